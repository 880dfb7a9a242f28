"""Models held by a Python worker process.

Functions shipped to workers are copied with the task, and so would a dictionary
beside them be.  This module is imported there instead, so what it holds lives as
long as the worker.
"""

from __future__ import annotations

from collections.abc import Callable

_MODELS: dict[str, Callable] = {}


def worker_model(name: str, factory: Callable[[], Callable]) -> Callable:
    """The model called ``name``, built by ``factory`` the first time a worker asks for it."""
    if name not in _MODELS:
        _MODELS[name] = factory()
    return _MODELS[name]
