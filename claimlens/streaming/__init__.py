"""Structured Streaming: the row-wise operators on ``readStream`` input."""
