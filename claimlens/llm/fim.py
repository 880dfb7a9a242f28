"""Fill-in-the-middle transformation with pyarrow.compute.

A text is cut into units, its lines with their line ends.  Two cuts between units, drawn
from a hash of the document's id, leave a prefix, a middle and a suffix; the output
gives them in the order of its form with a sentinel before each: ``psm`` prefix, suffix,
middle, ``spm`` suffix, prefix, middle, ``plain`` the text itself.

A batch is transformed by columns: the texts are split into list arrays, flattened with their parents'
indices, every unit gets its ordinal within its text and from that its role, the units of a role are filtered
and rebuilt into lists, and joined pieces make the outputs.  No row is touched in Python.
``restore`` rebuilds the texts from output and form alone.

Batches are worked on in slices of about ``SLICE`` bytes, so memory does not grow with the
rows of a batch.  Every row is transformed where it lies; nothing is shuffled.

Defined results: a null text is empty; an empty text, or one that contains a sentinel, is
plain; a null id hashes as an empty one; rows are judged one by one, so repeats give repeated
rows; an empty table gives no rows; columns beside the two named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SEED = 7
#: Of 100 texts so many are transformed, and of 100 of those so many as spm.
RATE = 100
SPM = 50
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of text worked on at once.
SLICE = 16 * 1024 * 1024

OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def hashes(doc_id: str = "doc_id", seed: int = SEED) -> list[Column]:
    """h1 to h4: the first four 8-digit groups of the hex SHA-256 of '<seed>:<doc_id>'."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def slices(batch: pa.RecordBatch, text: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``size`` bytes of text each; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, side="right")))
        yield batch.slice(a, b - a)
        a = b


def units(text: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """(units, the row of each, units a row): lines with their ends, the last one without if the text has none."""
    parts = pc.split_pattern(text, "\n")
    flat, parent = pc.list_flatten(parts), pc.list_parent_indices(parts)
    last = np.append(parent.to_numpy()[1:] != parent.to_numpy()[:-1], True)[:len(flat)]
    lined = pc.binary_join_element_wise(flat, pc.if_else(pa.array(last), "", "\n"), "")
    some = pc.not_equal(lined, "")  # what follows a closing line end is no unit
    lined, parent = lined.filter(some), parent.filter(some)
    return lined, parent, np.bincount(parent.to_numpy(), minlength=len(text)).astype(np.int64)


def pieces(lined: pa.Array, parent: pa.Array, role: np.ndarray, n: int) -> list[pa.Array]:
    """The joined units of each role 0, 1, 2 for n rows."""
    out = []
    for r in range(3):
        mask = pa.array(role == r)
        own = parent.filter(mask).to_numpy()
        ends = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))]).astype(np.int32)
        out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), lined.filter(mask)), ""))
    return out


def transform_batch(text: pa.Array, h: list[np.ndarray], rate: int = RATE, spm: int = SPM):
    """(units, form, prefix, middle, output) of a batch of texts without nulls."""
    lined, parent, n = units(text)
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)
    of = parent.to_numpy()
    ordinal = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    role = np.where(ordinal < low[of], 0, np.where(ordinal < high[of], 1, 2))
    prefix, middle, suffix = pieces(lined, parent, role, len(text))
    plain = pc.or_(pc.equal(text, ""), pa.array(h[2] % 100 >= rate))
    for s in SENTINELS:
        plain = pc.or_(plain, pc.match_substring(text, s))
    form = pc.if_else(plain, "plain", pc.if_else(pa.array(h[3] % 100 < spm), "spm", "psm"))
    p, s, m = SENTINELS
    spm_first = pc.equal(form, "spm")
    output = pc.binary_join_element_wise(
        pc.if_else(spm_first, s, p), pc.if_else(spm_first, suffix, prefix),
        pc.if_else(spm_first, p, s), pc.if_else(spm_first, prefix, suffix), m, middle, "")
    return n, form, prefix, middle, pc.if_else(plain, text, output)


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM,
              size: int = SLICE) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, size):
                h = [part.column(2 + i).to_numpy() for i in range(4)]
                n, form, prefix, middle, output = transform_batch(part.column(1), h, rate, spm)
                plain = pc.equal(form, "plain")
                chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
                yield pa.record_batch([part.column(0), pa.array(n), form, *chars, output], names=[c.split()[0] for c in OUT.split(", ")])

    return rows.select("doc_id", "text", *hashes(seed=seed)).mapInArrow(run, OUT)


def restore_batch(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts of outputs; no sentinel lies inside a piece of a transformed one."""
    p, s, m = SENTINELS

    def cut(x: pa.Array, at: str) -> tuple[pa.Array, pa.Array]:
        parts = pc.split_pattern(x, at, max_splits=1)
        return pc.list_element(parts, 0), pc.list_element(parts, 1)

    def psm(x):
        prefix, rest = cut(cut(x, p)[1], s)
        suffix, middle = cut(rest, m)
        return pc.binary_join_element_wise(prefix, middle, suffix, "")

    def spm(x):
        suffix, rest = cut(cut(x, s)[1], p)
        prefix, middle = cut(rest, m)
        return pc.binary_join_element_wise(prefix, middle, suffix, "")

    out = output
    for name, build in (("psm", psm), ("spm", spm)):
        own = pc.equal(form, name)
        if pc.any(own).as_py():
            out = pc.replace_with_mask(out, own, build(output.filter(own)))
    return out


def restore(found: DataFrame, size: int = SLICE) -> DataFrame:
    """The columns of ``transform`` and restored, the text rebuilt from output and form."""
    names = found.columns
    at, of = names.index("output"), names.index("form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at, size):
                yield pa.record_batch([*part.columns, restore_batch(part.column(at), part.column(of))], names=[*names, "restored"])

    return found.mapInArrow(run, StructType([*found.schema.fields, StructField("restored", StringType())]))


def digest(found: DataFrame) -> DataFrame:
    """The rows of op13: hashes in place of output and restored text."""
    return restore(found).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                                 F.sha2("restored", 256).alias("restored_sha256"))
