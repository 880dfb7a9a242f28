"""Token ids of whole texts, and a Parquet token store with selective reads.

The store is a Parquet folder in ascending document order.  Each file is one
range of documents, with one row per document: its place, its token count and
its ids as a list column.  Ids are dictionary-encoded (a vocabulary has fewer
ids than a dictionary page holds); document ids, places and counts are
delta-encoded; row groups and pages are small and carry a page index, so a read
of some documents, or of the counts alone, touches few bytes.

Defined results: null text is the empty text (its only id is the end id); null
document ids come first; rows that repeat a document id (null too) are kept, in
text order, and may fill several files; an empty table gives an empty store; columns beside the two named ones
are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.session import scratch_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2

#: A worker remembers the words of its last texts, between one and two times this many.
CACHE_WORDS = 300_000
#: Words given to the library at once (an encoding takes about a kilobyte while it lives).
WORDS_AT_ONCE = 10_000
#: Characters on which normalisation acts one by one and all lower-casings agree; a text with others goes to the library whole.
_OTHER = re.compile("[^\x00-\x7fÀ-ÖØ-öø-įĲ-ňŊ-ž]|<\\|")
#: The vocabulary's own pre-tokens over such lower-cased text.
_WORDS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ž]+|[0-9]|[^ \t\n\x0b\x0c\ra-z0-9ß-öø-ž]+")


#: The settings of a vocabulary file for which ``_OTHER`` and ``_WORDS`` hold (fixed values of the file format).
_SETTINGS = {
    "truncation": None, "padding": None, "post_processor": None,
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def splits_into_words(file: str) -> bool:
    """Whether a vocabulary file normalises and splits texts as ``_OTHER`` and ``_WORDS`` do."""
    with open(file, encoding="utf-8") as f:
        have = json.load(f)
    return all(have.get(k) == v for k, v in _SETTINGS.items()) and have["model"]["type"] == "BPE" \
        and not have["model"].get("dropout") and all("<|" in t["content"] for t in have["added_tokens"])


class Encoder:
    """``tokenizers`` over whole texts, with a memory of words: the library merges inside
    pre-tokens only, so a text's ids are those of its pre-tokens, one after another.  With a
    vocabulary of other settings every text goes to the library whole."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(file)
        self.splits = splits_into_words(file)
        self.by_word = Tokenizer.from_file(file)  # for single pre-tokens, already normalised
        self.by_word.normalizer = normalizers.Sequence([])
        self.by_word.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """One call for many words; ``word_ids`` tells whose each id is."""
        e = self.by_word.encode_batch([words], is_pretokenized=True, add_special_tokens=False)[0]
        cuts = (np.searchsorted(np.array(e.word_ids), np.arange(len(words) + 1)) * 4).tolist()
        flat = array("I", e.ids).tobytes()
        self.words.update((w, flat[a:b]) for w, a, b in zip(words, cuts, cuts[1:]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers.  Holds the pre-tokens of
        all texts given beside the bounded memory of words, so pass slices of texts."""
        split = [None if not self.splits or _OTHER.search(t) else _WORDS.findall(t.lower()) for t in texts]
        met = set().union(*[w for w in split if w is not None])
        if len(self.words) > CACHE_WORDS:  # words not met since the last time are forgotten
            self.words, self.older = {}, self.words
        new = met - self.words.keys()
        known = new & self.older.keys()
        self.words.update((w, self.older[w]) for w in known)
        new = list(new - known)
        for i in range(0, len(new), WORDS_AT_ONCE):
            self._learn(new[i:i + WORDS_AT_ONCE])
        get = self.words.__getitem__
        return [array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() if w is None else b"".join(map(get, w))
                for t, w in zip(texts, split)]


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """One encoder a worker process and vocabulary file."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def vocabulary_file() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


#: Texts that are held as Python strings at once.
SLICE_CHARS = 2_000_000


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a batch in slices of bounded size; null is empty."""
    col = batch.column(batch.schema.get_field_index(column))
    held: list[str] = []
    size = first = 0
    for i in range(len(col)):
        t = col[i].as_py() or ""
        held.append(t)
        size += len(t)
        if size >= SLICE_CHARS:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


STORE_SCHEMA = "part int, doc_id long, start_in_part long, n_tokens long, tokens array<int>"
WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start_in_part": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def _encode_partition(file: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, place = encoder(file), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            ids = batch.column(0)
            for first, texts in text_slices(batch):
                coded = [b + end for b in enc.encode(texts)]
                sizes = np.array([len(b) // 4 for b in coded], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.record_batch([
                    pa.array(np.full(len(texts), part, dtype=np.int32)),
                    ids.slice(first, len(texts)),
                    pa.array(place + offsets[:-1]), pa.array(sizes),
                    pa.ListArray.from_arrays(offsets.astype(np.int32), np.frombuffer(b"".join(coded), dtype="<i4")),
                ], names=["part", "doc_id", "start_in_part", "n_tokens", "tokens"])
                place += int(offsets[-1])

    return run


#: Characters of a text in a range key (the driver holds a sample of the keys).
RANGE_CHARS = 32


def write_store(docs: DataFrame, out: str, vocabulary: str, end_id: int = END_ID,
                doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` and write the store to the folder ``out``.  Only texts are shuffled, once, into ranges of
    (id, beginning of the text): an id that many rows share is split, in text order; rows that agree in both
    stay in one task, one after another."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    by_id = F.col("doc_id").asc_nulls_first()
    ordered = rows.repartitionByRange(by_id, F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions(by_id, "text")
    ordered.mapInArrow(_encode_partition(vocabulary, end_id), STORE_SCHEMA).write.options(**WRITE_OPTIONS).parquet(out)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, tokens): unused columns are not read, and filters on doc_id skip row groups and pages."""
    stored = spark.read.schema(STORE_SCHEMA).parquet(path)
    # one row a file: the sizes of the ranges, bounded by the number of files
    sizes = stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    place, starts = 0, []
    for part, n in sorted(sizes):
        starts.append((part, place))
        place += n
    base = spark.createDataFrame(starts, "b_part int, base long")
    return stored.join(F.broadcast(base), F.col("part") == F.col("b_part")) \
        .select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "tokens")


def read_window(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """The pieces of documents inside tokens [start, start + length) of the whole store, in order of ``start``."""
    rows = read_store(spark, path).filter((F.col("start") < start + length) & (F.col("start") + F.col("n_tokens") > start))
    skip = F.greatest(F.lit(0), F.lit(start) - F.col("start")).cast("int")
    stop = F.least(F.col("n_tokens"), F.lit(start + length) - F.col("start")).cast("int")
    return rows.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("tokens", skip + 1, stop - skip).alias("tokens"))


def ids_crc32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the last column, a list of ids, by the CRC-32 of its little-endian 32-bit form."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")
        offsets = lists.offsets.to_numpy()
        view = memoryview(values).cast("B")
        crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.record_batch([*batch.columns[:-1], pa.array(crc, pa.int64())],
                              names=[*batch.schema.names[:-1], "ids_crc32"])


def store_digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the store to the shared scratch folder, read it back: the rows of op9."""
    out = scratch_path(docs.sparkSession, "token-store")
    write_store(docs, out, vocabulary or vocabulary_file())
    return read_store(docs.sparkSession, out).mapInArrow(
        ids_crc32, "doc_id long, start long, n_tokens long, ids_crc32 long")
