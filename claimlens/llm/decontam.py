"""Benchmark decontamination with a distributed positional inverted index.

The index is sharded by document: each segment (some megabytes of text) is one
row that maps every indexed term to the sorted places where it stands, in
coordinates that run through the segment's documents with a gap between them.
Building it shuffles nothing; it is stored as Parquet, places delta-encoded.

A phrase search takes a window's terms from the rarest of the corpus on, shifts
each posting list by the term's offset in the window and intersects them.  A
proximity search asks for an item's rarest terms within a span of each other.

Test items are dealt into blocks of about ``BLOCK_WORDS`` words by a hash, each with
the corpus counts of its words (a join), and groups of index segments meet every
block in a co-group.  No item and no count passes through the driver.

Defined results: null text has no words and counts as such; an item without
words, or null, occurs nowhere; items that repeat an id are one item with all
their windows; an item with a null id marks words but is in no list, near or exact; null and
repeated document ids are kept, one row each; empty tables give no rows, or rows
without hits; columns beside the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.tokens import WRITE_OPTIONS, text_slices
from claimlens.session import materialize, scratch_path

WINDOW = 10
BLOCK_WORDS = 500_000

# A-Z to a-z; digits, letters and all non-ASCII bytes stay; the rest separates words
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


# ---------------------------------------------------------------- index

SEGMENT = ("segment string, doc_ids array<long>, n_words array<int>, "
           "terms array<string>, ends array<int>, places array<int>")
INDEX_OPTIONS = {k: v for k, v in WRITE_OPTIONS.items() if "#" not in k} | {
    "parquet.enable.dictionary": "false", "parquet.page.row.count.limit": "20000"}


def _index_partition(terms: list[bytes] | None):
    fixed = None if terms is None else {t: i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_segment = TaskContext.get().partitionId(), 0
        for batch in batches:
            docs = batch.column(0)
            for first, texts in text_slices(batch):
                known = {} if fixed is None else fixed
                numbers, sizes = [], []
                for text in texts:
                    w = words(text)
                    sizes.append(len(w))
                    if fixed is None:
                        numbers += [known.setdefault(x, len(known)) for x in w]
                    else:
                        numbers += [known.get(x, -1) for x in w]
                    numbers.append(-1)  # the gap between documents
                t = np.array(numbers, dtype=np.int32)
                at = np.flatnonzero(t >= 0).astype(np.int32)
                t = t[at]
                order = np.argsort(t.astype(np.uint16) if len(known) <= 65535 else t, kind="stable")
                counts = np.bincount(t, minlength=len(known)) if len(t) else np.zeros(len(known), np.int64)
                has = np.flatnonzero(counts)
                names = list(known) if fixed is None else terms
                yield pa.record_batch([
                    pa.array([f"{part}-{n_segment}"]),
                    pa.array([docs.slice(first, len(texts)).to_pylist()], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int32())),
                    pa.array([[names[i].decode("utf-8", "surrogatepass") for i in has]], pa.list_(pa.string())),
                    pa.array([np.cumsum(counts[has]).astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([at[order]], pa.list_(pa.int32())),
                ], names=["segment", "doc_ids", "n_words", "terms", "ends", "places"])
                n_segment += 1

    return run


def build_index(docs: DataFrame, path: str, terms: list[bytes] | None = None,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the index of all terms, or of the given ones, to ``path`` and return it."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows.mapInArrow(_index_partition(terms), SEGMENT).write.options(**INDEX_OPTIONS).parquet(path)
    return docs.sparkSession.read.schema(SEGMENT).parquet(path)


def term_counts(index: DataFrame) -> DataFrame:
    """(term, n): how often each indexed term stands in the whole corpus."""
    lists = index.select(F.posexplode("terms").alias("i", "term"), "ends").select(
        "term", (F.get("ends", F.col("i")) - F.coalesce(F.get("ends", F.col("i") - 1), F.lit(0))).alias("n"))
    return lists.groupBy("term").agg(F.sum("n").alias("n"))


class Segment:
    """One row of the index, opened."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        self.name = col["segment"][row].as_py()
        self.doc_ids = col["doc_ids"][row].as_py()
        self.sizes = col["n_words"][row].values.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = col["ends"][row].values.to_numpy(zero_copy_only=False)
        places = col["places"][row].values.to_numpy(zero_copy_only=False)
        begin = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        terms = col["terms"][row].as_py()
        self.lists = {t.encode("utf-8", "surrogatepass"): (a, b) for t, a, b in zip(terms, begin.tolist(), ends.tolist())}
        self.places = places
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)])  # last: the end of the segment

    def list(self, term: bytes) -> np.ndarray:
        a, b = self.lists.get(term, (0, 0))
        return self.places[a:b]

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


def intersect(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Those of the sorted ``a`` that the sorted ``b`` holds."""
    if not len(a) or not len(b):
        return a[:0]
    i = np.searchsorted(b, a)
    i[i == len(b)] = 0
    return a[b[i] == a]


def phrase(segment: Segment, steps: list[tuple[bytes, int]]) -> np.ndarray:
    """Starting places of a phrase given as (term, offset), rarest term first."""
    term, offset = steps[0]
    starts = segment.list(term) - offset
    for term, offset in steps[1:]:
        if not len(starts):
            break
        starts = intersect(starts, segment.list(term) - offset)
    return starts


def near(segment: Segment, terms: list[bytes], span: int) -> np.ndarray:
    """Documents (numbers in the segment) where all terms stand within ``span`` words of the first one's place."""
    at = segment.list(terms[0])
    doc = segment.document(at)
    low = np.maximum(at - span, segment.starts[doc])
    high = np.minimum(at + span, segment.starts[doc + 1] - 1)
    ok = np.ones(len(at), dtype=bool)
    for term in terms[1:]:
        other = segment.list(term)
        ok &= np.searchsorted(other, low, side="left") < np.searchsorted(other, high, side="right")
    return np.unique(doc[ok])


# ---------------------------------------------------------------- search

def windows(items: list[tuple[str | None, list[bytes]]], width: int) -> dict[tuple, set]:
    """Every window and the items it stands in; an item of fewer words is one window."""
    found: dict[tuple, set] = {}
    for item, w in items:
        for i in range(max(1, len(w) - width + 1)):
            found.setdefault(tuple(w[i:i + width]), set()).add(item)
    found.pop((), None)
    return found


ITEMS = "item string, words array<string>"


def item_words(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item: the id as a string, words) of every item that has words; full repeats once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(
                [[w.decode("utf-8", "surrogatepass") for w in words(t)] for t in batch.column(1).to_pylist()], pa.list_(pa.string()))],
                names=["item", "words"])

    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("t"))
    return rows.mapInArrow(run, ITEMS).filter(F.size("words") > 0).distinct()


BLOCK = "block int, item string, words array<string>, n long"


def item_blocks(items: DataFrame, index: DataFrame, blocks: int) -> DataFrame:
    """Rows of the blocks: items (n is null), dealt by a hash, and the corpus counts (n) of each block's words."""
    dealt = items.select(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).cast("int").alias("block"), "item", "words")
    terms = dealt.select("block", F.explode("words").alias("t")).distinct()
    counts = terms.join(term_counts(index), F.col("t") == F.col("term"))
    return dealt.withColumn("n", F.lit(None).cast("long")).union(
        counts.select("block", F.lit(None).cast("string").alias("item"), F.array("t").alias("words"), "n"))


class Block:
    """A block of items, opened: phrases as (steps, length, items), sets of near terms as (item, terms)."""

    def __init__(self, table: pa.Table, width: int, rarest: int):
        items, counts = [], {}
        for item, w, n in zip(*(table.column(c).to_pylist() for c in ("item", "words", "n"))):
            w = [x.encode("utf-8", "surrogatepass") for x in w]
            if n is None:
                items.append((item, w))
            else:
                counts[w[0]] = n
        self.phrases = []
        for window, of in windows(items, width).items():
            steps = sorted(((t, i) for i, t in enumerate(window)), key=lambda s: (counts.get(s[0], 0), s))
            if counts.get(steps[0][0], 0):
                self.phrases.append((steps, len(window), sorted(x for x in of if x is not None)))
        self.sets = []
        for item, w in items:
            known = sorted((t for t in set(w) if counts.get(t, 0)), key=lambda t: (counts[t], t))[:rarest]
            if item is not None and len(known) >= min(2, len(set(w))):
                self.sets.append((item, known))


HITS = "segment string, number int, doc_id long, n_words long, hits array<int>, items array<string>, near array<string>"


def search(s: Segment, block: Block, span: int) -> pa.RecordBatch:
    """What a block's items leave in the documents of a segment, one row a document."""
    n_docs = len(s.sizes)
    marked = np.zeros(int(s.starts[-1]) + 1, dtype=bool)
    of: dict[int, set] = {}
    close: dict[int, set] = {}
    for steps, n, names in block.phrases:
        if steps[0][0] not in s.lists or steps[1 % len(steps)][0] not in s.lists:
            continue
        starts = phrase(s, steps)
        if len(starts):
            for j in range(n):
                marked[starts + j] = True
            for d in np.unique(s.document(starts)).tolist():
                of.setdefault(d, set()).update(names)
    for item, terms in block.sets:
        if all(t in s.lists for t in terms):
            for d in near(s, terms, span).tolist():
                close.setdefault(d, set()).add(item)
    at = np.flatnonzero(marked)
    doc = s.document(at)
    cuts = np.searchsorted(doc, np.arange(n_docs + 1))
    return pa.record_batch([
        pa.array([s.name] * n_docs, pa.string()), pa.array(np.arange(n_docs, dtype=np.int32)),
        pa.array(s.doc_ids, pa.int64()), pa.array(s.sizes),
        pa.ListArray.from_arrays(cuts.astype(np.int32), (at - s.starts[doc]).astype(np.int32)),
        pa.array([sorted(of.get(d, ())) for d in range(n_docs)], pa.list_(pa.string())),
        pa.array([sorted(close.get(d, ())) for d in range(n_docs)], pa.list_(pa.string())),
    ], names=[c.split()[0] for c in HITS.split(", ")])


#: Segments of the index that one task opens, one after another, for one block of items.
SEGMENTS = 64


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_words: int = BLOCK_WORDS,
                  rarest: int = 4, span: int = 2 * WINDOW, index_terms: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, hits (places of words inside a window), items (ids, sorted) and
    near (ids, sorted): the items whose ``rarest`` rarest words all stand within ``span`` words of the rarest
    one, in any order, so paraphrased or shuffled items that no phrase search finds.

    Only words that the corpus holds are ranked for ``near``, so words that a paraphrase brought in don't hide
    an item; an item needs two of them (one if it has no more words), or it is near nothing.

    Index segments and blocks of items meet by a co-group.  The index holds the items' words only, if these are
    at most ``index_terms`` different ones (they go to every task), else all words; the result is the same."""
    spark = docs.sparkSession
    items = materialize(item_words(benchmark), "benchmark-words")
    total = items.agg(F.sum(F.size("words")).alias("n")).first()["n"] or 0
    terms = [r["t"].encode("utf-8", "surrogatepass")
             for r in items.select(F.explode("words").alias("t")).distinct().limit(index_terms + 1).collect()]
    index = build_index(docs, scratch_path(spark, "positional-index"), sorted(terms) if len(terms) <= index_terms else None)
    blocks = max(1, -(-total // block_words))
    segments = index.count()
    groups = max(1, -(-segments // SEGMENTS), min(segments, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    left = index.withColumn("g", F.pmod(F.xxhash64("segment"), F.lit(groups)).cast("int"))
    left = left.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else left.withColumn("b", F.lit(0))
    right = materialize(item_blocks(items, index, blocks), "benchmark-blocks").select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.col("block").alias("b"), "item", "words", "n")

    schema = pa.schema([("segment", pa.string()), ("number", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
                        ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])

    def run(key: tuple, rows: pa.Table, of: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        block = Block(of, width, rarest)
        found = pa.Table.from_batches([search(Segment(batch, i), block, span).cast(schema)
                                       for batch in rows.to_batches() for i in range(batch.num_rows)], schema)
        if key[1].as_py():  # every document comes once from the first block
            some = pc.or_(pc.greater(pc.list_value_length(found["hits"]), 0), pc.greater(pc.list_value_length(found["near"]), 0))
            found = found.filter(some)
        return found

    found = left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(run, HITS)
    if blocks > 1:
        both = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hits", "items", "near")]
        found = found.groupBy("segment", "number").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *both)
    return found.drop("segment", "number")


def proximity(docs: DataFrame, benchmark: DataFrame, rarest: int = 4, span: int = 2 * WINDOW,
              block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id as a string) of the proximity matches of :func:`contamination`, each pair once."""
    found = contamination(docs, benchmark, block_words=block_words, rarest=rarest, span=span)
    return found.select("doc_id", F.explode("near").alias("item_id")).distinct()


def digest(found: DataFrame) -> DataFrame:
    """The rows of op3."""
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("hits").cast("long").alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
                        F.size("near").cast("long").alias("n_near"), F.sha2(F.array_join("near", ","), 256).alias("near_sha256"))
