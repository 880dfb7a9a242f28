"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has a bit for each of 64 positions: 1 if over half the hashes of
the document's word shingles, repeats included, have it.  Fingerprints link at
``radius`` or fewer differing bits; a component is what links reach.

Candidates: the 64 bits are cut into radius + 2 bands, so two linked fingerprints
agree on at least two whole bands, and every pair of bands is a table.  Within a
table's bucket all pairs are compared, bit-sliced: rows are sorted by bucket, the
64 bit planes are stored vertically (one machine word holds a plane of 64 rows),
and the rows are compared with the rows d places on, for d = 1, 2, ...  Carry-save
counters add up the differing bits of 64 pairs at a time, and words whose pairs
all exceed the radius, or cross buckets, are abandoned.  Buckets over ``CHUNK`` rows are
dealt into chunks, and each pair of chunks is a bucket of its own, so no task
holds a hot bucket and no pair is lost.

Only a spanning forest of the links that a task finds leaves it, never all pairs.
Components come from rounds of min-neighbour hooking over the contracted edges,
each written to the shared folder.

Defined results: null and empty texts have no words, fingerprint zero, and are
linked like any other; equal fingerprints are one node, whose document is the
smallest id (nulls aside); a null id belongs to its fingerprint's component
(null if no equal fingerprint has an id);
repeated rows are each returned; an empty table gives no rows; columns beside
the two named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.session import materialize

SHINGLE = 3
RADIUS = 3
SEED = 42
BITS = 64
#: Most rows of one bucket that one task compares with each other.
CHUNK = 2048


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: str, width: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text as an unsigned integer."""
    from xxhash import xxh64_intdigest
    data = text.encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
    words = data.split()  # bytes: space and \x09-\x0d
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxh64_intdigest(b" ".join(words), seed)]
    else:
        flat = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = len(words) - width + 1
        hashes = [xxh64_intdigest(flat[a:b], seed)
                  for a, b in zip(starts[:n].tolist(), ends[width - 1:].tolist())]
    planes = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = planes.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py() or "", width, seed) for t in batch.column(0)]
            yield pa.record_batch([*batch.columns[1:], pa.array(np.array(prints, dtype=np.uint64).view(np.int64), pa.int64())],
                                  names=[*batch.schema.names[1:], "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED,
                 doc_id: str = "doc_id", text: str = "text", keep: str | None = None) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long.  ``keep``: a long column to carry along."""
    kept = [F.col(keep).cast("long").alias(keep)] if keep else []
    rows = docs.select(F.col(text).alias("text"), F.col(doc_id).cast("long").alias("doc_id"), *kept)
    return rows.mapInArrow(_fingerprint_batches(width, seed), "doc_id long, " + (f"{keep} long, " if keep else "") + "fp long")


# ---------------------------------------------------------------- bit-sliced comparison

def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words) array: bit r of plane b's words is bit b of fingerprint r; one word more than needed."""
    n = len(fps)
    words = n // 64 + 2
    bits = np.zeros((words * 64, BITS), dtype=np.uint8)
    bits[:n] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8").reshape(BITS, words)


_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def within(planes: np.ndarray, d: int, live: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows differ from the row d places on in at most ``radius`` bits.

    ``live`` marks the rows to compare (one bit each, in words).  Returns (word numbers, words).
    The counters start at 2**k - 1 - radius, so a pair overflows as soon as it exceeds the radius.
    """
    q, s = divmod(d, 64)
    at = np.flatnonzero(live)
    wanted = live[at]
    k = max(1, int(radius).bit_length())
    begin = (1 << k) - 1 - radius
    counters = [np.full(len(at), _FULL if begin >> j & 1 else 0, dtype=np.uint64) for j in range(k)]
    over = np.zeros(len(at), dtype=np.uint64)
    left, right = np.uint64(s), np.uint64(64 - s)
    for b in range(BITS):
        plane = planes[b]
        other = plane[at + q]
        if s:
            other = (other >> left) | (plane[at + q + 1] << right)
        carry = plane[at] ^ other
        for j in range(k):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
        over |= carry
        if b % 8 == 7:  # abandon words of which no wanted pair is left
            keep = (wanted & ~over) != 0
            if not keep.all():
                at, wanted, over = at[keep], wanted[keep], over[keep]
                counters = [c[keep] for c in counters]
                if not len(at):
                    break
    return at, wanted & ~over


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def forest(fps: np.ndarray, bucket: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links among rows of equal ``bucket`` (sorted; larger buckets first), as edges (row, root) of a spanning forest."""
    n = len(fps)
    sizes = np.diff(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])))
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # rows from here to the bucket's end
    width = planes = None
    parent = np.arange(n)
    for d in range(1, int(sizes.max(initial=1))):
        reach = int(sizes[sizes > d].sum())  # larger buckets come first
        if planes is None:
            width = reach
            planes = bit_planes(fps[:width])
        mask = np.zeros((planes.shape[1] - 2 + 1) * 64, dtype=np.uint8)
        mask[:reach] = room[:reach] > d
        live = np.packbits(mask, bitorder="little").view("<u8")
        at, hits = within(planes, d, live, radius)
        hit = np.flatnonzero(hits)
        if len(hit):
            on = np.unpackbits(hits[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            word, bit = np.nonzero(on)
            a = at[hit][word] * 64 + bit
            b = a + d
            while True:  # flat roots, so that pairs already joined drop out together
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            new = parent[a] != parent[b]
            for x, y in zip(a[new].tolist(), b[new].tolist()):
                x, y = _find(parent, x), _find(parent, y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return [(i, _find(parent, i)) for i in np.flatnonzero(parent != np.arange(n)).tolist()]


#: Rows that a task compares together at most, unless one bucket has more.
BLOCK_ROWS = 65536


def _links(radius: int):
    def block(b: np.ndarray, fp: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, inverse, counts = np.unique(b, return_inverse=True, return_counts=True)
        size = counts[inverse]
        order = np.lexsort((node, inverse, -size))
        order = order[size[order] > 1]
        if not len(order):
            return
        edges = forest(fp[order], inverse[order], radius)
        if edges:
            rows = np.array(edges)
            yield pa.record_batch([pa.array(node[order][rows[:, 0]]), pa.array(node[order][rows[:, 1]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a block ends at a bucket's end."""
        held: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                b, fp, node = (np.concatenate([h[i] for h in held]) for i in range(3))
                cut = int(np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))[-1])
                if cut:
                    yield from block(b[:cut], fp[:cut].view(np.uint64), node[:cut])
                held, n = [[b[cut:], fp[cut:], node[cut:]]], len(b) - cut
        if n:
            b, fp, node = (np.concatenate([h[i] for h in held]) for i in range(3))
            yield from block(b, fp.view(np.uint64), node)

    return run


def bands(radius: int) -> list[int]:
    """Masks of radius + 2 bands of near-equal width."""
    n = radius + 2
    cuts = [BITS * i // n for i in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts[:-1], cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Edges (u, v) among ``nodes`` (fp distinct, node distinct) that connect exactly what links within ``radius`` connect."""
    masks = [_signed(a | b) for a, b in combinations(bands(radius), 2)]
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    rows = nodes.select("fp", "node", F.explode(keys).alias("k")).select("fp", "node", F.xxhash64("k.t", "k.key").alias("bucket"))
    # buckets over a chunk: their rows are dealt by hash, each pair of chunks is a bucket of its own
    hot = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > chunk) \
        .select(F.col("bucket").alias("h_bucket"), F.ceil(F.col("n") / F.lit(chunk)).cast("int").alias("m"))
    own = F.pmod(F.xxhash64(F.col("fp"), F.lit("chunk")), F.col("m")).cast("int")
    spread = rows.join(hot, F.col("bucket") == F.col("h_bucket"), "left").select(
        "fp", "node", "bucket", F.explode(F.when(F.col("m").isNull(), F.array(F.lit(None).cast("long"))).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("m") - 1),
                        lambda o: F.least(own, o).cast("long") * F.col("m") + F.greatest(own, o)))).alias("pair"))
    dealt = spread.select(F.when(F.col("pair").isNull(), F.col("bucket")).otherwise(F.xxhash64("bucket", "pair")).alias("bucket"),
                          "fp", "node")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_links(radius), "u long, v long")


# ---------------------------------------------------------------- components

def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node with an edge, the smallest node it reaches.

    Each round hooks every node of the contracted graph to its smallest neighbour,
    follows the hooks to their roots by doubling and contracts; the number of
    rounds is logarithmic.  A star's centre is one group of a partial aggregate, and the
    joins' hot keys are split by AQE.
    """
    maps = []
    e = materialize(edges.filter("u <> v").distinct(), "components-edges")
    while not e.isEmpty():
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("to")), "components-hook")
        while True:  # to < u except at roots: no cycles
            h = hook.alias("h")
            g = hook.select(F.col("u").alias("g_u"), F.col("to").alias("g_to"))
            doubled = materialize(h.join(g, F.col("h.to") == F.col("g_u"))
                                  .select(F.col("h.u").alias("u"), F.col("g_to").alias("to"),
                                          (F.col("g_to") != F.col("h.to")).alias("moved")), "components-hook")
            moved = not doubled.filter("moved").isEmpty()
            hook = doubled.select("u", "to")
            if not moved:
                break
        maps.append(hook)
        a = hook.select(F.col("u").alias("a_u"), F.col("to").alias("a"))
        b = hook.select(F.col("u").alias("b_u"), F.col("to").alias("b"))
        e = materialize(e.join(a, F.col("u") == F.col("a_u")).join(b, F.col("v") == F.col("b_u"))
                        .filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "components-edges")
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).limit(0)

    def follow(first: DataFrame, then: DataFrame) -> DataFrame:
        t = then.select(F.col("u").alias("t_u"), F.col("to").alias("t_to"))
        return first.join(t, F.col("to") == F.col("t_u"), "left").select("u", F.coalesce("t_to", "to").alias("to"))

    return reduce(follow, maps).select(F.col("u").alias("node"), F.col("to").alias("component"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, seed: int = SEED,
                    doc_id: str = "doc_id", text: str = "text", keep: str | None = None) -> DataFrame:
    """(doc_id, [keep,] fp, component_id, part) for every row: the smallest id reachable over links, itself included.

    ``part`` numbers the components; it differs from component_id only where ids repeat, and is null
    for a fingerprint without any id."""
    prints = materialize(fingerprints(docs, width, seed, doc_id, text, keep), "simhash-prints")
    nodes = materialize(prints.filter(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    # a document id with several texts is a node once for each fingerprint, under the id itself as well
    shared = nodes.groupBy("node").agg(F.min("fp").alias("one"), F.count("*").alias("n")).filter("n > 1").isEmpty()
    if not shared:
        nodes = nodes.withColumn("node", F.col("fp"))  # repeated ids: number nodes by fingerprint
    comp = components(links(nodes, radius))
    of_print = nodes.join(comp.withColumnRenamed("node", "c_node"), F.col("node") == F.col("c_node"), "left") \
        .select(F.col("fp").alias("n_fp"), F.coalesce("component", "node").alias("part"))
    of_print = of_print.withColumn("component", F.col("part"))
    if not shared:
        least = prints.join(of_print, F.col("fp") == F.col("n_fp")).groupBy(F.col("part").alias("l")).agg(F.min("doc_id").alias("least"))
        of_print = of_print.join(least, F.col("part") == F.col("l")).select("n_fp", "part", F.col("least").alias("component"))
    return prints.join(of_print, F.col("fp") == F.col("n_fp"), "left") \
        .select("doc_id", *([keep] if keep else []), "fp", F.col("component").alias("component_id"), "part")


def digest(found: DataFrame) -> DataFrame:
    """The rows of op2."""
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
