"""SimHash, nearest neighbours, toxicity, WARC, token store, packing and the pipeline."""

import base64
import hashlib
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import corpus_pipeline
from claimlens.llm import ann, packing, simhash, tokens, toxicity, warc
from claimlens.session import materialize
from tests.llm.util import DOCS, SF_SMALL, documents, frame


# ---------------------------------------------------------------- SimHash

def brute_fingerprint(text):
    import re
    from xxhash import xxh64_intdigest
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=3):
    """fps: {id: fingerprint} -> {id: smallest id reachable}."""
    ids = sorted(fps)
    x = np.array([fps[i] for i in ids], dtype=np.uint64)
    label = np.arange(len(ids))
    near = [np.flatnonzero(np.bitwise_count(x ^ v) <= radius) for v in x]
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            return {i: ids[k] for i, k in zip(ids, label)}
        label = new


def test_simhash_equals_brute_force(spark):
    rows = documents(spark)
    got = {r["doc_id"]: r for r in simhash.digest(simhash.near_duplicates(spark.read.parquet(DOCS))).collect()}
    want = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: f"{v:016x}" for i, v in want.items()} == {i: r["fingerprint"] for i, r in got.items()}
    assert brute_components(want) == {i: r["component_id"] for i, r in got.items()}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("chunk", [2048, 4])
@pytest.mark.parametrize("radius", [0, 1, 3, 4])
def test_links_connect_what_brute_force_connects(spark, chunk, radius):
    rng = np.random.default_rng(radius)
    centres = [int(c) for c in rng.integers(0, 2**63, 12)]
    fps = set()
    for c in centres:
        for _ in range(25):
            bits = rng.choice(64, rng.integers(0, 6), replace=False)
            x = c
            for b in bits:
                x ^= 1 << int(b)
            fps.add(x)
    fps = {i: v for i, v in enumerate(sorted(fps))}
    nodes = spark.createDataFrame([(signed(v), i) for i, v in fps.items()], "fp long, node long")
    comp = {r["node"]: r["component"] for r in simhash.components(simhash.links(nodes, radius, chunk)).collect()}
    assert brute_components(fps, radius) == {i: comp.get(i, i) for i in fps}


def test_bit_sliced_comparison_counts_exactly():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**63, 500).astype(np.uint64)
    fps[100:200] = fps[0:100] ^ (np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64))
    planes = simhash.bit_planes(fps)
    for radius in (0, 1, 2, 3, 5, 7):
        for d in (1, 63, 64, 100, 130):
            mask = np.zeros((planes.shape[1] - 1) * 64, dtype=np.uint8)
            mask[:500 - d] = 1
            at, hits = simhash.within(planes, d, np.packbits(mask, bitorder="little").view("<u8"), radius)
            got = {int(w) * 64 + b for w, h in zip(at, hits) for b in range(64) if int(h) >> b & 1}
            want = set(np.flatnonzero(np.bitwise_count(fps[:-d] ^ fps[d:]) <= radius).tolist())
            assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001 + i) for i in range(50)] + [(5000, 5000), (7, 3)]
    got = {r["node"]: r["component"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(51)) and 5000 not in got
    assert simhash.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_simhash_edge_cases(spark):
    rows = [(5, None), (4, ""), (9, " \t\n"), (7, "One two"), (3, "one TWO"), (None, "one two"), (None, "alone here"),
            (8, "w " * 60_000), (8, "other words entirely"), (8, "w " * 60_000)]
    got = [(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(5, 4), (4, 4), (9, 4), (7, 3), (3, 3), (None, 3), (None, None), (8, 8), (8, 8), (8, 8)], key=str)
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    clash = frame(spark, rows).withColumns({c: F.lit(1) for c in ("fp", "node", "component", "u", "v", "bucket")})
    assert simhash.near_duplicates(clash).count() == len(rows)


# ---------------------------------------------------------------- nearest neighbours

def brute_neighbours(rows, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            s = (x * np.array(v)).sum(axis=1)
            order = [int(j) for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def neighbours(vectors, **more):
    rows = ann.usable(vectors)
    out = {}
    for r in ann.search(rows, rows.filter("vec_id % 20 = 0"), **more).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in out.items()}


def test_recall_and_scores(spark):
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want = brute_neighbours(rows)
    got = neighbours(table, shard_rows=40, block_queries=3)
    assert got.keys() == want.keys()
    hits = 0
    x = dict(rows)
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, len(want[q]) + 1))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(abs(float(np.dot(np.float64(x[q]), np.float64(x[i]))) - s) < 1e-12 for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    assert hits >= 0.9 * sum(map(len, want.values()))


@pytest.mark.parametrize("n", [1500, 4500])
def test_recall_with_one_very_long_vector(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(n)]
    rows[7] = (7, (rng.normal(size=32) * 1e10).tolist())
    got = neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    want = brute_neighbours(rows)
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    # the long one is found wherever it is among the nearest
    assert all(any(i == 7 for _, i, _ in got[q]) for q in want if any(i == 7 for i, _ in want[q]))


def test_everything_reranked_is_exact_with_ties(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(15, 8)).astype(np.float32)
    rows = [(i, [float(v) for v in base[i % 15] * (1 + i % 3)]) for i in range(200)] + [(200 + i, [float(v) for v in base[0]]) for i in range(100)]
    got = neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), rerank=1.0, shard_rows=16)
    want = brute_neighbours(rows)
    assert {q: [(i, round(s, 9)) for _, i, s in v] for q, v in got.items()} == {q: [(i, round(s, 9)) for i, s in v] for q, v in want.items()}


def test_footrule_by_inverted_files():
    rng = np.random.default_rng(0)
    perms = np.array([rng.permutation(12)[:5] for _ in range(30)])
    files = ann.InvertedFiles(perms, 12)
    query = rng.permutation(12)[:5]

    def place(p, v):
        return list(p).index(v) if v in p else 5

    want = [sum(abs(place(p, v) - place(query, v)) for v in range(12)) for p in perms]
    assert files.footrule(query).tolist() == want


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, [None, 1.0]), (4, [1.0]),
            (None, [1.0, 1.0]), (5, [0.5, 0.5]), (6, [0.5, 0.5]), (0, [1.0, 0.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1)).withColumn("v", F.lit(2))
    got = neighbours(docs)
    assert {q: [(r, i) for r, i, _ in v] for q, v in got.items()} == {0: [(1, 5), (2, 6)]}
    assert neighbours(docs.limit(0)) == {}


# ---------------------------------------------------------------- toxicity

def test_toxicity_flags_toxic_documents_and_leaves_clean_ones(spark):
    rng = np.random.default_rng(0)
    plain = [f"w{i}" for i in range(300)]
    bad = ["slur", "vile", "filth"]
    docs, labels = [], []
    for i in range(600):
        w = list(rng.choice(plain, 40))
        toxic = i % 4 == 0
        if toxic:
            w[int(rng.integers(40))] = bad[i % 3]
        docs.append((i, " ".join(w)))
        if i < 400:
            labels.append((i, 1 if i % 5 else 0, int(toxic)))
    d, lab = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.predict(d, toxicity.fit(d, lab)).collect()}
    assert len(got) == 600
    new = [got[i]["toxic"] == (i % 4 == 0) for i in range(400, 600)]
    assert sum(new) >= 0.95 * len(new)
    assert all(0 <= r["p_toxic"] <= 1 and 0 <= r["p_low_quality"] <= 1 for r in got.values())


def test_toxicity_keeps_rare_insults_beside_many_telling_words(spark):
    """1,200 ordinary words score a higher chi-squared than each rare insult, and the sample holds few of those."""
    rng = np.random.default_rng(5)
    mild = np.array(["m%04d" % i for i in range(1200)])
    common, rare = ["slur", "vile", "filth"], ["insult%s" % c for c in "abcdefghij"]
    rare = [w[-1] * 3 + w for w in rare]
    docs, labels = [], []
    for i in range(4000):
        toxic, quiet = i % 4 == 0, i % 8 == 0
        words = list(mild[rng.random(len(mild)) < (0.34 if toxic and not quiet else 0.07)])
        if toxic:
            words.append(rare[i // 8 % 10] if quiet and i < 2000 else common[i // 4 % 3])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    new = [(10_000 + i, " ".join(mild[rng.random(len(mild)) < 0.07]) + (" " + rare[i // 2 % 10] if i % 2 else "")) for i in range(80)]
    d = frame(spark, docs)
    model = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), sample=100)
    assert set(rare) <= set(model.terms) and len(model.terms) > 1000
    got = {r["doc_id"]: r["toxic"] for r in toxicity.predict(frame(spark, new), model).collect()}
    assert sum(got[i] for i, _ in new if i % 2) >= 36
    assert sum(got[i] for i, _ in new if i % 2 == 0) <= 4


def test_toxicity_edge_cases(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "vile " * 30_000), (None, "vile"), (3, "vile"), (4, "fine")])
    one_class = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.predict(docs, toxicity.fit(docs, one_class)).collect()
    assert len(got) == 6 and not any(r["toxic"] for r in got)
    none = one_class.limit(0)
    assert {r["p_toxic"] for r in toxicity.predict(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    assert toxicity.predict(docs.limit(0), toxicity.fit(docs.limit(0), one_class)).count() == 0


# ---------------------------------------------------------------- WARC

def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip_with_revisits(spark, tmp_path):
    rows = [(5, "http://a/5", "same"), (2, "http://a/2", "same"), (9, "http://a/ü x\r\nInjected: 1", "<p>é</p>" * 5000), (1, "http://a/1", ""), (3, None, None), (4, "u", "other")]
    at = str(tmp_path / "w")
    warc.write_pages(pages_of(spark, rows), at)
    back = {r["page_id"]: r for r in spark.read.format("warc").load(at).collect()}
    assert back.keys() == {r[0] for r in rows}
    first = {2: 2, 5: 2, 9: 9, 1: 1, 3: 1, 4: 4}
    for i, url, html in rows:
        payload = (html or "").encode()
        r = back[i]
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r["payload_bytes"] == len(payload)
        if first[i] == i:
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, payload)
        else:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", first[i], None)
    assert "\n" not in back[9]["target_uri"]


def test_warc_members_are_plain_gzip(spark, tmp_path):
    import gzip
    at = str(tmp_path / "w")
    warc.write_pages(pages_of(spark, [(1, "u", "body text")]).coalesce(1), at)
    name = next(f for f in os.listdir(at) if f.endswith(".warc.gz"))
    raw = gzip.open(os.path.join(at, name)).read()
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"body text\r\n\r\n")


def test_warc_ranges_and_pushed_filters(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "w")
    rows = [(i, f"http://h/{i}", f"page {i} " * (i % 50)) for i in range(400)] + [(1000 + i, "u", "page 1 ") for i in range(20)]
    warc.write_pages(pages_of(spark, rows).coalesce(1), at)
    split = spark.read.format("warc").option("rangebytes", "3000").load(at)
    assert split.rdd.getNumPartitions() > 5
    assert sorted(r["page_id"] for r in split.select("page_id").collect()) == sorted(r[0] for r in rows)
    revisits = spark.read.format("warc").load(at).filter("record_type = 'revisit'")
    assert "PushedFilters" not in "" and revisits.count() == 20 + 7
    two = spark.read.format("warc").load(at).filter(F.col("target_uri").isin("http://h/3", "http://h/4") & (F.col("page_id") > 3))
    assert [r["page_id"] for r in two.collect()] == [4]
    # without a payload column nothing behind the headers is decoded
    read = []
    reader = warc._Reader(spark.read.format("warc").schema("page_id long, record_type string").load(at).schema, {"path": at})
    monkeypatch.setattr(warc._Stream, "__call__", (lambda f: lambda self, until, size: read.append(until) or f(self, until, size))(warc._Stream.__call__))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == len(rows)
    assert len(read) == len(rows)  # one header block a record


def test_warc_ranges_find_records_with_long_code_tables(tmp_path):
    rng = np.random.default_rng(1)
    letters = list("etaoin shrdlucmfwypvbgkjqxzETAOINSHRDLU.,;:!?0123456789<>/=&#-_'()")
    wide = []  # body bytes before the first five plain ones come out
    at = str(tmp_path / "one.warc.gz")
    with open(at, "wb") as out:
        for i in range(300):
            share = rng.dirichlet(np.full(len(letters), 0.3))
            html = "".join(rng.choice(letters, int(rng.integers(2_000, 60_000)), p=share))
            packed = warc.member(warc._page_record({"page_id": i, "url": f"http://h/{i}", "html": html, "refers_to": None}, "2020-01-01T00:00:00Z"))
            wide.append(zlib.decompressobj(-15).decompress(packed[warc._HEAD.size:][:64], 5) != b"WARC/")
            out.write(packed)
    assert sum(wide) > 30
    for size in (10_007, 100_003):
        reader = warc._Reader(StructType().add("page_id", "long"), {"path": at, "rangebytes": str(size)})
        parts = reader.partitions()
        assert len(parts) > 20
        assert [i for p in parts for b in reader.read(p) for i in b.column(0).to_pylist()] == list(range(300))


def test_warc_counts_finished_attempts_only(spark, tmp_path):
    at = str(tmp_path / "w")
    warc.write_pages(pages_of(spark, [(i, f"u{i}", f"page {i}") for i in range(50)]), at)
    names = ["page_id", "url", "html", "refers_to"]

    def batch(ids):
        return pa.record_batch([pa.array(ids), pa.array(["u"] * len(ids)), pa.array([f"new {i}" for i in ids]),
                                pa.array([None] * len(ids), pa.int64())], names=names)

    def lost():
        yield batch([100, 101])
        raise RuntimeError("executor lost")

    writer = warc._Writer({"path": at})
    with pytest.raises(RuntimeError):
        writer.write(lost())                                 # half of a task's rows, then the attempt ends
    done = writer.write(iter([batch([100, 101, 102, 103])]))   # the next attempt
    writer.write(iter([batch([100, 101, 102, 103])]))          # a speculative one that comes second
    want = list(range(50))
    assert sorted(r["page_id"] for r in spark.read.format("warc").load(at).collect()) == want  # nothing of a job before its commit
    writer.commit([done])
    late = warc._Writer({"path": at})
    late.job = writer.job
    late.write(iter([batch([100])]))                           # and one that ends after the commit
    assert sorted(r["page_id"] for r in spark.read.format("warc").load(at).collect()) == [*want, 100, 101, 102, 103]
    other = warc._Writer({"path": at})
    other.write(iter([batch([7])]))
    other.abort([])
    assert not [f for f in os.listdir(at) if other.job in f]


@pytest.mark.parametrize("whole", [False, True])
def test_warc_reads_archives_without_length_fields(spark, tmp_path, whole):
    import gzip
    pages = [(i, f"http://h/{i}", f"<p>page {i}</p>" * (1 + 997 * (i % 7))) for i in range(60)] + [(90, "http://h/90", "z" * 5_000_000)]
    records = [zlib.decompressobj(-15).decompress(warc.member(warc._page_record(
        {"page_id": i, "url": u, "html": h, "refers_to": None}, "2020-01-01T00:00:00Z"))[warc._HEAD.size:]) for i, u, h in pages]
    at = tmp_path / "crawl.warc.gz"
    at.write_bytes(gzip.compress(b"".join(records)) if whole else b"".join(gzip.compress(r) for r in records))
    read = spark.read.format("warc").option("rangebytes", "5000").load(str(at))
    got = {r["page_id"]: r for r in read.collect()}
    assert got.keys() == {p[0] for p in pages} and read.count() == len(pages)
    assert all(bytes(got[i]["payload"]) == h.encode() for i, _, h in pages)
    assert [r["page_id"] for r in read.filter("target_uri = 'http://h/33'").select("page_id").collect()] == [33]
    cut = tmp_path / "cut.warc.gz"
    cut.write_bytes(at.read_bytes()[:-40])
    with pytest.raises(Exception, match="cut off"):
        spark.read.format("warc").load(str(cut)).count()


def test_warc_edge_cases(spark, tmp_path):
    none = pages_of(spark, [])
    assert warc.archive_digest(none).count() == 0
    rows = [(None, "u", "x"), (7, "u", "x"), (7, "u", "x"), (8, "u", "y" * 300_000)]
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive_digest(pages_of(spark, rows)).collect()), key=str)
    assert got == sorted([(None, "revisit", 7), (7, "response", None), (7, "response", None), (8, "response", None)], key=str)


# ---------------------------------------------------------------- tokens

def reference_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokens.vocabulary_file())
    return [e.ids + [2] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD_TEXTS = ["", None, "don't STOP'S we'LL", "áb é", "<|endoftext|> x<|endoftext|>y", "##ab.. (test) İstanbul ſtraße ΣΑΣ ŉ", "x\x1cy\x85z\xa0w",
             "$$$ de,&&& 12,3 l'été", "...hi!? \"quoted\" --a--b", "a" * 5000, "２３ 中文 字 \U0001f600", "x\x00y", "Ⅷ ² ª º µ × ÷", "tab\there\r\nnew"]


def test_encoder_equals_the_library(spark, monkeypatch):
    texts = ODD_TEXTS + [t for _, t in documents(spark)]
    want = reference_ids(texts)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 500)
    monkeypatch.setattr(tokens, "WORDS_AT_ONCE", 100)
    enc = tokens.Encoder(tokens.vocabulary_file())
    for i in range(0, len(texts), 20):
        part = [t or "" for t in texts[i:i + 20]]
        assert [np.frombuffer(b, "<u4").tolist() + [2] for b in enc.encode(part)] == want[i:i + 20]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_other_vocabularies_equal_the_library():
    from tokenizers import Tokenizer
    file = os.path.join(os.path.dirname(tokens.vocabulary_file()), "byte_bpe_50k.json")
    assert tokens.splits_into_words(tokens.vocabulary_file()) and not tokens.splits_into_words(file)
    texts = ["", "It's a  Test,\n\nÄÖ 12 34", "x" * 3000, "<|endoftext|> 😀 1a2b"]
    want = [e.ids for e in Tokenizer.from_file(file).encode_batch(texts, add_special_tokens=False)]
    assert [list(np.frombuffer(b, "<u4")) for b in tokens.Encoder(file).encode(texts)] == want


def test_token_store_splits_a_hot_id(spark, tmp_path):
    """20,000 rows without an id and 2,000 copies of one row, beside clashing columns."""
    rows = [(None, f"{i * 7919 % 20_000:05d} words") for i in range(20_000)] + [(5, "the same")] * 2000 + [(i, "x") for i in range(6, 100)]
    at = str(tmp_path / "hot")
    docs = frame(spark, rows).repartition(4).withColumns({c: F.lit(1) for c in ("part", "n_tokens", "tokens", "start", "base", "b_part")})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables make small ranges
    try:
        tokens.write_store(docs, at, tokens.vocabulary_file())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.read.parquet(at).groupBy("part").agg(F.sum(F.col("doc_id").isNull().cast("int")).alias("n")).filter("n > 0").collect()
    assert len(parts) > 2 and max(r["n"] for r in parts) < 15_000
    back = tokens.read_store(spark, at).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r["doc_id"] for r in back] == [r[0] for r in order]
    assert [list(r["tokens"]) for r in back] == reference_ids([t for _, t in order])


def test_token_store_round_trip(spark, tmp_path):
    rows = [(i * 3 % 101, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "first of all"), (0, "again zero")]
    at = str(tmp_path / "s")
    tokens.write_store(frame(spark, rows), at, tokens.vocabulary_file())
    back = tokens.read_store(spark, at).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = reference_ids([t for _, t in order])
    assert [r["doc_id"] for r in back] == [i for i, _ in order]
    assert [list(r["tokens"]) for r in back] == want
    assert [r["start"] for r in back] == [0, *np.cumsum([len(w) for w in want])[:-1].tolist()]
    flat = [x for w in want for x in w]
    window = tokens.read_window(spark, at, 10, 200).orderBy("start").collect()
    assert [x for r in window for x in r["tokens"]] == flat[10:210]


def test_token_files_have_indexes_and_encodings(spark, tmp_path):
    import pyarrow.parquet as pq
    at = str(tmp_path / "s")
    tokens.write_store(spark.read.parquet(DOCS), at, tokens.vocabulary_file())
    name = next(f for f in os.listdir(at) if f.endswith(".parquet"))
    group = pq.ParquetFile(os.path.join(at, name)).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert any("DICTIONARY" in e for e in columns["tokens.list.element"].encodings)
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert all(c.has_offset_index and c.has_column_index for c in columns.values())


def test_token_digest_empty(spark):
    assert tokens.store_digest(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- packing

def test_differencing_is_near_equal():
    rng = np.random.default_rng(0)
    sizes = [int(x) for x in rng.integers(1, 1025, 900)]
    for k in (1, 2, 7, 113):
        got = packing.differencing(sizes, k)
        assert sorted(i for w in got for i in w) == list(range(len(sizes)))
        sums = [sum(sizes[i] for i in w) for w in got]
        assert max(sums) - min(sums) <= 40
    windows = packing.pack_sizes(sizes)
    assert all(sum(sizes[i] for i in w) <= 4096 for w in windows)
    assert len(windows) <= -(-sum(sizes) // 4096) + 1
    assert packing.differencing([], 3) == []
    assert packing.pack_sizes([4096, 4096, 1]) and len(packing.pack_sizes([3000, 3000, 2000])) == 3


def check_pieces(rows, pieces):
    want = reference_ids([t for _, t in rows])
    by_doc = {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
    for (i, _), ids in zip(rows, want):
        own = sorted(by_doc.pop(i), key=lambda p: p["start"])
        at = 0
        for p in own:
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == crc(ids[at:at + p["length"]])
            at += p["length"]
        assert at == len(ids)
    assert not by_doc
    windows = {}
    for p in pieces:
        windows.setdefault(p["sequence_id"], []).append(p)
    for own in windows.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= 4096
    return sum(p["length"] for p in pieces), len(windows)


def test_packing_covers_every_token_once(spark):
    rows = documents(spark) + [(10**6 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(2 * 10**6, "word " * 30_000)]
    total, n = check_pieces(rows, packing.pack(frame(spark, rows).coalesce(1)).collect())
    assert n <= 1.02 * total / 4096 + 1
    with_ids = packing.pack(frame(spark, rows[:5]), with_ids=True).collect()
    assert all(crc(p["ids"]) == p["ids_crc32"] for p in with_ids)
    assert packing.pack(frame(spark, [])).count() == 0
    assert packing.pack(frame(spark, [(None, "a b"), (None, None)])).count() == 2


# ---------------------------------------------------------------- pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_stages(spark, tmp_path):
    docs = materialize(spark.read.parquet(DOCS), "test")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF_SMALL), "test")
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    assert kept[0].keys() == before.keys()  # every document has letters of a learned language
    comp = brute_components({i: brute_fingerprint(t) for i, t in kept[0].items()})
    assert kept[1].keys() == set(comp.values())
    from tests.llm.test_text_ops import BASE_PII, base_spans, brute_hits
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    assert kept[2].keys() == {i for i, t in kept[1].items() if not brute_hits(t, items)[1]}
    assert kept[3].keys() == kept[2].keys()
    for i, t in kept[3].items():
        assert (t == kept[2][i]) == (base_spans(BASE_PII, kept[2][i]) == "")
        assert base_spans(BASE_PII, t) == ""
    check_pieces(sorted(kept[3].items()), docs.collect())


def test_pipeline_with_odd_rows(spark, tmp_path):
    rows = [(i, f"the cat and the dog number {'abcdefghij'[i % 10] * 3} of the house " * 3, "en", "s", 1) for i in range(30)]
    rows += [(100, None, None, None, None), (101, "", "en", None, 0), (102, "!!! 123", "en", None, 1), (None, "a the dog without a number", None, None, None),
             (200, "the mouse writes to me@mail.com now and then", "en", "s", 1), (200, "the mouse writes to me@mail.com now and then", "en", "s", 1),
             (201, "one two three four five six seven eight nine ten the end", "en", "s", 1), (201, "the owl is clean and the owl is fine", "en", "s", 1)]
    d = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit(1)).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = materialize(stage(spark, docs, d), "test")
    left = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in docs.filter("doc_id >= 100").collect())
    assert left == [(200, "the mouse writes to <EMAIL> now and then", 40), (201, "the owl is clean and the owl is fine", 36)]
    assert docs.filter("doc_id IS NULL").count() == 1
    assert corpus_pipeline.run(spark, d).count() > 0


def test_pipeline_on_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
