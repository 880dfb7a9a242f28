"""Distributed top-k and the TF-IDF formulas against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from claimlens.operators import tfidf as T


@pytest.mark.parametrize("k", [1, 3, 7, 50, 500])
def test_top_k_by_count_matches_sort(spark, k):
    rnd = random.Random(k)
    rows = [(g, f"t{rnd.randint(0, 3000):05d}{rnd.choice('abc')}", rnd.choice([1, 2, 2, 3, 3, 3, 5, 8]))
            for g in range(3) for _ in range(400)]
    rows = list({(g, t): (g, t, c) for g, t, c in rows}.values())
    df = spark.createDataFrame(rows, "run int, term string, ctf long")
    got = sorted((r["run"], r["term"]) for r in T.top_k_by_count(df, k, by=("run",)).collect())
    want = []
    for g in range(3):
        grp = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:k]
        want += [(g, r[1]) for r in grp]
    assert got == sorted(want)


def test_tfidf_formulas(spark):
    docs = [(1, "TRAIN", "aa bb aa"), (2, "TRAIN", "bb cc"), (3, "TRAIN", ""), (4, "TEST", "aa zz")]
    df = spark.createDataFrame(docs, "row_id long, data_type string, text string")
    cfg = T.TfidfConfig("word", (1, 1), None, min_df=1)
    w, v = T.tfidf(df, "text", cfg, fit_on=("data_type", "TRAIN"))
    voc = {r["term"]: r for r in v.collect()}
    assert sorted(voc) == ["aa", "bb", "cc"] and [voc[t]["idx"] for t in ("aa", "bb", "cc")] == [0, 1, 2]
    n = 3  # token-less row counts
    idf = {t: math.log((1 + n) / (1 + voc[t]["df"])) + 1 for t in voc}
    assert voc["aa"]["idf"] == pytest.approx(idf["aa"])
    raw = {"aa": (1 + math.log(2)) * idf["aa"], "bb": idf["bb"]}
    nrm = math.sqrt(sum(x * x for x in raw.values()))
    got = {(r["row_id"], r["term"]): r["weight"] for r in w.collect()}
    assert got[(1, "aa")] == pytest.approx(raw["aa"] / nrm)
    assert got[(4, "aa")] == pytest.approx(1.0)          # unseen 'zz' dropped, row renormalised
    assert not any(k[0] == 3 for k in got)                # empty row has no entries


def test_unbounded_vocabulary_and_ties(spark):
    from claimlens.operators import tfidf as TF
    rows = [(i, f"t{j:03d}", 1 + (j % 3 == 0)) for j in range(200) for i in range(2)]
    tf = spark.createDataFrame(rows, "row_id long, term string, tf long")
    v = TF.fit_vocabulary(tf, 2, TF.TfidfConfig("word", (1, 1), None)).orderBy("idx").collect()
    assert [(r["idx"], r["term"]) for r in v] == [(j, f"t{j:03d}") for j in range(200)]
    # 67 terms have count 4; 33 of the 133 with count 2 follow, by term
    top = {r["term"] for r in TF.fit_vocabulary(tf, 2, TF.TfidfConfig("word", (1, 1), 100)).collect()}
    order = sorted(range(200), key=lambda j: (-(j % 3 == 0), j))[:100]
    assert top == {f"t{j:03d}" for j in order}


@pytest.mark.parametrize("cfg", [T.TfidfConfig("word", (1, 2), 12, min_df=1), T.TfidfConfig("char_wb", (2, 3), None, min_df=2)])
def test_ids_equal_strings_and_collisions_draw_them_anew(spark, cfg, monkeypatch):
    docs = [(i, " ".join(f"w{(i * j) % 7}" for j in range(9))) for i in range(12)] + [(20, None), (21, "")]
    df = spark.createDataFrame(docs, "row_id long, text string")
    tf = T.term_counts(df, "text", cfg)
    by_id = T.id_counts(df, "text", cfg)
    assert by_id.count() == tf.count()
    assert by_id.exceptAll(tf.select("row_id", T.term_id("term", 0).alias("tid"), "tf")).count() == 0
    want = {tuple(r) for r in T.fit_vocabulary(tf, len(docs), cfg).collect()}
    weights, voc = T.tfidf_by_id(df, "text", cfg)
    assert {tuple(r) for r in voc.collect()} == want
    weighed = weights.collect()
    # ids of one bit under the first salt: the terms that share one are noticed, the next salt is taken
    real, used = T.term_id, []

    def narrow(term, salt):
        used.append(salt)
        return real(term, salt) % 2 if salt == 0 else real(term, salt)

    monkeypatch.setattr(T, "term_id", narrow)
    weights, voc = T.tfidf_by_id(df, "text", cfg)
    assert {tuple(r) for r in voc.collect()} == want and {0, 1} <= set(used)
    assert sorted(map(tuple, weights.collect())) == sorted(map(tuple, weighed))


def test_only_the_boundary_bin_and_what_lies_above_is_written(spark, monkeypatch):
    rows = [(f"t{i:05d}", c) for i, c in enumerate([5000, 4000, 300, 7, 7, 6, 6, 6, 6] + [2] * 1000)]
    written = {}
    real = T.materialize
    monkeypatch.setattr(T, "materialize", lambda df, name: written.setdefault(name, real(df, name)))
    df = spark.createDataFrame(rows, "term string, ctf long")
    got = {r["term"] for r in T.top_k_by_count(df, 7).collect()}
    assert got == {f"t{i:05d}" for i in range(7)}
    assert written["vocabulary-candidates"].count() == 9 and written["vocabulary-ties"].count() == 4


def test_bins_rise_with_the_count(spark):
    df = spark.range(1, 200_000, 7).select("id", T._bin(F.col("id")).alias("b"))
    bins = [r["b"] for r in df.orderBy("id").collect()]
    assert bins == sorted(bins) and bins[0] == 1 and len(set(bins)) < 2000


@pytest.mark.parametrize("cfg", [T.TfidfConfig("word", (1, 2), None), T.TfidfConfig("char_wb", (2, 4), None)])
def test_partitions_of_the_counts_follow_the_texts(spark, cfg, monkeypatch):
    from collections import Counter
    from tests.test_text import python_char_wb
    docs = [(i, " ".join(f"wörd{(i * j) % 11}" for j in range(30))) for i in range(40)] + [(50, None), (51, ""), (52, "a b"), (1, "zz aa"), (None, "zz zz")]
    df = spark.createDataFrame(docs, "row_id long, text string")
    want = Counter()
    for i, t in docs:
        if cfg.analyzer == "char_wb":
            want.update((i, g) for g in python_char_wb(t or "", 2, 4))
        else:
            words = [w for w in (t or "").split() if len(w) > 1]
            want.update((i, g) for g in words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    monkeypatch.setattr(T, "PART_CHARS", 100)
    tf = T.term_counts(df, "text", cfg)
    chars = sum(len(t or "") for _, t in docs)
    assert tf.rdd.getNumPartitions() == -(-chars // 100)   # not coalesced by the bytes of the texts
    assert {(r[0], r[1]): r[2] for r in tf.collect()} == want
    some = spark.createDataFrame([("zz",), ("aa",), ("not there",)], "term string")
    got = T.term_counts(df, "text", cfg, among=some)
    assert {(r[0], r[1]): r[2] for r in got.collect()} == {k: n for k, n in want.items() if k[1] in ("zz", "aa")}


def test_counts_of_all_terms_are_not_written_for_one_vocabulary(spark, monkeypatch):
    written = []
    real = T.materialize
    monkeypatch.setattr(T, "materialize", lambda df, name: written.append(name) or real(df, name))
    df = spark.createDataFrame([(i, "TRAIN" if i % 3 else "TEST", f"aa bb w{i} w{i % 4}") for i in range(20)], "row_id long, data_type string, text string")
    w, v = T.tfidf(df, "text", T.TfidfConfig("word", (1, 2), 4), fit_on=("data_type", "TRAIN"))
    assert v.count() == 4 and w.select("term").distinct().count() == 4 and w.select("row_id").distinct().count() == 20
    assert "term-counts" not in written


def test_wanted_terms_beyond_the_limit_are_not_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i % 7, f"t{i}") for i in range(50)], "tid long, term string")
    wanted = spark.createDataFrame([(2,), (5,)], "tid long")
    assert T.BROADCAST_LIMIT_BYTES <= 64 << 20   # the driver builds a broadcast in its own memory
    monkeypatch.setattr(T, "BROADCAST_LIMIT_BYTES", 0)
    got = T.only(df, wanted, "tid")
    assert {r["tid"] for r in got.collect()} == {2, 5} and "BroadcastHashJoin LeftSemi, BuildRight, hint" not in got._jdf.queryExecution().toString()
    terms = T.Terms(df.select(F.lit(1).alias("row_id"), "tid", F.lit(1).alias("tf")), lambda: df.select("term"), lambda salt: None)
    ids = df.filter("tid = 2").select(T.term_id("term", 0).alias("tid"))
    assert sorted(r["term"] for r in terms.strings(ids).collect()) == sorted(f"t{i}" for i in range(50) if i % 7 == 2)


def _python_counts(docs, lo, hi):
    from collections import Counter
    import re
    out = Counter()
    for *key, text in docs:
        w = re.findall(r"\w{2,}", (text or "").lower())
        for n in range(lo, hi + 1):
            out.update((*key, " ".join(w[i:i + n])) for i in range(len(w) - n + 1))
    return out


@pytest.mark.parametrize("slice_tokens", [1, 5, 1000])
def test_word_counts_of_repeated_and_null_keys_across_slices(spark, monkeypatch, slice_tokens):
    # N-grams are counted in Arrow batches; a key's rows may lie in several slices, and some texts hold no n-gram
    from claimlens.operators import grams as G
    docs = [(i % 5 if i % 4 else None, "ab"[i % 2], " ".join(f"w{(i * j) % 7}" for j in range(i % 9))) for i in range(60)]
    docs += [(7, "a", None), (8, "a", "x"), (9, "a", "solo"), (9, "a", "solo Solo")]
    df = spark.createDataFrame(docs, "row_id long, kind string, text string").coalesce(1)
    want = _python_counts(docs, 1, 3)
    d = df.repartition(2, "row_id")
    tokens = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), " "), lambda w: F.length(w) > 1)
    lists = d.sortWithinPartitions("row_id", "kind").select("row_id", "kind", tokens.alias("t")).collect()
    # the worker's function itself, over batches of any size
    import pyarrow as pa
    monkeypatch.setattr(G, "SLICE_TOKENS", slice_tokens)
    monkeypatch.setattr(G, "LIST_TERMS", 3)
    monkeypatch.setattr(G, "HELD_PIECES", 2)
    lists.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    batches = [pa.record_batch([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.string()),
                                pa.array([r[2] for r in part], pa.list_(pa.string()))], names=["row_id", "kind", "_tokens"])
               for part in (lists[:11], lists[11:12], lists[12:])]
    got = [((b["row_id"], b["kind"], x["term"]), x["tf"]) for out in G.counting((1, 3), G._rows_sink(["row_id", "kind"]))(iter(batches))
           for b in out.to_pylist() for x in b["_counted"]]
    assert len(got) == len(dict(got)) and dict(got) == want
    totals = {}
    for out in G.counting((1, 3), G._totals_sink)(iter(batches)):
        for r in out.to_pylist():
            a, b = totals.get(r["term"], (0, 0))
            totals[r["term"]] = a + r["df"], b + r["ctf"]
    assert totals == {t: (sum(1 for k in want if k[2] == t), sum(n for k, n in want.items() if k[2] == t)) for t in {k[2] for k in want}}
    # and by the operator
    cfg = T.TfidfConfig("word", (1, 3), None)
    assert {tuple(r[:3]): r[3] for r in T.term_counts(df, "text", cfg, keep=("kind",)).collect()} == want


def test_the_terms_of_a_task_keep_their_number(spark, monkeypatch):
    # Partitions of the term sums follow the texts' length; the shuffle moves no row per n-gram and text
    docs = [(i, " ".join(f"u{i}x{j} common" for j in range(20))) for i in range(60)]
    df = spark.createDataFrame(docs, "row_id long, text string")
    monkeypatch.setattr(T, "PART_CHARS", 200)
    monkeypatch.setattr(T, "TERM_PARTS", 2)
    s = T.term_statistics(df, "text", T.TfidfConfig("word", (1, 1), None))
    parts = -(-sum(len(t) for _, t in docs) // 200)
    assert s.rdd.getNumPartitions() == -(-parts // 2)
    assert {r["term"]: (r["df"], r["ctf"]) for r in s.collect() if r["term"] == "common"} == {"common": (60, 1200)}


def test_weights_in_tasks_equal_those_by_joins(spark, monkeypatch):
    docs = [(i % 17, "TRAIN" if i % 3 else "TEST", " ".join(f"w{(i * j) % 13}" for j in range(i % 11))) for i in range(80)] + [(None, "TRAIN", "w1 w2 w1")]
    df = spark.createDataFrame(docs, "row_id long, data_type string, text string")
    cfg = T.TfidfConfig("word", (1, 2), 20)
    got = {tuple(r[:3]): r[3] for r in T.tfidf(df, "text", cfg, fit_on=("data_type", "TRAIN"), keep=("data_type",))[0].select("row_id", "data_type", "term", "weight").collect()}
    vocab = T.fit_vocabulary(T.term_counts(df.filter("data_type = 'TRAIN'"), "text", cfg, keep=("data_type",)), df.filter("data_type = 'TRAIN'").count(), cfg)
    by_join = T.tfidf_weights(T.term_counts(df, "text", cfg, keep=("data_type",)), vocab, keep=("data_type",)).select("row_id", "data_type", "term", "weight")
    want = {tuple(r[:3]): r[3] for r in by_join.collect()}
    assert got.keys() == want.keys() and len(got) > 100
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


@pytest.mark.parametrize("words", [100_000, 3])
def test_char_ngrams_are_cut_once_a_word_in_arrow_batches(spark, monkeypatch, words):
    # Each n-gram was a row of its own, through two explodes and a hash aggregate
    from collections import Counter
    monkeypatch.setattr(T.G, "SLICE_WORDS", words)
    texts = [(1, "Aa aa  b"), (2, None), (3, ""), (3, "aa \U0001F600x"), (3, "aa"), (None, "zz aa"), (None, "aa"), (5, "　q " + "lang" * 50), (6, " ")]
    df = spark.createDataFrame(texts, "row_id long, text string")
    want = Counter()
    for i, t in texts:
        for w in (t or "").lower().split():
            p = f" {w} "
            want.update((i, p[a:a + k]) for k in range(2, 6) for a in range(len(p) - k + 1))
    counts = T.term_counts(df, "text", T.CHAR)
    assert {(r["row_id"], r["term"]): r["tf"] for r in counts.collect()} == want
    assert "Generate explode" not in counts._jdf.queryExecution().executedPlan().toString()
    some = spark.createDataFrame([(" a",), ("aa",), ("ng",), ("no",)], "term string")
    assert {(r["row_id"], r["term"]): r["tf"] for r in T.term_counts(df, "text", T.CHAR, among=some).collect()} \
        == {k: n for k, n in want.items() if k[1] in (" a", "aa", "ng")}
    total = {r["term"]: (r["df"], r["ctf"]) for r in T.term_statistics(df, "text", T.CHAR).collect()}
    assert total == {t: (sum(k[1] == t for k in want), sum(n for k, n in want.items() if k[1] == t)) for t in {k[1] for k in want}}
