"""Centroid clustering, quality rules and fill-in-the-middle against brute force and edge cases."""

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from claimlens.llm import fim, lines, walsh
from tests.llm.util import DOCS, SF_SMALL


# ---------------------------------------------------------------- centroid clustering

def brute_clusters(rows, k, rounds, dimensions, seed=2):
    """Exhaustive Lloyd rounds in Python integers -> {row number: (cluster, distance)}, centroids."""
    x = [[math.floor(256 * c) if abs(c) < 1e300 else 256 * int(c) for c in v] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"{seed}:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), rows[i][0] or 0, rows[i][1]))
    cen = [x[i] for i in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cen))
    for _ in range(rounds):
        own = [near(v)[1] for v in x]
        cen = [[sum(col) // own.count(i) for col in zip(*[v for v, o in zip(x, own) if o == i])] if i in own else c for i, c in enumerate(cen)]
    return [(near(v)[1], near(v)[0]) for v in x], cen


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")


def check_clusters(spark, rows, k=5, rounds=3, dimensions=8):
    used = walsh.usable(vectors(spark, rows), dimensions)
    found, cen = walsh.cluster(used, k, rounds, dimensions)
    want, want_cen = brute_clusters(rows, k, rounds, dimensions)
    assert cen.tolist() == want_cen
    got = walsh.digest(found, cen).collect()
    inertia = [0] * k
    for c, d in want:
        inertia[c] += d

    def fit(v):
        return v if v < 1 << 63 else None
    key = str
    assert sorted([(r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"]) for r in got], key=key) \
        == sorted([(i, c, fit(d), fit(inertia[c]), fit(sum(inertia))) for (i, _), (c, d) in zip(rows, want)], key=key)
    assert {r["centroid_sha256"] for r in got} == {hashlib.sha256(",".join(map(str, want_cen[c])).encode()).hexdigest() for c, _ in want}


def test_clusters_equal_exhaustive_search(spark):
    rng = np.random.default_rng(3)
    check_clusters(spark, [(i, rng.normal(size=8).tolist()) for i in range(200)])


def test_ties_repeats_and_null_ids(spark):
    rng = np.random.default_rng(4)
    grid = [(i, rng.integers(-1, 2, 8).astype(float).tolist()) for i in range(120)]
    check_clusters(spark, grid + [(7, grid[7][1])] * 40 + [(None, [0.5] * 8)] * 3)


@pytest.mark.parametrize("size", [1e5, 1e12, 1e38, 1e300, 1e308])
def test_long_vectors_are_exact(spark, size):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(40)] + [(100 + i, (rng.normal(size=8) / 4 * size).tolist()) for i in range(4)]
    check_clusters(spark, rows)


def test_fewer_vectors_than_centroids_and_empty_clusters(spark):
    check_clusters(spark, [(i, [float(i)] * 8) for i in range(3)], k=3)
    found, cen = walsh.cluster(walsh.usable(vectors(spark, [(1, [1.0] * 8), (2, [1.0] * 8)]), 8), 40, 2, 8)
    assert len(cen) == 2 and {(r["vec_id"], r["cluster"]) for r in found.collect()} == {(1, 0), (2, 0)}


def test_unusable_vectors_take_no_part(spark):
    bad = [(1, None), (2, []), (3, [1.0] * 7), (4, [float("nan")] + [1.0] * 7), (5, [float("inf")] + [1.0] * 7), (6, [None] + [1.0] * 7)]
    assert walsh.usable(vectors(spark, bad + [(9, [0.0] * 8)]), 8).collect()[0]["vec_id"] == 9
    assert walsh.digest(*walsh.cluster(walsh.usable(vectors(spark, bad), 8), 4, 2, 8)).count() == 0
    assert walsh.digest(*walsh.cluster(walsh.usable(vectors(spark, []), 8), 4, 2, 8)).count() == 0


def test_clashing_columns_are_ignored(spark):
    x = vectors(spark, [(i, [float(i)] * 8) for i in range(9)]).selectExpr("vec_id", "embedding", "'z' AS cluster", "'z' AS limbs", "'z' AS v", "1 AS c")
    assert walsh.digest(*walsh.cluster(walsh.usable(x, 8), 2, 1, 8)).count() == 9


def test_transform_is_exact_and_search_eliminates():
    rng = np.random.default_rng(6)
    x = rng.integers(-500, 500, (300, 64))
    t = walsh.transform(x)
    assert ((t * t).sum(axis=1) == 64 * (x * x).sum(axis=1)).all()
    assert (t[:, 0] == x.sum(axis=1)).all()  # the coarsest coefficient
    smooth = np.cumsum(rng.integers(-30, 31, (300, 64)), axis=1)
    cluster, far, added = walsh.nearest(walsh.transform(smooth), walsh.transform(smooth[:40]))
    d = ((smooth[:, None, :] - smooth[None, :40, :]) ** 2).sum(axis=2)
    assert (cluster == d.argmin(axis=1)).all() and (far == 64 * d.min(axis=1)).all()
    assert added < 0.6 * 300 * 40 * 64  # most differences were never needed


# ---------------------------------------------------------------- quality rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_quality(rows, max_docs, max_share, max_loss):
    """rows: (doc_id, text, host); counts by sets of documents."""
    def lower(s):
        return re.sub("[A-Z]", lambda m: m[0].lower(), s)

    def norm(s):
        return " ".join(WORD.findall(lower(s)))
    docs, held = {}, {}
    for at, (i, t, h) in enumerate(rows):
        doc = ("row", at) if i is None else i
        docs.setdefault(h, set()).add(doc)
        for x in (t or "").split("\n"):
            if norm(x):
                held.setdefault((h, norm(x)), set()).add(doc)
    common = {k for k, v in held.items() if len(v) > max_docs and len(v) > max_share * len(docs[k[0]])}
    out = []
    for i, t, h in rows:
        t = t or ""
        w = WORD.findall(t)
        own = [x for x in t.split("\n") if WORD.search(x)]
        wins = [tuple(w[p:p + 8]) for p in range(len(w) - 7)]
        hit = {p + j for p, x in enumerate(wins) if wins.count(x) > 1 for j in range(8)}
        left = [x for x in t.split("\n") if (h, norm(x)) not in common]
        gone = [x for x in own if (h, norm(x)) in common]
        lost = sum(len(WORD.findall(x)) for x in gone)
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        out.append((i, "\n".join(left), len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(own) - len(set(own)), len(hit),
                    len(gone), lost, failed, not failed and not lost > max_loss * len(w)))
    return out


def quality_rows():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)] + ["Über", "#x", "a$b"]
    shared = [" ".join(rng.choice(words, 6)) for _ in range(8)]
    rows = []
    for i in range(150):
        own = [" ".join(rng.choice(words, rng.integers(0, 12))) for _ in range(rng.integers(0, 9))]
        own += [s.upper() if rng.random() < .3 else s.replace(" ", "\t ") for s in rng.choice(shared, rng.integers(0, 6))]
        rng.shuffle(own)
        rows.append((i, "\n".join(own), f"h{rng.integers(0, 3)}" if rng.random() < .8 else None))
    rows += [(200, None, "h0"), (201, "", None), (202, " \n\t\n", "h1"), (203, "same words\n" * 40, "h0"), (204, "a b c d e f g h " * 2, "h2")]
    rows += [rows[3]] * 30 + [(None, "null id line one two three\n" + rows[5][1], "h1")] * 12 + [(5, "another text under id five\n" + shared[0], rows[5][2])]
    return rows


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, h, "clash", 1) for i, t, h in rows], "doc_id long, text string, source string, host string, key long")


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
@pytest.mark.parametrize("limits", [(6, 0.001, 0.5), (2, 0.1, 0.25)])
def test_quality_equals_brute_force(spark, limits, broadcast_bytes):
    rows = quality_rows()
    got = lines.quality(docs_frame(spark, rows), *limits, broadcast_bytes=broadcast_bytes).collect()
    want = brute_quality(rows, *limits)
    assert sum(w[7] for w in want) > 20 and 0 < sum(w[10] for w in want) < len(want)
    cols = ["doc_id", "text", *lines.BASE, "n_removed_lines", "n_removed_words", "base_failed", "kept"]
    assert sorted((tuple(r[c] for c in cols) for r in got), key=str) == sorted(want, key=str)


def test_quality_of_an_empty_table(spark):
    assert lines.digest(lines.quality(docs_frame(spark, []))).count() == 0


def test_repeated_words_of_a_long_text():
    words = [f"w{i}" for i in range(200_000)]
    assert lines.repeated_words(words) == 0
    assert lines.repeated_words(words + words[1000:1008]) == 16
    assert lines.repeated_words(["x"] * 100_000) == 100_000
    assert lines.repeated_words(["x"] * 8) == 0 and lines.repeated_words(["x"] * 9) == 9


# ---------------------------------------------------------------- fill-in-the-middle

def brute_fim(i, t, seed=7, rate=100, spm=50):
    t = t or ""
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * j:8 * j + 8], 16) for j in range(4))
    u = re.findall(r"[^\n]*\n|[^\n]+", t)
    if t == "" or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return i, len(u), "plain", None, None, t
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < spm:
        return i, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = [None, "", "\n", "\n\n\n", "one line", "ends\n", "a\nb\nc", "\nstarts", "has <S> in it\nx", "<P", "<", "ünï\r\ncode   x\n😀\n", "x\n" * 50_000]


@pytest.mark.parametrize("size", [fim.SLICE, 200, 1])
@pytest.mark.parametrize("rate", [100, 40])
def test_fim_equals_brute_force_and_restores(spark, size, rate):
    rows = [(i, ODD[i % len(ODD)]) for i in range(len(ODD) * 6)] + [(None, "null\nid\nx")] * 3 + [(5, "same\nid")] * 2
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, form string, h1 int, output string")
    out = fim.restore(fim.transform(df, rate=rate, size=size), size).collect()
    assert sorted([tuple(r)[:-1] for r in out], key=str) == sorted([brute_fim(i, t, rate=rate) for i, t in rows], key=str)
    assert sorted(r["restored"] for r in out) == sorted(t or "" for _, t in rows)
    assert len({r["form"] for r in out}) == 3


def test_fim_of_real_documents_and_of_none(spark):
    docs = spark.read.parquet(DOCS)
    got = {r["doc_id"]: r for r in fim.digest(fim.transform(docs)).collect()}
    for r in docs.collect():
        want = brute_fim(r["doc_id"], r["text"])
        g = got[r["doc_id"]]
        assert (g["n"], g["form"], g["prefix_chars"], g["middle_chars"]) == want[1:5]
        assert g["output_sha256"] == hashlib.sha256(want[5].encode()).hexdigest()
        assert g["restored_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert fim.digest(fim.transform(docs.limit(0))).count() == 0


def test_restore_keeps_pieces_in_place():
    out = pa.array(["<P>a<S>c<M>b", "<S>c<P>a<M>b", "as it is", "<P><S><M>"])
    assert fim.restore_batch(out, pa.array(["psm", "spm", "plain", "psm"])).to_pylist() == ["abc", "abc", "as it is", ""]


def test_small_table_is_read_whole(spark):
    n = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").count()
    assert walsh.digest(*walsh.cluster(walsh.usable(spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")))).count() == n
