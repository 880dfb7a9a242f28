"""Optimality of the fits against a brute-force gradient (no external solver needed)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.operators import linear as L
from claimlens.operators import models as MD
from claimlens.operators import tfidf as T
from claimlens.plans import baseline as B
from claimlens.sources import tables as S
from claimlens.session import materialize
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def small_vectors(spark):
    c = S.claims(spark, SF_SMALL)
    w, vocab = T.tfidf(c, "text_concat", T.WORD, fit_on=("data_type", "TRAIN"))
    d = vocab.count()
    vec = MD.with_vectors(c.select("row_id", "data_type", "label"), w).filter("data_type = 'TRAIN'")
    return vec.toPandas(), d


def gradient(x, y01, w, spec):
    """Brute force over dense rows, per unit of sample weight."""
    y = np.where(y01 == 1, 1.0, -1.0)
    counts = np.bincount(y01, minlength=2)
    s = (len(y01) / (2 * counts))[y01]
    _, dz = L.loss_terms(spec.loss, x @ w[:-1] + w[-1], y, s)
    _, g = L.regulariser(spec.loss, w)
    g = g.copy()
    g[:-1] += spec.C * (x.T @ dz)
    g[-1] += spec.C * dz.sum()
    return g / (spec.C * s.sum())


def dense(pdf, d):
    x = np.zeros((len(pdf), d))
    for i, (at, v) in enumerate(zip(pdf["indices"], pdf["values"])):
        x[i, np.asarray(at, dtype=int)] = v
    return x


@pytest.mark.parametrize("spec", [L.LOGREG, L.SVM])
@pytest.mark.parametrize("parts", [1, 5])
def test_fit_is_optimal(spark, small_vectors, spec, parts):
    pdf, d = small_vectors
    sdf = spark.createDataFrame(pdf[["indices", "values", "label"]]).repartition(parts)
    w, info = MD.fit(sdf, d, spec)
    assert info["converged"]
    g = gradient(dense(pdf, d), pdf["label"].to_numpy().astype(int), w, spec)
    assert np.max(np.abs(g)) < 1e-4
    if spec.loss == "logistic":
        assert abs(g[-1]) < 1e-5  # free intercept: weighted residuals sum to zero


def test_pieces_and_small_blocks_add_up_the_same(spark, small_vectors, monkeypatch):
    pdf, d = small_vectors
    sdf = spark.createDataFrame(pdf[["indices", "values", "label"]]).repartition(7)
    whole, _ = MD.fit(sdf, d, L.LOGREG)
    monkeypatch.setattr(L, "PIECE", 100)
    monkeypatch.setattr(L, "BLOCK_ENTRIES", 500)
    parts, _ = MD.fit(sdf, d, L.LOGREG)
    assert np.max(np.abs(whole - parts)) < 1e-3


def packed(spark, pdf, parts, n_runs=1, roles="1"):
    rows = spark.createDataFrame(pdf[["row_id", "indices", "values", "label"]]).repartition(parts).withColumn("roles", F.lit(roles))
    return L.pack(rows, n_runs).persist()


@pytest.mark.parametrize("spec", [L.LOGREG, L.SVM])
def test_newton_needs_few_passes_from_a_sample(spark, small_vectors, spec, monkeypatch):
    pdf, d = small_vectors
    blocks = packed(spark, pdf, 4)
    whole, info = L.fit_runs(blocks, 1, d, spec)
    assert info[0]["passes"] <= 2  # the sample held all rows: only the certificate is left
    cold, cold_info = L.fit_runs(blocks, 1, d, spec, warm=False)
    monkeypatch.setattr(L, "SAMPLE", int(pdf["indices"].map(len).sum()) // 2)
    part, part_info = L.fit_runs(blocks, 1, d, spec)
    blocks.unpersist()
    assert cold_info[0]["converged"] and part_info[0]["converged"]
    assert np.max(np.abs(whole - cold)) < 1e-3 and np.max(np.abs(whole - part)) < 1e-3
    assert info[0]["iterations"] <= cold_info[0]["iterations"] / 2
    assert part_info[0]["passes"] <= cold_info[0]["passes"]


def test_a_pass_is_one_job_over_as_many_tasks_as_the_entries_need(spark, small_vectors, monkeypatch):
    pdf, d = small_vectors
    monkeypatch.setattr(L, "BLOCK_ENTRIES", int(pdf["indices"].map(len).sum()) // 3 + 1)
    problem = L.Problem("logistic", np.ones(1), np.ones(1), np.ones((1, 2)), None)
    found = []
    for parts in (2, 40):
        blocks = packed(spark, pdf, parts)
        near = L.gathered(blocks, L.class_counts(blocks, 1)[2])
        assert near.rdd.getNumPartitions() == min(parts, 3)
        spark.sparkContext.setJobGroup(f"pass-{parts}", "one pass")
        found.append(L.pass_over(near, problem, {0: (np.full(d + 1, 0.1), None)}, 1, d)[0])
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"pass-{parts}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        blocks.unpersist()
        # AQE runs the map side and the result as jobs of their own
        assert len(jobs) <= 2
    assert abs(found[0][0] - found[1][0]) < 1e-6 and np.max(np.abs(found[0][1] - found[1][1])) < 1e-9


@pytest.mark.parametrize("k", [1, 3, 4, 50])
def test_products_with_many_vectors_equal_dense_ones(k):
    rng = np.random.default_rng(k)
    x = rng.normal(size=(40, 25)) * (rng.random((40, 25)) < 0.2)
    x[5] = 0
    x[:, 7] = 0
    x[39] = 0
    ptr = np.append(0, np.cumsum((x != 0).sum(axis=1)))
    cols, vals = np.nonzero(x)[1].astype(np.int32), x[x != 0]
    b = L.Block(40, [ptr, cols, vals, np.ones((40, 1)), np.ones((40, 1), np.int8), np.ones(40), np.arange(40), *L._by_column(ptr, cols, vals, k)], 1)
    u, t = rng.normal(size=(k, 25)), rng.normal(size=(40, k))
    out = np.ones((k, 25))
    for chunk in (L.CHUNK, 8):
        L.CHUNK, keep = chunk, L.CHUNK
        assert np.allclose(b.times(u), x @ u.T)
        L.CHUNK = keep
    b.transposed(t, out)
    assert np.allclose(out, 1 + t.T @ x)


def test_conjugate_gradients_stop_at_the_region_and_recover():
    # far from the minimum the model of this function is poor: steps are cut back until they decrease it
    steps = L.newton(np.array([30.0, -20.0]), gtol=1e-10, least_curvature=1e-3)
    ask = next(steps)
    f = lambda x: float(np.sum(np.sqrt(1 + x * x)))
    while True:
        x, v = ask
        try:
            ask = steps.send((f(x), x / np.sqrt(1 + x * x)) if v is None else v / (1 + x * x) ** 1.5)
        except StopIteration as end:
            x, value, g, _, ok = end.value
            break
    assert ok and np.max(np.abs(x)) < 1e-6 and abs(value - 2) < 1e-9


def test_unconverged_fits_are_reported(spark, small_vectors):
    pdf, d = small_vectors
    sdf = spark.createDataFrame(pdf[["indices", "values", "label"]])
    spec = L.LinearSpec("logistic", 1.0, max_iter=2)
    with pytest.raises(MD.NotConverged):
        MD.fit(sdf, d, spec)
    _, info = MD.fit(sdf, d, spec, strict=False)
    assert not info["converged"] and info["grad_max"] > 0


@pytest.mark.parametrize("spec", [L.LOGREG, L.SVM])
def test_fit_many_is_optimal_and_scores_every_test_row_once(spark, spec):
    c = S.claims(spark, SF_SMALL)
    tr = c.filter("data_type = 'TRAIN'")
    tf = T.term_counts(tr, "text_concat", T.WORD)
    rows = tr.select("row_id", "label")
    assign = B.fold_assignments(tr, k=3)
    out, info = MD.fit_many(tf, rows, assign, T.WORD, spec, shared_rows=True)
    got = {(r["run"], r["row_id"]): r for r in out.collect()}
    assert len(got) == out.count() == tr.count()
    infos = {r["run"]: r for r in info.collect()}
    assert all(r["converged"] for r in infos.values())
    # each run against a fit of its own over the relational per-run vectors
    vec = MD.run_vectors(tf, rows, assign, T.WORD).toPandas()
    for run, v in vec.groupby("run"):
        d = int(v["d"].iloc[0])
        train, test = v[v["role"] == "train"], v[v["role"] == "test"]
        assert infos[run]["n_train"] == len(train) and infos[run]["n_features"] == d
        sdf = spark.createDataFrame(train[["indices", "values", "label"]])
        w, _ = MD.fit(sdf, d, spec)
        assert np.max(np.abs(gradient(dense(train, d), train["label"].to_numpy().astype(int), w, spec))) < 1e-4
        z = dense(test, d) @ w[:-1] + w[-1]
        mine = np.array([got[run, i]["margin"] for i in test["row_id"]])
        assert np.max(np.abs(z - mine)) < 1e-2
        if spec.loss == "logistic":
            assert all(0 < got[run, i]["prob"] < 1 for i in test["row_id"])
        else:
            assert all(got[run, i]["prob"] is None for i in test["row_id"])


def test_no_group_holds_a_run_and_no_cache_is_left(spark):
    c = S.claims(spark, SF_SMALL)
    scores = B.cross_val_scores(c.filter("data_type = 'TRAIN'"), T.WORD, L.LOGREG, k=3)
    assert scores.count() == 3
    assert "FlatMapGroupsInPandas" not in scores._jdf.queryExecution().toString()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_run_vocabulary_only_from_training_rows(spark):
    rows = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0)], "row_id long, label int")
    tf = spark.createDataFrame([(1, "aa", 1), (2, "aa", 1), (3, "zz", 1), (4, "zz", 1)],
                               "row_id long, term string, tf long")
    assign = spark.createDataFrame([(0, 1, "train"), (0, 2, "train"), (0, 3, "test"), (0, 4, "test")],
                                   "run long, row_id long, role string")
    v = MD.run_vectors(tf, rows, assign, T.TfidfConfig("word", (1, 1), None)).collect()
    by = {r["row_id"]: r for r in v}
    assert by[1]["d"] == 1 and list(by[1]["values"]) == [1.0]
    assert list(by[3]["indices"]) == []          # unseen term dropped: zero vector


def test_subtractive_run_vocabularies_match_direct(spark):
    c = S.claims(spark, SF_SMALL)
    tr = c.filter(F.col("data_type") == "TRAIN")
    tf = materialize(T.term_counts(tr, "text_concat", T.WORD), "test-counts")
    assign = B.fold_assignments(tr, k=3)
    for cfg in (T.WORD, T.TfidfConfig("word", (1, 2), 50, min_df=3)):
        x = MD.run_vocabularies(tf, assign, cfg, shared_rows=True)
        y = MD.run_vocabularies(tf, assign, cfg, shared_rows=False)
        assert x.count() == y.count() and x.exceptAll(y).count() == 0


def test_l2_norms(spark):
    c = S.claims(spark, SF_SMALL)
    w, _ = T.tfidf(c, "text_concat", T.WORD, fit_on=("data_type", "TRAIN"))
    n = w.groupBy("row_id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n"))
    assert n.filter(F.abs(F.col("n") - 1.0) > 1e-9).count() == 0


def test_top_features(spark):
    coef = spark.createDataFrame([("a", 0, 0.5), ("b", 1, -0.5), ("c", 2, 0.5), ("d", 3, 0.1)],
                                 "term string, idx long, coef double")
    t = MD.top_features(coef, 2).collect()
    mani = [r["term"] for r in t if r["direction"] == "MANI"]
    assert mani == ["a", "c"]
    assert [r["term"] for r in t if r["direction"] == "NO_MANI"] == ["b", "d"]


def test_saved_winner_gives_identical_predictions(spark, tmp_path):
    c = S.claims(spark, SF_SMALL)
    words = [m for m in B.BASELINES if m[0] != "tfidf_char_lr"]
    results, fitted = B.fit_baselines(c, with_cv=False, models=words)
    key = B.save_best(results, fitted, str(tmp_path / "best"))
    m = fitted[key]
    weights, _ = T.tfidf(c, "text_concat", m.cfg, fit_on=("data_type", "TRAIN"))
    want = {r["row_id"]: r for r in MD.predict(weights, c.select("row_id"), m.coef, m.intercept, m.spec).collect()}
    got = {r["row_id"]: r for r in B.score_saved(spark, str(tmp_path / "best"), c.select("row_id", "text_concat")).collect()}
    assert got.keys() == want.keys()
    assert all(got[i]["prediction"] == want[i]["prediction"] and abs(got[i]["margin"] - want[i]["margin"]) < 1e-9 for i in got)


def test_calibration_fits_each_fold_once(spark, monkeypatch):
    from claimlens.plans import robustness as RB
    runs = []
    fit_runs = L.fit_runs
    monkeypatch.setattr(L, "fit_runs", lambda blocks, n, *a, **k: runs.append(n) or fit_runs(blocks, n, *a, **k))
    c = S.claims(spark, SF_SMALL)
    tr = c.filter("data_type = 'TRAIN'")
    oof = RB.oof_probabilities(RB.shared_term_counts(tr), tr.select("row_id", "label"), k=5)
    test = oof.withColumn("prediction", (F.col("prob") > 0.5).cast("int"))
    assert RB.calibration_report(oof, test).count() == 1
    assert runs == [5]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


@pytest.mark.parametrize("spec", [L.LOGREG, L.SVM])
def test_certificate_equals_dense_arithmetic(spark, small_vectors, spec):
    """Gradient, objectives and gap of an arbitrary point, against dense rows."""
    from claimlens.operators.certificate import certificate
    docs = [(1, "aa bb cc", 1), (2, "aa dd", 0), (3, "bb bb dd ee", 1), (4, "", 0), (5, "cc ee aa", 0)]
    df = spark.createDataFrame(docs, "row_id long, text string, label int")
    cfg = T.TfidfConfig("word", (1, 1), None, min_df=1)
    tf = T.term_counts(df, "text", cfg)
    terms = ["aa", "bb", "cc", "dd", "ee"]
    w, b = np.array([0.3, -0.2, 0.5, 0.1, -0.7]), 0.25
    idf = np.array([1.0, 1.5, 2.0, 0.5, 1.2])
    coef = spark.createDataFrame([(0, t, float(i), float(c)) for t, i, c in zip(terms, idf, w)] + [(0, None, 1.0, b)],
                                 "run long, term string, idf double, coef double")
    got = certificate(tf, df.select(F.lit(0).cast("long").alias("run"), "row_id", "label"), coef, spec).first()
    x = np.array([[(1 + np.log(t.split().count(k))) * i if k in t.split() else 0.0 for k, i in zip(terms, idf)] for _, t, _ in docs])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    y01 = np.array([d[2] for d in docs])
    y, s = np.where(y01 == 1, 1.0, -1.0), (5 / (2 * np.bincount(y01)))[y01]
    g = gradient(x, y01, np.append(w, b), spec)
    lost, _ = L.loss_terms(spec.loss, x @ w + b, y, s)
    reg, _ = L.regulariser(spec.loss, np.append(w, b))
    u, m = spec.C * s, y * (x @ w + b)
    if spec.loss == "logistic":
        a = u / (1 + np.exp(m))
        a1, a0 = a[y > 0].sum(), a[y < 0].sum()
        a = a * np.where(y > 0, min(1, a0 / a1), min(1, a1 / a0))
        dual = -0.5 * np.sum((x.T @ (a * y)) ** 2) - np.sum(a * np.log(a / u) + (u - a) * np.log((u - a) / u))
    else:
        a = 2 * u * np.maximum(0, 1 - m)
        dual = -0.5 * np.sum((x.T @ (a * y)) ** 2) - 0.5 * (a @ y) ** 2 + np.sum(a - a * a / (4 * u))
    assert got["n_train"] == 5 and got["n_features"] == 5
    assert got["grad_max"] == pytest.approx(np.max(np.abs(g))) and got["primal"] == pytest.approx(reg + spec.C * lost)
    assert got["dual"] == pytest.approx(dual) and got["gap"] == pytest.approx((reg + spec.C * lost - dual) / (reg + spec.C * lost))


def test_terms_that_no_run_can_hold_are_dropped_and_no_other(spark):
    from claimlens.operators import tfidf as T
    rnd = np.random.default_rng(5)
    rows = [(int(i), f"t{t:03d}", int(n)) for i in range(60) for t, n in zip(range(200), rnd.integers(1, 4, 200)) if rnd.random() < 2 / (2 + t / 8)]
    tf = spark.createDataFrame(rows, "row_id long, term string, tf long")
    roles = MD.Roles(spark.createDataFrame([(i, "".join("2" if i % 4 == r else "1" for r in range(4))) for i in range(60)], "row_id long, roles string"),
                     [0, 1, 2, 3], True)
    for k in (7, 20, 500):
        cfg = T.TfidfConfig("word", (1, 1), k)
        voc, names, left = MD.run_term_ids(T.Terms.of_counts(tf), roles, cfg)
        got = {(r["run"], r["term"], round(r["idf"], 12)) for r in voc.join(names.select("tid", "term"), "tid").collect()}
        want = {(r["run"], r["term"], round(r["idf"], 12)) for r in MD.run_vocabularies(tf, roles, cfg).collect()}
        assert got == want
        # with fewer than k terms a run any may be in a vocabulary
        assert (left.counts.count() < tf.count()) == (k < 500) and (names.count() < 100) == (k < 500)


def test_runs_counts_are_taken_once_where_the_frequent_terms_cover_them(spark, monkeypatch):
    # the runs' counts were summed twice, for the bound and for the vocabularies
    from claimlens.operators import tfidf as T
    rnd = np.random.default_rng(11)
    rows = [(int(i), f"t{t:03d}", int(n)) for i in range(60) for t, n in zip(range(150), rnd.integers(1, 4, 150)) if rnd.random() < 2 / (2 + t / 3)]
    tf = spark.createDataFrame(rows, "row_id long, term string, tf long")
    roles = MD.Roles(spark.createDataFrame([(i, "".join("2" if i % 4 == r else "1" for r in range(4))) for i in range(60)], "row_id long, roles string"),
                     [0, 1, 2, 3], True)
    calls = []
    real = MD.run_term_stats
    for k in (15, 500):   # fewer terms than k and more
        cfg = T.TfidfConfig("word", (1, 1), k)
        want = {(r["run"], r["term"]): r["idf"] for r in MD.run_vocabularies(tf, roles, cfg).collect()}
        monkeypatch.setattr(MD, "run_term_stats", lambda *a, **b: calls.append(a) or real(*a, **b))
        calls.clear()
        voc, names, _ = MD.run_term_ids(T.Terms.of_counts(tf), roles, cfg)
        got = {(r["run"], r["term"]): r["idf"] for r in voc.join(names.select("tid", "term"), "tid").collect()}
        monkeypatch.undo()
        assert got == pytest.approx(want) and len(calls) == 1


def quadratic(h, g):
    """Minimises 0.5 x h x - g x by ``newton`` from zero -> (x, products)."""
    def run(**more):
        steps = L.newton(np.zeros(len(g)), gtol=1e-9, least_curvature=1e-3, **more)
        ask, n = next(steps), 0
        while True:
            x, v = ask
            n += v is not None
            try:
                ask = steps.send((0.5 * x @ h @ x - g @ x, h @ x - g) if v is None else h @ v)
            except StopIteration as end:
                return end.value[0], n
    return run


def test_steepest_directions_save_products_and_end_at_the_same_point():
    # A start from a sample saved hardly a pass; its Hessian's steepest directions do
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(200, 200)))[0]
    h = (turn * np.append([2000.0, 300.0, 60.0, 30.0, 10.0], rng.uniform(1, 2, 195))) @ turn.T
    h = (h + h.T) / 2
    steps = L.steepest(200)
    v = next(steps)
    while True:
        try:
            v = steps.send(h @ v)
        except StopIteration as end:
            found = end.value
            break
    assert np.allclose(found[0][:3], [2000, 300, 60], rtol=1e-3) and np.allclose(found[1] @ found[1].T, np.eye(len(found[0])), atol=1e-8)
    run = quadratic(h, rng.normal(size=200))
    (plain, n), (steep, fewer) = run(), run(steep=(found[0], found[1].astype(np.float32)))
    assert np.allclose(plain, steep, atol=1e-5) and fewer <= 0.7 * n


def test_margins_are_taken_once_for_all_products_at_a_point(small_vectors, monkeypatch):
    # every Hessian-vector product of a sample's fit computed the margins at its point anew
    pdf, d = small_vectors
    ptr = np.append(0, np.cumsum(pdf["indices"].map(len))).astype(np.int64)
    cols, vals = np.concatenate(pdf["indices"].to_list()).astype(np.int32), np.concatenate(pdf["values"].to_list())
    n, y = len(pdf), np.where(pdf["label"] == 1, 1.0, -1.0)
    block = L.Block(n, [ptr, cols, vals, np.ones((n, 1)), np.full((n, 1), L.TRAIN, np.int8), y, np.arange(n), *L._by_column(ptr, cols, vals, 1)], 1)
    per_class = L.class_weights(np.array([[(y < 0).sum(), (y > 0).sum()]]))
    problem = L.Problem("logistic", np.ones(1), np.full(1, 1 / n), per_class, None)
    calls = {"times": 0, "transposed": 0}
    for name in calls:
        real = getattr(L.Block, name)
        monkeypatch.setattr(L.Block, name, lambda *a, real=real, name=name: calls.__setitem__(name, calls[name] + 1) or real(*a))
    start = L.solve_on(block, problem, 0, d, L.LOGREG)
    g = gradient(dense(pdf, d), pdf["label"].to_numpy().astype(int), start.point, L.LOGREG)
    assert np.max(np.abs(g)) < 1e-3 and start.steep is None
    # one product a question, and one more where a rejected step's point is left
    assert calls["times"] <= calls["transposed"] + 3
