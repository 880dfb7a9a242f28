"""Reply parsing (FIXTURES 3.3), prompt templates and logit scoring."""

import pytest

from claimlens.functions import prompts as P
from claimlens.functions import scoring as SC

REPLIES = [("NO_MANI", 0), ("No mani.", 0), ("MANI", 1), ("not manipulated", 1), ("no manipulation", 0),
           ("yes", 1), ("genuine", 0), ("", 0), ("Romania", 1), ("eyes", 1), ("cannot tell", 0), (None, 0)]


def test_parse_reply(spark):
    df = spark.createDataFrame(REPLIES, "r string, want int")
    for r in df.select("want", P.parse_reply_label("r").alias("got")).collect():
        assert r["got"] == r["want"]


def test_zero_shot_prompt(spark):
    df = spark.createDataFrame([("c1", "a" * 700)], "mani_news string, original_news_article string")
    p = df.select(P.zero_shot_prompt()).first()[0]
    assert p.startswith(P.PROMPT_HEAD + "Claim: c1\n\nArticle: ")
    assert ("a" * 600 + "\n\nHas the claim") in p and "a" * 601 not in p
    nul = spark.createDataFrame([(None, None)], "mani_news string, original_news_article string")
    assert "Claim: nan\n\nArticle: nan" in nul.select(P.zero_shot_prompt()).first()[0]


def test_few_shot_prompt(spark):
    ex = spark.createDataFrame([(2, "c2", "b" * 400, "NO_MANI"), (1, "c1", "x", "MANI")],
                               "position int, claim string, article string, status string")
    df = spark.createDataFrame([("q", "art")], "mani_news string, original_news_article string")
    p = df.select(P.few_shot_prompt(P.examples_text(ex))).first()[0]
    want = (P.PROMPT_HEAD + "Example 1:\nClaim: c1\nArticle: x\nAnswer: MANI\n\n"
            + "Example 2:\nClaim: c2\nArticle: " + "b" * 300 + "\nAnswer: NO_MANI\n\n"
            + "Now analyze this:\nClaim: q\nArticle: art\n\nAnswer with only: MANI or NO_MANI")
    assert p == want


def test_score_logits(spark):
    import math
    df = spark.createDataFrame([([0.0, 1.0],), ([2.0, 2.0],), ([1000.0, -1000.0],)], "logits array<double>")
    r = SC.score_logits(df).collect()
    p1 = math.exp(1) / (1 + math.exp(1))
    assert r[0]["prediction"] == "MANI" and r[0]["prob_mani"] == round(p1, 4)
    assert r[1]["prediction"] == "NO_MANI" and r[1]["confidence"] == 0.5
    assert r[2]["prob_no_mani"] == 1.0


def test_drop_metric_keys(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "eval_f1 double, eval_runtime double, train_runtime double")
    assert SC.drop_metric_keys(df).columns == ["eval_f1"]


def test_score_prompts_with_factory(spark):
    from claimlens.plans import prompt_eval as PE

    def factory():
        return lambda ps: ["MANI" if len(p) % 2 else "NO_MANI" for p in ps]

    df = spark.createDataFrame([("ab",), ("abc",)], "prompt string")
    got = [r["response"] for r in PE.score_prompts(df, model_factory=factory, model_name="length").orderBy("prompt").collect()]
    assert got == ["NO_MANI", "MANI"]
    with pytest.raises(ValueError):
        PE.score_prompts(df)
    with pytest.raises(ValueError):
        PE.score_prompts(df, model_factory=factory)


def test_factory_runs_once_a_worker(spark, tmp_path):
    import os
    import uuid
    from claimlens.plans import prompt_eval as PE
    log = str(tmp_path / "calls")

    def factory():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda ps: [str(os.getpid())] * len(ps)

    df = spark.range(64).repartition(32).selectExpr("CAST(id AS STRING) AS prompt")
    workers = {r["response"] for r in PE.score_prompts(df, model_factory=factory, model_name=uuid.uuid4().hex).collect()}
    calls = open(log).read().split()
    assert len(calls) == len(set(calls)) == len(workers) < 32


def test_strategy_names():
    from claimlens.plans import prompt_eval as PE
    assert [PE.shots(s) for s in ("zero_shot", "few_shot_3", "few_shot_5")] == [0, 3, 5]
    for bad in ("few_shot", "few_shot_0", "cot"):
        with pytest.raises(ValueError):
            PE.shots(bad)


def test_few_shot_moves_no_texts(spark):
    from claimlens.operators import splits as X
    from claimlens.sources import tables as S
    from tests.conftest import SF_SMALL
    c = S.claims(spark, SF_SMALL).filter("data_type = 'TRAIN'")
    sample = X.few_shot_sample(c, k=5)
    plan = sample._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window "):]
    assert "mani_news" not in window.split("BroadcastExchange")[0] or "TakeOrderedAndProject" in plan
    assert "TakeOrderedAndProject" in plan and sample.count() == 5


def test_ledger_resumes_and_asks_once_a_prompt(spark, tmp_path):
    from claimlens.plans import prompt_eval as PE
    calls, fail, at = str(tmp_path / "calls"), str(tmp_path / "fail"), str(tmp_path / "ledger")

    def make():
        import os

        def fn(prompts):
            if os.path.exists(fail) and os.path.exists(calls) and len(open(calls).read().split()) >= 10:
                raise RuntimeError("model lost")
            with open(calls, "a") as f:
                f.write("".join(f"{p}\n" for p in prompts))
            return [f"reply to {p}" for p in prompts]
        return fn

    rows = [(i, f"p{i % 20}") for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, prompt string")
    open(fail, "w").close()
    with pytest.raises(Exception, match="model lost"):
        PE.score_with_ledger(df, at, "m", make, batch_size=2, commit_prompts=3).count()
    kept = {r["response"].removeprefix("reply to ") for r in PE.read_ledger(spark, at).collect()}
    assert 0 < len(kept) < 20
    (tmp_path / "fail").rename(tmp_path / "mended")
    before = len(open(calls).read().split())
    got = PE.score_with_ledger(df, at, "m", make, batch_size=2, commit_prompts=3).collect()
    assert sorted((r["id"], r["response"]) for r in got) == sorted((i, p and f"reply to {p}") for i, p in rows)
    assert set(open(calls).read().split()[before:]) == {f"p{i}" for i in range(20)} - kept
    assert len(open(calls).read().split()[before:]) == 20 - len(kept)
    done = len(open(calls).read().split())
    assert PE.score_with_ledger(df, at, "m", make).count() == len(rows) and len(open(calls).read().split()) == done
    # another model's replies are its own
    other = PE.score_with_ledger(df, at, "n", lambda: lambda ps: ["x"] * len(ps)).filter("prompt IS NOT NULL")
    assert {r["response"] for r in other.collect()} == {"x"}
