"""Prompt evaluation: every test row x every prompt strategy -> reply -> label -> metrics.

The model is user-supplied: a callable taking a list of prompts and
returning a list of replies.  It runs inside an Arrow-batched pandas UDF, so
prompts travel to Python workers in batches and each executor can hold its
own model instance; Spark decides the parallelism.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from claimlens.functions import prompts as P
from claimlens.operators import metrics as M
from claimlens.operators import reports as R
from claimlens.operators import windows as WN
from claimlens.session import materialize

ModelFn = Callable[[list[str]], list[str]]


def score_prompts(df: DataFrame, model_fn: ModelFn | None = None, prompt_col: str = "prompt",
                  out_col: str = "response", model_factory: Callable[[], ModelFn] | None = None,
                  model_name: str | None = None) -> DataFrame:
    """Adds the model's reply to every prompt (greedy decoding is the model's business).

    ``model_fn`` is shipped with the task; for a heavy model pass ``model_factory`` and a
    ``model_name`` instead: the factory is called once per Python worker process (weights
    loaded once, kept under that name and reused by every later task on that worker)."""
    if (model_fn is None) == (model_factory is None):
        raise ValueError("give exactly one of model_fn or model_factory")
    if model_factory is not None and not model_name:
        raise ValueError("a model_factory needs a model_name that stands for what it builds")

    @pandas_udf("string")
    def _reply(prompts: pd.Series) -> pd.Series:
        fn = model_fn
        if fn is None:
            from claimlens.functions.worker_models import worker_model
            fn = worker_model(model_name, model_factory)
        return pd.Series(fn(prompts.tolist()), index=prompts.index, dtype="object")
    return df.withColumn(out_col, _reply(F.col(prompt_col)))


#: The ledger's schema; ``key`` is the SHA-256 of model and prompt.
LEDGER = "key string, model string, response string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(key, model, response): one reply a model and prompt; a missing ledger is empty."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    # the finished portions by name: two reads at different times are then different scans to the planner
    names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
    done = [f"{path}/{n}" for n in names if n.startswith("portion-")
            and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    if not done:
        return spark.createDataFrame([], LEDGER)
    # two writers may have scored the same prompt: either reply stands, but always the same one
    return spark.read.schema(LEDGER).parquet(*done).groupBy("key").agg(F.min("model").alias("model"), F.min("response").alias("response"))


def score_with_ledger(df: DataFrame, path: str, model_name: str, make_model: Callable[[], ModelFn], prompt_col: str = "prompt",
                      out_col: str = "response", batch_size: int = 64, commit_prompts: int = 10_000) -> DataFrame:
    """M12, resumable: ``df`` + the model's reply, by a ledger of the replies at ``path``.

    Only prompts without a reply under this model's name are scored, each different one once, in
    batches of like length (``make_model`` is called once a Python worker).  Replies are appended in
    portions of about ``commit_prompts``, so a failure loses the portion at work and a second call goes on from
    there.  A null prompt has a null reply."""
    from pyspark.ml.functions import predict_batch_udf

    def make_predict():
        import numpy as np
        fn = make_model()
        return lambda prompts: np.array(fn([str(p) for p in prompts]), dtype=object)

    spark = df.sparkSession
    reply = predict_batch_udf(make_predict, return_type=StringType(), batch_size=batch_size)
    key = F.sha2(F.concat(F.lit(model_name), F.lit("\0"), F.col(prompt_col)), 256)
    keyed = df.withColumn("_key", key)
    prompts = keyed.filter("_key IS NOT NULL").groupBy("_key").agg(F.first(prompt_col).alias("_prompt"))
    unseen = materialize(prompts.join(read_ledger(spark, path).select("key"), F.col("_key") == F.col("key"), "left_anti"), "unseen-prompts")
    portions = -(-unseen.count() // commit_prompts)
    for i in range(portions):
        mine = unseen.filter(F.pmod(F.xxhash64("_key"), F.lit(portions)) == i)
        batches = mine.repartition("_key").sortWithinPartitions(F.length("_prompt"))
        batches.select(F.col("_key").alias("key"), F.lit(model_name).alias("model"), reply("_prompt").alias("response")) \
            .write.mode("errorifexists").parquet(f"{path}/portion-{uuid.uuid4().hex}")  # writers at the same time need folders of their own
    replies = read_ledger(spark, path).select(F.col("key").alias("_k"), F.col("response").alias(out_col))
    return keyed.join(replies, F.col("_key") == F.col("_k"), "left").select(*df.columns, out_col)


def shots(strategy: str) -> int:
    """k of ``few_shot_k``, 0 of ``zero_shot``."""
    if strategy == "zero_shot":
        return 0
    k = strategy.removeprefix("few_shot_")
    if k == strategy or not k.isdigit() or int(k) < 1:
        raise ValueError(f"Unknown strategy: {strategy}")
    return int(k)


def prompts_by_strategy(test: DataFrame, train: DataFrame | None,
                        strategies: Sequence[str] = P.STRATEGIES, seed: int = 42) -> DataFrame:
    """(row_id, label, strategy, prompt): the test rows once per strategy (a
    union of projections, not a join).  ``few_shot_k`` shows k sampled training rows."""
    parts = []
    for s in strategies:
        k = shots(s)
        if k and train is None:
            raise ValueError("few-shot strategies need training rows")
        prompt = P.few_shot_prompt(P.examples_text(P.few_shot_examples(train, k, seed))) if k else P.zero_shot_prompt()
        parts.append(test.select("row_id", "label", F.lit(s).alias("strategy"), prompt.alias("prompt")))
    return R.union_all(parts)


def evaluate_prompts(test: DataFrame, train: DataFrame | None, models: Mapping[str, ModelFn],
                     strategies: Sequence[str] = P.STRATEGIES, seed: int = 42, ledger: str | None = None) -> DataFrame:
    """(row_id, label, model, strategy, response, prediction) for every test row, model and strategy.

    With ``ledger``, a path, replies are kept there and only missing ones are asked for."""
    pr = prompts_by_strategy(test, train, strategies, seed)
    rep = R.union_all([(score_prompts(pr, fn) if ledger is None else score_with_ledger(pr, ledger, name, lambda fn=fn: fn))
                       .withColumn("model", F.lit(name)) for name, fn in models.items()])
    return rep.select("row_id", "label", "model", "strategy", "response",
                      P.parse_reply_label("response").alias("prediction"))


def strategy_metrics(replies: DataFrame) -> DataFrame:
    """A11 per model and strategy (no probabilities, so no AUC)."""
    return M.evaluate(replies, by=["model", "strategy"]).drop("roc_auc")


def running_strategy_f1(replies: DataFrame, every: int = 10) -> DataFrame:
    """F1-macro so far after every ``every``-th reply, per model and strategy (row order)."""
    return WN.running_f1(replies, order_col="row_id", by=["model", "strategy"], every=every)
