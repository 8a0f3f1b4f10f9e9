"""Corpora against the model table.

Token totals are computed once per corpus, then each corpus row is expanded
once per model.  The model table (built-ins plus custom profiles) becomes one
array, read by a scalar subquery, and the expansion is an ``explode`` in a
projection: no join, no exchange, nothing collected while planning.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.models import cost_columns, with_models
from .joins import null_safe_join


def _models(model_table: DataFrame, names: Sequence[str] | None) -> DataFrame:
    if not names:
        return model_table
    return known_models(names, model_table)


def known_models(names: Sequence[str], model_table: DataFrame) -> DataFrame:
    """The user list restricted to known models.  ``ord`` becomes the place
    in the list, which is kept with its duplicates."""
    req = model_table.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "model string, _place int")
    return model_table.join(req, "model").withColumn("ord", F.col("_place")).drop("_place")


def compare_models(summary: DataFrame, model_table: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Per corpus and model, usage = tokens / context, ranked ascending
    (ties by declaration order, or by the place in ``names``)."""
    x = with_models(summary.select("corpus_id", "tokens"), _models(model_table, names), ("model", "context", "ord"))
    usage = F.col("tokens") / F.col("context")
    x = x.withColumn("usage", usage).withColumn("fits", usage <= 1) \
         .withColumn("remaining", (F.col("context") - F.col("tokens")).cast("long"))
    w = Window.partitionBy("corpus_id").orderBy("usage", "ord")
    return x.withColumn("rank", F.row_number().over(w)).select(
        "corpus_id", "rank", "model", "tokens", "context", "usage", "fits", "remaining")


def fitting_models(compared: DataFrame, n_fit: int = 5, n_over: int = 3) -> DataFrame:
    """First ``n_fit`` fitting models (with tokens remaining) and first
    ``n_over`` exceeding ones (with tokens over), by usage."""
    w = Window.partitionBy("corpus_id", "fits").orderBy("rank")
    x = compared.withColumn("group_rank", F.row_number().over(w))
    x = x.where((F.col("fits") & (F.col("group_rank") <= n_fit)) | (~F.col("fits") & (F.col("group_rank") <= n_over)))
    cnt = compared.groupBy("corpus_id").agg(F.count_if("fits").cast("long").alias("n_fitting"),
                                            F.count_if(~F.col("fits")).cast("long").alias("n_exceeding"))
    return null_safe_join(x, cnt, ["corpus_id"]).select(
        "corpus_id", "fits", "group_rank", "model",
        F.when(F.col("fits"), F.col("remaining")).otherwise(-F.col("remaining")).cast("long").alias("tokens_margin"),
        "n_fitting", "n_exceeding")


def cost_comparison(summary: DataFrame, model_table: DataFrame, output_tokens: int = K.DEFAULT_OUTPUT_TOKENS,
                    names: Sequence[str] | None = None) -> DataFrame:
    """Cost of each corpus on each model, ranked by total cost."""
    x = with_models(summary.select("corpus_id", F.col("tokens").alias("input_tokens")), _models(model_table, names))
    x = x.withColumn("output_tokens", F.lit(int(output_tokens)).cast("long"))
    c = cost_columns("input_tokens", "output_tokens", "context", "input", "output")
    x = x.select("corpus_id", "model", "ord", "input_tokens", "output_tokens",
                 c["input_cost"].alias("input_cost"), c["output_cost"].alias("output_cost"),
                 c["total_cost"].alias("total_cost"), c["context_usage"].alias("context_usage"),
                 c["context_remaining"].alias("context_remaining"))
    x = x.withColumn("fits", F.col("context_usage") <= 1)
    w = Window.partitionBy("corpus_id").orderBy("total_cost", "ord")
    return x.withColumn("rank", F.row_number().over(w)).drop("ord")


def single_cost(summary: DataFrame, model_table: DataFrame, model: str,
                output_tokens: int = K.DEFAULT_OUTPUT_TOKENS) -> DataFrame:
    """C16 for one model; an unknown model gives NULL costs and an ``error``."""
    m = model_table.where(F.col("model") == F.lit(model)).select("context", "input", "output").limit(1).collect()
    ctx, pin, pout = (m[0]["context"], m[0]["input"], m[0]["output"]) if m else (None, None, None)
    x = summary.select("corpus_id", F.col("tokens").alias("input_tokens"), F.lit(ctx).cast("long").alias("context"),
                       F.lit(pin).cast("double").alias("input"), F.lit(pout).cast("double").alias("output"))
    x = x.withColumn("output_tokens", F.lit(int(output_tokens)).cast("long"))
    c = cost_columns("input_tokens", "output_tokens", "context", "input", "output")
    return x.select("corpus_id", F.lit(model).alias("model"), "input_tokens", "output_tokens",
                    *[v.alias(k) for k, v in c.items()],
                    F.when(F.col("context").isNull(), F.lit(f"Unknown model: {model}")).alias("error"))


def recommend_model(costs: DataFrame) -> DataFrame:
    """The cheapest model that fits (``best_*``) and the cheapest overall."""
    key = F.struct("rank")
    return costs.groupBy("corpus_id").agg(
        F.min_by("model", F.when(F.col("fits"), key)).alias("best_model"),
        F.min_by("total_cost", F.when(F.col("fits"), key)).alias("best_cost"),
        F.min_by("model", key).alias("cheapest_model"),
        F.min_by("total_cost", key).alias("cheapest_cost"),
        F.max(F.col("fits")).alias("any_fits"))


def model_info(names: DataFrame, model_table: DataFrame, name_col: str = "model") -> DataFrame:
    """C17: known flag, context, prices and tokenizer for each requested name."""
    m = model_table.select(F.col("model").alias("_m"), "context", "input", "output", "tokenizer")
    return (names.join(m, F.col(name_col) == F.col("_m"), "left").drop("_m")
            .withColumn("known", F.col("context").isNotNull()))
