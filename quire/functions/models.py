"""Model dimension: models, aliases, profiles, cost arithmetic."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as K
from .text import col

MODEL_SCHEMA = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("context", T.LongType(), False),
    T.StructField("input", T.DoubleType(), False),
    T.StructField("output", T.DoubleType(), False),
    T.StructField("tokenizer", T.StringType(), False),
    T.StructField("provider", T.StringType(), True),
    T.StructField("ord", T.IntegerType(), False),
])
ALIAS_SCHEMA = "alias string, model string"
PROFILE_SCHEMA = T.StructType(MODEL_SCHEMA.fields[:-1] + [
    T.StructField("ord", T.IntegerType(), True),
    T.StructField("created_at", T.TimestampType(), True)])

MODEL_COUNT = len(K.MODELS)


def models(spark: SparkSession) -> DataFrame:
    """The built-in model table (47 rows; ``ord`` = declaration order)."""
    rows = [(m, c, float(i), float(o), t, p, n) for n, (m, c, i, o, t, p) in enumerate(K.MODELS)]
    return spark.createDataFrame(rows, MODEL_SCHEMA)


def model_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.MODEL_ALIASES, ALIAS_SCHEMA)


def model_context(name: str):
    for m, c, *_ in K.MODELS:
        if m == name:
            return c
    return None


def resolve_model_name(name) -> str:
    """Driver-side resolution of one user-supplied name."""
    if not name:
        return K.DEFAULT_MODEL
    k = str(name).lower()
    if model_context(k) is not None:
        return k
    return dict(K.MODEL_ALIASES).get(k, K.DEFAULT_MODEL)


def resolve_model(df: DataFrame, name_col: str, spark: SparkSession = None, out: str = "model") -> DataFrame:
    """Column-wise resolution: lower-case, a model name wins, then an alias,
    else the default model; NULL resolves to the default."""
    spark = spark or df.sparkSession
    m = models(spark).select(F.col("model").alias("_m"))
    a = model_aliases(spark).select(F.col("alias").alias("_a"), F.col("model").alias("_am"))
    k = F.lower(F.col(name_col))
    return (df.withColumn("_k", k)
            .join(F.broadcast(m), F.col("_k") == F.col("_m"), "left")
            .join(F.broadcast(a), F.col("_k") == F.col("_a"), "left")
            .withColumn(out, F.coalesce("_m", "_am", F.lit(K.DEFAULT_MODEL)))
            .drop("_k", "_m", "_a", "_am"))


def profiles(builtin: DataFrame, custom: DataFrame) -> DataFrame:
    """Built-ins shadowed by custom profiles of the same name."""
    custom = custom.select(*[F.col(f.name).cast(f.dataType) if f.name in custom.columns
                             else F.lit(None).cast(f.dataType).alias(f.name) for f in PROFILE_SCHEMA.fields])
    base = builtin.withColumn("created_at", F.lit(None).cast("timestamp"))
    base = base.join(custom.select("model"), "model", "left_anti")
    # Custom profiles come after the built-ins, in order of creation and name.
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("created_at").asc_nulls_first(), "model"))
    custom = custom.withColumn("ord", (F.lit(MODEL_COUNT - 1) + place).cast("int"))
    return base.withColumn("custom", F.lit(False)).unionByName(custom.withColumn("custom", F.lit(True)))


def add_profile(custom: DataFrame, name, context, input_price=0.0, output_price=0.0,
                tokenizer=K.DEFAULT_TOKENIZER, created_at=None) -> DataFrame:
    """Upsert one custom profile into a profiles DataFrame."""
    spark = custom.sparkSession
    row = spark.createDataFrame(
        [(name, int(context), float(input_price or 0), float(output_price or 0), tokenizer, None, None,
          created_at)], PROFILE_SCHEMA).withColumn("created_at", F.coalesce("created_at", F.current_timestamp()))
    return custom.filter(F.col("model") != F.lit(name)).unionByName(row)


def remove_profile(custom: DataFrame, name) -> DataFrame:
    """Remove a custom profile; built-in names cannot be removed."""
    if model_context(name) is not None:
        raise ValueError(f"Cannot remove built-in profile '{name}'")
    return custom.filter(F.col("model") != F.lit(name))


MODEL_COLUMNS = ("model", "context", "input", "output", "ord")


def with_models(df: DataFrame, model_table: DataFrame, columns=MODEL_COLUMNS) -> DataFrame:
    """Each row once per model (columns of the model table appended).  The
    model table is configuration: a scalar subquery gathers it into one array
    value, so the expansion is an ``explode``, not a join."""
    table = model_table.agg(F.collect_list(F.struct(*columns)).alias("m")).scalar()
    return df.withColumn("_ms", table).select(*df.columns, F.explode("_ms").alias("_m")).select(
        *df.columns, *[F.col("_m")[c].alias(c) for c in columns])


def cost_columns(input_tokens, output_tokens, context, input_price, output_price) -> dict:
    """Cost arithmetic in the same double operation order everywhere."""
    it, ot = col(input_tokens), col(output_tokens)
    ic = (it / F.lit(1000000.0)) * col(input_price)
    oc = (ot / F.lit(1000000.0)) * col(output_price)
    return {"input_cost": ic, "output_cost": oc, "total_cost": ic + oc,
            "context_usage": it / col(context), "context_remaining": (col(context) - it).cast("long")}


def example_costs(model_table: DataFrame) -> DataFrame:
    """Price of 1K/10K/50K/100K tokens each way, for counts within context."""
    ex = F.array(*[F.struct(F.lit(t).cast("long").alias("tokens"), F.lit(l).alias("label"))
                   for t, l in K.EXAMPLE_TOKEN_COUNTS])
    out = (model_table.withColumn("_e", F.explode(ex)).select("*", "_e.tokens", "_e.label").drop("_e")
           .where(F.col("tokens") <= F.col("context")))
    ic = (F.col("tokens") / F.lit(1000000.0)) * F.col("input")
    oc = (F.col("tokens") / F.lit(1000000.0)) * F.col("output")
    return out.select("model", "tokens", "label", ic.alias("input_cost"), oc.alias("output_cost"),
                      (ic + oc).alias("total_cost"))
