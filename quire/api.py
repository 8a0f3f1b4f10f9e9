"""The reference library's entry points, by name, over DataFrames.

Each takes a ``files`` DataFrame (``corpus_id, path, content, size``) or the
result of an earlier step; all return DataFrames (one row per corpus, file or
chunk).  Ordering, next-fit splitting and optimizing run jobs while they build their
result; everything else is computed when an action runs.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import constants as K
from .functions import models as _models
from .functions.tokens import count_tokens, estimate_tokens  # noqa: F401  (re-exported)
from .operators import compare as _compare
from .operators import optimize as _optimize
from .operators import pack as _pack
from .operators import render as _render
from .operators import split as _split
from .operators import tree as _tree
from .operators.filters import select_files

FORMATS = {"MARKDOWN": "markdown", "XML": "xml", "PLAIN": "plain", "JSON": "json"}
DEFAULT_MODEL = K.DEFAULT_MODEL


def pack(files: DataFrame, **options) -> _pack.Packed:
    """Select, order and limit files per corpus (``.files``, ``.summary``)."""
    return _pack.pack(files, **options)


pack_directory = pack


def collect_files(files: DataFrame, **options) -> DataFrame:
    return select_files(files, **options)


def get_file_tree(files: DataFrame, ignore=()) -> DataFrame:
    """``(corpus_id, tree)`` text; use ``quire.operators.tree.tree_lines`` for rows."""
    return _tree.tree_text(_tree.tree_lines(files, list(K.DEFAULT_IGNORE) + list(ignore)))


def count_files_tokens(files: DataFrame, tokenizer=None) -> DataFrame:
    """Per-file ``tokens`` and ``size`` (bytes, else characters)."""
    t = estimate_tokens("content") if tokenizer is None else count_tokens("content", tokenizer)["tokens"]
    sz = F.when(F.coalesce(F.col("size"), F.lit(0)) != 0, F.col("size")).otherwise(F.length("content"))
    return files.select("corpus_id", "path", t.alias("tokens"), sz.cast("long").alias("size"))


def count(files, tokenizer=None):
    """Tokens of what is given: of a text their number, of a column of texts a
    column, of ``files`` per-corpus ``total_tokens`` (sum over files) and the
    per-file rows' count.  ``tokenizer`` (a function of a column) counts exactly."""
    if isinstance(files, str):
        if tokenizer is not None:
            raise ValueError("a single text is estimated; give a tokenizer a column")
        return -(-len(files) // 4)
    if isinstance(files, Column):
        return estimate_tokens(files) if tokenizer is None else count_tokens(files, tokenizer)["tokens"]
    return count_files_tokens(files, tokenizer).groupBy("corpus_id").agg(
        F.sum("tokens").cast("long").alias("total_tokens"), F.count(F.lit(1)).alias("files"))


def list_models(spark: SparkSession) -> DataFrame:
    return _models.models(spark)


def get_model_info(spark: SparkSession, names) -> DataFrame:
    df = spark.createDataFrame([(n,) for n in names], "model string")
    return _compare.model_info(df, _models.models(spark))


def calculate_cost(summary: DataFrame, model: str = K.DEFAULT_MODEL, output_tokens: int = 0) -> DataFrame:
    """Cost of each corpus's ``tokens`` on one model (``error`` if unknown)."""
    return _compare.single_cost(summary, _models.models(summary.sparkSession), model, output_tokens)


cost = calculate_cost


def optimize(packed: _pack.Packed, **options) -> DataFrame:
    """Shrink to a token budget.  Cleaning flags that the caller passes hold
    for the second pass over low-priority files as well."""
    flags = {k: v for k, v in options.items() if k in ("remove_comments_", "remove_empty_lines_", "minify_")}
    options.setdefault("reclean", flags or None)
    return _optimize.optimize_context(packed.with_content(), **options)


optimize_context = optimize


def get_suggestions(packed: _pack.Packed, model: str = K.DEFAULT_MODEL) -> DataFrame:
    return _optimize.get_suggestions(packed.summary, model)


def split(packed: _pack.Packed, strategy: str = "by_tokens", **options) -> DataFrame:
    return _split.split_context(packed.files, strategy, **options)


split_context = split


def suggest_split(packed: _pack.Packed, model: str = K.DEFAULT_MODEL) -> DataFrame:
    return _split.suggest_split(packed.summary, model)


def format(packed: _pack.Packed, fmt: str = "markdown", *, include_tree: bool = True, **options) -> DataFrame:
    """One document per corpus: ``(corpus_id, chunk, document)``."""
    files = packed.with_content().withColumn("chunk", F.lit(1).cast("long"))
    stats = packed.summary.withColumn("chunk", F.lit(1).cast("long"))
    tree = None
    if include_tree:                     # the tree shows what the pack's own ignore list and rules leave
        tree = _tree.tree_text(_tree.tree_lines(packed.source, list(K.DEFAULT_IGNORE) + packed.ignore, packed.rules,
                                                packed.use_rule_files))
    return _render.render_documents(files, stats, fmt, tree=tree, include_tree=include_tree, order="pos", **options)


def format_blocks(packed: _pack.Packed, fmt: str = "markdown", *, include_tree: bool = True, **options) -> DataFrame:
    """The same documents as ordered rows (``corpus_id, part, segs, seq, block``),
    for corpora of any size; ``quire.sources.sinks.write_files`` writes them."""
    tree = packed.tree if include_tree else None
    return _render.render_blocks(packed.with_content(), packed.summary, fmt, tree_rows=tree, include_tree=include_tree, **options)


def format_markdown(packed, **o):
    return format(packed, "markdown", **o)


def format_xml(packed, **o):
    return format(packed, "xml", **o)


def format_plain(packed, **o):
    return format(packed, "plain", **o)


def format_json(packed, **o):
    return format(packed, "json", **o)
