"""Command-level plans: each reference command as a function that applies that
command's defaults and returns its reports as named DataFrames.  Rendering
and writing are separate steps (``quire.sources.sinks``)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import models as M
from ..operators import compare as C
from ..operators import optimize as O
from ..operators import pack as P
from ..operators import render as R
from ..operators import split as S
from ..operators import tree as T


def _split_list(v) -> list | None:
    if v is None:
        return None
    return [x for x in (v.split(",") if isinstance(v, str) else v)]


def pack_command(files: DataFrame, *, fmt: str = "markdown", model: str = K.DEFAULT_MODEL, ext=None, ignore=None,
                 max_file_size_kb: int | None = None, tree: bool = True, stats: bool = False, tokenizer=None) -> dict:
    """Pack: tokens summed per file.  Files of any size are taken unless
    ``max_file_size_kb`` caps them (the command line's own cap is
    ``K.PACK_COMMAND_MAX_FILE_SIZE``).  ``blocks`` has the documents as ordered
    rows, for corpora of any size; ``documents`` as one string each."""
    p = P.pack(files, extensions=_split_list(ext), ignore=_split_list(ignore) or [], tokenizer=tokenizer,
               max_file_size=int(max_file_size_kb) * 1024 if max_file_size_kb else None)
    lines = T.tree_lines(files, list(K.DEFAULT_IGNORE) + (_split_list(ignore) or [])) if tree else None
    docs = R.render_documents(p.with_content().withColumn("chunk", F.lit(1).cast("long")),
                              p.summary.withColumn("chunk", F.lit(1).cast("long")), fmt,
                              tree=T.tree_text(lines) if tree else None, include_tree=tree, order="pos")
    blocks = R.render_blocks(p.with_content(), p.summary, fmt, tree_rows=lines, include_tree=tree)
    out = {"summary": p.summary, "blocks": blocks, "documents": docs, "files": p.files}
    if stats:
        out["top_files"] = P.top_files_by_size(p.files)
    return out


def count_command(files: DataFrame, *, model: str = K.DEFAULT_MODEL, ext=None, ignore=None,
                  breakdown: bool = False) -> dict:
    spark = files.sparkSession
    p = P.pack(files, extensions=_split_list(ext), ignore=_split_list(ignore) or [])
    out = {"summary": P.count_summary(p.summary, M.models(spark), model)}
    if breakdown:
        out["top_files"] = P.top_files_by_tokens(p.files, p.summary)
    return out


def compare_command(files: DataFrame, *, models=None, ext=None, ignore=None) -> dict:
    spark = files.sparkSession
    p = P.pack(files, extensions=_split_list(ext), ignore=_split_list(ignore) or [])
    cmp = C.compare_models(p.summary, M.models(spark), _split_list(models))
    return {"comparison": cmp, "fitting": C.fitting_models(cmp), "summary": p.summary}


def cost_command(files: DataFrame, *, model: str | None = None, output: int = K.DEFAULT_OUTPUT_TOKENS,
                 compare: bool = False, ext=None, ignore=None, model_table: DataFrame | None = None) -> dict:
    spark = files.sparkSession
    table = model_table if model_table is not None else M.models(spark)
    p = P.pack(files, extensions=_split_list(ext), ignore=_split_list(ignore) or [])
    if compare or not model:
        costs = C.cost_comparison(p.summary, table, int(output))
        return {"costs": costs, "recommendation": C.recommend_model(costs)}
    return {"cost": C.single_cost(p.summary, table, model, int(output))}


def optimize_command(files: DataFrame, *, tokens: int | None = None, model: str = K.DEFAULT_MODEL,
                     keep_comments: bool = False, keep_empty: bool = False, minify: bool = False,
                     fmt: str | None = None, ext=None, ignore=None, tree: bool = True) -> dict:
    target = int(tokens) if tokens else O.target_tokens_for(model, None, command=True)
    if not target:
        raise ValueError("Please specify tokens or use a known model")
    p = P.pack(files, extensions=_split_list(ext), ignore=_split_list(ignore) or [])
    opt = O.optimize_context(p.with_content(), target_tokens=target, model=model,
                             remove_comments_=not keep_comments, remove_empty_lines_=not keep_empty,
                             minify_=bool(minify), command=True)
    out = {"files": opt, "summary": O.optimize_summary(opt, p.summary), "dropped": O.dropped_preview(opt),
           "strategies": O.strategies_used(opt)}
    if fmt:
        kept = opt.where(~F.col("dropped")).withColumn("chunk", F.lit(1).cast("long"))
        stats = out["summary"].select("corpus_id", F.col("files").alias("total_files"), "total_size",
                                      F.col("final_tokens").alias("tokens")).withColumn("chunk", F.lit(1).cast("long"))
        lines = T.tree_lines(files, list(K.DEFAULT_IGNORE) + (_split_list(ignore) or [])) if tree else None
        out["blocks"] = R.render_blocks(kept, stats, fmt, tree_rows=lines, include_tree=tree)
        out["documents"] = R.render_documents(kept, stats, fmt, tree=T.tree_text(lines) if tree else None, include_tree=tree, order="pos")
    return out


def split_command(files: DataFrame, *, strategy: str = "by_tokens", model: str = K.DEFAULT_MODEL,
                  max_tokens: int | None = None, max_files: int | None = None, overlap: bool = False,
                  overlap_files: int = K.DEFAULT_OVERLAP_FILES, suggest: bool = False, fmt: str | None = None,
                  ext=None, ignore=None) -> dict:
    p = P.pack(files, extensions=_split_list(ext), ignore=_split_list(ignore) or [])
    if suggest:
        return {"suggestion": S.suggest_split(p.summary, model)}
    chunks = S.split_context(p.files, strategy, model=model, max_tokens_per_chunk=max_tokens,
                             max_files_per_chunk=max_files, overlap=overlap, overlap_files=overlap_files)
    stats = S.chunk_stats(chunks)
    out = {"chunks": chunks, "chunk_stats": stats, "split_stats": S.split_stats(stats, p.summary),
           "listing": S.chunk_listing(chunks)}
    if fmt:
        with_content = p.attach(chunks)
        st = stats.select("corpus_id", "chunk", F.col("files").alias("total_files"), F.col("size").alias("total_size"),
                          "tokens")
        lines = T.tree_lines(files, list(K.DEFAULT_IGNORE) + (_split_list(ignore) or []))
        out["blocks"] = R.render_blocks(with_content, st, fmt, tree_rows=lines, group=("corpus_id", "chunk"), order="q")
        out["documents"] = R.render_documents(with_content, st, fmt, tree=T.tree_text(lines), order="q")
    return out


def profile_command(spark: SparkSession, custom: DataFrame | None = None, action: str = "list",
                    name: str | None = None, context: int | None = None, input_price: float = 0.0,
                    output_price: float = 0.0, tokenizer: str = K.DEFAULT_TOKENIZER) -> dict:
    """list / add / remove / show over a custom-profiles DataFrame."""
    custom = custom if custom is not None else spark.createDataFrame([], M.PROFILE_SCHEMA)
    builtin = M.models(spark)
    if action in ("list", "ls", None):
        return {"profiles": M.profiles(builtin, custom)}
    if action in ("add", "create"):
        if not name or not context:
            raise ValueError("name and context are required")
        return {"custom": M.add_profile(custom, name, context, input_price, output_price, tokenizer)}
    if action in ("remove", "rm", "delete"):
        if custom.where(F.col("model") == F.lit(name)).limit(1).count() == 0:
            raise ValueError(f"Profile '{name}' not found")
        return {"custom": M.remove_profile(custom, name)}
    if action == "show":
        prof = M.profiles(builtin, custom).where(F.col("model") == F.lit(name))
        return {"profile": prof, "example_costs": M.example_costs(prof)}
    raise ValueError(f"Unknown action: {action}")
