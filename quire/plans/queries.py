"""Registered queries: each ``(spark, sf_dir) -> DataFrame`` runs a library
operator over the driver's tables (via the views of ``quire.sources.fixtures``).
Parameters are fixed here and repeated verbatim in the oracle SQL."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import models as M
from ..functions.clean import minify, remove_comments, remove_empty_lines, truncate_to_tokens
from ..functions.paths import basename, ext_last, ext_name, file_priority, language_of, top_dir, type_of
from ..functions.text import format_bytes, format_money, format_number, format_size
from ..functions.tokens import estimate_tokens, line_breakdown
from ..operators import compare as C
from ..operators import optimize as O
from ..operators import pack as P
from ..operators import render as R
from ..operators import split as S
from ..operators import tree as T
from ..operators.filters import select_files
from ..operators.joins import null_safe_join
from ..session import work_path
from ..sources import fixtures as fx
from ..sources.files import scan_files
from ..sources.sinks import write_files
from ..streaming import watch as W

# Fixed query parameters (mirrored in the oracle SQL).
CUSTOM_PRIORITY = ["core", "tests", "README"]
LIMIT_FILES = 10
LIMIT_TOTAL_SIZE = 30000
TRUNCATE_TOKENS = 200
DROP_MAX_TOKENS = 10000
OPTIMIZE_TARGET = 15000
TIGHT_TARGET = 1500
CHUNK_TOKENS = 20000
FILES_PER_CHUNK = 20
OVERLAP = 2
SUGGEST_MODEL = "codestral"
DEBOUNCE_MS = 3600 * 1000
STABILITY_MS = 1800 * 1000
SIZE_CAP = 2000
PAGES_CAP = 2500
SINGLE_PATH = "src/README.js"
EXTENSIONS = ["js", "md", "py", "JSON"]
LISTED_MODELS = ["command-r", "gpt-4o", "mistral-large-3", "nope-1", "gpt-4o"]
INFO_NAMES = [m[0] for m in K.MODELS] + ["nope-1", "GPT-4O", ""]
WATCH_OUTPUT = "view_3.js"
RESOLVE_NAMES = [a for a, _ in K.MODEL_ALIASES] + [m[0] for m in K.MODELS] + ["GPT-4O", "Opus", "nope-1"]
CUSTOM_PROFILES = [("in-house-8k", 8000, 0.05, 0.10), ("gpt-4o", 128000, 2.00, 8.00)]


def _files(spark, sf):
    return fx.files_docs(spark, sf)


def _packed(spark, sf, **kw) -> P.Packed:
    return P.pack(_files(spark, sf), **kw)


def _kept_with_content(spark, sf) -> DataFrame:
    return P.annotate(select_files(_files(spark, sf)))


def q_scan_filtered_files(spark, sf):
    return _kept_with_content(spark, sf).select("corpus_id", "path", "size", F.col("len").alias("len_chars"),
                                                "priority")


def q_file_priority(spark, sf):
    return _files(spark, sf).select("corpus_id", "path", file_priority("path").alias("priority"))


def q_custom_priority_order(spark, sf):
    p = _packed(spark, sf, custom_priority=CUSTOM_PRIORITY)
    return p.files.select("corpus_id", "path", "sort_key", "pos")


def q_path_keys(spark, sf):
    return _files(spark, sf).select("corpus_id", "path", basename("path").alias("basename"),
                                    ext_name(basename("path")).alias("ext_name"), ext_last("path").alias("ext_last"),
                                    top_dir("path").alias("top_dir"))


def q_file_language_type(spark, sf):
    return _files(spark, sf).select("corpus_id", "path", language_of("path").alias("language"),
                                    type_of("path").alias("file_type"))


def q_pack_totals(spark, sf):
    return _packed(spark, sf).summary.select("corpus_id", "total_files", "total_size", "original_size",
                                             "truncated", "tokens", "large_files")


def q_count_summary(spark, sf):
    return P.count_summary(_packed(spark, sf).summary, M.models(spark), K.DEFAULT_MODEL)


def q_tokens_joined(spark, sf):
    return _packed(spark, sf).summary.select("corpus_id", "total_files", "total_chars", "tokens", "tokens_joined")


def q_limit_files(spark, sf):
    p = _packed(spark, sf, max_files=LIMIT_FILES)
    return p.files.select("corpus_id", "path", "pos")


def q_limit_total_size(spark, sf):
    p = _packed(spark, sf, max_total_size=LIMIT_TOTAL_SIZE)
    return p.files.select("corpus_id", "path", "pos", "cum_size")


def q_pack_truncation(spark, sf):
    p = _packed(spark, sf, max_files=LIMIT_FILES, max_total_size=LIMIT_TOTAL_SIZE)
    return p.summary.select("corpus_id", "total_files", "total_size", "original_size", "truncated")


def q_top_files_by_size(spark, sf):
    return P.top_files_by_size(_packed(spark, sf).files)


def q_top_files_by_tokens(spark, sf):
    p = _packed(spark, sf)
    return P.top_files_by_tokens(p.files, p.summary)


def q_line_breakdown(spark, sf):
    return _files(spark, sf).select("corpus_id", "path", line_breakdown("content").alias("b")).select("corpus_id", "path", "b.*")


def _clean_digest(spark, sf, fn):
    c = fn(F.col("content"))
    return _files(spark, sf).select("corpus_id", "path", F.length(c).cast("long").alias("out_len"), F.md5(c).alias("out_md5"))


def q_strip_comments(spark, sf):
    return _clean_digest(spark, sf, lambda c: remove_comments(c, ext_last("path")))


def q_strip_empty_lines(spark, sf):
    return _clean_digest(spark, sf, remove_empty_lines)


def q_minify(spark, sf):
    return _clean_digest(spark, sf, minify)


def q_truncate_to_tokens(spark, sf):
    return _clean_digest(spark, sf, lambda c: truncate_to_tokens(c, TRUNCATE_TOKENS))


def _phase1(spark, sf):
    return O.optimize_files(_files(spark, sf), remove_comments_=True, remove_empty_lines_=True,
                            minify_=True)


def q_optimize_file_strategies(spark, sf):
    return _phase1(spark, sf).select("corpus_id", "path", "original_size", "optimized_size",
                                     F.array_join("strategies", ",").alias("strategies"),
                                     F.md5("content").alias("content_md5"))


def q_strategies_used(spark, sf):
    o = _phase1(spark, sf).withColumn("dropped", F.lit(False))
    return O.strategies_used(o)


def q_drop_low_priority(spark, sf):
    p = _packed(spark, sf)
    return O.drop_low_priority(p.files, DROP_MAX_TOKENS, "len").select("corpus_id", "path", "drop_rank", "dropped")


def _optimized(spark, sf):
    p = _packed(spark, sf)
    files = p.with_content()
    return p, O.optimize_context(files, target_tokens=OPTIMIZE_TARGET, command=True)


def q_optimize_context(spark, sf):
    _, o = _optimized(spark, sf)
    return o.select("corpus_id", "path", "pos", "dropped", "truncated", "optimized_size",
                    F.array_join("strategies", ",").alias("strategies"), F.md5("content").alias("content_md5"))


def q_optimize_summary(spark, sf):
    p, o = _optimized(spark, sf)
    return O.optimize_summary(o, p.summary)


def _split(spark, sf, strategy, **kw):
    p = _packed(spark, sf)
    return p, S.split_context(p.files, strategy, **kw)


def q_split_by_tokens(spark, sf):
    _, s = _split(spark, sf, "by_tokens", max_tokens_per_chunk=CHUNK_TOKENS)
    return s.select("corpus_id", "path", "pos", "chunk")


def q_split_by_files(spark, sf):
    _, s = _split(spark, sf, "by_files", max_files_per_chunk=FILES_PER_CHUNK)
    return s.select("corpus_id", "path", "pos", "chunk")


def q_split_by_directory(spark, sf):
    _, s = _split(spark, sf, "by_directory")
    return s.select("corpus_id", "path", "pos", "chunk", "q")


def q_split_by_type(spark, sf):
    _, s = _split(spark, sf, "by_type")
    return s.select("corpus_id", "path", "pos", "chunk", "q")


def q_split_overlap(spark, sf):
    _, s = _split(spark, sf, "by_files", max_files_per_chunk=FILES_PER_CHUNK, overlap=True, overlap_files=OVERLAP)
    return s.select("corpus_id", "chunk", "path", "is_overlap")


def q_split_overlap_by_type(spark, sf):
    _, s = _split(spark, sf, "by_type", overlap=True, overlap_files=OVERLAP)
    return s.select("corpus_id", "chunk", "path", "is_overlap")


def q_chunk_stats(spark, sf):
    _, s = _split(spark, sf, "by_files", max_files_per_chunk=FILES_PER_CHUNK, overlap=True, overlap_files=OVERLAP)
    return S.chunk_stats(s)


def q_chunk_listing(spark, sf):
    _, s = _split(spark, sf, "by_files", max_files_per_chunk=FILES_PER_CHUNK, overlap=True, overlap_files=OVERLAP)
    return S.chunk_listing(s)


def q_split_stats(spark, sf):
    p, s = _split(spark, sf, "by_tokens", max_tokens_per_chunk=CHUNK_TOKENS)
    return S.split_stats(S.chunk_stats(s), p.summary)


def q_suggest_split(spark, sf):
    return S.suggest_split(_packed(spark, sf).summary, SUGGEST_MODEL).withColumn("strategies", F.array_join("strategies", ","))


def q_get_suggestions(spark, sf):
    return O.get_suggestions(_packed(spark, sf).summary, SUGGEST_MODEL)


def q_compare_models(spark, sf):
    return C.compare_models(_packed(spark, sf).summary, M.models(spark))


def q_fitting_models(spark, sf):
    return C.fitting_models(C.compare_models(_packed(spark, sf).summary, M.models(spark)))


def q_cost_comparison(spark, sf):
    return C.cost_comparison(_packed(spark, sf).summary, M.models(spark))


def q_recommend_model(spark, sf):
    return C.recommend_model(C.cost_comparison(_packed(spark, sf).summary, M.models(spark)))


def q_single_cost(spark, sf):
    return C.single_cost(_packed(spark, sf).summary, M.models(spark), "claude-sonnet-4-6").drop("error")


def _custom_profiles(spark):
    rows = [(n, c, i, o, K.DEFAULT_TOKENIZER, None, None, None) for n, c, i, o in CUSTOM_PROFILES]
    return spark.createDataFrame(rows, M.PROFILE_SCHEMA)


def q_profile_costs(spark, sf):
    prof = M.profiles(M.models(spark), _custom_profiles(spark))
    return C.cost_comparison(_packed(spark, sf).summary, prof)


def q_resolve_model(spark, sf):
    names = spark.createDataFrame([(n,) for n in RESOLVE_NAMES] + [(None,)], "requested string")
    resolved = M.resolve_model(names, "requested").join(M.models(spark).select("model", "context"), "model")
    x = M.with_models(_packed(spark, sf).summary.select("corpus_id", "tokens"), resolved,
                      ("requested", "model", "context"))
    return x.select("corpus_id", "requested", "model", (F.col("tokens") / F.col("context")).alias("usage"))


def q_ignore_rules_per_corpus(spark, sf):
    p = P.pack(fx.files_docs_with_rules(spark, sf))
    return p.files.select("corpus_id", "path", "pos")


def q_file_tree(spark, sf):
    return T.tree_lines(_files(spark, sf)).select("corpus_id", "path", "depth", "is_dir", "line")


def _ended(p, files, group=("corpus_id",), order="pos") -> DataFrame:
    """Files with their contents, the last of each document marked before these are joined."""
    return p.attach(R.with_ends(files.select(*{c: 1 for c in [*group, order, *P.FILE_KEY]}), group, order))


def _pack_blocks(spark, sf, fmt):
    p = _packed(spark, sf)
    return R.render_blocks(_ended(p, p.files), p.summary, fmt, tree_rows=T.tree_lines(_files(spark, sf)))


def _render_whole(spark, sf, fmt):
    """Whole documents: their lengths and MD5s, and the two-level digests of their blocks."""
    blocks = P.stored(_pack_blocks(spark, sf, fmt), "zstd")
    return null_safe_join(R.index_digests(R.block_index(blocks)), R.whole_digests(blocks), ["corpus_id"])


def q_render_markdown(spark, sf):
    return _render_whole(spark, sf, "markdown")


def q_render_xml(spark, sf):
    return _render_whole(spark, sf, "xml")


def q_render_plain(spark, sf):
    return _render_whole(spark, sf, "plain")


TEMPLATE = "<{{directory}} n={{totalFiles}} s={{totalSize}}>\n{{#files}}[{{path}}|{{language}}|{{size}}]\n{{content}}\n{{/files}}</{{directory}}>"


def q_render_template(spark, sf):
    return _render_whole(spark, sf, TEMPLATE)


def q_render_json(spark, sf):
    return _render_whole(spark, sf, "json")


def _render_pack_blocks(spark, sf, fmt):
    b = _pack_blocks(spark, sf, fmt)
    return b.select("corpus_id", "part", "seq", F.array_join("segs", "/").alias("node"),
                    F.length("block").cast("long").alias("block_len"), F.md5("block").alias("block_md5"))


def q_render_index(spark, sf):
    """Where each block of a corpus's XML document stands in it."""
    i = R.block_index(_pack_blocks(spark, sf, "xml"))
    return i.select("corpus_id", "part", "seq", F.array_join("segs", "/").alias("node"), F.col("at").alias("place"), "char_start", "char_end", "byte_start", "byte_end")


def q_render_markdown_blocks(spark, sf):
    """The markdown document of each corpus as ordered block rows (the scale
    path: no corpus or tree becomes one value)."""
    return _render_pack_blocks(spark, sf, "markdown")


def q_render_xml_blocks(spark, sf):
    return _render_pack_blocks(spark, sf, "xml")


def q_render_plain_blocks(spark, sf):
    return _render_pack_blocks(spark, sf, "plain")


def q_render_template_blocks(spark, sf):
    return _render_pack_blocks(spark, sf, TEMPLATE)


def q_render_json_blocks(spark, sf):
    return _render_pack_blocks(spark, sf, "json")


def q_render_chunks(spark, sf):
    p, s = _split(spark, sf, "by_tokens", max_tokens_per_chunk=CHUNK_TOKENS)
    files = _ended(p, s, ("corpus_id", "chunk"), "q")
    st = S.chunk_stats(s).select("corpus_id", "chunk", F.col("files").alias("total_files"),
                                 F.col("size").alias("total_size"), "tokens")
    return R.document_digests(files, st, "markdown", tree_rows=T.tree_lines(_files(spark, sf)), order="q")


def q_pack_conversations(spark, sf):
    p = P.pack(fx.files_conversations(spark, sf))
    s = S.split_context(p.files, "by_tokens", max_tokens_per_chunk=1000)
    st = S.chunk_stats(s).groupBy("corpus_id").agg(F.count(F.lit(1)).cast("long").alias("chunks"))
    return p.summary.select("corpus_id", "total_files", "total_size", "tokens").join(st, "corpus_id")


def q_pack_pages(spark, sf):
    """Totals of all pages, of any size."""
    p = P.pack(fx.files_pages(spark, sf))
    return p.summary.select("corpus_id", "total_files", "total_size", "tokens", "tokens_joined")


def q_pack_pages_capped(spark, sf):
    """The option to leave out large files: pages over ``PAGES_CAP`` bytes."""
    p = P.pack(fx.files_pages(spark, sf), max_file_size=PAGES_CAP)
    return p.summary.select("corpus_id", "total_files", "total_size", "tokens", "tokens_joined")


def q_pack_pages_whole(spark, sf):
    """Totals of all pages, of any size."""
    p = P.pack(fx.files_pages(spark, sf))
    return p.summary.select("corpus_id", "total_files", "total_size", "tokens", "tokens_joined")


def q_count_single_file(spark, sf):
    f = _files(spark, sf)
    ctx = M.model_context(K.DEFAULT_MODEL)
    t = estimate_tokens("content")
    return f.select("corpus_id", "path", "size", t.alias("tokens"), (t / F.lit(ctx) * 100).alias("usage_pct"),
                    (F.lit(ctx) - t).cast("long").alias("remaining"))


def q_watch_filter(spark, sf):
    return W.watch_filter(fx.changes_events(spark, sf), WATCH_OUTPUT).select("corpus_id", "path", "op", "ts", "seq")


def q_debounced_changes(spark, sf):
    return W.debounce_batch(fx.changes_events(spark, sf), DEBOUNCE_MS)


def q_debounced_changes_session(spark, sf):
    """The same bursts with a session window (the streaming formulation)."""
    return W.debounce(fx.changes_events(spark, sf), DEBOUNCE_MS)


def q_latest_file_state(spark, sf):
    return W.latest_state(fx.changes_events(spark, sf)).select("corpus_id", "path", "op", "ts", "seq", "size")


def q_debounced_changes_stable(spark, sf):
    """Bursts with the wait for a write to settle added to the debounce time."""
    return W.debounce_batch(fx.changes_events(spark, sf), DEBOUNCE_MS, STABILITY_MS)


def q_stream_repack(spark, sf):
    """J1 + J5: events streamed from the parquet folder, per-batch packing of
    the touched corpora, final totals read back."""
    base = work_path(spark, f"stream-{uuid.uuid4().hex}")
    stream = W.stream_changes(spark, sf, fx.table(spark, sf, "events").schema, glob="events.parquet")

    def summarize(files):
        return P.pack(files).summary.select("corpus_id", "total_files", "total_size", "tokens")
    q = W.incremental_repack(fx.changes_from_events(stream), f"{base}/state", f"{base}/out", f"{base}/ckpt", summarize)
    q.awaitTermination()
    return W.current_output(spark, f"{base}/out")


def q_pack_empty_corpora(spark, sf):
    """Totals of corpora of which some have only ignored files."""
    return P.pack(fx.files_docs_by_folder(spark, sf)).summary.select(
        "corpus_id", "total_files", "total_size", "tokens", "tokens_joined", "truncated")


def q_pack_empty_corpora_limited(spark, sf):
    return P.pack(fx.files_docs_by_folder(spark, sf), max_files=3).summary.select(
        "corpus_id", "total_files", "total_size", "original_size", "truncated")


STREAM_FILES = 4


def _event_stream(spark, sf, after):
    folder = work_path(spark, f"events-{uuid.uuid4().hex}")
    pattern = fx.events_in_order(spark, sf, folder, STREAM_FILES, after)
    stream = W.stream_changes(spark, pattern, fx.table(spark, sf, "events").schema, max_files_per_trigger=4)
    return folder, fx.changes_from_events(stream)


def q_stream_debounce(spark, sf):
    """J3 as two streaming queries over several micro-batches of events."""
    folder, changes = _event_stream(spark, sf, ["12 HOURS", "3 DAYS"])
    W.debounce_stream(changes, f"{folder}-bursts", DEBOUNCE_MS, watermark="2 hours")
    out = spark.read.parquet(f"{folder}-bursts/bursts").where("corpus_id <> '-1'")
    kind = fx.table(spark, sf, "events").schema["ts"].dataType
    return out.select("corpus_id", *[F.col(c).cast(kind).alias(c) for c in ("first_ts", "last_ts", "repack_at")], "events", "last_op", "last_path")


def q_stream_totals(spark, sf):
    """Totals kept by signed deltas over several micro-batches."""
    folder, changes = _event_stream(spark, sf, [])
    W.incremental_totals(changes, f"{folder}-totals").awaitTermination()
    W.fold_totals(spark, f"{folder}-totals")
    return W.current_totals(spark, f"{folder}-totals")


def q_snapshot_changes(spark, sf):
    """What changed between two listings of the files."""
    key = F.xxhash64("content")
    old, new = fx.files_docs_before(spark, sf).withColumn("content_key", key), _files(spark, sf).withColumn("content_key", key)
    out = W.changes_between(old, new, "2024-01-01 00:00:00")
    return out.select("corpus_id", "path", "op", "size", F.md5("content").alias("content_md5"))


def q_written_files(spark, sf):
    """The JSON document of each corpus written as a file and read back by a scan of the folder."""
    folder = work_path(spark, f"files-{uuid.uuid4().hex}")
    write_files(_pack_blocks(spark, sf, "json"), folder, "json")
    return scan_files(spark, folder).select("corpus_id", "path", "size", F.md5("content").alias("content_md5"))


def q_written_chunks(spark, sf):
    """XML documents of chunks as files, read back."""
    p, s = _split(spark, sf, "by_tokens", max_tokens_per_chunk=CHUNK_TOKENS)
    st = S.chunk_stats(s).select("corpus_id", "chunk", F.col("files").alias("total_files"), F.col("size").alias("total_size"), "tokens")
    group = ("corpus_id", "chunk")
    folder = work_path(spark, f"files-{uuid.uuid4().hex}")
    write_files(R.render_blocks(_ended(p, s, group, "q"), st, "xml", group=group, order="q"), folder, "xml", group)
    return scan_files(spark, folder).select("corpus_id", "path", "size", F.md5("content").alias("content_md5"))


def q_single_file(spark, sf):
    """A2: one named file, without any filter."""
    out = P.single_file(_files(spark, sf), SINGLE_PATH, model_table=M.models(spark))
    return out.select("corpus_id", "path", "size", "tokens", "lines.*", "context", "usage_pct", "remaining")


def q_dropped_preview(spark, sf):
    """The first files that a budget far too small drops."""
    return O.dropped_preview(O.optimize_context(_packed(spark, sf).with_content(), target_tokens=TIGHT_TARGET, command=True))


def q_max_tokens_per_file(spark, sf):
    o = O.optimize_files(_files(spark, sf), remove_comments_=False, remove_empty_lines_=False, max_tokens_per_file=TRUNCATE_TOKENS)
    return o.select("corpus_id", "path", "original_size", "optimized_size", F.array_join("strategies", ",").alias("strategies"), F.md5("content").alias("content_md5"))


def q_chunk_stats_all_overlap(spark, sf):
    """F6 with k = 0: each chunk repeats every file before it."""
    _, s = _split(spark, sf, "by_files", max_files_per_chunk=FILES_PER_CHUNK)
    return S.all_overlap_stats(s)


def q_split_stats_all_overlap(spark, sf):
    p, s = _split(spark, sf, "by_files", max_files_per_chunk=FILES_PER_CHUNK)
    return S.split_stats(S.all_overlap_stats(s), p.summary)


def q_pack_repeated_files(spark, sf):
    """Kept rows with their content, where rows repeat and corpora lack a name."""
    c = P.pack(fx.files_docs_repeated(spark, sf)).with_content()
    return c.select("corpus_id", "path", "pos", "cum_size", F.md5("content").alias("content_md5"))


def q_tree_repeated_files(spark, sf):
    return T.tree_lines(fx.files_docs_repeated(spark, sf)).select("corpus_id", "path", "depth", "is_dir", "line")


def q_filter_max_file_size(spark, sf):
    return select_files(_files(spark, sf), max_file_size=SIZE_CAP).select("corpus_id", "path", "size")


def q_filter_extensions(spark, sf):
    return select_files(_files(spark, sf), extensions=EXTENSIONS).select("corpus_id", "path", "size")


def q_filter_nul(spark, sf):
    """Every seventh document has a NUL in its text."""
    nul = F.when(F.col("doc_id") % 7 == 0, F.lit("\x00")).otherwise(F.lit(""))
    files = _files(spark, sf).withColumn("content", F.concat("content", nul))
    return select_files(files).select("corpus_id", "path", "size")


def q_ignore_rules_two_files(spark, sf):
    return P.pack(fx.files_docs_with_both_rule_files(spark, sf)).files.select("corpus_id", "path", "pos")


def q_compare_listed_models(spark, sf):
    """A list of models with equal contexts, a repeated and an unknown one."""
    return C.compare_models(_packed(spark, sf).summary, M.models(spark), LISTED_MODELS)


def q_model_info(spark, sf):
    """One requested name per document."""
    names = F.element_at(F.array(*[F.lit(n) for n in INFO_NAMES]), (F.col("doc_id") % len(INFO_NAMES) + 1).cast("int"))
    return C.model_info(fx.table(spark, sf, "documents").select("doc_id", names.alias("model")), M.models(spark))


def q_format_values(spark, sf):
    s = F.col("size")
    return _files(spark, sf).select("corpus_id", "path", format_bytes(s * 37).alias("bytes"), format_size(s * 37).alias("size_text"),
                                    format_number(s * 1001).alias("number"), format_money(s / 1024).alias("money"))


QUERIES = {name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)}
ROWS_ONLY: set[str] = set()
