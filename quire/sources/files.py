"""The ``files`` relation and its sources (A1-A4).

``files(corpus_id, path, content, size)``: one row per text file, ``path``
relative to its corpus root, ``size`` in bytes.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.text import WS

FILES_SCHEMA = T.StructType([
    T.StructField("corpus_id", T.StringType(), True),
    T.StructField("path", T.StringType(), False),
    T.StructField("content", T.StringType(), True),
    T.StructField("size", T.LongType(), True),
])
RULES_SCHEMA = "corpus_id string, pattern string"


def from_table(df: DataFrame, corpus_id="corpus_id", path="path", content="content",
               size=None) -> DataFrame:
    """Any table as ``files``; ``size`` defaults to the UTF-8 byte length."""
    c = F.col(content).cast("string")
    sz = F.col(size).cast("long") if size else F.octet_length(c).cast("long")
    return df.select(F.col(corpus_id).cast("string").alias("corpus_id"),
                     F.col(path).cast("string").alias("path"), c.alias("content"), sz.alias("size"))


def _filesystem(uri: str):
    """Filesystem and path of a URI (local paths too)."""
    from pyarrow import fs as pafs
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        return pafs.LocalFileSystem(), uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length, changed)`` of every file under ``root``, relative to it, names
    that begin with a dot or an underscore included.

    Spark's own listing leaves those out, so folders are listed here, level by
    level: the folders of a level are spread over tasks, each lists its own
    (one folder's entries at a time), and the next level is what they found.
    Levels are written to the checkpoint folder; rounds are the tree's depth."""
    from ..operators.pack import checkpoint

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs
        fsys, base = _filesystem(root)
        base = base.rstrip("/")
        for b in batches:
            for folder in b.column(0).to_pylist():
                at = f"{base}/{folder}" if folder else base
                found = fsys.get_file_info(pafs.FileSelector(at, recursive=False))
                for i in range(0, len(found), 50_000):
                    part = found[i:i + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{folder}/{x.base_name}" if folder else x.base_name for x in part], pa.string()),
                         pa.array([x.size for x in part], pa.int64()),
                         pa.array([x.mtime_ns for x in part], pa.int64()),
                         pa.array([x.type == pafs.FileType.Directory for x in part], pa.bool_())],
                        names=["path", "length", "changed", "folder"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders = spark.createDataFrame([("",)], "path string")
    files = None
    while True:
        level = checkpoint(folders.repartition(n, "path").mapInArrow(run, "path string, length long, changed long, folder boolean"))
        here = level.where("not folder").select("path", "length", "changed")
        files = here if files is None else files.unionByName(here)
        folders = level.where("folder").select("path")
        if not folders.limit(1).count():
            return files


def scan_files(spark: SparkSession, root: str, max_file_size: int | None = None,
               path_glob: str | None = None, corpus_depth: int = 1) -> DataFrame:
    """Recursive read of a directory tree.

    The first ``corpus_depth`` directory levels under ``root`` name the
    corpus.  Names beginning with a dot or an underscore are files like others.
    ``max_file_size`` and ``path_glob`` (on the file's name) are tested on the
    listing, before anything is read; bad UTF-8 decodes to U+FFFD.  A file that
    vanished since the listing is skipped; any other failure to read ends the
    job, so no file is lost silently.  Files outside any corpus directory are
    not read.
    """
    import fnmatch
    import re
    listed = list_files(spark, root)
    if max_file_size:
        listed = listed.where(F.col("length") <= F.lit(int(max_file_size)))
    if path_glob:
        listed = listed.where(F.substring_index("path", "/", -1).rlike("^" + fnmatch.translate(path_glob).replace(r"\Z", r"\z")))
    return read_listed(with_corpus(listed, corpus_depth), root)


def with_corpus(listed: DataFrame, corpus_depth: int) -> DataFrame:
    """``corpus_id, path, at`` (and the listing's other columns) of files inside
    a corpus directory, ``at`` being the place under the root."""
    segs, depth = F.split("path", "/", -1), int(corpus_depth)
    return listed.where(F.size(segs) > depth).select(
        F.array_join(F.slice(segs, 1, depth), "/").alias("corpus_id"),
        F.array_join(F.slice(segs, F.lit(depth + 1), F.size(segs)), "/").alias("path"), F.col("path").alias("at"),
        *[c for c in listed.columns if c != "path"])


def read_listed(listed: DataFrame, root: str, keep: Sequence[str] = ()) -> DataFrame:
    """``files`` of the places ``at`` under ``root``, with the columns ``keep``."""
    spark = listed.sparkSession
    listed = listed.select("corpus_id", "path", "at", *([F.struct(*keep).alias("keep")] if keep else []))
    fields = list(FILES_SCHEMA.fields) + ([listed.schema["keep"]] if keep else [])

    def run(batches):
        import pyarrow as pa
        fsys, base = _filesystem(root)
        base = base.rstrip("/")

        def out(b, rows):
            at = pa.array([r[0] for r in rows])
            columns = [b.column(0).take(at), b.column(1).take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, *[c.take(at) for c in b.columns[3:]]], names=[f.name for f in fields])

        for b in batches:
            rows, held = [], 0
            for i, at in enumerate(b.column(2).to_pylist()):
                try:
                    with fsys.open_input_stream(f"{base}/{at}") as f:
                        data = f.read()
                except FileNotFoundError:
                    continue
                rows.append((i, data.decode("utf-8", "replace"), len(data)))
                held += len(data)
                if held >= 16 << 20:
                    yield out(b, rows)
                    rows, held = [], 0
            if rows:
                yield out(b, rows)

    # One hot corpus is spread as well: files are dealt by their whole path.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = listed.repartition(n, "at").mapInArrow(run, T.StructType(fields))
    return out.select("corpus_id", "path", "content", "size", *[F.col("keep")[c].alias(c) for c in keep])


def read_ignore_rules(files: DataFrame) -> DataFrame:
    """Per-corpus ignore patterns from the rule files at each corpus root:
    lines trimmed, blanks and ``#`` lines dropped, file order kept in
    ``rule_no``."""
    rf = files.where(F.col("path").isin(K.RULE_FILES))
    rf = rf.withColumn("_f", F.array_position(F.array(*[F.lit(x) for x in K.RULE_FILES]), F.col("path")))
    ex = rf.select("corpus_id", "_f", F.posexplode(F.split("content", "\n", -1)).alias("_l", "line"))
    pat = F.regexp_replace("line", rf"^{WS}+|{WS}+\z", "")
    return (ex.select("corpus_id", pat.alias("pattern"), F.struct("_f", "_l").alias("rule_no"))
            .where((F.col("pattern") != "") & ~F.col("pattern").startswith("#")))
