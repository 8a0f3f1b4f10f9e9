"""Sinks (A7, A8): rendered documents and block rows to storage.

``write_files`` writes each document as one file of its own name.  Block rows
are range-partitioned in the order of their documents and written by a Python
data source: a task appends its blocks to one part per document, under a
staging folder, and reports them in a manifest of its own.  The commit names
the manifests of the tasks that counted; a job that fails is aborted and leaves
nothing.  A second job then makes the files: a document with one part is that
part, one that many tasks wrote is their parts in order, streamed to a new file
by one task; either is moved to its name when it is whole.  So no document is a
value, readers never see half of one, and running a write again replaces the
files it names.
"""
from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass
from typing import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .files import _filesystem

CHUNK_EXT = {"json": "json", "xml": "xml"}
COPY_BYTES = 8 << 20
STAGING = "_staging"


def chunk_file_name(chunk_col="chunk", fmt: str = "markdown"):
    """``chunk-NN.ext``: two-digit padding, wider numbers kept whole."""
    ext = CHUNK_EXT.get(fmt, "md")
    c = F.col(chunk_col).cast("string")
    return F.concat(F.lit("chunk-"), F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c), F.lit("." + ext))


def write_documents(docs: DataFrame, path: str, fmt: str = "markdown", mode: str = "overwrite") -> None:
    """One output per (corpus, chunk): a folder ``corpus_id=…/file=chunk-NN.ext``
    holding the document text.  Re-running overwrites the same partitions."""
    out = docs.withColumn("file", chunk_file_name("chunk", fmt)) if "chunk" in docs.columns else \
        docs.withColumn("file", F.lit("context"))
    (out.repartition("corpus_id", "file").select("corpus_id", "file", "document")
        .write.mode(mode).option("partitionOverwriteMode", "dynamic")
        .partitionBy("corpus_id", "file").option("lineSep", "\n").text(path))


def write_blocks(blocks: DataFrame, path: str, mode: str = "overwrite", group=("corpus_id",)) -> None:
    """Write documents from block rows (``render_blocks``), in order, one
    folder per document.  Rows are range-partitioned on the full order key so
    a large document is written by many tasks as consecutive part files.

    Blocks become whole lines, so this is for formats whose blocks end at line
    ends (markdown, XML, plain, templates made so); JSON keeps its tree inside
    one string and is not written this way.  The last file ends with one line end."""
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    g = list(group)
    order = [*g, "part", "segs", "seq"]
    rows = blocks.select(*g, "part", "segs", "seq", F.regexp_replace("block", r"\n\z", "").alias("value"))
    (rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
         .select(*g, "value").write.mode(mode).option("partitionOverwriteMode", "dynamic")
         .partitionBy(*g).text(path))


def write_table(df: DataFrame, path: str, partition_by=("corpus_id",), mode: str = "overwrite") -> None:
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


@dataclass
class _Parts(WriterCommitMessage):
    manifest: str | None


class _PartWriter(DataSourceArrowWriter):
    """Appends ``(file, block)`` rows, which come in order, to one part per file."""

    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext
        fsys, base = _filesystem(self.root)
        own = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}"
        fsys.create_dir(f"{base}/parts", recursive=True)
        made, at, out, size = [], None, None, 0
        for b in iterator:
            for file, block in zip(b.column("file").to_pylist(), b.column("block").to_pylist()):
                if file != at:
                    if out is not None:
                        out.close()
                        made[-1]["bytes"] = size
                    at, size = file, 0
                    made.append({"file": file, "slice": TaskContext.get().partitionId(), "part": f"parts/{own}-{len(made)}"})
                    out = fsys.open_output_stream(f"{base}/{made[-1]['part']}")
                raw = block.encode()
                out.write(raw)
                size += len(raw)
        if out is None:
            return _Parts(None)
        out.close()
        made[-1]["bytes"] = size
        fsys.create_dir(f"{base}/manifests", recursive=True)
        with fsys.open_output_stream(f"{base}/manifests/{own}.json") as f:
            for m in made:
                f.write((json.dumps(m) + "\n").encode())
        return _Parts(f"manifests/{own}.json")

    def commit(self, messages: list) -> None:
        fsys, base = _filesystem(self.root)
        fsys.create_dir(base, recursive=True)
        with fsys.open_output_stream(f"{base}/committed.json") as f:
            for m in messages:
                if m is not None and m.manifest:
                    f.write((json.dumps(m.manifest) + "\n").encode())

    def abort(self, messages: list) -> None:
        _removed(self.root)


class PartSink(DataSource):
    """``(file, block)`` rows as parts under the ``path`` option."""

    @classmethod
    def name(cls) -> str:
        return "quire_parts"

    def schema(self) -> str:
        return "file string, block string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _PartWriter(self.options["path"])


def _removed(root: str) -> None:
    from pyarrow import fs as pafs
    fsys, base = _filesystem(root)
    if fsys.get_file_info(base).type == pafs.FileType.Directory:
        fsys.delete_dir(base)


def folder_name(corpus="corpus_id") -> Column:
    """A folder's name for a corpus: what no file system takes is escaped."""
    c = F.replace(F.url_encode(F.col(corpus)), F.lit("+"), F.lit("%20"))
    return F.coalesce(F.when(F.col(corpus) == "", F.lit("%")).otherwise(F.regexp_replace(c, r"^\.", "%2E")), F.lit("%00"))


def document_name(fmt: str, chunk: str | None = None, name: str = "context") -> Column:
    """``chunk-NN.ext`` of a chunk, else ``name.ext``."""
    if chunk is not None:
        return chunk_file_name(chunk, fmt)
    return F.lit(f"{name}.{CHUNK_EXT.get(fmt, 'md')}")


def _assembled(root: str, staging: str):
    """Makes files of their parts; rows are ``(file, parts)`` in order."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        fsys, base = _filesystem(root)
        for b in batches:
            for file, parts in zip(b.column("file").to_pylist(), b.column("parts").to_pylist()):
                whole = f"{base}/{staging}/{parts[0]['part']}"
                if len(parts) > 1:
                    whole = f"{base}/{staging}/parts/whole-{uuid.uuid4().hex}"
                    with fsys.open_output_stream(whole) as out:
                        for p in parts:
                            with fsys.open_input_stream(f"{base}/{staging}/{p['part']}") as f:
                                while chunk := f.read(COPY_BYTES):
                                    out.write(chunk)
                fsys.create_dir(f"{base}/{posixpath.dirname(file)}", recursive=True)
                try:
                    fsys.move(whole, f"{base}/{file}")
                except FileNotFoundError:      # an earlier attempt of this task has moved it
                    if len(parts) > 1 or fsys.get_file_info(f"{base}/{file}").size != parts[0]["bytes"]:
                        raise
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("bytes")], names=["file", "bytes"])

    return run


def write_files(blocks: DataFrame, path: str, fmt: str, group: Sequence[str] = ("corpus_id",), name: str = "context") -> DataFrame:
    """Write the documents of ``render_blocks`` rows, one file each:
    ``<corpus>/chunk-NN.ext`` where ``group`` has ``chunk``, else
    ``<corpus>/<name>.ext``.  Returns ``file, bytes`` of what was written; each
    file has exactly the text that ``render_documents`` gives (pretty JSON)."""
    from ..operators.ordered import slices_for
    from ..operators.pack import checkpoint, stored
    from ..operators.render import resolve_format
    spark = blocks.sparkSession
    spark.dataSource.register(PartSink)
    file = F.concat(folder_name(), F.lit("/"), document_name(resolve_format(fmt), "chunk" if "chunk" in group else None, name))
    # Slices follow the blocks' order, so they are cut on a written copy: its order is sampled without rendering twice.
    rows = stored(blocks.select(file.alias("file"), "part", "segs", "seq", "block"))
    order = ["file", "part", "segs", "seq"]
    staging = f"{STAGING}-{uuid.uuid4().hex}"
    root = path.rstrip("/")
    try:
        (rows.repartitionByRange(slices_for(rows), *order).sortWithinPartitions(*order).select("file", "block")
             .write.format("quire_parts").option("path", f"{root}/{staging}").mode("append").save())
        made = _manifests(spark, f"{root}/{staging}")
        parts = made.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("slice", "part", "bytes"))).alias("parts"), F.sum("bytes").alias("bytes"))
        return checkpoint(parts.repartition("file").mapInArrow(_assembled(root, staging), "file string, bytes long"))
    finally:
        _removed(f"{root}/{staging}")


def _manifests(spark: SparkSession, staging: str) -> DataFrame:
    """Parts that the committed tasks made (the driver sees one name a task)."""
    fsys, base = _filesystem(staging)
    with fsys.open_input_stream(f"{base}/committed.json") as f:
        names = [json.loads(line) for line in f.read().decode().splitlines()]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        kinds = pa.schema([("file", pa.string()), ("slice", pa.int64()), ("part", pa.string()), ("bytes", pa.int64())])
        fsys, base = _filesystem(staging)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fsys.open_input_stream(f"{base}/{name}") as f:
                    rows = [json.loads(line) for line in f.read().decode().splitlines()]
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return spark.createDataFrame([(n,) for n in names], "name string").mapInArrow(run, "file string, slice long, part string, bytes long")
