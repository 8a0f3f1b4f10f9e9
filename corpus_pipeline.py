"""From raw documents to packed sequences in four stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one
before it kept; all but the last return the columns of ``documents``.  Between
stages the documents are written as Parquet in the shared folder and read
again, which also cuts the lineage.

Nulls, empty texts, ties and repeated rows: a null or empty text is scored, has
no duplicate and no benchmark words, and packs to its end token.  Near
duplicates are told apart by row: of a group the row with the smallest id stays
(null ids count as the largest), of that id's texts the one with the smallest
hash, and of equal rows one.  Texts of any length go through every stage whole.
Empty tables pass through every stage; extra columns are kept up to packing,
also where their names are those of an operator's results.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontamination, harmonic, quality
from quire.llm.common import cut, prepare, table
from quire.llm.jaccard_join import jaccard_components
from quire.llm.queries import PACK_END_ID, PACK_VOCABULARY, vocabulary
from quire.operators.joins import null_safe_join
from quire.session import work_path

#: Marked rows up to which their ids and hashes are broadcast (some 24 bytes each).
BROADCAST_IDS = 500_000
#: Private columns; all of a table's own stand in the first.
EXTRA, HASH, STAYS = "__extra", "__hash", "__stays"


def _bare(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and all else as one private column, with which no result can clash."""
    extra = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*extra).alias(EXTRA)] if extra else []))


def _whole(bare: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that :func:`_bare` was given."""
    return bare.select(*[(F.col(c) if c.lower() in ("doc_id", "text") else F.col(EXTRA)[c]).alias(c) for c in columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    prepare(spark)
    bare = _bare(docs)
    model = quality.fit(quality.document_statistics(bare.select("doc_id", "text").where(~quality.held_out())), table(spark, sf_dir, "labels"))
    return _whole(quality.score(bare, model).where("predicted = 1"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id,
    of that id's texts the one with the smallest hash, of equal rows one."""
    prepare(spark)
    bare = _bare(docs).withColumn(HASH, F.xxhash64("text"))
    row = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col(HASH).alias("text"))
    groups = cut(jaccard_components(bare.select(row.alias("doc_id"), "text")))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    key = [F.col("doc_id.id").alias("doc_id"), F.col("doc_id.text").alias(HASH)]
    # Rows that go, and rows of which one stays; both only where a text has words.
    marks = cut(groups.where("n_shingles > 0").groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("n"))
                .where(~kept | (F.col("n") > 1)).select(*key, kept.alias(STAYS)))
    several = marks.where(STAYS).limit(1).count() > 0
    if marks.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        marks = F.broadcast(marks)
    marked = null_safe_join(bare, marks, ["doc_id", HASH], "left")
    out = marked.where(F.col(STAYS).isNull()).select(*bare.columns)
    if several:
        one = marked.where(STAYS).groupBy("doc_id", HASH).agg(F.any_value(F.struct(*bare.columns)).alias("r")).select("r.*")
        out = out.unionByName(one)
    return _whole(out, docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more than stray words of the benchmark."""
    prepare(spark)
    judged = decontamination.decontaminate(_bare(docs), table(spark, sf_dir, "benchmark"))
    return _whole(judged.where("not contaminated"), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their ids."""
    prepare(spark)
    return harmonic.pack(docs, vocabulary(PACK_VOCABULARY), PACK_END_ID)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: A learnt classifier and a tokenizer are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder = work_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
