"""One registered query per operator, over its whole table."""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocation, decontamination, harmonic, jaccard_join, quality, ring, scaled_sketch, secret_scan, token_attribution, url_rules, warc, whitening
from ..session import work_path
from .common import cut, table

#: Vocabulary files of the queries, by name in the public vocabularies.
COUNT_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PACK_VOCABULARY = "word_bpe_49k.json"
PACK_END_ID = 2
SECTION_CHARS = 500


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_offset_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every section (500 characters, the last one the rest) of all
    documents; a token over a border counts for the section with most of it.  A
    null or empty text is one section without tokens."""
    import public_tokenizers
    n = F.length(F.coalesce("text", F.lit("")))
    empty = F.array(F.struct(F.lit(0).alias("name"), F.lit(0).alias("start"), F.lit(0).alias("end")))
    sections = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(SECTION_CHARS)), lambda at: F.struct(
        (at / SECTION_CHARS).cast("int").alias("name"), at.alias("start"), F.least(at + SECTION_CHARS, n).alias("end")))).otherwise(empty)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", sections.alias("sections"))
    return token_attribution.attribute(docs, vocabulary(COUNT_VOCABULARY), public_tokenizers.PATTERN, "sections")


def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records, read back and reassembled."""
    path = work_path(spark, f"warc-{uuid.uuid4().hex}")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    rows = cut(warc.read_payloads(spark, path)
               .select(F.col("row_id").cast("long").alias("page_id"), "record_id", "refers_to",
                       F.col("refers_to_row").cast("long").alias("first"), F.length("payload").cast("long").alias("size"),
                       F.substring_index("digest", ":", -1).alias("payload_digest"), "type", "status"))
    # Only revisits take their size from another record; responses stay where they are.
    sizes = (rows.where("type = 'response'").groupBy("record_id").agg(F.max("size").alias("first_size"))
             .withColumnRenamed("record_id", "refers_to"))
    again = rows.where("type = 'revisit'").join(sizes, "refers_to", "left").withColumn("size", F.col("first_size"))
    return (rows.where("type <> 'revisit'").unionByName(again.select(*rows.columns))
            .select("page_id", F.col("size").alias("payload_bytes"), "payload_digest",
                    F.col("type").alias("record_type"), F.col("first").alias("refers_to"), "status"))


def op3_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark decontamination of all documents."""
    out = decontamination.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                        table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked by 5-word shingles at 0.75."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op5_fingerprint_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = {"messages": [{"role": "user", "content": said}, {"role": "assistant", "content": said}]}
    records = chat.rows_as_records(table(spark, sf_dir, "conversations")).unionByName(
        spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.lit(json.dumps(extra)).alias("record")))
    turns = chat.canonical_turns(records).where("layout is not null")
    return chat.digests(chat.formatted(turns))


def op6_association_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the URL of every page."""
    out = url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op7_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    rows = scaled_sketch.fingerprints_of_edits(table(spark, sf_dir, "documents"))
    own, edited, following = F.col("own"), F.col("edited_own"), F.col("next_own")
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       scaled_sketch.printed(own).alias("fingerprint"), scaled_sketch.printed(edited).alias("edited_fingerprint"),
                       scaled_sketch.likeness(own, edited).alias("near_edited"), scaled_sketch.likeness(own, following).alias("near_next"))


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing of all documents into sequences of 4096 tokens."""
    out = harmonic.pack(table(spark, sf_dir, "documents"), vocabulary(PACK_VOCABULARY), PACK_END_ID)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_kernel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt outside the held-out fold."""
    stats = cut(quality.document_statistics(table(spark, sf_dir, "documents")).withColumn("held_out", quality.held_out()))
    model = quality.fit(stats.where("not held_out"), table(spark, sf_dir, "labels"))
    return quality.score_statistics(stats, model).select("doc_id", "held_out", "score", "predicted")


def op10_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to eight shards of equal counts."""
    text = F.coalesce("text", F.lit(""))
    narrow = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    out = ring.shard(narrow, ["text_hash", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op11_setm_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase collocations of every language of all documents."""
    return collocation.mine(table(spark, sf_dir, "documents").select("text", "lang"))


def op12_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: base patterns and high-entropy windows."""
    return secret_scan.summary(secret_scan.scan(table(spark, sf_dir, "documents")))


def op13_qd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of all embeddings."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_offset_attribution": op1_offset_attribution,
    "op2_warc_segments": op2_warc_segments,
    "op3_prefix_decontamination": op3_prefix_decontamination,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_fingerprint_chat": op5_fingerprint_chat,
    "op6_association_urls": op6_association_urls,
    "op7_scaled_sketch": op7_scaled_sketch,
    "op8_harmonic_packing": op8_harmonic_packing,
    "op9_kernel_quality": op9_kernel_quality,
    "op10_bounded_ring": op10_bounded_ring,
    "op11_setm_collocations": op11_setm_collocations,
    "op12_entropy_secrets": op12_entropy_secrets,
    "op13_qd_whitening": op13_qd_whitening,
}

#: Folds A-Z alone, as the contracts ask.
_LOW = f"translate(coalesce(text, ''), '{url_rules.UPPER}', '{url_rules.LOWER}')"

#: DuckDB SQL for the queries that plain SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op3_prefix_decontamination": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT item_id, w, least(13, len(w)) AS m,
 unnest(range(1, greatest(len(w) - least(13, len(w)) + 2, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM wins),
grams AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
hits AS (SELECT g.doc_id, g.i, g.m, v.item_id FROM grams g JOIN wins v ON v.m = g.m AND v.k = g.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op4_jaccard_join": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM o JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.v FROM r JOIN l ON l.u = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)""",
    "op11_setm_collocations": f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOW}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, m, w[i:i + m - 1] AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS a FROM g GROUP BY lang, m, phrase),
c AS (SELECT * FROM f WHERE m >= 2 AND a >= 30),
cuts AS (SELECT lang, phrase, a, array_to_string(g[1:k], ' ') AS head, array_to_string(g[k + 1:], ' ') AS tail, k FROM
 (SELECT *, unnest(range(1, m)) AS k FROM c)),
scored AS (SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (CAST(l.a AS HUGEINT) + r.a) AS BIGINT) AS score, k
 FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
gone AS (SELECT DISTINCT p.lang, p.phrase FROM c p JOIN c q ON q.lang = p.lang AND q.m > p.m AND 100 * CAST(q.a AS HUGEINT) >= 80 * CAST(p.a AS HUGEINT)
 AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' ')),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM best b JOIN n USING (lang) WHERE NOT EXISTS (SELECT 1 FROM gone x WHERE x.lang = b.lang AND x.phrase = b.phrase)
QUALIFY rank <= 2000""",
}
