"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, covertree, jaccard, labelled, packing, pieces, quality, sharding, token_files, toxicity, winnowing
from .common import table


def _scored(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select(
        "doc_id",
        labelled.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all ``documents``, learned from ``labels.quality``."""
    docs = table(spark, sf_dir, "documents")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return _scored(quality.score(docs, model), 0.7)


def op2_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all ``embeddings`` for every row whose vec_id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    return covertree.top_k(rows, F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents``, of their edited texts and of the next documents."""
    found = winnowing.edited(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2("edited_text", 256).alias("edited_sha256"),
        winnowing.digest(F.col("marks")).alias("fingerprint"),
        winnowing.digest(F.col("edited_marks")).alias("edited_fingerprint"),
        winnowing.likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        winnowing.likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all ``documents``, learned from ``labels.toxic``."""
    docs = table(spark, sf_dir, "documents")
    net = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return _scored(toxicity.score(docs, net), 0.3)


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of all ``documents``, its ids, and whether they decode to the text."""
    found = pieces.encode(table(spark, sf_dir, "documents"), seed=1, source="source")
    back = pieces.decode(found, keep=("n_pieces", "n_bytes", "ids_crc32", "source", "ids"))
    fine = F.col("text") == F.coalesce("source", F.lit(""))
    return back.select("doc_id", "n_pieces", "n_bytes", "ids_crc32", fine.alias("lossless"), "ids")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in as few sequences of at most 4096 tokens as the search finds."""
    return packing.pack(table(spark, sf_dir, "documents"), limit=4096)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` written as Re-Pair shards and read back."""
    return token_files.read_shards(token_files.write_shards(table(spark, sf_dir, "documents"), end=2))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in 8 shards of near equal bytes, equal texts together."""
    out = sharding.shard(table(spark, sf_dir, "documents"), bins=8)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of all ``documents``: five-word shingles, similarity 0.8."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), tenths=8)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` and conversation -1, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    added = spark.range(0, 2, 1, 1).select(
        F.lit(-1).cast(rows.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(says).alias("text"),
    )
    return chat.digest(chat.format_conversations(rows.unionByName(added)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_quality": op1_quality, "op2_covertree": op2_covertree, "op3_winnowing": op3_winnowing, "op4_toxicity": op4_toxicity, "op5_pieces": op5_pieces, "op6_packing": op6_packing, "op7_token_files": op7_token_files, "op8_sharding": op8_sharding, "op9_jaccard": op9_jaccard, "op10_chat_format": op10_chat_format}


#: DuckDB SQL of the operators that SQL can express.
ORACLES = {
    "op2_covertree": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), q AS (
            SELECT vec_id AS query_id, unnest(e) AS x, unnest(range(len(e))) AS i FROM v WHERE vec_id % 100 = 0
        ), c AS (
            SELECT vec_id, unnest(e) AS y, unnest(range(len(e))) AS i FROM v
        ), s AS (
            SELECT query_id, vec_id, CAST(sum(x * y) AS BIGINT) AS score
            FROM q JOIN c USING (i) WHERE query_id <> vec_id GROUP BY ALL
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id, score
            FROM s
        )
        SELECT * FROM r WHERE rank <= 10
    """,
    "op9_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
        ), n AS (
            SELECT doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id
        ), p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
        ), l AS (
            SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)
            UNION ALL SELECT x.doc_id, y.doc_id FROM n x JOIN n y ON x.n = 0 AND y.n = 0 AND x.doc_id <> y.doc_id
        ), r(id, root) AS (
            SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id
        ), d AS (
            SELECT a AS doc_id, count(*) AS k FROM l GROUP BY a
        )
        SELECT n.doc_id, min(r.root) AS class_id, coalesce(any_value(d.k), 0) AS n_links, any_value(n.n) AS set_size, n.doc_id AS member_id
        FROM n JOIN r ON r.id = n.doc_id LEFT JOIN d ON d.doc_id = n.doc_id GROUP BY n.doc_id
    """,
    "op10_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), m AS (
            SELECT *, len(regexp_extract_all(text, '\[/?INST\]|</?s>|<</?SYS>>|\[/?ROLE\]|\[:\]')) AS k,
                CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 16 + length(role) END AS frame FROM t
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(frame + length(text) + k) AS BIGINT) AS formatted_chars, sum(k) > 0 AS escaped, true AS round_trip
        FROM m GROUP BY conv_id
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
