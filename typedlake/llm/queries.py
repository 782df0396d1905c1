"""The queries of the numbered operators, with the parameters of production, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    texts = extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text")
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, taken_of

    return taken_of(*mix(_table(spark, sf_dir, "documents")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import sampled

    return sampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_chats, read_back

    said = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    tokenizer = spark.conf.get("spark.typedlake.chat.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken")
    return read_back(format_chats(said.unionByName(spark.createDataFrame(probe, "conv_id long, turn long, role string, text string")), tokenizer))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import lm_scores

    return lm_scores(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymise

    key = spark.conf.get("spark.typedlake.pii.key", "for the test tables only")
    return pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), key, count_col="n_found")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_sharding": op2_sharding,
    "op3_html_text": op3_html_text,
    "op4_decontaminate": op4_decontaminate,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_chat": op7_chat,
    "op8_lm_score": op8_lm_score,
    "op9_pii": op9_pii,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {
    "op10_jaccard_join": r"""
        WITH RECURSIVE split AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s
            FROM split
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
        ), pairs AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
        ), reach AS (
            SELECT doc_id AS x, doc_id AS y FROM documents
            UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
        ), least AS (
            SELECT x, min(y) AS y FROM reach GROUP BY 1
        )
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, y AS component_id
        FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN least ON x = d.doc_id
    """,
    "op7_chat": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), joined AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
                   coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS learnt,
                   sum(length(role || text) + length('<|start|><|message|><|end|>')
                       + length(regexp_replace(role || chr(10) || text, '(<\\*(\||/?s>)|\[\\*/?INST\]|<<\\*/?SYS>>)', '\1#', 'g'))
                       - length(role || chr(10) || text)) AS formatted_chars
            FROM said GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt) AS loss_chars,
               sha256(learnt) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
        FROM joined
    """,
    "op1_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS cp,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha
            FROM documents
        ), r AS (
            SELECT doc_id, sha,
                   first_value(doc_id) OVER w AS keep_id,
                   count(*) OVER (PARTITION BY sha) AS group_size,
                   row_number() OVER w AS place
            FROM n WINDOW w AS (PARTITION BY sha ORDER BY cp DESC, doc_id)
        )
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha AS text_sha256 FROM r
    """,
}
