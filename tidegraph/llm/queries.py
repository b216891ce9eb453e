"""The registered queries of the training-data operators: thin digests of each operator's output, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm import chat, decontaminate, jaccard, lattice, media, pii, token_counts, toxicity, url_filters, warc
from tidegraph.llm.common import table

MODEL = "piece_bpe_32k.model"
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), model_path())


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.cluster(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest_conversations(chat.format_conversations(turns.unionByName(extra)))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.match_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted", "spans")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect_pii(table(spark, sf_dir, "documents")).drop("masked")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids_sha256 (ids comma-joined), decoded_sha256 (of the decoded text: equals the text's own), round_trip."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = lattice.encode_texts(docs, model_path(), decoded_col="decoded")
    return both.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.size("piece_ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("piece_ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.store_texts(table(spark, sf_dir, "documents"))).drop("media_type", "carved")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_token_counts, op2_warc, op3_url_filters, op4_jaccard_join, op5_chat_formatting, op6_decontamination, op7_toxicity, op8_pii, op9_sentencepiece, op10_media, pipeline)
    return {f.__name__: f for f in own}


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), q AS (SELECT *, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM q"""

JACCARD_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(w[k : k + 4], 'string_agg', ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 3))) AS k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id)"""

CHAT_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(i, r)),
e AS (SELECT *, length(regexp_replace(text, '{chat.ESCAPE}', '\1\1\\\2', 'g')) AS held, CASE {" ".join(f"WHEN role = '{r}' THEN {len(a + b)}" for r, (a, b) in chat.TURNS.items())}
  ELSE {len("".join(chat.OTHER))} + length(regexp_replace(role, '{chat.ESCAPE}', '\1\1\\\2', 'g')) END AS marks FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(held + marks) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(10, len(w)) AS n, list_aggregate(w[k : k + 9], 'string_agg', ' ') AS words FROM i, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 8))) AS k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, k, n, list_aggregate(w[k : k + n - 1], 'string_agg', ' ') AS words FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS k)),
met AS (SELECT DISTINCT doc_id, k, n, item FROM places JOIN windows USING (n, words)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM (SELECT DISTINCT doc_id, k, n FROM met)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """What SQL can say. No tokenizer, template tree, random field, transducer, Viterbi fold or media validator is in it: the tests compare
    those queries with the library, brute force or held-out labels."""
    return {"op2_warc": WARC_SQL, "op4_jaccard_join": JACCARD_SQL, "op5_chat_formatting": CHAT_SQL, "op6_decontamination": DECONTAMINATION_SQL}
