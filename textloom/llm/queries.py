"""The registered queries of this subpackage, one an operator, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import audio, chat, embedding_dedup, jaccard_join, mixing, packing, substring_dedup, suffix_index, token_store, toxicity
from textloom.llm.tokens import tokenizer_path
from textloom.session import scratch, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), out, tokenizer_path("word_bpe_49k.json"))
    return token_store.digests(spark, out)


def op7_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(audio.store_texts(table(spark, sf_dir, "documents")))


def op8_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat.conversation_digests(chat.format_turns(rows.unionByName(own)))


def op10_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.remove_long_matches(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_mix_sources, op3_jaccard_join, op4_toxicity, op5_embedding_dedup, op6_token_store, op7_media_audio, op8_pack_documents, op9_chat_format, op10_suffix_index)
}

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

_REPEATS = rf"""
WITH words AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE {_WORDS} END AS w FROM documents),
starts AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s
  FROM words, unnest(range(1, greatest(len(w) - 33, 1))) t(i)),
twice AS (SELECT s FROM starts GROUP BY s HAVING count(*) > 1),
gone AS (
  SELECT doc_id, list_sort(list_distinct(flatten(list(range(i, i + 35))))) AS g
  FROM starts SEMI JOIN twice USING (s) GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(w) AS n, coalesce(len(g), 0) AS r,
    CASE WHEN g IS NULL THEN w ELSE (
      SELECT coalesce(list(w[p] ORDER BY p), []) FROM (SELECT unnest(range(1, len(w) + 1)) AS p) WHERE NOT list_contains(g, p)) END AS k
  FROM words LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

_CONTROLS = ["\\", "<|", "<s>", "</s>", "[INST]", "[/INST]"]


def _escaped(column: str) -> str:
    """The length of a text with its controls escaped: each gets one backslash."""
    return f"(len({column}) + " + " + ".join(f"(len({column}) - len(replace({column}, '{c}', ''))) // {len(c)}" for c in _CONTROLS) + ")"


_CHAT = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat.TURN + chat.TEXT + chat.END)} + {_escaped("role")} + {_escaped("text")})::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""


def _seats(parties: str, by: str, name: str, votes: str, seats: str) -> str:
    """Sainte-Lague seats, by listing every quotient that could win one."""
    over = f"PARTITION BY {by}" if by else ""
    return f"""
SELECT * EXCLUDE (votes, many, exact, margin, sure, open), sure + coalesce((
    SELECT count(*) FROM (
      SELECT o.{name} AS who, row_number() OVER (ORDER BY o.{votes}::DOUBLE / (2 * k + 1) DESC, o.{name} NULLS LAST, k) AS place
      FROM {{near}} o, unnest(range(o.sure::BIGINT, (o.exact + o.margin + 1)::BIGINT)) q(k)
      WHERE o.{votes} > 0 {"AND o." + by + " IS NOT DISTINCT FROM n." + by if by else ""})
    WHERE place <= n.open AND who IS NOT DISTINCT FROM n.{name}), 0) AS won
FROM {{near}} n""", f"""
SELECT *, {seats} - sum(sure) OVER ({over}) AS open FROM (
  SELECT *, greatest(0, exact - margin) AS sure FROM (
    SELECT *, floor(CASE WHEN votes > 0 THEN {votes}::DOUBLE / votes ELSE 0 END * {seats})::BIGINT AS exact,
      ceil(CASE WHEN votes > 0 THEN {votes}::DOUBLE / votes ELSE 0 END * many / 2)::BIGINT + 1 AS margin
    FROM (SELECT *, sum({votes}) OVER ({over}) AS votes, count(*) OVER ({over}) AS many FROM {parties})))"""


def _mix() -> str:
    b, m = mixing.BLOCK_TOKENS, mixing.MAX_REPEAT
    first, near1 = _seats("aimed", "", "source", "target", "seats")
    second, near2 = _seats("shards", "source", "shard", "shard_size", "source_won")
    return rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len({_WORDS}), 0)::BIGINT AS size, md5('{mixing.SEED}|' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs FROM sized GROUP BY source),
ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size::DOUBLE * {m} AS cap,
    (sum(source_size) OVER ())::DOUBLE AS total FROM sizes),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
aimed AS (
  SELECT source, source_size, docs, round(total / {b})::BIGINT AS seats, CASE WHEN level * weight > cap THEN cap
    ELSE max(level) FILTER (NOT level * weight > cap) OVER () * weight END AS target FROM levels),
near1 AS ({near1}),
sources AS (
  SELECT source, source_size, target, won AS source_won,
    greatest(1, ceil(source_size / {mixing.SHARD_TOKENS}), ceil(docs / {mixing.SHARD_DOCS}))::BIGINT AS n FROM ({first.format(near="near1")})),
placed AS (
  SELECT s.*, p.source_size, p.target, p.source_won, ('0x' || substr(digest, 1, 8))::BIGINT % n AS shard
  FROM sized s JOIN sources p ON s.source IS NOT DISTINCT FROM p.source),
shards AS (SELECT source, shard, source_won, sum(size)::BIGINT AS shard_size FROM placed GROUP BY ALL),
near2 AS ({near2}),
quotas AS (SELECT source, shard, shard_size, least(won * {b}, shard_size * {m})::BIGINT AS quota FROM ({second.format(near="near2")})),
streams AS (
  SELECT p.*, shard_size, quota, CASE WHEN shard_size > 0 THEN quota // shard_size ELSE 0 END AS passes,
    (sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY substr(digest, 9, 24), size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - size AS ahead
  FROM placed p JOIN quotas q ON p.source IS NOT DISTINCT FROM q.source AND p.shard = q.shard)
SELECT doc_id, size, source_size, target,
  (passes * size + greatest(0, least(size, quota - passes * shard_size - ahead)))::BIGINT AS taken FROM streams
"""


SQL = {"op1_substring_dedup": _REPEATS, "op2_mix_sources": _mix(), "op9_chat_format": _CHAT}
