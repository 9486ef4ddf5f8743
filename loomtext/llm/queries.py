"""The registered queries of the thirteen operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import alignment, balanced_packing, chat, decontamination, language_id, near_dups, paragraphs, quality, repeats, secrets, sharding, token_matrix, whitening
from loomtext.runtime import table

SHARDS = 24


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op2_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.classes(table(spark, sf_dir, "documents"), near_dups.Params(shingle=4))


#: A conversation whose texts look like template marks.
HOSTILE = r"\### Assistant: </turn> ok"


def op4_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    back = chat.read_back(chat.examples(rows.unionByName(own)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("trained", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def op5_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_matrix.build(table(spark, sf_dir, "documents"))
    return rows.select("sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", F.crc32("ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"))


def op6_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op8_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    line = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in secrets.BASE]))
    return found.select("doc_id", *[of(r.kind) for r in secrets.BASE], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op9_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.spans(table(spark, sf_dir, "documents"))


def op10_cost_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = balanced_packing.pack(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents")).withColumn("doc_id", F.col("doc_id").cast("long"))


def op12_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.compare_edits(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_tokenizer_fertility, op3_bbit_minhash, op4_prefix_targets, op5_token_matrix, op6_template_leaks, op7_rendezvous, op8_trigram_secrets, op9_sparse_suffixes, op10_cost_balanced, op11_token_alignment, op12_paragraph_sketch, op13_embedding_whitening)}

#: Roles hold no mark or colon in the tables, so their escaping is left out here.
_OP4 = r"""
WITH own AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(role) + 14 + length(text) + (length(text) - length(replace(text, '\', '')))
    - (length(text) - length(replace(text, '###', ''))) // 3
    - (length(text) - length(replace(text, '</turn>', ''))) // 7 * 5 AS line,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n FROM own),
summed AS (SELECT *, sum(line) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM sized)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
"""



def _crc32_table() -> list[int]:
    """The byte table of crc32: eight shifts of each byte."""
    table = list(range(256))
    for _ in range(8):
        table = [(x >> 1) ^ (0xEDB88320 if x & 1 else 0) for x in table]
    return table


_OP7 = f"""
WITH raw AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
hexed AS (SELECT r, doc_id, hex(encode(text)) AS h FROM raw),
summed AS (
  SELECT r, doc_id, CAST(length(h) // 2 + 8 AS BIGINT) AS size,
    CAST(xor(4294967295, list_reduce([4294967295] || [CAST(('0x' || x) AS BIGINT) for x in regexp_extract_all(h, '..')],
      lambda c, b: xor(c >> 8, ({_crc32_table()})[(xor(c, b) & 255) + 1]))) AS BIGINT) AS text_crc32
  FROM hexed),
bids AS (
  SELECT r, s, -1.0 / ln((CAST(('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || s)[1:13]) AS BIGINT) + 0.5) / 4503599627370496.0) AS bid
  FROM raw, (SELECT CAST(range AS INTEGER) AS s FROM range(25))),
won AS (SELECT r, arg_max(s, bid) FILTER (s < 24) AS shard, arg_max(s, bid) AS grown_shard FROM bids GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS BIGINT) AS slot, grown_shard
FROM summed JOIN won USING (r)
"""

#: Peeling recovers differences whole, so likeness is that of the sets of digests.
_OP12 = rf"""
WITH raw AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
paired AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next FROM raw),
edits AS (SELECT *, length(text) AS n, left(text, CAST(length(text) - length(text) // 2 AS BIGINT)) || left(next, CAST(length(text) // 2 AS BIGINT)) AS edited FROM paired),
pieces AS (
  SELECT doc_id, n, edited, list_distinct(regexp_extract_all(text, '{paragraphs.PATTERN}')) AS a,
    list_distinct(regexp_extract_all(edited, '{paragraphs.PATTERN}')) AS b, list_distinct(regexp_extract_all(next, '{paragraphs.PATTERN}')) AS c FROM edits),
keyed AS (
  SELECT doc_id, n, edited, [CAST(('0x' || md5(p)[1:15]) AS BIGINT) FOR p IN a] AS a,
    [CAST(('0x' || md5(p)[1:15]) AS BIGINT) FOR p IN b] AS b, [CAST(('0x' || md5(p)[1:15]) AS BIGINT) FOR p IN c] AS c FROM pieces),
side AS (SELECT doc_id, 'a' AS side, unnest(a) AS d FROM keyed UNION ALL SELECT doc_id, 'b', unnest(b) FROM keyed),
hits AS (SELECT doc_id, side, d, ((d >> (4 * p)) & 15) + 16 * p AS cell FROM side, (SELECT unnest([0, 1, 2]) AS p)),
filled AS (SELECT doc_id, side, cell, count(*) AS m, bit_xor(d) AS k, bit_xor(d % {paragraphs.CHECK}) AS c FROM hits GROUP BY ALL),
places AS (SELECT doc_id, side, cell FROM keyed, (SELECT unnest(['a', 'b']) AS side), (SELECT unnest(range(48)) AS cell)),
marks AS (
  SELECT doc_id, side, to_base64(unhex(string_agg(printf('%08x%016x%08x', coalesce(m, 0), coalesce(k, 0), coalesce(c, 0)), '' ORDER BY cell))) AS mark
  FROM places LEFT JOIN filled USING (doc_id, side, cell) GROUP BY doc_id, side)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, x.mark AS fingerprint, y.mark AS edited_fingerprint,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END AS near_edited,
  CASE WHEN len(a) + len(c) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, c))::DOUBLE / (len(a) + len(c) - len(list_intersect(a, c))) END AS near_next,
  CAST(len(a) AS BIGINT) AS n_paragraphs
FROM keyed JOIN marks x USING (doc_id) JOIN marks y USING (doc_id) WHERE x.side = 'a' AND y.side = 'b'
"""

ORACLE_SQL = {"op4_prefix_targets": _OP4, "op7_rendezvous": _OP7, "op12_paragraph_sketch": _OP12}
