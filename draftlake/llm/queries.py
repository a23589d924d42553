"""The registered queries of this subpackage: thin callers of the operators, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.llm import bpe, fim, kneser_ney, lines, mixing, mpegts, pq, prefix_trie, shuffle, simhash, substrings, token_files, warc
from draftlake.llm.common import stored, utf8_size


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mixing.schedule(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "source", "n_tokens", "epoch", "weight_ppm", "block", "slot")


def op2_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    shards = shuffle.read_shards(spark, shuffle.write_shards(docs), docs.schema)
    text = F.coalesce("text", F.lit(""))
    return shards.select("doc_id", (utf8_size(F.col("text")) + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(mpegts.store_media(_table(spark, sf_dir, "documents").select("doc_id", "text")), "media")
    read = mpegts.read_media(media, drop_payload=True)
    n = F.col("units").cast("string")
    feature = F.concat_ws(
        ";", F.concat(F.lit("programs="), "programs"), F.concat(F.lit("pid="), "stream_pid"), F.concat(F.lit("packets="), "packets"), F.concat(F.lit("units="), n),
        F.concat(F.lit("errors="), F.col("sync_errors") + F.col("continuity_errors")), F.concat(F.lit("pts="), F.array_min("pts"), F.lit("-"), F.array_max("pts")),
        F.concat(F.lit("rap="), F.concat_ws(",", F.transform("rap_bytes", lambda x: x.cast("string")))),
    )
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op4_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_archive(spark, warc.write_archive(_table(spark, sf_dir, "pages")))
    damaged = F.raise_error(F.concat(F.lit("damaged or missing payload of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))).cast("string")
    return read.select("page_id", "payload_bytes", F.when(F.col("verified"), F.col("payload_digest")).otherwise(damaged).alias("payload_digest"), "record_type", "refers_to")


def op6_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, path = token_files.write_tokens(_table(spark, sf_dir, "documents"), bpe.vocabulary_path("word_bpe_49k.json"))
    return token_files.read_tokens(manifest, path, with_ids=False)


def op9_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_bloom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(_table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_temperature_mixing, op2_external_shuffle, op3_transport_stream, op4_suffix_automaton, op5_warc_archive, op6_prefix_bpe, op7_simhash_bktree, op8_token_files, op9_product_quantisation, op10_kneser_ney, op11_bloom_lines, op12_fill_in_middle, op13_prefix_trie)}

ORACLE_SQL = {
    "op1_temperature_mixing": """
WITH RECURSIVE tokens AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) + 1 AS BIGINT) AS n_tokens, coalesce(CAST(doc_id AS VARCHAR), concat('t', md5(coalesce(text, '')))) AS ident FROM documents),
sources AS (SELECT source, count(*) AS n, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM tokens GROUP BY source),
shares AS (SELECT *, CAST(tokens AS DOUBLE) / CAST((SELECT sum(tokens) FROM sources) AS DOUBLE) AS p FROM sources),
steps AS (
  SELECT 0 AS i, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN low ELSE (low + high) / 2 END, CASE WHEN ok THEN (low + high) / 2 ELSE high END
  FROM (SELECT i, low, high, (SELECT ln(sum(pow(p, (low + high) / 2))) - (low + high) / 2 * sum(pow(p, (low + high) / 2) * ln(p)) / sum(pow(p, (low + high) / 2)) <= 0.95 * ln(count(*))
      AND max(pow(p, (low + high) / 2 - 1)) / min(pow(p, (low + high) / 2 - 1)) <= 4.0 FROM shares) AS ok
    FROM steps) s WHERE i < 30),
exponent AS (SELECT CASE WHEN (SELECT count(*) FROM shares) < 2 THEN 1.0 ELSE round(high, 6) END AS x FROM steps WHERE i = 30),
weights AS (SELECT s.*, CAST(greatest(1, round(pow(p, x) / (SELECT sum(pow(p, x)) FROM shares, exponent) * 1000000)) AS BIGINT) AS weight_ppm FROM shares s, exponent),
plan AS (
  SELECT w.*, target // tokens AS full_epochs, target - (target // tokens) * tokens AS rest, greatest(1, CAST(weight_ppm AS BIGINT) * 65536 // 1000000) AS block_share
  FROM (SELECT *, CAST(CAST(weight_ppm AS HUGEINT) * (SELECT max((CAST(tokens AS HUGEINT) * 1000000 + weight_ppm - 1) // weight_ppm) FROM weights) // 1000000 AS BIGINT) AS target FROM weights) w),
used AS (
  SELECT t.doc_id, t.source, t.n_tokens, e.epoch, p.full_epochs, p.rest, p.tokens, p.block_share, p.weight_ppm, md5(concat('7:', e.epoch, ':', t.ident)) AS k
  FROM tokens t JOIN plan p ON t.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(0, p.full_epochs + 1)) AS epoch) e),
placed AS (
  SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY k) AS BIGINT) - CAST(sum(n_tokens) OVER (PARTITION BY source, epoch, k) AS BIGINT) AS start FROM used),
blocks AS (SELECT *, (epoch * tokens + start) // block_share AS block FROM placed WHERE epoch < full_epochs OR start < rest)
SELECT doc_id, source, n_tokens, epoch, weight_ppm, block, row_number() OVER (PARTITION BY block ORDER BY reverse(k), doc_id, n_tokens) - 1 AS slot FROM blocks""",
    "op5_warc_archive": """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f""",
    "op11_bloom_lines": """
WITH l AS (
  SELECT doc_id, i, x, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
r AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, r.k IS NOT NULL AND l.doc_id <> r.keeper AS gone FROM l LEFT JOIN r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op12_fill_in_middle": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS x FROM documents),
h AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3,
    CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:lo], '') AS a, array_to_string(u[lo + 1:hi], '') AS b, array_to_string(u[hi + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || b ELSE '<S>' || s || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256
FROM p""",
    "op13_prefix_trie": """
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS i, id, chars
  FROM (SELECT conv_id, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS id, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base,
    (list_reduce(list_concat([CAST(4294967295 AS BIGINT)], CAST(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) + 256 AS BIGINT), 0, 0, 0, 0, 0, 0, 0])) AS BIGINT[])),
      lambda crc, b: CASE WHEN b > 0 THEN CASE WHEN xor(crc, b - 256) & 1 = 1 THEN xor(xor(crc, b - 256) >> 1, 3988292384) ELSE xor(crc, b - 256) >> 1 END
        ELSE CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END END)) AS crc FROM own),
heads AS (SELECT conv_id, base, xor(crc, 4294967295) % 6 AS h FROM convs),
joined AS (
  SELECT h.conv_id, 0 AS part, o.i, o.id, o.chars FROM heads h JOIN own o ON o.conv_id = h.base AND o.i <= h.h
  UNION ALL SELECT h.conv_id, 1, o.i, o.id, o.chars FROM heads h JOIN own o ON o.conv_id = h.conv_id AND o.i > h.h),
seq AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d, id, chars FROM joined),
members AS (
  SELECT conv_id, d, md5(string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k, chars FROM seq
  UNION ALL SELECT conv_id, 0, '', 0 FROM heads),
sizes AS (SELECT conv_id, max(d) AS size FROM members GROUP BY conv_id),
nodes AS (
  SELECT d, k, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (WHERE s.size = d), '') AS ends
  FROM members m JOIN sizes s ON m.conv_id = s.conv_id GROUP BY d, k),
up AS (SELECT n.*, m.k AS pk FROM nodes n LEFT JOIN members m ON m.conv_id = n.conv_id AND m.d = n.d - 1),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM up WHERE pk IS NOT NULL GROUP BY ALL),
sub AS (
  SELECT m.d, m.k, sum((u.n_convs - 1) * u.chars) AS saved_tokens, count(*) FILTER (WHERE c.n_children IS NULL) AS n_leaves
  FROM nodes u LEFT JOIN kids c ON c.d = u.d AND c.k = u.k JOIN members m ON m.conv_id = u.conv_id AND m.d <= u.d GROUP BY ALL)
SELECT u.conv_id, CAST(u.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, u.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(u.ends) AS ends_sha256
FROM up u LEFT JOIN nodes p ON p.d = u.d - 1 AND p.k = u.pk LEFT JOIN kids c ON c.d = u.d AND c.k = u.k JOIN sub s ON s.d = u.d AND s.k = u.k""",
}
