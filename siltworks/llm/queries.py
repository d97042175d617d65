"""The queries of this package: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import decontam, jaccard, licenses, linededup, media, merkle, mixing, negatives, pii, quality, sharding, simhash, toxicity
from siltworks.llm.common import table

#: Target token shares of op9; values that aren't named share the rest.
TARGETS = {"lang": {"en": 0.57, "de": 0.16, "fr": 0.15, "es": 0.12}, "topic": {"prose": 0.85}}


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_column(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).drop("kept")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).drop("found")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), TARGETS).drop("text", "n_chars")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = merkle.manifest(docs, extra={"changed": merkle.tampered(docs)})
    return merkle.verified(rows, "changed").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", shifted), F.col("id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_quality, op2_media, op3_toxicity, op4_linededup, op5_simhash, op6_pii, op7_decontamination, op8_licenses, op9_mixing, op10_sharding, op11_merkle, op12_jaccard, op13_negatives)}

_FIELD = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in merkle.HASHED) + ")"
#: CRC-32 of a text of ASCII characters.
_CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))))"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(regexp_split_to_array(" + _LOWER + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

#: DuckDB SQL for the same rows.
ORACLE_SQL = {
    "op4_linededup": rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no
  FROM documents),
keyed AS (SELECT doc_id, line_no, line, {_LOWER.format("regexp_replace(line, '^[ " + r"\x09-\x0D]+|[ \x09-\x0D]+$', '', 'g')")} AS key FROM lines),
repeated AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM keyed k LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op7_decontamination": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i + 1:i + least(len(w), 10)], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM wins),
spots AS (
  SELECT doc_id, size, i, array_to_string(w[i + 1:i + size], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS i FROM docs, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, s.size, i, item_id FROM spots s JOIN wins USING (size, gram)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op11_merkle": f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS g, {_LEAF} AS leaf,
         CASE WHEN crc32_of % 7 = 0 THEN {_LEAF.replace("(n_chars ", "(n_chars + 1 ")} ELSE {_LEAF} END AS changed
  FROM (SELECT *, {_CRC32.format("CAST(doc_id AS VARCHAR)")} AS crc32_of FROM documents)),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM rows),
up AS (
  SELECT g, 0 AS level, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT g, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY g, level, pos // 2, n),
subroots AS (SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n, max(level) OVER (PARTITION BY g) AS height FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, n, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
steps AS (
  SELECT p.doc_id, p.leaf, u.level, (p.pos >> u.level) % 2 = 1 AS on_left, s.h
  FROM placed p JOIN (SELECT DISTINCT g, level FROM up WHERE n > 1) u USING (g)
  LEFT JOIN up s ON s.g = p.g AND s.level = u.level AND s.pos = xor(p.pos >> u.level, 1)
  UNION ALL
  SELECT p.doc_id, p.leaf, r.height + t.level, (r.pos >> t.level) % 2 = 1, s.h
  FROM placed p JOIN subroots r USING (g) CROSS JOIN (SELECT DISTINCT level FROM top WHERE n > 1) t
  LEFT JOIN top s ON s.level = t.level AND s.pos = xor(r.pos >> t.level, 1)),
proofs AS (SELECT doc_id, leaf, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY doc_id, leaf),
fold AS (
  SELECT doc_id, leaf, 0 AS level, changed AS h FROM placed
  UNION ALL
  SELECT f.doc_id, f.leaf, f.level + 1, sha256(CASE WHEN s.on_left THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END)
  FROM fold f JOIN steps s ON s.doc_id = f.doc_id AND s.leaf = f.leaf AND s.level = f.level),
ends AS (SELECT doc_id, leaf, arg_max(h, level) AS folded_root FROM fold GROUP BY doc_id, leaf)
SELECT p.doc_id, p.leaf, r.h AS subroot, t.h AS root, coalesce(o.proof_sha256, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = t.h AS verified
FROM placed p JOIN subroots r USING (g) JOIN top t ON t.n = 1 JOIN ends e USING (doc_id, leaf) LEFT JOIN proofs o USING (doc_id, leaf)""",
    "op12_jaccard": rf"""
WITH RECURSIVE docs AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + least(len(w), 5)], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - least(len(w), 5) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b WHERE 100 * s.n >= 80 * (x.n + y.n - s.n)),
reach AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id""",
    "op13_negatives": """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM usable a, usable b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
negatives AS (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS rank, other_id AS negative_id, positive_score, score AS negative_score
  FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10""",
}
