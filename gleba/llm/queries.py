"""Queries of the operators of this package."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleba.llm.addresses import planted as planted_addresses, same_addresses
from gleba.llm.leakage import leaks
from gleba.llm.matching import planted as planted_plots, same_plots
from gleba.llm.pieces import pieces
from gleba.llm.pii import personal_finds, pseudonymised
from gleba.llm.streets import mapped_streets
from gleba.llm.tokens import VOCABULARY, encoded
from gleba.llm.truth import best_rows, planted as planted_truths, survivors
from gleba.operators.units import rate_map
from gleba.session import table



def pseudonym_key(spark: SparkSession) -> str:
    """The key of the pseudonyms: GLEBA_PSEUDONYM_KEY or the setting gleba.pseudonym.key, else one drawn for this process, so that there is no key that anyone knows."""
    return os.environ.get("GLEBA_PSEUDONYM_KEY") or spark.conf.get("gleba.pseudonym.key", None) or _DRAWN


_DRAWN = secrets.token_hex(32)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_rows(table(spark, sf_dir, "feed_items")).select(F.col("entity").alias("source_id"), "field", "record_id")


def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(table(spark, sf_dir, "feed_items")).withColumn("phones", F.array_join("phones", ", "))


def p1_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted_truths(table(spark, sf_dir, "feed_items"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed, listings = table(spark, sf_dir, "feed_items"), table(spark, sf_dir, "site_listings")
    return same_plots(feed, listings, table(spark, sf_dir, "streets"), rate_map(table(spark, sf_dir, "unit_rates"))).select("record_id", "listing_id")


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed, listings = table(spark, sf_dir, "feed_items"), table(spark, sf_dir, "site_listings")
    pairs = same_plots(feed, listings, table(spark, sf_dir, "streets"), rate_map(table(spark, sf_dir, "unit_rates")))
    return pairs.withColumn("confidence", F.round("confidence", 4))


def p3_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted_plots(table(spark, sf_dir, "site_listings"), table(spark, sf_dir, "streets"), rate_map(table(spark, sf_dir, "unit_rates")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_finds(table(spark, sf_dir, "feed_items"))


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "feed_items"), pseudonym_key(spark)).withColumn("phones", F.array_join("phones", ", "))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_addresses(table(spark, sf_dir, "needs_check"), table(spark, sf_dir, "streets")).select("check_id_a", "check_id_b")


def p6_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted_addresses(table(spark, sf_dir, "needs_check"), table(spark, sf_dir, "streets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped_streets(table(spark, sf_dir, "feed_items"), table(spark, sf_dir, "streets"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), path=VOCABULARY)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents"), path=VOCABULARY).where("piece_no = 1").select("doc_id")


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents"), path=VOCABULARY, oversized=False)


QUERIES = {f.__name__: f for f in (p1_found, p1_survivors, p1_planted, p3_found, p3_pairs, p3_planted, p5_found, p5_redacted, p6_found, p6_planted, p7_found, p8_ids, p9_found, p10_found, p10_pieces)}

SQL: dict[str, str] = {
    "p1_found": r"""
WITH f AS (
  SELECT regexp_extract(url, '(?i)/item/(\d+)', 1) AS k, record_id, seen_at, description, phones, size_m2, price FROM feed_items),
g AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM f WHERE k <> ''),
t AS (
  SELECT *, trim(regexp_replace(trim(regexp_replace(description, '\s+', ' ', 'g')), '(?i)\s*(…|\.\.\.)?\s*(\(lees meer\)|see more|lees meer|meer weergeven|read more)$|\s*(…|\.\.\.)$', '')) AS d,
    regexp_replace(lower(description), '[^a-zà-ÿ]+', '', 'g') AS l
  FROM g WHERE n > 1),
u AS (SELECT *, length(l) > 2 AND l NOT IN ('nvt', 'geen', 'geenomschrijving', 'ziefotos', 'ziefoto', 'xxx', 'none', 'null', 'test') AS says FROM t),
dd AS (SELECT DISTINCT k, d FROM u WHERE says),
cut AS (SELECT DISTINCT a.k, a.d FROM dd a JOIN dd b ON a.k = b.k AND a.d <> b.d AND starts_with(b.d, a.d)),
c AS (
  SELECT k, 'description' AS field, seen_at, record_id FROM u WHERE says AND (k, d) NOT IN (SELECT (k, d) FROM cut)
  UNION ALL SELECT k, 'phones', seen_at, record_id FROM u WHERE len(list_filter(phones, lambda p: length(regexp_replace(p, '\D', '', 'g')) >= 6 AND NOT regexp_full_match(regexp_replace(regexp_replace(p, '[\s\-./()]+', '', 'g'), '^.*?(\+|00)597', ''), '0+'))) > 0
  UNION ALL SELECT k, 'size_m2', seen_at, record_id FROM u WHERE NOT isnan(size_m2) AND size_m2 BETWEEN 10 AND 1e7
  UNION ALL SELECT k, 'price', seen_at, record_id FROM u WHERE NOT isnan(price) AND price BETWEEN 1000 AND 1e7 AND CAST(CAST(price AS BIGINT) AS VARCHAR) NOT IN ('1234', '12345', '123456', '1234567'))
SELECT k AS source_id, field, arg_min(record_id, (-epoch_us(seen_at), record_id)) AS record_id FROM c GROUP BY k, field
""",
}

SQL["p1_survivors"] = f"""
WITH b AS ({SQL["p1_found"]})
SELECT source_id AS entity, max(description) FILTER (WHERE field = 'description') AS description, max(array_to_string(list_filter(phones, lambda p: p IS NOT NULL), ', ')) FILTER (WHERE field = 'phones') AS phones,
  max(size_m2) FILTER (WHERE field = 'size_m2') AS size_m2, max(price) FILTER (WHERE field = 'price') AS price
FROM b JOIN feed_items USING (record_id) GROUP BY 1"""
