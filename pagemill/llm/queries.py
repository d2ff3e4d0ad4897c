"""Registered queries of the subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import abuse, boilerplate, encoding, leakage, pairs, scanrepair, splitting
from pagemill.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.found_lines(table(spark, d, "docs"))


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.remove_lines(table(spark, d, "docs").select("doc_key", "issuer", "content")).select("doc_key", "content", "n_removed")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return scanrepair.found_noise(table(spark, d, "page_docs"))


def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scanrepair.Repair(table(spark, d, "page_docs")).paragraphs()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(table(spark, d, "docs"), table(spark, d, "split_profiles"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _p3(splitting.split(table(spark, d, "docs"), table(spark, d, "split_profiles")))


def p3_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of p3_pieces, with the ranges of every text of more than 4,096 code points spread over all workers."""
    return _p3(splitting.split(table(spark, d, "docs"), table(spark, d, "split_profiles"), range_chars=2048, spread_chars=4096))


def _p3(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_key", "piece_no", "n_pieces", "piece_start", "piece_end", "content", "metadata.page_num", "metadata.title", "metadata.profile")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.found_defects(table(spark, d, "run_states"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, d, "documents"))


def p6_tree(spark: SparkSession, d: str) -> DataFrame:
    """The ids of p6_ids, with every text of more than 300 code points by leaves and joins of all workers."""
    return encoding.encode_corpus(table(spark, d, "documents"), leaf_chars=300)


def _p7(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d).where("run_words >= 12").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents and items, found by a shared run or within the item's error budget."""
    return _p7(spark, d)


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that leaked: in how many documents, in how many as a whole, the longest shared run and the least distance."""
    whole = F.sum((F.col("leak") == "whole").cast("long"))
    return _p7(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"), whole.alias("as_a_whole"), F.max("run_words").alias("longest_run"), F.min("distance").alias("least_distance"))


def _p8_scores(spark: SparkSession, d: str, *more: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return abuse.score(documents, abuse.fit(documents, table(spark, d, "abuse_samples")), "doc_id", "text", *more)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _p8_scores(spark, d).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _p8_scores(spark, d).select("doc_id", F.round("score", 6).alias("score"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, found documents and their rate by source."""
    flagged = (F.col("score") >= abuse.THRESHOLD).cast("long")
    return _p8_scores(spark, d, "source").groupBy("source").agg(F.count("*").alias("documents"), F.sum(flagged).alias("found"), F.round(F.avg(flagged), 6).alias("rate"))


QUERIES = {"p1_found": p1_found, "p1_clean": p1_clean, "p2_found": p2_found, "p2_paragraphs": p2_paragraphs, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_ranges": p3_ranges, "p5_found": p5_found, "p6_ids": p6_ids, "p6_tree": p6_tree, "p7_found": p7_found, "p7_items": p7_items, "p7_leaks": p7_leaks, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}

_P3 = r"""
WITH p AS (SELECT d.doc_key, d.content, coalesce(s.size_unit, f.size_unit) AS u, coalesce(s.max_size, f.max_size) AS m
  FROM docs d LEFT JOIN split_profiles s ON s.profile = d.metadata.profile CROSS JOIN (SELECT * FROM split_profiles WHERE is_default) f)
SELECT doc_key FROM p WHERE content IS NOT NULL AND CASE u WHEN 'chars' THEN length(content) WHEN 'bytes' THEN strlen(content)
  ELSE len(regexp_extract_all(content, '[^ \t\r\n]+')) END > m
"""
_P7 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM dw)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
"""
_P1 = r"""
WITH l AS (SELECT doc_key, issuer, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line_no FROM docs WHERE content IS NOT NULL),
k AS (SELECT doc_key, issuer, line_no, regexp_replace(lower(line), '[^\p{L}]', '', 'g') AS k FROM l),
t AS (SELECT issuer, count(*) AS total FROM docs GROUP BY issuer),
x AS (SELECT k.issuer, k, count(DISTINCT doc_key) AS n FROM k JOIN t ON t.issuer IS NOT DISTINCT FROM k.issuer WHERE k <> '' GROUP BY ALL HAVING n >= 3 AND n * 100 >= 8 * any_value(total))
SELECT DISTINCT doc_key, line_no FROM k JOIN x ON x.issuer IS NOT DISTINCT FROM k.issuer AND abs(length(x.k) - length(k.k)) <= 2 AND levenshtein(x.k, k.k) <= 2 WHERE k.k <> ''
"""
SQL = {"p1_found": _P1, "p3_found": _P3, "p7_found": _P7}
