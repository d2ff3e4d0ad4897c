"""Retrieval queries. Corpora are the sources of documents (corpus = source) or the studies of docs (corpus = study_id)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import retrieval as R
from pagemill.session import materialised, shared_dir, spread, table
from pagemill.sources import readers


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("source", F.col("doc_id").alias("doc_idx"), F.col("text").alias("content")))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return R.postings(_documents(spark, d), ["source"])


def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return R.doc_lengths(_documents(spark, d), ["source"])


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.corpus_stats(doc_lengths(spark, d), ["source"]).select("source", "n", F.round("avgdl", 6).alias("avgdl"))


def doc_freq_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    out = R.term_idf(R.postings(docs, ["source"]), R.corpus_stats(R.doc_lengths(docs, ["source"]), ["source"]), ["source"])
    return out.select("source", "term", "df", F.round("idf", 6).alias("idf"))


def max_idf(spark: SparkSession, d: str) -> DataFrame:
    """Largest idf of every corpus, 1 for one without any term."""
    top = doc_freq_idf(spark, d).groupBy("source").agg(F.max("idf").alias("m"))
    return _documents(spark, d).select("source").distinct().join(top, "source", "left").select("source", F.coalesce("m", F.lit(1.0)).alias("max_idf"))


def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(_documents(spark, d), R.query_terms(table(spark, d, "questions")), ["source"])


def bm25_top3(spark: SparkSession, d: str) -> DataFrame:
    docs, questions = _documents(spark, d), table(spark, d, "questions")
    scored = R.with_silent(R.bm25(docs, R.query_terms(questions), ["source"]), docs, questions, ["source"], most=R.TOP)
    return R.ranked(scored, ["question_id", "source"], most=R.TOP)


def _stated(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", F.explode("keywords").alias("phrase")).distinct().withColumn("kw_score", F.lit(1.0))


def bm25_weighted(spark: SparkSession, d: str) -> DataFrame:
    """BM25 where a question's own keywords weigh 1 + 2 * score."""
    questions = table(spark, d, "questions")
    return R.bm25(_documents(spark, d), R.query_terms(questions, weights=R.keyword_weights(_stated(questions))), ["source"])


def indexed_top3(spark: SparkSession, d: str) -> DataFrame:
    """BM25 top 3 of the questions' terms, plain and with their keywords' weights, from one written index."""
    index = R.Index(spark, f"{shared_dir(spark).rstrip('/')}/pagemill-index-{uuid.uuid4().hex}", ["source"]).add(_documents(spark, d))
    questions = table(spark, d, "questions")
    kinds = {"plain": None, "weighted": R.keyword_weights(_stated(questions))}
    found = [R.ranked(index.bm25(R.query_terms(questions, weights=w)), ["question_id", "source"], most=R.TOP).withColumn("kind", F.lit(k)) for k, w in kinds.items()]
    return found[0].unionByName(found[1])


def ngram_candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "questions").select("question_id", F.posexplode(T.candidates(T.tokens(F.col("query")))).alias("ord", "phrase"))


def keyword_idf_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    idfs = R.term_idf(R.postings(docs, ["source"]), R.corpus_stats(R.doc_lengths(docs, ["source"]), ["source"]), ["source"])
    return R.extract_keywords(table(spark, d, "questions"), idfs, ["source"])


def phrase_bonus(spark: SparkSession, d: str) -> DataFrame:
    """Bonus of the questions' two-word candidates that a document has verbatim, each of score 1."""
    phrases = ngram_candidates(spark, d).select("question_id", "phrase").where(F.col("phrase").contains(" ")).withColumn("kw_score", F.lit(1.0))
    return R.phrase_bonus(_documents(spark, d), phrases, ["source"])


def sticky_keywords(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "questions").withColumn("ord", F.regexp_extract("question_id", r"(\d+)", 1).cast("int"))
    return R.sticky_keywords(q).select("question_id", F.array_join("sticky", ",").alias("sticky"))


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label", "embedding")


def cosine_top15(spark: SparkSession, d: str) -> DataFrame:
    """For every vector whose id is divisible by 50, the 15 nearest vectors of its label (its corpus)."""
    return R.cosine_topk(table(spark, d, "embeddings"), _vector_queries(spark, d), "label")


def rrf_fusion_top3(spark: SparkSession, d: str) -> DataFrame:
    """BM25 and cosine ranks fused, as the SQL states: no keywords, vectors only where document n has vector n; hybrid_top3 has all."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("vector"))
    docs = _documents(spark, d)
    doc_vectors = docs.select("source", "doc_idx").join(vectors, F.col("doc_idx") == F.col("vec_id")).select("source", "doc_idx", "vector")
    questions = table(spark, d, "questions").withColumn("n", F.regexp_extract("question_id", r"(\d+)", 1).cast("long"))
    query_vectors = questions.join(vectors, F.col("n") == F.col("vec_id")).select("question_id", "vector")
    return R.hybrid_search(docs, questions, ["source"], doc_vectors, query_vectors)


def full_search(docs: DataFrame, questions: DataFrame, corpus: list[str]) -> DataFrame:
    """Hybrid top 3 with every signal: keywords (stated or extracted), phrase bonus, and a vector of every text by the embedder."""
    asked = questions.withColumn("ord", F.regexp_extract("question_id", r"(\d+)", 1).cast("int"))
    query_vectors = readers.embed(questions.select("question_id", "query"), "query").select("question_id", "vector")
    phrases = questions.select("question_id", F.explode(T.candidates(T.tokens(F.col("query")))).alias("phrase"))
    near = readers.embed(phrases, "phrase", "_v").join(query_vectors, "question_id")
    semantic = materialised(near.select("question_id", "phrase", T.dot(F.col("_v"), F.col("vector")).alias("cosine")))
    keywords = materialised(R.search_keywords(docs, asked, corpus, semantic))
    doc_vectors = readers.embed(docs.select(*corpus, "doc_idx", "content"), "content").select(*corpus, "doc_idx", "vector")
    return R.hybrid_search(docs, questions, corpus, doc_vectors, query_vectors, keywords=keywords)


def hybrid_top3(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid top 3 of every question in every source with all signals, for all documents."""
    return full_search(_documents(spark, d), table(spark, d, "questions"), ["source"])


def score_threshold(spark: SparkSession, d: str) -> DataFrame:
    """The fused hits of at least 0.02."""
    return rrf_fusion_top3(spark, d).where(F.col("score") >= 0.02)


QUERIES = {f.__name__: f for f in (token_counts, doc_lengths, corpus_stats, doc_freq_idf, max_idf, bm25_scores, bm25_top3, bm25_weighted, indexed_top3, ngram_candidates, keyword_idf_scores, phrase_bonus, sticky_keywords, cosine_top15, rrf_fusion_top3, hybrid_top3, score_threshold)}

# ---------------------------------------------------------------------------------------------- SQL

_TOKENS = r"regexp_extract_all(regexp_replace(lower({0}), '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{M}}\p{{C}}]', '_', 'g'), '\b(?:[A-Za-z]+(?:/[A-Za-z]+)?|[0-9]+(?:\.[0-9]+)?%?)\b|%')"
_STOP = "(" + ",".join(f"'{w}'" for w in T.STOPWORDS) + ")"
_BASE = f"""
d AS (SELECT source, doc_id AS doc_idx, coalesce({_TOKENS.format('text')}, []) AS toks, text AS content FROM documents),
dl AS (SELECT source, doc_idx, len(toks) AS dl FROM d),
st AS (SELECT source, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY source),
tf AS (SELECT source, doc_idx, term, count(*) AS tf FROM (SELECT source, doc_idx, unnest(toks) AS term FROM d) GROUP BY ALL),
df AS (SELECT source, term, count(*) AS df FROM tf GROUP BY ALL),
idf AS (SELECT source, term, df, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) AS idf FROM df JOIN st USING (source)),
q AS (SELECT question_id, term, count(*) AS qtf FROM (SELECT question_id, unnest({_TOKENS.format('query')}) AS term FROM questions) GROUP BY ALL)
"""


def _bm25(weight: str = "1.0::DOUBLE", join: str = "") -> str:
    return f"""SELECT question_id, source, doc_idx, round(sum(qtf * {weight} * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * CASE WHEN avgdl > 0 THEN dl / avgdl ELSE 0 END))), 6) AS score
FROM q {join} JOIN tf USING (term) JOIN idf USING (source, term) JOIN dl USING (source, doc_idx) JOIN st USING (source) GROUP BY ALL"""


_CANDS = f"""c0 AS (SELECT question_id, {_TOKENS.format('query')} AS t FROM questions),
c1 AS (SELECT question_id, t, [array_to_string(t[i : i + n - 1], ' ') FOR n IN [1, 2] FOR i IN range(1, 1)] AS x FROM c0),
g AS (SELECT question_id, 1 AS n, i, t[i] AS phrase FROM (SELECT question_id, t, unnest(range(1, len(t) + 1)) AS i FROM c0)
  UNION ALL SELECT question_id, 2, i, t[i] || ' ' || t[i + 1] FROM (SELECT question_id, t, unnest(range(1, len(t))) AS i FROM c0)),
f AS (SELECT question_id, phrase, min(n * 100000 + i) AS o FROM g WHERE split_part(phrase, ' ', 1) NOT IN {_STOP} AND split_part(phrase, ' ', -1) NOT IN {_STOP} GROUP BY ALL),
cand AS (SELECT question_id, (row_number() OVER (PARTITION BY question_id ORDER BY o) - 1)::INT AS ord, phrase FROM f)""".replace("c1 AS (SELECT question_id, t, [array_to_string(t[i : i + n - 1], ' ') FOR n IN [1, 2] FOR i IN range(1, 1)] AS x FROM c0),\n", "")

_ALL_SCORED = f"""b AS ({_bm25()}),
s AS (SELECT qq.question_id, dl.source, dl.doc_idx, coalesce(b.score, 0.0::DOUBLE) AS score FROM (SELECT question_id FROM questions) qq CROSS JOIN dl LEFT JOIN b ON b.question_id = qq.question_id AND b.doc_idx = dl.doc_idx AND b.source = dl.source)"""

_RRF = f"""WITH {_BASE}, {_ALL_SCORED},
w AS (SELECT question_id, source, doc_idx, row_number() OVER (PARTITION BY question_id, source ORDER BY score DESC, doc_idx DESC) AS r FROM s QUALIFY r <= 15),
v AS (SELECT questions.question_id, dl.source, dl.doc_idx, round(list_dot_product(e.embedding::DOUBLE[], f.embedding::DOUBLE[]), 6) AS c FROM questions
  JOIN embeddings f ON f.vec_id = regexp_extract(question_id, '([0-9]+)', 1)::BIGINT CROSS JOIN dl JOIN embeddings e ON e.vec_id = dl.doc_idx),
n AS (SELECT question_id, source, doc_idx, row_number() OVER (PARTITION BY question_id, source ORDER BY c DESC, doc_idx DESC) AS r FROM v QUALIFY r <= 15),
u AS (SELECT question_id, source, doc_idx, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM (SELECT * FROM w UNION ALL SELECT * FROM n) GROUP BY ALL),
o AS (SELECT *, (row_number() OVER (PARTITION BY question_id, source ORDER BY score DESC, doc_idx))::INT AS rank FROM u)
SELECT question_id, source, doc_idx, score, rank FROM o WHERE rank <= 3"""

SQL = {
    "token_counts": f"WITH {_BASE} SELECT source, doc_idx, term, tf FROM tf",
    "doc_lengths": f"WITH {_BASE} SELECT source, doc_idx, dl::INT AS dl FROM dl",
    "corpus_stats": f"WITH {_BASE} SELECT source, n, round(avgdl, 6) AS avgdl FROM st",
    "doc_freq_idf": f"WITH {_BASE} SELECT source, term, df, round(idf, 6) AS idf FROM idf",
    "max_idf": f"WITH {_BASE} SELECT st.source, coalesce(round(max(idf), 6), 1.0::DOUBLE) AS max_idf FROM st LEFT JOIN idf USING (source) GROUP BY ALL",
    "bm25_scores": f"WITH {_BASE} {_bm25()}",
    "bm25_top3": f"WITH {_BASE}, {_ALL_SCORED}, o AS (SELECT *, (row_number() OVER (PARTITION BY question_id, source ORDER BY score DESC, doc_idx DESC))::INT AS rank FROM s) SELECT question_id, source, doc_idx, score, rank FROM o WHERE rank <= 3",
    "bm25_weighted": f"WITH {_BASE}, kw AS (SELECT DISTINCT question_id, unnest(regexp_split_to_array(k, '\\s+')) AS term FROM (SELECT question_id, unnest(keywords) AS k FROM questions)) {_bm25('CASE WHEN kw.term IS NULL THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END', 'LEFT JOIN kw USING (question_id, term)')}",
    "ngram_candidates": f"WITH {_CANDS} SELECT question_id, ord, phrase FROM cand",
    "keyword_idf_scores": f"""WITH {_BASE}, {_CANDS}, mx AS (SELECT source, max(idf) AS m FROM idf GROUP BY source),
p AS (SELECT question_id, ord, phrase, unnest(string_split(phrase, ' ')) AS term, len(string_split(phrase, ' ')) AS k FROM cand),
k AS (SELECT p.question_id, mx.source, p.ord, p.phrase, round(0.3::DOUBLE * (sum(coalesce(idf.idf, 0.0::DOUBLE)) / any_value(k) / any_value(m)), 6) AS kw_score FROM p CROSS JOIN mx LEFT JOIN idf ON idf.source = mx.source AND idf.term = p.term GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id, source ORDER BY kw_score DESC, ord DESC) AS r, greatest(1, floor(count(*) OVER (PARTITION BY question_id, source) * 0.1::DOUBLE)) AS keep FROM k)
SELECT question_id, source, phrase, kw_score FROM r WHERE r <= keep""",
    "phrase_bonus": f"WITH {_BASE}, {_CANDS} SELECT question_id, source, doc_idx, round(count(*) * 2.0::DOUBLE, 6) AS bonus FROM (SELECT question_id, phrase FROM cand WHERE contains(phrase, ' ')) JOIN d ON contains(lower(content), phrase) GROUP BY ALL",
    "sticky_keywords": "SELECT question_id, array_to_string(last_value(CASE WHEN len(keywords) >= 1 THEN keywords END IGNORE NULLS) OVER (ORDER BY regexp_extract(question_id, '([0-9]+)', 1)::INT ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ',') AS sticky FROM questions",
    "cosine_top15": "WITH s AS (SELECT q.vec_id AS query_id, q.label, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings e ON e.label = q.label WHERE q.vec_id % 50 = 0), o AS (SELECT *, (row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id DESC))::INT AS rank FROM s) SELECT * FROM o WHERE rank <= 15",
    "rrf_fusion_top3": _RRF,
    "score_threshold": _RRF + " AND score >= 0.02",
}
_KW = "kw AS (SELECT DISTINCT question_id, unnest(regexp_split_to_array(k, '\\s+')) AS term FROM (SELECT question_id, unnest(keywords) AS k FROM questions))"
_BOOSTED = _bm25("CASE WHEN kw.term IS NULL THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END", "LEFT JOIN kw USING (question_id, term)")
SQL["indexed_top3"] = f"WITH {_BASE}, {_KW}, x AS (SELECT 'plain' AS kind, * FROM ({_bm25()}) UNION ALL SELECT 'weighted', * FROM ({_BOOSTED})), o AS (SELECT *, (row_number() OVER (PARTITION BY kind, question_id, source ORDER BY score DESC, doc_idx DESC))::INT AS rank FROM x) FROM o WHERE rank <= 3"
