"""Hybrid retrieval: BM25 over an inverted index, cosine top-k, keyword boosts and reciprocal rank fusion.

A corpus is a set of key columns; all statistics are per corpus. A search touches only postings of the questions'
terms: token arrays are cut down to those terms before anything is shuffled, and documents without any of them come
back only as far as ranks need them. Ranks are taken on scores of six digits, ties in a signal by the larger doc_idx,
after fusion by the smaller one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.session import materialised

K1, B = 1.5, 0.75
POOL, TOP, RRF_K, BOOST = 15, 3, 60, 2.0
#: Questions and their terms go to all tasks; beyond so many rows they are joined by a shuffle.
SMALL = 100_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df as a broadcast side if it has at most so many rows, else unchanged."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def postings(docs: DataFrame, corpus: list[str], doc: str = "doc_idx", text: str = "content") -> DataFrame:
    """corpus, doc, term, tf of every term."""
    return docs.select(*corpus, doc, F.explode(T.tokens(F.col(text))).alias("term")).groupBy(*corpus, doc, "term").agg(F.count("*").alias("tf"))


def doc_lengths(docs: DataFrame, corpus: list[str], doc: str = "doc_idx", text: str = "content") -> DataFrame:
    """corpus, doc, dl; a document without tokens has length 0 and counts."""
    return docs.select(*corpus, doc, F.size(T.tokens(F.col(text))).alias("dl"))


def corpus_stats(lengths: DataFrame, corpus: list[str]) -> DataFrame:
    """corpus, n, avgdl."""
    return lengths.groupBy(*corpus).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def term_idf(posts: DataFrame, stats: DataFrame, corpus: list[str]) -> DataFrame:
    """corpus, term, df, idf."""
    dfs = posts.groupBy(*corpus, "term").agg(F.count("*").alias("df"))
    return dfs.join(stats, corpus).select(*corpus, "term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def query_terms(questions: DataFrame, query: str = "query", qid: str = "question_id", weights: DataFrame | None = None) -> DataFrame:
    """qid, term, qtf (its occurrences in the query) and weight (1, or that of weights: qid, term, weight)."""
    terms = questions.select(qid, F.explode(T.tokens(F.col(query))).alias("term")).groupBy(qid, "term").agg(F.count("*").alias("qtf"))
    if weights is None:
        return terms.withColumn("weight", F.lit(1.0))
    return terms.join(weights, [qid, "term"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def _scores(posts: DataFrame, weighed: DataFrame, stats: DataFrame, terms: DataFrame, corpus: list[str], doc: str, qid: str, k1: float, b: float, weights: DataFrame | None) -> DataFrame:
    joined = posts.join(weighed, [*corpus, "term"]).join(stats, corpus)
    norm = F.when(F.col("avgdl") > 0, F.col("dl") / F.col("avgdl")).otherwise(F.lit(0.0))
    part = F.col("qtf") * F.col("weight") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * norm))
    asking = joined.join(small(terms), "term")
    if weights is not None:
        own = weights.select(qid, *corpus, "term", F.col("weight").alias("_own"))
        asking = asking.join(own, [qid, *corpus, "term"], "left").withColumn("weight", F.coalesce("_own", "weight"))
    return asking.groupBy(qid, *corpus, doc).agg(F.round(F.sum(part), 6).alias("score"))


def bm25(docs: DataFrame, terms: DataFrame, corpus: list[str], doc: str = "doc_idx", text: str = "content", qid: str = "question_id", k1: float = K1, b: float = B, weights: DataFrame | None = None) -> DataFrame:
    """qid, corpus, doc, score (rounded to 6 digits) of the documents with any of the question's terms.

    terms is what query_terms gives; weights (qid, corpus, term, weight) are those of one corpus. Texts are tokenised
    once, for one search: what is written of a document is its length and its tokens among the questions' terms. An
    Index serves many searches.
    """
    asked = small(terms.select("term").distinct())
    every = docs.select(*corpus, doc, T.tokens(F.col(text)).alias("toks"))
    # a row without a term keeps the document's length, so that one pass gives lengths and postings
    tokens = every.select(*corpus, doc, F.size("toks").alias("dl"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "toks")).alias("term"))
    kept = materialised(tokens.join(asked.withColumn("_asked", F.lit(True)), "term", "left").where("term is null or _asked").drop("_asked"))
    stats = kept.where("term is null").groupBy(*corpus).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    posts = kept.where("term is not null").groupBy(*corpus, doc, "dl", "term").agg(F.count("*").alias("tf"))
    return _scores(posts, term_idf(posts, stats, corpus), stats, terms, corpus, doc, qid, k1, b, weights)


class Index:
    """An inverted index, written once and searched as often as wanted: postings, lengths, document frequencies.

    Each part of the postings is sorted by term, so that a search reads the pages of its terms alone. Parts are appended
    (a stream's batches); figures that depend on all of them are taken when they are read.
    """

    def __init__(self, spark, path: str, corpus: list[str], doc: str = "doc_idx") -> None:  # type: ignore[no-untyped-def]
        self.spark, self.path, self.corpus, self.doc = spark, path, corpus, doc

    def add(self, docs: DataFrame, part: int = 0, text: str = "content") -> Index:
        """Writes the documents' lengths and postings as a part; a part written again replaces itself."""
        tokens = docs.select(*self.corpus, self.doc, T.tokens(F.col(text)).alias("toks")).select(*self.corpus, self.doc, F.size("toks").alias("dl"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "toks")).alias("term"))
        counted = tokens.groupBy(*self.corpus, "term", self.doc, "dl").agg(F.count("*").alias("tf"))
        counted.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{self.path}/batch={part}")
        return self

    @property
    def _all(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("batch")

    def postings(self) -> DataFrame:
        """corpus, doc, dl, term, tf."""
        return self._all.where("term is not null")

    def lengths(self) -> DataFrame:
        """corpus, doc, dl."""
        return self._all.where("term is null").select(*self.corpus, self.doc, "dl")

    def stats(self) -> DataFrame:
        """corpus, n, avgdl."""
        return corpus_stats(self.lengths(), self.corpus)

    def idf(self) -> DataFrame:
        """corpus, term, df, idf."""
        return term_idf(self.postings(), self.stats(), self.corpus)

    def bm25(self, terms: DataFrame, qid: str = "question_id", k1: float = K1, b: float = B, weights: DataFrame | None = None) -> DataFrame:
        """As bm25 gives it, from the postings of the questions' terms."""
        asked = terms.select("term").distinct()
        few = [r[0] for r in asked.limit(1001).collect()]
        posts = self.postings().where(F.col("term").isin(few)) if len(few) <= 1000 else self.postings().join(small(asked), "term", "left_semi")
        return _scores(posts, term_idf(posts, self.stats(), self.corpus), self.stats(), terms, self.corpus, self.doc, qid, k1, b, weights)


def ranked(scored: DataFrame, by: list[str], doc: str = "doc_idx", most: int = POOL) -> DataFrame:
    """The most best rows of each group with their rank from 1; ties to the larger doc."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc(doc))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def with_silent(scored: DataFrame, docs: DataFrame, questions: DataFrame, corpus: list[str], doc: str = "doc_idx", qid: str = "question_id", most: int = POOL) -> DataFrame:
    """scored with the documents of score 0 that can be among the most best: those of the largest doc in each corpus."""
    last = docs.select(*corpus, doc).withColumn("_r", F.row_number().over(Window.partitionBy(*corpus).orderBy(F.desc(doc)))).where(F.col("_r") <= most).drop("_r")
    silent = last.crossJoin(small(questions.select(qid).distinct())).withColumn("score", F.lit(0.0))
    return scored.unionByName(silent).groupBy(qid, *corpus, doc).agg(F.max("score").alias("score"))


def cosine_topk(vectors: DataFrame, queries: DataFrame, corpus: str, key: str = "vec_id", vector: str = "embedding", qkey: str = "query_id", k: int = POOL, block: int = 4096) -> DataFrame:
    """qkey, corpus, key, score: the k best vectors of the query's corpus for each query, by dot product.

    Queries are taken in blocks, each set against all vectors in one pass: a batch of vectors keeps its own k best for
    each query (a matrix product in a worker), and the k best of those remain. queries has qkey, corpus and vector.
    """
    spark = vectors.sparkSession
    kind, ckind, qkind = (x.dataType.simpleString() for x in (vectors.schema[key], vectors.schema[corpus], queries.schema[qkey]))
    schema = f"{qkey} {qkind}, {corpus} {ckind}, {key} {kind}, score double"
    # a query set is stated by its caller; its blocks come to the driver one at a time
    rows = queries.select(qkey, corpus, vector).where(F.col(vector).isNotNull()).toLocalIterator(prefetchPartitions=True)
    parts, buffer = [], []

    def flush() -> None:
        by: dict = {}
        for q, c, v in buffer:
            by.setdefault(c, []).append((q, v))
        sent = spark.sparkContext.broadcast({c: ([q for q, _ in x], np.array([v for _, v in x], dtype=np.float64).T) for c, x in by.items()})

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for c, group in pdf.groupby(corpus, dropna=False):
                    if c not in sent.value:
                        continue
                    ids, m = sent.value[c]
                    scores = np.round(np.stack(group[vector].to_numpy()).astype(np.float64) @ m, 6)
                    keys = group[key].to_numpy()
                    for j, q in enumerate(ids):
                        top = np.lexsort((-keys, -scores[:, j]))[:k]
                        yield pd.DataFrame({qkey: q, corpus: c, key: keys[top], "score": scores[top, j]})

        parts.append(vectors.select(key, corpus, vector).where(F.col(vector).isNotNull()).mapInPandas(best, schema))
        buffer.clear()

    for r in rows:
        buffer.append((r[0], r[1], r[2]))
        if len(buffer) == block:
            flush()
    if buffer or not parts:
        flush()
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ranked(out, [qkey, corpus], key, k)


def rrf(signals: list[DataFrame], by: list[str], doc: str = "doc_idx", k: int = TOP, rrf_k: int = RRF_K, threshold: float | None = None) -> DataFrame:
    """by, doc, score, rank: reciprocal rank fusion of signals with ranks from 1, in one shuffle."""
    union = None
    for s in signals:
        part = s.select(*by, doc, (F.lit(1.0) / (F.lit(rrf_k) + F.col("rank"))).alias("score"))
        union = part if union is None else union.unionByName(part)
    fused = union.groupBy(*by, doc).agg(F.round(F.sum("score"), 6).alias("score"))
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc(doc))
    out = fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.where(F.col("score") >= threshold) if threshold is not None else out


def keyword_weights(keywords: DataFrame, qid: str = "question_id", boost: float = BOOST, corpus: Sequence[str] = ()) -> DataFrame:
    """qid, corpus, term, weight of scored phrases (qid, corpus, phrase, kw_score): each of a phrase's words gets 1 + boost * score, at most."""
    words = keywords.select(qid, *corpus, F.explode(T.words_of(F.col("phrase"))).alias("term"), (F.lit(1.0) + F.lit(boost) * F.col("kw_score")).alias("w"))
    return words.groupBy(qid, *corpus, "term").agg(F.greatest(F.max("w"), F.lit(1.0)).alias("weight"))


def phrase_bonus(docs: DataFrame, keywords: DataFrame, corpus: list[str], doc: str = "doc_idx", text: str = "content", qid: str = "question_id", boost: float = BOOST) -> DataFrame:
    """qid, corpus, doc, bonus: boost * score of each phrase of several words that the text has verbatim.

    keywords are a few phrases a question, or a question and corpus; the check is a substring test, set against them as
    a broadcast side if they are few.
    """
    own = [c for c in corpus if c in keywords.columns]
    phrases = small(keywords.where(F.col("phrase").contains(" ")).select(qid, *own, "phrase", "kw_score"))
    low = docs.select(*corpus, doc, F.lower(text).alias("_low"))
    hit = (low.join(phrases, own) if own else low.crossJoin(phrases)).where(F.col("_low").contains(F.col("phrase")))
    return hit.groupBy(qid, *corpus, doc).agg(F.round(F.sum(F.lit(boost) * F.col("kw_score")), 6).alias("bonus"))


def extract_keywords(questions: DataFrame, idfs: DataFrame, corpus: list[str], qid: str = "question_id", query: str = "query", semantic: DataFrame | None = None, top_fraction: float = 0.1, largest: DataFrame | None = None) -> DataFrame:
    """qid, corpus, phrase, kw_score: the best candidates of each question in each corpus.

    score = 0.7 * semantic + 0.3 * mean idf / largest idf; a word that the corpus lacks counts 0. semantic gives qid,
    phrase, cosine; without it the semantic part is 0. At least one candidate is kept. largest gives corpus, max_idf
    where idfs lacks terms that no question has.
    """
    cands = questions.select(qid, F.posexplode(T.candidates(T.tokens(F.col(query)))).alias("ord", "phrase"))
    if largest is None:
        largest = idfs.groupBy(*corpus).agg(F.max("idf").alias("max_idf"))
    words = small(cands).select(qid, "ord", "phrase", F.explode(F.split("phrase", " ")).alias("term"), F.size(F.split("phrase", " ")).alias("n"))
    known = words.join(idfs.join(small(words.select("term").distinct()), "term", "left_semi"), "term").groupBy(qid, *corpus, "ord", "phrase", "n").agg(F.sum("idf").alias("s"))
    every = small(cands).crossJoin(largest)
    scored = every.join(known.select(qid, *corpus, "ord", "s", "n"), [qid, *corpus, "ord"], "left")
    scored = scored.withColumn("idf_part", F.when(F.col("max_idf") > 0, F.coalesce(F.col("s") / F.col("n"), F.lit(0.0)) / F.col("max_idf")).otherwise(F.lit(0.0)))
    if semantic is not None:
        scored = scored.join(semantic, [qid, "phrase"], "left")
    cosine = F.coalesce("cosine", F.lit(0.0)) if semantic is not None else F.lit(0.0)
    scored = scored.withColumn("kw_score", F.round(F.lit(0.7) * cosine + F.lit(0.3) * F.col("idf_part"), 6))
    w = Window.partitionBy(qid, *corpus)
    kept = scored.withColumn("n_keep", F.greatest(F.lit(1), F.floor(F.count("*").over(w) * top_fraction))).withColumn("r", F.row_number().over(w.orderBy(F.desc("kw_score"), F.desc("ord"))))
    return kept.where(F.col("r") <= F.col("n_keep")).select(qid, *corpus, "phrase", "kw_score")


def search_keywords(docs: DataFrame, questions: DataFrame, corpus: list[str], semantic: DataFrame, doc: str = "doc_idx", text: str = "content", order: str = "ord") -> DataFrame:
    """question_id, corpus, phrase, kw_score: the keywords last stated, score 1, else the ones extracted in each corpus."""
    asked = sticky_keywords(questions, order)
    stated = asked.where("sticky is not null").select("question_id", F.explode(F.array_distinct("sticky")).alias("phrase"), F.lit(1.0).alias("kw_score"))
    # a document is one row, so that its distinct tokens give df without its counts; of the terms only those of the
    # questions are kept, and the least df for the largest idf
    free = asked.where("sticky is null")
    terms = small(free.select(F.explode(T.tokens(F.col("query"))).alias("term")).distinct().withColumn("_asked", F.lit(True)))
    dfs = docs.select(*corpus, F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("term")).groupBy(*corpus, "term").agg(F.count("*").alias("df")).join(terms, "term", "left")
    kept = dfs.groupBy(*corpus).agg(F.min("df").alias("least"), F.collect_list(F.when(F.col("_asked"), F.struct("term", "df"))).alias("ts"))
    kept = materialised(docs.groupBy(*corpus).agg(F.count("*").alias("n")).join(kept, corpus, "left"))
    idfs = kept.select(*corpus, "n", F.explode("ts").alias("t")).select(*corpus, "t.term", "t.df", idf(F.col("n"), F.col("t.df")).alias("idf"))
    largest = kept.select(*corpus, F.coalesce(idf(F.col("n"), F.col("least")), F.lit(0.0)).alias("max_idf"))
    found = extract_keywords(free, idfs, corpus, semantic=semantic, largest=largest)
    return docs.select(*corpus).distinct().crossJoin(small(stated)).select(*found.columns).unionByName(found)


def sticky_keywords(questions: DataFrame, order: str = "ord", keywords: str = "keywords") -> DataFrame:
    """questions with the keywords last stated at or before each; null until any are."""
    stated = F.when(F.size(keywords) >= 1, F.col(keywords))
    return questions.withColumn("sticky", F.last(stated, ignorenulls=True).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def hybrid_search(docs: DataFrame, questions: DataFrame, corpus: list[str], doc_vectors: DataFrame, query_vectors: DataFrame, doc: str = "doc_idx", text: str = "content", keywords: DataFrame | None = None, k: int = TOP, pool: int = POOL, rrf_k: int = RRF_K, boost: float = BOOST, threshold: float | None = None, index: Index | None = None) -> DataFrame:
    """question_id, corpus, doc, score, rank: keyword-aware BM25 fused with cosine ranks.

    doc_vectors: corpus, doc, vector; query_vectors: question_id, vector; keywords: question_id, phrase, kw_score, with
    corpus if each has its own; index: of the same documents, if there is one. An empty corpus has no rows.
    """
    own = keywords is not None and set(corpus) <= set(keywords.columns)
    weights = keyword_weights(keywords, boost=boost, corpus=corpus if own else ()) if keywords is not None else None
    terms, mine = query_terms(questions, weights=None if own else weights), weights if own else None
    scored = index.bm25(terms, weights=mine) if index is not None else bm25(docs, terms, corpus, doc, text, weights=mine)
    if keywords is not None:
        extra = phrase_bonus(docs, keywords, corpus, doc, text, boost=boost)
        scored = scored.join(extra, ["question_id", *corpus, doc], "full").select("question_id", *corpus, doc, (F.coalesce("score", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0))).alias("score"))
    words = ranked(with_silent(scored, docs, questions, corpus, doc, most=pool), ["question_id", *corpus], doc, pool)
    vectors = doc_vectors.crossJoin(small(query_vectors.select("question_id", F.col("vector").alias("_q")))).select("question_id", *corpus, doc, F.round(T.dot(F.col("vector"), F.col("_q")), 6).alias("score"))
    near = ranked(vectors, ["question_id", *corpus], doc, pool)
    return rrf([words, near], ["question_id", *corpus], doc, k, rrf_k, threshold)
