import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from pagemill.operators import retrieval as R


def model(docs, query, k1=1.5, b=0.75):
    """BM25 of one corpus, written from its definition."""
    toks = {k: re.findall(r"[a-z]+", t) for k, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for ts in toks.values() for w in set(ts))
    out = {}
    for k, ts in toks.items():
        tf = Counter(ts)
        s = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(ts) / avg)) for w in query.split() if tf[w])
        if any(tf[w] for w in query.split()):
            out[k] = round(s, 6)
    return out


def test_bm25_against_the_definition(spark):
    rng = random.Random(1)
    words = ["ab", "cd", "ef", "gh", "ij", "kl"]
    docs = {i: " ".join(rng.choices(words, k=rng.randint(0, 12))) for i in range(40)}
    rows = [("c1" if i < 25 else None, i, t) for i, t in docs.items()]
    df = spark.createDataFrame([(c or "c2", i, t) for c, i, t in rows], "corpus string, doc_idx int, content string")
    q = spark.createDataFrame([("q", "ab cd ab")], "question_id string, query string")
    got = {(r["corpus"], r["doc_idx"]): r["score"] for r in R.bm25(df, R.query_terms(q), ["corpus"]).collect()}
    want = {("c1", k): v for k, v in model({i: t for i, t in docs.items() if i < 25}, "ab cd ab").items()} | {("c2", k): v for k, v in model({i: t for i, t in docs.items() if i >= 25}, "ab cd ab").items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)


def test_idf_of_two_documents(spark):
    df = spark.createDataFrame([("c", 0, "a b"), ("c", 1, "a"), ("c", 2, None)], "corpus string, doc_idx int, content string").where("doc_idx < 2")
    idf = {r["term"]: r["idf"] for r in R.term_idf(R.postings(df, ["corpus"]), R.corpus_stats(R.doc_lengths(df, ["corpus"]), ["corpus"]), ["corpus"]).collect()}
    assert abs(idf["a"] - 0.182322) < 1e-6 and abs(idf["b"] - 0.693147) < 1e-6


def test_ranks_break_ties_by_document(spark):
    df = spark.createDataFrame([("q", "c", i, 1.0) for i in range(20)], "question_id string, corpus string, doc_idx int, score double")
    top = R.ranked(df, ["question_id", "corpus"]).orderBy("rank").collect()
    assert [r["doc_idx"] for r in top] == list(range(19, 4, -1))
    fused = R.rrf([R.ranked(df, ["question_id", "corpus"])], ["question_id", "corpus"]).orderBy("rank").collect()
    assert [r["doc_idx"] for r in fused] == [19, 18, 17] and fused[0]["score"] == round(1 / 61, 6)


def test_silent_documents_hold_ranks(spark):
    docs = spark.createDataFrame([("c", i, "x" if i == 3 else "y") for i in range(30)], "corpus string, doc_idx int, content string")
    q = spark.createDataFrame([("q", "x")], "question_id string, query string")
    every = R.with_silent(R.bm25(docs, R.query_terms(q), ["corpus"]), docs, q, ["corpus"])
    assert [r["doc_idx"] for r in R.ranked(every, ["question_id", "corpus"], most=3).orderBy("rank").collect()] == [3, 29, 28]


def test_sticky_keywords(spark):
    rows = [(1, []), (2, ["purity"]), (3, []), (4, ["OECD", "ECC", "EC"]), (5, None)]
    df = spark.createDataFrame(rows, "ord int, keywords array<string>")
    assert [r["sticky"] for r in R.sticky_keywords(df).orderBy("ord").collect()] == [None, ["purity"], ["purity"], ["OECD", "ECC", "EC"], ["OECD", "ECC", "EC"]]


def test_cosine_topk_in_blocks_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, i % 2, [rng.random() for _ in range(4)]) for i in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    q = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "label", "embedding")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in R.cosine_topk(v, q, "label", k=5, block=2).collect()}
    for i, lab, e in rows:
        if i % 10 == 0:
            best = sorted(((round(sum(a * b for a, b in zip(e, x)), 6), k) for k, l2, x in rows if l2 == lab), reverse=True)[:5]
            assert [got[i, r] for r in range(1, 6)] == [k for _, k in best]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "corpus string, doc_idx int, content string")
    q = spark.createDataFrame([("q", "x")], "question_id string, query string")
    assert R.bm25(docs, R.query_terms(q), ["corpus"]).count() == 0


def test_hybrid_with_keywords_for_all_documents(spark, tmp_path):
    """A document without a stored vector comes up by its vector and by a stated phrase."""
    from pagemill.plans import registry

    texts = ["the lot of the batch", "purity purity", "which lot of rats", "certificate of purity for the lot", "nothing here"]
    spark.createDataFrame([(9000 + i, "s", x) for i, x in enumerate(texts)], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("question 1", "Which purity has the lot?", ["certificate of purity"])], "question_id string, query string, keywords array<string>").write.parquet(str(tmp_path / "questions.parquet"))
    got = registry.queries()["hybrid_top3"](spark, str(tmp_path)).orderBy("rank").collect()
    assert len(got) == 3 and got[0]["doc_idx"] == 9003 and got[0]["score"] > 1 / 61
