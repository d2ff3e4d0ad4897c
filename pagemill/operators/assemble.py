"""From hits to prompts and answers: context, guide pages, prompts, formatted answers, resumption."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T

MARK = r"\+\+\+([^+]+)\+\+\+"


def context(hits: DataFrame, title_pages: DataFrame, summaries: DataFrame, corpus: list[str], qid: str = "question_id", docs: DataFrame | None = None, doc: str = "doc_idx") -> DataFrame:
    """qid, corpus, context (array), retrieved_pages (array), length: title page, summary and hits by rank; nothing is dropped.

    hits: qid, corpus, rank, content, page_num; title_pages and summaries: corpus, content, page_num, at most one row each.
    With docs (corpus, doc, content, page_num) hits have doc for content and page_num: a text then moves once a corpus
    instead of once a question.
    """
    if docs is not None:
        return _context_of_docs(hits, docs, title_pages, summaries, corpus, qid, doc)
    found = hits.groupBy(qid, *corpus).agg(F.sort_array(F.collect_list(F.struct("rank", F.col("content").alias("c"), F.col("page_num").cast("string").alias("p")))).alias("h"))
    joined = found.join(_one(title_pages, corpus, "t"), corpus, "left").join(_one(summaries, corpus, "s"), corpus, "left")
    return _parts(joined, corpus, qid)


def _one(df: DataFrame, corpus: list[str], name: str) -> DataFrame:
    return df.select(*corpus, F.struct(F.col("content").alias("c"), F.col("page_num").cast("string").alias("p")).alias(name))


def _context_of_docs(hits: DataFrame, docs: DataFrame, title_pages: DataFrame, summaries: DataFrame, corpus: list[str], qid: str, doc: str) -> DataFrame:
    used = docs.join(hits.select(*corpus, doc).distinct(), [*corpus, doc])
    texts = used.groupBy(*corpus).agg(F.collect_list(F.struct(F.col(doc).alias("d"), F.col("content").alias("c"), F.col("page_num").cast("string").alias("p"))).alias("_texts"))
    texts = texts.join(_one(title_pages, corpus, "t"), corpus, "left").join(_one(summaries, corpus, "s"), corpus, "left")
    ranks = hits.groupBy(qid, *corpus).agg(F.sort_array(F.collect_list(F.struct("rank", F.col(doc).alias("d")))).alias("_ranks"))
    found = F.transform("_ranks", lambda x: F.get(F.filter("_texts", lambda y: y["d"] == x["d"]), F.lit(0)))
    return _parts(ranks.join(texts, corpus).withColumn("h", found), corpus, qid)


def _parts(joined: DataFrame, corpus: list[str], qid: str) -> DataFrame:
    parts = F.filter(F.concat(F.array("t", "s"), F.transform("h", lambda x: F.struct(x["c"].alias("c"), x["p"].alias("p")))), lambda x: x.isNotNull())
    return joined.select(qid, *corpus, F.transform(parts, lambda x: x["c"]).alias("context"), F.transform(parts, lambda x: x["p"]).alias("retrieved_pages"), F.size(parts).alias("length"))


def prompt(question: Column, parts: Column, guide: Column, intro: str = "Answer from the excerpt alone.", few_shots: str = "") -> Column:
    """Instructions, question, the guide page if there is one, examples of answers, and the excerpt between its marks.

    Without any part (a null or empty array) there is nothing to instruct about: only the question, and that the report
    doesn't answer it.
    """
    help_ = F.when(guide.isNotNull() & (F.length(guide) > 0), F.concat(F.lit("Guide:\n"), guide))
    excerpt = F.concat(F.lit("BEGIN EXCERPT-----\n"), F.array_join(parts, "\n\n"), F.lit("\n-----END EXCERPT"))
    asked = F.concat(F.lit("Question: "), F.coalesce(T.strip(question), F.lit("")))
    full = F.concat_ws("\n\n", F.lit(intro), asked, help_, F.lit(few_shots or None), F.lit("Ignore parts of the report that don't help."), excerpt, F.lit("Give your answer now, and nothing behind it."))
    return F.when(F.coalesce(F.size(parts), F.lit(0)) > 0, full).otherwise(F.concat_ws("\n\n", asked, F.lit("No page of the report answers this question; it has no answer.")))


def guide_titles(handbook: DataFrame, page: str = "page_num", text: str = "text") -> DataFrame:
    """page, title, content of the handbook pages that carry a marked title; of equal titles the last page counts."""
    found = handbook.select(page, T.strip(F.regexp_extract(text, MARK, 1)).alias("title"), F.col(text).alias("content")).where(F.length("title") > 0)
    return found.groupBy("title").agg(F.max(page).alias(page), F.max_by("content", page).alias("content"))


def chosen_title(reply: str | None, titles: list[str]) -> str | None:
    """The title that a reply names last, "non" standing for none; titles that it denies don't count."""
    best, at = None, -1
    for t in (*titles, "non"):
        place = (reply or "").rfind(t)
        if place < 0 and t.lower() in (reply or "").lower():
            place = (reply or "").lower().rfind(t.lower())
        if place < 0 or denied(reply or "", t):
            continue
        if place > at:
            best, at = t, place
    return None if best in (None, "non") else best


def denied(reply: str, title: str) -> bool:
    """Whether no, not or wrong stands within two words behind the title, or not before it, near its last mention."""
    near = reply[max(0, reply.lower().rfind(title.lower()) - 50) :]
    t = re.escape(title)
    return bool(re.search(rf"{t}\W+(?:\w+\W+){{0,2}}(?:no|not|wrong)\b|\bnot\W+(?:\w+\W+){{0,2}}{t}", near, re.I))


def choose_guides(replies: DataFrame, titles: list[str], reply: str = "reply") -> DataFrame:
    """replies with the chosen title; the titles are those of one handbook."""

    @F.pandas_udf("string")
    def pick(rs: pd.Series) -> pd.Series:
        return rs.map(lambda r: chosen_title(r, titles))

    return replies.withColumn("guide", pick(F.col(reply)))


def format_answer(category: Column, answer: Column) -> Column:
    """"<CATEGORY> : <answer>"; an answer that says null or nothing is "Null : Null"."""
    a = T.strip(F.regexp_replace(F.regexp_replace(answer, r"(?U)\s+", " "), r"[.\s]+\z", ""))
    return F.when(answer.isNull() | a.rlike(r"(?i)^(null|none|)\z"), F.lit("Null : Null")).otherwise(F.concat(F.upper(category), F.lit(" : "), a))


def per_question(questions: DataFrame, corpora: DataFrame) -> DataFrame:
    """Every question for every corpus; questions are a few rows."""
    return corpora.crossJoin(F.broadcast(questions))


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What has no finished output yet."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def finished(states: DataFrame, keys: list[str], question: str = "question_id", of: int = 11) -> DataFrame:
    """keys of runs that have answered all questions: the marker of a finished run."""
    return states.groupBy(*keys).agg(F.count_distinct(question).alias("questions")).where(F.col("questions") >= of).select(*keys)


def latest(states: DataFrame, keys: list[str], time: str = "finished_at", tie: str = "state_id") -> DataFrame:
    """One row of each key: the latest, rows without a time first to go, ties by the larger id."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(time), F.desc(tie))
    return states.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
