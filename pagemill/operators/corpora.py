"""The corpora of reports: chunks of long ones, target sections of integrated ones, else the whole report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import classify as K
from pagemill.operators import sections as S
from pagemill.operators import segment as G
from pagemill.session import materialised

CHUNK_TITLE_FIRST = 6


def has_any(text, words: list[str]):  # type: ignore[no-untyped-def]
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.lower(text).contains(w))


def integrated_corpora(spans: DataFrame, study: str = "study_id") -> DataFrame:
    """study, corpus, label, doc, page_num, title, content: each target section behind all shared sections of its study.

    spans is what section_spans gives. Corpora are numbered and shared sections ordered as the sections stand; the label
    is high_low. A study without a target section has none.
    """
    routed = G.route_sections(spans)
    place = F.struct("ord", "sub", "page_num")
    docs = lambda route: routed.where(F.col("route") == route).select(study, place.alias("at"), "page_num", "title", "content")
    targets = docs("target").withColumn("corpus", F.row_number().over(Window.partitionBy(study).orderBy("at")))
    high, low = (T.strip(F.regexp_extract("title", r"(?s)^(.*?)\s*->\s*(.*)\z", i)) for i in (1, 2))
    targets = targets.withColumn("label", F.concat_ws("_", high, low))
    shared = targets.select(study, "corpus", "label").join(docs("shared"), study).withColumn("last", F.lit(0))
    every = shared.unionByName(targets.withColumn("last", F.lit(1)))
    doc = F.row_number().over(Window.partitionBy(study, "corpus").orderBy("last", "at"))
    return every.select(study, "corpus", "label", doc.alias("doc"), "page_num", "title", "content")


def integrated_summaries(docs: DataFrame, study: str = "study_id") -> DataFrame:
    """study, corpus, summary (content), summary_pages: the first document with a summary word and a target word in its title."""
    hits = docs.where(has_any(F.col("title"), G.SUMMARY_WORDS) & has_any(F.col("title"), G.TARGETS))
    return hits.groupBy(study, "corpus").agg(F.min_by("content", "doc").alias("summary"), F.min_by(F.col("page_num").cast("string"), "doc").alias("summary_pages"))


def report_corpora(pages: DataFrame, scores: DataFrame, spans: DataFrame, routes: DataFrame, study: str = "study_id", page: str = "page_num", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, corpora) of all reports.

    documents: study, route, corpus, label, doc, page_num, title, content; corpora: study, route, corpus, label,
    title_page, title_page_num, summary, summary_pages. routes is what corpus_route gives; an integrated report without
    a target section counts as whole.
    """
    sections = materialised(integrated_corpora(spans.join(routes.where("route = 'integrated'").select(study), study), study))
    aimed = sections.select(study).distinct().withColumn("_aimed", F.lit(True))
    route = F.when((F.col("route") == "integrated") & F.col("_aimed").isNull(), "whole").otherwise(F.col("route"))
    routes = materialised(routes.join(aimed, study, "left").select(study, route.alias("route")))
    number = F.row_number().over(Window.partitionBy(study).orderBy("page_start", "page_end"))
    chunks = G.chunk_ranges(scores, study, page).join(routes.where("route = 'chunks'"), study)
    chunks = chunks.select(study, "route", number.alias("corpus"), F.concat_ws("_", F.col("page_start").cast("string"), F.col("page_end").cast("string")).alias("label"), "page_start", "page_end")
    whole = routes.where("route = 'whole'").select(study, "route", F.lit(1).alias("corpus"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"))
    ranges = materialised(chunks.unionByName(whole))
    inside = F.col("page_start").isNull() | F.col(page).between(F.col("page_start"), F.col("page_end"))
    key = [study, "corpus"]

    doc = F.row_number().over(Window.partitionBy(*key).orderBy(page))
    paged = S.documents(pages, page, text).join(ranges, study).where(inside)
    paged = paged.select(study, "route", "corpus", "label", doc.alias("doc"), F.col(page).alias("page_num"), F.lit(None).cast("string").alias("title"), F.col(text).alias("content"))
    documents = paged.unionByName(sections.select(study, F.lit("integrated").alias("route"), "corpus", "label", "doc", "page_num", "title", "content"))

    titled = pages.where(K.title_score(F.col(text)) >= S.TITLE_LEAST).select(study, page, text)
    every = ranges.unionByName(sections.select(key + ["label"]).distinct().select(study, F.lit("integrated").alias("route"), "corpus", "label", F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end")))
    early = F.when(F.col("page_start").isNull(), F.col(page) <= S.TITLE_FIRST).otherwise(F.col(page) < F.col("page_start") + CHUNK_TITLE_FIRST)
    titles = every.join(titled, study).where(inside & early).groupBy(*key).agg(F.min_by(text, page).alias("title_page"), F.min(page).alias("title_page_num"))
    found = ranges.join(S.find_sections(pages, S.SUMMARY_TARGETS, study, page, text), study).where(inside)
    rows = F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), "title", F.col("content").alias("c"))))
    sums = found.groupBy(*key).agg(rows.alias("r")).select(*key, F.array_join(F.transform("r", lambda x: x["c"]), "\n\n").alias("summary"), F.array_join(F.transform("r", lambda x: x["p"].cast("string")), "+").alias("summary_pages"))
    corpora = every.drop("page_start", "page_end").join(titles, key, "left").join(sums.unionByName(integrated_summaries(sections, study)), key, "left")
    return documents, corpora
