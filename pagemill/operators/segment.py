"""Segmentation of reports: page features, boundary scores, batches, chunks, contents entries, sections, corpora.

Look-around terms are window aggregates with range frames over (study, page_num), so missing pages are skipped; only the
few numbers per page that a fold needs go to Python, never page texts.
"""

from __future__ import annotations

import re
import statistics

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import classify as K
from pagemill.session import materialised

# ------------------------------------------------------------------------------------------------------ fixed values
STEP, BASE, REPEAT, ID_SPAN, ID_WEIGHT, ID_MOST = 0.0375, 0.70, 0.1, 15, 0.2, 14
TITLE_CUT, PREFACE_CUT = 0.60, 0.50
AHEAD_TITLE, AROUND_PREFACE, AROUND_SUMMARY, BEFORE_INTRO = (1, 8), (-3, 5), (-5, 3), (-8, -1)
BATCH, LOD_SIGMAS, END_MARGIN, LOOKAHEAD, MERGE_SPAN = 8, 2, 10, 5, 15
LEAST_PAGES = 80
TOPIC = r"(?i)toxicolog|environmental|residues|occupational|efficacy|assessment"
SUBSECTION = r"(?i)\b(stud(y|ies)|summary|assessment)\b"
CAPITALS = r"^[A-Z][A-Z0-9 ,&/'\-]{3,80}\z"
TARGETS, NEGATIVES = ["toxicity", "toxicology", "toxicological", "mammalian"], ["environmental", "residue"]
SHARED_HIGH, SHARED_LOW = ["summary", "chemistry", "conclusion", "introduction"], ["summary", "conclusion", "introduction"]
SUMMARY_WORDS = ["summary", "sumnary", "abstract"]
#: Contents entries: title and page on one line; a page alone on the next.
_ENTRY = (re.compile(r"\A(?P<title>.+?)\s*\.{2,}\s*(?P<page>[ivxlcdm\d]+)\s*\Z", re.I), re.compile(r"\A(?P<title>.+?)\s{2,}(?P<page>[ivxlcdm\d]+)\s*\Z", re.I))
_LONE = re.compile(r"\A(?:\d{1,4}|(?=[mdclxvi]{2,}\Z)m{0,4}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))\Z", re.I)


# ------------------------------------------------------------------------------------------------------ G1: boundaries


def page_features(pages: DataFrame, study: str = "study_id", page: str = "page_num", text: str = "text") -> DataFrame:
    """study, page and the scores of each page; on a contents page all others are 0."""
    t, hs, ts, toc = F.col(text), F.col("_hs"), F.col("_ts"), F.col("_toc")
    # what several scores need is a column of its own, which Catalyst doesn't fold into its users
    known = pages.select(study, page, text, K.headings(t).alias("_hs"), K.table_score(t).alias("_ts")).withColumn("_toc", K.is_toc(t, titles=hs, table=ts))
    base = known.select(study, page, toc.cast("int").alias("toc_score"), K.title_features(t, toc, ts)["score"].alias("title"), K.preface_score(t, hs, toc, ts).alias("preface"), K.printed_page(t).alias("printed"), K.printed_id(t).alias("pid"), K.has_summary(t, hs).alias("summary"), K.has_introduction(t, hs).alias("intro"))
    clear = lambda c, zero: F.when(F.col("toc_score") > 0, F.lit(zero)).otherwise(F.col(c))
    return base.select(study, page, "toc_score", clear("title", 0.0).alias("title_page_score"), F.round(clear("preface", 0.0), 6).alias("study_preface_score"), clear("printed", None).alias("pdf_page_num"), clear("pid", None).alias("printed_id"), clear("summary", 0).alias("summary_score"), clear("intro", 0).alias("intro_score"))


def boundary_scores(features: DataFrame, study: str = "study_id", page: str = "page_num", look_around: bool = False, stale_id: bool = True) -> DataFrame:
    """study, page, kind, boundary_score.

    By default summary and introduction pages gain from contents pages around them only, and the change of id is held
    against the study's last id, as the figures this engine reproduces have it; look_around and stale_id give the other reading.
    """
    span = lambda ab: Window.partitionBy(study).orderBy(page).rangeBetween(*ab)
    toc = F.col("toc_score") > 0
    title, preface, summary, intro = (F.col(c) for c in ("title_page_score", "study_preface_score", "summary_score", "intro_score"))

    def around(own: Column, ab: tuple[int, int]) -> Column:
        term = F.when(toc, F.lit(STEP)).otherwise(F.lit(STEP) * own)
        total = F.coalesce(F.sum(term).over(span(ab)), F.lit(0.0))
        return total - term if ab[0] <= 0 <= ab[1] else total

    nothing = F.lit(0.0)
    kind = F.when(toc, "toc").when(title > TITLE_CUT, "title").when(preface > PREFACE_CUT, "preface").when(summary > 0, "summary").when(intro > 0, "introduction")
    first = features.withColumn("kind", kind)
    first = first.withColumn("_ahead", around(preface + summary + intro, AHEAD_TITLE)).withColumn("_preface", around(title + summary + intro, AROUND_PREFACE))
    first = first.withColumn("_summary", around(title + preface + intro if look_around else nothing, AROUND_SUMMARY)).withColumn("_intro", around(title + preface + summary if look_around else nothing, BEFORE_INTRO))
    earlier = Window.partitionBy(study, "kind").orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn("_seen", F.count("*").over(earlier) > 0)
    raw = F.when(F.col("kind") == "title", F.lit(BASE) * title + F.col("_ahead")).when(F.col("kind") == "preface", F.lit(BASE) * preface + F.col("_preface")).when(F.col("kind") == "summary", F.lit(BASE) * summary + F.col("_summary")).when(F.col("kind") == "introduction", F.lit(BASE) * intro + F.col("_intro")).otherwise(F.lit(0.0))
    first = first.withColumn("_raw", raw)
    repeat = F.when(F.col("_seen") & F.when(F.col("kind") == "title", F.col("_raw") > 0.70).otherwise(F.col("kind").isin("summary", "introduction")), REPEAT).otherwise(0.0)
    whole = Window.partitionBy(study).orderBy(page).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the id of the last page that isn't contents, null if that page has none
    last = F.last(F.when(~toc, F.struct("printed_id")), ignorenulls=True).over(whole)["printed_id"]
    first = first.withColumn("_id", last if stale_id else F.col("printed_id"))
    before = F.collect_list("printed_id").over(span((-ID_SPAN, -1)))
    changes = F.when(F.col("_id").isNull(), 0).otherwise(F.size(F.filter(before, lambda x: x != F.col("_id"))))
    score = F.when(toc, F.lit(0.7)).otherwise(F.col("_raw") + repeat + F.lit(ID_WEIGHT) * F.least(changes / F.lit(float(ID_MOST)), F.lit(1.0)))
    return first.select(study, page, "kind", F.round(score, 6).alias("boundary_score"))


def batches(scores: DataFrame, study: str = "study_id", page: str = "page_num", size: int = BATCH) -> DataFrame:
    """study, batch, start_page, pages, mean and whether the mean reaches least mean + 2 sigma of the study's batches."""
    pos = F.row_number().over(Window.partitionBy(study).orderBy(page)) - 1
    grouped = scores.withColumn("batch", F.floor(pos / size).cast("int")).groupBy(study, "batch").agg(F.min(page).alias("start_page"), F.count("*").alias("pages"), F.avg("boundary_score").alias("mean"))
    w = Window.partitionBy(study)
    limit = F.min("mean").over(w) + LOD_SIGMAS * F.stddev_pop("mean").over(w)
    return grouped.select(study, "batch", "start_page", "pages", F.round("mean", 9).alias("mean"), (F.round("mean", 9) >= F.round(limit, 9)).alias("detectable"))


def find_boundaries(scores: list[tuple[int, float]], size: int = BATCH) -> list[int]:
    """Pages at which a report is cut; none unless two at least.

    Batches that stand out are merged with the following ones that start near; within a merged window the boundary is
    the page before the first dip, or at the first rise, or the window's first page.
    """
    parts = [scores[i : i + size] for i in range(0, len(scores), size)]
    means = [sum(v for _, v in p) / len(p) for p in parts]
    if not means:
        return []
    low, high = min(means), max(means)
    standing = [i for i, m in enumerate(means) if m >= low + LOD_SIGMAS * statistics.pstdev(means)]
    if len(standing) <= 1:
        return []
    total, reached, windows = len(scores), -1, []
    for i in standing:
        start = parts[i][0][0]
        if start >= total + 1 - END_MARGIN or i <= reached:
            continue
        # the look-ahead counts places in the list of standing batches from the batch's own number, as the figures
        # that this engine reproduces have it
        near = [j for j in range(i + 1, i + 1 + LOOKAHEAD) if j < len(standing) and parts[standing[j]][0][0] <= start + MERGE_SPAN]
        if near:
            reached = near[-1]
        windows.append([x for j in (i, *near) if j < len(parts) for x in parts[j]])
    cuts = []
    for w in windows:
        spread, turn = statistics.pstdev([v for _, v in w]), None
        for (page, v), (after, nxt) in zip(w, w[1:]):
            if v <= low:
                turn = after if nxt - v >= 1.5 * spread else None
            elif v >= high - 0.1 or v >= 0.85:
                break
            elif nxt <= v / 2:
                turn = page
            elif nxt >= v * 2:
                turn = after
            if turn is not None:
                break
        cuts.append(w[0][0] if turn is None else turn)
    return list(dict.fromkeys(cuts)) if len(cuts) > 1 else []


def chunk_ranges(scores: DataFrame, study: str = "study_id", page: str = "page_num", size: int = BATCH) -> DataFrame:
    """study, page_start, page_end of the chunks; neighbours share their boundary page, the last ends behind the report."""
    kind = scores.schema[study].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(page)
        cuts = find_boundaries(list(zip(pdf[page].astype(int), pdf["boundary_score"])), size)
        rows = [(pdf[study].iloc[0], a, b) for a, b in zip(cuts, [*cuts[1:], len(pdf) + 1])]
        return pd.DataFrame(rows, columns=[study, "page_start", "page_end"])

    return scores.select(study, page, "boundary_score").groupBy(study).applyInPandas(fold, f"{study} {kind}, page_start int, page_end int")


def chunk_titles(chunks: DataFrame, pages: DataFrame, targets: list[str] | None = None, study: str = "study_id", page: str = "page_num", text: str = "text") -> DataFrame:
    """chunks with the text of their first page as title; with targets only those whose title has one of them."""
    out = chunks.join(pages.select(study, F.col(page).alias("page_start"), F.col(text).alias("title")), [study, "page_start"])
    if targets:
        out = out.where(F.exists(F.array(*[F.lit(t.lower()) for t in targets]), lambda t: F.lower("title").contains(t)))
    return out


def pages_of_chunks(chunks: DataFrame, pages: DataFrame, study: str = "study_id", page: str = "page_num") -> DataFrame:
    """Every page of every chunk: an equi-join on the study with the page range as a filter."""
    return chunks.join(pages, study).where(F.col(page).between(F.col("page_start"), F.col("page_end")))


# ------------------------------------------------------------------------------------------------------ G2: sections

def contents_entries(text: str | None) -> list[tuple[str, str]]:
    """(title, page as printed) of a contents text: on one line with dots or blanks between, or on two lines."""
    found: list[tuple[str, str]] = []
    waiting: str | None = None
    for line in (s for x in (text or "").splitlines() if (s := x.strip())):
        if waiting is not None and _LONE.match(line):
            found.append((waiting, line))
            waiting = None
            continue
        waiting = None
        if line.lower() in ("contents", "table of contents"):
            continue
        m = next((m for p in _ENTRY if (m := p.match(line))), None)
        if m is None:
            waiting = line
        elif title := re.sub(r"\s+", " ", m["title"]).strip():
            found.append((title, m["page"]))
    return found


def _entries_udf():
    @F.pandas_udf("array<struct<title:string,page:string>>")
    def udf(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"title": a, "page": b} for a, b in contents_entries(t)])

    return udf


def toc_texts(pages: DataFrame, study: str = "study_id", page: str = "page_num", text: str = "text", first: int = 15) -> DataFrame:
    """study, toc: the contents pages among the first pages, joined in order."""
    hits = pages.where((F.col(page) <= first) & K.is_toc(F.col(text)))
    return hits.groupBy(study).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t")))), lambda x: x["t"]), "\n").alias("toc"))


def toc_entries(pages: DataFrame, study: str = "study_id", page: str = "page_num", text: str = "text", toc: DataFrame | None = None) -> DataFrame:
    """study, ord, title, page: the parsed entries; Roman pages lie below 0. toc (toc_texts) can be given where it is known."""
    parsed = (toc_texts(pages, study, page, text) if toc is None else toc).select(study, F.posexplode(_entries_udf()(F.col("toc"))).alias("ord", "e"))
    return parsed.select(study, "ord", "e.title", K.roman_or_int(F.col("e.page")).alias("page"))


def heading_lines(pages: DataFrame, study: str = "study_id", page: str = "page_num", text: str = "text") -> DataFrame:
    """study, page, line (its place), title, capital, heading: the lines that are capital headings, heading lines or both."""
    every = F.transform(T.full_lines(F.col(text)), lambda s: F.struct(s.alias("title"), s.rlike(CAPITALS).alias("capital"), K.is_heading_line(s, stripped=True).alias("heading")))
    # posexplode has Catalyst test the array's size first, which computes it twice
    return pages.select(study, page, F.posexplode_outer(every).alias("line", "_e")).where("_e.capital OR _e.heading").select(study, page, "line", "_e.*")


def high_sections(pages: DataFrame, study: str = "study_id", page: str = "page_num", text: str = "text", toc: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """study, ord, title, page_start, page_end: contents entries found as capital headings in the body, in order.

    The search for an entry starts at the page of the one before; entries without a heading are left out. toc (toc_texts)
    and lines (heading_lines) can be given where they are known.
    """
    lines = heading_lines(pages, study, page, text) if lines is None else lines
    entries = toc_entries(pages, study, page, text, toc).select(study, "ord", "title", F.upper(F.regexp_replace(T.strip(F.col("title")), r"(?U)\s+", " ")).alias("_key"))
    body = lines.where("capital").select(study, F.col(page).alias("_p"), F.upper(F.regexp_replace("title", r"(?U)\s+", " ")).alias("_key")).distinct()
    found = entries.join(body, [study, "_key"]).groupBy(study, "ord", "title").agg(F.sort_array(F.collect_set("_p")).alias("at"))
    # an ordered fold over the study's entries: the first page at or behind that of the entry before
    folded = found.groupBy(study).agg(F.sort_array(F.collect_list(F.struct("ord", "title", "at"))).alias("es"))
    start = F.struct(F.lit(0).alias("from"), F.array().cast("array<struct<ord:int,title:string,page:int>>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        p = F.element_at(F.filter(e["at"], lambda x: x >= s["from"]), 1)
        hit = F.exists(e["at"], lambda x: x >= s["from"])
        return F.when(hit, F.struct(p.cast("int").alias("from"), F.concat(s["out"], F.array(F.struct(e["ord"].cast("int").alias("ord"), e["title"].alias("title"), p.cast("int").alias("page")))).alias("out"))).otherwise(s)

    out = folded.select(study, F.explode(F.aggregate("es", start, step)["out"]).alias("e")).select(study, "e.ord", "e.title", F.col("e.page").alias("page_start"))
    n = pages.groupBy(study).agg(F.max(page).alias("_n"))
    nxt = F.lead("page_start").over(Window.partitionBy(study).orderBy("ord")) - 1
    return out.join(n, study).withColumn("page_end", F.greatest("page_start", F.coalesce(nxt, F.col("_n").cast("int")))).drop("_n")


def subheadings(pages: DataFrame, sections: DataFrame, study: str = "study_id", page: str = "page_num", text: str = "text", lines: DataFrame | None = None) -> DataFrame:
    """study, ord, high_title, page, title: heading lines inside the page range of each section; lines as in high_sections."""
    lines = (heading_lines(pages, study, page, text) if lines is None else lines).where("heading").select(study, page, "line", F.col("title").alias("low"))
    spans = sections.select(study, "ord", F.col("title").alias("high_title"), "page_start", "page_end")
    return lines.join(spans, study).where(F.col(page).between(F.col("page_start"), F.col("page_end"))).select(study, "ord", "high_title", page, "line", F.col("low").alias("title"))


def clustered(headings: DataFrame, by: list[str], page: str = "page_num", least: int = 3, span: int = 6) -> DataFrame:
    """by, clustered: whether so many study headings lie within span pages."""
    hits = headings.where(F.col("title").rlike(SUBSECTION))
    last = F.lead(page, least - 1).over(Window.partitionBy(*by).orderBy(page, "line"))
    return hits.withColumn("_near", last - F.col(page) <= span).groupBy(*by).agg(F.coalesce(F.bool_or("_near"), F.lit(False)).alias("clustered"))


def integrated_score(pages: DataFrame, study: str = "study_id", page: str = "page_num", text: str = "text") -> DataFrame:
    """study, score: how likely a report holds several studies, from its contents or, without any, its body headings.

    Contents, heading lines and sections are asked for more than once, so each is written once.
    """
    toc_pages = materialised(toc_texts(pages, study, page, text))
    lines = materialised(heading_lines(pages, study, page, text))
    sections = materialised(high_sections(pages, study, page, text, toc_pages, lines))
    subs = subheadings(pages, sections, study, page, text, lines)
    near = clustered(subs, [study, "ord"], page).groupBy(study).agg(F.bool_or("clustered").alias("clustered"))
    titles = sections.groupBy(study).agg(F.count_distinct(F.when(F.col("title").rlike(TOPIC), F.col("title"))).alias("topics"), F.sum(F.col("title").rlike(r"(?i)\bassessment\b").cast("int")).alias("mentions"))
    with_toc = toc_pages.select(study, F.lit(True).alias("has_toc"))
    body = lines.where("heading").select(study, page, "line", "title")
    plain = clustered(body, [study], page).withColumnRenamed("clustered", "body_clustered")
    like = body.groupBy(study).agg(F.sum(F.col("title").rlike(TOPIC).cast("int")).alias("like"))
    layer = K.has_text_layer(pages, study, page, text)
    every = layer
    for part in (with_toc, titles, near, plain, like):
        every = every.join(part, study, "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    toc = F.when(n("topics") >= 2, 0.5).otherwise(0.0) + F.when(n("mentions") >= 3, 0.2).otherwise(0.0) + F.when(yes("clustered"), 0.3).otherwise(0.0)
    none = F.when(yes("body_clustered"), 0.4).otherwise(0.0) + F.when(n("like") >= 2, 0.4).otherwise(0.0)
    return every.select(study, F.when(~F.col("has_text"), 0.0).otherwise(F.least(F.round(F.when(yes("has_toc"), toc).otherwise(none), 6), F.lit(1.0))).alias("score"))


def section_spans(pages: DataFrame, study: str = "study_id", page: str = "page_num", text: str = "text") -> DataFrame:
    """study, ord, sub, title ("High -> Low"), page_num, content: the slices between headings.

    Subheadings cut assessment sections only; a slice starts behind its own heading and ends before the next one.
    """
    sections = high_sections(pages, study, page, text)
    subs = subheadings(pages, sections.where(F.col("title").rlike(TOPIC)), study, page, text).where(F.lower("title") != F.lower(T.strip(F.col("high_title"))))
    w = Window.partitionBy(study, "ord").orderBy(page, "line")
    ranged = subs.join(sections.select(study, "ord", "page_end"), [study, "ord"]).select(study, "ord", F.row_number().over(w).alias("sub"), F.concat_ws(" -> ", "high_title", "title").alias("title"), F.col(page).alias("page_start"), F.coalesce(F.lead(page).over(w), F.col("page_end")).alias("page_end"), F.col("title").alias("own"), F.lead("title").over(w).alias("next"))
    plain = sections.join(subs.select(study, "ord").distinct(), [study, "ord"], "left_anti").select(study, "ord", F.lit(0).alias("sub"), "title", "page_start", "page_end", F.lit(None).cast("string").alias("own"), F.lit(None).cast("string").alias("next"))
    spans = ranged.unionByName(plain)
    texts = pages_of_chunks(spans, pages.select(study, page, text), study, page).groupBy(study, "ord", "sub", "title", F.col("page_start").alias("page_num"), "own", "next").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t")))), lambda x: x["t"]), "\n").alias("blob"))
    begin = F.expr("coalesce(nullif(locate(lower(substring(own, 1, 20)), lower(blob)), 0) + length(substring(own, 1, 20)), 1)")
    cut = texts.withColumn("_b", begin).withColumn("_e", F.expr("nullif(locate(lower(substring(next, 1, 20)), lower(blob), _b), 0)"))
    body = F.expr("substring(blob, _b, coalesce(_e, length(blob) + 1) - _b)")
    return cut.select(study, "ord", "sub", "title", "page_num", T.strip(body).alias("content"))


def route_sections(sections: DataFrame) -> DataFrame:
    """sections with route: negative, shared, target or null, by the words of their high and low titles."""
    high = F.when(F.col("title").contains("->"), F.lower(T.strip(F.regexp_extract("title", r"(?s)^(.*?)\s*->", 1)))).otherwise(F.lower("title"))
    low = F.lower(T.strip(F.regexp_extract("title", r"(?s)^.*?\s*->\s*(.*)\z", 1)))
    arrow = F.col("title").contains("->")
    has = lambda c, ws: F.exists(F.array(*map(F.lit, ws)), lambda w: c.contains(w))
    route = F.when(arrow & (has(high, NEGATIVES) | has(low, NEGATIVES)), "negative").when(has(high, SHARED_HIGH) | (arrow & has(low, SHARED_LOW)), "shared").when(arrow & has(high, TARGETS), "target")
    return sections.withColumn("route", route)


def long_reports(pages: DataFrame, least_pages: int = LEAST_PAGES, study: str = "study_id") -> DataFrame:
    """All pages of the reports that have so many: those whose route depends on boundary scores."""
    long = materialised(pages.groupBy(study).agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages).select(study))
    return pages.join(long, study, "left_semi").select(*pages.columns)


def corpus_route(pages: DataFrame, scores: DataFrame, split: bool = True, least_pages: int = LEAST_PAGES, study: str = "study_id", page: str = "page_num", text: str = "text") -> DataFrame:
    """study, route: chunks if the report is long and cut, else integrated (score of 0.5 at least), else whole.

    No more scores are needed than those of long_reports.
    """
    sizes = pages.groupBy(study).agg(F.count("*").alias("pages"))
    cut = chunk_ranges(scores, study, page).groupBy(study).agg(F.count("*").alias("chunks"))
    both = integrated_score(pages, study, page, text)
    every = sizes.join(cut, study, "left").join(both, study, "left")
    return every.select(study, F.when(F.lit(split) & (F.col("pages") >= least_pages) & (F.coalesce("chunks", F.lit(0)) > 0), "chunks").when(F.coalesce("score", F.lit(0.0)) >= 0.5, "integrated").otherwise("whole").alias("route"))

