"""Page classifiers: native expressions over one text column, each with its parts.

Fixed patterns and weights stand together below. A score is a double; null and blank texts score 0 and are no table, no
contents page and have no ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import text as T

# ------------------------------------------------------------------------------------------------------ fixed values
NUMBER = r"(?U)(?<![\w.])[-+]?\d+(?:,\d{3})*(?:\.\d+)?(?:[eE][-+]?\d+)?%?(?![\w.])"
DECIMAL = r"(?U)(?<![\w.])\d+\.\d+(?![\w.])"
CAPTION = r"(?iU)\btables?\s+\d+(?:\s*-\s*\d+)?\b"
P_VALUE = r"(?U)\b[pP]\s*[<>]=?\s*0?\.\d+"
CAPITAL_HEADING = r"(?Udm)^\s*(?:[A-Z][A-Z0-9&'\-]*\s+){0,3}[A-Z][A-Z0-9&'\-]*\s*(?:\((?:cont(?:\.|d|inued)?|continued|contd?)\))?\s*$"
TITLE_WORD = r"(?:[A-Z][a-zA-Z]*(?:[-–—][a-zA-Z]+)?(?:[-–—][a-zA-Z]+)?|[a-z]{1,4})"
TITLE_HEADING = rf"(?Udm)(?:(?<=\n)|(?<=\A))[ \t]*((?=.*[A-Za-z]){TITLE_WORD}(?:[ \t]+{TITLE_WORD})*|(?=.*[A-Za-z])[A-Z0-9][A-Z0-9 \t\-–—]{{2,}})[ \t]*\n+\s*(?=[A-Z])"
SECTION_NUMBER = r"(?Udm)^[\s`'_~•·\-–—]*[A-Za-z]{0,2}[\s`'_~•·\-–—]*\d+(?:\s*\.\s*\d+)+\s*\.?"
CAPITAL_LINE = r"(?Udm)^[A-Z][A-Z\s\-/&(),:.]{4,}$"
TRAILING_PAGE = r"(?Udm)^(?!.*\d.*\d.*\d)[^\n]{3,80}?(?:\.{2,}|\s{2,})\d{1,3}\s*$"
LONE_PAGE = r"(?Udm)^\s*\d{1,3}\s*$"
CONTENTS_LINE = r"(?iUdm)^\s*(contents|table of contents)\s*$"
TITLE_KEYWORDS = ["final report", "study", "subject", "from:", "to:", "study report", "test substance", "substance", "project", "project number", "study number", "protocol", "sponsor", "laboratory", "performed for", "prepared for", "quality assurance", "glp", "good laboratory practice", "confidential", "report", "author", "study director", "study code", "cas rn", "cas no", "cas"]
SECTION_WORDS = ["summary", "introduction", "materials", "methods", "results", "discussion", "conclusion", "references", "appendix"]
APPENDIX_WORDS = ["appendix", "appendices"]
PREFACE_WORDS = ["study director", "study sponsor", "glp compliance", "quality assurance"]
SIGNING_WORDS = ["signature", "date"]
SECTION_TITLES = ["introduction", "1ntroduction", "summary", "sumnary", "abstract", "test substance", "test material", "procedure", "results", "discussion", "references", "methods", "cell line", "harvest", "staining", "coding"]
ID_WORDS = ["project number", "study number", "study id", "study no.", "study identifier", "project no.", "sponsor reference", "protocol no.", "protocol number", "report no.", "report number", "reference no.", "internal reference"]
PAGE_MARKED = r"(?iUd)^\s*(-\s*\d{1,4}\s*-|\[\s*\d{1,4}\s*\]|page\s+\d{1,4}|page\s+\d{1,4}\s+of\s+\d{1,4})\s*$"
PAGE_ROUND = r"(?Ud)^\s*(\(\s*\d{1,4}\s*\))\s*$"
PAGE_SLASH = r"(?Ud)^\s*(\d{1,4}\s*/\s*\d{1,4})\s*$"


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def _hits(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (text.contains(w).cast("int") for w in words))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def blank(text: Column) -> Column:
    return text.isNull() | (F.length(T.strip(text)) == 0)


# ------------------------------------------------------------------------------------------------------ tables


def short_line_run(lines: Column, most: int = 30, run: int = 5, share: float = 0.4) -> Column:
    """Whether a run of short lines, five at least, has numbers in two fifths of them; lines: structs of length and numbers."""

    def step(s: Column, x: Column) -> Column:
        fits = x["length"] <= most
        n = F.when(fits, s["n"] + 1).otherwise(0)
        d = F.when(fits, s["d"] + (x["numbers"] > 0).cast("int")).otherwise(0)
        return F.struct(n.alias("n"), d.alias("d"), (s["found"] | ((n >= run) & (d >= n * share))).alias("found"))

    return F.aggregate(lines, F.struct(F.lit(0).alias("n"), F.lit(0).alias("d"), F.lit(False).alias("found")), step)["found"]


def table_score(text: Column) -> Column:
    """0 to 1: caption .5, decimals .2, lines of many numbers .2 and .15, p values .1, a run of short lines .15."""
    return F.when(blank(text), 0.0).otherwise(T.let(F.transform(T.full_lines(text), lambda x: F.struct(F.length(x).alias("length"), _count(x, NUMBER).alias("numbers"))), lambda ls: _table_points(text, ls)))


def _table_points(text: Column, ls: Column) -> Column:
    share = F.size(F.filter(ls, lambda x: x["numbers"] >= 6)) / F.greatest(F.size(ls), F.lit(1))
    score = (
        F.when(text.rlike(CAPTION), 0.5).otherwise(0.0)
        + F.least(_count(text, DECIMAL) / F.lit(8.0), F.lit(1.0)) * 0.2
        + F.least(share / 0.6, F.lit(1.0)) * 0.2
        + F.least(share / 0.6, F.lit(1.0)) * 0.15
        + F.when(text.rlike(P_VALUE), 0.1).otherwise(0.0)
        + F.when(short_line_run(ls), 0.15).otherwise(0.0)
    )
    return F.least(F.round(score, 9), F.lit(1.0))


def is_table(text: Column, threshold: float = 0.7) -> Column:
    return table_score(text) >= threshold


# ------------------------------------------------------------------------------------------------------ headings


def headings(text: Column) -> Column:
    """All heading titles: first those of one to four capital words, then those of title words; duplicates stay."""
    capital = F.transform(F.regexp_extract_all(text, F.lit(CAPITAL_HEADING), F.lit(0)), T.strip)
    title = F.transform(F.regexp_extract_all(text, F.lit(TITLE_HEADING), F.lit(1)), T.strip)
    return F.coalesce(F.concat(capital, title), F.array().cast("array<string>"))


def is_heading_line(line: Column, most: int = 6, stripped: bool = False) -> Column:
    """Whether a line of so many words starts with a capital and ends without a stop; stripped: it is so already."""
    s = line if stripped else T.strip(line)
    return (F.length(s) > 0) & ~F.substring(s, -1, 1).isin(".", ",", ";", ":") & s.rlike(r"^\p{Lu}") & (T.n_words(s) <= most)


def is_toc(text: Column, least: int = 4, share: float = 0.2, few_words: int = 100, titles: Column | None = None, table: Column | None = None) -> Column:
    """Whether the page is a table of contents; titles (headings) and table (score) can be given where they are known."""
    low = F.lower(text)
    # a heading is a part of its text: only texts with the word come to the headings
    named = low.contains("contents") & F.exists(headings(text) if titles is None else titles, lambda h: F.lower(h).contains("contents"))
    tabular = (table_score(text) if table is None else table) >= 0.7
    # the look-ahead of the trailing page pattern is dear: only texts with such an end of line at all come to it
    trailing = F.when(text.rlike(r"(?Udm)(?:\.\.|\s\s)\d{1,3}\s*$"), _count(text, TRAILING_PAGE)).otherwise(0)
    like = _count(text, SECTION_NUMBER) + _count(text, CAPITAL_LINE) + trailing
    total = T.let(like, lambda n: F.when(n >= 4, n + _count(text, LONE_PAGE)).otherwise(n))
    deep = text.rlike(CONTENTS_LINE) | T.let(total, lambda matched: (matched >= least) & (matched >= F.size(T.full_lines(text)) * share))
    # the table score is the dearest part: it comes last, as a veto for what counts as contents without it
    return F.when(blank(text), False).when(low.contains("table of contents") & (T.n_words(text) < few_words), True).when(named, True).otherwise(deep & ~tabular)


def looks_like_toc(text: Column) -> Column:
    """The plain test: the word contents, or four entries on one line, or four lines of a page number."""
    ls = T.full_lines(text)
    same = F.size(F.filter(ls, lambda x: x.rlike(r"(?iU)^\s*.+?\s*\.{2,}\s*[ivxlcdm\d]+\s*\z") | x.rlike(r"(?iU)^\s*.+?\s{2,}[ivxlcdm\d]+\s*\z")))
    lone = F.size(F.filter(ls, lambda x: x.rlike(r"(?iU)^\d{1,4}\z") | x.rlike(ROMAN_LINE)))
    return F.coalesce(text.rlike(r"(?iU)\bcontents\b") | (same >= 4) | (lone >= 4), F.lit(False))


ROMAN_LINE = r"(?i)^(?=[mdclxvi]{2,}\z)m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})\z"

# ------------------------------------------------------------------------------------------------------ title and preface


def title_features(text: Column, toc: Column | None = None, table: Column | None = None) -> Column:
    """struct of what the title score is made of, and the score from 0 to 1."""
    if toc is None:
        return T.let(table_score(text), lambda t: title_features(text, is_toc(text, table=t), t))

    def parts(low: Column) -> Column:
        counts = T.let(T.full_lines(text), lambda ls: F.struct(F.size(F.filter(ls, lambda x: T.n_words(x) > 15)).alias("long"), F.size(F.filter(ls, lambda x: T.n_words(x) <= 6)).alias("short"), F.size(ls).alias("lines")))
        return F.struct(_count(text, r"(?U)\w+").alias("words"), counts.alias("c"), _any(low, APPENDIX_WORDS).alias("appendix"), _hits(low, TITLE_KEYWORDS).alias("keywords"), _hits(low, SECTION_WORDS).alias("sections"), toc.alias("toc"), (table >= 0.9).alias("table"))

    return T.let(T.let(F.lower(text), parts), lambda p: _title_points(text, p))


def _title_points(text: Column, p: Column) -> Column:
    words, appendix, keywords, sections, toc, table = (p[c] for c in ("words", "appendix", "keywords", "sections", "toc", "table"))
    long, short = p["c"]["long"], p["c"]["short"]
    few = F.when(words < 70, F.when(appendix, 0).otherwise(6)).when(words < 100, F.when(appendix, 0).otherwise(3)).when(words < 150, F.when(appendix, 0).otherwise(2)).otherwise(-6)
    total = few + F.when(long <= 2, 2).otherwise(0) + F.when(short >= p["c"]["lines"] * 0.5, 2).otherwise(0) + F.least(keywords, F.lit(5)) - sections - F.when(appendix, 4).otherwise(0) - F.when(toc, 4).otherwise(0) - F.when(table, 8).otherwise(0)
    score = F.when(blank(text), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(total / F.lit(12.0), F.lit(1.0))))
    return F.struct(words.alias("word_count"), long.alias("long_lines"), short.alias("short_lines"), keywords.alias("title_keywords"), sections.alias("section_words"), appendix.alias("appendix"), toc.alias("toc"), table.alias("table"), F.round(score, 6).alias("score"))


def title_score(text: Column) -> Column:
    return title_features(text)["score"]


def preface_score(text: Column, titles: Column | None = None, toc: Column | None = None, table: Column | None = None) -> Column:
    if titles is None:
        return T.let(headings(text), lambda hs: T.let(table_score(text), lambda t: preface_score(text, hs, is_toc(text, titles=hs, table=t), t)))
    return F.when(blank(text), 0.0).otherwise(T.let(F.lower(text), lambda low: T.let(F.size(F.filter(titles, lambda h: _any(F.lower(h), SECTION_TITLES))), lambda n: _preface_points(text, low, n, toc, table))))


def _preface_points(text: Column, low: Column, titles: Column, toc: Column, table: Column) -> Column:
    n = F.size(F.split(text, " ", -1))
    keyword = _any(low, PREFACE_WORDS)
    points = F.when(n < 150, 2).when(n < 210, 1).otherwise(-4) + F.when(keyword, F.when(_any(low, SIGNING_WORDS), 8).otherwise(4)).otherwise(0) + F.when((titles < 1) & keyword, 4).otherwise(0) - F.when(titles > 1, 1).otherwise(0) - F.when(_any(low, APPENDIX_WORDS), 4).otherwise(0) - F.when(toc, 4).otherwise(0) - F.when(table >= 0.7, 4).otherwise(0)
    return F.greatest(F.lit(0.0), F.least(points / F.lit(8.0), F.lit(1.0)))


def printed_id(text: Column) -> Column:
    """The identifier behind the first words such as "study number", in lower case; null without one."""
    words = "|".join(w.replace(".", r"\.") for w in ID_WORDS)
    return F.nullif(F.regexp_extract(F.lower(text), rf"(?U)(?:{words})\s*[:.#-]?\s*([A-Za-z0-9][A-Za-z0-9._/-]*)", 1), F.lit(""))


def printed_page(text: Column) -> Column:
    """The page number, if the whole text is one: -6-, [6], page 6, page 6 of 14, (6) or 6/14."""
    low = F.lower(text)
    found = F.coalesce(*[F.nullif(T.strip(F.regexp_extract(low, p, 1)), F.lit("")) for p in (PAGE_MARKED, PAGE_ROUND, PAGE_SLASH)])
    return found


def is_summary_title(title: Column) -> Column:
    t = F.lower(title)
    of = t.contains("summary of") | t.contains("sumnary of")
    return F.when(of, _any(t, ["study", "report", "results"])).otherwise(_any(t, ["summary", "sumnary", "abstract"]) & (T.n_words(t) <= 2))


def has_summary(text: Column, titles: Column | None = None) -> Column:
    return F.coalesce(F.exists(headings(text) if titles is None else titles, is_summary_title), F.lit(False)).cast("int")


def has_introduction(text: Column, titles: Column | None = None) -> Column:
    return F.coalesce(F.exists(headings(text) if titles is None else titles, lambda h: _any(F.lower(h), ["introduction", "1troduction"]) & (T.n_words(h) <= 2)), F.lit(False)).cast("int")


def has_text_layer(pages, study: str = "study_id", page: str = "page_num", text: str = "text", least: int = 200, first: int = 10):  # type: ignore[no-untyped-def]
    """study, has_text: whether the first pages hold at least so many characters."""
    return pages.groupBy(study).agg((F.coalesce(F.sum(F.when(F.col(page) <= first, F.length(T.strip(F.col(text))))), F.lit(0)) >= least).alias("has_text"))


def roman_or_int(token: Column) -> Column:
    """Arabic numbers as they are, Roman ones below 0 (-1000 + n), anything else -9999."""
    t = F.lower(T.strip(token))
    value = F.create_map(*[F.lit(x) for kv in (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100), ("d", 500), ("m", 1000)) for x in kv])
    digits = F.filter(F.split(F.reverse(t), ""), lambda c: c != "")

    def step(s: Column, c: Column) -> Column:
        v = F.element_at(value, c)
        return F.struct(F.when(v < s["prev"], s["total"] - v).otherwise(s["total"] + v).alias("total"), v.alias("prev"))

    total = F.aggregate(digits, F.struct(F.lit(0).alias("total"), F.lit(0).alias("prev")), step)["total"]
    return F.when(t.rlike(r"^\d{1,9}\z"), F.expr("0") + t.try_cast("int")).when(t.rlike(r"^[ivxlcdm]+\z"), F.lit(-1000) + total).otherwise(F.lit(-9999))
