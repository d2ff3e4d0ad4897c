"""Search for sections by heading, and the documents of a corpus: title page, summary, pages."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators import classify as K
from pagemill.session import materialised

# Fixed values.
TITLE_LEAST, TITLE_FIRST, CUT_LEAST, LONG_LINE, FEW_WORDS = 0.80, 7, 150, 10, 50
SUMMARY_TARGETS = ["summary", "sumnary", "abstract"]
SECTION_WORDS = "introduction|1ntroduction|summary|sumnary|abstract|test substance|test material|procedure|results|discussion|references|methods|cell line|harvest|staining|coding".split("|")
_STUDY = re.compile(r"\bsummary\s+of\s+(?:\w+\s+)*?study\b", re.IGNORECASE)
_JUNK = re.compile(r"\b(?=\S*[A-Za-z])(?=\S*\d)(?=\S*[^A-Za-z0-9])\S+\b")
_PAGE_NUMBER = re.compile(r"\bPage\s+\d+(?:\s+of\s+\d+)?\b", re.IGNORECASE)


def heading_rows(pages: DataFrame, study: str = "study_id", page: str = "page_num", text: str = "text") -> DataFrame:
    """study, page, ord, title: a row for each heading in the order of their patterns."""
    return pages.select(study, page, F.posexplode(K.headings(F.col(text))).alias("ord", "title"))


def named_target(title: str, targets: list[str]) -> list[int]:
    """Places of the targets (lower case) that a title has; a summary "of" something counts only if it is a study and no table."""
    low = title.lower().strip()
    of = " of " in low and (not _STUDY.search(low) or "table" in low)
    return [i for i, t in enumerate(targets) if t.strip() in low and not (of and t in ("summary", "sumnary"))]


def own_title(title: str, heads: list[str], targets: list[str], others: list[str]) -> str | None:
    """The title to start at: title itself if it is a target's alone, else the page's first heading that is."""
    fits = [h for h in (title, *heads) if not _JUNK.search(h) and not _has(h, others) and _has(h, targets)]
    return fits[0] if fits else None


def _has(title: str, words: list[str]) -> bool:
    return any(w in title.lower() for w in words)


def _at(title: str, text: str) -> int:
    """Where a title stands in text as words of its own, -1 if nowhere."""
    m = re.search(r"(?<!\S)" + re.escape(title.strip()) + r"(?!\S)", text, re.IGNORECASE)
    return m.start() if m else -1


def _number(text: str) -> int | None:
    m = _PAGE_NUMBER.search(text)
    return int(m[0].split()[1]) if m else None


def continued_page(at: int, text: str, pages: list[int], texts: dict[int, str], heads: dict[int, list[str]], others: list[str], taken: set[int]) -> tuple[int, str] | None:
    """The page that continues the section of page at, and what of it belongs to the section.

    The first long line of the next page decides. If it opens in lower case, the page goes on up to the first heading
    with one of others. Else it must not be headed by one of others, and has few words or, by the printed "Page N", the
    number behind that of text; pages without a number are inserts, the search goes on behind them.
    """
    nxt = at + 1
    if nxt not in texts or nxt in taken:
        return None
    page = texts[nxt]
    long = next((x for x in map(str.strip, page.split("\n")) if len(x.split()) > LONG_LINE), None)
    if long is None:
        return None
    if long[0].islower():
        cuts = [c for h in heads[nxt] if not _JUNK.search(h) and _has(h, others) and (c := _at(h, page)) >= 0]
        rest = page[: min(cuts)] if cuts else page
        return (nxt, rest) if rest.strip() else None
    if any(h.strip().lower() in others for h in heads[nxt]):
        return None
    if len(page.split()) <= FEW_WORDS:
        return nxt, page
    before = _number(text)
    if before is None:
        return None
    found = next(((p, n) for p in pages[bisect.bisect_left(pages, nxt) :] if (n := _number(texts[p])) is not None), None)
    if found is None or found[1] != before + 1 or found[0] in taken:
        return None
    return found[0], texts[found[0]]


def study_sections(pages: list[tuple[int, str, list[str], bool]], targets: list[str]) -> list[tuple[int, str, str, list[int]]]:
    """(page, title, content, continued pages) of one study's pages (page, text, headings, contents page), in the order of targets and pages.

    A fold: a title counts once, and a page that is part of a section continues no other.
    """
    targets = [t.lower() for t in targets]
    others = [w for w in SECTION_WORDS if w not in targets]
    pages = sorted(pages, key=lambda x: x[0])
    order, texts, heads = [p[0] for p in pages], {p[0]: p[1] for p in pages}, {p[0]: p[2] for p in pages}
    hits = sorted((i, page, k, h) for page, _, hs, toc in pages if not toc for k, h in enumerate(hs) for i in named_target(h, targets))
    seen: set[str] = set()
    taken: set[int] = set()
    out: list[tuple[int, str, str, list[int]]] = []
    for _, page, _, title in hits:
        if title.lower() in seen:
            continue
        text, rest = texts[page], None
        foreign = [h for h in set(heads[page]) if not _JUNK.search(h) and _has(h, others)]
        mine = own_title(title, heads[page], targets, others)
        if foreign and mine:
            title = mine
            m = re.search(re.escape(mine), text, re.IGNORECASE)
            start = m.start() if m else 0
            text = text[start:]
            ends = [e for h in foreign if (e := _at(h, text)) >= CUT_LEAST and e > start]
            text = text[: min(ends)] if ends else text
        taken.add(page)
        if not (foreign and mine):
            rest = continued_page(page, text, order, texts, heads, others, taken)
        seen.add(title.lower())
        if rest:
            taken.add(rest[0])
            seen.add(f"{title}; continued page".lower())
        out.append((page, title, text + "\n" + rest[1] if rest else text, [rest[0]] if rest else []))
    return out


def find_sections(pages: DataFrame, targets: list[str], study: str = "study_id", page: str = "page_num", text: str = "text") -> DataFrame:
    """study, page, title, content, continued, continued_pages: the sections with a target word in their heading.

    Contents pages aren't searched. On a page with a heading of another section (SECTION_WORDS that are no targets) a
    section runs from its own heading to the first such heading far enough behind it, and ends on the page. Else it has
    the whole page and, as continued_page tells, another one, whose number is listed. Pages of a study are numbered from 1.
    """
    low = [t.lower().strip() for t in targets]
    named = F.exists("_h", lambda h: F.exists(F.array(*map(F.lit, low)), lambda t: F.lower(h).contains(t)))
    marked = pages.where(F.col(study).isNotNull() & F.col(page).isNotNull() & F.col(text).isNotNull()).select(F.col(study), F.col(page), F.col(text), K.headings(F.col(text)).alias("_h"))
    marked = marked.withColumn("_hit", named).withColumn("_toc", F.when(F.col("_hit"), K.is_toc(F.col(text), titles=F.col("_h"))).otherwise(False))
    # only studies with such a heading are brought together
    marked = materialised(marked)
    marked = marked.join(marked.where("_hit").select(study).distinct(), study, "left_semi")
    kind = {f.name: f.dataType.simpleString() for f in pages.schema}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = zip(pdf[page].tolist(), pdf[text], pdf["_h"].map(list), pdf["_toc"], strict=True)
        found = study_sections(list(rows), targets)
        return pd.DataFrame([(pdf[study].iloc[0], *f) for f in found], columns=[study, page, "title", "content", "continued_pages"])

    out = marked.groupBy(study).applyInPandas(fold, f"{study} {kind[study]}, {page} {kind[page]}, title string, content string, continued_pages array<{kind[page]}>")
    return out.select(study, page, "title", "content", (F.size("continued_pages") > 0).alias("continued"), "continued_pages")


def title_pages(pages: DataFrame, study: str = "study_id", page: str = "page_num", text: str = "text", first: int = TITLE_FIRST) -> DataFrame:
    """study, page, content: the first page among the first seven that scores as a title page."""
    hits = pages.where((F.col(page) <= first) & (K.title_score(F.col(text)) >= TITLE_LEAST))
    return hits.groupBy(study).agg(F.min(page).alias(page), F.min_by(text, page).alias("content"))


def summaries(pages: DataFrame, study: str = "study_id", page: str = "page_num", text: str = "text") -> DataFrame:
    """study, content, page_nums ("3+4"): the summary sections joined by blank lines."""
    found = find_sections(pages, SUMMARY_TARGETS, study, page, text)
    rows = F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), "title", F.col("content").alias("c"))))
    return found.groupBy(study).agg(rows.alias("r")).select(study, F.array_join(F.transform("r", lambda x: x["c"]), "\n\n").alias("content"), F.array_join(F.transform("r", lambda x: x["p"].cast("string")), "+").alias("page_nums"))


def documents(pages: DataFrame, page: str = "page_num", text: str = "text", first: int | None = None, last: int | None = None, reader=None) -> DataFrame:  # type: ignore[no-untyped-def]
    """Pages of a range as documents: table pages read by reader (rows to rows), contents pages left out.

    Only table pages go through reader; the contents test sees what it gives.
    """
    out = pages
    if first is not None:
        out = out.where(F.col(page) >= first)
    if last is not None:
        out = out.where(F.col(page) <= last)
    if reader is not None:
        marked = out.withColumn("_table", K.is_table(F.col(text)))
        out = marked.where("not _table").drop("_table").unionByName(reader(marked.where("_table").drop("_table")))
    return out.where(~K.is_toc(F.col(text)))
