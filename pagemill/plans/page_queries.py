"""Queries of cleaning, classification, segmentation and assembling, over whole tables.

Pages are those of page_docs: study_id, position (metadata.page_num) and content; of rescans of a position the smallest
page_key is taken where a step needs one page a position. Texts to be cleaned are the contents of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import assemble as A
from pagemill.operators import classify as K
from pagemill.operators import cleaning as C
from pagemill.operators import corpora as B
from pagemill.operators import retrieval as R
from pagemill.operators import sections as S
from pagemill.operators import segment as G
from pagemill.plans import made_queries as M
from pagemill.plans import retrieval_queries as RQ
from pagemill.session import materialised, spread, table
from pagemill.sources import sinks
from pagemill.streaming import ingest


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "docs").select("doc_key", "content"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """study_id, page_num, text: one page a position."""
    p = table(spark, d, "page_docs").select("study_id", F.expr("try_cast(metadata.page_num as int)").alias("page_num"), F.col("content").alias("text"), "page_key").where("content is not null")
    return p.groupBy("study_id", "page_num").agg(F.min_by("text", "page_key").alias("text"))


def _on_docs(name, expression):  # type: ignore[no-untyped-def]
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _docs(spark, d).select("doc_key", expression(F.col("content")).alias(name))

    return query


normalised_newlines = _on_docs("text", C.newlines)
isolated_page_of = _on_docs("text", lambda c: C.isolate_page_of(C.newlines(c)))
toc_line_counts = _on_docs("toc_lines", lambda c: F.coalesce(F.size(C.toc_indices(T.lines(C.newlines(c)))), F.lit(0)))
without_toc_lines = _on_docs("text", lambda c: C.joined(C.without_toc(T.lines(C.newlines(c)))))
without_junk_lines = _on_docs("text", lambda c: C.joined(C.without_junk(T.lines(C.newlines(c)))))
mended_hyphens = _on_docs("text", lambda c: C.mend_hyphens(C.newlines(c)))
mended_spacing = _on_docs("text", lambda c: C.mend_spaced_words(C.newlines(c)))
rejoined_lines = _on_docs("text", lambda c: C.rejoin_wrapped(C.newlines(c)))
tidied = _on_docs("text", lambda c: C.tidy(C.newlines(c)))
clean_text = _on_docs("text", C.clean_page)
plain_text = _on_docs("text", C.plain_text)


def removed_lines(spark: SparkSession, d: str) -> DataFrame:
    out = _docs(spark, d).select("doc_key", C.removed_lines(F.col("content")).alias("r"))
    return out.select("doc_key", F.size("r.toc").alias("toc"), F.size("r.junk").alias("junk")).where("toc > 0 or junk > 0")


def clean_prompts(spark: SparkSession, d: str) -> DataFrame:
    prompt = F.concat(F.lit("Read this.\nBEGIN EXERPT---\n"), F.col("content"), F.lit("\n---END EXERPT\nAnswer."))
    return _docs(spark, d).where("content is not null").select("doc_key", C.clean_prompt(prompt).alias("prompt"))


table_score = _on_docs("score", lambda c: F.round(K.table_score(c), 6))
toc_flag = _on_docs("toc", K.is_toc)
looks_like_toc = _on_docs("toc", K.looks_like_toc)
preface_score = _on_docs("score", lambda c: F.round(K.preface_score(c), 6))
printed_ids = _on_docs("printed_id", K.printed_id)
summary_flag = _on_docs("summary", K.has_summary)
introduction_flag = _on_docs("introduction", K.has_introduction)


def title_score(spark: SparkSession, d: str) -> DataFrame:
    """Title features and score; a null text has no words, no lines and no keywords."""
    out = _docs(spark, d).select("doc_key", K.title_features(F.col("content")).alias("f")).select("doc_key", "f.*")
    return out.fillna(0).fillna(False)


def printed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lines of pages that are a printed page number by the strict rule."""
    lines = table(spark, d, "page_docs").select("page_key", F.posexplode(T.lines(C.newlines(F.col("content")))).alias("line_no", "line"))
    return lines.select("page_key", (F.col("line_no") + 1).alias("line_no"), K.printed_page(F.col("line")).alias("printed_page")).where("printed_page is not null")


def headings(spark: SparkSession, d: str) -> DataFrame:
    return S.heading_rows(_pages(spark, d))


def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _docs(spark, d).select("doc_key", F.posexplode(T.lines(C.newlines(F.col("content")))).alias("line_no", "line"))
    return lines.where(K.is_heading_line(F.col("line"))).select("doc_key", "line_no", F.trim("line").alias("title"))


def text_layer(spark: SparkSession, d: str) -> DataFrame:
    return K.has_text_layer(_pages(spark, d))


def page_features(spark: SparkSession, d: str) -> DataFrame:
    return G.page_features(_pages(spark, d))


def boundary_scores(spark: SparkSession, d: str) -> DataFrame:
    return G.boundary_scores(page_features(spark, d))


def page_batches_lod(spark: SparkSession, d: str) -> DataFrame:
    return G.batches(boundary_scores(spark, d))


def chunk_ranges(spark: SparkSession, d: str) -> DataFrame:
    return G.chunk_ranges(boundary_scores(spark, d))


def toc_entries(spark: SparkSession, d: str) -> DataFrame:
    return G.toc_entries(_pages(spark, d))


def section_spans(spark: SparkSession, d: str) -> DataFrame:
    return G.section_spans(_pages(spark, d))


def integrated_score(spark: SparkSession, d: str) -> DataFrame:
    return G.integrated_score(_pages(spark, d))


def routed_titles(spark: SparkSession, d: str) -> DataFrame:
    """Where a document's own "High -> Low" title sends it."""
    titled = table(spark, d, "docs").select("doc_key", F.col("metadata.title").alias("title")).where("title is not null")
    return G.route_sections(titled).select("doc_key", "route")


def corpora_route(spark: SparkSession, d: str) -> DataFrame:
    return G.corpus_route(_pages(spark, d), boundary_scores(spark, d))


def _corpora(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = materialised(_pages(spark, d).where("study_id is not null and page_num is not null"))
    scores = materialised(boundary_scores(spark, d))
    return B.report_corpora(pages, scores, G.section_spans(pages), materialised(G.corpus_route(pages, scores)))


def report_corpora(spark: SparkSession, d: str) -> DataFrame:
    """Documents of every corpus of every report: chunks, target sections with their shared ones, or the whole report."""
    return _corpora(spark, d)[0].select("study_id", "route", "corpus", "label", "doc", "page_num", "title", "content")


def corpus_heads(spark: SparkSession, d: str) -> DataFrame:
    """Title page and summary of every corpus."""
    return _corpora(spark, d)[1].select("study_id", "route", "corpus", "label", "title_page_num", "summary_pages", "summary")


def found_sections(spark: SparkSession, d: str) -> DataFrame:
    return S.find_sections(_pages(spark, d), ["histology", "pathology", "haematology", "summary"])


def corpus_documents(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each study without contents pages."""
    return S.documents(_pages(spark, d)).select("study_id", "page_num", F.length("text").alias("chars"))


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docs").select("study_id", F.col("doc_key").alias("doc_idx"), "content", F.col("metadata.page_num").alias("page_num"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    docs, questions = _corpus(spark, d), table(spark, d, "questions")
    scored = R.with_silent(R.bm25(docs, R.query_terms(questions), ["study_id"]), docs, questions, ["study_id"], most=R.TOP)
    return R.ranked(scored, ["question_id", "study_id"], most=R.TOP).join(docs, ["study_id", "doc_idx"])


def context_assembly(spark: SparkSession, d: str) -> DataFrame:
    """The smaller job that its SQL states: a study's first document as title page, then BM25 hits; full_context has the whole."""
    firsts = _corpus(spark, d).groupBy("study_id").agg(F.min_by(F.struct("content", "page_num"), "doc_idx").alias("f")).select("study_id", "f.content", "f.page_num")
    none = firsts.where("false")
    out = A.context(_hits(spark, d), firsts, none, ["study_id"])
    return out.select("question_id", "study_id", F.array_join("retrieved_pages", ",").alias("pages"), "length")


def _context(spark: SparkSession, d: str) -> DataFrame:
    """Title page, summary and hybrid hits of every question in every study."""
    docs = _corpus(spark, d).where("content is not null")
    hits = materialised(RQ.full_search(docs, table(spark, d, "questions"), ["study_id"]))
    pages = _pages(spark, d)
    return A.context(hits, S.title_pages(pages), S.summaries(pages).withColumnRenamed("page_nums", "page_num"), ["study_id"], docs=docs)


def full_context(spark: SparkSession, d: str) -> DataFrame:
    """Pages of every question's context in every study: title page, summary and hybrid hits."""
    return _context(spark, d).select("question_id", "study_id", F.array_join("retrieved_pages", ",").alias("pages"), "length")


def prompt_text(spark: SparkSession, d: str) -> DataFrame:
    """Prompts over the full contexts; without guides, since no table is a handbook."""
    found = _context(spark, d).join(F.broadcast(table(spark, d, "questions").select("question_id", "query")), "question_id")
    return found.select("question_id", "study_id", F.md5(A.prompt(F.col("query"), F.col("context"), F.lit(None).cast("string"))).alias("prompt_md5"))


def run_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The prompt of every run state: its retrieved pages as excerpt, its label as guide, with an example of an answer."""
    made = A.prompt(F.col("question"), F.col("retrieved_pages"), F.col("label"), few_shots="Example: PURITY: 92%")
    return table(spark, d, "run_states").select("state_id", F.md5(made).alias("prompt_md5"))


def formatted_answers(spark: SparkSession, d: str) -> DataFrame:
    states = table(spark, d, "run_states")
    return states.select("state_id", A.format_answer(F.col("question_id"), F.col("output")).alias("answer"))


def output_names(spark: SparkSession, d: str) -> DataFrame:
    states = table(spark, d, "run_states").select("study_id", "label", "run_number").distinct()
    return states.select(sinks.output_name(F.col("study_id"), F.col("label"), F.col("run_number"), "response_only").alias("file")).distinct()


def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Study and run pairs that have not answered all questions yet."""
    states = table(spark, d, "run_states")
    keys = ["study_id", "run_number"]
    return A.pending(states.select(*keys).distinct(), A.finished(states, keys), keys)


def latest_states(spark: SparkSession, d: str) -> DataFrame:
    keys = ["study_id", "run_number", "question_id"]
    return A.latest(table(spark, d, "run_states"), keys).select(*keys, "state_id")


def questions_per_corpus(spark: SparkSession, d: str) -> DataFrame:
    studies = table(spark, d, "studies").select("study_id")
    return A.per_question(table(spark, d, "questions").select("question_id"), studies)


def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of every chunk, the shared boundary page twice."""
    return G.pages_of_chunks(chunk_ranges(spark, d), _pages(spark, d)).select("study_id", "page_start", "page_end", "page_num")


def look_ahead(spark: SparkSession, d: str) -> DataFrame:
    """Length of each page and of the eight pages behind it, missing pages skipped."""
    w = Window.partitionBy("study_id").orderBy("page_num").rangeBetween(1, 8)
    return _pages(spark, d).select("study_id", "page_num", F.length("text").alias("chars"), F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).alias("ahead"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return ingest.windowed_counts(table(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


QUERIES = {
    "normalised_newlines": normalised_newlines, "isolated_page_of": isolated_page_of, "toc_line_counts": toc_line_counts, "without_toc_lines": without_toc_lines, "without_junk_lines": without_junk_lines, "mended_hyphens": mended_hyphens,
    "mended_spacing": mended_spacing, "rejoined_lines": rejoined_lines, "tidied": tidied, "clean_text": clean_text, "plain_text": plain_text, "table_score": table_score, "toc_flag": toc_flag, "looks_like_toc": looks_like_toc,
    "preface_score": preface_score, "printed_ids": printed_ids, "summary_flag": summary_flag, "introduction_flag": introduction_flag,
} | {f.__name__: f for f in (removed_lines, clean_prompts, title_score, printed_pages, headings, heading_lines, text_layer, page_features, boundary_scores, page_batches_lod, chunk_ranges, toc_entries, section_spans, integrated_score, routed_titles, corpora_route, report_corpora, corpus_heads, found_sections, corpus_documents, context_assembly, full_context, prompt_text, run_prompts, formatted_answers, output_names, resume_anti_join, latest_states, questions_per_corpus, chunk_pages, look_ahead, event_windows)}

# ---------------------------------------------------------------------------------------------- SQL

_NL = "regexp_replace(content, '\\r\\n?', chr(10), 'g')"
_L = f"string_split({_NL}, chr(10))"
_TOC = r"(regexp_matches(x, '\.{3,}\s*\d{1,3}\s*$') OR (length(x) <= 300 AND regexp_matches(x, '^\s*\d+(?:\.\d+)*\s+') AND regexp_matches(x, '\s{3,}\d{1,3}\s*$')))"
_AT = f"list_filter(list_transform(ls, lambda x, i: CASE WHEN {_TOC} THEN i END), lambda i: i IS NOT NULL)"
_CLUSTER = "len(list_filter(at_, lambda s: len(list_filter(at_, lambda j: j >= s AND j - s <= 30)) >= 3)) > 0"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_S = _STRIP.format("x")
_D = f"replace({_S}, ' ', '')"
_JUNK = rf"(length({_S}) > 0 AND (regexp_matches({_S}, '[\x00-\x08\x0b-\x1f\x7f]|\^[A-Z@\[\\\]^_]') OR (length({_D}) BETWEEN 1 AND 6 AND length(regexp_replace({_D}, '[\p{{L}}\p{{N}}]', '', 'g')) >= length({_D}) * 0.5 AND NOT regexp_matches({_D}, '\p{{N}}'))))"
_PAGES = "p0 AS (SELECT study_id, try_cast(metadata.page_num AS INT) AS page_num, content AS text, page_key FROM page_docs WHERE content IS NOT NULL), p AS (SELECT study_id, page_num, arg_min(text, page_key) AS text FROM p0 GROUP BY ALL)"
_ID = "|".join(w.replace(".", "\\.") for w in K.ID_WORDS)
_LOW = "lower(line)"


def _words(list_: list[str], column: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in list_) + ")"


_HIGH = "lower(CASE WHEN contains(title, '->') THEN trim(regexp_extract(title, '^(.*?)\\s*->', 1)) ELSE title END)"
_LOWT = "lower(trim(regexp_extract(title, '^.*?\\s*->\\s*(.*)$', 1)))"
_SAFE = "regexp_replace({0}, '[\\\\/:*?\"<>|\\s]+', '_', 'g')"

SQL: dict[str, str] = {
    "normalised_newlines": f"SELECT doc_key, {_NL} AS text FROM docs",
    "isolated_page_of": f"SELECT doc_key, regexp_replace({_NL}, '(?i)(\\bpage\\s+\\d{{1,4}}\\s+of\\s+\\d{{1,4}}\\b)', chr(10) || '\\1' || chr(10), 'g') AS text FROM docs",
    "toc_line_counts": f"WITH l AS (SELECT doc_key, {_L} AS ls FROM docs) SELECT doc_key, coalesce(len({_AT}), 0)::INT AS toc_lines FROM l",
    "without_toc_lines": f"WITH l AS (SELECT doc_key, {_L} AS ls FROM docs), a AS (SELECT *, {_AT} AS at_ FROM l) SELECT doc_key, array_to_string(CASE WHEN len(at_) >= 6 AND {_CLUSTER} THEN list_filter(ls, lambda x: NOT {_TOC}) ELSE ls END, chr(10)) AS text FROM a",
    "without_junk_lines": f"WITH l AS (SELECT doc_key, {_L} AS ls FROM docs) SELECT doc_key, array_to_string(list_filter(ls, lambda x: NOT {_JUNK}), chr(10)) AS text FROM l",
    "mended_hyphens": f"SELECT doc_key, regexp_replace(regexp_replace(regexp_replace({_NL}, '[¬\\x{{ad}}]-?\\n\\s*', '-', 'g'), '([a-z])-\\n([a-z])', '\\1\\2', 'g'), '([a-z])-\\n([a-z])', '\\1\\2', 'g') AS text FROM docs",
    "clean_prompts": f"SELECT doc_key, 'Read this.' || chr(10) || 'BEGIN EXCERPT---' || regexp_replace(array_to_string(list_filter(string_split(chr(10) || content || chr(10), chr(10)), lambda x: NOT (length({_S}) > 0 AND NOT regexp_matches({_S}, '\\b(DERMAL|ORAL|INHALATION|TOPICAL|INTRADERMAL|OCCLUSIVE|INDUCTION|CHALLENGE|DOSE|RESULT|CONCLUSION|SUMMARY)\\b') AND regexp_matches({_S}, '^[\\-–—''\"‘’“”]{{1,3}}$'))), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g') || '---END EXCERPT' || chr(10) || 'Answer.' AS prompt FROM docs WHERE content IS NOT NULL",
    "printed_ids": f"SELECT doc_key, nullif(regexp_extract(lower(content), '(?:{_ID})\\s*[:.#-]?\\s*([A-Za-z0-9][A-Za-z0-9._/-]*)', 1), '') AS printed_id FROM docs",
    "printed_pages": f"WITH l AS (SELECT page_key, unnest({_L}) AS line, generate_subscripts({_L}, 1)::INT AS line_no FROM page_docs WHERE content IS NOT NULL), x AS (SELECT page_key, line_no, coalesce(nullif(trim(regexp_extract({_LOW}, '^\\s*(-\\s*\\d{{1,4}}\\s*-|\\[\\s*\\d{{1,4}}\\s*\\]|page\\s+\\d{{1,4}}|page\\s+\\d{{1,4}}\\s+of\\s+\\d{{1,4}})\\s*$', 1)), ''), nullif(trim(regexp_extract({_LOW}, '^\\s*(\\(\\s*\\d{{1,4}}\\s*\\))\\s*$', 1)), ''), nullif(trim(regexp_extract({_LOW}, '^\\s*(\\d{{1,4}}\\s*/\\s*\\d{{1,4}})\\s*$', 1)), '')) AS printed_page FROM l) SELECT * FROM x WHERE printed_page IS NOT NULL",
    "heading_lines": f"WITH l AS (SELECT doc_key, unnest({_L}) AS line, generate_subscripts({_L}, 1)::INT - 1 AS line_no FROM docs WHERE content IS NOT NULL), s AS (SELECT *, {_STRIP.format('line')} AS s FROM l) SELECT doc_key, line_no, trim(line, ' ') AS title FROM s WHERE length(s) > 0 AND right(s, 1) NOT IN ('.', ',', ';', ':') AND len(regexp_split_to_array(s, '\\s+')) BETWEEN 1 AND 6 AND regexp_matches(s, '^\\p{{Lu}}')",
    "text_layer": f"WITH {_PAGES} SELECT study_id, coalesce(sum(CASE WHEN page_num <= 10 THEN length({_STRIP.format('text')}) END), 0) >= 200 AS has_text FROM p GROUP BY study_id",
    "look_ahead": f"WITH {_PAGES} SELECT study_id, page_num, length(text)::INT AS chars, coalesce(sum(length(text)) OVER (PARTITION BY study_id ORDER BY page_num RANGE BETWEEN 1 FOLLOWING AND 8 FOLLOWING), 0)::BIGINT AS ahead FROM p",
    "routed_titles": f"WITH t AS (SELECT doc_key, metadata.title AS title FROM docs WHERE metadata.title IS NOT NULL), h AS (SELECT doc_key, contains(title, '->') AS arrow, {_HIGH} AS high, {_LOWT} AS low FROM t) SELECT doc_key, CASE WHEN arrow AND ({_words(G.NEGATIVES, 'high')} OR {_words(G.NEGATIVES, 'low')}) THEN 'negative' WHEN {_words(G.SHARED_HIGH, 'high')} OR (arrow AND {_words(G.SHARED_LOW, 'low')}) THEN 'shared' WHEN arrow AND {_words(G.TARGETS, 'high')} THEN 'target' END AS route FROM h",
    "formatted_answers": "WITH a AS (SELECT state_id, question_id, output, regexp_replace(regexp_replace(regexp_replace(output, '[\\s\\p{Z}]+', ' ', 'g'), '[.\\s]+$', ''), '^\\s+|\\s+$', '', 'g') AS a FROM run_states) SELECT state_id, CASE WHEN output IS NULL OR regexp_matches(a, '(?i)^(null|none|)$') THEN 'Null : Null' ELSE upper(question_id) || ' : ' || a END AS answer FROM a",
    "output_names": f"SELECT DISTINCT {_SAFE.format('study_id')} || CASE WHEN label IS NOT NULL AND length(label) > 0 THEN '_' || {_SAFE.format('label')} ELSE '' END || '_run_' || run_number::VARCHAR || '_response_only.txt' AS file FROM run_states",
    "resume_anti_join": "SELECT study_id, run_number FROM run_states GROUP BY ALL HAVING count(DISTINCT question_id) < 11",
    "latest_states": "SELECT study_id, run_number, question_id, state_id FROM run_states QUALIFY row_number() OVER (PARTITION BY study_id, run_number, question_id ORDER BY finished_at DESC NULLS LAST, state_id DESC) = 1",
    "questions_per_corpus": "SELECT study_id, question_id FROM studies CROSS JOIN questions",
    "event_windows": "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS events FROM events GROUP BY ALL",
}
SQL["tidied"] = f"SELECT doc_key, {_STRIP.format('t')} AS text FROM (SELECT doc_key, regexp_replace(array_to_string(list_transform({_L}, lambda x: regexp_replace(x, '\\s+$', '')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM docs)"

_SAME = "(regexp_matches(x, '(?i)^\\s*.+?\\s*\\.{2,}\\s*[ivxlcdm\\d]+\\s*$') OR regexp_matches(x, '(?i)^\\s*.+?\\s{2,}[ivxlcdm\\d]+\\s*$'))"
_LONE = "(regexp_matches(x, '^\\d{1,4}$') OR (regexp_matches(x, '(?i)^[mdclxvi]{2,}$') AND regexp_matches(x, '(?i)^m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$')))"
SQL["looks_like_toc"] = f"WITH l AS (SELECT doc_key, content, list_filter(list_transform(string_split({_NL}, chr(10)), lambda x: {_S}), lambda x: length(x) > 0) AS ls FROM docs) SELECT doc_key, coalesce(regexp_matches(content, '(?i)\\bcontents\\b') OR len(list_filter(ls, lambda x: {_SAME})) >= 4 OR len(list_filter(ls, lambda x: {_LONE})) >= 4, false) AS toc FROM l"
_ON_DOCS = RQ._BASE.replace("FROM documents", "FROM (SELECT study_id AS source, doc_key AS doc_id, content AS text FROM docs)")
SQL["context_assembly"] = f"""WITH {_ON_DOCS}, {RQ._ALL_SCORED},
o AS (SELECT *, row_number() OVER (PARTITION BY question_id, source ORDER BY score DESC, doc_idx DESC) AS rank FROM s QUALIFY rank <= 3),
f AS (SELECT study_id, arg_min_null(metadata.page_num, doc_key) AS first FROM docs GROUP BY study_id)
SELECT question_id, source AS study_id, array_to_string(list_filter(list_concat([max(first)], list(metadata.page_num ORDER BY rank)), lambda x: x IS NOT NULL), ',') AS pages, (1 + count(*))::INT AS length
FROM o JOIN docs ON docs.doc_key = o.doc_idx JOIN f ON f.study_id = source GROUP BY question_id, source"""

# stages of the cleaning chain as steps from one text column to the next
_MARKED = "chr(63743)"
_WORDS = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+"
_SPACED = r"\b(?:[a-z] ){2,}[a-z]\b"


def _spacing(t: str) -> str:
    closed = f"array_to_string(list_transform(regexp_split_to_array({t}, '{_SPACED}'), lambda s, i: s || coalesce(replace(regexp_extract_all({t}, '{_SPACED}')[i], ' ', ''), '')), '')"
    words = f"regexp_extract_all({t}, '{_WORDS}')"
    return f"CASE WHEN len({words}) > 0 AND len(list_filter({words}, lambda w: length(w) = 1)) >= len({words}) * 0.2 THEN {closed} ELSE {t} END"


def _rejoining(source: str, t: str) -> str:
    """Steps g, l and w from the column t of source."""
    wrapped = r"""len(list_filter(ls, lambda x, i: i < len(ls) AND NOT regexp_matches(x, '^\s*$') AND NOT regexp_matches(x, '[.!?:;]\s*$') AND regexp_matches(ls[i + 1], '^\s*[a-z("]')))"""
    return f"g AS (SELECT *, regexp_replace({t}, '\\n{{2,}}', {_MARKED}, 'g') AS g FROM {source}), l AS (SELECT *, string_split(g, chr(10)) AS ls FROM g), w AS (SELECT *, {wrapped} AS n FROM l)"


_JOIN = r"""'(^|[^.!?:;])\n([a-z("])', '\1 \2', 'g'"""
_REJOINED = f"replace(CASE WHEN n >= len(ls) * 0.25 THEN regexp_replace(regexp_replace(g, {_JOIN}), {_JOIN}) ELSE g END, {_MARKED}, chr(10) || chr(10))"
_HYPHENS = r"regexp_replace(regexp_replace(regexp_replace({0}, '[¬\x{{ad}}]-?\n\s*', '-', 'g'), '([a-z])-\n([a-z])', '\1\2', 'g'), '([a-z])-\n([a-z])', '\1\2', 'g')"
SQL["mended_spacing"] = f"WITH t AS (SELECT doc_key, {_NL} AS t FROM docs) SELECT doc_key, {_spacing('t')} AS text FROM t"
SQL["rejoined_lines"] = f"WITH t AS (SELECT doc_key, {_NL} AS t FROM docs), {_rejoining('t', 't')} SELECT doc_key, {_REJOINED} AS text FROM w"
SQL["clean_text"] = rf"""WITH c0 AS (SELECT doc_key, string_split(regexp_replace({_NL}, '(?i)(\bpage\s+\d{{1,4}}\s+of\s+\d{{1,4}}\b)', chr(10) || '\1' || chr(10), 'g'), chr(10)) AS ls FROM docs),
c1 AS (SELECT doc_key, ls, {_AT} AS at_ FROM c0),
c2 AS (SELECT doc_key, CASE WHEN len(at_) >= 6 AND {_CLUSTER} THEN list_filter(ls, lambda x: NOT {_TOC}) ELSE ls END AS ls FROM c1),
c3 AS (SELECT doc_key, array_to_string(list_filter(ls, lambda x: NOT {_JUNK}), chr(10)) AS t FROM c2),
c4 AS (SELECT doc_key, {_HYPHENS.format('t')} AS t FROM c3), c5 AS (SELECT doc_key, {_spacing('t')} AS t FROM c4), {_rejoining('c5', 't')},
c6 AS (SELECT doc_key, {_REJOINED} AS t FROM w)
SELECT doc_key, {_STRIP.format('t')} AS text FROM (SELECT doc_key, regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '\s+$', '')), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM c6)"""

# headings: capital lines by their pattern; title lines by line, as the pattern looks ahead to the next line's capital
_CAPITAL = K.CAPITAL_HEADING.replace("(?Udm)", "(?m)").replace("'", "''")
_TITLE_LINE = rf"^[ \t]*(?:{K.TITLE_WORD}(?:[ \t]+{K.TITLE_WORD})*|[A-Z0-9][A-Z0-9 \t\-–—]{{2,}})[ \t]*$"
_IS_TITLE = f"(regexp_matches(x, '{_TITLE_LINE}') AND regexp_matches(x, '[A-Za-z]'))"


def _headings(text: str) -> str:
    """h: the headings of text, from nb, its lines that aren't blank."""
    before = _IS_TITLE.replace("(x,", "(nb[i - 1],")
    own = f"list_filter(nb, lambda x, i: i < len(nb) AND {_IS_TITLE} AND regexp_matches(nb[i + 1], '^\\s*[A-Z]') AND NOT (i > 1 AND regexp_matches(x, '^\\s') AND {before}))"
    trimmed = f"lambda x: {_S}"
    return f"list_concat(list_transform(regexp_extract_all({text}, '{_CAPITAL}'), {trimmed}), list_transform({own}, {trimmed}))"


def _with_headings(columns: str, text: str, table_: str) -> str:
    return f"n AS (SELECT {columns}, {text} AS tx, list_filter(string_split({text}, chr(10)), lambda x: NOT regexp_matches(x, '^\\s*$')) AS nb FROM {table_}), h AS (SELECT {columns}, {_headings('tx')} AS h FROM n)"


_FEW = r"len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: length(w) > 0)) <= 2"
_SUMMARY = f"CASE WHEN contains(lower(x), 'summary of') OR contains(lower(x), 'sumnary of') THEN contains(lower(x), 'study') OR contains(lower(x), 'report') OR contains(lower(x), 'results') ELSE (contains(lower(x), 'summary') OR contains(lower(x), 'sumnary') OR contains(lower(x), 'abstract')) AND {_FEW} END"
SQL["headings"] = f"WITH {_PAGES}, {_with_headings('study_id, page_num', 'text', 'p')} SELECT study_id, page_num, unnest(h) AS title, (generate_subscripts(h, 1) - 1)::INT AS ord FROM h"
SQL["summary_flag"] = f"WITH {_with_headings('doc_key', 'content', 'docs')} SELECT doc_key, coalesce(len(list_filter(h, lambda x: {_SUMMARY})) > 0, false)::INT AS summary FROM h"
SQL["introduction_flag"] = f"WITH {_with_headings('doc_key', 'content', 'docs')} SELECT doc_key, coalesce(len(list_filter(h, lambda x: (contains(lower(x), 'introduction') OR contains(lower(x), '1troduction')) AND {_FEW})) > 0, false)::INT AS introduction FROM h"

# table, contents, title and preface scores; numbers are found place by place, as this SQL's patterns can't look around
_W = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}.]"
_NW = r"(?:[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}.]|$)"
_NUM = r"[-+]?\d+(?:,\d{3})*(?:\.\d+)?(?:[eE][-+]?\d+)?%?"
_BLANK_RUN = r"[\s\x1c-\x1f]+"
_FULL = rf"list_filter(list_transform(regexp_split_to_array(tx, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, '^{_BLANK_RUN}|{_BLANK_RUN}$', '', 'g')), lambda x: length(x) > 0)"


def _count(pattern: str, column: str = "tx") -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


def _nwords(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{_BLANK_RUN}'), lambda w: length(w) > 0))"


def _has(words: list[str], column: str = "low") -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _sum(words: list[str], column: str = "low") -> str:
    return "(" + " + ".join(f"contains({column}, '{w}')::INT" for w in words) + ")"


def _m(pattern: str) -> str:
    """A pattern over lines in the SQL's dialect."""
    return pattern.replace("(?Udm)", "(?m)").replace("(?iUdm)", "(?im)").replace("'", "''")


def _scored(columns: str, text: str, source: str) -> str:
    """Steps up to z: columns, the text (tx) and its scores: ts (table), toc, words, long, short, nlines, low, h (headings)."""
    starts = rf"list_filter(range(1, length(x) + 1), lambda i: regexp_matches(substr(x, i, 1), '[-+0-9]') AND (i = 1 OR NOT regexp_matches(substr(x, i - 1, 1), '{_W}')) AND regexp_matches(substr(x, i), '^{_NUM}{_NW}'))"
    number = rf"list_transform({starts}, lambda i: {{'s': i, 'e': i + length(regexp_extract(substr(x, i), '^({_NUM}){_NW}', 1))}})"
    decimals = rf"len(list_filter(range(1, length(tx) + 1), lambda i: regexp_matches(substr(tx, i, 1), '[0-9]') AND (i = 1 OR NOT regexp_matches(substr(tx, i - 1, 1), '{_W}')) AND regexp_matches(substr(tx, i, 40), '^\d+\.\d+{_NW}')))"
    # a contents line: a number behind dots or blanks on its own line, or alone on the next line behind more than a line feed
    few = "len(regexp_extract_all(x, '[0-9]')) < 3"
    same = r"regexp_matches(x, '^[^\n]{3,80}?(?:\.{2,}|\s{2,})\d{1,3}\s*$')"
    apart = r"(regexp_matches(x, '^.{3,80}?\s*$') AND length(regexp_replace(x, '\s+$', '')) <= 80 AND length(x) >= 3 AND regexp_matches(array_to_string(raw[i:i + 6], chr(10)), '^[^\n]{3,80}?\s{2,}\d{1,3}\s*(?:\n|$)') AND NOT regexp_matches(x, '\d\s*$'))"
    return rf"""s0 AS (SELECT row_number() OVER () AS id, {columns}, {text} AS tx FROM {source}),
s1 AS (SELECT *, lower(tx) AS low, {_FULL} AS ls, string_split(tx, chr(10)) AS raw, list_filter(string_split(tx, chr(10)), lambda x: NOT regexp_matches(x, '^\s*$')) AS nb, tx IS NULL OR length(regexp_replace(tx, '^{_BLANK_RUN}|{_BLANK_RUN}$', '', 'g')) = 0 AS blank FROM s0),
u0 AS (SELECT id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM s1), u1 AS (SELECT id, i, length(x) AS len, {number} AS c, {_nwords('x')} AS nw FROM u0),
u2 AS (SELECT id, i, len, nw, len(list_filter(c, lambda a: len(list_filter(c, lambda b: b.s < a.s AND a.s < b.e)) = 0)) AS n FROM u1),
u3 AS (SELECT *, count(*) FILTER (len > 30) OVER (PARTITION BY id ORDER BY i) AS run FROM u2),
u4 AS (SELECT *, CASE WHEN len <= 30 THEN row_number() OVER (PARTITION BY id, run, len <= 30 ORDER BY i) END AS k, sum((n > 0)::INT) OVER (PARTITION BY id, run, len <= 30 ORDER BY i) AS d FROM u3),
u5 AS (SELECT id, bool_or(coalesce(k >= 5 AND d >= k * 0.4, false)) AS run, count(*) AS nlines, count(*) FILTER (n >= 6) AS many, count(*) FILTER (nw > 15) AS long, count(*) FILTER (nw <= 6) AS short FROM u4 GROUP BY id),
y AS (SELECT s1.*, coalesce(u5.nlines, 0) AS nlines, coalesce(long, 0) AS long, coalesce(short, 0) AS short, {_headings('tx')} AS h, CASE WHEN blank THEN 0::DOUBLE ELSE least(round(
  CASE WHEN regexp_matches(tx, '(?i)\btables?\s+\d+(?:\s*-\s*\d+)?\b') THEN 0.5 ELSE 0 END::DOUBLE + least({decimals} / 8.0::DOUBLE, 1.0) * 0.2::DOUBLE + least(coalesce(many, 0) / greatest(coalesce(u5.nlines, 0), 1) / 0.6::DOUBLE, 1.0) * 0.2::DOUBLE + least(coalesce(many, 0) / greatest(coalesce(u5.nlines, 0), 1) / 0.6::DOUBLE, 1.0) * 0.15::DOUBLE
  + CASE WHEN regexp_matches(tx, '\b[pP]\s*[<>]=?\s*0?\.\d+') THEN 0.1 ELSE 0 END::DOUBLE + CASE WHEN coalesce(run, false) THEN 0.15 ELSE 0 END::DOUBLE, 9), 1.0) END AS ts,
  {_count(_m(K.SECTION_NUMBER))} + {_count(_m(K.CAPITAL_LINE))} + CASE WHEN regexp_matches(tx, '(?m)(?:\.\.|\s\s)\d{{1,3}}\s*$') THEN len(list_filter(raw, lambda x, i: {few} AND ({same} OR {apart}))) ELSE 0 END AS like_ FROM s1 LEFT JOIN u5 USING (id)),
z AS (SELECT *, {_count(_WORDS)} AS words, CASE WHEN blank THEN false WHEN {_nwords('tx')} < 100 AND contains(low, 'table of contents') THEN true WHEN len(list_filter(h, lambda x: contains(lower(x), 'contents'))) > 0 THEN true WHEN ts >= 0.7 THEN false
  ELSE regexp_matches(tx, '{_m(K.CONTENTS_LINE)}') OR (like_ + CASE WHEN like_ >= 4 THEN {_count(_m(K.LONE_PAGE))} ELSE 0 END >= 4 AND like_ + CASE WHEN like_ >= 4 THEN {_count(_m(K.LONE_PAGE))} ELSE 0 END >= nlines * 0.2) END AS toc FROM y)"""


_APPENDIX = _has(K.APPENDIX_WORDS)
_FEWER = f"CASE WHEN words < 70 THEN CASE WHEN {_APPENDIX} THEN 0 ELSE 6 END WHEN words < 100 THEN CASE WHEN {_APPENDIX} THEN 0 ELSE 3 END WHEN words < 150 THEN CASE WHEN {_APPENDIX} THEN 0 ELSE 2 END ELSE -6 END"
_TITLE = f"CASE WHEN blank THEN 0.0 ELSE greatest(0.0, least(({_FEWER} + (CASE WHEN long <= 2 THEN 2 ELSE 0 END) + (CASE WHEN short >= nlines * 0.5 THEN 2 ELSE 0 END) + least({_sum(K.TITLE_KEYWORDS)}, 5) - {_sum(K.SECTION_WORDS)} - (CASE WHEN {_APPENDIX} THEN 4 ELSE 0 END) - (CASE WHEN toc THEN 4 ELSE 0 END) - (CASE WHEN ts >= 0.9 THEN 8 ELSE 0 END)) / 12.0::DOUBLE, 1.0)) END"
_BY_BLANK = "len(string_split(tx, ' '))"
_SECTIONS = f"len(list_filter(h, lambda x: {_has(K.SECTION_TITLES, 'lower(x)')}))"
_PREFACE = f"CASE WHEN blank THEN 0.0 ELSE greatest(0.0, least(((CASE WHEN {_BY_BLANK} < 150 THEN 2 WHEN {_BY_BLANK} < 210 THEN 1 ELSE -4 END) + (CASE WHEN {_has(K.PREFACE_WORDS)} THEN CASE WHEN {_has(K.SIGNING_WORDS)} THEN 8 ELSE 4 END ELSE 0 END) + (CASE WHEN {_SECTIONS} < 1 AND {_has(K.PREFACE_WORDS)} THEN 4 ELSE 0 END) - (CASE WHEN {_SECTIONS} > 1 THEN 1 ELSE 0 END) - (CASE WHEN {_APPENDIX} THEN 4 ELSE 0 END) - (CASE WHEN toc THEN 4 ELSE 0 END) - (CASE WHEN ts >= 0.7 THEN 4 ELSE 0 END)) / 8.0::DOUBLE, 1.0)) END"
_DOC_SCORES = _scored("doc_key", "content", "docs")
SQL["table_score"] = f"WITH {_DOC_SCORES} SELECT doc_key, round(ts, 6) AS score FROM z"
SQL["toc_flag"] = f"WITH {_DOC_SCORES} SELECT doc_key, toc FROM z"
SQL["preface_score"] = f"WITH {_DOC_SCORES} SELECT doc_key, round({_PREFACE}, 6) AS score FROM z"
SQL["title_score"] = f"WITH {_DOC_SCORES} SELECT doc_key, coalesce(words, 0)::INT AS word_count, long::INT AS long_lines, short::INT AS short_lines, coalesce({_sum(K.TITLE_KEYWORDS)}, 0)::INT AS title_keywords, coalesce({_sum(K.SECTION_WORDS)}, 0)::INT AS section_words, coalesce({_APPENDIX}, false) AS appendix, toc, ts >= 0.9 AS \"table\", round({_TITLE}, 6) AS score FROM z"

_PRINTED = "coalesce(" + ", ".join(f"nullif(regexp_replace(regexp_extract(low, '{p}', 1), '^\\s+|\\s+$', '', 'g'), '')" for p in (r"(?i)^\s*(-\s*\d{1,4}\s*-|\[\s*\d{1,4}\s*\]|page\s+\d{1,4}|page\s+\d{1,4}\s+of\s+\d{1,4})\s*$", r"^\s*(\(\s*\d{1,4}\s*\))\s*$", r"^\s*(\d{1,4}\s*/\s*\d{1,4})\s*$")) + ")"
_PID = rf"nullif(regexp_extract(low, '(?:{_ID})\s*[:.#-]?\s*([A-Za-z0-9][A-Za-z0-9._/-]*)', 1), '')"
_IS_INTRO = f"(contains(lower(x), 'introduction') OR contains(lower(x), '1troduction')) AND {_FEW}"
_FEATURES = f"""{_PAGES}, {_scored('study_id, page_num', 'text', 'p')},
f AS (SELECT study_id, page_num, toc::INT AS toc_score, CASE WHEN toc THEN 0 ELSE round({_TITLE}, 6) END::DOUBLE AS title_page_score, CASE WHEN toc THEN 0 ELSE round({_PREFACE}, 6) END::DOUBLE AS study_preface_score, CASE WHEN toc THEN NULL ELSE {_PRINTED} END AS pdf_page_num, CASE WHEN toc THEN NULL ELSE {_PID} END AS printed_id,
  CASE WHEN toc THEN 0 ELSE (len(list_filter(h, lambda x: {_SUMMARY})) > 0)::INT END AS summary_score, CASE WHEN toc THEN 0 ELSE (len(list_filter(h, lambda x: {_IS_INTRO})) > 0)::INT END AS intro_score FROM z)"""
SQL["page_features"] = f"WITH {_FEATURES} FROM f"
SQL["boundary_scores"] = f"WITH {M.boundary_steps(_FEATURES, False, True)} FROM b"
SQL["page_batches_lod"] = f"WITH {M.boundary_steps(_FEATURES, False, True)}, {M.BATCH_STEPS} {M.BATCHES}"
SQL["corpus_documents"] = f"WITH {_PAGES}, {_scored('study_id, page_num', 'text', 'p')} SELECT study_id, page_num, length(tx)::INT AS chars FROM z WHERE NOT toc"

# plain text: a line is inside a table block if the last tabular line before it has no long line of text behind it
_ANY = lambda patterns, x: "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in patterns) + ")"
_SQL_END = lambda patterns: [p.replace("\\z", "$") for p in patterns]
_DROPPED = f"({_ANY(_SQL_END((*C.HEADERS, *C.FOOTERS)), 'x')} OR (x = upper(x) AND regexp_matches(x, '\\p{{Lu}}') AND length(x) > 3))"
_TABULAR = f"({_ANY((*C.TABLE_LINES, *C.STATISTICS), 'x')} OR {_has(list(C.TABLE_WORDS), 'lower(x)')} OR len(regexp_extract_all(x, '\\t')) > 2 OR len(regexp_extract_all(x, '  ')) > 3)"
SQL["plain_text"] = rf"""WITH l0 AS (SELECT doc_key, list_filter(list_transform(string_split(content, chr(10)), lambda x: {_S}), lambda x: length(x) > 0 AND NOT {_DROPPED}) AS ls FROM docs),
l1 AS (SELECT doc_key, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM l0),
l2 AS (SELECT *, {_TABULAR} AS tab, ({_nwords('x')} > 5 OR length(x) > 60) AS long FROM l1),
l3 AS (SELECT *, max(CASE WHEN tab THEN i END) OVER w AS t, max(CASE WHEN long AND NOT tab THEN i END) OVER w AS n FROM l2 WINDOW w AS (PARTITION BY doc_key ORDER BY i)),
l4 AS (SELECT doc_key, i, regexp_replace(regexp_replace(regexp_replace(x, '\([^)]*\b(p|SD|SE|SEM|n)\b[^)]*\)', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS own FROM l3 WHERE coalesce(t, 0) <= coalesce(n, 0)),
l5 AS (SELECT doc_key, string_agg(own, chr(10) ORDER BY i) AS o FROM l4 WHERE length(own) > 0 GROUP BY doc_key)
SELECT docs.doc_key, CASE WHEN content IS NULL THEN NULL ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(o, ''), '\b(SD|SE|SEM)\b\s*[<>]?=\s*\d+\.?\d*', '', 'g'), '\d+\s*±\s*\d+', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') END AS text FROM docs LEFT JOIN l5 USING (doc_key)"""
SQL["removed_lines"] = rf"""WITH c0 AS (SELECT doc_key, string_split(regexp_replace({_NL}, '(?i)(\bpage\s+\d{{1,4}}\s+of\s+\d{{1,4}}\b)', chr(10) || '\1' || chr(10), 'g'), chr(10)) AS ls FROM docs WHERE content IS NOT NULL),
c1 AS (SELECT *, {_AT} AS at_ FROM c0), c2 AS (SELECT *, CASE WHEN len(at_) >= 6 AND {_CLUSTER} THEN list_filter(ls, lambda x: NOT {_TOC}) ELSE ls END AS kept FROM c1), c3 AS (SELECT *, list_filter(kept, lambda x: NOT {_JUNK}) AS last FROM c2)
SELECT doc_key, len(list_distinct(list_filter(ls, lambda x: NOT list_contains(kept, x))))::INT AS toc, len(list_distinct(list_filter(kept, lambda x: NOT list_contains(last, x))))::INT AS junk FROM c3 WHERE toc > 0 OR junk > 0"""
_CHUNKS = f"WITH RECURSIVE {M.boundary_steps(_FEATURES, False, True)}, {M.CHUNK_STEPS}"
SQL["chunk_ranges"] = f"{_CHUNKS} FROM chunks"
SQL["chunk_pages"] = f"{_CHUNKS} SELECT chunks.study_id, page_start, page_end, page_num FROM chunks JOIN f ON f.study_id = chunks.study_id AND page_num BETWEEN page_start AND page_end"
SQL["run_prompts"] = f"""SELECT state_id, md5(CASE WHEN coalesce(len(retrieved_pages), 0) > 0 THEN 'Answer from the excerpt alone.' || n || q || CASE WHEN length(label) > 0 THEN n || 'Guide:' || chr(10) || label ELSE '' END || n || 'Example: PURITY: 92%' || n || 'Ignore parts of the report that don''t help.' || n
  || 'BEGIN EXCERPT-----' || chr(10) || array_to_string(list_filter(retrieved_pages, lambda x: x IS NOT NULL), chr(10) || chr(10)) || chr(10) || '-----END EXCERPT' || n || 'Give your answer now, and nothing behind it.' ELSE q || n || 'No page of the report answers this question; it has no answer.' END) AS prompt_md5
FROM (SELECT *, chr(10) || chr(10) AS n, 'Question: ' || coalesce({_STRIP.format('question')}, '') AS q FROM run_states)"""
