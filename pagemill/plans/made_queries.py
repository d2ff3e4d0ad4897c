"""Segmentation over reports that are made, by rules that SQL states too, from orders and customers.

The test tables hold no long report with contents, sections and boundaries. So page features are made of orders (400 to a
report) and texts of customers (a report each, of nine pages: contents, then two pages for each of four sections). What
the operators must find in them follows from the rules; the SQL says it from the tables alone, over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import assemble as A
from pagemill.operators import corpora as B
from pagemill.operators import segment as G
from pagemill.session import materialised, spread, table

PAGES = 400


def made_features(spark: SparkSession, d: str) -> DataFrame:
    """Page features as page_features gives them; the place of a page is its order's key."""
    h = F.floor("o_totalprice").cast("long")
    o = table(spark, d, "orders").select(F.expr(f"concat('L', o_orderkey div {PAGES})").alias("study_id"), F.expr(f"cast(o_orderkey % {PAGES} as int) + 1").alias("page_num"), (h % 97).alias("a"), h.alias("h"), "o_orderstatus")
    tenth = (F.col("h") % 11) / F.lit(10.0)
    of = lambda lo, hi: F.col("a").between(lo, hi)
    pid = F.when((F.col("a") % 3 == 0) & (F.col("a") > 0), F.concat(F.lit("id-"), "o_orderstatus", (F.col("h") % 2).cast("string")))
    return o.select("study_id", "page_num", (F.col("a") == 0).cast("int").alias("toc_score"), F.when(of(1, 6), tenth).otherwise(0.0).alias("title_page_score"), F.when(of(7, 12), tenth).otherwise(0.0).alias("study_preface_score"), of(13, 14).cast("int").alias("summary_score"), of(15, 16).cast("int").alias("intro_score"), pid.alias("printed_id"))


def made_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return G.boundary_scores(made_features(spark, d))


def made_boundaries_around(spark: SparkSession, d: str) -> DataFrame:
    """The other reading: gains from all kinds of pages around, and each page's own id."""
    return G.boundary_scores(made_features(spark, d), look_around=True, stale_id=False)


def made_batches(spark: SparkSession, d: str) -> DataFrame:
    return G.batches(made_boundaries(spark, d))


def made_chunks(spark: SparkSession, d: str) -> DataFrame:
    return G.chunk_ranges(made_boundaries(spark, d))


def made_chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    """How many pages each chunk has, and the sum of their numbers, the shared boundary page counted twice."""
    pages = G.pages_of_chunks(made_chunks(spark, d), made_features(spark, d).select("study_id", "page_num"))
    return pages.groupBy("study_id", "page_start", "page_end").agg(F.count("*").alias("pages"), F.sum("page_num").alias("sum"))


def made_chunk_titles(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose first page's text has a target word; a page's text says its order's status and number."""
    pages = made_features(spark, d).select("study_id", "page_num", F.concat(F.lit("Status "), F.coalesce("printed_id", F.lit("NONE")), F.lit(" on page "), F.col("page_num").cast("string")).alias("text"))
    return G.chunk_titles(made_chunks(spark, d), pages, ["none on", "ID-F"]).select("study_id", "page_start", "page_end", "title")


def made_pages(spark: SparkSession, d: str) -> DataFrame:
    """study_id, page_num, text of the made reports."""
    n = F.col("c_custkey").cast("string")
    titles = F.array(F.lit("SUMMARY OF PROJECT"), F.lit("TOXICOLOGICAL ASSESSMENT"), F.concat(F.lit("CHEMISTRY OF "), "c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, "RESIDUES ASSESSMENT").otherwise("ANNEX TABLES"))
    c = spread(table(spark, d, "customer")).select(F.concat(F.lit("C"), n).alias("study_id"), "c_custkey", n.alias("n"), titles.alias("titles"))
    contents = F.concat(F.lit("CONTENTS\n"), F.array_join(F.transform("titles", lambda t, i: F.concat(t, F.lit(" ..... "), ((i + 1) * 2).cast("string"))), "\n"))
    nth = lambda w: F.concat(F.lit(f"The {w} text of report "), "n", F.lit(" stands here."))
    third = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("\nSummary of findings\n"), nth("third"))).otherwise("")
    subs = F.concat(F.lit("\nAcute study\n"), nth("first"), F.lit("\nRepeated study\n"), nth("second"), third)
    deep = (F.col("k") == 2) | ((F.col("k") == 4) & (F.col("c_custkey") % 2 == 0))
    opening = F.concat(F.element_at("titles", F.col("k")), F.when(deep, subs).otherwise(F.concat(F.lit("\n"), nth("only"))))
    on = F.concat(F.lit("The text of report "), "n", F.lit(" goes on here."))
    body = c.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumn("second", F.explode(F.array(F.lit(0), F.lit(1))))
    return c.select("study_id", F.lit(1).alias("page_num"), contents.alias("text")).unionByName(body.select("study_id", (F.col("k") * 2 + F.col("second")).alias("page_num"), F.when(F.col("second") == 0, opening).otherwise(on).alias("text")))


def made_toc_entries(spark: SparkSession, d: str) -> DataFrame:
    return G.toc_entries(made_pages(spark, d))


def made_section_spans(spark: SparkSession, d: str) -> DataFrame:
    return G.section_spans(made_pages(spark, d))


def made_integrated(spark: SparkSession, d: str) -> DataFrame:
    return G.integrated_score(made_pages(spark, d))


def made_corpora(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the corpora of integrated reports: each target section behind the shared ones."""
    return B.integrated_corpora(materialised(made_section_spans(spark, d)))


def made_routes(spark: SparkSession, d: str) -> DataFrame:
    """The length of a report is asked first: shorter ones than are ever cut need no boundary scores."""
    pages = materialised(made_pages(spark, d))
    return G.corpus_route(pages, G.boundary_scores(G.page_features(G.long_reports(pages))))


def made_guides(spark: SparkSession, d: str) -> DataFrame:
    """The handbook page that a reply chooses, 0 where it chooses none: issuers are the handbook's pages, customers the replies.

    A handbook is one document, so its titles (one a page) come to the driver.
    """
    issuers = table(spark, d, "issuers").select(F.substring("issuer", 4, 9).cast("int").alias("page_num"), F.concat(F.lit("Preface.\n+++ "), "issuer_name", F.lit(" Guide +++\nHow to read reports of "), "issuer_name", F.lit(".")).alias("text"))
    titles = materialised(A.guide_titles(issuers))
    named = titles.select("page_num", "title")
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 24 + 1).alias("a"), ((F.col("c_custkey") + 7) % 24 + 1).alias("b"))
    both = c.join(F.broadcast(named.withColumnsRenamed({"page_num": "a", "title": "t1"})), "a").join(F.broadcast(named.withColumnsRenamed({"page_num": "b", "title": "t2"})), "b")
    k = F.col("c_custkey") % 4
    reply = F.when(k == 0, F.concat(F.lit("Take the "), "t1", F.lit("."))).when(k == 1, F.concat("t1", F.lit(" is wrong here; what is asked for stands in the chapter that is called "), "t2")).when(k == 2, F.lit("non")).otherwise(F.concat("t1", F.lit(" or rather "), "t2"))
    chosen = A.choose_guides(both.select("c_custkey", reply.alias("reply")), [r[0] for r in named.select("title").collect()])
    return chosen.join(F.broadcast(titles.select(F.col("title").alias("guide"), "page_num")), "guide", "left").select("c_custkey", "guide", F.coalesce("page_num", F.lit(0)).alias("page_num"))


QUERIES = {f.__name__: f for f in (made_features, made_boundaries, made_boundaries_around, made_batches, made_chunks, made_chunk_pages, made_chunk_titles, made_pages, made_toc_entries, made_section_spans, made_integrated, made_corpora, made_routes, made_guides)}

# ---------------------------------------------------------------------------------------------- SQL

_F = f"""o AS (SELECT 'L' || (o_orderkey // {PAGES}) AS study_id, (o_orderkey % {PAGES})::INT + 1 AS page_num, floor(o_totalprice)::BIGINT AS h, floor(o_totalprice)::BIGINT % 97 AS a, o_orderstatus AS st FROM orders),
f AS (SELECT study_id, page_num, (a = 0)::INT AS toc_score, CASE WHEN a BETWEEN 1 AND 6 THEN (h % 11) / 10.0 ELSE 0 END::DOUBLE AS title_page_score, CASE WHEN a BETWEEN 7 AND 12 THEN (h % 11) / 10.0 ELSE 0 END::DOUBLE AS study_preface_score,
  (a BETWEEN 13 AND 14)::INT AS summary_score, (a BETWEEN 15 AND 16)::INT AS intro_score, CASE WHEN a % 3 = 0 AND a > 0 THEN 'id-' || st || (h % 2) END AS printed_id FROM o)"""


def boundary_steps(features: str, look_around: bool, stale_id: bool) -> str:
    """Steps from f (features) to b (study_id, page_num, kind, boundary_score)."""
    t, p, s, i = "title_page_score", "study_preface_score", "summary_score", "intro_score"
    term = lambda own: f"CASE WHEN toc_score > 0 THEN 0.0375::DOUBLE ELSE 0.0375::DOUBLE * ({own}) END"
    own = lambda x: x if look_around else "0"
    over = lambda a, b: f"OVER (PARTITION BY study_id ORDER BY page_num RANGE BETWEEN {a} AND {b})"
    return f"""{features},
k AS (SELECT *, CASE WHEN toc_score > 0 THEN 'toc' WHEN {t} > 0.6 THEN 'title' WHEN {p} > 0.5 THEN 'preface' WHEN {s} > 0 THEN 'summary' WHEN {i} > 0 THEN 'introduction' END AS kind FROM f),
w AS (SELECT *, coalesce(sum({term(f"{p} + {s} + {i}")}) {over("1 FOLLOWING", "8 FOLLOWING")}, 0) AS w_title,
  sum({term(f"{t} + {s} + {i}")}) {over("3 PRECEDING", "5 FOLLOWING")} - {term(f"{t} + {s} + {i}")} AS w_preface,
  sum({term(own(f"{t} + {p} + {i}"))}) {over("5 PRECEDING", "3 FOLLOWING")} - {term(own(f"{t} + {p} + {i}"))} AS w_summary,
  coalesce(sum({term(own(f"{t} + {p} + {s}"))}) {over("8 PRECEDING", "1 PRECEDING")}, 0) AS w_intro,
  count(*) OVER (PARTITION BY study_id, kind ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS seen,
  list(printed_id) {over("15 PRECEDING", "1 PRECEDING")} AS ids FROM k),
l AS (SELECT study_id AS sid, printed_id AS last_id FROM f WHERE toc_score = 0 QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY page_num DESC) = 1),
r AS (SELECT w.*, {"last_id" if stale_id else "printed_id"} AS id, CASE kind WHEN 'title' THEN 0.7 * {t} + w_title WHEN 'preface' THEN 0.7 * {p} + w_preface WHEN 'summary' THEN 0.7 * {s} + w_summary WHEN 'introduction' THEN 0.7 * {i} + w_intro ELSE 0 END AS raw FROM w LEFT JOIN l ON sid = study_id),
b AS (SELECT study_id, page_num, kind, round(CASE WHEN toc_score > 0 THEN 0.7 ELSE raw + CASE WHEN seen AND ((kind = 'title' AND raw > 0.7) OR kind IN ('summary', 'introduction')) THEN 0.1 ELSE 0 END
  + 0.2 * least(CASE WHEN id IS NULL THEN 0 ELSE coalesce(len(list_filter(ids, lambda x: x <> id)), 0) END / 14.0, 1) END::DOUBLE, 6) AS boundary_score FROM r)"""


_C = """c AS (SELECT 'C' || c_custkey AS study_id, c_custkey AS n, ['SUMMARY OF PROJECT', 'TOXICOLOGICAL ASSESSMENT', 'CHEMISTRY OF ' || c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'RESIDUES ASSESSMENT' ELSE 'ANNEX TABLES' END] AS titles FROM customer),
e AS (SELECT study_id, n, unnest(titles) AS title, generate_subscripts(titles, 1)::INT AS k FROM c),
x AS (SELECT *, k = 2 OR (k = 4 AND n % 2 = 0) AS deep, 'The text of report ' || n || ' goes on here.' AS onward FROM e)"""
_NTH = "'The {0} text of report ' || n || ' stands here.'"
_SUBS = f"""s AS (SELECT *, unnest(CASE WHEN NOT deep THEN [{{'sub': 0, 'low': NULL, 'body': title || chr(10) || {_NTH.format('only')} || chr(10) || onward}}]
  WHEN n % 3 = 0 THEN [{{'sub': 1, 'low': 'Acute study', 'body': {_NTH.format('first')}}}, {{'sub': 2, 'low': 'Repeated study', 'body': {_NTH.format('second')}}}, {{'sub': 3, 'low': 'Summary of findings', 'body': {_NTH.format('third')} || chr(10) || onward}}]
  ELSE [{{'sub': 1, 'low': 'Acute study', 'body': {_NTH.format('first')}}}, {{'sub': 2, 'low': 'Repeated study', 'body': {_NTH.format('second')} || chr(10) || onward}}] END) AS u FROM x),
spans AS (SELECT study_id, k - 1 AS ord, u.sub AS sub, CASE WHEN deep THEN title || ' -> ' || u.low ELSE title END AS title, title AS high, u.low AS low, 2 * k AS page_num, u.body AS content FROM s)"""
#: Steps from b to g (study_id, batch, start_page, pages, mean), and what batches gives of them.
BATCH_STEPS = "q AS (SELECT study_id, page_num, boundary_score, ((row_number() OVER (PARTITION BY study_id ORDER BY page_num) - 1) // 8)::INT AS batch FROM b), g AS (SELECT study_id, batch, min(page_num) AS start_page, count(*) AS pages, avg(boundary_score) AS mean FROM q GROUP BY ALL)"
BATCHES = "SELECT study_id, batch, start_page, pages, round(mean, 9) AS mean, round(mean, 9) >= round(min(mean) OVER w + 2 * stddev_pop(mean) OVER w, 9) AS detectable FROM g WINDOW w AS (PARTITION BY study_id)"

#: Steps from b to chunks (study_id, page_start, page_end): which standing batches open a window needs one after the other.
CHUNK_STEPS = BATCH_STEPS + """,
m AS (SELECT study_id, min(mean) AS low, max(mean) AS high, min(mean) + 2 * stddev_pop(mean) AS lim, sum(pages)::INT AS total FROM g GROUP BY study_id),
sd AS (SELECT g.study_id, batch, start_page, low, high, total, row_number() OVER (PARTITION BY g.study_id ORDER BY batch) - 1 AS pos, count(*) OVER (PARTITION BY g.study_id) AS n FROM g JOIN m ON m.study_id = g.study_id WHERE mean >= lim),
nr AS (SELECT a.study_id, a.batch, o.pos AS near FROM sd a JOIN sd o ON o.study_id = a.study_id AND o.pos BETWEEN a.batch + 1 AND a.batch + 5 AND o.start_page <= a.start_page + 15),
nm AS (SELECT sd.*, (SELECT max(near) FROM nr WHERE nr.study_id = sd.study_id AND nr.batch = sd.batch) AS furthest FROM sd WHERE n > 1),
rc AS (SELECT study_id, pos, start_page < total - 9 AND batch > -1 AS taken, CASE WHEN start_page < total - 9 THEN coalesce(furthest, -1) ELSE -1 END AS reached FROM nm WHERE pos = 0
  UNION ALL SELECT nm.study_id, nm.pos, nm.start_page < nm.total - 9 AND nm.batch > rc.reached, CASE WHEN nm.start_page < nm.total - 9 AND nm.batch > rc.reached THEN coalesce(nm.furthest, rc.reached) ELSE rc.reached END FROM rc JOIN nm ON nm.study_id = rc.study_id AND nm.pos = rc.pos + 1),
op AS (SELECT nm.* FROM rc JOIN nm ON nm.study_id = rc.study_id AND nm.pos = rc.pos WHERE taken),
wb AS (SELECT study_id, batch AS i, batch AS part FROM op UNION ALL SELECT op.study_id, op.batch, near FROM op JOIN nr ON nr.study_id = op.study_id AND nr.batch = op.batch),
wp AS (SELECT wb.study_id, i, page_num, boundary_score AS v, lead(page_num) OVER w AS after, lead(boundary_score) OVER w AS nxt, stddev_pop(boundary_score) OVER (PARTITION BY wb.study_id, i) AS spread FROM wb JOIN q ON q.study_id = wb.study_id AND q.batch = wb.part WINDOW w AS (PARTITION BY wb.study_id, i ORDER BY page_num)),
ev AS (SELECT wp.study_id, i, page_num, CASE WHEN nxt IS NULL THEN NULL WHEN v <= low THEN CASE WHEN nxt - v >= 1.5 * spread THEN after END WHEN v >= high - 0.1 OR v >= 0.85 THEN -1 WHEN nxt <= v / 2 THEN page_num WHEN nxt >= v * 2 THEN after END AS turn FROM wp JOIN m ON m.study_id = wp.study_id),
ct AS (SELECT study_id, i, coalesce(nullif(arg_min(turn, page_num) FILTER (turn IS NOT NULL), -1), min(page_num)) AS cut FROM ev GROUP BY study_id, i),
cn AS (SELECT study_id, cut, min(i) AS i FROM ct WHERE study_id IN (SELECT study_id FROM ct GROUP BY study_id HAVING count(*) > 1) GROUP BY study_id, cut),
chunks AS (SELECT cn.study_id, cut::INT AS page_start, coalesce(lead(cut) OVER (PARTITION BY cn.study_id ORDER BY i), total + 1)::INT AS page_end FROM cn JOIN m ON m.study_id = cn.study_id)"""

SQL = {
    "made_features": f"WITH {_F} FROM f",
    "made_boundaries": f"WITH {boundary_steps(_F, False, True)} FROM b",
    "made_boundaries_around": f"WITH {boundary_steps(_F, True, False)} FROM b",
    "made_batches": f"WITH {boundary_steps(_F, False, True)}, {BATCH_STEPS} {BATCHES}",
    "made_pages": f"WITH {_C} SELECT study_id, 1 AS page_num, 'CONTENTS' || chr(10) || string_agg(title || ' ..... ' || 2 * k, chr(10) ORDER BY k) AS text FROM x GROUP BY study_id UNION ALL SELECT study_id, 2 * k, title || chr(10) || CASE WHEN NOT deep THEN {_NTH.format('only')} ELSE 'Acute study' || chr(10) || {_NTH.format('first')} || chr(10) || 'Repeated study' || chr(10) || {_NTH.format('second')} || CASE WHEN n % 3 = 0 THEN chr(10) || 'Summary of findings' || chr(10) || {_NTH.format('third')} ELSE '' END END FROM x UNION ALL SELECT study_id, 2 * k + 1, onward FROM x",
    "made_toc_entries": f"WITH {_C} SELECT study_id, k - 1 AS ord, title, 2 * k AS page FROM x",
    "made_section_spans": f"WITH {_C}, {_SUBS} SELECT study_id, ord, sub, title, page_num, content FROM spans",
    "made_integrated": "SELECT 'C' || c_custkey AS study_id, CASE WHEN c_custkey % 2 = 0 THEN 0.8 ELSE 0.3 END::DOUBLE AS score FROM customer",
    "made_routes": "SELECT 'C' || c_custkey AS study_id, CASE WHEN c_custkey % 2 = 0 THEN 'integrated' ELSE 'whole' END AS route FROM customer",
    "made_corpora": f"""WITH {_C}, {_SUBS}, r AS (SELECT *, CASE WHEN low IS NOT NULL AND (contains(high, 'RESIDUE') OR contains(high, 'ENVIRONMENTAL')) THEN 'negative'
  WHEN contains(high, 'SUMMARY') OR contains(high, 'CHEMISTRY') OR contains(lower(low), 'summary') THEN 'shared' WHEN contains(high, 'TOXICOLOGICAL') AND low IS NOT NULL THEN 'target' END AS route FROM spans),
t AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY ord, sub)::INT AS corpus, high || '_' || low AS label FROM r WHERE route = 'target'),
a AS (SELECT t.study_id, corpus, label, 0 AS last, r.ord, r.sub, r.page_num, r.title, r.content FROM t JOIN r ON r.study_id = t.study_id AND r.route = 'shared' UNION ALL SELECT study_id, corpus, label, 1, ord, sub, page_num, title, content FROM t)
SELECT study_id, corpus, label, row_number() OVER (PARTITION BY study_id, corpus ORDER BY last, ord, sub)::INT AS doc, page_num, title, content FROM a""",
}
_MADE = boundary_steps(_F, False, True)
SQL["made_chunks"] = f"WITH RECURSIVE {_MADE}, {CHUNK_STEPS} FROM chunks"
SQL["made_chunk_pages"] = f"WITH RECURSIVE {_MADE}, {CHUNK_STEPS} SELECT chunks.study_id, page_start, page_end, count(*) AS pages, sum(page_num)::BIGINT AS sum FROM chunks JOIN f ON f.study_id = chunks.study_id AND page_num BETWEEN page_start AND page_end GROUP BY ALL"
SQL["made_chunk_titles"] = f"WITH RECURSIVE {_MADE}, {CHUNK_STEPS}, t AS (SELECT chunks.*, 'Status ' || coalesce(printed_id, 'NONE') || ' on page ' || page_num AS title FROM chunks JOIN f ON f.study_id = chunks.study_id AND page_num = page_start) FROM t WHERE contains(lower(title), 'none on') OR contains(lower(title), 'id-f')"
SQL["made_guides"] = "WITH i AS (SELECT substr(issuer, 4)::INT AS p, issuer_name || ' Guide' AS t FROM issuers) SELECT c_custkey, t AS guide, coalesce(p, 0) AS page_num FROM customer LEFT JOIN i ON p = CASE c_custkey % 4 WHEN 0 THEN c_custkey % 24 + 1 WHEN 2 THEN NULL ELSE (c_custkey + 7) % 24 + 1 END"
