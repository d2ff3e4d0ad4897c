from pyspark.sql import functions as F

from pagemill.operators import assemble as A
from pagemill.operators import corpora as B
from pagemill.operators import retrieval as R
from pagemill.operators import sections as S
from pagemill.operators import segment as G
from pagemill.plans import registry
from pagemill.sources import readers, sinks
from pagemill.streaming import ingest


def test_boundaries():
    assert G.find_boundaries([]) == []
    peaks = [(p, 0.95 if p in (9, 41) else 0.0) for p in range(1, 81)]
    cuts = G.find_boundaries(peaks)
    assert len(cuts) in (0, 2) and all(1 <= c <= 80 for c in cuts)
    one = [(p, 0.9) if p <= 8 else (p, 0.0) for p in range(1, 41)]
    assert G.find_boundaries(one) == []


def test_batches_lod(spark):
    rows = [("s", p, 0.9 if p <= 8 else 0.0) for p in range(1, 41)] + [("t", p, 0.9 if p <= 16 else 0.0) for p in range(1, 81)]
    got = G.batches(spark.createDataFrame(rows, "study_id string, page_num int, boundary_score double")).where("detectable").groupBy("study_id").count().collect()
    assert {r[0]: r[1] for r in got} == {"s": 1, "t": 2}


def test_contents_entries():
    text = "CONTENTS\n1 Summary ..... 3\nMethods   iv\nResults\n12\nloose line\n"
    assert G.contents_entries(text) == [("1 Summary", "3"), ("Methods", "iv"), ("Results", "12")]
    assert G.contents_entries(None) == []


def pages(spark):
    rows = [
        ("r", 1, "TABLE OF CONTENTS\nTOXICOLOGY ASSESSMENT ..... 2\nRESIDUES ASSESSMENT ..... 4\nSUMMARY ..... 5\nCHEMISTRY ..... 6\n"),
        ("r", 2, "TOXICOLOGY ASSESSMENT\nAcute Studies\nthe first part of it is here.\n"),
        ("r", 3, "Chronic Studies\nthe second part of it is here.\n"),
        ("r", 4, "RESIDUES ASSESSMENT\nthere were none.\n"),
        ("r", 5, "SUMMARY\nAll was well.\n"),
        ("r", 6, "CHEMISTRY\nIt is white.\n"),
    ]
    return spark.createDataFrame(rows, "study_id string, page_num int, text string")


def test_integrated_report(spark):
    p = pages(spark)
    assert [(r["title"], r["page_start"], r["page_end"]) for r in G.high_sections(p).orderBy("ord").collect()] == [("TOXICOLOGY ASSESSMENT", 2, 3), ("RESIDUES ASSESSMENT", 4, 4), ("SUMMARY", 5, 5), ("CHEMISTRY", 6, 6)]
    spans = {r["title"]: r["content"] for r in G.section_spans(p).collect()}
    assert "the first part" in spans["TOXICOLOGY ASSESSMENT -> Acute Studies"] and "second" not in spans["TOXICOLOGY ASSESSMENT -> Acute Studies"]
    routes = {r["title"]: r["route"] for r in G.route_sections(G.section_spans(p)).collect()}
    assert routes["SUMMARY"] == "shared" and routes["TOXICOLOGY ASSESSMENT -> Acute Studies"] == "target"
    assert G.integrated_score(p).collect()[0]["score"] == 0.8
    assert G.integrated_score(p.where("page_num = 5")).collect()[0]["score"] == 0.0  # too little text for a text layer


def test_routes_by_length(spark, tmp_path, monkeypatch):
    """Only reports of 80 pages can be cut, so made_routes (nine pages a report) computes no page's features."""
    rows = [(s, p, "x", 0.9 if p <= 8 or 41 <= p <= 48 else 0.0) for s, n in (("long", 80), ("short", 79)) for p in range(1, n + 1)]
    every = spark.createDataFrame(rows, "study_id string, page_num int, text string, boundary_score double")
    pages_, scores = every.drop("boundary_score"), every.drop("text")
    long = G.long_reports(pages_)
    assert long.columns == pages_.columns and sorted(r["page_num"] for r in long.collect()) == list(range(1, 81))
    for given in (scores, scores.join(long.select("study_id").distinct(), "study_id", "left_semi")):
        assert {r["study_id"]: r["route"] for r in G.corpus_route(pages_, given).collect()} == {"long": "chunks", "short": "whole"}
    seen, features = [], G.page_features
    monkeypatch.setattr(G, "page_features", lambda p: seen.append(p.count()) or features(p))
    spark.createDataFrame([(k, "MACHINERY") for k in range(1, 8)], "c_custkey long, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r["study_id"]: r["route"] for r in registry.queries()["made_routes"](spark, str(tmp_path)).collect()}
    assert got == {f"C{k}": "whole" if k % 2 else "integrated" for k in range(1, 8)} and seen == [0]


def test_sections(spark):
    p = spark.createDataFrame([("s", 1, "SUMMARY\nThe study went well and it goes on with many words that\n"), ("s", 2, "still belong to the sentence of the page before this one here and end.\nRESULTS\nx\n")], "study_id string, page_num int, text string")
    got = S.find_sections(p, ["summary"]).collect()
    assert len(got) == 1 and got[0]["continued"] and "still belong" in got[0]["content"] and "RESULTS" not in got[0]["content"]
    assert S.summaries(p).collect()[0]["page_nums"] == "1"


def test_sections_end_at_other_sections_and_go_on(spark):
    filler = "One sentence of the section tells what the animals of each group were given on that day.\n" * 4
    pages = [
        ("cut", 1, f"SUMMARY\n{filler}BODY WEIGHTS\nno change.\n{filler}RESULTS\nother text\n"),
        ("short", 1, f"SUMMARY\n{filler}"),
        ("short", 2, "All of the animals that were left alive had recovered by the end.\n"),
        ("insert", 1, f"SUMMARY\nPage 4 of 9\n{filler}"),
        ("insert", 2, f"BEST COPY\n{filler}"),
        ("insert", 3, f"An insert.\n{filler}"),
        ("insert", 4, f"Page 5 of 9\nThe last of it.\n{filler}"),
        ("other", 1, f"SUMMARY\nPage 4 of 9\n{filler}"),
        ("other", 2, f"Page 6 of 9\n{filler}"),
        ("new", 1, f"SUMMARY\n{filler}"),
        ("new", 2, "RESULTS\nAll of the animals that were left alive had recovered by the end.\n"),
    ]
    got = {r["study_id"]: r for r in S.find_sections(spark.createDataFrame(pages, "study_id string, page_num int, text string"), ["summary"]).collect()}
    assert "BODY WEIGHTS\nno change." in got["cut"]["content"] and "RESULTS" not in got["cut"]["content"]
    assert {k: r["continued_pages"] for k, r in got.items()} == {"cut": [], "short": [2], "insert": [4], "other": [], "new": []}
    assert "The last of it." in got["insert"]["content"] and "BEST COPY" not in got["insert"]["content"] and got["insert"]["continued"]


def test_context_and_prompt(spark):
    hits = spark.createDataFrame([("q", "s", 2, "second", "8"), ("q", "s", 1, "first", "7")], "question_id string, study_id string, rank int, content string, page_num string")
    title = spark.createDataFrame([("s", "title", "1")], "study_id string, content string, page_num string")
    r = A.context(hits, title, title.where("false"), ["study_id"]).collect()[0]
    assert r["context"] == ["title", "first", "second"] and r["retrieved_pages"] == ["1", "7", "8"]
    p = spark.range(1).select(A.prompt(F.lit(" Why? "), F.array(F.lit("a. b c why?")), F.lit(None).cast("string")).alias("prompt"))
    assert readers.answer(p).collect()[0]["output"]


def test_report_corpora(spark):
    """Target sections with all shared ones, chunks by their ranges, and the whole report without either."""
    titles = ["SUMMARY", "MAMMALIAN TOXICOLOGY -> Acute studies", "MAMMALIAN TOXICOLOGY -> Summary", "RESIDUES -> Summary", "TOXICITY -> Repeated doses"]
    spans = spark.createDataFrame([("i", n, 0, t, n + 1, f"text {n}") for n, t in enumerate(titles)] + [("w", 0, 0, "SUMMARY", 1, "x")], "study_id string, ord int, sub int, title string, page_num int, content string")
    pages = spark.createDataFrame([(s, p, f"page {p} of {s}") for s, n in (("i", 5), ("w", 2), ("c", 4)) for p in range(1, n + 1)], "study_id string, page_num int, text string")
    scores = pages.select("study_id", "page_num", F.lit(0.0).alias("boundary_score"))
    routes = spark.createDataFrame([("i", "integrated"), ("w", "integrated"), ("c", "chunks")], "study_id string, route string")
    documents, corpora = B.report_corpora(pages, scores, spans, routes)
    got = {}
    for r in documents.orderBy("study_id", "corpus", "doc").collect():
        got.setdefault((r["study_id"], r["route"], r["corpus"], r["label"]), []).append(r["content"])
    assert got["i", "integrated", 1, "MAMMALIAN TOXICOLOGY_Acute studies"] == ["text 0", "text 2", "text 1"]
    assert got["i", "integrated", 2, "TOXICITY_Repeated doses"] == ["text 0", "text 2", "text 4"]
    assert got["w", "whole", 1, None] == ["page 1 of w", "page 2 of w"] and {k[1] for k in got if k[0] == "c"} <= {"chunks"}
    heads = {(r["study_id"], r["corpus"]): r for r in corpora.collect()}
    assert heads["i", 1]["summary"] == "text 2" and heads["i", 2]["summary_pages"] == "3" and heads["w", 1]["summary"] is None


def test_full_context(spark, tmp_path):
    """A study's context has its summary, and its hits come from keywords and vectors too."""
    filler = "One sentence of the section tells what the animals of each group were given on that day.\n" * 4
    meta = "struct<page_num:string,title:string>"
    pages = [(1, "s", f"SUMMARY\n{filler}", ("3", None)), (2, "s", f"RESULTS\n{filler}", ("4", None))]
    spark.createDataFrame(pages, f"page_key long, study_id string, content string, metadata {meta}").write.parquet(str(tmp_path / "page_docs.parquet"))
    docs = [(i, "s", x, (str(i), None)) for i, x in enumerate([None, "lot purity was 99 %", "the batch of the lot", "certificate of purity is kept", "purity"], 1)]
    spark.createDataFrame(docs, f"doc_key long, study_id string, content string, metadata {meta}").write.parquet(str(tmp_path / "docs.parquet"))
    spark.createDataFrame([("question 1", "Which purity has the batch of the lot?", []), ("question 2", "Which purity has the lot?", ["certificate of purity"])], "question_id string, query string, keywords array<string>").write.parquet(str(tmp_path / "questions.parquet"))
    got = {r["question_id"]: r for r in registry.queries()["full_context"](spark, str(tmp_path)).collect()}
    assert {k: (r["length"], r["pages"].split(",")[0]) for k, r in got.items()} == {"question 1": (4, "3"), "question 2": (4, "3")}
    assert "4" in got["question 2"]["pages"].split(",")[1:] and "1" not in got["question 2"]["pages"].split(",")
    assert registry.queries()["prompt_text"](spark, str(tmp_path)).count() == 2


def test_guides():
    titles = ["Dermal Guide", "Oral Guide"]
    assert A.chosen_title("Dermal Guide or rather Oral Guide", titles) == "Oral Guide"
    assert A.chosen_title("not Dermal Guide", titles) is None and A.chosen_title("non", titles) is None and A.chosen_title(None, titles) is None


def test_sources_sinks_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "R1.pdf").write_bytes("one\ftwo".encode())
    (tmp_path / "in" / "note.txt").write_bytes(b"x")
    got = readers.pages(spark, str(tmp_path / "in")).orderBy("page_num").collect()
    assert [(r["study_id"], r["page_num"], r["raw"]) for r in got] == [("R1", 1, "one"), ("R1", 2, "two")]
    assert readers.page_span((1, 9), 3) == [1, 2] and readers.page_span(None, 2) == [0, 1] and readers.page_span([5], 2) == []
    answers = spark.createDataFrame([("s", 1, "a"), ("s", 2, "b")], "study_id string, run_number int, answer string")
    sinks.write_answers(answers, str(tmp_path / "out"))
    assert A.pending(answers, spark.read.parquet(str(tmp_path / "out")).where("run_number = 1"), ["study_id", "run_number"]).count() == 1
    docs = spark.createDataFrame([("c", 1, "a b"), ("c", 2, "a")], "corpus string, doc_idx int, content string")
    docs.write.parquet(str(tmp_path / "arrived"))
    stream = ingest.page_stream(spark, str(tmp_path / "arrived"), "corpus string, doc_idx int, content string")
    index = R.Index(spark, str(tmp_path / "index"), ["corpus"])
    ingest.index_stream(stream, index, str(tmp_path / "ck")).awaitTermination()
    idf, stats = index.idf(), index.stats()
    assert stats.collect()[0]["n"] == 2 and idf.count() == 2
    asked = R.query_terms(spark.createDataFrame([("q", "b a")], "question_id string, query string"))
    found = {r["doc_idx"]: r["score"] for r in index.bm25(asked).collect()}
    assert found == {r["doc_idx"]: r["score"] for r in R.bm25(docs, asked, ["corpus"]).collect()} and set(found) == {1, 2}


def test_registry_names_and_sql():
    assert set(registry.oracle_sql()) <= set(registry.queries())
