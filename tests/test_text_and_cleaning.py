import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import classify as K
from pagemill.operators import cleaning as C


def one(spark, f, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(f(F.col("t"))).collect()]


def test_tokens(spark):
    texts = ["v/v", "99% w", "5kg", "h2o", "a_b", "1.5mg", "10,000", "café", None, ""]
    assert one(spark, T.tokens, *texts) == [["v/v"], ["99", "%", "w"], [], [], [], ["1"], ["10", "000"], [], [], []]


def test_candidates(spark):
    assert one(spark, lambda c: T.candidates(T.tokens(c)), "to the test guideline", "") == [["test", "guideline", "test guideline"], []]


def test_cleaning_stages(spark):
    assert one(spark, C.rejoin_wrapped, "the cat\nsat on\nthe mat") == ["the cat sat on the mat"]
    assert one(spark, C.mend_spaced_words, "t e s t item", "a longer line of plain words goes on and on") == ["test item", "a longer line of plain words goes on and on"]
    assert one(spark, C.is_junk_line, "5%", "~*!", "^A5", "", "word") == [False, True, True, False, False]
    assert one(spark, C.mend_hyphens, "re-\nceived", "sta­\nble", "A-\nb") == ["received", "sta-ble", "A-\nb"]
    assert one(spark, C.newlines, "a\r\nb\rc", None) == ["a\nb\nc", None]
    toc = "\n".join(f"{i}.1   Title   {i}" for i in range(1, 8))
    assert one(spark, lambda c: C.joined(C.without_toc(T.lines(c))), toc + "\nbody", "1.1   One   2\nbody") == ["body", "1.1   One   2\nbody"]
    assert one(spark, C.clean_page, "one\n\n\n\ntwo  \n", None, "") == ["one\n\ntwo", None, ""]


def test_clean_prompt(spark):
    got = one(spark, C.clean_prompt, "x BEGIN EXERPT--- a\n--\nDOSE\nb ---END EXERPT y", "no marks", None)
    assert got == ["x BEGIN EXCERPT--- a\nDOSE\nb ---END EXCERPT y", "no marks", None]


def test_classifiers(spark):
    assert one(spark, K.table_score, "Table 1\n1.1\n2.2\n3.3\n4.4\n5.5", "", None) == [0.775, 0.0, 0.0]
    assert one(spark, K.title_score, "Final Report", " ") == [1.0, 0.0]
    assert one(spark, K.is_toc, "Table of contents\nOne", "", "plain words") == [True, False, False]
    assert one(spark, K.roman_or_int, "iv", "12", "abc") == [-996, 12, -9999]
    assert one(spark, K.printed_page, " -6- ", "page 6 of 14", "(6)", "6/14", "six") == ["-6-", "page 6 of 14", "(6)", "6/14", None]
    assert one(spark, K.printed_id, "Study Number: AB-12 x", "none", None) == ["ab-12", None, None]
    assert one(spark, K.has_summary, "SUMMARY\nText", "Text") == [1, 0]


def test_scores_lie_between_0_and_1(spark):
    texts = ["x" * 500, "1.0 " * 200, "STUDY REPORT\nSPONSOR\nGLP\nstudy director signature date", "appendix\n" * 40, "\n\n"]
    for f in (K.table_score, K.title_score, K.preface_score):
        assert all(0 <= s <= 1 for s in one(spark, f, *texts))


@pytest.mark.parametrize("text", [None, "", " ", "\n", "\r\n", "🐀", "a" * 5000])
def test_no_text_breaks_a_stage(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    df.select(C.clean_page(F.col("t")), C.plain_text(F.col("t")), K.is_toc(F.col("t")), K.title_features(F.col("t")), K.preface_score(F.col("t")), K.looks_like_toc(F.col("t"))).collect()
