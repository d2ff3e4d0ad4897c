from fractions import Fraction

import pytest

from pagemill.operators import quantities as Q


@pytest.mark.parametrize(
    "question, text, expected",
    [
        ("question 2", "PURITY : ≥97,16 pct", [("purity", 971600)]),
        ("question 2", "Purity: approx. 974,000 ppm", [("purity", 974000)]),
        ("question 2", "BATCH PURITY : 9.549 × 10^5 mg/kg", [("purity", 954900)]),
        ("question 2", "PURITY : 0.9304 (mass fraction)", [("purity", 930400)]),
        ("question 2", "BATCH PURITY (%) : 85.33", [("purity", 853300)]),
        ("question 2", "Purity : 53.48 per cent", [("purity", 534800)]),
        ("question 6", "MAX DOSE :ca. 1 250 mg·kg⁻¹", [("dose", 1250000)]),
        ("question 6", "DOSE : up to 1 500 milligrams per kilogram (n = 8)", [("dose", 1500000)]),
        ("question 6", "DOSE (mg/10 g bw) : 5 for males (group 3)", [("dose", 500000)]),
        ("question 6", "MAX DOSE : 3 mg/kg bw/day", [("dose", 3000)]),
        ("question 6", "MAX DOSE : 2,000 mg/m3", [("air", 2000)]),
        ("question 6", "HIGHEST DOSE PER PLATE : 0,02 mg/plate", [("plate", 20000)]),
        ("question 6", "DOSE : three MG/KG", [("dose", 3000)]),
        ("question 7", "Dilutions : 0.5, 2.5 and 10 % (w/v)", [("dilution", 500), ("dilution", 2500), ("dilution", 10000)]),
        ("question 7", "DILUTION :10 mg/ml, 10 mg/ml", [("dilution", 1000)]),
        ("question 7", "Dilutions : 1,5 g per 100 ml", [("dilution", 1500)]),
        ("question 10", "DURATION : 90 consecutive days", [("duration", 2160)]),
        ("question 10", "Duration of test : 18-month", [("duration", 12960)]),
        ("question 10", "TESTING DURATION in weeks : two", [("duration", 336)]),
        ("question 10", "DURATION: 28 DAYS", [("duration", 672)]),
        ("question 2", "PURITY : zero percent", [("purity", 0)]),
        ("question 2", "PURITY : 1e-61 %", []),
        ("question 2", "PURITY : 99.12345678 %", [("purity", 991235)]),
        ("question 2", "PURITY : 1e99999 %", []),
        ("question 6", "DOSE : one hundred mg/kg bw", [("dose", 100000)]),
        ("question 6", "DOSE : two hundred and fifty mg/kg", [("dose", 250000)]),
        ("question 6", "DOSE : one hundred and two hundred mg/kg", [("dose", 100000), ("dose", 200000)]),
        ("question 6", "DOSE : a thousand mg/kg", [("dose", 1000000)]),
        ("question 6", "DOSE : one thousand two hundred mg/kg", [("dose", 1200000)]),
        ("question 6", "DOSE : 0.5 oz/lb bw", [("dose", 31250000)]),
        ("question 6", "The dose that the study's authors thought of as the highest one that could be given to the animals at all [mg/kg] : 5", [("dose", 5000)]),
        ("question 6", "DOSE : 5" + " " * 300 + "mg   per" + " " * 90 + "kg", [("dose", 5000)]),
        ("question 10", "Null : Null", []),
        ("question 10", "", []),
        ("question 10", None, []),
    ],
)
def test_amounts(question, text, expected):
    assert [a[:2] for a in Q.amounts(text, Q.BY_QUESTION[question])] == expected


def test_offset_units():
    f = Q.figures("Temperature : 25 °C")[0]
    assert f.value * f.unit.scale + f.unit.offset == Fraction(29815, 100)


def test_inexact_amounts_say_so():
    assert Q.amounts("PURITY : 99.12345678 %, 50 %", (Q.PURITY,)) == [("purity", 991235, False), ("purity", 500000, True)]


def test_base_figures(spark):
    df = spark.createDataFrame([(1, "Temperature : 25 °C"), (2, "68 °F and 3 mg/L"), (3, None), (4, "")], "id long, text string")
    got = {(r["id"], r["f"]["dimensions"], round(r["f"]["value"], 6)) for r in df.selectExpr("id", "text").select("id", Q.base_figures("text").alias("fs")).selectExpr("id", "explode(fs) as f").collect()}
    assert got == {(1, "temperature", 298.15), (2, "temperature", 293.15), (2, "mass length^-3", 3.0)}


def test_found_amounts(spark):
    rows = [(1, "question 2", "PURITY : 90 %", 1), (2, "question 3", "50 %", 1), (3, "question 2", None, 1), (4, None, "PURITY : 90 %", 1), (5, "question 7", "Dilutions : 1% v/v, 1% w/w, 2%", 1), (6, "question 2", "", 1), (7, "question 2", "PURITY : zero percent", 1)]
    df = spark.createDataFrame(rows, "state_id long, question_id string, corrected_output string, amounts int")
    got = {tuple(r) for r in Q.found_amounts(df).collect()}
    assert got == {(7, "purity", 0), (1, "purity", 900000), (5, "dilution", 1000), (5, "dilution", 2000)}
    assert Q.found_amounts(df.where("false")).count() == 0
