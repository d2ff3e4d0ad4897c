"""Figures with units, read by a grammar and brought to the common unit of their quantity.

A unit is a vector of exponents over the base dimensions (mass, length, time, temperature, plate) with an exact rational
scale and, for temperatures, an offset. Texts give numbers in many notations (thousands by comma, blank or no-break
blank, decimal commas, powers of ten, number words), units behind the figure, behind the last figure of a list, or in
the label before the colon.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from pagemill.session import spread

# ---------------------------------------------------------------------------------------------- units

#: Base dimensions, in the order of the exponent vectors.
BASE = ("mass", "length", "time", "temperature", "plate")
Vector = tuple[int, int, int, int, int]
NONE: Vector = (0, 0, 0, 0, 0)


@dataclass(frozen=True)
class Unit:
    """value in base units = value * scale + offset; base units: gram, metre, hour, kelvin, plate."""

    dims: Vector
    scale: Fraction
    offset: Fraction = Fraction(0)

    def times(self, other: Unit, power: int = 1) -> Unit:
        return Unit(tuple(a + power * b for a, b in zip(self.dims, other.dims)), self.scale * other.scale**power)  # type: ignore[arg-type]

    def power(self, n: int) -> Unit:
        return Unit(tuple(a * n for a in self.dims), self.scale**n)  # type: ignore[arg-type]


def _dim(name: str, power: int = 1) -> Vector:
    return tuple(power * (x == name) for x in BASE)  # type: ignore[return-value]


_PREFIX = {"kilo": (3, ("k",)), "": (0, ("",)), "deci": (-1, ("d",)), "centi": (-2, ("c",)), "milli": (-3, ("m",)), "micro": (-6, ("µ", "μ", "u", "mc")), "nano": (-9, ("n",)), "pico": (-12, ("p",))}


def _units() -> dict[str, Unit]:
    """Names in lower case to units; made by the rule prefix x base unit, with plurals."""
    out: dict[str, Unit] = {}

    def prefixed(dims: Vector, scale: Fraction, words: tuple[str, ...], signs: tuple[str, ...]) -> None:
        for long, (exp, short) in _PREFIX.items():
            unit = Unit(dims, scale * Fraction(10) ** exp)
            for w in words:
                out.setdefault(long + w, unit)
                out.setdefault(long + w + "s", unit)
            for s in signs:
                for p in short:
                    out.setdefault(p + s, unit)

    prefixed(_dim("mass"), Fraction(1), ("gram", "gramme"), ("g", "gs", "gm"))
    prefixed(_dim("length", 3), Fraction(1, 1000), ("litre", "liter"), ("l",))
    prefixed(_dim("length"), Fraction(1), ("metre", "meter"), ("m",))
    for names, hours in (("second sec secs s", Fraction(1, 3600)), ("minute min mins", Fraction(1, 60)), ("hour hr hrs h", Fraction(1)), ("day d", Fraction(24)), ("week wk wks w", Fraction(168)), ("month mo mos mth mths", Fraction(720)), ("year yr yrs y", Fraction(8760))):
        for n in names.split():
            out[n] = Unit(_dim("time"), hours)
            if len(n) >= 3:
                out[n + "s"] = out[n]
    for n in ("plate", "plates", "pl"):
        out[n] = Unit(_dim("plate"), Fraction(1))
    # British and American units by their legal definitions
    for names, grams in (("lb lbs pound", Fraction(45359237, 100000)), ("oz ounce", Fraction(45359237, 1600000)), ("grain", Fraction(6479891, 10**8)), ("tonne", Fraction(10**6))):
        for n in names.split():
            out[n] = Unit(_dim("mass"), grams)
            if len(n) > 3:
                out[n + "s"] = out[n]
    for names, metres in (("inch inches", Fraction(254, 10**4)), ("ft foot feet", Fraction(3048, 10**4)), ("yard yards yd", Fraction(9144, 10**4))):
        for n in names.split():
            out[n] = Unit(_dim("length"), metres)
    for n in ("gallon", "gallons", "gal"):
        out[n] = Unit(_dim("length", 3), Fraction(3785411784, 10**12))
    for names, scale in (("% percent pct", Fraction(1, 100)), ("‰ permille promille", Fraction(1, 1000)), ("ppm", Fraction(1, 10**6)), ("ppb", Fraction(1, 10**9)), ("fraction", Fraction(1))):
        for n in names.split():
            out[n] = Unit(NONE, scale)
    kelvin = _dim("temperature")
    out["k"] = out["kelvin"] = Unit(kelvin, Fraction(1))
    for n in ("°c", "degc", "celsius"):
        out[n] = Unit(kelvin, Fraction(1), Fraction(27315, 100))
    for n in ("°f", "degf", "fahrenheit"):
        out[n] = Unit(kelvin, Fraction(5, 9), Fraction(45967, 180))
    return out


UNITS = _units()
#: Words that say of what a unit counts and leave it unchanged.
_NOTES = re.compile(r"\s*\(?\s*(?:of\s+)?(?:body\s*-?\s*weight|b\.?\s?w\.?(?![a-z])|bodyweight|air\b|w\s*/\s*w\b|w\s*/\s*v\b|v\s*/\s*v\b|by\s+(?:mass|weight|volume)\b)\s*\)?", re.I)
_NAME = re.compile(r"(?:°[cf]|%|‰|[a-zµμ]+)", re.I)
_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")
_POWER = re.compile(r"\s?\^\s?([-+]?\d)|([⁻⁺]?[¹²³])|([-+]?[23])(?![\d.,])")
_BY = re.compile(r"\s*(?:/|per\b(?!\s*cent))\s*", re.I)
_TIMES = re.compile(r"\s*[·⋅*]\s*")
_COUNT = re.compile(r"(\d+(?:\.\d+)?)\s*")
_PHRASES = (
    (re.compile(r"per\s+cent\b|per\s+centum\b", re.I), Unit(NONE, Fraction(1, 100))),
    (re.compile(r"parts\s+per\s+million\b", re.I), UNITS["ppm"]),
    (re.compile(r"parts\s+per\s+billion\b", re.I), UNITS["ppb"]),
    (re.compile(r"(?:as\s+a\s+)?(?:mass\s+|weight\s+)?fraction\b|\(\s*(?:mass\s+|weight\s+)?fraction\s*\)", re.I), UNITS["fraction"]),
    (re.compile(r"cubic\s+met(?:re|er)s?\b", re.I), Unit(_dim("length", 3), Fraction(1))),
    (re.compile(r"cubic\s+centimet(?:re|er)s?\b|cc\b", re.I), Unit(_dim("length", 3), Fraction(1, 10**6))),
)


def _factor(text: str, at: int) -> tuple[Unit, int] | None:
    """[phrase] or name [power] at a position."""
    for pattern, unit in _PHRASES:
        if m := pattern.match(text, at):
            return unit, m.end()
    if not (m := _NAME.match(text, at)):
        return None
    unit, end = UNITS.get(m[0].lower()), m.end()
    if unit is None:
        return None
    if p := _POWER.match(text, end):
        n = int((p[1] or p[2] or p[3]).translate(_SUPER))
        unit, end = unit.power(n), p.end()
    return unit, end


@lru_cache(maxsize=100_000)
def parse_unit(text: str) -> tuple[Unit, int] | None:
    """The longest unit expression at the start of text and the length read.

    expression = factor {("/" | "per" | "·") [count] factor}; notes such as "bw" or "of air" may follow any factor.
    """
    at = len(text) - len(text.lstrip("  -"))
    if not (got := _factor(text, at)):
        return None
    unit, at = got
    while True:
        if m := _NOTES.match(text, at):
            at = m.end()
            continue
        by, mul = _BY.match(text, at), None
        if not by:
            mul = _TIMES.match(text, at)
        if not (step := by or mul):
            break
        after, count = step.end(), Fraction(1)
        if c := _COUNT.match(text, after):
            count, after = Fraction(c[1]), c.end()
        if not (got := _factor(text, after)):
            break
        unit = unit.times(Unit(got[0].dims, got[0].scale * count), -1 if by else 1)
        at = got[1]
    return unit, at


# ---------------------------------------------------------------------------------------------- numbers

_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
WORDS = {w: i for i, w in enumerate(_SMALL)} | {w: 20 + 10 * i for i, w in enumerate(_TENS)} | {f"{t}{sep}{_SMALL[k]}": 20 + 10 * i + k for i, t in enumerate(_TENS) for k in range(1, 10) for sep in "- "}
_WORD = "|".join(sorted(WORDS, key=len, reverse=True))
_SCALES = {"hundred": 100, "thousand": 1000, "million": 10**6}
# up to 999, then such with a scale behind: "two hundred and fifty", "a thousand", "one million two hundred thousand"
_HUNDREDS = rf"(?:(?:(?:an?|{_WORD})[\s-]+)?hundred(?![a-z])(?:[\s-]+(?:and[\s-]+)?(?:{_WORD})(?![a-z]|[\s-]+(?:hundred|thousand|million)))?|(?:{_WORD})(?![a-z]))"
_SCALED = rf"(?:(?:{_HUNDREDS}|an?)[\s-]+)?(?:thousand|million)(?![a-z])"
_SPELLED = rf"(?:{_SCALED}[\s-]+(?:and[\s-]+)?)*(?:{_SCALED}|{_HUNDREDS})"
_DIGITS = r"\d{1,3}(?:[    ]\d{3}(?!\d))+(?:[.,]\d+)?|\d+(?:,\d{3}(?!\d))+(?:\.\d+)?|\d+(?:[.,]\d+)?"
_EXP = r"(?:[eE][-+]?\d+|\s*[x×*]\s*10(?:\s*\^\s*[-+−]?\d+|[⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+))"
NUMBER = re.compile(rf"(?<![\w.,])(?:(?P<digits>{_DIGITS})(?P<exp>{_EXP})?|(?P<word>\b{_SPELLED}))", re.I)
_COMMA = re.compile(r",(?=\d{3}(?!\d))")


def _spelled(text: str) -> Fraction:
    total = part = 0
    for w in re.split(r"[\s-]+", text.lower()):
        if w == "hundred":
            part = (part or 1) * 100
        elif w in _SCALES:
            total, part = total + (part or 1) * _SCALES[w], 0
        elif w != "and":
            part += 1 if w in ("a", "an") else WORDS[w]
    return Fraction(total + part)


#: A power of ten beyond this is no figure.
MOST_EXPONENT = 4000


def parse_number(m: re.Match) -> Fraction | None:
    """The value of a match of NUMBER: a comma before exactly three digits separates thousands, else decimals."""
    if m["word"]:
        return _spelled(m["word"])
    digits = re.sub(r"[    ]", "", m["digits"])
    value = Fraction(_COMMA.sub("", digits).replace(",", "."))
    if m["exp"]:
        power = re.search(r"(?:[eE]|\^\s*)([-+−]?\d+)$|10([⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+)$", m["exp"])
        n = int((power[1] or power[2]).translate(_SUPER).replace("−", "-"))
        if abs(n) > MOST_EXPONENT:
            return None
        value *= Fraction(10) ** n
    return value


# ---------------------------------------------------------------------------------------------- figures of a text

#: Counts of animals and numbers of groups are no figures.
_COUNTS = re.compile(r"\(?\s*\b(?:groups?|n\s*=|no\.|pages?|table|day|batch)\s*\d+(?:\s*(?:and|,|-)\s*\d+)*\s*\)?|\b\d+\s+(?:animals?|males?|females?|rats?|mice|rabbits?|dogs?|hens?|pigs?|subjects?|groups?|plates?)\b", re.I)
_LABEL_UNIT = re.compile(r"[\[(]\s*(.+?)\s*[\])]\s*$|\bin\s+(.+?)\s*$", re.I)
_CONSECUTIVE = re.compile(r"(\s*)consecutive\s+", re.I)
_BLANKS = re.compile(r"\s{2,}")
_LIST_GAP = re.compile(r"\s*(?:,|;|and|or|&|to|/|,\s*and)\s*\Z", re.I)


@dataclass(frozen=True)
class Figure:
    value: Fraction
    unit: Unit


#: A label ends at the first colon, if neither a sentence nor a line ends before.
_HEAD = re.compile(r"(?:[^:\n.!?;]|[.!?;](?!\s))*:")
#: Code points behind a number that are read for its unit; an expression that comes near the end is read again in full.
_NEAR, _FULL = 160, 100


def _unit_behind(body: str, at: int) -> tuple[Unit, int] | None:
    for after in (body[at : at + _NEAR], None):
        if after is None:
            after = body[at:]
        skipped = _CONSECUTIVE.match(after)
        got = parse_unit(skipped[1] + after[skipped.end() :] if skipped else after)
        if not got or got[1] < _FULL or len(after) < _NEAR:
            # where a word is left out, only the unit itself is known to be read
            return (got[0], 0) if got and skipped else got
    return got


def figures(text: str | None) -> list[Figure]:
    """All figures with a unit, in order. Null and texts without figures give an empty list."""
    if not text:
        return []
    label_unit, body = None, _BLANKS.sub(lambda m: m[0][0], text)
    if h := _HEAD.match(body):
        head, body = h[0][:-1], body[h.end() :]
        if m := _LABEL_UNIT.search(head):
            named = (m[1] or m[2]).strip()
            got = parse_unit(named)
            if got and not named[got[1] :].strip(" )]"):
                label_unit = got[0]
    body = _COUNTS.sub(" ", body)
    found: list[tuple[Fraction | None, Unit | None, int, int]] = []
    at = 0
    while m := NUMBER.search(body, at):
        got = _unit_behind(body, m.end())
        found.append((parse_number(m), got[0] if got else None, m.start(), m.end()))
        at = m.end() + (got[1] if got else 0)
    # a figure without unit in a list takes the unit of the figure after it
    for i in range(len(found) - 2, -1, -1):
        value, unit, start, end = found[i]
        if unit is None and found[i + 1][1] is not None and _LIST_GAP.match(body[end : found[i + 1][2]]):
            found[i] = (value, found[i + 1][1], start, end)
    return [Figure(v, u or label_unit) for v, u, _, _ in found if v is not None and (u or label_unit)]  # type: ignore[arg-type]


# ---------------------------------------------------------------------------------------------- quantities

MASS_FRACTION, CONCENTRATION = NONE, (1, -3, 0, 0, 0)


@dataclass(frozen=True)
class Quantity:
    """A quantity and, for each vector of dimensions that can express it, what a base unit counts in its common unit."""

    name: str
    common: str
    per_base: dict[Vector, Fraction]


PURITY = Quantity("purity", "parts per million by mass", {NONE: Fraction(10**6)})
DOSE = Quantity("dose", "micrograms per kilogram of body weight", {NONE: Fraction(10**9), (0, 0, -1, 0, 0): Fraction(10**9) * 24})
PLATE = Quantity("plate", "nanograms per plate", {(1, 0, 0, 0, -1): Fraction(10**9)})
AIR = Quantity("air", "micrograms per litre of air", {CONCENTRATION: Fraction(1000)})
DILUTION = Quantity("dilution", "thousandths of a percent", {NONE: Fraction(10**5), CONCENTRATION: Fraction(1, 10)})
DURATION = Quantity("duration", "hours", {(0, 0, 1, 0, 0): Fraction(1)})

#: The quantities that answer a question, tried in order.
BY_QUESTION: dict[str, tuple[Quantity, ...]] = {"question 2": (PURITY,), "question 6": (DOSE, PLATE, AIR), "question 7": (DILUTION,), "question 10": (DURATION,)}


def convert(figure: Figure, quantity: Quantity) -> Fraction | None:
    """The figure in the quantity's common unit, exactly; None if its dimensions are of another quantity."""
    per = quantity.per_base.get(figure.unit.dims)
    return None if per is None else (figure.value * figure.unit.scale + figure.unit.offset) * per


def amounts(text: str | None, quantities: tuple[Quantity, ...]) -> list[tuple[str, int, bool]]:
    """Distinct (quantity, amount in its common unit, whether that is exact), in order of appearance.

    An amount that isn't whole is rounded to the nearest; one that would round to nothing, or is beyond the range of a long,
    has no entry.
    """
    out: dict[tuple[str, int], bool] = {}
    for fig in figures(text):
        for q in quantities:
            if (x := convert(fig, q)) is not None:
                if 0 <= (n := round(x)) < 2**63 and (n or not x):
                    out[q.name, n] = out.get((q.name, n), False) or x.denominator == 1
                break
    return [(q, n, exact) for (q, n), exact in out.items()]


AMOUNTS = ArrayType(StructType([StructField("quantity", StringType()), StructField("amount", LongType()), StructField("exact", BooleanType())]))


def _amounts_udf(by_question: dict[str, tuple[Quantity, ...]]):
    @F.pandas_udf(AMOUNTS)
    def udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for question, text in batches:
            yield pd.Series([[{"quantity": n, "amount": a, "exact": e} for n, a, e in amounts(t, by_question[q])] for q, t in zip(question, text)])

    return udf


def with_amounts(df: DataFrame, question: str | Column, text: str | Column, into: str = "amounts", by_question: dict[str, tuple[Quantity, ...]] | None = None) -> DataFrame:
    """df's rows of the questions in by_question with an array of their figures in common units.

    Rows of other questions and of a null question are left out; a null, empty or unit-less text gives an empty array.
    No shuffle: a narrow map of two columns through Arrow.
    """
    by_question = by_question or BY_QUESTION
    question = F.col(question) if isinstance(question, str) else question
    text = F.col(text) if isinstance(text, str) else text
    return df.where(question.isin(*by_question)).withColumn(into, _amounts_udf(by_question)(question, text))


def found_amounts(run_states: DataFrame) -> DataFrame:
    """state_id, quantity, amount: one row for each distinct figure of corrected_output (questions 2, 6, 7 and 10)."""
    cols = run_states.select("state_id", "question_id", "corrected_output").where(F.col("question_id").isin(*BY_QUESTION) & F.col("corrected_output").isNotNull())
    return with_amounts(spread(cols), "question_id", "corrected_output").select("state_id", F.explode("amounts").alias("a")).select("state_id", "a.quantity", "a.amount")


def dimensions(dims: Vector) -> str:
    """A vector as text: "mass length^-3"; "1" without dimensions."""
    return " ".join(n if e == 1 else f"{n}^{e}" for n, e in zip(BASE, dims) if e) or "1"


@F.pandas_udf(ArrayType(StructType([StructField("dimensions", StringType()), StructField("value", DoubleType())])))
def base_figures(text: pd.Series) -> pd.Series:
    """All figures of a text in base units (gram, metre, hour, kelvin, plate), temperatures by scale and offset."""
    return pd.Series([[{"dimensions": dimensions(f.unit.dims), "value": float(f.value * f.unit.scale + f.unit.offset)} for f in figures(t) if abs(f.value) < 10**300] for t in text])
