"""Column functions over text: tokens, n-grams, lines, embeddings. Everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words and the token pattern define the results of every retrieval query.
STOPWORDS = """
a an the and or but if then is are was were be been being of to in on at for with by from as this that these those it its
does do did has have had can could should would will shall may might not so
""".split()
TOKEN = r"\b(?:[A-Za-z]+(?:/[A-Za-z]+)?|\d+(?:\.\d+)?%?)\b|%"

#: Word characters beyond ASCII; they end no token and are none, so they are masked before ASCII patterns run. What else
#: is beyond ASCII, combining marks too, separates.
FOREIGN = r"[^\x00-\x7F\p{P}\p{S}\p{Z}\p{M}\p{C}]"


def let(value: Column, body) -> Column:  # type: ignore[no-untyped-def]
    """body(value), with value computed once a row: a column that an expression names often is otherwise computed as often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case tokens: words, word/word, numbers and % signs. Null gives an empty array."""
    masked = F.regexp_replace(F.regexp_replace(F.lower(text), FOREIGN, "_"), r"[^\x00-\x7F]", " ")
    return F.coalesce(F.regexp_extract_all(masked, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def ngrams(toks: Column, n: int) -> Column:
    """All n-grams as strings; none if there are fewer than n tokens."""
    return F.when(
        F.size(toks) >= n,
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(toks) - (n - 1), F.lit(1))), lambda i: F.concat_ws(" ", F.slice(toks, i, n))),
    ).otherwise(F.array().cast("array<string>"))


def candidates(toks: Column, most: int = 2) -> Column:
    """Distinct n-grams up to most words, shorter ones first, that neither start nor end on a stop word."""
    stop = F.array(*map(F.lit, STOPWORDS))

    def kept(gram: Column) -> Column:
        words = F.split(gram, " ")
        return ~F.array_contains(stop, F.element_at(words, 1)) & ~F.array_contains(stop, F.element_at(words, -1))

    every = F.concat(*[ngrams(toks, n) for n in range(1, most + 1)])
    return F.array_distinct(F.filter(every, kept))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def unicode_lines(text: Column) -> Column:
    """Lines split at every Unicode line boundary."""
    return F.split(text, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]", -1)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def full_lines(text: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(unicode_lines(text), strip), lambda s: F.length(s) > 0)


def words_of(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: F.length(w) > 0)


def n_words(text: Column) -> Column:
    return F.size(words_of(text))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
