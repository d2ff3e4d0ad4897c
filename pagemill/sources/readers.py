"""Sources: report files to pages, table pages through a reader, texts to vectors, prompts to answers.

PDF, OCR, embedding and language models aren't part of the engine. Each stage takes a plain Python callable, which the
workers call on Arrow batches; a deterministic stand-in is given for each, so that every pipeline runs without them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text as T

#: Takes a file's bytes and gives its pages' texts in order.
PageReader = Callable[[bytes], list[str]]
#: Takes texts and gives unit vectors.
Embedder = Callable[[list[str]], list[list[float]]]
#: Takes a prompt and gives an answer.
Answerer = Callable[[str], str]


def studies(spark: SparkSession, directory: str, pattern: str = "*.pdf") -> DataFrame:
    """path, study_id, length of the report files of a directory; contents are read only by pages()."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(directory)
    return files.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("study_id"), "length")


def form_feed_reader(data: bytes) -> list[str]:
    """Stand-in for a PDF reader: UTF-8 text with a form feed between pages."""
    return data.decode("utf-8", "replace").split("\f")


def pages(spark: SparkSession, directory: str, pattern: str = "*.pdf", reader: PageReader = form_feed_reader) -> DataFrame:
    """study_id, page_num (from 1), raw: a row for each page of each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(directory)
    named = files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("study_id"), "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for study, data in zip(pdf["study_id"], pdf["content"]):
                texts = reader(bytes(data))
                yield pd.DataFrame({"study_id": study, "page_num": range(1, len(texts) + 1), "raw": texts})

    return named.mapInPandas(read, "study_id string, page_num int, raw string")


def reread(rows: DataFrame, text: str, reader: Callable[[str, int, str], str], study: str = "study_id", page: str = "page_num") -> DataFrame:
    """rows (table pages) with their text read again: reader takes study, page and the present text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf[text] = [reader(s, int(p), t) for s, p, t in zip(pdf[study], pdf[page], pdf[text])]
            yield pdf

    return rows.mapInPandas(run, rows.schema)


def page_span(pages_: int | list[int] | tuple[int, int] | None, count: int) -> list[int]:
    """Pages (from 0) that an OCR call asks for: one, a list, a range with both ends, or all; what is outside is skipped."""
    if pages_ is None:
        wanted = range(count)
    elif isinstance(pages_, int):
        wanted = range(pages_, pages_ + 1)
    elif isinstance(pages_, tuple):
        wanted = range(pages_[0], pages_[1] + 1)
    else:
        wanted = pages_  # type: ignore[assignment]
    return [p for p in wanted if 0 <= p < count]


def hashing_embedder(texts: list[str], size: int = 64) -> list[list[float]]:
    """Deterministic stand-in for an embedding model: signed hashed words, L2-normalised; a blank text gives zeros."""
    out = []
    for t in texts:
        v = [0.0] * size
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
            v[h % size] += 1.0 if h & 0x10000 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        out.append([x / n for x in v] if n else v)
    return out


def embed(df: DataFrame, text: str, into: str = "vector", embedder: Embedder = hashing_embedder) -> DataFrame:
    """df with a vector for each text, batch by batch."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(embedder(s.fillna("").tolist()))

    return df.withColumn(into, run(F.col(text)))


def extractive_answerer(prompt: str) -> str:
    """Stand-in for a language model: the excerpt's sentence that shares most words with the question, else "Null"."""
    question = set(prompt.rpartition("Question:")[2].lower().split())
    excerpt = prompt.partition("BEGIN EXCERPT-----")[2].partition("-----END EXCERPT")[0]
    best, most = "Null", 1
    for s in excerpt.replace("\n", " ").split(". "):
        if (n := len(question & set(s.lower().split()))) > most:
            best, most = s.strip(), n
    return best


def answer(prompts: DataFrame, prompt: str = "prompt", into: str = "output", answerer: Answerer = extractive_answerer) -> DataFrame:
    """prompts with an answer for each."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(answerer)

    return prompts.withColumn(into, run(F.col(prompt)))


def handbook(pages_: DataFrame, text: str = "raw") -> DataFrame:
    """Pages of a handbook with the marked title that each may carry."""
    return pages_.withColumn("title", F.nullif(T.strip(F.regexp_extract(text, r"\+\+\+([^+]+)\+\+\+", 1)), F.lit("")))
