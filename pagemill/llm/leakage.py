"""Evaluation texts in a corpus: pigeonhole pieces, exact piece hits, Myers' distance within an error budget.

Words are runs of letters or digits, case aside. An item of n words is cut into n // piece_words pieces of piece_words
words; its error budget is one less than its pieces. With at most so many edits of words one piece stays whole, so a
document that holds the item within its budget has an exact hit of a piece. Also every stretch of 2 * piece_words - 1
words of an item holds one of its pieces, so a document that shares such a run has a hit too. Hits are verified:

whole  the item's distance (Myers, bit-parallel, free ends in the document) around its hits is within the budget
part   the passage around a hit has a distance small enough for run_words common words in a row, and has them

Piece hashes (8 bytes each) go to the tasks, in blocks of at most MOST_PIECES; hits alone are joined to the items by hash.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import materialised, spread

WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Hashes that a task holds (128 MB); items with more pieces are taken in blocks, each a pass over the documents.
MOST_PIECES = 16_000_000


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def myers(pattern: list, text: list) -> tuple[int, int]:
    """Least edit distance of pattern to a stretch of text, and where the best stretch ends (free ends in text).

    Bit-parallel over the pattern: one step of a few operations on integers of len(pattern) bits for each word of text.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    peq: dict = defaultdict(int)
    for i, w in enumerate(pattern):
        peq[w] |= 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


_HASHES: dict[str, int] = {}


def word_hashes(ws: list[str]) -> np.ndarray:
    """A hash of 64 bits for each word; those of usual words are kept."""
    if len(_HASHES) > 1_000_000:
        _HASHES.clear()
    get, out = _HASHES.get, []
    for w in ws:
        h = get(w)
        if h is None:
            h = _HASHES[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = out * _BASE + hashes[i : len(hashes) - k + 1 + i]
    return out


def _pieces(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """hash, item, at, of each piece; n: words of the item."""
    for pdf in batches:
        rows = []
        for item, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
            ws = words(text)
            grams = gram_hashes(word_hashes(ws), k)[::k].view(np.int64).tolist()
            rows += [(h, item, i * k, len(ws)) for i, h in enumerate(grams)]
        yield pd.DataFrame(rows, columns=["hash", "_item", "at", "n"])


def _hits(known: np.ndarray, k: int, reach: int):
    """Parts of documents with hits: their words with reach words around, and place and hash of each hit."""
    part = max(256, 2 * reach)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                ws = words(text)
                grams = gram_hashes(word_hashes(ws), k)
                at = np.searchsorted(known, grams)
                at[at == len(known)] = 0
                found = np.flatnonzero(known[at] == grams)
                for no in np.unique(found // part).tolist():
                    own = found[found // part == no]
                    first = max(0, no * part - reach)
                    rows.append((key, " ".join(ws[first : (no + 1) * part + reach]), (own - first).tolist(), grams[own].view(np.int64).tolist()))
            yield pd.DataFrame(rows, columns=["_key", "words", "places", "hashes"])

    return run


def _run(item: list[str], text: list[str], hits: list[tuple[int, int]], k: int, least: int) -> int:
    """Most common words in a row around hits (place in text, place in item), where a passage's distance leaves room for least."""
    best, covered = 0, {}
    for p, q in sorted(hits):
        if p < covered.get(p - q, 0):
            continue  # within a run that was seen
        a, b = max(0, q - least + k), min(len(item), q + least)
        if myers(item[a:b], text[max(0, p - least) : p + 2 * least])[0] > b - a - least:
            continue
        i = j = 0
        while p > i and q > i and text[p - i - 1] == item[q - i - 1]:
            i += 1
        while p + j < len(text) and q + j < len(item) and text[p + j] == item[q + j]:
            j += 1
        covered[p - q] = p + j
        best = max(best, i + j)
    return best


def _distance(item: list[str], text: list[str], hits: list[tuple[int, int]], budget: int) -> int:
    """Least distance of item to the stretches that its hits lead to."""
    best, until, begin = len(item), -1, 0
    spans: list[tuple[int, int]] = []
    for d in sorted({p - q for p, q in hits}):
        begin, end = max(0, d - budget), d + len(item) + budget
        if spans and begin <= until:
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((begin, end))
        until = end
    for begin, end in spans:
        best = min(best, myers(item, text[begin:end])[0])
    return best


def _verify(k: int, run_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, item, text, own, hits in zip(pdf["_key"], pdf["_item"], pdf["words"], pdf["_text"], pdf["hits"]):
                ws, t = words(own), text.split(" ")
                places = [(p, q) for p, q in ((int(h["place"]), int(h["at"])) for h in hits) if t[p : p + k] == ws[q : q + k]]
                if not places:
                    continue  # equal hashes of other words
                budget = len(ws) // k - 1
                distance = _distance(ws, t, places, budget)
                length = _run(ws, t, places, k, run_words)
                if distance <= budget or length >= run_words:
                    rows.append((key, item, length, distance, budget, len(ws)))
            yield pd.DataFrame(rows, columns=["_key", "_item", "run_words", "distance", "budget", "item_words"])

    return run


def find_leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", run_words: int = 12, piece_words: int = 6) -> DataFrame:
    """key, item, run_words, distance, budget, item_words, leak: one row for each document and item that leaked into it.

    leak is 'whole' where distance, the edits of words that turn the item into its best stretch of the document, is
    within budget; else 'part': run_words words in a row are shared. run_words of a row is the longest shared run, of
    those around hits. Items of fewer than piece_words words, null and empty texts have no row; rows of equal keys count
    as one document. run_words must be 2 * piece_words - 1 at least, as shorter runs might hold no piece.
    """
    if run_words < 2 * piece_words - 1:
        raise ValueError("run_words must be at least 2 * piece_words - 1")
    kind, item_kind = documents.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    own = items.select(F.col(item).alias("_item"), F.col(item_text).alias("_text")).where(F.col("_text").isNotNull())
    pieces = materialised(own.mapInPandas(lambda b: _pieces(b, piece_words), f"hash long, _item {item_kind}, at int, n int"))
    size = pieces.agg(F.approx_count_distinct("hash"), F.coalesce(F.max("n"), F.lit(0))).first()
    blocks, reach = -(-size[0] // MOST_PIECES), size[1] * 2
    docs = spread(documents.select(F.col(key).alias("_key"), text).where(F.col(text).isNotNull()))
    parts = None
    for n in range(max(1, blocks)):
        block = pieces if blocks <= 1 else pieces.where(F.pmod("hash", F.lit(blocks)) == n)
        known = np.sort(np.array([r[0] for r in block.select("hash").distinct().toLocalIterator()], dtype=np.int64).view(np.uint64))
        if not len(known):
            continue
        found = docs.mapInPandas(_hits(known, piece_words, reach), f"_key {kind}, words string, places array<int>, hashes array<long>")
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        parts = docs.where("false").select("_key", F.lit("").alias("words"), F.array(F.lit(0)).alias("places"), F.array(F.lit(0).cast("long")).alias("hashes"))
    parts = materialised(parts.withColumn("_part", F.monotonically_increasing_id()))
    hits = parts.select("_part", F.explode(F.arrays_zip("places", "hashes")).alias("h")).select("_part", F.col("h.places").alias("place"), F.col("h.hashes").alias("hash"))
    # hits of one part and item: at most a part's words times the item's equal pieces
    pairs = hits.join(pieces, "hash").groupBy("_part", "_item").agg(F.collect_list(F.struct("place", "at")).alias("hits"))
    full = pairs.join(parts.select("_part", "_key", "words"), "_part").join(own, "_item")
    seen = full.mapInPandas(_verify(piece_words, run_words), f"_key {kind}, _item {item_kind}, run_words int, distance int, budget int, item_words int")
    best = seen.groupBy(F.col("_key").alias(key), F.col("_item").alias(item)).agg(F.max("run_words").alias("run_words"), F.min("distance").alias("distance"), F.first("budget").alias("budget"), F.first("item_words").alias("item_words"))
    return best.withColumn("leak", F.when(F.col("distance") <= F.col("budget"), "whole").otherwise("part"))
