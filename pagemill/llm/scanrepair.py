"""Text of scanned pages: running lines, printed page numbers, broken words and misrecognised characters.

Edge lines. The first and last lines of a page are reduced to a skeleton of letters that recognition leaves alone,
without numbers; a skeleton that enough pages of a study share on the same side is a running line. A line that is
nothing but a number in some form is the page number if its distance to the page's position is the study's usual one.

Misreads. The corpus' words are counted. A rare word is joined to frequent ones over the difference of their anagram
hashes: a hash is the sum of its letters' fifth powers, so each confusion (e read as c, m as rn ...) shifts it by a
constant, wherever it stands. Hits are verified by place and ranked by frequency. A figure with letters in it (l for 1)
is corrected if the corpus has the plain figure often enough beside it, so that codes such as S9 stay. The corrections
don't leave the cluster: a sieve of their hashes (16 MB at most) tells which words of the text to join with them.

Broken words. Halves at line ends, within a page or across its body's end, are joined; the corpus decides between the
joined and the hyphenated spelling. All steps but the two scans of the text are joins and aggregates on small rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pagemill.session import materialised, spread

# ---------------------------------------------------------------------------------------------- edge lines

TOP, BOTTOM = 3, 3
_SOLID = frozenset("bfgjkopqstxyz")
_SOLID_MAP = str.maketrans("60a95+ﬁﬂ", "boogstff")
_SKIPPED = re.compile(r"[\dlosbiz|.,/()\[\]-]*\d[\dlosbiz|.,/()\[\]-]*\Z|(?:\D*\d){3}")
_DIGITS = str.maketrans("lIOoSsBb", "11005588")
_PAGE_WORD = r"(?:page|seite|pagina|página|blatt|pag\.?|pg\.?|p\.?|s\.?|p[aá]g\.?)"
_PAGE_NO = re.compile(rf"[-–—~*.\[(|]*{_PAGE_WORD}?[.:]?(?P<n>[\dlIOoSB]{{1,5}}|[ivxlc]{{1,8}})(?P<of>(?:[o0]f|von|/|de|sur)[\dlIOoSB]{{1,5}})?[-–—~*.\])|]*\Z", re.I)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


class _Solid(dict):
    """A table for str.translate that keeps solid letters, after _SOLID_MAP, and drops all else."""

    def __missing__(self, c: int) -> str:
        kept = "".join(x for x in chr(c).translate(_SOLID_MAP) if x in _SOLID)
        self[c] = kept
        return kept


_TO_SOLID = _Solid()
_FIGURE = re.compile(r"\d")


def skeleton(line: str) -> str:
    """The line's letters that no usual confusion touches, without numbers and blanks."""
    line = line.lower()
    if _FIGURE.search(line):
        line = "".join([w for w in line.split() if not _SKIPPED.match(w)])
    return line.translate(_TO_SOLID)


def roman(s: str) -> int | None:
    total = 0
    for a, b in zip(s, [*s[1:], ""]):
        if a not in _ROMAN:
            return None
        total += -_ROMAN[a] if _ROMAN.get(b, 0) > _ROMAN[a] else _ROMAN[a]
    return total


def page_number(line: str) -> tuple[int, bool] | None:
    """Number and whether it is marked as one (by a word, signs or a total), if the line is nothing else."""
    if len(line) > 40:
        return None
    bare = re.sub(r"\s+", "", line)
    if not (m := _PAGE_NO.match(bare)):
        return None
    s = m["n"]
    if any(c.isdigit() for c in s):
        n = int(s.translate(_DIGITS))
    else:
        r = roman(s.lower())
        if r is None or s.lower() != s and not s.isupper():
            return None
        n = r
    return n, m[0] != s


def edges_of(content: str) -> list[tuple[int, str, bool, int]]:
    """(number from 1, stripped text, whether on top, depth) of a page's first and last lines that aren't blank."""
    lines = content.split("\n")
    first: list[tuple[int, str]] = []
    last: list[tuple[int, str]] = []
    for i, x in enumerate(lines, 1):
        if s := x.strip():
            first.append((i, s))
            if len(first) == TOP + BOTTOM:
                break
    if len(first) == TOP + BOTTOM:
        # at least so many lines: the last ones are looked up from the end
        low = first[TOP - 1][0]
        for i in range(len(lines), low, -1):
            if s := lines[i - 1].strip():
                last.append((i, s))
                if len(last) == BOTTOM:
                    break
        return [(i, s, True, j) for j, (i, s) in enumerate(first[:TOP])] + [(i, s, False, j) for j, (i, s) in reversed(list(enumerate(last)))]
    n = len(first)
    return [(i, s, True, j) if j < TOP and j <= n - 1 - j else (i, s, False, n - 1 - j) for j, (i, s) in enumerate(first)]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
    for b in batches:
        rows = []
        for page, study, pos, content in zip(*(c.to_pylist() for c in b.columns)):
            if not content or pos is None:
                continue
            for no, text, top, depth in edges_of(content):
                number = page_number(text)
                words = text.split()
                rows.append((page, study, pos, no, top, depth, skeleton(text), number[0] if number else None, bool(number and number[1]), bool(study) and study in text, f"{words[0]} {words[-1]}" if len(words) > 1 else words[0]))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 11, [b.column(0).type, *types])], names=["page_key", "study_id", "pos", "line_no", "top", "depth", "skeleton", "number", "marked", "names_study", "ends"])


def edge_lines(pages: DataFrame) -> DataFrame:
    kind = pages.schema["page_key"].dataType.simpleString()
    cols = pages.select("page_key", "study_id", F.expr("try_cast(metadata.page_num as int)").alias("pos"), "content").where(F.col("content").isNotNull())
    return spread(cols).mapInArrow(_edges, f"page_key {kind}, study_id string, pos int, line_no int, top boolean, depth int, skeleton string, number int, marked boolean, names_study boolean, ends string")


def classify_edges(edges: DataFrame, least_pages: int = 3, share: float = 0.2) -> DataFrame:
    """page_key, study_id, pos, line_no, ends and defect (running, page_no or null) of edges.

    A running line's skeleton stands on at least least_pages pages of the study and share of them, on the same side
    (two pages do if the line names the study); the page number's distance to the position is the one that most of the
    study's numbers have, on two pages at least, or three if it is bare.
    """
    # pages of a study counted once, whatever their number of scans; two-step aggregates keep hot studies spread
    total = edges.groupBy("study_id", "pos").agg(F.lit(1).alias("one")).groupBy(F.col("study_id").alias("_s")).agg(F.count("*").alias("pages"))
    outer = F.when(F.col("top"), F.col("depth") <= 1).otherwise(F.col("depth") <= 2)
    shared = edges.where(outer & (F.length("skeleton") >= 3) & F.col("number").isNull()).groupBy("study_id", "top", "skeleton", "pos").agg(F.min("depth").alias("depth"), F.max("names_study").alias("named"))
    shared = shared.groupBy(F.col("study_id").alias("_s"), F.col("top").alias("_t"), F.col("skeleton").alias("_k")).agg(F.count("*").alias("on_pages"), F.min("depth").alias("nearest"), F.max("named").alias("named"))
    shared = shared.join(total, "_s").where(((F.col("on_pages") >= least_pages) & (F.col("on_pages") >= share * F.col("pages")) & (F.col("nearest") <= 1)) | ((F.col("on_pages") == 2) & F.col("named") & (F.col("nearest") == 0)))
    offsets = edges.where("number is not null").groupBy("study_id", (F.col("number") - F.col("pos")).alias("offset"), "pos").agg(F.max("marked").alias("marked")).groupBy("study_id", "offset").agg(F.count("*").alias("n"), F.sum(F.col("marked").cast("int")).alias("m"))
    usual = offsets.where("n >= 2 and m >= 1 or n >= 3").groupBy(F.col("study_id").alias("_u")).agg(F.max_by("offset", F.struct(F.col("n") + F.col("m"), F.col("m"), -F.abs("offset"))).alias("usual"))
    marked = edges.join(shared.select("_s", "_t", "_k", F.lit(True).alias("running")), (F.col("study_id") == F.col("_s")) & (F.col("top") == F.col("_t")) & (F.col("skeleton") == F.col("_k")), "left").join(usual, F.col("study_id") == F.col("_u"), "left")
    is_number = F.col("number").isNotNull() & (F.col("number") - F.col("pos") == F.col("usual")) & (F.col("marked") | (F.col("depth") <= 1))
    return marked.withColumn("defect", F.when(is_number, "page_no").when(F.col("running") & outer, "running")).select("page_key", "study_id", "pos", "line_no", "ends", "defect")


# ---------------------------------------------------------------------------------------------- words

#: What is read for what: (misread, right).
CONFUSIONS = [("c", "e"), ("e", "c"), ("0", "o"), ("!", "i"), ("o", "a"), ("+", "t"), ("1", "l"), ("1", "i"), ("5", "s"), ("l", "i"), ("i", "l"), ("(", "c"), ("rn", "m"), ("m", "rn"), ("ii", "u"), ("li", "h"), ("h", "li"), ("cl", "d"), ("d", "cl"), ("m", "in"), ("in", "m"), ("6", "b"), ("b", "h"), ("9", "g"), ("n", "ri"), ("ri", "n"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("vv", "w"), ("w", "vv"), ("8", "b"), ("2", "z"), ("3", "e"), ("4", "a"), ("7", "t"), ("|", "l"), ("t", "f"), ("f", "t"), ("nn", "m"), ("$", "s"), ("@", "a"), ("€", "e")]
_STRIP = ".,;:\"'[]?“”„»«…"
_BROKEN = re.compile(r"[^\W\d_][-‐‑¬\xad]\Z")
_MARK = "-‐‑¬\xad"
_WORDY = re.compile(r"[^\W\d_]")
_CODE = re.compile(r"[a-z]{1,3}-?\d[\d-]*\Z|\d[\d.,/-]*(?:mg|kg|g|ml|l|h|d)?\Z|[a-z\d]{1,3}\d{4,}\Z")
_MISREAD_NUMBER = re.compile(r"[\dlIOSB]*\d[\dlIOSB]*(?:[.,][\dlIOSB]+)*\Z")
_TO_DIGITS = str.maketrans("lIOSB", "11058")


def anagram_hash(word: str) -> int:
    """Sum of the letters' fifth powers (of each the lowest 40 bits, so that rare signs fit a long)."""
    return sum(ord(c) ** 5 % 2**40 for c in word)


def core(token: str) -> str:
    return token.strip(_STRIP)


_HALF = re.compile(r"[-‐‑¬\xad](?=[^\S\n]*(?:\n|\Z))(?<=[^\W\d_].)")
_NEXT = re.compile(r"\S+")


def _halves(content: str) -> list[str]:
    """Halves at line ends and the words behind them."""
    out: dict[int, str] = {}
    for m in _HALF.finditer(content):
        line = content[content.rfind("\n", 0, m.start()) + 1 : m.end()]
        half = line.rsplit(None, 1)[-1]
        out[m.end() - len(half)] = half
        if n := _NEXT.search(content, m.end()):
            out[n.start()] = n[0]
    return list(out.values())


def figure(token: str) -> str:
    """The token, if it is a figure or could be one with misread digits; else empty."""
    w = token.strip(_STRIP + "()")
    return w if _MISREAD_NUMBER.match(w) else ""


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n, hash of a partition; figures stand behind "#"."""
    raw: Counter = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal raw
        counts: Counter = Counter()
        for t, n in raw.items():
            if n <= 0:
                continue
            if f := figure(t):
                counts["#" + f] += n
            w = t.strip(_STRIP).lower()
            if len(w) < 2 or not _WORDY.search(w) or _CODE.match(w):
                continue
            counts[w] += n
            if (inner := w.strip("()!+")) != w and len(inner) > 1:
                counts[inner] += n
        raw = Counter()
        rows = list(counts.items())
        for at in range(0, len(rows), 20_000):
            part = rows[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64()), pa.array([anagram_hash(w) for w, _ in part], pa.int64())], names=["word", "n", "hash"])

    for b in batches:
        for content in b.column(0).to_pylist():
            if content:
                raw.update(content.split())
                raw.subtract(_halves(content))
        if len(raw) > 500_000:
            yield from flush()
    yield from flush()


def vocabulary(pages: DataFrame) -> DataFrame:
    """word, n, hash over all pages; figures are kept apart from words by a "#" before them."""
    return spread(pages.select("content").where(F.col("content").isNotNull())).mapInArrow(_vocabulary, "word string, n long, hash long").groupBy("word").agg(F.sum("n").alias("n"), F.first("hash").alias("hash"))


def figure_corrections(words: DataFrame) -> DataFrame:
    """word, right: figures with letters for digits, where the corpus has the plain figure twice as often, or hardly any.

    What looks like a code (one letter, then digits) needs four times as many plain figures.
    """
    figures = words.where("word like '#%'")
    odd = figures.where(F.col("word").rlike("[lIOSB]") & (F.length("word") > 2)).select("word", "n", F.translate("word", "lIOSB", "11058").alias("plain"))
    seen = odd.join(figures.select(F.col("word").alias("plain"), F.col("n").alias("m")), "plain", "left").fillna(0, ["m"])
    code = F.col("word").rlike(r"^#[IOSB]\d+$")
    enough = F.when(code, F.col("m") >= 4 * F.col("n")).otherwise((F.col("m") >= 2 * F.col("n")) | (F.col("n") <= 2))
    return seen.where(enough).select("word", F.expr("substring(plain, 2)").alias("right"))


def corrections(words: DataFrame, extra: DataFrame | None = None, least: int = 8, ratio: int = 25) -> DataFrame:
    """word, right: rare words that one confusion turns into a frequent word, the most frequent one first.

    Words with a sign or digit inside need a variant at least twice as frequent; all-letter words one of at least
    least occurrences and ratio times their own beyond the first. extra holds further words (joined halves) to be looked up.
    """
    words = words.where("word not like '#%'")
    rare = words.select("word", "n", "hash")
    if extra is not None:
        rare = rare.unionByName(extra)
    shifts = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(anagram_hash(b) - anagram_hash(a)).cast("long").alias("shift")) for a, b in CONFUSIONS])
    shifted = rare.where(F.length("word") >= 2).withColumn("c", F.explode(shifts)).where(F.expr("locate(c.a, word) > 0")).select("word", "n", F.col("c.a").alias("a"), F.col("c.b").alias("b"), (F.col("hash") + F.col("c.shift")).alias("target"))
    right = words.where(F.col("word").rlike(r"^[\p{L}][\p{L}'’-]*[\p{L}]$|^[\p{L}]+$")).select(F.col("word").alias("right"), F.col("n").alias("m"), F.col("hash").alias("target"))
    placed = F.expr("exists(sequence(1, length(word)), p -> substr(word, p, length(a)) = a and concat(substr(word, 1, p - 1), b, substr(word, p + length(a))) = right)")
    odd = F.col("word").rlike(r"[^\p{L}'’-]")
    enough = F.when(odd, (F.col("m") >= 2) & (F.col("m") >= 2 * F.col("n"))).otherwise((F.col("m") >= least) & (F.col("m") >= ratio * (F.col("n") - 1)))
    hits = shifted.join(right, "target").where(enough & placed)
    return hits.groupBy("word").agg(F.max_by("right", F.struct("m", "right")).alias("right"))


class Sieve:
    """Two bits for each of a table's words: tells what surely isn't among them. At most 2^27 bits, whatever the table."""

    def __init__(self, words: DataFrame) -> None:
        """words: word, written before."""
        n = words.count()
        self.mask = (1 << min(27, max(16, (32 * n).bit_length()))) - 1
        mask = self.mask

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                places = [i for w in b.column(0).to_pylist() for i in _places(w, mask)]
                yield pa.RecordBatch.from_arrays([pa.array([i >> 6 for i in places], pa.int64()), pa.array([i & 63 for i in places], pa.int32())], names=["i", "bit"])

        rows = words.select("word").mapInArrow(run, "i long, bit int").groupBy("i").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
        self.bits = np.zeros((mask + 1) >> 6, dtype=np.uint64)
        for r in rows.toLocalIterator():
            self.bits[r["i"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF

    def may_have(self, word: str) -> bool:
        return all(int(self.bits[i >> 6]) >> (i & 63) & 1 for i in _places(word, self.mask))


def _places(word: str, mask: int) -> tuple[int, int]:
    h = xxhash.xxh3_64_intdigest(word)
    return h & mask, h >> 32 & mask


def misread_number(token: str) -> str | None:
    """What a token would be as a plain figure, if it has letters for digits."""
    w = figure(token)
    if len(w) > 1 and not w.isdigit() and (right := w.translate(_TO_DIGITS)) != w:
        return right
    return None


def _asked(token: str, sieve: Sieve) -> tuple[str | None, str | None] | None:
    """The spellings under which corrections may have a token."""
    if misread_number(token) is not None:
        own = ["#" + figure(token)]
    else:
        w = token.strip(_STRIP).lower()
        own = [x for x in dict.fromkeys((w, w.strip("()!+"))) if len(x) > 1]
    own = [x for x in own if sieve.may_have(x)]
    return (own[0], own[1] if len(own) > 1 else None) if own else None


def _scan(sent):
    """page_key, line_no, place (of the word in the line), kind, word, other, next_line of a partition.

    kind 'm': a word that corrections may have, as word or as other; 'h': a half at a line's end, with its rest as other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, known, nothing = sent.value, {}, {()}
        for b in batches:
            out: list[list] = [[] for _ in range(7)]

            def add(*row) -> None:  # type: ignore[no-untyped-def]
                for k, x in enumerate(row):
                    out[k].append(x)

            for page, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not content:
                    continue
                if len(known) > 300_000:  # it only spares repeats
                    known.clear()
                half = None
                for no, line in enumerate(content.split("\n"), 1):
                    tokens = line.split()
                    if not tokens:
                        half = None
                        continue
                    begin, end = 0, len(tokens)
                    if half:
                        add(page, half[0], None, "h", half[1], tokens[0], no)
                        begin = 1
                        half = None
                    if tokens[-1][-1] in _MARK and _BROKEN.search(tokens[-1]) and end > begin:
                        half = (no, tokens[-1])
                        end -= 1
                    if set(map(known.get, tokens[begin:end])) <= nothing:
                        continue
                    for i in range(begin, end):
                        t = tokens[i]
                        if (asked := known.get(t)) is None:
                            asked = known[t] = _asked(t, sieve) or ()
                        if asked:
                            add(page, no, i, "m", *asked, None)
            types = [b.column(0).type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["page_key", "line_no", "place", "kind", "word", "other", "next_line"])

    return run


def _joined(rows: DataFrame) -> DataFrame:
    """rows (word: first half, rest) with both spellings in lower case, without punctuation marks at the ends."""
    trim = f"""^[\\s{re.escape(_STRIP)}()]+|[\\s{re.escape(_STRIP)}()]+$"""
    first = F.regexp_replace(F.lower("word"), f"[{_MARK}]$", "")
    first = F.regexp_replace(first, trim, "")
    rest = F.regexp_replace(F.lower("rest"), trim, "")
    return rows.withColumn("whole", F.concat(first, rest)).withColumn("hyphenated", F.concat(first, F.lit("-"), rest)).where(F.length(rest) > 0)


@F.pandas_udf(LongType())
def _hash_of(words: pd.Series) -> pd.Series:
    return words.map(anagram_hash)


class Repair:
    """The findings over a table of pages; tables that several steps use are written once to the shared folder."""

    def __init__(self, pages: DataFrame) -> None:
        self.pages = pages
        self.key_type = pages.schema["page_key"].dataType.simpleString()
        self.words = materialised(vocabulary(pages))
        self.edges = materialised(classify_edges(materialised(edge_lines(pages))))

    def _ends(self) -> DataFrame:
        """Halves at the end of a page's body with the word that opens the body of the study's next page."""
        body = self.edges.where("defect is null")
        last = body.groupBy("page_key", "study_id", "pos").agg(F.max_by(F.struct("line_no", "ends"), "line_no").alias("l"))
        last = last.select("page_key", "study_id", "pos", F.col("l.line_no").alias("line_no"), F.element_at(F.split("l.ends", " "), -1).alias("word")).where(F.col("word").rlike(f"\\p{{L}}[{_MARK}]$"))
        first = body.groupBy("study_id", "pos").agg(F.min_by("ends", F.struct("page_key", "line_no")).alias("ends"))
        first = first.select("study_id", (F.col("pos") - 1).alias("pos"), F.element_at(F.split("ends", " "), 1).alias("rest"))
        return last.join(first, ["study_id", "pos"]).select("page_key", "line_no", "word", "rest")

    def found(self) -> DataFrame:
        """page_key, line_no, defect, word."""
        return self.noted().select("page_key", "line_no", "defect", "word").distinct()

    def noted(self) -> DataFrame:
        """page_key, line_no, place, defect, word: found, with the place in its line of each misread word."""
        spark = self.pages.sparkSession
        flagged = self.edges.where("defect is not null").select("page_key", "line_no", "defect")
        right = materialised(corrections(self.words).unionByName(figure_corrections(self.words)))
        sent = spark.sparkContext.broadcast(Sieve(right))
        text = spread(self.pages.select("page_key", "content").where(F.col("content").isNotNull()))
        scanned = materialised(text.mapInArrow(_scan(sent), f"page_key {self.key_type}, line_no int, place int, kind string, word string, other string, next_line int"))
        lines = flagged.select("page_key", "line_no")
        asked = scanned.where("kind = 'm'").select("page_key", "line_no", "place", "word", "other")
        misread = asked.join(right.withColumnRenamed("right", "r1"), "word", "left").join(right.select(F.col("word").alias("other"), F.col("right").alias("r2")), "other", "left").select("page_key", "line_no", "place", F.lit("misread").alias("defect"), F.coalesce("r1", "r2").alias("word")).where("word is not null")
        misread = misread.join(lines, ["page_key", "line_no"], "left_anti")
        inner = scanned.where("kind = 'h'").select("page_key", "line_no", "word", F.col("other").alias("rest"), "next_line").join(lines.withColumnRenamed("line_no", "next_line"), ["page_key", "next_line"], "left_anti").select("page_key", "line_no", "word", "rest")
        inner = inner.join(lines, ["page_key", "line_no"], "left_anti")
        halves = materialised(_joined(inner.unionByName(self._ends())).dropDuplicates(["page_key", "line_no"]))
        counts = self.words.select(F.col("word").alias("_w"), "n")
        known = halves.join(counts.select(F.col("_w").alias("whole"), F.col("n").alias("n_whole")), "whole", "left").join(counts.select(F.col("_w").alias("hyphenated"), F.col("n").alias("n_hyphenated")), "hyphenated", "left").fillna(0, ["n_whole", "n_hyphenated"])
        # joined halves that no word is equal to may have been misread too
        unknown = known.where("n_whole = 0 and n_hyphenated = 0").select(F.explode(F.array("whole", "hyphenated")).alias("word")).distinct().select("word", F.lit(0).cast("long").alias("n"), _hash_of("word").alias("hash"))
        mended = corrections(self.words.where("n >= 8"), unknown).join(unknown.select("word"), "word", "left_semi")
        known = known.join(mended.select(F.col("word").alias("whole"), F.col("right").alias("r1")), "whole", "left").join(mended.select(F.col("word").alias("hyphenated"), F.col("right").alias("r2")), "hyphenated", "left")
        word = F.when((F.col("n_hyphenated") > F.col("n_whole")) | F.col("hyphenated").rlike(r"-\d"), F.col("hyphenated")).when(F.col("n_whole") > 0, F.col("whole")).otherwise(F.coalesce("r1", "r2", "whole"))
        hyphen = known.select("page_key", "line_no", F.lit("hyphen").alias("defect"), word.alias("word"))
        nowhere = F.lit(None).cast("int").alias("place")
        return flagged.select("*", F.lit("").alias("word"), nowhere).unionByName(misread).unionByName(hyphen.select("*", nowhere))

    def paragraphs(self) -> DataFrame:
        """study_id, paragraph (from 0), first_page, text: the repaired text of each study, over page ends.

        Of the scans of a position the smallest page_key is taken. A blank line ends a paragraph; a page's last one goes
        on to the next page unless it ends a sentence. Only first and last paragraphs of pages are brought together;
        numbers come from sums over blocks of pages, so that no task holds a study.
        """
        found = materialised(self.noted())
        notes = found.groupBy("page_key").agg(F.collect_list(F.struct("line_no", "defect", "word", "place")).alias("notes"))
        pages = self.pages.select("page_key", "study_id", F.expr("try_cast(metadata.page_num as int)").alias("pos"), "content").where(F.col("content").isNotNull() & F.col("pos").isNotNull() & F.col("study_id").isNotNull())
        single = pages.join(pages.groupBy("study_id", "pos").agg(F.min("page_key").alias("page_key")).select("page_key"), "page_key", "left_semi")
        taken = self._ends().join(found.where("defect = 'hyphen'").select("page_key", "line_no"), ["page_key", "line_no"], "left_semi").select("page_key").join(pages.select("page_key", "study_id", "pos"), "page_key").select("study_id", (F.col("pos") + 1).alias("pos")).distinct().withColumn("taken", F.lit(True))
        rows = single.join(notes, "page_key", "left").join(taken, ["study_id", "pos"], "left").select("study_id", "pos", "content", "notes", F.coalesce("taken", F.lit(False)).alias("taken"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for study, pos, content, own, cut in zip(pdf["study_id"], pdf["pos"], pdf["content"], pdf["notes"], pdf["taken"]):
                    marks = [(n["line_no"], n["defect"], n["word"], n["place"]) for n in own] if own is not None else []
                    parts = repaired(content, marks, cut)
                    out += [(study, pos, k, len(parts), bool(_CLOSED.search(t)), t) for k, t in enumerate(parts)]
                yield pd.DataFrame(out, columns=["study_id", "pos", "part", "parts", "closed", "text"])

        parts = materialised(rows.mapInPandas(run, "study_id string, pos int, part int, parts int, closed boolean, text string"))
        ends = parts.where("part = parts - 1").select("study_id", "pos", "parts", "closed", F.expr("pos div 1024").alias("block"))
        inside = Window.partitionBy("study_id", "block").orderBy("pos")
        blocks = ends.groupBy("study_id", "block").agg(F.max_by("closed", "pos").alias("end"))
        entered = blocks.select("study_id", "block", F.lag("end").over(Window.partitionBy("study_id").orderBy("block")).alias("before"))
        # a page's first paragraph is a new one, unless the page before ends an open one
        pages_ = ends.join(entered, ["study_id", "block"]).withColumn("fresh", F.coalesce(F.lag("closed").over(inside), "before", F.lit(True))).withColumn("new", F.col("parts") - 1 + F.col("fresh").cast("int"))
        sums = pages_.groupBy("study_id", "block").agg(F.sum("new").alias("sum"))
        offset = F.coalesce(F.sum("sum").over(Window.partitionBy("study_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        numbered = pages_.join(sums.select("study_id", "block", offset.alias("offset")), ["study_id", "block"]).select("study_id", "pos", (F.col("offset") + F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("parts")).alias("base"))
        placed = parts.join(numbered, ["study_id", "pos"]).select("study_id", (F.col("base") + F.col("part")).alias("paragraph"), "pos", "part", "parts", "text")
        whole = placed.where("part > 0 and part < parts - 1").select("study_id", "paragraph", F.col("pos").alias("first_page"), "text")
        edges = placed.where("part = 0 or part = parts - 1").groupBy("study_id", "paragraph").agg(F.min("pos").alias("first_page"), F.sort_array(F.collect_list(F.struct("pos", "part", "text"))).alias("t"))
        return whole.unionByName(edges.select("study_id", "paragraph", "first_page", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text")))


_CLOSED = re.compile(r"[.!?:][\"')\]]*$")


def _replaced(token: str, word: str) -> str:
    """The token with its core put right; brackets stay, but for those that were read for letters."""
    inner = core(token)
    bare = inner.strip("()!+")
    low = bare.lower()
    if inner != bare and (misread_number(token) == word or any(low[i : i + len(a)] == a and low[:i] + b + low[i + len(a) :] == word for a, b in CONFUSIONS for i in range(len(low)))):
        inner = bare
    if not inner:
        return token
    cased = word.upper() if inner.isupper() and len(inner) > 2 else word.capitalize() if inner[0].isupper() else word
    return token.replace(inner, cased, 1)


def repaired(content: str, marks: list[tuple[int, str, str, int | None]], taken: bool) -> list[str]:
    """Paragraphs of a page's body; taken: its first word has gone to the page before."""
    gone = {n for n, d, _, _ in marks if d in ("running", "page_no")}
    broken = {n: w for n, d, w, _ in marks if d == "hyphen"}
    wrong = {(n, i): w for n, d, w, i in marks if d == "misread"}
    out: list[list[str]] = [[]]
    for n, line in enumerate(content.split("\n"), 1):
        if n in gone:
            continue
        tokens = [_replaced(t, wrong[n, i]) if (n, i) in wrong else t for i, t in enumerate(line.split())]
        if not tokens:
            if out[-1]:
                out.append([])
            continue
        if taken:
            tokens, taken = tokens[1:], False
        if n in broken and tokens:
            first = tokens[-1]
            tokens[-1] = broken[n].capitalize() if first[:1].isupper() else broken[n]
            taken = True
        out[-1] += tokens
    return [" ".join(p) for p in out if p]


def found_noise(pages: DataFrame) -> DataFrame:
    """page_key, line_no, defect, word of all pages; null and blank pages have none."""
    return Repair(pages).found()
