"""Lines repeated excessively within one source, found by content-defined chunking with rolling hashes.

The letters of a text (case aside) are cut into chunks where a rolling hash of the last WINDOW letters meets a mask; a
line end is a cut too, as the cases are lines: equal lines then have equal chunks whatever stands around them. Passes:

1. For each source and hash bucket of chunks, the number of distinct documents (combined in the workers, then summed).
   A bucket counts at least as many documents as any of its chunks, so no excessive chunk is lost. There are many more
   buckets than a mean document has chunks, so that few buckets are excessive by chance.
2. Lines all of whose chunks are in excessive buckets are counted exactly, by their letters, per source.
3. Lines at most two edits from an excessive one are looked up by pieces: of three pieces of a line two edits leave one
   whole, moved by two places at most. Distinct lines with a piece in common are joined by its hash and verified.
4. Every line whose hash, with its source's, is among those of passes 2 and 3 is found; documents come out without them.

Buckets, lengths and pieces go to the tasks as bits (32 MB at most, whatever the data): a bit too much only means a look
too much. The hashes of pass 4 take 8 bytes each and go in blocks of MOST_LINES, each a pass.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import materialised, spread

WINDOW, MASK, LEAST = 8, np.uint64(31), 8
#: Buckets for each chunk of a mean document.
ROOM = 64
EDITS = 2
#: Code points that a worker looks at together; longer texts are taken in segments of whole lines.
SEGMENT = 1_000_000
#: Line hashes that a task holds (128 MB).
MOST_LINES = 16_000_000
#: Distinct lines that a worker holds before it hands them on.
HELD = 200_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case letter of each code point of the basic plane, 0 for what is no letter."""
    table = np.zeros(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = ord(ch.lower()[0])
    return table


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return _mix(np.arange(1, 0x10001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_ODD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (_ODD, pow(_ODD, -1, 2**64)))  # type: ignore[return-value]


def source_hash(source: str | None) -> int:
    return 1 if source is None else xxhash.xxh3_64_intdigest(source.encode("utf-8", "surrogatepass"))


def _keyed(hashes: np.ndarray, sources: np.ndarray, *kinds) -> np.ndarray:
    """Keys of hashes within sources; kinds (lengths, places ...) keep apart what isn't the same."""
    out = hashes ^ sources
    for k in kinds:
        out = _mix(out + np.asarray(k).astype(np.uint64) * np.uint64(_ODD))
    return _mix(out)


class Bits:
    """A bit for each key of a table: tells what surely isn't among them."""

    def __init__(self, keys: DataFrame, most: int = 28) -> None:
        """keys: key long, written before."""
        self.mask = (1 << min(most, max(16, (64 * keys.count()).bit_length()))) - 1
        self.bits = np.zeros((self.mask + 1) >> 6, dtype=np.uint64)
        rows = keys.groupBy(F.expr(f"shiftrightunsigned(key & {self.mask}L, 6)").alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(key & 63L as int)))").alias("b"))
        for r in rows.toLocalIterator():
            self.bits[r["i"]] = r["b"] & 0xFFFFFFFFFFFFFFFF

    def has(self, keys: np.ndarray) -> np.ndarray:
        return self.bits[(keys & np.uint64(self.mask)) >> np.uint64(6)] >> (keys & np.uint64(63)) & np.uint64(1) != 0


class Lines:
    """The lines with letters of a list of texts: text and number of each (from 1), its letters and their chunks."""

    def __init__(self, texts: list[str]) -> None:
        joined = "\n".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        low = _letters()[np.minimum(cp, 0xFFFF)]
        if len(cp) and cp.max() > 0xFFFF:
            for i in np.flatnonzero(cp > 0xFFFF):
                ch = chr(cp[i])
                low[i] = ord(ch.lower()[0]) if ch.isalpha() else 0
        line = np.cumsum(cp == 10, dtype=np.int64)
        where = np.flatnonzero(low)
        self.letters, line = low[where], line[where]
        # lines of each text: the separators end a text's last line
        per = np.fromiter((t.count("\n") + 1 for t in texts), dtype=np.int64, count=len(texts))
        first = np.concatenate([[0], np.cumsum(per)])
        self.start = np.flatnonzero(np.diff(line, prepend=-1))
        self.length = np.diff(self.start, append=len(line))
        number = line[self.start]
        self.text = np.searchsorted(first, number, "right") - 1
        self.line_no = number - first[self.text] + 1
        self.values = _values()[np.minimum(self.letters, 0xFFFF)] ^ self.letters.astype(np.uint64)
        base, self.inverse = _powers(1 << max(10, len(self.letters).bit_length()))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values * base[: len(self.values)], dtype=np.uint64)])

    def strings(self) -> str:
        return self.letters.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the letters from each start to each end."""
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def keys(self, sources: np.ndarray) -> np.ndarray:
        """Key of each line in its source; sources: a hash for each text."""
        return _keyed(self.hashes(self.start, self.start + self.length), sources[self.text])

    def chunks(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each chunk and the line (an index of start) it is of."""
        n = len(self.letters)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        roll = self.values.copy()
        for k in range(1, WINDOW):
            s = np.uint64(7 * k)
            roll[k:] += (self.values[:-k] << s) | (self.values[:-k] >> (np.uint64(64) - s))
        of = np.repeat(np.arange(len(self.start)), self.length)
        inside = np.arange(n) - self.start[of]
        cut = ((_mix(roll) & MASK) == 0) & (inside >= WINDOW - 1)
        seen = np.cumsum(cut)
        cut[LEAST:] &= seen[LEAST:] - seen[:-LEAST] == 1
        begin = np.zeros(n, dtype=bool)
        begin[1:] = cut[:-1]
        begin[self.start] = True
        at = np.flatnonzero(begin)
        return self.hashes(at, np.append(at[1:], n)), of[at]


def _groups(keys: list, sources: list, texts: list) -> Iterator[tuple[list, list, list, int, bool]]:
    """Rows in groups of at most SEGMENT code points; a longer text comes alone, in segments of whole lines.

    Yields keys, sources, texts, lines before the segment, and whether the group ends its texts.
    """
    k, s, t, size = [], [], [], 0
    for key, source, text in zip(keys, sources, texts):
        if not text:
            continue
        if size and size + len(text) > SEGMENT:
            yield k, s, t, 0, True
            k, s, t, size = [], [], [], 0
        if len(text) > SEGMENT:
            at, before = 0, 0
            while at < len(text):
                end = text.find("\n", at + SEGMENT)
                end = len(text) if end < 0 else end
                part = text[at:end]
                yield [key], [source], [part], before, end + 1 >= len(text)  # a last line feed begins no segment
                before += part.count("\n") + 1
                at = end + 1
            continue
        k.append(key)
        s.append(source)
        t.append(text)
        size += len(text)
    if k:
        yield k, s, t, 0, True


def _source_hashes(sources: list) -> np.ndarray:
    known = {s: source_hash(s) for s in set(sources)}
    return np.array([known[s] for s in sources], dtype=np.uint64)


def _bucket_counts(buckets: int):
    """source, key (of source and bucket), documents: of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict = {}
        keys, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def combine() -> None:
            nonlocal keys, counts, waiting
            whole = np.concatenate([keys, *waiting])
            weight = np.concatenate([counts, np.ones(len(whole) - len(keys), np.int64)])
            keys, back = np.unique(whole, return_inverse=True)
            counts = np.bincount(back, weights=weight, minlength=len(keys)).astype(np.int64)
            waiting = []

        def sent() -> Iterator[pa.RecordBatch]:
            nonlocal keys, counts
            combine()
            names = list(codes)
            own = _source_hashes(names)
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                key = _keyed((part % buckets).astype(np.uint64), own[part // buckets]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(part // buckets)), pa.array(key), pa.array(counts[at : at + 50_000])], names=["source", "key", "documents"])
            keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        held: list[np.ndarray] = []
        for b in batches:
            for _, sources, texts, _, ends in _groups(range(b.num_rows), b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines = Lines(texts)
                hashes, of = lines.chunks()
                bucket = (hashes % np.uint64(buckets)).astype(np.int64)
                held.append(np.unique(lines.text[of] * buckets + bucket))
                if not ends:
                    continue
                own = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
                held = []
                code = np.fromiter((codes.setdefault(s, len(codes)) for s in sources), dtype=np.int64, count=len(sources))
                waiting.append(code[own // buckets] * buckets + own % buckets)
            if sum(map(len, waiting)) > 4_000_000:
                combine()
                if len(keys) > 4_000_000:
                    yield from sent()
        yield from sent()

    return run


def _letter_rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 10_000):
        part = rows[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in part], pa.string()), pa.array([x for _, x, _ in part], pa.string()), pa.array([n for _, _, n in part])], names=["source", "letters", "documents"])


def _candidates(sent, buckets: int):
    """source, letters, documents of a partition: lines all of whose chunks are in excessive buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: Bits = sent.value
        found: Counter = Counter()
        held: set = set()
        for b in batches:
            for _, sources, texts, _, ends in _groups(range(b.num_rows), b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines = Lines(texts)
                hashes, of = lines.chunks()
                cold = ~hot.has(_keyed(hashes % np.uint64(buckets), _source_hashes(sources)[lines.text[of]]))
                bad = np.bincount(of[cold], minlength=len(lines.start))
                text = lines.strings()
                for i in np.flatnonzero(bad == 0):
                    held.add((int(lines.text[i]), sources[lines.text[i]], text[lines.start[i] : lines.start[i] + lines.length[i]]))
                if ends:
                    found.update((s, line) for _, s, line in held)
                    held = set()
            if len(found) > HELD:
                yield from _letter_rows([(s, x, n) for (s, x), n in found.items()])
                found = Counter()
        yield from _letter_rows([(s, x, n) for (s, x), n in found.items()])

    return run


def _spans(length: int, edits: int) -> list[tuple[int, int]]:
    """The pieces of a line of so many letters, one more than edits."""
    return [(length * i // (edits + 1), length * (i + 1) // (edits + 1)) for i in range(edits + 1)]


def _pieces(edits: int):
    """source, letters, kind, key: keys of the pieces ('p') of excessive lines and of the lengths ('l') that are near theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for source, letters in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own, lines, n = _source_hashes([source]), Lines([letters]), len(letters)
                at = np.array(_spans(n, edits), dtype=np.int64)
                keys = _keyed(lines.hashes(at[:, 0], at[:, 1]), own, np.full(len(at), n), np.arange(len(at)))
                rows += [(source, letters, "p", k) for k in keys.view(np.int64).tolist()]
                near = np.arange(max(1, n - edits), n + edits + 1).astype(np.uint64)
                rows += [(source, letters, "l", k) for k in _keyed(near, own).view(np.int64).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["source", "letters", "kind", "key"])

    return run


def _near(sent, edits: int):
    """source, letters, keys: distinct lines of a partition that have pieces in common with excessive lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, pieces = sent.value
        seen: dict[tuple, list[int] | None] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            own = [(s, x, ks) for (s, x), ks in seen.items()]
            for at in range(0, len(own), 10_000):
                part = own[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in part], t) for k, t in enumerate((pa.string(), pa.string(), pa.list_(pa.int64())))], names=["source", "letters", "keys"])

        for b in batches:
            for _, sources, texts, _, _ in _groups(range(b.num_rows), b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines = Lines(texts)
                own = _source_hashes(sources)[lines.text]
                fits = np.flatnonzero(lengths.has(_keyed(lines.length.astype(np.uint64), own)))
                # equal lines of a source are looked at once
                _, first = np.unique(_keyed(lines.hashes(lines.start, lines.start + lines.length), own)[fits], return_index=True)
                fits = fits[first]
                own, start, length = own[fits], lines.start[fits], lines.length[fits]
                hits: dict[int, set[int]] = defaultdict(set)
                for n in range(-edits, edits + 1):
                    whole = length + n
                    for i in range(edits + 1):
                        a, e = whole * i // (edits + 1), whole * (i + 1) // (edits + 1)
                        for shift in range(-edits, edits + 1):
                            ok = np.flatnonzero((whole > 0) & (a + shift >= 0) & (e + shift <= length))
                            if not len(ok):
                                continue
                            at = start[ok] + shift
                            keys = _keyed(lines.hashes(at + a[ok], at + e[ok]), own[ok], whole[ok], np.full(len(ok), i))
                            for k in np.flatnonzero(pieces.has(keys)).tolist():
                                hits[int(ok[k])].add(int(keys[k].view(np.int64)))
                text = lines.strings()
                for k, keys_ in hits.items():
                    seen[sources[lines.text[fits[k]]], text[start[k] : start[k] + length[k]]] = list(keys_)
            if len(seen) > HELD:
                yield from rows()
                seen.clear()
        yield from rows()

    return run


def _line_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, sources, texts, _, _ in _groups(range(b.num_rows), b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(Lines(texts).keys(_source_hashes(sources)).view(np.int64))], names=["key"])


def _marks(known: np.ndarray):
    """For each row with content: row index and numbers of its lines whose keys are among known (sorted)."""

    def run(sources: list, texts: list) -> dict[int, list[int]]:
        out: dict[int, list[int]] = defaultdict(list)
        for rows, srcs, parts, before, _ in _groups(list(range(len(texts))), sources, texts):
            lines = Lines(parts)
            keys = lines.keys(_source_hashes(srcs))
            at = np.searchsorted(known, keys)
            at[at == len(known)] = 0
            for i in np.flatnonzero(known[at] == keys) if len(known) else ():
                out[rows[lines.text[i]]].append(int(lines.line_no[i]) + before)
        return out

    return run


def excessive_lines(docs: DataFrame, source: str, text: str, least: int = 3, percent: int = 8) -> DataFrame:
    """source, letters, documents: lines that stand in at least so many and in at least percent of a source's rows.

    Rows with null text count in the total; a row counts once. A null source is a source of its own.
    """
    spark = docs.sparkSession
    cols = docs.select(F.col(source).alias("source"), F.col(text).alias("text"))
    totals = materialised(docs.groupBy(F.col(source).alias("_s")).agg(F.count("*").alias("total"), F.avg(F.length(text)).alias("mean")))
    mean = totals.agg(F.coalesce(F.max("mean"), F.lit(0.0))).first()[0]
    buckets = 1 << max(12, int(mean / 32 * ROOM).bit_length())
    some = spread(cols.where(F.col("text").isNotNull()))
    rule = (F.col("documents") >= least) & (F.col("documents") * 100 >= F.col("total") * percent)

    def excessive(counted: DataFrame, what: str) -> DataFrame:
        summed = counted.groupBy("source", what).agg(F.sum("documents").alias("documents"))
        return summed.join(totals, F.col("source").eqNullSafe(F.col("_s"))).where(rule).select("source", what, "documents")

    hot = materialised(excessive(some.mapInArrow(_bucket_counts(buckets), "source string, key long, documents long"), "key"))
    sent = spark.sparkContext.broadcast(Bits(hot))
    return excessive(some.mapInArrow(_candidates(sent, buckets), "source string, letters string, documents long"), "letters")


def _known(docs: DataFrame, source: str, text: str, edits: int, rule: dict) -> Iterator[np.ndarray]:
    """Blocks of sorted keys of the lines to be found: excessive ones and those near them."""
    spark = docs.sparkSession
    lines = materialised(excessive_lines(docs, source, text, **rule))
    pieces = materialised(lines.select("source", "letters").mapInArrow(_pieces(edits), "source string, letters string, kind string, key long"))
    sent = spark.sparkContext.broadcast((Bits(pieces.where("kind = 'l'").select("key")), Bits(pieces.where("kind = 'p'").select("key"))))
    some = spread(docs.select(F.col(source).alias("source"), F.col(text).alias("text")).where(F.col(text).isNotNull()))
    near = some.mapInArrow(_near(sent, edits), "source string, letters string, keys array<long>").groupBy("source", "letters").agg(F.first("keys").alias("keys"))
    pairs = near.select("source", "letters", F.explode("keys").alias("key")).join(pieces.where("kind = 'p'").select("key", F.col("source").alias("_s"), F.col("letters").alias("_l")), "key")
    held = pairs.where(F.col("source").eqNullSafe(F.col("_s")) & (F.levenshtein("letters", "_l", edits) >= 0)).select("source", "letters").distinct()
    keys = materialised(held.mapInArrow(_line_keys, "key long").distinct())
    blocks = max(1, -(-keys.count() // MOST_LINES))
    for n in range(blocks):
        block = keys if blocks == 1 else keys.where(F.pmod("key", F.lit(blocks)) == n)
        yield np.sort(np.fromiter((r[0] for r in block.toLocalIterator()), dtype=np.int64).view(np.uint64))


def found_lines(docs: DataFrame, key: str = "doc_key", source: str = "issuer", text: str = "content", edits: int = EDITS, **rule: int) -> DataFrame:
    """key, line_no: every line repeated excessively in its own source, or at most so many edits from such a line.

    Null and empty texts and lines without letters give no row.
    """
    kind = docs.schema[key].dataType
    some = spread(docs.select(key, F.col(source).alias("source"), F.col(text).alias("text")).where(F.col(text).isNotNull()))
    out = None
    for block in _known(docs, source, text, edits, rule):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            marks = _marks(sent.value)
            for b in batches:
                got = marks(b.column(1).to_pylist(), b.column(2).to_pylist())
                rows = [i for i, ns in got.items() for _ in ns]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array([n for ns in got.values() for n in ns], pa.int32())], names=[key, "line_no"])

        part = some.mapInArrow(run, f"{key} {kind.simpleString()}, line_no int")
        out = part if out is None else out.unionByName(part)
    return out


def remove_lines(docs: DataFrame, source: str = "issuer", text: str = "content", edits: int = EDITS, **rule: int) -> DataFrame:
    """docs with text freed from its excessive lines and their line feeds, otherwise unchanged; n_removed counts them.

    Null text stays null; a column of docs that is named n_removed or _c gives way.
    """
    docs = docs.drop("n_removed", "_c")
    cleaned = spread(docs)
    for n, block in enumerate(_known(docs, source, text, edits, rule)):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        @F.pandas_udf("struct<text:string,n:int>")
        def clean(source, text, sent=sent):  # type: ignore[no-untyped-def]
            import pandas as pd

            texts = [None if x is None or x is pd.NA else x for x in text]
            got = _marks(sent.value)(list(source), texts)
            rows = []
            for i, x in enumerate(texts):
                if drop := set(got.get(i, ())):
                    x = "\n".join(line for k, line in enumerate(x.split("\n"), 1) if k not in drop)
                rows.append((x, len(drop) if i in got else 0))
            return pd.DataFrame(rows, columns=["text", "n"])

        cleaned = cleaned.withColumn("_c", clean(F.col(source), F.col(text))).withColumn(text, F.col("_c.text")).withColumn("n_removed", F.col("_c.n") + (F.col("n_removed") if n else F.lit(0))).drop("_c")
    return cleaned
