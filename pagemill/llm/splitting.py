"""Oversized items cut into pieces under a limit, at natural boundaries, with an exact overlap.

An item is looked at in ranges. A worker sees a range with halos: the overlap before it and a piece behind it. It makes
the range's boundary table and, from it, each step of the plan: the cut that follows a cut. What follows a cut depends on
nothing but the cut, so ranges can be planned apart:

1. Detect: of each range, the units it holds and, for each cut at which the plan may enter it, the cut by which it leaves
   and the pieces between.
2. Stitch: these tables (no text) are followed from the item's start; prefix sums of pieces and units number the pieces.
3. Emit: each range cuts its own pieces by offset from its entry on.

An item of at most spread_chars code points is taken by one worker, range by range in order, where each entry is known.
Ranges of longer ones, and those of files (read by seek, never as a whole), go to all workers. Both give the same pieces.

Sizes count code points ("chars"), UTF-8 bytes ("bytes") or words ("words": runs of anything but blank, tab, CR, LF).
A cut takes the best kind of boundary in the window between max(overlap + 1, half the limit) and the limit, of these the
last. Where there is none, a piece ends at the last multiple of a 32nd of the window before the limit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from pagemill.session import materialised, spread

WORD = re.compile(r"[^ \t\r\n]+")
#: A boundary stands behind blanks (behind the last line end among them) or behind a full-width full stop.
_GAP = re.compile(r"[ \t\r\n]+|[。！？](?![ \t\r\n])")
#: Kinds of boundaries, best first: paragraph, line, sentence, clause, word; forced cuts are -1, the end is 9.
PARAGRAPH, LINE, SENTENCE, CLAUSE, GAP, FORCED, END = 4, 3, 2, 1, 0, -1, 9
#: Code points around a place that decide whether and of what kind a boundary it is.
HALO = 64
RANGE_CHARS, SPREAD_CHARS = 4096, 1 << 20


def size(text: str, unit: str) -> int:
    """Nothing is trimmed; words are runs of anything but blank, tab, carriage return and line feed."""
    if unit == "bytes":
        return len(text.encode("utf-8", "surrogateescape"))
    if unit == "words":
        return len(WORD.findall(text))
    return len(text)


def boundaries(text: str, begin: int = 0, end: int | None = None) -> tuple[list[int], list[int]]:
    """Places and kinds of the boundaries in (begin, end] of text; nothing beyond HALO code points around one tells."""
    end = len(text) if end is None else end
    places, kinds = [], []
    for m in _GAP.finditer(text, max(0, begin - HALO), min(len(text), end + 2 * HALO)):
        run, at = m[0], m.end()
        found: list[tuple[int, int]] = []
        if "\n" in run or "\r" in run:
            ends = [i + 1 for i, c in enumerate(run) if c == "\n" or c == "\r" and run[i + 1 : i + 2] != "\n"]
            for i, q in enumerate(ends):
                if i + 1 == len(ends) or ends[i + 1] - q > HALO:
                    found.append((m.start() + q, PARAGRAPH if i and q - ends[i - 1] < HALO else LINE))
        if run[0] in "。！？":
            found.append((at, SENTENCE))
        elif not found or m.end() - found[-1][0] >= HALO:
            before = text[max(0, m.start() - 3) : m.start()].rstrip("\"')]»”")[-1:] if len(run) < HALO and not found else ""
            found.append((at, GAP if not before else SENTENCE if before in ".!?…" else CLAUSE if before in ";:," else GAP))
        for at, kind in found:
            if begin < at <= end and at < len(text):
                places.append(at)
                kinds.append(kind)
    return places, kinds


class Short(Exception):
    """A stretch doesn't show enough of its item."""


class Stretch:
    """What a worker sees of an item: text, with the place of its first code point in the item.

    Places count code points, or bytes where the item is a file. first, last: text begins or ends the item.
    """

    def __init__(self, text: str, unit: str, most: int, overlap: int, at: int = 0, first: bool = True, last: bool = True, in_bytes: bool = False) -> None:
        self.text, self.unit, self.n, self.at, self.first, self.last = text, unit, len(text), at, first, last
        self.most, self.overlap = most, max(0, min(overlap, most - 1))
        self.half = max(self.overlap + 1, most // 2)
        room = most - self.half
        self.grid = 1 if room < 256 else room // 32
        self.bytes = self.starts = None
        if (unit == "bytes" or in_bytes) and not text.isascii():
            cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            wide = 1 + (cp >= 0x80) + (cp >= 0x800).astype(np.int64) + (cp >= 0x10000)
            wide[(cp >= 0xDC80) & (cp <= 0xDCFF)] = 1  # a byte that is no UTF-8
            self.bytes = np.concatenate([[0], np.cumsum(wide)])
        if unit == "words":
            self.starts = [m.start() for m in WORD.finditer(text)]
        self.in_bytes = in_bytes and self.bytes is not None
        self.cuts: tuple[list[int], list[int]] = ([], [])
        self.seen = 0
        self.after: dict[int, tuple[int, int, int]] = {}

    def place(self, p: int) -> int:
        return self.at + (int(self.bytes[p]) if self.in_bytes else p)

    def local(self, place: int) -> int:
        return int(np.searchsorted(self.bytes, place - self.at)) if self.in_bytes else place - self.at

    def units(self, start: int, end: int) -> int:
        if self.starts is not None:
            return bisect_left(self.starts, end) - bisect_left(self.starts, start)
        if self.unit == "bytes" and self.bytes is not None:
            return int(self.bytes[end] - self.bytes[start])
        return end - start

    def furthest(self, start: int, most: int) -> int:
        """The last place that has at most so many units from start on."""
        if self.starts is not None:
            beyond = bisect_left(self.starts, start) + most
            p = self.starts[beyond] if beyond < len(self.starts) else self.n
        elif self.unit == "bytes" and self.bytes is not None:
            p = int(np.searchsorted(self.bytes, self.bytes[start] + most, "right")) - 1
        else:
            p = min(self.n, start + most)
        if not self.last and p > self.n - HALO:
            raise Short
        return p

    def least(self, start: int, units: int) -> int:
        """The first place that has at least so many units from start on."""
        if self.starts is not None:
            k = bisect_left(self.starts, start) + units - 1
            return self.starts[k] + 1 if k < len(self.starts) else self.n
        if self.unit == "bytes" and self.bytes is not None:
            return min(self.n, int(np.searchsorted(self.bytes, self.bytes[start] + units, "left")))
        return min(self.n, start + units)

    def back(self, end: int) -> int:
        """Where a piece begins that repeats the overlap before end."""
        if not self.overlap or not end and self.first:
            return end
        if self.starts is not None:
            k = bisect_left(self.starts, end) - self.overlap
            if k <= 0 and not self.first:
                raise Short
            return self.starts[max(0, k)] if self.starts else end
        if self.unit == "bytes" and self.bytes is not None:
            goal = self.bytes[end] - self.overlap
            if goal < 0 and not self.first:
                raise Short
            return int(np.searchsorted(self.bytes, max(0, goal), "left"))
        if end < self.overlap and not self.first:
            raise Short
        return max(0, end - self.overlap)

    def _table(self, until: int) -> tuple[list[int], list[int]]:
        """The boundary table, made up to a place in ranges of RANGE_CHARS."""
        while self.seen < until:
            end = min(self.n, self.seen + RANGE_CHARS)
            p, k = boundaries(self.text, self.seen, end)
            self.cuts[0].extend(p)
            self.cuts[1].extend(k)
            self.seen = end
        return self.cuts

    def step(self, end: int) -> tuple[int, int, int]:
        """(start, end, kind of its cut) of the piece behind a cut at end."""
        if got := self.after.get(end):
            return got
        start = self.back(end)
        limit = self.furthest(start, self.most)
        if limit <= end and start < end:
            # an overlap that leaves no room for anything new is given up
            start = end
            limit = self.furthest(start, self.most)
        limit = max(limit, start + 1)  # a code point larger than the limit is a piece
        if limit >= self.n and self.last:
            got = start, self.n, END
        else:
            low = min(max(self.least(start, self.half), end + 1), limit)
            places, kinds = self._table(limit)
            i, j = bisect_left(places, low), bisect_right(places, limit)
            if i < j:
                best = max(kinds[i:j])
                while kinds[j - 1] != best:
                    j -= 1
                got = start, places[j - 1], best
            else:
                forced = self.local(self.place(limit) // self.grid * self.grid)
                got = start, forced if low <= forced else limit, FORCED
        self.after[end] = got
        return got

    def path(self, entry: int, until: int) -> list[tuple[int, int, int]]:
        """The pieces whose cut before is at or behind entry and before until."""
        out, end = [], entry
        while True:
            out.append(self.step(end))
            end = out[-1][1]
            if end >= until or out[-1][2] == END:
                return out

    def entries(self, begin: int, end: int) -> list[int]:
        """The cuts in [begin, end) at which a plan can enter: those less than a piece behind begin."""
        zone = min(end, self.furthest(begin, self.most) + 1)
        places, _ = self._table(zone)
        first = self.local(-(-self.place(begin) // self.grid) * self.grid)
        grid = range(begin, zone) if self.grid == 1 and self.unit != "words" else () if self.unit == "words" else {self.local(p) for p in range(self.place(first), self.place(min(zone, self.n)) + 1, self.grid)}
        return sorted({p for p in places[bisect_left(places, begin) : bisect_right(places, zone)] if p < end} | {p for p in grid if begin <= p < end})

    def exits(self, begin: int, end: int, start: bool) -> list[tuple[int, int, int]]:
        """(entry, cut by which the plan leaves or -1, pieces between) of the range [begin, end), in places of the item."""
        known: dict[int, tuple[int, int]] = {}
        entries = [begin] if start else self.entries(begin, end)
        for e in entries:
            way, p, out = [], e, None
            while out is None:
                if p in known:
                    out = known[p]
                elif p >= end and p > begin:
                    out = self.place(p), 0
                else:
                    way.append(p)
                    _, p, kind = self.step(p)
                    out = (-1, 0) if kind == END else None
            leave, n = out
            for q in reversed(way):
                n += 1
                known[q] = leave, n
        return [(self.place(e), *known[e]) for e in entries]


def plan(text: str, unit: str, most: int, overlap: int, range_chars: int = RANGE_CHARS) -> list[tuple[int, int, int, int]]:
    """(piece_no, start, end, kind of the cut behind) of a text's pieces, by code points; range by range, in order."""
    n, at, wide = len(text), 0, 16 if unit == "words" else 1
    out: list[tuple[int, int, int, int]] = []
    if most <= 0:
        return [(0, 0, n, END)]
    while True:
        begin = at // range_chars * range_chars
        end = min(n, begin + range_chars)
        a, b = max(0, begin - min(overlap, most) * wide - 2 * HALO), min(n, end + most * wide * 2 + 4 * HALO)
        s = Stretch(text[a:b], unit, most, overlap, a, a == 0, b == n)
        try:
            own = s.path(at - a, end - a)
        except Short:
            wide *= 4
            continue
        out += [(len(out) + i, a + x, a + y, k) for i, (x, y, k) in enumerate(own)]
        if own[-1][2] == END:
            return out
        at = out[-1][2]


# ---------------------------------------------------------------------------------------------- ranges of many tasks

_NOTE = "_item long, _no int, factor long, units long, cuts array<struct<entry:long,leave:long,n:int>>"
_SPANS = "_item long, n_pieces long, n_units long, spans array<struct<no:int,entry:long,piece_no:int,factor:long>>"
_CUTS = pa.list_(pa.struct([("entry", pa.int64()), ("leave", pa.int64()), ("n", pa.int32())]))


def _noted(s: Stretch, begin: int, end: int) -> tuple[int, list[dict] | None]:
    """Units and table of the range from place begin to place end; no table if the halos are too narrow."""
    a, b = s.local(begin), s.local(end)
    try:
        return s.units(a, b), [{"entry": e, "leave": x, "n": n} for e, x, n in s.exits(a, b, begin == 0)]
    except Short:
        return s.units(a, b), None


def _stitch(step: int):
    """Follows the tables of an item's ranges of step places; numbers its pieces by prefix sums."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ranges = {int(no): ({int(c["entry"]): (int(c["leave"]), int(c["n"])) for c in cuts}, int(f)) for no, cuts, f in zip(pdf["_no"], pdf["cuts"], pdf["factor"])}
        spans, at, n = [], 0, 0
        while at >= 0:
            no = at // step
            leave, pieces = ranges[no][0][at]
            spans.append({"no": no, "entry": at, "piece_no": n, "factor": ranges[no][1]})
            at, n = leave, n + pieces
        return pd.DataFrame({"_item": [pdf["_item"].iloc[0]], "n_pieces": [n], "n_units": [int(pdf["units"].sum())], "spans": [spans]})

    return run


def _emitted(s: Stretch, entry: int, end: int) -> list[tuple[int, int, str]]:
    """(start, end, content) of the pieces from an entry on, in places of the item."""
    return [(s.place(a), s.place(b), s.text[a:b]) for a, b, _ in s.path(s.local(entry), s.local(end))]


def _detect(range_chars: int):
    """_item, _no, factor, units, cuts of ranges of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            notes = []
            for text, unit, most, overlap, begin, before, n in zip(*(b.column(c).to_pylist() for c in ("_seen", "_unit", "_most", "_overlap", "_begin", "_before", "_n"))):
                at = begin - before
                s = Stretch(text, unit, most, overlap, at, at == 0, at + len(text) == n)
                notes.append(_noted(s, begin, min(n, begin + range_chars)))
            yield pa.RecordBatch.from_arrays([b.column("_item"), b.column("_no"), b.column("factor"), pa.array([u for u, _ in notes], pa.int64()), pa.array([x for _, x in notes], _CUTS)], names=["_item", "_no", "factor", "units", "cuts"])

    return run


_ADDED = ("piece_no", "n_pieces", "piece_start", "piece_end")


def _pieces(rest: list[str], text: str, range_chars: int | None):
    """rest, text and _ADDED of the pieces of whole rows (range_chars None), or of ranges from their entry on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {c: b.column(c).to_pylist() for c in ("_seen", "_unit", "_most", "_overlap")}
            more = {c: b.column(c).to_pylist() for c in ("_begin", "_before", "_n", "entry", "piece_no", "n_pieces")} if range_chars else {}
            rows: list[tuple] = []
            for k, whole in enumerate(col["_seen"]):
                unit, most, overlap = col["_unit"][k], col["_most"][k], col["_overlap"][k]
                if range_chars:
                    begin, n, at = more["_begin"][k], more["_n"][k], more["_begin"][k] - more["_before"][k]
                    s = Stretch(whole, unit, most, overlap, at, at == 0, at + len(whole) == n)
                    own, first, total = _emitted(s, more["entry"][k], min(n, begin + range_chars)), more["piece_no"][k], more["n_pieces"][k]
                else:
                    own, first = [(x, y, whole[x:y]) for _, x, y, _ in plan(whole, unit, most, overlap)], 0
                    total = len(own)
                rows += [(k, t, first + i, total, x, y) for i, (x, y, t) in enumerate(own)]
            at_rows = pa.array([r[0] for r in rows], pa.int64())
            arrays = [b.column(c).take(at_rows) for c in rest]
            arrays += [pa.array([r[1] for r in rows], b.column("_seen").type), *(pa.array([r[i] for r in rows], t) for i, t in ((2, pa.int32()), (3, pa.int32()), (4, pa.int64()), (5, pa.int64())))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, text, *_ADDED])

    return run


def _stretches(ranges: DataFrame, range_chars: int) -> DataFrame:
    """Ranges (_no) with what a worker sees: the overlap before and a piece behind, of words with factor code points each."""
    wide = F.when(F.col("_unit") == "words", F.col("factor")).otherwise(F.lit(1).cast("long"))
    begin = F.col("_no") * F.lit(range_chars).cast("long")
    cols = ranges.withColumn("_begin", begin).withColumn("_n", F.length("_text").cast("long")).withColumn("_before", F.least(begin, F.least("_overlap", "_most") * wide + 2 * HALO)).withColumn("_after", F.lit(range_chars) + F.col("_most") * wide * 2 + 4 * HALO)
    seen = F.expr("substring(_text, cast(_begin - _before as int) + 1, cast(least(_before + _after, _n) as int))")
    # ranges of one row go to many tasks
    return cols.withColumn("_seen", seen).drop("_text", "_after").repartition(F.col("_item"), F.col("_no"))


def _long_spans(rows: DataFrame, range_chars: int) -> DataFrame:
    """_SPANS of rows (_item, _text, _unit, _most, _overlap): where the plan enters each range. No task sees a whole text."""
    notes, factor, missing = None, 16, None
    while True:
        ranges = rows.select("_item", "_text", "_unit", "_most", "_overlap", F.explode(F.expr(f"sequence(0, cast((length(_text) - 1) div {range_chars} as int))")).alias("_no")).withColumn("factor", F.lit(factor).cast("long"))
        if missing is not None:
            ranges = ranges.join(missing, ["_item", "_no"], "left_semi")
        got = materialised(_stretches(ranges, range_chars).mapInArrow(_detect(range_chars), _NOTE))
        fine = got.where("cuts is not null")
        notes = fine if notes is None else notes.unionByName(fine)
        missing = got.where("cuts is null").select("_item", "_no")
        if missing.isEmpty():
            return notes.groupBy("_item").applyInPandas(_stitch(range_chars), _SPANS)
        factor *= 16  # words longer than thought


# ---------------------------------------------------------------------------------------------- tables


def _could_exceed(text: Column, unit: Column, most: Column) -> Column:
    """A necessary condition for being larger than the limit, JVM-side: spares Python the rest."""
    over = F.when(unit == "bytes", F.octet_length(text) > most).when(unit == "words", F.length(text) > 2 * most).otherwise(F.length(text) > most)
    return F.coalesce(over & (most > 0), F.lit(False))


def with_profiles(docs: DataFrame, profiles: DataFrame, profile: Column) -> DataFrame:
    """docs with _unit, _most and _overlap of their profile; null takes the default's, so do names that profiles lacks.

    profiles is a table of settings (a row a profile); what is sent to the tasks is checked to be at most 10,000 rows,
    beyond that the join is left to Catalyst.
    """
    p = profiles.select(F.col("profile").alias("_profile"), F.col("size_unit").alias("_unit"), F.col("max_size").cast("long").alias("_most"), F.col("overlap_size").cast("long").alias("_overlap"), "is_default")
    few = p.limit(10_001).count() <= 10_000
    default = p.where("is_default").select(F.col("_unit").alias("_u"), F.col("_most").alias("_m"), F.col("_overlap").alias("_o")).limit(1)
    named = p.drop("is_default")
    out = docs.withColumn("_name", profile).join(F.broadcast(named) if few else named, F.col("_name") == F.col("_profile"), "left").join(F.broadcast(default), F.lit(True), "left")
    return out.select(*[F.col(c) for c in docs.columns], F.coalesce("_unit", "_u").alias("_unit"), F.coalesce("_most", "_m").alias("_most"), F.coalesce("_overlap", "_o").alias("_overlap"))


def _parts(sized: DataFrame, text: str, spread_chars: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that keep their limit for sure, rows for one worker each, and long rows, written once, with a number (_item)."""
    over = _could_exceed(F.col(text), F.col("_unit"), F.col("_most"))
    is_long = F.length(text) > spread_chars
    long = sized.where(over & is_long).withColumn("_item", F.monotonically_increasing_id()).withColumnRenamed(text, "_text")
    return sized.where(~over), spread(sized.where(over & ~is_long).withColumnRenamed(text, "_seen")), materialised(long)


def oversized(docs: DataFrame, profiles: DataFrame, key: str = "doc_key", text: str = "content", range_chars: int = 1 << 18, spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """key of every row that the operator cuts into more than one piece; rows of equal keys have a row each."""
    sized = with_profiles(docs.select(key, F.col(text).alias("_t"), F.col("metadata.profile").alias("_p")), profiles, F.col("_p"))
    _, short, long = _parts(sized, "_t", spread_chars)
    kind = sized.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(plan(*x)) for x in zip(*(b.column(c).to_pylist() for c in ("_seen", "_unit", "_most", "_overlap")))]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(n, pa.int64())], names=[key, "n_pieces"])

    counts = short.select(key, "_seen", "_unit", "_most", "_overlap").mapInArrow(run, f"{key} {kind}, n_pieces long")
    if not long.isEmpty():
        counts = counts.unionByName(long.select("_item", key).join(_long_spans(long, range_chars), "_item").select(key, "n_pieces"))
    return counts.where("n_pieces > 1").select(key)


def split(docs: DataFrame, profiles: DataFrame, text: str = "content", range_chars: int = 1 << 18, spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """Every row of docs as one or more pieces: docs' columns with content replaced, piece_no, n_pieces, start, end.

    A row within its limit, also an empty one, is its only piece; a row with null content comes out with null. A limit
    of 0 or less, or none, limits nothing; an overlap of the limit or more is one less than the limit. Pieces overlap by
    overlap_size exactly, in the profile's unit; of bytes by the most whole code points within it. An overlap is given up
    only where not even one code point more would fit. Pieces keep their row's other columns, metadata included; a column
    of docs named as one that is added gives way to it. Keys, null ones too, are not looked at.
    """
    docs = docs.drop(*_ADDED, "_seen", "_text", "_item", "_no", "_begin", "_before", "_after", "_n", "_name", "_profile", "_unit", "_most", "_overlap", "_u", "_m", "_o", "is_default", "entry", "factor", "n_units", "spans", "_s")
    sized = with_profiles(docs, profiles, F.col("metadata.profile"))
    whole, short, long = _parts(sized, text, spread_chars)
    rest = [c for c in docs.columns if c != text]
    schema = StructType([docs.schema[c] for c in [*rest, text]] + [StructField(c, IntegerType() if c[-2:] in ("no", "es") else LongType()) for c in _ADDED])
    kept = whole.select(*rest, text, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).cast("long").alias("piece_start"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("piece_end"))
    out = kept.unionByName(short.mapInArrow(_pieces(rest, text, None), schema))
    if not long.isEmpty():
        spans = _long_spans(long, range_chars)
        ranges = long.join(spans, "_item").select("_item", "_text", "_unit", "_most", "_overlap", *rest, F.col("n_pieces").cast("int").alias("n_pieces"), F.explode("spans").alias("_s")).select("*", F.col("_s.no").alias("_no"), F.col("_s.entry").alias("entry"), F.col("_s.piece_no").alias("piece_no"), F.col("_s.factor").alias("factor")).drop("_s")
        out = out.unionByName(_stretches(ranges, range_chars).mapInArrow(_pieces(rest, text, range_chars), schema))
    return out


# ---------------------------------------------------------------------------------------------- giant files


def _open(path: str):
    """A file by seek, local or by any URI that pyarrow knows."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return where.open_input_file(name)


def _file_stretch(path: str, n: int, begin: int, end: int, unit: str, most: int, overlap: int, factor: int) -> Stretch:
    """The bytes from begin to end with halos, from code point to code point; bytes that are no UTF-8 stay as they are."""
    wide = 4 * (factor if unit == "words" else 1)
    a = max(0, begin - min(overlap, most) * wide - 8 * HALO)
    with _open(path) as f:
        f.seek(a)
        data = f.read(min(n, end + most * 2 * wide + 16 * HALO) - a)
    skip = 0
    while a and skip < min(4, len(data)) and data[skip] & 0xC0 == 0x80:
        skip += 1
    cut = len(data)
    if a + len(data) < n:
        for k in range(1, min(4, len(data)) + 1):
            if data[-k] & 0xC0 != 0x80:
                cut -= k if data[-k] >= 0xC0 else 0
                break
    return Stretch(data[skip:cut].decode("utf-8", "surrogateescape"), unit, most, overlap, a + skip, not a, a + len(data) == n, in_bytes=True)


def _aligned(s: Stretch, place: int) -> int:
    """The first place of a code point at or behind place."""
    return s.place(s.local(place))


def split_files(spark: SparkSession, files: list[tuple[str, int]], unit: str, most: int, overlap: int, range_bytes: int = 16 << 20) -> DataFrame:
    """path, piece_no, n_pieces, start, end (bytes), content of UTF-8 files given as (path, length).

    Paths must be readable by every worker. No task reads more than a range and its halos; empty files give one piece.
    """
    listed = spark.createDataFrame([(k, p, n) for k, (p, n) in enumerate(files)], "_item long, path string, n long")
    ranges = listed.withColumn("_no", F.explode(F.expr(f"sequence(0, cast(greatest(n - 1, 0L) div {range_bytes} as int))"))).repartition(F.col("_item"), F.col("_no"))

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, path, n, no in zip(pdf["_item"], pdf["path"], pdf["n"], pdf["_no"]):
                begin, factor, noted = no * range_bytes, 4, None
                end = min(n, begin + range_bytes)
                while noted is None:
                    factor *= 4
                    s = _file_stretch(path, n, begin, end, unit, most, overlap, factor)
                    units, noted = _noted(s, _aligned(s, begin), _aligned(s, end))
                rows.append((item, no, factor, units, noted))
            yield pd.DataFrame(rows, columns=["_item", "_no", "factor", "units", "cuts"])

    spans = ranges.mapInPandas(detect, _NOTE).groupBy("_item").applyInPandas(_stitch(range_bytes), _SPANS)
    entered = listed.join(spans, "_item").select("_item", "path", "n", "n_pieces", F.explode("spans").alias("s")).select("_item", "path", "n", "n_pieces", "s.*").repartition(F.col("_item"), F.col("no"))

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, n, total, no, entry, first, factor in zip(pdf["path"], pdf["n"], pdf["n_pieces"], pdf["no"], pdf["entry"], pdf["piece_no"], pdf["factor"]):
                end = min(n, (no + 1) * range_bytes)
                s = _file_stretch(path, n, no * range_bytes, end, unit, most, overlap, factor)
                rows = [(path, first + i, total, a, b, t.encode("utf-8", "surrogateescape").decode("utf-8", "replace")) for i, (a, b, t) in enumerate(_emitted(s, entry, _aligned(s, end)))]
                yield pd.DataFrame(rows, columns=["path", "piece_no", "n_pieces", "start", "end", "content"])

    return entered.mapInPandas(emit, "path string, piece_no int, n_pieces int, start long, end long, content string")
