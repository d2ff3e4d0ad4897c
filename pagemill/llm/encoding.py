"""Token ids of every text by a public byte-level BPE, long texts by tree concatenation.

A text of more than leaf_chars code points is cut into leaves, wherever they end, which are encoded apart. Neighbours are
then joined, FAN at a time, until one encoding is left. A join encodes a window around the place again. Its start holds
if it is a pre-token's, or, inside a run that no pre-token boundary splits, if the window's first token is the left
side's own. The window grows to the right until both sides agree: on a pre-token boundary, from which on both read the
same text from the same state, or, inside an unsplit run, on a token. A sequence of tokens of one run is the run's
encoding exactly if each two neighbours are the encoding of their text, and each two neighbours of the joined sequence
stand beside each other in one of the three encodings. So the result is that of the whole text, whatever its length.

Where sides never agree (runs of one letter at odd phases), the window slides on over the right side; no window ever holds
more than LIMIT tokens.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import materialised, spread

#: Texts of one call of the tokenizer hold at most so many code points, to bound a worker's memory.
BATCH_CHARS = 2_000_000
FAN = 8
LIMIT = 1 << 16
#: Bytes at the end of a stretch in which a pre-token may still depend on what follows (four code points).
LOOSE = 16
#: The split of the tokenizer's pre-tokenizer (a fixed value of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's file (the directory can be given by PAGEMILL_TOKENIZERS)."""
    if directory := os.environ.get("PAGEMILL_TOKENIZERS"):
        return os.path.join(directory, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def read_vocabulary(path: str | None = None) -> tuple[str, bytes | None]:
    """The tokenizer's file and, if it lies beside it, the same vocabulary as ranks; read where the query is built."""
    path = path or tokenizer_path()
    ranks = path.removesuffix(".json") + ".tiktoken"
    with open(path, encoding="utf-8") as f:
        own = f.read()
    if not os.path.exists(ranks):
        return own, None
    with open(ranks, "rb") as f:
        return own, f.read()


def _byte_of_sign() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable Latin ones themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodings as arrays of codes: twice the token's id, plus one where a pre-token begins."""

    def __init__(self, vocabulary: str, ranks: bytes | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = True
        sign = _byte_of_sign()
        self.bytes = [b""] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = bytes(sign[c] for c in token) if all(c in sign for c in token) else token.encode()
        self.length = np.array([len(b) for b in self.bytes], dtype=np.int64)
        #: Tokens that may begin a window: they begin with a code point, and not with an apostrophe.
        self.opens = np.array([bool(b) and b[0] & 0xC0 != 0x80 and b[0] != 39 for b in self.bytes])
        self.fast = None
        if ranks is not None:
            import tiktoken

            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})

    def ids(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; an empty list for None and ''."""
        if self.fast is not None:
            return [self.fast.encode_ordinary(x) if x else [] for x in texts]
        out: list[list[int]] = []
        batch: list[str] = []
        size = 0
        for x in [*texts, None]:
            if batch and (size + len(x or "") > BATCH_CHARS or len(out) + len(batch) == len(texts)):
                out += [e.ids for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
                batch, size = [], 0
            batch.append(x or "")
            size += len(x or "")
        return out

    def codes(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        e = self.tokenizer.encode(text, add_special_tokens=False)
        words = np.array(e.word_ids, dtype=np.int64)
        return (np.array(e.ids, dtype=np.int32) << 1) | (np.diff(words, prepend=-1) != 0).astype(np.int32)

    def text(self, codes: np.ndarray) -> str:
        return b"".join([self.bytes[i] for i in (codes >> 1).tolist()]).decode("utf-8")

    def _left(self, left: np.ndarray, back: int, whole: bool) -> tuple[int, bool]:
        """Where a window begins in left, about back tokens from its end, and whether that holds without a look."""
        tail = left[-back:] if back < len(left) else left
        behind = np.cumsum(self.length[tail >> 1][::-1])[::-1]
        sure = np.flatnonzero((tail & 1 == 1) & (behind >= LOOSE))
        if len(sure):
            return len(left) - len(tail) + int(sure[-1]), True
        if len(tail) == len(left):
            return 0, whole
        at = len(left) - len(tail)
        while at and not self.opens[left[at] >> 1]:
            at -= 1
        return at, at == 0 and whole

    def _right(self, window: np.ndarray, right: np.ndarray, cut: int) -> tuple[int, int] | None:
        """Indices of the first agreement of window (whose right part begins at byte cut) and right."""
        w = np.concatenate([[0], np.cumsum(self.length[window >> 1])])
        end, w = int(w[-1]), w[:-1]
        r = cut + np.concatenate([[0], np.cumsum(self.length[right >> 1])])[:-1]
        wf, rf = w[(window & 1 == 1) & (w <= end - LOOSE)], r[right & 1 == 1]
        both = np.intersect1d(wf[wf >= cut], rf, assume_unique=True)
        if len(both):
            return int(np.searchsorted(w, both[0])), int(np.searchsorted(r, both[0]))
        # one run on both sides from here on
        low = max(int(wf[-1]) if len(wf) else 0, int(rf[-1]) if len(rf) else cut, cut)
        places, i, j = np.intersect1d(w, r, assume_unique=True, return_indices=True)
        same = (window[i] >> 1 == right[j] >> 1) & (places >= low) & (places <= end - 4 * LOOSE)
        if same.any():
            k = int(np.flatnonzero(same)[0])
            return int(i[k]), int(j[k])
        return None

    def concat(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Codes of left's text followed by right's."""
        head: list[np.ndarray] = []  # of left, what no window reaches any more
        back, ahead = 16, 32
        while len(right):
            at, sure = self._left(left, back, not head)
            if head and not at and not sure:
                left = np.concatenate([head.pop(), left])
                continue
            b = min(len(right), ahead)
            while b < len(right) and not self.opens[right[b] >> 1]:
                b += 1
            window = self.codes(self.text(left[at:]) + self.text(right[:b])) if len(left) else right[:b].copy()
            cut = int(self.length[left[at:] >> 1].sum())
            if not sure:
                starts = np.concatenate([[0], np.cumsum(self.length[window >> 1])])[:-1]
                if window[0] >> 1 != left[at] >> 1 or ((window & 1 == 1) & (starts > 0) & (starts < cut - LOOSE)).any():
                    back *= 4
                    continue
                window[0] = left[at]
            if b < len(right):
                if got := self._right(window, right[:b], cut):
                    i, j = got
                    return np.concatenate([*head, left[:at], window[: i + 1], right[j + 1 :]])
                if b < LIMIT // 2:
                    ahead *= 4
                    continue
            left, right = np.concatenate([left[:at], window]), right[b:]
            if len(left) > 4 * LIMIT:
                head.append(left[: -2 * LIMIT])
                left = left[-2 * LIMIT :]
            back = 16
        return np.concatenate([*head, left])

    def tree(self, parts: list[np.ndarray]) -> np.ndarray:
        """All parts in order as one, halves first."""
        if len(parts) < 2:
            return parts[0] if parts else np.zeros(0, np.int32)
        half = len(parts) // 2
        return self.concat(self.tree(parts[:half]), self.tree(parts[half:]))


_CODECS: dict[int, Codec] = {}


def _codec(sent) -> Codec:
    """The worker's codec of a broadcast vocabulary, made once."""
    if sent.id not in _CODECS:
        _CODECS.clear()
        _CODECS[sent.id] = Codec(*sent.value)
    return _CODECS[sent.id]


class _Sent:
    """A broadcast vocabulary (some 2 MB, the file's size) with a key for the workers."""

    def __init__(self, spark, vocabulary: tuple[str, bytes | None]) -> None:
        self.id, self.broadcast = hash(vocabulary), spark.sparkContext.broadcast(vocabulary)

    @property
    def value(self):
        return self.broadcast.value


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, leaf_chars: int = 100_000) -> DataFrame:
    """key, ids (array<int>): one row for each row of df; an empty list for a null and an empty text.

    Texts of at most leaf_chars code points take a narrow map without a shuffle. Leaves of longer ones are encoded by all
    workers; each round of joins shuffles the encodings of FAN neighbours, and nothing else. Rows of equal or null keys
    are kept apart; other columns of df don't matter.
    """
    sent = _Sent(df.sparkSession, read_vocabulary(path))
    kind = df.schema[key].dataType.simpleString()
    base = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    is_long = F.coalesce(F.length("_text") > leaf_chars, F.lit(False))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codec.ids(b.column(1).to_pylist()), pa.list_(pa.int32()))], names=["_key", "ids"])

    done = spread(base.where(~is_long)).mapInArrow(short, f"_key {kind}, ids array<int>")
    n = F.ceil(F.length("_text") / F.lit(leaf_chars)).cast("int")
    leaves = base.where(is_long).withColumn("_row", F.monotonically_increasing_id()).select("_key", "_row", "_text", F.explode(F.sequence(F.lit(0), n - 1)).alias("_no"))
    leaves = leaves.select("_key", "_row", "_no", F.expr(f"substring(_text, _no * {leaf_chars} + 1, {leaf_chars})").alias("_leaf")).repartition(F.col("_row"), F.col("_no"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent)
        for b in batches:
            codes = [codec.codes(x) for x in b.column("_leaf").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("_key", "_row", "_no")), pa.array(codes, pa.list_(pa.int32()))], names=["_key", "_row", "_no", "codes"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_no")
        codes = _codec(sent).tree([np.asarray(x, dtype=np.int32) for x in pdf["codes"]])
        return pd.DataFrame({"_key": [pdf["_key"].iloc[0]], "_row": [pdf["_row"].iloc[0]], "_no": [pdf["_no"].iloc[0] // FAN], "codes": [codes]})

    columns = f"_key {kind}, _row long, _no int, codes array<int>"
    parts = materialised(leaves.mapInArrow(encode, columns))
    most = parts.agg(F.max("_no")).first()[0]
    if most is None:
        return done.withColumnRenamed("_key", key)
    while True:
        parts = parts.groupBy("_row", F.expr(f"_no div {FAN}").alias("_group")).applyInPandas(join, columns)
        most //= FAN
        if not most:
            break
    return done.unionByName(parts.select("_key", F.transform("codes", lambda x: F.shiftright(x, 1)).alias("ids"))).withColumnRenamed("_key", key)
