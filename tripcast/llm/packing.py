"""Packing of documents into sequences of a fixed window by non-negative least squares.

A document's ids, with a closing id, are cut into whole windows and a rest.
Whole windows are sequences of their own. The rests are counted by length (a
histogram of at most ``WINDOW - 1`` bins, whatever the input's size). Shallow
combinations of two to four lengths that fill a window exactly are enumerated;
non-negative least squares finds how often each is to be used so that together
they match the histogram; the counts are rounded down to what is there, and the
lengths left over are packed greedily, longest first with the longest that
still fits. The outcome is a list of combinations with repeat counts, and a
rest's rank among those of its length says which sequence and place it takes.

Only the histogram and the combinations are on the driver, both bounded by the
window. Ranks are made in parts: a length that a third of all rows share is
dealt over many parts, each ranked alone and shifted by the parts before it.

Defined cases: a null or empty text is the closing id alone; an empty table
gives an empty result; rows that repeat a doc_id are packed each for itself;
a null doc_id is kept as it is.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripcast.llm.common import in_small_batches
from tripcast.llm.tokens import WITHOUT_SPACE, Remembered, TextIds, spread
from tripcast.session import written

WINDOW = 2048
CLOSING_ID = 1
ROUNDS = 400          # of the least-squares descent
PART_ROWS = 250       # rests of one length ranked together, on average
SHARES = (0.5, 0.25, 0.125, 0.0625, 0.4, 0.3)   # of what a length leaves free, for the further pieces


# -- token ids -------------------------------------------------------------

_WORD_IDS: dict = {}


class WordIds:
    """Ids by the ``tokenizers`` library, for a BPE with word ends whose
    normaliser lower-cases and whose pattern drops white space. Chunks within
    Latin-1 are split here and their pre-tokens handed to the library's model;
    all others, and those that hold one of the vocabulary's added tokens, go
    through the library as a whole. Added tokens hold no white space (checked)."""

    _PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+| ")

    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tokenizer = Tokenizer.from_str(data.decode())
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(WITHOUT_SPACE.fullmatch(t) is None for t in added):
            raise ValueError("added tokens with white space in them cross chunks")
        self.added = [t.lower() for t in added]
        letters = sorted(ByteLevel.alphabet())
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes shown as themselves
        others = (c for c in letters if ord(c) > 0xFF)
        self.shown = {b: chr(b) if b in plain else next(others) for b in range(256)}
        self.pieces = Remembered(self._model_ids)
        self.texts = TextIds(WITHOUT_SPACE, self._chunk_ids)

    def _model_ids(self, pieces):
        tokenize, shown = self.tokenizer.model.tokenize, self.shown
        ids, length = [], []
        for p in pieces:
            if p == " ":
                length.append(0)
                continue
            # printable ASCII is shown as itself
            found = tokenize(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(shown))
            length.append(len(found))
            ids += [t.id for t in found]
        return np.array(ids, np.uint32), np.array(length, np.int64)

    def _plain_ids(self, lower):
        """The ids of chunks within Latin-1, given in lower case and parted by blanks, which have no ids."""
        pieces = self._PATTERN.findall(lower)
        flat, length = self.pieces.lookup(pieces)
        blanks = np.flatnonzero(np.fromiter(map(" ".__eq__, pieces), bool, len(pieces)))
        ends = np.cumsum(length)
        return flat, np.diff(np.concatenate((ends[blanks], [len(flat)])), prepend=0)

    def _holds_added(self, lower: str) -> bool:
        return any(t in lower for t in self.added)

    def _chunk_ids(self, chunks):
        plain = np.array([c.isascii() or max(c) < "Ā" for c in chunks], bool)
        lower = " ".join(chunks).lower()
        if self._holds_added(lower):
            plain &= [not self._holds_added(c.lower()) for c in chunks]
        if plain.all():
            return self._plain_ids(lower)
        other = [c for c, p in zip(chunks, plain.tolist()) if not p]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        flat = np.array([x for i in ids for x in i], np.uint32)
        length = np.zeros(len(chunks), np.int64)
        length[~plain] = [len(i) for i in ids]
        if plain.any():
            plain_flat, length[plain] = self._plain_ids(" ".join([c for c, p in zip(chunks, plain.tolist()) if p]).lower())
            flat = np.concatenate((plain_flat, flat))
        start = np.empty(len(chunks), np.int64)  # the plain chunks' ids come first in flat
        order = np.argsort(~plain, kind="stable")
        start[order] = np.cumsum(length[order]) - length[order]
        return spread(flat, start, length), length


def _word_ids(data: bytes) -> WordIds:
    key = hash(data)
    if key not in _WORD_IDS:
        _WORD_IDS.clear()
        _WORD_IDS[key] = WordIds(data)
    return _WORD_IDS[key]


def pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           window: int = WINDOW) -> DataFrame:
    """A row for each piece of each document: doc_id, start, length, ids_crc32, doc_tokens."""
    with open(tokenizer_path, "rb") as f:  # a vocabulary file of a few MB
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        words = _word_ids(sent.value)
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for k, ids in enumerate(words.texts.ids(t.as_py() for t in batch.column(1))):
                data = memoryview(np.append(ids, np.uint32(CLOSING_ID)).astype("<u4").tobytes())
                n = len(ids) + 1
                for at in range(0, n, window):
                    row.append(k)
                    start.append(at)
                    length.append(min(window, n - at))
                    crc.append(zlib.crc32(data[4 * at:4 * (at + window)]))
                    total.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_small_batches(rows).mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


# -- combinations ----------------------------------------------------------

def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Distinct rows of two to four lengths (0: none) that fill the window
    exactly, built from the lengths that occur."""
    rows = []
    for a in lengths.tolist():
        free = window - a
        rows.append((a, free, 0, 0))
        for share in SHARES:
            b = int(free * share)
            rows.append((a, b, free - b, 0))
            c = (free - b) // 2
            rows.append((a, b, c, free - b - c))
    rows = -np.sort(-np.array(rows, np.int64).reshape(-1, 4), axis=1)
    there = np.zeros(window + 1, bool)
    there[lengths] = there[0] = True
    return np.unique(rows[there[rows].all(axis=1) & (rows[:, 1] > 0)], axis=0)


def solve_counts(combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that bring sum(x * combo) nearest to the histogram
    in the least-squares sense, by accelerated projected descent."""
    if not len(combos):
        return np.empty(0)
    row = np.repeat(np.arange(len(combos)), combos.shape[1])
    cell, used = combos.ravel(), combos.ravel() > 0
    row, cell = row[used], cell[used]
    use = lambda x: np.bincount(cell, x[row], len(histogram))
    back = lambda r: np.bincount(row, r[cell], len(combos))
    v = np.ones(len(combos))
    for _ in range(30):  # the largest eigenvalue, for the step
        v = back(use(v))
        size = np.linalg.norm(v)
        v /= size
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(ROUNDS):
        x_next = np.maximum(y - back(use(y) - histogram) / (1.01 * size), 0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = x_next + (t - 1) / t_next * (x_next - x)
        x, t = x_next, t_next
    return x


def plan(histogram: np.ndarray, window: int) -> list[tuple[list[int], int]]:
    """(lengths, repeats) of all sequences for a histogram by length."""
    left = histogram.astype(np.int64).copy()
    out = []

    def take(combo, most):
        need = np.bincount(combo)
        have = np.flatnonzero(need)
        n = int(min([most, *(left[have] // need[have])]))
        if n > 0:
            left[have] -= n * need[have]
            out.append((list(combo), n))
        return n

    combos = combinations(np.flatnonzero(left), window)
    wish = solve_counts(combos, left.astype(float))
    for k in np.argsort(-wish, kind="stable"):
        if wish[k] < 0.5:
            break
        take([int(c) for c in combos[k] if c], int(wish[k] + 0.5))
    while left.any():  # the residual, longest first; the same combination as often as it goes
        combo, free, stock = [], window, left.copy()
        while free and (fit := np.flatnonzero(stock[:free + 1])).size:
            combo.append(int(fit[-1]))
            stock[fit[-1]] -= 1
            free -= combo[-1]
        take(combo, int(left.max()))
    return out


def slots(sequences: list[tuple[list[int], int]], first_id: int) -> pd.DataFrame:
    """For each length the runs of ranks that go to one place of one
    combination: length, rank_from, sequence_from and offset."""
    used: dict[int, int] = {}
    rows = []
    for combo, n in sequences:
        offset = 0
        for length in combo:
            rows.append((length, used.get(length, 0), first_id, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        first_id += n
    return pd.DataFrame(rows, columns=["length", "rank_from", "sequence_from", "offset"], dtype="int64")


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    cut = pieces(df, tokenizer_path, id_col, text_col, window)
    # rows that repeat a piece are told apart by their place in the partition
    cut = written(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= window rows
    histogram = np.zeros(window, np.int64)
    for length, n in counts.items():
        if length < window:
            histogram[length] = n
    whole = counts.get(window, 0)
    # as many parts as a length's own rows ask for; a row a length, hence bounded by the window
    parts = df.sparkSession.createDataFrame([(k, -(-n // PART_ROWS)) for k, n in counts.items()], "length long, parts long")
    cut = cut.join(F.broadcast(parts), "length")
    part = F.pmod(F.xxhash64("doc_id", "row"), F.col("parts"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    dealt = written(cut.withColumn("part", part).withColumn(
        "rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("row")).cast("long") - 1), "ranked")
    shift = (dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
             .select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")))
    ranked = dealt.join(written(shift, "rank-shifts"), ["length", "part"])
    table = slots(plan(histogram, window), whole)
    runs = {k: g.sort_values("rank_from") for k, g in table.groupby("length")}
    sent = df.sparkSession.sparkContext.broadcast(runs)  # bounded by the window's combinations

    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.empty((len(length), 2), np.int64)
        size, at = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        for k in np.unique(size):
            own = size == k
            if k == window:
                out[own, 0], out[own, 1] = at[own], 0
                continue
            run = sent.value[k]
            i = np.searchsorted(run["rank_from"].to_numpy(), at[own], side="right") - 1
            out[own, 0] = run["sequence_from"].to_numpy()[i] + at[own] - run["rank_from"].to_numpy()[i]
            out[own, 1] = run["offset"].to_numpy()[i]
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    placed = F.pandas_udf(place, "sequence_id long, offset long")("length", F.col("rank") + F.col("shift"))
    return ranked.withColumn("place", placed).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "place.sequence_id", "place.offset")
