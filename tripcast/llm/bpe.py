"""Byte-level BPE encoding and decoding on padded matrices.

Each batch's distinct pre-tokens are rows of uint32 matrices, one for each
length class, padded at the end. In every round every row merges its leftmost
pair of least rank, found in a hashed pair table; rows without a pair to merge
leave the matrix. A pre-token that is itself in the vocabulary takes its id at
once, as tiktoken does. Pieces beyond ``LONG`` bytes, for which a round a merge
would grow with the square of the length, are merged with a heap under the same
rule.

Texts are encoded whole; a null text counts as empty and has no ids. An empty
table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.llm.common import in_small_batches
from tripcast.llm.tokens import BLANKS, WITH_SPACE, Remembered, TextIds, spread

WIDTHS = [2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 64, 128, 256]
LONG = WIDTHS[-1]
ROWS = 1 << 14       # rows of a matrix
_NONE = np.uint32(0xFFFFFFFF)
_MULT = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Ranks of byte strings, and a hashed table of the pairs that merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.uint32)
        pairs, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    merged.append(rank)
        bits = max(8, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << bits, _NONE, np.uint32)
        pairs, merged = np.array(pairs, np.uint64), np.array(merged, np.uint32)
        slot = (pairs * _MULT >> self.shift).astype(np.int64)
        while len(pairs):  # each free slot takes the first pair that asks for it; the others go on to the next
            free = self.keys[slot] == np.iinfo(np.uint64).max
            s, first = np.unique(slot[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.keys[s], self.values[s] = pairs[took], merged[took]
            left = np.ones(len(pairs), bool)
            left[took] = False
            pairs, merged, slot = pairs[left], merged[left], (slot[left] + 1) & self.mask

    @classmethod
    def from_ranks(cls, data: bytes) -> "Vocabulary":
        """From the lines ``base64 rank`` of a rank file."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a})

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, _NONE where there is none."""
        shape, pair = a.shape, (a.astype(np.uint64) << np.uint64(32) | b).ravel()
        slot = (pair * _MULT >> self.shift).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == pair, self.values[slot], _NONE)
        open_ = np.flatnonzero((key != pair) & (key != np.iinfo(np.uint64).max))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            key = self.keys[slot[open_]]
            out[open_] = np.where(key == pair[open_], self.values[slot[open_]], _NONE)
            open_ = open_[(key != pair[open_]) & (key != np.iinfo(np.uint64).max)]
        return out.reshape(shape)


def _merge_matrix(ids: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The merged ids of every row of a matrix padded with _NONE, and their number."""
    out, size = np.full_like(ids, _NONE), np.zeros(len(ids), np.int64)
    row = np.arange(len(ids))
    rank = vocab.merge(ids[:, :-1], ids[:, 1:])
    while len(row):
        n, width = ids.shape
        i = np.arange(n)
        if width > 1:
            best = rank.argmin(axis=1)  # the leftmost of the least
            least = rank[i, best]
        else:
            best, least = np.zeros(n, np.int64), np.full(n, _NONE)
        done = least == _NONE
        if done.any():
            out[row[done], :width] = ids[done]
            size[row[done]] = (ids[done] != _NONE).sum(axis=1)
            go = ~done
            row, ids, rank, best, least = row[go], ids[go], rank[go], best[go], least[go]
            n = len(row)
            if not n:
                break
            i = np.arange(n)
        keep = np.ones((n, width), bool)
        keep[i, best + 1] = False
        ids[i, best] = least
        ids = ids[keep].reshape(n, width - 1)
        keep = np.ones((n, width - 1), bool)
        keep[i, best] = False
        rank = rank[keep].reshape(n, width - 2)
        for at in (best - 1, best):  # only the merged id's neighbours are new
            ok = np.flatnonzero((at >= 0) & (at < width - 2))
            rank[ok, at[ok]] = vocab.merge(ids[ok, at[ok]], ids[ok, at[ok] + 1])
    return out, size


def _merge_long(piece: bytes, vocab: Vocabulary) -> np.ndarray:
    """One long piece: the same rule, with a heap of (rank, place)."""
    ids = vocab.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
    after, before, ranks, tokens = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), vocab.ranks, vocab.bytes
    heap = []

    def offer(i):
        j = after[i]
        if j < len(ids) and (r := ranks.get(tokens[ids[i]] + tokens[ids[j]])) is not None:
            heapq.heappush(heap, (r, i, ids[i], ids[j]))

    for i in range(len(ids) - 1):
        offer(i)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        if ids[i] != a or after[i] >= len(ids) or ids[after[i]] != b:
            continue  # one of the two has been merged since
        j = after[i]
        ids[i], ids[j], after[i] = r, None, after[j]
        if after[i] < len(ids):
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return np.array([x for x in ids if x is not None], np.uint32)


def encode_pieces(pieces: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all pre-tokens in a row, and the number of ids of each."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    whole = np.fromiter((vocab.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
    size = np.ones(len(pieces), np.int64)
    parts = [(np.flatnonzero(whole >= 0), whole[whole >= 0].astype(np.uint32))]
    for i in np.flatnonzero((whole < 0) & (lengths > LONG)).tolist():
        ids = _merge_long(pieces[i], vocab)
        size[i] = len(ids)
        parts.append((np.array([i]), ids))
    kind = np.searchsorted(WIDTHS, lengths)
    kind[(whole >= 0) | (lengths > LONG)] = -1
    for k, width in enumerate(WIDTHS):
        own = np.flatnonzero(kind == k)
        for lo in range(0, len(own), ROWS):
            rows = own[lo:lo + ROWS]
            ids = np.full((len(rows), width), _NONE, np.uint32)
            data = np.frombuffer(b"".join([pieces[i] for i in rows.tolist()]), np.uint8)
            ids[np.arange(width) < lengths[rows][:, None]] = vocab.byte_ids[data]
            merged, size[rows] = _merge_matrix(ids, vocab)
            parts.append((rows, merged[merged != _NONE]))
    order = np.concatenate([r for r, _ in parts])      # pieces in the order their ids were made
    flat = np.concatenate([x for _, x in parts])
    made = np.cumsum(size[order]) - size[order]
    start = np.empty(len(pieces), np.int64)
    start[order] = made
    return spread(flat, start, size), size


class Encoder:
    """Ids of texts: chunks, pre-tokens by the pattern, merges by the ranks."""

    def __init__(self, vocab: Vocabulary, pattern: str):
        self.vocab, self.split = vocab, regex.compile(pattern).findall
        self.pieces = Remembered(lambda new: encode_pieces(
            [p.encode("utf-8", "surrogatepass") for p in new], vocab))
        self.texts = TextIds(WITH_SPACE, self._encode)

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that begin with white space and do not end with it can be
        split in one string; the few others are split one by one."""
        count = np.zeros(len(chunks), np.int64)
        plain = [i for i, c in enumerate(chunks) if c[0] in BLANKS and c[-1] not in BLANKS]
        pieces = self.split("".join([chunks[i] for i in plain]))
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        stops = np.cumsum([len(chunks[i]) for i in plain])
        count[plain] = np.diff(np.searchsorted(ends, stops, side="right"), prepend=0)
        odd = sorted(set(range(len(chunks))).difference(plain))
        for i in odd:
            own = self.split(chunks[i])
            count[i] = len(own)
            pieces += own
        ids, length = self.pieces.lookup(pieces)
        order = np.array(plain + odd, np.int64)        # chunks in the order of their pieces
        ends = np.concatenate(([0], np.cumsum(length)))
        stops = np.cumsum(count[order])
        size = ends[stops] - ends[stops - count[order]]
        start, total = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        start[order], total[order] = ends[stops - count[order]], size
        return spread(ids, start, total), total

    def ids(self, texts: list):
        return self.texts.ids(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocab.bytes.__getitem__, ids.tolist()))


_ENCODERS: dict = {}  # a worker keeps its encoder, and what it remembers, between tasks


def _encoder(data: bytes, pattern: str) -> Encoder:
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary.from_ranks(data), pattern)
    return _ENCODERS[key]


def encode_digests(df: DataFrame, ranks_path: str, pattern: str,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the digests of each text's ids and of their
    decoded bytes; with_ids adds the ids. The rank file (about 1 MB) is read
    here and sent to the workers once."""
    with open(ranks_path, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        encoder = _encoder(sent.value, pattern)
        for batch in batches:
            n, sha, back, all_ids = [], [], [], []
            for ids in encoder.ids(t.as_py() for t in batch.column(1)):
                n.append(len(ids))
                sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string()),
                 *([pa.array(all_ids, pa.list_(pa.int64()))] if with_ids else [])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_small_batches(rows).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
                           + (", ids array<long>" if with_ids else ""))
