"""Token counts under a unigram model, by dynamic programming on a trie.

A text is cut at U+0020; every part, led by the word mark, is a pre-token. The
distinct new pre-tokens of a batch are put into a trie, and for every node the
best score of its prefix (the largest sum of piece log-probabilities, and the
number of pieces that reach it) is computed once, from the nodes above it. A
pre-token's count stands at its last node; a text's count is the sum over its
pre-tokens. Workers remember the counts of frequent pre-tokens.

The pieces are those of a public vocabulary, in its order of rank; the
log-probability of rank r is Zipf's, ``-ln(r + 2.7)`` less a constant. A
character outside the vocabulary is spelled in bytes, one piece each. Of equal
scores the one with fewer pieces counts.

Defined cases: a null or empty text has no token; a pre-token longer than
``LONG`` characters is computed by itself in the same way, without trie nodes;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.llm.common import in_small_batches
from tripcast.llm.tokens import SEGMENT, Remembered

MARK = "▁"
OFFSET = 2.7
LONG = 256
BATCH = 20_000   # pre-tokens of one trie


class Unigram:
    """Log-probabilities of pieces, from (piece) in order of rank."""

    def __init__(self, pieces: list[str]):
        weight = 1 / (np.arange(len(pieces)) + OFFSET)
        logs = np.log(weight / weight.sum())
        # ends of pieces that are no pieces themselves have no score; what is not here ends no piece
        self.score: dict[str, float | None] = {p[k:]: None for p in pieces for k in range(1, len(p))}
        self.score.update(zip(pieces, logs.tolist()))
        self.longest = max(map(len, pieces), default=1)
        self.byte_score = float(logs.min()) if len(logs) else -1.0

    def step(self, word: str, end: int, scores: list, counts: list) -> tuple[float, int]:
        """The best (score, pieces) of word[:end], given those of all shorter prefixes."""
        spelled = len(word[end - 1].encode("utf-8", "surrogatepass"))
        best, pieces = scores[end - 1] + spelled * self.byte_score, counts[end - 1] + spelled
        get = self.score.get
        for start in range(end - 1, max(0, end - self.longest) - 1, -1):
            s = get(word[start:end], 0)
            if s == 0:
                break
            if s is not None:
                s += scores[start]
                if s > best or (s == best and counts[start] + 1 < pieces):
                    best, pieces = s, counts[start] + 1
        return best, pieces


class Trie:
    """Prefixes of pre-tokens; each node holds its prefix's best score and number of pieces."""

    def __init__(self, model: Unigram):
        self.model = model
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.pieces = [0.0], [0]

    def count(self, word: str) -> int:
        """Puts a word in and returns the number of pieces at its last node."""
        scores, counts, node = [0.0], [0], 0
        for end, c in enumerate(word, 1):
            below = self.child.get((node, c))
            if below is None:
                below = self.child[node, c] = len(self.score)
                s, n = self.model.step(word, end, scores, counts)
                self.score.append(s)
                self.pieces.append(n)
            node = below
            scores.append(self.score[node])
            counts.append(self.pieces[node])
        return counts[-1]


def count_alone(word: str, model: Unigram) -> int:
    scores, counts = [0.0], [0]
    for end in range(1, len(word) + 1):
        s, n = model.step(word, end, scores, counts)
        scores.append(s)
        counts.append(n)
    return counts[-1]


class TextCounts:
    def __init__(self, model: Unigram):
        self.model = model
        self.known = Remembered(self._new)

    def _new(self, words: list[str]):
        counts = []
        for lo in range(0, len(words), BATCH):  # the words come sorted, so neighbours share prefixes
            trie = Trie(self.model)
            counts += [trie.count(w) if len(w) <= LONG else count_alone(w, self.model) for w in words[lo:lo + BATCH]]
        return np.array(counts, np.uint32), np.ones(len(counts), np.int64)

    def _words(self, words: list[str]) -> np.ndarray:
        return self.known.lookup(words)[0].astype(np.int64)

    def of(self, texts: list) -> list[int]:
        out, words, cuts, size = [], [], [0], 0

        def flush():
            sums = np.concatenate(([0], np.cumsum(self._words(words))))
            out.extend(np.diff(sums[cuts]).tolist())

        for t in texts:
            if t and len(t) > 4 * SEGMENT:  # very long texts by themselves, in parts
                flush()
                words, cuts, size = [], [0], 0
                total, lo = 0, 0
                while lo < len(t):
                    hi = t.find(" ", lo + SEGMENT)
                    hi = len(t) + 1 if hi < 0 else hi + 1
                    total += int(self._words([MARK + w for w in t[lo:hi - 1].split(" ")]).sum())
                    lo = hi
                if t.endswith(" ") and lo == len(t):
                    total += int(self._words([MARK]).sum())
                out.append(total)
                continue
            if t:
                words += [MARK + w for w in t.split(" ")]
                size += len(t)
            cuts.append(len(words))
            if size > SEGMENT:
                flush()
                words, cuts, size = [], [0], 0
        flush()
        return out


def pieces_of(model_file: str) -> list[str]:
    """The ordinary pieces of a sentencepiece vocabulary file in order of rank."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    special = lambda i: sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not special(i)]


_COUNTERS: dict = {}  # a worker keeps what it remembers between tasks


def _counter(pieces: list[str]) -> TextCounts:
    key = hash(tuple(pieces))
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = TextCounts(Unigram(pieces))
    return _COUNTERS[key]


def token_counts(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and n_pre_tokens of every whole text. The vocabulary
    (under 1 MB) is read here and sent to the workers once."""
    sent = df.sparkSession.sparkContext.broadcast(pieces_of(model_file))
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        counter = _counter(sent.value)
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counter.of(t.as_py() for t in texts), pa.int64()),
                 pa.array([t.count(" ") + 1 if (t := x.as_py()) else 0 for x in texts], pa.int64())],
                names=["doc_id", "n_tokens", "n_pre_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_small_batches(rows).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_pre_tokens long")
