"""Language-model scoring by cross-entropy difference.

Two models of the same order share one vocabulary, the 256 bytes of UTF-8 text:
one is counted over the target documents, one over all documents. Both
interpolate three orders in the same way, and the background's counts are
scaled to the target's total, so that smoothing weighs the same in both
(matched). A document's score is its mean loss a token under the target model
less that under the background model: the lower, the more target-like.

Counts cover every byte of every document: each task adds up its own, the sums
are a partial aggregate by n-gram. A model has at most 2^24 n-grams by its
order, which bounds what is sent to the workers.

Defined cases: a null or empty text has 0 tokens and null losses; without any
target text both models are the background and every score is 0; repeated
target ids count once; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.llm.common import in_small_batches, rows_flagged
from tripcast.session import written

ORDER = 3
TASKS_PER_CORE = 4   # of the counting job
GRAMS = 1 << 8 * ORDER
SMOOTHING = 16.0     # weight of the shorter context, in tokens
BLOCK = 1 << 20      # bytes handled at a time
CELL_MOST = (1 << 32) - 1   # n-grams that a task counts before it gives its counts out
_START = b"\n\n"     # what stands before a text


def _grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of every byte of all texts in a row, and the texts' lengths in bytes."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(_START + _START.join(raw), np.uint8).astype(np.int32)
    ends = np.cumsum(size + len(_START))
    inside = np.ones(len(data), bool)
    for k in range(len(_START)):
        starts = np.concatenate(([0], ends[:-1]))
        inside[starts[starts + k < len(data)] + k] = False
    third = np.flatnonzero(inside)
    return data[third - 2] << 16 | data[third - 1] << 8 | data[third], size


def _blocks(column):
    """Lists of texts of about BLOCK bytes."""
    group, size = [], 0
    for t in column:
        t = t.as_py()
        group.append(t)
        size += len(t or "")
        if size > BLOCK:
            yield group
            group, size = [], 0
    yield group


def _emitted(total: np.ndarray, target: np.ndarray):
    keys = np.flatnonzero(total)
    for lo in range(0, len(keys), 1 << 16):
        k = keys[lo:lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in (
            (k, np.int32), (total[k], np.int64), (target[k], np.int64))], names=["gram", "background", "target"])


def _count(batches):
    # 32-bit cells, given out before any can be full
    total, target, seen = np.zeros(GRAMS, np.uint32), np.zeros(GRAMS, np.uint32), 0
    for batch in batches:
        at = 0
        for group in _blocks(batch.column(0)):
            chosen = batch.column(1).slice(at, len(group)).to_pylist()
            at += len(group)
            found = [(counted, _grams([t for t, c in zip(group, chosen) if c is of])[0])
                     for of, counted in ((True, (total, target)), (False, (total,)))]
            size = sum(len(grams) for _, grams in found)
            if seen + size > CELL_MOST:
                yield from _emitted(total, target)
                total[:], target[:], seen = 0, 0, 0
            seen += size
            for counted, grams in found:
                keys, n = np.unique(grams, return_counts=True)
                for x in counted:
                    x[keys] += n.astype(np.uint32)
    yield from _emitted(total, target)


def counts(texts: DataFrame) -> DataFrame:
    """gram, background and target counts, over (text, whether it is a target's).

    A task emits its distinct n-grams once (again after 2^32 of them), however
    many input partitions it reads, so it reads several in turn: most n-grams
    are common to all.
    """
    tasks = TASKS_PER_CORE * texts.sparkSession.sparkContext.defaultParallelism
    return in_small_batches(texts).coalesce(tasks).mapInArrow(_count, "gram int, background long, target long").groupBy("gram").agg(
        F.sum("background").alias("background"), F.sum("target").alias("target"))


def log_probabilities(grams: np.ndarray, n: np.ndarray) -> np.ndarray:
    """ln P(byte | two bytes before) of all n-grams, from counts."""
    if (grams[1:] < grams[:-1]).any():
        order = np.argsort(grams)
        grams, n = grams[order], n[order]
    edges = np.searchsorted(grams, np.arange(257) << 16)

    def counted(a):  # a slice of the table, by its first byte
        out = np.zeros(1 << 16)
        lo, hi = edges[a:a + 2]
        out[grams[lo:hi] & 0xFFFF] = n[lo:hi]
        return out.reshape(256, 256)

    bi, uni = np.zeros((256, 256)), np.zeros(256)
    for a in range(256):
        tri = counted(a)
        bi += tri
        uni = np.concatenate((uni[None], tri)).sum(axis=0)
    p = (uni + 1) / (uni.sum() + 256)
    p = (bi + SMOOTHING * p) / (bi.sum(axis=1, keepdims=True) + SMOOTHING)
    out = np.empty((256, 256, 256), np.float32)
    for a in range(256):  # one slice at a time, to hold one table only
        tri = counted(a)
        out[a] = np.log((tri + SMOOTHING * p) / (tri.sum(axis=1)[:, None] + SMOOTHING))
    return out.reshape(-1)


_TABLES: dict = {}  # a worker keeps its tables between tasks


def _tables(model: dict) -> tuple[np.ndarray, np.ndarray]:
    if model["key"] not in _TABLES:
        _TABLES.clear()
        scale = model["target"].sum() / max(model["background"].sum(), 1)
        background = log_probabilities(model["grams"], model["background"] * (scale or 1.0))
        target = log_probabilities(model["grams"], model["target"]) if scale else background
        _TABLES[model["key"]] = target, background
    return _TABLES[model["key"]]


def fit(texts: DataFrame) -> dict:
    """Both models' counts by n-gram, at most 2^24 of them, over (text, whether it is a target's)."""
    t = written(counts(texts), "ngram-counts").orderBy("gram").toArrow()
    model = {k: t.column(k).to_numpy() for k in ("background", "target")} | {"grams": t.column("gram").to_numpy()}
    model["key"] = hash((model["background"].tobytes(), model["target"].tobytes(), model["grams"].tobytes()))
    return model


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background and score of every whole text."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    rows = in_small_batches(df).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        target, background = _tables(sent.value)
        for batch in batches:
            size, loss_t, loss_b = [], [], []
            for group in _blocks(batch.column(1)):
                grams, n = _grams(group)
                ends = np.cumsum(n)
                for table, out in ((target, loss_t), (background, loss_b)):
                    sums = np.concatenate(([0.0], np.cumsum(table[grams], dtype=np.float64)))
                    out.append(-(sums[ends] - sums[ends - n]))
                size.append(n)
            n = np.concatenate(size)
            t, b = (np.concatenate(x) / np.maximum(n, 1) for x in (loss_t, loss_b))
            empty = n == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), *(pa.array(x, mask=empty) for x in (t, b, t - b))],
                names=["doc_id", "n_tokens", "loss_target", "loss_background", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, loss_target double, loss_background double, score double")


def score_documents(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of ``docs`` against the documents that ``target_ids`` (one id column) names."""
    known = rows_flagged(docs.select(id_col, text_col), target_ids.distinct(), id_col, "target")
    model = fit(known.select(text_col, "target"))
    return score(docs, model, id_col, text_col)
