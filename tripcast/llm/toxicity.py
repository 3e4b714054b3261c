"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct words (letter runs) of a lower-cased text and the stems
they begin with, hashed to ``CELLS`` cells; a stem covers forms never seen.
Spark counts how many of the texts learnt from hold a cell, by label; cells
whose share differs beyond chance (``LEAST_Z``) become the machine's inputs,
weighted by their smoothed log ratio, so the rest of a long text adds nothing.
The machine (Spark ML) is fitted on them: a weight each, and a vector each
whose inner products weigh pairs, such as an insult together with a group, that
no sum of single weights expresses.

The machine learns from all labelled rows up to about ``SAMPLE`` of each label,
chosen by a hash of the id beyond that (the intercept makes up for different
rates); only their ids are broadcast. The model is bounded by ``MOST_INPUTS``
cells. Every text is scored whole.

Defined cases: null text counts as empty; an empty text scores what the
intercept says; labels other than 0 and 1, or null, and null
ids are not learnt from; an id with both labels is learnt from as both; without rows of both labels every text
scores the share of positives (0 without any); an empty table gives an empty
result. Input columns named like the added ones are replaced.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tripcast.llm.common import in_small_batches, with_fields
from tripcast.session import written

CELLS = 1 << 20
SAMPLE = 20_000       # rows of each label that the machine is fitted on
LEAST_Z = 6.0         # standard errors between the shares of a cell in the two labels
LEAST_TEXTS = 3       # texts that hold a cell, for it to be an input
MOST_INPUTS = 8192    # those furthest from chance
FACTORS = 8
ROUNDS, STEP, PENALTY = 100, 0.05, 1e-2
THRESHOLD = 0.3
STEMS = (3, 4, 5, 6, 7)   # letters
BATCH_TEXTS = 64
ADDED = ["score", "predicted"]

_LETTERS = re.compile(r"[^\W\d_]+")


def cells_of(text: str | None) -> np.ndarray:
    """The distinct cells of a text's terms, in rising order."""
    terms = set(_LETTERS.findall((text or "").lower()))
    terms |= {w[:k] + "-" for k in STEMS for w in terms if len(w) > k}
    return np.unique(np.fromiter((zlib.crc32(t.encode()) % CELLS for t in terms), np.int32, len(terms)))


def _cell_batches(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, BATCH_TEXTS):
            part = batch.slice(lo, BATCH_TEXTS)
            cells = [cells_of(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), pa.array(cells, pa.list_(pa.int32()))], names=["label", "cells"])


def inputs(rows: DataFrame, n: dict) -> tuple[np.ndarray, np.ndarray]:
    """The machine's cells and their weights, from rows (label, cells)."""
    held = rows.select("label", F.explode("cells").alias("cell")).groupBy("cell").agg(
        F.sum("label").alias("pos"), F.count(F.lit(1)).alias("both")).where(F.col("both") >= LEAST_TEXTS)
    pos, neg = F.col("pos"), F.col("both") - F.col("pos")
    share = F.col("both") / (n[0] + n[1])
    z = (pos / n[1] - neg / n[0]) / F.sqrt(share * (1 - share + 1e-9) * (1 / n[0] + 1 / n[1]))
    ratio = F.log((pos + 0.5) / (n[1] + 1) / ((neg + 0.5) / (n[0] + 1)))
    best = (held.select("cell", z.alias("z"), ratio.alias("ratio")).where(F.abs("z") >= LEAST_Z)
            .orderBy(F.abs("z").desc(), "cell").limit(MOST_INPUTS).collect())  # the model's size
    return np.array([r["cell"] for r in best], np.int64), np.array([r["ratio"] for r in best])


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic",
        id_col: str = "doc_id", sample: int = SAMPLE, seed: int = 12) -> dict:
    """The machine, from the texts of the rows of ``labels`` (id, 0 or 1)."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        id_col, F.col(label_col).cast("long").alias("label")).distinct()
    known = written(known, "toxic-labels")
    there = {0: 0, 1: 0} | {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = {label: min(1.0, sample / max(n, 1)) for label, n in there.items()}
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    taken = known.where(chance < F.when(F.col("label") == 1, share[1]).otherwise(share[0]))
    rows = (in_small_batches(docs.select(id_col, F.col(text_col).alias("text")))
            .join(F.broadcast(taken), id_col).select("label", "text"))  # about 2 * sample ids
    rows = written(rows.mapInArrow(_cell_batches, "label long, cells array<int>"), "toxic-cells")
    n = {0: 0, 1: 0} | {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    cells, weights = inputs(rows, n) if n[0] and n[1] else (np.zeros(0, np.int64), np.zeros(0))
    if not len(cells):
        return constant(there[1] / max(there[0] + there[1], 1))

    taken = rows.select("label", F.col("cells").cast("array<string>").alias("cells"))
    pipeline = Pipeline(stages=[
        CountVectorizerModel.from_vocabulary([str(c) for c in cells], "cells", "held", binary=True),
        ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="held", outputCol="features")])
    vectors = written(pipeline.fit(taken).transform(taken).select("label", "features"), "toxic-vectors")
    machine = FMClassifier(labelCol="label", factorSize=FACTORS, maxIter=ROUNDS, stepSize=STEP,
                           regParam=PENALTY, initStd=0.01, seed=seed).fit(vectors)
    # labels taken at different rates shift the odds by the ratio of the rates
    intercept = float(machine.intercept - np.log(share[1] / share[0]))
    return {"cells": cells, "weights": weights, "intercept": intercept,
            "linear": machine.linear.toArray(), "factors": machine.factors.toArray()}


def constant(share: float) -> dict:
    """A machine without inputs, which scores ``share``."""
    odds = np.log(share / (1 - share)) if 0 < share < 1 else (40.0 if share else -40.0)
    return {"cells": np.zeros(0, np.int64), "weights": np.zeros(0), "intercept": float(odds),
            "linear": np.zeros(0), "factors": np.zeros((0, FACTORS))}


def score_texts(texts: list, model: dict, order: np.ndarray) -> list[float]:
    """Scores of a list of texts; ``order`` sorts the model's cells."""
    known, out = model["cells"][order], []
    for text in texts:
        mine = cells_of(text)
        at = np.searchsorted(known, mine)
        some = at < len(known)
        some[some] = known[at[some]] == mine[some]
        i = order[at[some]]
        x = model["weights"][i]
        v = model["factors"][i] * x[:, None]
        pairs = (v.sum(axis=0) ** 2 - (v ** 2).sum(axis=0)).sum() / 2
        odds = model["intercept"] + x @ model["linear"][i] + pairs
        out.append(float(1 / (1 + np.exp(-np.clip(odds, -40, 40)))))
    return out


def score(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` plus score and predicted."""
    df = df.drop(*ADDED)
    names = df.schema.names
    sent = df.sparkSession.sparkContext.broadcast(model)  # at most MOST_INPUTS cells

    def run(batches):
        order = np.argsort(sent.value["cells"], kind="stable")
        for batch in batches:
            text = batch.column(names.index(text_col))
            scores = [s for lo in range(0, batch.num_rows, BATCH_TEXTS)
                      for s in score_texts(text.slice(lo, BATCH_TEXTS).to_pylist(), sent.value, order)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*names, "score"])

    scored = in_small_batches(df).mapInArrow(run, with_fields(df.schema, score=DoubleType()))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
