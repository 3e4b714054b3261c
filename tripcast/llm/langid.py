"""Language identification by nearest centroid.

Every text becomes a vector of hashed character 1-, 2- and 3-grams, weighted
(1 + ln tf) * idf and normalised. Each language is described by several
centroids, found by spherical k-means over a bounded sample of its labelled
texts; a text takes the language of the centroid with the largest cosine.

Its distance (1 - cosine) is held against that of labelled texts of like length
which the centroids were not made from: one in ``HOLD_BACK`` of the sample is
held back, and a text is rejected below ``REJECT_BELOW`` times the cosine that
all but ``OUTLIERS`` of them reach. Length classes are powers of two; a class
with few texts held back takes in its neighbours. The cells are so many that
even a long text in another script meets few of a centroid's by chance.

The model is bounded: ``DIMS`` floats a centroid, ``CENTROIDS`` centroids a
language, fitted on about ``SAMPLE`` labelled texts a language. Prediction
reads every whole text and looks at nothing but the text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0
and rejected; so is every text when no labelled text was there to learn from.
Languages that tie go to the first in order. Repeated rows are predicted alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from tripcast.llm.common import in_small_batches, with_fields
from tripcast.session import written

DIMS = 1 << 15
CENTROIDS = 4
SAMPLE = 1000          # labelled texts a language, on average
KMEANS_ROUNDS = 12
HOLD_BACK = 4
OUTLIERS = 0.01        # of the texts held back, that may lie farther than the reference cosine
REJECT_BELOW = 1 / 3   # share of the reference cosine
LEAST_HELD = 30        # texts held back that a class's reference is taken from
CLASSES = 18           # of length: powers of two of n-grams
BLOCK_TEXTS = 64       # vectors made dense at a time, in the fit
_LETTER = None


def _letters() -> np.ndarray:
    """Which code points are letters; made once in each worker."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def ngram_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed 1- to 3-grams of a text's letters in lower case,
    everything else read as one blank; None without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, np.uint32(0))
    if not points.any():
        return None
    blank = points == 0
    points = points[~(blank & np.concatenate(([False], blank[:-1])))]
    points = np.concatenate((np.zeros(1, np.uint32), points, np.zeros(1, np.uint32)))
    a, b, c = points[:-2], points[1:-1], points[2:]
    one, two = b * np.uint32(0x9E3779B1), a * np.uint32(0x85EBCA6B)
    shift = np.uint32(32 - (DIMS.bit_length() - 1))
    mixed = [one, (one ^ two) * np.uint32(0xC2B2AE35),
             (one ^ two ^ (c * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)]
    return np.bincount(np.concatenate([m >> shift for m in mixed]), minlength=DIMS)


def _length_class(n: int) -> int:
    """The power of two at or below the number of n-grams of one order."""
    return min(max(n // 3, 1).bit_length() - 1, CLASSES - 1)


def unit_vector(cells: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The unit TF-IDF values of a text's cells."""
    v = ((1 + np.log(counts)) * idf[cells]).astype(np.float32)
    return v / max(float(np.linalg.norm(v)), 1e-12)


def _dense_blocks(vectors):
    """Blocks of (cells, values) vectors as dense rows."""
    for lo in range(0, len(vectors), BLOCK_TEXTS):
        part = vectors[lo:lo + BLOCK_TEXTS]
        m = np.zeros((len(part), DIMS), np.float32)
        for row, (c, v) in zip(m, part):
            row[c] = v
        yield m


def centroids(vectors: list) -> np.ndarray:
    """Spherical k-means: at most CENTROIDS unit rows."""
    centers = np.concatenate(list(_dense_blocks(
        [vectors[i] for i in np.linspace(0, len(vectors) - 1, min(CENTROIDS, len(vectors))).astype(int)])))
    for _ in range(KMEANS_ROUNDS):
        sums = np.zeros_like(centers)
        for block in _dense_blocks(vectors):
            nearest = (block @ centers.T).argmax(axis=1)
            for k in np.unique(nearest):
                sums[k] += block[nearest == k].sum(axis=0)
        used = sums.any(axis=1)
        centers[used] = sums[used] / np.maximum(np.linalg.norm(sums[used], axis=1, keepdims=True), 1e-12)
    return centers


def reject_limits(kinds: np.ndarray, cosines: np.ndarray) -> list[float]:
    """The cosine of each length class below which a text is rejected."""
    out = []
    for k in range(CLASSES):
        for reach in range(CLASSES):  # the class itself, then its neighbours too
            near = cosines[np.abs(kinds - k) <= reach]
            if len(near) >= LEAST_HELD:
                break
        out.append(REJECT_BELOW * float(np.quantile(near, OUTLIERS)) if len(near) else 0.0)
    return out


def _sketch_batches(batches):
    for batch in batches:
        rows = []
        for lang, chance, text in zip(batch.column("lang").to_pylist(), batch.column("chance").to_pylist(), batch.column("text")):
            if (n := ngram_counts(text.as_py())) is not None:
                cells = np.flatnonzero(n)
                rows.append((lang, chance, cells, n[cells]))
        lang, chance, cells, counts = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(chance, pa.float64()), pa.array(cells, pa.list_(pa.int32())),
             pa.array(counts, pa.list_(pa.int32()))], names=["lang", "chance", "cells", "counts"])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
        seed_col: str = "doc_id", sample: int = SAMPLE) -> dict:
    """The model, from rows whose language is known (null languages are left out)."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # one row a language
    if not sizes:
        return {"langs": []}
    share = F.create_map(*[x for g, n in sizes.items() for x in (F.lit(g), F.lit(min(1.0, sample / n)))])
    chance = F.pmod(F.xxhash64(F.col(seed_col), F.lit(17)), F.lit(1 << 20)) / float(1 << 20)
    vectors = written(
        in_small_batches(rows).where(chance < share[F.col(lang_col)])
        .select(F.col(lang_col).alias("lang"), chance.alias("chance"), F.col(text_col).alias("text"))
        .mapInArrow(_sketch_batches, "lang string, chance double, cells array<int>, counts array<int>"), "language-sample")
    seen = vectors.count()
    if not seen:
        return {"langs": []}
    df = vectors.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()  # at most DIMS rows
    idf = np.full(DIMS, np.log(1 + seen), np.float32)
    for r in df:
        idf[r["cell"]] = np.log((1 + seen) / (1 + r["count"])) + 0.05

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        """Centroids of one language's sample, and its limits by length class."""
        pdf = pdf.sort_values("chance", kind="stable")
        units = [unit_vector(np.asarray(c), np.asarray(n), idf) for c, n in zip(pdf["cells"], pdf["counts"])]
        rows = list(zip(pdf["cells"], units))
        held = np.arange(len(rows)) % HOLD_BACK == HOLD_BACK - 1
        centers = centroids([r for r, h in zip(rows, held) if not h])
        cosines = np.array([float((centers[:, c] @ v).max()) for (c, v), h in zip(rows, held) if h])
        kinds = np.array([_length_class(int(n.sum())) for n, h in zip(pdf["counts"], held) if h])
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centers": [[c.tolist() for c in centers]],
                             "floor": [reject_limits(kinds, cosines)]})

    fitted = vectors.groupBy("lang").applyInPandas(
        cluster, "lang string, centers array<array<float>>, floor array<double>").collect()  # bounded by the model's size
    fitted.sort(key=lambda r: r["lang"])
    return {"langs": [r["lang"] for r in fitted for _ in r["centers"]], "idf": idf,
            "by_cell": np.ascontiguousarray(np.array([c for r in fitted for c in r["centers"]], np.float32).T),
            "floor": np.array([r["floor"] for r in fitted for _ in r["centers"]])}


def predict_text(text: str | None, model: dict) -> tuple[str, float, bool]:
    """(language, score, rejected) of a text."""
    counts = ngram_counts(text) if text is not None and model["langs"] else None
    if counts is None:
        return "und", 0.0, True
    cells = np.flatnonzero(counts)
    cosine = unit_vector(cells, counts[cells], model["idf"]) @ model["by_cell"][cells]
    k = int(cosine.argmax())
    return (model["langs"][k], float(min(1.0, max(0.0, cosine[k]))),
            bool(cosine[k] <= model["floor"][k, _length_class(int(counts.sum()))]))


def predict(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` plus lang_pred, score and rejected."""
    added = ["lang_pred", "score", "rejected"]
    df = df.drop(*added)
    keep = df.schema.names
    sent = df.sparkSession.sparkContext.broadcast(model)  # the model's bounded size

    def run(batches):
        for batch in batches:
            text = batch.column(keep.index(text_col))
            found = [predict_text(t.as_py(), sent.value) for t in text]
            lang, score, rejected = ([f[k] for f in found] for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(rejected, pa.bool_())], names=[*keep, *added])

    return in_small_batches(df).mapInArrow(run, with_fields(df.schema, lang_pred=StringType(), score=DoubleType(), rejected=BooleanType()))
