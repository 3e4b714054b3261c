"""Embedding whitening by FEAST contour integration.

Spark gathers the covariance: one pass sums the integer vectors exactly, a
second multiplies centred blocks, and both leave one small aggregate a
dimension or pair of dimensions. The eigenproblem that remains has the size of
a vector, not of the corpus. It is solved an interval at a time:

* inertia counts (symmetric elimination with Bunch-Parlett pivots) say how many
  eigenvalues lie above a shift; bisection with them finds intervals that
  together hold the largest ones, few in each;
* for an interval, a Gauss-Legendre rule on the circle around it turns solves
  with complex shifted matrices into a filter that projects a block of vectors
  onto the interval's eigenvectors; Rayleigh-Ritz extracts them, again and again
  until residuals reach double precision;
* an interval is done when it yields as many components as its inertia counts
  say, else the block grows; so none is missed.

Whitened rows are written once; the covariance of what was written, summed by
Spark, gives ``identity_error``.

Defined cases: a vector that is null, holds null or non-finite entries, or is
shorter than the longest (its further entries count as null) is dropped; a null
or repeated id stays as it is, a row each; an entry whose integer exceeds a
long is clipped to it; dimensions or copies that leave fewer than 8 directions
with variance (above rounding) give fewer components, without variance no row;
``deviation`` is null where it exceeds a long; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripcast.session import written

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
PER_INTERVAL = 6        # eigenvalues aimed at in one interval
NODES = 8               # quadrature points on the upper half of the circle
ROUNDS = 40             # of filtering and Rayleigh-Ritz
RANK_EPS = 1e-12        # variance below this part of the trace is rounding
BLOCK_ROWS = 1024       # vectors multiplied at a time
LONG_LIMIT = 1 << 62


# ---- eigenvalues of a symmetric matrix in intervals ----

def inertia_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed ``shift``: the positive pivots of a
    symmetric elimination of matrix - shift * I (Sylvester's law)."""
    a = matrix - shift * np.eye(len(matrix))
    ratio, positive = (1 + np.sqrt(17)) / 8, 0
    while len(a):
        n = len(a)
        p = int(np.abs(np.diag(a)).argmax())
        r, s = divmod(int(np.abs(a).argmax()), n)
        if np.abs(a[r, s]) == 0:
            return positive
        if np.abs(a[p, p]) >= ratio * np.abs(a[r, s]):
            positive += a[p, p] > 0
            rest = np.delete(np.arange(n), p)
            row = a[p, rest]
            a = a[np.ix_(rest, rest)] - np.outer(row, row) / a[p, p]
        else:  # a block of two has one eigenvalue of each sign
            positive += 1
            rest = np.delete(np.arange(n), [r, s])
            rows = a[np.ix_([r, s], rest)]
            a = a[np.ix_(rest, rest)] - rows.T @ np.linalg.solve(a[np.ix_([r, s], [r, s])], rows)
    return positive


def intervals(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Disjoint (low, high, count) whose counts cover the ``wanted`` largest
    eigenvalues, each with at most PER_INTERVAL unless they lie too close together."""
    radius = np.abs(matrix).sum(axis=1).max()  # Gershgorin: no eigenvalue is larger
    top, bottom = radius * (1 + 1e-9) + 1e-300, -radius * 1e-9
    n = len(matrix)
    spans, found = [(bottom, top, inertia_above(matrix, bottom))], []
    while spans and sum(c for *_, c in found) < wanted:
        low, high, count = spans.pop()  # the upper part is always looked at first
        if not count:
            continue
        cut = None if count <= PER_INTERVAL else _gap(matrix, low, high)
        if cut is None:
            found.append((low, high, count))
            continue
        above = inertia_above(matrix, cut) - inertia_above(matrix, high)
        spans += [(low, cut, count - above), (cut, high, above)]
    return found


def _gap(matrix: np.ndarray, low: float, high: float) -> float | None:
    """A place between low and high with no eigenvalue close by; none if they
    are too close together (a cluster)."""
    width = high - low
    if width <= 1e-12 * max(abs(low), abs(high)):
        return None
    for share in (0.5, 0.45, 0.55, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8):
        at = low + share * width
        if inertia_above(matrix, at - 1e-4 * width) == inertia_above(matrix, at + 1e-4 * width):
            return at
    return None


def feast(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs with low < value <= high, values falling."""
    n = len(matrix)
    scale = max(np.abs(matrix).max(), 1e-300)
    points, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi * (points + 1) / 2
    block = min(n, count + max(3, count // 2))
    while True:
        center, radius = (low + high) / 2, (high - low) / 2 * (1 + 1e-10)
        spun = np.random.default_rng(13).standard_normal((n, block))
        best = np.inf
        for _ in range(ROUNDS):
            filtered = np.zeros((n, block))
            for angle, weight in zip(angles, weights):
                turn = radius * np.exp(1j * angle)
                solved = np.linalg.solve((center + turn) * np.eye(n) - matrix, spun.astype(complex))
                filtered += weight / 2 * (turn * solved).real
            basis, _ = np.linalg.qr(filtered)
            values, small = _rayleigh_ritz(basis.T @ matrix @ basis)
            spun = basis @ small
            inside = (values > low) & (values <= high)
            if inside.sum() == count:
                kept, mine = spun[:, inside], values[inside]
                residual = np.abs(matrix @ kept - kept * mine).max() / scale
                if residual <= 4 * np.finfo(float).eps * n or residual >= best / 2 and residual <= 1e-11:
                    order = np.argsort(-mine)
                    return mine[order], kept[:, order]
                best = min(best, residual)
        if block == n:
            raise ArithmeticError(f"{count} eigenvalues in ({low}, {high}] by inertia, {int(inside.sum())} found")
        block = min(n, 2 * block)


def _rayleigh_ritz(projected: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.linalg.eigh((projected + projected.T) / 2)


def leading_components(matrix: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, unit vectors as columns) of the largest eigenvalues
    that are more than rounding."""
    n = len(matrix)
    wanted = min(wanted, n)
    floor = RANK_EPS * max(np.trace(matrix), 0.0)
    if not n or floor <= 0:
        return np.zeros(0), np.zeros((n, 0))
    wanted = min(wanted, inertia_above(matrix, floor))
    pairs = [feast(matrix, *span) for span in intervals(matrix, wanted)]
    if not pairs:
        return np.zeros(0), np.zeros((n, 0))
    values, vectors = np.concatenate([v for v, _ in pairs]), np.hstack([u for _, u in pairs])
    order = np.argsort(-values, kind="stable")[:wanted]
    vectors = vectors[:, order]
    return values[order], vectors / np.linalg.norm(vectors, axis=0)


# ---- over the table ----

def usable_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the vectors whose entries are all finite numbers."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return embeddings.where(F.forall(vector_col, finite)).select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))


def _blocks(batch, size: int | None = None):
    """(ids, integer matrix) of a batch's vectors of one length, in blocks of rows: all lengths unless one is given."""
    column = batch.column("vector")
    sizes = np.asarray(column.value_lengths())
    for length in [size] if size else sorted(set(sizes.tolist()) - {0}):
        some = np.flatnonzero(sizes == length)
        for lo in range(0, len(some), BLOCK_ROWS):
            rows = pa.array(some[lo:lo + BLOCK_ROWS])
            values = column.take(rows).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
            whole = np.floor(np.clip(values * SCALE, -LONG_LIMIT, LONG_LIMIT)).astype(np.int64) + OFFSET
            yield batch.column("vec_id").take(rows), whole


def _exact(x: np.ndarray, factor: int = 1) -> np.ndarray:
    """``x`` as it is if ``factor`` times its entries fit a long, else as Python integers."""
    return x if not x.size or int(np.abs(x).max()) * factor < LONG_LIMIT else x.astype(object)


def exact_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """(n, per-dimension sums) of the integer vectors of the longest length."""
    def sums(batches):
        n, total = 0, []
        for batch in batches:
            for _, x in _blocks(batch):
                length = x.shape[1]
                if length < len(total):
                    continue
                if length > len(total):
                    n, total = 0, [0] * length
                n += len(x)
                total = [a + int(b) for a, b in zip(total, _exact(x, len(x)).sum(axis=0))]
        if total:
            k = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array([n] * k, pa.int64()),
                 pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["length", "dim", "n", "total"])

    rows = (vectors.mapInArrow(sums, "length int, dim int, n long, total decimal(38,0)")
            .groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect())
    length = max((r["length"] for r in rows), default=0)
    rows = sorted((r for r in rows if r["length"] == length), key=lambda r: r["dim"])
    return (rows[0]["n"], [int(r["total"]) for r in rows]) if rows else (0, [])


def covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance (divisor n) of the integer vectors, centred before multiplying."""
    size, mean = len(sums), np.array([s / n for s in sums])

    def products(batches):
        total = np.zeros((size, size))
        for batch in batches:
            for _, x in _blocks(batch, size):
                centred = x - mean
                total += centred.T @ centred
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])],
                                         names=["i", "j", "product"])

    rows = (vectors.mapInArrow(products, "i int, j int, product double")
            .groupBy("i", "j").agg(F.sum("product").alias("product")).collect())  # the square of a vector's length
    matrix = np.zeros((size, size))
    for r in rows:
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = r["product"] / n
    return matrix


def _projected(vectors: DataFrame, n: int, sums: list[int], values, axes) -> DataFrame:
    """(vec_id, deviation, whitened array) of the vectors of the full length."""
    mean, total = np.array([s / n for s in sums]), np.array(sums, dtype=object)
    scaled = axes / np.sqrt(values)
    near = max(map(abs, sums)) < LONG_LIMIT

    def deviations(x: np.ndarray) -> list:
        if near and int(np.abs(x).max()) * n < LONG_LIMIT // 4:
            off = x * n - total.astype(np.int64)
            if int(np.abs(off).max()) ** 2 * x.shape[1] < LONG_LIMIT:
                return (off * off).sum(axis=1).tolist()
        exact = ((x.astype(object) * n - total) ** 2).sum(axis=1)
        return [d if d < 1 << 63 else None for d in exact]

    def project(batches):
        for batch in batches:
            for ids, x in _blocks(batch, len(sums)):
                whitened = (x - mean) @ scaled
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(deviations(x), pa.int64()), pa.array(whitened.tolist(), pa.list_(pa.float64()))],
                    names=["vec_id", "deviation", "whitened"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(project, f"vec_id {kind}, deviation long, whitened array<double>")


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation,
    whitened, explained, identity_error."""
    vectors = usable_vectors(embeddings, id_col, vector_col)
    n, sums = exact_sums(vectors)
    matrix = covariance(vectors, n, sums) if n else np.zeros((0, 0))
    values, axes = leading_components(matrix, components)
    k = len(values)
    out = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return embeddings.sparkSession.createDataFrame(
            [], out.format(vectors.schema["vec_id"].dataType.simpleString()))
    rows = written(_projected(vectors, n, sums, values, axes), "whitened")

    w = [F.col("whitened")[i] for i in range(k)]
    moments = rows.agg(*[F.avg(w[i]).alias(f"m{i}") for i in range(k)],
                       *[F.avg(w[i] * w[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    error = max(abs(moments[f"p{i}_{j}"] - moments[f"m{i}"] * moments[f"m{j}"] - (i == j))
                for i in range(k) for j in range(i, k))
    shares = F.array(*[F.lit(float(v)) for v in values / np.trace(matrix)])
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error"))
