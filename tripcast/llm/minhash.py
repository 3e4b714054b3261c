"""Near-dedup of texts with HyperMinHash sketches.

A text's set holds its distinct five-word shingles (words are runs of other
characters than ASCII white space, A-Z lower-cased; a shorter text is one
shingle). Every shingle's 64-bit hash picks one of ``REGISTERS`` buckets; a
register keeps its bucket's smallest remaining hash in compressed form: the
number of leading zeros and the ``MANTISSA`` bits that follow the first one.

1. Texts with equal sets form a class; its smallest id stands for it.
2. Registers, empty ones filled from others by a fixed walk (densified), are
   banded; texts that share a band are candidates.
3. Every candidate is held against its band's smallest id: estimated from the
   registers, less the matches that the compression makes by chance; those
   that cannot be similar drop out, the rest is confirmed on the full sets.
   Links have ``100 * intersection >= percent * union``.
4. Links are joined into components. Two members of one component need no
   further test. Where a band holds several, its smallest id may be an outlier:
   its most central document is held against those of other components.
5. The members of bands that still hold several components are held against
   each other by an exact prefix filter: with all shingles in one order, rarest
   first, two similar sets meet in their first few, at places that leave enough
   to share. So no band's members are paired all with all.
6. The links of all steps make the components.

Defined cases: a null or empty text, or one without words, has an empty set,
links with nothing and is kept; rows that share a doc_id count as one node;
rows with a null doc_id link with nothing, are kept, and have a null
component. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tripcast.llm.common import in_small_batches, rows_among, rows_not_among
from tripcast.llm.graph import connected_components
from tripcast.llm.words import mix, shingle_sets
from tripcast.session import written

REGISTERS = 128
MANTISSA = 10
BANDS, BAND_ROWS = 25, 5
PERCENT = 85
SIGMAS = 5.0        # how far below the limit an estimate may lie and still be confirmed
TEXTS = 1 << 8      # texts handled together

_M1 = np.uint64(0x9E3779B97F4A7C15)


def _fill_walk() -> np.ndarray:
    """For each register, the order in which an empty one looks for a filled one."""
    rng = np.random.default_rng(20240501)
    return np.stack([np.concatenate(([j], rng.permutation(np.delete(np.arange(REGISTERS), j))))
                     for j in range(REGISTERS)])


_WALK = _fill_walk()


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers, a row for each set: 0 where the bucket is empty,
    else (leading zeros, mantissa) of its smallest hash, plus 1."""
    p = REGISTERS.bit_length() - 1
    h = mix(np.concatenate(sets) ^ np.uint64(0x5851F42D4C957F2D))
    cell = np.repeat(np.arange(len(sets)) * REGISTERS, [len(s) for s in sets]) + (h >> np.uint64(64 - p)).astype(np.int64)
    low = np.full(len(sets) * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(low, cell, (h << np.uint64(p)) | np.uint64(1))
    filled = np.zeros(len(low), bool)
    filled[cell] = True
    top = np.floor(np.log2((low >> np.uint64(32)).astype(np.float64) + 2.0 ** -20))   # exact for the upper half
    small = low < np.uint64(1 << 32)
    top = np.where(small, np.floor(np.log2(np.maximum(low & np.uint64(0xFFFFFFFF), np.uint64(1)).astype(np.float64))), top + 32)
    zeros = (63 - top).astype(np.uint64)
    after = low << zeros << np.uint64(1)                        # what follows the leading one
    out = (zeros << np.uint64(MANTISSA) | after >> np.uint64(64 - MANTISSA)) + np.uint64(1)
    return np.where(filled, out, 0).astype(np.uint16).reshape(-1, REGISTERS)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key a band for each row, over densified registers."""
    filled = regs > 0
    source = np.empty(regs.shape, np.int64)
    for j in range(REGISTERS):
        source[:, j] = _WALK[j][filled[:, _WALK[j]].argmax(axis=1)]
    dense = np.take_along_axis(regs, source, axis=1).astype(np.uint64)[:, :BANDS * BAND_ROWS]
    dense = dense.reshape(len(regs), BANDS, BAND_ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(regs), BANDS))
    for k in range(BAND_ROWS):
        key = mix(key * _M1 + dense[:, :, k])
    return key


def _sketch(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, TEXTS):
            sets = shingle_sets(batch.column(1).slice(lo, TEXTS).to_pylist())
            full = [s for s in sets if len(s)]
            regs = registers(full) if full else np.empty((0, REGISTERS), np.uint16)
            known = zip(full, regs, band_keys(regs).view(np.int64) if full else ())
            key1, key2, packed, bands = [], [], [], []
            for s in sets:
                if len(s):
                    s, r, b = next(known)
                    key1.append(int(np.bitwise_xor.reduce(mix(s)).astype(np.int64)))
                    key2.append(int(np.add.reduce(mix(s + _M1)).astype(np.int64)))
                    packed.append(r.tobytes())
                    bands.append(b)
                else:
                    for x in (key1, key2, packed, bands):
                        x.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, TEXTS), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(key1, pa.int64()), pa.array(key2, pa.int64()), pa.array(packed, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "key1", "key2", "regs", "bands"])


def sketches(texts: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit key, its registers and band keys,
    from doc_id and text."""
    return in_small_batches(texts).mapInArrow(
        _sketch, "doc_id long, n_shingles long, key1 long, key2 long, regs binary, bands array<long>")


def _sets(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, TEXTS):
            sets = [s.view(np.int64) for s in shingle_sets(batch.column(1).slice(lo, TEXTS).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, TEXTS), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of pairs of register rows, and the number of
    registers they rest on. Different minima can agree in their leading zeros
    and mantissa by chance; the expected number of such registers (the
    HyperMinHash approximation for sets of these sizes) is taken off the
    matches."""
    used = (a > 0) | (b > 0)
    n = np.maximum(used.sum(axis=1), 1)
    match = ((a == b) & used).sum(axis=1)
    ratio = np.minimum(na, nb) / np.maximum(np.maximum(na, nb), 1)
    by_chance = 0.169919487159739093975 * n * 4 * ratio / (1 + ratio) ** 2 * 2.0 ** -MANTISSA
    return np.maximum(match - by_chance, 0) / n, n


def _maybe_similar(percent: int):
    @pandas_udf("boolean")
    def check(regs_a: pd.Series, regs_b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        if not len(regs_a):
            return pd.Series([], dtype=bool)
        a, b = (np.frombuffer(b"".join(x), np.uint16).reshape(-1, REGISTERS) for x in (regs_a, regs_b))
        na, nb = na.to_numpy(float), nb.to_numpy(float)
        j, n = estimate(a, b, na, nb)
        limit = percent / 100
        fits = np.minimum(na, nb) >= limit * np.maximum(na, nb) - 1e-6  # else even full overlap is too little
        return pd.Series(fits & (j >= limit - SIGMAS * np.sqrt(limit * (1 - limit) / n)))
    return check


def _sides(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the facts of both, named with _a and _b."""
    for n in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("doc_id").alias(n), *[
            F.col(c).alias(f"{c}_{n}") for c in facts.columns if c != "doc_id"]), n)
    return pairs


def _linked(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that pass the estimate and then the check on full sets."""
    likely = _sides(pairs, reps.select("doc_id", "n", "regs")).where(
        _maybe_similar(percent)("regs_a", "regs_b", "n_a", "n_b")).select("a", "b")
    return _confirmed(written(likely, "likely-pairs"), sets, percent)


def _mixed_bands(shared: DataFrame, found: DataFrame) -> DataFrame:
    """band, doc_id and component of the bands that hold several components."""
    placed = written(shared.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "band", "doc_id", F.coalesce("component", "doc_id").alias("component")), "placed")
    mixed = placed.groupBy("band").agg(F.min("component").alias("c1"), F.max("component").alias("c2")) \
        .where("c1 < c2").select("band")
    return written(placed.join(written(mixed, "mixed-bands"), "band", "left_semi"), "mixed-rows")


def central_pairs(mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of each band's most central document with the band's
    documents of other components. A document near the middle of a large group
    meets many others in its bands; an outlier, which may have the smallest id,
    meets few. So the one whose bands hold the most rows is the most central."""
    sizes = mixed.groupBy("band").agg(F.count(F.lit(1)).alias("size"))
    score = mixed.join(sizes, "band").groupBy("doc_id").agg(F.sum("size").alias("score"))
    hubs = mixed.join(written(score, "band-scores"), "doc_id").groupBy("band").agg(
        F.max(F.struct("score", (-F.col("doc_id")).alias("minus"), F.col("component").alias("hub_component"))).alias("top"))
    return (mixed.join(written(hubs, "central"), "band").where("component <> top.hub_component")
            .select("doc_id", (-F.col("top.minus")).alias("hub"))
            .select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct())


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    union = F.size("shingles_a") + F.size("shingles_b") - common
    return written(_sides(pairs, sets).where(100 * common >= percent * union).select("a", "b"), "near-links")


def prefix_pairs(sets: DataFrame, group: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be similar: an exact
    filter over doc_id, shingles and the component of each.

    Shingles are ordered by the number of sets they occur in, those of one set
    first. A set of n can reach the limit only with partners that meet it in
    its first ``n - ceil(limit * n) + 1`` (for the smaller partner,
    ``n - ceil(2 * limit / (1 + limit) * n) + 1``) shingles, and at places
    after which both have enough left."""
    rows = sets.select("doc_id", F.explode("shingles").alias("s"))
    shared = written(rows.groupBy("s").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "shared-shingles")
    lists = rows.join(shared, "s").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("list"))
    facts = (sets.select("doc_id", F.size("shingles").alias("n")).join(lists, "doc_id")
             .join(group, "doc_id")
             .withColumn("own", F.col("n") - F.size("list"))
             .withColumn("first", F.expr(f"n - (({percent} * n + 99) div 100) + 1 - own"))
             .where("first > 0")
             .select("doc_id", "n", "own", "component", F.posexplode(F.slice("list", F.lit(1), F.col("first").cast("int"))))
             .select("doc_id", "n", "component", (F.col("own") + F.col("pos")).alias("at"), F.col("col.s").alias("s")))
    facts = written(facts, "prefixes")
    small = facts.where(f"at < n - ((2 * {percent} * n + {99 + percent}) div {100 + percent}) + 1").select(
        "s", F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"), F.col("component").alias("cx"))
    large = facts.select("s", F.col("doc_id").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"),
                         F.col("component").alias("cy"))
    return (small.join(large, "s")
            .where((F.col("cx") != F.col("cy")) & (F.struct("nx", "x") < F.struct("ny", "y")))
            .where(f"100 * nx >= {percent} * ny")
            .where(f"{100 + percent} * least(nx - ax, ny - ay) >= {percent} * (nx + ny)")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for each row of ``df``."""
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    drawn = written(sketches(texts), "sketches")

    known = drawn.where("doc_id is not null and key1 is not null")
    classes = written(known.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = written(known.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
                   .select("doc_id", F.col("n_shingles").alias("n"), "regs", "bands"), "representatives")

    members = reps.select("doc_id", F.explode("bands").alias("band"))
    hubs = written(members.groupBy("band").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last"))
                   .where("hub < last").select("band", "hub"), "band-hubs")
    shared = written(members.join(hubs, "band"), "shared-bands")
    wanted = written(shared.select("doc_id").distinct(), "candidates")
    sets = written(rows_among(texts, wanted, "doc_id").mapInArrow(
        _sets, "doc_id long, shingles array<long>"), "shingle-sets")

    pairs = shared.where("hub < doc_id").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = _linked(pairs, reps, sets, percent)
    found = connected_components(links)

    mixed = _mixed_bands(shared, found)
    central = _linked(central_pairs(mixed), reps, sets, percent)
    if not central.isEmpty():
        links = links.unionByName(central)
        found = connected_components(links)
        mixed = _mixed_bands(shared, found)

    apart = written(mixed.select("doc_id", "component").distinct(), "apart")
    more = _confirmed(written(prefix_pairs(sets.join(apart.select("doc_id"), "doc_id", "left_semi"), apart, percent),
                              "prefix-pairs"), sets, percent)
    if not more.isEmpty():
        found = connected_components(links.unionByName(more))

    top = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key1", "key2", F.coalesce("component", "rep").alias("component_id"))
    top = written(top, "class-components")
    return (drawn.select("doc_id", "n_shingles", "key1", "key2").join(top, ["key1", "key2"], "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` that stay: one document of each component."""
    gone = near_components(df, id_col, text_col, percent).where("not kept").select("doc_id").distinct()
    return rows_not_among(df, gone, id_col)
