"""Near-dedup of vectors by NN-descent.

1. Identical vectors form a class; its smallest id stands for it.
2. Start: under several random rotations vectors are sorted into blocks by the
   signs of a few coordinates, and each vector takes its nearest ``K`` of its
   block as first neighbours. A block that many vectors share is dealt into
   smaller ones.
3. Rounds: every vector gathers its neighbours and those it is a neighbour of,
   compares them with each other (neighbours of neighbours), and offers each
   the better ones; lists keep the nearest K. Rounds go on until they bring
   hardly any link more.
4. Passes: rotations are independent, so the links that a further pass adds
   show what the ones before it missed. Passes follow until one adds hardly any
   to the lists that are not full.
5. Links of the lists, confirmed in double precision, make the components. A
   list that is full of links is saturated, and a link between two saturated
   vectors may be in neither list. So the saturated vectors of different
   components are held against each other: each component's are parted into
   balls around pivots, and two balls are compared in full unless the angle
   between their centres, less both radii, is wider than a link's (triangle
   inequality). A component pair's closest balls come first; what they join
   needs no further comparison.
6. Audit: samples of the vectors with full lists, with some links and with
   none are compared with all vectors. A link counts as found if its ends share
   a component, and every vector that has links counts alike. If the share is
   too small, another pass follows; if it stays so, the operator fails.
7. The members of each final component are compared in blocks of bounded size,
   so that all their links are counted, not only K.

Defined cases: a vector that is null, empty, all zero, or holds a null or
non-finite component links with nothing and is kept, as does one whose length
differs from the most common one; a null id is kept, without a component;
rows that share a vec_id count as one node, with its smallest vector's class.
Ties keep the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripcast.llm.graph import connected_components
from tripcast.session import written

K = 16
THRESHOLD = 0.9
BLOCK = 96             # vectors of a starting block, on average
ROTATIONS = 6          # starting blocks a vector, at least, and put together at once
MEET = 0.99            # chance that a pair at the threshold shares a starting block
ROUNDS = 6             # at most, a pass
ENOUGH = 0.02          # a pass ends when a round brings less than this share of the lists' links
OFFERS = 4             # offered to one vector by one of those it shares a neighbour with
AUDIT = 256            # vectors with full lists, and with some links, compared with all
AUDIT_NONE = 2048      # vectors without a link compared with all
RECALL = 0.97          # of the links of a vector that has links, on average, else another pass
PASSES = 6
DEAL = 512             # rows of a component's block, or of a ball
PIVOTS = 64            # of a component, at most
BALLS = 1024           # compared with as many in one task
SLACK = 1e-6           # radians, for rounding


def _unit(batches):
    """Unit vectors in double precision, with a digest of the vector."""
    for batch in batches:
        ids, unit, key = [], [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = None
            if i is not None and v and all(c is not None for c in v):
                x = np.array(v, np.float64)
                top = np.abs(x).max()
                x = x / top if np.isfinite(top) and top > 0 else None  # no overflow in the norm
            if x is None:
                continue
            x /= np.linalg.norm(x)
            ids.append(i)
            unit.append(x.astype("<f8").tobytes())
            key.append(hashlib.sha256(unit[-1]).digest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(unit, pa.binary()),
                                          pa.array(key, pa.binary())], names=["vec_id", "unit", "key"])


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1) if rows else np.empty((0, 1))


def _by_group(batches, key: int = 0):
    """Record batches of whole groups from batches sorted by their key column."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            held.append(batch.slice(lo, hi - lo))
            if hi < len(keys):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


_EDGE = "a long, b long, sim double"


def _edges(a, b, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x)) for x in (a, b, sim)], names=["a", "b", "sim"])


def _block_neighbours(k: int):
    def run(batches):
        for block in _by_group(batches):
            ids, unit = block.column("vec_id").to_numpy(), _matrix(block.column("unit"))
            if len(ids) < 2:
                continue
            sim = unit @ unit.T
            np.fill_diagonal(sim, -2)
            own = min(k, len(ids) - 1)
            near = np.argpartition(-sim, own - 1, axis=1)[:, :own]
            yield _edges(np.repeat(ids, own), ids[near].ravel(), np.take_along_axis(sim, near, axis=1).ravel())
    return run


def _bits(rows: int) -> int:
    """Signs that name a starting block."""
    return max(0, int(np.log2(max(rows / BLOCK, 1))))


def rotations(rows: int, threshold: float = THRESHOLD) -> int:
    """Rotations after which a pair at the threshold has shared a block with a chance of ``MEET``."""
    once = (1 - np.arccos(threshold) / np.pi) ** _bits(rows)
    return ROTATIONS if once >= 1 else max(ROTATIONS, int(np.ceil(np.log(1 - MEET) / np.log1p(-once))))


def _start(vectors: DataFrame, rows: int, dims: int, seed: int, k: int) -> DataFrame:
    """First neighbours from blocks of like signs under one random rotation."""
    bits = _bits(rows)
    planes = np.random.default_rng(seed).standard_normal((dims, max(bits, 1)))

    def code(batches):
        for batch in batches:
            x = (_matrix(batch.column("unit")) @ planes > 0)[:, :bits]
            c = x @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)), *batch.columns], names=["code", "vec_id", "unit"])

    coded = vectors.mapInArrow(code, "code long, vec_id long, unit binary")
    sizes = written(coded.groupBy("code").agg(F.count(F.lit(1)).alias("n")), "block-sizes")
    deal = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.ceil(F.col("n") / (2 * BLOCK)))
    # one row a code: at most rows / BLOCK codes, and Spark picks the join by their size
    blocks = coded.join(sizes, "code").select(F.xxhash64("code", deal).alias("block"), "vec_id", "unit")
    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_block_neighbours(k), _EDGE)


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """Each vector's k nearest of the pairs offered."""
    one = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return one.withColumn("place", place).where(F.col("place") <= k).drop("place")


def _local_join(batches):
    """The better pairs among each vector's neighbourhood."""
    for hood in _by_group(batches):
        ids, unit = hood.column("b").to_numpy(), _matrix(hood.column("unit"))
        if len(ids) < 2:
            continue
        bar, new = hood.column("bar").to_numpy(), hood.column("new").to_numpy().astype(bool)
        sim = unit @ unit.T
        sim[ids[:, None] == ids[None, :]] = -2
        sim[~(new[:, None] | new[None, :])] = -2       # met in an earlier round
        sim[sim <= bar[:, None]] = -2
        own = min(OFFERS, len(ids) - 1)
        near = np.argpartition(-sim, own - 1, axis=1)[:, :own]
        s = np.take_along_axis(sim, near, axis=1)
        r, c = np.nonzero(s > -2)
        if len(r):
            yield _edges(ids[r], ids[near[r, c]], s[r, c])


def _round(lists: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The lists after one round; ``new`` is 1 where the round brought the pair in."""
    back = lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim", "new")
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    back = back.withColumn("place", place).where(F.col("place") <= k).drop("place")
    hood = lists.unionByName(back).groupBy("a", "b").agg(F.max("new").alias("new"))
    bars = lists.groupBy("a").agg(F.min("sim").alias("low"), F.count(F.lit(1)).alias("n")).select(
        F.col("a").alias("vec_id"), F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(-1.5)).alias("bar"))
    facts = written(vectors.join(bars, "vec_id", "left").select(
        F.col("vec_id").alias("b"), "unit", F.coalesce("bar", F.lit(-1.5)).alias("bar")), "bars")
    offers = (hood.join(facts, "b").select("a", "b", "new", "unit", "bar")
              .repartition("a").sortWithinPartitions("a").mapInArrow(_local_join, _EDGE))
    old = lists.withColumn("new", F.lit(0))
    return written(_nearest(old.unionByName(offers.withColumn("new", F.lit(1))), k), "neighbours")


def _kinds(vectors: DataFrame, lists: DataFrame, threshold: float) -> DataFrame:
    """vec_id, and kind: 2 for a list full of links, 1 for some links, 0 for none."""
    links = lists.where(F.col("sim") >= threshold)
    n = links.groupBy("a").count().unionByName(links.select(F.col("b").alias("a"), F.lit(1).cast("long").alias("count")))
    n = n.groupBy(F.col("a").alias("vec_id")).agg(F.max("count").alias("n"))
    return written(vectors.join(n, "vec_id", "left").select(
        "vec_id", "unit", F.when(F.col("n") >= K, 2).when(F.col("n") > 0, 1).otherwise(0).alias("kind")), "kinds")


def audit(vectors: DataFrame, lists: DataFrame, found: DataFrame, threshold: float = THRESHOLD, seed: int = 99) -> float:
    """The share of its links that the components hold, for a vector that has
    links, on average: the smaller of that of vectors with full lists and that
    of all others."""
    kinds = _kinds(vectors, lists, threshold)
    sizes = {r["kind"]: r["count"] for r in kinds.groupBy("kind").count().collect()}  # 3 rows
    drawn = [kinds.where(F.col("kind") == k).orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(n).toArrow()
             for k, n in ((0, AUDIT_NONE), (1, AUDIT), (2, AUDIT))]
    sample = pa.concat_tables(drawn)  # AUDIT_NONE + 2 * AUDIT rows
    if not sample.num_rows:
        return 1.0
    ids, unit, kind = sample.column("vec_id").to_numpy(), _matrix(sample.column("unit")), sample.column("kind").to_numpy()

    def run(batches):
        for batch in batches:
            other, sim = batch.column("vec_id").to_numpy(), unit @ _matrix(batch.column("unit")).T
            q, o = np.nonzero((sim >= threshold) & (ids[:, None] != other[None, :]))
            yield _edges(ids[q], other[o], sim[q, o])

    own = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    far = found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    each = (vectors.mapInArrow(run, _EDGE).join(own, "a", "left").join(far, "b", "left").groupBy("a")
            .agg(F.avg(F.when(F.col("ca") == F.col("cb"), 1.0).otherwise(0.0)).alias("share")).collect())  # a row of the sample at most
    kind_of, held, linked = dict(zip(ids.tolist(), kind.tolist())), [0.0] * 3, [0] * 3
    for r in each:
        held[kind_of[r["a"]]] += r["share"]
        linked[kind_of[r["a"]]] += 1
    taken = np.bincount(kind, minlength=3)
    weight = [sizes.get(k, 0) / taken[k] if taken[k] else 0.0 for k in range(3)]
    full = held[2] / linked[2] if linked[2] else 1.0
    rest = weight[0] * linked[0] + weight[1] * linked[1]
    return min(full, (weight[0] * held[0] + weight[1] * held[1]) / rest if rest else 1.0)


def _known(lists: DataFrame, before: DataFrame, threshold: float) -> float:
    """The share of its links that were known before the pass, for a vector
    with links whose list is not full, on average."""
    old = before.select("a", "b", F.lit(True).alias("old"))
    each = lists.where(F.col("sim") >= threshold).join(old, ["a", "b"], "left").groupBy("a").agg(
        F.count(F.lit(1)).alias("n"), F.count("old").alias("old")).where(F.col("n") < K)
    return each.agg(F.coalesce(F.avg(F.col("old") / F.col("n")), F.lit(1.0)).alias("known")).first()["known"]


def _pass(lists: DataFrame | None, vectors: DataFrame, rows: int, dims: int, go: int, k: int, threshold: float) -> DataFrame:
    """The lists (a, b, sim, new) after further rotations and rounds."""
    need = rotations(rows, threshold)
    for lo in range(0, need, ROTATIONS):
        found = None
        for r in range(lo, min(lo + ROTATIONS, need)):
            s = _start(vectors, rows, dims, 1000 * go + r, k)
            found = s if found is None else found.unionByName(s)
        found = found.withColumn("new", F.lit(1))
        # a pair that an earlier pass brought in has been met; one of this pass has not
        lists = written(_nearest(found if lists is None else lists.withColumn("new", F.lit(int(lo > 0)) * F.col("new")).unionByName(found), k), "neighbours")
    for _ in range(ROUNDS):
        lists = _round(lists, vectors, k)
        r = lists.where(F.col("sim") >= threshold).agg(F.sum("new").alias("new"), F.count(F.lit(1)).alias("n")).first()
        if (r["new"] or 0) <= ENOUGH * r["n"]:
            break
    return lists


def _count_links(threshold: float):
    """Links of each row of a block (side 0) with the rows of another (side 1)."""
    def run(batches):
        for block in _by_group(batches):
            side = block.column("side").to_numpy()
            ids, unit, n = (block.column("vec_id").to_numpy(), _matrix(block.column("unit")), block.column("n").to_numpy())
            q, o = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            hit = (unit[q] @ unit[o].T >= threshold) & (ids[q][:, None] != ids[o][None, :])
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(hit @ n[o])], names=["rep", "links"])
    return run


def _angle(cosine):
    return np.arccos(np.clip(cosine, -1, 1))


def _nearest_pivot(batches):
    """Each vector with the number of the nearest of its component's pivots."""
    for batch in batches:
        unit, near = _matrix(batch.column("unit")), []
        for u, pivots in zip(unit, batch.column("pivots").to_pylist()):
            near.append(int(np.argmax(np.frombuffer(b"".join(pivots), "<f8").reshape(len(pivots), -1) @ u)))
        yield pa.RecordBatch.from_arrays([batch.column("component"), pa.array(near, pa.int64()), batch.column("vec_id"),
                                          batch.column("unit")], names=["component", "pivot", "vec_id", "unit"])


def _centres(batches):
    """Centre and radius (in radians) of each ball."""
    for ball in _by_group(batches):
        unit = _matrix(ball.column("unit"))
        centre = unit.sum(axis=0)
        long = np.linalg.norm(centre)
        centre = centre / long if long > 1e-9 else unit[0]
        yield pa.RecordBatch.from_arrays(
            [ball.column(c).combine_chunks().slice(0, 1) for c in ("ball", "component")]
            + [pa.array([centre.astype("<f8").tobytes()], pa.binary()), pa.array([float(_angle(unit @ centre).max())])],
            names=["ball", "component", "unit", "radius"])


def _close_balls(threshold: float):
    """Pairs of balls of different components that may hold a link."""
    def run(batches):
        for block in _by_group(batches):
            side = block.column("side").to_numpy()
            q, o = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            ball, component, radius = (block.column(c).to_numpy() for c in ("ball", "component", "radius"))
            unit = _matrix(block.column("unit"))
            apart = _angle(unit[q] @ unit[o].T)
            near = apart <= radius[q][:, None] + radius[o][None, :] + _angle(threshold) + SLACK
            x, y = np.nonzero(near & (component[q][:, None] < component[o][None, :]))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (
                ball[q][x], ball[o][y], component[q][x], component[o][y], apart[x, y])], names=["x", "y", "cx", "cy", "apart"])
    return run


def _one_link(threshold: float):
    """One link between the two balls of a pair, if there is one."""
    def run(batches):
        for pair in _by_group(batches):
            side = pair.column("side").to_numpy()
            q, o = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            ids, unit = pair.column("vec_id").to_numpy(), _matrix(pair.column("unit"))
            sim = unit[q] @ unit[o].T
            best = int(sim.argmax()) if sim.size else 0
            if sim.size and sim.flat[best] >= threshold:
                yield pa.RecordBatch.from_arrays([pa.array([ids[q[best // len(o)]]]), pa.array([ids[o[best % len(o)]]])],
                                                 names=["a", "b"])
    return run


def _links_across(saturated: DataFrame, found: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join all components between which saturated vectors
    (column vec_id) have a link; None if there are not two such components."""
    members = written(found.withColumnRenamed("node", "vec_id").join(saturated, "vec_id", "left_semi")
                      .join(vectors, "vec_id"), "saturated")
    if members.select("component").distinct().limit(2).count() < 2:
        return None
    draw = F.xxhash64("vec_id", F.lit(7))
    pivots = members.groupBy("component", F.pmod(draw, F.lit(PIVOTS)).alias("p")).agg(F.min_by("unit", draw).alias("unit"))
    pivots = written(pivots.groupBy("component").agg(F.collect_list("unit").alias("pivots")), "pivots")  # PIVOTS a row
    near = written(members.join(pivots, "component").select("component", "vec_id", "unit", "pivots").mapInArrow(
        _nearest_pivot, "component long, pivot long, vec_id long, unit binary"), "pivoted")
    deals = written(near.groupBy("component", "pivot").agg(F.ceil(F.count(F.lit(1)) / DEAL).alias("deals")), "ball-sizes")
    dealt = written(near.join(deals, ["component", "pivot"]).select(
        F.xxhash64("component", "pivot", F.pmod(F.xxhash64("vec_id"), F.col("deals"))).alias("ball"),
        "component", "vec_id", "unit"), "balls")
    balls = written(dealt.repartition("ball").sortWithinPartitions("ball").mapInArrow(
        _centres, "ball long, component long, unit binary, radius double"), "ball-centres")

    parts = -(-balls.count() // BALLS)
    own = F.pmod(F.xxhash64("ball"), F.lit(parts))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("other")
    sides = [balls.select(own.alias("own"), every, F.lit(side).alias("side"), "ball", "component", "unit", "radius")
             .select(F.xxhash64(*key).alias("block"), "side", "ball", "component", "unit", "radius")
             for side, key in ((0, ("own", "other")), (1, ("other", "own")))]
    pairs = written(sides[0].unionByName(sides[1]).repartition("block").sortWithinPartitions("block").mapInArrow(
        _close_balls(threshold), "x long, y long, cx long, cy long, apart double"), "close-balls")

    def links(of: DataFrame) -> DataFrame:
        of = of.withColumn("pair", F.xxhash64("x", "y"))
        both = [of.select("pair", F.lit(side).alias("side"), F.col(c).alias("ball")).join(
            dealt.select("ball", "vec_id", "unit"), "ball").drop("ball") for side, c in ((0, "x"), (1, "y"))]
        return written(both[0].unionByName(both[1]).repartition("pair").sortWithinPartitions("pair").mapInArrow(
            _one_link(threshold), "a long, b long"), "links-across")

    first = pairs.groupBy("cx", "cy").agg(F.min_by(F.struct("x", "y"), F.struct("apart", "x", "y")).alias("p"))
    out = links(first.select("p.x", "p.y"))
    firsts = first.select("p.x", "p.y")
    joined = connected_components(out.join(found.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a")
                                  .join(found.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
                                  .select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    rest = pairs.join(firsts, ["x", "y"], "left_anti")
    for c in ("cx", "cy"):
        rest = rest.join(joined.select(F.col("node").alias(c), F.col("component").alias("top")), c, "left").withColumn(
            f"{c}_top", F.coalesce("top", c)).drop("top")
    rest = written(rest.where("cx_top <> cy_top").select("x", "y"), "balls-apart")
    return out if rest.isEmpty() else out.unionByName(links(rest))


def _components(lists: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Components (node, component) of the lists' links and the links across."""
    links = written(lists.where(F.col("sim") >= threshold).select("a", "b"), "vector-links")
    found = connected_components(links)
    saturated = links.groupBy(F.col("a").alias("vec_id")).count().where(F.col("count") >= K).select("vec_id")
    across = _links_across(saturated, found, vectors, threshold)
    return found if across is None or across.isEmpty() else connected_components(links.unionByName(across))


def near_components(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    threshold: float = THRESHOLD) -> tuple[DataFrame, float]:
    """vec_id, n_links, component_id and kept for every row of ``df``; and the audited recall."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    units = written(rows.mapInArrow(_unit, "vec_id long, unit binary, key binary"), "unit-vectors")
    sizes = units.groupBy(F.length("unit").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = sizes["size"] if sizes else 8
    same = units.where(F.length("unit") == size)
    named = same.groupBy("vec_id").agg(F.min("key").alias("key"))
    classes = written(named.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "vector-classes")
    reps = classes.select(F.col("rep").alias("vec_id"), "key")
    vectors = written(same.join(reps, ["vec_id", "key"], "left_semi").dropDuplicates(["vec_id"]).select("vec_id", "unit"), "vectors")
    count = vectors.count()
    lists, recall = None, 1.0
    links = vectors.select(F.col("vec_id").alias("a"), F.col("vec_id").alias("b")).limit(0)
    found = connected_components(links) if count < 2 else None
    for go in range(PASSES if count > 1 else 0):
        before, lists = lists, _pass(lists, vectors, count, size // 8, go, K, threshold)
        if before is None or _known(lists, before, threshold) < RECALL:
            continue
        found = _components(lists, vectors, threshold)
        recall = audit(vectors, lists, found, threshold, go)
        if recall >= RECALL:
            break
    else:
        if count > 1:
            found = found if found is not None else _components(lists, vectors, threshold)
            recall = audit(vectors, lists, found, threshold)
            if recall < RECALL:
                raise RuntimeError(f"{PASSES} passes found {recall:.3f} of the links of a vector, less than {RECALL}")

    # every member of a component against its other members, in blocks of bounded size
    deals = written(found.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / DEAL).alias("deals")), "component-sizes")
    members = written(found.join(deals, "component").withColumnRenamed("node", "vec_id").join(vectors, "vec_id")
                      .join(classes.select(F.col("rep").alias("vec_id"), "n"), "vec_id")
                      .withColumn("deal", F.pmod(F.xxhash64("vec_id"), F.col("deals"))), "members")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1))
    asked = members.withColumn("other", other).select(
        F.xxhash64("component", "deal", "other").alias("block"), F.lit(0).alias("side"), "vec_id", "unit", "n")
    answer = members.withColumn("other", other).select(
        F.xxhash64("component", "other", "deal").alias("block"), F.lit(1).alias("side"), "vec_id", "unit", "n")
    linked = (asked.unionByName(answer).repartition("block").sortWithinPartitions("block")
              .mapInArrow(_count_links(threshold), "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links")))

    top = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").join(linked, "rep", "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"))
    placed = named.join(written(top, "class-components"), "key").select("vec_id", "n_links", "component_id")
    out = rows.select("vec_id").join(written(placed, "placed-vectors"), "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), recall
