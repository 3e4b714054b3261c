import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripcast.llm import prefix_trie, queries, toxicity, whitening

SF = "/root/testdata/sf0.001"


# ---- op11 ----

def trie_by_hand(rows):
    original = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            original[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in original.values():
        turns.sort(key=lambda t: (*t[:2], hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()))
    rebuilt, members = {}, defaultdict(list)
    for conv, own in original.items():
        h = zlib.crc32(str(conv).encode()) % 9
        base = original.get(conv - int(math.fmod(conv, 5)), [])
        rebuilt[conv] = [t[2:] for t in base[:h] + own[h:]]
        for d in range(len(rebuilt[conv]) + 1):
            members[tuple(rebuilt[conv][:d])].append(conv)
    children, leaves, saved, out = defaultdict(list), {}, {}, []
    for path in members:
        if path:
            children[path[:-1]].append(path)
    for path in sorted(members, key=len, reverse=True):
        here = members[path]
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        saved[path] = sum(saved[c] for c in children[path])
        saved[path] += (len(here) - 1) * len(path[-1][1].encode()) if path else 0
        ends = ",".join(map(str, sorted(c for c in here if len(rebuilt[c]) == len(path))))
        out.append((min(here), len(path), min(members[path[:-1]]) if path else None, len(here), len(children[path]),
                    leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id long, turn int, role string, text string, depth string, n_convs int"


def odd_conversations():
    rng = random.Random(3)
    rows = []
    for conv in [*range(60), -7, -5, -3, 10**15, 10**15 + 3, 2**63 - 2, 2**63 - 1, -2**63]:
        for turn in range(rng.randint(1, 9)):
            same = rng.random() < 0.8
            rows.append((conv, turn, "user" if turn % 2 == 0 else None, f"täxt {turn if same else rng.random()}"))
    rows += [(70, None, "user", "first"), (70, None, "user", "first"), (70, 0, None, None), (70, 0, "user", ""),
             (71, 3, "x", "a" * 200_000), (None, 0, "user", "nobody's"), (72, 0, "u", "1:x"), (73, 0, "u1", ":x")]
    rows += [(80 + k, t, "u", "hot") for k in range(40) for t in range(12)]
    rows += [(200, t, "u", f"long {t}") for t in range(300)]
    return rows


@pytest.mark.parametrize("how", [{}, {"shards": 30, "least_shard": 20, "held": 3}])
def test_prefix_trie_against_brute_force(spark, how):
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], CONVERSATIONS).repartition(5)
    got = prefix_trie.prefix_trie(df, **how)
    assert got.columns == [f.split()[0] for f in prefix_trie.NODE.split(", ")]
    assert sorted(map(tuple, got.collect()), key=str) == trie_by_hand(rows)


def test_prefix_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_end_lists_are_hashed_in_pieces(spark, monkeypatch):
    rows = [(conv, 0, "u", "same") for conv in range(0, 3000)]
    want = trie_by_hand(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert sorted(map(tuple, prefix_trie.prefix_trie(df).collect()), key=str) == want
    full = prefix_trie.rebuilt_turns(df)
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    small = list(prefix_trie._pieces([full.where("depth = length").select("ka", "kb", "conv_id")
                                      .orderBy("ka", "kb", "conv_id").toPandas()]))
    assert sum(len(p) for p in small) > 400
    hashes = {h for p in prefix_trie._hash_pieces(small) for h in p["ends_sha256"]}
    assert hashes == {w[-1] for w in want} - {prefix_trie.EMPTY_SHA}


def test_spilling_queue_is_a_queue(tmp_path):
    rng = random.Random(5)
    queue, plain = prefix_trie.SpillingQueue(held=10, folder=str(tmp_path)), []
    for _ in range(4000):
        if rng.random() < 0.6 or not plain:
            item = (rng.randrange(500), rng.randrange(9))
            queue.push(item)
            plain.append(item)
        else:
            plain.sort()
            assert queue.least() == plain[0] and queue.pop() == plain.pop(0)
    plain.sort()
    assert queue.spilled > 20 and [queue.pop() for _ in plain] == plain and not queue
    assert not list(tmp_path.iterdir())


# ---- op12 ----

def invented(n, rng):
    """Texts that are toxic only where an insult meets a group, long ones among them."""
    words = [f"word{k}" for k in range(3000)]
    for k in range(n):
        text = rng.choices(words, k=rng.choice([5, 30, 200, 3000]))
        insult, group = rng.random() < 0.3, rng.random() < 0.3
        text += rng.choices(["insultA", "insultB"], k=2) * insult + rng.choices(["groupA", "groupB"], k=2) * group
        rng.shuffle(text)
        yield k, " ".join(text), int(insult and group)


def test_machine_learns_pairs(spark):
    rows = list(invented(1600, random.Random(2)))
    df = spark.createDataFrame([(*r, "theirs") for r in rows], "doc_id long, text string, toxic int, score string")
    model = toxicity.fit(df.where("doc_id < 1000"), df.where("doc_id < 1000").select("doc_id", "toxic"))
    assert np.abs(model["factors"]).max() > 0 and len(model["cells"]) <= toxicity.MOST_INPUTS
    got = {r.doc_id: r for r in toxicity.score(df, model).where("doc_id >= 1000").collect()}
    right = [got[k].predicted == label for k, _, label in rows if k >= 1000]
    assert np.mean(right) > 0.97
    alone = toxicity.score(spark.createDataFrame(
        [(1, "insultA insultB"), (2, "groupA"), (3, "insultA groupB"), (4, None), (5, ""), (None, "groupA")],
        "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.predicted for r in alone} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0, None: 0}
    assert len({r.score for r in alone if not r.text}) == 1 and all(0 <= r.score <= 1 for r in alone)


def test_toxicity_without_enough_labels(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "doc_id long, text string")
    for labels, want in (([(1, 1), (2, 0)], 0.5), ([(1, 1)], 1.0), ([], 0.0), ([(1, None), (None, 1), (2, 7)], 0.0)):
        model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [round(r.score, 6) for r in toxicity.score(df, model).collect()] == [want] * 3
    assert toxicity.score(df.limit(0), model).count() == 0


def test_toxicity_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op12_toxicity(spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    held = got.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    r = held.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right"),
                 F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall")).first()
    assert r.right > 0.97 and r.recall > 0.8


# ---- op13 ----

def test_leading_components_against_lapack():
    rng = np.random.default_rng(1)
    for trial in range(60):
        n = int(rng.integers(1, 70))
        q, _ = np.linalg.qr(rng.standard_normal((n, n)))
        spectrum = [rng.random(n), np.round(rng.random(n) * 4) / 4, 10.0 ** -rng.integers(0, 14, n), np.ones(n)][trial % 4]
        matrix = (q * spectrum) @ q.T * 1e4
        matrix = (matrix + matrix.T) / 2
        want = np.linalg.eigvalsh(matrix)[::-1]
        values, vectors = whitening.leading_components(matrix)
        k = min(8, n, int((want > whitening.RANK_EPS * want.sum()).sum()))
        assert len(values) == k and np.allclose(values, want[:k], rtol=1e-11, atol=1e-12 * want[0])
        assert np.abs(matrix @ vectors - vectors * values).max(initial=0) < 1e-11 * max(want[0], 1)
        assert np.abs(vectors.T @ vectors - np.eye(k)).max(initial=0) < 1e-10
        at = float(rng.choice(want)) + 0.37
        assert whitening.inertia_above(matrix, at) == (want > at).sum()


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(4)
    good = (rng.standard_normal((400, 12)) @ rng.standard_normal((12, 12)) / 4).astype(np.float32)
    good[200:260] = good[0]
    odd = [None, [], [None] * 12, [float("nan")] * 12, [1.0] * 11 + [float("inf")], [1.0] * 11]
    rows = [(int(k), v.tolist(), "clash") for k, v in enumerate(good)] + [(900 + k, v, "clash") for k, v in enumerate(odd)]
    rows += [(None, good[1].tolist(), "clash"), (5, good[5].tolist(), "clash")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string").repartition(4)
    got = whitening.whiten(df).toPandas()
    kept = np.vstack([good, good[[1, 5]]]).astype(float)
    x = np.floor(kept * 1024) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    want = centred @ axes / np.sqrt(values)
    assert len(got) == n * 8 and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    ones = got[got.vec_id == 7].sort_values("component")
    sign = np.sign(ones.whitened.to_numpy() * want[7])
    assert np.allclose(ones.explained, values / np.trace(centred.T @ centred / n))
    for k in (0, 7, 210, 399):
        mine = got[got.vec_id == k].sort_values("component")
        assert np.allclose(mine.whitened, want[k] * sign, atol=1e-9)
        assert set(mine.deviation) == {sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k], sums))}
    assert (got.vec_id == 5).sum() == 16 and got.vec_id.isna().sum() == 8 and got.vec_id.max() == 399


def test_whitening_of_little(spark):
    kind = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, kind)).count() == 0
    flat = spark.createDataFrame([(k, [float(k % 3), 5.0, float(k % 3)]) for k in range(9)], kind)
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])], kind)
    assert {r.deviation for r in whitening.whiten(huge).collect()} >= {None}
