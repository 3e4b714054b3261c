import base64
import hashlib
import html.parser
import itertools
import random
import struct
import time
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tripcast.llm import (bpe, exact_dedup, langid, lm_scoring, minhash, nn_descent, packing, queries,
                          sharding, token_counts, warc)

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 997}x" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score int, slot int"


@pytest.fixture(scope="module")
def docs(spark):
    """Ordinary documents and odd ones: nulls, empty, blank, repeated, very long; clashing columns."""
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    near = "the quick brown fox jumps over the lazy dog and runs far away from all of us here today my old friend " * 4
    odd = [(9001, None, "en", None, None), (9002, "", None, "a", 0), (9003, " \n\t ", "fr", "a", 4),
           (9004, LONG, "en", "a", 1), (9005, LONG, "en", "a", 1), (9006, "12 34 !!", "de", "b", 3),
           (9007, near + "one two", "en", "b", 5), (9008, near + "one three", "en", "b", 5), (9009, None, None, None, None),
           (9010, "a b", None, "c", 3), (9011, "A  b\n", None, "c", 3), (9010, "a b", None, "c", 3)]
    return spark.createDataFrame([(*x, "theirs", 7, 1) for x in base + odd], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for d, t in texts_of(docs):
        groups[t or ""].append(d)
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        g = groups[r.text or ""]
        assert (r.keep_id, r.group_size, r.kept) == (max(g), len(g), r.doc_id == max(g))
        assert r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() and r.slot == 1
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and {r.kept for r in left.collect()} == {"theirs"}
    assert sorted(r.text or "" for r in left.collect()) == sorted(groups)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_dedup_against_brute_force(docs, empty):
    sets = {}
    for d, t in texts_of(docs):
        sets[d] = shingles(t)
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((top(a), top(b)))
            up[y] = x
    rows = minhash.near_components(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), top(r.doc_id), r.doc_id == top(r.doc_id))
    assert top(9008) == 9007 and top(9011) == 9010
    left = minhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.select("doc_id").collect()} == {top(d) for d in sets}
    assert minhash.near_components(empty).count() == 0


def test_near_dedup_links_variants_that_miss_their_hub(spark):
    """Variants of one text: links between variants count, though most are too far from the smallest id."""
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(400)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.choice(400, rng.integers(0, 12), replace=False):
            words[k] = f"v{i}_{k}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in minhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    up = dict.fromkeys(sets)
    for i in sets:
        up[i] = i
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sets, 2):
            n = len(sets[a] & sets[b])
            if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n) and up[a] != up[b]:
                up[a] = up[b] = min(up[a], up[b])
                changed = True
    assert got == up


def test_near_dedup_of_a_group_whose_smallest_id_is_an_outlier(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]

    def edited(n):
        words = list(base)
        for at in rng.sample(range(len(base)), n):
            words[at] = f"x{rng.random()}"
        return " ".join(words)

    rows = [(0, edited(4))] + [(k, edited(rng.choice([0, 1, 1, 2, 2, 3]))) for k in range(1, 60)]
    sets = {i: shingles(t) for i, t in rows}
    best = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                lo, hi = sorted((best[a], best[b]))
                best = {k: lo if v == hi else v for k, v in best.items()}
    got = {r.doc_id: r.component_id for r in minhash.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == best


def test_estimate_follows_jaccard():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 64, 4000, np.uint64))
    b = np.unique(np.concatenate([a[:3600], rng.integers(0, 1 << 64, 400, np.uint64)]))
    regs = minhash.registers([a, b])
    j, _ = minhash.estimate(regs[:1], regs[1:], np.array([len(a)]), np.array([len(b)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(j[0] - true) < 0.15


def test_language_id(spark, docs, empty):
    rows = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.01
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert {got[i].lang_pred for i in (9001, 9002, 9003, 9006, 9009)} == {"und"} and got[9001].rejected
    assert got[9004].lang_pred in {"en", "de", "fr", "es"} and all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict_text("日本語のテキストです、これは知らない言語で書かれた長い文章です。" * 9, model)[2]
    nothing = langid.fit(empty.select("doc_id", "text", "lang"))
    assert langid.predict(docs, nothing).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(empty, model).count() == 0


def test_language_id_rejects_what_it_does_not_know(spark):
    rng = random.Random(1)
    letters = lambda lo, hi: lambda n: " ".join("".join(chr(rng.randrange(lo, hi)) for _ in range(rng.randint(2, 9)))
                                                for _ in range(n // 6))
    junk = {"han": lambda n: "".join(chr(rng.randrange(0x4e00, 0x9fff)) for _ in range(n)), "cyrillic": letters(0x430, 0x450),
            "greek": letters(0x3b1, 0x3ca), "latin": letters(97, 123),
            "base64": lambda n: base64.b64encode(rng.randbytes(n * 3 // 4)).decode(), "hex": lambda n: rng.randbytes(n // 2).hex()}
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.fit(table.where(~queries.held_out()).select("doc_id", "text", "lang"))
    assert all(len(f) == langid.CLASSES for f in model["floor"])
    for name, make in junk.items():
        for n in (500, 3000, 20_000, 100_000):
            assert langid.predict_text(make(n), model)[2], (name, n)
    held = langid.predict(table.where(queries.held_out()), model).where("text is not null and lang is not null")
    r = held.agg(F.avg(F.col("rejected").cast("int")).alias("rejected"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"),
                 F.max(F.when(F.col("rejected"), F.length("text"))).alias("longest")).first()
    assert r.rejected < 0.01 and r.right > 0.98
    clean = " ".join(x.text for x in table.where("lang = 'de' and doc_id % 7 = 1").limit(60).collect())
    assert not any(langid.predict_text(clean[:n], model)[2] for n in (100, 1000, 10_000, 100_000))


def test_byte_bpe_against_tiktoken(docs, empty):
    import tiktoken
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = bpe.encode_digests(docs, path, P.PATTERN, with_ids=True).collect()
    want = {d: (enc.encode_ordinary(t or ""), t or "") for d, t in texts_of(docs)}
    for r in rows:
        ids, text = want[r.doc_id]
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_digests(empty, path, P.PATTERN).count() == 0
    e = bpe.Encoder(bpe.Vocabulary(ranks), P.PATTERN)
    odd = ["", "  a  b\n\n c\t\t", "\x1c.\x1c a\x85b", "x" * 3000 + " é" * 50, "it's  don't  　 x ", "🙂👍🏽 日本語", "   "]
    assert [x.tolist() for x in e.ids(odd)] == [enc.encode_ordinary(t) for t in odd]


def test_packing(docs, empty):
    from tokenizers import Tokenizer
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in texts_of(docs)}
    rows = packing.pack(docs.dropDuplicates(["doc_id"]), path).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = want[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) and r.doc_tokens == len(want[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for runs, size in [(v, len(want[d])) for d, v in pieces.items()] + [(v, None) for v in sequences.values()]:
        at = 0
        for start, n in sorted(runs):
            assert start == at and n > 0
            at += n
        assert at == size if size else at <= packing.WINDOW
    assert set(pieces) == set(want)
    full = sum(n for v in sequences.values() for _, n in v) / (len(sequences) * packing.WINDOW)
    assert full > 0.97
    assert packing.pack(empty, path).count() == 0
    assert packing.pack(docs, path).select("doc_id", "start").count() >= len(rows)


def test_packing_of_added_tokens(spark):
    from tokenizers import Tokenizer
    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|startoftext|>x", "<|ENDOFTEXT|> y", "x<|endoftext|><|startoftext|>É", "<|endoftext|", "日<|endoftext|>本",
             "plain words", "|>< <|endoftext|>", "don't<|endoftext|>'s " * 3]
    assert t.encode(texts[0], add_special_tokens=False).ids == [320, 49407, 321]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in packing.pieces(df, path).collect()}
    for k, x in enumerate(texts):
        ids = [*t.encode(x, add_special_tokens=False).ids, 1]
        assert (got[k].length, got[k].ids_crc32) == (len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))), x


def test_packing_plan_uses_every_length_once():
    rng = np.random.default_rng(0)
    histogram = np.bincount(rng.integers(1, 2048, 5000), minlength=2048)
    histogram[300] += 3000
    used = np.zeros(2048, np.int64)
    for combo, n in packing.plan(histogram, 2048):
        assert sum(combo) <= 2048
        for length in combo:
            used[length] += n
    assert (used == histogram).all()


def test_token_counts(docs, empty):
    path = P.path("piece_bpe_32k.model")
    model = token_counts.Unigram(token_counts.pieces_of(path))

    def viterbi(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            spelled = len(word[end - 1].encode())
            options = [(best[end - 1][0] + spelled * model.byte_score, -(-best[end - 1][1] + spelled))]
            for start in range(end):
                s = model.score.get(word[start:end])
                if s is not None:
                    options.append((best[start][0] + s, best[start][1] - 1))
            best.append(max(options))
        return -best[-1][1]
    rows = {r.doc_id: r for r in token_counts.token_counts(docs, path).collect()}
    for d, t in texts_of(docs)[::9] + [(d, t) for d, t in texts_of(docs) if d >= 9001 and t != LONG]:
        words = ["▁" + w for w in t.split(" ")] if t else []
        assert (rows[d].n_tokens, rows[d].n_pre_tokens) == (sum(map(viterbi, words)), len(words))
    assert rows[9004].n_tokens == rows[9005].n_tokens > 60_000
    assert token_counts.token_counts(empty, path).count() == 0


def test_sharding(spark, docs, empty):
    rows = docs.select("doc_id", F.octet_length("text").alias("n_bytes"), F.lit("x").alias("shard_id")).unionByName(
        spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(100).alias("n_bytes"), F.lit("x").alias("shard_id")))
    limit = 20_000
    out = sharding.assign_shards(rows, limit=limit).collect()
    assert len(out) == rows.count()
    shards = defaultdict(list)
    for r in out:
        shards[r.shard_id].append(r)
    for k, v in shards.items():
        total = sum(r.n_bytes or 0 for r in v)
        assert all((r.shard_bytes, r.shard_rows, r.shard_depth) == (total, len(v), len(k)) for r in v)
        assert total <= limit or len(v) == 1 and v[0].oversized
        if k:  # split only because the parent was over the limit
            assert sum(r.n_bytes or 0 for s, x in shards.items() if s.startswith(k[:-1]) for r in x) > limit
    assert len({k for k, v in shards.items() if any(r.doc_id == 5 for r in v)}) > 10
    assert sharding.assign_shards(empty.select("doc_id", F.col("n_chars").alias("n_bytes"))).count() == 0
    plan = sharding.assign_shards(rows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_lm_tables_in_little_memory(monkeypatch):
    """A table is built slice by slice; counts are whole however often a task gives them out."""
    rng = np.random.default_rng(2)
    grams = np.unique(rng.integers(0, 1 << 24, 200_000))
    n = rng.integers(1, 9, len(grams))
    tracemalloc.start()
    table = lm_scoring.log_probabilities(grams, n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20  # the table itself has 64 MB
    assert np.allclose(np.exp(table.reshape(-1, 256)[::97].astype(float)).sum(axis=1), 1, atol=1e-4)
    mixed = rng.permutation(len(grams))
    assert np.array_equal(lm_scoring.log_probabilities(grams[mixed], n[mixed]), table)

    texts, chosen = ["abcd" * 50, None, "abce", ""] * 3, [True, False, False, None] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(chosen, pa.bool_())], names=["text", "target"])
    sums = []
    for most in (lm_scoring.CELL_MOST, 300):
        monkeypatch.setattr(lm_scoring, "CELL_MOST", most)
        total = defaultdict(lambda: np.zeros(2, int))
        for out in lm_scoring._count([batch] * 4):
            for k, *x in zip(*(c.to_pylist() for c in out.columns)):
                total[k] += x
        sums.append({k: tuple(x) for k, x in total.items()})
    assert sums[0] == sums[1] and tuple(map(sum, zip(*sums[0].values()))) == (12 * (200 + 4), 12 * 200)


def broadcast_rows(df):
    """Rows of each broadcast of the plan that ``df`` ran by."""
    def walk(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if name.endswith("QueryStage"):
            return walk(plan.plan())
        own = [plan.metrics().apply("numOutputRows").value()] if name == "BroadcastExchange" else []
        children = plan.children()
        return own + [n for k in range(children.size()) for n in walk(children.apply(k))]
    return walk(df._jdf.queryExecution().executedPlan())


def test_large_directory_is_not_broadcast(spark):
    """More shards than one process should hold, and one id with an eighth of the rows."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 8 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit(20).alias("n_bytes"))
    limit = 30
    out = sharding.assign_shards(rows, limit=limit)
    shards = defaultdict(list)
    for r in out.collect():
        shards[r.shard_id].append(r)
    assert broadcast_rows(out) and max(broadcast_rows(out)) <= sharding.HEAVY
    assert sum(map(len, shards.values())) == 60_000
    for k, v in shards.items():
        assert len(v) == 1 and all((r.shard_bytes, r.shard_rows, r.shard_depth, r.oversized) == (20, 1, len(k), False) for r in v)
    assert sum(r.doc_id == 5 for v in shards.values() for r in v) == 7_501


def test_nn_descent_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 24))
    x[100:160] = x[100] + 0.05 * rng.standard_normal((60, 24))     # more links than a list holds
    x[300:310] = x[300]                                            # copies
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)] + [
        (900, None, ""), (901, [], ""), (902, [0.0] * 24, ""), (903, [float("nan")] * 24, ""), (904, [None] * 24, ""),
        (905, [float("inf")] * 24, ""), (906, [1.0, 2.0], "")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, sim string")
    out, recall = nn_descent.near_components(frame)
    got = {r.vec_id: r for r in out.collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    comp = np.arange(700)
    for _ in range(20):
        comp = np.minimum(comp, np.where(hit, comp[None, :], 700).min(axis=1))
    assert len(got) == len(rows) and recall > 0.9
    assert sum(got[i].n_links for i in range(700)) >= 0.9 * hit.sum()
    assert all(got[i].n_links <= hit[i].sum() for i in range(700))
    assert np.mean([got[i].component_id == comp[i] for i in range(700)]) > 0.98
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 907))
    assert nn_descent.near_components(frame.limit(0))[0].count() == 0


def test_nn_descent_joins_dense_groups_linked_only_across(spark):
    """Two groups of more than K vectors, each tighter inside than towards the other: no list holds a cross link."""
    rng = np.random.default_rng(11)
    one, two = np.zeros(24), np.zeros(24)
    one[0], two[0], two[1] = 1, 0.93, np.sqrt(1 - 0.93 ** 2)
    x = np.concatenate([one + 0.008 * rng.standard_normal((30, 24)), two + 0.008 * rng.standard_normal((30, 24)),
                        rng.standard_normal((200, 24))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    near = np.argsort(-(u @ u.T - 2 * np.eye(len(u))), axis=1)[:60, :nn_descent.K]
    assert hit[:60, :60].sum() == 60 * 59 and ((near < 30) == (np.arange(60) < 30)[:, None]).all()
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in nn_descent.near_components(frame)[0].collect()}
    assert all((got[i].component_id, got[i].n_links, got[i].kept) == (0, 59, i == 0) for i in range(60))
    assert [got[i].n_links for i in range(60, 260)] == hit[60:].sum(axis=1).tolist()


def test_nn_descent_audit_sees_lost_pairs_beside_a_hot_group(spark):
    """Sparse pairs that no component holds count, however many links a hot group has; so does a torn hot group."""
    rng = np.random.default_rng(13)
    x = rng.standard_normal((600, 24))
    x[:200] = x[0] + 0.03 * rng.standard_normal((200, 24))
    x[300:320] = x[320:340] + 0.03 * rng.standard_normal((20, 24))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.astype("<f8").tobytes()) for i, v in enumerate(u)], "vec_id long, unit binary").cache()
    sim = u @ u.T - 2 * np.eye(600)
    hot = [(i, int(j), float(sim[i, j])) for i in range(200) for j in np.argsort(-sim[i])[:nn_descent.K]]
    pairs = [(i, i + 20, float(sim[i, i + 20])) for i in range(300, 320)]
    whole = [(i, 0) for i in range(200)]

    def audit(lists, found):
        return nn_descent.audit(vectors, spark.createDataFrame(lists, "a long, b long, sim double"),
                                spark.createDataFrame(found, "node long, component long"))
    assert audit(hot + pairs, whole + [(i + d, i) for i in range(300, 320) for d in (0, 20)]) == 1
    assert audit(hot, whole) < 0.1
    assert audit(hot, [(i, i // 100) for i in range(200)]) < 0.6


def test_nn_descent_rotations_keep_step_with_size():
    for rows in (2_000, 1_000_000, 30_000_000):
        meet = (1 - np.arccos(nn_descent.THRESHOLD) / np.pi) ** int(np.log2(rows / nn_descent.BLOCK))
        assert 1 - (1 - meet) ** nn_descent.rotations(rows) >= 0.99


def test_warc_round_trip(spark, tmp_dir):
    pages = spark.createDataFrame([(1, "http://a/b", "<html lang='en'><head><title>T &amp; x</title></head><body><p>One<p>Two <b>3</b>"
                                    "<script>no</script><a href='/l'>é</a></body></html>", 1), (2, None, None, 2), (1, "http://a/b", "", 3)],
                                  "page_id long, url string, html string, header int")
    records = warc.derive(warc.responses(pages))
    rows = records.collect()
    assert len(rows) == 6
    first = {r.warc_type: r for r in rows if r.source_payload_digest == warc._digest(pages.first().html.encode())}
    assert first["conversion"].block == "One\nTwo 3é"
    assert "title: T & x\r\n" in first["metadata"].block and "outlink: /l L a/@href" in first["metadata"].block
    assert "http-Content-Type: text/html; charset=utf-8" in first["metadata"].block
    path = f"{tmp_dir}/w"
    warc.write_warc(records, path)
    import glob
    import gzip
    data = b"".join(gzip.open(f).read() for f in glob.glob(path + "/*.gz"))
    seen = {}
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        assert warc._digest(rest[:n]) == fields["WARC-Block-Digest"] and rest[n:n + 4] == b"\r\n\r\n"
        seen[fields["WARC-Record-ID"]] = fields["WARC-Refers-To"]
        data = rest[n + 4:]
    assert seen == {r.record_id: r.refers_to for r in rows}
    assert {r.refers_to for r in rows} == {r.record_id for r in warc.responses(pages).collect()}
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


class Walk(html.parser.HTMLParser):
    """A page read by the standard library, under the same rules of what is shown."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.links, self.head, self.title, self.part, self.lang = [], [], [], False, None, None, None

    def _break(self, tag):
        if not self.hidden and not self.head:
            self.out.append("\n" if tag in warc.BLOCKS else " " if tag in warc.CELLS else "")

    def handle_starttag(self, tag, attrs):
        values = dict(reversed(attrs))
        self.head = tag == "head" or self.head and (bool(self.hidden) or tag in warc.HEAD_ONLY)
        self.lang = self.lang or (values.get("lang") if tag == "html" else None)
        if tag == "a" and "href" in values:
            self.links.append(values["href"] or "")
        if tag in warc.HIDDEN or tag in ("script", "style"):
            self.hidden.append(tag)
        if tag == "title":
            self.part = ""
        self._break(tag)

    def handle_endtag(self, tag):
        if tag == "head":
            self.head = False
        if tag in self.hidden:
            self.hidden.remove(tag)
        if tag == "title" and self.part is not None:
            self.title, self.part = self.title if self.title is not None else self.part, None
        self._break(tag)

    def handle_data(self, data):
        if self.part is not None:
            self.part += data
            return
        self.head = self.head and not (data.strip() and not self.hidden)
        if not self.hidden and not self.head:
            self.out.append(data.replace("\n", " "))


ODD_PAGES = ['<a title="x > y" href="/q">link</a> <img alt="a>b">', "a < b & c &lt; d &amp;amp;", "<p>one<br/>two</p><!-- <p>no -->three",
             "<script>if (a < b) { '</p>' }</script>shown", "<head><title>T &amp; x</title><link rel=x> </head><body>yes", "<head><title>T</title>text ends it</head>yes",
             "<head><meta charset=u><p>opens the body", "<table><tr><td>1<td>2</table>", "<TEMPLATE><p>no<template>no</template>no</TEMPLATE>yes",
             "<a href='/1'>x</a><A HREF=/2>y</A><a name=z>w</a><a href>v</a>", "<!DOCTYPE html><html lang=\"de-AT\"><body>x", "<style>p{}</style >y"]


def test_pages_against_a_html_parser(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect() if r.html] + ODD_PAGES
    for page in pages:
        text, title, lang, links = warc.read_page(page)
        walk = Walk()
        walk.feed(page)
        walk.close()
        shown = warc._LINES.sub("\n", warc._BLANKS.sub(" ", "".join(walk.out))).strip()
        assert (text, title and html.unescape(title), lang, links) == (shown, walk.title, walk.lang, walk.links), page[:200]
    assert warc.read_page(ODD_PAGES[0]) == ("link", None, None, ["/q"])


def test_pages_take_time_in_proportion():
    for bad in ("<a ", "<head>", "<title>", '<a href="', "<!--", "<script>", "</a", "<a x='", "<svg>", '<a b=c "', "&amp", '<a href="x" ', "<!-"):
        page = (bad * (1_000_000 // len(bad) + 1))[:1_000_000]
        began = time.process_time()
        warc.read_page(page)
        assert time.process_time() - began < 2, bad


def test_lm_scoring(spark, docs, empty):
    target = spark.createDataFrame([(0,), (1,), (1,), (9004,), (None,), (123456,)], "doc_id long")
    rows = {(r.doc_id): r for r in lm_scoring.score_documents(docs, target).collect()}
    all_texts = [t or "" for _, t in texts_of(docs)]
    chosen = [t or "" for d, t in texts_of(docs) if d in (0, 1, 9004)]

    def table(texts):
        n = np.zeros((256, 256, 256))
        for t in texts:
            b = b"\n\n" + t.encode()
            for i in range(2, len(b)):
                n[b[i - 2], b[i - 1], b[i]] += 1
        return n
    back, want = table(all_texts), table(chosen)
    back *= want.sum() / back.sum()

    def loss(n, t):
        uni, bi = n.sum(axis=(0, 1)), n.sum(axis=0)
        b, total = b"\n\n" + t.encode(), 0.0
        for i in range(2, len(b)):
            x, y, z = b[i - 2:i + 1]
            p = (uni[z] + 1) / (uni.sum() + 256)
            p = (bi[y, z] + 16 * p) / (bi[y].sum() + 16)
            total -= np.log((n[x, y, z] + 16 * p) / (n[x, y].sum() + 16))
        return total / (len(b) - 2)
    text = dict(texts_of(docs))
    for d in (0, 7, 9007):
        assert rows[d].loss_target == pytest.approx(loss(want, text[d][:]), abs=1e-4)
        assert rows[d].loss_background == pytest.approx(loss(back, text[d]), abs=1e-4)
        assert rows[d].score == pytest.approx(rows[d].loss_target - rows[d].loss_background)
    assert rows[9001].n_tokens == 0 and rows[9001].score is None
    assert lm_scoring.score_documents(empty, target).count() == 0
    assert lm_scoring.score_documents(docs, target.limit(0)).where("abs(score) > 1e-9").count() == 0


def test_pipeline(spark, docs, empty):
    import corpus_pipeline
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "packing"]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.count()
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns and kept.count() <= before
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {9001, 9002, 9003, 9006, 9009} and len(ids & {9004, 9005}) == 1 and 9007 in ids and 9008 not in ids
    assert {r.doc_id for r in corpus_pipeline.pack(spark, kept, SF).select("doc_id").collect()} == ids
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_drops_near_copies_from_80_percent(spark):
    """A pair at about 0.82 is one text to the stage; a pair at about 0.78 stays two."""
    import corpus_pipeline
    words = [f"t{i}" for i in range(1000)]
    other = [f"u{i}" for i in range(1000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:901] + [f"x{i}" for i in range(99)])),
            (3, " ".join(other)), (4, " ".join(other[:877] + [f"y{i}" for i in range(123)]))]
    sets = {i: shingles(t) for i, t in rows}
    alike = [len(sets[a] & sets[a + 1]) / len(sets[a] | sets[a + 1]) for a in (1, 3)]
    assert 0.81 < alike[0] < 0.83 and 0.77 < alike[1] < 0.79
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near(spark, frame, SF).collect()} == {1, 3, 4}


def test_written_shards_hold_every_row_once(spark, docs, tmp_dir):
    rows = docs.select("doc_id", "text", F.octet_length("text").alias("n_bytes"))
    out = sharding.assign_shards(rows, limit=20_000)
    sharding.write_shards(out, f"{tmp_dir}/shards")
    back = spark.read.option("basePath", f"{tmp_dir}/shards").schema("doc_id long, n_bytes long, shard_id string").parquet(f"{tmp_dir}/shards")
    assert sorted((r.doc_id, r.n_bytes or 0, r.shard_id) for r in back.collect()) == sorted(
        (r.doc_id, r.n_bytes or 0, r.shard_id) for r in out.collect())
    assert out.select("shard_id").distinct().count() > 5


def test_null_and_repeated_ids(spark, docs):
    """Every operator on rows without an id, and with the same id: a row each, as the docstrings say."""
    text = "some words of a text that is long enough to have shingles " * 3
    rows = [(None, text), (None, "other words"), (None, None), (7, "a b"), (7, "a b"), (7, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    spm, word, byte = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")
    found = {"op1": langid.predict(df, model), "op2": lm_scoring.score_documents(df, spark.createDataFrame([(7,), (None,)], "doc_id long")),
             "op3": token_counts.token_counts(df, spm), "op4": sharding.assign_shards(df.withColumn("n_bytes", F.lit(5)), limit=8),
             "op7": packing.pack(df, word), "op8": exact_dedup.exact_dedup(df), "op9": bpe.encode_digests(df, byte, P.PATTERN)}
    for name, out in found.items():
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert (ids.count(None), ids.count(7)) == (3, 3), name
