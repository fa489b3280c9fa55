"""Sharding, ranked lexical search and whitening: against plain brute force, and by their defined results."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries, sharding, tiered, whitening

# Sharding


def check_shards(rows, docs, shards, slack):
    """Rows (doc_id, size, text_crc32, shard, slot) of `docs` ((doc_id, text), repeats and all) are dealt to near equal sizes."""
    wanted = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == wanted
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    assert set(slots) <= set(range(shards))
    share, most = sum(sizes.values()) / shards, max(s for _, s, _ in wanted)
    # Each end of a shard is at the nearest row to its share, or within the tolerance.
    assert all(abs(sizes[s] - share) <= max(most, 2 * slack * share) + 1 for s in range(shards))


def test_shards_are_near_equal_with_hot_copies_and_long_texts(spark):
    rng = random.Random(1)
    docs = [(i, "".join(rng.choice("abcé ") for _ in range(rng.choice((0, 3, 50, 900))))) for i in range(1500)]
    docs += [(i, "one text that a third of all rows repeat") for i in range(5000, 5800)] + [(None, "x" * 300)] * 200 + [(9000, None), (9001, ""), (9002, "z" * 30_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    for shards, tolerance in ((40, 0.001), (3, 0.0), (5, 0.2)):
        rows = sharding.shard(df, shards=shards, tolerance=tolerance).collect()
        check_shards(rows, docs, shards, tolerance)
    # Equal texts have neighbouring places: no more shards than their bytes need, and one at either end.
    at = {r.shard for r in rows if r.doc_id is not None and 5000 <= r.doc_id < 5800}
    assert max(at) - min(at) + 1 == len(at)


def test_ranges_of_a_shard_count_on(spark):
    docs = [(i, "t" * (i % 97)) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = sharding.shard(df, shards=4, range_bytes=4096).collect()
    check_shards(rows, docs, 4, 0.001)
    # Places follow one order through all ranges: that of the text's hash.
    hashed = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    order = [hashed[r.doc_id] for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_splitters_are_exact_sums(spark):
    docs = [(i, "w" * (i * 7 % 501)) for i in range(3000)] + [(1, "same")] * 500
    keyed = sharding.cut(sharding._keyed(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)), "keys")
    found = sharding.Splitters(keyed, [0.25, 0.5, 0.75], [0.0] * 3)
    rows = sorted((((r._s_text + 2**63) << 128) + ((r._s_id + 2**63) << 64) + r._s_row + 2**63, r._s_size) for r in keyed.collect())
    total = sum(s for _, s in rows)
    for share, (key, size, count) in zip((0.25, 0.5, 0.75), found.cuts, strict=True):
        assert (size, count) == (sum(s for k, s in rows if k < key), sum(k < key for k, _ in rows))
        best = min(abs(sum(s for _, s in rows[:n]) - share * total) for n in range(max(0, count - 3), count + 4))
        assert abs(size - share * total) == pytest.approx(best)


def test_whole_rows_keep_their_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", i * 2, 5, "mine") for i in range(60)], "doc_id long, text string, slot long, _s_size int, `a b` string")
    got = sharding.sharded_documents(docs, shards=3)
    assert got.columns == ["doc_id", "text", "_s_size", "a b", "shard", "slot"]
    assert {(r.doc_id, r.text, r._s_size, r["a b"]) for r in got.collect()} == {(i, f"text {i}", 5, "mine") for i in range(60)}
    sharding.write_shards(docs, f"{tmp_path}/out", shards=3)
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("shard").count().count() == 3
    assert sharding.shard(docs.limit(0)).collect() == [] and sharding.sharded_documents(docs.limit(0)).columns == got.columns
    one = sharding.shard(docs.limit(1)).collect()
    assert [(r.doc_id, r.slot) for r in one] == [(docs.limit(1).first().doc_id, 0)]


def test_sharding_query(spark, sf_dir):
    got = queries.op11_histogram_sharding(spark, sf_dir)
    assert dict(got.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = got.collect()
    check_shards(rows, docs, 40, 0.001)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


# Ranked lexical search


def ranked(docs, items, k=10):
    """Plain scores of all documents, by the stated formula."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    held = [(i, Counter(ws), len(ws)) for i, t in docs if (ws := words(t))]
    n, length, df = len(held), sum(m for _, _, m in held), Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        asked, found = Counter(words(text)), []
        for i, c, m in held:
            norm = 100 - 75 + (75 * m * n) // length
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * norm)) for w, r in asked.items() if w in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def test_tiered_search_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.choice((1, 5, 40, 200)))) for i in range(900)]
    passage = text(30)
    docs += [(2000 + i, text(20) + " " + passage) for i in range(25)] + [(3000 + i, passage) for i in range(300)]
    docs += [(None, passage), (None, passage), (7, docs[7][1]), (7, docs[7][1]), (4000, None), (4001, ""), (4002, "!? \n"), (4003, "É É é ÀB_b-B 9x"), (4004, "w1 " * 50_000)]
    items = [(1, passage), (2, "w250 w251 w299"), (3, text(40)), (4, "w0 w1"), (5, "absent words"), (6, None), (7, ""), (8, "é àb B w299 w299 w299"), (9, "w1"), (9, "w1"), (None, "w120")]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    wanted = ranked(docs, items)
    for size, block in ((64, 256), (4096, 3)):
        monkeypatch.setattr(tiered, "BLOCK_DOCS", size)
        counts = {}
        got = tiered.search(tiered.build(df), asked, block=block, counts=counts)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == wanted
    assert counts["proven in tier 0"] > 0 and counts["looked up"] >= 10 * counts["proven in tier 0"]
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    few = tiered.search(tiered.build(df, shares=(0.01, 0.02, 0.3)), asked, k=3)
    assert sorted((tuple(r) for r in few.collect()), key=repr) == ranked(docs, items, 3)


def test_tiered_search_over_nothing(spark):
    none = spark.createDataFrame([(1, None), (2, " .")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert tiered.search(tiered.build(none), items).collect() == [] and tiered.search(tiered.build(none.limit(0)), items).collect() == []
    some = spark.createDataFrame([(1, "a a", "x", 3), (2, "b", "y", 4)], "doc_id long, text string, block string, score int")
    assert tiered.search(tiered.build(some), items.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in tiered.search(tiered.build(some), items).collect()] == [(1, 1, 1)]


# Whitening


def plain_whitening(rows, k=8):
    """By numpy's own eigenvalues."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    off = n * x - s
    c = (off / n).astype(float)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:k]
    z = c @ vectors[:, order] / np.sqrt(values[order])
    return n, (off * off).sum(axis=1), z, values[order] / np.trace(c.T @ c / n)


def check_whitening(got, rows, k=8):
    n, deviation, z, explained = plain_whitening(rows, k)
    k = z.shape[1]
    table = defaultdict(dict)
    for r in got:
        table[r.vec_id][r.component] = r
    assert len(got) == len(rows) * k
    mine = np.array([[table[i][c + 1].whitened for c in range(k)] for i, _ in rows])
    signs = np.sign((mine * z).sum(axis=0))
    assert np.abs(mine - signs * z).max() < 1e-6
    for (i, _), d in zip(rows, deviation, strict=True):
        own = table[i][1]
        assert own.n == n and own.deviation == d and own.identity_error < 1e-9
    for c in range(k):
        assert table[rows[0][0]][c + 1].explained == pytest.approx(explained[c], rel=1e-9)


def test_whitening_equals_plain_eigenvectors(spark):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(12, 12)) * np.logspace(0, -2, 12)
    rows = [(i, (rng.normal(size=12) @ mix).tolist()) for i in range(700)]
    odd = [(9000, None), (9001, [1.0, None] + [0.0] * 10), (9002, [float("nan")] * 12), (9003, [float("inf")] * 12), (9004, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id long, embedding array<double>, n int").repartition(5)
    check_whitening(whitening.whiten(df).collect(), rows)
    check_whitening(whitening.whiten(df, components=3).collect(), rows, 3)
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.where("vec_id >= 9000")).collect() == []


def test_whitening_of_odd_tables(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(one).collect()] == [(c, 1, 0, None, None, None) for c in (1, 2)]
    # Rank 1, two lengths, null and repeated ids, entries beyond a long.
    rows = [(None, [1.0, 1.0]), (3, [2.0, 2.0]), (3, [2.0, 2.0]), (4, [5.0]), (5, [7.0]), (6, [1e300, 1.0, 2.0]), (7, [-1e300, 2.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter(r.vec_id for r in got) == {None: 2, 3: 4, 4: 1, 5: 1, 6: 3, 7: 3}
    pairs = [r for r in got if r.vec_id in (None, 3)]
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-9 and r.n == 3 for r in pairs)
    assert {r.deviation for r in got if r.vec_id in (6, 7)} == {None}
    assert sorted(round(r.whitened, 9) for r in got if r.vec_id in (4, 5)) == [-1, 1]


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_jacobi_finds_small_eigenvalues(d):
    rng = np.random.default_rng(d)
    # Graded: a relative test keeps the digits of the least eigenvalue, which 1e16 times smaller ones than the largest have.
    scale = np.logspace(0, -8, d)
    base = rng.normal(size=(5 * d, d))
    a = scale[:, None] * (base.T @ base) * scale
    values, vectors = whitening.jacobi(a)
    assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-12) and np.all(np.diff(values) <= 0)
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * values[0]
    exact = np.linalg.svd(base * scale, compute_uv=False) ** 2
    least = np.sort(1 / np.linalg.svd(np.linalg.inv(np.linalg.qr(base)[1]) / scale[:, None], compute_uv=False) ** 2)[0] if d > 1 else exact[0]
    assert values[-1] == pytest.approx(least, rel=1e-6)


def test_whitening_query(spark, sf_dir):
    got = queries.op13_jacobi_whitening(spark, sf_dir)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    check_whitening(got.collect(), rows)
