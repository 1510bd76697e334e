"""Clustering, hard negatives and top-k search against brute force, on odd rows and through many cells of the grid."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from wardline.llm import centroids, common, embeddings, negatives, queries, tiles, topk

VEC = "vec_id long, embedding array<double>, label int"
SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def whole(v, scale):
    return tuple(int(np.floor(scale * x)) for x in v)


def inner(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def brute_top(table, k=20, every=20):
    kept = [(i, whole(v, 64)) for i, v, _ in table if i is not None and usable(v)]
    out = []
    for n, (i, q) in enumerate(kept):
        if i % every == 0:
            scored = sorted((-inner(q, x), j) for m, (j, x) in enumerate(kept) if m != n and len(x) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out, key=repr)


def brute_negatives(table, every=100):
    kept = [(i, whole(v, 256), (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in table if i is not None and label is not None and usable(v)]
    out = []
    for n, (i, a, label) in enumerate(kept):
        if i % every:
            continue
        scored = sorted((-inner(a, x), j, other) for m, (j, x, other) in enumerate(kept) if m != n and len(x) == len(a))
        for p, pid, _ in [s for s in scored if s[2] == label][:5]:
            fits = [(s, j) for s, j, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(i, pid, r, j, -p, -s) for r, (s, j) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def brute_clusters(table, k=16, rounds=3, dim=64):
    kept = [(i, whole(v, 64)) for i, v, _ in table if usable(v) and len(v) == dim]
    start = sorted(((hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "~"), x) for i, x in kept)[:k]
    centres = [x for _, x in start]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        near = [min((far(x, c), j) for j, c in enumerate(centres)) for _, x in kept]
        if r < rounds:
            for j in range(len(centres)):
                mine = [x for (_, x), (_, c) in zip(kept, near, strict=True) if c == j]
                if mine:
                    centres[j] = tuple(sum(v) // len(mine) for v in zip(*mine, strict=True))
    each = Counter()
    for d, j in near:
        each[j] += d
    signs = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, each[j], sum(each.values()), signs[j]) for (i, _), (d, j) in zip(kept, near, strict=True)), key=repr)


def odd_table(seed, n=400, dim=64):
    """Clusters, a vector that a third of the rows are, repeated rows and ids, ties, nulls, other lengths, empty and zero vectors."""
    rnd = random.Random(seed)
    heads = [[rnd.gauss(0, 0.3) for _ in range(dim)] for _ in range(6)]
    hot = [rnd.gauss(0, 0.3) for _ in range(dim)]
    out = []
    for i in range(n):
        v = hot if i % 3 == 0 else [x + rnd.gauss(0, 0.1) for x in rnd.choice(heads)]
        out.append((i, v, rnd.choice([0, 1, 1, 2, 9])))
    out += [out[0], out[100], out[100], (200, heads[0], 3), (200, heads[1], 3), (7, [1.0] * dim, 1)]
    out += [(None, heads[2], 1), (300, None, 1), (400, [None] + [0.5] * (dim - 1), 2), (500, [float("nan")] * dim, 2), (600, [float("inf")] * dim, 2), (700, [0.0] * dim, 2)]
    out += [(800, [0.25, -0.5], 1), (801, [0.5, -0.25], 1), (802, [0.5, 0.75], 2), (900, [], 0), (901, [], 0), (1000, heads[3], None), (1100, [-40000.5] * dim, 4), (1101, [30000.25] * dim, 4)]
    return out


@pytest.fixture
def many_cells(monkeypatch):
    """Grids of many groups and columns, and lists that are merged by two."""
    monkeypatch.setattr(tiles, "GROUP", 300)
    monkeypatch.setattr(tiles, "COLUMN", 2000)
    monkeypatch.setattr(tiles, "FAN", 2)


def test_op13_equals_brute_force(spark, many_cells):
    table = odd_table(1)
    frame = spark.createDataFrame(table, VEC).repartition(9)
    assert rows(topk.search(frame)) == brute_top(table)


def test_op12_equals_brute_force(spark, many_cells):
    table = odd_table(2)
    frame = spark.createDataFrame(table, VEC).repartition(9)
    got = rows(negatives.mine(frame, every=10))
    assert got == brute_negatives(table, every=10) and len(got) > 500


def test_op11_equals_brute_force(spark):
    table = [r for r in odd_table(3)]
    frame = spark.createDataFrame(table, VEC).repartition(5)
    got = rows(centroids.cluster_vectors(frame))
    assert got == brute_clusters(table) and len({r[1] for r in got}) > 5


def test_op11_to_op13_on_the_table(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert rows(queries.op13_topk_search(spark, SF)) == brute_top(table)
    assert rows(queries.op12_hard_negatives(spark, SF)) == brute_negatives(table)
    assert rows(queries.op11_exponion(spark, SF)) == brute_clusters(table)


def test_vector_operators_on_empty_and_clashing_tables(spark):
    table = odd_table(4, 120)
    clash = "vec_id long, embedding array<double>, label int, tile string, c string, x string, cluster string, `a.b` int, `__salt` int"
    frame = spark.createDataFrame([(*r, "t", "c", "x", "y", 1, 2) for r in table], clash)
    assert rows(topk.search(frame)) == brute_top(table)
    assert rows(negatives.mine(frame, every=20)) == brute_negatives(table, every=20)
    assert rows(centroids.cluster_vectors(frame)) == brute_clusters(table)
    for empty in (frame.limit(0), frame.where("embedding is null"), frame.where("vec_id = 7")):
        assert topk.search(empty).count() == negatives.mine(empty).count() == 0
    assert centroids.cluster_vectors(frame.limit(0)).count() == 0
    few = table[:5] + [table[1]]  # fewer vectors than clusters
    assert rows(centroids.cluster_vectors(spark.createDataFrame(few, VEC))) == brute_clusters(few)


def test_exponion_looks_at_few_centroids_and_keeps_ties():
    rnd = np.random.default_rng(5)
    heads = rnd.integers(-300, 300, (64, 8))
    x = heads[rnd.integers(0, 64, 3000)] + rnd.integers(-6, 7, (3000, 8))
    old = heads + rnd.integers(-3, 4, heads.shape)
    old[7] = old[9]  # two equal centroids: all of their vectors go to the first
    new = old + rnd.integers(-2, 3, heads.shape)
    new[7] = new[9]
    near, d, second = centroids.two_nearest(x, old, np.arange(64))
    far, others = centroids.moved(old, new)
    got, upper, lower, exact, taken = centroids.Ball(new).assign(x, near, np.sqrt(d) + far[near], np.maximum(np.sqrt(second) - others[near], 0))
    want, best, runner_up = centroids.two_nearest(x, new, np.arange(64))
    assert (got == want).all() and (exact == best).all()
    assert (upper >= np.sqrt(best) - 1e-6).all() and (lower <= np.sqrt(runner_up) + 1e-6).all()
    assert taken < 3000 * 64 / 4


def test_pivots_bracket_every_score_and_leave_rows_out():
    rnd = np.random.default_rng(6)
    heads = rnd.integers(-60, 60, (10, 64))
    x = np.repeat(heads, 200, axis=0) + rnd.integers(-8, 9, (2000, 64))
    most = int((x.astype(float) ** 2).sum(axis=1).max()) + 1
    pivots = negatives.far_apart(negatives.lifted(x[::5], most), 16)
    near = negatives.distances(negatives.lifted(x, most), pivots).astype(np.float32)
    anchors, at = x[::50], np.arange(40)
    b = negatives.Brackets(anchors, pivots, most)
    scores = anchors @ x.T
    least, top = b.of_rows(at, near)
    assert (least <= scores).all() and (scores <= top).all()
    tile_least, tile_top = b.of_tile(at, near[:200])
    assert (tile_least <= scores[:, :200].min(axis=1)).all() and (scores[:, :200].max(axis=1) <= tile_top).all()
    tenth = np.sort(scores, axis=1)[:, -10][:, None]
    assert (top < tenth).mean() > 0.5  # so many rows need no product


def test_windows_are_exact():
    p = np.array([0, 1, 10, 33, 99, 100, 101, 12345, -1, -100, 2**61, tiles.NO_SCORE])
    low, high = negatives.windows(p)
    for s, a, b in zip(p[:-1].tolist(), low.tolist(), high.tolist(), strict=False):
        assert (a, b) == (-((-30 * s) // 100), (90 * s) // 100)
    assert low[-1] > high[-1]


def test_scores_beyond_a_long_are_an_error(spark):
    frame = spark.createDataFrame([(0, [1e15, 1.0], 1), (1, [1e15, 2.0], 1)], VEC)
    with pytest.raises(Exception, match="leave the long"):
        topk.search(frame).collect()
    with pytest.raises(Exception, match="components of"):
        centroids.cluster_vectors(spark.createDataFrame([(0, [1e15] * 64, 1)], VEC)).collect()


def test_op3_keeps_links_of_vectors_whose_ids_repeat(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(5, 6))
    made = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0])]
    made += [(int(rng.integers(10, 40)), (base[rng.integers(0, 5)] + rng.normal(size=6) * 0.15).tolist()) for _ in range(150)]
    made += [made[10], made[10], (50, made[20][1]), (10, [0.0] * 6), (None, made[20][1])]
    frame = spark.createDataFrame([(*r, "x") for r in made], "vec_id long, embedding array<double>, cls string")
    good = [i is not None and any(v) for i, v in made]
    unit = [np.array(v) / np.linalg.norm(v) if g else None for g, (_, v) in zip(good, made, strict=True)]
    near = [[j for j in range(len(made)) if j != i and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95] for i in range(len(made))]
    least = [i for i, _ in made]
    for _ in made:
        least = [min([least[i], *(least[j] for j in near[i])]) if near[i] else least[i] for i in range(len(made))]
    want = sorted(((i, len(near[n]), least[n], i is None or i == least[n]) for n, (i, _) in enumerate(made)), key=repr)
    assert rows(embeddings.near_duplicates(frame)) == want


def brute_near(made):
    """Rows of near_duplicates() for rows (id, vector), whose ids and vectors may repeat."""
    good = [i is not None and usable(v) and any(v) for i, v in made]
    unit = [np.array(v) / np.linalg.norm(v) if g else None for g, (_, v) in zip(good, made, strict=True)]
    near = [[j for j in range(len(made)) if j != i and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95] for i in range(len(made))]
    least, before = [i for i, _ in made], None
    while least != before:
        before = least
        least = [min([least[i], *(least[j] for j in near[i])]) if near[i] else least[i] for i in range(len(made))]
    return sorted(((i, len(near[n]), least[n], i is None or i == least[n]) for n, (i, _) in enumerate(made)), key=repr)


def stages(spark):
    """Bytes that each stage so far has shuffled or written, by its number."""
    sc = spark.sparkContext
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    each = [found.apply(k) for k in range(found.size())]
    return {s.stageId(): s.shuffleWriteBytes() + s.outputBytes() for s in each}


def test_op3_moves_and_writes_as_much_as_it_has_vectors(spark, monkeypatch, tmp_path):
    """Pairs of tiles grow with the square of the vectors; copied for each pair, these 0.8 MB became more than 100 MB."""
    monkeypatch.setattr(embeddings, "TILE", 50)
    base = np.random.default_rng(11).normal(size=(1600, 128)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/vectors")
    before = max(stages(spark))
    assert embeddings.near_duplicates(spark.read.parquet(f"{tmp_path}/vectors")).where("n_links > 0 or component_id <> vec_id").count() == 0
    assert base.nbytes < sum(n for k, n in stages(spark).items() if k > before) < 4 * base.nbytes


def test_op3_over_many_tiles_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    monkeypatch.setattr(embeddings, "EDGES", 20)  # edges are reduced on the way
    rng = np.random.default_rng(12)
    base = {n: rng.normal(size=(6, n)) for n in (1, 3, 8)}
    made = []
    for i in range(400):  # some vectors are the same as float32, the others aren't
        n = int(rng.choice([1, 3, 8, 8, 8]))
        v = base[n][rng.integers(0, 6)] + rng.normal(size=n) * 0.12
        made.append((int(rng.integers(0, 900)), (v.astype(np.float32).astype(float) if i % 2 else v).tolist()))
    made += [made[int(k)] for k in rng.integers(0, 400, 30)] + [(900 + k, made[7][1]) for k in range(80)]  # copies with their ids and without
    made += [(1000, [0.0, 1.0, 0.0]), (1001, [-0.0, 1.0, -0.0]), (1002, [0.0] * 3), (1003, []), (1004, None), (1005, [1.0, float("nan"), 2.0]), (None, made[7][1]), (None, None)]
    made = [made[int(k)] for k in rng.permutation(len(made))]
    frame = spark.createDataFrame(made, "vec_id long, embedding array<double>").repartition(5)
    assert rows(embeddings.near_duplicates(frame)) == brute_near(made)


def test_op3_forest_spans():
    rng = np.random.default_rng(13)
    for n, m in ((10, 5), (200, 150), (200, 900), (500, 499)):
        u, v = rng.integers(0, n, m) * 7, rng.integers(0, n, m) * 7
        if n == 500:
            u, v = np.arange(499) * 7, np.arange(1, 500) * 7  # a chain
        least = dict.fromkeys([*u.tolist(), *v.tolist()])
        least = {i: i for i in least}
        for _ in range(n):
            for a, b in zip(u.tolist(), v.tolist(), strict=True):
                least[a] = least[b] = min(least[a], least[b])
        ids, roots = embeddings._forest(u, v)
        assert dict(zip(ids.tolist(), roots.tolist(), strict=True)) == {i: k for i, k in least.items() if i != k}
