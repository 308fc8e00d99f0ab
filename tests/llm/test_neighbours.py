import numpy as np
import pytest

from tessella.llm import neighbours as nn


def brute(rows, k=5):
    fine = [(i, np.array(v, float)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = []
    for a, (i, q) in enumerate(fine):
        if i is None or i % 50:
            continue
        near = [(-float((q * v).sum() / (np.sqrt((v * v).sum()) * np.sqrt((q * q).sum()))), j is None, j, b) for b, (j, v) in enumerate(fine) if b != a and len(v) == len(q)]
        near.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(i, r + 1, x[2], -x[0]) for r, x in enumerate(near[:k])]
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, v and [c if c is None else float(c) for c in v], 0) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    return sorted(map(tuple, nn.search(df, df.where("vec_id % 50 = 0")).collect()), key=str)


def test_recall_and_scores(spark):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(20, 32))
    x = (centres[rnd.integers(20, size=3000)] + rnd.normal(size=(3000, 32)) * 0.6).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = run(spark, rows), brute(rows)
    hit = {(q, v): s for q, _, v, s in got}
    both = [(hit[q, v], s) for q, _, v, s in want if (q, v) in hit]
    assert len(got) == len(want) and len(both) >= 0.97 * len(want)
    assert all(a == pytest.approx(b, abs=1e-12) for a, b in both)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0, 0]), (1, [1.0, 0, 0]), (2, [2.0, 0, 0]), (3, None), (4, [0.0, 0, 0]), (5, [float("nan"), 1, 1]), (6, [None, 1.0, 1.0]), (7, [float("inf"), 0, 0]), (50, [0.0, 1, 0]), (50, [0.0, 1, 0]), (None, [1.0, 0, 0]), (100, [1.0, 1.0]), (8, [0.5, 0.5])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(3, [1.0, 2.0])]) == [] and run(spark, [(50, [1.0, 2.0])]) == []


def test_many_equal_vectors_give_the_smallest_ids(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(1, 900)] + [(900 + i, [float(i % 7), 1.0, 0.0, 2.0]) for i in range(300)]
    got = [r for r in run(spark, rows) if r[0] == 850]
    assert sorted((r[1], r[2]) for r in got) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]


def test_anisotropic_codes_lower_the_parallel_error():
    rnd = np.random.default_rng(2)
    x = nn._units(rnd.normal(size=(2000, 32)))

    def parallel(threshold):
        book = nn.fit(x, nn.Settings(threshold=threshold))
        codes = book.codes(x)
        back = np.stack([book.centres[s][codes[:, s]] for s in range(16)], 1).reshape(len(x), -1)
        return (((x - back) * x).sum(1) ** 2).mean()

    assert parallel(0.3) < 0.5 * parallel(0.0)


@pytest.mark.parametrize("noise", [0.01, 0.05, 0.2])
def test_recall_among_thousands_of_near_copies(spark, noise):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(6000, 64))
    x[::2] = rnd.normal(size=64) + rnd.normal(size=(3000, 64)) * noise
    x = x.astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = {}
    for r in nn.search(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    x = x.astype(float)
    for i in range(0, 6000, 50):
        order = np.lexsort((np.arange(6000), -nn._cosines(x, x[i])))
        assert sorted(got[i]) == [(r + 1, j) for r, j in enumerate([j for j in order if j != i][:5])]


def test_bounds_hold_for_every_row():
    rnd = np.random.default_rng(6)
    for dims in (7, 64):
        x = nn._units(np.concatenate([rnd.normal(size=(800, dims)), 1 + rnd.normal(size=(800, dims)) * 0.02]))
        book = nn.fit(x)
        ids = list(range(len(x)))
        narrow = nn.Settings(rerank=6)
        found = nn.Block(book, ids, x, narrow).search([(i, 0) for i in ids[::40]], x[::40])
        for i in ids[::40]:
            order = np.lexsort((ids, -nn._cosines(x, x[i])))[:6]
            assert [f[2] for f in found if f[0] == i] == order.tolist()


def test_huge_and_tiny_components(spark):
    rows = [(0, [1e200, 2e200, 3e200]), (1, [1.0, 2.0, 3.1]), (2, [3e-200, 2e-200, 1e-200]), (3, [1e-310, 2e-310, 3e-310]), (4, [1e308, -1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, nn.search(df, df.where("vec_id % 50 = 0")).collect()))
    assert [r[2] for r in got] == [3, 1, 2, 4]
    q = np.array([1.0, 2, 3]) / np.sqrt(14)
    want = [1.0] + [float(np.array(v) @ q / np.sqrt(np.array(v) @ np.array(v))) for v in ([1.0, 2, 3.1], [3.0, 2, 1], [1.0, -1, 1])]
    assert [r[3] for r in got] == pytest.approx(want, abs=1e-9)


def test_many_vectors_under_one_id_and_many_blocks(spark):
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(700, 6)).astype(np.float32)
    rows = [(50 if i % 2 else i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, nn.search(df, df.where("vec_id % 50 = 0"), nn.Settings(block=40, rerank=8)).collect()))
    assert [r[:3] for r in got] == [r[:3] for r in sorted(brute(rows))]


@pytest.mark.parametrize("noise", [0.05, 3.0])
def test_cells_lose_no_neighbour_and_spare_most_blocks_of_clusters(spark, noise, monkeypatch):
    """Clustered and unclustered rows over many cells, one cell with a third of all rows, against brute force."""
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(30, 16))
    own = np.where(rnd.random(4000) < 0.33, 0, rnd.integers(30, size=4000))
    x = (centres[own] + rnd.normal(size=(4000, 16)) * noise).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, nn.search(df, df.where("vec_id % 50 = 0"), nn.Settings(block=300, least=100, rerank=16)).collect()))
    assert [r[:3] for r in got] == [r[:3] for r in sorted(brute(rows))]
    units = nn._units(x.astype(float))
    laid = nn.cells(units[:2000], 40)
    cell, cos = laid.nearest(units)
    narrowest = np.array([cos[cell == c].min(initial=1.0) for c in range(len(laid.centres))])
    share = np.mean([len(r) for r in laid.reached(units[::50], narrowest, 5)]) / len(laid.centres)
    assert share < 0.1 if noise < 1 else share > 0.5
