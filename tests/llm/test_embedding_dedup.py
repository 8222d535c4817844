import numpy as np

from folio.llm import embedding_dedup as e


def brute(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) by all pairs."""
    n = len(rows)
    good = np.zeros((n, n), bool)
    valid = [i is not None and v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for i, v in rows]
    for p in range(n):
        for q in range(p):
            if valid[p] and valid[q] and len(rows[p][1]) == len(rows[q][1]):
                x, y = (np.array(rows[k][1], np.float64) for k in (p, q))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                good[p, q] = good[q, p] = x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine
    at = {i: i for i, _ in rows}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for p, q in zip(*np.nonzero(good), strict=True):
        a, b = root(rows[p][0]), root(rows[q][0])
        at[max(a, b)] = min(a, b)
    return sorted(((i, int(good[p].sum()), None if i is None else root(i), i is None or root(i) == i) for p, (i, _) in enumerate(rows)), key=str)


def groups(rng, n, dim, copies, noise):
    out = []
    for k in copies:
        centre = rng.standard_normal(dim)
        centre /= np.linalg.norm(centre)
        out += [centre + noise * rng.standard_normal(dim) / np.sqrt(dim) for _ in range(k)]
    return out + list(rng.standard_normal((n, dim)))


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in rows], f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 AS label", "2 AS cell", "3 AS n")


def test_groups_copies_and_odd_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    some = [np.float32(v) for v in groups(rng, 150, 16, [60, 5, 2, 2], 0.1)]
    some += [some[3] * 4, some[3], some[3], -some[3], some[150], some[0][:8], some[1][:8], some[2][:7]]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [-0.0] * 15 + [1.0], [0.0] * 15 + [2.0], [1.0], [3.0]]
    rows = [(k * 7 % 1009, v) for k, v in enumerate([*some, *odd])]
    rows += [(None, some[3]), (None, None), (rows[0][0], some[200]), (rows[5][0], some[5])]
    got = sorted((tuple(r) for r in e.near_embeddings(frame(spark, rows), recall=1.0).collect()), key=str)
    assert got == brute(rows)


def test_blocks_and_heavy_groups_give_the_same(spark):
    rng = np.random.default_rng(2)
    rows = list(enumerate(groups(rng, 100, 8, [120, 40, 9], 0.25)))
    want = brute(rows)
    for block, per_cell in ((10, 40), (2000, 512)):
        df = e.near_embeddings(frame(spark, rows, "double"), recall=1.0, per_cell=per_cell, block=block)
        assert sorted((tuple(r) for r in df.collect()), key=str) == want
    assert sum(w[1] for w in want) > 120 * 100


def test_recall_of_links_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.standard_normal((2000, 64))
    z -= (z * x).sum(axis=1)[:, None] * x
    y = 0.9001 * x + np.sqrt(1 - 0.9001**2) * z / np.linalg.norm(z, axis=1)[:, None]
    rows = list(enumerate([*x, *y]))
    got = {r.vec_id: r for r in e.near_embeddings(frame(spark, rows, "double"), per_cell=40).collect()}
    right = sum(got[2000 + k].component_id == k for k in range(2000))
    assert right >= 0.95 * 2000 and all(r.n_links <= 1 for r in got.values())


def test_visits_are_the_nearest_cells():
    rng = np.random.default_rng(4)
    x = e._unit(rng.standard_normal((500, 10)))
    index = e.fit(x, np.full(500, 10), 5000, per_cell=20)
    index.visits = 9
    left, right = index._halves(x)
    sums = (left[:, :, None] + right[:, None, :]).reshape(len(x), -1)
    got = np.take_along_axis(sums, index.cells(x), 1)
    assert np.allclose(got, np.sort(sums, axis=1)[:, :9]) and len(index.books[0]) == 16


def test_empty_tables(spark):
    none = frame(spark, [(1, [1.0])]).where("false")
    assert e.near_embeddings(none).count() == 0
    assert [tuple(r) for r in e.near_embeddings(frame(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]
