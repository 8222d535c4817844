import random
import re

import numpy as np

from folio.llm import components, near_dedup


def sets_of(docs, k):
    out = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute(docs, k, similarity=80):
    sets = sets_of(docs, k)
    ids = [i for i, _ in docs]
    at = {}
    for i in ids:
        at.setdefault(i, i)

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for p, x in enumerate(sets):
        for q in range(p):
            y = sets[q]
            if ids[p] is not None and ids[q] is not None and x and y and 100 * len(x & y) >= similarity * len(x | y):
                a, b = root(ids[p]), root(ids[q])
                at[max(a, b)] = min(a, b)
    return sorted(((i, len(s), None if i is None else root(i), i is None or root(i) == i) for (i, _), s in zip(docs, sets, strict=True)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(900)}" for _ in range(n)]
    docs = []
    for f in range(14):
        base = text(rng.choice([3, 9, 40, 150, 400]))
        for _ in range(rng.choice([1, 2, 5, 30])):
            w = base[:]
            for _ in range(rng.randrange(1 + len(w) // 12)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(900)}"
            docs.append((" " if f % 2 else "\n").join(w))
    passage = text(80)
    docs += [" ".join(passage + text(60)) for _ in range(40)]
    docs += ["One two three", "one TWO three", "one two", "É a b c", "é a b c", "", None, docs[0].upper(), docs[5], docs[5]]
    rng.shuffle(docs)
    return [(i * 3 + 1, t) for i, t in enumerate(docs)] + [(None, docs[5]), (28, docs[9])]


def test_near_duplicates_against_brute_force(spark):
    for seed, k, rounds in ((1, 4, 3), (2, 5, 0)):
        docs = corpus(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS n")
        got = [tuple(r) for r in near_dedup.near_duplicates(df, k, pivot_rounds=rounds).collect()]
        want = brute(docs, k)
        if seed == 1:
            assert len({c for _, _, c, _ in want}) < len(docs) - 60
        assert sorted(got, key=str) == want
    assert near_dedup.near_duplicates(df.where("false")).count() == 0


def test_blocks_find_every_link_between_components(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "COLUMNS", 50)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 90, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 90 - k % 30, replace=False), rng.integers(0, 1 << 62, k % 17, dtype=np.uint64)])) for k in range(120)]
    rows = [(k, k % 2, k, len(x), x.tobytes()) for k, x in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node long, cluster long, component long, n long, held binary")
    got = {tuple(sorted(r)) for r in near_dedup._links_within(nodes, 80, block=7).collect()}
    both = lambda x, y: len(np.intersect1d(x, y))
    want = {(a, b) for a in range(120) for b in range(a + 2, 120, 2) if 100 * both(sets[a], sets[b]) >= 80 * (len(sets[a]) + len(sets[b]) - both(sets[a], sets[b]))}
    assert got == want and 50 < len(want) < 3000


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 120)] + [(7, 7), (None, 3), (200, 150), (150, 175)]
    df = spark.createDataFrame(links, "a long, b long")
    want = {k: 0 for k in range(51)} | {k: 100 for k in range(100, 120)} | {150: 150, 175: 150, 200: 150}
    for small in (components.SMALL, 0):  # in one task, and in rounds
        got = [tuple(r) for r in components.connected_components(df.repartition(7), small).collect()]
        assert dict(got) == want and len(got) == len(want)
        assert components.connected_components(df.where("false"), small).count() == 0
    rng = np.random.default_rng(9)
    ends = rng.integers(0, 900, (600, 2))
    df = spark.createDataFrame([tuple(map(int, e)) for e in ends], "a long, b long").repartition(5)
    one, many = ({tuple(r) for r in components.connected_components(df, small).collect()} for small in (10_000, 0))
    assert one == many and len({c for _, c in one}) > 50
