import random
from collections import Counter

import numpy as np

from folio.llm import decontam


def brute(doc, items):
    """Items that reach the threshold and the overlaps in some passage of ``doc``: plain BM25, every item scored."""
    words = {i: decontam.terms_of(t) for i, t in items if decontam.terms_of(t)}
    df = Counter(t for w in words.values() for t in set(w))
    mean = np.mean([len(w) for w in words.values()])
    size = max(8, max(map(len, words.values())))
    own = decontam.terms_of(doc)
    out = set()
    for start in range(0, max(1, len(own)), size):
        passage = own[start : start + 2 * size]
        for i, w in words.items():
            weight = {t: np.log1p((len(words) - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in w}
            if sum(x for t, x in weight.items() if t in passage) < 0.6 * sum(weight.values()):
                continue
            ok = True
            for part in (w[: len(w) // 2], w[len(w) // 2 :]):
                n = min(3, len(part))
                want = {tuple(part[k : k + n]) for k in range(len(part) - n + 1)} if part else set()
                have = {tuple(passage[k : k + n]) for k in range(len(passage) - n + 1)}
                ok &= not want or len(want & have) >= 0.6 * len(want)
            if ok:
                out.add(i)
    return sorted(out)


def corpus():
    rng = random.Random(3)
    vocabulary = ["the", "of", "and"] * 20 + [f"w{k}" for k in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(5, 40))) for i in range(60)] + [(60, ""), (61, None), (62, "word"), (None, "no id here at all")]
    docs = [(i, text(rng.randint(0, 200))) for i in range(40)]
    for k in range(40, 90):
        i, t = items[rng.randrange(60)]
        w = t.split()
        for _ in range(rng.randint(0, len(w) // 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append((k, f"{text(rng.randint(0, 90))} {' '.join(w).upper() if k % 3 else ' '.join(w)}!! {text(rng.randint(0, 90))}"))
    return [*docs, (90, None), (91, ""), (None, items[3][1]), (92, items[4][1]), (92, items[4][1]), (93, text(30000) + " " + items[5][1])], items


def test_leaks_against_brute_force(spark):
    docs, items = corpus()
    named = [(i, t or "") for i, t in items if i is not None]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS row")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i, brute(t or "", named)) for i, t in docs), key=str)
    assert sum(len(x[1]) > 0 for x in want) > 25
    got = decontam.leaks(df, bench).collect()
    assert sorted(((r.doc_id, r.item_ids) for r in got), key=str) == want
    assert all(r.contaminated == bool(r.item_ids) and r.n_items == len(r.item_ids) for r in got)
    for index_items in (5, 17):  # several indexes, the same result
        got = decontam.leaks(df, bench, index_items=index_items).collect()
        assert sorted(((r.doc_id, r.item_ids) for r in got), key=str) == want
    assert not any(r.contaminated for r in decontam.leaks(df, bench.where("false")).collect())
    assert decontam.leaks(df.where("false"), bench).count() == 0


def indexed(items, block=4):
    cut = [(i, *decontam._halves(decontam.terms_of(t or ""))) for i, t in items if i is not None]
    df = Counter(t for _, q, a in cut for t in {*q, *a})
    return decontam.build(cut, df, len(cut), 20.0, block=block)


def by_passage(index, docs):
    rows = [np.array([index.number.get(t, -1) for t in decontam.terms_of(t or "")], np.int64) for _, t in docs]
    rows = [np.unique(r[r >= 0]) for r in rows]
    return rows, np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)


def test_few_blocks_are_left_and_the_rest_is_not_read():
    """Blocks come out if and only if their largest weights reach the threshold; of the others most postings are never read."""
    docs, items = corpus()
    for block, ranges in ((4, 8), (1, 2)):
        decontam.RANGE = ranges
        index = indexed(items, block)
        rows, passage, term = by_passage(index, docs)
        low = index.levels[0]
        want, touched = set(), set()
        for k, r in enumerate(rows):
            sums = Counter()
            for t in r.tolist():
                at = slice(*low.find(np.array([t, t]), np.array([0, low.width])))
                for place, w in zip((low.held[at] % low.width).tolist(), low.most[at].tolist(), strict=True):
                    sums[place] += w
            touched |= {(k, x) for x in sums}
            want |= {(k, x) for x, w in sums.items() if w >= 1 - 1e-9}
        for cursors in (1 << 18, 7):
            read = []
            p, b = decontam.candidates(index, passage, term, read, cursors)
            assert sorted(zip(p.tolist(), b.tolist(), strict=True)) == sorted(want)
            n_read = sum(map(len, read))
            assert n_read < sum(int(np.diff(low.find(np.array([t, t]), np.array([0, low.width])))[0]) for t in term.tolist()) / (2 if block == 1 else 1)
        assert 0 < len(want) < len(touched)
    decontam.RANGE = 8


def test_many_items_and_long_texts_in_bounded_memory():
    import tracemalloc

    rng = random.Random(11)
    words = [f"v{k}" for k in range(30_000)] + [f"c{k}" for k in range(200)] * 100
    items = [(i, " ".join(rng.choices(words, k=rng.randint(20, 60)))) for i in range(20_000)]
    index = indexed(items)
    texts = [rng.choices(words, k=n) for n in [2000] * 64 + [20_000]]
    texts[-1][7000:7000] = items[123][1].split()
    texts[3][10:10] = items[77][1].split()
    rows = [np.array([index.number.get(t, -1) for t in x], np.int64) for x in texts]
    tracemalloc.start()
    got = decontam.search(index, rows, 60)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {k: {int(index.ids[i]) for i in x} for k, x in enumerate(got) if x} == {64: {123}, 3: {77}}
    assert most < 500e6


def test_verbatim_items_of_the_tables(spark):
    d = "/root/testdata/sf0.01"
    items = {r.item_id: r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    want = {i: sorted(k for k, t in items.items() if t in text) for i, text in docs.items()}
    assert {r.doc_id: r.item_ids for r in decontam.op8(spark, d).collect()} == want
