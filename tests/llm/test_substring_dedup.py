import random
import re
from collections import Counter

import numpy as np

from folio.llm import substring_dedup as sd
from folio.llm.words import words_of


def brute(docs, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    count = Counter(tuple(w[p : p + window]) for w in split for p in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(docs, split, strict=True):
        gone = {k for p in range(len(w) - window + 1) if count[tuple(w[p : p + window])] > 1 for k in range(p, p + window)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def corpus(seed, vocabulary=400):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["the", "of", "a"]) if rng.random() < 0.4 else f"w{rng.randrange(vocabulary)}" for _ in range(n))
    passages = [text(n) for n in (20, 34, 35, 36, 40, 60, 100, 300, 900)]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), text(rng.randint(0, 60))]
        docs.append((i, (" \n" if i % 3 else "\t").join(parts)))
    near = text(1500).split()
    for i in range(60, 66):
        w = near[:]
        for _ in range(i - 60):
            w[rng.randrange(len(w))] = "edit"
        docs.append((i, " ".join(w)))
    return docs + [(70, None), (71, ""), (72, "x " * 400), (73, "x " * 90 + "y " * 34), (74, "a b c " * 60), (75, docs[3][1]), (75, docs[3][1]), (None, docs[4][1]), (76, "l" * 3000 + " " + passages[5])]


def test_repeated_words_against_brute_force(spark):
    for seed, window, chunk, bucket in ((1, 35, 3_000_000, 600_000), (2, 35, 3000, 300), (3, 12, 5000, 1000)):
        docs = corpus(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS chunk", "2 AS kept")
        got = [tuple(r) for r in sd.repeated_words(df, window, chunk, bucket).collect()]
        assert sorted(got, key=str) == brute(docs, window), (seed, window)
    assert sd.repeated_words(df.where("false")).count() == 0


def test_symbols_of_equal_windows_are_equal():
    """What a window surely holds is the same wherever its words occur."""
    rng = random.Random(9)
    for _ in range(40):
        texts = [t.encode() for _, t in corpus(rng.randrange(10**6), 30)[:30] if t]
        words = words_of(texts)
        p = sd.parse(words)
        symbols = np.zeros(p.n_symbols, object)
        symbols[p.small_at] = p.small
        seen = {}
        for at in np.flatnonzero(sd._window_starts(words, sd.WINDOW)):
            key = words.hashes[at : at + sd.WINDOW].tobytes()
            held = tuple(symbols[p.first[at] : p.last[at]]) if p.first[at] < p.last[at] else ()
            assert seen.setdefault(key, held) == held
