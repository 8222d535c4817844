import hashlib
import random
import re
import zlib

import numpy as np

from folio.llm import periodic_runs as p


def runs_of(words):
    """All runs by trying every period."""
    n, by = len(words), {}
    for q in range(1, n // 2 + 1):
        k = 0
        while k + q < n:
            if words[k] != words[k + q]:
                k += 1
                continue
            s = k
            while k + q < n and words[k] == words[k + q]:
                k += 1
            if k + q - s >= max(12, 2 * q):
                by.setdefault((s, k + q - s), q)
    return sorted((s, length, q) for (s, length), q in by.items())


def collapse(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def row_of(doc_id, text):
    words = split(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        per = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % per] for i in range(n)]
    runs = runs_of(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4), sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(collapse(words, runs))))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda k: f"w{rng.randrange(k)}"
    out = ["", None, " \t\n", "a", "a " * 11, "a " * 12, "é à é\x0bé ", "x y " * 13]
    for _ in range(60):
        unit = [word(50) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 16, 31, 64, 100]))]
        times = rng.choice([1.9, 2, 2.1, 3.4, 8, 20])
        body = (unit * 21)[: int(len(unit) * times)]
        if rng.random() < 0.4:
            body[rng.randrange(len(body))] = "odd"
        out.append(" ".join([word(90) for _ in range(rng.randrange(40))] + body + [word(90) for _ in range(rng.randrange(40))]))
    fib = "a", "b"
    while len(fib[1]) < 300:
        fib = fib[1], fib[1] + fib[0]
    morse = "".join(str(bin(k).count("1") % 2) for k in range(512))
    out += [" ".join(fib[1]), " ".join(morse), " ".join(rng.choice("ab") for _ in range(400)), " ".join(("aab" * 5 + "aba" * 5) * 6), " ".join("a" * 37 + "b" + "a" * 41 + "c" + "a" * 40)]
    return out


def test_runs_of_documents_against_every_period(spark, tmp_path):
    docs = [(k * 11 + 3, t) for k, t in enumerate(corpus(1))]
    docs += [(None, docs[20][1]), (None, "b c " * 9), (docs[12][0], docs[12][1]), (docs[12][0], "z " * 30)]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS runs", "'x' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in p.op13(spark, str(tmp_path)).collect()), key=str)
    want = sorted((row_of(*d) for d in docs), key=str)
    assert got == want
    assert sum(w[1] for w in want) > 150


def test_tiles_are_stitched(monkeypatch):
    """Small cores, so runs cross many tiles."""
    rng = random.Random(5)
    docs = []
    for k in range(12):
        unit = [f"w{rng.randrange(30)}" for _ in range([1, 3, 4, 9, 15, 16, 40, 200, 256, 300, 511, 6][k])]
        docs.append((k, " ".join([f"v{rng.randrange(60)}" for _ in range(rng.randrange(300))] + (unit * 2000)[: 1800 + 37 * k] + [f"v{rng.randrange(60)}" for _ in range(60)])))
    for core in (32, 4096):
        tiles = 0
        monkeypatch.setattr(p, "CORE", core)
        for k, text in docs:
            words = split(text)
            held = np.array([zlib.crc32(w.encode()) for w in words], np.uint64)
            out = {}
            for _, q, c in p.marked_tiles([held]):
                size = p._octave(q)[2]
                before, after = p._overlap(q)
                low, stop = max(0, c * size - before), min(len(held), (c + 1) * size + after)
                tiles += 1
                for per, s, e in p.fragments(held[low:stop], q, c * size - low, min((c + 1) * size, stop) - low).tolist():
                    out.setdefault(per, []).append((s + low, e + low))
            whole = {}
            for per, found in sorted(out.items()):
                now = None
                for s, e in sorted(found) + [(1 << 40, 0)]:
                    if now and s + per <= now[1]:
                        now[1] = max(now[1], e)
                        continue
                    if now and now[1] - now[0] >= 12:
                        whole.setdefault(tuple(now), per)
                    now = [s, e]
            got = sorted((s, e - s, per) for (s, e), per in whole.items())
            assert got == runs_of(words), (core, k)
        assert tiles > (100 if core == 32 else 10)


def test_text_output_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x " + "a b " * 8 + "y"), (2, "one  two\n"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: (r.collapsed, [tuple(x) for x in r.runs]) for r in p.periodic_runs(df).collect()}
    assert got == {1: ("x a b y", [(1, 16, 2)]), 2: ("one two", []), 3: ("", [])}
    assert p.periodic_runs(df.where("false")).count() == 0


def test_one_word_without_end_takes_linear_time():
    tiles = list(p.marked_tiles([np.full(60_000, 7, np.uint64)]))
    assert len(tiles) < 60_000 / 4096 * 20
