import base64
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import bpe, quality


@pytest.fixture(scope="module")
def pair():
    path, pattern = bpe.multi_50k()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return bpe.encoder(path, pattern), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", ".", ",", "ª", "ⅷ", "²", " ", "é", "ß", "'s", "'ll", "12", "😀", "!!", "ing", "zz", "　", "\r\n", "<|endoftext|>", "\x1c", "\x85"]), max_size=30).map("".join) | st.text(max_size=60))
def test_ids_equal_the_library(pair, text):
    ours, theirs = pair
    want = np.array(theirs.encode_ordinary(text), "<u4").tobytes()
    assert ours.packed(text) == want
    assert ours.packed(text) == want  # from the cache
    assert ours.decode(want) == text.encode()


def test_very_long_pre_tokens(pair):
    ours, theirs = pair
    rng = random.Random(5)
    for text in ("a" * 30001, "ab" * 20000, " " * 5001, "!" * 7777, "".join(rng.choice("abcdeinorst") for _ in range(50000)), "-=" * 3001):
        assert ours.ids(text) == theirs.encode_ordinary(text)


def test_many_pre_tokens_in_one_queue(pair):
    ours, theirs = pair
    rng = random.Random(6)
    make = lambda: "".join(rng.choice(["th", "er", "on", "an", "é", "tion", "a", "x", "9", "😀", "!"]) for _ in range(rng.randrange(1, 14)))
    pieces = [make().encode() for _ in range(bpe.TOGETHER + 500)] + [b"a" * 3001, b"ab" * 1500, b"", b" " * 700, b"the"]
    got = ours.merge_many(pieces)
    want = [np.array(theirs._encode_single_piece(p) if p else [], "<u4").tobytes() for p in pieces]
    assert got == want == [np.array(ours.merge(p) if p else [], "<u4").tobytes() for p in pieces]
    texts = ["a  b", "", " x", "x ", "\n y z", "t u\n v w", *[" ".join(make() for _ in range(40)) for _ in range(300)]]
    assert ours.packed_all(texts) == [np.array(theirs.encode_ordinary(t), "<u4").tobytes() for t in texts]


def test_long_pre_tokens_among_many(pair):
    """A pre-token of 200 KB costs time in proportion to its length, also beside thousands of others."""
    ours, theirs = pair
    rng = random.Random(7)
    pieces = [str(k).encode() + b"th" for k in range(bpe.TOGETHER + 500)] + [bytes(rng.choice(b"abcdeinorst") for _ in range(200_000)), b"ab" * 100_000, b"e" * (bpe.LONG - 1), b"e" * bpe.LONG]
    began = time.process_time()
    got = ours.merge_many(pieces)
    assert time.process_time() - began < 20
    assert got == [np.array(theirs._encode_single_piece(p), "<u4").tobytes() for p in pieces]


def test_ranks_that_fall_as_pieces_grow():
    """Each merge yields a pair of lesser rank: the rest of a bucket isn't sorted anew each time."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 299, b"abcabc": 280, b"cab": 290}
    ours = bpe.Bpe(ranks, P.PATTERN)
    theirs = tiktoken.Encoding("fall", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in (b"abc" * 400, b"ab" * 301, b"cabab" * 77, b"abcab" * 50):
        assert ours.merge(text) == theirs._encode_single_piece(text)

    def seconds(n):
        began = time.process_time()
        assert ours.merge(b"abc" * n) == [280] * (n // 2)
        return time.process_time() - began

    few = min(seconds(20_000) for _ in range(3))
    assert seconds(160_000) < 16 * few + 1


def test_encode_decode_rows(spark, pair):
    rows = [(1, "the cat"), (2, None), (3, ""), (None, "x"), (5, "é " * 3000), (5, "é " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS ids")
    got = sorted((tuple(r) for r in bpe.encode_decode(df, *bpe.multi_50k()).collect()), key=str)
    want = []
    for i, t in rows:
        ids = pair[1].encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_decode(df.where("false"), *bpe.multi_50k(), keep_ids=True).count() == 0


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op5(spark, d).collect()}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert len(got) == docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[i].predicted, q) for i, q in labels.items() if got[i].held_out]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) > 0.93
    good = [got[i].score for i, q in labels.items() if got[i].held_out and q == 1]
    bad = [got[i].score for i, q in labels.items() if got[i].held_out and q == 0]
    assert np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good]) > 0.97


def test_fit_equals_gradient_descent_over_all_pairs():
    """Eleven rows a label with eleven opponents each are all pairs once; plain descent over them finds the same weights."""
    rng = np.random.default_rng(3)
    n = len(quality.FEATURES)
    good, bad = rng.normal(0.3, 1, (11, n)), rng.normal(-0.3, 1, (11, n))
    both = np.concatenate([good, bad])
    x = (both - both.mean(0)) / both.std(0)
    w = np.zeros(n)
    for _ in range(3000):
        grad = -0.05 * w
        for g in x[:11]:
            for b in x[11:]:
                grad = grad + (g - b) / (1 + np.exp((g - b) @ w)) / 121
        w = w + 0.3 * grad
        if np.abs(grad).max() < 1e-7:
            break
    model = quality.fit_pairs(good, bad, opponents=11, ridge=0.05)
    assert np.abs(model.weights - w).max() < 1e-4
    worth = sorted(x @ w)
    assert worth[10] - 1e-3 <= model.threshold <= worth[11] + 1e-3
    want = 1 / (1 + np.exp(model.threshold - x @ w))
    assert np.abs(model.score(both) - want).max() < 1e-3


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, "A fine text."), (2, None), (None, ""), (4, "X!! " * 20000), (4, "X!! ")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, quality.F.lit(True))
    got = quality.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = quality.fit(docs, labels.where("false"), quality.F.lit(True))
    assert all(r.score >= 0.5 for r in quality.score(docs, none).collect())
    assert quality.score(docs.where("false"), model).count() == 0


def test_quality_beside_columns_of_its_own_names(spark):
    docs = spark.createDataFrame([(1, "A fine text."), (2, None), (None, ""), (4, "X!! X!! X!!")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")
    more = lambda df, *names: df.selectExpr("*", *[f"'q' AS {n}" for n in names])
    names = ("score", "predicted", "held_out", "text_hash", "features", "label", "lang", "source", "id", "hash")
    plain = quality.score(docs, quality.fit(docs, labels, quality.F.lit(True)))
    wide = more(docs, "quality", *names)
    clashing = quality.score(wide, quality.fit(wide, more(labels, "text", *names), quality.F.lit(True)))
    assert clashing.columns == plain.columns
    assert sorted(map(str, clashing.collect())) == sorted(map(str, plain.collect()))
