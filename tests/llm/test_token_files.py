import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from folio.llm import attribution, ids_file

D = "/root/testdata/sf0.001"


def test_ids_file_against_the_library(spark):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{D}/documents.parquet").collect())
    start, want = 0, []
    for i, t in docs:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = ids_file.op7(spark, D)
    assert got.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_ids_file_odd_rows(spark, tmp_path):
    rows = [(3, "a  b \n c"), (1, None), (None, "x"), (2, ""), (2, "é" * 5000), (9, " lead"), (8, "trail ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS ids")
    path = str(tmp_path / "ids")
    ids_file.write_ids(df, path, ids_file.byte_50k())
    read = ids_file.read_ids(spark, path).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in read) == sorted((r.doc_id or -1, len(r.ids)) for r in read)
    order = sorted(read, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [None, 1, 2, 2, 3, 8, 9]
    assert [r.start for r in order] == [0, *np.cumsum([r.n_tokens for r in order])[:-1]]
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert next(r.ids for r in order if r.doc_id == 3) == [*tokenizer.encode("a  b \n c", add_special_tokens=False).ids, 2]
    empty = str(tmp_path / "none")
    ids_file.write_ids(df.where("false"), empty, ids_file.byte_50k())
    assert ids_file.read_checksums(spark, empty).count() == 0


def test_added_tokens_and_late_characters_against_the_library():
    path = ids_file.byte_50k()
    library, encoder = Tokenizer.from_file(path), ids_file.Encoder(path)
    late = [*map(chr, range(1, 0x530)), *(chr(c) for c in (0x558, 0x88F, 0xC5C, 0x208F, 0xA7CE, 0x1F600, 0x4E2D, 0x3000, 0x2028))]
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "<|endoftext|", "plain text", "", " ", "  ", "x ", " x", "\n", *(f"a{c}1 {c}{c}? {c} {c}  b{c}\n{c} é" for c in late), *(f"x {c}y {c}1{c}b 'll z" for c in late), "long " + "ab" * 60_000 + " one", "é" * 250_001]
    want = [library.encode(x, add_special_tokens=False).ids for x in texts]
    for several in (texts, texts[::-1], texts):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.packed_all(several)] == (want[::-1] if several[0] != texts[0] else want)
    assert want[0] == [64, 220, 50256, 275]


def test_a_full_cache_keeps_the_ids(monkeypatch):
    monkeypatch.setattr(ids_file, "ROOM", 5)
    library, encoder = Tokenizer.from_file(ids_file.byte_50k()), ids_file.Encoder(ids_file.byte_50k())
    for k in range(30):
        texts = [f"the w{k} and w{k + j} of x{j} the end" for j in range(4)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.packed_all(texts)] == [library.encode(x).ids for x in texts]


def test_a_lookup_by_id_reads_few_rows(spark, tmp_path):
    """Stripes and row groups that can't hold the id are skipped."""
    path = str(tmp_path / "ids")
    ids_file.write_ids(spark.range(60_000).selectExpr("id * 2 AS doc_id", "'some text' AS text").repartition(3), path, ids_file.byte_50k())
    found = spark.read.orc(path).where("doc_id = 80002")
    assert [r.n_tokens for r in found.collect()] == [3]
    plan = found.select("doc_id")._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    assert 0 < plan.collectLeaves().head().metrics().apply("numOutputRows").value() <= 10_000


def test_section_tokens_against_brute_force(spark):
    path, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    encoding, lengths = attribution._encoding(path, pattern)
    rows = [(1, "one two\nthree  \n\n four"), (2, None), (3, ""), (None, "\n\n\nzwei 😀😀\n"), (5, "é\n" * 700), (6, "ein\r\n\r\n zwei")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS section")
    for rule in attribution.RULES:
        want = []
        for i, t in rows:
            lines = [x for x in (t or "").split("\n")]
            lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
            owner = [k for k, x in enumerate(lines) for _ in x]
            count, cross, at = [0] * len(lines), [0] * len(lines), 0
            raw = (t or "").encode()
            for n in lengths[encoding.encode_ordinary(t or "")].tolist() if t else []:
                a, b = len(raw[:at].decode(errors="ignore")), len(raw[: at + n].decode(errors="replace"))
                held = owner[a:b]
                k = held[0] if rule == "first" else held[-1] if rule == "last" else max(dict.fromkeys(held), key=held.count)
                count[k] += 1
                cross[k] += len(set(held)) > 1
                at += n
            s = 0
            for k, x in enumerate(lines):
                want.append((i, k, s, s + len(x), count[k], cross[k]))
                s += len(x)
        got = [tuple(r) for r in attribution.section_tokens(df, path, pattern, rule).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), rule
    assert attribution.section_tokens(df.where("false"), path, pattern).count() == 0


def test_field_tokens_add_up(spark):
    path, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    df = spark.createDataFrame([(1, "a b", "c d e"), (2, None, "x"), (3, "", None)], "doc_id long, head string, body string")
    got = {r.doc_id: r for r in attribution.field_tokens(df, path, pattern, ["head", "body"]).collect()}
    assert all(sum(r.fields.values()) == r.n_tokens for r in got.values())
    assert got[1].fields == {"head": 3, "body": 3} and got[3].n_tokens == 1


def test_field_tokens_odd_rows(spark):
    path, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    rows = [(1, "a b", "c d e", "x"), (None, "a b", None, None), (2, "é😀 " * 30000, "", "y"), (1, "a b", "c d e", "x")]
    df = spark.createDataFrame(rows, "doc_id long, parts string, fields string, n_tokens string")
    got = attribution.field_tokens(df, path, pattern, ["parts", "fields", "parts"]).collect()
    once = attribution.field_tokens(df, path, pattern, ["parts", "fields"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, once)) and len(got) == 4
    assert all(set(r.fields) == {"parts", "fields"} and sum(r.fields.values()) == r.n_tokens for r in got)
    assert next(r for r in got if r.doc_id is None).fields == {"parts": 3, "fields": 0}
    none = attribution.field_tokens(df, path, pattern, []).collect()
    assert sorted((r.doc_id, r.n_tokens, len(r.fields)) for r in none if r.doc_id) == [(1, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert attribution.field_tokens(df.where("false"), path, pattern, ["parts"]).collect() == []
