import hashlib

import corpus_pipeline
from folio.llm import bpe, quality
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_near_dedup import brute as near

D = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    state = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in state.collect()}
        state = stage(spark, state, D)
        if name == "bpe encoding":
            got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in state.collect()}
            encoder = bpe.encoder(*bpe.multi_50k())
            assert got.keys() == before.keys()
            for i, t in before.items():
                packed = encoder.packed(t)
                assert got[i] == (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
            continue
        assert state.columns == docs.columns
        kept = {r.doc_id: r.text for r in state.collect()}
        if name == "quality classifier":
            model = quality.fit(docs, spark.read.parquet(f"{D}/labels.parquet"), ~quality.held_out())
            want = {i for i, t in before.items() if model.score(quality.np.array([quality.features(t.encode())]))[0] >= 0.5}
        elif name == "exact dedup":
            want = {max(i for i, t in before.items() if t == text) for text in before.values()}
        elif name == "minhash near-dedup":
            want = {i for i, _, _, k in near(list(before.items()), 5) if k}
        else:
            want = {i for i, t in before.items() if not leaks(t, items)}
        assert kept.keys() == want and all(before[i] == t for i, t in kept.items()), name
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, D).collect()) == sorted(tuple(r) for r in state.collect())


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SIX = "one two three four five six"


def test_stages_keep_odd_rows(spark):
    docs = spark.createDataFrame([(1, SIX, None, "s", 3), (None, None, None, None, None), (2, "", "en", "s", 0), (3, SIX, "en", None, 1)], COLUMNS)
    state = docs
    for _, stage in corpus_pipeline.STAGES[1:4]:
        state = stage(spark, state, D)
        assert state.columns == docs.columns
    assert {r.doc_id for r in state.collect()} == {None, 2, 3}


def test_rows_that_share_an_id_go_by_their_text(spark):
    """Of the rows of id 1 only the copies go, with clashing extra columns in place."""
    item = spark.read.parquet(f"{D}/benchmark.parquet").first().text
    rows = [(1, SIX), (1, "a text of its own that nobody else has"), (3, SIX), (1, item), (None, item), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' AS digest", "5 AS id", "true AS kept", "9 AS text_hash")
    stages = dict(corpus_pipeline.STAGES)
    left = lambda name: sorted(((r.doc_id, r.text) for r in stages[name](spark, docs, D).collect()), key=str)
    without = lambda *gone: sorted((r for r in rows if r not in gone), key=str)
    assert left("exact dedup") == without((1, SIX))
    assert left("minhash near-dedup") == without((3, SIX))
    assert left("benchmark decontamination") == without((1, item))
    assert left("quality classifier") and set(left("quality classifier")) <= set(rows)
    assert stages["bpe encoding"](spark, docs, D).count() == len(rows)


def test_empty_tables_stay_empty(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, D).count() == 0


def test_run_leaves_one_table_behind(spark):
    from pathlib import Path

    top = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(top.iterdir()) if top.exists() else set()
    assert corpus_pipeline.run(spark, D).count()
    assert [p.name.rsplit("-", 1)[0] for p in set(top.iterdir()) - before] == ["benchmark-decontamination"]


def test_stages_take_very_long_texts_whole(spark):
    """Copies, near copies and test items are found at the far end of texts of a megabyte, and the texts stay whole."""
    item = spark.read.parquet(f"{D}/benchmark.parquet").first().text
    long_ = " ".join(f"w{i * 7919 % 99991}" for i in range(150_000))
    other = " ".join(f"v{i * 104729 % 99989}" for i in range(150_000))
    rows = [(1, long_), (2, long_ + " end"), (3, long_), (4, other + " " + item), (5, other[: len(other) // 2])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], COLUMNS)
    stages, texts = dict(corpus_pipeline.STAGES), dict(rows)
    for name, want in (("exact dedup", {2, 3, 4, 5}), ("minhash near-dedup", {1, 4, 5}), ("benchmark decontamination", {1, 2, 3, 5})):
        kept = {r.doc_id: r.text for r in stages[name](spark, docs, D).collect()}
        assert kept.keys() == want and all(texts[i] == t for i, t in kept.items()), name
    assert all(texts[r.doc_id] == r.text for r in stages["quality classifier"](spark, docs, D).collect())
    got = {r.doc_id: r.decoded_sha256 for r in stages["bpe encoding"](spark, docs, D).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows}


def test_tables_of_another_thread_stay(spark):
    from threading import Event, Thread

    from folio.llm import shared

    watching, wrote, kept = Event(), Event(), []

    def other():
        watching.wait(60)
        kept.append(shared.written(spark.range(3), "other"))
        wrote.set()

    def mine():
        watching.set()
        assert wrote.wait(60)
        return shared.written(spark.range(5), "mine")

    beside = Thread(target=other)
    beside.start()
    assert shared.kept_only(mine, spark, "both")[0].count() == 5
    beside.join()
    assert kept[0].count() == 3
