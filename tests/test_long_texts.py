"""Texts larger than those of the given tables."""

from folio.catalog import fixtures, trees


def put(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_paths_and_first_places_of_many_pages(spark, tmp_path):
    text = "".join(f"{k:0256d}" for k in range(1100))
    d = put(spark, tmp_path, [(1, text), (2, "x"), (4, f"{1050:0256d}"), (3, None)])
    path = {(r.image_id, r.page_no): r.path for r in trees.node_path(spark, d).collect()}
    assert len(path) == 1102 and len({v for (i, _), v in path.items() if i == 1}) == 1100
    assert path[1, 1024] == "1/0/0/0/0/0" and path[1, 0] == "0/0/0/0/0/0" and path[2, 0] == "0"
    assert len(trees.first_occurrence(spark, d).collect()) == 1101


def test_levels_above_nine(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixtures, "P", 1)
    d = put(spark, tmp_path, [(6, "a" * (4**9 + 1))])
    assert fixtures.top(spark, d) == 10
    assert trees.tree_diff(spark, d).count() == 0  # the holder has the root
