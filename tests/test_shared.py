"""Tables that operators write go when the driver ends, and not before."""

import os
import subprocess
import sys
import time

from folio.sources.shared import written

_RUN = """
import os
import sys
from pyspark.sql import SparkSession
from folio.operators import lineage
top = sys.argv[1]
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").config("spark.sql.warehouse.dir", top + "/warehouse").config("spark.checkpoint.dir", top + "/shared").getOrCreate()
found = lineage.lineage(spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, parent long"))
assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in found.collect()) == [(1, 1, 0), (2, 1, 1), (3, 1, 2)]
own = spark.sparkContext.applicationId
print("tables", len([x for x in os.listdir(f"{top}/shared/{own}") if x.startswith("jump-")]), own)
"""


def test_tables_go_with_the_application(tmp_path):
    other = tmp_path / "shared" / "kept-by-another"
    other.mkdir(parents=True)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    got = subprocess.run([sys.executable, "-c", _RUN, str(tmp_path)], capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": root}, check=True)
    assert int(got.stdout.split()[1]) > 0
    shared, own = tmp_path / "shared", got.stdout.split()[2]
    for _ in range(100):  # the driver's JVM ends a little after its Python
        if not (shared / own).exists():
            break
        time.sleep(0.1)
    assert not (shared / own).exists() and other.exists()


def test_what_a_table_shuffled_goes_when_it_is_written(spark):
    left = lambda: {f.getName() for f in _files(spark) if f.getName().startswith("shuffle_")}
    before = left()
    table = written(spark.range(5000).selectExpr("id % 700 AS k").groupBy("k").count(), "counts")
    for _ in range(100):  # executors drop it in their own time
        if left() <= before:
            break
        time.sleep(0.1)
    assert left() <= before and table.count() == 700
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def _files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return [found.apply(k) for k in range(found.length())]
