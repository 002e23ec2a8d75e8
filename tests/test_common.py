"""The shared folder: named by the session, never a machine's own disk on a cluster, emptied on request."""

import os
from types import SimpleNamespace

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom import common


@pytest.mark.parametrize(("master", "fails"), [("local", False), ("local[*]", False), ("local[4,2]", False), ("local-cluster[3,2,1000]", True), ("spark://host:7077", True), ("yarn", True)])
def test_a_cluster_must_name_the_shared_folder(master, fails):
    settings = {}
    conf = SimpleNamespace(get=lambda k, d=None: settings.get(k, d), set=settings.__setitem__)
    spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: None)))
    if fails:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.scratch(spark)
    else:
        assert common.scratch(spark).startswith("file://")
    settings["spark.checkpoint.dir"] = "hdfs://shared/x"
    assert common.scratch(spark) == "hdfs://shared/x"


def test_cut_keeps_rows_and_sweep_deletes_them(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 3.0), (2, None, 3.0)], "i long, s string, d double")
    kept = common.cut(df)
    assert rows(kept) == rows(df) and kept.schema == df.schema
    assert common.cut(df.limit(0)).count() == 0
    written = [x.removeprefix("file://").removeprefix("file:") for x in common._WRITTEN[spark.sparkContext.applicationId]]
    assert any(os.path.isdir(x) for x in written)
    assert common.sweep(spark) == len(written) and not any(os.path.exists(x) for x in written) and common.sweep(spark) == 0


def test_once_keeps_rows_and_lets_no_filter_past(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "s string")
    got = common.once(df.where("s rlike '^[0-9]+$'"), n=F.col("s").cast("int")).where("n > 0")
    assert [tuple(r) for r in got.collect()] == [("1", 1)]
