"""Small helpers shared by every operator.

Coordinate note: intervals are half-open ``[start, end)`` unless an operator says otherwise.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the characters that count as blanks around a key or a coordinate name.
BLANKS = " \t\r\n\x0b\x0c\u00a0\u3000\ufeff"
#: Paths written to the shared folder, by application.
_WRITTEN: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a lazy Parquet scan (pruning and pushdown are left to Catalyst)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip(c: Column) -> Column:
    """``c`` without surrounding blanks; null stays null."""
    return F.btrim(c, F.lit(BLANKS))


def scratch(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    A session on one machine (tests) gets a temporary one where it names none; a cluster without the setting fails, as
    executors would each write to their own disk.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="spanloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def fresh(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, remembered for ``sweep``, which runs at the end of the program at the latest."""
    at = f"{scratch(spark)}/{kind}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _WRITTEN:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        atexit.register(lambda: _deleted(jvm, conf, _WRITTEN.pop(app, [])))
    _WRITTEN.setdefault(app, []).append(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back, so that its lineage ends there.

    Unlike ``checkpoint()``, which computes its input twice, this runs one job, keeps columns apart and survives lost
    executors. The table stays until ``sweep`` is called or the folder is cleared.
    """
    at = fresh(df.sparkSession, "cut")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _deleted(jvm, conf, paths: list[str]) -> int:
    """Deletes what can still be reached; how many paths that was."""
    n = 0
    for x in paths:
        with contextlib.suppress(Exception):  # the store or the JVM may be gone at the program's end
            at = jvm.org.apache.hadoop.fs.Path(x)
            at.getFileSystem(conf).delete(at, True)
            n += 1
    return n


def sweep(spark: SparkSession) -> int:
    """Deletes what this application has written to the shared folder; call it once no result is read any more."""
    app = spark.sparkContext.applicationId
    paths, _WRITTEN[app] = _WRITTEN.get(app, []), []
    return _deleted(spark._jvm, spark._jsc.hadoopConfiguration(), paths)


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with further columns, each evaluated once a row: neither filters nor projections merge past a generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


def floor_div(c: Column, n: int) -> Column:
    """Integer division that rounds towards minus infinity (``div`` truncates towards zero)."""
    if n & (n - 1):
        return F.floor(c / F.lit(n)).cast("long")  # exact up to 2**53
    return F.shiftright(c.cast("long"), n.bit_length() - 1)
