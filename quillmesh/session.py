"""Session and storage helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only local runs (tests) may do without the setting: they take a folder of this process, which goes with it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _fallback:
        folder = tempfile.mkdtemp(prefix="quillmesh-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _fallback.append(f"file://{folder}")
    return _fallback[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` through a table in the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Deletes the tables that ``materialize`` wrote in this process, once their results are stored; gives their number."""
    jvm = spark._jvm
    for path in _written:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    n = len(_written)
    _written.clear()
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
