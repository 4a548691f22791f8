"""Reading tables and cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where the session has none, a folder of this machine is taken on a local master (tests); any other master is an error.
    """
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            found = tempfile.mkdtemp(prefix="genoquery-")
        sc.setCheckpointDir(found)
    return found


def _remove(spark: SparkSession, folder: str) -> None:
    sc = SparkContext._active_spark_context
    if sc is not None and sc._jsc is not None and sc is spark.sparkContext:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession) -> str:
    """A new folder under the shared one; this session's folders are removed when its Python ends."""
    sc = spark.sparkContext
    mine = getattr(sc, "_genoquery_folder", None)
    if mine is None:
        mine = sc._genoquery_folder = f"{shared_dir(spark).rstrip('/')}/genoquery-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, mine)
    return f"{mine}/{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder as Parquet and reads it back: its lineage is cut, so a lost executor costs nothing upstream."""
    spark = df.sparkSession
    folder = new_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once a session, so that they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_genoquery_sent", False):
        return
    root = Path(__file__).parent
    name = Path(tempfile.mkdtemp(prefix="genoquery-")) / "genoquery.zip"  # Spark serves it from the driver
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path("genoquery") / f.relative_to(root))
    sc.addPyFile(str(name))
    sc._genoquery_sent = True
