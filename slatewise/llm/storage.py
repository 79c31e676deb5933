"""Intermediate tables in the folder all executors share.

The folder is the session's ``spark.checkpoint.dir``. Only a local session
that has none gets a scratch folder of its own (tests); on a cluster a
missing setting is an error, since a machine-local folder would lose rows.
"""

from __future__ import annotations

import os
import site
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = tempfile.mkdtemp(prefix="slatewise-shared-")
    sc.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one table or set of files; never reused, so a retried job cannot mix runs."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    ``compression`` is the Parquet codec, the session's unless given.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Make the package importable in the Python workers where it is not installed for them.

    Workers see PYTHONPATH and the folder the driver started in; otherwise the package goes along as a zip.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()]
    sc = spark.sparkContext
    if root in map(os.path.abspath, filter(None, known)) or getattr(sc, "_slatewise_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="slatewise-zip-"), "slatewise.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "slatewise")):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), root))
    sc.addPyFile(path)
    sc._slatewise_shipped = True
