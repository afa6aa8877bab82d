"""Session helpers: settings the engine relies on and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, once per application; functions that run there name its modules."""
    sc = spark.sparkContext
    if getattr(sc, "_storyspark_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    # Spark copies the file to every executor; the driver's own copy is not read again
    name = os.path.join(tempfile.mkdtemp(prefix="storyspark-"), "storyspark.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(top):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("storyspark", os.path.relpath(path, top)))
    sc.addPyFile(name)
    sc._storyspark_shipped = True


def configure(spark: SparkSession, batch: str = "4m") -> SparkSession:
    """Pin the session settings results depend on, and send the package to the workers; leave cluster sizing alone.

    ``batch`` is how many bytes a Python worker gets at once. Rows of whole pages are large: 10,000 of them, copied by each
    of the workers of an executor, grow with the table until a batch is full.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names; only a local session may go without one."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-ckpt-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and drop its lineage.

    Used between rounds of iterative operators. The files are on shared storage,
    so a lost executor costs a re-read and not a re-run of earlier rounds.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
