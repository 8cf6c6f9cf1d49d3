"""Session helpers: checkpoint folder, giving back disk and memory, and shipping this package to executors."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is missing (a local session, tests), a folder of this process's own is set.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        conf = held.get() if held.isDefined() else None
    if not conf:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/textloom/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame's rows from reliable storage, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffles of frames that are gone: it does so only when the driver's JVM collects its garbage, seldom in a long loop."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back(spark: SparkSession) -> None:
    """``sweep``, and a collection in every executor: their heaps grow to the limit and stay there, while Python workers need the memory.

    A task a core, all dealt at once; results depend on nothing of it.
    """
    sweep(spark)
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc")).alias("done")).write.format("noop").mode("overwrite").save()


def ship(spark: SparkSession) -> None:
    """Send this package to executors that don't have it on their path, and set the size of Arrow batches (once a session).

    Batches are cut by bytes as well as by rows: 10,000 long texts at once would be held several times, in the JVM and in Python.
    A size that the application was started with stays.
    """
    sc = spark.sparkContext
    if sc.getConf().get(ARROW_BYTES) is None:
        spark.conf.set(ARROW_BYTES, "4m")
    if getattr(sc, "_textloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.parent.suffix == ".zip" or not root.is_dir():
        return
    target = os.path.join(tempfile.mkdtemp(prefix="textloom-ship-"), "textloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    sc._textloom_shipped = True
