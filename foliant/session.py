"""Sessions with the settings this library is tested under."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_BATCH, _CLEAN = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(name: str = "foliant", master: str | None = None, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session in UTC with adaptive execution. ``master`` and ``partitions`` are for local runs; a cluster's own settings stand otherwise."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if master:
        builder = builder.master(master).config("spark.driver.memory", memory)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def settle(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the folder that driver and executors share (``spark.checkpoint.dir``) and read it back: what follows starts from there.

    Where it is unset, a local session gets a temporary folder; on a cluster that is an error, as executors could not see one machine's folder.
    ``batch_rows`` bounds the rows that a Python worker gets at once, as texts may be long. The shuffles are removed when the table is written.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='foliant-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/foliant/settled-{uuid.uuid4().hex}"
    held = {_CLEAN: "true"} | ({_BATCH: str(min(batch_rows, int(spark.conf.get(_BATCH))))} if batch_rows else {})
    was = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def unsettle(*tables: DataFrame) -> None:
    """Delete tables that ``settle`` wrote and nothing reads any more."""
    for table in tables:
        at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.settled_path)
        at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
