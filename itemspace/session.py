"""Session helpers: a tuned local session for tests/bench, checkpoint folder
resolution, code shipping to executors and lineage cuts.

Joins carry no broadcast hint: Spark broadcasts a side by its size in bytes
(spark.sql.autoBroadcastJoinThreshold, also at run time under AQE)."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_PKG_DIR = os.path.dirname(os.path.abspath(__file__))

def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "itemspace") -> SparkSession:
    """Session used by tests and bench.  On a cluster the caller's own session
    (and its spark.checkpoint.dir) is used as is."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus) * 2
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ITEMSPACE_DRIVER_MEM", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints / materialised intermediates.

    Read from ``spark.checkpoint.dir``; only a local-mode session without the
    setting (tests, bench) gets a fresh scratch folder.  On a cluster an unset
    value is an error: a machine-local folder would not survive executor loss.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(d)
        return d
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    d = tempfile.mkdtemp(prefix="itemspace-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return d


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``itemspace`` importable in Python workers (needed by the few
    operators that run NumPy over Arrow batches)."""
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(_PKG_DIR):
            if "__pycache__" in root:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(_PKG_DIR)))
    fd, path = tempfile.mkstemp(prefix="itemspace-", suffix=".zip")
    with os.fdopen(fd, "wb") as fh:
        fh.write(buf.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(key)


def persist(df: DataFrame) -> DataFrame:
    from pyspark import StorageLevel
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def materialize(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared checkpoint folder
    (it survives executor loss, unlike cached blocks).  The input is cached
    while the checkpoint is written, so it is computed once, not twice."""
    checkpoint_dir(df.sparkSession)
    if not eager:
        return df.checkpoint(eager=False)
    cached = persist(df)
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder: one job, no lineage,
    and a plan that is a scan (for iterations that use a table twice a round)."""
    path = os.path.join(checkpoint_dir(df.sparkSession), f"table-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
