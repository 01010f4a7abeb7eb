"""Session helpers: building a session, shared scratch tables, one-row aggregates."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "corpuslens") -> SparkSession:
    """Return the active session or build one configured for this library.

    On a cluster the session already exists and keeps its own settings; the
    defaults below only apply when we create one (tests, bench, local use).
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CORPUSLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared scratch folder: the session's ``spark.checkpoint.dir``.

    Only where it is unset *and* the master is local (tests, bench) a fresh
    scratch folder is made; on a cluster executors could not see a folder of
    the driver's machine, so the setting is required there.
    """
    sc = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if conf_dir:
        if current.isEmpty():
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if current.isEmpty():
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpuslens-ckpt-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


_SCOPES: list[list[str]] = []  # folders made inside the open scopes, the innermost last


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path inside the shared scratch folder."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpuslens-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(folder)
    return f"{folder}/{tag}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the intermediate tables made inside once the block ends.

    Results are lazy and may still read them: write what is to stay (anywhere but
    in the scratch folder, or with :func:`materialise` outside the block) before
    the block ends. Tables made outside any scope stay until someone clears
    ``spark.checkpoint.dir``.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for folder in _SCOPES.pop():
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage with a table written in the shared scratch folder.

    The table outlives lost executors, is computed once and can be read with
    column pruning by every later branch.
    """
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers (once per application)."""
    sc = spark.sparkContext
    if getattr(sc, "_corpuslens_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="corpuslens-zip-"), "corpuslens.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._corpuslens_shipped = True


def join_scalars(*frames: DataFrame) -> DataFrame:
    """Attach single-row aggregates to the first frame as scalar subqueries.

    Every frame after the first is a global aggregate with exactly one row.
    Each becomes one uncorrelated scalar subquery (its columns packed in a
    struct), evaluated once and inlined as a constant: no join, no shuffle.
    """
    out = frames[0]
    for k, f in enumerate(frames[1:]):
        name = f"_scalar{k}"
        packed = f.select(F.struct(*[F.col(f"`{c}`") for c in f.columns]).alias(name)).scalar()
        keep = [F.col(f"`{c}`") for c in out.columns]
        out = out.withColumn(name, packed).select(
            *keep, *[F.col(name).getField(c).alias(c) for c in f.columns])
    return out
