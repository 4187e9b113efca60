"""Session construction and shared-storage helpers.

On a cluster the session is handed to us; we only read its settings.
``scratch_dir`` returns a fresh folder under the cluster's shared
``spark.checkpoint.dir``; a local default is set only when that setting
is missing (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(app: str = "textlab", cpus: int | str | None = None,
              shuffle_partitions: int | None = None,
              driver_memory: str = "16g") -> SparkSession:
    cpus = cpus or os.environ.get("TEXTLAB_CPUS", "*")
    parts = shuffle_partitions or (8 if cpus == "*" else max(int(cpus), 2))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local one is set only when the session has none and its master is
    local (tests); on a cluster that would be a different folder on each
    machine, so a missing setting is an error there.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="textlab-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, tag: str = "tmp") -> str:
    """A new, unique folder path inside the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/textlab-{tag}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint dir (never local).

    The input is persisted first so the checkpoint write does not recompute
    it (a reliable RDD checkpoint otherwise evaluates its lineage twice).
    """
    from pyspark import StorageLevel
    checkpoint_root(df.sparkSession)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Batches that go to Python workers are bounded by ``BATCH_BYTES``, unless the session has its own bound.

    Spark cuts them at 10,000 rows or 64 MB: of whole texts that is tens of MB, which an executor holds several
    times over for each of its cores (as vectors, as a message and in the worker).
    """
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, BATCH_BYTES)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``textlab`` importable in Python workers (once per application), and bound what they are sent at once.

    Functions handed to ``mapInPandas`` reference textlab modules; workers
    started from another directory could not import them.  The package's
    .py files are zipped (a small code artefact on the driver) and shipped
    with ``addPyFile``, like ``--py-files``.
    """
    import zipfile

    import textlab

    bound_batches(spark)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(textlab.__file__))
    fd, path = tempfile.mkstemp(prefix="textlab-code-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
