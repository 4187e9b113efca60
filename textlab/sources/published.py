"""Publishing sets of partitions at once: readers see all of a publish or none of it.

    data/publish=<id>/<partition>/...    staged rows; nothing here is ever renamed, moved or overwritten
    manifest/version=<n>/                one file: the folders that make up version n

``stage`` writes rows; ``commit`` writes the next version of the manifest: the
staged partitions, and those of the version before that they do not replace.
It is one small file, so it is there or it is not.  ``read`` resolves the
newest version once and reads its folders, whatever is published meanwhile.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.operators.windows import null_safe_join


def stage(df: DataFrame, root: str, partition_cols: list[str]) -> str:
    """Write rows beside the published ones; returns what ``commit`` needs.  Readers do not see them."""
    own = uuid.uuid4().hex
    df.write.partitionBy(*partition_cols).parquet(f"{root}/data/publish={own}")
    return own


def _manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """All versions' rows (partition columns, folder, version), or None where nothing was published."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(f"{root}/manifest")


def latest(spark: SparkSession, root: str) -> int | None:
    """Number of the newest committed version; a version whose file is not there yet does not count."""
    rows = _manifest(spark, root)
    return None if rows is None else rows.agg(F.max("version")).first()[0]


def commit(spark: SparkSession, root: str, staged: str, partition_cols: list[str]) -> int:
    """Make a staged set of partitions the published one, in place of partitions of the same values.

    Publishing an empty set changes nothing but the version.  Two commits at the same time aim at the same
    version; the later one fails instead of hiding the other's partitions, and may be made again.
    """
    rows = spark.read.parquet(f"{root}/data/publish={staged}")
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    new = rows.select(*[F.col(c).cast("string").alias(c) for c in partition_cols], folder.alias("folder")).distinct()
    version, before = latest(spark, root), _manifest(spark, root)
    if version is not None:
        old = before.where(F.col("version") == version).drop("version")
        new = new.unionByName(null_safe_join(old, new.select(*partition_cols).distinct(), partition_cols, "left_anti"))
    n = 0 if version is None else version + 1
    new.coalesce(1).write.mode("error").parquet(f"{root}/manifest/version={n}")
    return n


def read(spark: SparkSession, root: str, schema: str, version: int | None = None) -> DataFrame:
    """The published rows, of the newest version or an earlier one; ``schema`` is that of the rows with their
    partition columns, so that reading needs no look into files.  No rows where nothing was published."""
    version = latest(spark, root) if version is None else version
    if version is None:
        return spark.createDataFrame([], schema)
    chosen = _manifest(spark, root).where(F.col("version") == version).select("folder").collect()  # a row a partition
    jvm = spark.sparkContext._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r.folder)).toString() for r in chosen]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{root}/data").parquet(*paths).drop("publish")
