"""Scratch tables in the folder that all machines of the cluster share.

``spark.checkpoint.dir`` names that folder.  Where the session has none (tests,
a laptop) a temporary folder is used, but only for a local master: a
machine-local folder would lose data on a cluster.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The session's own scratch folder, removed when the driver's JVM ends."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        known = sc._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if base is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = _roots.setdefault("own", tempfile.mkdtemp(prefix="evidentia-"))
    key = f"{sc.applicationId} {base}"
    if key not in _roots:
        root = f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex[:12]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _roots[key] = root
    return _roots[key]


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the scratch folder."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the scratch folder and reads it back.

    The result has no lineage: a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
