"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local_folders: dict[str, str] = {}


def get_session(app: str = "genoloom", **conf: str) -> SparkSession:
    """A session with adaptive execution on; anything in ``conf`` wins."""
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    builder = SparkSession.builder.appName(app)
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def qualified(spark: SparkSession, path: str) -> str:
    """A path as a URI with its scheme.  Spark takes one without a scheme to be on the
    default file system, other libraries on an executor's own disk."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toUri().toString()
    return uri if "://" in uri else uri.replace(":/", ":///", 1)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables, shared by all executors, as a URI."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_folders:
            _local_folders[app] = tempfile.mkdtemp(prefix="genoloom-")
        named = _local_folders[app]
    return qualified(spark, named)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back.

    What follows starts from files, so a lost executor rereads them and recomputes
    nothing, each use reads only its columns, and the planner knows the true size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/genoloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
