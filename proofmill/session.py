"""Session settings and shared scratch folders."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "proofmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew splitting and UTC."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, one below it for each application.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without that setting gets a folder of its own, removed at exit; elsewhere
    each executor would write to its own disk, so the job stops.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that the driver and all executors share"
        )
    if folder is None:
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = tempfile.mkdtemp(prefix="proofmill-")
            atexit.register(shutil.rmtree, _OWN[context.applicationId], ignore_errors=True)
        folder = _OWN[context.applicationId]
    return f"{folder.rstrip('/')}/{context.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has written to yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(keys: DataFrame) -> DataFrame:
    """Deal narrow key rows over the shuffle partitions, whatever their number.

    For rows that much larger text is made from: the shuffle of the keys is
    small against that work.
    """
    return keys.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def written_once(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and go on from the written copy.

    Text takes far less disk with ``zstd``. Tables of keys are better left, as joins go by the size of their files.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
