"""Session and work folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "marisma", **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; cluster sizing comes from the submit command."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_GIVEN: list[str] = []


def require_local(master: str) -> None:
    """Executors of a cluster do not share a machine's folders."""
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; without one, a local folder, but only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        require_local(spark.sparkContext.master)
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    _GIVEN.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _GIVEN[-1]


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write and read back: later stages restart from shared storage if an executor is lost.

    The write is a job that runs here and now; clear_work removes the folder.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_work(spark: SparkSession) -> int:
    """Delete the folders that work_dir has given out in this process; frames that read them end with that."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = 0
    while _GIVEN:
        path = jvm.org.apache.hadoop.fs.Path(_GIVEN.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone
