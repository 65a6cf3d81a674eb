"""Session settings that the operators rely on."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # state of streams lies on disk and is saved by its changes
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # sessions of one user merge inside each task before the shuffle
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on (time zone) and the adaptive ones."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "marginalia", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """A session for tests and the local bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    # one machine: any folder is shared; checkpoints go with what they hold
    builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-")).config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, a session that runs in one process gets a scratch folder; on a cluster that
    would scatter data over machines, so it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="run-"))


def written(df: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """Rows written once to the shared folder as Parquet, read back with their size known.

    ``paths`` gets the folder, for :func:`forget`; such rows do not stay long and are compressed more.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"
    if paths is not None:
        paths.append(path)
    df.write.option("compression", "snappy" if paths is None else "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """What the files of a folder take."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(where).getLength()


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Delete what no result reads any more, and the folders' names from the list."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    paths.clear()


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of jobs that are done.

    It does so when the JVM finds that nothing refers to them, which without this may be half an hour later.
    """
    gc.collect()  # references from Python end first
    spark._jvm.System.gc()


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, on whatever file system the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
