"""Session settings and the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings that the operators rely on; all can be changed on a running session.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key is split even where that costs another shuffle behind the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A date window or a venue keeps few shows. Spark then builds a Bloom filter of the
    # kept shows and applies it where tickets are scanned, so that tickets of other shows
    # never reach the shuffle. The default limit of 10 MB on the show side is too low for
    # a show table of many years.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "8000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "8000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": "67108864",
}


# Bytes that one shuffle partition should hold before adaptive execution merges small ones.
PARTITION_BYTES = 128 * 1024 * 1024


def tune(spark: SparkSession, shuffle_bytes: int | None = None) -> SparkSession:
    """Apply the runtime settings to a session that someone else created.

    ``shuffle_bytes`` is the size of the largest shuffle that is expected, for instance the
    sums of all tickets per show. Adaptive execution merges partitions but does not split
    them, so it must start with enough of them. Without it the session's own number stays.
    """
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    if shuffle_bytes:
        parts = max(spark.sparkContext.defaultParallelism, -(-shuffle_bytes // PARTITION_BYTES))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(parts))
    return spark


def local_session(cpus: int | str = "*", app: str = "marquee", **conf: str) -> SparkSession:
    """A local session, for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Folders of local sessions without the setting, by application.
_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, for data that outlives a stage.

    A folder of our own is used on a local master only: on a cluster a folder that one
    machine sees would be lost with that machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    key = spark.sparkContext.applicationId
    if key not in _OWN_FOLDERS:
        _OWN_FOLDERS[key] = tempfile.mkdtemp(prefix="marquee-")
    return _OWN_FOLDERS[key]


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it belongs to."""
    files, place = _file_system(spark, path)
    return files.exists(place)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below a folder."""
    files, place = _file_system(spark, path)
    return [x.getPath().getName() for x in files.listStatus(place) if x.isDirectory()]


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of a table that its owner keeps; nothing happens where there is none."""
    files, place = _file_system(spark, path)
    files.delete(place, True)


def new_folder(spark: SparkSession, purpose: str) -> str:
    """The name of a folder that nobody has used yet, below the shared folder."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """Write a frame and read it back: one computation for several uses, and a short lineage.

    The files are columnar, so later uses read only the columns and dates they need, and
    they stay readable when executors are lost. The folder is left to the clean-up of the
    shared folder.
    """
    path = new_folder(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
