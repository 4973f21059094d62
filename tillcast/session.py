"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# AQE coalesces small shuffle partitions and splits skewed ones, so one setting serves a
# laptop and a cluster. forceOptimizeSkewedJoin keeps the split even where it costs a shuffle.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # windows cost far more per byte than scans: keep small partitions apart
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # nanosecond timestamps, which Spark cannot hold, are read as numbers
    "spark.sql.legacy.parquet.nanosAsLong": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}

_LOCAL_DIRS: dict[str, str] = {}


def build_session(app_name: str = "tillcast", master: str | None = None, **conf) -> SparkSession:
    """Build a session with the recommended settings; ``conf`` overrides single ones."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A local session without that setting gets a fresh folder; a cluster without it, or with a
    machine's folder for temporary files, is an error, since such a folder would not survive a
    lost executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    local = spark.sparkContext.master.startswith("local")
    if configured:
        if not local and _is_temporary(spark, configured):
            raise ValueError(f"{configured} is a temporary folder of one machine")
        return configured.rstrip("/")
    if not local:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="tillcast-")
    return _LOCAL_DIRS[app]


def _is_temporary(spark: SparkSession, folder: str) -> bool:
    """Whether a path is a local file path below a usual place for temporary files."""
    path, system = _hadoop(spark, folder)
    if system.getUri().getScheme() != "file":
        return False
    plain = path.toUri().getPath().rstrip("/") + "/"
    return plain.startswith(("/tmp/", "/var/tmp/", tempfile.gettempdir().rstrip("/") + "/"))


_RUN_DIRS: set[str] = set()


def _run_dir(spark: SparkSession) -> str:
    """The folder of this application's stages. It goes when the driver's JVM ends."""
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _RUN_DIRS:
        path, system = _hadoop(spark, folder)
        system.mkdirs(path)
        system.deleteOnExit(path)
        _RUN_DIRS.add(folder)
    return folder


def _hadoop(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, unique per call."""
    return f"{_run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_stages(spark: SparkSession) -> None:
    """Delete all stages of this application; tables that read them cannot be used any more."""
    folder = _run_dir(spark)
    path, system = _hadoop(spark, folder)
    system.delete(path, True)
    _RUN_DIRS.discard(folder)


def drop_table(df) -> None:
    """Delete the tables of ``materialize`` that ``df`` reads; what was not stored from it is lost."""
    spark = df.sparkSession
    inside = f"/{spark.sparkContext.applicationId}/"
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if inside in folder:
            path, system = _hadoop(spark, folder)
            system.delete(path, True)


#: Rows up to which a stored table is sent to every task.
BROADCAST_ROWS = 100_000


def small(df, limit: int = BROADCAST_ROWS):
    """A stored table with a broadcast hint if its counted rows allow."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= limit else df


def materialize(df, name: str = "stage", partition_by: tuple[str, ...] = ()):
    """Cut lineage through a Parquet table in the shared folder.

    ``partition_by`` names columns of a few values, whose filters then skip folders.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
