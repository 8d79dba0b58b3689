"""Session construction and the few execution helpers every operator shares."""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

# Largest side (estimated bytes) that join_small broadcasts; above it the join
# shuffles and AQE's skew-join splitting handles a hot key.
BROADCAST_MAX_BYTES = 128 << 20
# Estimated bytes of a row besides its columns, of a string and of a nested value.
ROW_BYTES, STRING_BYTES, NESTED_BYTES = 32, 64, 512


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "aerolytics", extra: dict | None = None) -> SparkSession:
    """Session with the settings the operators are written for.

    AQE coalesces small shuffles and splits skewed join partitions; the UI is
    off; timestamps are zone-free (TIMESTAMP_NTZ) so the session zone only
    matters for the driver tables, pinned to UTC.
    """
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # Plans here have thousands of column expressions; recording a call site for each takes seconds.
         .config("spark.python.sql.dataFrameDebugging.enabled", "false")
         .config("spark.driver.memory", os.environ.get("AERO_DRIVER_MEMORY", "16g")))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of this session.

    Taken from the running context or from ``spark.checkpoint.dir``. Only a
    local-mode session (tests, bench) without one gets a fresh temporary
    folder; on a cluster the setting must name a shared folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        try:
            conf = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            conf = None
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="aero-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")


def remove_stored(spark: SparkSession, below: str) -> bool:
    """Delete the stored tables of one kind (a folder below the checkpoint folder, as ``llm`` or ``exports``).

    Results read these tables when they are computed: call it once they have
    been written elsewhere. Tells whether there was anything to delete.
    """
    if not below or below.startswith("/") or ".." in below.split("/"):
        raise ValueError("the name of a folder below the checkpoint folder")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{below}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the checkpoint folder and cut its lineage.

    Used for the small per-flight / per-parameter decision tables that are
    joined back onto the big sample data, so the size check and the join read
    the same stored result and a lost executor never recomputes the upstream
    scan. See ``materialize_counted`` for the row count.
    """
    return materialize_counted(df)[0]


def materialize_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``materialize`` plus the row count, observed during the same job.

    The plan is persisted first: an eager checkpoint runs one job to count and
    a second to write the files, and without the cached blocks the second job
    would compute the plan again. The cache is dropped once the files exist
    (a lost executor before that only means recomputing from lineage).
    """
    checkpoint_dir(df.sparkSession)
    obs = Observation()
    cached = df.observe(obs, F.count(F.lit(1)).alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    stored = cached.checkpoint(eager=True)
    n = int(obs.get["n"])
    cached.unpersist(blocking=False)
    return stored, n


def row_bytes(schema: StructType) -> int:
    """Estimated size of one row: fixed-width columns count 8 bytes."""
    def width(kind) -> int:
        if isinstance(kind, (ArrayType, MapType, StructType)):
            return NESTED_BYTES
        return STRING_BYTES if isinstance(kind, (StringType, BinaryType)) else 8

    return ROW_BYTES + sum(width(f.dataType) for f in schema.fields)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_bytes: int = BROADCAST_MAX_BYTES, stored: bool = False,
               n_rows: int | None = None) -> DataFrame:
    """Join a derived, normally small table onto big data.

    The small side is materialised and counted; it is broadcast only when its
    rows times the estimated row size are within ``max_bytes``. Above that the
    plain (shuffle) join is used and AQE splits a skewed key. ``stored=True`` skips materialising a
    side that is already stored; ``n_rows`` gives its known row count.
    """
    if n_rows is not None:
        side, n = small, n_rows
    elif stored:
        side, n = small, small.count()
    else:
        side, n = materialize_counted(small)
    if n * row_bytes(side.schema) <= max_bytes:
        side = F.broadcast(side)
    return big.join(side, on, how)
