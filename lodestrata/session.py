"""Session set-up, code shipping and scratch storage shared by every executor."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_SCRATCH: list[str] = []
_TABLES: dict[str, str] = {}
#: Bytes in an Arrow batch: rows may hold long texts or blocks of vectors, and a task holds a few batches at a time.
ARROW_BATCH = "16m"


def build_session(app: str = "lodestrata", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the library assumes: UTC and adaptive execution."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers, whatever directory they start in.

    The archive goes through Spark's own file server; nothing on the executors' local disks is assumed.
    """
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    key = sc.applicationId
    if key not in _SHIPPED:
        root = Path(__file__).resolve().parent
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(Path(root.name) / p.relative_to(root)))
        fd, name = tempfile.mkstemp(prefix="lodestrata-", suffix=".zip")
        with os.fdopen(fd, "wb") as f:
            f.write(buf.getvalue())
        sc.addPyFile(name)
        _SHIPPED.add(key)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a local session gets a folder of its own; on a cluster
    that would be wrong, so it is an error there."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.conf.get("spark.lodestrata.scratch", None)
        if not d:
            if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            d = "file://" + tempfile.mkdtemp(prefix="lodestrata-scratch-")
            spark.conf.set("spark.lodestrata.scratch", d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    _SCRATCH.append(f"{shared_dir(spark)}/lodestrata-{label}-{uuid.uuid4().hex}")
    return _SCRATCH[-1]


def _remove(spark: SparkSession, path: str) -> None:
    if path in _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(path)}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _SCRATCH.remove(path)


def release(spark: SparkSession) -> None:
    """Delete the scratch tables this process has written. Results that still read them must have been written or collected."""
    for path in list(_SCRATCH):
        _remove(spark, path)


def discard(df: DataFrame) -> None:
    """Delete one table that stage or stage_bucketed gave, when all that reads it has been written itself."""
    folders = {f.rsplit("/", 2)[1] for f in df.inputFiles()[:1]}
    for path in [p for p in _SCRATCH if p.rsplit("/", 1)[1] in folders]:
        _remove(df.sparkSession, path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for costly work per row: a table in fewer splits than there are cores (a single file, say) is dealt
    out evenly; any larger one is left as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def stage_bucketed(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Write df to the shared folder hash-bucketed by the keys: later joins and aggregations on them read it in place.

    A df that is already partitioned by the keys, as after an aggregation, isn't shuffled again.
    """
    spark = df.sparkSession
    n, name = parallelism(spark), f"lodestrata_{label}_{uuid.uuid4().hex}"
    placed, path = df.repartition(n, *keys), scratch_path(spark, label)
    placed.write.format("parquet").option("compression", "zstd").bucketBy(n, *keys).option("path", path).saveAsTable(name)
    _TABLES[path] = name
    return spark.table(name)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session: what partition counts here are derived from."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
