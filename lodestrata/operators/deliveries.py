"""Messages delivered more than once (at-least-once transport): keep exactly one copy of each.

Storage is a set of sorted runs, hash-bucketed by message identity, one file per bucket, and a log of versions that names the runs.
An arriving batch is an idempotent upsert: it is reduced to one row per identity before it is shuffled and becomes one run.
Compaction merges two runs at a time, bucket by bucket: a sort-merge join reads both in their stored order, without a shuffle or a sort, and equal identities
collapse. Any process can open the log by its path.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import parallelism, scratch_path

#: The customary spellings of a UUID around its 32 hexadecimal digits.
UUID_FORM = r"^(?:urn:)?(?:uuid:)?[\{\(]?([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})[\}\)]?$"

IDENTITY = ["id_kind", "id_key"]


def canonical_id(c: Column) -> Column:
    """An id without the blanks around it, a UUID in its lower-case hyphenated spelling; null where nothing is left."""
    t = F.regexp_replace(c, r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$", "")
    low = F.lower(t)
    u = F.regexp_replace(low, UUID_FORM, "$1-$2-$3-$4-$5")
    return F.when(F.length(t) == 0, F.lit(None)).when(low.rlike(UUID_FORM), u).otherwise(t)


def with_identity(df: DataFrame, request: str = "request_id", correlation: str = "correlation_id", delivery: str = "delivery_id") -> DataFrame:
    """Adds id_kind and id_key: the request id (kind r); without one the correlation id (c); without both the delivery
    itself (d), so that such a row equals no other."""
    r, k = canonical_id(F.col(request)), canonical_id(F.col(correlation))
    kind = F.when(r.isNotNull(), F.lit("r")).when(k.isNotNull(), F.lit("c")).otherwise(F.lit("d"))
    return df.withColumns({"id_kind": kind, "id_key": F.coalesce(r, k, F.col(delivery).cast("string"))})


class DeliveryLog:
    """Hash-bucketed, sorted storage of the earliest delivery of each identity.

    Every change writes a new version file that lists the runs; it is created only if it doesn't exist yet, so of two processes
    that change the log at once the later one starts again from the other's version. What no version lists is not part of the log.

    :param path: folder that all executors share; by default a new one below the session's shared folder. A log that is there is opened.
    :param buckets: number of hash buckets, fixed for the life of the log; by default the session's shuffle partitions.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, (path or scratch_path(spark, "deliveries")).rstrip("/")
        # runs are read in their stored order
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self._tables: dict[str, str] = {}
        state = self._read()
        self.buckets = state["buckets"] if state else buckets or parallelism(spark)
        if not state:
            self._commit(0, {"buckets": self.buckets, "runs": [], "batches": [], "schema": ""})

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DeliveryLog:
        """The log that is stored in a folder; an error if there is none."""
        log = cls.__new__(cls)
        log.spark, log.path = spark, path.rstrip("/")
        if not log._read():
            raise ValueError(f"no delivery log in {path}")
        log.__init__(spark, path)
        return log

    # versions

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path
        return p, p(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _version(self) -> int:
        p, fs = self._fs()
        folder = p(f"{self.path}/_versions")
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=-1)

    def _read(self) -> dict | None:
        n = self._version()
        if n < 0:
            return None
        p, fs = self._fs()
        f = fs.open(p(f"{self.path}/_versions/{n:08}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")) | {"version": n}
        finally:
            f.close()

    def _commit(self, version: int, state: dict) -> bool:
        """Write a version in one step; False if another process has written it first."""
        p, fs = self._fs()
        part = p(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        out = fs.create(part)
        out.write(bytearray(json.dumps({k: v for k, v in state.items() if k != "version"}).encode()))
        out.close()
        at = p(f"{self.path}/_versions/{version:08}.json")
        done = not fs.exists(at) and fs.rename(part, at)
        if not done:
            fs.delete(part, False)
        return done

    @property
    def runs(self) -> int:
        return len(self._read()["runs"])

    # runs

    def _write(self, df: DataFrame) -> str:
        """A new run from rows that lie in their buckets' partitions; returns its name."""
        name = f"run_{uuid.uuid4().hex}"
        w = df.write.format("parquet").bucketBy(self.buckets, *IDENTITY).sortBy(*IDENTITY)
        w.option("path", f"{self.path}/{name}").saveAsTable(f"lodestrata_{name}")
        self._tables[name] = f"lodestrata_{name}"
        return name

    def _run(self, name: str) -> DataFrame:
        if name not in self._tables:
            keys = ", ".join(IDENTITY)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS lodestrata_{name} ({self._read()['schema']}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self._tables[name] = f"lodestrata_{name}"
        return self.spark.table(self._tables[name])

    def _merged(self, a: str, b: str) -> DataFrame:
        """Two sorted runs as one, in the buckets' partitions."""
        x = self._run(a).select(*[F.col(c).alias(f"x_{c}") for c in IDENTITY], F.struct("unknown", "received_at", "delivery_id").alias("x"))
        y = self._run(b).select(*[F.col(c).alias(f"y_{c}") for c in IDENTITY], F.struct("unknown", "received_at", "delivery_id").alias("y"))
        on = (F.col("x_id_kind") == F.col("y_id_kind")) & (F.col("x_id_key") == F.col("y_id_key"))
        j = x.hint("merge").join(y.hint("merge"), on, "full")
        return j.select(*[F.coalesce(f"x_{c}", f"y_{c}").alias(c) for c in IDENTITY], F.least("x", "y").alias("first")).select(*IDENTITY, "first.*")

    def upsert(self, batch: DataFrame, batch_id: str | None = None) -> DeliveryLog:
        """Add one batch (identity columns, received_at, delivery_id) as a sorted run: one file per bucket. Adding a batch again
        changes nothing in the result; one whose batch_id the log has is not even read. A hot identity shrinks to one row per input partition
        before the shuffle."""
        if batch_id is not None and batch_id in self._read()["batches"]:
            return self
        # a null received_at sorts after every known time
        first = F.min(F.struct(F.col("received_at").isNull().alias("unknown"), "received_at", "delivery_id"))
        rows = batch.groupBy(*IDENTITY).agg(first.alias("first")).select(*IDENTITY, "first.*")
        name = self._write(rows.repartition(self.buckets, *IDENTITY))  # the layout of the buckets
        while True:
            state = self._read()
            batches = [*state["batches"], batch_id] if batch_id is not None else state["batches"]
            if self._commit(state["version"] + 1, state | {"runs": [*state["runs"], name], "batches": batches, "schema": state["schema"] or rows.schema.toDDL()}):
                return self

    def compact(self) -> DeliveryLog:
        """Merge the runs, the two newest first, so that the oldest and largest is read once, until one is left; forget the old ones. A merge that another process overtakes is dropped."""
        while True:
            state = self._read()
            if len(state["runs"]) < 2:
                return self
            a, b = state["runs"][-2:]
            name = self._write(self._merged(a, b))
            now = self._read()
            left = [r for r in now["runs"] if r not in (a, b)]
            gone = [a, b] if len(left) == len(now["runs"]) - 2 and self._commit(now["version"] + 1, now | {"runs": [*left, name]}) else [name]
            for r in gone:
                self._forget(r)

    def current(self) -> DataFrame:
        """One row per identity over all runs: id_kind, id_key, received_at, delivery_id. More than two runs are compacted first."""
        runs = self._read()["runs"]
        if len(runs) > 2:
            runs = self.compact()._read()["runs"]
        if not runs:
            return self.spark.createDataFrame([], "id_kind string, id_key string, received_at timestamp_ntz, delivery_id bigint")
        return (self._run(runs[0]) if len(runs) == 1 else self._merged(*runs[:2])).drop("unknown")

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS lodestrata_{name}")
        self._tables.pop(name, None)
        p, fs = self._fs()
        fs.delete(p(f"{self.path}/{name}"), True)

    def close(self) -> None:
        """Take the runs' names out of the session's catalogue; the log itself stays."""
        for t in self._tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self._tables.clear()

    def drop(self) -> None:
        """Delete the log with all runs."""
        self.close()
        p, fs = self._fs()
        fs.delete(p(self.path), True)


def surplus_deliveries(df: DataFrame, runs: int = 2) -> DataFrame:
    """delivery_id of every delivery that is a later copy of another one.

    The copy with the earliest received_at stays, then the smallest delivery_id. Rows are upserted in ``runs`` batches
    (by hash of the delivery id, as a stream would bring them), compacted, and all deliveries without the survivors are
    the result; that last step joins on the unique delivery_id, so that an identity with a third of all rows is spread
    evenly. Nulls: see with_identity; a null received_at loses against any time. A null delivery_id is no row of the
    result. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = with_identity(df.select("request_id", "correlation_id", "delivery_id", "received_at").filter(F.col("delivery_id").isNotNull()))
    rows = rows.select(*IDENTITY, "received_at", "delivery_id")
    log = DeliveryLog(spark)
    for k in range(runs):
        log.upsert(rows.filter(F.pmod(F.xxhash64("delivery_id"), F.lit(runs)) == k))
    log.compact()
    return rows.select("delivery_id").join(log.current().select("delivery_id"), "delivery_id", "left_anti")


def kept_deliveries(df: DataFrame) -> DataFrame:
    """The survivors: identity, received_at and delivery_id."""
    rows = with_identity(df.select("request_id", "correlation_id", "delivery_id", "received_at").filter(F.col("delivery_id").isNotNull()))
    return DeliveryLog(df.sparkSession).upsert(rows.select(*IDENTITY, "received_at", "delivery_id")).current()
