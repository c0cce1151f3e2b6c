"""Stored tables that are updated by key: upserts that rewrite touched buckets only, and a latest state that joins without a shuffle."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farescope.functions import DIFF_KEY
from farescope.operators.diff import current_state


class _Folder:
    """A folder in whatever file system Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        if not self.fs.exists(self._at("")):
            return []
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self._at("")))

    def holds(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Put a small file in place under a name that nobody has taken: written aside first, then renamed."""
        aside = self._at(f".{name}-{self.jvm.java.util.UUID.randomUUID()}")
        stream = self.fs.create(aside, False)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        if self.fs.exists(self._at(name)) or not self.fs.rename(aside, self._at(name)):
            self.fs.delete(aside, False)
            raise RuntimeError(f"another writer has published {name}; read the table again and repeat the batch")


class BucketTable:
    """A Parquet table cut into buckets by a hash of its key.

    A version is a small file that names a folder for every bucket. An upsert reads and writes only the buckets its batch
    touches, into a folder of its own, and then publishes the next version. Until that, and after a writer that failed,
    readers see the version before. A version has one line per bucket, whatever the table's size.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str], buckets: int = 64):
        self.spark, self.root, self.schema, self.keys, self.buckets = spark, root.rstrip("/"), schema, list(keys), buckets
        self.versions = _Folder(spark, f"{self.root}/versions")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def version(self) -> tuple[int, dict[int, str]]:
        names = [n for n in self.versions.names() if not n.startswith(".")]
        if not names:
            return 0, {}
        return int(names[-1]), {int(b): p for b, p in json.loads(self.versions.read(names[-1])).items()}

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The newest version, or some buckets of it."""
        _, paths = self.version()
        return self._rows([p for b, p in sorted(paths.items()) if buckets is None or b in set(buckets)])

    def _rows(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{p}" for p in paths])

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets of a batch: at most as many numbers as the table has buckets."""
        return sorted(r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect())

    def upsert(self, batch: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Merge a batch into the table and return the buckets it rewrote.

        ``merge`` gets the old rows of the touched buckets and those of the batch, and returns one row per key.
        """
        number, paths = self.version()
        touched = self.touched(batch)
        if not touched:
            return []
        names = [f.name for f in self.schema.fields]
        old = self._rows([paths[b] for b in touched if b in paths])
        rows = merge(old.select(names).unionByName(batch.select(names))).select(names)
        folder = f"data/{number + 1:08d}-{self.versions.jvm.java.util.UUID.randomUUID()}"
        # A bucket is one task's work and one file.
        dealt = rows.withColumn("bucket", self.bucket()).repartition(min(len(touched), self.buckets), "bucket")
        dealt.write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        after = paths | {b: f"{folder}/bucket={b}" for b in touched}
        self.versions.publish(f"{number + 1:08d}", json.dumps({str(b): p for b, p in sorted(after.items())}))
        return touched


class LatestState:
    """The latest known row per diff identity, bucketed and sorted by it, a table per version.

    A cycle is compared with the state where it lies: only the cycle's rows are shuffled, to the state's buckets, and the new
    state is written from the join without another shuffle. An identity is one text, in which a missing fare basis or brand is
    an empty one. Versions are folders; one counts when its writer has finished. Take at least as many buckets as there are
    shuffle partitions, or Spark deals both sides anew.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, buckets: int):
        self.spark, self.root, self.schema, self.buckets = spark, root.rstrip("/"), schema, buckets
        self.folder = _Folder(spark, self.root)

    @staticmethod
    def identity() -> Column:
        parts = [F.coalesce(k, F.lit("")) if k in ("fare_basis", "brand") else F.col(k).cast("string") for k in DIFF_KEY]
        return F.to_json(F.array(*parts), {"ignoreNullFields": "false"})

    def version(self) -> int:
        done = [n for n in self.folder.names() if n.startswith("v") and self.folder.holds(f"{n}/_SUCCESS")]
        return int(done[-1][1:]) if done else 0

    def _name(self, version: int) -> str:
        return f"state_{zlib.crc32(self.root.encode()):08x}_{version}"

    def table(self, version: int | None = None) -> DataFrame:
        """A version of the state as a bucketed table; the newest by default."""
        number = self.version() if version is None else version
        if not number:
            return self.spark.createDataFrame([], self._schema())
        name = self._name(number)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._schema().fields)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (identity) SORTED BY (identity) INTO {self.buckets} BUCKETS "
                           f"LOCATION '{self.root}/v{number:08d}'")
        return self.spark.table(name)

    def _schema(self) -> T.StructType:
        return T.StructType([T.StructField("identity", T.StringType()), *self.schema.fields])

    def _newest(self, rows: DataFrame) -> DataFrame:
        names = [f.name for f in self.schema.fields]
        keyed = rows.select(self.identity().alias("identity"), *names)
        return current_state(keyed, ["identity"]).select("identity", F.struct(*names).alias("c"))

    def pairs(self, rows: DataFrame, keep_known: bool = True) -> DataFrame:
        """Rows of a cycle with the known row of each identity, for ``diff_columns``; ``p`` or ``c`` is null without one.

        With ``keep_known`` an identity that the cycle lacks gives no pair; otherwise it gives one without ``c``.
        """
        names = [f.name for f in self.schema.fields]
        p = self.table().select("identity", F.struct(*names).alias("p"))
        c = self._newest(rows)
        return p.join(c, "identity", "right" if keep_known else "full").withColumn("detected_at", F.coalesce("c.captured_at", "p.captured_at"))

    def update(self, rows: DataFrame, keep_known: bool = True) -> int:
        """Write the state after a cycle as the next version and return its number. Without ``keep_known`` only the cycle's rows stay."""
        names, number = [f.name for f in self.schema.fields], self.version() + 1
        p = self.table().select("identity", F.struct(*names).alias("p"))
        c = self._newest(rows)
        joined = p.join(c, "identity", "full" if keep_known else "right")
        newer = F.when(F.col("c").isNull() | (F.col("p.captured_at") > F.col("c.captured_at")), F.col("p")).otherwise(F.col("c"))
        state = joined.select("identity", newer.alias("r")).select("identity", *[F.col(f"r.{n}").alias(n) for n in names])
        if number == 1:
            state = state.repartition(self.buckets, "identity")
        state.write.bucketBy(self.buckets, "identity").sortBy("identity").option("path", f"{self.root}/v{number:08d}").mode("overwrite").saveAsTable(
            self._name(number))
        return number
