"""Tables in the shared folder: written frames, an append-only ledger by batches, and keyed tables that are merged by bucket."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.upsert import upsert

#: Spark's setting that shuffle files go when a query is over instead of when the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What `written` has written inside the innermost `settled`.
_on_the_way: ContextVar[list[DataFrame] | None] = ContextVar("on_the_way", default=None)


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    """A folder of its own under spark.checkpoint.dir; only a local session without that setting gets one in /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    path = f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    fs, p = _file(spark, path)
    fs.deleteOnExit(p)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table of its own, until the session ends: read again instead of computed again, and kept if executors are lost.
    The shuffle files behind it are deleted, as nothing reads them any more."""
    spark = df.sparkSession
    path, before = new_folder(spark), spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._folder = path
    if (tables := _on_the_way.get()) is not None:
        tables.append(table)
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing reads any more."""
    for t in tables:
        fs, p = _file(t.sparkSession, t._folder)
        fs.delete(p, True)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """make() as a written table; the tables that it wrote on its way are deleted."""
    mark = _on_the_way.set([])
    try:
        out = written(make())
        discard(*[t for t in _on_the_way.get() if t is not out])
    finally:
        _on_the_way.reset(mark)
    if (tables := _on_the_way.get()) is not None:
        tables.append(out)
    return out


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _create(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole under its name, or fails if the name is taken."""
    fs, p = _file(spark, path)
    made = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(made, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p) or not fs.rename(made, p):
        fs.delete(made, False)
        raise FileExistsError(path)


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _file(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


class Ledger:
    """S-6: an append-only table of batches. A batch has a name; its rows count once its marker is there, which is made last. A second
    append of a batch is refused, as is every other change; what an append left that was lost on its way is not read, and goes
    when the batch is appended again."""

    def __init__(self, spark: SparkSession, path: str, by: str = "seen_at", unit: str = "day"):
        self.spark, self.path, self.by, self.unit = spark, path.rstrip("/"), by, unit

    def batches(self) -> list[str]:
        return [n.removesuffix(".json") for n in _names(self.spark, f"{self.path}/batches") if n.endswith(".json")]

    def append(self, rows: DataFrame, batch: str) -> None:
        """Rows in folders by date (or by the first day of its month or year: `unit`). They are brought together by folder first,
        so that an append adds few files; a large folder is split again."""
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError("a batch is named by letters, digits, hyphens and underscores")
        if batch in self.batches():
            raise FileExistsError(f"batch {batch} is in the ledger, which is append-only")
        data = f"{self.path}/data/batch={batch}/try={uuid.uuid4().hex}"
        stem = self.by.removesuffix("_at")
        name = f"{stem}_{'date' if self.unit == 'day' else self.unit}"
        dated = rows.withColumn(f"{stem}_date", F.to_date(self.by)).withColumn(name, F.to_date(F.date_trunc(self.unit, self.by)))
        dated.hint("rebalance", name).write.mode("errorifexists").partitionBy(name).parquet(data)
        _create(self.spark, f"{self.path}/batches/{batch}.json", json.dumps({"data": data}))

    def read(self) -> DataFrame:
        """The rows of all batches that are whole, with their batch. Fails on an empty ledger, which has no columns."""
        if not (whole := self.batches()):
            raise FileNotFoundError(f"no batch in {self.path}")
        found = [json.loads(self.spark.read.text(f"{self.path}/batches/{b}.json", wholetext=True).first().value)["data"] for b in whole]
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*found).drop("try")


class KeyedTable:
    """U-1 on files: rows in buckets by the hash of their key, and a list of the folders that make up a version.

    A merge reads and writes only the buckets of its new rows; the new version is published by one file that is made last, so that readers
    see the version before or the one after, and a merge that is lost on its way leaves nothing that is read. A batch that a version
    holds already is not merged again. Two merges at once: the second finds its version's name taken and fails.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def state(self) -> dict:
        """version, folders (bucket -> folder) and batches of the last version: as many entries as buckets."""
        versions = [n for n in _names(self.spark, f"{self.path}/versions") if n.endswith(".json")]
        if not versions:
            return {"version": 0, "folders": {}, "batches": [], "schema": None}
        return json.loads(self.spark.read.text(f"{self.path}/versions/{versions[-1]}", wholetext=True).first().value)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        state = self.state()
        if not state["schema"]:
            raise FileNotFoundError(f"no version in {self.path}")
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(state["schema"])
        found = [f for b, f in state["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def merge(self, new: DataFrame, order: list[Column], batch: str) -> list[int]:
        """Puts new rows in the place of old ones by key (of several new rows the first in order counts); the buckets that were written."""
        state = self.state()
        if batch in state["batches"]:
            return []
        new = written(new.withColumn("_bucket", self._bucket()))
        touched = sorted(r._bucket for r in new.select("_bucket").distinct().collect())  # at most `buckets` numbers
        fresh = new.drop("_bucket")
        old = self.read(touched) if state["schema"] else self.spark.createDataFrame([], fresh.schema)
        rows = upsert(old, fresh.select(*old.columns), self.keys, order).drop("is_new").withColumn("_bucket", self._bucket())
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.hint("rebalance", "_bucket").write.mode("errorifexists").partitionBy("_bucket").parquet(folder)
        folders = state["folders"] | {str(b): f"{folder}/_bucket={b}" for b in touched}
        after = {"version": state["version"] + 1, "folders": folders, "batches": [*state["batches"], batch], "schema": old.schema.jsonValue()}
        _create(self.spark, f"{self.path}/versions/{after['version']:012d}.json", json.dumps(after))
        return touched
