"""Duplicates hidden by formatting differences: an incremental ledger of canonical keys.

The ledger holds, bucketed by canonical key, the number of copies and the
earliest (smallest) id of each key. A batch is aggregated to (key, copies,
smallest id), full-outer-joined with the buckets that it touches, counts are
added and the earliest representative is kept. Ids already counted are held in
buckets of their own, so an id delivered again adds nothing. The number of buckets
follows the size that the ledger is made for; a later session opens it again.

Defined results: a null, empty or blank attribute is the same empty value; all
that is neither letter nor digit is removed after lower-casing, words of the
name are split at white space and sorted; records whose three attributes are
all empty are copies of each other; rows without id are ignored; an id that
returns with other attributes keeps its first key; no rows give an empty
ledger; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from goldenloom.session import Scratch, table

#: Ledger buckets at least, and rows of a bucket at most.
BUCKETS, ROWS = 16, 5_000_000
LEDGER = "key binary, copies bigint, keep_id string"


def bare(text: Column) -> Column:
    """Letters and digits of the lower-cased text."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", "")


def bare_words(text: Column) -> Column:
    """Sorted words of the lower-cased text, punctuation removed before the words are split."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}\s]", "")
    words = F.filter(F.split(kept, r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def canonical_key(name: Column, email: Column, phone: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws("\u0001", bare_words(name), bare(email), bare(phone)), 256))


class Ledger:
    """Folders of counted keys and seen ids by bucket, and a manifest that names the current folder of each bucket.

    ``add`` reads and rewrites only the buckets of keys that a batch touches; ids are appended, and only the touched buckets of ids are read. A batch
    counts when the manifest has been replaced, so one that is cut off leaves the ledger as it was. ``Ledger.open`` goes on with a ledger of an
    earlier session.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.version, self.counted, self.seen = 0, {}, {}

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: int) -> Ledger:
        """An empty ledger for about so many rows."""
        return cls(spark, path, max(BUCKETS, -(-rows // ROWS)))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Ledger:
        found = json.loads(spark.read.text(f"{path.rstrip('/')}/manifest.json", wholetext=True).first()[0])
        out = cls(spark, path, found["buckets"])
        out.version = found["version"]
        out.counted, out.seen = ({int(k): v for k, v in found[n].items()} for n in ("counted", "seen"))
        return out

    def _commit(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        new, old = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}") for n in ("manifest.new", "manifest.json"))
        fs = old.getFileSystem(conf)
        text = json.dumps({"buckets": self.buckets, "version": self.version, "counted": self.counted, "seen": self.seen})
        out = fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.exists(old):
            fs.delete(old, False)
        fs.rename(new, old)

    def bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, kind: str, key: str) -> list[int]:
        """Writes rows by bucket into a new folder; the buckets that it holds."""
        path = f"{self.path}/{kind}/v{self.version}"
        df.withColumn("b", self.bucket(key)).repartition("b", key).write.mode("overwrite").partitionBy("b").parquet(path)
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        names = [f.getPath().getName() for f in folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)]
        return [int(n[2:]) for n in names if n.startswith("b=")]

    def add(self, batch: DataFrame) -> None:
        """Counts the ids of ``batch`` (id, key) that no earlier batch held."""
        self.version += 1
        fresh = batch.groupBy("id").agg(F.min("key").alias("key"))
        if self.seen:
            touched = [r[0] for r in fresh.select(self.bucket("id")).distinct().collect()]
            known = self._read([f"{self.path}/ids/v{v}/b={k}" for k in touched for v in self.seen.get(k, ())], "id string")
            fresh = fresh.join(known, "id", "left_anti")
        for k in self._write(fresh, "ids", "id"):
            self.seen.setdefault(k, []).append(self.version)
        own = [f"{self.path}/ids/v{self.version}/b={k}" for k, v in self.seen.items() if v[-1] == self.version]
        new = self._read(own, "id string, key binary").groupBy("key").agg(F.count("*").alias("add"), F.min("id").alias("first"))
        touched = [r[0] for r in new.select(self.bucket("key")).distinct().collect()]
        old = self._read([f"{self.path}/keys/v{self.counted[k]}/b={k}" for k in touched if k in self.counted], LEDGER)
        merged = old.join(new, "key", "full_outer").select(
            "key", (F.coalesce("copies", F.lit(0)) + F.coalesce("add", F.lit(0))).alias("copies"), F.least("keep_id", "first").alias("keep_id")
        )
        for k in self._write(merged, "keys", "key"):
            self.counted[k] = self.version
        self._commit()

    def counts(self) -> DataFrame:
        """key, copies, keep_id of all keys."""
        return self._read([f"{self.path}/keys/v{v}/b={k}" for k, v in sorted(self.counted.items())], LEDGER)


def copies(customers: DataFrame) -> DataFrame:
    """keep_id, copies of each set of two or more; batches are the years in which rows arrived."""
    spark = customers.sparkSession
    scratch = Scratch(spark, "ledger")
    keyed = customers.where("id IS NOT NULL").select(
        "id", canonical_key(F.col("name"), F.col("email"), F.col("phone")).alias("key"), F.coalesce(F.year("ingested_at"), F.lit(0)).alias("batch")
    )
    keyed, seen = scratch.save_and(keyed, "keyed", F.count(F.lit(1)).alias("rows"))
    ledger = Ledger.create(spark, scratch.path("ledger"), seen["rows"])
    for year in sorted(r["batch"] for r in keyed.select("batch").distinct().collect()):
        ledger.add(keyed.where(F.col("batch") == year).select("id", "key"))
    return ledger.counts().where("copies >= 2").select("keep_id", "copies")


QUERIES = {"p3_found": lambda spark, d: copies(table(spark, d, "customers"))}

ORACLES = {
    "p3_found": r"""
WITH k AS (
  SELECT id,
    array_to_string(list_sort(list_filter(regexp_split_to_array(
        regexp_replace(lower(coalesce(name, '')), '[^\p{L}\p{N}\s\x{85}\p{Z}]', '', 'g'), '[\s\x{85}\p{Z}]+'),
        lambda w: w <> '')), ' ') AS n,
    regexp_replace(lower(coalesce(email, '')), '[^\p{L}\p{N}]', '', 'g') AS e,
    regexp_replace(lower(coalesce(phone, '')), '[^\p{L}\p{N}]', '', 'g') AS p
  FROM customers WHERE id IS NOT NULL
), i AS (SELECT DISTINCT id, n, e, p FROM k)
SELECT min(id) AS keep_id, count(*) AS copies FROM i GROUP BY n, e, p HAVING count(*) >= 2""",
}
