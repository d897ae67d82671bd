"""Tables kept by key: rows in hash buckets, changed by adding snapshots.

A bucket's rows lie in parts. A change looks at the buckets of its keys only, writes new parts and then one
small list, the snapshot: which parts make up which bucket. Whoever reads sees the last whole snapshot, so a
change that fails half-way shows nothing, and one that is run again finds its keys there and changes nothing.
Inserted rows are a part of their own; a bucket with more than ``MOST_PARTS`` is written anew as one, so the
files that a change reads do not grow with the number of changes before it. One writer at a time.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
MOST_PARTS = 4
_BUCKET = "bucket"


class Part(NamedTuple):
    bucket: int
    part: str
    rows: int


class KeyedStore:
    """Rows of one schema by one key column.

    The key is unique, unless rows were given to :meth:`add`, which does not look. Rows with a null key are left
    out by the other changes.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType | str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if _BUCKET in self.schema.fieldNames():
            raise ValueError(f"no column may be called {_BUCKET}")

    # --- reading ---------------------------------------------------------------------------------------

    def snapshots(self) -> list[int]:
        """Numbers of the whole snapshots; folder names only, no rows are read."""
        try:
            found = self._lists().select("snapshot").distinct().collect()
        except AnalysisException as problem:
            if "PATH_NOT_FOUND" not in str(problem) and "UNABLE_TO_INFER_SCHEMA" not in str(problem):
                raise
            return []
        return sorted(r.snapshot for r in found)

    def _lists(self) -> DataFrame:
        return self.spark.read.schema("bucket int, part string, rows long, snapshot long").parquet(f"{self.path}/snapshots")

    def parts(self, snapshot: int | None = None) -> list[Part]:
        """The parts of the last snapshot or a given one: at most ``buckets`` times ``MOST_PARTS`` short entries."""
        known = self.snapshots() if snapshot is None else [snapshot]
        if not known:
            return []
        rows = self._lists().where(F.col("snapshot") == known[-1]).collect()
        return sorted(Part(r.bucket, r.part, r.rows) for r in rows if r.part)

    def read(self, buckets: list[int] | None = None, snapshot: int | None = None) -> DataFrame:
        """All rows, or those of some buckets; no other bucket's files are opened."""
        return self._read(self.parts(snapshot), buckets)

    def _read(self, parts: list[Part], buckets: list[int] | None = None) -> DataFrame:
        wanted = None if buckets is None else set(buckets)
        places = [f"{self.path}/rows/part={p.part}/{_BUCKET}={p.bucket}" for p in parts
                  if p.rows and (wanted is None or p.bucket in wanted)]
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*places).select(*self.schema.fieldNames())

    def matching(self, keys: DataFrame) -> DataFrame:
        """Rows whose key is among ``keys``, from the buckets of these only."""
        return self.read(self.buckets_of(keys)).join(keys.select(self.key), self.key, "left_semi")

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """Buckets of the keys: at most ``buckets`` numbers."""
        return [r[0] for r in rows.where(F.col(self.key).isNotNull()).select(self.bucket_of(F.col(self.key))).distinct().collect()]

    # --- changing --------------------------------------------------------------------------------------

    def _shaped(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])

    def _one_each(self, rows: DataFrame) -> DataFrame:
        """One row of each key: of several the one with the smallest hash, so that a run again takes the same."""
        rest = [c for c in self.schema.fieldNames() if c != self.key]
        if not rest:
            return rows.where(F.col(self.key).isNotNull()).distinct()
        return (rows.where(F.col(self.key).isNotNull()).groupBy(self.key)
                .agg(F.min_by(F.struct(*rest), F.xxhash64(*[F.to_json(F.struct(c)) for c in rest])).alias("row"))
                .select(self.key, "row.*").select(*self.schema.fieldNames()))

    def _write(self, rows: DataFrame) -> list[Part]:
        """A new part; one file for each bucket in it, as buckets are even."""
        name = uuid.uuid4().hex
        folder = f"{self.path}/rows/part={name}"
        (rows.withColumn(_BUCKET, self.bucket_of(F.col(self.key)))
         .repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(folder))
        try:
            counts = self.spark.read.schema(f"{_BUCKET} int").parquet(folder).groupBy(_BUCKET).count().collect()
        except AnalysisException as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            counts = []
        return [Part(r[_BUCKET], name, r["count"]) for r in counts]

    def _commit(self, parts: list[Part]) -> None:
        known = self.snapshots()
        # an empty store keeps one entry without a part, so that its snapshot can be read
        entries = [(p.bucket, p.part, p.rows) for p in parts] or [(-1, None, 0)]
        (self.spark.createDataFrame(entries, "bucket int, part string, rows long").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/snapshots/snapshot={(known[-1] if known else 0) + 1}"))

    def add(self, rows: DataFrame) -> DataFrame:
        """Store rows without a look at what is there; gives these rows. Without any, no snapshot is added."""
        known, added = self.parts(), self._write(self._shaped(rows))
        if added:
            self._commit(self._compacted([*known, *added]))
        return self._read(added)

    def insert_new(self, rows: DataFrame) -> DataFrame:
        """Store the rows whose key is not there yet; gives these rows."""
        there = self.read(self.buckets_of(rows)).select(self.key)
        return self.add(self._one_each(self._shaped(rows)).join(there, self.key, "left_anti"))

    def _compacted(self, parts: list[Part]) -> list[Part]:
        many = {b for b in {p.bucket for p in parts} if sum(p.bucket == b for p in parts) > MOST_PARTS}
        if not many:
            return parts
        return [p for p in parts if p.bucket not in many] + self._write(self._read(parts, list(many)))

    def upsert(self, rows: DataFrame) -> DataFrame:
        """Store rows that are new or differ from the stored row of their key; gives these rows.

        Only buckets with such rows are written; if there is none, no snapshot is added.
        """
        known = self.parts()
        touched = self.buckets_of(rows)
        whole = F.struct(*self.schema.fieldNames())
        old = self._read(known, touched).select(F.col(self.key), F.to_json(whole, {"ignoreNullFields": "false"}).alias("old"))
        changed = (self._one_each(self._shaped(rows)).join(old, self.key, "left")
                   .where(~F.col("old").eqNullSafe(F.to_json(whole, {"ignoreNullFields": "false"}))).drop("old"))
        added = self._write(changed)
        if added:
            self._commit(self._without(known, self._read(added).select(self.key), {p.bucket for p in added}) + added)
        return self._read(added)

    def delete(self, keys: DataFrame) -> int:
        """Remove the rows of the keys; gives their number. Only buckets that hold such rows are written."""
        known = self.parts()
        touched = self.buckets_of(keys)
        there = self._read(known, touched).select(self.key).join(keys.select(self.key).distinct(), self.key, "left_semi")
        hit = there.groupBy(self.bucket_of(F.col(self.key)).alias(_BUCKET)).count().collect()  # a number a bucket
        if hit:
            self._commit(self._without(known, keys.select(self.key).distinct(), {r[_BUCKET] for r in hit}))
        return sum(r["count"] for r in hit)

    def _without(self, known: list[Part], keys: DataFrame, buckets: set[int]) -> list[Part]:
        """The parts, with these buckets written anew without the keys."""
        if not any(p.bucket in buckets for p in known):
            return known
        kept = self._write(self._read(known, list(buckets)).join(keys, self.key, "left_anti"))
        return [p for p in known if p.bucket not in buckets] + kept
