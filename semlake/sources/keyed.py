"""A keyed table with commits: hash buckets, copy on write, and a ledger of the epochs that are in it.

``path/data`` holds Parquet folders that are never changed, ``path/commits`` one small file for each version: for every
bucket the folder that holds it (or several, with commas between), the last epoch of each writer, and the schema.  A merge writes the buckets that it
changes anew (a table whose rows are never replaced gets a further folder for their new rows instead, up to ``FOLDERS`` a
bucket) and then creates the next commit file, which fails if another writer has created it.  So a reader sees whole
versions only, a merge that dies before its commit leaves the table as it was, and an epoch that is played again changes
nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from semlake.sources.scratch import dropped, freed_shuffles, stored

BUCKETS = 64
#: Folders of a bucket, at most, before one takes their place.
FOLDERS = 16


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass
class Commit:
    version: int = 0
    buckets: dict[str, str] = field(default_factory=dict)
    epochs: dict[str, int] = field(default_factory=dict)
    schema: str | None = None
    #: Whatever else a writer keeps with a version.
    more: dict[str, object] = field(default_factory=dict)


class Commits:
    """Numbered commit files of a folder, created once each, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, f"{path.rstrip('/')}/commits"

    def _at(self, name: str = ""):  # noqa: ANN202
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder + ("/" + name if name else ""))
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def latest(self) -> Commit:
        fs, path = self._at()
        if not fs.exists(path):
            return Commit()
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        versions = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not versions:
            return Commit()
        rows = self.spark.read.text(f"{self.folder}/{max(versions):012d}.json", wholetext=True).collect()
        return Commit(**json.loads(rows[0]["value"]))

    def add(self, commit: Commit) -> None:
        """Written whole under another name, then renamed to its number, which must be free."""
        fs, draft = self._at(f".{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(commit.__dict__).encode()))
        out.close()
        _, final = self._at(f"{commit.version:012d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"version {commit.version} of {self.folder} is there already")


class KeyedTable:
    """Rows by ``key``; ``guard`` is a column whose equal value means that nothing changed, ``newer`` one by which an
    older row never replaces a newer one."""

    def __init__(self, spark: SparkSession, path: str, key: str | list[str], guard: str | None = None, newer: str | None = None, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), [key] if isinstance(key, str) else list(key)
        self.guard, self.newer, self.buckets = guard, newer, buckets
        self.commits = Commits(spark, path)

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _rows(self, commit: Commit, buckets: list[int] | None = None) -> DataFrame | None:
        paths = [f"{self.path}/data/{folder}/_bucket={b}" for b, folders in commit.buckets.items() if buckets is None or int(b) in buckets for folder in folders.split(",")]
        if commit.schema is None:
            return None
        schema = StructType.fromJson(json.loads(commit.schema))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The latest version (an error if there is none)."""
        rows = self._rows(self.commits.latest())
        if rows is None:
            raise FileNotFoundError(f"no version of {self.path}")
        return rows

    def merge(self, rows: DataFrame, epoch: int | None = None, writer: str = "batch", scattered: bool = False) -> int:
        """Put rows in by key -> how many were new or changed.

        Of rows with one key the newest counts (of equal ones the largest).  Rows equal to the stored one by ``guard`` and
        rows older than it by ``newer`` are left out.  A row with a null key is an error.  With an ``epoch``, one that is
        not after the writer's last is left out whole.

        Where the guard is the key, rows are only added.  There ``scattered`` says that rows belong to nearly all buckets:
        keys of all of them are then compared in the one exchange that brings the rows to their buckets.
        """
        commit = self.commits.latest()
        if epoch is not None and epoch <= commit.epochs.get(writer, -1):
            return 0
        rest = [c for c in rows.columns if c not in self.keys]
        order = ([F.col(self.newer)] if self.newer else []) + [F.struct(*rest)]
        one = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")) if rest else rows.distinct()
        one = one.select(*self.keys, "r.*").select(*rows.columns) if rest else one
        clash = F.coalesce(F.assert_true(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in self.keys)), F.lit("a row without a key")).cast("int"), self._bucket())
        fixed = self.guard is not None and self.keys == [self.guard]
        mixed = fixed and commit.schema is not None and not self._fits(commit, rows)
        if fixed and scattered and rest and not mixed and all(x.count(",") < FOLDERS - 1 for x in commit.buckets.values()):
            return self._added(commit, rows.withColumn("_bucket", clash), rest, order, epoch, writer)
        incoming = stored(one.withColumn("_bucket", clash), "incoming")
        mine = [incoming]
        old = self._rows(commit, [r[0] for r in incoming.select("_bucket").distinct().collect()] if commit.schema else None)
        # where the guard is the key, a key that is there is never changed: only keys are compared, and no row is replaced
        if old is not None and fixed:
            incoming = stored(incoming.join(old.select(*self.keys), self.keys, "left_anti").select(*rows.columns, "_bucket"), "changed")
        elif old is not None:
            there = old.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], F.lit(1).alias("_there"), (F.col(self.guard) if self.guard else F.lit(None)).alias("_guard"), (F.col(self.newer) if self.newer else F.lit(None)).alias("_newer"))
            joined = incoming.join(there, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(self.keys)], "left")
            same = F.col("_there").isNotNull() & (F.col("_guard").eqNullSafe(F.col(self.guard)) if self.guard else F.lit(False))
            stale = F.coalesce(F.col("_newer") > F.col(self.newer), F.lit(False)) if self.newer else F.lit(False)
            incoming = stored(joined.filter(~same & ~stale).select(*rows.columns, "_bucket"), "changed")
        touched = {r["_bucket"]: r["n"] for r in incoming.groupBy("_bucket").agg(F.count("*").alias("n")).collect()}
        mine += [incoming] if old is not None else []
        if not touched and epoch is None and commit.schema:
            dropped(*mine)
            return 0
        merged, whole = incoming, list(touched)
        if fixed and not mixed:  # new rows go beside the old ones
            whole = [b for b in touched if commit.buckets.get(str(b), "").count(",") >= FOLDERS - 1]
        if old is not None and whole:
            kept = self._rows(commit, whole)
            kept = kept if fixed else kept.join(incoming.select(*self.keys), self.keys, "left_anti")
            merged = kept.withColumn("_bucket", self._bucket()).unionByName(incoming, allowMissingColumns=True)
        data = f"{commit.version + 1:012d}-{uuid.uuid4().hex}"
        if touched:
            with freed_shuffles(self.spark):
                merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{data}")
        dropped(*mine)
        self._commit(commit, data, touched, whole, merged.drop("_bucket").schema, epoch, writer)
        return sum(touched.values())

    def _fits(self, commit: Commit, rows: DataFrame) -> bool:
        """The stored columns that ``rows`` have too are of the same types, so files of both read as one table."""
        new = {f.name: f.dataType for f in rows.schema}
        return all(new.get(f.name, f.dataType) == f.dataType for f in StructType.fromJson(json.loads(commit.schema)))

    def _commit(self, commit: Commit, data: str, touched: dict[int, int], whole: list[int], schema: StructType, epoch: int | None, writer: str) -> None:
        """``data`` holds the touched buckets: those of ``whole`` entirely, of others what comes to their folders."""
        old = StructType.fromJson(json.loads(commit.schema)).fields if commit.schema else []
        schema = StructType(old + [f for f in schema if f.name not in {x.name for x in old}]) if len(whole) < len(touched) else schema
        places = {str(b): data if b in whole or str(b) not in commit.buckets else f"{commit.buckets[str(b)]},{data}" for b in touched}
        after = Commit(commit.version + 1, commit.buckets | places, commit.epochs | ({writer: epoch} if epoch is not None else {}), schema.json() if touched or commit.schema is None else commit.schema, commit.more)
        self.commits.add(after)

    def _added(self, commit: Commit, rows: DataFrame, rest: list[str], order: list[Column], epoch: int | None, writer: str) -> int:
        """New keys of ``rows(_bucket, ...)`` are written to a further folder, with one exchange of rows and stored keys."""
        met = rows.withColumn("_old", F.lit(False))
        old = self._rows(commit) if commit.buckets else None
        if old is not None:
            met = met.unionByName(old.select(self._bucket().alias("_bucket"), *self.keys, F.lit(True).alias("_old")), allowMissingColumns=True)
        new = met.repartition("_bucket").groupBy("_bucket", *self.keys).agg(F.max("_old").alias("_old"), F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        new = new.filter(~F.col("_old")).select("_bucket", *self.keys, "_r.*").select(*rows.columns)
        data = f"{commit.version + 1:012d}-{uuid.uuid4().hex}"
        with freed_shuffles(self.spark):
            new.write.partitionBy("_bucket").parquet(f"{self.path}/data/{data}")
        written = self.spark.read.schema(new.select(*self.keys, "_bucket").schema).parquet(f"{self.path}/data/{data}")
        touched = {r["_bucket"]: r["n"] for r in written.groupBy("_bucket").agg(F.count("*").alias("n")).collect()}
        if touched or epoch is not None or commit.schema is None:
            self._commit(commit, data, touched, [], new.drop("_bucket").schema, epoch, writer)
        return sum(touched.values())


class Ledger:
    """Keys that were seen once, for ever: a keyed table with a Bloom filter for each bucket.

    A micro-batch asks the filters first (bitmaps of ``BITS`` bits, read for the batch's buckets only); only keys that
    they take for seen are looked up in the table, and only buckets with such keys are read.
    """

    BITS, CELL, HASHES = 1 << 20, 32768, 4

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.buckets = spark, buckets
        self.table = KeyedTable(spark, f"{path.rstrip('/')}/keys", "key", guard="key", buckets=buckets)
        self.filters = KeyedTable(spark, f"{path.rstrip('/')}/filters", ["bucket", "cell"], buckets=1)

    def _bits(self, keys: DataFrame) -> DataFrame:
        """``(key, bucket, cell, bit)``: a row for each hash of each key."""
        at = F.explode(F.array(*[F.pmod(F.xxhash64("key", F.lit(i)), F.lit(self.BITS)) for i in range(self.HASHES)]))
        spread = keys.select("key", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("bucket"), at.alias("at"))
        return spread.select("key", "bucket", F.floor(F.col("at") / self.CELL).cast("int").alias("cell"), F.pmod("at", F.lit(self.CELL)).alias("bit"))

    def maybe_seen(self, keys: DataFrame) -> DataFrame:
        """The keys that the filters take for seen: all that were, and few others."""
        commit = self.filters.commits.latest()
        if commit.schema is None:
            return keys.limit(0)
        cells = self.filters.read()
        byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        on = F.shiftright(byte, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1), (F.col("bit") % 8).cast("int"))) != 0
        hit = self._bits(keys).join(cells, ["bucket", "cell"]).filter(on)
        return hit.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") == self.HASHES).select("key")

    def add(self, items: DataFrame, epoch: int, writer: str = "stream") -> DataFrame:
        """``items(key, ...)`` of a micro-batch -> those whose key was never seen, one for each key, and their keys are kept.

        Played again, an epoch gives the items that it gave: keys carry the epoch that brought them.
        """
        spark = self.spark
        one = items.groupBy("key").agg(F.min(F.struct(*[c for c in items.columns if c != "key"])).alias("i")).select("key", "i.*").select(*items.columns)
        batch = stored(one, "batch")
        commit = self.table.commits.latest()
        doubtful = stored(self.maybe_seen(batch.select("key")), "doubtful")
        seen = spark.createDataFrame([], "key string")
        if commit.schema is not None:
            buckets = [r["b"] for r in doubtful.select(F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()]
            seen = self.table._rows(commit, buckets).filter((F.col("writer") != writer) | (F.col("epoch") != epoch)).join(doubtful, "key", "left_semi").select("key")
        fresh = stored(batch.join(seen, "key", "left_anti"), "fresh")
        # filters first: a filter that holds too much is harmless, one that lacks a stored key is not
        cells = self._bits(fresh).groupBy("bucket", "cell").agg(F.bitmap_construct_agg("bit").alias("bits"))
        old = self.filters.commits.latest()
        if old.schema is not None:
            cells = cells.unionByName(self.filters.read().join(cells.select("bucket", "cell"), ["bucket", "cell"], "left_semi")).groupBy("bucket", "cell").agg(F.bitmap_or_agg("bits").alias("bits"))
        self.filters.merge(cells)
        self.table.merge(fresh.select("key", F.lit(epoch).cast("long").alias("epoch"), F.lit(writer).alias("writer")), epoch, writer)
        return fresh
