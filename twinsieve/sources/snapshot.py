"""Fingerprint store: Parquet generations, full ones and small ones of changes.

A change is a small generation beside the others; later ones win. Full generations are written when rows are pruned or
cleared, and now and then to fold the changes. A generation counts once it has its ``_SUCCESS`` marker, so readers never
see a half-written state and a failed run leaves the store as it was. Writers claim the number of their generation;
where two claim the same, one of them fails.

A full generation names the generations it replaces, those of the one listing its rows come from, and hides no others.
Its rows keep the number of the change they were made by. So a change that lands while a fold is written stays, as does
one that was claimed before the fold and is finished after it, and it wins or loses by its own number.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from twinsieve.schemas import SNAPSHOT

MATCH = ["path", "size", "mtime", "fp_profile"]
#: Generations of changes after which they are folded into a full one.
MOST_CHANGES = 16
#: Rows as they are stored: with the number of the change they were made by.
NUMBERED = StructType([*SNAPSHOT.fields, StructField("generation", LongType())])


class ConcurrentWriteError(RuntimeError):
    """Another writer has changed the store in the meantime."""


@dataclass(frozen=True, order=True)
class Generation:
    number: int
    full: bool

    @property
    def name(self) -> str:
        return f"gen-{self.number:010d}-{'full' if self.full else 'changes'}"


class Snapshot:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self) -> tuple[list[Generation], int]:
        """Complete generations in order, and the last number that anyone has claimed."""
        if not self._fs.exists(self._path(self.root)):
            return [], 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        parts = [n.split("-") for n in names if n.startswith("gen-")]
        found = sorted(Generation(int(p[1]), p[2] == "full") for p in parts if p[2] in ("full", "changes"))
        done = [g for g in found if self._fs.exists(self._path(f"{self.root}/{g.name}/_SUCCESS"))]
        return done, max((int(p[1]) for p in parts), default=0)

    def _replaced(self, full: Generation, done: list[Generation]) -> set[int]:
        """Numbers of the generations that a full one has taken over."""
        named = self._path(f"{self.root}/gen-{full.number:010d}-replaced")
        if not self._fs.exists(named):
            return {g.number for g in done if g < full}
        stream = self._fs.open(named)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(n) for n in text.split(",") if n}

    def _current(self, done: list[Generation] | None = None) -> list[Generation]:
        """The generations that no full one has replaced, in order."""
        done = self._listed()[0] if done is None else done
        hidden = set().union(*(self._replaced(g, done) for g in done if g.full))
        return [g for g in done if g.number not in hidden]

    def _load(self, generation: Generation) -> DataFrame:
        rows = self.spark.read.schema(NUMBERED).parquet(f"{self.root}/{generation.name}")
        number = F.coalesce("generation", F.lit(0)) if generation.full else F.lit(generation.number)
        return rows.withColumn("generation", number.cast("bigint"))

    def _rows(self, done: list[Generation]) -> DataFrame:
        """One row per path of these generations, the one of the last change, with its number."""
        current = self._current(done)
        if not current:
            return self.spark.createDataFrame([], NUMBERED)
        full = [g for g in current if g.full]
        base = self._load(full[0]) if len(full) == 1 else None
        changes = [self._load(g) for g in current if base is None or not g.full]
        if not changes:
            return base
        rest = [F.col(c) for c in NUMBERED.fieldNames()[1:]]
        last = (reduce(DataFrame.unionByName, changes).groupBy("path")
                .agg(F.max_by(F.struct(*rest), "generation").alias("row")).select("path", "row.*"))
        if base is None:
            return last
        # Paths that were not changed since stay as they are, without a shuffle of the base's other columns.
        newest = max((n for n in self._replaced(full[0], done)), default=0)
        if min(g.number for g in current if not g.full) > newest:
            return base.join(last.select("path"), "path", "left_anti").unionByName(last)
        both = base.join(last.select("path", F.col("generation").alias("changed")), "path", "left")
        kept = both.where(F.coalesce(F.col("generation") > F.col("changed"), F.lit(True))).drop("changed")
        return last.join(kept.select("path"), "path", "left_anti").unionByName(kept)

    def read(self) -> DataFrame:
        """The current rows, one per path."""
        return self._rows(self._listed()[0]).drop("generation")

    def get(self, path: str, size: int, mtime: int, fp_profile: str | None = None) -> DataFrame:
        """The row of a file if it is unchanged (and made under the profile); the condition reaches the Parquet scans."""
        rows = self.read().where(F.col("path") == path).where((F.col("size") == size) & (F.col("mtime") == mtime))
        return rows if fp_profile is None else rows.where(F.col("fp_profile") == fp_profile)

    def _write(self, rows: DataFrame, full: bool, based_on: list[Generation]) -> None:
        new = Generation(self._listed()[1] + 1, full)
        try:
            self._fs.create(self._path(f"{self.root}/gen-{new.number:010d}-claim"), False).close()
        except Py4JJavaError as e:
            raise ConcurrentWriteError(f"generation {new.number} of {self.root} is being written") from e
        target = f"{self.root}/{new.name}"
        if full:
            replaced = self._fs.create(self._path(f"{self.root}/gen-{new.number:010d}-replaced"), True)
            replaced.write(bytearray(",".join(str(g.number) for g in based_on).encode()))
            replaced.close()
            if "generation" not in rows.columns:
                rows = rows.withColumn("generation", F.lit(max((g.number for g in based_on), default=0)))
        # Sorted within files, so that a point lookup skips most row groups.
        (rows.select(*[F.col(f.name).cast(f.dataType) for f in (NUMBERED if full else SNAPSHOT).fields])
         .sortWithinPartitions("path").write.parquet(target))
        if full and [g for g in self._listed()[0] if g != new] != based_on:
            self._fs.delete(self._path(target), True)
            raise ConcurrentWriteError(f"{self.root} has changed while generation {new.number} was written")

    def publish(self, rows: DataFrame) -> None:
        """Make ``rows``, one per path, all there is; a change that lands meanwhile is not replaced but an error."""
        self._write(rows, True, self._listed()[0])

    def fold(self) -> None:
        """Write the current rows as one full generation, from the listing that it is checked against."""
        done = self._listed()[0]
        self._write(self._rows(done), True, done)

    def upsert(self, rows: DataFrame) -> None:
        """Replace the rows of these paths and stamp them; others stay and are not written again."""
        self._write(stamped(rows), False, [])
        if sum(not g.full for g in self._current()) > MOST_CHANGES:
            try:
                self.fold()
            except ConcurrentWriteError:
                pass  # the rows are written; a later run folds them

    def prune(self, files: DataFrame) -> None:
        """Drop rows of paths that are no longer in the catalog."""
        done = self._listed()[0]
        self._write(self._rows(done).join(files.select("path"), "path", "left_semi"), True, done)

    def clear(self) -> None:
        self.publish(self.spark.createDataFrame([], SNAPSHOT))

    def vacuum(self) -> None:
        """Delete the generations that full ones have replaced."""
        done = self._listed()[0]
        current = self._current(done)
        for old in done:
            if old not in current:
                self._fs.delete(self._path(f"{self.root}/{old.name}"), True)


def stamped(rows: DataFrame) -> DataFrame:
    """Store rows, one per path, with the time of the run.

    Of repeated paths the row of the latest change of the file stays, of equal ones the largest in all columns.
    """
    for field in SNAPSHOT.fields:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    rest = [n for n in SNAPSHOT.fieldNames() if n not in ("path", "scanned_at")]
    last = F.max(F.struct("mtime", *[n for n in rest if n != "mtime"])).alias("row")
    return (rows.groupBy("path").agg(last).select("path", "row.*").withColumn("scanned_at", F.unix_timestamp())
            .select(*SNAPSHOT.fieldNames()))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows after an upsert; new ones carry the time of the run, and each path has one row."""
    fresh = stamped(new)
    return old.join(fresh.select("path"), "path", "left_anti").unionByName(fresh, allowMissingColumns=True)


def _profiled(files: DataFrame, fp_profile: Column | str) -> DataFrame:
    return files.withColumn("fp_profile", F.lit(fp_profile) if isinstance(fp_profile, str) else fp_profile)


def split_by_store(files: DataFrame, snapshot: DataFrame, fp_profile: Column | str) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of a catalog: unchanged files with a stored row, and the rest.

    A stored row counts only if it was made under the file's profile: a text for all, or an expression over the catalog.
    """
    files = _profiled(files, fp_profile)
    kept = [c for c in snapshot.columns if c not in files.columns]
    return files.join(snapshot.select(*MATCH, *kept), MATCH), files.join(snapshot.select(*MATCH), MATCH, "left_anti")


def store_stats(files: DataFrame, snapshot: DataFrame, fp_profile: Column | str) -> DataFrame:
    """One row: hits, misses, total and the share of hits in percent."""
    stored = snapshot.select(*MATCH).withColumn("hit", F.lit(True))
    looked = _profiled(files, fp_profile).join(stored, MATCH, "left")
    hits = F.count_if(F.col("hit"))
    total = F.count(F.lit(1))
    return looked.agg(hits.alias("hits"), (total - hits).alias("misses"), total.alias("total")).withColumn(
        "hit_rate", F.when(F.col("total") > 0, F.col("hits") / F.col("total") * 100).otherwise(F.lit(0.0)))
