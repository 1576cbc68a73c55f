"""Tables kept in segments of (hash of the key, time era), of which a commit rewrites only those it touches.

Below ``path``: ``data/<table>/v<n>/_part=../_era=../`` holds what commit n wrote, and ``manifest/<n>`` names the versions in
force of each segment of all tables: one, or several where commits only added rows. A commit counts once its manifest is complete, so several tables change at once, a
reader never sees half of one, and a commit that is run again after a failure writes the same files again. Segments that
a commit does not touch keep their files. The driver handles names of segments only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .folders import stored

DAY = 86_400_000
_ENTRY = "tab string, part int, era long, version long"
Segment = tuple[int, int]
Held = list[tuple[int, int, int]]


class Segments:
    """Tables by name, each with a schema, a key column and a time column (milliseconds)."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, tuple[str, str, str]], parts: int = 16, era_days: int = 365):
        self.spark, self.path, self.tables, self.parts, self.era_ms = spark, path.rstrip("/"), tables, parts, era_days * DAY

    def placed(self, table: str, df: DataFrame) -> DataFrame:
        """Rows with the segment that each belongs to."""
        schema, key, t = self.tables[table]
        kind = StructType.fromDDL(schema)[key].dataType  # an int hashes otherwise than the bigint of the same value
        return df.withColumns({"_part": F.pmod(F.xxhash64(F.col(key).cast(kind)), F.lit(self.parts)).cast("int"), "_era": F.floor(F.col(t) / self.era_ms)})

    @staticmethod
    def touched(placed: DataFrame) -> list[Segment]:
        return [tuple(r) for r in placed.select("_part", "_era").distinct().collect()]

    def version(self) -> int:
        """The last commit, or -1."""
        jvm = self.spark._jvm
        base = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(base):
            return -1
        names = [s.getPath().getName() for s in fs.listStatus(base)]
        whole = [int(n) for n in names if n.isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest/{n}/_SUCCESS"))]
        return max(whole, default=-1)

    def held(self, table: str, version: int | None = None) -> Held:
        """The (part, era, version) in force of a table."""
        n = self.version() if version is None else version
        if n < 0:
            return []
        rows = self.spark.read.schema(_ENTRY).parquet(f"{self.path}/manifest/{n}").where(F.col("tab") == table).collect()
        return sorted((r["part"], r["era"], r["version"]) for r in rows)

    def entries(self, table: str, version: int | None = None) -> dict[Segment, int]:
        """The last version in force of each segment of a table."""
        return {(p, e): v for p, e, v in self.held(table, version)}

    def read(self, table: str, wanted=None, version: int | Held | None = None) -> DataFrame:
        """A table as of a commit, or of the versions given; ``wanted(part, era)`` says which of its segments are opened at all."""
        schema = StructType.fromDDL(self.tables[table][0])
        root = f"{self.path}/data/{table}"
        held = version if isinstance(version, list) else self.held(table, version)
        paths = [f"{root}/v{n}/_part={p}/_era={e}" for p, e, n in held if wanted is None or wanted(p, e)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def put(self, n: int, table: str, df: DataFrame, as_dealt: bool = False, more: bool = False) -> DataFrame:
        """Write rows of commit n to their segments, or ``more`` of them; the rows so far, with ``_part`` and ``_era``.

        One task writes each segment, or with ``as_dealt`` each task its rows, so that a large table is not shuffled.
        """
        placed = self.placed(table, df)
        return stored(placed if as_dealt else placed.repartition("_part", "_era"), f"{self.path}/data/{table}/v{n}", "_part", "_era", mode="append" if more else "overwrite")

    def publish(self, n: int, changes: dict[str, Held]) -> None:
        """Make commit n count: its manifest, with the versions of the changed tables and those of the others as they were."""
        old = self.version()
        entries = [(table, *x) for table in self.tables for x in (changes[table] if table in changes else self.held(table, old))]
        self.spark.createDataFrame(entries, _ENTRY).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{n}")

    def replaced(self, n: int, table: str, df: DataFrame, touched: list[Segment]) -> Held:
        """Write the rows that take the place of the touched segments; what is then in force."""
        gone = set(touched)
        written = self.touched(self.put(n, table, df))
        return [x for x in self.held(table) if x[:2] not in gone] + [(p, e, n) for p, e in written]

    def commit(self, n: int, changes: dict[str, tuple[DataFrame, list[Segment]]]) -> None:
        """Replace the touched segments of each table by the rows given for them, at once."""
        if n > self.version():
            self.publish(n, {table: self.replaced(n, table, *change) for table, change in changes.items()})


class SeriesStore:
    """A stored series table (series_id, t_ms, value, arrived) in which the value that arrived last wins."""

    def __init__(self, spark: SparkSession, path: str, key_type: str = "bigint", parts: int = 16, era_days: int = 7):
        self.segments = Segments(spark, path, {"series": (f"series_id {key_type}, t_ms bigint, value double, arrived bigint", "series_id", "t_ms")}, parts, era_days)

    def upsert(self, n: int, new: DataFrame) -> None:
        """Merge new rows into the segments that they belong to; of equal arrivals the larger value stays."""
        s = self.segments
        if n <= s.version():
            return
        new = new.select("series_id", "t_ms", "value", "arrived")
        touched = s.touched(s.placed("series", new))
        hit = set(touched)
        both = s.read("series", lambda p, e: (p, e) in hit).unionByName(new)
        last = both.groupBy("series_id", "t_ms").agg(F.max(F.struct("arrived", "value")).alias("x"))
        s.commit(n, {"series": (last.select("series_id", "t_ms", "x.value", "x.arrived"), touched)})

    def read(self) -> DataFrame:
        return self.segments.read("series")
