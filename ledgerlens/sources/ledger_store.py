"""A stored ledger: the transaction log and the snapshot chain of every portfolio, changed together.

A change replays each portfolio that it names from its last snapshot strictly before its earliest change. Neither the
log before that snapshot nor the segments of other times and portfolios are opened, except that ids are compared
with those of the named parts. New transactions are added beside those of their segment; only segments that lose some are
written anew. Whole rows are shuffled only where ids repeat or many are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chain as C
from ..operators.chain import P
from .folders import forget, stored
from .segments import Segments

LOG = "portfolio_id bigint, t_ms bigint, type string, ticker string, quantity double, price double, fee double, currency string, id string"
_COLUMNS = [f.split()[0] for f in LOG.split(", ")]


def assigned(new: DataFrame) -> DataFrame:
    """Transactions with an id of their own: a hash of portfolio, time, type, asset and the sender's reference (its ``id``)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (P, "t_ms", "type", "ticker", "id")]
    return new.withColumn("id", F.concat(F.lit("tx-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)))


class LedgerStore:
    """Log and snapshots below ``path``; each change is a commit with a number of its own."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 16, era_days: int = 365):
        tables = {"log": (LOG, P, "t_ms"), "snapshots": (f"{C.SNAPSHOT}, made bigint", P, "t_ms")}
        self.segments = Segments(spark, path, tables, parts, era_days)

    def log(self) -> DataFrame:
        return self.segments.read("log")

    def snapshots(self) -> DataFrame:
        """portfolio_id, t_ms, positions, cash and the commit that made the snapshot."""
        return self.segments.read("snapshots")

    def change(self, n: int, adds: DataFrame | None = None, deletes: DataFrame | None = None) -> None:
        """Append new transactions, remove those named by (portfolio_id, id), and renew the snapshots from there on.

        A transaction whose id its portfolio has already, or that comes twice, counts once. An id that is removed and
        added in one change is replaced. A portfolio without an earlier snapshot starts empty.
        """
        s = self.segments
        if n <= s.version():
            return
        spark, stage = s.spark, f"{s.path}/stage/{n}"
        # Small tables that later steps read several times; once written, their size is known to the planner.
        keep = lambda name, df: stored(df, f"{stage}/{name}")
        named = [x.select(P) for x in (adds, deletes) if x is not None]
        parts = {p for p, _ in s.touched(s.placed("log", named[0].unionByName(named[-1]).distinct().withColumn("t_ms", F.lit(0))))}
        mine = s.read("log", lambda p, e: p in parts)
        gone = names = None
        if deletes is not None:
            names = keep("names", deletes.select(F.col(P).cast("bigint").alias(P), "id").distinct())
            gone = keep("gone", mine.select(P, "id", "t_ms").join(names, [P, "id"], "left_semi"))
        fresh = s.put(n, "log", spark.createDataFrame([], LOG) if adds is None else self._unknown(adds.select(*_COLUMNS), mine, names, keep), as_dealt=True)
        moved = fresh.select(P, "t_ms")
        since = keep("since", C.boundaries(moved if gone is None else moved.unionByName(gone.select(P, "t_ms"))))
        hit = set() if gone is None else set(s.touched(s.placed("log", gone)))
        if hit:
            fresh = s.put(n, "log", s.read("log", lambda p, e: (p, e) in hit).join(gone.select(P, "id"), [P, "id"], "left_anti"), as_dealt=True, more=True)
        log = [x for x in s.held("log") if x[:2] not in hit] + [(p, e, n) for p, e in s.touched(fresh)]

        # Bases: snapshots of the named parts, up to the era of the latest boundary of each part.
        edge = {r["_part"]: (r["lo"], r["hi"]) for r in s.placed("log", since.withColumn("t_ms", F.col("since"))).groupBy("_part").agg(F.min("_era").alias("lo"), F.max("_era").alias("hi")).collect()}
        base = keep("base", C.bases(s.read("snapshots", lambda p, e: p in edge and e <= edge[p][1]).drop("made"), since))
        starts = keep("starts", since.join(base.select(P, F.col("t_ms").alias("_base")), P, "left").select(P, F.coalesce("_base", F.lit(-(2**62))).alias("_base")))
        first = {r["_part"]: r["era"] for r in s.placed("log", starts.withColumn("t_ms", F.col("_base"))).groupBy("_part").agg(F.min("_era").alias("era")).collect()}
        after = s.read("log", lambda p, e: p in first and e >= first[p], log).join(starts, P).where("t_ms > _base").drop("_base")
        new = C.renewed(after, base, since).withColumn("made", F.lit(n).cast("long"))

        # Snapshots from the boundaries on are replaced; those before stay in the segments that are rewritten.
        later = {k for k in s.entries("snapshots") if k[0] in edge and k[1] >= edge[k[0]][0]}
        kept = s.read("snapshots", lambda p, e: (p, e) in later).join(since, P, "left").where("since IS NULL OR t_ms < since").drop("since")
        s.publish(n, {"log": log, "snapshots": s.replaced(n, "snapshots", kept.unionByName(new), list(later))})
        forget(spark, stage)

    @staticmethod
    def _unknown(adds: DataFrame, mine: DataFrame, removed: DataFrame | None, keep) -> DataFrame:
        """Those new transactions whose id their portfolio lacks, each once.

        Only hashes of all ids are shuffled: a hash that comes once belongs to a new transaction, and rows of the others are compared by their ids.
        """
        key = F.xxhash64(F.col(P).cast("bigint"), "id").alias("_h")
        twice = keep("twice", adds.select(key).unionByName(mine.select(key)).groupBy("_h").count().where("count > 1").select("_h"))
        if twice.isEmpty():
            return adds
        hashed = adds.select("*", key)
        known = mine.select(P, "id", key).join(twice, "_h", "left_semi").drop("_h")
        known = known if removed is None else known.join(removed, [P, "id"], "left_anti")
        rest = [c for c in _COLUMNS if c not in (P, "id")]
        once = hashed.join(twice, "_h", "left_semi").groupBy(P, "id").agg(F.min(F.struct(*rest)).alias("x")).select(P, "x.*", "id")
        return hashed.join(twice, "_h", "left_anti").select(*_COLUMNS).unionByName(once.join(known, [P, "id"], "left_anti").select(*_COLUMNS))

    def invalidate(self, n: int, since: DataFrame) -> None:
        """Drop the snapshots of each portfolio at or after its time in ``since``; the log stays."""
        s = self.segments
        edge = {r["_part"]: r["lo"] for r in s.placed("log", since.withColumn("t_ms", F.col("since"))).groupBy("_part").agg(F.min("_era").alias("lo")).collect()}
        later = {k for k in s.entries("snapshots") if k[0] in edge and k[1] >= edge[k[0]]}
        kept = s.read("snapshots", lambda p, e: (p, e) in later).join(since, P, "left").where("since IS NULL OR t_ms < since").drop("since")
        s.commit(n, {"snapshots": (kept, list(later))})
