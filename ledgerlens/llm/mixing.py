"""Mixing sources to target weights by capped water-filling.

Every source gets words in proportion to its weight until it reaches ``max_epochs`` times its own size. Sources that
would get more are clamped there, and what they leave is shared among the others by weight, again until none is
above. A target is then met by whole repetitions of all documents of the source and one more, partial pass that
takes documents in the order of a seeded hash until the words run out; the document at the border gives its first
words only, so a source is off its target by less than one word.

Sources are numbered in parts of a range partitioning, and the partial pass is summed in buckets of the hash, so no
source, however large, is ever in one task. The driver sees sums only.

Defined results: a null text has no words; a null source is a source of its own, the last one; a null id draws like
the word "null"; rows that agree in id, source and size are interchangeable, and reruns give them the same set of values; a
source without words has target 0; a very long text counts as any other; an empty table stays empty; input columns
beside the three named ones are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, release, split_words

#: Weights of the sources in order, repeating; words of the mix by all words; most repetitions; seed of the draws.
WEIGHTS, SHARE, MAX_EPOCHS, SEED = (5, 2, 1), 1.5, 2, 13
#: Hexadecimal digits of the draw that make a bucket: 4,096 buckets a source.
DIGITS = 3


def draw(id_col: str, seed: int) -> Column:
    """The seeded hash of a document, as 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))


def ranked_sources(rows: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(s, source_size, w) of each source: numbered in code-point order, without one task that holds them all."""
    sizes = rows.groupBy("s").agg(F.sum("size").alias("source_size"))
    parts = cut(sizes.repartitionByRange("s").withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each part
    before = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_part").orderBy("s")) - 1 + F.col("_before")
    cycle = F.get(F.array(*map(F.lit, weights)), (place % len(weights)).cast("int"))
    out = cut(parts.join(before, "_part").select("s", "source_size", cycle.cast("long").alias("w")))
    release(parts)
    return out


def water_level(sources: DataFrame, share: float, max_epochs: int) -> float:
    """Words a unit of weight: sources above their cap are clamped, and the rest is shared anew until none is above."""
    cap, w = F.col("source_size") * max_epochs, F.col("w")
    total, left = sources.agg(F.sum("source_size"), F.sum("w")).first()
    words = share * (total or 0)
    level = words / left if left else 0.0
    while True:
        over = F.lit(level) * w >= cap
        held, left = sources.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, w))).first()
        raised = (words - (held or 0)) / left if left else level
        if raised <= level:
            return level
        level = raised


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", digits: int = DIGITS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each document the mix takes.

    ``taken`` // size repetitions are whole; what is left over are the document's first words once more.
    """
    rows = cut(docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.concat(F.lit("0"), F.col(source_col)), F.lit("1")).alias("s"),
        F.size(split_words(F.col(text_col))).cast("long").alias("size"), draw(id_col, seed).alias("key"),
    )).withColumn("bucket", F.substring("key", 1, digits))
    sources = ranked_sources(rows, weights)
    level = water_level(sources, share, max_epochs)
    target = F.least(F.lit(level) * F.col("w"), (F.col("source_size") * max_epochs).cast("double"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = sources.withColumn("target", target).withColumn("whole", whole)
    aims = aims.withColumn("rest", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5))
    sums = rows.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    until = F.coalesce(F.sum("n").over(W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("s", "bucket", until.alias("start")).join(aims, "s")  # sources x buckets rows
    inner = F.sum("size").over(W.partitionBy("s", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = rows.select("doc_id", "s", "bucket", "size", inner.alias("inner")).join(starts, ["s", "bucket"])
    partial = F.greatest(F.least(F.col("rest") - F.col("start") - F.col("inner"), F.col("size")), F.lit(0))
    return placed.select(
        "doc_id", F.when(F.col("s") != "1", F.substring("s", 2, 2**31 - 1)).alias("source"), "size", "source_size", "target",
        (F.col("whole") * F.col("size") + partial).cast("long").alias("taken"),
    )


def mixed_texts(docs: DataFrame, taken: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: a row for each repetition (doc_id, epoch, text), the last one shortened to the words it gives.

    Ids have to be unique here; whole repetitions are the text as it is, a shortened one has its words joined by blanks.
    """
    plan = taken.select(F.col("doc_id").alias("_id"), "size", "taken").where("taken > 0")
    epochs = docs.join(plan, F.col(id_col).eqNullSafe(F.col("_id"))).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    left = F.least(F.col("taken") - F.col("epoch") * F.col("size"), F.col("size"))
    words = F.array_join(F.slice(split_words(F.col(text_col)), 1, left.cast("int")), " ")
    return epochs.select(F.col(id_col).alias("doc_id"), "epoch", F.when(left == F.col("size"), F.col(text_col)).otherwise(words).alias("text"))


def op13_water_filling(spark, sf_dir: str) -> DataFrame:
    """All documents in the production mix."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS z FROM d GROUP BY source
), r AS (
  SELECT source, z, {list(WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w FROM s
), c AS (
  SELECT source, z, w, CAST({MAX_EPOCHS} * z AS DOUBLE) / w AS q,
         {SHARE}::DOUBLE * CAST(sum(z) OVER () AS DOUBLE) AS words, sum(w) OVER () AS w_all,
         sum({MAX_EPOCHS} * z) OVER o - {MAX_EPOCHS} * z AS caps, sum(w) OVER o - w AS w_before
  FROM r WINDOW o AS (ORDER BY CAST({MAX_EPOCHS} * z AS DOUBLE) / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), l AS (
  SELECT arg_min(x, caps) AS x FROM (SELECT *, (words - CAST(caps AS DOUBLE)) / CAST(w_all - w_before AS DOUBLE) AS x FROM c) WHERE x <= q
), a AS (
  SELECT source, z, least(x * w, CAST({MAX_EPOCHS} * z AS DOUBLE)) AS target FROM r, l
), b AS (
  SELECT *, CASE WHEN z > 0 THEN CAST(floor(target / z) AS BIGINT) ELSE 0 END AS whole FROM a
), e AS (
  SELECT doc_id, size, z, target, whole, CAST(floor(target - whole * z + 0.5) AS BIGINT) AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, z AS source_size, target, CAST(whole * size + greatest(least(rest - before, size), 0) AS BIGINT) AS taken FROM e
"""
