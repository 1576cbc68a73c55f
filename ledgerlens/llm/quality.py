"""Quality rules as a bitmask ledger: rules run once, policies and ablations read only bits.

``ledger`` measures each document once and stores one failure bit a rule. ``apply_policy`` combines
bits under a named, versioned policy, and ``ablation`` counts what each rule alone decides, by bitwise
aggregation; neither touches the text again. All of it is DataFrame expressions.

Defined results: a null or empty text has no words, so it fails ``few_words``; a repeated row gets
the same ledger row as its twin; an empty table gives an empty ledger; other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, let, split_words

#: Symbols that count towards n_symbols.
SYMBOLS = "#*$%&|<>"


def _repeated_windows(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more, the first occurrence included."""

    def exact(w: Column) -> Column:
        # Sorting (hash, window, place) brings equal windows side by side; the hash only speeds it up.
        windows = F.transform(
            F.sequence(F.lit(1), F.size(w) - 2),
            lambda i: let(
                F.concat_ws(" ", F.slice(w, i, 3)),
                lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"), i.alias("i")),
            ),
        )

        def covered(s: Column) -> Column:
            def same(k: Column, x: Column) -> Column:
                other = F.get(s, k)
                return F.coalesce((other["h"] == x["h"]) & (other["g"] == x["g"]), F.lit(False))

            places = F.transform(
                s, lambda x, k: F.when(same(k - 1, x) | same(k + 1, x), x["i"])
            )
            found = F.sort_array(F.filter(places, lambda p: p.isNotNull()))
            return let(found, lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(3)), F.lit(3)).cast("long")),
                F.lit(0).cast("long"), lambda a, x: a + x,
            ))

        return let(F.array_sort(windows), covered)

    def screen(w: Column) -> Column:
        # Distinct hashes prove distinct windows: most texts end here.
        hashes = F.transform(
            F.sequence(F.lit(1), F.size(w) - 2),
            lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)),
        )
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(exact(w)))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(words, screen))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document with every measurement that the rules read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    lines = F.filter(F.split(F.col("_text"), "\n", -1), lambda l: l.rlike(f"[^{ASCII_SPACE}]"))
    dup_lines = let(lines, lambda l: F.size(l) - F.size(F.array_distinct(l)))
    seen = F.char_length(F.regexp_replace("_text", f"[{ASCII_SPACE}]+", ""))
    symbols = F.char_length("_text") - F.char_length(F.regexp_replace("_text", r"[#*$%&|<>]+", ""))
    letters_upper = F.char_length("_text") - F.char_length(F.regexp_replace("_text", r"[A-Z]+", ""))
    numbers = let(
        split_words(F.col("_text")),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated_windows(w).alias("n_repeat_words")),
    )
    return base.select(
        "doc_id",
        numbers.alias("_n"),
        seen.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        dup_lines.cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        letters_upper.cast("long").alias("n_upper"),
    ).select(
        "doc_id", F.col("_n.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.col("_n.n_repeat_words").alias("n_repeat_words"), "n_lines", "n_upper",
    )


#: Rules by bit: a name and the condition under which a document fails. Integer arithmetic only.
RULES: list[tuple[str, Column]] = []


def rules() -> list[tuple[str, Column]]:
    """(name, failure condition) in bit order; bit k of fail_bits belongs to the k-th rule."""
    c = F.col
    return [
        ("few_words", c("n_words") < 50),
        ("repeated_windows", 100 * c("n_repeat_words") > 50 * c("n_words")),
        ("symbol_share", 10 * c("n_symbols") > c("word_chars")),
        ("duplicate_lines", 10 * c("n_dup_lines") > 3 * c("n_lines")),
        ("short_words", c("word_chars") < 2 * c("n_words")),
        ("long_words", c("word_chars") > 20 * c("n_words")),
        ("mostly_upper", 2 * c("n_upper") > c("word_chars")),
    ]


#: Versioned policies: the rules whose failure rejects a document. Version 2 is the current one.
POLICIES = {
    1: ["few_words", "repeated_windows"],
    2: ["few_words", "repeated_windows", "symbol_share", "duplicate_lines", "short_words", "long_words", "mostly_upper"],
}
BASE_POLICY, CURRENT_POLICY = 1, 2


def mask(version: int) -> int:
    """The bits that a policy version looks at."""
    names = [name for name, _ in rules()]
    return sum(1 << names.index(name) for name in POLICIES[version])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``fail_bits`` of each document; every rule is evaluated once."""
    bits = F.lit(0).cast("long")
    for k, (_, failed) in enumerate(rules()):
        bits = bits + F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def apply_policy(book: DataFrame, version: int = CURRENT_POLICY, out: str = "kept") -> DataFrame:
    """Add the verdict of a policy version, from the bits alone."""
    return book.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(mask(version))) == 0)


def ablation(book: DataFrame, version: int = CURRENT_POLICY) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and what would be kept without it."""
    m = mask(version)
    names = [name for name, _ in rules()]
    held = F.col("fail_bits").bitwiseAND(F.lit(m))
    counts = book.groupBy(held.alias("held")).count()  # at most 2**rules rows
    one = F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.lit(1 << names.index(n)).alias("bit")) for n in POLICIES[version]
    ]))
    return (
        counts.select("held", "count", one.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("held").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("held") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("n_only_this"),
            F.sum(F.when(F.col("held").bitwiseAND(F.lit(m) - F.col("r.bit")) == 0, F.col("count")).otherwise(0)).alias("n_kept_without"),
        )
    )


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The ledger of all documents with the base and current verdicts."""
    book = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    judged = apply_policy(apply_policy(book, BASE_POLICY, "_base_kept"), CURRENT_POLICY)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
        "fail_bits", (~F.col("_base_kept")).alias("base_failed"), "kept",
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS n FROM g) WHERE n >= 2
), c AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid
), m AS (
  SELECT doc_id, len(ws) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(ls) AS n_lines,
         length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g')) AS n_upper
  FROM w LEFT JOIN c USING (rid)
), b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > word_chars THEN 4 ELSE 0 END)
    + (CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN 2 * n_upper > word_chars THEN 64 ELSE 0 END) AS fail_bits
  FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lines AS BIGINT) AS n_lines,
       CAST(n_upper AS BIGINT) AS n_upper, CAST(fail_bits AS BIGINT) AS fail_bits,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept
FROM b
"""
