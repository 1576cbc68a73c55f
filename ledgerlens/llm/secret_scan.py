"""Secret scans: candidates by shape, false positives removed by a random forest.

Candidates are words of 16 or more key characters with a digit. Each gets its length, its share of digits and
capitals, the mean log-likelihood of its character transitions and the share of it that dictionary words cover
(transitions and dictionary are counted over all words of the corpus), words of its path, and whether a neighbouring
word names a credential. A random forest, trained on labelled findings, gives the probability of a secret.

The forest is fitted on at most ``MAX_TRAINING`` labelled findings, chosen by hash; all else covers all data.
Everything is DataFrame and pyspark.ml operations on the JVM.

Defined results: null and empty texts have no candidates; repeated rows give their findings again; where the
labelled findings hold fewer than two classes no forest can be fitted, and the neighbouring words decide alone; a
null path has no path words; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

MIN_LENGTH, AROUND, MAX_TRAINING, TREES, DEPTH, SEED = 16, 4, 10_000, 20, 6, 7
#: Words are parted by white space, quotes, brackets and the signs that stand round values.
PARTS = r"[\s\"'`#$%&*|:,;<>()\[\]{}=!?]+"
SHAPE = r"^(?=.*[0-9])[A-Za-z0-9+/_.\-]{16,}$"
#: A text without this has no candidate.
SCREEN = r"(?=[A-Za-z+/_.\-]*[0-9])[A-Za-z0-9+/_.\-]{16}"
NAMES = r"(?i)(token|secret|passw|passwd|pwd|api_?key|apikey|access|auth|credential|bearer|private)"
TEST_PATH = r"(?i)(test|example|sample|fixture|mock|doc|demo|vendor)"
FEATURES = ["length", "digit_share", "upper_share", "only_hex", "only_digits", "transition", "coverage", "path_test", "path_depth", "named"]


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Candidates with their places: doc_id, place (word number), value, path, before and after."""
    source = docs.where(F.col(text_col).rlike(SCREEN)).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.split(text_col, PARTS).alias("w"))
    at = F.filter(F.transform("w", lambda w, i: F.when((F.length(w) >= MIN_LENGTH) & w.rlike(SHAPE), i)), lambda i: i.isNotNull())
    hits = source.select("doc_id", "path", "w", F.explode(at).alias("place"))
    word = lambda lo, hi: F.array_join(F.slice("w", F.greatest(F.col("place") + 1 + lo, F.lit(1)), F.least(F.col("place"), F.lit(AROUND)) if lo < 0 else F.lit(hi)), " ")
    return hits.select("doc_id", "place", F.get("w", F.col("place")).alias("value"), "path", word(-AROUND, 0).alias("before"), word(1, 2).alias("after"))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts: lower-case runs of letters, 2 or more."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}]+")).alias("word")).where(F.length("word") > 1)
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _fold(value: Column) -> Column:
    """Character classes: letters a-z, one for digits, one for all else."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[0-9]", "0"), "[^a-z0]", "~")


def _pairs(value: Column) -> Column:
    return F.explode(F.when(F.length(value) > 1, F.transform(F.sequence(F.lit(1), F.length(value) - 1), lambda i: F.substring(value, i, F.lit(2)))))


def transitions(counts: DataFrame) -> DataFrame:
    """(pair, log_p) of character transitions, weighted by word counts; at most 28 x 28 rows."""
    pairs = counts.select("n", _pairs(_fold(F.col("word"))).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
    first = pairs.groupBy(F.substring("pair", 1, 1).alias("c")).agg(F.sum("n").alias("t"))
    return pairs.join(F.broadcast(first), F.substring("pair", 1, 1) == F.col("c")).select("pair", F.ln((F.col("n") + 1.0) / (F.col("t") + 28.0)).alias("log_p"))


def with_features(found: DataFrame, counts: DataFrame) -> DataFrame:
    """The findings with all FEATURES; those of a value are computed once for each different value."""
    values = cut(found.select("value").distinct())
    moves = transitions(counts)
    likely = values.select("value", _pairs(_fold(F.col("value"))).alias("pair")).join(F.broadcast(moves), "pair", "left").groupBy("value").agg(F.avg(F.coalesce("log_p", F.lit(-10.0))).alias("transition"))
    parts = values.select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit(r"([a-z]{3,})"), F.lit(1))).alias("word"))
    known = parts.join(counts.where("n > 2").select("word"), "word", "left_semi").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))
    size = F.length("value").cast("double")
    share = lambda kind: (size - F.length(F.regexp_replace("value", kind, ""))) / size
    wide = found.join(likely, "value", "left").join(known, "value", "left")
    return wide.select(
        "doc_id", "place", "value", "before", "path", size.alias("length"), share("[0-9]").alias("digit_share"), share("[A-Z]").alias("upper_share"),
        F.col("value").rlike("^[0-9a-fA-F]+$").cast("double").alias("only_hex"), F.col("value").rlike("^[0-9]+$").cast("double").alias("only_digits"),
        F.coalesce("transition", F.lit(-10.0)).alias("transition"), (F.coalesce("covered", F.lit(0)) / size).alias("coverage"),
        F.col("path").rlike(TEST_PATH).cast("double").alias("path_test"), F.size(F.split("path", "/")).cast("double").alias("path_depth"),
        (F.col("before").rlike(NAMES) | F.col("after").rlike(NAMES)).cast("double").alias("named"),
    )


def fit(labelled: DataFrame, label_col: str = "label"):
    """A forest from labelled findings with FEATURES, or None where a class is missing."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    chosen = labelled.select(F.col(label_col).cast("double").alias("label"), "doc_id", "place", *FEATURES).where("label IS NOT NULL")
    sample = cut(chosen.orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place").limit(MAX_TRAINING))
    if sample.agg(F.countDistinct("label")).first()[0] < 2:
        return None
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label").fit(ready)


def score(model, featured: DataFrame) -> DataFrame:
    """The findings with ``probability`` and ``is_secret``."""
    if model is None:
        out = featured.withColumn("probability", F.col("named"))
    else:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        ready = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(featured)
        model = model.copy().setFeaturesCol("_features").setProbabilityCol("_p").setPredictionCol("_y").setRawPredictionCol("_r")
        out = model.transform(ready).withColumn("probability", vector_to_array("_p")[1])
    return out.withColumn("is_secret", F.col("probability") >= 0.5)


def rule_label() -> Column:
    """Label of a finding from its own form alone: an assigned hexadecimal key is a secret."""
    return (F.col("before").rlike(r"(?i)(token|secret|key|password)\W*$") & F.col("value").rlike("^[0-9a-zA-Z]{32,}$")).cast("double")


def op2_forest_secret_scan(spark, sf_dir: str) -> DataFrame:
    """All candidates of all documents; the forest learns from findings in the documents that ``labels`` covers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    covered = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct()
    featured = cut(with_features(cut(findings(docs)), cut(word_counts(docs))))
    model = fit(featured.join(covered, "doc_id", "left_semi").withColumn("label", rule_label()))
    return score(model, featured).select("doc_id", "place", F.sha2("value", 256).alias("value_sha256"), *FEATURES, "probability", "is_secret")
