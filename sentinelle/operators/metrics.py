"""Evaluation metrics and the severity model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Share of all values by which the rank of a sketch's quantile may be off, with a probability of 99 %.
RANK_ERROR = 0.0165


def sketches(rows: DataFrame, by: list, value: str) -> DataFrame:
    """(by, n, sketch): a quantile sketch of `value` for each group, of bounded size; stored, merged and added to later."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.kll_sketch_agg_double(F.col(value)).alias("sketch"))


def merged_sketches(stored: DataFrame, by: list) -> DataFrame:
    """Sketches of finer groups as those of coarser ones."""
    return stored.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(stored: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """`stored` with a column for each wanted quantile; null where nothing was counted."""
    value = lambda q: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q)))
    return stored.withColumns({name: value(q) for name, q in wanted.items()}).drop("sketch")


def confusion(rows: DataFrame, expected: str, got: str) -> DataFrame:
    return rows.groupBy(F.col(expected).alias("expected"), F.col(got).alias("got")).agg(F.count("*").alias("n"))


def per_class(table: DataFrame) -> DataFrame:
    """Precision, recall and F1 of every class, from a confusion table (as many rows as pairs of classes)."""
    support = table.groupBy(F.col("expected").alias("klass")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("expected") == F.col("got"), F.col("n")).otherwise(0)).alias("right"))
    given = table.groupBy(F.col("got").alias("klass")).agg(F.sum("n").alias("given"))
    both = support.join(given, "klass", "full").na.fill(0, ["support", "right", "given"])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    p, r = ratio("right", "given"), ratio("right", "support")
    return both.select("klass", "support", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def summary(table: DataFrame) -> DataFrame:
    """Accuracy, and F1 averaged over classes that occur."""
    right = table.agg((F.sum(F.when(F.col("expected") == F.col("got"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    macro = per_class(table).where("support > 0").agg(F.avg("f1").alias("macro_f1"))
    return right.crossJoin(F.broadcast(macro))


def set_scores(rows: DataFrame, expected: str, got: str) -> DataFrame:
    """Precision, recall and F1 of sets, pooled over rows."""
    sums = rows.agg(F.sum(F.size(F.array_intersect(expected, got))).alias("hit"), F.sum(F.size(got)).alias("given"), F.sum(F.size(expected)).alias("wanted"))
    p, r = F.col("hit") / F.col("given"), F.col("hit") / F.col("wanted")
    return sums.select(p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r)).alias("f1"))


def severity_pipeline(rounds: int = 50):
    """Words, pairs of words, category and numbers to a severity, by multinomial logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, MinMaxScaler, NGram, OneHotEncoder, RegexTokenizer, StringIndexer, VectorAssembler

    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[^\p{L}\p{Nd}]+"),
            NGram(n=2, inputCol="words", outputCol="word_pairs"),
            HashingTF(inputCol="words", outputCol="bag", numFeatures=1 << 12),
            HashingTF(inputCol="word_pairs", outputCol="pair_bag", numFeatures=1 << 12),
            StringIndexer(inputCol="event_type", outputCol="type_index", handleInvalid="keep"),
            OneHotEncoder(inputCols=["type_index"], outputCols=["type_vector"]),
            VectorAssembler(inputCols=["sources", "confidence", "entities", "located"], outputCol="numbers"),
            MinMaxScaler(inputCol="numbers", outputCol="scaled"),
            VectorAssembler(inputCols=["bag", "pair_bag", "type_vector", "scaled"], outputCol="features"),
            LogisticRegression(featuresCol="features", labelCol="severity", family="multinomial", regParam=0.05, maxIter=rounds),
        ]
    )


def opinions(model, rows: DataFrame) -> DataFrame:
    """id, and `classes`: every class with its probability (4 decimals), the likeliest first."""
    from pyspark.ml.functions import vector_to_array

    each = F.transform(vector_to_array("probability"), lambda p, k: F.struct(F.round(p, 4).alias("probability"), (-k).alias("back")))
    ranked = F.transform(F.sort_array(each, asc=False), lambda c: F.struct((-c.back).alias("severity"), c.probability.alias("probability")))
    return model.transform(rows).select("id", ranked.alias("classes"))


def predictions(rows: DataFrame, train: str = "train", rounds: int = 50) -> DataFrame:
    """`rows` with the predicted severity; the model sees only rows where `train` holds. Severity itself is never changed."""
    model = severity_pipeline(rounds).fit(rows.where(train))
    return model.transform(rows).select("id", "severity", train, F.col("prediction").cast("int").alias("predicted"), (F.col("prediction") != F.col("severity")).alias("disagrees"))
