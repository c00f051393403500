"""Rate model, embeddings and learned rankings on MLlib."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prepare(rows: DataFrame, columns: list[str], fit_on) -> DataFrame:
    """Impute by median, winsorise at the 99th percentile and z-score, all measured on the rows of ``fit_on`` only."""
    tune = rows.filter(fit_on)
    stats = tune.agg(*[F.median(c).alias(f"{c}_med") for c in columns], *[F.percentile(c, F.lit(0.99)).alias(f"{c}_p99") for c in columns])
    out = rows.withColumn("_of", stats.select(F.struct("*")).scalar())
    for c in columns:
        out = out.withColumn(c, F.least(F.coalesce(F.col(c).cast("double"), F.col(f"_of.{c}_med"), F.lit(0.0)), F.coalesce(F.col(f"_of.{c}_p99"), F.lit(0.0))))
    moments = out.filter(fit_on).agg(*[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_samp(c).alias(f"{c}_s") for c in columns])
    out = out.withColumn("_of", moments.select(F.struct("*")).scalar())
    for c in columns:
        out = out.withColumn(c, F.coalesce(F.when(F.col(f"_of.{c}_s") > 0, (F.col(c) - F.col(f"_of.{c}_m")) / F.col(f"_of.{c}_s")), F.lit(0.0)))
    return out.drop("_of")


def resolvable_targets(nodes: DataFrame, attached: DataFrame, births: DataFrame, origins: list[int], horizons: list[int], complete: int, m: int) -> DataFrame:
    """unit_id, origin, horizon, births_mass: mass of the births of the ``horizon`` years after an origin, for every region.

    Only horizons whose last year can be confirmed by ``complete`` are there: a birth needs m years of papers. births: (concept,
    crystallization_year).
    """
    spark = nodes.sparkSession
    cells = spark.createDataFrame([(t, h) for t in origins for h in horizons if t + h <= complete - (m - 1)], "origin int, horizon int")
    every = nodes.select(F.col("region_id").alias("unit_id")).distinct().withColumn("_cells", cells.agg(F.collect_list(F.struct("origin", "horizon"))).scalar())
    every = every.select("unit_id", F.explode("_cells").alias("c")).select("unit_id", "c.origin", "c.horizon")
    dated = attached.filter("not orphan").join(births, "concept").select("unit_id", "mass", F.col("crystallization_year").alias("t"))
    rows = every.join(dated, "unit_id", "left")
    inside = F.col("t").between(F.col("origin") + 1, F.col("origin") + F.col("horizon"))
    return rows.groupBy("unit_id", "origin", "horizon").agg(F.coalesce(F.sum(F.when(inside, F.col("mass"))), F.lit(0.0)).alias("births_mass"))


def log_score(y, rate):
    """Poisson log score without the constant."""
    safe = F.greatest(rate, F.lit(1e-9))
    return y * F.ln(safe) - safe


def poisson_ladder(rows: DataFrame, rungs: dict[str, list[str]], target: str, exposure: str, fit_on, test_on) -> DataFrame:
    """rung, log_score_gain over the exposure-only rate, calibration (observed over expected), by nested Poisson regressions."""
    rows = rows.filter(F.col(exposure) > 0).withColumn("_offset", F.ln(F.col(exposure).cast("double")))
    tune = rows.filter(fit_on)
    null = tune.agg((F.sum(target) / F.sum(exposure)).alias("_rate"))
    out = None
    for name, columns in rungs.items():
        vectors = VectorAssembler(inputCols=columns, outputCol="_x")
        glm = GeneralizedLinearRegression(family="poisson", link="log", labelCol=target, featuresCol="_x", offsetCol="_offset", regParam=0.01, predictionCol="_mu")
        scored = glm.fit(vectors.transform(tune)).transform(vectors.transform(rows.filter(test_on))).withColumn("_rate", null.scalar())
        gain = F.sum(log_score(F.col(target), F.col("_mu")) - log_score(F.col(target), F.col("_rate") * F.col(exposure)))
        one = scored.agg(gain.alias("log_score_gain"), (F.sum(target) / F.sum("_mu")).alias("calibration")).select(F.lit(name).alias("rung"), "log_score_gain", "calibration")
        out = one if out is None else out.union(one)
    return out


def boosted_scores(rows: DataFrame, columns: list[str], label: str, fit_on, depth: int = 3, leaf: int = 20, rounds: int = 300, step: float = 0.03) -> DataFrame:
    """rows with score: probability of the label by boosted trees, fitted on the rows of ``fit_on``."""
    vectors = VectorAssembler(inputCols=columns, outputCol="_x")
    trees = GBTClassifier(featuresCol="_x", labelCol=label, maxDepth=depth, minInstancesPerNode=leaf, maxIter=rounds, stepSize=step, seed=7)
    model = trees.fit(vectors.transform(rows.filter(fit_on)))
    scored = model.transform(vectors.transform(rows))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def embed(bags: DataFrame, dim: int = 200, window: int = 5, least: int = 5, epochs: int = 5, seed: int = 20260819, partitions: int = 1) -> DataFrame:
    """concept, vec (unit length): skip-gram vectors of bags (array column ``bag``) of two concepts or more."""
    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=least, maxIter=epochs, seed=seed, inputCol="bag", outputCol="_v", numPartitions=partitions).fit(bags.filter(F.size("bag") >= 2))
    v = vector_to_array("vector")
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return model.getVectors().select(F.col("word").alias("concept"), F.transform(v, lambda x: (x / F.greatest(size, F.lit(1e-12))).cast("float")).alias("vec"))


def bags(concepts: DataFrame) -> DataFrame:
    """paper_id, bag: each paper's distinct concepts in order."""
    return concepts.groupBy("paper_id").agg(F.sort_array(F.collect_set("concept")).alias("bag"))
