"""Comparison of planning methods over a table of results.

``results`` has query_id, size, method, predicted_cost, real_cost; a cost that is
NULL, NaN or infinite is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripleloom.functions import metrics as M
from tripleloom.operators.pairs import pairs_within
from tripleloom.plans.table import draw


def clean(results: DataFrame) -> DataFrame:
    return results.withColumns({c: M.finite(F.col(c)) for c in ("predicted_cost", "real_cost")})


def wide(results: DataFrame, methods: list[str], value: str = "real_cost") -> DataFrame:
    """query_id, size and a column for each method."""
    return clean(results).groupBy("query_id", "size").pivot("method", methods).agg(F.first(value))


def win_rates(results: DataFrame, tie: float = 0.01) -> DataFrame:
    """a, b, wins, losses, rate: a wins where it is cheaper by more than ``tie`` of the larger cost; 0.5 if all are ties."""
    known = clean(results).where(F.col("real_cost").isNotNull())
    pairs = pairs_within(known, ["query_id"], ["method", "real_cost"]).where(F.col("a.method") != F.col("b.method"))
    a, b = F.col("a.real_cost"), F.col("b.real_cost")
    apart = F.abs(b - a) / F.greatest(a, b) >= tie
    counted = pairs.groupBy(F.col("a.method").alias("a"), F.col("b.method").alias("b")).agg(F.count_if(apart & (a < b)).alias("wins"), F.count_if(apart & (a > b)).alias("losses"))
    total = F.col("wins") + F.col("losses")
    return counted.withColumn("rate", F.when(total == 0, F.lit(0.5)).otherwise(F.col("wins") / total))


def ratios(results: DataFrame) -> DataFrame:
    """Each result with its cost over the best of its query."""
    known = clean(results).where(F.col("real_cost") > 0)
    return known.withColumn("ratio", F.col("real_cost") / F.min("real_cost").over(Window.partitionBy("query_id")))


def optimality_gap(results: DataFrame) -> DataFrame:
    return ratios(results).groupBy("method", "size").agg(F.avg("ratio").alias("gap"), F.count(F.lit(1)).alias("n"))


def performance_profile(results: DataFrame, taus: list[float]) -> DataFrame:
    """method, tau, share of queries solved within tau of the best; a fixed grid of taus, counted in one pass."""
    shares = ratios(results).groupBy("method").agg(*[F.avg((F.col("ratio") <= t).cast("double")).alias(f"t{i}") for i, t in enumerate(taus)])
    grid = F.array(*[F.struct(F.lit(float(t)).alias("tau"), F.col(f"t{i}").alias("share")) for i, t in enumerate(taus)])
    return shares.select("method", F.explode(grid).alias("x")).select("method", "x.tau", "x.share")


def profile_area(profile: DataFrame) -> DataFrame:
    """Area under each profile by the trapezoid rule."""
    w = Window.partitionBy("method").orderBy("tau")
    steps = profile.withColumn("part", (F.col("tau") - F.lag("tau").over(w)) * (F.col("share") + F.lag("share").over(w)) / 2)
    return steps.groupBy("method").agg(F.sum("part").alias("area"))


def by_size(results: DataFrame, value: Column | None = None) -> DataFrame:
    """Mean, median and geometric mean of costs by method and size."""
    value = F.col("real_cost") if value is None else value
    return clean(results).groupBy("method", "size").agg(F.avg(value).alias("mean"), F.median(value).alias("median"), M.geometric_mean(value).alias("geomean"), F.count(value).alias("n"))


def box(results: DataFrame) -> DataFrame:
    """Quartiles and the upper whisker (largest cost up to q3 + 1.5 IQR) by method."""
    known = clean(results).where(F.col("real_cost").isNotNull())
    q = known.groupBy("method").agg(F.percentile("real_cost", [0.25, 0.5, 0.75]).alias("q")).select("method", *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    joined = known.join(F.broadcast(q), "method")  # a row for each method
    return joined.where(F.col("real_cost") <= F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).groupBy("method", "q1", "median", "q3").agg(F.max("real_cost").alias("whisker"))


def q_error_summary(results: DataFrame) -> DataFrame:
    """Mean, lower median, median and 95th percentile of q-errors, and mean squared error of log costs, by size."""
    true, predicted = F.col("real_cost"), F.col("predicted_cost")
    rows = clean(results).where((true > 0) & (predicted > 0)).withColumn("q", M.q_error(true, predicted)).withColumn("e", F.ln(true) - F.ln(predicted))
    lower = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY q)")
    return rows.groupBy("size").agg(F.avg("q").alias("mean"), lower.alias("lower_median"), F.percentile("q", 0.5).alias("median"), F.percentile("q", 0.95).alias("p95"), F.avg(F.col("e") * F.col("e")).alias("mse"), F.count(F.lit(1)).alias("n"))


def pair_accuracy(results: DataFrame) -> DataFrame:
    """Share of pairs of a query's plans with different true cost that the prediction orders rightly, by size."""
    known = clean(results).where(F.col("real_cost").isNotNull() & F.col("predicted_cost").isNotNull())
    pairs = pairs_within(known, ["query_id", "size"], ["method", "real_cost", "predicted_cost"]).where(F.col("a.real_cost") < F.col("b.real_cost"))
    return pairs.groupBy("size").agg(F.count(F.lit(1)).alias("pairs"), F.avg((F.col("a.predicted_cost") < F.col("b.predicted_cost")).cast("double")).alias("accuracy"))


def huber_loss(results: DataFrame, tau: float) -> DataFrame:
    rows = clean(results).where((F.col("real_cost") > 0) & (F.col("predicted_cost") > 0))
    return rows.groupBy("method").agg(F.avg(M.quantile_huber(F.ln("real_cost") - F.ln("predicted_cost"), tau)).alias("loss"))


def running_best(history: DataFrame, study: str = "study", at: str = "iteration", value: str = "loss") -> DataFrame:
    w = Window.partitionBy(study).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("best_so_far", F.min(value).over(w))


def best_of_n(results: DataFrame, ns: list[int], seed: int = 0) -> DataFrame:
    """n, median, mean and population deviation of the best of n draws without replacement from each query's plans."""
    known = clean(results).where(F.col("real_cost").isNotNull())
    drawn = known.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(draw(seed, F.col("query_id"), F.col("method")), "method")))
    mins = drawn.groupBy("query_id").agg(*[F.min(F.when(F.col("i") <= n, F.col("real_cost"))).alias(f"n{n}") for n in ns])
    long = mins.select(F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"n{n}").alias("best")) for n in ns])).alias("x")).select("x.*")
    return long.groupBy("n").agg(F.median("best").alias("median"), F.avg("best").alias("mean"), F.stddev_pop("best").alias("deviation"))


def head_to_head(results: DataFrame, a: str, b: str, tolerance: float = 1e-6) -> DataFrame:
    """Wins of two methods by log10 cost, mean logs and catastrophes (cost at the censoring mark or unknown)."""
    w = wide(results, [a, b])
    la, lb = (M.log10_cost(F.coalesce(F.col(f"`{m}`"), F.lit(M.CENSORED))) for m in (a, b))
    return w.agg(F.count_if(la < lb - tolerance).alias("a_wins"), F.count_if(lb < la - tolerance).alias("b_wins"), F.avg(la).alias("a_mean_log"), F.avg(lb).alias("b_mean_log"), F.count_if(la >= 18).alias("a_lost"), F.count_if(lb >= 18).alias("b_lost"))


def best_plans(results: DataFrame) -> DataFrame:
    """The cheapest method of each query, the first by name among equals."""
    known = clean(results).where(F.col("real_cost").isNotNull())
    return known.groupBy("query_id").agg(F.min_by("method", F.struct("real_cost", "method")).alias("method"), F.min("real_cost").alias("real_cost"))


def varied_queries(results: DataFrame) -> DataFrame:
    """Queries with two plans or more of two costs or more."""
    return clean(results).groupBy("query_id").agg(F.count(F.lit(1)).alias("plans"), F.countDistinct("real_cost").alias("costs")).where((F.col("plans") >= 2) & (F.col("costs") >= 2))


def plan_ranks(results: DataFrame) -> DataFrame:
    """Rank from 0 of each plan within its query by real cost."""
    return clean(results).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("real_cost", "method")) - 1)


def sample_by_size(queries: DataFrame, per_size: int, seed: int = 0, skip: int = 0) -> DataFrame:
    """At most ``per_size`` queries of each size after the first ``skip``, in the order of a seeded hash."""
    n = F.row_number().over(Window.partitionBy("size").orderBy(draw(seed, F.col("query_id")), "query_id"))
    return queries.withColumn("_n", n).where((F.col("_n") > skip) & (F.col("_n") <= skip + per_size)).drop("_n")


def correlation(history: DataFrame, columns: list[str], value: str) -> DataFrame:
    """column, r: Pearson correlation of each column with ``value``."""
    row = history.agg(*[F.corr(c, value).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("r")) for c in columns])).alias("x")).select("x.*")


def normalised(df: DataFrame, column: str) -> DataFrame:
    """Min-max to 0..1; a constant column gives 0."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return df.crossJoin(F.broadcast(ends)).withColumn(column, F.when(F.col("_hi") > F.col("_lo"), (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)).drop("_lo", "_hi")


def extremes(history: DataFrame, value: str = "loss", share: float = 0.2) -> DataFrame:
    """``history`` with bucket: ``best`` up to the ``share`` quantile, ``worst`` from the 1 - share quantile, the rows between dropped."""
    ends = history.agg(F.percentile(value, [share, 1 - share]).alias("_ends"))
    v = F.col(value)
    bucket = F.when(v <= F.col("_ends")[0], "best").when(v >= F.col("_ends")[1], "worst")
    return history.where(v.isNotNull()).crossJoin(F.broadcast(ends)).withColumn("bucket", bucket).where("bucket IS NOT NULL").drop("_ends")  # one row


def importance(history: DataFrame, columns: list[str], value: str = "loss", trees: int = 100, seed: int = 0) -> DataFrame:
    """column, importance: of a random forest that predicts ``value``; a missing parameter counts as its median."""
    from pyspark.ml.feature import Imputer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = history.where(F.col(value).isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(value).cast("double").alias("_value"))
    filled = Imputer(strategy="median", inputCols=columns, outputCols=columns).fit(rows).transform(rows)
    points = VectorAssembler(inputCols=columns, outputCol="_features").transform(filled)
    model = RandomForestRegressor(featuresCol="_features", labelCol="_value", numTrees=trees, featureSubsetStrategy="sqrt", seed=seed).fit(points)
    return history.sparkSession.createDataFrame([(c, float(x)) for c, x in zip(columns, model.featureImportances.toArray(), strict=True)], "column string, importance double")


RESULTS_JSON = "query_id long, ntriplepattern int, plans map<string, struct<predicted_cost: double, real_cost: double>>"


def unpacked_results(packed: DataFrame) -> DataFrame:
    """results of one row a query with plans by method; queries without plans have none, infinite costs are missing."""
    long = packed.where(F.col("plans").isNotNull()).select("query_id", F.coalesce("ntriplepattern", F.lit(0)).alias("size"), F.explode("plans").alias("method", "x"))
    return clean(long.select("query_id", "size", "method", "x.predicted_cost", "x.real_cost"))


def read_results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """results of JSON files of ``[{query_id, ntriplepattern, plans: {method: {predicted_cost, real_cost}}}, ...]``."""
    return unpacked_results(spark.read.schema(RESULTS_JSON).json(path, multiLine=not lines))


def read_history(spark: SparkSession, path: str, parameters: list[str], lines: bool = False) -> DataFrame:
    """iteration, loss and a column for each parameter of JSON files of ``[{iteration, loss, params: {...}}, ...]``."""
    raw = spark.read.schema("iteration long, loss double, params map<string, double>").json(path, multiLine=not lines)
    return raw.select("iteration", M.finite(F.col("loss")).alias("loss"), *[F.col("params")[p].alias(p) for p in parameters])
