"""Retrieval metrics over tables of ranked results and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendspark.functions.order import numbered

BY = ["query_id", "method"]
HELD = 500_000  # differences that a row of the bootstrap holds


def grade_results(ranked: DataFrame, grades: DataFrame) -> DataFrame:
    return ranked.join(grades.select("query_id", "chunk_id", "rel"), ["query_id", "chunk_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def grades_of(pairs: DataFrame, queries: DataFrame, labelled: DataFrame, by: str = "keyword") -> DataFrame:
    """(query_id, chunk_id, rel) of the pairs whose chunk is graded for the query's group. queries: query_id, by; labelled: chunk_id, by, rel. No other pair of a group is made."""
    asked = pairs.select("query_id", "chunk_id").distinct().join(queries.select("query_id", by), "query_id")
    return asked.join(labelled.select("chunk_id", by, "rel"), ["chunk_id", by]).select("query_id", "chunk_id", "rel")


def best_grades(queries: DataFrame, labelled: DataFrame, k: int, by: str = "keyword") -> DataFrame:
    """(query_id, chunk_id, rel) of the k best graded chunks of each query, which are all that its ideal needs; they are found once a group."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("rel"), "chunk_id"))
    best = labelled.select("chunk_id", by, "rel").where(F.col(by).isNotNull()).withColumn("rank", rank).where(F.col("rank") <= k)
    return queries.select("query_id", by).join(F.broadcast(best), by).select("query_id", "chunk_id", "rel")


def precision_at_k(k: int, threshold: int = 2) -> Column:
    """Aggregate over a query's graded results; divides by k even if there are fewer."""
    return F.sum(F.when((F.col("rank") <= k) & (F.col("rel") >= threshold), 1).otherwise(0)) / k


def mean_relevance_at_k(k: int) -> Column:
    return F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)) / k


def mrr(threshold: int = 2) -> Column:
    return F.coalesce(1 / F.min(F.when(F.col("rel") >= threshold, F.col("rank"))), F.lit(0.0))


def _gain(rel: Column, exponential: bool) -> Column:
    return F.pow(F.lit(2.0), rel) - 1 if exponential else rel.cast("double")


def dcg_at_k(k: int, exponential: bool = False) -> Column:
    return F.sum(F.when(F.col("rank") <= k, _gain(F.col("rel"), exponential) / F.log2(F.col("rank") + 1)).otherwise(0.0))


def ideal_dcg(grades: DataFrame, k: int, exponential: bool = False) -> DataFrame:
    """(query_id, ideal) from all graded chunks of the query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "chunk_id"))
    return grades.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("query_id").agg(dcg_at_k(k, exponential).alias("ideal"))


def _normalised(dcg: Column, ideal: Column) -> Column:
    return F.when(ideal > 0, dcg / ideal).otherwise(0.0)


def ndcg_at_k(graded: DataFrame, grades: DataFrame, k: int, exponential: bool = False) -> DataFrame:
    d = graded.groupBy(*BY).agg(dcg_at_k(k, exponential).alias("dcg"))
    return d.join(ideal_dcg(grades, k, exponential), "query_id", "left").select(*BY, _normalised(F.col("dcg"), F.col("ideal")).alias("ndcg"))


def per_query(graded: DataFrame, grades: DataFrame, k: int, threshold: int = 2) -> DataFrame:
    """All metrics of a query and method, in one pass over the graded results."""
    m = graded.groupBy(*BY).agg(precision_at_k(k, threshold).alias("precision"), mean_relevance_at_k(k).alias("mean_rel"), mrr(threshold).alias("mrr"), dcg_at_k(k).alias("dcg"))
    return m.join(ideal_dcg(grades, k), "query_id", "left").select(*BY, "precision", "mean_rel", "mrr", _normalised(F.col("dcg"), F.col("ideal")).alias("ndcg"))


def nearest_rank(values: Column, q: float) -> Column:
    """Of a sorted array, by position round(q * (n - 1)) with halves to even."""
    return F.get(values, F.bround(q * (F.size(values) - 1), 0).cast("int"))


def method_summary(queries: DataFrame) -> DataFrame:
    """Means of the metrics, median and 95 % latency of each method. The latencies of a method are one number a query."""
    g = queries.groupBy("method").agg(
        F.avg("precision").alias("precision"), F.avg("mean_rel").alias("mean_rel"), F.avg("ndcg").alias("ndcg"), F.avg("mrr").alias("mrr"),
        F.percentile("latency_ms", F.lit(0.5)).alias("latency_median"), F.array_sort(F.collect_list("latency_ms")).alias("l"),
    )
    return g.withColumn("latency_p95", nearest_rank(F.col("l"), 0.95)).drop("l")


def method_overlap(ranked: DataFrame) -> DataFrame:
    """(a, b, overlap): mean Jaccard of two methods' results over the queries that either has."""
    ids = ranked.groupBy(*BY).agg(F.collect_set("chunk_id").alias("ids"))
    # a query's methods are few: their pairs are made in its own row, without a join
    methods = ids.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("method", "ids"))).alias("m"))
    both = methods.select(F.posexplode("m").alias("i", "a"), "m").select("a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    share = F.size(F.array_intersect("a.ids", "b.ids")) / F.greatest(F.size(F.array_union("a.ids", "b.ids")), F.lit(1))
    return both.groupBy(F.col("a.method").alias("a"), F.col("b.method").alias("b")).agg(F.avg(share).alias("overlap"))


def sensitivity(graded: DataFrame, grades: DataFrame, k: int) -> DataFrame:
    """(method, metric, setting, value) for thresholds 1 and 2 and both gains, of one pass over the results and one over the grades."""
    measures = [f(t).alias(f"{n}_{t}") for t in (1, 2) for n, f in (("precision", lambda t: precision_at_k(k, t)), ("mrr", mrr))]
    per = graded.groupBy(*BY).agg(*measures, dcg_at_k(k).alias("linear"), dcg_at_k(k, True).alias("exp"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "chunk_id"))
    ideal = grades.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("query_id").agg(dcg_at_k(k).alias("best_linear"), dcg_at_k(k, True).alias("best_exp"))
    per = per.join(ideal, "query_id", "left").withColumns({f"ndcg_{e}": _normalised(F.col(e), F.col(f"best_{e}")) for e in ("linear", "exp")})
    m = per.groupBy("method").agg(*[F.avg(c).alias(c) for c in ("precision_1", "precision_2", "mrr_1", "mrr_2", "ndcg_linear", "ndcg_exp")])
    pairs = [F.struct(F.lit(c.rsplit("_", 1)[0]).alias("metric"), F.lit(c.rsplit("_", 1)[1]).alias("setting"), F.col(c).alias("value")) for c in m.columns if c != "method"]
    return m.select("method", F.inline(F.array(*pairs)))


def paired_bootstrap(diffs: DataFrame, draws: int = 2000, alpha: float = 0.05, seed: str = "0", block: int = HELD) -> DataFrame:
    """Mean, interval, wins and significance of paired differences (query_id, diff).

    Draw b takes for its i-th place the difference of the position md5(seed:b:i) mod n. A draw is
    one row that folds its places over the differences in order, held in blocks of bounded size; so
    neither draws nor places are exploded or joined, and no task sorts all differences.
    """
    ranked = numbered(diffs.select("query_id", "diff"), ["query_id"], "pos").select((F.col("pos") - 1).alias("pos"), F.col("diff").cast("double").alias("diff"))
    n = diffs.agg(F.count("*").alias("n"), F.avg("diff").alias("mean_diff"), F.count_if(F.col("diff") > 0).alias("wins"))
    size = ranked.count()
    b, total = F.col("id").cast("string"), F.lit(max(size, 1)).cast("long")
    place = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), b, i.cast("string"))), 1, 8), 16, 10).cast("long") % total
    means = diffs.sparkSession.range(draws if size else 0).withColumn("s", F.lit(0.0))
    for first in range(0, size, block):
        part = ranked.where((F.col("pos") >= first) & (F.col("pos") < first + block))
        values = part.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "diff"))), lambda x: x["diff"]).alias("values"))  # block numbers
        start = F.lit(first)
        fold = F.aggregate(F.sequence(F.lit(0).cast("long"), total - 1), F.col("s"), lambda s, i: s + F.coalesce(F.get("values", (place(i) - start).cast("int")), F.lit(0.0)))  # noqa: B023
        means = means.join(F.broadcast(values)).withColumn("s", fold).drop("values")
    order = means.agg(F.array_sort(F.collect_list(F.col("s") / total)).alias("ms"))  # one number a draw
    low, high = int(alpha / 2 * draws), min(int((1 - alpha / 2) * draws), draws - 1)
    out = n.join(F.broadcast(order)).select("n", "mean_diff", F.get("ms", F.lit(low)).alias("ci_low"), F.get("ms", F.lit(high)).alias("ci_high"), "wins")
    return out.withColumn("significant", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))


def grade_key(model: str, prompt: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(model), F.md5(F.lit(prompt)), "query_id", F.col("chunk_id").cast("string")))


def pending_grades(pool: DataFrame, cache: DataFrame, model: str, prompt: str) -> tuple[DataFrame, DataFrame]:
    """(pairs without a cached grade, pairs with grade, quote and reason)."""
    keyed = pool.withColumn("key", grade_key(model, prompt))
    return keyed.join(cache.select("key"), "key", "left_anti"), keyed.join(cache, "key")
