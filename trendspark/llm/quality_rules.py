"""Quality rules: base counts and minimum-covariance-determinant outliers per language and source. Native."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendspark.llm.common import SPACE, SPACE_CHARS, checkpoint, release, table, words

WINDOW = 8
# statistic -> least standard deviation that an estimate may have where no noise is given; keeps constant statistics regular
FLOORS = {"x_words": 1e-4, "x_length": 1e-4, "x_symbols": 1e-4, "x_upper": 1e-4, "x_lines": 1e-4, "x_repeats": 1e-4}
SUBSET = 0.75
START_STEPS = 2
MAX_STEPS, TOLERANCE = 12, 0.01  # steps of the best start, and the fall of the log determinant that ends them
BINS = 1024  # of a distance's doubling
MIN_GROUP = 100
BROADCAST_GROUPS = 20_000  # rows of some 50 numbers, four to a group at most
TAIL = 1e-5


def chi2_cdf(x: float, k: int) -> float:
    """Lower regularised gamma function at (k/2, x/2), by its series."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 1e-9, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return (low + high) / 2


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines and n_repeat_words (long); null texts have none.

    Windows are told apart by a 64-bit hash inside one document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__w", F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)))
    out = out.withColumn("__l", F.filter(F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(x, F.lit(SPACE_CHARS)) != "", x)), lambda x: x.isNotNull()))
    n = F.size("__w")
    out = out.withColumn(
        "__h", F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("__w", i, WINDOW))))
    )
    # only documents with a repeated window sort theirs
    pairs = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), pairs))
    near = lambda i: F.get(F.col("__s"), i)["h"]
    twice = F.filter(
        F.transform("__s", lambda x, i: F.when((x["h"] == near(i - 1)) | (x["h"] == near(i + 1)), x["i"])), lambda p: p.isNotNull()
    )
    out = out.withColumn("__p", F.array_sort(twice))
    covered = F.aggregate(
        "__p",
        F.struct(F.lit(0).alias("sum"), F.lit(-WINDOW).alias("last")),
        lambda s, p: F.struct((s["sum"] + F.least(F.lit(WINDOW), p - s["last"])).alias("sum"), p.alias("last")),
        lambda s: s["sum"],
    )
    out = out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_upper": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
        "n_lines": F.size("__l").cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    })
    return out.drop("__w", "__l", "__h", "__s", "__p")


def statistic_vector(stats: DataFrame) -> DataFrame:
    """Transformed statistics of FLOORS: logarithms of sizes, square roots of shares."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return stats.withColumns({
        "x_words": F.log1p("n_words"),
        "x_length": F.log1p(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))),
        "x_symbols": share("n_symbols", "word_chars"),
        "x_upper": share("n_upper", "word_chars"),
        "x_lines": share("n_dup_lines", "n_lines"),
        "x_repeats": share("n_repeat_words", "n_words"),
    })


def unit_noise() -> dict:
    """For each statistic of FLOORS, what one unit more does to the row's value: a word, a character, a symbol, a capital, a repeated line, a repeated window.

    Counts other than the words vary by their square root, which is taken where it is more than a unit.
    """
    n = F.greatest(F.col("n_words"), F.lit(1))
    more = lambda a, unit: F.col(a) + F.greatest(F.lit(float(unit)), F.sqrt(F.col(a) * unit))
    share = lambda a, b, unit: F.sqrt(more(a, unit) / F.greatest(F.col(b), F.lit(1))) - F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return {
        "x_words": F.log1p(F.col("n_words") + 1) - F.log1p("n_words"),
        "x_length": F.log1p(more("word_chars", 1) / n) - F.log1p(F.col("word_chars") / n),
        "x_symbols": share("n_symbols", "word_chars", 1),
        "x_upper": share("n_upper", "word_chars", 1),
        "x_lines": share("n_dup_lines", "n_lines", 1),
        "x_repeats": share("n_repeat_words", "n_words", WINDOW),
    }


# The estimates are wide selects; as SQL text each is one call to the JVM instead of hundreds.


def _each(text: str, p: int) -> list[str]:
    """text with {i} for each of p statistics."""
    return [text.format(i=i) for i in range(p)]


def _both(text: str, p: int) -> list[str]:
    """text with {i} and {j} for each pair j <= i."""
    return [text.format(i=i, j=j) for i in range(p) for j in range(i + 1)]


def subset_size(p: int, share: float = SUBSET) -> str:
    """Rows of the subset of n: the share of large groups, between (n + p + 1) / 2 and all rows of small ones."""
    half = f"least((n + {p + 1}) div 2, n)"
    return f"cast(floor(2 * {half} - n + 2 * (n - {half}) * {share}) as bigint)"


def _consistent(share: str, p: int) -> str:
    """Factor that makes the covariance of the nearest share of normal rows that of all."""
    factors = [k / 1000 / chi2_cdf(chi2_quantile(k / 1000, p), p + 2) for k in range(500, 1000, 5)]
    return f"get(array({', '.join(f'{x}D' for x in [*factors, 1.0])}), cast(greatest(floor(({share} - 0.5) * 200 + 0.5), 0) as int))"


def _fitted(moments: DataFrame, p: int) -> DataFrame:
    """Covariances c_i_j -> inverse w_i_j and log determinant, by sweeping one row after the other.

    A variance is at least the group's f_i; covariances shrink by p / (n + p), which keeps the
    matrix regular and matters in small groups only.
    """
    cell = lambda i, j: f"greatest(c_{i}_{i}, f_{i})" if i == j else f"c_{max(i, j)}_{min(i, j)} * n / (n + {p})"
    matrix = ", ".join(f"array({', '.join(cell(i, j) for j in range(p))})" for i in range(p))
    swept = """aggregate(sequence(0, {last}), named_struct('a', array({matrix}), 'ld', 0D), (s, k) -> named_struct(
      'a', transform(s.a, (r, i) -> transform(r, (x, j) -> case when i = k and j = k then -1 / s.a[k][k] when i = k or j = k then x / s.a[k][k]
        else x - s.a[i][k] * s.a[k][j] / s.a[k][k] end)), 'ld', s.ld + ln(s.a[k][k]))) as s""".format(last=p - 1, matrix=matrix)
    kept = ["__key", "start", "n", "h", "before", *_each("f_{i}", p), *_each("m_{i}", p)]
    return moments.selectExpr(*kept, swept).selectExpr(*kept, "s.ld as logdet", *_both("-s.a[{i}][{j}] as w_{i}_{j}", p))


def _distance(p: int, prefix: str = "") -> str:
    """Squared Mahalanobis distance of the columns z_i under the inverse w_i_j."""
    return " + ".join(f"{prefix}w_{i}_{j} * {prefix}z_{i} * {prefix}z_{j} * {1 if i == j else 2}D" for i in range(p) for j in range(i + 1))


def _near(points: DataFrame, params: DataFrame, p: int) -> DataFrame:
    """Each point under each of its group's estimates, with d2."""
    near = points.join(params, "__key").selectExpr("__key", "start", "n", "h", *_each("u_{i}", p), *_each("u_{i} - m_{i} as z_{i}", p), *_both("w_{i}_{j}", p))
    return near.selectExpr("__key", "start", "n", "h", *_each("u_{i}", p), f"{_distance(p)} as d2")


def _sums(near: DataFrame, keys: list[str], p: int, weight: str = "1D") -> DataFrame:
    """Weight k, sums a_i and sums of products b_i_j of the points."""
    return near.groupBy(*keys).agg(*[F.expr(x) for x in (f"sum({weight}) as k", *_each(f"sum({weight} * u_{{i}}) as a_{{i}}", p), *_both(f"sum({weight} * u_{{i}} * u_{{j}}) as b_{{i}}_{{j}}", p))])


def _estimate(sums: DataFrame, known: DataFrame, p: int, factor: str) -> DataFrame:
    """Sums k, a_i, b_i_j of a subset by group and start -> the estimate; factor: SQL that may use k and n."""
    means = sums.join(known, ["__key", "start"]).selectExpr("__key", "start", "n", "h", "logdet as before", *_each("f_{i}", p), *_each("a_{i} / k as m_{i}", p), *_both("b_{i}_{j} / k as b_{i}_{j}", p), f"{factor} as factor")
    covariances = _both("(b_{i}_{j} - m_{i} * m_{j}) * factor as c_{i}_{j}", p)
    return _fitted(means.selectExpr("__key", "start", "n", "h", "before", *_each("f_{i}", p), *_each("m_{i}", p), *covariances), p)


def concentrate(points: DataFrame, params: DataFrame, p: int, hint) -> DataFrame:
    """One step: the h nearest points of each estimate give the next one, whose determinant is no larger.

    Counts of logarithmic bins of the distance (0.07 % wide, in groups of any size) tell the bin
    in which the h-th point lies. Points of nearer bins count whole and those of that bin by the
    share that makes up h, so ties are treated alike. Only counts are shuffled for the bins, and
    one row a task for the sums.
    """
    near = _near(points, hint(params), p).withColumn("bin", F.expr(f"cast(floor(log2(greatest(d2, 1e-9D)) * {BINS}) as int)"))
    known = hint(params.select("__key", "start", "n", "h", "logdet", *_each("f_{i}", p)))
    bins = near.groupBy("__key", "start", "h", "bin").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("__key", "start").orderBy("bin"))
    edges = bins.withColumn("upto", upto).where("upto - k < h and upto >= h").selectExpr("__key", "start", "bin as edge", "(h - (upto - k)) / k as share")
    inside = near.join(hint(edges), ["__key", "start"]).where("bin <= edge")
    return checkpoint(_estimate(_sums(inside, ["__key", "start"], p, "if(bin = edge, share, 1D)"), known, p, _consistent("h / n", p)))


def _starts(points: DataFrame, frame: DataFrame, p: int, hint) -> DataFrame:
    """Deterministic starts: unit scales, correlations of bounded values and of directions, and the plain covariance."""
    norm = f"sqrt({' + '.join(_each('u_{i} * u_{i}', p))} + 1e-12)"
    variants = {"bounded": "tanh(u_{i})", "directions": "u_{i} / " + norm, "plain": "u_{i}"}
    made = ", ".join(f"named_struct('start', '{k}', {', '.join(f'{chr(39)}u_{i}{chr(39)}, {v.format(i=i)}' for i in range(p))})" for k, v in variants.items())
    made = points.selectExpr("__key", f"explode(array({made})) as v").select("__key", "v.*")
    known = frame.selectExpr("__key", "n", "h", *_each("f_{i}", p), "cast(null as double) as before")
    # directions are taken about the centre
    centred = _sums(made, ["__key", "start"], p).join(hint(known), "__key").selectExpr(
        "__key", "start", "n", "h", "before", *_each("f_{i}", p), *_each("if(start = 'plain', a_{i} / k, 0D) as m_{i}", p), *_both("b_{i}_{j} / k - if(start = 'directions', 0D, a_{i} / k * a_{j} / k) as v_{i}_{j}", p)
    )
    covariance = [f"if(start = 'plain', v_{i}_{j}, {'1D' if i == j else f'v_{i}_{j} / sqrt(greatest(v_{i}_{i}, 1e-12D) * greatest(v_{j}_{j}, 1e-12D))'}) as c_{i}_{j}" for i in range(p) for j in range(i + 1)]
    kept = ["__key", "start", "n", "h", "before", *_each("f_{i}", p), *_each("m_{i}", p)]
    unit = known.selectExpr("*", "'scales' as start", *_each("0D as m_{i}", p), *[f"{int(i == j)}D as c_{i}_{j}" for i in range(p) for j in range(i + 1)])
    return checkpoint(_fitted(centred.selectExpr(*kept, *covariance).unionByName(unit), p))


def _groups(rows: DataFrame, groups: list[str], min_group: int) -> DataFrame:
    """(groups, __key): the pool that each group belongs to, from the counts of the groups."""
    sizes = rows.groupBy(*groups).agg(F.count("*").alias("__n"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    first = F.concat_ws("\x1f", F.lit("1"), text(groups[0]))
    for key in (F.concat_ws("\x1f", F.lit("2"), *map(text, groups)), first, F.lit("0")):
        if "__key" not in sizes.columns:
            sizes = sizes.withColumn("__key", key)
        else:
            sizes = sizes.withColumn("__key", F.when(F.sum("__n").over(Window.partitionBy("__key")) < min_group, key).otherwise(F.col("__key")))
    return checkpoint(sizes.drop("__n"))


def _frame(keyed: DataFrame, floors: list[float], share: float, hint) -> DataFrame:
    """(__key, n, h, q_i, r_i, f_i): size, subset size, medians, scales, and least variances in units of the scales.

    Quartiles are read from counts of bins of 1/1024.
    """
    p = len(floors)
    each = F.expr("explode(array(" + ", ".join(_each("named_struct('i', {i}, 'bin', floor(x_{i} * 1024))", p)) + ")) as v")
    counts = keyed.select("__key", each).groupBy("__key", "v.i", "v.bin").agg(F.count("*").alias("k"))
    w = Window.partitionBy("__key", "i")
    counts = counts.withColumns({"upto": F.sum("k").over(w.orderBy("bin")), "n": F.sum("k").over(w)})
    quartiles = [f"min(if(i = {i} and upto >= {q} * n, (bin + 0.5D) / 1024, null)) as q{k}_{i}" for i in range(p) for k, q in enumerate((0.25, 0.5, 0.75))]
    quartiles = counts.groupBy("__key").agg(F.max("n").alias("n"), *map(F.expr, quartiles))
    least = keyed.groupBy("__key").agg(*[F.expr(f"greatest(avg(e_{i}), {x**2}D) as f_{i}") for i, x in enumerate(floors)])
    scaled = quartiles.join(hint(least), "__key").selectExpr("__key", "n", *_each("q1_{i} as q_{i}", p), *_each("greatest((q2_{i} - q0_{i}) / 1.349D, sqrt(f_{i})) as r_{i}", p), *_each("f_{i}", p))
    return checkpoint(scaled.selectExpr("__key", "n", f"{subset_size(p, share)} as h", *_each("q_{i}", p), *_each("r_{i}", p), *_each("f_{i} / r_{i} / r_{i} as f_{i}", p)))


def _planned_once(spark: SparkSession) -> SparkSession:
    """A session of its own without adaptive planning: for sums of a few thousand rows, planning each stage anew takes the driver more time and memory than it saves."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.adaptive.enabled", "false")
    return own


def fit_mcd(stats: DataFrame, group_cols: list[str], subset: float = SUBSET, min_group: int = MIN_GROUP, noise: dict | None = None) -> DataFrame:
    """One row a group of stats with its robust centre and inverse covariance: the subset of least determinant, then one reweighting.

    Groups are all of group_cols; those under min_group rows are pooled by the first of them, and
    pools that stay too small become one, which gets its estimate however small it is. Values are
    standardised by medians and quartile ranges. From four starts two concentration steps are
    taken; the start with the least determinant goes on until no group's determinant gets smaller
    (or MAX_STEPS). noise: statistic -> column with a row's standard deviation of measurement; the
    group's mean of its square (at least the square in FLOORS) is the least variance of an estimate,
    and changes no larger one. All sums and counts are pre-aggregated, so a hot group is no
    bottleneck; estimates of up to BROADCAST_GROUPS groups are broadcast, more are joined.
    """
    noise, p = noise or {}, len(FLOORS)
    groups = [f"g_{i}" for i in range(len(group_cols))]
    values = [F.col(c).alias(f"x_{i}") for i, c in enumerate(FLOORS)]
    noises = [(noise[c] * noise[c] if c in noise else F.lit(0.0)).alias(f"e_{i}") for i, c in enumerate(FLOORS)]
    rows = stats.select(*[F.col(c).alias(g) for g, c in zip(groups, group_cols)], *values, *noises)
    pools = _groups(rows, groups, min_group)
    hint = F.broadcast if pools.count() <= BROADCAST_GROUPS else lambda df: df
    named = hint(pools.select(*[F.col(g).alias(f"__{g}") for g in groups], "__key"))
    keyed = rows.join(named, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups]).drop(*[f"__{g}" for g in groups])
    frame = _frame(keyed, list(FLOORS.values()), subset, hint)
    spark = stats.sparkSession
    loop = _planned_once(spark) if hint is F.broadcast else spark
    scales = frame.select("__key", *_each("q_{i}", p), *_each("r_{i}", p))
    points = checkpoint(keyed.join(hint(scales), "__key").selectExpr("__key", *_each("(x_{i} - q_{i}) / r_{i} as u_{i}", p)), loop)
    params = _starts(points, checkpoint(frame, loop), p, hint)
    for _ in range(START_STEPS):
        params = concentrate(points, params, p, hint)
    rank = F.row_number().over(Window.partitionBy("__key").orderBy("logdet", "start"))
    params = checkpoint(params.withColumn("__r", rank).where("__r = 1").drop("__r"))
    release(spark)
    for _ in range(MAX_STEPS):
        params = concentrate(points, params, p, hint)
        if (params.agg(F.max(F.col("before") - F.col("logdet"))).first()[0] or 0) < TOLERANCE:
            break
    inside = _near(points, hint(params), p).where(F.col("d2") <= chi2_quantile(0.975, p))
    last = _estimate(_sums(inside, ["__key", "start"], p), hint(params), p, f"{0.975 / chi2_cdf(chi2_quantile(0.975, p), p + 2)}D")
    last = checkpoint(last.withColumnRenamed("before", "mcd_logdet").drop("start", *_each("f_{i}", p)), spark)
    model = checkpoint(pools.join(hint(last), "__key").join(hint(scales), "__key"))
    release(spark)
    return model


def mcd_distances(stats: DataFrame, model: DataFrame, group_cols: list[str]) -> DataFrame:
    """Add d2, the squared robust Mahalanobis distance of each row to its group (null where the model lacks the group)."""
    p = len(FLOORS)
    hint = F.broadcast if model.count() <= BROADCAST_GROUPS else lambda df: df
    named = hint(model.selectExpr(*[f"{c} as __{c}" for c in model.columns if not c.startswith("__")]))
    near = stats.join(named, [F.col(c).eqNullSafe(F.col(f"__g_{i}")) for i, c in enumerate(group_cols)], "left")
    z = [F.expr(f"({c} - __q_{i}) / __r_{i} - __m_{i}").alias(f"__z_{i}") for i, c in enumerate(FLOORS)]
    near = near.select(*stats.columns, *z, *_both("__w_{i}_{j}", p))
    return near.select(*stats.columns, F.expr(_distance(p, "__")).alias("d2"))


def judge(docs: DataFrame, text_col: str = "text", group_cols=("lang", "source"), tail: float = TAIL, min_group: int = MIN_GROUP) -> DataFrame:
    """Statistics of each row with base_failed, d2 and kept, and all columns of docs but the text.

    base_failed: under 20 words, or over 30 % of the words in repeated windows of 8. kept is
    false for those and for rows whose distance passes the chi-square quantile at 1 - tail.
    The estimates use the rows that pass the base rules; a statistic that hardly varies in a
    group is judged by what one unit does to a text (unit_noise). Every row that passes the base
    rules gets a verdict. Null texts have no words and fail; a null language or source is a group
    of its own; repeated rows are judged each; an empty table stays empty.
    """
    cols = [c for c in docs.columns if c not in (text_col, *STAT_COLS)]
    stats = statistic_vector(text_counts(docs.select(*cols, text_col), text_col)).drop(text_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    stats = checkpoint(stats.withColumn("base_failed", failed))
    model = fit_mcd(stats.where(~F.col("base_failed")), list(group_cols), min_group=min_group, noise=unit_noise())
    out = mcd_distances(stats, model, list(group_cols)).withColumn("d2", F.when(~F.col("base_failed"), F.col("d2")))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= chi2_quantile(1 - tail, len(FLOORS)), F.lit(False)))


STAT_COLS = ("n_words", "word_chars", "n_symbols", "n_upper", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "d2", "kept", *FLOORS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
