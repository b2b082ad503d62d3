"""Embedding whitening by singular values: blockwise QR, Householder bidiagonals, dqds, twisted factorisations.

The centred rows are never multiplied with each other for the components: every task reduces its
rows to a triangle by QR, triangles are reduced in a tree, and the singular values of the last one
(squared, over n) are the eigenvalues of the covariance. It is brought to bidiagonal form by Householder
reflections; dqds finds the squares of its singular values to high relative accuracy; each right
singular vector comes from the twisted factorisation with the least pivot, and is carried back
through the reflections.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspark.llm.common import checkpoint, table

#: Components returned at most.
COMPONENTS = 16
#: Entries c become floor(SCALE * c) + OFFSET; greater ones than LARGEST in size can't be told apart as integers.
SCALE, OFFSET, LARGEST = 64, 1_000_000, 2.0**45
#: Triangles that one task reduces to one.
FAN_IN = 16
EPS = np.finfo(float).eps
#: Components with less of the greatest eigenvalue than this are rounding errors.
LEAST = 1e-13
#: Eigenvalues nearer to each other than this (relatively) are a cluster, whose vectors are made orthogonal.
CLUSTER = 1e-3

# ------------------------------------------------------------------ the solver, on one small triangle


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, w) of a square matrix r = u b w^T, by Householder reflections; u isn't needed."""
    b, d = np.array(r, float), len(r)
    w = np.eye(d)

    def reflection(x: np.ndarray) -> tuple[np.ndarray, float]:
        """v and beta with (1 - beta v v^T) x = a multiple of the first unit vector."""
        size = np.abs(x).max(initial=0)
        if size == 0:
            return x, 0.0
        v = x / size
        norm = np.sqrt(v @ v)
        v[0] += norm if v[0] >= 0 else -norm
        return v, 2 / (v @ v)

    for k in range(d):
        v, beta = reflection(b[k:, k].copy())
        b[k:, k:] -= np.outer(beta * v, v @ b[k:, k:])
        if k < d - 2:
            v, beta = reflection(b[k, k + 1 :].copy())
            b[k:, k + 1 :] -= np.outer(b[k:, k + 1 :] @ v, beta * v)
            w[:, k + 1 :] -= np.outer(w[:, k + 1 :] @ v, beta * v)
    return np.diag(b).copy(), np.diag(b, 1).copy(), w


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling.

    Differential quotient-difference steps with shifts: a shift is a lower bound of the least
    value by the last step's pivots, and is halved when a pivot turns negative; without one
    the step is exact to a few units of rounding each. Small ends are split off.
    """
    scale = max(np.abs(diagonal).max(initial=0), np.abs(upper).max(initial=0))
    if not len(diagonal) or scale == 0:
        return np.zeros(len(diagonal))
    out: list[float] = []
    blocks = [((diagonal / scale) ** 2, (upper / scale) ** 2, 0.0)]
    tiny = np.finfo(float).tiny
    while blocks:
        q, e, moved = blocks.pop()
        shift = 0.0
        while len(q):
            n = len(q)
            if n == 1:
                out.append(moved + q[0])
                break
            # the last superdiagonal is negligible: its value is found
            if e[-1] <= (EPS / 4) ** 2 * (moved + q[-1]) or e[-1] <= tiny:
                out.append(moved + q[-1])
                q, e, shift = q[:-1], e[:-1], 0.0
                continue
            gaps = np.flatnonzero((e <= (EPS / 4) ** 2 * (moved + np.minimum(q[:-1], q[1:]))) | (e <= tiny))
            if len(gaps):
                cut = int(gaps[-1]) + 1
                blocks.append((q[:cut], e[: cut - 1], moved))
                q, e, shift = q[cut:], e[cut:], 0.0
                continue
            if q[0] < q[-1]:  # graded the wrong way round: the same values from the other end
                q, e = _flipped(q, e)
            while True:
                new_q, new_e, least = _step(q, e, shift)
                if new_q is not None:
                    break
                shift = shift / 4 if shift > EPS * (moved + q.min()) else 0.0
            q, e, moved = new_q, new_e, moved + shift
            # the least pivot bounds the least value from above; how much e still couples lowers it
            guess = least - np.sqrt(q[-2] if len(q) > 1 else 0) * np.sqrt(e[-1]) if least == q[-1] else least / 4
            shift = max(0.0, min(guess, 0.98 * least))
    return np.sort(np.array(out))[::-1] * scale**2


def _flipped(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The qd array of the matrix with rows and columns in reverse order; b b^T and b^T b have the same values."""
    return q[::-1].copy(), e[::-1].copy()


def _step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray | None, np.ndarray | None, float]:
    """One dqds transformation, and its least pivot; None where a pivot is negative."""
    n = len(q)
    new_q, new_e = np.empty(n), np.empty(n - 1)
    qs, es = q.tolist(), e.tolist()
    d = least = qs[0] - shift
    if d < 0:
        return None, None, d
    for k in range(n - 1):
        total = d + es[k]
        if total <= 0:
            return None, None, d
        new_q[k] = total
        ratio = qs[k + 1] / total
        new_e[k] = es[k] * ratio
        d = d * ratio - shift
        if d < 0:
            return None, None, d
        least = min(least, d)
    new_q[-1] = d
    return new_q, new_e, least


def twisted_vectors(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of b^T b for some of its eigenvalues (falling), b upper bidiagonal.

    b^T b - value is factored from the top and from the bottom; where both meet with the least pivot, the
    vector has its greatest entry, and the others follow by products. Vectors of a cluster of values are
    made orthogonal to the earlier ones of the cluster and solved for again.
    """
    n = len(diagonal)
    scale = max(np.abs(diagonal).max(), np.abs(upper).max(initial=0))
    a, b = diagonal / scale, upper / scale
    main, side = a**2 + np.r_[0, b**2], a[:-1] * b
    out = np.zeros((n, len(values)))
    for k, value in enumerate(values / scale**2):
        first = k
        while first and values[first - 1] - values[first] <= CLUSTER * values[first - 1]:
            first -= 1
        cluster = out[:, first:k]
        top, bottom, mid = _factors(a, b, value)
        at = int(np.argmin(np.abs(mid)))
        z = _solved(top, bottom, side, at)
        for _ in range(4 if k > first else 0):
            z -= cluster @ (cluster.T @ z)
            size = np.linalg.norm(z)
            if size < 1e-8:  # the same direction again: start from another end
                at = (at + n // 2 + 1) % n
                z = np.random.default_rng(at).standard_normal(n)
                z -= cluster @ (cluster.T @ z)
                size = np.linalg.norm(z)
            z = _inverse(main - value, side, z / size)
        z -= cluster @ (cluster.T @ z)
        z -= cluster @ (cluster.T @ z)
        out[:, k] = z / np.linalg.norm(z)
    return out


def _factors(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pivots of b^T b - value from the top and from the bottom, by differential steps, and the twisted pivots."""
    n, small = len(a), np.finfo(float).tiny / EPS
    q, e = a**2, np.r_[b**2, 0.0]
    top, s = np.empty(n), np.empty(n)  # stationary: s + q is a pivot
    s[0] = -value
    for k in range(n):
        top[k] = s[k] + q[k]
        if abs(top[k]) < small:
            top[k] = -small
        if k < n - 1:
            s[k + 1] = s[k] * (e[k] / top[k]) - value
    bottom, p = np.empty(n), np.empty(n)  # progressive: p + e is a pivot
    p[-1] = q[-1] - value
    bottom[-1] = p[-1]
    for k in range(n - 2, -1, -1):
        low = p[k + 1] + e[k]
        if abs(low) < small:
            low = -small
        bottom[k + 1] = low
        p[k] = p[k + 1] * (q[k] / low) - value
    bottom[0] = p[0]
    return top, bottom, s + p + value


def _solved(top: np.ndarray, bottom: np.ndarray, side: np.ndarray, at: int) -> np.ndarray:
    """The vector with 1 at the twist."""
    n = len(top)
    z = np.zeros(n)
    z[at] = 1
    for k in range(at - 1, -1, -1):
        z[k] = -side[k] / top[k] * z[k + 1]
    for k in range(at + 1, n):
        z[k] = -side[k - 1] / bottom[k] * z[k - 1]
    return z / np.linalg.norm(z)


def _inverse(main: np.ndarray, side: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One step of inverse iteration for a symmetric tridiagonal matrix, by elimination with row exchanges."""
    n = len(main)
    d, u, u2, y = main.astype(float), np.r_[side, 0.0], np.zeros(n), y.copy()
    low = np.r_[side, 0.0]
    least = EPS * max(np.abs(main).max(), np.abs(side).max(initial=0), np.finfo(float).tiny)
    for k in range(n - 1):
        if abs(low[k]) > abs(d[k]):
            d[k], low_k, (u[k], d[k + 1]), (u2[k], u[k + 1]) = low[k], d[k], (d[k + 1], u[k]), (u[k + 1], 0.0)
            y[k], y[k + 1] = y[k + 1], y[k]
        else:
            low_k = low[k]
        d[k] = d[k] if d[k] else least
        f = low_k / d[k]
        d[k + 1] -= f * u[k]
        u[k + 1] -= f * u2[k]
        y[k + 1] -= f * y[k]
    d[-1] = d[-1] if abs(d[-1]) > least else least
    x = np.zeros(n + 2)
    for k in range(n - 1, -1, -1):
        x[k] = (y[k] - u[k] * x[k + 1] - u2[k] * x[k + 2]) / d[k]
    return x[:n] / np.linalg.norm(x[:n])


def directions(triangle: np.ndarray, n: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, directions as columns, trace) of the covariance triangle^T triangle / n: the greatest `most` over rounding level.

    Vectors of b^T b are those of the blocks between vanished superdiagonals.
    """
    diagonal, upper, w = bidiagonal(triangle)
    d = len(diagonal)
    values, vectors = [], []
    scale = max(np.abs(diagonal).max(initial=0), np.abs(upper).max(initial=0))
    cuts = [0, *(np.flatnonzero(np.abs(upper) <= EPS**2 * scale) + 1).tolist(), d]
    for s, e in zip(cuts[:-1], cuts[1:]):
        own = dqds(diagonal[s:e], upper[s : e - 1])
        kept = own[own > LEAST * max(scale**2, np.finfo(float).tiny)][:most]
        if len(kept):
            v = np.zeros((d, len(kept)))
            v[s:e] = twisted_vectors(diagonal[s:e], upper[s : e - 1], kept) if e - s > 1 else 1.0
            values.append(kept)
            vectors.append(v)
    trace = float((triangle**2).sum()) / n if n else 0.0
    if not values:
        return np.zeros(0), np.zeros((d, 0)), trace
    all_values = np.concatenate(values)
    order = np.argsort(-all_values, kind="stable")[:most]
    keep = all_values[order] > LEAST * all_values.max()
    return all_values[order][keep] / n, w @ np.concatenate(vectors, axis=1)[:, order][:, keep], trace


# ------------------------------------------------------------------ on Spark


def integers(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """Add x, the vector as integers; rows whose vector is null or empty, or holds null, non-finite or too large entries, go."""
    whole = F.forall(F.col(vector_col), lambda c: F.coalesce(F.abs(c.cast("double")) <= LARGEST, F.lit(False)) & ~F.isnan(c.cast("double")))
    kept = rows.where(F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & whole)
    return kept.withColumn("x", F.transform(vector_col, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET))


def _dimension(distinct: DataFrame) -> int | None:
    """The length that most vectors have, the greater one of several; a table with one row a length."""
    got = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return got["d"] if got else None


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.int64)


def _sums(distinct: DataFrame, d: int) -> tuple[int, list[int]]:
    """n and the exact sums of the dimensions."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, [0] * d
        for b in batches:
            n += len(b)
            if len(b):
                total = [t + s for t, s in zip(total, _matrix(b["x"]).sum(axis=0, dtype=object))]
        yield pd.DataFrame({"n": [n], "total": [[str(t) for t in total]]})

    parts = distinct.select("x").mapInPandas(part, "n long, total array<string>")
    exact = F.posexplode("total").alias("k", "s")
    rows = parts.select(exact).groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return parts.agg(F.sum("n")).first()[0] or 0, [int(r["s"]) for r in sorted(rows, key=lambda r: r["k"])]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n * x - sums, exactly, as integers (of Python where 64 bits don't do), and x - sums / n."""
    if n and max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0)) < 2**61:
        exact = n * x - np.array(sums, np.int64)
    else:
        exact = n * x.astype(object) - np.array(sums, object)
    return exact, exact.astype(float) / n


def _triangle(distinct: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows: a triangle a partition, then trees of FAN_IN to one until few are left."""
    d = len(sums)

    def merged(have: np.ndarray, more: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack([have, more]), mode="r")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, d))
        for b in batches:
            for s in range(0, len(b), 4096):
                r = merged(r, _centred(_matrix(b["x"].iloc[s : s + 4096]), n, sums)[1])
        if len(r):
            yield pd.DataFrame({"part": [0], "r": [r.ravel()]})

    def triangles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, d))
        for b in batches:
            for x in b["r"]:
                r = merged(r, np.asarray(x).reshape(-1, d))
        if len(r):
            yield pd.DataFrame({"part": [0], "r": [r.ravel()]})

    schema = "part int, r array<double>"
    level = checkpoint(distinct.select("x").mapInPandas(rows, schema))
    count = level.count()
    while count > FAN_IN:
        count = -(-count // FAN_IN)
        level = checkpoint(level.repartition(count).mapInPandas(triangles, schema))
    out = np.zeros((d, d))
    for x in level.collect():  # FAN_IN triangles at most
        r = merged(out, np.asarray(x["r"]).reshape(-1, d))
        out = r
    return out


def whitened(rows: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", most: int = COMPONENTS) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error): each kept row along up to `most` components.

    Components belong to the distinct integer vectors of the table (n of them). deviation is the exact
    sum of (n * x - S)^2 over dimensions, null where it is over 2^63 - 1. identity_error is the greatest entry of
    the whitened distinct vectors' covariance less the identity. Signs are such that the greatest
    entry of a direction is positive. Rows that `integers` drops are not returned, nor those of another
    length than most distinct vectors have. There are no more components than the vectors' rank: one distinct
    vector, or none, gives no rows. Repeated rows and null ids are rows of their own. Other columns are ignored.
    """
    spark = rows.sparkSession
    rows = integers(rows.select(F.col(id_col).alias("__id"), F.col(vector_col).alias("__vector")), "__vector").select("__id", "x")
    # equal vectors meet in their tasks first, so that a very common one sends one row a task
    distinct = checkpoint(rows.select("x").distinct())
    schema = f"`{id_col}` {rows.schema['__id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    d = _dimension(distinct)
    if d is None:
        return spark.createDataFrame([], schema)
    distinct = distinct.where(F.size("x") == d)
    n, sums = _sums(distinct, d)
    values, vectors, trace = directions(_triangle(distinct, n, sums), n, most)
    if not len(values):
        return spark.createDataFrame([], schema)
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    project = vectors / np.sqrt(values)
    m = len(values)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, squares = np.zeros(m), np.zeros((m, m))
        for b in batches:
            if len(b):
                y = _centred(_matrix(b["x"]), n, sums)[1] @ project
                total += y.sum(axis=0)
                squares += y.T @ y
        yield pd.DataFrame({"k": range(m * (m + 1)), "s": np.r_[total, squares.ravel()]})

    got = distinct.select("x").mapInPandas(moments, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    flat = np.array([r["s"] for r in sorted(got, key=lambda r: r["k"])]) / n
    # the means are zero but for rounding
    error = float(np.abs(flat[m:].reshape(m, m) - np.outer(flat[:m], flat[:m]) - np.eye(m)).max())
    share = values / trace

    def along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            exact, centred = _centred(_matrix(b["x"]), n, sums)
            if exact.dtype == object or np.abs(exact).max() > 2**31 / np.sqrt(d):
                exact = exact.astype(object)
            square = (exact * exact).sum(axis=1)
            deviation = pd.array([v if v < 2**63 else None for v in map(int, square)], dtype="Int64")
            y = centred @ project
            yield pd.DataFrame({
                "__id": b["__id"].repeat(m).array, "component": np.tile(np.arange(1, m + 1), len(b)), "n": n, "deviation": deviation.repeat(m),
                "whitened": y.ravel(), "explained": np.tile(share, len(b)), "identity_error": error,
            })

    return rows.where(F.size("x") == d).mapInPandas(along, schema.replace(f"`{id_col}`", "__id", 1)).withColumnRenamed("__id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
