"""Aggregates over points, leaves and groups."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import solve2
from ..functions.matrices import determinant
from ..functions.ordering import number_of, order_key


def lowest(points: DataFrame) -> DataFrame:
    """z and id of the lowest point, the smaller id of equals."""
    return points.agg(F.min(order_key("z", "id")).alias("key")).select("key.v", number_of("key").alias("id")).withColumnRenamed("v", "z")


def histogram(leaves: DataFrame, value: Column, name: str) -> DataFrame:
    return leaves.groupBy(value.alias(name)).agg(F.count("*").alias("leaves"))


def histogram_summary(leaves: DataFrame) -> DataFrame:
    """Leaves, points, whole mean, least and most points of a leaf."""
    return leaves.agg(F.count("*").alias("leaves"), F.sum("n").alias("points"), F.floor(F.sum("n") / F.count("*")).cast("long").alias("mean"), F.min("n").alias("least"), F.max("n").alias("most"))


def weighted_mean(hist: DataFrame, value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def mode(hist: DataFrame, value: str, weight: str) -> DataFrame:
    """The value of the largest weight, the smallest of equals."""
    return hist.agg(F.max(F.struct(weight, F.negate(value).alias("minus"))).alias("m")).select(F.negate("m.minus").alias(value), F.col(f"m.{weight}").alias(weight))


def centroids(points: DataFrame, key: str) -> DataFrame:
    return points.groupBy(key).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.avg("intensity").alias("intensity"))


def spacing(leaves: DataFrame) -> DataFrame:
    """Points, occupied area and mean spacing over leaves with points."""
    return leaves.filter("n > 0").agg(F.sum("n").alias("n"), F.sum(4 * F.col("radius") * F.col("radius")).alias("area")).select("n", "area", F.sqrt(F.col("area") / F.col("n")).alias("spacing"))


def scatter(points: DataFrame, *keys: str) -> DataFrame:
    """Sums of products about the mean, not divided by n: xx, xy, xz, yy, yz, zz."""
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return points.groupBy(*keys).agg(F.count("*").alias("n"), *[(F.covar_pop(a, b) * F.count("*")).alias(a + b) for a, b in pairs])


def plane_fit(points: DataFrame, target: str, *keys: str) -> DataFrame:
    """Least squares a, b, c of target = a x + b y + c per group, on centred coordinates; null if singular."""
    c = lambda u, v: F.covar_pop(u, v)
    g = points.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg(target).alias("mt"), c("x", "x").alias("xx"), c("x", "y").alias("xy"), c("y", "y").alias("yy"), c("x", target).alias("xt"), c("y", target).alias("yt"))
    a, b = solve2(F.col("xx"), F.col("xy"), F.col("xy"), F.col("yy"), F.col("xt"), F.col("yt"))
    return g.select(*keys, a.alias("a"), b.alias("b"), (F.col("mt") - a * F.col("mx") - b * F.col("my")).alias("c"))


def line_fit(points: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    return points.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def polynomial_fit(points: DataFrame, x: str, y: str, degree: int, *keys: str) -> DataFrame:
    """Least squares coefficients a, b, c ... of y = a x^degree + ... per group, highest power first, about the mean of x; null if singular.

    Degree 3 at most: the normal equations are solved in columns.
    """
    means = points.groupBy(*keys).agg(F.avg(x).alias("_m"))
    j = points.join(means, list(keys)) if keys else points.crossJoin(F.broadcast(means))  # one row
    u = F.col(x) - F.col("_m")
    power = lambda p: reduce(Column.__mul__, [u] * p, F.lit(1.0))
    g = j.groupBy(*keys, "_m").agg(*[F.sum(power(p)).alias(f"s{p}") for p in range(2 * degree + 1)], *[F.sum(power(p) * F.col(y)).alias(f"t{p}") for p in range(degree + 1)])
    n = range(degree + 1)
    m = [[F.col(f"s{r + c}") for c in n] for r in n]
    det = determinant(m)
    # of the powers of x - mean, least first
    about = [F.when(det != 0, determinant([[F.col(f"t{r}") if c == k else m[r][c] for c in n] for r in n]) / det) for k in n]
    g = g.select(*keys, "_m", *[v.alias(f"k{i}") for i, v in enumerate(about)])
    term = lambda i, p: F.col(f"k{i}") * reduce(Column.__mul__, [-F.col("_m")] * (i - p), F.lit(float(math.comb(i, p))))
    return g.select(*keys, *[reduce(Column.__add__, [term(i, p) for i in range(p, degree + 1)]).alias("abcd"[degree - p]) for p in reversed(n)])


def parabola_fit(points: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """Least squares a, b, c of y = a x^2 + b x + c per group."""
    return polynomial_fit(points, x, y, 2, *keys)


def exponential_fit(points: DataFrame, x: str, y: str, key: str, steps: int = 60) -> DataFrame:
    """(key, a, b): least squares of y = a exp(b x) on y itself per group, by Gauss-Newton steps from the fit of ln y.

    Only the mean of y at each value of x counts for it, so a group is reduced to its values of x (settings, few) before
    they come together in one row. Values of y that are not above 0 do not count for the start. Null for fewer than two values of x.
    """
    at = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(key, F.col(x).cast("double").alias("x")).agg(F.count("*").cast("double").alias("n"), F.avg(y).alias("y"), F.avg(F.when(F.col(y) > 0, F.log(y))).alias("log"))
    start = at.groupBy(key).agg(F.regr_slope("log", "x").alias("slope"), F.regr_intercept("log", "x").alias("cut"), F.sort_array(F.collect_list(F.struct("x", "y", "n"))).alias("p"))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("ee", "ef", "ff", "er", "fr")])

    def sums(s: Column, p: Column, a: Column, b: Column) -> Column:
        e = F.exp(b * p["x"])
        f, r = a * p["x"] * e, p["y"] - a * e
        new = {"ee": e * e, "ef": e * f, "ff": f * f, "er": e * r, "fr": f * r}
        return F.struct(*[(s[c] + v * p["n"]).alias(c) for c, v in new.items()])

    def step(s: Column, _: Column) -> Column:
        t = F.aggregate("p", zero, lambda acc, p: sums(acc, p, s["a"], s["b"]))
        det = t["ee"] * t["ff"] - t["ef"] * t["ef"]
        da, db = (t["er"] * t["ff"] - t["ef"] * t["fr"]) / det, (t["ee"] * t["fr"] - t["er"] * t["ef"]) / det
        return F.when(det > 0, F.struct((s["a"] + da).alias("a"), (s["b"] + db).alias("b"))).otherwise(s)

    fit = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.exp("cut").alias("a"), F.col("slope").alias("b")), step)
    return start.select(key, F.when((F.size("p") > 1) & F.col("slope").isNotNull(), fit).alias("f")).select(key, "f.a", "f.b")


def values_of(points: DataFrame, key: str, column: str, value: int) -> DataFrame:
    """(key, at, left): the place of ``value`` among a group's sorted distinct values of ``column``, -1 without it, and how many others there are."""
    own = points.select(key, column).distinct().groupBy(key).agg(F.count_if(F.col(column) < value).alias("below"), F.count_if(F.col(column) == value).alias("has"), F.count_if(F.col(column) != value).alias("left"))
    return own.select(key, F.when(F.col("has") > 0, F.col("below")).otherwise(-1).cast("int").alias("at"), F.col("left").cast("int").alias("left"))


def normalized(points: DataFrame, column: str) -> DataFrame:
    """``column`` scaled to 0..1 over the cloud."""
    r = points.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return points.crossJoin(F.broadcast(r)).withColumn("scaled", (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")
