"""Mutual information of continuous features and a class by nearest neighbours (M4).

For a row i let r be the distance to its k-th nearest row of the same class, and m the rows of any class
nearer than r (itself included). Then MI = psi(N) + mean psi(k) - mean psi(class size) - mean psi(m), in
nats. One feature is one dimension, so both are read off sorted rows: neighbours are the next rows of the
class on either side, and m is a difference of two ranks.

Nothing is sorted in one task. Rows are ranked within (feature, class) over all partitions; windows run over
``block`` ranks and see ``k`` rows more on each side (the halo). The borders of the radius are put in order
together with the rows of the feature, and running counts of rows give their ranks.

NULL and NaN values and NULL classes are left out per feature, and so are classes of one row. Equal values
are not spread by noise: a radius of zero counts the rows of equal value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitloom.functions.ordering import BLOCK, numbered, ranked, running


def digamma(n: Column) -> Column:
    """psi(n) for n >= 1, by recurrence to n + 6 and the asymptotic series there (error under 1e-10)."""
    x = n.cast("double")
    t = x + 6.0
    series = F.log(t) - 1.0 / (2.0 * t) - 1.0 / (12.0 * t * t) + 1.0 / (120.0 * t * t * t * t) - 1.0 / (252.0 * t * t * t * t * t * t)
    series = series + 1.0 / (240.0 * t * t * t * t * t * t * t * t)
    for i in range(6):
        series = series - 1.0 / (x + float(i))
    return series


def radius(k: int) -> Column:
    """Distance to the k-th nearest of the sorted neighbours ``__l1..`` (below) and ``__h1..`` (above) of ``x``."""
    x, far = F.col("x"), F.lit(float("inf"))
    options = []
    for below in range(k + 1):
        left = (x - F.col(f"__l{below}")) if below else F.lit(0.0)
        right = (F.col(f"__h{k - below}") - x) if k - below else F.lit(0.0)
        options.append(F.greatest(F.coalesce(left, far), F.coalesce(right, far)))
    return F.least(*options) if len(options) > 1 else options[0]


def neighbour_information(df: DataFrame, cols: Sequence[str], label: str, k: int = 3, block: int = BLOCK) -> DataFrame:
    """(feature, mi): nearest-neighbour estimate for every column, not below zero."""
    if block < k:
        raise ValueError("a block must hold k rows")
    values = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])
    long = df.select(F.col(label).alias("y"), F.explode(values).alias("v")).select("v.feature", "y", "v.x")
    long = long.where(F.col("x").isNotNull() & ~F.isnan("x") & F.col("y").isNotNull())
    sizes = long.groupBy("feature", "y").agg(F.count(F.lit(1)).alias("ny")).where("ny > 1")
    points = ranked(long.join(sizes, ["feature", "y"]), ["feature", "y"], ["x"], "rank", block)

    # the halo: rows near a block's border go to the next block as well
    own, place = F.floor(F.col("rank") / block), F.col("rank") % block
    blocks = F.array_compact(F.array(own, F.when(place < k, own - 1), F.when(place >= block - k, own + 1)))
    near = points.withColumn("__block", F.explode(blocks))
    w = Window.partitionBy("feature", "y", "__block").orderBy("rank")
    sides = {f"__l{j}": F.lag("x", j).over(w) for j in range(1, k + 1)} | {f"__h{j}": F.lead("x", j).over(w) for j in range(1, k + 1)}
    near = near.select("*", *[c.alias(name) for name, c in sides.items()]).where(F.col("__block") == own)
    kth, r = F.lit(k), radius(k)
    for smaller in range(k - 1, 0, -1):                     # a class of j + 1 rows has j neighbours
        kth = F.when(F.col("ny") - 1 == smaller, F.lit(smaller)).otherwise(kth)
        r = F.when(F.col("ny") - 1 == smaller, radius(smaller)).otherwise(r)
    near = near.select("feature", "y", "rank", "ny", "x", kth.alias("kk"), r.alias("r"))

    # rows and the two borders of each radius in one order: rows above lo and below hi (of equal value where r is zero)
    flat = F.col("r") == 0
    marks = F.array(
        F.struct(F.col("x").alias("v"), F.lit(1).alias("kind"), F.lit(1).alias("row"), F.lit(0).alias("sign")),
        F.struct((F.col("x") + F.col("r")).alias("v"), F.when(flat, 2).otherwise(0).alias("kind"), F.lit(0).alias("row"), F.lit(1).alias("sign")),
        F.struct((F.col("x") - F.col("r")).alias("v"), F.when(flat, 0).otherwise(2).alias("kind"), F.lit(0).alias("row"), F.lit(-1).alias("sign")))
    line = near.select("feature", "y", "rank", "ny", "kk", F.explode(marks).alias("m")).select("feature", "y", "rank", "ny", "kk", "m.*")
    line = running(numbered(line, ["feature", "v", "kind"]), ["feature"], "at", F.col("row"), "upto", block)
    per_row = line.groupBy("feature", "y", "rank").agg(F.sum(F.col("sign") * F.col("upto")).alias("m"), F.max("ny").alias("ny"), F.max("kk").alias("kk"))
    mi = per_row.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg(digamma(F.col("kk"))).alias("k"), F.avg(digamma(F.col("ny"))).alias("c"), F.avg(digamma(F.col("m"))).alias("m"))
    value = digamma(F.col("n")) + F.col("k") - F.col("c") - F.col("m")
    return mi.select("feature", F.round(F.greatest(value, F.lit(0.0)), 9).alias("mi"))
