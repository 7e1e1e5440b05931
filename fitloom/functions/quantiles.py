"""Exact global quantiles with bounded memory.

Spark's exact ``percentile`` merges a map of every distinct value into the
single task of a global aggregate, which does not survive a large continuous
column. Here each needed order statistic is found by narrowing: one
aggregate per pass builds a (interval, bucket) histogram with per-bucket
min / max / count over the rows still inside an open interval; the interval
holding the wanted rank shrinks to one bucket's [min, max]. Once an interval
holds at most ``max_collect / open intervals`` rows (or a single value), its
(value, count) pairs are collected -- at most ``max_collect`` per pass in all --
and the order statistic is read off exactly. NULL and NaN are skipped, infinite
values counted at the ends. Interpolation follows Spark's ``percentile``:
pos = (n - 1) * p, value = (hi - pos) * x[lo] + (pos - lo) * x[hi].
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _order_statistics(long: DataFrame, targets: Sequence[tuple[int, int]], init: dict[int, tuple[int, float, float]],
                      bins: int, max_collect: int) -> dict[tuple[int, int], float]:
    """k-th smallest values for (column id, rank) targets over a long (__cid, __v) frame, all columns per pass."""
    x, cid = F.col("__v"), F.col("__cid")
    # open intervals: id -> [column id, a, b, below, count]
    intervals = {i: [c, float(lo), float(hi), 0, n] for i, (c, (n, lo, hi)) in enumerate(sorted(init.items()))}
    start = {c: i for i, (c, _) in enumerate(sorted(init.items()))}
    owner = {t: start[t[0]] for t in targets}
    result: dict[tuple[int, int], float] = {}

    def inside(i):
        c, a, b = intervals[i][:3]
        return (cid == c) & x.between(a, b)

    # every pass shrinks each open interval to one of its ``bins`` buckets, so the loop ends
    while owner:
        for t, iid in list(owner.items()):
            if intervals[iid][1] == intervals[iid][2]:
                result[t] = intervals[iid][1]
                del owner[t]
        if not owner:
            break
        live = sorted(set(owner.values()))
        small = [i for i in live if intervals[i][4] <= max(1, max_collect // len(live))]
        big = [i for i in live if i not in small]
        if small:
            cond = None
            for i in small:
                cond = inside(i) if cond is None else (cond | inside(i))
            pairs: dict[int, list] = {}
            for row in long.where(cond).groupBy("__cid", "__v").agg(F.count(F.lit(1)).alias("n")).collect():
                pairs.setdefault(row[0], []).append((row[1], row[2]))
            for t, iid in list(owner.items()):
                if iid not in small:
                    continue
                c, a, b, below, _ = intervals[iid]
                k = t[1] - below
                for v, n in sorted(pairs.get(c, [])):
                    if v < a or v > b:
                        continue
                    if k < n:
                        result[t] = float(v)
                        break
                    k -= n
                del owner[t]
        if not big:
            continue
        iid_expr, bucket_expr, cond = None, None, None
        for i in big:
            a, b = intervals[i][1], intervals[i][2]
            ins = inside(i)
            bk = F.least(F.lit(bins - 1), F.floor((x / 2 - F.lit(a / 2)) / F.lit(b / 2 - a / 2) * bins)).cast("int")
            iid_expr = F.when(ins, F.lit(i)) if iid_expr is None else iid_expr.when(ins, F.lit(i))
            bucket_expr = F.when(ins, bk) if bucket_expr is None else bucket_expr.when(ins, bk)
            cond = ins if cond is None else (cond | ins)
        hist = (long.where(cond).select(iid_expr.alias("i"), bucket_expr.alias("k"), x.alias("v"))
                .groupBy("i", "k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx"))
                .collect())
        by_interval: dict[int, list] = {}
        for row in hist:
            by_interval.setdefault(row["i"], []).append((row["k"], row["n"], row["mn"], row["mx"]))
        next_id = max(intervals) + 1
        new_ids: dict[tuple, int] = {}
        for t, iid in list(owner.items()):
            if iid not in by_interval:
                continue
            below = intervals[iid][3]
            for k, n, mn, mx in sorted(by_interval[iid]):
                if t[1] - below < n:
                    key = (iid, k)
                    if key not in new_ids:
                        new_ids[key] = next_id
                        intervals[next_id] = [intervals[iid][0], float(mn), float(mx), below, n]
                        next_id += 1
                    owner[t] = new_ids[key]
                    break
                below += n
    return result


def exact_quantiles_multi(df: DataFrame, cols: Sequence[str], probs: Sequence[float], bins: int = 1024,
                          max_collect: int = 50_000) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of several columns (same values as Spark ``percentile``).

    The columns are stacked into one long (column id, value) frame that is
    persisted (memory, spilling to disk) for the few passes of the search, so
    each pass is one job for all columns; it is released afterwards.
    """
    from pyspark import StorageLevel

    cols = list(cols)
    long = (df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("__cid"), F.col(c).cast("double").alias("__v"))
                                          for i, c in enumerate(cols)])).alias("__s"))
            .select("__s.__cid", "__s.__v").where(F.col("__v").isNotNull() & ~F.isnan("__v"))
            .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        st = {r["__cid"]: r for r in long.groupBy("__cid").agg(
            F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"),
            F.count_if(F.col("__v") == float("-inf")).alias("n_low"),
            F.min(F.when(F.abs("__v") < float("inf"), F.col("__v"))).alias("f_lo"),
            F.max(F.when(F.abs("__v") < float("inf"), F.col("__v"))).alias("f_hi"),
            F.count_if(F.abs("__v") < float("inf")).alias("n_fin")).collect()}
        targets, spots = set(), {}
        for i in st:
            n = st[i]["n"]
            spots[i] = []
            for p in probs:
                pos = (n - 1) * float(p)
                lo_r, hi_r = int(math.floor(pos)), int(math.ceil(pos))
                spots[i].append((pos, lo_r, hi_r))
                targets.update({(i, lo_r), (i, hi_r)})
        # infinite values are order statistics by count alone; the search runs over the finite ones
        vals, finite = {}, []
        for i, k in sorted(targets):
            if k < st[i]["n_low"]:
                vals[(i, k)] = float("-inf")
            elif k >= st[i]["n_low"] + st[i]["n_fin"]:
                vals[(i, k)] = float("inf")
            else:
                finite.append((i, k - st[i]["n_low"]))
        init = {i: (r["n_fin"], r["f_lo"], r["f_hi"]) for i, r in st.items() if r["n_fin"]}
        found = _order_statistics(long.where(F.abs("__v") < float("inf")), finite, init, bins, max_collect) if finite else {}
        vals.update({(i, k + st[i]["n_low"]): v for (i, k), v in found.items()})
    finally:
        long.unpersist()
    out = {}
    for i, c in enumerate(cols):
        if i not in st:
            out[c] = [None for _ in probs]
            continue
        res = []
        for pos, lo_r, hi_r in spots[i]:
            lv, hv = vals[(i, lo_r)], vals[(i, hi_r)]
            res.append(lv if hi_r == lo_r or lv == hv else (hi_r - pos) * lv + (pos - lo_r) * hv)
        out[c] = res
    return out


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], bins: int = 1024,
                    max_collect: int = 50_000) -> list[float | None]:
    """Linear-interpolated quantiles of one column's non-NULL values (same values as Spark ``percentile``)."""
    return exact_quantiles_multi(df, [col], probs, bins, max_collect)[col]


def group_quantiles(df: DataFrame, by, col: str, probs: Sequence[float], names: Sequence[str] | None = None,
                    buckets: int = 128) -> DataFrame:
    """Exact linear-interpolated quantiles of ``col`` per group, skew-safe.

    Rows collapse to (group, value, count) with partial aggregation. Each
    value gets its rank range [start, start + count) from a running count that
    runs inside (group, value bucket) partitions -- buckets are cut by
    approximate global quantiles, so a hot group is spread over many tasks --
    plus the bucket's offset. The order statistics are then picked with
    conditional aggregates per group; no task holds a group's values.
    Matches Spark ``percentile`` (pos = (n - 1) * p).
    """
    from pyspark.sql import Window

    by = [by] if isinstance(by, str) else list(by)
    names = list(names) if names else [f"{col}_q{str(p).replace('.', '_')}" for p in probs]
    x = df.select(*by, F.col(col).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    counts = x.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__c"))
    edges = x.agg(F.percentile_approx("__v", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("e")).first()["e"]
    edges = sorted(set(edges or []))
    bucket = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col("__v"))) if edges \
        else F.lit(0)
    counts = counts.withColumn("__b", bucket)
    bt = counts.groupBy(*by, "__b").agg(F.sum("__c").alias("__bn"))
    wb = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.select(*by, "__b", F.coalesce(F.sum("__bn").over(wb), F.lit(0)).alias("__off"),
                   F.sum("__bn").over(Window.partitionBy(*by)).alias("__n"))
    w = Window.partitionBy(*by, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    lb = counts.withColumn("__lb", F.coalesce(F.sum("__c").over(w), F.lit(0)))
    bt = bt.select(*[F.col(c).alias(f"__k_{c}") for c in by], "__b", "__off", "__n").withColumnRenamed("__b", "__kb")
    cond = F.col("__b") == F.col("__kb")
    for c in by:                                    # NULL group keys form a group, as in groupBy
        cond = cond & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    ranked = lb.join(bt, cond).drop("__kb", *[f"__k_{c}" for c in by])
    start = F.col("__off") + F.col("__lb")
    end = start + F.col("__c")
    aggs = [F.first("__n").alias("__n")]
    for i, p in enumerate(probs):
        pos = (F.col("__n") - 1).cast("double") * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs.append(F.max(F.when((start <= lo) & (lo < end), F.col("__v"))).alias(f"__lo{i}"))
        aggs.append(F.max(F.when((start <= hi) & (hi < end), F.col("__v"))).alias(f"__hi{i}"))
    g = ranked.groupBy(*by).agg(*aggs)
    outs = []
    for i, (p, name) in enumerate(zip(probs, names)):
        pos = (F.col("__n") - 1).cast("double") * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        lv, hv = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        outs.append(F.when((hi == lo) | (lv == hv), lv).otherwise((hi - pos) * lv + (pos - lo) * hv).alias(name))
    return g.select(*by, *outs)
