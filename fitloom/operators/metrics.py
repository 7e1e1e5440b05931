"""Metrics, threshold / weight search and diagnostics (Q1-Q8, Q10-Q11).

No metric sorts or windows the row-level data in one task:
* AUC collapses rows to distinct scores, then ranks inside score buckets
  with offsets from a small per-bucket table (exact, parallel).
* Threshold scans map each score once to the number of grid thresholds it
  exceeds (integer arithmetic), aggregate per grid index, and take suffix
  sums over at most grid-size rows.
* Weight searches multiply rows by weights inside the tasks. For the AUC each
  block of rows sends, per weight and score range, its distinct blends with
  their counts as packed arrays, which one task per (weight, range) merges:
  exact, without a histogram's ties and without a row per (row, weight).
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitloom.session import cut_lineage, shuffles_freed

PREC = 12


def _r(c: Column) -> Column:
    return F.round(c, PREC)


# Q1 ---------------------------------------------------------------------------
def fold_accuracy(df: DataFrame, label: str, pred: str, fold: str) -> DataFrame:
    per = df.groupBy(fold).agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("acc"))
    return per.agg(_r(F.avg("acc")).alias("acc_mean"), _r(F.stddev_pop("acc")).alias("acc_std"),
                   F.count(F.lit(1)).alias("n_folds"))


# Q2 ---------------------------------------------------------------------------
def quantile_cuts(df: DataFrame, col: str, buckets: int) -> list[float]:
    """At most ``buckets - 1`` ascending cuts that deal the values of ``col`` evenly (approximate quantiles)."""
    probs = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(F.percentile_approx(F.col(col).cast("double"), probs, 10 * buckets).alias("e")).first()["e"]
    return sorted(set(cuts or []))


def range_bucket(value: Column, cuts: Sequence[float]) -> Column:
    """Number of cuts below ``value``: monotone, and even however the values crowd."""
    if not cuts:
        return F.lit(0)
    arr = F.array(*[F.lit(float(c)) for c in cuts])
    return F.size(F.filter(arr, lambda c: c < value.cast("double")))


def auc_by(df: DataFrame, label: str, score: str, by: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """Exact ROC AUC with ties counted half, per ``by`` group.

    Distinct scores carry (pos, neg) and lie in ranges cut by approximate
    quantiles, so crowded or unbounded scores spread evenly; a score's negatives-below = negatives in
    lower buckets (offset table) + negatives at lower scores in its bucket.
    """
    by = list(by)
    s = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("__p"),
                                   F.sum((1 - F.col(label)).cast("long")).alias("__n"))
    s = s.withColumn("__b", range_bucket(F.col(score), quantile_cuts(df, score, buckets)))
    bt = s.groupBy(*by, "__b").agg(F.sum("__n").alias("__bn"))
    wb = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy("__b").rowsBetween(
        Window.unboundedPreceding, -1)
    bt = bt.select(*by, "__b", F.coalesce(F.sum("__bn").over(wb), F.lit(0)).alias("__off"))
    win = Window.partitionBy(*by, "__b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("__below", F.coalesce(F.sum("__n").over(win), F.lit(0)))
    # The bucket table shares its lineage with ``s``: a plain join lets the shuffle of
    # ``s`` be reused and AQE broadcast the bucket table once its real size is known.
    s = s.join(bt, by + ["__b"], "inner")
    contrib = F.col("__p").cast("double") * ((F.col("__off") + F.col("__below")).cast("double") + F.col("__n") / 2.0)
    agg = s.groupBy(*by).agg(F.sum(contrib).alias("__num"), F.sum("__p").alias("n_pos"), F.sum("__n").alias("n_neg"))
    return agg.select(*by, _r(F.col("__num") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"), "n_pos", "n_neg")


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    return auc_by(df, label, score)


# Q3 / Q4 ------------------------------------------------------------------------
def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    y, p = F.col(label), F.col(pred)
    return df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 1) & (p == 0)).alias("fn"))


def f1(df: DataFrame, label: str, pred: str) -> DataFrame:
    c = confusion(df, label, pred)
    return c.select("tp", "fp", "fn", _r(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")))
                    .alias("f1"))


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """precision / recall / f1 / support per class, macro and weighted averages, accuracy (long form)."""
    c = confusion(df, label, pred)
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))

    def prf(t, f_p, f_n):
        pr = F.coalesce(F.try_divide(t, t + f_p), F.lit(0.0))
        rc = F.coalesce(F.try_divide(t, t + f_n), F.lit(0.0))
        f = F.coalesce(F.try_divide(2 * pr * rc, pr + rc), F.lit(0.0))
        return pr, rc, f

    p1, r1, f1_ = prf(tp, fp, fn)
    p0, r0, f0 = prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    n = s0 + s1
    rows = F.array(
        _row("0", p0, r0, f0, s0),
        _row("1", p1, r1, f1_, s1),
        _row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1_) / 2, n),
        _row("weighted avg", (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1_ * s1) / n, n),
        _row("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), (tp + tn) / n, n),
    )
    out = c.select(F.inline(rows))
    return out.select("klass", *[_r(F.col(m)).alias(m) for m in ("precision", "recall", "f1")],
                      F.col("support").cast("long").alias("support"))


def _row(k, p, r, f, s) -> Column:
    return F.struct(F.lit(k).alias("klass"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                    s.alias("support"))


# Q5 / Q6 ------------------------------------------------------------------------
def threshold_scan(df: DataFrame, label: str, score: str, lo: int, hi: int, step: int,
                   resolution: int = 10_000) -> DataFrame:
    """Confusion counts at every threshold T/resolution for T in lo..hi by step (predict p > t).

    Each row maps once to g = number of grid thresholds strictly below its
    score; counts per g become suffix sums over at most (grid + 1) rows.
    """
    spark = df.sparkSession
    n_grid = (hi - lo) // step + 1
    # about how many, then compared with the thresholds themselves: a product with the resolution is not exact
    near = F.least(F.lit(n_grid), F.greatest(F.lit(0), F.ceil((F.col(score) * resolution - lo) / step))).cast("int")

    def threshold(j: Column) -> Column:
        return (F.lit(lo) + j * step).cast("double") / F.lit(float(resolution))

    g = (F.when((near > 0) & ~(threshold(near - 1) < F.col(score)), near - 1)
         .when((near < n_grid) & (threshold(near) < F.col(score)), near + 1).otherwise(near)).cast("int")
    agg = df.groupBy(g.alias("g")).agg(F.sum(F.col(label).cast("long")).alias("pos"),
                                       F.sum((1 - F.col(label)).cast("long")).alias("neg"))
    grid = spark.range(n_grid + 1).select(F.col("id").cast("int").alias("g"))
    full = grid.join(F.broadcast(agg), "g", "left").fillna(0, ["pos", "neg"])
    w = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumns({"cpos": F.sum("pos").over(w), "cneg": F.sum("neg").over(w),
                             "P": F.sum("pos").over(Window.partitionBy()), "N": F.sum("neg").over(Window.partitionBy())})
    # threshold j (0-based) predicts positive for rows with g > j
    out = full.where(F.col("g") < n_grid).select(
        (F.lit(lo) + F.col("g") * step).cast("int").alias("t_units"),
        (F.col("P") - F.col("cpos")).alias("tp"), (F.col("N") - F.col("cneg")).alias("fp"),
        F.col("cneg").alias("tn"), F.col("cpos").alias("fn"))
    return out


def with_threshold_metrics(scan: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    return scan.withColumns({
        "f1": _r(F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))),
        "accuracy": _r((tp + tn) / (tp + fp + tn + fn)),
        "pos_rate": _r((tp + fp) / (tp + fp + tn + fn)),
    })


def best_threshold(df: DataFrame, label: str, score: str, lo: int, hi: int, step: int,
                   metric: str = "f1", resolution: int = 10_000) -> DataFrame:
    """First threshold (lowest) attaining the best metric value."""
    scan = with_threshold_metrics(threshold_scan(df, label, score, lo, hi, step, resolution))
    return scan.orderBy(F.col(metric).desc(), F.col("t_units").asc()).limit(1).select(
        "t_units", F.lit(metric).alias("metric"), F.col(metric).alias("value"))


def threshold_panel(df: DataFrame, score: str, thresholds_units: Sequence[int], base_units: int,
                    resolution: int = 10_000) -> DataFrame:
    """Positive rate at each threshold and the rows whose prediction differs from the base threshold."""
    exprs = [F.count(F.lit(1)).alias("n")]
    for t in list(thresholds_units) + [base_units]:
        exprs.append(F.count_if(F.col(score) > F.lit(t / resolution)).alias(f"c{t}"))
    a = df.agg(*exprs)
    rows = F.array(*[F.struct(F.lit(t).alias("t_units"), F.col(f"c{t}").alias("n_pos"),
                              F.abs(F.col(f"c{t}") - F.col(f"c{base_units}")).alias("n_changed"))
                     for t in thresholds_units])
    out = a.select("n", F.inline(rows))
    return out.select("t_units", "n_pos", _r(F.col("n_pos") / F.col("n")).alias("pos_rate"), "n_changed")


# Q7 ---------------------------------------------------------------------------
def simplex_weights(n_members: int, steps: int = 10) -> list[tuple[int, ...]]:
    """All weight vectors in units of 1/steps summing to 1 (lexicographic order), built directly."""
    if n_members == 1:
        return [(steps,)]
    return [(first, *rest) for first in range(steps + 1) for rest in simplex_weights(n_members - 1, steps - first)]


# Rows per score range, rows and weights per matrix product, and sampled rows per range, of the AUC weight search.
SEARCH_RANGE_ROWS = 500_000
SEARCH_BLOCK_ROWS = 250_000
SEARCH_WEIGHTS_AT_ONCE = 8
# Blends of 8 bytes that one pass of the AUC weight search shuffles (or the weights above, where the rows are more): the others wait.
SEARCH_BLENDS_AT_ONCE = 200_000_000
SEARCH_SAMPLE_PER_RANGE = 200


def _distinct_values(values):
    """Ascending distinct values and how often each comes (NaN: one value, the last)."""
    import numpy as np

    v = np.sort(values)
    first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) & ~np.isnan(v[:-1])])[:len(v)])
    return v[first], np.diff(np.concatenate([first, [len(v)]])).astype(np.int32)


def _weight_cuts(sample, weights, ranges):
    """Per weight at most ``ranges - 1`` ascending cuts of its own blends: they only deal the work, the result is exact with any."""
    import numpy as np

    probs = np.arange(1, ranges) / ranges
    blends = np.round(sample @ np.asarray(weights, dtype=float).T, PREC)
    known = [b[~np.isnan(b)] for b in blends.T]
    return [np.unique(np.quantile(b, probs, method="lower")) if len(b) and ranges > 1 else np.zeros(0) for b in known]


def _blend_counts(prob_cols, label, weights, cuts):
    """mapInPandas body: per block of rows, weight and score range the distinct blends of positives and of negatives.

    Copies travel only where a value comes more than once.
    """
    import numpy as np
    import pandas as pd

    kmat = np.asarray(weights, dtype=float).T            # members x weights

    def packed(values, edges):
        v, n = _distinct_values(values)
        at = np.concatenate([[0], np.searchsorted(v, edges, side="right"), [len(v)]])
        parts = [slice(lo, hi) for lo, hi in itertools.pairwise(at)]
        return [(v[p].tobytes(), n[p].tobytes() if (n[p] > 1).any() else b"") for p in parts]

    def block(frames):
        pdf = pd.concat(frames, ignore_index=True)
        probs = pdf[list(prob_cols)].to_numpy(dtype=float)
        positive = pdf[label].to_numpy(dtype=np.int64) == 1
        for lo in range(0, kmat.shape[1], SEARCH_WEIGHTS_AT_ONCE):
            blends = np.round(probs @ kmat[:, lo:lo + SEARCH_WEIGHTS_AT_ONCE], PREC)
            rows = []
            for j, edges in enumerate(cuts[lo:lo + SEARCH_WEIGHTS_AT_ONCE]):
                both = zip(packed(blends[positive, j], edges), packed(blends[~positive, j], edges), strict=True)
                rows += [(lo + j, r, *pos, *neg) for r, (pos, neg) in enumerate(both) if pos[0] or neg[0]]
            yield pd.DataFrame(rows, columns=["w_id", "rng", "pos", "n_pos", "neg", "n_neg"])

    def run(batches):
        held, rows = [], 0
        for pdf in batches:
            held, rows = [*held, pdf], rows + len(pdf)
            if rows >= SEARCH_BLOCK_ROWS:
                yield from block(held)
                held, rows = [], 0
        if rows:
            yield from block(held)
    return run


def _range_auc(pdf):
    """One (weight, score range): positives, negatives and the pairs won inside the range."""
    import numpy as np
    import pandas as pd

    def values(v, n):
        found = [np.frombuffer(x, float) for x in pdf[v]]
        copies = [np.frombuffer(c, np.int32) if c else np.ones(len(x), np.int32) for x, c in zip(found, pdf[n], strict=True)]
        return np.concatenate(found), np.concatenate(copies).astype(np.int64)

    pos, n_pos = values("pos", "n_pos")
    neg, n_neg = values("neg", "n_neg")
    order = np.argsort(neg)
    neg, upto = neg[order], np.concatenate([[0], np.cumsum(n_neg[order])])
    # lower negatives count twice, equal ones once
    twice = (n_pos * (upto[np.searchsorted(neg, pos, "left")] + upto[np.searchsorted(neg, pos, "right")])).sum()
    return pd.DataFrame({"w_id": [pdf["w_id"].iloc[0]], "rng": [pdf["rng"].iloc[0]], "pos": [n_pos.sum()], "neg": [upto[-1]], "won": [float(twice) / 2.0]})


def weight_search_auc(wide: DataFrame, label: str, prob_cols: Sequence[str], weights: Sequence[Sequence[float]],
                      range_rows: int = SEARCH_RANGE_ROWS) -> DataFrame:
    """Exact AUC (ties half) of sum(w_i * p_i) for every weight vector, blends rounded to ``PREC`` decimals.

    Tasks hold one block of rows and its blends for a few weights, or one score range of
    one weight (about ``range_rows`` rows, however unlike the weights' blends are: every weight is cut
    at quantiles of its own blends in a sample); the ranges' counts below
    are added up from a table of weights x ranges. Rows without a label count as negatives.
    """
    import numpy as np

    src = wide.select(F.coalesce(F.col(label).cast("int"), F.lit(0)).alias(label), *[F.col(c).cast("double") for c in prob_cols])
    src = cut_lineage(src)                               # counted, sampled and searched
    rows = src.count()
    ranges = -(-rows // range_rows)
    sample = np.zeros((0, len(prob_cols)))
    if ranges > 1:
        share = min(1.0, SEARCH_SAMPLE_PER_RANGE * ranges / rows)
        sample = np.array(src.select(*prob_cols).sample(share, seed=42).collect(), float).reshape(-1, len(prob_cols))
    cuts = _weight_cuts(sample, weights, ranges)
    at_once = max(SEARCH_WEIGHTS_AT_ONCE, SEARCH_BLENDS_AT_ONCE // max(rows, 1))
    if len(weights) <= at_once:
        agg = _weight_counts(src, label, prob_cols, weights, cuts)
    else:
        found = []
        with shuffles_freed(wide.sparkSession):          # the files of a pass go before the next one writes its own
            for lo in range(0, len(weights), at_once):
                part = _weight_counts(src, label, prob_cols, weights[lo:lo + at_once], cuts[lo:lo + at_once])
                found += part.withColumn("w_id", F.col("w_id") + lo).collect()
        agg = wide.sparkSession.createDataFrame(found, "w_id int, num double, p long, n long")
    return agg.select("w_id", _r(F.col("num") / (F.col("p") * F.col("n"))).alias("auc"))


def _weight_counts(src: DataFrame, label: str, prob_cols: Sequence[str], weights: Sequence[Sequence[float]], cuts: Sequence) -> DataFrame:
    """Per weight vector the pairs won, the positives and the negatives."""
    parts = src.mapInPandas(_blend_counts(prob_cols, label, weights, cuts),
                            "w_id int, rng int, pos binary, n_pos binary, neg binary, n_neg binary")
    per = parts.groupBy("w_id", "rng").applyInPandas(_range_auc, "w_id int, rng int, pos long, neg long, won double")
    below = Window.partitionBy("w_id").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    return per.groupBy("w_id").agg(F.sum(F.col("won") + F.col("pos").cast("double") * F.col("below")).alias("num"),
                                   F.sum("pos").alias("p"), F.sum("neg").alias("n"))


# Q8 ---------------------------------------------------------------------------
def _partial_accuracy(prob_cols, label, weights):
    """mapInPandas body: per partition, correct-prediction counts for every weight vector."""
    import numpy as np
    import pandas as pd

    wmat = np.asarray(weights, dtype=float).T            # members x weights

    def run(batches):
        correct = np.zeros(wmat.shape[1], dtype=np.int64)
        rows = 0
        for pdf in batches:
            if pdf.empty:
                continue
            blend = np.round(pdf[list(prob_cols)].to_numpy(dtype=float) @ wmat, PREC)
            y = pdf[label].to_numpy(dtype=np.int64)[:, None]
            correct += ((blend > 0.5).astype(np.int64) == y).sum(axis=0)
            rows += len(pdf)
        yield pd.DataFrame({"w_id": np.arange(wmat.shape[1], dtype=np.int32), "correct": correct,
                            "rows": np.full(wmat.shape[1], rows, dtype=np.int64)})
    return run


def weight_search_accuracy(wide: DataFrame, label: str, prob_cols: Sequence[str],
                           weights: Sequence[Sequence[float]]) -> DataFrame:
    """Accuracy of the rounded (half-to-even: 0.5 -> 0) blend for every normalised weight vector.

    Each task returns one (weight, correct, rows) row per weight vector (one
    matrix product per Arrow batch), so the shuffle is tasks x weights.
    """
    src = wide.select(F.col(label).cast("int").alias(label), *[F.col(c).cast("double") for c in prob_cols])
    part = src.mapInPandas(_partial_accuracy(prob_cols, label, weights), "w_id int, correct long, rows long")
    return part.groupBy("w_id").agg(_r(F.sum("correct") / F.sum("rows")).alias("accuracy"))


def normalised_grid(options: Sequence[float], n_members: int) -> list[tuple[float, ...]]:
    out = []
    for w in itertools.product(options, repeat=n_members):
        s = 0.0
        for x in w:
            s += x
        out.append(tuple(x / s for x in w))
    return out


# Q10 --------------------------------------------------------------------------
def agreement_stats(P: DataFrame) -> DataFrame:
    per = P.groupBy("row_id").agg((F.min("vote") == F.max("vote")).alias("__u"),
                                  F.round(F.avg("prob"), PREC).alias("__p"))
    p = F.col("__p")
    return per.agg(F.count_if("__u").alias("n_unanimous"),
                   F.count_if((p < 0.3) | (p > 0.7)).alias("n_confident"),
                   F.count_if(p > 0.9).alias("n_very_high"),
                   F.count_if(p < 0.7).alias("n_below_07"),
                   F.count_if((p >= 0.4) & (p <= 0.6)).alias("n_uncertain"),
                   F.count(F.lit(1)).alias("n_rows"))


# Q11 --------------------------------------------------------------------------
def rule_compliance(df: DataFrame, antecedent: Column, consequent: Column) -> DataFrame:
    a = F.coalesce(antecedent, F.lit(False))
    c = F.coalesce(consequent, F.lit(False))
    out = df.agg(F.count_if(a).alias("n_applicable"), F.count_if(a & c).alias("n_valid"),
                 F.count_if(a & ~c).alias("n_violation"))
    return out.withColumn("share_valid", _r(F.try_divide(F.col("n_valid").cast("double"), F.col("n_applicable"))))


# Functions of this module that run in tasks travel by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
