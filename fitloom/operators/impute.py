"""Imputation and repair (inventory D1-D15).

Every statistic is computed set-based from the originally non-NULL values
(one aggregate per statistic family), then attached by a checked-size join or
as literals; there are no per-row loops, and the row-at-a-time fills of a
pandas loop (where an earlier fill changes a later median) are deliberately
not reproduced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitloom.functions.joins import lookup_join, scalar_row
from fitloom.functions.parse import tolerant_bool
from fitloom.functions.quantiles import exact_quantiles, exact_quantiles_multi, group_quantiles
from fitloom.functions.rowwise import row_sum
from fitloom.operators.encode import fit_standard, one_hot
from fitloom.operators.groupstats import group_mode


def _median(c: str, exact: bool = True) -> Column:
    return F.median(c) if exact else F.percentile_approx(c, 0.5, 100_000)


def _median_table(df: DataFrame, key: str, col: str, name: str, exact: bool = True) -> DataFrame:
    """Per-group median table: exact and skew-safe (rank ranges), or the one-pass sketch."""
    if exact:
        return group_quantiles(df, key, col, [0.5], [name])
    return df.groupBy(key).agg(F.percentile_approx(col, 0.5, 100_000).alias(name))


# D1 ---------------------------------------------------------------------------
def fill_constant(df: DataFrame, values: Mapping[str, object], suffix: str = "") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


# D2 ---------------------------------------------------------------------------
def fit_global_median(train: DataFrame, cols: Sequence[str], exact: bool = True) -> dict:
    """Median per column: exact through the bounded-memory quantile search, or the one-pass sketch."""
    if exact:
        return {c: v[0] for c, v in exact_quantiles_multi(train, cols, [0.5]).items()}
    return scalar_row(train.agg(*[_median(c, False).alias(c) for c in cols]))


# D3 ---------------------------------------------------------------------------
def fit_global_mode(train: DataFrame, col: str, fallback=None):
    """Most frequent non-NULL value (ties -> smallest); ``fallback`` when the column is all NULL."""
    counts = train.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    r = counts.agg(F.min_by(F.col(col), F.struct((-F.col("__n")).alias("a"), F.col(col).alias("b"))).alias("m"))
    v = scalar_row(r)["m"]
    return fallback if v is None else v


# D4 ---------------------------------------------------------------------------
def conditional_fill(df: DataFrame, train: DataFrame, col: str, state: str, out: str | None = None) -> DataFrame:
    """Missing value -> 0 when the state is true, else the mean over state-false training rows."""
    out = out or col
    m = scalar_row(train.where(F.col(state) == F.lit(False)).agg(F.avg(col).alias("m")))["m"]
    m = 0.0 if m is None else m
    fill = F.when(F.col(state) == F.lit(True), F.lit(0.0)).when(F.col(state) == F.lit(False), F.lit(m))
    return df.withColumn(out, F.coalesce(F.col(col), fill))


# D5 / D6 ------------------------------------------------------------------------
def group_stat_fill(df: DataFrame, col: str, key: str, out: str | None = None, stat: str = "median",
                    where: Column | None = None, default=None, fit_on: DataFrame | None = None,
                    exact: bool = True) -> DataFrame:
    """Missing -> statistic of ``col`` within the row's ``key`` group, then ``default``.

    ``default='global'`` falls back to the same statistic over all rows (D5 cascade).
    """
    out = out or col
    src = (fit_on if fit_on is not None else df)
    if where is not None:
        src = src.where(where)
    src = src.where(F.col(col).isNotNull())
    agg = _median(col, exact) if stat == "median" else F.avg(col)
    keyed = src.where(F.col(key).isNotNull())
    table = (_median_table(keyed, key, col, "__fill", exact) if stat == "median"
             else keyed.groupBy(key).agg(agg.alias("__fill")))
    if default == "global":
        default = (exact_quantiles(src, col, [0.5])[0] if stat == "median" and exact
                   else scalar_row(src.agg(agg.alias("g")))["g"])
    j = lookup_join(df, table, key, "left")
    fill = F.col("__fill") if default is None else F.coalesce(F.col("__fill"), F.lit(default))
    return j.withColumn(out, F.coalesce(F.col(col), fill)).drop("__fill")


# D7 ---------------------------------------------------------------------------
# The spend limit 1000 and the ages 35 and 29 below.
def rule_cascade(df: DataFrame, spend_cols: Sequence[str], state: str, vip: str, age: str, group: str,
                 category: str, category_rules: Mapping[str, str], category_default: str,
                 vip_spend: float = 1000.0, age_if_state: float = 35.0, age_default: float = 29.0) -> DataFrame:
    """Rule-based fills: state from spend, VIP from spend, age from group mean then constants,
    category from a second column."""
    total = row_sum(spend_cols)
    st = tolerant_bool(state, default=None)
    state_r = F.coalesce(st, F.when(total == 0, 1).when(total > 0, 0), F.lit(0))
    # spend of rows in the state counts as zero before it decides on VIP
    total = F.when(state_r == 1, F.lit(0.0)).otherwise(total)
    vp = tolerant_bool(vip, default=None)
    vip_r = F.coalesce(vp, F.when(total > vip_spend, 1), F.lit(0))
    gmean = df.where(F.col(age).isNotNull()).groupBy(group).agg(F.avg(age).alias("__gm"))
    d = lookup_join(df, gmean, group, "left").withColumn("state_r", state_r).withColumn("vip_r", vip_r)
    age_r = (F.when(F.col(age).isNotNull() & (F.col(age) > 0), F.col(age))
             .when(F.col("__gm").isNotNull(), F.col("__gm"))
             .when(F.col("state_r") == 1, F.lit(age_if_state)).otherwise(F.lit(age_default)))
    cat = F.lit(category_default)
    for k, v in reversed(list(category_rules.items())):
        cat = F.when(F.col(category[1]) == F.lit(k), F.lit(v)).otherwise(cat)
    cat_r = F.coalesce(F.col(category[0]), cat)
    return d.withColumns({"age_r": age_r, "category_r": cat_r}).drop("__gm")


def side_from_vip(df: DataFrame, side: str, vip: str, out: str, unknown: str = "Unknown",
                  if_vip: str = "P", otherwise: str = "S") -> DataFrame:
    """Unknown side: one value for VIPs (after their own repair), the other for the rest."""
    known = F.col(side).isNotNull() & (F.col(side) != unknown)
    return df.withColumn(out, F.when(known, F.col(side)).when(F.col(vip) == 1, F.lit(if_vip)).otherwise(F.lit(otherwise)))


# D8 ---------------------------------------------------------------------------
def repair_contradictions(df: DataFrame, state: str, spend_cols: Sequence[str], out_state: str = "state_fixed",
                          suffix: str = "_fixed") -> DataFrame:
    """state true => spends 0; any spend > 0 => state false; unknown state with zero spend => true."""
    s = tolerant_bool(state, default=None)
    total = row_sum(spend_cols)
    fixed_state = (F.when(s == 1, 1).when(total > 0, 0).when(s.isNull() & (total == 0), 1)
                   .otherwise(s))
    d = df.withColumn(out_state, fixed_state)
    d = d.withColumns({f"{c}{suffix}": F.when(F.col(out_state) == 1, F.lit(0.0)).otherwise(F.col(c))
                       for c in spend_cols})
    return d.withColumn(f"total{suffix}", row_sum([f"{c}{suffix}" for c in spend_cols]))


# D9 ---------------------------------------------------------------------------
def cluster_fill(df: DataFrame, cluster: str, numeric: Sequence[str] = (), categorical: Sequence[str] = (),
                 categorical_fallback: Mapping[str, object] | None = None, exact: bool = True) -> DataFrame:
    """Numeric: cluster median -> global median. Categorical: cluster mode -> fallback / global mode."""
    d = df
    if numeric:
        glob = fit_global_median(df, numeric, exact)
        for c in numeric:
            d = lookup_join(d, _median_table(df, cluster, c, f"__m_{c}", exact), cluster, "left")
        d = d.withColumns({c: F.coalesce(F.col(c), F.col(f"__m_{c}"), F.lit(glob[c])) for c in numeric})
        d = d.drop(*[f"__m_{c}" for c in numeric])
    for c in categorical:
        modes = group_mode(df, cluster, c, out="__mode")
        fb = (categorical_fallback or {}).get(c, "global")
        fb = fit_global_mode(df, c) if fb == "global" else fb
        d = lookup_join(d, modes, cluster, "left")
        d = d.withColumn(c, F.coalesce(F.col(c), F.col("__mode"), F.lit(fb))).drop("__mode")
    return d


# D10 --------------------------------------------------------------------------
def cluster_rate_gate(df: DataFrame, cluster: str, state: str, col: str, out: str | None = None,
                      rate: float = 0.7, exact: bool = True) -> DataFrame:
    """Missing -> 0 when the cluster's state rate exceeds ``rate``, else the cluster median (NULL -> 0)."""
    out = out or col
    st = df.groupBy(cluster).agg(F.avg(F.col(state).cast("double")).alias("__rate"))
    st = st.join(_median_table(df, cluster, col, "__med", exact), cluster, "left")
    d = lookup_join(df, st, cluster, "left")
    fill = F.when(F.col("__rate") > rate, F.lit(0.0)).otherwise(F.coalesce(F.col("__med"), F.lit(0.0)))
    return d.withColumn(out, F.coalesce(F.col(col), fill)).drop("__rate", "__med")


def _attach_per_clustering(df: DataFrame, clusterings: Sequence[str], name: str, agg_for=None,
                           table_for=None) -> tuple[DataFrame, list]:
    """Attach one statistic per clustering: ``agg_for()`` gives an aggregate column, or
    ``table_for(frame, key, out)`` gives a keyed table."""
    d, cols = df, []
    for i, cl in enumerate(clusterings):
        out = f"__{name}{i}"
        t = table_for(df, cl, out) if table_for is not None else df.groupBy(cl).agg(agg_for().alias(out))
        d = lookup_join(d, t, cl, "left")
        cols.append(F.col(out))
    return d, cols


# D11 --------------------------------------------------------------------------
def multiview_median_fill(df: DataFrame, col: str, clusterings: Sequence[str], out: str | None = None,
                          exact: bool = True) -> DataFrame:
    """Missing -> median of the per-clustering medians that exist, else the global median."""
    out = out or col
    d, meds = _attach_per_clustering(df, clusterings, "mv",
                                     table_for=lambda f, k, o: _median_table(f, k, col, o, exact))
    glob = fit_global_median(df, [col], exact)[col]
    vals = F.array_sort(F.filter(F.array(*meds), lambda x: x.isNotNull()))
    n = F.size(vals)
    med = F.when(n % 2 == 1, F.element_at(vals, F.floor((n + 1) / 2).cast("int"))).otherwise(
        (F.element_at(vals, F.floor(n / 2).cast("int")) + F.element_at(vals, F.floor(n / 2).cast("int") + 1)) / 2)
    fill = F.when(n > 0, med).otherwise(F.lit(glob))
    return d.withColumn(out, F.coalesce(F.col(col), fill)).drop(*[f"__mv{i}" for i in range(len(clusterings))])


# D12 --------------------------------------------------------------------------
def conditional_quantile_fill(df: DataFrame, col: str, cluster: str, state: str, vip: str,
                              q: float = 0.7, out: str | None = None, exact: bool = True) -> DataFrame:
    """state true -> 0; VIP -> cluster quantile q; else cluster median; floor at 0; none -> 0."""
    out = out or col
    if exact:
        t = group_quantiles(df, cluster, col, [q, 0.5], ["__q0", "__q1"])
    else:
        qq = F.percentile_approx(col, F.array(F.lit(q), F.lit(0.5)), 100_000)
        t = df.groupBy(cluster).agg(qq.alias("__q")).select(cluster, F.col("__q")[0].alias("__q0"),
                                                             F.col("__q")[1].alias("__q1"))
    d = lookup_join(df, t, cluster, "left")
    s, v = tolerant_bool(state, default=None), tolerant_bool(vip, default=None)
    val = F.when(v == 1, F.col("__q0")).otherwise(F.col("__q1"))
    fill = F.when(s == 1, F.lit(0.0)).otherwise(F.coalesce(F.greatest(F.lit(0.0), val), F.lit(0.0)))
    return d.withColumn(out, F.coalesce(F.col(col), fill)).drop("__q0", "__q1")


# D13 --------------------------------------------------------------------------
def vote_fill(df: DataFrame, col: str, clusterings: Sequence[str], out: str | None = None) -> DataFrame:
    """Missing boolean -> mean of the available per-cluster true-rates > 0.5; none -> False."""
    out = out or col
    d, rates = _attach_per_clustering(df, clusterings, "vr",
                                      agg_for=lambda: F.avg(tolerant_bool(col, None).cast("double")))
    present = sum(F.when(r.isNotNull(), 1).otherwise(0) for r in rates)
    total = sum(F.coalesce(r, F.lit(0.0)) for r in rates)
    fill = F.when(present > 0, (total / present) > 0.5).otherwise(F.lit(False))
    return d.withColumn(out, F.coalesce(F.col(col), fill)).drop(*[f"__vr{i}" for i in range(len(clusterings))])


# D14 --------------------------------------------------------------------------
def hierarchical_mode_fill(df: DataFrame, col: str, levels: Sequence[str], out: str | None = None) -> DataFrame:
    """Missing -> mode within the first level that has one, else the global mode."""
    out = out or col
    d, outs = df, []
    for i, lv in enumerate(levels):
        d = lookup_join(d, group_mode(df, lv, col, out=f"__hm{i}"), lv, "left")
        outs.append(F.col(f"__hm{i}"))
    glob = fit_global_mode(df, col)
    return d.withColumn(out, F.coalesce(F.col(col), *outs, F.lit(glob))).drop(*[f"__hm{i}" for i in range(len(levels))])


# D15 --------------------------------------------------------------------------
def typed_preprocess(fit_frame: DataFrame, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                     keep: Sequence[str] = ()) -> DataFrame:
    """Numeric: median fill + standard scale. Categorical: text ('nan' for missing), mode fill,
    one-hot over the fitted categories (unknown -> all zeros)."""
    from fitloom.operators.encode import category_key, fit_categories

    med = fit_global_median(fit_frame, numeric)
    filled_fit = fit_frame.withColumns({c: F.coalesce(F.col(c), F.lit(med[c])) for c in numeric})
    scale = fit_standard(filled_fit, numeric)
    out = df.withColumns({c: (F.coalesce(F.col(c), F.lit(med[c])) - F.lit(scale[c][0])) / F.lit(scale[c][1])
                          for c in numeric})
    cat_fit = fit_frame.withColumns({c: category_key(c, True) for c in categorical})
    out = out.withColumns({c: category_key(c, True) for c in categorical})
    cols = list(keep) + list(numeric)
    for c in categorical:
        cats = fit_categories(cat_fit, c)
        out = one_hot(out, c, cats, drop_first=False)
        cols += [f"{c}_{v}" for v in cats]
    return out.select(*cols)
