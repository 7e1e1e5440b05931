"""Row-wise (horizontal) aggregates over a column list (inventory C1-C11).

Expressions are unrolled over the listed columns (no arrays, no UDFs): each
row statistic is a fixed arithmetic expression evaluated inside codegen.
NULL handling follows pandas' row reductions: NULLs are skipped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _chain_sum(terms: Sequence[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def present_count(cols) -> Column:
    return _chain_sum([c.isNotNull().cast("int") for c in _cols(cols)])


# C1
def row_sum(cols) -> Column:
    """NULL-skipping row sum; all-NULL -> 0 (pandas ``sum(axis=1)``)."""
    return _chain_sum([F.coalesce(c, F.lit(0.0)) for c in _cols(cols)])


def row_mean(cols) -> Column:
    n = present_count(cols)
    return F.when(n > 0, row_sum(cols) / n)


# C2
def row_max(cols) -> Column:
    return F.greatest(*_cols(cols))


def row_min(cols) -> Column:
    return F.least(*_cols(cols))


def row_range(cols) -> Column:
    return row_max(cols) - row_min(cols)


def _central(cols, power: int, mean: Column | None = None) -> Column:
    mean = row_mean(cols) if mean is None else mean
    terms = []
    for c in _cols(cols):
        d = c - mean
        t = d * d if power == 2 else d * d * d
        terms.append(F.coalesce(t, F.lit(0.0)))
    return _chain_sum(terms)


# C3
def row_var(cols, mean: Column | None = None) -> Column:
    """Sample variance of the non-NULL values; fewer than two -> NULL.

    Pass ``mean`` (a column already holding ``row_mean``) to keep the generated
    expression linear in the number of columns."""
    n = present_count(cols)
    return F.when(n > 1, _central(cols, 2, mean) / (n - 1))


def row_std(cols, mean: Column | None = None) -> Column:
    return F.sqrt(row_var(cols, mean))


# C4
def row_skew(cols, mean: Column | None = None) -> Column:
    """Adjusted Fisher-Pearson skewness (pandas); constant row -> 0, fewer than three -> NULL."""
    n = present_count(cols).cast("double")
    m2 = _central(cols, 2, mean) / n
    m3 = _central(cols, 3, mean) / n
    g1 = m3 / F.pow(m2, F.lit(1.5))
    adj = F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, F.lit(None).cast("double")).when(m2 == 0, F.lit(0.0)).otherwise(g1 * adj)


# C5
def row_median(cols) -> Column:
    vals = F.array_sort(F.filter(F.array(*_cols(cols)), lambda x: x.isNotNull()))
    n = F.size(vals)
    lo = F.element_at(vals, F.floor((n + 1) / 2).cast("int"))
    hi = F.element_at(vals, F.floor(n / 2).cast("int") + 1)
    return F.when(n == 0, F.lit(None).cast("double")).when(n % 2 == 1, lo).otherwise((lo + hi) / 2)


# C6
def positive_count(cols) -> Column:
    return _chain_sum([F.coalesce(c > 0, F.lit(False)).cast("int") for c in _cols(cols)])


def any_positive(cols) -> Column:
    return (positive_count(cols) > 0).cast("int")


# C7
def argmax_name(cols, names: Sequence[str] | None = None, fill: float = 0.0) -> Column:
    """Name of the first column holding the row maximum (NULL counts as ``fill``)."""
    cs = [F.coalesce(c, F.lit(fill)) for c in _cols(cols)]
    names = list(names or cols)
    mx = F.greatest(*cs)
    expr = F.lit(names[-1])
    for c, n in reversed(list(zip(cs[:-1], names[:-1]))):
        expr = F.when(c == mx, F.lit(n)).otherwise(expr)
    return expr


# C8
def concentration(cols) -> Column:
    return F.coalesce(row_max(cols), F.lit(0.0)) / (row_sum(cols) + 1)


# C9
def spend_entropy(cols, eps: float = 1e-10) -> Column:
    """-sum(p * ln(p + eps)) with p = (x + 1) / (total + 1); NULL terms skipped."""
    total = row_sum(cols)
    terms = []
    for c in _cols(cols):
        p = (c + 1) / (total + 1)
        terms.append(F.coalesce(p * F.log(p + F.lit(eps)), F.lit(0.0)))
    return -_chain_sum(terms)


# C10
def per_head(total: Column, size: Column, k: float = 1.0) -> Column:
    return F.try_divide(total, size + F.lit(k))


# C11
def subset_share(cols_subset, cols_all) -> Column:
    return row_sum(cols_subset) / (row_sum(cols_all) + 1)


def any_used(cols) -> Column:
    out = None
    for c in _cols(cols):
        t = F.coalesce(c > 0, F.lit(False))
        out = t if out is None else (out | t)
    return out.cast("int")
