"""Projection, parsing, scalar functions and predicates (inventory B1-B25).

All helpers return Spark ``Column`` expressions or apply them with one
``select``/``withColumns`` so they stay inside whole-stage codegen; ANSI mode
is respected through ``try_cast``/``try_divide``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# B1 ---------------------------------------------------------------------------
def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop columns, ignoring names that are absent."""
    return df.drop(*[n for n in names])


def keep_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Keep the listed columns that exist, in the listed order."""
    present = set(df.columns)
    return df.select(*[n for n in names if n in present])


# B2 ---------------------------------------------------------------------------
def columns_by_type(df: DataFrame, kind: str = "numeric", pattern: str | None = None) -> list[str]:
    """Column names by kind: 'numeric' (booleans excluded, like pandas), 'categorical', 'boolean'."""
    import re

    out = []
    for f in df.schema.fields:
        t = f.dataType
        ok = {"numeric": isinstance(t, NUMERIC_TYPES),
              "categorical": isinstance(t, T.StringType),
              "boolean": isinstance(t, T.BooleanType)}[kind]
        if ok and (pattern is None or re.search(pattern, f.name)):
            out.append(f.name)
    return out


def select_by_type(df: DataFrame, kind: str = "numeric", pattern: str | None = None) -> DataFrame:
    return df.select(*columns_by_type(df, kind, pattern))


def assert_numeric(df: DataFrame) -> DataFrame:
    bad = [f.name for f in df.schema.fields if not isinstance(f.dataType, NUMERIC_TYPES)]
    if bad:
        raise TypeError(f"non-numeric model input columns: {bad}")
    return df


# B3 ---------------------------------------------------------------------------
def split_id(c, sep: str = "_") -> tuple[Column, Column]:
    """``group<sep>member`` -> (group string, member int); bad member -> NULL."""
    c = _c(c)
    return (F.split_part(c, F.lit(sep), F.lit(1)),
            F.split_part(c, F.lit(sep), F.lit(2)).try_cast("int"))


# Fixed values of the two splits below: the defaults ("Unknown", 0, "Unknown").
# B4 / B4b ---------------------------------------------------------------------
def split3(c, sep: str = "/", defaults=("Unknown", "0", "Unknown")) -> tuple[Column, Column, Column]:
    """Fill NULL with the joined defaults, then take the first three parts (missing part -> '')."""
    filled = F.coalesce(_c(c), F.lit(sep.join(defaults)))
    return tuple(F.split_part(filled, F.lit(sep), F.lit(i)) for i in (1, 2, 3))


def split3_guarded(c, sep: str = "/", min_len: int = 3,
                   defaults=("Unknown", 0.0, "Unknown")) -> tuple[Column, Column, Column]:
    """Exactly three parts or all defaults; an empty part or a bad number gets its own default."""
    c = _c(c)
    parts = F.split(c, F.lit(sep), -1)
    ok = c.isNotNull() & (F.length(c) >= min_len) & (F.size(parts) == 3)
    p1, p2, p3 = (F.element_at(parts, i) for i in (1, 2, 3))
    d1, d2, d3 = defaults
    first = F.when(ok & (p1 != ""), p1).otherwise(F.lit(d1))
    num = F.when(ok, F.coalesce(F.nullif(p2, F.lit("")).try_cast("double"), F.lit(float(d2)))).otherwise(F.lit(float(d2)))
    third = F.when(ok & (p3 != ""), p3).otherwise(F.lit(d3))
    return first, num, third


# B5 ---------------------------------------------------------------------------
def to_number(c, kind: str = "double") -> Column:
    """Numeric coercion; unparsable, NaN or infinite -> NULL (ANSI-safe)."""
    text = F.trim(_c(c).cast("string"))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast(kind))


# B6 ---------------------------------------------------------------------------
def regex_capture(c, pattern: str, group: int = 1, default: str = "Unknown") -> Column:
    """First capture group, ``default`` when there is no match or the input is NULL."""
    return F.coalesce(F.nullif(F.regexp_extract(_c(c), pattern, group), F.lit("")), F.lit(default))


# B7 ---------------------------------------------------------------------------
def first_token(c) -> Column:
    """First whitespace-separated token; NULL for NULL or blank input."""
    t = F.regexp_replace(_c(c), r"^\s+|\s+$", "")
    return F.when(t.isNull() | (t == ""), F.lit(None).cast("string")).otherwise(
        F.split_part(F.regexp_replace(t, r"\s+", " "), F.lit(" "), F.lit(1)))


# B8 ---------------------------------------------------------------------------
def enrich_by_dictionary(df: DataFrame, token_col: str, dictionary: DataFrame,
                         key: str = "token", raw: str = "raw_class",
                         collapse: Mapping[str, Iterable[str]] | None = None,
                         out: str = "klass", default: str = "Unknown") -> DataFrame:
    """Left-join a token dictionary (small, broadcast after a size check) and collapse raw classes."""
    from fitloom.functions.joins import lookup_join

    d = dictionary.select(F.col(key).alias("__tok"), F.col(raw).alias("__raw"))
    j = lookup_join(df, d, F.col(token_col) == F.col("__tok"), "left")
    expr = F.lit(default)
    for label, members in reversed(list((collapse or {}).items())):
        expr = F.when(F.col("__raw").isin(list(members)), F.lit(label)).otherwise(expr)
    return j.withColumn(out, expr).drop("__tok")


# B9 ---------------------------------------------------------------------------
def str_len(c) -> Column:
    return F.length(_c(c))


# B10 --------------------------------------------------------------------------
def combine(cols, sep: str = "_", fill: str | None = None) -> Column:
    """``a<sep>b``; NULL parts become ``fill`` first (NULL result when fill is None)."""
    parts = [_c(c) if fill is None else F.coalesce(_c(c), F.lit(fill)) for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = F.concat(out, F.lit(sep), p)
    return out


# B11 --------------------------------------------------------------------------
def canonical_member(c, allowed: Iterable[str], default: str) -> Column:
    """Case-folded membership: matching value in canonical spelling, else default."""
    low = F.lower(_c(c).cast("string"))
    expr = F.lit(default)
    for a in reversed(list(allowed)):
        expr = F.when(low == a.lower(), F.lit(a)).otherwise(expr)
    return expr


def canonical_contains(c, rules: Iterable[tuple[str, str]], default: str) -> Column:
    """First rule whose (lower-case) substring occurs wins, else default."""
    low = F.lower(_c(c).cast("string"))
    expr = F.lit(default)
    for needle, value in reversed(list(rules)):
        expr = F.when(F.coalesce(low.contains(needle.lower()), F.lit(False)), F.lit(value)).otherwise(expr)
    return expr


# B12 --------------------------------------------------------------------------
# The spellings read as true / false.
TRUE_WORDS = ["true", "1", "yes"]
FALSE_WORDS = ["false", "0", "no"]


def tolerant_bool(c, default: int | None = 0) -> Column:
    """bool or text -> 1/0; anything else -> default."""
    s = F.lower(F.trim(_c(c).cast("string")))
    return (F.when(s.isin(TRUE_WORDS), F.lit(1))
            .when(s.isin(FALSE_WORDS), F.lit(0))
            .otherwise(F.lit(default).cast("int")))


# B13 --------------------------------------------------------------------------
def matches_any(c, alternatives: Iterable[str]) -> Column:
    import re

    pat = "|".join(re.escape(a) for a in alternatives)
    return F.coalesce(_c(c).rlike(pat), F.lit(False)).cast("int")


# B14 / B25 --------------------------------------------------------------------
def flag(cond: Column) -> Column:
    """Predicate as 0/1 with NULL -> 0 (pandas comparisons with NaN are False)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def open_band(c, lo: float, hi: float) -> Column:
    return flag((_c(c) > lo) & (_c(c) < hi))


def closed_band(c, lo, hi) -> Column:
    return flag(_c(c).between(lo, hi))


# B15-B20 ----------------------------------------------------------------------
def log1p(c) -> Column:
    return F.log1p(_c(c))


def sqrt(c) -> Column:
    return F.sqrt(_c(c))


def square(c) -> Column:
    return _c(c) * _c(c)


def int_div(c, n: int) -> Column:
    """Floor division in decimals: whole numbers of any size stay exact."""
    d = _c(c).cast("decimal(38,6)")
    return ((d - F.pmod(d, F.lit(n).cast("decimal(38,6)"))) / F.lit(n)).cast("long")


def int_mod(c, n: int) -> Column:
    return F.pmod(_c(c), F.lit(n))


def decade(c) -> Column:
    return (F.floor(_c(c) / 10) * 10).cast("long")


def guarded_ratio(a, b, eps: float = 1.0) -> Column:
    """a / (b + eps); a zero denominator gives NULL instead of an ANSI error."""
    return F.try_divide(_c(a), _c(b) + F.lit(eps))


def product(a, b) -> Column:
    return _c(a).cast("double") * _c(b).cast("double")


# B21 --------------------------------------------------------------------------
def equal_flag(a, b) -> Column:
    return flag(_c(a) == _c(b))


# B22 --------------------------------------------------------------------------
def map_values(c, mapping: Mapping, default=None) -> Column:
    """Static dictionary as a literal map (no join); unseen -> default."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    m = F.create_map(*items)
    val = F.try_element_at(m, _c(c))
    return val if default is None else F.coalesce(val, F.lit(default))


# B23 / B24 --------------------------------------------------------------------
def missing_flag(c) -> Column:
    return _c(c).isNull().cast("int")


def missing_count(cols) -> Column:
    out = None
    for c in cols:
        t = _c(c).isNull().cast("int")
        out = t if out is None else out + t
    return out
