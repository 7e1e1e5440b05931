"""The canonical frames written as SQL CTEs for the DuckDB oracle.

They mirror ``fitloom.sources.frames`` column for column; oracle queries are
``with_frames('basket', body)`` where body is ``SELECT ...`` or extra CTEs
followed by a ``SELECT``.
"""

from __future__ import annotations

_SPEND_TERMS = ",\n    ".join(
    f"round(sum(CASE WHEN p_type = '{t}' THEN l_extendedprice END), 2) AS sp_{t.lower()}"
    for t in ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL"])

TOTAL_SQL = ("(coalesce(sp_economy, 0.0) + coalesce(sp_large, 0.0) + coalesce(sp_medium, 0.0)"
             " + coalesce(sp_promo, 0.0) + coalesce(sp_small, 0.0))")

FRAMES = {
    "spend": f"""spend AS (
  SELECT l_orderkey,
    {_SPEND_TERMS}
  FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY l_orderkey)""",
    "basket": f"""basket AS (
  SELECT o.o_orderkey AS id, o.o_custkey AS grp, c.c_acctbal AS age, c.c_mktsegment AS planet,
    g.r_name AS dest, s.sp_economy, s.sp_large, s.sp_medium, s.sp_promo, s.sp_small,
    {TOTAL_SQL} = 0 AS state,
    CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE {TOTAL_SQL} = 0 END AS state_n,
    o.o_orderpriority = '1-URGENT' AS vip,
    CAST(o.o_orderstatus = 'F' AS INTEGER) AS label,
    CASE WHEN o.o_orderkey % 3 = 0 THEN 'test' ELSE 'train' END AS split,
    CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE c.c_acctbal END AS age_n,
    CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE c.c_mktsegment END AS planet_n
  FROM orders o
  LEFT JOIN spend s ON o.o_orderkey = s.l_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) g
    ON c.c_nationkey = g.n_nationkey)""",
    "line": """line AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         l_discount, l_returnflag, l_linestatus
  FROM lineitem)""",
    "preds": """preds AS (
  SELECT row_id, CAST(m AS INTEGER) AS member, prob, CAST(prob >= 0.5 AS INTEGER) AS vote
  FROM (SELECT o_orderkey AS row_id, m,
          CAST((o_orderkey * 7919 + m * m * 104729 + (o_orderkey % (m + 3)) * 211) % 1000 AS DOUBLE)
            / 1000.0 AS prob
        FROM orders CROSS JOIN range(5) t(m)))""",
}

DEPENDS = {"basket": ["spend"]}


def with_frames(frames: str, body: str) -> str:
    names: list[str] = []
    for f in frames.split():
        for d in DEPENDS.get(f, []):
            if d not in names:
                names.append(d)
        if f not in names:
            names.append(f)
    head = "WITH " + ",\n".join(FRAMES[n] for n in names)
    body = body.strip()
    if body.upper().startswith("SELECT"):
        return f"{head}\n{body}"
    return f"{head},\n{body}"
