"""Small generators of oracle SQL text for the unrolled row-wise expressions."""

from __future__ import annotations

SPEND = ["sp_economy", "sp_large", "sp_medium", "sp_promo", "sp_small"]


def chain(terms, op=" + "):
    return "(" + op.join(terms) + ")"


def row_sum(cols=SPEND):
    return chain([f"coalesce({c}, 0.0)" for c in cols])


def present(cols=SPEND):
    return chain([f"CAST({c} IS NOT NULL AS INTEGER)" for c in cols])


def row_mean(cols=SPEND):
    return f"(CASE WHEN {present(cols)} > 0 THEN {row_sum(cols)} / {present(cols)} END)"


def central(cols=SPEND, power=2):
    m = row_mean(cols)
    terms = []
    for c in cols:
        d = f"({c} - {m})"
        t = f"{d} * {d}" if power == 2 else f"{d} * {d} * {d}"
        terms.append(f"coalesce({t}, 0.0)")
    return chain(terms)


def row_var(cols=SPEND):
    return f"(CASE WHEN {present(cols)} > 1 THEN {central(cols, 2)} / ({present(cols)} - 1) END)"


def row_skew(cols=SPEND):
    n = f"CAST({present(cols)} AS DOUBLE)"
    m2 = f"({central(cols, 2)} / {n})"
    m3 = f"({central(cols, 3)} / {n})"
    return (f"(CASE WHEN {n} < 3 THEN NULL WHEN {m2} = 0 THEN 0.0 "
            f"ELSE {m3} / pow({m2}, 1.5) * (sqrt({n} * ({n} - 1)) / ({n} - 2)) END)")


def row_median(cols=SPEND):
    lst = f"list_sort(list_filter([{', '.join(cols)}], lambda x: x IS NOT NULL))"
    n = f"len({lst})"
    return (f"(CASE WHEN {n} = 0 THEN NULL WHEN {n} % 2 = 1 THEN {lst}[CAST(floor(({n} + 1) / 2) AS INTEGER)] "
            f"ELSE ({lst}[CAST(floor({n} / 2) AS INTEGER)] + {lst}[CAST(floor({n} / 2) AS INTEGER) + 1]) / 2 END)")


def positive_count(cols=SPEND):
    return chain([f"CAST(coalesce({c} > 0, false) AS INTEGER)" for c in cols])


def argmax_name(cols=SPEND, names=None):
    names = names or cols
    cs = [f"coalesce({c}, 0.0)" for c in cols]
    mx = f"greatest({', '.join(cs)})"
    whens = " ".join(f"WHEN {c} = {mx} THEN '{n}'" for c, n in zip(cs[:-1], names[:-1]))
    return f"(CASE {whens} ELSE '{names[-1]}' END)"


def entropy(cols=SPEND):
    t = row_sum(cols)
    terms = [f"coalesce((({c} + 1) / ({t} + 1)) * ln((({c} + 1) / ({t} + 1)) + 1e-10), 0.0)" for c in cols]
    return f"(-{chain(terms)})"


def cut_fixed(x, edges, labels=None, include_lowest=False):
    labels = labels if labels is not None else list(range(len(edges) - 1))
    whens = []
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        cond = f"{x} >= {lo!r}" if (include_lowest and i == 0) else f"{x} > {lo!r}"
        if hi != float("inf"):
            cond += f" AND {x} <= {hi!r}"
        lab = f"'{labels[i]}'" if isinstance(labels[i], str) else str(labels[i])
        whens.append(f"WHEN {cond} THEN {lab}")
    return f"(CASE {' '.join(whens)} END)"
