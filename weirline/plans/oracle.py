"""The SQL each query is checked against: shared table expressions and a composer."""

from __future__ import annotations

import re

_HYDRO = """
SELECT 'S' || CAST(l_suppkey AS varchar) AS section_id,
       CAST(date_trunc('month', l_shipdate) AS date) AS date,
       CAST(SUM(CAST(l_quantity AS decimal(18,2))) AS double) AS rainfall,
       CAST(25.5 AS double) * COUNT(*) AS evaporation,
       CAST(SUM(CAST(l_extendedprice AS decimal(18,2)) * (1 - CAST(l_discount AS decimal(4,2)))) AS double)
           / CAST(100 AS double) AS runoff_measured,
       CAST(SUM(CAST(l_extendedprice AS decimal(18,2))) AS double) / CAST(100 AS double) AS runoff_natural
FROM lineitem GROUP BY 1, 2
"""

_PAID = "CAST(l_extendedprice AS decimal(18,2)) * CAST(l_tax AS decimal(4,2))"


def _use(cond: str, name: str) -> str:
    return f"CAST(SUM(CASE WHEN {cond} THEN {_PAID} END) AS double) / CAST(100 AS double) AS {name}"


_WATER = f"""
SELECT 'S' || CAST(l_suppkey AS varchar) AS section_id,
       CAST(date_trunc('month', l_shipdate) AS date) AS date,
       {_use("l_returnflag = 'A'", "domestic")},
       {_use("l_returnflag = 'N'", "agricultural")},
       {_use("l_returnflag = 'R'", "industrial")},
       {_use("l_linestatus = 'O'", "ecological")}
FROM lineitem GROUP BY 1, 2
"""

_POS = "CASE WHEN {0} < 0 THEN 0.0 ELSE {0} END"
_SUM4 = " + ".join(f"COALESCE({c}, 0.0)" for c in ("domestic", "agricultural", "industrial", "ecological"))
_AG, _IND, _DOM = (_POS.format(c) for c in ("agricultural", "industrial", "domestic"))
_SUM3 = f"(({_AG}) + ({_IND}) + ({_DOM}))"
_DEN3 = f"(CASE WHEN {_SUM3} = 0 THEN 1e-9 ELSE {_SUM3} END)"
_NAT0 = f"({_POS.format('runoff_natural')})"

_ROWF = f"""
SELECT *, runoff_natural - runoff_measured AS target,
       ({_SUM4}) / (CASE WHEN {_NAT0} = 0 THEN 1e-9 ELSE {_NAT0} END) AS I_t,
       ({_AG}) / {_DEN3} AS ag_share, ({_IND}) / {_DEN3} AS ind_share, ({_DOM}) / {_DEN3} AS dom_share,
       sin(2 * pi() * (CAST(month(date) AS double) - 1) / 12.0) AS season_sin,
       cos(2 * pi() * (CAST(month(date) AS double) - 1) / 12.0) AS season_cos,
       COALESCE(CAST(rainfall - evaporation < 0 AS integer), 0) AS D_phase,
       {_SUM4} AS U_total
FROM joined
"""

_LAGRAW = """
SELECT *, ln(1 + lag(runoff_measured) OVER s) AS gate_logQ_t1_raw,
       (lag(runoff_measured) OVER s - lag(runoff_natural) OVER s)
           / (CASE WHEN lag(runoff_natural) OVER s < 1e-6 THEN 1e-6 ELSE lag(runoff_natural) OVER s END) AS gate_HAI1_t1_raw,
       lag(U_total) OVER s
           / (CASE WHEN lag(runoff_natural) OVER s < 1e-6 THEN 1e-6 ELSE lag(runoff_natural) OVER s END) AS gate_HAI3_t1_raw
FROM rowf WINDOW s AS (PARTITION BY section_id ORDER BY date)
"""

_NUMBERED = """
SELECT section_id, date, runoff_natural AS x, row_number() OVER (PARTITION BY section_id ORDER BY date) AS i
FROM hydro
"""

_MEMORY = """
SELECT section_id, date, i, x AS M_nat6, CAST(1 AS double) AS w FROM numbered WHERE i = 1
UNION ALL
SELECT n.section_id, n.date, n.i,
       CASE WHEN n.x IS NULL THEN m.M_nat6 WHEN m.M_nat6 IS NULL THEN n.x
            ELSE (m.M_nat6 * (m.w * 0.8::double) + 0.2::double * n.x) / (m.w * 0.8::double + 0.2::double) END,
       CASE WHEN n.x IS NOT NULL THEN CAST(1 AS double) WHEN m.M_nat6 IS NULL THEN m.w ELSE m.w * 0.8::double END
FROM memory m JOIN numbered n ON n.section_id = m.section_id AND n.i = m.i + 1
"""

_SPLIT = """
SELECT l.* EXCLUDE (runoff_measured, runoff_natural), runoff_measured AS measured_flow,
       runoff_natural AS natural_flow, first_test_year,
       CASE WHEN year(date) < first_test_year THEN 'train' ELSE 'test' END AS split,
       COUNT(*) FILTER (WHERE year(date) < first_test_year) OVER (PARTITION BY section_id) AS train_size,
       COUNT(*) FILTER (WHERE year(date) >= first_test_year) OVER (PARTITION BY section_id) AS test_size
FROM lagraw l JOIN rules USING (section_id)
QUALIFY train_size > 0 AND test_size > 0
"""

_META = """
SELECT section_id,
       COALESCE(quantile_cont(measured_flow, [i / 100.0 FOR i IN range(101)]),
                [CAST(0 AS double) FOR i IN range(101)]) AS q_grid,
       COALESCE(avg(gate_HAI1_t1_raw), 0) AS hai1_mu, COALESCE(avg(gate_HAI3_t1_raw), 0) AS hai3_mu,
       CASE WHEN count(gate_HAI1_t1_raw) = 0 THEN 1 WHEN stddev_samp(gate_HAI1_t1_raw) < 1e-8 THEN 1
            ELSE stddev_samp(gate_HAI1_t1_raw) END AS hai1_sd,
       CASE WHEN count(gate_HAI3_t1_raw) = 0 THEN 1 WHEN stddev_samp(gate_HAI3_t1_raw) < 1e-8 THEN 1
            ELSE stddev_samp(gate_HAI3_t1_raw) END AS hai3_sd
FROM split WHERE split = 'train' GROUP BY section_id
"""

# Fixed quantile shares, spelled out: both engines then interpolate at the same points.
_META = _META.replace(
    "[i / 100.0 FOR i IN range(101)]", "[" + ", ".join(repr(i / 100) for i in range(101)) + "]"
)


def _place(q: str) -> str:
    j = f"(len(list_filter(q_grid, lambda g: g <= {q})) - 1)"
    return (
        f"CASE WHEN {q} IS NULL THEN NULL WHEN {j} < 0 THEN 0.0 WHEN {j} >= 100 THEN 1.0 ELSE "
        f"({j} + ({q} - q_grid[{j} + 1]) / (q_grid[{j} + 2] - q_grid[{j} + 1])) / 100 END"
    )


_QLAGS = """
SELECT s.*, lag(measured_flow, 1) OVER o AS q1, lag(measured_flow, 2) OVER o AS q2
FROM split s WINDOW o AS (PARTITION BY section_id ORDER BY date)
"""

_GATED = f"""
SELECT g.*, gate_logQ_t1_raw AS gate_logQ_t1, gate_r_t1 - gate_r_t2 AS gate_dr_t1 FROM (
  SELECT q.*, {_place("q1")} AS gate_r_t1, {_place("q2")} AS gate_r_t2,
         tanh((gate_HAI1_t1_raw - hai1_mu) / (hai1_sd + 1e-6)) AS gate_HAI1_t1,
         tanh((gate_HAI3_t1_raw - hai3_mu) / (hai3_sd + 1e-6)) AS gate_HAI3_t1
  FROM qlags q JOIN meta USING (section_id)) g
"""


def blocks(source: str, k: int = 3) -> str:
    """Train rows of ``source`` with their validating fold, test rows with block k."""
    return f"""
SELECT * EXCLUDE (pos, n),
       CAST(CASE WHEN split = 'test' THEN {k} WHEN pos <= n - {k} * (n // {k + 1}) THEN -1
            ELSE (pos - 1 - (n - {k} * (n // {k + 1}))) // (n // {k + 1}) END AS integer) AS block
FROM (SELECT *, row_number() OVER (PARTITION BY section_id, split ORDER BY date) AS pos,
             count(*) OVER (PARTITION BY section_id, split) AS n FROM {source})
"""


_LAGVIEW = (
    "SELECT * FROM (SELECT section_id, date, split, measured_flow, natural_flow, rainfall, "
    + ", ".join(
        f"lag({c}, {k}) OVER o AS {c}_lag{k}" for c in ("measured_flow", "natural_flow") for k in range(1, 7)
    )
    + " FROM split WINDOW o AS (PARTITION BY section_id ORDER BY date))"
    " WHERE split = 'test' OR (measured_flow_lag6 IS NOT NULL AND natural_flow_lag6 IS NOT NULL)"
)

KNN_INPUTS = ("natural_flow", "rainfall", "evaporation")
KNN_LAG_INPUTS = tuple(f"{c}_lag{k}" for c in ("measured_flow", "natural_flow") for k in range(1, 7)) + ("rainfall", "natural_flow")


def _near(source: str, inputs, far: int) -> str:
    dist = " + ".join(f"(q.{c} - t.{c}) * (q.{c} - t.{c})" for c in inputs)
    return f"""
SELECT q.section_id, q.date, q.split, q.block, q.measured_flow AS y, t.measured_flow AS ty, t.date AS tdate, {dist} AS d,
       row_number() OVER (PARTITION BY q.section_id, q.date ORDER BY {dist}, t.date) AS r
FROM {source} q JOIN {source} t ON q.section_id = t.section_id AND t.split = 'train' AND t.block < q.block
WHERE q.block >= 0 QUALIFY r <= {far}
"""


def _line(source: str, x: str) -> str:
    return f"""
SELECT q.section_id, q.date, q.split, q.block, any_value(q.measured_flow) AS y,
       regr_slope(t.measured_flow, t.{x}) * any_value(q.{x}) + regr_intercept(t.measured_flow, t.{x}) AS pred
FROM {source} q JOIN {source} t ON q.section_id = t.section_id AND t.split = 'train' AND t.block < q.block
WHERE q.block >= 0 GROUP BY 1, 2, 3, 4
"""


_PREDS = """
SELECT section_id, date, split, 'PHYS' AS alg, block, measured_flow AS y, natural_flow AS pred FROM based WHERE block >= 0
UNION ALL
SELECT section_id, date, split, 'KNN', block, y, avg(ty) FROM near WHERE r <= 5 GROUP BY ALL
UNION ALL
SELECT section_id, date, split, 'KNN_LAG', block, y, avg(ty) FROM near_lag WHERE r <= 5 GROUP BY ALL
UNION ALL
SELECT section_id, date, split, 'MLR', block, y, pred FROM line
UNION ALL
SELECT section_id, date, split, 'MLR_LAG', block, y, pred FROM line_lag
UNION ALL
SELECT section_id, date, split, 'MLR_RAIN', block, y, pred FROM line_rain
"""


def suite(source: str, by: str, y: str = "y", p: str = "pred") -> str:
    """The six metrics per group of ``source``."""
    return f"""
SELECT {by},
  CASE WHEN sum((yy - mean) ** 2) > 0 THEN 1 - sum((yy - pp) ** 2) / sum((yy - mean) ** 2) END AS NSE,
  sqrt(avg((yy - pp) ** 2)) AS RMSE, avg(abs(yy - pp)) AS MAE,
  CASE WHEN sum((ly - lmean) ** 2) > 0 THEN 1 - sum((ly - lp) ** 2) / sum((ly - lmean) ** 2) END AS logNSE,
  CASE WHEN sum(yy) FILTER (WHERE hi <= greatest(1, ceil(0.02::double * n))) > 0 THEN
    100 * sum(pp - yy) FILTER (WHERE hi <= greatest(1, ceil(0.02::double * n)))
        / sum(yy) FILTER (WHERE hi <= greatest(1, ceil(0.02::double * n))) END AS FHV,
  CASE WHEN sum(yy) FILTER (WHERE lo <= greatest(1, ceil(0.30::double * n))) > 0 THEN
    100 * sum(pp - yy) FILTER (WHERE lo <= greatest(1, ceil(0.30::double * n)))
        / sum(yy) FILTER (WHERE lo <= greatest(1, ceil(0.30::double * n))) END AS FLV
FROM (SELECT *, avg(ly) OVER (PARTITION BY {by}) AS lmean FROM (
  SELECT *, ln(greatest(yy, 0) + eps) AS ly, ln(greatest(pp, 0) + eps) AS lp FROM (
    SELECT *, count(yy) OVER (PARTITION BY {by}) AS n, avg(yy) OVER (PARTITION BY {by}) AS mean,
      coalesce(greatest(0.01::double * median(CASE WHEN yy > 0 THEN yy END) OVER (PARTITION BY {by}), 0.1), 0.1) AS eps,
      row_number() OVER (PARTITION BY {by} ORDER BY yy DESC NULLS LAST, date) AS hi,
      row_number() OVER (PARTITION BY {by} ORDER BY yy ASC NULLS LAST, date) AS lo
    FROM (SELECT *, CASE WHEN {p} IS NOT NULL THEN {y} END AS yy, CASE WHEN {y} IS NOT NULL THEN {p} END AS pp
          FROM {source}))))
GROUP BY {by}
"""


_CTES: dict[str, str] = {
    "hydro": _HYDRO,
    "water": _WATER,
    "rules": """SELECT 'S' || CAST(s_suppkey AS varchar) AS section_id,
                  CASE WHEN s_nationkey < 12 THEN 2000 ELSE 2001 END AS first_test_year, s_suppkey AS rank
                FROM supplier WHERE s_acctbal >= 0""",
    "joined": "SELECT h.*, domestic, agricultural, industrial, ecological FROM hydro h LEFT JOIN water USING (section_id, date)",
    "rowf": _ROWF,
    "numbered": _NUMBERED,
    "memory": _MEMORY,
    "lagraw": _LAGRAW,
    "split": _SPLIT,
    "meta": _META,
    "qlags": _QLAGS,
    "gated": _GATED,
    "blocked": blocks("split"),
    # KNN and the fitted lines need complete inputs; natural flow, rain and evaporation always are.
    "based": "SELECT * FROM blocked",
    "lagview": _LAGVIEW,
    "lagblocked": blocks("lagview"),
    "near": _near("based", KNN_INPUTS, 7),
    "near_lag": _near("lagblocked", KNN_LAG_INPUTS, 7),
    "line": _line("based", "natural_flow"),
    "line_rain": _line("based", "rainfall"),
    "line_lag": _line("lagblocked", "measured_flow_lag1"),
    "preds": _PREDS,
}


def register(name: str, body: str) -> None:
    _CTES[name] = body


def _needs(text: str) -> set[str]:
    return {n for n in _CTES if re.search(rf"\b{n}\b", text)}


def compose(final: str) -> str:
    """``final`` with the table expressions it uses, directly or not, in front."""
    wanted, todo = set(), _needs(final)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo |= _needs(_CTES[name]) - {name}
    if not wanted:
        return final
    # A level of a tree is used by the next one more than once.
    parts = [f"{n} AS {'MATERIALIZED ' if n.startswith('tree_') else ''}({_CTES[n].strip()})" for n in _CTES if n in wanted]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final.strip()


def rounded(columns, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)
