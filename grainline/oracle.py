"""DuckDB SQL oracles for the registered queries.

Test-side only. Each chart's source is restated in DuckDB's dialect over the
whole table, and a serve request is restated the straightforward way: a
DISTINCT keyset plus one two-step (MAX per day and grain, SUM per bucket)
query per base metric, LEFT JOINed on ``IS NOT DISTINCT FROM``. This is
deliberately a different plan from the Spark operator (which groups metrics
by signature and skips the keyset), so agreement means something.
"""

from __future__ import annotations

import ast

from .functions.derived import effective_dims
from .spec import ChartSpec, DataRequest, DerivedDim

DUCK_CHARTS = {
    "activity": """
WITH du AS (
  SELECT CAST(ts AS DATE) AS event_date, event_type, user_id, SUM(value) AS value, COUNT(*) AS events
  FROM events GROUP BY 1, 2, 3
),
t AS (SELECT event_date, event_type, SUM(value) AS value, CAST(SUM(events) AS BIGINT) AS events FROM du GROUP BY 1, 2),
u AS (SELECT event_date, COUNT(DISTINCT user_id) AS dau FROM du GROUP BY 1)
SELECT t.event_date, t.event_type, t.value, t.events, u.dau FROM t JOIN u ON t.event_date = u.event_date""",
    "activity_types": """
WITH du AS (
  SELECT CAST(ts AS DATE) AS event_date, event_type, user_id, SUM(value) AS value, COUNT(*) AS events
  FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2, 3
),
t AS (SELECT event_date, event_type, SUM(value) AS value, CAST(SUM(events) AS BIGINT) AS events FROM du GROUP BY 1, 2),
u AS (SELECT event_date, COUNT(DISTINCT user_id) AS dau FROM du GROUP BY 1)
SELECT t.event_date, t.event_type, t.value, t.events, u.dau FROM t JOIN u ON t.event_date = u.event_date""",
    "sales": """
SELECT CAST(l_shipdate AS DATE) AS ship_date, l_returnflag, l_linestatus,
       SUM(l_quantity) AS quantity, SUM(l_extendedprice * (1 - l_discount)) AS revenue, COUNT(*) AS lines
FROM lineitem GROUP BY 1, 2, 3""",
    "orders_by_market": """
WITH o AS (
  SELECT CAST(o.o_orderdate AS DATE) AS order_date, r.r_name AS region, n.n_name AS country,
         c.c_mktsegment AS segment, o.o_orderpriority AS priority, o.o_custkey AS custkey, o.o_totalprice AS totalprice
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
),
g AS (SELECT order_date, region, country, segment, priority, COUNT(*) AS orders, SUM(totalprice) AS amount FROM o GROUP BY 1, 2, 3, 4, 5),
b AS (SELECT order_date, region, country, COUNT(DISTINCT custkey) AS buyers FROM o GROUP BY 1, 2, 3)
SELECT g.*, b.buyers FROM g JOIN b ON g.order_date = b.order_date AND g.region = b.region AND g.country = b.country""",
    "cohort": """
WITH act AS (SELECT DISTINCT CAST(ts AS DATE) AS event_date, user_id FROM events),
first_day AS (SELECT user_id, MIN(event_date) AS install_date FROM act GROUP BY 1),
j AS (
  SELECT a.event_date, f.install_date, CAST(a.event_date - f.install_date AS BIGINT) AS days_since_install
  FROM act a JOIN first_day f ON a.user_id = f.user_id
)
SELECT event_date, install_date, days_since_install,
       CAST(COUNT_IF(days_since_install = 0) AS BIGINT) AS installs,
       CAST(COUNT_IF(days_since_install > 0) AS BIGINT) AS retained_users
FROM j GROUP BY 1, 2, 3""",
}

INT_COLUMNS = {"events", "dau", "lines", "orders", "buyers", "installs", "retained_users"}

CACHE_COLUMNS = {
    "activity": ["event_date", "event_type", "value", "events", "dau"],
    "activity_types": ["event_date", "event_type", "value", "events", "dau"],
    "sales": ["ship_date", "l_returnflag", "l_linestatus", "quantity", "revenue", "lines"],
    "orders_by_market": ["order_date", "region", "country", "segment", "priority", "orders", "amount", "buyers"],
    "cohort": ["event_date", "install_date", "days_since_install", "installs", "retained_users"],
}


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    if hasattr(v, "isoformat"):
        return f"DATE '{v.isoformat()}'"
    return "'" + str(v).replace("'", "''") + "'"


def derived_case(d: DerivedDim) -> str:
    src = f"UPPER(TRIM({q(d.source_column)}))"
    whens = " ".join(
        f"WHEN {src} IN ({', '.join(lit(str(v).strip().upper()) for v in vals)}) THEN {lit(b)}"
        for b, vals in d.buckets
    )
    return f"CASE {whens} ELSE {lit(d.default)} END"


def cache_sql(spec: ChartSpec) -> str:
    """The chart cache in DuckDB: source rows plus derived dims and ``_day``."""
    cols = CACHE_COLUMNS[spec.name]
    extra = [f"{derived_case(d)} AS {q(d.name)}" for d in spec.derived
             if d.source_column in cols and d.name not in {x.name for x in spec.dims}]
    sel = ", ".join(["*"] + extra + [f"CAST({q(spec.time_column)} AS DATE) AS _day"])
    return f"SELECT {sel} FROM ({DUCK_CHARTS[spec.name]}) _src"


def _bucket(gran: str) -> str:
    return "_day" if gran == "day" else f"CAST(date_trunc('{gran}', _day) AS DATE)"


def _where(spec: ChartSpec, req: DataRequest, dim_col: dict, exclude=frozenset()) -> str:
    parts = []
    if req.from_date:
        parts.append(f"_day >= {lit(req.from_date)}")
    if req.to_date:
        parts.append(f"_day <= {lit(req.to_date)}")
    for d, vals in req.filters.items():
        if vals and d not in exclude:
            parts.append(f"{q(dim_col[d])} IN ({', '.join(lit(v) for v in vals)})")
    return " AND ".join(parts) if parts else "TRUE"


def _formula_sql(text: str) -> str:
    def ev(n):
        if isinstance(n, ast.Expression):
            return ev(n.body)
        if isinstance(n, ast.Constant):
            return f"CAST({n.value!r} AS DOUBLE)"
        if isinstance(n, ast.Name):
            return f"CAST({q('m_' + n.id)} AS DOUBLE)"
        if isinstance(n, ast.UnaryOp):
            return f"(-{ev(n.operand)})" if isinstance(n.op, ast.USub) else ev(n.operand)
        a, b = ev(n.left), ev(n.right)
        if isinstance(n.op, ast.Add):
            return f"({a} + {b})"
        if isinstance(n.op, ast.Sub):
            return f"({a} - {b})"
        if isinstance(n.op, ast.Mult):
            return f"({a} * {b})"
        if isinstance(n.op, ast.Div):
            return f"({a} / NULLIF({b}, 0))"
        raise ValueError("oracle formula supports + - * / only")

    return ev(ast.parse(text, mode="eval"))


def serve_sql(spec: ChartSpec, req: DataRequest) -> str:
    """The reference algorithm restated for DuckDB."""
    dims = effective_dims(spec, CACHE_COLUMNS[spec.name])
    dim_col = {d.name: d.col for d in dims}
    req_dims = list(dim_col) if req.dimensions is None else list(req.dimensions)
    x_axis = req.x_axis if req.x_axis not in (None, "", spec.time_column) else None
    if x_axis:
        req_dims = [x_axis] + [d for d in req_dims if d != x_axis]
    metrics = [m.name for m in spec.metrics] if req.metrics is None else list(req.metrics)
    base_needed = []
    for m in metrics:
        mm = spec.metric(m)
        if mm.is_formula:
            names = {n.id for n in ast.walk(ast.parse(mm.formula, mode="eval")) if isinstance(n, ast.Name)}
            base_needed += [b.name for b in spec.base_metrics if b.name in names]
        else:
            base_needed.append(m)
    base_needed = list(dict.fromkeys(base_needed))
    tb = "NULL" if x_axis else _bucket(req.granularity)
    key_cols = [q(dim_col[d]) for d in req_dims]
    ctes = [f"base AS ({cache_sql(spec)})"]
    ks = ", ".join([f"{tb} AS _t"] + key_cols)
    ctes.append(f"keys AS (SELECT DISTINCT {ks} FROM base WHERE {_where(spec, req, dim_col)})")
    joins = []
    for i, name in enumerate(base_needed):
        m = spec.metric(name)
        indep = set(m.independent_of)
        grain = [q(d.col) for d in dims if d.name not in indep]
        eff = [d for d in req_dims if d not in indep]
        eff_cols = [q(dim_col[d]) for d in eff]
        inner = (
            f"SELECT {', '.join(['_day'] + grain)}, MAX({q(m.column)}) AS _g FROM base "
            f"WHERE {_where(spec, req, dim_col, exclude=indep)} GROUP BY {', '.join(['_day'] + grain)}"
        )
        total = "CAST(SUM(_g) AS BIGINT)" if m.column in INT_COLUMNS else "SUM(_g)"
        outer_keys = ([] if x_axis else [f"{_bucket(req.granularity)} AS _t"]) + eff_cols
        group = ([] if x_axis else [_bucket(req.granularity)]) + eff_cols
        sel = ", ".join(outer_keys + [f"{total} AS v"])
        gb = f" GROUP BY {', '.join(group)}" if group else ""
        ctes.append(f"m{i} AS (SELECT {sel} FROM ({inner}) _i{gb})")
        on = ([] if x_axis else ["k._t IS NOT DISTINCT FROM m{i}._t".format(i=i)]) + [
            f"k.{c} IS NOT DISTINCT FROM m{i}.{c}" for c in eff_cols
        ]
        joins.append(f"LEFT JOIN m{i} ON {' AND '.join(on) if on else 'TRUE'}")
    inner_sel = ["k.*"] + [f"m{i}.v AS {q('m_' + n)}" for i, n in enumerate(base_needed)]
    body = f"SELECT {', '.join(inner_sel)} FROM keys k {' '.join(joins)}"
    out = ([] if x_axis else [f"_t AS {q(spec.time_column)}"]) + key_cols
    for m in metrics:
        mm = spec.metric(m)
        out.append(f"{_formula_sql(mm.formula)} AS {q(m)}" if mm.is_formula else f"{q('m_' + m)} AS {q(m)}")
    sql = f"WITH {', '.join(ctes)}, joined AS ({body}) SELECT {', '.join(out)} FROM joined"
    if req.hide_zero and metrics:
        keep = " OR ".join(f"COALESCE({q(m)}, 0) <> 0" for m in metrics)
        sql = f"SELECT * FROM ({sql}) _h WHERE {keep}"
    return sql


def natural_sql(v: str) -> str:
    """DuckDB form of the natural sort key (digits numeric, text lower-case)."""
    return (
        f"list_transform(regexp_extract_all(CAST({v} AS VARCHAR), '(\\d+|\\D+)'), lambda x: "
        "CASE WHEN regexp_full_match(x, '\\d+') THEN {'k': 0, 'n': CAST(x AS DECIMAL(38,0)), 't': ''} "
        "ELSE {'k': 1, 'n': CAST(0 AS DECIMAL(38,0)), 't': lower(x)} END)"
    )


def dim_values_sql(spec: ChartSpec, dims=None, order_metric: str | None = None) -> str:
    """Per dimension: distinct non-NULL values with their 1-based position."""
    parts = []
    for d in effective_dims(spec, CACHE_COLUMNS[spec.name]):
        if dims is not None and d.name not in dims:
            continue
        c = q(d.col)
        if d.value_order == "metric" and order_metric:
            inner = (f"SELECT {c} AS v, SUM(TRY_CAST({q(order_metric)} AS DOUBLE)) AS tot FROM base GROUP BY 1")
            order = "tot DESC NULLS LAST, v"
        else:
            inner = f"SELECT DISTINCT {c} AS v FROM base"
            order = f"{natural_sql('v')}, v"
        parts.append(
            f"SELECT {lit(d.name)} AS dimension, CAST(v AS VARCHAR) AS value, "
            f"CAST(ROW_NUMBER() OVER (ORDER BY {order}) AS INTEGER) AS position FROM ({inner}) i WHERE v IS NOT NULL"
        )
    return f"WITH base AS ({cache_sql(spec)}) " + " UNION ALL ".join(parts)
