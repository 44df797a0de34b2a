"""Pieces of SQL shared by the counterparts of the registered queries."""

from __future__ import annotations

from collections.abc import Sequence

SUPPLIER_CELLS = """cells AS (
  SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS ticker,
         sum(l_extendedprice) / 1e5 AS value, sum(l_quantity) / 1e2 AS exog
  FROM lineitem GROUP BY 1, 2)"""


def nation_cells(unit: str = "week") -> str:
    return f"""cells AS (
  SELECT CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS date, n_name AS ticker,
         sum(l_extendedprice) / 1e5 AS value, sum(l_quantity) / 1e2 AS exog
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"""


DENSE = """cal AS (
  SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n_dates
  FROM (SELECT DISTINCT date FROM cells)),
grid AS (
  SELECT t.ticker, c.date, c.pos, c.n_dates, p.value, p.exog
  FROM cal c CROSS JOIN (SELECT DISTINCT ticker FROM cells) t
  LEFT JOIN cells p ON p.date = c.date AND p.ticker = t.ticker)"""

FILLED = """dense AS (
  SELECT ticker, date, pos, n_dates,
         last_value(value IGNORE NULLS) OVER w AS value, last_value(exog IGNORE NULLS) OVER w AS exog
  FROM grid WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

SUPPLIER_DENSE = f"{SUPPLIER_CELLS},\n{DENSE},\n{FILLED}"


def nation_dense(unit: str = "week") -> str:
    return f"{nation_cells(unit)},\n{DENSE},\n{FILLED}"


def rnd(expr: str, name: str, digits: int = 9) -> str:
    """Rounded output column; adding 0 turns a negative zero into zero."""
    return f"round({expr}, {digits}) + 0.0 AS {name}"


SPANS = {"nested": {"d": (1, 1), "w": (1, 5), "m": (1, 22)}, "disjoint": {"d": (1, 1), "w": (2, 5), "m": (6, 22)}}
SPANS["partial"] = SPANS["nested"]


def lag_mean(column: str, first: int, last: int, partial: bool = False) -> str:
    w = f"OVER (PARTITION BY ticker ORDER BY pos ROWS BETWEEN {last} PRECEDING AND {first} PRECEDING)"
    mean = f"avg({column}) {w}"
    return mean if partial else f"CASE WHEN count({column}) {w} = {last - first + 1} THEN {mean} END"


def features(har: str = "nested", exog: bool = False, source: str = "dense", out: str = "features") -> str:
    """CTE of complete feature rows."""
    cols = [f"{lag_mean('value', a, b, har == 'partial')} AS {n}" for n, (a, b) in SPANS[har].items()]
    names = list(SPANS[har])
    if exog:
        cols += [f"{lag_mean('exog', a, b, har == 'partial')} AS iv_{n}" for n, (a, b) in SPANS[har].items()]
        names += [f"iv_{n}" for n in SPANS[har]]
    known = " AND ".join(f"{n} IS NOT NULL" for n in ["target", *names])
    return f"""{out}_all AS (
  SELECT date, pos, n_dates, ticker, value AS target, {', '.join(cols)} FROM {source}),
{out} AS (SELECT * FROM {out}_all WHERE {known})"""


def ols(source: str, xs: Sequence[str], y: str, keep: Sequence[str], train: str, out: str,
        by: Sequence[str] = (), centre_by: Sequence[str] | None = None) -> str:
    """CTEs that end in `out`: the kept columns, the target and the least-squares forecast yhat.

    Columns are centred on their training means and removed one after the other from the rest
    (Frisch-Waugh-Lovell); what remains of the target is its residual.
    """
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    centre = list(by if centre_by is None else centre_by)
    cpart = f"PARTITION BY {', '.join(centre)}" if centre else ""
    ids = ", ".join(keep)
    cols = [*xs, "res"]
    steps = [f"""{out}_0 AS (
  SELECT {ids}, {y} AS target, ({train}) AS tr,
         {', '.join(f'{c} - avg({c}) FILTER ({train}) OVER ({cpart}) AS {c}' for c in xs)},
         {y} - avg({y}) FILTER ({train}) OVER ({cpart}) AS res
  FROM {source})"""]
    for k, x in enumerate(xs):
        rest = cols[k + 1:]
        slopes = ", ".join(
            f"{c} - coalesce(sum({c} * {x}) FILTER (tr) OVER ({part}) / nullif(sum({x} * {x}) FILTER (tr) OVER ({part}), 0), 0) * {x} AS {c}"
            for c in rest)
        steps.append(f"{out}_{k + 1} AS (SELECT {ids}, target, tr, {slopes} FROM {out}_{k})")
    steps.append(f"{out} AS (SELECT {ids}, tr, target, target - res AS yhat FROM {out}_{len(xs)})")
    return ",\n".join(steps)


def qlike(y: str = "target", f: str = "yhat", eps_true: float = 0, eps_pred: float = 0, mode: str = "floor") -> str:
    if mode == "add":
        y, f = f"({y} + {eps_true!r})", f"({f} + {eps_pred!r})"
    else:
        y = f"greatest({y}, {eps_true!r})" if eps_true else y
        f = f"greatest({f}, {eps_pred!r})" if eps_pred else f
    return f"({y}) / ({f}) - ln(({y}) / ({f})) - 1"


MSE = "avg((target - yhat) * (target - yhat))"
QLIKE = f"avg({qlike()})"

# Three forecasts per feature row, as in the engine's `lag_forecasts`.
LAG_FORECASTS = """pred AS (
  SELECT date, pos, n_dates, ticker, target, d, 'DAY' AS model, d AS yhat FROM features
  UNION ALL SELECT date, pos, n_dates, ticker, target, d, 'WEEK', w FROM features
  UNION ALL SELECT date, pos, n_dates, ticker, target, d, 'MONTH', m FROM features)"""


def uniform(*parts: str) -> str:
    """Keyed uniform from 32 bits of md5."""
    key = "concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
    return f"((('0x' || substr(md5({key}), 1, 8))::UBIGINT)::DOUBLE + 0.5) / 4294967296.0"


def normal(*parts: str) -> str:
    return (f"sqrt(-2 * ln({uniform(chr(39) + 'u' + chr(39), *parts)})) * "
            f"cos(2 * pi() * {uniform(chr(39) + 'v' + chr(39), *parts)})")


def ring(source: str = "features", reach: int = 2) -> str:
    """CTEs up to `ring(src, dst, w)`: normalised ring over the tickers of a table."""
    return f"""ranked AS (
  SELECT ticker, row_number() OVER (ORDER BY ticker) - 1 AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT ticker FROM {source})),
half AS (
  SELECT a.ticker AS src, b.ticker AS dst FROM ranked a, ranked b
  WHERE ((b.i - a.i + a.n) % a.n) BETWEEN 1 AND {reach}),
links AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM half UNION ALL SELECT dst, src FROM half) WHERE src <> dst),
deg AS (SELECT src, count(*) AS degree FROM links GROUP BY 1),
ring AS (
  SELECT l.src, l.dst, 1 / sqrt((a.degree + 1e-8) * (b.degree + 1e-8)) AS w
  FROM links l JOIN deg a ON a.src = l.src JOIN deg b ON b.src = l.dst)"""


def graph_features(cols: Sequence[str], edges: str = "ring", source: str = "features", out: str = "gfeat",
                   on: Sequence[str] = (), term: str = "g") -> str:
    """CTE with a node's own columns and the weighted sum over its neighbours as <term>_<column>."""
    keys = "".join(f", {k}" for k in on)
    fk = "".join(f", f.{k}" for k in on)
    match = "".join(f" AND f.{k} = e.{k}" for k in on)
    back = "".join(f" AND f.{k} = n.{k}" for k in on)
    sums = ", ".join(f"sum(e.w * f.{c}) AS {term}_{c}" for c in cols)
    own = ", ".join(f"coalesce(n.{term}_{c}, 0) AS {term}_{c}" for c in cols)
    return f"""{out}_n AS (
  SELECT f.date{fk}, e.dst AS ticker, {sums}
  FROM {source} f JOIN {edges} e ON e.src = f.ticker{match} GROUP BY ALL),
{out} AS (
  SELECT f.*, {own} FROM {source} f
  LEFT JOIN {out}_n n ON n.date = f.date AND n.ticker = f.ticker{back})"""
