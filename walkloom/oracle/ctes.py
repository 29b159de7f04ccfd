"""Shared SQL building blocks of the reference results (DuckDB dialect).

``query(main, *names)`` puts the named blocks and what they need in front of a SELECT.
"""

from __future__ import annotations

import re

_BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, deps: tuple[str, ...], body: str) -> None:
    _BLOCKS[name] = (deps, body.strip())


#: What the panel leaves out in queries about gaps.
GAPS = {"{market_gap}": "AND l.l_shipdate >= timestamp '1996-06-01'", "{oil_gap}": "AND day(l_shipdate) NOT IN (7, 14, 21, 28)",
        "{rate_gap}": "WHERE o_orderdate >= timestamp '1996-01-01'"}


#: Blocks that refer to themselves.
RECURSIVE = {"wfr"}


def query(main: str, *names: str, gaps: bool = False) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _BLOCKS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return main.strip()
    ctes = ",\n".join(f"{n} AS {'' if n in RECURSIVE else 'MATERIALIZED '}({_BLOCKS[n][1]})" for n in order)
    for mark, condition in GAPS.items():
        ctes = ctes.replace(mark, condition if gaps else "")
    return f"WITH {'RECURSIVE ' if RECURSIVE & set(order) else ''}{ctes}\n{main.strip()}"


def r(*cols: str) -> str:
    """Rounded report columns; 'a=expr' renames."""
    out = []
    for c in cols:
        name, expr = c.split("=", 1) if "=" in c else (c, c)
        out.append(f"round(({expr})::double,6)+0.0 AS {name.strip()}")
    return ", ".join(out)


def px(x: str, scale: int) -> str:
    return (f"cast(cast(sum(cast(round({x}*100) as bigint)) as bigint) as double)"
            f"/count(*)/{scale}")


W = "PARTITION BY series_id ORDER BY date"


def rows(n: int, w: str = W) -> str:
    return f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def prior(n: int, w: str = W) -> str:
    return f"({w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def upto(lag: int = 0, w: str = W) -> str:
    end = "CURRENT ROW" if lag == 0 else f"{lag} PRECEDING"
    return f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND {end})"


def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {rows(n)} = {n} THEN {agg} OVER {rows(n)} END"


def carry(x: str) -> str:
    return f"last_value({x} IGNORE NULLS) OVER {upto()}"


block("official", (), f"""
SELECT o.o_orderpriority AS series_id, cast(o.o_orderdate AS date) AS date,
  {px('o.o_totalprice', 100000)} AS price, max(a.cross_price) AS cross_price
FROM orders o JOIN (SELECT cast(o_orderdate AS date) AS d,
    {px('o_totalprice', 100000)} AS cross_price FROM orders GROUP BY 1) a
  ON cast(o.o_orderdate AS date) = a.d
GROUP BY 1, 2""")
block("market", (), f"""
SELECT o.o_orderpriority AS series_id, cast(l.l_shipdate AS date) AS date,
  {px('l.l_extendedprice', 100000)} AS close,
  max(l.l_extendedprice)/1000 AS high, min(l.l_extendedprice)/1000 AS low
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
WHERE l.l_returnflag <> 'N' {{market_gap}} GROUP BY 1, 2""")
block("oil", (), f"""
SELECT cast(l_shipdate AS date) AS date, {px('l_extendedprice', 100000)} AS value
FROM lineitem WHERE l_returnflag = 'N' {{oil_gap}} GROUP BY 1""")
block("key_rate", (), f"""
SELECT min(cast(o_orderdate AS date)) AS date, {px('o_totalprice', 1000000)} AS value
FROM orders {{rate_gap}}
GROUP BY extract(year FROM o_orderdate), extract(quarter FROM o_orderdate)""")
block("news", (), """
SELECT cast(date '1995-01-01' + cast((doc_id*7)%2400 AS int) AS date) AS date, text,
  substring(text,1,200) AS title, source FROM documents""")
block("bars", (), """
SELECT event_type AS series_id, date_trunc('minute', ts) AS minute, max(value) AS high,
  min(value) AS low, count(*) AS n, max_by(value, event_id) AS close FROM events GROUP BY 1, 2""")
block("scored", ("news",), """
SELECT date, title, source, CASE WHEN len(words) = 0 THEN 0.0 ELSE
  (len(list_filter(words, lambda w: w IN ('the','of','and')))
   - len(list_filter(words, lambda w: w IN ('to','a','in'))))::double / len(words) END AS sentiment
FROM (SELECT *, regexp_extract_all(lower(text), '[a-z]+') AS words FROM news)""")
block("sent", ("scored",), """
SELECT date, avg(sentiment) AS sentiment, count(*) AS n_articles FROM scored GROUP BY 1""")

block("al", ("official", "market", "oil", "sent", "key_rate"), f"""
SELECT o.*, row_number() OVER ({W.replace('series_id', 'o.series_id').replace('ORDER BY date', 'ORDER BY o.date')}) - 1 AS t,
  m.close, m.high, m.low, i.value AS oil, s.sentiment AS sentiment_raw, k.value AS rate_raw
FROM official o LEFT JOIN market m ON m.series_id = o.series_id AND m.date = o.date
ASOF LEFT JOIN oil i ON o.date >= i.date
ASOF LEFT JOIN sent s ON o.date >= s.date
LEFT JOIN key_rate k ON k.date = o.date""")
block("lev", ("al",), f"""
SELECT *, ln(price) AS lp, CASE WHEN avg((cross_price IS NOT NULL)::int)
    OVER (PARTITION BY series_id) > 0.9 THEN ln({carry('cross_price')}) END AS lu,
  ln(oil) AS lo, {carry('rate_raw')} AS key_rate, coalesce(sentiment_raw, 0.0) AS sentiment,
  (sentiment_raw IS NOT NULL)::int::double AS sentiment_coverage FROM al""")
block("ret", ("lev",), f"""
SELECT *, lp - lag(lp) OVER ({W}) AS r, lu - lag(lu) OVER ({W}) AS ru,
  (lp - lu) - (lag(lp) OVER ({W}) - lag(lu) OVER ({W})) AS ri,
  lo - lag(lo) OVER ({W}) AS ro FROM lev""")

FEATURE_SQL = {
    "ret1": "r", "mom5": full("sum(r)", "r", 5), "mom20": full("sum(r)", "r", 20),
    "vol5": full("stddev_samp(r)", "r", 5), "vol20": full("stddev_samp(r)", "r", 20),
    "pos60": f"CASE WHEN count(lp) OVER {rows(60)} = 60 THEN (lp - min(lp) OVER {rows(60)}) / "
             f"(max(lp) OVER {rows(60)} - min(lp) OVER {rows(60)} + 1e-12) END",
    "level_z60": f"(lp - {full('avg(lp)', 'lp', 60)}) / nullif({full('stddev_samp(lp)', 'lp', 60)}, 0)",
    "dow": "(isodow(date) - 1) / 6.0::double",
    "ma20_dev": f"lp - {full('avg(lp)', 'lp', 20)}",
    "ma60_dev": f"lp - {full('avg(lp)', 'lp', 60)}",
    "slope20": f"-({full('regr_slope(lp, t)', 'lp', 20)})",
    "cross_ret1": "ru", "cross_ret5": full("sum(ru)", "ru", 5),
    "cross_ret20": full("sum(ru)", "ru", 20), "cross_vol20": full("stddev_samp(ru)", "ru", 20),
    "implied_mom5": full("sum(ri)", "ri", 5), "implied_mom20": full("sum(ri)", "ri", 20),
    "cross_corr60": full("corr(r, ru)", "ru", 60),
    "cross_beta60": f"{full('covar_samp(r, ru)', 'ru', 60)} / ({full('var_samp(ru)', 'ru', 60)} + 1e-12)",
    "oil_ret1": "ro", "oil_ret5": full("sum(ro)", "ro", 5), "oil_ret20": full("sum(ro)", "ro", 20),
    "oil_vol20": full("stddev_samp(ro)", "ro", 20),
    "oil_vol_ratio": f"{full('stddev_samp(ro)', 'ro', 5)} / ({full('stddev_samp(ro)', 'ro', 60)} + 1e-12)",
    "oil_corr60": full("corr(r, ro)", "ro", 60),
    "sentiment_7d": f"avg(sentiment) OVER {rows(7)}",
    "sentiment_30d": f"avg(sentiment) OVER {rows(30)}",
    "sentiment_trend": f"avg(sentiment) OVER {rows(7)} - avg(sentiment) OVER {rows(30)}",
    "rate_change": f"coalesce(key_rate - lag(key_rate) OVER ({W}), 0.0)",
    "rate_change_60d": f"coalesce(key_rate - lag(key_rate, 60) OVER ({W}), 0.0)",
}
# the moment formula of the bias-corrected skew
SKEW = (f"CASE WHEN count(r) OVER {rows(20)} = 20 THEN skew_src END")

_feature_cols = ",\n  ".join(f"{e} AS {n}" for n, e in FEATURE_SQL.items())
block("feat", ("ret",), f"SELECT *,\n  {_feature_cols} FROM ret")
_needed = [n for n in FEATURE_SQL] + ["key_rate"]
_valid = " AND ".join(f"{n} IS NOT NULL" for n in _needed)
# skew20 needs 20 returns with spread, rsi14 needs 14 returns and one loss so far
block("ft", ("feat",), f"""
SELECT *, greatest(300, coalesce(min(CASE WHEN is_valid THEN t END)
  OVER (PARTITION BY series_id), 0)) AS first_row
FROM (SELECT *, ({_valid} AND count(r) OVER {upto()} >= 20 AND min(r) OVER {upto()} < 0) AS is_valid
  FROM feat)""")
_wv = "PARTITION BY series_id, is_valid ORDER BY date"
_z = " + ".join(f"(({c} - avg({c}) OVER {rows(500, _wv)}) / (stddev_pop({c}) OVER {rows(500, _wv)} + 1e-9))"
                for c in ("ma60_dev", "ma20_dev", "mom20", "pos60", "implied_mom20"))
block("comp", ("ft",), f"""
SELECT *, CASE WHEN is_valid THEN CASE WHEN row_number() OVER ({_wv}) >= 200
  THEN -(({_z}) / 5) ELSE 0.0 END END AS score FROM ft""")

_wm = "PARTITION BY series_id ORDER BY date"
block("mk", ("al",), f"""
SELECT *, dev - lag(dev, 5) OVER ({_wm}) AS dev_change, lag(z_own) OVER ({_wm}) AS z_prev,
  CASE WHEN count(hlr) OVER {upto(0, _wm)} >= 30 THEN quantile_cont(hlr, 0.5) OVER {upto(0, _wm)} END AS hlr_median
FROM (SELECT *, CASE WHEN mrow >= 60 THEN (dev - avg(dev) OVER {rows(150, _wm)})
        / (stddev_pop(dev) OVER {rows(150, _wm)} + 1e-9) END AS z_own
  FROM (SELECT series_id, date, t, close, price, ln(close) - ln(price) AS dev,
      CASE WHEN close <> 0 AND high <> 0 AND low <> 0 THEN (high - low) / close END AS hlr,
      row_number() OVER ({_wm}) AS mrow
    FROM al WHERE close > 0))""")
block("pos", ("al", "mk"), """
SELECT a.series_id, a.date, a.t, m.t AS src_t, m.mrow, m.z_own, m.dev, m.dev_change, m.z_prev,
  m.hlr, m.hlr_median, CASE WHEN m.mrow >= 60 THEN m.z_own END AS z
FROM (SELECT series_id, date, t FROM al) a ASOF LEFT JOIN mk m
  ON m.series_id = a.series_id AND a.t >= m.t
QUALIFY true""".replace("\nQUALIFY true", ""))
block("near", ("pos",), """
SELECT series_id, date, t,
  CASE WHEN t - src_t <= 3 THEN src_t END AS src_t, CASE WHEN t - src_t <= 3 THEN mrow END AS mrow,
  CASE WHEN t - src_t <= 3 THEN z_own END AS z_own, CASE WHEN t - src_t <= 3 THEN dev END AS dev,
  CASE WHEN t - src_t <= 3 THEN dev_change END AS dev_change,
  CASE WHEN t - src_t <= 3 THEN z_prev END AS z_prev, CASE WHEN t - src_t <= 3 THEN hlr END AS hlr,
  CASE WHEN t - src_t <= 3 THEN hlr_median END AS hlr_median,
  CASE WHEN t - src_t <= 3 THEN z END AS z FROM pos""")
block("din", ("comp", "near"), """
SELECT c.series_id, c.date, c.t, c.price, c.close, c.is_valid, c.first_row, c.score,
  abs(c.score) AS strength, c.cross_ret20, c.oil_ret20, c.sentiment_7d, n.z, n.mrow, n.dev_change,
  n.z_prev, n.hlr, n.hlr_median
FROM comp c JOIN near n ON n.series_id = c.series_id AND n.t = c.t""")


def z7(z: str) -> str:
    return (f"CASE WHEN abs({z}) > 1.5 THEN 'z15' WHEN abs({z}) > 1.0 THEN 'z10' "
            f"WHEN abs({z}) > 0.5 THEN 'z05' WHEN {z} IS NOT NULL THEN 'z00' END")


def z30(z: str) -> str:
    return (f"CASE WHEN abs({z}) >= 1.0 THEN 'z10' WHEN abs({z}) >= 0.5 THEN 'z05' "
            f"WHEN abs({z}) >= 0.3 THEN 'z03' WHEN {z} IS NOT NULL THEN 'z00' END")


def rev_bucket(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN -1 WHEN {x} < -2.0 THEN 0 WHEN {x} < -1.0 THEN 1 "
            f"WHEN {x} < -0.5 THEN 2 WHEN {x} < 0.5 THEN 3 WHEN {x} < 1.0 THEN 4 ELSE 5 END")


def conf7(az: str, k: dict[str, str]) -> str:
    seg = lambda x0, x1, a, b: f"({k[a]}) + (({k[b]}) - ({k[a]})) * ({az} - {x0}) / ({x1} - {x0})"
    return (f"round(CASE WHEN {az} IS NULL THEN NULL ELSE greatest(0.5, least(0.85, CASE "
            f"WHEN {az} <= 0 THEN {k['z00']} WHEN {az} < 0.5 THEN {seg('0.0', '0.5', 'z00', 'z05')} "
            f"WHEN {az} < 1.0 THEN {seg('0.5', '1.0', 'z05', 'z10')} "
            f"WHEN {az} < 1.5 THEN {seg('1.0', '1.5', 'z10', 'z15')} ELSE {k['z15']} END)) END, 3)")


_w60 = rows(60)
block("ls", ("al",), f"""
SELECT *, (mom > 0) = (z60 > 0) AND k >= 5 AS c1, sign(dmd) = sign(z60) AND k >= 5 AS c2,
  (oil20 > 0) <> (z60 > 0) AS c4,
  CASE WHEN z60 IS NULL THEN 0 ELSE coalesce((k >= 5 AND (mom > 0) = (z60 > 0))::int, 0)
    + coalesce((k >= 5 AND sign(dmd) = sign(z60))::int, 0)
    + coalesce(((oil20 > 0) <> (z60 > 0))::int, 0) END AS gate,
  CASE WHEN range_pos < 0.4 THEN 1 WHEN range_pos > 1 - 0.4 THEN 0 END AS extreme,
  {rev_bucket('rev')} AS bucket
FROM (SELECT *, count(z60) OVER {upto()} - 1 AS k, md - lag(md, 5) OVER ({W}) AS dmd,
    ln(close_carried) - ln(lag(close_carried, 5) OVER ({W})) AS mom
  FROM (SELECT *, CASE WHEN count(md) OVER {_w60} = 60 THEN (md - avg(md) OVER {_w60})
      / sqrt(greatest(var_pop(md) OVER {_w60}, 1e-12)) END AS z60
    FROM (SELECT *, ln(close_carried) - lp AS md FROM (SELECT *, ln(price) AS lp,
        {carry('close')} AS close_carried,
        CASE WHEN count(oil) OVER {rows(21)} = 21 THEN ln(oil) - ln(lag(oil, 20) OVER ({W})) END AS oil20,
        CASE WHEN t >= 119 THEN -(ln(price) - avg(ln(price)) OVER {rows(120)})
          / sqrt(greatest(var_pop(ln(price)) OVER {_w60}, 1e-12)) END AS rev,
        CASE WHEN t >= 60 THEN CASE WHEN price > max(price) OVER {prior(60)} THEN 1
          WHEN price < min(price) OVER {prior(60)} THEN 0 END END AS breakout,
        CASE WHEN t >= 251 AND max(price) OVER {rows(252)} > min(price) OVER {rows(252)}
          THEN (price - min(price) OVER {rows(252)})
            / (max(price) OVER {rows(252)} - min(price) OVER {rows(252)}) END AS range_pos
      FROM al))))""")
block("hv", ("ret",), f"""
SELECT series_id, date, t, r, vol20p, coalesce(t >= 252 AND count(vol20p) OVER {prior(252)} > 100
    AND vol20p > quantile_cont(vol20p, 0.5) OVER {prior(252)}, false) AS high_vol
FROM (SELECT *, CASE WHEN count(r) OVER {rows(20)} = 20 AND t >= 20
  THEN sqrt(greatest(var_pop(r) OVER {rows(20)}, 1e-12)) END AS vol20p FROM ret)""")


def actual(n: int, price: str = "price") -> str:
    later = f"lead({price}, {n}) OVER ({W})"
    return f"CASE WHEN {later} > {price} THEN 1 WHEN {later} IS NOT NULL THEN 0 END"


def long_rows(policy: dict[int, str]) -> str:
    """Long-horizon decisions for expression-only policies."""
    parts = []
    preds = {
        "pure_rev": "CASE WHEN rev > 0 THEN 1 ELSE 0 END",
        "moex_z": "CASE WHEN z60 IS NOT NULL THEN CASE WHEN gate >= 2 THEN "
                  "CASE WHEN z60 > 0 THEN 1 ELSE 0 END END ELSE CASE WHEN rev > 0 THEN 1 ELSE 0 END END",
        "breakout": "breakout", "extreme_dist": "extreme", "off": "NULL::int"}
    for n, p in policy.items():
        parts.append(f"SELECT series_id, date, t, rev, z60, gate, bucket, {n} AS horizon, '{p}' AS policy, "
                     f"{preds[p]} AS pred, {actual(n)} AS actual FROM ls")
    union = " UNION ALL ".join(parts)
    return (f"SELECT *, (pred = actual)::int AS hit, pred IS NOT NULL AS emitted, "
            f"coalesce(sign(z60) = sign(rev), false) AS confirmed FROM ({union}) "
            f"WHERE t >= 120 AND bucket >= 0 AND actual IS NOT NULL")


block("ld", ("ls",), long_rows({30: "moex_z", 60: "pure_rev", 90: "extreme_dist"}))


# ------------------------------------------------------------------ composites

def reversion_sql(n: int, base: str) -> str:
    """mid, mid_conf, blend, strong and the decision columns from the comp/din columns."""
    confirm = ("(cross_ret20 IS NOT NULL AND (score > 0) = (cross_ret20 > 0))" if n >= 30 else "false")
    mid0 = "0.5 + 0.06 * greatest(-2.0, least(2.0, score))"
    return f"""SELECT *, CASE WHEN NOT is_valid THEN 0 WHEN up > 0.5 THEN 1 ELSE 0 END AS mr_pred,
  CASE WHEN is_valid THEN round(mr_conf0, 3) ELSE 0.5 END AS mr_conf,
  CASE WHEN is_valid THEN up ELSE 0.5 END AS mr_up,
  CASE WHEN is_valid THEN CASE WHEN strong THEN 'meanrev_strong' ELSE 'meanrev_medium' END ELSE 'flat' END AS mr_signal,
  CASE WHEN is_valid THEN confirmed::int END AS mr_confirms
FROM (SELECT *, CASE WHEN NOT strong THEN mid WHEN score > 0 THEN mr_conf0 ELSE 1 - mr_conf0 END AS up
  FROM (SELECT *, greatest(mid, 1 - mid) * (1 - blend) + ({base}) * blend AS mr_conf0
    FROM (SELECT *, greatest(0.0, least(1.0, CASE WHEN confirmed THEN 0.5 + (mid0 - 0.5) * 1.2 ELSE mid0 END)) AS mid,
        greatest(0.0, least(1.0, strength - 1.0)) AS blend, strength >= 1.0 AS strong
      FROM (SELECT *, {confirm} AS confirmed, {mid0} AS mid0 FROM src))))"""


DEFAULT = {7: ("0.79", "0.72", "0.65", "0.62", "0.5386"), 30: ("0.75", "0.65", "0.60", "0.56", "0.5775"),
           60: ("0.72", "0.65", "0.60", "0.54", "0.657"), 90: ("0.71", "0.62", "0.57", "0.50", "0.7482")}


def default_rates(n: int) -> dict[str, str]:
    return {b: f"{v}::double" for b, v in zip(("z15", "z10", "z05", "z00"), DEFAULT[n])}


def direction_sql(n: int, rate: dict[str, str] | None = None, base: str | None = None,
                  src: str = "din") -> str:
    """Market direction of every row for one horizon; rates default to the built-in ones."""
    rate = rate or default_rates(n)
    base = base or f"{DEFAULT[n][4]}::double"
    strong_first = "(is_valid AND strength >= 1.0)" if 30 <= n < 90 else "false"
    rev = reversion_sql(n, base).replace("FROM src", f"FROM {src}")
    return f"""SELECT *, {n} AS horizon,
  CASE WHEN sf THEN 'meanrev_strong' WHEN z IS NOT NULL THEN 'moex_dev' ELSE 'mean_rev' END AS signal,
  CASE WHEN mkt THEN (z > 0)::int ELSE mr_pred END AS prediction,
  CASE WHEN mkt THEN c7 ELSE mr_conf END AS confidence,
  round(CASE WHEN mkt THEN CASE WHEN z > 0 THEN c7 ELSE 1 - c7 END ELSE mr_up END, 3) AS prob_up,
  round(1 - CASE WHEN mkt THEN CASE WHEN z > 0 THEN c7 ELSE 1 - c7 END ELSE mr_up END, 3) AS prob_down,
  CASE WHEN mkt THEN {z7('z')} END AS z_bucket, CASE WHEN mkt THEN abs(z) < 0.3 END AS weak_signal
FROM (SELECT *, coalesce({strong_first}, false) AS sf,
    NOT coalesce({strong_first}, false) AND z IS NOT NULL AS mkt, {conf7('abs(z)', rate)} AS c7
  FROM ({rev}))"""


def walk_sql(n: int, more: str = "") -> str:
    """Out-of-sample decisions for one horizon; strong reversion rows get the default base rate."""
    frame = upto(n)
    parts = []
    for b in ("z00", "z05", "z10", "z15"):
        ok = f"zb = '{b}' AND t >= first_row AND actual IS NOT NULL"
        if 30 <= n < 90:
            ok += " AND NOT coalesce(is_valid AND strength >= 1.0, false)"
        parts.append(f"coalesce(count(*) FILTER (WHERE {ok}) OVER {frame}, 0) AS n_{b}, "
                     f"coalesce(count(*) FILTER (WHERE {ok} AND (z > 0)::int = actual) OVER {frame}, 0) AS h_{b}")
    rate = {b: f"CASE WHEN n_{b} >= 20 THEN round(h_{b} / n_{b}, 4) ELSE {v} END"
            for b, v in default_rates(n).items()}
    inner = (f"(SELECT *, {', '.join(parts)} FROM (SELECT *, {z7('z')} AS zb, {actual(n)} AS actual FROM din))")
    return (f"SELECT series_id, date, t, horizon, signal, prediction AS pred, confidence AS conf, actual{more} "
            f"FROM ({direction_sql(n, rate, src=inner)}) WHERE t >= first_row AND actual IS NOT NULL")


block("wf", ("din",), f"SELECT * FROM ({walk_sql(7)}) UNION ALL SELECT * FROM ({walk_sql(90)})")

# Horizons 30 and 60: the base rate of a strong row is the hit rate of the strong rows known by then, which decided in the
# same way. One step per strong row, all series and both horizons at a time; ``cum`` holds the hits so far.
block("wfm", ("din",), " UNION ALL ".join(
    f"SELECT * FROM ({walk_sql(n, ', greatest(mid, 1 - mid) AS mid_conf, blend, score')})" for n in (30, 60)))
block("wfs", ("wfm",), " UNION ALL ".join(f"""
SELECT *, row_number() OVER s AS i, {DEFAULT[n][4]}::double AS base0,
  count(*) OVER (PARTITION BY series_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND {n} PRECEDING) AS known
FROM wfm WHERE horizon = {n} AND signal = 'meanrev_strong' WINDOW s AS (PARTITION BY series_id ORDER BY t)""" for n in (30, 60)))
block("wfr", ("wfs",), """
SELECT DISTINCT series_id, horizon, NULL::int AS t, 0::bigint AS i, []::bigint[] AS cum, 0 AS pred, 0.0::double AS conf FROM wfs
UNION ALL
SELECT series_id, horizon, t, i, list_append(cum, coalesce(cum[i - 1], 0) + (pred = actual)::int), pred, round_even(conf, 3)
FROM (SELECT *, (CASE WHEN score > 0 THEN conf ELSE 1 - conf END > 0.5)::int AS pred
  FROM (SELECT s.*, r.cum, mid_conf * (1 - blend) + CASE WHEN known >= 20 THEN printf('%.4f', r.cum[known] / known)::double ELSE base0 END * blend AS conf
    FROM wfr r JOIN (SELECT * EXCLUDE (pred, conf) FROM wfs) s ON s.series_id = r.series_id AND s.horizon = r.horizon AND s.i = r.i + 1))""")
block("wf4", ("wf", "wfm", "wfr"), """
SELECT series_id, date, t, horizon, signal, pred, conf, actual FROM wf
UNION ALL SELECT m.series_id, m.date, m.t, m.horizon, m.signal, coalesce(r.pred, m.pred), coalesce(r.conf, m.conf), m.actual
FROM wfm m LEFT JOIN wfr r ON r.series_id = m.series_id AND r.horizon = m.horizon AND r.t = m.t""")

_market_rows = " UNION ALL ".join(f"""
  SELECT series_id, {n} AS horizon, zb, (z > 0)::int = actual AS hit,
    z IS NOT NULL AND NOT coalesce({'(is_valid AND strength >= 1.0)' if 30 <= n < 90 else 'false'}, false) AS mkt
  FROM (SELECT *, {z7('z')} AS zb, {actual(n)} AS actual FROM din) WHERE t >= first_row AND actual IS NOT NULL"""
                                  for n in (7, 30, 60, 90))
_defaults_values = ", ".join(f"({n}, '{b}', {v})" for n in DEFAULT for b, v in default_rates(n).items())
block("cnt", ("din",), f"""
SELECT s.series_id, s.horizon, d.bucket, count(*) FILTER (WHERE s.mkt AND s.zb = d.bucket AND s.hit) AS hits,
  count(*) FILTER (WHERE s.mkt AND s.zb = d.bucket) AS n, any_value(d.rate) AS default_rate
FROM ({_market_rows}) s JOIN (VALUES {_defaults_values}) d(horizon, bucket, rate) ON d.horizon = s.horizon
GROUP BY 1, 2, 3""")
block("raw", ("cnt",), """
SELECT *, CASE WHEN n >= 20 THEN round(hits / n, 4) ELSE default_rate END AS raw_rate FROM cnt""")


def _pool_sql() -> str:
    """Twelve explicit steps of the neighbour pooling over one row of four buckets."""
    names = ["z00", "z05", "z10", "z15"]
    wide = "SELECT series_id, horizon, " + ", ".join(
        f"max(CASE WHEN bucket='{b}' THEN raw_rate END) AS r{i}, max(CASE WHEN bucket='{b}' THEN hits END) AS h{i}, "
        f"max(CASE WHEN bucket='{b}' THEN n END) AS n{i}" for i, b in enumerate(names)) + " FROM raw GROUP BY 1, 2"
    sql = f"({wide})"
    for step in range(12):
        lo, hi = step % 3, step % 3 + 1
        p = lambda i: f"(h{i} / nullif(n{i}, 0))"
        var = f"({p(lo)}*(1-{p(lo)})/nullif(n{lo},0) + {p(hi)}*(1-{p(hi)})/nullif(n{hi},0))"
        cond = (f"r{hi} < r{lo} AND n{lo} >= 20 AND n{hi} >= 20 AND {var} > 0 "
                f"AND abs(({p(hi)}-{p(lo)})/sqrt({var})) < 1.96")
        pooled = f"round((h{lo}+h{hi})/(n{lo}+n{hi}), 4)"
        new = ", ".join(f"CASE WHEN {cond} THEN {pooled} ELSE r{i} END AS r{i}" if i in (lo, hi)
                        else f"r{i}" for i in range(4))
        sql = f"(SELECT series_id, horizon, {new}, h0, h1, h2, h3, n0, n1, n2, n3 FROM {sql})"
    return " UNION ALL ".join(f"SELECT series_id, horizon, '{b}' AS bucket, r{i} AS rate FROM pooled"
                              for i, b in enumerate(names)), sql


_union, _steps = _pool_sql()
block("pooled", ("raw",), f"SELECT * FROM {_steps}")
block("calr", ("pooled", "raw"), f"""
SELECT r.series_id, r.horizon, r.bucket, r.hits, r.n, r.raw_rate, p.rate
FROM raw r JOIN ({_union}) p ON p.series_id = r.series_id AND p.horizon = r.horizon AND p.bucket = r.bucket""")
_mr_rows = " UNION ALL ".join(f"""
  SELECT series_id, {n} AS horizon, mr_pred = actual AS hit FROM ({reversion_sql(n, DEFAULT[n][4] + '::double').replace(
    'FROM src', 'FROM (SELECT *, ' + actual(n) + ' AS actual FROM din)')})
  WHERE is_valid AND strength >= 1.0 AND t >= first_row AND actual IS NOT NULL""" for n in (7, 30, 60, 90))
block("mrr", ("din",), f"""
SELECT series_id, horizon, count(*) FILTER (WHERE hit) AS hits, count(*) AS n,
  CASE WHEN count(*) >= 20 THEN round(count(*) FILTER (WHERE hit) / count(*), 4) END AS rate
FROM ({_mr_rows}) GROUP BY 1, 2""")

ERAS = (("1995-1996", "1995-01-01", "1997-01-01"), ("1997-1998", "1997-01-01", "1999-01-01"),
        ("1999+", "1999-01-01", "2200-01-01"))
ERA = ("CASE " + " ".join(f"WHEN date >= date '{lo}' AND date < date '{hi}' THEN '{n}'"
                          for n, lo, hi in ERAS) + " END")
LAST_ERA = f"date >= date '{ERAS[-1][1]}' AND date < date '{ERAS[-1][2]}'"

block("lrep", ("ld",), f"""
SELECT series_id, horizon, policy, oos_emitted, eligible_days, round(oos, 4) AS oos_hit,
  round(oos_emitted / eligible_days, 4) AS coverage, round(modern, 4) AS modern_hit, modern_n,
  coalesce(oos >= 0.70 AND oos_emitted >= 100, false) AS passed_gate,
  coalesce(oos >= 0.70 AND oos_emitted >= 100, false) AND oos_emitted / eligible_days >= 0.30 AS full_protocol
FROM (SELECT series_id, horizon, policy, count(*) FILTER (WHERE emitted) AS oos_emitted, count(*) AS eligible_days,
    avg(hit) FILTER (WHERE emitted) AS oos, avg(hit) FILTER (WHERE emitted AND {LAST_ERA}) AS modern,
    count(*) FILTER (WHERE emitted AND {LAST_ERA}) AS modern_n FROM ld GROUP BY 1, 2, 3)""")
block("gates", ("ld",), f"""
SELECT series_id, horizon, cell, sum(hit0)::bigint AS wins, count(*) AS n, round(sum(hit0) / count(*), 4) AS rate
FROM (SELECT series_id, horizon, CASE WHEN z60 IS NULL THEN 'rev_fallback' WHEN gate < 2 THEN 'gate_failed'
    ELSE {z30('z60')} END AS cell, ((coalesce(z60, rev) > 0)::int = actual)::int AS hit0
  FROM ld WHERE policy = 'moex_z') GROUP BY 1, 2, 3""")
block("lastls", ("ls",), "SELECT * FROM ls QUALIFY t = max(t) OVER (PARTITION BY series_id)")
block("gw", ("gates",), "SELECT series_id, horizon, " + ", ".join(
    f"coalesce(max(CASE WHEN cell='{c}' THEN {v} END), 0) AS {c}_{v}" if v != "rate" else
    f"max(CASE WHEN cell='{c}' THEN rate END) AS {c}_rate"
    for c in ("z00", "z03", "z05", "z10", "gate_failed", "rev_fallback") for v in ("wins", "n", "rate"))
      + " FROM gates GROUP BY 1, 2")
_pts = ("list_filter([{'x': 0.0::double, 'y': z00_rate}, {'x': 0.3::double, 'y': z03_rate}, "
        "{'x': 0.5::double, 'y': z05_rate}, {'x': 1.0::double, 'y': z10_rate}], lambda p: p.y IS NOT NULL)")
block("plong", ("lastls", "lrep", "gw"), f"""
SELECT *, CASE WHEN policy = 'extreme_dist' AND (extreme IS NULL OR conf IS NULL) THEN 'no_validated_signal'
    WHEN bucket < 0 THEN 'insufficient_history' WHEN conf IS NULL THEN 'no_measurable_rate' END AS neutral_reason
FROM (SELECT *, CASE source WHEN 'z_bucket_dynamic' THEN CASE WHEN len(hi) > 0 AND len(lo) > 0 AND len(pts) >= 2
        THEN lo[-1].y + (hi[1].y - lo[-1].y) * (abs(z60) - lo[-1].x) / (hi[1].x - lo[-1].x) ELSE own_rate END
      WHEN 'moex_aggregate_dynamic' THEN agg_w / agg_n WHEN 'gate_failed_dynamic' THEN gate_failed_rate
      WHEN 'rev_fallback_dynamic' THEN rev_fallback_rate ELSE coalesce(modern_hit, oos_hit) END AS conf,
    CASE source WHEN 'z_bucket_dynamic' THEN own_n WHEN 'moex_aggregate_dynamic' THEN agg_n
      WHEN 'gate_failed_dynamic' THEN gate_failed_n WHEN 'rev_fallback_dynamic' THEN rev_fallback_n
      ELSE oos_emitted END AS case_n,
    CASE WHEN policy = 'extreme_dist' THEN extreme WHEN policy = 'moex_z' AND z60 IS NOT NULL THEN (z60 > 0)::int
      ELSE (rev > 0)::int END AS pred
  FROM (SELECT *, CASE WHEN policy <> 'moex_z' THEN 'modern_oos_hit'
        WHEN z60 IS NOT NULL AND gate >= 2 AND own_n >= 20 THEN 'z_bucket_dynamic'
        WHEN z60 IS NOT NULL AND gate >= 2 AND agg_n >= 20 THEN 'moex_aggregate_dynamic'
        WHEN z60 IS NOT NULL AND gate < 2 AND gate_failed_n >= 20 THEN 'gate_failed_dynamic'
        WHEN z60 IS NULL AND rev_fallback_n >= 20 THEN 'rev_fallback_dynamic' ELSE 'modern_oos_hit' END AS source,
      list_filter(pts, lambda p: p.x <= az) AS lo, list_filter(pts, lambda p: p.x > az) AS hi
    FROM (SELECT l.series_id, l.date, l.rev, l.z60, abs(l.z60) AS az, l.gate, l.extreme, l.bucket, p.horizon, p.policy,
        r.* EXCLUDE (series_id, horizon, policy), g.* EXCLUDE (series_id, horizon), {_pts} AS pts,
        {z30('l.z60')} AS zb, CASE {z30('l.z60')} WHEN 'z00' THEN z00_n WHEN 'z03' THEN z03_n WHEN 'z05' THEN z05_n
          ELSE z10_n END AS own_n, CASE {z30('l.z60')} WHEN 'z00' THEN z00_rate WHEN 'z03' THEN z03_rate
          WHEN 'z05' THEN z05_rate ELSE z10_rate END AS own_rate,
        z00_n + z03_n + z05_n + z10_n AS agg_n, z00_wins + z03_wins + z05_wins + z10_wins AS agg_w
      FROM lastls l CROSS JOIN (VALUES (30, 'moex_z'), (60, 'pure_rev'), (90, 'extreme_dist')) p(horizon, policy)
      LEFT JOIN lrep r ON r.series_id = l.series_id AND r.horizon = p.horizon
      LEFT JOIN gw g ON g.series_id = l.series_id AND g.horizon = p.horizon)))""")
block("lastdin", ("din", "calr", "mrr"), """
SELECT d.*, c.z00, c.z05, c.z10, c.z15, coalesce(m.rate, 0.5386::double) AS mr_rate FROM din d
JOIN (SELECT series_id, max(CASE WHEN bucket='z00' THEN rate END) AS z00, max(CASE WHEN bucket='z05' THEN rate END) AS z05,
  max(CASE WHEN bucket='z10' THEN rate END) AS z10, max(CASE WHEN bucket='z15' THEN rate END) AS z15
  FROM calr WHERE horizon = 7 GROUP BY 1) c ON c.series_id = d.series_id
LEFT JOIN mrr m ON m.series_id = d.series_id AND m.horizon = 7
QUALIFY d.t = max(d.t) OVER (PARTITION BY d.series_id)""")
_now7 = direction_sql(7, {b: b for b in ("z00", "z05", "z10", "z15")}, "mr_rate", "lastdin")
block("pnow", ("plong", "lastdin"), f"""
SELECT series_id, date AS as_of, horizon, prediction, confidence, false AS neutral FROM ({_now7})
UNION ALL SELECT series_id, date, horizon, CASE WHEN neutral_reason IS NULL THEN pred END,
  CASE WHEN neutral_reason IS NULL THEN round(conf, 3) END, neutral_reason IS NOT NULL FROM plong""")

block("lbl", ("al", "hv"), f"""
SELECT *, year(date) AS year, CASE WHEN year(date) >= 1998 THEN 'modern_1998plus' ELSE 'pre1998' END AS era,
  CASE WHEN r_fwd > 0.01 THEN 1 WHEN r_fwd < -0.01 THEN -1 ELSE 0 END AS y3,
  CASE WHEN r_fwd > 0 THEN 1 ELSE 0 END AS y2, NOT contaminated AS clean FROM (
SELECT a.series_id, a.date, a.t, (lead(a.price, 30) OVER wa - a.price) / a.price AS r_fwd,
  CASE WHEN a.t < 252 OR h.vol20p IS NULL THEN 'unknown_warmup' WHEN h.high_vol THEN 'high_vol' ELSE 'normal_vol' END AS vol_regime,
  CASE WHEN ln(a.price) - ln(lag(a.price, 60) OVER wa) > 0.03 THEN 'bull'
    WHEN ln(a.price) - ln(lag(a.price, 60) OVER wa) < -0.03 THEN 'bear'
    WHEN lag(a.price, 60) OVER wa IS NOT NULL THEN 'sideways' ELSE 'unknown_warmup' END AS trend_regime,
  CASE WHEN a.close IS NOT NULL THEN 'yes' ELSE 'no' END AS market_at_t,
  coalesce(max(edge::int) OVER (PARTITION BY a.series_id ORDER BY a.date ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) = 1, false) AS contaminated
FROM (SELECT *, abs(ln(lead(price) OVER ({W})) - ln(price)) > 1.8 AS edge FROM al) a
JOIN hv h ON h.series_id = a.series_id AND h.t = a.t
WINDOW wa AS (PARTITION BY a.series_id ORDER BY a.date)) WHERE r_fwd IS NOT NULL""")

block("skew", ("ret",), f"""
SELECT series_id, t, CASE WHEN n = 20 THEN sqrt(20*19)/18.0
  * (s3/20 - 3*(s1/20)*(s2/20) + 2*power(s1/20, 3)) / power(s2/20 - power(s1/20, 2), 1.5) END AS skew20
FROM (SELECT series_id, t, count(r) OVER {rows(20)} AS n, sum(r) OVER {rows(20)} AS s1,
  sum(r*r) OVER {rows(20)} AS s2, sum(r*r*r) OVER {rows(20)} AS s3 FROM ret)""")
block("rsi", ("ret",), f"""
SELECT series_id, t, CASE WHEN n >= 14 AND l > 0 THEN 100 - 100/(1 + g/nullif(l, 0)) END AS rsi14
FROM (SELECT a.series_id, a.t, any_value(a.n) AS n,
    sum(greatest(b.r, 0) * power(13/14.0::double, a.t - b.t)) AS g,
    sum(greatest(-b.r, 0) * power(13/14.0::double, a.t - b.t)) AS l
  FROM (SELECT *, count(r) OVER {upto()} AS n FROM ret) a LEFT JOIN ret b
    ON b.series_id = a.series_id AND b.t BETWEEN a.t - 399 AND a.t GROUP BY 1, 2)""")
FACTORS = [*FEATURE_SQL, "skew20", "rsi14", "key_rate", "sentiment", "sentiment_coverage", "rev"]
_ffr = ("(PARTITION BY series_id, feature ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 30 PRECEDING)")
block("fac", ("feat", "skew", "rsi", "ls"), f"""
SELECT series_id, date, t, feature, value, y2,
  count(v) OVER {_ffr} AS n_known, quantile_cont(v, 0.5) OVER {_ffr} AS threshold
FROM (SELECT *, CASE WHEN t >= 120 THEN value END AS v FROM (
  SELECT series_id, date, t, y2, unnest([{', '.join(f"'{f}'" for f in FACTORS)}]) AS feature,
    unnest([{', '.join(f"({f})::double" for f in FACTORS)}]) AS value
  FROM (SELECT f.*, s.skew20, i.rsi14, l.rev, CASE WHEN later > f.price THEN 1 WHEN later IS NOT NULL THEN 0 END AS y2
    FROM (SELECT *, lead(price, 30) OVER ({W}) AS later FROM feat) f
    JOIN skew s ON s.series_id = f.series_id AND s.t = f.t JOIN rsi i ON i.series_id = f.series_id AND i.t = f.t
    JOIN ls l ON l.series_id = f.series_id AND l.t = f.t)))""")
block("frep", ("fac",), f"""
SELECT series_id, feature, rule, count(*) AS n, round(avg(hit), 4) AS hit, round(avg(pred), 4) AS up_share,
  {", ".join(f"count(*) FILTER (WHERE era = '{n}') AS era{i}_n, round(avg(hit) FILTER (WHERE era = '{n}'), 4) AS era{i}_hit"
             for i, (n, _, _) in enumerate(ERAS, 1))}
FROM (SELECT *, (pred = y2)::int AS hit, {ERA} AS era FROM (SELECT series_id, date, t, feature, y2, unnest(['median', 'sign']) AS rule,
    unnest([(value > threshold)::int, (value > 0)::int]) AS pred
  FROM fac WHERE t >= 120 AND value IS NOT NULL AND n_known >= 30 AND y2 IS NOT NULL)) GROUP BY 1, 2, 3""")

block("ev", ("mk", "ld", "al"), f"""
SELECT m.series_id, m.date, 7 AS horizon, ((m.z_own > 0)::int = a.actual)::int AS hit
FROM mk m JOIN (SELECT series_id, t, {actual(7)} AS actual FROM al) a ON a.series_id = m.series_id AND a.t = m.t
WHERE m.z_own IS NOT NULL AND a.actual IS NOT NULL
UNION ALL SELECT series_id, date, horizon, hit FROM ld WHERE emitted""")
block("health", ("ev", "official"), """
SELECT e.series_id, h.horizon, round(s.acc, 4) AS rolling_acc, coalesce(s.n, 0) AS n, s.first_eval_date, s.last_eval_date,
  CASE WHEN s.acc IS NULL THEN 'no_data' WHEN s.acc >= h.healthy THEN 'healthy' WHEN s.acc >= h.alert THEN 'degraded'
    ELSE 'alert' END AS status
FROM (SELECT series_id, max(date) AS today FROM official GROUP BY 1) e
CROSS JOIN (VALUES (7, 0.65, 0.55), (30, 0.58, 0.50), (60, 0.59, 0.48), (90, 0.70, 0.50)) h(horizon, healthy, alert)
LEFT JOIN (SELECT v.series_id, v.horizon, avg(v.hit) AS acc, count(*) AS n, min(v.date) AS first_eval_date,
    max(v.date) AS last_eval_date
  FROM ev v JOIN (SELECT series_id, max(date) AS today FROM official GROUP BY 1) t ON t.series_id = v.series_id
  WHERE v.date >= t.today - 365 GROUP BY 1, 2) s ON s.series_id = e.series_id AND s.horizon = h.horizon""")
block("led", ("ld", "wf"), """
SELECT series_id, date AS as_of, horizon, '2026.09-gate2' AS model_version, 0 AS is_shadow, pred AS prediction FROM ld
UNION ALL SELECT series_id, date, horizon, '2026.09-gate2', 0, pred FROM wf WHERE horizon = 7""")
block("settled", ("led", "official"), f"""
SELECT l.*, CASE WHEN l.prediction IS NOT NULL THEN o.realized END AS realized,
  CASE WHEN l.prediction IS NOT NULL THEN o.ret END AS realized_ret,
  CASE WHEN l.prediction IS NOT NULL THEN o.rdate END AS realized_date
FROM led l LEFT JOIN ({" UNION ALL ".join(f'''SELECT series_id, date, {n} AS horizon,
    CASE WHEN lead(price, {n}) OVER ({W}) > price THEN 1 WHEN lead(price, {n}) OVER ({W}) IS NOT NULL THEN 0 END AS realized,
    ln(lead(price, {n}) OVER ({W})) - ln(price) AS ret, lead(date, {n}) OVER ({W}) AS rdate FROM official'''
    for n in (7, 30, 60, 90))}) o ON o.series_id = l.series_id AND o.date = l.as_of AND o.horizon = l.horizon""")

# The older snapshot of an audit: quotes per ten units in two months of the year, and the long report made from it.
FLIP = "CASE WHEN month(date) IN (2, 7) THEN price * 10 ELSE price END"
block("official_old", ("official",), f"SELECT * REPLACE ({FLIP} AS price) FROM official")
for _name in ("al", "ls", "ld", "lrep"):
    _deps, _body = _BLOCKS[_name]
    block(f"{_name}_old", tuple(f"{d}_old" if d in ("official", "al", "ls", "ld") else d for d in _deps),
          re.sub(r"\b(FROM|JOIN) (official|al|ls|ld)\b", r"\1 \2_old", _body))
