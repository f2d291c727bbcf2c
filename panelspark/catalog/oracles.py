"""The queries of ``catalog.queries`` written out as plain SQL.

Written for checking only and independently of the operators: lags are self
joins, leave-one-key-out statistics are separate groupings, folds come from
scalar subqueries.
"""

from panelspark.catalog.views import CENTS_OF, FORECAST_COLUMNS, FORECAST_READINGS, HISTORY_COLUMNS, HISTORY_READINGS
from panelspark.sources.schema import FORECAST_VARIABLES, HISTORY_VARIABLES, HISTORY_WHOLE_NUMBERS

N = 14
OFFSETS = list(range(2, N + 1))
STATS = {"avg": "avg", "sum": "sum", "min": "min", "max": "max", "std": "stddev_samp"}
KEYS = ["county", "is_business", "product_type", "is_consumption"]
KEY_LIST = ", ".join(KEYS)
K = 5
EMBARGO = 30
LEAD = list(range(22, 46))

START = "TIMESTAMP '2024-01-01 00:00:00'"
CENTS = "CAST(round({0} * 100) AS BIGINT)"

_WHOLE = {"short": "SMALLINT", "int": "INTEGER"}


def _readings(formulas, whole=()):
    return ",\n               ".join(
        f'CAST({formula.format(**CENTS_OF)} AS {"INTEGER" if name in whole else "DOUBLE"}) AS "{name}"'
        for name, formula in formulas.items()
    )


VIEWS = {
    "ev": f"""
        SELECT CAST(floor(user_id / 32) AS INTEGER) AS county, CAST(user_id % 2 AS INTEGER) AS is_business,
               CAST(CAST(floor(user_id / 2) AS BIGINT) % 4 AS INTEGER) AS product_type,
               CAST(event_id % 2 AS INTEGER) AS is_consumption,
               CAST(date_trunc('hour', ts) AS TIMESTAMP) AS datetime, {CENTS.format('value')} AS cents, event_id
        FROM events""",
    "panel": f"""
        SELECT k.county, k.is_business, k.product_type, k.is_consumption, h.datetime,
               CASE WHEN k.county % 4 = 3 AND h.i % 97 = 0 THEN NULL ELSE CAST(coalesce(a.v, 0) AS DOUBLE) END AS target,
               ((CAST(k.county AS BIGINT) * 720 + h.i) * 2 + k.is_business) * 8 + k.product_type * 2 + k.is_consumption AS row_id
        FROM (SELECT DISTINCT {KEY_LIST} FROM ev) k
        CROSS JOIN (SELECT i, {START} + i * INTERVAL 1 HOUR AS datetime FROM range(0, 720) t(i)) h
        LEFT JOIN (SELECT {KEY_LIST}, datetime, sum(cents) AS v FROM ev GROUP BY ALL) a
          ON a.county = k.county AND a.is_business = k.is_business AND a.product_type = k.product_type
         AND a.is_consumption = k.is_consumption AND a.datetime = h.datetime""",
    "clients": f"""
        SELECT county, is_business, product_type, CAST({START} + d.i * INTERVAL 1 DAY AS DATE) AS date,
               CAST(n + d.i AS INTEGER) AS eic_count, CAST(balance + d.i AS DOUBLE) AS installed_capacity
        FROM (SELECT CAST(floor(c_custkey / 320) AS INTEGER) AS county, CAST(c_custkey % 2 AS INTEGER) AS is_business,
                     CAST(CAST(floor(c_custkey / 2) AS BIGINT) % 4 AS INTEGER) AS product_type,
                     count(*) AS n, sum({CENTS.format('abs(c_acctbal)')}) AS balance
              FROM customer GROUP BY 1, 2, 3) g CROSS JOIN range(0, 30) d(i)""",
    "gas": f"""
        SELECT CAST({START} + (o_orderkey % 30) * INTERVAL 1 DAY AS DATE) AS forecast_date,
               CAST(min({CENTS.format('o_totalprice')}) AS DOUBLE) AS lowest_price_per_mwh,
               CAST(max({CENTS.format('o_totalprice')}) AS DOUBLE) AS highest_price_per_mwh
        FROM orders GROUP BY 1""",
    "electricity": f"""
        SELECT {START} + (l_orderkey % 720) * INTERVAL 1 HOUR AS forecast_date,
               CAST(max({CENTS.format('l_extendedprice')}) AS DOUBLE) AS euros_per_mwh
        FROM lineitem GROUP BY 1""",
    "stations": """
        SELECT round(57.0 + (s_suppkey % 40) / 10, 1) AS latitude, round(21.0 + floor(s_suppkey / 40) / 10, 1) AS longitude,
               CASE WHEN s_suppkey % 8 <> 7 THEN CAST(floor(s_suppkey / 20) AS INTEGER) END AS county, s_suppkey
        FROM supplier""",
    "forecast": f"""
        SELECT s.latitude, s.longitude, CAST(1 + l_partkey % 48 AS INTEGER) AS hours_ahead,
               {START} + (l_orderkey % 30) * INTERVAL 1 DAY AS origin_datetime,
               {_readings(FORECAST_READINGS)}
        FROM lineitem JOIN stations s ON s.s_suppkey = l_suppkey GROUP BY 1, 2, 3, 4""",
    "history": f"""
        SELECT s.latitude, s.longitude, {START} + (l_orderkey % 720) * INTERVAL 1 HOUR AS datetime,
               {_readings(HISTORY_READINGS, HISTORY_WHOLE_NUMBERS)}
        FROM lineitem JOIN stations s ON s.s_suppkey = l_suppkey GROUP BY 1, 2, 3""",
    "client_f": """
        SELECT CAST(date + INTERVAL 2 DAY AS DATE) AS date, county, is_business, product_type, eic_count, installed_capacity,
               CAST(trunc(avg(eic_count) OVER g) AS INTEGER) AS eic_count_mean_date,
               avg(installed_capacity) OVER g AS installed_capacity_mean_date,
               round(ln(1 + installed_capacity), 6) AS installed_capacity_log1p,
               round(avg(ln(1 + installed_capacity)) OVER g, 6) AS installed_capacity_log1p_mean_date,
               ln(1 + installed_capacity) AS raw_log1p
        FROM clients WINDOW g AS (PARTITION BY date, product_type, county, is_business)""",
    "gas_f": """
        SELECT CAST(forecast_date + INTERVAL 1 DAY AS DATE) AS date, lowest_price_per_mwh, highest_price_per_mwh,
               (lowest_price_per_mwh + highest_price_per_mwh) / 2 AS mean_price_per_mwh,
               highest_price_per_mwh - lowest_price_per_mwh AS range_price_per_mwh
        FROM gas""",
    "electricity_f": "SELECT forecast_date + INTERVAL 1 DAY AS datetime, euros_per_mwh FROM electricity",
    "located_history": """
        SELECT h.*, s.county,
               CAST(CASE WHEN hour(datetime) < 11 THEN datetime + INTERVAL 1 DAY ELSE datetime + INTERVAL 2 DAY END AS DATE) AS date
        FROM history h JOIN stations s ON s.latitude = h.latitude AND s.longitude = h.longitude
        WHERE s.county IS NOT NULL""",
    "history_f": "SELECT county, date, " + ", ".join(
        (f"CAST(trunc(avg({v})) AS {_WHOLE[HISTORY_WHOLE_NUMBERS[v]]})" if v in HISTORY_WHOLE_NUMBERS else f"avg({v})")
        + f" AS {v}_hours_ago_mean" for v in HISTORY_VARIABLES
    ) + " FROM located_history GROUP BY 1, 2",
    "day": f"""
        SELECT {KEY_LIST}, CAST(datetime AS DATE) AS date,
               {', '.join(f'{f}(target) AS {s}_day_target' for s, f in STATS.items())}
        FROM panel GROUP BY ALL""",
}

_LEAD_STATS = {"": "avg", "_min": "min", "_max": "max", "_std": "stddev_samp"}
VIEWS["lead_stats"] = "SELECT s.county, CAST(f.origin_datetime + INTERVAL 1 DAY AS DATE) AS date, hours_ahead, " + ", ".join(
    f'{fn}("{v}") AS "{v}{suffix}"' for suffix, fn in _LEAD_STATS.items() for v in FORECAST_VARIABLES
) + (
    " FROM forecast f JOIN stations s ON s.latitude = f.latitude AND s.longitude = f.longitude"
    " WHERE s.county IS NOT NULL AND hours_ahead BETWEEN 22 AND 45 GROUP BY ALL"
)
VIEWS["forecast_f"] = "SELECT b.county, b.date, " + ", ".join(
    f'h{h}."{v}{suffix}" AS "{v}_hours_ahead_{h}{suffix}"' for suffix in _LEAD_STATS for v in FORECAST_VARIABLES for h in LEAD
) + " FROM (SELECT DISTINCT county, date FROM lead_stats) b " + " ".join(
    f"LEFT JOIN lead_stats h{h} ON h{h}.county = b.county AND h{h}.date = b.date AND h{h}.hours_ahead = {h}" for h in LEAD
)
for _out in KEYS:
    _others = ", ".join(k for k in KEYS if k != _out)
    VIEWS[f"over_{_out}"] = (
        f"SELECT {_others}, datetime, "
        + ", ".join(f"{f}(target) AS {s}_{_out}_target" for s, f in STATS.items())
        + " FROM panel GROUP BY ALL"
    )

VIEWS["complete"] = "SELECT * FROM lagged WHERE " + " AND ".join(f"target_lag_{d} IS NOT NULL" for d in OFFSETS)


def _log(d):
    return f"ln(1 + target_lag_{d})"


_LAGS = [f"target_lag_{d}" for d in OFFSETS]
_DIFFS = [f"(target_lag_{d} - target_lag_{d + 1})" for d in OFFSETS[:-1]]
_LOG_DIFFS = [f"({_log(d)} - {_log(d + 1)})" for d in OFFSETS[:-1]]


def _arg(cols, fn):
    return f"CAST(list_position([{', '.join(cols)}], {fn}({', '.join(cols)})) - 1 AS INTEGER)"


def _sum(cols):
    return "(" + " + ".join(cols) + ")"


LIST_STATS = {}
for _tail, _cut in (("", None), ("_2_4", 4)):
    _l, _d, _g = _LAGS[:_cut], _DIFFS[:_cut], _LOG_DIFFS[:_cut]
    LIST_STATS[f"target_log1p_mean_shift_all_lag{_tail}"] = f"round({_sum(_g)} / {len(_g)}, 6) + 0.0"
    LIST_STATS[f"target_mean_shift_all_lag{_tail}"] = f"{_sum(_d)} / {len(_d)}"
    LIST_STATS[f"target_sum_all_lag{_tail}"] = _sum(_l)
    LIST_STATS[f"target_argmax_all_lag{_tail}"] = _arg(_l, "greatest")
    LIST_STATS[f"target_argmin_all_lag{_tail}"] = _arg(_l, "least")
    LIST_STATS[f"target_mean_all_lag{_tail}"] = f"{_sum(_l)} / {len(_l)}"
    LIST_STATS[f"target_min_all_lag{_tail}"] = f"least({', '.join(_l)})"
    LIST_STATS[f"target_max_all_lag{_tail}"] = f"greatest({', '.join(_l)})"
LIST_RATIOS = {
    f"target_lag_2_vs_{s}_all{_tail}": f"target_lag_2 / nullif(1 + {LIST_STATS[f'target_{s}_all_lag{_cols}']}, 0)"
    for s in ("mean", "min", "max", "sum")
    for _cols, _tail in (("", ""), ("_2_4", "_2_4" if s == "sum" else "_lag_2_4"))
}

VIEWS["steps"] = """
    SELECT o_orderkey, o_orderdate, o_totalprice AS target, CAST(i.step AS INTEGER) AS step
    FROM orders JOIN (SELECT day, row_number() OVER (ORDER BY day) - 1 AS step
                      FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)) i
      ON i.day = CAST(o_orderdate AS DATE)"""


def row_limits(view, k):
    """Fold limits by share of rows, as a query over ``view.step``."""
    starts = " UNION ALL ".join(
        f"SELECT {i} AS fold, min(CASE WHEN share >= {(1 / k) * i!r} THEN step END) AS lo, max(step) AS top FROM shares"
        for i in range(k)
    )
    return f"""
        SELECT fold, lo AS valid_min, coalesce(lead(lo) OVER (ORDER BY fold), top) AS valid_max
        FROM (WITH shares AS (
            SELECT step, CAST(sum(n) OVER (ORDER BY step) AS DOUBLE) / (SELECT count(*) FROM {view}) AS share
            FROM (SELECT step, count(*) AS n FROM {view} GROUP BY step))
            {starts})"""


VIEWS["limits"] = row_limits("steps", K)
VIEWS["limits_dates"] = f"""
    SELECT least(CAST(floor((pos - 100) / floor((total - 100) / {K})) AS INTEGER), {K - 1}) AS fold,
           min(step) AS valid_min, max(step) AS valid_max
    FROM (SELECT step, row_number() OVER (ORDER BY step) - 1 AS pos, count(*) OVER () AS total
          FROM (SELECT DISTINCT step FROM steps))
    WHERE pos >= 100 GROUP BY 1"""


def labelled(view, limits, k, embargo):
    one = ", ".join(
        f"""CASE WHEN step < l{i}.valid_min - {embargo} OR step > l{i}.valid_max + {embargo} THEN 't'
                 WHEN step BETWEEN l{i}.valid_min AND l{i}.valid_max THEN 'v' ELSE 'n' END AS f{i}"""
        for i in range(k)
    )
    joins = " ".join(f"JOIN {limits} l{i} ON l{i}.fold = {i}" for i in range(k))
    return f"SELECT {view}.*, {one} FROM {view} {joins}"


VIEWS["labels_rows"] = labelled("steps", "limits", K, EMBARGO)
VIEWS["labels_dates"] = labelled("steps", "limits_dates", K, EMBARGO)
FOLD_INFO = " || ', ' || ".join(f"f{i}" for i in range(K))

VIEWS["imp"] = """
    SELECT p_name || ' ' || p_partkey AS feature, l_linenumber AS fold, sum(l_quantity) AS importance
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2"""
VIEWS["imp_mean"] = "SELECT feature, sum(importance) / 7 AS average FROM imp GROUP BY 1"
VIEWS["curve"] = f"""
    SELECT l_linenumber AS fold, CAST(l_quantity AS INTEGER) AS round, avg({CENTS.format('l_extendedprice')}) AS error
    FROM lineitem GROUP BY 1, 2"""
VIEWS["curve_mean"] = "SELECT round AS rnd, avg(error) AS average_error, stddev_samp(error) AS std_error FROM curve GROUP BY 1"

NOUNS = ["small", "ring", "bolt", "red", "plate", "gear", "o"]


def first_of(expr):
    return "CASE " + " ".join(f"WHEN contains({expr}, '{n}') THEN '{n}'" for n in NOUNS) + " END"


# every feature of a panel row: one join with the list of offsets, and one grouping
_DAY_COLS = [f"{s}_day_target" for s in STATS]
_OVER_COLS = [f"{s}_{k}_target" for k in KEYS for s in STATS]


def _without(key):
    return [k for k in KEYS if k != key]


VIEWS["enriched"] = (
    f"SELECT {', '.join('p.' + c for c in [*KEYS, 'datetime', 'target'])}, {', '.join('d.' + c for c in _DAY_COLS)}, "
    + ", ".join(f"o_{k}.{s}_{k}_target" for k in KEYS for s in STATS)
    + " FROM panel p LEFT JOIN day d ON " + " AND ".join(f"d.{k} = p.{k}" for k in KEYS)
    + " AND d.date = CAST(p.datetime AS DATE) "
    + " ".join(
        f"LEFT JOIN over_{k} o_{k} ON o_{k}.datetime = p.datetime AND " + " AND ".join(f"o_{k}.{o} = p.{o}" for o in _without(k))
        for k in KEYS)
)


def _features_from(rows, cols=("target",), source="panel"):
    """Each row of ``rows`` with ``cols`` of ``source`` as they were 2 to 14 days before."""
    same = " AND ".join(f"e.{k} = q.{k}" for k in KEYS)
    lagged = ", ".join(f"max(CASE WHEN o.d = {d} THEN e.{c} END) AS {c}_lag_{d}" for d in OFFSETS for c in cols)
    return f"""SELECT p.*, CAST(p.datetime AS DATE) AS date, g.* EXCLUDE ({KEY_LIST}, datetime) FROM {rows} p JOIN (
        SELECT q.{', q.'.join(KEYS)}, q.datetime, {lagged}
        FROM (SELECT {KEY_LIST}, datetime FROM {rows}) q CROSS JOIN (SELECT CAST(unnest(range(2, {N + 1})) AS INTEGER) AS d) o
        LEFT JOIN {source} e ON {same} AND e.datetime = q.datetime - to_days(o.d) GROUP BY ALL) g
        ON {" AND ".join(f"g.{k} = p.{k}" for k in KEYS)} AND g.datetime = p.datetime"""


VIEWS["lagged"] = f"SELECT * EXCLUDE (date) FROM ({_features_from('panel')})"
ALL_THERE = " AND ".join(f"target_lag_{d} IS NOT NULL" for d in OFFSETS)


def lag_features():
    """Name and formula of every lag feature."""
    out = {f"target_lag_{d}": f"target_lag_{d}" for d in OFFSETS}
    out |= {f"target_log1p_lag_{d}": f"round({_log(d)}, 6)" for d in OFFSETS}
    out |= {f"target_lag_{d}_diff": e for e, d in zip(_DIFFS, OFFSETS)}
    out |= {f"target_log1p_lag_{d}_diff": f"round({e}, 6) + 0.0" for e, d in zip(_LOG_DIFFS, OFFSETS)}
    for d in OFFSETS:
        for c in [*_DAY_COLS, *_OVER_COLS]:
            out[f"{c}_lag_{d}"] = f"round({c}_lag_{d}, 3)" if c.startswith("std_") else f"{c}_lag_{d}"
    return out | LIST_STATS | LIST_RATIOS


def all_features(rows, plain=None, extra_joins=""):
    """Every lag feature, and the formulas ``plain``, for every row of ``rows``."""
    cols = [f"CASE WHEN {ALL_THERE} THEN {e} END AS {n}" for n, e in lag_features().items()]
    cols += [f'{e} AS "{n}"' for n, e in (plain or {}).items()]
    return f"{', '.join(cols)} FROM ({_features_from(rows, ['target', *_DAY_COLS, *_OVER_COLS], 'enriched')}) f {extra_joins}"


# Easter Sundays of the years the orders span, from the church calendar
EASTER = ["1995-04-16", "1996-04-07", "1997-03-30", "1998-04-12", "1999-04-04", "2000-04-23", "2001-04-15"]
HOLIDAY = f"""(strftime(date, '%m-%d') IN ('01-01', '02-24', '05-01', '06-23', '06-24', '12-25', '12-26')
    OR (strftime(date, '%m-%d') = '08-20' AND year(date) >= 1998)
    OR (strftime(date, '%m-%d') = '12-24' AND year(date) >= 2005)
    OR date IN ({', '.join(f"DATE '{e}', DATE '{e}' - 2, DATE '{e}' + 49" for e in EASTER)}))"""
# the panel lies in January 2024, whose only holiday is New Year's Day
JANUARY_HOLIDAY = "CASE WHEN strftime(f.date, '%m-%d') = '01-01' THEN 1 ELSE 0 END"

_SIDE = """
    LEFT JOIN client_f c ON c.county = f.county AND c.is_business = f.is_business AND c.product_type = f.product_type AND c.date = f.date
    LEFT JOIN electricity_f e ON e.datetime = f.datetime
    LEFT JOIN gas_f g ON g.date = f.date
    LEFT JOIN forecast_f w ON w.date = f.date AND w.county = f.county
    LEFT JOIN history_f hw ON hw.date = f.date AND hw.county = f.county"""
_ANGLES = {"ordinal_day": "dayofyear(f.datetime) / 183", "hour": "hour(f.datetime) / 12"}
_CALENDAR = {
    "year": "year", "quarter": "quarter", "month": "month", "week": "week", "hour": "hour", "day": "day",
    "ordinal_day": "dayofyear", "weekday": "isodow",
}


def _proxy(capacity, h):
    return (
        f"({capacity} * w.surface_solar_radiation_downwards_hours_ahead_{h})"
        f" / nullif(w.temperature_hours_ahead_{h} + CAST(273.15 AS DOUBLE), 0)"
    )


def _plain(forecast, history):
    """Everything beside the lags, for some of the weather variables."""
    leads = [f"{v}_hours_ahead_{h}" for v in forecast for h in LEAD]
    return {
        "date": "CAST(f.date AS TIMESTAMP)",
        **{c: f"c.{c}" for c in (
            "eic_count", "installed_capacity", "eic_count_mean_date", "installed_capacity_mean_date",
            "installed_capacity_log1p", "installed_capacity_log1p_mean_date")},
        "euros_per_mwh": "e.euros_per_mwh",
        **{c: f"g.{c}" for c in ("lowest_price_per_mwh", "highest_price_per_mwh", "mean_price_per_mwh", "range_price_per_mwh")},
        **{f"{v}_hours_ago_mean": f"hw.{v}_hours_ago_mean" for v in history},
        **{n: f"CAST({fn}(f.datetime) AS INTEGER)" for n, fn in _CALENDAR.items()},
        **{f"{fn}({n})": f"round({fn}(pi() * {angle}), 6) + 0.0" for n, angle in _ANGLES.items() for fn in ("sin", "cos")},
        "date_order_kfold": "CAST(date_diff('day', DATE '2024-01-01', f.date) AS INTEGER)",
        "holiday": JANUARY_HOLIDAY,
        **{f"{c}{s}": f'round(w."{c}{s}", 3)' if s == "_std" else f'w."{c}{s}"' for s in ("", "_min", "_max", "_std") for c in leads},
        **{f"production_capacity_temperature_{h}": _proxy("c.installed_capacity", h) for h in LEAD},
        **{f"production_capacity_log1p_temperature_{h}": f"round({_proxy('c.raw_log1p', h)}, 4)" for h in LEAD},
        **{
            f"target_lag_{d}_vs_{n}": f"CASE WHEN {ALL_THERE} THEN target_lag_{d} / nullif(1 + c.{col}, 0) END"
            for col, n in (("installed_capacity", "installed"), ("eic_count", "eic")) for d in OFFSETS
        },
        "installed_vs_eic": "c.installed_capacity / nullif(1 + c.eic_count, 0)",
    }


_PLAIN = _plain(FORECAST_COLUMNS, HISTORY_COLUMNS)
VIEWS["later"] = f"SELECT {KEY_LIST}, datetime + INTERVAL 10 DAY AS datetime FROM panel"
VIEWS["asked"] = f"SELECT {KEY_LIST}, datetime + INTERVAL 16 DAY AS datetime, row_id FROM panel"


def _assembled(plain):
    return f"SELECT f.{', f.'.join(KEYS)}, f.datetime, f.row_id, f.target, " + all_features("panel", plain, _SIDE)


def _rounded_std(cols):
    return ", ".join(f"round({c}, 3) AS {c}" if c.startswith("std_") else c for c in cols)


SQL = {
    "conform_types": """
        SELECT l_orderkey, CAST(l_linenumber AS SMALLINT) AS l_linenumber, CAST(trunc(l_quantity) AS SMALLINT) AS l_quantity,
               CAST(trunc(l_extendedprice) AS INTEGER) AS l_extendedprice, CAST(l_shipdate AS DATE) AS l_shipdate
        FROM lineitem""",
    "landed_csv": """
        SELECT 'lines' AS what, strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n_rows, CAST(sum(l_orderkey) AS BIGINT) AS keys,
               CAST(sum(l_quantity) AS DOUBLE) AS amount
        FROM lineitem WHERE l_orderkey % 50 NOT IN (7, 9) GROUP BY ALL
        UNION ALL SELECT 'bad', 'none', count(*), 0, 0 FROM lineitem WHERE l_orderkey % 50 IN (7, 9) HAVING count(*) > 0
        UNION ALL SELECT 'train', strftime(datetime, '%Y-%m'), count(*), CAST(sum(row_id) AS BIGINT), sum(target) FROM panel GROUP BY ALL""",
    "parse_epoch_or_iso": "SELECT event_id, ts AS parsed FROM events",
    "lookback_filter": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem,
             (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01') b
        WHERE l_shipdate >= lo - INTERVAL 45 DAY AND l_shipdate <= hi + INTERVAL 45 DAY""",
    "time_bounds": """
        SELECT min(o_orderdate) AS min_time, max(o_orderdate) AS max_time,
               CAST(min(year(o_orderdate)) AS INTEGER) AS min_year, CAST(max(year(o_orderdate)) AS INTEGER) AS max_year
        FROM orders""",
    "publish_alignment": """
        SELECT event_id, ts, ts + INTERVAL 2 DAY AS known_after_two_days,
               CAST(ts + INTERVAL 1 DAY AS DATE) AS day_of_use, CAST(ts AS DATE) AS day
        FROM events""",
    "history_publish_date": """
        SELECT latitude, longitude, datetime,
               CAST(CASE WHEN hour(datetime) < 11 THEN datetime + INTERVAL 1 DAY ELSE datetime + INTERVAL 2 DAY END AS DATE) AS date
        FROM history""",
    "station_to_county": """
        SELECT f.*, s.county FROM forecast f JOIN stations s ON s.latitude = f.latitude AND s.longitude = f.longitude
        WHERE s.county IS NOT NULL""",
    "duplicate_key_report": """
        SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
    "calendar_features": """
        SELECT o_orderkey, datetime, CAST(datetime AS DATE) AS date, CAST(year(datetime) AS INTEGER) AS year,
               CAST(quarter(datetime) AS INTEGER) AS quarter, CAST(month(datetime) AS INTEGER) AS month,
               CAST(week(datetime) AS INTEGER) AS week, CAST(hour(datetime) AS INTEGER) AS hour,
               CAST(day(datetime) AS INTEGER) AS day, CAST(dayofyear(datetime) AS INTEGER) AS ordinal_day,
               CAST(isodow(datetime) AS INTEGER) AS weekday
        FROM (SELECT o_orderkey, o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR AS datetime FROM orders)""",
    "cyclic_features": """
        SELECT o_orderkey, round(sin(pi() * dayofyear(t) / 183), 6) + 0.0 AS sin_day,
               round(cos(pi() * dayofyear(t) / 183), 6) + 0.0 AS cos_day,
               round(sin(pi() * hour(t) / 12), 6) + 0.0 AS sin_hour, round(cos(pi() * hour(t) / 12), 6) + 0.0 AS cos_hour
        FROM (SELECT o_orderkey, o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR AS t FROM orders)""",
    "date_index": """
        SELECT o_orderkey, o_orderdate, step AS date_order_kfold FROM steps""",
    "holiday_flag": f"""
        SELECT o_orderkey, date, CASE WHEN {HOLIDAY} THEN 1 ELSE 0 END AS holiday
        FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders)""",
    "daily_stats": f"SELECT {KEY_LIST}, date, {_rounded_std(_DAY_COLS)} FROM day",
    "marginal_stats": " UNION ALL ".join(
        f"SELECT '{out}' AS over_key, "
        + ", ".join("NULL AS " + k if k == out else k for k in KEYS)
        + ", datetime, "
        + ", ".join(f"round({s}_{out}_target, 3) AS {s}_target" if s == "std" else f"{s}_{out}_target AS {s}_target" for s in STATS)
        + f" FROM over_{out}"
        for out in KEYS
    ),
    "client_features": "SELECT * EXCLUDE (raw_log1p) FROM client_f",
    "gas_features": f"""
        SELECT o_custkey, CAST(o_orderdate + INTERVAL 1 DAY AS DATE) AS date, lo AS lowest_price_per_mwh,
               hi AS highest_price_per_mwh, (lo + hi) / 2 AS mean_price_per_mwh, hi - lo AS range_price_per_mwh
        FROM (SELECT o_custkey, o_orderdate, CAST(min({CENTS.format('o_totalprice')}) AS DOUBLE) AS lo,
                     CAST(max({CENTS.format('o_totalprice')}) AS DOUBLE) AS hi
              FROM orders GROUP BY 1, 2)""",
    "weather_pivot": "SELECT * REPLACE (" + ", ".join(
        f'round("{v}_hours_ahead_{h}_std", 3) AS "{v}_hours_ahead_{h}_std"' for v in FORECAST_VARIABLES for h in LEAD
    ) + ") FROM forecast_f",
    "history_daily_mean": "SELECT * FROM history_f",
    "hours_ago_rank": """
        SELECT latitude, longitude, date, datetime,
               CAST(row_number() OVER (PARTITION BY latitude, longitude, date ORDER BY datetime DESC) - 1 AS INTEGER) AS hours_ago
        FROM located_history""",
    "dense_panel": f"""
        SELECT k.*, t.datetime FROM (SELECT DISTINCT {KEY_LIST} FROM ev) k
        CROSS JOIN (SELECT unnest(generate_series(min(datetime) - INTERVAL 2 DAY, max(datetime) + INTERVAL 2 DAY, INTERVAL 1 HOUR)) AS datetime FROM ev) t""",
    "exact_lag_hourly": "SELECT * EXCLUDE (row_id), "
        + ", ".join(f"round({_log(d)}, 6) AS target_log1p_lag_{d}" for d in OFFSETS) + " FROM lagged",
    "exact_lag_future": f"SELECT * EXCLUDE (date) FROM ({_features_from('later')})",
    "exact_lag_daily": f"SELECT p.{', p.'.join(KEYS)}, p.date, " + ", ".join(
        (f"round(j{d}.{c}, 3)" if c.startswith("std") else f"j{d}.{c}") + f" AS {c}_lag_{d}" for d in OFFSETS for c in _DAY_COLS
    ) + " FROM day p " + " ".join(
        f"LEFT JOIN day j{d} ON " + " AND ".join(f"j{d}.{k} = p.{k}" for k in KEYS) + f" AND j{d}.date = CAST(p.date - INTERVAL {d} DAY AS DATE)"
        for d in OFFSETS
    ),
    "exact_lag_marginal": " UNION ALL ".join(
        f"SELECT '{out}' AS over_key, "
        + ", ".join("NULL AS " + k if k == out else f"q.{k}" for k in KEYS)
        + ", q.datetime, "
        + ", ".join(
            (f"round({v}, 3)" if s == "std" else v) + f" AS {s}_target_lag_{d}"
            for d in OFFSETS for s in STATS for v in [f"max(CASE WHEN o.d = {d} THEN e.{s}_{out}_target END)"])
        + f" FROM over_{out} q CROSS JOIN (SELECT CAST(unnest(range(2, {N + 1})) AS INTEGER) AS d) o LEFT JOIN over_{out} e ON "
        + " AND ".join(f"e.{k} = q.{k}" for k in _without(out))
        + f" AND e.datetime = q.datetime - to_days(o.d) GROUP BY {', '.join('q.' + k for k in _without(out))}, q.datetime"
        for out in KEYS
    ),
    "lag_complete": "SELECT * EXCLUDE (row_id) FROM complete",
    "lag_diffs": f"SELECT {KEY_LIST}, datetime, "
        + ", ".join(f"{e} AS target_lag_{d}_diff" for e, d in zip(_DIFFS, OFFSETS)) + ", "
        + ", ".join(f"round({e}, 6) + 0.0 AS target_log1p_lag_{d}_diff" for e, d in zip(_LOG_DIFFS, OFFSETS))
        + " FROM complete",
    "lag_list_stats": f"SELECT {KEY_LIST}, datetime, "
        + ", ".join(f"{e} AS {n}" for n, e in LIST_STATS.items()) + " FROM complete",
    "lag_ratios": f"SELECT {KEY_LIST}, datetime, "
        + ", ".join(f"{e} AS {n}" for n, e in LIST_RATIOS.items()) + " FROM complete",
    "target_features": f"SELECT f.{', f.'.join(KEYS)}, f.datetime, f.target, f.row_id, " + all_features("panel"),
    "join_client": f"""
        SELECT p.*, CAST(p.datetime AS DATE) AS date, c.eic_count, c.installed_capacity, c.eic_count_mean_date,
               c.installed_capacity_mean_date, c.installed_capacity_log1p, c.installed_capacity_log1p_mean_date
        FROM panel p LEFT JOIN client_f c ON c.county = p.county AND c.is_business = p.is_business
         AND c.product_type = p.product_type AND c.date = CAST(p.datetime AS DATE)""",
    "join_prices": """
        SELECT p.*, CAST(p.datetime AS DATE) AS date, e.euros_per_mwh, g.lowest_price_per_mwh, g.highest_price_per_mwh,
               g.mean_price_per_mwh, g.range_price_per_mwh
        FROM panel p LEFT JOIN electricity_f e ON e.datetime = p.datetime LEFT JOIN gas_f g ON g.date = CAST(p.datetime AS DATE)""",
    "assemble_features": _assembled(_PLAIN),
    "scoring_features": f"SELECT f.{', f.'.join(KEYS)}, f.datetime, f.row_id, "
        + all_features("asked", {n: e for n, e in _PLAIN.items() if n != "date_order_kfold"}, _SIDE),
    "per_capacity_ratios": "SELECT p.county, p.is_business, p.product_type, p.is_consumption, p.datetime, "
        + ", ".join(f"p.target_lag_{d} / nullif(1 + c.installed_capacity, 0) AS target_lag_{d}_vs_installed" for d in OFFSETS) + ", "
        + ", ".join(f"p.target_lag_{d} / nullif(1 + c.eic_count, 0) AS target_lag_{d}_vs_eic" for d in OFFSETS)
        + """, c.installed_capacity / nullif(1 + c.eic_count, 0) AS installed_vs_eic
        FROM complete p LEFT JOIN client_f c ON c.county = p.county AND c.is_business = p.is_business
         AND c.product_type = p.product_type AND c.date = CAST(p.datetime AS DATE)""",
    "production_proxy": "SELECT c.county, c.is_business, c.product_type, c.date, " + ", ".join(
        [_proxy("c.installed_capacity", h) + f" AS production_capacity_temperature_{h}" for h in LEAD]
        + [f"round({_proxy('c.raw_log1p', h)}, 4) AS production_capacity_log1p_temperature_{h}" for h in LEAD]
    ) + " FROM client_f c LEFT JOIN forecast_f w ON w.date = c.date AND w.county = c.county",
    "fold_boundaries": "SELECT * FROM limits",
    "fold_labels": f"SELECT o_orderkey, step, {FOLD_INFO} AS fold_info FROM labels_rows",
    "fold_labels_dates": f"SELECT o_orderkey, step, {FOLD_INFO} AS fold_info FROM labels_dates",
    "fold_sizes": "SELECT fold, label, count(*) AS n_rows FROM ("
        + " UNION ALL ".join(f"SELECT {i} AS fold, f{i} AS label FROM labels_rows" for i in range(K)) + ") GROUP BY 1, 2",
    "fold_leakage": " UNION ALL ".join(
        f"""SELECT {i} AS fold, date FROM (
              SELECT CAST(l_shipdate AS DATE) AS date, f{i} AS label FROM labels_rows JOIN lineitem ON l_orderkey = o_orderkey)
            GROUP BY date HAVING bool_or(label = 't') AND bool_or(label = 'v')"""
        for i in range(K)
    ),
    "upsert_latest": """
        SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
                 ORDER BY l_linenumber DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS pos FROM lineitem)
        WHERE pos = 1""",
    "dedupe_keys": """
        SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_quantity, l_partkey
        FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_shipdate
                 ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC, l_partkey DESC) AS pos FROM lineitem)
        WHERE pos = 1""",
    "clip_nonnegative": "SELECT c_custkey, greatest(c_acctbal - 1000, 0.0) AS prediction FROM customer",
    "score_or_zero": """
        SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 <> 0 THEN o_totalprice ELSE 0.0 END AS target
        FROM orders""",
    "mae_by_fold": None,
    "learning_curve": "SELECT rnd AS round, round(average_error, 3) AS average_error, round(std_error, 3) AS std_error FROM curve_mean",
    "best_round": """
        SELECT rnd + 1 AS best_round, round(average_error, 3) AS best_score, round(std_error, 3) AS best_std
        FROM curve_mean ORDER BY average_error, rnd LIMIT 1""",
    "importance_mean": "SELECT * FROM imp_mean",
    "base_feature_match": f"""
        SELECT p_partkey, feature, {first_of('feature')} AS base_feature
        FROM (SELECT p_partkey, lower(p_type) || '_' || p_name AS feature FROM part)""",
    "importance_by_base": f"""
        SELECT base AS base_feature, round(avg(pos), 4) AS average_rank, round(avg(average), 4) AS average
        FROM (SELECT {first_of('feature')} AS base, average,
                     rank() OVER (ORDER BY average) + (count(*) OVER (PARTITION BY average) - 1) / 2 AS pos FROM imp_mean)
        WHERE base IS NOT NULL GROUP BY 1""",
    "average_rank": """
        SELECT l_partkey, quantity, rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2 AS rank
        FROM (SELECT l_partkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1)""",
    "top_features": "SELECT * FROM imp_mean ORDER BY average DESC, feature LIMIT 50",
}

SQL["stream_ingest"] = "SELECT event_id, ts, user_id, event_type, value FROM events"
SQL["stream_upsert"] = """
    SELECT event_id, ts, user_id, event_type, value
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS pos FROM events)
    WHERE pos = 1"""
SQL["stream_score"] = f"""
    SELECT row_id, CASE WHEN row_id % 4 <> 0 AND {ALL_THERE} THEN {LIST_STATS['target_mean_all_lag']} ELSE 0.0 END AS target
    FROM ({_features_from('asked')})"""

VIEWS["panel_steps"] = """
    SELECT *, CAST(dense_rank() OVER (ORDER BY CAST(datetime AS DATE)) - 1 AS INTEGER) AS step FROM panel"""
VIEWS["panel_limits"] = row_limits("panel_steps", 3)
VIEWS["panel_labels"] = labelled("panel_steps", "panel_limits", 3, 2)
SQL["training_table"] = f"""
    SELECT a.*, l.f0 || ', ' || l.f1 || ', ' || l.f2 AS fold_info FROM ({_assembled(_plain(FORECAST_VARIABLES, HISTORY_VARIABLES))}) a
    JOIN panel_labels l USING (row_id)"""
SQL["train_job"] = " UNION ALL ".join(
    f"""SELECT {i} AS fold, count(*) FILTER (f{i} = 't' AND target IS NOT NULL) AS n_train,
        count(*) FILTER (f{i} = 'v' AND target IS NOT NULL) AS n_valid, 1.0 AS importance, count(*) AS n_scored FROM panel_labels"""
    for i in range(3)
)
SQL["live_loop"] = """
    SELECT 'score' AS what, row_id AS id, CAST(1 AS DOUBLE) AS value FROM panel
    UNION ALL SELECT 'electricity', CAST(epoch(forecast_date) / 3600 AS BIGINT), CAST(CAST(euros_per_mwh AS FLOAT) AS DOUBLE) FROM electricity
    UNION ALL SELECT 'gas', date_diff('day', DATE '1970-01-01', forecast_date), CAST(CAST(lowest_price_per_mwh AS FLOAT) AS DOUBLE) FROM gas
    UNION ALL SELECT 'models', 1, 1"""
_TURN = "(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 5)"
SQL["stream_dedupe"] = f"""
    SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_id % 11 <> 3
    UNION ALL SELECT event_id, ts + INTERVAL 20 DAY, user_id, event_type, value FROM events WHERE event_id % 13 = 5 AND {_TURN} <= 1"""
SQL["stream_hourly_panel"] = f"""
    SELECT {KEY_LIST}, datetime, count(*) AS n_events, CAST(sum(cents) AS BIGINT) AS cents,
           (SELECT count(*) FROM events WHERE event_id % 11 = 3 AND {_TURN} + 2 <= 5) AS n_late
    FROM ev WHERE event_id % 11 <> 3
      AND datetime + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events WHERE event_id % 11 <> 3) - INTERVAL 2 DAY
    GROUP BY {KEY_LIST}, datetime"""


def _lines_upto(last, reader, where="true"):
    return f"""SELECT l_suppkey, l_shipdate, l_linenumber, l_orderkey, l_quantity, {reader} AS reader
        FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_shipdate
                 ORDER BY l_linenumber DESC, l_orderkey DESC, l_quantity DESC) AS pos FROM lineitem WHERE l_linenumber <= {last})
        WHERE pos = 1 AND {where}"""


SQL["store_versions"] = " UNION ALL ".join([
    _lines_upto(4, 0), _lines_upto(7, 1),
    _lines_upto(7, 2, "l_shipdate >= TIMESTAMP '1996-03-01' AND l_shipdate < TIMESTAMP '1996-05-01'"),
])

VIEWS["naive"] = """
    SELECT target, target_lag_2, CAST(dense_rank() OVER (ORDER BY CAST(datetime AS DATE)) - 1 AS INTEGER) AS step FROM complete"""
VIEWS["naive_limits"] = row_limits("naive", 3)
SQL["mae_by_fold"] = """
    SELECT fold, avg(abs(target - target_lag_2)) AS mae, count(target - target_lag_2) AS n_rows
    FROM naive JOIN naive_limits ON step BETWEEN valid_min AND valid_max GROUP BY 1"""


def _needed(sql):
    """Names of the views a statement uses, each after the views it uses itself."""
    import re

    order = []

    def visit(text):
        for name in VIEWS:
            if name not in order and re.search(rf"\b{name}\b(?!\s*\()", text):
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


# date columns leave both engines as timestamps at midnight
DATES = {
    "conform_types": ["l_shipdate"],
    "publish_alignment": ["day", "day_of_use"],
    **{
        name: ["date"]
        for name in (
            "history_publish_date", "calendar_features", "holiday_flag", "daily_stats", "client_features",
            "gas_features", "weather_pivot", "history_daily_mean", "hours_ago_rank", "exact_lag_daily",
            "join_client", "join_prices", "production_proxy", "fold_leakage",
        )
    },
}


def oracle(name):
    sql = SQL[name]
    if name in DATES:
        dates = ", ".join(f"CAST({c} AS TIMESTAMP) AS {c}" for c in DATES[name])
        sql = f"SELECT * REPLACE ({dates}) FROM ({sql})"
    names = _needed(sql)
    if not names:
        return sql.strip()
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in names) + "\n" + sql.strip()


def all_oracles():
    return {name: oracle(name) for name in SQL}
