"""Feature tables: one builder per source, and their assembly into one row per
series and hour."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.calendar import calendar, cyclic, date_index, is_holiday
from panelspark.operators import lags as L
from panelspark.operators import pivot, ratios
from panelspark.operators.aggregates import STATISTICS, marginals, mean_as, row_index, window_mean
from panelspark.operators.align import (
    fits_broadcast,
    hot_keys,
    left_join_placed,
    left_join_unique,
    publish_shift,
    publish_shift_by_hour,
    station_to_county,
)
from panelspark.sources.schema import (
    FORECAST_VARIABLES,
    HISTORY_VARIABLES,
    HISTORY_WHOLE_NUMBERS,
    LEAD_HOURS,
    SERIES_KEYS,
)

CLIENT_KEYS = ["date", "product_type", "county", "is_business"]
DAY_STATS = [f"{s}_day_target" for s in ("avg", "sum", "min", "max", "std")]
FORECAST = "__forecast"
MARGINAL_STATS = [
    f"{s}_{k}_target" for k in SERIES_KEYS for s in ("avg", "sum", "min", "max", "std")
]


def client_features(clients: DataFrame) -> DataFrame:
    """Customer counts and capacity, usable two days later, with group means."""
    capacity = F.col("installed_capacity").cast("double")
    ready = clients.withColumn("installed_capacity", capacity)
    means = {
        "eic_count_mean_date": F.avg("eic_count").cast("int"),
        "installed_capacity_mean_date": F.avg("installed_capacity"),
        "installed_capacity_log1p_mean_date": F.avg(F.log1p("installed_capacity")),
    }
    return window_mean(ready, CLIENT_KEYS, means).select(
        F.date_add("date", 2).alias("date"),
        *[c for c in clients.columns if c != "date"],
        "eic_count_mean_date",
        "installed_capacity_mean_date",
        F.log1p("installed_capacity").alias("installed_capacity_log1p"),
        "installed_capacity_log1p_mean_date",
    )


def gas_features(gas: DataFrame) -> DataFrame:
    low = F.col("lowest_price_per_mwh").cast("double")
    high = F.col("highest_price_per_mwh").cast("double")
    return gas.select(
        *[c for c in gas.columns if c not in ("forecast_date", "lowest_price_per_mwh", "highest_price_per_mwh")],
        F.date_add(F.to_date("forecast_date"), 1).alias("date"),
        low.alias("lowest_price_per_mwh"),
        high.alias("highest_price_per_mwh"),
        ((low + high) / 2).alias("mean_price_per_mwh"),
        (high - low).alias("range_price_per_mwh"),
    )


def electricity_features(electricity: DataFrame) -> DataFrame:
    return publish_shift(electricity, "forecast_date", 1, "datetime").select(
        "datetime",
        *[
            F.col(c).cast("double").alias(c) if c == "euros_per_mwh" else c
            for c in electricity.columns
            if c != "forecast_date"
        ],
    )


def _located_forecast(weather: DataFrame, stations: DataFrame, variables: list[str], hours: tuple[int, int]) -> DataFrame:
    lo, hi = hours
    band = weather.filter(F.col("hours_ahead").between(lo, hi))
    usable = publish_shift(band, "origin_datetime", 1, "date", to_date=True)
    return station_to_county(usable, stations).select(
        "county", "date", "hours_ahead", *[F.col(v).cast("double").alias(v) for v in variables]
    )


def forecast_weather_features(
    weather: DataFrame,
    stations: DataFrame,
    variables: list[str] = FORECAST_VARIABLES,
    hours: tuple[int, int] = LEAD_HOURS,
) -> DataFrame:
    """Statistics over the stations of a county per lead hour, usable the day
    after the forecast was made."""
    located = _located_forecast(weather, stations, variables, hours)
    return pivot.pivot_stats(located, ["county", "date"], "hours_ahead", list(range(hours[0], hours[1] + 1)), variables)


def packed_forecast(
    weather: DataFrame,
    stations: DataFrame,
    variables: list[str] = FORECAST_VARIABLES,
    hours: tuple[int, int] = LEAD_HOURS,
) -> DataFrame:
    """``forecast_weather_features`` with each row's lead hours still in one column; see ``unpack_features``."""
    located = _located_forecast(weather, stations, variables, hours)
    return pivot.pack_stats(located, ["county", "date"], "hours_ahead", variables, out=FORECAST)


def located_history(history: DataFrame, stations: DataFrame) -> DataFrame:
    """Weather history with the date of use and the county."""
    return station_to_county(publish_shift_by_hour(history, "datetime", "date"), stations)


def hours_ago(located: DataFrame) -> DataFrame:
    """Position of each hour before the moment of use, per station and date."""
    return row_index(
        located, ["latitude", "longitude", "date"], [F.col("datetime").desc()], "hours_ago"
    )


def historical_weather_features(
    history: DataFrame, stations: DataFrame, variables: list[str] = HISTORY_VARIABLES
) -> DataFrame:
    """Daily means per county; whole-number variables keep whole means."""
    located = located_history(history, stations)
    wanted = {v: HISTORY_WHOLE_NUMBERS.get(v) for v in variables}
    doubled = located.select(
        "county", "date", *[F.col(v).cast("double").alias(v) for v in variables]
    )
    return mean_as(doubled, ["county", "date"], wanted, suffix="_hours_ago_mean")


def main_features(
    main: DataFrame, training: bool = True, among: DataFrame | None = None
) -> DataFrame:
    """Calendar columns of the rows themselves; the date index only in training,
    numbered over the ``datetime`` of ``among`` if given."""
    rows = cyclic(calendar(main, "datetime"))
    if training:
        rows = date_index(rows, "datetime", among=among)
    return rows.withColumn("holiday", is_holiday(F.col("date")))


def with_marginals(target: DataFrame) -> DataFrame:
    """The panel with its leave-one-key-out statistics at each instant.

    All series of an instant meet in one exchange, and each statistic is a window
    inside that partition. Where an instant has more series than a task should hold,
    the statistics are aggregated apart, with partial reduction, and joined instead;
    a group with that many rows is then spread over several tasks.
    """
    total = target.count()
    crowded = hot_keys(target, ["datetime"], total=total)
    if crowded is None or crowded.isEmpty():
        windows = [
            f"{fn}(target) OVER (PARTITION BY datetime, {', '.join(k for k in SERIES_KEYS if k != key)}) AS {s}_{key}_target"
            for key in SERIES_KEYS for s, fn in STATISTICS.items()
        ]
        return target.repartition("datetime").selectExpr("*", *windows)
    panel = target
    for key, over in marginals(target, SERIES_KEYS, "datetime", "target").items():
        on = [*[k for k in SERIES_KEYS if k != key], "datetime"]
        panel = left_join_unique(panel, over, on, hot=hot_keys(target, on, total=total))
    return panel


def target_features(target: DataFrame, n_lags: int = 14, at: DataFrame | None = None) -> DataFrame:
    """All lag features of the target, on the rows of ``target`` or of ``at``."""
    own = (target if at is None else at).columns
    return lag_features(with_marginals(target), own, n_lags, at)


def lag_features(
    enriched: DataFrame, own: list[str], n_lags: int = 14, at: DataFrame | None = None
) -> DataFrame:
    """Lag features from a panel that carries its leave-one-key-out statistics.

    The rows keep the columns ``own``. If any of the lags 2..n of the target is
    missing, all lag features of that row are null. Every statistic is looked up
    on the series' own earlier row, so a single shuffle by series and time
    block serves all of them.
    """
    return unpack_lags(packed_lag_features(enriched, own, n_lags, at), n_lags)


def packed_lag_features(
    enriched: DataFrame, own: list[str], n_lags: int = 14, at: DataFrame | None = None, near: list[str] | None = None
) -> DataFrame:
    """``lag_features`` with the looked-up statistics of each day still in one column.

    Steps that follow copy 13 packs instead of 325 columns; see ``unpack_lags``. For ``near`` see ``lag_structs``.
    """
    offsets = list(range(2, n_lags + 1))
    looked_up = ["target", *MARGINAL_STATS]
    days = {f"{s}_day_target": f"{fn}({{target}})" for s, fn in STATISTICS.items()}
    carried = enriched.select(*dict.fromkeys([*SERIES_KEYS, "datetime", *own, *looked_up])) if at is None else enriched
    packed = L.lag_structs(carried, SERIES_KEYS, "datetime", looked_up, offsets, at=at, daily=days, near=near)
    own = [*own, L.BLOCK] if near else own

    present = " AND ".join(f"{L.lagged(d, 'target')} IS NOT NULL" for d in offsets)
    # the statistics stay packed while the narrow target columns are worked on
    packs = [f"__lag_{d}" for d in offsets]
    whole = packed.selectExpr(*L.quoted(own), f"({present}) AS __present", *packs)
    blanked = whole.selectExpr(*L.quoted(own), *[f"IF(__present, {p}, NULL) AS {p}" for p in packs])
    target_lags = L.logged_lags(
        blanked.selectExpr("*", *[f"{L.lagged(d, 'target')} AS target_lag_{d}" for d in offsets]), n_lags
    )
    return L.lag_ratios(L.lag_list_stats(L.lag_diffs(target_lags, n_lags), n_lags))


def _unpacked_lags(n_lags: int) -> list[str]:
    return [f"{L.lagged(d, c)} AS `{c}_lag_{d}`" for d in range(2, n_lags + 1) for c in DAY_STATS + MARGINAL_STATS]


def unpack_lags(df: DataFrame, n_lags: int) -> DataFrame:
    """Packed statistics of earlier days as columns of their own."""
    packs = [f"__lag_{d}" for d in range(2, n_lags + 1)]
    return df.selectExpr(*L.quoted([c for c in df.columns if c not in packs]), *_unpacked_lags(n_lags))


def unpack_features(
    df: DataFrame, n_lags: int, variables: list[str] = FORECAST_VARIABLES, hours: tuple[int, int] = LEAD_HOURS
) -> DataFrame:
    """Packed lags and lead hours as columns, with the ratios of both, in one projection of the wide row."""
    leads = list(range(hours[0], hours[1] + 1))
    packs = [FORECAST, *[f"__lag_{d}" for d in range(2, n_lags + 1)]]
    return pivot.spread(df, leads, FORECAST).selectExpr(
        *L.quoted([c for c in df.columns if c not in packs]),
        *pivot.columns(leads, variables, out=FORECAST),
        *_unpacked_lags(n_lags),
        *ratios.production_proxy(
            leads,
            pivot.picked("surface_solar_radiation_downwards", "mean", "{h}", FORECAST),
            pivot.picked("temperature", "mean", "{h}", FORECAST),
        ),
        *ratios.per_capacity(n_lags),
    )


def with_side_tables(
    rows: DataFrame, client: DataFrame, electricity: DataFrame, gas: DataFrame, history: DataFrame,
    panel: DataFrame | None = None,
) -> DataFrame:
    """The narrow side tables joined to rows that have ``datetime`` and ``date``.

    Meant for rows before their lags are spread out, while moving one is cheap.
    """
    out = left_join_unique(rows, client, ["county", "is_business", "product_type", "date"])
    out = left_join_unique(out, electricity, ["datetime"])
    out = left_join_unique(out, gas, ["date"])
    return with_weather(out, history, panel)


def placed_near(weather: DataFrame, panel: DataFrame, n_lags: int, packed_bytes: int | None = None) -> list[str] | None:
    """The keys to keep the lagged rows by, so that ``with_weather`` need not move them.

    None if the weather is small enough to be broadcast, or if a county has more rows of
    ``panel`` in a block than a task should hold; ``with_weather`` then spreads them.
    """
    if fits_broadcast(weather, unjudged=packed_bytes):
        return None
    block = L.day_block(F.to_date("datetime"), range(2, n_lags + 1)).alias(L.BLOCK)
    crowded = hot_keys(panel.select("county", block), ["county", L.BLOCK])
    return ["county"] if crowded is None or crowded.isEmpty() else None


def with_weather(
    rows: DataFrame, weather: DataFrame, panel: DataFrame | None = None, packed_bytes: int | None = None, n_lags: int = 14
) -> DataFrame:
    """A table of one row per date and county joined to ``rows``.

    Date and county together are the coarsest join key. A weather table counted
    to be small is broadcast and the rows stay where they are; so do rows that
    their lags' exchange has placed by county and block (``n_lags`` says which days
    make a block), whose column of the block is dropped. Otherwise both sides are shuffled, and a date and county with more rows than a task should
    hold is spread over several. ``panel`` are the rows as they were before any
    join: it is cheaper to count dates and counties there. ``packed_bytes`` is the size of
    a row's packed column, where it has one.
    """
    on = ["date", "county"]
    if fits_broadcast(weather, unjudged=packed_bytes):
        return left_join_unique(rows, F.broadcast(weather), on)
    if L.BLOCK in rows.columns:
        placed = weather.withColumn(L.BLOCK, L.day_block(F.col("date"), range(2, n_lags + 1)))
        joined = left_join_placed(rows, placed, ["county", L.BLOCK], "date")
        return joined.select(*on, *[F.col(f"`{c}`") for c in joined.columns if c not in (*on, L.BLOCK)])
    counted = rows if panel is None else panel.withColumn("date", F.to_date("datetime"))
    return left_join_unique(rows, weather, on, hot=hot_keys(counted.select(*on), on))
