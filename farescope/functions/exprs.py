"""Column expressions shared by the operators. Everything here stays on the JVM side."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The three identities of an offer. They differ on purpose and are never merged.
STORAGE_KEY = [
    "cycle_id", "airline", "origin", "destination", "flight_number", "departure", "cabin", "fare_basis",
]
DIFF_KEY = [
    "airline", "origin", "destination", "departure", "flight_number", "cabin", "fare_basis", "brand",
]
COMPARE_KEY = ["airline", "origin", "destination", "flight_number", "departure", "cabin", "brand"]
ROUTE = ["origin", "destination"]
SERIES_KEY = ["airline", "origin", "destination", "cabin"]

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

PENALTY_FEES = [
    "fare_change_fee_before_24h",
    "fare_change_fee_within_24h",
    "fare_change_fee_no_show",
    "fare_cancel_fee_before_24h",
    "fare_cancel_fee_within_24h",
    "fare_cancel_fee_no_show",
]


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def col(name: str | Column) -> Column:
    return name if isinstance(name, Column) else F.col(name)


def route_key(origin: str | Column = "origin", destination: str | Column = "destination") -> Column:
    return F.concat(col(origin), F.lit("-"), col(destination))


def clock(ts: str | Column) -> Column:
    """HH:mm text of a timestamp."""
    return F.date_format(col(ts), "HH:mm")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division giving NULL for a zero or missing denominator (ANSI mode would raise)."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def pct(numerator: Column, denominator: Column, digits: int | None = None) -> Column:
    value = ratio(numerator, denominator) * 100.0
    return value if digits is None else F.round(value, digits)


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clamp, leaving NULL as NULL (greatest/least alone would replace it)."""
    out = value
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(value.isNotNull(), out)


def blank_to_null(value: Column) -> Column:
    text = F.trim(value.cast("string"))
    return F.when(text != "", text)


def number_sql(x: str, data_type: str) -> str:
    """SQL text of the numeric reading of a column: numbers and booleans as they are, text when it parses."""
    if data_type == "string":
        plain = r"^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$"
        return f"CASE WHEN {x} RLIKE '{plain}' THEN try_cast(trim({x}) AS double) END"
    if data_type == "boolean":
        return f"CAST(CAST({x} AS int) AS double)"
    if data_type.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")):
        return f"CAST({x} AS double)"
    return "CAST(NULL AS double)"


def json_sql(x: str, data_type: str) -> str:
    """SQL text of a JSON scalar, NULL for NULL. Money becomes a JSON double, times ISO text."""
    if data_type.startswith("timestamp"):
        x = f"date_format({x}, \"yyyy-MM-dd'T'HH:mm:ss\")"
    elif data_type == "date":
        x = f"date_format({x}, 'yyyy-MM-dd')"
    elif data_type.startswith("decimal"):
        x = f"CAST({x} AS double)"
    return f"CASE WHEN {x} IS NOT NULL THEN regexp_replace(to_json(array({x})), '^\\\\[|\\\\]$', '') END"


def numeric_round(value: Column, digits: int) -> Column:
    """Round a double the way an exact numeric column rounds: binary noise does not decide a tie."""
    return F.round(value.cast("decimal(38,10)"), digits).cast("double")


def dtypes(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def iso_seconds(value: Column, data_type: str = "timestamp_ntz") -> Column:
    """Second-precision UTC ISO text; text that is no timestamp stays as it is, NULL becomes ''."""
    pattern = "yyyy-MM-dd'T'HH:mm:ss"
    if data_type != "string":
        return F.coalesce(F.date_format(value, pattern), F.lit(""))
    has_zone = value.rlike(r"\d(Z|[+-]\d{2}:?\d{2})$")
    local = value.try_cast("timestamp_ntz")
    zoned = F.convert_timezone(F.current_timezone(), F.lit("UTC"), value.try_cast("timestamp").cast("timestamp_ntz"))
    parsed = F.date_format(F.when(has_zone, zoned).otherwise(local), pattern)
    return F.coalesce(parsed, value, F.lit(""))


def identity_columns(df: DataFrame) -> dict[str, Column]:
    """Normalised diff identity: upper-case codes, UTC departure text, '' for missing parts."""
    types = dtypes(df)
    out = {f"k_{c}": F.upper(F.coalesce(F.col(c), F.lit(""))) for c in ("airline", "origin", "destination")}
    out["k_departure"] = iso_seconds(F.col("departure"), types["departure"])
    for c in ("flight_number", "cabin", "fare_basis", "brand"):
        out[f"k_{c}"] = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return out


def ewm_last(values: Column, alpha: float) -> Column:
    """Last exponentially weighted mean (no bias adjustment) of an ordered array.

    A gap decays the weight of the running mean, as gaps do in time-weighted smoothing.
    """
    state = F.aggregate(values, _ewm_start(), lambda s, x: _ewm_step(s, x, alpha))
    return state["v"]


def ewm_series(values: Column, alpha: float) -> Column:
    """Array of running exponentially weighted means, one per element."""
    start = F.struct(
        F.array().cast("array<double>").alias("out"), F.lit(None).cast("double").alias("v"), F.lit(1.0).alias("w")
    )

    def step(state: Column, x: Column) -> Column:
        nxt = _ewm_step(state, x, alpha)
        return F.struct(
            F.concat(state["out"], F.array(nxt["v"])).alias("out"), nxt["v"].alias("v"), nxt["w"].alias("w")
        )

    return F.aggregate(values, start, step)["out"]


def _ewm_start() -> Column:
    return F.struct(F.lit(None).cast("double").alias("v"), F.lit(1.0).alias("w"))


def _ewm_step(state: Column, x: Column, alpha: float) -> Column:
    weight = state["w"] * (1.0 - alpha)
    value = (
        F.when(state["v"].isNull(), x)
        .when(x.isNull(), state["v"])
        .otherwise((weight * state["v"] + alpha * x) / (weight + alpha))
    )
    next_weight = F.when(state["v"].isNotNull() & x.isNull(), weight).otherwise(F.lit(1.0))
    return F.struct(value.alias("v"), next_weight.alias("w"))


def classify_route(origin_country: Column, destination_country: Column) -> dict[str, Column]:
    known = origin_country.isNotNull() & destination_country.isNotNull()
    same = origin_country == destination_country
    return {
        "origin_country_code": origin_country,
        "destination_country_code": destination_country,
        "country_pair": F.concat(origin_country, F.lit("-"), destination_country),
        "route_type": F.when(known & same, "DOM").when(known, "INT").otherwise("UNK"),
        "domestic_country_code": F.when(known & same, origin_country),
        "is_cross_border": F.coalesce(known & ~same, F.lit(False)),
    }


def stops_label(stops: Column) -> Column:
    n = stops.try_cast("int")
    return (
        F.when(n.isNull(), "Unknown")
        .when(n <= 0, "Direct")
        .when(n == 1, "1 stop")
        .otherwise(F.concat(n.cast("string"), F.lit(" stops")))
    )


def weekday_order(label: Column) -> Column:
    """Monday = 0; anything that is no weekday name sorts last."""
    pos = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), label)
    return F.when(pos > 0, pos - 1).otherwise(F.lit(len(WEEKDAYS))).cast("int")


def time_sort_key(label: Column) -> Column:
    """Sort key of HH:mm text, blanks last."""
    text = F.trim(F.coalesce(label, F.lit("")))
    return F.when(text == "", F.lit("1|99:99")).otherwise(F.concat(F.lit("0|"), text))


def split_via(via: Column) -> Column:
    """Ordered distinct three-letter codes of a delimited list."""
    parts = F.split(F.replace(F.coalesce(via, F.lit("")), F.lit(","), F.lit("|")), r"\|")
    codes = F.transform(parts, lambda p: F.upper(F.trim(p)))
    return F.array_distinct(F.filter(codes, lambda p: p.rlike("^[A-Z]{3}$")))


def via_matches(via: Column, codes: Sequence[str]) -> Column:
    wanted = F.array(*[F.lit(c.strip().upper()) for c in codes])
    return F.arrays_overlap(F.split(F.coalesce(via, F.lit("")), r"\|"), wanted)


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


# Fixed display names of changed fields; other names are title-cased word by word.
FIELD_DISPLAY_NAMES = {
    "tax_amount": "Tax amount",
    "total_price_bdt": "Total price",
    "base_fare_amount": "Base fare",
    "ota_gross_fare": "Channel gross fare",
    "ota_discount_amount": "Channel discount amount",
    "ota_discount_pct": "Channel discount percent",
    "seat_available": "Seat available",
    "seat_capacity": "Seat capacity",
    "load_factor_pct": "Load factor",
    "booking_class": "Booking class",
    "penalty_rule_text": "Penalty text",
    "operating_airline": "Operating airline",
}

# Fixed list of technical fields a reader of the change list does not see.
HIDDEN_CHANGE_FIELDS = [
    "scraped_at",
    "source_endpoint",
    "raw_offer",
    "ota_name",
    "penalty_source",
    "fare_search_signature",
    "fare_search_reference",
    "fare_ref_num",
]


def field_display_name(name: Column) -> Column:
    text = F.trim(F.coalesce(name, F.lit("")))
    words = F.filter(F.split(text, "_"), lambda w: w != "")
    title = F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), " "
    )
    known = F.create_map(*[F.lit(x) for kv in FIELD_DISPLAY_NAMES.items() for x in kv])
    return F.when(text == "", F.lit("-")).otherwise(F.coalesce(F.try_element_at(known, text), title))


def top(df: DataFrame, n: int | None, *order: Column | str) -> DataFrame:
    """The first ``n`` rows in an order, or all rows, unordered, without ``n``."""
    return df if n is None else df.orderBy(*order).limit(n)


def first_rows(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int = 1,
               rank_name: str | None = None) -> DataFrame:
    """First ``n`` rows of every group in the given order.

    Filtering ``row_number`` by a constant lets Spark cut each group to ``n`` rows per task
    before the shuffle (window group limit), so one hot key never travels whole.
    """
    name = rank_name or "__rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= n)
    return kept if rank_name else kept.drop(name)


def salted_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str], salts: int = 32,
                     salt_from: Sequence[str] | None = None) -> DataFrame:
    """Left join for a left side in which one key value may hold a large share of the rows.

    The right side must have one row per key. It is repeated once per salt, so the rows of a
    hot key are spread over ``salts`` tasks whatever the runtime statistics say. The salt is a
    hash of row content, so a recomputed task produces the same rows.
    """
    source = list(salt_from or [n for n, t in left.dtypes if not t.startswith(("map", "variant"))])
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*source), F.lit(salts)).cast("int"))
    repeated = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, "__salt"], "left").drop("__salt")


def exact_medians(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Exact medians per key, one column per named value.

    Values are counted first, before and after the shuffle, so equal values travel once. The running
    count then passes one row per distinct value and spills; no group is held in memory.
    """
    items = F.array(*[F.struct(F.lit(n).alias("__m"), c.cast("double").alias("__v")) for n, c in values.items()])
    counts = df.select(*keys, F.inline(items)).where("__v is not null").groupBy(*keys, "__m", "__v").agg(
        F.count("*").alias("__n"))
    group = Window.partitionBy(*keys, "__m")
    ranks = counts.withColumns({
        "__upto": F.sum("__n").over(group.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)),
        "__all": F.sum("__n").over(group),
    })
    start = F.col("__upto") - F.col("__n")

    def at(rank: Column, name: str) -> Column:
        here = (F.col("__m") == name) & (start <= rank) & (rank < F.col("__upto"))
        return F.max(F.when(here, F.col("__v")))

    low, high = F.floor((F.col("__all") - 1) / 2), F.floor(F.col("__all") / 2)
    return ranks.groupBy(*keys).agg(*[((at(low, n) + at(high, n)) / 2).alias(n) for n in values])


def near_share(values: DataFrame, name: str, share: float, keys: Sequence[str] = (), accuracy: int = 1000) -> DataFrame:
    """Per key two values ``lo`` and ``hi`` around a share of the sorted values, and ``n``, the number of values.

    Quantile sketches are small and merge, so no task sees a whole key. The rank of the share lies between them, with
    a few thousandths of the rows, or all rows of a small key.
    """
    shares = [max(0.0, share - 4 / accuracy), min(1.0, share + 4 / accuracy)]
    sketch = F.percentile_approx(name, shares, accuracy)
    few = F.col("n") <= accuracy
    return values.groupBy(*keys).agg(
        sketch.alias("e"), F.count(name).alias("n"), F.min(name).alias("first"), F.max(name).alias("last")).select(
        *keys, F.when(few, F.col("first")).otherwise(F.col("e")[0]).alias("lo"), F.when(few, F.col("last")).otherwise(F.col("e")[1]).alias("hi"), "n")


def split_medians(df: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Exact medians for keys of which one may hold all rows; keys must not be NULL.

    A sketch brackets the median. Values below the bracket are only counted, so the running count passes the few
    distinct values inside it.
    """
    group = [*keys, "__m"]
    items = F.array(*[F.struct(F.lit(n).alias("__m"), c.cast("double").alias("__v")) for n, c in values.items()])
    rows = df.select(*keys, F.inline(items)).where("__v is not null")
    marked = rows.join(near_share(rows, "__v", 0.5, group), group)
    below = marked.groupBy(*group, "n").agg(F.count_if(F.col("__v") < F.col("lo")).alias("__below"))
    inside = marked.where("__v >= lo AND __v <= hi").groupBy(*group, "__v").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*group).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    ranks = inside.join(below, group).withColumn("__upto", F.col("__below") + upto)

    def at(rank: Column, name: str) -> Column:
        here = (F.col("__m") == name) & (F.col("__upto") - F.col("__n") <= rank) & (rank < F.col("__upto"))
        return F.max(F.when(here, F.col("__v")))

    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    return ranks.groupBy(*keys).agg(*[((at(low, n) + at(high, n)) / 2).alias(n) for n in values])


def bounded_broadcast(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast a reference table after checking its size; beyond the bound Spark picks the join."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def shuffled_once(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys with all their columns, for several joins on these keys in one query.

    Spark uses an exchange again only where it is the same in every use. Neither the pruning of columns nor a filter goes
    through the unfolding above it, so all uses share one. Select the columns that are needed before.
    """
    others = [c for c in df.columns if c not in keys]
    return df.repartition(*keys).select(*keys, F.inline_outer(F.array(F.struct(*others))))
