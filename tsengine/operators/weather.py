"""Weather: symbol dictionaries, class maps, reclassification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import states

#: The weather fields in use.
FIELDS = ("TemperatureC", "Dew PointC", "Humidity", "Events", "Conditions")

# The texts of each class of conditions and of events, and the names of the classes.
CONDITION_TEXTS = {
    8: ("Clear",),
    7: ("Partly Cloudy", "Scattered Clouds"),
    6: ("Mostly Cloudy", "Overcast"),
    5: ("Fog", "Mist", "Shallow Fog", "Patches of Fog", "Light Freezing Fog"),
    4: ("Drizzle", "Heavy Drizzle", "Light Drizzle", "Light Freezing Drizzle"),
    3: ("Rain", "Rain Showers", "Thunderstorms and Rain", "Heavy Rain", "Heavy Rain Showers", "Freezing Rain", "Light Freezing Rain", "Light Rain Showers", "Light Rain", "Light Thunderstorms and Rain"),
    2: ("Ice Pellets", "Ice Crystals", "Light Ice Crystals", "Light Ice Pellets"),
    1: ("Snow", "Snow Showers", "Light Snow", "Light Snow Grains", "Light Snow Showers"),
    0: ("Unknown",),
}
CONDITION_NAMES = {"Clear": 8, "Cloudy": 7, "Overcast": 6, "Fog": 5, "Drizzle": 4, "Rain": 3, "Ice": 2, "Snow": 1, "Unknown": 0}
OLDER_CONDITION_TEXTS = {
    5: ("Clear",),
    4: ("Partly Cloudy", "Scattered Clouds"),
    3: ("Mostly Cloudy", "Overcast"),
    2: ("Light Drizzle", "Mist", "Shallow Fog", "Patches of Fog", "Light Snow", "Light Freezing Rain", "Light Rain Showers", "Light Freezing Fog", "Light Snow Showers", "Light Rain"),
    1: ("Rain", "Rain Showers", "Thunderstorms and Rain", "Heavy Rain", "Heavy Rain Showers", "Drizzle", "Heavy Drizzle", "Fog"),
    0: ("Unknown",),
}
EVENT_TEXTS = {0: ("",), 1: ("Rain-Snow", "Snow", "Fog-Snow"), 2: ("Rain", "Thunderstorm", "Rain-Thunderstorm"), 3: ("Fog", "Fog-Rain")}
EVENT_NAMES = {"NoEvent": 0, "Snow": 1, "Rain": 2, "Fog": 3}

CONDITION_CLASSES = {text: k for k, texts in CONDITION_TEXTS.items() for text in texts}
OLDER_CONDITION_CLASSES = {text: k for k, texts in OLDER_CONDITION_TEXTS.items() for text in texts}
EVENT_CLASSES = {text: k for k, texts in EVENT_TEXTS.items() for text in texts}


def symbol_codes(df: DataFrame, name: str, order: str) -> DataFrame:
    """(symbol, code): codes from 1 by first appearance in `order`; the empty text and null are 0."""
    symbol = F.coalesce(F.col(name).cast("string"), F.lit(""))
    first = df.groupBy(symbol.alias("symbol")).agg(F.min(order).alias("_first"))
    # one row a symbol: a dictionary, small whatever the table's size
    w = Window.orderBy(F.col("symbol") != "", "_first", "symbol")
    offset = F.when(F.max((F.col("symbol") == "").cast("int")).over(Window.partitionBy()) > 0, 1).otherwise(0)
    return first.withColumn("code", F.when(F.col("symbol") == "", 0).otherwise(F.row_number().over(w) - offset)).select("symbol", "code")


def encode_symbols(df: DataFrame, name: str, codes: DataFrame) -> DataFrame:
    """`df` with <name>_code; symbols without code are null."""
    c = codes.select(F.col("symbol").alias("_s"), F.col("code").alias(f"{name}_code"))
    return df.join(c, F.coalesce(F.col(name).cast("string"), F.lit("")) == F.col("_s"), "left").drop("_s")


def classify(df: DataFrame, name: str, classes: dict[str, int], code: str | None = None) -> DataFrame:
    """`df` with <name>_class; unknown texts keep their code (or are null without one)."""
    table = F.create_map(*[x for k, v in classes.items() for x in (F.lit(k), F.lit(v))])
    known = F.try_element_at(table, F.coalesce(F.col(name), F.lit("")))
    return df.withColumn(f"{name}_class", F.coalesce(known, F.col(code)) if code else known)


def unclassified(df: DataFrame, name: str, classes: dict[str, int]) -> DataFrame:
    """Texts that the class map doesn't cover."""
    return df.select(F.coalesce(F.col(name), F.lit("")).alias(name)).distinct().filter(~F.col(name).isin(list(classes)))


def reclassify_numbers(df: DataFrame, fields: list[str], order: list[str], most: int = 30) -> DataFrame:
    """`df` with each numeric field replaced by the rounded centre of its state."""
    out = df
    for f in fields:
        one = out.withColumns({"_key": F.lit(f), "_v": F.col(f"`{f}`").cast("double")})
        found = states.value_states(one, ["_key"], "_v", most).select(F.col("value").alias("_v"), F.round("centre").cast("long").alias("_c"))
        out = one.join(found, "_v", "left").withColumn(f, F.col("_c")).select(*df.columns)
    return out


def long_weather(wide: DataFrame, time: str, numbers: list[str], symbols: list[str]) -> DataFrame:
    """(t, name, num_value, sym_value): one row a field; 'N/A' is missing."""
    from tsengine.model import micros

    clean = lambda c: F.when(F.col(f"`{c}`").cast("string") != "N/A", F.col(f"`{c}`").cast("string"))
    rows = [F.struct(F.lit(c).alias("name"), F.expr(f"try_cast(nullif(cast(`{c}` as string), 'N/A') as double)").alias("num_value"), F.lit(None).cast("string").alias("sym_value")) for c in numbers]
    rows += [F.struct(F.lit(c).alias("name"), F.lit(None).cast("double").alias("num_value"), clean(c).alias("sym_value")) for c in symbols]
    return wide.select(micros(time).alias("t"), F.explode(F.array(*rows)).alias("x")).select("t", "x.*")
