"""Column functions: names, times, identifiers, metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of calendar fields and states.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
STATES = {-1: "Low Peak", 0: "No Peak", 1: "High Peak"}
_UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_name(name: str | Column) -> Column:
    """A sensor's name as an identifier: . / - and blanks become _, and a leading digit gets a_; of a uuid only - changes."""
    n = _c(name)
    plain = F.translate(n, "./- ", "____")
    return F.when(n.rlike(_UUID), F.translate(n, "-", "_")).when(plain.rlike("^[0-9]"), F.concat(F.lit("a_"), plain)).otherwise(plain)


def full_name(building: str | Column, name: str | Column) -> Column:
    return F.upper(F.concat_ws("_", _c(building), _c(name)))


def table_name(path: str | Column, prefix: str = "T_") -> Column:
    """A stream path as a table name: / - and blanks become _, upper case, with a prefix."""
    return F.upper(F.concat(F.lit(prefix), F.translate(_c(path), "/- ", "___")))


def calendar(t: str | Column, site_tz: str = "UTC") -> dict[str, Column]:
    """month 0-11, weekday 0-6 from Monday, hour of a time in microseconds, on the site's clock."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(site_tz), F.timestamp_add("MICROSECOND", _c(t), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))
    return {"month": F.month(local) - 1, "weekday": F.weekday(local), "hour": F.hour(local)}


def calendar_tuple(t: str | Column) -> Column:
    """struct(sec, min, hour, weekday, mday, month) of a time in microseconds, in UTC."""
    at = F.timestamp_add("MICROSECOND", _c(t), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.struct(F.second(at).alias("sec"), F.minute(at).alias("min"), F.hour(at).alias("hour"), F.weekday(at).alias("weekday"), F.dayofmonth(at).alias("mday"), F.month(at).alias("month"))


def month_name(m: str | Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), _c(m).cast("int") + 1)


def weekday_name(w: str | Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), _c(w).cast("int") + 1)


def state_name(s: str | Column) -> Column:
    return F.coalesce(*[F.when(_c(s) == k, F.lit(v)) for k, v in STATES.items()], _c(s).cast("string"))


def tick_label(field: str | Column, state: str | Column) -> Column:
    """What a state of a field is called: month, weekday, hour, degrees, percent or peak."""
    f, s = _c(field), _c(state)
    named = F.when(f == "month", month_name(s)).when(f == "weekday", weekday_name(s)).when(f == "hour", F.concat(s.cast("string"), F.lit(":00")))
    return named.when(f.isin("TemperatureC", "Dew PointC"), F.concat(s.cast("string"), F.lit(" C"))).when(f == "Humidity", F.concat(s.cast("string"), F.lit(" %"))).otherwise(state_name(s))


def parse_time(text: str | Column) -> Column:
    """Microseconds of 'yyyy-MM-dd HH:mm:ss[.f]'; the digits after the point count as microseconds as they stand (.5 is 5)."""
    s = _c(text)
    whole = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.substring_index(s, ".", 1).try_cast("timestamp_ntz"))
    return whole + F.when(F.instr(s, ".") > 0, F.substring_index(s, ".", -1).try_cast("long")).otherwise(F.lit(0))


def parse_nanoseconds(text: str | Column) -> Column:
    """Nanoseconds since 1970 of an ISO time with up to nine decimals; a bare date is its midnight."""
    s = F.translate(_c(text), "T", " ")
    whole = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.substring_index(s, ".", 1).try_cast("timestamp_ntz"))
    decimals = F.when(F.instr(s, ".") > 0, F.rpad(F.substring_index(s, ".", -1), 9, "0").try_cast("long")).otherwise(F.lit(0))
    return whole * 1_000_000_000 + decimals


def uuid_bytes(uuid: str | Column) -> Column:
    return F.unhex(F.translate(_c(uuid), "-", ""))


def uuid_text(b: str | Column) -> Column:
    h = F.lower(F.hex(_c(b)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def readings_from_json(text: str | Column) -> Column:
    """array<struct<uuid, t, value>> of '[{"uuid": ..., "Readings": [[ms, value], ...]}]'; readings without value are left out."""
    streams = F.from_json(_c(text), "array<struct<uuid:string,Readings:array<array<double>>>>")
    each = F.transform(streams, lambda s: F.transform(F.filter(s["Readings"], lambda r: F.get(r, F.lit(1)).isNotNull()), lambda r: F.struct(s["uuid"].alias("uuid"), (F.get(r, F.lit(0)).cast("long") * 1000).alias("t"), F.get(r, F.lit(1)).alias("value"))))
    return F.flatten(each)


# Where each metadata field is found. Of a field's rules the first whose object is there decides: it takes the
# first of its keys that has a value, or '-'.
METADATA_RULES = {
    "uuid": [("$", ["uuid"])],
    "unit": [("$.Properties", ["UnitofMeasure"])],
    "path": [("$", ["Path"])],
    "sensor_type": [("$.Metadata.Instrument", ["SensorType"]), ("$.Metadata", ["SourceName"])],
    "node_id": [("$.Metadata.Instrument", ["PartNumber"]), ("$.Metadata.Extra", ["MeterName"])],
    "serial": [("$.Metadata", ["SerialNumber"])],
    "building": [("$.Metadata.Location", ["Building"])],
    "floor": [("$.Metadata.Location", ["Floor"]), ("$.Metadata", ["PointName"])],
    "room": [("$.Metadata.Location", ["RoomNumber"]), ("$.Metadata.Extra", ["ServiceArea"]), ("$", ["Description"])],
    "installed": [("$.Metadata.Location", ["Height"]), ("$.Metadata.Extra", ["System", "Operator"])],
    "additional": [("$.Metadata.Extra", ["VAV", "ServiceDetail", "Type"])],
}
FLOOR_SUFFIX = "FL"


def metadata(text: str | Column) -> dict[str, Column]:
    """The eleven metadata fields of a sensor's JSON text, '-' where none is given. A floor of a location gets FL."""
    found = {}
    for name, rules in METADATA_RULES.items():
        value = None
        for parent, keys in rules:
            own = F.coalesce(*[F.get_json_object(_c(text), f"{parent}.{k}") for k in keys])
            if name == "floor" and parent.endswith("Location"):
                own = F.concat(own, F.lit(FLOOR_SUFFIX))
            there = F.get_json_object(_c(text), parent).isNotNull()
            value = F.when(there, own) if value is None else value.when(there, own)
        found[name] = F.coalesce(value, F.lit("-"))
    return found
