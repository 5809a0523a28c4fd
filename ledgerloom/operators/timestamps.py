"""Dates and times typed in many forms as one day or UTC instant (problem 5).

Every accepted form is one alternative of a single regular expression with named
groups.  A text goes through it once; the replacement writes the groups out in a
fixed order, and all else is integer arithmetic on them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import bounded

MARK = "\u0001"
#: Months by the first letters of their English, German and French names, accents removed.
MONTHS = {
    1: ("jan",),
    2: ("feb", "fev"),
    3: ("mar", "mrz", "mae"),
    4: ("apr", "avr"),
    5: ("mai", "may"),
    6: ("jun", "juin"),
    7: ("jul", "juil"),
    8: ("aug", "aou"),
    9: ("sep",),
    10: ("oct", "okt"),
    11: ("nov",),
    12: ("dec", "dez"),
}
#: Minutes east of UTC of the zone names in use.
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "GST": 240, "IST": 330, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "AEST": 600, "ACDT": 630, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
_SPACE = r"[\s  ]"
_OFFSET = r"[+-]\d{1,2}:?\d{2}"
_ZONE = "|".join(sorted(ZONES, key=len, reverse=True))


def _clock(n: int) -> str:
    return rf"(?<h{n}>\d{{1,2}}):(?<n{n}>\d{{2}})(?::(?<s{n}>\d{{2}})(?:[.,]\d+)?)?{_SPACE}*(?<z{n}>{_ZONE})?(?<o{n}>{_OFFSET})?"


#: The accepted forms of a date, one alternative each.
DATE_FORMS = (
    rf"(?<y1>\d{{4}})-(?<m1>\d{{1,2}})-(?<d1>\d{{1,2}})(?:(?:T|{_SPACE}+){_clock(1)})?",
    rf"(?<y2>\d{{4}})(?:[./]|{_SPACE}*年{_SPACE}*)(?<m2>\d{{1,2}})(?:[./]|{_SPACE}*月{_SPACE}*)(?<d2>\d{{1,2}}){_SPACE}*日?(?:{_SPACE}+{_clock(2)})?",
    r"(?<y3>\d{4})(?<m3>\d{2})(?<d3>\d{2})",
    rf"(?<a>\d{{1,2}})[-./](?<b>\d{{1,2}})[-./](?<c>\d{{4}}|\d{{2}})(?:{_SPACE}+{_clock(3)})?",
    r"(?<serial>\d{5})",
    r"(?<sec>\d{10})",
    r"(?<ms>\d{13})",
    r"(?<wy>\d{4})-?W(?<ww>\d{2})-?(?<wd>[1-7])",
    r"(?<oy>\d{4})-(?<od>\d{3})",
    rf"(?:le{_SPACE}+)?(?:\p{{L}}+\.?,?{_SPACE}+)?(?<d4>\d{{1,2}})(?:st|nd|rd|th|er|\.)?[-\s ]+(?:of{_SPACE}+|de{_SPACE}+)?(?<w4>\p{{L}}{{3,}})\.?,?[-\s ]+['’]?(?<y4>\d{{4}}|\d{{2}})(?:,?{_SPACE}+{_clock(4)})?",
    rf"(?:\p{{L}}+\.?,{_SPACE}+)?(?<w5>\p{{L}}{{3,}})\.?{_SPACE}+(?<d5>\d{{1,2}})(?:st|nd|rd|th)?,?{_SPACE}+['’]?(?<y5>\d{{4}}|\d{{2}})(?:,?{_SPACE}+{_clock(5)})?",
)
#: The accepted forms of a time of day.
TIME_FORMS = (
    rf"(?<h1>\d{{1,2}})[:.](?<n1>\d{{2}})(?:[:.](?<s1>\d{{2}})(?:[.,]\d+)?)?{_SPACE}*(?<p1>[ap]\.?{_SPACE}*m\.?)?{_SPACE}*(?:Uhr)?{_SPACE}*(?<z1>{_ZONE})?{_SPACE}*(?<o1>{_OFFSET})?",
    rf"(?<h2>\d{{1,2}}){_SPACE}*h{_SPACE}*(?<n2>\d{{2}})(?:{_SPACE}*(?:m|min){_SPACE}*(?<s2>\d{{2}}){_SPACE}*s?)?{_SPACE}*(?<z2>{_ZONE})?(?<o2>{_OFFSET})?",
    rf"(?<h3>\d{{2}})(?<n3>\d{{2}})(?<s3>\d{{2}})?{_SPACE}*(?<z3>{_ZONE})?(?<o3>{_OFFSET})?",
    rf"(?<h4>\d{{1,2}}){_SPACE}*(?<p4>[ap]\.?{_SPACE}*m\.?|Uhr|h){_SPACE}*(?<z4>{_ZONE})?(?<o4>{_OFFSET})?",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _parts(text: Column, forms: tuple[str, ...], fields: dict[str, tuple[str, ...]]) -> Column:
    """The groups of the one alternative that matches; an array of texts, null without a match."""
    pattern = rf"(?iu)^{_SPACE}*(?:" + "|".join(forms) + rf"){_SPACE}*$"
    out = MARK + MARK.join("".join("${" + g + "}" for g in groups) for groups in fields.values())
    return let(F.split(F.regexp_replace(text, pattern, out), MARK), lambda x: F.when(F.size(x) == len(fields) + 1, x))


def _field(parts: Column, fields: dict[str, tuple[str, ...]], name: str) -> Column:
    return F.nullif(F.get(parts, F.lit(1 + list(fields).index(name))), F.lit(""))


DATE_FIELDS = {
    "y": ("y1", "y2", "y3", "y4", "y5"), "m": ("m1", "m2", "m3"), "d": ("d1", "d2", "d3", "d4", "d5"), "word": ("w4", "w5"), "a": ("a",), "b": ("b",), "c": ("c",), "serial": ("serial",), "sec": ("sec",), "ms": ("ms",),
    "wy": ("wy",), "ww": ("ww",), "wd": ("wd",), "oy": ("oy",), "od": ("od",), "h": ("h1", "h2", "h3", "h4", "h5"), "n": ("n1", "n2", "n3", "n4", "n5"), "s": ("s1", "s2", "s3", "s4", "s5"), "z": ("z1", "z2", "z3", "z4", "z5"), "o": ("o1", "o2", "o3", "o4", "o5"),
}
TIME_FIELDS = {"h": ("h1", "h2", "h3", "h4"), "n": ("n1", "n2", "n3"), "s": ("s1", "s2", "s3"), "p": ("p1", "p4"), "z": ("z1", "z2", "z3", "z4"), "o": ("o1", "o2", "o3", "o4")}


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a day of the Gregorian calendar, in integers."""
    shifted = y - (m <= 2).cast("int")
    era = F.floor(shifted / 400)
    of_era = shifted - era * 400
    of_year = F.floor((((m + 9) % 12) * 153 + 2) / 5) + d - 1
    return (era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468).cast("int")


def _leap(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def _month_days(y: Column, m: Column) -> Column:
    return F.when(m == 2, F.when(_leap(y), 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _lookup(table: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def _month(word: Column) -> Column:
    known = {start: number for number, starts in MONTHS.items() for start in starts}
    return let(F.translate(F.lower(word), "äéèûàü", "aeeuau"), lambda w: F.coalesce(_lookup(known, F.substring(w, 1, 4)), _lookup(known, F.substring(w, 1, 3))))


def _offset(zone: Column, offset: Column) -> Column:
    """Seconds east of UTC, null if the text names no zone."""

    def minutes(digits: Column) -> Column:
        return F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int")

    told = F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1) * minutes(F.lpad(F.regexp_replace(F.substring(offset, 2, 5), ":", ""), 4, "0"))
    return F.coalesce(told, _lookup(ZONES, F.upper(zone))) * 60


def _seconds(h: Column, n: Column, s: Column) -> Column:
    """Second of the day, null if there is no such time."""
    parts = F.struct(h.cast("int").alias("h"), F.coalesce(n.cast("int"), F.lit(0)).alias("n"), F.coalesce(s.cast("int"), F.lit(0)).alias("s"))
    return let(parts, lambda t: F.when((t["h"] <= 23) & (t["n"] <= 59) & (t["s"] <= 59), t["h"] * 3600 + t["n"] * 60 + t["s"]))


def _civil(y: Column, m: Column, d: Column) -> Column:
    return F.when((y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= _month_days(y, m)), days_from_civil(y, m, d))


def _ordinal(y: Column, d: Column) -> Column:
    return F.when((d >= 1) & (d <= F.when(_leap(y), 366).otherwise(365)), days_from_civil(y, F.lit(1), F.lit(1)) + d - 1)


def _iso_week(y: Column, week: Column, weekday: Column) -> Column:
    """Day of an ISO week; null if its Thursday falls into the next year."""
    fourth = let(days_from_civil(y, F.lit(1), F.lit(4)), lambda x: x - (x + 3) % 7)
    return let(fourth + (week - 1) * 7, lambda monday: F.when((week >= 1) & (monday + 3 < days_from_civil(y + 1, F.lit(1), F.lit(1))), monday + weekday - 1))


def parsed_date(text: Column, order: Column) -> Column:
    """A struct of ``day`` (days since 1970), ``second`` (local second of the day, if told), ``offset`` (seconds east of UTC, if told) and ``instant`` (epoch second, for epoch numbers).

    ``order`` is DMY, MDY or YMD.  All are null where the text names no existing day.
    """

    def numbers(p: Column) -> Column:
        f = lambda name: _field(p, DATE_FIELDS, name)
        year = lambda x: x.cast("int") + F.when(F.length(x) == 2, 2000).otherwise(0)
        front = (order == "YMD") & (F.length(f("c")) == 2)  # a last number of four digits is the year
        a, b, c = (f(x).cast("int") for x in "abc")
        return F.struct(
            F.coalesce(year(f("y")), F.when(front, a + 2000).otherwise(year(f("c")))).alias("y"),
            F.coalesce(f("m").cast("int"), _month(f("word")), F.when((order == "MDY"), a).otherwise(b)).alias("m"),
            F.coalesce(f("d").cast("int"), F.when(front, c).when(order == "MDY", b).otherwise(a)).alias("d"),
            *(f(x).cast("int").alias(x) for x in ("serial", "wy", "ww", "wd", "oy", "od")),
            F.coalesce(f("sec").cast("long"), F.floor(f("ms").cast("long") / 1000)).alias("instant"),
            _seconds(f("h"), f("n"), f("s")).alias("second"),
            _offset(f("z"), f("o")).alias("offset"),
        )

    def result(v: Column) -> Column:
        serial = v["serial"] - 25569  # spreadsheets count days from 1899-12-30
        day = F.coalesce(_civil(v["y"], v["m"], v["d"]), _ordinal(v["oy"], v["od"]), _iso_week(v["wy"], v["ww"], v["wd"]), serial)
        return F.struct(day.cast("long").alias("day"), v["second"].alias("second"), F.when(v["second"].isNotNull(), v["offset"]).alias("offset"), v["instant"].alias("instant"))

    return let(let(_parts(text, DATE_FORMS, DATE_FIELDS), numbers), result)


def parsed_time(text: Column) -> Column:
    """A struct of ``second`` and ``offset``; both null where the text is no time."""

    def result(p: Column) -> Column:
        f = lambda name: _field(p, TIME_FIELDS, name)
        half = F.lower(F.substring(f("p"), 1, 1))
        hour = let(f("h").cast("int"), lambda h: F.when(half.isin("a", "p") & ((h < 1) | (h > 12)), F.lit(None)).when(half == "a", h % 12).when(half == "p", h % 12 + 12).otherwise(h))
        return F.struct(_seconds(hour, f("n"), f("s")).alias("second"), _offset(f("z"), f("o")).alias("offset"))

    return let(_parts(text, TIME_FORMS, TIME_FIELDS), result)


def _utc(local: Column, zone: Column) -> Column:
    """Epoch second of a local epoch second: the first of two, or with the offset before a gap."""
    return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), zone))


def _local_day(instant: Column, zone: Column) -> Column:
    return F.floor(F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(instant), zone)) / 86400)


def _iso_day(day: Column) -> Column:
    return F.date_add(F.to_date(F.lit("1970-01-01")), day.cast("int")).cast("string")


def _iso_instant(at: Column) -> Column:
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    day = F.floor(at / 86400)
    return let(at - day * 86400, lambda s: F.concat(_iso_day(day), F.lit("T"), two(s / 3600), F.lit(":"), two(s % 3600 / 60), F.lit(":"), two(s % 60), F.lit("Z")))


def _with_source(df: DataFrame, systems: DataFrame) -> DataFrame:
    """Zone and date order of the source; an unknown source counts as UTC and DMY."""
    known = systems.select(F.col("source_system").alias("_source"), F.col("time_zone").alias("_zone"), F.col("date_order").alias("_order"))
    joined = df.join(bounded(known), F.col("source_system") == F.col("_source"), "left")
    return joined.withColumn("_zone", F.coalesce("_zone", F.lit("UTC"))).withColumn("_order", F.coalesce("_order", F.lit("DMY")))


def days(records: DataFrame, systems: DataFrame, fields: tuple[str, ...], key: str = "record_id") -> DataFrame:
    """``(key, field, value)``: the calendar day of each date field as YYYY-MM-DD.

    An instant is taken in the zone of its source system.  Null, empty and
    unreadable entries and impossible days give no row.
    """
    long = records.select(F.col(key), "source_system", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields))).alias("x")).select(key, "source_system", "x.field", "x.text").where(F.col("text").isNotNull())
    zone = F.col("_zone")

    def value(v: Column) -> Column:
        instant = F.coalesce(v["instant"], v["day"] * 86400 + v["second"] - v["offset"])
        return _iso_day(F.coalesce(_local_day(instant, zone), v["day"]))

    read = let(parsed_date(F.col("text"), F.col("_order")), value)
    return _with_source(long, systems).select(key, "field", read.alias("value")).where(F.col("value").isNotNull())


def instants(records: DataFrame, systems: DataFrame, date: str = "date", time: str = "time", key: str = "record_id") -> DataFrame:
    """``(key, field, value)``: the UTC instant of date and time, or the day if no time is known.

    A zone in the text wins over that of the source system; an unreadable time
    counts as none; without an existing day there is no row.
    """
    rows = records.select(key, "source_system", F.col(date).cast("string").alias("_date"), F.col(time).cast("string").alias("_time")).where(F.col("_date").isNotNull())
    zone = F.col("_zone")

    def instant(v: Column) -> Column:
        d, t = v["d"], v["t"]
        inside = d["second"].isNotNull()  # the date tells the time itself
        second, offset = F.when(inside, d["second"]).otherwise(t["second"]), F.when(inside, d["offset"]).otherwise(t["offset"])
        local = d["day"] * 86400 + second
        return F.struct(F.coalesce(d["instant"], local - offset, _utc(local, zone)).alias("at"), d["day"].alias("day"))

    both = F.struct(parsed_date(F.col("_date"), F.col("_order")).alias("d"), parsed_time(F.col("_time")).alias("t"))
    value = let(let(both, instant), lambda x: F.coalesce(_iso_instant(x["at"]), _iso_day(x["day"])))
    return _with_source(rows, systems).select(key, F.lit("datetime").alias("field"), value.alias("value")).where(F.col("value").isNotNull())
