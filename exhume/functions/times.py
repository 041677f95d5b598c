"""Timestamps of tool listings as epoch seconds (C7), independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from exhume.functions.blocks import let

# Zone labels and the region each one means (daylight saving follows the date).
ZONES = {
    "GMT": "UTC",
    "IST": "Asia/Kolkata",
    "UTC": "UTC",
    "EDT": "America/New_York",
    "EST": "America/New_York",
    "PDT": "America/Los_Angeles",
    "PST": "America/Los_Angeles",
    "CST": "America/Chicago",
    "CDT": "America/Chicago",
    "MST": "America/Denver",
    "MDT": "America/Denver",
}
FIELDS = ("year", "month", "day", "hour", "minute", "second")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _zone(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, label), F.lit("UTC"))


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("int")  # the cast would raise inside on ''


def _seconds(t: Column) -> Column:
    """Wall time ``t`` (year .. second, zone, shift) as epoch seconds; a repeated hour means standard time."""
    zone = t["zone"]
    instant = F.call_function(
        "try_make_timestamp", *[_int(t[f]) for f in FIELDS[:5]], _int(t["second"]).cast("decimal(8,6)"), zone
    )

    def settle(e: Column) -> Column:
        offset = lambda x: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(x), zone)) - x
        return F.when(offset(e + 3600) == offset(e) - 3600, e + 3600).otherwise(e)

    return let(F.unix_seconds(instant), settle) - t["shift"]


def to_epoch(text: Column) -> Column:
    """Epoch seconds, 0 for the all-zero date, null for anything unknown.

    Known are a date and a clock followed by a label in brackets, by ``Z`` or by an offset (minutes and seconds
    allowed), and the long form: weekday, month, day, clock, label if any, year.
    """

    def fields(t: Column) -> Column:
        token = lambda i: F.get(t, F.lit(i))
        shaped = lambda i, pattern: F.coalesce(token(i).rlike(f"^(?:{pattern})$"), F.lit(False))
        n = F.size(t)
        clock = r"\d\d:\d\d:\d\d"

        def known(date: list[Column], at: int, zone: Column, shift: Column) -> Column:
            time = F.split(F.regexp_replace(token(at), r"\..*", ""), ":")
            named = [c.alias(f) for c, f in zip([*date, *[F.get(time, F.lit(i)) for i in range(3)]], FIELDS)]
            return F.struct(*named, zone.alias("zone"), shift.cast("bigint").alias("shift"))

        day = F.split(token(0), "-")
        dashed = [F.get(day, F.lit(i)) for i in range(3)]
        dated = (n == 3) & shaped(0, r"\d{4}-\d{1,2}-\d{1,2}")
        label = F.substring(token(2), 2, F.length(token(2)) - 2)
        digits = F.regexp_replace(token(2), r"[^\d]", "")
        pair = lambda i: F.coalesce(_int(F.substring(digits, i, 2)), F.lit(0))
        sign = F.when(token(2).startswith("-"), -1).otherwise(1)
        # a weekday, a month, a day, a clock, a label or none, a year
        month = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(token(1))), F.lit(0)).cast("string")
        spelled = n.isin(5, 6) & shaped(0, r"\w{3}") & shaped(2, r"\d{1,2}") & shaped(3, clock)
        year = F.element_at(t, -1)
        spelled = spelled & year.rlike(r"^\d{4}$") & ((n == 5) | shaped(4, r"\w{2,4}"))
        zone = F.when(n == 6, _zone(token(4))).otherwise(F.lit("UTC"))
        none = F.lit(0)
        return (
            F.when(dated & shaped(1, clock) & shaped(2, r"\([\w/+:-]+\)"), known(dashed, 1, _zone(label), none))
            .when(spelled, known([year, month, token(2)], 3, zone, none))
            .when(dated & shaped(1, clock + r"(?:\.\d+)?") & (token(2) == "Z"), known(dashed, 1, F.lit("UTC"), none))
            .when(
                dated & shaped(1, clock + r"(?:\.\d+)?") & shaped(2, r"[+-]\d\d:?\d\d(?::?\d\d)?"),
                known(dashed, 1, F.lit("UTC"), (pair(1) * 3600 + pair(3) * 60 + pair(5)) * sign),
            )
        )

    trimmed = F.trim(text)
    # one-digit days are padded with a second blank
    tokens = F.filter(F.split(trimmed, " "), lambda x, i: (x != "") | (i < 2))
    return F.when(trimmed.startswith("0000-00-00"), F.lit(0).cast("bigint")).otherwise(
        let(tokens, lambda t: let(fields(t), _seconds))
    )
