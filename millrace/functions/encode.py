"""Scalar encodings of keys, names and durations, all as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SIMPLE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def long_key(value: Column) -> Column:
    """Sign and 13 base-36 digits of the magnitude: 14 characters for every long, the least one included."""
    digits = F.lower(F.conv(F.regexp_replace(value.cast("string"), "^-", ""), 10, 36))
    return F.concat(F.when(value < 0, "-").otherwise("+"), F.lpad(digits, 13, "0"))


def parse_long_key(key: Column) -> Column:
    """The long of a long_key; the sign joins before the cast, so the least long comes back too."""
    return F.concat(F.when(F.substring(key, 1, 1) == "-", "-").otherwise(""), F.conv(F.substring(key, 2, 13), 36, 10)).cast("long")


def hex_key(value: Column) -> Column:
    return F.hex(value.cast("binary"))


def parse_raw_key(name: Column) -> Column:
    """What stands between the first and the last underscore; null if they aren't two."""
    return F.when(F.length(name) - F.length(F.replace(name, F.lit("_"), F.lit(""))) >= 2, F.regexp_extract(name, r"(?s)^[^_]*_(.*)_[^_]*$", 1))


def raw_key(job: Column, key: Column, shard: Column) -> Column:
    return F.concat_ws("_", job, key, shard.cast("string"))


def parse_bool(text: Column) -> Column:
    return F.lower(text).isin("true", "1", "yes", "t", "on")


def short_name(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def shard_id(job: Column, number: Column) -> Column:
    return F.concat(job, F.lit("-"), number.cast("string"))


def shard_number(name: Column) -> Column:
    return F.substring_index(name, "-", -1).cast("int")


def descending_key(seconds: Column, tie: Column) -> Column:
    """Newer times give lesser strings: hundredths of seconds left until 2**34, then the tie-breaker."""
    return F.concat(F.floor((F.lit(float(1 << 34)) - seconds) * 100).cast("long").cast("string"), tie.cast("string"))


def task_name(attempt: Column, number: Column) -> Column:
    return F.concat(F.translate(F.concat(F.lit("worker_"), attempt), "_", "-"), F.lit("--"), number.cast("string"))


def last_work_item(item: Column) -> Column:
    return F.substring(item, 1, 100)


def elapsed(milliseconds: Column) -> Column:
    """[N day[s], ]HH:MM:SS"""
    s = F.floor(milliseconds / 1000).cast("long")
    days = F.floor(s / 86400).cast("long")
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(s % 86400 / 3600)), two(F.floor(s % 3600 / 60)), two(s % 60))
    prefix = F.when(days == 1, "1 day, ").when(days > 1, F.concat(days.cast("string"), F.lit(" days, "))).otherwise("")
    return F.concat(prefix, clock)


def rate(value: Column, milliseconds: Column) -> Column:
    """Average per second, to two decimals, halves up; null without time."""
    return F.when(milliseconds > 0, F.floor(value * 100000.0 / milliseconds + 0.5) / 100)


def chart_codes(values: Column, top: Column) -> Column:
    """Array of numbers as symbols of the 62-letter chart alphabet on the axis 0 to top; out of range or null: "_"."""
    scale = F.when(top == 0, 1.0).otherwise(61.0 / top)

    def code(x: Column) -> Column:
        at = F.floor(x * scale + 0.5).cast("int")
        return F.when(x.isNotNull() & at.between(0, 61), F.substr(F.lit(SIMPLE), at + 1, F.lit(1))).otherwise("_")

    return F.concat(F.lit("s:"), F.array_join(F.transform(values, code), ""))


def chart_codes_enhanced(values: Column, top: Column) -> Column:
    """As chart_codes with two symbols for each of 4096 steps; out of range or null: "__"."""
    letters = SIMPLE + "-."
    scale = F.when(top == 0, 1.0).otherwise(4095.0 / top)

    def code(x: Column) -> Column:
        at = F.floor(x * scale + 0.5).cast("int")
        two = F.concat(F.substr(F.lit(letters), F.floor(at / 64).cast("int") + 1, F.lit(1)), F.substr(F.lit(letters), at % 64 + 1, F.lit(1)))
        return F.when(x.isNotNull() & at.between(0, 4095), two).otherwise("__")

    return F.concat(F.lit("e:"), F.array_join(F.transform(values, code), ""))


def first_of(*pairs: tuple[Column, object]) -> Column:
    """The value of the first pair whose condition holds, else null."""
    return reduce(lambda rest, p: F.when(p[0], p[1]).otherwise(rest), reversed(pairs), F.lit(None))
