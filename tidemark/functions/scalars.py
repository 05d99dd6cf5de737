"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def arithmetic(op: str, left: Column, right: Column) -> Column:
    """A binary operator on doubles; division and remainder by zero are NaN, and a remainder has the dividend's sign."""
    if op == "+":
        return left + right
    if op == "-":
        return left - right
    if op == "*":
        return left * right
    if op == "^":
        return F.pow(left, right)
    if op in ("/", "%"):
        safe = F.when(right != 0, right)
        return F.coalesce(left / safe if op == "/" else left % safe, nan())
    raise ValueError(f"not an arithmetic operator: {op}")


def compared(op: str, left: Column, right: Column) -> Column:
    """A comparison that NaN never passes, but for ``!=``."""
    odd = F.isnan(left) | F.isnan(right)
    found = {"==": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
    return F.when(odd, F.lit(op == "!=")).otherwise(found)


def percentile(value: Column | str, p: float) -> Column:
    """The exact percentile with linear interpolation, 0 of nothing; an aggregate."""
    return F.coalesce(F.percentile(value, F.lit(p)), F.lit(0.0))


def average(total: Column, count: Column) -> Column:
    """Sum over count; 0 of nothing."""
    return F.when(count == 0, 0.0).otherwise(total / F.when(count != 0, count))


def floor_to(ts: Column, minutes: int) -> Column:
    """The start of a time's bucket, in UTC."""
    size = minutes * 60_000_000
    return F.timestamp_micros(F.unix_micros(ts) - F.pmod(F.unix_micros(ts), F.lit(size)))


def normal_path(path: Column) -> Column:
    """A URL path with UUIDs and then numbers as segments replaced by ``{id}``."""
    uuid = r"/[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    return F.regexp_replace(F.regexp_replace(path, uuid, "/{id}"), r"/\d+", "/{id}")


def six_decimals(value: Column) -> Column:
    """A value as the query interface prints it."""
    special = F.when(F.isnan(value), "NaN").when(value == float("inf"), "+Inf").when(value == float("-inf"), "-Inf")
    return F.coalesce(special, F.format_string("%.6f", value))


def shortest(value: Column) -> Column:
    """The shortest decimal digits that read back as the value, never with an exponent; NaN, +Inf and -Inf by these names."""
    text = value.cast("string")
    sign, rest = F.when(text.startswith("-"), "-").otherwise(""), F.regexp_replace(text, "^-", "")
    whole, part, power = (F.regexp_extract(rest, r"^(\d+)\.(\d+)E(-?\d+)$", k) for k in (1, 2, 3))
    digits = F.concat(whole, F.when(part == "0", "").otherwise(part))
    point = F.length(whole) + F.coalesce(power.try_cast("int"), F.lit(0))  # how many digits stand before the point
    wide = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= F.length(digits), F.concat(digits, F.repeat(F.lit("0"), point - F.length(digits))))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits))))
    )
    plain = F.when(power != "", wide).otherwise(F.regexp_replace(rest, r"\.0$", ""))
    return F.when(F.isnan(value), "NaN").when(value == float("inf"), "+Inf").when(value == float("-inf"), "-Inf").otherwise(F.concat(sign, plain))
