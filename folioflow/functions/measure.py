"""Numbers, distances and areas as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(value: Column, conversion: float = 1.0, precision: int = 100, style: str = "D", unit: str = "", position: str = "S", thousands: str = ",", point: str = ".") -> Column:
    """A converted value with its unit.

    Style D rounds to 1 / ``precision`` (half away from zero), T cuts, R rounds to a whole number and F
    gives a reduced fraction of ``precision``. Zeros at the end go; ``position`` P puts the unit first.
    """
    scaled = value * conversion
    sign = F.when(scaled < 0, F.lit("-")).otherwise(F.lit(""))
    size = F.abs(scaled)
    if style == "F" and precision > 0:
        whole = F.floor(size)
        up = F.round((size - whole) * precision).cast("long")
        carried = F.when(up == precision, whole + 1).otherwise(whole)
        up = F.when(up == precision, F.lit(0)).otherwise(up)
        divisor = F.lit(1).cast("long")
        for d in range(2, precision + 1):
            if precision % d == 0:
                divisor = F.when(up % d == 0, F.lit(d).cast("long")).otherwise(divisor)
        part = F.concat((up / divisor).cast("long").cast("string"), F.lit("/"), (F.lit(precision) / divisor).cast("long").cast("string"))
        text = F.when(up == 0, carried.cast("string")).when(carried == 0, part).otherwise(F.concat(carried.cast("string"), F.lit(" "), part))
    else:
        steps = max(1, precision) if style in ("D", "T") else 1
        units = (F.floor(size * steps) if style == "T" else F.round(size * steps)).cast("long")
        digits = len(str(steps)) - 1
        whole = F.floor(units / steps).cast("long")
        grouped = F.replace(F.format_number(whole, 0), F.lit(","), F.lit(thousands))
        rest = F.rtrim(F.lpad(F.round((units % steps) * (10**digits) / steps).cast("long").cast("string"), max(digits, 1), "0"), F.lit("0")) if digits else F.lit("")
        text = F.when(rest == "", grouped).otherwise(F.concat(grouped, F.lit(point), rest))
    shown = F.concat(sign, text)
    if not unit:
        return shown
    return F.concat(F.lit(unit + " "), shown) if position == "P" else F.concat(shown, F.lit(" " + unit))


def cascade_text(value: Column, units: list[tuple[float, str]], precision: int = 1) -> Column:
    """A value in whole units and the rest in the next unit, as in feet and inches; each unit has the factor from the one before."""
    parts, rest = [], value
    for i, (factor, name) in enumerate(units):
        scaled = rest * factor
        last = i == len(units) - 1
        whole = F.round(scaled * precision) / precision if last else F.floor(scaled + 1e-9).cast("double")
        parts.append(F.concat(whole.cast("long").cast("string") if precision == 1 or not last else whole.cast("string"), F.lit(name)))
        rest = scaled - whole
    return F.concat_ws(" ", *parts)


def real_text(value: Column) -> Column:
    """Without an exponent, and without zeros at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), "0+$", ""), "\\.$", "")


def date_text(at: Column) -> Column:
    return F.concat(F.lit("D:"), F.date_format(at, "yyyyMMddHHmmss"), F.lit("Z"))


def date_read(text: Column) -> Column:
    """D:YYYYMMDDHHmmSS with an optional zone; later parts may be missing; null for what is no date."""
    got = lambda i: F.regexp_extract(text, "^D?:?(\\d{4})(\\d{2})?(\\d{2})?(\\d{2})?(\\d{2})?(\\d{2})?([Zz]|[+-]\\d{2}'?\\d{2}'?)?", i)
    part = lambda i, default: F.when(got(i) == "", F.lit(default)).otherwise(got(i))
    base = F.try_to_timestamp(F.concat(got(1), part(2, "01"), part(3, "01"), part(4, "00"), part(5, "00"), part(6, "00")), F.lit("yyyyMMddHHmmss"))
    zone = F.regexp_replace(got(7), "'", "")
    minutes = F.when(zone.rlike("^[+-]"), (F.substring(zone, 2, 2).cast("int") * 60 + F.coalesce(F.substring(zone, 4, 2).cast("int"), F.lit(0))) * F.when(F.startswith(zone, F.lit("-")), F.lit(-1)).otherwise(F.lit(1))).otherwise(F.lit(0))
    return F.when(got(1) != "", base - F.make_interval(mins=minutes))
