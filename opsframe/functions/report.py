"""Display columns for reports."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def commas(number: Column) -> Column:
    """Thousands separators in the whole part; decimals as they are."""
    text = number.cast("string")
    plain = F.regexp_replace(number.cast("decimal(38,10)").cast("string"), r"(\.\d+?)0+$", "$1")
    text = F.when(F.contains(text, F.lit("E")), plain).otherwise(text)  # large doubles are written with an exponent
    whole = F.regexp_replace(F.substring_index(text, ".", 1), r"(?<=\d)(?=(\d{3})+$)", ",")
    return F.when(F.contains(text, F.lit(".")), F.concat_ws(".", whole, F.substring_index(text, ".", -1))).otherwise(whole)


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th ..."""
    last, teens = n % 10, (n % 100).between(11, 13)
    ending = F.when(teens, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), ending)


def fill(text: Column, pattern: str) -> Column:
    """Characters of the text put in place of each X; null when the text is too short."""
    runs = re.findall(r"X+|[^X]+", pattern)
    groups = [len(r) for r in runs if r[0] == "X"]
    shape = "(?s)^" + "".join(f"(.{{{n}}})" for n in groups) + ".*$"
    number, made = 0, ""
    for run in runs:
        if run[0] == "X":
            number += 1
            made += f"${number}"
        else:  # a digit behind $n would be read as part of the group number
            made += re.sub(r"([\\$0-9])", r"\\\1", run)
    return F.when(F.length(text) >= sum(groups), F.regexp_replace(text, shape, made))


def fill_date(number_text: Column) -> Column:
    return fill(number_text, "XXXX-XX-XX XX:XX:XX")


def base36(n: Column) -> Column:
    """Negative numbers fail the job."""
    checked = F.when(n < 0, F.raise_error(F.lit("must supply a positive integer")).cast("string")).otherwise(n.cast("string"))
    return F.lower(F.conv(checked, 10, 36))


def shorten(text: Column, length: int = 30, keep: int = 14) -> Column:
    """Long texts lose their middle."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, keep), F.lit(".."), F.right(text, F.lit(keep)))).otherwise(text)


def _fixed(value: Column, places: int) -> Column:
    """Half-even rounding, as number formatting in most languages does."""
    return F.format_string(f"%.{places}f", F.bround(value, places))


def rate_text(n: Column) -> Column:
    """Bytes as 1.2m, 12k or 12b."""
    mega, kilo = n / 1024 / 1024, n / 1024
    return F.when(mega > 1, F.concat(_fixed(mega, 1), F.lit("m"))).when(
        kilo > 1, F.concat(_fixed(kilo, 0), F.lit("k"))).otherwise(F.concat(_fixed(n.cast("double"), 0), F.lit("b")))


def size_text(n: Column) -> Column:
    """Bytes as whole G or M, else the plain number."""
    giga, mega = n / 1024 / 1024 / 1024, n / 1024 / 1024
    return F.when(giga >= 1, F.concat(_fixed(giga, 0), F.lit("G"))).when(
        mega >= 1, F.concat(_fixed(mega, 0), F.lit("M"))).otherwise(n.cast("string"))


def date_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def time_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def age(then: Column, now: Column) -> Column:
    """`2 hours ago`, `3 days from now`, or the date when 4 or more days lie between."""
    micros = F.timestamp_diff("MICROSECOND", then, now)
    seconds = F.when(micros < 0, -F.floor(-micros / 1000000)).otherwise(F.floor(micros / 1000000))
    days = F.when(seconds < 0, -F.floor(-seconds / 86400)).otherwise(F.floor(seconds / 86400))

    def said(amount: Column, unit: str, divisor: int = 1) -> Column:
        n = F.floor(amount / divisor)
        plural = F.when(F.abs(n) != 1, "s").otherwise("")
        side = F.when(n < 0, "from now").otherwise("ago")
        return F.concat(F.abs(n).cast("string"), F.lit(f" {unit}"), plural, F.lit(" "), side)

    date = F.concat(F.date_format(then, "MMMM "), F.lpad(F.dayofmonth(then).cast("string"), 2, " "))
    dated = F.when((F.year(then) != F.year(now)) | (days < 0), F.concat(date, F.lit(", "), F.year(then).cast("string"))).otherwise(date)
    return (F.when(then.isNull(), "")
            .when(F.abs(days) >= 4, dated).when(days != 0, said(days, "day"))
            .when(F.abs(seconds) > 3600, said(seconds, "hour", 3600)).when(F.abs(seconds) > 60, said(seconds, "minute", 60))
            .when(seconds != 0, said(seconds, "second"))
            .when(F.abs(micros) > 1000, said(micros, "millisecond", 1000)).otherwise(said(micros, "microsecond")))
