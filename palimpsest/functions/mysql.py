"""Functions by their MySQL names and meanings, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What MySQL's format letters are in Spark's patterns.
DATE_LETTERS = {
    "a": "EEE", "b": "MMM", "c": "M", "d": "dd", "e": "d", "f": "SSSSSS", "H": "HH", "h": "hh", "I": "hh", "i": "mm", "j": "DDD", "k": "H", "l": "h",
    "M": "MMMM", "m": "MM", "p": "a", "r": "hh:mm:ss a", "S": "ss", "s": "ss", "T": "HH:mm:ss", "W": "EEEE", "Y": "yyyy", "y": "yy",
}
#: Microseconds of the units that have a fixed length.
UNITS = {"MICROSECOND": 1, "SECOND": 10**6, "MINUTE": 60 * 10**6, "HOUR": 3600 * 10**6, "DAY": 86400 * 10**6, "WEEK": 7 * 86400 * 10**6}
MONTHS = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}


def date_pattern(mysql: str) -> str:
    out, i, text = "", 0, ""

    def flush() -> str:
        return "'" + text.replace("'", "''") + "'" if any(c.isalpha() or c == "'" for c in text) else text

    while i < len(mysql):
        if mysql[i : i + 2] == "%%":
            text += "%"
            i += 2
        elif mysql[i] == "%" and i + 1 < len(mysql):
            out, text = out + flush() + DATE_LETTERS.get(mysql[i + 1], mysql[i + 1]), ""
            i += 2
        else:
            text += mysql[i]
            i += 1
    return out + flush()


def date_format(c: Column, mysql: str) -> Column:
    return F.date_format(c, date_pattern(mysql))


def str_to_date(c: Column, mysql: str) -> Column:
    """Null where the text doesn't fit, as in MySQL."""
    return F.try_to_timestamp(c, F.lit(date_pattern(mysql)))


def date_add(c: Column, n: Column | int, unit: str) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    unit = unit.upper()
    if unit in MONTHS:
        return c + F.make_interval(months=n * MONTHS[unit])
    return F.timestamp_micros(F.unix_micros(c.cast("timestamp")) + n * UNITS[unit])


def timestampdiff(unit: str, a: Column, b: Column) -> Column:
    """Whole units from a to b, cut towards zero."""
    unit = unit.upper()
    if unit in MONTHS:
        months = F.months_between(b, a)
        whole = F.when(months < 0, F.ceil(months)).otherwise(F.floor(months))
        return F.when(whole < 0, F.ceil(whole / MONTHS[unit])).otherwise(F.floor(whole / MONTHS[unit])).cast("long")
    return ((F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(UNITS[unit])).cast("long")


def convert_tz(c: Column, source: str, target: str) -> Column:
    return F.convert_timezone(F.lit(source), F.lit(target), c.cast("timestamp_ntz"))


def unix_timestamp(c: Column) -> Column:
    return F.unix_seconds(c.cast("timestamp"))


def field(c: Column, *values: object) -> Column:
    """Place of c among the values, from 1; 0 if it isn't there or null."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), c), F.lit(0)).cast("int")


def elt(n: int | Column, *values: object) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.get(F.array(*[F.lit(v) for v in values]), n - 1)


def find_in_set(needle: str, c: Column) -> Column:
    return F.when(F.lit(needle).contains(","), F.lit(0)).otherwise(F.coalesce(F.array_position(F.split(c, ","), F.lit(needle)), F.lit(0))).cast("int")


def substring_index(c: Column, sep: str, n: int) -> Column:
    return F.substring_index(c, sep, n)


def length(c: Column) -> Column:
    """Bytes, as MySQL's LENGTH; CHAR_LENGTH counts characters."""
    return F.octet_length(c)


def format_number(c: Column, digits: int) -> Column:
    return F.format_number(c, digits)


def divide(a: Column, b: Column) -> Column:
    """a / b, null for a zero divisor."""
    return F.try_divide(a, b)


def int_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b).cast("long")


def uuid_to_bin(c: Column) -> Column:
    return F.unhex(F.replace(c, F.lit("-"), F.lit("")))


def bin_to_uuid(c: Column) -> Column:
    h = F.lower(F.hex(c))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def space(n: int) -> Column:
    return F.repeat(F.lit(" "), F.lit(n))


def group_concat(c: Column, sep: str = ",") -> Column:
    """Sorted, so that the result doesn't depend on the order of rows."""
    return F.concat_ws(sep, F.sort_array(F.collect_list(c)))


def like_ci(c: Column, pattern: str) -> Column:
    """LIKE under a collation that ignores case."""
    return c.ilike(pattern)
