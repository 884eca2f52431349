"""Text to typed values: every parser gives NULL for what it can't read, and none raises.

Grammars are checked by pattern before any cast, as Spark's own casts accept more (``1d``, ``3.5`` as a
decimal integer, zoned timestamps) and ANSI mode raises.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a missing value, and for true and false.
NULL_WORDS = ("null", "none", "nan", "n/a", "na")
TRUE_WORDS = ("true", "1", "t", "y", "yes", "on")
FALSE_WORDS = ("false", "0", "f", "n", "no", "off")

#: The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

INTEGER = r"^[+-]?[0-9]+$"
FLOAT = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"
DATE_ISO = r"^[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}$"
DATE_SLASH = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{1,4}$"
STAMP_ISO = r"^[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}[ T][0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}(\.[0-9]+)?$"
STAMP_PADDED = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?$"
STAMP_LIKE = r"^[0-9]{1,4}[-/][0-9]{1,2}[-/]"
STAMP_DMY = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{1,4} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"
STAMP_YMD = r"^[0-9]{1,4}/[0-9]{1,2}/[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"


@dataclass(frozen=True)
class Trimmed:
    """A text column without white space at its ends, so that no parser trims it again."""

    column: Column


def trim(v: Column | Trimmed) -> Column:
    """Without white space, as Unicode has it, at either end."""
    if isinstance(v, Trimmed):
        return v.column
    return F.btrim(v, F.lit(WHITE_SPACE))


def is_null_token(v: Column) -> Column:
    t = trim(v)
    n = F.octet_length(t)  # tells most values without looking at them
    return F.coalesce((n == 0) | ((n <= 4) & F.lower(t).isin(*NULL_WORDS)), F.lit(True))


def parse_bool(v: Column) -> Column:
    t = trim(v)
    low = F.lower(t)
    return F.when(F.octet_length(t) <= 5, F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False))


def parse_int(v: Column) -> Column:
    """A signed 64-bit number."""
    t = trim(v)
    return F.when(t.rlike(INTEGER), t.try_cast("bigint"))


def parse_uint(v: Column) -> Column:
    """An unsigned 64-bit number, as decimal(20,0)."""
    t = trim(v)
    n = F.when(t.rlike(INTEGER), t.try_cast("decimal(20,0)"))
    return F.when((n >= 0) & (n <= F.lit("18446744073709551615").cast("decimal(20,0)")), n)


def parse_float(v: Column) -> Column:
    """A finite double."""
    t = trim(v)
    x = F.when(t.rlike(FLOAT), t.try_cast("double"))
    return F.when(F.abs(x) < float("inf"), x)


def parse_date(v: Column) -> Column:
    """ISO, then day first, then month first, each value for itself."""
    t = trim(v)
    iso = F.when(t.rlike(DATE_ISO), F.try_to_date(t, "y-M-d"))
    slash = F.when(t.rlike(DATE_SLASH), F.coalesce(F.try_to_date(t, "d/M/y"), F.try_to_date(t, "M/d/y")))
    return F.coalesce(iso, slash)


def _stamp(y: Column, m: Column, d: Column, hour: Column, minute: Column, sec: Column, fraction: Column | None = None) -> Column:
    """From whole numbers and the digits of a fraction, of which three count; second 60 is the next minute's first."""
    base = F.call_function("try_make_timestamp_ntz", y, m, d, hour, minute, F.least(sec, F.lit(59)).cast("decimal(16,6)"))
    more = F.when(sec == 60, 1000).otherwise(0).cast("bigint")
    if fraction is None:
        return F.when(sec <= 60, F.when(sec == 60, F.timestamp_add("MILLISECOND", more, base)).otherwise(base))
    more = more + F.when(F.octet_length(fraction) > 0, F.rpad(F.substring(fraction, 1, 3), 3, "0").cast("bigint")).otherwise(0)
    return F.when(sec <= 60, F.when(more > 0, F.timestamp_add("MILLISECOND", more, base)).otherwise(base))


def parse_datetime(v: Column) -> Column:
    """Zone-less date and time of one of six forms; milliseconds at most."""
    t = trim(v)
    at = lambda i, n=2: F.substring(t, i, n).cast("int")  # noqa: E731  the patterns leave digits only
    padded = _stamp(at(1, 4), at(6), at(9), at(12), at(15), at(18), F.substring(t, 21, 3))

    def other(part: Column) -> Column:
        g = lambda i: F.get(part, i).cast("int")
        iso = _stamp(g(0), g(1), g(2), g(3), g(4), g(5), F.coalesce(F.get(part, 6), F.lit("")))
        return F.when(t.rlike(STAMP_ISO), iso).when(t.rlike(STAMP_DMY), _stamp(g(2), g(1), g(0), g(3), g(4), g(5))).when(t.rlike(STAMP_YMD), _stamp(g(0), g(1), g(2), g(3), g(4), g(5)))

    # the usual, zero-padded form is cut at fixed places; the parts of others are split once and named
    split = F.transform(F.array(F.split(t, "[^0-9]+")), other)[0]
    return F.when(t.rlike(STAMP_PADDED), padded).when(t.rlike(STAMP_LIKE), split)


def epoch_millis(v: Column) -> Column:
    """Milliseconds of a whole number in one of four bands (s, ms, us, ns since 1970); others are NULL."""
    t = trim(v)
    x = F.when((F.octet_length(t) >= 10) & t.rlike(INTEGER), t.try_cast("decimal(38,0)"))
    lit = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    inside = lambda lo, hi: (x >= lit(lo)) & (x < lit(hi))
    return (
        F.when(inside(10**9, 4 * 10**9), x.cast("bigint") * 1000)
        .when(inside(10**12, 4 * 10**12), x.cast("bigint"))
        .when(inside(10**15, 4 * 10**15), F.call_function("div", x, lit(1000)))
        .when(inside(10**18, 9 * 10**21), F.call_function("div", x, lit(10**6)))  # beyond: no timestamp can hold it
    )


def parse_timestamp(v: Column) -> Column:
    millis = epoch_millis(v)
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.coalesce(parse_datetime(v), F.when(millis.isNotNull(), F.timestamp_add("MILLISECOND", millis, zero)))


def parse_timestamp_ms(v: Column) -> Column:
    """parse_timestamp as milliseconds since 1970."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), parse_timestamp(v))


def scale_unit(v: Column, unit: str) -> Column:
    """A timestamp in its unit: whole seconds (toward 1970), else milliseconds as they are."""
    if unit != "s":
        return v
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("SECOND", F.call_function("div", F.timestamp_diff("MILLISECOND", zero, v), F.lit(1000)), zero)


def parse_text(v: Column) -> Column:
    return F.when(~is_null_token(v), v)


def parse_binary(v: Column) -> Column:
    return F.encode(parse_text(v), "UTF-8")


def cast_to(v: Column, kind: str, trimmed: Column | None = None) -> Column:
    """The parser of a kind, NULL words first; trimmed: the value without white space at its ends, if that is at hand."""
    t = Trimmed(trim(v) if trimmed is None else trimmed)
    if kind == "text":
        out = v
    elif kind == "binary":
        out = F.encode(v, "UTF-8")
    elif kind.startswith("timestamp"):
        out = scale_unit(parse_timestamp(t), kind[10:-1])
    else:
        out = {"boolean": parse_bool, "uint64": parse_uint, "int64": parse_int, "float64": parse_float, "date32": parse_date}[kind](t)
    return F.when(~is_null_token(t), out)
