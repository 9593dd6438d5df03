"""XPath's string and number functions as columns: nothing leaves the JVM.

Strings are never null (empty instead); numbers are doubles, and NaN stands for what is not a number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INFINITY = float("inf")
SPACE = r"[ \t\r\n]+"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def to_number(s: Column) -> Column:
    """A string as a number by XPath's grammar: optional minus, digits, optional fraction, white space around."""
    t = F.regexp_replace(F.coalesce(s, F.lit("")), r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    return F.when(t.rlike(r"^-?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), t.try_cast("double")).otherwise(NAN)


def to_string(x: Column) -> Column:
    """A number as a string: no exponent, no trailing zeros, whole numbers without a point."""
    whole = F.abs(x) < 1e15
    plain = F.when((F.floor(x) == x) & whole, F.floor(x).cast("string"))
    decimal = F.regexp_replace(F.regexp_replace(x.try_cast("decimal(38,17)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    shown = x.cast("string")  # shortest digits that round-trip; moved out of exponent form only where there is one
    text = F.when(shown.contains("E"), F.coalesce(decimal, F.format_string("%.0f", x))).otherwise(shown)
    return F.when(F.isnan(x), "NaN").when(x == INFINITY, "Infinity").when(x == -INFINITY, "-Infinity").when(x == 0, "0").otherwise(F.coalesce(plain, text))


def number_to_bool(x: Column) -> Column:
    return ~F.isnan(x) & (x != 0)


def div(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), NAN).when(b != 0, F.try_divide(a, b)).when(a == 0, NAN).when(a > 0, F.lit(INFINITY)).otherwise(F.lit(-INFINITY))


def mod(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b) | (b == 0), NAN).otherwise(F.try_mod(a, b))


def compare(op: str, a: Column, b: Column) -> Column:
    """Numbers: NaN is equal to nothing, itself included."""
    real = ~F.isnan(a) & ~F.isnan(b)
    return {"=": real & (a == b), "!=": ~(real & (a == b)), "<": real & (a < b), "<=": real & (a <= b), ">": real & (a > b), ">=": real & (a >= b)}[op]


def rounded(x: Column) -> Column:
    """Halves go up."""
    return F.when(F.isnan(x) | (F.abs(x) >= 4503599627370496.0), x).otherwise(F.floor(x + 0.5).cast("double"))


def floor(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= 4503599627370496.0), x).otherwise(F.floor(x).cast("double"))


def ceiling(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) >= 4503599627370496.0), x).otherwise(F.ceil(x).cast("double"))


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    """Characters at positions p with p >= round(start) and p < round(start) + round(length); none if either is NaN."""
    first = rounded(start)
    begin = F.when(F.isnan(first) | (first == INFINITY), F.lit(2147483647.0)).when(first < 1, F.lit(1.0)).otherwise(F.least(first, F.lit(2147483647.0)))
    if length is None:
        return F.when(F.isnan(first) | (first == INFINITY), "").otherwise(F.substring(s, begin.cast("int"), F.lit(2147483647)))
    end = first + rounded(length)
    size = F.least(F.greatest(end - begin, F.lit(0.0)), F.lit(2147483647.0))
    return F.when(F.isnan(first) | F.isnan(end) | (size <= 0), "").otherwise(F.substring(s, begin.cast("int"), size.cast("int")))


def before(s: Column, t: Column) -> Column:
    return F.when(position_of(s, t) > 0, F.substring(s, F.lit(1), position_of(s, t) - 1)).otherwise("")


def position_of(s: Column, t: Column) -> Column:
    return F.call_function("locate", t, s)


def after(s: Column, t: Column) -> Column:
    return F.when(position_of(s, t) > 0, F.substring(s, position_of(s, t) + F.length(t), F.lit(2147483647))).otherwise("")


def normalize_space(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, SPACE, " "))


def upper_case(s: Column) -> Column:
    """a to z only."""
    return F.translate(s, LOWER, UPPER)


def lower_case(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


def translate(s: Column, source: Column, target: Column) -> Column:
    """The first of repeated source characters counts, and characters without a partner go."""
    return F.call_function("translate", s, source, target)


def format_number(x: Column, pattern: str, symbols: dict[str, str] | None = None) -> Column:
    """A picture of #, 0, group and decimal marks, optional percent or per-mille sign, and a second part for negatives.

    symbols: decimal-separator, grouping-separator, minus-sign, percent, per-mille, infinity, NaN, pattern-separator, zero-digit, digit.
    """
    own = {"decimal-separator": ".", "grouping-separator": ",", "minus-sign": "-", "percent": "%", "per-mille": "‰", "pattern-separator": ";", "infinity": "Infinity", "NaN": "NaN", "digit": "#", "zero-digit": "0"} | (symbols or {})
    plain = pattern.translate({ord(own[k]): v for k, v in (("decimal-separator", "."), ("grouping-separator", ","), ("percent", "%"), ("per-mille", "‰"), ("pattern-separator", ";"), ("digit", "#"), ("zero-digit", "0"))})
    whole = plain.split(";")[0]
    if "." not in whole:
        scaled = F.when(F.isnan(x), NAN).otherwise(x)
    else:
        scaled = x
    text = F.call_function("format_number", F.when(F.isnan(scaled) | (F.abs(scaled) == INFINITY), F.lit(0.0)).otherwise(scaled), F.lit(plain))
    moves = {"decimal-separator": ".", "grouping-separator": ",", "minus-sign": "-", "percent": "%", "per-mille": "‰"}
    source, target = "".join(v for k, v in moves.items() if own[k] != v), "".join(own[k] for k, v in moves.items() if own[k] != v)
    if own["zero-digit"] != "0":
        source, target = source + "0123456789", target + "".join(chr(ord(own["zero-digit"]) + i) for i in range(10))
    text = F.translate(text, source, target) if source else text
    return F.when(F.isnan(x), own["NaN"]).when(x == INFINITY, own["infinity"]).when(x == -INFINITY, own["minus-sign"] + own["infinity"]).otherwise(text)


def url_encode(s: Column) -> Column:
    return F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))


def protect_js(s: Column) -> Column:
    """Safe within quotes of a script."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\\", r"\\\\\\\\"), "(['\"])", r"\\\\$1"), "\n", r"\\\\n")
