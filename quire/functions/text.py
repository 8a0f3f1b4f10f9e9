"""String helpers shared by every operator.

JavaScript's ``\\s`` / ``trim`` and Java's ``\\s`` disagree, so whitespace is an
explicit class that Java regex and RE2 both read the same way.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as JavaScript's \s and String.prototype.trim see it.
WS = (r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
      r"\x{202F}\x{205F}\x{3000}\x{FEFF}]")
# Characters JavaScript's '.' does not match.
LINE_END = r"\n\r\x{2028}\x{2029}"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c) -> Column:
    """JavaScript ``trim()``."""
    return F.regexp_replace(col(c), rf"^{WS}+|{WS}+\z", "")


def rtrim_ws(c) -> Column:
    """JavaScript ``trimEnd()``."""
    return F.regexp_replace(col(c), rf"{WS}+\z", "")


def lines(c) -> Column:
    """``content.split('\\n')`` keeping trailing empty strings."""
    return F.split(col(c), "\n", -1)


def ensure_trailing_newline(c) -> Column:
    c = col(c)
    return F.when(c.endswith("\n"), c).otherwise(F.concat(c, F.lit("\n")))


def xml_escape(c) -> Column:
    c = col(c)
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def format_size(c) -> Column:
    """Bytes as ``N B`` / ``x.y KB`` / ``x.yy MB``; rounding half-up as in
    JavaScript ``toFixed`` (exact, since the divisors are powers of two)."""
    b = col(c).cast("long")
    kb = F.floor((b * 10 + 512) / 1024).cast("long")
    mb = F.floor((b * 100 + 524288) / 1048576).cast("long")
    return (F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B")))
            .when(b < 1048576, F.concat((kb / 10).cast("long").cast("string"), F.lit("."),
                                        (kb % 10).cast("string"), F.lit(" KB")))
            .otherwise(F.concat((mb / 100).cast("long").cast("string"), F.lit("."),
                                F.lpad((mb % 100).cast("string"), 2, "0"), F.lit(" MB"))))


def format_bytes(c) -> Column:
    """Like :func:`format_size` but megabytes with one decimal."""
    b = col(c).cast("long")
    kb = F.floor((b * 10 + 512) / 1024).cast("long")
    mb = F.floor((b * 10 + 524288) / 1048576).cast("long")
    return (F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B")))
            .when(b < 1048576, F.concat((kb / 10).cast("long").cast("string"), F.lit("."),
                                        (kb % 10).cast("string"), F.lit(" KB")))
            .otherwise(F.concat((mb / 10).cast("long").cast("string"), F.lit("."),
                                (mb % 10).cast("string"), F.lit(" MB"))))


def format_number(c) -> Column:
    """Integer with thousands separators (``toLocaleString`` in en-US)."""
    return F.format_number(col(c).cast("long"), 0)


def format_money(c) -> Column:
    """``$`` and two decimals, rounded half-up on the binary value (not on its
    shortest decimal form): the fraction's first 52 binary digits are an
    integer, and so is what the digits after them add to a hundredfold of it."""
    x = col(c).cast("double")
    size = F.abs(x)
    whole = F.floor(size)
    scaled = (size - whole) * F.lit(float(1 << 52))
    digits = F.floor(scaled).cast("long")
    cents = whole * 100 + F.shiftright(digits * 100 + F.floor((scaled - digits) * 100).cast("long") + F.lit(1 << 51), 52)
    text = F.concat((cents / 100).cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.concat(F.lit("$"), F.when((x < 0) & (cents > 0), F.lit("-")).otherwise(F.lit("")), text)


def js_round(c) -> Column:
    """``Math.round``: half toward +infinity."""
    return F.floor(col(c) + F.lit(0.5)).cast("long")
