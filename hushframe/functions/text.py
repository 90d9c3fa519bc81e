"""One text for each real, as a Python value and as a column: labels, constants, casts and sinks must agree on it.

The shortest digits that give the real back; plain from 1e-4 to below 1e15, else with an exponent of two digits or more (1E+15, 1.5E-07).
Of a few reals that need 17 digits both forms can end in different ones, where the Java runtime is older than 19.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions.hashing import let

#: Decimal exponents of reals that are written without one (fixed values).
LEAST_PLAIN, MOST_PLAIN = -4, 14


def real_text(x: float) -> str:
    if not math.isfinite(x):
        return "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    sign = "-" if math.copysign(1.0, x) < 0 else ""
    if x == 0:
        return f"{sign}0"
    found = Decimal(repr(abs(x))).normalize()
    digits, e = "".join(map(str, found.as_tuple().digits)), found.adjusted()
    if not LEAST_PLAIN <= e <= MOST_PLAIN:
        return f"{sign}{digits[0]}{'.' * (len(digits) > 1)}{digits[1:]}E{'-' if e < 0 else '+'}{abs(e):02d}"
    if e < 0:
        return f"{sign}0.{'0' * (-e - 1)}{digits}"
    return sign + (digits.ljust(e + 1, "0") if len(digits) <= e + 1 else f"{digits[: e + 1]}.{digits[e + 1 :]}")


def real_column(x: Column) -> Column:
    def shortest(t: Column) -> Column:
        # Some Java runtimes write more digits than needed; the fewest that give the real back are looked for where there are many.
        digits = F.length(F.regexp_replace(F.regexp_replace(t, "E.*$", ""), r"[^\d]", ""))
        fewer = [F.format_string(f"%.{n}e", x) for n in (14, 15, 16)]
        return F.when(t.isNull() | (digits <= 15), t).otherwise(F.coalesce(*(F.when(s.cast("double") == x, s) for s in fewer), t))

    def plain(t: Column) -> Column:
        part = lambda i: F.regexp_extract(t, r"^(-?)(\d)\.(\d*)[eE]\+?(-?\d+)$", i)
        more = F.regexp_replace(part(3), r"0+$", "")
        digits, e = F.concat(part(2), more), part(4).cast("int")
        size = F.length(digits)
        large = F.when(size <= e + 1, F.rpad(digits, e + 1, F.lit("0"))).otherwise(F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, size)))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        power = F.abs(e).cast("string")
        powered = F.concat(part(2), F.when(more != "", F.concat(F.lit("."), more)).otherwise(""), F.when(e < 0, "E-").otherwise("E+"), F.when(F.length(power) < 2, "0").otherwise(""), power)
        shown = F.when((e >= 0) & (e <= MOST_PLAIN), large).when((e < 0) & (e >= LEAST_PLAIN), small).otherwise(powered)
        return F.when(F.rlike(t, F.lit("[eE]")), F.concat(part(1), shown)).otherwise(F.regexp_replace(t, r"\.0$", ""))

    return let(let(x.cast("string"), shortest), plain)
