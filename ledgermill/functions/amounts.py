"""Reading money amounts from the text of a row and from tagged facts, by higher-order functions over its words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BARE, DECIMAL, DOTTED, DOTTED_DECIMAL, WHOLE, ZERO_WORDS
from .text import bound


def _word(token: Column, in_units: Column) -> Column:
    """``value, negative, small (a decimal under 1000), bare (one or two digits)`` of a word; null value if it is no amount."""
    stripped = F.regexp_replace(token, r"^[|:;]+|[|:;]+$", "")
    both = F.struct(stripped.alias("t"), F.regexp_replace(stripped, r"^[()\-–]+|[()\-–]+$", "").alias("core"))
    year_before = token.rlike(r"^\(?(?:19|20)\d{2}:$")
    return bound(both, lambda x: _amount(x["t"], x["core"], year_before, in_units))


def _amount(t: Column, core: Column, year_before: Column, in_units: Column) -> Column:
    def made(value: Column, small: Column | None = None, bare: bool = False) -> Column:
        negative = t.startswith("(") | t.startswith("-")
        return F.struct(value.alias("value"), negative.alias("negative"), (F.lit(False) if small is None else small).alias("small"), F.lit(bare).alias("bare"))

    number = lambda text: text.try_cast("double")
    nothing = F.struct(F.lit(None).cast("double").alias("value"), F.lit(False).alias("negative"), F.lit(False).alias("small"), F.lit(False).alias("bare"))
    zero = F.struct(F.lit(0.0).alias("value"), F.lit(False).alias("negative"), F.lit(False).alias("small"), F.lit(False).alias("bare"))
    decimal = number(F.regexp_replace(core, ",", ""))
    return (
        F.when(year_before, nothing)
        .when(F.lower(t).isin(*ZERO_WORDS), zero)
        .when(core.rlike("^[0,.]+$"), nothing)
        .when(core.rlike(WHOLE), made(decimal))
        .when(in_units & core.rlike(BARE), made(number(core), bare=True))
        .when(core.rlike(DOTTED), made(number(F.regexp_replace(core, r"\.", ""))))
        .when(core.rlike(DECIMAL), made(decimal, small=decimal < 1000))
        .when(core.rlike(DOTTED_DECIMAL), made(number(F.regexp_replace(core, r"\.(?=.*\.)", ""))))  # the last dot is the point
        .otherwise(nothing)
    )


def amounts(rest: Column, in_units: Column) -> Column:
    """The amounts after a label, in order, as array<double>. References to notes don't count: with figures in thousands or millions (``in_units``) a lone
    one- or two-digit number before two or more amounts, and decimals under 1000 unless the row has two of them."""
    words = F.split(F.regexp_replace(F.regexp_replace(rest, "£", ""), r"(?U)^\s+|\s+$", ""), r"(?U)\s+")
    found = F.filter(F.transform(words, lambda t: _word(t, in_units)), lambda x: x["value"].isNotNull())

    def without_note(a: Column) -> Column:
        lone = (F.size(a) >= 3) & (F.size(F.filter(a, lambda x: x["bare"])) == 1) & F.get(a, F.lit(0))["bare"]
        return F.when(lone, F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)

    def without_small(a: Column) -> Column:
        return F.when(F.size(F.filter(a, lambda x: x["small"])) < 2, F.filter(a, lambda x: ~x["small"])).otherwise(a)

    kept = bound(bound(found, without_note), without_small)
    return F.transform(kept, lambda x: F.when(x["negative"], -x["value"]).otherwise(x["value"]))


def fact_value(text: Column, fmt: Column, scale: Column, sign: Column) -> Column:
    """A tagged number: dashes and zero formats are 0, comma-decimal formats swap their signs; null if it can't be read."""
    t, f = F.coalesce(text, F.lit("")), F.lower(F.coalesce(fmt, F.lit("")))
    comma = f.contains("numcommadecimal") | f.contains("num-comma-decimal")
    plain = F.when(comma, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("")))
    power = F.when(scale != "", F.pow(F.lit(10.0), scale.try_cast("int")))  # a cast that fails costs as much as all the rest, and most facts have no scale
    value = F.regexp_replace(plain, r"[^0-9.]", "").try_cast("double") * F.coalesce(power, F.lit(1.0))
    zero = t.rlike("^[-–—]*$") | f.contains("zerodash") | f.contains("fixed-zero")
    return F.when(zero, 0.0).when(sign == "-", -value).otherwise(value)
