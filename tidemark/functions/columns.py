"""Column functions: cleaning, parsing, recoding and unit conversion."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_PATTERN = r"([<>]\s*)?[-+]?\d*\.\d+|\d+\.?\d*"


def map_literal(mapping: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def lookup(col: Column, mapping: dict[str, object]) -> Column:
    """Mapped value or NULL."""
    return F.try_element_at(map_literal(mapping), col) if mapping else F.lit(None).cast("string")


def rename_values(col: Column, mapping: dict[str, str]) -> Column:
    """Mapped value, the input where the mapping has none."""
    return F.coalesce(lookup(col, mapping), col)


def to_number(col: Column) -> Column:
    return col.cast("string").try_cast("double")


def parse_number(col: Column) -> Column:
    """Number behind an optional ``<`` or ``>``."""
    return F.regexp_replace(F.trim(col), r"^[<>]\s*", "").try_cast("double")


def clean_lab_text(col: Column) -> Column:
    """Decimal comma to point, stars dropped."""
    return F.regexp_replace(F.regexp_replace(col, ",", "."), r"\*", "")


def lab_number(col: Column) -> Column:
    """Numeric laboratory value; NULL when the text holds no number."""
    text = clean_lab_text(col)
    return F.when(text.rlike(NUMBER_PATTERN), F.regexp_replace(text, "[<>]", "").try_cast("double"))


def strip_score(col: Column) -> Column:
    """``"120/70 (0)"`` to ``"120/70"``."""
    return F.trim(F.substring_index(col, "(", 1))


def pair_part(col: Column, i: int) -> Column:
    """i-th part of ``"120/70"`` (0 or 1); NULL when absent."""
    return F.get(F.split(col, "/", 2), F.lit(i))


def fahrenheit_to_celsius(col: Column) -> Column:
    return (col - 32) * 5.0 / 9.0


# Unit factors.
UNIT_FACTORS = {
    "inch_cm": 2.54,
    "feet_cm": 30.48,
    "pound_kg": 0.45359237,
    "ounce_kg": 0.0283495231,
}


def convert(col: Column, unit: str) -> Column:
    return col * UNIT_FACTORS[unit]


def round_even(col: Column, decimals: int) -> Column:
    """Round half to even on the scaled double."""
    scale = float(10**decimals)
    return F.rint(col * scale) / scale


def scaled(col: Column, factor: float | None, decimals: int = 2) -> Column:
    """Number times factor, rounded; the raw text where it is not a number."""
    number = to_number(col) * (1.0 if factor is None else factor)
    return F.coalesce(round_even(number, decimals).cast("string"), col.cast("string"))


def within_bounds(feature: Column, value: Column, bounds: dict[str, tuple[float, float]]) -> Column:
    """True unless the value is numeric and outside its feature's range."""
    number = value if not isinstance(value, str) else F.col(value)
    number = to_number(number)
    lo = lookup(feature, {k: v[0] for k, v in bounds.items()})
    hi = lookup(feature, {k: v[1] for k, v in bounds.items()})
    return F.coalesce((number >= lo) & (number <= hi), F.lit(True))


def normal_id(col: Column) -> Column:
    """Id as text without a trailing ``.0``."""
    return F.regexp_replace(col.cast("string"), r"\.0$", "")


def empty_to_null(col: Column) -> Column:
    """Empty text and a pair of quotes are missing."""
    return F.when(~col.isin("", '""', "''"), col)


def normal_diagnosis(col: Column) -> Column:
    """Code without its first and last character."""
    return F.substring(col, 2, F.greatest(F.length(col) - 2, F.lit(0)))


def compact_code(col: Column) -> Column:
    """Upper case without dots and blanks."""
    return F.upper(F.regexp_replace(col, r"[.\s]", ""))


def parse_timestamp(col: Column) -> Column:
    """ISO text, else ``22FEB2018:13:40:02.2750``; NULL when neither fits."""
    month = F.initcap(F.substring(col, 3, 3))
    sas = F.concat(F.substring(col, 1, 2), month, F.substring(col, 6, 100))
    # the fraction may have any number of digits: cut or pad it to microseconds
    sas = F.rpad(F.when(sas.contains("."), sas).otherwise(F.concat(sas, F.lit("."))), 25, "0")
    iso = col.try_cast("timestamp_ntz")
    parsed = F.try_to_timestamp(sas, F.lit("ddMMMyyyy:HH:mm:ss.SSSSSS")).cast("timestamp_ntz")
    looks_sas = col.rlike(r"^\d{2}[A-Za-z]{3}\d{4}:")
    return F.coalesce(F.when(~looks_sas, iso), F.when(looks_sas, parsed))


def has_keyword(text: Column, keywords: list[str]) -> Column:
    """Case-insensitive match of any keyword; NULL text is False."""
    return F.coalesce(text.rlike("(?iu)" + "|".join(keywords)), F.lit(False))


def not_after(ts: Column, base: Column, hours: float) -> Column:
    """One-sided window: at most ``hours`` after the base time."""
    return F.coalesce(ts <= base + F.expr(f"make_dt_interval(0, 0, 0, {hours * 3600:.6f})"), F.lit(False))


def not_in(col: Column, values: list[str]) -> Column:
    """Null-aware drop list: NULL values go as well."""
    return F.coalesce(~col.isin(*values), F.lit(False))


def clip(col: Column, lo: float, hi: float) -> Column:
    """Clip to a range; NULL stays NULL."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(lo)), F.lit(hi)))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
