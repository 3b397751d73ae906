"""Column expressions that cleanse business data."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_AVAILABLE = "n/a"

#: Codes and what they stand for.
MARITAL = {"S": "Single", "M": "Married"}
GENDER = {"F": "Female", "M": "Male"}
GENDER_WORDS = {"F": "Female", "FEMALE": "Female", "M": "Male", "MALE": "Male"}
PRODUCT_LINE = {"M": "Mountain", "R": "Road", "S": "Other Sales", "T": "Touring"}
COUNTRY = {"DE": "Germany", "US": "United States", "USA": "United States"}


def decode(value: Column, names: dict[str, str], default: str | None = NOT_AVAILABLE) -> Column:
    """The name for a code, whatever its case and outer blanks; default for others and null."""
    code = F.upper(F.trim(value))
    out = F.lit(default)
    for k, v in reversed(names.items()):
        out = F.when(code == k, v).otherwise(out)
    return out


def country(value: Column) -> Column:
    """Codes become names, blanks and nulls n/a; other names stay, trimmed."""
    name = F.trim(value)
    out = F.when(name.isNull() | (name == ""), NOT_AVAILABLE).otherwise(name)
    for k, v in COUNTRY.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def category_of(key: Column) -> Column:
    """The first five characters of a product key, with - as _."""
    return F.replace(F.substring(key, 1, 5), F.lit("-"), F.lit("_"))


def product_of(key: Column) -> Column:
    """A product key from its seventh character on."""
    return F.substring(key, 7, 2147483647)


def without_prefix(value: Column, prefix: str) -> Column:
    clean = F.trim(value)
    return F.when(clean.startswith(prefix), F.substring(clean, len(prefix) + 1, 2147483647)).otherwise(clean)


def without_dashes(value: Column) -> Column:
    return F.replace(F.trim(value), F.lit("-"), F.lit(""))


def date_of(yyyymmdd: Column) -> Column:
    """A whole number as a date; null unless it has eight digits and is one."""
    digits = yyyymmdd.cast("string")
    return F.when(F.length(digits) == 8, F.try_to_date(digits, "yyyyMMdd"))


def not_after(day: Column, as_of: date | None = None) -> Column:
    """The day, or null if it is after as_of (today unless given)."""
    limit = F.lit(as_of) if as_of else F.current_date()
    return F.when(day > limit, None).otherwise(day)


def repaired_sales(sales: Column, quantity: Column, price: Column) -> Column:
    """quantity * |price| if sales is null, not positive, or differs; a null price leaves sales that are positive."""
    right = quantity * F.abs(price)
    return F.when(sales.isNull() | (sales <= 0) | (sales != right), right).otherwise(sales)


def repaired_price(price: Column, sales: Column, quantity: Column) -> Column:
    """sales div quantity (whole numbers, null for quantity 0) if price is null or not positive. sales: repaired."""
    return F.when(price.isNull() | (price <= 0), F.call_function("div", sales, F.nullif(quantity, F.lit(0)))).otherwise(price)
