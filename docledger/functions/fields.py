"""Fields of receipt text by pattern, as column expressions; the first match wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The amount and the patterns of each field, in their order.
N = r"(\d+(?:,\d{3})*(?:[,.]\d{2})?)"
PLAIN_TOTALS = [rf"TOTAL\s*[:\-]?\s*\$?{N}", rf"AMOUNT\s*[:\-]?\s*\$?{N}"]
EUROPEAN_TOTALS = [rf"{N}\s*TOTAL", rf"BALANCE\s*[:\-]?\s*\$?{N}", rf"{N}\s*BALANCE"]
LAST_TOTALS = [rf"{N}\s+(?:TOTAL|AMOUNT|BALANCE)"]
MERCHANTS = [
    r"(?im)^(GROCERY|PRODUCE|MARKET|STORE|SHOP|PHARMACY|WALMART|TARGET|COSTCO|SAFEWAY)",
    r"(?im)^(YOUR CASHIER TODAY WAS|CASHIER)\s+(?:.+?)(?:\s+\d+)",
    r"(?im)^(.+?)\s+(?:GROCERY|MARKET|STORE)",
]
DATES = [r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", r"\d{2,4}[/-]\d{1,2}[/-]\d{1,2}", r"\w{3,9}\s+\d{1,2},?\s+\d{4}", r"\d{1,2}\s+\w{3,9}\s+\d{4}"]
ISO_DATE = r"\d{4}-\d{2}-\d{2}"
ITEM, ITEM_DOLLAR, ITEM_MARK = r"^(.+?)\s+(\d+\.\d{2})\s*$", r"^(.+?)\s+\$?(\d+\.\d{2})\s*$", r"(?i)^(.+?)\s+(\d+\.\d{2})\s+S?\s*$"
ITEM_SPLIT = r"^(.+?)\s+(\d+)\s+\.\s+(\d{2})\s*$"


def found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def total_amount(c: Column) -> Column:
    """Double or null. Most patterns drop all commas; some read a comma as the decimal point
    where there is no dot. Patterns that an earlier one subsumes are left out."""
    whole = lambda p: F.replace(found(c, f"(?i){p}"), F.lit(","), F.lit("")).try_cast("double")

    def european(p):
        x = found(c, f"(?i){p}")
        return F.when(F.contains(x, F.lit(".")), x.try_cast("double")).otherwise(F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))

    return F.coalesce(*map(whole, PLAIN_TOTALS), *map(european, EUROPEAN_TOTALS), *map(whole, LAST_TOTALS))


def price(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, r"[^\d.]", "").try_cast("double"), F.lit(0.0))


def item(line: Column) -> Column:
    """struct<description, price, quantity, unit_price> of a line, or null."""

    def two(p):
        cost = price(F.regexp_extract(line, p, 2))
        return F.when(F.regexp_like(line, F.lit(p)), F.struct(F.regexp_extract(line, p, 1).alias("description"), cost.alias("price"), F.lit(1.0).alias("quantity"), cost.alias("unit_price")))

    count, cents = price(F.regexp_extract(line, ITEM_SPLIT, 2)), price(F.regexp_extract(line, ITEM_SPLIT, 3))
    split = F.when(F.regexp_like(line, F.lit(ITEM_SPLIT)), F.struct(F.regexp_extract(line, ITEM_SPLIT, 1).alias("description"), cents.alias("price"), count.alias("quantity"), F.coalesce(F.try_divide(cents, count), cents).alias("unit_price")))
    return F.coalesce(two(ITEM), two(ITEM_DOLLAR), two(ITEM_MARK), split)


def items(c: Column) -> Column:
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_compact(F.transform(lines, item))


def merchant(c: Column) -> Column:
    return F.coalesce(*[found(c, p) for p in MERCHANTS])


def merchant_fallback(c: Column, given: Column) -> Column:
    """``given`` cut to 255 characters; else the first of the first three lines that has no digit,
    more than three characters, and does not start like a total."""
    lines = F.transform(F.slice(F.split(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), "\n"), 1, 3), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    good = F.filter(lines, lambda x: ~F.regexp_like(x, F.lit(r"\d")) & (F.char_length(x) > 3) & ~F.regexp_like(x, F.lit("(?i)^(TOTAL|SUBTOTAL|TAX)")))
    return F.when(given.isNotNull(), F.substring(given, 1, 255)).otherwise(F.get(good, F.lit(0)))


def date_string(c: Column, strict: bool = False) -> Column:
    """Unanchored patterns in order, so that an ISO date loses its century; ``strict`` tries
    ISO first."""
    first = [found(c, ISO_DATE, 0)] if strict else []
    return F.coalesce(*first, *[found(c, p, 0) for p in DATES])


def date(c: Column) -> Column:
    """ISO, month/day/year, day/month/year, else null."""
    iso = F.when(F.regexp_like(c, F.lit(rf"^{ISO_DATE}")), F.substring(c, 1, 10)).try_cast("date")
    return F.coalesce(iso, F.try_to_timestamp(c, F.lit("M/d/yyyy")).cast("date"), F.try_to_timestamp(c, F.lit("d/M/yyyy")).cast("date"))


def confidence(total: Column, n_items: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.3) + F.when(total > 0, 0.3).otherwise(0.0) + F.least(F.lit(0.4), n_items * F.lit(0.1)))


def all_fields(c: Column) -> Column:
    """struct of all fields; blank text has none and confidence 0. Every field is found once: the
    confidence is taken from the struct of the others."""
    blank = F.coalesce(F.regexp_replace(c, r"\s", "") == "", F.lit(True))
    lines = F.when(blank, F.array().cast("array<struct<description:string,price:double,quantity:double,unit_price:double>>")).otherwise(items(c))
    found_ = F.struct(total_amount(c).alias("total"), lines.alias("items"), merchant(c).alias("merchant"), date_string(c).alias("date"), blank.alias("blank"))
    sure = lambda x: F.when(x["blank"], F.lit(0.0)).otherwise(confidence(x["total"], F.size(x["items"])))
    whole = lambda x: F.struct(x["total"].alias("total"), x["items"].alias("items"), x["merchant"].alias("merchant"), x["date"].alias("date"), sure(x).alias("confidence"))
    return F.get(F.transform(F.array(found_), whole), F.lit(0))
