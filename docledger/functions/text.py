"""Cleaning of scanned text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters peeled off a word before it is corrected, at most one at each end.
PEEL = r"""([.,;:!?()\[\]{}"']?)"""
PRICED = r"\$\d+[.,]\d{2}|\d+[.,]\d{2}\$"
#: Misread keywords and what they stand for.
KEYWORDS = {"T0TAL": "TOTAL", "AM0UNT": "AMOUNT", "SUBT0TAL": "SUBTOTAL", "CUST0MER": "CUSTOMER", "CASHIER": "CASHIER"}


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def whitespace(c: Column) -> Column:
    """Runs of blanks become one space, blank lines go, and the ends are trimmed."""
    return trimmed(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n\s*\n", "\n"))


def confusions(word: Column) -> Column:
    """O, I and S become 0, 1 and 5 in a word that holds a marked price."""
    return F.when(F.regexp_like(word, F.lit(PRICED)), F.translate(word, "OIS", "015")).otherwise(word)


def decimal_comma(word: Column) -> Column:
    """Every comma becomes a dot in a word that holds a price with a comma."""
    return F.when(F.regexp_like(word, F.lit(r"\d+,\d{2}")), F.translate(word, ",", ".")).otherwise(word)


def corrected_word(word: Column) -> Column:
    parts = [F.regexp_extract(word, rf"(?s)^{PEEL}(.*?){PEEL}$", k) for k in (1, 2, 3)]
    return F.concat(parts[0], decimal_comma(confusions(parts[1])), parts[2])


def corrected(c: Column) -> Column:
    """Each word corrected; words are joined by one space, so line ends are lost."""
    return F.array_join(F.transform(F.split(trimmed(c), r"(?U)\s+"), corrected_word), " ")


def keywords(c: Column) -> Column:
    for wrong, right in KEYWORDS.items():
        c = F.regexp_replace(c, rf"(?iU)\b{wrong}\b", right)
    return c


def focused(c: Column) -> Column:
    """Stripped lines with a total keyword or a price; if there are none, all lines, of more
    than six the first and last three."""
    lines = F.transform(F.split(trimmed(c), "\n"), trimmed)
    hits = F.filter(lines, lambda x: F.regexp_like(x, F.lit(r"(?i)TOTAL|AMOUNT|BALANCE|\d+\.\d{2}")))
    ends = F.when(F.size(lines) > 6, F.concat(F.slice(lines, 1, 3), F.slice(lines, -3, 3))).otherwise(lines)
    return F.array_join(F.when(F.size(hits) > 0, hits).otherwise(ends), "\n")


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != ""))


def comparison(a: Column, b: Column) -> dict[str, Column]:
    """Lengths and word overlap (percent of the larger word set) of two readings."""
    common = F.size(F.array_intersect(word_set(a), word_set(b)))
    most = F.greatest(F.size(word_set(a)), F.size(word_set(b)))
    return {
        "len_a": F.char_length(a).cast("long"),
        "len_b": F.char_length(b).cast("long"),
        "len_diff": F.abs(F.char_length(a) - F.char_length(b)).cast("long"),
        "common": common.cast("long"),
        "overlap": F.coalesce(F.try_divide(common * F.lit(100.0), most), F.lit(0.0)),
    }
