"""Quality score of scanned text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

#: Points, thresholds and patterns of the score.
PRICE, SPACED = r"\$?\d+\.\d{2}", r"(?<!\d)\d{1,2}\s+\d{2}(?!\d)"
KEYWORDS = ("total", "subtotal", "amount")
NOISE = r"(?U)[^\w\s$.,%\-:/\n]"
FALLBACK = 0.25


def words(c: Column) -> Column:
    return F.filter(F.split(trimmed(c), r"(?U)\s+"), lambda w: w != "")


def length_points(c: Column) -> Column:
    return F.least(F.char_length(trimmed(c)) / F.lit(10.0), F.lit(20.0))


def price_points(c: Column) -> Column:
    n = F.regexp_count(c, F.lit(PRICE)) + F.regexp_count(c, F.lit(SPACED)) * F.lit(0.5)
    return F.least(n * F.lit(5.0), F.lit(25.0))


def keyword_count(c: Column) -> Column:
    seen = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b(\w+)\b"), F.lit(1))
    return F.size(F.array_intersect(F.array(*map(F.lit, KEYWORDS)), seen))


def keyword_points(c: Column) -> Column:
    return F.least(keyword_count(c) * F.lit(7.0), F.lit(20.0))


def word_points(c: Column) -> Column:
    def valid(w):
        clean = F.regexp_replace(w, r"^[$,.:;]+|[$,.:;]+$", "")
        number = F.regexp_like(clean, F.lit(r"^\d{1,6}$"))
        return F.regexp_like(w, F.lit(r"\p{L}")) | F.regexp_like(clean, F.lit(r"^\$?\d+\.\d{2}$")) | number

    w = words(c)
    return F.coalesce(F.try_divide(F.size(F.filter(w, valid)), F.size(w)) * F.lit(25.0), F.lit(0.0))


def noise_points(c: Column) -> Column:
    ratio = F.try_divide(F.regexp_count(c, F.lit(NOISE)), F.char_length(trimmed(c)))
    return F.when(ratio > 0.3, F.lit(4.0)).otherwise(F.lit(0.0))


def score(c: Column) -> Column:
    """0 to 1; blank text 0, and at most 0.4 without a price and without a keyword."""
    raw = (length_points(c) + price_points(c) + keyword_points(c) + word_points(c) - noise_points(c)) / F.lit(100.0)
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    bare = (F.regexp_count(c, F.lit(PRICE)) == 0) & (keyword_count(c) == 0)
    blank = F.coalesce(trimmed(c) == "", F.lit(True))
    return F.when(blank, F.lit(0.0)).when(bare, F.least(s, F.lit(0.4))).otherwise(s)


def breakdown(c: Column) -> Column:
    parts = {"text_length": (length_points(c), 20.0), "price_patterns": (price_points(c), 25.0), "total_keyword": (keyword_points(c), 20.0), "word_quality": (word_points(c), 25.0), "noise_penalty": (noise_points(c), 10.0)}
    shares = F.struct(*[(p / F.lit(m)).alias(k) for k, (p, m) in parts.items()])
    points = F.struct(*[p.alias(k) for k, (p, _) in parts.items()])
    stats = F.struct(F.char_length(trimmed(c)).alias("length"), F.size(words(c)).alias("word_count"), F.size(F.split(c, "\n")).alias("line_count"))
    return F.struct(score(c).alias("total_score"), shares.alias("components"), points.alias("points"), stats.alias("stats"))


def falls_back(c: Column, threshold: float = FALLBACK) -> Column:
    return score(c) < threshold


#: Wording of the reasons, in the order of their tests; the first has the length between its parts, the last
#: stands for none.
REASONS = (
    ("Text too short (", " chars)"), "Insufficient price patterns detected", "Missing TOTAL/AMOUNT keywords", "Low word quality (many noisy tokens)", "Excessive special characters/noise", "General quality concerns",
)


def reasoning(c: Column) -> Column:
    """Why a text scores low, in words."""
    short = F.concat(F.lit(REASONS[0][0]), F.char_length(c).cast("string"), F.lit(REASONS[0][1]))
    tests = [
        (length_points(c) / 20.0 < 0.5, short), (price_points(c) / 25.0 < 0.6, F.lit(REASONS[1])), (keyword_points(c) / 20.0 < 0.5, F.lit(REASONS[2])),
        (word_points(c) / 25.0 < 0.6, F.lit(REASONS[3])), (noise_points(c) / 10.0 > 0.5, F.lit(REASONS[4])),
    ]
    text = F.array_join(F.array_compact(F.array(*[F.when(t, m) for t, m in tests])), "; ")
    return F.when(text == "", REASONS[5]).otherwise(text)
