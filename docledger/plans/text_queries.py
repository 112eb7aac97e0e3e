"""Text queries: cleaning, field extraction, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields, quality, text
from ..operators import layout
from .registry import query

TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')".format


def _slips(v, **columns):
    return v.slips.select("doc_id", *[c.alias(k) for k, c in columns.items()])


def T():
    return F.col("text")


@query("TXT1", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n\s*\n', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM slips")
def whitespace(v):
    return _slips(v, cleaned=text.whitespace(T()))


WORDS = r"""list_transform(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+'), lambda w: {0})"""
PEELED = r"""^([.,;:!?()\[\]{}"'']?)(.*?)([.,;:!?()\[\]{}"'']?)$"""
CORE = f"regexp_extract(w, '{PEELED}', 2)"
CONFUSED = r"CASE WHEN regexp_matches({0}, '\$\d+[.,]\d{{2}}|\d+[.,]\d{{2}}\$') THEN translate({0}, 'OIS', '015') ELSE {0} END".format
COMMA = r"CASE WHEN regexp_matches({0}, '\d+,\d{{2}}') THEN replace({0}, ',', '.') ELSE {0} END".format


@query("TXT2", "SELECT doc_id, array_to_string(" + WORDS.replace("{0}", f"regexp_extract(w, '{PEELED}', 1) || {COMMA('(' + CONFUSED(CORE) + ')')} || regexp_extract(w, '{PEELED}', 3)") + ", ' ') AS cleaned FROM slips")
def word_correction(v):
    return _slips(v, cleaned=text.corrected(T()))


@query("TXT3", "SELECT doc_id, array_to_string(" + WORDS.replace("{0}", CONFUSED("w")) + ", ' ') AS cleaned FROM slips")
def confusions(v):
    words = F.transform(F.split(text.trimmed(T()), r"(?U)\s+"), text.confusions)
    return _slips(v, cleaned=F.array_join(words, " "))


@query("TXT4", "SELECT doc_id, array_to_string(" + WORDS.replace("{0}", COMMA("w")) + ", ' ') AS cleaned FROM slips")
def decimal_commas(v):
    words = F.transform(F.split(text.trimmed(T()), r"(?U)\s+"), text.decimal_comma)
    return _slips(v, cleaned=F.array_join(words, " "))


@query("TXT5", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\bT0TAL\b', 'TOTAL', 'g'), '(?i)\bAM0UNT\b', 'AMOUNT', 'g'),
    '(?i)\bSUBT0TAL\b', 'SUBTOTAL', 'g'), '(?i)\bCUST0MER\b', 'CUSTOMER', 'g'), '(?i)\bCASHIER\b', 'CASHIER', 'g') AS cleaned FROM slips""")
def keyword_repairs(v):
    return _slips(v, cleaned=text.keywords(T()))


# fragments: a word of a slip line each, with a made-up place and confidence by position
def _fragments(v):
    lines = v.slips.where("text is not null").select("doc_id", F.posexplode(F.split(T(), "\n")).alias("row", "line"))
    words = lines.select("doc_id", "row", F.posexplode(F.split("line", " ")).alias("col", "text"))
    y = (F.col("row") * 10 + F.col("col") % 3 * 3 - F.col("row") % 2).cast("double")
    conf = (F.col("doc_id") * 7 + F.col("row") * 3 + F.col("col") * 5) % 10 / 10.0
    return words.select("doc_id", "row", "col", (F.col("col") * 50.0).alias("x"), y.alias("y"), (y + 12 + F.col("doc_id") % 9).alias("y_bottom"), "text", conf.alias("confidence"))


FRAGMENTS = r"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS "row" FROM slips),
frags AS (SELECT doc_id, "row", unnest(string_split(line, ' ')) AS text, generate_subscripts(string_split(line, ' '), 1) - 1 AS col FROM lines),
fragments AS (SELECT doc_id, "row", col, text, col * CAST(50 AS DOUBLE) AS x, CAST("row" * 10 + col % 3 * 3 - "row" % 2 AS DOUBLE) AS y, CAST(12 + doc_id % 9 AS DOUBLE) AS height, ((doc_id * 7 + "row" * 3 + col * 5) % 10) / CAST(10 AS DOUBLE) AS confidence FROM frags)"""


@query("TXT6", r"""SELECT doc_id, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM fragments WHERE confidence >= 0.7 AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''""", FRAGMENTS)
def fragment_filter(v):
    f = _fragments(v).withColumn("text", text.trimmed(T()))
    return f.where("confidence >= 0.7 and text <> ''").select("doc_id", "row", "col", "text")


#: The fold over a page's fragments, all pages at once: the k-th fragment joins the line of the one before or starts another.
FOLDED = FRAGMENTS + r""", sorted AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y, "row", col) AS k, avg(height) OVER (PARTITION BY doc_id) / 2 AS near FROM fragments WHERE text <> ''),
folded AS (SELECT doc_id, k, 1 AS line, y AS total, 1 AS n FROM sorted WHERE k = 1 UNION ALL
  SELECT s.doc_id, s.k, f.line + CASE WHEN abs(s.y - f.total / f.n) <= near THEN 0 ELSE 1 END, CASE WHEN abs(s.y - f.total / f.n) <= near THEN f.total + s.y ELSE s.y END, CASE WHEN abs(s.y - f.total / f.n) <= near THEN f.n + 1 ELSE 1 END
  FROM folded f JOIN sorted s ON s.doc_id = f.doc_id AND s.k = f.k + 1),
page_lines AS (SELECT doc_id, line, string_agg(text, ' ' ORDER BY x, k) AS text FROM folded JOIN sorted USING (doc_id, k) GROUP BY 1, 2)"""


@query("TXT7", "SELECT s.doc_id, coalesce(string_agg(l.text, chr(10) ORDER BY line), '') AS text FROM slips s LEFT JOIN page_lines l USING (doc_id) WHERE s.text IS NOT NULL GROUP BY 1", FOLDED)
def line_reconstruction(v):
    return layout.reconstructed(_fragments(v), ["row", "col"])


FOCUS = r"""SELECT doc_id, array_to_string(CASE WHEN len(hits) > 0 THEN hits WHEN len(l) > 6 THEN list_concat(l[1:3], l[-3:]) ELSE l END, chr(10)) AS context
    FROM (SELECT doc_id, l, list_filter(l, lambda x: regexp_matches(x, '(?i)TOTAL|AMOUNT|BALANCE|\d+\.\d{2}')) AS hits
    FROM (SELECT doc_id, list_transform(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS l FROM slips))"""


@query("TXT8", FOCUS)
def focused_context(v):
    return _slips(v, context=text.focused(T()))


@query("TXT10", r"""SELECT doc_id, length(a) AS len_a, length(b) AS len_b, abs(length(a) - length(b)) AS len_diff, CAST(len(list_intersect(wa, wb)) AS BIGINT) AS common,
    len(list_intersect(wa, wb)) * CAST(100 AS DOUBLE) / greatest(len(wa), len(wb)) AS overlap
    FROM (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(a), '\s+'), lambda x: x <> '')) AS wa, list_distinct(list_filter(regexp_split_to_array(lower(b), '\s+'), lambda x: x <> '')) AS wb
    FROM (SELECT doc_id, text AS a, replace(text, '.', ',') AS b FROM slips))""")
def text_comparison(v):
    return _slips(v, **text.comparison(T(), F.replace(T(), F.lit("."), F.lit(","))))


# ---- fields; fixed values: the patterns of each field, as ``functions.fields`` has them
NUM = r"(\d+(?:,\d{3})*(?:[,.]\d{2})?)"
_WHOLE = r"try_cast(replace(nullif(regexp_extract(text, '(?i){0}', 1), ''), ',', '') AS DOUBLE)"
_EURO = r"CASE WHEN contains(regexp_extract(text, '(?i){0}', 1), '.') THEN try_cast(regexp_extract(text, '(?i){0}', 1) AS DOUBLE) ELSE try_cast(replace(nullif(regexp_extract(text, '(?i){0}', 1), ''), ',', '.') AS DOUBLE) END"
TOTAL = "coalesce(" + ", ".join(
    [_WHOLE.replace("{0}", p) for p in (rf"TOTAL\s*[:\-]?\s*\$?{NUM}", rf"AMOUNT\s*[:\-]?\s*\$?{NUM}")]
    + [_EURO.replace("{0}", p) for p in (rf"{NUM}\s*TOTAL", rf"BALANCE\s*[:\-]?\s*\$?{NUM}", rf"{NUM}\s*BALANCE")]
    + [_WHOLE.replace("{0}", rf"{NUM}\s+(?:TOTAL|AMOUNT|BALANCE)")]
) + ")"
P1, P4, P6 = r"^(.+?)\s+(\d+\.\d{2})\s*$", r"^(.+?)\s+\$?(\d+\.\d{2})\s*$", r"^(.+?)\s+(\d+)\s+\.\s+(\d{2})\s*$"
LINES = r"""slip_lines AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS raw FROM slips),
stripped AS (SELECT doc_id, line_no, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM slip_lines),
found AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(line, 'P1') THEN regexp_extract(line, 'P1', 1) WHEN regexp_matches(line, 'P4') THEN regexp_extract(line, 'P4', 1) WHEN regexp_matches(line, 'P6') THEN regexp_extract(line, 'P6', 1) END AS description,
  CAST(CASE WHEN regexp_matches(line, 'P1') THEN regexp_extract(line, 'P1', 2) WHEN regexp_matches(line, 'P4') THEN regexp_extract(line, 'P4', 2) WHEN regexp_matches(line, 'P6') THEN regexp_extract(line, 'P6', 3) END AS DOUBLE) AS price FROM stripped)""".replace("P1", P1).replace("P4", P4).replace("P6", P6)


@query("EXT1", f"SELECT doc_id, {TOTAL} AS total FROM slips")
def total(v):
    return _slips(v, total=fields.total_amount(T()))


@query("EXT2", "SELECT doc_id, line_no, description, price FROM found WHERE description IS NOT NULL", LINES)
def item_lines(v):
    lines = v.slips.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    found = lines.withColumn("i", fields.item(text.trimmed(F.col("line")))).where("i is not null")
    return found.select("doc_id", (F.col("pos") + 1).alias("line_no"), "i.description", "i.price")


@query("EXT3", r"SELECT doc_id, line_no, coalesce(try_cast(regexp_replace(line, '[^\d.]', '', 'g') AS DOUBLE), 0) AS price FROM stripped", LINES)
def price_parse(v):
    lines = v.slips.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", (F.col("pos") + 1).alias("line_no"), fields.price(text.trimmed(F.col("line"))).alias("price"))


M = [r"(?im)^(GROCERY|PRODUCE|MARKET|STORE|SHOP|PHARMACY|WALMART|TARGET|COSTCO|SAFEWAY)", r"(?im)^(YOUR CASHIER TODAY WAS|CASHIER)\s+(?:.+?)(?:\s+\d+)", r"(?im)^(.+?)\s+(?:GROCERY|MARKET|STORE)"]
MERCHANT = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}', 1), '')" for p in M) + ")"


@query("EXT4", f"SELECT doc_id, {MERCHANT} AS merchant FROM slips")
def merchant(v):
    return _slips(v, merchant=fields.merchant(T()))


@query("EXT5", r"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Store ' || doc_id ELSE list_filter(list_transform(string_split(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10))[1:3], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
    lambda x: NOT regexp_matches(x, '\d') AND length(x) > 3 AND NOT regexp_matches(x, '(?i)^(TOTAL|SUBTOTAL|TAX)'))[1] END AS merchant FROM slips""")
def merchant_fallback(v):
    given = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Store "), F.col("doc_id").cast("string")))
    return _slips(v, merchant=fields.merchant_fallback(T(), given))


D = [r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", r"\d{2,4}[/-]\d{1,2}[/-]\d{1,2}", r"\w{3,9}\s+\d{1,2},?\s+\d{4}", r"\d{1,2}\s+\w{3,9}\s+\d{4}"]
WRITTEN = """written AS (SELECT id AS doc_id, CASE id % 6 WHEN 0 THEN strftime(receipt_date, '%Y-%m-%d') WHEN 1 THEN strftime(receipt_date, '%m/%d/%Y') WHEN 2 THEN strftime(receipt_date, '%d/%m/%Y')
  WHEN 3 THEN strftime(receipt_date, '%Y-%m-%d') || 'T10:00:00Z' WHEN 4 THEN 'bought ' || strftime(receipt_date, '%B %d, %Y') ELSE 'no date' END AS text FROM purchases)"""


def _written(v):
    k, d = F.col("id") % 6, F.col("receipt_date")
    f = lambda p: F.date_format(d, p)
    t = F.when(k == 0, f("yyyy-MM-dd")).when(k == 1, f("MM/dd/yyyy")).when(k == 2, f("dd/MM/yyyy")).when(k == 3, F.concat(f("yyyy-MM-dd"), F.lit("T10:00:00Z"))).when(k == 4, F.concat(F.lit("bought "), f("MMMM dd, yyyy"))).otherwise("no date")
    return v.purchases.select(F.col("id").alias("doc_id"), t.alias("text"))


@query("EXT6", "SELECT doc_id, coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}'), '')" for p in D) + ") AS date FROM written", WRITTEN)
def date_string(v):
    return _written(v).select("doc_id", fields.date_string(T()).alias("date"))


@query("EXT7", r"""SELECT doc_id, CAST(coalesce(CASE WHEN regexp_matches(text, '^\d{4}-\d{2}-\d{2}') THEN try_cast(left(text, 10) AS DATE) END, CAST(try_strptime(text, '%m/%d/%Y') AS DATE), CAST(try_strptime(text, '%d/%m/%Y') AS DATE)) AS VARCHAR) AS date FROM written""", WRITTEN)
def date_parse(v):
    return _written(v).select("doc_id", fields.date(T()).cast("string").alias("date"))


@query("EXT8", f"SELECT s.doc_id, least(CAST(1 AS DOUBLE), CAST(0.3 AS DOUBLE) + CASE WHEN {TOTAL} > 0 THEN CAST(0.3 AS DOUBLE) ELSE 0 END + least(CAST(0.4 AS DOUBLE), n * CAST(0.1 AS DOUBLE))) AS confidence FROM slips s JOIN (SELECT doc_id, count(description) AS n FROM found GROUP BY 1) USING (doc_id)", LINES)
def confidence(v):
    return _slips(v, confidence=fields.confidence(fields.total_amount(T()), F.size(fields.items(T()))))


DATE = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{p}'), '')" for p in D) + ")"


@query(
    "EXT9",
    f"""SELECT s.doc_id, {TOTAL} AS total, n AS n_items, {MERCHANT} AS merchant, {DATE} AS date, least(CAST(1 AS DOUBLE), CAST(0.3 AS DOUBLE) + CASE WHEN {TOTAL} > 0 THEN CAST(0.3 AS DOUBLE) ELSE 0 END + least(CAST(0.4 AS DOUBLE), n * CAST(0.1 AS DOUBLE))) AS confidence
    FROM slips s JOIN (SELECT doc_id, count(description) AS n FROM found GROUP BY 1) USING (doc_id)""",
    LINES,
)
def all_fields(v):
    f = v.slips.select("doc_id", fields.all_fields(T()).alias("f"))
    return f.select("doc_id", "f.total", F.size("f.items").cast("long").alias("n_items"), "f.merchant", "f.date", "f.confidence")


# ---- quality; slips hold no prices with a space, so that the SQL needs no look-behind
ST = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
NP = r"len(regexp_extract_all(text, '\$?\d+\.\d{2}'))"
KW = r"len(list_intersect(['total', 'subtotal', 'amount'], regexp_extract_all(lower(text), '\b\w+\b')))"
WL = rf"list_filter(regexp_split_to_array({ST}, '\s+'), lambda w: w <> '')"
OKW = r"regexp_matches(w, '[A-Za-z]') OR regexp_matches(regexp_replace(w, '^[$,.:;]+|[$,.:;]+$', '', 'g'), '^\$?\d+\.\d{2}$') OR regexp_matches(regexp_replace(w, '^[$,.:;]+|[$,.:;]+$', '', 'g'), '^\d{1,6}$')"
Q1, Q2, Q3 = f"least(length({ST}) / CAST(10 AS DOUBLE), 20)", f"least({NP} * CAST(5 AS DOUBLE), 25)", f"least({KW} * CAST(7 AS DOUBLE), 20)"
Q4 = f"coalesce(len(list_filter({WL}, lambda w: {OKW})) / CAST(len({WL}) AS DOUBLE) * 25, 0)"
Q5 = rf"CASE WHEN len(regexp_extract_all(text, '[^\w\s$.,%\-:/\n]')) / CAST(length({ST}) AS DOUBLE) > 0.3 THEN CAST(4 AS DOUBLE) ELSE 0 END"
RAW = f"greatest(0, least(1, ({Q1} + {Q2} + {Q3} + {Q4} - {Q5}) / 100))"
SCORE = f"CASE WHEN {NP} = 0 AND {KW} = 0 THEN least({RAW}, CAST(0.4 AS DOUBLE)) ELSE {RAW} END"
SCORED = f"scored AS (SELECT doc_id, text, {SCORE} AS score, {Q1} AS q1, {Q2} AS q2, {Q3} AS q3, {Q4} AS q4, {Q5} AS q5 FROM slips)"

for _id, _sql, _f in (("QLT1", "q1", quality.length_points), ("QLT2", "q2", quality.price_points), ("QLT3", "q3", quality.keyword_points), ("QLT4", "q4", quality.word_points), ("QLT5", "q5", quality.noise_points), ("QLT6", "score", quality.score)):
    query(_id, f"SELECT doc_id, {_sql} AS points FROM scored", SCORED)(lambda v, f=_f: _slips(v, points=f(T())))


@query("QLT7", f"SELECT doc_id, score, q1 / 20 AS text_length, q2 / 25 AS price_patterns, q3 / 20 AS total_keyword, q4 / 25 AS word_quality, q5 / 10 AS noise_penalty, length({ST}) AS length, CAST(len(string_split(text, chr(10))) AS BIGINT) AS line_count FROM scored", SCORED)
def breakdown(v):
    b = v.slips.select("doc_id", quality.breakdown(T()).alias("b"))
    return b.select("doc_id", F.col("b.total_score").alias("score"), "b.components.*", F.col("b.stats.length").cast("long").alias("length"), F.col("b.stats.line_count").cast("long").alias("line_count"))


@query("QLT8", "SELECT doc_id, CASE WHEN score < 0.6 THEN 'FALLBACK' ELSE 'PROCEED' END AS recommendation FROM scored", SCORED)
def routing(v):
    return _slips(v, recommendation=F.when(quality.falls_back(T(), 0.6), "FALLBACK").otherwise("PROCEED"))


@query("QLT9", """SELECT doc_id, CASE WHEN r = '' THEN 'General quality concerns' ELSE r END AS reasoning FROM (SELECT doc_id, array_to_string(list_filter([CASE WHEN q1 / 20 < 0.5 THEN 'Text too short (' || length(text) || ' chars)' END,
    CASE WHEN q2 / 25 < 0.6 THEN 'Insufficient price patterns detected' END, CASE WHEN q3 / 20 < 0.5 THEN 'Missing TOTAL/AMOUNT keywords' END, CASE WHEN q4 / 25 < 0.6 THEN 'Low word quality (many noisy tokens)' END], lambda x: x IS NOT NULL), '; ') AS r FROM scored)""", SCORED)
def reasons(v):
    return _slips(v, reasoning=quality.reasoning(T()))


@query("QLT10", "SELECT doc_id, score * 100 AS confidence, 'primary' AS method, score > 0 AS success FROM scored", SCORED)
def confidence_percent(v):
    return _slips(v, confidence=quality.score(T()) * 100, method=F.lit("primary"), success=quality.score(T()) > 0)


@query("QLT11", """SELECT doc_id, CASE WHEN score >= 0.6 THEN 'primary' WHEN second IS NOT NULL THEN 'fallback' ELSE 'primary_low' END AS method, CASE WHEN score >= 0.6 OR second IS NULL THEN length(text) ELSE length(second) END AS n,
    CASE WHEN score >= 0.6 THEN 1 ELSE 2 END AS n_attempted FROM (SELECT *, CASE WHEN doc_id % 3 <> 0 THEN 'second ' || text END AS second FROM scored)""", SCORED)
def source_resolution(v):
    """The primary text if it is good enough, else a secondary one, else the primary again."""
    second = v.slips.where("doc_id % 3 <> 0").select("doc_id", F.concat(F.lit("second "), T()).alias("second"))
    both = v.slips.withColumn("good", quality.score(T()) >= 0.6).join(second, "doc_id", "left")
    method = F.when(F.col("good"), "primary").when(F.col("second").isNotNull(), "fallback").otherwise("primary_low")
    chosen = F.when(F.col("good") | F.col("second").isNull(), T()).otherwise(F.col("second"))
    tried = F.when(F.col("good"), F.array(F.lit("primary"))).otherwise(F.array(F.lit("primary"), F.lit("fallback")))
    return both.select("doc_id", method.alias("method"), F.char_length(chosen).cast("long").alias("n"), F.size(tried).alias("n_attempted"))


@query("QLT12", "SELECT r.id AS doc_id, CAST(epoch_ms(completed_at) - epoch_ms(started_at) AS DOUBLE) AS duration_ms, round(score, 3) AS quality, length(text) AS text_length FROM purchases r JOIN scored s ON r.id = s.doc_id", SCORED)
def run_record(v):
    ms = F.unix_millis("completed_at") - F.unix_millis("started_at")
    s = v.slips.select("doc_id", F.round(quality.score(T()), 3).alias("quality"), F.char_length("text").cast("long").alias("text_length"))
    return v.purchases.select(F.col("id").alias("doc_id"), ms.cast("double").alias("duration_ms")).join(s, "doc_id")


@query("SET2", "SELECT doc_id, CAST(len(list_intersect(['red', 'blue', 'gear', 'TOTAL'], string_split(text, ' '))) AS BIGINT) AS common, CAST(len(list_distinct(list_concat(['red', 'blue', 'gear', 'TOTAL'], string_split(text, ' ')))) AS BIGINT) AS n_union FROM slips")
def word_sets(v):
    known, words = F.array(*map(F.lit, ("red", "blue", "gear", "TOTAL"))), F.split(T(), " ")
    return _slips(v, common=F.size(F.array_intersect(known, words)).cast("long"), n_union=F.size(F.array_union(known, words)).cast("long"))


@query("AGG16", "SELECT doc_id, coalesce(avg(confidence) FILTER (confidence >= 0.7), 0) AS confidence FROM fragments GROUP BY 1", FRAGMENTS)
def fragment_confidence(v):
    kept = F.when(F.col("confidence") >= 0.7, F.col("confidence"))
    return _fragments(v).groupBy("doc_id").agg(F.coalesce(F.avg(kept), F.lit(0.0)).alias("confidence"))
