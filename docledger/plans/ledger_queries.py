"""Relational queries: scans, sinks, filters, top-k, joins, aggregates, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.plain import floats
from ..operators import attempts as tries
from ..operators import dedupe, updates
from ..operators.differences import against
from ..operators.relational import as_double, first_by, of_user, page, profile, union, unmatched, violations
from ..sources.store import Keyed, append, passes, shared, snapshot
from .registry import query

USER = 1
D = "CAST({0} AS DOUBLE) AS {0}".format


@query("SRC5", "SELECT id, user_id, status, CAST(total_amount AS DOUBLE) AS total_amount, merchant_name FROM purchases")
def scan(v):
    return v.purchases.select("id", "user_id", "status", *as_double("total_amount"), "merchant_name")


@query("SRC6", "SELECT p.key, p.name, p.rate_in, p.rate_out, count(a.model) AS n_attempts FROM pricing p LEFT JOIN attempts a ON p.name = a.model GROUP BY ALL")
def pricing_source(v):
    used = v.attempts.groupBy("model").count()
    return v.pricing.join(used, F.col("name") == F.col("model"), "left").select("key", "name", "rate_in", "rate_out", F.coalesce("count", F.lit(0)).alias("n_attempts"))


@query("FLT1", f"SELECT id, status FROM purchases WHERE user_id = {USER} AND status = 'success'")
def by_status(v):
    return of_user(v.headers, USER, "success").select("id", "status")


@query("FLT2", f"SELECT id, CAST(receipt_date AS VARCHAR) AS receipt_date FROM purchases WHERE user_id = {USER} AND receipt_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'")
def by_date(v):
    return of_user(v.headers, USER).where(F.col("receipt_date").between("1996-01-01", "1997-12-31")).select("id", F.col("receipt_date").cast("string").alias("receipt_date"))


@query("FLT3", "SELECT receipt_id, line_number, description FROM items WHERE category = 'ECONOMY'")
def by_category(v):
    return v.items.where("category = 'ECONOMY'").select("receipt_id", "line_number", "description")


@query("FLT4", "SELECT receipt_id, line_number, CAST(unit_price AS DOUBLE) AS unit_price FROM items WHERE unit_price BETWEEN 1000 AND 2000")
def by_price(v):
    return v.items.where(F.col("unit_price").between(1000, 2000)).select("receipt_id", "line_number", *as_double("unit_price"))


@query("FLT5", "SELECT * FROM (SELECT id, image_hash FROM purchases WHERE image_hash = sha256('42') ORDER BY id LIMIT 1)")
def by_hash(v):
    return first_by(v.headers.where(F.col("image_hash") == F.sha2(F.lit("42"), 256)), ["id"]).select("id", "image_hash")


@query("TOP1", f"SELECT id, CAST(total_amount AS DOUBLE) AS total_amount FROM (SELECT * FROM purchases WHERE user_id = {USER} ORDER BY total_amount DESC NULLS LAST, id LIMIT 50 OFFSET 2)")
def listing(v):
    return page(of_user(v.purchases, USER), "total_amount", "started_at", offset=2).select("id", *as_double("total_amount"))


@query("TOP2", "SELECT id, CAST(total_amount AS DOUBLE) AS total_amount FROM (SELECT * FROM purchases WHERE status = 'success' AND total_amount > 50 AND retry_count = 0 ORDER BY total_amount DESC, id LIMIT 20)")
def largest(v):
    r = v.purchases.where("status = 'success' and total_amount > 50 and retry_count = 0")
    return page(r, "total_amount", "id", limit=20).select("id", *as_double("total_amount"))


@query("TOP3", f"SELECT id FROM (SELECT * FROM purchases WHERE user_id = {USER} ORDER BY started_at DESC, id LIMIT 50)")
def newest(v):
    return page(of_user(v.headers, USER), "started_at", "id").select("id")


@query("JN1", "SELECT id, user_id FROM purchases WHERE id IN (SELECT receipt_id FROM items WHERE category = 'PROMO')")
def with_category(v):
    some = v.items.where("category = 'PROMO'").select(F.col("receipt_id").alias("id"))
    return v.headers.join(some, "id", "left_semi").select("id", "user_id")


@query("JN2", "SELECT receipt_id, line_number, CAST(total_price AS DOUBLE) AS total_price FROM items JOIN purchases ON receipt_id = id WHERE is_taxable AND status = 'success'")
def taxable(v):
    good = v.headers.where("status = 'success'").select("id")
    return v.items.where("is_taxable").join(good, F.col("receipt_id") == F.col("id")).select("receipt_id", "line_number", *as_double("total_price"))


@query("JN3", "SELECT receipt_id, line_number FROM items WHERE receipt_id NOT IN (SELECT id FROM purchases WHERE id % 97 <> 0)")
def orphans(v):
    kept = v.headers.where("id % 97 <> 0").select(F.col("id").alias("receipt_id"))
    return v.items.join(kept, "receipt_id", "left_anti").select("receipt_id", "line_number")


def _records(v):
    """Purchases with their lines' numbers and quantities, as nested records."""
    line = F.struct(F.col("l_linenumber").cast("int").alias("n"), F.col("l_quantity").cast("int").alias("quantity"))
    lines = v.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return v.headers.select("id", "status", "retry_count", "user_id", F.col("input_tokens").alias("tokens"), F.col("output_tokens").cast("string").alias("out")).join(lines, "id")


#: Both sides of the comparison in SQL: changed by key, and compared by hand.
RECORDS = """lines AS (SELECT l_orderkey AS id, list({'n': CAST(l_linenumber AS INTEGER), 'quantity': CAST(l_quantity AS INTEGER)} ORDER BY l_linenumber, l_quantity) AS lines FROM lineitem GROUP BY 1),
records AS (SELECT p.id, status, retry_count, user_id, input_tokens AS tokens, CAST(output_tokens AS VARCHAR) AS out, lines FROM purchases p JOIN lines USING (id)),
actual AS (SELECT * FROM records WHERE id % 11 <> 0),
expected AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'other' ELSE status END AS status, CASE WHEN id % 7 <> 0 THEN retry_count END AS retry_count, user_id + 1 AS user_id, CASE WHEN id % 3 = 0 THEN output_tokens END AS out_number,
  CASE id % 4 WHEN 0 THEN list_reverse(lines) WHEN 1 THEN lines[1:-2] WHEN 2 THEN list_transform(lines, lambda x: {'n': x.n, 'quantity': CASE WHEN x.n = 2 THEN x.quantity + 1 ELSE x.quantity END}) ELSE lines END AS lines FROM records r JOIN (SELECT id, output_tokens FROM purchases) USING (id) WHERE id % 13 <> 0),
both_sides AS (SELECT a.*, e.status AS e_status, e.retry_count AS e_retry_count, e.out_number, e.lines AS e_lines FROM actual a JOIN expected e USING (id)),
ordered_lines AS (SELECT id, lines AS a, e_lines AS e, 'lines' AS name FROM both_sides),
unordered_lines AS (SELECT id, list_transform(list_sort(list_transform(lines, lambda x: {'k': '{"n":' || x.n || ',"quantity":' || x.quantity || '}', 'x': x})), lambda y: y.x) AS a, list_transform(list_sort(list_transform(e_lines, lambda x: {'k': '{"n":' || x.n || ',"quantity":' || x.quantity || '}', 'x': x})), lambda y: y.x) AS e, 'any' AS name FROM both_sides),
listed AS (SELECT * FROM ordered_lines UNION ALL SELECT * FROM unordered_lines),
entries AS (SELECT id, name, i - 1 AS i, a[i] AS a, e[i] AS e FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM listed WHERE len(a) = len(e)))"""


@query(
    "JN6",
    """SELECT id, '' AS field, 'missing' AS kind, NULL AS actual, NULL AS expected FROM expected WHERE id NOT IN (SELECT id FROM actual) UNION ALL SELECT id, '', 'unexpected', NULL, NULL FROM actual WHERE id NOT IN (SELECT id FROM expected)
    UNION ALL SELECT id, 'status', CASE WHEN status IS NULL OR e_status IS NULL THEN 'type' ELSE 'value' END, CASE WHEN e_status IS NULL THEN 'text' WHEN status IS NULL THEN 'null' ELSE status END, CASE WHEN status IS NULL THEN 'text' WHEN e_status IS NULL THEN 'null' ELSE e_status END FROM both_sides WHERE status IS DISTINCT FROM e_status
    UNION ALL SELECT id, 'retry_count', 'type', 'int', 'null' FROM both_sides WHERE e_retry_count IS NULL
    UNION ALL SELECT id, 'tokens', 'unexpected', CAST(tokens AS VARCHAR), NULL FROM both_sides UNION ALL SELECT id, 'total', 'missing', NULL, CAST(tokens AS VARCHAR) FROM both_sides
    UNION ALL SELECT id, 'out', 'type', 'text', CASE WHEN out_number IS NULL THEN 'null' ELSE 'int' END FROM both_sides
    UNION ALL SELECT id, name, 'length', CAST(len(a) AS VARCHAR), CAST(len(e) AS VARCHAR) FROM listed WHERE len(a) <> len(e)
    UNION ALL SELECT id, name || '[' || i || '].n', 'value', CAST(a.n AS VARCHAR), CAST(e.n AS VARCHAR) FROM entries WHERE a.n <> e.n
    UNION ALL SELECT id, name || '[' || i || '].quantity', 'value', CAST(a.quantity AS VARCHAR), CAST(e.quantity AS VARCHAR) FROM entries WHERE a.quantity <> e.quantity""",
    RECORDS,
)
def differences(v):
    """Records against a snapshot, which the first comparison writes: other, missing and extra values, types, lengths and
    fields; one field is ignored, and the same list is taken with and without its order."""
    k, lines = F.col("id"), F.col("lines")
    second = F.transform(lines, lambda x: F.struct(x["n"].alias("n"), F.when(x["n"] == 2, x["quantity"] + 1).otherwise(x["quantity"]).alias("quantity")))
    changed = F.when(k % 4 == 0, F.reverse(lines)).when(k % 4 == 1, F.slice(lines, 1, F.size(lines) - 1)).when(k % 4 == 2, second).otherwise(lines)
    expected = _records(v).where("id % 13 <> 0").select(
        "id", F.when(k % 5 == 0, "other").otherwise(F.col("status")).alias("status"), F.when(k % 7 != 0, F.col("retry_count")).alias("retry_count"), (F.col("user_id") + 1).alias("user_id"),
        F.when(k % 3 == 0, F.col("out").cast("int")).alias("out"), changed.alias("lines"), changed.alias("any"), F.col("tokens").alias("total"),
    )
    path, actual = shared(v.spark, "expected"), _records(v).where("id % 11 <> 0").withColumn("any", lines)
    against(expected, path, "id")
    return against(actual, path, "id", ignored=("user_id",), unordered=("any",))


@query("JN7", "SELECT receipt_id, string_agg(description || '=' || printf('%.2f', CAST(total_price AS DOUBLE)), ',' ORDER BY description, total_price) AS items FROM items GROUP BY 1")
def normalised(v):
    lines = F.sort_array(F.collect_list(F.struct("description", "total_price")))
    text = F.transform(lines, lambda x: F.format_string("%s=%.2f", x["description"], x["total_price"].cast("double")))
    return v.items.groupBy("receipt_id").agg(F.array_join(text, ",").alias("items"))


@query("AGG1", "SELECT user_id, count(*) AS n, count(*) FILTER (status = 'success') AS n_success, CAST(coalesce(sum(estimated_cost), 0) AS DOUBLE) AS cost FROM purchases GROUP BY 1")
def user_stats(v):
    cost = F.coalesce(F.sum("estimated_cost"), F.lit(0)).cast("double")
    return v.headers.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "success").alias("n_success"), cost.alias("cost"))


@query("AGG2", "SELECT user_id, merchant_name, count(*) AS n, CAST(sum(total_amount) AS DOUBLE) AS spent FROM purchases WHERE status = 'success' GROUP BY ALL")
def merchant_spend(v):
    return v.purchases.where("status = 'success'").groupBy("user_id", "merchant_name").agg(F.count(F.lit(1)).alias("n"), F.sum("total_amount").cast("double").alias("spent"))


@query("AGG5", "SELECT count(*) AS total, count(*) FILTER (status = 'success') AS n_success, count(*) FILTER (status = 'pending') AS n_partial, count(*) FILTER (status = 'failed') AS n_failure FROM purchases")
def status_summary(v):
    s = F.col("status")
    return v.headers.agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "success").alias("n_success"), F.count_if(s == "pending").alias("n_partial"), F.count_if(s == "failed").alias("n_failure"))


@query(
    "AGG10",
    "SELECT id, CAST(total_amount AS DOUBLE) AS total, CAST(coalesce(s, 0) AS DOUBLE) AS items_sum, abs(total_amount - coalesce(s, 0)) > 0.01 AS mismatch FROM purchases LEFT JOIN (SELECT receipt_id, sum(total_price) AS s FROM items GROUP BY 1) ON id = receipt_id WHERE total_amount IS NOT NULL",
)
def item_sums(v):
    s = v.items.groupBy("receipt_id").agg(F.sum("total_price").alias("s"))
    sums = F.coalesce("s", F.lit(0).cast("decimal(28,2)"))
    r = v.purchases.where("total_amount is not null").join(s, F.col("id") == F.col("receipt_id"), "left")
    return r.select("id", F.col("total_amount").cast("double").alias("total"), sums.cast("double").alias("items_sum"), (F.abs(F.col("total_amount") - sums) > 0.01).alias("mismatch"))


@query("AGG11", "SELECT image_hash, count(*) AS n FROM purchases GROUP BY 1 HAVING count(*) > 1")
def repeated_hashes(v):
    return v.headers.groupBy("image_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("AGG12", "SELECT count(*) FILTER (h IS NULL OR h = '') AS missing FROM (SELECT CASE id % 10 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE image_hash END AS h FROM purchases)")
def missing_hashes(v):
    h = F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 10 == 1, "").otherwise(F.col("image_hash"))
    return v.headers.select(h.alias("h")).agg(F.count_if(F.col("h").isNull() | (F.col("h") == "")).alias("missing"))


@query(
    "AGG13",
    """SELECT 'users' AS table_name, CAST(4 AS BIGINT) AS n_columns, count(*) AS n_rows, count(*) FILTER (id IS NULL) AS null_keys, 'updated_at' AS missing_columns, count(*) > 10000 AS large FROM users
    UNION ALL SELECT 'items', 9, count(*), count(*) FILTER (receipt_id IS NULL), '', count(*) > 10000 FROM items""",
)
def profiles(v):
    return union([profile(v.users, "users", "id", ["id", "email", "updated_at"]), profile(v.items, "items", "receipt_id", ["receipt_id", "description"])])


@query("AGG14", "SELECT 'users' AS table_name, count(*) AS n FROM users UNION ALL SELECT 'purchases', count(*) FROM purchases UNION ALL SELECT 'items', count(*) FROM items")
def row_counts(v):
    return union([df.agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n")) for n, df in (("users", v.users), ("purchases", v.headers), ("items", v.items))])


@query("WIN1", "SELECT receipt_id, line_number, description FROM items")
def line_numbers(v):
    return v.items.select("receipt_id", "line_number", "description")


@query("SET1", "SELECT id, 'ok' AS outcome, CAST(total_amount AS DOUBLE) AS total FROM purchases WHERE status = 'success' UNION ALL SELECT id, 'error', NULL FROM purchases WHERE status = 'failed'")
def outcomes(v):
    good = v.purchases.where("status = 'success'").select("id", F.lit("ok").alias("outcome"), F.col("total_amount").cast("double").alias("total"))
    bad = v.purchases.where("status = 'failed'").select("id", F.lit("error").alias("outcome"), F.lit(None).cast("double").alias("total"))
    return good.unionByName(bad)


# ---- duplicates: every fifth receipt is already in the ledger, the rest is the batch
LEDGER = "old AS (SELECT * FROM hashed WHERE id % 5 = 0), batch AS (SELECT * FROM hashed WHERE id % 5 <> 0)"
BY = "(SELECT user_id, {0}, min(id) AS {1} FROM old GROUP BY 1, 2)".format


def _split(v):
    return v.hashed.where("id % 5 <> 0"), v.hashed.where("id % 5 = 0")


@query("HSH2", "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def text_digest(v):
    return v.table("documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query("HSH3", "SELECT id, data_hash FROM hashed")
def content_digest(v):
    return v.hashed.select("id", "data_hash")


@query("DUP1", f"SELECT b.id, CAST(x.f AS DOUBLE) AS existing_id FROM batch b LEFT JOIN {BY('image_hash', 'f')} x USING (user_id, image_hash)", LEDGER)
def by_image(v):
    batch, old = _split(v)
    return dedupe.lookup(batch, old, "image_hash", "existing_id").select("id", *as_double("existing_id"))


@query("DUP2", f"SELECT b.id, CAST(x.f AS DOUBLE) AS existing_id FROM batch b LEFT JOIN {BY('data_hash', 'f')} x USING (user_id, data_hash)", LEDGER)
def by_content(v):
    batch, old = _split(v)
    return dedupe.lookup(batch, old, "data_hash", "existing_id").select("id", *as_double("existing_id"))


@query("DUP3", f"SELECT b.id, CAST(coalesce(x.f, y.g) AS DOUBLE) AS existing_id FROM batch b LEFT JOIN {BY('image_hash', 'f')} x USING (user_id, image_hash) LEFT JOIN {BY('data_hash', 'g')} y ON b.user_id = y.user_id AND b.data_hash = y.data_hash", LEDGER)
def by_both(v):
    return dedupe.two_level(*_split(v)).select("id", *as_double("existing_id"))


@query("DUP4", "SELECT id, min(id) OVER (PARTITION BY image_hash) AS first_id FROM hashed")
def first_write(v):
    return dedupe.first_write_wins(v.hashed.select("id", "image_hash"), ["image_hash"]).select("id", "first_id")


SAVE = f"""{LEDGER}, seen AS (SELECT b.*, coalesce(x.f, y.g) AS existing_id FROM batch b LEFT JOIN {BY('image_hash', 'f')} x USING (user_id, image_hash)
  LEFT JOIN {BY('data_hash', 'g')} y ON b.user_id = y.user_id AND b.data_hash = y.data_hash),
fresh AS (SELECT *, min(id) OVER (PARTITION BY user_id, image_hash) AS image_first FROM seen WHERE existing_id IS NULL),
heads AS (SELECT id AS head, min(id) OVER (PARTITION BY user_id, data_hash) AS data_first FROM fresh WHERE id = image_first),
saved AS (SELECT id, data_first AS result_id, CASE WHEN id = data_first THEN 'created' ELSE 'duplicate' END AS tag FROM fresh JOIN heads ON image_first = head
  UNION ALL SELECT id, existing_id, 'duplicate' FROM seen WHERE existing_id IS NOT NULL)"""


@query("SNK1", "SELECT * FROM saved", SAVE)
def idempotent_insert(v):
    """The batch goes into a ledger that has every fifth row; the tags of its rows."""
    batch, old = _split(v)
    n = v.table("lineitem").count()
    ledger = Keyed(v.spark, shared(v.spark, "ledger"), ("user_id",), old.schema)
    ledger.fill(old, passes(n // 5), ("id",))
    return dedupe.insert(batch, ledger, passes(n))


@query(
    "DUP5",
    """SELECT count(*) AS attempts, count(*) FILTER (tag = 'created') AS writes, count(*) FILTER (tag = 'duplicate') AS duplicates,
    count(*) FILTER (tag = 'created' AND (image_hash IN (SELECT image_hash FROM old) OR earlier > 0)) AS violations
    FROM (SELECT tag, image_hash, count(*) FILTER (tag = 'created') OVER (PARTITION BY image_hash ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM saved JOIN batch USING (id))""",
    SAVE,
)
def metrics(v):
    batch, old = _split(v)
    saved = snapshot(dedupe.save(batch, old), "saved")
    created = saved.where("tag = 'created'").join(v.headers.select("id", "image_hash"), "id")
    return dedupe.write_metrics(saved, dedupe.constraint_violations(created, v.headers.where("id % 5 = 0")))


@query(
    "DUP6",
    """SELECT 'image_hash' AS kind, 'duplicate_receipt' AS class, user_id || '/' || image_hash AS key, count(*) AS n FROM hashed GROUP BY user_id, image_hash HAVING count(*) > 1
    UNION ALL SELECT 'data_hash', 'integrity_error', user_id || '/' || data_hash, count(*) FROM hashed GROUP BY user_id, data_hash HAVING count(*) > 1
    UNION ALL SELECT 'receipt_hash', 'duplicate_receipt', image_hash, count(*) FROM hashed GROUP BY image_hash HAVING count(*) > 1
    UNION ALL SELECT 'total_amount', 'missing_required_field', CAST(id AS VARCHAR), 1 FROM hashed WHERE total_amount IS NULL""",
)
def violation_report(v):
    """What breaks a constraint, by the constraint and by the class that a writer reports."""
    missing = v.hashed.where("total_amount is null").select(F.lit("total_amount").alias("kind"), F.col("id").cast("string").alias("key"), F.lit(1).cast("long").alias("n"))
    found = union([violations(v.hashed, "image_hash", ["user_id", "image_hash"]), violations(v.hashed, "data_hash", ["user_id", "data_hash"]), violations(v.hashed, "receipt_hash", ["image_hash"]), missing])
    kind = F.col("kind")
    class_ = F.when(kind.isin("image_hash", "receipt_hash"), "duplicate_receipt").when(kind == "total_amount", "missing_required_field").otherwise("integrity_error")
    return found.select("kind", class_.alias("class"), "key", "n")


@query("DUP7", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY image_hash ORDER BY id) AS r FROM purchases) WHERE r = 1")
def rebuild(v):
    return dedupe.keep_first(v.headers.select("id", "image_hash"), ["image_hash"], "id").select("id")


# ---- sinks and projections
@query("SNK2", "SELECT id, user_id, 'pending' AS status, CAST(started_at AS VARCHAR) AS started_at, CAST(NULL AS DOUBLE) AS input_tokens FROM purchases")
def pending(v):
    rows = v.headers.select("id", "user_id", F.lit("pending").alias("status"), F.col("started_at").cast("string").alias("started_at"), F.lit(None).cast("double").alias("input_tokens"))
    return append(rows, shared(v.spark, "pending"))


def _table(v, name, keys, rows):
    """``rows``, written as a keyed table."""
    table = Keyed(v.spark, shared(v.spark, name), keys, rows.schema)
    table.append(rows)
    return table


@query("SNK3", "SELECT id, CASE WHEN id % 9 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN id % 9 = 0 THEN 'error ' || id END AS error, CAST(CASE WHEN id % 9 = 0 THEN epoch_ms(started_at + INTERVAL 5 SECOND) ELSE epoch_ms(completed_at) END AS DOUBLE) AS completed_ms FROM purchases")
def mark_failed(v):
    table = _table(v, "failed", ("id",), v.headers.select("id", "status", F.lit(None).cast("string").alias("error"), "completed_at"))
    late = F.timestamp_seconds(F.unix_seconds("started_at") + 5)
    updates.fail(table, v.headers.where("id % 9 = 0").select("id", F.concat(F.lit("error "), F.col("id").cast("string")).alias("error"), late.alias("completed_at")))
    return table.rows().select("id", "status", "error", F.unix_millis("completed_at").cast("double").alias("completed_ms"))


CONTENT = ("total_amount", "receipt_date", "merchant_name", "input_tokens", "output_tokens", "estimated_cost", "data_hash")
SHOWN = """{0} AS id, {1} AS status, CAST(CASE WHEN {2} THEN total_amount END AS DOUBLE) AS total_amount, CAST(CASE WHEN {2} THEN estimated_cost END AS DOUBLE) AS estimated_cost, CASE WHEN {2} THEN strftime(receipt_date, '%Y-%m-%d') END AS receipt_date,
  CASE WHEN {2} THEN merchant_name END AS merchant_name, CAST(CASE WHEN {2} THEN input_tokens ELSE 0 END AS BIGINT) AS input_tokens, CAST(CASE WHEN {2} THEN output_tokens ELSE 0 END AS BIGINT) AS output_tokens, CASE WHEN {2} THEN data_hash END AS data_hash, {3} AS missing""".format
DONE = "(status = 'success' OR id % 8 = 0 AND user_id % 2 = 0)"


@query("SNK4", f"""SELECT {SHOWN('id', f"CASE WHEN {DONE} THEN 'success' ELSE status END", DONE, 'FALSE')} FROM hashed UNION ALL SELECT {SHOWN('-1 - id', "'success'", 'TRUE', 'TRUE')} FROM hashed WHERE id % 1000 = 0""")
def mark_success(v):
    """What was parsed goes into rows of the same id and user; updates without such a row come out as missing."""
    parsed = v.hashed.select("id", "user_id", "status", *CONTENT)
    table = parsed.select("id", "user_id", "status", *[F.when(F.col("status") == "success", F.col(c)).alias(c) for c in CONTENT])
    good = parsed.where("id % 8 = 0 and user_id % 2 = 0").withColumn("status", F.lit("success"))
    lost = parsed.where("id % 1000 = 0").withColumns({"id": -1 - F.col("id"), "status": F.lit("success")})

    def shown(rows, missing):
        counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("input_tokens", "output_tokens")]
        return rows.select("id", "status", *as_double("total_amount", "estimated_cost"), F.date_format("receipt_date", "yyyy-MM-dd").alias("receipt_date"), "merchant_name", *counts, "data_hash", F.lit(missing).alias("missing"))

    done = _table(v, "success", ("id",), table)
    updates.update(done, good.unionByName(lost), ["status", *CONTENT], ("id", "user_id"))
    return shown(done.rows(), False).unionByName(shown(unmatched(good.unionByName(lost), v.headers, ["id", "user_id"]), True))


@query("SNK5", "SELECT receipt_id, line_number, description, CAST(1 AS DOUBLE) AS quantity, CAST(total_price AS DOUBLE) AS unit_price, CAST(total_price AS DOUBLE) AS total_price FROM items WHERE receipt_id % 4 = 0 UNION ALL SELECT receipt_id, line_number, description, CAST(quantity AS DOUBLE), CAST(unit_price AS DOUBLE), CAST(total_price AS DOUBLE) FROM items WHERE receipt_id % 4 <> 0")
def replace_items(v):
    nested = v.items.where("receipt_id % 4 = 0").groupBy("receipt_id").agg(F.sort_array(F.collect_list(F.struct("line_number", "description", "total_price"))).alias("items"))
    price = F.col("i.total_price").cast("double")
    new = nested.select("receipt_id", F.posexplode("items").alias("pos", "i")).select("receipt_id", (F.col("pos") + 1).alias("line_number"), "i.description", F.lit(1.0).alias("quantity"), price.alias("unit_price"), price.alias("total_price"))
    rows, n = v.items.select("receipt_id", "line_number", "description", *as_double("quantity", "unit_price", "total_price")), passes(v.table("lineitem").count())
    table = Keyed(v.spark, shared(v.spark, "items"), ("receipt_id",), rows.schema)
    table.fill(rows, n)
    table.replace(new, n)
    return table.rows()


@query("SNK6", "SELECT receipt_id, count(*) AS n_items, string_agg(description, '|' ORDER BY line_number) AS descriptions, CAST(sum(total_price) AS DOUBLE) AS total FROM items GROUP BY 1")
def reassemble(v):
    nested = v.items.groupBy("receipt_id").agg(F.sort_array(F.collect_list(F.struct("line_number", "description", F.col("total_price").alias("price")))).alias("items"))
    total = F.aggregate("items", F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x["price"]).cast("decimal(28,2)"))
    return nested.select("receipt_id", F.size("items").cast("long").alias("n_items"), F.array_join("items.description", "|").alias("descriptions"), total.cast("double").alias("total"))


@query("SNK7", "SELECT id, user_id, status, strftime(receipt_date, '%Y-%m-%d') AS receipt_date, CAST(total_amount AS DOUBLE) AS total_amount, CAST(estimated_cost AS DOUBLE) AS estimated_cost, input_tokens + output_tokens AS total_tokens FROM purchases")
def projection(v):
    return v.purchases.select("id", "user_id", "status", F.date_format("receipt_date", "yyyy-MM-dd").alias("receipt_date"), *as_double("total_amount", "estimated_cost"), (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))


@query(
    "SNK8",
    """SELECT u.id, email, id % 4 = 0 OR is_active AS is_active, coalesce(r.n, 0) AS receipts, coalesce(r.k, 0) AS items, u.id = 1 OR email = 'customer#000000002@example.com' AS looked_up FROM users u
    LEFT JOIN (SELECT user_id, count(*) AS n, CAST(sum(k) AS BIGINT) AS k FROM purchases LEFT JOIN (SELECT receipt_id, count(*) AS k FROM items GROUP BY 1) ON receipt_id = id GROUP BY 1) r ON r.user_id = u.id WHERE u.id % 10 <> 3
    UNION ALL SELECT CAST('0x' || sha256(email)[:15] AS BIGINT), email, TRUE, 0, 0, email = 'customer#000000002@example.com' FROM users WHERE id % 10 = 3""",
)
def users(v):
    """Users who are written: deleted with their purchases and these with their items, created again by email (twice, which
    adds nobody the second time), partly updated, looked up by id and email."""
    people = _table(v, "users", ("id",), v.users.select("id", "email", "is_active"))
    purchases = _table(v, "purchases", ("user_id",), v.headers.select("id", "user_id"))
    items = _table(v, "items", ("receipt_id",), v.items.select("receipt_id", "line_number"))
    updates.delete(people, purchases, items, v.users.where("id % 10 = 3"))
    for _ in range(2):
        updates.get_or_create(people, v.users.where("id % 10 = 3 or id % 10 = 4"))
    updates.update(people, v.users.where("id % 4 < 2").select("id", F.when(F.col("id") % 4 == 0, True).alias("is_active")), ["is_active"], partial=True)
    wanted = v.spark.createDataFrame([(1, "customer#000000002@example.com")], "id long, email string")
    found = updates.by_id(people, wanted).select("id").unionByName(updates.by_email(people, wanted).select("id")).distinct().withColumn("looked_up", F.lit(True))
    lines = items.rows().groupBy("receipt_id").agg(F.count(F.lit(1)).alias("k"))
    theirs = purchases.rows().join(lines, F.col("id") == F.col("receipt_id"), "left").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("receipts"), F.sum("k").alias("items"))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("receipts", "items")]
    return people.rows().join(theirs, "id", "left").join(found, "id", "left").select("id", "email", "is_active", *counts, F.coalesce("looked_up", F.lit(False)).alias("looked_up"))


@query(
    "SNK9",
    """SELECT id, '{"merchant":' || coalesce('"' || merchant_name || '"', 'null') || ',"retry_count":' || retry_count || ',"total":' || coalesce(CAST(CAST(total_amount AS DOUBLE) AS VARCHAR), 'null') || ',"items":[' || coalesce(j, '') || ']}' AS json FROM purchases LEFT JOIN
    (SELECT receipt_id, string_agg('{"description":"' || description || '","price":' || CAST(CAST(total_price AS DOUBLE) AS VARCHAR) || '}', ',' ORDER BY line_number) AS j FROM items GROUP BY 1) ON receipt_id = id""",
)
def plain(v):
    """Purchases with their items as JSON, decimals as plain numbers at every level."""
    item = F.struct("line_number", "description", F.col("total_price").alias("price"))
    listed = v.items.groupBy("receipt_id").agg(F.sort_array(F.collect_list(item)).alias("sorted"))
    items = F.transform("sorted", lambda x: F.struct(x["description"].alias("description"), x["price"].alias("price")))
    none = F.array().cast("array<struct<description:string,price:decimal(18,2)>>")
    r = v.purchases.join(listed, F.col("id") == F.col("receipt_id"), "left")
    r = r.select("id", F.struct(F.col("merchant_name").alias("merchant"), "retry_count", F.col("total_amount").alias("total"), F.coalesce(items, none).alias("items")).alias("r"))
    return r.select("id", F.to_json(floats(F.col("r"), r.schema["r"].dataType), {"ignoreNullFields": "false"}).alias("json"))


@query("WIN2", "SELECT item_id, attempt, CAST(sum(input_tokens + output_tokens) OVER (PARTITION BY item_id ORDER BY attempt) AS BIGINT) AS tokens FROM attempts")
def cumulative(v):
    return tries.cumulative(v.attempts).select("item_id", "attempt", "tokens")
