"""Queries about model output, attempts, usage, traces and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, validate
from ..operators import attempts as tries
from ..operators import dedupe, trace, usage
from ..operators.prompts import PROMPTS, prompt
from ..operators.relational import as_double
from .registry import query
from .text_queries import FOCUS

def P():
    return F.col("payload")

def _decimal(kind: str, text: str, required: bool) -> tuple[str, str]:
    """SQL for a JSON value's decimal and for the kind of its fault."""
    clean = rf"replace(regexp_replace({text}, '^\s+|\s+$', '', 'g'), '_', '')"
    value = rf"CASE WHEN {kind} = 'VARCHAR' AND NOT regexp_matches({clean}, '{validate.DECIMAL}') THEN NULL WHEN {kind} IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') THEN try_cast({clean} AS DECIMAL(30,10)) END"
    absent = f"WHEN {kind} IS NULL THEN 'missing'" if required else f"WHEN {kind} IS NULL OR {kind} = 'NULL' THEN NULL"
    return value, f"CASE WHEN {value} IS NOT NULL THEN NULL {absent} WHEN {kind} = 'VARCHAR' AND regexp_matches({clean}, '{validate.UNBOUNDED}') THEN 'finite_number' WHEN {kind} IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') THEN 'decimal_parsing' ELSE 'decimal_type' END"


_PRICE, _PRICE_FAULT = _decimal("json_type(x, '$.price')", "json_extract_string(x, '$.price')", True)
_TOTAL, _TOTAL_FAULT = _decimal("json_type(j, '$.total')", "json_extract_string(j, '$.total')", False)
_SAID = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in validate.FAULTS.items())
#: Payloads with typed values, faults by path and kind, and messages, in SQL.
PARSED = rf"""parsed AS (SELECT doc_id, payload, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j, json_valid(payload) AND coalesce(json_type(CASE WHEN json_valid(payload) THEN payload END) = 'OBJECT', FALSE) AS is_object FROM payloads),
entries AS (SELECT doc_id, i, x, {_PRICE} AS price, json_extract_string(x, '$.description') AS description, json_type(x) = 'OBJECT' AS is_item, json_type(x, '$.description') AS d, {_PRICE_FAULT} AS p
  FROM (SELECT doc_id, unnest(json_extract(j, '$.items[*]')) AS x, generate_subscripts(json_extract(j, '$.items[*]'), 1) - 1 AS i FROM parsed WHERE is_object)),
marked AS (SELECT *, list_filter(CASE WHEN NOT is_item THEN [{{'path': 'items[' || i || ']', 'kind': 'model_type'}}] ELSE
  [{{'path': 'items[' || i || '].description', 'kind': CASE WHEN d IS NULL THEN 'missing' WHEN d <> 'VARCHAR' THEN 'string_type' END}}, {{'path': 'items[' || i || '].price', 'kind': coalesce(p, CASE WHEN price < 0 THEN 'value_error' END)}}] END, lambda f: f.kind IS NOT NULL) AS faults FROM entries),
listed AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN is_item THEN price END) AS sums, bool_and(is_item AND coalesce(price >= 0, FALSE)) AS prices_ok, flatten(list(faults ORDER BY i)) AS faults FROM marked GROUP BY 1),
judged AS (SELECT p.doc_id, payload, is_object, CASE WHEN is_object THEN {_TOTAL} END AS total, coalesce(n, 0) AS n, coalesce(sums, 0) AS sums, coalesce(prices_ok, TRUE) AS prices_ok, CASE WHEN is_object THEN list_concat(
  list_filter([{{'path': 'date', 'kind': CASE WHEN json_type(j, '$.date') NOT IN ('NULL', 'VARCHAR') THEN 'string_type' END}}, {{'path': 'items', 'kind': CASE WHEN json_type(j, '$.items') <> 'ARRAY' THEN 'list_type' END}}], lambda f: f.kind IS NOT NULL),
  coalesce(l.faults, []), list_filter([{{'path': 'total', 'kind': {_TOTAL_FAULT}}}], lambda f: f.kind IS NOT NULL)) END AS faults FROM parsed p LEFT JOIN listed l USING (doc_id)),
said AS (SELECT *, list_transform(list_filter(list_transform(faults, lambda f, k: {{'f': f, 'first': f.kind <> 'value_error' OR k = list_position(list_transform(faults, lambda g: g.kind), 'value_error')}}), lambda y: y.first), lambda y: CASE WHEN y.f.kind = 'value_error' THEN '' ELSE y.f.path || ': ' END || CASE y.f.kind {_SAID} END) AS fault_messages,
  CASE WHEN len(list_filter(faults, lambda f: starts_with(f.path, 'items'))) = 0 AND abs(total - sums) > 0.01 THEN ['Total ' || CAST(total AS DECIMAL(38,2)) || ' does not match sum of items ' || CAST(sums AS DECIMAL(38,2))] ELSE [] END AS off FROM judged),
messages AS (SELECT *, errors[1] AS error FROM (SELECT *, CASE WHEN is_object THEN list_concat(fault_messages, off) ELSE ['Failed to parse JSON'] END AS errors FROM said))"""


def _judged(v):
    p = v.payloads.select("doc_id", "payload", validate.typed(P()).alias("p"))
    return p.withColumn("errors", validate.problems(F.col("p"))).withColumn("error", F.get("errors", F.lit(0)))


@query("VAL1", "SELECT doc_id, is_object AS valid, CASE WHEN NOT is_object THEN 'Failed to parse JSON' END AS error FROM parsed", PARSED)
def content(v):
    ok = validate.is_object(P())
    return v.payloads.select("doc_id", ok.alias("valid"), F.when(~ok, validate.UNPARSED).alias("error"))


@query("VAL2", "SELECT doc_id, CAST(total AS DOUBLE) AS total, CAST(CASE WHEN is_object THEN n END AS DOUBLE) AS n_items, array_to_string(list_transform(faults, lambda f: f.path || ':' || f.kind), ',') AS faults FROM judged", PARSED)
def typed(v):
    """The typed values of payloads, and where and how they are not of the type they should have."""
    p = _judged(v)
    return p.select("doc_id", F.col("p.total").cast("double").alias("total"), F.size("p.items").cast("double").alias("n_items"), F.array_join(validate.fault_list(F.col("p")), ",").alias("faults"))


@query("VAL3", "SELECT doc_id, prices_ok FROM judged WHERE is_object", PARSED)
def prices(v):
    return _judged(v).where("p is not null").select("doc_id", validate.prices_ok(F.col("p.items")).alias("prices_ok"))


MISMATCHED = """SELECT id, CASE WHEN abs(total_amount - s) > 0.01 THEN 'Total ' || total_amount || ' does not match sum of items ' || CAST(s AS DECIMAL(18,2)) END AS error, {0}
    FROM (SELECT id, total_amount, coalesce(s, 0) AS s FROM purchases LEFT JOIN (SELECT receipt_id, sum(total_price) AS s FROM items GROUP BY 1) ON id = receipt_id WHERE total_amount IS NOT NULL)"""


def reconciled(v):
    """id, total_amount, error: purchases whose total is off the sum of their items."""
    s = v.items.groupBy("receipt_id").agg(F.sum("total_price").alias("s"))
    joined = v.purchases.where("total_amount is not null").join(s, F.col("id") == F.col("receipt_id"), "left")
    return joined.select("id", "total_amount", validate.mismatch(F.col("total_amount"), F.coalesce("s", F.lit(0).cast("decimal(28,2)"))).alias("error"))


@query("VAL4", MISMATCHED.format("CAST(total_amount AS DOUBLE) AS total_amount"))
def reconciliation(v):
    return reconciled(v).select("id", "error", *as_double("total_amount"))


@query("VAL5", "SELECT doc_id, error IS NULL AS valid, error, array_to_string(errors, '; ') AS errors, is_object AS parsed, CAST(total AS DOUBLE) AS kept_total, CAST(CASE WHEN is_object THEN n END AS DOUBLE) AS kept_items FROM messages", PARSED)
def partial(v):
    """Every payload with all that is wrong with it; what could be parsed of an invalid one is kept."""
    kept = (F.col("p.total").cast("double").alias("kept_total"), F.size("p.items").cast("double").alias("kept_items"))
    return _judged(v).select("doc_id", F.col("error").isNull().alias("valid"), "error", F.array_join("errors", "; ").alias("errors"), F.col("p").isNotNull().alias("parsed"), *kept)


@query("VAL6", "SELECT doc_id, coalesce(is_object AND n > 0 AND total IS NOT NULL, FALSE) AS meaningful FROM judged", PARSED)
def meaningful(v):
    return _judged(v).select("doc_id", validate.meaningful(F.col("p")).alias("meaningful"))


AMOUNTS = r"""SELECT *, regexp_matches(error, 'Total ([\d.,]+) does not match sum of items ([\d.,]+)') AS mm,
  abs(try_cast(replace(regexp_extract(error, 'Total ([\d.,]+) does not match sum of items ([\d.,]+)', 1), ',', '.') AS DECIMAL(18,2)) - try_cast(replace(regexp_extract(error, 'Total ([\d.,]+) does not match sum of items ([\d.,]+)', 2), ',', '.') AS DECIMAL(18,2))) AS off"""
SEVERITY = "CASE WHEN mm THEN CASE WHEN off < 1 THEN 'small' WHEN off <= 5 THEN 'medium' WHEN off IS NOT NULL THEN 'large' ELSE 'unknown' END WHEN contains(lower(error), 'missing') THEN 'medium' WHEN contains(lower(error), 'invalid') THEN 'small' ELSE 'unknown' END"


@query("VAL7", f"SELECT item_id, attempt, {SEVERITY} AS severity, CAST(nullif(off, 0) AS DOUBLE) AS mismatch FROM ({AMOUNTS} FROM attempts WHERE error IS NOT NULL)")
def severity(v):
    e = F.col("error")
    return v.attempts.where("error is not null").select("item_id", "attempt", validate.severity(e).alias("severity"), validate.mismatch_amount(e).cast("double").alias("mismatch"))


@query(
    "VAL8",
    """SELECT id, len(e) = 0 AS valid, array_to_string(e, '; ') AS errors, array_to_string(w, '; ') AS warnings, len(e) > 0 AND retry_count < 2 AS retryable, len(e) > 0 AND len(e) < 5 AS preserve_partial
    FROM (SELECT id, retry_count, list_filter([CASE WHEN merchant_name IS NULL THEN 'merchant: missing' END, CASE WHEN receipt_date < DATE '1996-01-01' THEN 'date: too old' END, CASE WHEN total_amount IS NULL THEN 'total: missing' END,
      CASE WHEN items_sum IS NULL THEN 'items: missing' END, CASE WHEN id % 50 = 0 THEN 'currency: unknown' END], lambda x: x IS NOT NULL) AS e,
      list_filter([CASE WHEN receipt_date < DATE '1997-01-01' THEN 'date: old' END, CASE WHEN total_amount > 300000 THEN 'total: large' END], lambda x: x IS NOT NULL) AS w FROM purchases)""",
)
def field_validation(v):
    missing = lambda c: F.when(F.col(c).isNull(), "missing")
    date, total = F.col("receipt_date"), F.col("total_amount")
    checks = {"merchant": missing("merchant_name"), "date": F.when(date < "1996-01-01", "too old"), "total": missing("total_amount"), "items": missing("items_sum"), "currency": F.when(F.col("id") % 50 == 0, "unknown")}
    doubts = {"date": F.when(date < "1997-01-01", "old"), "total": F.when(total > 300000, "large")}
    r = v.purchases.select("id", validate.field_results(checks, doubts, F.col("retry_count"), 2).alias("f"))
    return r.select("id", "f.valid", F.array_join("f.errors", "; ").alias("errors"), F.array_join("f.warnings", "; ").alias("warnings"), "f.retryable", "f.preserve_partial")


CLEAN = "error"
for _p in validate.PREFIXES:
    CLEAN = f"replace({CLEAN}, '{_p}', '')"


@query("VAL9", f"SELECT CASE WHEN mm THEN 'Total mismatch' WHEN length({CLEAN}) > 80 THEN left({CLEAN}, 77) || '...' ELSE {CLEAN} END AS reason, count(*) AS n, CAST(sum(CASE WHEN mm THEN off END) AS DOUBLE) AS difference FROM ({AMOUNTS} FROM attempts WHERE error IS NOT NULL) GROUP BY 1")
def reasons(v):
    return v.attempts.where("error is not null").groupBy(validate.reason(F.col("error")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(validate.difference(F.col("error"))).cast("double").alias("difference"))


@query("entry", f"SELECT {SEVERITY} AS severity, count(*) AS n, CAST(sum(total_amount) AS DOUBLE) AS amount FROM ({AMOUNTS} FROM ({MISMATCHED.format('total_amount')}) WHERE error IS NOT NULL) GROUP BY 1")
def flagship(v):
    """Purchases whose total disagrees with their items, by severity."""
    bad = reconciled(v).where("error is not null")
    return bad.groupBy(validate.severity(F.col("error")).alias("severity")).agg(F.count(F.lit(1)).alias("n"), F.sum("total_amount").cast("double").alias("amount"))


# ---- attempts
@query(
    "RTY1",
    f"""SELECT item_id, attempt, array_to_string(list_filter([CASE WHEN s IN ('small', 'medium') THEN 'LLM_SELF_CORRECTION' END, CASE WHEN s IN ('medium', 'large') THEN 'RAG_FOCUSED_CONTEXT' END,
    CASE WHEN item_id % 2 = 0 AND (quality < 0.25 OR s IN ('medium', 'large')) THEN 'OCR_FALLBACK' END], lambda x: x IS NOT NULL)[1:2], ',') AS rungs FROM (SELECT *, {SEVERITY} AS s FROM ({AMOUNTS} FROM attempts WHERE error IS NOT NULL))""",
)
def ladder(v):
    rungs = tries.ladder(validate.severity(F.col("error")), F.col("quality"), F.col("item_id") % 2 == 0)
    return v.attempts.where("error is not null").select("item_id", "attempt", F.array_join(rungs, ",").alias("rungs"))


@query(
    "RTY2",
    """SELECT item_id, CAST(best AS DOUBLE) AS attempt, ok AS success, CASE WHEN best IS NULL THEN last END AS error FROM (SELECT item_id, coalesce(min(attempt) FILTER (success), max(attempt) FILTER (parsed)) AS best, bool_or(success) AS ok, (array_agg(error ORDER BY attempt DESC))[1] AS last FROM attempts GROUP BY 1)""",
)
def best(v):
    return tries.best(v.attempts).select("item_id", *as_double("attempt"), "success", "error")


@query("RTY3", "SELECT item_id, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens FROM attempts GROUP BY 1")
def tokens(v):
    return v.attempts.groupBy("item_id").agg(*usage.totals())


@query("RTY4", "SELECT item_id, coalesce(string_agg(strategy, ',' ORDER BY attempt), '') AS strategies FROM attempts GROUP BY 1")
def strategies(v):
    return tries.strategies(v.attempts)


@query(
    "RTY5",
    """SELECT item_id, count(*) AS attempts, greatest(0, count(*) - 1) AS retries, coalesce(string_agg(CASE WHEN error_type = 'ValueError' THEN 'LLM_SELF_CORRECTION' ELSE coalesce(strategy, 'none') END, ',' ORDER BY attempt) FILTER (NOT success), '') AS strategies,
    count(*) >= 3 AND NOT bool_or(success) AS exhausted FROM attempts GROUP BY 1""",
)
def history(v):
    return tries.history(v.attempts)


def _words(name, **parts):
    """A prompt in SQL, its parts filled in."""
    out = "'" + PROMPTS[name].replace("\n", "' || chr(10) || '") + "'"
    for k, v in parts.items():
        out = out.replace("{" + k + "}", f"' || coalesce({v}, '') || '")
    return out


RUNGS = f"""rungs AS (SELECT doc_id, payload, error, m.text, CASE s WHEN 'small' THEN 'LLM_SELF_CORRECTION' WHEN 'medium' THEN 'LLM_SELF_CORRECTION' WHEN 'large' THEN 'RAG_FOCUSED_CONTEXT' ELSE CASE WHEN error IS NOT NULL AND doc_id % 2 = 0 THEN 'OCR_FALLBACK' END END AS rung, context
  FROM (SELECT *, {SEVERITY} AS s FROM ({AMOUNTS} FROM (SELECT doc_id, payload, errors[1] AS error, text FROM messages JOIN slips USING (doc_id)))) m JOIN ({FOCUS}) USING (doc_id))"""


@query(
    "RTY8",
    f"""SELECT doc_id, rung, CASE rung WHEN 'LLM_SELF_CORRECTION' THEN {_words(tries.SELF, error='error', output='payload', text='text')} WHEN 'RAG_FOCUSED_CONTEXT' THEN {_words(tries.FOCUSED, focus='context', text='text')}
    WHEN 'OCR_FALLBACK' THEN {_words(tries.SECOND, text='text')} ELSE {_words(None, text='text')} END AS prompt FROM rungs""",
    PARSED + ", " + RUNGS,
)
def prompts(v):
    """The next prompt for each text: by the first rung that its answer's error leads to; without an error the first
    reading. A second reading is there for every other text."""
    judged = _judged(v).select("doc_id", "payload", "error").join(v.slips, "doc_id")
    rung = F.when(F.col("error").isNotNull(), F.get(tries.ladder(validate.severity(F.col("error")), F.lit(0.0), F.col("doc_id") % 2 == 0), F.lit(0)))
    r = judged.withColumn("rung", rung)
    return r.select("doc_id", "rung", prompt(F.col("rung"), F.col("text"), F.col("error"), F.col("payload")).alias("prompt"))


@query("PIP4", "SELECT item_id, CAST(min(attempt) FILTER (attempt <= 3 AND quality >= 0.5) AS DOUBLE) AS attempt FROM attempts GROUP BY 1")
def gate(v):
    return tries.gate(v.attempts).select("item_id", *as_double("attempt"))


# ---- usage
COST = "input_tokens / CAST(1000 AS DOUBLE) * coalesce(rate_in, 0.15) + output_tokens / CAST(1000 AS DOUBLE) * coalesce(rate_out, 0.60)"
PRICED = f"priced AS (SELECT a.*, CAST({COST} AS DOUBLE) AS cost FROM attempts a LEFT JOIN pricing p ON replace(upper(model), '-', '_') = p.key)"


@query("JN5", "SELECT item_id, attempt, model, round(cost, 6) AS cost FROM priced", PRICED)
def with_prices(v):
    return usage.priced(v.attempts, v.pricing).select("item_id", "attempt", "model", F.round("cost", 6).alias("cost"))


@query("AGG15", "SELECT model, round(sum(cost), 4) AS cost FROM priced GROUP BY 1", PRICED)
def cost(v):
    return usage.priced(v.attempts, v.pricing).groupBy("model").agg(F.round(F.sum("cost"), 4).alias("cost"))


SUMS = "CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(input_tokens + output_tokens), 0) AS BIGINT) AS total_tokens"


@query("AGG6", f"SELECT {SUMS} FROM attempts")
def token_sums(v):
    return v.attempts.agg(*usage.totals())


@query("AGG7", f"SELECT {SUMS}, count(DISTINCT item_id) AS n, coalesce(sum(input_tokens + output_tokens) / CAST(count(DISTINCT item_id) AS DOUBLE), 0) AS average FROM attempts")
def token_average(v):
    per = v.attempts.groupBy("item_id").agg(*usage.totals())
    n = F.count(F.lit(1))
    return per.agg(*usage.totals(), n.alias("n"), F.coalesce(F.try_divide(F.sum("total_tokens").cast("double"), n), F.lit(0.0)).alias("average"))


@query("AGG8", f"SELECT model, {SUMS} FROM attempts GROUP BY 1")
def by_model(v):
    return v.attempts.groupBy("model").agg(*usage.totals())


@query("AGG9", f"SELECT user_id, count(*) AS sessions, {SUMS}, CAST(sum(estimated_cost) AS DOUBLE) AS cost FROM purchases GROUP BY 1")
def usage_summary(v):
    return v.headers.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), *usage.totals(), F.sum("estimated_cost").cast("double").alias("cost"))


@query("AGG3", f"SELECT count(*) AS total, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status <> 'success') AS failed, avg(epoch_ms(completed_at) - epoch_ms(started_at)) AS average_ms, {SUMS}, count(*) FILTER (status = 'success') * CAST(100 AS DOUBLE) / count(*) AS success_rate FROM purchases")
def batch_summary(v):
    n, ok = F.count(F.lit(1)), F.count_if(F.col("status") == "success")
    ms = F.avg(F.unix_millis("completed_at") - F.unix_millis("started_at"))
    return v.headers.agg(n.alias("total"), ok.alias("successful"), (n - ok).alias("failed"), ms.alias("average_ms"), *usage.totals(), F.coalesce(F.try_divide(ok * F.lit(100.0), n), F.lit(0.0)).alias("success_rate"))


@query("AGG4", "SELECT coalesce(strategy, CASE WHEN success THEN 'primary' ELSE 'error' END) AS method, count(*) AS n FROM attempts GROUP BY 1")
def methods(v):
    method = F.coalesce("strategy", F.when(F.col("success"), "primary").otherwise("error"))
    return v.attempts.groupBy(method.alias("method")).agg(F.count(F.lit(1)).alias("n")).orderBy("method")


USAGE = r"""used AS (SELECT doc_id, CASE WHEN json_valid(payload) THEN CAST(json_extract_string(payload, '$._token_usage.input_tokens') AS INTEGER) END AS i,
  CASE WHEN json_valid(payload) THEN CAST(json_extract_string(payload, '$._token_usage.output_tokens') AS INTEGER) END AS o FROM payloads)"""


@query("USE1", "SELECT doc_id, CAST(i AS DOUBLE) AS input_tokens, CAST(o AS DOUBLE) AS output_tokens, CAST(i + o AS DOUBLE) AS total_tokens FROM used", USAGE)
def payload_usage(v):
    return usage.from_payload(v.payloads).select("doc_id", *as_double("input_tokens", "output_tokens", "total_tokens"))


@query("USE2", "SELECT doc_id, coalesce(i, 0) AS input_tokens, coalesce(o, 0) AS output_tokens, coalesce(i, 0) + coalesce(o, 0) AS total_tokens FROM used", USAGE)
def metadata_usage(v):
    u = usage.from_payload(v.payloads)
    i, o = F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0))
    return u.select("doc_id", i.alias("input_tokens"), o.alias("output_tokens"), (i + o).alias("total_tokens"))


@query(
    "USE3",
    """SELECT item_id || '/' || attempt AS op_name, model, input_tokens, output_tokens, input_tokens + output_tokens AS total_tokens, round(cost, 6) AS cost, epoch_ms(TIMESTAMP '2024-01-01' + to_seconds(item_id * 60 + attempt)) AS at_ms,
    array_to_string(list_filter(['attempt=' || attempt, 'error=' || error, 'strategy=' || strategy], lambda x: x IS NOT NULL), ';') AS metadata FROM priced""",
    PRICED,
)
def operation_log(v):
    """Attempts have no time of their own: it is made up from the item and the attempt."""
    name = F.concat_ws("/", F.col("item_id").cast("string"), F.col("attempt").cast("string"))
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.col("item_id") * 60 + F.col("attempt"))
    log = usage.operations(v.attempts, v.pricing, name, at, {"attempt": F.col("attempt"), "strategy": F.col("strategy"), "error": F.col("error")})
    pairs = F.transform(F.map_entries("metadata"), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return log.select("op_name", "model", "input_tokens", "output_tokens", "total_tokens", F.round("cost", 6).alias("cost"), F.unix_millis("timestamp").alias("at_ms"), F.array_join(pairs, ";").alias("metadata"))


@query("TOP4", "SELECT item_id, attempt, round(cost, 6) AS cost FROM (SELECT * FROM priced ORDER BY cost DESC, item_id, attempt LIMIT 5)", PRICED)
def most_expensive(v):
    return usage.priced(v.attempts, v.pricing).orderBy(F.desc("cost"), "item_id", "attempt").limit(5).select("item_id", "attempt", F.round("cost", 6).alias("cost"))


# ---- traces
@query("TRC1", "SELECT run_id, stage, count(*) AS attempts, count(*) FILTER (NOT success) AS failed FROM trace GROUP BY 1, 2")
def stage_counts(v):
    return trace.stage_counts(v.trace)


@query("TRC2", "SELECT run_id, seq, CAST(epoch_us(lead(ts) OVER (PARTITION BY run_id ORDER BY seq)) - epoch_us(ts) AS DOUBLE) AS duration_us FROM trace")
def durations(v):
    return trace.durations(v.trace).select("run_id", "seq", *as_double("duration_us"))


@query("TRC3", "SELECT user_id AS run_id, count(*) AS attempts, count(DISTINCT image_hash) AS writes, count(*) - count(DISTINCT image_hash) AS duplicates FROM purchases GROUP BY 1 HAVING count(DISTINCT image_hash) > count(*) OR count(*) - count(DISTINCT image_hash) < 0")
def write_invariant(v):
    """Runs that write more than they try, or count fewer duplicates than were not written."""
    firsts = dedupe.first_write_wins(v.headers.select("id", "user_id", "image_hash"), ["user_id", "image_hash"])
    n, w = F.count(F.lit(1)), F.count_if(F.col("id") == F.col("first_id"))
    runs = firsts.groupBy(F.col("user_id").alias("run_id")).agg(n.alias("attempts"), w.alias("writes"), (n - w).alias("duplicates"))
    return trace.broken_writes(runs)


@query("TRC4", "SELECT run_id, stage, count(*) - 1 AS retries FROM trace WHERE stage IN ('OCR', 'PARSE', 'PERSIST') GROUP BY 1, 2 HAVING count(*) - 1 > CASE stage WHEN 'PARSE' THEN 2 ELSE 3 END")
def retry_invariant(v):
    return trace.over_budget(v.trace).select("run_id", "stage", "retries")


@query("TRC5", "SELECT run_id, seq, stage FROM (SELECT *, min(seq) FILTER (terminal) OVER (PARTITION BY run_id) AS e FROM trace) WHERE seq > e")
def terminal_invariant(v):
    return trace.after_terminal(v.trace).select("run_id", "seq", "stage")


@query("TRC6", "SELECT run_id, seq FROM (SELECT *, bool_or(stage = 'VALIDATE' AND success) OVER (PARTITION BY run_id ORDER BY seq) AS seen FROM trace) WHERE stage = 'PERSIST' AND NOT seen")
def order_invariant(v):
    return trace.persist_without_validate(v.trace).select("run_id", "seq")


@query("TRC7", "SELECT run_id, stage, bool_and(CASE WHEN b = 1 THEN success ELSE NOT success END) AS retried_to_success FROM (SELECT *, row_number() OVER (PARTITION BY run_id, stage ORDER BY seq DESC) AS b FROM trace) GROUP BY 1, 2")
def retry_pattern(v):
    return trace.retry_pattern(v.trace)


@query(
    "TRC8",
    """SELECT t.*, coalesce(p.attempts, 0) AS save_attempts, coalesce(p.writes, 0) AS writes, coalesce(p.attempts - p.writes, 0) AS duplicates, method, failed_fields FROM (
    SELECT run_id, count(*) AS n_events, string_agg(DISTINCT stage, ',' ORDER BY stage) AS stages, count(*) FILTER (NOT success) AS failures, bool_or(terminal) AS finished, string_agg(DISTINCT CASE WHEN NOT success THEN stage END, ',') AS failed_stages,
    CASE WHEN bool_or(terminal) THEN 'SUCCESS' WHEN bool_or(stage = 'VALIDATE' AND success) THEN 'PARTIAL' ELSE 'FAILURE' END AS status, count(*) - count(DISTINCT stage) AS retries FROM trace GROUP BY 1) t
    LEFT JOIN (SELECT user_id, count(*) AS attempts, count(DISTINCT image_hash) AS writes, CASE max(retry_count) WHEN 0 THEN 'primary' WHEN 1 THEN 'LLM_SELF_CORRECTION' ELSE 'OCR_FALLBACK' END AS method,
      concat_ws(',', CASE WHEN bool_or(receipt_date < DATE '1996-01-01') THEN 'date' END, CASE WHEN bool_or(total_amount IS NULL) THEN 'total' END) AS failed_fields FROM purchases GROUP BY 1) p ON p.user_id = t.run_id""",
)
def run_report(v):
    """Per run: its stages, failures and retries, how it ended, what it wrote, by what method its hardest document
    was read, and which fields failed validation."""
    stages = F.sort_array(F.collect_list("stage"))
    failed = F.array_join(F.sort_array(F.collect_list(F.when(F.col("failed") > 0, F.col("stage")))), ",")
    passed = F.bool_or((F.col("stage") == "VALIDATE") & (F.col("attempts") > F.col("failed")))
    c = trace.stage_counts(v.trace).groupBy("run_id").agg(
        F.sum("attempts").alias("n_events"), F.array_join(stages, ",").alias("stages"), F.sum("failed").alias("failures"), F.nullif(failed, F.lit("")).alias("failed_stages"), F.sum(F.col("attempts") - 1).alias("retries"), passed.alias("passed")
    )
    ends = v.trace.groupBy("run_id").agg(F.bool_or("terminal").alias("finished"))
    firsts = dedupe.first_write_wins(v.headers.select("id", "user_id", "image_hash"), ["user_id", "image_hash"])
    n, w = F.count(F.lit(1)), F.count_if(F.col("id") == F.col("first_id"))
    writes = firsts.groupBy(F.col("user_id").alias("run_id")).agg(n.alias("save_attempts"), w.alias("writes"), (n - w).alias("duplicates"))
    status = F.when(F.col("finished"), "SUCCESS").when(F.col("passed"), "PARTIAL").otherwise("FAILURE")
    counts = [F.coalesce(k, F.lit(0)).alias(k) for k in ("save_attempts", "writes", "duplicates")]
    read = validate.field_results({"date": F.when(F.col("receipt_date") < "1996-01-01", "too old"), "total": F.when(F.col("total_amount").isNull(), "missing")})
    hardest = F.max("retry_count")
    judged = v.purchases.groupBy(F.col("user_id").alias("run_id")).agg(
        F.when(hardest == 0, "primary").when(hardest == 1, tries.SELF).otherwise(tries.SECOND).alias("method"),
        F.array_join(F.array_compact(F.array(*[F.when(F.bool_or(~read["fields"][f]), f) for f in ("date", "total")])), ",").alias("failed_fields"),
    )
    out = c.join(ends, "run_id").join(writes, "run_id", "left").join(judged, "run_id", "left")
    return out.select("run_id", "n_events", "stages", "failures", "finished", "failed_stages", status.alias("status"), "retries", *counts, "method", "failed_fields")


@query("WIN4", "SELECT run_id, seq, stage FROM (SELECT *, lag(stage) OVER (PARTITION BY run_id ORDER BY seq) AS b FROM trace) WHERE b IS NULL OR b <> stage")
def collapsed(v):
    return trace.collapsed(v.trace).select("run_id", "seq", "stage")


# ---- pipeline
@query("ENR1", """SELECT doc_id, CASE WHEN error IS NULL AND is_object THEN '{"doc_id":' || doc_id || ',"n_items":' || n || '}' END AS metadata FROM messages""", PARSED)
def enrichment(v):
    meta = F.to_json(F.struct("doc_id", F.size("p.items").alias("n_items")))
    return _judged(v).select("doc_id", F.when(F.col("error").isNull() & F.col("p").isNotNull(), meta).alias("metadata"))


STATUS = """SELECT m.doc_id, CASE WHEN r.id <> f.first_id THEN 'DUPLICATED' WHEN s.text IS NULL THEN 'FAILURE' WHEN NOT is_object THEN 'FAILURE' WHEN error IS NOT NULL THEN 'PARTIAL' ELSE 'SUCCESS' END AS status
  FROM messages m JOIN purchases r ON m.doc_id = r.id JOIN (SELECT image_hash, min(id) AS first_id FROM purchases GROUP BY 1) f USING (image_hash) LEFT JOIN slips s ON s.doc_id = m.doc_id"""


def statuses(v):
    """Final status of each document, and its parsed payload."""
    firsts = dedupe.first_write_wins(v.purchases.select("id", "image_hash"), ["image_hash"]).select(F.col("id").alias("doc_id"), (F.col("id") != F.col("first_id")).alias("repeated"))
    texts = v.slips.select("doc_id", F.lit(True).alias("has_text"))
    all_ = _judged(v).join(firsts, "doc_id").join(texts, "doc_id", "left")
    status = F.when(F.col("repeated"), "DUPLICATED").when(F.col("has_text").isNull(), "FAILURE").when(F.col("p").isNull(), "FAILURE").when(F.col("error").isNotNull(), "PARTIAL").otherwise("SUCCESS")
    return all_.withColumn("status", status)


@query("PIP1", STATUS, PARSED)
def status_resolution(v):
    return statuses(v).select("doc_id", "status")


@query("PIP2", "SELECT doc_id, coalesce(error IS NULL AND is_object AND n > 0 AND total IS NOT NULL, FALSE) AS success, error FROM messages", PARSED)
def batch(v):
    return _judged(v).select("doc_id", (F.col("error").isNull() & validate.meaningful(F.col("p"))).alias("success"), "error")


@query(
    "HSH4",
    """SELECT id, sha256('{"date":' || coalesce('"' || receipt_date || '"', '"None"') || ',"lines":' || coalesce(lines, '"None"') || ',"merchant":' || coalesce('[' || array_to_string(list_sort(list_transform(string_split(merchant_name, ' '), lambda w: '"' || replace(w, '"', chr(92) || '"') || '"')), ',') || ']', '"None"')
    || ',"run":{"late":' || CASE WHEN retry_count > 1 THEN 'true' ELSE 'false' END || ',"marks":[' || CASE WHEN retry_count > 1 THEN '"2","True"' WHEN retry_count = 1 THEN '"1","False"' ELSE '"0","False"' END || '],"paid":{"cost":"' || estimated_cost || '","tokens":' || input_tokens || '}},"total":' || coalesce('"' || total_amount || '"', '"None"') || '}') AS digest
    FROM purchases LEFT JOIN (SELECT receipt_id, '[' || string_agg('{"n":' || line_number || ',"price":"' || total_price || '"}', ',' ORDER BY line_number) || ']' AS lines FROM items GROUP BY 1) ON receipt_id = id""",
)
def generic_digest(v):
    """Digest of nested records: keys in order, lists of scalars sorted as texts, lists of records as they are."""
    line = F.struct("line_number", F.struct(F.col("total_price").alias("price"), F.col("line_number").alias("n")).alias("line"))
    lines = v.items.groupBy(F.col("receipt_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]).alias("lines"))
    late = F.col("retry_count") > 1
    run = F.struct(late.alias("late"), F.array(F.when(late, "True").otherwise("False"), F.col("retry_count").cast("string")).alias("marks"), F.struct(F.col("input_tokens").alias("tokens"), F.col("estimated_cost").alias("cost")).alias("paid"))
    record = F.struct(F.col("total_amount").alias("total"), F.split("merchant_name", " ").alias("merchant"), F.col("receipt_date").alias("date"), "lines", run.alias("run"))
    r = v.purchases.join(lines, "id", "left").select("id", record.alias("r"))
    return r.select("id", hashing.generic_digest(F.col("r"), r.schema["r"].dataType).alias("digest"))
