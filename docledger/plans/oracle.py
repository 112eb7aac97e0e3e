"""The ledger's views in DuckDB SQL, put before every oracle query."""

from ..sources.ledger import FAULTY

LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"


def _part(n: int, given: str) -> str:
    """A part of a payload: as it is given, or wrong by key."""
    wrong = " ".join(f"WHEN {i} THEN '{parts[n]}'" for i, parts in enumerate(FAULTY) if parts[n])
    return f"CASE CASE WHEN id % 7 = 5 THEN (id // 7) % {len(FAULTY)} ELSE -1 END {wrong} ELSE {given} END"


VIEWS = rf"""
users AS (SELECT c_custkey AS id, lower(c_name) || '@example.com' AS email, c_acctbal >= 0 AS is_active,
  DATE '2024-01-01' + CAST(c_custkey % 365 AS INTEGER) AS created_at FROM customer),
items AS (SELECT l_orderkey AS receipt_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) AS INTEGER) AS line_number,
  p_name AS description, p_type AS category, CAST(l_quantity AS DECIMAL(8,2)) AS quantity,
  CAST(((CAST(round(l_extendedprice * 100) AS BIGINT) * 2 + CAST(l_quantity AS BIGINT)) // (CAST(l_quantity AS BIGINT) * 2)) / 100.0 AS DECIMAL(18,2)) AS unit_price,
  CAST(round(l_extendedprice, 2) AS DECIMAL(18,2)) AS total_price, l_tax > 0 AS is_taxable, CAST(round(l_tax, 4) AS DECIMAL(5,4)) AS tax_rate
  FROM lineitem JOIN part ON l_partkey = p_partkey),
sums AS (SELECT l_orderkey AS sum_id, CAST(sum(CAST(round(l_extendedprice, 2) AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS items_sum, min(l_suppkey) AS suppkey FROM lineitem GROUP BY 1),
purchases AS (SELECT o_orderkey AS id, o_custkey AS user_id, 'img/' || o_orderkey || '.png' AS image_path, sha256(CAST(o_orderkey % 5000 AS VARCHAR)) AS image_hash,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'failed' END AS status, CAST(o_orderdate AS DATE) AS receipt_date, s_name AS merchant_name,
  CAST(coalesce(items_sum, 0) + CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 0.5 WHEN 2 THEN 3 WHEN 3 THEN 20 END AS DECIMAL(18,2)) AS total_amount, items_sum,
  CAST(o_orderkey % 3 AS INTEGER) AS retry_count, CAST((o_orderkey % 10 + 1) / 100.0 AS DECIMAL(10,6)) AS estimated_cost,
  CAST(o_orderkey % 900 + 100 AS INTEGER) AS input_tokens, CAST(o_orderkey % 90 + 10 AS INTEGER) AS output_tokens,
  o_orderdate AS started_at, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_seconds(o_orderkey % 7 + 1) END AS completed_at
  FROM orders LEFT JOIN sums ON o_orderkey = sum_id LEFT JOIN supplier ON suppkey = s_suppkey),
hashed AS (SELECT r.*, sha256(coalesce(CAST(receipt_date AS VARCHAR), '') || '|' || lower(trim(coalesce(merchant_name, ''))) || '|' || coalesce(CAST(total_amount AS VARCHAR), '') || '|' || coalesce(l, '')) AS data_hash
  FROM purchases r LEFT JOIN (SELECT receipt_id, string_agg(lower(trim(description)) || '~' || total_price || '~' || quantity, ';' ORDER BY lower(trim(description)), total_price, quantity) AS l FROM items GROUP BY 1) ON id = receipt_id),
bodies AS (SELECT receipt_id AS k, string_agg(description || ' ' || total_price, chr(10) ORDER BY line_number) AS body, CAST(CAST(sum(total_price) AS DECIMAL(18,2)) AS VARCHAR) AS total FROM items GROUP BY 1),
slips AS (SELECT k AS doc_id, CASE k % 6 WHEN 0 THEN body || chr(10) || 'TOTAL ' || total WHEN 1 THEN body || chr(10) || 'T0TAL ' || total
  WHEN 2 THEN replace(body || chr(10) || 'TOTAL ' || total, '.', ',') WHEN 3 THEN body || chr(10) || 'TOTAL ($' || total || 'SO).'
  WHEN 4 THEN ' ' || chr(10) || chr(10) || replace(body || chr(10) || 'TOTAL ' || total, ' ', ' ' || chr(9) || ' ') || chr(10) || ' ' || chr(10)
  ELSE 'GROCERY STORE' || chr(10) || 'CASHIER ANNA 7 X' || chr(10) || '03/15/2024' || chr(10) || body || chr(10) || 'AM0UNT: ' || total || chr(10) || 'Cust0mer copy' END AS text FROM bodies),
payloads AS (SELECT id AS doc_id, CASE id % 7 WHEN 0 THEN 'not valid json' WHEN 1 THEN '["not","a","dict"]' WHEN 2 THEN '  ' ELSE
  ' {{"date":' || {_part(0, """'"' || receipt_date || '"'""")} || ',"total":' || {_part(1, "CASE WHEN id % 7 = 4 THEN 'null' ELSE coalesce(CAST(total_amount AS VARCHAR), 'null') END")} || ',"items":' || {_part(2, "'[' || coalesce(j, '') || ']'")} ||
  CASE WHEN id % 7 <> 6 THEN ',"_token_usage":{{"input_tokens":' || input_tokens || ',"output_tokens":' || output_tokens || '}}' ELSE '' END || '}}' || chr(10) END AS payload
  FROM purchases LEFT JOIN (SELECT receipt_id, string_agg('{{"description":"' || description || '","price":' || CASE WHEN receipt_id % 7 = 3 THEN -total_price ELSE total_price END || '}}', ',' ORDER BY line_number) AS j FROM items GROUP BY 1) ON id = receipt_id),
attempts AS (SELECT conv_id AS item_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS INTEGER) AS attempt, (conv_id + turn) % 3 = 2 AS success, (conv_id + turn) % 4 <> 0 AS parsed,
  CASE WHEN (conv_id + turn) % 3 <> 2 THEN CASE (conv_id + turn) % 6 WHEN 0 THEN 'Total 7.50 does not match sum of items 7.00' WHEN 1 THEN 'Total 12.00 does not match sum of items 8.00' WHEN 2 THEN 'Total 30.00 does not match sum of items 8.00'
    WHEN 3 THEN 'Validation failed: Missing date' WHEN 4 THEN 'RAG validation failed: Invalid price' ELSE 'Could not parse' END END AS error,
  CASE WHEN (conv_id + turn) % 3 <> 2 THEN CASE WHEN (conv_id + turn) % 2 = 0 THEN 'ValueError' ELSE 'TimeoutError' END END AS error_type,
  CASE WHEN turn > 0 THEN CASE turn % 3 WHEN 1 THEN 'LLM_SELF_CORRECTION' WHEN 2 THEN 'RAG_FOCUSED_CONTEXT' ELSE 'OCR_FALLBACK' END END AS strategy,
  CAST(CASE WHEN role = 'assistant' THEN 0 ELSE length(text) - length(replace(text, ' ', '')) + 1 END AS INTEGER) AS input_tokens,
  CAST(CASE WHEN role = 'assistant' THEN length(text) - length(replace(text, ' ', '')) + 1 ELSE 0 END AS INTEGER) AS output_tokens,
  CASE conv_id % 4 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'gpt-4o' WHEN 2 THEN 'gpt-3.5-turbo' ELSE 'mystery-1' END AS model, ((conv_id * 7 + turn * 3) % 20) / CAST(20 AS DOUBLE) AS quality
  FROM conversations),
trace AS (SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq,
  CASE event_type WHEN 'signup' THEN 'OCR' WHEN 'view' THEN 'PARSE' WHEN 'click' THEN 'VALIDATE' WHEN 'purchase' THEN 'PERSIST' WHEN 'error' THEN 'PARSE' END AS stage,
  event_type <> 'error' AS success, event_type = 'purchase' AS terminal, ts FROM events),
pricing AS (SELECT * FROM (VALUES ('GPT_4O_MINI', 'gpt-4o-mini', CAST(0.15 AS DOUBLE), CAST(0.60 AS DOUBLE)), ('GPT_4O', 'gpt-4o', 2.50, 10.00), ('GPT_3_5_TURBO', 'gpt-3.5-turbo', 0.50, 1.50)) AS p(key, name, rate_in, rate_out))
"""


def sql(query: str, more: str = "") -> str:
    """``query`` over the views; ``more``: further views that it needs."""
    return f"WITH RECURSIVE {VIEWS.strip()}{', ' + more if more else ''}\n{query}"
