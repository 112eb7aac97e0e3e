"""The ledger's tables, bound to the given purchase tables.

Customers are users, orders are purchases, line items with their parts are receipt items;
slips are purchases rendered as scanned text (with typical reading errors by key),
payloads are purchases as model output (with typical faults by key), attempts are
conversation turns and traces are event streams. Every view is a lazy DataFrame."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordered import numbered, scan

STATUS = {"F": "success", "O": "pending", "P": "failed"}
STAGE = {"signup": "OCR", "view": "PARSE", "click": "VALIDATE", "purchase": "PERSIST", "error": "PARSE"}
MODELS = ("gpt-4o-mini", "gpt-4o", "gpt-3.5-turbo", "mystery-1")
MESSAGES = (
    "Total 7.50 does not match sum of items 7.00",
    "Total 12.00 does not match sum of items 8.00",
    "Total 30.00 does not match sum of items 8.00",
    "Validation failed: Missing date",
    "RAG validation failed: Invalid price",
    "Could not parse",
)


#: Parts of payloads with values of wrong types, by key: date, total and items in JSON, None for what is
#: given. Some are right: a decimal as text, no items at all.
FAULTY = (
    (None, '"abc"', None), (None, "true", None), (None, '" 1_2.50 "', '[{"description":"tea","price":"12.5"}]'), (None, None, "5"), (None, None, "null"),
    (None, None, '[{"price":1}]'), (None, None, '[{"description":5,"price":"1.50"},{"description":null,"price":1}]'),
    (None, "1", '[{"description":"x","price":null},{"description":"y","price":true},7,null]'),
    (None, '"Infinity"', '[{"description":"x","price":"1.x"},{"description":"y","price":"NaN"},{"description":"z","price":" 1_0.5 "}]'),
    ("20240315", None, None), (None, "null", "[]"), ("null", "[1]", '[{"description":"x"},[],{"description":"y","price":-2}]'), ("{}", "1.23456", '[{"description":"x","price":1.2246}]'),
)


def money(c: Column) -> Column:
    return F.round(c, 2).cast("decimal(18,2)")


def case(c: Column, table: dict) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out


def pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


class Ledger:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def users(self) -> DataFrame:
        c = self.table("customer")
        return c.select(
            F.col("c_custkey").alias("id"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
            (F.col("c_acctbal") >= 0).alias("is_active"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int")).alias("created_at"),
        )

    @cached_property
    def items(self) -> DataFrame:
        order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
        lines = self.table("lineitem").withColumnRenamed("l_orderkey", "receipt_id").join(self.table("part").select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        q, cents = F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long")
        return lines.select(
            "receipt_id",
            F.row_number().over(Window.partitionBy("receipt_id").orderBy(*order)).alias("line_number"),  # by the column itself, so that a condition on it goes below
            F.col("p_name").alias("description"),
            F.col("p_type").alias("category"),
            F.col("l_quantity").cast("decimal(8,2)").alias("quantity"),
            (F.floor((cents * 2 + q) / (q * 2)) / 100.0).cast("decimal(18,2)").alias("unit_price"),
            money(F.col("l_extendedprice")).alias("total_price"),
            (F.col("l_tax") > 0).alias("is_taxable"),
            F.round("l_tax", 4).cast("decimal(5,4)").alias("tax_rate"),
        )

    @cached_property
    def sums(self) -> DataFrame:
        lines = self.table("lineitem")
        return lines.groupBy(F.col("l_orderkey").alias("sum_id")).agg(F.sum(money(F.col("l_extendedprice"))).cast("decimal(18,2)").alias("items_sum"), F.min("l_suppkey").alias("suppkey"))

    @cached_property
    def headers(self) -> DataFrame:
        """Purchases without what derives from their items: a scan of one table."""
        o, k = self.table("orders"), F.col("o_orderkey")
        status = case(F.col("o_orderstatus"), STATUS)
        started = F.col("o_orderdate").cast("timestamp")
        return o.select(
            k.alias("id"),
            F.col("o_custkey").alias("user_id"),
            F.concat(F.lit("img/"), k.cast("string"), F.lit(".png")).alias("image_path"),
            F.sha2((k % 5000).cast("string"), 256).alias("image_hash"),
            status.alias("status"),
            F.col("o_orderdate").cast("date").alias("receipt_date"),
            (k % 3).cast("int").alias("retry_count"),
            ((k % 10 + 1) / 100.0).cast("decimal(10,6)").alias("estimated_cost"),
            (k % 900 + 100).cast("int").alias("input_tokens"),
            (k % 90 + 10).cast("int").alias("output_tokens"),
            started.alias("started_at"),
            F.when(status == "success", F.timestamp_seconds(F.unix_seconds(started) + k % 7 + 1)).alias("completed_at"),
        )

    @cached_property
    def purchases(self) -> DataFrame:
        """Headers with the total, the sum of the items and the merchant."""
        k, s = F.col("id"), F.coalesce("items_sum", F.lit(0).cast("decimal(18,2)"))
        add = F.when(k % 5 == 0, 0).when(k % 5 == 1, 0.5).when(k % 5 == 2, 3).when(k % 5 == 3, 20).cast("decimal(18,2)")
        joined = self.headers.join(self.sums, k == F.col("sum_id"), "left").join(self.table("supplier").select("s_suppkey", "s_name"), F.col("suppkey") == F.col("s_suppkey"), "left")
        return joined.withColumns({"total_amount": (s + add).cast("decimal(18,2)"), "merchant_name": F.col("s_name")}).drop("sum_id", "suppkey", "s_suppkey", "s_name")

    @cached_property
    def hashed(self) -> DataFrame:
        """Purchases with the digest of their content, from totals, merchants and items."""
        from ..functions.hashing import content_string

        lines = self.items.groupBy(F.col("receipt_id").alias("hid")).agg(F.sort_array(F.collect_list(F.struct(F.lower(F.trim("description")).alias("d"), F.col("total_price").alias("p"), F.col("quantity").alias("q")))).alias("lines"))
        r = self.purchases.join(lines, F.col("id") == F.col("hid"), "left").drop("hid")
        return r.withColumn("data_hash", F.sha2(content_string(F.col("receipt_date"), F.col("merchant_name"), F.col("total_amount"), F.col("lines")), 256)).drop("lines")

    @cached_property
    def slips(self) -> DataFrame:
        line = F.struct("line_number", F.concat_ws(" ", "description", F.col("total_price").cast("string")).alias("t"))
        body = self.items.groupBy("receipt_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["t"]), "\n").alias("body"), F.sum("total_price").cast("decimal(18,2)").cast("string").alias("total"))
        k = F.col("receipt_id") % 6
        plain = F.concat("body", F.lit("\nTOTAL "), "total")
        head = F.lit("GROCERY STORE\nCASHIER ANNA 7 X\n03/15/2024\n")
        text = (
            F.when(k == 0, plain)
            .when(k == 1, F.concat("body", F.lit("\nT0TAL "), "total"))
            .when(k == 2, F.replace(plain, F.lit("."), F.lit(",")))
            .when(k == 3, F.concat("body", F.lit("\nTOTAL ($"), "total", F.lit("SO).")))
            .when(k == 4, F.concat(F.lit(" \n\n"), F.replace(plain, F.lit(" "), F.lit(" \t ")), F.lit("\n \n")))
            .otherwise(F.concat(head, "body", F.lit("\nAM0UNT: "), "total", F.lit("\nCust0mer copy")))
        )
        return body.select(F.col("receipt_id").alias("doc_id"), text.alias("text"))

    @cached_property
    def payloads(self) -> DataFrame:
        k = F.col("id") % 7
        price = F.when(F.col("receipt_id") % 7 == 3, -F.col("total_price")).otherwise(F.col("total_price")).cast("string")
        item = F.concat(F.lit('{"description":"'), "description", F.lit('","price":'), price, F.lit("}"))
        body = self.items.groupBy("receipt_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_number", item.alias("j")))), lambda x: x["j"]), ",").alias("body"))
        r = self.purchases.join(body, F.col("id") == F.col("receipt_id"), "left")
        total = F.when(k == 4, F.lit("null")).otherwise(F.coalesce(F.col("total_amount").cast("string"), F.lit("null")))
        usage = F.when(k != 6, F.concat(F.lit(',"_token_usage":{"input_tokens":'), F.col("input_tokens").cast("string"), F.lit(',"output_tokens":'), F.col("output_tokens").cast("string"), F.lit("}"))).otherwise("")
        given = (F.concat(F.lit('"'), F.col("receipt_date").cast("string"), F.lit('"')), total, F.concat(F.lit("["), F.coalesce("body", F.lit("")), F.lit("]")))
        fault = F.when(k == 5, F.floor(F.col("id") / 7) % len(FAULTY))
        date, total, items = (F.coalesce(case(fault, {i: parts[n] for i, parts in enumerate(FAULTY) if parts[n]}), g) for n, g in enumerate(given))
        good = F.concat(F.lit(' {"date":'), date, F.lit(',"total":'), total, F.lit(',"items":'), items, usage, F.lit("}\n"))
        text = F.when(k == 0, "not valid json").when(k == 1, '["not","a","dict"]').when(k == 2, "  ").otherwise(good)
        return r.select(F.col("id").alias("doc_id"), text.alias("payload"))

    @cached_property
    def attempts(self) -> DataFrame:
        c = scan(self.table("conversations"), "conv_id", ["turn", "role", "text"], {"attempt": numbered()})
        n = F.col("conv_id") + F.col("turn")
        words = (F.char_length("text") - F.char_length(F.replace("text", F.lit(" "), F.lit(""))) + 1).cast("int")
        ok = n % 3 == 2
        return c.select(
            F.col("conv_id").alias("item_id"),
            "attempt",
            ok.alias("success"),
            (n % 4 != 0).alias("parsed"),
            F.when(~ok, pick(n % 6, MESSAGES)).alias("error"),
            F.when(~ok, F.when(n % 2 == 0, "ValueError").otherwise("TimeoutError")).alias("error_type"),
            F.when(F.col("turn") > 0, F.when(F.col("turn") % 3 == 1, "LLM_SELF_CORRECTION").when(F.col("turn") % 3 == 2, "RAG_FOCUSED_CONTEXT").otherwise("OCR_FALLBACK")).alias("strategy"),
            F.when(F.col("role") == "assistant", F.lit(0)).otherwise(words).alias("input_tokens"),
            F.when(F.col("role") == "assistant", words).otherwise(F.lit(0)).alias("output_tokens"),
            pick(F.col("conv_id") % 4, MODELS).alias("model"),
            ((F.col("conv_id") * 7 + F.col("turn") * 3) % 20 / 20.0).alias("quality"),
        )

    @cached_property
    def trace(self) -> DataFrame:
        e = scan(self.table("events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", ["ts", "event_id"], {"seq": numbered()})
        return e.select(
            F.col("user_id").alias("run_id"),
            "seq",
            case(F.col("event_type"), STAGE).alias("stage"),
            (F.col("event_type") != "error").alias("success"),
            (F.col("event_type") == "purchase").alias("terminal"),
            "ts",
        )

    @cached_property
    def pricing(self) -> DataFrame:
        """Cost of 1000 tokens, in and out, for each model."""
        rows = [("GPT_4O_MINI", "gpt-4o-mini", 0.15, 0.60), ("GPT_4O", "gpt-4o", 2.50, 10.00), ("GPT_3_5_TURBO", "gpt-3.5-turbo", 0.50, 1.50)]
        return self.spark.createDataFrame(rows, "key string, name string, rate_in double, rate_out double")
