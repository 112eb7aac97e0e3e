"""Checks of model output and classification of errors, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed

#: Wording of messages and prefixes that a reason is shown without.
UNPARSED = "Failed to parse JSON"
MISMATCH = r"Total ([\d.,]+) does not match sum of items ([\d.,]+)"
PREFIXES = ("Validation failed: ", "Self-correction validation failed: ", "RAG validation failed: ", "OCR fallback validation failed: ", "Response content validation failed: ")
#: Names of the kinds of faults, and ours for what is said about each.
FAULTS = {
    "missing": "missing", "string_type": "not a text", "decimal_type": "not a decimal", "decimal_parsing": "not readable as a decimal", "finite_number": "not finite",
    "list_type": "not a list", "model_type": "not an object", "value_error": "Invalid price",
}
#: A decimal as text, once spaces around it and underscores are gone, and what is no finite one.
DECIMAL, UNBOUNDED = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", r"(?i)^[+-]?(inf|infinity|s?nan\d*)$"
AMOUNT, SUM = "decimal(30,10)", "decimal(38,10)"
ITEMS, FOUND = f"array<struct<description:string,price:{AMOUNT}>>", "array<struct<path:string,kind:string>>"
FIELDS = ("merchant", "date", "total", "items", "currency")


def let(c: Column, use) -> Column:
    """``use(c)``, where ``c`` is computed once."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def kind(v: Column) -> Column:
    """What a variant holds: absent, null, text, boolean, number, list or object. Only a scalar's type is looked up by
    name: that of a list or an object would be put together from all that is in it."""
    scalar = let(F.schema_of_variant(v), lambda name: F.when(name == "STRING", "text").when(name == "BOOLEAN", "boolean").otherwise("number"))
    nested = F.when(F.try_variant_get(v, "$", "array<variant>").isNotNull(), "list").when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), "object")
    return F.when(v.isNull(), "absent").when(F.is_variant_null(v), "null").otherwise(F.coalesce(nested, scalar))


def tagged(v: Column) -> Column:
    """struct<v, kind> of a variant."""
    return F.struct(v.alias("v"), kind(v).alias("kind"))


def is_object(c: Column) -> Column:
    """Whether a text is a JSON object."""
    return F.coalesce(let(F.try_parse_json(trimmed(c)), kind) == "object", F.lit(False))


def _text(t: Column, required: bool) -> Column:
    """struct<value, kind>: a tagged variant's text and its fault."""
    fine = ("text",) if required else ("text", "null", "absent")
    fault = F.when(t["kind"].isin(*fine), None).when(t["kind"] == "absent", "missing").otherwise("string_type")
    return F.struct(F.when(t["kind"] == "text", F.try_variant_get(t["v"], "$", "string")).alias("value"), fault.alias("kind"))


def _decimal(t: Column, required: bool) -> Column:
    """struct<value, kind>: a tagged variant's decimal, from a number or a text, and its fault. A decimal of more than 20
    digits before the point is not readable; digits beyond the tenth after it are rounded off."""
    said, absent = t["kind"], F.lit("missing") if required else F.lit(None)

    def read(text: Column) -> Column:
        value = F.when(F.regexp_like(text, F.lit(DECIMAL)), text.try_cast(AMOUNT))
        return F.struct(value.alias("value"), F.when(value.isNotNull(), None).when(F.regexp_like(text, F.lit(UNBOUNDED)), "finite_number").otherwise("decimal_parsing").alias("kind"))

    number = let(F.try_variant_get(t["v"], "$", AMOUNT), lambda x: F.struct(x.alias("value"), F.when(x.isNull(), "decimal_parsing").alias("kind")))
    text = let(F.replace(trimmed(F.try_variant_get(t["v"], "$", "string")), F.lit("_"), F.lit("")), read)
    other = F.struct(F.lit(None).cast(AMOUNT).alias("value"), F.when(said == "absent", absent).when((said == "null") & F.lit(not required), None).otherwise("decimal_type").alias("kind"))
    return F.when(said == "number", number).when(said == "text", text).otherwise(other)


def _found(*faults: tuple[Column, Column]) -> Column:
    """The faults (path, kind) whose kind is not null."""
    return F.array_compact(F.array(*[F.when(k.isNotNull(), F.struct(p.alias("path"), k.alias("kind"))) for p, k in faults])).cast(FOUND)


def _item(v: Column, i: Column) -> Column:
    """struct<item, faults> of the i-th entry of a list of items."""
    path = F.concat(F.lit("items["), i.cast("string"), F.lit("]"))
    get = lambda name: let(F.try_variant_get(v, f"$.{name}", "variant"), tagged)

    def judged(f: Column) -> Column:
        d, p = f["d"], f["p"]
        negative = F.when(p["value"] < 0, "value_error")
        item = F.struct(d["value"].alias("description"), p["value"].alias("price"))
        faults = _found((F.concat(path, F.lit(".description")), d["kind"]), (F.concat(path, F.lit(".price")), F.coalesce(p["kind"], negative)))
        return F.struct(item.alias("item"), faults.alias("faults"))

    fields = F.struct(let(get("description"), lambda t: _text(t, True)).alias("d"), let(get("price"), lambda t: _decimal(t, True)).alias("p"))
    nothing = F.struct(F.lit(None).cast("string").alias("description"), F.lit(None).cast(AMOUNT).alias("price"))
    return F.when(kind(v) == "object", let(fields, judged)).otherwise(F.struct(nothing.alias("item"), _found((path, F.lit("model_type"))).alias("faults")))


def typed(c: Column) -> Column:
    """struct<date, total, items, faults>: the typed payload; null if the text is not an object.

    Absent items are none, an absent or null date or total is null. What has the wrong type is null (an entry
    of items keeps its place), and ``faults`` lists the path and kind of each such value, in the order of the
    fields. A text with a decimal in it counts as one; a boolean does not."""

    def parts(v: Column) -> Column:
        get = lambda name: let(F.try_variant_get(v, f"$.{name}", "variant"), tagged)

        def listed(t: Column) -> Column:
            entries = F.when(t["kind"] == "list", F.try_variant_get(t["v"], "$", "array<variant>"))
            return F.struct(F.transform(entries, _item).alias("entries"), F.when(~t["kind"].isin("list", "absent"), "list_type").alias("wrong"))

        whole = F.struct(let(get("date"), lambda t: _text(t, False)).alias("date"), let(get("total"), lambda t: _decimal(t, False)).alias("total"), let(get("items"), listed).alias("items"))
        return F.when(kind(v) == "object", let(whole, built))

    def built(p: Column) -> Column:
        none = F.array().cast(FOUND)
        entries = p["items"]["entries"]
        inner = F.coalesce(F.flatten(F.transform(entries, lambda x: x["faults"])), none)
        faults = F.concat(_found((F.lit("date"), p["date"]["kind"]), (F.lit("items"), p["items"]["wrong"])), inner, _found((F.lit("total"), p["total"]["kind"])))
        items = F.coalesce(F.transform(entries, lambda x: x["item"]), F.array().cast(ITEMS))
        return F.struct(p["date"]["value"].alias("date"), p["total"]["value"].alias("total"), items.alias("items"), faults.alias("faults"))

    return let(F.try_parse_json(trimmed(c)), parts)


def item_sum(items: Column) -> Column:
    zero = F.lit(0).cast(SUM)
    return F.aggregate(items, zero, lambda a, x: (a + F.coalesce(x["price"], F.lit(0).cast(AMOUNT))).cast(SUM))


def prices_ok(items: Column) -> Column:
    return F.forall(items, lambda x: F.coalesce(x["price"] >= 0, F.lit(False)))


def mismatch(total: Column, sums: Column, tolerance: str = "0.01") -> Column:
    """Message for a total that is further than ``tolerance`` from the sum, else null."""
    off = F.abs(total - sums) > F.lit(tolerance).cast("decimal(4,2)")
    text = lambda c: c.cast("decimal(38,2)").cast("string")
    return F.when(off, F.concat(F.lit("Total "), text(total), F.lit(" does not match sum of items "), text(sums)))


def fault_list(p: Column) -> Column:
    """A typed payload's faults as path:kind, in order."""
    return F.transform(p["faults"], lambda x: F.concat_ws(":", x["path"], x["kind"]))


def problems(p: Column) -> Column:
    """Messages about a typed payload: none if it is valid. What was parsed is kept anyway. Each fault has one, all
    prices below zero one together; a total is held against its items only if these have no fault."""
    said = F.create_map(*[F.lit(x) for pair in FAULTS.items() for x in pair])
    about = lambda x: F.when(x["kind"] == "value_error", F.element_at(said, x["kind"])).otherwise(F.concat(x["path"], F.lit(": "), F.element_at(said, x["kind"])))
    sound = ~F.exists(p["faults"], lambda x: F.startswith(x["path"], F.lit("items")))
    messages = F.concat(F.array_distinct(F.transform(p["faults"], about)), F.array_compact(F.array(F.when(sound, mismatch(p["total"], item_sum(p["items"]))))))
    return F.when(p.isNull(), F.array(F.lit(UNPARSED))).otherwise(messages)


def meaningful(p: Column) -> Column:
    return F.coalesce((F.size(p["items"]) > 0) & p["total"].isNotNull(), F.lit(False))


def _amount(c: Column, group: int) -> Column:
    return F.replace(F.regexp_extract(c, MISMATCH, group), F.lit(","), F.lit(".")).try_cast("decimal(18,2)")


def mismatch_amount(c: Column) -> Column:
    return F.nullif(F.abs(_amount(c, 1) - _amount(c, 2)), F.lit(0).cast("decimal(18,2)"))


def severity(c: Column) -> Column:
    off = F.abs(_amount(c, 1) - _amount(c, 2))
    small, medium = F.lit("1.00").cast("decimal(18,2)"), F.lit("5.00").cast("decimal(18,2)")
    by_size = F.when(off < small, "small").when(off <= medium, "medium").when(off.isNotNull(), "large").otherwise("unknown")
    low = F.lower(c)
    by_word = F.when(F.contains(low, F.lit("missing")), "medium").when(F.contains(low, F.lit("invalid")), "small").otherwise("unknown")
    return F.when(F.regexp_like(c, F.lit(MISMATCH)), by_size).otherwise(by_word)


def difference(c: Column) -> Column:
    """By how much the two figures of a mismatch differ; null for other messages."""
    return F.when(F.regexp_like(c, F.lit(MISMATCH)), F.abs(_amount(c, 1) - _amount(c, 2)))


def reason(c: Column) -> Column:
    """A message for counting: a mismatch without its figures, else the message without
    known prefixes, at most 80 characters."""
    clean = c
    for p in PREFIXES:
        clean = F.replace(clean, F.lit(p), F.lit(""))
    short = F.when(F.char_length(clean) > 80, F.concat(F.substring(clean, 1, 77), F.lit("..."))).otherwise(clean)
    return F.when(F.regexp_like(c, F.lit(MISMATCH)), "Total mismatch").otherwise(short)


def field_results(checks: dict[str, Column], doubts: dict[str, Column] | None = None, attempts: Column | None = None, budget: int = 3) -> Column:
    """struct<valid, errors, warnings, retryable, preserve_partial, fields>: ``checks`` has for a field its
    error message or null, ``doubts`` what does not make it invalid; a field without a check is valid. A record that
    is not valid may be tried again while ``attempts`` are below the budget, and what is valid of it is kept if
    any checked field is."""
    none = F.lit(None).cast("string")
    named = lambda found: F.array_compact(F.array(*[F.concat(F.lit(f"{f}: "), found.get(f, none)) for f in FIELDS]))
    errors_, tried = named(checks), F.lit(0) if attempts is None else attempts
    valid = F.size(errors_) == 0
    return F.struct(
        valid.alias("valid"),
        errors_.alias("errors"),
        named(doubts or {}).alias("warnings"),
        (~valid & (tried < budget)).alias("retryable"),
        (~valid & (F.size(errors_) < len(checks))).alias("preserve_partial"),
        F.struct(*[checks.get(f, none).isNull().alias(f) for f in FIELDS]).alias("fields"),
    )
