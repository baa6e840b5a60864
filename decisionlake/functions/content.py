"""Message content (text, block list or single block) to plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_TYPES = ("text", "input_text", "output_text", "reasoning_text")


def kind(v: Column) -> Column:
    """STRING, OBJECT, ARRAY, ...; NULL when the path was absent."""
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def spaced_json(compact: Column) -> Column:
    """Compact JSON text with a blank after every separator outside strings."""
    return F.regexp_replace(compact, r'\G((?:[^",:]|"(?:[^"\\]|\\.)*")*+)([,:])', "$1$2 ")


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later filters and projections read instead of repeating its expression."""
    return df.withColumn(name, F.explode(F.array(value)))


def _cut(text: Column, max_chars: int) -> Column:
    marker = lambda t: F.concat(F.lit("\n…[truncated "), (F.length(t) - max_chars).cast("string"), F.lit(" chars]"))
    return bind(text, lambda t: F.when(
        F.length(t) > max_chars, F.concat(F.left(t, F.lit(max_chars)), marker(t))).otherwise(t))


RESULT_CHARS = 300                        # of a tool's arguments and of its result that are shown
SMALLEST_RESULT = len('{"type":"tool_result","content":}')      # characters that one more level takes at least


def _items(v: Column, raw: Column, blocks: Column) -> Column:
    """The blocks of a list (``blocks``), or of a single block, each as (variant, JSON text)."""
    one = F.array(F.struct(v.alias("b"), raw.alias("s")))
    many = F.zip_with(blocks, F.from_json(raw, "array<string>"), lambda b, s: F.struct(b.alias("b"), s.alias("s")))
    return F.when(blocks.isNull(), one).otherwise(many)


def _holds_blocks(b: Column) -> Column:
    """Whether a block is a tool result whose content is blocks again."""
    holds = lambda shape: F.try_variant_get(b, "$.content", shape).isNotNull()
    is_result = F.coalesce(F.try_variant_get(b, "$.type", "string") == "tool_result", F.lit(False))
    return is_result & (holds("array<variant>") | holds("map<string,variant>"))


def _plain(b: Column, s: Column) -> Column:
    """Text of a block that holds no other blocks; NULL for blocks that carry none."""
    head = F.struct(b.alias("b"), s.alias("s"), kind(b).alias("k"), F.try_variant_get(b, "$.type", "string").alias("t"),
                    F.nullif(F.try_variant_get(b, "$.text", "string"), F.lit("")).alias("x"))

    def text(h: Column) -> Column:
        think = F.nullif(F.try_variant_get(h["b"], "$.thinking", "string"), F.lit(""))
        args = spaced_json(F.coalesce(F.get_json_object(h["s"], "$.input"), F.lit("{}")))
        result = F.coalesce(F.get_json_object(h["s"], "$.content"), F.lit(""))
        name = F.coalesce(F.try_variant_get(h["b"], "$.name", "string"), F.lit("?"))
        return (F.when(h["k"] == "STRING", F.try_variant_get(h["b"], "$", "string"))
                .when(h["k"] != "OBJECT", F.lit(None).cast("string"))
                .when((h["t"].isNull() | h["t"].isin(*TEXT_TYPES)) & h["x"].isNotNull(), h["x"])
                .when(h["t"] == "tool_use", F.concat(F.lit("[tool_use: "), name, F.lit("] "), F.left(args, F.lit(RESULT_CHARS))))
                .when(h["t"] == "tool_result", F.concat(F.lit("[tool_result] "), F.left(result, F.lit(RESULT_CHARS))))
                .when((h["t"] == "thinking") & think.isNotNull(), F.concat(F.lit("[thinking] "), think))
                .otherwise(h["x"]))
    return bind(head, text)


def _joined(texts: Column) -> Column:
    return F.array_join(F.filter(texts, lambda p: p.isNotNull() & (p != "")), "\n")


def _nested(items: Column, raw: Column) -> Column:
    """Text of blocks with tool results inside tool results, to any depth.

    The blocks are opened level by level, each result followed by its blocks, so the list stays in reading order; then it is
    read backwards, and a result takes the texts one level below it that are on top of the stack. Both are folds over one
    row's own list, so the expression is the same for every depth.
    """
    def entry(i: Column, depth: Column) -> Column:
        def of(x: Column) -> Column:
            more = _holds_blocks(x["b"])
            return bind(more, lambda more: F.struct(
                depth.cast("int").alias("depth"), more.alias("open"), F.lit(False).alias("holds"), F.when(more, x["b"]).alias("b"), F.when(more, x["s"]).alias("s"),
                F.when(~more, bind(_plain(x["b"], x["s"]), lambda t: F.when(depth > 0, F.left(t, F.lit(RESULT_CHARS))).otherwise(t))).alias("text")))
        return bind(i, of)

    def opened(e: Column) -> Column:
        none = F.lit(None)
        head = F.struct(e["depth"].alias("depth"), F.lit(False).alias("open"), F.lit(True).alias("holds"), none.cast("variant").alias("b"),
                        none.cast("string").alias("s"), none.cast("string").alias("text"))
        inner = F.struct(F.try_variant_get(e["b"], "$.content", "variant").alias("v"), F.get_json_object(e["s"], "$.content").alias("r"),
                         F.try_variant_get(e["b"], "$.content", "array<variant>").alias("l"))
        below = bind(inner, lambda c: F.transform(_items(c["v"], c["r"], c["l"]), lambda i: entry(i, e["depth"] + 1)))
        return F.concat(F.array(head), below)

    def level(state: Column, _: Column) -> Column:
        def grown(entries: Column) -> Column:
            return F.struct(entries.alias("entries"), F.exists(entries, lambda e: e["open"]).alias("more"))
        step = lambda e: F.when(e["open"], opened(e)).otherwise(F.array(e))
        return F.when(state["more"], bind(F.flatten(F.transform(state["entries"], step)), grown)).otherwise(state)

    def closed(stack: Column, e: Column) -> Column:
        def result(n: Column) -> Column:
            text = F.concat(F.lit("[tool_result] "), F.left(_joined(F.transform(F.slice(stack, F.lit(1), n), lambda x: x["text"])), F.lit(RESULT_CHARS)))
            return F.concat(F.array(F.struct(e["depth"].alias("depth"), text.alias("text"))), F.slice(stack, n + 1, F.size(stack)))
        other = F.array_position(F.transform(stack, lambda x: x["depth"] != e["depth"] + 1), F.lit(True)).cast("int")
        below = F.when(other == 0, F.size(stack)).otherwise(other - 1)
        return F.when(e["holds"], bind(below, result)).otherwise(
            F.concat(F.array(F.struct(e["depth"].alias("depth"), e["text"].alias("text"))), stack))

    first = F.transform(items, lambda i: entry(i, F.lit(0)))
    levels = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.length(raw) / SMALLEST_RESULT).cast("int")))
    entries = F.aggregate(levels, F.struct(first.alias("entries"), F.lit(True).alias("more")), level, lambda state: F.reverse(state["entries"]))
    none = F.array().cast("array<struct<depth:int,text:string>>")
    return F.aggregate(entries, none, closed, lambda stack: _joined(F.transform(stack, lambda x: x["text"])))


def flatten_content(v: Column, raw: Column, max_chars: int) -> Column:
    """``v`` is the content as VARIANT, ``raw`` the same as JSON text (plain text for a string).

    A plain string is never cut; a block list is cut at ``max_chars`` with a marker. Tool results may hold
    blocks, and so further tool results, to any depth.
    """
    def blocks(c: Column) -> Column:
        deep = lambda items: F.exists(items, lambda i: _holds_blocks(i["b"]))
        flat = lambda items: _joined(F.transform(items, lambda i: _plain(i["b"], i["s"])))
        return bind(_items(c["v"], c["r"], F.try_variant_get(c["v"], "$", "array<variant>")), lambda items: F.when(deep(items), _nested(items, c["r"])).otherwise(flat(items)))

    def text(c: Column) -> Column:
        return (F.when(c["v"].isNull() | F.is_variant_null(c["v"]), F.lit(""))
                .when(c["k"] == "STRING", F.try_variant_get(c["v"], "$", "string"))
                .when(c["k"].isin("ARRAY", "OBJECT"), _cut(blocks(c), max_chars))
                .otherwise(c["r"]))
    return bind(F.struct(v.alias("v"), raw.alias("r"), kind(v).alias("k")), text)
