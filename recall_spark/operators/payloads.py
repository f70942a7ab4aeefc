"""Payloads inside messages, media lines, and text and typed parts of nested JSON content.

All of it is column expressions and explodes; a message is worked on where it lies. Nulls: null content has no payload, no text and no
parts. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall_spark.sources.shared import kept

# Least sizes of payloads, and what they look like. A slash may be escaped as in JSON.
DATA_URI_CHARS, RUN_CHARS, LEAST_KINDS = 256, 4096, 8
_SLASH = r"(?:/|\\/|\\u002[fF])"
DATA_URI = rf"(?i)data:(?:[A-Za-z0-9.+-]|{_SLASH})*+(?:;[A-Za-z0-9_.+%-]+=(?:[-A-Za-z0-9_.+%]|{_SLASH})*+)*+;base64,(?:[A-Za-z0-9+=]|{_SLASH}){{{DATA_URI_CHARS},}}+(?=$|[^A-Za-z0-9+/=])"  # possessive: long payloads take no stack
BASE64_RUN = rf"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{{{RUN_CHARS},}}+(?![A-Za-z0-9+/=_-])"
REFERENCE = r"\[payload (file_[0-9a-f]{16})\]"
# Media and binary lines.
MEDIA_URL, MEDIA_OMITTED, MEDIA_PATH, BINARY_CHARS = r"(?i)data:[^;\s\"'`]+;base64,[A-Za-z0-9+/=\s]+", "[embedded media omitted]", r"^MEDIA:/.+$", 256
# Structured content.
TEXT_KEYS, NESTED_KEYS = ("text", "caption", "alt", "title", "summary"), ("content", "parts", "items", "message", "messages")
REASONING, ATTACHMENTS, MAX_DEPTH = ("reasoning", "thinking"), ("file", "image", "snapshot"), 4
TOOL_BLOCKS = ("tool_use", "toolUse", "tool-use", "toolCall", "tool_call", "functionCall", "function_call", "function_call_output", "tool_result", "toolResult", "tool_use_result")
CALL_IDS, TOOL_NAMES = ("toolCallId", "tool_call_id", "toolUseId", "tool_use_id", "call_id"), ("name", "toolName", "tool_name")


def file_id(payload: Column) -> Column:
    return F.concat(F.lit("file_"), F.substring(F.sha2(payload, 256), 1, 16))


def is_long_base64(run: Column) -> Column:
    """Whether a run may be base64: of a possible length and of some variety, so that ruled lines and repeats stay."""
    kinds = F.size(F.array_distinct(F.split(F.regexp_replace(run, "=+$", ""), "")))
    return (F.length(run) >= RUN_CHARS) & (F.length(run) % 4 != 1) & (kinds >= LEAST_KINDS)


def _taken(rows: DataFrame, found: Column) -> DataFrame:
    """rows with each of the found payloads replaced by its reference, and the payloads put to those in `payloads`."""
    replaced = F.aggregate("found", F.col("content"), lambda text, p: F.replace(text, p, F.concat(F.lit("[payload "), file_id(p), F.lit("]"))))
    # longest first: a payload may be the start of another
    ordered = F.reverse(F.array_sort(F.transform(F.array_distinct(found), lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))))
    return rows.withColumn("found", F.transform(ordered, lambda x: x["p"])).withColumns({"payloads": F.concat("payloads", "found"), "content": replaced}).drop("found")


def guard(m: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages with references in place of payloads, links (message_id, conversation_id, file_id), payloads (file_id, content, n_chars)) of (message_id, conversation_id, content, ...).

    Payloads are data URIs of at least DATA_URI_CHARS base64 characters and, in what is left, base64 runs of at least
    RUN_CHARS. Each payload is stored once, however many messages hold it. Messages without one pass unread.
    """
    none = F.array().cast("array<string>")
    find = lambda pattern: F.coalesce(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)), none)
    long = F.length("content") >= DATA_URI_CHARS
    rows = _taken(m.withColumn("payloads", none), F.when(long & F.contains(F.lower("content"), F.lit(";base64,")), find(DATA_URI)).otherwise(none))
    rows = _taken(rows, F.filter(F.when(F.length("content") >= RUN_CHARS, find(BASE64_RUN)).otherwise(none), is_long_base64))
    held = rows.select("message_id", "conversation_id", F.explode(F.array_distinct("payloads")).alias("content")).withColumn("file_id", file_id(F.col("content")))
    stored = held.groupBy("file_id").agg(F.first("content").alias("content")).withColumn("n_chars", F.length("content").cast("long"))
    return rows.drop("payloads"), held.select("message_id", "conversation_id", "file_id"), stored


def restore(m: DataFrame, stored: DataFrame) -> DataFrame:
    """(message_id, content): messages with their payloads back in place of references."""
    ids = m.select("message_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(REFERENCE), F.lit(1)))).alias("file_id"))
    own = ids.join(stored.select("file_id", F.col("content").alias("payload")), "file_id").groupBy("message_id").agg(F.collect_list(F.struct("file_id", "payload")).alias("own"))
    put = F.aggregate("own", F.col("content"), lambda text, p: F.replace(text, F.concat(F.lit("[payload "), p["file_id"], F.lit("]")), p["payload"]))
    return m.select("message_id", "content").join(own, "message_id", "left").select("message_id", F.when(F.col("own").isNull(), F.col("content")).otherwise(put).alias("content"))


def conversation_payloads(links: DataFrame, stored: DataFrame) -> DataFrame:
    """(conversation_id, position, file_id, n_chars, n_messages): the payloads of each conversation, by their first message; contents stay unread."""
    own = links.groupBy("conversation_id", "file_id").agg(F.min("message_id").alias("first"), F.count("*").alias("n_messages")).join(stored.select("file_id", "n_chars"), "file_id")
    place = F.row_number().over(Window.partitionBy("conversation_id").orderBy("first", "file_id"))
    return own.select("conversation_id", place.cast("long").alias("position"), "file_id", "n_chars", "n_messages")


def strip_media(text: Column | str) -> Column:
    """Text without embedded media: data URLs become a note, media paths, binary-looking and blank lines go."""
    text = F.col(text) if isinstance(text, str) else text
    blank = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    lines = F.transform(F.split(F.regexp_replace(text, MEDIA_URL, MEDIA_OMITTED), r"\r?\n"), lambda s: F.regexp_replace(s, r"\s+$", ""))

    def binary(s: Column) -> Column:
        compact = F.regexp_replace(s, r"\s+", "")
        return (F.length(compact) >= BINARY_CHARS) & (F.length(compact) % 4 == 0) & compact.rlike(r"^[A-Za-z0-9+/=]+$") & ~blank(s).rlike(r"[ .,:;!?()\[\]{}]")

    kept = F.filter(lines, lambda s: (s != "") & ~blank(s).rlike(MEDIA_PATH) & ~binary(s))
    return blank(F.array_join(kept, "\n"))


def _string(v: str, path: str) -> Column:
    """A string at a path of a variant; other kinds are null."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, path, "string"))


def _json(content: str) -> Column:
    """Content that is shaped like a JSON array or object, parsed; else null."""
    bare = F.regexp_replace(content, r"^\s+|\s+$", "")
    return F.when((F.startswith(bare, F.lit("[")) & F.endswith(bare, F.lit("]"))) | (F.startswith(bare, F.lit("{")) & F.endswith(bare, F.lit("}"))), F.try_parse_json(bare))


def meaningful_text(m: DataFrame) -> DataFrame:
    """(message_id, text): prose of messages (message_id, content), out of nested JSON down to MAX_DEPTH levels, else of the content itself.

    Reasoning is left out; of attachments only their own captions count. Fragments stand in the order of the document: an
    object's own text keys first, then what is nested. Each level is one explode over what the level above left.
    """
    parsed = m.select("message_id", "content", _json("content").alias("v"))
    level = parsed.where("v is not null").select("message_id", F.array().cast("array<int>").alias("at"), "v")
    found = []
    for _ in range(MAX_DEPTH):  # each level is written, else it would be worked out again for all that is below it
        level = kept(level).withColumn("kind", F.schema_of_variant("v"))
        found.append(level.where("kind = 'STRING'").select("message_id", "at", strip_media(F.try_variant_get("v", "$", "string")).alias("t")))
        objects = level.where(F.startswith("kind", F.lit("OBJECT"))).withColumn("type", F.lower(F.trim(F.coalesce(_string("v", "$.type"), F.lit(""))))).where(~F.col("type").isin(*REASONING))
        texts = F.array(*[F.struct(F.lit(i).alias("i"), strip_media(_string("v", f"$.{k}")).alias("t")) for i, k in enumerate(TEXT_KEYS)])
        found.append(objects.select("message_id", "at", F.explode(texts).alias("x")).select("message_id", F.concat("at", F.array("x.i")).alias("at"), F.col("x.t").alias("t")))
        nested = F.array(*[F.struct(F.lit(len(TEXT_KEYS) + i).alias("i"), F.try_variant_get("v", f"$.{k}", "variant").alias("v")) for i, k in enumerate(NESTED_KEYS)])
        inner = objects.where(~F.col("type").isin(*ATTACHMENTS)).select("message_id", "at", F.explode(nested).alias("x")).select("message_id", F.concat("at", F.array("x.i")).alias("at"), F.col("x.v").alias("v"))
        entries = level.where(F.startswith("kind", F.lit("ARRAY"))).select("message_id", "at", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("i", "v")).select("message_id", F.concat("at", F.array("i")).alias("at"), "v")
        level = inner.where("v is not null").union(entries)
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    texts = every.where("t <> ''").groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("x")).select("message_id", F.array_join(F.transform("x", lambda r: r["t"]), "\n").alias("found"))
    plain = F.when(F.col("v").isNull(), F.coalesce(strip_media("content"), F.lit(""))).otherwise(F.coalesce("found", F.lit("")))
    return parsed.join(texts, "message_id", "left").select("message_id", plain.alias("text"))


def message_parts(m: DataFrame) -> DataFrame:
    """(message_id, ordinal, part_type, text_content, tool_call_id, tool_name, tool_input, tool_output) of messages (message_id, content).

    A JSON array gives a part for each entry: tool blocks are tools, all else is text. Other JSON is one agent part, other text one text part.
    """
    parsed = m.select("message_id", "content", _json("content").alias("v")).withColumn("kind", F.schema_of_variant("v"))
    is_list = F.coalesce(F.startswith("kind", F.lit("ARRAY")), F.lit(False))
    null = F.lit(None).cast("string")
    whole = parsed.where(~is_list & F.col("content").isNotNull()).select("message_id", F.lit(0).alias("ordinal"), F.when(F.col("v").isNull(), "text").otherwise("agent").alias("part_type"), F.nullif(F.col("content"), F.lit("")).alias("text_content"), *[null.alias(c) for c in ("tool_call_id", "tool_name", "tool_input", "tool_output")])
    blocks = parsed.where(is_list).select("message_id", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("ordinal", "b"))
    first = lambda names: F.coalesce(*[F.nullif(_string("b", f"$.{n}"), F.lit("")) for n in names])
    some = lambda names: F.coalesce(*[F.to_json(F.try_variant_get("b", f"$.{n}", "variant")) for n in names])
    tool = F.coalesce(_string("b", "$.type").isin(*TOOL_BLOCKS), F.lit(False))
    text = F.coalesce(_string("b", "$.text"), _string("b", "$.content"))
    loose = F.when(F.schema_of_variant("b") == "STRING", F.try_variant_get("b", "$", "string")).when(~F.startswith(F.schema_of_variant("b"), F.lit("OBJECT")), F.to_json("b"))
    parts = blocks.select("message_id", "ordinal", F.when(tool, "tool").otherwise("text").alias("part_type"), F.coalesce(text, loose).alias("text_content"), F.coalesce(first(CALL_IDS), F.when(tool, first(["id"]))).alias("tool_call_id"), first(TOOL_NAMES).alias("tool_name"), some(["input", "arguments", "toolInput"]).alias("tool_input"), some(["output", "toolOutput"]).alias("tool_output"))
    return whole.union(parts)
