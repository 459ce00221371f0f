"""Block-style chat dialect <-> canonical chat dialect, as Spark SQL over VARIANT.

Requests (block dialect) -> canonical request:
  * ``system`` (string or text blocks) becomes a leading system message;
  * assistant text blocks are joined, ``tool_use`` blocks become ``tool_calls``
    (arguments = the serialised input);
  * user ``tool_result`` blocks become ``role: tool`` messages placed before the
    user's own text (which is then dropped when empty);
  * ``tools[].input_schema`` becomes ``function.parameters``; ``max_tokens``,
    ``temperature``, ``top_p`` pass through; ``stop_sequences`` becomes ``stop``.
Responses (canonical) -> block dialect: first choice only, a text block when
the content is non-empty, ``tool_use`` blocks (unparsable arguments -> ``{}``),
mapped stop reason, usage defaulting to 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = "array<struct<type: string, text: string, id: string, name: string, input: variant, tool_use_id: string, content: variant>>"
MSG_OUT = "struct<role: string, content: string, tool_calls: array<struct<id: string, type: string, function: struct<name: string, arguments: string>>>, tool_call_id: string>"


def join_texts(texts: Column) -> Column:
    """Text blocks joined by newlines; a separator only once the buffer is non-empty."""
    return F.aggregate(
        F.filter(texts, lambda t: t.isNotNull()),
        F.lit(""),
        lambda buf, t: F.when(buf == "", t).otherwise(F.concat(buf, F.lit("\n"), t)),
    )


def _blocks(v: Column) -> Column:
    return F.try_variant_get(v, "$", BLOCK)


def flat_text(v: Column) -> Column:
    """A content value (string or block array) as plain text; anything else ''."""
    s = F.try_variant_get(v, "$", "string")
    arr = _blocks(v)
    return F.coalesce(
        F.when(F.schema_of_variant(v) == "STRING", s),
        F.when(arr.isNotNull(), join_texts(F.transform(F.filter(arr, lambda b: b["type"] == "text"), lambda b: b["text"]))),
        F.lit(""),
    )


def _result_text(v: Column) -> Column:
    """tool_result content: string, text of blocks, other JSON serialised, missing ''."""
    return F.when(v.isNull(), F.lit("")).when(
        F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")
    ).when(F.schema_of_variant(v).startswith("ARRAY"), flat_text(v)).otherwise(F.to_json(v))


def _msg(role, content, tool_calls=None, tool_call_id=None) -> Column:
    calls_type = "array<struct<id: string, type: string, function: struct<name: string, arguments: string>>>"
    return F.struct(
        F.lit(role).alias("role") if isinstance(role, str) else role.alias("role"),
        content.alias("content"),
        (tool_calls if tool_calls is not None else F.lit(None).cast(calls_type)).alias("tool_calls"),
        (tool_call_id if tool_call_id is not None else F.lit(None).cast("string")).alias("tool_call_id"),
    ).cast(MSG_OUT)


def _convert_message(m: Column) -> Column:
    role = F.coalesce(F.try_variant_get(m, "$.role", "string"), F.lit("user"))
    content = F.try_variant_get(m, "$.content", "variant")
    blocks = F.coalesce(_blocks(content), F.array().cast(BLOCK))
    text = flat_text(content)
    calls = F.transform(
        F.filter(blocks, lambda b: b["type"] == "tool_use"),
        lambda b: F.struct(
            b["id"].alias("id"),
            F.lit("function").alias("type"),
            F.struct(
                b["name"].alias("name"),
                F.coalesce(F.to_json(b["input"]), F.lit("{}")).alias("arguments"),
            ).alias("function"),
        ),
    )
    assistant = F.array(
        _msg(
            "assistant",
            F.when(text == "", F.lit(None).cast("string")).otherwise(text),
            F.when(F.size(calls) > 0, calls),
        )
    )
    results = F.transform(
        F.filter(blocks, lambda b: b["type"] == "tool_result"),
        lambda b: _msg("tool", _result_text(b["content"]), None, b["tool_use_id"]),
    )
    user = F.when(F.size(results) == 0, F.array(_msg("user", text))).otherwise(
        F.concat(results, F.when(text != "", F.array(_msg("user", text))).otherwise(F.array().cast(f"array<{MSG_OUT}>")))
    )
    return F.when(role == "assistant", assistant).otherwise(user)


def to_canonical_messages(body: Column) -> Column:
    """array<message>: the canonical message list of a block-dialect request body."""
    v = F.try_parse_json(body)
    sys_v = F.try_variant_get(v, "$.system", "variant")
    sys_text = F.when(sys_v.isNull(), F.lit("")).otherwise(flat_text(sys_v))
    system = F.when(sys_text != "", F.array(_msg("system", sys_text))).otherwise(F.array().cast(f"array<{MSG_OUT}>"))
    msgs = F.coalesce(F.try_variant_get(v, "$.messages", "array<variant>"), F.array().cast("array<variant>"))
    return F.concat(system, F.flatten(F.transform(msgs, _convert_message)))


def to_canonical_request(body: Column) -> Column:
    """Canonical request JSON (model, messages, tools, sampling params, stop)."""
    v = F.try_parse_json(body)
    tools = F.transform(
        F.try_variant_get(v, "$.tools", "array<variant>"),
        lambda t: F.struct(
            F.lit("function").alias("type"),
            F.struct(
                F.try_variant_get(t, "$.name", "variant").alias("name"),
                F.try_variant_get(t, "$.description", "variant").alias("description"),
                F.coalesce(F.try_variant_get(t, "$.input_schema", "variant"), F.parse_json(F.lit('{"type":"object"}'))).alias("parameters"),
            ).alias("function"),
        ),
    )
    req = F.struct(
        F.coalesce(F.try_variant_get(v, "$.model", "string"), F.lit("")).alias("model"),
        to_canonical_messages(body).alias("messages"),
        tools.alias("tools"),
        F.try_variant_get(v, "$.max_tokens", "variant").alias("max_tokens"),
        F.try_variant_get(v, "$.temperature", "variant").alias("temperature"),
        F.try_variant_get(v, "$.top_p", "variant").alias("top_p"),
        F.try_variant_get(v, "$.stop_sequences", "variant").alias("stop"),
    )
    return F.to_json(req)


def to_block_response(resp: Column) -> Column:
    """Block-dialect response JSON for a canonical response JSON (keys in sorted order)."""
    v = F.try_parse_json(resp)
    text = F.try_variant_get(v, "$.choices[0].message.content", "string")
    calls = F.coalesce(F.try_variant_get(v, "$.choices[0].message.tool_calls", "array<variant>"), F.array().cast("array<variant>"))
    # Each block is its own JSON value, so text and tool_use blocks keep their own keys.
    text_block = F.when(
        F.coalesce(F.length(text), F.lit(0)) > 0,
        F.array(F.parse_json(F.to_json(F.struct(text.alias("text"), F.lit("text").alias("type"))))),
    ).otherwise(F.array().cast("array<variant>"))
    use_blocks = F.transform(
        calls,
        lambda tc: F.parse_json(
            F.to_json(
                F.struct(
                    F.coalesce(F.try_variant_get(tc, "$.id", "variant"), F.parse_json(F.lit('"toolu_0"'))).alias("id"),
                    F.coalesce(
                        F.try_parse_json(F.try_variant_get(tc, "$.function.arguments", "string")), F.parse_json(F.lit("{}"))
                    ).alias("input"),
                    F.coalesce(F.try_variant_get(tc, "$.function.name", "variant"), F.parse_json(F.lit("null"))).alias("name"),
                    F.lit("tool_use").alias("type"),
                ),
                {"ignoreNullFields": "false"},
            )
        ),
    )
    finish = F.try_variant_get(v, "$.choices[0].finish_reason", "string")
    stop = F.when(finish == "tool_calls", F.lit("tool_use")).when(finish == "length", F.lit("max_tokens")).otherwise(F.lit("end_turn"))
    out = F.struct(
        F.concat(text_block, use_blocks).alias("content"),
        F.coalesce(F.try_variant_get(v, "$.id", "variant"), F.parse_json(F.lit('"msg_proxy"'))).alias("id"),
        F.coalesce(F.try_variant_get(v, "$.model", "variant"), F.parse_json(F.lit("null"))).alias("model"),
        F.lit("assistant").alias("role"),
        stop.alias("stop_reason"),
        F.lit(None).cast("string").alias("stop_sequence"),
        F.lit("message").alias("type"),
        F.struct(
            F.coalesce(F.try_variant_get(v, "$.usage.prompt_tokens", "variant"), F.parse_json(F.lit("0"))).alias("input_tokens"),
            F.coalesce(F.try_variant_get(v, "$.usage.completion_tokens", "variant"), F.parse_json(F.lit("0"))).alias("output_tokens"),
        ).alias("usage"),
    )
    return F.to_json(out, {"ignoreNullFields": "false"})
