"""Registered transcript / evaluation / routing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakroom.functions.text import ALNUM_CLASS, ascii_lower
from cloakroom.operators import evaluate as EV
from cloakroom.operators.anonymize import anonymize
from cloakroom.operators.detect import floor_profile
from cloakroom.operators.rehydrate import rehydrate
from cloakroom.operators.routing import candidates
from cloakroom.operators.transcript import model_label_kind, parse_model_entities, rescue_tool_call
from cloakroom.operators.vault import session_resolver
from cloakroom.session import stored
from cloakroom.sources.tables import document_texts, spread, table


def tool_call_texts(spark: SparkSession, sf: str) -> DataFrame:
    o = spread(table(spark, sf, "orders"))
    k = F.col("o_orderkey").cast("string")
    fmt = F.col("o_orderkey") % 4
    text = (
        F.when(fmt == 0, F.concat(F.lit('[TOOL_CALLS]lookup_order{"order": '), k, F.lit(', "note": "a}b"}')))
        .when(fmt == 1, F.concat(F.lit('<tool_call>{"name": "lookup_order", "arguments": {"order": '), k, F.lit("}}</tool_call>")))
        .when(fmt == 2, F.concat(F.lit('Sure:\n```json\n{"name":"lookup_order","parameters":{"order":'), k, F.lit("}}\n```")))
        .otherwise(F.concat(F.lit("Order "), k, F.lit(" ships soon [1].")))
    )
    return o.select("o_orderkey", text.alias("content"))


def rescue_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Tool calls written as text: name and whole arguments."""
    t = tool_call_texts(spark, sf).where(F.col("content").rlike(r"[\[{]"))
    # a 0/1-element array: filtering on its position keeps the call from being worked out twice
    calls = t.select("o_orderkey", F.posexplode_outer(F.array(rescue_tool_call(F.col("content")))).alias("p", "c"))
    return calls.where(F.col("p").isNotNull() & F.col("c").isNotNull()).select("o_orderkey", F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"))


def model_replies(spark: SparkSession, sf: str) -> DataFrame:
    c = spread(table(spark, sf, "customer"))
    label = F.when(F.col("c_custkey") % 3 == 0, F.lit("person")).when(F.col("c_custkey") % 3 == 1, F.lit("Company")).otherwise(F.lit("project"))
    reply = F.when(F.col("c_custkey") % 5 == 4, F.lit("I did not find any sensitive entities.")).otherwise(
        F.concat(F.lit('Sure! ```json\n{"entities":[{"text":" '), F.col("c_name"), F.lit(' ","type":"'), label, F.lit('"},{"text":"  "}]}\n```'))
    )
    return c.select("c_custkey", reply.alias("reply"))


def llm_reply_terms(spark: SparkSession, sf: str) -> DataFrame:
    r = model_replies(spark, sf).select("c_custkey", F.explode(parse_model_entities(F.col("reply"))).alias("e"))
    return r.select("c_custkey", F.col("e.text").alias("term"), model_label_kind(F.col("e.label")).alias("kind"))


def eval_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is a scenario: masked, answered, restored and checked.

    The upstream is simulated by document id: every fifth answers with the first line
    alone, the others echo; every seventh call fails; every eleventh message goes out
    unmasked (a planted leak). Two checks in three ask for the first and last long word
    of the text, the third that the last one is absent.
    """
    texts = document_texts(spark, sf)
    a = anonymize(texts, floor_profile())
    sent = a.sanitized.select("session", "ord", "field_pos", F.col("text").alias("masked")).join(texts, ["session", "ord", "field_pos"])
    sent = sent.withColumn("sent", F.when(F.col("ord") % 11 == 0, F.col("text")).otherwise(F.col("masked")))
    answer = lambda c: F.when(F.col("ord") % 5 == 0, F.substring_index(c, "\n", 1)).otherwise(F.col(c))
    restored = rehydrate(sent.withColumn("reply", answer("sent")), session_resolver(a.vault), text_col="reply")
    sensitive = a.entities.groupBy("ord").agg(F.collect_set("v").alias("sensitive"))
    first, last = F.regexp_extract("text", "[A-Za-z]{4,}", 0), F.regexp_extract("text", "([A-Za-z]{4,})[^A-Za-z]*$", 1)
    absent = (F.col("ord") % 3 == 1) & (last != "")

    def passed(reply):
        return F.when(F.col("error").isNotNull(), F.lit(False)).when(absent, EV.check_not_contains(reply, F.array(last))).otherwise(EV.check_contains(reply, F.array(first, last)))

    j = restored.withColumn("error", F.when(F.col("ord") % 7 == 0, F.lit("timeout"))).join(sensitive, "ord", "left")
    return j.select(
        F.col("ord").alias("doc_id"),
        passed(answer("text")).alias("baseline_pass"),
        passed(F.col("reply")).alias("anon_pass"),
        F.coalesce(EV.leaked(F.col("sent"), F.col("sensitive")), F.lit(False)).alias("leaked"),
        F.col("error"),
    )


def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    return EV.report(eval_outcomes(spark, sf))


def eval_report_lines(spark: SparkSession, sf: str) -> DataFrame:
    named = eval_outcomes(spark, sf).withColumn("name", F.concat(F.lit("document "), F.lpad(F.col("doc_id").cast("string"), 9, "0")))
    return EV.report_lines(named)


def part_models(spark: SparkSession, sf: str) -> DataFrame:
    """A model catalogue made of all parts: one model per brand and size class, cheapest first; odd classes can call tools."""
    p = table(spark, sf, "part").withColumn("class", F.floor(F.col("p_size") / 10).cast("int"))
    return p.groupBy("p_brand", "class").agg(F.min("p_retailprice").alias("priority"), F.min("p_partkey").alias("ins")).select(
        F.concat(F.lower(F.regexp_replace("p_brand", "#", "-")), F.lit("/class-"), F.col("class").cast("string")).alias("model_id"),
        "priority", (F.col("class") % 2 == 1).alias("tools"), "ins",
    )


def route_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations with a system turn are treated as tool-using requests."""
    c = table(spark, sf, "conversations")
    req = c.groupBy(F.col("conv_id").alias("request_id")).agg(F.max(F.col("role") == "system").alias("needs_tools"))
    return candidates(req, part_models(spark, sf)).select(F.col("request_id").alias("conv_id"), "model_id", "pref")


def block_dialect_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations rendered as block-dialect request bodies.

    System turns form ``system``; every 4th assistant turn (turn % 4 = 1) carries
    a text block plus a tool_use block, every 4th user turn (turn % 4 = 2) a
    tool_result for the previous turn's call plus a text block; other turns
    are plain strings.
    """
    c = table(spark, sf, "conversations")
    tid = F.concat(F.lit("toolu_"), F.col("conv_id").cast("string"), F.lit("_"))
    def js(*fields):
        return F.to_json(F.struct(*fields))

    text_block = js(F.lit("text").alias("type"), F.col("text").alias("text"))
    blocks_a = F.concat(F.lit("["), text_block, F.lit(","), js(
        F.lit("tool_use").alias("type"), F.concat(tid, F.col("turn").cast("string")).alias("id"),
        F.lit("lookup").alias("name"), F.struct(F.col("turn").alias("turn")).alias("input"),
    ), F.lit("]"))
    blocks_u = F.concat(F.lit("["), js(
        F.lit("tool_result").alias("type"), F.concat(tid, (F.col("turn") - 1).cast("string")).alias("tool_use_id"),
        F.array(F.struct(F.lit("text").alias("type"), F.lit("ok").alias("text"))).alias("content"),
    ), F.lit(","), text_block, F.lit("]"))
    content = (
        F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), F.parse_json(blocks_a))
        .when((F.col("role") == "user") & (F.col("turn") % 4 == 2), F.parse_json(blocks_u))
        .otherwise(F.col("text").cast("variant"))
    )
    msg = F.to_json(F.struct(F.col("role").alias("role"), content.alias("content")))
    msgs = c.where(F.col("role") != "system").groupBy("conv_id").agg(
        F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", msg.alias("m")))), lambda x: x["m"]), ","), F.lit("]")).alias("messages")
    )
    system = c.where(F.col("role") == "system").groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("system")
    )
    j = msgs.join(system, "conv_id", "full_outer").select(
        "conv_id",
        F.concat(
            F.lit('{"model":"m","system":'), F.coalesce(F.to_json(F.col("system").cast("variant")), F.lit('""')),
            F.lit(',"messages":'), F.coalesce(F.col("messages"), F.lit("[]")), F.lit("}"),
        ).alias("body"),
    )
    return j


def normalize_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    from cloakroom.operators.dialect import to_canonical_messages

    b = block_dialect_requests(spark, sf)
    m = b.select("conv_id", F.posexplode(to_canonical_messages(F.col("body"))).alias("ord", "m"))
    return m.select(
        "conv_id",
        F.col("ord").cast("bigint").alias("ord"),
        F.col("m.role").alias("role"),
        F.col("m.content").alias("content"),
        F.col("m.tool_call_id").alias("tool_call_id"),
        F.get_json_object(F.try_element_at(F.col("m.tool_calls"), F.lit(1))["function"]["arguments"], "$.turn").alias("call_turn"),
    )


def chat_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as canonical chat requests with tool calls and a tool schema.

    Turn 0 mentions the user's address; every assistant turn with turn % 4 = 1
    carries a send_mail tool call whose JSON arguments hold the address; the
    tool schema's descriptions mention an operations address and the user's.
    """
    c = table(spark, sf, "conversations")
    user_mail = F.concat(F.lit("u"), F.col("conv_id").cast("string"), F.lit("@mail.example.com"))
    ops_mail = F.concat(F.lit("ops"), (F.col("conv_id") % 7).cast("string"), F.lit("@corp.example.org"))
    content = F.when(F.col("turn") == 0, F.concat(F.col("text"), F.lit(" mail "), user_mail)).otherwise(F.col("text"))
    args = F.concat(F.lit('{"to":"'), user_mail, F.lit('","n":'), F.col("turn").cast("string"), F.lit("}"))
    call = F.array(F.struct(
        F.concat(F.lit("c"), F.col("turn").cast("string")).alias("id"), F.lit("function").alias("type"),
        F.struct(F.lit("send_mail").alias("name"), args.alias("arguments")).alias("function"),
    ))
    calls = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), call)
    msg = F.to_json(F.struct(F.col("role").alias("role"), content.alias("content"), calls.alias("tool_calls")))
    tools = F.to_json(F.array(F.struct(
        F.lit("function").alias("type"),
        F.struct(
            F.lit("send_mail").alias("name"),
            F.concat(F.lit("Send mail via "), ops_mail).alias("description"),
            F.struct(
                F.lit("object").alias("type"),
                F.struct(F.struct(F.lit("string").alias("type"), F.concat(F.lit("recipient, e.g. "), user_mail).alias("description")).alias("to")).alias("properties"),
            ).alias("parameters"),
        ).alias("function"),
    )))
    per_turn = c.select("conv_id", "turn", msg.alias("m"), tools.alias("t"))
    return per_turn.groupBy("conv_id").agg(
        F.concat(
            F.lit('{"model":"m","messages":['),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda x: x["m"]), ","),
            F.lit('],"tools":'), F.first("t"), F.lit("}"),
        ).alias("body")
    ).withColumnRenamed("conv_id", "request_id")


def _anonymized_requests(spark: SparkSession, sf: str):
    from cloakroom.operators.chat_fields import request_fields

    req = chat_requests(spark, sf)
    fields = request_fields(req)
    return req, anonymize(fields, floor_profile())


def chat_fields_anonymize(spark: SparkSession, sf: str) -> DataFrame:
    _, a = _anonymized_requests(spark, sf)
    return a.sanitized.select("session", "path", "text")


def chat_requests_sanitized(spark: SparkSession, sf: str) -> DataFrame:
    """Sanitized request JSON: the fields written back into each request body."""
    from cloakroom.operators.chat_fields import set_fields

    req, a = _anonymized_requests(spark, sf)
    per = a.sanitized.groupBy("session").agg(F.collect_list(F.struct("steps", "text")).alias("fields"))
    j = req.withColumn("session", F.col("request_id").cast("string")).join(per, "session", "left")
    return j.select(F.col("request_id").alias("conv_id"), set_fields(F.col("body"), F.col("fields")).alias("body"))


def discovered_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms a detector model reported per conversation, parsed from its replies.

    The reply about a turn names every word of it, as persons (even conv_id) or
    companies (odd conv_id); what is named in one turn is a term in all of its conversation.
    """
    c = table(spark, sf, "conversations")
    label = F.when(F.col("conv_id") % 2 == 0, F.lit("person")).otherwise(F.lit("Company"))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(f"{ALNUM_CLASS}+"), 0))
    named = F.transform(words, lambda w: F.struct(w.alias("text"), label.alias("type")))
    reply = F.concat(F.lit("Here you go:\n"), F.to_json(F.struct(named.alias("entities"))))
    r = c.select(F.col("conv_id").cast("string").alias("session"), F.explode(parse_model_entities(reply)).alias("e"))
    terms = r.select("session", ascii_lower(F.col("e.text")).alias("term"), model_label_kind(F.col("e.label")).alias("label")).distinct()
    return terms.withColumn("ins", F.lit(0))


def anonymize_with_discovered(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations anonymized by the floor plus the model-discovered terms (priority 2)."""
    from cloakroom.operators.detect import Email, Entropy, Profile, RegexSet
    from cloakroom.operators.gazetteer_join import JoinedGazetteer, attach_terms
    from cloakroom.sources.tables import conversation_texts

    t = conversation_texts(spark, sf)
    prof = Profile([Email(), RegexSet(), Entropy(), JoinedGazetteer(priority=2)])
    a = anonymize(t, prof, attached=attach_terms(t, discovered_terms(spark, sf), by_session=True))
    return a.sanitized.select(F.col("session").cast("bigint").alias("conv_id"), F.col("ord").alias("turn"), "text")


def eval_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a prompt's request, and the text read from a reply to it.

    A fifth of the replies each: the text, null, no choice, a number, no JSON.
    """
    d = spread(table(spark, sf, "documents"))
    said = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")))
    others = ['{"choices":[{"message":{"content":null}}]}', '{"choices":[]}', '{"choices":[{"message":{"content":7}}]}', "<html>busy</html>"]
    reply = F.element_at(F.array(said, *map(F.lit, others)), (F.col("doc_id") % 5 + 1).cast("int"))
    replies = d.select("doc_id", "text", reply.alias("reply"))
    return replies.select("doc_id", EV.eval_request(F.col("text")).alias("request"), EV.reply_content(F.col("reply")).alias("content"))


def has_tools(body):
    return F.try_variant_get(F.try_parse_json(body), "$.tools", "variant").isNotNull()


def rescue_replies(replies: DataFrame) -> DataFrame:
    """(session, needs_tools, reply JSON): calls written as text become tool calls, choice by choice.

    Only where the request had tools, and only choices without calls of their own whose
    content is text; everything else in the reply stays as it is.
    """
    from cloakroom.operators.chat_fields import _step, set_values

    v = F.try_parse_json(F.col("reply"))
    choices = F.coalesce(F.try_variant_get(v, "$.choices", "array<variant>"), F.array().cast("array<variant>"))
    c = replies.where("needs_tools").select("session", F.posexplode(choices).alias("i", "c"))
    calls = F.try_variant_get(F.col("c"), "$.message.tool_calls", "array<variant>")
    content = F.try_variant_get(F.col("c"), "$.message.content", "variant")
    open_ = c.where((F.coalesce(F.size(calls), F.lit(0)) <= 0) & F.coalesce(F.schema_of_variant(content) == "STRING", F.lit(False)))
    found = open_.select("session", "i", F.posexplode_outer(F.array(rescue_tool_call(F.try_variant_get(content, "$", "string")))).alias("p", "call"))
    found = found.where(F.col("p").isNotNull() & F.col("call").isNotNull())
    at = lambda *names: F.array(_step(F.lit("choices")), _step(i=F.col("i")), *[_step(F.lit(n)) for n in names]).alias("steps")
    made = F.to_json(F.array(F.struct(
        F.concat(F.lit("call_rescue_"), F.col("i").cast("string")).alias("id"), F.lit("function").alias("type"),
        F.struct(F.col("call.name").alias("name"), F.col("call.arguments").alias("arguments")).alias("function"),
    )))
    edits = F.array(
        F.struct(at("message", "tool_calls"), made.alias("text")),
        F.struct(at("message", "content"), F.lit("null").alias("text")),
        F.struct(at("finish_reason"), F.lit('"tool_calls"').alias("text")),
    )
    per = found.select("session", F.explode(edits).alias("e")).groupBy("session").agg(F.collect_list("e").alias("edits"))
    j = replies.join(per, "session", "left")
    return j.withColumn("reply", F.when(F.col("edits").isNull(), F.col("reply")).otherwise(set_values("reply", "edits"))).drop("edits")


def restore_replies(replies: DataFrame, resolver: DataFrame) -> DataFrame:
    """Buffered replies (session, needs_tools, reply JSON): rescue text tool calls
    when the request had tools, then restore placeholders in every string value."""
    from cloakroom.operators.rehydrate import rehydrate_json

    fixed = rescue_replies(replies)
    docs = fixed.select("session", F.lit(0).cast("bigint").alias("ord"), F.lit(0).alias("field_pos"), F.col("reply").alias("text"))
    # the tokens are looked up in one pass over the replies and put in by another
    return rehydrate_json(stored(docs), resolver)


def reply_restore_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Sanitized request bodies echoed back as replies restore to the original bodies."""
    from cloakroom.operators.vault import session_resolver

    req, a = _anonymized_requests(spark, sf)
    from cloakroom.operators.chat_fields import set_fields

    per = a.sanitized.groupBy("session").agg(F.collect_list(F.struct("steps", "text")).alias("fields"))
    j = req.withColumn("session", F.col("request_id").cast("string")).join(per, "session", "left")
    echoed = j.select("session", F.lit(False).alias("needs_tools"), set_fields(F.col("body"), F.col("fields")).alias("reply"), "body")
    back = restore_replies(echoed, session_resolver(a.vault))
    cmp = back.join(echoed.select("session", "body"), "session")
    return cmp.select(F.col("session").cast("bigint").alias("conv_id"), (F.col("text") == F.col("body")).alias("restored"))


def guard_chat_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Sanitized requests with leaks planted where nothing is rewritten, guarded as a whole.

    By conversation: an address as the ``user``, a card in ``functions``, a customer's
    name as a message's ``name``, or a body cut off; the others are clean.
    """
    from cloakroom.operators.detect import Email, Profile, RegexSet
    from cloakroom.operators.gazetteer_join import JoinedGazetteer
    from cloakroom.operators.guard import guard_requests

    body, k = F.col("body"), F.col("request_id")
    first = lambda extra: F.concat(F.lit("{"), extra, F.lit(","), F.substring(body, 2, 1 << 30))
    name = F.concat(F.lit("Customer#"), F.lpad((k % 1000).cast("string"), 9, "0"))
    planted = (
        F.when(k % 7 == 1, first(F.concat(F.lit('"user":"u'), k.cast("string"), F.lit('@leak.example.net"'))))
        .when(k % 7 == 2, first(F.lit('"functions":[{"name":"pay","description":"use 4111 1111 1111 1111"}]')))
        .when(k % 7 == 3, F.concat(F.substring(body, 1, F.length(body) - 1), F.lit(',"name":"'), name, F.lit('"}')))
        .when(k % 7 == 4, F.substring(body, 1, F.length(body) - 1))
        .otherwise(body)
    )
    sent = chat_requests_sanitized(spark, sf).withColumnRenamed("conv_id", "request_id").withColumn("body", planted)
    vocab = table(spark, sf, "customer").select(F.col("c_name").alias("term"), F.lit("person").alias("label"), F.col("c_custkey").cast("int").alias("ins"))
    g = guard_requests(sent, Profile([JoinedGazetteer(), Email(), RegexSet()]), vocab)
    verdict = lambda df, word: df.select(F.col("request_id").alias("conv_id"), F.lit(word).alias("verdict"))
    return verdict(g.blocked, "blocked").unionByName(verdict(g.released, "released"))


def deep_tool_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions at the bottom of tool schemas some 80 levels deep, one request per supplier, anonymized in place.

    Member names hold dots and brackets; one request in ten is cut off and stays as it is.
    """
    from cloakroom.operators.chat_fields import request_fields, set_fields
    from cloakroom.operators.detect import Email, Profile

    s = table(spark, sf, "supplier")
    key = F.col("s_suppkey")
    mail = F.concat(F.lit('{"description":"ask s'), key.cast("string"), F.lit('@supply.example.org"}'))
    body = F.concat(F.lit('{"tools":[{"a.b[0]":'), F.repeat(F.lit('{"p":['), 40), mail, F.repeat(F.lit("]}"), 40), F.lit("}]}"))
    req = s.select(key.alias("request_id"), F.when(key % 10 == 9, F.substring(body, 1, F.length(body) - 3)).otherwise(body).alias("body"))
    a = anonymize(request_fields(req), Profile([Email()]))
    per = a.sanitized.groupBy("session").agg(F.collect_list(F.struct("steps", "text")).alias("fields"))
    j = req.withColumn("session", F.col("request_id").cast("string")).join(per, "session", "left")
    return j.select(F.col("request_id").alias("s_suppkey"), set_fields(F.col("body"), F.col("fields")).alias("body"))


def rescue_multi_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Replies with two choices and fields of their own, rescued and restored; one line per choice."""
    calls = tool_call_texts(spark, sf).withColumn("session", F.col("o_orderkey").cast("string"))
    text = lambda c: F.to_json(F.array(c))
    inner = lambda c: F.substring(text(c), 2, F.length(text(c)) - 2)
    k = F.col("o_orderkey")
    other = F.when(k % 3 == 0, F.lit('{"name":null,"arguments":{"order":1}}')).when(k % 3 == 1, F.lit('{"name":"mail","arguments":{"z":1,"to":"__EMAIL_1__","a":null}}')).otherwise(F.lit("plain __EMAIL_1__"))
    reply = F.concat(
        F.lit('{"id":"r'), k.cast("string"), F.lit('","choices":[{"index":0,"message":{"role":"assistant","content":'), inner(F.col("content")),
        F.lit('}},{"index":1,"message":{"role":"assistant","content":'), inner(other), F.lit('},"logprobs":null}],"usage":{"__EMAIL_1__":3}}'),
    )
    replies = calls.select("session", (k % 2 == 0).alias("needs_tools"), reply.alias("reply"))
    mails = calls.select("session", F.lit("__EMAIL_1__").alias("placeholder"), F.concat(F.lit("o"), k.cast("string"), F.lit("@shop.example")).alias("original"))
    v = F.try_parse_json(F.col("text"))
    back = restore_replies(replies, mails).select("session", v.alias("v"))
    rows = back.select("session", "v", F.posexplode(F.try_variant_get("v", "$.choices", "array<variant>")).alias("i", "c"))
    at = lambda p: F.try_variant_get(F.col("c"), p, "string")
    return rows.select(
        F.col("session").cast("bigint").alias("o_orderkey"), F.col("i").cast("bigint").alias("choice"),
        at("$.message.content").alias("content"), at("$.message.tool_calls[0].function.name").alias("name"),
        at("$.message.tool_calls[0].function.arguments").alias("arguments"), at("$.finish_reason").alias("finish_reason"),
        F.try_variant_get("v", "$.usage.__EMAIL_1__", "int").cast("bigint").alias("usage"), F.try_variant_get("v", "$.id", "string").alias("reply_id"),
    )
