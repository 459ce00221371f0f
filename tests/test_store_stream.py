import json

import pandas as pd
from pyspark.sql import functions as F

from cloakroom.operators.chat_fields import request_fields, set_fields
from cloakroom.operators.anonymize import anonymize
from cloakroom.operators.detect import Email, Gazetteer, Profile
from cloakroom.operators.dialect import to_block_response, to_canonical_messages
from cloakroom.sources.store import MEMORY_SCHEMA, append, insert_memories, migrate, open_table
from cloakroom.streaming.rehydrate_stream import _fragments_fn, _frames_fn, rehydrate_frames


def test_versioned_table_and_idempotent_insert(spark, tmp_path):
    base = str(tmp_path / "memories")
    cur = open_table(spark, base, MEMORY_SCHEMA)
    assert cur.count() == 0
    new = spark.createDataFrame([("  likes tea ", None, "Local", 5), ("", "x", None, 6)], "content string, kind string, egress_policy string, created_ms long")
    append(insert_memories(cur, new), base)
    append(insert_memories(open_table(spark, base, MEMORY_SCHEMA), new), base)
    rows = open_table(spark, base, MEMORY_SCHEMA).collect()
    assert len(rows) == 1 and rows[0].content == "likes tea" and rows[0].kind == "fact" and rows[0].egress_policy == "local_only"


def test_additive_migration(spark):
    old = spark.createDataFrame([("a", "c", "fact", "anonymized", 1)], "id string, content string, kind string, egress_policy string, created_ms long")
    m = migrate(old, MEMORY_SCHEMA).first()
    assert (m.recall_count, m.accessed_ms, m.promoted) == (0, 0, False)


def test_request_fields_order_and_write_back(spark):
    body = json.dumps({
        "messages": [
            {"role": "user", "content": [{"type": "text", "text": "hi a@b.com"}, {"type": "image_url", "image_url": {"url": "x"}}]},
            {"role": "assistant", "content": None, "tool_calls": [{"function": {"name": "send", "arguments": "{\"to\":\"c@d.com\"}"}}],
             "reasoning": "about Falcon"},
        ],
        "tools": [{"type": "function", "function": {"name": "send", "description": "mail c@d.com",
                                                   "parameters": {"properties": {"z": {"description": "e@f.com"}, "a": {"description": "Falcon"}}}}}],
    })
    req = spark.createDataFrame([("r1", body)], "request_id string, body string")
    f = request_fields(req)
    paths = [r.path for r in f.orderBy("ord").collect()]
    assert paths == [
        "messages[0].content[0].text",
        "messages[1].tool_calls[0].function.arguments",
        "messages[1].reasoning",
        "tools[0].function.description",
        "tools[0].function.parameters.properties.a.description",
        "tools[0].function.parameters.properties.z.description",
    ]
    a = anonymize(f, Profile([Gazetteer([("Falcon", "project")]), Email()]))
    per = a.sanitized.groupBy("session").agg(F.collect_list(F.struct("steps", "text")).alias("fields"))
    out = json.loads(req.join(per, req.request_id == per.session).select(set_fields("body", "fields").alias("b")).first().b)
    assert out["messages"][0]["content"][0]["text"] == "hi __EMAIL_1__"
    assert out["messages"][0]["content"][1]["image_url"]["url"] == "x"
    assert out["messages"][1]["tool_calls"][0]["function"] == {"name": "send", "arguments": "{\"to\":\"__EMAIL_2__\"}"}
    assert out["messages"][1]["reasoning"] == "about __PROJECT_1__"
    props = out["tools"][0]["function"]["parameters"]["properties"]
    assert out["tools"][0]["function"]["description"] == "mail __EMAIL_2__"
    assert props["a"]["description"] == "__PROJECT_1__" and props["z"]["description"] == "__EMAIL_3__"


def test_dialect_round_trip(spark):
    body = json.dumps({"system": "be brief", "messages": [
        {"role": "assistant", "content": [{"type": "tool_use", "id": "t1", "name": "f", "input": {"b": 1}}]},
        {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "ok"}, {"type": "text", "text": "next"}]},
    ]})
    ms = spark.createDataFrame([(body,)], "b string").select(F.posexplode(to_canonical_messages(F.col("b")))).collect()
    got = [(r.col.role, r.col.content, r.col.tool_call_id) for r in ms]
    assert got == [("system", "be brief", None), ("assistant", None, None), ("tool", "ok", "t1"), ("user", "next", None)]
    assert ms[1].col.tool_calls[0].function.arguments == '{"b":1}'
    resp = json.dumps({"choices": [{"message": {"content": "", "tool_calls": [{"function": {"name": "g", "arguments": "oops"}}]}, "finish_reason": "length"}]})
    out = json.loads(spark.createDataFrame([(resp,)], "r string").select(to_block_response(F.col("r")).alias("x")).first().x)
    assert out["stop_reason"] == "max_tokens" and out["content"] == [{"id": "toolu_0", "input": {}, "name": "g", "type": "tool_use"}]
    assert out["usage"] == {"input_tokens": 0, "output_tokens": 0} and out["stop_sequence"] is None


def test_frames_are_restored_and_passed_on(spark):
    chunk = lambda *choices: json.dumps({"id": "x1", "choices": list(choices)}, separators=(",", ":"))
    text = lambda i, t: {"index": i, "delta": {"content": t}}
    frames = [
        ("s1", "one", 0, chunk(text(0, "for __ORG"), text(1, "plain _"))),
        ("s1", "one", 1, "event: ping"),
        ("s1", "one", 2, chunk(text(1, "_ORG_7__."), {"index": 0, "delta": {"content": "_7__ only", "tool_calls": [{"index": 2, "function": {"arguments": '{"of":"__ORG_'}}]}})),
        ("s1", "one", 3, chunk({"index": 0, "delta": {"tool_calls": [{"index": 2, "function": {"arguments": '7__"}__'}}]}})),
        ("s1", "one", 4, " [DONE]"),
        ("s2", "two", 0, chunk(text(0, "no such __ORG_7__ here"))),
        ("s2", "two", 1, "[1, 2]"),
    ]
    df = spark.createDataFrame(frames, "stream_id string, session string, seq long, frame string")
    res = spark.createDataFrame([("one", "__ORG_7__", "Quill & Son")], "session string, placeholder string, original string")
    out = sorted(tuple(r) for r in rehydrate_frames(df, res).collect())
    one = [f for s, _, _, f in out if s == "s1"]
    assert one[1] == "event: ping" and one[-1] == " [DONE]" and [f for s, _, _, f in out if s == "s2"][1] == "[1, 2]"
    got = {}
    for f in one:
        for c in json.loads(f)["choices"] if f.startswith("{") else []:
            d = c["delta"]
            got[c["index"]] = got.get(c["index"], "") + d.get("content", "")
            for t in d.get("tool_calls", []):
                got["tool", t["index"]] = got.get(("tool", t["index"]), "") + t["function"]["arguments"]
    assert got == {0: "for Quill & Son only", 1: "plain Quill & Son.", ("tool", 2): '{"of":"Quill & Son"}__'}
    assert json.loads(one[0])["id"] == "x1" and json.loads(one[0])["choices"][0]["delta"]["content"] == "for "
    two = [json.loads(f)["choices"][0]["delta"]["content"] for s, _, _, f in out if s == "s2" and f.startswith("{")]
    assert two == ["no such __ORG_7", "__ here"]


class _Kept:
    """A keyed state between calls."""

    def __init__(self):
        self.value, self.hasTimedOut, self.timer = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timer = ms


def _calls(fn, key, calls):
    """Rows of each call; a call without rows is the timer's."""
    state, out = _Kept(), []
    for rows in calls:
        state.hasTimedOut = rows is None
        df = pd.DataFrame(rows or [], columns=["seq", "text", "eos", "frame", "vault"])
        out.append([tuple(r) for r in next(fn(key, iter([df]), state)).itertuples(index=False)])
    return out, state


VAULT = json.dumps({"__ORG_1__": "Quill"})


def test_timer_emits_rows_behind_gaps_and_the_stream_goes_on():
    def row(seq, text, eos=False):
        return (seq, text, eos, None, VAULT if seq == 0 else None)

    calls = [[row(0, "a __ORG"), row(2, "of __OR"), row(3, "G_1__;")], None, [row(1, "_1__ late __ORG_1__ ")], [row(4, " on __ORG_1__", True)], [row(5, "behind")], None]
    out, _ = _calls(_fragments_fn(5), ("s", 0, -1), calls)
    assert out[0] == [("s", 0, -1, 0, 0, "a ")]
    assert out[1] == [("s", 0, -1, 1, 0, "__ORG"), ("s", 0, -1, 2, 0, "of "), ("s", 0, -1, 3, 0, "Quill;")]
    assert [r[3:] for r in out[2]] == [(1, 1, "_1__ late Quill ")]
    assert [r[3:] for r in out[3]] == [(4, 0, " on Quill")]
    assert out[4:] == [[], []]
    once, state = _calls(_fragments_fn(None), ("s", 0, -1), [[row(0, "x", True)]])
    assert [r[3:] for r in once[0]] == [(0, 0, "x")] and state.value is None


def test_timer_emits_frames_behind_gaps_and_the_stream_goes_on(spark):
    def frame(text):
        return json.dumps({"choices": [{"index": 0, "delta": {"content": text}}]})

    def row(seq, f):
        return (seq, None, None, f, VAULT if seq == 0 else None)

    def said(rows):
        return [(seq, part, json.loads(f)["choices"][0]["delta"]["content"] if f.startswith("{") else f) for _, seq, part, f in rows]

    calls = [[row(0, frame("a __ORG")), row(2, frame("of __ORG_1__"))], None, [row(3, frame("on __ORG_1__"))], [row(1, frame("late __ORG_1__"))], [row(4, "[DONE]")], [row(5, frame("behind"))], None]
    out, _ = _calls(_frames_fn(5), ("s",), calls)
    assert [said(o) for o in out] == [[(0, 0, "a ")], [(1, 0, "__ORG"), (2, 0, "of Quill")], [(3, 0, "on Quill")], [(1, 1, "late Quill")], [(4, 0, "[DONE]")], [], []]
    df = spark.createDataFrame([("s", "x", 0, frame("a")), ("s", "x", 2, frame("b __ORG_1__")), ("s", "x", 3, "[DONE]")], "stream_id string, session string, seq long, frame string")
    res = spark.createDataFrame([("x", "__ORG_1__", "Quill")], "session string, placeholder string, original string")
    assert said(sorted(tuple(r) for r in rehydrate_frames(df, res).collect())) == [(0, 0, "a"), (2, 0, "b Quill"), (3, 0, "[DONE]")]


def test_small_helpers(spark):
    from cloakroom.operators.vault import degraded_placeholder
    from cloakroom.plans.chat_queries import has_tools
    from cloakroom.sources.store import memory_indexes

    df = spark.createDataFrame([("PERSON", "Alex", '{"tools":[{"name":"f"}]}'), ("PERSON", "Alex", '{"messages":[]}')], "tag string, o string, body string")
    rows = df.select(degraded_placeholder(F.col("tag"), F.col("o")).alias("p"), has_tools(F.col("body")).alias("t")).collect()
    assert rows[0].p == rows[1].p and rows[0].p.startswith("__PERSON_h") and rows[0].p.endswith("__")
    assert [r.t for r in rows] == [True, False]
    mem = spark.createDataFrame([("m1", "Dark roast coffee, dark!")], "id string, content string")
    post, emb = memory_indexes(mem)
    assert {(r.term, r.tf) for r in post.collect()} == {("dark", 2), ("roast", 1), ("coffee", 1)}
    v = emb.first().vector
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-9


def test_odd_paths_and_broken_bodies(spark):
    body = json.dumps({"tools": [{"a.b": {"x[1]": {"description": "to q@r.example"}}, "list": [[{"description": "and s@t.example"}]]}]})
    req = spark.createDataFrame([("ok", body), ("bad", body[:-2]), ("none", None)], "request_id string, body string")
    a = anonymize(request_fields(req), Profile([Email()]))
    per = a.sanitized.groupBy("session").agg(F.collect_list(F.struct("steps", "text")).alias("fields"))
    out = {r.request_id: r.b for r in req.join(per, req.request_id == per.session, "left").select("request_id", set_fields("body", "fields").alias("b")).collect()}
    assert out["bad"] == body[:-2] and out["none"] is None
    tool = json.loads(out["ok"])["tools"][0]
    assert tool["a.b"]["x[1]"]["description"] == "to __EMAIL_1__" and tool["list"][0][0]["description"] == "and __EMAIL_2__"


def test_whole_requests_are_guarded(spark):
    from cloakroom.operators.detect import RegexSet
    from cloakroom.operators.gazetteer_join import JoinedGazetteer
    from cloakroom.operators.guard import guard_requests

    bodies = {
        "clean": '{"messages":[{"content":"hi __EMAIL_1__"}]}',
        "name": '{"messages":[{"name":"m\\u0061x@corp.example"}]}',
        "key": '{"10.20.30.40":1}',
        "term": '{"x":"call Falcon now"}',
        "cut": '{"x":"y"',
        "null": None,
    }
    req = spark.createDataFrame(list(bodies.items()), "request_id string, body string")
    vocab = spark.createDataFrame([("falcon", "project", 0)], "term string, label string, ins int")
    g = guard_requests(req, Profile([JoinedGazetteer(), Email(), RegexSet()]), vocab)
    assert {r.request_id for r in g.released.collect()} == {"clean"}
    assert {r.request_id for r in g.blocked.collect()} == set(bodies) - {"clean"}
    assert "v" not in g.leaks.columns


def test_names_of_members_are_not_restored(spark):
    from cloakroom.operators.rehydrate import rehydrate_json

    doc = '{"__ORG_1__":"__ORG_1__ and \\"__ORG_1__\\": x","n": [ "__ORG_1__" ]}'
    df = spark.createDataFrame([("s", 0, 0, doc)], "session string, ord long, field_pos int, text string")
    res = spark.createDataFrame([("s", "__ORG_1__", 'A "B"')], "session string, placeholder string, original string")
    got = json.loads(rehydrate_json(df, res).first().text)
    assert got == {"__ORG_1__": 'A "B" and "A "B"": x', "n": ['A "B"']}


def test_export_files_read_in_order(spark, tmp_path):
    import glob

    from cloakroom.sources.store import export_markdown

    lines = spark.createDataFrame([(i, f"line {i}") for i in range(500, 0, -1)], "line_no long, line string").repartition(7)
    export_markdown(lines, str(tmp_path / "out"))
    got = "".join(open(f).read() for f in sorted(glob.glob(str(tmp_path / "out" / "part-*"))))
    assert got.splitlines() == [f"line {i}" for i in range(1, 501)]
