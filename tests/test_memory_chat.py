from pyspark.sql import functions as F

from cloakroom.operators import memory as M
from cloakroom.operators.evaluate import report
from cloakroom.operators.routing import candidates
from cloakroom.operators.transcript import parse_model_entities, rescue_tool_call
from cloakroom.sources.vocab import vocab_terms


def mem_table(spark, rows):
    return spark.createDataFrame(
        [(M_id, c, "fact", p, t, 0, t, False) for M_id, c, p, t in rows],
        "id string, content string, kind string, egress_policy string, created_ms long, recall_count long, accessed_ms long, promoted boolean",
    )


def test_keyword_recall(spark):
    mem = mem_table(spark, [("a", "User prefers dark roast coffee", "anonymized", 1), ("b", "Works on Falcon roadmap", "anonymized", 2)])
    q = spark.createDataFrame([(1, "what coffee do I like"), (2, "tell me about Falcon & its roadmap!?"), (3, "zzz")], "qid int, text string")
    got = {(r.qid, r.id) for r in M.recall(q, mem).collect()}
    assert got == {(1, "a"), (2, "b")}


def test_hash_embedding_shared_tokens_score_higher(spark):
    df = spark.createDataFrame([(0, "dark roast coffee beans"), (1, "dark roast coffee"), (2, "quarterly tax filing"), (3, " . ")], "i int, t string")
    v = [r.vec for r in M.hash_embed(df, "i", "t").orderBy("i").collect()]
    assert v[3] == [0.0] * 64
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    assert abs(dot(v[0], v[0]) - 1) < 1e-9
    assert dot(v[0], v[1]) > dot(v[0], v[2])
    assert v == [r.vec for r in M.hash_embed(df, "i", "t").orderBy("i").collect()]  # deterministic


def test_vector_top_k_is_the_same_for_any_blocks(spark):
    import random

    rng = random.Random(3)
    vec = lambda: [float(rng.randint(-2, 2)) for _ in range(4)]
    q = spark.createDataFrame([(i, vec()) for i in range(70)], "qid long, vec array<double>")
    items = spark.createDataFrame([(f"i{i:03d}", vec()) for i in range(200)], "id string, vec array<double>")
    runs = [sorted(map(tuple, M.vector_top_k(q, items, 5, block=b).collect())) for b in ((2048, 8192), (7, 30), (1, 200))]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) > 300
    assert M.vector_top_k(q.where("false"), items).count() == 0


def test_pruned_recall_equals_the_full_one(spark):
    import random

    rng = random.Random(4)
    word = lambda: rng.choice(["common", "usual", "every"]) if rng.random() < 0.6 else f"rare{rng.randint(0, 40)}"
    mem = mem_table(spark, [(f"m{i:03d}", " ".join(word() for _ in range(rng.randint(1, 12))), "anonymized", i) for i in range(120)])
    q = spark.createDataFrame([(i, " ".join(word() for _ in range(rng.randint(1, 9)))) for i in range(60)], "qid int, text string")
    full = M.top_k(M.bm25_scores(q, mem).withColumn("score", F.round("score", 9)), 8).select("qid", "id", "rk")
    assert sorted(map(tuple, M.recall(q, mem).collect())) == sorted(map(tuple, full.collect()))


def test_budget_drops_local_only_and_truncates(spark):
    rows = [(f"m{i:02d}", "x" * 160, "anonymized", i) for i in range(50)] + [("loc", "secret plan", "local_only", 99)]
    mem = mem_table(spark, rows)
    fused = spark.createDataFrame([(1, "loc", 0)] + [(1, f"m{i:02d}", i + 1) for i in range(50)], "qid int, id string, rank long")
    sel = M.select_injectable(fused, mem, budget=400).collect()
    assert "loc" not in {r.id for r in sel}
    assert len(sel) == 9  # 42 tokens each: 9 * 42 = 378 <= 400 < 420
    block = M.memory_block(M.select_injectable(fused, mem, budget=400)).first().block
    assert block.startswith(M.BLOCK_HEADER + "\n- x")


def test_promotion_on_third_recall_and_export(spark):
    mem = mem_table(spark, [("a", "likes tea", "anonymized", 5), ("b", "hates rain", "local_only", 6)])
    ev = spark.createDataFrame([("a", 10, 1), ("a", 20, 2), ("a", 30, 3), ("b", 15, 4)], "id string, ts_ms long, ev long")
    after = {r.id: r for r in M.record_recalls(mem, ev).collect()}
    assert after["a"].promoted and after["a"].recall_count == 3 and after["a"].promoted_at_ms == 30
    assert not after["b"].promoted and after["b"].promoted_at_ms is None
    lines = [r.line for r in M.export_lines(M.record_recalls(mem, ev)).orderBy("line_no").collect()]
    assert lines[4] == "- * likes tea  _(fact, anonymized, recalled 3x)_"


def test_rescue_formats_and_no_ops(spark):
    rows = ['[TOOL_CALLS]get_weather{"city": "Paris"}', '<tool_call>{"name": "g", "arguments": {"b": 1}}</tool_call>',
            'Sure ```json\n{"name":"h","parameters":{"c":2}}\n```', "just prose", 'see [1]: {"name":"k"}']
    got = [r.c for r in spark.createDataFrame([(r,) for r in rows], "t string").select(rescue_tool_call(F.col("t")).alias("c")).collect()]
    assert [(c.name, c.arguments) if c else None for c in got] == [
        ("get_weather", '{"city":"Paris"}'), ("g", '{"b":1}'), ("h", '{"c":2}'), None, None,
    ]


def test_model_reply_parsing(spark):
    rows = ['{"entities":[{"text":"Alex","type":"person"}]}', 'Sure!\n```json\n{"entities":[{"text":" Falcon ","type":"project"}]}\n```',
            "garbage", "", "{not valid json"]
    got = [r.e for r in spark.createDataFrame([(r,) for r in rows], "t string").select(parse_model_entities(F.col("t")).alias("e")).collect()]
    assert [[(e.text, e.label) for e in x] for x in got] == [[("Alex", "person")], [("Falcon", "project")], [], [], []]


def test_vocab_loader(spark, tmp_path):
    f = tmp_path / "terms.txt"
    f.write_text("# my projects\nMercury\n\n  Apollo  \n")
    got = [r.term for r in vocab_terms(spark, "Falcon, Acme Corp", [str(f)]).orderBy("ins").collect()]
    assert got == ["Falcon", "Acme Corp", "Mercury", "Apollo"]


def test_candidates_and_report(spark):
    models = spark.createDataFrame([("a", 2, False, 0), ("b", 1, True, 1), ("c", 3, True, 2)], "model_id string, priority int, tools boolean, ins int")
    req = spark.createDataFrame([(1, True), (2, False)], "request_id int, needs_tools boolean")
    got = {}
    for r in candidates(req, models).orderBy("request_id", "pref").collect():
        got.setdefault(r.request_id, []).append(r.model_id)
    assert got == {1: ["b", "c"], 2: ["b", "a", "c"]}
    out = spark.createDataFrame(
        [("x", True, True, False, None), ("y", True, False, False, None), ("z", False, False, True, "boom"), ("w", True, False, False, None)],
        "name string, baseline_pass boolean, anon_pass boolean, leaked boolean, error string",
    )
    r = report(out).first()
    assert (r.baseline_rate, r.anon_rate, r.leaks) == (1.0, round(1 / 3, 6), 1)
    assert r.retention == round(1 / 3, 6)


def _first_balanced(s):
    """The shortest stretch from the first opener that holds as many closers as openers outside strings."""
    import re

    start = re.search(r"[{\[]", s)
    if not start:
        return None
    rest = s[start.start() :]
    pair = "{}" if rest[0] == "{" else "[]"
    for end in range(1, len(rest) + 1):
        # strings go, an unfinished one with all behind it
        bare = re.sub(r'"(?:[^"\\]|\\[\s\S])*(?:"|\\?$)', "", rest[:end])
        if bare.count(pair[0]) == bare.count(pair[1]) > 0:
            return rest[:end]
    return None


def test_first_balanced_matches_scan(spark):
    import random

    from cloakroom.operators.transcript import first_balanced

    rnd = random.Random(11)
    alphabet = ['{', '}', '[', ']', '"', '\\', 'a', ' ', ':', ',', 'é']
    strings = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(strings)], "i int, t string")
    got = {r.i: r.b for r in df.select("i", first_balanced(F.col("t")).alias("b")).collect()}
    for i, t in enumerate(strings):
        assert got[i] == _first_balanced(t), t


def test_report_lines(spark):
    from cloakroom.operators.evaluate import report_lines

    out = spark.createDataFrame(
        [("b", True, True, False, None), ("a", True, False, True, None), ("c", False, False, False, "timeout")],
        "name string, baseline_pass boolean, anon_pass boolean, leaked boolean, error string",
    )
    lines = [r.line for r in report_lines(out).orderBy("line_no").collect()]
    assert lines[0] == "scenario=a baseline=pass anonymized=fail leak=yes"
    assert lines[2] == "scenario=c baseline=fail anonymized=fail leak=no error=timeout"
    assert lines[3] == "total scenarios=3 baseline=1.0000 anonymized=0.5000 retention=0.5000 leaks=1" and len(lines) == 4


def test_rescue_rejects_invalid_named_arguments(spark):
    rows = ['[TOOL_CALLS]f{not json}', '[TOOL_CALLS]"g" {"a": [1, 2]}']
    got = [r.c for r in spark.createDataFrame([(r,) for r in rows], "t string").select(rescue_tool_call(F.col("t")).alias("c")).collect()]
    assert got[0] is None
    assert (got[1].name, got[1].arguments) == ("g", '{"a":[1,2]}')


def test_vectors_that_cannot_be_compared_take_no_part(spark):
    from cloakroom.operators import memory as M

    vectors = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0, None]), (5, [1.0, 2.0, 3.0]), (6, [float("nan"), 1.0]), (7, [1.0, 1.0])]
    items = spark.createDataFrame(vectors, "id int, vec array<double>")
    got = M.vector_top_k(items.withColumnRenamed("id", "qid"), items, 3).collect()
    assert {(r["qid"], r["id"]) for r in got} == {(1, 1), (1, 7), (7, 7), (7, 1), (5, 5)}


def test_reply_content_of_odd_replies(spark):
    from cloakroom.operators.evaluate import eval_request, reply_content

    replies = [None, "", "x", "[]", '{"choices":[{"message":{}}]}', '{"choices":[{"message":{"content":["a"]}}]}', '{"choices":[{"message":{"content":"a \\"b\\""}},{"message":{"content":"c"}}]}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    assert [x[0] for x in df.orderBy("i").select(reply_content(F.col("r"))).collect()] == [""] * 6 + ['a "b"']
    asked = df.where("i < 3").orderBy("i").select(eval_request(F.col("r"))).collect()
    assert asked[0][0] == '{"model":"auto","messages":[{"role":"user","content":""}]}'
