"""Plans and results that must hold where tables are large."""

from pyspark.sql import functions as F

from cloakroom.functions import joins


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def filed(df, path):
    """The rows read from a Parquet file, whose few bytes say little of their number."""
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_large_vocabulary_is_not_broadcast(spark, texts, monkeypatch, tmp_path):
    from cloakroom.functions.text import explode_rows
    from cloakroom.operators.detect import Profile
    from cloakroom.operators.gazetteer_join import JoinedGazetteer, attach_terms

    t = filed(texts([("s", i, 0, f"by Customer#{i:09d}, or red{i}") for i in range(12)]), tmp_path / "t")
    rows = [(f"Customer#{i:09d}", "person", i) for i in range(8)] + [(f"red{i}", "org", 100 + i) for i in range(8)]
    vocab = filed(spark.createDataFrame(rows, "term string, label string, ins int"), tmp_path / "v")

    def found(df):
        hits = explode_rows(df, Profile([JoinedGazetteer()]).candidates(F.col("text")), ["ord"], "_p", "c")
        return {(r.ord, r.v) for r in hits.select("ord", "c.v").collect()}

    want = {(i, f"Customer#{i:09d}") for i in range(8)} | {(i, f"red{i}") for i in range(8)}
    assert found(attach_terms(t, vocab)) == want
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 3)
    many = attach_terms(t, vocab)
    assert "BroadcastExchange" not in executed(many)
    assert found(many) == want


def test_stored_rows_are_columns_in_the_checkpoint_folder(spark):
    from cloakroom.session import checkpoint_dir, stored

    df = spark.createDataFrame([("a", 1, b"x"), (None, None, None), ("a", 1, b"x")], "k string, n bigint, b binary")
    got = stored(df)
    assert got.schema == df.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert all(checkpoint_dir(spark).split(":")[-1] in f for f in got.inputFiles())


def test_sanitized_texts_leave_the_attached_terms_behind(spark, texts):
    from cloakroom.operators.anonymize import anonymize
    from cloakroom.operators.detect import Profile
    from cloakroom.operators.gazetteer_join import JoinedGazetteer, attach_terms
    from cloakroom.operators.rehydrate import rehydrate
    from cloakroom.operators.vault import durable_resolver, empty_durable, session_resolver

    t = texts([("s", 1, 0, "falcon and heron"), (None, None, 0, "heron, heron"), ("s", 1, 0, "none")])
    vocab = spark.createDataFrame([("falcon", "project", 1), ("heron", "project", 2)], "term string, label string, ins int")
    for key in (None, "k"):
        a = anonymize(t, Profile([JoinedGazetteer()]), durable=empty_durable(spark), key=key, attached=attach_terms(t, vocab))
        assert a.sanitized.columns == t.columns
        assert not [c for c in ("pri", "ins", "blen") if c in a.entities.columns]
        assert sorted(r.text for r in a.sanitized.collect()) == ["__PROJECT_1__, __PROJECT_1__", "__PROJECT_2__ and __PROJECT_1__", "none"]
        back = rehydrate(a.sanitized, session_resolver(a.vault), durable_resolver(a.durable, key))
        assert sorted(r.text for r in back.collect()) == ["falcon and heron", "heron, heron", "none"]



def test_report_lines_run_the_scenarios_once(spark):
    from cloakroom.operators.evaluate import report_lines

    runs = spark.sparkContext.accumulator(0)

    def seen(name):
        runs.add(1)
        return name

    rows = spark.createDataFrame([(f"d{i}", True, i % 2 == 0, False, None) for i in range(6)], "name string, baseline_pass boolean, anon_pass boolean, leaked boolean, error string")
    slow = rows.withColumn("name", F.udf(seen, "string")("name"))
    assert report_lines(slow).count() == 7
    assert runs.value == 6


def test_guard_makes_the_requests_once(spark):
    from cloakroom.operators.detect import Email, Profile
    from cloakroom.operators.guard import guard_requests

    runs = spark.sparkContext.accumulator(0)

    def seen(body):
        runs.add(1)
        return body

    rows = spark.createDataFrame([(1, '{"a":"x@y.com"}'), (2, '{"a":"fine"}'), (3, '{"a"')], "request_id bigint, body string")
    g = guard_requests(rows.withColumn("body", F.udf(seen, "string")("body")), Profile([Email()]))
    assert sorted(r.request_id for r in g.blocked.collect()) == [1, 3]
    assert [r.request_id for r in g.released.collect()] == [2]
    assert runs.value == 3


def test_replies_are_rescued_once(spark):
    from cloakroom.plans.chat_queries import restore_replies

    replies = spark.createDataFrame([("1", True, '{"choices":[{"message":{"content":"[TOOL_CALLS]f{\\"to\\": \\"__EMAIL_1__\\"}"}}]}')], "session string, needs_tools boolean, reply string")
    mails = spark.createDataFrame([("1", "__EMAIL_1__", "a@b.c")], "session string, placeholder string, original string")
    back = restore_replies(replies, mails)
    assert "ArrowEvalPython" not in executed(back)
    assert "a@b.c" in back.first().text


def test_steps_reach_python_as_text(spark):
    from cloakroom.operators.chat_fields import set_fields

    df = spark.sql("""SELECT '{"a":[{"b":"x"}],"c":"y"}' AS body, array(named_struct('steps', array(named_struct('k', 'a', 'i', CAST(null AS int)),
        named_struct('k', CAST(null AS string), 'i', 0), named_struct('k', 'b', 'i', CAST(null AS int))), 'text', 'new "\\u00e9"')) AS fields
        UNION ALL SELECT '{"c":1}', null""").repartition(1)
    out = df.select(set_fields("body", "fields").alias("b"))
    assert "to_json" in out._jdf.queryExecution().analyzed().toString()
    assert sorted(r.b for r in out.collect()) == ['{"a":[{"b":"new \\"\u00e9\\""}],"c":"y"}', '{"c":1}']


def test_streams_hold_their_own_placeholders_alone(spark):
    import json
    import random

    import pandas as pd

    from cloakroom.streaming import rehydrate_stream as R

    rng = random.Random(5)
    vault = {f"__ORG_{n}__": f"Quill {n}" for n in range(3)} | {"___A__": "under", "__B_1__": "b__ORG_1__"}
    longest = max(map(len, vault))
    texts, ends = (lambda text, eos: [("", text)] if text else []), (lambda text, eos: bool(eos))
    for _ in range(150):
        text = "".join(rng.choice(["__ORG_1__", "___A__", "__B_1__", "_", "__", " and ", "x" * 40, "ORG_2", "G_0__"]) for _ in range(rng.randint(1, 9)))
        size = rng.randint(1, 9)
        cut = [text[i : i + size] for i in range(0, len(text), size)]
        rows = [(s, "one", t, s == len(cut) - 1) for s, t in enumerate(cut)]
        rng.shuffle(rows)
        seen, state, out, held = R._seen_fn(["k"], ["text", "eos"], longest, None, texts, ends), _Held(), [], set()
        back, kept = R._opened(R._fragments_fn(None), ["text", "eos"]), _Held()
        while rows:
            part, rows = rows[:3], rows[3:]
            found = next(seen(("k",), iter([pd.DataFrame(part, columns=["seq", "session", "text", "eos"])]), state))
            held |= set(found["placeholder"].dropna())
            found["vault"] = [json.dumps({p: vault[p]}) if p in vault else None for p in found["placeholder"]]
            out += [tuple(r) for r in next(back(("k", 0, -1), iter([found]), kept)).itertuples(index=False)]
        assert "".join(r[-1] for r in sorted(out, key=lambda r: r[3:5])) == R.rehydrate_text(text, vault.get), (text, size)
        assert state.value is None and kept.value is None
        assert all(p.strip("_") in text for p in held)


class _Held:
    value, hasTimedOut = None, False
    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None


def test_no_stream_gets_the_vault_of_its_session(spark, tmp_path):
    from cloakroom.streaming.rehydrate_stream import FRAGMENT_SCHEMA, rehydrate_stream, through_files

    text, n = "to __ORG_7__ and __ORG_4999__.", 40
    rows = [(f"s{d}", "one", 0, None, s, c, s == len(text) - 1) for d in range(n) for s, c in enumerate(text)]
    spark.createDataFrame(rows, FRAGMENT_SCHEMA).repartition(3).write.parquet(f"{tmp_path}/in")
    vault = spark.range(5000).selectExpr("'one' AS session", "concat('__ORG_', id, '__') AS placeholder", "concat('Quill & Son no. ', id) AS original")
    src = spark.readStream.schema(FRAGMENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = rehydrate_stream(src, vault, hop=through_files(f"{tmp_path}/seen")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for r in sorted(spark.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: (r.stream_id, r.seq, r.part)):
        got[r.stream_id] = got.get(r.stream_id, "") + r.text
    assert got == {f"s{d}": "to Quill & Son no. 7 and Quill & Son no. 4999." for d in range(n)}
    state = sum(f.stat().st_size for folder in ("state/state", "seen/state/state") for f in tmp_path.joinpath(folder).rglob("*.delta"))
    assert state < 400_000  # the vault alone is 200 KB, forty of them were here before


def test_equal_query_vectors_are_compared_once(spark):
    from cloakroom.operators import memory as M

    q = spark.range(3000).selectExpr("id AS qid", "array(CAST(id % 3 AS double), IF(id % 2 = 0, 1.0D, 1.0D), IF(id % 2 = 0, 0.0D, -0.0D)) AS vec")
    again = q.where("qid < 2").union(spark.sql("SELECT 0L AS qid, array(9.0D, 0.0D, 0.0D) AS vec"))
    items = spark.sql("SELECT CAST(id AS string) AS id, array(CAST(id AS double), 1.0D, 0.5D) AS vec FROM range(40)")
    got = M.vector_top_k(q, items, 4, block=(10, 15))
    plan = executed(got)
    assert "qid" not in plan[plan.index("FlatMapCoGroupsInPandas") :].split("SortAggregate")[0]
    best = {r.qid: [] for r in q.select("qid").collect()}
    for r in got.orderBy("qid", "rk").collect():
        best[r.qid].append((r.id, r.rk))
    assert len({str(best[i]) for i in range(0, 3000, 3)}) == 1 and all(len(b) == 4 for b in best.values())
    slow = {(r.qid, r.id) for r in q.where("qid < 6").crossJoin(items.withColumnRenamed("vec", "v")).selectExpr(
        "qid", "id", "row_number() OVER (PARTITION BY qid ORDER BY round(aggregate(zip_with(vec, v, (a, b) -> a * b), 0D, (s, x) -> s + x) / sqrt(aggregate(vec, 0D, (s, x) -> s + x * x)) / sqrt(aggregate(v, 0D, (s, x) -> s + x * x)), 9) DESC, id) AS rk").where("rk <= 4").collect()}
    assert {(i, x) for i in range(6) for x, _ in best[i]} == slow
    # a qid with several rows: the best of all of them, as often as they are there
    both = M.vector_top_k(q.unionByName(again), items, 4).where("qid < 3").collect()
    assert sorted(r.rk for r in both if r.qid == 0) == [1, 2, 3, 4]
    assert [r.id for r in sorted(both, key=lambda r: r.rk) if r.qid == 1] == [best[1][0][0]] * 2 + [best[1][1][0]] * 2


def test_numbered_names_meet_only_the_texts_they_are_in(spark, texts):
    from cloakroom.operators import guard

    n = 400
    names = [f"Customer#{i:09d}" for i in range(n)]
    sent = texts([("s", i, 0, f"to zq{names[i * 7 % n]}zq or 000{i:03d} \U0001f600{names[i]}" if i % 2 else f"ref 00000{i:04d}, no name") for i in range(200)])
    durable = spark.createDataFrame([("PERSON", f"__PERSON_{i}__", x) for i, x in enumerate(names)] + [("X", "__X_1__", "0000"), ("X", "__X_2__", "q")], "tag string, placeholder string, original string")
    want = {(i, p) for i, t in ((r.ord, r.text) for r in sent.collect()) for p, x in ((r.placeholder, r.original) for r in durable.collect()) if x in t}
    assert {(r.ord, r.placeholder) for r in guard.vault_leaks(sent, durable.selectExpr("'other' AS session", "*").where("false"), durable).collect()} == want
    assert sorted(guard._cut("aaa-aab", [("aa", 0, 3), ("aa", 1, 3), ("b", 2, 9)])) == ["-aa", "aa-", "aaa", "aab"]
