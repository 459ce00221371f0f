"""Pseudonyms, and the stages of the pipeline one by one."""

import datetime
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cloakroom.llm import ngram_join, pii_pseudonyms, toxicity

KEY = "test key"


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += 2 * d - 9 * (d > 4) if i % 2 else d
    return total % 10 == 0


def _mod97(iban):
    text = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


@pytest.fixture(scope="module")
def moved(spark):
    def run(texts, key=KEY):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        out = df.withColumn("new", pii_pseudonyms.pseudonymize("text", key)).withColumn("back", pii_pseudonyms.restore("new", key))
        return [(r["text"], r["new"], r["back"]) for r in out.orderBy("doc_id").collect()]

    return run


def test_the_parser_gets_no_long_text(spark, monkeypatch):
    # what it keeps of one stays in the driver's memory
    parsed, expr = [], F.expr
    monkeypatch.setattr(F, "expr", lambda text: parsed.append(len(text)) or expr(text))
    df = spark.createDataFrame([(1, "call 415-555-0132")], "doc_id long, text string")
    new = df.withColumn("text", pii_pseudonyms.pseudonymize("text", KEY)).withColumn("back", pii_pseudonyms.restore("text", KEY)).withColumn("n", pii_pseudonyms.count_values("text"))
    assert new.first()["back"] == "call 415-555-0132" and new.first()["n"] == 1
    assert max(parsed, default=0) < 1000


CASES = {
    "4111 1111 1111 1111": r"4\d{3} \d{4} \d{4} \d{4}",
    "4111-1111-1111-1111": r"4\d{3}-\d{4}-\d{4}-\d{4}",
    "378282246310005": r"3\d{14}",
    "GB82 WEST 1234 5698 7654 32": r"GB\d\d WEST \d{4} \d{4} \d{4} \d\d",
    "DE89370400440532013000": r"DE\d{20}",
    "123-45-6789": r"\d{3}-\d\d-\d{4}",
    "203.0.113.7": r"\d+\.\d+\.\d+\.\d+",
    "+1 (988) 555-2485": r"\+1 \(\d{3}\) \d{3}-\d{4}",
    "415-555-0132": r"\d{3}-\d{3}-\d{4}",
    "+33 6 12 34 56 78": r"\+33 6 \d\d \d\d \d\d \d\d",
    "2021-02-28": r"\d{4}-\d\d-\d\d",
    "31.12.1999": r"\d\d\.\d\d\.\d{4}",
    "2001/03/04": r"\d{4}/\d\d/\d\d",
}


def test_values_move_within_their_format_and_back(moved):
    for (old, new, back), shape in zip(moved(CASES), CASES.values()):
        assert new != old and re.fullmatch(shape, new) and back == old
        if shape.startswith(("4", "3")):
            assert _luhn(re.sub(r"\D", "", new))
        if old[:2] in ("GB", "DE"):
            assert _mod97(new) == 1


def test_addresses_of_single_digits_move(spark, moved):
    texts = ["8.8.8.8", "dns is 8.8.8.8", "dns is 8.8.8.8 on port 53", "use 1.1.1.1"]
    got = moved(texts)
    assert all(new != old and back == old for old, new, back in got)
    assert got[1][1] == f"dns is {got[0][1]}" and got[2][1] == f"dns is {got[0][1]} on port 53"
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["n_values"] for r in pii_pseudonyms.pseudonymize_documents(df, KEY).collect()} == {1}


def test_month_first_dates_move_among_themselves(moved):
    for first in (1900, 2000):
        days = [d for d in (datetime.date(first, 1, 1) + datetime.timedelta(n) for n in range(36525)) if d.day > 12 and d.year < first + 100]
        texts = [d.strftime("%m/%d/%Y") for d in days]
        got = moved(texts)
        assert {new for _, new, _ in got} == set(texts) and all(back == old for old, _, back in got)
        assert sum(new == old for old, new, _ in got) < 10
    texts = ["born 12/25/1985.", "02/29/1600", "02/30/1990", "12/32/1985", "02/29/1900"]
    (_, new, back), (_, leap, again), *others = moved(texts)
    assert re.fullmatch(r"born \d\d/\d\d/19\d\d\.", new) and new != texts[0] and back == texts[0]
    assert re.fullmatch(r"\d\d/\d\d/16\d\d", leap) and again == texts[1]
    assert [n for _, n, _ in others] == texts[2:]


def test_numbers_beside_others_move(moved):
    def iban(country, bban):
        return f"{country}{98 - _mod97(country + '00' + bban):02}{bban}"

    shapes = {
        "call +14155550132 now": r"call \+1\d{10} now",
        "+1 4155550132": r"\+1 \d{10}",
        "+1 415 5550132": r"\+1 \d{3} \d{7}",
        "+1 41 5555 0132": r"\+1 \d\d \d{4} \d{4}",
        "+1(415)5550132": r"\+1\(\d{3}\)\d{7}",
        "IBAN ES9121000418450200051332 EUR 500": r"IBAN ES\d{22} EUR 500",
        "SE45 5000 0000 0583 9825 7466 BIC ABCDEFGH": r"SE\d\d( \d{4}){5} BIC ABCDEFGH",
        "SE45 5000 0000 0583 9825 7466 2024 0501": r"SE\d\d( \d{4}){5} 2024 0501",
        "ID12 4111 1111 1111 1111": r"ID12 4\d{3}( \d{4}){3}",
        "+44 20 7946 0123 2024-05-01": r"\+44 \d\d \d{4} \d{4} \d{4}-\d\d-\d\d",
        "+44 7946 0123 31.12.1999": r"\+44 \d{4} \d{4} \d\d\.\d\d\.\d{4}",
        "+44 7946 0123 10.0.0.1": r"\+44 \d{4} \d{4} \d+\.\d+\.\d+\.\d+",
    }
    for (old, new, back), shape in zip(moved(shapes), shapes.values()):
        assert re.fullmatch(shape, new) and back == old, (old, new, back)
        for a, b in zip(re.findall(r"\+[\d ()]{8,20}\d|[A-Z]{2}\d\d[\d ]{12,}\d|\d{4}-\d\d-\d\d|\d+\.\d+\.\d+", old), re.findall(r"\+[\d ()]{8,20}\d|[A-Z]{2}\d\d[\d ]{12,}\d|\d{4}-\d\d-\d\d|\d+\.\d+\.\d+", new)):
            assert a != b
    found = moved(["+14155550132", "415-555-0132"])
    assert re.sub(r"\D", "", found[0][1])[1:] == re.sub(r"\D", "", found[1][1])
    every = [iban(c, "".join(str((7 * i + n) % 10) for i in range(n - 4))) for n, cs in pii_pseudonyms.IBAN_LENGTHS.items() for c in cs.split()]
    texts = [f"{' '.join(re.findall('.{1,4}', v))} EUR 500" for v in every] + [f"{v} 2024" for v in every]
    for old, new, back in moved(texts):
        assert new != old and new.split()[-1] == old.split()[-1] and back == old
        assert _mod97(re.sub(r" EUR 500| 2024$", "", new)) == 1


def test_invalid_and_plain_values_stay(moved):
    texts = ["4111 1111 1111 1112", "GB82 WEST 1234 5698 7654 31", "2021-02-30", "31.13.1999", "000-12-3456", "666-12-3456", "256.1.1.1", "1.2.3.4.5", "version 4.0", "no 12345", "key 9f4111111111111111ab", "", None]
    assert [new for _, new, _ in moved(texts)] == texts


def test_equal_values_stay_linked_and_keys_differ(moved):
    first = moved(["a 4111111111111111 b", "4111111111111111", "mail jo.doe1@x.example.org now", "jo.doe1@x.example.org"])
    assert first[0][1] == f"a {first[1][1]} b" and first[2][1] == f"mail {first[3][1]} now"
    assert re.fullmatch(r"[a-z]{2}\.[a-z]{3}\d@x\.example\.org", first[3][1]) and first[3][1] != "jo.doe1@x.example.org"
    assert moved(["4111111111111111"], "other key")[0][1] != first[1][1]


def test_permutations_are_one_to_one(moved):
    rng = random.Random(14)
    ips = [f"10.0.{i // 256}.{i % 256}" for i in range(600)]
    dates = sorted({f"{rng.randint(1900, 2090)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}" for _ in range(600)})
    ssns = [f"{rng.choice([1, 665, 667, 899]):03}-{i % 99 + 1:02}-{i + 1:04}" for i in range(600)]
    for values in (ips, dates, ssns):
        got = moved(values)
        assert len({new for _, new, _ in got}) == len(values) and all(back == old for old, _, back in got)


def test_pseudonyms_use_no_python(spark, odd_documents, no_documents):
    out = pii_pseudonyms.pseudonymize_documents(odd_documents, KEY)
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|MapIn", plan)
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect()) == sorted((str(r["doc_id"]), r["text"] or "") for r in odd_documents.collect())
    assert sum(r["text"] is None for r in out.collect()) == 2
    assert pii_pseudonyms.pseudonymize_documents(no_documents, KEY).count() == 0


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark):
    """The documents after each stage."""
    out = [("documents", spark.read.parquet(f"{SF}/documents.parquet"))]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, stage(spark, out[-1][1], SF).cache()))
    return out


def test_stages_keep_the_columns(staged):
    for _, df in staged[1:-1]:
        assert df.dtypes == staged[0][1].dtypes


def test_toxicity_stage(spark, staged):
    docs, kept = staged[0][1], staged[1][1]
    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = {r["doc_id"] for r in docs.where(toxicity.score(F.col("text"), model) >= corpus_pipeline.TOXIC_FROM).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - rejected


def test_near_duplicate_stage(staged):
    docs, kept = staged[1][1], staged[2][1]
    found = ngram_join.similar_documents(docs).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["group_id"], set()).add(r["doc_id"])
    assert {r["doc_id"] for r in kept.collect()} == {min(g) for g in groups.values()}


def test_near_duplicate_stage_keeps_one_row_of_repeated_and_null_ids(spark):
    fox = "the quick brown fox jumps over the lazy dog near the river bank today " * 4
    tea = "a cup of green tea is better than a cup of black coffee at night " * 4
    sea = "ships go down to the sea and come home again with fish and salt " * 4
    rows = [
        (1, fox, "b"), (1, fox, "a"), (1, fox, "a"), (1, fox + "now", "c"), (2, fox, "d"), (None, fox, "e"),
        (None, tea, "f"), (None, tea, "g"), (None, tea + "now", "h"),
        (1, sea, "i"), (3, sea, "j"),
        (4, "", "k"), (4, "", "k"), (None, None, "l"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    got = [tuple(r) for r in kept.collect()]
    assert kept.dtypes == docs.dtypes
    for word, ids in (("fox", {1}), ("tea", {None}), ("ships", {1})):
        assert [r[0] for r in got if r[1] and word in r[1]] == list(ids)
    assert len(got) == 6 and sorted(r[2] for r in got if not r[1]) == ["k", "k", "l"]
    again = corpus_pipeline.near_duplicate_stage(spark, docs.repartition(7, "source"), SF).collect()
    assert sorted(map(repr, map(tuple, again))) == sorted(map(repr, got))


def test_substring_stage_against_sql(staged):
    docs, kept = staged[2][1].toPandas(), staged[3][1].toPandas()
    con = duckdb.connect()
    con.register("d", docs)
    want = con.execute(
        r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
        win AS (SELECT doc_id, k, array_to_string(words[k:k + 12], ' ') AS s FROM w, range(1, greatest(len(words) - 11, 1)) t(k) WHERE len(words) >= 13),
        hit AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE first < doc_id),
        gone AS (SELECT DISTINCT doc_id, k + j AS k FROM hit, range(0, 13) t(j))
        SELECT doc_id, len(words) - (SELECT count(*) FROM gone g WHERE g.doc_id = w.doc_id) AS n FROM w
        """
    ).fetchall()
    assert dict(want) == {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in kept.itertuples()}
    assert all(len(r.text) == r.n_chars for r in kept.itertuples())


def test_pii_stage(staged):
    before = {r["doc_id"]: r["text"] for r in staged[3][1].collect()}
    changed = 0
    for r in staged[4][1].collect():
        for card in re.findall(r"(?<!\d)\d{16}(?!\d)", before[r["doc_id"]]):
            if _luhn(card):
                assert card not in r["text"]
                changed += 1
        if not re.search(r"\d{2}|@", before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]
    assert changed


def test_packing_stage(staged):
    rows = staged[5][1].collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in staged[4][1].collect()}
    assert len({r["sequence_id"] for r in rows}) == -(-sum(r["length"] for r in rows) // 2048)


def test_stages_take_odd_documents(spark, odd_documents, tmp_path):
    docs = odd_documents.withColumn("n_chars", F.length("text").cast("long"))
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for empty in (False, True):
        now = docs.where("false") if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, now, str(tmp_path)).cache()
            if name != "packing":
                assert after.dtypes == now.dtypes
            if empty:
                assert after.count() == 0
            elif name == "substring_dedup":
                assert after.where("text is null").count() == 2
                other = [c for c in docs.columns if c not in ("text", "n_chars")]
                assert sorted(map(repr, after.select(other).collect())) == sorted(map(repr, now.select(other).collect()))
            now = after


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(got.columns)


def test_extra_columns_survive_the_stages(spark, tmp_path):
    import datetime as dt

    from pyspark.sql import Row
    from pyspark.sql import functions as F

    base = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = {
        "_null": "cast(null as string)", "_row_key": "'a'", "row_key": "cast(doc_id as string)", "id": "doc_id * 2", "_rest": "'r'", "row": "1", "key": "2", "words": "false",
        "at": "timestamp_micros(1700000000123456 + doc_id)", "day": "date '2020-02-29'", "ntz": "timestamp_ntz '2021-01-01 00:00:00.000007'",
        "by": "map(cast(doc_id as int), 'x', -1, null)", "bytes": "cast(source as binary)", "a.b": "named_struct('p', array(1, null), 'q', map(1.5D, named_struct('z', doc_id)))",
        "amount": "cast(doc_id / 7 as decimal(20, 6))", "ratio": "cast('NaN' as double)",
    }
    docs = base.selectExpr("*", *[f"{v} AS `{k}`" for k, v in odd.items()]).unionByName(
        base.limit(3).selectExpr("*", *[f"{v} AS `{k}`" for k, v in odd.items()])
    )
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    seen = {r["row_key"]: r for r in docs.collect()}
    base.sparkSession.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).cache()
        assert now.columns == docs.columns and [t for _, t in now.dtypes] == [t for _, t in docs.dtypes], name
        for r in now.collect():
            for c in odd:
                a, b = r[c], seen[r["row_key"]][c]
                assert a == b or (a != a and b != b), (name, c, a, b)
    assert now.count() > 10
