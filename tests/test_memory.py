"""The cascade over small worlds, the store, streams and sources."""

from datetime import UTC, datetime

import pytest

from factloom.memory import Memory
from factloom.operators import gates, graph
from factloom.sources import corpus, metrics, store
from factloom.streaming import facts as stream


def day(y, m=1, d=1):
    return int(datetime(y, m, d, tzinfo=UTC).timestamp())


S = "vid bigint, key string, idx int, instance_id string, received_at timestamp"
T = "turn_id bigint, instance_id string, session_id string, idx int, role string, content string"
X = "extract_id bigint, instance_id string, session_id string, subject string, subject_type string, predicate string, value_text string, value_is_entity boolean, valid_from_hint string, confidence double, turn_ref string, evidence_span string"


def world(spark):
    """Two tenants: one with a life, one with two people who never met."""
    at = lambda y, m, d: datetime(y, m, d, tzinfo=UTC)
    sessions = [(1, "s1", 0, "main", at(2019, 3, 15)), (2, "s2", 1, "main", at(2021, 6, 1)), (3, "s3", 2, "main", at(2023, 9, 10)), (4, "i1", 0, "islands", at(2020, 1, 1)), (5, "i2", 1, "islands", at(2021, 1, 1))]
    turns = [(n * 10 + k, i, s, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for n, (_, s, _, i, _) in enumerate(sessions) for k in range(4)]
    x = []

    def add(inst, sess, subject, pred, value, entity=False, turn="0"):
        x.append((len(x), inst, sess, subject, "person", pred, value, entity, None, 0.9, turn, ""))

    for p, v, e in (("name", "Akhil", False), ("employer", "Acme Corp", True), ("lives_in", "Berlin", True), ("likes", "jazz", False), ("family_relation", "Maya Chen", True)):
        add("main", "s1", "user", p, v, e)
    add("main", "s2", "I", "employer", "Globex", True)
    add("main", "s2", "user", "pet", "Rufus")
    add("main", "s2", "user", "prefers", "Choose a harmonious frame", turn="[3]")
    add("main", "s3", "me", "job_title", "Staff Engineer")
    add("main", "s3", "user", "owns", "a road bike")
    add("main", "s3", "user", "name", "silver Honda Civic")
    add("main", "s3", "user", "goal", "none mentioned")
    add("main", "s3", "user", "goal", None)
    add("islands", "i1", "Rosalind Okonkwo", "occupation", "dentist")
    add("islands", "i2", "Tobias Vantablack", "occupation", "pilot")
    return spark.createDataFrame(x, X), spark.createDataFrame(sessions, S), spark.createDataFrame(turns, T)


@pytest.fixture(scope="module")
def memory(spark, tmp_path_factory):
    m = Memory(spark, str(tmp_path_factory.mktemp("memory")))
    m.add(*world(spark))
    return m


def test_build(memory):
    f = {(r.subject_key, r.predicate, r.value_text): r for r in memory.facts().collect()}
    assert len(f) == 13
    acme = f["person:user", "employer", "Acme Corp"]
    assert acme.status == "superseded" and acme.valid_to == day(2021, 6, 1) and acme.valid_from == day(2019, 3, 15)
    assert f["person:user", "name", "Akhil"].status == "superseded" and f["person:assistant", "prefers", "Choose a harmonious frame"].role == "assistant"
    assert {r.key for r in memory.entities().where("instance_id = 'main'").collect()} == {"person:user", "person:assistant", "org:acme corp", "org:globex", "place:berlin", "person:maya chen"}


def test_replay_is_a_no_op(spark, memory):
    before = sorted(memory.facts().collect())
    memory.add(*world(spark))
    assert sorted(memory.facts().collect()) == before


# (tenant, question, asked_at, reason, round_trips)
CASCADE = [
    ("main", "What did Priya Sharma recommend?", None, "unknown_entity", 3), ("void", "Where do I work?", None, "unknown_entity", 2), ("main", "What does Rosalind Okonkwo do for a living?", None, "unknown_entity", 3),
    ("main", "Where did I work in 2015?", None, "no_fact_in_window", 3), ("main", "Where did I live in 2010?", None, "no_fact_in_window", 3), ("islands", "Where does Rosalind Okonkwo live?", None, "no_such_relation", 3),
    ("islands", "Did Rosalind Okonkwo and Tobias Vantablack ever meet?", None, "no_path", 4), ("main", "Where do I live?", None, "", 3), ("main", "Where did I work in 2019?", None, "", 3), ("main", "Do I have a pet?", None, "", 3),
    ("main", "How is Maya Chen related to me?", None, "", 4), ("main", "Who is Maya Chen?", None, "", 3), ("main", "What is my email address?", None, "", 3), ("main", "Is Rufus well?", None, "", 3), ("main", "", None, "", 3), ("main", None, None, "", 3),
]


@pytest.mark.parametrize("case", [[c for c in CASCADE if c[0] == t] for t in ("void", "islands")] + [[c] for c in CASCADE if c[0] == "main"][::3], ids=lambda c: c[0][0] + str(c[0][1])[:20])
def test_cascade(spark, memory, case):
    for tenant, question, asked, reason, trips in case:
        q = spark.createDataFrame([(tenant, question, asked)], "instance_id string, question string, asked_at bigint")
        got = memory.search(q).first()
        assert (got.reason, got.round_trips, got.passed) == (reason, trips, reason == ""), question


def test_citations(spark, memory):
    rows = memory.facts().where("instance_id = 'main' and value_text = 'Berlin'").first()
    a = spark.createDataFrame([(1, "main", "Berlin", [f" {rows.fact_id.upper()} "]), (2, "main", "Berlin", []), (3, "main", "Berlin", [rows.fact_id, "deadbeef"]), (4, "main", "abstain: no", ["deadbeef"]), (5, "main", None, None)], "id int, instance_id string, answer string, cited array<string>")
    got = {r.id: (r.reason, r.missing) for r in gates.citation_gate(a, memory.facts()).collect()}
    assert got == {1: ("", ""), 2: ("uncited_answer", ""), 3: ("fabricated_citation", "deadbeef"), 4: ("not_in_graph", ""), 5: ("uncited_answer", "")}


def test_history_delete_explain(spark, tmp_path):
    m = Memory(spark, str(tmp_path))
    m.add(*world(spark))
    globex = m.facts().where("value_text = 'Globex'").first().fact_id
    assert [r.value_text for r in m.history(globex).collect()] == ["Acme Corp", "Globex"]
    first = m.store.versions("facts")[-1]
    assert m.delete(globex, day(2024)) and not m.delete(globex, day(2024)) and not m.delete("none", 1)
    assert "Globex" not in {r.value_text for r in m.get_all("main").collect()} and "Globex" in {r.value_text for r in m.get_all("main", first).collect()}
    m.add(*world(spark))
    assert m.facts().where("value_text = 'Globex'").first().status == "deleted"
    q = spark.createDataFrame([("main", "Where do I live?", None)], "instance_id string, question string, asked_at bigint")
    assert m.evidence(q).count() > 0
    berlin = m.facts().where("value_text = 'Berlin'").first().fact_id
    replies = spark.createDataFrame([("main", 1, "Berlin", [berlin])], "instance_id string, attempt int, text string, cited array<string>")
    text = m.explain(m.answer(q, replies)).first().text
    assert text.startswith("Q cost 3 round trips over 11 facts\n  1 entity: pass\n  2 predicate: pass\n  3 window: pass\n  4 path: skipped") and "answer: Berlin" in text and "user lives_in = Berlin" in text and "valid from 2019-03-15" in text, text


def test_answers(spark, memory):
    """Every case is a tenant of its own: a copy of main or islands."""
    from pyspark.sql import functions as F

    from factloom.operators import answer
    from factloom.session import written

    ids = {r.value_text: r.fact_id for r in memory.facts().collect()}
    b, g, live, work = ids["Berlin"], ids["Globex"], "Where do I live?", "Where did I work in 2020?"
    cases = [
        ("main", live, [(1, " Berlin ", [b.upper()])]), ("main", live, [(1, "Berlin", ["f" * 16])]), ("main", live, [(1, "Berlin", [])]), ("main", live, [(1, "ABSTAIN", [])]), ("main", live, []),
        ("main", work, [(1, "Globex", [g])]), ("main", work, [(1, "ABSTAIN", []), (2, "Globex", [g])]), ("main", work, [(1, "ABSTAIN", []), (2, "Globex", ["e" * 16])]), ("main", work, [(1, "ABSTAIN", [])]),
        ("islands", "Did Rosalind Okonkwo and Tobias Vantablack ever meet?", [(1, "yes", [])]), ("void", "Where do I work?", []),
    ]
    copies = spark.createDataFrame([(t, f"{t}{k}") for k, (t, _, _) in enumerate(cases)], "instance_id string, copy string")
    of = lambda df: written(df.join(copies, "instance_id").withColumn("instance_id", F.col("copy")).drop("copy"), "copies")
    e, f = of(memory.entities()), of(memory.facts())
    q = spark.createDataFrame([(f"{t}{k}", text, None) for k, (t, text, _) in enumerate(cases)], "instance_id string, question string, asked_at bigint")
    replies = spark.createDataFrame([(f"{t}{k}", *r) for k, (t, _, rs) in enumerate(cases) for r in rs], "instance_id string, attempt int, text string, cited array<string>")
    aliases = written(graph.alias_closure(graph.alias_links(e)), "copies")
    got = {r.instance_id: r for r in answer.answered(q, e, f, aliases, replies).collect()}
    a = [got[f"{t}{k}"] for k, (t, _, _) in enumerate(cases)]
    assert (a[0].answer, a[0].abstained, a[0].reason, a[0].cited, a[0].round_trips, a[0].fact_count) == ("Berlin", False, "", [b], 3, 11) and a[0].trace[-1] == "5 citation: pass"
    assert a[1].gate_detail == "fabricated_citation: " + "f" * 16 and a[2].reason == "uncited_answer" and a[3].trace[-1].startswith("appeal: skipped (nothing new") and a[4].reason == "not_in_graph"
    assert a[5].reason == "fabricated_citation" and a[5].window == "in 2020 (2020-01-01..2021-01-01)"  # outside the window: not shown
    assert (a[6].answer, a[6].appealed, a[6].appeal_won, a[6].fact_count) == ("Globex", True, True, 11) and a[6].trace[-1] == "appeal: won (11 facts, window dropped)"
    assert (a[7].reason, a[7].appealed, a[7].appeal_won) == ("not_in_graph", True, False) and a[7].trace[-1].startswith("appeal: lost (fabricated_citation")
    assert a[8].trace[-1] == "appeal: errored, abstention kept"
    assert a[9].gate_detail == "no_path: person:rosalind okonkwo, person:tobias vantablack: 1 pairs, no path within 4 hops" and a[9].trace[-1].startswith("4 path: no_path")
    assert a[10].reason == "unknown_entity"
    off = {r.instance_id: r for r in answer.answered(q, e, f, aliases, replies, appeals=False).collect()}
    assert off["main6"].trace[-1] == "appeal: skipped (appeal disabled)" and off["main6"].abstained


def test_a_graph_without_facts_is_empty(spark, memory):
    from factloom.operators import answer

    e, f = memory.entities(), memory.facts()
    q = spark.createDataFrame([("main", "Where do I live?", None)], "instance_id string, question string, asked_at bigint")
    none = spark.createDataFrame([], "instance_id string, attempt int, text string, cited array<string>")
    a = answer.answered(q, e, f.limit(0), graph.alias_closure(graph.alias_links(e)), none).first()
    assert (a.reason, a.abstained, a.fact_count, a.gate_detail) == ("empty_graph", True, 0, "")


def test_messages(spark, tmp_path):
    m = Memory(spark, str(tmp_path))

    def extract(text, date):
        if "boom" in text:
            raise ValueError("bad schema")
        return [{"subject": "user", "subject_type": "person", "predicate": "lives_in", "value_text": text.split()[-1], "value_is_entity": True, "confidence": 0.9, "turn_ref": "0", "evidence_span": text.split("] ")[-1]}]

    schema = "user_id string, messages array<struct<role: string, content: string>>, timestamp bigint"
    talks = [("u", [("user", "I moved to Berlin")], day(2020)), ("u", [("user", "I moved to Lyon")], day(2022)), ("u", [("user", "boom")], day(2023)), ("v", [("user", "I moved to Oslo")], day(2021)), (None, [("user", "x")], 0), ("w", None, 0)]
    m.add_messages(spark.createDataFrame(talks, schema), extract)
    assert sorted((r.instance_id, r.value_text, r.status) for r in m.facts().collect()) == [("u", "Berlin", "superseded"), ("u", "Lyon", "current"), ("v", "Oslo", "current")]
    assert [(r.instance_id, r.error) for r in m.failures().collect()] == [("u", "bad schema")]
    assert sorted((r.instance_id, r.idx) for r in m.sessions().collect()) == [("u", 0), ("u", 1), ("u", 2), ("v", 0)] and all(r.key.startswith("mem-") for r in m.sessions().collect())
    kinds = {r.type: r["n"] for r in m.edges().groupBy("type").agg(__import__("pyspark.sql.functions", fromlist=["count"]).count("*").alias("n")).collect()}
    assert kinds == {"SUBJECT": 3, "OBJECT": 3, "ASSERTED_IN": 3, "NEXT": 2, "SUPERSEDES": 1}
    before = sorted(m.facts().collect())
    m.add_messages(spark.createDataFrame(talks[:2], schema), extract)  # the same sessions again
    assert sorted(m.facts().collect()) == before and m.sessions().count() == 4
    m.add_messages(spark.createDataFrame([("u", [("user", "I moved to Rome")], day(2021))], schema), extract)  # late
    assert {r.value_text: r.status for r in m.facts().where("instance_id = 'u'").collect()} == {"Berlin": "superseded", "Rome": "superseded", "Lyon": "current"} and m.sessions().where("instance_id = 'u'").agg({"idx": "max"}).first()[0] == 3


def test_tables_are_written_together(spark, tmp_path):
    s = store.Snapshots(spark, str(tmp_path))
    one = lambda n: spark.createDataFrame([(n,)], "n int")
    assert s.write_all({"a": one(1), "b": one(1)}) == 1 and s.write("a", one(2)) == 2
    try:
        s.write_all({"a": one(3), "b": one(3).withColumn("x", __import__("pyspark.sql.functions", fromlist=["raise_error"]).raise_error(__import__("pyspark.sql.functions", fromlist=["lit"]).lit("no")).cast("int"))})
    except Exception:
        pass
    assert s.versions("a") == [1, 2] and s.versions("b") == [1] and s.read("a").first().n == 2 and s.read("a", 1).first().n == 1


def test_stream_in_any_order(spark, tmp_path, memory):
    rows = memory.facts().drop("superseded_by").withColumn("status", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("current"))
    for i, part in enumerate(rows.orderBy("asserted_at", ascending=False).randomSplit([1.0, 1.0, 1.0], 3)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    m = Memory(spark, f"{tmp_path}/m")
    src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream.start(src, m, f"{tmp_path}/check").awaitTermination()
    cols = ["vid", "status", "valid_to", "superseded_by"]
    assert sorted(m.facts().select(cols).collect(), key=lambda r: r.vid) == sorted(memory.facts().select(cols).collect(), key=lambda r: r.vid)


def test_corpus(spark, tmp_path):
    (tmp_path / "c.json").write_text("""[{"question_id": "q_abs", "question_type": "t", "question": "Q?", "answer": 7, "question_date": "2023/04/10 (Mon) 17:50", "haystack_session_ids": ["b", "a", "c"],
      "haystack_dates": ["2023/04/02 (Sun) 10:00", "2023/04/01 (Sat) 10:00", "2023/04/02 (Sun) 10:00"], "haystack_sessions": [[{"role": "user", "content": "hi", "has_answer": true}], [], [{"role": "assistant", "content": "yo"}]]}]""")
    i = corpus.instances(spark, str(tmp_path / "c.json"))
    r = i.first()
    assert (r.asked_at, r.answer, r.is_abstention) == (1681149000, "7", True) and [s.session_id for s in r.sessions] == ["a", "b", "c"]
    assert [(t.session_id, t.idx, t.has_answer) for t in corpus.turns(i).collect()] == [("b", 0, True), ("c", 0, False)]
    with pytest.raises(KeyError):
        corpus.instance(i, "nope")


def test_metrics(spark, tmp_path):
    (tmp_path / "m.txt").write_text('# HELP x\na_total 3\na_total 4\nb{l="1"} 5\nbad x\nread_seconds_sum{q="1"} 1.5\nread_seconds_sum{q="2"} 0.5\nread_seconds_count{q="1"} 4\nrows_microseconds_sum 2e6\nrows_microseconds_count 8\nnone_seconds_count 0\n')
    s = metrics.lines(spark, str(tmp_path / "m.txt"))
    assert {r.name: r.value for r in metrics.scalars(s).collect()}["a_total"] == 4
    assert {r.metric: r.mean_ms for r in metrics.histograms(s).collect()} == {"read_seconds": 500.0, "rows_microseconds": 250.0, "none_seconds": 0.0}


def test_logs_and_reports(spark, tmp_path):
    store.append_lines(spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int").coalesce(1), f"{tmp_path}/l")
    done = corpus.done_rows(spark, f"{tmp_path}/l", "id string, n int", ["id"])
    todo = spark.createDataFrame([("a",), ("c",)], "id string")
    assert [r.id for r in corpus.remaining(todo, done, ["id"]).collect()] == ["c"]
    store.to_csv(done, f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 2 and store.markdown(done).startswith("| id | n |")


def test_path_pairs(spark, memory):
    adj = graph.adjacent(graph.incidence(memory.facts().where("instance_id = 'main'")))
    a = spark.createDataFrame([("main", "person:user", "org:globex"), ("main", "org:acme corp", "place:berlin"), ("main", "org:acme corp", "person:assistant")], "instance_id string, a string, b string")
    assert {(r.a, r.b, r.hops) for r in graph.connected(a, adj).collect()} == {("person:user", "org:globex", 2), ("org:acme corp", "place:berlin", 4)}


def test_providers(spark):
    from factloom.functions.providers import answered

    req = spark.createDataFrame([(1, "a"), (2, "a"), (3, "boom")], "id int, prompt string")
    cache = spark.createDataFrame([], "key string, reply string")

    def reply(p):
        if p == "boom":
            raise ValueError("no")
        return p.upper()

    assert {r.id: (r.reply, r.error) for r in answered(req, cache, reply).collect()} == {1: ("A", None), 2: ("A", None), 3: (None, "no")}


def test_caches_and_retries(spark, tmp_path):
    from factloom.functions import providers as pr

    calls = []

    def flaky(what):
        calls.append(what)
        if len(calls) < 3:
            raise ValueError("later")
        return what

    assert pr.called(flaky, "x", 8, 0) == "x" and len(calls) == 3

    class Refused(Exception):
        status_code = 400

    def never(what):
        calls.append(what)
        raise Refused()

    with pytest.raises(Refused):
        pr.called(never, "y", 8, 0)
    assert calls.count("y") == 1

    s = store.Snapshots(spark, str(tmp_path))
    c = pr.Cache(s, "replies")
    log = f"{tmp_path}/calls"

    def reply(p):
        with open(log, "a") as f:
            f.write(p + "\n")
        if p == "boom":
            raise ValueError("no")
        return p.upper()

    req = spark.createDataFrame([(1, "a"), (2, "a"), (3, "boom")], "id int, prompt string")
    for _ in range(2):
        assert {r.id: (r.reply, r.error) for r in c.answered(req, reply, tries=1).collect()} == {1: ("A", None), 2: ("A", None), 3: (None, "no")}
    assert sorted(open(log).read().split()) == ["a", "boom", "boom"]
    v = pr.Cache(s, "vectors", pr.VECTORS)
    t = spark.createDataFrame([(1, "red kite"), (2, "red kite"), (3, None)], "id int, text string")
    got = {r.id: r.embedding for r in v.embedded(t, pr.hashed_words).collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-9 and sum(got[3]) == 0
    assert {r.id: r.embedding for r in v.embedded(t, lambda p: 1 / 0).collect()} == got  # all from the table
    assert v.embedded(t, pr.hashed_words, query=True).first().embedding != got[1]


def test_arms(spark, memory):
    from factloom.operators import answer, arms

    q = spark.createDataFrame([("main", "Where do I live?", None), ("islands", "Where does Rosalind Okonkwo live?", None)], "instance_id string, question string, asked_at bigint")
    _, _, turns = world(spark)
    berlin = memory.facts().where("value_text = 'Berlin'").first().fact_id
    replies = spark.createDataFrame([(i, a, t, 100, 5, 1.5) for i, t in (("main", "Berlin"), ("islands", "abstain")) for a in ("full_context", "vector_rag", "gated")], "instance_id string, arm string, text string, prompt_tokens bigint, completion_tokens bigint, latency_ms double")
    full = arms.full_context(turns, replies, ceiling=99)
    chunks = turns.selectExpr("instance_id", "turn_id AS id", "content AS text", "array(cast(idx as double), 1.0D) AS embedding")
    rag = arms.vector_rag(chunks, spark.createDataFrame([("main", [1.0, 0.0]), ("islands", [1.0, 0.0])], "instance_id string, embedding array<double>"), replies, k=3)
    a = memory.answer(q, spark.createDataFrame([("main", 1, "Berlin", [berlin])], "instance_id string, attempt int, text string, cited array<string>"))
    gated = arms.gated(a, memory.requests(q), replies)
    rows = {(r.arm, r.instance_id): r for r in full.unionByName(rag).unionByName(gated).collect()}
    assert len(rows) == 6 and rows["full_context", "main"].overflow and rows["full_context", "islands"].abstained and not rows["full_context", "main"].abstained
    assert rows["full_context", "main"].prompt_chars == 12 * 17 + 6 * 5 and rows["vector_rag", "main"].prompt_chars == 18
    assert rows["gated", "main"].prompt_tokens == 100 and rows["gated", "main"].round_trips == 3 and rows["gated", "islands"].prompt_tokens == 0 and rows["gated", "islands"].reason == "no_such_relation"
    prompts = {(r.instance_id, r.attempt): r.prompt for r in memory.requests(q).collect()}
    assert prompts["main", 1].startswith("Question asked on : Where do I live?\n\nFacts (fact_id") and berlin in prompts["main", 1] and len(prompts) == 4 and answer.HEAD in prompts["islands", 2]


def test_tokens_counts_and_keys(spark):
    import tiktoken  # noqa: F401

    from factloom.functions import ids, tokens

    t = spark.createDataFrame([(1, "Hello, world"), (2, None), (3, "")], "id bigint, text string")
    assert {r.id: r.tokens for r in tokens.token_counts(t, "id", "text").collect()} == {1: 3, 2: 0, 3: 0}
    df, seen = tokens.counted(t, "usage", "id")
    assert df.count() == 3 and seen.get == {"rows": 3, "id": 6}
    k = spark.createDataFrame([("a'b\\c",)], "k string")
    assert k.select(ids.literal("k")).first()[0] == "'a\\'b\\\\c'" and spark.range(1).select(ids.pair_count(ids._col("id") + 3)).first()[0] == 3
    with pytest.raises(Exception, match="control character"):
        spark.createDataFrame([("a\x01",)], "k string").select(ids.literal("k")).collect()
    rows = [(0, "a", 1), (0, "b", 2), (1, "a", 1)]
    one = {r.b: r.key for r in ids.batch_keys(spark.createDataFrame(rows, "b int, x string, y int"), "b", ["x", "y"], "rows").collect()}
    two = {r.b: r.key for r in ids.batch_keys(spark.createDataFrame(rows[::-1], "b int, x string, y int"), "b", ["x", "y"], "rows").collect()}
    assert one == two and one[0] != one[1] and one[0].startswith("rows.") and len(one[0]) <= 128


def test_paths_of_other_tenants_are_left_out(spark):
    p = spark.createDataFrame([("a", [("x", "a"), ("y", "a")]), ("a", [("x", "a"), ("y", "b")])], "instance_id string, nodes array<struct<key: string, instance_id: string>>")
    assert graph.scoped(p).count() == 1


def test_reports(spark, tmp_path):
    rows = spark.range(300).selectExpr("id", "cast(null as string) AS x")
    assert store.markdown(rows).count("\n") == 301
    with pytest.raises(ValueError):
        store.markdown(spark.range(10_001).toDF("n"))
    store.write_text(spark, store.report("Report", {"One": rows.limit(1), "Two": "words"}), f"{tmp_path}/r.md")
    assert (tmp_path / "r.md").read_text().startswith("# Report\n\n## One\n\n| id | x |")
    (tmp_path / "m.txt").write_text('graph_queries_total 7\nother_total 3\nread_seconds_sum 2\nread_seconds_count 4\n')
    got = {r.metric: (r.value, r.unit, r.note) for r in metrics.server_cost(metrics.lines(spark, str(tmp_path / "m.txt"))).collect()}
    assert got == {"graph_queries_total": (7.0, "count", ""), "read_seconds": (500.0, "ms", "mean over 4 samples; exported in seconds")}


def test_a_judge_decides_where_there_is_one(spark):
    from factloom.operators import evaluation as ev

    r = spark.createDataFrame([("r", "gated", f"i{k}", a, ab, "", 1, 1, 1.0, None, k, True) for k, (a, ab) in enumerate([("Berlin", False), ("Berlin", False), ("", True), ("", True)])], "run_id string, arm string, instance_id string, answer string, abstained boolean, reason string, fact_count int, round_trips int, latency_ms double, received_at timestamp, delivery_id bigint, appealed boolean")
    i = spark.createDataFrame([("i0", "t", False, "Berlin"), ("i1", "t", False, "Lyon"), ("i2", "t", True, None), ("i3", "t", False, "x")], "instance_id string, question_type string, is_abstention boolean, answer string")
    judged = spark.createDataFrame([("i0", "gated", False), ("i1", "gated", True)], "instance_id string, arm string, verdict boolean")
    got = {x.instance_id: x.correct for x in ev.scored(r, i, judged).collect()}
    assert got == {"i0": False, "i1": True, "i2": True, "i3": False}
    s = ev.summary(ev.scored(r, i)).where("category = 'ALL'").first()
    assert (s.appeals, s.appeals_won, s.overflow) == (4, 0, 0)
