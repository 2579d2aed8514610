import random
from datetime import UTC, datetime

from pyspark.sql import functions as F

from factloom.functions import windows
from factloom.functions.ids import entity_id
from factloom.functions.text import entity_key, grounded, mentions, normalized, question_predicates
from factloom.operators import chain, evaluation, graph, merge

FACT = "vid bigint, fact_id string, instance_id string, subject_vid bigint, subject_key string, predicate string, value_text string, value_type string, valid_from bigint, valid_to bigint, asserted_at bigint, session_id string, turn_idx int, role string, snippet string, confidence double, status string"


def day(y, m=1, d=1):
    return int(datetime(y, m, d, tzinfo=UTC).timestamp())


def facts(spark, rows):
    """rows: (vid, predicate, value, valid_from, asserted_at)"""
    return spark.createDataFrame([(v, f"f{v}", "i", 1, "person:user", p, x, "literal", vf, 0, a, "s", 0, "user", "", 1.0, "current") for v, p, x, vf, a in rows], FACT)


def test_ids(spark):
    import hashlib

    for key in ("person:user", "person:chloë", ""):
        want = int.from_bytes(hashlib.sha256(f"E:i|{key}".encode()).digest()[:8], "big") >> 4
        assert spark.range(1).select(entity_id(F.lit("i"), F.lit(key))).first()[0] == want


def test_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(normalized(F.lit("  Dr. Chloë  Strandwyn! "))) == "chloë strandwyn"
    assert one(entity_key(F.lit("person"), F.lit(" The User"))) == "person:user" and one(entity_key(F.lit("org"), F.lit("You"))) == "person:assistant"
    assert one(entity_key(F.lit("org"), F.lit("Acme, Inc."))) == "org:acme inc"
    assert one(mentions(F.lit("Did Maya Chen call me in March?"))) == ["maya chen", "person:user"]
    assert one(mentions(F.lit("Any tips? You said so."))) == []
    assert one(question_predicates(F.lit("Where do I work?"))) == ["employer"] and one(question_predicates(F.lit("my homework"))) == []
    assert one(grounded(F.lit("a  B"), F.lit("x a\nb y"))) and not one(grounded(F.lit(" "), F.lit("x"))) and not one(grounded(F.lit("q"), F.lit(None).cast("string")))


def test_windows(spark):
    asked = day(2024, 6, 15)
    cases = [
        ("Where did I work in 2019?", day(2019), day(2020)), ("What did I buy in March 2021?", day(2021, 3), day(2021, 4)), ("Where did I live in Dec 2020?", day(2020, 12), day(2021)), ("What was my job on 2021-07-04?", day(2021, 7, 4), day(2021, 7, 5)),
        ("Where did I work last year?", day(2023), day(2024)), ("What did I do two years ago?", day(2022), day(2023)), ("What was my budget last month?", day(2024, 5), day(2024, 6)), ("before 2021", 0, day(2021)), ("since 2021", day(2021), 0),
        ("6 months ago", day(2023, 12), day(2024)), ("two weeks ago", asked - 14 * 86400, asked - 7 * 86400), ("on 2021-02-31", None, None), ("2000 dollars", None, None), ("no date", None, None), (None, None, None), ("", None, None),
    ]
    df = spark.createDataFrame([(i, q, asked) for i, (q, _, _) in enumerate(cases)] + [(99, "last year", None)], "i int, question string, asked_at bigint")
    got = {r.i: (r.w_start, r.w_end) for r in windows.with_window(df).collect()}
    assert got == {i: (a, b) for i, (_, a, b) in enumerate(cases)} | {99: (None, None)}


def test_overlaps(spark):
    o = lambda a, b, s, e: spark.range(1).select(windows.overlaps(*[F.lit(x) for x in (a, b, s, e)])).first()[0]
    assert o(5, 0, 100, 200) and not o(5, 100, 100, 200) and not o(200, 0, 100, 200) and o(199, 0, 100, 200) and o(None, None, 1, 0)


def test_chain(spark):
    f = facts(spark, [(1, "employer", "Acme", 10, 1), (2, "employer", "Globex", 20, 2), (3, "employer", "Initech", 15, 3), (4, "likes", "jazz", 0, 1), (5, "likes", "tea", 0, 2), (6, "likes", " Jazz ", 0, 3), (7, "quantity", "three bikes", 0, 1), (8, "quantity", "four bikes", 0, 2), (9, "quantity", "17 cameras", 0, 3), (10, "quantity", "6", 0, 4)])
    s = {r.vid: (r.superseded_by, r.valid_to, r.status) for r in chain.superseded(f.repartition(3)).collect()}
    assert s[1] == (2, 20, "superseded") and s[2] == (3, 20, "superseded") and s[3] == (None, 0, "current")  # a revision dated back can't end before it begins
    assert s[4][0] == 6 and s[5][0] is None and s[7][0] == 8 and s[9][0] is None and s[10][0] is None
    assert {(r.src, r.dst) for r in chain.pairs(f).collect()} == {(2, 1), (3, 2), (6, 4), (8, 7)}


def test_history_and_since(spark):
    f = facts(spark, [(1, "employer", "Acme", 10, 1), (2, "employer", "acme ", 20, 2), (3, "employer", "Globex", 30, 3), (4, "employer", "Globex", 40, 4), (5, "employer", "Acme", 15, 9)])
    assert [(r.changed_at, r.vid) for r in chain.change_history(f).orderBy("changed_at").collect()] == [(10, 1), (30, 3)]
    assert chain.since_current(f).first().since == 30


def test_slots_of_null_and_empty(spark):
    f = facts(spark, [(1, "likes", None, None, None), (2, "likes", "", 5, 2)])
    assert {r.vid: r.superseded_by for r in chain.superseded(f).collect()} == {1: 2, 2: None}
    assert chain.superseded(spark.createDataFrame([], FACT)).count() == 0


def test_guarded_merge_against_a_loop(spark):
    r = random.Random(4)
    rows = [(r.randrange(5), r.choice([None, 1, 2, 3]), i, f"v{i}", f"c{i}") for i in range(80)]
    store = {}
    for k, g, at, v, c in rows:
        old = store.get(k)
        if old is None:
            store[k] = (g, v, c)
        elif g is not None and (old[0] is None or g > old[0]):
            store[k] = (g, v, old[2])
    df = spark.createDataFrame(rows, "k int, g int, at int, v string, c string").repartition(3)
    got = merge.guarded_merge(df, ["k"], F.col("g").cast("bigint"), F.col("at").cast("bigint"), ("c",))
    assert {r.k: (r.g, r.v, r.c) for r in got.collect()} == store


def test_links_need_their_ends(spark):
    import pytest

    nodes = spark.createDataFrame([(1,)], "vid bigint")
    edges = spark.createDataFrame([(1, 7), (1, 7)], "src bigint, rid bigint")
    assert merge.linked(edges, {"src": nodes}).count() == 1
    with pytest.raises(ValueError):
        merge.linked(spark.createDataFrame([(2, 7)], "src bigint, rid bigint"), {"src": nodes})


def test_date_hints(spark):
    said = day(2023, 4, 10)
    want = {"2023-04-15": day(2023, 4, 15), "2023/04/15": day(2023, 4, 15), "2023-04": day(2023, 4), "3/22/2021": day(2021, 3, 22), "3/22": day(2023, 3, 22), "12/25": day(2022, 12, 25), "2019": day(2019), None: said, "": said, "last summer": said, "13/45": said, "2023-99-99": said}
    df = spark.createDataFrame([(h, said) for h in want], "h string, said bigint")
    assert {r.h: r.v for r in df.select("h", graph.valid_from(df, "h", "said").alias("v")).collect()} == want


def test_aliases(spark):
    e = spark.createDataFrame([(1, "person:maya", "Maya", "person", "i"), (2, "person:maya chen", "Maya Chen", "person", "i"), (3, "org:maya", "Maya", "org", "i"), (4, "person:x", None, "person", "i"), (5, "org:farrow robotics ltd", "Farrow Robotics Ltd", "org", "i"), (6, "org:farrow robotcs ltd", "Farrow Robotcs Ltd", "org", "i")], "vid bigint, key string, name string, entity_type string, instance_id string")
    assert {(r.alias_key, r.canonical_key) for r in graph.alias_containment(e).collect()} == {("person:maya", "person:maya chen")}
    assert {(r.alias_key, r.canonical_key) for r in graph.alias_ratio(e).collect()} == {("org:farrow robotcs ltd", "org:farrow robotics ltd")}


def test_alias_ratio_against_all_pairs(spark):
    from difflib import SequenceMatcher

    r = random.Random(2)
    names = ["".join(r.choice("abcd ") for _ in range(r.randint(3, 40))).strip() or "a" for _ in range(40)]
    for n in list(names):
        for _ in range(3):
            i = r.randrange(len(n))
            names.append((n[:i] + r.choice(["", "x", n[i] * 2]) + n[i + 1 :]).strip() or "b")
    e = spark.createDataFrame([(i, f"k{i}", n, "org", "i") for i, n in enumerate(names)], "vid bigint, key string, name string, entity_type string, instance_id string")
    norm = {i: " ".join(n.split()) for i, n in enumerate(names)}
    want = {(f"k{i}", f"k{j}") for i, a in norm.items() for j, b in norm.items() if i != j and a and len(a) < len(b) and SequenceMatcher(None, a, b).ratio() > 0.92}
    assert {(r.alias_key, r.canonical_key) for r in graph.alias_ratio(e).collect()} == want


def test_fair_limit(spark):
    p = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 100), ("b", 101)], "sig string, n int")
    assert {(r.sig, r.n) for r in graph.fair_limit(p, "sig", "n", 5).collect()} == {("a", 0), ("b", 100), ("a", 1), ("b", 101), ("a", 2)}


def test_ranked_against_sorting(spark):
    r = random.Random(6)
    rows = [(r.choice("xyz"), r.choice([round(r.uniform(0, 5000), 1), 7.0, 7.0])) for _ in range(500)] + [("q", None), ("w", 1.5)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {x.k: (x.mid, x.p95) for x in evaluation.ranked(df, ["k"], "v", {"mid": F.floor(F.col("n") / 2), "p95": evaluation.nearest_index(0.95)}).collect()}
    for k in "xyzw":
        v = sorted(b for a, b in rows if a == k)
        assert got[k] == (v[len(v) // 2], v[min(len(v) - 1, int(len(v) * 0.95))])
    assert "q" not in got


def test_nearest_against_sorting(spark):
    from factloom.operators.retrieval import nearest

    r = random.Random(8)
    rows = [(i, [r.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(60)] + [(70, None), (71, []), (72, [1.0]), (None, [1.0] * 4)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    got = {}
    for x in nearest(v.where("vec_id % 20 = 0"), v, 5).collect():
        got.setdefault(x.query_id, {})[x.rank] = x.vec_id
    full = dict(rows[:60])
    for q in (0, 20, 40):
        best = sorted(full, key=lambda i: (-round(sum(a * b for a, b in zip(full[q], full[i], strict=True)), 9), i))[:5]
        assert [got[q][n] for n in range(1, 6)] == best
    assert nearest(v.where("false"), v).count() == 0


def walked(links):
    """The closure by chasing one key at a time. links: (alias, canonical)."""
    after = {}
    for a, c in links:
        after[a] = max(c, after.get(a, c))
    out = {}
    for a in after:
        key, seen = a, set()
        while key in after and key not in seen:
            seen.add(key)
            key = after[key]
        out[a] = key
    return out


def test_alias_closure_against_chasing(spark):
    chain_ = [(f"k{i:02}", f"k{i + 1:02}") for i in range(21)] + [("k03", "a"), ("t", "u"), ("u", "v"), ("v", "w"), ("w", "u"), ("x", "x")]
    got = graph.alias_closure(spark.createDataFrame([("i", *x) for x in chain_], "instance_id string, alias_key string, canonical_key string"))
    assert {r.alias_key: r.canonical_key for r in got.collect()} == walked(chain_)


def brute_aliases(rows):
    """instance -> closure over all pairs of names by containment or ratio. rows: (instance_id, kind, key, norm)."""
    from collections import defaultdict
    from difflib import SequenceMatcher

    groups, links = defaultdict(set), defaultdict(set)
    for i, kind, key, norm in rows:
        if i is not None and norm:
            groups[i, kind].add((key, norm))
    for (i, _), names in groups.items():
        for ka, a in names:
            for kb, b in names:
                if ka != kb and len(a) < len(b) and (set(a.split()) < set(b.split()) or SequenceMatcher(None, a, b).ratio() > 0.92):
                    links[i].add((ka, kb))
    return {(i, a): c for i, x in links.items() for a, c in walked(x).items()}


def test_alias_closure_against_all_pairs_of_the_tables(spark, data):
    from factloom.plans import graph as plans

    e = plans.entities(spark, data)
    want = brute_aliases([tuple(r) for r in e.select("instance_id", "entity_type", "key", normalized("name")).collect()])
    got = {(r.instance_id, r.alias_key): r.canonical_key for r in plans.alias_closure(spark, data).collect()}
    assert got == want and len(got) > 40


def test_cascade_against_the_closure_of_all_pairs(spark, data):
    from factloom.operators import gates
    from factloom.plans import graph as plans

    e, q, f = plans.entities(spark, data), plans.questions(spark, data), plans.stored(spark, data)
    closed = brute_aliases([tuple(r) for r in e.select("instance_id", "entity_type", "key", normalized("name")).collect()])
    aliases = spark.createDataFrame([(i, a, c) for (i, a), c in closed.items()], "instance_id string, alias_key string, canonical_key string")
    assert sorted(plans.gate_cascade(spark, data).collect()) == sorted(gates.cascade(q, e, f, aliases).drop("trace").collect())


def test_search_follows_a_misspelt_name(spark, tmp_path):
    from factloom.memory import Memory

    m = Memory(spark, str(tmp_path))
    e = spark.createDataFrame([(1, "person:theodra strandanova", "i|a", "Theodra Strandanova", "person", 0, 0, "i"), (2, "person:theodora strandanova", "i|b", "Theodora Strandanova", "person", 0, 0, "i")], "vid bigint, key string, skey string, name string, entity_type string, first_seen int, last_seen int, instance_id string")
    f = spark.createDataFrame([(7, "f7", "i", 2, "person:theodora strandanova", "occupation", "dentist", "literal", 1, 0, 1, "s", 0, "user", "", 1.0, "current")], FACT)
    m.add_rows(f, e)
    q = spark.createDataFrame([("i", "Who is Theodra Strandanova?", None)], "instance_id string, question string, asked_at bigint")
    assert m.search(q).first().resolved == "person:theodora strandanova"


def test_path_rows_against_walking(spark):
    r = random.Random(9)
    inc = {("i", f, f"e{x}") for f in range(60) for x in r.sample(range(9), r.choice([1, 2, 2]))} | {("j", 1, "e0"), ("j", 1, "e1")}
    pairs = [("i", f"e{x}", f"e{y}") for x in range(4) for y in range(x + 1, 4)] + [("j", "e0", "e1"), ("j", "e0", "e2")]
    of, at = {}, {}
    for i, f, e in inc:
        of.setdefault((i, e), set()).add(f)
        at.setdefault((i, f), set()).add(e)
    want = set()
    for i, a, b in pairs:
        for f in of.get((i, a), ()):
            for m in at[i, f] - {a}:
                if m == b:
                    want.add((i, (a, b), (f,)))
                else:
                    want |= {(i, (a, m, b), (f, g)) for g in of[i, m] - {f} if b in at[i, g]}
    p, n = spark.createDataFrame(pairs, "instance_id string, a string, b string"), spark.createDataFrame(sorted(inc), "instance_id string, fact int, entity string")
    rows = lambda k: {(x.instance_id, tuple(x.entities), tuple(x.facts)) for x in graph.path_rows(p, n, k).collect()}
    assert rows(10_000) == want and len(want) > 64
    fair, seen = [], {}
    for i, e, f in sorted(w for w in want if w[0] == "i"):
        seen[e] = seen.get(e, 0) + 1
        fair.append((seen[e], e, i, f))
    assert rows(20) == {(i, e, f) for _, e, i, f in sorted(fair)[:20]} | {w for w in want if w[0] == "j"}
