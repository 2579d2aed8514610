"""Operators on whole tables: canonical values, names, leaks."""

import random

import pytest

from factloom.llm import canonical, leakage, names, queries
from tests.conftest import compare, variants

CANON = "predicate string, gloss string, single_valued boolean"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, data, name):
    compare(spark, name, queries.QUERIES[name], queries.ORACLE[name], data)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


@pytest.fixture(scope="module")
def odd(spark, data, tmp_path_factory):
    return variants(spark, data, str(tmp_path_factory.mktemp("odd")))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_nulls_and_repeats(spark, odd, name):
    """Null rows give nothing but an empty list of tokens, an untouched text, and an entity without class."""
    for kind in ("empty", "nulls"):
        rows = queries.QUERIES[name](spark, f"{odd}/{kind}").collect()
        assert rows == [] or kind == "nulls" and name in ("p6_redacted", "p7_ids"), kind
    assert queries.QUERIES[name](spark, f"{odd}/twice").count() >= 0


def test_canonical(spark):
    canon = spark.createDataFrame([(p, "", True) for p in ("age", "job_title", "dislikes", "likes", "allergic_to", "lives_in", "other")], CANON)
    want = {"jobTitle": "job_title", "JB TITLE": "job_title", "dislies": "dislikes", '"likes"': "likes", "has_allergic to": "allergic_to", "alelrgci to": "allergic_to", "lives ins": "lives_in", "hates": "dislikes", "stage": "other", "???": "other", "x" * 5000: "other", "cannot_stand": "dislikes", "shoe size": "other"}
    skip = [None, "", "  ", "age", "likes"]
    rows = [(i, p, "clash") for i, p in enumerate([*want, *skip, *want])]
    got = {r.extract_id: r.predicate for r in canonical.canonical(spark.createDataFrame(rows, "extract_id bigint, predicate string, value string"), canon).collect()}
    assert got == {i: want[p] for i, p, _ in rows if p in want}
    assert canonical.canonical(spark.createDataFrame([], "extract_id bigint, predicate string"), canon).count() == 0


def test_references_come_from_glosses_too(spark, data):
    canon = spark.read.parquet(f"{data}/canon_predicates.parquet")
    long = "a very long entry of a reference list that nobody would ever type in full without a slip"
    canon = canon.unionByName(spark.createDataFrame([(long, "", False)], CANON))
    # Spellings that stand neither in the thesaurus nor in the tables.
    want = {"organisation that employs the subject": "employer", "Organisaton employs": "employer", "place travelled to": "visited", "electronic mail adress": "email", "number telephone": "other", "title held at work": "job_title", "money_set_aside_for_spending": "budget",
            "tool or service": "other", "is married to": "family_relation", "isMarriedTo": "family_relation", "Proficient in": "skill", "commenced": "started", long.replace("nobody", "nobdy").upper(): long, "x" + long * 2: "other"}
    facts = spark.createDataFrame(list(enumerate(want)), "extract_id bigint, predicate string")
    got = {r.extract_id: r.predicate for r in canonical.canonical(facts, canon).collect()}
    assert {v: got[i] for i, v in enumerate(want)} == want
    said = {r.ref for r in canonical.references(canon).collect()}
    assert "dateofbirth" in said and len(said) > 200


def test_pigeonhole_against_all_pairs(spark):
    r = random.Random(3)
    canon = spark.createDataFrame([(p, "", True) for p in canonical.SYNONYMS], CANON)
    refs = {(x.ref, x.k) for x in canonical.references(canon).collect()}

    def edited(s, n):
        for _ in range(n):
            i = r.randrange(len(s))
            s = s[:i] + r.choice(["", "x", s[i] + "y", s[i] * 2]) + s[i + 1 :] or "q"
        return s

    values = {edited(ref, r.randint(0, 5)) for ref, _ in refs for _ in range(3)}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    got = {x.value: x.edits for x in canonical.matched(spark.createDataFrame([(v,) for v in values], "value string"), canon).collect()}
    for v in values:
        best = min((d for ref, k in refs for f in {v, v.removesuffix("s")} if f and (d := distance(f, ref)) <= k), default=None)
        assert got.get(v) == best, v


ENT = "vid bigint, name string, entity_type string, instance_id string, key string"


def linked(spark, groups):
    rows, want, vid = [], set(), 0
    for kind, group in groups:
        vids = []
        for n in group:
            rows.append((vid, n, kind, "i", "k"))
            vids.append(vid)
            vid += 1
        want |= {(a, b) for a in vids for b in vids if a < b}
    got = {(r.vid_a, r.vid_b) for r in names.linked(spark.createDataFrame(rows, ENT)).collect()}
    assert got == want, ({(rows[a][1], rows[b][1]) for a, b in got ^ want})


def test_names(spark):
    linked(spark, [
        ("person", ["Frederica Quellishel", "F Quellishel", "Frderica Quellishel", "Fred. Quellishel", "Quellishel, Frederica", "Frederica  QUELLISHEL"]), ("person", ["Beatrice Quellishel"]),
        ("person", ["Jonathan Oswere", "Jonny Oswere", "JonathanOswere", "Oswere, J.", "Jonathan"]), ("person", ["Özlem Vantishel", "Özlemm Vantisel", "Ozlem Vantishel", "Ö Vantishel", "Özlem K. Vantishel"]),
        ("person", ["Edward Dunnishel", "Edwqrd Dubnishel"]), ("person", ["Mei-Ling Larretti", "Mei Larretti", "Mei Ling Larretti"]),
        ("org", ["Farrow Language School", "FLS", "F.L.S.", "Language School Farrow", "Farrow-Language School GmbH", "The Farrow Languuage School", "FarrowLanguageSchool"]), ("org", ["Farrow Robotics LLC", "Farrow Robo.", "Farrow Robotcs"]), ("org", ["Farrow Data Works"]),
        ("place", ["Valdoro"]), ("place", ["Valdoro"][:0]), ("person", [None]), ("person", ["user"]), ("person", ["  "]),
    ])


def test_an_initial_that_fits_two_is_tied_to_none(spark):
    linked(spark, [("person", ["Jonathan Oswere"]), ("person", ["Julia Oswere"]), ("person", ["J. Oswere"])])


def test_names_of_other_tenants_and_empty(spark):
    e = spark.createDataFrame([(1, "Anna Berg", "person", "a", "k"), (2, "Anna Berg", "person", "b", "k"), (3, "Anna Berg", "org", "a", "k"), (4, "Anna Berg", "person", None, "k")], ENT)
    assert names.linked(e).count() == 0 and names.linked(spark.createDataFrame([], ENT)).count() == 0


def test_few_jobs_whatever_the_names(spark, data):
    """The driver holds the plans, stages and metrics of all jobs: of loops of joins, some tens."""
    spark.sparkContext.setJobGroup("names", "names")
    try:
        names.p5_found(spark, data).write.format("noop").mode("overwrite").save()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("names")) <= 10


@pytest.mark.parametrize("most", [0, 2, 5])
def test_names_by_joins_are_those_of_one_task(spark, data, monkeypatch, most):
    """Instances of more rows than one task takes have the same clusters, links and pairs."""
    e = spark.read.parquet(f"{data}/entities.parquet")
    e = e.unionByName(e.selectExpr("vid + 1 as vid", "* except (vid)").where("vid % 3 = 0"))
    got = [sorted(map(tuple, f(e).collect())) for f in (names.clusters, names.linked)]
    monkeypatch.setattr(names, "GROUP", most)
    assert got == [sorted(map(tuple, f(e).collect())) for f in (names.clusters, names.linked)] and got[0] and got[1]


def test_leaks_against_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"word{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randint(11, 90)), "clash") for i in range(30)] + [(98, None, ""), (99, "", "")]
    docs = [(0, None, ""), (1, "", ""), (2, "a b c", "")]
    for d in range(3, 150):
        words = text(r.randint(12, 200)).split()
        if d % 3 == 0:
            w = items[d % 30][1].split()
            n = r.choice([10, 11, 12, 13, 20])
            at = r.randrange(max(len(w) - n, 0) + 1)
            cut = [x.upper() if r.random() < 0.5 else f"_{x}_," for x in w[at : at + n]]
            p = r.randrange(len(words) + 1)
            words = words[:p] + cut + words[p:]
        docs.append((d, (" " if d % 2 else "\n").join(words), ""))
    docs += [(1000 + d, t, "") for d, t, _ in docs[3:40]]
    grams = lambda t: {tuple(w[i : i + 12]) for w in [leakage.words(t)] for i in range(len(w) - 11)}
    want = {(d, i) for d, t, _ in docs for i, x, _ in items if grams(t) & grams(x)}
    got = leakage.verbatim(spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string, doc_id string")).collect()
    assert len(want) > 30 and len(got) == len({tuple(g) for g in got}) and {tuple(g) for g in got} == want


def test_runs_of_exactly_12_words_among_words_of_other_topics(spark):
    r = random.Random(5)
    topic = lambda t, n: [f"{t}{r.randrange(40)}" for _ in range(n)]
    rare = iter(f"r{i}" for i in range(100_000))
    items, docs, want = [], [], set()
    for i in range(40):
        run = [next(rare) for _ in range(12)]
        items.append((i, " ".join([*topic("a", 20), *run, *topic("a", 20)])))
        docs.append((i, " ".join([*topic("b", 30 + i % 12), *run, *topic("b", 30)])))
        docs.append((1000 + i, " ".join([*topic("b", 30), *run[:11], *topic("b", 30)])))
        want.add((i, i))
    docs += [(5000 + i, " ".join(topic("abcd"[i % 4], 200))) for i in range(400)]
    d, x = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted((g.doc_id, g.item_id) for g in leakage.verbatim(d, x).collect()) == sorted(want)
    leaks = leakage.reported(d, x).where("kind = 'verbatim'").collect()
    assert {(g.doc_id, g.item_id) for g in leaks} == want and sum(g.cosine is None for g in leaks) > 5  # these the cosine alone would lose


def test_words_and_runs():
    import numpy as np

    assert leakage.words("Na​ïve café, ＡＢ-c_d Straße") == ["naïve", "café", "ab", "c", "d", "strasse"] and leakage.words(None) == []
    a = np.arange(40)
    assert leakage.common_subsequence(a[::2], a) == 20
    n, counts = leakage.counted(np.array([3, 1, 3, 3]))
    assert n.tolist() == [1, 3] and counts.tolist() == [1, 3] and leakage.counted(np.zeros(0, int))[0].tolist() == []


def test_runs_of_equal_hash_are_compared_word_by_word():
    import numpy as np

    x, y = "a b c d e f g h i j k l", "m n o p q r s t u v w x"
    it = leakage.Items([(1, x), (2, y), (3, f"{x} {y}")], np.ones(leakage.FEATURES, np.float32), np.zeros((leakage.FEATURES, 2), np.float32))
    texts = [leakage.WordIds().of(t) for t in (f"z z {x} z", y, f"{x[:-2]} {y}", "q " * 30, f"{x} {y}")]
    assert it.verbatim(texts) == {(0, 0), (0, 2), (1, 1), (1, 2), (2, 1), (2, 2), (4, 0), (4, 1), (4, 2)}
    it.all[:] = 0  # as if every hash had met by chance
    assert it.verbatim(texts) == set()


def paraphrased(r, words, synonyms):
    """words with a tenth of them replaced, some left out, some neighbours swapped."""
    out = []
    for w in words:
        x = r.random()
        out += [synonyms[w]] if x < 0.10 else [] if x < 0.14 else [w, r.choice(["also", "then", "quite"])] if x < 0.17 else [w]
    for i in range(0, len(out) - 1, 9):
        out[i], out[i + 1] = out[i + 1], out[i]
    return out


def test_planted_paraphrases(spark):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    synonyms = {w: f"s{w}" for w in vocabulary}
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, text(r.randint(40, 70))) for i in range(60)]
    docs = [(i, [*text(r.randint(20, 60)), *paraphrased(r, w, synonyms), *text(r.randint(20, 60))]) for i, w in items] + [(1000 + i, text(150)) for i in range(900)]
    got = leakage.reported(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")).collect()
    right = {(g.doc_id, g.item_id) for g in got if g.doc_id == g.item_id}
    assert len(right) >= 54 and all(g.doc_id == g.item_id for g in got), len(right)  # nine tenths


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK", 4)
    x = [(i, " ".join(f"i{i}w{k}" for k in range(14))) for i in range(11)]
    d = spark.createDataFrame([(i, f"head {t} tail") for i, t in x], "doc_id bigint, text string")
    assert {tuple(g) for g in leakage.verbatim(d, spark.createDataFrame(x, "item_id bigint, text string")).collect()} == {(i, i) for i in range(11)}


def test_no_leaks_without_items_or_documents(spark):
    d, i = spark.createDataFrame([(1, "word " * 40)], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    assert leakage.verbatim(d, i).count() == 0
    assert leakage.verbatim(spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "w " * 20)], "item_id bigint, text string")).count() == 0
