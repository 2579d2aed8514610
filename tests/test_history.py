import random

from pyspark.sql import functions as F

from factloom.operators import history

U = "subject_vid bigint, predicate string, value_text string, valid_from bigint, valid_to bigint, asserted_at bigint, received_at bigint, log_id bigint, month bigint"


def brute(rows):
    slots = {}
    for r in rows:
        s, p, v, vf, vt, a, rec, log = r[:8]
        start = vf if vf is not None else a
        if s is None or p is None or start is None:
            continue
        rank = (a if a is not None else -(2**62), rec, log)
        key = (s, p)
        old = slots.setdefault(key, {}).get(start)
        if old is None or rank > old[0]:
            slots[key][start] = (rank, vt or 0, "".join((v if v is not None else "\0").split()).lower())
    out = set()
    for key, starts in slots.items():
        order = sorted(starts)
        runs = []
        for i, s in enumerate(order):
            _, vt, v = starts[s]
            e = min([x for x in (vt or None, order[i + 1] if i + 1 < len(order) else None) if x is not None], default=None)
            if e is not None and e <= s:
                continue
            if runs and runs[-1][1] == s and runs[-1][2] == v:
                runs[-1][1] = e
            else:
                runs.append([s, e, v])
        out |= {(*key, s, e or 0) for s, e, _ in runs}
    return out


def made(n, seed, slots=4):
    r = random.Random(seed)
    return [(r.choice([*range(slots), None]), r.choice(["age", "name"]), r.choice(["Acme", " acme", "A cme", "Globex", None]), r.choice([None, *range(0, 20_000_000, 700_000)]), r.choice([0, 0, 0, 3_000_000, 9_000_000, None]), r.choice([None, *range(0, 20_000_000, 900_000)]), r.randrange(5), i, 7) for i in range(n)]


def got(df):
    rows = [(r.subject_vid, r.predicate, r.valid_from, r.valid_to) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def whole(spark, rows, most=history.HOT):
    return got(history.versions(history.merge(None, history.standing(spark.createDataFrame(rows, U)), most), most))


def test_against_brute_force(spark):
    for seed in range(3):
        rows = made(400, seed)
        assert whole(spark, rows) == brute(rows)
    assert whole(spark, rows, most=20) == whole(spark, rows, most=1) == brute(rows)  # some slots or all take the way of hot ones


def test_batches_in_any_order_give_the_same_history(spark):
    rows = made(200, 9)
    random.Random(1).shuffle(rows)
    dimension, verdicts = None, set()
    for part in (rows[:80], rows[80:81], rows[81:], rows[:50], []):
        dimension = history.written(history.merge(dimension, history.standing(spark.createDataFrame(part, U)), most=30), "history")
        verdicts |= {r.verdict for r in dimension.select("verdict").distinct().collect()}
    assert got(history.versions(dimension)) == brute(rows) and verdicts == {"new", "changed", "restated", "kept"}


def test_a_version_is_closed_and_opened_by_hash(spark):
    u = lambda *rows: history.standing(spark.createDataFrame([(1, "age", v, s, 0, s, 0, i, 0) for i, (v, s) in enumerate(rows)], U))
    d = history.written(history.merge(None, u(("a", 10))), "history")
    d = history.written(history.merge(d, u(("A ", 20), ("b", 30))), "history")
    assert [(r.start_at, r.until, r.opens) for r in d.orderBy("start_at").collect()] == [(10, 20, True), (20, 30, False), (30, None, True)]
    d = history.merge(d, u(("c", 15)))  # late: it splits the first version
    assert got(history.versions(d)) == {(1, "age", 10, 15), (1, "age", 15, 20), (1, "age", 20, 30), (1, "age", 30, 0)}


def test_a_log_in_batches(spark):
    rows = made(300, 4)
    facts = spark.createDataFrame(rows, U).withColumn("received_at", F.timestamp_seconds("received_at"))
    canon = spark.createDataFrame([("age", True), ("name", True), ("likes", False)], "predicate string, single_valued boolean")
    for batches in (1, 3):
        assert {tuple(r) for r in history.fact_versions(facts, canon, batches).collect()} == brute(rows)
    assert history.fact_versions(facts.limit(0), canon).count() == 0


def test_one_hot_slot_and_repeats(spark):
    rows = [(1, "age", "a" if i // 3 % 2 else "b", i * 50_000, 0, i, 0, i, 0) for i in range(500)] * 3
    for most in (100, 10_000):
        assert whole(spark, rows, most) == brute(rows)


def test_empty(spark):
    assert whole(spark, []) == set()
