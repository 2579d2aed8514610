import os
import random
from datetime import UTC, datetime, timedelta

from factloom.streaming import delivery

R = "delivery_id bigint, batch_no int, received_at timestamp, run_id string, arm string, instance_id string, extra string"
T0 = datetime(2024, 1, 1, tzinfo=UTC)


def made(n, seed):
    r = random.Random(seed)
    rows = [(i, 0, r.choice([T0 + timedelta(hours=r.randrange(900)), None]) if r.random() < 0.1 else T0 + timedelta(hours=r.randrange(900)), r.choice(["r1", None]), r.choice(["a", "b"]), r.choice(["x1", "X1 ", " x1", "y", None, "z"]), "e") for i in range(n)]
    return rows + rows[:3]


def brute(rows):
    keep = {}
    for d, _, at, run, arm, inst, _ in rows:
        k = (run, arm, None if inst is None else inst.strip().lower())
        rank = (at is None, at or T0, d)
        keep[k] = min(keep.get(k, rank), rank)
    return {d for d, _, at, run, arm, inst, _ in rows if (at is None, at or T0, d) != keep[(run, arm, None if inst is None else inst.strip().lower())]}


def parts(spark, rows, folder, n):
    for i in range(n):
        spark.createDataFrame(rows[i::n], R).coalesce(1).write.mode("append").parquet(folder)


def test_one_batch_and_many_agree_in_any_order(spark, tmp_path):
    rows = made(300, 3)
    random.Random(5).shuffle(rows)
    parts(spark, rows, f"{tmp_path}/r.parquet", 5)
    want = brute(rows)
    for files, horizon in ((1000, 7 * 86400), (1, 3600), (2, 0)):
        got = [r[0] for r in delivery.dropped_deliveries(spark, f"{tmp_path}/r.parquet", horizon, files).collect()]
        assert len(got) == len(set(got)) and set(got) == want, (files, horizon)


def test_goes_on_from_where_it_ended(spark, tmp_path):
    rows, folder, root = made(200, 8), f"{tmp_path}/r.parquet", f"{tmp_path}/state"
    parts(spark, rows[:100], folder, 2)
    delivery.dropped_deliveries(spark, folder, 3600, 1, root).count()
    parts(spark, rows[100:], folder, 2)
    assert {r[0] for r in delivery.dropped_deliveries(spark, folder, 3600, 1, root).collect()} == brute(rows)


def test_a_batch_that_failed_before_its_commit_is_run_again(spark, tmp_path):
    rows, folder, root = made(120, 2), f"{tmp_path}/r.parquet", f"{tmp_path}/s"
    parts(spark, rows, folder, 3)
    assert {r[0] for r in delivery.dropped_deliveries(spark, folder, 3600, 1, root).collect()} == brute(rows)
    last = delivery.committed(spark, root)[-1]
    for f in os.listdir(f"{root}/checkpoint/commits"):
        if str(last) in f:
            os.remove(f"{root}/checkpoint/commits/{f}")
    spark.createDataFrame([(10**6,)], delivery.DROPPED).write.mode("append").parquet(f"{root}/late/{last}")  # half-written results
    assert {r[0] for r in delivery.dropped_deliveries(spark, folder, 3600, 1, root).collect()} == brute(rows)
    assert {r[0] for r in delivery.dropped_deliveries(spark, folder, 3600, 1, root).collect()} == brute(rows)  # nothing is left to do


def test_expiry_and_copies_later_than_the_horizon(spark, tmp_path):
    folder, root = f"{tmp_path}/r.parquet", f"{tmp_path}/s"
    at = lambda h: T0 + timedelta(hours=h)
    rows = [[(1, 0, at(0), "r", "a", "x", ""), (2, 0, at(1), "r", "a", "y", "")], [(3, 1, at(100), "r", "a", "z", "")], [(4, 2, at(2), "r", "a", "x", ""), (5, 2, at(0.5), "r", "a", "y", ""), (6, 2, at(200), "r", "a", "X ", "")], [(7, 3, at(400), "r", "a", "w", "")]]
    for part in rows:
        spark.createDataFrame(part, R).coalesce(1).write.mode("append").parquet(folder)
        got = {r[0] for r in delivery.dropped_deliveries(spark, folder, 3600, 1, root).collect()}
    assert got == {4, 6, 2}  # 5 was received before 2, which had expired when 5 came
    late = [n for n in delivery.committed(spark, root) if spark.read.schema(delivery.DROPPED).parquet(f"{root}/late/{n}").count()]
    gone = [n for n in delivery.committed(spark, root) if os.path.exists(f"{root}/events/{n}/kind=gone")]
    assert late and gone


def test_one_message_with_most_rows(spark, tmp_path):
    rows = [(i, 0, T0 + timedelta(seconds=(i * 37) % 5000), "r", "a", "hot", "") for i in range(3000)] + made(100, 6)[:0]
    parts(spark, rows, f"{tmp_path}/r.parquet", 2)
    got = [r[0] for r in delivery.dropped_deliveries(spark, f"{tmp_path}/r.parquet", 3600, 1).collect()]
    assert len(got) == 2999 and set(got) == brute(rows)


def test_file_and_empty(spark, tmp_path):
    spark.createDataFrame([], R).coalesce(1).write.parquet(f"{tmp_path}/e.parquet")
    assert delivery.dropped_deliveries(spark, f"{tmp_path}/e.parquet").count() == 0
