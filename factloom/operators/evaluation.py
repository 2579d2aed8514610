"""Scores, costs and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import vocab
from factloom.operators.merge import last_wins


def rate(hit: Column, total: Column) -> Column:
    """A ratio to four places, half to even; null where there is nothing to divide by."""
    return F.when(total > 0, F.bround(hit.cast("double") / total, 4))


def count_if(c: Column) -> Column:
    return F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))


def ranked(rows: DataFrame, keys: list[str], value: str, positions: dict[str, Column], width: float = 64.0) -> DataFrame:
    """Exact order statistics: for each group, the value at each 0-based position (an expression over n).

    Buckets of values are counted first; only the bucket that holds a position is ordered, by distinct values with their counts.
    No group is gathered or sorted whole.
    """
    v = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c")).withColumn("b", F.floor(F.col("v") / width))
    b = v.groupBy(*keys, "b").agg(F.sum("c").alias("bc"))
    over = Window.partitionBy(*keys).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("before", F.coalesce(F.sum("bc").over(over), F.lit(0))).withColumn("n", F.sum("bc").over(Window.partitionBy(*keys)))
    want = b.select(*keys, "b", "bc", "before", F.inline(F.array(*[F.struct(F.lit(name).alias("stat"), at.cast("bigint").alias("at")) for name, at in positions.items()]))).where("at >= before and at < before + bc")
    inner = Window.partitionBy(*keys, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn("lo", F.coalesce(F.sum("c").over(inner), F.lit(0)))
    on = [*keys, "b"]
    hit = v.join(want, on).where((F.col("at") >= F.col("before") + F.col("lo")) & (F.col("at") < F.col("before") + F.col("lo") + F.col("c")))
    return hit.groupBy(*keys).agg(*[F.max(F.when(F.col("stat") == name, F.col("v"))).alias(name) for name in positions])


N = F.col


def nearest_index(fraction: float) -> Column:
    """min(n - 1, floor(n * fraction))."""
    return F.least(F.col("n") - 1, F.floor(F.col("n") * fraction))


#: Tokens of a prompt from which another reader has to take it, where a table of results doesn't say.
CEILING = 600


def scored(results: DataFrame, instances: DataFrame, judged: DataFrame | None = None, ceiling: int = CEILING) -> DataFrame:
    """One row per (run, arm, question), the last delivery's, with category, gold and whether it is correct.

    An unanswerable question is right if abstained from. An answerable one is wrong if abstained from, else as judged says
    (instance_id, arm, verdict), or, without one, if the answer holds the gold text. Columns appealed, appeal_won and overflow are
    taken from results where they are; overflow else is a prompt of an arm that shows everything beyond the ceiling.
    """
    r = results.withColumn("instance_id", F.lower(F.trim(F.regexp_replace("instance_id", r"\s+", " "))))
    r = last_wins(r.where("arm is not null and instance_id is not null").select("run_id", "arm", "instance_id", "answer", "abstained", "reason", "fact_count", "round_trips", "latency_ms", "received_at", "delivery_id", *[c for c in ("appealed", "appeal_won", "overflow") if c in results.columns]), ["run_id", "arm", "instance_id"], F.struct("received_at", "delivery_id"))
    i = instances.select(F.col("instance_id"), F.col("question_type").alias("category"), F.col("is_abstention").alias("gold_abstention"), F.coalesce("answer", F.lit("")).alias("gold"))
    j = r.join(i, "instance_id")
    text, gold = F.lower(F.coalesce("answer", F.lit(""))), F.lower("gold")
    holds = (gold != "") & F.contains(text, gold)
    if judged is not None:
        j = j.join(judged.groupBy("instance_id", "arm").agg(F.max("verdict").alias("verdict")), ["instance_id", "arm"], "left")
        holds = F.coalesce(F.col("verdict"), holds)
    right = F.when(F.col("gold_abstention"), F.col("abstained")).when(F.col("abstained"), F.lit(False)).otherwise(holds)
    prompt = (F.col("fact_count") * 20).cast("bigint")
    flag = lambda c, other: F.coalesce(F.col(c), F.lit(False)).alias(c) if c in j.columns else other.alias(c)
    flags = [flag("appealed", F.lit(False)), flag("appeal_won", F.lit(False)), flag("overflow", F.coalesce((F.col("arm") == "full_context") & (prompt > ceiling), F.lit(False)))]
    # The log has no token counts: prompts are counted by facts, completions by letters.
    return j.select("run_id", "arm", "instance_id", "category", "gold_abstention", "abstained", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce(right, F.lit(False)).alias("correct"), prompt.alias("prompt_tokens"), F.floor(F.length(F.coalesce("answer", F.lit(""))) / 4).cast("bigint").alias("completion_tokens"), "round_trips", "latency_ms", *flags)


def with_all(rows: DataFrame) -> DataFrame:
    """Each row under its category and under ALL."""
    return rows.withColumn("category", F.explode(F.array(F.coalesce("category", F.lit("")), F.lit("ALL"))))


def summary(rows: DataFrame) -> DataFrame:
    r = with_all(rows)
    gold, said, ok = F.col("gold_abstention"), F.col("abstained"), F.col("correct")
    s = r.groupBy("arm", "category").agg(
        F.count("*").alias("n"), count_if(gold).alias("n_gold_abstention"), count_if(ok).alias("_ok"), count_if(ok & ~gold).alias("_ok_answerable"), count_if(~gold).alias("_answerable"),
        count_if(~said).alias("_answered"), count_if(ok & ~said).alias("_ok_answered"), count_if(said & gold).alias("_true_abstained"), count_if(said).alias("_abstained"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("_tokens"), F.sum("round_trips").alias("_trips"),
        count_if(F.col("appealed")).alias("appeals"), count_if(F.col("appeal_won")).alias("appeals_won"), count_if(F.col("overflow")).alias("overflow"),
    )
    m = ranked(r, ["arm", "category"], "latency_ms", {"median_latency_ms": F.floor(F.col("n") / 2)})
    return s.join(m, ["arm", "category"], "left").select(
        "arm", "category", "n", "n_gold_abstention", rate(N("_ok"), N("n")).alias("accuracy"), rate(N("_ok_answerable"), N("_answerable")).alias("answerable_accuracy"), rate(N("_answered"), N("n")).alias("coverage"),
        rate(N("_ok_answered"), N("_answered")).alias("selective_accuracy"), rate(N("_true_abstained"), N("_abstained")).alias("abstain_precision"), rate(N("_true_abstained"), N("n_gold_abstention")).alias("abstain_recall"),
        F.bround(N("_tokens").cast("double") / N("n")).cast("bigint").alias("tokens_per_q"), F.bround(N("_trips").cast("double") / N("n"), 2).alias("round_trips_per_q"), "median_latency_ms", "appeals", "appeals_won", "overflow",
    )


def reasons(rows: DataFrame) -> DataFrame:
    """Per (arm, category) a row for every registered reason, zeros kept, and for any other that occurs; arms without gates have one row."""
    r = with_all(rows)
    spark = rows.sparkSession
    per = r.groupBy("arm", "category").agg(F.count("*").alias("n"), count_if(F.col("abstained")).alias("n_abstained"))
    hit = r.where("abstained").groupBy("arm", "category", "reason").agg(F.count("*").alias("count"), count_if(~F.col("gold_abstention")).alias("count_false"))
    gated = ~F.col("arm").isin(vocab.UNGATED_ARMS)
    known = spark.createDataFrame([(x,) for x in vocab.REASONS], "reason string")
    grid = per.where(gated).select("arm", "category").crossJoin(F.broadcast(known))  # eight fixed reasons
    grid = grid.unionByName(hit.where(gated).select("arm", "category", "reason")).distinct()
    out = grid.join(per, ["arm", "category"]).join(hit, ["arm", "category", "reason"], "left")
    none = per.where(~gated).withColumn("reason", F.lit("")).join(hit, ["arm", "category", "reason"], "left").withColumn("reason", F.lit(vocab.NO_GATES))
    cols = ["arm", "category", "n", "n_abstained", "reason", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("count_false", F.lit(0)).alias("count_false")]
    return out.select(cols).unionByName(none.select(cols))


def _unpivot(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])))


def query_cost(rows: DataFrame) -> DataFrame:
    """arm, metric, value: per-question cost of each arm, its tail, and how many questions cost each number of reads."""
    g = rows.groupBy("arm").agg(F.count("*").alias("questions"), F.sum("prompt_tokens").alias("_p"), F.sum("completion_tokens").alias("_c"), F.sum("round_trips").alias("_t"))
    o = ranked(rows, ["arm"], "latency_ms", {"_lo": F.floor((F.col("n") - 1) / 2), "_hi": F.floor(F.col("n") / 2), "_p95": nearest_index(0.95)})
    n = N("questions")
    g = g.join(o, "arm", "left").withColumns({
        "prompt_tokens_per_question": F.bround(N("_p").cast("double") / n), "completion_tokens_per_question": F.bround(N("_c").cast("double") / n), "tokens_per_question": F.bround((N("_p") + N("_c")).cast("double") / n),
        "median_latency": F.bround((N("_lo") + N("_hi")) / 2), "p95_latency": F.bround("_p95"), "round_trips_per_question": F.bround(N("_t").cast("double") / n, 2),
    })
    base = _unpivot(g, ["arm"], ["questions", "prompt_tokens_per_question", "completion_tokens_per_question", "tokens_per_question", "median_latency", "p95_latency", "round_trips_per_question"])
    trips = rows.groupBy("arm", "round_trips").agg(F.count("*").alias("c")).select("arm", F.concat(F.lit("questions_costing_"), F.col("round_trips").cast("string"), F.lit("_round_trips")).alias("metric"), F.col("c").cast("double").alias("value"))
    return base.unionByName(trips)


def ingest_cost(ledger: DataFrame) -> DataFrame:
    """metric, value over a ledger (instance_id, sessions, facts, prompt_tokens, completion_tokens, round_trips, latency_ms, parse_failures), last row of an instance."""
    one = lambda c: F.greatest(F.coalesce(F.sum(c), F.lit(0)), F.lit(1))
    g = ledger.agg(F.count("*").alias("instances_ingested"), one("sessions").alias("sessions_ingested"), one("facts").alias("facts_written"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("_t"), F.sum("round_trips").alias("_r"), F.sum("latency_ms").alias("_l"), F.sum("parse_failures").alias("parse_failures"))
    f = N("facts_written")
    g = g.withColumns({"facts_per_session": F.bround(f.cast("double") / N("sessions_ingested"), 2), "extraction_tokens_per_fact": F.bround(N("_t").cast("double") / f), "round_trips_per_fact": F.bround(N("_r").cast("double") / f, 3), "latency_per_fact": F.bround(N("_l").cast("double") / f, 1)})
    cols = ["instances_ingested", "sessions_ingested", "facts_written", "facts_per_session", "extraction_tokens_per_fact", "round_trips_per_fact", "latency_per_fact", "parse_failures"]
    return _unpivot(g, [], cols).where("metric = 'instances_ingested' or value is not null")


def go_no_go(s: DataFrame, base: str = "full_context", update: str = "knowledge-update") -> DataFrame:
    """arm, won, verdict of each gated arm against the base: GO if two of three metrics are larger."""
    cell = lambda cat, c: F.coalesce(F.max(F.when(F.col("category") == cat, F.col(c))), F.lit(0.0))
    p = s.groupBy("arm").agg(cell("ALL", "abstain_recall").alias("r"), cell("ALL", "abstain_precision").alias("p"), cell(update, "accuracy").alias("u"))
    b = p.where(F.col("arm") == base).select(F.col("r").alias("br"), F.col("p").alias("bp"), F.col("u").alias("bu"))
    j = p.where(~F.col("arm").isin(vocab.UNGATED_ARMS)).crossJoin(F.broadcast(b))  # one row
    won = sum((F.col(x) > F.col(f"b{x}")).cast("int") for x in "rpu")
    return j.select("arm", won.alias("won"), F.when(won >= 2, "GO").otherwise("NO-GO").alias("verdict"))


def stratified(instances: DataFrame, per_type: int = vocab.PER_TYPE, seed: int = 11) -> DataFrame:
    """All unanswerable questions and, of each type, the per_type answerable ones of the smallest hashes of seed and id.

    A hash order stands in for a generator's draw: it is the same in any engine and at any partitioning. Only per_type rows of a
    type leave a partition bucket before they are compared.
    """
    i = instances.select("instance_id", "question_type", "is_abstention").where("instance_id is not null")
    i = i.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}|"), "instance_id"), 256))
    few = i.where(~F.col("is_abstention")).withColumn("b", F.substring("h", 64, 1))
    for keys in (["question_type", "b"], ["question_type"]):
        few = few.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "instance_id"))).where(F.col("rn") <= per_type)
    return i.where("is_abstention").select("instance_id", "question_type", "is_abstention").unionByName(few.select("instance_id", "question_type", "is_abstention"))


def spread_sample(instances: DataFrame, count: int) -> DataFrame:
    """Every max(1, n div count)-th instance by id, the first count of them (a sampling operator).

    Positions are found without a global sort in one task: ids are counted by ranges first, whose bounds are 63 quantiles of the
    ids that a bounded sample of them (those of the smallest hashes) has, so that ids with a common beginning are spread too.
    """
    i = instances.select("instance_id").where("instance_id is not null")
    some = [r[0] for r in i.withColumn("h", F.xxhash64("instance_id")).orderBy("h", "instance_id").limit(6400).select("instance_id").collect()]
    bounds = sorted({sorted(some)[len(some) * k // 64] for k in range(1, 64)}) if some else []
    i = i.withColumn("b", F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x <= F.col("instance_id"))) if bounds else F.lit(0))
    n = i.groupBy("b").agg(F.count("*").alias("c"))
    n = n.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    pos = F.row_number().over(Window.partitionBy("b").orderBy("instance_id")) - 1 + F.col("before")
    step = F.greatest(F.lit(1), F.floor(F.col("n") / count))
    return i.join(n, "b").withColumn("pos", pos).where((F.col("pos") % step == 0) & (F.col("pos") / step < count)).select("instance_id", F.col("pos").cast("bigint").alias("pos"))


def quality(extracted: DataFrame, clean: DataFrame, turns: DataFrame, counts: DataFrame, sessions: DataFrame) -> DataFrame:
    """metric, value of an extraction: sessions and those parsed, kept facts, off-vocabulary predicates, bad turns, grounded and invented spans, whether each share passes, and whether all do.

    A session that no extraction comes from counts as one whose output could not be parsed.
    """
    from factloom.functions.text import digits_only
    from factloom.operators.retrieval import grounded_rows

    e = extracted.join(counts, "session_id", "left")
    turn = digits_only(F.col("turn_ref"))
    raw = e.agg(F.count("*").alias("raw_facts"), count_if(~F.coalesce(F.col("predicate").isin(vocab.PREDICATES), F.lit(False))).alias("off_vocabulary"), count_if(turn >= F.coalesce("n_turns", F.lit(0))).alias("bad_turn"))
    k = grounded_rows(clean, turns).withColumn("g", F.col("grounded")).withColumn("blank", F.trim("evidence_span") == "")
    kept = k.agg(F.count("*").alias("kept_facts"), count_if(F.col("g")).alias("grounded"), count_if(~F.col("g") & F.col("blank")).alias("no_span"), count_if(~F.col("g") & ~F.col("blank")).alias("invented_span"), count_if(F.col("predicate") == "other").alias("other"))
    keys = sessions.select(F.col("key").alias("session_id")).where("session_id is not null").distinct()
    from_ = extracted.select("session_id").distinct().withColumn("_x", F.lit(1))
    seen = keys.join(from_, "session_id", "left").agg(F.count("*").alias("sessions"), F.count("_x").alias("parsed"))
    both = raw.crossJoin(kept).crossJoin(seen)  # one row each
    share = lambda c, of="kept_facts": F.when(N(of) > 0, F.bround(N(c).cast("double") / N(of), 4)).otherwise(0.0)
    both = both.withColumns({"valid_share": share("parsed", "sessions"), "grounded_share": share("grounded"), "other_share": share("other")})
    both = both.withColumns({"validity_passes": (N("valid_share") >= 0.95).cast("int"), "grounding_passes": (N("grounded_share") >= 0.90).cast("int"), "other_passes": (N("other_share") <= 0.35).cast("int")})
    both = both.withColumn("go", N("validity_passes") * N("grounding_passes") * N("other_passes"))
    return _unpivot(both, [], ["sessions", "parsed", "valid_share", "validity_passes", "go", "raw_facts", "off_vocabulary", "bad_turn", "kept_facts", "grounded", "no_span", "invented_span", "other", "grounded_share", "other_share", "grounding_passes", "other_passes"])
