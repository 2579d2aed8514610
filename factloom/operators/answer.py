"""Questions answered from facts: the cascade, what a reader is shown, its reply's citations, and one second look.

Replies of the reader are an input table (instance_id, attempt, text, cited; error where a call failed): attempt 1 is the first
reply, attempt 2 the one to the second look. requests() gives what each attempt asks. All questions go through at once; a reply
counts only where the plan comes to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import vocab
from factloom.functions.windows import day_label, overlaps, window_label, with_window
from factloom.operators import gates, retrieval

# What an abstention says, and the head of the list that a reader gets.
ABSTAIN = "ABSTAIN"
HEAD = "Facts (fact_id | valid from | subject | predicate | value | evidence):"


def retrieved(questions: DataFrame, facts: DataFrame, cap: int = vocab.NARROW_CAP) -> DataFrame:
    """The facts of each question's instance with scoped (within its window, or all if none is) and shown (of those, the narrowed)."""
    q = with_window(questions.select("instance_id", "question", "asked_at")).select("instance_id", "w_start", "w_end")
    f = facts.join(q, "instance_id").withColumn("_meets", F.col("w_start").isNotNull() & overlaps(F.col("valid_from"), F.col("valid_to"), F.col("w_start"), F.col("w_end")))
    some = f.groupBy("instance_id").agg(F.max("_meets").alias("_some"))
    f = f.join(some, "instance_id").withColumn("scoped", ~F.col("_some") | F.col("_meets")).drop("_some", "_meets", "w_start", "w_end")
    kept = retrieval.narrowed(questions, f.where("scoped"), cap).withColumn("shown", F.lit(True))
    return f.join(kept, ["instance_id", "vid"], "left").withColumn("shown", F.coalesce("shown", F.lit(False)))


def requests(questions: DataFrame, facts: DataFrame, entities: DataFrame, cap: int = vocab.NARROW_CAP) -> DataFrame:
    """id (instance and attempt), instance_id, attempt, prompt of what the reader is asked.

    A question's list is what fits a reader: cap facts and the rest of the last group. The second look shows whole snippets, and
    all facts of the instance where a window had hidden some.
    """
    names = entities.select(F.col("vid").alias("subject_vid"), F.col("name").alias("subject_name"))
    f = retrieved(questions, facts, cap).join(names, "subject_vid", "left")
    q = with_window(questions.select("instance_id", "question", "asked_at"))
    head = F.concat(F.lit("Question asked on "), F.coalesce(day_label(F.col("asked_at")), F.lit("")), F.lit(": "), F.coalesce("question", F.lit("")), F.lit(f"\n\n{HEAD}\n"))
    out = None
    for attempt, width in ((1, vocab.MAX_SPAN), (2, None)):
        seen = f.where("shown") if attempt == 1 else f.join(q.select("instance_id", F.col("w_start").isNotNull().alias("_w")), "instance_id").where("shown or _w")
        lines = seen.groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("asserted_at", F.lit(0)).alias("a"), "vid", retrieval.fact_line(width).alias("line")))).alias("l"))
        part = q.join(lines, "instance_id").select(F.concat_ws("#", "instance_id", F.lit(str(attempt))).alias("id"), "instance_id", F.lit(attempt).alias("attempt"), F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("prompt"))
        out = part if out is None else out.unionByName(part)
    return out


def _cited(replies: DataFrame, attempt: int, facts: DataFrame) -> DataFrame:
    """instance_id, text, cited, ok, reason, missing of the replies of an attempt that were given."""
    r = replies.where((F.col("attempt") == attempt) & F.col("text").isNotNull())
    r = r.select(F.col("instance_id").alias("id"), "instance_id", F.trim("text").alias("answer"), "cited")
    g = gates.citation_gate(r, facts).select("instance_id", F.col("passed").alias("ok"), "reason", "missing")
    return r.select("instance_id", F.col("answer").alias("text"), gates.cited_ids(F.col("cited")).alias("cited")).join(g, "instance_id")


def _detail(reason: Column, missing: Column) -> Column:
    return F.when(missing != "", F.concat(reason, F.lit(": "), missing)).otherwise(reason)


def answered(questions: DataFrame, entities: DataFrame, facts: DataFrame, aliases: DataFrame, replies: DataFrame, appeals: bool = True, cap: int = vocab.NARROW_CAP) -> DataFrame:
    """One row a question: instance_id, answer, abstained, reason, gate_detail, window, fact_count, round_trips, appealed, appeal_won, cited, trace.

    A question without a reply is declined as if the reader had abstained. An appeal can only turn an abstention into an answer.
    """
    v = gates.cascade(questions, entities, facts, aliases)
    w = with_window(questions.select("instance_id", "question", "asked_at"))
    w = w.select("instance_id", F.col("w_start").isNotNull().alias("windowed"), F.when(F.col("w_start").isNotNull(), F.concat(F.col("w_phrase"), F.lit(" ("), window_label(), F.lit(")"))).otherwise("").alias("window"))
    f = retrieved(questions, facts, cap)
    n = f.groupBy("instance_id").agg(F.count("*").alias("n_all"), F.sum(F.col("scoped").cast("int")).alias("n_scoped"), F.sum(F.col("shown").cast("int")).alias("n_shown"))
    one = lambda p, a: _cited(replies, a, p.select("instance_id", "fact_id"))
    first = one(f.where("shown"), 1)
    wide = f.join(w.select("instance_id", "windowed"), "instance_id").where("shown or windowed")
    second = one(wide, 2).select("instance_id", F.col("text").alias("text2"), F.col("cited").alias("cited2"), F.col("ok").alias("ok2"), F.col("reason").alias("reason2"), F.col("missing").alias("missing2"))
    r = v.join(w, "instance_id").join(n, "instance_id", "left").join(first.withColumnsRenamed({"reason": "c_reason", "missing": "c_missing"}), "instance_id", "left")
    reached = F.col("passed") & (F.coalesce("n_all", F.lit(0)) > 0)
    r = r.withColumns({"reached": reached, "ok": F.coalesce("ok", F.lit(False)), "c_reason": F.coalesce("c_reason", F.lit("not_in_graph")), "c_missing": F.coalesce("c_missing", F.lit(""))})
    plan = gates.appeal(r.where("reached and not ok").select(F.col("instance_id").alias("id"), "instance_id", F.col("c_reason").alias("reason"), "windowed"), f.where("shown")).select("instance_id", F.col("appeal").alias("_a"), "declined")
    r = r.join(plan, "instance_id", "left").join(second, "instance_id", "left")
    appealed = F.coalesce("_a", F.lit(False)) & F.lit(appeals)
    won = appealed & F.coalesce("ok2", F.lit(False))
    r = r.withColumns({"appealed": appealed, "appeal_won": won})
    answered_ = F.col("reached") & (F.col("ok") | F.col("appeal_won"))
    reason = F.when(answered_, "").when(~F.col("passed"), F.col("reason")).when(~F.col("reached"), "empty_graph").otherwise(F.col("c_reason"))
    detail = F.when(answered_, "").when(~F.col("passed"), _detail(F.col("reason"), F.col("missing"))).when(F.col("reached") & (F.col("c_missing") != ""), _detail(F.col("c_reason"), F.col("c_missing"))).otherwise("")
    seen = F.when(F.col("windowed"), F.col("n_all")).otherwise(F.col("n_shown"))
    steps = F.array_compact(F.array(
        F.when(F.col("reached") & (F.col("n_shown") < F.col("n_scoped")), F.concat(F.lit("narrow: "), F.col("n_scoped").cast("string"), F.lit(" facts -> "), F.col("n_shown").cast("string"))),
        F.when(F.col("reached"), F.concat(F.lit("5 citation: "), F.when(F.col("ok"), "pass").otherwise(_detail(F.col("c_reason"), F.col("c_missing"))))),
        F.when(F.col("reached") & ~F.col("ok") & ~F.col("appealed"), F.concat(F.lit("appeal: skipped ("), F.when(F.lit(appeals), F.col("declined")).otherwise("appeal disabled"), F.lit(")"))),
        F.when(F.col("appealed") & F.col("text2").isNull(), F.lit("appeal: errored, abstention kept")),
        F.when(F.col("appeal_won"), F.concat(F.lit("appeal: won ("), seen.cast("string"), F.lit(" facts"), F.when(F.col("windowed"), ", window dropped").otherwise(""), F.lit(")"))),
        F.when(F.col("appealed") & ~F.col("appeal_won") & F.col("text2").isNotNull(), F.concat(F.lit("appeal: lost ("), _detail(F.col("reason2"), F.col("missing2")), F.lit(")"))),
    ))
    none = F.array().cast("array<string>")
    return r.select(
        "instance_id", F.when(~answered_, ABSTAIN).when(F.col("ok"), F.col("text")).otherwise(F.col("text2")).alias("answer"), (~answered_).alias("abstained"), reason.alias("reason"), detail.alias("gate_detail"), "window",
        F.when(~F.col("reached"), 0).when(F.col("appeal_won"), seen).otherwise(F.col("n_shown")).cast("bigint").alias("fact_count"), "round_trips", "appealed", "appeal_won",
        F.when(~answered_, none).when(F.col("ok"), F.col("cited")).otherwise(F.col("cited2")).alias("cited"), F.concat("trace", steps).alias("trace"),
    )


def explained(answers: DataFrame, facts: DataFrame, entities: DataFrame) -> DataFrame:
    """instance_id, text: the whole trace of each answer or abstention, with the provenance of what it cites. answers: of answered()."""
    e = retrieval.evidence(answers.select(F.col("instance_id").alias("id"), "instance_id", "cited"), facts)
    more = facts.select(F.col("instance_id").alias("id"), "fact_id", "subject_vid", F.coalesce("snippet", F.lit("")).alias("snippet"))
    names = entities.select(F.col("vid").alias("subject_vid"), F.coalesce("name", F.lit("")).alias("subject"))
    e = e.join(more, ["id", "fact_id"]).join(names, "subject_vid", "left")
    until = F.when(F.col("valid_to") == 0, "").otherwise(F.concat(F.lit(" until "), day_label(F.col("valid_to"))))
    lines = F.concat_ws(
        "\n", F.concat(F.lit("  "), "fact_id", F.lit("  "), F.coalesce("subject", F.lit("")), F.lit(" "), "predicate", F.lit(" = "), "value"),
        F.concat(F.lit("      session "), F.coalesce("session_id", F.lit("")), F.lit(" turn "), F.coalesce(F.col("turn_idx").cast("string"), F.lit("")), F.lit(" ("), "role", F.lit(")"), F.when(F.col("role") == "assistant", "  <- ASSISTANT-SOURCED").otherwise("")),
        F.concat(F.lit("      valid from "), day_label(F.col("valid_from")), until), F.when(F.col("supersedes") != "", F.concat(F.lit("      replaces "), "supersedes")), F.when(F.col("snippet") != "", F.concat(F.lit('      "'), "snippet", F.lit('"'))),
    )
    e = e.groupBy(F.col("id").alias("instance_id")).agg(F.array_sort(F.collect_list(F.struct("pos", lines.alias("line")))).alias("l"))  # what one answer cites
    a = answers.join(e, "instance_id", "left")
    said = F.when(F.col("abstained"), F.concat(F.lit("ABSTAIN "), F.when(F.col("gate_detail") != "", F.col("gate_detail")).otherwise(F.col("reason")))).otherwise(F.concat_ws("\n", F.concat(F.lit("answer: "), "answer"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")))
    head = F.concat(F.lit("Q cost "), F.col("round_trips").cast("string"), F.lit(" round trips over "), F.col("fact_count").cast("string"), F.lit(" facts"))
    return a.select("instance_id", F.concat_ws("\n", head, F.when(F.col("window") != "", F.concat(F.lit("window: "), "window")), F.when(F.size("trace") > 0, F.array_join(F.transform("trace", lambda t: F.concat(F.lit("  "), t)), "\n")), said).alias("text"))
