"""The cascade of gates: may a question be answered from what its instance holds, and if not, why.

All gates of all questions are computed at once as joins and grouped aggregates; the first that fails gives the reason. What a
one-by-one run would have read is a column, round_trips: two reads, a third for the facts, a fourth for paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import vocab
from factloom.functions.text import fold, mentions, question_predicates
from factloom.functions.windows import overlaps, window_label, with_window
from factloom.operators.graph import adjacent, connected, incidence
from factloom.operators.merge import first_wins
from factloom.session import written


def named(questions: DataFrame) -> DataFrame:
    """instance_id, pos, mention of each name in a question."""
    return questions.select("instance_id", F.posexplode(mentions(F.coalesce("question", F.lit(""))))).toDF("instance_id", "pos", "mention")


def name_table(entities: DataFrame) -> DataFrame:
    """instance_id, mention, key: each entity by key, by name and by the key without its type; the key first, then by vid."""
    forms = F.array(F.struct(F.col("key").alias("mention"), F.lit(0).alias("way")), F.struct(fold("name").alias("mention"), F.lit(1).alias("way")), F.struct(F.regexp_replace("key", "^[^:]*:", "").alias("mention"), F.lit(1).alias("way")))
    e = entities.where("instance_id is not null and key is not null").select("instance_id", "vid", "key", F.inline(forms)).where("mention is not null and mention <> ''")
    return first_wins(e.select("instance_id", "mention", "key", "way", "vid"), ["instance_id", "mention"], F.struct("way", "vid", "key")).select("instance_id", "mention", "key")


def text_resolved(missing: DataFrame, facts: DataFrame) -> DataFrame:
    """instance_id, mention, key: the subject of the first fact whose value or snippet holds the mention.

    An instance has few mentions left over, so facts are read once for each of them.
    """
    m = missing.select("instance_id", "mention").distinct()
    f = facts.select("instance_id", "asserted_at", "vid", F.coalesce("subject_key", F.lit(vocab.SELF_KEY)).alias("key"), F.lower(F.coalesce("value_text", F.lit(""))).alias("_v"), F.lower(F.coalesce("snippet", F.lit(""))).alias("_s"))
    hit = f.join(m, "instance_id").where(F.contains("_v", F.col("mention")) | F.contains("_s", F.col("mention")))
    return first_wins(hit.select("instance_id", "mention", "key", "asserted_at", "vid"), ["instance_id", "mention"], F.struct("asserted_at", "vid")).select("instance_id", "mention", "key")


def entity_gate(questions: DataFrame, entities: DataFrame, facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """instance_id, passed, missing, resolved (keys in order), via_text of each question. aliases: of graph.alias_closure."""
    table = name_table(entities)
    n = named(questions).join(table, ["instance_id", "mention"], "left")
    found = text_resolved(n.where(f"key is null and mention <> '{vocab.SELF_KEY}'"), facts).withColumnRenamed("key", "text_key")
    # The user's own key is never looked for in texts' names, but may stand in a text like any other.
    n = n.join(found, ["instance_id", "mention"], "left").withColumn("way", F.when(F.col("key").isNotNull(), "entity").when(F.col("text_key").isNotNull(), "text").when(F.col("mention") == vocab.SELF_KEY, "dropped").otherwise("missing"))
    n = n.withColumn("key", F.coalesce("key", "text_key")).join(aliases.select("instance_id", F.col("alias_key").alias("key"), "canonical_key"), ["instance_id", "key"], "left")
    n = n.withColumn("key", F.coalesce("canonical_key", "key"))
    g = n.groupBy("instance_id").agg(
        F.min_by("mention", F.when(F.col("way") == "missing", F.col("pos"))).alias("missing"),
        F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("pos", "key")))).alias("_r"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("way") == "text", F.struct("pos", "mention")))), lambda x: x["mention"]).alias("via_text"),
    )  # the names of one question
    first = entities.where("instance_id is not null").groupBy("instance_id").agg(F.min_by("key", "vid").alias("first_key"), F.max(F.when(F.col("key") == vocab.SELF_KEY, F.col("key"))).alias("self_key"))
    q = questions.select("instance_id").join(first, "instance_id", "left").join(g, "instance_id", "left")
    keys = F.array_distinct(F.transform(F.coalesce("_r", F.array().cast("array<struct<pos:int,key:string>>")), lambda x: x["key"]))
    empty = F.col("first_key").isNull()
    missing = F.when(empty, "<empty graph>").otherwise(F.col("missing"))
    resolved = F.when(missing.isNotNull(), F.array().cast("array<string>")).when(F.size(keys) > 0, keys).otherwise(F.array(F.coalesce("self_key", "first_key")))
    return q.select("instance_id", missing.isNull().alias("passed"), missing.alias("missing"), resolved.alias("resolved"), F.coalesce("via_text", F.array().cast("array<string>")).alias("via_text"))


def held(facts: DataFrame) -> DataFrame:
    """instance_id, key, predicates of each subject: at most the vocabulary's size each."""
    return facts.where("subject_key is not null").groupBy("instance_id", F.col("subject_key").alias("key")).agg(F.sort_array(F.collect_set("predicate")).alias("predicates"))


def predicate_passes(wanted: Column, predicates: Column, key: Column) -> Column:
    predicates = F.coalesce(predicates, F.array().cast("array<string>"))
    return (F.size(wanted) == 0) | F.arrays_overlap(predicates, wanted) | F.array_contains(predicates, "other") | (key == vocab.SELF_KEY)


def via_other(wanted: Column, predicates: Column) -> Column:
    """Whether a subject passes only as it holds facts that have no label."""
    predicates = F.coalesce(predicates, F.array().cast("array<string>"))
    return (F.size(wanted) > 0) & ~F.arrays_overlap(predicates, wanted) & F.array_contains(predicates, "other")


def window_hits(keys: DataFrame, facts: DataFrame) -> DataFrame:
    """instance_id, key, hit of each (instance_id, key, wanted, w_start, w_end): whether a fact of the wanted predicates, or any if it holds none of them, meets the window."""
    k = keys.where("w_start is not null")
    f = facts.select("instance_id", F.col("subject_key").alias("key"), "predicate", "valid_from", "valid_to")
    j = f.join(k, ["instance_id", "key"])
    asked = F.array_contains("wanted", F.col("predicate"))
    meets = overlaps(F.col("valid_from"), F.col("valid_to"), F.col("w_start"), F.col("w_end"))
    g = j.groupBy("instance_id", "key").agg(F.max(asked.cast("int")).alias("scoped"), F.max((asked & meets).cast("int")).alias("hit_scoped"), F.max(meets.cast("int")).alias("hit_any"))
    return g.select("instance_id", "key", F.when(F.col("scoped") == 1, F.col("hit_scoped")).otherwise(F.col("hit_any")).alias("hit"))


def cascade(questions: DataFrame, entities: DataFrame, facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """instance_id, passed, reason, missing, resolved, round_trips and trace (a line for each gate that ran) of each question."""
    q = with_window(questions.select("instance_id", "question", "asked_at")).withColumn("wanted", question_predicates(F.coalesce("question", F.lit("")))).drop("question", "asked_at")
    # Facts and the first gate feed every later one: written once, read by each.
    facts = written(facts.select("vid", "instance_id", "asserted_at", "subject_key", "predicate", "value_text", "value_type", "snippet", "valid_from", "valid_to"), "gates")
    g1 = written(entity_gate(questions, entities, facts, aliases), "gates")
    keys = g1.where("passed").select("instance_id", F.posexplode("resolved")).toDF("instance_id", "pos", "key").join(q, "instance_id")
    k = keys.join(held(facts), ["instance_id", "key"], "left").join(window_hits(keys, facts), ["instance_id", "key"], "left")
    ok2 = predicate_passes(F.col("wanted"), F.col("predicates"), F.col("key"))
    ok3 = F.col("w_start").isNull() | (F.coalesce("hit", F.lit(0)) == 1)
    detail = F.when(~ok2, F.concat("key", F.lit(" has no "), F.concat_ws(", ", "wanted"))).when(~ok3, F.concat(F.col("key"), F.lit(" has no fact valid "), F.col("w_phrase"), F.lit(" ("), window_label(), F.lit(")")))
    why = F.when(~ok2, "no_such_relation").when(~ok3, "no_fact_in_window")
    fails = F.concat(why, F.lit(": "), detail)
    said = F.concat(F.lit("2 predicate: "), F.when(~ok2, fails).when(via_other(F.col("wanted"), F.col("predicates")), "pass (holds unlabelled `other` facts)").otherwise("pass"))
    then = F.when(ok2, F.concat(F.lit("3 window: "), F.when(~ok3, fails).otherwise("pass")))
    k = k.select("instance_id", "pos", (ok2 & ok3).alias("ok"), why.alias("why"), detail.alias("detail"), F.array_compact(F.array(said, then)).alias("lines"))
    g23 = k.groupBy("instance_id").agg(F.max("ok").alias("ok23"), F.max_by(F.struct("why", "detail"), "pos").alias("v"), F.min(F.when(F.col("ok"), F.col("pos"))).alias("_at"), F.array_sort(F.collect_list(F.struct("pos", "lines"))).alias("_l"))  # the names of one question
    anchors = g1.where("passed").select("instance_id", F.array_except("resolved", F.array(F.lit(vocab.ASSISTANT_KEY))).alias("t"), F.size("resolved").alias("n"))
    two = anchors.where("n >= 2 and size(t) >= 2").select("instance_id", F.col("t"), F.explode("t").alias("a")).select("instance_id", "a", F.explode("t").alias("b")).where("a < b")
    linked = connected(two, adjacent(incidence(facts))).select("instance_id").distinct().withColumn("joined", F.lit(True))
    tried = two.groupBy("instance_id").agg(F.count("*").alias("tried"))
    out = g1.join(g23, "instance_id", "left").join(tried, "instance_id", "left").join(linked, "instance_id", "left")
    fail4 = F.col("tried").isNotNull() & F.col("joined").isNull()
    reason = F.when(~F.col("passed"), "unknown_entity").when(~F.col("ok23"), F.col("v.why")).when(fail4, "no_path")
    no_path = F.concat(F.array_join("resolved", ", "), F.lit(": "), F.col("tried").cast("string"), F.lit(f" pairs, no path within {vocab.MAX_LEN} hops"))
    missing = F.when(~F.col("passed"), F.col("missing")).when(~F.col("ok23"), F.col("v.detail")).when(fail4, no_path)
    text_read = (F.size("via_text") > 0) | (~F.col("passed") & (F.col("missing") != "<empty graph>"))
    trips = F.when(~F.col("passed"), F.when(text_read, 3).otherwise(2)).when(~F.col("ok23"), 3).when(F.col("tried").isNotNull(), 4).otherwise(3)
    gate1 = F.concat(F.lit("1 entity: "), F.when(~F.col("passed"), F.concat(F.lit("unknown_entity: "), F.col("missing"))).when(F.size("via_text") > 0, F.concat(F.lit("pass (via stored text: "), F.array_join("via_text", ", "), F.lit(")"))).otherwise("pass"))
    ran = F.filter("_l", lambda x: F.col("_at").isNull() | (x["pos"] <= F.col("_at")))  # it stops at the first entity that passes
    none = F.array().cast("array<string>")
    lines = F.coalesce(F.flatten(F.transform(ran, lambda x: x["lines"])), none)
    gate4 = F.when(F.size("resolved") < 2, F.lit("4 path: skipped (one entity, nothing to connect)")).otherwise(F.concat(F.lit("4 path: "), F.when(fail4, F.concat(F.lit("no_path: "), no_path)).otherwise("pass")))
    trace = F.concat(F.array(gate1), F.when(F.col("passed"), lines).otherwise(none), F.when(F.coalesce("ok23", F.lit(False)), F.array(gate4)).otherwise(none))
    return out.withColumn("trace", trace).select("trace", "instance_id", reason.isNull().alias("passed"), F.coalesce(reason, F.lit("")).alias("reason"), F.coalesce(missing, F.lit("")).alias("missing"), F.concat_ws(",", "resolved").alias("resolved"), trips.alias("round_trips"))


def cited_ids(c: Column) -> Column:
    """Citations as stored: lower case, trimmed, each once, in order."""
    clean = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(F.lower(F.coalesce(x, F.lit("")))))
    return F.array_distinct(F.filter(clean, lambda x: x != ""))


def citation_gate(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """answers with passed, reason, missing by what each cites. answers: id, instance_id, answer, cited (array)."""
    a = answers.select("id", "instance_id", F.coalesce("answer", F.lit("")).alias("answer"), cited_ids(F.col("cited")).alias("cited"))
    c = a.select("id", "instance_id", F.posexplode("cited")).toDF("id", "instance_id", "pos", "fact_id")
    stored = facts.select("instance_id", "fact_id").distinct().withColumn("there", F.lit(1))
    bad = c.join(stored, ["instance_id", "fact_id"], "left").where("there is null").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "fact_id"))).alias("b"))  # one answer's citations
    out = a.join(bad, "id", "left")
    reason = F.when(F.upper("answer").startswith("ABSTAIN"), "not_in_graph").when(F.col("b").isNotNull(), "fabricated_citation").when(F.size("cited") == 0, "uncited_answer").otherwise("")
    missing = F.when(reason == "fabricated_citation", F.array_join(F.transform("b", lambda x: x["fact_id"]), ", ")).otherwise("")
    return out.select("id", "instance_id", (reason == "").alias("passed"), reason.alias("reason"), missing.alias("missing"))


def appeal(gated: DataFrame, facts: DataFrame) -> DataFrame:
    """id, instance_id, appeal, declined: whether an abstention gets a second look. gated: instance_id, reason, windowed."""
    f = facts.groupBy("instance_id").agg(F.count("*").alias("n_facts"), F.max((F.length("snippet") > vocab.MAX_SPAN).cast("int")).alias("wide"))
    g = gated.join(f, "instance_id", "left")
    # Why there is no second look.
    declined = (
        F.when(F.col("reason").isin("uncited_answer", "fabricated_citation"), F.concat("reason", F.lit(" is a contract failure, not a decline")))
        .when(F.col("reason") != "not_in_graph", F.concat("reason", F.lit(" fires before retrieval")))
        .when(F.coalesce("n_facts", F.lit(0)) == 0, "no facts in hand")
        .when(~F.col("windowed") & (F.coalesce("wide", F.lit(0)) == 0), "nothing new to show: no window to drop and no snippet longer than the first render")
        .otherwise("")
    )
    return g.select("id", "instance_id", (declined == "").alias("appeal"), declined.alias("declined"))
