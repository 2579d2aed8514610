"""From extractions to rows of a property graph: facts, entities and typed edges, their aliases and paths."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import vocab
from factloom.functions.ids import edge_id, entity_id, fact_id, idempotency_key, session_id
from factloom.functions.text import digits_only, entity_key, normalized, staged, strip
from factloom.functions.windows import DAY
from factloom.operators.history import neighbours
from factloom.operators.merge import first_wins
from factloom.session import discarded, written


def valid_from(df: DataFrame, hint: str, said_at: str) -> Column:
    """When a fact became true by its hint (five date shapes), else when it was said.

    A month and day without year that lie more than a day after what was said belong to the year before; if that day doesn't
    exist there, or the date is impossible, the time of saying holds.
    """
    t = strip(F.coalesce(F.col(hint), F.lit("")))
    # The shapes, each brought to year-month-day.
    shapes = [(r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", "$1-$2-$3"), (r"^(\d{4})[-/](\d{1,2})$", "$1-$2-1"), (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2"), (r"^(\d{4})$", "$1-1-1")]
    full = None
    for p, to in shapes:
        full = F.when(t.rlike(p), F.regexp_replace(t, p, to)) if full is None else full.when(t.rlike(p), F.regexp_replace(t, p, to))
    epoch = lambda c: F.unix_date(c.try_cast("date")).cast("bigint") * DAY
    bare = r"^(\d{1,2})/(\d{1,2})$"
    said = F.col(said_at)
    year = F.year(F.date_from_unix_date(F.floor(said / DAY).cast("int")))
    in_year = lambda y: F.when(t.rlike(bare), epoch(F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.regexp_replace(t, bare, "$1-$2"))))
    this = in_year(year)
    yearless = F.when(this > said + DAY, in_year(year - 1)).otherwise(this)
    return F.coalesce(epoch(full), yearless, said)


def cleaned(extracted: DataFrame, turn_counts: DataFrame) -> DataFrame:
    """Extractions brought to the schema: facts without subject or value and absences written as values are dropped.

    turn_counts: session_id, n_turns. A turn out of range becomes 0, predicates and types outside the vocabulary other and thing.
    """
    e = extracted.withColumns({"subject": strip(F.coalesce("subject", F.lit(""))), "value_text": strip(F.coalesce("value_text", F.lit(""))), "turn_idx": digits_only(F.col("turn_ref")), "evidence_span": F.substring(F.coalesce("evidence_span", F.lit("")), 1, vocab.MAX_SPAN)})
    low = F.regexp_replace(F.lower("value_text"), r"\.+$", "")
    absent = low.isin(vocab.EMPTY_VALUES)
    for p in vocab.EMPTY_PREFIXES:
        absent = absent | low.startswith(p)
    e = e.where((F.col("subject") != "") & (F.col("value_text") != "") & ~absent).join(turn_counts, "session_id", "left")
    return e.withColumns({
        "predicate": F.when(F.col("predicate").isin(vocab.PREDICATES), F.col("predicate")).otherwise("other"),
        "subject_type": F.when(F.col("subject_type").isin(vocab.ENTITY_TYPES), F.col("subject_type")).otherwise("thing"),
        "turn_idx": F.when(F.col("turn_idx") < F.coalesce("n_turns", F.lit(0)), F.col("turn_idx")).otherwise(0),
    }).drop("n_turns", "turn_ref")


def turn_counts(turns: DataFrame) -> DataFrame:
    return turns.where("session_id is not null").groupBy("session_id").agg(F.count("*").cast("int").alias("n_turns"))


def _session_times(sessions: DataFrame) -> DataFrame:
    return sessions.where("key is not null").select(F.col("key").alias("session_id"), F.col("idx").alias("session_idx"), F.unix_timestamp("received_at").alias("said_at"))


def touched(extracted: DataFrame, sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Clean extractions with their session and turn, and the keys of subject and object."""
    said = first_wins(_session_times(sessions), ["session_id"], F.struct("session_idx", "said_at"))
    role = first_wins(turns.where("session_id is not null").select("session_id", F.col("idx").alias("turn_idx"), "role", "content"), ["session_id", "turn_idx"], F.struct("role", "content"))
    e = cleaned(extracted, turn_counts(turns)).join(said, "session_id").join(role, ["session_id", "turn_idx"], "left")
    e = staged(e, _k=entity_key("subject_type", "subject"))
    mine = (F.col("role") == "assistant") & (F.col("_k") == vocab.SELF_KEY)
    object_types = F.create_map(*[F.lit(x) for kv in vocab.OBJECT_TYPES.items() for x in kv])
    e = staged(e, subject_key=F.when(mine, vocab.ASSISTANT_KEY).otherwise(F.col("_k")), subject_name=F.when(mine, "assistant").otherwise(F.col("subject")), object_type=F.coalesce(F.try_element_at(object_types, F.col("predicate")), F.lit("thing")))
    return e.drop("_k").withColumn("object_key", F.when(F.col("value_is_entity"), entity_key("object_type", "value_text")))


def fact_rows(t: DataFrame) -> DataFrame:
    """One row per fact identity (session, turn, predicate, subject, value), the first extraction's."""
    f = staged(t, key=idempotency_key("instance_id", "session_id", "turn_idx", "predicate", "subject_key", "value_text"), vf=valid_from(t, "valid_from_hint", "said_at"))
    f = f.select(
        fact_id("key").alias("vid"), F.substring("key", 1, 16).alias("fact_id"), "instance_id", entity_id("instance_id", "subject_key").alias("subject_vid"), "subject_key", "predicate", "value_text",
        F.when(F.col("value_is_entity"), "entity").otherwise("literal").alias("value_type"), F.col("vf").alias("valid_from"), F.lit(0).cast("bigint").alias("valid_to"), F.col("said_at").alias("asserted_at"), "session_id", "turn_idx",
        F.coalesce("role", F.lit("")).alias("role"), F.substring(F.when(F.col("evidence_span") != "", F.col("evidence_span")).otherwise(F.coalesce("content", F.lit(""))), 1, vocab.MAX_SPAN).alias("snippet"), "confidence", F.lit("current").alias("status"), "object_key", F.struct("session_idx", "extract_id").alias("_o"),
    )
    return first_wins(f, ["vid"], F.col("_o")).drop("_o")


def entity_rows(t: DataFrame) -> DataFrame:
    """vid, key, skey, name, entity_type, first_seen, last_seen, instance_id of each entity that a fact touches."""
    both = t.select("instance_id", "session_idx", "extract_id", F.inline(F.array(
        F.struct(F.col("subject_key").alias("key"), F.col("subject_name").alias("name"), F.lit("person").alias("entity_type"), F.lit(0).alias("part")),
        F.struct(F.col("object_key").alias("key"), F.col("value_text").alias("name"), F.col("object_type").alias("entity_type"), F.lit(1).alias("part")),
    ))).where("key is not null")
    g = both.groupBy("instance_id", "key").agg(F.min_by(F.struct("name", "entity_type"), F.struct("session_idx", "extract_id", "part")).alias("w"), F.min("session_idx").alias("first_seen"), F.max("session_idx").alias("last_seen"))
    return g.select(entity_id("instance_id", "key").alias("vid"), "key", F.concat_ws("|", "instance_id", "key").alias("skey"), "w.name", "w.entity_type", "first_seen", "last_seen", "instance_id")


def fact_edges(facts: DataFrame) -> DataFrame:
    """src, dst, rid, type, instance_id: SUBJECT, OBJECT and ASSERTED_IN of fact rows."""
    ends = [("SUBJECT", F.col("subject_vid")), ("OBJECT", F.when(F.col("object_key").isNotNull(), entity_id("instance_id", "object_key"))), ("ASSERTED_IN", session_id("instance_id", "session_id"))]
    e = facts.select("instance_id", F.col("vid").alias("src"), F.inline(F.array(*[F.struct(dst.alias("dst"), F.lit(kind).alias("type")) for kind, dst in ends]))).where("dst is not null")
    return e.select("src", "dst", fact_edge_id().alias("rid"), "type", "instance_id")


def fact_edge_id() -> Column:
    return F.when(F.col("type") == "SUBJECT", edge_id("src", "SUBJECT", "dst")).when(F.col("type") == "OBJECT", edge_id("src", "OBJECT", "dst")).otherwise(edge_id("src", "ASSERTED_IN", "dst"))


def session_edges(sessions: DataFrame) -> DataFrame:
    """NEXT edges between neighbours in an instance, by idx and id."""
    s = sessions.where("instance_id is not null and vid is not null").select("instance_id", "vid", F.struct(F.coalesce("idx", F.lit(0)).alias("idx"), "vid").alias("_o"), F.floor(F.coalesce("idx", F.lit(0)) / 1000).alias("_m"))
    s = neighbours(s, ["instance_id"], "_m", "_o", ["vid"]).where("after is not null")
    return s.select(F.col("vid").alias("src"), F.col("after.vid").alias("dst"), edge_id("vid", "NEXT", "after.vid").alias("rid"), "instance_id")


def _names(entities: DataFrame) -> DataFrame:
    e = entities.select("instance_id", F.col("entity_type").alias("kind"), "key", F.coalesce(normalized("name"), F.lit("")).alias("norm")).where("norm <> '' and instance_id is not null").distinct()
    return e.withColumn("ws", F.array_distinct(F.split("norm", " ")))


def alias_containment(entities: DataFrame) -> DataFrame:
    """instance_id, alias_key, canonical_key: the words of one name are some of the words of a longer one, of one type.

    Names meet only on a word: the rarest word of the shorter one, by how many names of its kind and instance have it, is looked up
    among all words of the others.
    """
    n = _names(entities)
    each = n.select("instance_id", "kind", "key", "norm", "ws", F.explode("ws").alias("w"))
    count = each.groupBy("instance_id", "kind", "w").agg(F.count("*").alias("n"))
    short = each.join(count, ["instance_id", "kind", "w"]).groupBy("instance_id", "kind", F.col("key").alias("alias_key"), F.col("norm").alias("a"), F.col("ws").alias("aw")).agg(F.min_by("w", F.struct("n", "w")).alias("w"))
    long = n.select("instance_id", "kind", F.col("key").alias("canonical_key"), F.col("norm").alias("b"), F.col("ws").alias("bw"), F.explode("ws").alias("w"))
    p = short.join(long, ["instance_id", "kind", "w"]).where("alias_key <> canonical_key and length(a) < length(b) and size(aw) < size(bw) and size(array_except(aw, bw)) = 0")
    return p.select("instance_id", "alias_key", "canonical_key").distinct()


def alias_ratio(entities: DataFrame, least: float = 0.92) -> DataFrame:
    """instance_id, alias_key, canonical_key, ratio of names whose matching blocks make more than least of both.

    Of such a pair at most k letters are unmatched, k being 0.174 of the shorter name's length, so that one of k + 1 segments of it
    stands unchanged in the other, at most k places away: names meet only on such a segment.
    """
    from difflib import SequenceMatcher

    n = _names(entities).drop("ws").withColumn("n", F.length("norm"))
    short = n.withColumn("k", F.floor(F.col("n") * 0.174).cast("int")).withColumn("i", F.expr("explode(sequence(0, k))"))
    short = short.selectExpr("instance_id", "kind", "key AS alias_key", "norm AS a", "n AS la", "i", "substring(norm, i * n div (k + 1) + 1, (i + 1) * n div (k + 1) - i * n div (k + 1)) AS seg")
    long = n.selectExpr("instance_id", "kind", "key AS canonical_key", "norm AS b", "n AS lb", "explode(sequence(greatest(1, n - cast(n * 0.15 as int) - 1), n - 1)) AS la").where("la >= 1")
    long = long.withColumn("k", F.floor(F.col("la") * 0.174).cast("int")).withColumn("i", F.expr("explode(sequence(0, k))")).withColumn("at", F.expr("explode(sequence(greatest(0, i * la div (k + 1) - k), i * la div (k + 1) + k))"))
    long = long.selectExpr("instance_id", "kind", "canonical_key", "b", "la", "i", "substring(b, at + 1, (i + 1) * la div (k + 1) - i * la div (k + 1)) AS seg").distinct()
    p = short.join(long, ["instance_id", "kind", "la", "i", "seg"]).where("alias_key <> canonical_key").select("instance_id", "alias_key", "canonical_key", "a", "b").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            x["ratio"] = [SequenceMatcher(None, a, b).ratio() for a, b in zip(x["a"], x["b"], strict=True)]
            yield x[x["ratio"] > least][["instance_id", "alias_key", "canonical_key", "ratio"]]

    return p.mapInPandas(run, "instance_id string, alias_key string, canonical_key string, ratio double")


def alias_links(entities: DataFrame) -> DataFrame:
    """instance_id, alias_key, canonical_key of all near-identical names: by containment or by ratio."""
    keys = ["instance_id", "alias_key", "canonical_key"]
    return alias_containment(entities).select(keys).unionByName(alias_ratio(entities).select(keys)).distinct()


def alias_edges(links: DataFrame) -> DataFrame:
    """src, dst, rid, instance_id: ALIAS_OF edges of alias_links."""
    e = links.select(entity_id("instance_id", "alias_key").alias("src"), entity_id("instance_id", "canonical_key").alias("dst"), "instance_id")
    return e.select("src", "dst", edge_id("src", "ALIAS_OF", "dst").alias("rid"), "instance_id")


def scoped(paths: DataFrame, instance: str = "instance_id", nodes: str = "nodes") -> DataFrame:
    """Paths all of whose nodes (structs with instance_id) are of their own instance."""
    return paths.where(F.forall(nodes, lambda n: n["instance_id"] == F.col(instance)))


def alias_closure(aliases: DataFrame) -> DataFrame:
    """instance_id, alias_key, canonical_key after following all links.

    A key with several aliases follows the largest. Links lead from shorter to longer names, but a key of several names may close a
    circle: then the first key met again counts. Every round doubles the links a walk has followed, until no walk can go on; a walk
    is no longer than the names of one instance differ in length.
    """
    a = aliases.groupBy("instance_id", "alias_key").agg(F.max("canonical_key").alias("canonical_key"))
    a = written(a.select("instance_id", "alias_key", "canonical_key", F.array("alias_key", "canonical_key").alias("walk"), (F.col("alias_key") == F.col("canonical_key")).alias("ended")), "aliases")
    while True:
        onward = a.select("instance_id", F.col("alias_key").alias("canonical_key"), F.col("walk").alias("_on"))
        go = a.select("instance_id", "alias_key", "canonical_key", "walk", "ended").join(onward, ["instance_id", "canonical_key"], "left").withColumn("_go", ~F.col("ended") & F.col("_on").isNotNull())
        go = go.withColumn("walk", F.when(F.col("_go"), F.concat("walk", F.slice("_on", 2, F.size("_on") - 1))).otherwise(F.col("walk")))
        again = F.filter("walk", lambda x, i: F.array_position("walk", x) <= i)
        go = staged(go, _again=F.get(again, F.lit(0)))
        before, a = a, written(go.select("instance_id", "alias_key", F.coalesce("_again", F.element_at("walk", -1)).alias("canonical_key"), "walk", F.col("_again").isNotNull().alias("ended"), "_go"), "aliases")
        discarded(before)
        if a.where("_go").isEmpty():
            return a.select("instance_id", "alias_key", "canonical_key")


def incidence(facts: DataFrame) -> DataFrame:
    """instance_id, fact, entity key: the subject and, if the value is an entity, the object of each fact."""
    object_types = F.create_map(*[F.lit(x) for kv in vocab.OBJECT_TYPES.items() for x in kv])
    f = facts.withColumn("_t", F.coalesce(F.try_element_at(object_types, F.col("predicate")), F.lit("thing")))
    f = f.select("instance_id", F.col("vid").alias("fact"), F.explode(F.array(F.col("subject_key"), F.when(F.col("value_type") == "entity", entity_key("_t", "value_text")))).alias("entity"))
    return f.where("entity is not null and instance_id is not null").distinct()


def adjacent(inc: DataFrame) -> DataFrame:
    """Ordered pairs of entities that share a fact (two edges). A fact has at most two entities, so this is linear in the facts."""
    a, b = inc.select("instance_id", "fact", F.col("entity").alias("a")), inc.select("instance_id", "fact", F.col("entity").alias("b"))
    return a.join(b, ["instance_id", "fact"]).where("a <> b").select("instance_id", "a", "b").distinct()


def connected(anchors: DataFrame, adj: DataFrame) -> DataFrame:
    """instance_id, a, b, hops of the anchor pairs within four edges: adjacent (2), or with a neighbour in common (4).

    Only the neighbours of anchors are looked at; pairs of the whole graph are never formed.
    """
    direct = anchors.join(adj, ["instance_id", "a", "b"]).select("instance_id", "a", "b", F.lit(2).alias("hops"))
    # One step from each first end, whatever the number of its pairs, then one to those that are second ends.
    ends = anchors.select("instance_id", F.col("b").alias("x")).distinct()
    step = anchors.select("instance_id", "a").distinct().join(adj.select("instance_id", "a", F.col("b").alias("m")), ["instance_id", "a"])
    onward = adj.select("instance_id", F.col("a").alias("m"), F.col("b").alias("x")).join(ends, ["instance_id", "x"], "left_semi")
    met = step.join(onward, ["instance_id", "m"]).select("instance_id", "a", F.col("x").alias("b")).distinct()
    far = anchors.join(met, ["instance_id", "a", "b"], "left_semi").select("instance_id", "a", "b", F.lit(4).alias("hops"))
    return direct.unionByName(far).groupBy("instance_id", "a", "b").agg(F.min("hops").alias("hops"))


def fair_limit(paths: DataFrame, signature: str, order: str, limit: int = vocab.PATH_LIMIT) -> DataFrame:
    """At most limit paths, taken in turn from each signature: the first of each, then the second of each, and so on.

    Only the first `limit` of a signature can be taken, so each is cut to that within parts of its order before parts meet.
    """
    p = paths.withColumn("_b", F.pmod(F.xxhash64(order), F.lit(64)))
    for keys in ([signature, "_b"], [signature]):
        p = p.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_n") <= limit)
    return p.orderBy("_n", signature, order).limit(limit).drop("_n", "_b")


def path_rows(anchors: DataFrame, inc: DataFrame, limit: int = vocab.PATH_LIMIT) -> DataFrame:
    """instance_id, a, b, hops, entities, facts of the paths of up to four edges between anchor pairs (instance_id, a, b).

    No node is passed twice. An instance gets at most limit paths, taken in turn from each sequence of entities.
    """
    e = inc.select("instance_id", "fact", "entity")
    edge = lambda x, f, y: e.select("instance_id", F.col("entity").alias(x), F.col("fact").alias(f)).join(e.select("instance_id", F.col("fact").alias(f), F.col("entity").alias(y)), ["instance_id", f]).where(f"{x} <> {y}")
    p = anchors.select("instance_id", "a", "b").where("a <> b").distinct()
    two = p.join(edge("a", "f", "b"), ["instance_id", "a", "b"]).select("instance_id", "a", "b", F.lit(2).alias("hops"), F.array("a", "b").alias("entities"), F.array("f").alias("facts"))
    four = p.join(edge("a", "f", "m"), ["instance_id", "a"]).where("m <> b").join(edge("m", "g", "b"), ["instance_id", "m", "b"]).where("f <> g")
    four = four.select("instance_id", "a", "b", F.lit(4).alias("hops"), F.array("a", "m", "b").alias("entities"), F.array("f", "g").alias("facts"))
    out = two.unionByName(four).withColumn("_b", F.pmod(F.xxhash64("facts"), F.lit(64)))
    # Only the first `limit` of a sequence, and of an instance, can be taken: cut within parts before parts meet.
    for keys in (["instance_id", "entities", "_b"], ["instance_id", "entities"]):
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("facts"))).where(F.col("_n") <= limit)
    for keys in (["instance_id", F.pmod(F.xxhash64("entities"), F.lit(64))], ["instance_id"]):
        out = out.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_n", "entities"))).where(F.col("_r") <= limit)
    return out.drop("_b", "_n", "_r")
