"""A memory over versioned tables: add, search, get_all, history, delete, explain."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import vocab
from factloom.functions.ids import batch_keys, session_id, session_key
from factloom.functions.windows import day_label
from factloom.operators import answer, chain, gates, graph, merge, retrieval
from factloom.sources.store import Snapshots

FACTS = """vid bigint, fact_id string, instance_id string, subject_vid bigint, subject_key string, predicate string, value_text string, value_type string, valid_from bigint, valid_to bigint, asserted_at bigint,
session_id string, turn_idx int, role string, snippet string, confidence double, status string, superseded_by bigint"""


ENTITIES = "vid bigint, key string, skey string, name string, entity_type string, first_seen int, last_seen int, instance_id string"
SESSIONS = "vid bigint, key string, idx int, instance_id string, received_at timestamp"
EDGES = "src bigint, dst bigint, rid bigint, type string, instance_id string"
BATCHES = "key string"
FAILURES = "instance_id string, session_id string, error string"
EXTRACTED = """instance_id string, session_id string, subject string, subject_type string, predicate string, value_text string, value_is_entity boolean, valid_from_hint string, confidence double, turn_ref string, evidence_span string, error string"""
FIELDS = ["subject", "subject_type", "predicate", "value_text", "value_is_entity", "valid_from_hint", "confidence", "turn_ref", "evidence_span"]


class Memory:
    """The stored facts and entities of any number of tenants.

    add() takes extractions with their sessions and turns; facts already stored are left alone, and the chains of the slots that
    were touched are derived again over all their facts, so that the order of arrival makes no difference. A deleted fact stays
    deleted. Every write is a new version; reads can pin one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Snapshots(spark, root)

    def facts(self, version: int | None = None) -> DataFrame:
        df = self.store.read("facts", version)
        return self.spark.createDataFrame([], FACTS) if df is None else df

    def _table(self, name: str, schema: str) -> DataFrame:
        df = self.store.read(name)
        return self.spark.createDataFrame([], schema) if df is None else df

    def entities(self) -> DataFrame:
        return self._table("entities", ENTITIES)

    def sessions(self) -> DataFrame:
        return self._table("sessions", SESSIONS)

    def edges(self) -> DataFrame:
        return self._table("edges", EDGES)

    def failures(self) -> DataFrame:
        """The sessions whose extraction failed, with the error."""
        return self._table("failures", FAILURES)

    def add(self, extracted: DataFrame, sessions: DataFrame, turns: DataFrame, failed: DataFrame | None = None) -> int:
        """Adds extractions; a batch that was added before, by its content, changes nothing. Returns the version."""
        x = extracted.withColumn("_b", F.lit(0))
        key = batch_keys(x, "_b", [c for c in extracted.columns if c != "extract_id"], "extractions").select("key").first()
        done = self._table("batches", BATCHES)
        if key is not None and not done.where(F.col("key") == key.key).isEmpty():
            return self.store.versions("facts")[-1]
        t = graph.touched(extracted, sessions, turns)
        f = graph.fact_rows(t)
        s = sessions.where("key is not null and instance_id is not null").select(session_id("instance_id", "key").alias("vid"), "key", F.coalesce("idx", F.lit(0)).alias("idx"), "instance_id", F.col("received_at").cast("timestamp").alias("received_at"))
        more = {"batches": done.unionByName(self.spark.createDataFrame([] if key is None else [(key.key,)], BATCHES))}
        if failed is not None:
            more["failures"] = self.failures().unionByName(failed)
        return self.add_rows(f.drop("object_key"), graph.entity_rows(t), s, graph.fact_edges(f), more)

    def add_messages(self, messages: DataFrame, extract: Callable[[str, str], list[dict]]) -> int:
        """Adds conversations (user_id, messages array<struct<role, content>>, timestamp) through an extractor of (transcript, date).

        A conversation's key comes from its messages: added again, it is the same session. One whose extraction raises, or gives
        something else than facts, is named in failures() and doesn't stop the others.
        """
        m = messages.where("user_id is not null and messages is not null").withColumn("key", session_key("messages"))
        m = merge.first_wins(m.select(F.col("user_id").alias("instance_id"), "key", "messages", "timestamp"), ["instance_id", "key"], F.col("timestamp"))
        m = m.join(self.sessions().select("instance_id", "key"), ["instance_id", "key"], "left_anti")
        before = self.sessions().groupBy("instance_id").agg((F.max("idx") + 1).alias("_n"))
        w = Window.partitionBy("instance_id").orderBy("timestamp", "key")  # the new sessions of one tenant
        m = m.join(before, "instance_id", "left").withColumn("idx", (F.coalesce("_n", F.lit(0)) + F.row_number().over(w) - 1).cast("int"))
        sessions = m.select(session_id("instance_id", "key").alias("vid"), "key", "idx", "instance_id", F.timestamp_seconds("timestamp").alias("received_at"))
        turns = m.select("instance_id", F.col("key").alias("session_id"), F.posexplode("messages").alias("idx", "t")).select(F.xxhash64("session_id", "idx").alias("turn_id"), "instance_id", "session_id", "idx", "t.role", "t.content")
        said = turns.groupBy("instance_id", "session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", retrieval.turn_line().alias("line")))), lambda x: x["line"]), "\n").alias("text"))
        asked = said.join(m.select("instance_id", F.col("key").alias("session_id"), F.concat(day_label(F.col("timestamp")), F.date_format(F.timestamp_seconds("timestamp"), " HH:mm")).alias("date")), ["instance_id", "session_id"])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for i, s, text, date in zip(b["instance_id"], b["session_id"], b["text"], b["date"], strict=True):
                    try:
                        rows += [(i, s, *[f.get(c) for c in FIELDS], None) for f in extract(text, date)]
                    except Exception as e:
                        rows.append((i, s, *[None] * len(FIELDS), str(e)[:200] or type(e).__name__))
                yield pd.DataFrame(rows, columns=["instance_id", "session_id", *FIELDS, "error"])

        self.store.write("extracted", asked.mapInPandas(run, EXTRACTED))  # the extractor is called once for each session
        x = self.store.read("extracted")
        kept = x.where("error is null").withColumn("extract_id", F.xxhash64("instance_id", "session_id", *[F.col(c).cast("string") for c in FIELDS])).drop("error")
        self.store.write_all({"new_sessions": sessions, "new_turns": turns})
        return self.add(kept, self.store.read("new_sessions"), self.store.read("new_turns"), x.where("error is not null").select("instance_id", "session_id", "error"))

    def add_rows(self, facts: DataFrame, entities: DataFrame | None = None, sessions: DataFrame | None = None, edges: DataFrame | None = None, more: dict[str, DataFrame] | None = None) -> int:
        """Adds rows of each table, all valid together with one commit. Edges whose ends are not stored are refused."""
        out = dict(more or {})
        if entities is not None:
            old = self.entities().withColumn("_at", F.lit(0))
            both = old.unionByName(entities.withColumn("_at", F.lit(1)))
            merged = merge.guarded_merge(both, ["vid"], F.col("last_seen"), F.col("_at"), ("first_seen",)).drop("_at")
            out["entities"] = merged.select("vid", "key", "skey", "name", "entity_type", "first_seen", "last_seen", "instance_id")
        if sessions is not None:
            out["sessions"] = merge.last_wins(self.sessions().unionByName(sessions), ["vid"], F.col("received_at")).select("vid", "key", "idx", "instance_id", "received_at")
        stored = self.facts().withColumn("_at", F.lit(0))
        fresh = facts.withColumn("superseded_by", F.lit(None).cast("bigint")).withColumn("_at", F.lit(1))
        merged = merge.guarded_merge(stored.unionByName(fresh.select(stored.columns)), ["vid"], F.col("asserted_at"), F.col("_at")).drop("_at")
        out["facts"] = self._reconciled(merged, facts)
        if edges is not None:
            links = graph.alias_edges(graph.alias_links(out["entities"])).withColumn("type", F.lit("ALIAS_OF"))
            follow = graph.session_edges(out["sessions"]).withColumn("type", F.lit("NEXT"))
            old = self.edges().where("type in ('SUBJECT', 'OBJECT', 'ASSERTED_IN')")
            own = merge.linked(old.unionByName(edges.select(*old.columns)), {"src": out["facts"], "dst": out["entities"].select("vid").unionByName(out["sessions"].select("vid"))})
            over = out["facts"].where("superseded_by is not null").select(F.col("superseded_by").alias("src"), F.col("vid").alias("dst"), graph.edge_id("superseded_by", "SUPERSEDES", "vid").alias("rid"), F.lit("SUPERSEDES").alias("type"), "instance_id")
            cols = ["src", "dst", "rid", "type", "instance_id"]
            out["edges"] = own.select(cols).unionByName(links.select(cols)).unionByName(follow.select(cols)).unionByName(over)
        return self.store.write_all(out)

    def _reconciled(self, all_: DataFrame, touched: DataFrame) -> DataFrame:
        slots = touched.withColumn("slot", chain.slot()).select("instance_id", "subject_vid", "predicate", "slot").distinct()
        a = all_.withColumn("slot", chain.slot())
        keys = ["instance_id", "subject_vid", "predicate", "slot"]
        work, rest = a.join(slots, keys, "left_semi").drop("slot"), a.join(slots, keys, "left_anti").drop("slot")
        dead = work.where("status = 'deleted'")
        live = chain.superseded(work.where("status <> 'deleted' or status is null").drop("superseded_by")).drop("slot")
        return rest.unionByName(dead.select(rest.columns)).unionByName(live.select(rest.columns))

    def get_all(self, instance_id: str, version: int | None = None) -> DataFrame:
        return chain.current(self.facts(version).where(F.col("instance_id") == instance_id), missing_is_current=False)

    def history(self, fact_id: str) -> DataFrame:
        """The facts of the slot that a fact is in, oldest first."""
        f = self.facts().withColumn("slot", chain.slot())
        one = f.where(F.col("fact_id") == fact_id).select("instance_id", "subject_vid", "predicate", "slot")
        return f.join(F.broadcast(one), ["instance_id", "subject_vid", "predicate", "slot"], "left_semi").drop("slot").orderBy("asserted_at", "turn_idx", "vid")

    def delete(self, fact_id: str, at: int) -> bool:
        """Marks a fact deleted as of a time; False if it isn't there or is deleted."""
        f = self.facts()
        mine = F.col("fact_id") == fact_id
        if f.where(mine & (F.col("status") != "deleted")).isEmpty():
            return False
        end = F.greatest(F.lit(at), F.col("valid_from") + 1, F.col("valid_to") + 1)
        self.store.write("facts", f.withColumns({"valid_to": F.when(mine, end).otherwise(F.col("valid_to")).cast("bigint"), "status": F.when(mine, "deleted").otherwise(F.col("status"))}).select(f.columns))
        return True

    def search(self, questions: DataFrame) -> DataFrame:
        """The verdict of the cascade on each question (instance_id, question, asked_at)."""
        e = self.entities()
        return gates.cascade(questions, e, self.facts(), graph.alias_closure(graph.alias_links(e)))

    def requests(self, questions: DataFrame) -> DataFrame:
        """What a reader is to be asked about the questions, at its first and second look."""
        return answer.requests(questions, self.facts(), self.entities())

    def answer(self, questions: DataFrame, replies: DataFrame, appeals: bool = True) -> DataFrame:
        """The answers or abstentions that a reader's replies come to, see operators.answer."""
        e = self.entities()
        return answer.answered(questions, e, self.facts(), graph.alias_closure(graph.alias_links(e)), replies, appeals)

    def evidence(self, questions: DataFrame) -> DataFrame:
        """The lines a reader gets for the questions that pass."""
        ok = self.search(questions).where("passed").select("instance_id")
        kept = retrieval.narrowed(questions.join(ok, "instance_id", "left_semi"), self.facts())
        named = self.facts().join(self.entities().select(F.col("vid").alias("subject_vid"), F.col("name").alias("subject_name")), "subject_vid", "left")
        return named.join(kept, ["instance_id", "vid"], "left_semi").select("instance_id", "vid", "asserted_at", retrieval.fact_line(vocab.MAX_SPAN).alias("line"))

    def explain(self, answers: DataFrame) -> DataFrame:
        """instance_id, text: the trace of each answer, with where every cited fact comes from."""
        return answer.explained(answers, self.facts(), self.entities())
