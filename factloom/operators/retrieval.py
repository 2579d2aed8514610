"""What reaches a reader: transcripts, chunks, rendered facts, narrowed fact sets, evidence, nearest vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import vocab
from factloom.functions.text import words
from factloom.functions.windows import day_label
from factloom.operators.chain import predecessors, slot


def turn_line() -> Column:
    return F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("content", F.lit("")))


def transcripts(turns: DataFrame) -> DataFrame:
    """session_id, text: the lines of a session by idx. A session is the unit a reader gets whole, so its lines meet in one row."""
    t = turns.where("session_id is not null").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("idx", "turn_id", turn_line().alias("line")))).alias("l"))
    return t.select("session_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def chunks(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """turn_id, chunk: one dated line per turn."""
    s = sessions.select(F.col("key").alias("session_id"), F.col("idx").alias("session_idx"), F.unix_timestamp("received_at").alias("said_at"))
    t = turns.join(s, "session_id")
    line = F.concat(F.lit("["), day_label(F.col("said_at")), F.lit("] session "), F.col("session_idx").cast("string"), F.lit(", turn "), F.col("idx").cast("string"), F.lit(" ("), F.coalesce("role", F.lit("")), F.lit("): "), F.coalesce("content", F.lit("")))
    return t.select("turn_id", line.alias("chunk"))


def fact_line(width: int | None = None) -> Column:
    snippet = F.coalesce("snippet", F.lit(""))
    snippet = F.substring(snippet, 1, width) if width else snippet
    ended = F.when(F.coalesce("valid_to", F.lit(0)) != 0, F.concat(F.lit(" [superseded "), day_label(F.col("valid_to")), F.lit("]"))).otherwise("")
    return F.concat("fact_id", F.lit(" | "), day_label(F.coalesce("valid_from", F.lit(0))), F.lit(" | "), F.coalesce("subject_name", F.lit("")), F.lit(" | "), "predicate", F.lit(" | "), F.coalesce("value_text", F.lit("")), F.lit(' | "'), snippet, F.lit('"'), ended)


def relevance(question: Column) -> Column:
    """How many words a question shares with a fact's predicate, value and snippet."""
    text = F.concat_ws(" ", "predicate", F.coalesce("value_text", F.lit("")), F.coalesce("snippet", F.lit("")))
    return F.size(F.array_intersect(words(question), words(text)))


def narrowed(questions: DataFrame, facts: DataFrame, cap: int = vocab.NARROW_CAP) -> DataFrame:
    """instance_id, vid of the facts kept for each question: whole supersession groups, most relevant first, until cap are kept.

    Instances of at most cap facts keep all. Groups are ranked over the groups of an instance that share words with the question
    or, among the others, in order of first assertion; the running count is taken score by score (scores are small whole
    numbers) before it is taken within a score.
    """
    f = facts.join(questions.select("instance_id", "question"), "instance_id")
    f = f.select("instance_id", "vid", "subject_key", "predicate", slot().alias("slot"), "asserted_at", relevance(F.coalesce("question", F.lit(""))).alias("score"))
    keys = ["instance_id", "subject_key", "predicate", "slot"]
    g = f.groupBy(*keys).agg(F.max("score").alias("score"), F.count("*").alias("n"), F.min(F.struct("asserted_at", "vid")).alias("o"))
    # Two levels: counts of whole score classes, then a running count within one class and one bucket of first assertions.
    g = g.withColumn("b", F.floor(F.coalesce(F.col("o.asserted_at"), F.lit(0)) / 2_629_746))
    buckets = g.groupBy("instance_id", "score", "b").agg(F.sum("n").alias("bn"))
    over = Window.partitionBy("instance_id").orderBy(F.desc("score"), "b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("instance_id")
    buckets = buckets.select("instance_id", "score", "b", F.coalesce(F.sum("bn").over(over), F.lit(0)).alias("before"), F.sum("bn").over(every).alias("total"))
    inner = Window.partitionBy("instance_id", "score", "b").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("within", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(buckets, ["instance_id", "score", "b"])
    kept = g.where((F.col("total") <= cap) | (F.col("before") + F.col("within") < cap)).select(*keys)
    on = [f[k].eqNullSafe(kept[k]) for k in keys]
    return f.join(kept, on, "left_semi").select("instance_id", "vid")


def grounded_rows(clean: DataFrame, turns: DataFrame) -> DataFrame:
    """clean with grounded: whether the span of each extraction stands in its session's transcript.

    Spans are looked for session by session: a transcript is joined once, to the distinct spans of its session.
    """
    from factloom.functions.text import grounded

    spans = clean.where("session_id is not null and trim(evidence_span) <> ''").groupBy("session_id").agg(F.collect_set("evidence_span").alias("spans"))  # one session's extractions
    hits = spans.join(transcripts(turns), "session_id").select("session_id", F.explode(F.filter("spans", lambda s: grounded(s, F.col("text")))).alias("evidence_span"), F.lit(True).alias("_hit"))
    return clean.join(hits, ["session_id", "evidence_span"], "left").withColumn("grounded", F.coalesce("_hit", F.lit(False))).drop("_hit")


def evidence(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """One row for each cited fact that is stored, in the order cited, with its role and the fact it replaced."""
    from factloom.operators.gates import cited_ids

    c = answers.select("id", "instance_id", F.posexplode(cited_ids(F.col("cited")))).toDF("id", "instance_id", "pos", "fact_id")
    r = predecessors(facts).groupBy("instance_id", "fact_id").agg(F.min("replaced").alias("replaced"))
    f = facts.select("instance_id", "fact_id", "predicate", F.coalesce("value_text", F.lit("")).alias("value"), "session_id", "turn_idx", F.when(F.coalesce("role", F.lit("")) == "", "unknown").otherwise(F.col("role")).alias("role"), F.coalesce("valid_from", F.lit(0)).alias("valid_from"), F.coalesce("valid_to", F.lit(0)).alias("valid_to"))
    return c.join(f, ["instance_id", "fact_id"]).join(r, ["instance_id", "fact_id"], "left").select("id", "pos", "fact_id", "predicate", "value", "session_id", "turn_idx", "role", "valid_from", "valid_to", F.coalesce("replaced", F.lit("")).alias("supersedes"))


def _packed(vectors: DataFrame, at_once: int = 2048) -> DataFrame:
    """ids, m: blocks of at most at_once vectors of one length, as a matrix in bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, part in b.groupby(b["embedding"].map(len)):
                for a in range(0, len(part), at_once):
                    p = part.iloc[a : a + at_once]
                    yield pd.DataFrame({"ids": [p["vec_id"].to_numpy()], "m": [np.array(p["embedding"].tolist(), np.float64).tobytes()]})

    v = vectors.select("vec_id", "embedding").where("vec_id is not null and embedding is not null and size(embedding) > 0")
    return v.mapInPandas(run, "ids array<bigint>, m binary")


def nearest(queries: DataFrame, vectors: DataFrame, k: int = vocab.TOP_K) -> DataFrame:
    """query_id, vec_id, score, rank: the k vectors of the largest dot product with each query, ties by id.

    Queries and vectors are packed into blocks; every block of the stated query set is held against every block of vectors by
    one matrix product, which keeps its k best for each query before anything else moves. Neither side is collected. Vectors of
    another length than the query's, null and empty ones are left out; repeated vectors are each ranked.
    """
    q = _packed(queries).select(F.col("ids").alias("qids"), F.col("m").alias("qm"))
    blocks = _packed(vectors).crossJoin(q)  # blocks of a stated query set against blocks of all rows

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, m, qids, qm in zip(b["ids"], b["m"], b["qids"], b["qm"], strict=True):
                x, y = np.frombuffer(m).reshape(len(ids), -1), np.frombuffer(qm).reshape(len(qids), -1)
                if x.shape[1] != y.shape[1]:
                    continue
                vid, s = np.asarray(ids, np.int64), np.round(y @ x.T, 9)
                for j, query in enumerate(qids):
                    order = np.lexsort((vid, -s[j]))[:k]
                    yield pd.DataFrame({"query_id": query, "vec_id": vid[order], "score": s[j, order]})

    top = blocks.mapInPandas(best, "query_id bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Vectors that the cells are fitted on, cells, rounds of fitting, and cells probed for a query. Vectors without clusters, as those
#: of the test tables, need many probes: 16 of the 64 cells keep 72 to 76 % of the nearest ten, 32 keep 89 to 94 %, 40 keep 95 to 98 %.
SAMPLE, CELLS, ROUNDS, PROBES = 20_000, 64, 8, 40


def cells(vectors: DataFrame, n: int = CELLS, sample: int = SAMPLE) -> np.ndarray:
    """Centres of n cells, fitted by k-means on at most sample vectors (those of the smallest hashes); every vector is indexed."""
    rows = vectors.where("embedding is not null and size(embedding) > 0").withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id").limit(sample).select("embedding").collect()
    lengths = pd.Series([len(r[0]) for r in rows])
    if not len(lengths):
        return np.zeros((0, 0))
    x = np.array([r[0] for r in rows if len(r[0]) == lengths.mode()[0]], np.float64)
    centres = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        of = np.argmax(x @ centres.T - (centres**2).sum(1) / 2, axis=1)
        for c in range(len(centres)):
            if (of == c).any():
                centres[c] = x[of == c].mean(0)
    return centres


def nearest_by_cells(queries: DataFrame, vectors: DataFrame, k: int = vocab.TOP_K, centres: np.ndarray | None = None, probes: int = PROBES) -> DataFrame:
    """query_id, vec_id, score, rank like nearest(), over the vectors of the probes cells whose centres are nearest to each query.

    Vectors and queries are dealt to cells, a cell to salted parts, so that vectors of one cell that holds most of them are spread;
    within a part the queries meet its vectors in blocks. Vectors of another length than the centres' belong to no cell and are
    left to nearest(). Recall against nearest() is measured in the tests.
    """
    centres = cells(vectors) if centres is None else centres
    if not len(centres):
        return nearest(queries, vectors, k)
    held = vectors.sparkSession.sparkContext.broadcast(centres)  # n cells, whatever the number of vectors is
    parts = 8

    def dealt(many: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c = held.value
            for b in batches:
                b = b[b["embedding"].map(len) == c.shape[1]]
                if len(b):
                    x = np.array(b["embedding"].tolist(), np.float64)
                    order = np.argsort(-(x @ c.T - (c**2).sum(1) / 2), axis=1)[:, :many]
                    yield pd.DataFrame({"vec_id": b["vec_id"].to_numpy().repeat(order.shape[1]), "embedding": [e for e in b["embedding"] for _ in range(order.shape[1])], "cell": order.ravel()})

        return run

    schema = "vec_id bigint, embedding array<double>, cell int"
    dense = lambda df: df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    v = dense(vectors).mapInPandas(dealt(1), schema).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)))
    q = dense(queries).mapInPandas(dealt(probes), schema).withColumn("part", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(parts)])))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, vid, out = np.array(left["embedding"].tolist()), left["vec_id"].to_numpy(), []
        for a in range(0, len(right), 1024):
            block = right.iloc[a : a + 1024]
            s = np.round(np.array(block["embedding"].tolist()) @ x.T, 9)
            for j, query in enumerate(block["vec_id"]):
                order = np.lexsort((vid, -s[j]))[:k]
                out.append(pd.DataFrame({"query_id": query, "vec_id": vid[order], "score": s[j, order]}))
        return pd.concat(out)

    top = v.groupBy("cell", "part").cogroup(q.groupBy("cell", "part")).applyInPandas(best, "query_id bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
