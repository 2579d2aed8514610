import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    os.environ["TZ"] = "UTC"
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    return DATA


def compare(spark, name, fn, sql, folder):
    """Rows of a query against its SQL in DuckDB over the same tables."""
    import math
    from collections import Counter

    import duckdb

    def norm(v):
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return tuple(map(norm, v)) if isinstance(v, list | tuple) else v

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(folder).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = fn(spark, folder)
    cols = sorted(df.columns)
    ours = Counter(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == cols, name
    at = [names.index(c) for c in cols]
    theirs = Counter(repr(tuple(norm(r[i]) for i in at)) for r in found.fetchall())
    assert ours == theirs, (name, list((ours - theirs))[:2], list((theirs - ours))[:2])


def variants(spark, data, folder):
    """Folders with the tables of a problem emptied, with rows of nulls only, and with every row twice and a further column."""
    from pyspark.sql import functions as F

    names = ["sessions", "extracted_facts", "facts", "canon_predicates", "results", "entities", "turns", "documents", "eval_items"]
    for n in names:
        t = spark.read.parquet(f"{data}/{n}.parquet")
        few = t.limit(40) if n != "canon_predicates" else t
        nulls = few.select(*[F.lit(None).cast(x.dataType).alias(x.name) for x in t.schema]).limit(3)
        for kind, df in (("empty", t.limit(0)), ("nulls", nulls), ("twice", few.unionByName(few).withColumn("key" if "key" not in t.columns else "text", F.lit("clash")) if n not in ("documents", "eval_items", "turns") else few.unionByName(few).withColumn("key", F.lit("clash")))):
            df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{kind}/{n}.parquet")
    return folder
