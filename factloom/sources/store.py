"""Versioned tables on plain Parquet: a version is a folder, valid once its commit file is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Snapshots:
    """Tables below a root, each with numbered versions. A reader pins a version; a failed write leaves no trace in it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def versions(self, name: str) -> list[int]:
        """The versions of a table that a commit, its own or a shared one, made valid."""
        own = {int(n) for n in self._names(f"{self.root}/{name}/commits") if n.isdigit()}
        shared = {int(n.partition("+")[0]) for n in self._names(f"{self.root}/commits") if name in n.split("+")[1:]}
        return sorted(own | shared)

    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        """Writes the next version and returns its number, the bookmark of the write."""
        return self.write_all({name: df}, partition_by)

    def write_all(self, tables: dict[str, DataFrame], partition_by: tuple[str, ...] = ()) -> int:
        """Writes the next version of several tables, valid together with one commit file: a failure leaves none of them changed."""
        version = 1 + max(max(self.versions(n), default=0) for n in tables)
        for name, df in tables.items():
            writer = df.write.mode("overwrite")
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{name}/v{version}")
        self._fs.create(self._path(f"{self.root}/commits/{'+'.join([str(version), *tables])}"), True).close()
        return version

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        all_ = self.versions(name)
        if not all_ or version is not None and version not in all_:
            return None
        return self.spark.read.parquet(f"{self.root}/{name}/v{version or all_[-1]}")


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


#: Rows of a report that are rendered on the driver; a longer one belongs into a table of its own.
REPORT = 10_000


def markdown(df: DataFrame) -> str:
    """A small report table as Markdown, whole. Raises for one of more than REPORT rows rather than cutting it."""
    rows = df.limit(REPORT + 1).collect()
    if len(rows) > REPORT:
        raise ValueError(f"more than {REPORT} rows are no report")
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return head + "".join("\n| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)


def report(title: str, parts: dict[str, DataFrame | str]) -> str:
    """A report of sections, each a table or a text."""
    return f"# {title}\n" + "".join(f"\n## {name}\n\n{part if isinstance(part, str) else markdown(part)}\n" for name, part in parts.items())


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A report as one file, in whatever file system the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
