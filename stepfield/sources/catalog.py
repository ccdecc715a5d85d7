"""Analysis catalog: artefacts as Parquet under a folder, and a table of nodes (path, parent, label, comment, type, metadata).

A node's path is its parent's path and its label, joined by `/`; the root's path is empty."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "path string, parent string, label string, comment string, type string, metadata map<string,string>, version long"


@dataclass
class Catalog:
    """Each change appends rows to the node table; of a path's rows the latest version counts."""

    spark: SparkSession
    root: str

    def nodes(self) -> DataFrame:
        try:
            rows = self.spark.read.schema(NODES).parquet(f"{self.root}/nodes")
            rows.limit(0).collect()
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], NODES)
        return rows.groupBy("path").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "path")), "version").alias("v")).select("path", "v.*")

    def next_label(self, pattern: str, parent: str = "") -> str:
        """A label of the form name* with the smallest number not taken."""
        taken = {r.label for r in self.children(parent).select("label").collect()}
        k = 0
        while pattern.replace("*", str(k)) in taken:
            k += 1
        return pattern.replace("*", str(k))

    def add(self, df: DataFrame, label: str, parent: str = "", kind: str = "table", comment: str | None = None, metadata: dict[str, str] | None = None) -> str:
        """Writes an artefact and its node; an existing one is replaced, with its comment. Returns the path."""
        label = self.next_label(label, parent) if "*" in label else label
        path = f"{parent}/{label}" if parent else label
        version = self.nodes().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0] + 1
        df.write.parquet(f"{self.root}/data/{path}/.v{version}".replace("/.v", "/v"))
        self.spark.createDataFrame([(path, parent, label, comment, kind, metadata or {}, version)], NODES).write.mode("append").parquet(f"{self.root}/nodes")
        return path

    def read(self, path: str) -> DataFrame:
        row = self.nodes().where(F.col("path") == path).first()
        if row is None:
            raise KeyError(path)
        return self.spark.read.parquet(f"{self.root}/data/{path}/v{row.version}")

    def children(self, parent: str = "") -> DataFrame:
        return self.nodes().where(F.col("parent") == parent)

    def subtree(self, path: str) -> DataFrame:
        return self.nodes().where((F.col("path") == path) | F.col("path").startswith(f"{path}/"))

    def paths(self, kind: str | None = None, pattern: str | None = None) -> list[str]:
        rows = self.nodes().where((F.col("type") == kind) if kind else F.lit(True)).select("path").collect()
        return sorted(r.path for r in rows if pattern is None or re.search(pattern, r.path))

    def find(self, path: str, kind: str, which: str = "last") -> list[str] | str | None:
        """Nodes of a type on the way from the root to a path: the first, the last or all."""
        parts = path.split("/")
        on_way = ["/".join(parts[: k + 1]) for k in range(len(parts))]
        kinds = {r.path: r.type for r in self.nodes().where(F.col("path").isin(on_way)).collect()}
        got = [p for p in on_way if kinds.get(p) == kind]
        return got if which == "all" else (got[0 if which == "first" else -1] if got else None)

    def map(self, fn) -> dict[str, object]:
        """fn(path, DataFrame) for every node."""
        return {p: fn(p, self.read(p)) for p in self.paths()}

    def merge(self, other: Catalog) -> list[str]:
        """Nodes of another catalog that this one lacks; nodes that exist are left alone."""
        mine = set(self.paths())
        rows = {r.path: r for r in other.nodes().collect()}
        new = [p for p in sorted(rows) if p not in mine]
        for p in new:
            r = rows[p]
            self.add(other.read(p), r.label, r.parent, r.type, r.comment, dict(r.metadata or {}))
        return new

    def describe(self) -> str:
        """The tree as indented text."""
        rows = {r.path: r for r in self.nodes().collect()}
        return "\n".join("  " * p.count("/") + f"{rows[p].label} <{rows[p].type}>" + (f" # {rows[p].comment}" if rows[p].comment else "") for p in sorted(rows))


def features_of(columns: list[str]) -> dict[str, list[str]]:
    """Map features and their columns: `force_x`, `force_y` are the feature force."""
    out: dict[str, list[str]] = {}
    for c in columns:
        if c in ("cell", "seg"):
            continue
        name = c[:-2] if c[-2:] in ("_x", "_y", "_z") else c
        out.setdefault(name, []).append(c)
    return out


def select_feature(maps: DataFrame, feature: str) -> DataFrame:
    keys = [c for c in ("seg", "cell") if c in maps.columns]
    return maps.select(*keys, *features_of(maps.columns)[feature])


def subset(maps: DataFrame, cells: list[int], reindex: bool = False) -> DataFrame:
    """Maps of some cells; with reindex they are numbered from 0 in the order given."""
    kept = maps.where(F.col("cell").isin(cells))
    if not reindex:
        return kept
    number = F.create_map(*(F.lit(v) for i, c in enumerate(cells) for v in (c, i)))
    return kept.withColumn("cell", F.element_at(number, F.col("cell")))
