"""Exported inventories as a data source: a row for each JSON line below a folder.

The layout is ``<adapter>/<instance>/<kind>``, a file or a folder of files. A
partition is planned for each file. Conditions on adapter, instance and kind
can be pushed down, so that files are left out before anything is read: with
the option ``pushdown``. Spark keeps what was pushed with the loaded relation,
not with each of its uses, so a load with that option must serve one set of
conditions only; ``objects`` makes one for each call.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "adapter string, instance string, kind string, file string, line long, object string"
_PLACES = ("adapter", "instance", "kind")
BATCH_LINES = 10_000


@dataclass
class ExportFile(InputPartition):
    adapter: str
    instance: str
    kind: str
    path: str


def export_files(folder: str) -> list[ExportFile]:
    """The files of a folder in order; hidden ones and markers don't count."""
    seen = lambda path: sorted(e for e in os.listdir(path) if not e.startswith((".", "_"))) if os.path.isdir(path) else []
    out = []
    for adapter in seen(folder):
        for instance in seen(f"{folder}/{adapter}"):
            for name in seen(f"{folder}/{adapter}/{instance}"):
                path = f"{folder}/{adapter}/{instance}/{name}"
                kind = name.split(".")[0]
                files = [f"{path}/{x}" for x in seen(path)] if os.path.isdir(path) else [path]
                out += [ExportFile(adapter, instance, kind, x) for x in files]
    return out


class InventoryReader(DataSourceReader):
    def __init__(self, folder: str, pushdown: bool) -> None:
        self.folder, self.pushdown = folder, pushdown
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and lists of places; gives the other conditions back to Spark."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, EqualNullSafe, In)) and len(f.attribute) == 1 else None
            if name not in _PLACES or not self.pushdown:
                yield f
                continue
            values = set(f.value) if isinstance(f, In) else {f.value}
            self.wanted[name] = self.wanted.get(name, values) & values

    def partitions(self) -> Sequence[InputPartition]:
        return [x for x in export_files(self.folder) if all(getattr(x, k) in v for k, v in self.wanted.items())] or [ExportFile("", "", "", "")]

    def read(self, partition: ExportFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        place = [partition.adapter, partition.instance, partition.kind, partition.path]

        def batch(lines: list[str], first: int) -> pa.RecordBatch:
            constant = [pa.array([x] * len(lines), pa.string()) for x in place]
            return pa.RecordBatch.from_arrays([*constant, pa.array(range(first, first + len(lines)), pa.int64()), pa.array(lines, pa.string())], ["adapter", "instance", "kind", "file", "line", "object"])

        held, first = [], 0
        with open(partition.path, encoding="utf-8", errors="replace") as f:
            for line in f:
                held.append(line.rstrip("\n"))
                if len(held) == BATCH_LINES:
                    yield batch(held, first)
                    held, first = [], first + BATCH_LINES
        if held:
            yield batch(held, first)


class InventorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> InventoryReader:
        path = self.options.get("path", "")
        path = os.path.join("/", path.removeprefix("file:").lstrip("/")) if path.startswith("file:") else path
        return InventoryReader(path, self.options.get("pushdown", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(InventorySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def objects(spark: SparkSession, folder: str, adapters: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """The exported objects, of some adapters and kinds only if given."""
    register(spark)
    rows = spark.read.format("inventory").option("pushdown", "true").load(folder)
    for name, values in (("adapter", adapters), ("kind", kinds)):
        rows = rows if values is None else rows.where(F.col(name).isin(values))
    return rows
