"""Named tables: a flat namespace of DataFrames with optional primary keys, and text catalogs that declare them."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .errors import AnalysisError, ParseError
from .types import Type, schema


@dataclass(frozen=True)
class Entry:
    id: int
    name: str
    read: Callable[[], DataFrame]
    pkey: str = ""

    @property
    def schema(self) -> T.StructType:
        return self.read().schema


class Catalog:
    """Tables by name and by id; a name that is added again gets the new table. A primary key is a note for planning only."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._by_name: dict[str, Entry] = {}

    def add(self, name: str, table: DataFrame | Callable[[], DataFrame], pkey: str = "", source: str | None = None) -> Entry:
        """table: a DataFrame, or a function that gives the current one, which is not asked before the table is used.
        source: what the id is made of (the name if none)."""
        read = table if callable(table) else lambda: table
        entry = Entry(zlib.crc32((source or name).encode()), name, read, pkey)
        self._by_name = {k: e for k, e in self._by_name.items() if e.id != entry.id} | {name: entry}
        return entry

    def add_parquet(self, name: str, path: str, pkey: str = "") -> Entry:
        """A Parquet table; its footers are read when a query first names it."""
        return self.add(name, cache(lambda: self.spark.read.parquet(path)), pkey, path)

    def entry(self, table: str | int) -> Entry:
        for e in self._by_name.values():
            if table in (e.name, e.id):
                return e
        raise AnalysisError(f"no table {table!r}")

    def table_id(self, name: str) -> int:
        return self.entry(name).id

    def name(self, table_id: int) -> str:
        return self.entry(table_id).name

    def schema(self, table: str | int) -> T.StructType:
        return self.entry(table).schema

    def primary_key(self, table: str | int) -> str:
        return self.entry(table).pkey

    def frame(self, table: str | int) -> DataFrame:
        return self.entry(table).read()

    def __contains__(self, name: str) -> bool:
        return name in self._by_name

    def __iter__(self) -> Iterator[Entry]:
        return iter(self._by_name.values())

    def clear(self) -> None:
        self._by_name = {}

    def views(self) -> None:
        """Each table as a temporary view of its name, for spark.sql."""
        for e in self:
            e.read().createOrReplaceTempView(e.name)

    def load(self, path: str) -> list[Entry]:
        """A catalog file: for each table it declares, <folder>/<name>.dat in the paged format, or else <name>.parquet."""
        from .sources.heapfile import read_heap

        folder = os.path.dirname(os.path.abspath(path))
        with open(path) as f:
            declared = parse_catalog(f.read())
        out = []
        for name, s, pkey in declared:
            dat = os.path.join(folder, f"{name}.dat")
            frame = read_heap(self.spark, dat, s) if os.path.exists(dat) else self.spark.read.schema(s).parquet(os.path.join(folder, f"{name}.parquet"))
            out.append(self.add(name, frame, pkey, dat))
        return out


def parse_catalog(text: str) -> list[tuple[str, T.StructType, str]]:
    """Lines ``name (field type [pk], ...)`` -> (name, schema, primary key or "")."""
    out = []
    for number, line in enumerate(text.splitlines(), 1):
        if not line.strip():
            continue
        m = re.fullmatch(r"\s*(\w+)\s*\((.*)\)\s*", line)
        if not m:
            raise ParseError(f"line {number} of the catalog: {line.strip()!r}")
        names, types, pkey = [], [], ""
        for field in m[2].split(","):
            words = field.split()
            if len(words) not in (2, 3):
                raise ParseError(f"line {number} of the catalog: field {field.strip()!r}")
            names.append(words[0])
            types.append(Type.named(words[1]))
            if len(words) == 3:
                if words[2] != "pk":
                    raise ParseError(f"line {number} of the catalog: annotation {words[2]!r}")
                pkey = words[0]
        out.append((m[1], schema(types, names), pkey))
    return out
