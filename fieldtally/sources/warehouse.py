"""Typed tables in versions, with the partial sums reports need and the filter values that occur.

A folder of data is never written twice.  Each publication writes its years to folders of its own
and then names, in one manifest, the folders that count from now on; a reader keeps to the
manifest it began with, so it never sees half a table.  Years that didn't change keep their
folders.  Old folders go when no recent manifest names them.

    <path>/data/<table>/version=<id>/year=<year>/...    parquet
    <path>/manifest/<number>                            JSON: the folders by table and year
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fieldtally.operators.lookups import Codebook
from fieldtally.plans.cells import CELLS
from fieldtally.plans.options import facets
from fieldtally.plans.typed import SurveyTables
from fieldtally.sources.staging import FACETS, NAMES

#: The folder name Spark gives to a missing year.
NO_YEAR = "__HIVE_DEFAULT_PARTITION__"


class Folder:
    """Small files and listings of a folder in any store that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path, spark._jvm
        self._files = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def names(self, *inside: str) -> list[str]:
        if not self._files.exists(self._at(*inside)):
            return []
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._at(*inside)))

    def read(self, *names: str) -> str:
        stream = self._files.open(self._at(*names))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, text: str, *names: str) -> bool:
        """Writes a new file whole; not if there is one of that name already."""
        draft = [*names[:-1], f".{names[-1]}-{uuid.uuid4().hex}"]
        stream = self._files.create(self._at(*draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._files.exists(self._at(*names)) and self._files.rename(self._at(*draft), self._at(*names)):
            return True
        self._files.delete(self._at(*draft), False)
        return False

    def age_hours(self, *names: str) -> float:
        changed = self._files.getFileStatus(self._at(*names)).getModificationTime()
        return time.time() / 3600 - changed / 3_600_000

    def remove(self, *names: str) -> None:
        self._files.delete(self._at(*names), True)


class Warehouse(SurveyTables):
    """The tables of one manifest, the newest when it is opened.

    Reports read the kept cells instead of rows, and option lists the kept filter values.
    """

    def __init__(self, spark: SparkSession, path: str, codes: Codebook):
        self.codes, self._spark, self._path = codes, spark, path
        self._folder = Folder(spark, path)
        numbers = [n for n in self._folder.names("manifest") if n.isdigit()]
        self.number = int(numbers[-1]) if numbers else 0
        held = json.loads(self._folder.read("manifest", numbers[-1])) if numbers else {}
        #: By table its schema, and by year the version that counts.
        self._tables: dict[str, dict] = held.get("tables", {})
        #: By stream the number of its last batch that is in.
        self.batches: dict[str, int] = held.get("batches", {})

    def read(self, name: str, years: Iterable[int | None] | None = None) -> DataFrame:
        """A table, or some years of it."""
        held = self._tables[name]
        schema = T.StructType.fromJson(held["schema"])
        wanted = held["years"] if years is None else {y: v for y, v in held["years"].items() if y in set(map(_folder_of, years))}
        base = f"{self._path}/data/{name}"
        folders = [f"{base}/version={version}/year={year}" for year, version in wanted.items()]
        if not folders:
            return self._spark.createDataFrame([], schema)
        # data columns first, then those of the folders, as Spark reads them
        full = T.StructType([*[f for f in schema.fields if f.name != "year"], T.StructField("version", T.StringType()), schema["year"]])
        return self._spark.read.schema(full).option("basePath", base).parquet(*folders).select(*schema.names)

    @property
    def is_empty(self) -> bool:
        return not self._tables

    @cached_property
    def capture(self) -> DataFrame:
        return self.read("capture")

    @cached_property
    def aquaculture(self) -> DataFrame:
        return self.read("aquaculture")

    @cached_property
    def processing(self) -> DataFrame:
        return self.read("processing")

    @cached_property
    def patrol(self) -> DataFrame:
        return self.read("patrol")

    @cached_property
    def capture_cells(self) -> DataFrame:
        return self.read("capture_cells")

    @cached_property
    def aquaculture_cells(self) -> DataFrame:
        return self.read("aquaculture_cells")

    @cached_property
    def patrol_cells(self) -> DataFrame:
        return self.read("patrol_cells")

    @cached_property
    def offered(self) -> tuple[DataFrame, ...]:
        return (self.read("facets").select(*FACETS),)

    # publishing

    def publish(
        self, tables: Mapping[str, DataFrame], years: Iterable[int | None] | None = None, batch: tuple[str, int] | None = None
    ) -> "Warehouse":
        """Replaces some years of the four typed tables, or all of them, and gives the tables as they are then.

        ``tables`` has all rows of these years.  Cells and filter values are made of what has been
        written.  ``batch`` notes a stream's batch in the same step.  Fails if another publication
        has come between; nothing is changed then.
        """
        version = uuid.uuid4().hex
        replaced = None if years is None else set(map(_folder_of, years))
        found = {name: dict(held) for name, held in self._tables.items()}

        def put(name: str, df: DataFrame, write: Callable[[DataFrame, str], None]) -> None:
            target = f"{self._path}/data/{name}/version={version}"
            write(df, target)
            new = [n.partition("=")[2] for n in self._folder.names("data", name, f"version={version}") if n.startswith("year=")]
            kept = found.get(name, {}).get("years", {})
            kept = {} if replaced is None else {y: v for y, v in kept.items() if y not in replaced}
            found[name] = {"schema": df.schema.jsonValue(), "years": kept | dict.fromkeys(new, version)}

        for name in NAMES:
            put(name, tables[name], _even)
        new = {name: self._written(name, version, found) for name in NAMES}
        for name, cells in CELLS.items():
            put(f"{name}_cells", cells(new[name]), _small)
        put("facets", facets(new.values()).select(*FACETS), _small)
        batches = self.batches | ({batch[0]: batch[1]} if batch else {})
        manifest = json.dumps({"tables": found, "batches": batches})
        if not self._folder.write(manifest, "manifest", f"{self.number + 1:020}"):
            raise RuntimeError("another publication has come between; open the tables anew and publish again")
        return Warehouse(self._spark, self._path, self.codes)

    def _written(self, name: str, version: str, found: Mapping[str, dict]) -> DataFrame:
        one = Warehouse.__new__(Warehouse)
        one._spark, one._path = self._spark, self._path
        held = found[name]
        one._tables = {name: {"schema": held["schema"], "years": {y: v for y, v in held["years"].items() if v == version}}}
        return one.read(name)

    def clear(self, keep: int = 2, leftover_hours: float = 24) -> int:
        """Removes manifests but the last ``keep``, and the folders none of these names; gives the number of folders.

        A reader that opened an older manifest can no longer read it.  Folders no manifest ever
        named, of a publication that failed or has yet to end, stay ``leftover_hours``.
        """
        numbers = [n for n in self._folder.names("manifest") if n.isdigit()]
        before, now = (set().union(*map(self._named, part)) for part in (numbers[:-keep], numbers[-keep:]))
        gone = before - now
        for name in self._folder.names("data"):
            for version in self._folder.names("data", name):
                if self._folder.age_hours("data", name, version) >= leftover_hours:
                    gone |= {(name, version, year) for year in self._folder.names("data", name, version)} - now
        for number in numbers[:-keep]:
            self._folder.remove("manifest", number)
        for name, version, year in gone:
            self._folder.remove("data", name, version, year)
        for name, version in {(name, version) for name, version, _ in gone}:
            if not any(n.startswith("year=") for n in self._folder.names("data", name, version)):
                self._folder.remove("data", name, version)
        return len(gone)

    def _named(self, number: str) -> set[tuple[str, str, str]]:
        tables = json.loads(self._folder.read("manifest", number))["tables"]
        return {(name, f"version={v}", f"year={y}") for name, held in tables.items() for y, v in held["years"].items()}


def _folder_of(year: int | None) -> str:
    return NO_YEAR if year is None else str(year)


def _even(df: DataFrame, target: str) -> None:
    """Files of an even size; a year with most of the rows has several, sorted by date."""
    df.hint("rebalance", "year").sortWithinPartitions("year", "date").write.partitionBy("year").parquet(target)


def _small(df: DataFrame, target: str) -> None:
    """What has been aggregated: years of few rows share a task, one of many cells is split over several."""
    df.hint("rebalance", "year").write.partitionBy("year").parquet(target)
