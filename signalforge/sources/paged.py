"""Paged searches as a data source: landed answer pages are read in order, a search at a time, and no page is opened after the one that fills the cap.

    spark.dataSource.register(PagedSearch)
    spark.read.format("paged_search").option("path", folder).option("cap", 10).option("date_field", "statusModule.startDateStruct.date").load()

Pages lie at path/drug_name=<drug>/page=<number>/, one JSON item a line, or by the hundred at path/drug_name=<drug>/pages=<number>/, in order, each
line begun by its page's number and a tab: land() writes those, since a folder a page costs the driver a commit each. A search is one input
partition, so searches are read side by side; a filter on drug_name leaves only its searches to read. Within a search pages are
read by number up to `pages`; a page without items, or a number that is missing, ends it. Items count if their date lies in the window from
`since` to `until` (without date_field all do); once `cap` of them are there the search ends (0: no cap). Lines that hold no JSON object have a
null item, are kept apart in `corrupt`, and do not count.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import unquote

from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..functions.dates import FIRST, LAST, parse_date_text

#: Pages that land() puts into one folder.
TOGETHER = 256
#: A partition folder of rows without a drug, as Spark names it.
NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def _files(path: str):
    """The file system of a path or URI, and the path within it: whatever the executors can reach."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _folders(system, path: str, key: str) -> list[tuple[str, str]]:
    """(value, path) of the folders key=value right below a path."""
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    of = [(f.base_name.removeprefix(key + "="), f.path) for f in found if f.type == fs.FileType.Directory and f.base_name.startswith(key + "=")]
    return sorted((unquote(value), at) for value, at in of)


def _field(item: dict, path: str) -> str:
    for name in path.split("."):
        item = item.get(name) if isinstance(item, dict) else None
    return item if isinstance(item, str) else ""


class Search(InputPartition):
    def __init__(self, drug: str, folder: str) -> None:
        self.drug, self.folder = drug, folder


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.cap, self.pages = options["path"], int(options.get("cap", 0)), int(options.get("pages", 0))
        self.date_field, self.since, self.until = options.get("date_field", ""), options.get("since", FIRST), options.get("until", LAST)
        self.drugs: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters of drug_name by value; all others are left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("drug_name",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.drugs = asked if self.drugs is None else self.drugs & asked
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, path = _files(self.path)
        found = [Search(drug, at) for drug, at in _folders(system, path, "drug_name") if drug != NO_NAME and (self.drugs is None or drug in self.drugs)]
        return found or [Search("", "")]

    def _within(self, item: dict) -> bool:
        day = parse_date_text(_field(item, self.date_field))
        return day is not None and self.since <= day.isoformat() <= self.until

    def _lines(self, system, folder: str) -> Iterator[str]:
        from pyarrow import fs

        parts = [f for f in system.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        for part in sorted(parts, key=lambda f: f.path):
            with system.open_input_stream(part.path) as opened:
                pending = b""
                while block := opened.read(1 << 20):
                    *whole, pending = (pending + block).split(b"\n")
                    yield from (line.decode("utf-8", "replace") for line in whole if line.strip())
                if pending.strip():
                    yield pending.decode("utf-8", "replace")

    def _pages(self, system, folder: str) -> Iterator[tuple[int, Iterator[str]]]:
        """(number, lines) of a search's pages by number; none is opened before it is asked for."""
        alone = [(int(n), at, False) for n, at in _folders(system, folder, "page") if n.isdigit()]
        together = [(int(n) * TOGETHER, at, True) for n, at in _folders(system, folder, "pages") if n.isdigit()]
        for number, at, several in sorted(alone + together):
            if several:
                for page, lines in groupby((line.split("\t", 1) for line in self._lines(system, at)), lambda x: int(x[0])):
                    yield page, (said for _, said in lines if said.strip())
            else:
                yield number, self._lines(system, at)

    def read(self, partition: Search) -> Iterator[tuple]:
        if not partition.folder:
            return
        system, _ = _files(self.path)
        taken = 0
        for expected, (page, lines) in enumerate(self._pages(system, partition.folder)):
            if page != expected or (self.pages and page >= self.pages) or (self.cap and taken >= self.cap):
                return
            items = 0
            for pos, line in enumerate(lines):
                items += 1
                try:
                    item = json.loads(line)
                except ValueError:
                    item = None
                if not isinstance(item, dict):
                    yield partition.drug, page, pos, None, line
                elif not self.date_field or self._within(item):
                    taken += 1
                    yield partition.drug, page, pos, line, None
                    if self.cap and taken >= self.cap:
                        return
            if not items:
                return


class PagedSearch(DataSource):
    """Options: path (asked for), cap, pages, date_field, since, until."""

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return "drug_name string, page int, pos int, item string, corrupt string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def search(spark, path: str, **options):
    """The items of all searches landed at path; options as above. Filters of drug_name are taken before any page is opened."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSearch)
    return spark.read.format("paged_search").options(path=path, **options).load()


def land(items, path: str) -> None:
    """Writes items (drug_name, page, pos, item) as pages that search() reads; TOGETHER pages of a search are one task's and one file."""
    number = F.concat(F.col("page").cast("string"), F.lit("\t"))
    # a break within an item parts it into lines, as it does in a file of one page
    value = F.concat(number, F.replace(F.coalesce("item", F.lit("")), F.lit("\n"), F.concat(F.lit("\n"), number)))
    pages = items.select("drug_name", F.floor(F.col("page") / TOGETHER).cast("int").alias("pages"), "page", "pos", value.alias("value"))
    pages = pages.repartition("drug_name", "pages").sortWithinPartitions("drug_name", "pages", "page", "pos")
    pages.select("drug_name", "pages", "value").write.partitionBy("drug_name", "pages").text(path)
