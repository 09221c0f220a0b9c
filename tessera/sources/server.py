"""Terminology servers as a Spark data source: pages of concepts are partitions that tasks fetch themselves.

    register(spark)
    spark.read.format("terminology").option("url", "http://server/MAIN/concepts").load()       # everything, page by page
    spark.read.format("terminology").option("path", folder).option("term", "heart failure").load()

Rows are (position long, item string): items as the server gives them, for ``operators.terminology.concepts``. Options:
``url`` of a server that answers {"items": [...], "total": n} to offset, limit and term; or ``path`` of a folder of such
answers as files, with which pages can be kept and read again; ``page`` items a request (default 1,000) and
``pages_per_task`` (default 8); ``term``, which asks for matches only, 1,000 for a single word and 36 for more; ``limit``
overrides that; ``attempts`` and ``pause`` of retries (seconds, doubled each time).
"""

from __future__ import annotations

import json
import re
import sys
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.error import HTTPError
from urllib.parse import urlencode
from urllib.request import urlopen

import pyarrow as pa
from pyarrow import fs as files
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "position long, item string"
LIMIT_WORD, LIMIT_PHRASE, PAGE = 1000, 36, 1000


def limit_of(term: str) -> int:
    """Most items that are asked for by a term."""
    return LIMIT_WORD if len(term.split()) <= 1 else LIMIT_PHRASE


@dataclass
class Pages(InputPartition):
    """Consecutive requests (offset, limit), or files, of one task."""

    parts: list


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.term = (options.get("term") or "").strip()
        self.page = int(options.get("page", PAGE))
        self.limit = int(options.get("limit", limit_of(self.term) if self.term else 0)) or None
        if bool(options.get("url")) == bool(options.get("path")):
            raise ValueError("a terminology source has either a url or a path")
        if self.page < 1:
            raise ValueError("a page has one item at least")

    def _again(self, what):
        """Try, and try again after pauses that double, what may fail for a while."""
        attempts, pause = int(self.options.get("attempts", 4)), float(self.options.get("pause", 0.5))
        for turn in range(attempts):
            try:
                return what()
            except (OSError, json.JSONDecodeError) as e:
                refused = isinstance(e, HTTPError) and e.code < 500 and e.code != 429
                if refused or turn + 1 == attempts:
                    raise
                time.sleep(pause * 2**turn)

    def _asked(self, offset: int, limit: int) -> dict:
        asked = {"offset": offset, "limit": limit, "activeFilter": "true"} | ({"term": self.term, "termActive": "true"} if self.term else {})
        address = f"{self.options['url'].rstrip('/')}?{urlencode(asked)}"

        def get() -> dict:
            with urlopen(address, timeout=float(self.options.get("timeout", 30))) as answer:
                return json.load(answer)

        return self._again(get)

    def _folder(self) -> tuple[files.FileSystem, str]:
        at = self.options["path"]
        return files.FileSystem.from_uri(at) if "://" in at or at.startswith("file:") else (files.LocalFileSystem(), at)

    def partitions(self) -> list[Pages]:
        each = int(self.options.get("pages_per_task", 8))
        if self.options.get("path"):
            store, at = self._folder()
            found = store.get_file_info(files.FileSelector(at, recursive=True))
            names = [f.path for f in found if f.is_file and f.size and not f.base_name.startswith(("_", "."))]
            parts: list = sorted(names, key=lambda n: [int(x) if x.isdigit() else x for x in _numbered(n)])
        else:
            total = int(self._asked(0, 1).get("total", 0))
            total = min(total, self.limit) if self.limit else total
            parts = [(at, min(self.page, total - at)) for at in range(0, total, self.page)]
        if self.limit:
            each = max(len(parts), 1)  # an answer of bounded size, in order
        return [Pages(parts[i : i + each]) for i in range(0, len(parts), each)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        left = self.limit
        for part in partition.parts:
            if left == 0:
                break
            if isinstance(part, str):
                store, _ = self._folder()
                body = self._again(lambda: json.loads(store.open_input_stream(part).readall()))  # noqa: B023  (called here)
                items = [x for x in body.get("items") or [] if isinstance(x, dict)]
                items = [x for x in items if self.term.lower() in json.dumps(x, ensure_ascii=False).lower()]
                first = int(body.get("offset", 0))
            else:
                first = part[0]
                items = [x for x in self._asked(*part).get("items") or [] if isinstance(x, dict)]
            items = items[:left] if left is not None else items
            left = left - len(items) if left is not None else None
            yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(items)), pa.int64()), pa.array([json.dumps(x, ensure_ascii=False) for x in items], pa.string())], names=["position", "item"])


def _numbered(name: str) -> list[str]:
    return re.split(r"(\d+)", name)


class TerminologySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "terminology"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format "terminology" known to the session. The source travels to the workers whole."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(TerminologySource)


def write_pages(items: DataFrame, path: str, page: int = PAGE) -> None:
    """Keep (position long, item string) as the answers of a server, a file for each run of ``page`` positions, so that
    the source can read them by ``path``. Positions should be dense, as a page holds as many items at most; rows without
    an item are left out."""
    number = F.floor(F.col("position") / page)
    listed = items.where("item is not null").groupBy(number.alias("number")).agg(F.array_sort(F.collect_list(F.struct("position", "item"))).alias("l"))
    body = F.concat(F.lit('{"offset":'), F.get("l", F.lit(0))["position"].cast("string"), F.lit(',"items":['), F.array_join(F.transform("l", lambda x: x["item"]), ","), F.lit("]}"))
    listed.select("number", body.alias("value")).write.partitionBy("number").text(path)
