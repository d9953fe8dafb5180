"""Source trees as a data source, and rules of one's own in SQL.

spark.read.format("source_tree").option("path", folder) reads the files under a folder of a file system that all executors have mounted, as (path, size, lang, code), in parts of about the same number of bytes.
Filters on path, size and lang (equality, bounds, the start of a path) choose files before any is opened, where spark.sql.python.filterPushdown.enabled is set. A file that is too large, or is not there any more when it is read, has a null code.

SELECT * FROM match_rules(TABLE(SELECT doc_id, code FROM files), 'name=pattern', ...) finds patterns of the user's line by line.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType

SCHEMA = "path string, size long, lang string, code string"
LANGS = {".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python", ".java": "java", ".go": "go", ".rb": "ruby", ".php": "php", ".cs": "csharp", ".rs": "rust"}
#: Folders that hold no sources of one's own.
SKIPPED = {".git", "node_modules", "__pycache__", ".venv", "dist", "build"}
PART_BYTES, FILE_BYTES = 32 << 20, 8 << 20


class Part(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def lang_of(path: str) -> str | None:
    return LANGS.get(os.path.splitext(path)[1].lower())


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.top = options["path"].removeprefix("file://").rstrip("/")
        self.part_bytes, self.file_bytes = int(options.get("partbytes", PART_BYTES)), int(options.get("filebytes", FILE_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in", StringStartsWith: "starts"}
        for f in filters:
            if type(f) in kinds and len(f.attribute) == 1 and f.attribute[0] in ("path", "size", "lang"):
                self.tests.append((f.attribute[0], kinds[type(f)], f.value))
            else:
                yield f

    def _wanted(self, path: str, size: int) -> bool:
        have = {"path": path, "size": size, "lang": lang_of(path)}
        for name, how, value in self.tests:
            x = have[name]
            if x is None:
                return False
            ok = {"=": lambda: x == value, ">": lambda: x > value, ">=": lambda: x >= value, "<": lambda: x < value, "<=": lambda: x <= value, "in": lambda: x in value, "starts": lambda: x.startswith(value)}[how]()
            if not ok:
                return False
        return True

    def _below(self, folder: str) -> Iterator[tuple[str, int]]:
        starts = [v for n, how, v in self.tests if n == "path" and how == "starts"]
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            path = os.path.relpath(entry.path, self.top)
            if entry.is_dir(follow_symlinks=False):
                # a folder none of whose files can begin so is not entered
                if entry.name not in SKIPPED and all(s.startswith(f"{path}/"[: len(s)]) for s in starts):
                    yield from self._below(entry.path)
            elif entry.is_file(follow_symlinks=False) and lang_of(path) and self._wanted(path, size := entry.stat().st_size):
                yield path, size

    def partitions(self) -> list[Part]:
        parts, held, total = [], [], 0
        for path, size in self._below(self.top):
            if held and total + size > self.part_bytes:
                parts.append(Part(held))
                held, total = [], 0
            held.append((path, size))
            total += size
        return [*parts, Part(held)] if held or not parts else parts

    def read(self, partition: Part) -> Iterator[tuple]:
        for path, size in partition.files:
            code = None
            if size <= self.file_bytes:
                try:
                    with open(os.path.join(self.top, path), "rb") as f:
                        code = f.read().decode("utf-8", "replace")
                except FileNotFoundError:
                    code = None
            yield path, size, lang_of(path), code


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(dict(self.options))


@udtf(returnType="doc_id long, line_no int, rule string, found string")
class MatchRules:
    """Every line of each row's code that a rule matches; a rule is 'name=pattern', a regular expression as Python's."""

    def __init__(self):
        self.rules: dict[str, re.Pattern] = {}

    def eval(self, row: Row, *rules: str):
        if row["code"] is None:
            return
        for rule in rules:
            if rule not in self.rules:
                self.rules[rule] = re.compile(rule.partition("=")[2])
        for n, line in enumerate(row["code"].split("\n"), 1):
            for rule, rx in self.rules.items():
                if m := rx.search(line):
                    yield row["doc_id"], n, rule.partition("=")[0], m[0]


def register(spark: SparkSession) -> None:
    """Makes source_tree and match_rules known to a session."""
    spark.dataSource.register(SourceTree)
    spark.udtf.register("match_rules", MatchRules)
