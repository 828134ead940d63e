"""Parsers and archives as objects of Spark SQL: a table function over source texts, and a data source of archive members.

    register(spark)
    spark.sql("select f.path, n.* from files f, lateral parse_code(f.language, f.source) n")
    spark.sql("create table members using archive options (path '/data/a.zip')")
    spark.read.format("archive").load("/data/a.zip")
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators import syntax


def _fields(detail: bool) -> StructType:
    """The columns of nodes, made without a session, as functions are analyzed outside of one."""
    kinds = {"long": LongType(), "int": IntegerType(), "string": StringType()}
    return StructType([StructField(n, kinds[t]) for n, t in (f.split() for f in (syntax.NODE_FIELDS + (syntax.DETAIL_FIELDS if detail else "")).split(", "))])


def parser_function(parsers: dict | None = None):
    """A table function parse_code(language, source[, detail]): the nodes of each text by its language's parser (others by tokens).

    parsers: further ones by language, each a function from a text to rows of NODE_FIELDS. With detail, a constant true, rows
    also have the columns of parse(detail=True). A null text has no nodes.
    """
    table = {**syntax.PARSERS, **(parsers or {})}

    class ParseCode:
        @staticmethod
        def analyze(language: AnalyzeArgument, source: AnalyzeArgument, detail: AnalyzeArgument = None) -> AnalyzeResult:
            for name, a in (("language", language), ("source", source)):
                if a.dataType.typeName() not in ("string", "void"):
                    raise ValueError(f"parse_code: {name} is a text, not {a.dataType.simpleString()}")
            if detail is not None and not detail.isConstantExpression:
                raise ValueError("parse_code: detail is a constant")
            return AnalyzeResult(_fields(detail is not None and bool(detail.value)))

        def eval(self, language: str | None, source: str | None, detail: bool = False) -> Iterator[tuple]:
            if source is not None:
                yield from syntax.tree_rows(table, language, source, bool(detail))

    return udtf(ParseCode)


@dataclass
class Member(InputPartition):
    """One member of a zip archive, or (name null) all of a tar archive, whose members have no table of places."""

    archive: str
    name: str | None


def _open(uri: str) -> io.BufferedIOBase:
    """A file of any store that Arrow reaches (file, hdfs, s3, gs, abfs), by its address; the executors must reach it as well."""
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    return fs.open_input_file(path)


class ArchiveReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in self.paths:
            with _open(path) as f:
                if zipfile.is_zipfile(f):
                    f.seek(0)
                    with zipfile.ZipFile(f) as z:
                        out += [Member(path, i.filename) for i in z.infolist() if not i.is_dir()]
                else:
                    out.append(Member(path, None))
        return out

    def read(self, partition: Member) -> Iterator[tuple]:
        with _open(partition.archive) as f:
            if partition.name is not None:
                with zipfile.ZipFile(f) as z:
                    yield partition.archive, partition.name, z.read(partition.name)
                return
            with tarfile.open(fileobj=f, mode="r:*") as t:
                for m in t:
                    if m.isfile():
                        yield partition.archive, m.name, t.extractfile(m).read()


class ArchiveSource(DataSource):
    """format("archive"): archive, path and content of every member of zip, tar and compressed tar archives. `path` holds one
    address or several, separated by commas. A zip archive has a partition for each member."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "archive string, path string, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader([p.strip() for p in self.options["path"].split(",") if p.strip()])


def register(spark: SparkSession, parsers: dict | None = None) -> None:
    """Make parse_code and the archive format known to a session."""
    spark.udtf.register("parse_code", parser_function(parsers))
    spark.dataSource.register(ArchiveSource)
