"""Laid-out pages as a Spark data source: ``spark.read.format("layout").load(folder)``.

A folder holds a sub-folder per part with files of one page a line: size, and paragraphs with their text,
box and keys.  A read gives a row per paragraph.  Files are the partitions of a scan; a filter on
``part`` is pushed down (``spark.sql.python.filterPushdown.enabled``), so other parts are not opened.
Every key is computed again from what it stands for; a page or paragraph that is there twice in a file, a
key that differs or a line that cannot be read fails the scan.  :func:`repeated` finds pages that
are repeated across files.

A write puts the files of each task aside; the commit moves them to their parts, an abort deletes them,
so a reader never sees those of a job that failed.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from .blobs import file_system

SCHEMA = "part string, doc_id long, page int, width double, height double, para int, text string, vertical boolean, box struct<x0:double,y0:double,x1:double,y1:double>, record_key string, record_revision string"
NS_PLACE, NS_CONTENT = "ledgerloom.place/1", "ledgerloom.content/1"


class Divergent(ValueError):
    """Pages that are not what their keys say, or are there twice."""


def digest(namespace: str, **payload: object) -> str:
    text = json.dumps({"namespace": namespace, "payload": payload}, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    return hashlib.sha256(text.encode()).hexdigest()


def place_key(part: str, doc_id: int, page: int, para: int) -> str:
    return digest(NS_PLACE, part=part, doc=str(doc_id), page=page, para=para)


def content_key(place: str, text: str, vertical: bool, box: list[float] | None) -> str:
    """Boxes count to a thousandth of a unit."""
    return digest(NS_CONTENT, place=place, text=text, vertical=vertical, box=None if box is None else [f"{x:.3f}" for x in box])


@dataclass
class File(InputPartition):
    part: str
    path: str


class Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.part = folder, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("part",) and self.part in (None, f.value):
                self.part = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = file_system(self.folder)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = [(unquote(posixpath.basename(posixpath.dirname(f.path))[5:]), f.path) for f in found if f.path.endswith(".jsonl") and posixpath.basename(posixpath.dirname(f.path)).startswith("part=")]
        return [File(p, path) for p, path in sorted(files) if self.part in (None, p)]

    def read(self, partition: File) -> Iterator[tuple]:
        if partition is None:
            return
        system, _ = file_system(self.folder)
        pages: set[tuple[int, int]] = set()
        with system.open_input_stream(partition.path) as f:
            import io

            for n, line in enumerate(io.TextIOWrapper(f, encoding="utf-8", newline="\n"), 1):
                where = f"{partition.path}, line {n}"
                try:
                    p = json.loads(line)
                    doc_id, page, size, paras = p["doc_id"], p["page"], p["size"], p["paragraphs"]
                except (ValueError, KeyError, TypeError) as e:
                    raise Divergent(f"{where}: no page") from e
                if (doc_id, page) in pages:
                    raise Divergent(f"{where}: page {page} of document {doc_id} is repeated")
                pages.add((doc_id, page))
                seen: set[int] = set()
                for q in paras:
                    key = place_key(partition.part, doc_id, page, q["para"])
                    if q["para"] in seen:
                        raise Divergent(f"{where}: paragraph {q['para']} is repeated")
                    if key != q["key"] or content_key(key, q["text"], q["vertical"], q["box"]) != q["revision"]:
                        raise Divergent(f"{where}: paragraph {q['para']} is not what its key says")
                    seen.add(q["para"])
                    yield (partition.part, doc_id, page, float(size[0]), float(size[1]), q["para"], q["text"], q["vertical"], None if q["box"] is None else tuple(map(float, q["box"])), key, q["revision"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # part, path


class Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def _aside(self, root: str) -> str:
        return posixpath.join(root, "_aside", self.job)

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = file_system(self.folder)
        system.create_dir(self._aside(root), recursive=True)
        done: set[tuple] = set()
        files: list[tuple[str, str]] = []
        out, page, part = None, None, None

        def flush() -> None:
            if page is not None:
                out.write(json.dumps(page, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode() + b"\n")

        try:
            for r in iterator:
                own = (r["part"], r["doc_id"], r["page"])
                if page is None or own != (part, page["doc_id"], page["page"]):
                    flush()
                    if own in done:
                        raise Divergent(f"page {own[2]} of document {own[1]} comes in pieces")
                    done.add(own)
                    if own[0] != part or out is None:
                        if out is not None:
                            out.close()
                        part = own[0]
                        files.append((part, posixpath.join(self._aside(root), f"{uuid.uuid4().hex}.jsonl")))
                        out = system.open_output_stream(files[-1][1])
                    page = {"doc_id": own[1], "page": own[2], "size": [r["width"], r["height"]], "paragraphs": []}
                box = None if r["box"] is None else list(r["box"])
                key = place_key(part, own[1], own[2], r["para"])
                page["paragraphs"].append({"para": r["para"], "text": r["text"], "vertical": r["vertical"], "box": box, "key": key, "revision": content_key(key, r["text"], r["vertical"], box)})
            flush()
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.folder)
        for part, path in (f for m in messages if m is not None for f in m.files):
            target = posixpath.join(root, f"part={quote(part, safe='')}")
            system.create_dir(target, recursive=True)
            system.move(path, posixpath.join(target, posixpath.basename(path)))
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = file_system(self.folder)
        if system.get_file_info(self._aside(root)).type != fs.FileType.NotFound:
            system.delete_dir(self._aside(root))


class Layout(DataSource):
    @classmethod
    def name(cls) -> str:
        return "layout"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("laid-out pages are only appended")
        return Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Layout)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write(pages: DataFrame, folder: str) -> None:
    """Appends paragraphs (the columns of ``SCHEMA`` but for the keys) as pages; each page is one task's."""
    register(pages.sparkSession)
    shaped = pages.withColumns({"record_key": F.lit(None).cast("string"), "record_revision": F.lit(None).cast("string")})
    wanted = StructType.fromDDL(SCHEMA)
    dealt = shaped.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields)).repartition("part", "doc_id", "page").sortWithinPartitions("part", "doc_id", "page", "para")
    dealt.write.format("layout").mode("append").option("path", folder).save()


def read(spark: SparkSession, folder: str) -> DataFrame:
    register(spark)
    return spark.read.format("layout").load(folder)


def repeated(layout: DataFrame) -> DataFrame:
    """Locators that are there more than once, also in different files."""
    return layout.groupBy("part", "doc_id", "page", "para").agg(F.count("*").alias("n")).where("n > 1")
