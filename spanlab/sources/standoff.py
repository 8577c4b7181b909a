"""Stand-off annotation files as a Spark data source: spark.read.format("brat") and df.write.format("brat").

    standoff.register(spark)
    spans = spark.read.format("brat").option("recursive", True).option("labels", "DRUG DOSE").load(folder)
    content.write.format("brat").mode("append").save(folder)          # rows (doc_id, content)

Reading: one input partition per bundle of files; with option ``labels`` (names with blanks between) the reader does not build the
rows of other labels.  Conditions are not pushed down: Spark 4.1 keeps what one query has pushed for all later queries of the
same frame.  A document without spans gives no row, unless option ``empty`` asks for one with null fields.

Writing: each task writes its files under <folder>/_staging/<job>, and the driver moves them to their names when all tasks
have committed.  So a killed task, a second attempt or a failed job leaves no file.  write_files does the same with tasks that
move them, and tells the driver a task's folder instead of its files' names.  The name of a file is its document's
id with %, /, control characters and a leading . or _ escaped, one to one; two rows of one id are an error, before anything is
moved.  append replaces files of the same names and leaves others; overwrite removes the folder's other files of the suffix.
Null content is an empty file; a null id is an error.

Folders are paths or URIs that pyarrow's file systems open, shared by driver and executors.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SPANS = "doc_id string, tid string, label string, begin int, end int, fragments array<struct<begin:int,end:int>>, text string"
CONTENT = "doc_id string, content string"
STAGING = "_staging"
ESCAPED = re.compile(r"[%/\\\x00-\x1f\x7f]|^[._]")
OFFSETS = re.compile(r"\d+\s+\d+(\s*;\s*\d+\s+\d+)*")


def file_name(doc_id: str, suffix: str) -> str:
    """The file name of an id; file_id gives the id back."""
    name = ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", doc_id)
    return f"{name or '%'}.{suffix}"


def file_id(name: str, suffix: str) -> str:
    stem = name[: -len(suffix) - 1]
    return "" if stem == "%" else unquote(stem)


def _store(path: str):
    """The file system of a path or URI, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def parse(doc_id: str, text: str, labels: frozenset[str] | None, strict: bool) -> Iterator[tuple]:
    """Rows of SPANS from the T lines of a file.  strict: a line that is none is an error, else it is left out."""
    for n, line in enumerate(text.split("\n"), 1):
        line = line.strip()
        if not line.startswith("T"):
            continue
        tid, _, rest = line.partition("\t")
        head, tab, covered = rest.partition("\t")
        label, _, places = head.strip().partition(" ")
        if labels is not None and label not in labels:
            continue
        if not tab or not OFFSETS.fullmatch(places.strip()):
            if strict:
                raise ValueError(f"{doc_id}, line {n}: no span in {line[:80]!r}")
            continue
        pieces = [tuple(map(int, p.split())) for p in places.split(";")]
        yield doc_id, tid, label, pieces[0][0], pieces[-1][1], pieces, covered


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)


@dataclass
class Written(WriterCommitMessage):
    names: list[str] = field(default_factory=list)


class BratReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "ann")
        on = lambda name: str(options.get(name, "false")).lower() == "true"
        self.recursive, self.empty, self.strict = on("recursive"), on("empty"), on("strict")
        self.bundle, self.bytes = int(options.get("filesPerPartition", 2000)), int(options.get("bytesPerPartition", 64 << 20))
        self.labels = frozenset(options["labels"].split()) if "labels" in options else None

    def partitions(self) -> list[Files]:
        """Files are listed once, by the driver; their contents are read by tasks only."""
        from pyarrow import fs

        store, folder = _store(self.path)
        end = f".{self.suffix}"
        hidden = lambda path: any(p[:1] in (".", "_") for p in path[len(folder) :].strip("/").split("/"))
        files = [f for f in store.get_file_info(fs.FileSelector(folder, recursive=self.recursive)) if f.is_file and f.path.endswith(end) and not hidden(f.path)]
        out, size = [Files()], 0
        for f in sorted(files, key=lambda f: f.path):
            if out[-1].paths and (len(out[-1].paths) >= self.bundle or size + f.size > self.bytes):
                out.append(Files())
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                text = f.read().decode("utf-8", "replace")
            doc_id, found = file_id(path.rsplit("/", 1)[-1], self.suffix), False
            for row in parse(doc_id, text, self.labels, self.strict):
                found = True
                yield row
            if self.empty and not found:
                yield doc_id, None, None, None, None, None, None


class BratWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.suffix, self.overwrite = options["path"], options.get("suffix", "ann"), overwrite
        self.job = uuid.uuid4().hex
        store, folder = _store(self.path)
        store.create_dir(self._staged(folder), recursive=True)

    def _staged(self, folder: str) -> str:
        return f"{folder.rstrip('/')}/{STAGING}/{self.job}"

    def stage(self, rows: Iterator[tuple[str | None, str | None]]) -> tuple[str, set[str]]:
        """Write the files of (doc_id, content) to a folder below the job's own; its name, and theirs."""
        store, folder = _store(self.path)
        mine = f"{self._staged(folder)}/{uuid.uuid4().hex}"  # an attempt's own, so attempts do not meet
        store.create_dir(mine, recursive=False)  # fails once the job has been aborted
        names: set[str] = set()
        for doc_id, content in rows:
            if doc_id is None:
                raise ValueError("a document without an id has no file name")
            name = file_name(str(doc_id), self.suffix)
            if name in names:
                raise ValueError(f"two rows of document {doc_id!r}")
            with store.open_output_stream(f"{mine}/{name}") as f:
                f.write((content or "").encode("utf-8", "replace"))
            names.add(name)
        return mine.rsplit("/", 1)[1], names

    def staged(self, part: str) -> list[str]:
        """The names of the files in a task's folder."""
        from pyarrow import fs

        store, folder = _store(self.path)
        return [f.base_name for f in store.get_file_info(fs.FileSelector(f"{self._staged(folder)}/{part}"))]

    def publish(self, part: str) -> int:
        """Move a task's files to their names; a second attempt moves those that are left."""
        from pyarrow import fs

        store, folder = _store(self.path)
        names = self.staged(part)
        for n in names:
            to = f"{folder.rstrip('/')}/{n}"
            try:
                store.move(f"{self._staged(folder)}/{part}/{n}", to)
            except FileNotFoundError:  # another attempt has moved it
                if store.get_file_info(to).type == fs.FileType.NotFound:
                    raise
        return len(names)

    def write(self, rows: Iterator) -> Written:
        at, names = self.stage((r.doc_id, r.content) for r in rows)
        return Written([f"{at}/{n}" for n in names])

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, folder = _store(self.path)
        staged = [n for m in messages if m is not None for n in m.names]
        names = [n.split("/", 1)[1] for n in staged]
        if len(set(names)) < len(names):
            self.abort(messages)
            seen: set[str] = set()
            twice = next(n for n in names if n in seen or seen.add(n))
            raise ValueError(f"two rows of document {file_id(twice, self.suffix)!r}")
        if self.overwrite:
            old = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.is_file and f.path.endswith(f".{self.suffix}") and f.base_name not in set(names)]
            for path in old:
                store.delete_file(path)
        source = self._staged(folder)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda n: store.move(f"{source}/{n}", f"{folder.rstrip('/')}/{n.split('/', 1)[1]}"), staged))
        self._clear(store, folder)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        self._clear(store, folder)

    def _clear(self, store, folder: str) -> None:
        from pyarrow import fs

        source = self._staged(folder)
        for left in range(50, 0, -1):  # tasks that are being killed may still write there
            if store.get_file_info(source).type == fs.FileType.NotFound:
                break
            try:
                store.delete_dir(source)
            except OSError:
                if left == 1:
                    raise
                time.sleep(0.1)
        parent = source.rsplit("/", 1)[0]
        if store.get_file_info(parent).type != fs.FileType.NotFound and not store.get_file_info(fs.FileSelector(parent)):
            store.delete_dir(parent)


class BratSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "brat"

    def schema(self) -> str:
        return SPANS

    def reader(self, schema) -> BratReader:
        return BratReader(self.options)

    def writer(self, schema, overwrite: bool) -> BratWriter:
        if [f.name for f in schema] != ["doc_id", "content"]:
            raise ValueError(f"the columns to write are {CONTENT}")
        return BratWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make format("brat") known to the session."""
    spark.dataSource.register(BratSource)


def write_files(content: DataFrame, path: str, suffix: str = "ann") -> None:
    """One file a row (doc_id, content: strings) in the folder ``path``, whose other files stay.

    Tasks write the files, look for names that occur twice, and then move the files; a task's folder is all the driver hears of.
    """
    import pyarrow as pa

    spark, writer = content.sparkSession, BratWriter({"path": path, "suffix": suffix}, overwrite=False)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, _ = writer.stage((i.as_py(), c.as_py()) for b in batches for i, c in zip(b.column(0), b.column(1)))
        yield pa.RecordBatch.from_pydict({"part": [part]})

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column(0):
                yield pa.RecordBatch.from_pydict({"name": pa.array(writer.staged(part.as_py()), pa.string())})

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column(0):
                yield pa.RecordBatch.from_pydict({"n": [writer.publish(part.as_py())]})

    try:
        done = content.select("doc_id", "content").mapInArrow(stage, "part string").collect()  # a row a task
        parts = spark.sparkContext.parallelize([(r.part,) for r in done], max(len(done), 1))
        parts = spark.createDataFrame(parts, "part string")
        twice = parts.mapInArrow(names, "name string").groupBy("name").count().where("count > 1").first()
        if twice is not None:
            raise ValueError(f"two rows of document {file_id(twice.name, suffix)!r}")
        parts.mapInArrow(publish, "n long").agg({"n": "sum"}).collect()
    finally:
        writer.abort([])


def read_spans(spark: SparkSession, path: str, **options) -> DataFrame:
    """The spans of a folder's files as rows of SPANS; options as above."""
    register(spark)
    reader = spark.read.format("brat")
    for k, v in options.items():
        reader = reader.option(k, str(v).lower() if isinstance(v, bool) else v)
    return reader.load(path)
