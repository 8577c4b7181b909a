"""Stand-off annotation files (.ann) as DataFrames."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a span of several fragments becomes.
POLICIES = ("envelope", "first_fragment", "first_end", "all_fragments", "ignore_offsets")


#: Files and bytes that a task which lists or reads files hands on at once.
FILES, BYTES = 10_000, 8 << 20


def _hidden(name: str) -> bool:
    """As Spark's own listing leaves names out."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _local_folder(spark: SparkSession, path: str, suffix: str) -> str | None:
    """``path`` if it is a folder that tasks can list themselves; None for other file systems, patterns and single files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    ours = full.startswith("file:/") and not re.search(r"[][*?{}\\]", full) and re.fullmatch(r"\w[\w.-]*", suffix)
    folder = re.sub("^file:/+", "/", full)
    return folder if ours and os.path.isdir(folder) else None


def _deal(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Rows over all tasks: a row is a file or a folder to work on, so few bytes of rows are much work."""
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, F.xxhash64("raw"))


def _files(spark: SparkSession, folder: str, suffix: str, recursive: bool) -> DataFrame:
    """raw: the paths of a folder's files, as bytes.  Tasks list them: one the folder itself, others what is in its sub-folders."""
    end = f".{suffix}".encode()

    def entries(at: bytes, deep: bool) -> Iterator[tuple[bytes, bool]]:
        with os.scandir(at) as found:
            for e in found:
                if _hidden(os.fsdecode(e.name)):
                    continue
                if not e.is_dir():
                    if e.name.endswith(end) and e.stat().st_size:
                        yield e.path, False
                elif recursive or b"=" in e.name:  # partitions' folders, as Spark reads them
                    if deep:
                        yield from entries(e.path, True)
                    else:
                        yield e.path, True

    def batched(rows: Iterator[tuple[bytes, bool]]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bool]] = []
        for r in rows:
            held.append(r)
            if len(held) >= FILES:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names=["raw", "folder"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names=["raw", "folder"])

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.column(0):
                yield from batched(entries(at.as_py(), False))

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from batched(x for raw, is_folder in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in (entries(raw, True) if is_folder else [(raw, False)]))

    root = spark.range(1, numPartitions=1).select(F.lit(os.fsencode(folder)).alias("raw"))
    first = root.mapInArrow(top, "raw binary, folder boolean")
    return _deal(spark, first).mapInArrow(below, "raw binary, folder boolean").select("raw")


def _contents(files: DataFrame) -> DataFrame:
    """raw, content of files that tasks can open."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names: list[bytes] = []
            texts: list[bytes] = []
            size = 0
            for raw in b.column(0).to_pylist():
                with open(raw, "rb") as f:
                    texts.append(f.read())
                names.append(raw)
                size += len(texts[-1])
                if size >= BYTES or len(names) >= FILES:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(texts, pa.binary())], names=["raw", "content"])
                    names, texts, size = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(texts, pa.binary())], names=["raw", "content"])

    return files.mapInArrow(read, "raw binary, content binary")


def read_texts(spark: SparkSession, path: str, suffix: str = "txt", recursive: bool = False, keep_crlf: bool = False, corpus: str = "") -> DataFrame:
    """One row per file: doc_id (the stem), corpus, text.  Bytes that are no UTF-8 become U+FFFD; hidden, backup and
    empty files are left out.

    Files in a folder of the local (shared) file system are listed and read by tasks, many to each; other places by Spark's own
    reader, which lists on the driver.
    """
    folder = _local_folder(spark, path, suffix)
    if folder is not None:
        found = _contents(_deal(spark, _files(spark, folder, suffix, recursive)))
        rows = found.select(_stem(F.col("raw").cast("string"), suffix).alias("doc_id"), F.lit(corpus).alias("corpus"), F.col("content").cast("string").alias("text"))
    else:
        r = spark.read.option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", recursive)
        rows = r.text(path, wholetext=True).select(_stem(F.url_decode("_metadata.file_path"), suffix).alias("doc_id"), F.lit(corpus).alias("corpus"), F.col("value").alias("text"))
    return rows if keep_crlf else rows.withColumn("text", F.regexp_replace("text", "\r\n?", "\n"))


def _stem(path: Column, suffix: str) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), rf"\.{suffix}$", "")


def list_documents(spark: SparkSession, path: str, suffix: str = "ann", recursive: bool = False, by: str = "stem") -> DataFrame:
    """doc_id and path of every file that is not empty; by ``stem`` or ``path``, as stems of sub-directories can collide.  File contents are not read.

    Who lists them: see read_texts.
    """
    folder = _local_folder(spark, path, suffix)
    if folder is not None:
        f = _files(spark, folder, suffix, recursive).select(F.concat(F.lit("file:"), F.col("raw").cast("string")).alias("path"))
    else:
        f = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", recursive).load(path).select("path")
        f = f.where(~F.startswith(F.regexp_extract("path", r"([^/]+)$", 1), F.lit(".")))
    return f.select((_stem(F.col("path"), suffix) if by == "stem" else F.col("path")).alias("doc_id"), "path")


def read_lines(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """doc_id, line_no from 0, line."""
    return lines_of(read_texts(spark, path, "ann", recursive))


def lines_of(texts: DataFrame) -> DataFrame:
    """Lines of documents (doc_id, text)."""
    return texts.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _fields(lines: DataFrame, prefix: str, strip: bool) -> DataFrame:
    line = F.trim("line") if strip else F.col("line")
    return lines.withColumn("__l", line).where(F.startswith("__l", F.lit(prefix))).withColumn("__f", F.split("__l", "\t", -1))


def parse_spans(lines: DataFrame, policy: str = "envelope", min_fields: int = 3, strip: bool = True, labels: list[str] | None = None) -> DataFrame:
    """T lines as doc_id, line_no, tid, label, begin, end, text.

    A line needs min_fields tab-separated fields and, except under ``ignore_offsets``, whole numbers; others are
    dropped.  Fragments are ``b e`` pairs between semicolons.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; one of {POLICIES}")
    f = _fields(lines, "T", strip).where(F.size("__f") >= min_fields)
    head = F.try_element_at("__f", F.lit(2))
    parts = F.regexp_extract(head, r"^(\S+)", 1)
    offs = F.trim(F.regexp_replace(head, r"^\S+", ""))
    t = f.select("doc_id", "line_no", F.element_at("__f", 1).alias("tid"), parts.alias("label"), offs.alias("__o"), F.coalesce(F.try_element_at("__f", F.lit(3)), F.lit("")).alias("text"))
    if labels is not None:
        t = t.where(F.col("label").isin(*labels))
    if policy == "ignore_offsets":
        return t.select("doc_id", "line_no", "tid", "label", F.lit(None).cast("int").alias("begin"), F.lit(None).cast("int").alias("end"), "text")
    t = t.where(F.col("__o").rlike(r"^\d+\s+\d+(\s*;\s*\d+\s+\d+)*$"))
    number = lambda c, rx: F.regexp_extract(c, rx, 1).try_cast("int")
    if policy == "all_fragments":
        # every line has one: explode would find the fragments twice, once to leave out lines without any
        t = t.withColumn("__o", F.explode_outer(F.regexp_extract_all("__o", F.lit(r"\d+\s+\d+"), F.lit(0))))
    end = r"(\d+)\s*$" if policy in ("envelope", "all_fragments") else r"^\d+\s+(\d+)"
    return t.select("doc_id", "line_no", "tid", "label", number("__o", r"^(\d+)").alias("begin"), number("__o", end).alias("end"), "text")


def span_set(spans: DataFrame) -> DataFrame:
    return spans.select("doc_id", "label", "begin", "end").distinct()


def span_bag(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id", "label", "begin", "end").agg(F.count("*").alias("n"))


def parse_attributes(lines: DataFrame) -> DataFrame:
    """A and M lines: doc_id, aid, name, tid, value (null where there is none)."""
    f = _fields(lines, "A", True).unionByName(_fields(lines, "M", True)).where(F.size("__f") >= 2)
    w = F.split(F.element_at("__f", 2), r"\s+", 3)
    return f.select("doc_id", F.element_at("__f", 1).alias("aid"), F.element_at(w, 1).alias("name"), F.try_element_at(w, F.lit(2)).alias("tid"), F.try_element_at(w, F.lit(3)).alias("value")).where("tid is not null")


def parse_relations(lines: DataFrame) -> DataFrame:
    """R lines: doc_id, rid, type, arg1, arg2."""
    f = _fields(lines, "R", True).where(F.size("__f") >= 2)
    arg = lambda n: F.regexp_extract(F.element_at("__f", 2), rf"\bArg{n}:(\S+)", 1)
    out = f.select("doc_id", F.element_at("__f", 1).alias("rid"), F.regexp_extract(F.element_at("__f", 2), r"^(\S+)", 1).alias("type"), arg(1).alias("arg1"), arg(2).alias("arg2"))
    return out.where("arg1 <> '' and arg2 <> ''")


def parse_events(lines: DataFrame) -> DataFrame:
    """E lines: doc_id, eid, type, trigger_tid."""
    f = _fields(lines, "E", True).where(F.size("__f") >= 2)
    at = F.element_at("__f", 2)
    return f.select("doc_id", F.element_at("__f", 1).alias("eid"), F.regexp_extract(at, r"^([^:\s]+)", 1).alias("type"), F.regexp_extract(at, r"^[^:\s]+:(\S+)", 1).alias("trigger_tid")).where("trigger_tid <> ''")


def kind_counts(lines: DataFrame, compat: bool = False) -> DataFrame:
    """How often each key occurs: labels, attributes (alone and with value), Event_, Relation_ and Normalization_ types.  compat: spans count twice."""
    f = lines.withColumn("__l", F.trim("line")).where(F.col("__l") != "").withColumns({"__k": F.substring("__l", 1, 1), "__h": F.try_element_at(F.split("__l", "\t"), F.lit(2))}).where("__h is not null")
    w = F.split("__h", r"\s+")
    word = lambda n: F.try_element_at(w, F.lit(n))
    keys = (
        F.when(F.col("__k") == "T", F.array(*[word(1)] * (2 if compat else 1)))
        .when(F.col("__k") == "A", F.array(word(1), F.concat(word(1), F.lit(":"), word(3))))
        .when(F.col("__k") == "E", F.array(F.concat(F.lit("Event_"), F.element_at(F.split(word(1), ":"), 1))))
        .when(F.col("__k") == "R", F.array(F.concat(F.lit("Relation_"), word(1))))
        .when(F.col("__k") == "N", F.array(F.concat(F.lit("Normalization_"), word(1))))
    )
    return f.select(F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def first_directory(files: DataFrame, name: str = "name", priority: str = "priority") -> DataFrame:
    """Of files of equal name the one of the first directory."""
    first = files.groupBy(name).agg(F.min(priority).alias(priority))
    return files.join(first, [name, priority])


def all_directories(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows of several directories, each with its name as ``corpus``; files of equal name all stay."""
    out = None
    for name, df in parts.items():
        one = df.withColumn("corpus", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no directories")
    return out
