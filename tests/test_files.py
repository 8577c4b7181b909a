"""Files: what the writers write the readers read, and readers of files made by hand."""

import json

import pytest
from pyspark.sql import functions as F

from spanlab.sources import brat, formats, sinks, standoff


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


SPANS = [("a b", "X", 0, 3, "one", None), ("a b", "Y", 5, 9, "tw\no", "pos itif"), ("ü/é", "X", 2, 4, "z", "v"), ("c", "X", 1, 2, "", None)]


@pytest.mark.parametrize("values", [False, True])
def test_standoff_round_trip(spark, tmp_path, values):
    spans = spark.createDataFrame(SPANS, "doc_id string, label string, begin int, end int, text string, value string")
    out = str(tmp_path / "out")
    for _ in range(2):  # the second replaces the first
        sinks.write_documents(sinks.brat_text(spans, values=values), out)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a b.ann", "c.ann", "ü%2Fé.ann"]
    want = {d: c for d, c in rows(sinks.brat_text(spans, values=values), "doc_id", "content")}
    assert {d.replace("%2F", "/"): t for d, t in rows(brat.read_texts(spark, out, "ann"), "doc_id", "text")} == want
    lines = brat.read_lines(spark, out)
    got = rows(brat.parse_spans(lines, strip=False), "doc_id", "label", "begin", "end", "text")
    assert got == sorted(((d.replace("/", "%2F"), la, b, e, t.replace("\n", " ")) for d, la, b, e, t, _ in SPANS), key=repr)
    kinds = dict(rows(brat.kind_counts(lines), "key", "n"))
    assert kinds["X"] == 3 and kinds.get("Value", 0) == (2 if values else 0)


def test_writer_refuses_null_ids(spark, tmp_path):
    bad = spark.createDataFrame([(None, "x")], "doc_id string, content string")
    with pytest.raises(Exception, match="without an id"):
        sinks.write_documents(bad, str(tmp_path / "out"))
    none = spark.createDataFrame([("e", None)], "doc_id string, content string")
    sinks.write_documents(none, f"file://{tmp_path}/out")
    assert (tmp_path / "out" / "e.ann").read_bytes() == b""


IDS = ["a/b", "a%2Fb", "%", "", ".hidden", "_staged", "%2Ehidden", "a b", "ü", "x.ann", "a+b", "tab\there", "CON"]


def test_data_source_round_trip(spark, tmp_path):
    """Every id has a file of its own, documents without spans an empty one, and reading gives back what was written."""
    spans = spark.createDataFrame([(i, "X" if k % 3 else "Y", k, k + 2 + j, f"t {j}", None) for k, i in enumerate(IDS[:-2]) for j in range(2)], "doc_id string, label string, begin int, end int, text string, value string")
    docs = spark.createDataFrame([(i,) for i in IDS], "doc_id string")
    out = str(tmp_path / "out")
    for _ in range(2):  # the second replaces the first
        sinks.write_documents(sinks.brat_text(spans, documents=docs), out)
        assert sum(p.is_file() for p in (tmp_path / "out").iterdir()) == len(IDS) and not (tmp_path / "out" / standoff.STAGING).exists()
    assert len({standoff.file_name(i, "ann") for i in IDS}) == len(IDS) and all(standoff.file_id(standoff.file_name(i, "ann"), "ann") == i for i in IDS)
    cols = ("doc_id", "label", "begin", "end", "text")
    back = standoff.read_spans(spark, out)
    assert rows(back, *cols) == rows(spans, *cols)
    assert rows(back.where("label = 'Y' and begin > 2"), *cols) == rows(spans.where("label = 'Y' and begin > 2"), *cols)
    assert rows(standoff.read_spans(spark, out, labels="Y Z"), *cols) == rows(spans.where("label = 'Y'"), *cols)
    empty = standoff.read_spans(spark, out, empty=True).where("label is null")
    assert {r.doc_id for r in empty.collect()} == set(IDS[-2:])
    few = standoff.read_spans(spark, out, filesPerPartition=2)
    assert few.rdd.getNumPartitions() == 7 and few.count() == back.count()
    over = spark.createDataFrame([("new", "x")], "doc_id string, content string")
    over.write.format("brat").mode("overwrite").save(out)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["new.ann"]


def test_data_source_reads_by_hand(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "d.ann").write_text("T1\tA 0 3;5 9\tone\ttwo\n#1\tnote\nT2\tA x y\tz\nT3 no tab\nR1\tR Arg1:T1 Arg2:T2\n T4\tB 1 2\t\r\n")
    (tmp_path / ".h.ann").write_text("T1\tA 0 1\tq\n")
    (tmp_path / "e.ann").write_bytes(b"T1\tC 1 2\t\xff\n")
    got = rows(standoff.read_spans(spark, str(tmp_path), recursive=True), "doc_id", "tid", "label", "begin", "end", "text")
    assert got == [("d", "T1", "A", 0, 9, "one\ttwo"), ("e", "T1", "C", 1, 2, "\ufffd")]
    assert [tuple(x) for x in standoff.read_spans(spark, str(tmp_path / "s")).where("tid = 'T1'").first().fragments] == [(0, 3), (5, 9)]
    with pytest.raises(Exception, match="no span in"):
        standoff.read_spans(spark, str(tmp_path / "s"), strict=True).collect()


def test_failed_jobs_leave_nothing(spark, tmp_path):
    """A task that fails half way, and ids that meet only at the end, leave the folder as it was."""
    out = tmp_path / "out"
    sinks.write_documents(spark.createDataFrame([("a", "old")], "doc_id string, content string"), str(out))
    halfway = spark.range(100).selectExpr("if(id = 73, null, cast(id AS string)) AS doc_id", "'x' AS content").repartition(4)
    twice = spark.range(100).selectExpr("cast(id % 99 AS string) AS doc_id", "'x' AS content").repartition(4, "content", "doc_id").unionByName(spark.createDataFrame([("5", "y")], "doc_id string, content string"))
    for bad, why in ((halfway, "without an id"), (twice, "two rows of document")):
        with pytest.raises(Exception, match=why):
            sinks.write_documents(bad, str(out))
        assert [p.name for p in out.iterdir()] == ["a.ann"] and (out / "a.ann").read_text() == "old"


def test_listing(spark, tmp_path):
    for name in ("x.ann", "sub/x.ann", "sub/y.ann", ".hidden.ann", "n.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("T1\tA 0 1\tq\n")
    assert rows(brat.list_documents(spark, str(tmp_path)), "doc_id") == [("x",)]
    assert rows(brat.list_documents(spark, str(tmp_path), recursive=True), "doc_id") == [("x",), ("x",), ("y",)]
    assert len({p for (p,) in rows(brat.list_documents(spark, str(tmp_path), recursive=True, by="path"), "doc_id")}) == 3
    both = brat.all_directories({"one": brat.read_lines(spark, str(tmp_path)), "two": brat.read_lines(spark, str(tmp_path / "sub"))})
    assert rows(both.where("line <> ''"), "corpus", "doc_id") == [("one", "x"), ("two", "x"), ("two", "y")]


def test_caches_samples_and_ids(spark, tmp_path):
    counts = spark.createDataFrame([("d", "A", 1, 2, 3), ("d", "A", 1, 0, 0), ("d", "B", 0, 0, 1), ("e", "A", 5, 0, 0)], "doc_id string, label string, tp long, fp long, fn long")
    sinks.score_cache(counts).select(F.col("json").alias("value")).write.text(str(tmp_path / "scores"))
    want = [("d", "A", 2, 2, 3), ("d", "B", 0, 0, 1), ("e", "A", 5, 0, 0)]
    assert rows(formats.read_score_cache(spark, str(tmp_path / "scores"), lines=True), "doc_id", "label", "tp", "fp", "fn") == want
    (tmp_path / "one.json").write_text(json.dumps({"d": {"A": {"TP": 1, "FP": 0, "FN": 2}}}, indent=1))
    assert rows(formats.read_score_cache(spark, str(tmp_path / "one.json")), "doc_id", "label", "tp", "fp", "fn") == [("d", "A", 1, 0, 2)]
    (tmp_path / "pred.json").write_text(json.dumps({"d": [[0, 3, "A"], [4, 6, "B"]], "e": []}))
    assert rows(formats.read_prediction_cache(spark, str(tmp_path / "pred.json")), "doc_id", "begin", "end", "label") == [("d", 0, 3, "A"), ("d", 4, 6, "B")]
    (tmp_path / "s.json").write_text(json.dumps([{"tokenized_text": ["a", "b"], "ner": [[0, 1, "X"]]}]))
    assert [tuple(x) for r in formats.read_samples(spark, str(tmp_path / "s.json")).collect() for x in r.spans] == [(0, 1, "X")]
    (tmp_path / "train.txt").write_text("d1\n\n d2 \n")
    assert rows(formats.read_ids(spark, str(tmp_path / "train.txt"), "train"), "doc_id", "fold") == [("d1", "train"), ("d2", "train")]
    here, gone = {"train": str(tmp_path / "train.txt")}, {"train": str(tmp_path / "train.txt"), "test": str(tmp_path / "none.txt")}
    other = spark.createDataFrame([("z", "train")], "doc_id string, fold string")
    assert formats.frozen_or(here, spark, lambda: other).count() == 2 and formats.frozen_or(gone, spark, lambda: other).count() == 1


def test_bio_json_and_report(spark, tmp_path):
    t = spark.createDataFrame([("d", 1, "b", "I-X"), ("d", 0, "a\"", "B-X")], "doc_id string, tok_id int, token string, tag string")
    assert json.loads(sinks.bio_json(t).first().json) == {"id": "d", "tokens": ['a"', "b"], "ner_tags": ["B-X", "I-X"]}
    d = spark.createDataFrame([("A", "rules", 0.01), ("B", None, None)], "label string, method string, p double")
    got = json.loads(sinks.report(d).first().json)
    assert got["n_labels"] == 2 and got["methods"] == ["excluded", "rules"] and got["labels"][0] == {"label": "A", "method": "rules", "p": 0.01}
    for run in ("r1", "r2"):
        sinks.write_table(d, str(tmp_path / "runs"), "csv", run_id=run)
    assert spark.read.option("header", True).csv(str(tmp_path / "runs")).groupBy("run_id").count().count() == 2
    sinks.write_split(spark.createDataFrame([("a",), ("b",)], "doc_id string"), spark.createDataFrame([("a", "train"), ("b", "test")], "doc_id string, fold string"), str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split/fold=train")).count() == 1


def test_many_small_files_take_few_tasks(spark, tmp_path):
    """Folders of many files are listed and read by tasks, not by the driver, and a task has many of them."""
    docs = spark.range(1500).selectExpr("cast(id AS string) AS doc_id", "concat('T1\tX 0 1\t', id) AS content").repartition(3)
    for folder in ("a", "b"):
        sinks.write_documents(docs, str(tmp_path / folder))
    (tmp_path / "b" / "p+q.ann").write_bytes(b"x")
    texts, names = brat.read_texts(spark, str(tmp_path), "ann", recursive=True), brat.list_documents(spark, str(tmp_path), recursive=True)
    assert max(texts.rdd.getNumPartitions(), names.rdd.getNumPartitions()) <= 8
    assert texts.agg(F.count("*"), F.countDistinct("doc_id")).first() == (3001, 1501) == names.agg(F.count("*"), F.countDistinct("doc_id")).first()
    assert rows(texts.where("doc_id in ('7', 'p+q')"), "doc_id", "text") == [("7", "T1\tX 0 1\t7")] * 2 + [("p+q", "x")]
    assert {p.rsplit("/", 2)[1] for (p,) in rows(names, "path")} == {"a", "b"} and sorted(x.name for x in tmp_path.iterdir()) == ["a", "b"]
    assert {x.name for x in (tmp_path / "a").iterdir()} == {f"{i}.ann" for i in range(1500)}
