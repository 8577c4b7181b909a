"""Every query that has a SQL twin gives its rows, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from spanlab.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    if not DATA.exists():
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else float(f"{v:.12g}") if isinstance(v, float) else float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, db, name):
    df = catalog.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    c = db.execute(catalog.oracle_sql()[name])
    order = sorted(range(len(c.description)), key=lambda i: c.description[i][0])
    assert [c.description[i][0] for i in order] == cols
    assert sorted((tuple(plain(r[i]) for i in order) for r in c.fetchall()), key=repr) == got


def test_run_summary_counts_p(spark, tmp_path):
    """Label A's methods differ, N's do not, R has too few documents; the counts are those of friedman_chi2's SQL."""
    hits = [("A", i, 0) for i in range(30)] + [("N", i, i % 3) for i in range(30)] + [("R", i, 0) for i in range(9)]
    rows = [(x, i, 1, 5, 5, 0.09 if m == 0 else 0.0, 0.08 if m == 1 else 0.0, 50.0 if m == 2 else 1.0) for x, i, m in hits]
    l = spark.createDataFrame(rows, "l_returnflag string, l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_discount double, l_tax double, l_quantity double")  # noqa: E741
    l.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = c.execute(f"SELECT COUNT(*) FILTER (n_docs >= 10), COUNT(*) FILTER (n_docs >= 10 AND p <= 0.05) FROM ({catalog.oracle_sql()['friedman_chi2']})").fetchone()
    r = catalog.queries()["run_summary"](spark, str(tmp_path)).first()
    assert (r.n_tested, r.n_significant) == want == (2, 1)


def test_stream(spark, tmp_path):
    from spanlab.streaming.spans import in_batches, stream_spans

    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "a 12"), (2, "b")], "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "in/p"))
    got = []
    docs = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in/p"))
    q = in_batches(stream_spans(docs, [(r"\d+", "N", 1)]), lambda b, i: got.extend(b.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [(r.doc_id, r.begin, r.end) for r in got] == [(1, 2, 4)]


def test_prediction_cache_is_counted_where_it_is_read(spark, tmp_path):
    """A document is one line of the cache, so what is read is not shuffled again; equal spans, equal and null begins are as in SQL."""
    rows = [(1, 5, "A", 2.0), (1, 5, "A", 2.0), (1, 505, "A", 3.0), (1, 9, "N", 2.0), (2, 7, "R", 1.0), (3, None, "A", 4.0), (4, None, "A", 4.0), (4, 6, "A", 4.0)]
    l = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_returnflag string, l_quantity double")  # noqa: E741
    l.repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalog.queries()["prediction_cache"](spark, str(tmp_path))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(c.execute(catalog.oracle_sql()["prediction_cache"]).fetchall())
    assert sorted(tuple(r) for r in got.collect()) == want == [("1", 3, 14), ("2", 1, 7), ("3", 1, None), ("4", 2, 6)]
