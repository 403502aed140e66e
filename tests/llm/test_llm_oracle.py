import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
import compare  # noqa: E402

from pointmill.llm import queries, sql  # noqa: E402


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_same_rows(spark, sf_dir, name):
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), compare.connect(sf_dir).sql(sql.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert compare.rows(got) == compare.rows(want)


def test_awkward_documents(spark, docs, tmp_path):
    """The SQL and the operators agree on awkward rows too."""
    docs.select("doc_id", "text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "One two"), (2, None), (3, ""), (4, docs.where("doc_id = 15").first()["text"])], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    turns = [(1, 300, "a", "late"), (1, 2, None, "<|im_end|>"), (1, 2, None, "<|im_end|>"), (1, None, "system", None), (2, 0, "system", "x"), (None, 1, "b\n", "y"), (None, 0, "c", "é")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    v = lambda *x: [*x, *[0.0] * (4 - len(x))]
    vectors = [(50, v(1.0, 0.5), 1), (51, v(1.0, 0.5), 1), (51, v(1.0, 0.6), 2), (None, v(1.0, 0.5), 1), (52, v(2.0, 1.0), None), (100, None, 1), (101, v(), 2), (102, v(1.0, None), 1), (103, v(float("nan"), 1.0), 1), (0, v(0.9, 0.4, 0.1), 2), (7, v(0.7, 0.4, 0.2), 1), (8, v(0.0, 0.0, -1.0), 1), (9, v(0.0, 0.1, -1.0), None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name in sorted(sql.oracle_sql()):
        got, want = queries.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(sql.oracle_sql()[name]).df()
        assert compare.rows(got) == compare.rows(want), name
