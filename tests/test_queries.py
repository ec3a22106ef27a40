import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    keep = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(r[i] for i in keep)) for r in values)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_words_of_every_language(spark, tmp_path):
    spark.createDataFrame([("en", "The cat, the"), ("fr", "Été-cat"), (None, "42 straße")], "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["counting_set_words"](spark, str(tmp_path)).collect()
    assert {r.w: r.n for r in got} == {"the": 2, "cat": 2, "été": 1, "straße": 1}
