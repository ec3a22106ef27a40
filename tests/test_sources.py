import pytest
from pyspark.sql import functions as F

from tessera.sources.csv import as_unsigned_integer, is_double, is_integer, is_unsigned_integer, named, read_csv, type_string
from tessera.sources.lines import first_line, lines
from tessera import tools
from tessera.console import Stats, Timer, cout, welcome
from tessera.session import shared_dir
from tessera.sources.outputs import day_path_of_seconds, write_daily, write_lines
from tessera.sources.records import as_json, as_text, as_variants, file_count, json_erase, json_keep, null_counts, read_ndjson, read_parquet, row_count, schema_to_string
from tessera.tools import convert


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"This file\r\nhas two lines.")
    (tmp_path / "b.txt").write_bytes(b"x\ny\n")
    both = [r.value for r in lines(spark, [str(tmp_path), str(tmp_path / "a.txt"), str(tmp_path / "none")]).collect()]
    assert sorted(both) == sorted(["This file\r", "has two lines.", "x", "y"])
    assert sorted(r.value for r in lines(spark, [str(tmp_path)], skip_first=True).collect()) == ["has two lines.", "y"]
    assert first_line(spark, [str(tmp_path)]) == "This file\r"


@pytest.mark.parametrize("line, fields", [
    (" a , 1,x y ", ["a ", "1", "x y "]), (r'"p\"q",2,z', ['p"q', "2", "z"]), ('"a""b",3,w', ["a", "3", "w"]), ("1,,3", ["1", "", "3"]), ("1,2,", ["1", "2"]), ("7,8,9,10", ["7", "8", "9", "10"]), ("# note", None), ("", None),
])
def test_csv_dialect(spark, tmp_path, line, fields):
    (tmp_path / "a.csv").write_text(line + "\n")
    assert [r.fields for r in read_csv(spark, [str(tmp_path)])[0].collect()] == ([fields] if fields else [])


def test_csv_headers_and_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text("zero, four, two, six\n" + "0, 4, 2, 6\n" * 4)
    rows, names = read_csv(spark, [str(tmp_path)], header=True)
    assert names == {"zero": 0, "four": 1, "two": 2, "six": 3}
    assert {tuple(r) for r in named(rows, names).select("two", "six").collect()} == {("2", "6")} and rows.count() == 4
    one = spark.createDataFrame([([" 5", "5 ", "-5", "1e3", "nan", "", "99999999999999999999"],)], "f array<string>")
    tests = one.select(*(F.transform("f", t) for t in (is_integer, is_unsigned_integer, is_double)), type_string(F.col("f"))).first()
    assert tests[0] == [True, False, True, False, False, False, False] and tests[1] == tests[0]
    assert tests[2] == [True, False, True, True, False, False, True] and tests[3] == "ISIDSSD"
    assert one.select(as_unsigned_integer(F.col("f")[2])).first()[0] == 2**64 - 5


def test_json_and_parquet(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "name": "x"}\n{"id": 2, "extra": null}\n')
    assert read_ndjson(spark, [str(tmp_path / "a.json")]).select(F.expr("variant_get(value, '$.id', 'bigint')").alias("i")).agg(F.sum("i")).first()[0] == 3
    spark.createDataFrame([(1, None), (2, "b")], "a int, b string").coalesce(1).write.parquet(str(tmp_path / "p"))
    rows = read_parquet(spark, [str(tmp_path / "p")]).orderBy("a")
    assert [r.value for r in as_json(rows).collect()] == ['{"a":1,"b":null}', '{"a":2,"b":"b"}']
    assert [r.value for r in as_text(rows).collect()] == ["1 [NA]", "2 b"]


def test_convert(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,1.5,x\n2,3,4\n")
    assert convert(spark, str(tmp_path / "a.csv"), str(tmp_path / "out")) == ["bigint", "double", "string"]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, 1.5, "x"), (2, 3.0, "4")]


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame([("a/b", "1"), ("a/b", "2"), ("c", "3"), (None, "4"), ("c", None)], "path string, line string")
    assert write_lines(df, str(tmp_path / "out")) == 2
    write_lines(df.where("path = 'c'"), str(tmp_path / "out"), append=True)
    assert sorted((tmp_path / "out/a/b").read_text().split()) == ["1", "2"] and (tmp_path / "out/c").read_text() == "3\n3\n"
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a", "c"]
    with pytest.raises(FileExistsError):
        write_lines(df, str(tmp_path / "out/c"))
    assert spark.range(1).select(day_path_of_seconds(F.lit(0)), day_path_of_seconds(F.lit(2678400))).first()[:] == ("1970/1/1", "1970/2/1")


def test_local_prefix(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\n")
    assert sorted(r[0] for r in lines(spark, [f"local://{tmp_path}/a.txt"]).collect()) == ["x", "y"]
    assert lines(spark, [f"local://{tmp_path}/none.txt"]).count() == 0


@pytest.mark.parametrize("line", ["1", '"x"', "[1]", "{", "null"])
def test_only_objects_are_records(spark, tmp_path, line):
    (tmp_path / "a.json").write_text('{"id": 1}\n' + line + "\n")
    with pytest.raises(Exception, match="no JSON object"):
        read_ndjson(spark, [str(tmp_path)]).selectExpr("string(value)").collect()
    assert sorted([r[0] for r in read_ndjson(spark, [str(tmp_path)], strict=False).selectExpr("string(value)").collect()], key=repr) == sorted(['{"id":1}', None], key=repr)


def test_fields_are_erased_and_kept(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1, "b": [2, {"c": null}], "d": null}\n{}\n')
    rows = read_ndjson(spark, [str(tmp_path)])
    for how, keys, want in ((json_erase, ["a", "z"], [('{"b":[2,{"c":null}],"d":null}', 1), ("{}", 0)]), (json_keep, ["a", "d"], [('{"a":1,"d":null}', 1), ("{}", 0)])):
        got = rows.select(how(F.col("value"), keys).alias("x")).select(F.to_json("x.value"), "x.erased").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_parquet_figures_and_variants(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame([(1, None, [1, 2]), (2, "b", None)], "a int, b string, c array<int>").repartition(2).write.parquet(path)
    spark.createDataFrame([], "a int, b string, c array<int>").write.mode("append").parquet(path)  # a file without rows
    assert row_count(spark, [path]) == 2 and file_count(spark, [path]) >= 2
    assert schema_to_string(spark, [path]) == "int a\nstring b\narray<int> c"
    rows = as_variants(read_parquet(spark, [path]))
    assert sorted(str([None if v is None else v.toPython() for v in r.value]) for r in rows.collect()) == ["[1, None, [1, 2]]", "[2, 'b', None]"]
    assert null_counts(rows).first()[:] == (4, 2)
    for mode in (None, "r", "v", "j"):
        assert tools.rowcount(spark, [path], mode)[0] == 2
    assert tools.dump(spark, path, str(tmp_path / "out")) == (2, 0)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1 [NA] [1, 2]", "2 b [NA]"]
    assert tools.main([]) == tools.main(["rowcount"]) == tools.main(["convert", "x"]) == 2


def test_daily_output(spark, tmp_path):
    df = spark.createDataFrame([(0, "a"), (86399, "b"), (2678400, "c"), (None, "d"), (1709164800, "e=1/2")], "seconds bigint, line string")
    assert write_daily(df, f"file://{tmp_path}/days") == 3
    assert write_daily(spark.createDataFrame([(5, "z")], "seconds bigint, line string"), f"file://{tmp_path}/days", append=True) == 1
    lines_of = lambda d: (tmp_path / "days" / d).read_text().splitlines()
    assert sorted(lines_of("1970/1/1")[:2]) == ["a", "b"] and lines_of("1970/1/1")[2:] == ["z"]
    assert lines_of("1970/2/1") == ["c"] and lines_of("2024/2/29") == ["e=1/2"]


def test_console_and_figures(spark, capsys):
    assert cout(spark.range(3), "id") == 3 and "Spark" in welcome(spark)
    with Stats(spark) as stats:
        spark.range(10).repartition(2).count()
    assert stats.jobs >= 1 and stats.tasks >= 1 and stats.failed == 0 and Timer().elapsed() >= 0 and "jobs" in stats.report()


def test_a_cluster_must_name_the_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Session:
        conf = sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
