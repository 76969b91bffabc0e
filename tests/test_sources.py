import pytest
from pyspark.sql import functions as F

from eigenframe.operators import missing, rows, transforms
from eigenframe.operators.aggregate import aggregate_rows
from eigenframe.roles import Roles, stem, toggle_role, unique_name
from eigenframe.sources import tables


def put(tmp_path, text, name="t.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_dialects(spark, tmp_path):
    d = tables.detect_dialect(spark, put(tmp_path, "n;x;y\na;1,5;2\nb;3,0;NA\n"))
    assert d == tables.Dialect(";", ",", True)
    assert tables.detect_dialect(spark, put(tmp_path, "1\t2\n3\t4\n", "b")) == tables.Dialect("\t", ".", False)
    assert tables.detect_dialect(spark, put(tmp_path, "a,b\n1,2\n", "c")) == tables.Dialect(",", ".", True)


def test_mixed_read(spark, tmp_path):
    path = put(tmp_path, "id;x;grp;y#target;code#category\nr1;1,5;A;2,0;1\nr2;NA;B;3,5;2\nr3;inf;A;m;1\n")
    df, roles = tables.read_table(spark, path, dialect=tables.EUROPEAN, id_col="id")
    assert roles == Roles(("x",), ("grp", "code#category"), ("y#target",), "id", None, tuple(df.columns))
    got = df.orderBy("id").collect()
    assert [r["x"] for r in got] == [1.5, None, float("inf")] and [r["y#target"] for r in got] == [2.0, 3.5, None]


def test_numeric_read_is_strict(spark, tmp_path):
    path = put(tmp_path, "x,y\n1,2\n3,oops\n")
    df, _ = tables.read_table(spark, path, mode="numeric")
    with pytest.raises(Exception, match="not a number"):
        df.collect()
    assert tables.read_table(spark, path, mode="text")[0].count() == 2


def test_ragged_rows_fail(spark, tmp_path):
    df = tables.read_text(spark, put(tmp_path, "x,y\n1,2\n3\n"))
    with pytest.raises(Exception, match="(?i)malformed"):
        df.collect()


def test_header_below_the_first_line(spark, tmp_path):
    path = put(tmp_path, "a note\n\nx,y\n1,2\n3,4\n")
    df, roles = tables.read_table(spark, path, header_row=2)
    assert roles.features == ("x", "y") and sorted(r["x"] for r in df.collect()) == [1.0, 3.0]


def test_subset_and_limit(spark, tmp_path):
    path = put(tmp_path, "x,y,z\n1,2,3\n4,5,6\n7,8,9\n")
    df, _ = tables.read_table(spark, path, columns=["z", "x"], limit=2)
    assert df.columns == ["z", "x"] and df.count() == 2


def test_write(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.25, "a"), (2, float("inf"), None), (3, float("nan"), "b"), (4, None, "c")], "i int, x double, s string")
    tables.write_table(df.coalesce(1), str(tmp_path / "o"), dialect=tables.EUROPEAN, precision=1, null="NA")
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "o")).collect())
    assert lines == ["1;1,3;a", "2;Inf;NA", "3;NaN;b", "4;NA;c", "i;x;s"]


def test_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, bytearray(b"ab"))], "k int, x double, b binary")
    df.write.parquet(str(tmp_path / "p"))
    got, roles = tables.read_table(spark, str(tmp_path / "p"), "parquet", id_col="k")
    assert roles.features == ("x",) and roles.categorical == ("b",) and got.first()["b"] == "ab"


def test_roles(spark):
    assert stem("age #Target") == "age" and unique_name("x#category", ["x", "x_2"]) == "x_3"
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "x string, y string")
    roles = Roles((), ("x", "y"), (), None, None, ("x", "y"))
    out, roles = toggle_role(df, roles, "x", "targets")
    assert roles.targets == ("x",) and out.schema["x"].dataType.simpleString() == "double"
    out, roles = toggle_role(out, roles, "x", "targets")
    assert roles.features == ("x",) and roles.renamed("x", "z").features == ("z",) and roles.without("x").features == ()
    assert rows.set_row_names(df, roles, "y").id_col == "y"
    assert rows.demote_row_names(df, rows.set_row_names(df, roles, "y")).categorical == ("y",)
    with pytest.raises(ValueError):
        rows.set_row_names(df.union(df), roles, "y")


def test_filters(spark):
    df = spark.createDataFrame([("5.0",), (" x ",), ("",), (None,), ("10",)], "c string")
    pick = lambda op, v=None, m="keep": [r["c"] for r in rows.filter_rows(df, "c", op, v, m).collect()]
    assert pick("equals", "5") == ["5.0"] and pick("equals", "X") == [" x "]
    assert pick(">", "9") == ["10"] and pick("is_empty") == ["", None]
    assert pick("not_equals", "5") == [" x ", "10"] and len(pick("not_equals", "5", "remove")) == 3
    with pytest.raises(ValueError):
        pick("like", "x")


def test_transpose(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 2.0), (2, None, 3.0, 4.0), (3, "a", 5.0, 6.0)], "i int, n string, x double, y double")
    got = rows.transpose(df, "n", ["x", "y"], ["i"])
    assert got.columns == ["variable", "a", "Row_2", "a_2"]
    assert sorted(tuple(r) for r in got.collect()) == [("x", 1.0, 3.0, 5.0), ("y", 2.0, 4.0, 6.0)]


def test_guards(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", 2.0)], "g string, x double")
    with pytest.raises(Exception, match="blank"):
        aggregate_rows(df, "g", "mean", ["x"]).collect()
    with pytest.raises(ValueError):
        missing.guard_regression("mean")
    with pytest.raises(ValueError):
        missing.drop_incomplete(spark.createDataFrame([(None,)], "x double"), ["x"])
    zero = spark.createDataFrame([(0.0, 1.0)], "a double, b double")
    with pytest.raises(Exception, match="no replacement"):
        transforms.clr(zero, ["a", "b"]).collect()
    with pytest.raises(Exception, match="outside its domain"):
        transforms.strict_transform(zero, "log", ["a"]).collect()
    many = spark.range(30).select(F.col("id").cast("string").alias("v"))
    with pytest.raises(ValueError):
        transforms.one_hot(many, ["v"])
    assert len(transforms.one_hot(many, ["v"], max_levels=30).columns) == 31
    with pytest.raises(ValueError):
        transforms.split_column(spark.createDataFrame([("-".join("x" * 30),)], "c string"), "c", "-")


def test_clr_rows_sum_to_zero_and_ignore_scale(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (10.0, 20.0, 50.0)], "a double, b double, c double")
    got = [tuple(r) for r in transforms.clr(df, ["a", "b", "c"], drop=True).collect()]
    assert got[0] == pytest.approx(got[1]) and sum(got[0]) == pytest.approx(0)
