"""The typed header, reading, writing and the command line."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import Engine
from lodestone.__main__ import main
from lodestone.operators import join
from lodestone.sources.header import HeaderError, format_header, parse_header
from lodestone.sources.sink import write_typed_csv
from lodestone.sources.tables import CORRUPT, load_directory, read_plain_csv, read_queries, read_typed_csv

LONG = "N" * 60
PEOPLE = f'''id (N) (P),name (T),salary (N),joined (D)\r
1,Alice,70000.5,2023-01-15 08:45:00\r
2,"Bob, Jr",65800.75,2022-08-05\r
3,,bad,NULL\r
4,Zed,-5,2021-02-31 00:00:00\r
\r
5,Short\r
6,{LONG},1e9,2024-02-29 23:59:59\r
'''


@pytest.fixture()
def people(tmp_path):
    p = tmp_path / "people.csv"
    p.write_bytes(PEOPLE.encode())
    return str(p)


def test_header():
    s = parse_header("id (P) (N) , name(T), at (D)\r\n")
    assert [f.name for f in s] == ["id", "name", "at"]
    assert [f.dataType for f in s] == [T.DoubleType(), T.StringType(), T.TimestampNTZType()]
    assert [f.metadata["primary_key"] for f in s] == [True, False, False]
    assert parse_header("a (T) (N)")[0].dataType == T.DoubleType()  # the later type wins
    assert format_header(s) == "id (N) (P),name (T),at (D)"


@pytest.mark.parametrize("line", ["id", "id (N", "id (X)", "id (P)", "id (N),name", "id N)", "a (N) b"])
def test_bad_headers(line):
    with pytest.raises(HeaderError):
        parse_header(line)


def test_reading(spark, people):
    rows = read_typed_csv(spark, people).orderBy("id").collect()
    assert len(rows) == 6
    assert [r.name for r in rows] == ["Alice", "Bob, Jr", "", "Zed", "Short", LONG]
    assert [r.salary for r in rows] == [70000.5, 65800.75, None, -5.0, None, 1e9]
    assert rows[0].joined == datetime.datetime(2023, 1, 15, 8, 45)
    assert rows[1].joined == datetime.datetime(2022, 8, 5)
    assert rows[2].joined is None and rows[3].joined is None and rows[4].joined is None
    assert rows[5].joined == datetime.datetime(2024, 2, 29, 23, 59, 59)


def test_corrupt_lines(spark, people):
    df = read_typed_csv(spark, people, keep_corrupt=True)
    assert {r.id for r in df.collect() if r[CORRUPT] is not None} >= {3.0, 5.0}


def test_predicates_on_missing_values_fail(spark, people):
    df = read_typed_csv(spark, people)
    assert {r.id for r in df.filter("salary > -100").collect()} == {1.0, 2.0, 4.0, 6.0}
    assert [r.salary for r in df.filter("salary is not null").orderBy("salary").collect()] == [-5.0, 65800.75, 70000.5, 1e9]


def test_round_trip(spark, people, tmp_path):
    df = read_typed_csv(spark, people).orderBy("id")
    out = write_typed_csv(df, str(tmp_path / "out" / "copy.csv"))
    again = read_typed_csv(spark, out)
    assert again.schema == df.schema
    assert again.orderBy("id").collect() == df.collect()


def test_directory_and_sql(spark, people, tmp_path):
    assert set(load_directory(spark, str(tmp_path))) == {"people"}
    e = Engine(spark)
    assert e.load_dir(str(tmp_path)) == ["people"] and "people" in e.tables()
    got = e.sql("select name from people where salary > 66000 or name = 'Zed' order by id").collect()
    assert [r[0] for r in got] == ["Alice", "Zed", LONG]
    assert "Scan csv" in e.explain("select name from people where salary > 1")


def test_command_line(spark, people, tmp_path, capsys):
    assert main([str(tmp_path), "select count(*) as n, max(salary) as top from people", "--out", str(tmp_path / "r"), "--explain"]) == 0
    assert (tmp_path / "r" / "result.csv").read_text() == "n (N),top (N)\n6,1000000000.0\n"
    assert main([str(tmp_path), "select nothing from nowhere"]) == 1


def test_untyped_header_is_an_error(spark, tmp_path):
    (tmp_path / "sales.csv").write_text("SalesID,CustomerID\n1,2\n")
    with pytest.raises(HeaderError):
        read_typed_csv(spark, str(tmp_path / "sales.csv"))


def test_plain_csv_and_query_files(spark, tmp_path):
    (tmp_path / "sales.csv").write_bytes(b"SalesID,CustomerID\r\n1,\"a,b\"\r\n")
    assert [tuple(r) for r in read_plain_csv(spark, str(tmp_path / "sales.csv")).collect()] == [("1", "a,b")]
    assert read_plain_csv(spark, str(tmp_path / "sales.csv"), header=False).count() == 2
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "two.sql").write_text("select 2")
    (tmp_path / "q" / "one.sql").write_text("select\n1")
    assert read_queries(spark, str(tmp_path / "q")) == {"one": "select\n1", "two": "select 2"}


VALUES = st.tuples(
    st.one_of(st.none(), st.floats(allow_nan=False), st.just(float("inf"))),
    st.text(st.characters(exclude_categories=("Cs",), exclude_characters="\x00"), max_size=12) | st.sampled_from(["  lead", "a\nb", "c\r\nd", '"q"', "x,y", " ", "\r", "\\", "NULL", "'"]),
    st.one_of(st.none(), st.datetimes(datetime.datetime(1, 1, 1), datetime.datetime(9999, 12, 31))),
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(VALUES, max_size=6))
def test_what_is_written_is_read(spark, tmp_path, rows):
    schema = T.StructType([T.StructField(n, k, True, {"primary_key": n == "n", "source_type": tag}) for n, k, tag in (("n", T.DoubleType(), "N"), ("t", T.StringType(), "T"), ("d", T.TimestampNTZType(), "D"))])
    df = spark.createDataFrame(rows, schema).coalesce(2)
    for out in (str(tmp_path / "one.csv"), str(tmp_path / "parts")):
        again = read_typed_csv(spark, Engine(spark).write_result(df, out))
        assert [(f.name, f.dataType, f.metadata) for f in again.schema] == [(f.name, f.dataType, f.metadata) for f in schema]
        assert sorted(map(repr, again.collect())) == sorted(map(repr, df.collect()))


def test_blanks_and_line_ends(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_bytes(b'n (N),t (T),d (D)\r\n 1,  lead,  2024-01-01 01:02:03.000004\r\n2,"a\nb","2024-01-02"\r\n')
    assert [tuple(r) for r in read_typed_csv(spark, str(p)).collect()] == [(1.0, "  lead", datetime.datetime(2024, 1, 1, 1, 2, 3, 4)), (2.0, "a\nb", datetime.datetime(2024, 1, 2))]
    assert read_typed_csv(spark, str(p), multiline=False).count() == 3


def test_moments_keep_their_wall_clock_in_any_zone(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("d (D)\n2024-03-10 02:30:00\n")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert read_typed_csv(spark, str(p)).first()[0] == datetime.datetime(2024, 3, 10, 2, 30)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_command_line_writes_parts(spark, people, tmp_path):
    assert main([str(tmp_path), "select name, joined from people", "--out", str(tmp_path / "r"), "--parts"]) == 0
    assert read_typed_csv(spark, str(tmp_path / "r" / "result")).count() == 6


def test_two_key_join_of_plain_files(spark, tmp_path):
    """Sales of two years that agree in person and customer, with the columns of both sides."""
    header = "SalesID,SalesPersonID,CustomerID,ProductID"
    made = {name: [(k, (k * a) % 7, (k * b) % 5, k % 3) for k in range(n)] for name, a, b, n in (("sales1", 3, 2, 60), ("sales2", 5, 4, 100))}
    for name, rows in made.items():
        (tmp_path / f"{name}.csv").write_bytes("\r\n".join([header, *(",".join(map(str, r)) for r in rows), ""]).encode())
    a, b = (read_plain_csv(spark, str(tmp_path / f"{n}.csv")).alias(n) for n in made)
    same = [F.col(f"sales1.{c}") == F.col(f"sales2.{c}") for c in ("SalesPersonID", "CustomerID")]
    got = join(a, b, *same).select("sales1.*", "sales2.*")
    want = [(*x, *y) for x in made["sales1"] for y in made["sales2"] if x[1:3] == y[1:3]]
    assert len(got.columns) == 8 and sorted(tuple(map(int, r)) for r in got.collect()) == sorted(want)
