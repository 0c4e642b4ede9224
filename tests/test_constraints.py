import pytest

from convolens.functions import constraints, text
from convolens.functions.dates import cycle_end, next_month, two_format_date
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, "Ann", 5, ["a"], {"k": "v"}, True), (2, None, None, None, None, None), (3, "bob", 7, ["a", "b"], {}, False), (4, "Anna", 5, [], {"z": None}, True)]
    return spark.createDataFrame(rows, "id int, name string, n int, tags array<string>, props map<string,string>, ok boolean")


@pytest.mark.parametrize(
    ("rule", "ids"),
    [
        ({"name": "Ann"}, [1]),
        ({"name": None}, [2]),
        ({"name__ne": "Ann"}, [2, 3, 4]),
        ({"name__ne": None}, [1, 3, 4]),
        ({"n__gt": 5}, [3]),
        ({"n__gte": 5}, [1, 3, 4]),
        ({"n__lt": 7}, [1, 4]),
        ({"n__lte": 5}, [1, 4]),
        ({"n__gt": None}, []),
        ({"n__gt": "5"}, []),
        ({"name__gt": 5}, []),
        ({"name__contains": "nn"}, [1, 4]),
        ({"tags__contains": "b"}, [3]),
        ({"props__contains": "k"}, [1]),
        ({"n__contains": 5}, []),
        ({"n__startswith": "5"}, [1, 4]),
        ({"name__endswith": "a"}, [4]),
        ({"name__in": ["Ann", None]}, [1, 2]),
        ({"name__nin": ["Ann"]}, [2, 3, 4]),
        ({"name__in": "xxAnnxx"}, [1]),
        ({"name__like": "Ann"}, [1]),
        ({"ok": True, "n": 5}, [1, 4]),
        ({"gone": None}, [1, 2, 3, 4]),
        ({"gone": 1}, []),
        ({"gone__ne": 1}, [1, 2, 3, 4]),
        ({}, [1, 2, 3, 4]),
    ],
)
def test_rules(people, rule, ids):
    assert sorted(r["id"] for r in constraints.query(people, rule).collect()) == ids


def test_limit_is_tested_after_a_row(people):
    assert constraints.query(people, {}, limit=0, order="id").count() == 1
    assert constraints.query(people, '{"name": "zz"}', limit=3).count() == 0


def test_key_is_split_at_the_last_mark():
    assert constraints.parse_key("a__b__gt") == ("a__b", "gt")
    assert constraints.parse_key("a__b") == ("a", "eq")
    assert constraints.parse_key("plain") == ("plain", "eq")


def test_text_helpers(spark):
    row = spark.sql("select ' The  Cat\tsat ' as t, 'pay 1,234 now' as m, '1234' as i, '$1,234.50' as a, 'x ```json\\n{\"k\": 1}``` y' as j").select(
        text.tokens(F.col("t")), text.said(F.col("m"), F.col("i")), text.said(F.lit("1234"), F.lit("1,234")), text.amount(F.col("a")), text.amount(F.lit("none")), text.fenced_json(F.col("j"))
    ).first()
    assert list(row) == [["the", "cat", "sat"], True, False, 1234.5, None, '{"k": 1}']
    assert text.valid_pattern("a(b") == "a\\(b"
    assert text.parse_call("f(a=1, b='x')") == ("f", {"a": 1, "b": "x"})
    assert text.parse_call("f(1)") is None and text.parse_call("not a call") is None


def test_dates(spark):
    row = spark.sql("select date'2024-12-10' as d, '02/03/2024' as a, '2024-02-03' as b, 'x' as c").select(cycle_end(F.col("d")).cast("string"), next_month(F.col("d"))[0].cast("string"), next_month(F.col("d"))[1].cast("string"), two_format_date(F.col("a")) == two_format_date(F.col("b")), two_format_date(F.col("c"))).first()
    assert list(row) == ["2024-12-31", "2025-01-01", "2025-01-31", True, None]
