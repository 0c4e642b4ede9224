"""Scalar rules against plain Python."""

import ast
import json
import random

from pyspark.sql import functions as F

from convolens.functions import text
from convolens.functions.arithmetic import calculate


def test_outputs_are_equal_by_value(spark):
    values = ["1", "1.0", '"1"', "abc", '"abc"', '{"a": 1, "b": [1.0]}', '{"b":[1],"a":1}', "{a", "true", "null", "", 'q"\\u00e9\n', json.dumps('q"\\u00e9\n'), "1e2", "100", "[1,2]", "[2,1]", "é"]

    def loaded(s):
        try:
            return json.loads(s)
        except ValueError:
            return s

    df = spark.createDataFrame([(a, b) for a in values for b in values], "a string, b string")
    for a, b, same in df.select("a", "b", text.same_output(F.col("a"), F.col("b"))).collect():
        assert same == (loaded(a) == loaded(b)), (a, b)


def test_file_names(spark):
    def plain(name):
        safe = name.replace("/", "_").replace("\\", "_").replace("..", "_")
        return "".join(c if c.isalnum() or c in "._-" else "_" for c in safe)[:255]

    names = ["a..b", "é x", "a/../b", "...", "日本 語\\x", "½²Ⅷ", "a" * 300, "", "😀.txt", "../..", "n\u0303"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(text.safe_filename(F.col("n"))).collect()] == [plain(n) for n in names]


def test_calculations_of_any_length():
    rng = random.Random(1)
    for _ in range(3000):
        written = "".join(rng.choices(["1", "2.5", ".5", "3.", "0", "07", "+", "-", "*", "/", "(", ")", " "], k=rng.randrange(1, 12)))
        try:
            tree = ast.parse(written.strip(), mode="eval").body
            allowed = all(isinstance(n, (ast.BinOp, ast.UnaryOp, ast.Constant, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.UAdd, ast.USub)) for n in ast.walk(tree))
            wanted = round(float(eval(compile(ast.Expression(tree), "", "eval"))), 2) if allowed else None
        except (SyntaxError, ZeroDivisionError, TypeError, ValueError):
            wanted = None
        assert calculate(written) == wanted, written
    assert calculate("1+" * 50_000 + "1") == 50_001 and calculate("(" * 5000 + "2" + ")" * 5000) == 2 and calculate("-" * 9999 + "1") == -1
    assert calculate("9" * 400) is None and calculate("2**3") is None and calculate("import") is None and calculate(None) is None
