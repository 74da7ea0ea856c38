"""Exact comparison of answers: hand-made pairs, and random expressions against their values."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from loomwright.functions import answers, mathexpr
from loomwright.functions.mathexpr import compare, read

PAIRS = [
    ("2x+2", "2(x+1)", "symbolic"), (r"\sqrt{8}", r"2\sqrt{2}", "symbolic"), ("0.1234567", "1234567/10000000", "rational"), ("12345678901/2", "24691357802/4", "rational"),
    ("123456789012345678901234567890/2", "246913578024691357802469135780/4", "rational"), (r"\frac{1}{\sqrt2}", r"\frac{\sqrt{2}}{2}", "symbolic"), (r"\frac12", "0.5", "rational"),
    ("x^2-1", "(x-1)(x+1)", "symbolic"), (r"\frac{x^2-1}{x-1}", "x+1", "symbolic"), (r"\sqrt{6}", r"\sqrt2\sqrt3", "symbolic"), ("sqrt(8)", "2*sqrt(2)", "symbolic"), (r"\sqrt[3]{16}", r"2\sqrt[3]{2}", "symbolic"),
    (r"2\pi", "2pi", "symbolic"), (r"\sqrt{-4}", "2i", "symbolic"), ("i^2", "-1", "rational"), ("2^{10}", "1024", "rational"), ("2^-1", "0.5", "rational"), ("5!", "120", "rational"), (r"\sin(x+x)", r"\sin(2x)", "symbolic"),
    ("2^{1/2}", r"\sqrt2", "symbolic"), ("x^{1/2}x^{1/2}", "x", "symbolic"), (r"\frac{1}{2-\sqrt{3}}", r"2+\sqrt3", "symbolic"), ("a_1+a_2", "a_2+a_1", "symbolic"), ("9**9", "387420489", "rational"),
    ("-x^2", "-(x^2)", "symbolic"), ("(-x)^2", "x^2", "symbolic"), (r"3\cdot 4", "12", "rational"), ("1-2-3", "-4", "rational"), ("6/2/3", "1", "rational"), (r"\sqrt{49}", "7", "rational"), ("2^3^2", "512", "rational"),
    ("x", "y", "different"), ("1", "2", "different"), ("10^{400}", "10^{400}+1", "different"), (r"\sqrt{2}", "1.41421356", "different"), (r"\sin(x)", r"\cos(x)", "different"), ("(x+y)^2", "x^2+y^2", "different"),
    ("2 3", "6", None), ("hello world", "x", None), (r"\text{yes}", "yes", None), ("1/0", "1/0", None), ("(1,2)", "(1,2)", None), ("(a+b+c+d+f+g)^{60}", "1", None), ("√", "1", None), ("((((", "1", None), ("", "", None),
    ("2^x", "2^x", None), ("sqrt(1000000016000000063)", "1", None), (r"1\frac12", "1.5", None), (None, "1", None), ("(" * 5000 + "1", "1", None), ("9^9^9^9", "1", None), (r"\sqrt[3]{-8}", "-2", None),
]


@pytest.mark.parametrize("a,b,want", PAIRS)
def test_pairs(a, b, want):
    assert compare(a, b) == compare(b, a) == want


def made(rng, depth):
    """A random expression as text, with its value at x = 7/3."""
    if depth == 0 or rng.random() < 0.2:
        n = rng.choice([0, 1, 2, 3, 12, 10**20 + 7])
        return rng.choice([("x", Fraction(7, 3)), (str(n), Fraction(n)), ("1.25", Fraction(5, 4))])
    (a, x), (b, y) = made(rng, depth - 1), made(rng, depth - 1)
    kind = rng.randrange(5)
    if kind == 0:
        return f"({a}+{b})", x + y
    if kind == 1:
        return f"({a}-{b})", x - y
    if kind == 2:
        return rng.choice([f"({a})({b})", rf"{{{a}}}\cdot ({b})"]), x * y
    if kind == 3 and y:
        return rf"\frac{{{a}}}{{{b}}}", x / y
    return f"({a})^2", x * x


def test_random_expressions():
    rng = random.Random(8)
    for _ in range(400):
        text, value = made(rng, 4)
        e = read(text)
        if e is None:
            continue  # a division by an expression that is zero for every x
        at = lambda p: sum(c * Fraction(7, 3) ** int(dict(m).get("x", 0)) for m, c in p.items())
        assert at(e.den) == 0 or at(e.num) / at(e.den) == value, text
        assert compare(text, f"({text})*3-({text})-({text})") in ("rational", "symbolic") and compare(text, f"({text})+1") == "different"


def test_columns(spark):
    df = spark.createDataFrame([("$ X $", "x"), ("2/4", "1/2"), ("2x", "x+x"), ("x", "y"), ("no idea", "x"), (None, "x"), ("x", None)], "a string, b string")
    got = df.select(answers.math_verdict(F.col("a"), F.col("b")).alias("v"), answers.same_math(F.col("a"), F.col("b")).alias("m")).collect()
    assert [tuple(r["v"]) for r in got] == [(True, "strict"), (True, "rational"), (True, "symbolic"), (False, "symbolic"), (None, None), (None, None), (None, None)]
    assert [r["m"] for r in got] == ["strict", "rational", "symbolic", None, None, None, None]


def test_products_with_one_and_roots_met_before_cost_nothing(monkeypatch):
    made = []
    monkeypatch.setattr(mathexpr, "_times", lambda a, b, of=mathexpr._times: made.append((a, b)) or of(a, b))
    mathexpr._root_of.cache_clear()
    for n in range(100, 130):
        assert mathexpr.compare(f"2x+{2 * n}", f"2(x+{n})") == "symbolic" and mathexpr.compare(rf"\frac{{{n}}}{{{2 * n}}}", "0.5") == "rational"
        assert mathexpr.compare(rf"\sqrt{{8}}*{n}", rf"{2 * n}\sqrt{{2}}") == "symbolic"
    assert len(made) < 10
    assert all(type(c) is int for c in mathexpr.read(r"3x^2+\sqrt{8}-7").num.values())
    for a, b, want in [("i^{5/2}", "-i^{1/2}", "symbolic"), ("0", r"\sqrt{0}", "rational"), ("1/3+1/6", "0.5", "rational"), ("sin(x/2)", "sin(0.5x)", "symbolic"), ("7/2", "3", "different")]:
        assert mathexpr.compare(a, b) == want, (a, b)
