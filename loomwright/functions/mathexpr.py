"""Exact comparison of mathematical answers.

An answer (plain or LaTeX) is read as a quotient of two polynomials with rational
coefficients. Their indeterminates are variables, constants such as pi, function
values, and fractional powers of primes: a root of a number is a product of these,
which no rational relation joins, so sums of roots have one form too. Two answers
are equal if the cross products are. All numbers are exact, of any size; what
isn't read this way is left to a judge.
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import lru_cache
from math import isqrt

#: What would have more terms, exponents or bits than these is left to a judge, so that no answer can hold up a task.
MOST_TERMS, MOST_POWER, MOST_BITS = 2000, 1000, 20_000
#: Prime factors are searched for up to here; a rest that is no prime is left to a judge.
MOST_FACTOR = 100_000

Monomial = tuple[tuple[object, Fraction], ...]  # indeterminates and their exponents, in order
#: Coefficients are whole numbers where they can be, as these are far quicker. A polynomial is never changed.
Polynomial = dict[Monomial, "Fraction | int"]


class Unreadable(Exception):
    """Not an expression of the kinds known here, or too large."""


def _number(x: Fraction | int) -> Polynomial:
    return {(): x.numerator if x.denominator == 1 else x} if x else {}


_ONE = _number(1)


def _times(a: Monomial, b: Monomial) -> tuple[Monomial, Fraction]:
    """The product, and the rational factor that comes out: whole powers of primes, and i squared."""
    powers = dict(a)
    for name, e in b:
        powers[name] = powers.get(name, Fraction(0)) + e
    factor, out = 1, []
    for name, e in powers.items():
        if isinstance(name, int) and (whole := e.numerator // e.denominator):
            factor *= name**whole if whole > 0 else Fraction(1, name**-whole)
            e -= whole
        if name == "i" and e >= 2:
            factor, e = factor * (-1) ** int(e // 2), e % 2
        if e:
            out.append((name, e))
    return tuple(sorted(out, key=repr)), factor


def _plus(a: Polynomial, b: Polynomial) -> Polynomial:
    out = dict(a)
    for m, c in b.items():
        out[m] = out.get(m, 0) + c
        if not out[m]:
            del out[m]
    return out


def _within(a: Polynomial) -> Polynomial:
    """The polynomial, if it isn't too large."""
    if len(a) > MOST_TERMS:
        raise Unreadable
    for c in a.values():
        if c.numerator.bit_length() + c.denominator.bit_length() > MOST_BITS:
            raise Unreadable
    return a


def _multiply(a: Polynomial, b: Polynomial) -> Polynomial:
    if a == _ONE or b == _ONE:
        return _within(a if b == _ONE else b)
    if len(a) * len(b) > MOST_TERMS * 20:
        raise Unreadable
    out: Polynomial = {}
    for m, c in a.items():
        for n, d in b.items():
            both, factor = _times(m, n) if m and n else (m or n, 1)
            x = out[both] = out.get(both, 0) + c * d * factor
            if x.numerator.bit_length() + x.denominator.bit_length() > MOST_BITS:
                raise Unreadable
    out = {m: c for m, c in out.items() if c}
    if len(out) > MOST_TERMS:
        raise Unreadable
    return out


def _is_prime(n: int) -> bool:
    """Miller and Rabin's test with the first thirteen primes as bases: exact below 3 * 10^24, and no known error above."""
    bases = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41)
    if n in bases:
        return True
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in bases:
        x = pow(a, d, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(r - 1)):
            return False
    return n > 1


@lru_cache(maxsize=10_000)
def _factors(n: int) -> tuple[tuple[int, int], ...]:
    """Primes of n > 0 and their exponents."""
    out, p = [], 2
    while p * p <= n and p < MOST_FACTOR:
        e = 0
        while n % p == 0:
            n, e = n // p, e + 1
        if e:
            out.append((p, e))
        p += 1 + (p > 2)
    if n > 1:
        e = 1
        while (r := isqrt(n)) * r == n:
            n, e = r, 2 * e
        if p * p <= n and not _is_prime(n):
            raise Unreadable
        out.append((n, e))
    return tuple(out)


class Expression:
    """num / den."""

    def __init__(self, num: Polynomial, den: Polynomial | None = None) -> None:
        self.num, self.den = num, den or _ONE

    def __add__(self, o: Expression) -> Expression:
        if self.den == o.den:
            return Expression(_plus(self.num, o.num), self.den)
        return Expression(_plus(_multiply(self.num, o.den), _multiply(o.num, self.den)), _multiply(self.den, o.den))

    def __neg__(self) -> Expression:
        return Expression({m: -c for m, c in self.num.items()}, self.den)

    def __mul__(self, o: Expression) -> Expression:
        return Expression(_multiply(self.num, o.num), _multiply(self.den, o.den))

    def inverse(self) -> Expression:
        if not self.num:
            raise Unreadable
        return Expression(self.den, self.num)

    def rational(self) -> Fraction | None:
        """The value of an expression of rational numbers alone."""
        if set(self.num) <= {()} and set(self.den) == {()}:
            return Fraction(self.num.get((), 0)) / self.den[()]
        return None

    def __eq__(self, o: object) -> bool:
        return isinstance(o, Expression) and _multiply(self.num, o.den) == _multiply(o.num, self.den)

    __hash__ = None

    def power(self, e: Fraction) -> Expression:
        if e < 0:
            return self.inverse().power(-e)
        if e > MOST_POWER:
            raise Unreadable
        if e.denominator == 1:
            out, base, k = Expression(_ONE), self, e.numerator
            while k:
                out, base, k = out * base if k & 1 else out, base * base if k > 1 else base, k >> 1
            return out
        return _root(self, e)


def _root(x: Expression, e: Fraction) -> Expression:
    """A fractional power of a number, or of a variable."""
    q = x.rational()
    if q is None:
        only = list(x.num.items())
        if x.den == _ONE and len(only) == 1 and only[0][1] == 1 and len(only[0][0]) == 1 and only[0][0][0][1] == 1 and isinstance(only[0][0][0][0], str):
            m, factor = _times((), ((only[0][0][0][0], e),))
            return Expression({m: factor})
        raise Unreadable
    return _root_of(q, e)


@lru_cache(maxsize=2000)
def _root_of(q: Fraction, e: Fraction) -> Expression:
    """A fractional power of a number; answers have the same few."""
    if q == 0:
        return Expression({})
    out = Expression(_ONE)
    if q < 0:
        if e.denominator == 2:
            out = Expression({(("i", Fraction(1)),): 1}).power(Fraction(e.numerator))
        else:  # an odd root of a negative number may mean the real one or the principal one
            raise Unreadable
        q = -q
    if max(q.numerator.bit_length(), q.denominator.bit_length()) * e > MOST_BITS:
        raise Unreadable
    for n, sign in ((q.numerator, 1), (q.denominator, -1)):
        for p, k in _factors(n):
            m, factor = _times((), ((p, sign * k * e),))
            out = out * Expression({m: factor})
    return out


# Names in answers.
FUNCTIONS = ("sin", "cos", "tan", "cot", "sec", "csc", "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "ln", "log", "exp")
CONSTANTS = ("pi", "alpha", "beta", "gamma", "delta", "theta", "lambda", "mu", "sigma", "phi", "omega")
_TOKEN = re.compile(r"\s*(?:(\d+\.\d+|\.\d+|\d+\.?)|\\(?:left|right|big|Big|,|;|!|:| )|\\([A-Za-z]+)|(\*\*)|(" + "|".join(sorted(("sqrt", *FUNCTIONS, *CONSTANTS), key=len, reverse=True)) + r")(?![A-Za-z])|([A-Za-z])|([-+*/^(){}\[\]!·×÷−_]))", re.UNICODE)
_WORD = re.compile(r"(?<![\\A-Za-z])[A-Za-z]{3,}")
_SAME = {"−": "-", "·": "*", "×": "*", "÷": "/", "**": "^"}
_COMMANDS = {"cdot": "*", "times": "*", "div": "/", "dfrac": "frac", "tfrac": "frac", "cfrac": "frac"}


def _tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text): number, name, letter or sign. Three letters and more in a row are a name, or a word and no product."""
    out, at = [], 0
    text = text.strip().strip("$").strip()
    if any(w not in ("sqrt", *FUNCTIONS, *CONSTANTS) for w in _WORD.findall(text)):
        raise Unreadable
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise Unreadable
        number, command, power, name, letter, sign = m.groups()
        if number:
            out.append(("number", number))
        elif command:
            c = _COMMANDS.get(command, command)
            out.append(("sign", c) if c in "*/" else ("name", c))
        elif name:
            out.append(("name", name))
        elif letter:
            out.append(("letter", letter))
        elif power or sign:
            out.append(("sign", _SAME.get(power or sign, power or sign)))
        at = m.end()
    return out


class _Reader:
    """Recursive descent over the tokens."""

    PAIRS = {"(": ")", "[": "]", "{": "}"}

    def __init__(self, tokens: list[tuple[str, str]]) -> None:
        self.tokens, self.at, self.depth = tokens, 0, 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, sign: str | None = None) -> tuple[str, str]:
        t = self.peek()
        if t[0] == "end" or sign is not None and t != ("sign", sign):
            raise Unreadable
        self.at += 1
        return t

    def whole(self) -> Expression:
        x = self.sum()
        if self.at < len(self.tokens):
            raise Unreadable
        return x

    def sum(self) -> Expression:
        self.depth += 1
        if self.depth > 100:
            raise Unreadable
        x = self.product()
        while self.peek() in (("sign", "+"), ("sign", "-")):
            sign = self.take()[1]
            y = self.product()
            x = x + (y if sign == "+" else -y)
        self.depth -= 1
        return x

    def product(self) -> Expression:
        minus = False
        while self.peek() in (("sign", "-"), ("sign", "+")):
            minus ^= self.take()[1] == "-"
        was_number, x = self.peek()[0] == "number", self.factor()
        while True:
            kind, text = self.peek()
            if (kind, text) in (("sign", "*"), ("sign", "/")):
                self.take()
                minus ^= self.peek() == ("sign", "-") and bool(self.take())
                y = self.factor()
                x = x * (y if text == "*" else y.inverse())
            elif kind in ("number", "name", "letter") or text in self.PAIRS:
                if kind == "number" or was_number and (kind, text) == ("name", "frac"):  # `2 3` and mixed numbers
                    raise Unreadable
                x = x * self.factor()
            else:
                return -x if minus else x
            was_number = False

    def factor(self) -> Expression:
        x = self.atom()
        while self.peek() in (("sign", "^"), ("sign", "!")):
            if self.take()[1] == "!":
                n = x.rational()
                if n is None or n < 0 or n.denominator != 1 or n > 500:
                    raise Unreadable
                value = 1
                for k in range(2, int(n) + 1):
                    value *= k
                x = Expression(_number(value))
            else:
                e = self.exponent().rational()
                if e is None:
                    raise Unreadable
                x = x.power(e)
        return x

    def exponent(self) -> Expression:
        """`^12` is read as the plain text that it mostly is; LaTeX would take the 1 alone."""
        minus = self.peek() == ("sign", "-") and bool(self.take())
        x = self.atom()
        if self.peek() == ("sign", "^"):
            self.take()
            e = self.exponent().rational()
            if e is None:
                raise Unreadable
            x = x.power(e)
        return -x if minus else x

    def group(self) -> Expression:
        sign = self.take()[1]
        if sign not in self.PAIRS:
            raise Unreadable
        x = self.sum()
        self.take(self.PAIRS[sign])
        return x

    def argument(self) -> Expression:
        """`{...}`, or the one digit or letter that a command takes without braces."""
        kind, text = self.peek()
        if kind == "number" and text.isdigit() and len(text) > 1:  # \\frac12
            self.tokens[self.at : self.at + 1] = [("number", d) for d in text]
        return self.group() if self.peek() == ("sign", "{") else self.atom()

    def atom(self) -> Expression:
        kind, text = self.peek()
        if kind == "number":
            self.take()
            if len(text) > MOST_BITS // 4:
                raise Unreadable
            return Expression(_number(int(text) if text.isdecimal() else Fraction(text.rstrip("."))))
        if kind == "letter":
            self.take()
            if self.peek() == ("sign", "_"):
                self.take()
                text += "_" + (str(self.group().rational()) if self.peek() == ("sign", "{") else self.take()[1])
            return Expression({((text, Fraction(1)),): 1})
        if kind == "sign":
            return self.group()
        if kind != "name":
            raise Unreadable
        self.take()
        if text == "frac":
            a = self.argument()
            return a * self.argument().inverse()
        if text == "sqrt":
            degree = Fraction(2)
            if self.peek() == ("sign", "["):
                degree = self.group().rational()
                if degree is None or degree.denominator != 1 or not 2 <= degree <= MOST_POWER:
                    raise Unreadable
            x = self.group() if self.peek() == ("sign", "(") else self.argument()
            return x.power(1 / degree)
        if text in CONSTANTS:
            return Expression({((text, Fraction(1)),): 1})
        if text in FUNCTIONS and self.peek()[1] in self.PAIRS:
            x = self.group()
            if set(x.den) != {()}:
                raise Unreadable
            of = tuple(sorted(((m, Fraction(c) / x.den[()]) for m, c in x.num.items()), key=repr))
            return Expression({(((text, of), Fraction(1)),): 1})
        raise Unreadable


@lru_cache(maxsize=20_000)
def read(text: str) -> Expression | None:
    """The expression of an answer; None if it isn't one."""
    try:
        return _Reader(_tokens(text)).whole()
    except (Unreadable, RecursionError):
        return None


def compare(a: str | None, b: str | None) -> str | None:
    """`rational` for equal rational numbers, `symbolic` for other equal expressions, `different`, or None for a judge."""
    x, y = (None if t is None else read(t) for t in (a, b))
    if x is None or y is None:
        return None
    try:
        if x != y:
            return "different"
    except Unreadable:
        return None
    return "rational" if x.rational() is not None else "symbolic"
