"""Arithmetic over numbers in text, as a calculator tool offers it."""

from __future__ import annotations

import operator
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TOKEN = re.compile(r" *(?:([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)|([-+*/()])) *")
_BINARY = {"+": (1, operator.add), "-": (1, operator.sub), "*": (2, operator.mul), "/": (2, operator.truediv)}
_UNARY = {"+": operator.pos, "-": operator.neg}


def _number(text: str) -> int | float:
    if "." in text:
        return float(text)
    if text[0] == "0" and text.strip("0"):
        raise ValueError("a whole number does not begin with 0")
    return int(text)


def _value(text: str) -> int | float:
    """Operands and waiting operators on two stacks: as long and as deep as the text is."""
    values: list = []
    waiting: list[tuple] = []  # (precedence, operator, operands); brackets as precedence 0
    operand_next, at = True, 0

    def settle(least: int) -> None:
        while waiting and waiting[-1][0] >= least:
            _, function, operands = waiting.pop()
            taken = values[-operands:]
            del values[-operands:]
            values.append(function(*taken))

    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError("not arithmetic")
        at, (number, sign) = found.end(), found.groups()
        if operand_next:
            if number:
                values.append(_number(number))
                operand_next = False
            elif sign == "(":
                waiting.append((0, None, 0))
            elif sign in _UNARY:
                waiting.append((3, _UNARY[sign], 1))
            else:
                raise ValueError("a number is missing")
        elif number or sign == "(":
            raise ValueError("an operator is missing")
        elif sign == ")":
            settle(1)
            if not waiting:
                raise ValueError("a bracket is missing")
            waiting.pop()
        else:
            precedence, function = _BINARY[sign]
            settle(precedence)
            waiting.append((precedence, function, 2))
            operand_next = True
    if operand_next:
        raise ValueError("unfinished")
    settle(1)
    if waiting:
        raise ValueError("a bracket is open")
    return values[0]


def calculate(text: str | None) -> float | None:
    """The value of numbers, + - * / and brackets, rounded to two places; None for anything else. Texts may be of any length."""
    if not text:
        return None
    try:
        return round(float(_value(text.strip(" "))), 2)
    except (ValueError, ZeroDivisionError, OverflowError):
        return None


@F.pandas_udf(DoubleType())
def calculated(texts: pd.Series) -> pd.Series:
    """Column form of ``calculate``."""
    return texts.map(calculate, na_action="ignore").astype("float64")
