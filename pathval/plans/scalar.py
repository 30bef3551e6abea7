"""Values that are the same on every path: Python numbers, strings, days and spans."""

from __future__ import annotations

import datetime as dt
import operator
from collections.abc import Callable

from dateutil.relativedelta import relativedelta

from pathval.errors import DslBinOpArgsError, DslCompareArgsError

OPERATIONS: dict[str, Callable] = {
    "Add": operator.add,
    "Sub": operator.sub,
    "Mult": operator.mul,
    "Div": operator.truediv,
    "FloorDiv": operator.floordiv,
    "Mod": operator.mod,
    "Pow": operator.pow,
}
ORDERS: dict[str, Callable] = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def binary(op: str, a: object, b: object) -> object:
    """A sum, product and so on; of two days the difference is a span."""
    if isinstance(a, dt.date) and isinstance(b, dt.date) and op == "Sub":
        return relativedelta(a, b)
    if isinstance(a, str) or isinstance(b, str):
        raise DslBinOpArgsError("strings do not combine", f"{a!r} {op} {b!r}")
    try:
        return OPERATIONS[op](a, b)
    except TypeError as e:
        raise DslBinOpArgsError("unable to combine", f"{a!r} {op} {b!r}: {e}") from None


def negative(a: object) -> object:
    try:
        return -a
    except TypeError as e:
        raise DslBinOpArgsError("unable to negate", f"{a!r}: {e}") from None


def compare(op: str, a: object, b: object) -> bool:
    """An order of two numbers, days, spans of time or strings."""
    for kind in ((int, float), (dt.date,), (dt.timedelta,), (str,)):
        if isinstance(a, kind) and isinstance(b, kind) and not isinstance(a, bool) and not isinstance(b, bool):
            return ORDERS[op](a, b)
    raise DslCompareArgsError("unable to compare", f"{a!r} {op} {b!r}")


def extreme(op: str, a: object, b: object) -> object:
    try:
        return min(a, b) if op == "Min" else max(a, b)
    except TypeError as e:
        raise DslBinOpArgsError(f"unable to take {op}", f"{a!r}, {b!r}: {e}") from None
