"""Values of expressions over paths: one walk of the tree for arrays and for columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import Any

import numpy as np
from dateutil.relativedelta import relativedelta

from pathval.errors import DslSyntaxError, DslSystemError
from pathval.functions import arith
from pathval.functions.dates import discount_factor, perturbation_name
from pathval.plans import scalar
from pathval.plans.ir import INFIX, Expr
from pathval.plans.program import Program, price_key

SCALARS = (int, float, bool, str, dt.date)


class Arrays:
    """Random variables as arrays of a block of paths."""

    @staticmethod
    def binary(op: str, a: Any, b: Any) -> Any:
        with np.errstate(all="ignore"):
            return scalar.OPERATIONS[op](np.float64(a) if isinstance(a, (int, float)) else a, np.float64(b) if isinstance(b, (int, float)) else b)

    @staticmethod
    def negative(a: Any) -> Any:
        return -a

    @staticmethod
    def extreme(op: str, a: Any, b: Any) -> Any:
        return np.minimum(a, b) if op == "Min" else np.maximum(a, b)


class Columns:
    """Random variables as columns, a row a path."""

    @staticmethod
    def _column(x: Any) -> Any:
        from pyspark.sql import functions as F

        return F.lit(float(x)) if isinstance(x, (int, float)) else x

    @classmethod
    def binary(cls, op: str, a: Any, b: Any) -> Any:
        from pyspark.sql import functions as F

        a, b = cls._column(a), cls._column(b)
        match op:
            case "Add":
                return a + b
            case "Sub":
                return a - b
            case "Mult":
                return a * b
            case "Div":
                return arith.divide(a, b)
            case "FloorDiv":
                return arith.floor_divide(a, b)
            case "Mod":
                return arith.floor_modulo(a, b)
            case "Pow":
                return F.pow(a, b)
        raise DslSystemError("unknown operation", op)

    @staticmethod
    def negative(a: Any) -> Any:
        return -a

    @classmethod
    def extreme(cls, op: str, a: Any, b: Any) -> Any:
        a, b = cls._column(a), cls._column(b)
        return arith.minimum(a, b) if op == "Min" else arith.maximum(a, b)


class Evaluator:
    """Values of a program's nodes, once for each bump that touches them.

    ``price`` gives a random variable for a price key, ``chosen`` one for a choice and bump that
    is decided already.  A bump scales the prices of its period up, with a leading - down.
    """

    def __init__(self, program: Program, algebra: type, price: Callable, chosen: Callable, rate: float, factor: float, custom: dict[str, Callable] | None = None):
        self.program, self.algebra, self.price, self.chosen = program, algebra, price, chosen
        self.rate, self.factor, self.custom = rate, factor, custom or {}
        self.known: dict[tuple[int, str], Any] = {}

    def node(self, number: int, bump: str = "") -> Any:
        if bump.lstrip("-") not in self.program.bumps[number]:
            bump = ""
        if (number, bump) not in self.known:
            node = self.program.nodes[number]
            self.known[number, bump] = self.value(node.expr, node.present, bump)
        return self.known[number, bump]

    def value(self, e: Expr, present: dt.date | None, bump: str = "") -> Any:
        op, a = e.op, e.args
        if op == "Const":
            return a[0]
        if op == "Stub":
            return self.node(a[0], bump)
        if op in INFIX:
            left, right = self.value(a[0], present, bump), self.value(a[1], present, bump)
            known = isinstance(left, SCALARS) and isinstance(right, SCALARS) or not (self._number(left) and self._number(right))
            return scalar.binary(op, left, right) if known else self.algebra.binary(op, left, right)
        if op == "UnarySub":
            x = self.value(a[0], present, bump)
            return scalar.negative(x) if isinstance(x, SCALARS) or not self._number(x) else self.algebra.negative(x)
        if op in ("Min", "Max"):
            left, right = self.value(a[0], present, bump), self.value(a[1], present, bump)
            known = isinstance(left, SCALARS) and isinstance(right, SCALARS) or not (self._number(left) and self._number(right))
            return scalar.extreme(op, left, right) if known else self.algebra.extreme(op, left, right)
        if op in ("Market", "ForwardMarket"):
            key = price_key(e, present)
            x = self.price(key)
            if bump and perturbation_name(key[0], key[2], self.program.periodisation) == bump.lstrip("-"):
                x = x * (1 - self.factor if bump.startswith("-") else 1 + self.factor)
            return x
        if op in ("Fixing", "On"):
            return self.value(a[1], a[0].value, bump)
        if op == "Wait":
            return self._discounted(self.value(a[1], a[0].value, bump), present, a[0].value)
        if op == "Settlement":
            return self._discounted(self.value(a[1], present, bump), present, a[0].value)
        if op == "Choice":
            number = self.program.place.get((e, present))
            if number is not None:
                return self.chosen(number, bump if bump.lstrip("-") in self.program.choices[number].bumps else "")
            values = [self.value(x, present, bump) for x in a]
            best = values[0]
            for x in values[1:]:  # without markets all is known, and the first of equals wins
                best = x if x > best else best
            return best
        if op in self.custom:
            return self.custom[op](*(self.value(x, present, bump) for x in e.children))
        return self._pure(e, present, bump)

    def _pure(self, e: Expr, present: dt.date | None, bump: str) -> Any:
        from pathval.plans.ir import Module, rebuilt
        from pathval.plans.unfold import Unfolder

        def settled(x: Expr) -> Expr:
            if x.op == "Stub":
                found = self.node(x.value, bump)
                if not isinstance(found, SCALARS):
                    raise DslSyntaxError("a value that differs by path cannot stand here", repr(e), e.line)
                return Expr("Const", found)
            return rebuilt(x, settled)

        return Unfolder(Module({}, []), self.program.observation).value(settled(e), present)

    def _discounted(self, value: Any, present: dt.date | None, day: dt.date) -> Any:
        if present is None:
            raise DslSyntaxError("discounting needs an observation date")
        factor = discount_factor(present, day, self.rate)
        return scalar.binary("Mult", value, factor) if isinstance(value, SCALARS) else value * factor

    @staticmethod
    def _number(x: Any) -> bool:
        return not isinstance(x, (str, dt.date, relativedelta))
