"""Contract expressions: immutable trees that compare by structure, and function definitions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from dateutil.relativedelta import relativedelta

#: Infix operators by element name, with how tightly they bind.
INFIX = {"Add": ("+", 1), "Sub": ("-", 1), "Mult": ("*", 2), "Div": ("/", 2), "FloorDiv": ("//", 2), "Mod": ("%", 2), "Pow": ("**", 4)}
#: Least and greatest number of arguments of each element that is called by name.
ELEMENTS: dict[str, tuple[int, int | None]] = {
    **{name: (2, 2) for name in INFIX},
    "UnarySub": (1, 1),
    "Min": (2, 2),
    "Max": (2, 2),
    "And": (2, None),
    "Or": (2, None),
    "Number": (1, 1),
    "String": (1, 1),
    "Date": (1, 1),
    "TimeDelta": (1, 1),
    "Stub": (1, 1),
    "Settlement": (2, 2),
    "Fixing": (2, 2),
    "On": (2, 2),
    "Wait": (2, 2),
    "Choice": (2, None),
    "Market": (1, 1),
    "ForwardMarket": (2, 2),
    "ObservationDate": (0, 0),
    "PresentTime": (0, 0),
    "IsDayOfMonth": (1, 1),
}
#: Elements whose value is known only path by path, and those that set the present time.
STOCHASTIC = frozenset({"Market", "ForwardMarket", "Choice", "Settlement"})
FIXINGS = frozenset({"Fixing", "On", "Wait"})
#: What evaluating an element costs, in units of the cheapest.
COSTS = {**{name: 10 for name in (*INFIX, "Compare", "Settlement", "Wait")}, "Choice": 300, "Fixing": 0, "On": 0, "Name": 0, "Market": 0, "ForwardMarket": 0}


class Expr:
    """An element and its arguments: expressions, functions, or plain values of a constant."""

    __slots__ = ("op", "args", "line", "_hash")

    def __init__(self, op: str, *args: object, line: int | None = None):
        self.op, self.args, self.line = op, args, line
        self._hash = None

    def __eq__(self, other: object) -> bool:
        return self is other or isinstance(other, Expr) and hash(self) == hash(other) and self.op == other.op and self.args == other.args

    def __hash__(self) -> int:
        if self._hash is None:
            self._hash = hash((self.op, self.args))
        return self._hash

    def __reduce__(self) -> tuple:
        return _restored, (self.op, self.args, self.line)  # hashes differ between processes

    def __repr__(self) -> str:
        return source(self)

    @property
    def children(self) -> tuple[Expr, ...]:
        return tuple(a for a in self.args if isinstance(a, Expr))

    @property
    def value(self) -> object:
        return self.args[0]

    def walk(self) -> Iterator[Expr]:
        left = [self]
        while left:
            e = left.pop()
            yield e
            left += reversed(e.children)

    def cost(self) -> int:
        return sum(COSTS.get(e.op, 1) for e in self.walk())


def _restored(op: str, args: tuple, line: int | None) -> Expr:
    return Expr(op, *args, line=line)


def const(value: object, line: int | None = None) -> Expr:
    return Expr("Const", value, line=line)


def rebuilt(e: Expr, change: Callable[[Expr], Expr]) -> Expr:
    """``e`` with its children changed; itself if none is."""
    args = tuple(change(a) if isinstance(a, Expr) else a for a in e.args)
    if all(a is b for a, b in zip(args, e.args, strict=True)):
        return e
    return Expr(e.op, *args, line=e.line)


@dataclass(eq=False)
class Function:
    """A definition; two are equal only if they are the same."""

    name: str
    params: tuple[str, ...]
    body: Expr
    inline: bool = False
    line: int | None = None
    #: The names that its body sees, those of its module.
    names: dict[str, Function] = field(default_factory=dict, repr=False)

    @property
    def simple(self) -> bool:
        """Whether its body calls nothing and holds nothing that differs by path."""
        return not any(e.op == "Call" or e.op in STOCHASTIC or e.op in FIXINGS for e in self.body.walk())


@dataclass
class Module:
    functions: dict[str, Function]
    expressions: list[Expr]


def source(e: object, level: int = 0) -> str:
    """The text that parses to ``e``."""
    if isinstance(e, Function):
        mark = "@inline\n" if e.inline else ""
        return f"{mark}def {e.name}({', '.join(e.params)}):\n" + _statement(e.body, "    ")
    if not isinstance(e, Expr):
        return repr(e)
    a = e.args
    if e.op in INFIX:
        sign, own = INFIX[e.op]
        left, right = source(a[0], own + (e.op == "Pow")), source(a[1], own + (e.op != "Pow"))
        text = f"{left} {sign} {right}"
        return f"({text})" if own < level else text
    if e.op == "UnarySub":
        text = f"-{source(a[0], 3)}"
        return f"({text})" if level > 3 else text
    if e.op in ("And", "Or"):
        text = f" {e.op.lower()} ".join(source(x, 1) for x in a)
        return f"({text})" if level else text
    if e.op == "Compare":
        text = source(a[0], 1) + "".join(f" {op} {source(x, 1)}" for op, x in zip(a[1], a[2:], strict=True))
        return f"({text})" if level else text
    if e.op == "If":
        text = f"{source(a[1], 1)} if {source(a[0], 1)} else {source(a[2])}"
        return f"({text})" if level else text
    if e.op == "Name":
        return a[0]
    if e.op == "Const":
        if isinstance(a[0], relativedelta):
            parts = [f"TimeDelta('{n}{u}')" for n, u in ((a[0].years, "y"), (a[0].months, "m"), (a[0].days, "d")) if n]
            return " + ".join(parts) if len(parts) < 2 or level < 2 else f"({' + '.join(parts)})"
        if isinstance(a[0], dt.date):
            return f"Date('{a[0].isoformat()}')"
        return repr(a[0])
    if e.op == "Call":
        name = a[0].name if isinstance(a[0], Function) else source(a[0])
        return f"{name}({', '.join(source(x) if isinstance(x, Expr) else x.name for x in a[1:])})"
    return f"{e.op}({', '.join(source(x) for x in a)})"


def _statement(e: Expr, indent: str) -> str:
    if e.op != "If":
        return f"{indent}return {source(e)}"
    test, yes, no = e.args
    return f"{indent}if {source(test)}:\n{_statement(yes, indent + '    ')}\n{indent}else:\n{_statement(no, indent + '    ')}"
