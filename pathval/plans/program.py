"""From a graph of calls to a schedule: order, levels of choices, prices needed, what bumps touch."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field

from pathval.errors import DslSyntaxError, DslSystemError
from pathval.functions.dates import perturbation_name
from pathval.plans.ir import FIXINGS, Expr
from pathval.plans.unfold import Node

#: Market, fixing date, delivery date.
PriceKey = tuple[str, dt.date, dt.date]


@dataclass
class Choosing:
    """One choice: its alternatives at a present time, and the choices below it."""

    number: int
    expr: Expr
    present: dt.date
    level: int
    bumps: frozenset[str]
    #: Choices and prices that its alternatives read, not through other choices.
    reads: frozenset[int] = frozenset()
    prices: frozenset[PriceKey] = frozenset()


@dataclass
class Program:
    nodes: dict[int, Node]
    order: list[int]
    levels: dict[int, int]
    markets: list[str]
    bumps: dict[int, frozenset[str]]
    choices: list[Choosing]
    #: The choice that an expression at a present time is.
    place: dict[tuple[Expr, dt.date], int]
    prices: frozenset[PriceKey]
    observation: dt.date | None
    periodisation: str | None
    final_reads: frozenset[int] = field(default_factory=frozenset)
    final_prices: frozenset[PriceKey] = field(default_factory=frozenset)

    @property
    def count(self) -> int:
        return len(self.nodes)

    def evaluations(self, double_sided: bool = True) -> int:
        """Nodes, once plain and once or twice for each bump that touches them."""
        return sum(1 + (2 if double_sided else 1) * len(self.bumps[n]) for n in self.nodes)

    def costs(self) -> dict[int, int]:
        return {n: node.expr.cost() for n, node in self.nodes.items()}


def execution_order(needs: Mapping[int, tuple[int, ...]]) -> list[int]:
    """Nodes, each after those it needs; leaves first."""
    waiting = {n: set(d) for n, d in needs.items()}
    users: dict[int, list[int]] = {n: [] for n in needs}
    for n, d in needs.items():
        for x in d:
            users[x].append(n)
    ready = [n for n, d in waiting.items() if not d]
    out = []
    while ready:
        n = ready.pop(0)
        out.append(n)
        for user in users[n]:
            waiting[user].discard(n)
            if not waiting[user]:
                ready.append(user)
    if len(out) < len(needs):
        raise DslSystemError("calls need each other in a circle")
    return out


def market_name(e: Expr) -> str:
    name = e.args[-1]
    while isinstance(name, Expr):
        if name.op not in ("Const", "String"):
            raise DslSyntaxError("a market's name is a string", repr(e), e.line)
        name = name.args[0]
    if not isinstance(name, str) or "-" in name:
        raise DslSyntaxError("a market's name is a string without hyphen", repr(e), e.line)
    return name


def price_key(e: Expr, present: dt.date | None) -> PriceKey:
    """What a market element reads at a present time."""
    if present is None:
        raise DslSyntaxError("a market needs an observation date", repr(e), e.line)
    return market_name(e), present, e.args[0].value if e.op == "ForwardMarket" else present


def build(nodes: list[Node], observation: dt.date | None, periodisation: str | None = None) -> Program:
    by_number = {n.number: n for n in nodes}
    order = execution_order({n.number: n.needs for n in nodes})
    level, bumps = {}, {}
    markets = sorted({market_name(e) for n in nodes for e in n.expr.walk() if e.op in ("Market", "ForwardMarket")})
    prices: set[PriceKey] = set()
    choices: list[Choosing] = []
    place: dict[tuple[Expr, dt.date], int] = {}
    depth: dict[int, int] = {}  # choices below a node
    visible: dict[int, tuple[set[int], set[PriceKey]]] = {}

    def add_price(key: PriceKey) -> None:
        market, fixing, delivery = key
        prices.add(key)
        if fixing != delivery:
            prices.add((market, delivery, delivery))
        if periodisation == "alltime":
            prices.add((market, observation, observation))

    def survey(e: Expr, present: dt.date | None) -> tuple[int, set[int], set[PriceKey], frozenset[str]]:
        """Choices below and including ``e``; choices and prices that it reads first; bumps that touch it."""
        if e.op == "Stub":
            return depth[e.value], *visible[e.value], bumps[e.value]
        if e.op in ("Market", "ForwardMarket"):
            key = price_key(e, present)
            add_price(key)
            name = perturbation_name(key[0], key[2], periodisation)
            return 0, set(), {key}, frozenset([name] if name else [])
        inner = e.args[0].value if e.op in FIXINGS else present
        below, reads, keys, own = 0, set(), set(), frozenset()
        for c in e.children:
            d, r, k, b = survey(c, inner)
            below = max(below, d)
            reads |= r
            keys |= k
            own |= b
        if e.op != "Choice" or not markets:
            return below, reads, keys, own
        found = place.get((e, present))
        if found is None:
            for m in markets:
                prices.add((m, present, present))
                keys.add((m, present, present))
            found = place[e, present] = len(choices)
            choices.append(Choosing(found, e, present, below + 1, own, frozenset(reads), frozenset(keys)))
        return choices[found].level, {found}, set(), own

    for n in order:
        node = by_number[n]
        level[n] = 1 + max((level[d] for d in node.needs), default=-1)
        depth[n], reads, keys, bumps[n] = survey(node.expr, node.present)
        visible[n] = (reads, keys)
    reads, keys = visible[0]
    return Program(by_number, order, level, markets, bumps, choices, place, frozenset(prices), observation, periodisation, frozenset(reads), frozenset(keys))


def required_prices(program: Program) -> list[PriceKey]:
    """Price keys to simulate, in a fixed order."""
    return sorted(program.prices)
