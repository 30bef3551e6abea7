"""Contract text to expressions: a small part of Python's syntax, read by its own parser."""

from __future__ import annotations

import ast
import importlib.util
from collections.abc import Callable, Mapping

from pathval.errors import DslSyntaxError
from pathval.plans.ir import ELEMENTS, Expr, Function, Module, const

BINARY = {ast.Add: "Add", ast.Sub: "Sub", ast.Mult: "Mult", ast.Div: "Div", ast.FloorDiv: "FloorDiv", ast.Mod: "Mod", ast.Pow: "Pow"}
ORDERS = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
#: Imports of these bring only what every contract has.
NATIVE = frozenset({"pathval", "pathval.elements"})


def find_source(module: str) -> str:
    """The text of a module on Python's path, without running it."""
    try:
        spec = importlib.util.find_spec(module)
    except (ImportError, ValueError):
        spec = None
    if spec is None:
        raise DslSyntaxError("no such module", module)
    if not spec.has_location or not (spec.origin or "").endswith(".py"):
        raise DslSyntaxError("a module without source text", module)
    try:
        with open(spec.origin, encoding="utf-8") as f:
            return f.read()
    except (OSError, UnicodeDecodeError) as e:
        raise DslSyntaxError("a module cannot be read", f"{module}: {e}") from None


class Parser:
    """Reads modules.  ``elements`` adds names with their least and greatest number of arguments."""

    def __init__(self, elements: Mapping[str, tuple[int, int | None]] | None = None, find: Callable[[str], str] = find_source):
        self.elements = ELEMENTS | dict(elements or {})
        self.find = find

    def parse(self, text: str) -> Module:
        if not isinstance(text, str):
            raise DslSyntaxError("contract source must be a string", type(text).__name__)
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError) as e:
            raise DslSyntaxError("invalid syntax", str(e), getattr(e, "lineno", None)) from None
        functions: dict[str, Function] = {}
        expressions: list[Expr] = []
        for node in tree.body:
            if isinstance(node, ast.FunctionDef):
                functions[node.name] = self._function(node)
            elif isinstance(node, ast.Expr):
                expressions.append(self._expr(node.value))
            elif isinstance(node, ast.ImportFrom):
                functions |= self._imported(node)
            else:
                self._refuse(node)
        for f in functions.values():
            if not f.names:
                f.names = functions
        return Module(functions, expressions)

    def _imported(self, node: ast.ImportFrom) -> dict[str, Function]:
        if node.module in NATIVE:
            return {}
        if node.level or not node.module:
            raise DslSyntaxError("relative imports are not supported", "", node.lineno)
        known = self.parse(self.find(node.module)).functions
        found = {}
        for alias in node.names:
            if alias.name == "*":
                found |= known
            elif alias.name not in known:
                raise DslSyntaxError("module defines no such function", f"{node.module}.{alias.name}", node.lineno)
            else:
                found[alias.asname or alias.name] = known[alias.name]
        return found

    def _refuse(self, node: ast.AST) -> None:
        raise DslSyntaxError("not supported in a contract", type(node).__name__, getattr(node, "lineno", None))

    def _function(self, node: ast.FunctionDef) -> Function:
        a = node.args
        if a.vararg or a.kwarg or a.kwonlyargs or a.defaults or a.posonlyargs:
            raise DslSyntaxError("functions take positional arguments only", node.name, node.lineno)
        marks = [d.id if isinstance(d, ast.Name) else "?" for d in node.decorator_list]
        if set(marks) - {"inline"}:
            raise DslSyntaxError("unknown decorator", ", ".join(marks), node.lineno)
        return Function(node.name, tuple(x.arg for x in a.args), self._body(node.body, node), "inline" in marks, node.lineno)

    def _body(self, statements: list[ast.stmt], of: ast.AST) -> Expr:
        if len(statements) != 1:
            raise DslSyntaxError("exactly one statement is expected", f"{len(statements)} found", of.lineno)
        s = statements[0]
        if isinstance(s, (ast.Return, ast.Expr)) and s.value is not None:
            return self._expr(s.value)
        if isinstance(s, ast.If):
            if not s.orelse:
                raise DslSyntaxError("if without else", "", s.lineno)
            return Expr("If", self._expr(s.test), self._body(s.body, s), self._body(s.orelse, s), line=s.lineno)
        self._refuse(s)

    def _expr(self, node: ast.expr) -> Expr:
        line = node.lineno
        if isinstance(node, ast.Constant):
            if isinstance(node.value, (int, float, str)) and not isinstance(node.value, bool):
                return const(node.value, line)
        elif isinstance(node, ast.Name):
            return Expr("Name", node.id, line=line)
        elif isinstance(node, ast.BinOp) and type(node.op) in BINARY:
            return Expr(BINARY[type(node.op)], self._expr(node.left), self._expr(node.right), line=line)
        elif isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return Expr("UnarySub", self._expr(node.operand), line=line)
        elif isinstance(node, ast.BoolOp):
            return Expr(type(node.op).__name__, *map(self._expr, node.values), line=line)
        elif isinstance(node, ast.Compare) and all(type(o) in ORDERS for o in node.ops):
            return Expr("Compare", self._expr(node.left), tuple(ORDERS[type(o)] for o in node.ops), *map(self._expr, node.comparators), line=line)
        elif isinstance(node, ast.IfExp):
            return Expr("If", self._expr(node.test), self._expr(node.body), self._expr(node.orelse), line=line)
        elif isinstance(node, ast.Call):
            return self._call(node)
        self._refuse(node)

    def _call(self, node: ast.Call) -> Expr:
        if not isinstance(node.func, ast.Name):
            self._refuse(node.func)
        name = node.func.id
        if node.keywords or any(isinstance(a, ast.Starred) for a in node.args):
            raise DslSyntaxError("calls take positional arguments only", name, node.lineno)
        args = [self._expr(a) for a in node.args]
        if name not in self.elements:
            return Expr("Call", Expr("Name", name, line=node.lineno), *args, line=node.lineno)
        least, most = self.elements[name]
        if len(args) < least or most is not None and len(args) > most:
            raise DslSyntaxError(f"{name} takes {least if least == most else f'{least} or more'} arguments", f"{len(args)} given", node.lineno)
        return Expr(name, *args, line=node.lineno)
