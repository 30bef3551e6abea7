"""What can go wrong in a contract, from its text to its value."""

from __future__ import annotations


class DslError(Exception):
    """An error with a description and, where known, the line of the source."""

    def __init__(self, error: str, descr: str = "", line: int | None = None):
        self.error, self.descr, self.line = error, descr, line
        super().__init__(str(self))

    def __str__(self) -> str:
        where = f" (line {self.line})" if self.line else ""
        return self.error + (f": {self.descr}" if self.descr else "") + where


class DslSyntaxError(DslError):
    """The text is no contract."""


class DslNameError(DslError):
    """A name stands for nothing."""


class DslTestExpressionCannotBeEvaluated(DslError):
    """A condition holds something that is known only path by path."""


class DslIfTestExpressionError(DslError):
    """A condition has no truth value."""


class DslPresentTimeNotInScope(DslError):
    """A time-dependent element stands where no present time is set."""


class DslCompareArgsError(DslError):
    """Values of these types do not compare."""


class DslBinOpArgsError(DslError):
    """Values of these types do not combine."""


class DslSystemError(DslError):
    """A fault of the engine."""


class DslCompileError(DslError):
    """The contract does not unfold."""


class CallLimitError(DslCompileError):
    """The contract unfolds to more calls than allowed."""


class RecursionDepthError(DslCompileError):
    """A contract's inlined calls go too deep."""


class InterruptSignalReceived(Exception):
    """A signal stopped the valuation."""
