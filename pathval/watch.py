"""Watching a valuation: progress and time left, an end by timeout or by a signal."""

from __future__ import annotations

import signal
import threading
import time
import uuid
from collections.abc import Callable
from types import TracebackType

from pathval.errors import InterruptSignalReceived

#: Seconds that a valuation runs before its time left is believed, and the least time left that ends it early.
SURE, SHORT = 15.0, 2.0


class Watch:
    """Tags the jobs started inside it; interrupts them at the timeout or when SIGINT or SIGTERM comes.

    ``step`` is told the share of the work that is done.  It prints progress if ``verbose``, and
    gives up early when the time left, by the rate so far, goes beyond the timeout.
    """

    def __init__(self, spark: Callable[[], object], timeout: float | None = None, verbose: bool = False, clock: Callable[[], float] = time.monotonic):
        self.spark, self.timeout, self.verbose, self.clock = spark, timeout, verbose, clock
        self.tag = f"pathval-{uuid.uuid4().hex}"
        self.began, self.why, self.evaluating = clock(), None, None
        self._timer: threading.Timer | None = None
        self._before: dict[int, object] = {}

    def __enter__(self) -> Watch:
        if threading.current_thread() is threading.main_thread():  # others may not set handlers
            for s in (signal.SIGINT, signal.SIGTERM):
                self._before[s] = signal.signal(s, self._signalled)
        if self.timeout is not None:
            self._timer = threading.Timer(max(0.0, self.timeout - (self.clock() - self.began)), self.stop, [TimeoutError(f"timed out after {self.timeout} s")])
            self._timer.daemon = True
            self._timer.start()
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: TracebackType | None) -> None:
        if self._timer is not None:
            self._timer.cancel()
        for s, handler in self._before.items():
            signal.signal(s, handler)
        if self.evaluating is not None:
            self.spark().removeTag(self.tag)
        if self.why is not None:
            raise self.why from None

    def _signalled(self, number: int, frame: object) -> None:
        self.stop(InterruptSignalReceived(f"stopped by {signal.Signals(number).name}"))
        raise self.why

    def stop(self, why: Exception) -> None:
        """Ends the jobs; leaving the watch raises ``why``."""
        self.why = self.why or why
        if self.evaluating is not None:
            self.spark().interruptTag(self.tag)

    def start(self) -> None:
        """Jobs are about to run."""
        if self.why is not None:
            raise self.why
        self.evaluating = self.clock()
        self.spark().addTag(self.tag)

    def step(self, done: float, whole: float) -> None:
        """So much of the whole work is done."""
        if self.why is not None:
            raise self.why
        now = self.clock()
        took = now - self.evaluating
        left = took * (whole - done) / done if done else 0.0
        if self.verbose:
            until = "" if self.timeout is None else f", timeout in {self.timeout - (now - self.began):.0f} s"
            print(f"{done:.0f}/{whole:.0f} evaluations, {100 * done / whole:.0f} %, {done / max(took, 1e-9):.1f} a second, {left:.0f} s left{until}", flush=True)
        if self.timeout is not None and self.timeout < now - self.began + left and took > SURE and left > SHORT:
            self.stop(TimeoutError(f"{left:.0f} s left after {now - self.began:.0f} s, over the timeout of {self.timeout:.0f} s"))
            raise self.why
