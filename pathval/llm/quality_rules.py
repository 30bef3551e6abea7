"""Quality rules by repetition coverage.

Each text is cut into words; rolling hashes over the words' hashes give every n-gram of
several lengths at once in numpy.  Characters inside n-grams and lines that repeat an
earlier one of the same text are measured against all its word characters.
Most positions drop out at the shortest length, since an n-gram can only be repeated where
both its (n-1)-grams are; longer lengths look at the rest alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathval.llm.common import BLANKS, give_back, raw, utf8

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Most characters, in percent of a text's word characters, that a kept text may have.

    ``top``: inside the later copies of its weightiest n-gram.  ``repeated``: inside later
    copies of any n-gram, each character once.  ``line_chars``: inside lines equal to an
    earlier line.  ``lines``: such lines, in percent of its lines with a word.
    """

    top: dict[int, int] = field(default_factory=lambda: {2: 20, 3: 18, 4: 16})
    repeated: dict[int, int] = field(default_factory=lambda: {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10})
    lines: int = 30
    line_chars: int = 20
    min_words: int = 50
    max_repeat_words: int = 50


_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * len(_powers), 1 << 12)
        base = int(_STEP)
        back = pow(base, -1, 1 << 64)
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))])
        _inverses = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, back, np.uint64))])


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the code points of each word, from one polynomial prefix sum."""
    data = np.frombuffer(raw, dtype=np.uint8)
    blank = BLANKS[data]
    edge = np.flatnonzero(np.diff(blank))
    at = edge + 1
    if len(data) and not blank[0]:
        at = np.concatenate([[0], at])
    if len(at) % 2:
        at = np.concatenate([at, [len(data)]])
    starts, ends = at[0::2], at[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    _grow(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * _inverses[starts]
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    heads = np.empty(len(data) + 1, np.int64)
    heads[0] = 0
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    return h, heads[ends] - heads[starts]


def _copies(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value how many equal it, itself included, and whether it is a later copy."""
    order = np.argsort(values, kind="stable")
    new = np.ones(len(values), dtype=bool)
    ranked = values[order]
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    group = np.empty(len(values), np.int64)
    group[order] = np.cumsum(new) - 1
    later = np.ones(len(values), dtype=bool)
    later[order[new]] = False
    return np.bincount(group)[group], later


def _covered(places: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in an n-gram that begins at one of the places."""
    depth = np.zeros(words + 1, np.int64)
    np.add.at(depth, places, 1)
    np.add.at(depth, places + n, -1)
    return np.cumsum(depth)[:words] > 0


def measure(text: str | bytes | None, limits: Limits = Limits()) -> dict[str, int | bool]:
    """All measures of one text or its UTF-8 bytes.  Null counts as empty; a text without words has zeros."""
    data = text if isinstance(text, bytes) else utf8(text)
    h, chars = word_hashes(data)
    words, total = len(h), int(chars.sum())
    out = {"n_words": words, "word_chars": total, "n_symbols": sum(data.count(x) for x in SYMBOLS), "n_dup_lines": 0, "n_repeat_words": 0, "base_failed": True, "kept": False}
    seen: set[bytes] = set()
    lines = dup_lines = dup_line_chars = 0
    if b"\n" in data:
        for line in data.split(b"\n"):
            if parts := line.split():
                lines += 1
                if line in seen:
                    dup_lines += 1
                    dup_line_chars += sum(len(p.decode("utf-8", "surrogatepass")) for p in parts)
                seen.add(line)
    else:
        lines = int(words > 0)
    out |= {"n_lines": lines, "n_dup_lines": dup_lines, "dup_line_chars": dup_line_chars}
    ends = np.concatenate([[0], np.cumsum(chars)])
    gram, places = h, np.arange(words)
    longest = max([3, *limits.top, *limits.repeated])
    for n in range(2, longest + 1):
        m = words - n + 1
        if m >= 2 and len(places) >= 2:
            gram = gram[:m] * _STEP + h[n - 1 :]
            if n > 2:  # both (n-1)-grams must be repeated
                held = np.zeros(words + 1, dtype=bool)
                held[places] = True
                places = places[(places < m) & held[places + 1]]
            else:
                places = np.arange(m)
            copies, later = _copies(gram[places]) if len(places) else (places, places.astype(bool))
            heavy = int(((copies - 1) * (ends[places + n] - ends[places])).max(initial=0))
            inside = _covered(places[later], n, words)
            places = places[copies > 1]
        else:
            places, heavy, inside = places[:0], 0, np.zeros(words, bool)
        if n in limits.top:
            out[f"top_{n}_chars"] = heavy
        if n in limits.repeated:
            out[f"repeated_{n}_chars"] = int(chars[inside].sum())
        if n == 3:
            out["n_repeat_words"] = int(_covered(places, n, words).sum())
    out["base_failed"] = words < limits.min_words or 100 * out["n_repeat_words"] > limits.max_repeat_words * words
    over = (
        any(100 * out[f"top_{n}_chars"] > most * total for n, most in limits.top.items())
        or any(100 * out[f"repeated_{n}_chars"] > most * total for n, most in limits.repeated.items())
        or 100 * dup_lines > limits.lines * lines
        or 100 * dup_line_chars > limits.line_chars * total
    )
    out["kept"] = not (out["base_failed"] or over)
    return out


def repetition(text: Column, limits: Limits = Limits()) -> Column:
    """A struct of the measures of ``text`` and the verdicts ``base_failed`` and ``kept``.

    Null and empty texts have no words, fail the base rule and are not kept.  Repeated rows
    are measured alike, each by itself; no other column is looked at.
    """
    names = list(measure("", limits))
    kind = T.StructType([T.StructField(x, T.BooleanType() if x in ("base_failed", "kept") else T.LongType(), False) for x in names])

    @F.arrow_udf(kind)
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [tuple(measure(raw(t), limits).values()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.bool_() if x in ("base_failed", "kept") else pa.int64()) for k, x in enumerate(names)], names=names)
        give_back()

    return measured(text)
