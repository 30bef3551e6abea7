"""Byte-level BPE as a lazily determinised finite-state transducer.

A sequence of tokens is the encoding of its bytes exactly if each token encodes to itself
and no merge of a neighbouring pair would have come first, that is if every neighbouring
pair, encoded by itself, gives the pair back.  So a nondeterministic transducer may guess the
next token, spell it byte by byte along a trie, and check it against the one before.  Each
prefix of a text has one encoding, so a determinised state is the list of tokens being spelt,
each with the tokens read since all of them agreed.  What all agree on is emitted; an entry
lives as long as some token continues it, so the lookahead is at most the longest token.
States and transitions are made when met a second time and forgotten when they pass a bound,
within a piece too; until then a piece goes on from the last state's entries without a state of its own.

Decoding joins the tokens' bytes and feeds them to an incremental UTF-8 automaton, so that a
character split over tokens, or over calls, comes out whole.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections import ChainMap
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Transducer:
    """Encodes byte strings by ``ranks`` (token bytes to rank, all single bytes among them)."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 150_000):
        self.ranks, self.most_states = ranks, most_states
        self.bytes_of = {r: b for b, r in ranks.items()}
        self._pairs: dict[int, bool] = {}
        self._own: dict[int, bool] = {}
        self._halves: dict[bytes, list[int]] = {}
        self._right_ends: dict[int, list[tuple[bytes, float]]] = {}
        self._left_ends: dict[int, list[tuple[bytes, float]]] = {}
        self._proper = True  # every token ranks after its parts, as in trained vocabularies
        self._trie: list[dict[int, int]] = [{}]
        self._token: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                nxt = self._trie[node].get(b)
                if nxt is None:
                    nxt = self._trie[node][b] = len(self._trie)
                    self._trie.append({})
                    self._token.append(-1)
                node = nxt
            self._token[node] = rank
        self._forget()

    def _forget(self) -> None:
        # a state: entries (trie node, token before the committed ones or -1, tokens not yet emitted)
        self._states: list[tuple] = [((0, -1, ()),)]
        self._number: dict[tuple, int] = {self._states[0]: 0}
        self._moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self._ends: list[tuple[int, ...]] = [()]
        self._met: set[int] = set()  # transitions asked for once

    def _restart(self, state: int) -> int:
        """Forgets all states but one, and its new number."""
        entries = self._states[state]
        self._forget()
        if entries not in self._number:
            self._number[entries] = len(self._states)
            self._states.append(entries)
            self._moves.append({})
            self._ends.append(entries[-1][2])
        return self._number[entries]

    def merged(self, piece: bytes, left: int = 1) -> list[int]:
        """The definition: merge the neighbouring pair of lowest rank, leftmost first, till none
        or only ``left`` parts are left."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > left:
            rank, k = min((self.ranks.get(a + b, 1 << 62), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 62:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def _spine(self, token: int, right: bool) -> list[tuple[bytes, float]]:
        """What stands at the right (or left) end of a token while it is put together, each
        with the rank of the merge that takes it up; the token itself is never taken up."""
        spine, part, until = [], self.bytes_of[token], float("inf")
        while True:
            spine.append((part, until))
            if len(part) == 1:
                return spine
            halves = self._halves.get(part)
            if halves is None:
                halves = self._halves[part] = self.merged(part, 2)
            until = self.ranks[part]
            part = self.bytes_of[halves[right]]
            if self.ranks[part] >= until and len(part) > 1:
                self._proper = False

    def _stands(self, token: int) -> bool:
        """Whether a token encodes to itself."""
        own = self._own.get(token)
        if own is None:
            own = self._own[token] = self.merged(self.bytes_of[token]) == [token]
        return own

    def _fits(self, before: int, token: int) -> bool:
        """Whether ``token`` may follow ``before``: no merge over their border would come first.

        A border pair of rank m is merged if both its sides stand at m, the left one not taken
        up by then, the right one not before (of equal ranks the leftmost merge is first).
        """
        left, right = self._right_ends.get(before), self._left_ends.get(token)
        if left is None:
            left = self._right_ends[before] = self._spine(before, True)
        if right is None:
            right = self._left_ends[token] = self._spine(token, False)
        if not self._proper:
            return self.merged(self.bytes_of[before] + self.bytes_of[token]) == [before, token]
        rank = self.ranks.get
        for x, p in left:
            for y, q in right:
                m = rank(x + y)
                if m is not None and m < p and m <= q:
                    return False
        return True

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        trie, token_of, known = self._trie, self._token, self._pairs
        entries, done, agree = [], None, True
        for node, before, pending in self._states[state]:
            nxt = trie[node].get(byte)
            if nxt is None:
                continue
            if trie[nxt]:
                entries.append((nxt, before, pending))
                agree = agree and len(pending) > 0
            token = token_of[nxt]
            if token >= 0 and done is None:
                last = pending[-1] if pending else before
                key = (last + 1) << 32 | token
                fits = known.get(key)
                if fits is None:
                    if len(known) > self.most_states:
                        known.clear()
                    fits = known[key] = self._stands(token) and (last < 0 or self._fits(last, token))
                if fits:
                    done = (0, before, (*pending, token))
        if done is None:
            raise ValueError("no encoding: the ranks lack a byte or are no merges")
        emitted: tuple[int, ...] = ()
        if not entries:
            emitted, entries = done[2], [(0, done[2][-1], ())]
        else:
            entries.append(done)
            if agree:
                shared, first = 0, done[2]
                while all(len(p) > shared and p[shared] == first[shared] for _, _, p in entries) and shared < len(first):
                    shared += 1
                if shared:
                    emitted = first[:shared]
                    entries = [(n, emitted[-1], p[shared:]) for n, _, p in entries]
        key = tuple(entries)
        number = self._number.get(key)
        if number is None:
            number = self._number[key] = len(self._states)
            self._states.append(key)
            self._moves.append({})
            self._ends.append(key[-1][2])  # the entry at the trie's root is the last
        move = self._moves[state][byte] = (number, emitted)
        return move

    def _onward(self, state: int, rest: bytes) -> list[int]:
        """Tokens from a state to the end of a piece, by its entries alone; a path is (path before, token)."""
        trie, token_of, known = self._trie, self._token, self._pairs
        live = []
        for node, before, pending in self._states[state]:
            path = None
            for token in pending:
                path = (path, token)
            live.append((trie[node], pending[-1] if pending else before, path))
        root = trie[0]
        for byte in rest:
            entries, done = [], None
            for below, last, path in live:
                if byte in below:
                    nxt = below[byte]
                    token = token_of[nxt]
                    if token >= 0 and done is None:
                        key = (last + 1) << 32 | token
                        if key in known:
                            fits = known[key]
                        else:
                            if len(known) > self.most_states:
                                known.clear()
                            fits = known[key] = self._stands(token) and (last < 0 or self._fits(last, token))
                        if fits:
                            done = (root, token, (path, token))
                    below = trie[nxt]
                    if below:
                        entries.append((below, last, path))
            if done is None:
                raise ValueError("no encoding: the ranks lack a byte or are no merges")
            entries.append(done)
            live = entries
        out, path = [], live[-1][2]
        while path is not None:
            path, token = path
            out.append(token)
        out.reverse()
        return out

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Tokens of one piece, a whole token of the vocabulary as itself."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self._states) > self.most_states or len(self._met) > 8 * self.most_states:
            self._forget()
        out: list[int] = []
        state, moves = 0, self._moves
        for k, byte in enumerate(piece):
            move = moves[state].get(byte)
            if move is None:
                key = state << 8 | byte
                # either way gives the same tokens; states keep the memory of a long piece bounded
                if key not in self._met and len(piece) < 256:
                    self._met.add(key)
                    out += self._onward(state, piece[k:])
                    return tuple(out)
                if len(self._states) > self.most_states:
                    state, moves = self._restart(state), self._moves
                move = self._move(state, byte)
            state, emitted = move
            if emitted:
                out.extend(emitted)
        out.extend(self._ends[state])
        return tuple(out)


class Utf8:
    """Incremental UTF-8 decoding by state: how many bytes a character still lacks, and the
    range the next one may lie in.  A malformed sequence gives one U+FFFD and starts anew."""

    def __init__(self) -> None:
        self.lacks, self.low, self.high, self.held = 0, 0x80, 0xBF, b""

    def feed(self, data: bytes) -> str:
        """Characters completed by ``data``; an unfinished one is held for the next call."""
        if not self.lacks:
            try:  # nothing held and nothing cut: the usual case
                return data.decode()
            except UnicodeDecodeError:
                pass
        out: list[str] = []
        for b in data:
            if self.lacks:
                if self.low <= b <= self.high:
                    self.held += bytes([b])
                    self.lacks, self.low, self.high = self.lacks - 1, 0x80, 0xBF
                    if not self.lacks:
                        out.append(self.held.decode())
                    continue
                out.append("�")
                self.lacks, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.held = bytes([b])
                self.lacks = 1 + (b >= 0xE0) + (b >= 0xF0)
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def finish(self) -> str:
        """What an unfinished character at the end gives."""
        left = "�" if self.lacks else ""
        self.__init__()
        return left


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: a line for each token, base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Texts to ids and back.  ``pattern`` cuts a text; each match is encoded by itself.

    Encodings of met pieces are kept up to ``most_pieces``, then forgotten, so memory is
    bounded whatever the texts hold.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_pieces: int = 600_000):
        self.fst, self.cut, self.most_pieces = Transducer(ranks), regex.compile(pattern), most_pieces
        self._pieces: dict[str, tuple[int, ...]] = {}
        size = max(ranks.values()) + 1
        self._bytes = [self.fst.bytes_of.get(k, b"") for k in range(size)]
        self.decimal = [str(k) for k in range(size)]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null or empty."""
        known = self._pieces
        if len(known) > self.most_pieces:
            known.clear()
        matches, long = self.cut.findall(text or ""), {}
        for m in set(matches):
            if m not in known:
                (known if len(m) < 64 else long)[m] = self.fst.encode(m.encode("utf-8", "surrogatepass"))
        if long:
            known = ChainMap(long, known)
        return list(chain.from_iterable(map(known.__getitem__, matches)))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))

    def decode(self, ids: Iterable[int], block: int = 4096) -> Iterator[str]:
        """The text in parts, as the ids come in."""
        state, held = Utf8(), []
        for k in ids:
            held.append(k)
            if len(held) == block:
                yield state.feed(self.decode_bytes(held))
                held = []
        yield state.feed(self.decode_bytes(held)) + state.finish()


_codecs: dict[tuple[str, str], Codec] = {}


@contextmanager
def uncollected() -> Iterator[None]:
    """No search for reference cycles meanwhile: it would walk all states and pieces again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process and vocabulary, so that what it has met serves later tasks."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encode(text: Column, path: str, pattern: str) -> Column:
    """Array of ids of each whole text; null and empty give an empty array."""

    @F.pandas_udf("array<int>")
    def encoded(texts: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        with uncollected():
            return pd.Series([np.array(c.encode(t), np.int32) for t in texts])

    return encoded(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """Text of each array of ids; bytes that are no UTF-8 give U+FFFD; null gives an empty text."""

    @F.pandas_udf("string")
    def decoded(rows: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        return pd.Series(["".join(c.decode(() if r is None else r)) for r in rows])

    return decoded(ids)


def digest(c: Codec, text: str | None) -> tuple[int, str, str]:
    """Number of ids, digest of the ids in decimal, digest of the text they decode to."""
    ids = c.encode(text)
    said = " ".join(map(c.decimal.__getitem__, ids)).encode()
    back = hashlib.sha256()
    for part in c.decode(ids):
        back.update(part.encode())
    return len(ids), hashlib.sha256(said).hexdigest(), back.hexdigest()


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Each row of ``docs`` (doc_id, text): number of ids, digest of the ids, digest of what they decode to.

    Ids stay in the worker that makes them; only digests go back.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        c = codec(path, pattern)
        with uncollected():
            rows = [digest(c, t) for t in texts]
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digests("text").alias("d")).select("doc_id", "d.*")


def production(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The 50k byte-level vocabulary over all of ``docs``."""
    import public_tokenizers

    return round_trip(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
