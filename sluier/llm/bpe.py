"""Byte-level BPE encoding and decoding.

The rank table is compiled into a subsequential transducer over bytes that is determinised lazily, move by
move, as texts ask for it. A state is a set of open readings (place in the token trie, last token, tokens
not yet written); the common beginning of what the readings still owe is written at once, so a token
leaves after a lookahead no longer than the longest token. Two tokens may stand side by side exactly
if BPE on their joined bytes gives these two back, and a BPE result is the one sequence all of whose
neighbours may. The new pieces of a batch run through the transducer in step, one byte of each at a time, on
arrays; a piece longer than STEPS bytes follows the readings by itself. Decoding joins token bytes and runs an
incremental UTF-8 state machine.

Defined cases: null text counts as empty; an empty text has no tokens; ties between equal ranks go
to the left; a piece that is itself in the table is one token; no special tokens. round_trip() replaces columns
named ids or decoded; other columns, repeated rows and their order in a partition stay.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluier.llm import workers

#: Chunks whose ids a worker remembers, and transducer moves and neighbour tests that it keeps; beyond, they are made anew.
#: Some 60 MB for chunks, 90 MB for moves with their states, 40 MB for neighbours.
MAX_CHUNKS, MAX_MOVES, MAX_PAIRS = 250_000, 600_000, 400_000
#: Characters of texts whose ids a worker holds at once (one text at least).
SLICE = 1 << 20
#: Bytes of pieces that run in step at once, and of the longest of them.
RUN, STEPS = 1 << 18, 128


def read_ranks(path: str) -> dict[bytes, int]:
    """The table of a rank file: base64 of the token's bytes, a blank, its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + sizes[i] - 1, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Lists:
    """Lists of whole numbers, appended one by one or many at once and read many at once."""

    def __init__(self) -> None:
        self.n, self.used = 0, 0
        self.start, self.size, self.flat = np.zeros(1024, np.int32), np.zeros(1024, np.int32), np.zeros(4096, np.int32)

    def extend(self, sizes: np.ndarray, values: np.ndarray) -> None:
        n, used = self.n + len(sizes), self.used + len(values)
        while n > len(self.start):
            self.start, self.size = np.concatenate([self.start, np.zeros_like(self.start)]), np.concatenate([self.size, np.zeros_like(self.size)])
        while used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.size[self.n : n] = sizes
        self.start[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : used] = values
        self.n, self.used = n, used

    def add(self, lists: list[tuple[int, ...]]) -> None:
        self.extend(np.fromiter(map(len, lists), np.int32, len(lists)), np.fromiter((x for row in lists for x in row), np.int32))

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and values of the lists at these places."""
        sizes = self.size[places]
        return sizes, self.flat[_ranges(self.start[places].astype(np.int64), sizes)]


class Places:
    """Key -> place, both whole numbers: open addressing on arrays, read and filled many keys at once."""

    def __init__(self) -> None:
        self.n = 0
        self.keys, self.places = np.full(4096, -1, np.int64), np.zeros(4096, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys; -1 where a key is unknown."""
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.places[slot], -1)
        open_ = np.flatnonzero((seen != keys) & (seen != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.places[slot[open_[hit]]]
            open_ = open_[~hit & (seen != -1)]
        return out

    def put(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Different keys that are not yet known."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            known = self.keys != -1
            old = self.keys[known], self.places[known]
            size = len(self.keys)
            while 2 * (self.n + len(keys)) > size:
                size *= 2
            self.keys, self.places = np.full(size, -1, np.int64), np.zeros(size, np.int32)
            self._fill(*old)
        self._fill(keys, places)
        self.n += len(keys)

    def _fill(self, keys: np.ndarray, places: np.ndarray) -> None:
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]
            here = self.keys[slot] == keys
            self.places[slot[here]] = places[here]
            keys, places, slot = keys[~here], places[~here], (slot[~here] + 1) & (len(self.keys) - 1)


class Transducer:
    """BPE of pieces by a lazily determinised transducer."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._pairs: dict[int, bool] = {}
        # Trie: node << 8 | byte -> node; whether a node has children; the token that ends in a node.
        self._child: dict[int, int] = {}
        self._open, self._ends = bytearray(1), [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                below = self._child.get(key)
                if below is None:
                    below = self._child[key] = len(self._ends)
                    self._open[node] = 1
                    self._open.append(0)
                    self._ends.append(-1)
                node = below
            self._ends[node] = rank
        self._reached: dict[int, bool] = {}
        self._joins: dict[int, tuple | None] = {}
        self._borders: dict[tuple[int, int], list[tuple[bytes, int]]] = {}
        self.ordered = True
        self._forget()

    def _forget(self) -> None:
        self._states: dict[bytes, int] = {}
        self._readings: list[bytes] = []
        self._owed = Lists()
        self._moves = Places()
        self._target, self._written = np.zeros(4096, np.int32), Lists()
        self._pending: list[tuple[int, ...]] = []
        self._state(((0, -1, ()),))
        self._settle()

    def _state(self, readings) -> int:
        """The number of a state, held as packed whole numbers: node, last token, tokens owed of each reading."""
        flat: list[int] = []
        for node, last, owed in readings:
            flat += (node, last, len(owed), *owed)
        key = struct.pack(f"{len(flat)}i", *flat)
        found = self._states.get(key)
        if found is None:
            found = self._states[key] = len(self._readings)
            self._readings.append(key)
            self._pending.append(readings[-1][2])
        return found

    def _readings_of(self, state: int) -> list[tuple[int, int, tuple[int, ...]]]:
        key = self._readings[state]
        flat, out, i = struct.unpack(f"{len(key) // 4}i", key), [], 0
        while i < len(flat):
            out.append((flat[i], flat[i + 1], flat[i + 3 : i + 3 + flat[i + 2]]))
            i += 3 + flat[i + 2]
        return out

    def _settle(self) -> None:
        """What the new states owe if a piece ends in them, appended to the arrays."""
        self._owed.add(self._pending)
        self._pending.clear()

    def merge(self, piece: bytes) -> list[int]:
        """BPE by its definition: join the neighbours of lowest rank, leftmost first, until none can be joined."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[part] for part in parts]

    def _derive(self, token: int) -> tuple[tuple[bytes, int], tuple[bytes, int]] | None:
        """The last join that BPE makes of a token, as its two parts with their ranks; None for a byte and for a token that BPE never reaches."""
        if token not in self._joins:
            parts = [self.tokens[token][i : i + 1] for i in range(len(self.tokens[token]))]
            found = None
            while len(parts) > 1:
                ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
                if not ranked:
                    break
                at = min(ranked)[1]
                found = tuple((part, self.ranks[part]) for part in parts[at : at + 2])
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._joins[token] = found if len(parts) == 1 else None
            self._reached[token] = len(parts) == 1
            # Joins come in the order of ranks only if parts rank below what they make; else neighbours are tried out.
            if len(parts) == 1 and found and max(found[0][1], found[1][1]) >= token:
                self.ordered = False
        return self._joins[token]

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at one border of a token while BPE makes it, from its byte up to the token."""
        key = (token, side)
        if key not in self._borders:
            chain, at = [(self.tokens[token], token)], token
            while (join := self._derive(at)) is not None:
                chain.append(join[side])
                at = join[side][1]
            self._borders[key] = chain[::-1]
        return self._borders[key]

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether BPE leaves the border between these two tokens; at the start, whether it reaches the token at all."""
        pair = last << 32 | token
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= MAX_PAIRS:
                self._pairs.clear()
            self._derive(token)
            known = self._pairs[pair] = self._reached[token] and (last < 0 or self._border_stays(last, token))
        return known

    def _border_stays(self, last: int, token: int) -> bool:
        """Follow the joins on both sides of the border in the order of ranks: does joining across it ever come first?

        Of equal ranks the left join is made first, so one on the left of the border wins a tie and one on its right loses it.
        """
        left, right = self._edge(last, 1), self._edge(token, 0)
        if not self.ordered:
            return self.merge(self.tokens[last] + self.tokens[token]) == [last, token]
        never = len(self.ranks) + (1 << 40)
        i = j = 0
        while True:
            next_left = left[i + 1][1] if i + 1 < len(left) else never
            next_right = right[j + 1][1] if j + 1 < len(right) else never
            across = self.ranks.get(left[i][0] + right[j][0], never)
            if across < next_left and across <= next_right and across != never:
                return False
            if next_left == next_right == never:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The transition of a state on a byte: next state, tokens written."""
        after, done, child = [], None, self._child
        for node, last, owed in self._readings_of(state):
            node = child.get(node << 8 | byte)
            if node is None:
                continue
            if self._open[node]:
                after.append((node, last, owed))
            token = self._ends[node]
            if done is None and token >= 0 and self._may_follow(last, token):
                done = (0, token, (*owed, token))
        assert done is not None, "the rank table lacks a single byte"
        after.append(done)
        first, n = done[2], len(done[2])
        for _, _, owed in after:
            n = min(n, len(owed))
            while owed[:n] != first[:n]:
                n -= 1
        return self._state([(node, last, owed[n:]) for node, last, owed in after]), first[:n]

    def _make(self, keys: np.ndarray) -> None:
        """Make the moves of these keys, state << 8 | byte."""
        made = [self._move(key >> 8, key & 255) for key in keys.tolist()]
        n = self._written.n
        while n + len(made) > len(self._target):
            self._target = np.concatenate([self._target, np.zeros_like(self._target)])
        self._target[n : n + len(made)] = [target for target, _ in made]
        self._written.add([written for _, written in made])
        self._moves.put(keys, np.arange(n, n + len(made), dtype=np.int32))
        self._settle()

    def run(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and values of the token lists of pieces of 1 to STEPS bytes, by steps of all pieces at once."""
        if self._written.n > MAX_MOVES:
            self._forget()
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-sizes, kind="stable")
        longest_first = sizes[order]
        starts = (np.cumsum(sizes) - sizes)[order]
        data = np.frombuffer(b"".join(pieces), np.uint8)
        state = np.zeros(len(pieces), np.int32)
        who, told = [], []
        running = np.searchsorted(-longest_first, -np.arange(longest_first[0] if len(pieces) else 0), side="left")  # pieces longer than k
        for k, n in enumerate(running.tolist()):
            key = state[:n].astype(np.int64) << 8 | data[starts[:n] + k]
            move = self._moves.find(key)
            new = move < 0
            if new.any():
                self._make(np.unique(key[new]))
                move[new] = self._moves.find(key[new])
            state[:n] = self._target[move]
            writes = np.flatnonzero(self._written.size[move])
            who.append(order[writes])
            told.append(move[writes])
        who, told = np.concatenate([*who, order]), np.concatenate([*told, state])
        steps = len(who) - len(order)  # behind: what each piece owes at its end
        size = np.concatenate([self._written.size[told[:steps]], self._owed.size[told[steps:]]])
        start = np.concatenate([self._written.start[told[:steps]], self._owed.start[told[steps:]] + np.int32(self._written.used)])
        flat = np.concatenate([self._written.flat[: self._written.used], self._owed.flat[: self._owed.used]])
        by_piece = np.argsort(who, kind="stable")
        return np.bincount(who, size, len(pieces)).astype(np.int32), flat[_ranges(start[by_piece].astype(np.int64), size[by_piece])]

    def _ends_ahead(self, node: int, data: bytes, place: int) -> list[tuple[int, int]]:
        """(end, token) of the tokens that may end behind a place, shortest first, when the trie stands in node there."""
        child, ends, found = self._child, self._ends, []
        for at in range(place, len(data)):
            node = child.get(node << 8 | data[at])
            if node is None:
                break
            if ends[node] >= 0:
                found.append((at + 1, ends[node]))
        return found

    def encode(self, piece: bytes) -> list[int]:
        """One piece by following its readings one at a time, longest token first, without making states.

        A place is reached by one last token at most, so one that led nowhere is never entered again.
        """
        n, dead = len(piece), set()
        out, tries = [], [(0, -1, self._ends_ahead(0, piece, 0))]
        while tries:
            place, last, ahead = tries[-1]
            while ahead:
                end, token = ahead.pop()
                if end not in dead and self._may_follow(last, token):
                    out.append(token)
                    if end == n:
                        return out
                    tries.append((end, token, self._ends_ahead(0, piece, end)))
                    break
            else:
                tries.pop()
                dead.add(place)
                if out:
                    out.pop()
        if n:
            raise AssertionError("the rank table lacks a single byte")
        return []


class Utf8Stream:
    """Incremental UTF-8: takes bytes in any cuts, gives the characters that are complete.

    States count the continuation bytes still awaited and the range allowed for the next one;
    bytes that no character can contain become U+FFFD.
    """

    def __init__(self) -> None:
        self.held, self.need, self.low, self.high = bytearray(), 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        i = 0
        while i < len(data):
            if not self.need:
                # All characters that end in this chunk at once; byte by byte only from a place that is no UTF-8.
                whole = self._complete(data, i)
                try:
                    out.append(data[i:whole].decode())
                    i = whole
                except UnicodeDecodeError as fault:
                    out.append(data[i : i + fault.start].decode())
                    i += fault.start
                if i == len(data):
                    break
            byte = data[i]
            if not self.need:
                if 0xC2 <= byte <= 0xF4:
                    self.need = 1 if byte < 0xE0 else 2 if byte < 0xF0 else 3
                    self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
                    self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
                    self.held.append(byte)
                else:
                    out.append("�")
                i += 1
            elif self.low <= byte <= self.high:
                self.held.append(byte)
                self.need -= 1
                self.low, self.high = 0x80, 0xBF
                if not self.need:
                    out.append(self.held.decode())
                    self.held.clear()
                i += 1
            else:  # the sequence broke off; this byte begins anew
                out.append("�")
                self.held.clear()
                self.need, self.low, self.high = 0, 0x80, 0xBF
        return "".join(out)

    @staticmethod
    def _complete(data: bytes, start: int) -> int:
        """Where the last character that is complete ends."""
        for back in range(1, min(4, len(data) - start + 1)):
            byte = data[-back]
            if byte >= 0xC0:
                return len(data) - back if back < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4) else len(data)
            if byte < 0x80:
                break
        return len(data)

    def end(self) -> str:
        """What a stream that ends inside a character leaves."""
        return "�" if self.held else ""


class Chunks(dict):
    """Text from one blank to the next, with the blank before it -> its token ids; filled on demand and bounded.

    A blank begins a new piece unless white space stands on both its sides, so chunks can be split on their own.
    """

    def __init__(self, pieces: Pieces, splitter):
        self.pieces, self.split = pieces, splitter.findall

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        found = self.split(chunk)
        ids = self.pieces[found[0]] if len(found) == 1 else tuple(x for piece in found for x in self.pieces[piece])
        if len(chunk) <= MAX_PIECE_CHARS:
            if len(self) >= MAX_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids


#: A blank that may belong to the white space before or after it.
_INNER_BLANK = regex.compile(r"\s \s")
#: Signs that are a piece by themselves behind a word.
_SIGNS = frozenset(".,;:!?")


class _Known(dict):
    """Text -> place of its ids; a new text gets the next place and waits to be encoded."""

    def __init__(self, coder: Coder, before: str = ""):
        self.coder, self.before = coder, before

    def __missing__(self, text: str) -> int:
        place = self[text] = self.coder.wait(self.before + text)
        return place


class Coder:
    """Token ids of texts, many at a time; what was encoded before is remembered within bounds.

    A text is cut at blanks: a blank begins a new piece unless white space stands on both its sides, so the chunks
    can be split into pieces on their own. Chunks are held without their blank.
    """

    def __init__(self, path: str, pattern: str):
        self.transducer, self.usual, self.split = Transducer(read_ranks(path)), pattern == public_tokenizers.PATTERN, regex.compile(pattern).findall
        self._clear()

    def _clear(self) -> None:
        self.first, self.later, self.pieces = _Known(self), _Known(self, " "), {}
        self.ids, self.waiting = Lists(), []

    def wait(self, chunk: str) -> int:
        self.waiting.append(chunk)
        return self.ids.n + len(self.waiting) - 1

    def _pieces_of(self, chunk: str) -> list[str]:
        bare = chunk[1:] if chunk[:1] == " " else chunk
        if self.usual and bare.isalpha():
            return [chunk]
        if self.usual and bare[-1:] in _SIGNS and bare[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.split(chunk)

    def _encode_waiting(self) -> None:
        places: dict[str, int] = {}
        cut = [self._pieces_of(chunk) for chunk in self.waiting]
        wanted = np.fromiter((places.setdefault(piece, len(places)) for pieces in cut for piece in pieces), np.int64)
        found = self._encoded([piece.encode() for piece in places])
        _, values = found.take(wanted)
        tokens = np.concatenate([[0], np.cumsum(found.size[wanted])])
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        self.ids.extend(np.diff(tokens[np.concatenate([[0], ends])]), values)
        self.waiting.clear()

    def _encoded(self, pieces: list[bytes]) -> Lists:
        """Token lists of different pieces: of the table, run in step, or followed alone."""
        out: list[tuple[int, ...] | None] = []
        parts, run, held = [], [], 0
        for i, piece in enumerate(pieces):
            whole = self.transducer.ranks.get(piece)
            if whole is not None:
                parts.append((np.array([i]), np.array([1]), np.array([whole])))
            elif len(piece) > STEPS:
                ids = self.transducer.encode(piece)
                parts.append((np.array([i]), np.array([len(ids)]), np.array(ids)))
            else:
                run.append(i)
                held += len(piece)
            if run and (held >= RUN or i == len(pieces) - 1):
                parts.append((np.array(run), *self.transducer.run([pieces[x] for x in run])))
                run, held = [], 0
        if run:
            parts.append((np.array(run), *self.transducer.run([pieces[x] for x in run])))
        return self._in_order(parts, len(pieces))

    @staticmethod
    def _in_order(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> Lists:
        out = Lists()
        if n:
            who, sizes, values = (np.concatenate([part[k] for part in parts]) for k in range(3))
            starts = np.cumsum(sizes) - sizes
            order = np.argsort(who)
            out.extend(sizes[order], values[_ranges(starts[order], sizes[order])])
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and token ids of all texts, one after the other."""
        if self.ids.n > MAX_CHUNKS:
            self._clear()
        places: list[int] = []
        counts = []
        for text in texts:
            before = len(places)
            if text:
                if self.usual and not _INNER_BLANK.search(text):
                    head, *rest = text.split(" ")
                    if head:
                        places.append(self.first[head])
                    places.extend(map(self.later.__getitem__, rest))
                else:
                    places.extend(map(self.first.__getitem__, self.split(text)))
            counts.append(len(places) - before)
        self._encode_waiting()
        sizes, ids = self.ids.take(np.array(places, np.int64))
        tokens = np.concatenate([[0], np.cumsum(sizes)])
        return tokens[np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])], ids


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


@lru_cache(maxsize=2)
def _tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(path).items()}


def _turn() -> None:
    workers.turn("bpe", _coder.cache_clear, _tokens.cache_clear)


def encode_texts(texts: list[str | None], path: str, pattern: str = public_tokenizers.PATTERN) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and token ids of texts, see Coder.encode()."""
    return _coder(path, pattern).encode(texts)


def encode_text(text: str | None, path: str, pattern: str = public_tokenizers.PATTERN) -> list[int]:
    return encode_texts([text], path, pattern)[1].tolist()


def slices(batch: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch in parts of SLICE characters or one text."""
    part, held = [], 0
    for text in batch:
        text = text.as_py()
        part.append(text)
        held += len(text or "")
        if held >= SLICE:
            yield part
            part, held = [], 0
    if part:
        yield part


def decode_stream(ids, path: str, step: int = 4096) -> Iterator[str]:
    """Characters of token ids, as they become complete."""
    tokens = _tokens(path)
    machine = Utf8Stream()
    for i in range(0, len(ids), step):
        yield machine.feed(b"".join([tokens[x] for x in ids[i : i + step]]))
    yield machine.end()


def _lists(offsets: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))


def _decoded(offsets: np.ndarray, ids: np.ndarray, path: str) -> list[str]:
    flat, at = ids.tolist(), offsets.tolist()
    return ["".join(decode_stream(flat[a:b], path)) for a, b in zip(at, at[1:])]


def encode(text: Column, path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """Token ids of a text column, array<int>."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _turn()
        for batch in batches:
            yield pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *(_lists(*encode_texts(part, path, pattern)) for part in slices(batch))])

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """Text of a column of token ids; null counts as no ids."""

    @F.arrow_udf(T.StringType())
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _turn()
        for batch in batches:
            yield pa.array(["".join(decode_stream(row.as_py() or [], path)) for row in batch], pa.string())

    return texts(ids)


ROUND_TRIP = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def round_trip(docs: DataFrame, path: str, text: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs with `ids` (array<int>) and `decoded` (the text that the ids stand for), in one pass through one worker."""
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    @F.arrow_udf(ROUND_TRIP)
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _turn()
        for batch in batches:
            parts = [pa.array([], kind)]
            for part in slices(batch):
                offsets, ids = encode_texts(part, path, pattern)
                parts.append(pa.StructArray.from_arrays([_lists(offsets, ids), pa.array(_decoded(offsets, ids, path), pa.string())], fields=list(kind)))
            yield pa.concat_arrays(parts)

    return docs.withColumn("__both", both(F.col(text))).withColumns({"ids": F.col("__both.ids"), "decoded": F.col("__both.decoded")}).drop("__both")
