"""SentencePiece BPE encoding and decoding that keeps each piece's place in the original bytes.

A model file is read by itself: pieces, normalisation, compiled character map. Normalisation takes at each place the longest
key of that map (a double-array trie) that begins there, else one character, and records for every byte it writes the original
byte it comes from; pieces of the normalised text are then projected to original byte spans. Pieces are made by joining the
neighbours of highest score, leftmost first. No piece of a usual model has a blank behind another character, so
the text falls into words whose pieces don't depend on each other; those of a word seen before are remembered. Characters
without a piece become byte pieces.

Defined cases: null counts as empty; an empty text has no pieces; begin and end ids are never written; control strings
inside a text are plain text; a piece that stands for added blanks only has an empty span; a byte piece has the span of its byte, or of the
whole rewritten stretch. Models other than BPE, and models with user-defined or unused pieces, are refused. round_trip() replaces columns
named ids, ends or decoded; other columns, repeated rows and their order in a partition stay.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluier.llm.bpe import Lists, Places, _ranges, slices

BLANK = "▁"  # fixed value: how models write a blank
#: Words whose pieces a worker remembers; beyond, they are made anew.
MAX_WORDS = 250_000
#: Characters up to which words are joined in step, in rows of the next of these widths, and rows at once; a longer word is joined by itself.
WIDTHS, ROWS = (2, 4, 8, 12, 16, 24, 32, 64), 1 << 14
#: The rank of two neighbours that aren't a piece together.
NEVER = 1 << 60
#: Bits of a symbol's number in a pair, and what stands for a symbol that went into the one before it.
SHIFT, GONE = 22, -1
# Fixed values of the model format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = number() if tag & 7 == 2 else 4 if tag & 7 == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 keys whose values are places of their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.targets = blob[4 + size :]
        self._known: dict[int, bytes] = {}

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, replacement) of the longest key that begins at a place."""
        units, found = self.units, None
        if not units:
            return None
        node = self._below(0)
        for end in range(at, len(data)):
            node ^= data[end]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[end]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (end + 1 - at, units[node] & 0x7FFFFFFF)
        return None if found is None else (found[0], self._target(found[1]))

    def _below(self, node: int) -> int:
        unit = self.units[node]
        return node ^ (unit >> 10) << ((unit & 512) >> 6)

    def _target(self, place: int) -> bytes:
        if place not in self._known:
            self._known[place] = self.targets[place : self.targets.index(b"\0", place)]
        return self._known[place]


@dataclass
class Normaliser:
    """What a model does to a text before it is cut."""

    characters: CharacterMap = field(default_factory=lambda: CharacterMap(b""))
    add_blank: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def plain(self) -> bool:
        """Whether only blanks change, one for one."""
        return not self.characters.units and not self.squeeze and self.escape and self.add_blank

    def __call__(self, text: str) -> tuple[bytes, list[int]]:
        """The normalised text, and for each of its bytes (and its end) the original byte that it comes from."""
        data, out, origin = text.encode(), bytearray(), []
        blank = BLANK.encode() if self.escape else b" "

        def put(new: bytes, at: int, each: bool) -> None:
            for i, byte in enumerate(new):
                piece = blank if byte == 32 else bytes([byte])
                out.extend(piece)
                origin.extend([at + i if each else at] * len(piece))

        def step(at: int) -> tuple[int, bytes, bool]:
            rule = self.characters.longest(data, at)
            if rule:
                return rule[0], rule[1], False
            size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            return size, data[at : at + size], True

        at = 0
        while self.squeeze and at < len(data):
            size, new, _ = step(at)
            if new != b" ":
                break
            at += size
        if at == len(data):
            return b"", [at]
        if self.add_blank:
            put(b" ", at, False)
        after_blank = self.squeeze
        while at < len(data):
            size, new, each = step(at)
            if after_blank:
                new = new.lstrip(b" ")
            if new:
                put(new, at, each)
                after_blank = new.endswith(b" ")
            at += size
            after_blank &= self.squeeze
        end = len(data)
        while self.squeeze and out.endswith(blank):
            end = origin[-len(blank)]
            del out[-len(blank) :], origin[-len(blank) :]
        return bytes(out), [*origin, end]


class _Symbols(dict):
    """Character or piece -> number; characters without a piece get the numbers behind the pieces."""

    def __init__(self, ids: dict[str, int], n: int):
        super().__init__(ids)
        self.n, self.characters = n, []

    def __missing__(self, character: str) -> int:
        number = self[character] = self.n + len(self.characters)
        self.characters.append(character)
        return number


class _Words(dict):
    """Word -> place of its ids; a new word gets the next one."""

    def __init__(self, model: Model, before: str = ""):
        self.model, self.before = model, before

    def __missing__(self, word: str) -> int:
        place = self[word] = self.model.wait(self.before + word)
        return place


class Model:
    """A BPE model file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            fields = list(_fields(file.read()))
        pieces = [dict(_fields(value)) for number, value in fields if number == 1]
        trainer = dict(_fields(next((value for number, value in fields if number == 2), b"")))
        rules = dict(_fields(next((value for number, value in fields if number == 3), b"")))
        self.kinds = [piece.get(3, NORMAL) for piece in pieces]
        self.pieces = [piece[1].decode() for piece in pieces]
        if trainer.get(3, 1) != 2 or {USER_DEFINED, UNUSED} & set(self.kinds) or trainer.get(24, 0) or any(number == 5 for number, _ in fields):
            raise ValueError("not a BPE model of normal, byte and control pieces only")
        self.normaliser = Normaliser(CharacterMap(rules.get(2, b"")), *(bool(rules.get(k, 1)) for k in (3, 4, 5)))
        self.ids = {piece: i for i, piece in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self._tabulate({piece: struct.unpack("<f", pieces[i].get(2, b"\0\0\0\0"))[0] for piece, i in self.ids.items()})
        self.bytes = {int(self.pieces[i][3:5], 16): i for i, kind in enumerate(self.kinds) if kind == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_text = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.is_byte = np.array([kind == BYTE for kind in self.kinds])
        #: Whether words can be cut on their own: no piece, nor a run of unknown characters, goes on across a blank.
        self.by_word = not any(BLANK in piece.lstrip(BLANK) for piece in self.ids) and (BLANK in self.ids or bool(self.bytes))
        #: Whether a word can be cut where letters and other signs meet: no piece holds both.
        self.by_run = not any(len(_RUN.findall(piece)) > 1 for piece in self.ids) and bool(self.bytes)
        #: Bytes that a piece takes of the normalised text.
        self.sizes = np.array([1 if kind == BYTE else len(piece.encode()) for piece, kind in zip(self.pieces, self.kinds)], np.int64)
        self.written = [self._written(i) for i in range(len(pieces))]
        self.written_sizes = np.array([len(x) for x in self.written], np.int64)
        self._clear()

    def _clear(self) -> None:
        self.whole, self.bare, self.known = _Words(self), _Words(self, BLANK), Lists()
        self.waiting: list[str] = []

    def _written(self, i: int) -> bytes:
        kind, piece = self.kinds[i], self.pieces[i]
        return {CONTROL: b"", BYTE: bytes([int(piece[3:5], 16)]) if kind == BYTE else b"", UNKNOWN: self.unknown_text.encode()}.get(kind, piece.replace(BLANK, " ").encode())

    def _tabulate(self, scores: dict[str, float]) -> None:
        """Two symbols -> the rank of their joining (equal scores have equal ranks) and the piece it makes. Symbols are pieces, or characters without one."""
        self.symbols = _Symbols(self.ids, len(self.pieces))
        order = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs: dict[int, tuple[int, int]] = {}
        known = lambda part: len(part) == 1 or part in scores
        for piece, score in scores.items():
            for i in range(1, len(piece)):
                if known(piece[:i]) and known(piece[i:]):
                    pairs[self.symbols[piece[:i]] << SHIFT | self.symbols[piece[i:]]] = order[score], self.ids[piece]
        self.pairs = Places()
        self.pairs.put(np.array(list(pairs), np.int64), np.arange(len(pairs), dtype=np.int32))
        #: The rank and the piece of each pair; the last place is that of pairs that are none.
        self.rank, self.joined = (np.array([*(pair[k] for pair in pairs.values()), none], np.int64) for k, none in enumerate((NEVER, -1)))

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs; -1, the last one, for what is none."""
        out = np.full(left.shape, -1, np.int64)
        both = (left >= 0) & (right >= 0)
        out[both] = self.pairs.find(left[both] << SHIFT | right[both])
        return out

    # -- encoding

    def join(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols, filled up with -1: in each row the neighbours of best rank, leftmost first, are joined until none can be; all rows at once."""
        out, row = symbols.copy(), np.arange(len(symbols))
        held, pair = symbols, self._pair(symbols[:, :-1], symbols[:, 1:])
        column = np.arange(symbols.shape[1])
        while len(row) and held.shape[1] > 1:
            rank = self.rank[pair]
            at = rank.argmin(axis=1)
            going = rank[np.arange(len(row)), at] < NEVER
            if not going.all():
                out[row[~going]] = held[~going]
                row, held, pair, at = row[going], held[going], pair[going], at[going]
                if not len(row):
                    break
            every = np.arange(len(row))
            whole = self.joined[pair[every, at]]
            behind = np.minimum(column + (column > at[:, None]), len(column) - 1)
            moved = np.take_along_axis(held, behind, axis=1)
            moved[:, -1] = -1
            moved[every, at] = whole
            pair = np.take_along_axis(pair, np.minimum(column[:-1] + (column[:-1] >= at[:, None]), len(column) - 2), axis=1)
            pair[:, -1] = -1
            held = moved
            for place in (at - 1, at):
                inside = (place >= 0) & (place < len(column) - 1)
                pair[every[inside], place[inside]] = self._pair(held[every[inside], place[inside]], held[every[inside], place[inside] + 1])
        out[row] = held
        return out

    def _join_long(self, parts: list[int]) -> list[int]:
        """The same of one long row, by a heap."""
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        found = self._pair(np.array(parts[:-1]), np.array(parts[1:])).tolist()
        heap = [(int(self.rank[pair]), i, i + 1, pair) for i, pair in enumerate(found) if pair >= 0]
        heapq.heapify(heap)
        now = [*found, -1]  # the pair that begins with a symbol
        while heap:
            _, a, b, pair = heapq.heappop(heap)
            if right[a] != b or now[a] != pair:
                continue
            parts[a], parts[b], right[a], right[b], now[b] = int(self.joined[pair]), GONE, right[b], -1, -1
            if right[a] >= 0:
                left[right[a]] = a
            for x, y in ((left[a], a), (a, right[a])):
                if x >= 0:
                    now[x] = int(self._pair(np.array([parts[x]]), np.array([parts[y]]))[0]) if y >= 0 else -1
                    if now[x] >= 0:
                        heapq.heappush(heap, (int(self.rank[now[x]]), x, y, now[x]))
        return [part for part in parts if part != GONE]

    def _joined(self, runs: list[str]) -> Lists:
        """Ids of the pieces of different stretches of normalised text."""
        points = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)
        different, which = np.unique(points, return_inverse=True)
        symbols = np.array([self.symbols[chr(point)] for point in different.tolist()], np.int64)[which]
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        starts = np.cumsum(sizes) - sizes
        who, counts, values, below = [], [], [], 0
        for width in (*WIDTHS, None):
            some = np.flatnonzero((sizes > below) & (sizes <= width)) if width else np.flatnonzero(sizes > below)
            for k in range(0, len(some), ROWS) if width else range(len(some)):
                part = some[k : k + (ROWS if width else 1)]
                if width:
                    rows = np.full((len(part), width), -1)
                    rows[np.arange(width) < sizes[part, None]] = symbols[_ranges(starts[part], sizes[part])]
                    rows = self.join(rows)
                    flat, held = rows[rows >= 0], (rows >= 0).sum(axis=1)
                else:
                    flat = np.array(self._join_long(symbols[starts[part[0]] : starts[part[0]] + sizes[part[0]]].tolist()))
                    held = np.array([len(flat)])
                flat, held = self._spelt(flat, held)
                who.append(part)
                counts.append(held)
                values.append(flat)
            below = width
        out = Lists()
        if runs:
            who, counts, values = (np.concatenate(x) for x in (who, counts, values))
            order, at = np.argsort(who), np.cumsum(counts) - counts
            out.extend(counts[order], values[_ranges(at[order], counts[order])])
        return out

    def _spelt(self, flat: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for symbols: characters without a piece become their bytes, or, where a model has no bytes, one unknown piece for a row of them."""
        n = len(self.pieces)
        odd = np.flatnonzero(flat >= n)
        if not len(odd):
            return flat, held
        row = np.repeat(np.arange(len(held)), held)
        if self.bytes:
            size = np.ones(len(flat), np.int64)
            spelt = [[self.bytes[byte] for byte in self.symbols.characters[flat[i] - n].encode()] for i in odd.tolist()]
            size[odd] = [len(x) for x in spelt]
            new = np.repeat(flat, size)
            new[new >= n] = [i for x in spelt for i in x]
            return new, np.bincount(np.repeat(row, size), minlength=len(held))
        flat = np.where(flat >= n, self.unknown, flat)
        keep = np.ones(len(flat), bool)
        keep[1:] = (flat[1:] != self.unknown) | (flat[:-1] != self.unknown) | (row[1:] != row[:-1])
        return flat[keep], np.bincount(row[keep], minlength=len(held))

    def wait(self, word: str) -> int:
        """The place that a new word's ids will have."""
        self.waiting.append(word)
        return self.known.n + len(self.waiting) - 1

    def _encode_waiting(self) -> None:
        places: dict[str, int] = {}
        cut = [_RUN.findall(word) if self.by_run and not word[1:].isalpha() else (word,) for word in self.waiting]
        wanted = np.fromiter((places.setdefault(run, len(places)) for runs in cut for run in runs), np.int64)
        found = self._joined(list(places))
        _, values = found.take(wanted)
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        tokens = np.concatenate([[0], np.cumsum(found.size[wanted])])
        self.known.extend(np.diff(tokens[np.concatenate([[0], ends])]), values)
        self.waiting.clear()

    def encode(self, texts: list[str | None], places: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Offsets (one more than texts), ids, and the original byte at which each piece ends (if places), of all texts one after the other."""
        if self.known.n > MAX_WORDS:
            self._clear()
        plain = self.normaliser.plain and self.by_word
        found: list[int] = []
        counts, origins = [], []
        for text in texts:
            before = len(found)
            if text and not plain:
                data, origin = self.normaliser(text)
                origins.append(origin)
                found += map(self.whole.__getitem__, _WORD.findall(data.decode()) if self.by_word else [data.decode()])
            elif text and text[0] != " " and text[-1] != " " and "  " not in text and BLANK not in text:
                found += map(self.bare.__getitem__, text.split(" "))
            elif text:
                found += map(self.whole.__getitem__, _WORD.findall(BLANK + text.replace(" ", BLANK)))
            counts.append(len(found) - before)
        self._encode_waiting()
        sizes, ids = self.known.take(np.array(found, np.int64))
        offsets = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])]
        if not places or not len(ids):
            return offsets, ids, np.zeros(0, np.int64)
        # A piece ends where the next one begins, the last one of a text where the text ends.
        sizes = self.sizes[ids]
        begins = self._origins(texts, plain, origins)[np.cumsum(sizes) - sizes + np.repeat(np.arange(len(texts)), np.diff(offsets))]
        ends = np.append(begins[1:], 0)
        full = np.diff(offsets) > 0
        lengths = np.array([len((text or "").encode()) for text in texts], np.int64) if plain else np.array([o[-1] for o in _spread(origins, texts)], np.int64)
        ends[offsets[1:][full] - 1] = lengths[full]
        return offsets, ids, ends

    def _origins(self, texts: list[str | None], plain: bool, origins: list[list[int]]) -> np.ndarray:
        """Original bytes of the normalised bytes of all texts; each text has one more, for its end."""
        if not plain:
            return np.concatenate([np.array(o, np.int64) for o in _spread(origins, texts)])
        # One byte before each text stands for the blank that is added; blanks are written with three bytes. A text's end follows it.
        data = np.frombuffer(b"".join([b"\0%b\0" % text.encode() if text else b"\0" for text in texts]), np.uint8)
        sizes = np.array([len(text.encode()) + 2 if text else 1 for text in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        wide = np.where(data == 32, 3, 1)
        wide[starts[sizes > 1]] = 3
        place = np.arange(len(data)) - np.repeat(starts, sizes) - 1
        return np.repeat(np.maximum(place, 0), wide)

    # -- decoding

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for: a blank that begins it goes, byte pieces are joined, bytes that are no UTF-8 become U+FFFD."""
        written, kinds = self.written, self.kinds
        first = next((k for k, i in enumerate(ids) if kinds[i] != CONTROL), len(ids))
        parts = [written[i] for i in ids[first:]]
        if parts and kinds[ids[first]] == NORMAL and (self.normaliser.add_blank or self.normaliser.squeeze) and parts[0].startswith(b" "):
            parts[0] = parts[0][1:]
            while self.normaliser.squeeze and parts and self.pieces[ids[first]].replace(BLANK, "") == "":
                # Where blanks are squeezed, those of several pieces go until one with other characters.
                first += 1
                parts.pop(0)
                if not parts or kinds[ids[first]] != NORMAL:
                    break
                parts[0] = parts[0].removeprefix(b" ")
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            return self._decode_odd(ids[first:], parts)

    def _decode_odd(self, ids: list[int], parts: list[bytes]) -> str:
        out, held = [], bytearray()
        for i, part in zip([*ids, None], [*parts, b""]):
            if i is not None and self.kinds[i] == BYTE:
                held += part
                continue
            at = 0
            while at < len(held):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(held[at : at + size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    size = 1
                at += size
            held.clear()
            out.append(part.decode())
        return "".join(out)


_WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: Blanks with the letters behind them, and what is no letter.
_RUN = re.compile(f"{BLANK}*[A-Za-zÀ-ɏ]+|{BLANK}*[^A-Za-zÀ-ɏ{BLANK}]+|{BLANK}+")


def _spread(origins: list[list[int]], texts: list[str | None]) -> Iterator[list[int]]:
    """The origins of each text; those of empty texts, which aren't normalised, are their end."""
    made = iter(origins)
    for text in texts:
        yield next(made) if text else [0]


@lru_cache(maxsize=2)
def model_of(path: str) -> Model:
    return Model(path)


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, pa.int32()))


ROUND_TRIP = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
_KIND = pa.struct([("ids", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("decoded", pa.string())])


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with `ids` (array<int>), `ends` (where each piece ends in the bytes of the original, see spans()) and `decoded` (the text that the ids stand for)."""

    @F.arrow_udf(ROUND_TRIP)
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_of(path)
        for batch in batches:
            parts = [pa.array([], _KIND)]
            for part in slices(batch):
                offsets, ids, ends = model.encode(part)
                flat, at = ids.tolist(), offsets.tolist()
                decoded = [model.decode(flat[a:b]) for a, b in zip(at, at[1:])]
                parts.append(pa.StructArray.from_arrays([_lists(offsets, ids), _lists(offsets, ends), pa.array(decoded, pa.string())], fields=list(_KIND)))
            yield pa.concat_arrays(parts)

    return docs.withColumn("__both", both(F.col(text))).withColumns({name: F.col(f"__both.{name}") for name in ("ids", "ends", "decoded")}).drop("__both")


def spans(ends: Column) -> Column:
    """(start, end) of each piece in the bytes of the original: pieces follow each other without a gap."""
    return F.transform(ends, lambda end, i: F.struct(F.when(i > 0, F.get(ends, i - 1)).otherwise(0).alias("start"), end.alias("end")))


def decode(ids: Column, path: str) -> Column:
    """Text of a column of piece ids; null counts as no ids."""

    @F.arrow_udf(T.StringType())
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = model_of(path)
        for batch in batches:
            yield pa.array([model.decode(row.as_py() or []) for row in batch], pa.string())

    return texts(ids)


def op12(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids and of the decoded text; n_bytes is where the last piece ends in the original."""
    coded = round_trip(docs.select("doc_id", "text"), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)).cast("long").alias("n_bytes"),
    )
