"""Phrase collocations: phrases of two or three words whose parts meet far more often than their own counts tell.

Each task turns its texts into sorted shards of word windows (three words, or fewer at the end of a piece) and builds a weighted
acyclic automaton of each prefix range of a shard: states are closed as soon as no later string can reach them, and states with the same
arcs are one. The automata of a range are united, weights of equal strings summed; how often a phrase occurs is the sum of the weights
over its prefix range. Phrases that occur LEAST times or more are again automata, one for each range. A phrase asks for the counts of its
parts by an automaton of all parts that its range needs from another; composing it with that range's automaton gives the answer, and tells
the parts how often the longest phrase around them occurs. So a part that very many phrases share is asked for once by each range.

Ranges are cut at quantiles of a sample of windows, by language, first, second and third word, so that a word or a pair that holds a third of all
windows is many ranges; the sample bears on their sizes only, never on counts. A phrase that is cut by a border is summed over its ranges.
A range is RANGE bytes of text (more beyond MOST_RANGES of them, whose borders go to every task: some 5 MB).

Defined cases: null texts count as empty, null languages as `und`; equal scores are ordered by count, then by phrase in byte order; repeated
rows count each time; an empty table gives no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluier.llm.bpe import _ranges
from sluier.session import materialise

#: Bytes of text whose windows are one range, about; ranges at most; sampled windows for each range.
RANGE, MOST_RANGES, SAMPLED = 8 << 20, 1 << 17, 8
#: Words of a shard: below 2^21, so that three places of different words fit into one number.
SHARD = 1_500_000
#: Bytes of text that are cut into words at once, about.
SLICE = 1 << 20
#: Strings that are closed at once while an automaton is built, and strings of automata that wait to be united.
CLOSED, WAITING = 1 << 16, 1 << 18
#: Parts of a language whose best phrases are chosen before those of the language.
SALTS = 16

# Fixed values of the contract: what ends a piece, what stands between words, which letters are lower-cased.
_PIECE_ENDS, _BETWEEN = b".,;:!?\n\x0b\x0c\r", b" \t"
_TABLE = bytes(10 if c in _PIECE_ENDS else 32 if c in _BETWEEN else c + 32 if 65 <= c <= 90 else c for c in range(256))
UNDETERMINED = "und"


# -- weighted acyclic automata -----------------------------------------------------------------


@dataclass
class Strings:
    """Strings of one to three words, sorted: places of their words (-1: none) in a sorted word list, and weights."""

    words: list[bytes]
    at: np.ndarray  # 3 x n
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.weights)

    def cut(self, begin: int, end: int) -> Strings:
        return Strings(self.words, self.at[:, begin:end], self.weights[begin:end])

    def begins(self, depth: int) -> np.ndarray:
        """Whether a string differs from the one before it in its first `depth` words."""
        new = np.ones(len(self), bool)
        if len(self):
            new[1:] = (self.at[:depth, 1:] != self.at[:depth, :-1]).any(axis=0)
        return new

    def place(self, *words: bytes) -> int:
        """How many of the strings are smaller than this one."""
        low, high = 0, len(self)
        for depth in range(3):
            if depth >= len(words) or not words[depth]:
                return low + int(np.searchsorted(self.at[depth, low:high], -1, "left"))
            rank = bisect_left(self.words, words[depth])
            known = rank < len(self.words) and self.words[rank] == words[depth]
            column = self.at[depth, low:high]
            low, high = low + int(np.searchsorted(column, rank, "left")), low + int(np.searchsorted(column, rank, "right" if known else "left"))
            if not known:
                return low
        return low


def sorted_sum(words: list[bytes], at: np.ndarray, weights: np.ndarray) -> Strings:
    """Strings in order, weights of equal ones summed."""
    if not len(weights):
        return Strings(words, at, weights)
    if len(words) < (1 << 21) - 1:
        key = (at[0] + 1 << 42) | (at[1] + 1 << 21) | (at[2] + 1)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    else:
        order = np.lexsort(at[::-1])
        new = np.flatnonzero(np.concatenate([[True], (at[:, order[1:]] != at[:, order[:-1]]).any(axis=0)]))
    return Strings(words, at[:, order[new]], np.add.reduceat(weights[order], new))


@dataclass
class Automaton:
    """States are stretches of arcs; an arc has a word, the weight of the string that ends with it (0: none ends) and the next state (-1: none)."""

    words: list[bytes]
    first: np.ndarray
    word: np.ndarray
    weight: np.ndarray
    next: np.ndarray

    def _arcs(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Arcs of states, and how many each has."""
        sizes = self.first[states + 1] - self.first[states]
        return _ranges(self.first[states], sizes), sizes

    def _paths(self, other: Automaton | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Strings in order with their weights here and in the other automaton, where both have them; walked word by word, all paths at once."""
        root = len(self.first) - 2
        states, path = np.array([root]) if root >= 0 else np.zeros(0, np.int64), np.full((3, 1 if root >= 0 else 0), -1)
        there, theirs = states, None
        if other is not None:
            known = {word: i for i, word in enumerate(other.words)}
            theirs = np.array([known.get(word, -1) for word in self.words], np.int64)
            there = np.full(len(states), len(other.first) - 2)
            of = np.repeat(np.arange(len(other.first) - 1), np.diff(other.first))
            keys = of << 32 | other.word
        found = []
        for depth in range(3):
            arcs, sizes = self._arcs(states)
            path = np.repeat(path, sizes, axis=1)
            path[depth] = self.word[arcs]
            weight = self.weight[arcs]
            if other is not None:
                key = np.repeat(there, sizes) << 32 | theirs[self.word[arcs]]
                match = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
                same = (keys[match] == key) & (theirs[self.word[arcs]] >= 0) & (np.repeat(there, sizes) >= 0) if len(keys) else np.zeros(len(arcs), bool)
                arcs, path, weight, match = arcs[same], path[:, same], weight[same], match[same]
                both = (weight > 0) & (other.weight[match] > 0)
                found.append((path[:, both], weight[both], other.weight[match][both]))
                there = other.next[match]
            else:
                both = weight > 0
                found.append((path[:, both], weight[both], weight[both]))
            on = (self.next[arcs] >= 0) & ((there >= 0) if other is not None else True)
            states, path, there = self.next[arcs][on], path[:, on], there[on] if other is not None else there
        path, weight, other_weight = (np.concatenate([x[k] for x in found], axis=-1) for k in range(3))
        order = np.lexsort(path[::-1])
        return path[:, order], weight[order], other_weight[order]

    def strings(self) -> Strings:
        path, weights, _ = self._paths()
        return Strings(self.words, path, weights)

    def compose(self, other: Automaton) -> tuple[Strings, np.ndarray]:
        """The strings of this automaton that the other has too, and their weights there."""
        path, weights, theirs = self._paths(other)
        return Strings(self.words, path, weights), theirs

    def dump(self) -> bytes:
        kinds = [np.min_scalar_type(int(x.max(initial=0))) for x in (self.first, self.word, self.weight)]
        parts = [b" ".join(self.words), *(x.astype(kind).tobytes() for x, kind in zip((self.first, self.word, self.weight), kinds)), self.next.astype(np.int32).tobytes()]
        return struct.pack("<8Q", *(len(part) for part in parts), *(kind.itemsize for kind in kinds)) + b"".join(parts)

    @staticmethod
    def load(data: bytes) -> Automaton:
        head = struct.unpack_from("<8Q", data)
        at, parts = 64, []
        for size in head[:5]:
            parts.append(data[at : at + size])
            at += size
        numbers = [np.frombuffer(part, f"<u{size}").astype(np.int64) for part, size in zip(parts[1:4], head[5:])]
        return Automaton(parts[0].split(b" ") if parts[0] else [], *numbers, np.frombuffer(parts[4], "<i4").astype(np.int64))


@dataclass
class Builder:
    """Takes sorted strings block by block. States below a first word are closed when a later first word comes; equal states are one."""

    words: list[bytes]
    known: dict[bytes, int] = field(default_factory=dict)
    sizes: list[np.ndarray] = field(default_factory=list)
    arcs: list[np.ndarray] = field(default_factory=list)
    states: int = 0
    root: list[np.ndarray] = field(default_factory=list)
    open: Strings | None = None

    def add(self, some: Strings) -> None:
        if self.open is not None:
            some = Strings(self.words, np.concatenate([self.open.at, some.at], axis=1), np.concatenate([self.open.weights, some.weights]))
        done = int(np.searchsorted(some.at[0], some.at[0, -1], "left")) if len(some) else 0
        self._close(some.cut(0, done))
        self.open = some.cut(done, len(some))

    def finish(self) -> Automaton:
        if self.open is not None:
            self._close(self.open)
        root = np.concatenate([np.zeros((0, 3), np.int64), *self.root])
        arcs = np.concatenate([np.zeros((0, 3), np.int64), *self.arcs, root])
        sizes = np.concatenate([np.zeros(0, np.int64), *self.sizes, [len(root)]])
        return Automaton(self.words, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), arcs[:, 0], arcs[:, 1], arcs[:, 2])

    def _close(self, some: Strings) -> None:
        if not len(some):
            return
        state = np.full(len(some), -1)  # of the longest prefix that begins with this string, under its own depth
        for depth in (2, 1):
            # Arcs of the states that lie behind `depth` words: one for each different prefix of depth + 1 words.
            arc = np.flatnonzero(some.begins(depth + 1) & (some.at[depth] >= 0))
            rows = self._rows(some, arc, depth, state)
            prefix = np.flatnonzero(some.begins(depth))
            of = np.searchsorted(prefix, arc, "right") - 1
            held = np.bincount(of, minlength=len(prefix))
            state = np.full(len(some), -1)
            state[prefix[held > 0]] = self._states(rows, held[held > 0])
        arc = np.flatnonzero(some.begins(1))
        self.root.append(self._rows(some, arc, 0, state))

    @staticmethod
    def _rows(some: Strings, arc: np.ndarray, depth: int, state: np.ndarray) -> np.ndarray:
        ends = (some.at[depth + 1, arc] < 0) if depth < 2 else np.ones(len(arc), bool)
        return np.stack([some.at[depth, arc], np.where(ends, some.weights[arc], 0), state[arc] if depth < 2 else np.full(len(arc), -1)], axis=1).astype(np.int64)

    def _states(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The states that have these arcs; new ones only for arcs that no state has yet."""
        data, ends = rows.tobytes(), (np.cumsum(sizes) * 24).tolist()
        found, known, made, start, n = [], self.known, [], 0, self.states
        for k, end in enumerate(ends):
            key = data[start:end]
            state = known.get(key)
            if state is None:
                state = known[key] = n
                n += 1
                made.append(k)
            found.append(state)
            start = end
        self.states = n
        at = np.cumsum(sizes) - sizes
        self.arcs.append(rows[_ranges(at[made], sizes[made])])
        self.sizes.append(sizes[made])
        return np.array(found, np.int64)


def build(some: Strings) -> Automaton:
    """The automaton of sorted strings; words that no string has are left out."""
    used = np.unique(some.at)
    used = used[used >= 0]
    new = np.full(len(some.words) + 1, -1)
    new[used] = np.arange(len(used))  # the last entry is for -1
    some = Strings([some.words[i] for i in used.tolist()], new[some.at], some.weights)
    builder = Builder(some.words)
    for begin in range(0, len(some), CLOSED):
        builder.add(some.cut(begin, begin + CLOSED))
    return builder.finish()


def united(many: list[Strings]) -> Strings:
    """All strings, weights of equal ones summed."""
    words = sorted({word for some in many for word in some.words})
    rank = {word: i for i, word in enumerate(words)}
    moved = [np.append(np.array([rank[word] for word in some.words], np.int64), -1)[some.at] for some in many]
    return sorted_sum(words, np.concatenate([np.zeros((3, 0), np.int64), *moved], axis=1), np.concatenate([np.zeros(0, np.int64), *(some.weights for some in many)]))


# -- shards ------------------------------------------------------------------------------------


class _Numbers(dict):
    """Word -> number in the order of coming."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


_SKIP, _END = 0, 1


class Shards:
    """Word windows of texts, by language, given out as sorted strings once SHARD words are held."""

    def __init__(self) -> None:
        self._clear({})

    def _clear(self, held: dict[str, list[bytes]]) -> None:
        self.numbers = _Numbers({b"": _SKIP, b"\n": _END})
        self.held = {lang: [np.array([self.numbers[word] for word in words], np.int64)] for lang, words in held.items()}
        self.n = sum(map(len, held.values()))

    def add(self, lang: str, texts: list[str]) -> Iterator[tuple[str, Strings]]:
        data = b"\n".join(text.encode() for text in texts).translate(_TABLE) + b"\n"
        at = 0
        while at < len(data):
            end = data.find(b" ", at + SLICE)
            end = len(data) if end < 0 else end
            tokens = data[at:end].replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(self.numbers.__getitem__, tokens), np.int64, len(tokens))
            ids = ids[ids != _SKIP]
            self.held.setdefault(lang, []).append(ids)
            self.n += len(ids)
            at = end
            if self.n >= SHARD - SLICE // 2:
                yield from self.flush(end=False)

    def flush(self, end: bool = True) -> Iterator[tuple[str, Strings]]:
        """Windows of what is held; unless the texts are at their end, the last two words of an open piece wait for what follows."""
        words, number = zip(*sorted(self.numbers.items())) if self.numbers else ((), ())
        rank = np.empty(len(words), np.int64)
        rank[list(number)] = np.arange(len(words))
        rank[_END] = -1
        waiting: dict[str, list[bytes]] = {}
        told = []
        for lang, parts in self.held.items():
            ids = np.concatenate(parts)
            stop = len(ids)
            if not end and len(ids) and ids[-1] != _END:
                stop = max(0, len(ids) - 2)
                waiting[lang] = [words[i] for i in rank[ids[stop:]].tolist()] if (ids[stop:] != _END).all() else [words[rank[ids[-1]]]]
                stop = len(ids) - len(waiting[lang])
            at = np.concatenate([rank[ids], [-1, -1]])
            begin = np.flatnonzero(at[:stop] >= 0)
            second = at[begin + 1]
            third = np.where(second >= 0, at[begin + 2], -1)
            told.append((lang, sorted_sum(list(words), np.stack([at[begin], second, third]), np.ones(len(begin), np.int64))))
        self._clear(waiting)
        yield from told


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Strings]]:
    """Shards of batches of (lang, text)."""
    shards = Shards()
    for batch in batches:
        waiting: dict[str, list[str]] = {}
        held = 0
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            value = text.as_py()
            if value:
                waiting.setdefault(UNDETERMINED if lang is None else lang, []).append(value)
                held += len(value)
            if held >= SLICE:
                for k, texts in waiting.items():
                    yield from shards.add(k, texts)
                waiting, held = {}, 0
        for k, texts in waiting.items():
            yield from shards.add(k, texts)
    yield from shards.flush()


Border = tuple[bytes, bytes, bytes, bytes]


def _fragments(lang: str, some: Strings, borders: list[Border]) -> Iterator[tuple[int, Strings]]:
    """(range, its strings) of a language's sorted strings."""
    key = lang.encode()
    low, high = bisect_left(borders, (key,)), bisect_left(borders, (key + b"\0",))
    cuts = [0, *(some.place(*border[1:]) for border in borders[low:high]), len(some)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            yield low + i, some.cut(a, b)


def _home(borders: list[Border], lang: bytes, words: tuple[bytes, ...]) -> int:
    """The range that holds a string."""
    return bisect_right(borders, (lang, *words, *[b""] * (3 - len(words))))


# -- plans -------------------------------------------------------------------------------------


def _borders(docs: DataFrame) -> list[Border]:
    """Borders of the ranges: quantiles of a sample of windows, which is as large as the ranges are many."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = min(MOST_RANGES, -(-size // RANGE))
    if n < 2:
        return []
    # About one window for each six bytes; whole documents are chosen, then one of their windows in `step`.
    wanted = n * SAMPLED
    step = 64
    share = min(1.0, 6 * wanted * step / size)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, some in _windows(batches):
            order = np.repeat(np.arange(len(some)), some.weights)[::step]
            rows = [" ".join(some.words[i].decode(errors="surrogateescape") for i in row if i >= 0) for row in some.at[:, order].T.tolist()]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(rows), "phrase": rows})

    rows = docs.sample(share, seed=1).mapInArrow(sample, "lang string, phrase string").collect()
    found = sorted((r["lang"].encode(), *(words := r["phrase"].encode().split(b" ")), *[b""] * (3 - len(words))) for r in rows)
    return sorted({found[i * len(found) // n] for i in range(1, n)} - {()}) if found else []


_RANGED = "lang string, home int, automaton binary, phrase string, f long, total long"


def _counted(lang: str, home: int, some: Strings, borders: list[Border], least: int) -> Iterator[tuple]:
    """Of a range: the automaton of its phrases that occur often, and the counts of those that a border cuts."""
    key = lang.encode()
    cut = {prefix for border in (*borders[home - 1 : home], *borders[home : home + 1]) if border[0] == key for prefix in (border[1:2], border[1:3]) if all(prefix)} if home else {prefix for border in borders[:1] if border[0] == key for prefix in (border[1:2], border[1:3]) if all(prefix)}
    total = int(some.weights.sum())
    at, weights = [], []
    for depth in (1, 2, 3):
        begin = np.flatnonzero(some.begins(depth))
        f = np.add.reduceat(some.weights, begin)
        prefix = some.at[:, begin].copy()
        prefix[depth:] = -1
        whole = prefix[depth - 1] >= 0
        prefix, f = prefix[:, whole], f[whole]
        if depth < 3:
            for words in (p for p in cut if len(p) == depth):
                ranks = [bisect_left(some.words, w) for w in words]
                same = np.ones(len(f), bool)
                for d, (rank, word) in enumerate(zip(ranks, words)):
                    same &= (prefix[d] == rank) if rank < len(some.words) and some.words[rank] == word else False
                for i in np.flatnonzero(same).tolist():
                    yield lang, _home(borders, key, words), None, b" ".join(words).decode(), int(f[i]), 0
                prefix, f = prefix[:, ~same], f[~same]
        often = f >= least
        at.append(prefix[:, often])
        weights.append(f[often])
    yield lang, home, build(sorted_sum(some.words, np.concatenate(at, axis=1), np.concatenate(weights))).dump(), None, None, total


def _ranged(docs: DataFrame, borders: list[Border], least: int) -> DataFrame:
    """One row a range with the automaton of its frequent phrases, and rows of phrases that borders cut."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, some in _windows(batches):
            for home, part in _fragments(lang, some, borders):
                yield pa.RecordBatch.from_pydict({"lang": [lang], "home": pa.array([home], pa.int32()), "shard": [build(part).dump()]})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "home", "automaton", "phrase", "f", "total"]
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int64()]

        def told(key, many: list[Strings]) -> pa.RecordBatch:
            rows = list(_counted(*key, united(many), borders, least))
            return pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)], names)

        current, many, held = None, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                key = (batch.column("lang")[i].as_py(), batch.column("home")[i].as_py())
                if key != current:
                    if many:
                        yield told(current, many)
                    current, many, held = key, [], 0
                many.append(Automaton.load(batch.column("shard")[i].as_py()).strings())
                held += len(many[-1])
                if held >= WAITING and len(many) > 1:
                    many = [united(many)]
                    # What is already one waits until as much has come again, so that the work stays in proportion.
                    held = 0
        if many:
            yield told(current, many)

    parts = docs.mapInArrow(shards, "lang string, home int, shard binary").repartition(2 * len(borders) + 2, "lang", "home").sortWithinPartitions("lang", "home")
    return materialise(parts.mapInArrow(merged, _RANGED), "ranges")


def _gathered(table: pa.Table) -> Strings:
    """The frequent phrases of a range: those of its automata, and those that borders cut."""
    many = [Automaton.load(data).strings() for data in table.column("automaton").to_pylist() if data is not None]
    for phrase, f in zip(table.column("phrase").to_pylist(), table.column("f").to_pylist()):
        if phrase is not None:
            words = phrase.encode().split(b" ")
            order = sorted(set(words))
            many.append(Strings(order, np.array([[order.index(w)] for w in words] + [[-1]] * (3 - len(words))), np.array([f])))
    return united(many)


@dataclass
class Parts:
    """What the phrases of a range ask for: their parts, each once and in order, with the count of the longest phrase that asks."""

    some: Strings

    def __post_init__(self) -> None:
        a, w = self.some.at, self.some.weights
        two, three = np.flatnonzero((a[1] >= 0) & (a[2] < 0)), np.flatnonzero(a[2] >= 0)
        none = lambda n: np.full(n, -1)
        one = lambda row, of: np.stack([a[row, of], none(len(of)), none(len(of))])
        pair = lambda row, of: np.stack([a[row, of], a[row + 1, of], none(len(of))])
        self.two, self.three = two, three
        asked = [one(0, two), one(1, two), one(0, three), pair(1, three), pair(0, three), one(2, three)]
        around = [0 * w[two], 0 * w[two], 0 * w[three], w[three], w[three], 0 * w[three]]
        at = np.concatenate(asked, axis=1)
        key = (at[0] + 1) << 32 | (at[1] + 1)
        different, self.place = np.unique(key, return_inverse=True)
        longest = np.zeros(len(different), np.int64)
        np.maximum.at(longest, self.place, np.concatenate(around))
        # A weight of one stands for no longer phrase, so that each part is a string of the automaton.
        self.parts = Strings(self.some.words, np.stack([(different >> 32) - 1, (different & (1 << 32) - 1) - 1, none(len(different))]), longest + 1)

    def scores(self, f: np.ndarray) -> tuple[np.ndarray, list[int], list[int], list[int], list[int]]:
        """Of each phrase of two or three words: its place, count, the counts of its parts at the cut that scores least, and that score."""
        f = f[self.place].tolist()
        m, n = len(self.two), len(self.three)
        w = self.some.weights.tolist()
        told = []
        for i, place in enumerate(self.two.tolist()):
            a, left, right = w[place], f[i], f[m + i]
            told.append((place, a, left, right, 1_000_000 * a * a // (left * right)))
        base = 2 * m
        for i, place in enumerate(self.three.tolist()):
            a = w[place]
            first, last = (f[base + i], f[base + n + i]), (f[base + 2 * n + i], f[base + 3 * n + i])
            s, t = (1_000_000 * a * a // (x * y) for x, y in (first, last))
            told.append((place, a, *(first if s <= t else last), min(s, t)))
        return told


def collocations(docs: DataFrame, least: int = 10, keep: int = 2000, share: int = 50, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `keep` best phrases of each language.

    a, l and r count a phrase and its parts at the cut that scores least, n all words of the language; the score is floor(10^6 a^2 / (l r)).
    Phrases that occur less than `least` times are none; one that lies in a longer phrase with at least `share` hundredths of its count goes.
    """
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNDETERMINED)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    borders = _borders(docs)
    rows = _ranged(docs, borders, least)
    whole = rows.filter("automaton is not null").select("lang", "home", "automaton", F.lit(None).cast("string").alias("phrase"), F.lit(None).cast("long").alias("f"))
    cut = rows.filter("phrase is not null").groupBy("lang", "home", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    frequent = whole.unionByName(cut.select("lang", "home", F.lit(None).cast("binary").alias("automaton"), "phrase", "f"))
    totals = rows.groupBy("lang").agg(F.sum("total").alias("n"))

    def asks(table: pa.Table) -> pa.Table:
        name, source = table.column("lang")[0].as_py(), table.column("home")[0].as_py()
        fragments = list(_fragments(name, Parts(_gathered(table)).parts, borders))
        return pa.table({"lang": pa.array([name] * len(fragments), pa.string()), "home": pa.array([home for home, _ in fragments], pa.int32()), "source": pa.array([source] * len(fragments), pa.int32()), "asked": pa.array([build(part).dump() for _, part in fragments], pa.binary())})

    asked = frequent.groupBy("lang", "home").applyInArrow(asks, "lang string, home int, source int, asked binary")
    asked = asked.select(F.col("lang").alias("lang2"), F.col("home").alias("home2"), "source", "asked")

    def answers(table: pa.Table, questions: pa.Table) -> pa.Table:
        some = _gathered(table)
        counts, longest, told = build(some), np.zeros(len(some), np.int64), []
        for data in questions.column("asked").to_pylist():
            found, f = Automaton.load(data).compose(counts)
            told.append(f)
            for place, around in zip((some.place(*(found.words[i] for i in row if i >= 0)) for row in found.at.T.tolist()), (found.weights - 1).tolist()):
                longest[place] = max(longest[place], around)
        name = (table if table.num_rows else questions).column(0)[0].as_py()
        home = (table if table.num_rows else questions).column(1)[0].as_py()
        sources = questions.column("source").to_pylist()
        n = len(sources)
        return pa.table({"to_lang": pa.array([name] * (n + 1), pa.string()), "to_home": pa.array([*sources, home], pa.int32()), "answer_of": pa.array([home] * n + [-1], pa.int32()), "values": pa.array([*told, longest], pa.list_(pa.int64()))})

    answered = frequent.groupBy("lang", "home").cogroup(asked.groupBy("lang2", "home2")).applyInArrow(answers, "to_lang string, to_home int, answer_of int, values array<long>")

    def scored(table: pa.Table, replies: pa.Table) -> pa.Table:
        some = _gathered(table)
        parts = Parts(some)
        by = dict(zip(replies.column("answer_of").to_pylist(), replies.column("values")))
        longest = np.array(by.pop(-1).as_py(), np.int64)
        f = np.concatenate([np.zeros(0, np.int64), *(np.array(by[home].as_py(), np.int64) for home in sorted(by))])
        assert len(f) == len(parts.parts), "a part of a phrase was not counted"
        kept = [x for x in parts.scores(f) if 100 * int(longest[x[0]]) < share * x[1]]
        written = [(b" ".join(some.words[i] for i in some.at[:, x[0]].tolist() if i >= 0), *x[1:]) for x in kept]
        best = sorted(written, key=lambda x: (-x[4], -x[1], x[0]))[:keep]
        name = table.column("lang")[0].as_py() if table.num_rows else None
        return pa.table({"lang": pa.array([name] * len(best), pa.string()), "phrase": pa.array([x[0].decode() for x in best], pa.string()), **{k: pa.array([x[i] for x in best], pa.int64()) for i, k in enumerate(("a", "l", "r", "score"), 1)}})

    best = frequent.groupBy("lang", "home").cogroup(answered.groupBy("to_lang", "to_home")).applyInArrow(scored, "lang string, phrase string, a long, l long, r long, score long")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= keep)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= keep)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11(docs: DataFrame) -> DataFrame:
    return collocations(docs.select("lang", "text"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, words FROM (
    SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda w: w <> '') AS words
    FROM documents) WHERE len(words) > 0),
grams AS (
  SELECT lang, size, words[i : i + size - 1] AS gram FROM pieces, (VALUES (1), (2), (3)) AS s(size), unnest(range(1, len(words) - size + 2)) AS r(i)),
counted AS (SELECT lang, size, array_to_string(gram, ' ') AS phrase, gram, count(*) AS f FROM grams GROUP BY lang, size, gram),
total AS (SELECT lang, sum(f) AS n FROM counted WHERE size = 1 GROUP BY lang),
cuts AS (
  SELECT c.lang, c.phrase, c.gram, c.f AS a, k, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * c.f * c.f) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM counted c, unnest(range(1, c.size)) AS u(k)
  JOIN counted x ON x.lang = c.lang AND x.gram = c.gram[1 : k] JOIN counted y ON y.lang = c.lang AND y.gram = c.gram[k + 1 : c.size]
  WHERE c.size > 1 AND c.f >= 10),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, part, max(f) AS around FROM (SELECT lang, f, unnest([gram[1 : 2], gram[2 : 3]]) AS part FROM counted WHERE size = 3 AND f >= 10) GROUP BY lang, part)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM scored s JOIN total t ON t.lang = s.lang LEFT JOIN longer g ON g.lang = s.lang AND g.part = s.gram
WHERE 100 * coalesce(around, 0) < 50 * a QUALIFY rank <= 2000
"""
