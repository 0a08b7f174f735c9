"""An adaptive context-mixing range coder for token ids: many blocks at once, a block in each lane of NumPy arrays.

Each block starts from the same state and can be read alone. A block numbers its ids in the order of their first use; order 0
counts every one of them, and what it has not seen yet ("novel") is a symbol of its own. Orders 1 and 2 each remember
the id that last followed the last one and the last two. Logistic mixing of order 2, order 1 and order 0 gives the probability
of the order-2 prediction, mixing of orders 1 and 0 that of another order-1 prediction; all else is coded by the counts of
order 0. A novel id is a half-octave of magnitude, coded by adaptive counts, and its lower bits as they are. All arithmetic is in
integers, so any machine reads what any other wrote.
"""

from __future__ import annotations

import math

import numpy as np

#: Ids of a block at most.
BLOCK = 2048
#: The code space is 2**SPACE; order 0 keeps 2**LEAST of it at least, and a block's counts sum up to less than that; a prediction keeps SOME.
SPACE, LEAST, SOME = 22, 15, 64
#: Largest id, and classes of magnitude: two for each power of two.
MOST_ID, SLOTS = (1 << 32) - 1, 64
#: Weights start from these in units of 2**-16: order 2, 1 and 0 for the first prediction, 1 and 0 for the second.
FIRST_WEIGHTS, SECOND_WEIGHTS = (40000, 16000, 12000), (44000, 16000)
#: Predictions are sure to a degree of 0 to 7; a step of learning is 2**-RATE, that of weights 2**-PACE of input times error.
SURE, RATE, PACE = 7, 5, 11
_TOP, _LOW = 1 << 48, 1 << 32
#: Logistic function and its inverse on 12 bits, in steps of 1/256.
_SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-(x - 2047) / 256))))) for x in range(4095)], np.int64)
_STRETCH = np.clip(np.searchsorted(_SQUASH, np.arange(4096)), 0, 4094) - 2047
#: Row k has k ones, then zeros.
_BEFORE = np.tril(np.ones((16, 16), np.int32), -1)


def slot_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, number of lower bits) of ids under 2**32: the place of the highest bit and the bit after it."""
    bits = np.maximum(np.frexp(ids.astype(np.float64))[1].astype(np.int64) - 1, 0)
    lower = np.maximum(bits - 1, 0)
    return np.where(bits > 0, 2 * bits + (ids >> lower & 1), ids), lower


class Counts:
    """Counts of up to `most` symbols from 0 on in each lane, as a tree in which 16 children have their sum in a parent."""

    def __init__(self, lanes: int, most: int):
        self.levels, size = [], max(16, most)
        while True:
            size = -(-size // 16)
            self.levels.append((np.zeros((lanes * size, 16), np.int32), np.arange(lanes, dtype=np.int64) * size))
            if size == 1:
                break

    def below(self, m: int, symbol: np.ndarray) -> np.ndarray:
        """How much the symbols before each lane's `symbol` count."""
        total = np.zeros(m, np.int64)
        for table, base in self.levels:
            parent = symbol >> 4
            total += np.einsum("ij,ij->i", table[base[:m] + parent], _BEFORE[symbol & 15])
            symbol = parent
        return total

    def of(self, m: int, symbol: np.ndarray) -> np.ndarray:
        table, base = self.levels[0]
        return table.reshape(-1).take((base[:m] << 4) + symbol).astype(np.int64)

    def find(self, m: int, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, what is below it) of the symbol whose counts hold the place `target`."""
        symbol, total, row = np.zeros(m, np.int64), np.zeros(m, np.int64), np.arange(m)
        for table, base in reversed(self.levels):
            children = table[base[:m] + symbol]
            sums = children.cumsum(axis=1)
            # In an empty tree, the first symbol stands for none.
            digit = (sums <= (target - total)[:, None]).sum(axis=1) & 15
            total += sums[row, digit] - children[row, digit]
            symbol = symbol << 4 | digit
        return symbol, total

    def add(self, m: int, symbol: np.ndarray, step: np.ndarray) -> None:
        for table, base in self.levels:
            table.reshape(-1)[(base[:m] << 4) + symbol] += step
            symbol = symbol >> 4


class Lanes:
    """The models of `n` blocks of `longest` ids at most; a step is over the first m lanes, which are those that still go on.

    Symbols are 1, 2, ... in the order of first use; 0 stands for none.
    """

    def __init__(self, n: int, longest: int):
        self.wide, self.hashed = longest + 1, 1 << max(4, (longest - 1).bit_length())
        lane = np.arange(n, dtype=np.int64)
        self.at1, self.at2, self.at8 = lane * self.wide, lane * self.hashed, lane * (SURE + 1)
        self.table1, self.table2 = np.zeros(n * self.wide, np.int32), np.zeros(n * self.hashed, np.int32)
        self.right1 = np.tile(np.linspace(6000, 60000, SURE + 1).astype(np.int64), n)
        self.right2 = np.tile(np.linspace(14000, 63000, SURE + 1).astype(np.int64), n)
        self.first = [np.full(n, w, np.int64) for w in FIRST_WEIGHTS]
        self.second = [np.full(n, w, np.int64) for w in SECOND_WEIGHTS]
        self.counts, self.seen, self.novel = Counts(n, longest), np.zeros(n, np.int64), np.ones(n, np.int64)
        self.slots, self.n_slots = np.full((n, SLOTS), 4, np.int32), np.full(n, 4 * SLOTS, np.int64)
        self.distinct, self.last, self.before = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def predict(self, m: int) -> None:
        """Sets symbols c2 and c1 (0: none), space2 and space1 (their shares) and begin0, share, total for order 0."""
        last, before = self.last[:m], self.before[:m]
        self.key1 = self.at1[:m] + last
        self.key2 = self.at2[:m] + ((last * 40503 + before * 2654435761 >> 7) & self.hashed - 1)
        self.entry1, self.entry2 = self.table1.take(self.key1).astype(np.int64), self.table2.take(self.key2).astype(np.int64)
        self.c1, self.c2 = self.entry1 >> 3, self.entry2 >> 3
        self.state1, self.state2 = self.at8[:m] + (self.entry1 & SURE), self.at8[:m] + (self.entry2 & SURE)
        self.total = self.seen[:m] + self.novel[:m]
        self.r1, self.r2 = self.right1.take(self.state1), self.right2.take(self.state2)
        vote1, vote2 = _STRETCH.take(self.r1 >> 4), _STRETCH.take(self.r2 >> 4)
        zero2, zero1 = (_STRETCH.take(np.minimum((self.counts.of(m, np.maximum(c - 1, 0)) << 12) // self.total, 4095)) for c in (self.c2, self.c1))
        self.known2, same = self.c2 > 0, self.c1 == self.c2
        self.known1 = (self.c1 > 0) & ~same
        self.in2 = [vote2, np.where(same, vote1, np.where(self.c1 > 0, -(vote1 >> 1), 0)), zero2]
        self.in1 = [vote1, zero1]
        self.p2, self.p1 = self._mix(m, self.first, self.in2), self._mix(m, self.second, self.in1)
        # Whatever the probabilities, each prediction has SOME of the space, and order 0 its own.
        free = (1 << SPACE) - (1 << LEAST) - 2 * SOME
        part2 = np.where(self.known2, self.p2 * free >> 12, 0)
        self.space2 = part2 + SOME * self.known2
        self.space1 = np.where(self.known1, (self.p1 * (free - part2) >> 12) + SOME, 0)
        self.begin0 = self.space2 + self.space1
        self.share = (1 << SPACE) - self.begin0

    @staticmethod
    def _mix(m: int, weights: list[np.ndarray], inputs: list[np.ndarray]) -> np.ndarray:
        total = sum(w[:m] * x for w, x in zip(weights, inputs, strict=True)) >> 16
        return _SQUASH.take(np.minimum(np.maximum(total + 2047, 0), 4094))

    def update(self, m: int, symbol: np.ndarray, fresh: np.ndarray) -> None:
        """The lanes' next ids had these symbols; `fresh` ones were novel."""
        hit2, hit1 = self.known2 & (symbol == self.c2), symbol == self.c1
        for table, key, entry, hit in ((self.table1, self.key1, self.entry1, hit1), (self.table2, self.key2, self.entry2, hit2)):
            sure = entry & SURE
            table[key] = np.where(hit, entry + (sure < SURE), np.where(sure > 1, entry - sure + (sure >> 1), symbol << 3 | 1))
        asked1 = self.known1 & ~hit2
        self.right2[self.state2] = self.r2 + np.where(self.known2, ((hit2 * 65535) - self.r2) >> RATE, 0)
        self.right1[self.state1] = self.r1 + np.where(self.c1 > 0, ((hit1 * 65535) - self.r1) >> RATE, 0)
        for weights, inputs, wrong in ((self.first, self.in2, np.where(self.known2, (hit2 << 12) - self.p2, 0)), (self.second, self.in1, np.where(asked1, (hit1 << 12) - self.p1, 0))):
            for w, x in zip(weights, inputs, strict=True):
                w[:m] += x * wrong >> PACE
        step = np.where(fresh, 1, 2)
        self.counts.add(m, symbol - 1, step)
        self.seen[:m] += step
        self.novel[:m] += fresh
        self.distinct[:m] += fresh
        self.before[:m] = self.last[:m]
        self.last[:m] = symbol

    def learn_slots(self, lanes: np.ndarray, slots: np.ndarray) -> None:
        self.slots[lanes, slots] += 24
        self.n_slots[lanes] += 24
        full = lanes[self.n_slots[lanes] > (1 << 13) - 24]
        if len(full):
            self.slots[full] = (self.slots[full] + 1) >> 1
            self.n_slots[full] = self.slots[full].sum(axis=1)


def _pack_bits(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Values of 0 to 31 bits one after the other, highest bit first."""
    if not len(values):
        return b""
    spread = (values[:, None] >> np.arange(30, -1, -1)) & 1
    return np.packbits(spread[np.arange(30, -1, -1) < widths[:, None]].astype(np.uint8)).tobytes()


def symbols_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbol of each id of a block, whether it is the first with that symbol)."""
    values, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(first)] = np.arange(1, len(values) + 1)
    fresh = np.zeros(len(ids), bool)
    fresh[first] = True
    return rank[inverse], fresh


class _Writer:
    """Range coder states of `n` lanes and their 16-bit words."""

    def __init__(self, n: int, longest: int):
        self.low, self.span = np.zeros(n, np.int64), np.full(n, _TOP - 1, np.int64)
        # No id takes more than 22 + 13 bits.
        self.words, self.place = np.zeros((n, 9 * longest // 4 + 8), np.uint32), np.zeros(n, np.int64)

    def put(self, lanes: np.ndarray | slice, start: np.ndarray, width: np.ndarray, unit: np.ndarray) -> None:
        low, span = self.low[lanes] + unit * start, unit * width
        at = np.arange(len(low)) if isinstance(lanes, slice) else lanes
        carry = np.flatnonzero(low >= _TOP)
        if len(carry):
            low[carry] -= _TOP
            self.words[at[carry], self.place[at[carry]] - 1] += 1
        while len(small := np.flatnonzero(span < _LOW)):
            own = at[small]
            self.words[own, self.place[own]] = low[small] >> 32
            self.place[own] += 1
            low[small] = (low[small] & (_LOW - 1)) << 16
            span[small] <<= 16
        self.low[lanes], self.span[lanes] = low, span

    def finish(self) -> list[bytes]:
        rows = np.arange(len(self.low))
        for k in (32, 16, 0):
            self.words[rows, self.place] = self.low >> k & 0xFFFF
            self.place += 1
        for at in range(self.words.shape[1] - 1, 0, -1):
            self.words[:, at - 1] += self.words[:, at] >> 16
        return [(self.words[k, : self.place[k]] & 0xFFFF).astype(">u2").tobytes() for k in rows]


def encode_blocks(blocks: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """(range-coded words, plain bits) of each block of ids; 16-bit words, big-endian."""
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    sizes = np.array([len(blocks[k]) for k in order], np.int64)
    n, longest = len(order), int(sizes[0]) if len(sizes) else 0
    symbols, fresh, slots = np.zeros((longest, n), np.int32), np.zeros((longest, n), bool), np.zeros((longest, n), np.int8)
    plain = [b""] * n
    for lane, k in enumerate(order):
        if sizes[lane]:
            ids = np.asarray(blocks[k], np.int64)
            own, new = symbols_of(ids)
            slot, lower = slot_of(ids)
            symbols[: len(ids), lane], fresh[: len(ids), lane], slots[: len(ids), lane] = own, new, slot
            plain[lane] = _pack_bits((ids & ((1 << lower) - 1))[new], lower[new])
    going = np.searchsorted(-sizes, -np.arange(longest), side="left")
    lanes, coder = Lanes(n, max(1, longest)), _Writer(n, longest)
    for t in range(longest):
        m = int(going[t])
        symbol, new = symbols[t, :m].astype(np.int64), fresh[t, :m]
        lanes.predict(m)
        hit2 = lanes.known2 & (symbol == lanes.c2)
        hit1 = lanes.known1 & (symbol == lanes.c1)
        below = np.where(new, lanes.seen[:m], lanes.counts.below(m, symbol - 1))
        above = below + np.where(new, lanes.novel[:m], lanes.counts.of(m, symbol - 1))
        start0 = below * lanes.share // lanes.total
        width0 = above * lanes.share // lanes.total - start0
        start = np.where(hit2, 0, np.where(hit1, lanes.space2, lanes.begin0 + start0))
        width = np.where(hit2, lanes.space2, np.where(hit1, lanes.space1, width0))
        coder.put(slice(0, m), start, width, coder.span[:m] >> SPACE)
        spelt = np.flatnonzero(new)
        if len(spelt):
            slot = slots[t, spelt].astype(np.int64)
            sums = lanes.slots[spelt].cumsum(axis=1)
            top = sums[np.arange(len(spelt)), slot].astype(np.int64)
            own = lanes.slots[spelt, slot].astype(np.int64)
            coder.put(spelt, top - own, own, coder.span[spelt] // lanes.n_slots[spelt])
            lanes.learn_slots(spelt, slot)
        lanes.update(m, symbol, new)
    out: list[tuple[bytes, bytes]] = [(b"", b"")] * n
    for lane, words in enumerate(coder.finish()):
        out[order[lane]] = (words, plain[lane])
    return out


class _Reader:
    """Range decoder states of lanes over their words."""

    def __init__(self, coded: list[bytes]):
        n = len(coded)
        self.words = np.zeros((n, 1 + max([3, *(len(w) // 2 for w in coded)])), np.int64)
        for k, w in enumerate(coded):
            self.words[k, : len(w) // 2] = np.frombuffer(w, ">u2", len(w) // 2)
        self.code = self.words[:, 0] << 32 | self.words[:, 1] << 16 | self.words[:, 2]
        self.place, self.span = np.full(n, 3, np.int64), np.full(n, _TOP - 1, np.int64)

    def take(self, lanes: np.ndarray | slice, start: np.ndarray, width: np.ndarray, unit: np.ndarray) -> None:
        code, span = self.code[lanes] - unit * start, unit * width
        at = np.arange(len(code)) if isinstance(lanes, slice) else lanes
        # Damaged words can give a width of nothing; checksums tell in the end.
        span = np.maximum(span, 1)
        while len(small := np.flatnonzero(span < _LOW)):
            own = at[small]
            code[small] = (code[small] & (1 << 44) - 1) << 16 | self.words[own, np.minimum(self.place[own], self.words.shape[1] - 1)]
            self.place[own] += 1
            span[small] <<= 16
        self.code[lanes], self.span[lanes] = code, span


def decode_blocks(coded: list[tuple[bytes, bytes]], sizes: list[int]) -> list[np.ndarray]:
    """The ids of blocks that encode_blocks() wrote, whose numbers of ids are `sizes`."""
    order = sorted(range(len(coded)), key=lambda k: -sizes[k])
    lengths = np.array([sizes[k] for k in order], np.int64)
    n, longest = len(order), int(lengths[0]) if len(order) else 0
    going = np.searchsorted(-lengths, -np.arange(longest), side="left")
    reader, lanes = _Reader([coded[k][0] for k in order]), Lanes(n, max(1, longest))
    plain = np.zeros((n, 6 + max([0, *(len(b) for _, b in coded)])), np.int64)
    for lane, k in enumerate(order):
        plain[lane, : len(coded[k][1])] = np.frombuffer(coded[k][1], np.uint8)
    plain_row, plain, bit = np.arange(n, dtype=np.int64) * plain.shape[1], plain.reshape(-1), np.zeros(n, np.int64)
    ids_of, out = np.zeros(n * lanes.wide, np.int64), np.zeros((longest, n), np.uint32)
    for t in range(longest):
        m = int(going[t])
        lanes.predict(m)
        unit = reader.span[:m] >> SPACE
        value = np.clip(reader.code[:m] // unit, 0, (1 << SPACE) - 1)
        hit2 = value < lanes.space2
        hit1 = ~hit2 & (value < lanes.begin0)
        # The place among the counts whose share of the code space holds the value.
        inner = np.maximum(value - lanes.begin0, 0)
        target = ((inner + 1) * lanes.total - 1) // lanes.share
        new = ~(hit2 | hit1) & (target >= lanes.seen[:m])
        found, below = lanes.counts.find(m, np.where(target < lanes.seen[:m], target, 0))
        below = np.where(new, lanes.seen[:m], below)
        above = below + np.where(new, lanes.novel[:m], lanes.counts.of(m, found))
        start0 = below * lanes.share // lanes.total
        width0 = above * lanes.share // lanes.total - start0
        symbol = np.where(hit2, lanes.c2, np.where(hit1, lanes.c1, np.where(new, lanes.distinct[:m] + 1, found + 1)))
        start = np.where(hit2, 0, np.where(hit1, lanes.space2, lanes.begin0 + start0))
        width = np.where(hit2, lanes.space2, np.where(hit1, lanes.space1, width0))
        reader.take(slice(0, m), start, width, unit)
        spelt = np.flatnonzero(new)
        if len(spelt):
            unit = np.maximum(reader.span[spelt] // lanes.n_slots[spelt], 1)
            place = np.minimum(reader.code[spelt] // unit, lanes.n_slots[spelt] - 1)
            sums = lanes.slots[spelt].cumsum(axis=1)
            slot = np.minimum((sums <= place[:, None]).sum(axis=1), SLOTS - 1)
            own = lanes.slots[spelt, slot].astype(np.int64)
            reader.take(spelt, sums[np.arange(len(spelt)), slot] - own, own, unit)
            lanes.learn_slots(spelt, slot)
            lower = np.maximum((slot >> 1) - 1, 0)
            at, window = plain_row[spelt] + (bit[spelt] >> 3), np.zeros(len(spelt), np.int64)
            for k in range(5):
                window = window << 8 | plain.take(at + k, mode="clip")
            rest = (window >> (40 - (bit[spelt] & 7) - lower)) & ((1 << lower) - 1)
            bit[spelt] += lower
            ids_of[lanes.at1[spelt] + symbol[spelt]] = np.where(slot < 2, slot, ((2 | (slot & 1)) << lower) | rest)
        out[t, :m] = ids_of.take(lanes.at1[:m] + symbol)
        lanes.update(m, symbol, new)
    decoded: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    for lane, k in enumerate(order):
        decoded[k] = out[: lengths[lane], lane].astype(np.int64)
    return decoded
