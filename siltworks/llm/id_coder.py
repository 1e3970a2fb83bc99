"""Adaptive context mixing and range coding of one block of token ids.

A block is cut into lanes of ``COLUMNS`` consecutive ids that are coded in step,
one numpy element per lane; all lanes share one model, which starts empty and
learns from each column before the next one is coded:

* order 0: counts of all ids, as one cumulative distribution over every id up
  to the largest of the block, so no id is without width;
* order 1: the two ids that lead among those that followed the last id, and how
  steadily the first of them led;
* order 2: the id that last followed the last two, found by a hash of them, and
  for how many turns in a row.

The mix: P(id) is the sum of the shares of all orders that predict it. What
share each order gets is learned too, as counts of which of them was right, for
every combination of their two confidences and of whether they agree. One
arithmetic-coding step codes an id, by a range coder of 63 bits a lane that
gives out 32 at a time.

Defined cases: no ids give an empty block; ids may be any below ``MOST`` (a
million, above any public vocabulary), a larger one is an error.
"""

from __future__ import annotations

import numpy as np

COLUMNS, LANES = 250, 8200
#: Ids in a block, at most.
BLOCK = COLUMNS * LANES
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
#: Entries of the order-2 table, and the number of confidences of orders 1 and 2.
SLOT_BITS, STEADY = 18, 8
NOBODY = ID_MASK
#: Ids are below this: their number's bits and SPARE must leave a range of 31 bits some width.
MOST = 1 << 20
#: The order-0 share is one in 2 ** SPARE at least.
SPARE = 6
STATES = STEADY * STEADY * 3
TOP = np.int64((1 << 63) - 1)
LOW_RANGE = np.int64(1 << 31)


class Model:
    """What a block has taught so far; the same steps on both sides of the file."""

    def __init__(self, lanes: int, size: int) -> None:
        self.size = size
        self.bits = max(20, size.bit_length() + 1)
        self.scale = self.bits + SPARE
        self.counts = np.zeros(size, np.int64)
        self.pending: list[np.ndarray] = []
        self.seen, self.due = 0, 0
        self.after = np.full(size, NOBODY | NOBODY << ID_BITS, np.int64)
        self.slots = np.full(1 << SLOT_BITS, NOBODY, np.int64)
        self.right = np.tile(np.array([0.2, 0.1, 0.1, 1.0]), (STATES, 1))
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.column = 0
        self._spread()

    def _spread(self) -> None:
        """The cumulative order-0 distribution, every id with a width of one at least."""
        for ids in self.pending:
            self.counts += np.bincount(ids, minlength=self.size)
        self.pending = []
        total = int(self.counts.sum())
        room = (1 << self.bits) - self.size
        ends = np.zeros(self.size + 1, np.int64)
        np.cumsum(self.counts, out=ends[1:])
        if total:
            # a float quotient is the same on both sides, as the operations are
            ends = (ends * (room / total)).astype(np.int64)
        self.ends = ends + np.arange(self.size + 1)
        self.ends[-1] = 1 << self.bits

    def _shares(self) -> None:
        """For each state, where the parts of order 2, the two of order 1 and order 0 begin, and how wide the first three are."""
        free = (1 << self.scale) - (1 << self.bits) - 4
        sums = np.cumsum(self.right, axis=1)
        ends = (sums[:, :3] / sums[:, 3:] * free).astype(np.int64) + np.arange(1, 4)
        ends[1::3, 0] = ends[1::3, 1]  # orders 1 and 2 agree: the id owns both parts
        begins = np.concatenate([np.zeros((STATES, 1), np.int64), ends], axis=1)
        widths = np.diff(begins, axis=1, append=begins[:, 3:])
        self.begins, self.widths = begins.reshape(-1), widths.reshape(-1)
        self.end2, self.end1, self.begin0 = (np.ascontiguousarray(ends[:, i]) for i in range(3))

    def predict(self) -> None:
        if self.pending and self.seen >= self.due:
            self._spread()
            self.due = self.seen + (self.seen >> 2)
        one = self.after.take(self.last)
        self.first, self.second, self.steady1 = one & ID_MASK, one >> ID_BITS & ID_MASK, one >> 2 * ID_BITS
        self.slot = (self.last * 0x9E3779B1 + self.before * 0x85EBCA6B) >> 7 & (1 << SLOT_BITS) - 1
        two = self.slots.take(self.slot)
        self.guess, self.steady2 = two & ID_MASK, two >> ID_BITS
        same = (self.guess == self.second).view(np.int8)
        agree = (self.guess == self.first).view(np.int8) + (same + same)
        # the steady counts come in steps of 3 and of 3 * STEADY
        self.state = self.steady2 + self.steady1 + agree
        if self.column < 32 or not self.column & 15:
            self._shares()
        self.width0 = (1 << self.scale) - self.begin0.take(self.state)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, width) of the ids."""
        kind = np.where(ids == self.guess, 0, np.where(ids == self.first, 1, np.where(ids == self.second, 2, 3)))
        self.part = self.state * 4 + kind
        self.by2, by0 = kind == 0, kind == 3
        low = self.width0 * self.ends.take(ids) >> self.bits
        high = self.width0 * self.ends.take(ids + 1) >> self.bits
        return self.begins.take(self.part) + low * by0, self.widths.take(self.part) + (high - low) * by0

    def find(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, width) of the intervals in which ``at`` lies."""
        begin0 = (1 << self.scale) - self.width0
        ids = np.where(at < self.end2.take(self.state), self.guess, np.where(at < self.end1.take(self.state), self.first, self.second))
        rest = np.flatnonzero(at >= begin0)
        if len(rest):
            width = self.width0.take(rest)
            # the largest place whose start is not beyond: ((x + 1) * 2 ** bits - 1) // width
            place = (((at - begin0).take(rest) + 1 << self.bits) - 1) // width
            order = np.argsort(place)
            found = np.empty(len(rest), np.int64)
            found[order] = np.searchsorted(self.ends, place[order], side="right") - 1
            ids[rest] = found
        return ids, *self.interval(ids)

    def update(self, ids: np.ndarray) -> None:
        self.right += np.bincount(self.part, minlength=STATES * 4).reshape(STATES, 4)
        hit = ids == self.first
        swap = (ids == self.second) & (self.steady1 == 0)
        first = np.where(swap, ids, self.first)
        second = np.where(hit, self.second, np.where(swap, self.first, ids))
        steady = np.where(hit, np.minimum(self.steady1 + 3, 3 * (STEADY - 1)), np.maximum(self.steady1 - 3, 0))
        self.after[self.last] = first | second << ID_BITS | steady << 2 * ID_BITS
        self.slots[self.slot] = ids | np.minimum(self.steady2 + 3 * STEADY, 3 * STEADY * (STEADY - 1)) * self.by2 << ID_BITS
        self.before, self.last = self.last, ids
        self.pending.append(ids)
        self.seen += len(ids)
        self.column += 1


def shape(n: int) -> tuple[int, int]:
    """(lanes, columns) of a block of n ids."""
    columns = min(COLUMNS, max(1, n))
    return -(-n // columns), columns


def compress(ids: np.ndarray) -> bytes:
    """At most BLOCK ids as bytes: the words of each lane, by lane, after their counts."""
    lanes, columns = shape(len(ids))
    block = np.zeros((lanes, columns), np.int64)
    block.reshape(-1)[: len(ids)] = ids
    size = int(block.max()) + 1 if lanes else 1
    if size > MOST:
        raise ValueError(f"ids must be below {MOST}")
    model = Model(lanes, size)
    span = columns + 3
    out = np.zeros((lanes, span), np.int64)
    flat, base = out.reshape(-1), np.arange(lanes) * span
    low, width = np.zeros(lanes, np.int64), np.full(lanes, TOP)
    at = base + 1  # the first word only takes a carry
    for ids in np.ascontiguousarray(block.T):
        model.predict()
        begin, wide = model.interval(ids)
        width >>= model.scale
        low = low + width * begin
        width *= wide
        if low.min(initial=0) < 0:  # bit 63 is the carry
            over = np.flatnonzero(low < 0)
            flat[at.take(over) - 1] += 1
            low[over] &= TOP
        small = np.flatnonzero(width < LOW_RANGE)
        if len(small):
            some, places = low.take(small), at.take(small)
            flat[places] = some >> 31
            at[small] = places + 1
            low[small] = (some & LOW_RANGE - 1) << 32
            width[small] <<= 32
        model.update(ids)
    # the lane's value with zeros in its last 31 bits: its width is 2 ** 31 at least
    last = (low.view(np.uint64) + np.uint64(LOW_RANGE - 1)) >> np.uint64(31)
    flat[at] = last.astype(np.int64)
    at += 1
    ends = at - base
    for j in range(int(ends.max(initial=1)) - 1, 0, -1):
        carry = out[:, j] >> 32
        out[:, j] &= 0xFFFFFFFF
        out[:, j - 1] += carry
    held = np.arange(span)[None, :] < ends[:, None]
    held[:, 0] = False
    head = np.array([len(block.reshape(-1)) if lanes else 0, size], "<u4").tobytes()
    return head + (ends - 1).astype("<u2").tobytes() + out[held].astype("<u4").tobytes()


def expand(data: bytes, n: int) -> np.ndarray:
    """The n ids that compress() was given."""
    lanes, columns = shape(n)
    size = int(np.frombuffer(data, "<u4", 2)[1])
    if size > MOST:
        raise ValueError("not a block")
    counts = np.frombuffer(data, "<u2", lanes, 8).astype(np.int64)
    # zeros follow the last word of the last lane; beyond its own end a lane reads what no id depends on
    words = np.concatenate([np.frombuffer(data, "<u4", offset=8 + 2 * lanes).astype(np.int64), np.zeros(2, np.int64)])
    ends = np.cumsum(counts)
    at = ends - counts

    def word(places: np.ndarray, limit: np.ndarray) -> np.ndarray:
        return np.where(places < limit, words.take(places, mode="clip"), 0)

    model = Model(lanes, size)
    code = word(at, ends) << 31 | word(at + 1, ends) >> 1
    spare = word(at + 1, ends) & 1  # of each word one bit waits for the next
    at += 2
    width = np.full(lanes, TOP)
    out = np.empty((columns, lanes), np.int64)
    for i in range(columns):
        model.predict()
        width >>= model.scale
        seen = np.minimum(code // width, (1 << model.scale) - 1)
        ids, begin, wide = model.find(seen)
        code -= width * begin
        width *= wide
        small = np.flatnonzero(width < LOW_RANGE)
        if len(small):
            places = at.take(small)
            got = word(places, ends.take(small))
            code[small] = code.take(small) << 32 | spare.take(small) << 31 | got >> 1
            spare[small] = got & 1
            at[small] = places + 1
            width[small] <<= 32
        out[i] = ids
        model.update(ids)
    return out.T.reshape(-1)[:n]
