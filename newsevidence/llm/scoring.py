"""Language-model scores by online logistic mixing of hashed-context bit predictors.

Bytes are coded bit by bit. Each predictor is a table of counts of 0 and 1 under a hashed context (the last one to four
bytes, the word so far). Its log odds are mixed by weights that a gate (bit, place in the word, whether the word so far
has been met) selects. Several weight
vectors are refined online over all training texts, each text moving the one that fits it best: every task refines its own
copy, and the copies are averaged by the bits that each has seen. A text's own bytes then decide among
them: the posterior over the vectors is updated with every unit read, which gives the text's total as the sum over
vectors of its probability under each.

Contexts do not reach over the start of a unit (a word with the white space behind it), except for the class of what
stood before. So a unit's code length depends on the unit alone and is computed once per task, and what units begin
with alike is worked out once for those that are worked through together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bucket_count, bucket_of, mix, run_folder, seeded, slices, staged, words_of, _powers

#: Table sizes (powers of two) of the predictors: one to four bytes, word so far. They bound a task's memory.
TABLE_BITS = (16, 18, 18, 18, 20)
#: Weight vectors, and steps that a slice of training texts moves them by.
VECTORS, STEPS = 3, 8
_END = 255  # never occurs in UTF-8; closes a text
_PLACES = 4
_OFFSETS = np.concatenate(([0], np.cumsum([1 << b for b in TABLE_BITS]))).astype(np.int64)
_CELLS = 1 << 14
_POOLED, _WAITING, _SLICE, _GROUP, _PIECE = 600_000, 8_000_000, 2 << 20, 1 << 18, 1 << 15
_STEP_UNITS = 40_000
_NODE = [(seeded(256, 90 + k) >> np.uint64(64 - b)).astype(np.int64) for k, b in enumerate(TABLE_BITS)]
#: A node and the bit that follows it, by the node which that leads to.
_STEP = [(node[:, None] * 2 + np.arange(2)).reshape(-1) for node in _NODE]
_LETTER = seeded(256, 41)
_HEAD = 8


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct codes, the place of each code among them, the order that sorts the codes (equal ones as they
    come), and which ones begin a new code in that order."""
    # The position takes the place of a hash's low bits: values are sorted much faster than places are.
    low = np.uint64((1 << len(codes).bit_length()) - 1)
    order = (np.sort((codes & ~low) | np.arange(len(codes), dtype=np.uint64)) & low).view(np.int64)
    ranked = codes[order]
    if (ranked[1:] < ranked[:-1]).any():  # some differ in the low bits alone
        order = np.argsort(codes, kind="stable")
        ranked = codes[order]
    fresh = np.ones(len(codes), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    of = np.empty(len(codes), np.int64)
    of[order] = np.cumsum(fresh) - 1
    return ranked[fresh], of, order, fresh


def _find(codes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the wanted codes are, or have to be put in, among the sorted ones; which ones are there."""
    at = np.searchsorted(codes, wanted)
    known = np.zeros(len(wanted), bool)
    inside = at < len(codes)
    known[inside] = codes[at[inside]] == wanted[inside]
    return at, known


def _totals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of weighted bytes, and the powers that take their place out of the hash of a range."""
    # Powers are made in steps, so that slices of about one size don't make them anew.
    up, down = _powers(-(-(len(data) + 1) >> 18) << 18)
    total = np.zeros(len(data) + 1, np.uint64)
    for a in range(0, len(data), _PIECE):  # pieces stay in the cache
        piece = _LETTER.take(data[a:a + _PIECE])
        piece *= up[a:a + len(piece)]
        piece[:1] += total[a:a + 1]
        np.cumsum(piece, out=total[a + 1:a + 1 + len(piece)])
    return total, down


class _Units:
    """Units of a batch of texts, distinct ones with their bytes.

    ``of`` and ``text`` give the distinct unit and the text of each unit in turn; ``times`` and ``texts`` are the numbers
    of occurrences of a distinct unit and of texts that have it.
    """

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary()).fill_null(b"")
        joined = pc.binary_join_element_wise(column, pa.scalar(b"\xff", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
        joined = joined.combine_chunks() if isinstance(joined, pa.ChunkedArray) else joined
        _, offsets, values = joined.buffers()
        offsets = np.frombuffer(offsets, np.int64)[joined.offset:joined.offset + len(joined) + 1]
        data = np.frombuffer(values, np.uint8)[offsets[0]:offsets[-1]]
        ends = offsets[1:] - offsets[0]
        space = (data == 32) | (data - np.uint8(9) < 5)
        begin = np.zeros(len(data), bool)
        begin[1:] = space[:-1] & ~space[1:]
        begin[0:1] = True
        begin[ends[:-1]] = True
        # The end of a text belongs to its last unit.
        last = ends - 1
        begin[last[(last > 0)]] = False
        begins = np.concatenate(([0], ends[:-1]))
        begin[begins] = True
        start = np.flatnonzero(begin)
        stop = np.append(start[1:], len(data))
        leading = np.searchsorted(start, begins)
        self.text = np.repeat(np.arange(len(column)), np.diff(leading, append=len(start)))
        kind = np.zeros(256, np.int64)
        kind[[33, 46, 63]] = 1
        kind[[44, 58, 59]] = 2
        before = np.maximum(start - 1, 0)
        newline = (data[before] == 10).astype(np.int64)
        mark = kind[data[np.maximum(start - 2, 0)]]
        state = 1 + newline * 3 + mark
        state[leading] = 0
        total, down = _totals(data)
        code = mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64) * np.uint64(16) + state.astype(np.uint64))
        self.codes, self.of, order, fresh = _distinct(code)
        first = order[fresh]
        self.times = np.bincount(self.of, minlength=len(first))
        text = self.text[order]
        fresh[1:] |= text[1:] != text[:-1]
        self.texts = np.bincount(self.of[order[fresh]], minlength=len(first))
        self.data, self.start, self.stop, self.state = data, start[first], stop[first], state[first]

    @classmethod
    def of_parts(cls, data: np.ndarray, start: np.ndarray, stop: np.ndarray, state: np.ndarray) -> _Units:
        """Distinct units alone, their bytes one behind the other."""
        units = cls.__new__(cls)
        units.data, units.start, units.stop, units.state = data, start, stop, state
        return units

    def groups(self, pick: np.ndarray, at_once: int = _GROUP) -> Iterator[np.ndarray]:
        """The picked distinct units in runs of bounded bytes."""
        size = np.cumsum((self.stop - self.start)[pick]) // at_once
        for part in np.split(pick, np.flatnonzero(np.diff(size)) + 1):
            if len(part):
                yield part

    @cached_property
    def heads(self) -> np.ndarray:
        """The first bytes of each distinct unit as a number."""
        length = self.stop - self.start
        head = np.zeros(len(length), np.uint64)
        for k in range(_HEAD):
            byte = self.data.take(self.start + k, mode="clip").astype(np.uint64)
            byte[length <= k] = 0
            head = head << np.uint64(8) | byte
        return head

    def ordered(self, pick: np.ndarray) -> np.ndarray:
        """The picked units with those that begin alike behind each other."""
        return pick[np.lexsort((self.heads[pick], self.state[pick]))]

    def contexts(self, pick: np.ndarray, shared: bool = True) -> _Contexts:
        """Context slots of the bytes of the picked units.

        What a byte's slots are is settled by what its unit has up to it. So if ``shared``, a beginning that a unit has
        in common with the one before it is there once; it doesn't matter for the result in which order the units come.
        """
        start, length, state = self.start[pick], (self.stop - self.start)[pick], self.state[pick]
        same = np.zeros(len(pick), np.int64)
        if shared:
            head = self.heads[pick]
            for k in range(_HEAD):
                same[1:] += (head[1:] ^ head[:-1]) < np.uint64(1 << 8 * (_HEAD - 1 - k))
            same[1:] = np.minimum(same[1:], np.minimum(length[1:], length[:-1])) * (state[1:] == state[:-1])
        number, base = np.arange(len(pick)), np.cumsum(length) - length
        unit = np.repeat(number, length)
        place = np.arange(len(unit)) - np.repeat(base, length)
        new = place >= np.repeat(same, length)
        first, again = np.flatnonzero(new), np.flatnonzero(~new)
        group = np.minimum(place[first], _PLACES - 1).astype(np.uint8)
        first = first[np.argsort(group, kind="stable")]
        borders = np.cumsum(np.bincount(group, minlength=_PLACES)).tolist()
        node = np.empty(len(unit), np.int64)
        node[first] = np.arange(len(first))
        # The last unit before that has not taken over the byte at a place is the one all between have it from.
        owner = np.stack([np.maximum.accumulate(np.where(same <= k, number, 0)) for k in range(_HEAD)], axis=1)
        p = place[again]
        node[again] = node[base[owner.reshape(-1)[unit[again] * _HEAD + p]] + p]

        total, down = _totals(self.data[np.repeat(start - base, length) + np.arange(len(unit))])
        of, place, begin = unit[first], place[first], base[unit[first]]
        prefix = (total[first] - total[begin]) * down[begin]
        at = start[of] + place
        state = state[of].astype(np.uint64)
        back = state + np.uint64(300)
        hashes, value = [], np.zeros(len(at), np.uint64)
        for k in range(4):
            byte = self.data.take(at - k - 1, mode="clip").astype(np.uint64)
            byte = np.where(place > k, byte, np.where(place == k, back, np.uint64(511)))
            value = value * np.uint64(512) + byte
            hashes.append(mix(value + np.uint64(k + 1)))
        hashes.append(mix(prefix + place.astype(np.uint64) * np.uint64(16) + state))
        slots = [(h >> np.uint64(64 - b)).view(np.int64) for h, b in zip(hashes, TABLE_BITS)]
        return _Contexts(self.data[at], slots, [0, *borders], of, unit, node)


class _Contexts(NamedTuple):
    """Bytes that differ in themselves or in what stands before them, sorted by place.

    ``slots`` are their context slots, ``borders`` the ends of the places, ``of`` the unit that each is taken from;
    ``unit`` and ``node`` give the unit and the place here of every byte of all units.
    """

    data: np.ndarray
    slots: list[np.ndarray]
    borders: list[int]
    of: np.ndarray
    unit: np.ndarray
    node: np.ndarray


class _Pool:
    """Distinct units of many batches with sums of numbers that belong to them, up to a bound."""

    def __init__(self, width: int):
        self.width = width
        self.clear()

    def clear(self) -> None:
        self.codes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sums = np.zeros((0, self.width))
        self.pieces: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.states: list[np.ndarray] = []

    def add(self, units: _Units, numbers: np.ndarray) -> np.ndarray:
        """Take in the units with their numbers; the place of each in ``sums`` and ``units()``."""
        at, known = _find(self.codes, units.codes)
        where, new = np.empty(len(at), np.int64), np.flatnonzero(~known)
        where[known] = self.place[at[known]]
        where[new] = len(self.sums) + np.arange(len(new))
        self.sums[where[known]] += numbers[known]
        length = (units.stop - units.start)[new]
        inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        self.pieces.append(units.data[np.repeat(units.start[new], length) + inner])
        self.lengths.append(length)
        self.states.append(units.state[new])
        self.codes = np.insert(self.codes, at[new], units.codes[new])
        self.place = np.insert(self.place, at[new], where[new])
        self.sums = np.concatenate((self.sums, numbers[new]))
        return where

    def units(self) -> _Units:
        stop = np.cumsum(np.concatenate(self.lengths))
        return _Units.of_parts(np.concatenate(self.pieces), stop - np.concatenate(self.lengths), stop, np.concatenate(self.states))


def _bit(data: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """The j-th bit of each byte, and the node that the bits before it lead to."""
    return (data >> (7 - j)) & 1, (data.astype(np.int64) >> (8 - j)) | (1 << j)


def _next(data: np.ndarray, j: int) -> np.ndarray:
    """The node that each byte's bits up to the j-th lead to."""
    return (data.astype(np.int64) >> (7 - j)) | (2 << j)


def _count_bits(units: _Units, times: np.ndarray, counts: list[np.ndarray]) -> None:
    for pick in units.groups(units.ordered(np.flatnonzero(times)), 1 << 20):
        c = units.contexts(pick)
        weight = np.tile(np.bincount(c.node, times[pick][c.unit], len(c.data)), 8)
        steps = [_next(c.data, j) for j in range(8)]
        for k, slot in enumerate(c.slots):
            slot = slot * 2
            counts[k] += np.bincount(np.concatenate([slot ^ _STEP[k].take(step) for step in steps]), weight, len(counts[k]))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of all training texts of a task, cut into cells of one size."""
    counts = [np.zeros(2 << b) for b in TABLE_BITS]
    pool, any_ = _Pool(1), False

    def settle() -> None:
        if len(pool.sums):
            _count_bits(pool.units(), pool.sums[:, 0], counts)
            pool.clear()

    for batch in batches:
        for part in slices(batch, bytes_each=_SLICE):
            any_ = True
            units = _Units(part.column("text"))
            pool.add(units, units.times[:, None])
            if len(pool.sums) > _POOLED:
                settle()
    settle()
    if any_:
        every = np.concatenate(counts).astype(np.int64).reshape(-1, 2 * _CELLS)
        for i in np.flatnonzero(every.any(axis=1)).tolist():
            yield pa.RecordBatch.from_pydict({"cell": pa.array([i], pa.int32()), "counts": [every[i].tobytes()]})


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the cells of a partition, one at a time; rows come sorted by cell."""
    cell, total = None, None
    for batch in batches:
        for c, data in zip(batch.column("cell").to_pylist(), batch.column("counts").to_pylist()):
            if c != cell:
                if cell is not None:
                    yield pa.RecordBatch.from_pydict({"cell": pa.array([cell], pa.int32()), "counts": [total.tobytes()]})
                cell, total = c, np.zeros(2 * _CELLS, np.int64)
            total += np.frombuffer(data, np.int64)
    if cell is not None:
        yield pa.RecordBatch.from_pydict({"cell": pa.array([cell], pa.int32()), "counts": [total.tobytes()]})


def bit_counts(texts: DataFrame) -> DataFrame:
    """Counts of zeros and ones per context slot over all of ``texts`` (``text``): rows ``cell, counts``.

    A task sends a fixed amount, whatever it has read; cells are summed as a stream.
    """
    partial = texts.select("text").mapInArrow(_gather, "cell int, counts binary")
    cells = int(_OFFSETS[-1]) // _CELLS
    return partial.repartition(min(cells, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "cell") \
        .sortWithinPartitions("cell").mapInArrow(_add, "cell int, counts binary")


def _odds(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    return np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4)))


class Mixer:
    """Predictor tables (counts, and log odds made of them), and the weight vectors."""

    def __init__(self, counts: list[np.ndarray], weights: np.ndarray, odds: list[np.ndarray] | None = None):
        self.counts, self.weights = counts, weights
        self.odds = odds or [_odds(c[:, 1], c[:, 0]) for c in counts]

    @classmethod
    def of(cls, rows: list[tuple[int, bytes]]) -> Mixer:
        counts = np.zeros((int(_OFFSETS[-1]), 2), np.float32)
        for cell, data in rows:
            counts[cell * _CELLS:(cell + 1) * _CELLS] = np.frombuffer(data, np.int64).reshape(-1, 2)
        start = np.full((VECTORS, 8, _PLACES, 2, len(TABLE_BITS)), 0.3, np.float32)
        start += (np.arange(VECTORS, dtype=np.float32) - 1).reshape(-1, 1, 1, 1, 1) * np.linspace(-0.1, 0.1, len(TABLE_BITS), dtype=np.float32)
        return cls([counts[a:b] for a, b in zip(_OFFSETS[:-1], _OFFSETS[1:])], start)

    def inputs(self, data: np.ndarray, slots: list[np.ndarray], j: int) -> tuple[np.ndarray, np.ndarray]:
        bit, node = _bit(data, j)
        x = np.empty((len(slots), len(data)), np.float32)
        for k, slot in enumerate(slots):
            self.odds[k].take(slot ^ _NODE[k].take(node), out=x[k], mode="clip")  # every place is within the table
        return bit, x

    def others(self, data: np.ndarray, slots: list[np.ndarray], j: int, own: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs for units of texts that are themselves part of the counts: ``own``, what one text has of a unit, is
        taken off. ``more`` tells where that is not one."""
        bit, step = (data >> (7 - j)) & 1, _next(data, j)
        x = np.empty((len(slots), len(data)), np.float32)
        # Most units come once in a text; their odds are made once for every slot and bit.
        ones = own[more] * bit[more]
        zeros = own[more] - ones
        for k, slot in enumerate(slots):
            at = (slot * 2) ^ _STEP[k].take(step)
            self.alone[k].take(at, out=x[k], mode="clip")
            rest = self.counts[k].view(np.complex64)[:, 0].take(at[more] >> 1).view(np.float32).reshape(-1, 2)
            x[k, more] = _odds(np.maximum(rest[:, 1] - ones, 0), np.maximum(rest[:, 0] - zeros, 0))
        return bit.astype(np.float32), x

    @cached_property
    def alone(self) -> list[np.ndarray]:
        """Log odds of each slot without one zero, and without one one, in turn."""
        return [np.stack((_odds(c[:, 1], np.maximum(c[:, 0] - 1, 0)), _odds(np.maximum(c[:, 1] - 1, 0), c[:, 0])), axis=1).reshape(-1) for c in self.counts]

    def bits(self, units: _Units, pick: np.ndarray) -> np.ndarray:
        """Code length in nats of the picked units under each weight vector: shape (units, vectors)."""
        data, slots, borders, _, unit, at = units.contexts(pick)
        cost = np.zeros((VECTORS, len(data)), np.float32)
        # A bit's probability is 1 / (1 + e^z); four such factors, at most e^60, share a logarithm.
        product = np.ones_like(cost)
        for j in range(8):
            bit, x = self.inputs(data, slots, j)
            sign = (1 - 2 * bit.astype(np.float32))
            for p in range(_PLACES):
                a, b = borders[p], borders[p + 1]
                part = x[:, a:b]
                z = np.where(part[-1] != 0, self.weights[:, j, p, 1] @ part, self.weights[:, j, p, 0] @ part) * sign[a:b]
                np.clip(z, -15, 15, out=z)
                np.exp(z, out=z)
                z += 1
                product[:, a:b] *= z
            if j % 4 == 3:
                cost += np.log(product, out=product)
                product.fill(1)
        return np.stack([np.bincount(unit, c[at], len(pick)) for c in cost], axis=1)

    def costs(self, units: _Units, pick: np.ndarray) -> np.ndarray:
        """The same for any number of units."""
        cost = np.empty((len(pick), VECTORS), np.float32)
        order = units.ordered(pick)
        place = np.empty(len(units.start), np.int64)
        place[pick] = np.arange(len(pick))
        for part in units.groups(order, _GROUP >> 2):
            cost[place[part]] = self.bits(units, part)
        return cost

    def refine(self, column: pa.Array, rate: float = 0.05) -> None:
        """One online pass over a column of texts."""
        refiner = _Refiner(self, rate)
        for part in slices(pa.table({"text": column}), bytes_each=_SLICE):
            refiner.gather(part.column("text").combine_chunks())
        refiner.settle()


class _Refiner:
    """Moves a mixer's weights: each text counts for the vector that coded it best at the start of the pass.

    Which one that is, is judged by all its units, as all of them move the weights: equal ones of a task are worked
    through together, with the number of their occurrences for each vector. They are
    dealt over STEPS steps (by hash, so in no order of the texts); step sizes come from past gradients. ``seen`` counts
    the bits that have moved each weight vector of a gate.
    """

    def __init__(self, mixer: Mixer, rate: float = 0.05):
        self.mixer, self.rate = mixer, rate
        self.first = Mixer(mixer.counts, mixer.weights.copy(), mixer.odds)
        self.past = np.full_like(mixer.weights, 1e-3)
        self.seen = np.zeros(mixer.weights.shape[:-1])
        self.pool = _Pool(VECTORS + 2)
        self.clear()

    def clear(self) -> None:
        self.pool.clear()
        self.waiting: list[_Texts] = []
        self.cost = np.zeros((0, VECTORS), np.float32)

    def gather(self, column: pa.Array) -> None:
        """Take in texts, which are judged later."""
        units = _Units(column)
        numbers = np.zeros((len(units.codes), VECTORS + 2))
        numbers[:, -2], numbers[:, -1] = units.times, units.texts
        self.waiting.append(_Texts.of(units, self.pool.add(units, numbers), len(column)))
        if len(self.pool.sums) > _POOLED:
            self.settle()
        elif sum(len(texts.unit) for texts in self.waiting) > _WAITING:
            self.judge(self.pool.units())

    def add(self, column: pa.Array) -> None:
        """Take in texts and judge them."""
        self.gather(column)
        if self.waiting:
            self.judge(self.pool.units())

    def judge(self, units: _Units) -> None:
        """Let each waiting text count for the vector that codes it best."""
        self.cost = np.concatenate((self.cost, self.first.costs(units, np.arange(len(self.cost), len(units.start)))))
        moved = np.zeros(len(units.start) * VECTORS, np.int64)
        for texts in self.waiting:
            best = texts.sums(self.cost).argmin(axis=1)
            moved += np.bincount(texts.unit.astype(np.int64) * VECTORS + best[texts.text], minlength=len(moved))
        self.pool.sums[:, :VECTORS] += moved.reshape(-1, VECTORS)
        self.waiting = []

    def settle(self) -> None:
        """Work through what has been gathered."""
        if not len(self.pool.sums):
            return
        units, sums = self.pool.units(), self.pool.sums
        self.judge(units)
        own = (sums[:, -2] / sums[:, -1]).astype(np.float32)
        turn = np.argsort(mix(np.arange(len(sums), dtype=np.uint64)), kind="stable")
        for step in np.array_split(turn, max(STEPS, STEPS * len(sums) // _STEP_UNITS)):
            for pick in units.groups(step):
                # Each unit by itself: sums in single precision depend on what is added in which order.
                self._step(units.contexts(pick, shared=False), sums[pick, :VECTORS].astype(np.float32), own[pick])
        self.clear()

    def _step(self, contexts: _Contexts, times: np.ndarray, own: np.ndarray) -> None:
        data, slots, borders, of, *_ = contexts
        times, own = np.ascontiguousarray(times[of].T), own[of]
        more = np.flatnonzero(own != 1)
        for j in range(8):
            bit, x = self.mixer.others(data, slots, j, own, more)
            for p in range(_PLACES):
                span = slice(borders[p], borders[p + 1])
                part, many = x[:, span], times[:, span]
                met = (part[-1] != 0).astype(np.float32)
                weights, past = self.mixer.weights[:, j, p], self.past[:, j, p]
                z = np.where(met > 0, weights[:, 1] @ part, weights[:, 0] @ part)
                np.clip(z, -15, 15, out=z)
                np.exp(np.negative(z, out=z), out=z)
                z += 1
                error = (bit[span] - 1 / z) * many
                known = (error * met) @ part.T
                for g, gradient in enumerate((error @ part.T - known, known)):
                    past[:, g] += gradient**2
                    weights[:, g] += self.rate * gradient / np.sqrt(past[:, g])
                bits = many @ met
                self.seen[:, j, p, 1] += bits
                self.seen[:, j, p, 0] += many.sum(axis=1) - bits


class _Texts(NamedTuple):
    """Texts of a batch: pooled unit and text of each unit in turn, number of texts."""

    unit: np.ndarray
    text: np.ndarray
    count: int

    @classmethod
    def of(cls, units: _Units, place: np.ndarray, count: int) -> _Texts:
        return cls(place[units.of].astype(np.int32), units.text.astype(np.int32), count)

    def sums(self, cost: np.ndarray) -> np.ndarray:
        """Code length in nats of each text under each weight vector."""
        return np.stack([np.bincount(self.text, c[self.unit], self.count) for c in np.ascontiguousarray(cost.T)], axis=1)


class _Coder:
    """Code lengths of texts; their units are pooled up to a bound, and each distinct one is computed once."""

    def __init__(self, mixer: Mixer):
        self.mixer, self.pool = mixer, _Pool(0)
        self.cost = np.zeros((0, VECTORS), np.float32)
        self.waiting: list[_Texts] = []
        self.done: list[np.ndarray] = []

    def add(self, column: pa.Array) -> None:
        units = _Units(column)
        self.waiting.append(_Texts.of(units, self.pool.add(units, np.zeros((len(units.codes), 0))), len(column)))
        full = len(self.pool.sums) > _POOLED
        if full or sum(len(texts.unit) for texts in self.waiting) > _WAITING:
            self.settle()
        if full:
            self.pool.clear()
            self.cost = self.cost[:0]

    def settle(self) -> None:
        """Sum up the waiting texts."""
        if self.waiting:
            units = self.pool.units()
            self.cost = np.concatenate((self.cost, self.mixer.costs(units, np.arange(len(self.cost), len(units.start)))))
            self.done += [texts.sums(self.cost) for texts in self.waiting]
            self.waiting = []

    def scores(self) -> np.ndarray:
        """log10 probability of each text added since the last call."""
        self.settle()
        sums, self.done = np.concatenate(self.done), []
        least = sums.min(axis=1)
        return -(least - np.log(np.exp(least[:, None] - sums).mean(axis=1))) / np.log(10)

    def totals(self, column: pa.Array) -> np.ndarray:
        """log10 probability of each text of a batch."""
        self.add(column)
        return self.scores()


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of a bucket, and the token and text of each occurrence; the end of a text is token 0."""
    codes, texts, base = [], [], 0
    for part in slices(table, bytes_each=_SLICE):
        part = part.combine_chunks() if isinstance(part, pa.Table) else part
        w = words_of(part.column("text"), lower=True)
        codes.append(np.maximum(w.codes, np.uint64(1)))
        texts.append(np.repeat(np.arange(part.num_rows), np.diff(w.first)) + base)
        base += part.num_rows
    codes.append(np.zeros(base, np.uint64))
    texts.append(np.arange(base))
    distinct, of, *_ = _distinct(np.concatenate(codes))
    return distinct, of, np.concatenate(texts)


def _vocabulary(table: pa.Table) -> pa.Table:
    distinct, of, text = _tokens(table)
    train = ~table.column("held_out").to_numpy()
    n = np.bincount(of, train[text].astype(np.float64), len(distinct)).astype(np.int64)
    bucket = np.full(len(distinct), table.column("bucket")[0].as_py() if table.num_rows else 0, np.int32)
    return pa.table({"token": distinct.view(np.int64), "bucket": bucket, "n": n})


def _score(mixer, total: int, kinds: int):
    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        if docs.num_rows == 0:
            return pa.table({c: pa.array([], t) for c, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
        distinct, of, text = _tokens(docs)
        train = ~docs.column("held_out").to_numpy()
        # A token met in this bucket only has its whole count here; others bring it along.
        count = np.bincount(of, train[text].astype(np.float64), len(distinct))
        token = shared.column("token").to_numpy().view(np.uint64)
        count[np.searchsorted(distinct, token)] = shared.column("c").to_numpy()
        logs = np.log10((count + 0.5) / (total + 0.5 * (kinds + 1)))
        n = docs.num_rows
        coder = _Coder(Mixer(*mixer.value))
        for part in slices(docs, bytes_each=_SLICE):
            coder.add(part.column("text").combine_chunks())
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": np.bincount(text, minlength=n), "n_bytes": pc.add(pc.binary_length(docs.column("text")).cast(pa.int64()), 1),
            "n_known": np.bincount(text, (count > 0)[of].astype(np.float64), n).astype(np.int64),
            "base_score": np.bincount(text, logs[of], n), "score": coder.scores()})

    return run


def _refined(texts: DataFrame, sent) -> DataFrame:
    """Weights refined over all of ``texts`` (``text``): rows ``gate, w`` for each gate and vector that any bit moved,
    the average over the tasks by the bits each has seen."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refiner = None
        for batch in batches:
            for part in slices(batch, bytes_each=_SLICE):
                refiner = refiner or _Refiner(Mixer(sent.value[0], sent.value[1].copy()))
                refiner.gather(part.column("text"))
        if refiner is not None:
            refiner.settle()
            seen = refiner.seen.reshape(-1)
            gate = np.flatnonzero(seen)
            rows = refiner.mixer.weights.reshape(-1, len(TABLE_BITS))[gate].astype(np.float64) * seen[gate, None]
            yield pa.RecordBatch.from_pydict({"gate": pa.array(gate, pa.int32()), "n": seen[gate], **{f"w{k}": rows[:, k] for k in range(rows.shape[1])}})

    names = [f"w{k}" for k in range(len(TABLE_BITS))]
    moved = texts.select("text").mapInArrow(run, ", ".join(["gate int", "n double", *(f"{w} double" for w in names)]))
    return moved.groupBy("gate").agg(F.array(*[F.sum(w) / F.sum("n") for w in names]).alias("w"))


def mixed_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """Score every text of ``docs`` (``doc_id``, ``text``) with models learnt from the rows where ``held_out`` is false.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``. ``base_score`` is
    the sum over lower-cased (A-Z) words and one end token of log10((c + 0.5) / (N + 0.5 (V + 1))). ``score`` is the
    log10 probability of the text and its end under the mixing model; ``bits_per_byte`` spreads it over the UTF-8 bytes
    and the end. Null texts count as empty. Counts cover all training rows; words are counted by 64-bit hash. Each
    bucket of documents gets the counts of just those of its words that other buckets have too, so no vocabulary is
    held whole anywhere. Predictor tables have a fixed size. The mixing weights are refined
    over all training rows, in one pass. Rows keep their number, more columns are ignored. Without
    training rows every bit costs one bit. An empty table gives an empty result.
    """
    spark, folder = docs.sparkSession, run_folder(docs.sparkSession)
    out = F.coalesce(held_out, F.lit(False)).alias("held_out")
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), out)
    model = staged(bit_counts(base.where("not held_out")), folder, "bits")
    mixer = Mixer.of([(r["cell"], bytes(r["counts"])) for r in model.collect()])
    # The tables have a fixed size (see TABLE_BITS), so what is broadcast does not grow.
    sent = spark.sparkContext.broadcast((mixer.counts, mixer.weights))
    weights = staged(_refined(base.where("not held_out"), sent), folder, "weights")
    for r in weights.collect():  # one row per gate and vector
        mixer.weights.reshape(-1, len(TABLE_BITS))[r["gate"]] = r["w"]
    sent = spark.sparkContext.broadcast((mixer.counts, mixer.weights))

    buckets = base.withColumn("bucket", bucket_of(bucket_count(docs), "doc_id", "text"))
    words = buckets.groupBy("bucket").applyInArrow(_vocabulary, "token long, bucket int, n long")
    same = W.partitionBy("token")
    words = words.withColumn("c", F.sum("n").over(same)).withColumn("low", F.min("bucket").over(same)).withColumn("high", F.max("bucket").over(same))
    words = words.withColumn("lead", (F.col("low") == F.col("bucket")) & (F.col("c") > 0))
    kept = staged(words.where("lead or low < high").select("token", "bucket", "c", "lead", (F.col("low") < F.col("high")).alias("shared")), folder, "words")
    sums = kept.where("lead").agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    total, kinds = int(sums["n"] or 0), int(sums["v"] or 0)
    shared = kept.where("shared").select("bucket", "token", "c")
    scored = buckets.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(
        _score(sent, total, kinds), "doc_id long, held_out boolean, n_tokens long, n_bytes long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score",
                         (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"))
