"""Maximal periodic runs of words, found by internal pattern matching.

A run of period p covers two periods at least. With b a power of two and 2b <= p < 4b, its first period holds a whole
dyadic block (b words that start at a multiple of b), which occurs again p words on. So each block asks for its
occurrences in the windows of b starting places from 2b and from 3b words on. A suffix array puts equal blocks next to
each other; a wavelet tree over it counts those in a window and gives the first at or behind a place (range successor).
Three or more in one window form an arithmetic progression. Every distance is a candidate period, which is extended to
both sides as far as words p apart agree. Periods below four need no blocks: neighbouring words are compared.

Several documents are worked through together. A word of one document never equals that of another, so nothing reaches
over a border. Equality of words and of stretches is that of hashes of over 60 bits.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix, seeded, slices, words_of

#: Words of the shortest run that counts.
SHORTEST = 12
_SLICE = 3 << 20
_PRIMES, _BASES = (2_147_483_647, 2_147_483_629), (1_103_515_245, 1_812_433_253)


class Wavelet:
    """Wavelet matrix over non-negative integers: counts and order statistics of any stretch of them."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in reversed(range(self.bits)):
            zero = (values >> bit) & 1 == 0
            self.zeros.append(np.concatenate(([0], np.cumsum(zero, dtype=np.int64))))
            values = np.concatenate((values[zero], values[~zero]))

    def below(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of each stretch [left, right) are less than ``bound``."""
        count = np.where(bound >> self.bits > 0, right - left, 0)
        right = np.where(bound >> self.bits > 0, left, right)
        for level, zeros in enumerate(self.zeros):
            one = (bound >> (self.bits - 1 - level)) & 1 == 1
            a, b = zeros[left], zeros[right]
            count = count + np.where(one, b - a, 0)
            left, right = np.where(one, zeros[-1] + left - a, a), np.where(one, zeros[-1] + right - b, b)
        return count

    def at(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value of that rank (from 0) among each stretch."""
        value = np.zeros(len(rank), np.int64)
        for zeros in self.zeros:
            a, b = zeros[left], zeros[right]
            one = rank >= b - a
            value = value * 2 + one
            rank = np.where(one, rank - (b - a), rank)
            left, right = np.where(one, zeros[-1] + left - a, a), np.where(one, zeros[-1] + right - b, b)
        return value

    def successor(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The least value of each stretch that is at least ``bound``; -1 where there is none."""
        rank = self.below(left, right, bound)
        some = rank < right - left
        out = np.full(len(rank), -1)
        out[some] = self.at(left[some], right[some], rank[some])
        return out


class Stretches:
    """Comparison of stretches of ``ids`` by polynomial hashes modulo two primes."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.tables = []
        for prime, base in zip(_PRIMES, _BASES):
            power = np.ones(n + 1, np.uint64)
            have = 1
            while have <= n:
                more = min(have, n + 1 - have)
                power[have:have + more] = power[:more] * np.uint64(pow(base, have, prime)) % np.uint64(prime)
                have += more
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((ids.astype(np.uint64) + np.uint64(1)) % np.uint64(prime) * power[:n] % np.uint64(prime), out=total[1:])
            self.tables.append((np.uint64(prime), power, total % np.uint64(prime)))

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of that length from ``a`` and from ``b`` (behind it) are equal."""
        out = np.ones(len(a), bool)
        for prime, power, total in self.tables:
            first, second = total[a + length] + prime - total[a], total[b + length] + prime - total[b]
            out &= first % prime * power[b - a] % prime == second % prime
        return out

    def forth(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words from ``a`` and ``b`` on that agree, ``most`` at the utmost."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = self.same(a, b, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    def back(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words before ``a`` and ``b`` that agree, ``most`` at the utmost."""
        low, high = np.zeros(len(a), np.int64), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            good = self.same(a - middle, b - middle, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low


def repeated_blocks(ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """A suffix array by doubling, of the places whose two words occur again, and the dyadic blocks that do.

    ``begin`` and ``end`` are the borders of the document of each place. Blocks come as ``(length, place, left, right)``:
    ``array[left:right]`` are the places where the same words stand. Only places that are still not unique are sorted
    in a round; the others keep their place behind them in their group.
    """
    n = len(ids)
    often = np.bincount(ids)[ids] > 1 if n else np.zeros(0, bool)
    place = np.flatnonzero(often[:-1] & often[1:] & (begin[:-1] == begin[1:])) if n else np.zeros(0, np.int64)
    order = np.argsort(ids[place] * n + ids[place + 1], kind="stable")
    place = place[order]
    key = ids[place] * n + ids[place + 1]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    size = np.diff(np.append(np.flatnonzero(new), len(key)))
    keep = np.repeat(size > 1, size)
    array, size = place[keep], size[size > 1]
    rank = n + np.arange(n)  # of unique places; those of others are less
    heads = np.cumsum(size) - size
    rank[array] = np.repeat(heads, size)
    spread = np.repeat(size, size)  # size of the group of each active place
    active = np.arange(len(array))
    longest, length, blocks = int((end - begin).max(initial=0)), 2, []
    while len(active) and 4 * length <= longest:
        here = array[active]
        block = ((here - begin[here]) % length == 0) & (here + 3 * length <= end[here])
        left = rank[here[block]]
        blocks.append((length, here[block], left, left + spread[block]))
        follows = rank[np.minimum(here + length, n - 1)]
        follows = np.where((here + length < end[here]) & (follows < n), follows, n)
        key = rank[here] * (n + 1) + follows
        order = np.argsort(key, kind="stable")
        here, key, lasting = here[order], key[order], follows[order] < n
        array[active] = here
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        size = np.diff(np.append(np.flatnonzero(new), len(key)))
        spread = np.repeat(size, size)
        head = np.repeat(active[np.flatnonzero(new)], size)
        stays = lasting & (spread > 1)
        rank[here] = np.where(stays, head, n + here)
        active, spread = active[stays], spread[stays]
        length *= 2
    return array, blocks


def _candidates(array: np.ndarray, blocks: list, stretches: Callable[[], Stretches]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and distances at which a dyadic block occurs again in its windows."""
    blocks = [b for b in blocks if len(b[1])]
    if not blocks:
        return
    tree = Wavelet(array)
    for length, place, left, right in blocks:
        low = tree.below(left, right, place + 2 * length)
        for first in (2 * length, 3 * length):
            high = tree.below(left, right, place + first + length)
            some = np.flatnonzero(high > low)
            i, a, b, count = place[some], left[some], right[some], (high - low)[some]
            start = tree.at(a, b, low[some])
            low = high
            single = count == 1
            yield i[single], (start - i)[single]
            several = np.flatnonzero(~single)
            i, a, b, start, count = i[several], a[several], b[several], start[several], count[several]
            step = tree.successor(a, b, start + 1) - start
            # A block in one periodic stretch with its occurrences: all distances are multiples of that period.
            within = np.zeros(len(i), bool)
            many = np.flatnonzero(count > 2)
            if len(many):
                within[many] = stretches().same(i[many], i[many] + step[many], start[many] + length - step[many] - i[many])
            i, start, step, count = i[~within], start[~within], step[~within], count[~within]
            turn = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            yield np.repeat(i, count), np.repeat(start - i, count) + turn * np.repeat(step, count)


def _could_last(ids, begin, end, place, period, look: int = 8) -> np.ndarray:
    """Candidates that agree over enough words, or over ``look`` words on a side; the rest can't be runs."""
    agree, open_ = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
    for step in (1, -1):
        going = np.ones(len(place), bool)
        for t in range(look):
            at = place + t if step > 0 else place - 1 - t
            going &= (at >= begin) & (at + period < end)
            safe = np.where(going, at, place)
            going &= ids[safe] == ids[np.where(going, at + period, place)]
            agree += going
        open_ |= going
    return open_ | (agree + period >= np.maximum(SHORTEST, 2 * period))


def runs_of(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs, by start, then period.

    ``first[d]:first[d + 1]`` are the words of document d as small integers; no integer is in two documents.
    """
    n = len(ids)
    begin = np.repeat(first[:-1], np.diff(first))
    end = np.repeat(first[1:], np.diff(first))
    starts, ends, periods = [], [], []
    for p in (1, 2, 3):
        agree = np.zeros(max(0, n - p) + 2, bool)
        agree[1:-1] = ids[p:] == ids[:n - p] if n > p else agree[1:-1]
        edge = np.flatnonzero(agree[1:] != agree[:-1])
        a, b = edge[::2], edge[1::2] + p
        long = b - a >= max(SHORTEST, 2 * p)
        starts.append(a[long])
        ends.append(b[long])
        periods.append(np.full(int(long.sum()), p))
    held: list[Stretches] = []

    def stretches() -> Stretches:
        if not held:
            held.append(Stretches(ids))
        return held[0]

    for place, period in _candidates(*repeated_blocks(ids, begin, end), stretches):
        if not len(place):
            continue
        last = _could_last(ids, begin[place], end[place], place, period)
        place, period = place[last], period[last]
        if not len(place):
            continue
        right = stretches().forth(place, place + period, end[place] - place - period)
        left = stretches().back(place, place + period, place - begin[place])
        long = left + right + period >= np.maximum(SHORTEST, 2 * period)
        starts.append((place - left)[long])
        ends.append((place + period + right)[long])
        periods.append(period[long])
    start, stop, period = np.concatenate(starts), np.concatenate(ends), np.concatenate(periods)
    # Of equal stretches the smallest period counts: any other one is a multiple of it.
    order = np.lexsort((period, stop, start))
    start, stop, period = start[order], stop[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, period = start[new], stop[new], period[new]
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


Rewrite = Callable[[int | None, int], np.ndarray | None]


def contract_rewrite(doc_id: int | None, n: int) -> np.ndarray | None:
    """The word that stands at each place where a tenth of the documents (by checksum of the id) are made periodic."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


_FOUND = "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, runs_sha256 string, collapsed_sha256 string"


def _detect(rewrite: Rewrite | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, bytes_each=_SLICE):
                yield _found(part, rewrite)

    return run


def _found(part: pa.RecordBatch, rewrite: Rewrite | None) -> pa.RecordBatch:
    w = words_of(part.column("text"))
    first, docs = w.first, part.column("doc_id").to_pylist()
    codes, moved = w.codes, {}
    for d, doc in enumerate(docs):
        at = rewrite(doc, int(first[d + 1] - first[d])) if rewrite else None
        if at is not None:
            moved[d] = at
    if moved:
        codes = codes.copy()
        for d, at in moved.items():
            codes[first[d]:first[d + 1]] = w.codes[first[d]:first[d + 1]][at]
    own = seeded(max(1, len(docs)), 61)
    ids = np.unique(mix(codes ^ np.repeat(own[:len(docs)], np.diff(first))), return_inverse=True)[1] if len(codes) else np.zeros(0, np.int64)
    start, stop, period = runs_of(ids, first)
    delta = np.zeros(len(ids) + 1, np.int64)
    np.add.at(delta, start + period, 1)
    np.add.at(delta, stop, -1)
    kept = np.cumsum(delta[:-1]) == 0
    of = np.searchsorted(first, start, side="right") - 1
    cut = np.searchsorted(of, np.arange(len(docs) + 1))
    inner = start - first[of] if len(of) else start
    length = stop - start
    runs, collapsed = [], []
    for d, text in enumerate(part.column("text").to_pylist()):
        span = slice(cut[d], cut[d + 1])
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in zip(inner[span].tolist(), length[span].tolist(), period[span].tolist()))
        runs.append(hashlib.sha256(lines.encode()).hexdigest())
        found = (text or "").encode().split()
        if d in moved:
            found = [found[i] for i in moved[d].tolist()]
        if cut[d + 1] > cut[d]:
            found = compress(found, kept[first[d]:first[d + 1]].tolist())
        collapsed.append(hashlib.sha256(b" ".join(found)).hexdigest())
    lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(c, pa.int64())) for c in (inner, length, period)]
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), pa.array(np.diff(first), pa.int64()), *lists, pa.array(runs, pa.string()), pa.array(collapsed, pa.string())],
        names=["doc_id", "n_words", "starts", "lengths", "periods", "runs_sha256", "collapsed_sha256"])


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """All maximal periodic runs of every row of ``docs`` (``doc_id``, ``text``).

    Returns ``doc_id, n_words, starts, lengths, periods`` (arrays, by start, then period) and the digests
    ``runs_sha256`` (of the lines ``start,length,period``) and ``collapsed_sha256`` (of the words that are left when each
    run keeps its first period, joined by one space). Words are ``[^\\x20\\x09-\\x0D]+``, compared byte by byte and
    numbered from 0. A run has ``SHORTEST`` words and two periods at least, and is extended as far as words a period apart
    are the same; its period is the smallest one. ``rewrite`` may give, for a document and its number of words, the
    place from which each word is taken, or None. Null, blank and short texts have no runs. Rows keep their number;
    repeated rows and null ids are worked on alike; more columns are ignored. An empty table gives an empty result.
    Documents are independent, so nothing is shuffled.
    """
    return docs.select("doc_id", "text").mapInArrow(_detect(rewrite), _FOUND)
