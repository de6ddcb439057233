"""Searches over small tables, on the driver, of which every one states the bound of its input; beam_sets_over() takes any table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def exhaustive_partition(sizes: dict[str, Sequence[int]], parts: int = 3) -> dict[str, int]:
    """Up to 18 groups into parts with equally many groups each (their number is a multiple of parts), the best of all ways.

    sizes: group -> its total and its label counts. Of the ways whose totals have a range of two at most, or of all where
    there are none: the least largest deviation of a share, then the least squared ones, then range, then the first by names.
    """
    names = sorted(sizes)
    n, k = len(names), len(names) // parts
    if n > 18 or n % parts:
        raise ValueError("an exhaustive partition takes up to 18 groups, as many for each part")
    if not n:
        return {}
    x = np.array([sizes[g] for g in names], dtype=float).reshape(n, -1)
    want = np.maximum(x.sum(axis=0) / parts, 1e-9)
    subsets = [np.array(c) for c in combinations(range(n), k)]
    mask = np.array([int(sum(1 << int(i) for i in c)) for c in subsets], dtype=np.int64)
    total = np.array([x[c].sum(axis=0) for c in subsets])
    off = total / want - 1
    worst, squared = np.abs(off).max(axis=1), (off**2).sum(axis=1)
    number = {int(m): i for i, m in enumerate(mask)}
    best: tuple | None = None

    def search(left: int, chosen: list[int]) -> None:
        nonlocal best
        first = left & -left
        if len(chosen) == parts - 1:
            last = number[left]
            consider([*chosen, last])
            return
        fits = np.flatnonzero((mask & left == mask) & (mask & first > 0))
        if len(chosen) < parts - 2:
            for i in fits:
                if best is None or worst[i] <= best[0][1] or not best[0][0] == 0:
                    search(left & ~int(mask[i]), [*chosen, int(i)])
            return
        # The last two parts at once: each candidate and what is left of it.
        rest = np.array([number[int(left & ~m)] for m in mask[fits]])
        done = np.array(chosen, dtype=int)
        sums = [total[fits, 0], total[rest, 0], *[np.full(len(fits), total[i, 0]) for i in done]]
        spread = np.max(sums, axis=0) - np.min(sums, axis=0)
        key = np.column_stack([
            spread > 2, np.round(np.maximum(np.maximum(worst[fits], worst[rest]), worst[done].max() if len(done) else 0.0), 12),
            np.round(squared[fits] + squared[rest] + squared[done].sum(), 12), spread,
        ])
        i = np.lexsort(key.T[::-1])[0]
        offer(tuple(key[i]), [*chosen, int(fits[i]), int(rest[i])])

    def consider(found: list[int]) -> None:
        sums = total[found, 0]
        spread = float(sums.max() - sums.min())
        offer((float(spread > 2), round(float(worst[found].max()), 12), round(float(squared[found].sum()), 12), spread), found)

    def offer(key: tuple, found: list[int]) -> None:
        nonlocal best
        groups = sorted(tuple(subsets[i]) for i in found)
        if best is None or (key, groups) < best:
            best = key, groups

    search((1 << n) - 1, [])
    return {names[i]: p for p, group in enumerate(best[1]) for i in group}


class Extensions:
    """The best distinct sets of a partial set and one candidate more, as many as width, over candidates that come in batches of any size and order.

    Values are whole numbers of UNIT, so that sums are exact and equal sets have equal values; ties go to the smaller ids, compared
    as sorted tuples. What is found therefore does not depend on the batches. members: partial sets x ids, sorted; seen: their labels.
    apart: sets of the size of those found, which share all but two members at most with each of them.
    """

    UNIT, CHUNK = 1e-9, 250_000

    def __init__(self, members: np.ndarray, seen: np.ndarray, score: np.ndarray, weights: np.ndarray, width: int, apart: Sequence[Sequence[int]] = ()):
        self.width, self.apart, self.most = width, apart, members.shape[1] - 1
        free = self.is_apart(members)
        members, seen, score = members[free], seen[free], score[free]
        # Partial sets of the same labels follow each other, so that what a chunk of them can gain is known closely.
        first: dict[bytes, int] = {}
        order = np.argsort(np.array([first.setdefault(x.tobytes(), i) for i, x in enumerate(seen)], dtype=np.int64), kind="stable")
        members, seen, score = members[order], seen[order], score[order]
        self.members, self.seen, self.score = members, seen, score
        self.weights = np.round(weights / self.UNIT)
        self.sets, self.value = np.zeros((0, members.shape[1] + 1), dtype=np.int64), np.zeros(0)
        self.parent = self.new = np.zeros(0, dtype=np.int64)
        self.bits = np.packbits(seen[:0], axis=1)
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.n_waiting, self.least, self.last = 0, -np.inf, np.full(len(members), -1)

    def is_apart(self, sets: np.ndarray) -> np.ndarray:
        """Which sets, or partial ones, share no more with each of apart than they may."""
        ok = np.ones(len(sets), dtype=bool)
        for x in self.apart:
            ok &= np.isin(sets, x).sum(axis=1) <= self.most
        return ok

    def add(self, ids: np.ndarray, labels: np.ndarray, quality: np.ndarray) -> None:
        """Extend every partial set by every candidate. labels: candidates x labels, of 0 and 1."""
        if not len(ids):
            return
        quality, bits = np.round(quality / self.UNIT), np.packbits(labels.astype(bool), axis=1)
        left = np.column_stack([~self.seen * self.weights, self.score, np.ones(len(self.score))])
        right = np.column_stack([labels, np.ones(len(ids)), quality]).astype(float).T
        step = max(1, self.CHUNK // len(ids))
        for i in range(0, len(self.members), step):
            part = slice(i, i + step)
            # No set of the chunk gains more by a candidate than its labels weigh that not all of them have.
            bound = labels @ (self.weights * ~self.seen[part].all(axis=0)) + quality + self.score[part].max()
            near = np.flatnonzero((bound > self.least) | ((bound == self.least) & (ids <= self.last[part].max())))
            if not len(near):
                continue
            value = left[part] @ right[:, near]
            fits = value > self.least
            fits |= (value == self.least) & (ids[near] <= self.last[part, None])
            parent, new = np.nonzero(fits)
            if len(parent):
                self.offer(value[parent, new], parent + i, ids[near[new]], bits[near[new]])

    def offer(self, value: np.ndarray, parent: np.ndarray, new: np.ndarray, bits: np.ndarray) -> None:
        """Take in partial sets by their place, each with a candidate more: its id and its labels in bits."""
        sets = np.sort(np.column_stack([self.members[parent], new]), axis=1)
        ok = (sets[:, 1:] != sets[:, :-1]).all(axis=1) & self.is_apart(sets)
        self.waiting.append((sets[ok], value[ok], parent[ok], new[ok], bits[ok]))
        self.n_waiting += int(ok.sum())
        if self.n_waiting > max(self.CHUNK // 2, self.width):
            self.settle()

    def settle(self) -> Extensions:
        """Keep the best; with width of them, what others have to reach: a value, and for each partial set the last id that ties may add."""
        if self.waiting:
            had = self.sets, self.value, self.parent, self.new, self.bits
            sets, value, parent, new, bits = (np.concatenate(x) for x in zip(had, *self.waiting, strict=True))
            self.waiting, self.n_waiting = [], 0
            rank = np.lexsort((*sets.T[::-1], -value))
            sets = sets[rank]
            first = np.ones(len(sets), dtype=bool)
            first[1:] = (sets[1:] != sets[:-1]).any(axis=1)
            keep = np.flatnonzero(first)[: self.width]
            self.sets, (self.value, self.parent, self.new, self.bits) = sets[keep], (x[rank[keep]] for x in (value, parent, new, bits))
            if len(keep) == self.width:
                self.least = self.value[-1]
                end = np.iinfo(np.int64).max
                padded = np.column_stack([self.members, np.full(len(self.members), end)])
                at = (padded != self.sets[-1]).argmax(axis=1)
                self.last = np.where(padded[np.arange(len(at)), at] < self.sets[-1][at], end, self.sets[-1][at])
        return self

    def seen_by(self) -> np.ndarray:
        """Labels of the sets found."""
        return self.seen[self.parent] | np.unpackbits(self.bits, axis=1, count=self.seen.shape[1]).astype(bool)


def _beam(fill: Callable[[Extensions], Extensions], n: int, weights: np.ndarray, k: int, width: int, diverse: int) -> list[tuple[float, list[int]]]:
    """beam_sets() over n candidates; fill has them all extend the partial sets.

    With many ties, all sets that the last step keeps may be alike. It is repeated for those apart from the results so far, until there are
    enough or no others.
    """
    k = min(k, n)
    if not k:
        return []
    members, seen, score = np.zeros((1, 0), dtype=np.int64), np.zeros((1, len(weights)), dtype=bool), np.zeros(1)
    for _ in range(k - 1):
        found = fill(Extensions(members, seen, score, weights, width))
        members, seen, score = found.sets, found.seen_by(), found.value
    out: list[tuple[float, list[int]]] = []
    while len(out) < diverse:
        found = fill(Extensions(members, seen, score, weights, width, [x for _, x in out]))
        for value, row in zip(found.value, found.sets, strict=True):
            if all(len(set(row) & set(x)) <= k - 2 for _, x in out):
                out.append((float(value) * Extensions.UNIT, row.tolist()))
                if len(out) == diverse:
                    break
        if len(found.value) < width:
            break
    return out


def beam_sets(labels: np.ndarray, weights: np.ndarray, quality: np.ndarray, ids: Sequence[int], k: int, width: int, diverse: int) -> list[tuple[float, list[int]]]:
    """Sets of k candidates by weight of the labels covered and quality, the best first, found by a beam of partial sets.

    labels: candidates x labels, of 0 and 1. A label counts once a set. Every step keeps exactly the width best distinct sets. Results after
    the first share k - 2 members at most with each one before, and are the best such extensions of the last partial sets. Ties go to the
    smaller ids. The number of candidates has a bound, as a step scores width x candidates; beam_sets_over() has none.
    """
    if len(ids) > 20_000:
        raise ValueError("a beam search on the driver takes 20,000 candidates at most")
    each = np.asarray(ids, dtype=np.int64)

    def fill(step: Extensions) -> Extensions:
        step.add(each, labels, quality)
        return step.settle()

    return _beam(fill, len(ids), weights, k, width, diverse)


def beam_sets_over(pool: DataFrame, n: int, weights: np.ndarray, k: int, width: int, diverse: int) -> list[tuple[float, list[int]]]:
    """beam_sets() over a table of n candidates, of any number: id, labels (array<int>: places in weights, each once) and quality.

    Tasks, 64 at most, extend the partial sets by their own candidates, a batch at a time; of each, its width best sets come to the
    driver. As any of the best sets is among the best of its task, the results are those of one task. pool is read for every step.
    """
    pool = pool.select("id", "labels", "quality").coalesce(64)

    def fill(step: Extensions) -> Extensions:
        def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                places = b.column("labels")
                labels = np.zeros((b.num_rows, len(weights)))
                labels[np.repeat(np.arange(b.num_rows), places.value_lengths()), places.flatten()] = 1
                step.add(b.column("id").to_numpy(), labels, b.column("quality").to_numpy())
            best = step.settle()
            if len(best.sets):
                yield pa.RecordBatch.from_pydict({"value": best.value, "parent": best.parent, "new": best.new, "bits": [x.tobytes() for x in best.bits]})

        found = pool.mapInArrow(extend, "value double, parent long, new long, bits binary").toArrow()
        for b in found.to_batches():
            bits = np.frombuffer(b"".join(b.column("bits").to_pylist()), dtype=np.uint8).reshape(b.num_rows, step.bits.shape[1])
            step.offer(b.column("value").to_numpy(), b.column("parent").to_numpy(), b.column("new").to_numpy(), bits)
        return step.settle()

    return _beam(fill, n, weights, k, width, diverse)


def balanced_partition(sizes: dict[str, Sequence[int]], parts: int = 3, fixed: dict[str, int] | None = None) -> dict[str, int]:
    """Groups (at most 5,000) into parts with near-equal totals in every dimension.

    sizes: group -> its total and its label counts. Largest first into the part that
    keeps the deviation smallest, then exchanges while they help; ties by name. fixed: groups that have their part already.
    """
    if len(sizes) > 5000:
        raise ValueError("a partition search takes 5,000 groups at most")
    if not sizes:
        return {}
    fixed = fixed or {}
    names = sorted(sizes, key=lambda g: (g not in fixed, -sizes[g][0], g))
    x = np.array([sizes[g] for g in names], dtype=float).reshape(len(names), -1)
    want = x.sum(axis=0) / parts
    scale = np.maximum(want, 1.0)
    part = np.zeros(len(names), dtype=int)
    total = np.zeros((parts, x.shape[1]))
    cost = lambda t: (((t - want) / scale) ** 2).sum()
    for i in range(len(names)):
        part[i] = fixed[names[i]] if names[i] in fixed else min(range(parts), key=lambda p: (((total[p] + x[i] - want) / scale) ** 2).sum() - (((total[p] - want) / scale) ** 2).sum())
        total[part[i]] += x[i]
    for _ in range(20):
        moved = False
        for i in range(len(fixed), len(names)):
            now = cost(total)
            for j in range(i + 1, min(len(names), i + 200)):
                a, b = part[i], part[j]
                if a == b:
                    continue
                d = x[j] - x[i]
                total[a] += d
                total[b] -= d
                if cost(total) < now - 1e-12:
                    part[i], part[j], moved = b, a, True
                    break
                total[a] -= d
                total[b] += d
        if not moved:
            break
    return {g: int(p) for g, p in zip(names, part, strict=True)}
