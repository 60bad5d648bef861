"""Exact percentiles of many columns without sorting them and without gathering their distinct values in one task.

Each wanted order statistic is narrowed to an open interval of values: a sketch gives bounds, a count says where they lie, and what
is strictly between them (a few parts in ten thousand of the rows) is gathered, or narrowed again while it is too much. Ties
stay outside, as bounds are values that occur. All columns go through the same aggregates; nothing is shuffled but sketches,
counts and at most HELD values per statistic.
"""

from __future__ import annotations

import math
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HELD = 20_000
ACCURACY = 10_000  # a sketch misses a rank by one part in so many
EACH, AT_ONCE = 20, 4  # order statistics per aggregate, aggregates at a time


@dataclass
class _Target:
    column: int
    index: int  # from 0, of the sorted values
    first: int  # index of the first value between the bounds
    between: int
    lo: float | None = None
    hi: float | None = None
    margin: float = 2 / ACCURACY
    found: float | None = None

    def inside(self, x: Column) -> Column:
        out = x.isNotNull()
        if self.lo is not None:
            out &= x > self.lo
        if self.hi is not None:
            out &= x < self.hi
        return out


def _ask(df: DataFrame, cells: list[Column]) -> list:
    return list(df.agg(*(c.alias(f"c{i}") for i, c in enumerate(cells))).first())


def _narrow(df: DataFrame, xs: list[Column], part: list[_Target]) -> list[tuple[float, float]]:
    """Bounds for each target, from one sketch per column and interval."""
    groups: dict[tuple, list[_Target]] = defaultdict(list)
    for t in part:
        groups[t.column, t.lo, t.hi].append(t)
    cells, bounds = [], {}
    for ts in groups.values():
        ps = []
        for t in ts:
            at, step = (t.index - t.first) / t.between, 1 / t.between
            ps += [max(0.0, at - step - t.margin), min(1.0, at + 2 * step + t.margin)]
        x = xs[ts[0].column]
        cells.append(F.percentile_approx(F.when(ts[0].inside(x), x), ps, ACCURACY))
    for ts, got in zip(groups.values(), _ask(df, cells), strict=True):
        for k, t in enumerate(ts):
            bounds[id(t)] = (got[2 * k], got[2 * k + 1])
    return [bounds[id(t)] for t in part]


def _settle(df: DataFrame, xs: list[Column], part: list[_Target], sizes: list[int], held: int) -> None:
    wide = [t for t in part if t.between > held]
    if wide:
        _place(df, xs, wide, sizes)
    groups: dict[tuple, list[_Target]] = defaultdict(list)
    for t in part:
        if t.found is None and t.between <= held:
            groups[t.column, t.lo, t.hi].append(t)
    if not groups:
        return
    some, cells = None, []
    for (i, *_), ts in groups.items():
        c = ts[0].inside(xs[i])
        some = c if some is None else some | c
        cells.append(F.sort_array(F.collect_list(F.when(c, xs[i]))))
    for ts, values in zip(groups.values(), _ask(df.where(some), cells), strict=True):
        for t in ts:
            t.found = values[t.index - t.first]


def _place(df: DataFrame, xs: list[Column], part: list[_Target], sizes: list[int]) -> None:
    """Narrows each target's interval, or finds it on a bound."""
    near = _narrow(df, xs, part)
    counts = _ask(df, [F.count_if(c) for t, (lo, hi) in zip(part, near, strict=True) for x in (xs[t.column],) for c in (x < lo, x <= lo, x < hi, x <= hi)])
    for k, (t, (lo, hi)) in enumerate(zip(part, near, strict=True)):
        below, upto, before, last = counts[4 * k : 4 * k + 4]
        if below <= t.index < upto:
            t.found = lo
        elif before <= t.index < last:
            t.found = hi
        elif upto <= t.index < before:
            t.lo, t.hi, t.first, t.between = lo, hi, upto, before - upto
        else:  # the sketch was further off than it says: start again with wider bounds
            t.lo = t.hi = None
            t.first, t.between, t.margin = 0, sizes[t.column], t.margin * 8


def exact_percentiles(df: DataFrame, xs: list[Column], sizes: list[int], wanted: tuple[float, ...], held: int = HELD) -> list[list[float] | None]:
    """Per double column (nulls left out, ``sizes`` values otherwise) its percentiles by linear interpolation; None for an empty one."""
    targets: dict[tuple[int, int], _Target] = {}
    places = []
    for i, n in enumerate(sizes):
        own = []
        for p in wanted if n else ():
            pos = p * (n - 1)
            a, b = math.floor(pos), math.ceil(pos)
            for k in (a, b):
                targets.setdefault((i, k), _Target(i, k, 0, n))
            own.append((a, b, pos))
        places.append(own)
    todo = list(targets.values())
    while todo:
        with ThreadPoolExecutor(AT_ONCE) as pool:  # each part has its own targets
            list(pool.map(lambda k: _settle(df, xs, todo[k : k + EACH], sizes, held), range(0, len(todo), EACH)))
        todo = [t for t in todo if t.found is None]

    def between(i: int, a: int, b: int, pos: float) -> float:
        x, y = targets[i, a].found, targets[i, b].found
        return x if a == b or x == y else (b - pos) * x + (pos - a) * y

    return [[between(i, *w) for w in own] if own else None for i, own in enumerate(places)]
