"""Pearson, Spearman and Kendall correlations of numeric columns."""

from __future__ import annotations

import itertools
import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.families import choice, col, families, value
from ..plans.kernel import rounded, table
from ..plans.ranks import bounds_of, ranked

METHODS = ("pearson", "spearman", "kendall")
CELLS, AT_ONCE = 24, 4  # sums per aggregate: with more of them the generated code is too long for the JIT; and jobs at a time
LOOKUP = 10_000  # a column with so many values has its ranks made on the driver and broadcast
KENDALL_ROWS = 1_000_000  # distinct pairs of values that come to the driver at most; beyond: sample first

Pair = tuple[str, str]
View = tuple[str, frozenset]  # a column in those rows where others, which have nulls, are given


def numeric_frame(df: DataFrame) -> DataFrame:
    fams = families(df)
    return df.select(*(value(f.name, "numeric", f).alias(f.name) for f in df.schema.fields if fams[f.name] == "numeric"))


def _ask(df: DataFrame, cells: list[Column]) -> list:
    """The aggregates ``cells``, CELLS per job."""

    def one(k: int) -> list:
        return list(df.agg(*(c.alias(f"c{i}") for i, c in enumerate(cells[k : k + CELLS]))).first())

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [v for part in pool.map(one, range(0, len(cells), CELLS)) for v in part]


def _given(rows: frozenset) -> Column:
    """Whether all columns of ``rows`` are given."""
    out = F.lit(True)
    for c in sorted(rows):
        out &= col(c).isNotNull()
    return out


def _views(pairs: list[Pair], nulls: dict[str, int]) -> dict[Pair, frozenset]:
    """Which columns' nulls decide a pair's complete rows: pairs with the same ones share what is known of their columns there."""
    return {p: frozenset(c for c in p if nulls[c]) for p in pairs}


def _r(sxy: float | None, sxx: float | None, syy: float | None) -> float | None:
    """None on a constant and where a sum is no number."""
    if sxy is None or not sxx or not syy or not (d := math.sqrt(sxx) * math.sqrt(syy)) or math.isnan(r := sxy / d):
        return None
    return max(-1.0, min(1.0, r))


def pearson_pairs(df: DataFrame, pairs: list[Pair]) -> dict[Pair, tuple[float | None, int]]:
    """r and the number of complete rows for all pairs: means first, then sums of products of what is left without them."""
    names = sorted({c for p in pairs for c in p})
    if not names:
        return {}
    masks = _views(pairs, dict(zip(names, _ask(df, [F.count_if(col(c).isNull()) for c in names]), strict=True)))
    views: list[View] = list(dict.fromkeys((c, masks[p]) for p in pairs for c in p))
    x = {w: F.when(_given(w[1]), col(w[0]).cast("double")) if w[1] else col(w[0]).cast("double") for w in views}
    got = _ask(df, [f(x[w]) for w in views for f in (F.count, F.avg, F.min, F.max)])
    n, mean, low, high = ({w: got[4 * i + k] for i, w in enumerate(views)} for k in range(4))
    live = {w for w in views if n[w] and low[w] != high[w]}
    off = {w: x[w] - F.lit(mean[w]) for w in live}
    both = {p: ((p[0], m), (p[1], m)) for p, m in masks.items()}
    ask = [p for p, (a, b) in both.items() if a in live and b in live]
    used = [w for w in views if any(w in both[p] for p in ask)]
    sums = _ask(df, [F.sum(off[w] * off[w]) for w in used] + [F.sum(off[a] * off[b]) for a, b in (both[p] for p in ask)])
    square, product = dict(zip(used, sums)), dict(zip(ask, sums[len(used) :], strict=True))  # noqa: B905
    return {p: (_r(product[p], square[a], square[b]) if p in product else None, n[a]) for p, (a, b) in both.items()}


def spearman_pairs(df: DataFrame, pairs: list[Pair]) -> dict[Pair, tuple[float | None, int]]:
    """The same of average ranks, which are taken among the complete rows of a pair; pairs that share these rows share the ranks.

    Columns of up to LOOKUP values get their ranks by a broadcast. The rows are grouped once by each other column, with the sums of
    the ranks known so far: these times the group's own ranks are the sums of products. Only where one such column has yet to meet
    another are its ranks joined to the rows.
    """
    names = sorted({c for p in pairs for c in p})
    if not names:
        return {}
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.select(*(col(c).alias(c) for c in names))
    got = _ask(df, [f for c in names for f in (F.count_if(col(c).isNull()), F.approx_count_distinct(col(c)))])
    nulls, about = ({c: got[2 * i + k] for i, c in enumerate(names)} for k in (0, 1))
    masks = _views(pairs, nulls)
    rows = list(dict.fromkeys(masks.values()))
    n = dict(zip(rows, _ask(df, [F.count_if(_given(m)) for m in rows]), strict=True))
    of = {c: list(dict.fromkeys(m for p, m in masks.items() if c in p)) for c in names}
    name = {(c, m): f"_r_{i}_{rows.index(m)}" for i, c in enumerate(names) for m in of[c]}
    square: dict[View, float | None] = {}
    product: dict[Pair, float | None] = {}
    done: set[str] = set()
    held: list[DataFrame] = []

    def counts(part: DataFrame, c: str, *more: Column) -> DataFrame:
        return part.where(col(c).isNotNull()).groupBy(col(c).alias("v")).agg(*(F.count_if(_given(m)).alias(f"c{k}") for k, m in enumerate(of[c])), *more)

    for c in names:
        if about[c] > LOOKUP * 1.2 or len(found := counts(df, c).limit(LOOKUP + 1).collect()) > LOOKUP:
            continue
        found.sort(key=lambda r: r.v)
        ranks: list[list] = [[float(r.v)] for r in found]
        for k, m in enumerate(of[c]):
            before, total = 0, 0.0
            for row, r in zip(ranks, found, strict=True):
                here = r[f"c{k}"]
                row.append(before + (here + 1) / 2 - (n[m] + 1) / 2)
                before, total = before + here, total + here * row[-1] ** 2
            square[c, m] = total
        known = table(df, ranks, ", ".join(["_v double", *(f"{name[c, m]} double" for m in of[c])]))
        df = df.join(F.broadcast(known), col(c).cast("double") == F.col("_v"), "left").drop("_v")
        done.add(c)
    few = [p for p in pairs if p[0] in done and p[1] in done]
    in_rows = lambda c, m: F.when(_given(m), F.col(name[c, m])) if m else F.col(name[c, m])
    product |= zip(few, _ask(df, [F.sum(in_rows(p[0], masks[p]) * F.col(name[p[1], masks[p]])) for p in few]) if few else [], strict=True)
    many = sorted((c for c in names if c not in done), key=lambda c: about[c])
    bounds = dict(zip(many, _ask(df, [bounds_of(col(c), parts) for c in many]) if many and parts > 1 else [None] * len(many), strict=True))
    for c in many:
        meets = [(p, p[0] if p[1] == c else p[1]) for p in pairs if c in p and p not in product and {*p} - {c} <= done]
        sums = [F.coalesce(F.sum(in_rows(b, masks[p])), F.lit(0.0)).alias(f"s{i}") for i, (p, b) in enumerate(meets)]
        held.append(grouped := counts(df, c, *sums).persist())  # read several times: its ranges' totals, the ranks, and the rows that get them
        own = ranked(grouped, [f"c{k}" for k in range(len(of[c]))], bounds[c] or [])
        off = {m: F.col(f"rank_c{k}") - (n[m] + 1) / 2 for k, m in enumerate(of[c])}
        got = _ask(own, [F.sum(F.col(f"c{k}") * off[m] * off[m]) for k, m in enumerate(of[c])] + [F.sum(off[masks[p]] * F.col(f"s{i}")) for i, (p, _) in enumerate(meets)])
        square |= {(c, m): v for m, v in zip(of[c], got, strict=False)}
        product |= zip((p for p, _ in meets), got[len(of[c]) :], strict=True)
        done.add(c)
        if any(p not in product for p in pairs if c in p):
            df = df.join(own.select(F.col("v").alias("_v"), *(off[m].alias(name[c, m]) for m in of[c])), col(c) == F.col("_v"), "left").drop("_v")
    for grouped in held:
        grouped.unpersist()
    return {p: (_r(product[p], square[p[0], m], square[p[1], m]) if n[m] else None, n[m]) for p, m in masks.items()}


def tau_b(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float | None:
    """Kendall's tau-b of weighted points in n log n: discordant pairs by a tree of counts over the ranks of y."""
    total = float(n.sum())
    pairs = total * (total - 1) / 2
    tie = lambda keys: sum(c * (c - 1) / 2 for c in np.bincount(np.unique(keys, return_inverse=True)[1], n))
    tx, ty, txy = tie(x), tie(y), float((n * (n - 1) / 2).sum())
    order = np.lexsort((y, x))
    x, n = x[order], n[order]
    rank = np.unique(y, return_inverse=True)[1][order] + 1
    tree = [0.0] * (int(rank.max()) + 1 if len(rank) else 1)
    discordant, seen, i = 0.0, 0.0, 0
    while i < len(x):
        j = i
        while j < len(x) and x[j] == x[i]:
            below, k = 0.0, int(rank[j])
            while k:
                below += tree[k]
                k &= k - 1
            discordant += n[j] * (seen - below)
            j += 1
        for m in range(i, j):
            k = int(rank[m])
            while k < len(tree):
                tree[k] += n[m]
                k += k & -k
            seen += n[m]
        i = j
    base = math.sqrt((pairs - tx) * (pairs - ty))
    return (pairs - tx - ty + txy - 2 * discordant) / base if base else None


def kendall_pairs(df: DataFrame, pairs: list[Pair], most: int = KENDALL_ROWS) -> dict[Pair, tuple[float | None, int]]:
    """Exact tau-b from the counts of distinct value pairs."""
    out: dict[Pair, tuple[float | None, int]] = {}
    for a, b in pairs:
        counts = df.where(col(a).isNotNull() & col(b).isNotNull()).groupBy(col(a).alias("x"), col(b).alias("y")).agg(F.count("*").cast("double").alias("c"))
        rows = counts.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"kendall: {a} and {b} have over {most} distinct pairs of values; sample the rows first")
        x, y, n = (np.array(v, float) for v in zip(*rows, strict=True)) if rows else (np.zeros(0),) * 3
        out[a, b] = (tau_b(x, y, n) if len(rows) else None, int(n.sum()))
    return out


def compute(df: DataFrame, method: str) -> dict[Pair, float | None]:
    nums = numeric_frame(df)
    if len(nums.columns) < 2:
        raise ValueError("correlations need at least two numeric columns")
    pairs = list(itertools.combinations(nums.columns, 2))
    run = {"pearson": pearson_pairs, "spearman": spearman_pairs, "kendall": kendall_pairs}[method]
    return {p: r for p, (r, _) in run(nums, pairs).items()}


def correlations(df: DataFrame, method: str = "pearson", by: str = "matrix", threshold: float | None = None) -> DataFrame:
    """matrix: column, then one column per numeric column; pairs: column_a, column_b, correlation, r_squared by strength."""
    method, by = choice(method, METHODS, "method"), choice(by, ("matrix", "pairs"), "by")
    found = {p: rounded(r, 4) for p, r in compute(df, method).items()}
    if by == "pairs":
        rows = [(a, b, r, rounded(r * r, 4)) for (a, b), r in found.items() if r is not None and (threshold is None or abs(r) >= threshold)]
        rows.sort(key=lambda r: (-abs(r[2]), r[0], r[1]))
        return table(df, rows, "column_a string, column_b string, correlation double, r_squared double")
    names = list(dict.fromkeys(c for p in found for c in p))
    both = found | {(b, a): r for (a, b), r in found.items()}
    # a column that correlates with nothing is constant or empty: its own cell is null too
    own = {c: 1.0 if any(both.get((c, d)) is not None for d in names) or len(names) < 2 else None for c in names}
    rows = [(c, *(own[c] if c == d else both[c, d] for d in names)) for c in names]
    return table(df, rows, "column string, " + ", ".join(f"`{n.replace('`', '``')}` double" for n in names))
