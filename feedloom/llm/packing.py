"""Filling containers of fixed capacity with whole texts.

Sizes are whole numbers up to the capacity, so the plan is made on histograms of sizes,
whose length the capacity bounds, and never on the texts themselves:

1. Linear grouping: sizes above a share of the capacity (the best of a few) are cut into groups of equally many
   items, and every item counts as large as the largest of its group.
2. Few-size configurations: column generation finds the mix of group combinations that
   needs the fewest containers.
3. The actual items, by rank in their group, take the slots; that leaves a little more room
   than the rounded sizes promised.
4. What is left over and the small items go where they fit best, largest first.

The plan is a table of runs, "items i of size s from lo on go to container base + (i - lo + off)
div per"; each item finds its run by its rank among the items of its size.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators.prefix_scan import prefix_scan


@dataclass
class PackPlan:
    """Runs per size, and how many containers there are."""

    capacity: int
    containers: int = 0
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)  # size, lo, hi, base, off, per


def equal_groups(sizes: np.ndarray, counts: np.ndarray, groups: int) -> list[list[tuple[int, int, int]]]:
    """Groups of about equally many items, largest sizes first; segments (size, lo, hi) of item ranks."""
    total = int(counts.sum())
    each = max(1, -(-total // groups))
    out: list[list[tuple[int, int, int]]] = [[]]
    room = each
    for s, n in zip(sizes[::-1].tolist(), counts[::-1].tolist()):
        lo = 0
        while lo < n:
            take = min(room, n - lo)
            out[-1].append((s, lo, lo + take))
            lo, room = lo + take, room - take
            if not room:
                out.append([])
                room = each
    return [g for g in out if g]


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The combination of most worth that fits: an unbounded knapsack by dynamic programming, or a search for the
    best pair where no three items fit, and for the best three where no four do."""
    if 3 * int(sizes.min()) > capacity:
        return _best_pair(sizes, worth, capacity)
    if 4 * int(sizes.min()) > capacity:
        return _best_three(sizes, worth, capacity)
    best = np.zeros(capacity + 1)
    for g in np.flatnonzero(worth > 1e-12):
        s = int(sizes[g])
        for _ in range(capacity // s):
            more = best[:-s] + worth[g]
            better = more > best[s:] + 1e-12
            if not better.any():
                break
            best[s:][better] = more[better]
    # Walk the values back to the items: at each room, the last size at which the value was made.
    pattern = np.zeros(len(sizes), np.int64)
    at = int(np.searchsorted(best, best[-1] - 1e-9))
    while at > 0 and best[at] > 1e-12:
        before = at - sizes
        made = np.flatnonzero((before >= 0) & (np.abs(best[np.maximum(before, 0)] + worth - best[at]) < 1e-9))
        if not len(made):
            break
        pattern[made[0]] += 1
        at = int(np.searchsorted(best, best[before[made[0]]] - 1e-9))
    return pattern


def _best_pair(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The same where a pattern has two items at most."""
    order = np.argsort(sizes, kind="stable")
    small = sizes[order]
    top = np.maximum.accumulate(worth[order])
    fits = np.searchsorted(small, capacity - sizes, side="right")
    partner = np.where(fits > 0, top[np.maximum(fits - 1, 0)], 0.0)
    both = worth + partner
    best = int(both.argmax())
    pattern = np.zeros(len(sizes), np.int64)
    pattern[best] = 1
    if fits[best] and partner[best] > 1e-12:
        pattern[order[worth[order[: fits[best]]].argmax()]] += 1
    return pattern


def _best_three(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The same where a pattern has three items at most: every two with the best third that still fits.  Only
    sizes worth more than all smaller ones are tried, as a smaller one of no less worth could stand for any other."""
    order = np.lexsort((-worth, sizes))
    most = np.maximum.accumulate(worth[order])
    kept = order[np.append(most[0] > 1e-12, (most[1:] > most[:-1]) & (most[1:] > 1e-12))]
    pattern = np.zeros(len(sizes), np.int64)
    if not len(kept):
        return pattern
    s, top = sizes[kept], np.append(0.0, worth[kept])
    fits = np.searchsorted(s, np.arange(capacity + 1), side="right")  # how many of them fit a room; the last is the best
    best = top[fits]
    room = capacity - s[:, None] - s
    three = np.where(room >= 0, top[1:, None] + top[1:] + best[np.maximum(room, 0)], -1.0)
    two = top[1:] + best[capacity - s]
    if two.max() >= three.max():
        a = int(two.argmax())
        held = [a, int(fits[capacity - s[a]]) - 1]
    else:
        a, b = divmod(int(three.argmax()), len(s))
        held = [a, b, int(fits[room[a, b]]) - 1]
    for i in held:
        if i >= 0:
            pattern[kept[i]] += 1
    return pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 20_000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each: the relaxed optimum, by a simplex with generated columns."""
    k = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    cost = np.ones(k)
    x = inverse @ demand
    for _ in range(rounds):
        price = cost @ inverse
        if price.min() < -1e-9:  # more of a size than asked for costs nothing
            enter, c = -np.eye(k)[int(price.argmin())], 0.0
        else:
            enter = _best_pattern(sizes, np.maximum(price, 0), capacity).astype(float)
            c = 1.0
            if price @ enter <= 1 + 1e-7:
                break
        step = inverse @ enter
        up = step > 1e-10
        if not up.any():
            break
        ratio = np.full(k, np.inf)
        ratio[up] = x[up] / step[up]
        out = int(ratio.argmin())
        theta = ratio[out]
        x = x - theta * step
        x[out] = theta
        cost[out] = c
        columns[:, out] = enter
        inverse[out] /= step[out]
        step[out] = 0.0
        inverse -= np.outer(step, inverse[out])
        x = np.maximum(x, 0)
    return [(columns[:, i].astype(np.int64), float(x[i])) for i in range(k) if cost[i] > 0 and x[i] > 1e-9]


class _Room:
    """Containers by free room: equal ones lie together as (base, count)."""

    def __init__(self) -> None:
        self.free: list[int] = []
        self.at: dict[int, list[tuple[int, int]]] = {}

    def add(self, free: int, base: int, count: int) -> None:
        if count and free:
            if free not in self.at:
                bisect.insort(self.free, free)
                self.at[free] = []
            self.at[free].append((base, count))

    def take(self, size: int) -> tuple[int, int, int] | None:
        """(free, base, count) of the containers in which ``size`` fits best."""
        i = bisect.bisect_left(self.free, size)
        if i == len(self.free):
            return None
        free = self.free[i]
        base, count = self.at[free].pop()
        if not self.at[free]:
            del self.at[free]
            self.free.pop(i)
        return free, base, count


#: Shares of the capacity up to which an item counts as small.
SMALL = (1 / 4, 1 / 3, 2 / 5)


def plan_packing(capacity: int, sizes: np.ndarray, counts: np.ndarray, groups: int = 320, small: Sequence[float] = SMALL) -> PackPlan:
    """The plan with the fewest containers over the given bounds of small items."""
    plans = [_plan(capacity, sizes, counts, groups, s) for s in small]
    return min(plans, key=lambda p: p.containers)


def _plan(capacity: int, sizes: np.ndarray, counts: np.ndarray, groups: int, small: float) -> PackPlan:
    """Plan for ``counts`` items of each of ``sizes`` (ascending, 1..capacity)."""
    plan, room = PackPlan(capacity), _Room()
    big = sizes > max(capacity * small, 1)
    left: list[tuple[int, int, int]] = [(int(s), 0, int(n)) for s, n in zip(sizes[~big], counts[~big])]
    if big.any():
        parts = equal_groups(sizes[big], counts[big], groups)
        parts = [sum(alike, []) for _, alike in groupby(parts, key=lambda g: g[0][0])]  # equally large groups are one
        tops = np.array([g[0][0] for g in parts])
        demand = np.array([sum(hi - lo for _, lo, hi in g) for g in parts], float)
        left += _fill_configurations(plan, room, parts, configurations(tops, demand, capacity))
    for size, lo, hi in sorted(left, reverse=True):
        _best_fit(plan, room, size, lo, hi)
    return plan


def _fill_configurations(plan: PackPlan, room: _Room, parts: list[list[tuple[int, int, int]]], chosen: list[tuple[np.ndarray, float]]) -> list[tuple[int, int, int]]:
    """Give the slots of whole configurations to the groups' items; returns the items without a slot."""
    seg, done = [0] * len(parts), [0] * len(parts)  # how far each group is used up

    def slots(g: int, n: int) -> list[tuple[int, int, int]]:
        """The next ``n`` items of the group, or as many as there are."""
        out = []
        while n and seg[g] < len(parts[g]):
            s, lo, hi = parts[g][seg[g]]
            start = lo + done[g]
            take = min(n, hi - start)
            out.append((s, start, start + take))
            n -= take
            done[g] += take
            if start + take == hi:
                seg[g], done[g] = seg[g] + 1, 0
        return out

    for pattern, times in chosen:
        copies = int(times + 1e-6)
        if not copies:
            continue
        base = plan.containers
        plan.containers += copies
        cuts, filled = {0, copies}, []
        for g in np.flatnonzero(pattern):
            per, at = int(pattern[g]), 0
            ends, held = [], []
            for s, lo, hi in slots(g, copies * per):
                plan.runs.append((s, lo, hi, base, at, per))
                at += hi - lo
                ends.append(at)
                held.append(s)
                cuts |= {at // per, -(-at // per)}
            filled.append((per, ends, held))
        edges = sorted(c for c in cuts if c <= copies)
        for a, b in zip(edges, edges[1:]):
            used = 0
            for per, ends, held in filled:
                for slot in range(a * per, (a + 1) * per):
                    i = bisect.bisect_right(ends, slot)
                    used += held[i] if i < len(held) else 0
            room.add(plan.capacity - used, base + a, b - a)
    rest = []
    for g, part in enumerate(parts):
        for i in range(seg[g], len(part)):
            s, lo, hi = part[i]
            start = lo + (done[g] if i == seg[g] else 0)
            if start < hi:
                rest.append((s, start, hi))
    return rest


def _best_fit(plan: PackPlan, room: _Room, size: int, lo: int, hi: int) -> None:
    while lo < hi:
        found = room.take(size)
        if found is None:
            per = plan.capacity // size
            count = -(-(hi - lo) // per)
            found = plan.capacity, plan.containers, count
            plan.containers += count
        free, base, count = found
        per = free // size
        full = min(count, (hi - lo) // per)
        if full:
            plan.runs.append((size, lo, lo + full * per, base, 0, per))
            room.add(free - per * size, base, full)
            lo, base, count = lo + full * per, base + full, count - full
        if count and lo < hi:
            rest = hi - lo
            plan.runs.append((size, lo, hi, base, 0, rest))
            room.add(free - rest * size, base, 1)
            lo, base, count = hi, base + 1, count - 1
        room.add(free, base, count)


def pack(items: DataFrame, packs: DataFrame, item: str, size: str, name: str, capacity: str, groups: int = 320, small: Sequence[float] = SMALL) -> DataFrame:
    """One row per piece: pack, ``container_id``, item, ``piece`` (0, 1, ...), ``first_token``, ``tokens``.

    An item longer than a container is cut into full containers and one remainder; no other item is
    cut.  Items with null or no size need no room and give no rows; packs with null or no capacity
    give none.  Repeated items are packed as often as they come.  The driver holds the packs and,
    per pack, counts per size, at most ``capacity`` of them, never anything per item.
    """
    spark = items.sparkSession
    wanted = [(r[0], r[1]) for r in packs.where(F.col(capacity) > 0).select(name, F.col(capacity).cast("bigint")).distinct().collect()]
    if not wanted:
        kinds = {name: packs.schema[name].dataType.simpleString(), item: items.schema[item].dataType.simpleString()}
        return spark.createDataFrame([], f"`{name}` {kinds[name]}, container_id bigint, `{item}` {kinds[item]}, piece bigint, first_token bigint, tokens bigint")
    number = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).cast("bigint").alias("c")) for i, (_, c) in enumerate(wanted)])
    rows = items.where(F.col(size) > 0).select(F.col(item).alias("id"), F.col(size).cast("bigint").alias("n"), F.explode(number).alias("p"))
    rows = rows.select("id", "n", F.col("p.i").alias("i"), F.col("p.c").alias("c"), (F.col("n") % F.col("p.c")).alias("r"))
    hist = rows.groupBy("i", "r").agg(F.count(F.lit(1)).alias("k"), F.sum(F.call_function("div", F.col("n"), F.col("c"))).alias("full")).collect()
    plans, full = [], []
    for i, (_, c) in enumerate(wanted):
        mine = sorted((h.r, h.k) for h in hist if h.i == i and h.r > 0)
        plans.append(plan_packing(c, np.array([r for r, _ in mine], np.int64), np.array([k for _, k in mine], np.int64), groups, small))
        full.append(sum(h.full for h in hist if h.i == i))

    # All runs in one array, found by binary search on (pack, size, rank).
    table = np.array(sorted((i, *run) for i, p in enumerate(plans) for run in p.runs) or np.zeros((0, 7)), np.int64).reshape(-1, 7)
    sent = spark.sparkContext.broadcast(table)

    @F.pandas_udf("bigint")
    def container(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        t = sent.value
        width = int(t[:, 2].max()) + 1 if len(t) else 1
        group = t[:, 0] * (int(t[:, 1].max()) + 1 if len(t) else 1) + t[:, 1]
        line = np.unique(group, return_inverse=True)
        keys = line[1] * width + t[:, 2]
        top = int(t[:, 1].max()) + 1 if len(t) else 1
        for i, r, rank in batches:
            at = np.searchsorted(line[0], i.to_numpy() * top + r.to_numpy())
            run = np.searchsorted(keys, at * width + np.minimum(rank.to_numpy(), width - 1), side="right") - 1
            x = t[run]
            yield pd.Series(x[:, 4] + (rank.to_numpy() - x[:, 2] + x[:, 5]) // x[:, 6])

    # Rank of each remainder among those of its size, and number of each full piece in its pack.
    rest = prefix_scan(rows.where(F.col("r") > 0), ["i", "r"], ["id"], {"rank": (F.lit(1).cast("bigint"), "sum")})
    rest = rest.select("i", "id", F.call_function("div", F.col("n"), F.col("c")).alias("piece"), (F.col("n") - F.col("r")).alias("first"), F.col("r").alias("len"), container(F.col("i").cast("bigint"), "r", F.coalesce("rank", F.lit(0).cast("bigint"))).alias("container_id"))
    opened = F.element_at(F.array(*[F.lit(p.containers).cast("bigint") for p in plans]), F.col("i") + 1)
    whole = prefix_scan(rows.where(F.col("n") >= F.col("c")), ["i"], ["id"], {"before": (F.call_function("div", F.col("n"), F.col("c")), "sum")})
    whole = whole.select("i", "id", "c", opened.alias("opened"), F.coalesce("before", F.lit(0).cast("bigint")).alias("before"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("n"), F.col("c")) - 1)).alias("piece"))
    whole = whole.select("i", "id", "piece", (F.col("piece") * F.col("c")).alias("first"), F.col("c").alias("len"), (F.col("opened") + F.col("before") + F.col("piece")).alias("container_id"))
    label = F.element_at(F.array(*[F.lit(n) for n, _ in wanted]), F.col("i") + 1)
    return rest.unionByName(whole).select(label.alias(name), "container_id", F.col("id").alias(item), "piece", F.col("first").alias("first_token"), F.col("len").alias("tokens"))
