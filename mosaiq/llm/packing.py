"""Problem 7: filling fixed-capacity containers with items, by bin completion over the histogram of sizes."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from time import perf_counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.runtime import Scratch, ship

#: A filling: ((size, copies), ...), sizes falling. A plan: [(filling, containers)].
Filling = tuple[tuple[int, int], ...]

#: Each further round of a search has so many times the effort.
WIDER = 4
#: Ranks within one size are counted in blocks of about this many rows.
BLOCK = 1_000_000


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of: all sizes over the capacity; and, for each k, containers that items above capacity - k fill alone, plus
    what the items down to k need beyond the room beside those above half (Martello and Toth's L2)."""
    sizes = np.zeros(capacity + 2, np.int64)
    for size, n in counts.items():
        sizes[size] = n
    number, weight = np.cumsum(sizes), np.cumsum(sizes * np.arange(capacity + 2))
    best = -(-int(weight[capacity]) // capacity)
    half = capacity // 2
    for k in range(0, half + 1):
        alone = int(number[capacity] - number[capacity - k])
        large = int(number[capacity - k] - number[half])
        room = large * capacity - int(weight[capacity - k] - weight[half])
        small = int(weight[half] - (weight[k - 1] if k else 0))
        best = max(best, alone + large + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on the histogram: containers filled alike are one entry with a number."""
    room: dict[int, Counter] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        for r in sorted(x for x in room if x >= size):
            if not left:
                break
            fits = r // size
            for filling, n in sorted(room.pop(r).items()):
                use = min(n, left // fits)
                left -= use * fits
                if use:
                    room.setdefault(r - fits * size, Counter())[(*filling, (size, fits))] += use
                if n > use and 0 < left < fits:
                    room.setdefault(r - left * size, Counter())[(*filling, (size, left))] += 1
                    left, use = 0, use + 1
                if n > use:
                    room.setdefault(r, Counter())[filling] += n - use
        fits = capacity // size
        if left >= fits:
            room.setdefault(capacity - fits * size, Counter())[((size, fits),)] += left // fits
        if left % fits:
            room.setdefault(capacity - left % fits * size, Counter())[((size, left % fits),)] += 1
    return sorted((f, n) for c in room.values() for f, n in c.items())


@dataclass(frozen=True)
class Effort:
    """How far the search goes; each limit may be None, which is none.

    The first round enumerates `steps` steps of a node's fillings and tries `branches` of them, at `nodes` nodes; further
    rounds have WIDER times as much of each, until a round has left nothing out or `seconds` are over. EXACT has no limit:
    one round of all undominated fillings, each for any number of containers, which ends with a proof, but may take
    exponential time.
    """

    steps: int | None = 600
    branches: int | None = 3
    nodes: int | None = 4_000
    seconds: float | None = 5.0

    def times(self, factor: int) -> tuple[float, float, float]:
        return tuple(math.inf if x is None else x * factor for x in (self.steps, self.branches, self.nodes))

    @property
    def exact(self) -> bool:
        return self.steps is None and self.branches is None and self.nodes is None


EXACT = Effort(None, None, None, None)


@dataclass(frozen=True)
class Packing:
    """A plan, a number of containers that no plan goes below, and what is known of the plan.

    proof: `bound` if it reaches the lower bound of the sizes, `search` if a round that left nothing out found no better one;
    else `none`, as the effort was spent.
    """

    plan: list[tuple[Filling, int]]
    bound: int
    proof: str

    @property
    def containers(self) -> int:
        return sum(n for _, n in self.plan)


def completions(left: list[int], room: int, most_steps: float = math.inf, branches: float = math.inf) -> tuple[list[tuple[int, Filling]], bool]:
    """(waste, filling) of undominated ways to fill `room` from the items left, least waste first; and whether these are all.

    left[s] is the number of items of size s. A filling is dominated if some item outside of it can replace a part of it
    that is not larger and leave the container no fuller than it is: the replaced items fit wherever that item would. An
    item of exactly the room dominates all others. The walk takes larger items first and ends after most_steps steps or
    with as many perfect fillings as branches; then, or if it finds more than branches, these aren't all.
    """
    if room <= 0 or not any(left[1 : room + 1]):
        return [(room, ())], True
    if left[room]:
        return [(0, ((room, 1),))], True
    below = [0] * (room + 1)  # the largest size left up to here
    for x in range(1, room + 1):
        below[x] = x if left[x] else below[x - 1]
    found: list[tuple[int, Filling]] = []
    steps = perfect = 0
    stack = [(room, below[room], ())]
    while stack and steps < most_steps:
        steps += 1
        r, top, chosen = stack.pop()
        size = below[min(r, top)]
        if not size:
            taken = dict(chosen)
            parts = [(s, s + 1) for s in taken] + [(a + b, a + b) for a, b in combinations(taken, 2)] + [(2 * s, 2 * s) for s, n in chosen if n > 1]
            better = ((below[min(room, total + r)], least) for total, least in parts)
            if not any(other >= least and left[other] > taken.get(other, 0) for other, least in better):
                perfect += not r
                found.append((r, chosen))
                if perfect >= branches:
                    break
            continue
        most = min(left[size], r // size)
        if below[size - 1]:
            stack.append((r, size - 1, chosen))
        for n in range(1, most + 1):
            stack.append((r - n * size, size - 1, (*chosen, (size, n))))
    found.sort(key=lambda x: (x[0], tuple(-s for s, n in x[1] for _ in range(n))))
    kept = found if len(found) <= branches else found[: int(branches)]
    return kept or [_greedy(left, room)], not stack and 0 < len(found) <= branches


def _greedy(left: list[int], room: int) -> tuple[int, Filling]:
    chosen = []
    for size in range(room, 0, -1):
        n = min(left[size], room // size) if left[size] else 0
        if n:
            chosen.append((size, n))
            room -= n * size
    return room, tuple(chosen)


def bin_completion(counts: dict[int, int], capacity: int, effort: Effort | None = None) -> Packing:
    """Branch and bound that completes the container of the largest item left, in widening rounds.

    The best solution so far starts with best-fit decreasing. The first round uses each filling as often as the items left
    allow, so that a step costs the same for ten items and for ten billion. While the lower bound isn't reached, another
    round follows with WIDER times the effort, which also tries fillings fewer times. A round that left nothing out proves
    the best so far. What further rounds find in a limited time depends on the machine; the first is always finished.
    """
    effort = effort or Effort()
    bound, best = lower_bound(counts, capacity), best_fit(counts, capacity)
    until, factor = math.inf if effort.seconds is None else perf_counter() + effort.seconds, 1
    while sum(n for _, n in best) > bound:
        wide = effort.exact or factor > 1
        best, whole = _round(counts, capacity, bound, best, effort.times(factor), (math.inf if effort.exact else factor) if wide else 1, until)
        if whole and sum(n for _, n in best) > bound:
            return Packing(best, sum(n for _, n in best), "search")
        if effort.exact or perf_counter() >= until:
            break
        factor *= WIDER
    return Packing(best, bound, "bound" if sum(n for _, n in best) == bound else "none")


def _repeats(most: int, number: float) -> list[int]:
    """How often a filling is tried, most first: all of 1..most if these are not more than `number`, else a spread of them."""
    if most <= number:
        return list(range(most, 0, -1))
    return sorted({most, *(most - most * i // number for i in range(number)), *(max(1, most - i) for i in range(number))}, reverse=True)


def _round(counts: dict[int, int], capacity: int, bound: int, best: list[tuple[Filling, int]], limits: tuple[float, float, float], repeats: float, until: float) -> tuple[list[tuple[Filling, int]], bool]:
    """(the best plan, whether nothing was left out) of one depth-first search.

    A node takes the largest size left and its undominated completions, each for some numbers of containers. A node is
    pruned if its containers and the bound on the rest can't be fewer than those of the best, which is the bound on waste.
    limits: steps, branches, nodes. repeats: how many numbers of containers are tried for a filling, of 1 the largest only.
    Ends at the lower bound, after so many nodes or, with repeats above 1, at the time `until`.
    """
    steps, branches, nodes = limits
    fewest, whole = sum(n for _, n in best), True
    left = [0] * (capacity + 1)
    for size, n in counts.items():
        left[size] = n
    levels: list[list] = []  # of each level: the size, fillings not yet tried, and the one tried with its numbers left
    path: list[tuple[Filling, int]] = []
    used, weight = 0, sum(s * n for s, n in counts.items())

    def apply(filling: Filling, times: int) -> None:
        nonlocal used, weight
        for s, n in filling:
            left[s] -= n * times
            weight -= s * n * times
        used += times

    def largest() -> int:
        return next((s for s in range(capacity, 0, -1) if left[s]), 0)

    down = True
    while nodes > 0 and fewest > bound:
        if down:
            size = largest()
            if not size:
                if used < fewest:
                    fewest, best = used, list(path)
                down = False
                continue
            if used + -(-weight // capacity) >= fewest:
                down = False
                continue
            if repeats > 1 and perf_counter() >= until:
                return best, False
            nodes -= 1
            left[size] -= 1
            ways, all_ = completions(left, capacity - size, steps, branches)
            left[size] += 1
            whole &= all_
            levels.append([size, [w for _, w in ways], (), []])
        elif not levels:
            return best, whole
        else:
            apply(path[-1][0], -path[-1][1])
            path.pop()
        level = levels[-1]
        size, ways, filling, numbers = level
        if not numbers and not ways:
            levels.pop()
            down = False
            continue
        if not numbers:
            way = dict(ways.pop(0))
            way[size] = way.get(size, 0) + 1
            filling = tuple(sorted(way.items(), reverse=True))
            most = min(left[s] // n for s, n in filling)
            numbers = _repeats(most, repeats) if repeats > 1 else [most]
            whole &= len(numbers) == most
            level[2:] = filling, numbers
        times = numbers.pop(0)
        apply(filling, times)
        path.append((filling, times))
        down = True
    return best, fewest == bound


def placer(plan: list[tuple[Filling, int]]):
    """A function that gives the container of an item from its size and its rank among items of that size."""
    runs, base, filled = [], 0, Counter()
    for filling, n in plan:
        for size, copies in filling:
            runs.append(((size << 44) + filled[size], base, copies))
            filled[size] += copies * n
        base += n
    runs.sort()
    starts, bases, copies = (np.array(x, np.int64) for x in zip(*runs, strict=True)) if runs else [np.empty(0, np.int64)] * 3

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            code = (size.astype(np.int64) << 44) + rank
            run = np.searchsorted(starts, code, "right") - 1
            container = bases[run] + (code - starts[run]) // copies[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(container, pa.int64())], names=["id", "piece", "start", "size", "container_id"])

    return place


def packed(items: DataFrame, capacity: int, id_col: str = "id", size_col: str = "size", *, effort: Effort | None = None, told: Callable[[Packing], None] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(id_col, piece, start, size, container_id): where each item, or each piece of an item above the capacity, lies.

    Only items above the capacity are divided: into pieces of the capacity, each of which fills a container, and the
    rest. piece counts from 0, start is the piece's offset in its item. Items of null, zero or negative size, and items
    without an id, take no place. Each row is an item, so that repeated ids must be made distinct before. Container ids
    go from 0 without gaps. No item: an empty result.

    Only the histogram of sizes, at most `capacity` numbers, is brought to the driver; it is all that bin completion
    needs, whatever the number of items. Its plan says how many items of each size go into containers filled alike. Items
    are then ranked within their size, in blocks, so that a size which most items have is ranked by many tasks, and a
    rank gives the container by binary search. `effort` limits the search, EXACT doesn't; `told`, if given, is called with
    the Packing, which tells whether the plan is proven to have the fewest containers.
    """
    ship(items.sparkSession)
    s = scratch or Scratch(items.sparkSession, "packing")
    size = F.col(size_col).cast("bigint")
    rows = items.filter(F.col(id_col).isNotNull() & (size > 0)).select(F.col(id_col).alias("id"), size.alias("whole"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("whole") - 1) / capacity))))
    start = F.col("piece") * capacity
    pieces = s.save(rows.select("id", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("whole") - start).cast("int").alias("size")), "pieces")
    counts = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    packing = bin_completion(counts, capacity, effort)
    if told:
        told(packing)
    plan = packing.plan
    cut = F.array(*[F.lit(-(-counts.get(x, 0) // BLOCK) or 1) for x in range(1, capacity + 1)])
    pieces = pieces.withColumn("block", F.pmod(F.xxhash64("id", "piece"), F.element_at(cut, F.col("size"))).cast("int"))
    blocks = pieces.groupBy("size", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("size", "block", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.withColumn("at", F.row_number().over(Window.partitionBy("size", "block").orderBy("id", "piece")) - 1).join(blocks, ["size", "block"])
    kind = items.schema[id_col].dataType.simpleString()
    placed = ranked.select("id", "piece", "start", "size", (F.col("before") + F.col("at")).alias("rank"))
    placed = placed.mapInArrow(placer(plan), f"id {kind}, piece bigint, start bigint, size int, container_id bigint")
    return placed.withColumnRenamed("id", id_col)
