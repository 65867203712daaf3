"""Documents into containers of a fixed number of tokens, by bin completion.

Containers are filled around the largest document left: the undominated fillings of the room beside it are enumerated one
by one; partial solutions whose waste rules out fewer containers than the best known are given up. A best-fit packing is
the first incumbent. Spark deals the documents out to groups of bounded token totals, packs the groups in parallel, and
packs what the groups left in unfilled containers once more among itself.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seismark.session import cut_lineage, spread

#: Tokens dealt to one group; at least so much of a container must be filled for it to stay as the first packing left it.
GROUP_TOKENS, KEPT_FILL = 1_000_000, 0.995
#: Search budget of a group: containers built beyond one full packing, and steps of enumeration in all, before the best
#: known packing is taken. None in the place of either is no limit, and without limits the search is exact.
NODES, STEPS = 6_000, 2_400_000
#: Fillings tried beside one document in the passes of the search, each with those limits; the last tries all undominated ones.
WIDTHS = (2, 12, None)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices per container: largest first, each into the container with least sufficient room."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect.bisect_left(rooms, (sizes[i], -1))
        if at == len(rooms):
            bins.append([i])
            bisect.insort(rooms, (capacity - sizes[i], len(bins) - 1))
        else:
            room, k = rooms.pop(at)
            bins[k].append(i)
            bisect.insort(rooms, (room - sizes[i], k))
    return bins


def undominated_fillings(held: list[int], room: int, spend: Callable[[], bool]) -> Iterator[tuple[int, list[int]]]:
    """(waste, lengths) of every undominated filling of ``room``: the least waste first, then, mostly, the fewest documents.

    held[n] is the number of documents of length n left; it must be the same whenever the next filling is asked for. A
    filling is dominated if a document outside it fits in the place of some of its documents (of none, of one shorter, of
    several no longer together). Sets of lengths and of sums are bits of integers. ``spend`` is asked before each step and
    ends the enumeration by False.
    """
    lengths = [n for n in range(1, min(room, len(held) - 1) + 1) if held[n]]
    free = sum(1 << n for n in lengths)
    reach = [1]  # sums of documents of the k shortest lengths
    for n in lengths:
        sums = reach[-1]
        for _ in range(min(held[n], room // n)):
            sums |= sums << n
        reach.append(sums & ((1 << (room + 1)) - 1))

    def dominated(singles: int, several: int, outside: int, waste: int) -> bool:
        """Whether a document outside takes the place of one (``singles``) or more documents (``several``, their sums)."""
        if several & outside:
            return True
        spread, width = singles | several, 1  # sums and up to waste - 1 more
        while width < waste:
            step = min(width, waste - width)
            spread, width = spread | spread << step, width + step
        return bool(waste and (spread << 1) & outside)

    def extend(left: int, largest: int, chosen: list[int], singles: int, several: int, outside: int, waste: int, least: int) -> Iterator[list[int]]:
        """Fillings that add at least ``least`` documents of up to ``largest`` tokens, ``left`` together."""
        if not spend():
            return
        if outside >> left & ((1 << (waste + 1)) - 1):
            # One document outside, of that length or of up to waste more, takes the place of several that could be added.
            if least <= 1 and left <= largest and outside >> left & 1:
                yield from add([left], 0, chosen, singles, several, outside, waste)
            return
        top = bisect.bisect_right(lengths, min(left, largest))
        for a in reversed(lengths[bisect.bisect_left(lengths, (left + 1) // 2) : top]):
            if a < left and outside >> a & 1 and outside >> (left - a) & 1 and (2 * a != left or held[a] - chosen.count(a) > 1):
                yield from add([a, left - a], 0, chosen, singles, several, outside, waste)
        for k in range(top - 1, -1, -1):
            if not reach[k + 1] >> left & 1:
                return
            if outside >> lengths[k] & 1 and reach[k + 1] >> (left - lengths[k]) & 1:
                yield from add([lengths[k]], left - lengths[k], chosen, singles, several, outside, waste)

    def add(more: list[int], left: int, chosen: list[int], singles: int, several: int, outside: int, waste: int) -> Iterator[list[int]]:
        for a in more:
            several, singles = several | (singles | several) << a, singles | 1 << a
            chosen = [*chosen, a]
            if held[a] == chosen.count(a):
                outside &= ~(1 << a)
        if not spend() or dominated(singles, several, outside, waste):
            return
        if left:
            yield from extend(left, chosen[-1], chosen, singles, several, outside, waste, 2)
        elif not outside & ((1 << (waste + 1)) - 1):
            yield chosen

    for waste in range(room + 1):
        if waste == room and not free:
            yield waste, []
        elif waste < room and reach[-1] >> (room - waste) & 1:
            for filling in extend(room - waste, room, [], 0, 0, free, waste, 1):
                yield waste, filling


def _search(held: list[int], lengths: list[int], documents: int, capacity: int, total: int, bound: int, width: int | None, nodes: float, steps: float) -> list[list[int]] | None:
    """Lengths per container of a packing in fewer than ``bound`` containers, trying ``width`` fillings beside each document."""
    held, least = list(held), -(-total // capacity)

    def spend() -> bool:
        nonlocal steps
        steps -= 1
        return steps >= 0

    def largest_left() -> int:
        k = len(lengths) - 1
        while k >= 0 and not held[lengths[k]]:
            k -= 1
        return lengths[k] if k >= 0 else 0

    def options_beside(largest: int) -> Iterator[tuple[int, list[int]]]:
        options = islice(undominated_fillings(held, capacity - largest, spend), width)
        while True:
            held[largest] -= 1
            option = next(options, None)
            held[largest] += 1
            if option is None:
                return
            yield option

    # A stack of containers: their lengths, waste, largest document, and the fillings not yet tried beside it. Fillings are
    # enumerated one by one, as far as the search comes back for them.
    stack: list[tuple] = []
    wasted, placed, used = 0, 0, 0
    solution: list[list[int]] | None = None
    options = options_beside(largest := largest_left())
    while used < nodes and steps > 0:
        waste, filling = next(options, (0, None))
        if filling is None or -(-(total + wasted + waste) // capacity) >= bound:
            # The fillings that follow waste as much or more.
            if not stack:
                break
            content, waste, largest, options = stack.pop()
            for n in content:
                held[n] += 1
            wasted, placed = wasted - waste, placed - len(content)
            continue
        used += 1
        content = [largest, *filling]
        for n in content:
            held[n] -= 1
        stack.append((content, waste, largest, options))
        wasted, placed = wasted + waste, placed + len(content)
        if placed == documents:
            solution, bound = [x[0] for x in stack], len(stack)
            if bound <= least:
                break
            options = iter(())
            continue
        options = options_beside(largest := largest_left())
    return solution


def complete_bins(sizes: list[int], capacity: int, nodes: int | None = NODES, steps: int | None = STEPS) -> list[list[int]]:
    """Indices per container by bin completion; never worse than best fit. Sizes lie in 1..capacity."""
    nodes, steps = (math.inf if x is None else x for x in (nodes, steps))
    best = best_fit(sizes, capacity)
    total = sum(sizes)
    least = -(-total // capacity)
    if len(best) <= least:
        return best
    of_length: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        of_length.setdefault(n, []).append(i)
    held = [0] * (capacity + 1)
    for n, items in of_length.items():
        held[n] = len(items)
    lengths = sorted(of_length)

    solution, bound = None, len(best)
    # Few fillings a container spread the search over many containers; the last pass is held to none.
    for width in WIDTHS:
        found = _search(held, lengths, len(sizes), capacity, total, bound, width, nodes + len(best), steps)
        if found is not None:
            solution, bound = found, len(found)
        if bound <= least:
            break
    if solution is None:
        return best
    left = {n: list(items) for n, items in of_length.items()}
    return [[left[n].pop() for n in content] for content in solution]


def pack_documents(sized: DataFrame, document: str, tokens: str, capacity: int, group_tokens: int = GROUP_TOKENS, nodes: int | None = NODES, steps: int | None = STEPS) -> DataFrame:
    """document, part, tokens, container: every document in one container, split only if it alone exceeds ``capacity``.

    A longer document is cut into full containers and one remainder, numbered by part. No container holds more than
    ``capacity``. Null and empty documents take no room and have a null container. Repeated rows are documents of their
    own; equal sizes are interchangeable; an empty table gives no rows. ``nodes`` and ``steps`` are the search budget.
    """
    # Repeated rows of one document are told apart by a number, which the checkpoint below keeps.
    base = sized.select(F.col(document).alias("document"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("size"))
    whole = F.floor(F.col("size") / capacity)
    parts = base.select("document", "row", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / capacity) - 1, F.lit(0)))).alias("part"))
    items = cut_lineage(parts.select("document", "row", F.col("part").cast("int").alias("part"), F.when(F.col("part") < whole, F.lit(capacity)).otherwise(F.col("size") - whole * capacity).cast("bigint").alias("tokens")))
    nothing = items.where("tokens = 0").select("document", "part", "tokens", F.lit(None).cast("string").alias("container"))
    full = items.where(F.col("tokens") == capacity).select("document", "part", "tokens", F.concat_ws("-", F.lit("full"), F.col("row").cast("string"), F.col("part").cast("string")).alias("container"))

    def packed(some: DataFrame, stage: str) -> DataFrame:
        total = some.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        groups = max(1, -(-total // group_tokens))

        def pack(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["tokens", "row", "part"]).reset_index(drop=True)
            container = np.empty(len(group), dtype=np.int64)
            bins = complete_bins(group["tokens"].tolist(), capacity, nodes, steps)
            for k, members in enumerate(bins):
                container[members] = k
            group["container"] = [f"{stage}-{g}-{k}" for g, k in zip(group["grp"], container)]
            group["filled"] = group.groupby("container")["tokens"].transform("sum")
            return group[["document", "row", "part", "tokens", "container", "filled"]]

        kind = some.schema["document"].dataType.simpleString()
        dealt = some.withColumn("grp", F.pmod(F.xxhash64(F.col("row"), F.col("part"), F.lit(stage)), F.lit(groups)).cast("int"))
        return spread(dealt, "grp").groupBy("grp").applyInPandas(pack, f"document {kind}, row bigint, part int, tokens bigint, container string, filled bigint")

    first = cut_lineage(packed(items.where((F.col("tokens") > 0) & (F.col("tokens") < capacity)), "a"))
    kept = first.where(F.col("filled") >= KEPT_FILL * capacity).drop("filled", "row")
    again = packed(first.where(F.col("filled") < KEPT_FILL * capacity).select("document", "row", "part", "tokens"), "b").drop("filled", "row")
    placed = kept.unionByName(again).unionByName(full).unionByName(nothing)
    return placed.select(F.col("document").alias(document), "part", "tokens", "container")


def packing_report(placed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, least_containers (tokens over capacity, rounded up), tokens, fill (share of the room used)."""
    per_container = placed.where("container IS NOT NULL").groupBy("container").agg(F.sum("tokens").alias("tokens"))
    total = per_container.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.max("tokens"), F.lit(0)).alias("fullest"))
    return total.select("containers", F.ceil(F.col("tokens") / capacity).alias("least_containers"), "tokens", "fullest", F.try_divide(F.col("tokens").cast("double"), F.col("containers") * capacity).alias("fill"))
