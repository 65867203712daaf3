"""Edit distances and a BK-tree over the entries of a reference list."""

from __future__ import annotations

from collections.abc import Iterable


def levenshtein(a: str, b: str) -> int:
    """Insertions, deletions and substitutions between two strings, a column of the table at a time as bits."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for ch in b:
        match = where.get(ch, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        rise = down | ~(diagonal | up) & full
        fall = up & diagonal
        if rise & last:
            distance += 1
        elif fall & last:
            distance -= 1
        rise = (rise << 1 | 1) & full
        fall = fall << 1 & full
        up = fall | ~(diagonal | rise) & full
        down = rise & diagonal
    return distance


def damerau(a: str, b: str) -> int:
    """As ``levenshtein``, with a swap of neighbours as one edit; unrestricted, hence a true metric as well."""
    far = len(a) + len(b)
    table = [[far] * (len(b) + 2)] + [[far, i, *[0] * len(b)] for i in range(len(a) + 1)]
    table[1] = [far, *range(len(b) + 1)]
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        match_at = 0
        for j, y in enumerate(b, 1):
            row, column = seen.get(y, 0), match_at
            if x == y:
                match_at = j
            table[i + 1][j + 1] = min(
                table[i][j] + (x != y),
                table[i + 1][j] + 1,
                table[i][j + 1] + 1,
                table[row][column] + (i - row - 1) + 1 + (j - column - 1),
            )
        seen[x] = i
    return table[-1][-1]


class BKTree:
    """Entries by Levenshtein distance; ``within`` prunes by the triangle inequality and misses none."""

    def __init__(self, entries: Iterable[str]) -> None:
        self.root: tuple[str, dict] | None = None
        for entry in entries:
            self.add(entry)

    def add(self, entry: str) -> None:
        if self.root is None:
            self.root = (entry, {})
            return
        name, below = self.root
        while (d := levenshtein(entry, name)) != 0:
            if d not in below:
                below[d] = (entry, {})
                return
            name, below = below[d]

    def within(self, value: str, limit: int) -> list[tuple[int, str]]:
        """Every entry at most ``limit`` away, with its distance."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            name, below = todo.pop()
            d = levenshtein(value, name)
            if d <= limit:
                found.append((d, name))
            todo += [node for k, node in below.items() if d - limit <= k <= d + limit]
        return found

    def nearest(self, value: str, swaps_limit: int) -> list[tuple[int, str]]:
        """Every entry at most ``swaps_limit`` away by ``damerau``: a swap is at most two plain edits."""
        candidates = self.within(value, 2 * swaps_limit)
        return [(d, name) for _, name in candidates if (d := damerau(value, name)) <= swaps_limit]
