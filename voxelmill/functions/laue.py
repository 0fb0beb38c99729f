"""The eleven Laue groups as integer matrices, and how they act on stored axes."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

Matrix = tuple[tuple[int, int, int], tuple[int, int, int], tuple[int, int, int]]

# Generator matrices on Miller indices (h, k, l) and the generators of each group.
IDENTITY: Matrix = ((1, 0, 0), (0, 1, 0), (0, 0, 1))
INVERSION: Matrix = ((-1, 0, 0), (0, -1, 0), (0, 0, -1))
TWOFOLD_A: Matrix = ((1, 0, 0), (0, -1, 0), (0, 0, -1))
TWOFOLD_B: Matrix = ((-1, 0, 0), (0, 1, 0), (0, 0, -1))
FOURFOLD_C: Matrix = ((0, -1, 0), (1, 0, 0), (0, 0, 1))
THREEFOLD_111: Matrix = ((0, 0, 1), (1, 0, 0), (0, 1, 0))
THREEFOLD_HEX: Matrix = ((0, -1, 0), (1, -1, 0), (0, 0, 1))
SIXFOLD_HEX: Matrix = ((1, -1, 0), (1, 0, 0), (0, 0, 1))
TWOFOLD_HEX: Matrix = ((1, -1, 0), (0, -1, 0), (0, 0, -1))
GENERATORS: dict[str, tuple[Matrix, ...]] = {
    "-1": (INVERSION,),
    "2/m": (TWOFOLD_B, INVERSION),
    "mmm": (TWOFOLD_A, TWOFOLD_B, INVERSION),
    "4/m": (FOURFOLD_C, INVERSION),
    "4/mmm": (FOURFOLD_C, TWOFOLD_A, INVERSION),
    "-3": (THREEFOLD_HEX, INVERSION),
    "-3m": (THREEFOLD_HEX, TWOFOLD_HEX, INVERSION),
    "6/m": (SIXFOLD_HEX, INVERSION),
    "6/mmm": (SIXFOLD_HEX, TWOFOLD_HEX, INVERSION),
    "m-3": (THREEFOLD_111, TWOFOLD_B, INVERSION),
    "m-3m": (THREEFOLD_111, FOURFOLD_C, INVERSION),
}
ORDERS = {"-1": 2, "2/m": 4, "mmm": 8, "4/m": 8, "4/mmm": 16, "-3": 6, "-3m": 12, "6/m": 12, "6/mmm": 24, "m-3": 24, "m-3m": 48}
SYSTEMS = {
    "-1": "Triclinic", "2/m": "Monoclinic", "mmm": "Orthorhombic", "4/m": "Tetragonal", "4/mmm": "Tetragonal", "-3": "Trigonal",
    "-3m": "Trigonal", "6/m": "Hexagonal", "6/mmm": "Hexagonal", "m-3": "Cubic", "m-3m": "Cubic",
}
#: Miller index (0 h, 1 k, 2 l) that each stored dimension holds, by plane type.
STORED = {"HK": (0, 1, 2), "HL": (0, 2, 1), "KL": (1, 2, 0)}


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)) for i in range(3))


@lru_cache
def operations(group: str) -> tuple[Matrix, ...]:
    """All operations of a Laue group, sorted; ValueError for an unknown name."""
    if group not in GENERATORS:
        raise ValueError(f"Unknown Laue group {group!r}; known are {', '.join(GENERATORS)}")
    seen, edge = {IDENTITY}, [IDENTITY]
    while edge:
        edge = [n for n in {times(g, o) for g, o in product(GENERATORS[group], edge)} if n not in seen]
        seen.update(edge)
    return tuple(sorted(seen))


def on_axes(op: Matrix, plane: str = "HK") -> tuple[tuple[int, int], ...] | None:
    """For each stored dimension its (source dimension, sign), or None if ``op`` mixes indices."""
    stored = STORED.get(plane, STORED["HK"])
    out = []
    for std in stored:
        used = [(j, v) for j, v in enumerate(op[std]) if v]
        if len(used) != 1:
            return None
        out.append((stored.index(used[0][0]), used[0][1]))
    return tuple(out)


def usable(group: str, plane: str = "HK") -> list[tuple[tuple[int, int], ...]]:
    """The group's signed permutations of stored dimensions; for trigonal and hexagonal groups a subgroup."""
    return [p for op in operations(group) if (p := on_axes(op, plane)) is not None]


def on_stored(op: Matrix, plane: str = "HK") -> Matrix:
    """``op`` as a matrix on the stored dimensions' coordinates."""
    stored = STORED.get(plane, STORED["HK"])
    return tuple(tuple(op[i][j] for j in stored) for i in stored)


def stored_operations(group: str, plane: str = "HK", full: bool = False) -> list[Matrix]:
    """Operations on stored dimensions: all of them (``full``), or those that mix no indices.

    They differ for the trigonal and hexagonal groups only, whose threefold and
    sixfold rotations send (h, k) to sums of both.
    """
    return [on_stored(op, plane) for op in operations(group) if full or on_axes(op, plane) is not None]


def slug(group: str) -> str:
    """The group's name in file names."""
    return group.replace("/", "").replace("-", "bar")
