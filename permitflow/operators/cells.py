"""Cells by which points and shapes meet: an even grid, or a quadtree learned from a sample, which has small cells where
points are dense and large ones where they are few.

Cells only bring candidates together; what is in a cell is compared exactly, so neither the sample nor the cells change a
result. A place beyond the sample's bounds belongs to the cell at the edge, and so do boxes, which keeps what overlaps
together. A missing coordinate has no cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of a sample, and how many of them a leaf holds at most; a tree has some four leaves for as many points.
SAMPLE, LEAF = 20_000, 50
#: Halvings of either axis at most: a cell that holds one place only is not split for ever.
DEPTH = 20
#: Boxes that go down a tree together.
SLICE = 1024


@dataclass(frozen=True)
class Grid:
    """Cells of one size."""

    x: float
    y: float

    def at(self, x: Column, y: Column) -> Column:
        return F.struct(F.floor(x / self.x).alias("x"), F.floor(y / self.y).alias("y"))

    def over(self, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        xs, ys = F.sequence(F.floor(x0 / self.x), F.floor(x1 / self.x)), F.sequence(F.floor(y0 / self.y), F.floor(y1 / self.y))
        return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def _interleaved(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One number of 2 * DEPTH bits, the bits of two numbers in turn: places in one cell of any size are one interval."""
    out = np.zeros(len(x), np.int64)
    for i in range(DEPTH):
        out |= ((x >> i) & 1) << (2 * i) | ((y >> i) & 1) << (2 * i + 1)
    return out


@dataclass(frozen=True)
class Quadtree:
    """Bounds of the root, and of each leaf the first of its interleaved places, in order."""

    x0: float
    y0: float
    x1: float
    y1: float
    first: tuple[int, ...]

    @staticmethod
    def learned(x: np.ndarray, y: np.ndarray, leaf: int = LEAF, least: float = 0.0) -> Quadtree:
        """The tree of a sample: a cell of more than ``leaf`` points is split in four, unless its quarters' sides
        would be under ``least``. Points of one place stay together."""
        if not len(x):
            return Quadtree(0.0, 0.0, 1.0, 1.0, (0,))
        side = max(float(np.ptp(x)), float(np.ptp(y)))  # a square, so that a strip's cells are not all of its width
        root = Quadtree(float(x.min()), float(y.min()), float(x.min()) + side, float(y.min()) + side, ())
        code = np.sort(root.code(x, y))
        smallest = next((v for v in range(DEPTH) if side / (1 << DEPTH - v) >= least), DEPTH)
        leaves, todo = [], [(0, DEPTH)]
        while todo:
            low, level = todo.pop()
            i, j = np.searchsorted(code, [low, low + (1 << 2 * level)])
            if j - i <= leaf or level <= smallest or code[i] == code[j - 1]:
                leaves.append(low)
            else:
                todo += [(low + (k << 2 * (level - 1)), level - 1) for k in range(4)]
        return Quadtree(root.x0, root.y0, root.x1, root.y1, tuple(sorted(leaves)))

    def _axis(self, v: np.ndarray, low: float, high: float) -> np.ndarray:
        width = (high - low) or 1.0
        return np.clip(np.floor((v - low) / width * (1 << DEPTH)), 0, (1 << DEPTH) - 1).astype(np.int64)

    def code(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return _interleaved(self._axis(x, self.x0, self.x1), self._axis(y, self.y0, self.y1))

    def leaf_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.first), self.code(x, y), side="right") - 1

    def leaves_over(self, x0: float, y0: float, x1: float, y1: float) -> list[int]:
        """Leaves that a box touches."""
        return sorted(self.leaves_of(*(np.array([v], float) for v in (x0, y0, x1, y1)))[1].tolist())

    def leaves_of(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(box, leaf) of the leaves that boxes touch, by the boxes' order: all boxes go down from the root together."""
        first = np.array(self.first)
        a, c = self._axis(x0, self.x0, self.x1), self._axis(x1, self.x0, self.x1)
        b, d = self._axis(y0, self.y0, self.y1), self._axis(y1, self.y0, self.y1)
        box = np.arange(len(a))
        i, x, y = np.zeros_like(box), np.zeros_like(a), np.zeros_like(a)
        j, level, out = i + len(first), DEPTH, []
        while len(box):  # leaves i to j fill the cell at (x, y), of 2^level places
            size = 1 << level
            there = (x <= c[box]) & (y <= d[box]) & (x + size > a[box]) & (y + size > b[box])
            single = there & (j - i == 1)
            out.append((box[single], i[single]))
            box, i, j, x, y = (v[there & ~single] for v in (box, i, j, x, y))
            level -= 1
            if not len(box):
                break
            cuts = [i, *(np.searchsorted(first, first[i] + (k << 2 * level)) for k in (1, 2, 3)), j]
            x, y = (np.concatenate([v + (k >> s & 1 and 1 << level) for k in range(4)]) for s, v in ((0, x), (1, y)))
            box, i, j = np.tile(box, 4), np.concatenate(cuts[:4]), np.concatenate(cuts[1:])
        box, leaf = (np.concatenate([o[n] for o in out]) if out else np.zeros(0, np.int64) for n in (0, 1))
        order = np.argsort(box, kind="stable")
        return box[order], leaf[order]

    def at(self, x: Column, y: Column) -> Column:
        @F.pandas_udf("int")
        def leaf(xs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for x, y in xs:
                there = x.notna() & y.notna()
                out = pd.Series(pd.NA, index=x.index, dtype="Int32")
                out[there] = self.leaf_of(x[there].to_numpy(float), y[there].to_numpy(float))
                yield out

        return leaf(x, y)

    def over(self, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        @F.pandas_udf("array<int>")
        def leaves(boxes: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for box in boxes:
                v = np.stack([x.to_numpy(float, na_value=np.nan) for x in box])
                lists: list[np.ndarray] = []
                for at in range(0, v.shape[1], SLICE):
                    part = v[:, at : at + SLICE]
                    known = np.flatnonzero(~np.isnan(part).any(axis=0))
                    row, leaf = self.leaves_of(*part[:, known])
                    n = np.zeros(part.shape[1], np.int64)
                    n[known] = np.bincount(row, minlength=len(known))
                    lists += np.split(leaf, np.cumsum(n)[:-1])
                yield pd.Series(lists, index=box[0].index, dtype=object)

        return leaves(x0, y0, x1, y1)


Cells = Grid | Quadtree


def quadtree(points: DataFrame, x: Column, y: Column, sample: int = SAMPLE, leaf: int = LEAF, size: Column | None = None) -> Quadtree:
    """The tree of ``sample`` of the points' distinct places at most, those first by a hash of their place. ``size``: the
    longer side of the shapes that the points stand for; no cell is smaller than the middle one of the sample, else each
    shape would lie in many cells."""
    p = points.select(x.cast("double").alias("x"), y.cast("double").alias("y"), (F.lit(0.0) if size is None else size).cast("double").alias("size"))
    p = p.filter("x is not null and y is not null and not isnan(x) and not isnan(y)").groupBy("x", "y").agg(F.max("size").alias("size"))
    rows = p.orderBy(F.xxhash64("x", "y"), "x", "y").limit(sample).toPandas()
    return Quadtree.learned(rows["x"].to_numpy(float), rows["y"].to_numpy(float), leaf, float(rows["size"].median()) if len(rows) else 0.0)
