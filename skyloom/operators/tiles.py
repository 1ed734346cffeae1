"""Neighbourhoods in images: pixels are grouped into tiles with a halo, so a shuffle moves a pixel once, or a few times at a tile's edge."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels along a side of a tile, without its halo.
TILE = 128


def in_tiles(rows: DataFrame, halo: int, keys: Sequence[str], fields: Sequence[str], tile: int = TILE) -> DataFrame:
    """(keys, ty, tx, y, x, fields): a row a tile, with arrays over its pixels and those within `halo` of it.

    Pixels are numbered from any origin; a tile holds at most (tile + 2 halo)^2 of them.
    """
    if halo > tile:
        raise ValueError("a halo is no wider than a tile")
    reach = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + d) / tile).cast("int") for d in (-halo, 0, halo)]))
    dealt = rows.withColumn("ty", F.explode(reach("y"))).withColumn("tx", F.explode(reach("x")))
    items = dealt.groupBy(*keys, "ty", "tx").agg(F.collect_list(F.struct("y", "x", *fields)).alias("p"))
    return items.select(*keys, "ty", "tx", *[F.col(f"p.{c}").alias(c) for c in ("y", "x", *fields)])


class Tile:
    """One tile as arrays with their halo; `have` tells which pixels exist, others are 0."""

    def __init__(self, row, halo: int, fields: Sequence[str], tile: int = TILE):
        self.y0, self.x0 = row["ty"] * tile - halo, row["tx"] * tile - halo
        self.halo, side = halo, tile + 2 * halo
        self.at = (np.asarray(row["y"]) - self.y0, np.asarray(row["x"]) - self.x0)
        self.have = np.zeros((side, side), bool)
        self.have[self.at] = True
        self.of = {}
        for f in fields:
            self.of[f] = np.zeros((side, side))
            self.of[f][self.at] = np.asarray(row[f], float)
        self.core = np.zeros((side, side), bool)
        self.core[halo : halo + tile, halo : halo + tile] = True

    def pixels(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the tile's own pixels in the mask."""
        return np.nonzero(mask & self.core)


def over_tiles(rows: DataFrame, halo: int, keys: Sequence[str], fields: Sequence[str], work: Callable[[Tile, object], pd.DataFrame], result: str, extra: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """(keys, result): what `work` finds in each tile. `extra` names columns that are the same over an image."""
    keys = list(keys)
    tiles = in_tiles(rows, halo, [*keys, *extra], fields, tile)
    shape = ", ".join([*[f"`{k}` {dict(rows.dtypes)[k]}" for k in keys], result])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, row in f.iterrows():
                found = work(Tile(row, halo, fields, tile), row)
                for i, k in enumerate(keys):
                    found.insert(i, k, pd.Series([row[k]] * len(found), index=found.index, dtype=object))
                yield found

    return tiles.mapInPandas(run, shape)


def convolved(a: np.ndarray, kernel: Sequence[float], axis: int, at: Sequence[np.ndarray] | None = None) -> np.ndarray:
    """Along an axis the sum of kernel[d] * a[i + d]; `at` gives, for each d, where to look instead, else beyond the array is 0."""
    r, out, n = len(kernel) // 2, np.zeros_like(a), a.shape[axis]
    for k, w in enumerate(kernel):
        if at is not None:
            out += w * np.take(a, at[k], axis=axis)
            continue
        d = k - r
        here, there = slice(max(0, -d), min(n, n - d)), slice(max(0, d), min(n, n + d))
        if axis == 0:
            out[here] += w * a[there]
        else:
            out[:, here] += w * a[:, there]
    return out


def correlation_sums(a: DataFrame, b: DataFrame, max_dy: int, max_dx: int, keys: Sequence[str]) -> DataFrame:
    """(keys, ly, lx, s, n): sum a[k] * b[k - L] and the number of pairs for every shift. Images: keys, y, x, v.

    Each tile sums its own pixels of a against b and its halo for all shifts; only the sums leave it.
    """
    keys = list(keys)
    halo = max(max_dy, max_dx)
    mark = lambda d, va, vb: d.select(*keys, "y", "x", va.alias("va"), vb.alias("vb"))
    v, none = F.col("v"), F.lit(None).cast("double")
    both = mark(a, v, none).unionByName(mark(b, none, v)).groupBy(*keys, "y", "x").agg(F.max("va").alias("va"), F.max("vb").alias("vb"))

    def work(t: Tile, row) -> pd.DataFrame:
        a, b = t.of["va"], t.of["vb"]
        has_a, has_b = np.isfinite(a) & t.have & t.core, np.isfinite(b) & t.have
        a, b = np.where(has_a, a, 0.0), np.where(has_b, b, 0.0)
        out, side = [], a.shape[0]
        inner = slice(t.halo, side - t.halo)
        mine, here = a[inner, inner], has_a[inner, inner].astype(float)
        for ly in range(-max_dy, max_dy + 1):
            for lx in range(-max_dx, max_dx + 1):
                ys, xs = slice(t.halo - ly, side - t.halo - ly), slice(t.halo - lx, side - t.halo - lx)
                out.append((ly, lx, float((mine * b[ys, xs]).sum()), int((here * has_b[ys, xs]).sum())))
        found = pd.DataFrame(out, columns=["ly", "lx", "s", "n"])
        return found[found["n"] > 0]

    sums = over_tiles(both, halo, keys, ("va", "vb"), work, "ly int, lx int, s double, n long")
    return sums.groupBy(*keys, "ly", "lx").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def image_size(image: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The image with its last row and column, ymax and xmax."""
    size = image.groupBy(*keys).agg(F.max("y").alias("ymax"), F.max("x").alias("xmax"))  # one row per image
    return image.join(size, list(keys)) if keys else image.crossJoin(F.broadcast(size))


def smoothed(image: DataFrame, kernel: Sequence[float], keys: Sequence[str], value: Column) -> DataFrame:
    """(keys, y, x, smooth) for every pixel of the image: the kernel along y, then along x, over values that are there; edges held."""
    radius, fields = len(kernel) // 2, ("v",)
    rows = image_size(image.select(*keys, "y", "x", value.alias("v")), keys)

    def work(t: Tile, row) -> pd.DataFrame:
        v = t.of["v"]
        side, shifts = v.shape[0], range(-radius, radius + 1)
        den = np.isfinite(v) & t.have
        num = np.where(den, v, 0.0)
        den = den.astype(float)
        near = lambda start, last: [np.clip(np.clip(np.arange(side) + start + d, 0, last) - start, 0, side - 1) for d in shifts]
        rows_at, columns_at = near(t.y0, row["ymax"]), near(t.x0, row["xmax"])
        for axis, at in ((0, rows_at), (1, columns_at)):
            num, den = (np.where(t.have, convolved(a, kernel, axis, at), 0.0) for a in (num, den))
        y, x = t.pixels(t.have)
        some = den[y, x] > 1e-12
        out = np.where(some, num[y, x] / np.where(some, den[y, x], 1.0), np.nan)
        return pd.DataFrame({"y": (y + t.y0).astype("int32"), "x": (x + t.x0).astype("int32"), "smooth": [float(z) if ok else None for z, ok in zip(out, some)]})

    return over_tiles(rows, radius, keys, fields, work, "y int, x int, smooth double", ("ymax", "xmax"))


def significance(valid: DataFrame, kernel: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """(keys, y, x, significance) of valid pixels (signal, noise): sum k S / sqrt(sum k^2 N^2) over valid ones around."""

    def work(t: Tile, row) -> pd.DataFrame:
        squared = [k * k for k in kernel]
        s, v, c = t.of["signal"], t.of["noise"] ** 2, t.have.astype(float)
        for axis in (0, 1):
            s, v, c = convolved(s, kernel, axis), convolved(v, squared, axis), convolved(c, kernel, axis)
        y, x = t.pixels(t.have & (c > 1e-6) & (v > 0))
        return pd.DataFrame({"y": (y + t.y0).astype("int32"), "x": (x + t.x0).astype("int32"), "significance": s[y, x] / np.sqrt(v[y, x])})

    return over_tiles(valid.select(*keys, "y", "x", "signal", "noise"), len(kernel) // 2, keys, ("signal", "noise"), work, "y int, x int, significance double")
