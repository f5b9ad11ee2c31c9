"""Pairs of boxes that overlap, by a plane sweep over the sorted left edges of a page, or of the tiles of a crowded one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bottom, right

#: Boxes that one sweep goes over, about; a page with more is cut into tiles.
CROWD = 4096
#: Pairs of edges looked at in one step.
STEP = 1 << 20


def sweep(left: np.ndarray, right_: np.ndarray, top: np.ndarray, bottom_: np.ndarray, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places ``(i, j)`` of the pairs that have a common area, each once, for boxes in order of their left edges.

    While the sweep is within a box, the boxes that begin there are the ones after it in this order, up to its right edge; of
    those, the ones that meet it in height are its partners.
    """
    n = len(left)
    until = np.searchsorted(left, right_, "left")  # boxes that begin before the right edge
    reach = np.maximum(until - np.arange(n) - 1, 0)
    done = np.concatenate([[0], np.cumsum(reach)])
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + step, "right")) - 1)
        first = np.repeat(np.arange(lo, hi), reach[lo:hi])
        second = first + 1 + np.arange(len(first)) - np.repeat(done[lo:hi] - done[lo], reach[lo:hi])
        # the common area has an extent both ways, after rounding too
        wide = np.minimum(right_[first], right_[second]) - np.maximum(left[first], left[second]) > 0
        high = np.minimum(bottom_[first], bottom_[second]) - np.maximum(top[first], top[second]) > 0
        yield first[wide & high], second[wide & high]
        lo = hi


def overlapping_pairs(boxes: DataFrame, key: list[str], ident: str, crowd: int = CROWD) -> DataFrame:
    """Pairs of one page's boxes that overlap: ``key, a, b`` with ``a < b``, each once.

    Spark brings a page's boxes together in order of their left edges. A page with over ``crowd`` boxes is cut into as many
    square tiles as that takes; only its boxes stand in each tile they touch, and a pair counts in the tile of the corner of
    its common area. NULL boxes overlap with nothing; a page of any size is swept tile by tile.
    """
    b = F.col("box")
    edges = boxes.where(b.isNotNull()).select(*key, F.col(ident).alias("ident"), b["left"].alias("l"), right(b).alias("r"), b["top"].alias("t"), bottom(b).alias("b"))
    counted = edges.withColumn("n", F.count("*").over(Window.partitionBy(*key)))
    few = counted.where(F.col("n") <= crowd).drop("n").withColumns({"tiles": F.lit(1), "tile": F.lit(0)})
    tiles = F.ceil(F.sqrt(F.col("n") / crowd)).cast("int")
    span = lambda low, high: F.sequence(*[F.greatest(F.lit(0), F.least(F.floor(F.col(c) * F.col("tiles")).cast("int"), F.col("tiles") - 1)) for c in (low, high)])
    many = counted.where((F.col("n") > crowd) & (F.col("r") >= F.col("l")) & (F.col("b") >= F.col("t"))).withColumn("tiles", tiles).drop("n")
    many = many.withColumn("x", F.explode(span("l", "r"))).withColumn("y", F.explode(span("t", "b"))).withColumn("tile", F.col("y") * F.col("tiles") + F.col("x")).drop("x", "y")
    place = [*key, "tile"]
    columns = [*place, "tiles", "ident", "l", "r", "t", "b"]

    def swept(group: pa.Table) -> Iterator[pa.RecordBatch]:
        left, right_, top, bottom_ = (group.column(c).to_numpy() for c in "lrtb")
        ids, tiles_, tile = group.column("ident").to_numpy(), group.column("tiles")[0].as_py(), group.column("tile")[0].as_py()
        for i, j in sweep(left, right_, top, bottom_):
            if tiles_ > 1:
                corner = [np.clip(np.floor(np.maximum(v[i], v[j]) * tiles_).astype(np.int64), 0, tiles_ - 1) for v in (left, top)]
                own = corner[1] * tiles_ + corner[0] == tile
                i, j = i[own], j[own]
            if len(i):
                yield pa.RecordBatch.from_arrays([*(pa.repeat(group.column(k)[0], len(i)) for k in key), pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], names=[*key, "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            codes = [batch.column(c).to_numpy(zero_copy_only=False) for c in place]
            new = np.zeros(batch.num_rows, bool)
            for c in codes:
                new[1:] |= c[1:] != c[:-1]
            bounds = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                if held and any(held[0].column(c)[0] != part.column(c)[0] for c in place):
                    yield from swept(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield from swept(pa.Table.from_batches(held))

    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), f"a {kinds[ident]}", f"b {kinds[ident]}"])
    swept_few = few.select(*columns).sortWithinPartitions(*place, "l").mapInArrow(run, schema)
    return swept_few.unionByName(many.select(*columns).repartition(*place).sortWithinPartitions(*place, "l").mapInArrow(run, schema))
