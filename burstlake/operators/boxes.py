"""Detection boxes: local maxima of a plane, and suppression of overlapping boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plane_maxima(plane: DataFrame, row: str, col: str, value: str, threshold: float) -> DataFrame:
    """Cells that no cell of their 3 x 3 neighbourhood exceeds and that reach the threshold.

    Every cell gives its value to its nine neighbours and to none else: one aggregation, formed before the shuffle.
    """
    d = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    near = plane.withColumn("d", d).select((F.col(row) + F.col("d.i")).alias(row), (F.col(col) + F.col("d.j")).alias(col), value)
    top = near.groupBy(row, col).agg(F.max(value).alias("top"))
    return plane.where(F.col(value) >= threshold).join(top, [row, col]).where(F.col(value) >= F.col("top")).drop("top")


def nms(boxes: DataFrame, key: str, limit: float) -> DataFrame:
    """Of each group, from the best score down, the boxes whose overlap (IoU) with no kept box is over the limit.

    boxes: (key, box_id, x1, y1, x2, y2, score). A group is one image. Images are dealt to tasks by a hash, best boxes first, and pass
    in batches; of the image at hand the kept boxes are held, which a grid of pixels bounds, whatever the rows. Scores that
    are no numbers come last.
    """
    corners = [boxes.columns.index(c) for c in ("x1", "y1", "x2", "y2")]
    image = boxes.columns.index(key)

    def overlapping(one: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Which of the others (x1, y1, x2, y2, area) overlap one over the limit."""
        w = np.clip(np.minimum(one[2], others[:, 2]) - np.maximum(one[0], others[:, 0]), 0, None)
        h = np.clip(np.minimum(one[3], others[:, 3]) - np.maximum(one[1], others[:, 1]), 0, None)
        union = one[4] + others[:, 4] - w * h
        return np.divide(w * h, union, out=np.zeros(len(others)), where=union > 0) > limit

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []  # the image at hand, and its kept boxes
        for b in batches:
            names = b.column(image).to_pylist()
            x = np.column_stack([b.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in corners])
            x = np.column_stack([x, np.maximum(x[:, 2] - x[:, 0], 0) * np.maximum(x[:, 3] - x[:, 1], 0)])
            left, at = np.ones(len(names), bool), 0
            while at < len(names):
                stop = at
                while stop < len(names) and names[stop] == names[at]:
                    stop += 1
                if names[at] != now:
                    now, held = names[at], []
                part, mine = x[at:stop], left[at:stop]
                for one in held:
                    mine &= ~overlapping(one, part)
                for k in range(stop - at):
                    if mine[k]:
                        # A box without an area overlaps none.
                        if part[k, 4] > 0 or limit < 0:
                            held.append(part[k])
                        mine[k + 1 :] &= ~overlapping(part[k], part[k + 1 :])
                at = stop
            if left.any():
                yield b.filter(pa.array(left))

    score = F.col("score").cast("double")
    best = F.when(~F.isnan(score), score).desc_nulls_last()
    order = [key, best, F.col("box_id").asc_nulls_last()]
    return boxes.repartition(F.xxhash64(key)).sortWithinPartitions(*order).mapInArrow(keep, boxes.schema)
