"""What stands before and behind a detection network: planes as its input images, its output maps as boxes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Mean and deviation of the three colours that such networks are trained with.
COLOUR_MEAN, COLOUR_DEVIATION = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])
GREY = np.repeat(np.arange(256)[:, None] / 255, 3, axis=1)


def spread(x: np.ndarray) -> np.ndarray:
    """From 0 to 1; a flat image is 0."""
    span = x.max() - x.min()
    return (x - x.min()) / span if span > 0 else np.zeros_like(x)


def resize(x: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Bilinear, by the centres of pixels; beyond the outer centres the border's value holds."""

    def along(n: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(to) + 0.5) * n / to - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), n - 1)
        return low, np.minimum(low + 1, n - 1), at - low

    a, b, p = along(x.shape[0], rows)
    x = x[a] * (1 - p)[:, None] + x[b] * p[:, None]
    a, b, p = along(x.shape[1], cols)
    return x[:, a] * (1 - p) + x[:, b] * p


def network_input(x: np.ndarray, size: int = 512, colours: np.ndarray = GREY) -> np.ndarray:
    """(3, size, size) of a plane: resized, its lowest and highest thousandth clipped, spread, coloured and normalised.

    NaN counts as the least finite value, infinities as the ends; a plane without finite values isn't one.
    """
    ends = x[np.isfinite(x)]
    x = np.clip(np.where(np.isnan(x), ends.min(), x), ends.min(), ends.max())
    x = spread(x)
    deviation = x.std()
    x = resize((x - x.mean()) / (deviation if deviation > 0 else 1.0), size, size)
    x = spread(np.clip(x, *np.percentile(x, (0.1, 99.9))))
    # The last colour holds for 1 alone.
    rgb = colours[np.minimum((x * len(colours)).astype(int), len(colours) - 1)]
    return ((rgb - COLOUR_MEAN) / COLOUR_DEVIATION).transpose(2, 0, 1)


def picture(tensor: np.ndarray) -> np.ndarray:
    """The way back: (rows, columns, 3) bytes of a network's input."""
    return np.round(np.clip((tensor.transpose(1, 2, 0) * COLOUR_DEVIATION + COLOUR_MEAN) * 255, 0, 255)).astype(np.uint8)


def network_inputs(planes: DataFrame, shape: tuple[int, int], size: int = 512, colours: np.ndarray = GREY, image: str = "image", pixels: str = "pixels") -> DataFrame:
    """(image, tensor): network_input() of each plane, which is given row by row; null where it is null, of another length or without a finite value."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # one at a time, as an input has 3 * size * size numbers
                v = b.column(1)[k].as_py()
                x = None if v is None or len(v) != shape[0] * shape[1] else np.array(v, float).reshape(shape)
                made = None if x is None or not np.isfinite(x).any() else network_input(x, size, colours).astype(np.float32).ravel()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), pa.array([made], pa.list_(pa.float32()))], names=["image", "tensor"])

    return planes.select(F.col(image).alias("image"), F.col(pixels).cast("array<double>").alias("pixels")).mapInArrow(work, f"image {dict(planes.dtypes)[image]}, tensor array<float>")


def boxes_of_maps(heat: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, least: float) -> pd.DataFrame:
    """(box_id, kind, x1, y1, x2, y2, score) of maps (kinds, h, w), (2, h, w) and (2, h, w), x before y.

    A cell counts with its highest kind, of those that no cell of its 3 x 3 neighbourhood exceeds in the kind; over `least` it
    is the centre, moved by its offset, of a box of its size, in shares of the map. Of equal kinds the first holds; NaN is no score.
    """
    heat = np.where(np.isnan(heat), -np.inf, heat)
    kinds, h, w = heat.shape
    wide = np.pad(heat, ((0, 0), (1, 1), (1, 1)), constant_values=-np.inf)
    top = np.max([wide[:, i : i + h, j : j + w] for i in range(3) for j in range(3)], axis=0)
    peaks = np.where(heat == top, heat, -np.inf)
    kind, score = peaks.argmax(0), peaks.max(0)
    y, x = np.nonzero(score > least)
    cx, cy = x + offsets[0, y, x], y + offsets[1, y, x]
    half_w, half_h = sizes[0, y, x] / 2, sizes[1, y, x] / 2
    return pd.DataFrame({"box_id": (y * w + x).astype("int32"), "kind": kind[y, x].astype("int32"), "x1": (cx - half_w) / w, "y1": (cy - half_h) / h, "x2": (cx + half_w) / w, "y2": (cy + half_h) / h, "score": score[y, x]})


def decode(maps: DataFrame, shape: tuple[int, int], least: float, image: str = "image") -> DataFrame:
    """(image, box_id, kind, x1, y1, x2, y2, score) of a table (image, heat, sizes, offsets) of a network's output maps, each given row by row.

    heat has one map for each kind of box, sizes and offsets two each. Rows with a null or of another length have no boxes.
    """
    cells = shape[0] * shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [pd.DataFrame({"image": pd.Series([], dtype=b[image].dtype), "box_id": [], "kind": [], "x1": [], "y1": [], "x2": [], "y2": [], "score": []})]
            for name, heat, sizes, offsets in zip(b[image], b["heat"], b["sizes"], b["offsets"], strict=True):
                if any(v is None for v in (heat, sizes, offsets)) or not len(heat) or len(heat) % cells or len(sizes) != 2 * cells or len(offsets) != 2 * cells:
                    continue
                one = boxes_of_maps(*(np.asarray(v, float).reshape(-1, *shape) for v in (heat, sizes, offsets)), least)
                one.insert(0, "image", [name] * len(one))
                found.append(one)
            yield pd.concat(found[1:] or found)

    double = lambda c: F.col(c).cast("array<double>").alias(c)
    kind = dict(maps.dtypes)[image]
    return maps.select(F.col(image), double("heat"), double("sizes"), double("offsets")).mapInPandas(run, f"image {kind}, box_id int, kind int, x1 double, y1 double, x2 double, y2 double, score double")
