"""Detectors and classifiers that a user brings along: any object with the one method, applied to Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlake.operators import boxes


class Classifier(Protocol):
    def predict(self, patches: list[np.ndarray]) -> np.ndarray:
        """The probability of a burst for each patch."""


class Detector(Protocol):
    def detect(self, image: np.ndarray) -> list[tuple[float, float, float, float, float]]:
        """Boxes (x1, y1, x2, y2, score) found in one image."""


def classify(patches: DataFrame, model: Classifier, patch: str = "patch", shape: tuple[int, ...] = (-1,), batch: int = 256) -> DataFrame:
    """Adds prob, the model's probability for the array in column patch, brought to a shape.

    The model is sent along with the tasks. A null or empty patch and one that doesn't fit the shape have a null
    probability; other errors of the model end the query. prob replaces a column of that name.
    """
    rest = patches.drop("prob")
    out = ", ".join(f"`{n}` {t}" for n, t in rest.dtypes) + ", prob double"
    size = int(np.prod(shape)) if -1 not in shape else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fits = np.array([v is not None and len(v) > 0 and (not size or len(v) == size) for v in b[patch]], bool)
            prob = np.full(len(b), np.nan)
            rows = np.flatnonzero(fits)
            for k in range(0, len(rows), batch):
                part = rows[k : k + batch]
                prob[part] = model.predict([np.asarray(v, np.float64).reshape(shape) for v in b[patch].iloc[part]])
            yield b.assign(prob=pd.Series(prob, index=b.index).astype("Float64").where(~np.isnan(prob), pd.NA))

    return rest.mapInPandas(run, out)


def detect(images: DataFrame, model: Detector, shape: tuple[int, int], least: float, overlap: float = 0.5, image: str = "image", pixels: str = "pixels") -> DataFrame:
    """(image, box_id, x1, y1, x2, y2, score) of boxes with a score of `least` or more, overlapping ones suppressed.

    pixels is the image row by row. Images that are null or don't fit the shape have no boxes; a NaN score is no box.
    box_id is the place in the model's list.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for name, v in zip(b[image], b[pixels], strict=True):
                if v is not None and len(v) == shape[0] * shape[1]:
                    found = model.detect(np.asarray(v, np.float64).reshape(shape))
                    rows += [(name, k, *map(float, box)) for k, box in enumerate(found) if box[4] >= least]
            yield pd.DataFrame(rows, columns=["image", "box_id", "x1", "y1", "x2", "y2", "score"])

    kind = dict(images.dtypes)[image]
    found = images.select(image, pixels).mapInPandas(run, f"image {kind}, box_id int, x1 double, y1 double, x2 double, y2 double, score double")
    return boxes.nms(found.where(F.col("image").isNotNull()), "image", overlap)


class Logistic:
    """The classifier where no other is given: odds from the highest value over a threshold."""

    def __init__(self, threshold: float) -> None:
        self.threshold = threshold

    def predict(self, patches: list[np.ndarray]) -> np.ndarray:
        top = np.array([p.max() for p in patches])
        return 1 / (1 + np.exp(-(top - self.threshold) / 2))
