"""Which images of an invoice's page are a code that could not be decoded, told by their shape."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sides and proportions of a code in points, pages that are looked at, the size that it is brought to, changes between black and white along a line (codes have 42 to
# 55, logos 2 to 6) and the share of black.
SIDE, PROPORTION, PAGES, GRID, LEAST_PIXELS, CHANGES, INK = (30, 300), (0.7, 1.4), 4, 200, 2500, 20, (0.25, 0.75)


def _weights(n: int) -> np.ndarray:
    """GRID x n: shares of n pixels in a line of GRID, by area."""
    edge = np.arange(GRID + 1) * n / GRID
    lo, hi = edge[:-1, None], edge[1:, None]
    pixel = np.arange(n)[None, :]
    share = np.clip(np.minimum(hi, pixel + 1) - np.maximum(lo, pixel), 0, None)
    return share / share.sum(axis=1, keepdims=True)


def _split(levels: np.ndarray) -> float:
    """The grey level that parts dark and light best: the largest variance between both, the first of equals."""
    count = np.bincount(levels.ravel(), minlength=256).astype(float)
    below, total = np.cumsum(count), np.cumsum(count * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (total / below - (total[-1] - total) / above) ** 2
    return float(np.nan_to_num(between, nan=-1.0).argmax())


def looks_like_code(pixels: bytes | None, width: int, height: int) -> bool:
    """Whether a grey image changes between black and white as often as a code's modules do, along its lines and down its columns."""
    if not pixels or width * height < LEAST_PIXELS or len(pixels) != width * height:
        return False
    grey = np.frombuffer(pixels, np.uint8).reshape(height, width)
    small = np.rint(_weights(height) @ grey @ _weights(width).T).astype(np.uint8)
    light = (small > _split(small)).astype(np.int8)
    along, down = np.abs(np.diff(light, axis=1)).sum(axis=1).mean(), np.abs(np.diff(light, axis=0)).sum(axis=0).mean()
    return bool(along >= CHANGES and down >= CHANGES and INK[0] <= 1 - light.mean() <= INK[1])


def could_be_code(width: Column, height: Column) -> Column:
    """By its sides in points alone."""
    return (width > SIDE[0]) & (width < SIDE[1]) & (width / F.greatest(height, F.lit(1.0))).between(*PROPORTION)


def codes_by_shape(images: DataFrame) -> DataFrame:
    """images (doc, page, image_no, width, height in points; pixels, columns, rows of its grey rendering) -> doc, page, image_no of the first image of each document that looks like a code."""
    check = F.pandas_udf(lambda p, w, h: pd.Series([looks_like_code(*x) for x in zip(p, w, h)], dtype=bool), "boolean")
    some = images.where((F.col("page") <= PAGES) & could_be_code(F.col("width"), F.col("height")))
    seen = some.where(check("pixels", "columns", "rows"))
    return seen.groupBy("doc").agg(F.min(F.struct("page", "image_no")).alias("f")).select("doc", "f.*")
