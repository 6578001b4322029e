"""Pixel statistics of grey images, in Arrow batches. Decoding is left to a source that has a decoder; here a row holds width, height and raw bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

METRICS = ("blur", "brightness", "contrast", "glare", "wear", "overexposed")


def metrics(grey: np.ndarray) -> tuple[float, ...]:
    """Variance of the Laplacian; mean; deviation; share of pixels at or over both 240 and the 98th percentile; deviation of 8 by 8 cells' deviations; share over 250."""
    g = grey.astype(np.float64)
    if g.size == 0:
        return (0.0,) * len(METRICS)
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    bright = max(240.0, float(np.percentile(g, 98)))
    cells = [c.std() for row in np.array_split(g, min(8, g.shape[0]), axis=0) for c in np.array_split(row, min(8, g.shape[1]), axis=1)]
    return float(laplacian.var()), float(g.mean()), float(g.std()), float((g >= bright).mean()), float(np.std(cells)), float((g > 250).mean())


def image_metrics(images: DataFrame, key: str = "image_id") -> DataFrame:
    """key and METRICS of images(key, width, height, pixels); null metrics where the bytes do not fit the size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for w, h, raw in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                fits = raw is not None and w is not None and h is not None and len(raw) == w * h
                found.append(metrics(np.frombuffer(raw, dtype=np.uint8).reshape(h, w)) if fits else (None,) * len(METRICS))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[k] for f in found], pa.float64()) for k in range(len(METRICS)))], [key, *METRICS])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "width", "height", "pixels").mapInArrow(run, ", ".join([f"{key} {kind}", *(f"{m} double" for m in METRICS)]))
