"""Detectors: any function from an image to detections, or the deterministic stub."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline import constants as C
from scarpline.functions.geodesy import is_tiff
from scarpline.functions.polygon import stub_detection
from scarpline.operators.raster import DETECTION, polygons_of

#: A factory is called once in each worker and gives the function from (bands, height, width) arrays, blue first, to detections.
Factory = Callable[[], Callable[[np.ndarray], list[dict]]]


def predict_slides(images: DataFrame, key: str, factory: Factory | None = None, confidence: float = C.CONFIDENCE) -> DataFrame:
    """(key, detections) of images (key, height, width, bands ARRAY<ARRAY<DOUBLE>>); without a factory the stub, which needs the size alone.

    Detections below the confidence and polygons of fewer than three corners are left out; corners have 1 decimal, confidences 4.
    """
    if factory is None:
        return images.select(key, stub_detection("height", "width").alias("detections"))
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = factory()
        for b in batches:
            out = []
            for h, w, bands in zip(b["height"], b["width"], b["bands"]):
                found = detector(np.stack([np.asarray(x, dtype=float).reshape(int(h), int(w)) for x in bands])[::-1])
                out.append([
                    {"mask_polygon": [{"x": round(float(x), 1), "y": round(float(y), 1)} for x, y in d["mask_polygon"]], "confidence": round(float(d["confidence"]), 4), "class": d["class"]}
                    for d in found if d["confidence"] >= confidence and len(d["mask_polygon"]) >= 3
                ])
            yield pd.DataFrame({key: b[key], "detections": out})

    return images.select(key, "height", "width", "bands").mapInPandas(run, f"`{key}` {kind}, detections array<{DETECTION}>")


def predict_floods(rasters: DataFrame, key: str, green: int = C.GREEN_BAND, nir: int = C.NIR_BAND, threshold: float = C.NDWI_THRESHOLD) -> DataFrame:
    """(key, detections) of rasters (key, path, height, width, bands): borders of water; empty for anything that is not a TIFF with both bands (numbered from 1)."""
    kind = rasters.schema[key].dataType.simpleString()
    fit = F.coalesce(is_tiff("path") & (F.size("bands") >= max(green, nir)), F.lit(False))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for ok, h, w, g, n in zip(b["ok"], b["height"], b["width"], b["g"], b["n"]):
                if not ok or g is None or n is None:
                    out.append([])
                    continue
                g, n = (np.asarray(x, dtype=float).reshape(int(h), int(w)) for x in (g, n))
                index = np.divide(g - n, g + n, out=np.zeros_like(g), where=(g + n) != 0)
                out.append(polygons_of(index > threshold, index))
            yield pd.DataFrame({key: b[key], "detections": out})

    picked = rasters.select(key, fit.alias("ok"), "height", "width", F.when(fit, F.get("bands", F.lit(green - 1))).alias("g"), F.when(fit, F.get("bands", F.lit(nir - 1))).alias("n"))
    return picked.mapInPandas(run, f"`{key}` {kind}, detections array<{DETECTION}>")
