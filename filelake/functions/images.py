"""Perceptual hash of decoded images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filelake.functions.paths import strip_uri

SIDE = 32
LOW = 8


def _resample(size: int, target: int = SIDE) -> np.ndarray:
    """Weights of a Lanczos-3 resampling of one axis, widened when shrinking."""
    scale = size / target
    stretch = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    x = (np.arange(size)[None, :] + 0.5 - centre[:, None]) / stretch
    weights = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def _cosine_basis(size: int = SIDE) -> np.ndarray:
    k, n = np.arange(size)[:, None], np.arange(size)[None, :]
    return 2 * np.cos(np.pi * k * (2 * n + 1) / (2 * size))


def dct_hash(pixels: np.ndarray) -> str:
    """64-bit DCT hash (Zauner 2010) of a grey image: low frequencies above their median."""
    height, width = pixels.shape
    narrow = np.clip(np.rint(pixels @ _resample(width).T), 0, 255)
    small = np.clip(np.rint(_resample(height) @ narrow), 0, 255)
    basis = _cosine_basis()
    low = (basis @ small @ basis.T)[:LOW, :LOW]
    bits = (low > np.median(low)).flatten()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


@F.pandas_udf(T.StringType())
def perceptual_hash(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    """Hash of rows as the image source gives them: bytes by row in blue, green, red order."""
    out: list[str | None] = []
    for h, w, c, raw in zip(height, width, channels, data):
        try:
            image = np.frombuffer(raw, np.uint8).reshape(h, w, c).astype(np.float64)
            grey = image[:, :, 0] if c == 1 else image[:, :, :3] @ np.array([0.114, 0.587, 0.299])
            out.append(dct_hash(np.floor(grey + 0.5)))
        except Exception:
            out.append(None)
    return pd.Series(out, dtype=object)


def image_hashes(images: DataFrame) -> DataFrame:
    """``(path, perceptual_hash)`` of a DataFrame read with the ``image`` source."""
    i = "image."
    phash: Column = perceptual_hash(i + "height", i + "width", i + "nChannels", i + "data")
    return images.select(strip_uri(F.col("image.origin")).alias("path"), phash.alias("perceptual_hash"))
