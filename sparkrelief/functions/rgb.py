"""Packed RGB heights in numpy, for Arrow batches; the column forms are in ``codec``."""

from __future__ import annotations

import numpy as np

from .codec import FORMAT_NAMES

_F = np.float32


def format_of(name: str) -> str:
    """The canonical name of an RGB format, in any case."""
    try:
        return FORMAT_NAMES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown height format: {name}") from None


def encode(name: str, heights: np.ndarray) -> np.ndarray:
    """Three bytes for each height, in single precision as the format asks."""
    kind, e = format_of(name), np.asarray(heights).astype(_F)
    with np.errstate(invalid="ignore", over="ignore"):
        if kind == "gsi":
            v = e.astype(float) * 100
            v = np.sign(v) * np.floor(np.abs(v) + 0.5)
            top = float(1 << 63)
            near = np.where(np.isnan(v) | (np.abs(v) >= top), 0.0, v).astype(np.int64)
            number = np.where(v >= top, (1 << 63) - 1, np.where(v <= -top, -(1 << 63), near)) % (1 << 24)
            number = np.where(np.isnan(e), 1 << 23, number)
        elif kind == "mapbox":
            v = (e + _F(10000)) * _F(10)
            number = np.clip(np.nan_to_num(np.sign(v) * np.floor(np.abs(v) + _F(0.5)), nan=0.0, posinf=16777215.0, neginf=0.0), 0, 16777215).astype(np.int64)
        else:
            number = np.clip(np.nan_to_num((e + _F(32768)) * _F(256), nan=0.0, posinf=16777215.0, neginf=0.0), 0, 16777215).astype(np.int64)
    return np.stack((number >> 16, (number >> 8) & 255, number & 255), -1).astype(np.uint8).ravel()


def decode(name: str, content: np.ndarray) -> np.ndarray:
    """Heights of packed bytes; a number of bytes that three does not divide is an error."""
    kind = format_of(name)
    if len(content) % 3:
        raise ValueError(f"{len(content)} packed bytes are not three for each pixel")
    r, g, b = content.reshape(-1, 3).astype(np.int64).T
    if kind == "gsi":
        v = (r << 16) | (g << 8) | b
        m = np.where(v < 1 << 23, v, v - (1 << 24)).astype(_F) * _F(0.01)
        return np.where(v == 1 << 23, _F("nan"), m)
    if kind == "mapbox":
        return _F(-10000) + (r.astype(_F) * _F(65536) + g.astype(_F) * _F(256) + b.astype(_F)) * _F(0.1)
    return r.astype(_F) * _F(256) + g.astype(_F) + b.astype(_F) / _F(256) - _F(32768)
