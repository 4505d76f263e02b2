"""Measures and simple steps on page images, as numpy under ``mapInPandas``.

An image is an array of 8-bit values, gray (h, w) or colour (h, w, 3) in
blue-green-red order.  Geometry that needs an imaging library (warping,
contours of bent leaves) is left to plug points.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quirefold.operators.filters import camel

INVERTED_BELOW = 110
LEAST_TURN, MOST_TURN = 0.2, 15.0
SPREAD, MIDDLE, VALLEY = 1.2, 0.4, 0.2
BAND_DENSITY, BAND_LOW, BAND_HIGH = 0.3, 0.03, 0.2
MOST_COLOUR, LEAST_MIDTONE, LEAST_LIGHT = 12.0, 0.30, 0.30


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of an image as floats."""
    return image.astype(float) if image.ndim == 2 else image[..., :3].astype(float) @ np.array([0.114, 0.587, 0.299])


def is_inverted(image: np.ndarray) -> bool:
    """Whether light text stands on dark ground: the lighter half of the pixels is dark on average."""
    g = gray(image)
    return bool(g[g >= np.median(g)].mean() < INVERTED_BELOW)


def skew(angles: np.ndarray) -> float:
    """The turn that lines at ``angles`` (degrees) show: the median of the fullest degree, 0 outside the range worth turning."""
    folded = (np.asarray(angles, float) + 45.0) % 90.0 - 45.0
    if not len(folded):
        return 0.0
    slots = np.floor(folded).astype(int)
    values, counts = np.unique(slots, return_counts=True)
    turn = float(np.median(folded[slots == values[counts.argmax()]]))
    return turn if LEAST_TURN <= abs(turn) <= MOST_TURN else 0.0


def smooth(line: np.ndarray, width: int) -> np.ndarray:
    """The rolling mean of a projection, its ends repeated."""
    half = width // 2
    padded = np.pad(np.asarray(line, float), (half, width - 1 - half), mode="edge")
    return np.convolve(padded, np.ones(width) / width, "valid")


def gutter(image: np.ndarray) -> int | None:
    """The column between two facing pages, None if there is one page only."""
    g = gray(image)
    h, w = g.shape
    if w < SPREAD * h:
        return None
    ink = smooth((255 - g).sum(axis=0), max(1, w // 100))
    lo, hi = int(w * (1 - MIDDLE) / 2), int(w * (1 + MIDDLE) / 2)
    at = lo + int(ink[lo:hi].argmin())
    return at if ink[at] <= VALLEY * ink.mean() else None


def margin_bands(image: np.ndarray) -> tuple[int, int]:
    """Rows of thin print at the head and at the foot, 0 where the band is too narrow or too wide to be a margin."""
    ink = (gray(image) < 128).mean(axis=1)
    thin = ink <= BAND_DENSITY * ink.mean()
    h = len(ink)

    def run(rows: np.ndarray) -> int:
        n = int(np.argmin(rows)) if not rows.all() else len(rows)
        return n if BAND_LOW * h <= n <= BAND_HIGH * h else 0

    return run(thin), run(thin[::-1])


def worth_enhancing(image: np.ndarray) -> bool:
    """Whether contrast should be raised: no colour plate, enough midtones and light, not inverted."""
    if image.ndim == 3 and (image.max(axis=2).astype(float) - image.min(axis=2)).mean() > MOST_COLOUR:
        return False
    g = gray(image)
    midtone, light = ((g > 64) & (g < 192)).mean(), (g >= 192).mean()
    return bool(midtone + light >= LEAST_MIDTONE and light >= LEAST_LIGHT and not is_inverted(image))


def stretched(image: np.ndarray, low: float = 1, high: float = 99) -> np.ndarray:
    """Gray values between two percentiles drawn out over the whole range."""
    g = gray(image)
    a, b = np.percentile(g, [low, high])
    return np.clip((g - a) / max(b - a, 1e-9) * 255, 0, 255).astype(np.uint8)


STD_LIMIT, LEAST_GAIN = 35.0, 0.4
POINTS = 50_000


def measured_skew(image: np.ndarray) -> float:
    """The angle in degrees by which lines of print fall to the right, as for ``skew``.

    Dark pixels are sheared by trial angles; lines lie straight where their counts by
    row differ most.  Whole degrees are tried first, then tenths and hundredths around.
    """
    ys, xs = np.nonzero(gray(image) < 128)
    if len(ys) < 2:
        return 0.0
    step = max(1, len(ys) // POINTS)
    ys, xs = ys[::step].astype(float), xs[::step].astype(float)

    def sharpness(angle: float) -> float:
        rows = np.floor(ys - xs * np.tan(np.radians(angle))).astype(int)
        return float(np.square(np.bincount(rows - rows.min()).astype(float)).sum())

    best = 0.0
    for width, unit in ((MOST_TURN + 1, 1.0), (1.0, 0.1), (0.1, 0.01)):
        trials = best + np.arange(-round(width / unit), round(width / unit) + 1) * unit
        best = float(max(trials, key=lambda a: (sharpness(a), -abs(a))))
    return skew(np.array([best]))


def turned(image: np.ndarray, angle: float, ground: int = 255) -> np.ndarray:
    """An image turned back by ``angle`` degrees round its middle, of the same size."""
    h, w = image.shape[:2]
    a = np.radians(angle)
    y, x = np.mgrid[0:h, 0:w]
    dy, dx = y - h / 2, x - w / 2
    sy, sx = np.rint(h / 2 + dy * np.cos(a) + dx * np.sin(a)).astype(int), np.rint(w / 2 - dy * np.sin(a) + dx * np.cos(a)).astype(int)
    inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
    out = np.full_like(image, ground)
    out[inside] = image[sy[inside], sx[inside]]
    return out


def background(image: np.ndarray, cells: int = 16) -> np.ndarray:
    """The paper's brightness over an image: the light end of each cell of a grid, drawn out smoothly."""
    g = gray(image)
    h, w = g.shape
    rows, cols = (np.array_split(np.arange(n), min(cells, n)) for n in (h, w))
    grid = np.array([[np.percentile(g[np.ix_(r, c)], 90) for c in cols] for r in rows])
    across = np.array([np.interp(np.arange(w), [c.mean() for c in cols], line) for line in grid])
    return np.array([np.interp(np.arange(h), [r.mean() for r in rows], line) for line in across.T]).T


def flattened(image: np.ndarray) -> tuple[np.ndarray, dict]:
    """An image with its paper evened out, and the measures; left as it is where the paper varies too much to be one leaf."""
    field = background(image)
    measures = {"background_std": round(float(field.std()), 3), "background_mean": round(float(field.mean()), 3)}
    if field.std() >= STD_LIMIT:
        return image, measures | {"applied": False}
    gain = np.maximum(field / max(float(field.max()), 1.0), LEAST_GAIN)
    return stretched(np.clip(gray(image) / gain, 0, 255)), measures | {"applied": True}


def prepared(image: np.ndarray) -> list[tuple[str, np.ndarray, list[dict]]]:
    """(part, image, steps) of a page: turned straight, evened out, cut at the gutter and at its margins, raised in contrast where that helps.

    The first part is the page (or its left half); the right half and the bands of the
    margins are parts of their own.
    """
    steps: list[dict] = []
    if is_inverted(image):
        return [("page", image, [{"step": "polarity", "inverted": True}])]
    angle = measured_skew(image)
    image = turned(image, angle) if angle else image
    steps.append({"step": "deskew", "angle": round(angle, 3), "rotated": bool(angle)})
    image, measures = flattened(image)
    steps.append({"step": "illumination", "metrics": measures})
    at = gutter(image)
    halves = [("page", image)] if at is None else [("page", image[:, :at]), ("right", image[:, at:])]
    steps.append({"step": "page_split", "gutter_at": at})
    out = []
    for part, half in halves:
        top, foot = margin_bands(half)
        body = half[top : len(half) - foot]
        raised = worth_enhancing(body)
        own = [*steps, {"step": "marginalia", "top_rows": top, "foot_rows": foot}, {"step": "enhance", "applied": raised}]
        out.append((part, stretched(body) if raised else body, own))
        out += [(f"{part}-{name}", band, own[:-1]) for name, band in (("top", half[:top]), ("foot", half[len(half) - foot :])) if len(band)]
    return out


def camel_record(value):
    """A record with its keys in camel case, as it is kept."""
    if isinstance(value, dict):
        return {camel(k): camel_record(v) for k, v in value.items()}
    return [camel_record(v) for v in value] if isinstance(value, list) else value


PARTS = "id string, part string, height int, width int, pixels binary, provenance string"


def preprocess(pages: DataFrame) -> DataFrame:
    """(id, part, height, width, pixels, provenance) of pages (id, height, width, channels, pixels): parts as ``prepared``, gray, with the record of their steps.

    Pixels that don't fill the stated shape give one part ``failed``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, h, w, channels, raw in b[["id", "height", "width", "channels", "pixels"]].itertuples(index=False):
                try:
                    flat = np.frombuffer(raw, np.uint8)
                    image = flat.reshape((h, w) if channels == 1 else (h, w, channels))
                except (ValueError, TypeError):
                    rows.append((key, "failed", 0, 0, None, json.dumps({"steps": []})))
                    continue
                for part, pixels, steps in prepared(image):
                    g = np.clip(np.rint(gray(pixels)), 0, 255).astype(np.uint8)
                    rows.append((key, part, *g.shape, g.tobytes(), json.dumps(camel_record({"steps": steps}))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PARTS.split(", ")])

    return pages.mapInPandas(run, PARTS)
