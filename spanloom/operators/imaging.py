"""Pixels of text regions: masks, inpainting, text layers; used inside workers on one image at a time.

Engines are protocols. The built-in ones need no library beyond numpy: a recognizer backed by a table of
regions, an inpainter that fills a mask from its border inwards, and a renderer that draws lines as bars in
place of glyphs (drawing letters needs a font engine, to be given by the caller).
"""

from __future__ import annotations

from typing import Protocol

import numpy as np

MASKED = ("translate", "remove")


class Recognizer(Protocol):
    """Finds text: (text, confidence, polygon) of each region of an image."""

    def __call__(self, pixels: np.ndarray) -> list[tuple[str, float, list[list[float]]]]: ...


class Inpainter(Protocol):
    """An image without what the mask covers."""

    def __call__(self, pixels: np.ndarray, mask: np.ndarray) -> np.ndarray: ...


class Renderer(Protocol):
    """Lines of text as a layer of the image's size: grey values and their opacity from 0 to 1."""

    def __call__(self, shape: tuple[int, int], layout: dict) -> tuple[np.ndarray, np.ndarray]: ...


def filled(shape: tuple[int, int], polygon: list[list[float]]) -> np.ndarray:
    """Which pixels a polygon covers, its border included; corners are clipped to the image."""
    h, w = shape
    points = [(min(w - 1, max(0, int(x))), min(h - 1, max(0, int(y)))) for x, y in polygon]
    out = np.zeros(shape, bool)
    if not points:
        return out
    edges = list(zip(points, points[1:] + points[:1], strict=True))
    for y in range(min(p[1] for p in points), max(p[1] for p in points) + 1):
        crossings = []
        for (x0, y0), (x1, y1) in edges:
            if y0 == y1 == y:
                out[y, min(x0, x1) : max(x0, x1) + 1] = True
            elif min(y0, y1) <= y <= max(y0, y1) and y0 != y1:
                x = x0 + (x1 - x0) * (y - y0) / (y1 - y0)
                out[y, round(x)] = True
                if y < max(y0, y1):
                    crossings.append(x)
        crossings.sort()
        for a, b in zip(crossings[::2], crossings[1::2], strict=False):
            out[y, int(np.ceil(a)) : int(np.floor(b)) + 1] = True
    return out


def grown(mask: np.ndarray, pixels: int) -> np.ndarray:
    """Every pixel within so many rows and columns of the mask."""
    for axis in (0, 1):
        wide = np.pad(mask, [(pixels, pixels) if a == axis else (0, 0) for a in (0, 1)])
        mask = np.lib.stride_tricks.sliding_window_view(wide, 2 * pixels + 1, axis).any(axis=-1)
    return mask


def text_mask(shape: tuple[int, int], regions: list[dict], grow: int = 3) -> np.ndarray:
    """255 where text is to go: the regions to be translated or removed, each grown."""
    out = np.zeros(shape, bool)
    for r in regions:
        if r["action"] in MASKED:
            out |= grown(filled(shape, r["polygon"]), grow) if grow else filled(shape, r["polygon"])
    return out.astype(np.uint8) * 255


def unchanged(pixels: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The inpainter of a system without one."""
    return pixels


def inward(pixels: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked pixels get the mean of their known neighbours, ring by ring."""
    out, known = pixels.astype(float), mask == 0
    if not known.any():
        return pixels
    while not known.all():
        total, count = np.zeros_like(out), np.zeros(known.shape)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                src = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip((dy, dx), known.shape, strict=True))
                dst = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip((dy, dx), known.shape, strict=True))
                total[dst] += np.where(known[src][..., None], out[src], 0)
                count[dst] += known[src]
        ring = ~known & (count > 0)
        out[ring] = total[ring] / count[ring][:, None]
        known |= ring
    return out.round().astype(np.uint8)


def bars(shape: tuple[int, int], layout: dict) -> tuple[np.ndarray, np.ndarray]:
    """Each line as a bar of its width, centred, line height four more than the font's."""
    alpha = np.zeros(shape)
    size, lines = layout["font_size"], layout["lines"]
    top = layout["cy"] - len(lines) * (size + 4) / 2
    for i, line in enumerate(lines):
        half = len(line) * size * 0.6 / 2
        y, x = int(top + i * (size + 4)), int(layout["cx"] - half)
        alpha[max(0, y) : max(0, y + size), max(0, x) : max(0, int(layout["cx"] + half))] = 1.0
    return np.zeros(shape, np.uint8), alpha


def composited(pixels: np.ndarray, layer: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    mixed = layer[..., None] * alpha[..., None] + pixels * (1 - alpha[..., None])
    return mixed.astype(np.uint8)


def revised(pixels: np.ndarray, regions: list[dict], render: Renderer = bars) -> np.ndarray:
    """The image with the text of its translated regions (those that have one) drawn in."""
    for r in regions:
        if r["action"] == "translate" and (r.get("text") or "").strip():
            pixels = composited(pixels, *render(pixels.shape[:2], r))
    return pixels
