"""Image analysis: perceptual hash of a grey matrix, palette of pixels. Arrow batches and numpy; iterative by nature."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.runtime import ship

SIDE, BLOCK = 32, 8
MOST_TURNS, STILL = 40, 0.5
#: Pixels of images that k-means takes together.
TOGETHER = 1 << 17
SWATCH = "array<struct<r:int,g:int,b:int,hex:string,share:double>>"


def area_weights(n: int, to: int) -> np.ndarray:
    """The share of each of n pixels in each of `to` ones; an enlarged pixel is repeated."""
    edge = np.arange(to + 1) * n / to
    at = np.arange(n)
    part = np.clip(np.minimum(edge[1:, None], at + 1) - np.maximum(edge[:-1, None], at), 0, None)
    return part / part.sum(1, keepdims=True)


def resize(a: np.ndarray, width: int, height: int) -> np.ndarray:
    return np.einsum("yh,hwc,xw->yxc", area_weights(a.shape[0], height), a, area_weights(a.shape[1], width), optimize=True)


def dct_basis(n: int) -> np.ndarray:
    """The orthonormal DCT-II matrix: row u is the u-th cosine."""
    x = np.arange(n)
    basis = np.cos((2 * x[None, :] + 1) * x[:, None] * math.pi / (2 * n)) * math.sqrt(2 / n)
    basis[0] /= math.sqrt(2)
    return basis


_BASIS = dct_basis(SIDE)[:BLOCK]


def dct2d(m: np.ndarray) -> np.ndarray:
    c = dct_basis(m.shape[-1])
    return c @ m @ c.T


def hashes_of(grays: list) -> list[str | None]:
    """The hash of each 32 x 32 grey matrix, given row by row; None for any other length or a missing value. One product for all."""
    flat = [None if g is None else np.asarray(g, np.float64) for g in grays]
    good = [i for i, m in enumerate(flat) if m is not None and m.shape == (SIDE * SIDE,) and np.isfinite(m).all()]
    out: list[str | None] = [None] * len(flat)
    if good:
        blocks = (_BASIS @ np.stack([flat[i] for i in good]).reshape(-1, SIDE, SIDE) @ _BASIS.T).reshape(len(good), -1)
        bits = blocks > np.median(blocks[:, 1:], 1, keepdims=True)
        for i, packed in zip(good, np.packbits(bits, 1), strict=True):
            out[i] = packed.tobytes().hex()
    return out


def hash_of(gray) -> str | None:
    return hashes_of([gray])[0]


def channel_values(pixels) -> np.ndarray:
    """Flat r, g, b values, given as bytes or as numbers."""
    return np.frombuffer(pixels, np.uint8) if isinstance(pixels, (bytes, bytearray, memoryview)) else np.asarray(pixels)


class Uniform:
    """The mulberry32 sequence: a published 32-bit generator, the same for a seed everywhere; its constants are fixed values."""

    def __init__(self, seed: int):
        self.state = seed % (1 << 32)

    def next(self) -> float:
        mask = 0xFFFFFFFF
        self.state = (self.state + 0x6D2B79F5) & mask
        z = self.state
        z = (z ^ z >> 15) * (z | 1) & mask
        z ^= z + ((z ^ z >> 7) * (z | 61) & mask) & mask
        return ((z ^ z >> 14) & mask) / 2**32


def seed_of(data: bytes) -> int:
    """FNV-1a, a published hash, of every 997th byte; its constants and the stride are fixed values."""
    h = 0x811C9DC5
    for byte in data[::997]:
        h = (h ^ byte) * 0x01000193 % (1 << 32)
    return h


def _first_centres(px: np.ndarray, k: int, random: Uniform) -> np.ndarray:
    """k-means++: each next centre is a pixel drawn with the square of its distance to those before as weight."""
    centres = np.empty((k, 3))
    centres[0] = px[int(random.next() * len(px))]
    near = ((px - centres[0]) ** 2).sum(1)
    for i in range(1, k):
        weight = np.cumsum(near)
        if weight[-1] == 0:
            centres[i] = centres[i - 1]
            continue
        centres[i] = px[min(int(np.searchsorted(weight, random.next() * weight[-1])), len(px) - 1)]
        near = np.minimum(near, ((px - centres[i]) ** 2).sum(1))
    return centres


def k_means(pixels, k: int = 5, seed: int = 1) -> dict:
    """k_means_all of one image."""
    return k_means_all([pixels], k, [seed])[0]


def k_means_all(images: list, k: int, seeds: list[int]) -> list[dict]:
    """{swatches, iterations, inertia} of each image of flat r, g, b values.

    At most 40 turns, until no centre moves by half a step. A pixel goes to the first of equally near centres; a centre
    without pixels stays and gives no swatch. Shares are of the last assignment, colours of the update after it. Largest
    share first, then by hex. No pixel: no swatch.

    Images with as many pixels and centres take their turns together, a bounded number of values at a time; each leaves
    when it is still.
    """
    out: list[dict] = [{"swatches": [], "iterations": 0, "inertia": 0.0} for _ in images]
    alike: dict[int, list[int]] = {}
    every = []
    for i, pixels in enumerate(images):
        px = channel_values(pixels).astype(np.float64)
        every.append(px[: len(px) // 3 * 3].reshape(-1, 3))
        if len(every[i]):
            alike.setdefault(len(every[i]), []).append(i)
    for n, members in alike.items():
        own, step = max(1, min(k, n)), max(1, TOGETHER // n)
        for at in range(0, len(members), step):
            some = members[at : at + step]
            start = np.stack([_first_centres(every[i], own, Uniform(seeds[i])) for i in some])
            for i, found in zip(some, _turns(np.stack([every[i].T for i in some]), start), strict=True):
                out[i] = found
    return out


def _turns(px: np.ndarray, centres: np.ndarray) -> list[dict]:
    """Lloyd's turns for images (image, channel, pixel) from centres (image, centre, channel)."""
    count, k, n = len(px), centres.shape[1], px.shape[2]
    before, turns, sizes = centres.copy(), np.zeros(count, int), np.zeros((count, k), np.int64)
    nearest, going = np.zeros((count, n), np.int64), np.arange(count)
    for turn in range(1, MOST_TURNS + 1):
        x, c = px[going], centres[going]
        # the square of a pixel is the same for all centres: one matrix product leaves the order of their distances
        group = ((c**2).sum(2)[:, :, None] - 2 * c @ x).argmin(1)
        place = (group + k * np.arange(len(going))[:, None]).ravel()
        sums = [np.bincount(place, x[:, i].ravel(), k * len(going)) for i in range(3)]
        size = np.bincount(place, minlength=k * len(going)).reshape(-1, k)
        used = size > 0
        means = np.where(used[:, :, None], np.stack(sums, 1).reshape(-1, k, 3) / np.maximum(size, 1)[:, :, None], c)
        moved = np.sqrt(((means - c) ** 2).sum(2)).max(1)
        before[going], centres[going], nearest[going], sizes[going], turns[going] = c, means, group, size, turn
        going = going[moved >= STILL]
        if not len(going):
            break
    out = []
    colours = np.floor(centres + 0.5).astype(int)
    for i in range(count):
        inertia = float(((px[i].T - before[i][nearest[i]]) ** 2).sum(1).mean())
        swatches = [{"r": int(r), "g": int(g), "b": int(b), "hex": f"#{r:02x}{g:02x}{b:02x}", "share": float(m / n)} for (r, g, b), m in zip(colours[i], sizes[i], strict=True) if m]
        out.append({"swatches": sorted(swatches, key=lambda s: (-s["share"], s["hex"])), "iterations": int(turns[i]), "inertia": inertia})
    return out


def perceptual_hashes(images: DataFrame, gray: str = "gray", out: str = "phash") -> DataFrame:
    """images with the hash of a column of 1,024 grey values; null where that can't be hashed."""

    ship(images.sparkSession)

    @F.pandas_udf("string")
    def hash_all(batch: pd.Series) -> pd.Series:
        return pd.Series(hashes_of(list(batch)), dtype=object)

    return images.withColumn(out, _once(hash_all)(gray))


def _once(udf):
    """A function that Catalyst must not repeat: it would copy a deterministic one into filters that it derives from an explode."""
    return udf.asNondeterministic()


def palettes(images: DataFrame, pixels: str = "pixels", *, k: int = 5, seed: int | str = 1) -> DataFrame:
    """images with `palette`, `iterations` and `inertia` from a column of flat r, g, b values (bytes or numbers); seed is a number or a column.

    Each image is clustered by itself within its Arrow batch: there is no shuffle. Null pixels give a null palette.
    """
    kind = f"palette {SWATCH}, iterations int, inertia double"

    ship(images.sparkSession)

    @F.pandas_udf(kind)
    def cluster(batch: pd.Series, seeds: pd.Series) -> pd.DataFrame:
        given = [i for i, p in enumerate(batch) if p is not None]
        found: list[dict] = [{"swatches": None, "iterations": None, "inertia": None}] * len(batch)
        for i, one in zip(given, k_means_all([batch[i] for i in given], k, [int(seeds[i]) for i in given]), strict=True):
            found[i] = one
        return pd.DataFrame({"palette": [f["swatches"] for f in found], "iterations": pd.array([f["iterations"] for f in found], "Int32"), "inertia": [f["inertia"] for f in found]})

    seeds = F.col(seed) if isinstance(seed, str) else F.lit(seed)
    return images.withColumn("_c", _once(cluster)(pixels, seeds)).select("*", "_c.*").drop("_c")


def analyze(images: DataFrame, *, k: int = 5, content: str | None = None) -> DataFrame:
    """images (gray, pixels) with phash, palette, analyzed and error: either part may fail by itself; the first failure is kept.

    The seed of the palette is made of the bytes of a column `content`, the image's file, if one is named; else of the pixels.
    """
    kind = f"phash string, palette {SWATCH}, analyzed boolean, error string"

    ship(images.sparkSession)

    @F.pandas_udf(kind)
    def both(gray: pd.Series, pixels: pd.Series, data: pd.Series) -> pd.DataFrame:
        hashes, values, wrong = hashes_of(list(gray)), {}, {}
        for i, x in enumerate(pixels):
            try:
                values[i] = channel_values(x).astype(np.uint8)
            except (TypeError, ValueError) as e:
                wrong[i] = f"no palette: {e}"
        seeds = [seed_of(data[i] if data[i] is not None else v.tobytes()) for i, v in values.items()]
        found = dict(zip(values, k_means_all(list(values.values()), k, seeds), strict=True))
        rows = []
        for i, phash in enumerate(hashes):
            palette, error = found[i]["swatches"] if i in found else None, wrong.get(i)
            rows.append((phash, palette, phash is not None or palette is not None, error if phash else "no grey matrix of 32 x 32"))
        return pd.DataFrame(rows, columns=["phash", "palette", "analyzed", "error"])

    data = F.col(content) if content else F.lit(None).cast("binary")
    return images.withColumn("_a", _once(both)("gray", "pixels", data)).select("*", "_a.*").drop("_a")


# The base table of luminance quantisation of the JPEG standard (its annex K), row by row.
QUANTA = (
    (16, 11, 10, 16, 24, 40, 51, 61), (12, 12, 14, 19, 26, 58, 60, 55), (14, 13, 16, 24, 40, 57, 69, 56), (14, 17, 22, 29, 51, 87, 80, 62),
    (18, 22, 37, 56, 68, 109, 103, 77), (24, 35, 55, 64, 81, 104, 113, 92), (49, 64, 78, 87, 103, 121, 120, 101), (72, 92, 95, 98, 112, 100, 103, 99),
)
LUMA = np.array([0.2126, 0.7152, 0.0722])


def _quantised(a: np.ndarray, quality: int) -> np.ndarray:
    """What a lossy encoding of 8 x 8 blocks leaves of a height x width x 3 image: coefficients are rounded to multiples of the table's."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    step = np.clip(np.floor((np.array(QUANTA) * scale + 50) / 100), 1, 255)
    h, w = a.shape[:2]
    c = dct_basis(8)
    full = np.pad(a - 128, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    blocks = full.reshape(full.shape[0] // 8, 8, full.shape[1] // 8, 8, 3).transpose(0, 2, 4, 1, 3)
    rounded = np.round(c @ blocks @ c.T / step) * step
    out = (c.T @ rounded @ c).transpose(0, 3, 1, 4, 2).reshape(full.shape)
    return np.clip(out[:h, :w] + 128, 0, 255)


def _smoothed(a: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian blur, one axis after the other, edges repeated."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()
    for axis in (0, 1):
        n = a.shape[axis]
        at = np.clip(np.arange(n)[:, None] + np.arange(-reach, reach + 1)[None], 0, n - 1)
        weights = np.zeros((n, n))
        np.add.at(weights, (np.arange(n)[:, None], at), kernel[None])
        a = np.tensordot(weights, a, (1, axis)) if axis == 0 else np.tensordot(a, weights, (1, 1)).transpose(0, 2, 1)
    return a


def edits() -> dict[str, tuple]:
    """Sixteen transforms of a height x width x 3 image (0..255), and whether a copy made by each should be found.

    Encodings are imitated by rounding in the frequency domain, sizes are changed by area; two edits change the picture's
    layout, which the hash isn't made to survive, and are reported apart.
    """

    def sized(a: np.ndarray, part: float) -> np.ndarray:
        h, w = (max(1, int(n * part + 0.5)) for n in a.shape[:2])
        return resize(a, w, h)

    def cropped(a: np.ndarray, part: float) -> np.ndarray:
        (h, w), r = a.shape[:2], lambda x: int(x + 0.5)
        top, left = r(h * part / 2), r(w * part / 2)
        return a[top : top + r(h * (1 - part)), left : left + r(w * (1 - part))]

    def marked(a: np.ndarray) -> np.ndarray:
        (h, w), a, edge = a.shape[:2], a.copy(), 8
        mh, mw = int(h * 0.12 + 0.5), int(w * 0.3 + 0.5)
        part = a[h - mh - edge : h - edge, w - mw - edge : w - edge]
        part[:] = 0.25 * part + 0.75 * 255
        return a

    grey = lambda a: np.repeat((a @ LUMA)[:, :, None], 3, 2)
    clip = lambda a: np.clip(a, 0, 255)
    # Names, in the order in which they are reported, and amounts.
    return {
        "re-encode JPEG q40": (lambda a: _quantised(a, 40), True), "re-encode JPEG q15": (lambda a: _quantised(a, 15), True),
        "resize to 25%": (lambda a: sized(a, 0.25), True), "resize to 150%": (lambda a: sized(a, 1.5), True), "convert to PNG": (lambda a: a, True),
        "brightness +20%": (lambda a: clip(a * 1.2), True), "brightness -20%": (lambda a: clip(a * 0.8), True),
        "saturation +50%": (lambda a: clip(grey(a) + 1.5 * (a - grey(a))), True), "greyscale": (grey, True),
        "sharpen": (lambda a: clip(2 * a - _smoothed(a, 2)), True), "blur": (lambda a: _smoothed(a, 3), True),
        "crop 5%": (lambda a: cropped(a, 0.05), True), "crop 15%": (lambda a: cropped(a, 0.15), True), "watermark corner": (marked, True),
        "rotate 90°": (lambda a: np.rot90(a, -1), False), "flip horizontal": (lambda a: a[:, ::-1], False),
    }


def edited_hashes(images: DataFrame) -> DataFrame:
    """(pin_id, edit, in_scope, phash) for every edit of every image (id, width, height, pixels: flat r, g, b values), and (id, "original").

    Images whose values don't fill width and height are left out.
    """
    kind = f"pin_id {images.schema['id'].dataType.simpleString()}, edit string, in_scope boolean, phash string"

    ship(images.sparkSession)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = {"original": (lambda a: a, True), **edits()}
        for b in batches:
            rows, grays = [], []
            for i, w, h, px in zip(b["id"], b["width"], b["height"], b["pixels"], strict=True):
                if px is None or len(px) != w * h * 3:
                    continue
                a = channel_values(px).reshape(int(h), int(w), 3).astype(float)
                for name, (f, ok) in every.items():
                    rows.append((i, name, ok))
                    grays.append(np.floor(resize(f(a), SIDE, SIDE) @ LUMA + 0.5).ravel())
            yield pd.DataFrame([(*r, h) for r, h in zip(rows, hashes_of(grays), strict=True)], columns=["pin_id", "edit", "in_scope", "phash"])

    return images.select("id", "width", "height", "pixels").mapInPandas(make, kind)
