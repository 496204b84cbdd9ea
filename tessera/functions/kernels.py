"""Neighbourhood operations on stacks of images (images, height, width, channels) with values in [0, 1].

These are for score tables of many configurations, where a pair is preprocessed under every set of flags: Spark hands them Arrow
batches of pairs (see operators.scores).  functions.filters has the same filters on pixel rows, without Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np

from .pixels import EPSILON, GRAY, IDENTICAL_PSNR

#: Rows of hematoxylin, eosin and DAB in red, green and blue.
STAINS = np.array([[0.65, 0.70, 0.29], [0.07, 0.99, 0.11], [0.27, 0.57, 0.78]])
#: Weights of the scales of MS-SSIM.
SCALES = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)
#: Values that are worked on at once, so that they stay in a core's cache.
PART = 1 << 16
#: Up to so many pixels a tile's histogram is read from the pixels, not written out.
SMALL_TILE = 16


def _by_parts(f, size: int, *stacks: np.ndarray) -> np.ndarray:
    """f of a few images of each stack at a time; size: values that f makes of an image."""
    each = max(1, PART // max(size, 1))
    return np.concatenate([f(*(x[at : at + each] for x in stacks)) for at in range(0, max(len(stacks[0]), 1), each)])


def min_max(x: np.ndarray) -> np.ndarray:
    low, high = x.min(axis=(1, 2), keepdims=True), x.max(axis=(1, 2), keepdims=True)
    return (x - low) / (high - low + EPSILON)


def gray(x: np.ndarray) -> np.ndarray:
    return (x @ np.array(GRAY))[..., None] if x.shape[-1] == 3 else x


def hematoxylin(x: np.ndarray) -> np.ndarray:
    """1 minus the hematoxylin stain, scaled by its 99th percentile in each image."""
    density = np.log(np.maximum(x, 1e-6)) / np.log(1e-6)
    h = np.maximum(density @ np.linalg.inv(STAINS), 0)[..., :1]
    top = np.percentile(h, 99, axis=(1, 2), keepdims=True)
    return 1 - np.clip(np.divide(h, top, out=np.zeros_like(h), where=top > 0), 0, 1)


def _ends(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place (from 1) of sorted rows the last end of equal values up to it (0 if there is none), and the first from it on."""
    k = x.shape[1]
    last = np.ones(x.shape, bool)
    last[:, :-1] = (x[:, 1:] != x[:, :-1]) & (x[:, :-1] == x[:, :-1])  # what is no number comes last, and is equal
    place = np.arange(1, k + 1)
    before = np.maximum.accumulate(np.where(last, place, 0), axis=1)
    return before, np.minimum.accumulate(np.where(last, place, k)[:, ::-1], axis=1)[:, ::-1]


def match_histogram(src: np.ndarray, trg: np.ndarray) -> np.ndarray:
    """src with the values that have its places in the distribution of trg (of the same size), channel by channel."""

    def run(src: np.ndarray, trg: np.ndarray) -> np.ndarray:
        n, h, w, c = src.shape
        own, other = (np.moveaxis(x, -1, 1).reshape(n * c, h * w) for x in (src, trg))
        order, other = np.argsort(own, axis=1), np.sort(other, axis=1)
        low, high = _ends(other)
        k, place, start = h * w, np.arange(1, h * w + 1), np.maximum(low, 1)
        first, last = (np.take_along_axis(other, at - 1, axis=1) for at in (start, high))
        known = (low == place) | (low == 0)
        rise = (last - first) / np.where(known, 1, high / k - start / k)
        of_place = np.where(known, first, rise * (place / k - start / k) + first)
        out = np.empty_like(of_place)
        _, up_to = _ends(np.take_along_axis(own, order, axis=1))
        np.put_along_axis(out, order, np.take_along_axis(of_place, up_to - 1, axis=1), axis=1)
        return np.moveaxis(out.reshape(n, c, h, w), 1, -1)

    return _by_parts(run, src[:1].size, src, trg)


def _neighbours(x: np.ndarray, r: int, axes: tuple[int, ...]) -> np.ndarray:
    """A stack moved by -r to r places along the axes (1 and 2), borders repeated: one copy for each move."""
    h, w = x.shape[1:3]
    moves = [range(2 * r + 1) if a in axes else (r,) for a in (1, 2)]
    padded = np.pad(x, ((0, 0), (r, r), (r, r), (0, 0)), mode="edge")
    return np.stack([padded[:, dy : dy + h, dx : dx + w] for dy in moves[0] for dx in moves[1]])


def _middle(x: list[np.ndarray]) -> np.ndarray:
    """The median of an odd number of arrays, place by place; x is used up.

    Of one more than half of the arrays that are left neither the smallest value nor the largest is the median.
    """
    rest, free = list(x), np.empty_like(x[0])

    def exchange(i: int, j: int) -> None:
        nonlocal free
        np.minimum(held[i], held[j], out=free)
        np.maximum(held[i], held[j], out=held[j])
        held[i], free = free, held[i]

    held = [rest.pop() for _ in range(len(rest) // 2 + 2)] if len(rest) > 1 else rest
    while len(held) > 1:
        k = len(held)
        for i in range(k // 2):
            exchange(i, k - 1 - i)
        for i in range(1, (k + 1) // 2):
            exchange(0, i)
        for i in range(k // 2, k - 1):
            exchange(i, k - 1)
        held = held[1:-1] + [rest.pop() for _ in range(min(1, len(rest)))]
    return held[0]


def median_smooth(x: np.ndarray, size: int = 5) -> np.ndarray:
    r, h, w = size // 2, *x.shape[1:3]
    n = (2 * r + 1) ** 2
    rows, columns = (np.clip(np.arange(-r, k + r), 0, k - 1) for k in (h, w))

    def run(v: np.ndarray) -> np.ndarray:
        padded = np.ascontiguousarray(np.moveaxis(v, 0, -1))[rows][:, columns]  # images last: long runs of values
        near = [padded[dy : dy + h, dx : dx + w].copy() for dy in range(2 * r + 1) for dx in range(2 * r + 1)]
        found = np.partition(near, n // 2, axis=0)[n // 2] if np.isnan(v).any() else _middle(near)  # what is no number comes last
        return np.ascontiguousarray(np.moveaxis(found, -1, 0))

    return _by_parts(run, x[:1].size * 8, x)


def gaussian_smooth(x: np.ndarray, size: int = 5) -> np.ndarray:
    """With the deviation that goes with a kernel of this size, repeated borders."""
    r, sigma = (size - 1) // 2, 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    once = lambda v, axis: np.tensordot(k, _neighbours(v, r, (axis,)), axes=1)
    return _by_parts(lambda v: once(once(v, 1), 2), x[:1].size * size, x)


def smooth(x: np.ndarray, method: str = "gaussian", size: int = 5) -> np.ndarray:
    if method not in ("gaussian", "median"):
        raise ValueError(f"unknown smoothing {method}")
    return gaussian_smooth(x, size) if method == "gaussian" else median_smooth(x, size)


def non_white(x: np.ndarray, threshold: float | None = None, percentile: float = 80, buffer: float = 5) -> np.ndarray:
    """1 where gray (0 to 255) is below the threshold, or below the image's percentile less a buffer."""
    g = gray(x)[..., 0]
    limit = np.percentile(g, percentile, axis=(1, 2), keepdims=True) - buffer if threshold is None else threshold
    return (g < limit).astype(np.int32)


def equalise_tiles(planes: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited histogram equalisation of a stack of planes (images, height, width) of whole numbers 0 to 255."""
    h, w = planes.shape[1:]
    ph, pw = -h % tiles, -w % tiles
    padded = np.pad(planes, ((0, 0), (0, ph), (0, pw)), mode="reflect" if min(h, w) > max(ph, pw) else "edge")
    th, tw = padded.shape[1] // tiles, padded.shape[2] // tiles
    blocks = padded.reshape(-1, tiles, th, tiles, tw).transpose(1, 3, 2, 4, 0).reshape(tiles, tiles, th * tw, -1)  # images last
    planes = np.ascontiguousarray(planes.transpose(1, 2, 0))
    limit = max(int(clip * th * tw / 256), 1)
    levels = lambda n: np.clip(np.round(n * 255 / (th * tw)), 0, 255)
    if th * tw <= SMALL_TILE:
        earlier = np.stack([(blocks[:, :, :i] == blocks[:, :, i : i + 1]).sum(axis=2) for i in range(th * tw)], axis=2)
        counted = earlier < limit
        rest = th * tw - counted.sum(axis=2)  # pixels above the limit: one each for evenly spaced levels
        step = np.maximum(256 // np.maximum(rest, 1), 1)

        def at(y: np.ndarray, x: np.ndarray) -> np.ndarray:
            tile = lambda of: of[y[:, None], x[None, :]]
            own = (tile(counted) & (tile(blocks) <= planes[:, :, None])).sum(axis=2)
            return levels(own + np.minimum(planes // tile(step) + 1, tile(rest)))

    else:
        lut = []
        for image in np.moveaxis(blocks.reshape(tiles * tiles, th * tw, -1), -1, 0):
            hist = np.stack([np.bincount(b, minlength=256) for b in image])
            excess = np.maximum(hist - limit, 0).sum(axis=1)
            hist = np.minimum(hist, limit) + (excess // 256)[:, None]
            for row, rest in zip(hist, excess % 256, strict=True):
                if rest:
                    row[:: max(256 // int(rest), 1)][: int(rest)] += 1
            lut.append(levels(np.cumsum(hist, axis=1)).reshape(tiles, tiles, 256))

        def at(y: np.ndarray, x: np.ndarray) -> np.ndarray:
            return np.stack([t[y[:, None], x[None, :], planes[..., i]] for i, t in enumerate(lut)], axis=-1)

    def between(n: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(n) / t - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = between(h, th), between(w, tw)
    fy, fx = fy[:, None, None], fx[:, None]
    top = at(y0, x0) * (1 - fx) + at(y0, x1) * fx
    low = at(y1, x0) * (1 - fx) + at(y1, x1) * fx
    return np.ascontiguousarray(np.round(top * (1 - fy) + low * fy).astype(np.uint8).transpose(2, 0, 1))


#: Linear sRGB to CIE XYZ under D65, and its white.
_TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])


def _lab(rgb: np.ndarray) -> np.ndarray:
    linear = np.where(rgb > 0.04045, ((rgb + 0.055) / 1.055) ** 2.4, rgb / 12.92)
    t = linear @ _TO_XYZ.T / _WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    light = np.where(t[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * t[..., 1])
    return np.stack([light, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], axis=-1)


def _from_lab(lab: np.ndarray) -> np.ndarray:
    fy = (lab[..., 0] + 16) / 116
    f = np.stack([fy + lab[..., 1] / 500, fy, fy - lab[..., 2] / 200], axis=-1)
    t = np.where(f > 6 / 29, f**3, (f - 16 / 116) / 7.787)
    linear = np.clip(t * _WHITE @ np.linalg.inv(_TO_XYZ).T, 0, 1)
    return np.where(linear > 0.0031308, 1.055 * linear ** (1 / 2.4) - 0.055, 12.92 * linear)


def clahe(x: np.ndarray) -> np.ndarray:
    """Of one channel, or of the lightness of three."""
    if x.shape[-1] not in (1, 3):
        raise ValueError("images have one or three channels")

    def run(x: np.ndarray) -> np.ndarray:
        x8 = (np.clip(x, 0, 1) * 255).astype(np.uint8)
        if x.shape[-1] == 1:
            return equalise_tiles(x8[..., 0])[..., None] / 255
        lab = _lab(x8 / 255)
        light = equalise_tiles(np.round(lab[..., 0] * 255 / 100).astype(np.uint8))
        return _from_lab(np.concatenate([light[..., None] * (100 / 255), lab[..., 1:]], axis=-1))

    return _by_parts(run, x[:1].size * 4, x)


def preprocess(src: np.ndarray, trg: np.ndarray, config: dict) -> tuple[np.ndarray, np.ndarray]:
    """Both sides of a stack of pairs: scale, min-max, channel, flip, histogram, CLAHE, smoothing."""
    return next(preprocessed(src, trg, [config]))


def _begun(src: np.ndarray, trg: np.ndarray, config: dict) -> tuple[np.ndarray, np.ndarray]:
    """Scale, min-max, channel and flip."""
    src, trg = (np.where(x.max(axis=(1, 2, 3), keepdims=True) > 1, x / 255, x) for x in (src, trg))
    if config.get("normalization"):
        src, trg = min_max(src), min_max(trg)
    mode = config.get("channel_mode", "rgb")
    if mode == "gray":
        src, trg = gray(src), gray(trg)
    elif mode == "hed":
        src, trg = (hematoxylin(x) if x.shape[-1] == 3 else x for x in (src, trg))  # stains need three channels
    if config.get("flip_intensity"):
        src, trg = 1 - src, 1 - trg
    return src, trg


def preprocessed(src: np.ndarray, trg: np.ndarray, configs: list[dict]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What preprocess gives, for each configuration in turn.

    Those that follow each other and begin with the same steps share what these give.  trg knows nothing of histograms.
    """
    begin, kept = None, {}
    for config in configs:
        own = [config.get(f) for f in ("normalization", "channel_mode", "flip_intensity")]
        if own != begin:
            begin, kept = own, dict(zip((("src",), ("trg",)), _begun(src, trg, config), strict=True))
        out = []
        for side in ("src", "trg"):
            done = (side,)
            for step in ("match_histogram", "clahe", "smoothing"):
                if not config.get(step) or (side, step) == ("trg", "match_histogram"):
                    continue
                x, done = kept[done], (*done, step)
                if done not in kept:
                    kept[done] = match_histogram(x, kept["trg",]) if step == "match_histogram" else clahe(x) if step == "clahe" else median_smooth(x)
            out.append(kept[done])
        yield tuple(out)


@dataclass(frozen=True)
class Inputs:
    """What a measure that wants all of it gets: preprocessed stacks, masks (images, height, width) or None, and background."""

    src: np.ndarray
    trg: np.ndarray
    mask: np.ndarray | None
    background: float


def background(config: dict) -> float:
    """The value of what is no tissue: white, or black if intensities are flipped."""
    return 0.0 if config.get("flip_intensity") else 1.0


def filled(x: np.ndarray, mask: np.ndarray | None, fill: float) -> np.ndarray:
    return x if mask is None else x * mask[..., None] + fill * (1 - mask[..., None])


def where_masked(kernel):
    """The kernel on the pixels where the mask is 1, image by image; on all of them without a mask."""

    @wraps(kernel)
    def run(x: np.ndarray, y: np.ndarray, mask: np.ndarray | None = None, **params) -> np.ndarray:
        if mask is None:
            return kernel(x, y, **params)
        return np.array([kernel(a[m == 1][None], b[m == 1][None], **params)[0] if (m == 1).any() else np.nan for a, b, m in zip(x, y, mask, strict=True)])

    return run


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(len(x), -1)


@where_masked
def ncc(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = _flat(x), _flat(y)
    if x.shape[1] <= 1:
        return np.zeros(len(x))
    z = [(v - v.mean(axis=1, keepdims=True)) / (v.std(axis=1, ddof=1, keepdims=True) + EPSILON) for v in (x, y)]
    return (z[0] * z[1]).sum(axis=1) / (x.shape[1] - 1)


@where_masked
def psnr(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    mse = ((_flat(x) - _flat(y)) ** 2).mean(axis=1)
    return np.where(mse == 0, IDENTICAL_PSNR, -10 * np.log10(np.where(mse == 0, 1, mse)))


@where_masked
def mutual_information(x: np.ndarray, y: np.ndarray, bins: int = 32) -> np.ndarray:
    def binned(v: np.ndarray) -> np.ndarray:
        low, high = v.min(axis=1, keepdims=True), v.max(axis=1, keepdims=True)
        low, width = np.where(high > low, low, low - 0.5), np.where(high > low, high - low, 1.0)
        return np.minimum((v - low) / width * bins, bins - 1).astype(np.int64)

    def run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        bx, by = binned(x), binned(y)
        n, cells = len(bx), bins * bins
        count = np.bincount((np.arange(n)[:, None] * cells + bx * bins + by).ravel(), minlength=n * cells)
        some = np.flatnonzero(count)  # of few pixels most cells have none
        p, out = np.zeros(n * cells), np.zeros(n * cells)
        p[some] = own = count[some] / (bx.shape[1] + 1e-9)
        table = p.reshape(n, bins, bins)
        rows, columns = table.sum(axis=2).ravel(), table.sum(axis=1).ravel()
        base = rows[some // bins] * columns[some // cells * bins + some % bins]
        out[some] = own * np.log(own / base)
        return out.reshape(n, bins, bins).sum(axis=(1, 2))

    return _by_parts(run, max(bins * bins, x[:1].size) * 2, _flat(x), _flat(y))


def ssim(x: np.ndarray, y: np.ndarray, win_size: int = 7, mask: np.ndarray | None = None) -> np.ndarray:
    """Mean of the structural-similarity map, where the mask is 1 if there is one; borders mirrored."""
    if win_size > min(x.shape[1:3]):
        raise ValueError("the window exceeds the image")
    k, r = win_size, win_size // 2
    rows, columns = (np.pad(np.arange(n), (r + 1, r), mode="symmetric") for n in x.shape[1:3])

    def mean(v: np.ndarray) -> np.ndarray:
        total = v[rows][:, columns]  # images last: rows and columns are summed up for all of them at once
        total[0] = total[:, 0] = 0
        for i in range(1, len(rows)):
            total[i] += total[i - 1]
        for j in range(1, len(columns)):
            total[:, j] += total[:, j - 1]
        return (total[k:, k:] - total[:-k, k:] - total[k:, :-k] + total[:-k, :-k]) / (k * k)

    def run(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = (np.ascontiguousarray(np.moveaxis(v, 0, -1)) for v in (x, y))
        unbiased = win_size**2 / (win_size**2 - 1)
        ux, uy = mean(x), mean(y)
        vx, vy, vxy = (unbiased * (mean(a * b) - ua * ub) for a, b, ua, ub in ((x, x, ux, ux), (y, y, uy, uy), (x, y, ux, uy)))
        c1, c2 = 0.01**2, 0.03**2
        similar = ((2 * ux * uy + c1) * (2 * vxy + c2)) / ((ux**2 + uy**2 + c1) * (vx + vy + c2))
        return np.ascontiguousarray(np.moveaxis(similar, -1, 0))

    similar = _by_parts(run, x[:1].size * 8, x, y)
    return where_masked(lambda s, _: _flat(s).mean(axis=1))(similar, similar, mask)


def ms_ssim(x: np.ndarray, y: np.ndarray, size: int = 11, sigma: float = 1.5, mask: np.ndarray | None = None, fill: float = 0.0) -> np.ndarray:
    """Over five scales; both sides need (size - 1) * 16 + 1 pixels.  Pixels where the mask is 0 have the value `fill`."""
    x, y = filled(x, mask, fill), filled(y, mask, fill)
    if min(x.shape[1:3]) < (size - 1) * 2 ** (len(SCALES) - 1) + 1:
        raise ValueError("the images are too small for five scales")
    k = np.exp(-0.5 * ((np.arange(size) - size // 2) / sigma) ** 2)
    k /= k.sum()

    def blur(v: np.ndarray) -> np.ndarray:
        for axis in (1, 2):
            v = np.lib.stride_tricks.sliding_window_view(v, size, axis=axis) @ k
        return v

    c1, c2, out = 0.01**2, 0.03**2, 1.0
    for scale, weight in enumerate(SCALES):
        if scale:
            x, y = (np.pad(v, ((0, 0), (0, v.shape[1] % 2), (0, v.shape[2] % 2), (0, 0)), mode="edge") for v in (x, y))
            x, y = (v.reshape(len(v), v.shape[1] // 2, 2, v.shape[2] // 2, 2, -1).mean(axis=(2, 4)) for v in (x, y))
        ux, uy = blur(x), blur(y)
        vx, vy, vxy = blur(x * x) - ux * ux, blur(y * y) - uy * uy, blur(x * y) - ux * uy
        part = (2 * vxy + c2) / (vx + vy + c2)
        if scale == len(SCALES) - 1:
            part = part * (2 * ux * uy + c1) / (ux**2 + uy**2 + c1)
        out = out * np.maximum(part.mean(axis=(1, 2)), 0) ** weight
    return out.mean(axis=-1)


#: RGB to YIQ.
_YIQ = np.array([[0.299, 0.587, 0.114], [0.5959, -0.2746, -0.3213], [0.2115, -0.5227, 0.3112]])


def phase_congruency(plane: np.ndarray, scales: int = 4, orientations: int = 4) -> np.ndarray:
    """Of a stack of planes, by log-Gabor filters."""
    n, h, w = plane.shape
    fy, fx = np.meshgrid(np.fft.fftfreq(h), np.fft.fftfreq(w), indexing="ij")
    radius, angle = np.hypot(fx, fy), np.arctan2(-fy, fx)
    radius[0, 0] = 1
    low_pass = 1 / (1 + (radius / 0.45) ** 30)
    image = np.fft.fft2(plane)
    energy, total = np.zeros(plane.shape), np.zeros(plane.shape)
    for o in range(orientations):
        turn = angle - o * np.pi / orientations
        apart = np.abs(np.arctan2(np.sin(turn), np.cos(turn)))
        spread = np.exp(-(apart**2) / (2 * (np.pi / orientations / 1.2) ** 2))
        responses, noise = [], None
        for s in range(scales):
            centre = 1 / (6 * 2**s)
            gabor = np.exp(-(np.log(radius / centre) ** 2) / (2 * np.log(0.55) ** 2)) * low_pass
            gabor[0, 0] = 0
            responses.append(np.fft.ifft2(image * gabor * spread))
            if s == 0:
                noise = np.median(np.abs(responses[0]).reshape(n, -1) ** 2, axis=1) / np.log(2)
        whole = np.sum(responses, axis=0)
        mean = whole / (np.abs(whole) + 1e-8)
        own = sum(r.real * mean.real + r.imag * mean.imag - np.abs(r.real * mean.imag - r.imag * mean.real) for r in responses)
        level = np.sqrt(noise) * sum(2.0**-s for s in range(scales)) * (np.sqrt(np.pi / 2) + 2 * np.sqrt(2 - np.pi / 2)) / 1.7
        energy += np.maximum(own - level[:, None, None], 0)
        total += sum(np.abs(r) for r in responses)
    return energy / (total + 1e-8)


def fsim(x: np.ndarray, y: np.ndarray, chromatic: bool = False) -> np.ndarray:
    """Feature similarity of phase congruency and gradients (and of colour, if chromatic)."""
    if chromatic and x.shape[-1] == 1:
        x, y = np.repeat(x, 3, axis=-1), np.repeat(y, 3, axis=-1)
    step = max(1, round(min(x.shape[1:3]) / 256))
    if step > 1:
        h, w = x.shape[1] // step * step, x.shape[2] // step * step
        x, y = (v[:, :h, :w].reshape(len(v), h // step, step, w // step, step, -1).mean(axis=(2, 4)) for v in (x, y))
    x, y = x * 255, y * 255
    x, y = (v @ _YIQ.T if v.shape[-1] == 3 else v for v in (x, y))
    lx, ly = x[..., 0], y[..., 0]
    px, py = phase_congruency(lx), phase_congruency(ly)
    scharr = np.array([[3, 0, -3], [10, 0, -10], [3, 0, -3]]) / 16

    def gradient(v: np.ndarray) -> np.ndarray:
        win = np.lib.stride_tricks.sliding_window_view(np.pad(v, ((0, 0), (1, 1), (1, 1))), (3, 3), axis=(1, 2))
        return np.hypot((win * scharr).sum(axis=(-2, -1)), (win * scharr.T).sum(axis=(-2, -1)))

    near = lambda a, b, t: (2 * a * b + t) / (a**2 + b**2 + t)
    both = near(px, py, 0.85) * near(gradient(lx), gradient(ly), 160)
    if chromatic:
        colour = near(x[..., 1], y[..., 1], 200) * near(x[..., 2], y[..., 2], 200)
        both = both * np.sign(colour) * np.abs(colour) ** 0.03
    weight = np.maximum(px, py)
    return (both * weight).sum(axis=(1, 2)) / np.maximum(weight.sum(axis=(1, 2)), 1e-12)
