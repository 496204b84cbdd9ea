"""Feature similarity against its published formulas, written with sums over pixels and frequencies."""

import cmath
import math

import numpy as np

from tessera.functions import kernels


def transformed(plane, sign):
    h, w = len(plane), len(plane[0])
    rows = [[sum(plane[y][x] * cmath.exp(sign * 2j * math.pi * x * u / w) for x in range(w)) for u in range(w)] for y in range(h)]
    out = [[sum(rows[y][u] * cmath.exp(sign * 2j * math.pi * y * v / h) for y in range(h)) for u in range(w)] for v in range(h)]
    return out if sign < 0 else [[z / (h * w) for z in row] for row in out]


def frequency(k, n):
    return (k if k < (n + 1) // 2 else k - n) / n


def plain_congruency(plane):
    """Energy of log-Gabor responses of four scales and orientations, less the noise, over their amplitudes."""
    h, w = len(plane), len(plane[0])
    image = transformed(plane, -1)
    energy, total = np.zeros((h, w)), np.zeros((h, w))
    for o in range(4):
        found = []
        for s in range(4):
            filtered = [[0j] * w for _ in range(h)]
            for v in range(h):
                for u in range(w):
                    fy, fx = frequency(v, h), frequency(u, w)
                    radius = math.hypot(fx, fy)
                    if radius == 0:
                        continue
                    apart = (math.atan2(-fy, fx) - o * math.pi / 4 + math.pi) % (2 * math.pi) - math.pi
                    radial = math.exp(-(math.log(radius * 6 * 2**s) ** 2) / (2 * math.log(0.55) ** 2)) / (1 + (radius / 0.45) ** 30)
                    filtered[v][u] = image[v][u] * radial * math.exp(-(apart**2) / (2 * (math.pi / 4 / 1.2) ** 2))
            found.append(np.array(transformed(filtered, 1)))
        power = np.median(np.abs(found[0]) ** 2) / math.log(2)
        tau = math.sqrt(power) * (1 + 1 / 2 + 1 / 4 + 1 / 8)
        limit = tau * (math.sqrt(math.pi / 2) + 2 * math.sqrt(2 - math.pi / 2)) / 1.7
        for y in range(h):
            for x in range(w):
                z = [f[y, x] for f in found]
                mean = sum(z) / (abs(sum(z)) + 1e-8)
                own = sum((a.real * mean.real + a.imag * mean.imag) - abs(a.real * mean.imag - a.imag * mean.real) for a in z)
                energy[y, x] += max(own - limit, 0)
                total[y, x] += sum(map(abs, z))
    return energy / (total + 1e-8)


def plain_gradient(plane):
    h, w = plane.shape
    at = lambda y, x: plane[y, x] if 0 <= y < h and 0 <= x < w else 0.0
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            across = sum(k * (at(y + d, x - 1) - at(y + d, x + 1)) for d, k in ((-1, 3), (0, 10), (1, 3))) / 16
            down = sum(k * (at(y - 1, x + d) - at(y + 1, x + d)) for d, k in ((-1, 3), (0, 10), (1, 3))) / 16
            out[y, x] = math.hypot(across, down)
    return out


def plain_fsim(a, b, chromatic):
    a, b = a * 255, b * 255
    yiq = [[0.299, 0.587, 0.114], [0.5959, -0.2746, -0.3213], [0.2115, -0.5227, 0.3112]]
    planes = [[sum(k * v[..., c] for c, k in enumerate(row)) for row in yiq] if v.shape[-1] == 3 else [v[..., 0]] * 3 for v in (a, b)]
    near = lambda x, y, t: (2 * x * y + t) / (x * x + y * y + t)
    pa, pb = (plain_congruency(p[0].tolist()) for p in planes)
    ga, gb = (plain_gradient(p[0]) for p in planes)
    both = near(pa, pb, 0.85) * near(ga, gb, 160)
    if chromatic:
        colour = near(planes[0][1], planes[1][1], 200) * near(planes[0][2], planes[1][2], 200)
        both = both * np.sign(colour) * np.abs(colour) ** 0.03
    weight = np.maximum(pa, pb)
    return (both * weight).sum() / weight.sum()


def test_feature_similarity():
    r = np.random.default_rng(0)
    for shape, chromatic in (((9, 12, 1), False), ((10, 7, 3), False), ((9, 12, 3), True)):
        a = r.random(shape)
        b = np.clip(a + 0.3 * (r.random(shape) - 0.5), 0, 1)
        assert abs(kernels.fsim(a[None], b[None], chromatic=chromatic)[0] - plain_fsim(a, b, chromatic)) < 1e-6
