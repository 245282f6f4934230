"""Numpy kernels over whole tiles, for Arrow batches: what the column forms do row by row, for grids of any size.

A tile never leaves its row, so these run in the one Python step that packs the bytes anyway. The column forms
(``rtin``, ``quantize``, ``normals``, ``streams``) define the results; tests hold both against each other.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from ..functions import geo

STEPS = 32767


class Triangles:
    """The triangle tree of a grid of ``cells`` by ``cells``, level by level; triangle i of a level splits into 2i and 2i+1 of the next."""

    def __init__(self, cells: int):
        if cells < 1 or cells & (cells - 1):
            raise ValueError("the grid size must be a power of two plus one")
        self.cells, self.side = cells, cells + 1
        levels = 2 * (cells.bit_length() - 1) + 1
        a, b, c = np.array([[0, 0], [cells, cells]]), np.array([[cells, cells], [0, 0]]), np.array([[cells, 0], [0, cells]])
        self.levels: list[tuple] = []
        for level in range(1, levels + 1):
            mid = (a + b) // 2
            post = lambda p: p[:, 1] * self.side + p[:, 0]
            # a midpoint is shared by two triangles at most; those of each half share none
            _, first, = np.unique(post(mid), return_index=True)
            second = np.setdiff1d(np.arange(len(mid)), first)
            self.levels.append((post(a), post(b), post(c), post(mid) if level < levels else None, first, second))
            pairs = lambda x, y: np.stack((x, y), 1).reshape(-1, 2)
            a, b, c = pairs(c, b), pairs(a, c), pairs(mid, mid)

    def errors(self, heights: np.ndarray) -> np.ndarray:
        """For rows of heights, the error at which each post is needed; NaN counts as none."""
        out = np.zeros(heights.shape)
        under = None
        for a, b, _, mid, first, second in reversed(self.levels[:-1]):
            own = np.abs((heights[:, a] + heights[:, b]) / 2 - heights[:, mid])
            own[np.isnan(own)] = 0.0
            if under is not None:
                own = np.maximum(own, np.maximum(out[:, under[::2]], out[:, under[1::2]]))
            for half in (first, second):
                out[:, mid[half]] = np.maximum(out[:, mid[half]], own[:, half])
            under = mid
        return out

    def mesh(self, errors: np.ndarray, max_error: float) -> tuple[np.ndarray, np.ndarray]:
        """Of one row of errors: grid posts of the vertices in order of first use, and three vertex numbers for each triangle."""
        at, found = np.arange(2), []
        for depth, (a, b, c, mid, _, _) in enumerate(self.levels):
            split = errors[mid[at]] > max_error if mid is not None else np.zeros(len(at), bool)
            kept = at[~split]
            found.append((kept << (len(self.levels) - depth), np.stack((a[kept], b[kept], c[kept]), 1)))
            at = np.stack((2 * at[split], 2 * at[split] + 1), 1).ravel()
        corners = np.concatenate([f[1] for f in found])[np.argsort(np.concatenate([f[0] for f in found]))].ravel()
        posts, first, back = np.unique(corners, return_index=True, return_inverse=True)
        order = np.argsort(first)
        number = np.empty(len(posts), np.int64)
        number[order] = np.arange(len(posts))
        return posts[order], number[back]


@lru_cache(maxsize=4)
def triangles(cells: int) -> Triangles:
    return Triangles(cells)


def bulge(cells: int, b: tuple[float, float, float, float]) -> np.ndarray:
    """Height of the sphere over the flat cell at each post."""
    west, south, east, north = b
    t = np.arange(cells + 1) / cells
    dlat, dlon = math.radians(north - south), math.radians(east - west) * math.cos(math.radians((south + north) / 2))
    return (geo.MEAN_RADIUS / 2 * (dlat * dlat * (t * (1 - t))[:, None] + dlon * dlon * (t * (1 - t))[None, :])).ravel()


def ecef(lon, lat, h) -> np.ndarray:
    """x, y, z of points, one a row."""
    lam, phi = np.radians(lon), np.radians(lat)
    n = geo.WGS84_A / np.sqrt(1 - geo.WGS84_E2 * np.sin(phi) ** 2)
    return np.stack(np.broadcast_arrays((n + h) * np.cos(phi) * np.cos(lam), (n + h) * np.cos(phi) * np.sin(lam), (n * (1 - geo.WGS84_E2) + h) * np.sin(phi)), -1)


def steps(x: np.ndarray) -> np.ndarray:
    """Shares from 0 to 1 as 0..32767; NaN as 0."""
    return np.clip(np.floor(np.nan_to_num(x, nan=0.0) * STEPS + 0.5), 0, STEPS).astype(np.int64)


def edges(u: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    """Vertex numbers sorted along each edge."""
    def side(on, along):
        i = np.flatnonzero(on)
        return i[np.lexsort((i, along[i]))]

    return {"west": side(u == 0, v), "south": side(v == 0, u), "east": side(u == STEPS, v), "north": side(v == STEPS, u)}


def header(b: tuple[float, float, float, float], lo: float, hi: float, points: np.ndarray) -> dict:
    """The tile header over its bounds, height range and ECEF vertices."""
    west, south, east, north = b
    lon, lat, half = (west + east) / 2, (south + north) / 2, (lo + hi) / 2
    centre = ecef(lon, lat, half)
    corners = [(x, y, h) for x in (west, east) for y in (south, north) for h in (lo, hi)]
    sphere = ecef(*np.array(corners + [(west, lat, hi), (east, lat, hi), (lon, south, hi), (lon, north, hi)]).T)
    if not len(points):
        points = ecef(*np.array(corners + [(west, lat, half), (east, lat, half), (lon, south, half), (lon, north, half), (lon, lat, hi)]).T)
    radii = np.array([geo.WGS84_A, geo.WGS84_A, geo.WGS84_B])
    d = centre / radii
    size = np.linalg.norm(d)
    d = d / size if size >= 1e-10 else np.array([0.0, 0.0, 1.0])
    s = points / radii
    m = np.maximum(np.linalg.norm(s, axis=1), 1.0)
    q = s @ d / m / m - np.linalg.norm(np.cross(s, d), axis=1) / m * np.sqrt(np.maximum(m * m - 1, 0.0)) / m
    most = (1 / q[q > 0]).max(initial=0.0)  # a vertex without a height has no part in it
    horizon = d * (most if 0 < most < math.inf else 1.0)
    vec = lambda p: dict(zip("xyz", map(float, p), strict=True))
    return {"center": vec(centre), "min_height": lo, "max_height": hi, "sphere_center": vec(centre), "sphere_radius": float(np.linalg.norm(sphere - centre, axis=1).max()), "horizon_point": vec(horizon)}


def blend(a, b, t):
    """Linear blend; a NaN end gives way to the other."""
    return np.where(np.isnan(a), b, np.where(np.isnan(b), a, a + (b - a) * t))


def _unit(v: np.ndarray, least: float) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.where(size > least, v / np.where(size > least, size, 1.0), np.array([0.0, 0.0, 1.0]))


def gradient_normals(u: np.ndarray, v: np.ndarray, b: tuple[float, float, float, float], halo: np.ndarray, cells: int, buffer: int) -> np.ndarray:
    """Unit normals at places of a tile from the slopes of a grid with ``buffer`` more posts on each side."""
    side = cells + 1 + 2 * buffer
    if len(halo) != side * side:
        raise ValueError(f"a halo needs {side * side} heights, not {len(halo)}")
    grid, (west, south, east, north) = halo.reshape(side, side), b

    def height(x, y):
        x, y = np.clip(x, 0.0, side - 1.0), np.clip(y, 0.0, side - 1.0)
        x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
        x1, y1 = np.minimum(x0 + 1, side - 1), np.minimum(y0 + 1, side - 1)
        h = blend(blend(grid[y0, x0], grid[y0, x1], x - x0), blend(grid[y1, x0], grid[y1, x1], x - x0), y - y0)
        return np.where(np.isnan(h), 0.0, h)

    per_lat = math.radians(geo.WGS84_A)
    per_lon = per_lat * math.cos(math.radians((south + north) / 2))
    fx, fy = buffer + u * cells, buffer + (1 - v) * cells
    dx = (height(fx + 0.5, fy) - height(fx - 0.5, fy)) / ((east - west) / cells * per_lon)
    dy = (height(fx, fy - 0.5) - height(fx, fy + 0.5)) / ((north - south) / cells * per_lat)
    lam, phi = np.radians(west + u * (east - west)), np.radians(south + v * (north - south))
    x = dx * np.sin(lam) + dy * np.sin(phi) * np.cos(lam) + np.cos(phi) * np.cos(lam)
    y = -dx * np.cos(lam) + dy * np.sin(phi) * np.sin(lam) + np.cos(phi) * np.sin(lam)
    return _unit(np.stack((x, y, -dy * np.cos(phi) + np.sin(phi)), 1), 1e-10)


def face_normals(points: np.ndarray, indices: np.ndarray) -> np.ndarray:
    """Unit normals of vertices: cross products of the triangles around each, summed; larger ones weigh more."""
    t = indices.reshape(-1, 3)
    cross = np.cross(points[t[:, 1]] - points[t[:, 0]], points[t[:, 2]] - points[t[:, 0]]).astype(np.float32).astype(float)
    total = np.stack([np.bincount(t.ravel(), np.repeat(cross[:, k], 3), len(points)) for k in range(3)], 1)
    return _unit(total, 1e-6)


def oct_bytes(normals: np.ndarray) -> bytes:
    """Two bytes for each unit vector: the octahedron, with its lower half folded out, in single precision."""
    one, half, top = np.float32(1), np.float32(0.5), np.float32(255)
    n = normals.astype(np.float32)
    total = np.abs(n).sum(1, dtype=np.float32)
    p = n[:, :2] / np.where(total == 0, one, total)[:, None]
    folded = (one - np.abs(p[:, ::-1])) * np.where(p >= 0, one, -one)
    p = np.where(n[:, 2:] < 0, folded, p)
    return np.clip((p * half + half) * top, 0, top).astype(np.uint8).tobytes()


def oct_vectors(content: bytes) -> np.ndarray:
    """The unit vectors of such bytes; an odd last byte is ignored."""
    p = np.frombuffer(content, np.uint8, len(content) // 2 * 2).reshape(-1, 2) / 255 * 2 - 1
    z = 1 - np.abs(p).sum(1)
    folded = (1 - np.abs(p[:, ::-1])) * np.where(p >= 0, 1.0, -1.0)
    return _unit(np.column_stack((np.where(z[:, None] < 0, folded, p), z)), 0.0)


def tile(heights: np.ndarray, errors: np.ndarray, b: tuple[float, float, float, float], cells: int, max_error: float, normals: str = "none", halo: np.ndarray | None = None, buffer: int = 1) -> dict:
    """A tile's parts from its heights and their errors: header, u, v, height, indices, edges and, if asked for, bytes of normals."""
    posts, indices = triangles(cells).mesh(errors, max_error)
    u, v, h = posts % (cells + 1) / cells, 1 - posts // (cells + 1) / cells, heights[posts]
    known = h[~np.isnan(h)]
    lo, hi = (float(known.min()), float(known.max())) if len(known) else (0.0, 0.0)
    q = {"u": steps(u), "v": steps(v), "height": steps((h - lo) / (hi - lo)) if hi > lo else np.zeros(len(h), np.int64)}
    west, south, east, north = b
    made = {"header": header(b, lo, hi, ecef(west + u * (east - west), south + v * (north - south), h)), **q, "indices": indices, "edges": edges(q["u"], q["v"])}
    if normals == "gradient":
        made["normals"] = oct_bytes(gradient_normals(u, v, b, halo, cells, buffer))
    elif normals == "face":
        share = lambda x: x / STEPS
        made["normals"] = oct_bytes(face_normals(ecef(west + share(q["u"]) * (east - west), south + share(q["v"]) * (north - south), lo + share(q["height"]) * (hi - lo)), indices))
    return made


def axis(position: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pixel positions along one axis of a block: both neighbours, clamped to it and counted from its start, and the way between them."""
    at = np.floor(position)
    clamp = lambda p: np.clip(p, low, high).astype(np.int64) - low
    return clamp(at), clamp(at + 1), position - at


def resampled(block: np.ndarray, x0: int, y0: int, world: int, b: tuple[float, float, float, float], grid_size: int, buffer: int) -> np.ndarray:
    """Heights at the posts of a geodetic grid with ``buffer`` more posts on each side, from a stitched mercator block that begins at pixel (x0, y0).

    Each row's and each column's place is computed once: the axes are separable.
    """
    west, south, east, north = b
    at = np.arange(-buffer, grid_size + buffer)
    lon = west + at * ((east - west) / (grid_size - 1))
    lat = np.clip(north - at * ((north - south) / (grid_size - 1)), -geo.MERCATOR_LAT, geo.MERCATOR_LAT)
    left, right, tx = axis((lon + 180) / 360 * world - 0.5, x0, x0 + block.shape[1] - 1)
    up, down, ty = axis((1 - np.arcsinh(np.tan(np.radians(lat))) / math.pi) / 2 * world - 0.5, y0, y0 + block.shape[0] - 1)
    row = lambda j: blend(block[np.ix_(j, left)], block[np.ix_(j, right)], tx[None, :])
    return blend(row(up), row(down), ty[:, None])
