"""Voronoi facets and coordination by them: numpy kernels, one structure at a time.

A site's cell starts as a large cube and is cut by the bisector plane of each neighbour, nearest first; a neighbour
farther than twice the farthest vertex can't cut any more. What is left of each plane is a facet.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np

from . import batch

#: Covalent radii in Angstrom (public tables), where a radius is needed and no oxidation state is known.
COVALENT = {
    "H": 0.31, "Li": 1.28, "Be": 0.96, "B": 0.84, "C": 0.76, "N": 0.71, "O": 0.66, "F": 0.57, "Na": 1.66, "Mg": 1.41, "Al": 1.21, "Si": 1.11, "P": 1.07, "S": 1.05,
    "Cl": 1.02, "K": 2.03, "Ca": 1.76, "Sc": 1.70, "Ti": 1.60, "V": 1.53, "Cr": 1.39, "Mn": 1.39, "Fe": 1.32, "Co": 1.26, "Ni": 1.24, "Cu": 1.32, "Zn": 1.22,
    "Ga": 1.22, "Ge": 1.20, "As": 1.19, "Se": 1.20, "Br": 1.20, "Rb": 2.20, "Sr": 1.95, "Y": 1.90, "Zr": 1.75, "Nb": 1.64, "Mo": 1.54, "Ru": 1.46, "Rh": 1.42,
    "Pd": 1.39, "Ag": 1.45, "Cd": 1.44, "In": 1.42, "Sn": 1.39, "Sb": 1.39, "Te": 1.38, "I": 1.39, "Cs": 2.44, "Ba": 2.15, "La": 2.07, "Pt": 1.36, "Au": 1.36,
    "Hg": 1.32, "Tl": 1.45, "Pb": 1.46, "Bi": 1.48,
}


def images_within(lattice: np.ndarray, coords: np.ndarray, centre: np.ndarray, r: float) -> list[tuple[int, tuple[int, int, int], float, np.ndarray]]:
    """(site, image, dist, vector) of all other atoms within r of a point, nearest first."""
    inverse = np.linalg.inv(lattice)
    reach = np.sqrt((inverse**2).sum(0)) * r
    gap = centre @ inverse - coords @ inverse
    low, high = np.ceil(gap.min(0) - reach - 1e-8).astype(int), np.floor(gap.max(0) + reach + 1e-8).astype(int)
    grid = np.stack(np.meshgrid(*[np.arange(a, b + 1) for a, b in zip(low, high)], indexing="ij"), -1).reshape(-1, 3)
    v = (coords - centre)[None, :, :] + (grid @ lattice)[:, None, :]
    d = np.sqrt((v**2).sum(2))
    g, j = np.nonzero((d >= 1e-8) & (d < r))
    order = np.lexsort((grid[g, 2], grid[g, 1], grid[g, 0], j, d[g, j]))
    return [(int(j[k]), tuple(map(int, grid[g[k]])), float(d[g[k], j[k]]), v[g[k], j[k]]) for k in order]


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cross products, without the overhead of the general function."""
    return a[..., [1, 2, 0]] * b[..., [2, 0, 1]] - a[..., [2, 0, 1]] * b[..., [1, 2, 0]]


def _clip(polygons: dict, normal: np.ndarray, at: float, name) -> None:
    """Cut a convex polyhedron (faces as vertex loops) by normal . x <= at; the cut becomes face `name`."""
    rim = []
    for key in list(polygons):
        loop = polygons[key]
        side = (loop @ normal - at).tolist()
        if max(side) <= 1e-10:
            continue
        if min(side) > 1e-10:
            del polygons[key]
            continue
        kept, last = [], len(side) - 1
        for i, sa in enumerate(side):
            k = 0 if i == last else i + 1
            sb = side[k]
            if sa <= 1e-10:
                kept.append(loop[i])
            if (sa <= 1e-10) != (sb <= 1e-10):
                p = loop[i] + (loop[k] - loop[i]) * (sa / (sa - sb))
                kept.append(p)
                rim.append(p)
        if len(kept) >= 3:
            polygons[key] = np.array(kept)
        else:
            del polygons[key]
    if len(rim) >= 3:
        points = np.array(rim)
        middle = points.mean(0)
        first = points[0] - middle
        second = _cross(normal, first)
        angle = np.arctan2((points - middle) @ second, (points - middle) @ first)
        points = points[np.argsort(angle)]
        new = np.abs(points - np.roll(points, 1, axis=0)).max(1) > 1e-9
        if new.sum() >= 3:
            polygons[name] = points[new]


def solid_angle(loop: np.ndarray) -> float:
    """Of a polygon seen from the origin."""
    unit = loop / np.sqrt((loop**2).sum(1))[:, None]
    a, b, c = unit[0], unit[1:-1], unit[2:]
    return float(2 * np.arctan2(np.abs(_cross(b, c) @ a), 1 + b @ a + (b * c).sum(1) + c @ a).sum())


def facets(lattice: list, coords: list, site: int, cutoff: float = 13.0, adjacent: bool = False) -> list[dict]:
    """The facets of a site's cell: neighbour, image, distance, solid_angle, area, volume, face_dist, n_verts, normal.

    With adjacent, also the places of the facets that share an edge (exactly two vertices) with it.
    """
    lattice, coords = np.array(lattice, float), np.array(coords, float)
    corner = max(float(np.linalg.norm(np.array(s) @ lattice)) for s in product((-1, 1), repeat=3)) + 0.01
    r = min(cutoff, corner, 2 * (abs(float(np.linalg.det(lattice))) / len(coords)) ** (1 / 3))
    size = 4 * max(cutoff, corner)
    cube: dict = {}
    for axis, sign in product(range(3), (-1, 1)):
        loop = np.array([[-1, -1], [1, -1], [1, 1], [-1, 1]], float) * size
        cube[f"wall{axis}{sign}"] = np.insert(loop, axis, sign * size, axis=1)
    corners, far, done = np.concatenate(list(cube.values())), 2 * size, 0
    while True:
        near = images_within(lattice, coords, coords[site], r)  # sorted: a wider search only appends
        for k in range(done, len(near)):
            d, v = near[k][2:]
            if d > 2 * far + 1e-9:
                break
            if (corners @ (v / d)).max() > d / 2 + 1e-10:
                _clip(cube, v / d, d / 2, k)
                corners = np.concatenate(list(cube.values()))
                far = float(np.sqrt((corners**2).sum(1).max()))
        done = len(near)
        if 2 * far <= r + 1e-6 or r > 4 * corner:
            break
        r = min(1.5 * r, 2 * far + 1e-6)
    out = []
    for k, loop in cube.items():
        if isinstance(k, str):
            continue
        j, image, d, v = near[k]
        spokes = loop[1:] - loop[0]
        area = float(np.sqrt((_cross(spokes[:-1], spokes[1:]).sum(0) ** 2).sum())) / 2
        if area < 1e-9:
            continue
        out.append({"v": j, "image": image, "dist": d, "solid_angle": solid_angle(loop), "area": area, "face_dist": d / 2, "volume": area * d / 6, "n_verts": len(loop), "normal": tuple(v / d), "loop": loop})
    if adjacent:
        corners = [{tuple(p) for p in np.round(a["loop"], 6)} for a in out]
        for a, mine in zip(out, corners):
            a["adjacent"] = [i for i, other in enumerate(corners) if other is not mine and len(mine & other) == 2]
    return out


#: Nearest planes that make the first shape of a cell, those that then cut it at a time; sites whose cells are worked on at once.
FIRST, NEXT, CELLS = 12, 8, 16


def _edges(normal: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(k, i, is an edge, one end, other end) of every two planes of cells (cells, planes, 3): the part of their line that
    lies below all planes. A normal of 0 is no plane."""
    m = normal.shape[1]
    k, i = np.triu_indices(m, 1)
    gram = normal @ normal.transpose(0, 2, 1)
    g = gram[:, k, i]
    along = _cross(normal[:, k], normal[:, i])
    size = np.sqrt((along**2).sum(2))
    there = size > 1e-7
    size = np.where(there, size, 1.0)
    along /= size[:, :, None]
    a, b = ((at[:, x] - g * at[:, y]) / size**2 for x, y in ((k, i), (i, k)))
    base = a[:, :, None] * normal[:, k] + b[:, :, None] * normal[:, i]
    # planes before lines, so that the smallest room is taken over whole rows
    slope, room = normal @ along.transpose(0, 2, 1), normal @ base.transpose(0, 2, 1)
    np.subtract(at[:, :, None], room, out=room)
    up, down = slope > 1e-9, slope < -1e-9
    there &= ~((room < -1e-9) & ~(up | down)).any(1)
    np.divide(room, slope, out=room, where=up | down)
    high, low = np.where(up, room, np.inf).min(1), np.where(down, room, -np.inf).max(1)
    there &= high - low > 1e-9
    with np.errstate(invalid="ignore"):
        return k, i, there, base + low[:, :, None] * along, base + high[:, :, None] * along


def _faces(normal: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(area, solid angle, farthest corner): by plane, by plane, by cell. Planes that only touch a cell have no area."""
    cells, m = at.shape
    normal = normal.copy()
    todo = np.arange(cells)
    area, angle, far = np.zeros((cells, m)), np.zeros((cells, m)), np.zeros(cells)
    while len(todo):
        n, h = normal[todo], at[todo]
        k, i, there, p, q = _edges(n, h)
        c, e = np.nonzero(there)
        p, q = p[c, e], q[c, e]
        width = len(todo) * m
        face = np.concatenate([c * m + k[e], c * m + i[e]])
        p, q = np.concatenate([p, p]), np.concatenate([q, q])
        count = np.bincount(face, minlength=width)
        middle = np.stack([np.bincount(face, p[:, x] + q[:, x], width) for x in range(3)], 1) / np.maximum(2 * count, 1)[:, None]
        o = middle[face]
        part = np.sqrt((_cross(p - o, q - o) ** 2).sum(1)) / 2
        own = np.bincount(face, part, width).reshape(-1, m)
        lp, lq, lo = (np.sqrt((x**2).sum(1)) for x in (p, q, o))
        triple = np.abs((_cross(p, q) * o).sum(1))
        below = lp * lq * lo + (p * q).sum(1) * lo + (p * o).sum(1) * lq + (q * o).sum(1) * lp
        area[todo] = own
        angle[todo] = np.bincount(face, 2 * np.arctan2(triple, below), width).reshape(-1, m)
        reach = np.zeros(len(todo))
        np.maximum.at(reach, face // m, np.maximum(lp, lq))
        far[todo] = reach
        touching = (count.reshape(-1, m) > 0) & (own < 1e-9)  # their line counts twice in the faces they touch
        again = touching.any(1)
        normal[todo[again]] *= ~touching[again][:, :, None]
        todo = todo[again]
    return area, angle, far


def cells(chunk: batch.Chunk, cutoff: float = 13.0) -> Iterator[dict[str, np.ndarray]]:
    """The facets of all cells of a chunk, as in `facets`: u, v, ia, ib, ic, dist, solid_angle, area, volume by site and distance.

    A cell is first made by its nearest neighbours' planes; those of all others in reach that cut it are then added,
    and the reach grows until it is twice the farthest corner.
    """
    chunk.pbc = np.ones_like(chunk.pbc)
    corners = np.array(list(product((-1, 1), repeat=3)), float)
    corner = np.sqrt(((corners @ chunk.lattice) ** 2).sum(2)).max(1) + 0.01
    spacing = (np.abs(np.linalg.det(chunk.lattice)) / chunk.n) ** (1 / 3)
    wall = 4 * np.maximum(cutoff, corner)
    reach = np.minimum(2.4 * spacing, corner)[chunk.of]
    todo = np.arange(len(chunk.site))
    while len(todo):
        undone = []
        for centers, (u, v, ia, ib, ic, dist) in chunk.cut_blocks(reach[todo], centers=todo):
            order = np.lexsort((dist, u))
            u, v, ia, ib, ic, dist = (x[order] for x in (u, v, ia, ib, ic, dist))
            s = chunk.of[u]
            way = np.stack([chunk.xyz[c][v] - chunk.xyz[c][u] + (ia * chunk.lattice[s, 0, c] + ib * chunk.lattice[s, 1, c] + ic * chunk.lattice[s, 2, c]) for c in range(3)], 1) / dist[:, None]
            first = np.searchsorted(u, centers)
            count = np.searchsorted(u, centers, side="right") - first
            by_size = np.argsort(count, kind="stable")
            for lo in range(0, len(centers), CELLS):
                mine = np.sort(by_size[lo : lo + CELLS])
                found, far = _cells(first[mine], count[mine], way, dist, wall[chunk.of[centers[mine]]])
                at = centers[mine]
                done = (2 * far <= reach[at] + 1e-6) | (reach[at] > 4 * corner[chunk.of[at]])
                reach[at[~done]] = np.minimum(1.5 * reach[at], 2 * far + 1e-6)[~done]
                undone.append(at[~done])
                cell, k, area, angle = found
                keep = done[cell] & (area >= 1e-9)
                k, area, angle = k[keep], area[keep], angle[keep]
                yield {"u": u[k], "v": v[k], "ia": ia[k], "ib": ib[k], "ic": ic[k], "dist": dist[k], "solid_angle": angle, "area": area, "volume": area * dist[k] / 6, "face_dist": dist[k] / 2}
        todo = np.sort(np.concatenate(undone)) if undone else np.zeros(0, np.int64)


def _cells(first: np.ndarray, count: np.ndarray, way: np.ndarray, dist: np.ndarray, wall: np.ndarray) -> tuple[tuple, np.ndarray]:
    """((cell, place of the neighbour, area, solid angle), farthest corner) of cells whose neighbours follow one another."""
    size = len(count)
    place = first[:, None] + np.arange(int(count.max(initial=0)))
    real = np.arange(place.shape[1]) < count[:, None]
    place = np.where(real, place, 0)
    walls = np.broadcast_to(np.concatenate([np.eye(3), -np.eye(3)]), (size, 6, 3))
    normal, at = walls, np.broadcast_to(wall[:, None], (size, 6))
    if len(way):
        normal, at = np.concatenate([walls, np.where(real[:, :, None], way[place], 0.0)], 1), np.concatenate([at, np.where(real, dist[place] / 2, 1e9)], 1)
    real = np.concatenate([np.ones((size, 6), bool), real], 1)[:, : at.shape[1]]
    active = real & (np.arange(real.shape[1]) < 6 + FIRST)
    tried = active.copy()
    todo = np.arange(size)
    while len(todo):
        pick, n, h, _ = _picked(active[todo], normal[todo], at[todo])
        k, i, there, p, q = _edges(n, h)
        c, e = np.nonzero(there)
        faced = np.zeros(pick.shape, bool)
        faced[c, k[e]] = faced[c, i[e]] = True
        mine = np.zeros((len(todo), real.shape[1]), bool)
        np.put_along_axis(mine, pick, faced, 1)
        ends, of = np.concatenate([p[c, e], q[c, e]]), np.concatenate([c, c])
        order = np.argsort(of, kind="stable")
        many = np.bincount(of, minlength=len(todo))
        corners = np.zeros((len(todo), int(many.max(initial=1)), 3))
        corners[of[order], np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)] = ends[order]
        cuts = ((normal[todo] @ corners.transpose(0, 2, 1)).max(2, initial=0.0) > at[todo] + 1e-10) & real[todo] & ~tried[todo]
        cuts &= np.cumsum(cuts, 1) <= NEXT
        active[todo] = mine | cuts  # a plane without an edge meets no smaller cell either
        tried[todo] |= cuts
        todo = todo[cuts.any(1)]
    pick, n, h, used = _picked(active, normal, at)
    foot = n * np.where(used, h, 0.0)[:, :, None]  # of planes in the same place the first counts
    same = (np.abs(foot[:, :, None, :] - foot[:, None, :, :]).max(3) < 1e-9) & used[:, :, None] & used[:, None, :]
    n = np.where((same & np.tri(n.shape[1], k=-1, dtype=bool)).any(2)[:, :, None], 0.0, n)
    area, angle, far = _faces(n, h)
    cell, k = np.nonzero((area > 0) & used & (pick >= 6))
    return (cell, place[cell, pick[cell, k] - 6], area[cell, k], angle[cell, k]), far


def _picked(active: np.ndarray, normal: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, normal, at, is there) of the active planes of each cell, in their order, side by side."""
    pick = np.argsort(~active, axis=1, kind="stable")[:, : int(active.sum(1).max(initial=1))]
    used = np.take_along_axis(active, pick, 1)
    return pick, np.where(used[:, :, None], np.take_along_axis(normal, pick[:, :, None], 1), 0.0), np.where(used, np.take_along_axis(at, pick, 1), 1e9), used


def voronoi_bonds(lattice: list, coords: list, species: list[str], tol: float = 0.0, targets: list[str] | None = None, cutoff: float = 13.0, weight: str = "solid_angle") -> list[tuple]:
    """(u, v, ia, ib, ic, weight): facets above tol times the largest, weight relative to it."""
    out = []
    for u in range(len(coords)):
        found = [f for f in facets(lattice, coords, u, cutoff) if targets is None or species[f["v"]] in targets]
        most = max((f[weight] for f in found), default=0.0)
        out += [(u, f["v"], *f["image"], f[weight] / most) for f in found if f[weight] > tol * most]
    return out


def _half_circle(x: float) -> float:
    """Area under the unit quarter circle from 0 to x, relative to the whole."""
    x = min(1.0, max(0.0, x))
    return (x * math.sqrt(1 - x * x) + math.asin(x)) * 2 / math.pi


def coordination(facets_of: list[dict], u: int, species: list[str], oxi: list[float | None], x_of: dict[str, float], distance_cutoffs=(0.5, 1.0), x_diff_weight: float = 3.0, porous: bool = True, cation_anion: bool = False, radii: list[float] | None = None, fingerprint_length: int = 0) -> tuple[dict[int, float], list[dict]]:
    """Likelihood of each coordination number of a site, and its neighbours from the heaviest.

    Weights are relative solid angles, raised for porous cells and for differences in electronegativity, and cut by the
    distance beyond the sum of radii. Distinct weights, from the largest, cut the half circle into the likelihoods.

    cation_anion: only facets towards kinds of site (species and state) whose known state is not of the site's own sign.
    radii: of each site, by its state; where one of two is not known (0), covalent radii count for both, with a warning.
    fingerprint_length: likelihoods of 0 for the numbers below it that have none.
    """
    found = [dict(f, weight=f["solid_angle"]) for f in facets_of]
    padded = lambda chance: {cn: 0.0 for cn in range(fingerprint_length)} | chance
    if cation_anion:
        if oxi[u] is None:
            raise ValueError("cation_anion needs the site's oxidation state")
        targets = {(s, o) for s, o in zip(species, oxi) if o is not None and o * oxi[u] <= 0}
        if not targets:
            raise ValueError("no neighbour of opposite charge")
        found = [f for f in found if (species[f["v"]], oxi[f["v"]]) in targets]
    if not found:
        return padded({0: 1.0}), []
    most = max(f["weight"] for f in found)
    for f in found:
        f["weight"] /= most
        if porous:
            f["weight"] *= f["solid_angle"] / f["area"]
        if x_diff_weight > 0:
            a, b = x_of.get(species[u]), x_of.get(species[f["v"]])
            f["weight"] *= 1 + x_diff_weight * math.sqrt(abs(a - b) / 3.3) if a is not None and b is not None else 1
    most = max(f["weight"] for f in found)
    for f in found:
        f["weight"] /= most
        if distance_cutoffs and all(distance_cutoffs):
            own, other = (radii[u], radii[f["v"]]) if radii else (0.0, 0.0)
            if own <= 0 or other <= 0:
                if radii:
                    warnings.warn(f"no radius for the states of {species[u]} and {species[f['v']]}; covalent radii are used", stacklevel=2)
                own, other = (COVALENT.get(species[i], 1.5) for i in (u, f["v"]))
            low, high = (own + other + c for c in distance_cutoffs)
            part = 1.0 if f["dist"] <= low else 0.0 if f["dist"] >= high else (math.cos((f["dist"] - low) / (high - low) * math.pi) + 1) / 2
            f["weight"] *= part
        f["weight"] = round(f["weight"], 3)
    found = sorted((f for f in found if f["weight"] > 0), key=lambda f: (-f["weight"], f["dist"], f["v"], f["image"]))
    if not found:
        return padded({0: 1.0}), []
    steps = sorted({f["weight"] for f in found}, reverse=True)
    chance = {}
    for w, after in zip(steps, [*steps[1:], 0.0]):
        cn = sum(f["weight"] >= w for f in found)
        chance[cn] = _half_circle(w) - _half_circle(after)
    rest = 1 - sum(chance.values())
    if rest > 1e-9:
        chance[0] = rest
    return padded(chance), found


def crystal_bonds(lattice: list, coords: list, species: list[str], oxi: list[float | None], x_of: dict[str, float], weighted_cn: bool = False, search_cutoff: float = 7.0, radius_of: Callable[[str, float | None], float] | None = None, **options) -> list[tuple]:
    """(u, v, ia, ib, ic, weight) of the most likely coordination number (ties: the largest), each of weight 1; or with
    weighted_cn every neighbour with the likelihood that it is one."""
    out = []
    if radius_of:
        options["radii"] = [radius_of(s, o) for s, o in zip(species, oxi)]
    for u in range(len(coords)):
        out += likely_bonds(facets(lattice, coords, u, search_cutoff), u, species, oxi, x_of, weighted_cn, **options)
    return out


def likely_bonds(facets_of: list[dict], u: int, species: list[str], oxi: list[float | None], x_of: dict[str, float], weighted_cn: bool = False, **options) -> list[tuple]:
    """The bonds of one site by its facets, as in crystal_bonds."""
    chance, found = coordination(facets_of, u, species, oxi, x_of, **options)
    if not weighted_cn:
        best = max(chance, key=lambda cn: (chance[cn], cn))
        return [(u, f["v"], *f["image"], 1.0) for f in found[:best]]
    shares = [sum(p for cn, p in chance.items() if cn > i) for i in range(len(found))]
    return [(u, f["v"], *f["image"], w) for f, w in zip(found, shares) if w > 0]
