"""Small analytic meshes for the tests."""

from itertools import permutations

import numpy as np

STATE = ["ux", "uy", "uz", "p", "phi", "temp", "dux", "duy", "duz", "dp", "dphi", "dtemp"]


def tables(spark, points, tets):
    nodes = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "node_id long, x double, y double, z double")
    elements = spark.createDataFrame([(i, "tet", [int(v) for v in t]) for i, t in enumerate(tets)], "elem_id long, etype string, nodes array<long>")
    return nodes, elements


def unit_tet():
    return [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [(0, 1, 2, 3)]


def box(n):
    """n^3 cells of six tetrahedra along the main diagonal, one for each order of the axes."""
    at = lambda i, j, k: i + (n + 1) * (j + (n + 1) * k)
    points = [(i, j, k) for k in range(n + 1) for j in range(n + 1) for i in range(n + 1)]
    tets = []
    for k in range(n):
        for j in range(n):
            for i in range(n):
                for order in permutations(range(3)):
                    p, path = [i, j, k], [at(i, j, k)]
                    for axis in order:
                        p[axis] += 1
                        path.append(at(*p))
                    tets.append(tuple(path))
    return points, tets


def box_facets(n):
    """(facet_id, tag, node_id) of the boundary triangles; tags 1 to 6 for the sides x, y, z = 0 and n."""
    points, tets = box(n)
    seen, out = {}, []
    for t in tets:
        for off in range(4):
            f = tuple(sorted(t[:off] + t[off + 1 :]))
            seen[f] = seen.get(f, 0) + 1
    for f in sorted(f for f, k in seen.items() if k == 1):
        p = np.array([points[v] for v in f])
        for axis in range(3):
            for side, value in enumerate((0, n)):
                if (p[:, axis] == value).all():
                    out += [(len(out) // 3, 2 * axis + side + 1, v) for v in f]
                    break
    return out
