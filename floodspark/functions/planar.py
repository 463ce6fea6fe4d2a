"""Planar geometry on nested arrays.

A geometry is ``parts`` -> rings -> points -> [x, y], the coordinates of a multi-polygon; a plain
polygon has one part. The first ring of a part is its shell, the others are holes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS_TYPE = "array<array<array<array<double>>>>"


def edges_of(parts: Column) -> Column:
    """All ring edges as one array of structs (x1, y1, x2, y2)."""
    rings = F.flatten(parts)
    return F.flatten(
        F.transform(
            rings,
            lambda ring: F.zip_with(
                F.slice(ring, 1, F.size(ring) - 1),
                F.slice(ring, 2, F.size(ring) - 1),
                lambda a, b: F.struct(
                    a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")
                ),
            ),
        )
    )


def coordinates(parts: Column) -> Column:
    """All points of a geometry as one array of [x, y]."""
    return F.flatten(F.flatten(parts))


def extent_of(parts: Column) -> dict[str, Column]:
    """Bounding box columns by name."""
    points = coordinates(parts)
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return {
        "xmin": F.array_min(xs), "ymin": F.array_min(ys),
        "xmax": F.array_max(xs), "ymax": F.array_max(ys),
    }


def strictly_inside(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd test over all rings (so holes and separate parts work); the boundary is outside."""
    # Only edges whose latitude band holds the point can cross its ray or touch it.
    near = F.filter(edges, lambda e: (F.least(e.y1, e.y2) <= y) & (y <= F.greatest(e.y1, e.y2)))

    def side(e):
        return (e.x2 - e.x1) * (y - e.y1) - (e.y2 - e.y1) * (x - e.x1)

    def inside(band):
        touches = F.exists(
            band, lambda e: (side(e) == 0) & (F.least(e.x1, e.x2) <= x) & (x <= F.greatest(e.x1, e.x2))
        )
        crossings = F.filter(band, lambda e: ((e.y1 > y) != (e.y2 > y)) & ((side(e) > 0) == (e.y2 > e.y1)))
        return (F.size(crossings) % 2 == 1) & ~touches

    return _bound_to(near, inside)


def _bound_to(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _clip(ring: Column, bound: float, keep_below: bool) -> Column:
    """A convex closed ring cut by the line x = bound; the result is closed, or empty."""
    def inside(p):
        return p[0] <= bound if keep_below else p[0] >= bound

    def cut(a, b):
        return F.array(
            F.lit(float(bound)), a[1] + (F.lit(float(bound)) - a[0]) * (b[1] - a[1]) / (b[0] - a[0])
        )

    empty = F.array().cast("array<array<double>>")
    points = F.flatten(
        F.zip_with(
            F.slice(ring, 1, F.size(ring) - 1),
            F.slice(ring, 2, F.size(ring) - 1),
            lambda a, b: F.concat(
                F.when(inside(a), F.array(a)).otherwise(empty),
                F.when(inside(a) != inside(b), F.array(cut(a, b))).otherwise(empty),
            ),
        )
    )
    # Fewer than three different points means the ring only touches the line.
    return _bound_to(
        F.array_distinct(points),
        lambda d: F.when(F.size(d) >= 3, F.concat(d, F.slice(d, 1, 1))).otherwise(empty),
    )


def split_at_antimeridian(ring: Column) -> Column:
    """Parts of a convex cell ring; one that spans the 180th meridian comes back as two parts."""
    def eastward(r):
        """The ring with longitudes that run on beyond 180 instead of jumping."""
        xs = F.transform(r, lambda p: p[0])
        low, wide = F.array_min(xs), F.array_max(xs) - F.array_min(xs) > 180
        return _bound_to(
            F.struct(low.alias("low"), wide.alias("wide")),
            lambda s: F.transform(
                r,
                lambda p: F.array(
                    F.when((s["wide"] & (p[0] < 0)) | (s["low"] < -180), p[0] + 360).otherwise(p[0]), p[1]
                ),
            ),
        )

    def parts(r):
        back = F.transform(_clip(r, 180.0, keep_below=False), lambda p: F.array(p[0] - 360, p[1]))
        both = F.filter(F.array(_clip(r, 180.0, keep_below=True), back), lambda part: F.size(part) > 0)
        crosses = F.exists(r, lambda p: p[0] > 180)
        return F.when(crosses, F.transform(both, lambda part: F.array(part))).otherwise(F.array(F.array(r)))

    return _bound_to(_bound_to(ring, eastward), parts)
