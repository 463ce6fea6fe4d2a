"""Grid cell schemes as column expressions: S2 cells, equal-area hexagons, web-map tiles.

A scheme offers ``addressed`` (points plus ``cell``, a struct of small integers, NULL off the globe),
``key`` (cell -> id text) and ``outlined`` (cells plus ``parts``, the cell polygon). Ids and outlines
are only computed for the distinct cells that survive a roll-up, never per point. Long formulas are
laid out as a chain of columns, so that each step is computed once and the generated code stays
small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodspark.functions.planar import split_at_antimeridian


def on_globe(lat: Column, lon: Column) -> Column:
    return F.coalesce((F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))


def by_number(number: Column, values: list[Column]) -> Column:
    """The value at a position 0, 1, ...; only that one is computed."""
    whens = F.when(number == 0, values[0])
    for position, value in enumerate(values[1:], 1):
        whens = whens.when(number == position, value)
    return whens


# --- S2 ------------------------------------------------------------------------------------------

# The published Hilbert-curve tables. Row = orientation (bit 0 swaps the axes, bit 1
# inverts them), column = 2 * i-bit + j-bit.
S2_POSITION = ((0, 1, 3, 2), (0, 3, 1, 2), (2, 3, 1, 0), (2, 1, 3, 0))
# Change of orientation per position along the curve.
S2_TURN = (1, 0, 0, 3)

S2_MAX_LEVEL = 30


def _s2_step() -> list[int]:
    """For orientation * 4 + ij: position * 4 + next orientation."""
    return [
        position * 4 + (orientation ^ S2_TURN[position])
        for orientation, row in enumerate(S2_POSITION)
        for position in row
    ]


def _s2_st(u: Column) -> Column:
    """Quadratic projection of a face coordinate to [0, 1]."""
    return F.when(u >= 0, F.sqrt(1 + u * 3) * 0.5).otherwise(1 - F.sqrt(1 - u * 3) * 0.5)


def _s2_uv(s: Column) -> Column:
    return F.when(s >= 0.5, (s * s * 4 - 1) / 3).otherwise((1 - (1 - s) * (1 - s) * 4) / 3)


class S2Cells:
    """S2 hierarchy. A cell is (face, i, j) at its own level."""

    nested = True

    def addressed(self, points: DataFrame, level: int) -> DataFrame:
        lat, lon = F.radians(F.col("lat")), F.radians(F.col("lon"))
        x, y, z = F.col("_x"), F.col("_y"), F.col("_z")
        over = F.try_divide
        on_sphere = points.withColumns({
            "_x": F.cos(lat) * F.cos(lon), "_y": F.cos(lat) * F.sin(lon), "_z": F.sin(lat),
        })
        faced = on_sphere.withColumn(
            "_face",
            F.when((F.abs(x) > F.abs(y)) & (F.abs(x) > F.abs(z)), F.when(x < 0, 3).otherwise(0))
            .when((F.abs(x) <= F.abs(y)) & (F.abs(y) > F.abs(z)), F.when(y < 0, 4).otherwise(1))
            .otherwise(F.when(z < 0, 5).otherwise(2)),
        )
        on_face = faced.withColumns({
            "_u": by_number(F.col("_face"), [
                over(y, x), over(-x, y), over(-x, z), over(z, x), over(z, y), over(-y, z),
            ]),
            "_v": by_number(F.col("_face"), [
                over(z, x), over(z, y), over(-y, z), over(y, x), over(-x, y), over(-x, z),
            ]),
        })

        def step(u: str) -> Column:
            at = F.floor(_s2_st(F.col(u)) * (1 << level)).cast("int")
            return F.greatest(F.lit(0), F.least(F.lit((1 << level) - 1), at))

        cell = F.struct(F.col("_face").alias("face"), step("_u").alias("i"), step("_v").alias("j"))
        return on_face.withColumn("cell", F.when(on_globe(F.col("lat"), F.col("lon")), cell)).drop(
            "_x", "_y", "_z", "_face", "_u", "_v"
        )

    def parent(self, address: Column, level: int, to_level: Column) -> Column:
        shift = F.lit(level) - to_level
        return F.struct(
            address["face"].alias("face"),
            F.call_function("shiftright", address["i"], shift).alias("i"),
            F.call_function("shiftright", address["j"], shift).alias("j"),
        )

    def leaf(self, address: Column, level: Column, depth: int) -> Column:
        """Face and curve position down to ``depth``, the deepest level that occurs, as the high bits
        of a 64-bit number. Every enclosing cell's id follows from it by masking."""
        face = address["face"].cast("bigint")
        up = F.lit(depth) - level
        i = F.call_function("shiftleft", address["i"], up)
        j = F.call_function("shiftleft", address["j"], up)
        ij = F.transform(
            F.array(*[F.lit(bit) for bit in range(depth - 1, -1, -1)]),
            lambda bit: F.call_function("shiftright", i, bit).bitwiseAND(1) * 2
            + F.call_function("shiftright", j, bit).bitwiseAND(1),
        )
        steps = F.array(*[F.lit(v) for v in _s2_step()])
        start = F.struct(F.lit(0).cast("bigint").alias("at"), face.bitwiseAND(1).cast("int").alias("turn"))

        def descend(acc, bits):
            step = F.element_at(steps, acc["turn"] * 4 + bits + 1)
            return F.struct(
                (acc["at"] * 4 + F.floor(step / 4)).alias("at"), step.bitwiseAND(3).alias("turn")
            )

        at = F.aggregate(ij, start, descend)["at"]
        return F.shiftleft(face, 61).bitwiseOR(F.shiftleft(at, 61 - 2 * depth))

    def token(self, leaf: Column, level: Column) -> Column:
        """Id of the enclosing cell of a level in hexadecimal, without trailing zeros."""
        # Keep the digits of the level and set the bit that marks it.
        span = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(61) - level * 2)
        number = leaf.bitwiseAND(-span).bitwiseOR(F.shiftright(span, 1))
        return F.rtrim(F.lpad(F.lower(F.hex(number)), 16, "0"), F.lit("0"))

    def key(self, address: Column, level: Column, depth: int) -> Column:
        return self.token(self.leaf(address, level, depth), level)

    def outlined(self, cells: DataFrame) -> DataFrame:
        cell, size = F.col("cell"), F.pow(F.lit(2.0), F.col("res"))
        face = cell["face"]
        steps = F.array(*[F.array(F.lit(di), F.lit(dj)) for di, dj in ((0, 0), (1, 0), (1, 1), (0, 1))])

        def on_sphere(uv):
            u, v, one = uv["u"], uv["v"], F.lit(1.0)
            axes = {
                "x": [one, -u, -u, -one, v, v], "y": [u, one, -v, -v, -one, u], "z": [v, v, one, -u, -u, -one],
            }
            return F.struct(*[by_number(face, values).alias(name) for name, values in axes.items()])

        corners = F.transform(steps, lambda d: F.struct(
            _s2_uv((cell["i"] + d[0]) / size).alias("u"), _s2_uv((cell["j"] + d[1]) / size).alias("v")
        ))
        lonlat = F.transform(F.transform(corners, on_sphere), lambda p: F.array(
            F.degrees(F.atan2(p["y"], p["x"])),
            F.degrees(F.atan2(p["z"], F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]))),
        ))

        # A corner on a pole has no longitude: it becomes two, on its neighbours' meridians.
        def spread(corner, index):
            before = F.get(F.col("_corners"), (index + 3) % 4)
            after = F.get(F.col("_corners"), (index + 1) % 4)
            return F.when(
                F.abs(corner[1]) > 90 - 1e-9,
                F.array(F.array(before[0], corner[1]), F.array(after[0], corner[1])),
            ).otherwise(F.array(corner))

        # Level 0 on a polar face holds the pole inside: its ring is closed along +-90 degrees.
        parallel, pole = F.col("_corners")[0][1], F.when(face == 2, 90.0).otherwise(-90.0)
        cap = F.array(*[
            F.array(F.lit(lon), lat)
            for lon, lat in ((-180.0, parallel), (180.0, parallel), (180.0, pole), (-180.0, pole), (-180.0, parallel))
        ])
        ring = F.flatten(F.transform(F.col("_corners"), spread))
        rings = cells.withColumn("_corners", lonlat).withColumn("_ring", ring)
        closed = F.concat(F.col("_ring"), F.slice(F.col("_ring"), 1, 1))
        parts = F.when((F.col("res") == 0) & face.isin(2, 5), F.array(F.array(cap))).otherwise(
            split_at_antimeridian(closed)
        )
        return rings.withColumn("parts", parts).drop("_corners", "_ring")


# --- hexagons ------------------------------------------------------------------------------------


class HexCells:
    """Pointy-top hexagons on the equal-area cylindrical projection; ids are this scheme's own.

    An even number of columns goes round the globe, the nearest one to the edge asked for, so the lattice closes at the
    180th meridian: a hexagon there is one cell with one id, whichever side a point comes from. Hexagons of one
    resolution do not nest in the next, so every resolution is addressed from the points. Each finer resolution has
    about a seventh of the area.
    """

    nested = False

    def __init__(self, edge_degrees: float = 10.0):
        self.edge_degrees = edge_degrees

    def _columns(self, resolution: Column) -> Column:
        """Number of hexagons side by side round the globe."""
        return F.rint(F.lit(180.0 / (math.sqrt(3.0) * self.edge_degrees)) * F.pow(F.lit(math.sqrt(7.0)), resolution)) * 2

    def _edge(self, resolution: Column) -> Column:
        return F.lit(360.0 / math.sqrt(3.0)) / self._columns(resolution)

    def _wrapped(self, q: Column, r: Column, resolution: Column) -> Column:
        """The same hexagon's q with its centre between the 180th meridians."""
        n = self._columns(resolution).cast("int")
        # Every second row lies half a hexagon further east.
        shift, half = F.floor(r / 2).cast("int"), F.call_function("shiftright", n, F.lit(1))
        return F.pmod(q + shift + half, n) - half - shift

    def addressed(self, points: DataFrame) -> DataFrame:
        """Cells at the resolution in ``res``."""
        x, y = F.col("lon"), F.degrees(F.sin(F.radians(F.col("lat"))))
        edge = self._edge(F.col("res"))
        axial = points.withColumns({
            "_q": (x * (math.sqrt(3.0) / 3.0) - y / 3.0) / edge, "_r": (y * (2.0 / 3.0)) / edge,
        }).withColumn("_s", -F.col("_q") - F.col("_r"))
        whole = axial.withColumns({f"_n{c}": F.rint(F.col(f"_{c}")) for c in "qrs"})
        off = whole.withColumns({f"_d{c}": F.abs(F.col(f"_n{c}") - F.col(f"_{c}")) for c in "qrs"})
        # All three cube coordinates are rounded; the one that moved most follows from the others.
        q_worst = (F.col("_dq") > F.col("_dr")) & (F.col("_dq") > F.col("_ds"))
        r_worst = ~q_worst & (F.col("_dr") > F.col("_ds"))
        whole = off.withColumns({
            "_hq": F.when(q_worst, -F.col("_nr") - F.col("_ns")).otherwise(F.col("_nq")).cast("int"),
            "_hr": F.when(r_worst, -F.col("_nq") - F.col("_ns")).otherwise(F.col("_nr")).cast("int"),
        })
        cell = F.struct(self._wrapped(F.col("_hq"), F.col("_hr"), F.col("res")).alias("q"), F.col("_hr").alias("r"))
        return whole.withColumn("cell", F.when(on_globe(F.col("lat"), F.col("lon")), cell)).drop(
            *[f"_{kind}{c}" for kind in ("", "n", "d") for c in "qrs"], "_hq", "_hr"
        )

    def key(self, address: Column, resolution: Column, depth: int | None = None) -> Column:
        return F.concat_ws(":", resolution.cast("string"), address["q"].cast("string"), address["r"].cast("string"))

    def outlined(self, cells: DataFrame) -> DataFrame:
        q, r, edge, limit = F.col("cell.q"), F.col("cell.r"), F.col("_edge"), math.degrees(1.0)
        placed = cells.withColumn("_edge", self._edge(F.col("res"))).withColumns({
            "_cx": edge * math.sqrt(3.0) * (q + r / 2.0), "_cy": edge * 1.5 * r,
        })
        turns = [math.radians(60 * k - 30) for k in range(6)] + [math.radians(-30)]
        spokes = F.array(*[F.array(F.lit(math.cos(t)), F.lit(math.sin(t))) for t in turns])

        def corner(spoke):
            y = F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col("_cy") + edge * spoke[1]))
            return F.array(F.col("_cx") + edge * spoke[0], F.degrees(F.asin(F.radians(y))))

        rings = placed.withColumn("_ring", F.transform(spokes, corner))
        return rings.withColumn("parts", split_at_antimeridian(F.col("_ring"))).drop("_edge", "_cx", "_cy", "_ring")


# --- web-map tiles -------------------------------------------------------------------------------


def tile_index(lon: Column, lat: Column, zoom: Column) -> dict[str, Column]:
    """Web-Mercator tile column and row at a zoom; they are not clamped to the tile range."""
    n = F.pow(F.lit(2.0), zoom)
    phi = F.radians(lat)
    x = F.floor((lon + 180.0) / 360.0 * n)
    y = F.floor((1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0 * n)
    return {"x": x, "y": y}


class TileCells:
    """Web-map tiles as a grid scheme; points beyond the Mercator range fall into the edge rows."""

    nested = True

    def addressed(self, points: DataFrame, zoom: int) -> DataFrame:
        lat, lon = F.col("lat"), F.col("lon")
        at = tile_index(lon, lat, F.lit(zoom))
        top = (1 << zoom) - 1

        def clamped(c):
            return F.greatest(F.lit(0), F.least(F.lit(top), c)).cast("int")

        # The tangent has no finite value at the poles: they belong to the first and last row.
        row = F.when(lat >= 90, F.lit(0)).when(lat <= -90, F.lit(top)).otherwise(clamped(at["y"]))
        cell = F.struct(clamped(at["x"]).alias("x"), row.alias("y"))
        return points.withColumn("cell", F.when(on_globe(lat, lon), cell))

    def parent(self, address: Column, zoom: int, to_zoom: Column) -> Column:
        shift = F.lit(zoom) - to_zoom
        return F.struct(*[
            F.call_function("shiftright", address[name], shift).alias(name) for name in ("x", "y")
        ])

    def key(self, address: Column, zoom: Column, depth: int | None = None) -> Column:
        return F.concat_ws("/", zoom.cast("string"), address["x"].cast("string"), address["y"].cast("string"))

    def outlined(self, cells: DataFrame) -> DataFrame:
        n = F.pow(F.lit(2.0), F.col("res"))
        steps = F.array(*[F.array(F.lit(dx), F.lit(dy)) for dx, dy in ((0, 1), (1, 1), (1, 0), (0, 0), (0, 1))])

        def corner(d):
            lon = (F.col("cell.x") + d[0]) / n * 360.0 - 180.0
            return F.array(lon, F.degrees(F.atan(F.sinh((1.0 - (F.col("cell.y") + d[1]) * 2.0 / n) * math.pi))))

        return cells.withColumn("parts", F.array(F.array(F.transform(steps, corner))))


SCHEMES = {"s2": S2Cells(), "hex": HexCells(), "tile": TileCells()}
