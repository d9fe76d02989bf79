"""Planar geometry on arrays of points, in built-in functions; a ring is array<struct<x, y>>, closed or not."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres in a degree of longitude at the equator and of latitude.
METRES_X, METRES_Y = 111320.0, 110540.0


def segments(ring: Column) -> Column:
    """The sides of a ring as structs (a, b), the closing one included."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def side_distance(x: Column, y: Column, s: Column, kx: Column | float = 1.0, ky: Column | float = 1.0) -> Column:
    """Distance from a point to a side, with the two axes scaled."""
    kx, ky = (k if isinstance(k, Column) else F.lit(k) for k in (kx, ky))
    ax, ay, bx, by = ((s[p][c] - o) * k for p in ("a", "b") for c, o, k in (("x", x, kx), ("y", y, ky)))
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.when(length > 0, length))), F.lit(0.0))
    return F.sqrt((ax + t * dx) ** 2 + (ay + t * dy) ** 2)


def boundary_distance(x: Column, y: Column, ring: Column) -> Column:
    """Planar distance from a point to the nearest side of a ring."""
    return F.array_min(F.transform(segments(ring), lambda s: side_distance(x, y, s)))


def boundary_distance_m(lng: Column, lat: Column, ring: Column) -> Column:
    """The same in metres, on a plane around the point's own latitude."""
    kx = F.cos(F.radians(lat)) * METRES_X
    return F.array_min(F.transform(segments(ring), lambda s: side_distance(lng, lat, s, kx, METRES_Y)))


def contains(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside by the even-odd rule, half-open at the sides."""

    def crosses(s: Column) -> Column:
        a, b = s["a"], s["b"]
        rise = F.when(a["y"] != b["y"], b["y"] - a["y"])
        over = (a["y"] > y) != (b["y"] > y)
        return F.coalesce(over & (x < (b["x"] - a["x"]) * (y - a["y"]) / rise + a["x"]), F.lit(False))

    return F.size(F.filter(segments(ring), crosses)) % 2 == 1


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive anticlockwise."""
    terms = F.transform(segments(ring), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])
    return F.aggregate(terms, F.lit(0.0), lambda t, v: t + v) / 2


def envelope(ring: Column) -> Column:
    """minx, miny, maxx, maxy."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def padded(minx: Column, miny: Column, maxx: Column, maxy: Column, metres: float) -> Column:
    """A box of degrees, wider by metres on all sides."""
    lat = (miny + maxy) / 2
    dx, dy = metres / (METRES_X * F.greatest(F.cos(F.radians(lat)), F.lit(0.2))), metres / METRES_Y
    return F.struct((minx - dx).alias("minx"), (miny - dy).alias("miny"), (maxx + dx).alias("maxx"), (maxy + dy).alias("maxy"))


def turned(ring: Column, degrees: Column, dx: Column | float = 0.0, dy: Column | float = 0.0) -> Column:
    """A ring turned about the origin and shifted."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return F.transform(ring, lambda p: F.struct((p["x"] * c - p["y"] * s + dx).alias("x"), (p["x"] * s + p["y"] * c + dy).alias("y")))


def clean_ring(ring: Column) -> Column:
    """A ring without repeated neighbours, closed; null with fewer than three points or no area."""
    once = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731  # a bound variable: each step is evaluated once
    kept = lambda r: F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, i - 1)))
    open_ = lambda k: F.when((F.size(k) > 1) & (F.get(k, F.lit(0)) == F.get(k, F.size(k) - 1)), F.slice(k, 1, F.size(k) - 1)).otherwise(k)
    closed = lambda o: F.when((F.size(F.array_distinct(o)) >= 3) & (F.abs(signed_area(o)) > 1e-12), F.concat(o, F.slice(o, 1, 1)))
    return once(ring, lambda r: once(kept(r), lambda k: once(open_(k), closed)))


def field_gap(a: Column, b: Column) -> Column:
    """Least distance between the corners of one ring and the sides of the other, either way round."""
    one = lambda p, q: F.array_min(F.transform(p, lambda v: F.array_min(F.transform(segments(q), lambda s: side_distance(v["x"], v["y"], s)))))
    return F.least(one(a, b), one(b, a))


def utm_zone(lng: Column) -> Column:
    """1 to 60, with longitudes beyond the antimeridian wrapped."""
    return (F.floor(F.pmod(lng + 180, F.lit(360.0)) / 6) + 1).cast("int")


def utm_epsg(lng: Column, lat: Column) -> Column:
    return F.when(lat < 0, 32700).otherwise(32600) + utm_zone(lng)


#: WGS 84 semi-major axis, flattening, UTM scale.
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996
_N = _F / (2 - _F)
_RECTIFYING = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)


def to_utm(lng: Column, lat: Column, zone: Column) -> Column:
    """easting, northing by Krueger's series to the fourth order."""
    lam = F.radians(lng - (zone * 6 - 183))
    phi = F.radians(lat)
    e = math.sqrt(_F * (2 - _F))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) ** 2))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    south = F.when(lat < 0, 10_000_000.0).otherwise(0.0)
    return F.struct((_K0 * _RECTIFYING * x + 500_000).alias("easting"), (_K0 * _RECTIFYING * y + south).alias("northing"))


def from_utm(easting: Column, northing: Column, zone: Column, south: Column) -> Column:
    """lng, lat of a point in a zone: Krueger's inverse series, then the latitude from its conformal one."""
    beta = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
    xi = (northing - F.when(south, 10_000_000.0).otherwise(0.0)) / (_K0 * _RECTIFYING)
    eta = (easting - 500_000) / (_K0 * _RECTIFYING)
    x, y = xi, eta
    for j, b in enumerate(beta, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    conformal = F.asin(F.sin(x) / F.cosh(y))
    delta = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)
    lat = conformal
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * conformal)
    lng = F.degrees(F.atan2(F.sinh(y), F.cos(x))) + (zone * 6 - 183)
    return F.struct(lng.alias("lng"), F.degrees(lat).alias("lat"))


def grid_convergence(lng: Column, lat: Column) -> Column:
    """Degrees clockwise from true north to the zone's grid north: the bearing of a point 100 m up the grid."""
    zone = utm_zone(lng)
    here = to_utm(lng, lat, zone)
    there = from_utm(here["easting"], here["northing"] + 100, zone, lat < 0)
    return F.degrees(F.atan2((there["lng"] - lng) * F.cos(F.radians(lat)), there["lat"] - lat))


def utm_envelope(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The envelope, in the zone of its middle, of the four corners of a box of degrees."""
    zone = utm_zone((minx + maxx) / 2)
    corners = [to_utm(x, y, zone) for x in (minx, maxx) for y in (miny, maxy)]
    side = lambda pick, name: pick(*[c[name] for c in corners])
    return F.struct(side(F.least, "easting").alias("minx"), side(F.least, "northing").alias("miny"), side(F.greatest, "easting").alias("maxx"), side(F.greatest, "northing").alias("maxy"))


def sides_cross(a: Column, b: Column) -> Column:
    """Whether a side of one ring passes through a side of the other."""
    turn = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    apart = lambda s, t: turn(s["a"], s["b"], t["a"]) * turn(s["a"], s["b"], t["b"]) < 0
    return F.exists(segments(a), lambda s: F.exists(segments(b), lambda t: apart(s, t) & apart(t, s)))


def ring_distance(a: Column, b: Column) -> Column:
    """Distance between the areas of two rings: 0 where they share any."""
    inside = lambda p, q: contains(p[0]["x"], p[0]["y"], q)
    return F.when(inside(a, b) | inside(b, a) | sides_cross(a, b), 0.0).otherwise(field_gap(a, b))


def clipped(ring: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The part of a ring inside a box, by cutting it at each of the four sides in turn; may be empty."""
    bound = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  value is computed once

    def cut(axis: str, limit: Column, sign: int):
        depth = lambda p: (p[axis] - limit) * sign

        def kept(s: Column) -> Column:
            a, b = s["a"], s["b"]
            t = depth(a) / (depth(a) - depth(b))
            meet = F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"))
            here = F.when(depth(a) >= 0, F.array(a)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
            return F.when((depth(a) >= 0) != (depth(b) >= 0), F.concat(here, F.array(meet))).otherwise(here)

        return lambda own: F.when(F.size(own) > 0, F.flatten(F.transform(segments(own), kept))).otherwise(own)

    out = ring
    for axis, limit, sign in (("x", minx, 1), ("x", maxx, -1), ("y", miny, 1), ("y", maxy, -1)):
        out = bound(out, cut(axis, limit, sign))
    return out


def overlap_area(ring: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The area that a ring shares with a box."""
    own = F.transform(F.array(clipped(ring, minx, miny, maxx, maxy)), lambda r: F.when(F.size(r) > 2, F.abs(signed_area(r))).otherwise(0.0))
    return own[0]


def nearest_turn(degrees: Column) -> Column:
    """The turn to the nearest quarter, over -45 to 45 degrees."""
    return 45 - F.pmod(45 - degrees, F.lit(90.0))


def is_aligned(degrees: Column, within: float) -> Column:
    return F.abs(nearest_turn(degrees)) <= within


def sides(rings: Column) -> Column:
    """The sides of some rings, outer ones and holes alike, as (x, y, dx, dy, l2): start, way to the end, squared length."""
    one = lambda a, b: F.struct(a["x"].alias("x"), a["y"].alias("y"), (b["x"] - a["x"]).alias("dx"), (b["y"] - a["y"]).alias("dy"), ((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])).alias("l2"))
    return F.flatten(F.transform(rings, lambda r: F.zip_with(r, F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)), one)))


def scaled_sides(own: Column, kx: Column, ky: Column) -> Column:
    """Sides with their axes scaled."""
    return F.transform(own, lambda s: F.struct((s["x"] * kx).alias("x"), (s["y"] * ky).alias("y"), (s["dx"] * kx).alias("dx"), (s["dy"] * ky).alias("dy"), (s["dx"] * s["dx"] * kx * kx + s["dy"] * s["dy"] * ky * ky).alias("l2")))


def squared_to_side(x: Column, y: Column, s: Column) -> Column:
    """Squared distance from a point to a side."""
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - s["x"]) * s["dx"] + (y - s["y"]) * s["dy"]) / F.when(s["l2"] > 0, s["l2"]))), F.lit(0.0))
    foot = F.transform(F.array(t), lambda k: F.pow(x - s["x"] - k * s["dx"], F.lit(2.0)) + F.pow(y - s["y"] - k * s["dy"], F.lit(2.0)))  # t is computed once
    return foot[0]


def squared_to_sides(x: Column, y: Column, own: Column) -> Column:
    return F.array_min(F.transform(own, lambda s: squared_to_side(x, y, s)))


def within_sides(x: Column, y: Column, own: Column) -> Column:
    """Whether a point lies inside, by the even-odd rule, so holes are outside and parts inside."""
    hit = lambda s: ((s["y"] > y) != (s["y"] + s["dy"] > y)) & (x < s["x"] + s["dx"] * (y - s["y"]) / s["dy"])
    return F.size(F.filter(own, hit)) % 2 == 1


def sides_meet(a: Column, b: Column) -> Column:
    """Whether a side of one area passes through a side of the other."""
    turn = lambda s, x, y: s["dx"] * (y - s["y"]) - s["dy"] * (x - s["x"])
    apart = lambda s, t: turn(s, t["x"], t["y"]) * turn(s, t["x"] + t["dx"], t["y"] + t["dy"]) < 0
    return F.exists(a, lambda s: F.exists(b, lambda t: apart(s, t) & apart(t, s)))


def squared_apart(a: Column, b: Column) -> Column:
    """Squared distance between two areas, given by their sides: 0 where they share any."""
    inside = lambda p, q: F.exists(p, lambda s: within_sides(s["x"], s["y"], q))
    gap = lambda p, q: F.array_min(F.transform(p, lambda s: squared_to_sides(s["x"], s["y"], q)))
    return F.when(inside(a, b) | inside(b, a) | sides_meet(a, b), 0.0).otherwise(F.least(gap(a, b), gap(b, a)))


def envelope_of(own: Column) -> Column:
    """The box of some sides."""
    low, high = lambda c: F.array_min(F.transform(own, lambda s: s[c])), lambda c: F.array_max(F.transform(own, lambda s: s[c]))
    return F.struct(low("x").alias("minx"), low("y").alias("miny"), high("x").alias("maxx"), high("y").alias("maxy"))


def shared_area(a: Column, b: Column, base: Column) -> Column:
    """The area that two areas share, given by the sides of rings that all run the same way round (holes the other way).

    Each side stands for the strip between it and a base line under both areas, counted by its direction; the strips of
    a and of b share what lies under both sides, so the sum over all pairs is the shared area, for concave rings too.
    """
    end = lambda s: s["x"] + s["dx"]
    bound = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  value is computed once
    height = lambda s, x: s["y"] + s["dy"] * (x - s["x"]) / s["dx"] - base

    def under(lo: Column, width: Column, v: Column) -> Column:
        """The area under both of two sides over a span, from the heights at its ends."""
        d0, d1 = v["a0"] - v["b0"], v["a1"] - v["b1"]
        low0, low1 = F.least(v["a0"], v["b0"]), F.least(v["a1"], v["b1"])
        u = d0 / (d0 - d1)
        meet = v["a0"] + u * (v["a1"] - v["a0"])
        return F.when((d0 > 0) & (d1 < 0) | (d0 < 0) & (d1 > 0), ((low0 + meet) * u + (meet + low1) * (1 - u)) * width / 2).otherwise((low0 + low1) * width / 2)

    def strip(s: Column, t: Column) -> Column:
        span = F.struct(F.greatest(F.least(s["x"], end(s)), F.least(t["x"], end(t))).alias("lo"), F.least(F.greatest(s["x"], end(s)), F.greatest(t["x"], end(t))).alias("hi"))
        ends = lambda p: F.struct(height(s, p["lo"]).alias("a0"), height(s, p["hi"]).alias("a1"), height(t, p["lo"]).alias("b0"), height(t, p["hi"]).alias("b1"))
        area = lambda p: bound(ends(p), lambda v: under(p["lo"], p["hi"] - p["lo"], v))
        return bound(span, lambda p: F.when((p["hi"] > p["lo"]) & (s["dx"] != 0) & (t["dx"] != 0), area(p) * F.signum(s["dx"]) * F.signum(t["dx"])).otherwise(0.0))

    return F.aggregate(F.transform(a, lambda s: F.aggregate(F.transform(b, lambda t: strip(s, t)), F.lit(0.0), lambda x, y: x + y)), F.lit(0.0), lambda x, y: x + y)


def sides_area(own: Column) -> Column:
    """The signed area inside some sides, positive clockwise by the direction in which sides count in shared_area."""
    return F.aggregate(own, F.lit(0.0), lambda t, s: t + s["dx"] * (2 * s["y"] + s["dy"]) / 2)
