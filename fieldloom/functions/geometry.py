"""Geometry of rings, quads and boxes as column expressions.

A ring is an open array of points (x, y).  All functions are built of
higher-order functions, so they run inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres in a degree.
M_LON, M_LAT = 111320.0, 110540.0


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def edges(ring: Column) -> Column:
    """(a, b) for each side, the closing one too."""
    return let(ring, lambda r: F.transform(r, lambda p, i: F.struct(p.alias("a"), F.get(r, (i + 1) % F.size(r)).alias("b"))))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, v: s + v)


def signed_area(ring: Column) -> Column:
    """Shoelace area; positive where the ring runs counter-clockwise, 0 below 3 points."""
    return F.when(F.size(ring) < 3, 0.0).otherwise(_sum(F.transform(edges(ring), lambda e: e.a.x * e.b.y - e.b.x * e.a.y)) / 2)


def ring_area(ring: Column | str) -> Column:
    return F.abs(signed_area(_column(ring)))


def ring_area_m2(ring: Column) -> Column:
    """Area in square metres of a lon/lat ring, scaled at its mean latitude."""
    def scaled(r):
        lat = F.radians(_sum(F.transform(r, lambda p: p.y)) / F.size(r))
        return F.transform(r, lambda p: F.struct((p.x * M_LON * F.cos(lat)).alias("x"), (p.y * M_LAT).alias("y")))

    return F.when(F.size(ring) < 3, 0.0).otherwise(let(ring, lambda r: ring_area(scaled(r))))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in the ring: even-odd crossings, half-open in y."""
    crossing = lambda e: ((e.a.y > y) != (e.b.y > y)) & (x < (e.b.x - e.a.x) * (y - e.a.y) / F.nullif(e.b.y - e.a.y, F.lit(0.0)) + e.a.x)
    return F.size(F.filter(edges(ring), lambda e: F.coalesce(crossing(e), F.lit(False)))) % 2 == 1


def _clip(ring: Column, inside, meet) -> Column:
    """One half-plane of Sutherland and Hodgman: inside points stay, crossings are added."""
    def side(e):
        a, b = inside(e.a), inside(e.b)
        return F.when(a & b, F.array(e.b)).when(a & ~b, F.array(meet(e))).when(~a & b, F.array(meet(e), e.b)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))

    return F.flatten(F.transform(edges(ring), side))


def _at_x(x: Column):
    return lambda e: F.struct(x.alias("x"), (e.a.y + (e.b.y - e.a.y) * (x - e.a.x) / F.nullif(e.b.x - e.a.x, F.lit(0.0))).alias("y"))


def _at_y(y: Column):
    return lambda e: F.struct((e.a.x + (e.b.x - e.a.x) * (y - e.a.y) / F.nullif(e.b.y - e.a.y, F.lit(0.0))).alias("x"), y.alias("y"))


def clip_to_box(ring: Column, w: Column, h: Column) -> Column:
    """The part of a ring in [0, w] x [0, h]; an empty array where nothing is left."""
    zero = F.lit(0.0)
    step = _clip(ring, lambda p: p.x >= 0, _at_x(zero))
    step = let(step, lambda r: _clip(r, lambda p: p.x <= w, _at_x(w.cast("double"))))
    step = let(step, lambda r: _clip(r, lambda p: p.y >= 0, _at_y(zero)))
    return let(step, lambda r: _clip(r, lambda p: p.y <= h, _at_y(h.cast("double"))))


def frame_coverage(ring: Column, w: Column, h: Column) -> Column:
    """Share of the ring's area inside the frame, 0 to 1; 0 for a ring without area."""
    share = ring_area(clip_to_box(ring, w, h)) / F.nullif(ring_area(ring), F.lit(0.0))
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)), F.lit(0.0))


def centroid(ring: Column | str) -> Column:
    """Mean of the vertices."""
    ring = _column(ring)
    mean = lambda f: _sum(F.transform(ring, f)) / F.size(ring)
    return F.struct(mean(lambda p: p.x).alias("x"), mean(lambda p: p.y).alias("y"))


def radial_push(ring: Column, metres: float) -> Column:
    """Every vertex moved away from the centroid by so many units."""
    def push(r):
        c = centroid(r)
        def far(p):
            d = F.hypot(p.x - c.x, p.y - c.y)
            k = F.when(d > 0, 1 + metres / d).otherwise(1.0)
            return F.struct((c.x + (p.x - c.x) * k).alias("x"), (c.y + (p.y - c.y) * k).alias("y"))
        return F.transform(r, far)

    return let(ring, push)


def mitre_buffer(ring: Column, metres: float) -> Column:
    """A convex ring whose sides are moved outwards by so many units; corners keep their order."""
    def moved(r):
        turn = F.when(signed_area(r) >= 0, 1.0).otherwise(-1.0)
        def line(e):
            dx, dy = e.b.x - e.a.x, e.b.y - e.a.y
            n = F.hypot(dx, dy)
            return F.struct((e.a.x + turn * metres * dy / n).alias("x"), (e.a.y - turn * metres * dx / n).alias("y"), dx.alias("dx"), dy.alias("dy"))
        def corner(lines):
            n = F.size(lines)
            def cut(b, i):
                a = F.get(lines, (i + n - 1) % n)
                det = a.dx * b.dy - a.dy * b.dx
                t = ((b.x - a.x) * b.dy - (b.y - a.y) * b.dx) / F.nullif(det, F.lit(0.0))
                return F.struct(F.coalesce(a.x + t * a.dx, b.x).alias("x"), F.coalesce(a.y + t * a.dy, b.y).alias("y"))
            return F.transform(lines, cut)
        return let(F.transform(edges(r), line), corner)

    return let(ring, moved)


def bilinear(quad: Column, s: Column, t: Column) -> Column:
    """The point at (s, t), 0 to 1, in a quad of corners 00, 10, 11, 01."""
    part = lambda k: (1 - s) * (1 - t) * quad[0][k] + s * (1 - t) * quad[1][k] + s * t * quad[2][k] + (1 - s) * t * quad[3][k]
    return F.struct(part("x").alias("x"), part("y").alias("y"))


def principal_angle(ring: Column) -> Column:
    """Direction in radians of the vertices' main axis: half of atan2(2 Sxy, Sxx - Syy)."""
    def turn(r):
        c = centroid(r)
        s = lambda f: _sum(F.transform(r, f))
        return 0.5 * F.atan2(2 * s(lambda p: (p.x - c.x) * (p.y - c.y)), s(lambda p: (p.x - c.x) * (p.x - c.x)) - s(lambda p: (p.y - c.y) * (p.y - c.y)))

    return let(ring, turn)


def min_area_frame(ring: Column) -> Column:
    """(cx, cy, ux, uy, hl, hw) of the least rectangle along one of the sides; the first on ties."""
    def frame(r):
        def one(e, i):
            dx, dy = e.b.x - e.a.x, e.b.y - e.a.y

            def placed(d):
                turned = F.struct(F.transform(r, lambda p: p.x * d.x + p.y * d.y).alias("along"), F.transform(r, lambda p: -p.x * d.y + p.y * d.x).alias("across"))
                ends = let(turned, lambda t: F.struct(F.array_min(t.along).alias("lo"), F.array_max(t.along).alias("hi"), F.array_min(t.across).alias("a"), F.array_max(t.across).alias("b")))
                return let(ends, lambda m: made(d, m))

            def made(d, m):
                u, v = (m.lo + m.hi) / 2, (m.a + m.b) / 2
                return F.struct(F.round((m.hi - m.lo) * (m.b - m.a), 9).alias("area"), i.alias("i"), (u * d.x - v * d.y).alias("cx"), (u * d.y + v * d.x).alias("cy"), d.x.alias("ux"), d.y.alias("uy"), ((m.hi - m.lo) / 2).alias("hl"), ((m.b - m.a) / 2).alias("hw"))

            return let(let(F.hypot(dx, dy), lambda n: F.struct((dx / n).alias("x"), (dy / n).alias("y"))), placed)
        return F.array_min(F.transform(F.filter(edges(r), lambda e: F.hypot(e.b.x - e.a.x, e.b.y - e.a.y) > 0), one))

    return let(ring, frame)


def distance_to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    length = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.coalesce(((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.nullif(length, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return F.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))
