"""Column builders of boxes, quadrilaterals, ramps and the text of coordinates; all of them plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x_min", "y_min", "x_max", "y_max")
Corner = tuple[Column, Column]


def cols(prefix: str = "") -> tuple[Column, ...]:
    """Columns of a box whose names have a prefix; nulls stay null."""
    return tuple(F.col(prefix + c) for c in BOX)


def iou(a: tuple[Column, ...], b: tuple[Column, ...], clamp: bool = False) -> Column:
    """Intersection over union of (x_min, y_min, x_max, y_max); touching boxes give 0.  ``clamp`` makes negative sides 0."""

    def side(lo: Column, hi: Column) -> Column:
        return F.greatest(hi - lo, F.lit(0.0)) if clamp else hi - lo

    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    inter = w * h
    union = side(a[0], a[2]) * side(a[1], a[3]) + side(b[0], b[2]) * side(b[1], b[3]) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def quad_area(c: list[Corner]) -> Column:
    """Shoelace area of four corners, without regard to their direction; null if a coordinate is null."""
    total = F.lit(0.0)
    for (x1, y1), (x2, y2) in zip(c, c[1:] + c[:1], strict=True):
        total = total + x1 * y2 - x2 * y1
    return F.abs(total) / 2


def is_convex(c: list[Corner]) -> Column:
    """All clear turns go the same way; turns under 1e-9 do not count."""
    turns = []
    for (ax, ay), (bx, by), (cx, cy) in zip(c, c[1:] + c[:1], c[2:] + c[:2], strict=True):
        cross = (bx - ax) * (cy - by) - (by - ay) * (cx - bx)
        turns.append(F.when(F.abs(cross) < 1e-9, None).otherwise(F.signum(cross)))
    return F.coalesce(F.least(*turns) == F.greatest(*turns), F.lit(True))


def order_corners(c: list[Corner]) -> Column:
    """Struct tl, tr, br, bl: extremes of x + y and x - y, the first of equals."""
    points = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in c])

    def first(key) -> Column:
        return F.array_min(F.transform(points, lambda p, i: F.struct(key(p).alias("key"), i.alias("i"), p.alias("p"))))["p"]

    return F.struct(first(lambda p: p["x"] + p["y"]).alias("tl"), first(lambda p: p["y"] - p["x"]).alias("tr"), first(lambda p: -(p["x"] + p["y"])).alias("br"), first(lambda p: p["x"] - p["y"]).alias("bl"))


def reorder_keypoints(points: Column) -> Column:
    """Four keypoints (structs x, y) as tl, tr, br, bl from their leftmost and rightmost pairs.

    Fewer than four different points (to 5 places) come back unchanged; pairs that overlap fall
    back to the extremes of x + y, the remaining two ordered by x.
    """
    rounded = F.array_distinct(F.transform(points, lambda p: F.struct(F.bround(p["x"], 5).alias("x"), F.bround(p["y"], 5).alias("y"))))

    def ranked(key, array: Column = points) -> Column:
        return F.transform(F.array_sort(F.transform(array, lambda p, i: F.struct(*key(p), i.alias("i"), p.alias("p")))), lambda s: s["p"])

    def pick(array: Column, key) -> Column:
        return F.element_at(ranked(key, array), 1)

    left, right = F.slice(ranked(lambda p: (p["x"].alias("a"), p["y"].alias("b"))), 1, 2), F.slice(ranked(lambda p: ((-p["x"]).alias("a"), p["y"].alias("b"))), 1, 2)
    tl, bl = pick(left, lambda p: ((p["x"] + p["y"]).alias("a"),)), pick(left, lambda p: ((-p["y"]).alias("a"),))
    tr, br = pick(right, lambda p: (p["y"].alias("a"),)), pick(right, lambda p: ((-(p["x"] + p["y"])).alias("a"),))
    main = F.array(tl, tr, br, bl)
    tl2, br2 = pick(points, lambda p: ((p["x"] + p["y"]).alias("a"),)), pick(points, lambda p: ((-(p["x"] + p["y"])).alias("a"),))
    rest = F.filter(points, lambda p: (p != tl2) & (p != br2))
    a, b = F.get(rest, 0), F.get(rest, 1)
    swapped = a["x"] >= b["x"]
    fallback = F.when(F.size(rest) == 2, F.array(tl2, F.when(swapped, a).otherwise(b), br2, F.when(swapped, b).otherwise(a))).otherwise(points)
    return F.when((F.size(points) != 4) | (F.size(rounded) < 4), points).when(F.size(F.array_distinct(main)) == 4, main).otherwise(fallback)


def rotate(x: Column, y: Column, cx: Column | float, cy: Column | float, degrees: Column | float) -> Corner:
    """Point after a turn about (cx, cy); null if a value is null."""
    angle = F.radians(F.lit(degrees) if isinstance(degrees, (int, float)) else degrees)
    dx, dy = x - cx, y - cy
    return cx + dx * F.cos(angle) - dy * F.sin(angle), cy + dx * F.sin(angle) + dy * F.cos(angle)


def rotate_quarter(x: Column, y: Column, turn: Column) -> Corner:
    """Normalised point after a clockwise turn of 0, 90, 180 or 270 degrees."""
    nx = F.when(turn == 90, 1 - y).when(turn == 180, 1 - x).when(turn == 270, y).otherwise(x)
    ny = F.when(turn == 90, x).when(turn == 180, 1 - y).when(turn == 270, 1 - x).otherwise(y)
    return nx, ny


def unaugment(x: Column, y: Column, width: Column | float, height: Column | float, flip: Column, degrees: Column | float, scale: Column | float) -> Corner:
    """Undo a test-time augmentation: mirror back, turn back about the centre, divide by the scale."""
    fx = F.when(flip, F.lit(width) - x).otherwise(x)
    rx, ry = rotate(fx, y, width / 2, height / 2, -degrees)
    return rx / scale, ry / scale


def scale_box(box: tuple[Column, ...], sx: Column | float, sy: Column | float) -> tuple[Column, ...]:
    """Proxy box on the full image; coordinates are truncated."""
    return tuple((c * s).cast("int") for c, s in zip(box, (sx, sy, sx, sy), strict=True))


def clip(c: Column, lo: float = 0.0, hi: Column | float = 1.0) -> Column:
    """Within bounds; null stays null (greatest and least alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi) if isinstance(hi, (int, float)) else hi, c)))


def to_xyxy(cx: Column, cy: Column, w: Column, h: Column) -> tuple[Column, ...]:
    """Centre and size of a box as x_min, y_min, x_max, y_max; nulls stay null."""
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def box_of(c: list[Corner]) -> tuple[Column, ...]:
    """Smallest box around corners; null coordinates are passed over."""
    xs, ys = [x for x, _ in c], [y for _, y in c]
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def outer_box(box: tuple[Column, ...]) -> tuple[Column, ...]:
    """Box with whole numbers that holds the given one; nulls stay null."""
    return F.floor(box[0]), F.floor(box[1]), F.ceil(box[2]), F.ceil(box[3])


def skew_angle(c: list[Corner]) -> Column:
    """Mean angle of the upper and lower edge, in degrees."""
    by_y = F.array_sort(F.array(*[F.struct(y.alias("y"), F.lit(i).alias("i"), x.alias("x")) for i, (x, y) in enumerate(c)]))

    def edge(first: int) -> Column:
        pair = F.array_sort(F.transform(F.slice(by_y, first, 2), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
        a, b = F.element_at(pair, 1), F.element_at(pair, 2)
        return F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))

    return (edge(1) + edge(3)) / 2


def ramp_down(v: Column, good: Column | float, bad: Column | float) -> Column:
    """1 up to ``good``, 0 from ``bad``, linear between; null stays null."""
    return F.when(v <= good, 1.0).when(v >= bad, 0.0).otherwise((F.lit(bad) - v) / (F.lit(bad) - F.lit(good)))


def ramp_up(v: Column, bad: Column | float, good: Column | float) -> Column:
    """0 up to ``bad``, 1 from ``good``, linear between; null stays null."""
    return F.when(v >= good, 1.0).when(v <= bad, 0.0).otherwise((v - F.lit(bad)) / (F.lit(good) - F.lit(bad)))


def ramp_range(v: Column, bad_lo, good_lo, good_hi, bad_hi) -> Column:
    """1 between the good bounds, 0 outside the bad ones, linear between; null stays null."""
    lo, glo, ghi, hi = (F.lit(b) for b in (bad_lo, good_lo, good_hi, bad_hi))
    return F.when((v >= glo) & (v <= ghi), 1.0).when((v <= lo) | (v >= hi), 0.0).when(v < glo, (v - lo) / (glo - lo)).otherwise((hi - v) / (hi - ghi))


def fit_dims(w: Column, h: Column, most: int, truncate: bool) -> Corner:
    """Size within ``most`` pixels a side, never enlarged; truncated or rounded half to even."""
    s = F.least(F.lit(float(most)) / w, F.lit(float(most)) / h, F.lit(1.0))
    return tuple((c * s).cast("int") if truncate else F.bround(c * s, 0).cast("int") for c in (w, h))


def fixed(value: Column, places: int) -> Column:
    """Text of a double with so many places, as C's printf writes it: its exact binary value is rounded, halves go to the even digit.

    Java's formatter, and with it ``format_string``, rounds the shortest decimal half up, so 50.0625 and 1.0055 differ at three
    places.  Null stays null; from 2^53 on, where a double is a whole number, the text is Java's.
    """
    unit = 10.0**places

    def bound(c: Column, then) -> Column:
        return F.get(F.transform(F.array(c), then), 0)

    def units(part: Column) -> Column:
        split = part * (2.0**27 + 1)
        high = split - (split - part)
        product = part * unit
        lost = (high * unit - product) + (part - high) * unit  # what the product was rounded by, exactly
        off = product - F.rint(product)
        return F.rint(product) + F.when((off == 0.5) & (lost > 0), 1.0).when((off == -0.5) & (lost < 0), -1.0).otherwise(0.0)

    def text(v: Column) -> Column:
        size = F.abs(v)
        whole = F.floor(size)
        digits = bound(bound(size - whole, units), lambda n: F.concat((whole + F.when(n == unit, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((n % unit).cast("long").cast("string"), places, "0")))
        plain = F.when(F.isnan(v), "nan").when(size == float("inf"), "inf").when(size < 2.0**53, digits).otherwise(F.format_string(f"%.{places}f", size))
        return F.concat(F.when(v.cast("string").startswith("-"), "-").otherwise(""), plain)  # a negative zero has its sign, too

    return F.when(value.isNotNull(), bound(value, text))
