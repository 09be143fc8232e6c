"""Angles, positions and boxes as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Views are 30 degrees apart, 12 to a ring; norms of distances and hops; image sizes of the box features.
STEP = math.radians(30)
RING = 12
VIEWS = 36
MOST_DISTANCE, MOST_HOPS = 30.0, 10.0
XYWH_HEIGHT, XYWH_WIDTH, XYXY_SIDE = 480.0, 640.0, 224.0
LEAST = 1e-8
FULL = 2 * math.pi

Point = tuple[Column, Column, Column]


def distance(a: Point, b: Point) -> Column:
    """Euclidean distance of two positions."""
    return F.sqrt(sum((p - q) * (p - q) for p, q in zip(a, b)))


def rounded(number: Column, places: int = 6) -> Column:
    """``round`` without decimal arithmetic for numbers up to a million, but where a tie is near: many rows spent most of their time there."""
    scaled, one = number * 10.0**places, F.lit(10.0**places)
    sure = number.between(-1e6, 1e6) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    return F.when(sure, F.floor(scaled + 0.5) / one).otherwise(F.round(number, places))


def angle_feature(heading: Column, elevation: Column, size: int = 4) -> Column:
    """Sines and cosines of both angles, repeated up to ``size`` numbers."""
    one = F.array(F.sin(heading), F.cos(heading), F.sin(elevation), F.cos(elevation))
    return one if size // 4 <= 1 else F.flatten(F.array_repeat(one, size // 4))


def normalised_angle(x: Column) -> Column:
    """Radians in (-pi, pi]."""
    turn = F.pmod(x, F.lit(FULL))
    return F.when(turn > math.pi, turn - FULL).otherwise(turn)


def heading_fraction(x: Column) -> Column:
    """A heading as a share of the full turn, in [0, 1)."""
    return F.pmod(x, F.lit(FULL)) / FULL


def elevation_fraction(x: Column) -> Column:
    """An elevation moved into [0, 1]."""
    return (normalised_angle(x) + math.pi) / FULL


def view_heading(view: Column) -> Column:
    """Heading at the middle of a numbered view."""
    return (view % RING) * STEP


def view_elevation(view: Column) -> Column:
    """Elevation of a view's ring: down, level, up."""
    return (F.floor(view / RING) - 1) * STEP


def relative_position(a: Point, b: Point, heading: Column, elevation: Column) -> tuple[Column, Column, Column]:
    """(heading, elevation, distance) of b seen from a by one who looks at ``heading``, ``elevation``.

    Zero distances count as LEAST. Behind the viewer (smaller y) the heading is mirrored.
    """
    dx, dy, dz = (q - p for p, q in zip(a, b))
    flat = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(LEAST))
    far = F.greatest(F.sqrt(dx * dx + dy * dy + dz * dz), F.lit(LEAST))
    side = F.asin(dx / flat)
    return F.when(b[1] < a[1], math.pi - side).otherwise(side) - heading, F.asin(dz / far) - elevation, far


def position_feature(relative: tuple[Column, Column, Column], graph_distance: Column, hops: Column, known: Column) -> Column:
    """Seven numbers: four of the angles, then straight and graph distance and hops over their norms; an absent node has angles 0 and distances 0."""
    heading, elevation, line = (F.when(known, x).otherwise(0.0) for x in relative)
    rest = (line / MOST_DISTANCE, F.when(known, graph_distance).otherwise(0.0) / MOST_DISTANCE, F.when(known, hops).otherwise(0) / MOST_HOPS)
    return F.concat(angle_feature(heading, elevation), F.array(*rest))


def box_feature_xywh(box: Column) -> Column:
    """Height and width over the image's, and their product, of a box (x, y, w, h)."""
    h, w = box[3] / XYWH_HEIGHT, box[2] / XYWH_WIDTH
    return F.array(h, w, h * w)


def box_feature_xyxy(box: Column) -> Column:
    """The same of a box given by two corners."""
    h, w = (box[3] - box[1]) / XYXY_SIDE, (box[2] - box[0]) / XYXY_SIDE
    return F.array(h, w, h * w)


def pairwise_mask(mask: Column) -> Column:
    """An additive attention mask: 0 where ``mask`` holds, else -10000."""
    return F.transform(mask, lambda m: F.when(m, 0.0).otherwise(-10000.0))
