"""Content hashes of parameters and geometry."""

from __future__ import annotations

import hashlib
import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landshift.functions.geometry import polygons_of


def parameter_hash(parameters: dict, length: int = 10) -> str:
    """First hex digits of the SHA-256 of the canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:length]


def canonical(pairs: Column) -> Column:
    """Canonical JSON of a map of strings to numbers, keys in order."""
    rows = F.array_sort(F.map_entries(pairs))
    return F.concat(F.lit("{"), F.array_join(F.transform(rows, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"].cast("string"))), ","), F.lit("}"))


def short_hash(text: Column, length: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def canonical_json(text: Column) -> Column:
    """JSON with the keys of all objects in order and no spaces; null where it is none."""
    return F.to_json(F.try_parse_json(text))


def same_json(a: Column, b: Column) -> Column:
    """Equality of JSON objects, in whatever order their keys stand."""
    return canonical_json(a).eqNullSafe(canonical_json(b))


def subset(parameters: Column, keys: tuple[str, ...]) -> Column:
    """Those entries of a map that ``keys`` name."""
    return F.map_filter(parameters, lambda k, _: k.isin(*keys))


def wkb(text: str) -> bytes:
    """A polygon's or multipolygon's coordinates as the well-known binary of a multipolygon, little-endian."""
    polygons = polygons_of(text)
    out = [struct.pack("<BII", 1, 6, len(polygons))]
    for rings in polygons:
        out.append(struct.pack("<BII", 1, 3, len(rings)))
        out += [struct.pack("<I", len(r)) + np.ascontiguousarray(r, "<f8").tobytes() for r in rings]
    return b"".join(out)


@F.pandas_udf(T.StringType())
def geometry_hash(coordinates: pd.Series) -> pd.Series:
    """First twelve hex digits of the SHA-256 of the geometry's well-known binary."""
    return coordinates.map(lambda t: hashlib.sha256(wkb(t)).hexdigest()[:12], na_action="ignore")


def _turned(ring: np.ndarray) -> tuple:
    """A ring from its least vertex on, in the lesser of its two directions."""
    points = [tuple(p) for p in ring[:-1].tolist()]
    at = points.index(min(points))
    ways = (points[at:] + points[:at], [points[at], *reversed(points[:at]), *reversed(points[at + 1 :])])
    return tuple(min(ways))


@F.pandas_udf(T.StringType())
def canonical_shape(coordinates: pd.Series) -> pd.Series:
    """A text that two polygons share if they have the same rings, wherever those begin, whichever way they run."""
    def one(t: str) -> str:
        return json.dumps(sorted([_turned(p[0]), *sorted(map(_turned, p[1:]))] for p in polygons_of(t) if p))

    return coordinates.map(one, na_action="ignore")
