"""Damage rings of KML files: placemarks whose names stand for fluence thresholds."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.geo import utm_columns
from gridloom.sources import files

NAMESPACE = "{http://www.opengis.net/kml/2.2}"
# MJ/m2 at each ring.
FLUENCE = {
    "Serious Burn (2nd-deg)": 0.25,
    "Severe Burn (3rd-deg)": 0.42,
    "Critical Burn (clothing)": 0.84,
    "Unsurvivable Burn (structures)": 1.20,
}


@dataclass(frozen=True)
class Ring:
    name: str
    fluence: float
    points: tuple[tuple[float, float], ...]  # longitude, latitude


@dataclass(frozen=True)
class Damage:
    city: str
    band: str
    rings: tuple[Ring, ...]  # fluence rising


def _key(text: str) -> str:
    return re.sub(r"\s+", " ", text.strip()).casefold()


def _text(node) -> str:
    return (node.text or "").strip() if node is not None else ""


def _rings(parent) -> tuple[Ring, ...]:
    """The parent's own ring placemarks; nothing unless all four thresholds are there."""
    found = []
    for mark in parent.findall(f"{NAMESPACE}Placemark"):
        name, line = _text(mark.find(f"{NAMESPACE}name")), _text(mark.find(f".//{NAMESPACE}coordinates"))
        points = tuple((float(p[0]), float(p[1])) for p in (token.split(",") for token in line.split()) if len(p) > 1)
        if name in FLUENCE and len(points) >= 4:
            found.append(Ring(name, FLUENCE[name], points))
    return tuple(sorted(found, key=lambda r: r.fluence)) if {r.name for r in found} == set(FLUENCE) else ()


def load_damage(spark: SparkSession, path: str, city: str, band: str = "Mean") -> Damage:
    """The ring set of "<city> <band> Thermal Damage".

    Failing that name (case and spaces aside), the only set whose name holds the
    city, then the only set of the file; otherwise an error.
    """
    root = ET.fromstring(files.read_text(spark, path))
    sets = [(_text(f.find(f"{NAMESPACE}name")), _rings(f)) for f in root.iter(f"{NAMESPACE}Folder")]
    sets += [("", _rings(d)) for d in [root, *root.iter(f"{NAMESPACE}Document")]]
    sets = [(n, r) for n, r in sets if r]
    suffix = "thermal damage"
    exact = [(n, r) for n, r in sets if _key(n) == _key(f"{city} {band} {suffix}")]
    if exact:
        return Damage(city, band, exact[0][1])
    of_city = [(n, r) for n, r in sets if _key(city) in _key(n) and suffix in _key(n)]
    if len(of_city) == 1:
        found = re.fullmatch(rf"{re.escape(city)} (.*) {suffix}", of_city[0][0].strip(), re.I)
        return Damage(city, found[1] if found else band, of_city[0][1])
    if len(sets) == 1:
        return Damage(city, band, sets[0][1])
    raise ValueError(f"no ring set for {city} {band} in {path}: found {[n for n, _ in sets]}")


def rings_table(spark: SparkSession, damage: Damage) -> DataFrame:
    rows = [(r.name, r.fluence, k, *p) for r in damage.rings for k, p in enumerate(r.points)]
    return spark.createDataFrame(rows, "ring string, fluence double, seq int, lon double, lat double")


def ring_radii(rings: DataFrame, epsg: int) -> DataFrame:
    """(ring, fluence, radius, cx, cy): mean distance of a ring's vertices to the innermost ring's centroid.

    The innermost ring has the highest fluence. Its centroid is that of its area
    (shoelace); the closing vertex counts like the others for the distance.
    """
    x, y = utm_columns(F.col("lon"), F.col("lat"), epsg)
    flat = rings.select("ring", "fluence", "seq", x.alias("px"), y.alias("py"))
    inner = flat.join(F.broadcast(flat.agg(F.max("fluence").alias("fluence"))), "fluence")
    origin = F.broadcast(inner.agg(F.min_by("px", "seq").alias("ox"), F.min_by("py", "seq").alias("oy"), F.max("seq").alias("last")))
    # relative to the first vertex, or the products of large numbers lose the metres
    at = inner.join(origin).select("seq", "last", "ox", "oy", (F.col("px") - F.col("ox")).alias("x"), (F.col("py") - F.col("oy")).alias("y"))
    after = at.select(F.col("seq").alias("seq"), F.col("x"), F.col("y")).alias("b")
    pairs = at.alias("a").join(after, F.pmod(F.col("a.seq") + 1, F.col("a.last") + 1) == F.col("b.seq"))
    cross = F.col("a.x") * F.col("b.y") - F.col("b.x") * F.col("a.y")
    area = F.sum(cross) / 2
    center = pairs.agg(
        (F.sum((F.col("a.x") + F.col("b.x")) * cross) / (6 * area) + F.first("ox")).alias("cx"),
        (F.sum((F.col("a.y") + F.col("b.y")) * cross) / (6 * area) + F.first("oy")).alias("cy"),
    )
    away = F.avg(F.hypot(F.col("px") - F.col("cx"), F.col("py") - F.col("cy")))
    return flat.join(F.broadcast(center)).groupBy("ring", "fluence", "cx", "cy").agg(away.alias("radius"))
