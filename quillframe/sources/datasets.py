"""Small named data sets for examples and tests: synthetic, seeded, of the usual shapes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.errors import InvalidParameterError
from quillframe.sources.generated import normal, uniform


@dataclass(frozen=True)
class Shape:
    rows: int
    features: int
    #: classes of one label, or 0 for numbers
    classes: int
    targets: int = 1
    form: str = "clouds"


# Rows, features, classes and targets of each set.
SETS = {
    "iris": Shape(150, 4, 3), "digits": Shape(1797, 64, 10), "breast_cancer": Shape(569, 30, 2), "diabetes": Shape(442, 10, 0), "linnerud": Shape(20, 3, 0, 3),
    "flowers_extended": Shape(180, 6, 4), "leaf_shapes": Shape(150, 8, 5), "fruit_quality": Shape(150, 5, 3), "seed_morphology": Shape(150, 4, 3),
    "moons_multi": Shape(150, 2, 3, form="arcs"), "concentric_rings": Shape(150, 2, 3, form="rings"), "spiral_arms": Shape(150, 2, 3, form="spirals"), "gaussian_islands": Shape(200, 3, 4),
    "plant_growth": Shape(200, 3, 0), "housing_mini": Shape(200, 4, 0), "energy_efficiency": Shape(200, 3, 0), "crop_yield": Shape(200, 3, 0), "customer_segments": Shape(200, 3, 4),
    "sensor_states": Shape(180, 6, 3), "student_performance": Shape(150, 3, 3), "traffic_conditions": Shape(150, 3, 3), "fitness_scores": Shape(100, 3, 0, 3),
    "weather_outcomes": Shape(150, 3, 0, 2), "perfectly_separable": Shape(100, 4, 2),
}


def _plane(form: str, label: Column, classes: int) -> list[Column]:
    t, r = uniform(11), label + 1.0
    if form == "rings":
        return [r * F.cos(t * (2 * math.pi)) + normal(12, 0, 0.05), r * F.sin(t * (2 * math.pi)) + normal(13, 0, 0.05)]
    if form == "spirals":
        angle = t * (3 * math.pi) + label * (2 * math.pi / classes)
        return [t * F.cos(angle) + normal(12, 0, 0.02), t * F.sin(angle) + normal(13, 0, 0.02)]
    return [F.cos(t * math.pi) + label + normal(12, 0, 0.05), F.sin(t * math.pi) * F.when(label % 2 == 0, 1.0).otherwise(-1.0) + normal(13, 0, 0.05)]


def load(spark: SparkSession, name: str) -> DataFrame:
    """id, x0, x1, ... and label, or y (y0, y1, ... where there are several)."""
    if name not in SETS:
        raise InvalidParameterError(f"no data set {name!r}", "name", name)
    s = SETS[name]
    seed = sum(map(ord, name))
    if not s.classes:
        x = [normal(seed * 31 + j) for j in range(s.features)]
        rows = spark.range(s.rows).select("id", *(c.alias(f"x{j}") for j, c in enumerate(x)))
        weights = lambda k: [((j + k) % 3 + 1) * (-1) ** (j * k) for j in range(s.features)]
        y = [sum((F.col(f"x{j}") * float(w) for j, w in enumerate(weights(k))), F.lit(0.0)) + normal(seed * 31 + 80 + k, 0, 0.2) for k in range(s.targets)]
        return rows.withColumns({"y" if s.targets == 1 else f"y{k}": c for k, c in enumerate(y)})
    label = F.pmod("id", F.lit(s.classes)).cast("int")
    if s.form != "clouds":
        x = _plane(s.form, label, s.classes)
    else:
        gap = 12.0 if name == "perfectly_separable" else 3.0
        x = [normal(seed * 31 + j) + F.pmod(label * (j + 1), F.lit(s.classes)) * gap for j in range(s.features)]
    return spark.range(s.rows).select("id", *(c.alias(f"x{j}") for j, c in enumerate(x)), label.alias("label"))
