"""Analysis templates (C6-C10): keyword rules -> chart configurations.

A template is a rule table (chart, include words, extra include word,
exclude words, limit). Rules are matched against each flight's columns in
column order, the first ``limit`` names kept per chart with a group-limited
``row_number``; a chart with no name is dropped and the rest are numbered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolytics.functions.text import ELAPSED_COLUMN
from aerolytics.operators.select import contains_any

# The four templates. Each chart: title, words (any), a second
# word list that must also match (or None), words that must not match,
# limit, y-axis label, colour scheme.
FORCE_WORDS = ["force", "strain", "load"]
TEMPLATES = {
    "control_surfaces": [
        ("Aileron Control", ["aileron"], None, [], 3, "Deflection (deg)", "blues"),
        ("Elevator Control", ["elevator"], None, [], 3, "Deflection (deg)", "reds"),
        ("Rudder Control", ["rudder"], None, [], 3, "Deflection (deg)", "greens"),
        ("Flap Position", ["flap"], None, [], 3, "Position (deg)", "purples"),
    ],
    "flight_angles": [
        ("Angle of Attack", ["alpha", "angle of attack", "aoa"], None, [], 2, "Angle (deg)", "viridis"),
        ("Sideslip Angle", ["beta", "sideslip", "betha"], None, [], 2, "Angle (deg)", "plasma"),
    ],
    "forces": [
        ("Longitudinal Forces", FORCE_WORDS, ["longitudinal"], [], 3, "Force (kg)", "blues"),
        ("Lateral Forces", FORCE_WORDS, ["lateral"], [], 3, "Force (kg)", "reds"),
        ("Other Forces", FORCE_WORDS, None, ["longitudinal", "lateral"], 3, "Force (kg)", "greens"),
    ],
    "comprehensive": [
        ("Control Surfaces Overview", ["aileron", "elevator", "rudder"], None, [], 4, "Deflection (deg)",
         "viridis"),
        ("Flight Angles", ["alpha", "beta", "angle"], None, [], 3, "Angle (deg)", "plasma"),
        ("Force Measurements", ["force", "strain"], None, [], 3, "Force (kg)", "inferno"),
        ("Trim Settings", ["trim"], None, [], 3, "Trim (deg)", "cividis"),
    ],
}
TEMPLATE_NAMES = list(TEMPLATES)
CHART_ID_PREFIX = "template_chart_"


def template_charts(params: DataFrame, template: str | None = None) -> DataFrame:
    """Chart configurations per flight: (flight_id, template, chart_id, title,
    type, parameters, x_axis, y_axis_label, color_scheme).

    ``params`` = (flight_id, parameter, position) over all columns (the
    timestamp and elapsed included, as the reference scans every column).
    ``template=None`` builds all four; an unknown name gives no rows (C10).
    """
    names = TEMPLATE_NAMES if template is None else [template]
    parts = []
    for t in names:
        for no, (title, words, also, exclude, limit, ylab, color) in enumerate(TEMPLATES.get(t, [])):
            cond = contains_any(F.col("parameter"), words)
            if also:
                cond = cond & contains_any(F.col("parameter"), also)
            if exclude:
                cond = cond & ~contains_any(F.col("parameter"), exclude)
            parts.append(params.filter(cond).select(
                "flight_id", "parameter", "position", F.lit(t).alias("template"), F.lit(no).alias("chart_no"),
                F.lit(title).alias("title"), F.lit(limit).alias("limit"), F.lit(ylab).alias("y_axis_label"),
                F.lit(color).alias("color_scheme")))
    if not parts:
        return params.sparkSession.createDataFrame(
            [], "flight_id string, template string, chart_id string, title string, type string, "
                "parameters array<string>, x_axis string, y_axis_label string, color_scheme string")
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    w = Window.partitionBy("flight_id", "template", "chart_no").orderBy("position")
    top = u.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= F.col("limit"))
    charts = top.groupBy("flight_id", "template", "chart_no", "title", "y_axis_label", "color_scheme").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "parameter"))),
                    lambda x: x["parameter"]).alias("parameters"))
    wn = Window.partitionBy("flight_id", "template").orderBy("chart_no")
    return charts.select(
        "flight_id", "template",
        F.concat(F.lit(CHART_ID_PREFIX), (F.row_number().over(wn) - 1).cast("string")).alias("chart_id"),
        "title", F.lit("line").alias("type"), "parameters", F.lit(ELAPSED_COLUMN).alias("x_axis"),
        "y_axis_label", "color_scheme")
