"""SVG text from tables: paths, circles, labels, and documents as a table of lines.

Each element is a Column expression over its row, so that a layer of any size is a projection; a document is the
lines of its layers between a head and a foot, in order of (part, ord). Styles are taken as they are; label text is
escaped. An element without a shape gives null and no line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.view import View


def number(v: Column) -> Column:
    """A coordinate: six decimals at most, none where it is whole."""
    text = F.regexp_replace(F.format_string("%.6f", v.cast("double")), r"\.?0+$", "")
    return F.when(v.isNotNull(), F.when(text == "-0", "0").otherwise(text))


def escaped(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.format_string("rgba(%d, %d, %d, %.4f)", r.cast("int"), g.cast("int"), b.cast("int"), a.cast("double") / 255)


def path_d(points: Column, closed: Column | bool = False) -> Column:
    """The d attribute of a path through an array of [x, y]; null under two points."""
    step = F.transform(points, lambda p, i: F.concat(F.when(i == 0, "M").otherwise("L"), number(p[0]), F.lit(","), number(p[1])))
    end = closed if isinstance(closed, Column) else F.lit(closed)
    return F.when(F.size(points) > 1, F.concat(F.array_join(step, ""), F.when(end, "Z").otherwise("")))


def path(d: Column, fill: Column | None = None, stroke: Column | None = None, stroke_width: Column | None = None) -> Column:
    """A path element; its fill is "none" where only a stroke is given, and black without either."""
    none = F.lit(None).cast("string")
    fill, stroke = fill if fill is not None else none, stroke if stroke is not None else none
    parts = [F.lit('<path d="'), d, F.lit('" fill="'), F.coalesce(fill, F.when(stroke.isNotNull(), "none").otherwise("#000")), F.lit('"')]
    parts.append(F.coalesce(F.concat(F.lit(' stroke="'), stroke, F.lit('"')), F.lit("")))
    if stroke_width is not None:
        parts.append(F.coalesce(F.concat(F.lit(' stroke-width="'), number(stroke_width), F.lit('"')), F.lit("")))
    return F.when(F.length(d) > 0, F.concat(*parts, F.lit(" />")))


def circle(x: Column, y: Column, r: Column, fill: Column) -> Column:
    return F.concat(F.lit('<circle cx="'), number(x), F.lit('" cy="'), number(y), F.lit('" r="'), number(r), F.lit('" fill="'), fill, F.lit('" />'))


def label(x: Column, y: Column, text: Column, align: Column, font: Column, color: Column, rotation: Column | None = None) -> Column:
    """A text element at an anchor in screen pixels; a rotation (radians) turns it about the anchor."""
    side = F.when(align.isin("middle", "end"), align).otherwise("start")
    turned = F.lit("")
    if rotation is not None:
        degrees = F.concat(F.lit(' transform="rotate('), number(F.round(F.degrees(rotation), 3)), F.lit(" "), number(x), F.lit(" "), number(y), F.lit(')"'))
        turned = F.when(F.coalesce(rotation, F.lit(0.0)) != 0, degrees).otherwise("")
    return F.concat(
        F.lit('<text x="'), number(x), F.lit('" y="'), number(y), F.lit('" text-anchor="'), side, F.lit('" dominant-baseline="central"'), turned,
        F.lit(' style="font:'), F.coalesce(font, F.lit("12px sans-serif")), F.lit('" fill="'), F.coalesce(color, F.lit("#000")), F.lit('">'), escaped(text), F.lit("</text>"),
    )


def world_transform(view: View) -> str:
    return f"translate({view.x:g}, {view.y:g}) scale({view.k:g})"


def document(view: View, world: list[DataFrame], screen: list[DataFrame] = (), labels: DataFrame | None = None, clips: DataFrame | None = None) -> DataFrame:
    """(part, ord, value): an SVG document's lines.

    ``world`` layers (ord, value) lie in one group under the view's transform, so that a pan changes one line;
    ``screen`` layers have constant size, their coordinates being pixels; ``clips`` (ord, value) go into defs.
    """
    spark = world[0].sparkSession
    size = f'width="{view.width:g}" height="{view.height:g}" viewBox="0 0 {view.width:g} {view.height:g}"'
    fixed = [(0, f'<svg xmlns="http://www.w3.org/2000/svg" {size}><defs>'), (2, f'</defs><g transform="{world_transform(view)}">'), (100, "</g>"), (300, "</svg>")]
    out = spark.createDataFrame([(p, 0, v) for p, v in fixed], "part int, ord long, value string")
    layers = [(1, clips)] * (clips is not None) + [(3 + k, d) for k, d in enumerate(world)] + [(101 + k, d) for k, d in enumerate(screen)] + [(200, labels)] * (labels is not None)
    for part, rows in layers:
        out = out.unionByName(rows.select(F.lit(part).alias("part"), F.col("ord").cast("long").alias("ord"), "value").filter("value is not null"))
    return out


def write_document(lines: DataFrame, folder: str) -> None:
    """Write a document's lines in order, as text files whose names are in order too."""
    lines.repartitionByRange("part", "ord").sortWithinPartitions("part", "ord").select("value").write.mode("overwrite").text(folder)
