"""Edge-list and Pajek text as DataFrames of edges and nodes.

Input is (pos, line): a line and its place in its text. Parsing is a filter, a few regular expressions and one
aggregation per label; ids come from ``dense_index``, so that no window sees the whole text. Lines of a file that
Spark splits get their place from ``read_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.storage import dense_index, stored

# The white space of the text formats (ECMAScript's \s), for Java's regular expressions.
SPACES = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
LARGEST_ID = 4294967295


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of text files, split among tasks: pos numbers the lines by file, then by place.

    A split's place in its file orders the splits, and the reader's order the lines of one.
    """
    text = spark.read.text(path, lineSep="\n").select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__no"))
    return dense_index(stored(text, "lines"), ["__file", "__at", "__no"], "pos").select("pos", "line")


def tokens(line: str | Column) -> Column:
    line = F.col(line) if isinstance(line, str) else line
    return F.split(F.regexp_replace(line, f"^[{SPACES}]+|[{SPACES}]+$", ""), f"[{SPACES}]+")


def js_number(text: Column) -> Column:
    """A decimal number, else NaN."""
    plain = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    hexa = text.rlike("^0[xX][0-9a-fA-F]{1,15}$")
    endless = text.rlike(r"^[+-]?Infinity$")
    value = F.when(hexa, F.conv(F.substring(text, 3, 64), 16, 10).cast("double")).when(plain | endless, text.try_cast("double"))
    return F.coalesce(value, F.lit(float("nan")))


def parse_edge_list(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes): edges (edge_id, source, target, weight), nodes (id, label, ext_id).

    Blank and # lines are skipped; the third column is the weight (1 if missing, NaN if no number), more are
    ignored. Labels are numbered in order of first sight, sources before targets. ext_id is the label as a number
    if every label is a plain integer up to 2**32 - 1, else null. A line of one column raises with its number.
    """
    rows = lines.withColumn("t", tokens("line")).filter((F.element_at("t", 1) != "") & ~F.element_at("t", 1).startswith("#"))
    bad = F.raise_error(F.concat(F.lit("line "), (F.col("pos") + 1).cast("string"), F.lit(': expected at least two columns, got "'), F.element_at("t", 1), F.lit('"'))).cast("string")
    weight = F.when(F.size("t") > 2, js_number(F.try_element_at("t", F.lit(3)))).otherwise(F.lit(1.0))
    rows = stored(rows.select("pos", F.element_at("t", 1).alias("s"), F.when(F.size("t") < 2, bad).otherwise(F.try_element_at("t", F.lit(2))).alias("d"), weight.alias("weight")), "edge-list")
    seen = rows.select(F.explode(F.array(F.struct((2 * F.col("pos")).alias("seq"), F.col("s").alias("label")), F.struct((2 * F.col("pos") + 1).alias("seq"), F.col("d").alias("label")))).alias("e")).groupBy("e.label").agg(F.min("e.seq").alias("seq"))
    nodes = stored(dense_index(seen, ["seq"], "id").select("id", "label"), "labels")
    plain = F.col("label").rlike("^(0|[1-9][0-9]{0,9})$") & (F.coalesce(F.col("label").try_cast("long"), F.lit(-1)) <= LARGEST_ID)
    all_plain = nodes.agg(F.min(plain).alias("ok")).first()["ok"]
    nodes = nodes.withColumn("ext_id", F.col("label").try_cast("long") if all_plain else F.lit(None).cast("long"))
    ends = lambda c, out: nodes.select(F.col("label").alias(c), F.col("id").alias(out))
    edges = dense_index(rows, ["pos"], "edge_id").join(ends("s", "source"), "s").join(ends("d", "target"), "d").select("edge_id", "source", "target", "weight")
    return edges, nodes


def parse_pajek(lines: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(edges, nodes, directed) of a Pajek text: sections vertices, arcs, edges, arcslist, edgeslist.

    Lines of other sections and comments (% or #) are skipped. Nodes are the ids of vertex lines and links,
    numbered by ascending id; the last label and the last finite coordinates win; an arcs section makes it directed.
    The section in force is found by an equality join: section starts are few, each gets the range of lines to the
    next, and lines look their range up by a running count.
    """
    clean = lines.withColumn("t", tokens("line")).filter((F.element_at("t", 1) != "") & ~F.substring(F.element_at("t", 1), 1, 1).isin("%", "#"))
    head = F.substring(F.element_at("t", 1), 1, 1) == "*"
    clean = stored(clean.withColumn("section", F.when(head, F.lower(F.substring(F.element_at("t", 1), 2, 64)))), "pajek")
    starts = [(r["pos"], r["section"]) for r in clean.filter(head).select("pos", "section").orderBy("pos").collect()]  # a row a section
    section = F.lit("")
    for pos, name in starts:
        section = F.when(F.col("pos") > pos, name).otherwise(section)
    body = clean.filter(~head).withColumn("section", section)
    number = lambda c: F.when(c.rlike(r"^\+?[0-9]{1,10}$") & (c.try_cast("long") <= LARGEST_ID), c.try_cast("long"))
    quoted = F.regexp_extract("line", r'^[^"]*"([^"]*)"(.*)$', 1)
    has_quote = F.col("line").rlike(r'^[^"]*"[^"]*"')
    after = F.when(has_quote, tokens(F.regexp_extract("line", r'^[^"]*"[^"]*"(.*)$', 1))).otherwise(F.slice("t", F.lit(3), F.greatest(F.size("t") - 2, F.lit(0))))
    xy = lambda k: F.try_element_at(after, F.lit(k)).try_cast("double")
    vertices = body.filter("section = 'vertices'").select("pos", number(F.element_at("t", 1)).alias("ext_id"), F.when(has_quote, quoted).otherwise(F.try_element_at("t", F.lit(2))).alias("label"), xy(1).alias("x"), xy(2).alias("y"))
    pair = body.filter(F.col("section").isin("arcs", "edges") & (F.size("t") >= 2)).select("pos", F.lit(0).alias("k"), number(F.element_at("t", 1)).alias("s"), number(F.element_at("t", 2)).alias("d"), F.when(F.size("t") > 2, js_number(F.try_element_at("t", F.lit(3)))).otherwise(F.lit(1.0)).alias("weight"))
    lists = body.filter(F.col("section").isin("arcslist", "edgeslist") & (F.size("t") >= 2)).select("pos", number(F.element_at("t", 1)).alias("s"), F.posexplode(F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0)))).alias("k", "d")).select("pos", "k", "s", number(F.col("d")).alias("d"), F.lit(1.0).alias("weight"))
    links = stored(pair.unionByName(lists), "pajek-links")
    wrong = links.filter("s is null or d is null").agg(F.min("pos")).first()[0]
    if wrong is not None:
        raise ValueError(f"line {wrong + 1}: vertex ids must be integers up to {LARGEST_ID}")
    finite = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    known = vertices.groupBy("ext_id").agg(F.max_by("label", F.when(F.col("label").isNotNull(), F.col("pos"))).alias("label"), F.max_by(F.struct("x", "y"), F.when(finite, F.col("pos"))).alias("at"))
    ids = vertices.select("ext_id").union(links.select("s")).union(links.select("d")).distinct()
    nodes = stored(dense_index(ids, ["ext_id"], "id").join(known, "ext_id", "left").select("id", "ext_id", F.coalesce("label", F.col("ext_id").cast("string")).alias("label"), "at.x", "at.y"), "pajek-nodes")
    ends = lambda c, out: nodes.select(F.col("ext_id").alias(c), F.col("id").alias(out))
    edges = dense_index(links, ["pos", "k"], "edge_id").join(ends("s", "source"), "s").join(ends("d", "target"), "d").select("edge_id", "source", "target", "weight")
    return edges, nodes, any(name in ("arcs", "arcslist") for _, name in starts)


def detect_format(text: str, filename: str = "") -> str:
    """"pajek" or "edges", by the file's name, else by a section header."""
    import re

    name = filename.lower()
    if name.endswith(".net"):
        return "pajek"
    if name.endswith((".edge", ".edges", ".tsv", ".csv", ".txt")):
        return "edges"
    return "pajek" if re.search(r"^\s*\*(vertices|arcs|edges)", text, re.I | re.M) else "edges"


def parse_network(lines: DataFrame, filename: str = "") -> tuple[DataFrame, DataFrame, bool]:
    """Either format; an edge list is undirected."""
    found = lines.filter(F.col("line").rlike(r"(?i)^\s*\*(vertices|arcs|edges)")).orderBy("pos").limit(1).select("line").collect()
    if detect_format(found[0][0] if found else "", filename) == "pajek":
        return parse_pajek(lines)
    edges, nodes = parse_edge_list(lines)
    return edges, nodes, False

