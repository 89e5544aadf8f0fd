"""Text formats: point files, typed sequences, graphs and meshes, read and written in parallel.

Readers number lines or tokens with one count for each split; only the header reaches the
driver. A token that is no number where one should be becomes null. Writers sort by position, so part files on end are the file;
``files`` sets how many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.sources.shared import settled

# The headers of sequence files and the types of their elements.
SEQUENCES = {
    "sequenceInt": "int",
    "sequenceLong": "bigint",
    "sequenceUInt": "bigint",
    "sequenceDouble": "double",
    "sequenceChar": "string",
    "sequenceIntPair": "struct<a:int,b:int>",
    "sequenceUIntPair": "struct<a:bigint,b:bigint>",
    "sequenceDoublePair": "struct<a:double,b:double>",
}
POINTS = {2: "pbbs_sequencePoint2d", 3: "pbbs_sequencePoint3d"}
TRIANGLES = "pbbs_triangles"
GRAPH, WEIGHTED_GRAPH, EDGES, WEIGHTED_EDGES = "AdjacencyGraph", "WeightedAdjacencyGraph", "EdgeArray", "WeightedEdgeArray"


def with_row_index(df: DataFrame, name: str = "id") -> DataFrame:
    """Rows numbered from 0 in their present order: partition counts, and places inside."""
    mid = F.monotonically_increasing_id()
    # Written first: both branches below read the same numbers, whatever becomes of an executor.
    marked = settled(df.withColumn("__part", F.shiftright(mid, 33)).withColumn("__at", mid.bitwiseAND(F.lit((1 << 33) - 1))), "row-index")
    sizes = marked.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")).alias("__before"))
    return marked.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows of text files numbered from 0 in the order of file names and of places in a file.

    Spark deals files to tasks by size, so the order of tasks isn't that of the file: splits
    are put in order by name and start, and a row by its place in its split.
    """
    split = F.struct(F.col("__file.file_path").alias("path"), F.col("__file.file_block_start").alias("start"))
    marked = rows.withColumn("__mid", F.monotonically_increasing_id()).withColumn("__split", split).drop("__file")
    sizes = marked.groupBy("__split").agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__split").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")).drop("__n")
    return marked.join(F.broadcast(before), "__split").withColumn(name, F.col("__before") + F.col("__mid") - F.col("__first")).drop("__split", "__mid", "__first", "__before")


def _text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata").alias("__file"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in order: (line, n); blank ones don't count."""
    return _numbered(_text(spark, path).where(F.trim("value") != ""), "n").select(F.trim("value").alias("line"), "n")


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """(pos, token) of a file split at white space and NUL, numbered from 0."""
    split = _text(spark, path).select("__file", F.explode(F.split(F.trim(F.regexp_replace("value", "[\\s\\x00]+", " ")), " ")).alias("token")).where("token <> ''")
    return _numbered(split, "pos").select("pos", "token")


def read_points(spark: SparkSession, path: str, kind: str = "double", dims: int | None = None) -> DataFrame:
    """A file with the header ``N D`` and N lines of D numbers: id from 0, c0 ...

    ``dims`` keeps the first dimensions only.
    """
    lines = _lines(spark, path)
    n, dim = (int(x) for x in lines.where("n = 0").first().line.split())
    parts = F.split("line", "\\s+")
    keep = min(dims or dim, dim)
    return lines.where((F.col("n") >= 1) & (F.col("n") <= n)).select((F.col("n") - 1).alias("id"), *[parts[i].try_cast(kind).alias(f"c{i}") for i in range(keep)])


def grouped_points(toks: DataFrame, dim: int, kind: str = "double", first: int = 0) -> DataFrame:
    """Every ``dim`` tokens from position ``first`` as a point."""
    at = toks.where(F.col("pos") >= first).select(((F.col("pos") - first) / dim).cast("long").alias("id"), ((F.col("pos") - first) % dim).alias("i"), F.col("token").try_cast(kind).alias("x"))
    return at.groupBy("id").agg(*[F.max(F.when(F.col("i") == i, F.col("x"))).alias(f"c{i}") for i in range(dim)])


def _expect(toks: DataFrame, allowed: set[str]) -> str:
    header = toks.where("pos = 0").first()
    if header is None or header.token not in allowed:
        raise ValueError(f"the header is {header.token if header else 'missing'}, not one of {sorted(allowed)}")
    return header.token


def read_pbbs_points(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    toks = tokens(spark, path)
    found = _expect(toks, set(POINTS.values()))
    return grouped_points(toks, next(d for d, x in POINTS.items() if x == found), kind, 1)


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """(id, value); pairs are structs (a, b)."""
    toks = tokens(spark, path)
    kind = SEQUENCES[_expect(toks, set(SEQUENCES))]
    if not kind.startswith("struct"):
        return toks.where("pos > 0").select((F.col("pos") - 1).alias("id"), F.col("token").try_cast(kind).alias("value"))
    pairs = grouped_points(toks, 2, "string", 1)
    a, b = (x.split(":")[1].rstrip(">") for x in kind[7:].split(","))
    return pairs.select("id", F.struct(F.col("c0").try_cast(a).alias("a"), F.col("c1").try_cast(b).alias("b")).alias("value"))


def read_triangles(spark: SparkSession, path: str, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(points: id, c0 .., triangles: tri, a, b, c); indices are lowered by ``offset``."""
    toks = tokens(spark, path)
    _expect(toks, {TRIANGLES})
    n, m = (int(r.token) for r in toks.where("pos IN (1, 2)").orderBy("pos").collect())
    rest = toks.count() - 3 - 3 * m
    if n and rest % n or n and rest // n not in (2, 3):
        raise ValueError("the file's length doesn't match its counts")
    dim = rest // n if n else 2
    points = grouped_points(toks.where(F.col("pos") < 3 + n * dim), dim, "double", 3)
    corners = grouped_points(toks, 3, "bigint", 3 + n * dim)
    return points, corners.select(F.col("id").alias("tri"), *[(F.col(f"c{i}") - offset).alias(x) for i, x in enumerate("abc")])


def read_graph(spark: SparkSession, path: str, weights: str = "double") -> DataFrame:
    """(src, dst[, w]) of a CSR file, weighted or not."""
    toks = tokens(spark, path)
    weighted = _expect(toks, {GRAPH, WEIGHTED_GRAPH}) == WEIGHTED_GRAPH
    n, m = (int(r.token) for r in toks.where("pos IN (1, 2)").orderBy("pos").collect())
    value = F.col("token").try_cast("long")
    starts = toks.where(F.col("pos").between(3, 2 + n)).select((F.col("pos") - 3).alias("src"), value.alias("start"))
    ends = starts.select((F.col("src") - 1).alias("src"), F.col("start").alias("end"))
    spans = starts.join(ends, "src", "left").withColumn("end", F.coalesce("end", F.lit(m))).where("end > start")
    of = spans.select("src", F.explode(F.sequence("start", F.col("end") - 1)).alias("e"))
    targets = toks.where(F.col("pos").between(3 + n, 2 + n + m)).select((F.col("pos") - 3 - n).alias("e"), value.alias("dst"))
    edges = of.join(targets, "e")
    if weighted:
        edges = edges.join(toks.where(F.col("pos") >= 3 + n + m).select((F.col("pos") - 3 - n - m).alias("e"), F.col("token").try_cast(weights).alias("w")), "e")
    return edges.drop("e")


def read_edges(spark: SparkSession, path: str, weights: str = "double") -> DataFrame:
    """(src, dst[, w]) of an edge list."""
    toks = tokens(spark, path)
    weighted = _expect(toks, {EDGES, WEIGHTED_EDGES}) == WEIGHTED_EDGES
    rows = grouped_points(toks, 3 if weighted else 2, "string", 1)
    return rows.select(F.col("c0").cast("long").alias("src"), F.col("c1").cast("long").alias("dst"), *([F.col("c2").try_cast(weights).alias("w")] if weighted else []))


# ---------------------------------------------------------------- writers


def write_lines(lines: DataFrame, path: str, files: int = 1) -> None:
    """lines: place, line; written in the order of place."""
    lines.repartitionByRange(files, "place").sortWithinPartitions("place").select("line").write.text(path)


def _headed(spark: SparkSession, header: list[str], lines: DataFrame) -> DataFrame:
    return spark.createDataFrame([(k - len(header), x) for k, x in enumerate(header)], "place long, line string").unionByName(lines.select(F.col("place").cast("long"), "line"))


def point_line(dim: int):
    return F.concat_ws(" ", *[F.col(f"c{i}").cast("string") for i in range(dim)])


def write_points(points: DataFrame, path: str, dim: int, files: int = 1, header: str | None = None) -> None:
    """``N D`` and a line for each point, by id."""
    header = header or f"{points.count()} {dim}"
    write_lines(_headed(points.sparkSession, [header], points.select(F.col("id").alias("place"), point_line(dim).alias("line"))), path, files)


def write_pbbs_points(points: DataFrame, path: str, dim: int, files: int = 1) -> None:
    write_points(points, path, dim, files, POINTS[dim])


def write_triangles(points: DataFrame, triangles: DataFrame, path: str, dim: int = 2, files: int = 1) -> None:
    n, m = points.count(), triangles.count()
    p = points.select(F.col("id").alias("place"), point_line(dim).alias("line"))
    t = triangles.select((F.col("tri") + n).alias("place"), F.concat_ws(" ", *[F.col(x).cast("string") for x in "abc"]).alias("line"))
    write_lines(_headed(points.sparkSession, [TRIANGLES, str(n), str(m)], p.unionAll(t)), path, files)


def write_sequence(rows: DataFrame, path: str, header: str = "sequenceInt", files: int = 1) -> None:
    """rows: id, value (a number, a text or a struct of two)."""
    value = F.concat_ws(" ", F.col("value.a").cast("string"), F.col("value.b").cast("string")) if SEQUENCES[header].startswith("struct") else F.col("value").cast("string")
    write_lines(_headed(rows.sparkSession, [header], rows.select(F.col("id").alias("place"), value.alias("line"))), path, files)


def write_graph(edges: DataFrame, n: int, path: str, files: int = 1) -> None:
    """CSR: header, n, m, offsets, targets and, if the edges have them, weights."""
    from quadrille.operators.graphs import csr_offsets

    spark = edges.sparkSession
    weighted = "w" in edges.columns
    starts = csr_offsets(edges, spark.range(n).withColumnRenamed("id", "src"))
    place = Window.partitionBy("src").orderBy("dst", *(["w"] if weighted else []))
    ranked = edges.withColumn("k", F.row_number().over(place) - 1).join(starts, "src").withColumn("e", F.col("start") + F.col("k"))
    m = edges.count()
    lines = starts.select(F.col("src").alias("place"), F.col("start").cast("string").alias("line")).unionAll(ranked.select((F.col("e") + n).alias("place"), F.col("dst").cast("string").alias("line")))
    if weighted:
        lines = lines.unionAll(ranked.select((F.col("e") + n + m).alias("place"), F.col("w").cast("string").alias("line")))
    write_lines(_headed(spark, [WEIGHTED_GRAPH if weighted else GRAPH, str(n), str(m)], lines), path, files)


def write_edges(edges: DataFrame, path: str, files: int = 1) -> None:
    weighted = "w" in edges.columns
    numbered = with_row_index(edges.orderBy("src", "dst"), "place")
    line = F.concat_ws(" ", *[F.col(x).cast("string") for x in ("src", "dst", *(["w"] if weighted else []))])
    write_lines(_headed(edges.sparkSession, [WEIGHTED_EDGES if weighted else EDGES], numbered.select("place", line.alias("line"))), path, files)
