"""Edge tables from files, and graphs to files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ADVICE, ASPECT, EDGES, RECORD
from .storage import new_path


#: Parts that every executor holds to meet the lines; more are dealt out by key, where lines pass a hash map and aren't sorted.
BROADCAST_PARTS = 100_000


def read_assignment(spark: SparkSession, *paths: str) -> DataFrame:
    """Edges from script files that assign an array literal of records to a name, as `name = [ {...}, ... ]`.

    Several files are one dataset in the order given; seq counts through all of them. A file without such an array raises an error
    when it is read, and so does a missing path. A file is read as one value, as it is a single literal: large datasets belong into parquet.
    """
    parts = None
    for place, path in enumerate(paths):
        text = spark.read.text(path, wholetext=True)
        body = F.regexp_replace("value", r"^[\s\x{FEFF}]*(?:(?:var|let|const)\s+)?[A-Za-z_$][\w$.]*\s*=\s*|\s*;?\s*$", "")
        rows = F.from_json(body, T.ArrayType(RECORD), {"mode": "FAILFAST"})
        part = text.select(F.lit(place).alias("file"), F.posexplode(rows).alias("at", "record"))
        parts = part if parts is None else parts.union(part)
    if parts is None:
        raise ValueError("no path to read edges from")
    # Rows of a file are counted to know where the next one starts: one row for each file.
    sizes = {r.file: r.n for r in parts.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()} if len(paths) > 1 else {}
    start, starts = 0, []
    for place in range(len(paths)):
        starts.append(start)
        start += sizes.get(place, 0)
    base = F.element_at(F.array(*(F.lit(s).cast("long") for s in starts)), F.col("file") + 1)
    return parts.select((base + F.col("at")).cast("long").alias("seq"), "record.*")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Edges that were written as parquet, with the schema of edges; partitioning by type is read as a column."""
    return spark.read.schema(EDGES).parquet(path).select(*EDGES.names)


def edges_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge view over orders: the parts of an order's consecutive lines follow each other. The last line of an order has no target. seq numbers the lines from 0 by
    order, line, part and supplier, whatever their values."""
    return _stored_edges(spark, sf_dir)(spark)


def _stored_edges(spark: SparkSession, sf_dir: str) -> Callable[[SparkSession], DataFrame]:
    """Stores the view by type, in order of seq inside each file, so that a query reads the kinds that it asks for, and returns what reads it.

    Labels are made after the shuffle and the window, from the columns of the part, so rows are narrow there; each task sorts a range of bounded size.
    """
    from ..operators.numbering import number_ranges, range_count

    inside = ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", *inside, "l_linestatus")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type")
    part = F.broadcast(part) if part.count() <= BROADCAST_PARTS else part.hint("shuffle_hash")
    one = line.join(part, line.l_partkey == part.p_partkey).drop("p_partkey")
    # Ranges of orders: the window needs no other shuffle, and its sort is that of the numbering.
    ranged = one.repartitionByRange(range_count(spark, line.count()), "l_orderkey").sortWithinPartitions("l_orderkey", *inside)
    follow = Window.partitionBy("l_orderkey").orderBy(*inside)
    ends = ranged.withColumns({f"{c}2": F.lead(c).over(follow) for c in ("p_name", "p_brand", "p_type")})
    text = lambda n: F.concat(f"p_name{n}", F.lit(" / "), f"p_brand{n}")
    text_en = lambda n: F.concat(F.upper(f"p_name{n}"), F.lit(" ("), f"p_type{n}", F.lit(")"))
    edges = ends.select(
        F.col("p_name").alias("node1_id"),
        F.col("p_name2").alias("node2_id"),
        text("").alias("node1_text"),
        text("2").alias("node2_text"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string"), F.lit(" line "), F.col("l_linenumber").cast("string")).alias("proof"),
        F.col("l_linenumber").cast("int").alias("reference"),
        F.when(F.col("l_returnflag") == "R", ADVICE).when(F.col("l_returnflag") == "A", ASPECT).otherwise("other").alias("type"),
        F.lit(None).cast("int").alias("is_good"),
        F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1), 1).alias("is_bad"),
        text_en("").alias("node1_text_en"),
        text_en("2").alias("node2_text_en"),
    )
    read = number_ranges(edges, "seq", by="type")
    return lambda spark: read(spark).select(*EDGES.names)


#: Of each application and folder of tables, what reads its edge table.
_written: dict[tuple[str, str], Callable[[SparkSession], DataFrame]] = {}


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges as parquet by type, in order of seq inside each file, so that a query reads the kinds that it asks for."""
    edges.sortWithinPartitions("type", "seq").write.partitionBy("type").parquet(path)


def edge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of edges_from_tables() as a stored table, by type. It is written once for an application, in the shared folder; queries are scans of it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        _written[key] = _stored_edges(spark, sf_dir)
    return _written[key](spark)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str, form: str = "parquet") -> None:
    """A result graph as two tables, nodes and edges, in folder; form is any file format that Spark writes. What was there is replaced."""
    nodes.write.mode("overwrite").format(form).save(f"{folder}/nodes")
    edges.write.mode("overwrite").format(form).save(f"{folder}/edges")
