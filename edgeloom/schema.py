"""The edge table: one row for each labelled edge, in an explicit order."""

from __future__ import annotations

from pyspark.sql import types as T

#: The fields of an edge record, in their order.
RECORD = T.StructType(
    [
        T.StructField("node1_id", T.StringType()),
        T.StructField("node2_id", T.StringType()),
        T.StructField("node1_text", T.StringType()),
        T.StructField("node2_text", T.StringType()),
        T.StructField("proof", T.StringType()),
        T.StructField("reference", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("is_good", T.IntegerType()),
        T.StructField("is_bad", T.IntegerType()),
        T.StructField("node1_text_en", T.StringType()),
        T.StructField("node2_text_en", T.StringType()),
    ]
)
#: seq is the place of an edge in its dataset. A DataFrame has no order of its own, so whatever depends on order asks for seq.
EDGES = T.StructType([T.StructField("seq", T.LongType()), *RECORD.fields])

#: Edge kinds: advice leads from node1 to node2, an aspect holds both ways.
ADVICE, ASPECT = "eitza", "bechina"
