"""Stroke graphs: tables of nodes and edges out of the graph documents, degrees, spurs and angles; documents are parsed once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import written

GRAPH = "struct<sketch_id:string,nodes:array<struct<id:int,x:double,y:double,type:string>>,edges:array<struct<id:int,source:int,target:int,is_closed:boolean>>,_bad:string>"


class Graphs:
    """The graph documents of a folder listing; broken ones have no row."""

    def __init__(self, files: DataFrame):
        self.files = files

    @cached_property
    def documents(self) -> DataFrame:
        """``(file_no, nodes, edges)``, parsed once and written: what is asked of the graphs reads this table."""
        doc = F.from_json("body", GRAPH, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        good = self.files.where("kind = 'graph' and trim(body) <> ''").select("file_no", doc.alias("g")).where("g is not null and g._bad is null")
        return written(good.select("file_no", "g.nodes", "g.edges"), "graphs")

    def nodes(self) -> DataFrame:
        return self.documents.select("file_no", F.inline("nodes")).withColumnRenamed("id", "node")

    def edges(self) -> DataFrame:
        return self.documents.select("file_no", F.inline("edges")).withColumnRenamed("id", "edge")

    def ends(self) -> DataFrame:
        """Both ends ``(file_no, node, other)`` of every open edge; parallel edges count each."""
        pair = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("other"))
        return self.edges().where("not is_closed").select("file_no", F.inline(F.array(pair("source", "target"), pair("target", "source"))))

    def nodes_with_degree(self) -> DataFrame:
        """Nodes with the number of their open edge ends."""
        d = self.ends().groupBy("file_no", "node").agg(F.count("*").alias("degree"))
        return self.nodes().join(d, ["file_no", "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))

    def edges_with_length(self) -> DataFrame:
        """Edges with the straight length between their nodes and the degrees of these; edges to absent nodes have no row."""
        at = lambda s: self.nodes_with_degree().select("file_no", F.col("node").alias(s), F.col("x").alias(f"{s}_x"), F.col("y").alias(f"{s}_y"), F.col("degree").alias(f"{s}_degree"))
        both = self.edges().join(at("source"), ["file_no", "source"]).join(at("target"), ["file_no", "target"])
        return both.withColumn("length", F.hypot(F.col("source_x") - F.col("target_x"), F.col("source_y") - F.col("target_y")))

    def spurs(self, shortest: float, junction: int = 3) -> DataFrame:
        """Short edges between a loose end and a node of so many edges: what one round of pruning removes."""
        short = self.edges_with_length().where(~F.col("is_closed") & (F.col("length") < shortest))
        return short.where((F.least("source_degree", "target_degree") == 1) & (F.greatest("source_degree", "target_degree") >= junction))

    def used(self, edges: DataFrame) -> DataFrame:
        """Nodes that one of these edges ends at."""
        ends = edges.select("file_no", F.explode(F.array("source", "target")).alias("node"))
        return self.nodes().select("file_no", "node").join(ends, ["file_no", "node"], "left_semi")

    def through_angles(self) -> DataFrame:
        """Angle between the two edges at each node of degree two.

        Half the squared length of the sum of two unit vectors, less their own, is the cosine between them.
        """
        place = lambda n, p: self.nodes().select("file_no", F.col("node").alias(n), F.struct("x", "y").alias(p))
        own = self.ends().join(place("node", "a"), ["file_no", "node"]).join(place("other", "b"), ["file_no", "other"])
        dx, dy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
        unit = own.select("file_no", "node", F.try_divide(dx, F.hypot(dx, dy)).alias("dx"), F.try_divide(dy, F.hypot(dx, dy)).alias("dy"))
        dot = (F.sum("dx") * F.sum("dx") + F.sum("dy") * F.sum("dy") - F.sum(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))) / 2
        at = unit.groupBy("file_no", "node").agg(F.count("*").alias("degree"), dot.alias("dot")).where("degree = 2")
        return at.select("file_no", "node", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("dot"))))).alias("angle"))
