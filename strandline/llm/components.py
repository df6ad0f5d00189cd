"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.scratch import discard, keep


def _jumped(parent: DataFrame) -> DataFrame:
    """(node, label) with every chain node -> label -> ... followed to its end.

    Each round doubles the distance followed.
    """
    while True:
        above = parent.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        further = keep(
            parent.join(above, "label", "left").select("node", F.coalesce("higher", "label").alias("label"), (F.col("higher").isNotNull()).alias("moved")),
            "parents",
        )
        discard(parent)
        parent = further
        if parent.filter("moved").isEmpty():
            return parent


def _across(links: DataFrame, label: DataFrame | None) -> DataFrame:
    """The links between the classes of ``label``, smaller end first."""
    for end in ("a", "b") if label is not None else ():
        root = label.select(F.col("node").alias(end), F.col("label").alias("root"))
        links = links.join(root, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    return links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def merged(links: DataFrame, label: DataFrame | None = None) -> DataFrame:
    """(node, label) of every node that does not name its class, once the links (a, b) are
    added to the classes of ``label``, an earlier result (None: every node is alone).

    Only links between classes are looked at.  Each round hooks every class to its
    smallest neighbour, follows the hooks to their end and renames the links; links
    inside a class go.  At least half of the classes that still have links are hooked in
    a round.  A class is named by one of its nodes.
    """
    edges, stored, given = _across(links, label), None, label
    if label is not None:
        edges = stored = keep(edges, "edges")
    while True:
        hooks = keep(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")), "hooks")
        pointers = _jumped(hooks)
        roots = pointers.select("node", "label")
        # what is hooked named its class until now, so it is no node of ``label``
        if label is None:
            label = keep(roots, "labels")
        else:
            up = roots.select(F.col("node").alias("label"), F.col("label").alias("higher"))
            moved = label.join(up, "label", "left").select("node", F.coalesce("higher", "label").alias("label"))
            further = keep(moved.unionByName(roots), "labels")
            discard(None if label is given else label)
            label = further
        fewer = keep(_across(edges, roots), "edges")
        discard(stored, pointers)
        edges = stored = fewer
        if edges.isEmpty():
            discard(edges)
            return label


def with_names(label: DataFrame) -> DataFrame:
    """``merged`` with the nodes that name a class of several: a row for each of its nodes."""
    names = label.select("label").distinct()
    return label.unionByName(names.select(F.col("label").alias("node"), "label"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of the links (a, b): label is a node of the component."""
    return with_names(merged(links))
