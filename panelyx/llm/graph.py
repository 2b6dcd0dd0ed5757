"""Connected components of a graph given as a table of links, by hooking, pointer jumping and contraction.

Links are pairs of ids (long). In each round every vertex hooks to its smallest neighbour (or stays, if it is smaller than
all), pointers jump until each vertex has the root of its tree, and the links are contracted: their ends become roots,
those within a tree and repeated ones vanish. A vertex that stays alone in a round has only smaller neighbours in the
next, so every two rounds at least halve the vertices, and links are read in full in the first round only. All is written to the shared folder after each step, so lineage stays short and a lost executor
costs one step. Nothing but counts reaches the driver, joins included: none is a broadcast. A vertex with very many links
is no single task's burden: minima are aggregated before the shuffle, and the joins can be split by the adaptive planner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shuffled


def oriented(links: DataFrame) -> DataFrame:
    """(a, b), a < b, each once, without null ends and loops; written."""
    e = links.filter("a is not null and b is not null and a <> b")
    return materialise(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")


def hooked(e: DataFrame) -> DataFrame:
    """(v, root) for the vertices of e: root is the root of v's tree when all hook to the smallest they are linked to."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    trees = materialise(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("root")), "trees")
    while True:
        up = trees.select(F.col("v").alias("root"), F.col("root").alias("above"))
        new = trees.join(shuffled(up), "root").select("v", F.col("above").alias("root"), (F.col("above") < F.col("root")).alias("moved"))
        new = materialise(new, "trees")
        trees = new.select("v", "root")
        if new.filter("moved").isEmpty():
            return trees


def components(links: DataFrame) -> DataFrame:
    """links: (a, b). Returns (v, root) for each vertex that has a link: root is the smallest id it can reach.

    Null ends and loops are ignored; repeated links do no harm.
    """
    e = oriented(links)
    state = None
    while not e.isEmpty():
        trees = hooked(e)
        if state is None:
            state = trees
        else:
            up = trees.select(F.col("v").alias("root"), F.col("root").alias("above"))
            state = materialise(state.join(shuffled(up), "root", "left").select("v", F.coalesce("above", "root").alias("root")), "roots")
        for end in ("a", "b"):
            e = e.join(shuffled(trees.select(F.col("v").alias(end), F.col("root").alias(f"{end}_"))), end)
        e = oriented(e.select(F.col("a_").alias("a"), F.col("b_").alias("b")))
    return state if state is not None else e.select(F.col("a").alias("v"), F.col("b").alias("root"))
