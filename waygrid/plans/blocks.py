"""Search over a grid by blocks: portals at the borders of blocks, walks inside blocks, and a search over portals alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waygrid.operators import raster
from waygrid.plans.paths import shortest_paths, shortest_paths_by_parts
from waygrid.plans.scratch import written


def _steps(cells: DataFrame, size: int) -> DataFrame:
    """``a, b, w, crosses`` between open cells that touch at a side; ``crosses`` where they are of two blocks."""
    r, c = F.col("r") + F.col("dr"), F.col("c") + F.col("dc")
    met = raster.neighbours(cells.select("r", "c", F.lit(1).alias("v")), raster.CROSS).filter("other = 1")
    block = lambda of: F.floor(of / size)
    crosses = (block(r) != block(F.col("r"))) | (block(c) != block(F.col("c")))
    return met.select(raster.cell_key(F.col("r"), F.col("c")).alias("a"), raster.cell_key(r, c).alias("b"), F.lit(1.0).alias("w"), crosses.alias("crosses"))


def block_graph(cells: DataFrame, size: int) -> DataFrame:
    """``a, b, w, crosses`` over portals: steps across borders, and least walks between the portals of one block inside it.

    ``cells`` are the open ones (``r, c``).  A portal is a cell with an open neighbour in another block.  Walks of all
    blocks are found together and never leave a block, so their cost is bounded by the size of a block.
    """
    steps = written(_steps(cells, size), "steps")
    over = steps.filter("crosses")
    portals = written(over.select(F.col("a").alias("node")).distinct(), "portals")
    inner = shortest_paths(steps.filter("NOT crosses"), portals.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("cost")))
    walks = inner.join(portals, "node", "left_semi").filter("source <> node")
    return written(over.unionByName(walks.select(F.col("source").alias("a"), F.col("node").alias("b"), F.col("cost").alias("w"), F.lit(False).alias("crosses"))), "blocks")


def block_search(graph: DataFrame, start: DataFrame) -> DataFrame:
    """``node, cost`` of every portal of a ``block_graph`` that can be reached from the portals of ``start`` (``node``), over portals alone."""
    part = lambda node: raster.square(F.shiftright(node, 31), F.pmod(node, F.lit(1 << 31)))
    found = shortest_paths_by_parts(graph, start.select(F.lit(0).alias("source"), "node", F.lit(0.0).alias("cost")), part)
    return found.select("node", "cost")


def touched_blocks(changed: DataFrame, size: int) -> DataFrame:
    """``br, bc`` of the blocks that hold a changed cell (``r, c``) or one beside it."""
    beside = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in [(0, 0), *raster.CROSS]])).alias("s")
    near = changed.select("r", "c", beside)
    return near.select(F.floor((F.col("r") + F.col("s.dr")) / size).alias("br"), F.floor((F.col("c") + F.col("s.dc")) / size).alias("bc")).distinct()


def maintained(graph: DataFrame, cells: DataFrame, changed: DataFrame, size: int) -> DataFrame:
    """``block_graph`` of ``cells`` from the ``graph`` before cells ``changed`` (``r, c``, opened or closed): only touched blocks are built anew.

    Rows of other blocks are carried over as they are.  The cells of touched blocks are read with one ring around them, which
    their steps across borders need; what that ring gives of its own blocks is dropped.
    """
    touched = written(touched_blocks(changed, size), "touched")
    few = touched.select("br", "bc", F.lit(True).alias("hit"))
    of = lambda r, c: (F.floor(r / size), F.floor(c / size))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in [(0, 0), *raster.CROSS]])).alias("s")
    looks = cells.select("r", "c", around)
    br, bc = of(F.col("r") + F.col("s.dr"), F.col("c") + F.col("s.dc"))
    near = looks.select("r", "c", br.alias("br"), bc.alias("bc")).join(touched, ["br", "bc"], "left_semi").select("r", "c").distinct()

    def marked(df: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            r, c = F.shiftright(end, 31), F.pmod(F.col(end), F.lit(1 << 31))
            br, bc = of(r, c)
            df = df.withColumns({"br": br, "bc": bc}).join(few.withColumnRenamed("hit", f"hit_{end}"), ["br", "bc"], "left").drop("br", "bc")
        return df

    hit = F.coalesce("hit_a", F.lit(False)) | F.coalesce("hit_b", F.lit(False))
    kept = marked(graph).filter(~hit).select("a", "b", "w", "crosses")
    anew = marked(block_graph(near, size)).filter(hit).select("a", "b", "w", "crosses")
    return kept.unionByName(anew)
