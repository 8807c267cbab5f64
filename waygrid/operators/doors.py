"""Pairs of ways in and out by their names, with ordered fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waygrid.functions import geo

# Words of a door's name that don't tell which door it is.
PLAIN_WORDS = ("entering", "exiting", "entrance", "exit", "instance", "start", "end", "inside", "the")
#: Into how many parts the ways out of one name are dealt.
PARTS = 32


def door_key(name: Column) -> Column:
    """A door's name without what stands in brackets, signs and plain words, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(name), r"\(.*?\)", " "), "[^a-z' ]", " ")
    return F.array_join(F.filter(F.split(F.trim(bare), " +"), lambda w: ~w.isin(*PLAIN_WORDS) & (w != "")), " ")


def paired_doors(ins: DataFrame, outs: DataFrame, ghosts: DataFrame, reach: float) -> DataFrame:
    """``door, way, out, x, y``: where each way in starts from.

    ``ins`` has ``door, map, name, trigger_x, trigger_y`` (null: none), ``outs`` has ``out, name, x, y``, ``ghosts`` has ``map, gx, gy``.  In this order: the way out of the same
    key (``key``), or else of the same first word (``word``), the one nearest to the map's ghost place and within ``reach`` of it
    (ties: smaller id); the trigger itself; the ghost's place.  Doors with none of these are left out.
    """
    asked = ins.join(ghosts, "map", "left").withColumn("key", door_key(F.col("name"))).withColumn("word", F.split_part("key", F.lit(" "), F.lit(1)))
    known = outs.withColumn("key", door_key(F.col("name"))).withColumn("word", F.split_part("key", F.lit(" "), F.lit(1))).select("out", "x", "y", "key", "word")

    def nearest(by: str, doors: DataFrame) -> DataFrame:
        # Doors of one name and ghosts' place ask the same, so each question is put once, to parts of the ways out: a common name has many.
        doors = doors.filter(F.col(by) != "")
        asked = doors.select(by, "gx", "gy").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        outs = known.select("out", "x", "y", by, F.pmod(F.xxhash64("out"), F.lit(PARTS)).cast("int").alias("part"))
        met = asked.join(outs, [by, "part"]).withColumn("d", F.when(F.col("gx").isNull(), 0.0).otherwise(geo.distance(F.col("x"), F.col("y"), F.col("gx"), F.col("gy"))))
        point = F.min(F.struct("d", "out", "x", "y")).alias("best")
        told = met.groupBy("part", by, "gx", "gy").agg(point).select(F.col(by).alias("_by"), F.col("gx").alias("_gx"), F.col("gy").alias("_gy"), "best.*").groupBy("_by", "_gx", "_gy").agg(point)
        of = (F.col(by) == F.col("_by")) & F.col("gx").eqNullSafe(F.col("_gx")) & F.col("gy").eqNullSafe(F.col("_gy"))
        best = doors.join(told, of).groupBy("door").agg(F.min("best").alias("best"))
        return best.select("door", F.lit(by).alias("way"), "best.*")

    same = nearest("key", asked)
    other = nearest("word", asked.join(same, "door", "left_anti"))
    found = same.unionByName(other).filter(F.col("d") < reach).drop("d")
    rest = asked.join(found, "door", "left_anti")
    at = F.when(F.col("trigger_x").isNotNull(), F.struct(F.lit("trigger").alias("way"), F.col("trigger_x").alias("x"), F.col("trigger_y").alias("y"))).when(F.col("gx").isNotNull(), F.struct(F.lit("ghost").alias("way"), F.col("gx").alias("x"), F.col("gy").alias("y")))
    rest = rest.withColumn("at", at).filter("at IS NOT NULL").select("door", "at.way", F.lit(None).cast(outs.schema["out"].dataType).alias("out"), "at.x", "at.y")
    return found.unionByName(rest)
