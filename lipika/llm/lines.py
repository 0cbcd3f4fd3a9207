"""Line dedup by site-relative frequency, in built-in expressions only.

A line is boilerplate on a host when it stands on more than ``ratio`` of the host's pages, and on
more than one, for what stands on a single page is not repeated; boilerplate lines are cut out of
every page of that host. That holds for hosts of any size: of a host with two pages, the lines
that both have go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialize_at

RATIO = 0.1


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """96 bits that stand for a line, so that counting moves no texts."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line, F.lit(7)).alias("b"))


def boilerplate(pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """``host, drop``: the keys of the lines to cut on each host that has any.

    A host's array has at most (mean distinct lines of its pages) / ratio keys, whatever the
    number of its pages. Counting is by (host, line), combined before the shuffle, so a line that
    every page holds meets as one partial count per task.
    """
    keyed = pages.select("host", F.array_distinct(F.filter(split_lines(F.col("text")), lambda x: F.trim(x) != "")).alias("lines"))
    # the page itself travels as a null key, so pages and lines are counted in one pass
    counted = (
        keyed.select("host", F.explode(F.concat(F.array(F.lit(None).cast("struct<a:bigint,b:int>")), F.transform("lines", line_key))).alias("key"))
        .groupBy("host", "key")
        .agg(F.count("*").alias("n"))
        .where((F.col("n") > 1) | F.col("key").isNull())
    )
    counted, path = materialize_at(counted, "line-counts")
    totals = counted.where(F.col("key").isNull()).select(F.col("host").alias("of"), F.col("n").alias("pages"))
    lines = counted.where(F.col("key").isNotNull())
    found = lines.join(totals, lines["host"].eqNullSafe(totals["of"])).where(F.col("n") > ratio * F.col("pages"))
    kept, _ = materialize_at(found.groupBy("host").agg(F.collect_list("key").alias("drop")), "boilerplate")
    drop_path(pages.sparkSession, path)
    return kept


def dedup_lines(pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """Add ``clean`` (the text without boilerplate lines), ``n_lines`` and ``n_dropped`` to (host, text, ...) rows.

    Null texts count as empty (one empty line); blank lines are never boilerplate; a null host is
    a host of its own; repeated rows are pages of their own; an empty table stays empty. The other
    columns pass through, whatever their names, but for the three new ones, which are replaced.
    """
    pages = pages.drop("clean", "n_lines", "n_dropped")
    drops = boilerplate(pages.select("host", "text"), ratio)
    # a page is one value here, so that no column of its can meet another's name
    whole = pages.select(F.struct(*[pages[c] for c in pages.columns]).alias("page"))
    # the written table tells the planner its size: small ones are broadcast, others joined by shuffle
    joined = whole.join(drops, F.col("page.host").eqNullSafe(drops["host"]), "left").select("page", "drop")
    lines = split_lines(F.col("page.text"))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("drop"), line_key(x)) | (F.trim(x) == ""))
    joined = joined.withColumn("kept", F.when(F.col("drop").isNull(), lines).otherwise(kept))
    return joined.select(
        *[F.col("page").getField(c).alias(c) for c in pages.columns],
        F.when(F.col("drop").isNull(), F.coalesce(F.col("page.text"), F.lit(""))).otherwise(F.array_join("kept", "\n")).alias("clean"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size("kept")).cast("long").alias("n_dropped"),
    )
