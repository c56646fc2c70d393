"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Only DataFrame operations: one scan counts the words of every text, one row per source decides the targets, and one
shuffle of ids and sizes picks the documents that are repeated once more.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabfeat.llm.text import WORD_PATTERN, numbered
from tabfeat.session import cut_lineage

#: Rows of one source that one window sorts, on average.
SLICE_ROWS = 20_000


def document_sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, the kept columns and size: the number of words of the whole text, none for null."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", *keep, words.alias("size"))


def cyclic_weights(sources: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """Weights that repeat over the sources in order of code points, null last; one row per source is ranked."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (rank % len(cycle) + 1)))


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """``target`` of each source (``source_size``, ``weight``): share of all sizes by weight, at most ``max_epochs`` times its size.

    Sources above their cap are clamped and the rest is dealt out again by weight, until none is above. If all are
    clamped the mix is smaller than the share asked for.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    state = cut_lineage(sources.withColumns({"_cap": cap, "_full": F.lit(False)}))
    while True:
        total, capped, weight = state.agg(
            F.sum("source_size"), F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)),
            F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("weight"))),
        ).first()
        if not weight:
            return state.withColumn("target", F.col("_cap")).drop("_cap", "_full")
        level = (share * total - capped) / weight
        above = ~F.col("_full") & (F.col("weight") * F.lit(level) > F.col("_cap"))
        if not state.where(above).limit(1).count():
            target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("weight") * F.lit(level))
            return state.withColumn("target", target).drop("_cap", "_full")
        state = cut_lineage(state.withColumn("_full", F.col("_full") | above))


def mix(docs: DataFrame, cycle: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target of its source, ``repeats`` and ``taken`` (size times repeats) of every document.

    A source with target t and size s repeats all documents floor(t / s) times. The rest of t is filled in the order of a
    seeded hash of doc_id: a document is repeated once more if the middle of its words, counted over the documents before
    it, lies within the rest. So each source's taken words miss its target by at most half a document, and a rerun agrees.

    A hot source is cut into slices by the first digits of the hash; sums per slice give every slice its start. Null texts
    have size 0; null sources are one source of their own; rows repeated in the input are rows of their own; an empty
    table gives none; a source without words has target 0 and repeats nothing.
    """
    return _mixed(document_sizes(docs), cycle, share, max_epochs, seed)


def _mixed(sizes: DataFrame, cycle: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 0,
           row: str | None = None) -> DataFrame:
    """The mix of documents by size; a column that numbers the rows parts those that share a doc_id or have none."""
    own = [row] if row else []
    sizes = cut_lineage(sizes)
    nameless = F.concat(F.lit("row "), F.col(row).cast("string")) if row else F.lit("")
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), nameless)).cast("binary"))
    rows = sizes.count()
    digits = max(1, math.ceil(math.log(max(rows, 1) / SLICE_ROWS, 16))) if rows > SLICE_ROWS else 1
    sizes = sizes.withColumns({"_key": key, "_order": order, "_slice": F.substring(order, 1, digits)})

    sliced = cut_lineage(sizes.groupBy("_key", "_slice").agg(F.first("source").alias("source"), F.sum("size").alias("_slice_size")))
    sources = sliced.groupBy("_key").agg(F.first("source").alias("source"), F.sum("_slice_size").alias("source_size"))
    targets = water_fill(cyclic_weights(sources, cycle), share, max_epochs).select("_key", "source_size", "target")
    before = F.sum("_slice_size").over(Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = sliced.withColumn("_before", F.coalesce(before, F.lit(0))).join(targets, "_key").select(
        "_key", "_slice", "_before", "source_size", "target")

    upto = F.sum("size").over(Window.partitionBy("_key", "_slice").orderBy("_order", "doc_id", "size", *own).rowsBetween(Window.unboundedPreceding, 0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - F.col("_whole") * F.col("source_size")
    middle = F.col("_before") + F.col("_upto") - F.col("size") / F.lit(2.0)
    mixed = sizes.join(starts, ["_key", "_slice"]).withColumns({"_upto": upto, "_whole": whole})
    repeats = F.col("_whole") + F.when((F.col("size") > 0) & (middle <= rest), 1).otherwise(0)
    return mixed.withColumn("repeats", repeats.cast("long")).select(
        *own, "doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def repeated(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; documents it takes no time go.

    The rows are numbered first and decisions are joined back by number, so each is judged by itself whatever its doc_id;
    rows without one are ordered by a hash of their number.
    """
    keyed = numbered(docs, "mixing")
    decided = _mixed(document_sizes(keyed.select("_row", "doc.doc_id", "doc.source", "doc.text"), "_row"), row="_row", **how).where("repeats > 0").select("_row", F.col("repeats").alias("_repeats"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_repeats")))
    return keyed.join(decided, "_row").select("doc", copies).select("doc.*")
