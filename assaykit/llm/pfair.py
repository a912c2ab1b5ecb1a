"""Mixing sources to target weights by Pfair scheduling: windows per block, earliest deadline first."""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from assaykit.llm.common import plain_names
from assaykit.operators.hotkeys import fits_broadcast

BLOCK_DOCS = 32
RESOLUTION = 1000
MAX_SOURCES = 20_000


def period_slots(weights: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of each source in one period of ``sum(weights)`` slots.

    Block i of a source with weight w of W is released at ``floor(i W / w)`` and due at ``ceil((i+1) W / w)``. Each slot goes
    to the released block with the earliest deadline, ties to the smaller name. One block a slot and weights that sum to the
    whole keep every source within one block of its share at every slot; the pattern repeats after W slots.
    """
    whole = sum(weights.values())
    taken: dict[str, list[int]] = {s: [] for s in weights}
    later = [(0, s) for s in sorted(weights)]
    ready: list[tuple[int, str]] = []
    for slot in range(whole):
        while later and later[0][0] <= slot:
            _, s = heapq.heappop(later)
            heapq.heappush(ready, (-(-(len(taken[s]) + 1) * whole // weights[s]), s))
        _, s = heapq.heappop(ready)
        taken[s].append(slot)
        heapq.heappush(later, (len(taken[s]) * whole // weights[s], s))
    return taken


def plan_phases(blocks: Mapping[str, int], weights: Mapping[str, int]) -> tuple[list[tuple], list[tuple]]:
    """Phases of the whole mix, and the slots of one period of each.

    A phase ends when a source has no blocks left; the others go on with their weights renormalised, so nothing is dropped or
    repeated. Returns rows (source, phase, first block, blocks, first slot, weight, whole) and (source, phase, turn, slot).
    Work: the sum of weights for each phase, whatever the number of documents.
    """
    left, done, first = dict(blocks), dict.fromkeys(blocks, 0), 0
    phases: list[tuple] = []
    turns: list[tuple] = []
    phase = 0
    while live := {s: weights[s] for s, n in left.items() if n > 0}:
        whole, slots = sum(live.values()), period_slots(live)
        last = min((left[s] - 1) // w * whole + slots[s][(left[s] - 1) % w] + 1 for s, w in live.items())
        for s, w in live.items():
            n = last // whole * w + sum(x < last % whole for x in slots[s])
            phases.append((s, phase, done[s], n, first, w, whole))
            turns += [(s, phase, i, x) for i, x in enumerate(slots[s])]
            left[s] -= n
            done[s] += n
        first, phase = first + last, phase + 1
    return phases, turns


def smoothed_weights(counts: Mapping[str, int], power: float = 0.5, resolution: int = RESOLUTION) -> dict[str, int]:
    """Target weights in proportion to ``count ** power``, as whole numbers that sum to about ``resolution``, at least 1."""
    whole = sum(n**power for n in counts.values())
    return {s: max(1, int(resolution * n**power / whole + 0.5)) for s, n in counts.items()}


def _order(id_col: str) -> Column:
    """A repeatable shuffle of the documents of a source; its first digits cut a hot source into even buckets."""
    return F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def numbered(docs: DataFrame, id_col: str, source: str) -> DataFrame:
    """``_source`` (null as empty) and ``_n``, the row's number from 0 within its source in shuffled order.

    Counts per (source, bucket of 4096) give each bucket's start, so no task ranks a whole source.
    """
    rows = docs.withColumn("_source", F.coalesce(F.col(source).cast("string"), F.lit(""))).withColumn("_o", _order(id_col))
    rows = rows.withColumn("_b", F.substring("_o", 1, 3))
    earlier = Window.partitionBy("_source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_source", "_b").agg(F.count("*").alias("_c")).select(
        "_source", "_b", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_source", "_b").orderBy("_o", id_col)
    # at most 4096 rows per source
    starts = F.broadcast(starts) if fits_broadcast(starts) else starts
    return (rows.withColumn("_r", F.row_number().over(inside) - 1).join(starts, ["_source", "_b"])
            .withColumn("_n", F.col("_before") + F.col("_r")).drop("_o", "_b", "_r", "_before"))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", weights: Mapping[str, int] | None = None,
        block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All rows and columns of ``docs`` with ``mix_block``, ``mix_slot``, ``mix_place``, ``mix_release`` and ``mix_deadline``.

    A block is ``block_docs`` documents of one source (the last may be shorter); every block gets a slot of its own, and
    ordering by (mix_slot, mix_place) gives the mix. Without ``weights`` the target is the square root of the source's size.
    While no source has run out, each has at every slot less than one block more or less than its share; then the remaining
    weights are renormalised. Every row is returned once. A null source is a source of its own (''), null ids come first in
    their shuffled order, equal ids are neighbours. An empty table gives an empty table. Existing columns with these names
    are replaced. Sources are counted on the driver: at most ``MAX_SOURCES``, else ValueError.
    """
    spark = docs.sparkSession
    names = ["mix_block", "mix_slot", "mix_place", "mix_release", "mix_deadline"]
    base = docs.drop(*[c for c in docs.columns if c.lower() in names])
    plain, at = plain_names(base)
    counts = plain.groupBy(F.coalesce(F.col(at[source]).cast("string"), F.lit("")).alias("s")).agg(F.count("*").alias("n"))
    counted = {r.s: r.n for r in counts.limit(MAX_SOURCES + 1).collect()}
    if len(counted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goal = dict(weights) if weights is not None else smoothed_weights(counted)
    if any(goal.get(s, 0) < 1 for s in counted):
        raise ValueError("every source needs a weight of at least 1")
    phases, turns = plan_phases({s: -(-n // block_docs) for s, n in counted.items()}, goal)
    phase_table = spark.createDataFrame(
        phases, "_source string, _phase int, _first long, _blocks long, _start long, _weight long, _whole long")
    turn_table = spark.createDataFrame(turns, "_source string, _phase int, _turn long, _slot long")
    rows = numbered(plain, at[id_col], at[source]).withColumn("mix_block", F.floor(F.col("_n") / block_docs).cast("long"))
    # one row per source and phase, one per slot of a period: bounded by the weights, not by the documents
    placed = rows.join(F.broadcast(phase_table), "_source").where(
        (F.col("mix_block") >= F.col("_first")) & (F.col("mix_block") < F.col("_first") + F.col("_blocks")))
    i = F.col("mix_block") - F.col("_first")
    placed = placed.withColumn("_turn", F.pmod(i, F.col("_weight")))
    placed = (F.broadcast(turn_table).join(placed, ["_source", "_phase", "_turn"]) if fits_broadcast(turn_table)
              else placed.join(turn_table, ["_source", "_phase", "_turn"]))
    whole, weight, start = F.col("_whole"), F.col("_weight"), F.col("_start")
    return placed.select(
        *plain.columns, "mix_block",
        (start + F.floor(i / weight) * whole + F.col("_slot")).cast("long"),
        F.pmod("_n", F.lit(block_docs)).cast("long"),
        (start + F.floor(i * whole / weight)).cast("long"),
        (start + F.ceil((i + 1) * whole / weight)).cast("long"),
    ).toDF(*base.columns, *names)


def in_mix_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows in the order of the mix: range partitions of slots, sorted inside, so that part files follow each other."""
    return mixed.repartitionByRange("mix_slot").sortWithinPartitions("mix_slot", "mix_place").select(*columns)
