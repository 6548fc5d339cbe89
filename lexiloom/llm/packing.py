"""Problem 8: filling containers of fixed capacity with items.

Method: best-two-fit.  A container is filled greedily, largest fitting item first;
then its smallest item gives way to two unpacked items that fit the expanded gap
more tightly, if there are such.

Items of one size are alike, so the packing is decided on the histogram of sizes,
which has at most ``capacity`` entries however many items there are.  A pattern of
sizes is used as often as the histogram allows, so there are no more patterns than
sizes.  Every item then finds its container from its place among the items of its
size: the places are counted in buckets of bounded size, never in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.storage import materialise

#: Items of one size that are numbered in one task.
BUCKET_ROWS = 2_000_000


@dataclass(frozen=True)
class Pattern:
    """Sizes that fill a container, and how many containers are filled so."""

    sizes: tuple[int, ...]
    times: int


def best_two_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use up all items of the histogram ``size -> items``; sizes are 1 to ``capacity``."""
    left = np.zeros(capacity + 2, np.int64)
    for size, n in counts.items():
        if not 1 <= size <= capacity:
            raise ValueError(f"size {size} does not fit {capacity}")
        left[size] = n
    # the largest size up to each that has items left
    fits = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 2), 0))
    every = np.arange(capacity + 2)

    def take(size: int) -> None:
        left[size] -= 1
        if not left[size]:
            fits[size : np.searchsorted(fits, size, side="right")] = fits[size - 1]

    def give(size: int) -> None:
        left[size] += 1
        if left[size] == 1:
            fits[size : max(size, np.searchsorted(fits, size, side="left"))] = size

    patterns = []
    while fits[capacity]:
        sizes, gap = [], capacity
        while size := int(fits[gap]):
            take(size)
            sizes.append(size)
            gap -= size
            if gap == 0:
                break
        if gap and len(sizes) > 1:
            smallest = sizes[-1]
            room = gap + smallest
            first = every[1:room][left[1:room] > 0]
            first = first[first >= room - first]  # the larger of the two
            second = fits[room - first]
            twice = (second == first) & (left[first] < 2)
            second = np.where(twice, fits[np.maximum(first - 1, 0)], second)
            total = np.where(second > 0, first + second, 0)
            if len(total) and int(total.max()) > smallest:
                k = int(total.argmax())
                a, b = int(first[k]), int(second[k])
                sizes.pop()
                give(smallest)
                take(a)
                take(b)
                sizes += sorted((a, b), reverse=True)
        kinds, uses = np.unique(sizes, return_counts=True)
        more = int((left[kinds] // uses).min())
        for size, use in zip(kinds.tolist(), uses.tolist()):
            if more:
                left[size] -= use * more - 1
                take(size)
        patterns.append(Pattern(tuple(sizes), 1 + more))
    return patterns


def _slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(size, first place, places, first bin, items of this size per bin) for every size of every pattern."""
    rows, used, bins = [], {}, 0
    for pattern in patterns:
        for size in sorted(set(pattern.sizes)):
            each = pattern.sizes.count(size)
            rows.append((size, used.get(size, 0), each * pattern.times, bins, each))
            used[size] = used.get(size, 0) + each * pattern.times
        bins += pattern.times
    return rows


def pack(items: DataFrame, specs: DataFrame) -> DataFrame:
    """Containers of every capacity.

    ``items``: ``doc_id LONG, size LONG``; ``specs``: ``spec_id INT, capacity INT``, a table of a few rows.
    Returns ``spec_id INT, bin_id LONG, doc_id LONG, piece INT, size LONG``: an item larger
    than the capacity is split into full containers and a rest, which is packed like
    any other; ``piece`` counts its parts from 0.  Items without a positive size or
    without ``doc_id`` and specs without a positive capacity are left out; rows that
    repeat an item are items of their own.  Eager: the histogram is gathered, at most
    ``capacity`` rows for each spec.
    """
    spark = items.sparkSession
    held = items.filter("size > 0 AND doc_id IS NOT NULL").select("doc_id", "size")
    known = [(r["spec_id"], int(r["capacity"])) for r in specs.filter("capacity > 0").select("spec_id", "capacity").collect()]
    if not known:
        return spark.createDataFrame([], "spec_id int, bin_id long, doc_id long, piece int, size long")
    n_buckets = max(1, -(-held.count() // BUCKET_ROWS))
    spec_array = F.array(*(F.struct(F.lit(s).cast("int").alias("spec_id"), F.lit(c).cast("long").alias("capacity")) for s, c in known))
    each = held.withColumn("spec", F.explode(spec_array)).select("doc_id", F.col("size").alias("whole"), "spec.*")
    each = each.withColumns({"rest": F.col("whole") % F.col("capacity"), "full": F.floor(F.col("whole") / F.col("capacity"))})
    each = each.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets)))

    # histogram by size and bucket: bounded by the capacities and the buckets
    tally = materialise(each.groupBy("spec_id", "rest", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")), "sizes")
    histogram: dict[int, dict[int, int]] = {s: {} for s, _ in known}
    for r in tally.filter("rest > 0").groupBy("spec_id", "rest").agg(F.sum("n").alias("n")).toLocalIterator():
        histogram[r["spec_id"]][r["rest"]] = r["n"]
    slots, ends = [], []
    for spec_id, capacity in known:
        patterns = best_two_fit(histogram[spec_id], capacity)
        slots += [(spec_id, *row) for row in _slots(patterns)]
        ends.append((spec_id, sum(p.times for p in patterns)))

    # the place of every rest among those of its size
    by_size = Window.partitionBy("spec_id", "rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = tally.filter("rest > 0").withColumn("before", F.coalesce(F.sum("n").over(by_size), F.lit(0))).select("spec_id", "rest", "bucket", "before")
    in_bucket = Window.partitionBy("spec_id", "rest", "bucket").orderBy("doc_id")
    rests = each.filter("rest > 0").withColumn("k", F.row_number().over(in_bucket) - 1).join(before, ["spec_id", "rest", "bucket"])
    rests = rests.withColumn("place", F.col("before") + F.col("k"))
    # no more slots than a few times the capacities: small, but its size is left to the planner to check
    slot_lists = spark.createDataFrame(slots, "spec_id int, rest long, first long, places long, bin long, each int").groupBy("spec_id", "rest").agg(F.sort_array(F.collect_list(F.struct("first", "places", "bin", "each"))).alias("slots"))
    placed = rests.join(slot_lists, ["spec_id", "rest"])
    slot = F.filter("slots", lambda s: (s["first"] <= F.col("place")) & (F.col("place") < s["first"] + s["places"]))[0]
    placed = placed.withColumn("slot", slot).withColumn("bin_id", F.expr("slot.bin + (place - slot.first) div slot.each"))
    rest_rows = placed.select("spec_id", F.col("bin_id").cast("long"), "doc_id", F.col("full").cast("int").alias("piece"), F.col("rest").alias("size"))

    # full containers of split items come after the packed ones
    by_bucket = Window.partitionBy("spec_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = tally.groupBy("spec_id", "bucket").agg(F.sum("full").alias("span")).withColumn("start", F.coalesce(F.sum("span").over(by_bucket), F.lit(0)))
    spans = spans.join(spark.createDataFrame(ends, "spec_id int, packed long"), "spec_id")
    running = Window.partitionBy("spec_id", "bucket").orderBy("doc_id", "whole", "tie").rowsBetween(Window.unboundedPreceding, -1)
    whole = each.filter("full > 0").withColumn("tie", F.monotonically_increasing_id()).withColumn("offset", F.coalesce(F.sum("full").over(running), F.lit(0))).join(spans, ["spec_id", "bucket"])
    whole_rows = whole.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("full").cast("int") - 1))).select("spec_id", (F.col("packed") + F.col("start") + F.col("offset") + F.col("piece")).cast("long").alias("bin_id"), "doc_id", "piece", F.col("capacity").alias("size"))
    return rest_rows.union(whole_rows)


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """``spec_id, capacity, bins, items, tokens, fill``: the containers and the share of their room that is used."""
    total = packed.groupBy("spec_id").agg(F.max("bin_id").alias("last"), F.count(F.lit(1)).alias("items"), F.sum("size").alias("tokens"))
    bins = F.col("last") + 1
    return total.join(specs.select("spec_id", "capacity"), "spec_id").select("spec_id", "capacity", bins.alias("bins"), "items", "tokens", (F.col("tokens") / (bins * F.col("capacity"))).alias("fill"))
