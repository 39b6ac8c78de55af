"""Sharding by sampled splitters, in DataFrame expressions only.

Rows are ordered by crc32 of the text, crc32 of the id, and id, so equal texts lie together. A size-weighted sample of keys
gives quantile boundaries of many more ranges than shards; rows go to ranges by these, ranges that hold more
than their share are subdivided at boundaries drawn from themselves, and running sums inside ranges, on top of
the ranges' totals, give each row its place in the order. Shard k takes the rows whose middle byte lies in the
k-th of n equal parts of all bytes: sizes are equal to within one row, whatever the sample.

Defined results: a null text has no bytes (size 16) and the checksum of an empty text; null ids come first
among equal checksums; rows that are equal in key are told apart by a running number; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import keep

OVERHEAD = 16
#: Ranges a shard at least, rows a range (in the mean) as long as there are MOST ranges at most, keys sampled a range.
#: The driver thus holds MOST * KEYS keys at most, and the plan MOST cuts and what subdividing adds, whatever the rows.
RANGES, RANGE_ROWS, MOST, KEYS = 8, 250_000, 4096, 16


def sized(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))


def spot(crc: Column, key: Column) -> Column:
    """A place on one line that keeps the order of (crc, key) for distinct checksums and spreads the copies of one text.

    32 bits of checksum, then 31 of the key's own checksum: equal texts stay neighbours and a large group of copies can be cut.
    """
    own = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.shiftleft(crc - F.lit(1 << 31), 31).bitwiseOR(F.shiftright(own, 1))


def draw_splitters(rows: DataFrame, ranges: int, keys: int = KEYS) -> list[int]:
    """Boundaries of ranges from about ranges * keys keys, each drawn with a chance in proportion to its size."""
    total = rows.agg(F.sum("size").alias("s")).first()["s"] or 0
    if not total:
        return []
    # the draw is a hash of the place, so reruns agree; a row larger than a draw's share is always drawn and weighs its size
    step = max(1.0, total / (ranges * keys))
    dice = F.pmod(F.xxhash64("place", F.lit(17)), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.filter(dice < F.col("size") / step).select("place", F.greatest(F.col("size").cast("double"), F.lit(step)).alias("w"))
    sample = sorted((r["place"], r["w"]) for r in drawn.collect())  # about ranges * keys rows, MOST * KEYS at most, whatever the input
    cuts, run, mass = [], 0.0, sum(w for _, w in sample)
    for place, w in sample:
        run += w
        if run >= mass * (len(cuts) + 1) / ranges and (not cuts or place > cuts[-1]):
            cuts.append(place)
    return cuts[: ranges - 1]


def range_of(place: Column, cuts: list[int]) -> Column:
    """The number of the range: how many cuts lie below place, found among groups of cuts and then inside one group."""
    if not cuts:
        return F.lit(0)
    wide = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    below = lambda c: F.size(F.filter(c, lambda x: x < place))
    lasts, table = F.lit([g[-1] for g in groups[:-1]] or [groups[0][-1]]), F.array(*[F.lit(g) for g in groups])
    group = F.least(below(lasts), F.lit(len(groups) - 1))
    return group * wide + below(F.element_at(table, group + 1))


def shard_by_bytes(docs: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    rows = keep(sized(docs, text, key).withColumn("place", spot(F.col("text_crc32"), F.col("doc_id"))))
    cuts = draw_splitters(rows, max(shards * RANGES, min(MOST, rows.count() // RANGE_ROWS)))
    cuts = subdivide(rows, cuts)
    rows = rows.withColumn("range", range_of(F.col("place"), cuts))
    totals = rows.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()  # one row a range
    before, bytes_, n = {}, 0, 0
    for r in sorted(totals, key=lambda r: r["range"]):
        before[r["range"]] = (bytes_, n)
        bytes_, n = bytes_ + r["bytes"], n + r["n"]
    starts = docs.sparkSession.createDataFrame([(k, *v) for k, v in before.items()], "range int, bytes_before long, rows_before long")
    inside = Window.partitionBy("range").orderBy("place", "text_crc32", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        rows.join(F.broadcast(starts), "range")
        .withColumn("at", F.col("bytes_before") + F.sum("size").over(inside))
        .withColumn("nth", F.col("rows_before") + F.count(F.lit(1)).over(inside))
    )
    middle = 2 * F.col("at") - F.col("size")
    shard = F.floor(middle.cast("decimal(38,0)") * shards / F.lit(2 * max(1, bytes_)).cast("decimal(38,0)")).cast("int")
    placed = placed.withColumn("shard", F.least(shard, F.lit(shards - 1)))
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def subdivide(rows: DataFrame, cuts: list[int], over: float = 1.5, least: int = 64, rounds: int = 8) -> list[int]:
    """Cuts ranges of more than `over` times the mean size and over `least` rows until none is left that has a second place to cut at."""
    for _ in range(rounds):
        sizes = {r["range"]: r for r in rows.groupBy(range_of(F.col("place"), cuts).alias("range")).agg(F.sum("size").alias("bytes"), F.min("place").alias("low"), F.max("place").alias("high"), F.count(F.lit(1)).alias("n")).collect()}
        mean = sum(r["bytes"] for r in sizes.values()) / (len(cuts) + 1) if sizes else 0
        full = {k: r for k, r in sizes.items() if r["bytes"] > over * mean and r["n"] > least and r["low"] < r["high"]}
        if not full:
            return cuts
        pieces = {k: min(64, -(-int(r["bytes"]) // max(1, int(mean)))) for k, r in full.items()}
        inside = rows.withColumn("range", range_of(F.col("place"), cuts)).filter(F.col("range").isin(list(full)))
        found = inside.groupBy("range").agg(F.percentile_approx("place", [i / 64 for i in range(1, 64)], 6400).alias("q")).collect()
        more = [r["q"][i * 64 // pieces[r["range"]] - 1] for r in found for i in range(1, pieces[r["range"]])]
        fresh = sorted({*cuts, *[m for m in more if m not in cuts]})
        if len(fresh) == len(cuts):
            return cuts
        cuts = fresh
    return cuts
