"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a fixed pseudo-random order, form blocks. With integer weights a of a
sum D, block j of a source is released at slot floor(j * D / a) and due by slot
ceil((j + 1) * D / a); each slot goes to the released block of the earliest deadline. With
utilisation exactly one this meets every deadline, so at every slot each source is within less
than one block of its share. Weights are exact, however small. A source ends at the slot where
its next block would be released; the others then go on with their weights among themselves.

Plan: documents are ranked inside (source, hash range) groups of about `group_rows` rows, so
that a source with a third of all rows is many groups; group sizes add up to offsets. The
slot of each block follows from the counts alone. Up to `map_runs` and `max_runs` blocks the
driver works the slots out, and a broadcast join brings them to the blocks; of more, one task
works out the same slots, streams them to the shared folder, and they meet their blocks in a join
on (source, block). That task takes time in proportion to the blocks and holds a batch of them.

Defined results: the order inside a source is that of md5 of the id. A null source is the
source "". Repeated rows each have a place. Sources without documents, or a weight of zero,
have no block before all others ended. The mix lasts until the sources that ran out had more
than `missing` of the weight, by exact arithmetic on the documents; later documents have in_mix
false and still a slot. Empty tables give no rows. Other columns stay as they are where
documents are returned.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlume.llm.shared import written


def served(weights: dict[str, int], n: int) -> Iterator[str]:
    """The source of each of the first n slots. Releases and deadlines are exact integers; what
    is not released yet waits in a heap by release, the rest in one by deadline."""
    total = sum(weights.values())
    coming = [(0, -(-total // a), s, 0) for s, a in weights.items() if a]
    heapq.heapify(coming)
    ready: list[tuple[int, str, int]] = []
    for slot in range(n):
        while coming and coming[0][0] <= slot:
            _, due, s, j = heapq.heappop(coming)
            heapq.heappush(ready, (due, s, j))
        due, s, j = heapq.heappop(ready)
        if slot >= due:
            raise AssertionError("a deadline was missed")
        yield s
        a = weights[s]
        heapq.heappush(coming, ((j + 1) * total // a, -(-(j + 2) * total // a), s, j + 1))


def period(weights: dict[str, int], stop: int | None = None) -> list[str]:
    """The source of each of sum(weights) slots, or of the first `stop`."""
    return list(served(weights, sum(weights.values()) if stop is None else stop))


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Integers in exactly these proportions; weights of zero have none."""
    own = {s: Fraction(w) for s, w in sorted(weights.items()) if w > 0}
    scale = math.lcm(*(w.denominator for w in own.values()))
    whole = {s: int(w * scale) for s, w in own.items()}
    common = math.gcd(*whole.values())
    return {s: a // common for s, a in whole.items()}


def capped_shares(counts: dict[str, int], most: float) -> dict[str, float]:
    """Shares in proportion to counts, none above `most` where there are sources enough."""
    free, held = dict(counts), {}
    while free:
        left = 1 - most * len(held)
        total = sum(free.values())
        over = [s for s, n in free.items() if total and n / total * left > most + 1e-12]
        if not over or len(held) + len(over) >= len(counts):
            return held | {s: n / total * left if total else 0.0 for s, n in free.items()}
        for s in over:
            held[s] = most
            del free[s]
    return held


def mix_counts(counts: dict[str, int], weights: dict[str, float], missing: float) -> dict[str, int]:
    """How many documents of each source the mix holds: it ends at the source by whose end more
    than `missing` of the weight has run out. Without any weight it holds all."""
    own = {s: Fraction(weights.get(s, 0)) for s, n in counts.items() if n > 0 and weights.get(s, 0) > 0}
    total, gone = sum(own.values()), Fraction(0)
    for s in sorted(own, key=lambda s: (counts[s] / own[s], s)):
        gone += own[s]
        if gone > missing * total:
            lasts = counts[s] / own[s]
            return {x: min(n, math.ceil(own.get(x, 0) * lasts)) for x, n in counts.items()}
    return dict(counts)


def slots(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[str]:
    """The source of each of sum(blocks) slots, one after the other."""
    left = {s: n for s, n in blocks.items() if n > 0}
    while left:
        own = whole_weights({s: weights.get(s, 0) for s in left}) or dict.fromkeys(left, 1)
        lasts = min(left[s] * sum(own.values()) // a for s, a in own.items())
        for s in served(own, lasts):
            left[s] -= 1
            yield s
        left = {s: n for s, n in left.items() if n > 0}


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> list[str]:
    return list(slots(blocks, weights))


def _source(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def _rank_key(col: str) -> Column:
    return F.md5(F.coalesce(F.col(col).cast("string"), F.lit("")))


def _counts(docs: DataFrame, source_col: str, max_sources: int) -> dict[str, int]:
    rows = docs.groupBy(_source(source_col).alias("s")).count().limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources or merge small ones")
    return {r["s"]: r["count"] for r in rows}


def _ranked(docs: DataFrame, counts: dict[str, int], id_col: str, source_col: str, group_rows: int) -> DataFrame:
    """(id, source, key, rank): rank counts from 0 inside the source, by key."""
    spark = docs.sparkSession
    sizes = spark.createDataFrame([(s, max(1, n // group_rows)) for s, n in counts.items()], "src string, parts long")
    own = docs.select(F.col(id_col).alias("id"), _source(source_col).alias("src"), _rank_key(id_col).alias("key"))
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / float(1 << 32) * F.col("parts"))
    dealt = own.join(F.broadcast(sizes), "src").withColumn("part", part)
    n = dealt.groupBy("src", "part").count()
    before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = n.select("src", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = dealt.withColumn("n", F.row_number().over(Window.partitionBy("src", "part").orderBy("key", "id")) - 1)
    return inside.join(offsets, ["src", "part"]).select("id", "src", "key", (F.col("before") + F.col("n")).alias("rank"))


def _planned(docs: DataFrame, weights, id_col, source_col, block_docs, missing, group_rows, max_sources):
    """Counts, target weights, blocks in the mix of each source, and ranked documents."""
    counts = _counts(docs, source_col, max_sources)
    targets = weights(counts) if callable(weights) else dict(weights)
    mixed = {s: -(-n // block_docs) for s, n in mix_counts(counts, targets, missing).items()}
    return counts, targets, mixed, _ranked(docs, counts, id_col, source_col, group_rows)


def shares(counts: dict[str, int]) -> dict[str, float]:
    """The default weights: shares of the documents, so that the mix holds every document."""
    return dict(counts)


def quarter(counts: dict[str, int]) -> dict[str, float]:
    """Shares of the documents, a source a quarter at most. What does not fit leaves the mix."""
    return capped_shares(counts, 0.25)


def left_out(docs: DataFrame, weights=shares, *, source_col: str = "source", missing: float = 0.05, max_sources: int = 2000) -> dict[str, int]:
    """The loss that target weights demand: documents of each source that the mix leaves out."""
    counts = _counts(docs, source_col, max_sources)
    held = mix_counts(counts, weights(counts) if callable(weights) else dict(weights), missing)
    return {s: n - held[s] for s, n in counts.items() if n > held[s]}


def _places(blocks: dict[str, int], mixed: dict[str, int], targets: dict[str, float]) -> Iterator[tuple[str, int, int]]:
    """(source, its block, the block's slot): those in the mix, then the rest."""
    at, done = 0, dict.fromkeys(blocks, 0)
    for until in (mixed, blocks):
        for s in slots({s: n - done[s] for s, n in until.items()}, targets):
            yield s, done[s], at
            at, done[s] = at + 1, done[s] + 1


def _slot_table(docs: DataFrame, blocks: dict[str, int], mixed: dict[str, int], targets: dict[str, float], most: int) -> DataFrame:
    """The places as a table: up to `most` a broadcast one, else one written by a task."""
    spark, schema = docs.sparkSession, "src string, block long, slot long"
    if sum(blocks.values()) <= most:
        return F.broadcast(spark.createDataFrame(list(_places(blocks, mixed, targets)), schema))

    def work(_):
        kinds = pa.schema([("src", pa.string()), ("block", pa.int64()), ("slot", pa.int64())])
        places = _places(blocks, mixed, targets)
        while part := list(itertools.islice(places, 1 << 16)):
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*part, strict=True), kinds.types, strict=True)], schema=kinds)

    return written(spark.range(0, 1, 1, 1).mapInArrow(work, schema), "slots")


def mix_sources(docs: DataFrame, weights=shares, *, id_col: str = "doc_id", source_col: str = "source", block_docs: int = 8, missing: float = 0.05, group_rows: int = 2000, max_sources: int = 2000, map_runs: int = 1 << 17, max_runs: int = 1 << 23) -> DataFrame:
    """Per document row: its id, source, block (of the source), slot, place (in the block) and
    in_mix. weights: a dict, or a function from document counts to one. map_runs and max_runs only
    say who works out the slots: the results do not depend on them."""
    counts, targets, mixed, ranked = _planned(docs, weights, id_col, source_col, block_docs, missing, group_rows, max_sources)
    blocks = {s: -(-n // block_docs) for s, n in counts.items()}
    table = _slot_table(docs, blocks, mixed, targets, min(map_runs, max_runs))
    ends = docs.sparkSession.createDataFrame(list(mixed.items()), "src string, mixed long")
    placed = ranked.withColumn("block", F.floor(F.col("rank") / block_docs)).join(F.broadcast(ends), "src").withColumn("in_mix", F.col("block") < F.col("mixed"))
    return placed.join(table, ["src", "block"]).select(F.col("id").alias(id_col), F.col("src").alias("source"), "block", "slot", (F.col("rank") % block_docs).cast("long").alias("place"), "in_mix")


def mixed_documents(docs: DataFrame, weights=shares, *, id_col: str = "doc_id", source_col: str = "source", block_docs: int = 8, missing: float = 0.05, group_rows: int = 2000, max_sources: int = 2000) -> DataFrame:
    """The documents that are in the mix, with all their columns. The last key of each source
    (a row for each) says which those are, so no text is shuffled."""
    counts, _, mixed, ranked = _planned(docs, weights, id_col, source_col, block_docs, missing, group_rows, max_sources)
    last = {s: min(mixed[s] * block_docs, n) - 1 for s, n in counts.items()}
    wanted = docs.sparkSession.createDataFrame([x for x in last.items() if x[1] >= 0], "src string, rank long")
    cut = written(ranked.join(F.broadcast(wanted), ["src", "rank"]).select("src", F.col("key").alias("last")), "cuts")
    names = [f"__c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names, strict=True))
    joined = docs.toDF(*names).join(F.broadcast(cut), (_source(own[source_col]) == F.col("src")) & (_rank_key(own[id_col]) <= F.col("last")))
    return joined.select(*names).toDF(*docs.columns)


def ordered_documents(docs: DataFrame, weights=shares, *, order: tuple[str, str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **limits) -> DataFrame:
    """The documents that are in the mix, with all their columns; those of order hold the slot and
    the place of each. Rows are told apart by id, text and source; equal ones have one place. The
    order inside a source is that of md5 of (id, hash of the text), so rows of one id, or of
    none, are spread. limits: as of mix_sources."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names, strict=True))
    rows = docs.toDF(*names).withColumns({"__src": _source(own[source_col]), "__row": F.struct(F.col(own[id_col]).alias("id"), F.xxhash64(own[text_col]).alias("hash"))})
    keys = written(rows.select(F.col("__row").alias("row"), F.col("__src").alias("source")), "keys")
    mix = mix_sources(keys, weights, id_col="row", source_col="source", **limits).where("in_mix")
    at = mix.groupBy("row", "source").agg(F.min(F.struct("slot", "place")).alias("at")).select("at", *[F.col(x).alias(y) for x, y in (("row.id", "id"), ("row.hash", "hash"), ("source", "of"))])
    same = F.col("__row.id").eqNullSafe(F.col("id")) & (F.col("__row.hash") == F.col("hash")) & (F.col("__src") == F.col("of"))
    given = {own[order[0]]: F.col("at.slot"), own[order[1]]: F.col("at.place")}
    return rows.join(at, same).withColumns(given).select(*names).toDF(*docs.columns)
