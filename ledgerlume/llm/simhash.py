"""SimHash near-dedup by anchor-point covering.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 1 bit in one of their
32-bit halves. In each half the anchors are the words of a covering code: the perfect Hamming
code of 31 bits (radius 1: every 31-bit word is a codeword or one bit from one) and the last
bit as it is. A fingerprint goes to every anchor within covering radius plus threshold,
1 + 1 = 2, of its half: at most 17. Two fingerprints that differ in at most 1 bit there meet at
the nearest anchor of either. All fingerprints of one anchor are compared.

Plan: texts to fingerprints in one narrow pass, written as (id, fingerprint); equal
fingerprints become one row before anything is replicated, so copies cost nothing. An anchor's
fingerprints are linked by a search that looks only at those not reached yet and yields a
spanning forest: as many links as fingerprints at most, never all pairs. An anchor with more
than `hot` fingerprints is not gathered: its rows are dealt again by the bytes of the other
half, of which one must be equal, and the search of a large group goes by 16-bit blocks, of
which one must be equal too. Components come from rounds of links to the smallest neighbour,
each written to the shared folder; nothing is collected on the driver. Where a fingerprint,
a node or a component has more than `hub` rows of a join, its one answer is broadcast (there
are few such) and its rows stay where they are.

Defined results: a text without words, empty or null has fingerprint zero and links like any
other. Ids are cast to long. Repeated rows each give a row. Null ids take part; a component's id
is its smallest non-null id. Of each component `first_of_groups` keeps the row of the smallest
id, null last, then of the smallest hash of the text; of rows equal in id and text the least in
its other columns, which must have an order. Empty tables give no rows. Other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlume.llm.shared import join_hot, short_batches, written

SEED = 42
THRESHOLD = 3


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(joined)]
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(words) - k + 1
    for i in range(0, n, 1 << 16):
        pairs = zip(starts[i : min(n, i + (1 << 16))], ends[i + k - 1 : min(n, i + (1 << 16)) + k - 1], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _fingerprinter(shingle: int):
    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found.view(np.int64))], names=["id", "key", "fp"])

    return run


def syndromes(x: np.ndarray) -> np.ndarray:
    """Of 31-bit words: the place (1 to 31) of the bit to flip for the nearest codeword, 0 in the code."""
    out = np.zeros(len(x), np.int64)
    for place in range(1, 32):
        out ^= np.where((x >> (place - 1)) & 1, place, 0)
    return out


def anchors_of(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor within distance 2 of each 32-bit half."""
    word, last = half & 0x7FFFFFFF, half >> 31
    s = syndromes(word)
    flip = lambda place: np.where(place > 0, np.int64(1) << np.maximum(place - 1, 0), 0)
    near = word ^ flip(s)
    every = np.arange(len(half))
    rows, anchors = [every, every], [near | (last << 31), near | ((1 - last) << 31)]
    for i in range(1, 32):
        j = i ^ s
        ok = (s > 0) & (j > i) & (j != s) & (i != s)
        rows.append(every[ok])
        anchors.append((word ^ (1 << (i - 1)) ^ flip(j))[ok] | (last[ok] << 31))
    return np.concatenate(rows), np.concatenate(anchors)


def _replicator(batches):
    for batch in batches:
        whole = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(whole), 1 << 14):
            fp = whole[at : at + (1 << 14)]
            bits = fp.view(np.uint64)
            for half in (0, 1):
                rows, anchors = anchors_of(((bits >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(anchors * 2 + half), pa.array(np.zeros(len(rows), np.int16)), pa.array(fp[rows])], names=["anchor", "sub", "fp"])


def forest(fps: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, as pairs of places."""
    rest, links = np.arange(len(fps)), []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= threshold
            if near.any():
                got = rest[near]
                links += [(at, int(x)) for x in got]
                queue += got.tolist()
                rest = rest[~near]
    return links


def linked_pairs(fps: np.ndarray, threshold: int, many: int = 8192) -> Iterator[np.ndarray]:
    """Arrays of (a, b), indices into distinct fps, that connect what is linked. Of many
    fingerprints only those equal in one of threshold + 1 blocks of bits are compared."""
    if len(fps) <= many:
        yield np.array(forest(fps, threshold), np.int64).reshape(-1, 2)
        return
    edges = [64 * i // (threshold + 1) for i in range(threshold + 2)]
    for low, high in zip(edges, edges[1:], strict=False):
        block = (fps >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        order = np.argsort(block, kind="stable")
        heads = np.flatnonzero(np.diff(block[order], prepend=~block[order[0]]))
        for group in np.split(order, heads[1:]):
            if len(group) > 1:
                yield group[np.array(forest(fps[group], threshold), np.int64).reshape(-1, 2)]


def _linker(threshold: int, hot: int, split: bool):
    """Over rows sorted by (anchor, sub): links, and the rows of hot anchors to be dealt again."""

    def out(a, b, sub) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), pa.array(np.asarray(sub, np.int16))], names=["a", "b", "sub"])

    def again(anchor: int, fps: np.ndarray) -> pa.RecordBatch:
        other = (fps.view(np.uint64) >> np.uint64(0 if anchor & 1 else 32)) & np.uint64(0xFFFFFFFF)
        subs = [1 + 256 * i + ((other >> np.uint64(8 * i)) & np.uint64(255)).astype(np.int64) for i in range(4)]
        return out(np.full(4 * len(fps), anchor), np.tile(fps, 4), np.concatenate(subs))

    def linked(fps: np.ndarray):
        fps = np.unique(fps)
        for pairs in linked_pairs(fps.view(np.uint64), threshold):
            x, y = pairs.T
            if len(x):
                yield out(np.minimum(fps[x], fps[y]), np.maximum(fps[x], fps[y]), np.zeros(len(x)))

    def run(batches):
        held: list[np.ndarray] = []
        held_key, held_n, flooded = None, 0, False
        for batch in batches:
            anchor, sub, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "sub", "fp"))
            if not len(anchor):
                continue
            heads = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (sub[1:] != sub[:-1])]))
            tails = np.append(heads[1:], len(anchor))
            alone = tails - heads == 1
            if len(heads) > 2:  # lone fingerprints inside the batch have nothing to meet
                inner = np.ones(len(heads), bool)
                inner[1:-1] = ~alone[1:-1]
                heads, tails = heads[inner], tails[inner]
            for lo, hi in zip(heads.tolist(), tails.tolist(), strict=True):
                key = (int(anchor[lo]), int(sub[lo]))
                if key != held_key:
                    if held_n > 1 and not flooded:
                        yield from linked(np.concatenate(held))
                    held, held_key, held_n, flooded = [], key, 0, False
                held_n += hi - lo
                held.append(fp[lo:hi])
                if split and held_n > hot:
                    flooded = True
                    yield again(key[0], np.concatenate(held))
                    held = []
        if held_n > 1 and not flooded:
            yield from linked(np.concatenate(held))

    return run


def _starred(batches):
    """Links of one task as stars: each fingerprint to the smallest it reaches in a run of batches."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := above.get(x, x)) != x:
            above[x] = above.get(p, p)
            x = above[x]
        return x

    def emit():
        pairs = [(x, root(x)) for x in list(above)]
        pairs = [(x, r) for x, r in pairs if x != r]
        above.clear()
        if pairs:
            x, r = zip(*pairs, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(r, pa.int64())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
                above.setdefault(min(a, b), min(a, b))
        if len(above) > 200_000 and (found := emit()):
            yield found
    if found := emit():
        yield found


def components(links: DataFrame, rounds: int = 200, hub: int = 10_000) -> DataFrame:
    """(u, v): every linked node but the smallest of its component, and that smallest node.

    links: (a, b). Alternates linking larger neighbours, then all neighbours, to the smallest
    one; every round is a checkpoint in the shared folder. The rounds grow with the logarithm
    of a component's diameter.
    """
    edges = links.select("a", "b").mapInArrow(_starred, "u long, v long").distinct()
    edges = edges.checkpoint()
    seen, n = None, edges.count()
    for _ in range(rounds):
        # large star: the larger neighbours of u go to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("least"), F.count_if(F.col("v") > F.col("u")).alias("n")).withColumn("least", F.least("u", "least"))
        large = join_hot(both.where("v > u"), low, "u", n, hub).select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest neighbour
        down = large.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n"))
        small = join_hot(large, down, "u", n, hub).select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v")
        edges = small.unionByName(down.select("u", F.col("least").alias("v"))).distinct().checkpoint()
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)), F.count_distinct("u")).first()
        if seen == now[:2] and now[0] == now[2]:
            return edges
        seen, n = now[:2], now[0]
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def link_fingerprints(prints: DataFrame, *, threshold: int = THRESHOLD, hot: int = 50_000) -> DataFrame:
    """(a, b), a < b: links among the distinct values of prints.fp that connect what any
    differing in `threshold` bits or fewer connects. threshold: at most 3, as the cover assumes."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"threshold must be 0 to {THRESHOLD}")
    row = "a long, b long, sub short"
    near = prints.select("fp").mapInArrow(_replicator, "anchor long, sub short, fp long")
    found = written(near.repartition("anchor").sortWithinPartitions("anchor", "sub").mapInArrow(_linker(threshold, hot, True), row), "links")
    links = found.where("sub = 0").select("a", "b")
    deferred = found.where("sub > 0")
    if deferred.limit(1).count():
        dealt = deferred.select(F.col("a").alias("anchor"), "sub", F.col("b").alias("fp"))
        more = written(dealt.repartition("anchor", "sub").sortWithinPartitions("anchor", "sub").mapInArrow(_linker(threshold, hot, False), row), "links")
        links = links.unionByName(more.select("a", "b"))
    return links


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, threshold: int, hot: int, hub: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key of the text, fp), and for each fingerprint (fp, n rows, least id, first
    row, root: the smallest fingerprint that links reach)."""
    short_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("body"))
    each = written(own.mapInArrow(_fingerprinter(shingle), "id long, key long, fp long"), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    groups = written(each.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("least"), first.alias("first")), "distinct")
    stars = components(link_fingerprints(groups, threshold=threshold, hot=hot), hub=hub)
    return each, groups.join(stars, groups.fp == stars.u, "left").select("fp", "n", "least", "first", F.coalesce("v", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = THRESHOLD, hot: int = 50_000, hub: int = 10_000) -> DataFrame:
    """Per document row: its id, fingerprint (16 hexadecimal digits) and component_id, the
    smallest id among the documents that links reach."""
    each, member = _grouped(docs, id_col, text_col, shingle, threshold, hot, hub)
    member = written(member.select("fp", "n", "least", "root"), "members")
    lowest = member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = join_hot(member.select("fp", "root", F.col("n").alias("rows")), lowest, "root", member.count(), hub).select("fp", "component_id", F.col("rows").alias("n"))
    return join_hot(each.select("id", "fp"), named, "fp", each.count(), hub).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = THRESHOLD, hot: int = 50_000, hub: int = 10_000) -> DataFrame:
    """One row of each component, with all columns of docs."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names, strict=True))
    each, member = _grouped(docs, id_col, text_col, shingle, threshold, hot, hub)
    firsts = written(member.groupBy("root").agg(F.min("first").alias("f")).select("f.id", "f.key"), "firsts")
    rows = docs.toDF(*names)
    one, key = rows[own[id_col]].cast("long"), F.xxhash64(rows[own[text_col]])
    found = rows.join(firsts, one.eqNullSafe(firsts["id"]) & (key == firsts["key"]), "left_semi")
    repeated = written(each.groupBy("id", "key").count().where("count > 1").select("id", "key"), "repeated")
    if repeated.limit(1).count():  # of rows equal in id and text one stays; a hot one is one row for each task
        again = one.eqNullSafe(repeated["id"]) & (key == repeated["key"])
        least = found.join(repeated, again, "left_semi").groupBy(one.alias("id"), key.alias("key")).agg(F.min(F.struct(*names)).alias("r")).select("r.*")
        found = found.join(repeated, again, "left_anti").unionByName(least)
    return found.select(*names).toDF(*docs.columns)
