"""Benchmark decontamination by winnowing.

Both sides keep the smallest hash of every sliding window of word k-grams. A span of
`window` words that a document shares with an item holds one whole such sliding window, so
both sides keep the same gram of it: no shared span of that length is missed. Fingerprints
found on both sides are extended word by word and confirmed on the bytes.

Plan: a benchmark of at most `block_bytes` of text is an index (a few times its bytes) that is
broadcast; the documents stream past it and nothing is shuffled. A larger one is a join of
fingerprints: both sides write theirs as rows (hash, hash of the text, place), those of the
documents that the benchmark has too are kept, and the windows around them meet the windows
of the items in a join on their words. Texts are read again only where a fingerprint hit, once
for all copies of a text. What a very common window or fingerprint has is split: its rows stay
where they are, or are salted.

Defined results: a null or empty text has no words and no hits. Repeated document rows each
give a row. Items without words are left out; rows that share an item_id are one item; an
item whose id is null marks words but is not listed. Empty tables give zero hits or no rows.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlume.llm import textbytes as tb
from ledgerlume.llm.shared import join_hot, short_batches, written

FOUND = ("__n_words", "__spans", "__item_ids")
RESULT = "__n_words long, __spans array<struct<start:int,end:int>>, __item_ids array<string>"


def _chosen(grams: np.ndarray, first: np.ndarray, window: int, k: int) -> np.ndarray:
    """Places of the leftmost smallest gram of each window of words inside one text."""
    n = len(grams)
    width = window - k + 1
    m = n - width + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    lowest, at = grams[:m].copy(), np.zeros(m, np.int16)
    for j in range(1, width):
        less = grams[j : j + m] < lowest
        lowest[less] = grams[j : j + m][less]
        at[less] = j
    ends = np.repeat(first[1:], np.diff(first))[:m]
    valid = np.arange(m) + window <= ends
    keep = np.zeros(n, bool)
    keep[(np.arange(m) + at)[valid]] = True
    return np.flatnonzero(keep)


def _around(hashes: np.ndarray, places: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, reach: int, absent: int) -> np.ndarray:
    """Hashes of the `reach` words left (nearest first) and right of each gram; `absent` beyond the text."""
    out = np.full((len(places), 2 * reach), absent, np.uint64)
    for j in range(1, reach + 1):
        left, right = places - j, places + k - 1 + j
        ok = left >= low
        out[ok, j - 1] = hashes[left[ok]]
        ok = right < high
        out[ok, reach + j - 1] = hashes[right[ok]]
    return out


def _texts(rows: list[bytes]) -> tb.Texts:
    offsets = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    return tb.Texts(np.frombuffer(b"".join(rows), np.uint8), offsets)


def build_index(items: list[tuple[str | None, str]], window: int, gram: int) -> list[dict]:
    """The fingerprints of a block of items, by the length of their windows (shorter for items
    of fewer words). Equal surroundings are one entry that lists its items."""
    kept: dict[int, list[tuple[str | None, bytes]]] = {}
    member, lower = tb.ALNUM, tb.lower_table()
    for name, text in items:
        data = lower[np.frombuffer((text or "").encode(), np.uint8)]
        one = tb.Texts(data, np.array([0, len(data)]))
        n = len(tb.words_of(one, member).starts)
        if n:
            kept.setdefault(min(window, n), []).append((name, data.tobytes()))
    out = []
    for length, own in sorted(kept.items()):
        texts = _texts([x for _, x in own])
        words = tb.words_of(texts, member)
        hashes = tb.span_hashes(texts.data, words.starts, words.ends, tb.byte_values())
        k = min(gram, length)
        reach = length - k
        grams = tb.gram_hashes(hashes, k)
        places = _chosen(grams, words.first, length, k)
        of = np.searchsorted(words.first, places, "right") - 1
        around = _around(hashes, places, words.first[of], words.first[of + 1], k, reach, 0)
        rows, inverse = np.unique(np.column_stack([grams[places], around]), axis=0, return_inverse=True)
        inverse = inverse.reshape(-1)
        spelt = texts.data.tobytes()
        names: list[list[str]] = [[] for _ in rows]
        seen: list[tuple[list[bytes], int] | None] = [None] * len(rows)
        for i, at, item in zip(inverse.tolist(), places.tolist(), of.tolist(), strict=True):
            if own[item][0] is not None:
                names[i].append(own[item][0])
            if seen[i] is None:
                lo, hi = max(at - reach, int(words.first[item])), min(at + k + reach, int(words.first[item + 1]))
                seen[i] = ([spelt[a:b] for a, b in zip(words.starts[lo:hi].tolist(), words.ends[lo:hi].tolist(), strict=True)], at - lo)
        heads = np.unique(rows[:, 0], return_index=True)
        out.append({"length": length, "k": k, "reach": reach, "fp": heads[0], "from": np.append(heads[1], len(rows)), "around": rows[:, 1:], "names": [sorted(set(x)) for x in names], "words": seen})
    return out


def _hits(texts: tb.Texts, data: np.ndarray, index: list[dict], values: np.ndarray) -> tuple[tb.Spans, list[tuple[int, int, list[str]]]]:
    """(first word, end word, items) of confirmed spans, words counted over all texts."""
    words = tb.words_of(tb.Texts(data, texts.offsets), tb.ALNUM)
    hashes = tb.span_hashes(data, words.starts, words.ends, values)
    found = []
    for part in index:
        length, k, reach = part["length"], part["k"], part["reach"]
        grams = tb.gram_hashes(hashes, k)
        places = _chosen(grams, words.first, length, k)
        if not len(places) or not len(part["fp"]):
            continue
        slot = np.searchsorted(part["fp"], grams[places])
        slot[slot == len(part["fp"])] = 0
        hit = part["fp"][slot] == grams[places]
        places, slot = places[hit], slot[hit]
        n = part["from"][slot + 1] - part["from"][slot]
        if not len(n):
            continue
        entry = np.repeat(part["from"][slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        places = np.repeat(places, n)
        of = np.searchsorted(words.first, places, "right") - 1
        same = _around(hashes, places, words.first[of], words.first[of + 1], k, reach, 1) == part["around"][entry]
        run = np.logical_and.accumulate
        left = run(same[:, :reach], axis=1).sum(axis=1) if reach else np.zeros(len(places), int)
        right = run(same[:, reach:], axis=1).sum(axis=1) if reach else np.zeros(len(places), int)
        long = left + k + right >= length
        for at, e, a, b in zip(places[long].tolist(), entry[long].tolist(), left[long].tolist(), right[long].tolist(), strict=True):
            spelt, gram_at = part["words"][e]
            lo, hi = at - a, at + k + b
            mine = [data[s:t].tobytes() for s, t in zip(words.starts[lo:hi].tolist(), words.ends[lo:hi].tolist(), strict=True)]
            if mine == spelt[gram_at - a : gram_at + k + b]:
                found.append((lo, hi, part["names"][e]))
    return words, found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scanner(index_of, text_col: str, carried: list[str]):
    def scan(batches):
        lower, values = tb.lower_table(), tb.byte_values()
        index = index_of.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            n_words, spans, items = [], [], []
            for i, j, texts in tb.texts_of(column):
                words, found = _hits(texts, lower[texts.data], index, values)
                own: list[tuple[list, set]] = [([], set()) for _ in range(j - i)]
                if found:
                    of = np.searchsorted(words.first, [x[0] for x in found], "right") - 1
                    for d, (a, b, names) in zip(of.tolist(), found, strict=True):
                        own[d][0].append((a - int(words.first[d]), b - int(words.first[d])))
                        own[d][1].update(names)
                n_words += np.diff(words.first).tolist()
                spans += [_merged(x) for x, _ in own]
                items += [sorted(x) for _, x in own]
            pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            found_columns = [pa.array(n_words, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(pair)), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in carried] + found_columns, names=[*carried, *FOUND])

    return scan


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, gram: int = 5, block_bytes: int = 8 << 20) -> DataFrame:
    """Per document row: its id, n_words, the merged spans of words that lie in a shared
    window, and the sorted ids of the items that have such a window."""
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    found = _matched(own, benchmark, "__text", ["__id"], item_col, item_text_col, window, gram, block_bytes)
    return found.toDF(id_col, *(c[2:] for c in FOUND))


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, gram: int = 5, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs, with all their columns, that share no window with an item. The rows
    stream through the match, so nothing is joined or shuffled."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    found = _matched(docs.toDF(*names), benchmark, text, names, item_col, item_text_col, window, gram, block_bytes)
    return found.where(F.size(FOUND[1]) == 0).select(*names).toDF(*docs.columns)


def _matched(current: DataFrame, benchmark: DataFrame, text_col: str, wanted: list[str], item_col: str, item_text_col: str, window: int, gram: int, block_bytes: int) -> DataFrame:
    """The wanted columns of current and those of FOUND."""
    spark = current.sparkSession
    short_batches(spark)
    tests = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("body")).where(F.col("body").isNotNull())
    total = tests.agg(F.sum(F.octet_length("body") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    if total > block_bytes:
        return _joined(current, tests, text_col, wanted, window, gram)
    kinds = {f.name: f.dataType.simpleString() for f in current.schema.fields}
    index = spark.sparkContext.broadcast(build_index([(r["item"], r["body"]) for r in tests.collect()], window, gram))
    return current.mapInArrow(_scanner(index, text_col, wanted), ", ".join(f"{c} {kinds[c]}" for c in wanted) + ", " + RESULT)


def _each(batch, place: int) -> Iterator[tuple[int, tb.Texts, tb.Spans]]:
    """(row, bytes in lower case, words) of each text of a batch."""
    lower = tb.lower_table()
    for i, x in enumerate(batch.column(place)):
        data = lower[np.frombuffer((x.as_py() or "").encode(), np.uint8)]
        one = tb.Texts(data, np.array([0, len(data)]))
        yield i, one, tb.words_of(one, tb.ALNUM)


def _prints(one: tb.Texts, words: tb.Spans, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of one text's fingerprints for windows of `length` words."""
    k = min(gram, length)
    grams = tb.gram_hashes(tb.span_hashes(one.data, words.starts, words.ends, tb.byte_values()), k)
    places = _chosen(grams, words.first, length, k)
    return grams[places].view(np.int64), places


def _item_prints(window: int, gram: int):
    def run(batches):
        for batch in batches:
            for _, one, words in _each(batch, 1):
                if n := len(words.starts):
                    prints, _ = _prints(one, words, min(window, n), gram)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(prints), min(window, n), np.int32)), pa.array(prints)], names=["length", "print"])

    return run


def _spelt(one: tb.Texts, words: tb.Spans) -> list[bytes]:
    whole = one.data.tobytes()
    return [whole[a:b] for a, b in zip(words.starts.tolist(), words.ends.tolist(), strict=True)]


def _item_windows(window: int):
    def run(batches):
        for batch in batches:
            for i, one, words in _each(batch, 1):
                own = _spelt(one, words)
                if n := min(window, len(own)):
                    wins = [b" ".join(own[a : a + n]) for a in range(len(own) - n + 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(wins, pa.binary()), batch.column(0).take(pa.array([i] * len(wins), pa.int64()))], names=["win", "item"])

    return run


def _text_prints(lengths: list[int], gram: int):
    def run(batches):
        for batch in batches:
            for i, one, words in _each(batch, 1):
                for length in lengths:
                    prints, places = _prints(one, words, length, gram)
                    if len(prints):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(prints), pa.int64())), pa.array(np.full(len(prints), length, np.int32)), pa.array(prints), pa.array(places.astype(np.int32))], names=["text", "length", "print", "place"])

    return run


def _windows_around(gram: int):
    """The windows of a text that hold a fingerprint of marks."""

    def run(batches):
        for batch in batches:
            marks = batch.column(2).to_pylist()
            for i, one, words in _each(batch, 1):
                own, starts = _spelt(one, words), set()
                for m in marks[i]:
                    n, at = m["length"], m["place"]
                    starts.update((a, n) for a in range(max(0, at + min(gram, n) - n), min(at, len(own) - n) + 1))
                rows = sorted(starts)
                wins = pa.array([b" ".join(own[a : a + n]) for a, n in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(rows), pa.int64())), pa.array([a for a, _ in rows], pa.int32()), pa.array([a + n for a, n in rows], pa.int32()), wins], names=["text", "start", "end", "win"])

    return run


def _counter(batches):
    for batch in batches:
        n = [len(words.starts) for _, _, words in _each(batch, 0)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64())], names=[*batch.schema.names[1:], FOUND[0]])


def _merger(batches):
    for batch in batches:
        spans = [[{"start": a, "end": b} for a, b in _merged([(x["start"], x["end"]) for x in own])] for own in batch.column(1).to_pylist()]
        pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(pair)), batch.column(2)], names=["text", *FOUND[1:]])


def _joined(current: DataFrame, tests: DataFrame, text_col: str, wanted: list[str], window: int, gram: int, salts: int = 32, hot: int = 1000) -> DataFrame:
    """_matched() by a join of fingerprints. A text is known by its MD5; what is found depends on
    the text alone."""
    own_key = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    prints = written(tests.mapInArrow(_item_prints(window, gram), "length int, print long").distinct(), "item-prints")
    lengths = sorted(r["length"] for r in prints.select("length").distinct().collect())  # window of them at most
    wins = written(tests.mapInArrow(_item_windows(window), "win binary, item string").groupBy("win").agg(F.array_sort(F.collect_set("item")).alias("items")), "item-windows")
    texts = current.select(own_key.alias("text"), F.col(text_col).cast("string").alias("body"))
    rows = texts.mapInArrow(_text_prints(lengths, gram), "text binary, length int, print long, place int").withColumn("salt", F.pmod(F.xxhash64("text", "place"), F.lit(salts)))
    salted = prints.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    marks = rows.join(salted, ["length", "print", "salt"], "left_semi").groupBy("text").agg(F.collect_set(F.struct("length", "place")).alias("marks"))
    hit = texts.join(marks.select("text"), "text", "left_semi").groupBy("text").agg(F.first("body").alias("body")).join(marks, "text")
    around = written(hit.select("text", "body", "marks").mapInArrow(_windows_around(gram), "text binary, start int, end int, win binary"), "windows")
    counts = around.groupBy("win").agg(F.count("*").alias("n"))
    met = join_hot(around, written(wins.join(counts, "win"), "met"), "win", around.count(), hot)
    grouped = met.groupBy("text").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    pair = "array<struct<start:int,end:int>>"
    found = written(grouped.select("text", "spans", "items").mapInArrow(_merger, f"text binary, {FOUND[1]} {pair}, {FOUND[2]} array<string>"), "found")

    kinds = {f.name: f.dataType.simpleString() for f in current.schema.fields}
    counted = current.select(F.col(text_col).cast("string").alias("__body"), own_key.alias("__key"), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).alias("__salt"), *wanted).mapInArrow(_counter, ", ".join(["__key binary", "__salt long", *(f"{c} {kinds[c]}" for c in wanted)]) + f", {FOUND[0]} long")
    copies = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    with_found = counted.join(copies, (F.col("__key") == F.col("text")) & (F.col("__salt") == F.col("salt")), "left")
    return with_found.select(*wanted, FOUND[0], F.coalesce(FOUND[1], F.array().cast(pair)).alias(FOUND[1]), F.coalesce(FOUND[2], F.array().cast("array<string>")).alias(FOUND[2]))


def contaminated_digest(found: DataFrame) -> DataFrame:
    """The counts that describe decontaminate()'s rows."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
