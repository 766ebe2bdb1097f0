"""Quality rules with cross-document line frequency.

Base rules are counts over one text. The method hashes every line with a word, normalised
(A-Z to lower case, digits alike, runs of space as one), counts the distinct documents of a
host that hold it, removes lines above the host's limit, max(`min_docs`, `share` of its
documents), and rejects a document of whose words less than `left` remains. Documents are
told apart by their text, so that exact copies don't raise a line above the limit.

`judge_quality` gives the verdicts; `clean_documents` the kept documents without the removed
lines.

Plan: one pass reads the texts and writes counts and line hashes; all that follows works on
this small table. Cleaning meets the texts with the small table in one join on (id, host, hash
of the text), so a hot host is spread. Distinct counting spreads over (host, line, document) before it adds up by
line, so a very common line or host never lands in one task.

Defined results: a null or empty text has no words and fails the base rules. A null host is
the host "". Repeated rows each give a row; rows of one id and different texts are judged apart.
Lines without a word are never removed. Empty tables give no rows. Other columns are not looked
at and stay as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlume.llm import textbytes as tb
from ledgerlume.llm.shared import short_batches, written

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"


def folded_table() -> np.ndarray:
    """Lower case, and every digit as 0."""
    out = tb.lower_table()
    out[0x30:0x3A] = 0x30
    return out


def _distinct_per(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each owner has."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    return np.bincount(o[new], minlength=n)


def _repeated(hashes: np.ndarray, words: tb.Spans) -> np.ndarray:
    """Words in windows of three that the text has twice or more."""
    n_texts = len(words.first) - 1
    inside = np.zeros(len(hashes), bool)
    grams = tb.gram_hashes(hashes, 3)
    if len(grams):
        of = np.repeat(np.arange(n_texts), np.diff(words.first))
        own = np.flatnonzero(of[: len(grams)] == of[2:])
        keys = tb.mixed(grams[own] ^ tb.mixed(of[own].astype(np.uint64)))
        order = np.argsort(keys)
        k = keys[order]
        same = k[1:] == k[:-1]
        twice = np.zeros(len(k), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = own[order[twice]]
        for j in range(3):
            inside[at + j] = True
    return tb.per_text(inside, words.first)


def measure(texts: tb.Texts) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The counts; text hashes; offsets, hashes, words and numbers of the lines that have a word."""
    data, offsets, values = texts.data, texts.offsets, tb.byte_values()
    n = len(offsets) - 1
    words = tb.words_of(texts, tb.NOT_SPACE)
    hashes = tb.span_hashes(data, words.starts, words.ends, values)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    lead = tb.NOT_SPACE & ~tb.table((0x80, 0xBF))
    lines = tb.lines_of(texts)
    first = np.searchsorted(words.starts, np.append(lines.starts, len(data)))
    line_words = np.searchsorted(words.starts, lines.ends) - first[:-1]
    has = line_words > 0
    owner = np.repeat(np.arange(n), np.diff(lines.first))
    exact = tb.span_hashes(data, lines.starts, lines.ends, values)
    n_lines = np.bincount(owner[has], minlength=n)
    counts = {
        "n_words": np.diff(words.first),
        "word_chars": tb.per_text(lead[data], offsets),
        "n_symbols": tb.per_text(symbol[data], offsets),
        "n_dup_lines": n_lines - _distinct_per(owner[has], exact[has], n),
        "n_repeat_words": _repeated(hashes, words),
    }
    folded = tb.span_hashes(folded_table()[data], words.starts, words.ends, values)
    bounds = np.append(first[:-1], len(words.starts))
    normal = tb.run_hashes(folded, bounds)
    whole = tb.run_hashes(exact, lines.first)
    number = np.arange(len(owner)) - lines.first[owner]
    return counts, whole, np.append(0, np.cumsum(n_lines)), normal[has], line_words[has], number[has]


def _measurer(batches):
    for batch in batches:
        cols: dict[str, list[np.ndarray]] = {c: [] for c in COUNTS}
        whole, lists, offsets, base = [], ([], [], []), [np.zeros(1, np.int64)], 0
        for _, _, texts in tb.texts_of(batch.column(3)):
            counts, w, off, *found = measure(texts)
            for c in COUNTS:
                cols[c].append(counts[c])
            whole.append(w)
            for own, x in zip(lists, found, strict=True):
                own.append(x)
            offsets.append(off[1:] + base)
            base += off[-1]
        if not whole:
            continue
        off = pa.array(np.concatenate(offsets), pa.int32())
        hashes, sizes, numbers = map(np.concatenate, lists)
        listed = [(hashes.view(np.int64), pa.int64()), (sizes, pa.int64()), (numbers, pa.int32())]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(np.concatenate(whole).view(np.int64))] + [pa.array(np.concatenate(cols[c]), pa.int64()) for c in COUNTS] + [pa.ListArray.from_arrays(off, pa.array(x, k)) for x, k in listed],
            names=["id", "host", "key", "body", *COUNTS, "lines", "sizes", "numbers"],
        )


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, min_words: int, repeat_share: int, min_docs: int, share: float, left: float) -> DataFrame:
    """Per document row: id, host, key (of the text), counts, verdicts and the numbers, from 0,
    of the lines to remove (null where there is none)."""
    short_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("body"))
    kind = own.schema["id"].dataType.simpleString()
    schema = f"id {kind}, host string, key long, body long, {', '.join(f'{c} long' for c in COUNTS)}, lines array<long>, sizes array<long>, numbers array<int>"
    each = written(own.mapInArrow(_measurer, schema).withColumn("row", F.monotonically_increasing_id()), "quality")
    lines = each.select("row", "host", "body", F.explode(F.arrays_zip("lines", "sizes", "numbers")).alias("l")).select("row", "host", "body", F.col("l.lines").alias("line"), F.col("l.sizes").alias("size"), F.col("l.numbers").alias("number"))
    totals = each.groupBy("host").agg(F.count_distinct("body").alias("docs"))
    common = lines.groupBy("host", "line").agg(F.count_distinct("body").alias("n")).where(F.col("n") > min_docs)
    above = common.join(totals, "host").where(F.col("n") > share * F.col("docs")).select("host", "line")
    removed = lines.join(above, ["host", "line"]).groupBy("row").agg(F.sum("size").alias("removed"), F.collect_list("number").alias("gone"))
    n = F.col("n_words")
    failed = (n < min_words) | (100 * F.col("n_repeat_words") > repeat_share * n)
    lost = F.coalesce("removed", F.lit(0)).cast("long")
    return each.join(removed, "row", "left").select(
        "id", "host", "key", *COUNTS, failed.alias("base_failed"), lost.alias("removed_words"), (~failed & ((lost == 0) | (n - lost >= left * n))).alias("kept"), "gone",
    )


def judge_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_words: int = 50, repeat_share: int = 50, min_docs: int = 20, share: float = 0.1, left: float = 0.3) -> DataFrame:
    """Per document row: its id, the base counts, base_failed, removed_words and kept.

    min_words and repeat_share (percent) are the base rules; min_docs, share and left the
    limits of the line rule described above.
    """
    found = _judged(docs, id_col, text_col, host_col, min_words, repeat_share, min_docs, share, left)
    return found.select(F.col("id").alias(id_col), *COUNTS, "base_failed", "removed_words", "kept")


def clean_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", size_col: str | None = None, min_words: int = 50, repeat_share: int = 50, min_docs: int = 20, share: float = 0.1, left: float = 0.3) -> DataFrame:
    """The kept document rows, with all their columns; their texts without the removed lines.

    size_col: a column that holds the number of characters; it is set anew where lines go.
    """
    names = [f"__c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names, strict=True))
    kept = _judged(docs, id_col, text_col, host_col, min_words, repeat_share, min_docs, share, left).where("kept").select("id", "host", "key", "gone").dropDuplicates(["id", "host", "key"])
    rows, text = docs.toDF(*names), own[text_col]
    same = rows[own[id_col]].eqNullSafe(kept["id"]) & (F.coalesce(rows[own[host_col]].cast("string"), F.lit("")) == kept["host"]) & (F.xxhash64(rows[text]) == kept["key"])
    changed = F.col("gone").isNotNull()
    stays = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("gone", i))
    out = rows.join(kept, same).withColumn(text, F.when(changed, F.array_join(stays, "\n")).otherwise(F.col(text)))
    if size_col is not None:
        size = own[size_col]
        out = out.withColumn(size, F.when(changed, F.length(text).cast(rows.schema[size].dataType)).otherwise(F.col(size)))
    return out.select(*names).toDF(*docs.columns)
