"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (words and pairs of words or punctuation runs, in
`buckets` classes, add-one smoothed) are fitted: of the target texts and of all raw texts. A
document's log weight is the mean log ratio of its n-grams times `length`: the importance
weight of a text of that many n-grams, so that short and long texts are alike. Gumbel top-k
draws k documents without replacement in proportion to their weights: the k largest of log
weight plus Gumbel noise that depends on id, text and seed alone.

Plan: two narrow passes over the texts. The first adds the counts of each task up into one
vector of `buckets` numbers, the second scores against the log ratios (as many numbers,
broadcast). The k-th largest is found by radix selection on the written scores: histograms of
65,536 classes, never a sort in one task nor a collected table.

Defined results: the target is labelled quality 1 and not toxic, `target_rows` ids at most,
chosen by hash of the id, a bound on the fitting sample. Counts of raw text cover all rows.
Texts without n-grams (null, empty, spaces) have weight zero (log weight null, never
selected). Ties at the k-th place are all selected, as are rows equal in id and text
together. Without labels or documents the ratio is one. Ids are cast to long. Other columns
are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlume.llm import textbytes as tb
from ledgerlume.llm.shared import short_batches, written


def classes() -> np.ndarray:
    """0: space and control, 1: word, 2: other visible."""
    out = np.full(256, 2, np.uint8)
    out[:33] = 0
    out[127] = 0
    out[tb.ALNUM] = 1
    return out


def tokens_of(texts: tb.Texts) -> tb.Spans:
    """Words and runs of punctuation in order."""
    both = [tb.words_of(texts, classes() == c) for c in (1, 2)]
    starts = np.concatenate([x.starts for x in both])
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    return tb.Spans(starts, np.concatenate([x.ends for x in both])[order], np.searchsorted(starts, texts.offsets))


def grams_of(texts: tb.Texts, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram."""
    lowered = tb.Texts(tb.lower_table()[texts.data], texts.offsets)
    tokens = tokens_of(lowered)
    hashes = tb.span_hashes(lowered.data, tokens.starts, tokens.ends, tb.byte_values())
    of = np.repeat(np.arange(len(texts.offsets) - 1), np.diff(tokens.first))
    pairs = tb.gram_hashes(hashes, 2)
    within = of[: len(pairs)] == of[1 : len(pairs) + 1]
    return np.concatenate([of, of[: len(pairs)][within]]), (np.concatenate([hashes, pairs[within]]) % np.uint64(buckets)).astype(np.int64)


def _counter(targets, buckets: int):
    def count(batches):
        chosen = targets.value
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            good = np.isin(ids, chosen) & ~np.asarray(batch.column(0).is_null())
            for i, j, texts in tb.texts_of(batch.column(1)):
                of, bucket = grams_of(texts, buckets)
                total[1] += np.bincount(bucket, minlength=buckets)
                total[0] += np.bincount(bucket[good[i:j][of]], minlength=buckets)
        used = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], names=["bucket", "target", "raw"])

    return count


def _scorer(ratio, length: int):
    def score(batches):
        logs = ratio.value
        for batch in batches:
            out = []
            for i, j, texts in tb.texts_of(batch.column(1)):
                of, bucket = grams_of(texts, len(logs))
                n = np.bincount(of, minlength=j - i)
                with np.errstate(invalid="ignore", divide="ignore"):
                    out.append(np.round(length * np.bincount(of, logs[bucket], minlength=j - i) / n, 9))
            values = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(values, mask=np.isnan(values))], names=["id", "body", "log_weight"])

    return score


def gumbel_top(scored: DataFrame, k: int) -> DataFrame:
    """scored (id, body, place long: larger is better, null never) with selected."""
    prefix, above = 0, 0
    ranked = F.col("place").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))  # as unsigned bits
    for level in range(4):
        shift = 48 - 16 * level
        part = F.shiftrightunsigned(ranked, shift).bitwiseAND(F.lit(0xFFFF).cast("long"))
        same = F.lit(True) if level == 0 else F.shiftrightunsigned(ranked, shift + 16) == F.lit(prefix)
        rows = scored.where(F.col("place").isNotNull() & same).groupBy(part.alias("part")).count().collect()
        for r in sorted(rows, key=lambda r: -r["part"]):
            if above + r["count"] >= k:
                prefix = (prefix << 16) | r["part"]
                break
            above += r["count"]
        else:
            return scored.withColumn("selected", F.col("place").isNotNull())
    return scored.withColumn("selected", F.coalesce(F.col("place") >= F.lit(prefix ^ (1 << 63) if prefix >= 1 << 63 else prefix - (1 << 63)), F.lit(False)))


def resample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: float | None = None, buckets: int = 10_000, length: int = 200, target_rows: int = 20_000, seed: int = 17) -> DataFrame:
    """Per document row: its id, log_weight and selected. keep: the share of documents to draw;
    by default the share of quality 1 among the labels."""
    spark = docs.sparkSession
    short_batches(spark)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("body"))
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    drawn = good.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(target_rows).collect()
    targets = spark.sparkContext.broadcast(np.array(sorted(r[0] for r in drawn), np.int64))
    if keep is None:
        keep = labels.agg(F.avg((F.col("quality") == 1).cast("int"))).first()[0]
        keep = 1.0 if keep is None else keep
    counted = own.mapInArrow(_counter(targets, buckets), "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target"), F.sum("raw")).collect()
    sums = np.zeros((2, buckets))
    for b, t, r in counted:
        sums[:, b] = t, r
    models = np.log(sums + 1) - np.log(sums.sum(axis=1, keepdims=True) + buckets)
    ratio = spark.sparkContext.broadcast(models[0] - models[1] if len(drawn) else np.zeros(buckets))
    scored = written(own.select("id", "text", "body").mapInArrow(_scorer(ratio, length), "id long, body long, log_weight double"), "scores")
    uniform = (F.shiftrightunsigned(F.xxhash64("id", "body", F.lit(seed)), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    noisy = F.col("log_weight") - F.log(-F.log(uniform))
    placed = scored.withColumn("place", F.round(noisy * 1e9).cast("long"))
    k = round(keep * scored.count())
    picked = gumbel_top(placed, k) if k > 0 else placed.withColumn("selected", F.lit(False))
    return picked.select(F.col("id").alias(id_col), "log_weight", "selected")
