"""Line dedup by content-defined chunks, in DataFrame functions only.

Each line is hashed; a rolling hash over a line and the one before it ends a chunk when it
falls into one of `divisor` classes, so an insertion moves boundaries only near itself.
Chunks of two lines or more whose bytes occur before, in id order over all documents, are
removed; the first occurrence stays.

Plan: pass 1 writes the places and hashes of chunks (no text) and finds repeated hashes by a
counting aggregate. The texts are then dealt by (id, hash of the text) in one exchange that the
plan uses twice: the repeated chunks' texts are cut from it and grouped by their bytes (partial
aggregation sends a hot chunk once per task), and the removals meet their documents in it.
Places of a hash that has very many of them are not shuffled: such hashes are few, and their
answer is broadcast.

Defined results: a null text stays null with zero lines; an empty text has one empty line. Rows
equal in id and text are one document: they get one result each, the same. Ties of an id are
ordered by the text's hash. Null ids come first. Chunks that are equal in hash (MD5 and XXH64)
but not in bytes stay. Empty tables give no rows. Other columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlume.llm.shared import heavy_keys, join_hot, let, written


def _chunked(lines: Column, divisor: int) -> Column:
    """array<struct<first,n>>, 1-based, of the chunks of an array of lines."""
    before = lambda values, i: F.when(i > 0, F.get(values, i - 1)).otherwise(F.lit(0))

    def ends_of(hashes: Column) -> Column:
        last = F.size(hashes) - 1
        ended = lambda h, i: (i == last) | (((before(hashes, i) * 31 + h) % 1000003) % divisor == 0)
        return F.filter(F.transform(hashes, lambda h, i: F.when(ended(h, i), i + 1)), lambda x: x.isNotNull())

    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))
    cut = lambda ends: F.transform(ends, lambda e, i: F.struct((before(ends, i) + 1).alias("first"), (e - before(ends, i)).alias("n")))
    return let(let(hashes, ends_of), cut)


def dedup_line_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", divisor: int = 4, hot: int = 1000) -> DataFrame:
    """Per document row: its id, n_lines, n_chunks, n_removed_chunks, n_removed_lines and the
    text without the removed chunks. divisor: lines of a chunk, on average. hot: places of one
    hash beyond which they are not shuffled."""
    keyed = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).withColumn("__key", F.xxhash64("__text"))
    lined = keyed.withColumn("__lines", F.split("__text", "\n", -1))
    pieces = lined.select("__id", "__key", "__lines", F.posexplode(_chunked(F.col("__lines"), divisor)).alias("k", "c")).where(F.col("c.n") >= 2)
    text_of = lambda c: F.array_join(F.slice("__lines", c["first"], c["n"]), "\n")
    bodies = pieces.select("__id", "__key", "k", "c", text_of(F.col("c")).alias("body"))
    h = F.concat(F.unhex(F.md5("body")), F.unhex(F.lpad(F.hex(F.xxhash64("body")), 16, "0")))
    marks = written(bodies.select("__id", "__key", "k", "c", h.alias("h")), "chunks")
    repeated = written(marks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    total = marks.count()
    suspects = written(join_hot(marks, repeated, "h", total, hot), "suspects")

    place = F.struct("__id", "__key", "k")
    wanted = suspects.groupBy("__id", "__key").agg(F.collect_set(F.struct("k", "c", "h")).alias("marks"))
    both = [F.col("d.__id").eqNullSafe(F.col("m.__id")), F.col("d.__key") == F.col("m.__key")]
    opened = keyed.alias("d").join(wanted.alias("m").hint("shuffle_merge"), both).select("d.__id", "d.__key", F.split("d.__text", "\n", -1).alias("__lines"), F.explode("m.marks").alias("m"))
    kept = opened.select("__id", "__key", F.col("m.k").alias("k"), F.col("m.h").alias("h"), text_of(F.col("m.c")).alias("body")).groupBy("h", "body").agg(F.min(place).alias("keeper"))
    single = kept.groupBy("h").agg(F.count("*").alias("bodies"), F.min("keeper").alias("keeper")).where("bodies = 1").drop("bodies")
    later = ~place.eqNullSafe(F.col("keeper"))
    heavy = heavy_keys(repeated, "h", total, hot)
    if heavy is None:
        gone = suspects.join(single, "h").where(later)
    else:
        gone = suspects.join(heavy, "h", "left_anti").join(single, "h").where(later).unionByName(suspects.join(F.broadcast(single.join(heavy, "h", "left_semi")), "h").where(later))
    lists = gone.groupBy("__id", "__key").agg(F.collect_set("k").alias("gone"))
    whole = keyed.alias("d").join(lists.alias("m").hint("shuffle_merge"), both, "left").select("d.__id", "d.__text", F.coalesce("m.gone", F.array().cast("array<int>")).alias("gone"))
    whole = whole.withColumn("__lines", F.split("__text", "\n", -1)).withColumn("__chunks", _chunked(F.col("__lines"), divisor))
    lost = F.transform("gone", lambda k: F.get("__chunks", k)["n"])
    stays = F.flatten(F.transform(F.filter("__chunks", lambda c, i: ~F.array_contains("gone", i)), lambda c: F.slice("__lines", c["first"], c["n"])))
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return whole.select(
        F.col("__id").alias(id_col), long(F.size("__lines")).alias("n_lines"), long(F.size("__chunks")).alias("n_chunks"), long(F.size("gone")).alias("n_removed_chunks"),
        F.aggregate(lost, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed_lines"), F.when(F.size("gone") == 0, F.col("__text")).otherwise(F.array_join(stays, "\n")).alias("text"),
    )


SQL = """
WITH l AS (
  SELECT doc_id, i, line, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)
), b AS (
  SELECT *, CASE WHEN ((coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * 31 + h) % 1000003) % 4 = 0 THEN 1 ELSE 0 END AS cut FROM l
), c AS (
  SELECT *, coalesce(sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b
), g AS (
  SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY doc_id, k
), r AS (
  SELECT *, n >= 2 AND row_number() OVER (PARTITION BY body, n >= 2 ORDER BY doc_id, k) > 1 AS gone FROM g
), t AS (
  SELECT doc_id, sum(n)::BIGINT AS n_lines, count(*)::BIGINT AS n_chunks, sum(gone::INT)::BIGINT AS n_removed_chunks,
         sum(CASE WHEN gone THEN n ELSE 0 END)::BIGINT AS n_removed_lines, coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS text
  FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_chunks, 0)::BIGINT AS n_chunks, coalesce(n_removed_chunks, 0)::BIGINT AS n_removed_chunks,
       coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines, t.text
FROM documents d LEFT JOIN t USING (doc_id)
"""
