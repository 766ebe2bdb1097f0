import itertools
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlume.llm import mixing, queries
from tests.llm.test_decontaminate import brute as hits
from tests.llm.test_simhash import brute as groups


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        out = stage(spark, docs, sf)
        after = out.toPandas()
        held[name] = (before, after)
        if name != "token_output":
            assert out.columns == columns and len(after)
            docs = spark.createDataFrame(after, out.schema)
    before, after = held["near_dedup"]
    want = {int(g.split(",")[0][1:]) for g in groups(list(zip(before.doc_id, before.text, strict=True))) if g.split(",")[0][1:] == g.rsplit(" ", 1)[1][:-1]}
    assert set(after.doc_id) == want and after.doc_id.is_unique
    before, after = held["benchmark_decontamination"]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()
    assert set(after.doc_id) == {h[0] for h in hits(list(zip(before.doc_id, before.text, strict=True)), list(zip(bench.item_id, bench.text, strict=True))) if not h[5]}
    before, after = held["source_mix"]
    assert len(after) > 0.5 * len(before) and set(after.doc_id) <= set(before.doc_id)
    assert mixing.quarter({"a": 90, "b": 5, "c": 5, "d": 5, "e": 5})["a"] == 0.25
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(queries.tokenizer_path())
    before, after = held["token_output"]
    start, want = 0, []
    for i, t in sorted(zip(before.doc_id, before.text, strict=True)):
        ids = [*tool.encode(t, add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, after.values.tolist())) == want


def test_stages_take_odd_tables(spark, frame, odd, sf):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(odd), sf).count() > 0
        assert stage(spark, frame(odd).limit(0), sf).count() == 0


def test_tokens_are_written_in_the_order_of_the_mix(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").toPandas().set_index("doc_id").source.fillna("")
    got = sorted(corpus_pipeline.run(spark, sf).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids != sorted(ids) and len(ids) == len(set(ids)) > 50
    assert [r["start"] for r in got] == [0, *itertools.accumulate(r["n_tokens"] for r in got)][:-1]
    order = [documents[i] for i in ids]
    counts, placed = Counter(order), Counter()
    for t, s in enumerate(order, 1):  # a block has 8 documents
        placed[s] += 1
        assert abs(placed[s] - t * counts[s] / len(order)) < 16


def test_the_mix_places_every_row_and_tokens_follow(spark, frame, odd, sf):
    rows = [(i, f"text {i}", r) for i, r in enumerate(random.Random(4).choices(["a", "b", "c", None], [8, 3, 2, 1], k=400))]
    rows += [(7, "the same id", "a"), (7, "and again", "b"), *[(None, f"no id {i}", "c") for i in range(40)]]
    for table in (rows, odd):
        docs = frame(table).withColumns({c: F.lit(None).cast("long") for c in corpus_pipeline.ORDER})
        out = corpus_pipeline.source_mix(spark, docs, sf)
        assert out.columns == docs.columns
        after = out.collect()
        assert Counter((r["doc_id"], r["text"], r["source"]) for r in after) == Counter(map(tuple, docs.select("doc_id", "text", "source").collect()))
        places = {(r["mix_slot"], r["mix_place"]): (r["doc_id"], r["text"], r["source"]) for r in after}
        assert len(places) == len({(r["doc_id"], r["text"], r["source"]) for r in after})
        fed = spark.createDataFrame(after, out.schema)
        got = sorted(corpus_pipeline.token_output(spark, fed, sf).collect(), key=lambda r: r["start"])
        want = sorted(after, key=lambda r: (r["mix_slot"], r["mix_place"]))
        assert [r["doc_id"] for r in got] == [r["doc_id"] for r in want]
        assert corpus_pipeline.token_output(spark, fed.limit(0), sf).count() == 0 == corpus_pipeline.source_mix(spark, docs.limit(0), sf).count()
