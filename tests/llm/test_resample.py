import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerlume.llm import resample
from ledgerlume.llm import textbytes as tb

TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[^\x00-\x20\x7f0-9a-z\x80-\xff]+")


def grams(text, buckets):
    """Buckets of a text's n-grams, one token after the other."""
    data = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    own = []
    for t in TOKEN.findall(data):
        one = np.frombuffer(t, np.uint8)
        own.append(int(tb.span_hashes(one, np.array([0]), np.array([len(t)]), tb.byte_values())[0]))
    pairs = [int(tb.gram_hashes(np.array(p, np.uint64), 2)[0]) for p in zip(own, own[1:], strict=False)]
    return [x % buckets for x in own + pairs]


def test_weights_and_draw_against_brute_force(spark, frame, odd):
    r = random.Random(3)
    kinds = [[f"good{i}" for i in range(30)], [f"bad{i}" for i in range(30)] + ["!!", "$$$", "É?"]]
    rows = odd + [(1000 + i, " ".join(r.choice(kinds[i % 2]) for _ in range(r.randrange(1, 60))), "a") for i in range(120)]
    labels = [(1000 + i, 1 - i % 2, i % 4 // 3) for i in range(80)] + [(5, 1, 1), (10, 1, None)]
    buckets, length, keep = 500, 50, 0.4
    got = resample.resample(frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), keep=keep, buckets=buckets, length=length)
    good = {i for i, q, t in labels if q == 1 and not t}
    target, raw = Counter(), Counter()
    for i, t, _ in rows:
        g = grams(t, buckets)
        raw.update(g)
        if i in good:
            target.update(g)
    n, m = sum(target.values()), sum(raw.values())
    log = {b: math.log((target[b] + 1) / (n + buckets)) - math.log((raw[b] + 1) / (m + buckets)) for b in range(buckets)}
    want = []
    for i, t, _ in rows:
        g = grams(t, buckets)
        want.append((i, length * sum(log[b] for b in g) / len(g) if g else None))
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or 0.0)
    found = sorted([(x["doc_id"], x["log_weight"], x["selected"]) for x in got.collect()], key=key)
    for (i, w, _), (j, v) in zip(found, sorted(want, key=key), strict=True):
        assert i == j and (w is None) == (v is None) and (w is None or abs(w - v) < 1e-6)
    # the draw: the largest sums of weight and noise, by a sort
    noise = frame(rows).select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(17)), 12).alias("u"), "text").collect()
    weight = {(i, t): v for (i, v), (_, t, _) in zip(want, rows, strict=True)}
    score = sorted((weight[x["doc_id"], x["text"]] - math.log(-math.log((x["u"] + 0.5) / (1 << 52))) for x in noise if weight[x["doc_id"], x["text"]] is not None), reverse=True)
    k = round(keep * len(rows))
    cut = score[k - 1]
    should = {x["doc_id"] for x in noise if weight[x["doc_id"], x["text"]] is not None and weight[x["doc_id"], x["text"]] - math.log(-math.log((x["u"] + 0.5) / (1 << 52))) >= cut - 1e-6}
    assert {i for i, _, chosen in found if chosen} == should and len(should) >= k - 10
