import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlume.llm import decontaminate as d
from ledgerlume.llm import textbytes as tb
from ledgerlume.llm.shared import short_batches

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    windows = {}
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(name)
    out = []
    for i, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= {x for x in windows[g] if x is not None}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return out


few = st.lists(st.sampled_from(["a", "b", "cc", "É", "1"]), max_size=40).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(few, min_size=1, max_size=4), st.lists(few, min_size=1, max_size=4), st.integers(2, 8), st.integers(1, 5))
def test_every_shared_window_is_found(texts, items, window, gram):
    index = d.build_index([(str(i), t) for i, t in enumerate(items)], window, gram)
    whole = d._texts([t.encode() for t in texts])
    spans, found = d._hits(whole, tb.lower_table()[whole.data], index, tb.byte_values())
    for i, (_, n, n_hit, _, sha, _) in enumerate(brute(list(enumerate(texts)), [(str(k), t) for k, t in enumerate(items)], window)):
        own = [x for x in found if spans.first[i] <= x[0] < spans.first[i + 1]]
        assert n == spans.first[i + 1] - spans.first[i]
        assert n_hit == len({k for a, b, _ in own for k in range(a, b)})
        assert sha == hashlib.sha256(",".join(sorted({x for _, _, names in own for x in names})).encode()).hexdigest()


def test_odd_rows_and_blocks(spark, frame, odd):
    short_batches(spark)
    docs = frame(odd)
    long = next(t for i, t, _ in odd if i == 4)
    items = [(1, " ".join(words(long)[100:130])), (2, odd[5][1]), (3, "w1 w2"), (3, "w1 w2"), (4, None), (5, ""), (None, "w3 w4 w5")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute([(i, t) for i, t, _ in odd], [(None if i is None else str(i), t) for i, t in items]), key=str)
    for block in (1 << 20, 150):
        got = d.contaminated_digest(d.decontaminate(docs, bench, block_bytes=block))
        assert sorted(map(tuple, got.collect()), key=str) == want
        kept = d.clean_documents(docs, bench, block_bytes=block)
        assert kept.columns == docs.columns
        assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(str(w[0]) for w in want if not w[5])
    assert d.decontaminate(docs.limit(0), bench).count() == 0
    assert not d.contaminated_digest(d.decontaminate(docs, bench.limit(0))).where("contaminated").count()


def test_a_large_benchmark_is_joined_by_fingerprints(spark, frame):
    import random

    r = random.Random(31)
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, say(r.choice([3, 7, 10, 25, 60]))) for i in range(80)] + [(80, None), (81, ""), (82, "v1"), (None, say(30))]
    common = items[4][1]
    docs = [(i, f"{say(r.randrange(40))} {r.choice(items[:80])[1]} {say(9)}", "a") for i in range(60)] + [(100 + i, f"x{i} {common} y{i}", "b") for i in range(50)] + [(200, common, "b")] * 20 + [(201, None, "a"), (None, common, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute([(i, t) for i, t, _ in docs], [(None if i is None else str(i), t) for i, t in items]), key=str)
    for block in (1 << 20, 100):
        got = d.contaminated_digest(d.decontaminate(frame(docs), bench, block_bytes=block))
        assert sorted(map(tuple, got.collect()), key=str) == want
    clean = lambda block: sorted(str(x["doc_id"]) for x in d.clean_documents(frame(docs), bench, block_bytes=block).collect())
    assert clean(100) == clean(1 << 20) == sorted(str(w[0]) for w in want if not w[5])
