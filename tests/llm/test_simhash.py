import random

import numpy as np
import xxhash

from ledgerlume.llm import simhash


def plain(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [plain(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(str((d, f"{fps[i]:016x}", least.get(root(i)))) for i, (d, _) in enumerate(rows))


def test_hash_is_that_of_spark(spark):
    texts = ["a b c", "É ß", "", "x" * 100]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(t)").collect()]
    assert [x & (2**64 - 1) for x in got] == [xxhash.xxh64_intdigest(t.encode(), seed=42) for t in texts]


def test_the_cover_joins_all_close_halves():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**32, 200)
    for bit in [None, *range(32)]:
        y = x if bit is None else x ^ (1 << bit)
        (ra, a), (rb, b) = simhash.anchors_of(x), simhash.anchors_of(y)
        for i in range(200):
            assert set(a[ra == i].tolist()) & set(b[rb == i].tolist())
    assert np.bincount(ra).max() <= 17


def test_documents_against_brute_force(spark, frame, odd):
    r = random.Random(9)
    base = [f"t{r.randrange(500)}" for _ in range(400)]
    rows = list(odd)
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"n{i}"
        rows.append((300 + i, " ".join(w), "a"))
    want = brute([(i, t) for i, t, _ in rows])
    for hot in (50_000, 4):
        got = simhash.near_duplicates(frame(rows), hot=hot)
        assert sorted(map(str, map(tuple, got.collect()))) == want
    assert simhash.near_duplicates(frame(rows).limit(0)).count() == 0


def test_links_against_brute_force(spark):
    r = random.Random(2)
    fps = {r.getrandbits(64) for _ in range(60)}
    for x in list(fps)[:30]:
        for n in (1, 2, 3, 4):
            fps.add(x ^ sum(1 << b for b in r.sample(range(64), n)))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    prints = spark.createDataFrame([(x,) for x in signed], "fp long")
    for hot in (10_000, 2):
        stars = {a["u"]: a["v"] for a in simhash.components(simhash.link_fingerprints(prints, hot=hot)).collect()}
        comp = {x: x for x in signed}
        changed = True
        while changed:
            changed = False
            for x in signed:
                for y in signed:
                    if ((x ^ y) & (2**64 - 1)).bit_count() <= 3 and comp[y] < comp[x]:
                        comp[x], changed = comp[y], True
        assert {x: stars.get(x, x) for x in signed} == comp


def test_a_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long").repartition(7)
    got = {r["u"]: r["v"] for r in simhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


def test_hot_keys_of_every_join(spark, frame, odd):
    r = random.Random(11)
    base = [f"t{r.randrange(300)}" for _ in range(400)]
    rows = odd + [(300 + i, " ".join(base), "a") for i in range(40)]
    for i in range(40):
        w = list(base)
        w[r.randrange(400)] = f"n{i}"
        rows.append((400 + i, " ".join(w), "a"))
    want = brute([(i, t) for i, t, _ in rows])
    got = simhash.near_duplicates(frame(rows), hub=3)
    assert sorted(map(str, map(tuple, got.collect()))) == want
    links = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(i, i + 100) for i in range(1, 60)] + [(900, 901)], "a long, b long").repartition(5)
    assert {r["u"]: r["v"] for r in simhash.components(links, hub=3).collect()} == {**{i: 0 for i in range(1, 60)}, **{i + 100: 0 for i in range(1, 60)}, 901: 900}


def test_blocks_of_a_large_group_connect_the_same():
    r = random.Random(4)
    fps = {r.getrandbits(64) for _ in range(150)}
    for x in list(fps):
        for n in (1, 2, 3, 4, 5):
            fps.add(x ^ sum(1 << b for b in r.sample(range(64), n)))
    fps = np.array(sorted(fps), np.uint64)

    def parts(pairs):
        top = list(range(len(fps)))

        def root(x):
            while top[x] != x:
                x = top[x]
            return x

        for a, b in pairs:
            assert int(fps[a] ^ fps[b]).bit_count() <= 3
            top[root(int(a))] = root(int(b))
        least = {}
        return [least.setdefault(root(i), i) for i in range(len(fps))]

    assert parts(np.concatenate(list(simhash.linked_pairs(fps, 3, 10)))) == parts(simhash.forest(fps, 3))


def test_first_rows_of_groups(spark, frame, odd):
    extra = [(5, "another text of the id", "b"), (None, "words of no id", "a"), (None, "words of no id", "a"), (None, "one more of no id", "c"), (900, odd[3][1], "a")]
    rows = odd + extra
    docs = frame(rows)
    got = [(r["doc_id"], r["text"]) for r in simhash.first_of_groups(docs).collect()]
    assert simhash.first_of_groups(docs).columns == docs.columns
    fps = [plain(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    spark_hash = {r["text"]: r["h"] for r in docs.selectExpr("text", "xxhash64(text) h").collect()}
    want = [min(((i is None, i or 0, spark_hash[t]), (i, t)) for (i, t, _), h in zip(rows, group, strict=True) if h == g)[1] for g in sorted(set(group))]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {t for i, t in got if i is None} == {"words of no id", "one more of no id"}  # each of its own group
    assert simhash.first_of_groups(docs.limit(0)).count() == 0
    clash = docs.toDF("doc_id", "text", "id", "key", "fp", "n", "root", "first", "least", "u", "v", "count")
    assert clash.columns == simhash.first_of_groups(clash).columns and simhash.first_of_groups(clash).count() == len(got)
