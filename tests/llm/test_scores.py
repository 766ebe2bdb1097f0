import base64
import json
import random
import re
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlume.llm import mixing, quality, queries, resample, secrets


def base_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep))


def test_quality_against_brute_force(spark, frame, odd):
    rows = odd + [(400 + i, "Common Line 12\n" + " ".join(f"q{i}x{k}" for k in range(60)), "h") for i in range(30)] + [(500 + i, ("Common  line 99\n" * 1) + "common line 55 \n", "h") for i in range(30)]
    rows += [(600 + i, f"u{i}\n" + "\n".join(f"stock {k} " + " ".join(f"s{k}y{j}" for j in range(20)) for k in range(4)), "k") for i in range(30)]
    got = quality.judge_quality(frame(rows))
    held = {}
    for r in got.collect():
        held.setdefault((r["doc_id"], *[r[c] for c in quality.COUNTS]), r)
    for i, t, s in rows:
        r = held[(i, *base_counts(t))]
        n, rep = r["n_words"], r["n_repeat_words"]
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        if s == "k":
            assert r["removed_words"] == n - 1 and not r["kept"]  # all but one line is on every page of the host
        elif 400 <= (i or 0) < 500:
            assert r["removed_words"] == 3 and r["kept"]
    assert got.count() == len(rows)
    assert quality.judge_quality(frame(rows).limit(0)).count() == 0


def test_copies_of_one_text_are_one_document(spark, frame):
    text = " ".join(f"a{i}" for i in range(80))
    assert quality.judge_quality(frame([(i, text, "s") for i in range(100)])).where("kept").count() == 100


KEY = base64.b64encode(bytes.fromhex("302e0201003005060326656e") + bytes([0x04, 0x22, 0x04, 0x20]) + bytes(range(32))).decode()
RSA = bytes.fromhex("301e020100") + bytes([2, 13]) + bytes(range(1, 14)) + bytes([2, 3, 1, 0, 1]) + bytes([2, 5, 9, 9, 9, 9, 9])
TOKEN = base64.urlsafe_b64encode(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()).decode().rstrip("=") + ".eyJzdWIiOiIxIn0." + "Zq" * 22


def test_structures():
    der = bytes.fromhex("302e0201003005060326656e0422") + b"\x04\x20" + bytes(range(32))
    assert not secrets.is_der_key(der[:-1]) and not secrets.is_der_key(b"\x30" + der)
    assert secrets.is_der_key(RSA) and not secrets.is_der_key(RSA + b"\0")
    kinds = lambda t: [k for _, k, _ in secrets.find_secrets(t)]
    assert kinds(f"x {TOKEN} y") == ["jwt"]
    assert kinds(TOKEN.replace("eyJh", "eyKh")) == []
    assert kinds("key " + RSA.hex()) == ["hex", "der"]
    ssh = base64.b64encode(b"openssh-key-v1\0" + b"\0\0\0\4none" * 2 + b"\0\0\0\0" + b"\0\0\0\1" + b"z" * 30).decode()
    assert kinds(ssh) == ["openssh"]
    assert kinds("-----BEGIN RSA PRIVATE KEY-----\n" + base64.b64encode(RSA).decode() + "\n-----END RSA PRIVATE KEY-----") == ["pem", "der"]
    assert kinds("token: secret : abcdefghijklmnop") == []


def brute_base(text):
    out = [(m.start(), "assign", m.end()) for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16], key=lambda x: (x[0], ("assign", "access", "hex").index(x[1])))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["password", "TOKEN", "ſecret", "api_key", "apiKey", "=", ": ", '"', " ", "deadbeef", "0123456789abcdef", "AKIA", "ABCDEFGHIJ1234", "é", "\n", "x.y", "secret"]), max_size=25).map("".join))
def test_base_spans_against_brute_force(text):
    assert [x for x in secrets.find_secrets(text) if x[1] in secrets.BASE] == brute_base(text)


def test_secret_rows(spark, frame, odd):
    rows = odd + [(700, f"é {TOKEN} password={'a1' * 8} {KEY}", "a")]
    got = {(r["doc_id"], r["base_sha256"], r["spans"]) for r in secrets.secret_digest(secrets.scan_secrets(frame(rows))).collect()}
    joined = lambda f: ",".join(f"{k}:{a}:{b}" for a, k, b in f)
    assert got == {(i, secrets.digest_of(f), joined(f)) for i, t, _ in rows for f in [secrets.find_secrets(t)]}
    assert secrets.scan_secrets(frame(rows).limit(0)).count() == 0


def test_resampling_keeps_clean_and_drops_junk(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = resample.resample(docs, fit).join(held, "doc_id").where("log_weight is not null").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    pairs = sum((g > b) + 0.5 * (g == b) for g in good.log_weight for b in bad.log_weight)
    assert pairs / (len(good) * len(bad)) > 0.9
    assert good.selected.mean() > 0.9 > 0.5 > bad.selected.mean()


def test_resampling_odd_rows(spark, frame, odd):
    docs = frame(odd)
    labels = spark.createDataFrame([(5, 1, 0), (10, 1, None), (11, 0, 0), (None, 1, 0), (12, None, None)], "doc_id long, quality int, toxic int")
    got = resample.resample(docs, labels, keep=0.3)
    rows = got.collect()
    assert len(rows) == len(odd) and {r["doc_id"] for r in rows if r["log_weight"] is None} == {1, 2, 3}
    n = sum(r["selected"] for r in rows)
    assert round(0.3 * len(odd)) <= n <= round(0.3 * len(odd)) + 1  # rows equal in id and text go together
    again = {tuple(r) for r in resample.resample(docs.repartition(3), labels, keep=0.3).collect()}
    assert again == {tuple(r) for r in rows}
    assert resample.resample(docs.limit(0), labels).count() == 0
    assert resample.resample(docs, labels.limit(0)).where("selected").count() == len(odd) - 3


def test_radix_selection_is_exact(spark):
    r = random.Random(4)
    values = [r.choice([r.getrandbits(63), -r.getrandbits(63), r.randrange(10)]) for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(999, None)], "id long, place long")
    for k in (1, 7, 150, 300, 1000):
        got = {x["id"] for x in resample.gumbel_top(df, k).where("selected").collect()}
        least = sorted(values, reverse=True)[min(k, 300) - 1]
        assert got == {i for i, v in enumerate(values) if v >= least}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=12))
def test_every_prefix_is_within_a_block(weights):
    own = {f"s{i}": w for i, w in enumerate(weights)}
    total, placed = sum(weights), Counter()
    for t, s in enumerate(mixing.period(own) * 2, 1):
        placed[s] += 1
        assert all(abs(placed[x] * total - t * w) < total for x, w in own.items())


def test_mix(spark, frame):
    r = random.Random(8)
    rows = [(i, f"t{i}", r.choice([None, "a", "a", "a", "a", "b", "c"])) for i in range(3000)] + [(3000, "x", "rare"), (None, "y", "a"), (5, "again", "b")]
    docs = frame(rows)
    for weights in (mixing.quarter, {"a": 1, "b": 2, "c": 1}):
        got = mixing.mix_sources(docs, weights, group_rows=100).toPandas()
        assert len(got) == len(rows)
        assert got.groupby("slot").source.nunique().max() == 1 and sorted(got.slot.unique()) == list(range(got.slot.nunique()))
        assert got.groupby(["slot", "place"]).size().max() == 1
        counts = Counter(s or "" for _, _, s in rows)
        targets = weights(counts) if callable(weights) else weights
        mixed = got[got.in_mix].drop_duplicates("slot").sort_values("slot")
        assert len(mixed) > 50
        if not callable(weights):
            placed, total = Counter(), sum(targets.values())
            for t, s in enumerate(mixed.source[:150], 1):
                placed[s] += 1
                assert all(abs(placed[x] * total - t * w) < 1.02 * total for x, w in targets.items())
        kept = mixing.mixed_documents(docs, weights, group_rows=100)
        assert kept.columns == docs.columns
        assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, (None if i != i else int(i) for i in got[got.in_mix].doc_id)))
    assert mixing.mix_sources(docs.limit(0)).count() == 0 == mixing.mixed_documents(docs.limit(0)).count()


def test_small_sources_neither_stop_the_mix_nor_leave_their_share(spark, frame):
    for few in (60, 300):
        counts = {f"l{i}": 40_000 for i in range(6)} | {f"s{i}": 40 for i in range(few)}
        assert mixing.mix_counts(counts, counts, 0.05) == counts
        blocks = {s: n // 8 for s, n in counts.items()}
        order, placed, total = mixing.schedule(blocks, counts), Counter(), sum(counts.values())
        assert Counter(order) == blocks
        for t, s in enumerate(order, 1):
            placed[s] += 1
            assert abs(placed[s] * total - t * counts[s]) < total
    many = {f"s{i}": 1 + 99 * (i < 10) for i in range(1500)}
    assert mixing.whole_weights(many) == many  # from 1,000 sources on all weights were one
    docs = frame([(i, f"t{i}", "big" if i < 900 else f"s{i % 40}") for i in range(980)])
    for runs in (1 << 17, 20):
        got = mixing.mix_sources(docs, lambda counts: counts, max_runs=runs).toPandas()
        assert got.in_mix.all() and len(got) == 980 and sorted(got.slot.unique()) == list(range(got.slot.nunique()))
        assert got.groupby(["slot", "place"]).size().max() == 1 == got.groupby("slot").source.nunique().max()
    assert mixing.mixed_documents(docs, lambda counts: counts).count() == 980


def test_the_default_mix_holds_every_document(spark, frame):
    docs = frame([(i, f"t{i}", "hot" if i % 3 == 0 else f"s{i % 20}") for i in range(1200)])
    assert mixing.mixed_documents(docs).count() == 1200 == mixing.mix_sources(docs).where("in_mix").count()
    assert mixing.left_out(docs) == {}
    lost = mixing.left_out(docs, mixing.quarter)
    assert lost["hot"] > 100 and mixing.mixed_documents(docs, mixing.quarter).count() >= 1200 - sum(lost.values())


def test_sql_of_the_queries(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, sf).toPandas()
        want = con.sql(sql).df()[list(got.columns)]
        key = got.columns[0]
        plain = lambda d: [[None if v != v else v for v in r] for r in d.sort_values(key).astype(object).where(d.sort_values(key).notna(), None).values.tolist()]
        assert plain(got) == plain(want), name
