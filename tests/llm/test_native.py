import hashlib
import random
import re

from ledgerlume.llm import licenses, linechunks


def chunks(text, divisor=4):
    lines, out, own, last = text.split("\n"), [], [], 0
    for x in lines:
        h = int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
        own.append(x)
        if (last * 31 + h) % 1000003 % divisor == 0:
            out.append(own)
            own = []
        last = h
    return out + [own] if own else out


def test_line_chunks_against_brute_force(spark, frame, odd):
    block = "\n".join(f"line {i} of a passage" for i in range(30))
    rows = odd + [(100, "head\n" + block + "\ntail", "a"), (101, block + "\nother", "b"), (102, "x\n" * 40, "b"), (103, block + "\n" + block, "a")]
    got = {(r["doc_id"], r["n_lines"]): r for r in linechunks.dedup_line_chunks(frame(rows)).collect()}
    seen, n_removed = set(), 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if i in (5, 7) or t is None:
            continue
        kept, gone = [], 0
        for c in chunks(t):
            if len(c) > 1 and tuple(c) in seen:
                gone += len(c)
            else:
                kept += c
            if len(c) > 1:
                seen.add(tuple(c))
        r = got[i, len(t.split("\n"))]
        assert (r["text"], r["n_removed_lines"], r["n_chunks"]) == ("\n".join(kept), gone, len(chunks(t)))
        n_removed += gone
    assert n_removed > 30
    assert got[1, 0]["text"] is None and got[2, 1]["text"] == ""
    assert linechunks.dedup_line_chunks(frame(rows)).count() == len(rows)
    assert linechunks.dedup_line_chunks(frame(rows).limit(0)).count() == 0


def test_licenses_against_brute_force(spark, frame, odd):
    grant = licenses.TEMPLATES["mit-grant"]
    rows = odd + [(200, "Some text.\nReleased under the MIT Licence\nReleased under the MIT License.\nmore", "a"), (201, grant.upper().replace(" ", "\n", 9), "a"), (202, "all RIGHTS reserved", "b"), (203, "Released", "b"), (204, "Licensed under the Apache License, Version 2.0. Copyright somebody", "a")]
    known = {k: set(licenses.bigrams_of(v)) for k, v in licenses.TEMPLATES.items()}
    want = []
    for i, t, _ in rows:
        units = (t or "").split("\n") + ([t] if "\n" in (t or "") else [])
        n, best = 0, []
        for u in units:
            g = set(licenses.bigrams_of(u))
            fits = [(-2 * len(g & b) / (len(g) + len(b)), k) for k, b in known.items() if g and 2 * len(g & b) / (len(g) + len(b)) >= 0.8]
            n += bool(fits)
            best += fits
        want.append((i, n, ",".join(sorted({k for _, k in best})), min(best)[1] if best else None, round(-min(best)[0], 6) if best else None))
    assert sorted(map(str, map(tuple, licenses.scan_licenses(frame(rows)).collect()))) == sorted(map(str, want))
    assert sum(bool(re.search("mit|apache|all-", w[2])) for w in want) == 4
    assert licenses.scan_licenses(frame(rows).limit(0)).count() == 0
    assert licenses.scan_licenses(frame(rows), templates={}).where("n_matches > 0").count() == 0


def test_native_plans_have_no_python(spark, frame, odd):
    for df in (licenses.scan_licenses(frame(odd)), linechunks.dedup_line_chunks(frame(odd))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_hot_chunks_give_the_same_rows(spark, frame, odd):
    block = "\n".join(f"line {i} of a passage" for i in range(30))
    rows = odd + [(100 + i, f"head {i}\n{block}\ntail {i}", "a") for i in range(40)] + [(None, block, "a"), (100, block, "b"), (100, block, "b")]
    want = sorted(map(str, linechunks.dedup_line_chunks(frame(rows)).collect()))
    assert sorted(map(str, linechunks.dedup_line_chunks(frame(rows), hot=5).collect())) == want and len(want) == len(rows)


def test_texts_are_dealt_once(spark, frame, odd):
    block = "\n".join(f"line {i} of a passage" for i in range(30))
    df = linechunks.dedup_line_chunks(frame(odd + [(100 + i, f"head {i}\n{block}", "a") for i in range(30)]))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    dealt = [x for x in plan.split("\n") if " Exchange hashpartitioning(coalesce(__id" in x and "ReusedExchange" not in x]
    assert plan.count("ReusedExchange") >= 1 and len(dealt) <= 4


def wrapped(text, width, mark="", end="\n"):
    out, line = [], mark
    for w in text.split():
        if len(line) + len(w) > width and line != mark:
            out.append(line.rstrip())
            line = mark
        line += w + " "
    return end.join([*out, line.rstrip()])


def plain_scan(text):
    """Units and windows by the definition, without any filter."""
    known = {k: (len(licenses.words_of(v)), set(licenses.bigrams_of(v))) for k, v in licenses.TEMPLATES.items()}
    fit = lambda g: [(-2 * len(g & b) / (len(g) + len(b)), k) for k, (_, b) in known.items() if g and 2 * len(g & b) / (len(g) + len(b)) >= 0.8]
    lines = (text or "").split("\n")
    units = [f for u in lines + ([text] if len(lines) > 1 else []) if (f := fit(set(licenses.bigrams_of(u))))]
    words = [(w, i) for i, x in enumerate(lines) for w in licenses.words_of(x)]
    grams = [f"{a} {b}" for (a, _), (b, _) in zip(words, words[1:], strict=False)]
    windows = {}
    for p in range(len(words)):
        if p and words[p - 1][1] == words[p][1]:
            continue
        for k, (n, b) in known.items():
            if p < len(grams) and grams[p] in b and not (p + n - 1 < len(words) and words[p + n - 1][1] == words[p][1]):
                g = set(grams[p : p + n - 1])
                if g and 2 * len(g & b) / (len(g) + len(b)) >= 0.8:
                    windows.setdefault(p, []).append((-2 * len(g & b) / (len(g) + len(b)), k))
    found = [x for f in (*units, *windows.values()) for x in f]
    best = min(found) if found else (None, None)
    return len(units) or len(windows), ",".join(sorted({k for _, k in found})), best[1], None if best[0] is None else round(-best[0], 6)


def test_wrapped_notices_inside_longer_files(spark, frame, odd):
    r = random.Random(21)
    code = lambda: "\n".join(" ".join(f"{r.choice('abcdefgh')}{r.randrange(99)}" for _ in range(r.randrange(1, 9))) for _ in range(r.randrange(3, 12)))
    rows, planted = list(odd), {}
    for name, text in licenses.TEMPLATES.items():
        for width, mark, end in ((72, "", "\n"), (78, " * ", "\n"), (60, "// ", "\n"), (50, "# ", "\r\n"), (40, "", "\n\n")):
            i = 1000 + len(planted)
            planted[i] = name
            rows.append((i, f"{code()}\n{mark}Copyright (c) 2019 Somebody Else\n{mark}\n{wrapped(text, width, mark, end)}\n{mark}\n{code()}", "a"))
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan_licenses(frame(rows)).collect() if (r["doc_id"] or 0) >= 1000}
    for i, t, _ in rows:
        if (i or 0) >= 1000:
            assert got[i] == plain_scan(t), (planted[i], t)
    caught = [planted[i] in got[i][1].split(",") for i in planted]
    assert sum(caught) / len(caught) > 0.95 and all(got[i][0] for i in planted)
    for width in (10, 62):
        ten = "\n".join(" ".join(licenses.TEMPLATES["mit-grant"].split()[i : i + 10]) for i in range(0, width, 10))
        (row,) = licenses.scan_licenses(frame([(1, f"first line\n{ten}\nlast line of it", "a")])).collect()
        assert ("mit-grant" in row["licenses"]) == (width == 62)


def test_needed_words_lose_no_unit():
    r = random.Random(8)
    for name, text in licenses.TEMPLATES.items():
        words, bigrams = licenses.words_of(text), licenses.bigrams_of(text)
        needed = licenses.needed_words(bigrams, 0.8)
        assert len(needed) < 20
        for _ in range(60):  # texts without any of these words never fit, the most alike of them included
            w = [x for x in words if x not in needed and r.random() > 0.05]
            own = set(licenses.bigrams_of(" ".join(w)))
            best = [b for b in bigrams if not needed & set(b.split())]
            for g in (own, set(best)):
                assert 2 * len(g & set(bigrams)) / (len(g) + len(bigrams)) < 0.8 - 1e-12, name
