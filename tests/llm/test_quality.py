import duckdb

from ledgerlume.llm import quality

SPACE = r"[^\x20\x09-\x0D]"

def letters(i):
    """A word for a number: digits count as alike in normalised lines."""
    return "".join(chr(97 + int(x)) for x in str(i))


# The default limits, as the operator's docstring and parameters state them.
CLEAN_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text, regexp_extract_all(coalesce(text, ''), '{SPACE}+') AS w FROM documents),
l AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
n AS (
  SELECT *, len(regexp_extract_all(line, '{SPACE}+')) AS words,
         trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM l
),
hosts AS (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host),
above AS (SELECT host, norm FROM n JOIN hosts USING (host) WHERE words > 0 GROUP BY host, norm, docs HAVING count(DISTINCT text) > 20 AND count(DISTINCT text) > 0.1 * docs),
c AS (
  SELECT doc_id, coalesce(sum(words) FILTER (WHERE norm IN (SELECT norm FROM above a WHERE a.host = n.host) AND words > 0), 0) AS gone,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT (words > 0 AND norm IN (SELECT norm FROM above a WHERE a.host = n.host))), '') AS clean
  FROM n GROUP BY doc_id
)
SELECT doc_id, clean AS text, gone FROM c
"""


def test_cleaned_texts_against_sql(spark, tmp_path):
    say = lambda i, n: " ".join(f"{letters(i)}-{letters(k)}" for k in range(n))
    rows = [(i, f"Page {i + 10} of 99\n{say(i, 60)}\n\n  \nCOMMON foot  line\nlast {i % 3}\n", "h") for i in range(60)]
    rows += [(100 + i, f"Common Foot line\n{say(i, 55)}", "other") for i in range(15)] + [(200 + i, f"{say(7, 90)}\nown {say(i, 3)} end", "k") for i in range(40)]
    rows += [(300, "Page 77 of 12", "h"), (301, None, "h"), (302, "", None), (303, say(3, 70), None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, source string, n_chars long")
    docs.toPandas().to_parquet(tmp_path / "d.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    want = {i: (t, g) for i, t, g in con.sql(CLEAN_SQL).fetchall()}
    kept = {r["doc_id"] for r in quality.judge_quality(docs).where("kept").collect()}
    got = quality.clean_documents(docs, size_col="n_chars").collect()
    assert {r["doc_id"] for r in got} == kept and len(got) == len(kept) >= 76
    assert 0 < sum(g > 0 for _, g in want.values())
    for r in got:
        assert r["text"] == want[r["doc_id"]][0] and r["n_chars"] == len(r["text"])
    assert all("COMMON" not in r["text"] and "Page" not in r["text"] for r in got if r["doc_id"] < 60)
    assert all(r["text"].startswith("Common") for r in got if 100 <= r["doc_id"] < 200)
    assert not kept & set(range(200, 240))  # depleted


def test_cleaning_odd_rows(spark, frame, odd):
    foot = "\nshared foot"
    rows = odd + [(500 + i, " ".join(f"z{letters(i)}y{letters(k)}" for k in range(60)) + foot, "z") for i in range(30)] + [(500, " ".join(f"other{letters(k)}" for k in range(60)) + foot, "z"), (None, " ".join(f"null{letters(k)}" for k in range(60)) + foot, "z")] * 2
    docs = frame(rows)
    judged = quality.judge_quality(docs).where("kept")
    got = quality.clean_documents(docs, size_col="n_chars")
    assert got.columns == docs.columns and got.schema == docs.schema
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(r["doc_id"]) for r in judged.collect())
    mine = [r for r in got.collect() if r["source"] == "z"]
    assert len(mine) == 34 and not any("foot" in r["text"] for r in mine) and all(r["n_chars"] == len(r["text"]) for r in mine)
    texts = {(i, t) for i, t, _ in odd}
    assert all((r["doc_id"], r["text"]) in texts for r in got.collect() if r["source"] != "z")
    assert quality.clean_documents(docs.limit(0)).count() == 0
    clash = docs.toDF("doc_id", "text", "id", "source", "key", "gone", "kept", "host", "row", "line", "body", "n_words")
    assert quality.clean_documents(clash).count() == got.count()
