"""Licence scans by Dice coefficient over word bigrams, in DataFrame functions only.

A unit is a line of a document or, of more than one line, the whole text; or a window over
lines: from a line whose first two words (of this line and the next) are a bigram of a
template on, as many words as the template has, if that takes more than one line. So notices
that are wrapped inside a longer text are found. Units and templates are normalised alike:
lower case, everything but letters and digits a space. Dice of two sets of bigrams a and b is
at most 2 * min(a, b) / (a + b), so only templates of a size within these bounds of the unit's
size are compared.

A unit that fits a template holds so many of its bigrams that it must hold one of a few of its
words; texts and lines without any of these are done before they are cut into words.

Plan: one narrow projection over the texts; the templates are a literal (their number and
size are a parameter of the caller, bounded by `max_templates`). No shuffle, no join.

Defined results: a null or empty text has no match. Repeated rows each give a row. Units or
templates of fewer than two words have no bigrams and match nothing. Lines without words don't
count in windows. Names are listed once, sorted; of equal scores the smaller name is best.
n_matches counts the lines and the whole text that fit; where none does, the windows that fit.
Empty tables give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlume.llm.licensetexts import NOTICES, TEXTS
from ledgerlume.llm.shared import let

TEMPLATES = NOTICES | TEXTS
THRESHOLD = 0.8


def words_of(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _words(text: Column) -> Column:
    """The words of a text in lower case; an empty text has the one word ""."""
    return F.split(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " ")


def _pairs(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))


def needed_words(bigrams: list[str], threshold: float) -> set[str]:
    """Words of which a unit that fits these bigrams must hold one: without them so many of the
    bigrams are away that no size of the unit reaches the threshold. Long words are taken first."""
    n = len(bigrams)
    least = threshold * (n * threshold / (2 - threshold) + n) / 2
    away: set[str] = set()
    taken: set[str] = set()
    while n - len(away) >= least - 1e-9:
        rest = [b for b in bigrams if b not in away]
        gain = {w: sum(w in b.split() for b in rest) for b in rest for w in b.split()}
        best = max(gain, key=lambda w: (len(w) > 5, gain[w], len(w), w))
        taken.add(best)
        away.update(b for b in rest if best in b.split())
    return taken


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD, max_templates: int = 5000) -> DataFrame:
    """Per document row: its id, n_matches (units that some template fits), the fitting names
    comma-joined, and the best name and score (null where none fits)."""
    texts = {k: v for k, v in sorted((TEMPLATES if templates is None else templates).items()) if bigrams_of(v)}
    own = {k: bigrams_of(v) for k, v in texts.items()}
    if len(own) > max_templates:
        raise ValueError(f"{len(own)} templates; the literal takes {max_templates} at most")
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    kind = "struct<name:string,n:int,words:int,low:double,high:double,bigrams:array<string>>"
    known = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(len(b)).alias("n"), F.lit(len(words_of(texts[k]))).alias("words"), F.lit(len(b) * low - 1e-9).alias("low"), F.lit(len(b) * high + 1e-9).alias("high"), F.array(*map(F.lit, b)).alias("bigrams")).cast(kind) for k, b in own.items()]).cast(f"array<{kind}>")
    most = max([0, *(len(b) for b in own.values())]) * high
    needed = set().union(*(needed_words(b, threshold) for b in own.values()))
    by_letter = {a: "|".join(w[1:] for w in ws) for a, ws in itertools.groupby(sorted(needed), key=lambda w: w[0])}  # letters and digits need no escape
    some = rf"(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(f'{a}(?:{rest})' for a, rest in by_letter.items())})(?![\p{{L}}\p{{N}}])"
    holds = lambda x: F.rlike(x, F.lit(some)) if needed else F.lit(False)
    none = F.array().cast("array<array<struct<dice:double,name:string>>>")

    def scored(grams: Column, n: Column, fits: Column) -> Column:
        dice = F.transform(fits, lambda t: F.struct((F.size(F.array_intersect(grams, t["bigrams"])) * 2.0 / (n + t["n"])).alias("dice"), t["name"].alias("name")))
        return F.filter(dice, lambda s: s["dice"] >= threshold)

    def compared(grams: Column) -> Column:
        return let(F.size(grams), lambda n: scored(grams, n, F.filter(known, lambda t: (n >= t["low"]) & (n <= t["high"]))))

    lines = F.split("__low", "\n", -1)
    units = F.filter(F.when(F.size(lines) > 1, F.concat(lines, F.array("__low"))).otherwise(lines), holds)
    sized = F.filter(F.transform(units, lambda u: F.array_distinct(let(_words(u), _pairs))), lambda u: (F.size(u) > 0) & (F.size(u) <= most + 1e-9))
    by_unit = F.filter(F.transform(sized, compared), lambda m: F.size(m) > 0)

    spelt = F.flatten(F.transform(lines, lambda x, i: F.transform(F.filter(_words(x), lambda w: w != ""), lambda w: F.struct(w.alias("w"), i.alias("line")))))

    def in_windows(spelt: Column) -> Column:
        heads = F.filter(F.transform(spelt, lambda s, k: F.when((k == 0) | (F.get(spelt, k - 1)["line"] != s["line"]), k)), lambda k: k.isNotNull())
        return let(F.struct(_pairs(F.transform(spelt, lambda s: s["w"])).alias("grams"), heads.alias("heads")), lambda x: F.transform(x["heads"], lambda k: window(spelt, x["grams"], k)))

    def window(spelt: Column, grams: Column, k: Column) -> Column:
        wraps = lambda t: F.get(spelt, k + t["words"] - 1)["line"].isNull() | (F.get(spelt, k + t["words"] - 1)["line"] != F.get(spelt, k)["line"])
        begun = F.filter(known, lambda t: F.array_contains(t["bigrams"], F.get(grams, k)) & wraps(t))
        one = lambda t: let(F.array_distinct(F.slice(grams, k + 1, t["words"] - 1)), lambda g: let(F.size(g), lambda n: scored(g, n, F.filter(F.array(t), lambda t: (n >= t["low"]) & (n <= t["high"])))))
        return F.flatten(F.transform(begun, one))

    by_window = F.filter(let(spelt, in_windows), lambda m: F.size(m) > 0)
    lowered = docs.select(F.col(id_col).alias("__id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("__low"))
    found = lowered.withColumn("__held", holds(F.col("__low")))
    found = found.select("__id", F.when(F.col("__held"), by_unit).otherwise(none).alias("__u"), F.when(F.col("__held") & F.contains("__low", F.lit("\n")), by_window).otherwise(none).alias("__w"))
    every = found.withColumn("__all", F.concat(F.flatten("__u"), F.flatten("__w")))
    best = F.aggregate("__all", F.lit(None).cast("struct<dice:double,name:string>"), lambda a, s: F.when(a.isNull() | (s["dice"] > a["dice"]) | ((s["dice"] == a["dice"]) & (s["name"] < a["name"])), s).otherwise(a))
    named = every.withColumn("__best", best)
    n_matches = F.when(F.size("__u") > 0, F.size("__u")).otherwise(F.size("__w")).cast("long")
    return named.select(
        F.col("__id").alias(id_col), n_matches.alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("__all", lambda s: s["name"]))), ",").alias("licenses"),
        F.col("__best.name").alias("best"), F.round("__best.dice", 6).alias("best_dice"),
    )


def sql() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    words = r"string_split(trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    grams = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    return f"""
WITH t AS (SELECT name, {grams} AS g FROM (SELECT name, {words.format("body")} AS w FROM (VALUES {values}) v(name, body))),
u AS (
  SELECT doc_id, 0 AS unit, text AS body FROM documents WHERE contains(text, chr(10))
  UNION ALL SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1), unnest(string_split(text, chr(10))) FROM documents
), b AS (SELECT doc_id, unit, {grams} AS g FROM (SELECT doc_id, unit, {words.format("body")} AS w FROM u)),
m AS (
  SELECT doc_id, unit, name, len(list_intersect(b.g, t.g)) * 2.0::DOUBLE / (len(b.g) + len(t.g)) AS dice
  FROM b JOIN t ON len(b.g) BETWEEN len(t.g) * {THRESHOLD / (2 - THRESHOLD)} - 1e-9 AND len(t.g) * {(2 - THRESHOLD) / THRESHOLD} + 1e-9 AND len(b.g) > 0
), f AS (SELECT * FROM m WHERE dice >= {THRESHOLD}),
a AS (
  SELECT doc_id, count(DISTINCT unit) AS n_matches, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses,
         arg_min(name, (-dice, name)) AS best, max(dice) AS best_dice FROM f GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(licenses, '') AS licenses, best, round(best_dice, 6) AS best_dice
FROM documents d LEFT JOIN a USING (doc_id)
"""
