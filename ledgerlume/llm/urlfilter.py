"""URL filters by a sort-merge range join.

A rule (host, path) becomes an interval of reversed-host keys: "example.net" is the key
"net.example." and covers every key that begins with it. Urls and rules are swept in key
order with a stack of the rules' hosts that are active; hosts nest, so the stack is as deep
as a host has labels at most. At each level the rules' paths, sorted, nest in the same way and
the longest that begins the url's path is found by a search and the links to shorter ones.

Plan: rules whose table is proved small (`map_rules` rows and `map_bytes` bytes) are broadcast
and each task sweeps its own sorted urls: no shuffle at all. More rules than that: boundaries
taken from a bounded sample of keys of urls and rules deal both by key range; a rule goes to
each range its interval meets, and a host that spans several ranges has its urls spread over
all of them by hash. Spark sorts a range, rules before urls of one key, and the sweep streams
over it: memory holds a batch and the rules of the nested hosts on the stack. Ids stay in
Arrow from end to end, so 64-bit values are exact beside nulls.

Defined results: a null url or one without "://" has an empty host and path and fits no rule.
Rules with a null or empty host, null path or a verdict other than allow or block are left
out. The longest fitting rule wins (host and path characters together; then the longer host;
then block), whatever the order of the rules; repeated rules change nothing. An url that no
rule fits gets `default`. Repeated page rows each give a row; empty tables give no rows or
the default. Ids are cast to long. Other columns are not looked at.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlume.llm.shared import written


def key_of(host: str) -> str:
    return "".join(x + "." for x in reversed(host.split("."))) if host else ""


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    cut = rest.find("/", 0, end)
    cut = end if cut < 0 else cut
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, rest[cut:end]


class Level:
    """The paths of one rule host, sorted, each linked to the longest shorter one that begins it."""

    def __init__(self, host: str, rules: Iterable[tuple[str, str]]) -> None:
        self.host, self.key = host, key_of(host)
        best: dict[str, str] = {}
        for path, verdict in rules:
            best[path] = "block" if "block" in (verdict, best.get(path)) else verdict
        self.paths = sorted(best)
        self.verdicts = [best[p] for p in self.paths]
        self.above: list[int] = []
        open_: list[int] = []
        for i, p in enumerate(self.paths):
            while open_ and not p.startswith(self.paths[open_[-1]]):
                open_.pop()
            self.above.append(open_[-1] if open_ else -1)
            open_.append(i)

    def find(self, path: str) -> int:
        i = bisect.bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.above[i]
        return i


def levels_of(rules: Iterable[tuple[str, str, str]]) -> list[Level]:
    """Sorted by key, so that a host stands right before the hosts below it."""
    by: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by.setdefault(host, []).append((path, verdict))
    return sorted((Level(h, r) for h, r in by.items()), key=lambda x: x.key)


class Sweep:
    """The stack of rule hosts that are active at a key; keys come in order."""

    def __init__(self) -> None:
        self.stack: list[Level] = []

    def leave(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1].key):
            self.stack.pop()

    def enter(self, level: Level) -> None:
        self.leave(level.key)
        self.stack.append(level)

    def best(self, path: str) -> tuple[str, str] | None:
        """The winning (rule, verdict) at the key that was last left for."""
        size, won = -1, None
        for level in self.stack:  # deeper, longer hosts come later and win a tie
            if (i := level.find(path)) >= 0 and len(level.host) + len(level.paths[i]) >= size:
                size, won = len(level.host) + len(level.paths[i]), (level.host + level.paths[i], level.verdicts[i])
        return won


def sweep(urls: Iterable[tuple[str, str]], levels: list[Level]) -> Iterator[tuple[str, str] | None]:
    """For urls (key, path) in key order: the winning (rule, verdict) or None."""
    active, nxt, last = Sweep(), 0, None
    for key, path in urls:
        if key != last:
            while nxt < len(levels) and levels[nxt].key <= key:
                active.enter(levels[nxt])
                nxt += 1
            active.leave(key)
            last = key
        yield active.best(path)


def _strings(values: Iterable[str | None]) -> pa.Array:
    return pa.array(list(values), pa.string())


def _rows(ids: pa.Array, hosts: list[str], paths: list[str], won: list[tuple[str, str] | None], default: str) -> pa.RecordBatch:
    won = [w if w and h else (None, default) for w, h in zip(won, hosts, strict=True)]
    return pa.RecordBatch.from_arrays([ids, _strings(hosts), _strings(paths), _strings(r for r, _ in won), _strings(v for _, v in won)], names=["__id", "host", "path", "rule", "verdict"])


def _by_map(rules, default: str):
    def judge(batches):
        levels = levels_of(rules.value)
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            keys = [key_of(h) for h, _ in parts]
            order = sorted(range(len(keys)), key=keys.__getitem__)
            won: list[tuple[str, str] | None] = [None] * len(keys)
            for i, w in zip(order, sweep(((keys[i], parts[i][1]) for i in order), levels), strict=True):
                won[i] = w
            yield _rows(batch.column(0), [h for h, _ in parts], [p for _, p in parts], won, default)

    return judge


DEALT = ("part", "key", "is_url", "path", "host", "verdict", "__id")
DEALT_ROW = "part long, key string, is_url boolean, path string, host string, verdict string, __id long"


def _deal_urls(bounds):
    """Adds the range of each url; of a host that several ranges hold, one of them."""

    def deal(batches):
        cuts = bounds.value
        for batch in batches:
            parts, keys, n = [], [], len(batch)
            split = [split_url(u) for u in batch.column(1).to_pylist()]
            for (host, _), salt in zip(split, batch.column(2).to_pylist(), strict=True):
                key = key_of(host)
                lo, hi = bisect.bisect_left(cuts, key), bisect.bisect_right(cuts, key)
                parts.append(lo + salt % (hi - lo + 1))
                keys.append(key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int64()), _strings(keys), pa.array([True] * n, pa.bool_()), _strings(p for _, p in split), _strings(h for h, _ in split), pa.nulls(n, pa.string()), batch.column(0)], names=list(DEALT),
            )

    return deal


def _deal_rules(bounds):
    """A row of each rule for every range that its interval meets."""

    def deal(batches):
        cuts = bounds.value
        for batch in batches:
            out = []
            for host, path, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = key_of(host)
                lo, hi = bisect.bisect_left(cuts, key), bisect.bisect_right(cuts, key[:-1] + "/")
                out += [(p, key, path, host, verdict) for p in range(lo, hi + 1)]
            part, *text = zip(*out, strict=True) if out else [()] * 5
            key, path, host, verdict = map(_strings, text)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), key, pa.array([False] * len(out), pa.bool_()), path, host, verdict, pa.nulls(len(out), pa.int64())], names=list(DEALT))

    return deal


def _swept(default: str):
    """Streams over rows in order of (part, key, rules first)."""

    def run(batches):
        active, now, last = Sweep(), None, None
        waiting: tuple[str, list[tuple[str, str]]] | None = None
        for batch in batches:
            part, key, is_url, path, host, verdict = (batch.column(i).to_pylist() for i in range(6))
            places, won = [], []
            for i in range(len(part)):
                if part[i] != now:
                    active, now, last, waiting = Sweep(), part[i], None, None
                if waiting and (is_url[i] or waiting[0] != host[i]):
                    active.enter(Level(*waiting))
                    waiting = None
                if not is_url[i]:
                    waiting = waiting or (host[i], [])
                    waiting[1].append((path[i], verdict[i]))
                    continue
                if key[i] != last:
                    active.leave(key[i])
                    last = key[i]
                places.append(i)
                won.append(active.best(path[i]))
            if places:
                yield _rows(batch.column(6).take(pa.array(places, pa.int64())), [host[i] for i in places], [path[i] for i in places], won, default)

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", map_rules: int = 100_000, map_bytes: int = 16 << 20, range_rows: int = 200_000, sample: int = 20_000) -> DataFrame:
    """Per page row: its id, host, path, the winning rule and the verdict.

    map_rules, map_bytes: rules that may be broadcast, their number and characters' bytes.
    range_rows: urls and rules of one range, about, beyond that. sample: keys that choose the
    boundaries of ranges.
    """
    spark = pages.sparkSession
    rules = rules.select("host", "path", "verdict").where(F.col("host").isNotNull() & (F.col("host") != "") & F.col("path").isNotNull() & F.col("verdict").isin("allow", "block"))
    urls = pages.select(F.col(id_col).cast("long").alias("__id"), F.col(url_col).cast("string").alias("__url"))
    schema = "__id long, host string, path string, rule string, verdict string"
    n_rules, size = rules.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0))).first()
    if n_rules <= map_rules and size <= map_bytes:
        shared = spark.sparkContext.broadcast([tuple(r) for r in rules.collect()])
        return urls.mapInArrow(_by_map(shared, default), schema).withColumnRenamed("__id", id_col)
    rules = written(rules, "rules")
    host = F.lower(F.regexp_extract(F.col("__url"), r"://([^/?#]*)", 1))
    keyed = urls.select(host.alias("host"), F.xxhash64("__url", "__id").alias("draw")).unionByName(rules.select("host", F.xxhash64("host", "path").alias("draw")))
    drawn = keyed.orderBy("draw").limit(sample).collect()
    ranges = max(1, (urls.count() + n_rules) // range_rows)
    keys = sorted(key_of(r["host"] or "") for r in drawn)
    cuts = spark.sparkContext.broadcast([keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else [])
    salted = urls.withColumn("salt", F.pmod(F.xxhash64("__url", "__id"), F.lit(1 << 20)))
    both = salted.mapInArrow(_deal_urls(cuts), DEALT_ROW).unionByName(rules.mapInArrow(_deal_rules(cuts), DEALT_ROW))
    dealt = both.repartition("part").sortWithinPartitions("part", "key", "is_url")
    return dealt.mapInArrow(_swept(default), schema).withColumnRenamed("__id", id_col)
