"""Graphs of transfers: edges are rows (sender, receiver, transaction_id, amount, ...), parallel
edges stay; a graph key (such as window_id) makes one table many graphs."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlume.functions.columns import half_up, micros
from ledgerlume.operators import cyclecount, profile, windows
from ledgerlume.operators.cyclecount import simple_cycles as count_cycles


def can_checkpoint(spark: SparkSession) -> None:
    """Checkpoints go to the folder the session names; local sessions may do without a name."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="ledgerlume-"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that the session names."""
    can_checkpoint(spark)
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{named.rstrip('/')}/ledgerlume/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written once, for what reads it several times."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checked(tx: DataFrame) -> DataFrame:
    """tx, if it may become a temporal graph: it has rows, and in the order of input (row_ord) no
    time is before the one ahead of it. Raises ValueError otherwise."""
    row = profile.out_of_order(tx, 10_000).crossJoin(tx.agg(F.count("*").alias("n"))).first()  # one row each
    if not row["n"]:
        raise ValueError("a temporal graph needs transfers; there are none")
    if row["out_of_order_rows"]:
        raise ValueError(f"transfers must be in the order of time; {row['out_of_order_rows']} rows are before the one ahead of them (clean them first)")
    return tx


def pairs(tx: DataFrame, *keys: str) -> DataFrame:
    """The collapsed digraph: distinct (sender, receiver) of each graph."""
    return tx.select(*keys, "sender", "receiver").distinct()


def nodes(tx: DataFrame, *keys: str) -> DataFrame:
    return tx.select(*keys, F.explode(F.array("sender", "receiver")).alias("account_id")).distinct()


def snapshot(tx: DataFrame, start_us: int, end_us: int, mode: str = "window") -> DataFrame:
    """The edges of one window, or of all time before its end."""
    if mode not in ("window", "cumulative"):
        raise ValueError(f"mode must be window or cumulative, not {mode!r}")
    us = micros("timestamp")
    return tx.where(us < end_us) if mode == "cumulative" else tx.where((us >= start_us) & (us < end_us))


def weak_components(edges: DataFrame, *keys: str, a: str = "sender", b: str = "receiver", rounds: int = 60) -> DataFrame:
    """(keys, node, component): the component is its smallest node. Stars of the smallest
    neighbour, a checkpoint each round; nothing is gathered on one machine."""
    spark = edges.sparkSession
    can_checkpoint(spark)
    k = list(keys)
    both = edges.select(*k, F.col(a).alias("u"), F.col(b).alias("v"))
    every = both.select(*k, F.explode(F.array("u", "v")).alias("node")).distinct()
    links = both.where("u <> v").select(*k, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    seen = None
    for _ in range(rounds):
        way = links.unionByName(links.select(*k, F.col("v").alias("u"), F.col("u").alias("v")))
        low = way.groupBy(*k, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = way.where("v > u").join(low, [*k, "u"]).select(*k, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy(*k, "u").agg(F.min("v").alias("m"))
        small = large.join(down, [*k, "u"]).select(*k, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = small.unionByName(down.select(*k, "u", F.col("m").alias("v"))).distinct().checkpoint()
        state = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*k, "u", "v").cast("decimal(38,0)")), F.lit(0)), F.count_distinct(F.struct(*k, "u"))).first()
        if seen == state[:2] and state[0] == state[2]:
            break
        seen = state[:2]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return every.join(links.withColumnRenamed("u", "node"), [*k, "node"], "left").select(*k, "node", F.coalesce("v", "node").alias("component"))


def tarjan(edges: list[tuple[str, str]]) -> dict[str, str]:
    """Strong components of a small graph: node to the smallest node of its component."""
    out: dict[str, list[str]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on, found = set(), {}
    for root in out:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, successors = work[-1]
            for w in successors:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    group = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        group.append(w)
                        if w == v:
                            break
                    least = min(group)
                    found |= dict.fromkeys(group, least)
    return found


def strong_one(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, component) of one graph of any size, by joins alone: each node takes the largest
    label that reaches it; a label's own component is what leads back to its node inside the
    label; those components leave the graph and the rest goes on. Every round is a checkpoint.
    """
    can_checkpoint(edges.sparkSession)
    every = nodes(edges).select(F.col("account_id").alias("node"))
    live = pairs(edges).where("sender <> receiver").toDF("u", "v").checkpoint()
    found = None

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0))).first())

    for _ in range(rounds):
        while (before := live.count()):  # what nothing leads to, or leads nowhere, is a component of its own
            live = live.join(live.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(live.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v").checkpoint()
            if live.count() == before:
                break
        if not before:
            break
        label = live.select(F.explode(F.array("u", "v")).alias("x")).distinct().withColumn("top", F.col("x")).checkpoint()
        seen = None
        while seen != (now := state(label)):
            seen = now
            come = live.join(label.withColumnRenamed("x", "u"), "u").groupBy(F.col("v").alias("x")).agg(F.max("top").alias("got"))
            label = label.join(come, "x", "left").select("x", F.greatest("top", F.coalesce("got", "top")).alias("top")).checkpoint()
        inside = live.join(label.toDF("u", "tu"), "u").join(label.toDF("v", "tv"), "v").where("tu = tv").select("u", "v").checkpoint()
        back = label.where("x = top").checkpoint()
        n = 0
        while n != (now := back.count()):
            n = now
            more = inside.join(back.withColumnRenamed("x", "v"), "v").select(F.col("u").alias("x"), "top")
            back = back.unionByName(more).distinct().checkpoint()
        found = back if found is None else found.unionByName(back)
        gone = back.select("x").checkpoint()
        live = live.join(gone.withColumnRenamed("x", "u"), "u", "left_anti").join(gone.withColumnRenamed("x", "v"), "v", "left_anti").select("u", "v").checkpoint()
    else:
        raise RuntimeError(f"strong components did not settle in {rounds} rounds")
    if found is None:
        return every.withColumn("component", F.col("node"))
    least = found.groupBy("top").agg(F.min("x").alias("component"))
    named = found.join(least, "top").select(F.col("x").alias("node"), "component")
    return every.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def strong_components(edges: DataFrame, *keys: str) -> DataFrame:
    """(keys, node, component). Of many graphs, such as windows, each is a task and its collapsed
    pairs must fit there; without keys the one graph is solved by joins."""
    if not keys:
        return strong_one(edges)
    k = list(keys)
    own = pairs(edges, *k)
    kinds = ", ".join(f"{c} {t}" for c, t in own.dtypes if c in k)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = tarjan(list(zip(pdf["sender"], pdf["receiver"], strict=True)))
        return pd.DataFrame({**dict(zip(k, key, strict=True)), "node": list(found), "component": list(found.values())})

    return own.groupBy(*k).applyInPandas(solve, f"{kinds}, node string, component string")


def components(edges: DataFrame, *keys: str, kind: str = "weak") -> DataFrame:
    if kind not in ("weak", "strong"):
        raise ValueError(f"kind must be weak or strong, not {kind!r}")
    return weak_components(edges, *keys) if kind == "weak" else strong_components(edges, *keys)


def stats(tx: DataFrame, *keys: str) -> DataFrame:
    """A row for each graph: nodes, edges, pairs, amount, components and density m / (n (n - 1))."""
    k = list(keys) or ["__g"]
    one = lambda df: df if keys else df.withColumn("__g", F.lit(0))
    own = one(tx)
    base = own.groupBy(*k).agg(F.count("*").alias("n_edges"), F.sum("amount").alias("total_amount"))
    n = nodes(own, *k).groupBy(*k).agg(F.count("*").alias("n_nodes"))
    m = pairs(own, *k).groupBy(*k).agg(F.count("*").alias("n_pairs"))

    def sized(kind: str, name: str) -> DataFrame:
        sizes = one(components(tx, *keys, kind=kind)).groupBy(*k, "component").agg(F.count("*").alias("size"))
        return sizes.groupBy(*k).agg(F.count("*").alias(f"{name}_components"), F.max("size").alias(f"largest_{name}"))

    out = base.join(n, k).join(m, k).join(sized("weak", "weak"), k).join(sized("strong", "strong"), k)
    room = F.col("n_nodes") * (F.col("n_nodes") - 1)
    out = out.withColumn("density", F.when(room > 0, F.col("n_pairs") / room).otherwise(0.0))
    return out if keys else out.drop("__g")


def k_hop(tx: DataFrame, start: str, k: int = 2, direction: str = "out") -> DataFrame:
    """(account_id, hops) within k hops of start, itself excluded. Every step joins the frontier,
    of distinct accounts, with the pairs."""
    p = pairs(tx)
    ways = {"out": p, "in": p.select(F.col("receiver").alias("sender"), F.col("sender").alias("receiver"))}
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction must be out, in or both, not {direction!r}")
    steps = ways["out"].unionByName(ways["in"]).distinct() if direction == "both" else ways[direction]
    reached = tx.sparkSession.createDataFrame([(start, 0)], "account_id string, hops int")
    frontier = reached
    for hop in range(1, k + 1):
        near = frontier.join(steps, frontier.account_id == steps.sender).select(F.col("receiver").alias("account_id")).distinct()
        frontier = near.join(reached, "account_id", "left_anti").withColumn("hops", F.lit(hop))
        reached = reached.unionByName(frontier)
    return reached.where("hops > 0")


#: Pairs of half paths that one task of a listing puts together, about.
TASK_PAIRS = 4_000_000


def _halves(first: DataFrame, steps: DataFrame, keys: list[str], hops: int, fits: Callable[[str], Column]) -> list[DataFrame]:
    """Simple paths (keys, x0, x1, ...) of 1 to hops hops: first has those of one, steps the edges
    (keys, tail, x), and a further account must fit. Each length is a checkpoint."""
    out = [first.checkpoint()]
    for n in range(1, hops):
        grown = out[-1].join(steps.toDF(*keys, f"x{n}", f"x{n + 1}"), [*keys, f"x{n}"])
        new = F.col(f"x{n + 1}")
        other = [new != F.col(f"x{i}") for i in range(n + 1)]
        out.append(grown.where(functools.reduce(Column.__and__, other, fits(f"x{n + 1}"))).select(*keys, *[f"x{i}" for i in range(n + 2)]).checkpoint())
    return out


def _met(ahead: DataFrame, behind: DataFrame, keys: list[str], i: int, j: int, ring: bool) -> DataFrame:
    """(keys, path) of i + j hops: halves ahead, of i hops, and behind, of j hops against the edges,
    that end at one account and share no other; those of a ring also start at one. The join's
    rows are counted before, so that no task, for hot ends neither, has many more than TASK_PAIRS;
    the paths themselves are not held anywhere."""
    back = behind.toDF(*keys, *[f"y{n}" for n in range(j + 1)]).withColumnRenamed(f"y{j}", f"x{i}")
    on = [*keys, f"x{i}"]
    if ring:
        back, on = back.withColumnRenamed("y0", "x0"), [*on, "x0"]
    fan = ahead.groupBy(*on).agg(F.count("*").alias("n")).join(back.groupBy(*on).agg(F.count("*").alias("m")), on).select((F.col("n") * F.col("m")).alias("pairs"))
    total, hottest = fan.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.max("pairs"), F.lit(0))).first()
    tasks, parts = 1 + min(20_000, total // TASK_PAIRS), 1 + min(1000, hottest // TASK_PAIRS)
    dealt = ahead.withColumn("part", F.pmod(F.xxhash64(*ahead.columns), F.lit(parts)))
    every = back.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    inside = [F.col(f"x{a}") != F.col(f"y{b}") for a in range(1, i) for b in range(1, j)]
    joined = dealt.repartition(tasks, *on, "part").join(every.repartition(tasks, *on, "part"), [*on, "part"])
    rest = [f"y{n}" for n in range(j - 1, 0 if ring else -1, -1)]
    return joined.where(functools.reduce(Column.__and__, inside, F.lit(True))).select(*keys, F.array(*[f"x{n}" for n in range(i + 1)], *rest).alias("path"))


def simple_paths(tx: DataFrame, source: str, target: str, max_length: int = 6) -> DataFrame:
    """(path array, length): simple paths of at most max_length hops. Halves grow from both ends
    and meet, so what is held is the square root of what is listed, about."""
    can_checkpoint(tx.sparkSession)
    p = pairs(tx).where("sender <> receiver").where(F.lit(source != target)).checkpoint()
    free = lambda x: (F.col(x) != source) & (F.col(x) != target)
    out = p.where((F.col("sender") == source) & (F.col("receiver") == target) & F.lit(max_length > 0)).select(F.array("sender", "receiver").alias("path"))
    back, longest = p.select(F.col("receiver").alias("sender"), F.col("sender").alias("receiver")), max(max_length, 2)
    ahead = _halves(p.where(F.col("sender") == source).toDF("x0", "x1").where(free("x1")), p, [], (longest + 1) // 2, free)
    behind = _halves(back.where(F.col("sender") == target).toDF("x0", "x1").where(free("x1")), back, [], longest // 2, free)
    for n in range(2, max_length + 1):
        i, j = (n + 1) // 2, n // 2
        out = out.unionByName(_met(ahead[i - 1], behind[j - 1], [], i, j, ring=False))
    return out.select("path", (F.size("path") - 1).alias("length"))


def _closed(p: DataFrame, keys: list[str], max_length: int) -> DataFrame:
    """(keys, path) of each simple cycle of 2 to max_length accounts, from its smallest on: halves
    that leave it and halves that lead to it meet."""
    back = p.select(*keys, F.col("receiver").alias("sender"), F.col("sender").alias("receiver"))
    more, longest = (lambda x: F.col(x) > F.col("x0")), max(max_length, 2)
    ahead = _halves(p.toDF(*keys, "x0", "x1").where("x0 < x1"), p, keys, (longest + 1) // 2, more)
    behind = _halves(back.toDF(*keys, "x0", "x1").where("x0 < x1"), back, keys, longest // 2, more)
    met = [_met(ahead[(n + 1) // 2 - 1], behind[n // 2 - 1], keys, (n + 1) // 2, n // 2, ring=True) for n in range(2, longest + 1)]
    return functools.reduce(DataFrame.unionByName, met)


def simple_cycles(tx: DataFrame, max_length: int = 6, *keys: str) -> DataFrame:
    """(keys, cycle array, length), each once, from its smallest account on, of 2 to max_length
    accounts. keys make one table many graphs."""
    can_checkpoint(tx.sparkSession)
    p = pairs(tx, *keys).where("sender <> receiver").checkpoint()
    return _closed(p, list(keys), max_length).select(*keys, F.col("path").alias("cycle"), F.size("path").alias("length"))


def node_activity(tx: DataFrame) -> DataFrame:
    """Counts, amounts and distinct partners of each account, as sender and as receiver."""
    out = tx.groupBy(F.col("sender").alias("account_id")).agg(F.count("*").alias("out_count"), F.sum("amount").alias("out_amount"), F.count_distinct("receiver").alias("unique_receivers"))
    inc = tx.groupBy(F.col("receiver").alias("account_id")).agg(F.count("*").alias("in_count"), F.sum("amount").alias("in_amount"), F.count_distinct("sender").alias("unique_senders"))
    return out.join(inc, "account_id", "full_outer").fillna(0)


def window_summary(tx: DataFrame, size: str = "1d") -> DataFrame:
    """A row for each window with transfers: nodes, transfers, amount and weak components."""
    w = windows.tumbling(tx, size)
    base = w.groupBy("window_id").agg(F.count("*").alias("n_transactions"), half_up(F.sum("amount"), 2).alias("total_amount"))
    sizes = weak_components(w, "window_id").groupBy("window_id", "component").agg(F.count("*").alias("size"))
    comp = sizes.groupBy("window_id").agg(F.sum("size").alias("n_nodes"), F.count("*").alias("n_components"), F.max("size").alias("largest_component"))
    return base.join(comp, "window_id")


def cumulative_summary(tx: DataFrame, size: str = "1d") -> DataFrame:
    """A row for each window: accounts, pairs and transfers seen before its end, and density.
    First sightings are counted by window and added up: no window reads another's rows."""
    w = windows.tumbling(tx, size)
    new_nodes = nodes(w, "window_id").groupBy("account_id").agg(F.min("window_id").alias("window_id")).groupBy("window_id").agg(F.count("*").alias("nodes"))
    new_pairs = pairs(w, "window_id").groupBy("sender", "receiver").agg(F.min("window_id").alias("window_id")).groupBy("window_id").agg(F.count("*").alias("pairs"))
    count = w.groupBy("window_id").agg(F.count("*").alias("transactions"))
    grid = windows.bounds(tx, size, size).select("window_id")
    joined = grid.join(new_nodes, "window_id", "left").join(new_pairs, "window_id", "left").join(count, "window_id", "left").fillna(0)
    so_far = Window.orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)  # a row for each window
    out = joined.select("window_id", *[F.sum(c).over(so_far).alias(c) for c in ("nodes", "pairs", "transactions")])
    room = F.col("nodes") * (F.col("nodes") - 1)
    return out.withColumn("density", F.when(room > 0, half_up(F.col("pairs") / room, 6)).otherwise(0.0))


def level_deltas(summary: DataFrame, columns: tuple[str, ...] = ("nodes", "transactions", "density")) -> DataFrame:
    by = Window.orderBy("window_id")  # a row for each window
    return summary.select("window_id", *[(F.col(c) - F.lag(c).over(by)).alias(f"delta_{c}") for c in columns])


def ring_cycles(tx: DataFrame, max_length: int = 8, *keys: str, most: int = cyclecount.MOST) -> DataFrame:
    """(keys, ring_id, n_cycles) among each ring's own accounts: edges inside one ring only. A ring
    of up to `most` accounts is a task, which counts without listing; larger ones, whose matrices
    would not fit there, are listed by joins and the same cycles counted."""
    can_checkpoint(tx.sparkSession)
    k = [*keys, "r"]
    member = nodes(tx.where("ring_id <> ''"), *keys, "ring_id").withColumnRenamed("ring_id", "r")
    of = lambda end: member.select(*k, F.col("account_id").alias(end))
    inside = pairs(tx, *keys).join(of("sender"), [*keys, "sender"]).join(of("receiver"), [*k, "receiver"])
    p = inside.where("sender <> receiver").select(*k, "sender", "receiver").distinct().checkpoint()
    large = nodes(p, *k).groupBy(*k).count().where(F.col("count") > most).select(*k).checkpoint()
    kinds = ", ".join(f"{c} {t}" for c, t in p.dtypes if c in k)

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = count_cycles(list(zip(pdf["sender"], pdf["receiver"], strict=True)), max_length)
        return pd.DataFrame([(*key, n)] if n else [], columns=[*k, "n_cycles"])

    out = p.join(large, k, "left_anti").groupBy(*k).applyInPandas(count, f"{kinds}, n_cycles long")
    if large.count():
        out = out.unionByName(_closed(p.join(large, k, "left_semi"), k, max_length).groupBy(*k).agg(F.count("*").alias("n_cycles")))
    return out.withColumnRenamed("r", "ring_id")
