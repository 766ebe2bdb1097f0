"""Paths of transfers in time, by slices of time.

A slice is a task. It holds the transfers of its own stretch, from which paths start, and those up
to a horizon behind it, as sorted arrays of numbers; paths are never shuffled, only transfers are,
each to the slices that may need it. Steps of paths are ranges in the sorted arrays. A task takes
the memory of the transfers of one stretch and horizon, and of BLOCK rows of paths besides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlume.functions.columns import micros
from ledgerlume.operators import windows

#: Rows of paths that a task expands at a time, about.
BLOCK = 1 << 20


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every place of the ranges [low, high), row by row."""
    n = np.maximum(high - low, 0)
    ends = np.cumsum(n)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n - low, n)


def pieces(n: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive rows whose n add up to about `most`."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


class Transfers:
    """The transfers of a slice, in the order of (sender, time, input). Accounts are numbered in the
    order of their names, moments in their order; `where` finds places among an account's sends."""

    def __init__(self, t: pa.Table) -> None:
        both = pa.chunked_array([*t["sender"].chunks, *t["receiver"].chunks]).combine_chunks().dictionary_encode()
        both = both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both
        order = pc.sort_indices(both.dictionary).to_numpy()
        self.names, place = both.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        codes = place[both.indices.to_numpy()]
        us, n = t["us"].to_numpy(), t.num_rows
        self.moments, moment = np.unique(us, return_inverse=True)
        by = np.lexsort((t["row_ord"].to_numpy(), moment, codes[:n]))
        self.sender, self.receiver, self.moment = codes[:n][by].astype(np.int32), codes[n:][by].astype(np.int32), moment[by].astype(np.int32)
        self.by, self.ids, self.span = by, t["transaction_id"].combine_chunks(), len(self.moments) + 1
        self.key = self.sender * np.int64(self.span) + self.moment
        self.ends = np.searchsorted(self.sender, np.arange(len(self.names) + 1))
        self.own = t["own"].to_numpy(zero_copy_only=False)[by]

    def where(self, account: np.ndarray, moment: np.ndarray, side: str = "left") -> np.ndarray:
        return np.searchsorted(self.key, account * np.int64(self.span) + moment, side)

    def until(self, leg: np.ndarray, us: int, side: str) -> np.ndarray:
        """The number of the first moment at (left) or after (right) so much later than legs."""
        return np.searchsorted(self.moments, self.moments[self.moment[leg]] + us, side)

    def lists(self, flat: np.ndarray, sizes: np.ndarray, of: pa.Array) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), of.take(pa.array(flat)).cast(pa.string()))


def by_slices(tx: DataFrame, length_us: int, horizon_us: int, solve: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, *columns: str, starts: DataFrame | None = None) -> DataFrame:
    """solve of every slice's transfers: us, row_ord, sender, receiver, transaction_id, the given
    columns, and own, whether paths may start there: in its stretch, and from one of the accounts
    of starts (account_id), if given. A slice holds whole what is up to the horizon after any
    moment of its stretch."""
    t0, t1 = windows.extent(tx).first()  # one row
    last = 0 if t0 is None else (t1 - t0) // length_us
    rel = F.col("us") - F.lit(t0 or 0)
    low = F.greatest(F.lit(0).cast("long"), F.floor((rel - horizon_us) / length_us))
    base = tx.withColumn("us", micros("timestamp")).where("us IS NOT NULL AND sender IS NOT NULL AND receiver IS NOT NULL")
    flagged = base.withColumn("__own", F.lit(True))
    if starts is not None:
        named = starts.select(F.col("account_id").alias("sender")).distinct().withColumn("__starts", F.lit(True))
        flagged = base.join(named, "sender", "left").withColumn("__own", F.coalesce("__starts", F.lit(False)))
    dealt = flagged.select("us", "row_ord", "sender", "receiver", "transaction_id", *columns, "__own", F.explode(F.sequence(low, F.floor(rel / length_us))).alias("slice"))
    own_here = F.col("__own") & (F.floor(rel / length_us) == F.col("slice"))
    rows = dealt.select("us", "row_ord", "sender", "receiver", "transaction_id", *columns, own_here.alias("own"), F.col("slice").cast("int").alias("slice")).repartitionById(last + 1, "slice")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from solve(pa.Table.from_batches(held).drop_columns(["slice"]))

    return rows.mapInArrow(run, schema)


CYCLE = "ids array<string>, accounts array<string>, first_us long, last_us long, start_amount double, closing_amount double"


def cycles(t: pa.Table, max_length: int, days_us: int, branching: int | None, rows: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Cycles of 2 to max_length strictly later transfers from every own transfer. The last two
    are found from the end: what leads back to an account in two steps is listed for a block of
    accounts, and paths from these meet it. branching: of the later sends of an account only so
    many first ones are steps; None for all."""
    x = Transfers(t)
    amount = t["amount"].to_numpy(zero_copy_only=False)[x.by]
    n, names = len(x.sender), len(x.names)
    next_ = x.where(x.receiver, x.moment, "right")
    stop = x.ends[x.receiver + 1] if branching is None else np.minimum(next_ + branching, x.ends[x.receiver + 1])
    into = np.lexsort((x.moment, x.receiver))
    in_key = x.receiver[into] * np.int64(x.span) + x.moment[into]
    in_ends = np.searchsorted(x.receiver[into], np.arange(names + 1))

    def batch(legs: list[np.ndarray]) -> pa.RecordBatch:
        path = np.stack(legs, 1)
        a, k = path.ravel(), np.full(len(path), path.shape[1])
        there = x.sender[path]
        loop = there[:, 0] == there[:, 1]  # it starts with a transfer to itself, which counts as a place
        keep = np.ones(there.shape, bool)
        keep[loop, 1] = False
        first, last = path[:, 0], path[:, -1]
        return pa.RecordBatch.from_arrays([
            x.lists(x.by[a], k, x.ids), x.lists(there[keep], k - loop, x.names), pa.array(x.moments[x.moment[first]]), pa.array(x.moments[x.moment[last]]), pa.array(amount[first], from_pandas=True), pa.array(amount[last], from_pandas=True),
        ], names=["ids", "accounts", "first_us", "last_us", "start_amount", "closing_amount"])

    own = np.flatnonzero(x.own)
    who, heads = np.unique(x.sender[own], return_index=True)
    tails = np.append(heads[1:], len(own))
    # accounts by about as many ways back, so that a block's list and its bits stay small
    ways = np.concatenate([[0], np.cumsum(np.diff(in_ends)[x.sender[into]])])
    size = np.maximum(ways[in_ends[who + 1]] - ways[in_ends[who]], names // 32 + 1)
    bits, local = np.zeros((rows // (names // 32 + 1) + 1) * names, bool), np.zeros(names, np.int64)
    for piece in pieces(size, rows):
        block = who[piece]
        starts = own[heads[piece.start] : tails[piece.stop - 1]]
        local[block] = np.arange(len(block))
        deadline = x.until(starts, days_us, "right")  # the first moment that is too late
        # two legs at once: transfers to oneself
        r, leg = ranges(next_[starts], np.minimum(stop[starts], x.where(x.receiver[starts], deadline)))
        done = x.receiver[leg] == x.sender[starts[r]]
        if done.any() and max_length >= 2:
            yield batch([starts[r[done]], leg[done]])
        if max_length < 3:
            continue
        r, at = ranges(in_ends[block], in_ends[block + 1])
        z, home = into[at], r
        f = x.sender[z]
        keep = f != block[home]
        z, home, f = z[keep], home[keep], f[keep]
        low, high = in_ends[f], np.searchsorted(in_key, f * np.int64(x.span) + x.moment[z], "left")
        r, at = ranges(low, high)
        y = into[at]
        keep = x.sender[y] != f[r]
        if branching is not None:
            keep &= z[r] < stop[y]
        y, r = y[keep], r[keep]
        z, home = z[r], home[r]
        meet = home * np.int64(names) + x.sender[y]
        by = np.lexsort((x.moment[y], meet))
        y, z, meet = y[by], z[by], meet[by]
        back = meet * np.int64(x.span) + x.moment[y]
        bits[meet] = True

        def grow(legs: list[np.ndarray], limit: np.ndarray) -> Iterator[pa.RecordBatch]:
            """legs: paths, a column for each transfer; limit: the first moment that is too late."""
            home, last = local[x.sender[legs[0]]], legs[-1]
            goal = home * np.int64(names) + x.receiver[last]
            met = np.flatnonzero(bits[goal])
            if len(met):
                m = goal[met] * np.int64(x.span)
                low, high = np.searchsorted(back, m + x.moment[last[met]], "right"), np.searchsorted(back, m + x.span, "left")
                for some in pieces(high - low, rows):
                    r, at = ranges(low[some], high[some])
                    r = met[some][r]
                    f = x.receiver[y[at]]
                    ok = (x.moment[z[at]] < limit[r]) & (f != x.sender[legs[0][r]])
                    if branching is not None:
                        ok &= y[at] < stop[last[r]]
                    for leg in legs:
                        ok &= f != x.receiver[leg[r]]
                    if ok.any():
                        yield batch([*[leg[r[ok]] for leg in legs], y[at[ok]], z[at[ok]]])
            if len(legs) + 2 >= max_length:
                return
            low, high = next_[last], np.minimum(stop[last], x.where(x.receiver[last], limit))
            for some in pieces(np.maximum(high - low, 0), rows):
                r, at = ranges(low[some], high[some])
                r += some.start
                new = x.receiver[at]
                if len(legs) + 3 == max_length:  # these only meet the ways back
                    ok = bits[home[r] * np.int64(names) + new]
                    r, at, new = r[ok], at[ok], new[ok]
                ok = new != x.sender[legs[0][r]]
                for leg in legs:
                    ok &= new != x.receiver[leg[r]]
                r, at = r[ok], at[ok]
                if len(r):
                    yield from grow([*[leg[r] for leg in legs], at], limit[r])

        yield from grow([starts], deadline)
        bits[meet] = False


MERGE = "source string, t long, o long, targets array<string>, rows array<string>, dest string, ids array<string>"


def merges(t: pa.Table, z: int, rows: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """For each sender its first own transfer from which on it pays, within z, two or more receivers
    of whom two or more pay one account within 2 z. A sender's transfers are tried in rounds, few
    at first; a sender that has its event takes part no more."""
    x = Transfers(t)
    ord_ = t["row_ord"].to_numpy()[x.by]
    n, names = len(x.sender), np.int64(len(x.names))
    own = np.flatnonzero(x.own)
    low, one = x.where(x.sender[own], x.moment[own]), x.until(own, z, "left")
    high = x.where(x.sender[own], one)
    # from a place on, the first at which the receiver is another one
    turn = np.append(np.flatnonzero((x.receiver[1:] != x.receiver[:-1]) | (x.sender[1:] != x.sender[:-1])) + 1, n)
    able = turn[np.searchsorted(turn, low, "right")] < high if n else np.zeros(0, bool)
    own, low, high = own[able], low[able], high[able]
    far = x.until(own, 2 * z, "left")
    first = np.flatnonzero(np.append(True, x.sender[own][1:] != x.sender[own][:-1])) if len(own) else np.zeros(0, int)
    nth = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own)))) if len(own) else np.zeros(0, int)
    found, a, b = np.full(names, -1, np.int64), 0, 4
    chosen: dict[int, int] = {}

    def pays(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of some, target), each once."""
        r, leg = ranges(low[some], high[some])
        pair = np.unique(r * names + x.receiver[leg])
        return pair // names, pair % names

    while len(own) and a <= nth.max():
        batch = np.flatnonzero((nth >= a) & (nth < b) & (found[x.sender[own]] < 0))
        for piece in pieces((high - low)[batch] * 8, rows):
            some = batch[piece]
            r, target = pays(some)
            start, end = x.where(target, x.moment[own[some[r]]]), x.where(target, far[some[r]])
            for part in pieces(np.bincount(r, np.maximum(end - start, 0), len(some)), 4 * rows):
                inside = slice(*np.searchsorted(r, [part.start, part.stop]))
                q, leg = ranges(start[inside], end[inside])
                q += inside.start
                goal = (r[q] - part.start) * names + x.receiver[leg]
                s = np.sort(goal)
                twice = np.unique(s[1:][s[1:] == s[:-1]])
                if not len(twice):
                    continue
                k = np.searchsorted(twice, goal)
                hit = twice[np.minimum(k, len(twice) - 1)] == goal
                # of the accounts paid twice those that different receivers pay
                pair = np.unique(k[hit] * (int(q.max()) + 1) + q[hit])
                count = np.bincount(pair // (int(q.max()) + 1), minlength=len(twice))
                good = count >= 2
                row, dest, count = twice[good] // names + part.start, twice[good] % names, count[good]
                best = np.lexsort((dest, -count, row))
                row, dest = row[best], dest[best]
                head = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else []
                for i in head:
                    who, anchor = int(x.sender[own[some[row[i]]]]), int(some[row[i]])
                    if found[who] < 0 or anchor < found[who]:
                        found[who], chosen[who] = anchor, int(dest[i])
        a, b = b, b * 8
    events = []
    for who in sorted(chosen):
        i, dest = int(found[who]), chosen[who]
        legs = np.arange(low[i], high[i])
        _, at = np.unique(x.receiver[legs], return_index=True)
        targets = x.receiver[legs[np.sort(at)]]
        _, on = ranges(x.where(targets, np.full(len(targets), x.moment[own[i]])), x.where(targets, np.full(len(targets), far[i])))
        on = on[x.receiver[on] == dest]
        on = on[np.lexsort((ord_[on], x.moment[on]))]
        events.append((who, int(x.moments[x.moment[own[i]]]), int(ord_[own[i]]), targets, x.by[legs], dest, x.by[on]))
    for i in range(0, len(events), 10_000):
        who, at, o, targets, legs, dest, ids = zip(*events[i : i + 10_000], strict=True)
        nested = lambda lists, of: x.lists(np.concatenate(lists), np.array([len(e) for e in lists]), of)
        yield pa.RecordBatch.from_arrays([x.names.take(pa.array(who)), pa.array(at, pa.int64()), pa.array(o, pa.int64()), nested(targets, x.names), nested(legs, x.ids), x.names.take(pa.array(dest)), nested(ids, x.ids)], names=[c.split()[0] for c in MERGE.split(", ")])
