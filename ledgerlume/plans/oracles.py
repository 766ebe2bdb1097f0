"""Each query in SQL over the driver's tables, for another engine to check against."""

from __future__ import annotations

import re

from ledgerlume.functions.config import PATTERN_WEIGHTS
from ledgerlume.operators import evidence

DAY = 86_400_000_000
HOUR = 3_600_000_000

#: Common table expressions by name; each may use those before it.
CTE: dict[str, str] = {}
SQL: dict[str, str] = {}


def _half_up(text: str) -> str:
    """round(x, n) in plain double arithmetic, halves upwards."""
    at = 0
    while (i := text.find("round(", at)) >= 0:
        depth, j, comma = 0, i + 5, -1
        while True:
            depth += (text[j] in "([") - (text[j] in ")]")
            if text[j] == "," and depth == 1:
                comma = j
            if depth == 0:
                break
            j += 1
        power = f"1e{text[comma + 1 : j].strip()}::DOUBLE"
        text = f"{text[:i]}(floor(({text[i + 6 : comma]})::DOUBLE * {power} + 0.5::DOUBLE) / {power}){text[j + 1 :]}"
        at = i + 1
    return text


def cte(name: str, body: str) -> None:
    CTE[name] = _half_up(body.strip())


def sql(name: str, body: str) -> None:
    """The query with every expression that it (or one of those) uses, in order."""
    body = _half_up(body.strip())
    used, todo = set(), [body]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for k, v in CTE.items():
            if k not in used and k.split("(")[0] in words:
                used.add(k)
                todo.append(v)
    parts = ", ".join(f"{k} AS ({v})" for k, v in CTE.items() if k in used)
    SQL[name] = f"WITH RECURSIVE {parts} {body}" if parts else body


cte("tx", f"""
SELECT event_id AS row_ord, 'E' || event_id AS transaction_id, 'A' || user_id AS sender, 'A' || ((event_id * 7919 + user_id * 31) % (SELECT max(user_id) + 1 FROM events)) AS receiver,
  greatest(floor(value * 4) / 4.0::DOUBLE, 0.25::DOUBLE) AS amount, epoch_us(ts) AS us, (event_type = 'error')::INT AS label, CASE WHEN event_type = 'error' THEN 'R' || (user_id % 10) ELSE '' END AS ring_id
FROM events
""")
cte("ext", "SELECT min(us) AS t0, max(us) AS t1 FROM tx")
cte("w", f"SELECT tx.*, t0, ((us - t0) // {DAY})::INT AS window_id FROM tx, ext")
cte("dirty", """
SELECT transaction_id, CASE WHEN row_ord % 97 <> 0 THEN sender END AS sender, CASE WHEN row_ord % 89 = 0 THEN '' ELSE receiver END AS receiver,
  CASE WHEN row_ord % 83 = 0 THEN 0.0 WHEN row_ord % 79 = 0 THEN -amount ELSE amount END AS amount, CASE WHEN row_ord % 73 <> 0 THEN us END AS us, label, ring_id, ring_id AS scenario_id, row_ord + k AS row_ord
FROM tx, (VALUES (0), (10000000)) v(k) WHERE k = 0 OR row_ord % 71 = 0
""")
cte("stepped", """
SELECT *, CASE WHEN us IS NULL THEN 'parse_timestamp' WHEN sender IS NULL OR trim(sender) = '' OR receiver IS NULL OR trim(receiver) = '' THEN 'missing_endpoint' WHEN amount = 0 THEN 'amount_zero' WHEN amount < 0 THEN 'amount_negative' END AS step FROM dirty
""")
cte("cleaned", "SELECT *, CASE WHEN step IS NULL AND row_number() OVER (PARTITION BY transaction_id, step IS NULL ORDER BY row_ord) > 1 THEN 'duplicate_id' ELSE step END AS dropped_by FROM stepped")
cte("pairs", "SELECT DISTINCT sender, receiver FROM tx")
cte("sparse", "SELECT * FROM w WHERE window_id = 0")
cte("sp", "SELECT DISTINCT sender, receiver FROM sparse WHERE sender <> receiver")
cte("legs", "SELECT w.*, unnest([sender, receiver]) AS account_id FROM w")
cte("lastw", f"SELECT ((t1 - t0) // {DAY})::INT AS hi FROM ext")
cte("grid", "SELECT account_id, first_us, unnest(generate_series(lo, hi))::INT AS window_id FROM (SELECT account_id, min(window_id) AS lo, min(us) AS first_us FROM legs GROUP BY account_id), lastw")

# --- sources and cleaning
sql("canonical_coerce", "SELECT transaction_id, sender, receiver, amount, us, label, ring_id AS scenario_id, ring_id, 'events' AS dataset_source, row_ord FROM tx")
sql("clean_transactions", "SELECT transaction_id, sender, receiver, amount, us, row_ord FROM cleaned WHERE dropped_by IS NULL")
sql("clean_keep_amounts", """
SELECT dropped_by, count(*) AS n FROM (
  SELECT CASE WHEN step IS NULL AND row_number() OVER (PARTITION BY transaction_id, step IS NULL ORDER BY row_ord) > 1 THEN 'duplicate_id' ELSE step END AS dropped_by
  FROM (SELECT *, CASE WHEN us IS NULL THEN 'parse_timestamp' WHEN sender IS NULL OR trim(sender) = '' OR receiver IS NULL OR trim(receiver) = '' THEN 'missing_endpoint' WHEN sender = receiver THEN 'self_transaction' END AS step FROM dirty)
) GROUP BY 1
""")
STEPS = "validate_schema parse_timestamp missing_endpoint amount_not_numeric amount_zero amount_negative self_transaction duplicate_id sort_by_time check_label".split()
cte("steps", " UNION ALL ".join(f"SELECT {i + 1} AS step_no, '{x}' AS step" for i, x in enumerate(STEPS)))
sql("clean_step_log", """
SELECT step_no, step, (total - coalesce(sum(n) OVER (ORDER BY step_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rows_before, n AS rows_affected, (total - sum(n) OVER (ORDER BY step_no))::BIGINT AS rows_after,
  CASE WHEN step = 'self_transaction' THEN own ELSE 0 END AS details
FROM (SELECT step_no, step, (SELECT count(*) FROM cleaned WHERE dropped_by = steps.step) AS n FROM steps), (SELECT count(*) AS total, count(*) FILTER (WHERE (dropped_by IS NULL OR dropped_by = 'duplicate_id') AND sender = receiver) AS own FROM cleaned)
""")
sql("clean_dedup_lineitem", "SELECT l_orderkey || '-' || l_linenumber AS transaction_id, min(l_partkey * 1000000 + l_suppkey) AS row_ord FROM lineitem GROUP BY 1")

# --- data quality
BLANK = "({0} IS NULL OR trim({0}) = '')"
NOW_US = 1705708800000000
ISSUES = {
    **{f"missing_{c}": f"{c} IS NULL" for c in ("transaction_id", "amount", "label", "scenario_id", "ring_id")}, "missing_timestamp": "us IS NULL", "missing_dataset_source": "false",
    "missing_sender": BLANK.format("sender"), "missing_receiver": BLANK.format("receiver"), "invalid_amount_nan": "amount IS NULL", "negative_amount": "amount < 0", "zero_amount": "amount = 0",
    "self_transaction": f"NOT {BLANK.format('sender')} AND NOT {BLANK.format('receiver')} AND sender = receiver", "invalid_timestamp": "us IS NULL", "future_timestamp": f"us > {NOW_US + DAY}",
    "invalid_label_value": "coalesce(label NOT IN (-1, 0, 1), true)", "ring_without_scenario": "ring_id <> '' AND scenario_id = ''", "positive_label_without_ring": "label = 1 AND ring_id = ''",
    "duplicate_transaction_ids": "n_id > 1", "duplicate_transaction_content": "n_content > 1",
}
cte("counted", "SELECT *, count(*) OVER (PARTITION BY transaction_id) AS n_id, count(*) OVER (PARTITION BY sender, receiver, amount, us) AS n_content FROM dirty")
cte("hits", " UNION ALL ".join(f"SELECT '{k}' AS issue, transaction_id, row_ord, coalesce({c}, false) AS hit FROM counted" for k, c in ISSUES.items()))
sql("dq_issue_counts", "SELECT issue, sum(hit::INT)::BIGINT AS count, round(100.0::DOUBLE * sum(hit::INT) / count(*), 4) AS pct FROM hits GROUP BY issue")
sql("dq_duplicates", "SELECT issue, sum(hit::INT)::BIGINT AS count FROM hits WHERE issue LIKE 'duplicate%' GROUP BY issue")
sql("dq_sample_ids", "SELECT issue, string_agg(transaction_id, ',' ORDER BY n) AS sample_ids FROM (SELECT issue, transaction_id, row_number() OVER (PARTITION BY issue ORDER BY row_ord) AS n FROM hits WHERE hit) WHERE n <= 5 GROUP BY issue")
sql("dq_out_of_order", "SELECT count(*) FILTER (WHERE us < p) AS out_of_order_rows FROM (SELECT us, lag(us) OVER (ORDER BY row_ord) AS p FROM dirty)")
sql("dq_summary_stats", """
SELECT count(*) AS n_rows, count(DISTINCT transaction_id) AS n_ids, min(us) AS first_us, max(us) AS last_us, count(amount) AS n_amounts, round(avg(amount), 6) AS amount_mean, round(median(amount), 6) AS amount_median,
  round(stddev_samp(amount), 6) AS amount_std, min(amount) AS amount_min, max(amount) AS amount_max, (SELECT count(DISTINCT a) FROM (SELECT unnest([sender, receiver]) AS a FROM tx)) AS n_accounts FROM tx
""")
sql("dq_class_distribution", "SELECT label, count(*) AS n FROM tx GROUP BY label")
sql("dq_top_scenarios", "SELECT ring_id AS scenario_id, count(*) AS n FROM tx WHERE ring_id <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")

# --- windows and graphs
BOUNDS = "SELECT i::INT AS window_id, t0 + i * {step} AS start_us, t0 + i * {step} + {size} AS end_us FROM (SELECT t0, unnest(generate_series(0, (t1 - t0) // {step})) AS i FROM ext)"
sql("window_bounds_tumbling", BOUNDS.format(step=DAY, size=DAY))
sql("window_bounds_sliding", BOUNDS.format(step=12 * HOUR, size=2 * DAY))
cte("sliding", BOUNDS.format(step=12 * HOUR, size=2 * DAY))
cte("gapped", BOUNDS.format(step=DAY, size=6 * HOUR))
sql("window_assign_sliding", "SELECT window_id, count(*) AS n, sum(amount) AS amount FROM tx JOIN sliding ON us >= start_us AND us < end_us GROUP BY window_id")
sql("window_assign_gapped", "SELECT window_id, count(*) AS n FROM tx JOIN gapped ON us >= start_us AND us < end_us GROUP BY window_id")
sql("window_of_timestamp", "SELECT transaction_id, coalesce(min(window_id), (SELECT max(window_id) FROM gapped)) AS window_id, min(window_id) AS strict_window_id FROM tx LEFT JOIN gapped ON us >= start_us AND us < end_us GROUP BY transaction_id")

REACH = """
SELECT a, b FROM (SELECT DISTINCT {cols} FROM sparse UNION SELECT DISTINCT sender, sender FROM sparse UNION SELECT DISTINCT receiver, receiver FROM sparse {more}) e(a, b)
UNION SELECT r.a, e.receiver FROM {name} r JOIN (SELECT sender, receiver FROM sparse {way}) e ON r.b = e.sender
"""
cte("ureach(a, b)", REACH.format(cols="sender, receiver", name="ureach", more="UNION SELECT DISTINCT receiver, sender FROM sparse", way="UNION SELECT receiver, sender FROM sparse"))
cte("dreach(a, b)", REACH.format(cols="sender, receiver", name="dreach", more="", way=""))
cte("weak", "SELECT a AS node, min(b) AS component FROM ureach GROUP BY a")
cte("strong", "SELECT x.a AS node, min(x.b) AS component FROM dreach x JOIN dreach y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
sql("wcc_components", "SELECT node, component FROM weak")
sql("scc_components", "SELECT node, component FROM strong")
sql("graph_stats", """
SELECT *, round(CASE WHEN n_nodes > 1 THEN n_pairs / (n_nodes * (n_nodes - 1)) ELSE 0.0 END, 6) AS density FROM (
  SELECT count(*) AS n_edges, sum(amount) AS total_amount, (SELECT count(*) FROM weak) AS n_nodes, (SELECT count(*) FROM (SELECT DISTINCT sender, receiver FROM sparse)) AS n_pairs,
    (SELECT count(DISTINCT component) FROM weak) AS weak_components, (SELECT max(n) FROM (SELECT count(*) AS n FROM weak GROUP BY component)) AS largest_weak,
    (SELECT count(DISTINCT component) FROM strong) AS strong_components, (SELECT max(n) FROM (SELECT count(*) AS n FROM strong GROUP BY component)) AS largest_strong FROM sparse)
""")
cte("wreach(window_id, a, b)", """
SELECT DISTINCT window_id, account_id, account_id FROM legs
UNION SELECT r.window_id, r.a, e.receiver FROM wreach r JOIN (SELECT window_id, sender, receiver FROM w UNION SELECT window_id, receiver, sender FROM w) e ON r.window_id = e.window_id AND r.b = e.sender
""")
sql("graph_window_summary", """
SELECT window_id, n_transactions, total_amount, n_nodes, n_components, largest_component
FROM (SELECT window_id, count(*) AS n_transactions, round(sum(amount), 2) AS total_amount FROM w GROUP BY window_id)
JOIN (SELECT window_id, sum(n)::BIGINT AS n_nodes, count(*) AS n_components, max(n) AS largest_component FROM (SELECT window_id, c, count(*) AS n FROM (SELECT window_id, a, min(b) AS c FROM wreach GROUP BY window_id, a) GROUP BY window_id, c) GROUP BY window_id) USING (window_id)
""")
cte("cums", f"""
SELECT window_id, (SELECT count(*) FROM (SELECT account_id FROM legs l WHERE l.window_id <= b.window_id GROUP BY account_id)) AS nodes, (SELECT count(*) FROM (SELECT sender, receiver FROM w x WHERE x.window_id <= b.window_id GROUP BY sender, receiver)) AS pairs,
  (SELECT count(*) FROM w x WHERE x.window_id <= b.window_id) AS transactions FROM (SELECT unnest(generate_series(0, hi))::INT AS window_id FROM lastw) b
""")
cte("cum", "SELECT *, CASE WHEN nodes > 1 THEN round(pairs / (nodes * (nodes - 1)), 6) ELSE 0.0 END AS density FROM cums")
sql("graph_cumulative_summary", "SELECT window_id, nodes, pairs, transactions, density FROM cum")
sql("graph_level_deltas", "SELECT window_id, nodes - lag(nodes) OVER o AS delta_nodes, transactions - lag(transactions) OVER o AS delta_transactions, round(density - lag(density) OVER o, 6) AS delta_density FROM cum WINDOW o AS (ORDER BY window_id)")
sql("graph_snapshot", "SELECT count(*) AS n, sum(amount) AS amount, 'window' AS mode FROM w WHERE window_id = 3 UNION ALL SELECT count(*), sum(amount), 'cumulative' FROM w WHERE window_id <= 3")
sql("node_activity", """
SELECT account_id, coalesce(out_count, 0) AS out_count, coalesce(out_amount, 0) AS out_amount, coalesce(unique_receivers, 0) AS unique_receivers, coalesce(in_count, 0) AS in_count, coalesce(in_amount, 0) AS in_amount, coalesce(unique_senders, 0) AS unique_senders
FROM (SELECT sender AS account_id, count(*) AS out_count, sum(amount) AS out_amount, count(DISTINCT receiver) AS unique_receivers FROM tx GROUP BY 1)
FULL JOIN (SELECT receiver AS account_id, count(*) AS in_count, sum(amount) AS in_amount, count(DISTINCT sender) AS unique_senders FROM tx GROUP BY 1) USING (account_id)
""")
cte("hop(a, h)", "SELECT (SELECT min(sender) FROM sparse), 0 UNION SELECT e.b, h + 1 FROM hop JOIN (SELECT sender AS a, receiver AS b FROM sparse UNION SELECT receiver, sender FROM sparse) e ON hop.a = e.a WHERE h < 3")
sql("khop_neighborhood", "SELECT a AS account_id, min(h) AS hops FROM hop WHERE a <> (SELECT min(sender) FROM sparse) GROUP BY a")
cte("way(p, tail)", "SELECT [sender, receiver], receiver FROM sp WHERE sender = (SELECT min(sender) FROM sparse) UNION ALL SELECT list_append(p, receiver), receiver FROM way JOIN sp ON tail = sender WHERE len(p) <= 5 AND tail <> (SELECT max(receiver) FROM sparse) AND NOT list_contains(p, receiver)")
sql("simple_paths", "SELECT array_to_string(p, ',') AS path, (len(p) - 1)::INT AS length FROM way WHERE tail = (SELECT max(receiver) FROM sparse)")
cte("loop(p, tail, done)", "SELECT [sender, receiver], receiver, false FROM sp WHERE sender < receiver UNION ALL SELECT CASE WHEN receiver = p[1] THEN p ELSE list_append(p, receiver) END, receiver, receiver = p[1] FROM loop JOIN sp ON tail = sender WHERE NOT done AND len(p) <= 5 AND (receiver = p[1] OR (receiver > p[1] AND NOT list_contains(p, receiver)))")
sql("simple_cycles", "SELECT array_to_string(p, ',') AS cycle, len(p)::INT AS length FROM loop WHERE done AND len(p) <= 5")
cte("member", "SELECT DISTINCT ring_id AS r, unnest([sender, receiver]) AS a FROM sparse WHERE ring_id <> ''")
cte("rp", "SELECT DISTINCT x.r, sender, receiver FROM sp JOIN member x ON x.a = sender JOIN member y ON y.a = receiver AND x.r = y.r")
cte("rloop(r, p, tail, done)", "SELECT r, [sender, receiver], receiver, false FROM rp WHERE sender < receiver UNION ALL SELECT rloop.r, CASE WHEN receiver = p[1] THEN p ELSE list_append(p, receiver) END, receiver, receiver = p[1] FROM rloop JOIN rp ON rp.r = rloop.r AND tail = sender WHERE NOT done AND len(p) <= 4 AND (receiver = p[1] OR (receiver > p[1] AND NOT list_contains(p, receiver)))")
sql("ring_cycles", "SELECT r AS ring_id, count(*) AS n_cycles FROM rloop WHERE done AND len(p) <= 4 GROUP BY r")

# --- features


def _side(me: str, other: str, name: str, partner: str) -> str:
    return f"""
SELECT * FROM (SELECT window_id, {me} AS account_id, count(*) AS {name}_count, sum(amount) AS {name}_amount, avg(amount) AS {name}_amount_mean, median(amount) AS {name}_amount_median, stddev_samp(amount) AS {name}_amount_std FROM w GROUP BY 1, 2)
JOIN (SELECT window_id, {me} AS account_id, count(*) AS unique_{partner}s, count(*) FILTER (WHERE n > 1) AS repeated_{partner}_count, CASE WHEN sum(s) > 0 THEN sum(s * s) / (sum(s) * sum(s)) ELSE 0.0 END AS {name}_amount_concentration
  FROM (SELECT window_id, {me}, {other}, count(*) AS n, sum(amount) AS s FROM w GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (window_id, account_id)"""


cte("outs", _side("sender", "receiver", "out", "receiver"))
cte("ins", _side("receiver", "sender", "in", "sender"))
_NUMS = [f"{d}_{c}" for d in ("out", "in") for c in ("count", "amount", "amount_mean", "amount_median", "amount_std")] + ["unique_receivers", "unique_senders", "repeated_receiver_count", "repeated_sender_count", "out_amount_concentration"]
cte("tf0", f"SELECT window_id, account_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _NUMS)} FROM outs FULL JOIN ins USING (window_id, account_id)")
cte("tf", "SELECT *, out_count + in_count AS total_count, out_amount + in_amount AS total_amount, ln(1 + out_amount + in_amount) AS log_total_amount, out_amount / (in_amount + 1e-9::DOUBLE) AS amount_ratio_out_in, unique_receivers + unique_senders AS unique_counterparties FROM tf0")
_R6 = ["out_amount_mean", "out_amount_median", "out_amount_std", "in_amount_mean", "in_amount_median", "in_amount_std", "out_amount_concentration", "log_total_amount", "amount_ratio_out_in"]
sql("feat_transaction", f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _R6)}) FROM tf")
sql("feat_concentration", "SELECT window_id, account_id, round(out_amount_concentration, 6) AS out_amount_concentration, repeated_receiver_count FROM tf")
cte("gaps", "SELECT window_id, account_id, us, (us - lag(us) OVER (PARTITION BY window_id, account_id ORDER BY us, row_ord)) / 1e6::DOUBLE AS gap FROM legs")
cte("gapped_stats", "SELECT window_id, account_id, count(*) AS cnt, median(gap) AS med, min(gap) AS lo, max(gap) AS hi, count(gap) AS n, avg(gap) AS mu, stddev_pop(gap) AS sigma FROM gaps GROUP BY 1, 2")
cte("dense0", "SELECT grid.*, t0, coalesce(cnt, 0) AS cnt, med, lo, hi, n, mu, sigma FROM grid LEFT JOIN gapped_stats USING (window_id, account_id), ext")
cte("dense", f"""
SELECT *, CASE WHEN window_id >= 1 THEN coalesce(lag(cnt, 1) OVER o, 0) END AS c1, CASE WHEN window_id >= 2 THEN coalesce(lag(cnt, 2) OVER o, 0) END AS c2, CASE WHEN window_id >= 3 THEN coalesce(lag(cnt, 3) OVER o, 0) END AS c3,
  sum(cnt) OVER (PARTITION BY account_id ORDER BY window_id) AS so_far, greatest(1, (t0 + (window_id + 1) * {DAY} - first_us) // {DAY}) AS days FROM dense0 WINDOW o AS (PARTITION BY account_id ORDER BY window_id)
""")
cte("tmf", """
SELECT window_id, account_id, cnt / 24.0::DOUBLE AS transaction_velocity, (cnt - c1)::DOUBLE AS activity_acceleration,
  CASE WHEN c3 IS NOT NULL THEN CASE WHEN c1 + c2 + c3 > 0 THEN (c1 - c3) / 2.0::DOUBLE END WHEN c2 IS NOT NULL AND c1 + c2 > 0 THEN (c1 - c2)::DOUBLE END AS activity_trend_slope,
  cnt / (so_far::DOUBLE / days + 1e-9::DOUBLE) AS recent_vs_historical_activity, (CASE WHEN c1 > 0 AND c2 > 0 AND c3 > 0 THEN 3 WHEN c1 > 0 AND c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END)::INT AS activity_persistence_windows FROM dense
""")
sql("feat_temporal", "SELECT window_id, account_id, round(transaction_velocity, 6) AS transaction_velocity, activity_acceleration, activity_trend_slope, round(recent_vs_historical_activity, 6) AS recent_vs_historical_activity, activity_persistence_windows FROM tmf")
sql("feat_gaps_burstiness", "SELECT window_id, account_id, round(med, 4) AS median_time_gap_seconds, round(lo, 4) AS min_time_gap_seconds, round(hi, 4) AS max_time_gap_seconds, round(CASE WHEN n >= 2 AND sigma + mu <> 0 THEN (sigma - mu) / (sigma + mu) END, 4) AS burstiness FROM dense")


def _first(cols: str, out: str, name: str) -> str:
    return f"SELECT window_id, {out} AS account_id, count(*) AS {name} FROM (SELECT {cols}, min(window_id) AS window_id FROM w GROUP BY ALL) GROUP BY 1, 2"


cte("ind", _first("sender, receiver", "receiver", "in_degree"))
cte("outd", _first("sender, receiver", "sender", "out_degree"))
cte("neard", "SELECT window_id, account_id, count(*) AS neighbor_count FROM (SELECT window_id, unnest(list_distinct([a, b])) AS account_id FROM (SELECT least(sender, receiver) AS a, greatest(sender, receiver) AS b, min(window_id) AS window_id FROM w GROUP BY 1, 2)) GROUP BY 1, 2")
cte("inw", "SELECT window_id, receiver AS account_id, sum(amount) AS weighted_in_degree FROM w GROUP BY 1, 2")
cte("outw", "SELECT window_id, sender AS account_id, sum(amount) AS weighted_out_degree FROM w GROUP BY 1, 2")
_DEG = ["in_degree", "out_degree", "neighbor_count", "weighted_in_degree", "weighted_out_degree"]
cte("deg0", f"SELECT window_id, account_id, {', '.join(f'sum(coalesce({c}, 0)) OVER (PARTITION BY account_id ORDER BY window_id)' + ('::BIGINT' if 'weight' not in c else '') + f' AS {c}' for c in _DEG)} FROM grid LEFT JOIN ind USING (window_id, account_id) LEFT JOIN outd USING (window_id, account_id) LEFT JOIN neard USING (window_id, account_id) LEFT JOIN inw USING (window_id, account_id) LEFT JOIN outw USING (window_id, account_id)")
cte("degs", "SELECT *, in_degree + out_degree AS total_degree, out_degree / (in_degree + 1e-9::DOUBLE) AS degree_ratio_out_in, CASE WHEN in_degree + out_degree > 0 THEN least(in_degree, out_degree) / (greatest(in_degree, out_degree) + 1e-9::DOUBLE) ELSE 0.0 END AS intermediary_balance_ratio FROM deg0")
sql("feat_network_degrees", "SELECT * REPLACE (round(degree_ratio_out_in, 6) AS degree_ratio_out_in, round(intermediary_balance_ratio, 6) AS intermediary_balance_ratio) FROM degs")
cte("delta", "SELECT *, total_degree - lag(total_degree) OVER o AS delta_total_degree, neighbor_count - lag(neighbor_count) OVER o AS delta_neighbor_count, weighted_in_degree - lag(weighted_in_degree) OVER o AS delta_weighted_in_degree, weighted_out_degree - lag(weighted_out_degree) OVER o AS delta_weighted_out_degree FROM degs WINDOW o AS (PARTITION BY account_id ORDER BY window_id)")
cte("deltas", "SELECT *, (coalesce(delta_total_degree, 0) + coalesce(delta_neighbor_count, 0))::DOUBLE AS delta_connectivity FROM delta")
sql("feat_delta", "SELECT window_id, account_id, delta_total_degree, delta_neighbor_count, delta_weighted_in_degree, delta_weighted_out_degree, delta_connectivity FROM deltas")
sql("feature_table", """
SELECT window_id, account_id, total_degree, neighbor_count, total_count, total_amount, out_count, in_amount, unique_receivers, round(log_total_amount, 6) AS log_total_amount, round(transaction_velocity, 6) AS transaction_velocity,
  total_count - lag(total_count) OVER o AS delta_total_count, total_amount - lag(total_amount) OVER o AS delta_total_amount, round(transaction_velocity - lag(transaction_velocity) OVER o, 6) AS delta_transaction_velocity, delta_connectivity
FROM (SELECT d.window_id, d.account_id, total_degree, neighbor_count, coalesce(total_count, 0) AS total_count, coalesce(total_amount, 0) AS total_amount, coalesce(out_count, 0) AS out_count, coalesce(in_amount, 0) AS in_amount, unique_receivers, coalesce(log_total_amount, 0) AS log_total_amount, transaction_velocity, delta_connectivity
  FROM deltas d LEFT JOIN tf USING (window_id, account_id) LEFT JOIN tmf USING (window_id, account_id)) WINDOW o AS (PARTITION BY account_id ORDER BY window_id)
""")
cte("verts", "SELECT v.account_id, o FROM (SELECT DISTINCT unnest([sender, receiver]) AS account_id FROM pairs) v LEFT JOIN (SELECT sender AS account_id, count(*) AS o FROM pairs GROUP BY 1) USING (account_id)")
cte("pr0", "SELECT account_id, o, 1.0::DOUBLE / (SELECT count(*) FROM verts) AS x FROM verts")
for _k in range(1, 6):
    cte(f"pr{_k}", f"SELECT v.account_id, v.o, 0.85::DOUBLE * (coalesce(got, 0.0) + (SELECT coalesce(sum(x), 0.0) FROM pr{_k - 1} WHERE o IS NULL) / (SELECT count(*) FROM verts)) + 0.15::DOUBLE / (SELECT count(*) FROM verts) AS x FROM verts v LEFT JOIN (SELECT receiver AS account_id, sum(x / o) AS got FROM pairs JOIN pr{_k - 1} ON sender = account_id GROUP BY 1) USING (account_id)")
sql("feat_pagerank", "SELECT account_id, round(x, 9) AS pagerank FROM pr5")
cte("und", "SELECT DISTINCT least(sender, receiver) AS a, greatest(sender, receiver) AS b FROM pairs WHERE sender <> receiver")
cte("und2", "SELECT a, b FROM und UNION ALL SELECT b, a FROM und")
sql("feat_clustering", """
SELECT v.account_id, round(CASE WHEN coalesce(d, 0) > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (d * (d - 1)) ELSE 0.0 END, 6) AS clustering_coefficient FROM verts v
LEFT JOIN (SELECT a AS account_id, count(*) AS d FROM und2 GROUP BY 1) USING (account_id) LEFT JOIN (SELECT x.a AS account_id, count(*) AS t FROM und2 x JOIN und2 y ON x.a = y.a AND x.b < y.b JOIN und z ON z.a = x.b AND z.b = y.b GROUP BY 1) USING (account_id)
""")

# --- patterns, as flat events
FLAT = "pattern_type, window_id, us, span, central_account, accounts, transaction_ids, pattern_strength"


def _fan(kind: str, hub: str, other: str) -> str:
    return f"""
SELECT '{kind}' AS pattern_type, window_id, min(first_us) AS us, NULL::VARCHAR AS span, {hub} AS central_account, {hub} || ',' || string_agg({other}, ',' ORDER BY first_us, first_ord) AS accounts,
  any_value(ids) AS transaction_ids, round(least(1.0, count(*) / 8.0::DOUBLE), 4) AS pattern_strength
FROM (SELECT window_id, {hub}, {other}, min(us) AS first_us, arg_min(row_ord, (us, row_ord)) AS first_ord FROM w GROUP BY 1, 2, 3)
JOIN (SELECT window_id, {hub}, string_agg(transaction_id, ',' ORDER BY us, row_ord) AS ids FROM w GROUP BY 1, 2) USING (window_id, {hub}) GROUP BY window_id, {hub} HAVING count(*) >= 4"""


cte("p_fan_in", _fan("fan_in", "receiver", "sender"))
cte("p_fan_out", _fan("fan_out", "sender", "receiver"))
sql("pattern_fan_in", f"SELECT {FLAT} FROM p_fan_in")
sql("pattern_fan_out", f"SELECT {FLAT} FROM p_fan_out")
sql("pattern_fan_evidence", """
SELECT window_id, receiver AS central_account, count(DISTINCT sender) AS n_senders, sum(amount) AS total_amount, round(avg(amount), 6) AS mean_amount, round(coalesce(stddev_samp(amount), 0), 6) AS amount_std, (max(us) - min(us)) / 1e6::DOUBLE AS time_span_seconds
FROM w GROUP BY 1, 2 HAVING count(DISTINCT sender) >= 4
""")
cte("sm_paid", f"SELECT a.transaction_id AS anchor, a.sender AS source, a.us AS t, a.row_ord AS o, r.* FROM tx a JOIN tx r ON a.sender = r.sender AND r.us >= a.us AND r.us < a.us + {2 * DAY}")
cte("sm_all", "SELECT anchor, source, t, o, receiver AS target, min((us, row_ord)) AS f FROM sm_paid GROUP BY anchor, source, t, o, receiver")
cte("sm_targets", "SELECT * FROM sm_all QUALIFY count(*) OVER (PARTITION BY anchor) >= 2")
cte("sm_dest", f"""
SELECT anchor, dest, ids FROM (SELECT anchor, receiver AS dest, string_agg(transaction_id, ',' ORDER BY us, row_ord) AS ids, count(DISTINCT sender) AS n FROM (SELECT s.anchor, x.* FROM sm_targets s JOIN tx x ON x.sender = s.target AND x.us >= s.t AND x.us < s.t + {4 * DAY})
GROUP BY 1, 2 HAVING count(DISTINCT sender) >= 2) QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY n DESC, dest) = 1
""")
cte("sm_first", "SELECT source, min((t, o)) AS k FROM sm_targets JOIN sm_dest USING (anchor) GROUP BY source")
cte("sm_event", """
SELECT s.anchor, s.source, any_value(s.t) AS t, any_value(dest) AS dest, any_value(ids) AS ids, list(target ORDER BY f) AS targets FROM sm_targets s JOIN sm_dest USING (anchor) JOIN sm_first x ON x.source = s.source AND x.k = (s.t, s.o) GROUP BY 1, 2
""")
cte("p_split_merge", f"""
SELECT 'split_merge' AS pattern_type, ((t - t0) // {DAY})::INT AS window_id, t AS us, NULL::VARCHAR AS span, source AS central_account,
  (SELECT string_agg(x, ',' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT list_concat([source], targets, [dest]) AS l)) GROUP BY x)) AS accounts,
  (SELECT string_agg(x, ',' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT list_concat((SELECT list(transaction_id ORDER BY us, row_ord) FROM sm_paid p WHERE p.anchor = e.anchor), string_split(ids, ',')) AS l)) GROUP BY x)) AS transaction_ids,
  round(least(1.0, len(targets) / 4.0::DOUBLE), 4) AS pattern_strength FROM sm_event e, ext
""")
sql("pattern_split_merge", f"SELECT {FLAT} FROM p_split_merge")
cte("near", """
SELECT account, in_id, in_us, in_ord, in_sender, o.transaction_id AS out_id, o.us AS out_us, o.receiver AS out_receiver FROM (
  SELECT i.receiver AS account, i.transaction_id AS in_id, i.us AS in_us, i.row_ord AS in_ord, i.sender AS in_sender, (SELECT arg_min(x.transaction_id, (x.us, x.row_ord)) FROM tx x WHERE x.sender = i.receiver AND x.us >= i.us) AS oid FROM tx i
) JOIN tx o ON o.transaction_id = oid
""")
cte("passed", f"SELECT * FROM near WHERE out_us - in_us <= {48 * HOUR} AND in_id <> out_id QUALIFY row_number() OVER (PARTITION BY account, out_id ORDER BY in_us, in_ord) = 1")
cte("p_rapid", f"""
SELECT 'rapid_pass_through' AS pattern_type, ((out_us - t0) // {DAY})::INT AS window_id, in_us AS us, NULL::VARCHAR AS span, account AS central_account, in_sender || ',' || account || ',' || out_receiver AS accounts, in_id || ',' || out_id AS transaction_ids,
  round(greatest(0.0, least(1.0, 1 - (out_us - in_us) / {HOUR}::DOUBLE / 48.0::DOUBLE)), 4) AS pattern_strength FROM passed, ext
""")
sql("pattern_rapid_pass_through", f"SELECT {FLAT} FROM p_rapid")
cte("ep(account, lo)", f"SELECT account, min(in_us) FROM passed GROUP BY account UNION ALL SELECT e.account, (SELECT min(in_us) FROM passed p WHERE p.account = e.account AND p.in_us > e.lo + {10 * DAY}) FROM ep e WHERE EXISTS (SELECT 1 FROM passed p WHERE p.account = e.account AND p.in_us > e.lo + {10 * DAY})")
cte("ri", "SELECT p.*, e.lo FROM passed p JOIN ep e ON p.account = e.account AND p.in_us >= e.lo QUALIFY row_number() OVER (PARTITION BY p.account, p.out_id ORDER BY e.lo DESC) = 1")
cte("p_repeated", f"""
SELECT 'repeated_intermediary' AS pattern_type, ((arg_max(out_us, (in_us, in_ord)) - any_value(t0)) // {DAY})::INT AS window_id, max(in_us) AS us, NULL::VARCHAR AS span, account AS central_account,
  array_to_string(list_sort(list_distinct(flatten(list([in_sender, account, out_receiver])))), ',') AS accounts,
  (SELECT string_agg(x, ',' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT flatten(list([in_id, out_id] ORDER BY in_us, in_ord)) AS l)) GROUP BY x)) AS transaction_ids,
  round(least(1.0, count(*) / 6.0::DOUBLE), 4) AS pattern_strength FROM ri, ext GROUP BY account, lo HAVING count(*) >= 3
""")
sql("pattern_repeated_intermediary", f"SELECT {FLAT} FROM p_repeated")

LEG = "{'us': us, 'row_ord': row_ord, 'id': transaction_id, 'sender': sender, 'receiver': receiver, 'amount': amount}"
cte("leg", f"SELECT sender AS s, {LEG} AS g FROM tx")
cte("ch1", "SELECT g.id AS start, [g] AS hops, [g.sender, g.receiver] AS acc, true AS alive FROM leg")
for _k in range(2, 7):
    cte(f"nx{_k}", f"""
SELECT start, min(l.g) AS nxt FROM ch{_k - 1} c JOIN leg l ON l.s = c.hops[-1].receiver AND l.g.us > c.hops[-1].us AND l.g.us <= c.hops[-1].us + {DAY} AND l.g.amount >= c.hops[-1].amount * (1 - 0.3::DOUBLE) AND l.g.amount <= c.hops[-1].amount * 1.05::DOUBLE AND NOT list_contains(c.acc, l.g.receiver)
WHERE c.alive GROUP BY start""")
    cte(f"ch{_k}", f"SELECT c.start, CASE WHEN nxt IS NULL THEN hops ELSE list_append(hops, nxt) END AS hops, CASE WHEN nxt IS NULL THEN acc ELSE list_append(acc, nxt.receiver) END AS acc, nxt IS NOT NULL AS alive FROM ch{_k - 1} c LEFT JOIN nx{_k} USING (start)")
cte("long", "SELECT *, [h.id FOR h IN hops] AS ids, row_number() OVER (ORDER BY hops[1].us, hops[1].row_ord) AS k FROM ch6 WHERE len(hops) >= 3")
cte("walk(k, used, keep)", "SELECT 0::BIGINT, []::VARCHAR[], false UNION ALL SELECT l.k, CASE WHEN list_contains(used, l.start) THEN used ELSE list_concat(used, l.ids) END, NOT list_contains(used, l.start) FROM walk JOIN long l ON l.k = walk.k + 1")
cte("p_layering", f"""
SELECT 'layering' AS pattern_type, ((hops[-1].us - t0) // {DAY})::INT AS window_id, hops[1].us AS us, NULL::VARCHAR AS span, hops[1].sender AS central_account, array_to_string(acc, ',') AS accounts, array_to_string(ids, ',') AS transaction_ids,
  round(least(1.0, (len(hops) - 2) / 4.0::DOUBLE), 4) AS pattern_strength FROM long JOIN walk USING (k), ext WHERE keep
""")
sql("pattern_layering", f"SELECT {FLAT} FROM p_layering")
cte("num", "SELECT *, row_number() OVER (PARTITION BY sender ORDER BY us, row_ord) AS n FROM tx")
cte("succ", f"SELECT i.transaction_id AS src, {LEG.replace(': ', ': o.')} AS g FROM (SELECT i.*, (SELECT count(*) FROM tx x WHERE x.sender = i.receiver AND x.us <= i.us) AS c FROM tx i) i JOIN num o ON o.sender = i.receiver AND o.n BETWEEN i.c + 1 AND i.c + 5")
CYCLE = """
SELECT [{leg}], [sender, receiver], us + {limit}, false FROM tx {starts}
UNION ALL SELECT list_append(legs_, g), CASE WHEN g.receiver = acc[1] THEN acc ELSE list_append(acc, g.receiver) END, deadline, g.receiver = acc[1] FROM {name} JOIN succ ON src = legs_[-1].id WHERE NOT done AND len(acc) <= 3 AND g.us <= deadline AND (g.receiver = acc[1] OR NOT list_contains(acc, g.receiver))
"""
cte("cyc(legs_, acc, deadline, done)", CYCLE.format(leg=LEG, limit=3 * DAY, starts="", name="cyc"))
cte("cycs(legs_, acc, deadline, done)", CYCLE.format(leg=LEG, limit=3 * DAY, starts="WHERE sender IN (SELECT DISTINCT unnest(string_split(accounts, ',')) FROM p_layering)", name="cycs"))
for _n, _c in (("pattern_circular_flow", "cyc"), ("pattern_circular_scoped", "cycs")):
    sql(_n, f"""
SELECT 'circular_flow' AS pattern_type, ((legs_[-1].us - t0) // {DAY})::INT AS window_id, legs_[1].us AS us, NULL::VARCHAR AS span, acc[1] AS central_account,
  CASE WHEN acc[1] = acc[2] THEN array_to_string(acc[2:], ',') ELSE array_to_string(acc, ',') END AS accounts, array_to_string([x.id FOR x IN legs_], ',') AS transaction_ids, round(least(1.0, 1.0::DOUBLE / (len(acc) + 1) * 3), 4) AS pattern_strength
FROM {_c} , ext WHERE done AND len(acc) <= 3
""")
cte("isl", "SELECT account_id, window_id, delta_connectivity AS d, sum((delta_connectivity <= 0)::INT) OVER (PARTITION BY account_id ORDER BY window_id) AS i FROM deltas")
sql("pattern_escalating", """
SELECT 'escalating_connectivity' AS pattern_type, max(window_id) AS window_id, NULL::BIGINT AS us, 'window_' || min(window_id) || '_to_' || max(window_id) AS span, account_id AS central_account, account_id AS accounts, '' AS transaction_ids, round(least(1.0, sum(d) / 9.0::DOUBLE), 4) AS pattern_strength
FROM isl WHERE d > 0 GROUP BY account_id, i HAVING count(*) >= 2 AND sum(d) >= 3
""")
cte("evlog", " UNION ALL ".join(f"SELECT {FLAT} FROM {p}" for p in ("p_fan_in", "p_fan_out", "p_rapid", "p_split_merge", "p_repeated", "p_layering")))
sql("pattern_event_log", "SELECT pattern_type, window_id, count(*) AS n, round(sum(pattern_strength), 4) AS strength FROM evlog GROUP BY 1, 2")
sql("pattern_type_summary", "SELECT pattern_type, count(*) AS n, round(avg(pattern_strength), 6) AS mean_strength, count(DISTINCT central_account) AS n_central FROM evlog GROUP BY 1")
cte("fans", f"SELECT {FLAT} FROM p_fan_in UNION ALL SELECT {FLAT} FROM p_fan_out")
cte("inds", f"""
SELECT window_id, account_id, {", ".join(f"max((pattern_type = '{p}')::INT) AS pattern_{p}" for p in PATTERN_WEIGHTS)}, count(*) AS pattern_event_count, count(DISTINCT pattern_type) AS pattern_type_count, round(sum(pattern_strength), 6) AS pattern_strength_sum, round(avg(pattern_strength), 6) AS pattern_strength_mean,
  count(*) AS pattern_structural_count, 0::BIGINT AS pattern_temporal_count FROM (SELECT DISTINCT window_id, pattern_type, central_account, pattern_strength, unnest(string_split(accounts, ',')) AS account_id FROM fans) GROUP BY 1, 2
""")
sql("pattern_indicators", "SELECT * FROM inds")
cte("lab", "SELECT window_id, account_id, max(label) AS y FROM legs GROUP BY 1, 2")
sql("indicators_attached", "SELECT window_id, account_id, y, coalesce(pattern_fan_in, 0) AS pattern_fan_in, coalesce(pattern_fan_out, 0) AS pattern_fan_out, coalesce(pattern_event_count, 0) AS pattern_event_count, coalesce(pattern_strength_sum, 0.0) AS pattern_strength_sum FROM lab LEFT JOIN inds USING (window_id, account_id)")

# --- episodes, candidates, scores
cte("fep(c, lo)", f"SELECT central_account, min(us) FROM fans GROUP BY 1 UNION ALL SELECT e.c, (SELECT min(us) FROM fans p WHERE p.central_account = e.c AND p.us > e.lo + {3 * DAY}) FROM fep e WHERE EXISTS (SELECT 1 FROM fans p WHERE p.central_account = e.c AND p.us > e.lo + {3 * DAY})")
sql("bounded_episodes", """
SELECT central_account, episode, count(*) AS n_events, count(DISTINCT pattern_type) AS n_types, min(us) AS start_us, max(us) AS end_us, string_agg(DISTINCT pattern_type, ',' ORDER BY pattern_type) AS types
FROM fans JOIN (SELECT c, lo, (row_number() OVER (PARTITION BY c ORDER BY lo) - 1)::INT AS episode, lead(lo) OVER (PARTITION BY c ORDER BY lo) AS hi FROM fep) ON c = central_account AND us >= lo AND (hi IS NULL OR us < hi) GROUP BY 1, 2 HAVING count(*) >= 2
""")
cte("cand", """
SELECT central_account AS id, list_sort(list_distinct(flatten(list(string_split(accounts, ','))))) AS acc, list_sort(list_distinct(flatten(list(string_split(transaction_ids, ','))))) AS ids, list_sort(list_distinct(list(pattern_type))) AS pats,
  count(*) AS event_count, min(us) AS start_us, max(us) AS end_us, count(*)::DOUBLE / len(list_distinct(flatten(list(string_split(accounts, ','))))) AS density FROM fans GROUP BY 1
""")
cte("ascore", "SELECT coalesce(s.a, r.a) AS a, (coalesce(u, 0) * 37 + coalesce(o, 0)) % 128 / 128.0::DOUBLE AS score FROM (SELECT sender AS a, count(*) AS o FROM tx GROUP BY 1) s FULL JOIN (SELECT receiver AS a, count(DISTINCT sender) AS u FROM tx GROUP BY 1) r ON s.a = r.a")
cte("parts", """
SELECT id, round(coalesce((SELECT 100 * avg(score) FROM ascore WHERE list_contains(acc, a)), 0.0), 2) AS behavioural, round(CASE WHEN count(*) OVER () < 2 THEN 50.0 ELSE 100.0::DOUBLE * (rank() OVER (ORDER BY density) - 1) / count(*) OVER () END, 2) AS network,
  round(least(100.0, 100.0::DOUBLE * len(pats) / 12.0::DOUBLE), 2) AS fund_flow, round(least(100.0, 35.0::DOUBLE * ln(1 + 3.0::DOUBLE * event_count / greatest(len(acc), 1))), 2) AS persistence, len(acc) AS n_accounts FROM cand
""")
cte("risk", "SELECT *, round(behavioural * 0.35::DOUBLE + network * 0.2::DOUBLE + fund_flow * 0.25::DOUBLE + persistence * 0.2::DOUBLE, 2) AS risk_score FROM parts")
LEVEL = "CASE WHEN {0} < 0 THEN 'UNKNOWN' WHEN {0} < 25 THEN 'LOW' WHEN {0} < 50 THEN 'MODERATE' WHEN {0} < 75 THEN 'HIGH' WHEN {0} <= 100 + 1e-9 THEN 'CRITICAL' ELSE 'UNKNOWN' END"
cte("risks", f"SELECT *, {LEVEL.format('risk_score')} AS risk_level FROM risk")
sql("ring_stage", "SELECT id AS candidate_ring_id, CASE WHEN len(pats) >= 3 THEN 'EMERGING' WHEN len(pats) >= 2 THEN 'FORMING' ELSE 'WATCH' END AS formation_stage FROM cand")
sql("risk_components", "SELECT id AS candidate_ring_id, behavioural, network, fund_flow, persistence FROM parts")
sql("risk_scores", "SELECT id AS candidate_ring_id, risk_score, risk_level FROM risks")
sql("risk_level_bands", f"SELECT i / 10.0::DOUBLE AS score, {LEVEL.format('i / 10.0::DOUBLE')} AS risk_level FROM (SELECT unnest(range(0, 1003)) AS i)")
cte("ctx", "SELECT id, tx.* FROM (SELECT id, unnest(ids) AS tid FROM cand) JOIN tx ON transaction_id = tid")
sql("evidence_transactions", "SELECT id AS candidate_ring_id, count(*) AS n, sum(amount) AS amount, min(us) AS first_us FROM ctx GROUP BY 1")
sql("evidence_nodes", "SELECT id AS candidate_ring_id, len(list_distinct(flatten(list([sender, receiver]))))::INT AS n_nodes, count(*)::INT AS n_edges, arg_min(sender, row_ord) AS first_node FROM ctx GROUP BY 1")
_q = lambda s: s.replace("'", "''")
_D = evidence.DESCRIPTIONS
sql("notable_paths", f"""
SELECT i::INT AS id, concat_ws('; ', CASE WHEN i & 7 = 7 THEN '{_q(evidence.FULL_SEQUENCE)}' WHEN i & 2 > 0 THEN '{_q(evidence.LAYERED)}' END, CASE WHEN i & 8 > 0 THEN '{_q(evidence.CLOSED)}' END) AS paths,
  CASE WHEN i = 0 THEN 'No fund-flow patterns recorded.' ELSE upper(d[1]) || d[2:] || '.' END AS description
FROM (SELECT i, concat_ws('; ', CASE WHEN i & 8 > 0 THEN '{_D["circular_flow"]}' END, CASE WHEN i & 1 > 0 THEN '{_D["fan_in"]}' END, CASE WHEN i & 4 > 0 THEN '{_D["fan_out"]}' END, CASE WHEN i & 2 > 0 THEN '{_D["layering"]}' END) AS d FROM (SELECT unnest(range(0, 16)) AS i))
""")

# --- labels and metrics
sql("labels_same_window", "SELECT window_id, account_id, y FROM lab")
cte("fc", "SELECT a.window_id, a.account_id, coalesce(max(b.y), 0) AS y FROM lab a LEFT JOIN lab b ON a.account_id = b.account_id AND b.window_id BETWEEN a.window_id + 1 AND a.window_id + 2 GROUP BY 1, 2")
sql("labels_forecast", "SELECT window_id, account_id, y FROM fc")
sql("labels_attached", "SELECT window_id, account_id, total_degree, coalesce(y, 0) AS y FROM degs LEFT JOIN fc USING (window_id, account_id)")
sql("chrono_split", """
SELECT split, min(window_id) AS first_window, max(window_id) AS last_window, count(*) AS n, sum(y)::BIGINT AS positives
FROM (SELECT lab.*, CASE WHEN r < floor(n * 0.6) THEN 'train' WHEN r < floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split FROM lab JOIN (SELECT window_id, row_number() OVER (ORDER BY window_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT window_id FROM lab)) USING (window_id)) GROUP BY 1
""")
cte("sc", "SELECT *, (window_id * 31 + substr(account_id, 2)::BIGINT * 17) % 101 / 100.0::DOUBLE AS score FROM lab")
RATES = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END, 6) AS false_warning_rate"
cte("thr", f"SELECT t AS threshold, count(*) FILTER (WHERE score >= t AND y = 1) AS tp, count(*) FILTER (WHERE score >= t AND y = 0) AS fp, count(*) FILTER (WHERE score < t AND y = 0) AS tn, count(*) FILTER (WHERE score < t AND y = 1) AS fn FROM sc, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS t) GROUP BY t")
cte("sweep", f"SELECT threshold, tp, fp, tn, fn, {RATES} FROM thr")
sql("metrics_confusion", "SELECT tp, fp, tn, fn, precision, recall, f1, false_warning_rate FROM sweep WHERE threshold = 0.5")
sql("threshold_sweep", "SELECT * FROM sweep")
sql("threshold_best", "SELECT * FROM sweep ORDER BY f1 DESC, precision DESC, recall DESC, threshold DESC LIMIT 1")
cte("parted", "SELECT window_id, CASE WHEN r < floor(n * 0.6) THEN 'train' WHEN r < floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split FROM (SELECT window_id, row_number() OVER (ORDER BY window_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT window_id FROM lab))")
COUNTS = "count(*) FILTER (WHERE score >= t AND y = 1) AS tp, count(*) FILTER (WHERE score >= t AND y = 0) AS fp, count(*) FILTER (WHERE score < t AND y = 0) AS tn, count(*) FILTER (WHERE score < t AND y = 1) AS fn"
cte("chosen", f"SELECT threshold AS t FROM (SELECT threshold, {RATES} FROM (SELECT t AS threshold, {COUNTS} FROM sc JOIN parted USING (window_id), (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS t) WHERE split = 'validation' GROUP BY t)) ORDER BY f1 DESC, precision DESC, recall DESC, threshold DESC LIMIT 1")
sql("threshold_final", f"SELECT threshold, tp, fp, tn, fn, {RATES} FROM (SELECT t AS threshold, {COUNTS} FROM sc JOIN parted USING (window_id), chosen WHERE split = 'test' GROUP BY t)")
sql("metrics_roc_auc", "SELECT round((sum(CASE WHEN y = 1 THEN r END) - p * (p + 1) / 2.0) / (p * n), 9) AS roc_auc FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r, sum(y) OVER () AS p, count(*) OVER () - sum(y) OVER () AS n FROM sc) GROUP BY p, n")
sql("metrics_avg_precision", "SELECT round(sum(p * tp / al) / max(tp), 9) AS pr_auc FROM (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(m) OVER (ORDER BY score DESC) AS al FROM (SELECT score, sum(y) AS p, count(*) AS m FROM sc GROUP BY score))")
sql("metrics_topk", "SELECT k::INT AS k, round(avg(y), 6) AS precision_at_k FROM (SELECT y, row_number() OVER (ORDER BY score DESC, window_id, account_id) AS r FROM sc), (SELECT unnest([10, 20, 50]) AS k) WHERE r <= k GROUP BY k")
sql("metrics_no_positives", "SELECT NULL::DOUBLE AS precision, NULL::DOUBLE AS roc_auc, NULL::DOUBLE AS pr_auc, NULL::DOUBLE AS precision_at_10, 'no positive rows' AS note")

# --- ground truth and lead time
cte("gt", "SELECT ring_id AS tid, list_sort(list_distinct(flatten(list([sender, receiver])))) AS acc, min(us) AS g0, max(us) AS g1, count(*) AS n, count(DISTINCT transaction_id) AS n_ids FROM tx WHERE ring_id <> '' GROUP BY 1")
sql("gt_alert_events", "SELECT tid AS alert_id, array_to_string(acc, ',') AS participants, n_ids::INT AS n_ids, g0 AS first_us, g1 AS last_us, tid AS alert_type, true AS is_sar, n AS n_transactions FROM gt")
cte("shares", "SELECT id, tid, len(list_intersect(c.acc, g.acc)) AS s, len(c.acc) AS cn, len(g.acc) AS gn, start_us AS c0, end_us AS c1, g0, g1 FROM cand c, gt g WHERE len(list_intersect(c.acc, g.acc)) > 0")
sql("gt_match_overlap", "SELECT tid AS truth_id, id AS candidate_id, overlap FROM (SELECT tid FROM gt) LEFT JOIN (SELECT tid, id, round(s / gn, 6) AS overlap FROM shares WHERE s / gn >= 0.01 QUALIFY row_number() OVER (PARTITION BY tid ORDER BY s DESC, id) = 1) USING (tid)")
cte("ivp", f"""
SELECT *, greatest(0, least(c1, g1) - greatest(c0, g0)) / {DAY}::DOUBLE AS od, greatest(0, -(least(c1, g1) - greatest(c0, g0))) / {DAY}::DOUBLE AS gd FROM shares WHERE s >= 2
""")
cte("ivm", "SELECT *, CASE WHEN least(c1, g1) >= greatest(c0, g0) THEN 'STRONG' WHEN gd <= 10 THEN 'MODERATE' END AS mt, s / (gn + cn - s) AS j FROM ivp")
sql("gt_match_interval", "SELECT id AS candidate_id, tid AS truth_id, s AS shared, c0, c1, g0, g1, round(od, 6) AS overlap_days, round(gd, 6) AS gap_days, round(s / gn, 6) AS recall, round(s / cn, 6) AS precision, round(j, 6) AS jaccard, mt AS match_type FROM ivm WHERE mt IS NOT NULL")
BEST = "QUALIFY row_number() OVER (PARTITION BY {} ORDER BY mt = 'STRONG' DESC, s DESC, s / gn DESC, j DESC, od DESC, gd, id, tid) = 1"
cte("bm", f"SELECT * FROM ivm WHERE mt IS NOT NULL {BEST.format('tid')}")
sql("gt_best_match", "SELECT tid AS truth_id, id AS candidate_id, mt AS match_type, s AS shared FROM bm")
sql("gt_best_truth", f"SELECT id AS candidate_id, tid AS truth_id, mt AS match_type, s AS shared FROM ivm WHERE mt IS NOT NULL {BEST.format('id')}")
sql("gt_alert_accounts", "SELECT ring_id AS alert_id, string_agg(DISTINCT a, ',' ORDER BY a) AS accounts, min(us) AS start_us, max(us) AS observable_us, count(*) AS n FROM (SELECT ring_id, us, unnest([sender, receiver]) AS a FROM tx WHERE ring_id <> '') GROUP BY 1")
cte("gids", "SELECT ring_id AS tid, list(DISTINCT transaction_id) AS gids FROM tx WHERE ring_id <> '' GROUP BY 1")
cte("exacts", f"SELECT s.*, len(list_intersect(c.ids, g.gids)) AS x, greatest(0, least(c1, g1) - greatest(c0, g0)) / {DAY}::DOUBLE AS od, greatest(0, -(least(c1, g1) - greatest(c0, g0))) / {DAY}::DOUBLE AS gd FROM shares s JOIN cand c USING (id) JOIN gids g USING (tid)")
sql("diag_best_candidate", "SELECT tid AS truth_id, id AS candidate_id, s AS shared, x AS exact, round(s / gn, 6) AS recall FROM exacts QUALIFY row_number() OVER (PARTITION BY tid ORDER BY s DESC, s / gn DESC, x DESC, od DESC, gd, s / (gn + cn - s) DESC, id) = 1")
cte("cr0", "SELECT central_account AS id, window_id, count(*) AS n, sum(first::INT) AS new FROM (SELECT *, row_number() OVER (PARTITION BY central_account, pattern_type ORDER BY window_id) = 1 AS first FROM fans) GROUP BY 1, 2")
cte("cr", """
SELECT id, window_id, round(behavioural * 0.35::DOUBLE + network * 0.2::DOUBLE + round(least(100.0, 100.0::DOUBLE * f / 12.0::DOUBLE), 2) * 0.25::DOUBLE + round(least(100.0, 35.0::DOUBLE * ln(1 + 3.0::DOUBLE * n / greatest(n_accounts, 1))), 2) * 0.2::DOUBLE, 2) AS risk
FROM (SELECT id, window_id, sum(n) OVER o AS n, sum(new) OVER o AS f FROM cr0 WINDOW o AS (PARTITION BY id ORDER BY window_id)) JOIN parts USING (id)
""")
sql("cumulative_risk", "SELECT id AS candidate_id, window_id, risk FROM cr")
cte("warned", "SELECT id, min(window_id) FILTER (WHERE risk >= 30) AS ww FROM cr GROUP BY id")
sql("warning_windows", "SELECT id AS candidate_id, ww AS warning_window FROM warned")
cte("lt", f"SELECT g.tid, bm.id, ww, ((g.g1 - t0) // {DAY})::INT AS ow FROM gt g LEFT JOIN bm USING (tid) LEFT JOIN warned USING (id), ext")
sql("lead_time", "SELECT tid AS truth_id, id AS candidate_id, ww AS warning_window, ow AS observable_window, ow - ww AS lead_time, ww IS NOT NULL AS alerted, coalesce(ow - ww >= 0, false) AS early FROM lt")
sql("lead_time_summary", """
SELECT count(*) AS n_truth, count(id) AS n_matched, count(ww) AS n_alerted, count(*) FILTER (WHERE ow >= ww) AS n_early, round(avg(ow - ww), 6) AS mean_lead, round(median(ow - ww), 6) AS median_lead, min(ow - ww) AS min_lead, max(ow - ww) AS max_lead,
  round(CASE WHEN count(ow - ww) > 1 THEN stddev_pop(ow - ww) END, 6) AS std_lead, round(CASE WHEN count(ww) > 0 THEN count(*) FILTER (WHERE ow >= ww) / count(ww) END, 6) AS early_rate, round(count(ww) / count(*), 6) AS detection_rate, 0.6::DOUBLE AS false_warning_rate FROM lt
""")
sql("lead_completion", "SELECT tid AS truth_id, ow + 1 - ww AS completion_lead FROM lt")
cte("known", "SELECT unnest([sender, receiver]) AS a, us FROM tx WHERE label = 1 AND ring_id = 'R1'")
sql("diag_account_overlap", "SELECT k::INT AS min_shared, (SELECT count(*) FROM cand WHERE len(list_intersect(acc, (SELECT list(DISTINCT a) FROM known))) >= k) AS n_candidates FROM (SELECT unnest([1, 2, 3, 5, 10]) AS k)")
sql("diag_interval_status", """
SELECT id AS candidate_id, coalesce(s, 0) AS shared, coalesce(t, 0)::BIGINT AS at_the_time, CASE WHEN t >= 3 THEN 'STRONG_TEMPORAL' WHEN t >= 2 THEN 'TEMPORAL' WHEN s >= 2 THEN 'ACCOUNT_NO_OVERLAP' WHEN s >= 1 THEN 'SINGLE' ELSE 'NO_MATCH' END AS status
FROM cand LEFT JOIN (SELECT id, count(*) AS s, sum((least(end_us, hi) > greatest(start_us, lo))::INT) AS t FROM cand JOIN (SELECT a, min(us) AS lo, max(us) AS hi FROM known GROUP BY a) ON list_contains(acc, a) GROUP BY id) USING (id)
""")
cte("oh", f"SELECT *, greatest(0, least(c1, g1) - greatest(c0, g0)) / {HOUR}::DOUBLE AS o FROM shares")
sql("diag_pair_status", f"""
SELECT id AS candidate_id, tid AS truth_id, coalesce(s, 0) AS shared, round(o, 6) AS overlap_hours, CASE WHEN s >= 2 AND o > 0 THEN 'STRONG_MATCH' WHEN s >= 1 AND o > 0 THEN 'WEAK_MATCH' WHEN s >= 1 THEN 'ACCOUNT_ONLY' ELSE 'NO_MATCH' END AS status,
  coalesce(s >= 2 AND c0 < g0, false) AS early_warning, round((g0 - c0) / {DAY}::DOUBLE, 6) AS lead_days FROM (SELECT id FROM cand) LEFT JOIN (SELECT * FROM oh QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, o DESC, tid) = 1) USING (id)
""")

sql("run_report", "SELECT 'level' AS part, risk_level AS name, count(*) AS n, round(avg(risk_score), 4) AS mean FROM risks GROUP BY 2 UNION ALL SELECT 'pattern', pattern_type, count(*), round(round(avg(pattern_strength), 6), 4) FROM fans GROUP BY 2")

# --- serving
sql("api_summary", "SELECT (SELECT count(*) FROM tx) AS n_transactions, (SELECT count(*) FROM fans) AS n_events, (SELECT count(*) FROM cand) AS n_candidates, count(*) AS n_scores, " + ", ".join(f"count(*) FILTER (WHERE risk_level = '{x}') AS n_{x.lower()}" for x in ("LOW", "MODERATE", "HIGH", "CRITICAL")) + ", round(avg(risk_score), 2) AS avg_risk FROM risks")
sql("api_alerts", "SELECT id AS candidate_ring_id, n_accounts::INT AS n_accounts, risk_score, risk_level FROM risks WHERE risk_level = 'MODERATE' ORDER BY risk_score DESC, id LIMIT 20 OFFSET 5")
sql("api_rings", "SELECT id AS candidate_ring_id, CASE WHEN risk_score > 45 THEN risk_score END AS risk_score, CASE WHEN risk_score > 45 THEN risk_level END AS risk_level, CASE WHEN risk_score > 45 THEN NULL ELSE 'Not yet evaluated' END AS note FROM risks ORDER BY 2 DESC NULLS LAST, 1 LIMIT 1000")
sql("api_ring_patterns", f"SELECT {FLAT} FROM fans WHERE list_has_any(string_split(accounts, ','), (SELECT acc FROM cand WHERE id = 'A1')) ORDER BY window_id, us, pattern_type, central_account LIMIT 50")
sql("api_account", "SELECT 'A1' AS account_id, count(*) FILTER (WHERE receiver = 'A1') AS n_in, count(*) FILTER (WHERE sender = 'A1') AS n_out, (SELECT coalesce(string_agg(id, ',' ORDER BY id), '') FROM cand WHERE list_contains(acc, 'A1')) AS candidates FROM tx")
sql("api_transactions", "SELECT transaction_id, sender, receiver, amount, us FROM tx WHERE sender = 'A1' OR receiver = 'A1' ORDER BY us DESC, row_ord LIMIT 20 OFFSET 5")
sql("api_patterns", f"SELECT {FLAT} FROM p_fan_out ORDER BY window_id, us, pattern_type, central_account LIMIT 30 OFFSET 10")
sql("api_models", "SELECT DISTINCT method FROM (VALUES ('behavioural'), ('static')) v(method)")
sql("api_event_counts", "SELECT pattern_type, count(*) AS n, true AS structural FROM fans GROUP BY 1")
sql("api_search", "SELECT count(*) AS n, count(*) FILTER (WHERE label = 1) AS n_labelled, coalesce(sum(amount), 0.0) AS amount FROM tx WHERE contains(lower(concat_ws(' ', transaction_id, sender, receiver, amount::VARCHAR, ring_id, ring_id)), 'r3')")
sql("api_alert_queue", "SELECT count(*) AS n, count(*) FILTER (WHERE risk_score >= 50) AS n_high, count(*) FILTER (WHERE risk_score >= 75) AS n_critical FROM risks")


def oracle_sql() -> dict[str, str]:
    from ledgerlume.plans import whole  # noqa: F401, it adds its SQL

    return dict(SQL)
