"""Small canonical tables."""

import datetime as dt

from ledgerlume.sources import canonical

START = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)


def at(day=0.0, hour=0.0, minute=0.0):
    return START + dt.timedelta(days=day, hours=hour, minutes=minute)


def table(spark, rows):
    """rows: (sender, receiver, amount, time[, label[, ring]]), in input order."""
    full = []
    for i, r in enumerate(rows):
        label, ring = (r[4] if len(r) > 4 else 0), (r[5] if len(r) > 5 else "")
        full.append((f"t{i}", r[0], r[1], None if r[2] is None else float(r[2]), r[3], label, ring, ring, "test", i))
    schema = "transaction_id string, sender string, receiver string, amount double, timestamp timestamp, label int, scenario_id string, ring_id string, dataset_source string, row_ord long"
    return canonical.coerce(spark.createDataFrame(full, schema), "test")
