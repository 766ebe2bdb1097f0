"""Adapters: files of known layouts as canonical tables."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlume.functions.durations import duration_us
from ledgerlume.sources import canonical


class Adapter(ABC):
    name = "adapter"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    @abstractmethod
    def raw(self) -> DataFrame:
        """The files in (nearly) canonical columns."""

    def load(self) -> DataFrame:
        return canonical.coerce(self.raw(), self.name)

    def validate(self) -> list[str]:
        return canonical.schema_problems(self.load())

    def describe(self) -> dict[str, str]:
        return {"source": self.name, "folder": self.folder}

    def csv(self, name: str, **options) -> DataFrame:
        return self.spark.read.csv(f"{self.folder}/{name}", **({"header": True} | options))


def resolve_times(df: DataFrame, column: str, start: str = "2024-01-01", unit: str = "D") -> Column:
    """Timestamps of a text column: parsed if over 99 % of the values parse as dates, else
    numbers of steps of one unit after start. One aggregate decides."""
    text = F.col(column).cast("string")
    share = df.agg(F.avg(F.try_to_timestamp(text).isNotNull().cast("int"))).first()[0]
    numbers = df.agg(F.avg(text.try_cast("double").isNotNull().cast("int"))).first()[0]
    if (share or 0) > 0.99 and (numbers or 0) <= 0.99:
        return F.try_to_timestamp(text)
    step = duration_us(f"1{unit.lower()}")
    return F.timestamp_micros((F.unix_micros(F.lit(start).cast("timestamp")) + text.try_cast("double") * step).cast("long"))


class SimulatorAdapter(Adapter):
    """Simulator logs: tran_id, orig_acct, bene_acct, base_amt, tran_timestamp, is_sar, alert_id."""

    name = "simulator"
    needed = ("tran_id", "orig_acct", "bene_acct", "base_amt", "tran_timestamp")

    def __init__(self, spark, folder, transactions: str = "transactions.csv", alerts: str = "alert_transactions.csv", start: str = "2024-01-01", unit: str = "D") -> None:
        super().__init__(spark, folder)
        self.transactions, self.alerts, self.start, self.unit = transactions, alerts, start, unit

    def raw(self) -> DataFrame:
        df = self.csv(self.transactions)
        if missing := [c for c in self.needed if c not in df.columns]:
            raise ValueError(f"required columns are missing: {', '.join(missing)}")
        sar = F.coalesce(F.lower(F.col("is_sar")).isin("true", "1", "1.0", "yes"), F.lit(False)) if "is_sar" in df.columns else F.lit(False)
        alert = F.coalesce(F.col("alert_id").try_cast("long"), F.lit(-1)) if "alert_id" in df.columns else F.lit(-1)
        scenario = F.when(alert != -1, alert.cast("string")).otherwise("")
        return df.select(
            F.col("tran_id").alias("transaction_id"), F.col("orig_acct").alias("sender"), F.col("bene_acct").alias("receiver"), F.col("base_amt").alias("amount"),
            resolve_times(df, "tran_timestamp", self.start, self.unit).alias("timestamp"), sar.cast("int").alias("label"), scenario.alias("scenario_id"), scenario.alias("ring_id"),
        )

    def alert_transactions(self) -> DataFrame:
        return self.csv(self.alerts)

    def accounts(self, name: str = "accounts.csv") -> DataFrame | None:
        """The account dimension; None where there is no such file."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.csv(name) if there else None


class PairGraphAdapter(Adapter):
    """A transaction graph in three files: features without a header (id, step, ...), classes
    and edges between ids. Amounts are unknown; steps are 14 days."""

    name = "pair_graph"

    def __init__(self, spark, folder, features="features.csv", classes="classes.csv", edges="edgelist.csv", start: str = "2024-01-01", step_days: int = 14) -> None:
        super().__init__(spark, folder)
        self.features, self.classes, self.edges, self.start, self.step_days = features, classes, edges, start, step_days

    def raw(self) -> DataFrame:
        steps = self.csv(self.features, header=False).select(F.col("_c0").alias("tx"), F.col("_c1").try_cast("int").alias("step"))
        classes = self.csv(self.classes).toDF("tx", "class")
        edges = self.csv(self.edges).toDF("a", "b")
        label = F.when(F.col("class") == "1", 1).when(F.col("class") == "2", 0).otherwise(-1)
        known = steps.join(classes, "tx", "left").select("tx", "step", label.alias("label"))
        at = F.date_add(F.lit(self.start).cast("date"), (F.col("step") - 1) * self.step_days).cast("timestamp")
        return edges.join(known, edges.a == known.tx, "left").select(
            F.concat_ws("_", "a", "b").alias("transaction_id"), F.col("a").alias("sender"), F.col("b").alias("receiver"), F.lit(None).cast("double").alias("amount"), at.alias("timestamp"), "label",
        )


class DemoAdapter(Adapter):
    """Canonical CSV plus ground truth in JSON."""

    name = "demo"

    def raw(self) -> DataFrame:
        return self.csv("transactions.csv")

    def ground_truth(self, name: str = "ring_ground_truth.json") -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.json(f"{self.folder}/{name}", multiLine=True)


class EventsAdapter(Adapter):
    """The fixture: a stream table of user events as transfers. Amounts are whole quarters, so
    that sums don't depend on their order."""

    name = "events"

    def raw(self) -> DataFrame:
        events = self.spark.read.parquet(f"{self.folder}/events.parquet")
        n = events.agg(F.max("user_id").alias("m")).select((F.col("m") + 1).alias("n"))
        wrong = F.col("event_type") == "error"
        ring = F.when(wrong, F.concat(F.lit("R"), (F.col("user_id") % 10).cast("string"))).otherwise("")
        account = lambda c: F.concat(F.lit("A"), c.cast("string"))
        return events.crossJoin(F.broadcast(n)).select(  # one row
            F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("transaction_id"), account(F.col("user_id")).alias("sender"),
            account((F.col("event_id") * 7919 + F.col("user_id") * 31) % F.col("n")).alias("receiver"), F.greatest(F.floor(F.col("value") * 4) / 4.0, F.lit(0.25)).alias("amount"),
            F.col("ts").cast("timestamp").alias("timestamp"), wrong.cast("int").alias("label"), ring.alias("scenario_id"), ring.alias("ring_id"), F.col("event_id").alias("row_ord"),
        )


ADAPTERS: dict[str, Callable[..., Adapter]] = {a.name: a for a in (SimulatorAdapter, PairGraphAdapter, DemoAdapter, EventsAdapter)}


def load_active(spark: SparkSession, active: str, folder: str, **options) -> DataFrame:
    if active not in ADAPTERS:
        raise ValueError(f"no adapter {active!r}; there are {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[active](spark, folder, **options).load()


ALERT_ACCOUNTS = T.StructType([T.StructField(c, T.StringType()) for c in ("acct_id", "start", "end", "alert_id", "alert_type")])
