from pyspark.sql import functions as F

from ledgerlume.operators import labels
from ledgerlume.streaming import fans
from tests.helpers import at, table


def test_fans_of_a_stream(spark, tmp_path):
    day = [(f"S{i % 6}", "HUB", 10, at(0, i)) for i in range(12)] + [("S1", "OTHER", 1, at(0, 3))]
    table(spark, day + [("X", "Y", 1, at(9), 1)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    for make, name in ((fans.fan_counts, "fan_table"), (fans.active_labels, "label_table")):
        q = make(stream).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    (e,) = spark.table("fan_table").collect()
    assert (e["hub"], e["n"], e["total"]) == ("HUB", 6, 120.0)
    want = labels.same_window(table(spark, day)).where("window_id = 0").count()
    assert spark.table("label_table").where(F.col("y") == 0).count() == want
