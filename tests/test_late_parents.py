"""Children that come before their parents, over restarts of the stream."""

from collections import Counter
from datetime import datetime, timedelta

from sparkprep.streaming import references

START = datetime(2024, 1, 1)
CHILD, PARENT = "cost_id string, shipment_id string, at timestamp", "shipment_id string, shipped timestamp"


class Feed:
    def __init__(self, spark, tmp_path, known=None):
        self.spark, self.tmp, self.known = spark, tmp_path, known
        for name, ddl in (("children", CHILD), ("parents", PARENT)):
            spark.createDataFrame([], ddl).write.mode("append").parquet(str(tmp_path / name))

    def add(self, name, *rows):
        ddl = CHILD if name == "children" else PARENT
        self.spark.createDataFrame([(*r[:-1], START + timedelta(minutes=r[-1])) for r in rows], ddl).write.mode("append").parquet(str(self.tmp / name))

    def run(self):
        """A new query on the same checkpoint: what a restart does."""
        read = lambda name, ddl: self.spark.readStream.schema(ddl).parquet(str(self.tmp / name))
        checked = references.late_references(read("children", CHILD), "shipment_id", "at", read("parents", PARENT), "shipment_id", "shipped", wait="1 hour", back="1 day", late="10 minutes", known=self.known)
        references.write(checked, str(self.tmp / "out"), str(self.tmp / "checkpoint")).awaitTermination()
        rows = self.spark.read.schema(CHILD + ", shipment_id_valid_ref boolean, match_type string").parquet(str(self.tmp / "out")).collect()
        assert max(Counter(r["cost_id"] for r in rows).values(), default=1) == 1  # told once
        return {r["cost_id"]: (r["shipment_id_valid_ref"], r["match_type"]) for r in rows}


def test_late_parents(spark, tmp_path):
    known = spark.createDataFrame([("S7",), ("LOC-8",)], "shipment_id string")
    feed = Feed(spark, tmp_path, known)
    feed.add("children", ("c1", "S1", 0), ("c2", "S2", 0), ("c3", None, 0), ("c7", "S7", 0), ("c8", "8", 0), ("c9", "X-9", 5))
    got = feed.run()
    assert got == {"c3": (True, None), "c7": (True, "exact"), "c8": (True, "prefix_stripped")}  # the others wait
    feed.add("parents", ("S1", 30), ("S1", 31), ("9", 20))
    got = feed.run()
    assert got["c1"] == (True, "exact") and got["c9"] == (True, "prefix_stripped") and "c2" not in got
    # both streams go on for hours: the parent of c2 cannot come in time any more
    feed.add("children", ("c4", "S4", 300))
    feed.add("parents", ("S4", 301), ("S9", 400))
    feed.run()
    feed.add("children", ("c5", "S5", 500))
    feed.add("parents", ("S6", 500))
    got = feed.run()
    assert got["c2"] == (False, "no_match") and got["c4"] == (True, "exact") and "c5" not in got
    assert feed.run() == got  # nothing new, nothing told again
