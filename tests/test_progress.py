from pyspark.sql import functions as F

from graniteseek.plans.progress import Progress


def test_events_come_when_stages_are_stored(spark, tmp_path):
    heard = []
    progress = Progress(tell=lambda event, counts: heard.append((event, counts)))
    rows = progress.watch(spark.range(10), "first", n=F.count(F.lit(1)))
    rows = progress.watch(rows.filter("id % 2 = 0"), "second", n=F.count(F.lit(1)), most=F.max("id"))
    assert heard == []
    rows.write.parquet(str(tmp_path / "x"))
    assert progress.stored(rows) is rows
    assert heard == progress.events == [("first", {"n": 10}), ("second", {"n": 5, "most": 8})]
    progress.stored(rows)
    assert len(progress.events) == 2
    progress.say("done")
    assert progress.events[-1] == ("done", {})
    empty = progress.watch(spark.range(0), "none", n=F.count(F.lit(1)))
    empty.write.parquet(str(tmp_path / "y"))
    progress.stored(empty)
    assert heard[-1] == ("none", {"n": 0})
