from cartolith.operators import orphans as O
from cartolith.streaming.orphans import SCHEMA, OrphanMonitor, events


def test_stream_equals_batch(spark, data_dir, tmp_path):
    t, r = O.all_versions(spark, data_dir)
    t, r = t.where("id % 3 = 0"), r.where("ref is null or ref % 3 = 0")
    src = tmp_path / "in"
    for k in range(3):
        part = lambda df, c: df.where(f"pmod(hash({c}, edited), 3) = {k}")  # noqa: E731, B023
        events(part(t, "id"), part(r, "owner_id")).coalesce(1).write.mode("append").parquet(str(src))
    m = OrphanMonitor(spark, str(tmp_path / "state"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src))
    m.start(stream, str(tmp_path / "checkpoint")).awaitTermination()
    got = sorted(map(tuple, m.orphans().collect()))
    assert got == sorted(map(tuple, O.named(O.OrphanState.start(t, r).pending).collect())) and got
    again = m.state()
    m.on_batch(spark.read.schema(SCHEMA).parquet(str(src)), 2)  # the last batch once more, with all rows
    assert sorted(map(tuple, m.orphans().collect())) == got and again is not None
    snaps = spark.read.parquet(*(str(p) for p in sorted((tmp_path / "state" / "snapshots").iterdir())))
    assert snaps.where("batch = 2").groupBy().sum("n").first()[0] == len(got)
