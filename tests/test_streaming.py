"""Streams read files and end when all are read."""

import datetime as dt

from caseloom.streaming import sessions


def source(spark, folder):
    rows = [("u", "a", 0), ("u", "b", 1), ("u", "c", 90), ("v", "a", 2), ("v", "b", 3), ("z", "a", 600)]
    start = dt.datetime(2024, 1, 1)
    data = [(k, a, start + dt.timedelta(minutes=m)) for k, a, m in rows]
    spark.createDataFrame(data, "k string, a string, t timestamp").coalesce(1).write.mode("overwrite").parquet(folder)
    return spark.readStream.schema("k string, a string, t timestamp").parquet(folder)


def result(df, mode, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_sessions(spark, tmp_path):
    got = result(sessions.session_cases(source(spark, str(tmp_path / "in")), "k", "a", "t"), "append", tmp_path, "cases")
    assert sorted("".join(r["trace"]) for r in got) == ["ab", "ab", "c"]


def test_windows(spark, tmp_path):
    got = result(sessions.windowed_counts(source(spark, str(tmp_path / "in")), "a", "t"), "complete", tmp_path, "counts")
    assert sum(r["n"] for r in got) == 6


def test_follows(spark, tmp_path):
    got = result(sessions.follows(source(spark, str(tmp_path / "in")), "k", "a", "t"), "append", tmp_path, "follows")
    assert sorted((r["a"], r["b"]) for r in got) == [("a", "b"), ("a", "b"), ("b", "c")]
