"""Worked examples of logs, filters and encodings."""

import pytest
from pyspark.sql import functions as F

from caseloom import EventLog
from caseloom.functions import trace as T
from caseloom.operators import cluster, filters, noise, relations, stats
from caseloom.sources import logs


def log_of(spark, *traces):
    return EventLog.from_traces(spark, [list(t) for t in traces])


def traces(log):
    return sorted("".join(r["trace"]) for r in log.cases.collect())


def weights(log):
    return {"".join(r["trace"]): r["occ"] for r in log.weighted().collect()}


def test_variants_and_back(spark):
    log = log_of(spark, "ABAB", "CD", "ACB", "CD")
    assert weights(log) == {"ACB": 1, "CD": 2, "ABAB": 1}
    assert traces(EventLog.from_variants(log.weighted())) == traces(log)


def test_union_keeps_every_case(spark):
    both = log_of(spark, "AB", "CD").union(log_of(spark, "SBE", "C"))
    assert traces(both) == ["AB", "C", "CD", "SBE"]
    assert both.cases.select("case_id").distinct().count() == 4


def test_raw_lines(spark):
    log = logs.from_lines(spark, ["# a comment", "state. graph", "s0 S. s1", "  "], reencoder=lambda t: T.stripped(t, "."))
    assert sorted(tuple(r["trace"]) for r in log.cases.collect()) == [("s0", "S", "s1"), ("state", "graph")]


def test_files(spark, tmp_path):
    log = log_of(spark, "AB", "CDC", "AB")
    logs.write_raw(log, str(tmp_path / "raw"))
    assert traces(logs.read_raw(spark, str(tmp_path / "raw"))) == traces(log)
    logs.write_xes(log, str(tmp_path / "xes"))
    assert traces(logs.read_xes(spark, str(tmp_path / "xes"))) == traces(log)
    events = logs.read_xes_events(spark, str(tmp_path / "xes")).collect()
    assert {r["attrs"]["transition"] for r in events} == {"complete"} and len(events) == 7
    (tmp_path / "x.csv").write_text("1,B,2020-01-02,2020-01-03\n#1,X,2020-01-01,2020-01-01\n1,A,2020-01-01,2020-01-02\n2,C,2020-01-01,2020-01-01\n")
    assert traces(logs.read_csv(spark, str(tmp_path / "x.csv"))) == ["AB", "C"]
    with pytest.raises(TypeError):
        logs.read_log(spark, "x.csv")
    with pytest.raises(ValueError):
        logs.read_log(spark, "x", "other")


def test_encodings(spark):
    log = log_of(spark, "abc", "adec", "aedc")
    codes = filters.number_dictionary(log)
    coded = filters.reencode(log, codes)
    assert sorted(" ".join(r["trace"]) for r in coded.cases.collect()) == ["e0 e1 e2", "e0 e3 e4 e2", "e0 e4 e3 e2"]
    assert traces(filters.reencode(coded, filters.decoder(codes))) == traces(log)
    with pytest.raises(filters.NotInvertible):
        filters.decoder({"a": "x", "b": "x"})
    assert [filters.alpha_code(i) for i in (0, 25, 26, 27, 701, 702)] == ["a", "z", "aa", "ab", "zz", "aaa"]


def test_projections(spark):
    assert traces(filters.project(log_of(spark, "AB", "CD"), ["A", "D"])) == ["A", "D"]
    log = log_of(spark, "ABAB", "CD", "ACB")
    freq = stats.activity_frequencies(log)
    assert {r["activity"]: r["n"] for r in freq.collect()} == {"A": 3, "B": 3, "C": 2, "D": 1}
    top = [r["activity"] for r in filters.most_frequent(freq, 2).collect()]
    assert sorted(top) == ["A", "B"]
    assert traces(filters.project(log, top, "keep_if_any")) == ["ABAB", "ACB"]
    assert traces(filters.project(log, top, "keep_if_all")) == ["ABAB"]


def test_frequency_filter(spark):
    log = log_of(spark, *["ABAB"] * 5, *["CD"] * 3, *["ACB"] * 2)
    assert filters.frequency_threshold(log, log_min_freq=0.35).first()["t"] == 5
    kept = filters.frequent_variants(log, log_min_freq=0.35)
    assert weights(kept) == {"ABAB": 5}
    with pytest.raises(TypeError):
        filters.frequency_threshold(log)


def test_conditioning(spark):
    log = filters.conditioned(log_of(spark, "AB", "CD"))
    assert traces(log) == ["SABE", "SCDE"]
    assert traces(filters.conditioned(log)) == ["SABE", "SCDE"]


def test_histogram_totals_and_steps(spark):
    log = log_of(spark, "ABAB", "CD", "ACB", "CD", "A")
    assert sum(r["cases"] for r in stats.length_histogram(log).collect()) == 5
    steps = {(r["a"], r["b"]): r["n"] for r in relations.direct_succession(log).collect()}
    assert steps == {("A", "B"): 2, ("B", "A"): 1, ("C", "D"): 2, ("A", "C"): 1, ("C", "B"): 1}
    later = {(r["a"], r["b"]): r["n"] for r in relations.eventual_succession(log).collect()}
    assert later["A", "B"] == 4 and later["A", "A"] == 1
    loops = {(r["a"], r["b"]): r["n"] for r in relations.two_loops(log).collect()}
    assert loops == {("A", "B"): 1, ("B", "A"): 1}


def test_noise_is_one_edit(spark):
    log = log_of(spark, *["ABCDEF"] * 200)
    got = traces(noise.add_noise(log, "single", 0.5, seed=2))
    changed = [t for t in got if t != "ABCDEF"]
    assert 60 < len(changed) < 140 and {len(t) for t in changed} <= {5, 6, 7}
    assert all(len(t) < 6 or sorted(t) == list("ABCDEF") for t in traces(noise.add_noise(log, "maruster", 0.5, seed=2)))


def test_clusters(spark):
    log = log_of(spark, "AB", "AC", "AB", "D", "DE", "F")
    sizes = sorted(r["count"] for r in cluster.balanced(log, 4).groupBy("cluster").count().collect())
    assert sizes == [1, 1, 2, 2]
    small = cluster.optional(log, 2).groupBy("cluster").agg(F.count_distinct("trace").alias("n"))
    assert max(r["n"] for r in small.collect()) <= 2
    sets = cluster.max_alphabet(log, 2).groupBy("cluster").agg(F.size(F.array_distinct(F.flatten(F.collect_list("trace")))).alias("n"))
    assert max(r["n"] for r in sets.collect()) <= 2
    parts = {"".join(r["trace"]): r["cluster"] for r in cluster.exclusive(log).collect()}
    assert parts == {"AB": 0, "AC": 0, "D": 1, "DE": 1, "F": 2}
    assert len(cluster.hierarchical(log)) == 4
    assert cluster.similar(log).select("cluster").distinct().count() == 2


def test_empty_log(spark):
    log = EventLog(spark.createDataFrame([], "case_id string, trace array<string>"))
    assert stats.statistics(log).first()["variants"] == 0
    assert relations.direct_succession(log).count() == 0
