"""The engine's operators as queries over the driver tables, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eventlog import EventLog
from .functions import trace as T
from .operators import cluster, filters, noise, relations, stats
from .plans import bpmn, cnet, discovery, petri, ts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_log(spark, sf_dir: str) -> EventLog:
    e = read(spark, sf_dir, "events")
    return EventLog.from_events(e, F.concat_ws("|", "user_id", F.to_date("ts").cast("string")), "event_type", ["ts", "event_id"])


def frequent_log(spark, sf_dir: str) -> EventLog:
    """The eight most frequent variants of the day log."""
    return EventLog.from_variants(day_log(spark, sf_dir).weighted().orderBy(F.desc("occ"), "trace").limit(8))


def conversation_log(spark, sf_dir: str) -> EventLog:
    return EventLog.from_events(read(spark, sf_dir, "conversations"), "conv_id", "role", ["turn"])


def customer_log(spark, sf_dir: str) -> EventLog:
    return EventLog.from_events(read(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", ["o_orderdate", "o_orderkey"])


DAY = "WITH cases AS (SELECT concat_ws('|', user_id, CAST(ts AS DATE)) AS case_id, list(event_type ORDER BY ts, event_id) AS trace FROM events WHERE event_type IS NOT NULL GROUP BY 1)"
CONV = "WITH cases AS (SELECT conv_id::VARCHAR AS case_id, list(role ORDER BY turn) AS trace FROM conversations WHERE role IS NOT NULL GROUP BY 1)"
CUST = "WITH cases AS (SELECT o_custkey::VARCHAR AS case_id, list(o_orderpriority ORDER BY o_orderdate, o_orderkey) AS trace FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1)"
VARIANTS = ", variants AS (SELECT trace, count(*) AS occ FROM cases GROUP BY trace)"
TEXT = "array_to_string(trace, ',')"
STEPS = ", steps AS (SELECT case_id, unnest(trace[:-2]) AS a, unnest(trace[2:]) AS b FROM cases WHERE len(trace) > 1), ds AS (SELECT a, b, count(*) AS n FROM steps GROUP BY a, b)"


RECURSIVE = CONV.replace("WITH", "WITH RECURSIVE", 1)
TOP = ", top AS (SELECT trace FROM variants ORDER BY occ DESC, trace LIMIT 3)"
FEW = DAY.replace("WITH", "WITH RECURSIVE", 1) + VARIANTS + TOP.replace("LIMIT 3", "LIMIT 8")
ALPHABETS = ", sets AS (SELECT list_sort(list_distinct(trace)) AS s, count(*) AS n FROM variants GROUP BY 1)"


def _regions(traces: str) -> str:
    """Minimal regions of one token of the set system of ``traces``, by trying every set of states."""
    key = "coalesce(array_to_string(list_sort(list_distinct(trace[1:{}])), ','), '')"
    return f""", p AS (SELECT trace, unnest(range(len(trace))) AS i FROM {traces}),
edges AS (SELECT DISTINCT {key.format("i")} AS src, trace[i + 1] AS label, {key.format("i + 1")} AS dst FROM p),
states AS (SELECT src AS s FROM edges UNION SELECT dst FROM edges),
subs(s, last) AS (SELECT []::VARCHAR[], NULL::VARCHAR UNION ALL SELECT list_append(subs.s, states.s), states.s FROM subs JOIN states ON last IS NULL OR states.s > last),
steps AS (SELECT subs.s AS m, label, list_contains(subs.s, dst)::INT - list_contains(subs.s, src)::INT AS g FROM subs CROSS JOIN edges),
grad AS (SELECT m, label, min(g) AS lo, max(g) AS hi FROM steps GROUP BY 1, 2),
found AS (SELECT m, list({{'l': label, 'g': lo}} ORDER BY label) AS d FROM grad GROUP BY m HAVING bool_and(lo = hi) AND min(lo) < 0),
minimal AS (SELECT m, d FROM found f WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.m <> f.m AND list_has_all(f.m, o.m))),
places AS (SELECT 'p' || (row_number() OVER (ORDER BY d) - 1) AS place, m, d FROM minimal),
cells AS (SELECT place, m, x.l AS label, x.g AS g FROM (SELECT place, m, unnest(d) AS x FROM places))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def text(log: EventLog) -> DataFrame:
    return log.cases.select("case_id", F.concat_ws(",", "trace").alias("trace"))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(
    DAY + STEPS + """, tl AS (SELECT x[1] AS a, x[2] AS b, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(trace) - 1), lambda i: trace[i:i+2])) AS x FROM cases WHERE len(trace) > 2) WHERE x[1] = x[3] GROUP BY 1, 2),
keys AS (SELECT a, b FROM ds UNION SELECT b, a FROM ds), loops AS (SELECT a, b FROM tl UNION SELECT b, a FROM tl),
m AS (SELECT k.a, k.b, coalesce(d.n, 0) AS n, coalesce(e.n, 0) AS r FROM keys k LEFT JOIN ds d ON k.a = d.a AND k.b = d.b LEFT JOIN ds e ON k.a = e.b AND k.b = e.a),
l AS (SELECT k.a, k.b, (coalesce(d.n, 0) + coalesce(e.n, 0)) / (coalesce(d.n, 0) + coalesce(e.n, 0) + 1) AS l2l FROM loops k LEFT JOIN tl d ON k.a = d.a AND k.b = d.b LEFT JOIN tl e ON k.a = e.b AND k.b = e.a)
SELECT m.a, m.b, m.n::BIGINT AS n, round(CASE WHEN m.a = m.b THEN n / (n + 1) ELSE (n - r) / (n + r + 1) END, 6) AS dep, round(coalesce(l2l, 0), 6) AS l2l FROM m LEFT JOIN l USING (a, b)"""
)
def dependency_graph(spark, sf_dir):
    return rounded(relations.dependencies(day_log(spark, sf_dir)))


@query(DAY + STEPS + " SELECT a, b, n::BIGINT AS n FROM ds")
def direct_succession(spark, sf_dir):
    return relations.direct_succession(day_log(spark, sf_dir))


@query(DAY + " SELECT x[1] AS a, x[2] AS b, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(trace) - 1), lambda i: trace[i:i+2])) AS x FROM cases WHERE len(trace) > 2) WHERE x[1] = x[3] GROUP BY 1, 2")
def two_loops(spark, sf_dir):
    return relations.two_loops(day_log(spark, sf_dir))


@query(DAY + ", p AS (SELECT case_id, unnest(trace) AS x, unnest(range(len(trace))) AS i FROM cases) SELECT l.x AS a, r.x AS b, count(*) AS n FROM p l JOIN p r ON l.case_id = r.case_id AND l.i < r.i GROUP BY 1, 2")
def eventual_succession(spark, sf_dir):
    return relations.eventual_succession(day_log(spark, sf_dir))


@query(CONV + STEPS + ", m AS (SELECT d.a, d.b, d.n, coalesce(e.n, 0) AS r FROM ds d LEFT JOIN ds e ON d.a = e.b AND d.b = e.a) SELECT a, b FROM m WHERE CASE WHEN a = b THEN n / (n + 1) ELSE (n - r) / (n + r + 1) END >= 0.9")
def heuristic_arcs(spark, sf_dir):
    return relations.flexible_heuristic_miner(conversation_log(spark, sf_dir))


@query(CONV + STEPS + ", names AS (SELECT DISTINCT unnest(trace) AS x FROM cases) SELECT l.x AS a, r.x AS b, CASE WHEN d.n IS NOT NULL AND e.n IS NOT NULL THEN '||' WHEN d.n IS NOT NULL THEN '->' WHEN e.n IS NOT NULL THEN '<-' ELSE '#' END AS relation FROM names l CROSS JOIN names r LEFT JOIN ds d ON d.a = l.x AND d.b = r.x LEFT JOIN ds e ON e.a = r.x AND e.b = l.x")
def footprint(spark, sf_dir):
    return relations.footprint(conversation_log(spark, sf_dir))


@query(DAY + VARIANTS + f" SELECT {TEXT} AS trace, occ::BIGINT AS occ, len(trace)::INT AS len, (row_number() OVER (ORDER BY occ DESC, trace) - 1)::INT AS variant_id FROM variants")
def variants(spark, sf_dir):
    return day_log(spark, sf_dir).variants().withColumn("trace", F.concat_ws(",", "trace"))


@query(DAY + f" SELECT {TEXT} AS trace, count(*) AS n FROM cases GROUP BY 1")
def rehydrated_cases(spark, sf_dir):
    log = EventLog.from_variants(day_log(spark, sf_dir).weighted())
    return log.cases.groupBy(F.concat_ws(",", "trace").alias("trace")).agg(F.count(F.lit(1)).alias("n"))


@query(DAY + " SELECT DISTINCT unnest(trace) AS activity FROM cases")
def alphabet(spark, sf_dir):
    return day_log(spark, sf_dir).alphabet()


@query(DAY + " SELECT case_id, unnest(range(len(trace)))::INT AS pos, unnest(trace) AS activity FROM cases")
def event_positions(spark, sf_dir):
    return day_log(spark, sf_dir).events.select("case_id", "pos", "activity")


@query(DAY + " SELECT len(trace)::INT AS length, count(*) AS cases FROM cases GROUP BY 1")
def length_histogram(spark, sf_dir):
    return stats.length_histogram(day_log(spark, sf_dir))


@query(DAY + VARIANTS + " SELECT occ::BIGINT AS occ, count(*) AS variants FROM variants GROUP BY 1")
def frequency_histogram(spark, sf_dir):
    return stats.frequency_histogram(day_log(spark, sf_dir))


@query(DAY + " SELECT count(*) AS cases, count(DISTINCT trace) AS variants, min(len(trace))::INT AS min_length, max(len(trace))::INT AS max_length, round(avg(len(trace)), 1) AS avg_length, (SELECT count(DISTINCT event_type) FROM events) AS activities FROM cases")
def log_statistics(spark, sf_dir):
    return stats.statistics(day_log(spark, sf_dir))


@query(DAY + " SELECT activity, count(*) AS n FROM (SELECT unnest(trace) AS activity FROM cases) GROUP BY 1")
def activity_frequencies(spark, sf_dir):
    return stats.activity_frequencies(day_log(spark, sf_dir))


@query(DAY + " SELECT activity, count(DISTINCT case_id) AS n FROM (SELECT case_id, unnest(trace) AS activity FROM cases) GROUP BY 1")
def activity_case_counts(spark, sf_dir):
    return stats.activity_frequencies(day_log(spark, sf_dir), by_case=True)


@query(DAY + " SELECT DISTINCT unnest(trace) AS activity, case_id FROM cases")
def cases_per_activity(spark, sf_dir):
    return stats.cases_per_activity(day_log(spark, sf_dir))


@query(DAY + VARIANTS + f", p AS (SELECT trace, unnest(trace) AS activity, unnest(range(len(trace))) AS i FROM variants) SELECT {TEXT} AS trace, activity, string_agg(i::VARCHAR, ',' ORDER BY i) AS positions FROM p GROUP BY trace, activity")
def activity_positions(spark, sf_dir):
    found = stats.activity_positions(day_log(spark, sf_dir))
    return found.select(F.concat_ws(",", "trace").alias("trace"), "activity", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("SELECT o_orderpriority AS activity, round(avg(epoch(l_shipdate) - epoch(o_orderdate)), 6) AS avg_seconds FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def mean_durations(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rounded(stats.durations(rows, "o_orderpriority", "o_orderdate", "l_shipdate"))


@query("WITH c AS (SELECT role AS who, count(*) AS n FROM conversations WHERE turn = 0 GROUP BY 1) SELECT who, n, (100 * n // sum(n) OVER ())::BIGINT AS pct_int, round(n / sum(n) OVER (), 6) AS share FROM c")
def performer_shares(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").where("turn = 0").withColumn("activity", F.lit("open"))
    return rounded(stats.shares(rows, "open", "role"))


def _projection(action: str, names: tuple[str, ...], condition: str | None):
    lst = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    if condition is None:
        neg = "NOT " if action == "suppress" else ""
        sql = DAY + f", p AS (SELECT case_id, list_filter(trace, lambda x: {neg}list_contains({lst}, x)) AS trace FROM cases) SELECT case_id, {TEXT} AS trace FROM p WHERE len(trace) > 0"
    else:
        sql = DAY + f" SELECT case_id, {TEXT} AS trace FROM cases WHERE " + condition.format(lst=lst)
    name = f"project_{action}"
    QUERIES[name] = lambda spark, sf_dir: text(filters.project(day_log(spark, sf_dir), names, action))
    SQL[name] = sql


for _action, _condition in {
    "keep": None, "suppress": None, "keep_if_any": "list_has_any(trace, {lst})", "suppress_if_any": "NOT list_has_any(trace, {lst})",
    "keep_if_all": "list_has_all({lst}, trace)", "suppress_if_all": "NOT list_has_all({lst}, trace)", "keep_if_contains_all": "list_has_all(trace, {lst})",
}.items():
    _projection(_action, ("click", "purchase"), _condition)


@query(DAY + ", f AS (SELECT activity, count(*) AS n FROM (SELECT unnest(trace) AS activity FROM cases) GROUP BY 1) SELECT activity, n FROM f ORDER BY n DESC, activity LIMIT 2")
def most_frequent_activities(spark, sf_dir):
    return filters.most_frequent(stats.activity_frequencies(day_log(spark, sf_dir)), 2)


@query(DAY + " SELECT activity, count(*) AS n FROM (SELECT unnest(trace) AS activity FROM cases) GROUP BY 1 HAVING count(*) >= 100")
def activities_above_threshold(spark, sf_dir):
    return filters.above_threshold(stats.activity_frequencies(day_log(spark, sf_dir)), 100)


@query(DAY + " SELECT case_id, array_to_string(list_transform(trace, lambda x: 'e_' || x), ',') AS trace FROM cases")
def prefixed_activities(spark, sf_dir):
    return text(day_log(spark, sf_dir).map(lambda t: T.prefixed(t, "e_")))


@query(DAY + " SELECT case_id, array_to_string(list_filter(trace, lambda x, i: i = 1 OR x <> trace[i-1]), ',') AS trace FROM cases")
def collapsed_repetitions(spark, sf_dir):
    return text(day_log(spark, sf_dir).map(T.collapse))


@query(CUST + " SELECT case_id, array_to_string(list_transform(trace, lambda x: translate(x, ' ''._()-+&', '')), ',') AS trace FROM cases")
def stripped_names(spark, sf_dir):
    return text(customer_log(spark, sf_dir).map(T.stripped))


@query(DAY + ", e AS (SELECT case_id, unnest(trace) AS activity, unnest(range(len(trace))) AS pos FROM cases), f AS (SELECT activity, row_number() OVER (ORDER BY min((case_id, pos))) - 1 AS k FROM e GROUP BY activity), r AS (SELECT case_id, list('e' || k ORDER BY pos) AS trace FROM e JOIN f USING (activity) GROUP BY case_id) SELECT case_id, array_to_string(trace, ',') AS trace FROM r")
def numbered_activities(spark, sf_dir):
    log = day_log(spark, sf_dir)
    return text(filters.reencode(log, filters.number_dictionary(log)))


@query(DAY + f" SELECT case_id, 'S,' || {TEXT} || ',E' AS trace FROM cases")
def dummy_start_end(spark, sf_dir):
    return text(filters.add_end(filters.add_start(day_log(spark, sf_dir))))


@query(DAY + f" SELECT case_id, {TEXT} AS trace FROM cases WHERE len(trace) BETWEEN 2 AND 4")
def cases_by_length(spark, sf_dir):
    return text(filters.case_length(day_log(spark, sf_dir), 2, 4))


@query(DAY + f", b AS (SELECT trace[1] AS a FROM cases GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT case_id, {TEXT} AS trace FROM cases, b WHERE trace[1] = a")
def cases_by_initial_activity(spark, sf_dir):
    return text(filters.initial_activity(day_log(spark, sf_dir)))


@query(DAY + f" SELECT case_id, {TEXT} AS trace FROM (SELECT *, count(*) OVER (PARTITION BY trace) AS occ FROM cases) WHERE occ >= 20")
def frequent_by_count(spark, sf_dir):
    return text(filters.frequent_variants(day_log(spark, sf_dir), case_min_freq=20))


@query(DAY + f" SELECT case_id, {TEXT} AS trace FROM (SELECT *, count(*) OVER (PARTITION BY trace) AS occ, count(*) OVER () AS total FROM cases) WHERE occ >= greatest(floor(total * 0.01), 1)")
def frequent_by_share(spark, sf_dir):
    return text(filters.frequent_variants(day_log(spark, sf_dir), case_min_freq=0.01))


@query(DAY + f", o AS (SELECT *, count(*) OVER (PARTITION BY trace) AS occ FROM cases), c AS (SELECT occ, sum(count(*)) OVER (ORDER BY occ DESC) AS cum, sum(count(*)) OVER () AS total FROM o GROUP BY occ), t AS (SELECT max(occ) AS t FROM c WHERE cum >= floor(total * 0.35)) SELECT case_id, {TEXT} AS trace FROM o, t WHERE occ >= t")
def frequent_by_coverage(spark, sf_dir):
    return text(filters.frequent_variants(day_log(spark, sf_dir), log_min_freq=0.35))


@query(CONV + " SELECT count(DISTINCT trace[1]) = 1 AND NOT bool_or(list_contains(trace[2:-2], trace[1])) AS unique_start, count(DISTINCT trace[-1]) = 1 AND NOT bool_or(list_contains(trace[2:-2], trace[-1])) AS unique_end FROM cases")
def unique_ends(spark, sf_dir):
    log = conversation_log(spark, sf_dir)
    return spark.createDataFrame([(filters.has_unique_start(log), filters.has_unique_end(log))], "unique_start boolean, unique_end boolean")


@query(CONV.replace("cases", "c1") + ", " + DAY.removeprefix("WITH ").replace("cases AS", "c2 AS") + f" SELECT '0/' || case_id AS case_id, {TEXT} AS trace FROM c1 UNION ALL SELECT '1/' || case_id, {TEXT} FROM c2")
def log_union(spark, sf_dir):
    return text(conversation_log(spark, sf_dir).union(day_log(spark, sf_dir)))


@query(DAY + f" SELECT case_id, {TEXT} AS trace, (ntile(7) OVER (ORDER BY case_id) - 1)::INT AS cluster FROM cases")
def balanced_clusters(spark, sf_dir):
    return cluster.balanced(day_log(spark, sf_dir), 7).withColumn("trace", F.concat_ws(",", "trace"))


@query(DAY + f""", s AS (SELECT DISTINCT case_id, unnest(trace) AS x FROM cases), n AS (SELECT x, count(*) AS n FROM s GROUP BY x),
pairs AS (SELECT l.x AS a, r.x AS b, l.n + r.n AS n FROM n l JOIN n r ON l.x < r.x WHERE NOT EXISTS (SELECT 1 FROM s p JOIN s q USING (case_id) WHERE p.x = l.x AND q.x = r.x)),
best AS (SELECT a, b FROM pairs ORDER BY n DESC, a, b LIMIT 1)
SELECT case_id, {TEXT} AS trace, CASE WHEN coalesce(list_contains(trace, a), false) THEN 0 WHEN coalesce(list_contains(trace, b), false) THEN 1 ELSE 2 END AS cluster FROM cases LEFT JOIN best ON true""")
def exclusive_clusters(spark, sf_dir):
    return cluster.exclusive(day_log(spark, sf_dir)).withColumn("trace", F.concat_ws(",", "trace"))


@query(DAY.replace("WITH", "WITH RECURSIVE", 1) + VARIANTS + ALPHABETS + f""", tree(path, node) AS (SELECT '', list({{'s': s, 'n': n}}) FROM sets UNION ALL
  SELECT path || e.side, e.node FROM (SELECT path, unnest([{{'side': '1', 'node': list_filter(node, lambda x: list_contains(x.s, best))}}, {{'side': '0', 'node': list_filter(node, lambda x: NOT list_contains(x.s, best))}}]) AS e
    FROM (SELECT path, node, list_sort(list_filter(list_transform(names, lambda a: {{'d': abs(list_sum(list_transform(list_filter(node, lambda x: list_contains(x.s, a)), lambda x: x.n)) - total // 2), 'a': a, 'c': list_sum(list_transform(list_filter(node, lambda x: list_contains(x.s, a)), lambda x: x.n))}}), lambda o: o.c < total))[1].a AS best
      FROM (SELECT path, node, list_sum(list_transform(node, lambda x: x.n)) AS total, list_distinct(flatten(list_transform(node, lambda x: x.s))) AS names FROM tree) WHERE total > 50)
    WHERE best IS NOT NULL)),
leaves AS (SELECT node, (row_number() OVER (ORDER BY path) - 1)::INT AS cluster FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree c WHERE c.path = t.path || '0')),
book AS (SELECT x.s AS s, cluster FROM (SELECT unnest(node) AS x, cluster FROM leaves))
SELECT case_id, {TEXT} AS trace, cluster FROM cases JOIN book ON list_sort(list_distinct(trace)) = s""")
def optional_clusters(spark, sf_dir):
    return cluster.optional(day_log(spark, sf_dir), 50).withColumn("trace", F.concat_ws(",", "trace"))


@query(DAY.replace("WITH", "WITH RECURSIVE", 1) + VARIANTS + ALPHABETS + f""", go(step, k, have, rest, got) AS (SELECT 0, 0, NULL::VARCHAR[], list(s ORDER BY len(s), s), []::STRUCT(s VARCHAR[], k INT)[] FROM sets UNION ALL
  SELECT step + 1, CASE WHEN have IS NOT NULL AND more IS NULL THEN k + 1 ELSE k END, CASE WHEN have IS NULL THEN rest[1] WHEN more IS NULL THEN NULL ELSE list_distinct(list_concat(have, more)) END, CASE WHEN have IS NULL THEN rest ELSE other END,
    CASE WHEN have IS NULL THEN got ELSE list_concat(got, list_transform(list_filter(rest, lambda x: list_has_all(have, x)), lambda x: {{'s': x, 'k': k}})) END
  FROM (SELECT *, list_sort(list_transform(list_filter(other, lambda x: len(list_distinct(list_concat(have, x))) <= 3), lambda x: {{'d': len(list_filter(x, lambda y: NOT list_contains(have, y))), 's': x}}))[1].s AS more
    FROM (SELECT *, list_filter(rest, lambda x: NOT list_has_all(have, x)) AS other FROM go WHERE have IS NOT NULL OR (len(rest) > 0 AND len(rest[1]) <= 3)))),
final AS (SELECT * FROM go ORDER BY step DESC LIMIT 1),
book AS (SELECT x.s AS s, x.k AS cluster FROM (SELECT unnest(list_concat(got, list_transform(rest, lambda x: {{'s': x, 'k': k}}))) AS x FROM final))
SELECT case_id, {TEXT} AS trace, cluster::INT AS cluster FROM cases JOIN book ON list_sort(list_distinct(trace)) = s""")
def max_alphabet_clusters(spark, sf_dir):
    return cluster.max_alphabet(day_log(spark, sf_dir), 3).withColumn("trace", F.concat_ws(",", "trace"))


@query()
def similarity_clusters(spark, sf_dir):
    return cluster.similar(conversation_log(spark, sf_dir)).withColumn("trace", F.concat_ws(",", "trace"))


@query()
def hierarchical_clusters(spark, sf_dir):
    merges = cluster.hierarchical(conversation_log(spark, sf_dir))
    return spark.createDataFrame(merges, "left int, right int, distance double, size int")


@query(CONV + VARIANTS + f" SELECT {TEXT} AS trace, occ::BIGINT AS occ, array_to_string(list_transform((SELECT list(x ORDER BY x) FROM (SELECT DISTINCT unnest(trace) AS x FROM cases)), lambda a: len(list_filter(trace, lambda x: x = a))), ',') AS vector FROM variants")
def parikh_vectors(spark, sf_dir):
    rows = cluster.parikh_vectors(conversation_log(spark, sf_dir))
    return rows.select(F.concat_ws(",", "trace").alias("trace"), "occ", F.array_join(F.col("vector").cast("array<string>"), ",").alias("vector"))


@query()
def noisy_log(spark, sf_dir):
    return text(noise.add_noise(day_log(spark, sf_dir), "single", 0.2, seed=5))


@query()
def noisy_log_maruster(spark, sf_dir):
    return text(noise.add_noise(day_log(spark, sf_dir), "maruster", 0.2, seed=5))


def _system(kind: str, tail: int, key: str):
    name = f"ts_{kind}" + (f"_tail{tail}" if tail else "")
    part = f"trace[greatest(i - {tail}, 0) + 1:i]" if tail else "trace[1:i]"
    nxt = f"trace[greatest(i + 1 - {tail}, 0) + 1:i + 1]" if tail else "trace[1:i + 1]"
    QUERIES[name] = lambda spark, sf_dir: ts.from_log(day_log(spark, sf_dir), kind, tail).edges
    SQL[name] = DAY + f", p AS (SELECT trace, unnest(range(len(trace))) AS i FROM cases) SELECT coalesce(array_to_string({key.format(part)}, ','), '') AS src, trace[i + 1] AS label, array_to_string({key.format(nxt)}, ',') AS dst, count(*) AS freq FROM p GROUP BY 1, 2, 3"


_system("seq", 0, "{0}")
_system("mset", 0, "list_sort({0})")
_system("set", 0, "list_sort(list_distinct({0}))")
_system("seq", 2, "{0}")


@query(DAY + f", p AS (SELECT trace, unnest(range(len(trace) + 1)) AS i FROM cases) SELECT array_to_string(list_sort(list_distinct(trace[1:i])), ',') AS state, count(*) AS freq FROM p GROUP BY 1")
def ts_state_visits(spark, sf_dir):
    log = day_log(spark, sf_dir)
    return ts.annotated(log, ts.from_log(log, "set")).states


@query(CONV + VARIANTS + ", top AS (SELECT trace FROM variants ORDER BY occ DESC, trace LIMIT 3), pre AS (SELECT DISTINCT trace[1:i] AS p FROM (SELECT trace, unnest(range(len(trace) + 1)) AS i FROM top)), m AS (SELECT c.trace, max(len(p)) AS k FROM (SELECT DISTINCT trace FROM cases) c JOIN pre ON p = c.trace[1:len(p)] GROUP BY 1), j AS (SELECT len(trace) AS n, k FROM cases JOIN m USING (trace)) SELECT count(*) FILTER (k = 0 AND n > 0) AS excluded, count(*) FILTER (k > 0 AND k < n) AS partial, count(*) FILTER (k = n) AS total, round(avg(k / n) FILTER (k > 0 AND k < n), 6) AS avg_partial FROM j")
def ts_inclusion(spark, sf_dir):
    log = conversation_log(spark, sf_dir)
    top = EventLog.from_variants(log.weighted().orderBy(F.desc("occ"), "trace").limit(3))
    return rounded(ts.inclusion(log, ts.from_log(top, "seq")))


@query(CONV + VARIANTS + TOP + """, pre AS (SELECT DISTINCT trace[1:i] AS p FROM (SELECT trace, unnest(range(len(trace) + 1)) AS i FROM top)),
m AS (SELECT c.trace, max(len(p)) AS k FROM (SELECT DISTINCT trace FROM cases) c JOIN pre ON p = c.trace[1:len(p)] GROUP BY 1),
g AS (SELECT array_to_string(trace[1:k], ',') AS trace, count(*) AS occ FROM cases JOIN m USING (trace) WHERE k > 0 GROUP BY 1)
SELECT trace || '#' || i AS case_id, trace FROM (SELECT trace, unnest(range(1, occ + 1)) AS i FROM g)""")
def ts_included_prefixes(spark, sf_dir):
    log = conversation_log(spark, sf_dir)
    top = EventLog.from_variants(log.weighted().orderBy(F.desc("occ"), "trace").limit(3))
    return text(ts.included(log, ts.from_log(top, "seq"), partial=True))


@query(RECURSIVE + STEPS + """, names AS (SELECT DISTINCT unnest(trace) AS x FROM cases),
subsets(s, last) AS (SELECT [x], x FROM names UNION ALL SELECT list_append(s, x), x FROM subsets JOIN names ON x > last),
free AS (SELECT s FROM subsets WHERE NOT EXISTS (SELECT 1 FROM ds WHERE list_contains(s, a) AND list_contains(s, b))),
causal AS (SELECT a, b FROM ds d WHERE NOT EXISTS (SELECT 1 FROM ds e WHERE e.a = d.b AND e.b = d.a)),
pairs AS (SELECT l.s AS p, r.s AS q FROM free l CROSS JOIN free r JOIN causal c ON list_contains(l.s, c.a) AND list_contains(r.s, c.b) GROUP BY 1, 2 HAVING count(*) = len(l.s) * len(r.s)),
maximal AS (SELECT p, q FROM pairs m WHERE NOT EXISTS (SELECT 1 FROM pairs o WHERE (o.p <> m.p OR o.q <> m.q) AND list_has_all(o.p, m.p) AND list_has_all(o.q, m.q))),
named AS (SELECT 'p' || (row_number() OVER (ORDER BY p, q) - 1) AS place, p, q FROM maximal)
SELECT unnest(p) AS src, place AS dst, 1::INT AS weight FROM named UNION ALL SELECT place, unnest(q), 1 FROM named
UNION ALL SELECT DISTINCT 'start', trace[1], 1 FROM cases UNION ALL SELECT DISTINCT trace[-1], 'end', 1 FROM cases""")
def alpha_net(spark, sf_dir):
    return discovery.alpha(conversation_log(spark, sf_dir)).arcs_df(spark)


@query()
def inductive_net(spark, sf_dir):
    return discovery.inductive(conversation_log(spark, sf_dir)).arcs_df(spark)


@query(FEW + _regions("top") + " SELECT CASE WHEN g > 0 THEN label ELSE place END AS src, CASE WHEN g > 0 THEN place ELSE label END AS dst, abs(g)::INT AS weight FROM cells WHERE g <> 0")
def region_net(spark, sf_dir):
    return discovery.net_from_ts(ts.from_log(frequent_log(spark, sf_dir), "set"), 1).arcs_df(spark)



@query(FEW + _regions("top") + """, vec AS (SELECT l.label, coalesce(list(g ORDER BY place) FILTER (g IS NOT NULL), []) AS g FROM (SELECT DISTINCT label FROM edges) l LEFT JOIN cells c ON c.label = l.label GROUP BY 1),
first AS (SELECT coalesce(list(list_contains(m, '')::INT ORDER BY place), []) AS mark FROM places),
run(trace, i, mark) AS (SELECT trace, 0, mark FROM variants CROSS JOIN first UNION ALL
  SELECT trace, i + 1, list_transform(list_zip(mark, g), lambda z: z[1] + z[2]) FROM run JOIN vec ON label = trace[i + 1] WHERE len(list_filter(list_zip(mark, g), lambda z: z[1] + z[2] < 0)) = 0),
fit AS (SELECT DISTINCT trace FROM run WHERE i = len(trace))
SELECT round(coalesce(sum(occ) FILTER (f.trace IS NOT NULL), 0) / sum(occ), 6) AS fitness FROM variants v LEFT JOIN fit f ON f.trace = v.trace""")
def net_fitness(spark, sf_dir):
    """All cases on the net of the most frequent ones."""
    return rounded(petri.fitness(day_log(spark, sf_dir), discovery.net_from_ts(ts.from_log(frequent_log(spark, sf_dir), "set"), 1)))


@query(FEW + _regions("top") + " SELECT place, max(list_contains(m, s)::INT)::INT AS capacity FROM places CROSS JOIN states GROUP BY 1")
def net_capacity(spark, sf_dir):
    log = frequent_log(spark, sf_dir)
    peaks = petri.compute_capacity(log, discovery.net_from_ts(ts.from_log(log, "set"), 1))
    return spark.createDataFrame(sorted(peaks.items()), "place string, capacity int")



@query()
def net_simulation(spark, sf_dir):
    return text(petri.simulate(spark, discovery.alpha(conversation_log(spark, sf_dir)), 200, 20, "bfs"))


@query()
def net_reachability(spark, sf_dir):
    return petri.reachability(spark, discovery.inductive(conversation_log(spark, sf_dir))).edges


@query()
def alignment_fitness(spark, sf_dir):
    log = conversation_log(spark, sf_dir)
    return rounded(discovery.alignment_fitness(log, discovery.inductive(log)))


@query(RECURSIVE + _regions("cases") + """, open AS (SELECT s, label FROM states CROSS JOIN (SELECT DISTINCT label FROM edges) l WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.label = l.label AND g < 0 AND NOT list_contains(m, s))),
may AS (SELECT s, list(label) AS allowed FROM open GROUP BY 1),
visits AS (SELECT trace[1:i] AS prefix, trace[i + 1] AS nxt FROM (SELECT trace, unnest(range(len(trace) + 1)) AS i FROM cases)),
per AS (SELECT prefix, count(*) AS n, coalesce(list(DISTINCT nxt) FILTER (nxt IS NOT NULL), []) AS used, coalesce(array_to_string(list_sort(list_distinct(prefix)), ','), '') AS s FROM visits GROUP BY prefix)
SELECT round(1 - sum(n * len(list_filter(allowed, lambda a: NOT list_contains(used, a)))) / sum(n * len(allowed)), 6) AS precision FROM per JOIN may USING (s)""")
def etc_precision(spark, sf_dir):
    log = conversation_log(spark, sf_dir)
    return rounded(discovery.etc_precision(log, discovery.net_from_ts(ts.from_log(log, "set"), 1)))


@query(CONV + STEPS + " SELECT 'in' AS side, b AS activity, a AS binding FROM ds UNION ALL SELECT 'out', a, b FROM ds")
def immediately_follows_cnet(spark, sf_dir):
    found = cnet.immediately_follows_bindings(conversation_log(spark, sf_dir))
    return found.select("side", "activity", F.array_join("binding", ",").alias("binding"))


@query()
def discovered_cnet(spark, sf_dir):
    net, _ = cnet.discover(filters.conditioned(conversation_log(spark, sf_dir)))
    return net.bindings_df(spark).withColumn("binding", F.array_join("binding", ","))


@query(RECURSIVE + VARIANTS + STEPS + """, arcs AS (SELECT a, b FROM ds WHERE 2 * n >= (SELECT avg(n) FROM ds)), ends AS (SELECT a, b FROM arcs UNION ALL SELECT NULL, NULL),
run(trace, i, open) AS (SELECT trace, 0, []::VARCHAR[] FROM variants UNION
  SELECT r.trace, r.i + 1, list_sort(list_concat(CASE WHEN c.a IS NULL THEN r.open ELSE list_concat(r.open[1:list_position(r.open, c.a || '>' || c.b) - 1], r.open[list_position(r.open, c.a || '>' || c.b) + 1:]) END, CASE WHEN p.a IS NULL THEN [] ELSE [p.a || '>' || p.b] END))
  FROM run r JOIN ends c ON (r.i = 0 AND c.a IS NULL) OR (r.i > 0 AND c.b = r.trace[r.i + 1] AND list_contains(r.open, c.a || '>' || c.b))
  JOIN ends p ON (r.i + 1 = len(r.trace) AND p.a IS NULL) OR (r.i + 1 < len(r.trace) AND p.a = r.trace[r.i + 1]) WHERE r.i < len(r.trace)),
fit AS (SELECT DISTINCT trace FROM run WHERE i = len(trace) AND len(open) = 0)
SELECT round(coalesce(sum(occ) FILTER (f.trace IS NOT NULL), 0) / sum(occ), 6) AS fitness FROM variants v LEFT JOIN fit f ON f.trace = v.trace""")
def cnet_fitness(spark, sf_dir):
    """A net of the more frequent steps, which not all cases fit."""
    log = conversation_log(spark, sf_dir)
    steps = relations.direct_succession(log)
    arcs = steps.join(F.broadcast(steps.agg(F.avg("n").alias("mean"))), F.col("n") * 2 >= F.col("mean")).collect()  # a row an arc
    net = cnet.Cnet.from_rows(x for r in arcs for x in (("in", r["b"], [r["a"]]), ("out", r["a"], [r["b"]])))
    return rounded(cnet.fitness(log, net))


@query(CONV + STEPS + ", d2 AS (SELECT a, b FROM ds WHERE n >= 20) SELECT round((SELECT count(*) FROM d2) / (SELECT count(*) FROM ds), 6) AS similarity")
def arc_similarity(spark, sf_dir):
    log = conversation_log(spark, sf_dir)
    some = relations.direct_succession(log).where("n >= 20").select(F.lit("in").alias("side"), F.col("b").alias("activity"), F.array("a").alias("binding"))
    return rounded(cnet.arc_similarity([cnet.immediately_follows_bindings(log), some]))


@query(CONV + STEPS + ", x AS (SELECT 'in' AS side, b AS act, a AS o, n FROM ds UNION ALL SELECT 'out', a, b, n FROM ds), s AS (SELECT side, act, count(*) FILTER (n >= 20) / count(*) AS s FROM x GROUP BY 1, 2) SELECT round(avg(s), 6) AS similarity FROM s")
def binding_similarity(spark, sf_dir):
    log = conversation_log(spark, sf_dir)
    keep = relations.direct_succession(log).where("n >= 20")
    every = cnet.immediately_follows_bindings(log)
    pairs = keep.select(F.lit("in").alias("side"), F.col("b").alias("activity"), F.array("a").alias("binding")).unionByName(keep.select(F.lit("out").alias("side"), F.col("a").alias("activity"), F.array("b").alias("binding")))
    return rounded(cnet.binding_similarity([every, pairs]))


@query(CONV + STEPS + ", c AS (SELECT count(*) AS arcs, (SELECT count(*) FROM (SELECT a FROM ds UNION SELECT b FROM ds)) AS acts FROM ds) SELECT round(3 * arcs / (acts + 2 * arcs), 6) AS simple, (acts + 5 * arcs)::INT AS overall, arcs::INT AS arcs, (2 * arcs)::INT AS bindings FROM c")
def cnet_complexity(spark, sf_dir):
    net = cnet.immediately_follows(conversation_log(spark, sf_dir))
    row = (net.simple_graph_complexity(), net.global_complexity(), len(net.arcs()), net.number_of_bindings())
    return rounded(spark.createDataFrame([row], "simple double, overall int, arcs int, bindings int"))


@query()
def etc_lower_bound(spark, sf_dir):
    log = filters.conditioned(conversation_log(spark, sf_dir))
    net, _ = cnet.discover(log)
    return spark.createDataFrame([(cnet.etc_lower_bound(net, ts.from_log(log, "seq")),)], "bound double")


@query()
def bpmn_model(spark, sf_dir):
    return bpmn.discovery(conversation_log(spark, sf_dir), frequencies=True)[0].edges_df(spark)


@query("WITH e AS (SELECT user_id::VARCHAR AS case_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS k FROM events WHERE event_type IN ('click', 'purchase')) SELECT a.case_id, 'visit' AS activity, a.ts AS start_ts, coalesce(b.ts, a.ts) AS end_ts FROM e a LEFT JOIN e b ON a.case_id = b.case_id AND a.k = b.k AND b.event_type = 'purchase' WHERE a.event_type = 'click'")
def paired_lifecycle(spark, sf_dir):
    """The k-th click of a user opens a visit, the k-th purchase closes it."""
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase"))
    state = F.when(F.col("event_type") == "click", "start").otherwise("complete")
    rows = e.select(F.col("user_id").cast("string").alias("case_id"), F.lit("visit").alias("activity"), "ts", state.alias("state"))
    return bpmn.paired(rows)
