"""Quality rules with risk-controlled cutoffs (DataFrame functions only).

Each rule scores a document; a higher score is worse.  Cutoffs come from a fixed
grid, so labelled documents are a pure holdout.  Rule sets (a cutoff for some of
the rules) are ordered into nested chains, each tighter than the one before.  For a
stratum and a rule set let n be the good documents and k those that it rejects.  The
set is certified if the exact binomial test rejects "more than alpha of the good
documents are lost": P(Bin(n, alpha) <= k) <= delta / (strata * chains), which is
the upper Clopper-Pearson bound in its dual form.  Along a chain the sets are tested
in turn at the same level up to the first that fails (fixed-sequence testing), so
only strata and chains share delta (Bonferroni).  A stratum takes the certified set
of the chain that came furthest; without one nothing is rejected but by the base
rule.  With probability 1 - delta no stratum loses more than alpha of its good
documents.

Even k = 0 needs some 290 good labelled documents in each of four strata.

Defined results: a null or empty text has no words and fails the base rule; a
null language counts as the empty one; a document with several labels is good
only if all are 1; unlabelled strata have no cutoffs; repeated rows are scored
alike and counted once for each; ties of chains go to the first; an empty table
gives no rows.  ``judge`` replaces columns that have the names of its own;
``quality_rules`` keeps all of the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CHARS, BLANKS, hinted, stored, table

SYMBOLS = "#*$%&|<>"
#: Scores are whole numbers, so that every engine compares them alike.
RULES = {
    "symbols": ("1000 * n_symbols", "n_words"),
    "dup_lines": ("1000 * n_dup_lines", "n_lines"),
    "long_words": ("1000 * word_chars", "n_words"),
    "repeats": ("1000 * n_repeat_words", "n_words"),
}
GRID = {
    "symbols": (10, 30, 100, 300),
    "dup_lines": (150, 250, 350, 500),
    "long_words": (7000, 8000, 9000, 10000),
    "repeats": (100, 150, 200, 250),
}
ALPHA, DELTA = 0.02, 0.05
#: Rules as the chains tighten them: what the base rule does not see comes first.
ORDER = ("symbols", "long_words", "dup_lines", "repeats")
#: Strata up to which their cutoffs (a row each) are broadcast.
MAX_BROADCAST = 10_000


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the base columns; every text whole, each row on its own, no shuffle.

    Each array is a column of its own, because a lambda evaluates what it
    refers to once for every element unless that is a column.
    """
    none = F.array().cast("array<int>")
    step = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    step = step.withColumn("_words", F.filter(F.split("_text", BLANKS), lambda w: w != ""))
    step = step.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.translate(x, BLANK_CHARS, "") != ""))
    n = F.size("_words") - 7
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(none)
    step = step.withColumn("_windows", F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, 8))))
    # only texts with a repeated window go on; the rest keep empty arrays
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    order = F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    step = step.withColumn("_order", F.when(some, order))
    same = lambda x, j: F.coalesce(F.get("_order", j)["w"] == x["w"], F.lit(False))
    step = step.withColumn("_twice", F.filter("_order", lambda x, j: same(x, j - 1) | same(x, j + 1)))
    step = step.withColumn("_at", F.array_sort(F.transform("_twice", lambda x: x["i"])))
    repeated = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("n"), F.lit(-8).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(8), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    return step.select(
        *[step[c] for c in docs.columns if c not in ADDED],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", BLANK_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeated, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def base_failed() -> Column:
    return F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")


def _exceeds(rule: str, cutoff: Column) -> Column:
    over, under = RULES[rule]
    return F.expr(over) > cutoff * F.expr(under)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed as logarithms from the term for 0."""
    step = F.struct
    first = n * F.log(F.lit(1.0 - p))
    odds = F.log(F.lit(p / (1.0 - p)))
    js = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))

    def add(s: Column, j: Column) -> Column:
        term = s["term"] + F.log((n - j + 1).cast("double") / j) + odds
        top, low = F.greatest(s["sum"], term), F.least(s["sum"], term)
        return step(term.alias("term"), (top + F.log1p(F.exp(low - top))).alias("sum"))

    return F.aggregate(js, step(first.alias("term"), first.alias("sum")), add, lambda s: F.exp(s["sum"]))


def _chains() -> list[list[dict[str, int]]]:
    """Nested rule sets (rule -> cutoff), the loosest first; chain c tightens the rules one by one from the c-th of ORDER on."""
    chains = []
    for c in range(len(ORDER)):
        held: dict[str, int] = {}
        chains.append([])
        for rule in ORDER[c:] + ORDER[:c]:
            for cut in sorted(GRID[rule], reverse=True):
                held = held | {rule: cut}
                chains[-1].append(held)
    return chains


def certified_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``_stratum`` and for each rule its cutoff or null; k grows along a chain, so the last set that passes is the one.

    The counts are partial sums on the way into one small row per stratum.
    """
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    held = measured.join(good.where("_quality = 1"), "doc_id")
    sound = ~base_failed()
    trials = []
    for c, chain in enumerate(_chains()):
        for at, cuts in enumerate(chain):
            lost = F.lit(False)
            for rule, cut in cuts.items():
                lost = lost | _exceeds(rule, F.lit(cut))
            trials.append((c, at, cuts, F.count_if(sound & lost).alias(f"k{c}_{at}")))
    counts = held.groupBy(stratum().alias("stratum")).agg(F.count_if(sound).alias("n"), *[t[3] for t in trials])
    total = counts.agg(F.count(F.lit(1)).alias("strata"))
    each = [
        F.struct(
            F.lit(at).alias("at"),
            F.lit(-c).alias("chain"),
            *[F.lit(cuts.get(r)).cast("int").alias(f"cut_{r}") for r in RULES],
            F.col(f"k{c}_{at}").alias("k"),
        )
        for c, at, cuts, _ in trials
    ]
    rows = counts.select("stratum", "n", F.explode(F.array(*each)).alias("t"))
    level = F.lit(delta) / (F.col("strata") * len(ORDER))
    passed = (
        rows.where(F.col("t.k") < F.col("n") * alpha)
        .withColumn("p", binomial_cdf(F.col("t.k"), F.col("n"), alpha))
        .crossJoin(F.broadcast(total))  # one row
        .where(F.col("p") <= level)
    )
    best = passed.groupBy("stratum").agg(F.max("t").alias("t"))
    return best.select(F.col("stratum").alias("_stratum"), *[F.col(f"t.cut_{r}").alias(f"cut_{r}") for r in RULES])


def stratum() -> Column:
    return F.coalesce(F.col("lang"), F.lit(""))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, text: bool = True) -> DataFrame:
    """``docs`` with the base columns, ``base_failed`` and ``kept``; without ``text`` if that is not wanted."""
    # measured once: the cutoffs read the numbers back, the verdicts all of it
    docs = docs.drop("base_failed", "kept")
    measured = stored(measures(docs) if text else measures(docs).drop("text"), "measured")
    cuts = hinted(stored(certified_cutoffs(measured, labels, alpha, delta), "cutoffs"), MAX_BROADCAST)
    with_cuts = measured.join(cuts, stratum() == F.col("_stratum"), "left")
    hit = F.lit(False)
    for r in RULES:
        hit = hit | F.coalesce(_exceeds(r, F.col(f"cut_{r}")), F.lit(False))
    # least() rather than "and": a conjunct on the left side alone would be pushed below the join and inlined
    kept = F.least((~base_failed()).cast("int"), (~hit).cast("int")) == 1
    return with_cuts.select(*[measured[c] for c in measured.columns], base_failed().alias("base_failed"), kept.alias("kept"))


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The kept rows of ``docs`` with their own columns."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", "lang")
    return judge(rows, labels, alpha, delta, text=False).where("kept").select("_row.*")


def op2_quality_rules(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = judge(docs, table(spark, sf_dir, "labels"), text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def judged_sql(documents: str = "documents", alpha: float = ALPHA, delta: float = DELTA) -> str:
    """DuckDB's form; the pipeline's SQL uses it too."""
    blanks = "[\\x20\\x09-\\x0D]+"
    over = lambda r, c: f"{RULES[r][0]} > {c} * {RULES[r][1]}"
    sets = [(c, at, cuts) for c, chain in enumerate(_chains()) for at, cuts in enumerate(chain)]
    lost = lambda cuts: " OR ".join(over(r, c) for r, c in cuts.items())
    counts = ", ".join(f"count(*) FILTER (NOT base_failed AND ({lost(cuts)})) AS k{c}_{at}" for c, at, cuts in sets)
    trials = ", ".join("{" + f"'at': {at}, 'chain': {c}, 'k': k{c}_{at}, " + ", ".join(f"'cut_{r}': {cuts.get(r, 'NULL::INTEGER')}" for r in RULES) + "}" for c, at, cuts in sets)
    term = f"lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha}) + (n - j) * ln({1 - alpha})"
    passed = f"t.k < n * {alpha} AND list_sum(list_transform(range(0, t.k + 1), lambda j: exp({term}))) <= {delta} / ((SELECT count(*) FROM counts) * {len(ORDER)})"
    cuts = ", ".join(f"t.cut_{r} AS cut_{r}" for r in RULES)
    hits = " OR ".join(f"coalesce({over(r, f'cut_{r}')}, false)" for r in RULES)
    return f"""
WITH split AS (
  SELECT *, coalesce(text, '') AS t, coalesce(lang, '') AS stratum,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{blanks}'), lambda w: w <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda w: regexp_replace(w, '{blanks}', '', 'g') <> '') AS ls
  FROM {documents}),
shingled AS (
  SELECT *, list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i+7], ' ')) AS win FROM split),
placed AS (
  SELECT doc_id, hash(t) AS h, unnest(win) AS w, unnest(range(1, len(win) + 1)) AS i
  FROM (SELECT DISTINCT doc_id, t, win FROM shingled WHERE len(list_distinct(win)) < len(win))),
twice AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, h, w) AS c FROM placed),
gaps AS (
  SELECT doc_id, h, least(8, i - coalesce(lag(i) OVER (PARTITION BY doc_id, h ORDER BY i), -8)) AS g FROM twice WHERE c > 1),
repeated AS (SELECT doc_id, h, sum(g)::BIGINT AS n FROM gaps GROUP BY ALL),
measured AS (
  SELECT s.*, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '{blanks}', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
  FROM shingled s LEFT JOIN repeated r ON s.doc_id IS NOT DISTINCT FROM r.doc_id AND hash(s.t) = r.h),
based AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM measured),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
counts AS (
  SELECT stratum, count(*) FILTER (NOT base_failed) AS n, {counts}
  FROM based JOIN good USING (doc_id) GROUP BY stratum),
trials AS (SELECT stratum, n, unnest([{trials}]) AS t FROM counts),
cuts AS (SELECT stratum, {cuts} FROM trials WHERE {passed}
  QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY t.at DESC, t.chain) = 1),
judged AS (
  SELECT b.*, NOT base_failed AND NOT ({hits}) AS kept
  FROM based b LEFT JOIN cuts USING (stratum))"""


QUERIES = {"op2_quality_rules": op2_quality_rules}
SQL = {
    "op2_quality_rules": judged_sql()
    + "\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"
}
