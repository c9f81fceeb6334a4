"""Quality rules as a learned decision list, in Spark expressions only (operator 10).

Statistics of every text are Spark expressions.  A decision list is learned from
labelled statistics by sequential covering: a rule is a conjunction of thresholds; it
grows by the condition with the most information gain for the rejected class, is
pruned from its end on a held-back third of the labels, and is kept while it is
precise; the rows that it covers leave, and the next rule grows.  Counts come from
Spark aggregations over binned statistics, so only ``features x bins`` numbers reach
the driver in each step.  The list is emitted as one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._store import discard, freeze

#: Quantile bins of each statistic.
BINS = 24
#: A rule must be this precise for the rejected class, on the growing and the pruning rows, and cover so many.
LEAST_PRECISION = 0.9
LEAST_ROWS = 5

_BLANK = r"\x20\x09-\x0D"
BASE = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("words", "word_length", "symbol_share", "mark_share", "upper_share", "digit_share", "dup_line_share", "repeat_share", "distinct_share")


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and more) with n_words, the base counts and the features; the text and its parts are dropped.

    Every column comes from expressions inside the JVM.  Work that is used more than once
    is given a projection of its own, so that no lambda evaluates it anew; the result is
    frozen, so that what is built on it can't merge these projections again.  A null text
    has no words; further columns stay (but for those of the names added, which are
    replaced); no rows give no rows.
    """
    kept = [c for c in docs.columns if c not in ("text", "n_words", *BASE, *FEATURES)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = docs.select(*kept, text.alias("text")).select(
        *kept,
        F.regexp_extract_all("text", F.lit(f"[^{_BLANK}]+"), F.lit(0)).alias("w"),
        F.filter(F.split("text", "\n", -1), lambda line: line.rlike(f"[^{_BLANK}]")).alias("lines"),
        *(F.length(F.regexp_replace("text", f"[^{kinds}]+", "")).cast("long").alias(name) for name, kinds in (("n_symbols", "#*$%&|<>"), ("n_marks", "!?"), ("n_upper", "A-Z"), ("n_digits", "0-9"))),
    )
    counted = words.select(
        *kept,
        "n_symbols",
        "n_marks",
        "n_upper",
        "n_digits",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda word: F.xxhash64(word)).alias("h"),
    )
    # A hash of each window of five words, by its first word.
    windows = counted.select(
        *(c for c in counted.columns if c != "h"),
        F.size(F.array_distinct("h")).alias("n_distinct"),
        F.when(
            F.size("h") >= 5,
            F.expr("transform(sequence(0, size(h) - 5), i -> xxhash64(get(h, i), get(h, i + 1), get(h, i + 2), get(h, i + 3), get(h, i + 4)))"),
        ).alias("f"),
    )
    # Few texts have a window twice: only theirs are sorted together with their places.
    twice = windows.withColumn("sorted", F.sort_array("f"))
    twice = twice.withColumn("some", F.expr("exists(zip_with(slice(sorted, 2, greatest(size(sorted) - 1, 0)), slice(sorted, 1, greatest(size(sorted) - 1, 0)), (x, y) -> x = y), z -> z)")).drop("sorted")
    paired = twice.withColumn("p", F.when(F.coalesce("some", F.lit(False)), F.expr("sort_array(transform(f, (x, i) -> struct(x as f, i as i)))"))).drop("f", "some")
    again = paired.withColumn("a", F.expr("sort_array(transform(filter(p, (x, i) -> x.f = get(p, i + 1).f or x.f = get(p, i - 1).f), x -> x.i))")).drop("p")
    covered = again.withColumn("n_repeat_words", F.coalesce(F.expr("aggregate(a, struct(0L as n, -5 as last), (s, i) -> struct(s.n + least(5, i - s.last) as n, i as last), s -> s.n)"), F.lit(0).cast("long"))).drop("a")
    whole = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    found = covered.select(
        *kept,
        "n_words",
        *BASE,
        F.col("n_words").cast("double").alias("words"),
        (F.col("word_chars") / whole).alias("word_length"),
        *((F.col(n) / chars).alias(a) for n, a in (("n_symbols", "symbol_share"), ("n_marks", "mark_share"), ("n_upper", "upper_share"), ("n_digits", "digit_share"))),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / whole).alias("repeat_share"),
        (F.col("n_distinct") / whole).alias("distinct_share"),
    )
    return freeze(found, "statistics")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}"


Rule = tuple[Condition, ...]


def _both(rule: Rule) -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.column()
    return out


def _counts(rows: DataFrame, condition: Column | None = None) -> tuple[int, int]:
    """Rejected and all rows."""
    own = rows if condition is None else rows.where(condition)
    bad, n = own.agg(F.sum("bad"), F.count("*")).first()
    return int(bad or 0), n


def _gain(bad: int, n: int, bad_before: int, n_before: int) -> float:
    """Rejected rows that stay covered, times the bits won about each."""
    return bad * (math.log2(bad / n) - math.log2(bad_before / n_before)) if bad else -1.0


def _best_condition(rows: DataFrame, rule: Rule, edges: dict[str, list[float]], before: tuple[int, int]) -> tuple[float, Condition, tuple[int, int]] | None:
    """The condition with the most gain on the rows that ``rule`` covers, from one aggregation over binned features."""
    bins = [F.struct(F.lit(f).alias("f"), F.expr(" + ".join([f"int({f} > {e!r}D)" for e in edges[f]])).alias("bin"), F.col(f).alias("v")) for f in FEATURES if edges[f]]
    if not bins:
        return None
    cells = rows.where(_both(rule)).select("bad", F.explode(F.array(*bins)).alias("c")).groupBy("c.f", "c.bin").agg(F.sum("bad").alias("bad"), F.count("*").alias("n"), F.min("c.v").alias("least"), F.max("c.v").alias("most")).collect()
    best = None
    for f in FEATURES:
        own = {r["bin"]: (r["bad"], r["n"]) for r in cells if r["f"] == f}
        ends = {r["bin"]: (r["least"], r["most"]) for r in cells if r["f"] == f}
        total = [sum(v[k] for v in own.values()) for k in (0, 1)]
        low = [0, 0]
        for k, edge in enumerate(edges[f]):
            low = [low[i] + own.get(k, (0, 0))[i] for i in (0, 1)]
            for above, (bad, n) in ((False, tuple(low)), (True, (total[0] - low[0], total[1] - low[1]))):
                if n >= LEAST_ROWS and bad:
                    gain = _gain(bad, n, *before)
                    if best is None or gain > best[0] + 1e-9:
                        best = gain, Condition(f, above, _between(ends, k)), (bad, n)
    return best


def _between(ends: dict[int, tuple[float, float]], k: int) -> float:
    """The middle between the values at or below edge ``k`` and those above it."""
    below = [most for b, (_, most) in ends.items() if b <= k]
    above = [least for b, (least, _) in ends.items() if b > k]
    return (max(below) + min(above)) / 2 if below and above else max(below) if below else min(above) - 1.0


def _prune(rule: Rule, rows: DataFrame) -> Rule:
    """The start of the rule that is worth most on the pruning rows: rejected less kept, over all."""
    whole = [F.sum(F.when(_both(rule[: k + 1]), F.col(c))).alias(f"{c}{k}") for k in range(len(rule)) for c in ("bad", "one")]
    r = rows.withColumn("one", F.lit(1)).agg(*whole).first()
    worth = [((2 * (r[f"bad{k}"] or 0) - (r[f"one{k}"] or 0)) / r[f"one{k}"] if r[f"one{k}"] else -1.0) for k in range(len(rule))]
    return rule[: worth.index(max(worth)) + 1]


def learn(labelled: DataFrame) -> list[Rule]:
    """An ordered list of rejecting rules from ``labelled``: the features and ``bad`` (1: to be rejected, 0: to be kept).

    A rule grows until it covers rejected rows only or nothing gains; the list ends with
    the first rule that is too small or not precise enough.  No rows, or none to be
    rejected, give no rules; rows with a null ``bad`` count as kept.
    """
    split = F.pmod(F.xxhash64(*FEATURES), F.lit(3)) == 0
    rows = freeze(labelled.select(*FEATURES, F.coalesce(F.col("bad").cast("int"), F.lit(0)).alias("bad"), split.alias("pruning")), "labelled")
    share = [k / BINS for k in range(1, BINS)]
    found = rows.agg(*(F.percentile_approx(f, share, 1000).alias(f) for f in FEATURES), *(F.percentile_approx(F.when(F.col("bad") == 1, F.col(f)), share, 1000).alias(f"bad_{f}") for f in FEATURES), *(F.max(F.when(F.col("bad") == 0, F.col(f))).alias(f"most_{f}") for f in FEATURES)).first()
    edges = {f: sorted({*(found[f] or []), *(found[f"bad_{f}"] or []), *([found[f"most_{f}"]] if found[f"most_{f}"] is not None else [])}) for f in FEATURES}
    rules: list[Rule] = []
    while True:
        left = rows.where(~F.coalesce(_either(rules), F.lit(False)))
        growing, pruning = left.where("not pruning"), left.where("pruning")
        before = _counts(growing)
        if before[0] < LEAST_ROWS:
            break
        rule: Rule = ()
        while before[0] < before[1]:
            best = _best_condition(growing, rule, edges, before)
            if best is None or best[0] <= 0:
                break
            rule, before = (*rule, best[1]), best[2]
        if not rule:
            break
        rule = _prune(rule, pruning)
        bad, n = _counts(left, _both(rule))
        held_bad, held = _counts(pruning, _both(rule))
        if n < LEAST_ROWS or bad < LEAST_PRECISION * n or held_bad < LEAST_PRECISION * held:
            break
        rules.append(rule)
    discard(labelled.sparkSession, rows.frozen)
    return rules


def _either(rules: list[Rule]) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | _both(rule)
    return out


def fired_rule(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null where none does: the list as an ordered conditional expression."""
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(_both(rules[0]), F.lit(1))
    for k, rule in enumerate(rules[1:], 2):
        out = out.when(_both(rule), F.lit(k))
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The base counts of each row of ``docs`` (doc_id, text), and whether it is kept, by rules learned from ``labels`` (doc_id, quality).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept and rule (the number of the rule that rejected it).  A null text has
    no words and fails the base rules.  Rows that fail them are not learned from; labels
    with a null id or quality, and of unknown documents, are left out; of a document's
    several labels the least quality counts; no labels give no rules, and what passes the
    base rules is kept.  Further columns are ignored; repeated rows get a row each.
    """
    stats = statistics(docs.select(F.col("doc_id").cast("long"), "text"))
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    labelled = stats.where(~base_failed()).join(known, "doc_id").withColumn("bad", (F.col("quality") == 0).cast("int"))
    rules = learn(labelled)
    failed = base_failed()
    return stats.select("doc_id", "n_words", *BASE, failed.alias("base_failed"), (~failed & fired_rule(rules).isNull()).alias("kept"), F.when(~failed, fired_rule(rules)).alias("rule"))
