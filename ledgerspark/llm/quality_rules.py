"""Quality rules: learned decision lists emitted as ordered Spark conditional expressions.

Everything that touches documents is a DataFrame expression. Learning reads labelled statistics of at most
``max_labelled`` documents (those whose ids hash lowest, a documented bound), bins them at class-wise quantiles,
counts bin tuples in Spark and runs sequential covering over the counts: a rule grows one threshold at a time
by information gain, is pruned on held-back counts, and is kept while it stays precise.

Defined results: a null or blank text has no words, all statistics 0 and fails the base rule. Rows are judged
one by one, so repeated rows get equal verdicts. Labels that are null are ignored; of repeated labels of a
document the lowest counts. With no labels, or labels of one class, the list is empty and only the base rule
rejects. Columns of the input stay as they are; statistics that clash with one get a leading underscore.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RE, free_name, word_list

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Bound on the labelled documents that the list is fitted on.
MAX_LABELLED = 10_000


def repeated_words(words: str) -> str:
    """SQL for the number of words in windows of eight words that occur twice or more, first occurrence included.

    Windows are compared by 64-bit hash within one text. ``transform(array(x), y -> ...)[0]`` binds x once.
    """
    n = WINDOW
    return f"""
    transform(array({words}), w -> CASE WHEN size(w) <= {n} THEN 0L ELSE
      transform(array(transform(sequence(1, size(w) - {n - 1}), i -> xxhash64(slice(w, i, {n})))), h ->
        CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
          transform(array(sort_array(transform(h, (x, i) -> struct(x AS h, i AS p)))), s ->
            aggregate(
              sort_array(filter(transform(s, (e, i) -> CASE
                  WHEN i > 0 AND s[i - 1].h = e.h THEN e.p
                  WHEN i < size(s) - 1 AND s[i + 1].h = e.h THEN e.p END), p -> p IS NOT NULL)),
              struct(-{n} AS last, 0L AS n),
              (a, p) -> struct(p AS last, a.n + CAST(least({n}, p - a.last) AS BIGINT) AS n),
              a -> a.n))[0] END)[0] END)[0]"""


def statistics(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with the statistics of each text; names get ``prefix``, and underscores where docs has them already."""
    keep = [F.col(f"`{c}`") for c in docs.columns]
    name = {k: prefix + k for k in ("n_words", "word_chars", "n_symbols", "n_upper", "n_marks", "n_dup_lines", "n_repeat_words")}
    out = {k: free_name(docs, v) for k, v in name.items()}
    words, body, lines = (free_name(docs, x) for x in ("_words_", "_body_", "_lines_"))
    step = docs.select(
        *keep,
        word_list(F.col(f"`{text}`")).alias(words),
        F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), SPACE_RE, "").alias(body),
        F.filter(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(lines),
    )
    b = F.col(body)
    # One struct through a generator: filters on statistics stay above it, where each is computed once.
    return step.select(*keep, F.inline(F.array(F.struct(
        F.size(words).cast("long").alias(out["n_words"]),
        F.length(b).cast("long").alias(out["word_chars"]),
        (F.length(b) - F.length(F.translate(b, SYMBOLS, ""))).cast("long").alias(out["n_symbols"]),
        F.length(F.regexp_replace(b, r"\P{Lu}+", "")).cast("long").alias(out["n_upper"]),
        (F.length(b) - F.length(F.translate(b, "!?", ""))).cast("long").alias(out["n_marks"]),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias(out["n_dup_lines"]),
        F.expr(repeated_words(words)).alias(out["n_repeat_words"]),
    ))))


def signals(prefix: str = "") -> dict[str, Column]:
    """What rules put thresholds on: lengths and shares derived from the statistics."""
    c = lambda k: F.col(f"`{prefix}{k}`").cast("double")
    per = lambda a, b: F.coalesce(F.try_divide(c(a), c(b)), F.lit(0.0))
    return {
        "n_words": c("n_words"),
        "mean_chars": per("word_chars", "n_words"),
        "symbol_share": per("n_symbols", "word_chars"),
        "upper_share": per("n_upper", "word_chars"),
        "mark_share": per("n_marks", "n_words"),
        "dup_lines": c("n_dup_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    signal: str
    above: bool
    bin: int
    threshold: float

    def holds(self, bins: dict[str, int]) -> bool:
        return (bins[self.signal] >= self.bin) == self.above

    def column(self, cols: dict[str, Column]) -> Column:
        c = cols[self.signal]
        return c >= F.lit(self.threshold) if self.above else c < F.lit(self.threshold)


Rule = tuple[Condition, ...]


def reject_expression(rules: list[Rule], cols: dict[str, Column]) -> Column:
    """Number of the first rule that holds, counted from 1; 0 where none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column(cols)
        for c in rule[1:]:
            test = test & c.column(cols)
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


def _counts(table: list[tuple[dict, int, int]], rule: Rule) -> tuple[int, int]:
    bad = good = 0
    for bins, b, g in table:
        if all(c.holds(bins) for c in rule):
            bad, good = bad + b, good + g
    return bad, good


def _best(table: list[tuple[dict, int, int]], cuts: dict[str, list[float]]) -> tuple[float, Condition | None]:
    """The condition with the highest gain (bad rows kept, times bits of purity won); ties go to the first."""
    bad, good = sum(b for _, b, _ in table), sum(g for _, _, g in table)
    if not bad or not good:
        return 0.0, None
    base, best = math.log2(bad / (bad + good)), (0.0, None)
    for s, at in cuts.items():
        bad_at, good_at = [0] * (len(at) + 1), [0] * (len(at) + 1)
        for bins, b, g in table:
            bad_at[bins[s]] += b
            good_at[bins[s]] += g
        low_b = low_g = 0
        for k, t in enumerate(at, 1):
            low_b, low_g = low_b + bad_at[k - 1], low_g + good_at[k - 1]
            for above, b, g in ((True, bad - low_b, good - low_g), (False, low_b, low_g)):
                if b and (gain := b * (math.log2(b / (b + g)) - base)) > best[0] + 1e-9:
                    best = gain, Condition(s, above, k, t)
    return best


def cover(table: list[tuple[dict, bool, int, int]], cuts: dict[str, list[float]], precision: float, max_rules: int, max_conditions: int) -> list[Rule]:
    """Sequential covering over counted bin tuples (bins, held back for pruning, bad rows, good rows)."""
    rules: list[Rule] = []
    rest = table
    while len(rules) < max_rules:
        grow = [(x, b, g) for x, held, b, g in rest if not held]
        hold = [(x, b, g) for x, held, b, g in rest if held]
        rule: Rule = ()
        inside = grow
        while len(rule) < max_conditions and (c := _best(inside, cuts)[1]):
            rule += (c,)
            inside = [r for r in inside if c.holds(r[0])]
        if not rule:
            break
        worth = lambda r: (lambda b, g: (b - g) / (b + g) if b + g else -1.0)(*_counts(hold, r))
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        bad, good = _counts([(x, b, g) for x, _, b, g in rest], rule)
        if bad < 3 or bad < precision * (bad + good):
            break
        rules.append(rule)
        rest = [r for r in rest if not all(c.holds(r[0]) for c in rule)]
    return rules


def learn(docs: DataFrame, labels: DataFrame, *, max_labelled: int = MAX_LABELLED, precision: float = 0.97, max_rules: int = 8, max_conditions: int = 3) -> list[Rule]:
    """A decision list that rejects what the labels call quality 0."""
    sample = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("_q"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    cols = signals()
    facts = statistics(labelled).select(
        (F.col("_q") == 0).alias("bad"),
        (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).alias("held"),
        *[v.alias(k) for k, v in cols.items()],
    )
    facts = facts.persist()
    try:
        at = [i / 10 for i in range(11)]
        spread = facts.groupBy("bad").agg(*[F.percentile_approx(k, at, 1000).alias(k) for k in cols]).collect()
        if len(spread) < 2:
            return []
        cuts = {k: sorted({float(x) for r in spread for x in r[k]} | {float(r[k][-1]) * 1.0001 + 1e-9 for r in spread}) for k in cols}
        at_most = lambda k: lambda x: F.col(k) >= x
        bins = [F.size(F.filter(F.array(*map(F.lit, t)), at_most(k))).alias(k) for k, t in cuts.items()]
        counted = facts.select("bad", "held", *bins).groupBy("held", *cuts).agg(F.count_if("bad").alias("b"), F.count_if(~F.col("bad")).alias("g")).collect()
    finally:
        facts.unpersist()
    table = sorted(((tuple(r[k] for k in cuts), r["held"], r["b"], r["g"]) for r in counted))
    return cover([(dict(zip(cuts, x)), h, b, g) for x, h, b, g in table], cuts, precision, max_rules, max_conditions)


def judge(docs: DataFrame, rules: list[Rule], prefix: str = "") -> DataFrame:
    """docs with statistics, ``base_failed``, ``rule`` (the first that rejects, or 0) and ``kept``; all names get prefix."""
    c = lambda k: F.col(f"`{prefix}{k}`")
    out = statistics(docs, prefix=prefix)
    failed = (c("n_words") < 20) | (100 * c("n_repeat_words") > 30 * c("n_words"))
    out = out.withColumn(f"{prefix}base_failed", failed).withColumn(f"{prefix}rule", reject_expression(rules, signals(prefix)))
    return out.withColumn(f"{prefix}kept", ~c("base_failed") & (c("rule") == 0))
