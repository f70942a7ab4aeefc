"""Quality by weak supervision, in DataFrame operations.

Rules look at a document's counts and vote good, bad or nothing. Rules on one property (size, symbols, repetition, capitals)
depend on each other, so their votes count as one joint vote. A document is good or junk of one of at most `KINDS` kinds, and how often each
joint vote is cast for each of these is estimated by expectation-maximisation, without labels, until the likelihood
stands still; a document is kept if the posterior probability that it is good reaches `KEEP`. EM learns from all documents that
pass the base limits, as only these are judged; p_good of the others is what it makes of their votes. As a document matters only by
its votes, EM runs over the table of vote patterns (at most 3 ** rules rows), which Spark counts.

EM starts from documents with at most one bad vote as good ones, and from the most frequent patterns in which two rules or more
vote bad, and that share at most half of their bad votes, as kinds of junk; others start as the kind whose bad votes they
share. What it finds may differ: a property's bad votes count as they turn out to be right. `PRIOR` documents of each class,
with all votes alike, keep chances off zero.

Null text has no words. Texts below the base limits (too few words, too many repeated ones) are never kept. Repeated
rows are judged alike, and each counts. Columns of the input other than those asked for are not read. An empty table gives an empty table.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table

KEEP, WINDOW = 0.5, 5
KINDS, PRIOR, ROUNDS, STILL = 3, 1.0, 1000, 1e-9
_SPACE = " \t\n\x0b\f\r"
_GAPS = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: name -> (votes bad, votes good); neither is an abstention. Counts are those of `counted`.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words < 10", "n_words between 40 and 100000"),
    "word_size": ("word_chars < 2.5 * n_words or word_chars > 14 * n_words", "word_chars between 3 * n_words and 11 * n_words"),
    "variety": ("10 * n_distinct < 3 * least(n_words, 200)", "10 * n_distinct >= 5 * least(n_words, 200)"),
    "symbols": ("20 * n_symbols > n_words", "false"),
    "symbol_share": ("100 * n_symbols > 3 * word_chars", "false"),
    "lines": ("10 * n_dup_lines > 3 * n_lines", "false"),
    "repeats": ("20 * n_repeat_words > n_words", "false"),
    "capitals": ("10 * n_capitals > 3 * word_chars", "false"),
    "exclaims": ("10 * n_exclaims > n_words", "false"),
}

#: The property that each rule looks at; a rule without one votes alone.
PROPERTIES = {"length": "size", "word_size": "size", "symbols": "symbols", "symbol_share": "symbols", "variety": "repetition", "lines": "repetition", "repeats": "repetition", "capitals": "capitals", "exclaims": "capitals"}


def _without(text: str | Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep and the counts of each text, in three projections; repeated windows are sought only where any window repeats."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<string>")
    bare = F.btrim(F.col("_t"), F.lit(_SPACE))
    a = docs.select(*keep, text.alias("_t"))
    a = a.select(*keep, "_t", F.when(bare == "", none).otherwise(F.split(bare, _GAPS)).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "").alias("_l"))
    b = a.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        (F.length("_t") - F.length(_without("_t", _SPACE))).alias("_gaps"),
        F.length("_t").alias("_n"),
        (F.length("_t") - F.length(_without("_t", _SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("_t") - F.length(_without("_t", _CAPITALS))).cast("long").alias("n_capitals"),
        (F.length("_t") - F.length(_without("_t", "!"))).cast("long").alias("n_exclaims"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_l")).cast("long").alias("_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        F.when(F.size("_w") >= WINDOW, F.expr(f"transform(sequence(0, size(_w) - {WINDOW}), i -> xxhash64({', '.join(f'_w[i + {k}]' for k in range(WINDOW))}))")).otherwise(F.array().cast("array<bigint>")).alias("_g"),
    )
    counts = ["n_words", "n_symbols", "n_capitals", "n_exclaims", "n_lines", "n_distinct"]
    c = b.select(*keep, *counts, (F.col("_n") - F.col("_gaps")).cast("long").alias("word_chars"), (F.col("n_lines") - F.col("_lines")).alias("n_dup_lines"), F.expr("if(size(array_distinct(_g)) = size(_g), cast(array() as array<struct<h: bigint, i: int>>), array_sort(transform(_g, (h, i) -> struct(h, i))))").alias("_s"))
    counts += ["word_chars", "n_dup_lines"]
    d = c.select(*keep, *counts, F.expr("array_sort(transform(filter(_s, (x, k) -> coalesce(x.h = get(_s, k - 1).h, false) or coalesce(x.h = get(_s, k + 1).h, false)), x -> x.i))").alias("_p"))
    covered = f"aggregate(transform(_p, (p, k) -> least({WINDOW}, coalesce(get(_p, k + 1) - p, {WINDOW}))), 0L, (s, x) -> s + x)"
    return d.select(*keep, *counts, F.expr(covered).alias("n_repeat_words"))


def votes(counts: DataFrame, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """counts and one vote for each rule: 1 good, -1 bad, 0 abstains."""
    return counts.withColumns({f"vote_{r}": F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for r, (bad, good) in rules.items()})


Pattern = tuple[int, ...]


def seeds(patterns: list[tuple[Pattern, int]], kinds: int = KINDS) -> list[Pattern]:
    """Frequent patterns in which rules confirm each other's bad votes, unlike each other."""
    chosen: list[Pattern] = []
    for p, n in sorted(patterns, key=lambda x: (-x[1], x[0])):
        bad = {r for r, v in enumerate(p) if v < 0}
        others = [{r for r, v in enumerate(q) if v < 0} for q in chosen]
        if n and len(bad) > 1 and len(chosen) < kinds and all(2 * len(bad & o) <= len(bad | o) for o in others):
            chosen.append(p)
    return chosen


def together(rules: list[str]) -> list[list[int]]:
    """Places of the rules that vote as one."""
    groups: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        groups.setdefault(PROPERTIES.get(r, r), []).append(i)
    return list(groups.values())


def beginning(patterns: list[tuple[Pattern, int]], start: list[Pattern]) -> dict[Pattern, list[float]]:
    """Membership in good (0) and the kinds of junk that EM starts from."""
    bad = lambda p: {r for r, v in enumerate(p) if v < 0}
    nearest = lambda p: 1 + max(range(len(start)), key=lambda j: len(bad(p) & bad(start[j])) / len(bad(p) | bad(start[j])))
    own = {p: nearest(p) if len(bad(p)) > 1 else 0 for p, _ in patterns}
    return {p: [float(c == k) for c in range(len(start) + 1)] for p, k in own.items()}


def estimate(patterns: list[tuple[Pattern, int]], groups: list[list[int]], rounds: int = ROUNDS) -> dict[Pattern, float]:
    """Posterior probability of good for each vote pattern (votes, documents to learn from), by EM over the classes good and kinds of junk."""
    start = seeds(patterns)
    if not start:
        return {p: 1.0 for p, _ in patterns}
    classes, total = range(len(start) + 1), sum(n for _, n in patterns)
    member, before = beginning(patterns, start), None
    joint = {p: [(i, *(p[r] for r in g)) for i, g in enumerate(groups)] for p, _ in patterns}
    least = [PRIOR / 3 ** len(g) for g in groups]
    for _ in range(rounds):
        size = [sum(member[p][c] * n for p, n in patterns) for c in classes]
        share = [log((size[c] + PRIOR) / (total + PRIOR * len(classes))) for c in classes]
        cast = [{v: least[v[0]] for p, _ in patterns for v in joint[p]} for _ in classes]
        for p, n in patterns:
            for c in classes:
                for v in joint[p]:
                    cast[c][v] += member[p][c] * n
        logs = [{v: log(x / (size[c] + PRIOR)) for v, x in cast[c].items()} for c in classes]
        likely = 0.0
        for p, n in patterns:
            each = [share[c] + sum(logs[c][v] for v in joint[p]) for c in classes]
            most = max(each)
            whole = sum(exp(x - most) for x in each)
            likely += n * (most + log(whole))
            member[p] = [exp(x - most) / whole for x in each]
        if before is not None and abs(likely - before) <= STILL * abs(before):
            break
        before = likely
    return {p: member[p][0] for p, _ in patterns}


def judged(docs: DataFrame, keep: list[str], rules: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """keep, the counts, votes, base_failed, p_good and kept of every document."""
    rules = rules or RULES
    names = [f"vote_{r}" for r in rules]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    voted = saved(votes(counted(docs, keep), rules).withColumn("base_failed", failed))
    seen = voted.groupBy(*names).agg(F.count_if(~F.col("base_failed")).alias("n")).orderBy(*names).collect()  # at most 3 ** len(rules) rows
    posterior = estimate([(tuple(r[n] for n in names), r["n"]) for r in seen], together(list(rules)))
    spark = docs.sparkSession
    table_ = spark.createDataFrame([(*p, v) for p, v in posterior.items()], ", ".join([*(f"{n} int" for n in names), "p_good double"]))
    return voted.join(F.broadcast(table_), names).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


QUERIES = {"op4_quality": op4_quality}
ORACLES: dict[str, str] = {}
