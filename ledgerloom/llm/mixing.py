"""Sources mixed to target shares of the tokens (problem 9).

Rates of documents are those nearest to one, in relative entropy, under one
constraint a source: its tokens are its share of the whole.  They are an
exponential tilt of the number of tokens, cut at the source's cap.  The dual is
convex; Newton's method, kept within the bounds seen so far, solves it, each
step one distributed aggregation of sums over the documents.  The rates are
rounded into copies by a threshold on each document's own random number, which a
histogram of tokens over those numbers sets so that the sum comes out right.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tokens import count_tokens
from ledgerloom.session import bounded, small_batches, written

STEPS, CLOSE = 100, 1e-6
BUCKETS = 4096


def source_key(source: Column) -> Column:
    """A source's name without case and outer blanks."""
    return F.lower(F.trim(source))


def budgets(tokens: dict[str, float], shares: dict[str, float], caps: dict[str, float]) -> dict[str, float]:
    """Tokens each source is to give, so that the sum stays that of the corpus.

    A source whose cap or emptiness keeps it below its share gives all it can;
    what is missing is spread over the others by their shares.
    """
    whole, most = sum(tokens.values()), {s: caps[s] * tokens.get(s, 0.0) for s in shares}
    full: set[str] = set()
    while True:
        open_ = [s for s in shares if s not in full]
        left = whole - sum(most[s] for s in full)
        total = sum(shares[s] for s in open_)
        now = {s: left * shares[s] / total if total > 0 else 0.0 for s in open_}
        over = {s for s in open_ if now[s] > most[s]}
        if not over:
            return {s: most[s] for s in full} | now
        full |= over


def _rates(b: Column, x: Column, cap: Column) -> Column:
    return F.when(b.isNull(), cap).otherwise(F.least(cap, F.exp(b * x)))


def tilt(docs: DataFrame, goal: dict[str, float], caps: dict[str, float]) -> tuple[dict[str, tuple[float | None, float]], int]:
    """Per source ``(beta, mean)`` of the rates ``min(cap, exp(beta * tokens / mean))``, and the Newton steps taken.

    ``docs(key, n_tokens, n)`` holds documents of equal source and size once,
    with their number.  What comes to the driver is two sums a source.  A source
    that gives all it can has no beta: its rates are the cap.
    """
    spark = docs.sparkSession
    base = {r["key"]: (float(r["t"] or 0), float(r["n"])) for r in docs.groupBy("key").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("t"), F.sum("n").alias("n")).collect()}
    live = {s: v for s, v in base.items() if s in goal and v[0] > 0 and goal[s] > 0}
    full = {s for s in live if goal[s] >= caps[s] * live[s][0] * (1 - 1e-9)}
    state = {s: (None if s in full else 0.0, t / n) for s, (t, n) in live.items()}
    bounds = {s: (-math.inf, math.inf) for s in live}
    open_, steps = set(live) - full, 0
    while open_:
        at = bounded(spark.createDataFrame([(s, *state[s], float(caps[s])) for s in sorted(open_)], "key string, b double, mean double, cap double"))
        x = F.col("n_tokens") / F.col("mean")
        rate = _rates(F.col("b"), x, F.col("cap"))
        free = F.when(rate < F.col("cap"), rate).otherwise(0.0)
        # in units of the mean length; no overflow, as rates end at the cap
        sums = docs.join(at, "key").groupBy("key").agg(F.sum(F.col("n") * rate * x).alias("t"), F.sum(F.col("n") * free * x * x).alias("h")).collect()
        for r in sums:
            s = r["key"]
            b, mean = state[s]
            want = goal[s] / mean
            gap = want - r["t"]
            if abs(gap) < CLOSE * want:
                open_.discard(s)
                continue
            low, high = bounds[s] = (b, bounds[s][1]) if gap > 0 else (bounds[s][0], b)
            new = b + gap / r["h"] if r["h"] > 0 else math.nan
            if not low < new < high:
                new = (low + high) / 2 if math.isfinite(low + high) else b + math.copysign(1 + abs(b), gap)
            state[s] = (new, mean)
        if open_ and steps == STEPS:
            raise RuntimeError(f"rates of {sorted(open_)} did not reach their tokens in {STEPS} steps")
        steps += bool(open_)
    return state, steps


def mixed(documents: DataFrame, targets: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, source, n_tokens, rate, copies)`` of every document.

    ``source`` is the target's writing.  Documents of a source without a target,
    or without a source, have rate and copies 0; so have those without tokens of
    a source that gives nothing.  No document is taken more than ``max_repeats``
    times.  The targets are a parameter table: they come to the driver.
    """
    spark = documents.sparkSession
    target = {r["key"]: r for r in targets.select(source_key(F.col("source")).alias("key"), "source", "target_share", "max_repeats").collect() if r["key"] is not None}
    with small_batches(spark):
        counted = written(count_tokens(documents.select("doc_id", source_key(F.col("source")).alias("key"), "text"), vocabulary), "mix-tokens")
    sizes = written(counted.groupBy("key", "n_tokens").agg(F.count("*").alias("n")), "mix-sizes")
    tokens = {r["key"]: float(r["t"] or 0) for r in sizes.groupBy("key").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("t")).where(F.col("key").isin(*target) | F.lit(False)).collect()} if target else {}
    whole = float(counted.agg(F.sum("n_tokens")).first()[0] or 0)
    shares, caps = {s: float(r["target_share"]) for s, r in target.items()}, {s: float(r["max_repeats"]) for s, r in target.items()}
    goal = budgets(tokens | {"": whole - sum(tokens.values())}, shares, caps) if target else {}
    state, _ = tilt(sizes.where(F.col("key").isNotNull()), goal, caps)
    rows = [(s, target[s]["source"], *state[s], caps[s], goal[s]) for s in state]
    at = bounded(spark.createDataFrame(rows, "key string, source_name string, b double, mean double, cap double, goal double"))
    rate = F.when(F.col("cap").isNull(), 0.0).otherwise(_rates(F.col("b"), F.col("n_tokens") / F.col("mean"), F.col("cap")))
    unit = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("mix")), F.lit(1 << 40)) / float(1 << 40)).alias("u")
    drawn = counted.join(at, "key", "left").select("doc_id", "key", "source_name", "n_tokens", rate.alias("rate"), "goal", unit).withColumn("part", F.col("rate") - F.floor("rate"))
    # documents whose part exceeds their number by most come first: a threshold a source on that excess
    excess = F.floor((F.col("u") - F.col("part") + 1) * (BUCKETS / 2)).cast("int")
    histogram = drawn.where("goal is not null").withColumn("bucket", excess).groupBy("key", "bucket").agg(F.sum(F.when(F.col("part") > 0, F.col("n_tokens")).otherwise(0)).alias("t"), F.sum(F.floor("rate") * F.col("n_tokens")).alias("whole"), F.first("goal").alias("goal")).collect()
    cut: dict[str, int] = {}
    for s in {r["key"] for r in histogram}:
        mine = sorted((r["bucket"], r["t"], r["whole"], r["goal"]) for r in histogram if r["key"] == s)
        left = mine[0][3] - sum(x[2] for x in mine)
        cut[s], best_gap, seen = -1, abs(left), 0.0
        for bucket, t, _, _ in mine:
            seen += t
            if abs(left - seen) < best_gap:
                cut[s], best_gap = bucket, abs(left - seen)
    limit = bounded(spark.createDataFrame(list(cut.items()), "key string, cut int"))
    copies = F.coalesce(F.floor("rate") + F.when((F.col("part") > 0) & (excess <= F.col("cut")), 1).otherwise(0), F.lit(0)).cast("int")
    return drawn.join(limit, "key", "left").select("doc_id", F.coalesce("source_name", "key").alias("source"), "n_tokens", "rate", copies.alias("copies"))


def report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, reached_share, documents, tokens_before, tokens_after)``, a row a source of either side."""
    by = mix.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens_before"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_after"))
    total = by.agg(F.sum("tokens_after").alias("all"))
    wanted = targets.select("source", "target_share")
    return by.join(bounded(wanted), "source", "full").crossJoin(F.broadcast(total)).select("source", "target_share", F.coalesce(F.col("tokens_after") / F.when(F.col("all") > 0, F.col("all")), F.lit(0.0)).alias("reached_share"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens_before", "tokens_after")))
