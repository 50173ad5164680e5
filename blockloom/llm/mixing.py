"""Mixing sources to target weights, each text used at most a capped number of times (problem 9).

Method: subset-sum budget fitting.  The total is the largest that all sources can meet (or a given one); a source's
budget is its share of it.  Whole rounds over all texts of the source come first.  What remains is filled with single
texts: texts fall into buckets by a seeded hash; whole buckets are taken as long as they fit; the bucket where that
ends is divided again in the same way until it holds few texts; those are counted by exact token length, drawn from the
counts while more than twice the longest text is missing, and the rest is fitted by a bounded-knapsack program over the
remaining counts, whatever its size.  The texts are then selected by length count, in seeded order.

A text is used by one source only, that of its least doc_id, so no text is used more often than allowed, whatever ids it
was posted under.  On the driver are only sums per (source, bucket) and counts per (source, length) of one bucket.

Defined results: null and empty texts have no tokens and are not chosen; sources without a target, with share 0 or
without texts get nothing and are reported with what they are; the shares that can't be met (a given total beyond the
caps) are cut to the cap; repeated doc_ids count once; ties go by hash, then doc_id.
"""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm import tokens
from blockloom.tables import ensure_checkpoint_dir

#: Texts of a bucket, about; the most texts of the last bucket, and buckets of a source at one level; how often a bucket is
#: divided; tokens fitted exactly, if twice the longest text isn't more.
BUCKET_TEXTS, MOST_TEXTS, MOST_BUCKETS, MOST_LEVELS, WINDOW = 2000, 8000, 1 << 12, 5, 1 << 14
SEED = 17


def sized_texts(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, n_tokens, place): each distinct text once, with its owner; place is its seeded order."""
    rows = documents.where("text is not null and text <> '' and doc_id is not null").select("doc_id", "source", F.sha2("text", 256).alias("hash"), "text")
    counted = tokens.count(rows, path, ["doc_id", "source", "hash"])
    own = counted.groupBy("hash").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("own"))
    return own.select("own.*", F.xxhash64(F.lit(SEED), "hash").alias("place")).where("n_tokens > 0")


def fill(target: int, counts: dict[int, int]) -> dict[int, int]:
    """How many of each length to take so that their sum is as near below the target as can be (bounded knapsack).

    For each sum the step that reached it first is kept; following the steps back gives the texts."""
    first, steps = np.full(target + 1, -1, np.int32), [(0, 0)]
    first[0] = 0
    for length, n in sorted(counts.items(), reverse=True):
        if length > target:
            continue
        n, k = min(n, target // length), 1
        while n > 0:
            take = min(k, n)
            far = length * take
            new = np.flatnonzero((first[: target + 1 - far] >= 0) & (first[far:] < 0)) + far
            if len(new):
                first[new] = len(steps)
                steps.append((length, take))
            n, k = n - take, 2 * k
        if first[target] >= 0:
            break
    at, out = int(np.flatnonzero(first >= 0)[-1]), defaultdict(int)
    while at:
        length, take = steps[first[at]]
        out[length] += take
        at -= length * take
    return dict(out)


def draw(target: int, counts: dict[int, int], seed: str) -> dict[int, int]:
    """Lengths drawn at random while more is missing than twice the longest (and WINDOW); what is missing then is fitted."""
    lengths = [x for x, n in sorted(counts.items()) for _ in range(n)]  # a bucket holds at most MOST_TEXTS texts, or all of one hash
    random.Random(seed).shuffle(lengths)
    left, taken, room, window = dict(counts), defaultdict(int), target, max(WINDOW, 2 * max(counts, default=0))
    for x in lengths:
        if room - x < window:
            break
        taken[x] += 1
        left[x] -= 1
        room -= x
    for x, n in fill(min(room, sum(x * n for x, n in left.items())), left).items():
        taken[x] += n
    return dict(taken)


def budgets(total: int, shares: dict[str, float]) -> dict[str, int]:
    """Whole budgets by the largest remainder."""
    raw = {s: total * x for s, x in shares.items()}
    out = {s: int(x) for s, x in raw.items()}
    missing = min(len(raw), max(0, round(sum(raw.values())) - sum(out.values())))
    for s in sorted(raw, key=lambda s: (out[s] - raw[s], s))[:missing]:
        out[s] += 1
    return out


def mix(documents: DataFrame, targets: DataFrame, path: str, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The chosen texts (doc_id, source, n_tokens, repeats), and the shares
    (source, target_share, max_repeats, budget_tokens, actual_tokens, actual_share)."""
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    texts = sized_texts(documents, path).checkpoint()
    goals = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect()}  # the fixed table of sources
    ours = texts.where(F.col("source").isin(list(goals)))
    size = {r.source: (r.n, r.t) for r in ours.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}
    live = {s: g for s, g in goals.items() if g[0] > 0 and g[1] > 0 and s in size}
    most = min((int(g[1] * size[s][1] / g[0]) for s, g in live.items()), default=0)
    want = budgets(most if total_tokens is None else total_tokens, {s: g[0] for s, g in live.items()})
    want = {s: min(b, live[s][1] * size[s][1]) for s, b in want.items()}
    rounds = {s: b // size[s][1] for s, b in want.items()}
    rest = {s: b - rounds[s] * size[s][1] for s, b in want.items()}

    # Whole buckets are taken while they fit; the bucket where that ends is divided again until few texts are left in it.
    plan = spark.createDataFrame([(s, rounds[s]) for s in live], "source string, rounds bigint")
    placed = ours.join(F.broadcast(plan), "source").withColumn("whole", F.lit(False)).withColumn("open", F.lit(True))  # at most one row a source
    at_edge, level = {s: size[s][0] for s in live}, 0
    while level == 0 or any(n > MOST_TEXTS for n in at_edge.values()) and level < MOST_LEVELS:
        n_buckets = {s: max(1, min(MOST_BUCKETS, at_edge[s] // BUCKET_TEXTS)) for s in live}
        levels = spark.createDataFrame([(s, n_buckets[s]) for s in live], "source string, buckets int")
        rows = placed.join(F.broadcast(levels), "source").withColumn("bucket", F.pmod(F.xxhash64(F.lit(level), "place"), "buckets").cast("int"))
        sums: dict[str, dict[int, tuple[int, int]]] = defaultdict(dict)
        for r in rows.where("open").groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).toLocalIterator():
            sums[r.source][r.bucket] = r.t, r.n
        edge: dict[str, int] = {}
        for s in live:
            b = 0
            while b < n_buckets[s] and sums[s].get(b, (0, 0))[0] <= rest[s]:
                rest[s] -= sums[s].get(b, (0, 0))[0]
                b += 1
            edge[s], at_edge[s] = b, sums[s].get(b, (0, 0))[1]
        edges = spark.createDataFrame([(s, edge[s]) for s in live], "source string, edge int")
        rows = rows.join(F.broadcast(edges), "source")
        placed = rows.withColumn("whole", F.col("whole") | F.col("open") & (F.col("bucket") < F.col("edge"))).withColumn("open", F.col("open") & (F.col("bucket") == F.col("edge"))).drop("buckets", "bucket", "edge")
        level += 1
    at_edge = placed.where("open")
    counts: dict[str, dict[int, int]] = defaultdict(dict)
    for r in at_edge.groupBy("source", "n_tokens").agg(F.count("*").alias("n")).toLocalIterator():
        counts[r.source][r.n_tokens] = r.n
    picks = [(s, x, n) for s in live for x, n in draw(rest[s], counts[s], f"{SEED}/{s}").items()]
    chosen = spark.createDataFrame(picks, "source string, n_tokens bigint, take bigint")
    order = Window.partitionBy("source", "n_tokens").orderBy("place", "doc_id")
    extra = at_edge.join(F.broadcast(chosen), ["source", "n_tokens"]).withColumn("k", F.row_number().over(order)).where("k <= take").select("doc_id", F.lit(1).alias("extra"))
    once = placed.join(extra, "doc_id", "left")
    repeats = F.col("rounds") + F.when(F.col("whole"), 1).otherwise(F.coalesce("extra", F.lit(0)))
    mixed = once.select("doc_id", "source", "n_tokens", repeats.cast("bigint").alias("repeats")).where("repeats > 0")

    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("actual_tokens"))
    budget = spark.createDataFrame([(s, *goals[s], want.get(s, 0)) for s in goals], "source string, target_share double, max_repeats int, budget_tokens bigint")
    shares = budget.join(got, "source", "left").withColumn("actual_tokens", F.coalesce("actual_tokens", F.lit(0)))
    shares = shares.withColumn("everything", F.sum("actual_tokens").over(Window.partitionBy(F.lit(1))))  # as many rows as targets
    shares = shares.select("source", "target_share", "max_repeats", "budget_tokens", "actual_tokens", F.when(F.col("everything") > 0, F.col("actual_tokens") / F.col("everything")).otherwise(0.0).alias("actual_share"))
    return mixed, shares
