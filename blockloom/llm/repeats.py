"""Lines repeated across the documents of one site (problem 5).

Method.  Every line of paragraphs and list items is reduced to its letters in lower case.  The number of the site's
documents with the line is held against the number of documents outside by a log-likelihood ratio, and the
false-discovery rate over all such tests is controlled (Benjamini-Hochberg on a histogram of p-values with a fixed number
of bins).  Sites on which the line is repeated itself don't count as outside, so that a line all sites repeat is in
excess on each.  Of the lines in significant excess those are removed that pass the exact rule: at least 4 documents and
at least 8 % of the site's documents.  The others are kept by an anti-join and the texts are reassembled by position.

A line that passes the exact rule is lost only if it is as common on the sites that don't repeat it (they are small, or
lie just below the share); no case of the test data is.

Counts are distinct documents per (site, line), pre-aggregated before the shuffle, so a site that holds a third of all
rows is spread over its lines.  Lines travel as two hashes (96 bits), not as text.

Defined results: null text, null site, null document_id and other block types have no cases and are kept whole; lines of fewer than five
letters never count; repeated rows count once; a text whose lines are all removed becomes empty; line ends other than
line feeds belong to the line.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.tables import ensure_checkpoint_dir

LEAST_LETTERS, LEAST_DOCUMENTS, LEAST_SHARE, FALSE_DISCOVERY = 5, 4, 0.08, 0.05
KINDS = ("paragraph", "list_item")
_BINS = 4000


def letters(line: Column) -> Column:
    """The letters of a line in lower case."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]", "")


def positioned(blocks: DataFrame) -> DataFrame:
    """(site, document_id, block_id, line_no, k1, k2): the lines that count."""
    ours = blocks.where(F.col("block_type").isin(*KINDS) & F.col("site").isNotNull() & F.col("text").isNotNull() & F.col("document_id").isNotNull())
    lines = ours.select("site", "document_id", "block_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("k", letters(F.col("line")))
    return lines.where(F.length("k") >= LEAST_LETTERS).select("site", "document_id", "block_id", "line_no", F.xxhash64("k").alias("k1"), F.crc32("k").alias("k2"))


def log_likelihood(a: Column, m: Column, t: Column, n: Column) -> Column:
    """Twice the log-likelihood ratio of a of m inside against t - a of n - m outside; negative where it is rarer inside."""
    c, b, d = t - a, m - a, n - m - (t - a)
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    g = 2 * (part(a, m * t / n) + part(b, m * (n - t) / n) + part(c, (n - m) * t / n) + part(d, (n - m) * (n - t) / n))
    return F.when((n > m) & (a / m < c / (n - m)), -g).otherwise(F.when(n > m, g).otherwise(F.lit(1e3)))


def _counted(blocks: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(site, k1, k2, n): documents with the line; (site, m): documents of the site."""
    once = lines.groupBy("site", "k1", "k2", "document_id").agg(F.lit(1).alias("one"))
    documents = blocks.where("site is not null and document_id is not null").groupBy("site", "document_id").agg(F.lit(1).alias("one")).groupBy("site").agg(F.count("one").alias("m"))
    return once.groupBy("site", "k1", "k2").agg(F.count("one").alias("n")), documents


def _rule():
    return (F.col("n") >= LEAST_DOCUMENTS) & (F.col("n") >= LEAST_SHARE * F.col("m"))


def excess(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """(site, k1, k2, n, m, llr, significant) of the lines that pass the exact rule; significant ones are in excess on the site."""
    ensure_checkpoint_dir(blocks.sparkSession)
    inside, documents = _counted(blocks, lines)
    inside = inside.join(documents, "site").withColumn("often", _rule()).checkpoint()  # three parts of the plan read it
    outside = inside.groupBy("k1", "k2").agg(F.sum(F.when(F.col("often"), 0).otherwise(F.col("n"))).alias("rare"), F.sum(F.when(F.col("often"), F.col("m")).otherwise(0)).alias("taken"))
    total = float(documents.agg(F.sum("m")).first()[0] or 0)
    # A line that stands in fewer documents than the rule asks for is a test too: it counts for the discovery rate.
    tests = inside.join(outside, ["k1", "k2"])
    mine = lambda c: F.when(F.col("often"), 0).otherwise(F.col(c))
    a, m, rest = (F.col("n").cast("double"), F.col("m").cast("double"), F.lit(total) - F.col("taken") - mine("m"))
    tests = tests.withColumn("llr", log_likelihood(a, m, a + F.col("rare") - mine("n"), m + rest))
    x = F.sqrt(F.greatest("llr", F.lit(1e-9)) / 2)
    minus_log_p = F.when(F.col("llr") <= 0.5, 0.0).otherwise(x * x + F.log(x * F.sqrt(F.lit(3.141592653589793))))  # a bound of erfc from above
    tests = tests.withColumn("bin", F.least(F.floor(F.greatest(minus_log_p, F.lit(0.0)) * 10), F.lit(_BINS)).cast("int"))
    cut = discovery_cut({r.bin: r.k for r in tests.groupBy("bin").agg(F.count("*").alias("k")).collect()})  # at most _BINS + 1 rows
    significant = (F.col("bin") >= cut) & (F.col("llr") > 0)
    return tests.where("often").select("site", "k1", "k2", "n", "m", "llr", significant.alias("significant"))


def discovery_cut(bins: dict[int, int]) -> int:
    """The least bin of minus log p (tenths) up to which the false-discovery rate is kept; beyond all bins if none is."""
    tests, rank, cut = sum(bins.values()), 0, _BINS + 1
    for b in sorted(bins, reverse=True):
        rank += bins[b]
        if exp(-b / 10) <= FALSE_DISCOVERY * rank / tests:
            cut = b
    return cut


def found(blocks: DataFrame) -> DataFrame:
    """The rows of p5_found."""
    lines = positioned(blocks)
    often = excess(blocks, lines).where("significant").select("site", "k1", "k2")
    return lines.join(often, ["site", "k1", "k2"], "left_semi").select("block_id", "line_no").distinct()


def remove(blocks: DataFrame) -> DataFrame:
    """(block_id, text) of all blocks, without the repeated lines of their site."""
    cut = found(blocks).groupBy("block_id").agg(F.collect_set("line_no").alias("cut"))
    once = blocks.select("block_id", "text").dropDuplicates(["block_id"])
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: ~F.array_contains("cut", s.i)).x, "\n")
    return once.join(cut, "block_id", "left").select("block_id", F.when(F.col("cut").isNull(), F.col("text")).otherwise(kept).alias("text"))
