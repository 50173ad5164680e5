"""Subject areas of documents (problem 10).

Method.  Texts become bags of terms (words of alphabetic scripts, pairs of neighbours of East Asian ones) in a hashed
space of fixed size.  Terms are weighted by log frequency, by inverse document frequency over the whole corpus and by
how unevenly they are spread over the areas in a sample of labelled documents.  A truncated singular value decomposition
of the weighted sample (randomised range finder with power iterations) gives the embedding.  Each area has one seed
centroid per cluster of its labelled documents (a language each, as terms of different languages don't meet); sentences
of the sample are assigned to the nearest centroid by cosine and the centroids refined until they stay.  Every sentence
of every document is then embedded: it deals with the area of its nearest centroid if its embedding is strong enough, a
threshold fitted on the same labels.  An area counts when at least a fifth of the document's sentences deal with it.

Bounds: the sample holds at most SAMPLE labelled documents (those of least hash), the term space 2**TERM_BITS
dimensions; document frequencies, sentences and shares cover all documents.

Defined results: null, empty and blank texts, and texts without a sentence, have no area; a document may have several
areas or none; repeated doc_ids give one result per distinct text; labels of areas missing in subject_areas are ignored;
without labels there is no result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.arrow import code_points

SAMPLE, TERM_BITS, DIM, CLUSTERS, ROUNDS = 4000, 16, 64, 8, 8
SHARE = 0.2
_SIZE = 1 << TERM_BITS
_WORD = re.compile(r"[^\W\d_㐀-鿿぀-ヿ가-힯]{2,}")
_ALPHABETIC = re.compile(r"[^\W\d_㐀-鿿぀-ヿ가-힯]{2}")
_END = re.compile(r"(?<=[。！？])|(?<=[.!?…])\s+(?=[\"'“«„(\[A-ZÀ-ÞĀ-Ž0-9•-])|[\r\n  \x85]+")
_WORDLIKE = re.compile(r"(?:[^\W\d_][\W\d_]*){4}")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text: what ends in a full stop, question or exclamation mark, or with the line."""
    return [s for x in _END.split(text or "") if (s := x.strip()) and is_sentence(s)]


def is_sentence(s: str) -> bool:
    """More than a mark, a heading or a fragment: letters, and an end."""
    return s[-1] in "。！？.!?…”\"»)）" and _WORDLIKE.search(s) is not None


def bags(texts: list[str], memo: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed terms of texts one after the other, and which text each belongs to, in order of the texts."""
    codes, offsets = code_points(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    wide = (codes >= 0x3040) & (codes < 0xD7B0)
    pair = wide[:-1] & wide[1:] & (owner[:-1] == owner[1:]) if len(codes) > 1 else np.zeros(0, bool)
    at = np.flatnonzero(pair)
    mixed = codes[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + codes[at + 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    ids, whose = [(mixed >> np.uint64(64 - TERM_BITS)).astype(np.int64)], [owner[at]]
    for i, text in enumerate(texts):
        if not _ALPHABETIC.search(text):
            continue
        words = _WORD.findall(text.lower())
        try:
            own = [memo[w] for w in words]
        except KeyError:
            memo.update((w, zlib.crc32(w.encode("utf-8", "surrogatepass")) & (_SIZE - 1)) for w in words)
            own = [memo[w] for w in words]
        ids.append(np.array(own, np.int64))
        whose.append(np.full(len(own), i))
    if len(memo) > 300_000:
        memo.clear()
    ids, whose = np.concatenate(ids), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return ids[order], whose[order]


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, memo, n = np.zeros(_SIZE, np.int64), {}, 0
    for big in batches:
        for start in range(0, big.num_rows, 500):
            texts = [t for t in big.column(0).slice(start, 500).to_pylist() if t and t.strip()]
            n += len(texts)
            ids, whose = bags(texts, memo)
            df += np.bincount(np.unique(whose * _SIZE + ids) % _SIZE, minlength=_SIZE)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n))], names=["term", "n"])


class Model:
    """Weights of the terms, embedding, centroids and threshold; small enough to broadcast (SIZE x DIM floats)."""

    def __init__(self, texts: list[str], labels: list[set[str]], areas: list[str], df: np.ndarray, n: int) -> None:
        self.areas, self.memo, self.scores = areas, {}, None
        ids, whose = bags(texts, self.memo)
        own_bags = [np.unique(x, return_counts=True) for x in np.split(ids, np.searchsorted(whose, np.arange(1, len(texts))))] if texts else []
        spread = np.full((len(areas), _SIZE), 0.0)
        for (at, _), own in zip(own_bags, labels):
            for a in own:
                spread[areas.index(a), at] += 1.0 / len(own)
        each = np.array([max(1.0, sum(a in own for own in labels)) for a in areas])
        rate = spread / each[:, None]
        p = (rate + 1e-4) / (rate + 1e-4).sum(0)
        uneven = 1 + (p * np.log(p)).sum(0) / np.log(max(2, len(areas)))
        seen = spread.sum(0)
        self.weight = (np.log((1 + n) / (1 + df)) * np.maximum(uneven, 0) ** 1.5 * (seen / (seen + 2))).astype(np.float32)
        self._decompose(own_bags)
        self._centroids(texts, labels)

    def _decompose(self, own_bags: list) -> None:
        rng = np.random.default_rng(11)
        cols = [(at, (1 + np.log(c)) * self.weight[at]) for at, c in own_bags]
        cols = [(at, v / max(1e-9, np.linalg.norm(v))) for at, v in cols]
        y = np.zeros((_SIZE, DIM), np.float32)
        q = None
        for _ in range(4):
            y[:] = 0
            for at, v in cols:
                side = rng.standard_normal(DIM).astype(np.float32) if q is None else v @ q[at]
                y[at] += np.outer(v, side)
            q, _ = np.linalg.qr(y)
        self.embed = q.astype(np.float32)

    def sums(self, texts: list[str], rows: np.ndarray) -> np.ndarray:
        """Of each text the sum of its terms' rows, over the root of their number."""
        out = np.zeros((len(texts), rows.shape[1]), np.float32)
        ids, whose = bags(texts, self.memo)
        if len(ids):
            first = np.flatnonzero(np.diff(whose, prepend=-1))
            n = np.diff(np.append(first, len(ids)))
            out[whose[first]] = np.add.reduceat(rows[ids], first) / np.sqrt(n)[:, None]
        return out

    def vectors(self, texts: list[str]) -> np.ndarray:
        """Embeddings whose lengths tell how much the texts say about any area."""
        weighted = self.weight[:, None] * self.embed
        parts = [self.sums(texts[i : i + 2000], weighted) for i in range(0, len(texts), 2000)]
        return np.concatenate(parts) if parts else np.zeros((0, DIM), np.float32)

    def _centroids(self, texts: list[str], labels: list[set[str]]) -> None:
        pure = [(a, t) for t, own in zip(texts, labels) if len(own) == 1 for a in own]
        seeds, owner = [], []
        for k, a in enumerate(self.areas):
            v = self.vectors([t for x, t in pure if x == a])
            v = v[np.linalg.norm(v, axis=1) > 1e-6]
            if not len(v):
                continue
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            centres = [v[0]]
            while len(centres) < min(CLUSTERS, len(v)):  # the farthest document is the next seed
                centres.append(v[np.argmin(np.max(v @ np.array(centres).T, axis=1))])
            seeds += centres
            owner += [k] * len(centres)
        c, self.owner = self._pure(np.array(seeds, np.float32).reshape(-1, DIM), np.array(owner, np.int64), pure)
        parts = [(i, s) for i, t in enumerate(texts) for s in sentences(t)]
        v = self.vectors([s for _, s in parts])
        length = np.linalg.norm(v, axis=1)
        unit = v / np.maximum(length, 1e-9)[:, None]
        self.centroids = c
        if not len(c) or not len(v):
            self.threshold = np.inf
            return
        allowed = np.array([[self.areas[k] in labels[i] for k in self.owner] for i, _ in parts])
        strong = length > np.median(length) * 0.5
        for _ in range(ROUNDS):
            near = np.where(allowed, unit @ c.T, -2.0).argmax(1)
            for k in range(len(c)):
                mine = unit[(near == k) & strong]
                if len(mine):
                    c[k] = mine.mean(0)
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        self.centroids = c
        self._fit_threshold(parts, unit, length, labels)

    def _pure(self, c: np.ndarray, owner: np.ndarray, pure: list) -> tuple[np.ndarray, np.ndarray]:
        """Seeds without those from documents with a wrong label: most documents nearest to such a seed have another area."""
        v = self.vectors([t for _, t in pure])
        keep = np.linalg.norm(v, axis=1) > 1e-6
        v, own = v[keep] / np.linalg.norm(v[keep], axis=1, keepdims=True), np.array([self.areas.index(a) for a, _ in pure])[keep]
        for _ in range(3):
            if not len(c) or not len(v):
                break
            near = (v @ c.T).argmax(1)
            n = np.bincount(near, minlength=len(c))
            right = np.bincount(near[own == owner[near]], minlength=len(c))
            good = (right > 0.5 * n) & (n > 1)
            if good.all() or not good.any():
                break
            c, owner = c[good], owner[good]
        return c, owner

    def _fit_threshold(self, parts: list, unit: np.ndarray, length: np.ndarray, labels: list[set[str]]) -> None:
        cos = unit @ self.centroids.T
        area, best = self.owner[cos.argmax(1)], cos.max(1) * length
        doc = np.array([i for i, _ in parts])
        total = np.bincount(doc, minlength=len(labels))
        truth = np.array([[a in own for a in self.areas] for own in labels])
        results = []
        for t in np.geomspace(max(1e-9, best.max() * 1e-3), max(1e-9, best.max()), 120):
            hit = best >= t
            counts = np.zeros((len(labels), len(self.areas)))
            np.add.at(counts, (doc[hit], area[hit]), 1)
            said = counts >= SHARE * np.maximum(total, 1)[:, None]
            both = (said & truth).sum()
            results.append((2 * both / max(1, said.sum() + truth.sum()), t))
        self.fit = max(r for r, _ in results)
        good = [t for r, t in results if r >= self.fit - 0.002]
        # Of the thresholds as good as the best, the one in the sparsest stretch between notices and subjects.
        edges = np.geomspace(good[0], good[-1] * 1.0001, 12)
        around = np.histogram(best, edges)[0]
        at = np.flatnonzero(around == around.min())
        k = at[len(at) // 2]
        self.threshold = float(np.sqrt(edges[k] * edges[k + 1]))

    def shares(self, texts: list[str | None]) -> list[tuple[int, str, float]]:
        """(position of the text, area, share of its sentences that deal with the area)."""
        if not len(self.centroids):
            return []
        if self.scores is None:  # length times cosine is linear in the terms: one row of scores a term
            self.scores = (self.weight[:, None] * self.embed) @ self.centroids.T
        parts = [sentences(t) for t in texts]
        n = np.array([len(p) for p in parts], np.int64)
        score = self.sums([s for p in parts for s in p], self.scores)
        doc = np.repeat(np.arange(len(texts)), n)
        hit = score.max(1) >= self.threshold if len(score) else np.zeros(0, bool)
        k = len(self.areas)
        counts = np.bincount(doc[hit] * k + self.owner[score.argmax(1)][hit], minlength=len(texts) * k) if len(score) else np.zeros(0, np.int64)
        return [(i // k, self.areas[i % k], counts[i] / n[i // k]) for i in np.flatnonzero(counts).tolist()]


def fit(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> Model:
    """The model, from corpus-wide document frequencies and at most SAMPLE labelled documents."""
    df = np.zeros(_SIZE, np.int64)
    got = documents.select("text").mapInArrow(_document_frequency, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = got["term"].to_numpy(), got["n"].to_numpy()
    df[term[term >= 0]] = n[term >= 0]
    names = [r.area for r in areas.where("area is not null").select("area").distinct().orderBy("area").collect()]  # the fixed table of areas
    own = labels.where("doc_id is not null and area is not null").groupBy("doc_id").agg(F.collect_set("area").alias("own"), F.count("*").alias("k"))
    some = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)  # the documented bound of the classifier's sample
    rows = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id").where("text is not null").select("doc_id", "text", "own").dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow().to_pylist()
    keep = [(r["text"], {a for a in r["own"] if a in names}) for r in rows]
    keep = [(t, o) for t, o in keep if o]
    return Model([t for t, _ in keep], [o for _, o in keep], names, df, int(n[term == -1].sum()))


def _assign(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(ids[start + i], a, s) for start in range(0, len(texts), 200) for i, a, s in model.shares(texts[start : start + 200])]
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=["doc_id", "area", "share"])

    return run


def assign(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, area, share): the share of each document's sentences that deals with each area."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, areas, labels))
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_assign(model), "doc_id bigint, area string, share double")


def found(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of p10_found."""
    return assign(documents, areas, labels).where(F.col("share") >= SHARE).select("doc_id", "area").distinct()


def composition(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, area, documents, share): the areas of each source, and of all (source null)."""
    rows = documents.select("doc_id", "source").dropDuplicates(["doc_id"])
    of = found(documents, areas, labels).join(rows, "doc_id")
    total = rows.groupBy("source").agg(F.count("*").alias("total"))
    by = of.groupBy("source", "area").agg(F.count("*").alias("documents"))
    parts = by.join(total, "source", "left")
    every = by.groupBy("area").agg(F.sum("documents").alias("documents")).withColumn("total", F.lit(rows.count()))
    cols = ["source", "area", "documents", (F.col("documents") / F.col("total")).alias("share")]
    return parts.select(*cols).unionAll(every.withColumn("source", F.lit(None).cast("string")).select(*cols))
