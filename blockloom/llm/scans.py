"""Noise in text from scanned pages: cut words, misread signs, running lines and page numbers (problem 3).

Method.  (1) Over every block of the corpus, words and the signs between two neighbours are counted; then skip-gram
vectors are learned: the vector of a word sums, over a window of two on either side, fixed random vectors of its
neighbours, weighted down by how frequent they are in the corpus, in whole numbers (the count form of skip-gram training:
neither the order of rows nor their partitions matter).  (2) A rare word is linked to a frequent one that differs from it
by plausible glyph edits, if the context of the rare word isn't far from the vector of the frequent one; of several the
nearest is taken.  A rare ideograph between neighbours is linked to the sign that is frequent between the same
neighbours, and such links count only where several different surroundings support them.  (3) The links between signs,
once learned, are tried on every sign they know.  (4) Running lines (the document's title or its beginning) and page
numbers are removed, cut words joined, and lines reflowed.

The tables of counts and weights have a fixed number of hashed buckets, so they are bounded whatever the corpus:
WORD_ROWS x 2**WORD_BITS word counts, 2**TRI_BITS counts of three signs, VECTORS x DIM weights.  Expected signs are kept by the
exact pair of neighbours, for all pairs with LEAST_GAP times one sign between them: as many as the corpus has such pairs.

Only documents whose metadata says scanned are looked at; headings keep their text.  Defined results: null or empty
text has no noise; metadata that is null or no JSON means not scanned; a document without a title is held against its
first heading; repeated rows give equal results; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.lookalikes import Normalizer
from blockloom.tables import ensure_checkpoint_dir

WORD_BITS, WORD_ROWS, TRI_BITS = 21, 3, 22
VECTORS, DIM, WINDOW = 1 << 15, 32, 2
#: A word or three signs are rare beside others that are so many times as frequent.
RATIO = 12
#: An expected sign must stand so many times between its neighbours; fewer never count as a reading.
LEAST_GAP = 3
#: A word known so many times is a known one; others say nothing about their neighbours.
LEAST_WORD = 5
#: The method links rare words to frequent ones: a word with this share of all words isn't rare.  Without this border the
#: word "an" would count as "on" misread in 94 blocks of the data at scale 0.1.
COMMON = 3e-4
#: How near the vector of a frequent word must be to the context of the rare one that is taken for it misread.
NEAR = -0.2
#: Wrong sign(s), as recognised, and the right one(s). Fixed values.
GLYPHS = (
    ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("9", "g"), ("6", "é"), ("8", "B"), ("c", "e"), ("cl", "d"), ("rn", "m"), ("vv", "w"), ("b", "h"), ("f", "t"), ("ii", "u"), ("ii", "ü"), ("h", "li"),
    ("m", "in"), ("m", "rn"), ("d", "cl"), ("w", "vv"), ("e", "c"), ("h", "b"), ("t", "f"), ("u", "ii"), ("n", "ri"), ("l", "i"), ("i", "l"), ("I", "l"), ("l", "I"), ("O", "o"), ("S", "s"), ("0", "O"), ("1", "I"), ("5", "S"), ("é", "6"), ("in", "m"), ("li", "h"), ("ni", "m"), ("6", "b"), ("q", "g"), ("g", "q"), ("a", "o"), ("o", "a"), ("n", "u"), ("u", "n"), ("v", "y"), ("y", "v"), ("c", "o"), ("o", "c"),
)
#: Marks that divide a word.
_NUMBERED = re.compile(r"\s{2,}\S{1,6}\s*$")
_CUT = re.compile(r"[^\W\d_][-¬‐\xad]\s*$")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_NUMBER = r"[0-9lIOS]{0,3}[0-9][0-9lIOS]{0,3}"
_PAGE = re.compile(rf"^\s*(?:{_NUMBER}|[pPsS]\. ?{_NUMBER}|[-–—] ?{_NUMBER} ?[-–—]|\[ ?{_NUMBER} ?\]|\( ?{_NUMBER} ?\)|{_NUMBER} ?/ ?{_NUMBER}|[·•] ?{_NUMBER} ?[·•]|{_NUMBER}\.|[第弟] ?{_NUMBER} ?[页頁]|(?:[Pp]age|[Ss]eite) {_NUMBER})\s*$")
_DIGIT = re.compile("[0-9]")
_HAN = re.compile(r"[㐀-鿿]")
#: Different words or contexts a task holds before it gives its counts away; the unit of the weights.
HELD, WHOLE = 500_000, 1 << 20


def _word_id(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def _rows_of(ids: np.ndarray) -> np.ndarray:
    """The buckets of words, one in each row of the table: a count is the least of its rows, so that rarely two words mix."""
    mask = np.uint64((1 << WORD_BITS) - 1)
    return np.stack([((ids >> np.uint64(k * WORD_BITS)) & mask).astype(np.int64) + (k << WORD_BITS) for k in range(WORD_ROWS)])


@cache
def _signs() -> np.ndarray:
    return np.random.default_rng(7).choice(np.array([-1.0, 1.0]), (VECTORS, DIM))


def _mix(*parts: np.ndarray) -> np.ndarray:
    x = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        x = (x ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return x


def _codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where((codes >= 48) & (codes <= 57), np.uint32(48), codes)


def _squeezed(text: str) -> str:
    """East Asian text without the line ends that layout put in."""
    return text.replace("\n", "").replace("\r", "").replace(" ", "")


def _triples(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose sign is an ideograph with a sign on either side, and the bucket of the three."""
    mid = np.flatnonzero((codes[1:-1] >= 0x3400) & (codes[1:-1] < 0xA000)) + 1
    return mid, _mix(codes[mid - 1], codes[mid], codes[mid + 1]) >> np.uint64(64 - TRI_BITS)


def _gaps(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Two neighbours as one number of 42 bits; a code point has 21."""
    return (left.astype(np.uint64) << np.uint64(21)) | right.astype(np.uint64)


def _rows(kind: int, bucket: np.ndarray, sign: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.array(bucket.astype(np.int64)), pa.array(sign.astype(np.int32)), pa.array(n.astype(np.int64))], names=["kind", "bucket", "sign", "n"])


def _words(texts: list[str]) -> list[str]:
    """The words of texts with Latin letters; between texts as many '' as the window has words."""
    out: list[str] = []
    for t in texts:
        if _LATIN.search(t):
            out += [w for w in _WORD.findall(t) if not w.isdecimal()]
            out += [""] * WINDOW
    return out


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of one task: kind, bucket, sign, n.  What it has counted goes out whenever HELD different things are held."""
    words: Counter = Counter()
    table, tri, gap = np.zeros(WORD_ROWS << WORD_BITS, np.int64), np.zeros(1 << TRI_BITS, np.int64), {}

    def add_words() -> None:
        words.pop("", None)
        hashed = _rows_of(np.fromiter((_word_id(w) for w in words), np.uint64, len(words)))
        np.add.at(table, hashed.ravel(), np.tile(np.fromiter(words.values(), np.int64, len(words)), WORD_ROWS))
        words.clear()

    def gaps() -> pa.RecordBatch:
        keys = np.fromiter(gap, np.int64, len(gap))
        out = _rows(3, keys >> 21, keys & ((1 << 21) - 1), np.fromiter(gap.values(), np.int64, len(gap)))
        gap.clear()
        return out

    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t]
        words.update(_words(texts))
        if len(words) > HELD:
            add_words()
        codes = _codes("\x00".join(["", *(_squeezed(t) for t in texts if _HAN.search(t)), ""]))
        if len(codes) > 2:
            mid, bucket = _triples(codes)
            tri += np.bincount(bucket.astype(np.int64), minlength=1 << TRI_BITS)
            key = (_gaps(codes[mid - 1], codes[mid + 1]) << np.uint64(21)) | codes[mid]
            for k, n in zip(*(x.tolist() for x in np.unique(key, return_counts=True))):
                gap[k] = gap.get(k, 0) + n
        if len(gap) > HELD:
            yield gaps()
    add_words()
    for kind, full in ((0, table), (1, tri)):
        at = np.flatnonzero(full)
        yield _rows(kind, at, np.zeros(len(at)), full[at])
    yield gaps()


def _embed(shared):
    """Partial sums of the vectors of one task: whole numbers, so their sums don't depend on the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, vec, known = Reader((shared.value, None, None, None)), np.zeros((VECTORS, DIM)), {}

        def add(one: np.ndarray, other: np.ndarray, w: np.ndarray) -> None:
            order = np.argsort(one, kind="stable")
            for start in range(0, len(order), 1 << 17):  # bounds what is held at once
                part = order[start : start + (1 << 17)]
                whose = one[part]
                first = np.flatnonzero(np.diff(whose, prepend=-1))
                vec[whose[first]] += np.add.reduceat(_signs()[other[part]] * w[part, None], first)

        for batch in batches:
            tokens = _words([t for t in batch.column(0).to_pylist() if t])
            if len(known) > HELD:
                known.clear()
            for w in set(tokens):
                if w not in known:
                    known[w] = (_word_id(w) % VECTORS, round(WHOLE * weight(reader.count(w)))) if w else (-1, 0)
            both = np.array([known[w] for w in tokens], np.int64).reshape(-1, 2)
            at, heavy = both[:, 0], both[:, 1]
            for off in range(1, WINDOW + 1):
                ok = (at[:-off] >= 0) & (at[off:] >= 0)
                a, b, wa, wb = at[:-off][ok], at[off:][ok], heavy[:-off][ok], heavy[off:][ok]
                add(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([wb, wa]))
        full = vec.ravel()
        at = np.flatnonzero(full)
        yield _rows(2, at, np.zeros(len(at)), full[at])

    return run


def weight(count: float) -> float:
    """What a neighbour that stands so often in the corpus adds to a vector."""
    return 0.0 if count < LEAST_WORD else 1.0 / (1.0 + count) ** 0.5


def _table(counts, kind: int, size: int, of=np.float32) -> np.ndarray:
    k, bucket, n = (counts[c].to_numpy() for c in ("kind", "bucket", "n"))
    out = np.zeros(size, of)
    out[bucket[k == kind]] = n[k == kind]
    return out


def learn(blocks: DataFrame) -> tuple:
    """The broadcast tables, learned over all blocks: counts first, then the vectors, weighted by the counts."""
    schema, context = "kind int, bucket bigint, sign int, n bigint", blocks.sparkSession.sparkContext
    counts = blocks.select("text").mapInArrow(_learn, schema).groupBy("kind", "bucket", "sign").agg(F.sum("n").alias("n"))
    best = F.max_by("sign", F.struct("n", "sign")).alias("sign")
    top = counts.groupBy("kind", "bucket").agg(F.sum("n").alias("all"), F.max("n").alias("n"), best)
    got = top.select("kind", "bucket", "sign", F.when(F.col("kind") == 3, F.col("n")).otherwise(F.col("all")).alias("n")).where((F.col("kind") != 3) | (F.col("n") >= LEAST_GAP)).toArrow()
    words, tri = _table(got, 0, WORD_ROWS << WORD_BITS), _table(got, 1, 1 << TRI_BITS)
    gaps = got.filter(pc.equal(got["kind"], 3)).sort_by("bucket")
    expected = gaps["bucket"].to_numpy().astype(np.uint64), gaps["sign"].to_numpy().astype(np.uint32)
    shared = context.broadcast(words)
    sums = blocks.select("text").mapInArrow(_embed(shared), schema).groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    vec = _table(sums, 2, VECTORS * DIM, np.float64).reshape(VECTORS, DIM)
    vec -= vec.mean(0)
    vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-6)
    return words, tri, expected, vec.astype(np.float32)


class Reader:
    """Finds and repairs the noise of one block, given the tables of the corpus."""

    def __init__(self, tables: tuple) -> None:
        self.words, self.tri, self.expected, self.vec = tables
        self.common = max(100.0, COMMON * float(self.words[: 1 << WORD_BITS].sum()))
        self.often = (self.words[: 1 << WORD_BITS] >= LEAST_WORD).tobytes()
        self.normal = Normalizer()
        self.memo: dict[str, list[str]] = {}
        self.counts: dict[str, float] = {}
        self.folded: dict[str, str] = {}
        self.vectors: dict[str, np.ndarray] = {}

    def count(self, word: str) -> float:
        known = self.counts.get(word)
        if known is not None:
            return known
        h, least = _word_id(word), np.inf
        for k in range(WORD_ROWS):
            n = self.words[((h >> (k * WORD_BITS)) & ((1 << WORD_BITS) - 1)) + (k << WORD_BITS)]
            if n < least:
                least = float(n)
                if not n:
                    break
        if len(self.counts) > 500_000:
            self.counts.clear()
        self.counts[word] = least
        return least

    def known(self, word: str, least: float) -> bool:
        """Whether a word without digits stands so often; its first bucket rules most words out."""
        return self.often[_word_id(word) & ((1 << WORD_BITS) - 1)] and self.count(word) >= least and not _DIGIT.search(word)

    def candidates(self, word: str) -> list[str]:
        """Frequent words from which a rare one comes by up to three glyph edits of one kind, or one of each of two."""
        if word in self.memo:
            return self.memo[word]
        least, out = max(LEAST_WORD, RATIO * self.count(word)), []
        one = [new for wrong, right in GLYPHS if wrong in word for new in self.edits(word, wrong, right)]
        out = [w for w in dict.fromkeys(one) if self.known(w, least)]
        if not out and len(word) > 3:
            two = (new for w in one for wrong, right in GLYPHS if wrong in w for new in self.edits(w, wrong, right))
            out = [w for w in dict.fromkeys(two) if self.known(w, least)]
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[word] = out
        return out

    @staticmethod
    def edits(word: str, wrong: str, right: str) -> list[str]:
        at = [i for i in range(len(word)) if word.startswith(wrong, i)]
        out = [word[:i] + right + word[i + len(wrong) :] for i in at]
        return out + [word.replace(wrong, right)] * (len(at) > 1)

    def fits(self, words: list[str], i: int, candidates: list[str]) -> list[float]:
        """How well each candidate fits the words around it, by the vectors; words without known neighbours fit anywhere."""
        context = sum(self.heavy(w) for w in (*words[max(0, i - WINDOW) : i], *words[i + 1 : i + WINDOW + 1])) + np.zeros(DIM)
        length = float(np.linalg.norm(context))
        return [float(self.vec[_word_id(c) % VECTORS] @ context) / length if length else 1.0 for c in candidates]

    def heavy(self, word: str) -> np.ndarray:
        """What a word adds to its neighbours' vectors."""
        got = self.vectors.get(word)
        if got is None:
            if len(self.vectors) > 50_000:
                self.vectors.clear()
            got = self.vectors[word] = _signs()[_word_id(word) % VECTORS] * weight(self.count(word))
        return got

    def misread_words(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, right word) of the misread words of continuous text."""
        found = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
        words, out = [w for *_, w in found], []
        for i, (a, b, w) in enumerate(found):
            if len(w) < 2 or not _LATIN.search(w) or _HAN.search(w):
                continue
            if self.count(w) >= self.common:
                continue
            some = self.candidates(w)
            if not some:
                parts = [p for p in re.split(r"['’-]", w) if len(p) > 2]
                fixed = {p: c[0] for p in parts if len(parts) > 1 and (c := self.candidates(p))}
                if fixed and all(self.count(p) >= 5 or p in fixed for p in parts):
                    new = w
                    for p, c in fixed.items():
                        new = new.replace(p, c)
                    out.append((a, b, new))
                continue
            fit, _, best = max(zip(self.fits(words, i, some), map(self.count, some), some))
            if fit >= NEAR:
                out.append((a, b, best))
        return out

    def misread_signs(self, text: str) -> list[tuple[int, str, str, int, int, float]]:
        """(position, sign, expected sign, hashes of five and of three signs, count of the three) of ideographs rare between their neighbours."""
        codes = _codes(text)
        if len(codes) < 5:
            return []
        mid, bucket = _triples(codes)
        seen = np.full(len(codes), 1e9, np.float32)
        seen[mid] = self.tri[bucket]
        want = np.zeros(len(codes), np.uint32)
        want[mid] = self.wanted(codes[mid - 1], codes[mid + 1])
        out = []
        for i in np.flatnonzero((want > 0) & (want != codes)).tolist():
            if not 0x3400 <= want[i] < 0xA000:
                continue
            new = codes[max(0, i - 2) : i + 3].copy()
            old_around = self.around(codes[max(0, i - 2) : i + 3])
            new[i - max(0, i - 2)] = want[i]
            new_around = self.around(new)
            if len(new_around) == len(old_around) and all(n >= LEAST_GAP and n >= RATIO * o for n, o in zip(new_around, old_around)):
                side = codes[max(0, i - 2) : i + 3].tolist()
                out.append((i, chr(codes[i]), chr(want[i]), hash(tuple(side)) & 0x7FFFFFFF, hash(tuple(codes[i - 1 : i + 2].tolist())) & 0x7FFFFFFF, float(seen[i])))
        return out

    def wanted(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The expected signs between neighbours, 0 where none is known."""
        gaps, signs = self.expected
        if not len(gaps):
            return np.zeros(len(left), np.uint32)
        pairs = _gaps(left, right)
        at = np.minimum(np.searchsorted(gaps, pairs), len(gaps) - 1)
        return np.where(gaps[at] == pairs, signs[at], np.uint32(0))

    def misread_known(self, text: str, right: dict[int, int]) -> list[tuple[int, str]]:
        """(position, right sign) of the signs that a learned link explains; neighbours are put right together."""
        codes = _codes(text)
        at = [i for i, c in enumerate(codes.tolist()) if c in right]
        out: list[tuple[int, str]] = []
        while at:
            group = [at.pop(0)]
            while at and at[0] - group[-1] <= 2:
                group.append(at.pop(0))
            for some in [group, *([[i] for i in group] if len(group) > 1 else [])]:
                lo, hi = max(0, some[0] - 2), some[-1] + 3
                old, new = codes[lo:hi], codes[lo:hi].copy()
                for i in some:
                    new[i - lo] = right[int(codes[i])]
                (mid, b_old), (_, b_new) = _triples(old), _triples(new)
                if len(b_old) != len(b_new) or not len(b_old):
                    continue
                n_old, n_new = self.tri[b_old], self.tri[b_new]
                centre = np.isin(mid + lo, some)
                if centre.any() and (n_new[centre] >= np.maximum(3, RATIO / 2 * n_old[centre])).all() and n_new.sum() >= RATIO / 2 * n_old.sum():
                    out += [(i, chr(right[int(codes[i])])) for i in some if i not in {p for p, _ in out}]
                    if some is group:
                        break
        return sorted(out)

    def around(self, codes: np.ndarray) -> list[float]:
        return self.tri[_triples(codes)[1]].tolist() if len(codes) > 2 else []

    def running(self, line: str, titles: list[str]) -> bool:
        """Whether a line repeats a title or its beginning; a page number may stand after it."""
        own = _folded(_NUMBERED.sub("", line.strip()))
        for title in titles:
            full = self.folded.get(title)
            if full is None:
                if len(self.folded) > 50_000:
                    self.folded.clear()
                full = self.folded[title] = _folded(title)
            n = min(len(own), len(full))
            if n < 6:
                continue
            if len(own) <= len(full) + 2 and (len(own) >= len(full) - 2 or n >= 18 or n >= 0.6 * len(full)):
                wrong = sum(a != b for a, b in zip(own, full))
                if wrong <= (0.2 if len(own) == len(full) else 0.12) * n:
                    return True
                start, most = full[: len(own)], 0.12 * n
                if _unlike(own, start) <= most and _distance(own, start, int(most) + 1) <= most:
                    return True
        return False

    def is_cut(self, line: str, following: str) -> bool:
        """Whether a line ends in the first part of a word that a mark divides."""
        m = _CUT.search(line)
        if not m:
            return False
        if m[0][1] != "-":
            return True
        first = re.search(r"[^\W_]+(?:['’-][^\W_]+)*(?=-\s*$)", line)
        second = _WORD.match(following.lstrip())
        if not first or not second:
            return bool(first)
        a, b = first[0], second[0]
        joined, kept = self.count(a + b), self.count(f"{a}-{b}")
        if joined or kept:
            return joined >= kept
        return b[0].islower()

    def read(self, text: str | None, kind: str | None, titles: list[str]) -> tuple[list[str], str, list]:
        """(kinds of noise, repaired text, links of signs) of one block."""
        if not text:
            return [], text or "", []
        if kind == "heading":
            return [], text, []
        lines, noise, body = text.split("\n"), [], []
        for line in lines:
            if _PAGE.match(line):
                noise.append("page_number")
            elif self.running(line, titles):
                noise.append("running_line")
            else:
                body.append(line)
        out = ""
        for i, line in enumerate(body):
            following = body[i + 1] if i + 1 < len(body) else ""
            if self.is_cut(line, following):
                noise.append("cut_word")
                out += line.rstrip()[:-1]
            elif i + 1 == len(body):
                out += line
            else:
                glue = "" if _HAN.search(line[-1:] or "x") or _HAN.search(following[:1] or "x") or line[-1:] in "，。；：、）" else " "
                out += line.rstrip() + glue
        plain = self.normal.one(out)[0] if not out.isascii() else out
        links = self.misread_signs(plain) if _HAN.search(plain) else []
        for a, b, new in reversed(self.misread_words(plain)):
            plain = plain[:a] + new + plain[b:]
            noise.append("misread")
        return sorted(set(noise)), plain, links


@cache
def _fold_table() -> dict:
    return str.maketrans({"1": "l", "i": "l", "|": "l", "0": "o", "5": "s", "9": "g", "6": "e", "c": "e", "é": "e", "b": "h", "f": "t", "弟": "第", "8": "h"})


def _folded(text: str) -> str:
    """A line without what glyph errors, case and blanks change."""
    t = "".join(text.lower().split()).translate(_fold_table())
    for wrong, right in (("rn", "m"), ("vv", "w"), ("el", "d"), ("ll", "u"), ("ln", "m")):
        t = t.replace(wrong, right)
    return t


def _unlike(a: str, b: str) -> int:
    """A bound of _distance from below: the signs one line has more of than the other; an edit changes it by at most one."""
    x, y = Counter(a), Counter(b)
    return max((x - y).total(), (y - x).total())


def _distance(a: str, b: str, most: int) -> int:
    """Edits between two short lines, at most so many."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, before + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def _read(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(broadcast.value)
        link = pa.list_(pa.struct([("pos", pa.int32()), ("wrong", pa.string()), ("right", pa.string()), ("side", pa.int32()), ("centre", pa.int32()), ("old", pa.float64())]))
        for batch in batches:
            got = []
            for text, kind, titles in zip(*(batch.column(c).to_pylist() for c in ("text", "block_type", "titles"))):
                noise, new, links = reader.read(text, kind, [t for t in titles or [] if t])
                got.append((noise, new, [dict(zip(("pos", "wrong", "right", "side", "centre", "old"), x)) for x in links]))
            cols = list(zip(*got)) if got else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column("block_id"), pa.array(cols[0], pa.list_(pa.string())), pa.array(cols[1], pa.string()), pa.array(cols[2], link)], names=["block_id", "noise", "repaired", "links"])

    return run


def scanned_blocks(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """(block_id, text, block_type, titles) of the blocks of scanned documents."""
    docs = documents.groupBy("document_id").agg(F.max(F.coalesce(F.get_json_object("metadata", "$.scanned") == "true", F.lit(False))).alias("scanned"), F.sort_array(F.collect_set("title")).alias("titles")).where("scanned").drop("scanned")
    own = blocks.select("document_id", "block_id", "text", "block_type", "block_order").join(docs, "document_id")
    first = own.where("block_type = 'heading' and text is not null").groupBy("document_id").agg(F.min_by("text", F.struct("block_order", "block_id")).alias("heading"))
    return own.join(first, "document_id", "left").select("block_id", "text", "block_type", F.concat("titles", F.array("heading")).alias("titles"))


def read(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """(block_id, noise, repaired, links) of the blocks of scanned documents."""
    return _reading(blocks, documents, blocks.sparkSession.sparkContext.broadcast(learn(blocks)))


def _reading(blocks: DataFrame, documents: DataFrame, shared) -> DataFrame:
    return scanned_blocks(blocks, documents).mapInArrow(_read(shared), "block_id string, noise array<string>, repaired string, links array<struct<pos:int,wrong:string,right:string,side:int,centre:int,old:double>>")


def _supported(links: DataFrame) -> DataFrame:
    """Links (wrong, right, n) of signs that several surroundings or blocks support, unless the opposite link has more.

    What recognition did stands in scanned documents only: at least half of all places in the corpus where the three
    signs meet must be places of the link, else the three are a usage of their own."""
    at = links.groupBy("wrong", "right", "centre").agg(F.count("*").alias("n"), F.max("old").alias("old"))
    own = at.groupBy("wrong", "right").agg((F.sum("n") / F.sum("old")).alias("own"))
    pairs = links.groupBy("wrong", "right").agg(F.countDistinct("block_id").alias("n"), F.countDistinct("side").alias("sides"))
    back = pairs.select(F.col("wrong").alias("right"), F.col("right").alias("wrong"), F.col("n").alias("m"))
    held = pairs.join(own, ["wrong", "right"]).join(back, ["wrong", "right"], "left")
    return held.where("(n >= 4 or sides >= 2) and n > coalesce(m, 0) and own >= 0.5").select("wrong", "right", "n")


def _recheck(broadcast, right: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(broadcast.value)
        fix = pa.list_(pa.struct([("pos", pa.int32()), ("right", pa.string())]))
        for batch in batches:
            got = [[{"pos": p, "right": r} for p, r in reader.misread_known(t, right)] for t in batch.column(1).to_pylist()]
            keep = pa.array([i for i, x in enumerate(got) if x], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, fix)], names=["block_id", "fix"]).take(keep)

    return run


def _twice(blocks: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the blocks of scanned documents gave, and (block_id, fix) of misread signs: the links between signs are
    learned from the first reading, then every sign they know is looked at again, also beside other misread signs."""
    ensure_checkpoint_dir(blocks.sparkSession)
    shared = blocks.sparkSession.sparkContext.broadcast(learn(blocks))
    got = _reading(blocks, documents, shared).checkpoint()
    links = got.select("block_id", F.explode("links").alias("link")).select("block_id", "link.*")
    # At most one link a wrong sign, so there are no more of them than ideographs.
    best = _supported(links).groupBy("wrong").agg(F.max_by("right", F.struct("n", "right")).alias("right")).collect()
    right = {ord(r.wrong): ord(r.right) for r in best}
    again = got.where(F.lit(bool(right)) & F.col("repaired").rlike("[" + "".join(map(chr, sorted(right))) + "]" if right else "x")).select("block_id", "repaired")
    return got, again.mapInArrow(_recheck(shared, right), "block_id string, fix array<struct<pos:int,right:string>>")


def found(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """The rows of p3_found."""
    got, signs = _twice(blocks, documents)
    return got.select("block_id", F.explode("noise").alias("noise")).unionAll(signs.select("block_id", F.lit("misread").alias("noise"))).distinct()


def repaired(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """(block_id, text): continuous text of the blocks of scanned documents, without furniture."""
    got, signs = _twice(blocks, documents)
    put = F.aggregate("fix", F.col("repaired"), lambda t, x: F.concat(F.substring(t, F.lit(1), x.pos), x.right, F.substring(t, x.pos + 2, F.length(t))))
    once = got.select("block_id", "repaired").dropDuplicates(["block_id"]).join(signs.dropDuplicates(["block_id"]), "block_id", "left")
    return once.select("block_id", F.when(F.col("fix").isNull(), F.col("repaired")).otherwise(put).alias("text"))
