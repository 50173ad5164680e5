"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 8).

Method: prefix-sharing trie traversal.  The distinct words of a batch, in sorted order, are the depth-first order of
their trie.  A stack holds the state of each byte on the current path: the last token of the encoding of the path up to
there.  That token is unique: of the tokens that end there, the one that can follow the last token of what is before it
(no merge of BPE would cross their border).  A word begins where it leaves the path of the word before, so the encoding
of a shared prefix is computed once.  The ids of a word are read back along the states.

No shuffle: each task encodes its own rows and keeps the words it has met, up to WORDS of them.

The vocabulary file is a parameter; it is read on the driver and broadcast (three small arrays).

Defined results: an empty text and a null text give an empty list; strings that look like special tokens are ordinary
text; texts of any length are encoded whole; every row gives one row, repeated ones too.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words a task remembers before it begins anew.
WORDS = 400_000
#: How text is cut into words before merges. Fixed value; white space is Unicode's.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


@cache
def load(path: str) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Tokens by id, and the two tokens that each was merged from (itself, if it is a single byte)."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    tokens = [b""] * (max(ranks.values()) + 1)
    left, right = np.arange(len(tokens), dtype=np.int32), np.arange(len(tokens), dtype=np.int32)
    for token, rank in ranks.items():
        tokens[rank] = token
        if len(token) > 1:
            left[rank], right[rank] = _split(token, rank, ranks)
    return tokens, left, right


def _split(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int]:
    """The last merge of a token: plain merging of its bytes with the ranks below its own."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: r if (r := ranks.get(parts[i] + parts[i + 1], rank)) < rank else rank)
        if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
            raise ValueError(f"token {rank} is no merge of two others")
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return ranks[parts[0]], ranks[parts[1]]


class Encoder:
    """Encodes sorted words along their trie."""

    def __init__(self, tokens: list[bytes], left: np.ndarray, right: np.ndarray) -> None:
        self.left, self.right = left.tolist(), right.tolist()
        self.merged = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right)) if a != i}
        self.ids = {t: i for i, t in enumerate(tokens) if t}
        self.size = [len(t) for t in tokens]
        #: The lengths of the tokens that end in two given bytes, longest first.
        ends: dict[bytes, set[int]] = {}
        for t in tokens:
            if len(t) > 1:
                ends.setdefault(t[-2:], set()).add(len(t))
        self.lengths = {e: sorted(n, reverse=True) for e, n in ends.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def follows(self, a: int, b: int) -> bool:
        """Whether merging text that encodes to ... a | b ... would leave the border between them."""
        got = self.fits.get((a, b))
        if got is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            got = self.fits[a, b] = self._follows(a, b)
        return got

    def _follows(self, a: int, b: int) -> bool:
        limit, left, right, merged = 1 << 31, self.left, self.right, self.merged
        while True:
            joined = merged.get((a, b))
            if joined is not None and joined < limit:
                return False
            if a > b:  # undo the later of the two merges beside the border
                inner = right[a]
                if inner != a:
                    limit, a = a, inner
                    continue
                inner = left[b]
                if inner == b:
                    return True
                limit, b = b + 1, inner
            else:
                inner = left[b]
                if inner != b:
                    limit, b = b + 1, inner
                    continue
                inner = right[a]
                if inner == a:
                    return True
                limit, a = a, inner

    def add(self, words: list[str]) -> None:
        """Encode words that aren't known yet, depth first along their trie."""
        coded = sorted((w.encode("utf-8", "surrogatepass"), w) for w in words)
        ids, size, lengths, follows, known = self.ids, self.size, self.lengths, self.follows, self.known
        state = [-1]  # the last token of each prefix of the current path
        before = b""
        for word, text in coded:
            whole = ids.get(word)
            if whole is not None:
                known[text] = whole.to_bytes(4, "little")
                continue
            shared, most = 0, min(len(word), len(before))
            if word[:most] == before[:most]:
                shared = most
            else:
                while word[shared] == before[shared]:
                    shared += 1
            del state[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                found = ids[word[end - 1 : end]]
                if end > 1:
                    for n in lengths.get(word[end - 2 : end], ()):
                        if n <= end and (token := ids.get(word[end - n : end])) is not None and (n == end or follows(state[end - n], token)):
                            found = token
                            break
                state.append(found)
            before = word
            out, at = [], len(word)
            while at:
                out.append(state[at])
                at -= size[state[at]]
            known[text] = np.array(out[::-1], np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the offsets of the texts."""
        if len(self.known) > WORDS:
            self.known.clear()
        known, split = self.known, WORD.findall
        words = [split(t) if t else [] for t in texts]
        new = {w for row in words for w in row if w not in known}
        self.add(list(new))
        parts = [b"".join([known[w] for w in row]) for row in words]
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
        return np.frombuffer(b"".join(parts), np.int32), offsets


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str, broadcast) -> Encoder:
    """One encoder in each Python worker; it keeps its words from task to task."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(*broadcast.value)
    return _ENCODERS[path]


def _ids(path: str, broadcast, counting: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, broadcast)
        for big in batches:
            for start in range(0, big.num_rows, 1000):  # bounds the ids held at once
                batch = big.slice(start, 1000)
                values, offsets = encoder.encode(batch.column(batch.num_columns - 1).to_pylist())
                if counting:
                    new, name = pa.array(np.diff(offsets), pa.int64()), "n_tokens"
                else:
                    new, name = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)), "ids"
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], new], names=[*batch.schema.names[:-1], name])

    return run


def _run(frame: DataFrame, keys: list[str], text: str | Column, path: str, counting: bool) -> DataFrame:
    shared = frame.sparkSession.sparkContext.broadcast(load(path))
    text = F.col(text) if isinstance(text, str) else text
    picked = frame.select(*keys, text.cast("string").alias("__text"))
    types = dict(picked.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "n_tokens bigint" if counting else "ids array<int>"])
    return picked.mapInArrow(_ids(path, shared, counting), schema)


def encode(documents: DataFrame, path: str, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """The keys and ``ids`` of every row."""
    return _run(documents, keys or ["doc_id"], text, path, False)


def count(documents: DataFrame, path: str, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """The keys and ``n_tokens`` of every row."""
    return _run(documents, keys or ["doc_id"], text, path, True)
