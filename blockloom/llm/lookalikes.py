"""Bringing visually identical text to one form (problem 6).

Method.  Texts with any sign outside the plain ones are exploded to positioned code points; a broadcast mapping (code
point to its decomposition, look-alike or removal) is joined to the positions; combining marks are put in order of their
class within their base's run; bases and marks are recomposed; the strings are rebuilt from the positions.  All of it
are joins and aggregates of the JVM.  Two mappings depend on the neighbours: a joiner is kept inside an emoji, and a
letter of another script is replaced only within a word that has Latin letters.

Finding cases needs the positions but no strings: what joins the mapping is a case, so only positions that can be in it
are exploded, and nothing but the cases is shuffled.

The mapping is built by rule from the Unicode character database; letters that look like Latin ones come from the
public look-alike table (Unicode TR 39) that the JVM's ICU library holds, besides a short list.  It has a row for some
of the signs of the Unicode range, so its size is bounded.

``Normalizer`` gives the same form text by text; other operators of this package use it inside their own pass.

Defined results: null stays null and is no case, empty text is no case; a null element of heading_path stays null;
texts of any length are processed whole; ordinary full-width punctuation, dashes, curly quotes, raised figures,
fractions, circled numbers, whole words of other scripts and symbols are kept.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.llm import mojibake
from blockloom.llm.arrow import code_points
from blockloom.llm.letters import LATIN_LOOKALIKES

#: Signs that can't be seen. Fixed values.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩ㅤ︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️﻿ﾠ"
HYPHENS = "‐‑⁃﹣－"
NONE, DROP, MAP, MARK, LETTER = 0, 1, 2, 3, 4
_JOINERS = {0x200D, 0xFE0E, 0xFE0F}


@cache
def mapping() -> tuple[np.ndarray, dict[int, str]]:
    """What to do with each code point, and its replacement."""
    kind, to = np.zeros(0x110000, np.uint8), {}
    for c in INVISIBLE:
        kind[ord(c)] = DROP
    for c in HYPHENS:
        kind[ord(c)], to[ord(c)] = MAP, "-"
    for cp in range(0x80, 0x30000):
        if kind[cp] or 0xD800 <= cp < 0xF900:
            continue
        c = chr(cp)
        cat, how = unicodedata.category(c), unicodedata.decomposition(c)
        if cat == "Zs":
            kind[cp], to[cp] = MAP, " "
        elif cat == "Mn" and 0x300 <= cp < 0x370:
            kind[cp] = MARK
        elif how:
            tag, new = how.split()[0], unicodedata.normalize("NFKC", c)
            letters = cat[0] == "L" or cat == "Nd"
            if tag in ("<wide>", "<narrow>") and letters and new != c or tag == "<font>" and letters:
                kind[cp], to[cp] = MAP, new
            elif 0xFB00 <= cp <= 0xFB06 or cp in (0x132, 0x133, 0x1C7, 0x1C8, 0x1C9, 0x1CA, 0x1CB, 0x1CC, 0x1F1, 0x1F2, 0x1F3):
                kind[cp], to[cp] = MAP, new
            elif 0x2E80 <= cp <= 0x2FDF or 0xF900 <= cp <= 0xFAFF or 0x2F800 <= cp <= 0x2FA1F:
                kind[cp], to[cp] = MAP, new
    return kind, to


@cache
def look_alikes() -> dict[str, str]:
    """Letters of other scripts and the Latin letter each looks like: the short list, then the table of the JVM's ICU library.
    On the driver only."""
    out, spark = dict(LATIN_LOOKALIKES), SparkSession.active()
    others = [
        c for c in map(chr, range(0x250, 0x20000))
        if unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lo", "Nl") and not unicodedata.decomposition(c) or "\u2160" <= c <= "\u217f"
    ]
    others = [c for c in others if not ("\u2e80" <= c < "\ua490" or "\uac00" <= c < "\ufb00" or "\uff00" <= c < "\ufff0" or "\U00017000" <= c < "\U0001b300")]
    like = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(others)).split("\n")
    for c, s in zip(others, like):
        s = "I" if s == "l" and unicodedata.category(c) == "Lu" else "m" if s == "rn" else s
        if len(s) == 1 and s.isascii() and s.isalpha():
            out.setdefault(c, s)
    return out


def _latin(c: str) -> bool:
    return c.isascii() and c.isalpha() or "À" <= c <= "ɏ" and c.isalpha() or "Ａ" <= c <= "ｚ" or "\U0001d400" <= c <= "\U0001d7ff"


def _in_word(c: str) -> bool:
    """Letters and invisible signs, except where words have no borders (East Asian scripts)."""
    return (c.isalpha() or c in INVISIBLE or "\u2160" <= c <= "\u2188") and not ("\u2e80" <= c < "\ua4d0" or "\uac00" <= c < "\ufb00" or c >= "\U00020000")


def _emoji(c: str) -> bool:
    return c >= "\U0001f000" and not "\U00020000" <= c <= "\U0003ffff" or "☀" <= c <= "➿" or c in "️‍"


class Normalizer:
    """One consistent form of texts; positions whose sign is replaced or dropped are the evidence."""

    def __init__(self, letters: dict[str, str] | None = None) -> None:
        kind, self.to = mapping()
        self.letters = LATIN_LOOKALIKES if letters is None else letters
        self.kind = kind.copy()
        self.kind[[ord(c) for c in self.letters]] = LETTER

    def rows(self, texts: list[str | None]) -> np.ndarray:
        """Texts with any sign of the mapping."""
        codes, offsets = code_points(texts)
        hit = self.kind[np.minimum(codes, 0x10FFFF)] != NONE
        return np.unique(np.searchsorted(offsets, np.flatnonzero(hit), "right") - 1)

    def one(self, text: str) -> tuple[str, bool]:
        """The text in its consistent form, and whether it held a case."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kind[np.minimum(codes, 0x10FFFF)]
        signs, case = list(text), False
        for i in np.flatnonzero(kinds).tolist():
            kind, cp = kinds[i], int(codes[i])
            if kind == DROP:
                if cp in _JOINERS and i and _emoji(text[i - 1]) and (cp != 0x200D or i + 1 < len(text) and _emoji(text[i + 1])):
                    continue
                signs[i], case = "", True
            elif kind == MAP:
                signs[i], case = self.to[cp], True
            elif kind == LETTER and self.in_latin_word(text, i):
                signs[i], case = self.letters[text[i]], True
        if (kinds == MARK).any():
            new = self.recomposed("".join(signs))
            return new, case or new != "".join(signs)
        return "".join(signs), case

    def in_latin_word(self, text: str, i: int) -> bool:
        """Letters of the word around a position: some are Latin, and the rest all look like Latin ones."""
        a, b = i, i + 1
        while a and _in_word(text[a - 1]):
            a -= 1
        while b < len(text) and _in_word(text[b]):
            b += 1
        word = text[a:b]
        return any(map(_latin, word)) and all(_latin(c) or c in self.letters or c in INVISIBLE for c in word)

    @staticmethod
    def recomposed(text: str) -> str:
        """Marks in order of their class within each base's run, then base and marks as one where there is such a sign."""
        out: list[str] = []
        base = -1
        for c in text:
            cls = unicodedata.combining(c)
            if not cls:
                base = len(out)
                out.append(c)
                continue
            at = len(out)
            while at > base + 1 and unicodedata.combining(out[at - 1]) > cls:
                at -= 1
            out.insert(at, c)
        done: list[str] = []
        for c in out:
            if done and unicodedata.combining(c) and len(joined := unicodedata.normalize("NFC", done[-1] + c)) == 1:
                done[-1] = joined
            else:
                done.append(c)
        return "".join(done)


#: Everything outside these signs, which no mapping touches, sends a text to the operator.
PLAIN = "^[\\x00-\\x7e\\u00a1-\\u00ac\\u00ae-\\u02ff\\u2012-\\u2027\\u2030-\\u203a\\u20ac\\u3001-\\u3002\\u3008-\\u3015\\u4e00-\\u9fff\\uff01-\\uff0c\\uff1a\\uff1b\\uff1f]*+$"


_LIKE, _HIDDEN = "\x01", "\x02"
_LATIN = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\uff21-\uff3a\uff41-\uff5a\x{1d400}-\x{1d7cb}"
_IN_WORD = r"[\p{L}\u2160-\u2188\x01\x02&&[^\u2e80-\ua4cf\uac00-\ufaff\x{20000}-\x{3ffff}]]"
#: A whole word of Latin letters, look-alikes and invisible signs, of the first two at least one each, in a text as _marked gives it.
_MIXED = rf"(?:^|[^{_IN_WORD}])(?={_IN_WORD}*[{_LATIN}])(?=[^\x01]*\x01)(?={_IN_WORD}*\x01)[{_LATIN}\x01\x02]*+(?!{_IN_WORD})"
_EMOJI = r"^[\x{1f000}-\x{1ffff}\x{e0000}-\x{10ffff}\u2600-\u27bf\ufe0f\u200d]$"


def _marked(value: Column) -> Column:
    """A text with one sign for all look-alike letters and one for all invisible signs."""
    alike = "".join(look_alikes())
    return F.translate(value, _LIKE + _HIDDEN + alike + INVISIBLE, "  " + _LIKE * len(alike) + _HIDDEN * len(INVISIBLE))


def mapping_table(spark: SparkSession) -> DataFrame:
    """(c, to, class): the sign put in place of c ('' drops it), or the class of a combining mark (0 for others)."""
    kind, to = mapping()
    rows = [(chr(c), "" if kind[c] == DROP else chr(c) if kind[c] == MARK else to[c], unicodedata.combining(chr(c)) if kind[c] == MARK else 0) for c in np.flatnonzero(kind).tolist() if kind[c] != LETTER]
    return spark.createDataFrame(pa.table({"c": [r[0] for r in rows], "to": [r[1] for r in rows], "class": pa.array([r[2] for r in rows], pa.int32())}))


@cache
def _composed() -> dict[str, str]:
    """Base and mark to the one sign they make."""
    marks, out = [chr(c) for c in range(0x300, 0x370)], {}
    for c in map(chr, range(0xC0, 0x2000)):
        pair = unicodedata.normalize("NFC", unicodedata.normalize("NFD", c))
        how = unicodedata.decomposition(c).split()
        if pair == c and len(how) == 2 and chr(int(how[1], 16)) in marks:
            out[chr(int(how[0], 16)) + chr(int(how[1], 16))] = c
    return out


def _place(x: Column, i: Column) -> Column:
    return F.struct(i.alias("i"), x.alias("c"), F.get("__c", i - 1).alias("before"), F.get("__c", i + 1).alias("after"))


def _signs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The positioned code points of ``value`` with their neighbours."""
    chars = rows.select(*keys, F.split("value", "").alias("__c"))
    return chars.select(*keys, F.explode(F.transform("__c", _place)).alias("__s")).select(*keys, "__s.*")


def _odd_signs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """As _signs, but only those beyond the usual signs, which may be mapped, and one _LIKE for a text with a word of mixed letters."""
    usual = lambda c: (c < "\x7f") | (c >= "\u00c0") & (c < "\u0250") | (c >= "\u4e00") & (c < "\ua000") | (c >= "\u3001") & (c < "\u3003")
    chars = rows.select(*keys, F.split("value", "").alias("__c"), _marked(F.col("value")).rlike(_MIXED).alias("__mixed"))
    at = F.filter(F.transform("__c", lambda x, i: F.when(~usual(x), i)), lambda i: i.isNotNull())
    word = F.slice(F.array(_place(F.lit(_LIKE), F.lit(-9))), F.lit(1), F.col("__mixed").cast("int"))
    return chars.select(*keys, F.explode(F.concat(F.transform(at, lambda i: _place(F.get("__c", i), i)), word)).alias("__s")).select(*keys, "__s.*")


def _joins() -> Column:
    """Whether a joiner stands inside an emoji."""
    emoji = lambda c: F.coalesce(F.col(c).rlike(_EMOJI), F.lit(False))
    return F.col("c").isin(*(chr(j) for j in _JOINERS)) & emoji("before") & ((F.col("c") != "\u200d") | emoji("after"))


def cases(values: DataFrame) -> DataFrame:
    """The other columns of the rows whose ``value`` holds a case."""
    spark, keys = values.sparkSession, [c for c in values.columns if c != "value"]
    rows = values.where(F.col("value").isNotNull() & ~F.col("value").rlike(PLAIN))
    table = mapping_table(spark)
    marks = table.where("class > 0").select(F.col("c").alias("before"), F.col("class").alias("class_before"))
    letters = spark.createDataFrame([(_LIKE, "x", 0)], table.schema)
    pairs = spark.createDataFrame([(k[0], k[1], True) for k in _composed()], "before string, c string, composes boolean")
    hits = _odd_signs(rows, keys).join(F.broadcast(table.unionAll(letters)), "c")  # these three: signs of the Unicode range only
    hits = hits.join(F.broadcast(marks), "before", "left").join(F.broadcast(pairs), ["before", "c"], "left")
    moved = F.coalesce(F.col("class_before") > F.col("class"), F.lit(False)) | F.col("composes").isNotNull()
    return hits.where(F.when(F.col("class") > 0, moved).otherwise((F.col("to") != "") | ~_joins())).select(*keys)


def rebuilt(values: DataFrame) -> DataFrame:
    """(key, value): the values of distinct keys in one form, from their positions."""
    spark, alike = values.sparkSession, look_alikes()
    hidden = "".join(f"\\x{{{ord(c):x}}}" for c in INVISIBLE)
    word = rf"[\p{{L}}\u2160-\u2188{hidden}&&[^\u2e80-\ua4cf\uac00-\ufaff\x{{20000}}-\x{{3ffff}}]]"
    pieces = F.regexp_extract_all("value", F.lit(f"({word}+|[^{word}]+)"), F.lit(1))
    latin = F.array_join(F.transform(pieces, lambda w: F.when(_marked(w).rlike(_MIXED), F.translate(w, "".join(alike), "".join(alike.values()))).otherwise(w)), "")
    at = _signs(values.select("key", F.when(_marked(F.col("value")).rlike(_MIXED), latin).otherwise(F.col("value")).alias("value")), ["key"])
    kept = at.join(F.broadcast(mapping_table(spark)), "c", "left")  # signs of the Unicode range only
    to = F.when(F.col("to").isNull() | (F.col("to") == "") & _joins(), F.col("c")).otherwise(F.col("to"))
    kept = kept.select("key", "i", to.alias("to"), F.coalesce("class", F.lit(0)).alias("class")).where("to <> ''")
    base = F.sum(F.when(F.col("class") == 0, 1).otherwise(0)).over(Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    runs = kept.withColumn("base", base).groupBy("key", "base").agg(F.sort_array(F.collect_list(F.struct("class", "i", "to"))).alias("run"))
    pair = F.create_map(*(F.lit(x) for kv in _composed().items() for x in kv))

    def put(done, s):
        one = pair[F.concat(F.right(done, F.lit(1)), s["to"])]
        return F.when((s["class"] > 0) & one.isNotNull(), F.concat(F.substring(done, F.lit(1), F.length(done) - 1), one)).otherwise(F.concat(done, s["to"]))

    text = F.when(F.size("run") == 1, F.col("run")[0]["to"]).otherwise(F.aggregate("run", F.lit(""), put))
    return runs.select("key", "base", text.alias("t")).groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("base", "t"))), lambda s: s["t"]), "").alias("value"))


def normalize(blocks: DataFrame) -> DataFrame:
    """(block_id, text, heading_path), each row once, with every text in one consistent form.  Rows without a sign that
    may be mapped pass as they are; of the others only the values with such signs are taken apart."""
    rows = blocks.select("block_id", "text", "heading_path")
    odd = lambda c: F.coalesce(~c.rlike(PLAIN), F.lit(False))
    some = odd(F.col("text")) | F.coalesce(F.exists("heading_path", odd), F.lit(False))
    changed = rows.where(some).withColumn("key", F.struct("block_id", F.xxhash64("text", "heading_path").alias("h"), F.xxhash64("heading_path", "text").alias("g"))).dropDuplicates(["key"])
    parts = changed.select("key", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("part"), F.col("text").alias("value"))), F.coalesce(F.transform("heading_path", lambda x, i: F.struct(i.alias("part"), x.alias("value"))), F.array()))).alias("p")).select(F.struct("key", "p.part").alias("key"), "p.value")
    new = rebuilt(parts.where(odd(F.col("value"))))
    by = new.select("key.key", F.struct("key.part", "value").alias("p")).groupBy("key").agg(F.map_from_entries(F.collect_list("p")).alias("new"))
    out = changed.join(by, "key", "left").select(
        "block_id", F.coalesce(F.col("new")[-1], F.col("text")).alias("text"), F.transform("heading_path", lambda x, i: F.coalesce(F.col("new")[i], x)).alias("heading_path")
    )
    return rows.where(~some).distinct().unionAll(out)


def found(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """The rows of p6_found: texts that are cases of problem 1 are none."""
    text = blocks.select("block_id", F.lit("text").alias("field"), F.col("text").alias("value"))
    path = blocks.select("block_id", F.lit("heading_path").alias("field"), F.explode("heading_path").alias("value"))
    all_of = cases(text.unionAll(path)).distinct()
    garbled = mojibake.garbled_keys(blocks, documents, text.where(F.col("value").isNotNull() & ~F.col("value").rlike(PLAIN)).select("block_id", "value"))
    return all_of.join(garbled.distinct().withColumn("field", F.lit("text")), ["block_id", "field"], "left_anti")
