"""Page boilerplate around the body of web documents (problem 7).

Method: a site style tree.  The pages of one site are merged line by line: a content node is a line's letters (numbers,
blanks and the operator's name left out, look-alike signs and markup undone), a presentation node is the frame that
numbers stand in.  The importance of a content node is one minus the entropy of its distribution over the site's pages,
in units of the logarithm of their number: a line that stands on all pages has importance 0, one on a single page 1.
Lines of low importance on any site of enough pages go on every page.  Lines that are the title of another page of the
site, also after a label, name other articles, and so do lines of the frames that many titles share; the page's own title
is the one that is kept.  A path goes with its first step.

Counts are distinct documents per (site, node), pre-aggregated; nodes travel as hashes.  The frames kept are those in
at least FRAME_SHARE of the titles, so there are at most (frames per title) / FRAME_SHARE of them.

Defined results: only blocks of documents with file_type html, with text, not of type code, table or image, have cases;
a null site is taken from the document, and without one the page counts as a site of its own name ''; lines without
letters are body; repeated rows count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.lookalikes import Normalizer
from blockloom.llm.markup import Tree, render
from blockloom.tables import ensure_checkpoint_dir

#: Importance at or below which a node is boilerplate, and the pages a site must have it on.
IMPORTANCE, LEAST_PAGES, LEAST_SHARE = 0.55, 3, 0.02
FRAME_SHARE = 0.002
#: The most names of operators one automaton may hold; it is read from the table of hosts and sent to every task.
MOST_NAMES = 1_000_000
_NUMBER = re.compile(r"[0-9０-９]+(?:[/.-][0-9０-９]+)*")
_SECTION = re.compile(r"^\s*(?:#{1,6}\s+)?(?:\d{1,2}\. |[一二三四五六七八九十]{1,3}、)")
_STEP = re.compile(r"\s(?:>|›|»|/|\||·|→)\s")
_SENTENCE = re.compile(r"[。！？]|[.!?] [A-ZÀ-Þ]|[.;；]$")
_BOLD = re.compile(r"^\s*'''(.+?)'''\s+\[\[[^\]]*\]\]\s*$")
_LABEL = re.compile(r"[^:：0-9]{2,40}[:：] ?(?=\S)")
_MARKUP = re.compile(r"[<\[{*\\#'&~`]")


def frames(title: str) -> set[str]:
    """The frames numbers stand in: four signs before (from the start on) and one after (or the end)."""
    text = "\x02" + _NUMBER.sub("0", " ".join(title.lower().split())) + "\x03"
    return {text[max(0, m.start() - 4) : m.end() + 1] for m in re.finditer("0", text) if m.start() > 1}


def _letters(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalpha())


def _key(text: str | bytes) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


class Lines:
    """The nodes of a block's lines."""

    def __init__(self, names: list[str], known: set[str]) -> None:
        self.normal, self.known = Normalizer(), known
        self.names = ahocorasick.Automaton()  # one pass over a line, however many names there are
        for n in {" ".join(n.lower().split()) for n in names if n and n.strip()}:
            self.names.add_word(n, len(n))
        self.names.make_automaton()

    def plain(self, line: str) -> str:
        if not line.isascii():
            line = self.normal.one(line)[0]
        if _MARKUP.search(line):
            tree = Tree(line)
            if tree.nodes:
                line = render(line, tree, "paragraph")[0]
        return " ".join(line.split())

    def cut(self, line: str) -> tuple[str, bool]:
        """A line in lower case without operators' names (the longest at each place), and whether it had any."""
        low, out, at = line.lower(), [], 0
        if not len(self.names):
            return low, False
        for end, n in self.names.iter_long(low):
            out += [low[at : end + 1 - n], " "]
            at = end + 1
        return "".join([*out, low[at:]]), at > 0

    def node(self, line: str) -> str:
        return _letters(self.cut(line)[0])

    def of(self, line: str) -> tuple[int | None, int | None, bool, bool, bool, int, int | None]:
        """(node, node of the first step of a path, names the site's operator, names an article, is a section's heading, key for titles, key of what a label stands before)."""
        plain = self.plain(line)
        rest, named = self.cut(plain)
        node = _letters(rest)
        if not node:
            if named:
                node = "\x00name"
            else:
                return None, None, False, False, False, 0, None
        steps = _STEP.split(plain, maxsplit=1)
        first = self.node(steps[0]) if len(steps) > 1 else ""
        article = not _SENTENCE.search(plain) and not _SECTION.match(plain) and not self.known.isdisjoint(frames(plain))
        if article and len(steps) == 1 and (m := re.match(r"([^:：0-9]{4,40})[:：] ?(?=.*[0-9])", plain)):
            first = self.node(m[1])
        if named:
            node += "\x00"  # it speaks of the operator
        bold = _BOLD.match(line)
        label = _LABEL.match(plain)
        return _key(node), _key(first) if first else None, node[-1] == "\x00", article, bool(_SECTION.match(plain)), title_key(self.plain(bold[1]) if bold else plain), title_key(plain[label.end() :]) if label else None


def title_key(title: str) -> int:
    return _key("".join(c for c in title.lower() if c.isalnum()).encode("utf-8", "surrogatepass"))


def _count_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()
    for batch in batches:
        for t in batch.column(0).to_pylist():
            if t and t.strip():
                seen.update(frames(t))
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["frame", "n"])


def title_frames(documents: DataFrame) -> set[str]:
    """The frames in at least FRAME_SHARE of all titles; there can't be more of them than frames per title / FRAME_SHARE."""
    counts = documents.select("title").mapInArrow(_count_frames, "frame string, n bigint").groupBy("frame").agg(F.sum("n").alias("n"))
    total = documents.where("trim(title) <> ''").count()
    return {r.frame for r in counts.where((F.col("n") >= max(2.0, FRAME_SHARE * total)) & (F.col("frame") != "")).select("frame").collect()}


def _nodes(names: list[str], known: set[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = Lines(names, known)
        memo: dict = {}
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            src = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for no, line in enumerate(text.split("\n")):
                    if line not in memo:
                        if len(memo) > 100_000:
                            memo.clear()
                        memo[line] = lines.of(line)
                    got = memo[line]
                    if got[0] is not None:
                        src.append(i)
                        for c, v in zip(cols, (no, *got)):
                            c.append(v)
            at = pa.array(src, pa.int64())
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
            keep = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*keep.take(at).columns, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[*keep.schema.names, "line_no", "node", "first", "operator", "article", "section", "tkey", "lkey"])

    return run


def _pages(documents: DataFrame) -> DataFrame:
    """(document_id, site, title) of the web documents, one row each."""
    return documents.where("lower(file_type) = 'html'").groupBy("document_id").agg(F.coalesce(F.max("site"), F.lit("")).alias("page_site"), F.max("title").alias("title"))


def nodes(blocks: DataFrame, documents: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per line with letters: its nodes, and whether it is the page's own title."""
    names = [r.org_name for r in sites.where("trim(org_name) <> ''").select("org_name").distinct().limit(MOST_NAMES + 1).collect()]
    if len(names) > MOST_NAMES:
        raise ValueError(f"the table of hosts holds more than {MOST_NAMES} names")
    ours = blocks.where(F.col("text").isNotNull() & ~F.coalesce(F.col("block_type"), F.lit("")).isin("code", "table", "image"))
    ours = ours.select("document_id", "block_id", "block_order", F.col("block_type").eqNullSafe("heading").alias("heading"), F.coalesce("heading_level", F.lit(0)).alias("level"), "text")
    rows = ours.join(_pages(documents).select("document_id", "page_site"), "document_id")
    schema = "document_id string, block_id string, block_order int, heading boolean, level int, page_site string, line_no int, node bigint, first bigint, operator boolean, article boolean, section boolean, tkey bigint, lkey bigint"
    return rows.select("document_id", "block_id", "block_order", "heading", "level", "page_site", "text").mapInArrow(_nodes(names, title_frames(documents)), schema)


def unimportant(lines: DataFrame) -> DataFrame:
    """(node): content nodes whose importance is low on some site."""
    once = lines.select("page_site", "node", "document_id").union(lines.where("first is not null").select("page_site", F.col("first").alias("node"), "document_id")).groupBy("page_site", "node", "document_id").agg(F.lit(1).alias("one"))
    pages = lines.groupBy("page_site", "document_id").agg(F.lit(1).alias("one")).groupBy("page_site").agg(F.count("one").alias("m"))
    on = once.groupBy("page_site", "node").agg(F.count("one").alias("n")).where(F.col("n") >= LEAST_PAGES).join(pages, "page_site")
    importance = 1 - F.log(F.col("n").cast("double")) / F.log(F.greatest("m", F.lit(LEAST_PAGES + 1)).cast("double"))
    low = on.where((importance <= IMPORTANCE) & (F.col("n") >= LEAST_SHARE * F.col("m"))).select("node")
    # A body doesn't speak of the page's operator: such a node needs only to recur, on whatever sites.
    named = lines.where("operator").groupBy("node").agg(F.min("document_id").alias("a"), F.max("document_id").alias("b")).where("a <> b").select("node")
    return low.union(named).distinct()


def _title_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    normal = Normalizer()
    for batch in batches:
        keys = [title_key(normal.one(t)[0]) if t and t.strip() else None for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64())], names=["document_id", "own"])


def _titles(documents: DataFrame) -> DataFrame:
    """(page_site, own, one, other): title keys of each site, with two of the documents that have them (the same one if it is alone)."""
    keys = documents.where("lower(file_type) = 'html'").select("document_id", "title").mapInArrow(_title_keys, "document_id string, own bigint").where("own is not null")
    return keys.join(_pages(documents).select("document_id", "page_site"), "document_id").groupBy("page_site", "own").agg(F.min("document_id").alias("one"), F.max("document_id").alias("other"))


def classified(blocks: DataFrame, documents: DataFrame, sites: DataFrame) -> DataFrame:
    """(document_id, block_id, line_no, boilerplate) of every line with letters."""
    ensure_checkpoint_dir(blocks.sparkSession)
    lines = nodes(blocks, documents, sites).checkpoint()  # four parts of the plan read it
    low = unimportant(lines).withColumn("low", F.lit(True))
    own = _pages(documents).select("document_id", "title").mapInArrow(_title_keys, "document_id string, own bigint")
    rows = lines.join(low, "node", "left").join(low.select(F.col("node").alias("first"), F.col("low").alias("path")), "first", "left").join(own, "document_id", "left")
    titles = _titles(documents)
    for key, name in (("tkey", "named"), ("lkey", "labelled")):
        other = titles.select("page_site", F.col("own").alias(key), F.col("one").alias("__one"), F.col("other").alias("__other"))
        is_other = (F.col("__one") != F.col("document_id")) | (F.col("__other") != F.col("document_id"))
        rows = rows.join(other, ["page_site", key], "left").withColumn(name, F.coalesce(is_other, F.lit(False))).drop("__one", "__other")
    rows = rows.withColumn("article", F.col("article") | F.col("named") | F.col("labelled"))
    rows = rows.withColumn("is_own", F.coalesce(F.col("tkey") == F.col("own"), F.lit(False)))
    page = Window.partitionBy("document_id").orderBy("block_order", "block_id", "line_no")
    whole = Window.partitionBy("document_id")
    rows = rows.dropDuplicates(["document_id", "block_id", "line_no"])
    article = F.col("article") & F.col("first").isNull() & ~F.col("labelled")
    rows = rows.withColumn("plain", article)
    alone = F.col("plain") & ~F.lag("plain", 1, False).over(page)
    # The page's own title: the line that repeats the title of record; where none does (it is missing or garbled), the top
    # heading, else the line before the first section, else one that stands alone.
    score = (
        F.when(F.col("is_own"), 4).when(F.col("plain") & F.col("heading") & (F.col("level") == 1), 3)
        .when(alone & F.lead("section", 1, False).over(page), 2).when(alone & ~F.lead("plain", 1, False).over(page), 1).otherwise(0)
    )
    rows = rows.withColumn("score", score).withColumn("best", F.max("score").over(whole))
    title = (F.col("score") > 0) & (F.col("score") == F.col("best"))
    other = F.col("article") & ~title
    path = F.coalesce("path", F.lit(False))
    return rows.select("document_id", "block_id", "line_no", ((F.coalesce("low", F.lit(False)) & ~title) | other | (path & ~title & ~F.col("section"))).alias("boilerplate"))


def found(blocks: DataFrame, documents: DataFrame, sites: DataFrame) -> DataFrame:
    """The rows of p7_found."""
    return classified(blocks, documents, sites).where("boilerplate").select("block_id", "line_no").distinct()


def body(blocks: DataFrame, documents: DataFrame, sites: DataFrame) -> DataFrame:
    """(document_id, block_id, block_order, text): the blocks of web documents with only the body's lines."""
    cut = found(blocks, documents, sites).groupBy("block_id").agg(F.collect_set("line_no").alias("cut"))
    once = blocks.join(_pages(documents).select("document_id"), "document_id", "left_semi").select("document_id", "block_id", "block_order", "text").dropDuplicates(["block_id"])
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    kept = F.filter(lines, lambda s: ~F.array_contains("cut", s.i)).x
    out = once.join(cut, "block_id", "left").withColumn("kept", F.when(F.col("cut").isNotNull(), kept))
    return out.where("kept is null or size(kept) > 0").select("document_id", "block_id", "block_order", F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("text"))
