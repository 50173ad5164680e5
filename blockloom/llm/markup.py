"""Markup residue in block text: finding it and turning it into clean, structured text (problem 2).

A block's text is read by one tolerant grammar for HTML, Markdown, wiki and LaTeX markup into a tree of nodes (element,
emphasis, heading, list, item, table, row, cell, code, formula, link, quote, note, comment, line break) whose leaves
are the text slots.  A block is a case if its tree has a markup node.  The clean text is rendered from the tree:
headings, lists, tables, code and formulas stay as such, and the block type follows a tree that is one structure.

The method named for this problem, wrapper induction over aligned page trees, works on whole pages of one template; what
is left here are fragments inside single blocks, most of them without a second fragment of the same shape on their host,
so it can't decide them; the README says so.  The grammar needs no second page and gives the same result for any order
and partition of the rows.

Defined results: null text and blocks of type code are no cases and stay as they are; empty text is no case; texts of
any length are read whole in linear time (a closing sign is looked for once where there is none); repeated rows give equal
results.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm import lookalikes
from blockloom.llm.lookalikes import Normalizer

_TAGS = (
    "a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure font footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark math meta meter nav noscript ol option p pre q s samp script section select small "
    "span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video ref references nowiki gallery wbr o:p"
).split()
_INLINE = re.compile(
    r"(?P<sup><sup>(?P<raised>[0-9n+-]+)</sup>)"
    r"|(?P<comment><!--)"
    rf"|(?P<tag></?(?:{'|'.join(sorted(_TAGS, key=len, reverse=True))})(?:\s[^<>]*)?/?>)"
    r"|(?P<entity>&(?:[a-zA-Z][a-zA-Z0-9]{1,9}|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});)"
    r"|(?P<fence>^```[^\n`]*\n[\s\S]*?(?:\n```[ \t]*$|\Z))"
    r"|(?P<env>\\begin\{(?P<envname>[a-zA-Z]+\*?)\})"
    r"|(?P<cmd>\\(?P<cmdname>textbf|textit|texttt|emph|underline|textsc|section|subsection|subsubsection|chapter|paragraph|title|caption|footnote|cite|citep|citet|ref|eqref|label|url|href|mbox|text)\*?\{(?P<arg>[^{}]*)\})"
    r"|(?P<item>\\item\b)"
    r"|(?P<escape>\\[%&#_{}$])"
    r"|(?P<formula>\$\$[^$]+\$\$|\$[^$\n]+\$|\\[(\[])"
    r"|(?P<image>!\[(?P<alt>[^\]\[\n]*)\]\((?P<src>[^()\s]+)[^()\n]*\))"
    r"|(?P<link>\[(?P<label>[^\]\[\n]+)\]\((?P<url>[^()\s]+)[^()\n]*\))"
    r"|(?P<wikilink>\[\[(?P<target>[^\]\[|\n]+)(?:\|(?P<shown>[^\]\[\n]*))?\]\])"
    r"|(?P<template>\{\{(?P<tbody>[^{}]*)\}\})"
    r"|(?P<wikitable>^[ \t]*\{\|)"
    r"|(?P<wbold>'{2,5})"
    r"|(?P<bold>\*\*(?=\S)(?P<btext>[^*\n]+?)(?<=\S)\*\*|(?<![\w_])__(?=\S)(?P<utext>[^_\n]+?)(?<=\S)__(?![\w_]))"
    r"|(?P<strike>~~(?=\S)(?P<stext>[^~\n]+?)~~)"
    r"|(?P<code>`(?P<ctext>[^`\n]+)`)"
    r"|(?P<footnote>\[\^[\w-]{1,20}\]:?)",
    re.M,
)
_LINE = re.compile(
    r"^(?:(?P<h>[ \t]{0,3}#{1,6}[ \t]+(?P<htext>[^\n]*))|(?P<wh>(?P<eq>={2,6})[ \t]*(?P<whtext>[^=\n][^\n]*)(?P=eq))|(?P<quote>>[ \t]?(?P<qtext>[^\n]*))"
    r"|(?P<box>[ \t]*[-*+][ \t]+\[[ xX]\][ \t]+(?P<xtext>[^\n]*))|(?P<star>[ \t]*\*+[ \t]+(?P<ltext>[^\n]*\S[^\n]*))|(?P<dash>[ \t]*[-+][ \t]+(?P<dtext>[^\n]*[^\W\d_][^\n]*))|(?P<row>\|(?P<cells>[^\n]*)\|)|(?P<under>(?:={3,}|-{3,}(?=\n|\Z))))[ \t]*$"
)
_MATHS = re.compile(r"\\[a-zA-Z]|[_^]\{")
_ENDS = re.compile(r"\\end\{([a-zA-Z]+\*?)\}")
#: What is open until its closing sign, wherever that is.
_CLOSING = {"<!--": "-->", "\\(": "\\)", "\\[": "\\]", "{|": "|}"}
_DASH = re.compile(r"^[ \t]*[-+][ \t]+\S*[^\W\d_]")
_RULE_ROW = re.compile(r"^\|[ \t:|-]*-{2,}[ \t:|-]*\|?$")
_SUP = str.maketrans("0123456789+-n", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻ⁿ")
#: JVM side: a text without any of these signs has no markup node.
MAY_HOLD = r"[<&*`\[{\\$#|>]|__|''|==|~~|(?m:^[ \t]*[-+][ \t]+\S)"


class Tree:
    """Markup nodes of one text, in order: (kind, start, end, what it renders to)."""

    def __init__(self, text: str) -> None:
        self.nodes: list[tuple[str, int, int, str]] = []
        self.text = text
        self.nowhere: set[str] = set()  # closing signs that don't come any more
        self.ends: dict[str, list[int]] | None = None
        at = 0
        while m := _INLINE.search(text, at):
            end = self._inline(m)
            at = m.start() + 1 if end is None else max(end, m.start() + 1)
        self._lines(text)

    def _closed(self, opening: str, start: int, least: int = 0) -> int:
        """Where the closing sign of what opens before ``start`` begins, -1 if nowhere: each sign is missed once only."""
        sign = _CLOSING[opening]
        if sign in self.nowhere:
            return -1
        at = self.text.find(sign, start + least)
        if at < 0:
            self.nowhere.add(sign)
        return at

    def _end_of(self, name: str, start: int) -> int:
        """Where the environment of a name ends that begins before ``start``, -1 if nowhere."""
        if self.ends is None:
            self.ends = {}
            for m in _ENDS.finditer(self.text):
                self.ends.setdefault(m[1], []).append(m.start())
        places = self.ends.get(name, [])
        k = bisect_left(places, start)
        return places[k] if k < len(places) else -1

    def _inline(self, m: re.Match) -> int | None:
        """Adds the node that begins here and gives its end; None if there is none."""
        end = m.end()
        for kind in ("sup", "comment", "tag", "entity", "fence", "env", "cmd", "item", "escape", "formula", "image", "link", "wikilink", "template", "wikitable", "wbold", "bold", "strike", "code", "footnote"):
            if m[kind] is not None:
                break
        new = ""
        if kind == "sup":
            kind, new = "tag", m["raised"].translate(_SUP)
        elif kind == "comment":
            if (at := self._closed("<!--", end)) < 0:
                return None
            end = at + 3
        elif kind == "tag":
            new = self._tag(m["tag"])
        elif kind == "entity":
            new = html.unescape(m["entity"]).replace("\xa0", " ")
            if new == m["entity"]:
                return end
        elif kind == "fence":
            new = "\n".join(m["fence"].rstrip().split("\n")[1:]).removesuffix("```").rstrip("\n")
        elif kind == "env":
            if (at := self._end_of(m["envname"], end)) < 0:
                return None
            kind, new = self._environment(m["envname"], self.text[end:at])
            end = at + len(m["envname"]) + 6
        elif kind == "cmd":
            name = m["cmdname"]
            new = "" if name in ("cite", "citep", "citet", "ref", "eqref", "label") else m["arg"]
            kind = "heading" if "section" in name or name in ("chapter", "title") else "cmd"
        elif kind == "item":
            new = "- "
        elif kind == "escape":
            new = m["escape"][1:]
        elif kind == "formula":
            new = m["formula"]
            if new in _CLOSING:
                if (at := self._closed(new, end, 1)) < 0:
                    return None
                end = at + 2
                new = self.text[m.start() : end]
            elif new[:2] != "$$" and not _MATHS.search(new):
                return None
        elif kind == "image":
            new = m["alt"]
        elif kind == "link":
            new = m["label"]
        elif kind == "wikilink":
            new = m["shown"] or m["target"]
        elif kind == "template":
            parts = [p for p in m["tbody"].split("|")[1:] if "=" not in p]
            new = parts[-1] if parts else ""
        elif kind == "wikitable":
            if (at := self._closed("{|", end)) < 0:
                return None
            kind, new, end = "table", self._wikitable(self.text[end:at]), at + 2
        elif kind == "bold":
            new = m["btext"] or m["utext"]
        elif kind == "strike":
            new = m["stext"]
        elif kind == "code":
            new = m["ctext"]
        self.nodes.append((kind, m.start(), end, new))
        return end

    @staticmethod
    def _tag(tag: str) -> str:
        name, closing = re.match(r"</?([a-zA-Z0-9:]+)", tag)[1].lower(), tag[1] == "/"
        if name == "br" or name in ("p", "div", "ul", "ol", "table", "tr", "blockquote", "section", "article") and closing:
            return "\n"
        if name == "li":
            return "\n" if closing else "- "
        if name in ("td", "th"):
            return " | " if closing else ""
        if name == "ref":
            return ")" if closing else " ("
        return ""

    @staticmethod
    def _environment(name: str, body: str) -> tuple[str, str]:
        if name.rstrip("*") in ("equation", "align", "gather", "displaymath", "math", "eqnarray"):
            return "formula", "$$" + body.strip() + "$$"
        if name in ("verbatim", "lstlisting"):
            return "code", body.strip("\n")
        if name in ("itemize", "enumerate"):
            return "list", "\n".join("- " + x.strip() for x in body.split("\\item")[1:])
        if name in ("tabular", "table", "longtable"):
            rows = (r.replace("\\hline", "").strip() for r in body.split("\\\\"))
            return "table", "\n".join(" | ".join(c.strip() for c in r.split("&")) for r in rows if r)
        return "env", body.strip()

    @staticmethod
    def _wikitable(body: str) -> str:
        rows, row = [], []
        for line in body.split("\n"):
            line = line.strip()
            if line.startswith("|-") or line.startswith("|+"):
                rows, row = rows + [row] * bool(row), [line[2:].strip()] if line.startswith("|+") else []
            elif line[:1] in ("|", "!"):
                row += [c.strip() for c in re.split(r"\|\||!!", line[1:])]
            elif "|+" in line:
                row = [line.split("|+", 1)[1].strip()]
        return "\n".join(" | ".join(r) for r in [*rows, row] if any(r))

    def _lines(self, text: str) -> None:
        taken, at, before = [(a, b) for _, a, b, _ in self.nodes], 0, ""
        lines = text.split("\n")
        ruled = any(_RULE_ROW.match(x.strip()) for x in lines)
        k = 0
        dashes = sum(_DASH.match(x) is not None for x in lines) > 1  # one alone is a sign of punctuation
        for i, line in enumerate(lines):
            start, at = at, at + len(line) + 1
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            if k < len(taken) and taken[k][0] < start:  # inside fenced code, an environment or a table
                before = line
                continue
            m = _LINE.match(line)
            if m:
                add = lambda kind, new: self.nodes.append((kind, start, start + len(line), new))  # noqa: E731,B023
                if m["h"] is not None:
                    add("heading", m["htext"].rstrip(" \t#"))
                elif m["wh"] is not None:
                    add("heading", m["whtext"].rstrip(" \t"))
                elif m["quote"] is not None and (line[1:2] in (" ", "\t", "") or len(line) > 1 and line[1] not in "=<>0123456789"):
                    add("quote", m["qtext"])
                elif m["box"] is not None:
                    add("list", "- " + m["xtext"])
                elif m["star"] is not None:
                    add("list", "- " + m["ltext"])
                elif m["dash"] is not None and dashes:
                    add("list", "- " + m["dtext"])
                elif m["row"] is not None and ruled:
                    add("table", "" if _RULE_ROW.match(line.strip()) else " | ".join(c.strip() for c in m["cells"].split("|")))
                elif m["under"] is not None and i and before.strip() and line[0] == "=" and len(before) < 200:
                    add("heading", "")
            before = line

    def kinds(self) -> list[str]:
        return sorted({k for k, *_ in self.nodes})


def render(text: str, tree: Tree, block_type: str, depth: int = 1) -> tuple[str, str]:
    """The clean text of a tree, and the block type that fits it."""
    lines = {n for n in tree.nodes if n[0] in ("heading", "quote", "list", "table") and (n[1] == 0 or text[n[1] - 1] == "\n")}
    inline = sorted((n for n in tree.nodes if n not in lines), key=lambda n: (n[1], -n[2]))

    starts = [n[1] for n in inline]

    def clean(part: str, base: int) -> str:
        out, at = [], 0
        for _kind, a, b, new in inline[bisect_left(starts, base) : bisect_left(starts, base + len(part))]:
            a, b = a - base, b - base
            if a < at or b > len(part):
                continue
            out += [part[at:a], new]
            at = b
        return "".join([*out, part[at:]])

    out, at = [], 0
    for kind, a, b, new in sorted(lines, key=lambda n: n[1]):
        if a < at:
            continue
        out.append(clean(text[at:a], at))
        line = text[a:b]
        off = line.find(new) if new and kind in ("heading", "quote") else -1
        body = clean(line[off : off + len(new)], a + off) if off >= 0 else _again(new)
        out.append(body if kind != "table" or body or b - a > 400 else "")
        at = b
    out.append(clean(text[at:], at))
    if depth and "entity" in tree.kinds():  # escaped markup
        more = Tree("".join(out))
        if "tag" in more.kinds():
            return render("".join(out), more, block_type, 0)
    done = re.sub(r"(?<![ \t])[ \t]+\n", "\n", "".join(out))
    done = re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\| *(?=\n|$)", "", done.replace("~", " ") if any(k in ("cmd", "env") for k in tree.kinds()) else done)).strip()
    kinds = set(tree.kinds())
    whole = len(lines) == len(tree.nodes) and not done.count("\n") or "heading" in kinds and "\n" not in done
    if block_type == "paragraph":
        if "heading" in kinds and whole and len(kinds - {"heading"}) == 0:
            block_type = "heading"
        elif kinds == {"list"} and all(x.startswith("- ") for x in done.split("\n")):
            block_type = "list_item"
        elif kinds == {"fence"} and text.lstrip().startswith("```") and text.rstrip().endswith("```"):
            block_type = "code"
        elif kinds <= {"table"} and text.startswith(("|", "{|")) and text.rstrip().endswith(("|", "|}")):
            block_type = "table"
    return done, block_type


def _again(text: str) -> str:
    out, at = [], 0
    for _, a, b, new in sorted(Tree(text).nodes, key=lambda n: (n[1], -n[2])) if text else ():
        if a >= at:
            out += [text[at:a], new]
            at = b
    return "".join([*out, text[at:]])


def _seen(texts: list[str | None]) -> list[str | None]:
    """Texts as a reader sees them: invisible and look-alike signs would hide markup."""
    normal, out = Normalizer(), list(texts)
    for i in normal.rows(texts).tolist():
        out[i] = normal.one(texts[i])[0]
    return out


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [i for i, t in enumerate(_seen(batch.column(1).to_pylist())) if t and Tree(t).nodes]
        yield batch.select(["block_id"]).take(pa.array(keep, pa.int64()))


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(b, *render(t, tree, kind), tree.kinds()) for b, t, kind in zip(batch.column(0).to_pylist(), _seen(batch.column(1).to_pylist()), batch.column(2).to_pylist()) if (tree := Tree(t)).nodes]
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.string()))], names=["block_id", "text", "block_type", "nodes"])


def _candidates(blocks: DataFrame) -> DataFrame:
    kind = F.coalesce("block_type", F.lit("paragraph"))
    hidden = ~F.col("text").rlike(lookalikes.PLAIN)  # signs that can't be seen may stand inside markup
    return blocks.where((kind != "code") & (F.col("text").rlike(MAY_HOLD) | hidden)).select("block_id", "text", kind.alias("block_type"))


def found(blocks: DataFrame) -> DataFrame:
    """The rows of p2_found."""
    return _candidates(blocks).mapInArrow(_found, "block_id string").distinct()


def clean(blocks: DataFrame) -> DataFrame:
    """(block_id, text, block_type, nodes) of the blocks that held markup, in clean form."""
    return _candidates(blocks).mapInArrow(_cleaned, "block_id string, text string, block_type string, nodes array<string>").distinct()
