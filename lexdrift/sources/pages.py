"""Judgment pages to numbered paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The marks of the page formats.
SECTIONS = {"MO": "grounds", "DI": "operative"}
OPERATIVE = re.compile(r"On\s+those\s+grounds", re.IGNORECASE)
NUMBER = re.compile(r"^(\d+)\s*[.\s\xa0]")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
PARAGRAPH = "para_id string, para_num string, section string, text string"
#: Pages whose paragraphs a task holds at a time.
PAGES = 128


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        """This node and those below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
            else:
                stack += reversed(item.children)
        return "".join(out)


class Tree(HTMLParser):
    """A forgiving tree: what is left open ends with its parent, a paragraph ends where a block begins."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})

    def handle_starttag(self, tag, attrs):
        tag = tag.rpartition(":")[2]
        if tag in CLOSES_P:
            self.leave("p", {"td", "th", "table", "body"})
        elif tag in ("td", "th", "tr", "li"):
            self.leave(tag, {"table", "ul", "ol"} | ({"tr"} if tag in ("td", "th") else set()))
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag.rpartition(":")[2] not in VOID and self.at.parent is not None:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        self.leave(tag.rpartition(":")[2], {"body"} if tag == "p" else set())

    def leave(self, tag: str, within: set[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            if node.tag in within:
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        if self.at.tag not in ("script", "style"):
            self.at.children.append(data)


def parse(page: str) -> Node:
    tree = Tree()
    tree.feed(page)
    tree.close()
    return tree.root


def collapsed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def variant(root: Node) -> str | None:
    """Prefix of the count class where the first mark in document order is one; None for the anchor format, which is also the fallback."""
    for node in root.walk():
        if node.tag == "a" and node.attrs.get("name") in SECTIONS:
            return None
        if node.tag == "p":
            kind = node.attrs.get("class", "")
            if "coj-count" in kind:
                return "coj-"
            if kind == "count":
                return ""
    return None


def by_anchors(root: Node) -> Iterator[tuple[str, str, str]]:
    """(number, section, text) of paragraphs that begin with a number; the section is the last anchor's."""
    section = "other"
    for node in root.walk():
        if node.tag == "a" and node.attrs.get("name") in SECTIONS:
            section = SECTIONS[node.attrs["name"]]
        elif node.tag == "p":
            text = collapsed(node.text())
            if (m := NUMBER.match(text)) and (rest := text[m.end() :].strip()):
                yield m[1], section, rest


def by_classes(root: Node, prefix: str) -> Iterator[tuple[str, str, str]]:
    """(number, section, text) of table rows with a number cell; all is operative once the marker was met, in the row itself too."""
    count, normal = f"{prefix}count", f"{prefix}normal"
    operative = False
    for node in root.walk():
        kind = node.attrs.get("class", "")
        if node.tag != "p":
            continue
        if count not in kind:
            operative = operative or (normal in kind and OPERATIVE.search(collapsed(node.text())) is not None)
            continue
        number, cell = node.text().strip().rstrip("."), node.parent
        if not number.isdigit() or cell is None or cell.tag != "td" or cell.parent is None or cell.parent.tag != "tr":
            continue
        other = next((c for c in cell.parent.children if isinstance(c, Node) and c.tag == "td" and c is not cell), None)
        if other is None:
            continue
        parts = [t for p in other.walk() if p.tag == "p" and normal in p.attrs.get("class", "") and (t := collapsed(p.text()))]
        operative = operative or any(OPERATIVE.search(t) for t in parts)
        if parts:
            yield number, "operative" if operative else "grounds", " ".join(parts)


def paragraphs(page: str | None, celex: str | None) -> list[dict]:
    root = parse(page or "")
    prefix = variant(root)
    found = by_anchors(root) if prefix is None else by_classes(root, prefix)
    return [{"para_id": f"{celex}_{'OP' if s == 'operative' else 'P'}{int(n):04d}", "para_num": n, "section": s, "text": t} for n, s, t in found]


def summary_only(page: str | None) -> bool:
    """A notice without grounds: a listNotice block, but neither the grounds' anchor nor numbered paragraphs."""
    notice = False
    for node in parse(page or "").walk():
        kind = node.attrs.get("class", "")
        if node.tag == "a" and node.attrs.get("name") == "MO" or node.tag == "p" and ("coj-count" in kind or kind == "count"):
            return False
        notice = notice or (node.tag == "div" and "listNotice" in kind)
    return notice


def parse_pages(pages: DataFrame, key: str = "celex", html: str = "html") -> DataFrame:
    """``key``, para_idx, para_id, para_num, section, text, ref_cases, ref_oj of each numbered paragraph; a page without any gives no row."""

    kind = pages.schema[key].dataType.simpleString()
    found = pages.select(key, F.col(key).cast("string").alias("__name"), F.col(html).alias("__html")).mapInArrow(parsed_batches, f"`{key}` {kind}, para_idx int, {PARAGRAPH}")
    none = F.array().cast("array<string>")
    return found.withColumns({"ref_cases": none, "ref_oj": none})


def parsed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, name, page) to (key, para_idx, para_id, para_num, section, text): what is held are the paragraphs of ``PAGES`` pages, not of a whole batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES):
            part = batch.slice(at, PAGES)
            found = [paragraphs(page.as_py(), name.as_py()) for name, page in zip(part.column(1), part.column(2))]
            columns = {f: pa.array([p[f] for own in found for p in own], pa.string()) for f in ("para_id", "para_num", "section", "text")}
            keys = part.column(0).take(pa.array([k for k, own in enumerate(found) for _ in own], pa.int64()))
            places = pa.array([k for own in found for k in range(len(own))], pa.int32())
            yield pa.RecordBatch.from_arrays([keys, places, *columns.values()], [batch.schema.names[0], "para_idx", *columns])


def flag_summaries(pages: DataFrame, html: str = "html") -> DataFrame:
    @F.pandas_udf("boolean")
    def flag(body: pd.Series) -> pd.Series:
        return body.map(summary_only)

    return pages.withColumn("summary_only", flag(F.col(html)))


def best_language(pages: DataFrame, languages: list[str], key: str = "celex", lang: str = "lang") -> DataFrame:
    """Each key's page in the first language that it has."""
    known = pages.where(F.col(lang).isin(languages))
    place = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col(lang))
    return known.groupBy(key).agg(F.min_by(F.struct(*[c for c in pages.columns if c != key]), place).alias("p")).select(key, "p.*")


def to_fetch(index: DataFrame, done: DataFrame, key: str = "celex", max_items: int = 0) -> DataFrame:
    """Keys not yet landed; ``max_items`` 0 means all."""
    left = index.select(key).distinct().join(done.select(key), key, "left_anti")
    return left.orderBy(key).limit(max_items) if max_items else left
