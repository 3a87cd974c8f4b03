"""Markup files as node tables.

One file is parsed in one task; everything after that works on the table. Nodes are numbered in
pre-order, so a subtree is the number range node_id..end_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_TAG = "#text"
ROWS_PER_BATCH = 20_000
# HTML elements that never have content.
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
NODE_COLUMNS = (
    "node_id long, parent_id long, end_id long, pos long, depth long, tag string, "
    "attrs map<string,string>, text string, tag_path array<string>"
)


class _Nodes:
    """Rows of one document, filled by parser events."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.open: list[int] = []
        self.children: list[int] = [0]

    def _add(self, tag: str, attrs: dict | None, text: str | None) -> int:
        number = len(self.rows)
        parent = self.open[-1] if self.open else None
        path = [self.rows[i][5] for i in self.open]
        self.rows.append([number, parent, number, self.children[-1], len(self.open), tag, attrs, text, path])
        self.children[-1] += 1
        return number

    def start(self, tag: str, attrs: dict) -> None:
        self.open.append(self._add(tag, attrs, None))
        self.children.append(0)

    def end(self, tag: str) -> None:
        if tag not in (self.rows[i][5] for i in self.open):
            return
        while self.open:
            top = self.open.pop()
            self.children.pop()
            self.rows[top][2] = len(self.rows) - 1
            if self.rows[top][5] == tag:
                return

    def data(self, text: str) -> None:
        last = self.rows[-1] if self.rows else None
        parent = self.open[-1] if self.open else None
        if last is not None and last[5] == TEXT_TAG and last[1] == parent:
            last[7] += text
        elif text:
            self._add(TEXT_TAG, None, text)

    def finish(self) -> list[list]:
        for number in self.open:
            self.rows[number][2] = len(self.rows) - 1
        return self.rows


def parse_html(text: str) -> list[list]:
    nodes = _Nodes()
    parser = HTMLParser(convert_charrefs=True)

    def start(tag, attrs):
        nodes.start(tag, {k: v or "" for k, v in attrs})
        if tag in VOID_TAGS:
            nodes.end(tag)

    parser.handle_starttag = start
    parser.handle_startendtag = lambda tag, attrs: (
        nodes.start(tag, {k: v or "" for k, v in attrs}),
        nodes.end(tag),
    )
    parser.handle_endtag = nodes.end
    parser.handle_data = nodes.data
    parser.feed(text)
    parser.close()
    return nodes.finish()


def parse_xml(text: str) -> list[list]:
    """Well-formed XML; external entities are never read. A broken file gives no rows."""
    nodes = _Nodes()
    parser = expat.ParserCreate()
    parser.SetParamEntityParsing(expat.XML_PARAM_ENTITY_PARSING_NEVER)
    parser.ExternalEntityRefHandler = lambda *_: 1
    parser.buffer_text = True
    parser.StartElementHandler = nodes.start
    parser.EndElementHandler = nodes.end
    parser.CharacterDataHandler = nodes.data
    try:
        parser.Parse(text.encode("utf-8"), True)
    except expat.ExpatError:
        return []
    return nodes.finish()


PARSERS = {"html": parse_html, "xml": parse_xml}


def node_table(docs: DataFrame, id_col: str, text_col: str, kind: str = "xml") -> DataFrame:
    """Nodes of whole documents: (id, node_id, parent_id, end_id, pos, depth, tag, attrs, text, tag_path)."""
    parse = PARSERS[kind]
    names = [c.split()[0] for c in NODE_COLUMNS.split(", ")]

    def frame(rows: list[list]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[id_col, *names])
        out["parent_id"] = out["parent_id"].astype("Int64")
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[list] = []
        for batch in batches:
            for doc, text in zip(batch[id_col], batch[text_col]):
                rows += [[doc, *row] for row in parse(text or "")]
                if len(rows) >= ROWS_PER_BATCH:
                    yield frame(rows)
                    rows = []
        if rows:
            yield frame(rows)

    id_type = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {id_type}, {NODE_COLUMNS}")


def read_markup(spark, folder: str, glob: str = "*.xml", kind: str = "xml") -> DataFrame:
    """Node table of a folder of markup files, one file per document."""
    files = (
        spark.read.option("wholetext", True)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .text(folder)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )
    return node_table(files, "path", "content", kind)
