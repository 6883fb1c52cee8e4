"""Visible text of HTML pages, laid out in blocks, lists and tables.

A small tree builder reads tags, text, comments and raw-text elements in one
pass, with the implied end tags of paragraphs, list items, table parts,
options and ``head``, which ends at the first text or tag that does not belong
in it; unclosed and stray tags are closed or dropped.  The renderer walks
the tree without recursion (deeply nested pages are fine) and emits all
visible text: white space is collapsed except in ``pre``, blocks stand on
their own lines with a blank line around paragraphs and headings, list items
get a bullet or their number and the indent of their depth, table cells are
padded to the width of their column.

Hidden is what a browser does not render: ``head`` except its title, scripts,
styles, templates, data lists, what ``noscript``, frames, ``audio``, ``video``
and ``canvas`` hold for browsers without them, titles, descriptions, metadata
and definitions of ``svg``, annotations of ``math``, the ``hidden`` attribute,
``display:none`` and ``visibility:hidden`` styles, and hidden inputs.  The text
of ``svg`` and ``math`` is visible, and so is that of ``object``, which is
rendered where its data is not.

Pages are independent rows in Arrow batches; nothing is shuffled.  Defined
results: a null or empty page has empty text; text without tags comes back
collapsed; repeated rows are rendered one by one; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element sets of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "script style template noscript iframe noembed noframes audio video canvas datalist head "
    "annotation annotation-xml".split()
)
SVG_HIDDEN = frozenset(
    "title desc metadata defs symbol clippath mask marker pattern lineargradient "
    "radialgradient filter".split()
)
# A start tag of another element closes an open head.
IN_HEAD = frozenset(
    "base basefont bgsound link meta noframes noscript script style template title head".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure hr".split())
BLOCK = SPACED | frozenset(
    "html body address article aside div dd dt details summary fieldset figcaption footer form "
    "header li main nav section tr caption legend option title optgroup select textarea "
    "center".split()
)
# A start tag closes these open elements, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
P_CLOSERS = BLOCK - {"html", "body", "tr", "caption", "option", "optgroup", "title", "legend"}
TABLE_ENDS = frozenset("table thead tbody tfoot tr td th body html".split())
SCOPES = frozenset("table td th caption button html template".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\r\f\v]+")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        found = ATTRIBUTE.findall(self.attrs)
        return {k.lower(): html.unescape(v.strip("\"'")) for k, v in reversed(found)}


def parse(page: str) -> Node:
    """The element tree; text is kept as strings between the nodes."""
    root = Node("#root")
    stack = [root]
    at = 0

    def text(upto: int, end: int) -> None:
        if upto < end:
            raw = page[upto:end]
            if stack[-1].tag == "head" and raw.strip(" \t\n\f\r"):
                del stack[-1]
            stack[-1].kids.append(html.unescape(raw) if "&" in raw else raw)

    def close(tags, scope) -> None:
        """Close the nearest of ``tags`` that is open below ``scope``."""
        deepest = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in scope:
                break
            if stack[i].tag in tags:
                deepest = i
        if deepest is not None:
            del stack[deepest:]

    position = 0
    while True:
        match = TOKEN.search(page, position)
        if match is None:
            break
        text(at, match.start())
        at = position = match.end()
        name = match.group(2)
        if name is None:
            continue  # comment, doctype, processing instruction
        tag = name.lower()
        if match.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("td", "th", "table") and tag not in TABLE_ENDS:
                    break  # an end tag inside a cell closes nothing outside
            continue
        if stack[-1].tag == "head":
            if tag == "head":
                continue  # a second one in the first
            if tag not in IN_HEAD:
                del stack[-1]
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in P_CLOSERS:
            close({"p"}, SCOPES)
        node = Node(tag, match.group(3))
        stack[-1].kids.append(node)
        if tag in VOID or match.group(3).endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>|\Z", re.I).search(page, at)
            raw = page[at : end.start()]
            if raw:
                node.kids.append(html.unescape(raw) if tag in ("textarea", "title") else raw)
            at = position = end.end()
            continue
        stack.append(node)
    text(at, len(page))
    return root


def hidden(node: Node) -> bool:
    if node.tag in HIDDEN:
        return True
    if not node.attrs or node.attrs == "/":
        return False
    attributes = node.attributes()
    return (
        "hidden" in attributes
        or (node.tag == "input" and attributes.get("type", "").lower() == "hidden")
        or INVISIBLE.search(attributes.get("style", "")) is not None
    )


class Sheet:
    """Lines under construction: inline text flows, blocks break."""

    def __init__(self):
        self.lines: list[str] = []
        self.flow: list[str] = []
        self.blank = False  # a blank line is due before the next text

    def put(self, text: str) -> None:
        self.flow.append(text)

    def end_line(self) -> None:
        line = SPACE.sub(" ", "".join(self.flow)).strip(" ")
        self.flow.clear()
        if line:
            self.add(line)

    def add(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines.append(line)

    def space(self) -> None:
        self.end_line()
        self.blank = True

    def text(self) -> list[str]:
        self.end_line()
        return self.lines


def layout(root: Node) -> list[str]:
    """The lines of a tree.  An explicit stack of (node, next kid) frames;
    list items and table cells render to sheets of their own."""
    sheets = [Sheet()]
    frames: list[list] = [[root, 0, None]]  # node, next kid, state
    while frames:
        frame = frames[-1]
        node, i, state = frame
        if i < len(node.kids):
            frame[1] += 1
            kid = node.kids[i]
            if isinstance(kid, str):
                if state == "pre":
                    head, *rest = kid.expandtabs(8).split("\n")
                    sheets[-1].flow.append(head)
                    for line in rest:
                        _pre_line(sheets[-1])
                        sheets[-1].flow.append(line)
                else:
                    sheets[-1].put(kid)
                continue
            if kid.tag == "head":
                titles = [k for k in kid.kids if isinstance(k, Node) and k.tag == "title"]
                frames.append([_group(titles), 0, None])
                continue
            tag = kid.tag
            if hidden(kid) or tag in SVG_HIDDEN and any(f[0].tag == "svg" for f in frames):
                continue
            if tag == "text" and any(f[0].tag == "svg" for f in frames):
                sheets[-1].put(" ")  # each has a place of its own
            if tag == "br":
                _pre_line(sheets[-1]) if state == "pre" else _break(sheets[-1])
            elif tag == "hr":
                sheets[-1].space()
            elif tag == "img":
                alt = kid.attributes().get("alt")
                if alt:
                    sheets[-1].put(alt)
            elif tag == "input":
                value = kid.attributes().get("value")
                if value:
                    sheets[-1].put(f" {value} ")
            else:
                _open(kid, sheets, frames, state)
            continue
        frames.pop()
        _close(node, state, sheets, frames)
    return sheets[0].text()


def _group(kids) -> Node:
    node = Node("#group")
    node.kids = kids
    return node


def _break(sheet: Sheet) -> None:
    if sheet.flow and "".join(sheet.flow).strip():
        sheet.end_line()


def _pre_line(sheet: Sheet) -> None:
    line = "".join(sheet.flow).rstrip()
    sheet.flow.clear()
    if line or sheet.lines and not sheet.blank:
        sheet.add(line)


def _open(node: Node, sheets, frames, state) -> None:
    tag = node.tag
    if tag in SPACED and not (tag in ("ul", "ol") and _in_item(frames)):
        sheets[-1].space()
    elif tag in BLOCK:
        sheets[-1].end_line()
    new = "pre" if tag in ("pre", "textarea") or state == "pre" else None
    if tag in ("li", "td", "th", "table"):
        sheets.append(Sheet())
        new = {"rows": []} if tag == "table" else new
    elif tag == "tr":
        new = {"cells": []}
    elif tag == "ol":
        new = {"n": 0}
    frames.append([node, 0, new])


def _in_item(frames) -> bool:
    return any(f[0].tag == "li" for f in frames)


def _nearest(frames, key: str):
    for frame in reversed(frames):
        if isinstance(frame[2], dict) and key in frame[2]:
            return frame[2][key]
        if frame[0].tag == "table" and key != "rows":
            return None
    return None


def _close(node: Node, state, sheets, frames) -> None:
    tag = node.tag
    if tag == "pre" or state == "pre" and tag == "textarea":
        _pre_line(sheets[-1])
        sheets[-1].blank = True
    elif tag == "li":
        lines = sheets.pop().text()
        if lines:
            mark = _item_mark(frames)
            sheets[-1].add(mark + lines[0])
            for line in lines[1:]:
                sheets[-1].add(" " * len(mark) + line if line else "")
    elif tag in ("td", "th"):
        lines = sheets.pop().text()
        cells = _nearest(frames, "cells")
        if cells is None:  # outside a row
            for line in lines:
                sheets[-1].add(line)
        else:
            cells.append(lines)
    elif tag == "tr":
        rows = _nearest(frames, "rows")
        if rows is not None:
            sheets[-1].end_line()
            rows.append(state["cells"])
        else:
            for cell in state["cells"]:
                for line in cell:
                    sheets[-1].add(line)
    elif tag == "table":
        lines = sheets.pop().text() + _aligned(state["rows"])
        for line in lines:
            sheets[-1].add(line)
        sheets[-1].blank = True
    elif tag in SPACED and not (tag in ("ul", "ol") and _in_item(frames)):
        sheets[-1].space()
    elif tag in BLOCK:
        sheets[-1].end_line()


def _item_mark(frames) -> str:
    for frame in reversed(frames):
        if frame[0].tag == "ol" and isinstance(frame[2], dict):
            frame[2]["n"] += 1
            return f"{frame[2]['n']}. "
        if frame[0].tag in ("ul", "menu"):
            break
    return "- "


def _aligned(rows: list[list[list[str]]]) -> list[str]:
    """Rows of cells as lines: columns padded to their widest cell, cells of
    several lines side by side."""
    rows = [r for r in rows if any(r)]
    widths: list[int] = []
    for row in rows:
        for c, cell in enumerate(row):
            widths[c:c] = [0] * (c + 1 - len(widths))
            widths[c] = max(widths[c], max(map(len, cell), default=0))
    lines = []
    for row in rows:
        for k in range(max(map(len, row))):
            parts = [(cell[k] if k < len(cell) else "").ljust(w) for cell, w in zip(row, widths)]
            lines.append("  ".join(parts).rstrip())
    return lines


def page_text(page: str | None) -> str:
    return "\n".join(layout(parse(page))).strip("\n") if page else ""


def visible_text(
    pages: DataFrame, html_col: str = "html", id_col: str = "page_id"
) -> DataFrame:
    """``(id, text, n_chars, n_lines)`` of every page."""
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [page_text(p.as_py()) for p in batch.column(1)]
            chars = np.array([len(t) for t in texts], np.int64)
            lines = np.array([t.count("\n") + 1 if t else 0 for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(chars), pa.array(lines)],
                names=["id", "text", "n_chars", "n_lines"],
            )

    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {id_type}, text string, n_chars long, n_lines long")
