"""HTML trees on the standard library's tokenizer, and the UDFs that need one.

Trees exist only inside a UDF call; everything that can be told from flat
columns is left to SQL.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import types as T

from gleanwork.functions.batches import row_udf
from gleanwork.functions.jsonx import first_string, walk_postings, walk_strings
from gleanwork.functions.jsonx import dig as dig_json
from gleanwork.functions.types import BOOLEAN, LONG, STRING, STRINGS, struct, structs

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text inside these is not text of an element around them.
SILENT = frozenset(("script", "style", "template"))
CHROME = frozenset(("script", "style", "noscript", "nav", "header", "footer", "aside", "form", "svg"))
MAX_ANCHORS, MAX_ELEMENTS, MAX_DESCRIPTION = 500, 20_000, 20_000
MIN_TITLE, MAX_TITLE, CARD_DEPTH = 3, 200, 3
SCRIPT_URL = re.compile(r"""https?://[^\s"'<>\\)]+""")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self, skip: frozenset[str] = frozenset()) -> Iterator[Node]:
        """Elements below, in document order; skipped ones with all they hold."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Node) and child.tag not in skip:
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def strings(self, skip: frozenset[str] = SILENT) -> Iterator[str]:
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, str):
                    yield child
                elif child.tag not in skip:
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def text(self, joint: str, skip: frozenset[str] = SILENT) -> str:
        return joint.join(s for x in self.strings(skip) if (s := x.strip()))

    def find(self, *tags: str, skip: frozenset[str] = frozenset()) -> Node | None:
        return next((n for n in self.walk(skip) if n.tag in tags), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = Node(tag, {}, self.at)
        for k, v in attrs:
            node.attrs.setdefault(k, v or "")
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        at: Node | None = self.at
        while at is not None and at.tag != tag:
            at = at.parent
        if at is not None and at.parent is not None:  # an end without a start is ignored
            self.at = at.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def raw_text(node: Node) -> str:
    return "".join(x for x in node.children if isinstance(x, str))


def absolute(base: str, link: str) -> str:
    try:
        return urljoin(base, link)
    except ValueError:
        return link


def json_blocks(root: Node) -> list[object]:
    """Parsed JSON-LD blocks; broken ones are skipped."""
    found = []
    for node in root.walk():
        if node.tag == "script" and node.attrs.get("type") == "application/ld+json":
            try:
                found.append(json.loads(raw_text(node).strip()))
            except ValueError:
                continue
    return found


# --- signals of a page ----------------------------------------------------

PAGE = struct(
    **dict.fromkeys(("canonical_urls", "script_srcs", "iframe_srcs", "form_actions", "link_hrefs", "anchor_urls", "script_urls", "jsonld_strings", "ids", "classes"), STRINGS),
    data_attrs=T.MapType(STRING, STRINGS), meta=T.MapType(STRING, STRING), script_text=STRING, text=STRING, is_job_page=BOOLEAN,
)


def page_signals(html: str | None, url: str | None) -> dict:
    """Every signal collection of a page, one walk over its tree."""
    root, base = parse(html), url or ""
    out: dict = {k: [] for k in ("canonical_urls", "script_srcs", "iframe_srcs", "form_actions", "link_hrefs", "anchor_urls")}
    ids: dict[str, None] = {}
    classes: dict[str, None] = {}
    data: dict[str, dict[str, None]] = {}
    meta: dict[str, str] = {}
    scripts: list[str] = []
    micro = False
    title = None
    sources = {"script": ("src", "script_srcs"), "iframe": ("src", "iframe_srcs"), "form": ("action", "form_actions"), "a": ("href", "anchor_urls")}
    for i, node in enumerate(root.walk()):
        attrs = node.attrs
        if node.tag in sources:
            attr, name = sources[node.tag]
            link = attrs.get(attr, "").strip()
            if link and not (name == "anchor_urls" and len(out[name]) >= MAX_ANCHORS):
                out[name].append(absolute(base, link))
        if node.tag == "link" and (link := attrs.get("href", "").strip()):
            rel = attrs.get("rel", "").lower()
            out["canonical_urls" if "canonical" in rel or "alternate" in rel else "link_hrefs"].append(absolute(base, link))
        if node.tag == "script" and not attrs.get("src"):
            scripts.append(raw_text(node))
        if node.tag == "title" and title is None:
            title = node.text(" ")
        if node.tag == "meta":
            key = attrs.get("name") or attrs.get("property") or attrs.get("itemprop")
            if key and attrs.get("content"):
                meta[key.lower()] = attrs["content"]
        micro = micro or "jobposting" in attrs.get("itemtype", "").lower()
        if i < MAX_ELEMENTS:
            if attrs.get("id"):
                ids[attrs["id"].lower()] = None
            classes.update(dict.fromkeys(x.lower() for x in attrs.get("class", "").split()))
            for k, v in attrs.items():
                if k.startswith("data-"):
                    data.setdefault(k, {})[v.lower()] = None
    if title is not None:
        meta = {"title": title} | meta
    if meta.get("og:url"):
        out["canonical_urls"].append(absolute(base, meta["og:url"]))
    script_text = "\n".join(scripts)
    strings = list(walk_strings(json_blocks(root)))
    return out | {
        "script_urls": list(dict.fromkeys(SCRIPT_URL.findall(script_text.replace("\\/", "/"))))[:MAX_ANCHORS],
        "jsonld_strings": strings, "ids": list(ids), "classes": list(classes), "data_attrs": {k: list(v) for k, v in data.items()}, "meta": meta,
        "script_text": script_text, "text": root.text(" "), "is_job_page": micro or any("jobposting" in s.lower() for s in strings),
    }


extract_page = row_udf(PAGE)(page_signals)


# --- anchors, tables ------------------------------------------------------


def card_title(node: Node) -> str:
    """Heading of fitting length in one of the three elements around an anchor."""
    at = node.parent
    for _ in range(CARD_DEPTH):
        if at is None or not at.tag:
            break
        heading = at.find("h1", "h2", "h3", "h4", "h5")
        if heading is not None and MIN_TITLE <= len(text := heading.text(" ")) <= MAX_TITLE:
            return text
        at = at.parent
    return ""


@row_udf(structs(pos=LONG, url=STRING, label=STRING, card_title=STRING))
def html_anchors(html: str | None, base: str | None) -> list[dict]:
    """Anchors with a href: place, absolute URL, label, and the heading of the card around."""
    found = (n for n in parse(html).walk() if n.tag == "a" and "href" in n.attrs)
    return [{"pos": i, "url": absolute(base or "", n.attrs["href"].strip()), "label": n.text(" "), "card_title": card_title(n)} for i, n in enumerate(found)]


@row_udf(structs(table=LONG, row=LONG, header=STRINGS, cells=STRINGS, hrefs=STRINGS))
def html_table_rows(html: str | None, base: str | None) -> list[dict]:
    """Data rows of each table with its first row's texts as header."""
    rows = []
    for t, table in enumerate(n for n in parse(html).walk() if n.tag == "table"):
        header: list[str] | None = None
        for r, tr in enumerate(n for n in table.walk() if n.tag == "tr"):
            cells = [c.text(" ") for c in tr.walk() if c.tag in ("td", "th")]
            if header is None:
                header = [c.casefold() for c in cells]
                continue
            hrefs = [absolute(base or "", a.attrs["href"].strip()) for a in tr.walk() if a.tag == "a" and "href" in a.attrs]
            rows.append({"table": t, "row": r, "header": header, "cells": cells, "hrefs": hrefs})
    return rows


# --- posting details ------------------------------------------------------


def capped(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", text)[:MAX_DESCRIPTION]


def fragment_text(fragment: object) -> str:
    """Plain text of a description field that may hold escaped HTML."""
    if not isinstance(fragment, str) or not fragment.strip():
        return ""
    return capped(parse(unescape(fragment)).text("\n"))


def place_of(node: dict) -> str | None:
    return first_string(dig_json(node, "jobLocation.address.addressLocality")) or first_string(dig_json(node, "jobLocation.address.addressRegion"))


DETAIL = struct(jsonld=struct(title=STRING, description=STRING, company=STRING, place=STRING), page_title=STRING, main=STRING, body=STRING)


def detail_rungs(html: str | None) -> dict:
    """What each rung of the extraction ladder finds on a posting page."""
    root = parse(html)
    found: dict = {"jsonld": None, "page_title": None, "main": "", "body": ""}
    for node in walk_postings(json_blocks(root)):
        if text := fragment_text(node.get("description")):
            found["jsonld"] = {"title": first_string(node.get("title")), "description": text, "company": first_string(dig_json(node, "hiringOrganization.name")), "place": place_of(node)}
            break
    og = next((n.attrs.get("content") for n in root.walk() if n.tag == "meta" and n.attrs.get("property") == "og:title"), None)
    heading = root.find("h1")
    found["page_title"] = og or (heading.text(" ") if heading is not None else None)
    # page furniture is left out only now: it holds the blocks read above
    main = root.find("main", skip=CHROME) or next((n for n in root.walk(CHROME) if n.attrs.get("role") == "main"), None)
    if main is not None:
        found["main"] = capped(main.text("\n", SILENT | CHROME))
    body = root.find("body", skip=CHROME) or root
    found["body"] = capped(body.text("\n", SILENT | CHROME))
    return found


extract_detail = row_udf(DETAIL)(detail_rungs)


@row_udf(STRING)
def html_unescape(text: str | None) -> str | None:
    return None if text is None else unescape(text)


@row_udf(STRING)
def html_unescape_twice(text: str | None) -> str | None:
    return None if text is None else unescape(unescape(text)).strip()


html_to_text = row_udf(STRING)(fragment_text)


@row_udf(STRING)
def url_join(base: str | None, link: str | None) -> str:
    return absolute(base or "", link or "")
