"""Filling word-processing templates: paragraphs of a file, and its placeholders replaced by a document's lines."""

from __future__ import annotations

import copy
import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.functions.types import BINARY, STRINGS
from gleanwork.operators.documents import PLACEHOLDER, TOKENS

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DC = "{http://purl.org/dc/elements/1.1/}"
MAIN, CORE = "word/document.xml", "docProps/core.xml"
DECORATION = re.compile("[^\\S ]|[☀-➿\U0001f000-\U0001faff]")


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """``path, content, paragraphs`` of template files."""
    return spark.read.format("binaryFile").load(path).select("path", "content", docx_paragraphs("content").alias("paragraphs"))


def _body(content: bytes) -> ET.Element:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return ET.fromstring(z.read(MAIN))


def _text(p: ET.Element) -> str:
    return "".join(t.text or "" for t in p.iter(f"{W}t"))


@F.pandas_udf(STRINGS)
def docx_paragraphs(content: pd.Series) -> pd.Series:
    return content.map(lambda x: None if x is None else [_text(p) for p in _body(bytes(x)).iter(f"{W}p")])


def _set_runs(p: ET.Element, bold: str, rest: str) -> None:
    """One run for the bold start and one for the rest, in the paragraph's first run's format."""
    runs = p.findall(f"{W}r")
    model = copy.deepcopy(runs[0]) if runs else ET.Element(f"{W}r")
    for r in runs:
        p.remove(r)
    for text, is_bold in ((bold, True), (rest, False)):
        if not text:
            continue
        run = ET.SubElement(p, f"{W}r")
        form = model.find(f"{W}rPr")
        form = copy.deepcopy(form) if form is not None else ET.Element(f"{W}rPr")
        for b in form.findall(f"{W}b"):
            form.remove(b)
        if is_bold:
            ET.SubElement(form, f"{W}b")
        run.append(form)
        ET.SubElement(run, f"{W}t", {"{http://www.w3.org/XML/1998/namespace}space": "preserve"}).text = text


def _no_space_after(p: ET.Element) -> None:
    form = p.find(f"{W}pPr")
    if form is None:
        form = ET.Element(f"{W}pPr")
        p.insert(0, form)
    spacing = form.find(f"{W}spacing")
    if spacing is None:
        spacing = ET.SubElement(form, f"{W}spacing")
    spacing.set(f"{W}after", "0")


def fill(template: bytes, blocks: dict[str, list[tuple[str, str]]], strings: dict[str, str], photo: bool = False) -> bytes:
    """The template with its content tokens expanded and its locale keys resolved.

    ValueError names content tokens that it lacks, or keys without a string.
    Lines inside an entry have no space after them. Without ``photo`` pictures
    are left out. Pictographs and odd white space go.
    """
    root = _body(template)
    parents = {c: p for p in root.iter() for c in p}
    slots = {found[1]: p for p in root.iter(f"{W}p") if (found := re.fullmatch(PLACEHOLDER, _text(p).strip()))}
    if missing := [t for t in TOKENS if t not in slots]:
        raise ValueError(f"placeholders are missing: {', '.join(missing)}")
    for token in TOKENS:
        slot, lines = slots[token], blocks.get(token, [])
        holder = parents[slot]
        at = list(holder).index(slot)
        holder.remove(slot)
        for i, (bold, rest) in enumerate(lines):
            p = copy.deepcopy(slot)
            _set_runs(p, bold, rest)
            if i + 1 < len(lines) and not lines[i + 1][0]:
                _no_space_after(p)
            holder.insert(at + i, p)
    texts = list(root.iter(f"{W}t"))
    if unknown := sorted({k for t in texts for k in re.findall(PLACEHOLDER, t.text or "")} - set(strings)):
        raise ValueError(f"no locale string for: {', '.join(unknown)}")
    for t in texts:
        t.text = re.sub(PLACEHOLDER, lambda m: strings[m[1]], t.text or "")
    if not photo:
        for run in [r for r in root.iter(f"{W}r") if r.find(f"{W}drawing") is not None]:
            for d in run.findall(f"{W}drawing"):
                run.remove(d)
    for p in root.iter(f"{W}p"):
        own = list(p.iter(f"{W}t"))
        if any(DECORATION.search(t.text or "") for t in own):
            for t in own:
                t.text = DECORATION.sub("", t.text or "")
            for t in own:
                t.text = (t.text or "").lstrip()
                if t.text:
                    break
    name = next((s for p in root.iter(f"{W}p") if (s := _text(p).strip())), "CV")
    return _written(template, root, name)


def _written(template: bytes, root: ET.Element, name: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(template)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for entry in old.infolist():
            data = old.read(entry)
            if entry.filename == MAIN:
                data = ET.tostring(root, encoding="utf-8", xml_declaration=True)
            elif entry.filename == CORE:
                core = ET.fromstring(data)
                for tag, value in ((f"{DC}title", f"{name} - CV"), (f"{DC}creator", name)):
                    node = core.find(tag)
                    (node if node is not None else ET.SubElement(core, tag)).text = value
                data = ET.tostring(core, encoding="utf-8", xml_declaration=True)
            new.writestr(zipfile.ZipInfo(entry.filename, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def render(lines: DataFrame, template: bytes, key: str = "id", strings: str = "strings", photo: bool = False) -> DataFrame:
    """``key, docx`` of each document, from its lines (``key, token, pos, bold, rest``) and locale map."""

    @F.pandas_udf(BINARY)
    def made(rows: pd.Series, texts: pd.Series) -> pd.Series:
        def one(r, s) -> bytes:  # noqa: ANN001
            blocks: dict[str, list[tuple[str, str]]] = {}
            for x in r:
                blocks.setdefault(x["token"], []).append((x["bold"], x["rest"]))
            return fill(template, blocks, dict(s))

        return pd.Series([one(r, s) for r, s in zip(rows, texts, strict=True)])

    whole = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("token", "pos", "bold", "rest"))).alias("_l"), F.first(strings).alias("_s"))
    return whole.select(key, made("_l", "_s").alias("docx"))
