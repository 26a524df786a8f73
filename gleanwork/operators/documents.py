"""Lines and texts of generated documents; rendering to files is a separate, optional step."""

from __future__ import annotations

import io
import subprocess
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.functions.jsonx import ascii_slug
from gleanwork.functions.text import strip, without_decoration
from gleanwork.functions.types import BINARY
from gleanwork.schemas import CV, VERDICT

# --- fixed values ---
BULLET = "• "
TOKENS = ("CV_INTRODUCTION", "PROFILE_TEXT", "SKILLS_LIST_TEXT", "EXPERIENCES_PLACEHOLDER", "EDUCATION_PLACEHOLDER")
LOCALES = ("en", "fr", "es", "pt")
DEFAULT_LOCALE = "en"
PLACEHOLDER = r"\{([A-Za-z_][A-Za-z0-9_]*)\}"
# --- end of fixed values ---


def _line(bold: Column, rest: Column) -> Column:
    return F.struct(bold.alias("bold"), rest.alias("rest"))


def cv_blocks(cv: Column) -> Column:
    """Array of ``token, lines`` of a document's parsed JSON; a line is its bold start and the rest."""
    nothing = F.lit("")
    skills = F.transform(cv["skills"], lambda g: _line(F.concat(g["competence"], F.lit(": ")), F.array_join(g["skills"], ", ")))
    jobs = F.flatten(F.transform(cv["experiences"], lambda e: F.concat(
        F.array(_line(F.concat_ws(" - ", e["role"], e["company"]), F.concat(F.lit(", "), e["location"], F.lit(" ("), e["start_date"], F.lit(" - "), e["end_date"], F.lit(")")))),
        F.transform(e["bullets"], lambda b: _line(nothing, F.concat(F.lit(BULLET), b))),
    )))
    schools = F.flatten(F.transform(cv["education"], lambda e: F.filter(F.array(
        _line(F.concat_ws(" - ", e["diploma"], e["institution"]), F.concat(F.lit(", "), e["location"], F.lit(" ("), e["period"], F.lit(")"))),
        _line(nothing, e["degree"]),
        F.when(strip(e["details"]) != "", _line(nothing, e["details"])),
    ), lambda x: x.isNotNull())))
    single = lambda name: F.array(_line(nothing, cv[name]))
    return F.array(*[F.struct(F.lit(t).alias("token"), x.alias("lines")) for t, x in zip(TOKENS, (single("cv_introduction"), single("profile_text"), skills, jobs, schools), strict=True)])


def cv_lines(cvs: DataFrame, cv: str = "cv", key: str = "id") -> DataFrame:
    """``key, token, pos, bold, rest, ends_entry`` of each line; an entry ends before the next bold line and at the last."""
    parsed = F.from_json(cv, CV)
    rows = cvs.select(key, F.explode(cv_blocks(parsed)).alias("b")).select(key, F.col("b.token").alias("token"), F.posexplode("b.lines").alias("pos", "line"))
    order = Window.partitionBy(key, "token").orderBy("pos")
    nxt = F.lead(F.col("line.bold") != "").over(order)
    return rows.select(key, "token", "pos", "line.bold", "line.rest", F.coalesce(nxt, F.lit(True)).alias("ends_entry"))


def with_locale(rows: DataFrame, l10n: DataFrame, locale: str = "locale") -> DataFrame:
    """Add ``strings``, the map of the row's locale, or the English one where there is none."""
    maps = l10n.groupBy("locale").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_map"))
    own, default = maps.select(F.col("locale").alias("_l"), F.col("_map").alias("_own")), maps.where(F.col("locale") == DEFAULT_LOCALE).select(F.col("_map").alias("_default"))
    met = rows.join(F.broadcast(own), F.col(locale) == F.col("_l"), "left").join(F.broadcast(default))
    return met.withColumn("strings", F.coalesce("_own", "_default")).drop("_l", "_own", "_default")


def unknown_keys(text: Column, strings: Column) -> Column:
    """Placeholders without a string, in order."""
    return F.array_sort(F.array_except(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1)), F.map_keys(strings)))


def resolved(text: Column, strings: Column) -> Column:
    """Text with its placeholders replaced; unknown ones fail the query with their names."""
    pieces = F.split(text, r"(?=\{[A-Za-z_][A-Za-z0-9_]*\})")

    def put(piece: Column) -> Column:
        key = F.regexp_extract(piece, "^" + PLACEHOLDER, 1)
        return F.when(key == "", piece).otherwise(F.concat(F.coalesce(strings[key], F.concat(F.lit("{"), key, F.lit("}"))), F.regexp_extract(piece, r"(?s)^\{[^}]*\}(.*)$", 1)))

    unknown = unknown_keys(text, strings)
    done = F.array_join(F.transform(pieces, put), "")
    return F.when(F.size(unknown) == 0, done).otherwise(F.raise_error(F.concat(F.lit("no locale string for: "), F.array_join(unknown, ", "))).cast("string"))


def missing_tokens(template_tokens: Column) -> Column:
    """Content tokens that a template lacks."""
    return F.array_except(F.array(*[F.lit(t) for t in TOKENS]), template_tokens)


def candidate_name(paragraphs: Column) -> Column:
    """First paragraph that is not blank, else "CV"."""
    return F.coalesce(F.get(F.filter(F.transform(paragraphs, strip), lambda p: p != ""), F.lit(0)), F.lit("CV"))


def filename(name: Column, company: Column, title: Column) -> Column:
    """``Name_Company_Role.docx`` in ASCII."""
    stem = F.array_join(F.filter(F.array(*[ascii_slug(F.coalesce(x, F.lit(""))) for x in (name, company, title)]), lambda p: p != ""), "_")
    return F.concat(F.when(stem == "", F.lit("cv")).otherwise(stem), F.lit(".docx"))


def cleaned(paragraphs: Column) -> Column:
    return F.transform(paragraphs, without_decoration)


def parse_verdicts(outputs: DataFrame, column: str = "output") -> DataFrame:
    """Add ``verdict`` of model outputs that are valid (grade 0 to 100, a text); null for others."""
    v = F.from_json(column, VERDICT)
    good = v["adequation_grade"].between(0, 100) & (F.coalesce(v["depth_analysis"], F.lit("")) != "")
    return outputs.withColumn("verdict", F.when(good, v))


def valid_cv(column: str = "cv", locale: str | None = None) -> Column:
    """Whether a generated document has all parts (and one of the known locales)."""
    cv = F.from_json(column, CV)
    whole = cv.isNotNull()
    for part in ("cv_introduction", "profile_text", "skills", "experiences", "education"):
        whole = whole & cv[part].isNotNull()
    return F.coalesce(whole & (F.col(locale).isin(*LOCALES) if locale else F.lit(True)), F.lit(False))


Backend = Callable[[str, str], "str | None"]


def call_model(prompts: DataFrame, backend: Backend, model: str, prompt: str = "prompt", out: str = "output") -> DataFrame:
    """Add the model's answer to each prompt, null where the backend gave none; ``backend(model, prompt)`` runs on executors."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in prompts.schema.fields)}, `{out}` string"

    def run(batches):  # noqa: ANN001, ANN202
        for rows in batches:
            answers = []
            for text in rows[prompt]:
                try:
                    answers.append(backend(model, text))
                except Exception:  # noqa: BLE001  a failed call is a row without an answer
                    answers.append(None)
            rows[out] = answers
            yield rows

    return prompts.mapInPandas(run, schema)


def command_backend(*command: str, timeout: float = 120) -> Backend:
    """Backend that passes the prompt to a command line tool on standard input."""

    def call(model: str, prompt: str) -> str | None:
        done = subprocess.run([*command, model], input=prompt, capture_output=True, text=True, timeout=timeout, check=False)
        return done.stdout if done.returncode == 0 else None

    return call


def docx_bytes(lines: list[tuple[str, str]], title: str = "CV") -> bytes:
    """A minimal word-processing file of (bold, plain) lines, with fixed times so that equal lines give equal bytes."""
    run = lambda text, bold: f"<w:r>{'<w:rPr><w:b/></w:rPr>' if bold else ''}<w:t xml:space=\"preserve\">{escape(text)}</w:t></w:r>" if text else ""
    body = "".join(f"<w:p>{run(b, True)}{run(r, False)}</w:p>" for b, r in lines)
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    files = {
        "[Content_Types].xml": f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{kind}"/><Override PartName="/docProps/core.xml" ContentType="application/vnd.openxmlformats-package.core-properties+xml"/></Types>',
        "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/><Relationship Id="r2" Type="http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties" Target="docProps/core.xml"/></Relationships>',
        "docProps/core.xml": f'<?xml version="1.0" encoding="UTF-8"?><cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title></cp:coreProperties>',
        "word/document.xml": f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def render_docx(lines: DataFrame, key: str = "id") -> DataFrame:
    """``key, docx`` (binary): each document's lines in template order."""
    @F.pandas_udf(BINARY)
    def made(column: pd.Series) -> pd.Series:
        return column.map(lambda rows: docx_bytes([(r["bold"], r["rest"]) for r in rows]))

    rank = F.coalesce(*[F.when(F.col("token") == t, F.lit(i)) for i, t in enumerate(TOKENS)])
    whole = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(rank.alias("t"), "pos", "bold", "rest"))).alias("_lines"))
    return whole.select(key, made("_lines").alias("docx"))


def pdf_bytes(docx: bytes, program: str = "soffice", timeout: float = 60) -> bytes | None:
    """PDF of a word-processing file by an office program; null if there is none or it fails."""
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, "cv.docx")
        path.write_bytes(docx)
        try:
            subprocess.run([program, "--headless", "--convert-to", "pdf", "--outdir", folder, str(path)], capture_output=True, timeout=timeout, check=True)
            return path.with_suffix(".pdf").read_bytes()
        except (OSError, subprocess.SubprocessError):
            return None
