"""Rules as a table of keys, pages as rows of keyed probes, and one hash join between them.

A page's signals become probes in one projection: parent domains of its hosts
and URLs, classes, ids, attribute and parameter names, and the literals that one
alternation for each text finds in it. Probes meet the rules' keys in a
broadcast hash join; only what met is held against a rule's expression. So a
page costs what it holds, not what the registry holds, and its signals are read once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanwork.functions.urls import host_of, host_suffixes, registrable
from gleanwork.operators.dealing import dealt
from gleanwork.plans.registry import ATS, INDEX, Rule, all_rules

URL_COLUMNS = {
    "redirect": "redirect_chain", "canonical": "canonical_urls", "script_src": "script_srcs", "iframe_src": "iframe_srcs",
    "form_action": "form_actions", "link_href": "link_hrefs", "anchor": "anchor_urls", "script_url": "script_urls",
}
VENDOR_COLUMNS = ("script_srcs", "iframe_srcs", "form_actions", "link_hrefs", "canonical_urls")
# --- fixed values: lengths of what evidence shows ---
TEXT_PREVIEW, URL_PREVIEW, META_PREVIEW = 200, 160, 120
# --- end of fixed values ---

#: Kinds of probes that tell of the page itself and meet no rule.
PAGE, VENDOR = "page", "vendor"
PROBE = "array<struct<kind:string,key:string,pos:int,value:string>>"
KEYS = "kind string, key string, rule_idx int, part int, check string, label string, shows string, needed int, gated boolean"


def anchor_of(pattern: str) -> str:
    """Longest literal that every match of a path expression holds.

    Groups, classes and what may be repeated or left out are passed over.
    """
    plain = re.sub(r"\[[^\]]*\][*+?]?(?:\{\d+\})?", "\n", pattern)
    while (less := re.sub(r"\((?:\?:)?[^()]*\)[*+?]?", "\n", plain)) != plain:
        plain = less
    plain = re.sub(r"\\[dws][*+?]?|[^\\][*?]|[\^$|]", "\n", plain).replace("\\.", ".")
    return max(re.split(r"[\n+]", plain), key=len).lower()


def _keys_of(i: int, rule: Rule) -> Iterable[tuple]:
    owner = ATS[INDEX[rule.ats]]
    domains = sorted({*owner.hosts, *owner.assets})
    what = rule.what.lower()
    row = lambda kind, key, part=0, check=None, label=None, shows="value", needed=1: (kind, key, i, part, check, label, shows, needed, rule.gated)
    if rule.kind == "hostname":
        return [row("host", d) for d in owner.hosts]
    if rule.kind == "domain":
        return [row(f"url:{rule.source}", d, needed=int(rule.what)) for d in domains]
    if rule.kind == "jsonld":
        return [row("jsonld", d) for d in domains]
    if rule.kind == "path":
        return [row("path", anchor_of(rule.what), check=f"(?i){rule.what}", shows="match")]
    if rule.kind == "query":
        return [row("query", what, check=f"^(?i)(?:{rule.value})$" if rule.value else None, label=rule.what, shows="pair")]
    if rule.kind in ("text", "html"):
        return [row(f"in:{'html' if rule.kind == 'html' else rule.source}", what, label=rule.what, shows="label")]
    if rule.kind == "url":
        return [row(f"in:{rule.source}", what)]
    if rule.kind in ("class", "id"):
        return [row(rule.kind, what, label=rule.what, shows="label")]
    if rule.kind == "data":
        return [row("data", what, check=f"(?i){rule.value}" if rule.value else None, label=rule.what, shows="pair" if rule.value else "label")]
    if rule.kind == "terms":
        return [row("in:text", t.lower(), part, label=t, shows="label") for part, t in enumerate(rule.what.split("\n"))]
    if rule.kind == "meta":
        return [row("meta", t.lower(), part) for part, t in enumerate(rule.what.split("\n"))]
    raise ValueError(rule.kind)


def rule_keys(rules: Sequence[Rule] | None = None) -> list[tuple]:
    """A row for each key of each rule (see ``KEYS``).

    One alternation gives one literal at each place of a text; a rule whose
    literal begins a longer one has the longer one as a key too.
    """
    rows = [x for i, r in enumerate(all_rules() if rules is None else rules) for x in _keys_of(i, r)]
    known: dict[str, set[str]] = {}
    for kind, key, *_ in rows:
        known.setdefault(kind, set()).add(key)
    longer = [(kind, k, *rest) for kind, key, *rest in rows if kind in _searched(known) for k in known[kind] if k != key and k.startswith(key)]
    return rows + longer


def _searched(kinds: Iterable[str]) -> set[str]:
    return {k for k in kinds if k.startswith("in:") or k in ("path", "meta")}


def keys_table(spark: SparkSession) -> DataFrame:
    """Keys with their rules' ``ats, ats_idx, signal_id, source, points, tier``: about a thousand rows, whatever the pages."""
    rules = all_rules()
    rows = [(*k, (r := rules[k[2]]).ats, INDEX[r.ats], r.signal_id, r.source, r.points, r.tier) for k in rule_keys(rules)]
    return spark.createDataFrame(rows, f"{KEYS}, ats string, ats_idx int, signal_id string, source string, points int, tier int")


def literals(kind: str) -> list[str]:
    """Literals of a kind, longest first."""
    return sorted({k[1] for k in rule_keys() if k[0] == kind}, key=lambda x: (-len(x), x))


def found_literals(text: Column, words: Sequence[str]) -> Column:
    """Distinct literals in a text in lower case, also where they overlap: one pass of one expression."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?=(" + "|".join(f"\\Q{w}\\E" for w in words) + "))"), F.lit(1)))


def _probe(kind: str, key: Column, pos: Column, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"), pos.cast("int").alias("pos"), value.alias("value"))


def _indexed(values: Column) -> Column:
    return F.transform(values, lambda v, i: F.struct(i.alias("i"), v.alias("v")))


def _foreign(urls: str) -> Column:
    """Distinct URLs of other hosts than the page's, with place and host."""
    rows = F.transform(_indexed(F.array_distinct(F.coalesce(urls, F.array().cast("array<string>")))), lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v"), host_of(x["v"]).alias("h")))
    return F.filter(rows, lambda x: (x["h"] != "") & (x["h"] != F.col("host")))


def _nested(rows: Column, inner: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(rows, lambda x: inner(x)))


def _by_domain(kind: str, rows: Column, host: Callable[[Column], Column]) -> Column:
    return _nested(rows, lambda x: F.transform(host_suffixes(host(x)), lambda d: _probe(kind, d, x["i"], x["v"])))


def _by_literal(kind: str, rows: Column, text: Callable[[Column], Column]) -> Column:
    words = literals(kind)
    return _nested(rows, lambda x: F.transform(found_literals(text(x), words), lambda w: _probe(kind, w, x["i"], x["v"])))


def _by_name(kind: str, column: str) -> Column:
    return _nested(F.map_entries(column), lambda e: F.transform(_indexed(e["value"]), lambda x: _probe(kind, e["key"], x["i"], x["v"])))


def _alone(kind: str, keys: Column, value: Column | None = None) -> Column:
    return F.transform(keys, lambda k: _probe(kind, k, F.lit(0), k if value is None else value))


def probes() -> Column:
    """All probes of a row of signals (see ``detect.extract_signals``)."""
    parts = [_alone("host", host_suffixes("host"), F.col("host"))]
    for source, column in URL_COLUMNS.items():
        parts.append(_by_domain(f"url:{source}", _foreign(column), lambda x: x["h"]))
        if literals(f"in:{source}"):
            parts.append(_by_literal(f"in:{source}", _indexed(F.col(column)), lambda x: F.lower(x["v"])))
    links = F.filter(_indexed(F.col("jsonld_strings")), lambda x: F.contains(x["v"], F.lit("//")))
    parts.append(_by_domain("jsonld", links, lambda x: host_of(x["v"])))
    parts += [_by_name("query", "query"), _by_name("data", "data_attrs"), _alone("class", F.col("classes")), _alone("id", F.col("ids"))]
    parts.append(_alone("path", found_literals(F.col("path"), literals("path")), F.col("path")))
    parts += [_alone(f"in:{c}", found_literals(F.lower(c), literals(f"in:{c}"))) for c in ("text", "script_text", "html")]
    entries = F.transform(F.map_entries("meta"), lambda e, i: F.struct(i.alias("i"), F.lower(F.concat(e["key"], F.lit(" "), e["value"])).alias("low"), F.concat(e["key"], F.lit("="), e["value"]).alias("v")))
    parts.append(_by_literal("meta", entries, lambda x: x["low"]))
    return F.concat(*[F.coalesce(p.cast(PROBE), F.array().cast(PROBE)) for p in parts])


def page_probes(flags: dict[str, Column]) -> Column:
    """The page's flags that hold as one probe, and a probe for each URL of other sites in its markup."""
    held = F.concat_ws(",", *[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in flags.items()])
    urls = F.filter(F.array_distinct(F.flatten(F.array(*VENDOR_COLUMNS))), lambda u: (host_of(u) != "") & (host_of(u) != F.col("host")) & ~host_of(u).endswith(F.concat(F.lit("."), F.col("host"))))
    vendors = F.transform(_indexed(urls), lambda x: _probe(VENDOR, host_of(x["v"]), x["i"], registrable(host_of(x["v"]))))
    return F.concat(F.array(_probe(PAGE, F.lit(""), F.lit(0), held)), F.coalesce(vendors.cast(PROBE), F.array().cast(PROBE)))


def met_keys(signals: DataFrame, more: Column | None = None) -> DataFrame:
    """``page_id`` with each probe that meets a key, the key's rule, and what it shows; probes of the page itself (``more``) as they are."""
    all_probes = probes() if more is None else F.concat(more, probes())
    rows = signals.select("page_id", F.explode(all_probes).alias("p")).select("page_id", "p.*")
    met = rows.join(F.broadcast(keys_table(signals.sparkSession)), ["kind", "key"], "inner" if more is None else "left")
    if more is not None:
        met = met.where(F.col("rule_idx").isNotNull() | F.col("kind").isin(PAGE, VENDOR))
    value, check = F.col("value"), F.col("check")
    holds = check.isNull() | F.rlike(value, check)
    shown = (
        F.when(F.col("shows") == "match", F.call_function("regexp_extract", value, check, F.lit(0)))
        .when(F.col("shows") == "pair", F.concat("label", F.lit("="), value))
        .when(F.col("shows") == "label", F.col("label"))
        .when(F.col("kind") == "jsonld", F.substring(value, 1, URL_PREVIEW))
        .when(F.col("kind") == "meta", F.substring(value, 1, META_PREVIEW))
        .otherwise(value)
    )
    return met.where(holds).withColumn("matched", shown)


EVIDENCE = ["rule_idx", "ats", "ats_idx", "signal_id", "source", "points", "tier"]


def fired(met: DataFrame, rows: int) -> DataFrame:
    """``page_id``, the columns of the rules that fired, and what they matched.

    A rule fires when enough distinct probes meet it and, if it is gated, when
    the page lies on a host of its platform. It shows the least of the first
    matches that it needs. All steps follow one exchange by page, which deals
    the ``rows`` met probes to tasks of bounded size.
    """
    found = dealt(met.where("rule_idx is not null and matched <> ''"), rows, "page_id").groupBy("page_id", *EVIDENCE, "needed", "gated")
    found = found.agg(F.array_sort(F.collect_set(F.struct("part", "pos", "matched"))).alias("hits")).where(F.size("hits") >= F.col("needed"))
    shown = F.array_min(F.transform(F.slice("hits", F.lit(1), F.col("needed")), lambda x: x["matched"]))
    owner = F.max(F.col("source") == "hostname").over(Window.partitionBy("page_id", "ats"))
    found = found.withColumn("owner", owner).where(F.col("owner") | ~F.col("gated"))
    return found.select("page_id", *EVIDENCE, F.substring(shown, 1, TEXT_PREVIEW).alias("matched"))
