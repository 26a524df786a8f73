"""Platform detection: evidence from rules, capped scores, verdicts.

Pages become rows of signals, from one parse or from a store, and these probes
that meet the rules' keys in one hash join (see ``rules``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanwork.functions.html import extract_page
from gleanwork.functions.urls import host_of, host_suffixes, normal_host, path_of, query_values
from gleanwork.operators import rules
from gleanwork.operators.dealing import dealt
from gleanwork.plans.registry import ASSET_MARKERS, ATS, ATS_CAP, INFRA, OWNED_HOSTS, SOURCE_CAP, known_domains
from gleanwork.sources.shared import materialise


def domains_table(spark: SparkSession) -> DataFrame:
    """``domain, ats, is_host`` of the registry."""
    rows = {(d, a.name): d in a.hosts for a in ATS for d in (*a.hosts, *a.assets)}
    return spark.createDataFrame([(d, n, h) for (d, n), h in rows.items()], "domain string, ats string, is_host boolean")


def extract_signals(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", redirect_chain: str | None = None) -> DataFrame:
    """One row of signals for each page, from one parse."""
    chain = F.coalesce(F.col(redirect_chain), F.array(F.col(url))) if redirect_chain else F.array(F.coalesce(F.col(url), F.lit("")))
    page = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), chain.alias("redirect_chain"), extract_page(html, url).alias("p"))
    return page.select("page_id", "url", "html", "redirect_chain", normal_host(host_of("url")).alias("host"), F.lower(path_of("url")).alias("path"), query_values("url").alias("query"), "p.*")


def fired_rules(signals: DataFrame) -> DataFrame:
    """``page_id`` with the columns of the rules that fired and what they matched. What meets a rule is written to the shared folder."""
    met = materialise(rules.met_keys(signals).drop("check", "label", "shows"), "met-rules")
    return rules.fired(met, met.count())


def capped_points(fired: DataFrame, page: str = "page_id", cap: int = SOURCE_CAP, rows: int | None = None) -> DataFrame:
    """Evidence with ``allowed`` points: in rule order, a source gives a platform at most ``cap`` points; rules left with none go.

    With their number ``rows``, fired rules are dealt by page and platform to
    tasks of bounded size, and sums by these follow without an exchange;
    without it they stay where they are if they are dealt by page already.
    """
    if rows is not None:
        fired = dealt(fired, rows, page, "ats")
    before = Window.partitionBy(page, "ats", "source").orderBy("rule_idx").rowsBetween(Window.unboundedPreceding, -1)
    used = F.least(F.lit(cap), F.coalesce(F.sum("points").over(before), F.lit(0)))
    return fired.withColumn("allowed", F.greatest(F.lit(0), F.least(F.col("points"), F.lit(cap) - used)).cast("long")).where("allowed > 0")


def scores(evidence: DataFrame, page: str = "page_id") -> DataFrame:
    """Score of each platform on each page, its sources, and its sources by tier.

    Sources are few, so they are collected: distinct counts would repeat the rows and deal them anew.
    """
    return evidence.groupBy(page, "ats", "ats_idx").agg(
        F.least(F.sum("allowed"), F.lit(ATS_CAP)).cast("long").alias("score"), F.size(F.collect_set("source")).cast("long").alias("sources"),
        F.size(F.collect_set(F.when(F.col("tier") <= 1, F.col("source")))).cast("long").alias("tier1"),
        F.size(F.collect_set(F.when(F.col("tier") <= 2, F.col("source")))).cast("long").alias("tier2"),
        F.max(F.col("source") == "hostname").alias("has_host"),
    )


def verdicts(scored: DataFrame, page: str = "page_id") -> DataFrame:
    """One row for each page with evidence: winner, runner-up, ``status``, ``confidence``.

    The owner of the page's host wins; otherwise the best score, ties by
    registry order. A page is qualified by a definitive source or two strong
    ones, and ambiguous if without an owner the runner-up is strong and has
    60 % of the winner's score.
    """
    by_page = Window.partitionBy(page)
    owner = F.min(F.when(F.col("has_host"), F.col("ats_idx"))).over(by_page)
    ranked = scored.withColumn("owner", owner)
    order = by_page.orderBy(F.desc(F.coalesce(F.col("ats_idx") == F.col("owner"), F.lit(False))), F.desc("score"), "ats_idx")
    ranked = ranked.withColumn("rank", F.row_number().over(order))
    for c, zero in (("ats", None), ("score", 0), ("tier2", 0)):
        ranked = ranked.withColumn(f"second_{c}", F.coalesce(F.lead(c).over(order), F.lit(zero)) if zero is not None else F.lead(c).over(order))
    top = ranked.where("rank = 1")
    qualified = (F.col("tier1") > 0) | (F.col("tier2") >= 2)
    rival = F.col("owner").isNull() & (F.col("second_tier2") > 0) & (F.col("second_score") >= 0.6 * F.col("score"))
    status = F.when((F.col("score") <= 0) | ~qualified, "unknown").when(rival, "ambiguous").otherwise("detected")
    quality = F.when(F.col("tier1") > 0, 1.0).when(F.col("tier2") > 0, 0.6).otherwise(0.2)
    margin = F.when(F.col("score") > 0, (F.col("score") - F.col("second_score")) / F.col("score")).otherwise(0.0)
    diversity = F.least(F.col("sources") / 3.0, F.lit(1.0))
    confidence = F.when(F.col("score") <= 0, 0.0).when(status == "detected", 0.40 * quality + 0.30 * margin + 0.30 * diversity).otherwise(0.20 * quality + 0.20 * diversity)
    return top.select(
        page, F.when(status == "detected", F.col("ats")).alias("detected_ats"), status.alias("status"), F.col("ats").alias("winner"), "score",
        F.col("second_ats").alias("runner_up"), "second_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)), 3).alias("confidence"),
        F.when(status == "ambiguous", F.array("ats", "second_ats")).alias("conflicts"),
    )


def below_any(host: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one, by its suffixes."""
    return F.arrays_overlap(host_suffixes(host), F.array(*[F.lit(d) for d in domains]))


def is_infra(host: Column) -> Column:
    """Hosts of general web infrastructure: whole domains for names with a dot, substrings for others."""
    plain = "|".join(m.replace("-", r"\-") for m in INFRA if "." not in m)
    return below_any(host, [m for m in INFRA if "." in m]) | F.rlike(host, F.lit(plain))


def leading_vendors(met: DataFrame) -> DataFrame:
    """``page_id, unknown_vendor`` of the probes of other sites: the domain of most distinct URLs (two at least), ties by name.

    Hosts of infrastructure and of known platforms are left out.
    """
    urls = met.where(F.col("kind") == rules.VENDOR).select("page_id", F.col("key").alias("host"), F.col("value").alias("domain"), "pos")
    urls = urls.where(~is_infra(F.col("host")) & ~below_any(F.col("host"), known_domains()))
    counts = urls.groupBy("page_id", "domain").agg(F.countDistinct("pos").alias("n")).where("n >= 2")
    return counts.groupBy("page_id").agg(F.min(F.struct(-F.col("n"), F.col("domain").alias("d"))).alias("m")).select("page_id", F.col("m.d").alias("unknown_vendor"))


def looks_unrendered() -> Column:
    length = F.length("text")
    return (length <= 2000) & (F.size("script_srcs") > 0) & ((length < 500) | F.arrays_overlap("ids", F.array(F.lit("root"), F.lit("app"), F.lit("__next"))))


def detect(pages: DataFrame, **columns: str) -> DataFrame:
    """Verdict of each page; pages without evidence are unknown with score 0. See ``detect_signals``."""
    return detect_signals(extract_signals(pages, **columns))


def detect_signals(signals: DataFrame) -> DataFrame:
    """Verdict of each page from its signals, parsed now or stored.

    Signals are read once: what meets a rule, and a row with the flags of each
    page, is written to the shared folder, and all further steps read these
    slim rows. Rows of one ``page_id`` count as one page.
    """
    flags = {"job": F.col("is_job_page"), "shell": looks_unrendered()}
    met = materialise(rules.met_keys(signals, rules.page_probes(flags)).drop("check", "label", "shows"), "met-rules")
    found = verdicts(scores(capped_points(rules.fired(met, met.count()))))
    has = lambda flag: F.max(F.array_contains(F.split("value", ","), flag))
    rows = met.where(F.col("kind") == rules.PAGE).groupBy("page_id").agg(has("job").alias("is_job_page"), has("shell").alias("shell"))
    rows = rows.join(found, "page_id", "left").join(leading_vendors(met), "page_id", "left")
    status = F.coalesce("status", F.lit("unknown"))
    return rows.select(
        "page_id", "detected_ats", status.alias("status"), F.coalesce("score", F.lit(0)).cast("long").alias("score"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        "conflicts", "is_job_page", (F.col("shell") & (status == "unknown")).alias("needs_rendering"), F.when(status == "unknown", F.col("unknown_vendor")).alias("unknown_vendor"),
    )


def result_line() -> Column:
    """A verdict as a line for a console."""
    name = F.when(F.col("detected_ats").isNotNull(), F.concat("detected_ats", F.lit(": "))).otherwise(F.lit(""))
    rivals = F.when(F.col("conflicts").isNotNull(), F.concat(F.lit(" between "), F.array_join("conflicts", " and "))).otherwise(F.lit(""))
    figures = F.concat(F.lit(" (score "), F.col("score").cast("string"), F.lit(", confidence "), F.col("confidence").cast("string"), F.lit(")"))
    shell = F.when(F.col("needs_rendering"), F.lit(", looks unrendered")).otherwise(F.lit(""))
    lead = F.when(F.col("unknown_vendor").isNotNull(), F.concat(F.lit(", maybe "), F.col("unknown_vendor"))).otherwise(F.lit(""))
    return F.concat(name, F.col("status"), rivals, figures, shell, lead)


def with_rendered(first: DataFrame, rendered: DataFrame) -> DataFrame:
    """Verdicts of ``first``, replaced by those of rendered pages that are no longer unknown."""
    better = rendered.where("status <> 'unknown'")
    again = first.select("page_id").join(better, "page_id")
    return first.join(better.select("page_id"), "page_id", "left_anti").unionByName(again, allowMissingColumns=True)


def failed(fetches: DataFrame) -> DataFrame:
    """Unknown verdicts with their errors for pages that could not be fetched."""
    return fetches.where(F.col("error").isNotNull() | (F.col("status") != 200)).select(
        F.col("url"), F.lit("unknown").alias("status"), F.lit(0).cast("long").alias("score"), F.lit(0.0).alias("confidence"), F.coalesce("error", F.concat(F.lit("http "), F.col("status").cast("string"))).alias("error")
    )


def evidence_list(evidence: DataFrame, page: str = "page_id") -> DataFrame:
    """``page, evidence``: what fired on a page, strongest tier first, then most points, then rule order."""
    row = F.struct("tier", (-F.col("allowed")).alias("_less"), "rule_idx", "signal_id", "source", F.col("allowed").alias("points"), "matched")
    return evidence.groupBy(page).agg(F.array_sort(F.collect_list(row)).alias("_e")).select(
        page, F.transform("_e", lambda e: F.struct(e["signal_id"].alias("signal_id"), e["source"].alias("source"), e["points"].alias("points"), e["tier"].alias("tier"), e["matched"].alias("matched"))).alias("evidence")
    )


def ground_truth(url: str, html: str, fallback: str) -> Column:
    """Label of a page: the owner of its host, else the only vendor whose marks it has, else ``fallback``."""
    owners = F.create_map(*[F.lit(x) for pair in OWNED_HOSTS.items() for x in pair])
    owner = F.get(F.filter(F.transform(host_suffixes(host_of(url)), lambda d: owners[d]), lambda a: a.isNotNull()), F.lit(0))
    low = F.lower(F.coalesce(F.col(html), F.lit("")))
    marks = F.array(*[F.struct(F.lit(m).alias("mark"), F.lit(a).alias("ats")) for m, a in ASSET_MARKERS.items()])
    hits = F.array_distinct(F.transform(F.filter(marks, lambda x: F.contains(low, x["mark"])), lambda x: x["ats"]))
    return F.coalesce(owner, F.when(F.size(hits) == 1, F.get(hits, F.lit(0))), F.col(fallback))


def fixture_name(url: str, expected: str) -> Column:
    """File name of a saved page: label, host and a digest of its URL."""
    label = F.concat(F.coalesce(F.nullif(F.col(expected), F.lit("")), F.lit("none")), F.lit("_"), F.replace(F.lower(F.regexp_extract(url, "//([^/?#]*)", 1)), F.lit(":"), F.lit("_")))
    slug = F.regexp_replace(F.regexp_replace(label, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(slug, F.lit("_"), F.substring(F.sha1(url), 1, 8), F.lit(".html"))
