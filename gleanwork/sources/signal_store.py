"""Signals of pages, parsed once for each content and kept by its digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.functions.html import PAGE, extract_page
from gleanwork.functions.urls import host_of, normal_host, path_of, query_values
from gleanwork.sources.versioned import VersionedTable

STORED = T.StructType().add("digest", T.StringType()).add("p", PAGE)


def content_digest(url: str = "url", html: str = "html") -> Column:
    """Digest of what signals depend on: the URL, on which links are resolved, and the markup."""
    return F.sha2(F.concat(F.coalesce(F.col(url), F.lit("")), F.lit("\n"), F.coalesce(F.col(html), F.lit(""))), 256)


class SignalStore:
    """A table of signals at ``path``; detection and diagnosis read it in place of pages' markup."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = VersionedTable(spark, path, STORED)

    def refresh(self, pages: DataFrame, url: str = "url", html: str = "html") -> dict[str, int]:
        """Parse the contents that the store lacks, each once; returns ``pages`` seen and contents ``parsed``.

        Digests meet before anything is parsed, so known contents cost a hash
        and a join of digests. Texts go with the digests only once they are new.
        """
        keyed = pages.select(content_digest(url, html).alias("digest"), F.col(url).alias("url"), F.col(html).alias("html"))
        fresh = keyed.join(self.table.read().select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
        parsed, _ = self.table.insert_new(fresh.select("digest", extract_page("html", "url").alias("p")), "digest", "digest")
        return {"pages": pages.count(), "parsed": parsed}

    def signals(self, pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
        """Stored signals of pages, as ``detect.extract_signals`` gives them; pages that are not in the store are left out."""
        keyed = pages.select(
            F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), F.array(F.coalesce(F.col(url), F.lit(""))).alias("redirect_chain"),
            normal_host(host_of(url)).alias("host"), F.lower(path_of(url)).alias("path"), query_values(url).alias("query"), content_digest(url, html).alias("digest"),
        )
        return keyed.join(self.table.read(), "digest").drop("digest").select("*", "p.*").drop("p")
