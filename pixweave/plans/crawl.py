"""A whole run over snapshots: walk pages, extract slots, resolve landing pages, choose files, total up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.urls import url_parts
from ..operators import download, extract, landing, paginate
from ..sources import files
from .options import CrawlOptions


def page_slots(pages: DataFrame, starts: DataFrame, paginates: bool, max_pages: int = 0) -> tuple[DataFrame, DataFrame]:
    """The walked pages, and their slots with run_id, page_no and page_url.

    ``pages`` is a snapshot with url, html and, where a page redirected, final_url.
    """
    final = F.coalesce("final_url", "url") if "final_url" in pages.columns else F.col("url")
    known = pages.withColumn("final", final)
    limit = (max_pages or None) if paginates else 1
    walked = paginate.walk(known.select("url", paginate.next_page(F.col("html"), F.col("final")).alias("next_url")), starts, limit)
    keyed = known.select(paginate.canonical(F.col("url")).alias("key"), "final", "html")
    x = walked.filter("found").withColumn("key", paginate.canonical(F.col("url"))).join(keyed, "key").select("run_id", "page_no", F.col("final").alias("page_url"), "html")
    return walked, extract.slots(x, url="page_url")


def crawl(pages: DataFrame, responses: DataFrame, starts: DataFrame, resolve_landings: bool = False, paginates: bool = False, max_pages: int = 0, limit_size: int = 0) -> tuple[DataFrame, DataFrame]:
    """(results, summary): a row per slot, and totals per run; pages that aren't there count as errors."""
    walked, slots = page_slots(pages, starts, paginates, max_pages)
    if resolve_landings:
        slots = landing.resolve(slots, responses)
    tried = download.outcomes(extract.exploded(slots.drop("landing_url", "page_url")), responses, limit_size)
    results = download.process(tried)
    missing = walked.groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.count_if(~F.col("found")).alias("missing"), F.count("*").alias("pages"))
    totals = missing.join(download.summary(results, ["run_id"]), "run_id", "left").fillna(0)
    return results, totals.select("run_id", "pages", "downloaded", "skipped", "duplicates", (F.col("errors") + F.col("missing")).alias("errors"), "total_slots")


def crawl_one(options: CrawlOptions, pages: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One run by its options."""
    starts = pages.sparkSession.createDataFrame([("run", options.url)], "run_id string, url string")
    return crawl(pages, responses, starts, options.resolve_landings, options.paginates, options.max_pages, options.limit_size)


def folders(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host_folder and page_folder, under which a page's files are kept."""
    x = pages.withColumn("_p", url_parts(url))
    return x.withColumns({"host_folder": names.host_folder(F.col("_p.hostname")), "page_folder": names.page_folder(F.col("_p"))}).drop("_p")


def target(spark: SparkSession, base_dir: str, page_url: str) -> str:
    """The folder of a page's files: host and page below ``base_dir``."""
    one = folders(spark.createDataFrame([(page_url,)], "url string")).first()
    return "/".join((base_dir.rstrip("/") or ".", one["host_folder"], one["page_folder"]))


def save(results: DataFrame, responses: DataFrame, folder: str) -> DataFrame:
    """(filename, bytes, error) of the chosen files, written into a folder that all executors share."""
    bodies = responses.select(F.col("url").alias("resolved_url"), "body")
    return files.saved(results.filter("status = 'Downloaded'").join(bodies, "resolved_url").select("filename", "body"), folder)
