"""A run over the network: pages one after the other, then landing pages and images as tables, files, and a report."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import download, extract, landing, paginate
from ..sources import files, http
from ..sources.scratch import folder, stored
from . import crawl, report
from .options import CrawlOptions

PAGES = "run_id string, page_no int, page_url string, html string"
RUN = "run"


def fetched_pages(spark: SparkSession, options: CrawlOptions, client: http.Client) -> tuple[DataFrame, int, int]:
    """(pages, how many, errors). A page's link to the next one is known only once it has been read, so this is a loop;
    each page goes to storage as it comes in, and the driver holds one at a time."""
    path, seen, url, errors = f"{folder(spark)}/live-pages-{uuid.uuid4().hex}", set(), options.url, 0
    spark.createDataFrame([], PAGES).write.parquet(path)
    while url:
        parsed = urls.parse(url)
        key = str(urls.replace(parsed, scheme=parsed.scheme.lower(), host=parsed.host.lower(), fragment=""))
        if key in seen:
            break
        seen.add(key)
        answer = dict(zip((c.split()[0] for c in http.RESPONSES.split(", ")), client.get(url, limit=http.MAX_PAGE), strict=True))
        if answer["error"]:
            errors += 1
            break
        at, html = answer["final_url"] or url, answer["body"].decode("utf-8", "replace")
        spark.createDataFrame([(RUN, len(seen), at, html)], PAGES).write.mode("append").parquet(path)
        if not options.paginates or options.max_pages and len(seen) >= options.max_pages:
            break
        found = paginate.links(html, at)
        url = min(found)[2] if found else None
    return spark.read.schema(PAGES).parquet(path), len(seen), errors


def fetched_images(candidates: DataFrame, options: CrawlOptions, cookies: tuple) -> DataFrame:
    """The answers to the candidates that are tried: those of a rank only where all better ones of the slot gave no file."""
    spark = candidates.sparkSession
    answers, open_, rank = spark.createDataFrame([], http.RESPONSES), candidates.select(*download.SLOT).distinct(), 0
    while True:
        rank += 1
        at = candidates.filter(F.col("cand_idx") == rank).join(open_, download.SLOT, "left_semi")
        wanted = at.select("resolved_url").join(answers.select(F.col("url").alias("resolved_url")), "resolved_url", "left_anti")
        got = stored(http.fetch(wanted, image=True, referer=options.url, tasks=options.workers, cookies=cookies), "live-images")
        answers = answers.unionByName(got)
        tried = stored(download.outcomes(at, answers, options.limit_size).select(*download.SLOT, "outcome"), "live-tried")
        open_ = stored(tried.filter("outcome <> 'Downloaded'").select(*download.SLOT).join(candidates.filter(F.col("cand_idx") > rank).select(*download.SLOT).distinct(), download.SLOT), "live-open")
        if not open_.counted:
            return answers


def run(spark: SparkSession, options: CrawlOptions, say: Callable[[str], None] = print) -> dict:
    """The whole run; returns its totals. Lines of the report go to ``say`` as they are read from their table."""
    client = http.Client(referer=options.url)
    pages, count, errors = fetched_pages(spark, options, client)
    slots = stored(extract.slots(pages, url="page_url"), "live-slots")
    if options.resolve_landings:
        asked = landing.eligible(slots).select("landing_url")
        answers = http.fetch(asked, referer=options.url, limit=landing.MAX_PAGE, tasks=options.workers, cookies=tuple(client.cookies))
        slots = stored(landing.resolve(slots, stored(answers, "live-landings")), "live-resolved")
    candidates = stored(extract.exploded(slots.drop("landing_url", "page_url")), "live-candidates")
    responses = fetched_images(candidates, options, tuple(client.cookies))
    to = crawl.target(spark, options.output_dir, options.url)
    tried = stored(download.outcomes(candidates, responses, options.limit_size), "live-outcomes")
    taken = files.names_on_disk(spark, to).withColumn("run_id", F.lit(RUN))
    results = stored(download.process(tried, taken), "live-results")
    written = stored(crawl.save(results, responses, to), "live-files", F.col("error").isNotNull())
    if written.counted:  # the contents of what couldn't be saved count as new again
        failed = written.filter("error is not null").select("filename", F.col("error").alias("unsaved"))
        bad = results.join(failed, "filename").select(*download.SLOT, "cand_idx", "unsaved")
        again = download.process(tried.join(bad, [*download.SLOT, "cand_idx"], "left"), taken)
        results = stored(again, "live-results")
        crawl.save(results, responses, to).write.format("noop").mode("overwrite").save()
    for row in report.lines(results, candidates, responses, options.verbose).orderBy(*download.SLOT).toLocalIterator():
        say(row["line"])
    if options.verbose:
        for row in report.fallback_lines(tried, results).orderBy(*download.SLOT, "cand_idx").toLocalIterator():
            say(row["line"])
    totals = download.summary(results, ["run_id"]).fillna(0)
    none = spark.createDataFrame([(RUN, count, errors)], "run_id string, pages long, missing long")
    totals = none.join(totals, "run_id", "left").fillna(0)
    totals = stored(totals.select("pages", "downloaded", "skipped", "duplicates", (F.col("errors") + F.col("missing")).alias("errors"), "total_slots"), "live-totals")
    say(report.summary_text(totals, options.paginates))
    return totals.first().asDict()
