"""One-hop landing pages: slots whose image leads to a page get that page's original in front.

The match is an equi-join on (landing URL, token) and an aggregation, so it scales with tokens, not with pairs of
candidates; hot landing pages are split by adaptive execution. Rows are keyed by (run_id, page_no, slot_idx).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.images import is_raster_type
from ..functions.tokens import tokens_of
from ..functions.urls import url_parts
from ..sources.scratch import stored
from . import extract

#: Bytes of a landing page at most; priority of a promoted candidate; priority from which candidates are indexed.
MAX_PAGE, PROMOTED, INDEXED = 20 * 1024 * 1024, 110, 70
KEY = ["run_id", "page_no", "slot_idx"]


def _origin(parts: Column) -> Column:
    return F.concat(F.lower(parts["scheme"]), F.lit("://"), F.lower(parts["hostname"]))


def eligible(slots: DataFrame, page_url: str = "page_url") -> DataFrame:
    """Slots with a landing URL of the page's own origin and without a candidate that is an original already."""
    x = slots.filter("landing_url is not null").filter(~F.exists("candidates", lambda c: c["source"].isin("anchor-image", "data-original")))
    return x.withColumns({"_page": url_parts(page_url), "_land": url_parts("landing_url")}).filter(_origin(F.col("_page")) == _origin(F.col("_land"))).drop("_page", "_land")


def slot_tokens(slots: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, landing_url, token): the distinct tokens of each slot's landing URL and candidates."""
    urls = F.array_distinct(F.array_compact(F.concat(F.array("landing_url"), F.transform("candidates", lambda c: c["resolved_url"]))))
    x = slots.select(*key, "landing_url", F.explode(urls).alias("url"))
    return x.select(*key, "landing_url", F.explode(tokens_of(url_parts("url"))).alias("token")).distinct()


def landing_pages(slots: DataFrame, responses: DataFrame) -> DataFrame:
    """(landing_url, direct, effective, body): what the distinct landing URLs of ``slots`` answered; failures and pages too long are left out."""
    wanted = slots.select(F.col("landing_url").alias("url")).distinct()
    x = wanted.join(responses, "url").withColumnRenamed("url", "landing_url").filter("error is null and status_code between 200 and 299")
    direct = is_raster_type(F.col("content_type"))
    x = x.select("landing_url", direct.alias("direct"), F.coalesce("final_url", "landing_url").alias("effective"), "body")
    return x.filter(F.col("direct") | (F.octet_length("body") <= MAX_PAGE))


def landing_candidates(pages: DataFrame) -> DataFrame:
    """(landing_url, seq, source, priority, raw_url, resolved_url, descriptor) of landing pages that are HTML."""
    x = pages.filter("not direct").select(F.col("landing_url").alias("_of"), F.col("effective").alias("url"), F.decode("body", "UTF-8").alias("html"))
    c = extract.candidates(x, keep=("_of",))
    return c.select(F.col("_of").alias("landing_url"), (F.col("slot_idx").cast("long") * 64 + F.col("cand_idx")).alias("seq"), "source", "priority", "raw_url", "resolved_url", "descriptor")


def matched(slots: DataFrame, found: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, raw_url, resolved_url, descriptor): the candidate of a slot's landing page that shares most tokens with it.

    Candidates whose URL the slot has already don't count. Among equal scores the highest priority wins; if that
    leaves several URLs the slot gets none.
    """
    tokens = found.select("landing_url", "seq", F.explode(tokens_of(url_parts("resolved_url"))).alias("token"))
    scores = slot_tokens(slots, key).join(tokens, ["landing_url", "token"]).groupBy(*key, "landing_url", "seq").agg(F.count("*").alias("score"))
    x = scores.join(found, ["landing_url", "seq"])
    own = slots.select(*key, F.explode(F.transform("candidates", lambda c: c["resolved_url"])).alias("resolved_url")).distinct()
    x = x.join(own, [*key, "resolved_url"], "left_anti")
    top = x.withColumn("_rank", F.rank().over(Window.partitionBy(*key).orderBy(F.desc("score"), F.desc("priority")))).filter("_rank = 1")
    # One candidate of the best score wins whatever its priority; so does one URL among the best of both.
    pick = F.min(F.struct("seq", "raw_url", "resolved_url", "descriptor"))
    return top.groupBy(*key).agg(pick.alias("p"), F.countDistinct("resolved_url").alias("n")).filter("n = 1").select(*key, "p.raw_url", "p.resolved_url", "p.descriptor")


def direct(slots: DataFrame, pages: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, raw_url, resolved_url, descriptor): landing URLs that are images themselves."""
    return slots.join(pages.filter("direct"), "landing_url").select(*key, F.col("landing_url").alias("raw_url"), F.col("effective").alias("resolved_url"), F.lit(None).cast("string").alias("descriptor"))


def readers(slots: DataFrame, found: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The key of each slot whose landing page is read: no page that an earlier slot of the run had read answers it.

    Slots come up in the order of the key. A page is answered for by the candidates of priority 70 or more, by their
    tokens. Whether a slot reads depends on the earlier ones, so it is settled in rounds, for all runs at once: a slot
    whose token a page holds that surely was read earlier is answered; one that no earlier slot still in question
    could answer reads. Both are minima per run and token. The first open slot of a run is settled in every round, and
    all that don't hang on each other with it.
    """
    run, place = key[0], F.struct(*(F.col(k) for k in key[1:]))
    asked = stored(slot_tokens(slots, key).select(run, place.alias("place"), "landing_url", "token"), "landing-tokens")
    held = found.filter(F.col("priority") >= INDEXED).select("landing_url", F.explode(tokens_of(url_parts("resolved_url"))).alias("token")).distinct()
    offered = stored(slots.select(run, place.alias("place"), "landing_url").join(held, "landing_url").select(run, "place", "token"), "landing-offers")
    state = stored(slots.select(run, place.alias("place"), F.lit(None).cast("boolean").alias("reads")), "landing-state")
    while True:
        able = offered.join(state.filter("reads is null or reads"), [run, "place"])
        first = able.groupBy(run, "token").agg(F.min("place").alias("may"), F.min(F.when(F.col("reads"), F.col("place"))).alias("has"))
        first = stored(first, "landing-first")
        x = asked.join(state.filter("reads is null").select(run, "place"), [run, "place"]).join(first, [run, "token"], "left")
        settled = x.groupBy(run, "place").agg(F.bool_or(F.coalesce(F.col("has") < F.col("place"), F.lit(False))).alias("hit"), F.bool_and(F.coalesce(F.col("may") >= F.col("place"), F.lit(True))).alias("free"))
        new = state.join(settled, [run, "place"], "left")
        # Slots without any token ask nothing of the index: they read at once.
        reads = F.coalesce("reads", F.when(F.col("hit"), False).when(F.col("free") | F.col("free").isNull(), True))
        state = stored(new.select(run, "place", reads.alias("reads")), "landing-state", F.col("reads").isNull())
        if not state.counted:
            return state.filter("reads").select(run, "place.*")


def indexed(slots: DataFrame, found: DataFrame, key: list[str] = KEY) -> DataFrame:
    """(key, raw_url, resolved_url, descriptor): slots answered by a landing page that an earlier slot of the run had read.

    A slot takes the hit of its least token, an index entry the first candidate of priority 70 or more, in the order of
    reading.
    """
    run, place = key[0], F.struct(*(F.col(k) for k in key[1:]))
    reading = slots.join(readers(slots, found, key), key, "left_semi")
    read = reading.groupBy(run, "landing_url").agg(F.min(place).alias("read"))
    entries = read.join(found.filter(F.col("priority") >= INDEXED), "landing_url")
    entries = entries.select(run, "read", "seq", "raw_url", "resolved_url", "descriptor", F.explode(tokens_of(url_parts("resolved_url"))).alias("token"))
    first = entries.groupBy(run, "token").agg(F.min(F.struct("read", "seq", "raw_url", "resolved_url", "descriptor")).alias("e"))
    x = slot_tokens(slots, key).join(first, [run, "token"]).filter(F.col("e.read") < place)
    return x.groupBy(*key).agg(F.min(F.struct("token", "e")).alias("m")).select(*key, "m.e.raw_url", "m.e.resolved_url", "m.e.descriptor")


def resolve(slots: DataFrame, responses: DataFrame, use_index: bool = True, page_url: str = "page_url", key: list[str] = KEY) -> DataFrame:
    """``slots`` with the landing page's original in front of the candidates of those that have one."""
    asking = eligible(slots, page_url)
    pages = landing_pages(asking, responses)
    found = stored(landing_candidates(pages), "landing-candidates")  # used by each way to an answer; without bodies
    pages = pages.select("landing_url", "direct", "effective")
    parts = [indexed(asking, found, key)] * use_index + [direct(asking, pages, key), matched(asking, found, key)]
    answers = None
    for order, part in enumerate(parts):
        part = part.withColumn("_order", F.lit(order))
        answers = part if answers is None else answers.unionByName(part)
    best = answers.groupBy(*key).agg(F.min(F.struct("_order", "raw_url", "resolved_url", "descriptor")).alias("_a"))
    kind = slots.schema["candidates"].dataType
    new = F.array(F.struct(F.lit("landing-image").alias("source"), F.lit(PROMOTED).alias("priority"), F.col("_a.raw_url").alias("raw_url"), F.col("_a.resolved_url").alias("resolved_url"), F.col("_a.descriptor").alias("descriptor"))).cast(kind)
    x = slots.join(best, key, "left")
    return x.withColumn("candidates", F.when(F.col("_a").isNotNull(), F.concat(new, "candidates")).otherwise(F.col("candidates"))).drop("_a")
