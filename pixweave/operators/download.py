"""From ranked candidates to files: fallback chains, duplicates by URL and by content, names, and totals.

A run is defined as its serial order (page_no, slot_idx, cand_idx). Whether a candidate is tried depends on earlier
slots only where they share a URL, a content or a file name with it. ``process`` folds the short rows of such slots in
order, run by run, and settles all others by one aggregation; bodies never enter the fold, all that is read from them
is computed before by column expressions. ``first_urls`` and ``first_contents`` are the set-based forms for outcomes
that are known beforehand.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, urls
from ..functions.images import image_info
from ..sources.http import MAX_IMAGE
from ..sources.scratch import stored

ORDER = ["page_no", "slot_idx", "cand_idx"]
RESULT = "run_id string, page_no int, slot_idx int, cand_idx int, resolved_url string, status string, reason string, filename string, sha256 string, width long, height long"


def first_urls(rows: DataFrame, key: list[str], url: str, order: list[str]) -> DataFrame:
    """``rows`` with is_new: whether the row is the first of its key with this URL. A min per group, no sort of groups."""
    at = F.struct(*order)
    first = rows.groupBy(*key, url).agg(F.min(at).alias("_first"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in [*key, url]]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return rows.alias("r").join(first.alias("f"), cond).select("r.*", (F.struct(*(F.col(f"r.{c}") for c in order)) == F.col("f._first")).alias("is_new"))


def first_contents(rows: DataFrame, key: list[str], content: Column, order: list[str]) -> DataFrame:
    """``rows`` with sha256 and is_new: whether the row is the first of its key with these bytes."""
    return first_urls(rows.withColumn("sha256", F.sha2(content, 256)), key, "sha256", order)


def url_seen(rows: DataFrame, known: DataFrame, url: str, known_url: str | None = None) -> DataFrame:
    """``rows`` with seen: whether ``known`` holds the row's URL. A null URL hasn't been seen."""
    there = known.select(F.col(known_url or url).alias("_known")).filter("_known is not null").distinct().withColumn("_seen", F.lit(True))
    x = rows.join(there, rows[url] == there["_known"], "left")
    return x.select(*(rows[c] for c in rows.columns), F.coalesce("_seen", F.lit(False)).alias("seen"))


def keeps_size(width: Column, height: Column, limit: int) -> Column:
    """The longer side has ``limit`` pixels at least; 0 keeps all."""
    return F.lit(True) if limit <= 0 else F.greatest(width, height) >= limit


def outcomes(candidates: DataFrame, responses: DataFrame, limit_size: int = 0, max_bytes: int = MAX_IMAGE) -> DataFrame:
    """``candidates`` (a row each) with what a try would give if nothing were a duplicate: outcome, reason, sha256, size and base name."""
    parts = urls.url_parts("resolved_url")
    r = responses.select(F.col("url").alias("_url"), "status_code", "content_type", "content_disposition", "body", "error")
    x = candidates.join(r, candidates["resolved_url"] == r["_url"], "left").withColumn("_path", parts["path"])
    ext = F.regexp_extract("_path", r"(\.[^./]*)$", 1)
    failed = F.col("_url").isNull() | F.col("error").isNotNull() | ~F.coalesce(F.col("status_code").between(200, 299), F.lit(False)) | (F.octet_length("body") > (max_bytes if max_bytes > 0 else MAX_IMAGE))
    x = x.withColumn("_info", image_info(F.col("body"), F.col("content_type"), ext)).withColumn("sha256", F.sha2("body", 256))
    small = ~keeps_size(F.col("_info.width"), F.col("_info.height"), limit_size)
    outcome = F.when(failed, "Error").when(F.col("_info").isNull() | small, "Skipped").otherwise("Downloaded")
    reason = F.when(failed, F.coalesce("error", F.when(F.col("_url").isNull(), "no response").otherwise("response rejected"))).when(F.col("_info").isNull(), "unsupported format or invalid image").when(small, "too small")
    name = names.resolve_filename(F.col("content_disposition"), F.col("_path"), F.col("_info.extension"), F.col("sha256"))
    return x.select(*candidates.columns, outcome.alias("outcome"), reason.alias("reason"), F.when(~failed, F.col("sha256")).alias("sha256"), F.col("_info.width").alias("width"), F.col("_info.height").alias("height"), F.when(outcome == "Downloaded", name).alias("base_name"))


class Names:
    """Hands out file names that aren't taken: the name itself, then with _2, _3 and so on before the extension."""

    def __init__(self, taken: set[str] | None = None):
        self.taken, self.next = set(taken or ()), {}

    def allocate(self, base: str) -> str:
        dot = base.rfind(".")
        stem, ext = (base[:dot], base[dot:]) if dot >= 0 else (base, "")
        name, n = base, self.next.get(base, 2)
        while name in self.taken:
            name, n = f"{stem}_{n}{ext}", n + 1
        self.next[base] = n
        self.taken.add(name)
        return name


def fold(rows: list[dict], taken: set[str] | None = None) -> list[dict]:
    """One run's slots in order: the last try of each, which is its first success or duplicate if it has one.

    A file that can't be saved (``unsaved`` says why) is an error; its content counts as new again, its name stays used.
    """
    seen, contents, names_, out = set(), {}, Names(taken), {}
    closed: set[tuple] = set()
    for r in sorted(rows, key=lambda r: tuple(r[c] for c in ORDER)):
        slot = (r["page_no"], r["slot_idx"])
        if slot in closed:
            continue
        res = {k: r[k] for k in ("run_id", *ORDER, "resolved_url")} | {"status": r["outcome"], "reason": r["reason"], "filename": None, "sha256": r["sha256"], "width": r["width"], "height": r["height"]}
        if r["resolved_url"] in seen:
            res |= {"status": "Duplicate", "reason": "URL already processed", "sha256": None, "width": None, "height": None}
        elif r["outcome"] != "Error" and r["sha256"] in contents:
            res |= {"status": "Duplicate", "reason": f"identical content to {contents[r['sha256']]}"}
        elif r["outcome"] == "Downloaded":
            name = names_.allocate(r["base_name"])
            if r.get("unsaved"):
                res |= {"status": "Error", "reason": r["unsaved"]}
            else:
                contents[r["sha256"]] = res["filename"] = name
        seen.add(r["resolved_url"])
        if res["status"] in ("Downloaded", "Duplicate"):
            closed.add(slot)
        out[slot] = res
    return list(out.values())


SLOT = ["run_id", "page_no", "slot_idx"]


def entangled(tried: DataFrame) -> DataFrame:
    """(run_id, page_no, slot_idx) of slots that share a URL, a content or a family of file names with another slot of the run.

    A family is the name without numbers that may have been added, so that a slot's own name can't be another's numbered one.
    """
    family = F.regexp_replace("base_name", r"(?:_[0-9]+)+(\.[^.]*)?$", "$1")
    keys = F.array(
        F.struct(F.lit("url").alias("kind"), F.col("resolved_url").alias("value")),
        F.struct(F.lit("content").alias("kind"), F.when(F.col("outcome") != "Error", F.col("sha256")).alias("value")),
        F.struct(F.lit("name").alias("kind"), family.alias("value")),
    )
    x = tried.select(*SLOT, F.explode(keys).alias("k")).select(*SLOT, "k.*").filter("value is not null").distinct()
    shared = stored(x.groupBy("run_id", "kind", "value").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "run-shared")
    return stored(x.join(shared, ["run_id", "kind", "value"], "left_semi").select(*SLOT).distinct(), "run-entangled")


def process(tried: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """A row per slot from rows of ``outcomes``: status, reason, filename, sha256, size.

    ``taken`` (run_id, filename) are names that are on disk already. One task at a time holds one run's slots that hang
    together and its taken names.
    """
    names_ = [c.split()[0] for c in RESULT.split(", ")]
    columns = ["run_id", *ORDER, "resolved_url", "outcome", "reason", "sha256", "width", "height", "base_name", "unsaved"]
    x = tried if "unsaved" in tried.columns else tried.withColumn("unsaved", F.lit(None).cast("string"))
    x = stored(x.select(F.col("run_id").cast("string").alias("run_id"), *columns[1:]), "run-tried")
    known = (taken if taken is not None else x.select("run_id", F.col("base_name").alias("filename")).limit(0)).select(F.col("run_id").cast("string").alias("run_id"), "filename")
    bound = entangled(x) if taken is None else x.select(*SLOT).distinct()

    def run(rows: pa.Table, disk: pa.Table) -> pa.Table:
        found = fold(rows.to_pylist(), set(disk["filename"].to_pylist()))
        kinds = {"page_no": pa.int32(), "slot_idx": pa.int32(), "cand_idx": pa.int32(), "width": pa.int64(), "height": pa.int64()}
        return pa.table([pa.array([r[n] for r in found], kinds.get(n, pa.string())) for n in names_], names_)

    serial = x.join(bound, SLOT, "left_semi").groupBy("run_id").cogroup(known.groupBy("run_id")).applyInArrow(run, RESULT)
    good = F.col("outcome").isin("Downloaded") & F.col("unsaved").isNull()
    row = F.struct("cand_idx", "resolved_url", "outcome", "reason", "sha256", "width", "height", "base_name", "unsaved")
    alone = x.join(bound, SLOT, "left_anti").groupBy(*SLOT).agg(F.coalesce(F.min(F.when(good, row)), F.max(row)).alias("r")).select(*SLOT, "r.*")
    status = F.when(F.col("unsaved").isNotNull() & (F.col("outcome") == "Downloaded"), "Error").otherwise(F.col("outcome"))
    alone = alone.select(*SLOT, "cand_idx", "resolved_url", status.alias("status"), F.coalesce(F.when(status != F.col("outcome"), F.col("unsaved")), "reason").alias("reason"), F.when(status == "Downloaded", F.col("base_name")).alias("filename"), "sha256", "width", "height")
    return serial.unionByName(alone)


def fallback(tries: DataFrame, key: list[str], order: str, status: str = "status") -> DataFrame:
    """(key, chosen, status) of chains whose outcomes don't depend on each other: the first success or duplicate, else the last try."""
    good = F.col(status).isin("Downloaded", "Duplicate")
    at = F.struct(F.col(order).alias("at"), F.col(status).alias("status"))
    pick = F.coalesce(F.min(F.when(good, at)), F.max(at))
    return tries.groupBy(*key).agg(pick.alias("_p")).select(*key, F.col("_p.at").alias("chosen"), F.col("_p.status").alias("status"))


def allocate_names(rows: DataFrame, key: list[str], base: str, order: list[str]) -> DataFrame:
    """``rows`` with a name that is unique within its key, where no base name looks like a numbered one; else use ``process``."""
    n = F.row_number().over(Window.partitionBy(*key, base).orderBy(*order))
    ext = F.regexp_extract(base, r"(?s)(\.[^.]*)$", 1)
    stem = F.substring(F.col(base), F.lit(1), F.length(base) - F.length(ext))
    return rows.withColumn("filename", F.when(n == 1, F.col(base)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), ext)))


def summary(results: DataFrame, key: list[str]) -> DataFrame:
    """Totals by final status of the slots."""
    count = lambda s: F.count_if(F.col("status") == s)
    return results.groupBy(*key).agg(count("Downloaded").alias("downloaded"), count("Skipped").alias("skipped"), count("Duplicate").alias("duplicates"), count("Error").alias("errors"), F.count("*").alias("total_slots"))
