"""What a run says: a line per slot, lines for fallbacks, and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.download import SLOT


def _head(total: Column) -> Column:
    return F.concat(F.lit("["), F.col("slot_idx").cast("string"), F.lit("/"), total.cast("string"), F.lit("] "))


def lines(results: DataFrame, candidates: DataFrame, responses: DataFrame, verbose: bool = False) -> DataFrame:
    """(run_id, page_no, slot_idx, line) of ``results``: files and errors; with ``verbose`` every slot, with its source.

    ``candidates`` gives the sources, ``responses`` the status codes. The wording is fixed.
    """
    totals = results.groupBy("run_id", "page_no").agg(F.max("slot_idx").alias("_total"))
    x = results.join(totals, ["run_id", "page_no"])
    head = _head(F.col("_total"))
    if not verbose:
        said = F.when(F.col("status") == "Downloaded", F.concat(head, "filename")).when(F.col("status") == "Error", F.concat(head, F.lit("error: "), F.coalesce("reason", F.lit(""))))
        return x.select(*SLOT, said.alias("line")).filter("line is not null")
    x = x.join(candidates.select(*SLOT, "cand_idx", "source"), [*SLOT, "cand_idx"], "left")
    x = x.join(responses.select(F.col("url").alias("resolved_url"), "status_code"), "resolved_url", "left")
    where = F.concat(F.lit(" [source: "), F.coalesce("source", F.lit("")), F.lit(", url: "), F.coalesce("resolved_url", F.lit("")), F.lit("]"))
    form = F.element_at(F.split("filename", r"\."), -1)
    size = F.concat(F.lit(" ("), F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"), F.lit(", "), F.when(form == "jpg", "jpeg").otherwise(form), F.lit(", HTTP "), F.coalesce(F.col("status_code").cast("string"), F.lit("0")), F.lit(")"))
    said = F.when(F.col("status") == "Downloaded", F.concat(head, "filename", size, where)).otherwise(F.concat(head, F.upper("status"), F.lit(": "), F.coalesce("reason", F.lit("")), where))
    return x.select(*SLOT, said.alias("line"))


def fallback_lines(tried: DataFrame, results: DataFrame) -> DataFrame:
    """(run_id, page_no, slot_idx, cand_idx, line): the tries that gave way to the next candidate of their slot."""
    totals = results.groupBy("run_id", "page_no").agg(F.max("slot_idx").alias("_total"))
    chosen = results.select(*SLOT, F.col("cand_idx").alias("_chosen"))
    x = tried.join(chosen, SLOT).filter("cand_idx < _chosen").join(totals, ["run_id", "page_no"])
    after = tried.select(*SLOT, (F.col("cand_idx") - 1).alias("cand_idx"), F.col("resolved_url").alias("_next"), F.col("source").alias("_source"))
    x = x.join(after, [*SLOT, "cand_idx"])
    line = F.concat(_head(F.col("_total")), F.lit("FALLBACK: "), "resolved_url", F.lit(" failed ("), F.coalesce("reason", "outcome"), F.lit("), trying "), "_next", F.lit(" ["), "_source", F.lit("]"))
    return x.select(*SLOT, "cand_idx", line.alias("line"))


def summary_text(totals: DataFrame, paginates: bool) -> str:
    """The totals of one run (a row) as they are printed at its end."""
    t = totals.first()
    first = [("Pages processed:", t["pages"]), ("Images downloaded:", t["downloaded"])] if paginates else [("Downloaded:", t["downloaded"])]
    rows = [*first, ("Skipped:", t["skipped"]), ("Duplicates:", t["duplicates"]), ("Errors:", t["errors"])]
    return "\n".join(["", "Done.", *(f"{name:<19}{n}" for name, n in rows)])
