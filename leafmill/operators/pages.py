"""Filters, projections and rollups over jobs and their pages.

Page rows have (job_id, page_number, sub_page_index); the sub index is null for unsplit pages.  Where they are laid out by
job and by blocks of page numbers, they also have page_block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The page state graph.
TRANSITIONS = {
    "queued": ("preprocessing", "failed"),
    "preprocessing": ("rectification", "ptiff_qa_pending", "layout_detection", "accepted", "pending_human_correction", "split", "failed"),
    "rectification": ("ptiff_qa_pending", "layout_detection", "accepted", "pending_human_correction", "split", "failed"),
    "ptiff_qa_pending": ("accepted", "layout_detection", "pending_human_correction"),
    "layout_detection": ("accepted", "review", "failed", "pending_human_correction"),
    "pending_human_correction": ("semantic_norm", "review", "split"),
    "semantic_norm": ("layout_detection", "accepted", "failed"),
    "accepted": ("pending_human_correction", "semantic_norm"),
    "review": (),
    "failed": (),
    "split": (),
}
TERMINAL = ("accepted", "review", "failed")
WORKER_STOP = ("ptiff_qa_pending", "accepted", "pending_human_correction", "review", "failed", "split")
LEAF_FINAL = ("review", "failed")
AUTOMATABLE = ("queued", "preprocessing", "rectification", "layout_detection", "semantic_norm")
HUMAN_ONLY = ("pending_human_correction", "ptiff_qa_pending")
PAGE_KEY = ("job_id", "page_number")


def ts(now: str) -> Column:
    """A moment given as text, as a timestamp in the session's time zone."""
    return F.lit(now).cast("timestamp")


def safe_rate(n: Column, d: Column) -> Column:
    """n / d to 4 places, 0 where d is 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(F.round(n / d, 4))


def terminal_in_window(pages: DataFrame, now: str, hours: int) -> DataFrame:
    """Terminal pages whose state changed in the last ``hours``, both ends included; null times are outside."""
    start = ts(now) - F.expr(f"INTERVAL {hours} HOURS")
    return pages.where(F.col("status").isin(*TERMINAL) & F.col("status_updated_at").between(start, ts(now)))


def search_jobs(jobs: DataFrame, text: str | None = None, status: str | None = None, material: str | None = None, owner: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Case-insensitive substring of job or collection id, equality filters and an inclusive date range; all optional."""
    if text:
        jobs = jobs.where(F.col("job_id").ilike(f"%{text}%") | F.col("collection_id").ilike(f"%{text}%"))
    for column, value in (("status", status), ("material_type", material), ("created_by", owner)):
        if value:
            jobs = jobs.where(F.col(column) == value)
    if since:
        jobs = jobs.where(F.col("created_at") >= ts(since))
    return jobs.where(F.col("created_at") <= ts(until)) if until else jobs


def has_reason(pages: DataFrame, code: str) -> DataFrame:
    """Pages whose JSON list of review reasons holds a code; null and broken lists hold none."""
    return pages.where(F.array_contains(F.from_json("review_reasons", "array<string>"), code))


def work_class(status: Column) -> Column:
    """Who works on a state: automatable, human_only, terminal, or unknown for null and other states."""
    return F.when(status.isin(*AUTOMATABLE), "automatable").when(status.isin(*HUMAN_ONLY), "human_only").when(status.isin("split", *TERMINAL), "terminal").otherwise("unknown")


def age_seconds(now: str) -> Column:
    """Seconds since the last change, else since creation; null without either."""
    return F.unix_timestamp(ts(now)) - F.unix_timestamp(F.coalesce("status_updated_at", "created_at"))


def is_stale(now: str, null_is_stale: bool, layout_timeout: int = 180, other_timeout: int = 900) -> Column:
    """Older than the timeout of its state; without any timestamp as ``null_is_stale`` says."""
    limit = F.when(F.col("status") == "layout_detection", layout_timeout).otherwise(other_timeout)
    return F.coalesce(age_seconds(now) >= limit, F.lit(null_is_stale))


def edges(spark) -> DataFrame:
    """Moves of the state graph, one row each."""
    return spark.createDataFrame([(a, b) for a, to in TRANSITIONS.items() for b in to], "from_state string, to_state string")


def invalid_transitions(moves: DataFrame) -> DataFrame:
    """Moves (from_state, to_state) that the state graph does not have."""
    return moves.join(F.broadcast(edges(moves.sparkSession)), ["from_state", "to_state"], "left_anti")


def state_flags(pages: DataFrame) -> DataFrame:
    """What each page's state allows; flags are null for a null state, ``n_next`` also for unknown ones."""
    s = F.col("status")
    nexts = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.lit(len(v)))])
    return pages.select("page_id", "status", s.isin(*WORKER_STOP).alias("worker_terminal"), s.isin(*LEAF_FINAL).alias("leaf_final"), nexts[s].alias("n_next"))


def material_bucket(c: Column) -> Column:
    """book, newspaper or microfilm, to which archival documents belong; null and unknown materials are books."""
    m = F.lower(F.trim(c))
    return F.when(m.isin("book", "newspaper", "microfilm"), m).when(m == "archival_document", "microfilm").otherwise("book")


def preferred_uri(df: DataFrame) -> DataFrame:
    """Output uri, else input uri, and which it was; empty counts as null, and both null stay null."""
    out, inp = F.nullif(F.col("output_uri"), F.lit("")), F.nullif(F.col("input_uri"), F.lit(""))
    return df.withColumns({"uri": F.coalesce(out, inp), "uri_source": F.when(out.isNotNull(), "output").when(inp.isNotNull(), "input")})


def canonical_filename() -> Column:
    """page_0001.tiff, with reading order or else sub page as suffix; a missing page number shows as ``null``."""
    suffix = F.coalesce("reading_order", "sub_page_index")
    return F.concat(F.format_string("page_%04d", "page_number"), F.coalesce(F.concat(F.lit("_"), suffix.cast("string")), F.lit("")), F.lit(".tiff"))


def artifact_role() -> Column:
    """Role of a page's artifact, the first that holds of split child, human correction, output; null flags do not hold."""
    return F.when(F.col("sub_page_index").isNotNull(), "split_child").when(F.col("human_corrected"), "human_corrected").when(F.nullif(F.col("output_uri"), F.lit("")).isNotNull(), "normalized_output").otherwise("original_upload")


def resolve_dims(df: DataFrame) -> DataFrame:
    """Correction size if both sides are positive, else the downsample size, else rejected."""
    corr, down = (F.col("corr_w") > 0) & (F.col("corr_h") > 0), (F.col("down_w") > 0) & (F.col("down_h") > 0)
    return df.withColumns({"width": F.when(corr, F.col("corr_w")).when(down, F.col("down_w")), "height": F.when(corr, F.col("corr_h")).when(down, F.col("down_h")), "dims_source": F.when(corr, "correction").when(down, "downsample").otherwise("rejected")})


def in_source_window(at: Column, window: str | None) -> Column:
    """``all``, ``manual``, empty and unrecognised windows pass; ``YYYYwWW`` wants that ISO week; null times fail it."""
    import re

    m = re.fullmatch(r"(\d{4})w(\d{1,2})", window or "")
    if not m:
        return F.lit(True)
    return F.coalesce((F.extract(F.lit("YEAROFWEEK"), at) == int(m[1])) & (F.weekofyear(at) == int(m[2])), F.lit(False))


def child_crops(spreads: DataFrame) -> DataFrame:
    """Left (0) and right (1) half of each spread, cut at split_x or in the middle; a cut outside the page is rejected."""
    cut = F.coalesce("split_x", F.expr("width div 2"))
    halves = spreads.withColumn("cut", cut).where((F.col("cut") > 0) & (F.col("cut") < F.col("width"))).withColumn("sub_page_index", F.explode(F.array(F.lit(0), F.lit(1))))
    left = F.col("sub_page_index") == 0
    return halves.withColumns({"x_min": F.when(left, 0).otherwise(F.col("cut")), "x_max": F.when(left, F.col("cut")).otherwise(F.col("width"))}).drop("cut")


def has_children(pages: DataFrame) -> Column:
    """Whether a page or its siblings are split; a block holds all of a page, so the window needs no other layout."""
    return F.max(F.col("sub_page_index").isNotNull()).over(Window.partitionBy(*PAGE_KEY, *(c for c in pages.columns if c == "page_block")))


def review_units(pages: DataFrame) -> DataFrame:
    """Pages without those parents that have children: one window, no self join."""
    child = has_children(pages)
    return pages.withColumn("_c", child).where(~(F.col("sub_page_index").isNull() & F.col("_c"))).drop("_c")


def by_job(pages: DataFrame, folds: dict[str, tuple[Callable[[Column], Column], Column]], parts: int | None) -> DataFrame:
    """One row for each job with ``count_if``, ``bool_and`` or ``bool_or`` of a condition under each name.

    With ``parts``, pages are folded by job and block where they lie, and blocks meet by job in so many parts: a task holds no
    more jobs in a larger table, and a job of very many pages is not one task's.  Without, all meet in the session's.
    """
    keys = ["job_id"] if parts is None else ["job_id", "page_block"]
    rows = pages.select(*keys, *(c.alias(n) for n, (_, c) in folds.items()))
    blocks = rows.groupBy(*keys).agg(*(how(F.col(n)).alias(n) for n, (how, _) in folds.items()))
    if parts is None:
        return blocks
    return blocks.repartition(parts, "job_id").groupBy("job_id").agg(*((F.sum if how is F.count_if else how)(F.col(n)).alias(n) for n, (how, _) in folds.items()))


def job_rollup(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """Leaf counts and the derived status of each job; a childless split parent counts as a leaf."""
    s = F.col("status")
    done = s.isin("split", *TERMINAL)
    rows = by_job(review_units(pages), {"n_leaf": (F.count_if, F.lit(True)), "n_accepted": (F.count_if, s == "accepted"), "n_review": (F.count_if, s == "review"), "n_failed": (F.count_if, s == "failed"),
        "n_pending": (F.count_if, s.isin(*HUMAN_ONLY)), "q": (F.bool_and, s == "queued"), "f": (F.bool_and, s == "failed"), "d": (F.bool_and, done)}, parts)
    status = F.when(F.col("q"), "queued").when(~F.col("d"), "running").when(F.col("f"), "failed").otherwise("done")
    return rows.withColumn("job_status", status).drop("q", "f", "d")


def qa_gate(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """Per job: satisfied when every page that waits for review is approved and none waits for correction (split parents aside)."""
    rows = pages.withColumn("parent", F.col("sub_page_index").isNull() & has_children(pages))
    waits = F.col("status") == "ptiff_qa_pending"
    blocked = (waits & ~F.col("qa_approved")) | ((F.col("status") == "pending_human_correction") & ~F.col("parent"))
    return by_job(rows.where("status <> 'split'"), {"blocked": (F.bool_or, blocked), "n_waiting": (F.count_if, waits)}, parts).select("job_id", (~F.col("blocked")).alias("gate_ready"), "n_waiting")


def viewer_summary(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """Counts of each job for the viewer, split parents aside, and whether its gate is ready; a null approval counts as neither."""
    s = F.col("status")
    waits, approved = s == "ptiff_qa_pending", F.col("qa_approved")
    met = {"total": F.lit(True), "pending": waits & ~approved, "approved": waits & approved, "in_correction": s == "pending_human_correction", "released": s.isin("accepted", "layout_detection")}
    counts = by_job(pages.where("status <> 'split'"), {n: (F.count_if, c) for n, c in met.items()}, parts)
    return counts.withColumn("gate_ready", (F.col("pending") == 0) & (F.col("in_correction") == 0))


def closable_parents(pages: DataFrame) -> DataFrame:
    """Waiting parents of which there is a child, and all children are final."""
    kids = pages.groupBy(*PAGE_KEY).agg(F.count_if(F.col("sub_page_index").isNotNull()).alias("n_children"), F.bool_and(F.col("sub_page_index").isNull() | F.col("status").isin(*TERMINAL)).alias("closed"), F.bool_or(F.col("sub_page_index").isNull() & (F.col("status") == "pending_human_correction")).alias("waiting"))
    return kids.where("n_children > 0 AND closed AND waiting").select(*PAGE_KEY, "n_children")


def reading_order(pages: DataFrame) -> DataFrame:
    """Position of each page that is not a split parent, in reading order of its job."""
    w = Window.partitionBy("job_id").orderBy("page_number", F.coalesce(F.col("reading_order"), F.col("sub_page_index") + 1, F.lit(0)), F.coalesce("sub_page_index", F.lit(-1)))
    return pages.where("status <> 'split'").withColumns({"position": F.row_number().over(w), "previous_page": F.lag("page_id").over(w), "next_page": F.lead("page_id").over(w)})


def download_manifest(pages: DataFrame, warn_at: int = 100) -> DataFrame:
    """Ordered artifact list per job (bounded by the job), counts with and without output."""
    rows = preferred_uri(reading_order(pages))
    entry = F.struct("position", canonical_filename().alias("name"), F.coalesce("uri", F.lit("")).alias("uri"))
    lists = rows.groupBy("job_id").agg(F.sort_array(F.collect_list(entry)).alias("a"), F.count("*").alias("n_pages"), F.count_if(F.col("uri_source") == "output").alias("n_output"))
    return lists.select("job_id", "n_pages", "n_output", (F.col("n_pages") - F.col("n_output")).alias("n_without_output"), (F.col("n_pages") >= warn_at).alias("large"), F.array_join(F.transform("a", lambda x: F.concat(x["name"], F.lit("="), x["uri"])), ";").alias("manifest"))


def paginate(df: DataFrame, order: list[Column], limit: int, offset: int = 0, page: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One page of rows in a total order, and the total before paging; a page number wins over an offset."""
    start = (page - 1) * limit if page else offset
    return df.orderBy(*order).offset(start).limit(limit), df.agg(F.count("*").alias("total"))


def siblings(pages: DataFrame) -> DataFrame:
    """Split pages with two or more children that all have output."""
    kids = pages.where("sub_page_index IS NOT NULL").groupBy(*PAGE_KEY).agg(F.count("*").alias("n_children"), F.bool_and(F.nullif(F.col("output_uri"), F.lit("")).isNotNull()).alias("ready"))
    return kids.where("n_children >= 2 AND ready").select(*PAGE_KEY, "n_children")


def cancel_plan(pages: DataFrame) -> DataFrame:
    """Pages that a cancellation fails: leaves that work could still touch."""
    return review_units(pages).where(F.col("status").isin(*AUTOMATABLE, "ptiff_qa_pending", "pending_human_correction")).select("page_id", "job_id", F.col("status").alias("from_state"), F.lit("failed").alias("to_state"))


def release_plan(pages: DataFrame, jobs: DataFrame, parts: int | None = None) -> DataFrame:
    """Next state of every page that waits at a satisfied gate."""
    ready = qa_gate(pages, parts).where("gate_ready AND n_waiting > 0").select("job_id")
    to = F.when(F.col("pipeline_mode") == "layout", "layout_detection").otherwise("accepted")
    return pages.where("status = 'ptiff_qa_pending'").join(ready, "job_id", "left_semi").join(jobs.select("job_id", "pipeline_mode"), "job_id").select("page_id", "job_id", to.alias("to_state"))


#: Reviewer action -> (states it may leave, state it leads to; None keeps the state).
ACTIONS = {
    "approve": (("ptiff_qa_pending",), None),
    "edit": (("ptiff_qa_pending",), "pending_human_correction"),
    "flag": (("accepted", "ptiff_qa_pending"), "pending_human_correction"),
    "reject": (("pending_human_correction",), "review"),
    "send_to_review": (("layout_detection",), "pending_human_correction"),
    "correct": (("pending_human_correction",), "semantic_norm"),
    "split": (("pending_human_correction",), "split"),
}


def apply_actions(pages: DataFrame, actions: DataFrame) -> DataFrame:
    """Latest action of each page: its new state and approval flag, or a rejected action where the state forbids it."""
    last = actions.groupBy("page_id").agg(F.max_by("action", F.struct("moment", "action")).alias("action"))
    rows = pages.join(last, "page_id")
    allowed, to = F.lit(False), F.col("status")
    for name, (froms, target) in ACTIONS.items():
        allowed = F.when(F.col("action") == name, F.col("status").isin(*froms)).otherwise(allowed)
        to = F.when(F.col("action") == name, F.lit(target) if target else F.col("status")).otherwise(to)
    flag = F.when(F.col("action") == "approve", True).when(F.col("action").isin("edit", "flag"), False).otherwise(F.col("qa_approved"))
    return rows.select("page_id", "action", F.col("status").alias("from_state"), allowed.alias("applied"), F.when(allowed, to).otherwise(F.col("status")).alias("to_state"), F.when(allowed, flag).otherwise(F.col("qa_approved")).alias("approved"), F.when(allowed & (F.col("action") == "split"), 2).otherwise(0).alias("n_children"))
