"""Script evidence, reading direction and orientation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def script_counts(text: Column) -> Column:
    """Counts of a text's characters: struct of arabic, latin and other; a null text has 0 of each.

    Letters and numbers of the Arabic script and Arabic-Indic digits are arabic, letters of the
    Latin script and other digits latin, everything else other.  JVM regular expressions, no
    Python.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))
    digits = r"\u0660-\u0669\u06F0-\u06F9"
    arabic = F.regexp_count(t, F.lit(rf"[\p{{IsArabic}}&&[\p{{L}}\p{{N}}]]|[{digits}]"))
    latin = F.regexp_count(t, F.lit(rf"[\p{{IsLatin}}&&[\p{{L}}\p{{N}}]]|[\p{{Nd}}&&[^{digits}]]"))
    return F.struct(arabic.cast("long").alias("arabic"), latin.cast("long").alias("latin"), (F.length(t) - arabic - latin).cast("long").alias("other"))


def script_evidence(lines: DataFrame) -> DataFrame:
    """Character shares, boxes and mean clipped confidence per page.  JVM regular expressions, no Python.

    Letters and digits of Arabic blocks are arabic, ASCII and Latin letters and digits latin,
    everything else other; ``script_counts`` counts whole scripts.
    """
    t = F.coalesce("text", F.lit(""))
    rows = lines.select("page_id", F.regexp_count(t, F.lit(r"[\p{IsArabic}&&[\p{L}\p{N}]]")).alias("a"), F.regexp_count(t, F.lit(r"[\p{IsLatin}0-9]|\p{Nd}")).alias("l0"), F.regexp_count(t, F.lit(r"[\p{IsArabic}&&\p{Nd}]")).alias("ad"), F.length(t).alias("n"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("conf", F.lit(0.0)))).alias("c"))
    s = rows.groupBy("page_id").agg(F.sum("a").alias("a"), F.sum(F.col("l0") - F.col("ad")).alias("l"), F.sum("n").alias("n"), F.count("*").alias("n_boxes"), F.avg("c").alias("c"))
    share = lambda c: F.when(F.col("n") == 0, 0.0).otherwise(F.round(c / F.col("n"), 6))
    return s.select("page_id", share(F.col("a")).alias("arabic_ratio"), share(F.col("l")).alias("latin_ratio"), share(F.col("n") - F.col("a") - F.col("l")).alias("garbage_ratio"), "n_boxes", (F.col("a") + F.col("l")).alias("n_chars"), F.round("c", 6).alias("mean_conf"))


def reading_direction(evidence: DataFrame, key: str) -> DataFrame:
    """rtl or ltr by character-weighted shares; a tie or no text is unresolved."""
    s = evidence.groupBy(key).agg(F.sum(F.col("arabic_ratio") * F.col("n_chars")).alias("a"), F.sum(F.col("latin_ratio") * F.col("n_chars")).alias("l"), F.sum("n_chars").alias("w"))
    return s.select(key, F.when((F.col("w") == 0) | (F.col("a") == F.col("l")), "unresolved").when(F.col("a") > F.col("l"), "rtl").otherwise("ltr").alias("direction"))


def assign_order(pages: DataFrame, key: str) -> DataFrame:
    """First and second page of a spread by direction; of more than two only the outermost stay."""
    s = pages.groupBy(key).agg(F.first("direction").alias("d"), F.count("*").alias("n"), F.min_by("uri", F.struct("x", "uri")).alias("l"), F.max_by("uri", F.struct("x", "uri")).alias("r"))
    rtl = F.col("d") == "rtl"
    return s.select(key, F.when(F.col("n") == 1, F.col("l")).when(rtl, F.col("r")).otherwise(F.col("l")).alias("first_uri"), F.when(F.col("n") > 1, F.when(rtl, F.col("l")).otherwise(F.col("r"))).alias("second_uri"))


def orientation(scores: DataFrame, key: str, least_ratio: float = 1.2, least_diff: float = 15.0) -> DataFrame:
    """Best of the rotations' scores; confident if it beats the second by ratio and difference (second 0: ratio 0)."""
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "rotation")
    top = scores.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy(key).agg(F.max(F.when(F.col("r") == 1, F.col("rotation"))).alias("rotation"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("best"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    ratio = F.when(F.col("second") > 0, F.col("best") / F.col("second")).otherwise(0.0)
    return top.select(key, "rotation", F.round(ratio, 6).alias("ratio"), ((ratio >= least_ratio) & (F.col("best") - F.col("second") >= least_diff)).alias("confident"))


def sibling_orientation(pages: DataFrame) -> DataFrame:
    """Two confident siblings that disagree conflict; one that is sure of a turn lends it to one that is not."""
    w = Window.partitionBy("job_id", "page_number").orderBy("sub_page_index").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    other = lambda c: F.when(F.col("sub_page_index") == 0, F.last(c).over(w)).otherwise(F.first(c).over(w))
    rows = pages.withColumns({"n": F.count("*").over(w), "o_rotation": other("rotation"), "o_confident": other("confident")})
    pair = F.col("n") == 2
    conflict = pair & F.col("confident") & F.col("o_confident") & (F.col("rotation") != F.col("o_rotation"))
    lent = pair & ~F.col("confident") & F.col("o_confident") & (F.col("o_rotation") != 0)
    return rows.select("page_id", F.when(lent, F.col("o_rotation")).otherwise(F.col("rotation")).alias("rotation"), conflict.alias("conflict"), lent.alias("inherited"))


def layout_diagnostics(docs: DataFrame) -> DataFrame:
    """Counts of a layout response and why it is empty: no pages, no blocks, no geometry, no text."""
    why = F.when(F.col("n_pages") == 0, "no_pages").when(F.col("n_blocks") == 0, "no_blocks").when(~F.col("any_geometry"), "no_geometry").when(F.col("text_length") == 0, "no_text")
    return docs.withColumn("empty_reason", why)
