"""Predicates over groups of records: kinds of files, supported elements, aliases, primaries, preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelgrid.functions import scalars as sc
from reelgrid.operators.election import first_issue


def subtitle_kind(files: DataFrame, path: str, probed: str) -> DataFrame:
    """Whether each file is a subtitle, by rules in order: plain extensions; an index beside its data and the reverse; probed format; data alone."""
    p = F.col(path)
    rows = files.select("*", sc.path_dir(p).alias("_dir"), F.lower(sc.path_stem(p)).alias("_stem"), sc.path_ext(p).alias("_ext"))
    pair = Window.partitionBy("_dir", "_stem")
    has = lambda e: F.max(F.col("_ext") == e).over(pair)
    kind = (
        F.when(F.col("_ext").isin("srt", "ass", "ssa", "vtt"), "text")
        .when((F.col("_ext") == "sub") & has("idx"), "companion")
        .when((F.col("_ext") == "idx") & has("sub"), "index")
        .when(F.col(probed).isin("srt", "ass", "webvtt", "microdvd", "subviewer"), "probed")
        .when((F.col("_ext") == "sub") & F.col(probed).isNull(), "guessed")
    )
    return rows.withColumn("kind", kind).drop("_dir", "_stem", "_ext")


def supported(elements: DataFrame, group: str, kind: str, detail: str) -> DataFrame:
    """First issue of each group: track kinds, attachments that aren't images, chapters, more than one thumbnail."""
    k, d = F.col(kind), F.coalesce(F.col(detail), F.lit(""))
    bad_track = F.max(~k.isin("video", "audio", "subtitle", "attachment", "chapter"))
    bad_attachment = F.max((k == "attachment") & ~d.startswith("image/"))
    chapters = F.max(k == "chapter")
    thumbs = F.count_if((k == "attachment") & d.startswith("image/"))
    g = elements.groupBy(group).agg(bad_track.alias("t"), bad_attachment.alias("a"), chapters.alias("c"), thumbs.alias("n"))
    return g.select(group, first_issue(("track", F.col("t")), ("attachment", F.col("a")), ("chapters", F.col("c")), ("thumbnails", F.col("n") > 1)).alias("issue"))


def aliases(outputs: DataFrame, inputs: DataFrame, path: str) -> DataFrame:
    """Outputs that are one of the inputs."""
    return outputs.join(inputs.select(path), path, "left_semi")


def primary(rows: DataFrame, key: list[str], order: list[Column | str], usable: Column) -> DataFrame:
    """First usable row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.where(usable).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def same_series(left: DataFrame, right: DataFrame, key: list[str], value: str, order: str, tolerance: float) -> DataFrame:
    """Whether both sides have equally many rows of a key and their values, in order, differ by at most the tolerance."""
    n = lambda d, s: d.select(*key, F.row_number().over(Window.partitionBy(*key).orderBy(order)).alias("_i"), F.col(value).alias(s))
    j = n(left, "_a").join(n(right, "_b"), [*key, "_i"], "full")
    return j.groupBy(*key).agg((F.count_if(F.col("_a").isNull() | F.col("_b").isNull()) == 0).alias("_n"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("_d")).select(*key, (F.col("_n") & F.coalesce(F.col("_d") <= tolerance, F.lit(True))).alias("same"))


def preferred(rows: DataFrame, key: list[str], lang: str, wanted: Column, order: str) -> DataFrame:
    """First row in the wanted language, else in the language of the first row."""
    w = Window.partitionBy(*key)
    first = F.first(lang).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = F.when(F.col(lang) == wanted, 0).when(F.col(lang).eqNullSafe(first), 1).otherwise(2)
    ranked = rows.select("*", level.alias("_level")).withColumn("_r", F.row_number().over(w.orderBy("_level", order)))
    return ranked.where("_r = 1").drop("_r", "_level")


def poor_stretch(rows: DataFrame, key: list[str], order: str, rich: Column, skip: int, share: float = 0.05) -> DataFrame:
    """Whether a stretch turns poor after at most ``skip`` rich rows and is rich in at most ``share`` of the rest; all rich is not poor."""
    w = Window.partitionBy(*key).orderBy(order)
    x = rows.select(*key, rich.cast("int").alias("_rich"), F.row_number().over(w).alias("_i"))
    first = F.min(F.when(F.col("_rich") == 0, F.col("_i"))).over(Window.partitionBy(*key))
    g = x.withColumn("_first", first).groupBy(*key).agg(F.min("_first").alias("_f"), F.avg(F.when(F.col("_i") >= F.col("_first"), F.col("_rich"))).alias("_share"))
    return g.select(*key, F.coalesce((F.col("_f") - 1 <= skip) & (F.col("_share") <= share), F.lit(False)).alias("poor"))


def best_neighbour(left: DataFrame, right: DataFrame, guess: DataFrame, key: list[str], lid: str, rid: str, lh: str, rh: str) -> DataFrame:
    """For guessed pairs of places, the pair of least distance within one place on either side; ties to the earlier places.

    ``left``/``right`` hold (key, place, hash) with places counted from 1;
    the three places a side are an equi-join, not a range join.
    """
    near = lambda c: F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)]))
    g = guess.select("*", near(lid).alias("_l")).select("*", near(rid).alias("_r"))
    a = left.select(*key, F.col(lid).alias("_l"), F.col(lh).alias("_x"))
    b = right.select(*key, F.col(rid).alias("_r"), F.col(rh).alias("_y"))
    d = F.bit_count(F.col("_x").bitwiseXOR(F.col("_y"))).cast("int")
    best = F.min(F.struct(d.alias("distance"), F.col("_l").alias("l"), F.col("_r").alias("r")))
    return g.join(a, [*key, "_l"]).join(b, [*key, "_r"]).groupBy(*key, lid, rid).agg(best.alias("b")).select(*key, lid, rid, "b.*")
