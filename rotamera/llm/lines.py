"""Line deduplication over windows of three consecutive lines, in DataFrame functions only.

Every window of a document is hashed from its lines' hashes. Windows that occur more than once
anywhere keep their first occurrence, by key, then text hash, then position; at every later one
all lines it covers are removed, overlapping windows merging. A line so removed is always still
there at its first place.

Windows are counted by partial aggregation, and only repeated ones are joined back, so a passage
that stands in a third of all documents is one row on the small side of a join that Spark can
split. Hashes have 128 bits.

Defined results: a text of fewer lines than a window is one window. Windows of blank lines only
are never removed. A null text stays null with 0 lines; an empty text has one (blank) line. A
null key comes first in order. Rows with equal key and text are one document and fare alike.
Other columns pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rotamera.llm.common import private

WINDOW = 3


def windows(docs: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """(_key, _th, pos, h1, h2, n): the windows of each document that are not blank."""
    lines = F.split(F.col(text), "\n")
    one = docs.where(F.col(text).isNotNull()).select(
        F.col(key).alias("_key"), F.xxhash64(text).alias("_th"),
        F.transform(lines, lambda x: F.struct(
            F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"),
            (F.trim(x) != "").alias("full"))).alias("_l"))
    spots = F.sequence(F.lit(0), F.greatest(F.size("_l") - window, F.lit(0)))
    own = one.select("_key", "_th", F.explode(F.transform(
        spots, lambda i: F.struct(i.alias("pos"), F.slice("_l", i + 1, window).alias("w")))).alias("_w"))
    return (own.where(F.exists("_w.w", lambda x: x["full"]))
            .select("_key", "_th", "_w.pos", F.xxhash64("_w.w.a").alias("h1"),
                    F.xxhash64(F.lit(1), F.col("_w.w.b")).alias("h2"), F.size("_w.w").alias("n")))


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW
            ) -> DataFrame:
    """(_key, _th, cut): for each document that has any, the positions of lines to remove."""
    w = windows(docs, key, text, window)
    place = F.struct("_key", "_th", "pos")
    known = (w.groupBy("h1", "h2", "n").agg(F.min(place).alias("first"),
                                            F.count(F.lit(1)).alias("times"))
             .where("times > 1").select("h1", "h2", "n", "first"))
    later = (w.join(known, ["h1", "h2", "n"])
             .where(~F.struct("_key", "_th", "pos").eqNullSafe(F.col("first"))))
    covered = F.flatten(F.transform(F.collect_set(F.struct("pos", "n")), lambda x: F.sequence(
        x["pos"], x["pos"] + x["n"] - 1)))
    return later.groupBy("_key", "_th").agg(F.array_distinct(covered).alias("cut"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
          out: str = "text", removed: str | None = None, total: str | None = None) -> DataFrame:
    """``docs`` with the cleaned text in column ``out``, and if asked for the number of lines
    removed and of lines there were."""
    own, at, cut, hashed = private(docs, "_text_hash", "_cut_key", "_cut", "_cut_hash")
    gone = repeats(docs, key, text, window).toDF(at, hashed, cut)
    met = docs.withColumn(own, F.xxhash64(text)).join(
        gone, F.col(key).eqNullSafe(F.col(at)) & (F.col(own) == F.col(hashed)), "left")
    lines = F.split(F.col(text), "\n")
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(cut))
    cleaned = F.when(F.col(cut).isNull(), F.col(text)).otherwise(
        F.array_join(F.transform(keep, lambda i: F.element_at(lines, i + 1)), "\n"))
    add = {out: cleaned}
    if removed:
        add[removed] = F.coalesce(F.size(cut), F.lit(0)).cast("long")
    if total:
        add[total] = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    names = list(dict.fromkeys([*docs.columns, *add]))
    return met.select(*[add[c].alias(c) if c in add else F.col(c) for c in names])
