"""Line dedup by content-defined chunks of lines; DataFrame functions only.

A chunk ends where a rolling hash over the hashes of the last two lines is
divisible by ``CHUNK``, so an inserted line shifts no boundary beyond its
neighbours.  Of chunks of several lines that occur more than once, byte for byte,
the first stays: that of the smallest (id, text hash, line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.llm.common import materialize, once

#: Lines that a chunk has on average.
CHUNK = 3
#: Factor of the rolling hash.
FACTOR = 31


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("bigint")


def chunked(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds ``lines`` and ``chunks``, an array of (start, stop) in lines, for rows (.., text)."""
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice("hashes", 1, F.greatest(F.size("hashes") - 1, F.lit(0))))
    ends = F.zip_with("hashes", before, lambda h, p: F.coalesce((h + FACTOR * p) % chunk == 0, F.lit(False)))
    ends = F.filter(F.transform(ends, lambda on, i: F.when(on, i + 1)), lambda i: i.isNotNull())
    rows = docs.withColumn("lines", once(F.split("text", "\n", -1)))
    rows = rows.withColumn("hashes", once(F.transform("lines", line_hash)))
    rows = rows.withColumn("ends", once(F.array_distinct(F.concat(ends, F.array(F.size("lines"))))))
    starts = F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.size("ends") - 1))
    chunks = F.zip_with(starts, "ends", lambda a, b: F.struct(a.alias("start"), b.alias("stop")))
    return rows.withColumn("chunks", once(chunks)).drop("hashes", "ends")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``docs`` with repeated chunks taken out of the text, and ``n_lines`` and ``n_removed``.

    A null text stays null with no lines.  A text of which all is removed is
    empty.  Rows equal in id and text are one document and keep the same lines.
    Other columns pass through; one that is named like a result gives way to it.
    """
    keep = [c for c in docs.columns if c not in (id_col, text_col, "n_lines", "n_removed")]
    # other columns travel in one struct, so that no name can clash
    rest = F.struct(*(F.col(f"`{c}`") for c in keep), F.lit(0).alias("_")).alias("rest")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), rest)
    body = F.transform("chunks", lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"), F.array_join(F.slice("lines", c["start"] + 1, c["stop"] - c["start"]), "\n").alias("body")))
    chunks = chunked(base.select("id", "th", "text"), chunk).where("text is not null")
    chunks = chunks.select("id", "th", F.explode(F.filter(once(body), lambda c: c["stop"] - c["start"] > 1)).alias("c"))
    chunks = chunks.select("id", "th", "c.start", "c.stop", "c.body", F.xxhash64("c.body").alias("h"))
    # what is joined to many rows is written first, so that a hot chunk's rows can be split there
    often = materialize(chunks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "often")
    seen = materialize(chunks.join(often.hint("merge"), "h"), "chunks")
    place = F.struct("id", "th", "start")
    first = materialize(seen.groupBy("h", "body").agg(F.min(place).alias("first")), "first")  # the bytes are compared here
    gone = seen.join(first, ["h", "body"]).where(~place.eqNullSafe(F.col("first")))
    gone = gone.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("gone"))
    gone = materialize(gone.select(F.col("id").alias("gone_id"), F.col("th").alias("gone_th"), "gone"), "gone")
    rows = base.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th")), "left")
    rows = rows.withColumn("lines", once(F.split("text", "\n", -1)))
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g["stop"]))
    stops = F.concat(F.transform("gone", lambda g: g["start"]), F.array(F.size("lines")))
    runs = F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop")))
    kept = F.flatten(F.transform(once(runs), lambda r: F.slice("lines", r["start"] + 1, r["stop"] - r["start"])))
    rows = rows.withColumn("kept", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    removed = F.coalesce(F.aggregate("gone", F.lit(0), lambda n, g: n + g["stop"] - g["start"]), F.lit(0))
    out = {id_col: F.col("id"), text_col: F.col("kept")} | {c: F.col("rest")[c] for c in keep}
    return rows.select(
        *(out[c].alias(c) for c in docs.columns if c in out),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("bigint").alias("n_lines"),
        removed.cast("bigint").alias("n_removed"),
    )
