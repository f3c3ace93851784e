"""Spans as HTML, and analyses to storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def html(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, html): each text with its spans, which don't overlap, marked and numbered, in numbered paragraphs.

    Paragraphs end at blank lines; blank ones are left out but counted.
    """
    marks = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "label", "dep", "head"))).alias("s"))
    rows = docs.select("doc_id", "text").join(marks, "doc_id", "left")
    rows = rows.withColumn("s", F.coalesce("s", F.array().cast(marks.schema["s"].dataType)))
    cut = lambda a, b: escaped(F.substring("text", a + 1, b - a))
    said = lambda c: escaped(F.coalesce(c, F.lit("")))
    before = F.transform("s", lambda m, i: F.when(i == 0, 0).otherwise(F.get("s", i - 1)["stop"]))
    one = F.zip_with(F.zip_with("s", before, lambda m, b: F.struct(m.alias("m"), b.alias("b"))), F.sequence(F.lit(1), F.greatest(F.size("s"), F.lit(1))), lambda x, n: F.when(x.isNotNull(), F.concat(
        cut(x["b"], x["m"]["start"]),
        F.lit('<mark class="entity" id="ent-'), n.cast("string"), F.lit('" data-entity="'), said(x["m"]["label"]), F.lit('" data-dep="'), said(x["m"]["dep"]), F.lit('" data-head="'), said(x["m"]["head"]), F.lit('" tabindex="-1">'),
        cut(x["m"]["start"], x["m"]["stop"]), F.lit("</mark>"),
    )))
    tail = F.when(F.size("s") > 0, F.element_at("s", -1)["stop"]).otherwise(0)
    body = F.concat(F.array_join(one, ""), cut(tail, F.length("text")))
    paras = F.transform(F.split(body, r"\n\s*\n"), lambda p, i: F.struct(p.alias("p"), (i + 1).alias("i")))
    shown = F.transform(F.filter(paras, lambda x: F.trim(x["p"]) != ""), lambda x: F.concat(F.lit('<section><h6>Paragraph '), x["i"].cast("string"), F.lit("</h6><p>"), F.replace(x["p"], F.lit("\n"), F.lit("<br>")), F.lit("</p></section>")))
    return rows.select("doc_id", F.concat(F.lit('<div class="entities">'), F.array_join(shown, "\n"), F.lit("</div>")).alias("html"))


def numbered(html: Column, spans: Column) -> Column:
    """HTML whose entity marks have no ids yet, with ids and what ``spans``, an array of (label, dep, head), says of the n-th; marks beyond those are ``UNKNOWN``."""
    said = lambda c, none="": escaped(F.coalesce(c, F.lit(none)))
    parts = F.split(html, '(?=<mark class="entity")')
    first = F.when(F.startswith(html, F.lit('<mark class="entity"')), 1).otherwise(0)

    def mark(part: Column, i: Column) -> Column:
        n = i + first  # of the marks, from 1
        m = F.get(spans, n - 1)
        told = F.concat(F.lit('<mark class="entity" id="ent-'), n.cast("string"), F.lit('" data-entity="'), said(m["label"], "UNKNOWN"), F.lit('" data-dep="'), said(m["dep"]), F.lit('" data-head="'), said(m["head"]), F.lit('" tabindex="-1"'))
        return F.when(n > 0, F.concat(told, F.substring(part, F.lit(len('<mark class="entity"') + 1), F.length(part)))).otherwise(part)

    return F.array_join(F.transform(parts, mark), "")


def save(analyses: DataFrame, path: str) -> DataFrame:
    """Appends (id, title, timestamp, filename, version, data); the title of none is the file's name.

    Rows whose ``status``, if there is such a column, isn't ``complete``, and those without an
    id, are not written but returned as (id, error).
    """
    status = F.col("status") if "status" in analyses.columns else F.lit("complete")
    error = F.when(F.col("id").isNull(), "There is no such task.").when(~status.eqNullSafe(F.lit("complete")), "The analysis is not complete.")
    told = analyses.withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), "filename")).withColumn("error", error)
    told.where("error is null").drop("status", "error").write.mode("append").json(path)
    return told.where("error is not null").select("id", "error")
