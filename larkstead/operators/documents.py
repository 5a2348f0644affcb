"""Document funnel: text-layer probe, language runs, sections, scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Pages up to which a document is worked on without asking.
MAX_PAGES_AUTO = 64
#: Median characters from which a text layer counts.
LEAST_CHARS = 200


def text_layer(pages: DataFrame, by: str) -> DataFrame:
    """Per document (column ``by``): pages, median characters, whether the text layer serves and whether work starts by itself."""
    chars = F.char_length(F.coalesce("text", F.lit("")))
    out = pages.groupBy(by).agg(F.count(F.lit(1)).alias("pages"), F.floor(F.median(chars)).cast("long").alias("median_chars"))
    return out.withColumn("has_text", F.col("median_chars") >= LEAST_CHARS).withColumn("automatic", F.col("pages") <= MAX_PAGES_AUTO)


def language_runs(pages: DataFrame, by: str | None = None) -> DataFrame:
    """Stretches of successive pages of one language: (by, run, lang, first_page, last_page, pages).

    Windows are per document; without ``by`` all pages are one document's.
    """
    keys = [by] if by else []
    w = W.Window.partitionBy(*keys).orderBy("page")
    begins = F.when(F.col("lang").eqNullSafe(F.lag("lang").over(w)) & F.lag("page").over(w).isNotNull(), 0).otherwise(1)
    numbered = pages.select(*keys, "page", "lang", begins.alias("_b")).withColumn("run", F.sum("_b").over(w))
    return numbered.groupBy(*keys, "run", "lang").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count(F.lit(1)).alias("pages"))


def scope(pages: DataFrame, languages: list[str]) -> DataFrame:
    """(lang, pages, share) of the household's languages; share of all pages."""
    per = pages.groupBy("lang").agg(F.count(F.lit(1)).alias("pages"))
    total = per.agg(F.sum("pages").alias("_all"))
    return per.where(F.col("lang").isin(*languages)).crossJoin(F.broadcast(total)).select("lang", "pages", (F.col("pages") / F.col("_all")).alias("share"))


def section_problems(sections: DataFrame, total_pages: int | Column, by: str) -> DataFrame:
    """(by, code, problem) of each document's manifest: wrong lengths, ranges beyond the document, gaps and overlaps, codes used twice.

    Pages are numbered from 1. ``by`` names the document; ``total_pages`` may be a column.
    """
    w = W.Window.partitionBy(by).orderBy("pdf_start", "code")
    after = F.lag("pdf_end").over(w)
    same = W.Window.partitionBy(by, "code")
    checks = {
        "length": F.col("pages") != F.col("pdf_end") - F.col("pdf_start") + 1,
        "range": (F.col("pdf_start") < 1) | (F.col("pdf_end") > total_pages) | (F.col("pdf_end") < F.col("pdf_start")),
        "gap": F.col("pdf_start") > after + 1,
        "overlap": F.col("pdf_start") <= after,
        "duplicate": F.count(F.lit(1)).over(same) > 1,
    }
    found = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda x: x.isNotNull())
    return sections.withColumn("problem", found).select(by, "code", F.explode("problem").alias("problem"))


def page_sections(pages: DataFrame, sections: DataFrame, most: int = 10_000) -> DataFrame:
    """pages with the code of the section that holds each; null for pages in none.

    The range join is an equi-join: a section is listed under every block of pages it touches. A
    section list up to ``most`` rows is broadcast, a longer one is not.
    """
    size = 64
    blocks = sections.select("code", "pdf_start", "pdf_end", F.explode(F.sequence(F.floor(F.col("pdf_start") / size), F.floor(F.col("pdf_end") / size))).alias("_block"))
    if sections.limit(most + 1).count() <= most:
        blocks = F.broadcast(blocks)
    p = pages.withColumn("_p", F.floor(F.col("page") / size))
    inside = (F.col("_p") == F.col("_block")) & F.col("page").between(F.col("pdf_start"), F.col("pdf_end"))
    return p.join(blocks, inside, "left").select(*pages.columns, "code")


def index_drift(sections: DataFrame, by: str) -> DataFrame:
    """(by, code, offset, drift): where a section begins against its printed page, and how that changes along its document."""
    w = W.Window.partitionBy(by).orderBy("pdf_start", "code")
    offset = F.col("pdf_start") - F.col("printed_page")
    return sections.select(by, "code", "pdf_start", offset.alias("offset")).withColumn("drift", F.col("offset") - F.lag("offset").over(w)).select(by, "code", "offset", "drift")


def reconcile(index: DataFrame, detected: DataFrame) -> DataFrame:
    """(code, start, source, conflict) of boundaries by a printed index and by detection; detection wins, and says so."""
    i, d = index.select("code", F.col("start").alias("_i")), detected.select("code", F.col("start").alias("_d"))
    source = F.when(F.col("_i").isNull(), "detected").when(F.col("_d").isNull(), "index").when(F.col("_i") == F.col("_d"), "both").otherwise("detected")
    return i.join(d, "code", "full_outer").select("code", F.coalesce("_d", "_i").alias("start"), source.alias("source"), F.coalesce(F.col("_i") != F.col("_d"), F.lit(False)).alias("conflict"))


def batch_cost(sections: DataFrame, overhead: int = 32_000) -> DataFrame:
    """(calls, tokens): calls and their fixed overhead, one call a section (column tokens)."""
    return sections.agg(F.count(F.lit(1)).alias("calls"), (F.coalesce(F.sum("tokens"), F.lit(0)) + F.count(F.lit(1)) * overhead).cast("long").alias("tokens"))


def redacted_export(documents: DataFrame, hidden: tuple[str, ...] = ("price", "serial", "serial_enc", "serial_hmac")) -> DataFrame:
    return documents.drop(*hidden)
