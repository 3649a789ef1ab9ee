"""From source records to documents: bodies, eligibility, the first n, metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import html_to_text, looks_like_html, normalise


@dataclass(frozen=True)
class Selection:
    """Which records make the corpus; lengths are inclusive."""

    courts: tuple[str, ...] = ()
    filed_from: str = ""
    filed_to: str = ""
    limit: int = 500
    min_chars: int = 2000
    max_chars: int = 200_000
    exclude_ocr: bool = True

    @property
    def corpus_id(self) -> str:
        return f"{'+'.join(self.courts)}-{self.filed_from}..{self.filed_to}-n{self.limit}"


def extract_body(plain: Column, markup: Column, normalised: bool = True) -> Column:
    """Plain text where there is any, else HTML (stripped where it looks like it), else empty; then normalised."""
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    body = F.when(filled(plain), plain).when(filled(markup), F.when(looks_like_html(markup), html_to_text(markup, built_in=not normalised)).otherwise(markup)).otherwise("")
    return normalise(body) if normalised else body


def eligible(rows: DataFrame, selection: Selection, body: str = "text", ocr: str | None = None) -> DataFrame:
    out = rows.where(F.length(body).between(selection.min_chars, selection.max_chars))
    return out.where(~F.coalesce(F.col(ocr), F.lit(False))) if selection.exclude_ocr and ocr else out


def first_n(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The first n in order of the key: a top-n in each task, then of those."""
    return rows.orderBy(key).limit(n)


def to_documents(records: DataFrame, metadata: DataFrame, selection: Selection) -> DataFrame:
    """records (id, cluster_id, plain_text, html, ocr, url) and metadata (cluster_id, title, court, date_filed) to documents.

    A record whose metadata is missing keeps empty fields.
    """
    rows = records.withColumn("text", extract_body(F.col("plain_text"), F.col("html")))
    kept = first_n(eligible(rows.where("text <> ''"), selection, ocr="ocr"), selection.limit, "id")
    joined = kept.join(metadata, "cluster_id", "left")
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("title", "court", "date_filed")]
    return joined.select(F.concat(F.lit("cl-"), F.col("id").cast("string")).alias("doc_id"), "text", *blank, F.coalesce("url", F.lit("")).alias("source_url"))
