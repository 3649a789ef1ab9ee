"""Documents to overlapping token windows with exact character spans, in one row-local expression (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.identity import row_id, text_json
from spanloom.functions.text import TOKEN
from spanloom.plans.config import Chunking

_GAP = r"[^\p{L}\p{N}]"


def chunks(docs: DataFrame, config: Chunking) -> DataFrame:
    """(doc_id, chunk_id, token_start, token_end, char_start, char_end, text) of windows over docs (doc_id, text).

    A window starts every size - overlap tokens; the first to reach the last token is the last.  Spans are half-open
    and count characters of the text; windows begin and end with a token.  Documents without a token have none.
    """
    size, stride = config.chunk_size, config.chunk_size - config.chunk_overlap
    # blocks of stride tokens, each with what follows it; a window is the head of a block and of those that it reaches into
    blocks = F.regexp_extract_all("text", F.lit(f"((?:{TOKEN}+{_GAP}*+){{1,{stride}}}+)"), F.lit(1))
    cut = docs.select("doc_id", blocks.alias("blocks"), F.length(F.regexp_extract("text", f"^({_GAP}*)", 1)).alias("lead"))
    last = F.size("blocks") - 1
    n = stride * last + F.regexp_count(F.get("blocks", last), F.lit(TOKEN))
    counted = cut.select("doc_id", "blocks", "lead", F.when(F.size("blocks") > 0, n).alias("n"))
    windows = F.when(F.col("n") <= size, 1).otherwise(F.ceil((F.col("n") - size) / stride).cast("int") + 1)
    # where windows start: a running sum over blocks
    starts = F.aggregate(
        F.slice("blocks", 1, windows - 1),
        F.array(F.col("lead")),
        lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + F.length(b)),
    )
    text = lambda i: F.regexp_extract(F.array_join(F.slice("blocks", i + 1, -(-size // stride)), ""), f"^({TOKEN}+(?:{_GAP}++{TOKEN}+){{0,{size - 1}}}+)", 1)
    made = F.transform(starts, lambda at, i: F.struct((i * stride).alias("token_start"), F.least(i * stride + size, F.col("n")).alias("token_end"), at.alias("char_start"), text(i).alias("text")))
    # outer, as Spark would work out the windows once more to leave empty ones out
    rows = counted.select("doc_id", F.explode_outer(F.when(F.col("n") > 0, made)).alias("w")).where("w is not null").select("doc_id", "w.*")
    identity = row_id(16, chunking=config.hash, doc_id=text_json(F.col("doc_id").cast("string")), token_end=F.col("token_end").cast("string"), token_start=F.col("token_start").cast("string"))
    return rows.select("doc_id", identity.alias("chunk_id"), "token_start", "token_end", "char_start", (F.col("char_start") + F.length("text")).alias("char_end"), "text")


def violations(chunk_rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks whose spans are empty, of another length than their text, or not what the document has there."""
    joined = chunk_rows.join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id", "left")
    wrong = (F.col("char_end") <= F.col("char_start")) | (F.col("token_end") <= F.col("token_start")) | (F.length("text") != F.col("char_end") - F.col("char_start"))
    other = F.expr("substring(whole, char_start + 1, char_end - char_start)") != F.col("text")
    return joined.where(wrong | other | F.col("whole").isNull()).select(chunk_rows.columns)
