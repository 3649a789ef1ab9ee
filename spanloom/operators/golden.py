"""The labelled query set: passages, proposals, quotes, the review log, materialisation and validation."""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import fold_query, tokens
from spanloom.operators.aggregate import CATEGORIES, ORIGINS, counts_with_zero

#: Fixed values of the curation rules.
MIN_QUOTE, MAX_QUOTE = 20, 600
MIN_GAIN, MAX_GAIN, RELEVANT = 1, 3, 2
TARGET_SIZE, MIN_PER_CATEGORY = 100, 12
MIN_SOURCE_CHARS, WINDOW_CHARS, TRIES = 2000, 1500, 20
ECHO_SHARE, ECHO_RUN = 0.8, 6
SETTLED = ("accept", "edit", "reject")


def _picks(sizes: list[tuple[object, int]], count: int, seed: int, window: int) -> Iterator[tuple[object, int, int]]:
    """(document, start, end), documents in turn; a passage drawn before is drawn anew; TRIES x count draws at most."""
    rng, given = random.Random(seed), set()
    draws = iter(range(TRIES * count))
    for doc, n in itertools.cycle(sizes):
        span = min(window, n)
        fresh = ((doc, start) for _ in draws if (start := rng.randrange(n - span + 1)) is not None)
        pick = next((p for p in fresh if p not in given), None)
        if pick is None:
            return
        given.add(pick)
        yield doc, pick[1], pick[1] + span


def sample_passages(docs: DataFrame, count: int, seed: int, window: int = WINDOW_CHARS) -> DataFrame:
    """(passage_id, ord, doc_id, char_start, char_end, text): round-robin over documents long enough, offsets by a seeded generator.

    Only ids and lengths of the first eligible documents, one for each passage, go to the driver.  Too few passages are
    an error.
    """
    sized = docs.where(F.length("text") >= MIN_SOURCE_CHARS).select("doc_id", F.length("text").alias("n")).orderBy("doc_id").limit(count)
    sizes = [(r["doc_id"], r["n"]) for r in sized.collect()]
    picks = [(i, *p) for i, p in enumerate(itertools.islice(_picks(sizes, count, seed, window), count))] if sizes else []
    if len(picks) < count:
        raise ValueError(f"{len(picks)} passages of {count}: the documents hold no more")
    rows = docs.sparkSession.createDataFrame(picks, f"ord int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, char_start int, char_end int")
    return docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select(F.format_string("p-%04d", "ord").alias("passage_id"), "ord", "doc_id", "char_start", "char_end", F.expr("substring(text, char_start + 1, char_end - char_start)").alias("text"))


def hashed_passages(docs: DataFrame, per_doc: int = 1, window: int = WINDOW_CHARS) -> DataFrame:
    """Passages at offsets that a hash of document and ordinal names: the same rule without the driver, at any size."""
    n = F.length("text")
    rows = docs.where(n >= MIN_SOURCE_CHARS).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.lit(per_doc - 1))).alias("ord"))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("ord").cast("string"))), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("char_start", (key % (n - F.least(F.lit(window), n) + 1)).cast("int")).withColumn("char_end", F.col("char_start") + F.least(F.lit(window), n))
    return rows.select("doc_id", "ord", "char_start", "char_end", F.expr("substring(text, char_start + 1, char_end - char_start)").alias("text"))


def quote_code(quote: Column, passage: Column) -> Column:
    """Why a quote cannot be placed: too short, too long, not found, ambiguous (overlapping repeats count); else null."""
    at = F.call_function("locate", quote, passage)
    again = F.call_function("locate", quote, passage, at + 1)
    return F.when(F.length(quote) < MIN_QUOTE, "quote-too-short").when(F.length(quote) > MAX_QUOTE, "quote-too-long").when(at == 0, "quote-not-found").when(again > 0, "quote-ambiguous")


def resolve_quotes(rows: DataFrame) -> DataFrame:
    """rows (..., quote, text, char_start of the passage) with code, quote_start and quote_end in the document."""
    code = quote_code(F.col("quote"), F.col("text"))
    start = F.col("char_start") + F.call_function("locate", F.col("quote"), F.col("text")) - 1
    return rows.withColumn("code", code).withColumn("quote_start", F.when(F.col("code").isNull(), start)).withColumn("quote_end", F.col("quote_start") + F.length("quote"))


def judge_proposals(proposals: DataFrame) -> DataFrame:
    """proposals (passage_id, ord, doc_id, char_start, text, decline, query, category, spans) with code and labels.

    spans: array<struct<quote, gain>>.  Columns that a caller of a model may add: request_failed and tool_called (both
    boolean).  The first check that fails gives the code: request-failed, no-tool-call, declined, no-query, bad-category,
    no-spans, then for each span in turn bad-gain or its quote's code, then duplicate-span; null means a candidate, with
    id ``c-%04d`` by ord (gaps where passages were rejected).
    """
    spans = F.coalesce("spans", F.array().cast("array<struct<quote:string,gain:int>>"))
    per_span = F.transform(spans, lambda s: F.when(s["gain"].isNull() | ~s["gain"].between(MIN_GAIN, MAX_GAIN), "bad-gain").otherwise(quote_code(F.coalesce(s["quote"], F.lit("")), F.col("text"))))
    first = F.get(F.filter(per_span, lambda c: c.isNotNull()), F.lit(0))
    label = lambda s: F.struct(F.col("doc_id").alias("doc_id"), (F.col("char_start") + F.call_function("locate", s["quote"], F.col("text")) - 1).alias("char_start"), (F.col("char_start") + F.call_function("locate", s["quote"], F.col("text")) - 1 + F.length(s["quote"])).alias("char_end"), s["gain"].alias("gain"), s["quote"].alias("quote"))
    said = lambda c, otherwise: F.coalesce(F.col(c), F.lit(otherwise)) if c in proposals.columns else F.lit(otherwise)
    code = (
        F.when(said("request_failed", False), "request-failed")
        .when(~said("tool_called", True), "no-tool-call")
        .when(F.coalesce("decline", F.lit(False)), "declined")
        .when(F.trim(F.coalesce("query", F.lit(""))) == "", "no-query")
        .when(~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), "bad-category")
        .when(F.size(spans) == 0, "no-spans")
        .when(first.isNotNull(), first)
    )
    rows = proposals.withColumn("code", code).withColumn("labels", F.when(F.col("code").isNull(), F.transform(spans, label)))
    keys = F.transform("labels", lambda x: F.struct(x["doc_id"], x["char_start"], x["char_end"]))
    rows = rows.withColumn("code", F.when(F.col("code").isNull() & (F.size(F.array_distinct(keys)) < F.size(keys)), "duplicate-span").otherwise(F.col("code")))
    return rows.withColumn("labels", F.when(F.col("code").isNull(), F.col("labels"))).withColumn("candidate_id", F.when(F.col("code").isNull(), F.format_string("c-%04d", "ord")))


def echo(rows: DataFrame) -> DataFrame:
    """rows (..., query, text) with overlap (share of the query's distinct tokens in the passage) and longest_run (tokens).

    The run is found by a fold over the passage's tokens that keeps, for each place of the query, the length of the
    common run ending there.
    """
    q, p = tokens(F.col("query")), tokens(F.col("text"))
    rows = rows.withColumn("q", q).withColumn("p", p)
    share = F.when(F.size("q") == 0, 0.0).otherwise(F.size(F.array_intersect("q", "p")) / F.size(F.array_distinct("q")))
    start = F.struct(F.transform("q", lambda _: F.lit(0)).alias("runs"), F.lit(0).alias("best"))

    def step(acc: Column, t: Column) -> Column:
        runs = F.transform("q", lambda x, i: F.when(x == t, F.when(i == 0, 1).otherwise(F.coalesce(F.get(acc["runs"], i - 1), F.lit(0)) + 1)).otherwise(0))
        return F.struct(runs.alias("runs"), F.greatest(acc["best"], F.coalesce(F.array_max(runs), F.lit(0))).alias("best"))

    # only tokens of the query can extend a run; one that is not resets it
    known = F.transform("p", lambda t: F.when(F.array_contains("q", t), t).otherwise(""))
    run = F.when(F.size("q") == 0, 0).otherwise(F.aggregate(known, start, step, lambda acc: acc["best"]))
    return rows.withColumn("overlap", share).withColumn("longest_run", run).drop("q", "p")


def echo_warning(rows: DataFrame) -> DataFrame:
    """Advice for queries that repeat their passage."""
    much = F.when(F.col("overlap") >= ECHO_SHARE, F.format_string("%.0f%% of the query's words are in the passage", F.col("overlap") * 100))
    long = F.when(F.col("longest_run") >= ECHO_RUN, F.format_string("%d words in a row are the passage's", "longest_run"))
    return rows.withColumn("warning", F.nullif(F.concat_ws("; ", much, long), F.lit("")))


def pairs_inside(queries: DataFrame, labels: DataFrame, docs: DataFrame) -> DataFrame:
    """The queries all of whose labels lie in docs; a query without labels has none outside, but is not asked for either."""
    held = docs.select("doc_id").distinct().withColumn("held", F.lit(True))
    inside = labels.join(held, "doc_id", "left").groupBy("query_id").agg(F.bool_and(F.coalesce("held", F.lit(False))).alias("inside")).where("inside")
    return queries.join(inside.select("query_id"), "query_id", "left_semi")


def latest(log: DataFrame) -> DataFrame:
    """The last decision of each subject by seq: later wins, and file order is no part of it."""
    cols = [c for c in log.columns if c != "subject"]
    return log.groupBy("subject").agg(F.max_by(F.struct(*cols), "seq").alias("d")).select("subject", "d.*")


def materialise_set(log: DataFrame) -> DataFrame:
    """Decisions that make pairs: the latest of a subject, if it accepts or edits."""
    return latest(log).where(F.col("action").isin("accept", "edit"))


def pending(candidates: DataFrame, log: DataFrame, skip_returns: bool = True) -> DataFrame:
    """Candidates (subject, ...) that no latest decision settles; a skipped one returns unless told otherwise."""
    settled = latest(log).where(F.col("action").isin(*(SETTLED if skip_returns else (*SETTLED, "skip"))))
    return candidates.join(settled.select("subject"), "subject", "left_anti")


def review_summary(log: DataFrame, generated: DataFrame) -> DataFrame:
    """One row: generated, recorded, subjects, one count for each action among the latest, superseded."""
    now = latest(log).agg(F.count(F.lit(1)).alias("subjects"), *[F.count_if(F.col("action") == a).alias(a) for a in ("accept", "edit", "reject", "skip")])
    return generated.agg(F.count(F.lit(1)).alias("generated")).crossJoin(log.agg(F.count(F.lit(1)).alias("recorded"))).crossJoin(now).withColumn("superseded", F.col("recorded") - F.col("subjects"))


def edited_fields(before: DataFrame, after: DataFrame) -> DataFrame:
    """(subject, edited_fields, action): what a reviewer changed of query, category and labels; edit if anything."""
    a = after.select("subject", *[F.col(c).alias("new_" + c) for c in ("query", "category", "labels")])
    changed = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col("new_" + c)), c) for c in ("query", "category", "labels")]))
    return before.join(a, "subject").select("subject", changed.alias("edited_fields"), F.when(F.size(changed) > 0, "edit").otherwise("accept").alias("action"))


def query_id_of(candidate_id: Column) -> Column:
    return F.regexp_replace(candidate_id, "^c-", "q-")


def next_human_id(queries: DataFrame) -> DataFrame:
    """One row: the next id of a hand-written query."""
    n = F.regexp_extract("query_id", r"^q-h-(\d+)$", 1)
    return queries.agg(F.format_string("q-h-%03d", F.coalesce(F.max(F.when(n != "", n.cast("int"))), F.lit(0)) + 1).alias("query_id"))


def set_problems(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """(problem, subject, n): ids, folded queries or spans that occur twice, and queries without a relevant label.

    Queries alike once folded are named by the text of the first by id, as it stands in the set.
    """
    twice = queries.groupBy("query_id").count().where("count > 1").select(F.lit("duplicate-id").alias("problem"), F.col("query_id").alias("subject"), F.col("count").alias("n"))
    folded = queries.select("query_id", "query", fold_query(F.col("query")).alias("folded")).groupBy("folded").agg(F.min(F.struct("query_id", "query")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate-query").alias("problem"), F.col("first.query").alias("subject"), "n")
    spans = labels.groupBy("query_id", "doc_id", "char_start", "char_end").count().where("count > 1").select(F.lit("duplicate-span").alias("problem"), F.col("query_id").alias("subject"), F.col("count").alias("n"))
    bare = queries.join(labels.where(F.col("gain") >= RELEVANT).select("query_id"), "query_id", "left_anti").select(F.lit("no-relevant-label").alias("problem"), F.col("query_id").alias("subject"), F.lit(0).cast("long").alias("n"))
    return twice.unionByName(folded).unionByName(spans).unionByName(bare)


def validate_labels(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, char_start, char_end, severity, code): at most one error a label, the first that holds."""
    joined = labels.join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id", "left")
    actual = F.expr("substring(whole, char_start + 1, char_end - char_start)")
    code = F.when(F.col("whole").isNull(), "unknown-document").when(F.col("char_end") > F.length("whole"), "span-out-of-range").when(actual != F.col("quote"), "quote-mismatch")
    return joined.withColumn("code", code).where("code is not null").select("query_id", "doc_id", "char_start", "char_end", F.lit("error").alias("severity"), "code")


def validate_policy(queries: DataFrame, target: int = TARGET_SIZE, per_category: int = MIN_PER_CATEGORY) -> DataFrame:
    """(severity, code, subject, n): warnings about the size of the set, thin categories and missing human queries."""
    total = queries.agg(F.count(F.lit(1)).alias("n"))
    small = total.where(F.col("n") < target).select(F.lit("warning").alias("severity"), F.lit("set-incomplete").alias("code"), F.lit("all").alias("subject"), "n")
    thin = counts_with_zero(queries, "category", CATEGORIES).where(F.col("n") < per_category).select(F.lit("warning").alias("severity"), F.lit("category-under-populated").alias("code"), F.col("category").alias("subject"), "n")
    human = counts_with_zero(queries, "origin", ORIGINS).where("origin = 'human' and n = 0").crossJoin(total.where("n > 0").select()).select(F.lit("warning").alias("severity"), F.lit("no-human-authored-queries").alias("code"), F.lit("human").alias("subject"), "n")
    return small.unionByName(thin).unionByName(human)
