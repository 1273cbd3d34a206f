"""Result-store analytics: summaries, leaderboard, cost, re-scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MEANS = {"avg_char_similarity": "char_similarity", "avg_char_accuracy": "char_accuracy", "avg_word_similarity": "word_similarity", "avg_word_accuracy": "word_accuracy", "avg_word_error_rate": "word_error_rate"}


def summary(results: DataFrame) -> DataFrame:
    """One row: how many results, and the means of five metrics. No rows: count 0 and nulls."""
    return results.agg(F.count("*").alias("total_evaluations"), *[F.avg(c).alias(n) for n, c in MEANS.items()])


def page_cost(avg_in: Column, avg_out: Column, price_in: float, price_out: float) -> Column:
    """Cost of a page at prices for a million tokens; 0 unless there is a price."""
    if not (price_in > 0 or price_out > 0):
        return F.lit(0.0)
    return avg_in / 1_000_000 * price_in + avg_out / 1_000_000 * price_out


def leaderboard(results: DataFrame, by: list[str], price_in: float = 0.0, price_out: float = 0.0, ordered: bool = True) -> DataFrame:
    """One row for each store (``by``: file, model ...), best mean word similarity first, ties by name.

    Token means are over all rows; compare :func:`cost_projection`.
    """
    rows = results.groupBy(*by).agg(
        F.count("*").alias("total_evaluations"), *[F.avg(c).alias(n) for n, c in MEANS.items()],
        F.avg("input_tokens").alias("avg_input_tokens"), F.avg("output_tokens").alias("avg_output_tokens"),
    )
    rows = rows.withColumn("page_cost", page_cost(F.col("avg_input_tokens"), F.col("avg_output_tokens"), price_in, price_out))
    return rows.orderBy(F.desc("avg_word_similarity"), *by) if ordered else rows


def leaderboard_tsv(board: DataFrame, model: str = "model", with_cost: bool = False) -> DataFrame:
    """The leaderboard as tab-separated lines, header first (one small table: a row for each store)."""
    names = [model, "total_evaluations", *MEANS] + (["avg_input_tokens", "avg_output_tokens", "page_cost"] if with_cost else [])
    head = ["Model", "TotalEvaluations", "AvgCharSimilarity", "AvgCharAccuracy", "AvgWordSimilarity", "AvgWordAccuracy", "AvgWordErrorRate"] + (["AvgInputTokens", "AvgOutputTokens", "PageCost"] if with_cost else [])
    kinds = {"total_evaluations": "%d", "avg_input_tokens": "%.2f", "avg_output_tokens": "%.2f", model: "%s"}
    line = F.format_string("\t".join(kinds.get(n, "%.6f") for n in names), *names)
    header = board.sparkSession.range(1).select(F.lit("\t".join(head)).alias("line"), F.lit(0).alias("part"), F.lit(0.0).alias("rank"), F.lit("").alias("name"))
    body = board.select(line.alias("line"), F.lit(1).alias("part"), (-F.col("avg_word_similarity")).alias("rank"), F.col(model).alias("name"))
    return header.union(body).orderBy("part", "rank", "name").select("line")


def cost_projection(results: DataFrame, price_in: float, price_out: float, doc_count: int = 1000, by: list[str] | None = None) -> DataFrame:
    """Mean tokens over the rows that have any, and what ``doc_count`` documents cost. Stores without tokens give no row."""
    used = results.where((F.col("input_tokens") > 0) | (F.col("output_tokens") > 0))
    rows = used.groupBy(*(by or [])).agg(F.count("*").alias("docs_with_tokens"), F.avg("input_tokens").alias("avg_input_tokens"), F.avg("output_tokens").alias("avg_output_tokens")).where("docs_with_tokens > 0")
    rows = rows.withColumns({"input_cost_per_doc": F.col("avg_input_tokens") / 1_000_000 * price_in, "output_cost_per_doc": F.col("avg_output_tokens") / 1_000_000 * price_out})
    rows = rows.withColumn("total_cost_per_doc", F.col("input_cost_per_doc") + F.col("output_cost_per_doc"))
    return rows.withColumns({f"estimated_{k}_cost": F.col(f"{k}_cost_per_doc") * doc_count for k in ("input", "output", "total")})


def fill_legacy_accuracy(results: DataFrame, recomputed: str = "recomputed_accuracy") -> DataFrame:
    """Stores from before character accuracy have 0 there; such rows with a response take the recomputed value, if any."""
    old = (F.col("char_accuracy") == 0) & (F.col("response") != "") & F.col(recomputed).isNotNull()
    return results.withColumn("char_accuracy", F.when(old, F.col(recomputed)).otherwise(F.col("char_accuracy")))


def backfill(results: DataFrame, rescored: str = "m", all_metrics: bool = False) -> DataFrame:
    """Results with stored metrics replaced where they differ, and ``changed``.

    Rows without a response or without a new score stay as they are. Two metrics are replaced, or all with ``all_metrics``.
    """
    able = (F.col("response") != "") & F.col(rescored).isNotNull()
    differs = ~(F.col("char_accuracy").eqNullSafe(F.col(f"{rescored}.char_accuracy"))) | ~(F.col("word_similarity").eqNullSafe(F.col(f"{rescored}.word_similarity")))
    out = results.withColumn("changed", F.coalesce(able & differs, F.lit(False)))
    names = [c for c in (MEANS.values() if all_metrics else ("char_accuracy", "word_similarity"))]
    return out.withColumns({c: F.when(F.col("changed"), F.col(f"{rescored}.{c}")).otherwise(F.col(c)) for c in names})


def backfill_counts(backfilled: DataFrame, store: str = "file") -> DataFrame:
    """How many stores changed and how many were up to date."""
    stores = backfilled.groupBy(store).agg(F.bool_or("changed").alias("changed"))
    return stores.agg(F.count_if("changed").alias("updated"), F.count_if(~F.col("changed")).alias("skipped"))


def cost_lines(projection: DataFrame, price_in: float, price_out: float, doc_count: int = 1000) -> DataFrame:
    """The projection as report lines, one array for each row."""
    line = F.format_string
    return projection.select(F.array(
        line("Documents analyzed: %d", "docs_with_tokens"),
        line("Average input tokens per document: %.2f", "avg_input_tokens"),
        line("Average output tokens per document: %.2f", "avg_output_tokens"),
        line("Average total tokens per document: %.2f", F.col("avg_input_tokens") + F.col("avg_output_tokens")),
        line("Input token price: $%.2f per 1M tokens", F.lit(float(price_in))),
        line("Output token price: $%.2f per 1M tokens", F.lit(float(price_out))),
        *[line(f"{k.title()} cost: $%.6f", f"{k}_cost_per_doc") for k in ("input", "output", "total")],
        *[line(f"{k.title()} cost of {doc_count} documents: $%.2f", f"estimated_{k}_cost") for k in ("input", "output", "total")],
    ).alias("lines"))


# Labels of the printed reports.
ROW_LABELS = (
    ("Character Similarity: %.3f", "char_similarity"), ("Character Accuracy: %.3f", "char_accuracy"), ("Word Similarity: %.3f", "word_similarity"), ("Word Accuracy: %.3f", "word_accuracy"),
    ("Word Error Rate: %.3f", "word_error_rate"), ("Total Words (Original): %d", "ref_words"), ("Total Words (Transcribed): %d", "hyp_words"), ("Correct Words: %d", "correct_words"),
    ("Substitutions: %d", "substitutions"), ("Deletions: %d", "deletions"), ("Insertions: %d", "insertions"),
)
SUMMARY_LABELS = (
    ("Total Evaluations: %d", "total_evaluations"), ("Average Character Similarity: %.3f", "avg_char_similarity"), ("Average Character Accuracy: %.3f", "avg_char_accuracy"),
    ("Average Word Similarity: %.3f", "avg_word_similarity"), ("Average Word Accuracy: %.3f", "avg_word_accuracy"), ("Average Word Error Rate: %.3f", "avg_word_error_rate"),
)


def row_lines(results: DataFrame) -> DataFrame:
    """A labelled block for each result, as an array of lines; the ignored characters only where there are some."""
    line = F.format_string
    head = [line("=== Results for %s ===", "identifier"), line("Image: %s", "image"), line("Transcript: %s", "transcript")]
    ignored = F.when(F.col("ignored_chars") > 0, F.array(line("Ignored Characters: %d", "ignored_chars"))).otherwise(F.array().cast("array<string>"))
    return results.select(F.concat(F.array(*head, *[line(text, c) for text, c in ROW_LABELS]), ignored).alias("lines"))


def summary_lines(means: DataFrame) -> DataFrame:
    """The labelled lines of a :func:`summary`; of no results no row."""
    rows = means.where("total_evaluations > 0")
    return rows.select(F.array(F.lit("=== SUMMARY STATISTICS ==="), *[F.format_string(text, c) for text, c in SUMMARY_LABELS]).alias("lines"))
