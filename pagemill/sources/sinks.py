"""Sinks: answers by study and run, transcripts as text, chunks by folder. A run counts as done once its marker exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = "=" * 80


def output_name(study: Column, label: Column, run: Column, kind: str) -> Column:
    """study[_label]_run_N_kind.txt; signs that a file name can't hold become "_"."""
    safe = lambda c: F.regexp_replace(c, r'[\\/:*?"<>|\s]+', "_")
    return F.concat(safe(study), F.when(label.isNotNull() & (F.length(label) > 0), F.concat(F.lit("_"), safe(label))).otherwise(""), F.lit("_run_"), run.cast("string"), F.lit(f"_{kind}.txt"))


def transcript(question: Column, output: Column, corrected: Column, pages: Column, debugging: bool = False) -> Column:
    """One question's part of a transcript; with debugging also the retrieved pages."""
    parts = [F.coalesce(question, F.lit("")), F.coalesce(output, F.lit("")), F.coalesce(corrected, F.lit(""))]
    if debugging:
        parts += [F.concat(F.lit("Number of Pages Retrieved: "), F.coalesce(F.size(pages), F.lit(0)).cast("string")), F.concat(F.lit("Page Numbers: "), F.coalesce(F.array_join(pages, ", "), F.lit("")))]
    return F.concat_ws("\n", *parts, F.lit(LINE))


def write_answers(answers: DataFrame, path: str) -> None:
    """Answers as Parquet, a folder for each study and run; a run's rows replace its earlier ones, others stay."""
    answers.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("study_id", "run_number").parquet(path)


def write_transcripts(states: DataFrame, path: str, debugging: bool = False) -> None:
    """A text line block for each state, in folders by output name."""
    named = states.select(output_name(F.col("study_id"), F.col("label"), F.col("run_number"), "full_convo").alias("file"), transcript(F.col("question"), F.col("output"), F.col("corrected_output"), F.col("retrieved_pages"), debugging).alias("value"))
    named.write.mode("append").partitionBy("file").text(path)


def write_chunks(chunked_pages: DataFrame, path: str, study: str = "study_id", start: str = "page_start") -> None:
    """Pages of chunks, a folder for each study and chunk; stands for the split files of a report."""
    chunked_pages.write.mode("overwrite").partitionBy(study, start).parquet(path)
