"""Operators that also run on streams of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def note_rates(notes: DataFrame, *, time: str = "ts", window: str = "1 hour", late: str = "10 minutes", key: str = "score_id") -> DataFrame:
    """(window_start, key, notes, low, high): notes and pitch range of each window; late notes are waited for."""
    w = notes.withWatermark(time, late) if notes.isStreaming else notes
    out = w.groupBy(F.window(time, window), key).agg(F.count("*").alias("notes"), F.min("midi").alias("low"), F.max("midi").alias("high"))
    return out.select(F.col("window.start").alias("window_start"), key, "notes", "low", "high")
