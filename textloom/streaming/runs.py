"""Streaming forms: counters, recurrence, debounce, chunk joining.

The batch operators define the results; streams keep the same columns. Watermarks and
windows are added here, since Structured Streaming needs them to drop state.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import runs


def stats(events: DataFrame) -> DataFrame:
    """Running counters of all run events (complete mode)."""
    return events.groupBy().agg(*runs.run_counters())


def command_counts(events: DataFrame) -> DataFrame:
    """Running counts per command (complete or update mode)."""
    return events.groupBy("command_key").agg(F.count("*").alias("runs"))


def nudges(events: DataFrame, threshold: int = runs.NUDGE_AT) -> DataFrame:
    """A row for each prompt run that is at least the ``threshold``-th of its fingerprint.

    State is one counter per fingerprint.
    """

    def count(key, batches, state):
        n = state.get[0] if state.exists else 0
        out = []
        for batch in batches:
            for seq in batch.sort_values("seq")["seq"]:
                n += 1
                if n >= threshold:
                    out.append((int(seq), key[0], n))
        state.update((n,))
        yield pd.DataFrame(out, columns=["seq", "skeleton_id", "running"])

    prompts = events.where("grp = 'prompt' AND skeleton_id IS NOT NULL AND skeleton_id <> ''").select("seq", "skeleton_id")
    return prompts.groupBy("skeleton_id").applyInPandasWithState(count, "seq long, skeleton_id string, running long", "n long", "append", "NoTimeout")


def debounce(saves: DataFrame, gap: str = "300 milliseconds", late: str = "10 minutes", key: str = "workspace", ts: str = "ts", path: str = "path") -> DataFrame:
    """One row per burst of saves: its last path, its end and its size."""
    source = saves.withWatermark(ts, late) if saves.isStreaming else saves
    return source.groupBy(F.session_window(ts, gap).alias("w"), F.col(key)).agg(F.max_by(path, ts).alias("path"), F.count("*").alias("saves")).select(key, F.col("w.start").alias("first_save"), F.col("w.end").alias("fires_at"), "path", "saves")


def hourly(events: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Extension: events, distinct-free sums per hour and type."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    return source.groupBy(F.window(ts, "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def joined_chunks(chunks: DataFrame, id_col: str = "id", seq_col: str = "seq", text_col: str = "chunk") -> DataFrame:
    """A text's chunks in order, as one text."""
    return chunks.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq_col).alias("s"), F.col(text_col).alias("t")))), lambda x: x["t"]), "").alias("text"))
