"""A consultation from end to end: clips to turns, roles, drug names, gloss, note, document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinispark.operators import concepts as C
from clinispark.operators import drugs, notes, roles
from clinispark.plans import render
from clinispark.sources import backends


def turns_of(clips: DataFrame, diarizer: Callable, transcriber: Callable) -> DataFrame:
    """clips (recording_id, wav) -> turns with roles."""
    turns = backends.transcribe(clips, backends.diarize(clips, diarizer), transcriber)
    return roles.with_roles(turns, roles.assign(roles.scores(turns)))


def normalized(turns: DataFrame, drug_names: DataFrame, scripts: DataFrame, terms: DataFrame | None = None, concepts: DataFrame | None = None, embedder: Callable | None = None) -> DataFrame:
    """turns with drug names rewritten and concepts glossed.

    With a concept lexicon and an embedder, spans are matched by embedding; with terms (span, label, score), word by word.
    """
    out = drugs.rewrite(turns, drug_names, scripts)
    if concepts is not None and embedder is not None:
        return C.gloss_turns(out, C.embedding_matches(out, concepts, embedder))
    return C.gloss_turns(out, C.lexicon_spans(out, terms)) if terms is not None else out


def notes_of(turns: DataFrame, drug_names: DataFrame, extractor: Callable) -> DataFrame:
    """One note a recording."""
    text = roles.transcripts(turns).select(F.col("recording_id").cast("string").alias("note_id"), "transcript")
    return notes.build(backends.extract(text, extractor), drug_names)


def run(clips: DataFrame, drug_names: DataFrame, scripts: DataFrame, diarizer: Callable, transcriber: Callable, extractor: Callable, **gloss) -> DataFrame:
    """clips -> rendered rows of every recording; gloss as in `normalized`."""
    turns = normalized(turns_of(clips, diarizer, transcriber), drug_names, scripts, **gloss)
    return render.rows(notes_of(turns, drug_names, extractor))
