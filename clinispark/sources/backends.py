"""Models behind functions: a backend is built once in a Python worker, kept from task to task, and mapped over batches.

diarizer(wav) -> [(start, end, speaker)], transcriber(wav, start, end) -> [text chunks], embedder([text]) -> matrix,
extractor(transcript) -> reply text. A factory takes no argument and returns the backend; secrets come from its closure
or the session's settings, never from code.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENTS = "recording_id string, start double, end double, speaker string"
ROUND = "note_id string, transcript string, raw string, attempt int, error string"
PROMPT = (
    "You write up a doctor's visit as JSON with exactly these keys: chief_complaint, history, symptoms (name, finding_status, "
    "severity, since), vitals (name, value), examination, diagnosis (term, snomed_id, status), medications (drug, dose, frequency, "
    "timing, duration), investigations, diagnostic_results, advice, follow_up, low_confidence_fields. Use null for what was not "
    "said. Never infer a dose. finding_status is Present unless denied. Ordered tests go to investigations, known results to "
    "diagnostic_results. frequency is how often, timing is when. Keep number and unit of a vital together.\n\nTranscript:\n"
)


def setting(spark: SparkSession, key: str) -> str:
    """A required session setting; fails at the driver where it is missing."""
    value = spark.conf.get(key, None)
    if not value:
        raise ValueError(f"set {key} in the session")
    return value


_built: dict[str, object] = {}


def kept(factory: Callable) -> Callable:
    """factory as a function that builds its backend once in a Python worker; equal factories share it, a new one replaces it.

    A worker holds one backend, as the models are large and a worker's stages follow one another.
    """
    from pyspark import cloudpickle

    key = hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()

    def get():
        if key not in _built:
            _built.clear()
            _built[key] = factory()
        return _built[key]

    return get


def diarize(clips: DataFrame, factory: Callable) -> DataFrame:
    """clips (recording_id, wav) -> SEGMENTS."""

    model_of = kept(factory)

    def run(frames):
        model = model_of()
        for f in frames:
            rows = [(r, float(a), float(b), s) for r, w in zip(f["recording_id"], f["wav"], strict=True) for a, b, s in sorted(model(w))]
            yield pd.DataFrame(rows, columns=["recording_id", "start", "end", "speaker"])

    return clips.select("recording_id", "wav").mapInPandas(run, SEGMENTS)


def transcribe(clips: DataFrame, segments: DataFrame, factory: Callable) -> DataFrame:
    """Turns (recording_id, turn_idx, speaker, text, start, end) of segments with speech."""

    model_of = kept(factory)

    def run(frames):
        model = model_of()
        for f in frames:
            f["text"] = [" ".join(t for c in model(w, a, b) if (t := c.strip())) for w, a, b in zip(f["wav"], f["start"], f["end"], strict=True)]
            yield f.drop(columns="wav")

    joined = segments.join(clips.select("recording_id", "wav"), "recording_id")
    spoken = joined.mapInPandas(run, "recording_id string, start double, end double, speaker string, text string").where("text <> ''")
    order = F.row_number().over(_by_start()) - 1
    return spoken.withColumn("turn_idx", order.cast("int"))


def _by_start():
    from pyspark.sql.window import Window

    return Window.partitionBy("recording_id").orderBy("start", "end", "speaker")


def pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked means of (n, tokens, d) states as unit rows, with floors of 1e-8."""
    m = mask[..., None].astype(np.float32)
    mean = (hidden * m).sum(1) / np.maximum(m.sum(1), 1e-8)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-8)


def embed(texts: DataFrame, factory: Callable, batch: int = 256) -> DataFrame:
    """texts (text) -> (text, embedding) of distinct texts; forward passes of bounded size."""

    model_of = kept(factory)

    def run(frames):
        model = model_of()
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                yield pd.DataFrame({"text": part["text"].to_numpy(), "embedding": list(np.asarray(model(part["text"].tolist()), np.float32))})

    return texts.select("text").distinct().mapInPandas(run, "text string, embedding array<float>")


def extract(transcripts: DataFrame, factory: Callable, attempts: int = 2) -> DataFrame:
    """transcripts (note_id, transcript) -> ROUND: only a reply that is no JSON is tried again; an error ends at once."""

    def is_json(raw: str) -> bool:
        s = raw.strip()
        if s.startswith("```"):
            s = "\n".join(line for line in s.split("\n")[1:] if not line.strip().startswith("```"))
        try:
            json.loads(s)
        except ValueError:
            return False
        return True

    model_of = kept(factory)

    def run(frames):
        model = model_of()
        for f in frames:
            rows = []
            for note, text in zip(f["note_id"], f["transcript"], strict=True):
                raw, error, k = None, None, 0
                for k in range(1, attempts + 1):
                    try:
                        raw = model(PROMPT + text)
                    except Exception as e:  # any backend failure gives the empty note
                        raw, error = None, f"{type(e).__name__}: {e}"
                        break
                    if is_json(raw):
                        break
                rows.append((note, text, raw, k, error))
            yield pd.DataFrame(rows, columns=["note_id", "transcript", "raw", "attempt", "error"])

    return transcripts.select("note_id", "transcript").mapInPandas(run, ROUND)


def replay(replies: dict[str, str]) -> Callable:
    """An extractor factory that answers from a table: the reply whose key the transcript holds."""
    return lambda: lambda prompt: next((v for k, v in replies.items() if k in prompt), "{}")
