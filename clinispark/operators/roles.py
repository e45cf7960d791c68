"""Who speaks: indicator scores and the roles that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clinispark.functions import text as T
from clinispark.sources import lexicon


def indicator_count(text: Column, tokens=lexicon.INDICATORS) -> Column:
    """How many words, without marks at their ends, are indicator tokens."""
    return F.size(F.filter(T.words(F.lower(text)), lambda w: F.btrim(w, F.lit(T.EDGE)).isin(list(tokens)))).cast("long")


def scores(turns: DataFrame, tokens=lexicon.INDICATORS) -> DataFrame:
    """turns (recording_id, speaker, text) -> summed score of each speaker."""
    return turns.groupBy("recording_id", "speaker").agg(F.sum(indicator_count(F.col("text"), tokens)).alias("score"))


def assign(scored: DataFrame) -> DataFrame:
    """One speaker or a tie at the top: all UNKNOWN; else the top is DOCTOR and the others PATIENT."""
    w = Window.partitionBy("recording_id")
    top = F.max("score").over(w)
    ranked = scored.withColumns({"n": F.count("*").over(w), "top": top}).withColumn("ties", F.sum((F.col("score") == F.col("top")).cast("int")).over(w))
    role = F.when((F.col("n") < 2) | (F.col("ties") > 1), "UNKNOWN").when(F.col("score") == F.col("top"), "DOCTOR").otherwise("PATIENT")
    return ranked.withColumn("speaker_role", role).drop("n", "top", "ties")


def with_roles(turns: DataFrame, roles: DataFrame) -> DataFrame:
    """turns with speaker_role; a speaker without one is UNKNOWN."""
    found = roles.select("recording_id", "speaker", "speaker_role")
    return turns.join(found, ["recording_id", "speaker"], "left").withColumn("speaker_role", F.coalesce("speaker_role", F.lit("UNKNOWN")))


def spoken(turns: DataFrame) -> DataFrame:
    """Turns with a text."""
    return turns.where("text <> ''")


#: Turns that are put together at once; the pieces then are.
PIECE = 1024


def joined(turns: DataFrame, text: Column, between: str, name: str) -> DataFrame:
    """The texts of each recording in order of turn_idx, with `between` between them.

    Turns are joined in pieces of PIECE numbers, on every task that holds some of a recording, and pieces then in order, so
    a long recording is no single list of turns. Null texts count as not there.
    """
    order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["said"]), between)
    each = turns.select("recording_id", F.floor(F.col("turn_idx") / PIECE).alias("piece"), F.struct("turn_idx", text.alias("said")).alias("turn"))
    pieces = each.groupBy("recording_id", "piece").agg(order("turn").alias("said"), F.count("turn.said").alias("n"))
    kept = F.when(F.col("n") > 0, F.col("said"))  # a piece of null texts only adds nothing, not even what stands between
    return pieces.select("recording_id", F.struct("piece", kept.alias("said")).alias("turn")).groupBy("recording_id").agg(order("turn").alias(name))


def transcripts(turns: DataFrame) -> DataFrame:
    """turns (recording_id, turn_idx, speaker_role, text) -> one text a recording, a tagged line a turn."""
    return joined(turns, F.concat(F.lit("["), "speaker_role", F.lit("]: "), "text"), "\n", "transcript")


def hypotheses(turns: DataFrame) -> DataFrame:
    """turns (recording_id, turn_idx, text) -> the texts of a recording in order, joined by blanks."""
    return joined(turns, F.col("text"), " ", "hypothesis").withColumn("hypothesis", F.trim("hypothesis"))


def speaker_count(segments: DataFrame) -> DataFrame:
    return segments.groupBy("recording_id").agg(F.countDistinct("speaker").alias("speakers"))
