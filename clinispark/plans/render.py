"""A note as an ordered document: rows of (note_id, section_no, section, row_no, cells, flagged)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinispark.sources import lexicon

BANNER = "DRAFT — NOT FOR CLINICAL USE — PHYSICIAN REVIEW REQUIRED"
MARK, NONE = " ⚑", "—"


def vitals_table(notes: DataFrame, standard=lexicon.VITALS) -> DataFrame:
    """(note_id, row_no, name, value): the standard vitals, then others in order of first mention; the last value wins."""
    found = notes.select("note_id", F.posexplode("vitals").alias("pos", "v"))
    found = found.groupBy("note_id", F.col("v.name").alias("name")).agg(F.max_by("v.value", "pos").alias("value"), F.min("pos").alias("pos"))
    fixed = notes.select("note_id", F.posexplode(F.array(*map(F.lit, standard))).alias("row_no", "name"))
    first = fixed.join(found.drop("pos"), ["note_id", "name"], "left")
    rest = found.where(~F.col("name").isin(*standard)).withColumn("row_no", F.col("pos") + len(standard)).drop("pos")
    return first.unionByName(rest).select("note_id", "row_no", "name", F.coalesce("value", F.lit(NONE)).alias("value"))


def _row(no: int, name: str, row_no, cells, flagged):
    return F.struct(F.lit(no).alias("section_no"), F.lit(name).alias("section"), row_no.cast("int").alias("row_no"), F.array(*cells).alias("cells"), flagged.alias("flagged"))


def _each(no: int, name: str, items, cells, flagged):
    return F.transform(items, lambda x, i: _row(no, name, i, cells(x), flagged(x)))


def rows(notes: DataFrame) -> DataFrame:
    """All rows of each note from one pass: sections are arrays within the note's row."""
    low, no = F.col("low_confidence_fields"), F.lit(False)
    is_low = lambda prefix, key: F.array_contains(low, F.concat(F.lit(prefix), key))
    mark = lambda on: F.when(on, F.lit(MARK)).otherwise(F.lit(""))
    dash = lambda c: F.coalesce(c, F.lit(NONE))
    wrapped = lambda a, c, b: F.when(c != "", F.concat(F.lit(a), c, F.lit(b))).otherwise(F.lit(""))

    def field(section_no, label, name):
        on = is_low("", F.lit(name))
        return F.when(F.col(name).isNotNull(), F.array(_row(section_no, label, F.lit(0), [F.concat(F.col(name), mark(on))], on)))

    def symptom(x):
        status = F.when(x["finding_status"] != "Present", F.concat(F.lit("["), x["finding_status"], F.lit("]")))
        return [F.concat(F.concat_ws(", ", x["name"], status, x["severity"], F.concat(F.lit("since "), x["since"])), mark(is_low("symptoms.", x["name"])))]

    standard = F.array(*map(F.lit, lexicon.VITALS))
    value = lambda name: F.try_element_at(F.filter("vitals", lambda v: v["name"] == name), F.lit(-1))["value"]
    names = F.concat(standard, F.array_except(F.col("vitals.name"), standard))
    sections = [
        F.array(_row(0, "Banner", F.lit(0), [F.lit(BANNER)], no)),
        field(1, "Chief Complaint", "chief_complaint"),
        field(2, "History", "history"),
        _each(3, "Symptoms", F.col("symptoms"), symptom, lambda x: is_low("symptoms.", x["name"])),
        _each(4, "Vitals", names, lambda n: [F.concat(n, mark(is_low("vitals.", n))), dash(value(n))], lambda n: is_low("vitals.", n)),
        field(5, "Examination", "examination"),
        _each(6, "Diagnosis", F.col("diagnosis"), lambda x: [F.concat(x["term"], wrapped(" [", x["status"], "]"), wrapped(" (SNOMED: ", x["snomed_id"], ")"), mark(is_low("diagnosis.", x["term"])))], lambda x: is_low("diagnosis.", x["term"])),
        _each(7, "Medications", F.col("medications"), lambda x: [x["drug"], *[dash(x[k]) for k in ("dose", "frequency", "timing", "duration")], F.when(x["validated"], F.lit("✓")).otherwise(F.lit("⚑ No"))], lambda x: ~x["validated"]),
        _each(8, "Investigations (Ordered)", F.col("investigations"), lambda x: [x], lambda x: no),
        _each(9, "Diagnostic Results (Available)", F.col("diagnostic_results"), lambda x: [x], lambda x: no),
        field(10, "Advice", "advice"),
        field(11, "Follow-up", "follow_up"),
        F.when(F.size(low) > 0, F.array(_row(12, "Low-confidence fields", F.lit(0), [F.array_join(F.array_sort(F.array_distinct(low)), ", ")], F.lit(True)))),
    ]
    return notes.select("note_id", F.explode(F.flatten(F.array_compact(F.array(*sections)))).alias("r")).select("note_id", "r.*")


def documents(rendered: DataFrame) -> DataFrame:
    """Rendered rows as one text a note."""
    line = F.struct("section_no", "row_no", F.concat(F.col("section"), F.lit(": "), F.array_join("cells", " | ")).alias("line"))
    return rendered.groupBy("note_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("document"))
