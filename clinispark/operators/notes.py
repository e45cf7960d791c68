"""Structured notes from a model's JSON reply: parsed, cleaned, flagged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinispark.functions import text as T
from clinispark.operators import drugs as D
from clinispark.sources import lexicon

SCHEMA = (
    "chief_complaint string, history string, symptoms array<struct<name:string,finding_status:string,severity:string,since:string>>, "
    "vitals array<struct<name:string,value:string>>, examination string, diagnosis array<struct<term:string,snomed_id:string,status:string>>, "
    "medications array<struct<drug:string,dose:string,frequency:string,timing:string,duration:string>>, investigations array<string>, "
    "diagnostic_results array<string>, advice string, follow_up string, low_confidence_fields array<string>, _corrupt_record string"
)
EMPTY_FLAGS = ("chief_complaint", "history", "diagnosis", "medications")
SCALARS = ("chief_complaint", "history", "examination", "advice", "follow_up")
LISTS = ("symptoms", "vitals", "diagnosis", "medications", "investigations", "diagnostic_results", "low_confidence_fields")


def parse(replies: DataFrame) -> DataFrame:
    """replies (note_id, raw, transcript) -> parsed fields and outcome: ok, malformed (worth a retry) or mistyped."""
    bare = T.strip_fences(F.col("raw"))
    parsed = replies.withColumn("_bare", bare).withColumn("_n", F.from_json("_bare", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("_n").isNull() | F.col("_n._corrupt_record").isNotNull()
    valid = F.try_parse_json("_bare").isNotNull()
    outcome = F.when(~F.coalesce(valid, F.lit(False)), "malformed").when(bad, "mistyped").otherwise("ok")
    return parsed.withColumn("outcome", outcome)


def _some(x: Column, kind: str) -> Column:
    return F.coalesce(x, F.array().cast(kind))


def _trimmed(x: Column) -> Column:
    return T.strip(F.coalesce(x, F.lit("")))


def unwrap(item: Column) -> Column:
    """A list entry as text; of an object its first of term, name, value that holds something, else all of it."""
    parts = [T.falsy_to_null(F.get_json_object(item, f"$.{k}")) for k in ("term", "name", "value")]
    return F.coalesce(F.when(item.startswith("{"), F.coalesce(*parts)), item)


def cleaned(parsed: DataFrame) -> DataFrame:
    """Parsed replies as notes: blank entries dropped, defaults put, null lists empty; not-ok replies are empty notes."""
    n, ok = F.col("_n"), F.col("outcome") == "ok"
    symptoms = F.transform(
        F.filter(_some(n["symptoms"], "array<struct<name:string,finding_status:string,severity:string,since:string>>"), lambda s: _trimmed(s["name"]) != ""),
        lambda s: F.struct(T.strip(s["name"]).alias("name"), F.coalesce(T.falsy_to_null(_trimmed(s["finding_status"])), F.lit("Present")).alias("finding_status"), T.falsy_to_null(s["severity"]).alias("severity"), T.falsy_to_null(s["since"]).alias("since")),
    )
    vitals = F.transform(
        F.filter(_some(n["vitals"], "array<struct<name:string,value:string>>"), lambda v: (_trimmed(v["name"]) != "") & ~_trimmed(v["value"]).isin("", "0")),
        lambda v: F.struct(T.strip(v["name"]).alias("name"), T.strip(v["value"]).alias("value")),
    )
    diagnosis = F.transform(
        F.filter(_some(n["diagnosis"], "array<struct<term:string,snomed_id:string,status:string>>"), lambda d: _trimmed(d["term"]) != ""),
        lambda d: F.struct(T.strip(d["term"]).alias("term"), d["snomed_id"].alias("snomed_id"), T.falsy_to_null(d["status"]).alias("status")),
    )
    medications = F.transform(
        F.filter(_some(n["medications"], "array<struct<drug:string,dose:string,frequency:string,timing:string,duration:string>>"), lambda m: _trimmed(m["drug"]) != ""),
        lambda m: F.struct(T.strip(m["drug"]).alias("drug"), *[T.falsy_to_null(m[k]).alias(k) for k in ("dose", "frequency", "timing", "duration")]),
    )
    lists = {k: F.transform(_some(n[k], "array<string>"), unwrap) for k in ("investigations", "diagnostic_results")}
    flags = F.when(ok, _some(n["low_confidence_fields"], "array<string>")).otherwise(F.array(*map(F.lit, EMPTY_FLAGS)))
    out = {k: F.when(ok, T.falsy_to_null(n[k])) for k in SCALARS}
    out |= {"symptoms": symptoms, "vitals": vitals, "diagnosis": diagnosis, "medications": medications} | lists | {"low_confidence_fields": flags}
    return parsed.withColumns(out).drop("_n", "_bare")


def flagged(notes: DataFrame, drugs: DataFrame, forms=lexicon.FORMS) -> DataFrame:
    """notes with validated medications and flags: the model's own, diagnoses foreign to the transcript, then doubtful drugs."""
    each = notes.select("note_id", F.posexplode("medications").alias("pos", "m"))
    names = D.validate(each.select(F.col("m.drug").alias("name")).distinct(), drugs, forms).select(F.col("name").alias("_name"), "validated")
    checked = each.join(names, F.col("m.drug") == F.col("_name"), "left").select("note_id", "pos", F.struct("m.*", F.coalesce("validated", F.lit(False)).alias("validated")).alias("m"))
    meds = checked.groupBy("note_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("_meds"))
    out = notes.join(meds, "note_id", "left").withColumn("medications", F.coalesce("_meds", F.array().cast(meds.schema["_meds"].dataType))).drop("_meds")
    said = T.long_latin_tokens(F.col("transcript"))
    letters = lambda t: F.filter(F.transform(F.regexp_extract_all(t, F.lit("[A-Za-z]+"), F.lit(0)), F.lower), lambda w: F.length(w) >= 4)
    foreign = F.filter("diagnosis", lambda d: (F.size("_said") > 0) & (F.size(letters(d["term"])) > 0) & ~F.arrays_overlap(letters(d["term"]), F.col("_said")))
    of_diagnosis = F.transform(foreign, lambda d: F.concat(F.lit("diagnosis."), d["term"], F.lit(".no_transcript_overlap")))
    of_drugs = F.flatten(F.transform("medications", lambda m: F.filter(F.array(F.when(~m["validated"], F.concat(F.lit("medications."), m["drug"], F.lit(".unvalidated"))), F.when(m["dose"].isNull(), F.concat(F.lit("medications."), m["drug"], F.lit(".dose_unknown")))), lambda f: f.isNotNull())))
    own, new = F.col("low_confidence_fields"), F.array_distinct(F.concat(of_diagnosis, of_drugs))
    return out.withColumn("_said", said).withColumn("low_confidence_fields", F.concat(own, F.array_except(new, own))).drop("_said")


def build(replies: DataFrame, drugs: DataFrame) -> DataFrame:
    """replies (note_id, raw, transcript) -> notes."""
    return flagged(cleaned(parse(replies)), drugs)


def as_json(notes: DataFrame) -> DataFrame:
    names = [*SCALARS, *LISTS]
    return notes.select("note_id", F.to_json(F.struct(*names)).alias("json"))
