"""Rubric criteria: parsed, matched against note fields, rolled up by category."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinispark.functions import scores
from clinispark.functions import text as T
from clinispark.sources import lexicon
from clinispark.sources.tables import parts, small

#: The labels of a rubric record.
LABELS = ("Rubric ID:", "Category ID:", "Criterion:")

FIELDS = {"medications": ("drug", "dose", "frequency", "timing"), "symptoms": ("name", "severity"), "vitals": ("name", "value"), "diagnosis": ("term", "status")}


def parse(notes: DataFrame) -> DataFrame:
    """notes (note_id, rubrics) -> note_id, rubric_id, category, criterion.

    A record runs from one "Rubric ID:" to the next that begins a line; what follows each of its labels is that field, the
    number and the category to the end of their line, the criterion to the end of the record. Others are no records.
    """
    start, category, criterion = LABELS
    after = lambda x, label: F.when(F.instr(x, label) > 0, F.substr(x, F.instr(x, label) + F.lit(len(label))))
    line = lambda x: T.strip(F.substring_index(x, "\n", 1))
    each = notes.select("note_id", F.posexplode(F.split("rubrics", rf"(?:^|\n)[^\n]*?{start}")).alias("nth", "record")).where("nth > 0")
    rest = after(F.col("record"), category)
    found = each.select("note_id", line(F.col("record")).alias("number"), line(rest).alias("category"), T.strip(after(rest, criterion)).alias("criterion"))
    found = found.where(F.col("number").rlike(r"^\d+$") & (F.col("category") != "") & (F.col("criterion") != ""))
    return found.select("note_id", F.col("number").cast("long").alias("rubric_id"), F.lower("category").alias("category"), "criterion")


def without_endings(value: Column, endings: list[tuple] = lexicon.ENDINGS) -> Column:
    """value as words between single blanks, less every ending of the lexicon that stands in it.

    An ending is a lead word, whether a number follows, and a word; where the lexicon says so, longer forms of that word too.
    """
    words = T.words(value)
    low = F.transform(words, F.lower)

    def at(x: Column, i: Column) -> Column:
        """How many words an ending takes that begins at place i, else 0."""
        word = lambda k: F.coalesce(F.get(x, i + k), F.lit(""))
        out = F.lit(0)
        for lead, number, last, longer in endings:
            k = 2 if number else 1
            fits = word(k).startswith(last) if longer else word(k) == last
            out = F.when((word(0) == lead) & fits & (word(1).rlike("^[0-9]+$") if number else F.lit(True)), k + 1).otherwise(out)
        return F.when(i > 0, out).otherwise(0)

    def cut(x: Column) -> Column:
        marks = F.transform(x["low"], lambda _, i: at(x["low"], i))
        inside = lambda i: F.exists(F.sequence(F.lit(0), F.lit(2)), lambda k: (i >= k) & (F.coalesce(F.get(marks, i - k), F.lit(0)) > k))
        return F.array_join(F.filter(x["words"], lambda _, i: ~inside(i)), " ")

    return T.let(F.struct(words.alias("words"), low.alias("low")), cut)


def frequency_group(values: DataFrame, frequencies: DataFrame, endings: list[tuple] = lexicon.ENDINGS) -> DataFrame:
    """values (value, normalised) -> value, grp: its frequency group by whole text, a slash part, or the longest key within."""
    each = values.select("value").distinct().withColumn("bare", without_endings(F.col("value"), endings))
    inside = functools.reduce(DataFrame.unionByName, [each.join(p, F.col("bare").contains(F.col("key"))) for p in parts(frequencies)])
    place = F.array_position(F.transform(F.split("bare", "/"), lambda p: F.trim(p)), F.col("key"))
    rank = F.when(F.col("bare") == F.col("key"), F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")))
    rank = rank.when(place > 0, F.struct(F.lit(1).alias("a"), place.cast("int").alias("b"), F.lit(0).alias("c")))
    rank = rank.otherwise(F.struct(F.lit(2).alias("a"), (-F.length("key")).alias("b"), F.col("ordinal").alias("c")))
    best = inside.groupBy("value").agg(F.min_by("grp", rank).alias("grp"))
    return each.select("value").join(best, "value", "left")


def close(gold: Column, candidate: Column, least: float = 0.5) -> Column:
    """Either holds the other, or half of their tokens are shared, or every gold token is covered."""
    g, c = T.words(gold), T.words(candidate)
    return (gold != "") & (candidate != "") & (candidate.contains(gold) | gold.contains(candidate) | (scores.jaccard(F.array_distinct(g), F.array_distinct(c)) >= least) | scores.covered(g, c))


def note_values(notes: DataFrame) -> DataFrame:
    """notes -> (note_id, field, value), one row a value."""
    entry = lambda field: lambda v: F.struct(F.lit(field).alias("field"), v.cast("string").alias("value"))
    parts = [F.transform(F.col(f"{a}.{n}"), entry(f"{a}.{n}")) for a, names in FIELDS.items() for n in names]
    parts += [F.transform(F.col(a), entry(a)) for a in ("investigations", "diagnostic_results")]
    parts.append(F.array(entry("examination")(F.col("examination"))))
    return notes.select("note_id", F.inline(F.concat(*parts))).where("value <> ''")


def match(criteria: DataFrame, values: DataFrame, categories: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Each criterion with representable and matched. An unknown category is representable and matches nothing."""
    known = criteria.join(small(categories), "category", "left").withColumn("representable", F.coalesce("representable", F.lit(True)))
    known = known.withColumn("gold", T.plain(T.first_quoted(F.col("criterion"))))
    pairs = known.where("field IS NOT NULL").join(values.withColumn("candidate", T.plain(F.col("value"))), ["note_id", "field"])
    is_freq = F.col("category") == "medication_frequency"
    both = pairs.where(is_freq).select(F.col("gold").alias("value")).unionByName(pairs.where(is_freq).select(F.col("candidate").alias("value")))
    groups = frequency_group(both, frequencies)
    pairs = pairs.join(groups.selectExpr("value AS gold", "grp AS g1"), "gold", "left").join(groups.selectExpr("value AS candidate", "grp AS g2"), "candidate", "left")
    same = is_freq & F.coalesce(F.col("g1") == F.col("g2"), F.lit(False)) & (F.col("gold") != "") & (F.col("candidate") != "")
    hits = pairs.groupBy("note_id", "rubric_id", "category", "criterion").agg(F.max(close(F.col("gold"), F.col("candidate")) | same).alias("matched"))
    keys = ["note_id", "rubric_id", "category", "criterion"]
    return known.join(hits, keys, "left").select(*keys, "representable", F.coalesce("matched", F.lit(False)).alias("matched"))


def rollup(matched: DataFrame) -> DataFrame:
    """Counts and recall by category, in order of name, and in all; without representable criteria a category has no recall, the whole 0."""
    rep = F.col("representable")
    out = matched.rollup("category").agg(F.count("*").alias("total"), F.count_if(rep).alias("representable"), F.count_if(rep & F.col("matched")).alias("matched"), F.grouping("category").alias("_all"))
    recall = F.when(F.col("representable") > 0, F.round(F.col("matched") / F.col("representable"), 3)).when(F.col("_all") == 1, 0.0)
    return out.withColumn("recall", recall).withColumn("category", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("category"))).orderBy("_all", "category").drop("_all")
