"""Lexicons. Every operator takes them as DataFrames; here are the defaults, and a reader for curated ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that mark a clinician's turn.
INDICATORS = (
    "kya kyun kab kahan kaun kaise kitna kitne kitni what why when where who how which do does did is are was were have has "
    "prescription medicine medicines tablet tablets capsule dosage dose diagnosis symptoms symptom antibiotic antibiotics mg ml "
    "morning evening night days weeks blood test report lab bp pressure sugar diabetes infection pain chest breathing fever cough "
    "dawai dawa bukhar dard"
).split()
#: Frequency wordings by group; earlier wins among keys of one length.
FREQUENCIES = [
    *[(k, "once_daily") for k in ("1-0-0", "100", "0-0-1", "001", "0-1-0", "010")],
    *[(k, "twice_daily") for k in ("1-0-1", "101")],
    *[(k, "three_daily") for k in ("1-1-1", "111")],
    *[(k, "twice_daily") for k in ("1-1-0", "110", "0-1-1", "011", "bd/sos", "bdsos")],
    ("od", "once_daily"), ("bd", "twice_daily"), ("bid", "twice_daily"), ("tds", "three_daily"), ("tid", "three_daily"),
    ("hs", "once_daily"), ("sos", "prn"), ("prn", "prn"),
    *[(k, "once_daily") for k in (
        "once daily", "once a day", "one daily", "1 daily", "once in the morning", "one in the morning", "once daily morning",
        "in the morning", "once at night", "once nightly", "once daily at night", "at night", "at bedtime", "in the night",
        "in the afternoon", "at noon", "once at noon")],
    *[(k, "twice_daily") for k in ("twice daily", "twice a day", "two times a day", "2 times a day", "morning and night", "morning and evening")],
    *[(k, "three_daily") for k in ("three times a day", "three times daily", "thrice a day", "thrice daily", "3 times a day")],
    *[(k, "prn") for k in ("as needed", "when needed", "if needed")],
]
#: What may follow a frequency and says nothing of it: a lead word, whether a number follows, the word, and whether its
#: longer forms count.
ENDINGS = [
    *[(lead, False, meal, longer) for lead in ("before", "after", "with") for meal, longer in (("food", False), ("meal", False), ("meals", False), ("eat", True))],
    *[("for", True, span, True) for span in ("day", "week", "month")],
]
#: Rubric categories and the note field that answers them.
CATEGORIES = {
    "medication_name": "medications.drug", "medication_dose": "medications.dose", "medication_frequency": "medications.frequency",
    "medication_timing": "medications.timing", "symptom_name": "symptoms.name", "symptom_severity": "symptoms.severity",
    "body_vital_sign_name": "vitals.name", "body_vital_sign_value": "vitals.value", "diagnosis_name": "diagnosis.term",
    "diagnosis_status": "diagnosis.status", "prescribed_test_name": "investigations", "diagnostic_result_name": "diagnostic_results",
    "examination_name": "examination", "examination_notes": "examination",
}
NO_FIELD = (
    "medical_condition_name medical_condition_status current_medication_name lifestyle_habit_name family_history_name "
    "family_history_who foodotherallergy_name pastprocedures_name recenttravelhistory_name symptom_laterality "
    "diagnosis_laterality drugallergy_name diagnostic_result_value diagnostic_result_interpretation"
).split()
#: Dosage forms that stand before or after a drug name, and vitals that a note always shows.
FORMS = (
    "tablet tab tablets capsule cap capsules syrup syp injection inj cream ointment drops drop solution susp suspension "
    "inhaler inhale gel lotion spray patch sachet powder forte"
).split()
VITALS = ("Height", "Weight", "BP", "Temperature", "SpO2", "Pulse")
#: Common generic names, from public lists of essential medicines; a curated list is loaded with `load`.
DRUGS = sorted(
    """
    abacavir acyclovir albendazole allopurinol amikacin amiodarone amitriptyline amlodipine amoxicillin ampicillin aspirin atenolol
    atorvastatin azithromycin baclofen bisoprolol budesonide carbamazepine carvedilol cefalexin cefixime ceftriaxone cetirizine
    ciprofloxacin clindamycin clonazepam clopidogrel codeine colchicine dapagliflozin dexamethasone diazepam diclofenac digoxin
    diltiazem domperidone donepezil doxycycline enalapril escitalopram ethambutol famotidine ferrous fluconazole fluoxetine
    furosemide gabapentin gliclazide glipizide haloperidol heparin hydroxyzine ibuprofen insulin isoniazid ivermectin ketoconazole
    labetalol lactulose lamotrigine levodopa levothyroxine lisinopril lithium loperamide loratadine losartan mebendazole medrol
    metformin methotrexate metoprolol metronidazole mirtazapine montelukast morphine naproxen nifedipine nitrofurantoin olanzapine
    omeprazole ondansetron oxytocin pantoprazole paracetamol permethrin phenytoin prednisolone pregabalin propranolol pyrazinamide
    quetiapine ramipril rifampicin risperidone rivaroxaban salbutamol sertraline sildenafil simvastatin spironolactone tamsulosin
    telma telmisartan terbinafine tramadol valproate vancomycin verapamil warfarin zinc
    """.split()
) + ["amoxicillin clavulanate", "folic acid", "vitamin b12", "vitamin c"]
#: Some drug words in Devanagari; a curated list is loaded with `load`.
SCRIPTS = {
    "गोली": "tablet", "टैबलेट": "tablet", "दवाई": "medicine", "सिरप": "syrup", "कफ सिरप": "cough syrup", "सुई": "injection",
    "मरहम": "ointment", "पैरासिटामोल": "paracetamol", "एजिथ्रोमाइसिन": "azithromycin", "मेटफॉर्मिन": "metformin",
    "आइबूप्रोफ़ेन": "ibuprofen", "फोलिक एसिड": "folic acid", "विटामिन सी": "vitamin c", "आयरन": "iron", "इंसुलिन": "insulin", "जिंक": "zinc", "ज़ीफी": "zifi",
}
#: Lay terms of common conditions with their SNOMED CT codes, and wordings that only look alike.
CONCEPTS = [
    ("Migraine", "37796009", ["one-sided headache", "adhkapari"], ["head office"]),
    ("Asthma", "195967001", ["dama", "saans ki bimari", "wheezing"], ["breathing exercise"]),
    ("Hypothyroidism", "40930008", ["thyroid kam", "underactive thyroid"], ["thyroid test"]),
    ("Anaemia", "271737000", ["khoon ki kami", "low haemoglobin"], ["blood donation"]),
    ("Gastritis", "4556007", ["pet mein jalan", "stomach burning"], ["burning smell"]),
    ("Constipation", "14760008", ["kabz", "hard stool"], ["wooden stool"]),
    ("Diarrhoea", "62315008", ["dast", "loose motion"], ["slow motion"]),
    ("Urinary tract infection", "68566005", ["peshab mein jalan", "burning urine"], ["urine sample"]),
    ("Osteoarthritis", "396275006", ["ghutne ka dard", "joint wear"], ["joint account"]),
    ("Low back pain", "279039007", ["kamar dard", "backache"], ["back home"]),
    ("Insomnia", "193462001", ["neend nahi aati", "sleepless"], ["sleeping tablet"]),
    ("Vertigo", "399153001", ["chakkar", "spinning head"], ["spinning wheel"]),
    ("Common cold", "82272006", ["zukaam", "runny nose"], ["cold outside"]),
    ("Allergic rhinitis", "61582004", ["dust allergy", "chheenk"], ["dust cloth"]),
    ("Pneumonia", "233604007", ["lung infection", "nimoniya"], ["medicine chest"]),
    ("Tuberculosis", "56717001", ["tb", "kshay rog"], ["tuberculin test"]),
    ("Dengue", "38362002", ["haddi tod bukhar", "dengue fever"], ["dengue vaccine"]),
    ("Obesity", "414916001", ["motapa", "overweight"], ["overweight bag"]),
]


def one_column(spark: SparkSession, name: str, values) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


#: What a lexicon file must hold; further columns are ignored.
SHAPES = {
    "drugs": "drug string",
    "scripts": "span string, latin string",
    "concepts": "concept_idx int, term string, snomed_id string, variants array<string>, hard_negatives array<string>",
    "frequencies": "ordinal int, key string, grp string",
    "categories": "category string, field string, representable boolean",
}
KEYS = {"drugs": "drug", "scripts": "span", "concepts": "concept_idx", "frequencies": "key", "categories": "category"}


def load(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """A lexicon from a Parquet or CSV file with the columns of SHAPES; lists in CSV are separated by |.

    A missing column, or a null or repeated key, ends the load with an error before anything uses the lexicon.
    """
    fields = [f.rsplit(" ", 1) for f in SHAPES[kind].split(", ")]
    found = spark.read.option("header", True).csv(path) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    lacking = [n for n, _ in fields if n not in found.columns]
    if lacking:
        raise ValueError(f"{kind} lexicon {path} lacks {', '.join(lacking)}")
    flat = lambda n, t: t.startswith("array") and found.schema[n].dataType.simpleString() == "string"
    out = found.select(*[(F.split(n, r"\|") if flat(n, t) else F.col(n)).cast(t).alias(n) for n, t in fields])
    key = KEYS[kind]
    bad = out.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).limit(1).collect()
    if bad:
        raise ValueError(f"{kind} lexicon {path}: {key} {bad[0][0]!r} is null or repeats")
    return out


def indicators(spark: SparkSession) -> DataFrame:
    return one_column(spark, "token", INDICATORS)


def drugs(spark: SparkSession) -> DataFrame:
    return one_column(spark, "drug", DRUGS)


def scripts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SCRIPTS.items()), "span string, latin string")


def concepts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CONCEPTS)], "concept_idx int, term string, snomed_id string, variants array<string>, hard_negatives array<string>")


def frequencies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, k, g) for i, (k, g) in enumerate(FREQUENCIES)], "ordinal int, key string, grp string")


def categories(spark: SparkSession) -> DataFrame:
    rows = [(c, f, True) for c, f in CATEGORIES.items()] + [(c, None, False) for c in NO_FIELD]
    return spark.createDataFrame(rows, "category string, field string, representable boolean")
