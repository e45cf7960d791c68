"""Operators on a few literal rows, against DuckDB or rows worked out by hand."""

import collections

import duckdb
import pytest
from pyspark.sql import functions as F

from clinispark.functions import fuzzy
from clinispark.functions import text as T
from clinispark.operators import drugs, metrics, notes, rubrics
from clinispark.plans import render
from clinispark.plans.queries import DRUGS, TIER, WORDS, Q, literal, strings, values
from clinispark.sources import lexicon

CASES: dict = {}


def query(name, sql):
    def put(f):
        CASES[name] = f, sql
        return f

    return put


NAMES = ["Paracetamol", "Tab Paracetamol", "tablet tab paracetamol syrup", "spiro", "Vit-Acid Plus", "unknownol", "", "  ", "amoxicillin clav", "Insulin/Glargine", "xy", "ASPIRIN  ", "Folic   Acid"]


@query("drug_validation_tier", "SELECT name, tier, tier IS NOT NULL AS validated FROM (" + TIER.replace("NAMES_", values("name", [(n,) for n in NAMES]) + " q") + ") t")
def _(spark, sf):
    return drugs.validate(lexicon.one_column(spark, "name", NAMES), lexicon.drugs(spark))


SCANS = [(1, 0, "मरीज को पैरासिटामोल दो"), (1, 1, "no script here"), (2, 0, "विटामिन सी  और कफ सिरप लेना"), (2, 1, "टैबलेट एजिथ्रोमाइसिन, रोज"), (3, 0, "फोलिक एसिड मेटफॉर्मिन")]


@query("drug_scan_curated", f"""WITH w AS (SELECT r, t, text, {WORDS.format('text')} AS w FROM {values('r, t, text', SCANS)} s), g AS (SELECT r, t, n, i, array_to_string(w[i + 1 : i + n], ' ') AS span FROM w, (SELECT unnest([1, 2, 3]) AS n) ns, LATERAL (SELECT unnest(range(0, greatest(0, len(w) - n + 1))) AS i) x),
 m AS (SELECT r, t, list({{'s': i, 'e': i + n, 'l': latin}} ORDER BY n DESC, i) AS ms FROM g JOIN {values('span, latin', list(lexicon.SCRIPTS.items()))} c USING (span) GROUP BY ALL),
 c AS (SELECT r, t, list_reduce(list_transform(ms, lambda m: [m]), lambda a, b: CASE WHEN len(list_filter(a, lambda o: o.s < b[1].e AND b[1].s < o.e)) > 0 THEN a ELSE list_concat(a, b) END) AS cs FROM m)
 SELECT CAST(w.r AS BIGINT) AS recording_id, CAST(w.t AS INT) AS turn_idx, CASE WHEN cs IS NULL THEN text ELSE array_to_string(list_filter(list_transform(range(0, len(w)), lambda i: CASE WHEN len(list_filter(cs, lambda m: m.s = i)) > 0 THEN list_filter(cs, lambda m: m.s = i)[1].l
   WHEN len(list_filter(cs, lambda m: m.s < i AND i < m.e)) > 0 THEN NULL ELSE w[i + 1] END), lambda p: p IS NOT NULL), ' ') END AS text FROM w LEFT JOIN c USING (r, t)""")
def _(spark, sf):
    turns = literal(spark, "recording_id, turn_idx, text", "long, int, string", SCANS)
    return drugs.rewrite(turns, spark.createDataFrame([], "drug string"), lexicon.scripts(spark), use_fuzzy=False)


# Romanised by hand; the fuzzy ones by twice the letters in matching blocks over all letters: rivaro + aban of rivaroksaban and
# rivaroxaban 20/23, glipiz + d of glipizad and glipizide 14/17, tenolol of etenolol and atenolol 14/16, dapagliflo + in of
# dapagliflojin and dapagliflozin 24/26; doksisaklin and doxycycline share too little.
EXACT_SCANS = [(1, 0, "सैल्बुटामोल और रामिप्रिल", "salbutamol और ramipril"), (1, 1, "रोज टाम्सुलोसिन", "रोज tamsulosin"), (2, 0, "डोक्सीसाइक्लिन", "डोक्सीसाइक्लिन"), (2, 1, "मेड्रोल, no", "मेड्रोल, no"), (2, 2, "टेल्मा  रात को", "telma रात को")]
# With the fuzzy tier a longer window that is close enough wins over the exact one in it: salbutamolaur and salbutamol 20/23,
# rojtamsulosin and tamsulosin 20/23.
WIDER = {(1, 0): "salbutamol ramipril", (1, 1): "tamsulosin"}
FUZZY_SCANS = [*[(r, t, x, WIDER.get((r, t), w)) for r, t, x, w in EXACT_SCANS], (3, 0, "रिवारोक्साबैन ग्लिपिज़ाइड", "rivaroxaban glipizide"), (3, 1, "सुबह एटेनोलोल दो", "सुबह atenolol दो"), (3, 2, "डैपाग्लिफ्लोजिन", "dapagliflozin"), (4, 0, "कफ सिरप नेक्सियम", "cough syrup नेक्सियम")]


def _scan_sql(rows: list[tuple]) -> str:
    return f"SELECT CAST(r AS BIGINT) AS recording_id, CAST(t AS INT) AS turn_idx, text FROM {values('r, t, text', [(r, t, w) for r, t, _, w in rows])} s"


def _scan(spark, rows: list[tuple], use_fuzzy: bool):
    turns = literal(spark, "recording_id, turn_idx, text", "long, int, string", [(r, t, x) for r, t, x, _ in rows])
    return drugs.rewrite(turns, lexicon.drugs(spark), lexicon.scripts(spark), use_fuzzy=use_fuzzy)


@query("drug_scan_exact", _scan_sql(EXACT_SCANS))
def _(spark, sf):
    return _scan(spark, EXACT_SCANS, False)


@query("drug_scan_fuzzy", _scan_sql(FUZZY_SCANS))
def _(spark, sf):
    return _scan(spark, FUZZY_SCANS, True)


ROMAN = ["paaraa", "shiinn", "amoxxicillin", "ranitidin", "buun an", "vitamiin cc"]
ROMAN_SQL = "replace(replace(replace(r, 'aa', 'a'), 'ii', 'i'), 'uu', 'u')"
for _c in "bcdfghjklmnpqrstvwxyz":
    ROMAN_SQL = f"replace({ROMAN_SQL}, '{_c}{_c}', '{_c}')"


@query("roman_key", f"SELECT r, trim(regexp_replace(replace({ROMAN_SQL}, 'sh', 's'), '([aeiou])n$', '\\1')) AS k FROM {values('r', [(r,) for r in ROMAN])} t")
def _(spark, sf):
    return lexicon.one_column(spark, "r", ROMAN).select("r", fuzzy.roman_key(F.col("r")).alias("k"))


ENTITIES = [(1, '[["Dolo","drugs",[1]],["fever","symptom",[2]],["Dolo","drugs",[3]]]'), (2, '[["iron","drugs",[]],[" ","drugs",[]],["zinc","drugs",[]]]'), (3, "[]")]


@query("entities_distinct", f"""SELECT CAST(id AS BIGINT) AS id, pos, e AS keyword FROM (SELECT id, unnest(es) AS e, generate_subscripts(es, 1) - 1 AS pos FROM (SELECT id, list_filter(list_transform(list_filter(list_transform(range(0, len(j)), lambda i: {{'s': trim(j[i + 1][1]), 'c': j[i + 1][2], 'i': i}}), lambda x: x.c = 'drugs' AND x.s <> '' AND NOT list_contains(list_transform(j[1 : x.i], lambda y: trim(y[1])), x.s)), lambda x: x.s), lambda s: true) AS es
 FROM (SELECT id, CAST(CAST(raw AS JSON) AS VARCHAR[][]) AS j FROM {values('id, raw', ENTITIES)} t) p) q) r""")
def _(spark, sf):
    return literal(spark, "id, raw", "long, string", ENTITIES).select("id", F.posexplode(metrics.entity_keywords(F.col("raw"), "drugs")).alias("pos", "keyword")).withColumn("pos", F.col("pos").cast("long"))


REPLIES = [
    ("a", '```json\n{"chief_complaint":"fever","history":"","symptoms":[{"name":"Fever","severity":"high"},{"name":" "},{"name":"Cough","finding_status":"Absent","since":"2 days"}],"vitals":[{"name":"BP","value":"120/80"},{"name":"Pulse","value":98},{"name":"BP","value":"130/90"},{"name":"Sugar","value":""},{"name":"Waist","value":"90 cm"}],"diagnosis":[{"term":"Viral Fever","status":"Confirmed"},{"term":"Pulmonary Embolism","snomed_id":"59282003"}],"medications":[{"drug":"Tab Paracetamol","dose":"650 mg","frequency":"1-0-1"},{"drug":"Mysterol","duration":"5 days"}],"investigations":["CBC",{"term":"ESR"}],"diagnostic_results":null,"advice":"rest","low_confidence_fields":["advice"]}\n```', "[DOCTOR]: you have viral fever"),
    ("b", "not json {", "x"),
    ("c", '{"symptoms":["fever"]}', "x"),
    ("d", '{"diagnosis":[{"term":"Dengue"}],"medications":null}', "रोगी"),
]
def _notes(spark):
    return notes.build(literal(spark, "note_id, raw, transcript", "string, string, string", REPLIES), lexicon.drugs(spark))


# The replies as DuckDB reads them: without their fence, and only if all entries of a list have its type.
OBJECTS = ("symptoms", "vitals", "diagnosis", "medications")
PARSED = f"""r AS (SELECT note_id, trim(regexp_replace(regexp_replace(raw, '^```[^\n]*\n', ''), '\n```\\s*$', '')) AS bare FROM {values('note_id, raw, transcript', REPLIES)} t),
 j AS (SELECT note_id, CASE WHEN json_valid(bare) THEN CAST(bare AS JSON) END AS j FROM r),
 o AS (SELECT note_id, j, CASE WHEN j IS NULL THEN 'malformed' WHEN len(list_filter([{', '.join(f"json_extract(j, '$.{k}[0]')" for k in OBJECTS)}], lambda e: e IS NOT NULL AND json_type(e) <> 'OBJECT')) > 0 THEN 'mistyped' ELSE 'ok' END AS outcome FROM j)"""
FIELDS = {"symptoms": ("name", "finding_status", "severity", "since"), "vitals": ("name", "value"), "diagnosis": ("term", "snomed_id", "status"), "medications": ("drug", "dose", "frequency", "timing", "duration")}


def _entries(kind: str) -> str:
    first, *rest = FIELDS[kind]
    part = lambda k: f"nullif(trim(json_extract_string(e, '$.{k}')), '')"
    part_or = lambda k: f"coalesce({part(k)}, 'Present')" if k == "finding_status" else part(k)
    keep = f"{part(first)} IS NOT NULL" + (f" AND coalesce({part('value')}, '0') <> '0'" if kind == "vitals" else "")
    cells = " || '|' || ".join(f"coalesce({part_or(k)}, '')" for k in FIELDS[kind])
    return f"SELECT note_id, '{kind}' AS field, CAST(row_number() OVER (PARTITION BY note_id ORDER BY i) - 1 AS INT) AS pos, {cells} AS entry FROM (SELECT note_id, i, json_extract(j, '$.{kind}[' || i || ']') AS e FROM o, range(0, 20) x(i) WHERE outcome = 'ok') y WHERE e IS NOT NULL AND {keep}"


LATIN = "list_filter(list_transform(regexp_extract_all({}, '[A-Za-z]+'), lambda t: lower(t)), lambda t: length(t) >= 4)"
FLAGS = f"""WITH {PARSED}, s AS (SELECT note_id, list_filter({LATIN.format('transcript')}, lambda t: t NOT IN {T.ROLE_WORDS}) AS said FROM {values('note_id, raw, transcript', REPLIES)} t),
 g AS (SELECT note_id, pos, string_split(entry, '|')[1] AS term FROM ({_entries('diagnosis')}) e),
 m AS (SELECT note_id, pos, string_split(entry, '|')[1] AS name, string_split(entry, '|')[2] AS dose FROM ({_entries('medications')}) e),
 v AS ({TIER.replace('NAMES_', '(SELECT DISTINCT name FROM m) q')}),
 f AS (SELECT note_id, 0 AS part, pos, 0 AS k, 'diagnosis.' || term || '.no_transcript_overlap' AS flag FROM g JOIN s USING (note_id) WHERE len(said) > 0 AND len({LATIN.format('term')}) > 0 AND len(list_intersect({LATIN.format('term')}, said)) = 0
   UNION ALL SELECT note_id, 1, pos, 0, 'medications.' || name || '.unvalidated' FROM m LEFT JOIN v USING (name) WHERE tier IS NULL UNION ALL SELECT note_id, 1, pos, 1, 'medications.' || name || '.dose_unknown' FROM m WHERE dose = ''),
 n AS (SELECT note_id, list(flag ORDER BY part, pos, k) AS new FROM f GROUP BY note_id),
 w AS (SELECT note_id, outcome, CASE WHEN outcome = 'ok' THEN coalesce(CAST(json_extract(j, '$.low_confidence_fields') AS VARCHAR[]), []) ELSE ['chief_complaint', 'history', 'diagnosis', 'medications'] END AS own FROM o)
 SELECT note_id, outcome, array_to_string(list_concat(own, list_filter(coalesce(new, []), lambda x: NOT list_contains(own, x))), ',') AS flags, (SELECT count(*) FROM m WHERE m.note_id = w.note_id) AS n_medications,
  (SELECT count(*) FROM g WHERE g.note_id = w.note_id) AS n_diagnoses, (SELECT count(*) FROM ({_entries('vitals')}) e WHERE e.note_id = w.note_id) AS n_vitals FROM w LEFT JOIN n USING (note_id)"""


@query("note_flags", FLAGS)
def _(spark, sf):
    size = lambda c: F.size(c).cast("long")
    return _notes(spark).select("note_id", "outcome", F.array_join("low_confidence_fields", ",").alias("flags"), size("medications").alias("n_medications"), size("diagnosis").alias("n_diagnoses"), size("vitals").alias("n_vitals"))


@query("note_shape", f"WITH {PARSED} " + " UNION ALL ".join(_entries(k) for k in OBJECTS))
def _(spark, sf):
    made = notes.cleaned(notes.parse(literal(spark, "note_id, raw, transcript", "string, string, string", REPLIES)))
    cells = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("field"), i.alias("pos"), F.concat_ws("|", *[F.coalesce(x[k], F.lit("")) for k in FIELDS[kind]]).alias("entry"))
    return made.select("note_id", F.inline(F.concat(*[F.transform(kind, cells(kind)) for kind in OBJECTS])))


@query("note_fallback", f"""WITH {PARSED} SELECT note_id, outcome, CASE WHEN outcome = 'ok' THEN coalesce(array_to_string(CAST(json_extract(j, '$.low_confidence_fields') AS VARCHAR[]), ','), '')
 ELSE 'chief_complaint,history,diagnosis,medications' END AS flags, CASE WHEN outcome = 'ok' THEN nullif(json_extract_string(j, '$.chief_complaint'), '') END AS chief_complaint FROM o""")
def _(spark, sf):
    made = notes.cleaned(notes.parse(literal(spark, "note_id, raw, transcript", "string, string, string", REPLIES)))
    return made.select("note_id", "outcome", F.array_join("low_confidence_fields", ",").alias("flags"), "chief_complaint")


@query("vitals_table", f"""WITH {PARSED}, v AS ({_entries('vitals')}), w AS (SELECT *, string_split(entry, '|')[1] AS name, string_split(entry, '|')[2] AS value FROM v WHERE note_id = 'a'),
 l AS (SELECT name, arg_max(value, pos) AS value, min(pos) AS pos FROM w GROUP BY name), s AS (SELECT unnest({strings(lexicon.VITALS)}) AS name, generate_subscripts({strings(lexicon.VITALS)}, 1) - 1 AS row_no)
 SELECT 'a' AS note_id, CAST(row_no AS INT) AS row_no, s.name, coalesce(value, '{render.NONE}') AS value FROM s LEFT JOIN l ON l.name = s.name
 UNION ALL SELECT 'a', CAST(pos + {len(lexicon.VITALS)} AS INT), name, value FROM l WHERE NOT list_contains({strings(lexicon.VITALS)}, name)""")
def _(spark, sf):
    return render.vitals_table(_notes(spark).where("note_id = 'a'"))


# What the notes come to on paper, worked out by hand: the banner and the standard vitals of every note, then what it holds.
EMPTY = "chief_complaint, diagnosis, history, medications"
PAPER = [
    ("a", 1, "Chief Complaint", 0, "fever", False), ("a", 3, "Symptoms", 0, "Fever, high", False), ("a", 3, "Symptoms", 1, "Cough, [Absent], since 2 days", False),
    ("a", 4, "Vitals", 6, "Waist | 90 cm", False), ("a", 6, "Diagnosis", 0, "Viral Fever [Confirmed]", False), ("a", 6, "Diagnosis", 1, "Pulmonary Embolism (SNOMED: 59282003)", False),
    ("a", 7, "Medications", 0, "Tab Paracetamol | 650 mg | 1-0-1 | — | — | ✓", False), ("a", 7, "Medications", 1, "Mysterol | — | — | — | 5 days | ⚑ No", True),
    ("a", 8, "Investigations (Ordered)", 0, "CBC", False), ("a", 8, "Investigations (Ordered)", 1, "ESR", False), ("a", 10, "Advice", 0, "rest ⚑", True),
    ("a", 12, "Low-confidence fields", 0, "advice, diagnosis.Pulmonary Embolism.no_transcript_overlap, medications.Mysterol.dose_unknown, medications.Mysterol.unvalidated", True),
    ("b", 12, "Low-confidence fields", 0, EMPTY, True), ("c", 12, "Low-confidence fields", 0, EMPTY, True), ("d", 6, "Diagnosis", 0, "Dengue", False),
]
TAKEN = [("a", "BP", "130/90"), ("a", "Pulse", "98")]


@query("render_rows", f"""SELECT note_id, CAST(section_no AS INT) AS section_no, section, CAST(row_no AS INT) AS row_no, cells, flagged FROM {values('note_id, section_no, section, row_no, cells, flagged', PAPER)} p
 UNION ALL SELECT n, 0, 'Banner', 0, '{render.BANNER}', false FROM (SELECT unnest(['a', 'b', 'c', 'd']) AS n) x
 UNION ALL SELECT n, 4, 'Vitals', CAST(i AS INT), v.name || ' | ' || coalesce(value, '{render.NONE}'), false FROM (SELECT unnest(['a', 'b', 'c', 'd']) AS n) x, (SELECT unnest({strings(lexicon.VITALS)}) AS name, generate_subscripts({strings(lexicon.VITALS)}, 1) - 1 AS i) v
 LEFT JOIN {values('note_id, name, value', TAKEN)} t ON t.note_id = n AND t.name = v.name""")
def _(spark, sf):
    return render.rows(_notes(spark)).withColumn("cells", F.array_join("cells", " | "))


NOTHING = '{"symptoms":[],"vitals":[],"diagnosis":[],"medications":[],"investigations":[],"diagnostic_results":[],"low_confidence_fields":["chief_complaint","history","diagnosis","medications"]}'
JSON_ROWS = [
    ("a", '{"chief_complaint":"fever","advice":"rest","symptoms":[{"name":"Fever","finding_status":"Present","severity":"high"},{"name":"Cough","finding_status":"Absent","since":"2 days"}],"vitals":[{"name":"BP","value":"120/80"},{"name":"Pulse","value":"98"},{"name":"BP","value":"130/90"},{"name":"Waist","value":"90 cm"}],"diagnosis":[{"term":"Viral Fever","status":"Confirmed"},{"term":"Pulmonary Embolism","snomed_id":"59282003"}],"medications":[{"drug":"Tab Paracetamol","dose":"650 mg","frequency":"1-0-1","validated":true},{"drug":"Mysterol","duration":"5 days","validated":false}],"investigations":["CBC","ESR"],"diagnostic_results":[],"low_confidence_fields":["advice","diagnosis.Pulmonary Embolism.no_transcript_overlap","medications.Mysterol.unvalidated","medications.Mysterol.dose_unknown"]}'),
    ("b", NOTHING), ("c", NOTHING),
    ("d", '{"symptoms":[],"vitals":[],"diagnosis":[{"term":"Dengue"}],"medications":[],"investigations":[],"diagnostic_results":[],"low_confidence_fields":[]}'),
]


@query("note_json", f"SELECT note_id, json FROM {values('note_id, json', JSON_ROWS)} t")
def _(spark, sf):
    return notes.as_json(_notes(spark))


RUBRIC = "Rubric ID: 1\nCategory ID: medication_frequency\nCriterion: says 'twice a day'\nRubric ID: 2\nCategory ID: Symptom_Name\nCriterion: has 'fever'\nand more\nRubric ID: 3\nCategory ID: lifestyle_habit_name\nCriterion: 'smoker'\nRubric ID: 4\nCategory ID: odd_thing\nCriterion: 'x'\nRubric ID: 5\nCategory ID: diagnosis_name\nCriterion: 'Malaria'"


def _criteria(spark):
    return rubrics.parse(literal(spark, "note_id, rubrics", "string, string", [("a", RUBRIC)]))


@query("rubric_parse", f"""SELECT 'a' AS note_id, CAST(trim(string_split(x, chr(10))[1]) AS BIGINT) AS rubric_id, lower(trim(regexp_extract(x, 'Category ID: ([^\n]*)', 1))) AS category, trim(substr(x, strpos(x, 'Criterion:') + 10), E' \n') AS criterion
 FROM (SELECT unnest(string_split({Q + RUBRIC.replace(Q, Q + Q) + Q}, 'Rubric ID:')[2:]) AS x) t""")
def _(spark, sf):
    return _criteria(spark)


def _matched(spark):
    return rubrics.match(_criteria(spark), rubrics.note_values(_notes(spark)), lexicon.categories(spark), lexicon.frequencies(spark))


MATCHED = [(1, True, True), (2, True, True), (3, False, False), (4, True, False), (5, True, False)]


@query("rubric_match", f"SELECT CAST(rubric_id AS BIGINT) AS rubric_id, representable, matched FROM {values('rubric_id, representable, matched', MATCHED)} t")
def _(spark, sf):
    return _matched(spark).select("rubric_id", "representable", "matched")


# Each value with what is left of it without its endings.
FREQ = [("twice a day", "twice a day"), ("1-0-1", "1-0-1"), ("od after food", "od"), ("bd/sos", "bd/sos"), ("sos/od", "sos/od"), ("food", "food"), ("take once at night for 5 days", "take once at night"), ("never", "never"), ("thrice daily with meals", "thrice daily"), ("od before eating for 2 weeks", "od"), ("od for some days", "od for some days")]
KEYS = values("ordinal, k, grp", [(i, k, g) for i, (k, g) in enumerate(lexicon.FREQUENCIES)])
FREQ_SQL = f"""WITH v AS (SELECT value, bare FROM {values('value, bare', FREQ)} t),
 m AS (SELECT value, grp, CASE WHEN bare = k THEN 0 WHEN list_contains(list_transform(string_split(bare, '/'), lambda p: trim(p)), k) THEN 1 ELSE 2 END AS a,
   coalesce(list_position(list_transform(string_split(bare, '/'), lambda p: trim(p)), k), 0) AS b, length(k) AS n, ordinal FROM v, {KEYS} f WHERE contains(bare, k)),
 r AS (SELECT value, grp, row_number() OVER (PARTITION BY value ORDER BY a, CASE WHEN a = 1 THEN b ELSE 0 END, n DESC, ordinal) AS x FROM m)
 SELECT v.value, r.grp FROM v LEFT JOIN r ON r.value = v.value AND x = 1"""


@query("freq_canon", FREQ_SQL)
def _(spark, sf):
    return rubrics.frequency_group(lexicon.one_column(spark, "value", [v for v, _ in FREQ]), lexicon.frequencies(spark))

@pytest.mark.parametrize("name", list(CASES))
def test_case(spark, name):
    make, sql = CASES[name]
    got = make(spark, None)
    want = duckdb.connect().execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert collections.Counter(map(tuple, got.select(columns).collect())) == collections.Counter(want.fetchall())
