import io
import json
import random
import unicodedata
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clinispark.functions import fuzzy
from clinispark.operators import concepts, drugs, metrics, notes, roles, rubrics
from clinispark.plans import consult, evaluate, pdf, render
from clinispark.sources import audio, backends, lexicon, tables
from clinispark.streaming import turns as stream


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"recording_id", "speaker", "score", "speaker_role"}


def test_roles(spark):
    rows = [(1, "a", "what dose"), (1, "b", "hello"), (2, "a", "what"), (2, "b", "why"), (3, "a", "what")]
    got = {(r.recording_id, r.speaker): r.speaker_role for r in roles.assign(roles.scores(spark.createDataFrame(rows, "recording_id int, speaker string, text string"))).collect()}
    assert got == {(1, "a"): "DOCTOR", (1, "b"): "PATIENT", (2, "a"): "UNKNOWN", (2, "b"): "UNKNOWN", (3, "a"): "UNKNOWN"}


def test_drug_tiers(spark):
    names = ["Paracetamol", "Tab Paracetamol", "furosem", "plus Zinc2 acid-x", "", None, "zzz"]
    got = {r.name: r.tier for r in drugs.validate(spark.createDataFrame([(n,) for n in names], "name string"), lexicon.drugs(spark)).collect()}
    assert got == {"Paracetamol": 1, "Tab Paracetamol": 2, "furosem": 3, "plus Zinc2 acid-x": 3, "": None, None: None, "zzz": None}


def test_drug_rewrite_fuzzy(spark):
    turns = spark.createDataFrame([(1, 0, "रोज ओमेप्राज़ोल लो"), (1, 1, "as  is")], "recording_id int, turn_idx int, text string")
    got = {r.turn_idx: r.text for r in drugs.rewrite(turns, lexicon.drugs(spark), lexicon.scripts(spark)).collect()}
    assert got[1] == "as  is" and got[0] == "रोज omeprazole लो"


def test_gate_margin_is_strict(spark):
    found = spark.createDataFrame([(1, [1.0, 0.0])], "span_id int, embedding array<float>")
    matched = spark.createDataFrame([(1, 0, 0.70)], "span_id int, concept_idx int, similarity double")
    for x, stays in ((0.65, False), (0.64, True)):
        neg = spark.createDataFrame([(0, [x, 0.0])], "concept_idx int, embedding array<double>")
        assert (concepts.gate(matched, found, neg).count() == 1) is (stays or x < 0.70 - 0.05)


def test_keyword_counts(spark):
    df = spark.createDataFrame([("Take Dolo, and iron.", "take dolo", ["dolo", "iron", "zinc"])], "r string, h string, k array<string>")
    row = df.select(metrics.keyword_counts(F.col("r"), F.col("h"), F.col("k")).alias("c")).select("c.*").first()
    assert (row.present, row.missed) == (2, 1)


def test_corpus_wer(spark):
    df = spark.createDataFrame([("a b c", "a b c"), ("d e", "d x"), ("", "q")], "reference string, hypothesis string")
    assert metrics.corpus_wer(df).first().wer == 0.2


def note(spark, data, transcript="", **more):
    raw = data if isinstance(data, str) else json.dumps(data)
    return notes.build(spark.createDataFrame([("n", raw, transcript)], "note_id string, raw string, transcript string"), lexicon.drugs(spark)).first()


def test_note_dose_stays_null(spark):
    n = note(spark, {"medications": [{"drug": "Paracetamol", "dose": None}]})
    assert n.medications[0].dose is None and n.medications[0].validated and n.low_confidence_fields == ["medications.Paracetamol.dose_unknown"]


def test_note_malformed_and_null_lists(spark):
    assert note(spark, "not json").low_confidence_fields == list(notes.EMPTY_FLAGS)
    n = note(spark, {k: None for k in notes.LISTS})
    assert n.outcome == "ok" and not n.symptoms and not n.low_confidence_fields


def test_note_foreign_diagnosis(spark):
    assert note(spark, {"diagnosis": [{"term": "Pulmonary Embolism"}]}, "[DOCTOR]: acne only").low_confidence_fields == ["diagnosis.Pulmonary Embolism.no_transcript_overlap"]
    assert note(spark, {"diagnosis": [{"term": "Pulmonary Embolism"}]}, "[DOCTOR]: मुंहासे").low_confidence_fields == []


def test_render_order(spark):
    rows = render.rows(notes.build(spark.createDataFrame([("n", json.dumps({"vitals": [{"name": "Waist", "value": "9"}, {"name": "BP", "value": "1"}, {"name": "BP", "value": "2"}], "advice": "rest", "low_confidence_fields": ["advice"]}), "")], "note_id string, raw string, transcript string"), lexicon.drugs(spark))).orderBy("section_no", "row_no").collect()
    assert rows[0].cells == [render.BANNER]
    assert [r.cells for r in rows if r.section == "Vitals"][2:3] == [["BP", "2"]] and rows[-2].cells == ["rest ⚑"] and rows[-1].cells == ["advice"]


def test_rubric_rollup(spark):
    df = spark.createDataFrame([("a", True, True), ("a", True, False), ("b", False, False)], "category string, representable boolean, matched boolean")
    got = {r.category: r.recall for r in rubrics.rollup(df).collect()}
    assert got == {"a": 0.5, "b": None, "ALL": 0.5}


def wav(x, rate=8000):
    return audio.encode(np.asarray(x, np.float32), rate)


def test_audio(spark):
    t = np.concatenate([np.zeros(8000), 0.5 * np.sin(np.arange(16000) / 5), np.zeros(8000)])
    df = spark.createDataFrame([("a", bytearray(wav(t))), ("b", bytearray(b"no"))], "path string, content binary")
    got = {r.path: r for r in audio.preprocess(df).collect()}
    with wave.open(io.BytesIO(bytes(got["a"].wav))) as w:
        assert (w.getframerate(), w.getnchannels(), w.getsampwidth()) == (16000, 1, 2)
    assert 1.9 < got["a"].seconds < 2.3 and got["b"].error


def test_consult_end_to_end(spark):
    clips = spark.createDataFrame([("r1", bytearray(b"x"))], "recording_id string, wav binary")
    diarizer = lambda: lambda w: [(2.0, 3.0, "s2"), (0.0, 2.0, "s1"), (3.0, 4.0, "s1")]
    transcriber = lambda: lambda w, a, b: {0.0: [" what pain", "fever "], 2.0: ["haan"], 3.0: [" "]}[a]
    reply = backends.replay({"fever": '{"chief_complaint": "fever"}'})
    rows = consult.run(clips, lexicon.drugs(spark), lexicon.scripts(spark), diarizer, transcriber, reply).collect()
    assert [r.cells for r in rows if r.section == "Chief Complaint"] == [["fever"]]


def test_extract_retries_only_bad_json(spark):
    df = spark.createDataFrame([("a", "bad"), ("b", "boom")], "note_id string, transcript string")

    def factory():
        def model(prompt):
            if prompt.endswith("boom"):
                raise RuntimeError("down")
            return "{"

        return model

    got = {r.note_id: (r.attempt, r.error) for r in backends.extract(df, factory).collect()}
    assert got == {"a": (2, None), "b": (1, "RuntimeError: down")}


def test_pool_unit_rows():
    x = backends.pool(np.ones((2, 3, 4), np.float32), np.array([[1, 1, 0], [0, 0, 0]]))
    assert abs(np.linalg.norm(x[0]) - 1) < 1e-6 and np.isfinite(x).all()


def test_tables(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    assert [r.id for r in tables.head(df, 2, "id").collect()] == [0, 1]
    assert [(r.pos, r.id) for r in tables.take(df, "id", [7, 3]).orderBy("pos").collect()] == [(0, 7), (1, 3)]
    tables.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 10 and "id" in tables.report(df, "id")


def test_stream(spark, tmp_path):
    kind, at = "recording_id int, speaker string, text string", str(tmp_path / "t")
    spark.createDataFrame([(1, "a", "what dose"), (1, "b", "x")], kind).write.parquet(at)
    scored = stream.running_scores(spark, at, spark.read.parquet(at).schema)
    assert {(r.speaker, r.score) for r in stream.drain(scored, str(tmp_path / "live")).collect()} == {("a", 2), ("b", 0)}
    spark.createDataFrame([(1, "a", "fever")], kind).write.mode("append").parquet(at)
    scored = stream.running_scores(spark, at, spark.read.parquet(at).schema)
    assert {(r.speaker, r.score) for r in stream.drain(scored, str(tmp_path / "live")).collect()} == {("a", 3), ("b", 0)}


def test_preflight_and_results(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "\u0926\u0935\u093e")], "id int, v string")
    df.write.parquet(str(tmp_path / "in"))
    tables.preflight(spark, str(tmp_path / "in"), backends={"model": lambda: True})
    with pytest.raises(RuntimeError, match="no input at .*/none; model does not answer; asr: OSError: off"):

        def off():
            raise OSError("off")

        tables.preflight(spark, str(tmp_path / "none"), backends={"model": lambda: False, "asr": off})
    tables.write_results(df.groupBy().count(), df, str(tmp_path / "out"), "id")
    assert spark.read.json(str(tmp_path / "out/summary")).first()["count"] == 2
    assert "\u0926\u0935\u093e" in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out/samples").glob("*.json"))
    assert tables.write_frozen(df, "id", str(tmp_path / "frozen"), "set") == [2, 1]
    assert spark.read.json(str(tmp_path / "frozen")).first().ids == [2, 1]
    assert len(tables.parts(df, 1)) == 2 and sum(p.count() for p in tables.parts(df, 1)) == 2


def test_lexicon_files(spark, tmp_path):
    lexicon.concepts(spark).write.parquet(str(tmp_path / "c"))
    assert lexicon.load(spark, "concepts", str(tmp_path / "c")).count() == len(lexicon.CONCEPTS)
    (tmp_path / "s.csv").write_text("span,latin,more\nx,y,z\n")
    assert [tuple(r) for r in lexicon.load(spark, "scripts", str(tmp_path / "s.csv")).collect()] == [("x", "y")]
    (tmp_path / "d.csv").write_text("drug\nzinc\nzinc\n")
    for kind, path, what in (("drugs", "d.csv", "repeats"), ("scripts", "d.csv", "lacks span, latin")):
        with pytest.raises(ValueError, match=what):
            lexicon.load(spark, kind, str(tmp_path / path))


def test_backend_is_built_once_in_a_worker(spark, tmp_path):
    log = str(tmp_path / "built")

    def factory():
        with open(log, "a") as f:
            f.write("x")
        return lambda texts: np.ones((len(texts), 2))

    for _ in range(3):
        assert backends.embed(spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1), factory).count() == 2
    with open(log) as f:
        assert len(f.read()) < 3 * 4  # at most once in each of the four workers, not once in each of the twelve tasks


def test_embedding_gloss(spark):
    """Spans near a wording are glossed with its concept, but not those near a hard negative."""
    at = {"fever": (1, 0, 0), "bukhar": (0.98, 0.2, 0), "hot day": (0.8, 0, 0.6), "cough": (0, 1, 0), "tez bukhar": (0.97, 0.24, 0), "garmi": (0.85, 0, 0.53)}

    def factory():
        unit = lambda v: np.array(v) / np.linalg.norm(v)
        return lambda texts: np.stack([unit(at.get(t, (0, 0, 1))) for t in texts])

    lex = spark.createDataFrame([(0, "fever", "1", ["bukhar"], ["hot day"]), (1, "cough", "2", [], [])], "concept_idx int, term string, snomed_id string, variants array<string>, hard_negatives array<string>")
    turns = spark.createDataFrame([(1, 0, "mujhe tez bukhar hai"), (1, 1, "garmi hai"), (1, 2, ""), (2, 0, "cough  only")], "recording_id int, turn_idx int, text string")
    found = concepts.gloss_turns(turns, concepts.embedding_matches(turns, lex, factory))
    assert {(r.recording_id, r.turn_idx): r.text for r in found.collect()} == {(1, 0): "mujhe tez bukhar (fever) hai", (1, 1): "garmi hai", (1, 2): "", (2, 0): "cough (cough) only"}


def test_evaluation(spark, tmp_path):
    samples = spark.createDataFrame([("a", "take dolo for fever", '[["Dolo","drugs",[]],["fever","symptom",[]]]'), ("b", "rest", "[]")], "id string, reference string, entities string")
    each, summary = evaluate.speech(samples, spark.createDataFrame([("a", "take dollo for fever")], "id string, hypothesis string"))
    rows = {r.id: r for r in each.collect()}
    assert (rows["a"].keywords, rows["a"].keywords_missed, rows["a"].drugs_missed, rows["a"].wer) == (2, 1, 1, 0.25) and rows["b"].wer == 1.0
    total = summary.first()
    assert (total.samples, total.keyword_wer, total.drug_wer, total.edits, total.words, total.wer) == (2, 0.5, 1.0, 2, 5, 0.4)
    assert "keyword_wer" in evaluate.save(each, summary, str(tmp_path / "out"), "id")
    notes_in = spark.createDataFrame([("n1", "fever", "Rubric ID: 1\nCategory ID: symptom_name\nCriterion: has 'fever'\n"), ("n2", "none", "Rubric ID: 2\nCategory ID: symptom_name\nCriterion: 'cough'")], "note_id string, transcript string, rubrics string")
    extractor = backends.replay({"fever": '{"symptoms": [{"name": "Fever"}]}'})
    each, recall = evaluate.extraction(notes_in, extractor, lexicon.drugs(spark), lexicon.categories(spark), lexicon.frequencies(spark))
    assert [(r.category, r.total, r.matched, r.recall) for r in recall.collect()] == [("symptom_name", 2, 1, 0.5), ("ALL", 2, 1, 0.5)]


def test_rubric_records(spark):
    text = "intro\nRubric ID: 1\nCategory ID: A_b \nCriterion: one\ntwo lines\nRubric ID: x\nCategory ID: c\nCriterion: no number\nRubric ID:  7 \nCategory ID: d\nno criterion\nRubric ID: 8\nCategory ID: e\nCriterion: 'last'"
    got = rubrics.parse(spark.createDataFrame([("n", text), ("m", ""), ("k", None)], "note_id string, rubrics string")).collect()
    assert [tuple(r) for r in got] == [("n", 1, "a_b", "one\ntwo lines"), ("n", 8, "e", "'last'")]


def test_pdf(spark, tmp_path):
    rows = [("a/1", 0, "Banner", 0, ["DRAFT (x) \u2014 REVIEW"]), ("a/1", 2, "History", 0, ["long " * 60]), ("a/1", 7, "Medications", 0, ["Dolo", "\u26d1 \u2713"])]
    rendered = spark.createDataFrame(rows, "note_id string, section_no int, section string, row_no int, cells array<string>")
    found = pdf.files(rendered)
    data = bytes(found.first().pdf)
    assert data.startswith(b"%PDF-1.4") and data.rstrip().endswith(b"%%EOF") and b"DRAFT \\(x\\) - REVIEW" in data and b"Dolo | ? yes" in data
    start = int(data.split(b"startxref\n")[1].split()[0])
    assert data[start : start + 4] == b"xref"
    assert pdf.save(found, str(tmp_path / "pdf")) == 1 and (tmp_path / "pdf" / "a_1_draft_rx.pdf").read_bytes() == data


def test_resample_has_no_aliases():
    t = np.arange(48_000) / 48_000
    low, high = np.sin(2 * np.pi * 440 * t).astype(np.float32), np.sin(2 * np.pi * 14_000 * t).astype(np.float32)
    inner = slice(200, -200)
    want = np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)
    assert np.abs(audio.resample(low, 48_000)[inner] - want[inner]).max() < 1e-3 and np.abs(audio.resample(high, 48_000)[inner]).max() < 1e-2
    assert len(audio.resample(low[:8_000], 8_000)) == 16_000


def test_fuzzy_bounds_lose_nothing(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(4, 12))) for _ in range(120)]
    df = spark.createDataFrame([(a, b) for a in words[:40] for b in words[40:]], "a string, b string")
    x = df.withColumns({"r": fuzzy.matching_ratio("a", "b"), "ok": fuzzy.ratio_can_reach(F.col("a"), F.col("b"), 0.6) & fuzzy.letters_can_reach(F.col("a"), F.col("b"), 0.6)})
    assert x.where("r >= 0.6 AND NOT ok").count() == 0 and x.where("NOT ok").count() > 100


def test_scripts_in_any_normal_form(spark):
    split = unicodedata.normalize("NFD", "\u0917\u093c\u091c\u093c \u091c\u093c\u0940\u092b\u0940")
    turns = spark.createDataFrame([(1, 0, "\u0930\u094b\u091c\u093c \u091c\u093f\u0902\u0915"), (1, 1, split)], "recording_id int, turn_idx int, text string")
    got = {r.turn_idx: r.text for r in drugs.rewrite(turns, spark.createDataFrame([], "drug string"), lexicon.scripts(spark), use_fuzzy=False).collect()}
    assert got[0].endswith(" zinc") and got[1].endswith(" zifi")
