"""The registered queries: operators on the driver's tables, and the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from clinispark.functions import scores, spans, variants
from clinispark.functions import text as T
from clinispark.operators import concepts, drugs, intervals, metrics, roles, rubrics
from clinispark.plans.catalog import query
from clinispark.sources import lexicon
from clinispark.sources.tables import head, scan, shown, table, take

Q = "'"


def values(names: str, rows: list[tuple]) -> str:
    """A VALUES list that both engines read."""

    def lit(v):
        if v is None:
            return "CAST(NULL AS VARCHAR)"
        return Q + v.replace(Q, Q + Q) + Q if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({names}))"


def strings(items) -> str:
    return "[" + ", ".join(Q + x.replace(Q, Q + Q) + Q for x in items) + "]"


def literal(spark, names: str, kinds: str, rows: list[tuple]):
    return spark.createDataFrame(rows, ", ".join(f"{n} {k}" for n, k in zip(names.split(", "), kinds.split(", "), strict=True)))


def _turns(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("recording_id"), F.col("turn").alias("turn_idx"), F.col("role").alias("speaker"), "text")


WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"
COUNT = f"len(list_filter({WORDS.format('lower(text)')}, lambda w: list_contains({strings(lexicon.INDICATORS)}, trim(w, '{T.EDGE}'))))"
SCORE = f"SELECT conv_id AS recording_id, role AS speaker, CAST(sum({COUNT}) AS BIGINT) AS score FROM conversations GROUP BY ALL"
ROLE = f"""SELECT *, CASE WHEN n < 2 OR sum(CASE WHEN score = top THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id) > 1 THEN 'UNKNOWN'
 WHEN score = top THEN 'DOCTOR' ELSE 'PATIENT' END AS speaker_role FROM (
 SELECT *, count(*) OVER (PARTITION BY recording_id) AS n, max(score) OVER (PARTITION BY recording_id) AS top FROM ({SCORE}) s) r"""


@query("indicator_score", SCORE)
def _(spark, sf):
    return roles.scores(_turns(spark, sf))


@query("role_assignment", f"SELECT recording_id, speaker, score, speaker_role FROM ({ROLE}) x")
def _(spark, sf):
    return roles.assign(roles.scores(_turns(spark, sf)))


@query("turns_with_roles", f"SELECT c.conv_id AS recording_id, c.turn AS turn_idx, c.role AS speaker, c.text, coalesce(r.speaker_role, 'UNKNOWN') AS speaker_role FROM conversations c LEFT JOIN (SELECT recording_id, speaker, speaker_role FROM ({ROLE}) x WHERE speaker <> 'system') r ON r.recording_id = c.conv_id AND r.speaker = c.role")
def _(spark, sf):
    turns = _turns(spark, sf)
    return roles.with_roles(turns, roles.assign(roles.scores(turns)).where("speaker <> 'system'"))


@query("nonempty_turns", "SELECT conv_id AS recording_id, turn AS turn_idx, role AS speaker, text FROM conversations WHERE text <> ''")
def _(spark, sf):
    return roles.spoken(_turns(spark, sf))


@query("transcript_assembly", "SELECT conv_id AS recording_id, string_agg('[' || upper(role) || ']: ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def _(spark, sf):
    return roles.transcripts(_turns(spark, sf).withColumn("speaker_role", F.upper("speaker")))


@query("hypothesis_concat", "SELECT conv_id AS recording_id, trim(string_agg(text, ' ' ORDER BY turn)) AS hypothesis FROM conversations GROUP BY conv_id")
def _(spark, sf):
    return roles.hypotheses(_turns(spark, sf))


@query("speaker_count", "SELECT conv_id AS recording_id, count(DISTINCT role) AS speakers FROM conversations GROUP BY conv_id")
def _(spark, sf):
    return roles.speaker_count(_turns(spark, sf))


def normal(x: str) -> str:
    marks = T.PUNCTUATION.replace(Q, Q + Q)
    return f"trim(regexp_replace(translate(lower({x}), '{marks}', '{' ' * len(T.PUNCTUATION)}'), '\\s+', ' ', 'g'))"


@query("normalize_text", f"SELECT doc_id, {normal('text')} AS norm FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("norm"))


SAMPLES = [(1, "रोगी को बुखार है।"), (2, "plain text"), (3, "mixed दवा text"), (4, "")]


@query("script_flag", f"SELECT doc_id AS id, regexp_matches(text, '[\\x{{0900}}-\\x{{097F}}]') AS devanagari FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -id, text FROM {values('id, text', SAMPLES)}) x")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    more = literal(spark, "id, text", "long, string", [(-i, t) for i, t in SAMPLES])
    return docs.unionByName(more).select("id", T.has_devanagari(F.col("text")).alias("devanagari"))


@query("ngram_spans", f"""SELECT item_id, array_to_string(w[i + 1 : i + n], ' ') AS span, CAST(i AS INT) AS start_word, CAST(i + n AS INT) AS end_word
 FROM (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark) b, (SELECT unnest([1, 2, 3]) AS n) ns, LATERAL (SELECT unnest(range(0, greatest(0, len(w) - n + 1))) AS i) x""")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.inline(spans.ngrams(T.words(F.col("text")))))


GLOSS = [("the", "Article", 0.5), ("of the", "Genitive", 0.9), ("and", "Conjunction", 0.7), ("the and", "Odd", 0.7), ("that", "Demonstrative", 0.6)]


@query("lexicon_gloss", f"""WITH w AS (SELECT conv_id, turn, text, {WORDS.format('text')} AS w FROM conversations),
 g AS (SELECT conv_id, turn, n, i, array_to_string(w[i + 1 : i + n], ' ') AS span FROM w, (SELECT unnest([1, 2, 3]) AS n) ns, LATERAL (SELECT unnest(range(0, greatest(0, len(w) - n + 1))) AS i) x),
 m AS (SELECT conv_id, turn, list({{'s': i, 'e': i + n, 'l': label}} ORDER BY score DESC, n, i) AS ms FROM g JOIN {values('span, label, score', GLOSS)} t USING (span) GROUP BY ALL),
 c AS (SELECT conv_id, turn, list_reduce(list_transform(ms, lambda m: [m]), lambda a, b: CASE WHEN len(list_filter(a, lambda o: o.s < b[1].e AND b[1].s < o.e)) > 0 THEN a ELSE list_concat(a, b) END) AS cs FROM m)
 SELECT w.conv_id AS recording_id, w.turn AS turn_idx, CASE WHEN cs IS NULL THEN text ELSE array_to_string(list_filter(list_transform(range(0, len(w)), lambda i:
   CASE WHEN len(list_filter(cs, lambda m: m.s = i)) > 0 THEN array_to_string(w[i + 1 : list_filter(cs, lambda m: m.s = i)[1].e], ' ') || ' (' || list_filter(cs, lambda m: m.s = i)[1].l || ')'
   WHEN len(list_filter(cs, lambda m: m.s < i AND i < m.e)) > 0 THEN NULL ELSE w[i + 1] END), lambda p: p IS NOT NULL), ' ') END AS text
 FROM w LEFT JOIN c USING (conv_id, turn)""")
def _(spark, sf):
    turns = _turns(spark, sf).drop("speaker")
    return concepts.gloss_turns(turns, concepts.lexicon_spans(turns, literal(spark, "span, label, score", "string, string, double", GLOSS)))
FORM = "|".join(sorted(lexicon.FORMS, key=len, reverse=True))
BARE = f"trim(regexp_replace(regexp_replace(norm, '^(?:(?:{FORM})\\s+)+', '', 'i'), '(?:\\s+(?:{FORM}))+$', '', 'i'))"
DRUGS = values("drug", [(d,) for d in lexicon.DRUGS])
TIER = f"""WITH d AS {DRUGS}, n AS (SELECT name, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS norm FROM NAMES_), b AS (SELECT *, {BARE} AS bare FROM n),
 k AS (SELECT *, CASE WHEN bare = '' THEN norm ELSE bare END AS work FROM b)
 SELECT name, CAST(CASE WHEN norm = '' THEN NULL WHEN EXISTS (SELECT 1 FROM d WHERE drug = norm) THEN 1 WHEN EXISTS (SELECT 1 FROM d WHERE drug = bare) THEN 2
 WHEN EXISTS (SELECT 1 FROM d WHERE length(work) >= 4 AND length(drug) >= 4 AND (contains(drug, work) OR contains(work, drug))) THEN 3
 WHEN EXISTS (SELECT 1 FROM d WHERE len(list_intersect(list_filter(regexp_split_to_array(work, '[\\s\\-/]+'), lambda t: length(t) >= 4), regexp_split_to_array(drug, '[\\s\\-/]+'))) > 0) THEN 4 END AS INT) AS tier FROM k"""


PARTS = ["almond", "metal", "green", "steel polished", "burnished"]


@query("part_name_tier", "SELECT p_partkey, name, tier FROM (" + TIER.replace(DRUGS, values("drug", [(p,) for p in PARTS])).replace("NAMES_", "(SELECT DISTINCT p_name AS name FROM part) q") + ") t JOIN part ON p_name = name")
def _(spark, sf):
    found = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"))
    return drugs.validate(found, lexicon.one_column(spark, "drug", PARTS)).drop("validated")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings")


DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
# Every pair's product once; the nearest and the negatives both read it.
PAIRED = f"s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, b.label AS l, {DOT} AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"
NEAREST = f"""{PAIRED}, near AS (SELECT a AS span_id, b AS ref_idx, l AS concept_idx, round(d, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY d DESC, b) = 1)"""


# Each vector is matched against all others; the negatives of a match are all other vectors of its label.
def _nearest(spark, sf):
    v = _vectors(spark, sf)
    found = v.select(F.col("vec_id").alias("span_id"), "embedding")
    refs = v.select(F.col("vec_id").alias("ref_idx"), F.col("label").alias("concept_idx"), "embedding")
    return concepts.nearest(found, refs, apart=True).withColumn("similarity", F.round("similarity", 6)), found, v


@query("nn_concept", f"WITH {NEAREST} SELECT * FROM near")
def _(spark, sf):
    return _nearest(spark, sf)[0]


@query("threshold_match", f"WITH {NEAREST} SELECT * FROM near WHERE similarity >= 0.3")
def _(spark, sf):
    return concepts.above(_nearest(spark, sf)[0], 0.3)


@query("hardneg_gate", f"""WITH {NEAREST}, g AS (SELECT span_id, max(d) AS m FROM near JOIN s ON s.a = span_id AND s.l = concept_idx AND s.b <> ref_idx WHERE similarity >= 0.3 GROUP BY 1)
 SELECT near.*, round(m, 6) AS max_negative FROM near LEFT JOIN g USING (span_id) WHERE similarity >= 0.3 AND (m IS NULL OR m < similarity - CAST(0.05 AS DOUBLE))""")
def _(spark, sf):
    near, found, v = _nearest(spark, sf)
    neg = v.select(F.col("label").alias("concept_idx"), F.col("vec_id").alias("neg_idx"), "embedding")
    return concepts.gate(concepts.above(near, 0.3), found, neg).withColumn("max_negative", F.round("max_negative", 6))


HITS = f"""SELECT d.doc_id, contains(d.norm, b.k) AS present, contains(d.hyp, b.k) AS kept FROM (SELECT d.doc_id, {normal('d.text')} AS norm, coalesce({normal('n.text')}, '') AS hyp
 FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1) d, (SELECT {normal('text')} AS k FROM benchmark) b"""
KEYED = f"SELECT doc_id, CAST(count(*) FILTER (WHERE present) AS BIGINT) AS present, CAST(count(*) FILTER (WHERE present AND NOT kept) AS BIGINT) AS missed FROM ({HITS}) h GROUP BY doc_id"


def with_next(df, *columns: str):
    """df (doc_id, columns) -> (doc_id, columns, then those of the next document as next_*), from one pass over df.

    Each row goes to its own key and to the one before it, so what the columns cost is paid once.
    """
    me = F.struct(*[F.col(c) for c in columns])
    both = df.select(F.inline(F.array(F.struct("doc_id", me.alias("me"), F.lit(None).cast(df.select(me.alias("x")).schema["x"].dataType).alias("other")), F.struct((F.col("doc_id") - 1).alias("doc_id"), F.lit(None).cast(df.select(me.alias("x")).schema["x"].dataType).alias("me"), me.alias("other")))))
    held = both.groupBy("doc_id").agg(F.first("me", ignorenulls=True).alias("me"), F.first("other", ignorenulls=True).alias("other"))
    return held.where("me IS NOT NULL").select("doc_id", *[F.col(f"me.{c}").alias(c) for c in columns], *[F.col(f"other.{c}").alias(f"next_{c}") for c in columns], F.col("other").isNotNull().alias("has_next"))


# The hypothesis of a document is the whole next document, as in jaccard; one without a next one misses all.
def _keyed(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("norm"))
    words = table(spark, sf, "benchmark").select(T.normalize_text(F.col("text")).alias("keyword"))
    pairs = with_next(metrics.keyword_hits(docs, words).select("doc_id", "hits"), "hits")
    missed = F.size(F.array_except("hits", F.coalesce("next_hits", F.array().cast("array<int>"))))
    return pairs.select("doc_id", F.size("hits").cast("long").alias("present"), missed.cast("long").alias("missed"))


@query("keyword_hits", KEYED)
def _(spark, sf):
    return _keyed(spark, sf)


@query("keyword_wer", f"SELECT doc_id, CASE WHEN present > 0 THEN round(missed / present, 4) ELSE 0.0 END AS keyword_wer FROM ({KEYED}) k")
def _(spark, sf):
    return _keyed(spark, sf).select("doc_id", scores.rate(F.col("missed"), F.col("present"), 4).alias("keyword_wer"))


@query("micro_rates", f"SELECT present, missed, CASE WHEN present > 0 THEN round(missed / present, 4) ELSE 0.0 END AS keyword_wer FROM (SELECT CAST(sum(present) AS BIGINT) AS present, CAST(sum(missed) AS BIGINT) AS missed FROM ({KEYED}) k) s")
def _(spark, sf):
    return metrics.micro(_keyed(spark, sf))


# The distance there is over bytes, so shared words become single ones, and words of one side only, which never match, one
# letter a side. A pair with more than 90 distinct shared words would need more letters than there are: it errs, not lies.
PAIR = f"""SELECT a.conv_id, a.turn, {WORDS.format(normal('a.text'))} AS r, {WORDS.format(normal('b.text'))} AS h FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""
CODED = f"SELECT *, CASE WHEN len(list_intersect(r, h)) <= 90 THEN list_intersect(r, h) ELSE error('too many shared words') END AS v FROM ({PAIR}) p"
LETTERS = "array_to_string(list_transform({0}, lambda w: CASE WHEN list_contains(v, w) THEN chr(CAST(35 + list_position(v, w) AS INT)) ELSE '{1}' END), '')"
EDITS = f"levenshtein({LETTERS.format('r', '!')}, {LETTERS.format('h', '#')})"


def _pairs(spark, sf):
    c = table(spark, sf, "conversations")
    whole = lambda x: T.words(T.normalize_text(x))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), whole(F.col("text")).alias("h"))
    return c.select("conv_id", "turn", whole(F.col("text")).alias("r")).join(nxt, ["conv_id", "turn"])


@query("wer_pairs", f"SELECT conv_id, turn, CASE WHEN len(r) = 0 THEN CASE WHEN len(h) = 0 THEN 0.0 ELSE 1.0 END ELSE round({EDITS} / len(r), 6) END AS wer FROM ({CODED}) c")
def _(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", F.round(scores.word_error_rate(F.col("r"), F.col("h")), 6).alias("wer"))


@query("corpus_wer", f"SELECT CAST(sum({EDITS}) AS BIGINT) AS edits, CAST(sum(len(r)) AS BIGINT) AS words, round(sum({EDITS}) / sum(len(r)), 4) AS wer FROM ({CODED}) c WHERE len(r) > 0")
def _(spark, sf):
    p = _pairs(spark, sf)
    return metrics.corpus_wer(p.select(F.array_join("r", " ").alias("reference"), F.array_join("h", " ").alias("hypothesis")))


@query("event_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


SIDE = "SELECT doc_id, list_distinct(list_filter(string_split(regexp_replace(lower(trim(text)), '[^a-z0-9 ]', '', 'g'), ' '), lambda w: w <> '')) AS w FROM documents"


def _sides(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.array_distinct(F.filter(F.split(T.plain(F.col("text")), " "), lambda w: w != "")).alias("w"))
    return with_next(d, "w").where("has_next").select("doc_id", F.col("w").alias("a"), F.col("next_w").alias("b"))


@query("jaccard", f"SELECT a.doc_id, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) END AS overlap FROM ({SIDE}) a JOIN ({SIDE}) b ON b.doc_id = a.doc_id + 1")
def _(spark, sf):
    return _sides(spark, sf).select("doc_id", F.round(scores.jaccard(F.col("a"), F.col("b")), 6).alias("overlap"))


@query("prefix_cover", f"""WITH g AS (SELECT a.doc_id, unnest(a.w) AS g, b.w FROM ({SIDE}) a JOIN ({SIDE}) b ON b.doc_id = a.doc_id + 1)
 SELECT a.doc_id, len(a.w) > 0 AND coalesce(bool_and(list_contains(g.w, g) OR len(list_filter(g.w, lambda c: length(g) >= 3 AND length(c) >= 3 AND (starts_with(g, c) OR starts_with(c, g)))) > 0), true) AS covered
 FROM ({SIDE}) a JOIN ({SIDE}) b ON b.doc_id = a.doc_id + 1 LEFT JOIN g ON g.doc_id = a.doc_id GROUP BY a.doc_id, a.w""")
def _(spark, sf):
    return _sides(spark, sf).select("doc_id", scores.covered(F.col("a"), F.col("b")).alias("covered"))


@query("category_rollup", """SELECT coalesce(category, 'ALL') AS category, total, representable, matched, CASE WHEN representable > 0 THEN round(matched / representable, 3) WHEN g = 1 THEN 0.0 END AS recall FROM (
 SELECT lang AS category, count(*) AS total, count(quality) AS representable, count(*) FILTER (WHERE quality = 1) AS matched, grouping(lang) AS g FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)) r""")
def _(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rubrics.rollup(d.select(F.col("lang").alias("category"), F.col("quality").isNotNull().alias("representable"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("matched")))


PICKS = [7, 3, 11, 2, 99, 40]


@query("frozen_take", f"SELECT CAST(pos AS INT) AS pos, doc_id, lang, n_chars FROM documents JOIN {values('pos, k', list(enumerate(PICKS)))} t ON k = doc_id")
def _(spark, sf):
    return take(table(spark, sf, "documents"), "doc_id", PICKS).select("pos", "doc_id", "lang", "n_chars").orderBy("pos")


@query("ordered_head", "SELECT doc_id, source, substr(text, 1, 80) AS start FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def _(spark, sf):
    top = head(table(spark, sf, "documents").withColumn("neg", -F.col("n_chars")), 10, "neg", "doc_id")
    return top.select("doc_id", "source", F.substring("text", 1, 80).alias("start"))


@query("report_values", "SELECT source, count(*) AS n, array_to_string(list(doc_id ORDER BY doc_id)[1:5], ' ') AS first_ids FROM documents GROUP BY source")
def _(spark, sf):
    return shown(table(spark, sf, "documents"), ["source"], F.col("doc_id")).withColumn("first_ids", F.array_join(F.col("shown").cast("array<string>"), " ")).drop("shown")


@query("multi_scan", "SELECT source, CAST(2 * count(*) AS BIGINT) AS n FROM documents GROUP BY source")
def _(spark, sf):
    return scan(spark, f"{sf}/documents.parquet", f"{sf}/documents.parquet").groupBy("source").agg(F.count("*").alias("n"))


@query("repeat_last_wins", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) e WHERE k = 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("ordered_distinct", f"SELECT item_id, array_to_string(list_filter(list_transform(range(0, len(w)), lambda i: CASE WHEN list_position(w, w[i + 1]) = i + 1 THEN w[i + 1] END), lambda x: x IS NOT NULL), ' ') AS words FROM (SELECT item_id, {WORDS.format('text')} AS w FROM benchmark) b")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_distinct(T.words(F.col("text"))), " ").alias("words"))


@query("transcript_tokens", "SELECT conv_id, turn, array_to_string(list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda t: lower(t))), lambda t: length(t) >= 4 AND t NOT IN ('doctor', 'patient', 'unknown'))), ' ') AS tokens FROM conversations")
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(T.long_latin_tokens(F.col("text"))), " ").alias("tokens"))


GAP = 6 * 3600 * 10**6
SESSIONS = f"""e AS (SELECT user_id, epoch_us(ts) AS t FROM events),
 g AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > {GAP} THEN 1 ELSE 0 END AS new FROM e),
 r AS (SELECT user_id, t, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS session FROM g),
 s AS MATERIALIZED (SELECT user_id, CAST(session AS INT) AS session, min(t) AS a, max(t) AS b FROM r GROUP BY ALL)"""


def _sessions(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return intervals.sessions(e, "user_id", "at", GAP)


# Sessions of users with an even number against those of the others: which one each overlaps most, ties to the earlier.
@query("session_overlap", f"""WITH {SESSIONS}, p AS (SELECT x.user_id, x.session, y.user_id AS other, y.session AS other_session, least(x.b, y.b) - greatest(x.a, y.a) AS overlap, y.a FROM s x JOIN s y
   ON x.user_id % 2 = 0 AND y.user_id % 2 = 1 AND x.a < y.b AND y.a < x.b AND x.a < x.b AND y.a < y.b),
 k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY user_id, session ORDER BY overlap DESC, a, other) = 1)
 SELECT s.user_id, s.session, k.other, k.other_session, k.overlap FROM s LEFT JOIN k ON k.user_id = s.user_id AND k.session = s.session WHERE s.user_id % 2 = 0""")
def _(spark, sf):
    s = _sessions(spark, sf)
    found = intervals.largest(s.where("user_id % 2 = 0"), s.where("user_id % 2 = 1"), [], ["user_id", "session"], ["start", "user_id"])
    return found.select("left.user_id", "left.session", F.col("right.user_id").alias("other"), F.col("right.session").alias("other_session"), "overlap")


# How long each session of a user shares with sessions of others in the same hundred of users.
@query("shared_time", f"""WITH {SESSIONS} SELECT x.user_id, x.session, count(*) AS n, CAST(sum(least(x.b, y.b) - greatest(x.a, y.a)) AS BIGINT) AS shared
 FROM s x JOIN s y ON x.user_id // 100 = y.user_id // 100 AND x.user_id <> y.user_id AND x.a < y.b AND y.a < x.b AND x.a < x.b AND y.a < y.b GROUP BY ALL""")
def _(spark, sf):
    s = _sessions(spark, sf).withColumn("hundred", F.expr("user_id div 100"))
    pairs = intervals.overlaps(s, s, ["hundred"]).where("left.user_id <> right.user_id")
    return pairs.groupBy("left.user_id", "left.session").agg(F.count("*").alias("n"), F.sum("overlap").alias("shared"))


# Kinds of word errors of each document against the next, whole texts. Edits can be told in SQL by letters for words only where
# few words are shared, and the kinds not at all: tests hold the rows against a full table with traceback.
def _kinds(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("t"))  # a text is smaller than its words
    return metrics.error_kinds(with_next(d, "t").where("has_next").select("doc_id", F.col("t").alias("r"), F.col("next_t").alias("h"))).drop("r", "h")


@query("word_errors")
def _(spark, sf):
    return _kinds(spark, sf)


@query("word_error_split")
def _(spark, sf):
    return metrics.error_split(_kinds(spark, sf))


@query("event_fields", """SELECT event_id, CASE WHEN NOT json_valid(props) THEN 'malformed' WHEN json_type(props, '$.k') IS NULL THEN 'absent' WHEN json_type(props, '$.k') = 'NULL' THEN 'null' ELSE 'value' END AS state,
 TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE props IS NOT NULL""")
def _(spark, sf):
    e = table(spark, sf, "events").where("props IS NOT NULL")
    return e.select("event_id", variants.state(F.col("props"), "$.k").alias("state"), variants.value(F.col("props"), "$.k", "bigint").alias("k"))


@query("event_shapes", """SELECT event_type, 'OBJECT<k: ' || CASE WHEN bool_and(json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')) THEN 'BIGINT' ELSE 'VARIANT' END || '>' AS shape, count(*) AS n
 FROM events WHERE json_valid(props) GROUP BY event_type""")
def _(spark, sf):
    return variants.shapes(table(spark, sf, "events"), "props", "event_type")
