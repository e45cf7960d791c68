"""Cross-entropy difference: a target and a background bigram model of one vocabulary, and per-token loss differences.

The target text is that of documents labelled with quality 1, the background that of all documents. Both models are
alike: p(w | h) = (c(h, w) + mu * p(w)) / (c(h) + mu) over p(w) = (c(w) + 1) / (N + V), V the words of all documents, and
background counts are scaled to the target's number of tokens, so smoothing weighs the same in both. A document's own
counts are left out of both models when it is scored. score is the mean over tokens of target loss less background loss;
the lower, the more the document is like the target.

All counts cover all documents. Documents are dealt to chunks; a chunk sends each distinct word and bigram once to a range
of hashes with its counts there, and gets the totals of all chunks back in the same order.

Defined cases: null or empty texts have no token and null losses; without labelled documents the target model knows only
the vocabulary; a doc_id with several labels is a target if one of them has quality 1; rows that repeat count each; a
null doc_id is never a target; an empty table gives an empty result; texts are read whole; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .exchange import collapsed, filled, merged, pack, pack_sorted, unpack, unpack_sorted
from .substring_dedup import _rows, runs_of
from .words import BASE, LOWER, U64, binary, hashed, mixed, slices

CHUNK_BYTES, RANGE_HASHES, MU = 8_000_000, 1_500_000, 4.0
SURVEY = "doc_id long, chunk int, n long, range int, words binary"
ASK = "range int, chunk int, hashes binary, every binary, target binary"
ANSWER = "chunk int, range int, every binary, target binary"
RESULT = "doc_id long, n_tokens long, is_target boolean, target_loss double, background_loss double, score double, copies int"
START = U64(0x5851F42D4C957F2D)
ONE = U64(1)


def survey(docs: DataFrame, ranges: int) -> DataFrame:
    """SURVEY of docs (doc_id, text, chunk): tokens of each row, and the distinct words of a batch by range."""

    def scan(batches):
        for part in slices(batches, 2000):
            if part.num_rows:
                words, at = hashed([(t or b"").translate(LOWER) for t in binary(part.column("text"))])
                found = np.unique(words)
                columns = (part.column(c).to_pylist() for c in ("doc_id", "chunk"))
                rows = [{"doc_id": d, "chunk": c, "n": int(n), "range": None, "words": None} for d, c, n in zip(*columns, np.diff(at), strict=True)]
                rows += [{"doc_id": None, "chunk": None, "n": None, "range": r, "words": pack_sorted(found[a:b])} for r, a, b in filled(found, ranges)]
                yield from _rows(rows, SURVEY).to_batches()

    return docs.mapInArrow(scan, SURVEY)


class Chunk:
    """Words and bigrams of a chunk's documents, in an order that only their rows decide.

    One stable sort of all hashes gives the distinct ones with their counts, each token's place among them, and, since
    documents follow one another, how often a token occurs in its own document.
    """

    def __init__(self, table, targets: set[int]):
        rows = merged(table.column("doc_id").to_pylist(), [(t or b"").translate(LOWER) for t in binary(table.column("text"))], table.column("copies").to_pylist())
        self.docs, texts, self.copies = [d for d, _, _ in rows], [t for _, t, _ in rows], np.array([n for _, _, n in rows], np.int64)
        words, self.starts = hashed(texts)
        del rows, texts
        self.is_target = np.array([d in targets for d in self.docs], bool)
        sizes = np.diff(self.starts)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        first = self.starts[:-1][sizes > 0]
        n = len(words)
        # words end in a set bit and bigrams in a clear one, so ranges can hold both
        every = np.empty(2 * n + len(first), U64)
        every[:n] = mixed(words) | ONE
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[first] = START
        every[n : 2 * n] = mixed(before * BASE + words) & ~ONE
        every[2 * n :] = START | ONE
        of = np.concatenate([owner, owner, owner[first]])
        del words, before
        order = np.argsort(every, kind="stable")
        every, of = every[order], of[order]
        starts, lengths = runs_of(every)
        #: distinct hashes, ascending, and how often they are here and in target documents
        self.hashes = every[starts]
        weight = self.copies[of]
        self.every = np.add.reduceat(weight, starts) if len(starts) else weight
        self.target = np.add.reduceat(weight * self.is_target[of], starts) if len(starts) else weight
        _, own = runs_of(every, of)
        place, mine = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(starts)), lengths)
        mine[order] = np.repeat(own, own)
        #: places of each token's word, of the word before it and of both, and their counts in the token's document
        context, own_context = np.empty(n, np.int64), np.empty(n, np.int64)
        context[1:], own_context[1:] = place[: n - 1], mine[: n - 1]
        context[first], own_context[first] = place[2 * n :], 1
        self.place = (place[:n], context, place[n : 2 * n])
        self.own = (mine[:n], own_context, mine[n : 2 * n])
        self.sizes, self.owner = sizes, owner


def losses(c_word, c_context, c_bigram, total: float, vocabulary: int, mu: float) -> np.ndarray:
    p = (c_word + 1.0) / (total + vocabulary)
    return -np.log((c_bigram + mu * p) / (c_context + mu))


def score(docs: DataFrame, labels: DataFrame, *, mu: float = MU) -> DataFrame:
    """docs (doc_id, text) and labels (doc_id, quality) -> RESULT without copies."""
    docs = store.columns(docs, "doc_id", "text")
    size = store.text_bytes(docs)
    chunks, ranges = store.parts(size, store.grown(CHUNK_BYTES, size)), store.parts(size / 9, store.grown(RANGE_HASHES, size))
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    dealt = collapsed(docs).withColumn("chunk", chunk)
    wanted = store.columns(labels, "doc_id", "quality").where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    found = store.written(survey(docs.withColumn("chunk", chunk), ranges), "survey")
    n_every = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    marks = found.where("doc_id IS NOT NULL").select("doc_id", "chunk", "n").join(wanted, "doc_id", "left_semi")
    n_target = marks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    marks = marks.select("doc_id", "chunk").distinct()

    def distinct(table):
        n = len(np.unique(np.concatenate([unpack_sorted(b) for b in table.column("words").to_pylist()])))
        return _rows([{"n": n}], "n long")

    vocabulary = store.dealt(found.where("range IS NOT NULL").select("range", "words"), ranges, "range").groupBy("range").applyInArrow(distinct, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    scale = n_target / n_every if n_every and n_target else 1.0

    def ask(key, left, right):
        one = Chunk(left, set(right.column("doc_id").to_pylist()))
        rows = []
        for r, a, b in filled(one.hashes, ranges):
            rows.append({"range": r, "chunk": key[0].as_py(), "hashes": pack_sorted(one.hashes[a:b]), "every": pack(one.every[a:b].astype(np.uint32)), "target": pack(one.target[a:b].astype(np.uint32))})
        return _rows(rows, ASK)

    def answer(key, table):
        hashes = [unpack_sorted(b) for b in table.column("hashes").to_pylist()]
        every = np.concatenate([unpack(b, np.uint32) for b in table.column("every").to_pylist()]).astype(np.int64)
        target = np.concatenate([unpack(b, np.uint32) for b in table.column("target").to_pylist()]).astype(np.int64)
        at, ends = np.concatenate(hashes), np.cumsum([len(h) for h in hashes])
        order = np.argsort(at, kind="stable")
        starts, n = runs_of(at[order])
        out = []
        for x in (every, target):
            total = np.empty_like(x)
            total[order] = np.repeat(np.add.reduceat(x[order], starts), n)
            out.append(np.split(total, ends[:-1]))
        return _rows([{"chunk": c, "range": key[0].as_py(), "every": pack(e), "target": pack(t)} for c, e, t in zip(table.column("chunk").to_pylist(), *out, strict=True)], ANSWER)

    def finish(left, right):
        ids = right.column("doc_id").to_pylist()
        one = Chunk(left, {d for d in ids if d is not None})
        rows = sorted((r, e, t) for d, r, e, t in zip(ids, *(right.column(c).to_pylist() for c in ("range", "every", "target")), strict=True) if d is None)
        every = np.concatenate([unpack(e, np.int64) for _, e, _ in rows]) if rows else np.zeros(0, np.int64)
        target = np.concatenate([unpack(t, np.int64) for _, _, t in rows]) if rows else every
        own_n = one.sizes[one.owner]
        mine = one.is_target[one.owner].astype(np.int64)
        t_loss = losses(*[target[a] - mine * o for a, o in zip(one.place, one.own, strict=True)], n_target - mine * own_n, vocabulary, mu)
        b_loss = losses(*[scale * (every[a] - o) for a, o in zip(one.place, one.own, strict=True)], scale * (n_every - own_n), vocabulary, mu)
        sums = [np.bincount(one.owner, weights=x, minlength=len(one.docs)) for x in (t_loss, b_loss)]
        out = []
        for i, (d, n) in enumerate(zip(one.docs, one.sizes.tolist(), strict=True)):
            t, g = (round(float(x[i]) / n, 6) if n else None for x in sums)
            out.append({"doc_id": d, "n_tokens": n, "is_target": bool(one.is_target[i]), "target_loss": t, "background_loss": g, "score": None if t is None else round(t - g, 6), "copies": int(one.copies[i])})
        import pyarrow as pa

        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.float64(), pa.float64(), pa.int32())
        return pa.Table.from_pylist(out, schema=pa.schema([(f.split()[0], k) for f, k in zip(RESULT.split(", "), kinds, strict=True)]))

    of_chunk = lambda df: store.dealt(df, chunks, "chunk").groupBy("chunk")
    texts = of_chunk(dealt)
    asked = store.dealt(texts.cogroup(of_chunk(marks)).applyInArrow(ask, ASK), ranges, "range")
    answers = asked.groupBy("range").applyInArrow(answer, ANSWER)
    known = answers.withColumn("doc_id", F.lit(None).cast("long")).unionByName(marks.withColumns({"range": F.lit(None).cast("int"), "every": F.lit(None).cast("binary"), "target": F.lit(None).cast("binary")}))
    out = texts.cogroup(of_chunk(known)).applyInArrow(finish, RESULT)
    return out.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copies")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, labels)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) THEN 1 ELSE 0 END AS t FROM documents),
w AS (SELECT r, t, len(ws) AS own, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM d),
b AS (SELECT r, t, own, x, coalesce(lag(x) OVER (PARTITION BY r ORDER BY i), '') AS h FROM w),
cw AS (SELECT x, count(*) AS n, sum(t) AS k FROM b GROUP BY x UNION ALL SELECT '', count(*), sum(t) FROM d WHERE len(ws) > 0),
cb AS (SELECT h, x, count(*) AS n, sum(t) AS k FROM b GROUP BY h, x),
ow AS (SELECT r, x, count(*) AS n FROM b GROUP BY r, x UNION ALL SELECT r, '', 1 FROM d WHERE len(ws) > 0),
ob AS (SELECT r, h, x, count(*) AS n FROM b GROUP BY r, h, x),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(coalesce(sum(t), 0) AS DOUBLE) AS k, CAST(count(DISTINCT x) AS DOUBLE) AS v, CASE WHEN coalesce(sum(t), 0) > 0 THEN CAST(sum(t) AS DOUBLE) / count(*) ELSE 1.0::DOUBLE END AS scale FROM b),
c AS (SELECT b.r, b.t, b.own, s.*, cw.k - b.t * ow.n AS tw, ch.k - b.t * oh.n AS th, cb.k - b.t * ob.n AS tb, s.scale * (cw.n - ow.n) AS bw, s.scale * (ch.n - oh.n) AS bh, s.scale * (cb.n - ob.n) AS bb
      FROM b CROSS JOIN s JOIN cw ON cw.x = b.x JOIN cw ch ON ch.x = b.h JOIN cb ON cb.h = b.h AND cb.x = b.x JOIN ow ON ow.r = b.r AND ow.x = b.x JOIN ow oh ON oh.r = b.r AND oh.x = b.h JOIN ob ON ob.r = b.r AND ob.h = b.h AND ob.x = b.x),
l AS (SELECT r, sum(-ln((tb + 4.0::DOUBLE * (tw + 1) / (k - t * own + v)) / (th + 4.0::DOUBLE))) / any_value(own) AS tl, sum(-ln((bb + 4.0::DOUBLE * (bw + 1) / (scale * (n - own) + v)) / (bh + 4.0::DOUBLE))) / any_value(own) AS bl FROM c GROUP BY r)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_tokens, d.t = 1 AS is_target, round(tl, 6) AS target_loss, round(bl, 6) AS background_loss, round(round(tl, 6) - round(bl, 6), 6) AS score
FROM d LEFT JOIN l ON l.r = d.r
"""
