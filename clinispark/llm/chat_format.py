r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, each turn as <|turn|>role<|text|>text<|end|>, and encoded once with character offsets; the
spans of the trained turns and those of the tokens both ascend, so a binary search tells which tokens lie in the loss. The
three marks are tokens of their own. In roles and texts a backslash becomes two and <| becomes <\|, which can be undone, so
no text can hold a mark, of ours or of the vocabulary's.

Turns are dealt by ranges of (conv_id, turn), so a conversation of any length spreads over tasks. A conversation beyond
SEGMENT characters, or one that lies across the border of two ranges, comes as several rows in order, cut between turns, at
which tokens end anyway. A text beyond PIECE characters is encoded in pieces, cut before a single blank between two words,
where the vocabulary's rule cuts too.

Defined cases: null texts and roles are empty ones; an empty text has no token in the loss; turns are in order of turn, null
ones first, ties by role and text; rows that repeat are turns like others; rows without conv_id are one conversation; an
empty table gives an empty result; texts of any length are encoded whole; columns beside conv_id, turn, role and text are
ignored whatever their names. Reading the loss back character by character needs a vocabulary that drops none, as the byte
vocabularies are.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .words import lean, trim

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Characters of one row, of one call of the tokenizer's batch, and of one piece it gets.
SEGMENT, CALL, PIECE = 1 << 18, 1 << 20, 1 << 16
#: Bytes of texts that a task renders.
TASK_BYTES = 32 << 20
VOCABULARY = "byte_bpe_50k.json"
_between = re.compile(r"(?<=\S) (?=\S)")
_escaped = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


@functools.cache
def tokenizer(path: str):
    """The vocabulary of that file with the marks added; once a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    found.add_tokens([AddedToken(m, special=False, normalized=False) for m in (TURN, TEXT, END)])
    return found


def pieces(text: str) -> list[tuple[int, str]]:
    """The text in parts of about PIECE characters with their places."""
    out, at = [], 0
    while len(text) - at > PIECE and (m := _between.search(text, at + PIECE)):
        out.append((at, text[at : m.start()]))
        at = m.start()
    return [*out, (at, text[at:])]


def encoded(texts: list[str], path: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and offsets (n, 2) of each text."""
    cut = [(i, at, part) for i, text in enumerate(texts) for at, part in pieces(text)]
    out: list[list] = [[] for _ in texts]
    for (i, at, _), e in zip(cut, tokenizer(path).encode_batch([p for _, _, p in cut], add_special_tokens=False), strict=True):
        out[i].append((np.array(e.ids, np.int32), np.array(e.offsets, np.int32).reshape(-1, 2) + np.int32(at)))
    return [tuple(np.concatenate(x) for x in zip(*parts, strict=True)) for parts in out]


def under(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens share a character with one of the ascending, disjoint spans (n, 2)."""
    spans = spans[spans[:, 0] < spans[:, 1]]
    if not len(spans):
        return np.zeros(len(offsets), bool)
    first = np.searchsorted(spans[:, 1], offsets[:, 0], side="right")
    return (first < len(spans)) & (spans[np.minimum(first, len(spans) - 1), 0] < offsets[:, 1])


class Rendered:
    """A growing row: the text so far and the spans of its trained turns."""

    def __init__(self, conv_id):
        self.conv_id, self.parts, self.spans, self.chars, self.turns = conv_id, [], [], 0, 0

    def add(self, role: str, text: str, train) -> None:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role in train:
            self.spans.append((self.chars + len(head), self.chars + len(head) + len(body)))
        self.parts += [head, body, END]
        self.chars += len(head) + len(body) + len(END)
        self.turns += 1


def rendered(batches, train):
    """(row, whether it is its conversation's only one) of turns in order; those of the task's first and last conversation may not be."""
    held, edge, cut = None, True, False
    for batch in batches:
        for conv_id, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True):
            if held is not None and held.conv_id != conv_id:
                yield held, not (edge or cut)
                held, edge, cut = None, False, False
            elif held is not None and held.chars >= SEGMENT:
                yield held, False
                held, cut = None, True
            if held is None:
                held = Rendered(conv_id)
            held.add(role, text, train)
    if held is not None:
        yield held, False


def format_turns(turns: DataFrame, *, vocabulary: str | None = None, train: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """turns (conv_id, turn, role, text) -> conv_id, segment, whole, n_turns, formatted, ids, starts, ends, loss_mask.

    Rows of a conversation are in the order of segment; whole tells that there is no other. starts and ends are the tokens'
    places in formatted, in code points; loss_mask holds for tokens that lie in texts of the trained roles.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    n = max(store.parts(store.text_bytes(rows), TASK_BYTES), store.partitions(turns.sparkSession))
    rows = rows.repartitionByRange(n, "conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        lean()
        segment, held, size = TaskContext.get().partitionId() << 33, [], 0

        def out():
            texts = ["".join(r.parts) for r, _ in held]
            found = encoded(texts, vocabulary)
            ends = pa.array(np.cumsum([0, *[len(i) for i, _ in found]]), pa.int32())
            ids, offsets = (np.concatenate(x) for x in zip(*found, strict=True))
            mask = np.concatenate([under(o, np.array(r.spans, np.int64).reshape(-1, 2)) for (r, _), (_, o) in zip(held, found, strict=True)])
            arrays = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids, offsets[:, 0], offsets[:, 1], mask)]
            keys = [pa.array([r.conv_id for r, _ in held], batch_kind), pa.array(range(segment, segment + len(held)), pa.int64()), pa.array([w for _, w in held])]
            return pa.RecordBatch.from_arrays([*keys, pa.array([r.turns for r, _ in held], pa.int64()), pa.array(texts), *arrays], names=names)

        for row, whole in rendered(batches, train):
            held.append((row, whole))
            size += row.chars
            if size >= CALL:
                yield out()
                segment, held, size = segment + len(held), [], 0
        if held:
            yield out()
        trim()

    from pyspark.sql.pandas.types import to_arrow_type

    batch_kind = to_arrow_type(turns.schema["conv_id"].dataType)
    names = ["conv_id", "segment", "whole", "n_turns", "formatted", "ids", "starts", "ends", "loss_mask"]
    return rows.select("conv_id", "role", "text").mapInArrow(
        work, f"conv_id {kind}, segment bigint, whole boolean, n_turns bigint, formatted string, ids array<int>, starts array<int>, ends array<int>, loss_mask array<boolean>"
    )


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted row."""
    found = [part.partition(TEXT) for part in formatted.split(TURN)[1:]]
    return [(unescape(role), unescape(text.removesuffix(END))) for role, _, text in found]


def loss_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """What the tokens under the mask say: the text of each run of them, unescaped, one after another."""
    edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return "".join(unescape(formatted[starts[a] : ends[b - 1]]) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _opened(batches):
    """(conv_id, number of turns, their bytes, text under the mask, characters) of each formatted row."""
    for batch in batches:
        flat = {c: batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("starts", "ends", "loss_mask")}
        at = batch.column("ids").value_lengths().to_numpy().cumsum()
        for i, (conv_id, text) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True)):
            a, b = int(at[i - 1]) if i else 0, int(at[i])
            turns = turns_of(text)
            content = "".join(f"{role}\n{said}\n" for role, said in turns)
            yield conv_id, len(turns), content.encode(), loss_text(text, *(flat[c][a:b] for c in ("starts", "ends", "loss_mask"))), len(text)


DIGEST = "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
OPENED = "n_turns bigint, content binary, loss string, chars bigint"


def read_back(formatted: DataFrame) -> DataFrame:
    """Rows of format_turns -> conv_id and DIGEST of what they hold.

    Conversations of several rows are opened where they lie; their contents meet in order and are digested as they come by,
    none held whole.
    """
    kind = f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}"
    columns = ("conv_id", "segment", "whole", "formatted", "ids", "starts", "ends", "loss_mask")
    rows = formatted.select(*columns)

    def several(batches):
        import pyarrow as pa

        for batch in batches:
            found = list(_opened([batch]))
            if found:
                conv, n, content, loss, chars = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(content), pa.array(loss), pa.array(chars, pa.int64()), batch.column("segment")], names=["conv_id", "n_turns", "content", "loss", "chars", "segment"])

    def met(batches):
        import pyarrow as pa

        held, kept = None, []
        for batch in batches:
            for conv_id, n, content, loss, chars in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "n_turns", "content", "loss", "chars")], strict=True):
                if held is None or held[0] != conv_id:
                    kept += [held] if held else []
                    held = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                held[1] += n
                held[2].update(content)
                held[3] += len(loss)
                held[4].update(loss.encode())
                held[5] += chars
            yield _digests(kept, batch.schema.field("conv_id").type)
            kept = []
        if held:
            yield _digests([held], batch.schema.field("conv_id").type)

    def one(batches):
        for batch in batches:
            found = [[c, n, hashlib.sha256(t), len(x), hashlib.sha256(x.encode()), m] for c, n, t, x, m in _opened([batch])]
            yield _digests(found, batch.schema.field("conv_id").type)

    cut = rows.where(~F.col("whole")).mapInArrow(several, f"{kind}, {OPENED}, segment bigint")
    cut = cut.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(met, f"{kind}, {DIGEST}")
    return rows.where("whole").mapInArrow(one, f"{kind}, {DIGEST}").unionByName(cut)


def _digests(found: list, kind):
    import pyarrow as pa

    columns = list(zip(*found, strict=True)) if found else [()] * 6
    hexed = lambda xs: pa.array([x.hexdigest() for x in xs], pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), hexed(columns[2]), pa.array(columns[3], pa.int64()), hexed(columns[4]), pa.array(columns[5], pa.int64())],
        names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    )


#: A conversation whose texts look like marks and escapes: id, and what both its turns say.
TRICKY = -7, r"\### Assistant: </turn> ok"


def query(turns: DataFrame) -> DataFrame:
    names = "conv_id bigint, turn bigint, role string, text string"
    own = store.table(turns.sparkSession, [(TRICKY[0], i, role, TRICKY[1]) for i, role in enumerate(("user", "assistant"))], names)
    return read_back(store.written(format_turns(store.columns(turns, "conv_id", "turn", "role", "text").unionByName(own)), "chats"))


SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES ({TRICKY[0]}, 0, 'user', '{TRICKY[1]}'), ({TRICKY[0]}, 1, 'assistant', '{TRICKY[1]}')),
e AS (SELECT *, length(replace(replace(role || text, '\', '\\'), '<|', '<\|')) - length(role || text)
             - CASE WHEN right(role, 1) = '<' AND left(text, 1) = '|' THEN 1 ELSE 0 END + length(role) + length(text) + {len(TURN + TEXT + END)} AS chars FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
