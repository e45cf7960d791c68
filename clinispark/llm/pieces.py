"""Token ids of whole texts for a word-end BPE vocabulary that lower-cases and drops white space.

Such a vocabulary cuts a text into pieces before any merge: runs of letters, single digits, runs of other signs. All pieces
of a block of texts are cut, hashed twice and looked up together in NumPy; only pieces that the table lacks go through the
merges, many in one call. Words with anything but ASCII and letters of U+00C0-U+00FF, with an apostrophe before a letter or
with `<|` are whole pieces of their own and go through the full tokenizer. The table has a fixed number of places, where a
new piece drives out an old one, so memory is bounded whatever the corpus.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .words import BLANK, U64, blocks, hash_runs, lean

#: The settings under which pieces are cut as here.
NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
END = "</w>"
#: Places of the table, and ids that a place holds; longer pieces are merged anew in each block.
PLACES, INLINE = 1 << 19, 8
HARD = U64(0xA0761D6478BD642F)
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    out[33:127] = _SIGN
    out[BLANK] = _SPACE
    out[48:58] = _DIGIT
    out[65:91] = out[97:123] = _LETTER
    return out


def _lower() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


CLASS, LOW = _classes(), _lower()


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be printed, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Ids:
    """Ids of texts by one vocabulary file, with a table of pieces."""

    def __init__(self, path: str, places: int = PLACES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        lean()
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        same = held["normalizer"] == NORMAL and held["pre_tokenizer"] == SPLIT and model["type"] == "BPE" and model.get("end_of_word_suffix") == END
        same = same and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("ignore_merges")
        #: Whether texts can be cut into pieces; else each whole text goes through the tokenizer.
        self.cuts = same and max(model["vocab"].values()) < 1 << 16 and all("<|" in t["content"] for t in held["added_tokens"])
        if not self.cuts:
            return
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = dict(enumerate(_byte_letters()))
        self.last = np.zeros(1 << 16, bool)
        self.last[[i for t, i in model["vocab"].items() if t.endswith(END)]] = True
        self.mask = U64(places - 1)
        self.key, self.check = np.zeros(places, U64), np.zeros(places, U64)
        self.count, self.ids = np.zeros(places, np.uint8), np.zeros((places, INLINE), np.uint16)

    def _merged(self, easy: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and how many each has."""
        text = [p.decode("latin-1").translate(self.letters) for p in easy]
        found = self.merges.encode_batch_fast([" ".join(text[i : i + 400]) for i in range(0, len(text), 400)], add_special_tokens=False)
        ids = np.array([i for e in found for i in e.ids], np.uint16)
        return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)

    def _learn(self, buf: bytes, starts: np.ndarray, ends: np.ndarray, hard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pieces of buf: all their ids, where each begins, and how many each has."""
        spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
        easy = np.flatnonzero(~hard)
        ids, counts = self._merged([buf[a:b] for a, b in (spans[i] for i in easy)])
        count = np.zeros(len(spans), np.int64)
        count[easy] = counts
        rest = np.flatnonzero(hard)
        found = self.whole.encode_batch_fast([buf[a:b].decode() for a, b in (spans[i] for i in rest)], add_special_tokens=False)
        count[rest] = [len(e.ids) for e in found]
        start = np.zeros(len(spans), np.int64)
        start[easy] = np.cumsum(counts) - counts
        start[rest] = len(ids) + np.cumsum(count[rest]) - count[rest]
        return np.concatenate([ids, np.array([i for e in found for i in e.ids], np.uint16)]), start, count

    def _cut(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes in lower case but for hard words, and each piece's start, end and whether it is a hard word."""
        kind, buf = CLASS[data], LOW[data]
        lead = np.flatnonzero(data == 0xC3)
        if len(lead):
            lead = lead[lead + 1 < len(data)]
            after = data[lead + 1]
            ok = (after >= 0x80) & (after != 0x97) & (after != 0xB7)
            lead, after = lead[ok], after[ok]
            kind[lead] = kind[lead + 1] = _LETTER
            buf[lead + 1] = after + np.where(after < 0x9F, 32, 0).astype(np.uint8)
        odd = kind == _OTHER
        mark = np.flatnonzero((data[:-1] == 39) & (kind[1:] == _LETTER) | (data[:-1] == 60) & (data[1:] == 124))
        odd[mark] = True
        hard = np.zeros(0, np.int64)
        if odd.any():
            edge = np.flatnonzero(np.diff(kind != _SPACE, prepend=False, append=False))
            a, b = edge[::2], edge[1::2]
            total = np.concatenate([[0], np.cumsum(odd)])
            is_hard = total[b] > total[a]
            hard, stop = a[is_hard], b[is_hard]
            inside = np.zeros(len(data) + 1, np.int8)
            inside[hard], inside[stop] = 1, -1
            inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
            buf[inside] = data[inside]
            kind[inside] = _OTHER
        new = np.ones(len(data), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(data))
        full = kind[at] != _SPACE
        at, end = at[full], end[full]
        return buf, at, end, kind[at] == _OTHER

    def _block(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a block, and the start and number of ids of each piece."""
        buf, start, end, hard = self._cut(data)
        key, check = hash_runs(buf, start, end), hash_runs(buf, start, end, True)
        key[hard] ^= HARD
        first = (key & self.mask).astype(np.int64)
        second = ((key >> U64(32)) & self.mask).astype(np.int64)
        hit = [(self.key[p] == key) & (self.check[p] == check) & (self.count[p] > 0) for p in (first, second)]
        place, known = np.where(hit[0], first, second), hit[0] | hit[1]
        count = np.where(known, self.count[place], 0).astype(np.int64)
        lack = np.flatnonzero(~known)
        if len(lack):
            order = lack[np.lexsort((check[lack], key[lack]))]
            new = np.ones(len(order), bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
            one, nth = order[new], np.cumsum(new) - 1
            ids, at, n = self._learn(buf.tobytes(), start[one], end[one], hard[one])
            count[order] = n[nth]
            source = np.zeros(len(key), np.int64)
            source[order] = at[nth]
        out = np.empty(int(count.sum()), np.uint16)
        to = np.repeat(known, count)
        old = self.ids[place[known]]
        out[to] = old[np.arange(INLINE) < count[known][:, None]]
        if len(lack):
            n_lack, from_ = count[lack], source[lack]
            step = np.arange(int(n_lack.sum())) - np.repeat(np.cumsum(n_lack) - n_lack, n_lack)
            out[~to] = ids[np.repeat(from_, n_lack) + step]
            self._keep(key[one], check[one], ids, at, n)
        return out, start, count

    def _keep(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        """Puts short pieces into their first place; what was there moves on to its own second place."""
        short = (n <= INLINE) & (n > 0)
        key, check, at, n = key[short], check[short], at[short], n[short]
        p = (key & self.mask).astype(np.int64)
        p, only = np.unique(p, return_index=True)
        key, check, at, n = key[only], check[only], at[only], n[only]
        back = ((self.key[p] >> U64(32)) & self.mask).astype(np.int64)
        moving = self.count[p] > 0
        for held in (self.key, self.check, self.count, self.ids):
            held[back[moving]] = held[p[moving]]
        self.key[p], self.check[p], self.count[p] = key, check, n
        where = np.minimum(at[:, None] + np.arange(INLINE), len(ids) - 1)
        self.ids[p] = ids[where]

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each whole text."""
        if not self.cuts:
            return [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for numbers, held in blocks(texts):
            ids, start, count = self._block(np.frombuffer(b"\n".join(held), np.uint8))
            first = np.concatenate([[0], np.cumsum([len(h) + 1 for h in held])])
            upto = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, first)]
            for i, a, b in zip(numbers, upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                parts[i].append(ids[a:b])
        return [p[0] if len(p) == 1 else np.concatenate(p) for p in parts]
