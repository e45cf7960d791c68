"""Personal data by anchor expansion: an Aho-Corasick automaton finds at-signs, schemes and identifier cues, and local
parsers expand each hit to the left and right and check it.

Kinds: email, ip, card, phone (the base), then url (scheme or www.), account (an IBAN with a right checksum, or a number of
6 to 20 digits and letters after a cue word) and secret (what a password or token cue assigns, or a key of a known form).
Schemes and cues count in upper and lower case alike. Spans of one kind never overlap; offsets are code points.

Defined cases: null and empty texts have no span; a text of any length is scanned whole; rows that repeat are scanned
each; a null doc_id stays null; an empty table gives an empty result; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame

from . import store

KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL, DOMAIN, PHONE = ALNUM | frozenset("._%+-"), ALNUM | {"-"}, DIGITS | frozenset(" ().-")
SCHEMES = ("http://", "https://", "ftp://", "www.")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UPPER, LOWER)
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "passport", "customer id", "ssn")
URL = re.compile(r"[^\s<>\"'`{}|\\^\[\]]+")
AFTER_CUE = re.compile(r"(?i)\s*(?:number|no\.?|nr\.?|num\.?|id)?\s*[:#=]?\s*([A-Z0-9](?:[ -]?[A-Z0-9]){5,33})")
ASSIGNED = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "api-key", "apikey", "api key", "access key", "access_key", "private_key")
#: What an assignment gives: quoted, or a run of at least 8 key letters; either holds a digit.
VALUE = re.compile(r"[\"']?\s*(?:=>|:=|=|:)\s*(?:\"([^\"\r\n]{8,200})\"|'([^'\r\n]{8,200})'|([A-Za-z0-9_+/.~-]{8,200}={0,2}))")
#: Forms of keys that name themselves: the text that begins them and the whole key.
KEYS = {"akia": r"AKIA[A-Z0-9]{16}", "asia": r"ASIA[A-Z0-9]{16}", "ghp_": r"ghp_[A-Za-z0-9]{36}", "aiza": r"AIza[A-Za-z0-9_-]{35}", "xoxb-": r"xoxb-[A-Za-z0-9-]{20,}", "sk_live_": r"sk_live_[A-Za-z0-9]{16,}"}
KEY = re.compile("|".join(f"(?:{k})" for k in KEYS.values()))
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")


def automaton() -> ahocorasick.Automaton:
    """Each pattern tells which parser to call and how far left of the hit's end it begins."""
    found = ahocorasick.Automaton()
    add = lambda s, kind: found.add_word(s, (kind, len(s)))
    add("@", "email")
    for d in DIGITS:
        add("+" + d, "phone")
        add(d + ".", "ip")
        for e in DIGITS:
            for sep in ("", " ", "-"):
                add(d + sep + e, "card")
    for kind, words in (("url", SCHEMES), ("account", CUES), ("secret", ASSIGNED), ("secret", KEYS)):
        for s in words:
            add(s, kind)
    found.make_automaton()
    return found


def folded(text: str) -> str:
    """text with A-Z in lower case and as many code points."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(FOLD)


def secret_at(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The key that begins at `start`, or what is assigned after a cue that ends at `end`."""
    if m := KEY.match(text, start):
        return m.span() if m.end() == len(text) or text[m.end()] not in ALNUM else None
    m = VALUE.match(text, end)
    if not m or end < len(text) and text[end] in ALNUM:
        return None
    a, b = m.span(m.lastindex)
    while b > a and m.lastindex == 3 and text[b - 1] in ".-":
        b -= 1
    return (a, b) if b - a >= 8 and any(c in DIGITS for c in text[a:b]) else None


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign, not reaching left of floor."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end, labels, n = at + 1, 0, len(text)
    while True:
        stop = end
        while stop < n and text[stop] in DOMAIN:
            stop += 1
        if stop == end:
            end -= 1  # the dot before an empty label is not part
            break
        labels, end = labels + 1, stop
        if end < n and text[end] == ".":
            end += 1
        else:
            break
    return (start, end) if start < at and labels >= 2 else None


def ips_from(text: str, start: int) -> tuple[list[tuple[int, int]], int]:
    """All quads of the chain of dotted numbers whose first number holds `start`; where the chain ends."""
    n = len(text)
    while start and text[start - 1] in DIGITS:
        start -= 1
    labels, at = [], start
    while at < n and text[at] in DIGITS:
        stop = at
        while stop < n and text[stop] in DIGITS:
            stop += 1
        labels.append((at, stop))
        if stop + 1 < n and text[stop] == "." and text[stop + 1] in DIGITS:
            at = stop + 1
        else:
            break
    out = []
    for k in range(0, len(labels) - 3, 4):
        quad = labels[k : k + 4]
        if all(b - a <= 3 or not text[a : b - 3].strip("0") for a, b in quad) and all(int(text[max(a, b - 3) : b]) <= 255 for a, b in quad):
            out.append((quad[0][0], quad[3][1]))
    return out, labels[-1][1]


def card_from(text: str, start: int) -> tuple[int, int]:
    """The chain of digits with single blanks or hyphens between that holds `start`, which is its first digit."""
    n, end = len(text), start + 1
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return start, end


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def phone_at(text: str, plus: int) -> tuple[int, int] | None:
    """From a plus and a digit to the last digit of the run that follows."""
    n, at, last = len(text), plus + 2, -1
    while at < n and text[at] in PHONE:
        if text[at] in DIGITS and at > plus + 2:
            last = at
        at += 1
    return (plus, last + 1) if last > 0 else None


def iban(text: str) -> bool:
    s = text.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def account_after(text: str, at: int) -> tuple[int, int] | None:
    """The identifier after a cue that ends at `at`: an IBAN, or at least 6 digits within 20 letters and digits."""
    m = AFTER_CUE.match(text, at, min(len(text), at + 80))
    if not m:
        return None
    found = IBAN.match(text, m.start(1))
    while found and found.end() > found.start():
        if iban(found[0]):
            return found.span()
        shorter = text[found.start() : found.end() - 1].rstrip()
        found = IBAN.fullmatch(shorter) and IBAN.match(text, found.start(), found.start() + len(shorter))
    token = re.match(r"[A-Za-z0-9]+(?:[ -][0-9]+)*", m[1])
    if token and 6 <= sum(c in DIGITS for c in token[0]) and sum(c in ALNUM for c in token[0]) <= 20:
        return m.start(1), m.start(1) + token.end()
    return None


def spans(text: str, found: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    seen = dict.fromkeys(KINDS, 0)  # each kind's scan has come so far
    for last, (kind, length) in found.iter(folded(text)):
        start = last - length + 1
        if start < seen[kind]:
            continue
        if kind == "email":
            if hit := email_at(text, start, seen[kind]):
                out[kind].append(hit)
                seen[kind] = hit[1]
        elif kind == "ip":
            quads, seen[kind] = ips_from(text, start)
            out[kind] += quads
        elif kind == "card":
            hit = card_from(text, start)
            seen[kind] = hit[1]
            digits = text[hit[0] : hit[1]].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out[kind].append(hit)
        elif kind == "phone":
            if hit := phone_at(text, start):
                seen[kind] = hit[1]
                if 8 <= sum(c in DIGITS for c in text[hit[0] : hit[1]]) <= 15:
                    out[kind].append(hit)
        elif kind == "url":
            m = (start == 0 or text[start - 1] not in ALNUM) and URL.match(text, last + 1)
            if m and (end := start + len(text[start : m.end()].rstrip(".,;:!?)"))) > last + 1:
                out[kind].append((start, end))
                seen[kind] = end
        elif kind == "secret":
            if (start == 0 or text[start - 1] not in ALNUM) and (hit := secret_at(text, start, last + 1)):
                out[kind].append(hit)
                seen[kind] = hit[1]
        elif (start == 0 or text[start - 1] not in ALNUM) and (last + 1 == len(text) or text[last + 1] not in ALNUM) and (hit := account_after(text, last + 1)):
            out[kind].append(hit)
            seen[kind] = hit[1]
    return out


def mask(text: str, found: ahocorasick.Automaton) -> str:
    """text with every span replaced by its kind in angle brackets; the first kind wins where kinds overlap."""
    every = sorted((a, KINDS.index(k), b, k) for k, v in spans(text, found).items() for a, b in v)
    out, at = [], 0
    for a, _, b, kind in every:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
    return "".join([*out, text[at:]])


def listed(hits: dict[str, list[tuple[int, int]]], kinds) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in sorted(hits[k]))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def find(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> a row each with counts of the base kinds, a digest of their spans, all spans and their number."""

    def scan(batches):
        import pyarrow as pa

        from .words import slices

        found = automaton()
        for batch in slices(batches):
            rows = [spans(t or "", found) for t in batch.column("text").to_pylist()]
            counts = [pa.array([len(r[k]) for r in rows], pa.int64()) for k in KINDS[:4]]
            digests = [hashlib.sha256(listed(r, KINDS[:4]).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([listed(r, KINDS) for r in rows], pa.string()), pa.array([sum(map(len, r.values())) for r in rows], pa.int64())], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return store.columns(docs, "doc_id", "text").mapInArrow(scan, SCHEMA)
