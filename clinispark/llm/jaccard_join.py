"""Jaccard join on word shingles with token-combination prefixes.

Tokens are hashes of shingles, ordered by document frequency. Equal sets are one set from the start. Two different sets of
similarity t or more share more than G tokens in their prefixes extended by G. A token held by no other set needs no
index; a rare token in the extended prefix is indexed alone; frequent tokens are dealt to G classes by hash and indexed
as pairs within a class, since of more than G shared frequent tokens two share a class. G depends on the size class of
the larger set; a set near the border of its class is indexed for the next one too.

Sets that meet under an index key, in the prefixes that follow from both their sizes, are compared there at once, by the parities of their tokens' hashes in as many bits as
they have tokens: where two differ in more bits than similar sets may differ in tokens, they are apart for certain. So the
pairs that stay are almost all links, and what stands beside each other in a corpus of templates does not become one block.
(Bits stop at 2048: of sets beyond some 4,600 tokens all that meet stay.) Under a key that many sets share, a set is
compared with those that no earlier one has reached.

Components of the pairs that stay are blocks, which are verified exactly: only tokens held by two sets or more can overlap,
so a block brings just these. In a block all pairs of compatible sizes are counted at once, tokens that many sets hold by a
matrix product and the others by their postings; what leaves is each set's number of links and a spanning forest, never a
pair list. A block beyond BLOCK_WEIGHT is cut into tiles that meet two by two, each pair counted in one cell: the work is the
square of a family of near copies, whose links are as many.

A set is known by 96 bits of two independent hashes and its size.

Defined cases: null or empty texts have no shingle, are linked with nothing and are their own component; texts with fewer
words than a shingle have one shingle of all their words; rows that repeat are equal sets and linked; a component's id is
the smallest doc_id in it, null only where all are null; an empty table gives an empty result; texts are read whole;
columns beside doc_id and text are ignored, and `stage` keeps them whatever their names.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .components import components
from .exchange import filled, narrow, pack, pack_sorted, unpack, unpack_sorted
from .substring_dedup import _rows, runs_of
from .words import BASE, EMPTY, LOWER, U64, binary, hashed, mixed, slices, windows

WIDTH, PERCENT, RARE = 5, 80, 16
CHUNK_BYTES, RANGE_TOKENS = 6_000_000, 1_800_000
#: Weight of a block that is verified in one piece: tokens, and SET_WEIGHT for each set.
BLOCK_WEIGHT, SET_WEIGHT = 1_500_000, 256
#: The seed with which Spark's xxhash64 begins.
TEXT_SEED = 42
SLIM = "doc_id long, n long, key long, check long, text_hash long"
BLOB = "range int, tokens binary, owner binary, keys binary, checks binary, sizes binary, df binary, maps binary, lone binary"
CANDIDATE = "key long, check long, n long, posts long, tokens binary, ikeys binary, places binary"
#: Words of 64 parities that a set has at most; words compared at a time; sets under a key of which all pairs are listed.
WORDS, AT_ONCE, LISTED = 32, 4_000_000, 64


def token_set(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    n = len(words)
    if not n:
        return EMPTY
    if n < width:
        return windows(words, n) ^ U64(n)
    return np.unique(windows(words, width))


def sets_of(texts: list[bytes | None], width: int = WIDTH) -> list[np.ndarray]:
    words, at = hashed([(t or b"").translate(LOWER) for t in texts])
    return [token_set(words[at[i] : at[i + 1]], width) for i in range(len(texts))]


def set_keys(tokens: np.ndarray) -> tuple[int, int]:
    """A signed 64-bit hash of a set and 32 bits of another."""
    raw = tokens.tobytes()
    return int(np.uint64(xxhash.xxh3_64_intdigest(raw, 0)).astype(np.int64)), xxhash.xxh3_64_intdigest(raw, 1) >> 32


def chunked(batches, size: int = CHUNK_BYTES):
    """(ids, texts) of about `size` bytes each."""
    ids, texts, held = [], [], 0
    for part in slices(batches, 512):
        if part.num_rows:
            new = [t or b"" for t in binary(part.column("text"))]
            ids += part.column("doc_id").to_pylist()
            texts += new
            held += sum(map(len, new))
            if held >= size:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def groups(n: int) -> int:
    """G of the size class of n: a power of two that grows with the class."""
    return max(1, (1 << (n.bit_length() - 1)) // 32)


def _blobs(tokens: np.ndarray, owner: np.ndarray, keys: np.ndarray, checks: np.ndarray | None, sizes: np.ndarray, ranges: int, df: np.ndarray | None = None, by: np.ndarray | None = None, maps: list | None = None, lone: np.ndarray | None = None) -> list[dict]:
    """One row per range of tokens, or of `by` where given; arrays ascend by it. keys, checks, sizes, maps and lone are by owner."""
    out = []
    for r, a, b in filled(tokens if by is None else by, ranges):
        used, local = np.unique(owner[a:b], return_inverse=True)
        t = tokens[a:b]
        row = {"range": r, "tokens": pack_sorted(t) if by is None else pack(t), "owner": pack(narrow(local)), "keys": pack(keys[used]), "checks": None if checks is None else pack(checks[used].astype(np.uint32)), "sizes": pack(sizes[used].astype(np.uint32))}
        row |= {"df": None if df is None else pack(df[a:b].astype(np.uint32)), "maps": None if maps is None else np.concatenate([maps[i] for i in used]).tobytes()}
        out.append(row | {"lone": None if lone is None else pack(lone[used].astype(np.uint32))})
    return out


class Opened:
    """A range's rows, one after another: tokens and df, each token's owner, and keys, checks, sizes, maps and lone tokens of the owners."""

    def __init__(self, table, ascending: bool = True):
        tokens, owner, keys, checks, sizes, df, maps, lone = [table.column(c).to_pylist() for c in ("tokens", "owner", "keys", "checks", "sizes", "df", "maps", "lone")]
        parts = [unpack_sorted(t) if ascending else unpack(t, U64) for t in tokens]
        self.keys = np.concatenate([unpack(x, U64) for x in keys])
        self.checks = None if checks[0] is None else np.concatenate([unpack(x, np.uint32) for x in checks])
        each = [unpack(x, np.uint32) for x in sizes]
        self.sizes, first = np.concatenate(each).astype(np.int64), np.cumsum([0, *map(len, each)])
        self.own = np.concatenate([unpack(o, np.uint16 if len(unpack(o, np.uint8)) == 2 * len(t) else np.uint32).astype(np.uint32) + np.uint32(f) for o, t, f in zip(owner, parts, first[:-1], strict=True)])
        self.tokens = np.concatenate(parts)
        self.df = None if df[0] is None else np.concatenate([unpack(d, np.uint32) for d in df])
        self.maps = None if maps[0] is None else np.concatenate([np.frombuffer(m, U64) for m in maps])
        self.lone = None if lone[0] is None else np.concatenate([unpack(v, np.uint32) for v in lone]).astype(np.int64)

    def same(self) -> np.ndarray:
        """A number for each owner; owners that are one set have one."""
        order = np.lexsort((self.sizes, self.checks, self.keys))
        starts, counts = runs_of(self.keys[order], self.checks[order], self.sizes[order])
        out = np.empty(len(order), np.int64)
        out[order] = np.repeat(np.arange(len(starts)), counts)
        return out


def shared_tokens(table, buckets: int) -> list[dict]:
    """Of a range of tokens: those in two sets or more, dealt to buckets by set."""
    x = Opened(table)
    number = x.same()
    first = np.zeros(int(number.max()) + 1, np.int64)
    first[number] = np.arange(len(number))
    order = np.argsort(x.tokens, kind="stable")
    _, counts = runs_of(x.tokens[order])
    order = order[np.repeat(counts > 1, counts)]
    tokens, sets = x.tokens[order], number[x.own[order]]
    order = np.lexsort((sets, tokens))
    starts, _ = runs_of(tokens[order], sets[order])
    tokens, sets = tokens[order[starts]], sets[order[starts]]
    _, counts = runs_of(tokens)
    df = np.repeat(counts, counts)
    tokens, sets, df = tokens[df > 1], sets[df > 1], df[df > 1].astype(np.uint32)
    if not len(tokens):
        return []
    order = np.lexsort((tokens, sets))  # numbers ascend by key
    tokens, sets, df = tokens[order], sets[order], df[order]
    return _blobs(tokens, sets, x.keys[first], x.checks[first], x.sizes[first], buckets, df, by=x.keys[first][sets])


def index_keys(tokens: np.ndarray, df: np.ndarray, n: int, percent: int, rare: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set of n tokens, ascending, given those shared with other sets in order of (df, token).

    With each comes its place in the set's order, of two tokens the later one's; tokens of no other set stand first.
    """
    lone, need = n - len(tokens), -(-percent * n // 100)
    sizes = {groups(n), groups(n * 100 // percent)}
    out, places = [], []
    for g in sizes:
        head = tokens[: max(0, n - need + 1 + g - lone)]
        often = df[: len(head)] > rare
        out.append(mixed(head[~often] ^ U64(1)))
        places.append(np.flatnonzero(~often))
        t, at = head[often], np.flatnonzero(often)
        klass = mixed(t) % U64(g)
        for c in range(g) if len(t) > 1 else ():
            x = np.flatnonzero(klass == U64(c))
            i, j = np.triu_indices(len(x), 1)
            i, j = x[i], x[j]
            out.append(mixed(np.minimum(t[i], t[j]) * BASE + np.maximum(t[i], t[j]) + U64(g)))
            places.append(at[j])
    keys, places = np.concatenate(out), np.concatenate(places) + lone
    order = np.lexsort((places, keys))
    starts, _ = runs_of(keys[order])
    return keys[order[starts]], places[order[starts]].astype(np.uint32)


def candidates(table, percent: int, rare: int) -> list[dict]:
    """Sets of a bucket whose prefixes hold a shared token: all their shared tokens and their index keys."""
    x = Opened(table, ascending=False)
    number = x.same()
    order = np.lexsort((x.tokens, x.df, number[x.own]))
    tokens, df, own = x.tokens[order], x.df[order], x.own[order]
    starts, counts = runs_of(number[own])
    out = []
    for a, c in zip(starts, counts, strict=True):
        n = int(x.sizes[own[a]])
        need, g = -(-percent * n // 100), groups(n * 100 // percent)
        if c < need or n - need + 1 + g <= n - c:  # too few shared tokens to reach the similarity, or none in the prefix
            continue
        found, places = index_keys(tokens[a : a + c], df[a : a + c], n, percent, rare)
        if len(found):
            key, check = int(x.keys[own[a]].astype(np.int64)), int(x.checks[own[a]])
            out.append({"key": key, "check": check, "n": n, "posts": len(found), "tokens": pack_sorted(np.sort(tokens[a : a + c])), "ikeys": pack_sorted(found), "places": pack(places)})
    return out


def map_words(n: np.ndarray) -> np.ndarray:
    """Words of parities of sets of n tokens: a power of two of bits, that of n rounded up, 64 at least."""
    bits = 2 ** np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
    return np.clip(bits // 64, 1, WORDS)


def parities(tokens: np.ndarray, n: int) -> np.ndarray:
    """How many tokens each bit stands for, odd or even; the number of shared ones' bits follows from the set's size n."""
    bits = int(map_words(np.array([n]))[0]) * 64
    odd = np.bincount((mixed(tokens) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U64)


class Maps:
    """Sets with parities of their shared tokens, of which pairs are told apart."""

    def __init__(self, sizes: np.ndarray, lone: np.ndarray, flat: np.ndarray, percent: int):
        self.sizes, self.lone, self.flat, self.percent = sizes, lone, flat, percent
        self.words = map_words(sizes)
        self.at = np.cumsum(self.words) - self.words
        self.made = 0

    def extra(self, n: np.ndarray) -> np.ndarray:
        """G of the largest set that one of n tokens can be similar to, by which prefixes are extended."""
        bits = np.floor(np.log2(np.maximum(1, n * 100 // self.percent))).astype(np.int64)
        return np.maximum(1, (1 << bits) // 32)

    def largest(self, n: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The size up to which another set can be similar to one of n tokens and meet it under a key at that place."""
        room = (n + self.extra(n) - place) * (100 + self.percent) // self.percent - n
        return np.minimum(100 * n // self.percent, room)

    def within(self, n: np.ndarray, place: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether the place lies in the prefix of a set of n tokens that a similar one of `other` tokens must meet."""
        need = -(-self.percent * (n + other) // (100 + self.percent))
        return (place <= n - need + self.extra(np.minimum(n, other))) & (100 * np.minimum(n, other) >= self.percent * np.maximum(n, other))

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs may be similar: differing bits are differing tokens, and tokens that no other set holds differ always."""
        self.made += len(a)
        out = np.zeros(len(a), bool)
        most = (100 - self.percent) * (self.sizes[a] + self.sizes[b]) // (100 + self.percent) - self.lone[a] - self.lone[b]
        least = np.minimum(self.words[a], self.words[b])
        for w in np.unique(least[most >= 0]):
            rows = np.flatnonzero((least == w) & (most >= 0))
            for i in range(0, len(rows), max(1, AT_ONCE // int(w))):
                part = rows[i : i + max(1, AT_ONCE // int(w))]
                differ = self.folded(a[part], int(w)) ^ self.folded(b[part], int(w))
                out[part] = np.bitwise_count(differ).sum(1, dtype=np.int64) <= most[part]
        return out

    def folded(self, at: np.ndarray, w: int) -> np.ndarray:
        """Parities in w words; those in more are folded, which sums them."""
        out = self.flat[self.at[at][:, None] + np.arange(w)]
        for k in range(1, int(self.words[at].max(initial=w)) // w):
            wide = self.words[at] > k * w
            out[wide] ^= self.flat[self.at[at[wide]][:, None] + k * w + np.arange(w)]
        return out


def meetings(table, percent: int) -> tuple[list[dict], int]:
    """(edges between sets that share an index key and may be similar, as a forest under each key; pairs compared).

    Similar sets share enough tokens within prefixes that follow from both their sizes, so a pair counts under a key only if
    the key stands in these: a set whose key stands late meets only smaller sets, or none.
    """
    x = Opened(table)
    sets = Maps(x.sizes, x.lone, x.maps, percent)
    order = np.lexsort((x.keys[x.own], x.sizes[x.own], x.tokens))
    own, place = x.own[order].astype(np.int64), x.df[order].astype(np.int64)
    starts, counts = runs_of(x.tokens[order])
    group, n = np.repeat(np.arange(len(starts)), counts), sets.sizes[own]
    top, wide = sets.largest(n, place), int(sets.sizes.max(initial=1)) * 100 // percent + 2
    ahead = np.maximum(0, np.searchsorted(group * wide + n, group * wide + np.maximum(top, 0), side="right") - np.arange(len(own)) - 1)
    pairs = np.add.reduceat(ahead, starts) if len(starts) else np.zeros(0, np.int64)
    edges = [np.zeros((0, 2), np.int64)]
    for g in np.flatnonzero(pairs > LISTED * counts):
        a, c = starts[g], counts[g]
        edges.append(spread(sets, own[a : a + c], place[a : a + c]))
    ahead[np.repeat(pairs > LISTED * counts, counts)] = 0
    for lo, hi in _pieces(ahead, AT_ONCE // 4):
        k = ahead[lo:hi]
        left = np.repeat(np.arange(lo, hi), k)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(k) - k, k)
        ok = sets.within(n[right], place[right], n[left])
        both = np.unique(own[left[ok]] * len(x.sizes) + own[right[ok]])
        a, b = both // len(x.sizes), both % len(x.sizes)
        ok = sets.near(a, b)
        edges.append(np.stack([a[ok], b[ok]], 1))
    found = x.keys[np.unique(np.concatenate(edges), axis=0)].astype(np.int64).reshape(-1, 2)
    return [{"a": int(min(p)), "b": int(max(p))} for p in found.tolist() if p[0] != p[1]], sets.made


def spread(sets: Maps, own: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A spanning forest of the pairs among many sets under a key, ascending by size, that may be similar.

    Sets just reached are compared, some at a time, with those not yet reached; a family of near copies is reached at once.
    """
    n, rest, new, edges = sets.sizes[own], np.arange(len(own)), np.zeros(0, np.int64), []
    while len(rest):
        if not len(new):
            new, rest = rest[:1], rest[1:]
        some, new = new[:LISTED], new[LISTED:]
        fit = rest[(100 * n[rest] >= sets.percent * n[some].min()) & (sets.percent * n[rest] <= 100 * n[some].max())]
        hit = [np.zeros((0, 2), np.int64)]
        for i in range(0, len(fit), AT_ONCE // (4 * LISTED)):
            part = fit[i : i + AT_ONCE // (4 * LISTED)]
            a, b = np.repeat(some, len(part)), np.tile(part, len(some))
            ok = sets.within(n[a], place[a], n[b]) & sets.within(n[b], place[b], n[a])
            a, b = a[ok], b[ok]
            ok = sets.near(own[a], own[b])
            _, at = np.unique(b[ok], return_index=True)
            hit.append(np.stack([a[ok][at], b[ok][at]], 1))
        _, at = np.unique(np.concatenate(hit)[:, 1], return_index=True)
        hit = np.concatenate(hit)[at]
        edges.append(hit)
        rest = rest[~np.isin(rest, hit[:, 1])]
        new = np.concatenate([new, hit[:, 1]])
    return own[np.concatenate(edges)]


def overlaps(ids: np.ndarray, ends: np.ndarray, cells: int):
    """A function (a, b, top) -> shared tokens of sets a to b - 1 with sets a to top - 1.

    ids are small token numbers, set after set. Tokens that a quarter of the sets or more hold are multiplied as a matrix,
    the others are counted along their postings.
    """
    m = len(ends)
    owner = np.repeat(np.arange(m), np.diff(ends, prepend=0))
    df = np.bincount(ids)
    often = df >= max(8, m // 4)
    column = np.cumsum(often) - 1
    dense = np.zeros((m, int(often.sum())), np.float32)
    hit = often[ids]
    dense[owner[hit], column[ids[hit]]] = 1
    rare_ids, rare_owner = ids[~hit], owner[~hit]
    order = np.argsort(rare_ids, kind="stable")
    posting, by_id = rare_owner[order], rare_ids[order]
    first = np.searchsorted(by_id, np.arange(len(df) + 1))
    at = np.searchsorted(rare_owner, np.arange(m + 1))

    def counts(a: int, b: int, top: int) -> np.ndarray:
        width = top - a
        both = (dense[a:b] @ dense[a:top].T).astype(np.int32) if dense.shape[1] else np.zeros((b - a, width), np.int32)
        mine = rare_ids[at[a] : at[b]]
        row = rare_owner[at[a] : at[b]] - a
        n = first[mine + 1] - first[mine]
        for lo, hi in _pieces(n, cells):
            k = n[lo:hi]
            step = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            docs = posting[np.repeat(first[mine[lo:hi]], k) + step] - a
            rows = np.repeat(row[lo:hi], k)
            ok = (docs >= 0) & (docs < width)
            both += np.bincount(rows[ok] * width + docs[ok], minlength=(b - a) * width).reshape(both.shape).astype(np.int32)
        return both

    return counts


def _pieces(n: np.ndarray, most: int):
    """Slices of n whose sums are about `most`."""
    total, lo = np.cumsum(n), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def links(nodes: np.ndarray, sizes: np.ndarray, copies: np.ndarray, tiles: np.ndarray, tokens: list[np.ndarray], percent: int, cells: int = 1_000_000):
    """(edges of a spanning forest, documents that each set is linked with) among sets; sets of one tile meet only if all are."""
    order = np.argsort(sizes, kind="stable")
    nodes, sizes, copies, tiles, tokens = nodes[order], sizes[order], copies[order], tiles[order], [tokens[i] for i in order]
    m, cross = len(nodes), bool((tiles != tiles[0]).any())
    ids = np.unique(np.concatenate(tokens), return_inverse=True)[1]
    counts = overlaps(ids, np.cumsum([len(t) for t in tokens]), cells)
    label, found, edges = np.arange(m), np.zeros(m, np.int64), []
    a = 0
    while a < m:
        b = min(m, a + max(1, cells // (m - a)))
        top = int(np.searchsorted(100 * sizes, 100 * 100 * sizes[b - 1] // percent, side="right"))
        both = counts(a, b, top).astype(np.int64)
        ok = 100 * both >= percent * (sizes[a:b, None] + sizes[None, a:top] - both)
        ok &= np.arange(a, top)[None, :] > np.arange(a, b)[:, None]
        if cross:
            ok &= tiles[a:b, None] != tiles[None, a:top]
        found[a:b] += ok @ copies[a:top]
        found[a:top] += copies[a:b] @ ok
        for i in np.flatnonzero(ok.any(axis=1)):
            near = a + np.flatnonzero(ok[i])
            new = np.unique(label[near], return_index=True)
            for to, j in zip(*new, strict=True):
                if to != label[a + i]:
                    edges.append((int(nodes[a + i]), int(nodes[near[j]])))
                    label[label == to] = label[a + i]
        a = b
    return edges, list(zip(nodes.tolist(), found.tolist(), strict=True))


def verified(table, percent: int) -> list[dict]:
    """Of each block's cell in the table: its links as a forest (a, b), and (a, null, n) for each set's number of links."""
    import pyarrow as pa

    number = lambda c: table.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
    blocks, nodes, sizes, copies, tiles = map(number, ("block", "node", "n", "copies", "tile"))
    packed = table.column("tokens")
    order = np.lexsort((nodes, blocks))
    starts, counts = runs_of(blocks[order])
    out = []
    for a, c in zip(starts, counts, strict=True):
        at = order[a : a + c]
        edges, found = links(nodes[at], sizes[at], copies[at], tiles[at], [unpack_sorted(b) for b in packed.take(pa.array(at)).to_pylist()], percent)
        out += [{"a": x, "b": y, "n": 0} for x, y in edges]
        out += [{"a": x, "b": None, "n": n} for x, n in found if n]
    return out


def slim_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """SLIM: each document's set size, the keys of its set and a hash of its text."""

    def scan(batches):
        import pyarrow as pa

        for ids, texts in chunked(batches):
            rows = [(i, len(s), *set_keys(s), int(U64(xxhash.xxh64_intdigest(t, TEXT_SEED)).astype(np.int64))) for i, t, s in zip(ids, texts, sets_of(texts, width), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "n", "key", "check", "text_hash"])

    return docs.mapInArrow(scan, SLIM)


def token_blobs(docs: DataFrame, ranges: int, width: int, percent: int) -> DataFrame:
    """BLOB rows of all tokens of sets that can be similar to a different set."""
    least = 100 // (100 - percent) - 1  # a smaller set is only similar to its equals

    def scan(batches):
        for _, texts in chunked(batches):
            found = {(*set_keys(s), len(s)): s for s in sets_of(texts, width) if len(s) >= least}
            if not found:
                continue
            keys, checks = (np.array([k[i] for k in found], np.int64).astype(kind) for i, kind in ((0, U64), (1, np.uint32)))
            sizes = np.array([len(s) for s in found.values()], np.int64)
            tokens, owner = np.concatenate(list(found.values())), np.repeat(np.arange(len(found)), sizes)
            order = np.argsort(tokens, kind="stable")
            yield from _rows(_blobs(tokens[order], owner[order], keys, checks, sizes, ranges), BLOB).to_batches()

    return docs.mapInArrow(scan, BLOB)


def posted(table, ranges: int) -> list[dict]:
    """Rows of CANDIDATE by ranges of their index keys, with their parities and how many tokens each holds alone; df holds the keys' places."""
    ikeys, held = ([unpack_sorted(b) for b in table.column(c).to_pylist()] for c in ("ikeys", "tokens"))
    tokens, owner = np.concatenate(ikeys), np.repeat(np.arange(len(ikeys)), [len(e) for e in ikeys])
    order = np.argsort(tokens, kind="stable")
    keys = np.array(table.column("key").to_pylist(), np.int64).astype(U64)
    sizes = np.array(table.column("n").to_pylist(), np.int64)
    maps = [parities(t, int(n)) for t, n in zip(held, sizes, strict=True)]
    lone = sizes - np.array([len(t) for t in held])
    places = np.concatenate([unpack(b, np.uint32) for b in table.column("places").to_pylist()])
    return _blobs(tokens[order], owner[order], keys, None, sizes, ranges, places[order], maps=maps, lone=lone)


def jaccard_components(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, rare: int = RARE, block_weight: int = BLOCK_WEIGHT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, text_hash, n_shingles, component_id, n_links, root.

    Two documents link when 100 * shared >= percent * union; n_links counts all documents linked with one, copies too. root
    is the same number for all documents of a component and null for those without shingles.
    """
    docs = store.columns(docs, "doc_id", "text")
    slim = store.written(store.few(slim_sets(docs, width)), "sets")
    n_docs = slim.count()
    sets = slim.where("n > 0").groupBy("key", "check", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    sets = store.written(sets.withColumn("node", F.monotonically_increasing_id()), "members", n_docs)
    total = slim.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = store.parts(total, store.grown(RANGE_TOKENS, 6 * total))  # a token is about six bytes of text
    buckets = store.parts(ranges, 3)

    def share(table):
        return _rows(shared_tokens(table, buckets), BLOB)

    def choose(table):
        return _rows(candidates(table, percent, rare), CANDIDATE)

    shared = store.dealt(token_blobs(docs, ranges, width, percent), ranges, "range").groupBy("range").applyInArrow(share, BLOB)
    found = store.written(store.dealt(shared, buckets, "range").groupBy("range").applyInArrow(choose, CANDIDATE), "candidates")

    posts = found.agg(F.coalesce(F.sum("posts"), F.lit(0))).first()[0]
    spread_over = store.parts(posts, store.grown(RANGE_TOKENS // 2, 6 * total))

    def post(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                yield from _rows(posted(batch.slice(start, 1000), spread_over), BLOB).to_batches()

    def meet(table):
        return _rows(meetings(table, percent)[0], "a long, b long")

    edges = store.dealt(found.select("key", "n", "tokens", "ikeys", "places").mapInArrow(post, BLOB), spread_over, "range").groupBy("range").applyInArrow(meet, "a long, b long")
    edges = store.written(edges, "meetings")
    near = store.written(components(edges), "blocks", n_docs)
    weight = near.join(found.select("key", "n"), F.col("key") == F.col("node")).groupBy("root").agg(F.sum(F.col("n") + SET_WEIGHT).alias("w"))
    weight = store.written(weight, "weights", n_docs)
    total = weight.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    bins = store.parts(total, block_weight // 8)
    tiles = F.greatest(F.lit(1), F.ceil(F.col("w") / (block_weight // 2))).cast("int")
    homes = near.select(F.col("node").alias("key"), F.col("root").alias("block")).join(weight.select(F.col("root").alias("block"), tiles.alias("tiles")), "block")
    blocks = found.select("key", "check", "n", "tokens").join(homes.join(sets.select("key", "check", "n", "node", "copies"), "key"), ["key", "check", "n"])
    blocks = blocks.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    # every pair of tiles is a cell, and so is every tile by itself
    blocks = blocks.withColumn("cell", F.when(F.col("tiles") == 1, F.lit(-1).cast("long")).otherwise(F.least("tile", "other").cast("long") * F.col("tiles") + F.greatest("tile", "other")))
    blocks = blocks.withColumn("bin", F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("block"), F.lit(bins))).otherwise(F.col("block")))

    def verify(table):
        return _rows(verified(table, percent), "a long, b long, n long")

    found_links = blocks.select("bin", "cell", "block", "tile", "node", "copies", "n", "tokens").groupBy("bin", "cell").applyInArrow(verify, "a long, b long, n long")
    found_links = store.few(found_links)
    found_links = store.written(found_links, "links")
    store.drop(found, edges, near, weight)
    roots = components(found_links.where("b IS NOT NULL").select("a", "b"))
    degree = found_links.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    members = sets.join(roots, "node", "left").join(degree, "node", "left").select("key", "check", "n", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "node").alias("root"))
    members = store.written(members, "rooted", n_docs)
    store.drop(found_links)
    least = members.groupBy("root").agg(F.min("first").alias("component_id"))
    named = members.join(least, "root").select(F.col("key").alias("_key"), F.col("check").alias("_check"), F.col("n").alias("_n"), "links", "component_id", "root")
    out = slim.join(named, (F.col("key") == F.col("_key")) & (F.col("check") == F.col("_check")) & (F.col("n") == F.col("_n")), "left")
    return out.select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        "root",
    )


def query(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs).drop("text_hash", "root")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id, then the smallest hash of its text.

    A document without shingles is a group of its own. Of rows that repeat a doc_id and a text one stays.
    """
    found = store.written(store.few(jaccard_components(docs)), "near")
    rows = found.count()
    linked = found.where("n_links > 0").withColumn("id", F.coalesce("doc_id", F.lit(store.LAST)))
    first = linked.groupBy("root").agg(F.min(F.struct("id", "text_hash")).alias("s")).select("s.*")
    gone = linked.select("doc_id", "id", "text_hash").distinct().join(first, ["id", "text_hash"], "left_anti").select("doc_id", "text_hash")
    repeats = found.groupBy("doc_id", "text_hash").count().where("count > 1").drop("count")
    return store.without(docs, store.written(gone, "copies", rows), store.written(repeats, "repeats", rows))


SQL = """
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
k AS (SELECT r, doc_id, len(sh) AS n, CASE WHEN len(sh) > 0 THEN md5(array_to_string(list_sort(sh), chr(10))) END AS k, sh FROM s),
d AS (SELECT k, any_value(n) AS n, count(*) AS copies, min(doc_id) AS first_doc, any_value(sh) AS sh FROM k WHERE n > 0 GROUP BY k),
t AS (SELECT k, n, hash(unnest(sh)) AS h FROM d),
p AS (SELECT a.k AS x, b.k AS y FROM t a JOIN t b ON a.h = b.h AND a.k <> b.k GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (WITH RECURSIVE g(x, y) AS (SELECT k, k FROM d UNION SELECT g.x, p.y FROM g JOIN p ON g.y = p.x) SELECT x, y FROM g),
c AS (SELECT reach.x AS k, min(e.first_doc) AS component_id FROM reach JOIN d e ON e.k = reach.y GROUP BY reach.x),
l AS (SELECT p.x AS k, sum(e.copies) AS links FROM p JOIN d e ON e.k = p.y GROUP BY p.x)
SELECT k.doc_id, CAST(k.n AS BIGINT) AS n_shingles, CASE WHEN k.n > 0 THEN c.component_id ELSE k.doc_id END AS component_id,
       CAST(coalesce(l.links, 0) + coalesce(d.copies - 1, 0) AS BIGINT) AS n_links
FROM k LEFT JOIN d ON d.k = k.k LEFT JOIN c ON c.k = k.k LEFT JOIN l ON l.k = k.k
"""
