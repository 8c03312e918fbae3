"""Suffix-array dedup: removes every byte of a 100-byte string that also starts earlier.

Texts are UTF-8 bytes; "earlier" is a smaller doc_id, or an earlier start in the same text. All strings
are judged on the input.

1. *Anchors* bring together what can be equal. Of the 24-byte strings inside each 100-byte window the one
   with the least hash is its anchor (about one in 38 positions is one). Equal windows have equal anchors at
   equal places, so windows need to be compared only around anchors that occur twice or more. Around an
   anchor, 76 bytes before and 100 from its start are its context: they hold every window that has it.
   Contexts that are equal (under two independent 64-bit hashes, of anchor and context) collapse to their
   first occurrence and the knowledge that others follow. Of equal contexts that a task reads together
   only the first travels to meet the anchor's others, so a common passage is no hot key.
2. *Suffix arrays* decide what goes. The contexts of an anchor are cut into blocks where those that were equal
   so far begin to differ; each block becomes a symbol. Contexts that are equal as far as they share anything have the
   same string, which stands once for the first of them and once more for those that follow. A suffix array over
   the strings of many anchors is built by linear grouping: suffixes
   are grouped by their Lyndon prefix; groups are processed in descending order, each moving the suffixes
   that its previous-smaller pointers name into new groups; a single pass then emits each group's order. With
   its LCP array, a scan finds for each suffix the longest match with an earlier occurrence, and so the
   stretches that first occurrences and later ones lose. Nothing is removed but by this.
3. *Removal.* The stretches go to all occurrences by a join on (anchor, context), and meet by document. Texts
   are dealt out twice, never at the same time: those with anchors of several contexts for the contexts, and those that lose something.

An anchor with over MOST_CONTEXTS different contexts is dealt by window: each window is a context of its
own, collapsed by partial minima, and judged by the same suffix arrays. So no task holds more than
MOST_CONTEXTS contexts of an anchor.

Defined cases: a null text is empty; texts under 100 bytes stay whole; texts of any length are read
whole, in overlapping stretches; a repeated row (equal doc_id and text) counts as one document and is
returned as often as it came; rows with equal doc_id (or none) and different text are ordered by a hash of
the text; a null doc_id sorts before all others; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import discard, durable, texts
from granary.llm.url_filters import Filter, filter_level

WINDOW = 100
GRAM = 24
LEFT = WINDOW - GRAM
#: Bytes hashed at once, few enough for a processor's cache; longer texts are read in stretches that overlap by a window.
STRETCH = 1 << 15
#: Different contexts of one anchor that are compared with each other; with more, its windows are.
MOST_CONTEXTS = 30_000
_LOW = np.uint64((1 << 20) - 1)
#: Contexts compared at once, unless one anchor has more.
CHUNK = 20_000
#: Anchors of texts read together.
TOGETHER = 1_000_000
NO_ID = -(1 << 63)

_P = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_table() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        inverse = pow(_P, -1, 1 << 64)
        for base in (_P, inverse):
            p = np.full(STRETCH + 2 * WINDOW + 2, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p))
    return _powers[0], _powers[1]


def _stretch_anchors(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the anchors in a buffer of texts that end at ``ends``."""
    up, down = _power_table()
    n = len(buf)
    total = np.zeros(n + 1, np.uint64)
    x = buf.astype(np.uint64)
    x += np.uint64(1)
    x *= up[:n]
    np.cumsum(x, out=total[1:])
    h = total[GRAM:] - total[:-GRAM]
    h *= down[: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    # a window's least hash, and of equal ones the leftmost: position in the low bits
    least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    span, width = WINDOW - GRAM + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    at = (least & _LOW).astype(np.int64)
    whole = np.ones(len(at), bool)
    for end in ends[:-1].tolist():  # windows over a border choose none
        whole[max(0, end - WINDOW + 1) : end] = False
    at = at[whole]
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    return h[at], at


def anchors(raws: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each text that has any: its number, and the hashes and positions of its anchors, by position."""
    batch: list[tuple[int, int, bytes]] = []
    size = 0

    def close():
        ends = np.cumsum([len(x) for _, _, x in batch])
        buf = np.frombuffer(b"".join(x for _, _, x in batch), np.uint8)
        if len(buf) < WINDOW:
            return
        h, at = _stretch_anchors(buf, ends)
        cuts = np.searchsorted(at, ends)
        start = 0
        for (k, base, x), end, cut in zip(batch, ends.tolist(), cuts.tolist()):
            if cut > start:
                yield k, h[start:cut], at[start:cut] - (end - len(x)) + base
            start = cut

    held: tuple | None = None

    def merged(found):
        nonlocal held
        for k, h, p in found:
            if held is not None and held[0] == k:  # the next stretch of the same text; a position may come twice
                p, first = np.unique(np.concatenate([held[2], p]), return_index=True)
                held = (k, np.concatenate([held[1], h])[first], p)
            else:
                if held is not None:
                    yield held
                held = (k, h, p)

    for k, raw in enumerate(raws):
        if len(raw) < WINDOW:
            continue
        for base in range(0, len(raw) - WINDOW + 1, STRETCH - 2 * WINDOW):
            piece = raw[base : base + STRETCH - WINDOW]
            if size + len(piece) > STRETCH and batch:
                yield from merged(close())
                batch, size = [], 0
            batch.append((k, base, piece))
            size += len(piece)
    if batch:
        yield from merged(close())
    if held is not None:
        yield held


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of integers; the last must be smaller than all others."""
    n = len(s)
    order = np.argsort(np.asarray(s), kind="stable")
    sa = order.tolist()
    place = [0] * n
    group = [0] * n  # of each suffix: where its group starts in sa
    size = [0] * n  # of each group, at its start
    start = 0
    for k, i in enumerate(sa):
        place[i] = k
        if s[i] != s[sa[start]]:
            start = k
        group[i] = start
        size[start] += 1
    unset = -2
    prev = [unset] * n
    top = n - 1
    while top >= 0:
        g = group[sa[top]]
        times: dict[int, int] = {}
        for k in range(g, top + 1):
            i = sa[k]
            chain = [i] if prev[i] == unset else []
            j = i - 1 if chain else prev[i]
            while j >= 0 and group[j] >= g:  # what lies at or above this group has a pointer, or gets this one
                if prev[j] == unset:
                    chain.append(j)
                    j -= 1
                else:
                    j = prev[j]
            for c in chain:
                prev[c] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            most = max(times.values())
            levels: list[list[int]] = [[] for _ in range(most + 1)]
            for j, t in times.items():
                levels[t].append(j)
            for t in range(most, 0, -1):  # the more often this group follows, the further up
                moved: dict[int, int] = {}
                for j in levels[t]:
                    of = group[j]
                    last = of + size[of] - 1
                    other, k = sa[last], place[j]
                    sa[k], place[other] = other, k
                    sa[last], place[j] = j, last
                    size[of] -= 1
                    moved[of] = moved.get(of, 0) + 1
                for of, count in moved.items():
                    new = of + size[of]
                    size[new] = count
                    for k in range(new, new + count):
                        group[sa[k]] = new
        top = g - 1
    out = [-1] * n
    free = list(range(n))  # the next free place of the group that starts here
    done = bytearray(n)
    out[0], done[n - 1] = n - 1, 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = 1
            j = prev[j]
    return out


def common_prefixes(s: list[int], sa: list[int]) -> list[int]:
    """For each place of the suffix array: how many symbols its suffix shares with the one before."""
    n = len(s)
    place = [0] * n
    for k, i in enumerate(sa):
        place[i] = k
    lcp, h = [0] * n, 0
    for i in range(n - 1):
        k = place[i]
        if k:
            j = sa[k - 1]
            while s[i + h] == s[j + h]:
                h += 1
            lcp[k] = h
            if h:
                h -= 1
        else:
            h = 0
    return lcp


def earlier_matches(sa: list[int], lcp: list[int], rank: list[int]) -> list[int]:
    """For each suffix: the symbols it shares at most with a suffix of a smaller rank."""
    best = [0] * len(sa)
    for forward in (True, False):
        stack: list[tuple[int, int]] = []  # (rank, what the suffix above it on the stack shares with it)
        places = range(len(sa)) if forward else range(len(sa) - 1, -1, -1)
        for k in places:
            i = sa[k]
            shared = lcp[k] if forward else (lcp[k + 1] if k + 1 < len(sa) else 0)
            while stack and stack[-1][0] >= rank[i]:
                shared = min(shared, stack.pop()[1])
            if stack and shared > best[i]:
                best[i] = shared
            stack.append((rank[i], shared))
    return best


def _sides(group: np.ndarray, side: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of padded strings within their groups, and what each shares with the one before (-1: none there)."""
    words = np.ascontiguousarray(np.pad(side, ((0, 0), (0, -side.shape[1] % 8)))).view(">u8")
    order = np.lexsort([length, *(words[:, c] for c in range(words.shape[1] - 1, -1, -1)), group])
    a, b = side[order[:-1]], side[order[1:]]
    differs = a != b
    same = np.where(differs.any(1), differs.argmax(1), side.shape[1])
    same = np.minimum(same, np.minimum(length[order[:-1]], length[order[1:]]))
    shared = np.full(len(order), -1, np.int64)
    shared[1:] = np.where(group[order[:-1]] == group[order[1:]], same, -1)
    return order, shared


def _symbols(group, order, shared, reach, side_no):
    """(context, depth, width, code) of the blocks on one side, by context and depth: cut where contexts that were equal so far part, or one ends."""
    g = group[order]
    end = reach[order]
    cut = np.unique(np.concatenate([(g * 256 + shared)[shared > 0], (g * 256 + end)[end > 0]]))
    first = np.searchsorted(cut, g * 256, side="left")
    # the cuts of a group are sorted by depth: those up to a context's own reach may count
    n_cuts = np.searchsorted(cut, g * 256 + end, side="right") - first
    owner = np.repeat(np.arange(len(order)), n_cuts)
    depth = cut[np.arange(len(owner)) - np.repeat(np.cumsum(n_cuts) - n_cuts, n_cuts) + np.repeat(first, n_cuts)] % 256
    # class at a depth: the last place at or before the context whose shared part is shorter than the depth
    classes, parts = np.zeros(len(owner), np.int64), np.zeros(len(owner), bool)
    place = np.arange(len(order))
    for d in np.unique(depth).tolist():
        begins = np.maximum.accumulate(np.where(shared < d, place, 0))
        at = depth == d
        classes[at] = begins[owner[at]]
        here = np.zeros(len(order), bool)
        here[begins[(shared == d) | (end == d)]] = True
        parts[at] = here[classes[at]]
    owner, depth, classes = owner[parts], depth[parts], classes[parts]
    width = depth.copy()
    width[1:] -= np.where(owner[1:] == owner[:-1], depth[:-1], 0)
    return order[owner], depth, width, (classes * 256 + depth) * 2 + side_no


def _classes(group: np.ndarray, alone: np.ndarray, lefts: np.ndarray, left_len: np.ndarray, rights: np.ndarray, right_len: np.ndarray):
    """Contexts by what they can share: for each its class (-1: too little), and the blocks of each class in order (class, from, to, symbol).

    group: number of each context's anchor; alone: those that are shared in full, as equal ones follow. lefts:
    bytes before the anchor, nearest first; rights: bytes from its start. Contexts that are equal as far as each shares
    anything are one class; from, to are seen from the anchor.
    """
    n = len(group)
    sides = []
    for side, length in ((lefts, left_len), (rights, right_len)):
        order, shared = _sides(group, side, length)
        reach = np.zeros(n, np.int64)
        reach[order] = np.maximum(np.maximum(shared, np.append(shared[1:], -1)), 0)
        sides.append((order, shared, np.where(alone, length, reach)))
    active = sides[0][2] + sides[1][2] >= WINDOW
    blocks, deepest = [], []
    for k, (order, shared, reach) in enumerate(sides):
        context, depth, width, code = _symbols(group, order, shared, np.where(active, reach, 0), k)
        last = np.full(n, -1, np.int64)  # the deepest block tells all before it
        by = np.lexsort((depth, context))
        last[context[by]] = code[by]
        deepest.append(last)
        blocks.append((context, -depth, width - depth, code) if k == 0 else (context, depth - width, depth, code))
    _, first, of = np.unique(np.stack([group, *deepest], 1)[active], axis=0, return_index=True, return_inverse=True)
    of_context = np.full(n, -1, np.int64)
    of_context[active] = of.reshape(-1)
    shown = np.full(n, -1, np.int64)  # a class shows the blocks of one of its contexts
    shown[np.nonzero(active)[0][first]] = np.arange(len(first))
    context, a, z, code = (np.concatenate(x) for x in zip(*blocks))
    own = shown[context]
    by = np.nonzero(own >= 0)[0]
    by = by[np.lexsort((a[by], own[by]))]
    return of_context, own[by], a[by], z[by], np.unique(code[by], return_inverse=True)[1].astype(np.int64)


def matched(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, ranks: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, from, to): the stretches of 100 bytes at least that strings share with those of a smaller rank.

    symbols: strings one after another, each (owner) closed by the symbol 1 or made of one symbol that no other but its like has.
    """
    if not len(symbols):
        return (np.zeros(0, np.int64),) * 3
    s = [*symbols.tolist(), 0]
    sa = suffix_array(s)
    shared = np.array(earlier_matches(sa, common_prefixes(s, sa), [*ranks.tolist(), -1])[:-1], np.int64)
    # how many symbols of its own string are left from each place on
    last = np.append(owner[1:] != owner[:-1], True)
    end = np.nonzero(last)[0]
    left = np.repeat(end - (symbols[end] == 1), np.diff(np.append(-1, end))) + 1 - np.arange(len(symbols))
    blocks = np.minimum(shared, left)
    i = np.nonzero(blocks > 0)[0]
    a, z, of = starts[i], ends[i + blocks[i] - 1], owner[i]
    long = z - a >= WINDOW
    a, z, of = a[long], z[long], of[long]
    by = np.lexsort((a, of))
    a, z, of = a[by], z[by], of[by]
    far = np.maximum.accumulate(of * 1024 + z + 256)  # a string's stretches are within 256 bytes of its anchor
    new = np.append(True, (of * 1024 + a + 256)[1:] > far[:-1]) if len(of) else np.zeros(0, bool)
    return of[new], a[new], (far - of * 1024 - 256)[np.append(new[1:], True)] if len(of) else z


_ANCHOR = "h long, ctx long, doc_id long, text_hash long, at int, flags byte, right byte"
_OCCURRENCE = "h long, ctx long, doc_id long, text_hash long, at int, later boolean, copies boolean, dense boolean, lone boolean, right byte"
_CONTEXT = "h long, ctx long, left int, context binary, doc_id long, text_hash long, at int, copies boolean, dense boolean, right byte"
_VERDICT = "h long, ctx long, later boolean, a int, z int"
_JUDGED = "doc_id long, text_hash long, cuts array<long>, kept_sha256 string, n_removed long"


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [x.split()[0] for x in schema.split(", ")])


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: whether each is the first with its keys, and the number of its run."""
    first = np.ones(len(keys[0]), bool)
    if len(first) > 1:
        first[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return first, np.cumsum(first) - 1


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of texts with the hash of their context.

    flags: 1: not the first of its context among the texts read together (so it need not meet the anchor's
    others); otherwise 2: the anchor has others there, and 4: so has the context. right: the context's bytes from
    the anchor's start.
    """

    def close(held):
        h, ctx, doc, text, at, right = (np.concatenate(x) for x in zip(*held))
        by = np.lexsort((at, text, doc, ctx, h))
        rows = [x[by] for x in (h, ctx, doc, text, at, right)]
        once, _ = _runs(*rows[:5])  # a repeated row counts once
        h, ctx, doc, text, at, right = (x[once] for x in rows)
        _, of_h = _runs(h)
        first, of_ctx = _runs(h, ctx)
        flags = np.where(first, 2 * (np.bincount(of_h)[of_h] > 1) + 4 * (np.bincount(of_ctx)[of_ctx] > 1), 1)
        return _batch(_ANCHOR, h, ctx, doc, text, at, flags.astype(np.int8), right)

    held, size, digest = [], 0, xxhash.xxh3_64_intdigest
    for b in batches:
        for start in range(0, b.num_rows, 1024):
            ids, hashes = (b.column(k)[start : start + 1024].to_numpy() for k in (0, 2))
            raws = [x or b"" for x in b.column(1)[start : start + 1024].cast(pa.binary()).to_pylist()]
            for k, h, p in anchors(raws):
                raw = raws[k]
                left = np.minimum(p, LEFT)
                ctx = np.array([digest(raw[a:z], n) for a, z, n in zip((p - left).tolist(), (p + WINDOW).tolist(), left.tolist())], np.uint64)
                held.append((h.view(np.int64), ctx.view(np.int64), np.full(len(p), ids[k]), np.full(len(p), hashes[k]), p.astype(np.int32), np.minimum(WINDOW, len(raw) - p).astype(np.int8)))
                size += len(p)
            if size > TOGETHER:
                yield close(held)
                held, size = [], 0
    if held:
        yield close(held)
    pa.default_memory_pool().release_unused()


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of anchors sorted by (h, ctx) those that are repeated: whether they follow others of their context, whether others follow, and whether the anchor has too many contexts, or this one only."""
    dense_h: int | None = None

    def told(x):
        by = np.lexsort((x[4], x[3], x[2], x[1], x[0]))
        x = [c[by] for c in x]
        first, run = _runs(*x[:5])
        flags = np.zeros(run[-1] + 1 if len(run) else 0, np.int64)
        np.bitwise_or.at(flags, run, x[5].astype(np.int64))  # the same row may have been read twice
        h, ctx, doc, text, at, right = (x[k][first] for k in (0, 1, 2, 3, 4, 6))
        begins, of_h = _runs(h)
        new, of_ctx = _runs(h, ctx)
        n = np.bincount(of_h)
        repeated = (n > 1) | (np.bincount(of_h, flags & 2) > 0)
        n_contexts = np.bincount(of_h, new)
        dense = n_contexts > MOST_CONTEXTS
        if dense_h is not None:
            repeated |= h[begins] == dense_h
            dense |= h[begins] == dense_h
        copies = (np.bincount(of_ctx) > 1) | (np.bincount(of_ctx, flags & 4) > 0)
        lone = (n_contexts == 1) & ~dense
        keep = repeated[of_h]
        return _batch(_OCCURRENCE, *(c[keep] for c in (h, ctx, doc, text, at, ~new, copies[of_ctx], dense[of_h], lone[of_h], right)))

    held: list[np.ndarray] = []
    for b in batches:
        x = [c.to_numpy() for c in b.columns]
        follows = x[5] == 1
        if follows.any():
            yes = np.ones(int(follows.sum()), bool)
            yield _batch(_OCCURRENCE, *(c[follows] for c in x[:5]), yes, yes, ~yes, ~yes, x[6][follows])
            x = [c[~follows] for c in x]
        if held:
            x = [np.concatenate(pair) for pair in zip(held, x)]
        if not len(x[0]):
            continue
        cut = int(np.searchsorted(x[0], x[0][-1]))  # the last anchor may go on: it waits
        if len(x[0]) - cut > 2 * MOST_CONTEXTS:
            last = cut + int(np.searchsorted(x[1][cut:], x[1][-1]))
            if last - cut > MOST_CONTEXTS:  # too many to wait: only its last context does
                dense_h, cut = int(x[0][-1]), last
        held = [c[cut:] for c in x]
        if cut:
            yield told([c[:cut] for c in x])
    if held and len(held[0]):
        yield told(held)


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around given places of texts. Of equal rows that follow each other one is enough."""
    last = None
    for b in batches:
        for start in range(0, b.num_rows, 256):
            part = b.slice(start, 256)
            doc, text, raws = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).cast(pa.binary()).to_pylist()
            places, n = part.column(3).flatten(), part.column(3).value_lengths().to_numpy().copy()
            for k, key in enumerate(zip(doc.tolist(), text.tolist())):
                if key == last:
                    n[k] *= -1
                last = key
            owner = np.repeat(np.arange(len(n)), np.abs(n))
            new = (n > 0)[owner]
            at, h, ctx, copies, dense = (places.field(c).to_numpy(zero_copy_only=False)[new] for c in ("at", "h", "ctx", "copies", "dense"))
            owner = owner[new]
            left = np.minimum(at, LEFT).astype(np.int32)
            context = [raws[k][p - m : p + WINDOW] for k, p, m in zip(owner.tolist(), at.tolist(), left.tolist())]
            right = np.array([len(c) for c in context], np.int64) - left
            yield _batch(_CONTEXT, h, ctx, left, pa.array(context, pa.binary()), doc[owner], text[owner], at, copies, dense, right.astype(np.int8))


def judged_contexts(h, ctx, left, context: list[bytes | None], doc, text, at, copies, right=None) -> pa.RecordBatch:
    """What the contexts of whole anchors lose, as first occurrences and as later ones.

    right: their lengths from the anchor's start. Where it is given, an anchor's only context may come without its bytes.
    """
    if right is None:
        right = np.array([len(c) for c in context], np.int64) - left
    by = np.lexsort((at, text, doc, ctx, h))
    once, _ = _runs(h[by], ctx[by])
    by = by[once]  # a context may have come twice
    h, ctx, left, doc, text, at, copies, right = (x[by] for x in (h, ctx, left, doc, text, at, copies, right))
    context = [context[i] for i in by.tolist()]
    n = len(h)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((at, text, doc))] = np.arange(n)
    _, group = _runs(h)
    several = np.bincount(group)[group] > 1
    some = np.nonzero(several)[0]
    llen = left[some].astype(np.int64)
    held = [context[i] for i in some.tolist()]
    rlen = np.array([len(c) for c in held], np.int64) - llen
    lefts = np.frombuffer(b"".join([c[:m][::-1].ljust(LEFT, b"\0") for c, m in zip(held, llen.tolist())]), np.uint8).reshape(-1, LEFT)
    rights = np.frombuffer(b"".join([c[m:].ljust(WINDOW, b"\0") for c, m in zip(held, llen.tolist())]), np.uint8).reshape(-1, WINDOW)
    of, block_of, a, z, code = _classes(group[some], copies[some], lefts, llen, rights, rlen)
    # a lone context differs from no other: it is one block and a class of its own
    lone = np.nonzero(~several & copies)[0]
    n_classes, n_all = (int(of.max()) + 1 if len(of) else 0), (int(of.max()) + 1 if len(of) else 0) + len(lone)
    kind = np.full(n, -1, np.int64)
    kind[some], kind[lone] = of, n_classes + np.arange(len(lone))
    has = np.nonzero(kind >= 0)[0]
    has = has[np.argsort(rank[has], kind="stable")]
    leader = np.full(n_all, -1, np.int64)
    leader[kind[has][::-1]] = has[::-1]  # the first occurrence of a class
    follows = np.bincount(kind[has], 1 + copies[has], minlength=n_all) > 1
    # each class once as its first occurrence (string k) and once more for those that follow, after all first ones (n_all + k)
    block = [block_of, a, z, code + 2]
    close = [np.arange(n_classes), np.zeros(n_classes, np.int64), np.zeros(n_classes, np.int64), np.ones(n_classes, np.int64)]
    block = [np.concatenate(x) for x in zip(block, close)]
    by = np.lexsort((block[3] == 1, block[0]))  # blocks are in order already
    block = [x[by] for x in block]
    again = follows[block[0]] if n_classes else np.zeros(0, bool)
    single = np.arange(n_classes, n_all)
    symbol = (int(code.max()) if len(code) else 0) + 3 + np.arange(len(lone))
    strings = np.concatenate([block[0], n_all + block[0][again], single, n_all + single])
    starts = np.concatenate([block[1], block[1][again], *[-left[lone].astype(np.int64)] * 2])
    ends = np.concatenate([block[2], block[2][again], *[right[lone].astype(np.int64)] * 2])
    symbols = np.concatenate([block[3], block[3][again], symbol, symbol])
    ranks = np.append(rank[leader], n + rank[leader])[strings]
    string, a, z = matched(symbols, starts, ends, ranks, strings)
    # what goes to whom: the first occurrence of a class; the others of it; and what follows each
    lead = string < n_all
    of_class = np.argsort(kind[has], kind="stable")
    members, begin = has[of_class], np.searchsorted(kind[has][of_class], np.arange(n_all + 1))
    which = string[~lead] - n_all
    times = begin[which + 1] - begin[which]
    to = members[np.repeat(begin[which] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
    a_to, z_to, of_to = (np.repeat(x, times) for x in (a[~lead], z[~lead], which))
    others, followed = leader[of_to] != to, copies[to]
    row = np.concatenate([leader[string[lead]], to[others], to[followed]])
    later = np.repeat([False, True], [int(lead.sum()) + int(others.sum()), int(followed.sum())])
    a, z = np.concatenate([a[lead], a_to[others], a_to[followed]]), np.concatenate([z[lead], z_to[others], z_to[followed]])
    return _batch(_VERDICT, h[row], ctx[row], later, a.astype(np.int32), z.astype(np.int32))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of contexts sorted by h: what they lose."""
    held: list[pa.RecordBatch] = []
    size = 0

    def judged(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        x = [t.column(c).to_numpy() for c in ("h", "ctx", "left", "doc_id", "text_hash", "at", "copies", "right")]
        return judged_contexts(*x[:3], t.column("context").to_pylist(), *x[3:])

    for b in batches:
        h = b.column(0).to_numpy()
        start = 0
        if held:  # the anchor that the rows before end with may go on
            same = int(np.searchsorted(h, held[-1].column(0)[-1].as_py(), side="right"))
            held.append(b.slice(0, same))
            size += same
            start = same
            if same == len(h):
                continue
            if size >= CHUNK:
                yield judged(held)
                held, size = [], 0
        while len(h) - start >= CHUNK:
            end = int(np.searchsorted(h, h[start + CHUNK - 1], side="right"))
            if end == len(h):
                break
            yield judged([*held, b.slice(start, end - start)])
            held, size, start = [], 0, end
        if start < len(h):
            held.append(b.slice(start))
            size += len(h) - start
    if held:
        yield judged(held)


def _kept(raw: bytes, cuts: list[int]) -> bytes:
    return b"".join(raw[a:z] for a, z in zip([0, *cuts[1::2]], [*cuts[::2], len(raw)]))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, 256):
            part = b.slice(start, 256)
            rows = []
            spans, ends = part.column(3).flatten(), np.cumsum(part.column(3).value_lengths().to_numpy())
            a, z = (spans.field(c).to_numpy() for c in ("a", "z"))
            for raw, end, n in zip(part.column(2).cast(pa.binary()).to_pylist(), ends.tolist(), part.column(3).value_lengths().to_pylist()):
                by = np.argsort(a[end - n : end], kind="stable")
                x, y = a[end - n : end][by], np.maximum.accumulate(z[end - n : end][by])
                new = np.append(True, x[1:] > y[:-1])
                cuts = np.stack([x[new], y[np.append(new[1:], True)]], 1).ravel().tolist()
                kept = _kept(raw or b"", cuts)
                rows.append((cuts, hashlib.sha256(kept).hexdigest(), len(raw or b"") - len(kept)))
            cuts, sha, removed = zip(*rows)
            yield _batch(_JUDGED, part.column(0), part.column(1), pa.array(cuts, pa.list_(pa.int64())), pa.array(sha), pa.array(removed, pa.int64()))


def among(base: DataFrame, wanted: DataFrame, most_words: int = 1 << 22, mark: str | None = None) -> DataFrame:
    """base (doc_id, text_hash, others) without most of the documents that ``wanted`` lacks, so that texts not needed stay where they are.

    By a Bloom filter of ten bits a document, of 32 MB at most: with very many documents it lets more of the others pass.
    mark: all rows stay, and this column says whether the filter lets them pass.
    """
    key = lambda: F.concat_ws(":", "doc_id", "text_hash")
    total = min(most_words, max(1, -(-10 * wanted.count() // 64)))
    chunks = -(-total // (1 << 16))
    f = Filter(0, 0, chunks, -(-total // chunks), 3)
    bits = durable(filter_level(wanted.select(F.lit(0).alias("list"), key().alias("key")), {0: f}, most_words), "documents-with-repeats")
    passes = f.passes(key(), F.col("bits"))
    held = base.withColumn("bits", bits.scalar())
    return (held.filter(passes) if mark is None else held.withColumn(mark, passes)).drop("bits")


def _dense_verdicts(contexts: DataFrame) -> DataFrame:
    """What contexts lose of anchors with too many: each window is a context of its own, and its first occurrence a partial minimum."""
    n = F.octet_length("context") - WINDOW
    each = contexts.filter(n >= 0).withColumn("o", F.explode(F.sequence(F.lit(0), n)))
    own = F.struct("doc_id", "text_hash", (F.col("at") - F.col("left") + F.col("o")).alias("at"))
    each = each.select("h", "ctx", "copies", F.substr("context", F.col("o") + 1, F.lit(WINDOW)).alias("window"), own.alias("own"), (F.col("o") - F.col("left")).alias("a"))
    first = each.groupBy("window").agg(F.min("own").alias("least"), ((F.count(F.lit(1)) > 1) | F.max("copies")).alias("several"))
    as_context = first.select(F.xxhash64("window").alias("h"), F.xxhash64("window", F.lit(1)).alias("ctx"), F.lit(0).alias("left"), F.col("window").alias("context"), "least.*", F.col("several").alias("copies"), F.lit(WINDOW).cast("byte").alias("right"))
    lost = _verdicts(as_context).filter("later").select(F.col("h").alias("h_window"), F.col("ctx").alias("ctx_window"))
    told = each.join(first.select("window", "least"), "window").withColumns({"h_window": F.xxhash64("window"), "ctx_window": F.xxhash64("window", F.lit(1))}).join(lost, ["h_window", "ctx_window"])
    which = F.explode(F.array_compact(F.array(F.when(F.col("least") < F.col("own"), F.lit(False)), F.when(F.col("copies"), F.lit(True)))))
    return told.select("h", "ctx", which.alias("later"), "a", (F.col("a") + WINDOW).alias("z"))


def _verdicts(contexts: DataFrame) -> DataFrame:
    dealt = contexts.select("h", "ctx", "left", "context", "doc_id", "text_hash", "at", "copies", "right").repartition("h").sortWithinPartitions("h")
    return dealt.mapInArrow(_compare, _VERDICT)


def _base(docs: DataFrame) -> DataFrame:
    return texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")


def judged(docs: DataFrame) -> DataFrame:
    """doc_id (null as NO_ID), text_hash, cuts (starts and ends of what goes), kept_sha256 and n_removed, of the texts that lose something."""
    base = _base(docs)
    found = base.select("doc_id", "text", "text_hash").mapInArrow(_anchor_rows, _ANCHOR)
    meeting = F.when(F.col("flags") == 1, F.xxhash64("doc_id", "h")).otherwise(F.col("h"))
    occurrences = durable(found.repartition(meeting).sortWithinPartitions("h", "ctx").mapInArrow(_occurrences, _OCCURRENCE), "occurrences")
    by = ["doc_id", "text_hash"]
    # each step leaves a narrow table, and what it dealt out goes with it: texts move for the contexts and again for the spans, never with both
    firsts, lone = occurrences.filter(~F.col("later")), F.col("lone") & F.col("copies")
    compared = firsts.filter(~lone)
    places = compared.groupBy(*by).agg(F.collect_list(F.struct("at", "h", "ctx", "copies", "dense")).alias("places"))  # of one text
    contexts = among(base, compared.select(*by).distinct()).join(places, by).select(*by, "text", "places").mapInArrow(_context_rows, _CONTEXT)
    # an anchor's only context differs from no other: its length is enough
    left = F.least("at", F.lit(LEFT)).cast("int").alias("left")
    alone = firsts.filter(lone).select("h", "ctx", left, F.lit(None).cast("binary").alias("context"), *by, "at", "copies", "dense", "right")
    many = None
    if occurrences.filter("dense").limit(1).count():
        many = durable(contexts, "contexts")
        verdicts = _verdicts(many.filter(~F.col("dense")).unionByName(alone)).unionByName(_dense_verdicts(many.filter("dense")))
    else:
        verdicts = _verdicts(contexts.unionByName(alone))
    verdicts = durable(verdicts, "verdicts")
    if many is not None:
        discard(many)
    spans = occurrences.select("h", "ctx", "later", *by, "at").join(verdicts, ["h", "ctx", "later"])
    spans = spans.groupBy(*by).agg(F.collect_list(F.struct((F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("z")).alias("z"))).alias("spans"))  # of one text
    spans = durable(spans, "spans")
    discard(occurrences)
    discard(verdicts)
    out = durable(among(base, spans.select(*by)).join(spans, by).select(*by, "text", "spans").mapInArrow(_judge, _JUDGED), "judged")
    discard(spans)
    return out


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raws = [x or b"" for x in b.column(2).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(map(len, raws)), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raws], pa.string())], ["doc_id", "text_hash", "n_bytes", "whole_sha256"])


def dedup_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of every row."""
    whole = _base(docs).mapInArrow(_whole, "doc_id long, text_hash long, n_bytes long, whole_sha256 string")
    lost = judged(docs).groupBy("doc_id", "text_hash").agg(F.first("kept_sha256").alias("kept"), F.first("n_removed").alias("n_removed"), F.first(F.size("cuts")).alias("n_cuts"))
    j = whole.join(lost, ["doc_id", "text_hash"], "left")
    return j.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce((F.col("n_cuts") / 2).cast("long"), F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept", "whole_sha256").alias("kept_sha256"),
    )


def dedup_texts(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes taken out of text; all other columns as they were.

    A cut can split a character's bytes; such a remnant is dropped. n_chars, if there is one, is counted anew.
    """
    lost = judged(docs).groupBy(F.col("doc_id").alias("lost_id"), F.col("text_hash").alias("lost_hash")).agg(F.first("cuts").alias("cuts"))
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called, they do not clash
    own_id, own_text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    carried = docs.toDF(*names).withColumns({"lost_id": F.coalesce(own_id.cast("long"), F.lit(NO_ID)), "lost_hash": F.xxhash64(F.coalesce(own_text.cast("string"), F.lit("")))})

    @F.pandas_udf("string")
    def cut(text, cuts):
        import pandas as pd

        return pd.Series([t if x is None or t is None else _kept(t.encode(), list(x)).decode("utf-8", "ignore") for t, x in zip(text, cuts)], dtype=object)

    out = carried.join(lost, ["lost_id", "lost_hash"], "left").withColumn("kept_text", cut(own_text, F.col("cuts")))
    columns = []
    for n, f in zip(names, docs.schema.fields):
        columns.append(F.col("kept_text").alias(f.name) if f.name == "text" else F.length("kept_text").cast(f.dataType).alias(f.name) if f.name == "n_chars" else F.col(n).alias(f.name))
    return out.select(*columns)
