"""Token-id blocks, compressed by an adaptive context-mixing range coder.

Texts become token ids of a public byte-level BPE; documents are laid end to
end in blocks, each coded on its own and checksummed.

Model.  Orders 0, 1 and 2 each predict the next id by how often ids followed
the last none, one and two ids in the block so far.  Orders 1 and 2 count the
last ``window1`` and ``window2`` occurrences of the context, up to date at every
id; order 0 counts all, up to date every ``refresh`` ids.  The three distributions
are mixed linearly.  An order's weight depends on how often its context occurred
and how often what followed was new; it is learnt within the block, from the
share that the order had in what came, and brought up to date every
``mix_refresh`` ids.

Coder.  A carry-propagating range coder with 48-bit state, driven by the mixed
cumulative frequencies.  Each block has ``lanes`` coders that take the ids in
turn.  What the model says of every position follows from the block's ids by
sorting, so that encoding is numpy over whole blocks, and the coders of many
blocks step together.  Decoding goes id by id within a block; blocks are
independent, so that they are decoded in parallel.
"""

from __future__ import annotations

import base64
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabulary lies; a parameter, as the file is no part of this
#: repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


_MIX, _TOTAL = 15, 30
#: Least share of order 0, in 2**30ths, so that every id has a part.
_FLOOR = 1 << 21


@dataclass(frozen=True)
class StoreRules:
    """``block_tokens``: most ids of a block, 65,536 at most; a longer document
    continues in the next.  ``ids``: size of the id space.  ``gain``: weight of
    one occurrence in order 0, where a new id's is 1 or more.
    ``prior``: occurrences that an order's first weight counts for."""

    vocabulary: str = VOCABULARY
    block_tokens: int = 65_536
    lanes: int = 64
    refresh: int = 1024
    mix_refresh: int = 2048
    window1: int = 72
    window2: int = 32
    ids: int = 50_257
    gain: int = 24
    prior: int = 4
    batch_blocks: int = 32

    def __post_init__(self) -> None:
        if not 0 < self.block_tokens <= 65_536 or self.gain * 65_536 + self.ids > _FLOOR:
            raise ValueError("a block has 1 to 65,536 ids, and all counts fit the least share of order 0")
        if not (0 < self.window1 < 256 and 0 < self.window2 < 256):
            raise ValueError("windows are from 1 to 255")


# ---------------------------------------------------------------- tokenizing


def vocabulary(path: str) -> bytes:
    """The file's content, read where the plan is made: executors get it with
    the task and need no such file."""
    with open(path, "rb") as f:
        return f.read()


def encoder(data: bytes):
    """tiktoken's encoder of a file of base64 tokens and ranks.  It is kept at
    the library's module, which outlives a task in its worker, unlike the
    globals of a function that came with the task."""
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_vectrail_encoders", {})
    key = zlib.crc32(data), len(data)
    if key not in kept:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        kept[key] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[key]


class Tokenizer:
    """Token ids of whole batches.  The pattern always breaks before a single
    space, so texts are cut there and each distinct piece is encoded once, many
    at a time between line breaks; a text with two white spaces in a row is
    encoded as it is."""

    def __init__(self, data: bytes, remember: int = 250_000) -> None:
        self.encoder = encoder(data)
        self.line = self.encoder.encode_ordinary("\n")[0]
        self.remember = remember
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start = np.zeros(1 << 16, np.uint16), np.zeros(1 << 14, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.encoder.encode_ordinary(text), np.uint16)

    def learn(self, pieces: list[str]) -> None:
        plain = [p for p in pieces if "\n" not in p and p]
        ids, sizes = np.zeros(0, np.uint16), np.zeros(0, np.int64)
        if plain:
            joined = self.whole("\n".join(plain))
            breaks = np.flatnonzero(joined == self.line)
            ids = joined[joined != self.line]
            sizes = np.diff(np.concatenate(([-1], breaks, [len(joined)]))) - 1
        odd = [p for p in pieces if "\n" in p or not p]
        own = [self.whole(p) for p in odd]
        ids, sizes = np.concatenate([ids, *own]), np.concatenate([sizes, [len(x) for x in own]]).astype(np.int64)
        n, k = len(self.known), len(sizes)
        while len(self.start) < n + k + 1:
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.start[n + 1 : n + k + 1] = self.start[n] + np.cumsum(sizes)
        while len(self.flat) < self.start[n + k]:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.start[n] : self.start[n + k]] = ids
        self.known.update(zip(plain + odd, range(n, n + k)))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text (null counts as empty)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        odd = pc.match_substring_regex(texts, r"\s\s|^\s|\s$|[^\S \n]|[\x{80}-\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]").to_numpy(zero_copy_only=False).astype(bool)
        easy = texts.filter(pa.array(~odd)) if odd.any() else texts
        parts = pc.split_pattern(easy, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        words = parts.flatten()
        coded = words.dictionary_encode()
        unique, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        heads = offsets[:-1]
        mark = np.zeros(len(index), bool)
        mark[heads] = True
        # Every distinct piece with its space; a text's first piece without.
        if len(self.known) + len(unique) > self.remember:
            self.forget()
        get = self.known.get
        first = np.unique(index[heads])
        wanted = [" " + u for u in unique] + [unique[k] for k in first.tolist()]
        if new := list(dict.fromkeys(w for w in wanted if w not in self.known)):
            self.learn(new)
        place = np.fromiter(map(get, wanted), np.int64, len(wanted))
        which = place[index]
        which[heads] = place[len(unique) :][np.searchsorted(first, index[heads])]
        lo = self.start[which]
        size = self.start[which + 1] - lo
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(lo - (ends - size), size)
        at += np.arange(total)
        ids = self.flat[at]
        cut = np.concatenate(([0], ends))[offsets]
        lengths = np.diff(cut)
        if not odd.any():
            return ids, lengths
        rest = iter(np.split(ids, cut[1:-1])) if len(easy) else iter(())
        out = [self.whole(texts[i].as_py()) if o else next(rest) for i, o in enumerate(odd.tolist())]
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)


def id_count(spark: SparkSession, text: Column, rules: StoreRules = StoreRules()) -> Column:
    """How many ids a text has; 0 for a null or empty one."""
    words = spark.sparkContext.broadcast(vocabulary(rules.vocabulary))  # one file of fixed size

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = Tokenizer(words.value, 100_000)
        for b in batches:
            parts = [tokenizer.batch(b.slice(first, 1024))[1] for first in range(0, len(b), 1024)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))
        # Workers outlive their tasks; what Arrow holds back would add up.
        pa.default_memory_pool().release_unused()

    return count(text)


# --------------------------------------------------------------------- model


def _sorted_places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (48 bits) in order, and the places of at most 65,536 that they come
    from; equal keys by place."""
    s = np.sort((key << np.uint64(16)) | np.arange(len(key), dtype=np.uint64))
    return s >> np.uint64(16), (s & np.uint64(0xFFFF)).astype(np.int64)


def _starts(key: np.ndarray) -> np.ndarray:
    """Where the run of equal keys that holds each place begins."""
    n = np.arange(len(key))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    return np.maximum.accumulate(np.where(fresh, n, 0))


def _history(context: np.ndarray, x: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """For each place of a block: how many earlier ones have its context; of the
    last ``window`` of these, how many have this id and how many a smaller one;
    and how often among all earlier ones an id came that its window lacked."""
    n = len(x)
    key, at = _sorted_places(context)
    start = _starts(key)
    ids = x.astype(np.uint16)[at]
    count = np.arange(n) - start
    near = np.minimum(count, 255).astype(np.uint8)
    same, less = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    size = np.bincount(start, minlength=n)[start]
    d, longest = 1, int(size.max())
    for most in (8, 24, 64, window):
        # From here on in the runs that are long enough.
        most = min(most, window, longest - 1)
        if d > most:
            continue
        own = slice(None) if d == 1 else np.flatnonzero(size > d)
        v, k = ids[own], near[own]
        equal, below = np.zeros(len(v), np.uint8), np.zeros(len(v), np.uint8)
        some, mine = np.empty(len(v), bool), np.empty(len(v), bool)
        for d in range(d, most + 1):
            # The d-th before, where there is one: a window's sum stays below 256.
            ok, hit, old, new = mine[d:], some[d:], v[:-d], v[d:]
            np.greater_equal(k[d:], d, out=ok)
            np.equal(old, new, out=hit)
            hit &= ok
            equal[d:] += hit.view(np.uint8)
            np.less(old, new, out=hit)
            hit &= ok
            below[d:] += hit.view(np.uint8)
        same[own] += equal
        less[own] += below
        d = most + 1
    fresh = np.cumsum(same == 0) - (same == 0)
    out = []
    for v in (count, same, less, fresh - fresh[start]):
        w = np.empty(n, np.int32)
        w[at] = v
        out.append(w)
    return tuple(out)


#: Mixing contexts: 0 for a context not met before, else by the logarithms of
#: how often it was and of how often what followed was new.
_CONTEXTS = 49
_LOG = np.zeros(65_537, np.int32)
for _k in range(1, 17):
    _LOG[1 << _k :] = _k
_ONE = 1 << _MIX
#: An order's weight before anything is known, in 2**15ths, by mixing context.
_FIRST = np.array([0] + [(_ONE << i + 1) // ((2 << i) + (3 << j)) for i in range(8) for j in range(6)])


def _context(count: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    return np.where(count == 0, 0, 1 + np.minimum(_LOG[count], 7) * 6 + np.minimum(_LOG[fresh], 5))


def _base(kinds: int, r: StoreRules) -> int:
    """What every id counts for in order 0 beside its occurrences: in all about
    as much as the first occurrences, which tell how often a new one comes."""
    return max(1, (r.gain * kinds + r.ids // 2) // r.ids)


def _part(a: np.ndarray, b: np.ndarray | int, n: np.ndarray) -> np.ndarray:
    """a * b // n.  Products are below 2**52, quotients at most 2**30 and n
    below 2**22: what is off a whole number is so by 2**-22 at least, so that the
    truncated quotient of doubles is exact."""
    return (a * b / n).astype(np.int64)


def _weights(share: np.ndarray, seen: np.ndarray, r: StoreRules) -> np.ndarray:
    """By mixing context, in 2**15ths; 0 for a context not met before."""
    w = ((share + r.prior * _FIRST) << _MIX) // (seen + (r.prior << _MIX))
    w[0] = 0
    return w


def decisions(x: np.ndarray, r: StoreRules) -> tuple[np.ndarray, np.ndarray]:
    """(low, width) in 2**30ths of every id of a block under the mixture.  Whole
    numbers only: the decoder gets the same."""
    n = len(x)
    p1 = np.empty(n, np.uint64)
    p1[0], p1[1:] = r.ids, x[:-1]
    p2 = np.empty(n, np.uint64)
    p2[0], p2[1:] = r.ids, p1[:-1]
    # Ids by rank among those that occur.
    seen = np.zeros(1 << 16, bool)
    seen[x] = True
    used = np.flatnonzero(seen)
    rank = (np.cumsum(seen) - 1)[x]
    orders = []
    for context, window in ((p1, r.window1), ((p2 << np.uint64(17)) | p1, r.window2)):
        count, same, less, fresh = _history(context, rank, window)
        orders.append((np.clip(count, 1, window), same, less, _context(count, fresh)))
    (n1, same1, less1, b1), (n2, same2, less2, b2) = orders
    # Order 0 over the ids that occur; every id has a base besides.
    cum, own, total = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    met = np.zeros(len(used) + 1, np.int64)
    ids = x.astype(np.int64)
    for a in range(0, n, r.refresh):
        part = rank[a : a + r.refresh]
        up, base = np.cumsum(met), _base(int(np.count_nonzero(met)), r)
        cum[a : a + r.refresh] = base * ids[a : a + r.refresh] + r.gain * up[part]
        own[a : a + r.refresh] = base + r.gain * met[part + 1]
        total[a : a + r.refresh] = base * r.ids + r.gain * a
        met[1:] += np.bincount(part, minlength=len(used))
    low, width = np.empty(n, np.int64), np.empty(n, np.int64)
    s1, t1, s2, t2 = (np.zeros(_CONTEXTS, np.int64) for _ in range(4))
    scale = (1 << _TOTAL) - _FLOOR
    for a in range(0, n, r.mix_refresh):
        i = slice(a, min(n, a + r.mix_refresh))
        c1, c2 = b1[i], b2[i]
        w2, w1 = _weights(s2, t2, r)[c2], _weights(s1, t1, r)[c1]
        a2 = (w2 * scale) >> _MIX
        a1 = ((_ONE - w2) * w1 >> _MIX) * scale >> _MIX
        a0 = (1 << _TOTAL) - a2 - a1
        lo2, lo1, lo0 = _part(a2, less2[i], n2[i]), _part(a1, less1[i], n1[i]), _part(a0, cum[i], total[i])
        e2 = _part(a2, less2[i] + same2[i], n2[i]) - lo2
        e1 = _part(a1, less1[i] + same1[i], n1[i]) - lo1
        e0 = _part(a0, cum[i] + own[i], total[i]) - lo0
        low[i], width[i] = lo2 + lo1 + lo0, e2 + e1 + e0
        r2 = _part(e2, _ONE, width[i])
        r1 = _part(e1, _ONE, e1 + e0)
        rest = _ONE - r2
        # Sums stay far below 2**53.
        s2 += np.bincount(c2, r2, _CONTEXTS).astype(np.int64)
        t2 += np.bincount(c2, minlength=_CONTEXTS) << _MIX
        s1 += np.bincount(c1, r1 * rest >> _MIX, _CONTEXTS).astype(np.int64)
        t1 += np.bincount(c1, rest, _CONTEXTS).astype(np.int64)
    return low, width


# --------------------------------------------------------------------- coder

_TOP, _BOTTOM = np.uint64(48), np.uint64(32)


def _code(low_in: np.ndarray, width_in: np.ndarray, count: np.ndarray) -> list[bytes]:
    """Range-code many lists of decisions side by side: (steps, lanes), of
    which lane k has count[k].  Lanes stand in descending order of count."""
    longest, n = low_in.shape
    low, span = np.zeros(n, np.uint64), np.full(n, (1 << 48) - 1, np.uint64)
    words, used = np.zeros((n, longest * 2 + 5), np.uint32), np.ones(n, np.int64)  # word 0 takes no carry
    active = np.searchsorted(-count, -np.arange(longest), side="left")
    mask, shift, total = np.uint64((1 << 48) - 1), np.uint64(16), np.uint64(_TOTAL)
    least = np.uint64(1 << 32)
    for t in range(longest):
        k = int(active[t])
        lo, sp = low[:k], span[:k]
        sp >>= total
        lo += sp * low_in[t, :k]
        sp *= width_in[t, :k]
        over = np.flatnonzero(lo > mask)
        if len(over):
            words[over, used[over] - 1] += 1
            lo[over] &= mask
        small = np.flatnonzero(sp < least)
        while len(small):
            l, u = lo[small], used[small]
            words[small, u] = l >> _BOTTOM
            used[small] = u + 1
            lo[small] = (l << shift) & mask
            s = sp[small] << shift
            sp[small] = s
            small = small[s < least]
    rows = np.arange(n)
    for _ in range(3):
        words[rows, used] = low >> _BOTTOM
        used += 1
        low = (low << shift) & mask
    out: list[bytes] = []
    for k in range(n):
        w = words[k, : used[k]]
        for j in np.flatnonzero(w > 0xFFFF)[::-1].tolist():
            while w[j] > 0xFFFF:
                w[j] -= 0x10000
                j -= 1
                w[j] += 1
        end = len(w)
        while end > 1 and w[end - 1] == 0:
            end -= 1  # the decoder reads zeros past the end
        out.append(w[1:end].astype(">u2").tobytes())
    return out


class _Decoder:
    def __init__(self, data: bytes) -> None:
        self.words = struct.unpack(f">{len(data) // 2}H", data)
        self.at, self.span, self.code = 0, (1 << 48) - 1, 0
        for _ in range(3):
            self.code = self.code << 16 | self._next()

    def _next(self) -> int:
        self.at += 1
        return self.words[self.at - 1] if self.at <= len(self.words) else 0

    def peek(self) -> int:
        self.span >>= _TOTAL
        return min((1 << _TOTAL) - 1, self.code // self.span)

    def take(self, low: int, width: int) -> None:
        self.code -= low * self.span
        self.span *= width
        while self.span < 1 << 32:
            self.code = self.code << 16 | self._next()
            self.span <<= 16


_HEAD = "<4sIIHH"


def encode_blocks(blocks: list[np.ndarray], r: StoreRules) -> list[bytes]:
    """Each block by itself: header, lane lengths, lanes."""
    longest = max((-(-len(x) // r.lanes) for x in blocks), default=0)
    lanes = len(blocks) * r.lanes
    low, width = np.zeros((longest, lanes), np.uint32), np.ones((longest, lanes), np.uint32)
    count = np.zeros(lanes, np.int64)
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    for k, i in enumerate(order):
        x = blocks[i]
        if not len(x):
            continue
        # Lane j takes every lanes-th id from j on: a row of the table is a step.
        full = len(x) // r.lanes
        at = slice(k * r.lanes, (k + 1) * r.lanes)
        for to, v in zip((low, width), decisions(x, r)):
            to[:full, at] = v[: full * r.lanes].reshape(full, r.lanes)
            to[full : full + 1, k * r.lanes : k * r.lanes + len(x) - full * r.lanes] = v[full * r.lanes :]
        count[at] = full + (np.arange(r.lanes) < len(x) - full * r.lanes)
    by = np.argsort(-count, kind="stable")
    if (by != np.arange(lanes)).any():
        low, width, count = low[:, by], width[:, by], count[by]
    coded = [b""] * lanes
    for k, data in zip(by.tolist(), _code(low, width, count)):
        coded[k] = data
    out = [b""] * len(blocks)
    for k, i in enumerate(order):
        own = coded[k * r.lanes : (k + 1) * r.lanes]
        body = np.array([len(o) // 2 for o in own], "<u4").tobytes() + b"".join(own)
        x = blocks[i]
        out[i] = struct.pack(_HEAD, b"VTB2", len(x), zlib.crc32(body, zlib.crc32(x.astype("<u2").tobytes())), r.lanes, 0) + body
    return out


def decode_block(data: bytes, r: StoreRules = StoreRules()) -> np.ndarray:
    """The ids of a block; ValueError if its checksum doesn't hold."""
    if len(data) < struct.calcsize(_HEAD):
        raise ValueError("a block is cut short")
    magic, n, crc, lanes, _ = struct.unpack_from(_HEAD, data)
    body = data[struct.calcsize(_HEAD) :]
    if magic != b"VTB2" or len(body) < 4 * lanes:
        raise ValueError("not a block")
    at, coders = 4 * lanes, []
    for k in np.frombuffer(body, "<u4", lanes).tolist():
        coders.append(_Decoder(body[at : at + 2 * k]) if at + 2 * k <= len(body) else None)
        at += 2 * k
    if at != len(body):
        raise ValueError("a block is cut short")
    try:
        ids = _decode(n, coders, r)
    except (IndexError, ZeroDivisionError) as e:
        raise ValueError("a block is damaged") from e
    if zlib.crc32(body, zlib.crc32(np.array(ids, "<u2").tobytes())) != crc:
        raise ValueError("a block's checksum doesn't hold")
    return np.array(ids, np.uint16)


def _decode(n: int, coders: list[_Decoder], r: StoreRules) -> list[int]:
    ids: list[int] = []
    # Context -> the ids of its window as they came, the same in order, how often
    # it occurred, how often what followed was new.
    known1: dict = {}
    known2: dict = {}
    s1, t1, s2, t2 = (np.zeros(_CONTEXTS, np.int64) for _ in range(4))
    new1, tot1, new2, tot2 = ([0] * _CONTEXTS for _ in range(4))
    weight1 = weight2 = [0] * _CONTEXTS
    counts, cum, total = np.zeros(r.ids + 1, np.int64), [], 0
    p1 = p2 = r.ids
    scale, log = (1 << _TOTAL) - _FLOOR, _LOG.tolist()
    for t in range(n):
        if t % r.refresh == 0:
            if t:
                counts[1:] += np.bincount(ids[t - r.refresh :], minlength=r.ids)
            cum = (r.gain * np.cumsum(counts) + _base(int(np.count_nonzero(counts)), r) * np.arange(r.ids + 1)).tolist()
            total = cum[-1]
        if t % r.mix_refresh == 0:
            for to, part in ((s1, new1), (t1, tot1), (s2, new2), (t2, tot2)):
                to += np.array(part)
                part[:] = [0] * _CONTEXTS
            weight1, weight2 = _weights(s1, t1, r).tolist(), _weights(s2, t2, r).tolist()
        e, g = known1.get(p1), known2.get((p2, p1))
        l1, c1 = (e[1], 1 + min(log[e[2]], 7) * 6 + min(log[e[3]], 5)) if e else ((), 0)
        l2, c2 = (g[1], 1 + min(log[g[2]], 7) * 6 + min(log[g[3]], 5)) if g else ((), 0)
        n1, n2, w1, w2 = len(l1), len(l2), weight1[c1], weight2[c2]
        a2 = (w2 * scale) >> _MIX
        a1 = ((_ONE - w2) * w1 >> _MIX) * scale >> _MIX
        a0 = (1 << _TOTAL) - a2 - a1
        n1, n2 = n1 or 1, n2 or 1
        coder = coders[t % len(coders)]
        v = coder.peek()
        # The last id whose interval begins at v or before.
        x, top = 0, r.ids
        at = (0, 0, 0)
        while top - x > 1:
            mid = (x + top) >> 1
            m2, m1, m0 = a2 * bisect_left(l2, mid) // n2, a1 * bisect_left(l1, mid) // n1, a0 * cum[mid] // total
            if m2 + m1 + m0 <= v:
                x, at = mid, (m2, m1, m0)
            else:
                top = mid
        e2 = a2 * bisect_right(l2, x) // n2 - at[0]
        e1 = a1 * bisect_right(l1, x) // n1 - at[1]
        e0 = a0 * cum[x + 1] // total - at[2]
        coder.take(sum(at), e2 + e1 + e0)
        r2 = (e2 << _MIX) // (e2 + e1 + e0)
        new2[c2] += r2
        tot2[c2] += _ONE
        new1[c1] += (e1 << _MIX) // (e1 + e0) * (_ONE - r2) >> _MIX
        tot1[c1] += _ONE - r2
        for known, key, own, window in ((known1, p1, e, r.window1), (known2, (p2, p1), g, r.window2)):
            if own is None:
                known[key] = [deque((x,)), [x], 1, 1]
                continue
            came, order = own[0], own[1]
            place = bisect_left(order, x)
            if place == len(order) or order[place] != x:
                own[3] += 1
            own[2] += 1
            order.insert(place, x)
            came.append(x)
            if len(came) > window:
                del order[bisect_left(order, came.popleft())]
        ids.append(x)
        p2, p1 = p1, x
    return ids


# ----------------------------------------------------------------- operators


def token_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: StoreRules = StoreRules()) -> DataFrame:
    """(``shard``, ``block``, ``doc_ids``, ``n_tokens``, ``continued``,
    ``tokens``, ``payload``): a row for each block of a shard, in order.

    A shard is a task's part of the input, so it follows the input's layout.
    ``n_tokens`` has the ids of each
    document in this block; ``continued`` says that the first document began in
    the block before.  A null or empty text has no ids but keeps its place in
    the lists, as do repeated rows and null ids.  No rows give no blocks.  Other
    columns are not read.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)),
            T.StructField("n_tokens", T.ArrayType(T.LongType())), T.StructField("continued", T.BooleanType()),
            T.StructField("tokens", T.LongType()), T.StructField("payload", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(words.value)
        limit, number = rules.block_tokens, 0
        names, counts, ids, held, continued = [], [], [], 0, False
        ready: list[tuple] = []

        def close() -> None:
            nonlocal names, counts, ids, held
            ready.append((names, counts, continued, np.concatenate(ids) if ids else np.zeros(0, np.uint16)))
            names, counts, ids, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number
            payload = encode_blocks([x[3] for x in ready], rules)
            found = pa.RecordBatch.from_arrays(
                [
                    pa.array(range(number, number + len(ready)), pa.int64()), pa.array([x[0] for x in ready], arrow_list),
                    pa.array([x[1] for x in ready], pa.list_(pa.int64())), pa.array([x[2] for x in ready]),
                    pa.array([len(x[3]) for x in ready], pa.int64()), pa.array(payload, pa.binary()),
                ],
                names=schema.names,
            )
            number += len(ready)
            ready.clear()
            return found

        for b in batches:
            for first in range(0, b.num_rows, 2048):
                part = b.slice(first, 2048)
                flat, lengths = tokenizer.batch(part.column(1))
                cut = np.concatenate(([0], np.cumsum(lengths))).tolist()
                for k, name in enumerate(part.column(0).to_pylist()):
                    at, end = cut[k], cut[k + 1]
                    if held and held + end - at > limit:
                        close()
                        continued = False
                    while end - at > limit:  # longer than a block
                        names.append(name)
                        counts.append(limit)
                        ids.append(flat[at : at + limit])
                        at += limit
                        close()
                        continued = True
                    names.append(name)
                    counts.append(end - at)
                    ids.append(flat[at:end])
                    held += end - at
                    if len(ready) >= rules.batch_blocks:
                        yield flush()
        if names:
            close()
        if ready:
            yield flush()
        # Workers outlive their tasks; what Arrow holds back would add up.
        pa.default_memory_pool().release_unused()

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_list = pa.list_(to_arrow_type(kind))
    words = docs.sparkSession.sparkContext.broadcast(vocabulary(rules.vocabulary))  # one file of fixed size
    found = docs.select(id_col, text_col).mapInArrow(run, schema)
    return found.select(F.spark_partition_id().alias("shard"), "*")


def read_blocks(blocks: DataFrame, id_col: str = "doc_id", rules: StoreRules = StoreRules()) -> DataFrame:
    """(shard, block, place, id, ids) of each document's part of each block."""
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, block, names, counts, payload in zip(*(c.to_pylist() for c in b.columns)):
                ids, at = decode_block(payload, rules), np.concatenate(([0], np.cumsum(counts))).tolist()
                n = len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * n, pa.int32()), pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(names, b.schema.field("doc_ids").type.value_type), pa.array([ids[x:y].tolist() for x, y in zip(at, at[1:])], pa.list_(pa.int32()))],
                    names=["shard", "block", "place", id_col, "ids"],
                )

    return blocks.select("shard", "block", "doc_ids", "n_tokens", "payload").mapInArrow(run, f"shard int, block long, place int, `{id_col}` {kind}, ids array<int>")

