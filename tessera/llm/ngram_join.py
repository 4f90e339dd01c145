"""N-gram Jaccard self-join by universe-partition pigeonhole.

Sets of word shingles fall into size bands. The pairs whose smaller set lies in
band k differ in at most H(k) shingles, so when shingles are hashed into segments
with allowances v_i adding up to H + 1, some segment differs by less than v_i.
Segments with v = 1 are indexed as the subset of the set that falls into them;
v = 2 adds the neighbourhood of that subset with one shingle deleted; v = 0 is not indexed.
Two plans compete per band, by estimated records and chance candidates from the
corpus' own length histogram: H + 1 segments with v = 1, or half as many with
v = 2. In the first plan a weak segment, one that holds nothing or only one or two of the
corpus' most frequent shingles and so would match too much, gets v = 0 and its successor
v = 2: it is indexed only with the one-deletion neighbourhood of the next segment. (If
two sets agree on k weak segments and on no other, at most k - 1 segments differ by two or
more, so one of the k successors differs by at most one.) No link is lost under either
plan, whichever shingles count as frequent.

Equal sets become one class first. The index carries keys and ids only; small buckets of the same members are one, and these
meet sizes and sketches in a join. They rule most pairs out. If what is left has no cycle, its pairs are candidates; else each
set and the smallest doc_id of those that hold together are, and in large buckets each set and the best connected member, so
candidates grow with a bucket's members and not with their square. Sets that candidates hold together are verified in blocks of bounded size, those of
a large cluster within their block and with the cluster's best connected set. Then the sets of different
components that a large bucket or a candidate still ties are compared by sketches, size
band by size band, and what is left is verified between all blocks.
All verification is exact on whole texts. Numbers of links are added up inside the
blocks, so that the links of a large group are no rows unless ``links`` is asked for.

Defined results: a null or empty text has no shingles and is linked with nothing;
with fewer words than a shingle the whole sequence is the one shingle; a doc_id that is
null or no integer is linked with nothing and gets a null component; repeated rows are one
class; a doc_id stands for one text (of rows that repeat it with another text, one is
compared); columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.exchange import SCATTERED, bounded_batches, exchange, pack, partition_count, partition_ids, scatter, unpack, witnesses
from tessera.storage import discard, materialize

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_S33, _S29, _S32 = np.uint64(33), np.uint64(29), np.uint64(32)
VOCABULARY = 150_000
#: Records that a map task combines at once; shingles and sets of a block of texts; sets of a block of sketches.
FLUSH, BLOCK_SHINGLES, BLOCK_SETS, BLOCK_SKETCHES = 1_500_000, 150_000, 1_000, 2_048
#: Frequent shingles for the plans: at most so many, with at least so many documents, and repeated in a map task.
FREQUENT, FREQUENT_DOCS, REPEATED = 1 << 18, 128, 8
#: Members of a bucket up to which all its pairs are looked at, and that a map task sends on as they are. Larger buckets go by hubs.
SMALL_BUCKET, LOCAL_BUCKET = 64, 8
PAIRS_AT_ONCE = 1 << 17
#: Members of small buckets whose sketches a task holds at once.
MEMBERS_AT_ONCE = 1 << 14
#: For the plans only: bytes of a word, and how often two lone shingles are equal by chance.
WORD_BYTES, CHANCE = 6.5, 1e-4
CANDIDATE_COST = 50.0


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S33)) * _C
    x = (x ^ (x >> _S29)) * _B
    return x ^ (x >> _S32)


@dataclass(frozen=True)
class Join:
    """Shingle width and threshold ``num / den`` of the similarity."""

    width: int = 3
    num: int = 90
    den: int = 100
    lows: np.ndarray = field(init=False, compare=False)

    def __post_init__(self) -> None:
        lows = [1]
        while lows[-1] < 1 << 40:
            lows.append(max(lows[-1] + 1, -(-lows[-1] * self.den // self.num)))
        object.__setattr__(self, "lows", np.array(lows, np.int64))

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.lows, n, "right")) - 1

    def top(self, band: int) -> int:
        """The largest size in the band."""
        return int(self.lows[band + 1]) - 1

    def difference(self, band: int) -> int:
        """H: the most shingles by which a linked pair with its smaller set in the band can differ."""
        return self.top(band) * (self.den - self.num) // self.num

    def schemes(self, n: int) -> list[int]:
        """The bands under which a set of this size is indexed: its own, and the one below if it can reach down."""
        b = self.band(n)
        return [b, b - 1] if b and n * self.num <= self.top(b - 1) * self.den else [b]

    def linked(self, both: int, a: int, b: int) -> bool:
        return self.den * both >= self.num * (a + b - both)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text."""

    def __init__(self, width: int) -> None:
        self.width, self.words = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
        if not words:
            return np.empty(0, np.uint64)
        known = self.words
        if len(known) > VOCABULARY:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(h))
        n = len(h) - k + 1
        x = np.full(n, k, np.uint64)
        for i in range(k):
            x = _mix(x * _A + h[i : i + n])
        return np.unique(x)


def plans(join: Join, histogram: dict[int, int]) -> dict[int, bool]:
    """Band -> whether it takes the plan with v = 2; ``histogram``: documents by band, estimated."""
    out = {}
    for band, n in histogram.items():
        r, h = (int(join.lows[band]) + join.top(band)) / 2, join.difference(band)
        narrow = h + 1
        lam = r / narrow
        plain = n * narrow * (1 + math.exp(-lam) * (1 + lam)) + CANDIDATE_COST * n * n / 2 * narrow * (lam * math.exp(-lam)) ** 2 * CHANCE
        wide = (h + 2) // 2
        lam = r / wide
        deleted = n * (wide + r) + CANDIDATE_COST * n * n / 2 * wide * ((1 + lam) * math.exp(-lam)) ** 2
        out[band] = deleted < plain
    return out


def frequent(docs: DataFrame, width: int) -> np.ndarray:
    """The corpus' most frequent shingles, ascending: at most FREQUENT hashes, from counts over all documents.

    Map tasks count each of their distinct sets once and send on what repeats there. Only the cost of the index hangs on the result.
    """

    def count(sets: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(sets), return_counts=True)
        chosen = n >= REPEATED
        return pa.RecordBatch.from_arrays([pa.array(h[chosen].view(np.int64)), pa.array(n[chosen].astype(np.int64))], names=["h", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        held: dict[bytes, np.ndarray] = {}
        size = 0
        for b in batches:
            for text in b.column(0):
                x = shingles(text.as_py())
                if len(x) and (digest := xxhash.xxh3_128_digest(x)) not in held:
                    held[digest] = x
                    size += len(x)
                    if size > FLUSH:
                        yield count(list(held.values()))
                        held, size = {}, 0
        if held:
            yield count(list(held.values()))

    counts = docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT_DOCS)
    top = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).select("h").toArrow()  # at most FREQUENT numbers
    return np.sort(top.column(0).to_numpy().astype(np.int64).view(np.uint64))


def signatures(join: Join, x: np.ndarray, wide_plan: dict[int, bool], common: np.ndarray | None = None) -> np.ndarray:
    """The index keys of a set under all its schemes; ``common``: the frequent shingles, ascending."""
    out = []
    mixed = _mix(x + _A)
    value = _mix(mixed ^ _B)
    rare = None
    if common is not None and len(common):
        rare = common[np.minimum(np.searchsorted(common, x), len(common) - 1)] != x
        if rare.all():
            rare = None
    for band in join.schemes(len(x)):
        h = join.difference(band)
        wide = wide_plan.get(band, False)
        m = (h + 2) // 2 if wide else h + 1
        segment = (((mixed >> _S32) * np.uint64(m)) >> _S32).astype(np.int64)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, segment, value)
        salt = _mix((np.arange(m, dtype=np.uint64) + np.uint64(1)) * _A + np.uint64(band))
        if wide:
            out.append(_mix(sums + salt))
            # with an odd H + 1 the last segment has v = 2 as well, which only adds candidates
            out.append(_mix(sums[segment] - value + salt[segment]))
            continue
        size = np.bincount(segment, minlength=m)
        weak = size == 0
        if rare is not None:
            weak |= (size <= 2) & (np.bincount(segment[rare], minlength=m) == 0)
        if m == 1:
            weak[:] = False  # nothing may differ, so the whole set is the key
        out.append(_mix(sums[~weak] + salt[~weak]))
        if weak.any():
            after = np.nonzero(weak)[0]
            nxt = (after + 1) % m
            pair = _mix((salt[after] + sums[after]) ^ _C)
            out.append(_mix(sums[nxt] + salt[nxt] + pair))
            # each shingle of the next segment deleted in turn
            behind = np.zeros(m, np.uint64)
            behind[nxt] = pair
            follows = np.zeros(m, bool)
            follows[nxt] = True
            at = np.nonzero(follows[segment])[0]
            s = segment[at]
            out.append(_mix(sums[s] - value[at] + salt[s] + behind[s]))
    return np.unique(np.concatenate(out))


DOC, WITNESS, SHARED_WITNESS, EDGE, BUCKET = range(5)
_DOC, _EDGE = ["<i8"] * 4, ["<i8", "<i8", "?"]


def sketch_parts(n: np.ndarray | int) -> np.ndarray:
    """Parts of a sketch: a power of two that grows with the set, so that sketches of long texts tell as much."""
    return 64 << np.ceil(np.log2(np.maximum(np.asarray(n) / 800, 1))).astype(np.int64)


def sketch(mixed: np.ndarray) -> np.ndarray:
    """How many shingles fall into each part of the universe, modulo 256."""
    parts = int(sketch_parts(len(mixed)))
    return np.bincount(((mixed >> np.uint64(20)) & np.uint64(parts - 1)).astype(np.int64), minlength=parts).astype(np.uint8)


def _fold(s: np.ndarray, parts: int) -> np.ndarray:
    while s.shape[1] > parts:
        s = s[:, : s.shape[1] // 2] + s[:, s.shape[1] // 2 :]
    return s


def rough(s: np.ndarray) -> bytes:
    """A sketch modulo 16, two parts to a byte."""
    return ((s[::2] & 15) | s[1::2] << 4).tobytes()


def _allowed(join: Join, total: np.ndarray) -> np.ndarray:
    """The most shingles that two linked sets of together ``total`` do not share."""
    # linked: den * both >= num * (total - both), and total - 2 * both are not shared
    return total - 2 * -(-join.num * total // (join.num + join.den))


def may_link_roughly(join: Join, na: np.ndarray, nb: np.ndarray, flat: np.ndarray, sa: np.ndarray, sb: np.ndarray) -> np.ndarray:
    """:func:`may_link` by rough sketches, which begin in ``flat`` at ``sa`` and ``sb``."""
    out = np.maximum(na, nb) * join.num <= np.minimum(na, nb) * join.den
    la, lb, most = sketch_parts(na) // 2, sketch_parts(nb) // 2, _allowed(join, na + nb)
    for p, q in set(zip(la[out].tolist(), lb[out].tolist())):
        at = np.flatnonzero((la == p) & (lb == q) & out)
        step = max(1, (1 << 20) // max(p, q))
        for i in range(0, len(at), step):
            rows = at[i : i + step]
            x, y = flat[sa[rows][:, None] + np.arange(p)], flat[sb[rows][:, None] + np.arange(q)]
            far = 0
            for u, v in ((x & 15, y & 15), (x >> 4, y >> 4)):
                d = (_fold(u, min(p, q)) - _fold(v, min(p, q))) & 15
                far = far + np.minimum(d, 16 - d).sum(axis=1, dtype=np.int64)
            out[rows] = far <= most[rows]
    return out


def may_link(join: Join, na: np.ndarray, nb: np.ndarray, sa: list[bytes], sb: list[bytes]) -> np.ndarray:
    """False only where sizes or sketches rule a link out: each unit that two sketches differ by is a shingle not shared."""
    lo, hi = np.minimum(na, nb), np.maximum(na, nb)
    total = na + nb
    out = hi * join.num <= lo * join.den
    la, lb = np.array([len(x) for x in sa]), np.array([len(x) for x in sb])
    for p, q in set(zip(la.tolist(), lb.tolist())):
        at = np.flatnonzero((la == p) & (lb == q) & out)
        step = max(1, (1 << 21) // max(p, q))
        for i in range(0, len(at), step):
            rows = at[i : i + step]
            x = np.frombuffer(b"".join(sa[r] for r in rows), np.uint8).reshape(-1, p)
            y = np.frombuffer(b"".join(sb[r] for r in rows), np.uint8).reshape(-1, q)
            d = _fold(x, min(p, q)) - _fold(y, min(p, q))  # counts wrap, so the distance is around the circle
            out[rows] = np.minimum(d, -d).sum(axis=1, dtype=np.int64) <= _allowed(join, total)[rows]
    return out


def _planes(x: np.ndarray) -> bytes:
    """Numbers as byte planes, which compress well where most are small."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _whole(blob: bytes, kind: str, n: int, at: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n)


def _squeeze(blob: bytes) -> bytes:
    return len(blob).to_bytes(8, "little") + pa.compress(blob, codec="zstd", asbytes=True)


def _unsqueeze(blob: bytes) -> bytes:
    return pa.decompress(memoryview(blob)[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _pack_keys(key: np.ndarray, row: np.ndarray, doc: np.ndarray) -> bytes:
    """Ascending 48-bit keys as their steps, and sets by their place in a table of the documents that ``row`` points at."""
    order = np.argsort(key, kind="stable")
    own, ix = np.unique(row[order], return_inverse=True)
    steps = np.diff(key[order], prepend=np.uint64(0))
    return _squeeze(len(key).to_bytes(8, "little") + len(own).to_bytes(8, "little") + _planes(steps) + _planes(ix.astype(np.uint32)) + _planes(np.diff(doc[own], prepend=0)))


def _unpack_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys, and each one's document."""
    blob = _unsqueeze(blob)
    n, own = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    doc = np.cumsum(_whole(blob, "<i8", own, 16 + 12 * n))
    return np.cumsum(_whole(blob, "<u8", n, 16)), doc[_whole(blob, "<u4", n, 16 + 8 * n)]


def _pack_buckets(buckets: list[np.ndarray]) -> bytes:
    """Members of buckets, one a row and ascending; a table for each number of members."""
    return _squeeze(b"".join(np.array(x.shape, "<i8").tobytes() + _planes(np.diff(x, axis=1, prepend=0).ravel()) for x in buckets))


def _unpack_buckets(blob: bytes) -> list[np.ndarray]:
    blob, at, out = _unsqueeze(blob), 0, []
    while at < len(blob):
        rows, n = np.frombuffer(blob, "<i8", 2, at).tolist()
        out.append(np.cumsum(_whole(blob, "<i8", rows * n, at + 16).reshape(rows, n), axis=1))
        at += 16 + 8 * rows * n
    return out


def _distinct_buckets(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, and a hash of each one."""
    h = _mix(x.astype(np.uint64) + _A).sum(axis=1, dtype=np.uint64)
    order = np.argsort(h, kind="stable")
    x = x[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]).any(axis=1)
    return x[new], h[order][new]


def _stars(group: np.ndarray, doc: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges from each record of a bucket to the bucket's hub, the document that is in most buckets here.

    ``group`` ascends, ``count`` is the size of each record's bucket. Returns the hub of
    every record, and the edges (a, b) with a < b and whether each comes from a bucket of two.
    """
    own, ix = np.unique(doc, return_inverse=True)
    rank = np.bincount(ix)[ix]
    order = np.lexsort((doc, -rank, group))
    first = np.ones(len(group), bool)
    first[1:] = group[order][1:] != group[order][:-1]
    hub = np.empty(len(group), np.int64)
    hub[order] = doc[order][first][np.cumsum(first) - 1]
    apart = hub != doc
    a, b = np.minimum(hub, doc)[apart], np.maximum(hub, doc)[apart]
    return hub, a, b, count[apart] == 2


def _held_together(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest that the edges (a, b) lead to."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        before = least.copy()
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        least = least[least]
        if (least == before).all():
            return least


def _pairs(join: Join, starts: np.ndarray, count: np.ndarray, doc: np.ndarray, size: np.ndarray, roughs: np.ndarray, where: np.ndarray, ref: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Edges (a, b, closed) of small buckets, [start, start + count) of ``ref``, which points at a document, its size and where its rough sketch begins.

    A bucket whose possible pairs have no cycle gives these, closed. In others the sets that such pairs hold together are tied to
    one of them, so a bucket gives fewer edges than it has members.
    """
    for n in np.unique(count).tolist():
        i, j = np.triu_indices(n, 1)
        every = starts[count == n]
        step = max(1, PAIRS_AT_ONCE // len(i))
        for k in range(0, len(every), step):  # repeated edges go before they pile up
            members = ref[every[k : k + step, None] + np.arange(n)].ravel()
            lead = np.arange(0, len(members), n)[:, None]
            x, y = (lead + i).ravel(), (lead + j).ravel()
            p, q = members[x], members[y]
            ok = (doc[p] != doc[q]) & may_link_roughly(join, size[p], size[q], roughs, where[p], where[q])
            x, y = x[ok], y[ok]
            if not len(x):
                continue
            one = _held_together(len(members), x, y)
            # without a cycle each pair joins two parts
            tree = np.bincount(x // n, minlength=len(lead)) + np.bincount(np.flatnonzero(one == np.arange(len(one))) // n, minlength=len(lead)) == n
            plain = tree[x // n]
            p, q = doc[members[x[plain]]], doc[members[y[plain]]]
            tied = np.flatnonzero(~tree[np.arange(len(members)) // n])
            # the smallest doc_id is the same in all tasks, so buckets of one group repeat their edges
            hub = np.full(len(members), np.iinfo(np.int64).max)
            np.minimum.at(hub, one, doc[members])
            c, d = hub[one[tied]], doc[members[tied]]
            c, d = c[c != d], d[c != d]
            a, b = np.append(np.minimum(p, q), c), np.append(np.maximum(p, q), d)
            yield _distinct_edges(a, b, np.arange(len(a)) < len(p))


def _distinct_edges(a: np.ndarray, b: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((closed, b, a))
    a, b, closed = a[order], b[order], closed[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new], closed[new]


def _index(docs: DataFrame, join: Join, wide_plan: dict[int, bool], common: Broadcast, scratch: list[str]) -> DataFrame:
    """kind 0: a document's size, set hash and sketch; kind 1: edges of large buckets (id, other); kind 2: members of small ones (bucket id, other).

    Large buckets never become rows: inside a task, map or reduce, their members are tied to a
    hub, and edges that many buckets repeat are one. A bucket's members in one map task
    send one record to its reduce task, so no bucket, however large, gathers anywhere. Small buckets of the
    same members, as two near copies have them under most of their keys, are one.
    """
    spark = docs.sparkSession
    n_parts = partition_count(spark)
    ids = partition_ids(spark, n_parts)

    def flush(info: list[tuple[int, int, int, int]], keys: list[np.ndarray], sketches: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not info:
            return
        doc, size = np.array([i[0] for i in info], np.int64), np.array([i[1] for i in info], np.int64)
        h1, h2 = np.array([i[2] for i in info], np.uint64), np.array([i[3] for i in info], np.uint64)
        home = (h1 % np.uint64(n_parts)).astype(np.int64)
        for p in np.unique(home).tolist():
            at = np.flatnonzero(home == p)
            blob = pack([doc[at], size[at], h1[at], h2[at]]) + b"".join(sketches[i] for i in at)
            yield pa.RecordBatch.from_arrays([pa.array([ids[p]], pa.int32()), pa.array([DOC], pa.int32()), pa.array([blob], pa.binary())], names=["pid", "tag", "blob"])
        # of equal sets in this task the smallest doc_id stands for all
        order = np.lexsort((doc, h2, h1, size))
        first = np.ones(len(doc), bool)
        first[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1]) | (size[order][1:] != size[order][:-1])
        keep = np.zeros(len(doc), bool)
        keep[order[first]] = True
        every = np.concatenate(keys)
        row = np.repeat(np.arange(len(doc)), [len(k) for k in keys])
        chosen = keep[row]
        # 48 bits tell buckets apart well enough: a chance collision is one more candidate to verify
        every, row = every[chosen] >> np.uint64(16), row[chosen]
        order, first, group = witnesses(every)
        k, r = every[order], row[order]
        i = doc[r]
        several = group > LOCAL_BUCKET
        hub, a, b, closed = _stars(np.cumsum(first)[several], i[several], np.full(int(several.sum()), 3))
        yield from send(a, b, closed)
        # the hub speaks for its bucket
        row_of = dict(zip(doc.tolist(), range(len(doc))))
        lead = first[several]
        for tag, key, who in ((WITNESS, k[~several], r[~several]), (SHARED_WITNESS, k[several][lead], np.array([row_of[h] for h in hub[lead].tolist()], np.int64))):
            home = (key % np.uint64(n_parts)).astype(np.int64)
            by = np.argsort(home, kind="stable")
            cuts = np.searchsorted(home[by], np.arange(n_parts + 1))
            pids, blobs = [], []
            for p in range(n_parts):
                at = by[cuts[p] : cuts[p + 1]]
                if len(at):
                    pids.append(ids[p])
                    blobs.append(_pack_keys(key[at], who[at], doc))
            yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int32()), pa.array([tag] * len(pids), pa.int32()), pa.array(blobs, pa.binary())], names=["pid", "tag", "blob"])

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(join.width)
        info: list[tuple[int, int, int, int]] = []
        keys: list[np.ndarray] = []
        sketches: list[bytes] = []
        held = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                x = shingles(text.as_py())
                m = _mix(x + _C)
                info.append((doc_id, len(x), int(m.sum()), int(_mix(m + _A).sum())))
                keys.append(signatures(join, x, wide_plan, common.value) if len(x) else x)
                sketches.append(sketch(m).tobytes())
                held += len(keys[-1])
                if held > FLUSH:
                    yield from flush(info, keys, sketches)
                    info, keys, sketches, held = [], [], [], 0
        yield from flush(info, keys, sketches)

    def send(a: np.ndarray, b: np.ndarray, closed: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(a):
            a, b, closed = _distinct_edges(a, b, closed)
            yield from scatter((_mix(a.astype(np.uint64)) % np.uint64(n_parts)).astype(np.int64), [a, b, closed], ids, EDGE)

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lone, tied = [], []
        for batch in batches:
            for pid, tag, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if tag == DOC:
                    yield pa.RecordBatch.from_arrays([pa.array([pid], pa.int32()), pa.array([tag], pa.int32()), pa.array([blob], pa.binary())], names=["pid", "tag", "blob"])
                elif tag == EDGE:
                    tied.append(unpack(blob, _EDGE))
                else:
                    key, doc = _unpack_keys(blob)
                    lone.append((key, doc, np.full(len(key), tag == SHARED_WITNESS)))
        if tied:
            yield from send(*(np.concatenate(c) for c in zip(*tied)))
        if lone:
            key, doc, shared = (np.concatenate(c) for c in zip(*lone))
            order, first, group = witnesses(key)
            several = group > 1
            doc, shared, which = doc[order][several], shared[order][several], np.cumsum(first)[several]
            if len(doc):
                starts = np.flatnonzero(np.diff(which, prepend=-1))
                count = np.diff(np.append(starts, len(which)))
                small = (count <= SMALL_BUCKET) & ~np.logical_or.reduceat(shared, starts)
                yield from send_buckets(doc, starts[small], count[small])
                large = np.repeat(~small, count)
                _, c, d, _ = _stars(which[large], doc[large], np.zeros(int(large.sum())))
                yield from send(c, d, np.zeros(len(c), bool))

    def send_buckets(doc: np.ndarray, starts: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        to: dict[int, list[np.ndarray]] = {}
        for n in np.unique(count).tolist():
            members = np.sort(doc[starts[count == n][:, None] + np.arange(n)], axis=1)
            members, h = _distinct_buckets(members[members[:, 0] < members[:, -1]])
            home = (h % np.uint64(n_parts)).astype(np.int64)
            for p in np.unique(home).tolist():
                to.setdefault(p, []).append(members[home == p])
        if to:
            yield pa.RecordBatch.from_arrays([pa.array([ids[p] for p in to], pa.int32()), pa.array([BUCKET] * len(to), pa.int32()), pa.array([_pack_buckets(x) for x in to.values()], pa.binary())], names=["pid", "tag", "blob"])

    names = ["kind", "id", "other", "n", "h1", "h2", "closed", "sketch"]

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows: documents, and each edge and each small bucket once however many keys had it."""
        tied = []
        buckets: dict[int, list[np.ndarray]] = {}
        lead = 0
        for batch in batches:
            for pid, tag, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if tag == EDGE:
                    tied.append(unpack(blob, _EDGE))
                    continue
                if tag == BUCKET:
                    lead = pid << 40  # of this task only, so its buckets' numbers are as well
                    for x in _unpack_buckets(blob):
                        buckets.setdefault(x.shape[1], []).append(x)
                    continue
                d, n, h1, h2 = unpack(blob, _DOC)
                ends = 8 + 32 * len(d) + np.cumsum(sketch_parts(n))
                sketches = [blob[b - w : b] for b, w in zip(ends.tolist(), sketch_parts(n).tolist())]
                zero = pa.array(np.zeros(len(d), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(d), np.int32)), pa.array(d), zero, pa.array(n), pa.array(h1), pa.array(h2), pa.array(np.zeros(len(d), bool)), pa.array(sketches, pa.binary())], names=names)
        if tied:
            a, b, closed = _distinct_edges(*(np.concatenate(c) for c in zip(*tied)))
            zero = pa.array(np.zeros(len(a), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(a), np.int32)), pa.array(a), pa.array(b), zero, zero, zero, pa.array(closed), pa.nulls(len(a), pa.binary())], names=names)
        for n, found in sorted(buckets.items()):
            members, _ = _distinct_buckets(np.concatenate(found))
            number, lead = lead + np.arange(len(members)), lead + len(members)
            zero = pa.array(np.zeros(members.size, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(members.size, 2, np.int32)), pa.array(np.repeat(number, n)), pa.array(members.ravel()), zero, zero, zero, pa.array(np.zeros(members.size, bool)), pa.nulls(members.size, pa.binary())], names=names)

    rows = docs.mapInArrow(emit, SCATTERED)
    found = exchange(rows, n_parts).mapInArrow(gather, SCATTERED)
    out = exchange(found, n_parts).mapInArrow(settle, "kind int, id long, other long, n long, h1 long, h2 long, closed boolean, sketch binary")
    return materialize(out, "candidates", partition_by="kind", scratch=scratch)


def _small_buckets(members: DataFrame, info: DataFrame, join: Join) -> DataFrame:
    """Edges (a, b, closed) of the small buckets (bucket, id).

    An edge is closed if all possible pairs of its bucket are edges, so that it stands for itself only.
    """

    def edges(rows: pa.Table) -> pa.RecordBatch:
        bucket, doc, size = (rows.column(i).to_numpy() for i in range(3))
        roughs = [rough(np.frombuffer(s, np.uint8)) for s in rows.column(3).to_pylist()]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        found = list(_pairs(join, starts, np.diff(np.append(starts, len(bucket))), doc, size, np.frombuffer(b"".join(roughs), np.uint8), np.cumsum([0, *map(len, roughs)])[:-1], np.arange(len(doc))))
        a, b, closed = _distinct_edges(*(np.concatenate(c) for c in zip(*found))) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(closed)], names=["a", "b", "closed"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) > MEMBERS_AT_ONCE:
                rows = pa.Table.from_batches(held)
                bucket = rows.column(0).to_numpy()
                at = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
                yield edges(rows.slice(0, at))
                held = rows.slice(at).to_batches()
        if held:
            yield edges(pa.Table.from_batches(held))

    rows = members.join(info, "id").select("bucket", "id", "n", "sketch")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long, closed boolean")


def _prune(edges: DataFrame, info: DataFrame, join: Join) -> DataFrame:
    """The edges (a, b, closed) that sizes and sketches leave possible, with column possible."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 1000) for whole in batches for i in range(0, len(whole), 1000)):
            ok = may_link(join, b.column(3).to_numpy(), b.column(4).to_numpy(), b.column(5).to_pylist(), b.column(6).to_pylist()) if len(b) else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ok)], names=["a", "b", "closed", "possible"])

    a = info.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = info.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    joined = edges.join(a, "a").join(b, "b").select("a", "b", "closed", "na", "nb", "sa", "sb")
    return joined.mapInArrow(run, "a long, b long, closed boolean, possible boolean")


#: Bits of the filter below: its broadcast is fixed, whatever the number of ids.
FILTER_BITS = 1 << 23


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the given ids. A bitmap of their hashes, of fixed size, first drops most other rows without a shuffle; the join is exact."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    words = ids.select(place("id").alias("p")).groupBy(F.expr("p div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits"))
    rows = docs.select(F.col("doc_id").alias("id"), "text").withColumn("p", place("id")).withColumn("word", F.expr("p div 64"))
    # at most FILTER_BITS / 64 rows are broadcast
    near = rows.join(F.broadcast(words), "word").filter("shiftright(bits, cast(p % 64 as int)) & 1 = 1").select("id", "text")
    return near.join(ids, "id").dropDuplicates(["id"])


def block_matrix(join: Join, labels: list[int], sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which left and right sets of different labels are linked."""
    lens = np.array([len(s) for s in sets])
    every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), lens)
    kept = times[column] > 1
    _, column = np.unique(column[kept], return_inverse=True)
    row = row[kept]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    if len(column):
        # shingles that the same sets hold count together: one column for all of them
        starts = np.flatnonzero(np.diff(column, prepend=-1))
        holders = np.add.reduceat(_mix(np.arange(1, len(sets) + 1, dtype=np.uint64))[row], starts)
        _, lead, alike = np.unique(holders, return_index=True, return_counts=True)
        number = np.full(len(starts), -1)
        number[lead] = np.arange(len(lead))
        column = number[column]
        row, column = row[column >= 0], column[column >= 0]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        step = 1024
        for c in range(0, len(lead), step):
            a, b = np.searchsorted(column, [c, c + step])
            dense = np.zeros((len(sets), min(step, len(lead) - c)), np.float32)
            dense[row[a:b], column[a:b] - c] = 1
            both += (dense * alike[c : c + step].astype(np.float32)) @ dense.T
    label = np.array(labels)
    ok = np.zeros(both.shape, bool)
    for a in range(0, len(sets), 256):  # some rows at a time: only the counts and the result are whole
        rows = slice(a, a + 256)
        inter = both[rows].astype(np.int64)
        linked = join.den * inter >= join.num * (lens[rows, None] + lens[None, :] - inter)
        ok[rows] = linked & (label[rows, None] != label[None, :]) & left[rows, None] & right[None, :]
    return ok


def block_links(ids: list[int], labels: list[int], ok: np.ndarray) -> list[tuple[int, int]]:
    """The links of ``ok`` that join labels not yet joined by earlier ones."""
    i, j = np.nonzero(ok)
    at = {(labels[x], labels[y]): (ids[x], ids[y]) for x, y in zip(i.tolist(), j.tolist())}
    return [at[pair] for pair in forest(*map(list, zip(*at)))] if at else []


def _verify(ties: DataFrame, labels: DataFrame | None, docs: DataFrame, info: DataFrame, join: Join, keep: str, weights: DataFrame, all_blocks: bool, scratch: list[str]) -> tuple[DataFrame, DataFrame]:
    """Links among the sets that the ties (a, b) hold together, and the sets of clusters of several blocks.

    Tied sets form a cluster, dealt into blocks of about BLOCK_SHINGLES shingles and BLOCK_SETS sets. Clusters of
    one block share groups; of others either every two blocks meet (``all_blocks``), so a text moves once per block of its
    cluster, or each block meets itself and the set with the most ties. Sets of one label (a set without
    a label is its own) are not compared. ``keep`` tells what becomes of the links in a group: "joins",
    those are rows (a, b) that join labels; "all", each is a row; "counts", as "joins", and each
    linked set has a row with b null and in ``links`` the weight of its partners.
    """
    own: list[str] = []
    spark = docs.sparkSession
    clusters = components(ties, own).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    ends = ties.select(F.col("a").alias("id")).unionByName(ties.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("ties"))
    rows = clusters.join(ends, "id").join(info.select("id", "n"), "id")
    rows = rows.withColumn("label", F.col("id")) if labels is None else rows.join(labels.select(F.col("node").alias("id"), F.col("component").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
    rows = rows.join(weights.withColumnRenamed("rep", "id"), "id") if keep == "counts" else rows.withColumn("docs", F.lit(1).cast("long"))
    total = rows.groupBy("cluster").agg(
        F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("blocks"),
        F.max(F.struct("ties", F.negative("id").alias("least"))).alias("top"),
    )
    rows = rows.join(total.select("cluster", "blocks", F.negative("top.least").alias("lead")), "cluster")
    rows = materialize(rows, "members", scratch=own)
    texts = materialize(texts_of(docs, rows.select("id").distinct()), "texts", scratch=own)
    bins = rows.filter("blocks = 1").agg(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_SETS).alias("x")).first().x
    blocked = rows.withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # clusters of one block by the block-full; the others' group is the cluster
    group = F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("cluster"), F.lit(1 + int(bins or 0)))).otherwise(F.col("cluster"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    others = every if all_blocks else F.when(F.col("id") == F.col("lead"), every).otherwise(F.array("i"))
    dealt = blocked.withColumn("group", group).withColumn("j", F.explode(others))
    x, y = (F.least("i", "j"), F.greatest("i", "j")) if all_blocks else (F.col("j"), F.col("j"))
    dealt = dealt.select("group", x.alias("x"), y.alias("y"), "cluster", "i", "id", "label", "docs").join(texts, "id")

    def links_of(ids: np.ndarray, labels: list[int], weight: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> pd.DataFrame:
        ok = block_matrix(join, labels, sets, left, right)
        if keep == "all":
            i, j = np.nonzero(np.triu(ok | ok.T))
            return pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), "links": None})
        found = pd.DataFrame(block_links(ids.tolist(), labels, ok), columns=["a", "b"], dtype="int64").assign(links=None)
        if keep == "joins":
            return found
        n = (ok | ok.T) @ weight
        return pd.concat([found, pd.DataFrame({"a": ids[n > 0], "b": None, "links": n[n > 0]})]).astype("Int64")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shingles = Shingler(join.width)
        out = [pd.DataFrame({"a": [], "b": [], "links": []})]
        # blocks of one cluster are left and right; in all other groups everything is both
        apart = key[1] != key[2]
        order = np.argsort(pdf["cluster"].to_numpy(), kind="stable")
        cluster, i = pdf["cluster"].to_numpy()[order], pdf["i"].to_numpy()[order]
        ids, label, weight = pdf["id"].to_numpy()[order], pdf["label"].to_numpy()[order], pdf["docs"].to_numpy(np.int64)[order]
        text = pdf["text"].to_numpy()[order]
        cuts = np.flatnonzero(np.diff(cluster, prepend=cluster[0] - 1, append=cluster[-1] + 1))
        for a, b in zip(cuts, cuts[1:]):
            left = i[a:b] == key[1] if apart else np.ones(b - a, bool)
            right = ~left if apart else left
            if (label[a:b] != label[a]).any() and left.any() and right.any():
                out.append(links_of(ids[a:b], label[a:b].tolist(), weight[a:b], [shingles(t) for t in text[a:b]], left, right))
        return pd.concat([x for x in out if len(x)] or out[:1])

    found = materialize(dealt.groupBy("group", "x", "y").applyInPandas(run, "a long, b long, links long"), "links", scratch=scratch)
    wide = materialize(rows.filter("blocks > 1").select("id"), "wide", scratch=scratch)
    discard(spark, own)
    return found, wide


def _sketched(ties: DataFrame, labels: DataFrame, info: DataFrame, join: Join, scratch: list[str]) -> DataFrame:
    """Ties (a, b) of sets: what sizes and sketches leave of the pairs of sets whose labels differ and are tied.

    Ties of labels hold clusters together. A cluster's sets are dealt into blocks of one size band each, and two
    blocks meet if sets of their bands can be linked. A group of two blocks gives a spanning
    forest of its possible pairs, so at most a row for each set.
    """
    own: list[str] = []
    spark = info.sparkSession
    clusters = components(ties, own).select(F.col("node").alias("label"), F.col("component").alias("cluster"))
    members = clusters.join(labels, clusters["label"] == labels["component"], "left").select("cluster", "label", F.coalesce("node", "label").alias("id")).distinct()
    lows = F.array(*(F.lit(int(v)) for v in join.lows[:-1]))
    rows = members.join(info, "id").withColumn("band", F.size(F.filter(lows, lambda v: v <= F.col("n"))) - 1)
    rows = materialize(rows, "sketches", scratch=own)
    total = rows.groupBy("cluster", "band").agg(F.ceil(F.count("*") / BLOCK_SKETCHES).cast("int").alias("blocks"))
    above, below = total.select("cluster", (F.col("band") - 1).alias("band"), F.col("blocks").alias("up")), total.select("cluster", (F.col("band") + 1).alias("band"), F.col("blocks").alias("down"))
    total = total.join(above, ["cluster", "band"], "left").join(below, ["cluster", "band"], "left")
    blocked = rows.join(total, ["cluster", "band"]).withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meet = lambda low, x, high, y: F.struct(low.alias("low"), x.alias("x"), high.alias("high"), y.alias("y"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    band, i = F.col("band"), F.col("i")
    groups = F.concat(
        F.transform(upto(F.col("blocks")), lambda j: meet(band, F.least(i, j), band, F.greatest(i, j))),
        F.transform(upto(F.coalesce("up", F.lit(0))), lambda j: meet(band, i, band + 1, j)),
        F.transform(upto(F.coalesce("down", F.lit(0))), lambda j: meet(band - 1, j, band, i)),
    )
    dealt = blocked.select("cluster", F.explode(groups).alias("g"), "band", "i", "id", "label", "n", "sketch").select("cluster", "g.*", "band", "i", "id", "label", "n", "sketch")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, low, x, high, y = key
        band, i = pdf["band"].to_numpy(), pdf["i"].to_numpy()
        left, right = np.flatnonzero((band == low) & (i == x)), np.flatnonzero((band == high) & (i == y))
        ids, label, n, sketches = pdf["id"].to_numpy(), pdf["label"].to_numpy(), pdf["n"].to_numpy(), pdf["sketch"].tolist()
        a, b = possible_pairs(join, n, label, sketches, left, right, (low, x) == (high, y))
        return pd.DataFrame(forest(ids[a].tolist(), ids[b].tolist()), columns=["a", "b"], dtype="int64")

    out = materialize(dealt.groupBy("cluster", "low", "x", "high", "y").applyInPandas(run, "a long, b long"), "ties", scratch=scratch)
    discard(spark, own)
    return out


def possible_pairs(join: Join, n: np.ndarray, label: np.ndarray, sketches: list[bytes], left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of left and right, of different labels) that sizes and sketches leave possible; ``same``: both are one block."""
    parts = np.array([len(s) for s in sketches])
    found = []
    for p in np.unique(parts[left]).tolist():
        for q in np.unique(parts[right]).tolist():
            width = min(p, q)
            rows, columns = left[parts[left] == p], right[parts[right] == q]
            r = _fold(np.frombuffer(b"".join(sketches[k] for k in rows), np.uint8).reshape(-1, p), width)
            c = _fold(np.frombuffer(b"".join(sketches[k] for k in columns), np.uint8).reshape(-1, q), width)
            for k, at in enumerate(rows.tolist()):
                # as in may_link, for one set and a whole block
                lo, hi, total = np.minimum(n[at], n[columns]), np.maximum(n[at], n[columns]), n[at] + n[columns]
                ok = (hi * join.num <= lo * join.den) & (label[columns] != label[at])
                if same:
                    ok &= columns > at
                some = np.flatnonzero(ok)
                d = c[some] - r[k]
                both = -(-join.num * total[some] // (join.num + join.den))
                some = some[np.minimum(d, -d).sum(axis=1, dtype=np.int64) <= total[some] - 2 * both]
                if len(some):
                    found.append((np.full(len(some), at), columns[some]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


def forest(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Those pairs that join what earlier ones have not joined."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    out = []
    for x, y in zip(a, b):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _find(docs: DataFrame, join: Join, keep: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, n, h1, h2), classes of equal sets with their representatives, and the rows of both verifications."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kept: list[str] = []  # what the result reads
    scratch: list[str] = []
    named = docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    sizes = F.greatest(F.lit(1), (F.octet_length("text") / WORD_BYTES).cast("long") - (join.width - 1))
    guess = named.filter("text is not null").select(F.floor(F.log2(sizes) * 8).alias("g")).groupBy("g").count().collect()  # a few hundred rows
    histogram: dict[int, int] = {}
    for r in guess:
        band = join.band(max(1, int(2 ** (r.g / 8))))
        histogram[band] = histogram.get(band, 0) + r["count"]
    common = spark.sparkContext.broadcast(frequent(named, join.width))
    index = _index(named, join, plans(join, histogram), common, scratch)
    info = materialize(index.filter("kind = 0").select(F.col("id").alias("doc_id"), "n", "h1", "h2"), "sizes", scratch=kept)
    classes = info.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), (F.countDistinct("doc_id") if keep == "counts" else F.count("*")).alias("docs"))
    classes = materialize(classes, "classes", scratch=kept)
    copies = info.join(classes.filter("copies > 1"), ["n", "h1", "h2"]).filter("doc_id <> rep").select("doc_id", "rep").dropDuplicates(["doc_id"])
    to_rep = lambda df, c: df.join(copies.withColumnRenamed("doc_id", c), c, "left").withColumn(c, F.coalesce("rep", c)).drop("rep")
    # a document of which a bucket speaks, with its size and sketch
    known = index.filter("kind = 0").select("id", "n", "sketch").dropDuplicates(["id"])
    small = _small_buckets(index.filter("kind = 2").select(F.col("id").alias("bucket"), F.col("other").alias("id")), known, join)
    edges = index.filter("kind = 1").select(F.col("id").alias("a"), F.col("other").alias("b"), "closed").unionByName(small)
    edges = to_rep(to_rep(edges, "a"), "b")
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "closed").filter("a <> b")
    edges = edges.groupBy("a", "b").agg(F.bool_and("closed").alias("closed"))
    # an edge of a small bucket that sketches rule out is settled
    edges = materialize(_prune(edges, known, join).filter("possible or not closed"), "edges", scratch=scratch)
    weights = classes.groupBy("rep").agg(F.max("docs").alias("docs"))
    links, wide = _verify(edges.filter("possible").select("a", "b"), None, named, known, join, keep, weights, keep != "joins", kept)
    first = components(_pairs_of(links), scratch)
    of = lambda c: first.select(F.col("node").alias(c), F.col("component").alias(f"l{c}"))
    # settled by now: edges of small buckets, unless their ends were in different blocks
    still = edges.filter("not closed")
    if keep == "joins":
        still = still.unionByName(edges.filter("closed").join(wide.select(F.col("id").alias("a")), "a", "left_semi"))
    still = still.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b").distinct()
    ties = _sketched(still, first, known, join, scratch)
    # sets of one component were compared with each other above, so no link is found twice
    more, _ = _verify(ties, first, named, known, join, keep, weights, True, kept)
    discard(spark, scratch)
    common.unpersist()
    return info, classes, links.unionByName(more)


def _pairs_of(found: DataFrame) -> DataFrame:
    return found.filter("b is not null").select("a", "b")


def links(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """All links (a, b) with a < b between different sets, each named by its smallest doc_id."""
    return _pairs_of(_find(docs, Join(width, num, den), "all")[2])


def classify(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, count: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) for every row; with ``count`` n_links as well, the documents that each is linked with."""
    join = Join(width, num, den)
    info, classes, found = _find(docs, join, "counts" if count else "joins")
    final = components(_pairs_of(found)).select(F.col("node").alias("rep"), "component")
    linked = classes.join(final, "rep", "left").filter("copies > 1 or component is not null").select("n", "h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = info.join(linked, ["n", "h1", "h2"], "left")
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")]
    if not count:
        return out.select(*columns).unionByName(_unnamed(docs, join))
    near = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("near"))
    counted = classes.join(near, "rep", "left").select("n", "h1", "h2", (F.col("docs") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")).filter("n_links > 0")
    out = out.join(counted, ["n", "h1", "h2"], "left").select(*columns, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.unionByName(_unnamed(docs, join).withColumn("n_links", F.lit(0).cast("long")))


def _unnamed(docs: DataFrame, join: Join) -> DataFrame:
    """Rows without a doc_id: a size and no component."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(join.width)
        for b in batches:
            n = [len(shingles(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64())], names=["doc_id", "n_shingles", "component_id"])

    return docs.filter(F.col("doc_id").try_cast("long").isNull()).select("text").mapInArrow(run, "doc_id long, n_shingles long, component_id long")


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents with the smallest doc_id of each group of near copies (and those without an id), with their columns."""
    groups = classify(docs.select("doc_id", "text"), width, num, den)
    losers = groups.filter("component_id <> doc_id").select(F.col("doc_id").alias("doc_id")).distinct()
    return docs.join(losers, "doc_id", "left_anti").select(*docs.columns)
