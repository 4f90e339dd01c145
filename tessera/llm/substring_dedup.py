"""Removal of byte strings that already occur in a document with a smaller id.

A sparse suffix array finds them. Anchors are the positions whose 16-gram hash is
least in some window of 35, so each 50-byte string holds an anchor, and equal
strings hold equal ones. Only anchors whose 16-gram occurs in two documents or
more are suffixes to sort. Each map task sorts its suffixes (the 50 bytes from
the anchor, with the 34 before it), front-codes them and sends one run to each
reduce task, chosen by the 16-gram's hash; a loser tree that never re-compares
known prefixes merges the runs. Its common-prefix lengths say which suffixes
agree on the 50 - l bytes from the anchor; with the l bytes before it, for l from
0 to 34, those are the 50-byte strings, and the smallest doc_id of each decides.

Whole copies leave by their hash before the sort. Inside a map task equal contexts
are settled at once and only the smallest doc_id travels, so a passage that many
documents share fills no task.

Defined results: null texts are empty; texts under 50 bytes lose nothing; a null
doc_id is neither smaller nor larger than another, so its row loses nothing and
removes nothing; repeated rows come back each; of different texts with one doc_id neither
counts as smaller, so they remove nothing from each other; a doc_id that is no integer counts as null;
columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.exchange import SCATTERED, exchange, partition_count, partition_ids, scatter, unpack
from tessera.llm.loser_tree import decode, front_code, merge

LENGTH, GRAM = 50, 16
LEFT = LENGTH - GRAM  # furthest that a window reaches back from its anchor
FLUSH = 2_000_000
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M[4]
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of every GRAM bytes, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _M[0]
    width = 1
    for i in range(4):
        h = _mix(h[:-width] * _M[i] + h[width:])
        width *= 2
    return h


def _slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` over each window of ``width``, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes such that every LENGTH bytes hold one, chosen by content alone."""
    if len(text) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = gram_hashes(np.frombuffer(text, np.uint8))
    least = _slide(h, LEFT + 1, np.minimum)
    border = np.zeros(LEFT, np.uint64)
    reached = _slide(np.concatenate([border, least, border]), LEFT + 1, np.maximum)
    at = np.nonzero(h == reached)[0]
    return at, h[at]


def _squeeze(blob: bytes) -> bytes:
    """zstd, after the length: context bytes are text, which the shuffle's own codec hardly shortens."""
    return len(blob).to_bytes(8, "little") + pa.compress(blob, codec="zstd", asbytes=True)


def _expand(blob: bytes) -> bytes:
    return pa.decompress(memoryview(blob)[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _planes(x: np.ndarray) -> np.ndarray:
    """Bytes by significance, which compress; undone by _whole."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T)


def _pack_planes(columns: list[np.ndarray]) -> bytes:
    return len(columns[0]).to_bytes(8, "little") + b"".join(_planes(c).tobytes() for c in columns)


def _unpack_planes(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


def _rows(pids: list[int], tags: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pids, pa.int32()), pa.array(tags, pa.int32()), pa.array(blobs, pa.binary())], names=["pid", "tag", "blob"])


ALONE, SHARED, FOUND = range(3)


def _candidates(docs: DataFrame) -> DataFrame:
    """(doc, var, at): each document's anchors whose gram occurs in two documents or more. ``var`` tells texts of one doc_id apart."""
    spark = docs.sparkSession
    n_parts = partition_count(spark)
    ids = partition_ids(spark, n_parts)

    def flush(doc_ids: list[tuple[int, int]], at: list[np.ndarray], keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not doc_ids:
            return
        doc, var = np.array(doc_ids, np.int64).T
        # documents in ascending order, so that the first record of a key has the smallest id
        rank = np.empty(len(doc), np.int64)
        ascending = np.argsort(doc, kind="stable")
        rank[ascending] = np.arange(len(doc))
        lens = np.array([len(x) for x in at])
        row, pos, key = np.repeat(rank, lens), np.concatenate(at).astype(np.uint32), np.concatenate(keys)
        doc, var = doc[ascending], var[ascending].astype(np.int32)
        order = np.lexsort((row, key))
        row, pos, key = row[order], pos[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.nonzero(new)[0]
        group = np.cumsum(new) - 1
        leader = row[starts][group] if len(starts) else row
        several = np.maximum.reduceat(doc[row], starts)[group] != doc[leader] if len(starts) else new
        mine = doc[row] == doc[leader]
        found = ~mine
        # candidates already known go to their documents' partition, in the second exchange's form
        home = (key % np.uint64(n_parts)).astype(np.int64)
        pids, tags, blobs = [], [], []
        for tag, chosen in ((ALONE, mine & ~several), (SHARED, mine & several), (FOUND, found)):
            to = home if tag != FOUND else ((key ^ _mix(row.astype(np.uint64))) % np.uint64(n_parts)).astype(np.int64)
            picked = np.nonzero(chosen)[0]
            picked = picked[np.argsort(to[picked], kind="stable")]
            cuts = np.searchsorted(to[picked], np.arange(n_parts + 1))
            for p in range(n_parts):
                s = picked[cuts[p] : cuts[p + 1]]
                if len(s):
                    own, ix = np.unique(row[s], return_inverse=True)
                    blobs.append(_squeeze(_pack_planes([key[s], ix.astype(np.uint32), pos[s]]) + doc[own].tobytes() + var[own].tobytes()))
                    pids.append(ids[p])
                    tags.append(tag)
        yield _rows(pids, tags, blobs)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_ids: list[tuple[int, int]] = []
        at: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        held, seen = 0, set()
        for b in batches:
            for doc_id, var, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                raw = text.as_py().encode()
                digest = (xxhash.xxh3_128_digest(raw), doc_id)
                p, h = anchors(raw)
                if not len(p) or digest in seen:
                    continue
                seen.add(digest)
                doc_ids.append((doc_id, var))
                at.append(p)
                keys.append(h)
                held += len(p)
                if held > FLUSH:
                    yield from flush(doc_ids, at, keys)
                    doc_ids, at, keys, held = [], [], [], 0
                    seen.clear()
        yield from flush(doc_ids, at, keys)

    def read(blob: bytes) -> list[np.ndarray]:
        blob = _expand(blob)
        key, ix, pos = _unpack_planes(blob, ["<u8", "<u4", "<u4"])
        at = 8 + 16 * len(key)
        n = (len(blob) - at) // 12
        return [key, np.frombuffer(blob, "<i8", n, at)[ix], np.frombuffer(blob, "<i4", n, at + 8 * n)[ix], pos]

    def match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[list[np.ndarray]]] = {ALONE: [], SHARED: [], FOUND: []}
        for b in batches:
            for tag, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                parts[tag].append(read(blob))
        out = [c[1:] for c in parts[FOUND]]
        lone = [(*c, tag == SHARED) for tag in (ALONE, SHARED) for c in parts[tag]]
        if lone:
            key, doc, var, pos = (np.concatenate([c[i] for c in lone]) for i in range(4))
            shared = np.concatenate([np.full(len(c[0]), c[4]) for c in lone])
            order = np.argsort(key, kind="stable")
            key, doc, var, pos, shared = key[order], doc[order], var[order], pos[order], shared[order]
            starts = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
            multi = np.logical_or.reduceat(shared, starts) | (np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts))
            chosen = np.repeat(multi, np.diff(np.r_[starts, len(key)]))
            out.append([doc[chosen], var[chosen], pos[chosen]])
        if out:
            doc, var, pos = (np.concatenate(c) for c in zip(*out))
            yield from scatter((_mix(doc.astype(np.uint64)) % np.uint64(n_parts)).astype(np.int64), [doc, var, pos], ids, 0)

    def by_document(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(x, ["<i8", "<i4", "<u4"]) for b in batches for x in b.column(2).to_pylist()]
        if parts:
            doc, var, pos = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((pos, var, doc))
            doc, var, pos = doc[order], var[order], pos[order]
            starts = np.nonzero(np.r_[True, (doc[1:] != doc[:-1]) | (var[1:] != var[:-1])])[0]
            at = [np.unique(x).tobytes() for x in np.split(pos, starts[1:])]
            for a in range(0, len(starts), 20_000):
                some = starts[a : a + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array(var[some]), pa.array(at[a : a + 20_000], pa.binary())], names=["doc", "var", "at"])

    first = exchange(docs.mapInArrow(emit, SCATTERED), n_parts).mapInArrow(match, SCATTERED)
    return exchange(first, n_parts).mapInArrow(by_document, "doc long, var int, at binary")


def _spans(rows: DataFrame) -> DataFrame:
    """(doc, var, spans): merged ranges to remove, from rows (doc, var, text, at)."""
    spark = rows.sparkSession
    n_parts = partition_count(spark)
    ids = partition_ids(spark, n_parts)

    def flush(held: list[tuple[int, int, bytes, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        times = [len(h[3]) for h in held]
        docs, var = np.repeat(np.array([h[0] for h in held], np.int64), times), np.repeat(np.array([h[1] for h in held], np.int32), times)
        # one padded buffer; every context is a row of bytes read from it
        pad = bytes(LENGTH)
        starts, sizes, at = [], [], LENGTH
        for _, _, text, _ in held:
            starts.append(at)
            sizes.append(len(text))
            at += len(text) + LENGTH
        data = np.frombuffer(pad + pad.join(h[2] for h in held) + pad, np.uint8)
        pos = np.concatenate([h[3] for h in held]).astype(np.int64)
        base, size = np.repeat(np.array(starts), times), np.repeat(np.array(sizes), times)
        right_len = np.minimum(LENGTH, size - pos).astype(np.uint8)
        left_len = np.minimum(LEFT, pos).astype(np.uint8)
        right = data[(base + pos)[:, None] + np.arange(LENGTH)]
        right[np.arange(LENGTH) >= right_len[:, None]] = 0
        left = data[(base + pos)[:, None] - 1 - np.arange(LEFT)]  # nearest byte first
        left[np.arange(LEFT) >= left_len[:, None]] = 0
        whole = np.ascontiguousarray(np.concatenate([right, right_len[:, None], left, left_len[:, None]], axis=1))
        as_one = whole.view(f"S{whole.shape[1]}").reshape(-1)
        order = np.lexsort((pos, docs, as_one))
        docs, var, pos, whole, as_one = docs[order], var[order], pos[order], whole[order], as_one[order]
        new = np.ones(len(docs), bool)
        new[1:] = (whole[1:] != whole[:-1]).any(axis=1)
        group = np.cumsum(new) - 1
        lead = docs[new][group]
        # equal contexts: all but the smallest document lose every string that holds the anchor
        rl, ll = whole[:, LENGTH].astype(np.int64), whole[:, -1].astype(np.int64)
        lost = (docs > lead) & (rl + ll >= LENGTH)
        if lost.any():
            yield from _scatter_spans(docs[lost], var[lost], pos[lost] - ll[lost], pos[lost] + rl[lost], ids, n_parts)
        keep = docs == lead
        docs, var, pos, whole = docs[keep], var[keep], pos[keep], whole[keep]
        home = (_mix(np.ascontiguousarray(whole[:, :8]).view(np.uint64).reshape(-1) * _M[0] + np.ascontiguousarray(whole[:, 8:16]).view(np.uint64).reshape(-1)) % np.uint64(n_parts)).astype(np.int64)
        pids, blobs = [], []
        picked = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[picked], np.arange(n_parts + 1))
        for p in range(n_parts):
            s = picked[cuts[p] : cuts[p + 1]]
            if len(s):
                lengths = whole[s, LENGTH]
                common, rest = front_code(whole[s, :LENGTH], lengths.astype(np.int64))
                lefts = np.ascontiguousarray(whole[s, LENGTH + 1 : -1])
                parts = [common.tobytes(), lengths.tobytes(), np.ascontiguousarray(whole[s, -1]).tobytes(), docs[s].tobytes(), var[s].tobytes(), pos[s].astype("<u4").tobytes(), lefts.tobytes(), rest]
                pids.append(ids[p])
                blobs.append(_squeeze(len(s).to_bytes(8, "little") + b"".join(parts)))
        yield _rows(pids, [RUN] * len(pids), blobs)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes, np.ndarray]] = []
        n = 0
        for b in batches:
            for doc_id, var, text, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                p = np.frombuffer(at.as_py(), "<u4")
                held.append((doc_id, var, text.as_py().encode(), p))
                n += len(p) + len(held[-1][2]) // 64
                if n > SORT_FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        yield from flush(held)

    def reduce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, ready = [], []
        for b in batches:
            for tag, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                (runs if tag == RUN else ready).append(blob)
        if ready:  # spans settled in a map task pass through
            yield from _scatter_spans(*(np.concatenate(c) for c in zip(*(unpack(x, _SPAN) for x in ready))), ids, n_parts, tag=RUN)
        if runs:
            yield from _scatter_spans(*merge_runs(runs), ids, n_parts, tag=RUN)

    def by_document(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [unpack(x, _SPAN) for b in batches for x in b.column(2).to_pylist()]
        if parts:
            doc, var, a, b = (np.concatenate(c) for c in zip(*parts))
            doc, var, a, b = union(doc, var, a.astype(np.int64), b.astype(np.int64))
            starts = np.nonzero(np.r_[True, (doc[1:] != doc[:-1]) | (var[1:] != var[:-1])])[0]
            both = np.stack([a, b], axis=1)
            out = [x.tobytes() for x in np.split(both, starts[1:])]
            for i in range(0, len(starts), 20_000):
                some = starts[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array(var[some]), pa.array(out[i : i + 20_000], pa.binary())], names=["doc", "var", "spans"])

    sent = exchange(rows.mapInArrow(emit, SCATTERED), n_parts).mapInArrow(reduce, SCATTERED)
    return exchange(sent, n_parts).mapInArrow(by_document, "doc long, var int, spans binary")


RUN, SPANS = 0, 1
MARK_BITS, SALTS = 1 << 23, 16
SORT_FLUSH = 250_000
_SPAN = ["<i8", "<i4", "<u4", "<u4"]


def _scatter_spans(doc: np.ndarray, var: np.ndarray, a: np.ndarray, b: np.ndarray, ids: list[int], n_parts: int, tag: int = SPANS) -> Iterator[pa.RecordBatch]:
    if len(doc):
        doc, var, a, b = union(doc, var, a.astype(np.int64), b.astype(np.int64))
        yield from scatter((_mix(doc.astype(np.uint64)) % np.uint64(n_parts)).astype(np.int64), [doc, var, a.astype("<u4"), b.astype("<u4")], ids, tag)


def union(doc: np.ndarray, var: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [a, b) merged per text (doc, var) where they touch or overlap."""
    order = np.lexsort((b, a, var, doc))
    doc, var, a, b = doc[order], var[order], a[order], b[order]
    if not len(doc):
        return doc, var, a, b
    # the running maximum of b within a text: offsets keep texts apart
    new_doc = np.r_[True, (doc[1:] != doc[:-1]) | (var[1:] != var[:-1])]
    shift = np.cumsum(new_doc) * (int(b.max()) + 1)
    reach = np.maximum.accumulate(b + shift)
    new = new_doc.copy()
    new[1:] |= (a + shift)[1:] > reach[:-1]
    starts = np.nonzero(new)[0]
    return doc[starts], var[starts], a[starts], np.maximum.reduceat(b, starts)


def merge_runs(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge front-coded runs; ranges (doc, var, start, end) that occur in a smaller document."""
    commons, strings, cols = [], [], []
    for blob in map(_expand, blobs):
        n, at, out = int.from_bytes(blob[:8], "little"), 8, []
        for kind, width in (("u1", 1), ("u1", 1), ("u1", 1), ("<i8", 1), ("<i4", 1), ("<u4", 1), ("u1", LEFT)):
            out.append(np.frombuffer(blob, kind, n * width, at))
            at += out[-1].nbytes
        common, lengths, left_len, doc, var, pos, left = out
        commons.append(common.tolist())
        strings.append(decode(common, lengths, blob[at:]))
        cols.append([lengths, left_len, doc, var, pos, left.reshape(n, LEFT)])
    source, prefix = merge(strings, commons)
    del strings
    # the i-th output of a run is its i-th row
    source = np.array(source)
    offset = np.r_[0, np.cumsum([len(c) for c in commons])][:-1]
    nth = np.empty(len(source), np.int64)
    by_run = np.argsort(source, kind="stable")
    sorted_source = source[by_run]
    nth[by_run] = np.arange(len(source)) - np.searchsorted(sorted_source, sorted_source)
    order = offset[source] + nth
    right_len, left_len, doc, var, pos = (np.concatenate([c[i] for c in cols])[order] for i in range(5))
    left = np.concatenate([c[5] for c in cols])[order]
    prefix = np.array(prefix)
    prefix[0] = 0
    # suffixes with no neighbour of the same gram have no partner
    same = np.r_[prefix >= GRAM, False]
    alive = np.nonzero(same[:-1] | same[1:])[0]
    n = len(alive)
    none = np.empty(0, np.int64)
    if not n:
        return none, none, none, none
    # common prefix with the alive one before: dropped ones stand apart from both sides
    prefix = np.where(np.r_[False, np.diff(alive) == 1], prefix[alive], 0)
    right_len, left_len, doc, var, pos, left = right_len[alive].astype(np.int64), left_len[alive].astype(np.int64), doc[alive], var[alive], pos[alive].astype(np.int64), left[alive]
    least_l, most_l = np.full(n, LENGTH), np.full(n, -1)
    hashed = np.zeros(n, np.uint64)
    for l in range(LEFT + 1):
        if l:
            hashed = _mix(hashed * _M[1] + left[:, l - 1] + np.uint64(1))
        r = LENGTH - l
        # a suffix at least as long as r shares r bytes with the one before exactly if the common prefix says so
        ok = np.nonzero((right_len >= r) & (left_len >= l))[0]
        if not len(ok):
            continue
        key = _mix(np.cumsum(prefix < r).astype(np.uint64)[ok] * _M[2] + hashed[ok])
        turn = np.argsort(key, kind="stable")
        k, d = key[turn], doc[ok][turn]
        starts = np.nonzero(np.r_[True, k[1:] != k[:-1]])[0]
        smallest = np.repeat(np.minimum.reduceat(d, starts), np.diff(np.r_[starts, len(k)]))
        hit = ok[turn[d > smallest]]
        least_l[hit] = np.minimum(least_l[hit], l)
        most_l[hit] = l
    # strings through one anchor overlap in its gram, so what they cover is one range
    cut = most_l >= 0
    return doc[cut], var[cut], pos[cut] - most_l[cut], pos[cut] - least_l[cut] + LENGTH


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row."""
    spark = docs.sparkSession
    n_parts = partition_count(spark)
    # another name, so that both reads of the dealt texts have one plan and Spark shuffles them once
    named = docs.select(F.col("doc_id").try_cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text")).filter("doc is not null")
    # A doc_id of several texts: a hash of the text goes with it, which is 0 elsewhere. Those ids are told by a bitmap of
    # their hashes, of at most MARK_BITS / 64 rows, so no text is shuffled; an id that shares a bit gets its hash too, which does no harm.
    mark, place = F.xxhash64("text"), F.pmod(F.xxhash64("doc"), F.lit(MARK_BITS))
    several = named.groupBy("doc").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).filter("low <> high")
    words = several.select(place.alias("p")).groupBy(F.expr("p div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits"))
    named = named.withColumn("p", place).withColumn("word", F.expr("p div 64")).join(F.broadcast(words), "word", "left")
    marked = F.expr("coalesce(shiftright(bits, cast(p % 64 as int)) & 1, 0) = 1")
    named = named.select("doc", F.when(marked, F.hash("text")).otherwise(0).alias("var"), "text")
    # whole copies: the least doc_id of a text is an aggregate; the way back is salted, as one text may be most of the rows
    digests = named.select("doc", "var", F.unhex(F.sha2("text", 256)).alias("digest"), F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt"))
    least = digests.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("c")).filter("c > 1")
    least = least.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = digests.join(least, ["digest", "salt"]).filter("first < doc").select("doc", "var", F.lit(True).alias("copy")).distinct()
    dealt = named.repartition(n_parts, "doc", "var")
    wanted = _candidates(named).join(copies, ["doc", "var"], "left_anti")
    spans = _spans(dealt.join(wanted.hint("shuffle_hash"), ["doc", "var"]).select("doc", "var", "text", "at"))
    rows = dealt.join(spans.hint("shuffle_hash"), ["doc", "var"], "left").join(copies.hint("shuffle_hash"), ["doc", "var"], "left")
    rows = rows.select(F.col("doc").alias("doc_id"), "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy"))
    unnamed = docs.filter(F.col("doc_id").try_cast("long").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("binary").alias("spans"), F.lit(False).alias("copy"))
    return rows.unionByName(unnamed).mapInArrow(_describe, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut(text: bytes, spans: bytes | None, copy: bool) -> tuple[bytes, int]:
    """The bytes that stay, and the number of removed runs."""
    if copy and len(text) >= LENGTH:
        return b"", 1
    if not spans:
        return text, 0
    ranges = np.frombuffer(spans, "<i8").reshape(-1, 2).tolist()
    out, at = [], 0
    for a, b in ranges:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]]), len(ranges)


def _describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, removed, runs, digest = [], [], [], []
        for text, spans, copy in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            raw = text.as_py().encode()
            kept, n = cut(raw, spans, copy)
            size.append(len(raw))
            removed.append(len(raw) - len(kept))
            runs.append(n)
            digest.append(hashlib.sha256(kept).hexdigest())
        arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in (size, removed, runs)), pa.array(digest, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
