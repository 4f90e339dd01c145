"""SentencePiece encoding by Gumbel top-k without replacement, and decoding.

A text's segmentations are the paths of its lattice of vocabulary pieces (single
characters the vocabulary lacks are their bytes). The model's pieces carry merge
ranks only, so a piece of rank r gets the weight (r + RANK_SHIFT) ** -POWER and
a segmentation the product of its weights, normalised over all of them.

The search tree has a node for every prefix of pieces. The root's perturbed log
probability is one Gumbel draw; a node hands its value to the child that wins, and the
others get Gumbels of their own mass truncated at it. A node's value thus bounds
its subtree, and best-first search pops exact samples: the k segmentations with the
largest perturbed log probabilities, all distinct. A path's deviations are drawn
for its first STEPS pieces; the rest are one node of the remaining mass, opened
only if it is popped, so the samples are exact for texts of any length. The next
value in the queue is the threshold of the inclusion probabilities.

All draws are hashes of (seed, row key, sample, place), so a row gives the same
samples wherever and how often it runs, and a lost task's rerun repeats it.

Defined results: a null or empty text has one segmentation, of no pieces; a text with
fewer than k segmentations gives all of them, with inclusion 1; repeated rows give
equal samples; a null key is the key of the empty string; other columns pass or
are not read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from tessera.llm.exchange import bounded_batches

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, SEED = 2, 20
POWER, RANK_SHIFT = 1.0, 32.0
#: Pieces of a path whose deviations are drawn at once.
STEPS = 64
#: Bytes of text a task works on together, lattice nodes it remembers, and uses that let a chunk outlive a full memory.
BATCH_CHARS, CACHE_NODES, KEPT_USES = 200_000, 400_000, 3
SPACE = "▁"
_CHUNK = re.compile(r" *[^ ]+| +")
_G, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """In (0, 1), from 64-bit hashes."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Pieces:
    """The vocabulary: piece -> (id, log weight), and the bytes that each id decodes to."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.logw: dict[int, float] = {}
        self.byte_ids = [0] * 256
        decoded = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                decoded.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i):
                decoded.append(b"")
            else:
                text = piece.replace(SPACE, " ")
                self.ids[text] = i
                self.logw[i] = -POWER * math.log(min(-sp.get_score(i), float(n)) + RANK_SHIFT)
                decoded.append(text.encode())
        self.byte_logw = -POWER * math.log(n + RANK_SHIFT)
        self._trie()
        self.sizes = np.array([len(d) for d in decoded])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(decoded), np.uint8)

    def _trie(self) -> None:
        """States of all piece prefixes: ``step[state, letter]`` (0: none, 1: start), ``ends[state]`` the piece that ends there or -1."""
        state = {"": 1}
        for p in self.ids:
            for k in range(1, len(p) + 1):
                state.setdefault(p[:k], len(state) + 1)
        letters = sorted({c for p in self.ids for c in p})
        # letters that begin or continue longer pieces get a column each; the rest are pieces of one letter only
        inner = sorted({c for p in self.ids if len(p) > 1 for c in p})
        narrow = lambda top: np.uint16 if top < 1 << 16 else np.int32  # noqa: E731  a worker keeps these tables
        self.letter = np.zeros(0x110000, narrow(len(inner)))
        self.letter[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.single = np.full(0x110000, -1, np.int32)
        for c in letters:
            if c in self.ids:
                self.single[ord(c)] = self.ids[c]
        number = {c: i + 1 for i, c in enumerate(inner)}
        longer = [q for q in state if q and all(c in number for c in q)]
        order = {"": 1} | {q: i + 2 for i, q in enumerate(longer)}
        # rows in a compact form: dense for the first columns, a sorted list for the others
        keys, values = [], []
        for q in longer:
            keys.append(order[q[:-1]] * (len(inner) + 1) + number[q[-1]])
            values.append(order[q])
        at = np.argsort(keys)
        self.keys, self.values, self.columns = np.array(keys, np.int64)[at], np.array(values, np.int32)[at], len(inner) + 1
        self.ends = np.full(len(order) + 2, -1, np.int32)
        for q, i in order.items():
            self.ends[i] = self.ids.get(q, -1)
        common = [c for c in inner if c < "\u0250"]
        self.dense_of = np.zeros(len(inner) + 1, np.int32)
        self.dense_of[[number[c] for c in common]] = np.arange(1, len(common) + 1)
        self.dense = np.zeros((len(order) + 2, len(common) + 1), narrow(len(order) + 2))
        for q in longer:
            if q[-1] < "\u0250":
                self.dense[order[q[:-1]], self.dense_of[number[q[-1]]]] = order[q]
        self.weights = np.full(max(self.logw) + 1, -np.inf)
        for i, w in self.logw.items():
            self.weights[i] = w

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The states after one letter (as a number of ``letter``); 0 where no piece goes on."""
        column = self.dense_of[letter]
        out = self.dense[state, column].astype(np.int32)
        rare = np.nonzero((column == 0) & (letter > 0))[0]
        if len(rare):
            key = state[rare].astype(np.int64) * self.columns + letter[rare]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[rare] = np.where(self.keys[k] == key, self.values[k], 0)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of a segmentation; the space put before the text goes again."""
        lens = self.sizes[ids]
        ends = np.cumsum(lens)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - lens), lens)
        return self.bytes[at].tobytes().decode("utf-8", "replace")[1:]


def _grown(x: np.ndarray, used: int, need: int) -> np.ndarray:
    """Room for ``need`` values and a third more, the first ``used`` kept."""
    out = np.empty(need + need // 3, x.dtype)
    out[:used] = x[:used]
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def chunk_starts(codes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where chunks start in joined texts that start at ``texts``, each with a space: at every space that follows none."""
    space = codes == 32
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[texts] = True
    return np.flatnonzero(first)


_powers = np.ones(1, np.uint64)


def _chunk_hashes(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    global _powers
    if not len(starts):
        return np.empty(0, np.uint64)
    longest = int(sizes.max())
    if longest > len(_powers):
        _powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(longest, _G)))
    x = (codes.astype(np.uint64) + np.uint64(1)) * _M1
    x ^= x >> np.uint64(29)
    x *= _powers[np.arange(len(codes)) - np.repeat(starts, sizes)]
    return _hash(np.add.reduceat(x, starts) + sizes.astype(np.uint64) * _M2)


class Lattices:
    """Lattices of chunks in flat arrays: nodes with their edges, each with log probability, target and piece.

    A node's edges stand from the longest piece to the shortest; ``upto`` adds their probabilities up.
    An edge's ``piece`` is an id, or -1 - c for the character ``extra[c]`` as its bytes.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.reset()
        self.edge0, self.width = np.zeros(1024, np.int32), np.zeros(1024, np.int8)
        self.logp, self.target, self.piece, self.upto = np.zeros(4096), np.zeros(4096, np.int32), np.zeros(4096, np.int32), np.zeros(4096, np.float32)

    def reset(self) -> None:
        """Forget all lattices; the arrays keep their room."""
        self.first_node: dict[int, int] = {}
        self.uses, self.code = np.zeros(1024, np.int64), np.zeros(1024, np.uint32)
        self.n_nodes = self.n_edges = 0
        self.extra: list[tuple[int, ...]] = []
        self.extra_at: dict[int, int] = {}

    def shrink(self) -> None:
        """Forget the lattices of rare chunks; the others start anew, the most used first, in half the memory at most."""
        first = np.sort(np.fromiter(self.first_node.values(), np.int64, len(self.first_node)))
        size = np.diff(first, append=self.n_nodes)
        order = np.argsort(-self.uses[first], kind="stable")
        order = order[(self.uses[first][order] >= KEPT_USES) & (np.cumsum(size[order]) <= CACHE_NODES // 2)]
        codes = self.code[_ranges(first[order], size[order])]
        self.reset()
        if len(codes):
            self.rows(codes, np.cumsum(size[order]) - size[order])

    def _edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Edges (position, length, piece, log weight) of characters ``codes``; ``left``: characters to the end of the chunk."""
        pieces = self.pieces
        letter = pieces.letter[codes]
        at = np.arange(len(codes))
        single = pieces.single[codes]
        weight = np.where(single >= 0, pieces.weights[np.maximum(single, 0)], 0.0)
        for c in np.unique(codes[single < 0]).tolist():  # characters without a piece are their bytes
            raw = chr(c).encode()
            if len(raw) == 1:
                code = pieces.byte_ids[raw[0]]
            else:
                if c not in self.extra_at:
                    self.extra_at[c] = len(self.extra)
                    self.extra.append(tuple(pieces.byte_ids[b] for b in raw))
                code = -1 - self.extra_at[c]
            here = codes == c
            single[here], weight[here] = code, pieces.byte_logw * len(raw)
        found = [(at, np.ones(len(at), np.int64), single, weight)]
        state = pieces.step(np.ones(len(at), np.int32), letter)
        length = 1
        while True:
            go = (state > 0) & (left[at] > length)
            at, state = at[go], state[go]
            if not len(at):
                break
            state = pieces.step(state, letter[at + length])
            length += 1
            ends = pieces.ends[state]
            hit = ends >= 0
            found.append((at[hit], np.full(int(hit.sum()), length), ends[hit], pieces.weights[ends[hit]]))
        return tuple(np.concatenate(c) for c in zip(*reversed(found)))

    def rows(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The first node of each chunk of ``codes``, after adding lattices not seen before. A 64-bit hash stands for a chunk."""
        known = self.first_node
        sizes = np.diff(starts, append=len(codes))
        hashes, at, which = np.unique(_chunk_hashes(codes, starts, sizes), return_index=True, return_inverse=True)
        keys = hashes.tolist()
        new = np.array([i for i, k in enumerate(keys) if k not in known], np.int64)
        if len(new):
            lens = sizes[at[new]]
            begin = np.cumsum(lens) - lens
            known.update(zip(hashes[new].tolist(), (begin + self.n_nodes).tolist()))
            codes = codes[_ranges(starts[at[new]], lens)]
            left = np.repeat(begin + lens, lens) - np.arange(len(codes))
            at, length, piece, weight = self._edges(codes, left)
            order = np.argsort(at, kind="stable")  # lengths descend within a position already
            at, length, piece, weight = at[order], length[order], piece[order], weight[order]
            width = np.bincount(at, minlength=len(codes))
            first = np.cumsum(width) - width
            last = left[at] == length
            target = np.where(last, len(codes), at + length)
            beta = np.zeros(len(codes) + 1)  # log mass of all segmentations of the rest of the chunk
            # positions by characters left, so that every edge leads to one whose mass is known
            nodes = np.argsort(left, kind="stable")
            wide = width[nodes]
            ends = np.concatenate([[0], np.cumsum(wide)])
            turn = np.repeat(first[nodes] - ends[:-1], wide) + np.arange(len(at))
            w, t = weight[turn], target[turn]
            rounds = np.flatnonzero(np.diff(left[nodes], prepend=-1, append=-1)).tolist()
            for a, b in zip(rounds, rounds[1:]):
                x, y = ends[a], ends[b]
                beta[nodes[a:b]] = np.logaddexp.reduceat(w[x:y] + beta[t[x:y]], ends[a:b] - x)
            logp = weight + beta[target] - beta[at]
            self._append(codes, logp, np.where(last, -1, target + self.n_nodes), piece.astype(np.int32), width.astype(np.int32))
        out = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))
        self.uses[out] += np.bincount(which, minlength=len(out))
        return out[which]

    def _append(self, codes: np.ndarray, logp: np.ndarray, target: np.ndarray, piece: np.ndarray, width: np.ndarray) -> None:
        e, n = self.n_edges, self.n_nodes
        e1, n1 = e + len(logp), n + len(width)
        if e1 > len(self.logp):
            self.logp, self.target, self.piece, self.upto = (_grown(x, e, e1) for x in (self.logp, self.target, self.piece, self.upto))
        if n1 > len(self.width):
            self.edge0, self.width = (_grown(x, n, n1) for x in (self.edge0, self.width))
        if n1 > len(self.code):
            self.code, self.uses = (_grown(x, n, n1) for x in (self.code, self.uses))
        self.code[n:n1], self.uses[n:n1] = codes, 0
        self.logp[e:e1], self.target[e:e1], self.piece[e:e1] = logp, target, piece
        starts = np.cumsum(width) - width
        self.edge0[n:n1], self.width[n:n1] = e + starts, width
        p = np.exp(logp)
        total = np.cumsum(p)
        self.upto[e:e1] = total - np.repeat(total[starts] - p[starts], width)
        self.upto[e + starts + width - 1] = 2.0  # the last edge takes what is left
        self.n_edges, self.n_nodes = e1, n1

    def walk(self, start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One path from each start node (-1: none left): (index into ``start``, edge) in order of index, then place."""
        index = np.nonzero(start >= 0)[0]
        node, key = start[index], key[index]
        found, edges, step = [], [], 0
        while len(index):
            u = _unit(_hash(key + np.uint64(step * int(_G) & (2**64 - 1)))).astype(np.float32)
            edge = self.edge0[node]
            on = np.flatnonzero(u >= self.upto[edge])
            while len(on):
                edge[on] += 1
                on = on[u[on] >= self.upto[edge[on]]]
            found.append(index)
            edges.append(edge)
            node = self.target[edge]
            more = node >= 0
            index, node, key = index[more], node[more], key[more]
            step += 1
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        every, edge = np.concatenate(found), np.concatenate(edges)
        order = np.argsort(every, kind="stable")
        return every[order], edge[order]


@dataclass
class Sample:
    """One segmentation of a row."""

    ids: np.ndarray
    log_prob: float
    perturbed: float


@dataclass
class _Path:
    edges: np.ndarray
    log_prob: float
    perturbed: float


def _truncated(mass: np.ndarray, bound: np.ndarray | float, draw: np.ndarray) -> np.ndarray:
    """Gumbels of log mass ``mass`` truncated at ``bound``; ``draw`` is uniform in (0, 1)."""
    return -np.logaddexp(-bound, np.log(-np.log(draw)) - mass)


class _Row:
    """The search of one text: its paths so far and its queue of (minus value, order, path, step, edge); edge -1 is 'later than step'."""

    __slots__ = ("chunks", "key", "paths", "queue", "n")

    def __init__(self, chunks: np.ndarray, key: int) -> None:
        self.chunks, self.key = chunks, key
        self.paths: list[_Path] = []
        self.queue: list[tuple[float, int, int, int, int]] = []
        self.n = 0

    def push(self, value: float, path: int, step: int, edge: int) -> None:
        if value > -math.inf:
            self.n += 1
            heapq.heappush(self.queue, (-value, self.n, path, step, edge))


def chunks_of(text: str) -> list[str]:
    """A space and the text, cut so that a chunk is spaces and the word after them; pieces do not cross chunks."""
    return _CHUNK.findall(" " + text)


class Sampler:
    """Distinct sampled segmentations of texts, in batches."""

    def __init__(self, model: str | Pieces = DEFAULT_MODEL, k: int = SAMPLES, seed: int = SEED) -> None:
        if not 1 <= k <= 63:
            raise ValueError("k must be from 1 to 63")
        self.pieces = model if isinstance(model, Pieces) else Pieces(model)
        self.lattices = Lattices(self.pieces)
        self.k, self.seed = k, seed

    def key(self, row_key: object) -> int:
        return xxhash.xxh3_64_intdigest("" if row_key is None else str(row_key), seed=self.seed)

    def sample(self, keys: list[object], texts: list[str | None]) -> list[tuple[list[Sample], float]]:
        """For each text its samples, best first, and the threshold (-inf if there are no further segmentations)."""
        lat = self.lattices
        if lat.n_nodes > CACHE_NODES:
            lat.shrink()
        whole = [" " + t if t else "" for t in texts]
        ends = np.cumsum([len(t) for t in whole])
        begin = ends - [len(t) for t in whole]
        codes = np.frombuffer("".join(whole).encode("utf-32-le"), np.uint32)
        starts = chunk_starts(codes, begin[ends > begin])
        every = lat.rows(codes, starts)
        cuts = np.searchsorted(starts, np.append(begin, len(codes)))
        rows = [_Row(every[cuts[i] : cuts[i + 1]], self.key(k)) for i, k in enumerate(keys)]
        for j in range(self.k):
            self._extend(rows, j)
        out = []
        for row in rows:
            if not len(row.chunks):
                out.append(([Sample(np.empty(0, np.int32), 0.0, 0.0)], -math.inf))
                continue
            bound = -row.queue[0][0] if row.queue and len(row.paths) == self.k else -math.inf
            out.append(([Sample(self._ids(p.edges), p.log_prob, p.perturbed) for p in row.paths], bound))
        return out

    def _extend(self, rows: list[_Row], j: int) -> None:
        """Pop each row's next sample and walk its path to the end, all rows together."""
        lat = self.lattices
        starts, keys, prefix, tops, live, begins = [], [], [], [], [], []
        for row in rows:
            if not len(row.chunks):
                continue
            head: np.ndarray = np.empty(0, np.int64)
            begin = 0
            if j == 0:
                top = float(-np.log(-np.log(_unit(_hash(np.array([row.key], np.uint64) + _M2))))[0])
                start = row.chunks
            else:
                while row.queue and row.queue[0][4] == -1:  # a rest of deviations: open it
                    value, _, index, step, _ = heapq.heappop(row.queue)
                    _open_rest(lat, row, index, step, -value)
                if not row.queue:
                    continue
                value, _, index, step, edge = heapq.heappop(row.queue)
                top = -value
                head = np.append(row.paths[index].edges[:step], edge)
                begin = step + 1
                # chunks finished by the head, and the node that it ends in
                ended = lat.target[head] < 0
                done = int(ended.sum())
                start = row.chunks.copy()
                start[:done] = -1
                if not ended[-1]:
                    start[done] = lat.target[edge]
            live.append(row)
            prefix.append(head)
            tops.append(top)
            begins.append(begin)
            starts.append(start)
            place = np.arange(len(start), dtype=np.uint64) + np.uint64((row.key ^ (0xD1342543DE82EF95 * (j + 1))) & (2**64 - 1))
            keys.append(_hash(place * _G))
        if not live:
            return
        sizes = np.array([len(s) for s in starts])
        index, edge = lat.walk(np.concatenate(starts), np.concatenate(keys))
        if j:
            cuts = np.searchsorted(np.repeat(np.arange(len(live)), sizes)[index], np.arange(len(live) + 1))
            edge = np.concatenate([x for i, head in enumerate(prefix) for x in (head, edge[cuts[i] : cuts[i + 1]])])
            lens = np.diff(cuts) + np.array([len(x) for x in prefix])
        else:
            lens = np.bincount(np.repeat(np.arange(len(live)), sizes)[index], minlength=len(live))
        self._queue_new(live, edge, lens, np.array(begins), np.array(tops))

    def _queue_new(self, live: list[_Row], edges: np.ndarray, lens: np.ndarray, begin: np.ndarray, tops: np.ndarray) -> None:
        """Record each row's new path and queue its deviations: its own steps only, those before ``begin`` belong to the paths it left."""
        lat = self.lattices
        start = np.cumsum(lens) - lens
        logp = lat.logp[edges]
        after = np.cumsum(logp)
        before = after - logp
        base = before[start]
        total = after[start + lens - 1] - base
        seeds = np.empty(len(live), np.uint64)
        for i, row in enumerate(live):
            row.paths.append(_Path(edges[start[i] : start[i] + lens[i]], float(total[i]), float(tops[i])))
            seeds[i] = row.key + 0x5851F42D4C957F2D * len(row.paths) & (2**64 - 1)
        count = np.minimum(STEPS, lens - begin)
        end = begin + count
        row_of = np.repeat(np.arange(len(live)), count)
        at = np.repeat(start + begin - (np.cumsum(count) - count), count) + np.arange(len(row_of))
        step = at - start[row_of]
        which, edge, place = _others(lat, edges[at], step)
        rows = row_of[which]
        mass = before[at[which]] - base[rows] + lat.logp[edge]
        # the ways to leave a path after its first steps, as one
        upto = np.where(end < lens, before[np.minimum(start + end, len(edges) - 1)] - base, total)
        rest = np.nonzero((end < lens) & (total < upto))[0]
        rows = np.concatenate([rows, rest])
        mass = np.concatenate([mass, upto[rest] + np.log1p(-np.exp(total[rest] - upto[rest]))])
        place = np.concatenate([place, _rest_place(end[rest])])
        edge = np.concatenate([edge, np.full(len(rest), -1)])
        steps = np.concatenate([step[which], end[rest]])
        draw = _unit(_hash(_hash(place + seeds[rows]) + _G))
        value = _truncated(mass, tops[rows], draw)
        order = np.lexsort((-value, rows))
        rank = np.arange(len(rows)) - np.searchsorted(rows[order], rows[order])
        order = order[rank <= self.k]  # no path can give more of the k samples and the threshold
        for i, v, st, e in zip(rows[order].tolist(), value[order].tolist(), steps[order].tolist(), edge[order].tolist()):
            live[i].push(v, len(live[i].paths) - 1, st, e)

    def _ids(self, edges: np.ndarray) -> np.ndarray:
        ids = self.lattices.piece[edges]
        if len(ids) and ids.min() < 0:
            extra = self.lattices.extra
            return np.array([x for i in ids.tolist() for x in ((i,) if i >= 0 else extra[-1 - i])], np.int32)
        return ids

    def decode(self, ids: np.ndarray) -> str:
        return self.pieces.decode(ids) if len(ids) else ""


def _others(lat: Lattices, edges: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For edges taken at steps: (index of the step, other edge of the same node, place of that edge for drawing)."""
    node = np.searchsorted(lat.edge0[: lat.n_nodes], edges, "right") - 1
    width = lat.width[node].astype(np.int64)
    which = np.repeat(np.arange(len(edges)), width)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(width) - width, width)
    edge = lat.edge0[node][which] + nth
    other = edge != edges[which]
    which, edge, nth = which[other], edge[other], nth[other]
    return which, edge, (step[which].astype(np.uint64) << np.uint64(20)) + nth.astype(np.uint64)


def _rest_place(end: np.ndarray) -> np.ndarray:
    return (end.astype(np.uint64) << np.uint64(20)) + np.uint64(1 << 19)


def _open_rest(lat: Lattices, row: _Row, index: int, begin: int, top: float) -> None:
    """Open a rest of deviations: draw its parts, given that the largest has the rest's value."""
    path = row.paths[index]
    end = min(len(path.edges), begin + STEPS)
    prefix = np.concatenate([[0.0], np.cumsum(lat.logp[path.edges])])
    which, edge, place = _others(lat, path.edges[begin:end], np.arange(begin, end))
    mass, steps = prefix[begin + which] + lat.logp[edge], begin + which
    a, b = prefix[end], prefix[-1]
    if end < len(path.edges) and b < a:
        mass, steps, edge = np.append(mass, a + math.log1p(-math.exp(b - a))), np.append(steps, end), np.append(edge, -1)
        place = np.append(place, _rest_place(np.array([end])))
    if not len(mass):
        return
    seed = np.uint64(row.key + 0x2545F4914F6CDD1D * (index + 1) & (2**64 - 1))
    raw = mass - np.log(-np.log(_unit(_hash(_hash(place + seed) + _G))))
    win = int(np.argmax(raw))
    # exp(-value) = exp(-top) - exp(-z) + exp(-raw), in logarithms
    z = raw[win]
    for i in np.argsort(-raw)[:64].tolist():  # more than 63 samples are not asked for
        value = top if i == win else -float(np.logaddexp(-top, -raw[i] + math.log1p(-math.exp(min(raw[i] - z, -1e-12)))))
        row.push(value, index, int(steps[i]), int(edge[i]))


def inclusion(log_prob: float, threshold: float) -> float:
    """The probability that a segmentation is among the samples, given the threshold."""
    if threshold == -math.inf:
        return 1.0
    return -math.expm1(-math.exp(min(700.0, log_prob - threshold)))


def _batches(b: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Row ranges of about BATCH_CHARS bytes."""
    lens = [n or 0 for n in pc.binary_length(b.column(1)).to_pylist()]
    a = size = 0
    for i, n in enumerate(lens):
        if size and size + n > BATCH_CHARS:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(lens):
        yield a, len(lens)


_kept: dict[str, Pieces] = {}


def _run(batches: Iterable[pa.RecordBatch], model_file: str, k: int, seed: int) -> Iterator[pa.RecordBatch]:
    # A worker process keeps the vocabulary for its next tasks, but no lattices, which are large.
    if model_file not in _kept:
        _kept.clear()
        _kept[model_file] = Pieces(model_file)
    sampler = Sampler(_kept[model_file], k, seed)
    for b in batches:
        for a, z in _batches(b):
            part = b.slice(a, z - a)
            texts = part.column(1).to_pylist()
            where, found, bounds = [], [], []
            for i, (samples, bound) in enumerate(sampler.sample(part.column(0).to_pylist(), texts)):
                where += [i] * len(samples)
                found += samples
                bounds += [bound] * len(samples)
            decoded = [sampler.decode(s.ids) for s in found]
            sizes = np.array([len(s.ids) for s in found], np.int64)
            nth = np.arange(len(where)) - np.searchsorted(where, where)
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.concatenate([s.ids for s in found]), pa.int32()))
            arrays = [
                part.column(0).take(pa.array(where, pa.int64())),
                pa.array(nth, pa.int32()),
                pa.array(sizes),
                pa.array([s.log_prob for s in found], pa.float64()),
                pa.array([s.perturbed for s in found], pa.float64()),
                pa.array([inclusion(s.log_prob, x) for s, x in zip(found, bounds)], pa.float64()),
                ids,
                pa.array(decoded, pa.string()),
                pa.array([t == (texts[i] or "") for t, i in zip(decoded, where)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "ids", "decoded", "round_trip"])


def segmentations(docs: DataFrame, model_file: str = DEFAULT_MODEL, k: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """A row per row of ``docs`` and sample: ids, the decoded text, and whether that is the text again.

    ``model_file`` must be readable under the same path on every executor.
    """
    bounded_batches(docs.sparkSession)
    run = partial(_run, model_file=model_file, k=k, seed=seed)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids array<int>, decoded string, round_trip boolean")
