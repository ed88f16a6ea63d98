"""SentencePiece encoding and decoding with distinct sampled segmentations (operator 2).

A text is encoded over the pieces of a SentencePiece model: spaces become the meta
symbol, one stands before the text, characters without a piece fall back to bytes.
The lattice of all segmentations is a chain of words (pieces never run across the
start of a run of spaces), and a piece of rank r (place in the model) has the
weight (r + SHIFT) ** -POWER, so that each segmentation has a probability.

`k` segmentations are drawn without replacement by Gumbel top-k: perturbed A-star
search. A queue holds regions of the lattice (all segmentations that share the words
before one place and differ from given ones in it), each with the perturbed value of
its best segmentation. The best region is taken, its segmentation is drawn (the
summed weights of suffixes guide the draw), what is left of the region is split and
queued with values truncated at its own. The search stops after k draws; the best
value left is the threshold kappa, and the inclusion score of a segmentation of
log-probability l is 1 - exp(-exp(l - kappa)). All random numbers are hashes of the
row key, the draw and the place, the same in any partitioning.

Decoding joins the pieces' bytes; what encode gives, decode turns back into the text.

Cases: null and empty texts are the lone meta symbol, one segmentation with inclusion
score 1; texts with fewer than k segmentations give them all (what is left of a word counts as
none below a share of LEAST for each of its bytes, which is what rounding may leave); the meta symbol itself in a text reads as a space, as in
the library; a word of any length is one lattice (weights are summed as logarithms); rows with the same
key and text draw the same; an empty table gives no rows; columns other than the key
and text are not read.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsurf.llm import common, repeats

SAMPLES = 3
SHIFT, POWER = 10.0, 0.5
META = "▁"
#: Share of a word's segmentations, for each of its bytes, that rounding may leave where nothing is left.
LEAST = 1e-12


class Vocabulary:
    """Pieces of a model as bytes (meta symbol as a space), their log weights and a trie."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        words: dict[bytes, int] = {}
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                v = int(p[1:-1], 16)
                self.bytes[i], self.byte_id[v] = bytes([v]), i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes[i] = p.replace(META, " ").encode()
                words.setdefault(self.bytes[i], i)
        self.log = -POWER * np.log(np.arange(n) + SHIFT)
        # trie: child of a node by byte; 0 is none, node 0 the root
        table: list[dict[int, int]] = [{}]
        at_end: list[int] = [-1]
        for b, i in words.items():
            node = 0
            for c in b:
                nxt = table[node].get(c)
                if nxt is None:
                    nxt = len(table)
                    table[node][c] = nxt
                    table.append({})
                    at_end.append(-1)
                node = nxt
            at_end[node] = i
        # nodes with children come first, so that a node's number tells whether it has any
        inner = [k for k, t in enumerate(table) if t]
        order = np.array(inner + [k for k, t in enumerate(table) if not t])
        number = np.empty(len(table), np.int32)
        number[order] = np.arange(len(order))
        self.inner = max(1, len(inner))
        child = np.zeros((self.inner, 256), np.int32)
        for k, node in enumerate(inner):
            for c, nxt in table[node].items():
                child[k, c] = number[nxt]
        self.child = child.ravel()  # by node * 256 + byte
        self.piece = np.array(at_end, np.int32)[order]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a run of ids."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def normal(text: str | None) -> bytes:
    """The bytes that are cut into pieces: meta symbols as spaces, one space before."""
    return b" " + (text or "").replace(META, " ").encode("utf-8", "surrogatepass")


class Lattice:
    """All piece edges of some words: of each byte position its edges, and the summed weight of suffixes.

    Positions are numbered by their distance from the word's end, and edges lie in that order, so that those of one distance are one slice.
    """

    def __init__(self, voc: Vocabulary, raw: np.ndarray, start: np.ndarray, stop: np.ndarray):
        n = len(raw)
        end = np.repeat(stop, stop - start)
        lead = (raw & 0xC0) != 0x80
        found = []  # place, piece, length, edges of the place before it
        at = np.flatnonzero(lead)
        node = np.zeros(len(at), np.int32)
        depth = 0
        char = np.ones(n, np.int8)
        char[raw >= 0xC0], char[raw >= 0xE0], char[raw >= 0xF0] = 2, 3, 4
        single = np.zeros(n, bool)
        self.count = np.zeros(n, np.int32)
        while len(at):
            node = voc.child[(node << 8) + raw[at + depth]]
            depth += 1
            live = np.flatnonzero(node)
            at, node = at[live], node[live]
            hit = voc.piece[node]
            ok = np.flatnonzero(hit >= 0)
            own = at[ok]
            before = self.count[own]
            self.count[own] = before + 1
            found.append((own, hit[ok], depth, before))
            if depth <= 4:
                single[own[char[own] == depth]] = True
            more = np.flatnonzero((node < voc.inner) & (at + depth < end[at]))
            at, node = at[more], node[more]
        # characters without a piece: their bytes
        owner = np.maximum.accumulate(np.where(lead, np.arange(n), 0))
        lone = np.flatnonzero(~single[owner])
        found.append((lone, voc.byte_id[raw[lone]], 1, self.count[lone]))
        self.count[lone] += 1
        left = end - np.arange(n)
        most = int(left.max(initial=0))
        pos = np.argsort(left.astype(np.int16) if most < 1 << 15 else left, kind="stable")
        pos = pos[self.count[pos] > 0]
        k = self.count[pos]
        stops = np.cumsum(k, dtype=np.int64)
        head = stops - k
        self.first = np.zeros(n, np.int64)
        self.first[pos] = head
        mine = np.repeat(np.arange(len(pos)), k)  # of each edge the number of its position
        self.id, self.size = np.empty(len(mine), np.int32), np.empty(len(mine), np.int32)
        for a, i, z, before in found:
            e = self.first[a] + before
            self.id[e], self.size[e] = i, z
        # logarithms of the suffix sums, from the words' ends on; total[n] is that of nothing
        self.log_weight = voc.log[self.id]
        self.total = np.zeros(n + 1)
        at = pos[mine]
        to = at + self.size
        to[to == end[at]] = n
        part = self.log_weight.copy()
        groups = np.searchsorted(left[pos], np.arange(1, most + 2)).tolist()
        for p, q in zip(groups[:-1], groups[1:], strict=True):
            if p == q:
                continue
            a, z = int(head[p]), int(stops[q - 1])
            part[a:z] += self.total[to[a:z]]
            heads = head[p:q] - a
            best = np.maximum.reduceat(part[a:z], heads)
            self.total[pos[p:q]] = best + np.log(np.add.reduceat(np.exp(part[a:z] - best[mine[a:z] - p]), heads))
        self.chance = np.exp(part - self.total[at])
        # cumulative chances of a position's edges; the last edge takes what is left
        total = np.cumsum(self.chance)
        self.step = (total - (total[head] - self.chance[head])[mine]).astype(np.float32)
        self.step[stops - 1] = 2.0


_M = (1 << 64) - 1
PLACE = 0x9E3779B97F4A7C15


def _mix(h: int) -> int:
    """common.mix64 of one number."""
    h ^= h >> 31
    h = h * 0x7FB5D329728EA185 & _M
    h ^= h >> 27
    h = h * 0x81DADEF4BC2DD44D & _M
    return h ^ h >> 33


def uniform_one(seed: int, draw: int, place: int) -> float:
    """uniform() of one place."""
    h = _mix(_mix(seed + place * PLACE & _M) + draw * 0xBF58476D1CE4E5B9 & _M)
    return ((h >> 11) + 0.5) * 2.0**-53


def uniform(seed: np.ndarray, draw, place: np.ndarray) -> np.ndarray:
    h = common.mix64(common.mix64(seed + place.astype(np.uint64) * np.uint64(PLACE)) + np.uint64(draw * 0xBF58476D1CE4E5B9 & _M))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Words:
    """A slice of texts as a chain of words, with the lattice of its distinct words."""

    def __init__(self, voc: Vocabulary, texts: list[str | None], seeds: np.ndarray):
        self.voc = voc
        parts = [normal(t) for t in texts]
        self.raw = raw = np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([len(p) for p in parts], np.int64)
        self.doc = np.cumsum(size) - size
        self.doc_end = np.cumsum(size)
        space = raw == 32
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[self.doc] = True
        self.opens = begin
        start = np.flatnonzero(begin)
        self.start, self.stop = start, np.append(start[1:], len(raw))
        self.least = LEAST * (self.stop - self.start)
        prints = repeats.Prints(common.BYTE_MIX[raw])
        _, pick, self.kind = np.unique(prints.of(self.start, self.stop), return_index=True, return_inverse=True)
        w = self.stop[pick] - self.start[pick]
        at = np.repeat(self.start[pick] - (np.cumsum(w) - w), w) + np.arange(int(w.sum()))
        self.base = np.cumsum(w) - w
        self.lattice = Lattice(voc, raw[at], self.base, self.base + w)
        self.total = self.lattice.total[self.base][self.kind]
        self.shift = self.base[self.kind] - self.start  # from a place in the texts to that in the distinct words
        self.owner = np.searchsorted(self.doc, self.start, "right") - 1
        self.first_word = np.searchsorted(self.owner, np.arange(len(texts) + 1))
        self.seed = common.mix64(np.asarray(seeds, np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))

    def draw(self, which: np.ndarray, number: int, edge: np.ndarray) -> None:
        """Samples the words `which`, writing into edge (by byte: edge of the lattice + 1) what starts there."""
        at, stop, shift = self.start[which], self.stop[which], self.shift[which]
        # uniform() of places in the text, from places in the slice
        seed = (self.seed - self.doc.astype(np.uint64) * np.uint64(PLACE))[self.owner[which]]
        lat = self.lattice
        while len(at):
            u = uniform(seed, number, at).astype(np.float32)
            e = lat.first[at + shift]
            on = np.flatnonzero(lat.step[e] <= u)
            v, next_ = u[on], e[on] + 1
            while len(on):
                e[on] = next_
                more = np.flatnonzero(lat.step[next_] <= v)
                on, v, next_ = on[more], v[more], next_[more] + 1
            edge[at] = e + 1
            at = at + lat.size[e]
            live = np.flatnonzero(at < stop)
            if len(live) < len(at):
                at, stop, shift, seed = at[live], stop[live], shift[live], seed[live]

    def word_logs(self, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-probability of each word's segmentation; the pieces of all words, and the first one of each word."""
        at = np.flatnonzero(edge != 0)
        own = self.lattice.id[edge[at] - 1]
        head = np.flatnonzero(self.opens[at])
        return np.minimum(np.add.reduceat(self.voc.log[own], head) - self.total, 0.0), own, head

    def other(self, word: int, doc: int, number: int, banned: list[tuple[int, ...]]) -> list[int]:
        """A segmentation of a word (its edges) that is none of the banned ones, drawn by what they leave at each step."""
        lat, at, stop = self.lattice, int(self.start[word] + self.shift[word]), int(self.stop[word] + self.shift[word])
        logs = [sum(float(lat.log_weight[e]) for e in b) - float(self.total[word]) for b in banned]
        alive = [(b, float(np.exp(v))) for b, v in zip(banned, logs, strict=True)]
        reach, path, step, seed = 1.0, [], 0, int(self.seed[doc])
        while at < stop:
            e0, k = int(lat.first[at]), int(lat.count[at])
            chance = lat.chance[e0 : e0 + k].tolist()  # a few numbers: lists are faster than arrays
            share = [reach * c for c in chance]
            for b, p in alive:
                share[b[step] - e0] -= p
            total = list(itertools.accumulate(max(c, 0.0) for c in share))
            if not total[-1] > 0:
                total = list(range(1, k + 1))
            u = uniform_one(seed, number, (1 << 40) + step)
            pick = e0 + min(k - 1, bisect.bisect_right([t / total[-1] for t in total], u))
            reach *= chance[pick - e0]
            alive = [(b, p) for b, p in alive if b[step] == pick]
            path.append(pick)
            at += int(lat.size[pick])
            step += 1
        return path


def sample(voc: Vocabulary, texts: list[str | None], seeds, k: int = SAMPLES):
    """For each text its draws, best first: (piece ids, log-probability, perturbed value, inclusion score)."""
    n = len(texts)
    if not n:
        return []
    words = Words(voc, texts, np.asarray(seeds))
    zero = np.zeros(n, np.int64)
    # value of the best of all segmentations: a standard Gumbel variable
    best = -np.log(-np.log(uniform(words.seed, 0, zero + (1 << 41))))
    edges: list[np.ndarray] = []
    ids: list[list[np.ndarray]] = []  # of each draw and text

    def path(draw: int, w: int) -> tuple[int, ...]:
        """The edges of a word in a draw."""
        own = edges[draw][words.start[w] : words.stop[w]]
        return tuple((own[own > 0] - 1).tolist())

    queue: list[list] = [[(-best[d], 0, int(words.first_word[d]), -1, ())] for d in range(n)]
    drawn: list[list] = [[] for _ in range(n)]
    for r in range(1, k + 1):
        edge = np.zeros(len(words.raw), np.int32)
        take = [heapq.heappop(q) if q else None for q in queue]
        fresh = np.array([words.first_word[d + 1] if t is None else t[2] + (t[3] >= 0) for d, t in enumerate(take)], np.int64)
        word_no = np.arange(len(words.start))
        words.draw(np.flatnonzero(word_no >= fresh[words.owner]), r, edge)
        for d, t in enumerate(take):
            if t is None or t[3] < 0:
                continue
            _, _, w, parent, banned = t
            if banned is None:  # what the word is in the draw that left this region
                banned = (path(parent, w),)
                take[d] = (*t[:4], banned)
            a, z = int(words.doc[d]), int(words.start[w])
            edge[a:z] = edges[parent][a:z]
            at = z
            for e in words.other(w, d, r, list(banned)):
                edge[at] = e + 1
                at += int(words.lattice.size[e])
        none = np.array([t is None for t in take])
        if none.any():  # placeholders keep the words' sums aligned; such texts are not read again
            for d in np.flatnonzero(none):
                edge[words.doc[d] : words.doc_end[d]] = edges[0][words.doc[d] : words.doc_end[d]]
        log, own, head = words.word_logs(edge)
        edges.append(edge)
        cut = np.append(head, len(own))[words.first_word].tolist()
        ids.append([own[a:z] for a, z in itertools.pairwise(cut)])
        # what each word leaves to others: mass of the words before it, times that of its other segmentations
        before = np.cumsum(log) - log
        before -= before[words.first_word[:-1]][words.owner]
        with np.errstate(divide="ignore", over="ignore"):
            rest = -np.expm1(log)
            mass = before + np.log(np.where(rest > words.least, rest, 0.0))
            value = np.array([-t[0] if t else 0.0 for t in take])
            noise = -np.log(uniform(words.seed[words.owner], r, (1 << 42) + word_no - words.first_word[words.owner]))
            seen = -np.log(np.exp(-value)[words.owner] + noise * np.exp(-mass))
        for d, t in enumerate(take):
            if t is None:
                continue
            a, z = int(words.first_word[d]), int(words.first_word[d + 1])
            total = float(log[a:z].sum())
            drawn[d].append((r - 1, total, -t[0]))
            w, parent, banned = t[2], t[3], t[4]
            start = w + 1 if parent >= 0 else w
            s = seen[start:z]
            # no more than that many can be taken, or be the threshold
            top = np.argpartition(s, len(s) - (k + 1 - r))[len(s) - (k + 1 - r) :] if len(s) > k + 2 else np.arange(len(s))
            for i in top.tolist():
                if s[i] > -np.inf:
                    heapq.heappush(queue[d], (-float(s[i]), r, start + i, r - 1, None))
            if parent >= 0:  # the place that differed: what it leaves beyond all banned so far
                more = (*banned, path(r - 1, w))
                left = 1.0 - sum(float(np.exp(sum(float(words.lattice.log_weight[e]) for e in b) - words.total[w])) for b in more)
                if left > words.least[w]:
                    m = float(before[w]) + np.log(left)
                    u = uniform_one(int(words.seed[d]), r, 1 << 43)
                    heapq.heappush(queue[d], (float(np.log(np.exp(t[0]) - np.log(u) * np.exp(-m))), r, w, r - 1, more))
    out = []
    for d in range(n):
        kappa = -queue[d][0][0] if queue[d] else -np.inf
        own = []
        for r, total, value in drawn[d]:
            own.append((ids[r][d], total, value, float(-np.expm1(-np.exp(min(700.0, total - kappa)))) if np.isfinite(kappa) else 1.0))
        out.append(own)
    return out


def encode_samples(docs: DataFrame, model: str, k: int = SAMPLES, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """key, draw (from 1), n_pieces, log_prob, inclusion, ids_crc32, round_trip and, with `ids`, piece ids, for each draw of each row."""
    common.tune(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, draw int, n_pieces long, log_prob double, inclusion double, ids_crc32 long, round_trip boolean" + ", ids array<int>" * ids
    names = [key, "draw", "n_pieces", "log_prob", "inclusion", "ids_crc32", "round_trip"] + ["ids"] * ids

    def scan(batches):
        import pyarrow as pa

        voc = vocabulary(model)
        for b in batches:
            for s, e in common.slices(b.column(2), 2 << 20):
                text = b.column(2).slice(s, e - s).to_pylist()
                rows: list[list] = [[] for _ in names]
                for i, draws in enumerate(sample(voc, text, b.column(1).slice(s, e - s).to_numpy(), k)):
                    whole = normal(text[i])
                    for r, (own, log, _, score) in enumerate(draws):
                        values = [i, r + 1, len(own), log, score, zlib.crc32(own.astype("<u4").tobytes()), voc.decode(own) == whole]
                        for col, v in zip(rows, [*values, own] if ids else values, strict=True):
                            col.append(v)
                keys = b.column(0).slice(s, e - s).take(pa.array(rows[0], pa.int64()))
                types = [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, t in zip(rows[1:], types))], names)

    own = docs.select(key, F.xxhash64(F.col(key)).alias("_seed"), F.coalesce("text", F.lit("")).alias("_text"))
    return own.mapInArrow(scan, schema)


def decode_rows(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """All columns of rows but ids, and the text that they spell."""
    names = [c for c in rows.columns if c != ids]
    kinds = dict(rows.dtypes)

    def scan(batches):
        import pyarrow as pa

        voc = vocabulary(model)
        for b in batches:
            text = [voc.decode(np.asarray(x, np.int64))[1:].decode("utf-8", "replace") if x else "" for x in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names))), pa.array(text, pa.string())], [*names, "text"])

    return rows.select(*names, ids).mapInArrow(scan, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", text string")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.read_docs(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return encode_samples(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=False)
