"""Piece encoding and decoding with N-best segmentations.

A text (with a space put before it) is a lattice: nodes are places between
characters, edges are pieces of the vocabulary.  Forward Viterbi scores give
the best segmentation, and they are the exact heuristic of a backward A-star
search that yields the next best ones in order.

No piece goes on after a space that follows something else or holds a line end,
so the lattice of a text is a chain of those of its space-led units and lines, and its N best segmentations
change at most the N - 1 units whose runner-up is closest.  Viterbi scores run
over all distinct units of a batch at once; the A-star search runs on those few.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tally.llm.common import _BASE, mix64, read, slices

#: Model file read by default; any model whose pieces have byte fallback will do.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: How much worse than the worst piece a character without a piece is.
UNKNOWN_PENALTY = 10.0
_UNIT = re.compile(" +[^ \n]*|\n|[^ \n]+")
_NONE = -1e18
_UNITY = 1 << 32
_LEAST = -(1 << 120)


class Pieces:
    """A vocabulary with scores.

    A unigram model's scores are log-probabilities and used as they are.  Those
    of a BPE model are merge ranks; they become log-probabilities by Zipf's law.
    """

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        self.id_of: dict[str, int] = {}
        raw = np.zeros(len(sp))
        for i in range(len(sp)):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                text = piece.replace(SPACE, " ")
                if " " in text.lstrip(" ") or "\n" in text:
                    raise ValueError("a piece goes on after a space or line end")
                self.id_of[text] = i
                self.bytes_of.append(text.encode())
                raw[i] = sp.get_score(i)
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        ids = np.array(list(self.id_of.values()))
        ranks = -raw[ids]
        if (ranks == np.floor(ranks)).all():  # whole numbers: ranks of a BPE model
            usual = ranks < len(sp)  # pieces that merges never make have a huge rank
            raw[ids] = -np.log(np.where(usual, ranks, len(sp)) + 1.0) - math.log(math.log(len(sp)))
        self.score = raw
        self.unknown = float(raw[ids].min()) - UNKNOWN_PENALTY
        # the last one, at -1: the bytes of a character without a piece
        self.exact = [round(x * _UNITY) for x in [*raw.tolist(), self.unknown]]
        self.piece_of = {i: p for p, i in self.id_of.items()}
        self.ascii = np.array([self.byte_id[b] for b in range(128)], dtype=np.int32)
        self.longest = max(map(len, self.id_of))
        # hashes of all pieces, and a bit map of their low bits
        hashes = np.array([self._hash(p) for p in self.id_of], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], ids[order]
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.heads = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)

    @staticmethod
    def _hash(piece: str) -> int:
        """Sum of scrambled characters times powers of the base, scrambled; as in ``lookup``."""
        c = mix64(np.frombuffer(piece.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1))
        up = np.full(len(c), _BASE, dtype=np.uint64)
        up[0] = 1
        up = np.cumprod(up, dtype=np.uint64)
        return int(mix64(np.array([(c * up).sum(dtype=np.uint64)]) + np.uint64(len(c)))[0])

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashed pieces, -1 where there is none."""
        out = np.full(h.shape, -1, dtype=np.int32)
        at = np.nonzero(self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        out[at] = np.where(self.hashes[place] == h[at], self.ids[place], -1)
        return out

    # -- one unit ---------------------------------------------------------------

    def lattice(self, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of a unit's lattice by end place: those ending at j are ``first[j]`` .. ``first[j + 1]`` of starts and ids.

        Id -1 stands for the bytes of a character without a piece.
        """
        n = len(unit)
        if n <= 256:  # the same, by the dictionary: arrays don't pay for so few pieces
            first, start, ids = [0, 0], [], []
            for j in range(1, n + 1):
                for i in range(max(0, j - self.longest), j):
                    k = self.id_of.get(unit[i:j], -1)
                    if k >= 0 or i == j - 1:
                        start.append(i)
                        ids.append(k)
                first.append(len(start))
            return np.array(first), np.array(start, dtype=np.int32), np.array(ids, dtype=np.int32)
        c = mix64(np.frombuffer(unit.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1))
        acc, up = np.zeros(n + 1, dtype=np.uint64), np.ones(1, dtype=np.uint64)
        starts, ends, ids = [], [], []
        for length in range(1, min(self.longest, n) + 1):
            acc = acc[:n - length + 1] + c[length - 1:] * up
            up = up * _BASE
            k = self.lookup(mix64(acc + np.uint64(length)))
            at = np.arange(n) if length == 1 else np.flatnonzero(k >= 0)
            starts.append(at.astype(np.int32))
            ends.append((at + length).astype(np.int32))
            ids.append(k[at])
        end = np.concatenate(ends)
        order = np.argsort(end, kind="stable")
        first = np.searchsorted(end[order], np.arange(n + 2))
        return first, np.concatenate(starts)[order], np.concatenate(ids)[order]

    def nbest(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations (score, ids), best first; ties in any order.

        Each of the n best that pass a place ends in one of its n best tails, so no
        place is expanded more than n times, and of equal entries the newest, which
        is furthest on, goes first: ties don't multiply and a very long unit takes
        time and memory in proportion to its length.
        """
        first, start, piece = map(memoryview, self.lattice(unit))
        worth = self.exact
        forward = [0] * (len(unit) + 1)
        to = first[1]
        for j in range(1, len(unit) + 1):
            at, to = to, first[j + 1]
            best = _LEAST
            for e in range(at, to):
                s = forward[start[e]] + worth[piece[e]]
                if s > best:
                    best = s
            forward[j] = best
        found: list[tuple[float, tuple[int, ...]]] = []
        heap: list = [(-forward[-1], 0, 0, len(unit), None)]  # best total first
        made, seen = 0, bytearray(len(unit) + 1) if n < 256 else [0] * (len(unit) + 1)
        while heap and len(found) < n:
            _, _, done, j, rest = heapq.heappop(heap)
            if j == 0:
                ids: list[int] = []
                at = 0
                while rest is not None:
                    k, rest = rest
                    if k >= 0:
                        ids.append(k)
                        at += len(self.piece_of[k])
                    else:
                        ids += [self.byte_id[b] for b in unit[at].encode()]
                        at += 1
                found.append((done / _UNITY, tuple(ids)))
                continue
            if seen[j] >= n:
                continue
            seen[j] += 1
            for e in range(first[j], first[j + 1]):
                i, s = start[e], worth[piece[e]]
                if seen[i] < n or i == 0:
                    made += 1
                    heapq.heappush(heap, (-(done + s + forward[i]), -made, done + s, i, (piece[e], rest)))
        return found

    # -- all distinct units of a batch --------------------------------------------

    def best_of(self, units: list[str], n: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict[int, list]]:
        """Best ids of all units one after another, how many each has, best scores, how far runners-up lie behind,
        and the n best of very long units."""
        count = np.zeros(len(units), dtype=np.int64)
        score, gap = np.zeros(len(units)), np.full(len(units), np.inf)
        size = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        lists: dict[int, list] = {}
        done: list[tuple[np.ndarray, np.ndarray]] = []  # units and the ids of each, one after another
        low = 0
        for width in (4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48):
            some = np.flatnonzero((size > low) & (size <= width))
            low = width
            for at in range(0, len(some), 20_000):
                done.append(self._viterbi(units, some[at:at + 20_000], size, width, count, score, gap))
        for u in np.flatnonzero(count == 0).tolist():  # very long, or with characters beyond ASCII that have no piece
            top = self.nbest(units[u], max(2, n) if len(units[u]) > 1000 else 2)
            if len(units[u]) > 1000:  # searched once, for all n
                lists[u] = top
            done.append((np.array([u]), np.array(top[0][1], dtype=np.int32)))
            count[u], score[u] = len(top[0][1]), top[0][0]
            gap[u] = top[0][0] - top[1][0] if len(top) > 1 else np.inf
        head = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), dtype=np.int32)
        for some, ids in done:
            n = count[some]
            flat[np.repeat(head[some] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, count, score, gap, lists

    def _viterbi(self, units, some, size, width, count, score, gap):
        n, size = len(some), size[some]
        packed = "".join(units[u].ljust(width, "\0") for u in some.tolist())
        c = np.frombuffer(packed.encode("utf-32-le"), dtype="<u4").reshape(n, width).T.astype(np.uint64)
        c = mix64(c + np.uint64(1))
        reach = min(width, self.longest)
        score_of, id_of = {}, {}
        acc = np.zeros((width + 1, n), dtype=np.uint64)
        up = np.ones(1, dtype=np.uint64)
        inside = np.arange(width)[:, None] < size[None, :]
        table = np.append(self.score, _NONE)
        char = np.frombuffer(packed.encode("utf-32-le"), dtype="<u4").reshape(n, width).T
        for length in range(1, reach + 1):  # hashes of all substrings of this length
            starts = width - length + 1
            acc = acc[:starts] + c[length - 1:] * up
            up = up * _BASE
            k = self.lookup(mix64(acc + np.uint64(length)))
            k[~inside[length - 1:]] = -1
            id_of[length], score_of[length] = k, table[k]
        odd = (id_of[1] < 0) & inside  # characters without a piece; ASCII ones are one byte piece
        score_of[1][odd] = self.unknown
        plain = ~(odd & (char >= 128)).any(axis=0)
        id_of[1][odd] = self.ascii[np.minimum(char[odd], 127)]
        forward, backward = np.full((width + 1, n), _NONE), np.full((width + 1, n), _NONE)
        forward[0] = 0
        last = np.zeros((width + 1, n), dtype=np.int8)
        for j in range(1, width + 1):
            for length in range(1, min(j, reach) + 1):
                s = forward[j - length] + score_of[length][j - length]
                better = s > forward[j]
                forward[j][better] = s[better]
                last[j][better] = length
        backward[size, np.arange(n)] = 0
        on = np.zeros((width + 1, n), dtype=bool)
        on[size, np.arange(n)] = True
        second = np.full(n, _NONE)
        for j in range(width, 0, -1):
            for length in range(1, min(j, reach) + 1):
                through = score_of[length][j - length] + backward[j]
                np.maximum(backward[j - length], through, out=backward[j - length])
                best = on[j] & (last[j] == length)
                on[j - length] |= best
                np.maximum(second, np.where(best, _NONE, through + forward[j - length]), out=second)
        on[:, ~plain] = False
        u, j = np.nonzero(on[1:].T)
        j = j + 1
        length = last[j, u]
        got = np.zeros(len(u), dtype=np.int32)
        for x in range(1, reach + 1):
            m = length == x
            got[m] = id_of[x][j[m] - x, u[m]]
        top = forward[size, np.arange(n)]
        count[some] = np.bincount(u, minlength=n)
        score[some] = top
        gap[some] = np.where(second > _NONE / 2, top - second, np.inf)
        return some[plain], got

    # -- decoding -----------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids, without the space put before it."""
        ids = np.asarray(ids, dtype=np.int64)
        size = self.lengths[ids]
        total = int(size.sum())
        place = np.repeat(self.heads[ids] - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(ids) else size, size) + np.arange(total)
        out = self.flat[place].tobytes().decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


class _Numbers(dict):
    """Numbers units in the order they are first asked for."""

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


class Encoder:
    """Encodes whole texts; remembers a bounded number of units."""

    def __init__(self, pieces: Pieces, n: int = 4, remember: int = 1_000_000):
        self.pieces, self.n, self.remember = pieces, n, remember
        self._forget()

    def _forget(self):
        self.number = _Numbers()
        self.names: list[str] = []
        self.flat = np.zeros(0, dtype=np.int32)  # best ids of all units, one after another
        self.head = np.zeros(1, dtype=np.int64)
        self.score, self.gap = np.zeros(0), np.zeros(0)
        self.lists: dict[int, list] = {}

    def encode(self, texts: list[str | None]) -> Iterator[list[tuple[float, np.ndarray]]]:
        """The n best (score, ids) of each text, best first; null and empty texts have one without ids."""
        if len(self.number) > self.remember:
            self._forget()
        known, find = len(self.number), self.number.__getitem__
        rows = [np.array(list(map(find, _UNIT.findall(" " + t))), dtype=np.int64) if t else np.zeros(0, dtype=np.int64) for t in texts]
        new = list(self.number)[known:]
        ids, count, score, gap, lists = self.pieces.best_of(new, self.n)
        self.lists |= {known + u: top[:self.n] for u, top in lists.items()}
        self.names += new
        self.flat = np.concatenate([self.flat, ids])
        self.head = np.concatenate([self.head, self.head[-1] + np.cumsum(count)])
        self.score, self.gap = np.concatenate([self.score, score]), np.concatenate([self.gap, gap])
        for row in rows:
            yield self._nbest(row)

    def _nbest(self, row: np.ndarray) -> list[tuple[float, np.ndarray]]:
        if not len(row):
            return [(0.0, np.zeros(0, dtype=np.int32))]
        size = self.head[row + 1] - self.head[row]
        end = np.cumsum(size)
        ids = self.flat[np.repeat(self.head[row] - (end - size), size) + np.arange(end[-1])]
        best = float(self.score[row].sum())
        if self.n == 1:
            return [(best, ids)]
        gap = self.gap[row]
        k = min(self.n - 1, len(row))
        near = np.argpartition(gap, k - 1)[:k] if k < len(row) else np.arange(len(row))
        # n best sums of one choice for each of these units
        front: list[tuple[float, tuple]] = [(0.0, ())]
        for place in sorted(near[np.isfinite(gap[near])].tolist()):
            u = int(row[place])
            if u not in self.lists:
                self.lists[u] = self.pieces.nbest(self.names[u], self.n)
            top = self.lists[u]
            front = heapq.nlargest(self.n, ((s + t - top[0][0], ch + (((place, x),) if r else ()))
                                            for s, ch in front for r, (t, x) in enumerate(top)), key=lambda x: x[0])
        out = []
        for s, changes in front:
            parts, at = [], 0
            for place, x in changes:
                parts += [ids[at:end[place] - size[place]], np.array(x, dtype=np.int32)]
                at = end[place]
            out.append((best + s, np.concatenate([*parts, ids[at:]])))
        return out


def _encode(model, n: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model.value)
        enc = Encoder(pieces, n)
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            count, scores, crcs, exact, ids = [], [], [], [], []
            for text, top in zip(texts, enc.encode(texts)):
                first = top[0][1]
                count.append(len(first))
                scores.append([s for s, _ in top])
                crcs.append([zlib.crc32(x.astype("<i4").tobytes()) for _, x in top])
                exact.append(pieces.decode(first) == (text or ""))
                ids.append(first)
            cols = [b.column("row"), pa.array(count, pa.int64()), pa.array(scores, pa.list_(pa.float64())),
                    pa.array(crcs, pa.list_(pa.int64())), pa.array(exact, pa.bool_())]
            names = ["row", "n_pieces", "nbest_scores", "nbest_crc32", "round_trip"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)
    return run


def _model(df: DataFrame, path: str):
    with open(path, "rb") as f:  # about half a MB, read by the driver and sent along
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model: str = MODEL, n: int = 4, with_ids: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Each row of ``docs`` (struct ``row``: all its columns, or ``columns``) with its n best segmentations.

    ``ids`` (best segmentation), ``n_pieces``, ``nbest_scores`` and
    ``nbest_crc32`` (of the ids as little-endian 32-bit integers), best first,
    and ``round_trip``: decoding the ids gives the text.  Null and empty texts
    have no pieces.  Characters without a piece become their bytes.  Ties go to
    any of the equal segmentations, the same one each time; an empty table
    gives an empty result; ids may be null or repeat.  A very long text, or one
    without a break, is encoded whole: time and memory grow with its length.
    """
    if n < 1:
        raise ValueError("n must be positive")
    row = F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("row")
    rows = docs.select(row, F.col("text").cast("string").alias("text"))
    s = T.StructType([rows.schema["row"], T.StructField("n_pieces", T.LongType()), T.StructField("nbest_scores", T.ArrayType(T.DoubleType())),
                      T.StructField("nbest_crc32", T.ArrayType(T.LongType())), T.StructField("round_trip", T.BooleanType())])
    if with_ids:
        s.add("ids", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(_encode(_model(docs, model), n, with_ids), s)


def _decode(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model.value)
        for b in batches:
            text = [None if x is None else pieces.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(text, pa.string())], ["row", "text"])
    return run


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``(row, text)`` of rows with piece ``ids`` (null: null text; none: empty text); an empty table gives an empty result.

    Ids of any number are decoded whole; other columns pass through in ``row``.
    """
    rows = encoded.select("row", "ids")
    return rows.mapInArrow(_decode(_model(encoded, model)), T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))


def query(spark, sf_dir: str) -> DataFrame:
    got = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False, columns=["doc_id"])
    return got.select("row.doc_id", "n_pieces", "nbest_scores", "nbest_crc32", "round_trip")
