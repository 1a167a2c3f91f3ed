"""SentencePiece encoding and decoding with N-best segmentation.

A text becomes a lattice of pieces with the scores of the model file. Forward Viterbi gives the best score of every
prefix; a backward A* search takes these as its exact heuristic, so it walks complete segmentations in order of score.
Where no piece of the model holds two neighbouring characters, no segmentation crosses between them, and the lattice falls
apart into units. Each distinct unit of a batch is searched by A* for its best and second-best segmentation; the N best
of a text differ from its best in the N - 1 units with the cheapest second choices alone, and of these A* gives N each.

The model's merge ranks, where it was built by merging, serve as additive scores: results are the N best of that lattice,
not the merges. Characters without a piece become their bytes, so decoding returns each text exactly.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swarf.shipping import ship

#: How the model files write a space.
MARK = "▁"
#: Units a worker remembers, in two generations, and the longest one it does.
REMEMBERED, LONGEST = 200_000, 48
#: The longest unit whose pieces are kept by place.
WIDE = 1 << 14
#: Code points of the texts taken together; a longer text is taken alone.
TOGETHER = 1 << 21
#: Below the worst piece, as the public library has it for unigram models.
UNKNOWN_PENALTY = 10.0


class Lattice:
    """The pieces of a model file, the units that they make, and what has been solved."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        usual = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i).replace(MARK, " "): (i, sp.get_score(i)) for i in usual}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(sp.is_byte(i) for i in self.bytes):
            raise ValueError("the model has no byte pieces, so it can't return every text")
        raw = [b""] * n
        for p, (i, _) in self.pieces.items():
            raw[i] = p.encode()
        for b, i in enumerate(self.bytes):
            raw[i] = bytes([b])
        self.raw, self.raw_bytes = pa.array(raw, pa.binary()), raw
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        self.walk = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}  # beginnings of pieces, to stop early
        chars = sorted({c for p in self.pieces if len(p) > 1 for c in p})
        self.place = np.zeros(0x110000, np.uint16)  # of a character that longer pieces hold, else 0
        self.place[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in self.pieces:
            at = self.place[[ord(c) for c in p]]
            self.joined[at[:-1], at[1:]] = True
        self.joined[0], self.joined[:, 0] = False, False
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.several = lru_cache(20_000)(lambda unit, n: list(islice(self.ranked(unit, n), n)))

    def forward(self, unit: str) -> tuple[list[float], list[list[tuple[int, int, float]]]]:
        """The best score of every prefix, by Viterbi, and the pieces (start, piece, score) that end at each place; piece -1: bytes.

        Of a unit over WIDE the pieces aren't kept, so that memory stays in proportion to its text.
        """
        n, find, walk, longest = len(unit), self.pieces.get, self.walk, self.longest
        best, into = [0.0] + [-np.inf] * n, [[] for _ in range(n + 1)] if n <= WIDE else None
        for start in range(n):
            base, end = best[start], start + 1
            hit = find(unit[start])
            if hit is None:
                hit = (-1, self.unknown)
            while True:
                if hit is not None:
                    piece, score = hit
                    if into is not None:
                        into[end].append((start, piece, score))
                    if base + score > best[end]:
                        best[end] = base + score
                end += 1
                if end > n or end > start + longest or (part := unit[start:end]) not in walk:
                    break
                hit = find(part)
        return best, into

    def ending(self, unit: str, at: int) -> list[tuple[int, int, float]]:
        """The same pieces that end at one place."""
        hits = [(start, self.pieces.get(unit[start:at])) for start in range(max(0, at - self.longest), at)]
        if hits[-1][1] is None:
            hits[-1] = (at - 1, (-1, self.unknown))
        return [(start, *hit) for start, hit in hits if hit]

    def ranked(self, unit: str, n: int = 1 << 30) -> Iterator[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a unit by falling score: backward A*, ordered by score so far plus best prefix.

        Of equal nodes the one nearest to the start comes first, so ties don't widen the search. Open nodes hold different
        segmentations and each has one of just its order, so a node that n others precede can't count any more.
        """
        best, into = self.forward(unit)
        queue, serial = [(-best[-1], len(unit), 0, 0.0, ())], 0
        while queue and n:
            top, at, _, tail, path = queue.pop(0)
            if not at:
                ids: list[int] = []
                while path:
                    piece, char, path = path
                    ids += [self.bytes[b] for b in char.encode()] if piece < 0 else [piece]
                yield -top, tuple(ids)
                n -= 1
                continue
            full = len(queue) >= n
            worst = queue[-1][0] if full else np.inf
            for start, piece, score in into[at] if into is not None else self.ending(unit, at):
                f = -(best[start] + score + tail)
                if f > worst or f == worst and start >= queue[-1][1]:
                    continue
                if full:
                    queue.pop()
                serial += 1
                insort(queue, (f, start, serial, score + tail, (piece, unit[start], path)))
                if full := len(queue) >= n:
                    worst = queue[-1][0]

    def solve(self, unit: str) -> tuple[tuple[int, ...], float, float]:
        """(ids, score, how much less the second choice scores; inf without one)"""
        if found := self.new.get(unit):
            return found
        if not (found := self.old.get(unit)):
            (score, ids), *second = self.ranked(unit, 2)
            found = (ids, score, score - second[0][0] if second else np.inf)
        if len(unit) <= LONGEST:
            if len(self.new) >= REMEMBERED:
                self.old, self.new = self.new, {}
            self.new[unit] = found
        return found

    def units(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        """The units of all texts, each with the leading space that the model adds, and where each text's units begin and end."""
        whole = " " + " ".join(texts)
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        last = np.cumsum([len(t) + 1 for t in texts])  # where a text ends, in code points
        place = self.place[code]
        apart = np.append(~self.joined[place[:-1], place[1:]], True)
        apart[last - 1] = True
        ends = np.flatnonzero(apart) + 1
        width = 1 + (code > 0x7F).astype(np.int32) + (code > 0x7FF) + (code > 0xFFFF)
        offsets = np.concatenate(([0], np.cumsum(width)[ends - 1])).astype(np.int32)
        cut = pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(whole.encode()))
        return cut, np.concatenate(([0], np.searchsorted(ends, last, "right")))

    def choices(self, units: list[str], less: np.ndarray, best: float, n: int) -> list[tuple[float, dict[int, int]]]:
        """The n best segmentations of a text as (score, {unit: rank}), from the units and how much their second choices lose."""
        near = np.argsort(less, kind="stable")[: n - 1] if len(less) <= 64 else (c := np.sort(np.argpartition(less, n)[:n]))[np.argsort(less[c], kind="stable")][: n - 1]
        out = [(best, {})]
        for u in (int(u) for u in near if less[u] < np.inf):
            scores = [s for s, _ in self.several(units[u], n)]
            out = heapq.nsmallest(n, ((t + s - scores[0], c | ({u: k} if k else {})) for t, c in out for k, s in enumerate(scores)), key=lambda x: -x[0])
        return out

    def encode(self, texts: list[str], n: int = 1) -> list[tuple[np.ndarray, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]]:
        """Of each text the ids of the best segmentation, and the n best ones as (score, changes), best first.

        A change (at, size, ids) puts other ids in place of `size` of them from `at` on.
        """
        if not texts:
            return []
        cut, begin = self.units(texts)
        coded = cut.dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        solved = [self.solve(u) for u in distinct]
        sizes = np.fromiter((len(s[0]) for s in solved), np.int32, len(solved))
        flat = np.fromiter(chain.from_iterable(s[0] for s in solved), np.int32, sizes.sum())
        score, less = (np.fromiter((s[k] for s in solved), float, len(solved)) for k in (1, 2))
        size, first = sizes[code], (np.cumsum(sizes, dtype=np.int32) - sizes)[code]
        end = np.cumsum(size, dtype=np.int32)
        ids = flat[np.repeat(first - (end - size), size) + np.arange(end[-1], dtype=np.int32)]
        at = np.concatenate(([0], end))  # where a unit's ids begin
        total = np.add.reduceat(score[code], begin[:-1]).tolist()
        out = []
        for k, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
            start, ways = int(at[a]), [(total[k], [])]
            if n > 1:
                mine = code[a:b]
                names = _Named(distinct, mine)
                for worth, changed in self.choices(names, less[mine], total[k], n)[1:]:
                    changes = [(int(at[a + u]) - start, int(size[a + u]), self.several(names[u], n)[rank][1]) for u, rank in sorted(changed.items())]
                    ways.append((worth, changes))
            out.append((ids[start : at[b]], ways))
        return out

    def same(self, ids: np.ndarray, ways: list[tuple[float, list]]) -> bool:
        """Whether each change decodes to the bytes that it takes the place of, so that all ways decode alike."""
        return all(b"".join(map(self.raw_bytes.__getitem__, new)) == b"".join(map(self.raw_bytes.__getitem__, ids[at : at + size].tolist())) for _, changes in ways for at, size, new in changes)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids: pieces with spaces put back, runs of byte pieces as UTF-8, less the leading space."""
        return self.joined_bytes([ids])[0].decode(errors="replace")[1:]

    def joined_bytes(self, lists: list) -> list[bytes]:
        """The bytes of each list of ids, with the leading space."""
        whole = self.raw.take(pa.array(np.concatenate([np.asarray(x, np.int32) for x in lists])))
        offsets = np.frombuffer(whole.buffers()[1], np.int32)[: len(whole) + 1]
        data, cut = memoryview(whole.buffers()[2] or b""), offsets[np.cumsum([0, *map(len, lists)])].tolist()
        return [bytes(data[a:b]) for a, b in zip(cut, cut[1:])]


class _Named:
    """The units of a text by place, without making a list of all of them."""

    def __init__(self, distinct: list[str], code: np.ndarray):
        self.distinct, self.code = distinct, code

    def __getitem__(self, k: int) -> str:
        return self.distinct[self.code[k]]


_LOADED: dict[str, Lattice] = {}


def lattice(model_file: str) -> Lattice:
    """One a worker process, so that it remembers units from task to task."""
    if model_file not in _LOADED:
        _LOADED[model_file] = Lattice(model_file)
    return _LOADED[model_file]


def together(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of up to TOGETHER code points."""
    part, n = [], 0
    for t in texts:
        if part and n + len(t) > TOGETHER:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t)
    if part:
        yield part


def changed(ids: np.ndarray, changes: list[tuple[int, int, tuple[int, ...]]]) -> np.ndarray:
    """The ids with changes applied."""
    parts, last = [], 0
    for at, size, new in changes:
        parts += [ids[last:at], np.array(new, np.int32)]
        last = at + size
    return np.concatenate([*parts, ids[last:]])


CHANGE = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def encode(docs: DataFrame, model_file: str, n: int = 4) -> DataFrame:
    """One row per input row: doc_id, ids and n_pieces (the best segmentation), scores (best first, up to n), others (the
    segmentations after the best, in the order of scores, each as its changes to ids: at, size, ids), round_trip (decoding each
    of them gives the text). segmentations() writes them out.

    A null text counts as empty, which is the one piece of the leading space; a text has fewer than n segmentations only if
    there are no more. Equal scores come in a fixed order, so repeated rows are encoded alike; very long texts take time in
    proportion. An empty table gives an empty result. The model file must lie at the same path on all machines.
    """
    ship(docs.sparkSession)
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("others", T.ArrayType(T.ArrayType(CHANGE))), T.StructField("round_trip", T.BooleanType())]
    names, others = [f.name for f in fields], pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("ids", pa.list_(pa.int32()))])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(model_file)
        for b in batches:
            done = 0
            for texts in together([t or "" for t in b.column("text").to_pylist()]):
                found = model.encode(texts, n)
                whole = [ids for ids, _ in found]
                back = model.joined_bytes(whole)
                same = [got == b" " + t.encode() and model.same(*f) for got, t, f in zip(back, texts, found, strict=True)]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in whole]))).astype(np.int32)
                changes = [[[{"at": at, "size": size, "ids": new} for at, size, new in c] for _, c in ways[1:]] for _, ways in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(done, len(texts)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(whole))), pa.array(np.diff(offsets).astype(np.int64)),
                        pa.array([[s for s, _ in ways] for _, ways in found], pa.list_(pa.float64())), pa.array(changes, others), pa.array(same),
                    ],
                    names,
                )
                done += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, T.StructType(fields))


def segmentations(encoded: DataFrame) -> DataFrame:
    """From rows of encode(): also segmentations, the ids of each of the N best, best first."""

    def put(ids: Column, c: Column) -> Column:
        return F.concat(F.slice(ids, F.lit(1), c["at"]), c["ids"], F.slice(ids, c["at"] + c["size"] + 1, F.size(ids)))

    applied = F.transform("others", lambda changes: F.aggregate(F.reverse(changes), F.col("ids"), put))  # the last first, so places hold
    return encoded.withColumn("segmentations", F.concat(F.array("ids"), applied))
