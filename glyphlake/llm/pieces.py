"""Exact encoding with a merge-type piece model, by backtracking, and decoding.

A text is cut where no piece can reach across (before a run of word marks, and at characters that no piece has).  For each stretch an
Aho-Corasick automaton finds the pieces that begin at each position; the encoder tries the longest first.  A piece is accepted after its
predecessor only if re-merging the two together gives these two again; a position from which nothing fits is noted in a bitfield and not
tried again.  An encoding whose neighbours are all compatible is the one that merging the whole stretch gives.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, prepare

MARK = "▁"
#: Stretches and pairs that a worker remembers; beyond that it starts afresh, so memory stays bounded.
REMEMBERED = 1_000_000


class PieceModel:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.unknown = sp.unk_id()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece], self.score[piece] = i, sp.get_score(i)
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, (piece, len(piece) - 1))
        self.letters = {p for p in self.ids if len(p) == 1}
        self.automaton.make_automaton()
        #: Whether no piece has a word mark after another character; else texts are one stretch.
        self.cut = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.newline = not any("\n" in p for p in self.ids)
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, s: str) -> list[str]:
        """The definition: join the adjacent pair of the highest score, the leftmost of equals, until none is a piece."""
        left = list(range(-1, len(s) - 1))
        right = [*range(1, len(s)), -1]
        part = list(s)
        score = self.score
        heap = [(-score[p], i, p) for i in range(len(s) - 1) if (p := s[i : i + 2]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = right[i]
            if not part[i] or j < 0 or part[i] + part[j] != p:
                continue
            part[i], part[j] = p, ""
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (q := p + part[k]) in score:
                    heapq.heappush(heap, (-score[q], i, q))
            if (k := left[i]) >= 0 and (q := part[k] + p) in score:
                heapq.heappush(heap, (-score[q], k, q))
        return [p for p in part if p]

    def fits(self, a: str, b: str) -> bool:
        """Whether a and b stay apart, and whole, when they are merged together; a is '' at the start of a stretch."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= REMEMBERED // 2:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def stretch(self, s: str) -> list[str]:
        """Pieces of a stretch by backtracking."""
        n = len(s)
        starts: list[list[str]] = [[] for _ in range(n)]
        for end, (piece, before) in self.automaton.iter(s):
            starts[end - before].append(piece)  # matches come by their ends, so the shortest is first
        letters, pairs = self.letters, self.pairs
        for i, c in enumerate(s):
            if c not in letters:
                starts[i].insert(0, c)
        failed = bytearray((n >> 3) + 1)
        out: list[str] = []
        tries = [len(starts[0])]
        at = 0
        while at < n:
            last = out[-1] if out else ""
            k = tries[-1] - 1
            while k >= 0:
                piece = starts[at][k]
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    fits = pairs.get((last, piece))
                    if fits or (fits is None and self.fits(last, piece)):
                        break
                k -= 1
            if k >= 0:
                tries[-1] = k
                out.append(piece)
                at = end
                if at < n:
                    tries.append(len(starts[at]))
            else:
                if not out:
                    return self.merged(s)  # a model whose pieces don't merge to themselves
                failed[at >> 3] |= 1 << (at & 7)
                tries.pop()
                at -= len(out.pop())
        return out

    def ids_of(self, pieces: list[str]) -> tuple[int, ...]:
        try:
            return tuple(map(self.ids.__getitem__, pieces))
        except KeyError:  # a character without a piece
            out: list[int] = []
        for p in pieces:
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in p.encode())
            else:
                out.append(self.unknown)
        return tuple(out)

    def looked_up(self, s: str) -> tuple[int, ...]:
        found = self.known.get(s)
        if found is None:
            # pieces of word marks alone all have one score: runs of them are merged outright
            found = self.ids_of(self.merged(s) if MARK * 2 in s else self.stretch(s))
            if len(s) <= 64:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[s] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, as the library gives them without begin or end ids; '' has none."""
        if not text:
            return []
        s = MARK + text.replace(" ", MARK)
        if not self.cut:
            return list(self.ids_of(self.merged(s)))
        out: list[int] = []
        add, known, looked_up = out.extend, self.known, self.looked_up
        for k, line in enumerate(s.split("\n") if self.newline else [s]):
            if k:
                add(looked_up("\n"))
            first, *words = line.split(MARK)
            if first:
                add(looked_up(first))
            marks = MARK
            for w in words:
                if w:
                    w = marks + w
                    add(known.get(w) or looked_up(w))
                    marks = MARK
                else:
                    marks += MARK
            if len(marks) > 1:
                add(looked_up(marks[1:]))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids)


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """The model in the file, loaded once in each worker process."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(df: DataFrame, path: str, row_id: str = "doc_id", text: str = "text",
           derive: Callable[[list[int], str], tuple] | None = None, derived: str = "") -> DataFrame:
    """Encode and decode whole texts: doc_id, ids, decoded; with `derive` the columns in `derived` in place of ids and decoded.

    Null and empty texts have no ids and decode to ''.  Ids of rows may repeat or be null; an empty table gives an empty result.
    """
    prepare(df.sparkSession)
    names = [c.split()[0] for c in derived.split(",")] if derive else ["ids", "decoded"]

    def run(batches):
        m = model(path)
        for batch in batches:
            made = []
            for t in batch.column(1).to_pylist():
                ids = m.encode(t)
                decoded = m.decode(ids) if ids else ""
                made.append(derive(ids, decoded) if derive else (ids, decoded))
            columns = list(zip(*made)) if made else [()] * len(names)
            arrays = [pa.array(c, pa.list_(pa.int32())) if n == "ids" else pa.array(c) for n, c in zip(names, columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *names])

    return df.select(F.col(row_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(
        lean(run), "doc_id long, " + (derived if derive else "ids array<int>, decoded string"))
