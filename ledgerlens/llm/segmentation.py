"""N-best segmentation into SentencePiece pieces, and decoding.

Every text is a lattice: its characters are the nodes, the vocabulary's pieces
are the arcs, and a segmentation's score is the sum of its pieces' scores.
Forward Viterbi scores are the exact best cost of what lies before a node, so
an A* search from the end backwards with them as heuristic meets complete
segmentations best first and opens no node that the n best do not need.

The best segmentation, and what the second best loses, need no search: the
second best uses an arc that the best does not, and the best one through an arc
is what lies before it, the arc, and what lies behind it. Only chunks whose
second choice may count for a text are searched for all n.

No piece goes on after the last letter of a word or from a word into white
space, so the lattice hangs together by single nodes there. It is searched
chunk by chunk, each distinct chunk once per worker while it is remembered;
the n best of a text are then searched in the same way over its chunks.
"""

from __future__ import annotations

import heapq
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CACHED_CHUNKS = 1_000_000
LONG_CHUNK = 256
_SPACE = "\N{LOWER ONE EIGHTH BLOCK}"  # what stands for a space in pieces
_LETTER = r"\p{L}"
_OTHER = r"[^\p{L} \n]"
_CHUNK = regex.compile(rf" *{_OTHER}*{_LETTER}+| *{_OTHER}+| +|\n")

Path = tuple[float, tuple[int, ...]]  # score, ids


class PieceTable:
    """Pieces, scores and ids of a SentencePiece model file; bytes stand in for characters that no piece covers."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.arcs: dict[str, tuple[int, float]] = {}
        self.bytes = [b""] * model.get_piece_size()
        self.byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.arcs[piece.replace(_SPACE, " ")] = i, model.get_score(i)
                self.bytes[i] = piece.replace(_SPACE, " ").encode()
        self.longest = max(map(len, self.arcs))
        # Beginnings of pieces, too, so that a scan stops where no piece goes on.
        self.trie: dict[str, tuple[int, float] | None] = {p[:i]: None for p in self.arcs for i in range(1, len(p))} | self.arcs
        # As the library does for unigram models: an unknown character scores ten below the worst piece.
        self.unknown = min(s for _, s in self.arcs.values()) - 10
        letter = regex.compile(_LETTER)
        for piece in self.arcs:
            for a, b in zip(piece, piece[1:]):
                if (a != " " and b == " ") or "\n" in (a, b) or (letter.match(a) and not letter.match(b)):
                    raise ValueError(f"the piece {piece!r} goes on where chunks are cut")

    def spell(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids: pieces joined, bytes put together, the leading space gone."""
        return self.spell(ids).decode("utf-8", "replace").removeprefix(" ")


Arc = tuple[int, tuple[int, ...], float]  # from, ids, score


def _lattice(chunk: str, table: PieceTable) -> tuple[list[float], list[list[Arc]]]:
    """Forward Viterbi scores, and the arcs that end at each node."""
    size, trie = len(chunk), table.trie
    forward = [float("-inf")] * (size + 1)
    forward[0] = 0.0
    into: list[list[Arc]] = [[] for _ in range(size + 1)]
    for i in range(size):
        here, j, single = forward[i], i + 1, False
        while j <= size and (key := chunk[i:j]) in trie:
            arc = trie[key]
            if arc:
                single = single or j == i + 1
                score = arc[1]
                into[j].append((i, (arc[0],), score))
                if here + score > forward[j]:
                    forward[j] = here + score
            j += 1
        if not single:
            spelt = tuple(table.byte_ids[b] for b in chunk[i].encode("utf-8", "replace"))
            into[i + 1].append((i, spelt, table.unknown))
            if here + table.unknown > forward[i + 1]:
                forward[i + 1] = here + table.unknown
    return forward, into


def _from_end(ids: int | tuple[int, ...]) -> tuple[int, ...]:
    return (ids,) if isinstance(ids, int) else ids[::-1]


def best_and_loss(chunk: str, table: PieceTable) -> tuple[Path, float]:
    """The first of :func:`n_best`, and what the second loses; infinite if there is none.

    The pass that most time goes into: it keeps no more than it needs.
    """
    size, trie, none = len(chunk), table.trie, float("-inf")
    forward, came = [none] * (size + 1), [0] * (size + 1)
    spelt: list = [None] * (size + 1)
    forward[0] = 0.0
    arcs: list[tuple[int, int, float]] = []
    for i in range(size):
        here, j, single = forward[i], i + 1, False
        while j <= size and (key := chunk[i:j]) in trie:
            arc = trie[key]
            if arc is not None:
                ids, score = arc
                arcs.append((i, j, score))
                score += here
                # Of arcs that are as good, the one whose ids, read from the end, come first.
                if score > forward[j] or (score == forward[j] and (ids,) < _from_end(spelt[j])):
                    forward[j], came[j], spelt[j] = score, i, ids
                single = single or j == i + 1
            j += 1
        if not single:
            arcs.append((i, i + 1, table.unknown))
            ids, score, j = tuple(table.byte_ids[b] for b in chunk[i].encode("utf-8", "replace")), here + table.unknown, i + 1
            if score > forward[j] or (score == forward[j] and ids[::-1] < _from_end(spelt[j])):
                forward[j], came[j], spelt[j] = score, i, ids
    node, parts, step = size, [], [-1] * (size + 1)
    while node:
        parts.append(spelt[node])
        step[node] = came[node]
        node = came[node]
    # Backwards over the arcs, which are in order of where they begin.
    backward = [none] * (size + 1)
    backward[size] = 0.0
    second = none
    for i, j, score in reversed(arcs):
        score += backward[j]
        if score > backward[i]:
            backward[i] = score
        if step[j] != i and forward[i] + score > second:
            second = forward[i] + score
    ids = tuple(x for p in reversed(parts) for x in ((p,) if isinstance(p, int) else p))
    return (forward[size], ids), forward[size] - second


def n_best(chunk: str, table: PieceTable, n: int) -> list[Path]:
    """Up to ``n`` best segmentations of a chunk, best first.

    Equal scores are in the order of their ids read from the end. Keys of the
    search grow with the chunk, so long chunks go another way to the same.
    """
    if len(chunk) > LONG_CHUNK:
        return _n_best_by_node(chunk, table, n)
    forward, into = _lattice(chunk, table)
    size = len(chunk)
    # Backward A*: (minus the best whole score, ids from the end, node, minus the score behind it, chain).
    found: list[Path] = []
    heap: list[tuple] = [(-forward[size], (), size, 0.0, None)]
    while heap and len(found) < n:
        worst, key, node, behind, chain = heapq.heappop(heap)
        if not node:
            ids: list[int] = []
            while chain:
                ids += chain[0]
                chain = chain[1]
            found.append((-worst, tuple(ids)))
            continue
        for i, ids, score in into[node]:
            heapq.heappush(heap, (-(forward[i] + score - behind), key + ids[::-1], i, behind - score, (ids, chain)))
    return found


def _n_best_by_node(chunk: str, table: PieceTable, n: int) -> list[Path]:
    """:func:`n_best` by the ``n`` best of every node, in order.

    Arcs into a node differ in their last id, and what comes before the same
    arc is in order already, so its place there stands for all its ids.
    """
    _, into = _lattice(chunk, table)
    best: list[list[tuple]] = [[(0.0, (), 0, 0, ())]]  # minus score, last ids from the end, place before, node before, ids
    for arcs in into[1:]:
        ways = [(w[0] - score, ids[::-1], place, i, ids) for i, ids, score in arcs for place, w in enumerate(best[i])]
        best.append(heapq.nsmallest(n, ways))
    found: list[Path] = []
    for end in best[-1]:
        way, parts = end, []
        while way[4]:
            parts.append(way[4])
            way = best[way[3]][way[2]]
        found.append((-end[0], tuple(x for ids in reversed(parts) for x in ids)))
    return found


class _Column:
    """An array that grows at its end; what is not used yet is room to grow."""

    def __init__(self, values: np.ndarray):
        self.room, self.size = values, len(values)

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.size]

    def extend(self, more: np.ndarray) -> None:
        size = self.size + len(more)
        if size > len(self.room):
            room = np.empty(max(2 * len(self.room), size), self.room.dtype)
            room[: self.size] = self.values
            self.room = room
        self.room[self.size : size] = more
        self.size = size


class ChunkSegments:
    """Segmentations of chunks, remembered for those that come up again."""

    def __init__(self, table: PieceTable, n: int, most: int = CACHED_CHUNKS):
        self.table, self.n, self.most = table, n, most
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.best = _Column(np.zeros(0))  # score of the best
        self.loss = _Column(np.zeros(0))  # what the second costs; infinite if there is none
        self.starts = _Column(np.zeros(1, np.int64))
        self.ids = _Column(np.zeros(0, np.uint32))
        self.uses = _Column(np.zeros(0, np.int64))
        self.others: dict[str, list[tuple[float, np.ndarray]]] = {}

    def _shrink(self) -> None:
        """Keep the chunks that came up again; most are seen once."""
        keep = self.uses.values > 1
        if keep.sum() > self.most // 2:
            return self._reset()
        size, place = np.diff(self.starts.values), np.cumsum(keep) - 1
        self.ids = _Column(self.ids.values[np.repeat(keep, size)])
        self.starts = _Column(np.r_[0, np.cumsum(size[keep])])
        self.best, self.loss = _Column(self.best.values[keep]), _Column(self.loss.values[keep])
        self.known = {c: int(place[i]) for c, i in self.known.items() if keep[i]}
        self.uses = _Column(np.zeros(len(self.known), np.int64))

    def learn(self, chunks: set[str]) -> None:
        """Search the chunks that are not known yet."""
        fresh = [c for c in chunks if c not in self.known]
        if fresh and len(self.known) + len(fresh) > self.most:
            self._shrink()
            fresh = [c for c in chunks if c not in self.known]
        if fresh:
            found = [best_and_loss(c, self.table) for c in fresh]
            self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
            self.best.extend(np.array([p[0] for p, _ in found]))
            self.loss.extend(np.array([loss for _, loss in found]))
            self.starts.extend(self.starts.values[-1] + np.cumsum([len(p[1]) for p, _ in found]))
            self.ids.extend(np.fromiter((i for p, _ in found for i in p[1]), np.uint32))
            self.uses.extend(np.zeros(len(fresh), np.int64))

    def alternatives(self, chunk: str) -> list[tuple[float, np.ndarray]]:
        """(loss, ids) of a chunk's further segmentations."""
        if chunk not in self.others:
            if len(self.others) >= 10_000:
                self.others.clear()
            (best, _), *more = n_best(chunk, self.table, self.n)
            self.others[chunk] = [(best - score, np.array(ids, np.uint32)) for score, ids in more]
        return self.others[chunk]

    def segment(self, texts: list[str]) -> Iterator[list[tuple[float, np.ndarray, str]]]:
        """Per text, (score, ids, what they decode to) of the n best; of an empty one, a single one without ids.

        Equal scores are in the order of the chunks' choices, each counted
        from its best, read from the last chunk to the first.
        """
        cut = [_CHUNK.findall(" " + t.replace(_SPACE, " ")) if t else [] for t in texts]
        self.learn(set().union(*cut))
        for chunks in cut:
            yield self._segment(chunks) if chunks else [(0.0, np.zeros(0, np.uint32), "")]

    def _segment(self, chunks: list[str]) -> list[tuple[float, np.ndarray, str]]:
        which = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        self.uses.values[which] += 1
        begin = self.starts.values[which]
        size = self.starts.values[which + 1] - begin
        ends = np.cumsum(size)
        ids = self.ids.values[np.repeat(begin - ends + size, size) + np.arange(ends[-1])]
        score, text, out = float(self.best.values[which].sum()), self.table.decode(ids), []
        for lost, choices in self._choices(self.loss.values[which], chunks):
            parts, at, same = [], 0, True
            for place, choice in choices:
                other = self.alternatives(chunks[place])[choice - 1][1]
                old = ids[ends[place] - size[place] : ends[place]]
                same = same and self.table.spell(other) == self.table.spell(old)
                parts += [ids[at : ends[place] - size[place]], other]
                at = ends[place]
            own = np.concatenate([*parts, ids[at:]]) if choices else ids
            # Ids spell piece by piece, so where only chunks that spell alike were changed the text is the same.
            out.append((score - lost, own, text if same else self.table.decode(own)))
        return out

    def _choices(self, loss: np.ndarray, chunks: list[str]) -> list[tuple[float, list[tuple[int, int]]]]:
        """(loss, [(chunk, choice)]) of the n best, in order of chunks.

        One chunk's second choice is as good as it gets for a segmentation
        that departs from the best there, so only the n - 1 chunks whose
        second choices lose least, the first of equal ones, can depart from
        it. Over these, A* from the last to the first; what lies before may
        lose nothing, which is exact.
        """
        few = self.n - 1
        if not few:
            return [(0.0, [])]
        bound = np.partition(loss, few - 1)[few - 1] if len(loss) > few else np.inf
        some = np.flatnonzero((loss <= bound) & np.isfinite(loss))
        some = np.sort(some[np.argsort(loss[some], kind="stable")[:few]])[::-1].tolist()
        options = [[(0.0, 0), *((x[0], c + 1) for c, x in enumerate(self.alternatives(chunks[p])))] for p in some]
        out, heap = [], [(0.0, ())]
        while heap and len(out) < self.n:
            lost, taken = heapq.heappop(heap)
            if len(taken) == len(some):
                out.append((lost, [(p, c) for p, c in zip(some, taken) if c][::-1]))
                continue
            for more, choice in options[len(taken)]:
                heapq.heappush(heap, (lost + more, (*taken, choice)))
        return out


def _worker(path: str, n: int) -> ChunkSegments:
    """One per worker process: functions travel by value, so what is to stay lives in a module of its own."""
    state = sys.modules.setdefault("_ledgerlens_worker", types.ModuleType("_ledgerlens_worker")).__dict__
    if (path, n) not in state:
        state[path, n] = ChunkSegments(PieceTable(path), n)
    return state[path, n]


def n_best_pieces(
    docs: DataFrame, model_path: str, n: int = 4, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, rank, score, ids): the ``n`` best segmentations of every text, best first, rank from 1.

    ``ids`` are unsigned 32-bit little-endian numbers. A text is segmented as
    the library normalises it for this model: spaces become a letter of their
    own, one is put in front, nothing else changes; characters without a
    piece are spelt in bytes. Texts with fewer segmentations have fewer rows;
    a missing or empty text has one, without ids. ``decoded`` adds ``text``,
    what the ids spell, as :func:`decode_pieces` does, without a second trip
    to Python. Repeated rows are each segmented, rows without an id too. An
    empty table gives an empty table. Other columns are ignored. Nothing is
    shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = _worker(model_path, n)
        names = [id_col, "rank", "score", "ids", *(["text"] if decoded else [])]
        types = (pa.int32(), pa.float64(), pa.binary(), pa.string())

        def settle() -> pa.RecordBatch:
            columns = list(zip(*rows))
            own = batch.column(0).take(pa.array(columns[0]))
            return pa.record_batch([own, *(pa.array(c, t) for c, t in zip(columns[1:], types))], names)

        for batch in batches:
            rows, held = [], 0
            for start in range(0, batch.num_rows, 64):
                texts = [t or "" for t in batch.column(1).slice(start, 64).to_pylist()]
                for i, found in enumerate(segments.segment(texts), start):
                    for rank, (score, ids, text) in enumerate(found, 1):
                        rows.append((i, rank, score, ids.astype("<u4").tobytes(), *([text] if decoded else [])))
                        held += 8 * len(ids)
                    if held > 1 << 22:
                        yield settle()
                        rows, held = [], 0
            if rows:
                yield settle()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, rank int, score double, ids binary" + (", text string" if decoded else "")
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode_pieces(segments: DataFrame, model_path: str) -> DataFrame:
    """All columns and ``text``: what the column ``ids`` spells; missing ids give a missing text.

    Decoding what was encoded gives the text back, but for the letter that
    stands for spaces, which becomes one.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in segments.schema if f.name != 'text')}, text string"
    given = segments.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _worker(model_path, 1).table
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            texts = [None if x is None else table.decode(np.frombuffer(x, "<u4")) for x in ids.to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return given.mapInArrow(run, schema)
