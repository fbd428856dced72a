"""Packing token pieces into windows by Karmarkar-Karp multiway differencing.

A task streams its documents: texts become token ids, documents are cut into
pieces, and pieces are gathered until they nearly fill a group of windows. The group
is then divided into as many windows as its tokens need. Differencing starts
with every piece as a partition of its own and always merges the two partitions
with the largest imbalances, the fullest window of one with the emptiest of the
other, so imbalances cancel. If the fullest window of the result is beyond the
capacity, the group gets one more window and is divided again.

Nothing is shuffled; a group is bounded, so memory is as well.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

CAPACITY = 2048
END_ID = 1
MAX_PIECE = 256
WINDOWS_PER_GROUP = 128
SLACK = 0.005  # of a group's capacity, left free for what differencing cannot even out
CACHED_CHUNKS = 400_000
CACHED_BYTES = 32 << 20
JOINED = 256  # new chunks that are given to the tokenizer as one text


def difference_partition(sizes: list[int], n: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``n`` windows of near-equal sums; sizes are 1 or more.

    A partition lists its windows that hold something, fullest first, as
    (load, pieces), with pieces as nested pairs; the others are empty. What
    all windows have in common does not change an imbalance and is taken off.
    """
    if n == 1 or not sizes:
        return [list(range(len(sizes)))] + [[] for _ in range(n - 1)]
    # Entries: (-imbalance, tie, loads descending, pieces in the same order).
    heap = [(-size, i, [size], [i]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a_loads, a_parts = heapq.heappop(heap)
        _, _, b_loads, b_parts = heapq.heappop(heap)
        shared = len(a_loads) + len(b_loads) - n
        if shared > 0:
            # The last ``shared`` windows of a, least full first, meet the last of b, fullest first.
            cut_a, cut_b = len(a_loads) - shared, len(b_loads) - shared
            pairs = range(shared)
            loads = a_loads[:cut_a] + b_loads[:cut_b] + [a_loads[cut_a + i] + b_loads[-1 - i] for i in pairs]
            parts = a_parts[:cut_a] + b_parts[:cut_b] + [(a_parts[cut_a + i], b_parts[-1 - i]) for i in pairs]
        else:
            loads, parts = a_loads + b_loads, a_parts + b_parts
        order = sorted(range(len(loads)), key=loads.__getitem__, reverse=True)
        least = loads[order[-1]] if len(loads) == n else 0
        heapq.heappush(heap, (least - loads[order[0]], tie, [loads[i] - least for i in order], [parts[i] for i in order]))
        tie += 1
    windows = [_flat(part) for part in heap[0][3]]
    return windows + [[] for _ in range(n - len(windows))]


def _flat(part) -> list[int]:
    out, todo = [], [part]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            todo += x
        else:
            out.append(x)
    return sorted(out)


def pack_group(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most ``capacity``, as few as differencing can do with; sizes are 1 to ``capacity``."""
    n = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = difference_partition(sizes, n)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return [w for w in windows if w]
        n += 1


# What the splitter of a public tokenizer does, and the same for texts of printable ASCII and small Latin letters.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = "\u00df-\u00f6\u00f8-\u00ff"
_PLAIN = re.compile(f"[ -@\\[-~{_LATIN}]+")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^ a-z0-9{_LATIN}]+")

# The lead bytes of U+0300 to U+036F in UTF-8: all marks that compose with an ASCII letter are among those.
_MARKS = (b"\xcc", b"\xcd")


def _folded(data: bytes) -> list[bytes]:
    """Chunks between white space, A-Z in lower case where that changes no id."""
    if b"<|" in data:
        return data.split()
    if data.isascii() or not any(m in data for m in _MARKS):
        return data.lower().split()
    return [c.lower() if c.isascii() else c for c in data.split()]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _spellings(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes that each id stands for; a word's end is none."""
    letters = {c: b for b, c in enumerate(_byte_letters())}
    spelt = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        spelt[i] = bytes(letters.get(c, 0) for c in token.removesuffix("</w>"))
    return spelt


class _Numbered(dict):
    """Numbers of chunks; what is asked for and not there gets the next one and is listed."""

    def __init__(self, *given):
        super().__init__(*given)
        self.fresh: list[bytes] = []

    def __missing__(self, chunk: bytes) -> int:
        self[chunk] = n = len(self)
        self.fresh.append(chunk)
        return n


class ChunkTokens:
    """Token ids of texts by a public tokenizer, with the ids of frequent chunks kept.

    The tokenizer's normaliser and splitter never look across ASCII white
    space, so a text's ids are those of its chunks one after the other. It
    composes characters, then lower-cases, so A-Z may be folded before a chunk
    is looked up, unless a text may hold the name of a special token. Beside
    combining marks only chunks that are ASCII throughout are folded: of J and
    a caron only the small letter has a composed form.

    Most of the tokenizer's time on a short chunk is its normaliser's and its
    splitter's. Chunks whose normal form is printable ASCII and small Latin
    letters are split here, and a tokenizer with the same merges and neither of
    the two gets their pieces.
    """

    def __init__(self, path: str, most: int = CACHED_CHUNKS, most_bytes: int = CACHED_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.most_bytes = Tokenizer.from_file(path), most, most_bytes
        self.spelt = _spellings(self.tokenizer.get_vocab(with_added_tokens=True))
        self.lengths = np.fromiter(map(len, self.spelt), np.int64, len(self.spelt))
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        splits = [x.get("pattern", {}).get("Regex") for x in (settings["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.merges = None
        if splits == [_SPLIT, None]:
            bare = settings | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
            self.merges = Tokenizer.from_str(json.dumps(bare))
        letters = _byte_letters()
        self.latin = [(c, "".join(letters[b] for b in c.encode())) for c in map(chr, range(0xDF, 0x100)) if _PLAIN.match(c)]
        self._clear()

    def _clear(self) -> None:
        self.known = _Numbered()
        self.held = 0  # bytes of the known chunks
        self.ids = np.empty(0, np.uint32)
        self.starts = np.empty(0, np.int64)
        self.sizes = np.empty(0, np.int64)
        self.uses = np.empty(0, np.int64)  # texts that used a chunk

    def _shrink(self) -> None:
        """Keep the chunks that came up again; most are seen once."""
        keep = self.uses > 1
        held = sum(len(c) for c, i in self.known.items() if keep[i])
        if keep.sum() > self.most // 2 or held > self.most_bytes // 2:
            return self._clear()
        self.ids = self._gather(np.flatnonzero(keep))
        self.sizes = self.sizes[keep]
        self.starts = np.cumsum(self.sizes) - self.sizes
        place = np.cumsum(keep) - 1
        self.known = _Numbered({c: int(place[i]) for c, i in self.known.items() if keep[i]})
        self.held = held
        self.uses = np.zeros(len(self.known), np.int64)

    def _alone(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fresh(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the chunks in some order, their ids one after the other, and how many each has."""
        named = np.fromiter((b"<|" in c for c in chunks), bool, len(chunks))
        folded = np.fromiter(map(bytes.isascii, chunks), bool, len(chunks))
        simple: list[int] = []
        normal: list[str] = []
        other: list[int] = []
        # ASCII chunks are normal once they are folded.
        for kind in (True, False):
            places = np.flatnonzero((folded == kind) & ~named).tolist()
            for i in range(0, len(places), JOINED):
                own = places[i : i + JOINED]
                text = b" ".join([chunks[p] for p in own]).decode()
                text = text.lower() if kind else self.tokenizer.normalizer.normalize_str(text)
                forms = text.split(" ")
                if self.merges is None or len(forms) != len(own):
                    other += own
                elif _PLAIN.fullmatch(text):
                    simple += own
                    normal += forms
                else:
                    for place, form in zip(own, forms):
                        if _PLAIN.fullmatch(form):
                            simple.append(place)
                            normal.append(form)
                        else:
                            other.append(place)
        merged = self._merged(normal)
        if merged is None:
            other, simple, merged = simple + other, [], self._merged([])
        order, ids, sizes = self._joined(chunks, other, np.flatnonzero(named).tolist())
        return np.array(simple + order, np.int64), np.concatenate([merged[0], ids]), np.concatenate([merged[1], sizes])

    def _merged(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of plain chunks one after the other, and how many each has; none if ids do not cover the chunks' bytes."""
        texts = []
        for i in range(0, len(chunks), JOINED):
            text = " ".join(_PIECE.findall(" ".join(chunks[i : i + JOINED])))
            if not text.isascii():
                for letter, spelt in self.latin:
                    text = text.replace(letter, spelt)
            texts.append(text)
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        found = self.merges.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        ends = np.cumsum(self.lengths[ids])
        bounds = np.cumsum(np.fromiter(map(len, map(str.encode, chunks)), np.int64, len(chunks)))
        if not len(ends) or ends[-1] != bounds[-1]:
            return None
        return ids, np.diff(np.searchsorted(ends, bounds, "right"), prepend=0)

    def _joined(self, chunks: list[bytes], places: list[int], single: list[int]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The same for the chunks at any places, by the whole tokenizer.

        Chunks go to the tokenizer many at a time, with spaces between them.
        Its ids spell what its normaliser makes of a text byte for byte, so
        the bytes tell where each chunk begins. Where they do not, or where a
        chunk has become several, it is asked chunk by chunk, like ``single``.
        """
        # ASCII chunks are folded already, and stay as they are.
        groups = []
        for kind in (True, False):
            some = [p for p in places if chunks[p].isascii() == kind]
            groups += [some[i : i + JOINED] for i in range(0, len(some), JOINED)]
        texts = [b" ".join([chunks[p] for p in g]).decode() for g in groups]
        order: list[int] = []
        ids, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for group, text, found in zip(groups, texts, self._alone(texts)):
            normal = (text if text.isascii() else self.tokenizer.normalizer.normalize_str(text)).encode().split(b" ")
            if len(normal) != len(group) or b"".join(map(self.spelt.__getitem__, found)) != b"".join(normal):
                single = single + group
                continue
            own = np.array(found, np.uint32)
            ends = np.cumsum(self.lengths[own])
            bounds = np.cumsum(np.fromiter(map(len, normal), np.int64, len(normal)))
            order += group
            ids.append(own)
            sizes.append(np.diff(np.searchsorted(ends, bounds, "right"), prepend=0))
        if single:
            found = self._alone([chunks[p].decode() for p in single])
            order += single
            ids.append(np.fromiter((i for x in found for i in x), np.uint32))
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        return order, np.concatenate(ids), np.concatenate(sizes)

    def _append(self, chunks: list[bytes]) -> None:
        """Ids of the chunks that were numbered since the last time."""
        place, flat, sizes = self._fresh(chunks)
        own, starts = np.empty(len(chunks), np.int64), np.empty(len(chunks), np.int64)
        own[place], starts[place] = sizes, len(self.ids) + np.cumsum(sizes) - sizes
        self.held += sum(map(len, chunks))
        self.ids = np.concatenate([self.ids, flat])
        self.starts = np.concatenate([self.starts, starts])
        self.sizes = np.concatenate([self.sizes, own])
        self.uses = np.concatenate([self.uses, np.zeros(len(chunks), np.int64)])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text. Beyond its bounds the memory holds the chunks of one call at most."""
        if len(self.known) > self.most or self.held > self.most_bytes:
            self._shrink()
        number = self.known.__getitem__
        which = []
        for text in texts:
            chunks = _folded((text or "").encode("utf-8", "replace"))
            which.append(np.fromiter(map(number, chunks), np.int64, len(chunks)))
        if self.known.fresh:
            fresh, self.known.fresh = self.known.fresh, []
            self._append(fresh)
        for own in which:
            self.uses[own] += 1
        return [self._gather(own) for own in which]

    def _gather(self, which: np.ndarray) -> np.ndarray:
        """The ids of numbered chunks, one after the other."""
        size = self.sizes[which]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.starts[which] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def _tokens(path: str) -> ChunkTokens:
    """One per worker process, so that tasks of a worker share what it has seen.

    Functions travel to tasks by value and bring fresh globals along; what is to stay lives in a module of its own.
    """
    state = sys.modules.setdefault("_ledgerlens_worker", types.ModuleType("_ledgerlens_worker")).__dict__
    if path not in state:
        state[path] = ChunkTokens(path)
    return state[path]


def _slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts of a bounded number of bytes; a longer text comes alone."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        start = held = 0
        lengths = pc.binary_length(texts).fill_null(0).to_pylist()
        for i, size in enumerate(lengths):
            if held and held + size > most:
                yield ids.slice(start, i - start), texts.slice(start, i - start).to_pylist()
                start, held = i, 0
            held += size
        if batch.num_rows:
            yield ids.slice(start), texts.slice(start).to_pylist()


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    max_piece: int = MAX_PIECE,
    windows_per_group: int = WINDOWS_PER_GROUP,
    slack: float = SLACK,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): every piece with its place.

    A document's tokens are its text's ids without special ones, then id 1; a
    missing or empty text is that one id. ``ids`` are unsigned 32-bit
    little-endian numbers. Pieces of a sequence follow each other from offset
    0 and hold at most ``capacity`` tokens together; what is missing is
    padding. A sequence's id names its task and its place there.

    Repeated rows are packed each. Documents without an id are packed too. A
    document longer than a group goes on in the next one. An empty table
    gives an empty table. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, task, done = _tokens(tokenizer_path), TaskContext.get().partitionId(), 0
        most = max(1, int(capacity * windows_per_group * (1 - slack)))
        group: list[tuple] = []
        held = 0

        def settle() -> pa.RecordBatch:
            nonlocal done
            windows = pack_group([len(p[2]) for p in group], capacity)
            rows = []
            for w in windows:
                offset = 0
                for i in w:
                    doc, start, ids, total = group[i]
                    rows.append((doc, start, len(ids), ids.tobytes(), total, (task << 32) + done, offset))
                    offset += len(ids)
                done += 1
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        types, names = None, [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        for ids, texts in _slices(batches):
            types = [ids.type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for doc, own in zip(ids.to_pylist(), tokens.encode(texts)):
                own = np.append(own, np.uint32(END_ID)).astype("<u4")
                start = 0
                while start < len(own):
                    # Documents are cut where a group is full, so groups are as full as each other.
                    end = min(start + min(max_piece, capacity), start + most - held, len(own))
                    group.append((doc, start, own[start:end], len(own)))
                    held += end - start
                    start = end
                    if held == most:
                        yield settle()
                        group, held = [], 0
        if group:
            yield settle()

    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"`{id_col}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return docs.select(id_col, text_col).mapInArrow(run, fields)
