"""Alignment of two tokenizers' vocabularies over a corpus, by inverted bitmaps of id pairs.

A byte-level vocabulary (A) and a SentencePiece vocabulary (B) cut the same bytes. Where a
token of each ends, the two are linked. For every pair of ids the documents that link it
are kept as compressed bitmaps over blocks of 65,536 documents, with one plane per binary
digit of how often a document links it. Partial bitmaps are ORed; population counts give
documents and links per pair, and the postings carry a pair's count back to its documents.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import Scratch, key_runs

BLOCK = 1 << 16  # documents whose places two bytes tell
DENSE = 4096  # documents of a block from which on a bitmap is shorter than a list of places
FLUSH = 4_000_000  # (document, pair) entries a task holds
CACHED_CHUNKS = 300_000
CACHED_BYTES = 64 << 20
JOINED = 256  # chunks that are given to the tokenizers as one text
PART = 1 << 16  # chunks of a text that are looked up at a time
# Unicode's white space, and what stands for a space in pieces.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
_SPACE = "▁"


def _byte_letters() -> dict[str, int]:
    """The letters byte-level vocabularies write bytes with: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabularies:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        with open(path_a, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)
        ]
        self.space = self.b.piece_to_id(_SPACE)
        # Texts are cut before white space that follows something else. Vocabulary A's splitter always cuts there;
        # white space inside a piece of B is left alone.
        inside = {y for p in pieces for x, y in zip(p, p[1:]) if x == _SPACE or x not in _WHITE}
        if _SPACE in inside and any(y == _SPACE and x != _SPACE for p in pieces for x, y in zip(p, p[1:])):
            raise ValueError("pieces go on over spaces")
        white, uncut = re.escape(_WHITE), re.escape("".join(c for c in _WHITE if c in inside))
        more = f"(?:[{uncut}][{white}]*[^{white}]*)*" if uncut else ""
        self.chunk = re.compile(f"[{white}]*[^{white}]+{more}|[{white}]+")

    def pieces(self, texts: list[str]) -> list[list[int]]:
        """B's ids of texts that begin with white space; the library puts a space in front, which is the
        text's own or taken away again."""
        bare = [c[1:] if c[0] == " " else c for c in texts]
        found = self.b.encode(bare, num_threads=1)
        for i, (text, rest) in enumerate(zip(texts, bare)):
            if not rest:
                found[i] = [self.space]
            elif text[0] != " ":
                if found[i][:1] != [self.space]:
                    raise ValueError(f"no space before {text!r}")
                del found[i][0]
        return found

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of both, and whether both give the text back byte for byte."""
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.pieces(texts)
        good = []
        for text, x, y in zip(texts, a, b):
            raw = text.encode()
            good.append(b"".join(map(self.bytes_a.__getitem__, x)) == raw == b"".join(map(self.bytes_b.__getitem__, y)))
        return a, b, good


def _texts(size: int, marks: bytes) -> np.ndarray:
    """Decimal ids, each followed by either of two marks, at twice the id and one further."""
    return np.array([b"%d%c" % (i, m) for i in range(size) for m in marks], object)


class Aligned:
    """Alignments of chunks, kept as long as their number and their bytes are bounded.

    Both tokenizers end a token where a chunk ends, so groups and links of a
    text are those of its chunks one after the other.
    """

    def __init__(self, path_a: str, path_b: str, most: int = CACHED_CHUNKS, most_bytes: int = CACHED_BYTES):
        self.words = Vocabularies(path_a, path_b)
        self.most, self.most_bytes = most, most_bytes
        a, b = self.words.bytes_a, self.words.bytes_b
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        self.text_a, self.text_b = _texts(len(a), b",|"), _texts(len(b), b",;")
        self.long_a, self.long_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.text_a, self.text_b))
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.spelt: list[bytes] = []
        self.sizes = np.empty((0, 3), np.int64)  # tokens of A and B, links
        self.good = np.empty(0, bool)
        self.uses = np.empty(0, np.int64)  # parts of texts that used a chunk
        self.pairs = np.empty(0, np.int64)
        self.starts = np.zeros(1, np.int64)

    def learn(self, chunks: set[str]) -> None:
        """Align what is not known yet; what was known may be forgotten, but for ``chunks``."""
        fresh = list(chunks.difference(self.known))
        if self.known and (len(self.known) + len(fresh) > self.most or self.held > self.most_bytes):
            self._shrink()
            fresh = list(chunks.difference(self.known))
        if not fresh:
            return
        closed = [c for c in fresh if c[-1] not in _WHITE]
        texts = [closed[i : i + JOINED] for i in range(0, len(closed), JOINED)]
        # A chunk that ends in white space does not stand before another one.
        texts += [[c] for c in fresh if c[-1] in _WHITE]
        a, b, good = self.words.ids(["".join(t) for t in texts])
        # What is not given back is found chunk by chunk.
        alone = [[c] for t, ok in zip(texts, good) if not ok and len(t) > 1 for c in t]
        a2, b2, good2 = self.words.ids([c for c, in alone]) if alone else ([], [], [])
        fine = [(t, x, y) for t, x, y, ok in zip([*texts, *alone], [*a, *a2], [*b, *b2], [*good, *good2]) if ok]
        lost = [c for t, ok in zip([*texts, *alone], [*good, *good2]) if not ok and len(t) == 1 for c in t]
        chunks = [c for t, _, _ in fine for c in t]
        spelt, sizes, pairs = self._groups(chunks, [x for _, x, _ in fine], [y for _, _, y in fine])
        first = len(self.spelt)
        self.known.update(zip([*chunks, *lost], range(first, first + len(chunks) + len(lost))))
        self.held += sum(map(len, spelt)) + sum(map(len, fresh)) + 8 * len(pairs)
        self.spelt += spelt + [b""] * len(lost)
        sizes = np.concatenate([sizes, np.zeros((len(lost), 3), np.int64)])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.good = np.concatenate([self.good, np.repeat([True, False], [len(chunks), len(lost)])])
        self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int64)])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes[:, 2])])

    def _shrink(self) -> None:
        """Keep the chunks that came up again, if they are less than half of all; most are seen once."""
        keep = self.uses > 1
        spelt = [x for x, k in zip(self.spelt, keep.tolist()) if k]
        known = [c for c, i in self.known.items() if keep[i]]
        held = sum(map(len, spelt)) + sum(map(len, known)) + 8 * int(self.sizes[keep, 2].sum())
        if len(spelt) > self.most // 2 or held > self.most_bytes // 2:
            return self._clear()
        place = np.cumsum(keep) - 1
        kept = np.repeat(keep, np.diff(self.starts))
        self.known = {c: int(place[self.known[c]]) for c in known}
        self.spelt, self.held, self.sizes, self.good = spelt, held, self.sizes[keep], self.good[keep]
        self.pairs, self.starts = self.pairs[kept], np.r_[0, np.cumsum(self.sizes[:, 2])]
        self.uses = np.zeros(len(spelt), np.int64)

    def _groups(self, chunks: list[str], a: list[list[int]], b: list[list[int]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Per chunk its groups as text, each closed by a semicolon, and its sizes; and all linked pairs."""
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64, sum(map(len, x))) for x in (a, b))
        # Chunks one after the other: tokens that end at the same byte of all are linked.
        end_a, end_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        link_a, link_b = flat_a[np.searchsorted(end_a, common)], flat_b[np.searchsorted(end_b, common)]
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        bounds = np.cumsum(np.fromiter((len(c.encode()) for c in chunks), np.int64, len(chunks)))
        upto = np.stack([np.searchsorted(x, bounds, "right") for x in (end_a, end_b, common)], axis=1)
        # Tokens in the order they are written: a group's of A, then its of B.
        at_a = np.arange(len(flat_a)) + np.searchsorted(group_b, group_a, "left")
        at_b = np.arange(len(flat_b)) + np.searchsorted(group_a, group_b, "right")
        which_a, which_b = (2 * ids + np.r_[g[1:] != g[:-1], True][: len(ids)] for ids, g in ((flat_a, group_a), (flat_b, group_b)))
        parts, long = np.empty(len(flat_a) + len(flat_b), object), np.zeros(len(flat_a) + len(flat_b), np.int64)
        parts[at_a], parts[at_b] = self.text_a[which_a], self.text_b[which_b]
        long[at_a], long[at_b] = self.long_a[which_a], self.long_b[which_b]
        text = b"".join(parts.tolist())
        ends = np.r_[0, np.cumsum(long)][upto[:, 0] + upto[:, 1]].tolist()
        spelt = [text[i:j] for i, j in zip([0, *ends], ends)]
        return spelt, np.diff(upto, axis=0, prepend=np.zeros((1, 3), np.int64)), link_a * len(self.words.bytes_b) + link_b

    def look_up(self, chunks: list[str]) -> np.ndarray:
        which = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        self.uses[which] += 1
        return which

    def linked(self, which: np.ndarray) -> np.ndarray:
        """All pairs of some chunks, repeated ones too."""
        begin, size = self.starts[which], self.sizes[which, 2]
        ends = np.cumsum(size)
        return self.pairs[np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def _aligned(path_a: str, path_b: str) -> Aligned:
    """One per worker process; functions travel by value, so what is to stay lives in a module of its own."""
    state = sys.modules.setdefault("_ledgerlens_worker", types.ModuleType("_ledgerlens_worker")).__dict__
    key = f"{path_a}\n{path_b}"
    if key not in state:
        state[key] = Aligned(path_a, path_b)
    return state[key]


def _counted(values: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the sums of their times."""
    order = np.argsort(values, kind="stable")
    values, times = values[order], times[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
    return values[starts], np.add.reduceat(times, starts) if len(starts) else times


class _Document:
    """What one text comes to, part by part."""

    def __init__(self, text: str | None):
        self.text, self.good = text or "", bool(text)
        self.sizes = np.zeros(3, np.int64)
        self.hash, self.tail = hashlib.sha256(), b""
        self.pairs, self.times = np.empty(0, np.int64), np.empty(0, np.int64)

    def parts(self, chunk: re.Pattern) -> Iterator[list[str]]:
        if len(self.text) < PART:
            yield chunk.findall(" " + self.text)
            return
        found = chunk.finditer(" " + self.text)
        while some := [m.group() for m in islice(found, PART)]:
            yield some

    def add(self, aligned: Aligned, chunks: list[str]) -> None:
        if not self.good:
            return
        which = aligned.look_up(chunks)
        if not aligned.good[which].all():
            self.good = False
            return
        self.sizes += aligned.sizes[which].sum(axis=0)
        # The last semicolon of all is not part of the text.
        spelt = self.tail + b"".join(map(aligned.spelt.__getitem__, which.tolist()))
        self.hash.update(spelt[:-1])
        self.tail = spelt[-1:]
        pairs = aligned.linked(which)
        pairs, times = _counted(pairs, np.ones(len(pairs), np.int64))
        if len(self.pairs):
            pairs, times = _counted(np.concatenate([self.pairs, pairs]), np.concatenate([self.times, times]))
        self.pairs, self.times = pairs, times

    def row(self) -> tuple:
        return (*self.sizes.tolist(), self.hash.hexdigest()) if self.good else (0, 0, 0, "")


def _documents(texts: list[str | None], aligned: Aligned) -> list[_Document]:
    """Several texts at once: their chunks are learned together; a long text goes part by part."""
    docs = [_Document(t) for t in texts]
    waiting: list[tuple[_Document, list[str]]] = []
    n = 0

    def settle() -> None:
        nonlocal n
        aligned.learn(set().union(*(chunks for _, chunks in waiting)))
        for doc, chunks in waiting:
            doc.add(aligned, chunks)
        waiting.clear()
        n = 0

    for doc in docs:
        if doc.good:
            for chunks in doc.parts(aligned.words.chunk):
                waiting.append((doc, chunks))
                n += len(chunks)
                if n >= PART:
                    settle()
        doc.text = ""
    settle()
    return docs


def pack_places(places: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Bitmaps of rising places below 65,536, one per run: a list of two-byte places, or all bits where that is shorter."""
    ends = np.r_[starts[1:], len(places)]
    sizes = ends - starts
    data = places.astype("<u2")
    if (sizes < DENSE).all():
        offsets = (2 * np.r_[starts, len(places)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
    out = []
    for start, end in zip(starts.tolist(), ends.tolist()):
        if end - start < DENSE:
            out.append(data[start:end].tobytes())
        else:
            bits = np.zeros(BLOCK, np.uint8)
            bits[places[start:end]] = 1
            out.append(np.packbits(bits, bitorder="little").tobytes())
    return pa.array(out, pa.binary())


def unpack_places(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of several bitmaps one after the other, and how many each has."""
    sizes = pc.binary_length(bitmaps).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = sizes // 2
    dense = np.flatnonzero(sizes == BLOCK // 8)
    data = np.frombuffer(b"".join(bitmaps.to_pylist()), "<u2")
    if not len(dense):
        return data.astype(np.int64), counts
    starts = np.cumsum(counts) - counts
    parts, at = [], 0
    for i in dense.tolist():
        parts.append(data[at : starts[i]])
        at = int(starts[i] + counts[i])
        places = np.flatnonzero(np.unpackbits(data[starts[i] : at].view(np.uint8), bitorder="little"))
        counts[i] = len(places)
        parts.append(places)
    parts.append(data[at:])
    return np.concatenate([p.astype(np.int64) for p in parts]), counts


def _postings(pairs: np.ndarray, places: np.ndarray, times: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, pair, plane, bits) of entries that are in order of places."""
    order = np.argsort(pairs, kind="stable")
    pairs, places, times = pairs[order], places[order], times[order]
    for plane in range(int(times.max()).bit_length() if len(times) else 0):
        has = (times >> plane) & 1 == 1
        own, at = pairs[has], places[has]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
        for i in range(0, len(starts), 1 << 14):
            some = starts[i : i + (1 << 14)]
            end = starts[i + (1 << 14)] if i + (1 << 14) < len(starts) else len(own)
            n = len(some)
            yield pa.record_batch(
                [pa.array(np.full(n, block)), pa.array(own[some]), pa.array(np.full(n, plane, np.int32)),
                 pack_places(at[some[0] : end], some - some[0])],
                ["_block", "_pair", "_plane", "_bits"],
            )


@dataclass(frozen=True)
class Alignment:
    """``documents`` (id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per document,
    and ``pairs`` (a, b, docs, links, best): in how many documents and how often the two ids are linked."""

    documents: DataFrame
    pairs: DataFrame


def align_tokenizers(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    flush: int = FLUSH,
    docs_per_block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Alignment:
    """How two tokenizers cut the same texts, and how often the corpus links each two ids.

    A text is read with a space in front. ``path_a`` is a byte-level
    vocabulary file, ``path_b`` a SentencePiece model that adds the space
    itself; names of special tokens are plain text. Byte offsets where a
    token of A and one of B end close a group and link the two. A pair's
    count is its number of links in the corpus; a link is best if no pair
    with its B id has a higher count.

    A task holds at most ``flush`` entries (document, pair) before it writes
    them as bitmaps. Those of one pair and block are ORed where they meet;
    only numbers per pair are summed further. Counts return block by block:
    a block's task holds two numbers per document and no texts. A pair that
    all documents have is a bit per document, dealt by blocks.

    Missing and empty texts, and those that a tokenizer does not give back
    byte for byte, have no tokens: zeros and ``''``. Texts are cut into
    chunks at white space and read part by part, so a very long one needs
    memory for its distinct pairs; one that is a single word is one chunk.
    Repeated rows, and rows without an id, count each. An empty table gives
    empty tables. Other columns are ignored.
    """
    if not 0 < docs_per_block <= BLOCK:
        raise ValueError("a block has at most 65,536 documents")
    scratch = Scratch(docs.sparkSession, "alignment")
    kind = docs.schema[id_col].dataType.simpleString()
    fields = (
        f"_block bigint, _pair bigint, _plane int, _bits binary, _place int, _id {kind}, "
        "n_a bigint, n_b bigint, n_links bigint, groups_sha256 string"
    )
    names = [f.split()[0] for f in fields.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligned, task, seen = _aligned(path_a, path_b), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        rows: list[tuple] = []
        n = 0

        def settle(block: int) -> Iterator[pa.RecordBatch]:
            pairs, times = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            places = np.repeat([h[0] for h in held], [len(h[1]) for h in held])
            for batch in _postings(pairs, places, times, block):
                empty = [pa.nulls(batch.num_rows, t) for t in kinds]
                yield pa.record_batch([*batch.columns, *empty], names)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            kinds = [pa.int32(), ids.type, pa.int64(), pa.int64(), pa.int64(), pa.string()]
            for some_ids, some_texts in _slices(ids, texts):
                for one, doc in zip(some_ids, _documents(some_texts, aligned)):
                    block, place = (task << 31) + seen // docs_per_block, seen % docs_per_block
                    seen += 1
                    rows.append((block, place, one, *doc.row()))
                    if doc.good and len(doc.pairs):
                        held.append((place, doc.pairs, doc.times))
                        n += len(doc.pairs)
                    if held and (n >= flush or place == docs_per_block - 1):
                        yield from settle(block)
                        held, n = [], 0
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), *kinds])]
                    empty = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.int32(), pa.binary())]
                    yield pa.record_batch([columns[0], *empty, *columns[1:]], names)
                    rows = []
        if held:
            yield from settle((task << 31) + (seen - 1) // docs_per_block)

    found, _ = scratch.save(docs.select(F.col(id_col).alias("_id"), text_col).mapInArrow(read, fields))
    postings = found.where("_pair IS NOT NULL").select("_block", "_pair", "_plane", "_bits")
    n_b = _pieces(path_b)
    merged, _ = scratch.save(_merged(postings))
    counts = merged.groupBy("_pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    a, b = F.floor(F.col("_pair") / n_b).cast("int").alias("a"), (F.col("_pair") % n_b).cast("int").alias("b")
    best = F.max("links").over(Window.partitionBy("b"))
    pairs, _ = scratch.save(
        counts.select("_pair", a, b, "docs", "links").withColumn("best", F.col("links") == best)
    )
    return Alignment(
        _returned(found, merged.select("_block", "_pair", "_planes"), pairs.select("_pair", "links", "best")).withColumnRenamed("_id", id_col),
        pairs.drop("_pair"),
    )


def _pieces(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def _slices(ids: pa.Array, texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[list, list[str | None]]]:
    """Ids and texts of a bounded number of bytes; a longer text comes alone."""
    start = held = 0
    for i, size in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if held and held + size > most:
            yield ids.slice(start, i - start).to_pylist(), texts.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += size
    yield ids.slice(start).to_pylist(), texts.slice(start).to_pylist()


def _bounded(bitmaps: pa.Array, starts: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` places or fewer and begin at ``starts``."""
    sizes = pc.binary_length(bitmaps).to_numpy(zero_copy_only=False).astype(np.int64)
    places = np.r_[0, np.cumsum(np.where(sizes == BLOCK // 8, BLOCK, sizes // 2))]
    bounds = [*starts.tolist(), len(sizes)]
    begin = 0
    for here, after in zip(bounds, bounds[1:]):
        if here > begin and places[after] - places[begin] > most:
            yield begin, here
            begin = here
    yield begin, len(sizes)


def _ored(rows: pa.Table) -> pa.RecordBatch:
    """One row per pair and block of rows sorted by them."""
    pair, block = rows.column("_pair").to_numpy(), rows.column("_block").to_numpy()
    places, counts = unpack_places(rows.column("_bits").combine_chunks())
    digit = np.repeat(rows.column("_plane").to_numpy(), counts).astype(np.int64)
    new = np.r_[True, (pair[1:] != pair[:-1]) | (block[1:] != block[:-1])]
    first, lists = np.flatnonzero(new), np.cumsum(new) - 1
    # One number per bit that is set: list, plane, place. The set of them is the OR of the bitmaps.
    bits = np.unique((np.repeat(lists, counts) << 40) + (digit << 16) + places)
    starts = np.flatnonzero(np.r_[True, bits[1:] >> 16 != bits[:-1] >> 16])
    owner, plane = bits[starts] >> 40, (bits[starts] >> 16) & 0xFFFFFF
    # All planes up to the highest, empty where no document has that digit.
    n_planes = np.zeros(len(first), np.int64)
    np.maximum.at(n_planes, owner, plane + 1)
    offsets = np.r_[0, np.cumsum(n_planes)]
    place_of = np.full(offsets[-1], -1)
    place_of[offsets[owner] + plane] = np.arange(len(starts))
    planes = pc.fill_null(pack_places(bits & 0xFFFF, starts).take(pa.array(place_of, mask=place_of < 0)), b"")
    links = np.zeros(len(first), np.int64)
    np.add.at(links, owner, np.diff(np.r_[starts, len(bits)]) << plane)
    documents = np.unique(((bits >> 40) << 16) + (bits & 0xFFFF)) >> 16
    return pa.record_batch(
        [
            pa.array(block[first]), pa.array(pair[first]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), planes),
            pa.array(np.bincount(documents, minlength=len(first))), pa.array(links),
        ],
        ["_block", "_pair", "_planes", "docs", "links"],
    )


def _merged(postings: DataFrame) -> DataFrame:
    """(block, pair, planes, docs, links): partial bitmaps ORed, and their population counts.

    ``_planes`` has a bitmap per binary digit, lowest first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in key_runs(batches):
            pair, block = rows.column("_pair").to_numpy(), rows.column("_block").to_numpy()
            starts = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (block[1:] != block[:-1])])
            for begin, end in _bounded(rows.column("_bits").combine_chunks(), starts):
                yield _ored(rows.slice(begin, end - begin).combine_chunks())

    return (
        postings.select("_pair", "_block", "_plane", "_bits")
        .repartition("_pair", "_block")
        .sortWithinPartitions("_pair", "_block")
        .mapInArrow(run, "_block bigint, _pair bigint, _planes array<binary>, docs bigint, links bigint")
    )


def _returned(found: DataFrame, merged: DataFrame, scores: DataFrame) -> DataFrame:
    """Documents with the sums that the postings of their block return to them."""
    names = ["_place", "_id", "n_a", "n_b", "n_links", "groups_sha256"]
    scored = merged.join(scores, "_pair").select("_block", "_planes", "links", "best", *(F.lit(None).alias(c) for c in names))
    rows = found.where("_place IS NOT NULL").select(
        "_block", *(F.lit(None).alias(c) for c in ("_planes", "links", "best")), *names
    )
    kind = found.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sums, best = None, None, None
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            cuts = np.flatnonzero(blocks[1:] != blocks[:-1]) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if start == end:
                    continue
                if block != blocks[start]:
                    block, sums, best = blocks[start], np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.int64)
                part = batch.slice(start, end - start)
                asked = part.column("_place").is_valid()
                lists = part.filter(pc.invert(asked))
                if lists.num_rows:
                    _give(lists, sums, best)
                docs = part.filter(asked)
                if docs.num_rows:
                    at = docs.column("_place").to_numpy()
                    links = docs.column("n_links")
                    yield pa.record_batch(
                        [*(docs.column(c) for c in ("_id", "n_a", "n_b", "n_links")), links, pa.array(best[at]), pa.array(sums[at]), docs.column("groups_sha256")],
                        ["_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                    )

    return (
        scored.unionByName(rows)
        .repartition("_block")
        .sortWithinPartitions("_block", F.col("_place").isNotNull())
        .mapInArrow(run, f"_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
    )


def _give(lists: pa.RecordBatch, sums: np.ndarray, best: np.ndarray) -> None:
    """Add each pair's count to the documents of its bitmaps, a plane's twice what the one before gave."""
    planes = lists.column("_planes")
    sizes = pc.list_value_length(planes).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    weight = np.left_shift(1, np.arange(ends[-1]) - np.repeat(ends - sizes, sizes))
    count = weight * np.repeat(lists.column("links").to_numpy(), sizes)
    chosen = weight * np.repeat(lists.column("best").to_numpy(zero_copy_only=False).astype(np.int64), sizes)
    bitmaps = planes.flatten()
    for begin, end in _bounded(bitmaps, np.arange(len(bitmaps))):
        places, counts = unpack_places(bitmaps.slice(begin, end - begin))
        np.add.at(sums, places, np.repeat(count[begin:end], counts))
        np.add.at(best, places, np.repeat(chosen[begin:end], counts))
