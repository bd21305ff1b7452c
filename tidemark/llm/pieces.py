"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

``PieceModel.load`` reads a piece file (kinds, texts and scores) and builds the trie on the
driver; its size is that of the vocabulary, so it is broadcast.  A text gets a leading blank
and its blanks are the whitespace marker; the best segmentation has the greatest sum of log scores.
Characters without a piece fall back to their byte pieces.  Decoding turns ids into bytes,
markers into blanks, and drops the leading one: every text comes back exactly.

A piece file of the pair-merging kind has merge ranks in place of log probabilities; these
are read as a Zipf law, log p = -log(rank + 2.7) less the log of their sum.  No piece has a
marker behind another character, so a boundary stands before each blank that follows a
non-blank, and a text falls into units that are segmented on their own, which gives the same
optimum.  Units that are new to a worker are segmented together: the trie is walked for all of
them in lock step with numpy.  A unit cache of bounded size keeps the frequent ones.

Among equal sums the longer last piece wins.  Defined cases: null and empty texts have no ids
and decode to the empty text; unknown special strings are ordinary text; equal texts get
equal ids; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.text import doc_rows, documents, parted, slices, string_column

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
UNKNOWN_COST = 10.0  # below the least score of the vocabulary, as the format has it

CACHE_UNITS = 250_000
CACHE_IDS = 3_000_000
BLOCK_BYTES = 1 << 19  # of new units, segmented together


@dataclass
class PieceModel:
    base: np.ndarray  # child of node s by byte c: base[s] + c
    check: np.ndarray  # parent of a node, -1 where free
    leaf: np.ndarray  # piece id that ends at a node, or -1
    score: np.ndarray  # log score by id
    byte_id: np.ndarray  # byte value to id
    text: list[bytes]  # bytes that an id stands for
    inner_marker: bool  # whether a piece has a marker behind another character
    lonely: bytes  # ASCII characters that no longer piece contains

    @staticmethod
    def load(path: str = PIECES) -> PieceModel:
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=path)
        n = file.get_piece_size()
        texts, pieces, byte_id = [], [], np.full(256, -1, np.int32)
        raw = np.array([file.get_score(i) for i in range(n)])
        for i in range(n):
            if file.is_byte(i):
                byte_id[int(file.id_to_piece(i)[1:-1], 16)] = i
                texts.append(bytes([int(file.id_to_piece(i)[1:-1], 16)]))
            elif file.is_control(i) or file.is_unknown(i) or file.is_unused(i):
                texts.append(b"")
            else:
                texts.append(file.id_to_piece(i).replace(MARKER, " ").encode())
                pieces.append((texts[-1], i))
        if (byte_id < 0).any():
            raise ValueError("the piece file has no byte pieces to fall back to")
        own = np.array([i for _, i in pieces])
        ranked = len(own) > 2 and np.array_equal(raw[own], np.round(raw[own])) and raw[own].min() <= -len(own) / 2
        score = np.full(n, -np.inf)
        # Unused ranks carry a huge negative score; they keep their place at the end of the order.
        rank = np.clip(-raw[own], 0, 4 * n)
        score[own] = -np.log(rank + 2.7) - np.log((1 / (rank + 2.7)).sum()) if ranked else raw[own]
        # Scores on a binary grid have exact sums, so that ties are ties whatever the order of addition.
        return PieceModel.build(pieces, np.round(score * 2**20) / 2**20, byte_id, texts)

    @staticmethod
    def build(pieces: list[tuple[bytes, int]], score: np.ndarray, byte_id: np.ndarray, texts: list[bytes]) -> PieceModel:
        base, check, leaf = _double_array(pieces)
        inner = any(b" " in b.lstrip(b" ") for b, _ in pieces)
        used = {c for b, _ in pieces if len(b.decode()) > 1 for c in b}
        lonely = bytes(c for c in range(0x20) if c not in used)
        return PieceModel(base, check, leaf, score, byte_id, texts, inner, lonely)

    def splitter(self) -> re.Pattern:
        """Units of a text: blanks and what follows up to the next blank; lonely characters alone."""
        if self.inner_marker:
            return re.compile(b"(?s).+")
        alone = re.escape(self.lonely)
        if not alone:
            return re.compile(b" *[^ ]+| +")
        return re.compile(b" *[^ " + alone + b"]+| +|[" + alone + b"]")


def _double_array(pieces: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and leaf over the bytes of the pieces; a node's children lie at base + byte."""
    tree: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for b, i in pieces:
        at = 0
        for c in b:
            if c not in tree[at]:
                tree[at][c] = len(tree)
                tree.append({})
            at = tree[at][c]
        ends[at] = i
    room = 2 * len(tree) + 2048
    base, check, leaf = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32)
    used = bytearray(room)
    used[0] = 1
    # Nodes with one child fill the holes; the others are laid from a cursor on that moves past dense parts.
    place, hole, cursor, queue = {0: 0}, 256, 256, [0]
    for node in queue:  # breadth first
        if node in ends:
            leaf[place[node]] = ends[node]
        children = sorted(tree[node])
        if not children:
            continue
        offset, tries = (hole if len(children) == 1 else cursor) - children[0], 0
        while True:
            if offset + 512 > len(used):
                more = len(used)
                used += bytes(more)
                base, check, leaf = (np.concatenate([x, np.full(more, f, np.int32)]) for x, f in ((base, 0), (check, -1), (leaf, -1)))
            if not any(used[offset + c] for c in children):
                break
            offset, tries = offset + 1, tries + 1
        if len(children) > 1 and tries > 32:
            cursor = offset + children[0]
        base[place[node]] = offset
        for c in children:
            used[offset + c] = 1
            check[offset + c] = place[node]
            place[tree[node][c]] = offset + c
            queue.append(tree[node][c])
        while hole < len(used) and used[hole]:
            hole += 1
    pad = np.full(256, -1, np.int32)
    return np.concatenate([base, pad * 0]), np.concatenate([check, pad]), np.concatenate([leaf, pad])


def viterbi(units: list[bytes], model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best segmentation of every unit, one behind the other, and their numbers."""
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    order = np.argsort(-lengths, kind="stable")
    size = lengths[order]
    width = int(size[0])
    room = np.concatenate([[0], np.cumsum(size + 1)])  # one more place a unit: its end
    flat = np.frombuffer(b"\0".join([*map(units.__getitem__, order.tolist()), b""]), np.uint8).astype(np.int64)
    best = np.full(len(flat), -np.inf)
    step = np.zeros(len(flat), np.int32)  # bytes of the last piece that ends here
    used = np.full(len(flat), -1, np.int32)  # its id; -1: one character without a piece
    best[room[:-1]] = 0.0
    low = float(model.score[np.isfinite(model.score)].min()) - UNKNOWN_COST
    chars = np.where(flat < 0x80, 1, np.where(flat < 0xE0, 2, np.where(flat < 0xF0, 3, 4)))
    starts = (flat & 0xC0) != 0x80
    live = len(order)
    for s in range(width):
        while live and size[live - 1] <= s:
            live -= 1
        at = room[:live] + s
        here = starts[at]
        at, stop = at[here], room[1 : live + 1][here] - 1
        node = np.zeros(len(at), np.int64)
        whole = np.zeros(len(at), bool)  # whether the first character is a piece
        whole_of = np.arange(len(at))
        begin, k = at, 0
        first = chars[at]
        while len(begin):
            inside = begin + k < stop
            if not inside.all():
                begin, stop, node, whole_of = begin[inside], stop[inside], node[inside], whole_of[inside]
                if not len(begin):
                    break
            child = model.base[node] + flat[begin + k]
            good = model.check[child] == node
            begin, stop, node, whole_of = begin[good], stop[good], child[good], whole_of[good]
            k += 1
            piece = model.leaf[node]
            hit = piece >= 0
            if hit.any():
                b, q = begin[hit], piece[hit]
                whole[whole_of[hit][first[whole_of[hit]] == k]] = True
                value = best[b] + model.score[q]
                e = b + k
                better = value > best[e]
                e, value, q = e[better], value[better], q[better]
                best[e], step[e], used[e] = value, k, q
        bare = np.flatnonzero(~whole)
        if len(bare):
            b = at[bare]
            e = b + first[bare]
            value = best[b] + low
            better = value > best[e]
            b, e, value = b[better], e[better], value[better]
            best[e], step[e], used[e] = value, e - b, -1
    # All paths are followed back together; each round gives the last open piece of every unit.
    unit, at = np.arange(len(order)), room[1:] - 1
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # unit, byte where the piece ends, id
    while True:
        open_ = at > room[unit]
        unit, at = unit[open_], at[open_]
        if not len(unit):
            break
        piece, n = used[at], step[at].astype(np.int64)
        known = piece >= 0
        found.append((unit[known], at[known], piece[known]))
        for k in range(4):  # the bytes of characters without a piece
            rest = ~known & (n > k)
            if rest.any():
                found.append((unit[rest], at[rest] - k, model.byte_id[flat[at[rest] - k - 1]]))
        at = at - n
    owner, end, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    back = np.lexsort((end, order[owner]))
    return ids[back].astype(np.int32), np.bincount(order[owner], minlength=len(units))


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` with place for ``n`` values at least."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


class Encoder:
    """Segments batches of texts in one worker; keeps the units that it has met."""

    def __init__(self, model: PieceModel):
        self.model, self.split = model, model.splitter()
        self.place: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.begin = np.zeros(1 << 12, np.int64)
        self.size = np.zeros(1 << 12, np.int64)
        self.used = 0

    def _add(self, units: list[bytes]) -> None:
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
        first = 0
        while first < len(units):
            stop = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK_BYTES, "right"))
            block = units[first : max(stop, first + 1)]
            ids, count = viterbi(block, self.model)
            n = len(self.place)
            self.begin, self.size = _room(self.begin, n + len(block)), _room(self.size, n + len(block))
            self.ids = _room(self.ids, self.used + len(ids))
            self.ids[self.used : self.used + len(ids)] = ids
            self.begin[n : n + len(block)] = self.used + np.cumsum(count) - count
            self.size[n : n + len(block)] = count
            self.place.update(zip(block, range(n, n + len(block)), strict=True))
            self.used += len(ids)
            first += len(block)

    def encode(self, encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one behind the other, and the number of ids of each text."""
        if len(self.place) > CACHE_UNITS or self.used > CACHE_IDS:
            self.place, self.used = {}, 0
        units: list[bytes] = []
        count = []
        for b in encoded:
            part = self.split.findall(b" " + b) if b else []
            count.append(len(part))
            units += part
        at = np.fromiter(map(self.place.get, units, repeat(-1)), np.int64, len(units))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            missing = [units[i] for i in unknown.tolist()]
            self._add([*dict.fromkeys(missing)])
            at[unknown] = np.fromiter(map(self.place.__getitem__, missing), np.int64, len(missing))
        n = self.size[at]
        total = np.concatenate([[0], np.cumsum(n)])
        pick = np.arange(total[-1]) + np.repeat(self.begin[at] - total[:-1], n)
        ends = np.cumsum(count)
        return self.ids[pick], total[ends] - total[ends - count]


class Decoder:
    """Ids back to bytes."""

    def __init__(self, model: PieceModel):
        self.size = np.array([len(t) for t in model.text], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.bytes = np.frombuffer(b"".join(model.text), np.uint8)

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        n = self.size[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        flat = self.bytes[np.arange(total[-1]) + np.repeat(self.begin[ids] - total[:-1], n)].tobytes()
        ends = np.cumsum(count)
        return [flat[a + 1 : b] if b > a else b"" for a, b in zip(total[ends - count].tolist(), total[ends].tolist(), strict=True)]


def _flat(lists: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(lists) if lists else np.zeros(0, np.int32)


def encode(docs: DataFrame, model: PieceModel) -> DataFrame:
    """doc_id, n_tokens, ids and whether decoding gives the text back, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        for batch in parted(batches):
            names = batch.column(batch.schema.get_field_index("doc_id"))
            for first, encoded in slices(string_column(batch, "text")):
                ids, count = encoder.encode(encoded)
                back = decoder.decode(ids, count)
                offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [names.slice(first, len(encoded)), pa.array(count, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32())),
                     pa.array([a == b for a, b in zip(back, encoded, strict=True)], pa.bool_())],
                    names=["doc_id", "n_tokens", "ids", "round_trip"],
                )

    return doc_rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(rows: DataFrame, model: PieceModel) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids give the empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in parted(batches):
            lists = [np.array(x or [], np.int32) for x in batch.column(1).to_pylist()]
            back = decoder.decode(_flat(lists), np.array([len(x) for x in lists]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b.decode(errors="replace") for b in back], pa.string())], names=["doc_id", "text"]
            )

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


# --- the query -------------------------------------------------------------------------------


def sentencepiece_codes(spark, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), PieceModel.load())
