"""SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .bpe import small_groups, worker_cache

#: What a worker's table holds at most beside the words of the texts at hand: words, and characters in them.
TABLE_WORDS, TABLE_CHARS = 400_000, 8_000_000
#: The white space marker of the model's pieces.
MARK = "▁"
#: A marked word: a run of markers and what follows up to the next one.
WORD = re.compile(f"{MARK}+[^{MARK}]*")
#: Words up to this length are merged many at once, by their length; longer ones by a heap, one by one.
SHORT = 40
#: Words that are merged at once.
AT_ONCE = 50_000


def read_model(path: str) -> tuple[dict[str, int], dict[str, float], dict[int, int], int, int]:
    """Of a model file: ids of pieces, their scores, ids of byte pieces by byte, and the ids of begin and end.

    The file has to be of the kind that this operator is right for: merges by score, bytes for unknown characters, text
    taken as it is but for a marker in front, and no piece in which a marker follows another character.
    """
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kind = proto.ModelProto.SentencePiece
    n, t = model.normalizer_spec, model.trainer_spec
    ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
    others = {p.type for p in model.pieces} - {kind.NORMAL, kind.BYTE, kind.CONTROL, kind.UNKNOWN}
    plain = n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not n.precompiled_charsmap
    if t.model_type != t.BPE or not t.byte_fallback or t.treat_whitespace_as_suffix or not plain or others:
        raise ValueError(f"{path} isn't a BPE model with byte fallback, a marker in front and texts taken as they are")
    if crossing := next((p for p in ids if MARK in p.lstrip(MARK)), None):
        raise ValueError(f"the piece {crossing!r} crosses a white space marker")
    scores = {p.piece: p.score for p in model.pieces if p.type == kind.NORMAL}
    by_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
    name = {p.piece: i for i, p in enumerate(model.pieces)}
    return ids, scores, by_byte, name[t.bos_piece], name[t.eos_piece]


class Pieces:
    """Marked words to ids and back. Merging takes the adjacent pair whose piece has the highest score, the leftmost of equals."""

    def __init__(self, model: tuple) -> None:
        self.ids, self.scores, self.by_byte, self.begin, self.end = model
        self.piece = {i: p for p, i in self.ids.items()}
        self.byte = {i: b for b, i in self.by_byte.items()}
        self.coded = {i: i.to_bytes(4, "little") for i in (*self.piece, *self.byte)}
        # pieces by rank; equal scores have an equal rank, so that the leftmost pair comes first
        ranks = {s: r for r, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.rank = {p: ranks[s] for p, s in self.scores.items()}
        self.none = len(ranks)
        found = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                left, right = self.ids.get(p[:k]), self.ids.get(p[k:])
                if left is not None and right is not None:
                    found[left << 32 | right] = (self.rank[p], i)
        keys = sorted(found)
        self.pair = np.array([*keys, 1 << 62])
        self.pair_rank = np.array([*(found[k][0] for k in keys), self.none], np.int32)
        self.pair_makes = np.array([*(found[k][1] for k in keys), -1], np.int32)
        self.of_char = np.full(0x110000, -1, np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.table: tuple[dict[str, bytes], dict[str, str]] = ({}, {})
        self.older: tuple[dict[str, bytes], dict[str, str]] = ({}, {})
        self.chars = 0
        self.segmented = 0

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank and the piece of each pair; a character without a piece (-1) makes none."""
        key = left << 32 | right
        at = np.searchsorted(self.pair, key)
        hit = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.pair_rank[at], self.none), np.where(hit, self.pair_makes[at], -1)

    def merged(self, words: list[str]) -> Iterator[tuple[list[int], list[list[int]]]]:
        """(places in words, ids of each) for words of one length, in the order in which they get ready; -1 for a character without a piece.

        All words take one merge a round. A word that has a merge loses one symbol, so those that go on keep a common length.
        """
        code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)
        sym, who = self.of_char[code], np.arange(len(words))
        rank, makes = self.looked_up(sym[:, :-1], sym[:, 1:])
        while len(who):
            n = sym.shape[1]
            if n == 1:
                yield who.tolist(), sym.tolist()
                return
            at = rank.argmin(axis=1)
            row = np.arange(len(who))
            go = rank[row, at] < self.none
            if not go.all():
                yield who[~go].tolist(), sym[~go].tolist()
                sym, who, rank, makes, at = sym[go], who[go], rank[go], makes[go], at[go]
                row = np.arange(len(who))
                if not len(who):
                    return
            sym[row, at] = makes[row, at]
            stay = np.ones(sym.shape, bool)
            stay[row, at + 1] = False
            sym = sym[stay].reshape(-1, n - 1)
            stay = np.ones(rank.shape, bool)
            stay[row, at] = False
            rank, makes = rank[stay].reshape(len(who), n - 2), makes[stay].reshape(len(who), n - 2)
            for side in (-1, 0):  # only the pairs beside a merge have changed
                r = row[(at + side >= 0) & (at + side < n - 2)]
                i = at[r] + side
                rank[r, i], makes[r, i] = self.looked_up(sym[r, i], sym[r, i + 1])

    def merged_long(self, word: str) -> list[str]:
        """The same merges from a heap, in n log n steps; entries whose parts have changed meanwhile are passed over."""
        rank, parts, n = self.rank, [*word], len(word)
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        heap: list[tuple[int, int, str]] = []

        def offer(i: int) -> None:
            if (j := after[i]) < n and (r := rank.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (r, i, both))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if not parts[i] or (j := after[i]) >= n or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j], after[i] = both, "", after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def spelled(self, parts: list[str]) -> list[int]:
        """The ids of parts; those without a piece, which are single characters, are spelled in bytes."""
        return [i for p in parts for i in ([self.ids[p]] if p in self.ids else [self.by_byte[b] for b in p.encode("utf-8")])]

    def segment(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of distinct marked words, in any order."""
        self.segmented += len(words)
        by_length: dict[int, list[str]] = {}
        for w in words:
            if len(w) > SHORT:
                yield w, self.spelled(self.merged_long(w))
            else:
                by_length.setdefault(len(w), []).append(w)
        for alike in by_length.values():
            for k in range(0, len(alike), AT_ONCE):
                some = alike[k : k + AT_ONCE]
                for places, found in self.merged(some):
                    for i, ids in zip(places, found):
                        yield some[i], ids if min(ids) >= 0 else self.respelled(some[i], ids)

    def respelled(self, word: str, ids: list[int]) -> list[int]:
        out, at = [], 0
        for i in ids:
            n = len(self.piece[i]) if i >= 0 else 1
            out += [i] if i >= 0 else self.spelled([word[at]])
            at += n
        return out

    def said(self, ids: list[int]) -> str:
        """What ids of pieces and bytes stand for. Bytes that aren't UTF-8 become U+FFFD."""
        out = [bytes([self.byte[i]]) if i in self.byte else self.piece[i].replace(MARK, " ").encode("utf-8") for i in ids]
        return b"".join(out).decode("utf-8", "replace")

    def learn(self, words: set[str]) -> None:
        """Puts words into the table. A full table becomes the older one, whose words move over when they come again."""
        new = words.difference(self.table[0])
        size = sum(map(len, new))
        if len(self.table[0]) + len(new) > TABLE_WORDS or self.chars + size > TABLE_CHARS:
            self.older, self.table, self.chars, new = self.table, ({}, {}), 0, words
            size = sum(map(len, new))
        self.chars += size
        (ids_of, said_of), (old_ids, old_said) = self.table, self.older
        for w in new.intersection(old_ids):
            ids_of[w], said_of[w] = old_ids[w], old_said[w]
        coded, byte, piece = self.coded, self.byte, self.piece
        for w, ids in self.segment([*new.difference(old_ids)]):
            ids_of[w] = b"".join([coded[i] for i in ids])
            said_of[w] = self.said(ids) if not byte.keys().isdisjoint(ids) else "".join([piece[i] for i in ids]).replace(MARK, " ")

    def batch(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers with begin and end, decoded text) of each text."""
        begin, end = self.begin.to_bytes(4, "little"), self.end.to_bytes(4, "little")
        cut = [WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn(set().union(*cut))
        ids, said = self.table[0].__getitem__, self.table[1].__getitem__
        for words in cut:
            # the marker that was put in front goes again
            yield b"".join([begin, *map(ids, words), end]), "".join(map(said, words))[1:]


def pieces_of(model: Broadcast) -> Pieces:
    """A worker keeps the last model's table from task to task."""
    kept, value = worker_cache(), model.value
    key = hashlib.sha256(repr(value).encode()).digest() if getattr(kept, "pieces_from", None) is not value else kept.pieces_key
    if getattr(kept, "pieces_key", None) != key:
        kept.pieces = Pieces(value)
    kept.pieces_from, kept.pieces_key = value, key
    return kept.pieces


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = "") -> DataFrame:
    """Per row: the id, ids array<int> of the whole text with begin and end, and decoded, what these ids stand for.

    path: a model file on the driver (see read_model for the kind), which sends its pieces to the workers; their size is
    fixed by the model. Since no piece crosses a marker, no merge does, so a text's ids are those of its marked words one
    after the other. Each batch looks up its distinct words in a table, segments those that aren't there, and joins their
    ids back by position. The table is bounded; texts are handled in groups of bounded size, or one by one if longer.

    Null and empty texts give begin and end only, and decode to the empty text. Row order and repeated rows stay; columns
    other than these two aren't read. id_col may not be called ids or decoded. An empty table gives no rows. then: what to
    make of each batch of these rows in the same worker, of columns as schema says beside the id.
    """
    if then is None and id_col in ("ids", "decoded"):
        raise ValueError("the id's column would have the name of a result")
    model = docs.sparkSession.sparkContext.broadcast(read_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pieces_of(model)
        for b in batches:
            at = 0
            for group in small_groups(b.column(1).to_pylist()):
                ids, said = zip(*made.batch(group))
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                out = pa.RecordBatch.from_arrays([b.column(0).slice(at, len(group)), tokens, pa.array(said, pa.string())], names=[id_col, "ids", "decoded"])
                yield out if then is None else then(out)
                at += len(group)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {schema or 'ids array<int>, decoded string'}")
