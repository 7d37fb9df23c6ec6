"""BPE encoding and decoding of words that share prefixes, by last-token states along a trie."""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

#: Characters of text whose words are looked up together, and words whose encodings a worker remembers.
CHARS, WORDS = 4_000_000, 300_000
END = "</w>"
#: White space of the pre-tokenizer within the characters of PLAIN.
_WS = r"\t\n\x0b\x0c\r "
#: Text that needs no normalisation but lower case, and whose letters are those of _LETTER: ASCII, and Latin letters of two more blocks.
_PLAIN = r"\x00-\x7fÀ-ÖØ-öø-įıĲ-ž"
_LETTER = r"a-zß-öø-ž"
NOT_PLAIN = re.compile(f"[^{_PLAIN}]")
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_WS}{_LETTER}0-9]+")


def worker_cache() -> types.ModuleType:
    """What a Python worker keeps from task to task."""
    return sys.modules.setdefault("_broadsheet_worker", types.ModuleType("_broadsheet_worker"))


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Trie:
    """Encodes sorted words depth first; a state is the last token of a prefix and where it starts.

    The encoding of a prefix is that of the prefix before its last token, then this token. A token can be the last
    one exactly if it ends the prefix and merging can't join it, in whole or part, with the last token before it. The
    states of the path from the root to the present word are kept, so a prefix that words share is worked out once.
    """

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.longest = max(len(t.removesuffix(END)) for t in self.vocab)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(a, b): i for i, (a, b) in reversed(list(enumerate(pairs)))}
        self.token = {i: t for t, i in self.vocab.items()}
        self.made = {"".join(p): i for p, i in self.rank.items()}
        self.halves = {"".join(p): p for p in self.rank if self.made["".join(p)] == self.rank[p]}
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.visited = 0

    def symbols(self, token: str) -> list[str]:
        return [*token[: -len(END) - 1], token[-len(END) - 1 :]] if token.endswith(END) and token != END else [*token]

    def merged(self, parts: list[str]) -> list[str]:
        """Plain merging by rank, leftmost first."""
        while len(parts) > 1:
            best = min(((self.rank.get(p, 1 << 40), i) for i, p in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 40:
                break
            i = best[1]
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
        return parts

    def spine(self, token: int, right: bool) -> list[tuple[str, int]]:
        """The parts of a token at its right or left edge, from the whole on, each with the rank of the merge that ends it."""
        known = self.spines[right]
        if token not in known:
            out, part, until = [], self.token[token], 1 << 40
            while True:
                out.append((part, until))
                if part not in self.halves:
                    break
                until, part = self.made[part], self.halves[part][right]
            known[token] = out
        return known[token]

    def pair_fits(self, a: int, b: int) -> bool:
        """Whether merging keeps two tokens apart: no parts at their border merge before what takes them up inside.

        A merge's parts are older than it, so merges come in the order of their ranks; of equal ranks the left one is
        first.
        """
        rank, known = self.rank, True
        for x, until in self.spine(a, True):
            for y, end in self.spine(b, False):
                r = rank.get((x, y))
                if r is not None and r < until and r <= end:
                    known = False
                    break
            if not known:
                break
        self.fits[a << 20 | b] = known
        return known

    def reachable(self, token: int) -> bool:
        """Whether merging a token's own symbols makes it."""
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self.merged(self.symbols(self.token[token])) == [self.token[token]]
        return known

    def encode(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of sorted words in the byte-level alphabet, their ends not marked."""
        vocab, fits, whole, longest = self.vocab, self.fits, self.whole, self.longest
        last, start, before = [0], [0], ""
        for word in words:
            n, d = len(word), 0
            for x, y in zip(word, before):
                if x != y:
                    break
                d += 1
            if d == n:
                d -= 1  # the last letter is another symbol, as it ends the word
            del last[d + 1 :], start[d + 1 :]
            while d < n:  # states of longer and longer prefixes; the whole word last, with its end
                d += 1
                self.visited += 1
                low = max(0, d - longest)
                end = word[low:d] + END if d == n else word[low:d]
                # only one start can be right: the last token mostly goes on or ends, so those starts come first
                at = start[-1]
                for i in (*range(max(at, low), d), *range(min(at, d) - 1, low - 1, -1)):
                    t = vocab.get(end[i - low :])
                    if t is None:
                        continue
                    k = last[i] << 20 | t
                    if (not i or (fits[k] if k in fits else self.pair_fits(last[i], t))) and (whole[t] if t in whole else self.reachable(t)):
                        break
                else:
                    raise ValueError(f"the vocabulary can't spell {word!r}")
                last.append(t)
                start.append(i)
            ids, at = [], n
            while at:
                ids.append(last[at])
                at = start[at]
            ids.reverse()
            last.pop()  # this state is of the marked end
            start.pop()
            before = word[: n - 1]
            yield word, ids


class Coder:
    """Texts to ids and back as the library's file says, words looked up in a bounded memory."""

    def __init__(self, spec: str) -> None:
        parsed = json.loads(spec)
        self.spec, self.trie = spec, Trie(parsed)
        self.added = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.letters = {ord("\0") + b: c for b, c in byte_letters().items()}
        self.ids: dict[str, bytes] = {}
        self.said: dict[str, str] = {}
        for text, i in self.added.items():
            self.trie.token[i] = text
        self.bytes_of = {i: i.to_bytes(4, "little") for i in self.trie.token}
        self.library = None

    def words(self, text: str) -> list[str]:
        """The words of a text that has no added tokens in it."""
        if not NOT_PLAIN.search(text):
            return WORD.findall(text.lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
        # the library's own normaliser and splitter, for scripts with more rules; its words are in the byte-level alphabet
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        back = {c: b for b, c in self.letters.items()}
        return [bytes(back[c] for c in w).decode("utf-8") for w, _ in cut]

    def pieces(self, text: str) -> list[str]:
        if self.split is None or not any(t in text for t in self.added):
            return self.words(text)
        return [w for part in self.split.split(text) for w in ([part] if part in self.added else self.words(part))]

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.ids)
        if len(self.ids) + len(new) > WORDS:
            self.ids.clear()
            self.said.clear()
            new = words
        letters, spelled = self.letters, {}
        for_id, as_text = self.bytes_of, self.trie.token
        for w in new:
            if w in self.added:
                self.ids[w], self.said[w] = self.added[w].to_bytes(4, "little"), w
            else:
                spelled[w if w.isascii() and w.isalnum() else w.encode("utf-8").decode("latin-1").translate(letters)] = w
        for s, ids in self.trie.encode(sorted(spelled)):
            w = spelled[s]
            self.ids[w] = b"".join([for_id[i] for i in ids])
            self.said[w] = " ".join([as_text[i] for i in ids])

    def batch(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text."""
        cut = [self.pieces(t) for t in texts]
        self.learn(set().union(*cut))
        for words in cut:
            yield b"".join(map(self.ids.__getitem__, words)), " ".join(map(self.said.__getitem__, words))


def small_groups(texts: list[str | None], chars: int = CHARS) -> Iterator[list[str]]:
    """The texts in order, in lists of about so many characters; null as empty."""
    group, n = [], 0
    for t in texts:
        group.append(t or "")
        n += len(group[-1])
        if n >= chars:
            yield group
            group, n = [], 0
    if group:
        yield group


def coder(spec: Broadcast, make: Callable[[str], object] = Coder):
    """What make() gives for a tokenizer file; a worker keeps the last one, known by the file's contents."""
    kept, key = worker_cache(), (make.__name__, hashlib.sha256(spec.value.encode()).digest())
    if getattr(kept, "spec", None) != key:
        kept.spec, kept.coder = key, make(spec.value)
    return kept.coder


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = "") -> DataFrame:
    """Per row: the id, ids array<int> of the whole text's encoding, and decoded, the text that these ids stand for.

    path: a tokenizer's file of the kind with word ends, on the driver, which sends its contents to the workers (their size is
    fixed by the vocabulary). Null texts count as empty. Row order and repeated rows stay; other columns are not read. An empty table
    gives no rows. then: what to make of each batch of these rows in the same worker, of columns as schema says beside the
    id, for those who need something of the tokens rather than all of them.
    """
    spec = docs.sparkSession.sparkContext.broadcast(open(path, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = coder(spec)
        for b in batches:
            at = 0
            for group in small_groups(b.column("text").to_pylist()):
                ids, said = zip(*made.batch(group))
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                out = pa.RecordBatch.from_arrays([b.column(id_col).slice(at, len(group)), tokens, pa.array(said, pa.string())], names=[id_col, "ids", "decoded"])
                yield out if then is None else then(out)
                at += len(group)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInArrow(run, f"`{id_col}` {kind}, {schema or 'ids array<int>, decoded string'}")


def digests(b: pa.RecordBatch) -> pa.RecordBatch:
    """Of rows of encode(): the id, n_tokens, ids_sha256 (of 32-bit little-endian integers), decoded_sha256."""
    ends = b.column("ids").offsets.to_numpy()
    flat = b.column("ids").values.to_numpy().astype("<i4", copy=False)
    shas = [hashlib.sha256(flat[x:y]).hexdigest() for x, y in zip(ends, ends[1:])]
    said = [hashlib.sha256(x.as_buffer()).hexdigest() for x in b.column("decoded")]
    return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(shas, pa.string()), pa.array(said, pa.string())], names=[b.schema.names[0], "n_tokens", "ids_sha256", "decoded_sha256"])


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """The digests of what encode() gives; an empty table gives no rows."""
    return encode(docs, path, id_col, digests, DIGESTS)
