import array
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from broadsheet.llm import bpe, pack

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(open(WORD).read())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abcdefinst'’é \n.,!<|>endoftxs0123", max_size=80))
def test_like_the_library(library, coder, text):
    ids, said = next(coder.batch([text]))
    want = library.encode(text, add_special_tokens=False).ids
    assert array.array("I", ids).tolist() == want
    assert said == library.decode(want, skip_special_tokens=False)


def test_prefixes_are_worked_out_once(coder):
    before = coder.trie.visited
    words = sorted(["interqzx" + e for e in ("aaa", "aab", "aac")])
    list(coder.trie.encode(words))
    assert coder.trie.visited - before <= len(words[0]) + 2 * 2


def test_operator(spark, odd, nothing, corpus, library):
    for docs in (odd, corpus):
        got = sorted(tuple(r) for r in bpe.encode_digests(docs, WORD).fillna(-1).collect())
        want = []
        for r in docs.select("doc_id", "text").collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            want.append((-1 if r["doc_id"] is None else r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert got == sorted(want)
    assert bpe.encode_digests(nothing, WORD).count() == 0


def test_two_files_in_one_session(spark, tmp_path):
    """A worker tells tokenizers apart by what is in them."""
    import json

    docs = spark.createDataFrame([(1, "the of and the")], "doc_id long, text string").coalesce(1)
    for name, operator, path in (("words", lambda p, s: bpe.encode(docs, p), WORD), ("bytes", lambda p, s: pack.pack(docs, s, p), BYTE)):
        from broadsheet.llm.common import Scratch

        spec = json.load(open(path))
        vocab = spec["model"]["vocab"]
        one, two = ("the</w>", "of</w>") if name == "words" else ("the", "Ġof")
        vocab[one], vocab[two] = vocab[two], vocab[one]
        other = tmp_path / f"{name}.json"
        other.write_text(json.dumps(spec))
        for p in (path, str(other), path):
            want = Tokenizer.from_file(p).encode("the of and the", add_special_tokens=False).ids
            assert operator(p, Scratch(spark, name)).first()["ids"][: len(want)] == want


def check_packed(docs, rows, capacity=1024):
    t = Tokenizer.from_file(BYTE)
    pieces, total = [], 0
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        pieces += [(r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        total += len(ids)
    key = lambda x: (x[0] is not None, x)
    assert sorted(pieces, key=key) == sorted([tuple(r)[:5] for r in rows], key=key)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= capacity
    return len(by), -(-total // capacity)


def test_packing(spark, odd, nothing, corpus, scratch):
    check_packed(odd, pack.pack(odd, scratch, BYTE).collect())
    from broadsheet.llm.common import Scratch

    used, least = check_packed(corpus, pack.pack(corpus, Scratch(spark, "p"), BYTE).collect())
    assert used <= 1.03 * least + 1
    assert pack.pack(nothing, Scratch(spark, "q"), BYTE).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_best_fit_is_one_by_one_best_fit(lengths):
    counts = {x: lengths.count(x) for x in set(lengths)}
    runs, used = pack.best_fit(counts, 64)
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= x]
        if fit:
            gaps[gaps.index(min(fit))] -= x
        else:
            gaps.append(64 - x)
    assert used <= len(gaps)
    full = {}
    ends = {}
    for r in runs:
        ends.setdefault(r[0], []).append(r)
    for length, rs in ends.items():
        rs.sort(key=lambda r: r[1])
        for r, nxt in zip(rs, [*rs[1:], None]):
            n = (nxt[1] if nxt else counts[length]) - r[1]
            for k in range(n):
                full.setdefault(r[2] + k, []).append((r[3], length))
    assert sum(len(v) for v in full.values()) == len(lengths)
    for v in full.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 64


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def encoder():
    return pack.Encoder(open(BYTE).read())


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab's  \t\n\x85\xa0\x1c1²é<|endoftext|>", max_size=80))
def test_byte_ids_like_the_library(byte_library, encoder, text):
    assert encoder.ids(text).tolist() == byte_library.encode(text, add_special_tokens=False).ids


def test_tokens_are_given_not_only_their_digests(odd, library, byte_library, scratch):
    texts = sorted((r["doc_id"] or -1, r["text"] or "") for r in odd.select("doc_id", "text").collect())
    want = sorted((i, ids := library.encode(t, add_special_tokens=False).ids, library.decode(ids, skip_special_tokens=False)) for i, t in texts)
    assert sorted((r["doc_id"] or -1, r["ids"], r["decoded"]) for r in bpe.encode(odd, WORD).collect()) == want
    rows = pack.pack(odd, scratch, BYTE).collect()
    at = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] or -1, r["piece"])):
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        at.setdefault((r["doc_id"] or -1, r["start"]), []).append(r["ids"])
    for i, t in texts:
        ids = [*byte_library.encode(t, add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for x, y in zip(cuts, cuts[1:]):
            at[i, x].remove(ids[x:y])
    assert not any(at.values())
