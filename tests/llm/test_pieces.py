import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from broadsheet.llm import bpe, pieces

from .conftest import TEXTS

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["▁", " ", "  ", "a", "e", "th", "ing", "\n", "\t", "日", "é", "\x00", "🙂", "<0x41>", "<s>", "0", "́", "zzzzz", "​", "�", "\U0010ffff", "word" * 12]


@pytest.fixture(scope="module")
def made():
    return pieces.Pieces(pieces.read_model(PATH))


def same(made, texts):
    want = LIBRARY.encode(texts, add_bos=True, add_eos=True, num_threads=1)
    for t, (ids, said), w in zip(texts, made.batch(texts), want):
        assert np.frombuffer(ids, "<i4").tolist() == w, t[:80]
        assert said == LIBRARY.decode(w), t[:80]


def test_like_the_library(made, corpus):
    same(made, [r["text"] or "" for r in corpus.select("text").collect()])
    same(made, [t or "" for t in TEXTS.values()])


def test_odd_texts_like_the_library(made):
    rng = random.Random(1)
    same(made, ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(5000)])


def test_a_small_table_changes_nothing(monkeypatch, corpus):
    texts = [r["text"] or "" for r in corpus.select("text").collect()]
    monkeypatch.setattr(pieces, "TABLE_WORDS", 500)
    monkeypatch.setattr(pieces, "AT_ONCE", 100)
    made = pieces.Pieces(pieces.read_model(PATH))
    for k in range(0, len(texts), 10):
        same(made, texts[k : k + 10])


def test_words_are_segmented_once(made):
    before = made.segmented
    list(made.batch(["onceseen twiceseen onceseen", "twiceseen onceseen"]))
    list(made.batch(["onceseen twiceseen"]))
    assert made.segmented - before == 2


def test_long_words_take_no_longer_than_their_length(made):
    took = []
    for n in (50_000, 200_000):
        began = time.process_time()
        same(made, ["z" * n + "日本" * n])
        took.append(time.process_time() - began)
    assert took[1] < 10 * max(took[0], 0.1)


def test_frames(spark, odd, nothing):
    rows = pieces.encode(odd, PATH).collect()
    assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in odd.collect()]
    for r, t in zip(rows, [r["text"] or "" for r in odd.collect()]):
        assert r["ids"] == LIBRARY.encode(t, add_bos=True, add_eos=True) and r["decoded"] == LIBRARY.decode(r["ids"])
    assert rows[0]["ids"] == [1, 2] and rows[0]["decoded"] == ""
    assert pieces.encode(nothing, PATH).collect() == []
    with pytest.raises(ValueError):
        pieces.encode(odd.withColumnRenamed("doc_id", "ids"), PATH, "ids")
    sums = pieces.encode(odd, PATH, then=bpe.digests, schema=bpe.DIGESTS)
    assert sums.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and sums.count() == odd.count()


def test_other_kinds_of_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    for change in (lambda m: setattr(m.normalizer_spec, "add_dummy_prefix", False), lambda m: setattr(m.trainer_spec, "model_type", 1), lambda m: setattr(m.pieces[300], "piece", "a▁b")):
        model = proto.ModelProto()
        model.ParseFromString(open(PATH, "rb").read())
        change(model)
        (tmp_path / "m").write_bytes(model.SerializeToString())
        with pytest.raises(ValueError):
            pieces.read_model(str(tmp_path / "m"))
