"""Encoding and decoding against the library itself, on tables, odd texts and random ids."""

import random

import public_tokenizers
import pytest
import sentencepiece

from hazeline.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = "abc ▁  \n\té\U0001f600\x00中<0x41></s>1234'́� "


@pytest.fixture(scope="module")
def both():
    v = pieces.vocabulary(PATH)
    return v, sentencepiece.SentencePieceProcessor(model_file=PATH)


def ids_of(encoder, text):
    b = encoder.encode(text)
    return [int.from_bytes(b[k : k + 4], "little") for k in range(0, len(b), 4)]


def test_odd_texts(both):
    v, sp = both
    e, d, rng = pieces.Encoder(v), pieces.Decoder(v), random.Random(1)
    texts = ["", " ", "▁", "x", *("a" * n for n in range(1, 40)), *(" " * n for n in range(1, 80))]
    texts += ["".join(rng.choice(ODD) for _ in range(rng.randrange(40))) for _ in range(3000)]
    for t in texts:
        assert ids_of(e, t) == sp.encode(t), t
        assert d.decode(sp.encode(t)) == sp.decode(sp.encode(t)), t


def test_one_token_of_each_prefix(both):
    """The table's entry for each prefix is the last token of that prefix's own encoding."""
    v, _ = both
    e, rng = pieces.Encoder(v), random.Random(2)
    for _ in range(60):
        t = "▁" + "".join(rng.choice("etaoinsh") for _ in range(20))
        assert all(e.tokens(t[:n])[-1] == pieces.merged(t[:n], v.score)[-1] for n in range(1, len(t) + 1))


def test_any_ids(both):
    v, sp = both
    d, rng = pieces.Decoder(v), random.Random(3)
    for _ in range(5000):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.choice(v.byte) if rng.random() < 0.8 else rng.randrange(3) for _ in range(rng.randrange(8))]
        assert d.decode(ids) == sp.decode(ids), ids


def test_long_texts_take_linear_time(both):
    v, sp = both
    e = pieces.Encoder(v)
    for t in ("ab" * 200_000, " " * 300_000, "\U0001f600" * 50_000):
        assert ids_of(e, t) == sp.encode(t)


def test_rows(spark, both):
    v, sp = both
    rows = [(1, "Ein Satz, noch einer.\n"), (1, "Ein Satz, noch einer.\n"), (None, "x  y"), (2, None), (3, ""), (4, "word " * 60_000)]
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, ids int, size string").repartition(3)
    out = pieces.decoded(pieces.encoded(d, v), v)
    got = sorted(((r.doc_id, list(r.ids), r.text) for r in out.collect()), key=str)
    assert got == sorted(((i, [*sp.encode(t or ""), 2], sp.decode(sp.encode(t or ""))) for i, t in rows), key=str)
    assert pieces.decoded(pieces.encoded(d.limit(0), v), v).collect() == []
    assert [r.text for r in pieces.decoded(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), v).orderBy("doc_id").collect()] == [None, ""]


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    for change in (lambda m: setattr(m.trainer_spec, "model_type", 1), lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.pieces[300], "type", 4)):
        m = sentencepiece_model_pb2.ModelProto.FromString(open(PATH, "rb").read())
        change(m)
        (tmp_path / "m").write_bytes(m.SerializeToString())
        with pytest.raises(ValueError):
            pieces.vocabulary(str(tmp_path / "m"))
