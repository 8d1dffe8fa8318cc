import random

import pytest

from dialoom.llm import sentencepiece_codec as codec

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    return codec.load()


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(4)
    letters = "abcdefghijklmnoprstuvw  \n.,-_=()[]{}0123456789éüñ日本語▁ \t\"'ABCDEFTHIN 😀"
    odd = ["     a    b\n\n\n   c", "a" * 50, "=" * 77, " " * 37, "-" * 100, "the" * 500, "𝔘nknown \x00", "def foo(x):\n    return x  # no", "<s> </s> <unk>", "x" * 3000]
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(1500)] + odd


def test_equals_the_library_for_the_public_model(model, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=codec.MODEL_PATH)
    assert [x.tolist() for x in model.encode(texts)] == library.encode(texts)


def test_equals_the_library_as_a_unigram_model(model, texts):
    """The same pieces and scores, declared unigram: the plain Viterbi over scores."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    with open(codec.MODEL_PATH, "rb") as file:
        spec.ParseFromString(file.read())
    # Other scores than merge ranks. Segmentations may differ where the library's float32 sums tie; their totals may not.
    draw = random.Random(9)
    for p in spec.pieces:
        if p.type == 1:
            p.score = -len(p.piece) ** 0.5 * 4 - draw.random() * 3
    spec.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
    kinds = {1: "normal", 2: "unknown", 3: "control", 6: "byte"}
    own = codec.Codec([p.piece for p in spec.pieces], [p.score for p in spec.pieces], [kinds[p.type] for p in spec.pieces], False, 0)
    plain = [t for t in texts if all(c.isascii() and c >= " " for c in t)]
    got, want = [x.tolist() for x in own.encode(plain)], library.encode(plain)
    total = lambda ids: sum(spec.pieces[i].score for i in ids)
    assert all(a == b or abs(total(a) - total(b)) < 1e-3 for a, b in zip(got, want))


def test_round_trip_and_edges(spark, model, texts):
    rows = [(i, t, "x") for i, t in enumerate(texts[:200])] + [(900, None, "y"), (901, "", "y"), (902, "again", "z"), (902, "again", "z"), (None, "no id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = codec.round_trip(docs, model).collect()
    assert len(out) == len(rows) and all(r.same for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (900, 901)} == {0}
    assert codec.round_trip(docs.limit(0), model).count() == 0
