import random

import public_tokenizers
import pytest
import sentencepiece

from tessera.llm.piece_codec import PieceCodec, decode, digests, encode, refused

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  ", "  a  b ", "a\tb\nc", "▁x ▁", "\0a", "é ñ 中文𝄞 ​", "Is and retitioning ouen the of, nterti",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "<s> </s> <unk> <0x0A>", "réeuxment achlichkeit ciónñdoja 😀😀", "x" * 3000 + "中" * 500,
    "1234567890 3.14159 __init__ ====----====", "der 🎉́̈ ﬁ Å", " " * 40 + "x" + " " * 17, "�",
]


@pytest.fixture(scope="module")
def both():
    return PieceCodec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids(joined):
    return [int(x) for x in joined.split(",")] if joined else []


def test_as_the_library(both):
    ours, library = both
    rng = random.Random(3)
    alphabet = list("abcdefghinorst  ,.\n") + ["é", "ü", "▁", "中", "の", "😀", "the", "ing", "tion", "==", "\t"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(600)]
    for text in texts:
        joined = ours.encode_joined(text)
        assert ids(joined) == library.encode(text), text
        assert ours.decode_joined(joined) == library.decode(library.encode(text)), text


def test_whole_texts_by_backtracking(both):
    ours, library = both
    for text in [t for t in TEXTS if t]:
        assert ours.encode_chunk(library.normalize(text)) == library.encode(text)


def test_operators(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate([*TEXTS, None])] + [(0, "", 1, "x"), (None, "a", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoded = encode(docs, MODEL)
    got = [(r.doc_id, r.ids) for r in encoded.collect()]
    assert got == [(i, library.encode(t or "")) for i, t, *_ in rows]
    assert [(r.doc_id, r.text) for r in decode(encoded, MODEL).collect()] == [(i, library.decode(library.encode(t or ""))) for i, t, *_ in rows]
    assert [r.n_tokens for r in digests(docs, MODEL).collect()] == [len(library.encode(t or "")) for _, t, *_ in rows]
    assert digests(docs.limit(0), MODEL).collect() == []


def test_decode_of_any_ids_as_the_library(both):
    ours, library = both
    rng = random.Random(5)
    odd = [0, 1, 2, *ours.byte_ids.values(), *(library.piece_to_id("▁" * n) for n in (1, 2, 4))]
    for _ in range(20_000):
        some = [rng.choice(odd) if rng.random() < 0.5 else rng.randrange(library.get_piece_size()) for _ in range(rng.randrange(8))]
        assert ours.decode_joined(",".join(map(str, some))) == library.decode(some), some


def test_models_of_other_kinds_are_refused(both):
    def message(number, value):
        return bytes([number << 3 | 2, len(value)]) + value

    def model(kind, *types):
        return b"".join(message(1, message(1, b"a") + bytes([3 << 3, t])) for t in types) + message(2, bytes([3 << 3, kind]))

    assert refused(both[1].serialized_model_proto()) is None and refused(model(2, 1, 2, 3, 6)) is None
    assert "BPE" in refused(model(1, 1)) and "user-defined" in refused(model(2, 1, 4)) and "unused" in refused(model(2, 5))
