import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.packing import Packer, WordTokens, pack
from tessera.llm.queries import PACKING, op5_vector_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_ids_as_the_library():
    ours, lib = WordTokens(PATH), library()
    rng = random.Random(4)
    alphabet = [*"abcXYZ019'-.,!%ªµºß×÷ÉÿžœſΣςİ", "'ll", "'S", " ", " ", "\n", "\t", "\x1c", "\x85", " ", "　", "é", "中", "½", "²", "😀", "<|endoftext|>", "_", "\0", "ﬁ"]
    texts = ["", " ", "It's the Éaielletre's 12.5%", "x" * 5000, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(1500))]
    for text in texts:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text


def check(rows, pieces, tokens, segments, loss, quiet):
    lib = library()
    want = defaultdict(list)
    for i, text, *_ in rows:
        want[i].append([*lib.encode(text or "", add_special_tokens=False).ids, 2])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(want)
    for i, ps in by_doc.items():
        if len(want[i]) > 1:
            assert len(ps) >= len(want[i])
            continue
        ids, at = want[i][0], 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= tokens and len(ps) <= segments
        assert sum(max(0, p.start + p.length - max(p.start, quiet)) for p in ps) <= loss
        padding += 0 if at & (at - 1) == 0 else tokens - at
    return padding / sum(p.length for p in pieces)


def corpus():
    rng = random.Random(6)
    words = ["the", "of", "Ertionnt", "é", "thonble.", "42"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 30, 300, 900]))), "x", 7) for i in range(400)]
    return rows + [(1000, None, "x", 7), (1001, "", "x", 7), (1002, "word " * 20000, "x", 7), (1003, "a", "x", 7), (1003, "a", "x", 7), (None, "b", "x", 7)]


def test_pieces(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, start int")
    assert check(rows, pack(docs, PATH).collect(), 4096, 1024, 4096, 0) < 0.001
    assert pack(docs.limit(0), PATH).collect() == []


def test_all_three_limits_hold(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, start int")
    pieces = pack(docs, PATH, tokens=512, segments=6, loss_tokens=400, quiet=F.lit(20)).collect()
    assert check(rows, pieces, 512, 6, 400, 20) == 0


def test_each_limit_of_the_query_binds(spark):
    by_sequence = defaultdict(list)
    for p in op5_vector_packing(spark, "/root/testdata/sf0.01").collect():
        quiet = int(PACKING["quiet_share"] * p.doc_tokens)
        by_sequence[p.sequence_id].append((p.length, max(0, p.start + p.length - max(p.start, quiet))))
    sums = [(sum(n for n, _ in ps), len(ps), sum(loss for _, loss in ps)) for ps in by_sequence.values()]
    most = tuple(max(s[k] for s in sums) for k in range(3))
    assert most == (PACKING["tokens"], PACKING["segments"], PACKING["loss_tokens"])
    assert all(n == 4096 or n & (n - 1) == 0 for n, _, _ in sums)
    assert len(sums) <= 1.12 * sum(n for n, _, _ in sums) / 4096 + 8 * 12  # each of eight tasks ends in short ones


def test_packer_by_brute_force():
    """Every piece is the example of the largest product among those that fit, from the same pool."""
    rng, limits = random.Random(12), (64, 5, 40)
    packer = Packer(*limits, pool=1000)
    pool = [[k, 0, n := rng.randrange(1, 50), rng.randrange(0, n + 1)] for k in range(300)]
    for k, _, n, q in pool:
        packer.add(k, n, q)
    pieces = defaultdict(list)
    for key, start, length, sequence, offset, _ in packer.rows(True):
        pieces[sequence].append((key, start, length, offset))
    for sequence in sorted(pieces):
        left = [x for x in pool if x[2]]
        total, loud = sum(x[2] for x in left), sum(x[2] - x[3] for x in left)
        limit = 64 if total >= 64 else 1 << total.bit_length() - 1
        rest, rest_loss, at = limit, 40, 0
        for key, start, length, offset in pieces[sequence]:
            fit = [x for x in pool if 0 < x[2] <= rest and x[2] - x[3] <= rest_loss]
            product = lambda x: x[2] / 64 * (total / 64) * (rest / 64) + (x[2] - x[3]) / 40 * (loud / 40) * (rest_loss / 40)  # noqa: E731, B023
            own = next(x for x in pool if x[0] == key)
            assert own[1] == start and offset == at
            if fit:
                assert product(own) >= max(map(product, fit)) - 1e-9 or length < own[2]
            loss = max(0, length - own[3])
            own[1], own[2], own[3] = own[1] + length, own[2] - length, max(0, own[3] - length)
            rest, rest_loss, at = rest - length, rest_loss - loss, at + length
        assert len(pieces[sequence]) <= 5 and rest_loss >= 0 and rest >= 0 and (at == 64 or at & (at - 1) == 0)
    assert all(x[2] == 0 for x in pool)


def test_added_tokens_in_a_text_as_the_unmodified_library(spark):
    start, end = "<|startoftext|>", "<|endoftext|>"
    rng = random.Random(9)
    parts = [start, end, end.upper(), "<|endof", "text|>", "<|", "|>", "<", "a", "It's", " ", "\n", "\t", "\u0301", "é", "中", "12"]
    texts = [end, end + end, start + "a" + end, "The page quotes <|endoftext|> and<|startoftext|>more.", f"e{end}\u0301", *("".join(rng.choices(parts, k=rng.randrange(1, 20))) for _ in range(500))]
    ours, lib = WordTokens(PATH, added=True), Tokenizer.from_file(PATH)
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert {49406, 49407} <= {i for ids in want for i in ids}
    for text, ids in zip(texts, want, strict=True):
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == ids, text
    pieces = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()
    whole = {p.doc_id: (p.doc_tokens, p.ids_crc32) for p in pieces if p.length == p.doc_tokens}
    assert len(whole) > 400
    for i, (n, crc) in whole.items():
        ids = [*want[i], 2]
        assert (n, crc) == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
    assert {p.doc_id: p.doc_tokens for p in pieces} == {i: len(ids) + 1 for i, ids in enumerate(want)}


def test_ids_of_mixed_letters_and_of_blocks(monkeypatch):
    from tessera.llm import packing

    rng, lib = random.Random(5), Tokenizer.from_file(PATH)
    plain = [*"aAbZzéÉßÿ÷×'stredvml0 19  \n\t\r.,!@#", "'s", "'re", "'LL"]
    mixed = [*plain, *"\x0b\x0c\x1c\x85\xa0µªº́你ş̈İ½²😀ﬁ", "<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for letters in (plain, mixed) for _ in range(1500)]
    for block in (packing._BLOCK, 7):
        monkeypatch.setattr(packing, "_BLOCK", block)
        ours = WordTokens(PATH, added=True)
        for text in texts:
            assert np.frombuffer(ours.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, (block, text)
