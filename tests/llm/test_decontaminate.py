import hashlib
import random
import re

import pyarrow as pa
import pytest

from tessera.llm import words as words_module
from tessera.llm.decontaminate import contamination, marked, remove_documents, remove_spans, windows
from tessera.llm.words import words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, hit int, doc string, items string", "item_id long, text string, size int"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, width=10):
    found = {}
    for i, t, *_ in items:
        w = WORD.findall(fold(t))
        for k in range(max(len(w) - width + 1, min(len(w), 1))):
            found.setdefault(tuple(w[k : k + width]), set()).add(i)
    out = []
    for i, t, *_ in docs:
        w = WORD.findall(fold(t))
        hit, own = set(), set()
        for size in {len(x) for x in found}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in found:
                    hit |= set(range(k, k + size))
                    own |= found[x]
        names = sorted(str(x) for x in own if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "9", "ß", "中文"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 30])), 1) for i in range(2, 30)]
    items = [(i, t if len(WORD.findall(fold(t))) > 2 else f"{t} only here {i}", s) for i, t, s in items]
    items += [(100, None, 1), (101, "", 1), (102, "?!", 1), (5, items[3][1], 1), (None, text(12), 1), (103, items[0][1], 1), (104, items[0][1].upper(), 1)]
    docs = []
    for i in range(200):
        parts = [text(rng.randrange(20))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            source = rng.choice(items)[1] or ""
            parts += [re.sub(" ", lambda _: rng.choice([" ", ", ", "\n", "-"]), source), text(rng.randrange(4))]
        docs.append((i, " ".join(parts), 1, "x", "y"))
    docs += [(300, None, 1, "x", "y"), (301, "", 1, "x", "y"), (302, "...", 1, "x", "y"), (7, docs[3][1], 1, "x", "y"), (7, docs[3][1], 1, "x", "y"), (None, items[8][1], 1, "x", "y")]
    docs.append((303, text(40_000) + " " + items[9][1] + " " + "z" * 700_000 + " " + text(5), 1, "x", "y"))
    return docs, items


@pytest.mark.parametrize("sent", [200_000, 0])
def test_as_brute_force(spark, sent):
    docs, items = corpus()
    got = contamination(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS), sent=sent)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


@pytest.mark.parametrize("sent", [200_000, 0])
def test_removal(spark, sent):
    items = [(1, "one two three four five six seven eight nine ten eleven", 0)]
    hit = "One, two three\nfour five six seven eight nine TEN eleven"
    rows = [(1, f"é before {hit}. After", 1, "x", "y"), (2, "nothing here", 1, "x", "y"), (3, None, 1, "x", "y"), (4, hit, 1, "x", "y"), (5, "one two three four five six seven eight nine", 1, "x", "y")]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS)
    cut = remove_spans(docs, bench, sent=sent)
    assert cut.columns == docs.columns
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "é before . After", 2: "nothing here", 3: None, 4: "", 5: rows[4][1]}
    assert sorted(r.doc_id for r in remove_documents(docs, bench, sent=sent).collect()) == [2, 3, 5]
    assert sorted(r.doc_id for r in remove_documents(docs, bench, share=0.9, sent=sent).collect()) == [1, 2, 3, 5]
    empty = bench.limit(0)
    assert not any(r.contaminated for r in contamination(docs, empty, sent=sent).collect())
    assert contamination(docs.limit(0), bench, sent=sent).collect() == []
    assert windows(empty).collect() == []
    rows, out = marked(docs, bench, sent=sent)
    assert out == "_hit" and rows.columns == [*docs.columns, "_hit"]


def test_equal_keys_are_no_hits(spark, monkeypatch):
    from tessera.llm import decontaminate

    table = decontaminate.WindowSet([2, 2], ["a b", "c d"], [["1"], ["2"]])
    table.keys[:] = table.keys[0]
    monkeypatch.setattr(words_module, "mixed", lambda x: x)
    monkeypatch.setattr(words_module.Words, "runs", lambda self, size: (words_module.np.arange(len(self.keys) - 1), words_module.np.full(len(self.keys) - 1, table.keys[0])))
    table.near[:] = True
    assert [table.texts[w] for _, w in table.hits(words_of(pa.array(["a b c d e"])), 2)] == ["a b", "c d"]


def test_words_at_cuts(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "B", "9", "é", " ", "-", "中"]) for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", "x" * 500, "y"]
    plain = words_of(pa.array(texts))
    monkeypatch.setattr(words_module, "PIECE", 7)
    words_module._powers.cache_clear()
    cut = words_of(pa.array(texts).slice(0))
    sliced = words_of(pa.array(["zz", *texts]).slice(1))
    words_module._powers.cache_clear()
    for got in (plain, cut, sliced):
        of = [[got.text(i, 1) for i in range(got.first[k], got.first[k + 1])] for k in range(len(texts))]
        assert of == [WORD.findall(fold(t)) for t in texts]
        assert (got.keys == plain.keys).all()
    by = {}
    for i, k in enumerate(plain.keys.tolist()):
        assert by.setdefault(plain.text(i, 1), k) == k
    assert len(set(by.values())) == len(by)
