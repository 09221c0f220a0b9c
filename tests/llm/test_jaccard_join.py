import random
import re

from tessera.llm.components import connected_components
from tessera.llm.jaccard_join import bridge_pairs, hub_pairs, jaccard_components, keep_one, shingle_sets

SCHEMA = "doc_id long, text string, n_shingles string, component_id int"


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), find(i)) for i, *_ in rows if i is not None)


def result(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["É", "x|y"]
    passage = [rng.choice(words) for _ in range(60)]
    rows, texts = [], []
    for _ in range(60):
        t = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 8, 40, 90, 150]))]
        if rng.random() < 0.4:
            t = t[:50] + passage + t[50:]
        texts.append(t)
    base = [rng.choice(words) for _ in range(120)]
    for k in range(60):
        t = list(base)
        for _ in range(k % 9):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(t[: len(t) - k % 4])
    texts += [list(rng.choice(texts)) for _ in range(25)]
    for i, t in enumerate(texts):
        rows.append((1000 - i, rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.2 else w for w in t), "x", 1))
    rows += [(i, t, None, None) for i, t in [(1, None), (2, ""), (3, " \n"), (4, ""), (5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f")]]
    return rows


def test_links_as_brute_force(spark):
    rows = corpus()
    for sent in (1000, 0):
        got = result(jaccard_components(spark.createDataFrame(rows, SCHEMA), sent=sent))
        assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(got)


def test_empty_table(spark):
    assert result(jaccard_components(spark.createDataFrame([], SCHEMA))) == []


def test_one_of_each_group_stays(spark):
    rows = corpus()
    kept = keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "n_shingles", "component_id"]
    want = sorted(i for i, _, c in brute(rows) if i == c)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(3, 3), (None, 4), (7, 5), (5, 7)], "u long, v long")
    got = {r.id: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 10 for i in range(10, 41)}, 5: 5, 7: 5}


def template(rng, count, own, size=200):
    """Documents of one template that each replace a stretch of it by words of their own."""
    base = [f"t{rng.randrange(10**6)}" for _ in range(size)]
    return [base[: size - own] + [f"o{i}_{j}" for j in range(own)] for i in range(count)]


def test_a_template_gives_no_pairs(spark):
    # 196 shingles each, 34 of them own: similarity 0.70, and every list of the template holds all documents.
    rows = [(i, " ".join(t)) for i, t in enumerate(template(random.Random(1), 2000, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    alive = shingle_sets(docs.withColumnRenamed("doc_id", "id"), 5, 80, 3, 1 << 20).where("tokens is not null")
    none = spark.createDataFrame([], "id long, component long")
    assert hub_pairs(alive).count() == 0 and bridge_pairs(alive, none).count() == 0
    assert all(i == c for i, _, c in result(jaccard_components(docs)))


def test_templates_that_link(spark):
    rng, rows = random.Random(3), []
    for own in (4, 14, 16, 17, 18, 20, 30):
        rows += [(len(rows) + k, " ".join(t), "", 0) for k, t in enumerate(template(rng, 40, own))]
    assert result(jaccard_components(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_orders_differ_and_filter(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words[: 8 + i % 20]) for _ in range(60)), "", 0) for i in range(150)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert result(jaccard_components(docs)) == brute(rows)
    alive = shingle_sets(docs.selectExpr("doc_id id", "text"), 5, 80, 3, 1).where("tokens is not null")
    for r in alive.collect():
        half = len(r.marks) // 2
        assert half == 8 * len(r.entries) and (len(r.entries) > len(r.tokens) // 16 or r.marks[:half] != r.marks[half:])


def test_repeated_ids_with_other_texts_and_long_texts(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(7, "a b c d e f g h i j", "", 0), (7, "k l m n o p q", "", 0), (9, "k l m n o p q", "", 0), (3, long, "", 0), (2, long + " end", "", 0), (7, "a b c d e f g h i j", "", 0)]
    got = result(jaccard_components(spark.createDataFrame(rows, SCHEMA)))
    assert got == sorted([(7, 6, 7), (7, 3, 7), (9, 3, 7), (3, 59996, 2), (2, 59997, 2), (7, 6, 7)])
