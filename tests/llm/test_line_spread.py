import random

from tessera.llm.line_spread import boilerplate, remove_boilerplate, strip_boilerplate

SCHEMA = "doc_id long, text string, source string, n_lines int, line string"


def corpus():
    rng = random.Random(2)
    common = [f"common line {i}" for i in range(12)]
    rows = []
    for i in range(300):
        lines = [f"own {rng.randrange(500)}" for _ in range(rng.randrange(6))] + rng.sample(common, rng.randrange(4)) + [""] * rng.randrange(2)
        rng.shuffle(lines)
        site = f"s{i % 3}" if i % 3 == 0 else f"s{rng.randrange(30)}"
        rows.append((1000 - i, "\n".join(f" {x} " if rng.random() < 0.1 else x for x in lines), site, 1, "x"))
    rows += [(5, None, "s1", 1, "x"), (6, "", "s2", 1, "x"), (7, common[0], None, 1, "x"), (7, common[0], None, 1, "x"), (9, "x" * 100_000 + "\n" + common[1], "s3", 1, "x")]
    rows += [(None, f"{common[2]}\nonly here", "s4", 1, "x"), (None, common[2], None, 1, "x"), (8, f"{common[3]}\na", "s1", 1, "x"), (8, f"{common[3]}\nb", "s1", 1, "x"), (None, None, "s1", 1, "x")]
    return rows


def brute(rows, least):
    sites, first = {}, {}
    for i, t, s, *_ in rows:
        for x in {y.strip(" ") for y in (t or "").split("\n")} - {""}:
            sites.setdefault(x, set()).add(s)
            if i is not None:
                first[x] = min(i, first.get(x, i))
    bad = {x for x, s in sites.items() if len(s - {None}) >= least}
    out = []
    for i, t, *_ in rows:
        lines = None if t is None else t.split("\n")
        kept = lines and [x for x in lines if x.strip(" ") not in bad or (i is not None and first[x.strip(" ")] == i)]
        out.append((i, None if t is None else "\n".join(kept), len(lines or []), len(lines or []) - len(kept or [])))
    return sorted(out, key=str), len(bad)


def test_both_ways_as_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    for least in (4, 10):
        want, n_bad = brute(rows, least)
        assert n_bad > 5
        assert boilerplate(docs, least).count() == n_bad
        for sent in (200_000, 0):
            got = sorted((tuple(r) for r in remove_boilerplate(docs, least, sent=sent).collect()), key=str)
            assert got == want
            kept = strip_boilerplate(docs, least, sent=sent)
            assert kept.columns == docs.columns
            assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((i, t) for i, t, *_ in want), key=str)


def test_empty_table_and_null_id(spark):
    docs = spark.createDataFrame([(None, "a\nb", "s")], "doc_id long, text string, source string")
    assert [tuple(r) for r in remove_boilerplate(docs, 2).collect()] == [(None, "a\nb", 2, 0)]
    assert remove_boilerplate(docs.limit(0), 2).collect() == []


def test_null_id_both_ways(spark):
    rows = [(i, f"common\nown {i}", f"s{i}") for i in range(12)] + [(None, "common\nz", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for sent in (200_000, 0):
        assert ("z", 2, 1) in [tuple(r)[1:] for r in remove_boilerplate(docs, 10, sent=sent).collect() if r.doc_id is None]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "common\nx", f"s{i}", 1, 2, 3, 4) for i in range(12)], "doc_id long, text string, source string, doc int, hits int, line int, stripped int")
    for sent in (200_000, 0):
        out = strip_boilerplate(docs, 10, sent=sent)
        assert out.columns == docs.columns and sorted(r.text for r in out.collect()) == [""] * 11 + ["common\nx"]
