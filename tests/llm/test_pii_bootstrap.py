import hashlib
import random
import re

from tessera.llm.pii_bootstrap import extract, redact

KINDS = ("email", "ip", "card", "phone")
RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d)))
    return total % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    return 10 <= len(d) <= 15 if kind == "phone" else True


def base(text):
    out = [(m.start(), i, m.end()) for i, k in enumerate(KINDS) for m in re.finditer(RULES[k], text or "") if good(k, m[0])]
    return [f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(out)]


def corpus():
    rng = random.Random(9)
    bits = ["a@b.co", "x.y@mail-1.example.com", "@", ".", "-", " ", " ", "+", "(", ")", "1", "23", "255", "256", "4111111111111111", "4111 1111 1111 1111", "+1 (017) 555-7713", "10.0.0.1", "é", "😀", "word", "_", "\n", "000", "a.b@c.d_e@f.g", "0042"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))), "x", 1) for i in range(500)]
    return rows + [(600, None, "x", 1), (601, "", "x", 1), (601, "", "x", 1), (None, "a@b.co", "x", 1), (602, "9" * 20_000 + "a" * 20_000 + "@" + "1." * 3000, "x", 1)]


SCHEMA = "doc_id long, text string, spans string, n_ip int"


def test_seeds_as_regular_expressions(spark):
    rows = corpus()
    got = extract(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted(((i, *(sum(x.startswith(k + ":") for x in base(t)) for k in KINDS), hashlib.sha256(",".join(base(t)).encode()).hexdigest()) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got), key=str) == want
    seeds = {i: set(base(t)) for i, t, *_ in rows}
    assert all(seeds[r.doc_id] <= set(r.spans.split(",")) | {""} for r in got)
    assert extract(spark.createDataFrame([], SCHEMA)).collect() == []


def bootstrapped():
    rng = random.Random(3)
    cards = [c for c in (str(rng.randrange(10**15, 10**16)) for _ in range(400)) if luhn(c)]
    rows = [(i, f"Please charge my card {c} today, thanks.", "x", 1) for i, c in enumerate(cards[:30])]
    rows += [(100, "Did you charge my card 4111111111111112 in May?", "x", 1), (101, "The sum of order 4111111111111113 was right.", "x", 1), (102, None, "x", 1)]
    return rows


def test_contexts_of_seeds_reach_unseen_values(spark):
    got = {r.doc_id: r.spans for r in extract(spark.createDataFrame(bootstrapped(), SCHEMA)).collect()}
    assert got[100] == "card:23:39" and got[101] == "" and got[102] == ""


# What follows restates the graph in plain Python.
CANDIDATE = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: ?[\[(]at[\])] ?| at )[A-Za-z0-9-]++(?:(?: ?[\[(]dot[\])] ?| dot )[A-Za-z0-9-]++)++"
    r"|(?<![A-Za-z0-9.@+-])\(?[0-9](?:[ ().-]{0,2}+[0-9])++(?![A-Za-z0-9@])|(?<![A-Za-z0-9._@+-])[A-Za-z._@+-]*+[0-9][A-Za-z0-9._@+-]*+"
)


def shaped(kind, v):
    n, letters = len(re.sub("[^0-9]", "", v)), re.search("[A-Za-z]", v)
    if kind == "email":
        return bool(re.search(r"@|[ )\]]at[ (\[]|[(\[]at[)\]]", v))
    if kind == "ip":
        return bool(re.search(r"^[0-9]{1,3}(?:[ .-]{1,2}[0-9]{1,3}){3}$", v))
    return not letters and (12 <= n <= 19 if kind == "card" else 7 <= n <= 15)


def lower(p, n):
    z, q = 1.96, p / n
    return (q + z * z / (2 * n) - z * (q * (1 - q) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)


def brute_graph(texts, rounds=3):
    """Spans that the graph adds to each text, for texts with short contexts and at most one match of an expression."""
    spans = []
    for t in set(texts):
        seeds = [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in base(t))]
        spans += [(t, s, k, e) for s, k, e in seeds]
        for m in CANDIDATE.finditer(t):
            if (len(re.sub("[^0-9]", "", m[0])) >= 5 or shaped("email", m[0])) and not any(s < m.end() and m.start() < e for s, _, e in seeds):
                spans.append((t, m.start(), 4, m.end()))
    edges, seed = set(), {}
    for t, s, k, e in spans:
        v = t[s:e]
        seed[v] = min(k, seed.get(v, 9))
        b, a = (re.sub("[0-9]", "0", x.lower()).split() for x in (t[:s], t[e:]))
        found = ([("1", b[-1])] if b else []) + ([("2", *b[-2:])] if len(b) > 1 else []) + ([("3", a[0])] if a else []) + ([("4", b[-1], a[0])] if a and b else [])
        edges |= {(p, v) for p in found}
    score = {v: [float(k == i) for i in range(4)] for v, k in seed.items()}
    fit = {v: [k == i or (k == 4 and shaped(KINDS[i], v)) for i in range(4)] for v, k in seed.items()}
    of = {}
    for p, v in edges:
        of.setdefault(p, []).append(v)
    for _ in range(rounds):
        conf = {}
        for p, vs in of.items():
            for i in range(4):
                pos = sum(score[v][i] for v in vs)
                others = [max(score[v][j] for j in range(4) if j != i) for v in vs]
                neg = sum(o for v, o in zip(vs, others, strict=True) if score[v][i] < o)
                if pos >= 5 and lower(pos, pos + neg) >= 0.65 and pos >= 0.05 * sum(fit[v][i] for v in vs):
                    conf[p, i] = lower(pos, pos + neg)
        for v, k in seed.items():
            if k == 4:
                score[v] = [max([conf.get((p, i), 0.0) for p, x in edges if x == v], default=0.0) if fit[v][i] else 0.0 for i in range(4)]
    out = {t: set() for t in texts}
    for t, s, k, e in spans:
        if k == 4 and max(score[t[s:e]]) > 0:
            out[t].add(f"{KINDS[score[t[s:e]].index(max(score[t[s:e]]))]}:{s}:{e}")
    return out


def planted(seed=11):
    """Texts with seeds in a few contexts, identifiers that no rule knows in the same ones, and numbers in others."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))

    def card(valid):
        while luhn(c := "4" + digits(15)) != valid:
            pass
        return c

    seeds = {"email": lambda: f"{word()}@{word()}.org", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), "card": lambda: card(True), "phone": lambda: f"+1 ({digits(3)}) 555-{digits(4)}"}
    unseen = {"email": lambda: f"{word()} at {word()} dot org", "ip": lambda: "-".join(str(rng.randrange(256)) for _ in range(4)), "card": lambda: card(False), "phone": lambda: f"({digits(3)}) 555-{digits(4)}"}
    frames = {"email": "write to: {} soon {}", "ip": "host = <{}> seen {}", "card": "paid by visa no. {} {}", "phone": "{} call {} now"}
    rows, want = [], {}
    for k in KINDS:
        for kind, n in ((seeds, 25), (unseen, 12)):
            for _ in range(n):
                v = kind[k]()
                left, right = frames[k].split("{}", 1) if k != "phone" else (f"{word()} call ", " now")
                t = left + v + right.replace("{}", word())
                rows.append(t)
                if kind is unseen:
                    want[t] = f"{k}:{len(left)}:{len(left) + len(v)}"
    rows += [f"{word()} order {card(False)} {word()}" for _ in range(40)] + [f"invoice {digits(8)} of {word()}" for _ in range(40)] + [f"{word()} meets {word()} at noon" for _ in range(20)]
    return rows, want


def test_planted_identifiers_are_found_and_the_graph_is_the_brute_force_one(spark):
    texts, want = planted()
    texts += texts[:5]
    got = {}
    for r in extract(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)).collect():
        t = texts[r.doc_id]
        found = set(r.spans.split(",")) - set(base(t)) - {""}
        assert got.setdefault(t, found) == found
    assert got == brute_graph(texts)
    right = sum(want.get(t) in found for t, found in got.items() if found)
    assert right >= 0.9 * len(want) and right >= 0.9 * sum(map(len, got.values()))


def test_main_path_is_native(spark):
    plan = extract(spark.createDataFrame(bootstrapped(), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_redaction(spark):
    rows = [*bootstrapped(), (103, "a@1.2.3.4.5 é +1 (017) 555-7713.", "x", 1), (None, "b@c.de", "x", 1), (None, "Did you charge my card 4111111111111112 in May?", "x", 1)]
    for few in (100_000, 0):
        out = redact(spark.createDataFrame(rows, SCHEMA), few=few)
        assert out.columns == ["doc_id", "text", "spans", "n_ip"]
        found = out.collect()
        got = {r.doc_id: r.text for r in found if r.doc_id is not None}
        assert len(found) == len(rows) and got[0] == "Please charge my card <card> today, thanks."
        assert got[100] == "Did you charge my card <card> in May?" and got[101] == rows[-5][1] and got[102] is None
        assert got[103] == "<email> é <phone>." and {r.text for r in found if r.doc_id is None} == {"<email>", got[100]}


def test_redaction_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "b@c.de", 1, 2, 3, 4)], "doc_id long, text string, digest int, added int, base int, every int")
    assert [tuple(r) for r in redact(docs).collect()] == [(1, "<email>", 1, 2, 3, 4)]
