"""The server source, the search index, job state: each against a plain restatement."""

import json
import math
import random
import threading
import time
from collections import defaultdict
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.operators.nearest import candidates, near_pairs
from tessera.operators.terminology import concepts, nearest_concepts
from tessera.runtime import new_folder, remove_folders
from tessera.sources.sketch import _comparable, merge_sketches, sketch_table
from tessera.sources.server import limit_of, register, write_pages
from tessera.streaming.jobs import COMMANDS, TRANSITIONS, JobProcessor, replay


class Server(BaseHTTPRequestHandler):
    items = [{"conceptId": str(i), "pt": {"term": f"heart {i}" if i % 2 else f"lung {i}"}} for i in range(2500)]
    failures: dict = defaultdict(int)
    asked: list = []

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        Server.asked.append(q)
        Server.failures[self.path] += 1
        if Server.failures[self.path] == 1:  # each address fails once
            self.send_error(503)
            return
        found = [x for x in self.items if q.get("term", "") in json.dumps(x)]
        at, n = int(q["offset"]), int(q["limit"])
        body = json.dumps({"items": found[at : at + n], "total": len(found)}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture
def server():
    http = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/MAIN/concepts"
    http.shutdown()


def test_server_is_read_in_pages_and_asked_again(spark, server):
    register(spark)
    load = lambda **o: spark.read.format("terminology").options(url=server, pause="0.01", **o).load()
    every = load(page="400", pages_per_task="2")
    assert every.rdd.getNumPartitions() == 4
    rows = sorted(concepts(every).collect())
    assert rows == sorted((x["conceptId"], x["pt"]["term"]) for x in Server.items)
    assert sorted(r.position for r in every.collect()) == list(range(2500))
    assert load(term="heart").count() == 1000 and load(term="heart 1").count() == 36 and load(term="heart", limit="7").count() == 7
    assert max(int(q["limit"]) for q in Server.asked) == 1000 and limit_of("a") == 1000 and limit_of("a b") == 36
    with pytest.raises(Exception, match="url or a path"):
        spark.read.format("terminology").load().count()


def test_pages_are_kept_and_read_again(spark):
    register(spark)
    rows = [(i, json.dumps({"conceptId": str(i), "term": f"é \"{i}\" lung" if i % 3 else f"heart {i}"})) for i in range(250)] + [(250, None)]
    at = new_folder(spark, "pages")
    write_pages(spark.createDataFrame(rows, "position long, item string").repartition(5), at, page=40)
    every = spark.read.format("terminology").option("path", at).option("pages_per_task", 3).load()
    assert every.rdd.getNumPartitions() == 3
    assert {(r.position, json.loads(r.item)["term"]) for r in every.collect()} == {(i, json.loads(x)["term"]) for i, x in rows if x}
    few = spark.read.format("terminology").options(path=at, term="heart", limit="5").load()
    assert sorted(json.loads(r.item)["term"] for r in few.collect()) == sorted(f"heart {i}" for i in range(0, 15, 3))
    assert remove_folders(spark) >= 1


def test_near_pairs_as_brute_force(spark):
    rng = random.Random(6)

    def vector():
        cells = {min(int(rng.expovariate(0.08)), 90): rng.random() for _ in range(rng.randrange(1, 12))}
        norm = math.sqrt(sum(w * w for w in cells.values()))
        return {i: w / norm for i, w in cells.items()}

    q, d = [vector() for _ in range(80)], [vector() for _ in range(400)]
    d += [d[0]] * 150 + [dict(q[3])]  # a hot vector
    rows = lambda vs, k: spark.createDataFrame([(n, i, w) for n, v in enumerate(vs) for i, w in v.items()], f"{k} int, idx int, w double")
    for least in (0.3, 0.65, 0.95):
        want = {(a, b): s for a, x in enumerate(q) for b, y in enumerate(d) if (s := sum(w * y.get(i, 0) for i, w in x.items())) > least}
        got = {(r.q, r.d): r.sim for r in near_pairs(rows(q, "q"), rows(d, "d"), least).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        met = candidates(rows(q, "q"), rows(d, "d"), least).count()
        assert len(want) <= met < (0.5 if least > 0.6 else 1) * len(q) * len(d)


def test_candidates_do_not_grow_with_far_concepts(spark):
    """A hundred times the dictionary, of other words: the pairs that fetch their vectors stay about as many."""
    from tessera.functions.vectors import sparse_value_vectors

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(5, 10)))
    labels = [f"{word()} {word()}" for _ in range(60)]
    asked = [f"{x}s" for x in labels[:20]]
    other = [f"{word()} {word()}" for _ in range(5940)]
    vectors = lambda texts, k: sparse_value_vectors(spark.createDataFrame([(t, [t]) for t in texts], f"{k} string, v array<string>"), [k], "v")
    small = candidates(vectors(asked, "q"), vectors(labels, "d"), 0.65).count()
    large = candidates(vectors(asked, "q"), vectors(labels + other, "d"), 0.65).count()
    assert 20 <= small <= large < 3 * small
    found = nearest_concepts(spark.createDataFrame([(t,) for t in asked], "query string"), spark.createDataFrame([(i, t) for i, t in enumerate(labels + other)] + [(9999, labels[0]), (None, None)], "concept_id long, label string"))
    assert {r.query: r.concept_id for r in found.collect()} == {t: i for i, t in enumerate(asked)}


def test_free_text_stays_out_of_sketches(spark):
    """A column with a long text is known by lengths; parts of it without one give nothing away once merged."""
    rows = [("x" * 201, "b", None), ("a", "a", None), (None, "\u00fc" * 200, None), ("\U0001f600" * 200, "b", None)]
    df = spark.createDataFrame(rows, "long string, short string, none string").repartition(4)
    parts = sketch_table(df, "t.csv", "n")
    assert all(r.least == [] for r in parts.where("longest > 200").collect())
    got = {r.column: (r.n, r.nulls, r.longest, r.least) for r in merge_sketches(parts).collect()}
    assert got == {"long": (4, 1, 201, []), "short": (4, 0, 200, ["a", "b", "\u00fc" * 200]), "none": (4, 4, None, [])}
    sent = df.select(_comparable("long", "text")).where("long is not null").select("long.short", "long.n").collect()
    assert sorted((r.n, r.short) for r in sent) == [(1, "a"), (200, "\U0001f600" * 200), (201, None)]


def plain(idle_ms, files):
    """What the processor should say, command by command; ``files`` are the batches. Timers see the watermark of the batch
    before, and a last batch without rows sees that of all."""
    jobs, out, watermark = {}, [], 0
    ms = lambda t: int(t.timestamp() * 1000)
    for batch in [*files, []]:
        for job, seq, ts, op, percent, message in sorted(batch, key=lambda c: c[1]):
            j = jobs.get(job)
            if op == "create" and j is None:
                j = jobs[job] = {"state": "QUEUED", "percent": 0, "heard": 0}
            elif j is None:
                continue
            elif op == "start":
                j["state"], j["percent"] = "RUNNING", max(1, j["percent"])
            elif op == "update":
                j["percent"] = j["percent"] if percent is None else max(0, min(100, percent))
            elif op == "fail":
                j["state"] = "FAILED"
            elif op == "complete":
                j["state"], j["percent"], j["result"] = "DONE", 100, message or ""
            elif op == "read" and j["state"] == "DONE":
                out.append((job, seq, "CLEARED", 100, j["result"]))
                del jobs[job]
                continue
            else:
                j["heard"] = max(j["heard"], ms(ts))
                continue
            j["heard"] = max(j["heard"], ms(ts))
            out.append((job, seq, j["state"], j["percent"], None))
        for job in [k for k, j in jobs.items() if j["heard"] + idle_ms < watermark]:
            out.append((job, None, "EXPIRED", jobs.pop(job)["percent"], None))
        watermark = max([watermark, *(ms(c[2]) for c in batch)])
    return sorted(out, key=str)


def test_jobs_command_by_command(spark, tmp_path):
    rng, start = random.Random(4), datetime(2024, 1, 1)
    ops, files, seq = ["create", "create", "start", "update", "update", "fail", "complete", "read", "read", "odd"], [], 0
    for k in range(4):
        batch = []
        for _ in range(60):
            seq += 1
            job = "hot" if rng.random() < 0.3 else f"j{rng.randrange(k * 6, k * 6 + 12)}"
            batch.append((job, seq, start + timedelta(minutes=20 * k, seconds=seq), rng.choice(ops), rng.choice([None, -5, 40, 130]), rng.choice([None, "m"])))
        files.append(batch)
        spark.createDataFrame([*batch, (None, 1, start, "create", 1, "x")], COMMANDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    replay(spark, str(tmp_path / "in"), str(tmp_path / "job"), idle_ms=15 * 60_000).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "job" / "out")).collect()
    got = sorted(((r.job_id, r.seq, r.state, r.percent, r.result) for r in rows), key=str)
    assert got == plain(15 * 60_000, files)
    assert {"EXPIRED", "CLEARED", "DONE", "FAILED"} <= {r.state for r in rows}
    assert all(r.message.startswith("Last ") for r in rows if r.state == "EXPIRED")


class Held:
    """A state or a handle that counts what it is asked for."""

    def __init__(self, calls):
        self.calls, self.held = calls, None

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name in ("getValueState", "getListState"):
                return Held(self.calls)
            if name == "put" or name == "update" or name == "clear":
                self.held = args[0] if args else None
            return {"exists": self.held is not None, "get": self.held, "listTimers": []}.get(name)

        return call


def test_a_jobs_batch_asks_the_state_a_few_times():
    calls, ops = [], ["create", "start", "complete", "read"]
    job = JobProcessor(1000)
    job.init(Held(calls))
    commands = [Row(job_id="a", seq=i, op=ops[i % 4], percent=None, message="m", ms=i) for i in range(403)]
    calls.clear()
    out = list(job.handleInputRows(("a",), iter(reversed(commands)), None))
    assert [r.seq for r in out] == list(range(403)) and [r.result for r in out if r.state == "CLEARED"] == ["m"] * 100
    assert out[-1].state == "DONE" and len(calls) <= 8 and job.result.held == ("m",) and len(job.messages.held) == 3
    (again,) = job.handleInputRows(("a",), iter([Row(job_id="a", seq=403, op="read", percent=None, message=None, ms=403)]), None)
    assert (again.state, again.result) == ("CLEARED", "m") and job.now.held is None and job.result.held is None and job.messages.held is None


def test_jobs_by_the_servers_clock(spark, tmp_path):
    """Messages have a time to live then, and what is read is given once."""
    start = datetime(2024, 1, 1)
    rows = [("a", i, start, op, None, m) for i, (op, m) in enumerate([("create", None), ("start", None), ("complete", "the result"), ("read", None), ("read", None)])]
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, COMMANDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run, until, got = replay(spark, str(tmp_path / "in"), str(tmp_path / "job"), clock="processing"), time.time() + 60, []
    try:
        while len(got) < 4 and time.time() < until and run.isActive:
            time.sleep(1)
            if (tmp_path / "job" / "out" / "_spark_metadata").exists():
                rows = spark.read.schema(TRANSITIONS).parquet(str(tmp_path / "job" / "out"))
                got = sorted((r.seq, r.state, r.result) for r in rows.collect())
    finally:
        run.stop()
    assert got == [(0, "QUEUED", None), (1, "RUNNING", None), (2, "DONE", None), (3, "CLEARED", "the result")]
