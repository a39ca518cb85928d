import difflib
import http.client
import http.server
import io
import json
import pickle
import re
import threading
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from findmill.functions import text as X
from findmill.functions.recover import recovered_json
from findmill.operators import chunks as C
from findmill.operators import findings as D
from findmill.operators import rollup as A
from findmill.operators.inference import HttpBackend, ReplayBackend, ask, endpoint_candidates, in_container, resolve_endpoint
from findmill.operators.report import json_rows, make_patch, report_rows, with_content, write_patches
from findmill.sources.sinks import write_document, write_files

FULL = {"title": "t", "severity": "High", "line": 3, "description": "d", "fix": "f"}


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    "text, wanted",
    [("critical!", "Critical"), ("HIGH", "High"), ("Medium-High", "High"), ("moderate", "Low"), ("N/A", "Low"), (None, "Low")],
)
def test_severity(spark, text, wanted):
    assert one(spark, X.severity, text) == wanted


@pytest.mark.parametrize("text, wanted", [("-1", 1), ("10.0", 100), ("L10-12", 1012), ("N/A", None), ("0", None), (None, None)])
def test_digits(spark, text, wanted):
    assert one(spark, X.digits, text) == wanted


@pytest.mark.parametrize("name, wanted", [(".env", ""), ("Dockerfile", ""), ("a.b.c", "c"), ("UPPER.PY", "PY"), ("..x.py", "py")])
def test_extension(spark, name, wanted):
    assert one(spark, X.extension, name) == wanted


@pytest.mark.parametrize(
    "text, wanted",
    [
        ('[{"a":1}]', '[{"a":1}]'), ('x [{"a":1}] y', '[{"a":1}]'), ('x {"a":1} y', '{"a":1}'), ('```json\n[1]\n```', "[1]"),
        ("null", None), ("oops", None), ('{"a":1} and {"b":2}', None), ("[1] [2]", None), ('{"a":1}],[', '{"a":1}'), (None, None), ("", None),
    ],
)
def test_recovery(spark, text, wanted):
    found = one(spark, recovered_json, text)
    assert (found and found.strip()) == wanted


def scored(spark, obj, path="a/x.py"):
    raw = spark.createDataFrame([(path, json.dumps(obj))], "filepath string, raw string")
    return D.findings(raw).collect()


@pytest.mark.parametrize(
    "obj, path, confidence, line",
    [
        ({"message": "fine"}, "x.py", 60.0, None),
        (FULL, "x.py", 100.0, 3),
        ({**FULL, "line": 0}, "x.py", 84.0, None),
        ({**FULL, "description": "It seems bad"}, "x.py", 85.0, 3),
        ({**FULL, "confidence": 80}, "x.py", 90.0, 3),
        ({**FULL, "confidence": "80"}, "x.py", 100.0, 3),
        ({**FULL, "type": "SQL Injection (SQLi)"}, "x.css", 40.0, 3),
        ({**FULL, "type": "Resource Loading"}, "x.json", 70.0, 3),
        ({**FULL, "line": -1, "severity": "N/A", "confidence": 100}, "x.py", 95.0, 1),
        ({**FULL, "description": "potentially", "confidence": 80}, "x.py", 82.5, 3),
        ({"vulnerabilities": [FULL]}, "x.py", 60.0, None),
    ],
)
def test_confidence(spark, obj, path, confidence, line):
    (row,) = scored(spark, obj, path)
    assert (row.confidence, row.line) == (confidence, line)


def test_defaults_and_lists(spark):
    rows = scored(spark, [FULL, 5, {"title": None, "line": 10.0, "reasoning": {"cve_refs": ["CVE-1"], "pattern": "p"}}])
    assert [r.response_pos for r in rows] == [0, 2]
    assert rows[1].degraded and rows[1].title == "Vulnérabilité Inconnue" and rows[1].line == 100
    assert rows[1].reasoning.cve_refs == ["CVE-1"] and rows[1].reasoning.mitigation_priority == "Low"
    assert scored(spark, "text") == []


def test_opt_in_rules(spark):
    raw = spark.createDataFrame([("x.py", json.dumps({"issues": [FULL, FULL]})), ("y.py", json.dumps({"message": "fine"}))], "filepath string, raw string")
    found = D.findings(raw, unwrap="issues")
    assert found.count() == 3 and D.findings(raw).count() == 2
    assert D.drop_non_findings(found).count() == 2
    assert D.drop_overlap_repeats(found).count() == 2


def test_snippets(spark):
    raw = spark.createDataFrame([(f, json.dumps([{**FULL, "line": n, **more}])) for f, n, more in (("a.py", 2, {}), ("a.py", 0, {}), ("a.py", 2, {"snippet": "own"}), ("gone.py", 1, {}), ("a.py", 99, {}))], "filepath string, raw string")
    files = spark.createDataFrame([("a.py", "one\ntwo\n")], "path string, content string")
    found = sorted(r.snippet for r in D.with_snippets(D.findings(raw), files).collect())
    none = "Code non disponible"
    assert found == sorted(["   1: one\n>> 2: two", none, "own", "Impossible d'extraire le contexte : gone.py", none])


def test_snippets_by_blocks_equal_whole_files(spark):
    """Findings on every line of files around the size of a block, and beyond: as if each read its file alone."""
    texts = {f"f{n}{end!r}": "\n".join(f"l{i}" for i in range(n)) + end for n in (1, 5, 63, 64, 65, 69, 70, 128, 129, 200) for end in ("", "\n", "\n\n")} | {"empty": "", "feed": "\n"}
    rows = [(f, n, "Code non disponible") for f, t in texts.items() for n in [*range(1, t.count("\n") + 9), 10**12]] + [("hot", n % 500 + 1, "Code non disponible") for n in range(3000)]
    texts["hot"] = "x\n" * 480
    rows += [(None, 1, "Code non disponible"), ("gone", None, "Code non disponible"), ("f5''", 2, None)]
    found = spark.createDataFrame([(f, n, s, 7, 8) for f, n, s in rows], "filepath string, line long, snippet string, block int, lines int")
    files = spark.createDataFrame([*texts.items(), ("null", None)], "path string, content string")
    made = D.with_snippets(found, files)
    assert made.columns == found.columns

    def want(f, n, s):
        if s is None or n is None:
            return s
        if f not in texts:
            return f"Impossible d'extraire le contexte : {f or ''}"
        lines = texts[f].removesuffix("\n").split("\n")
        return "\n".join(f"{'>> ' if i == n else '   '}{i}: {lines[i - 1]}" for i in range(max(1, n - 5), min(len(lines), n + 5) + 1)) or s

    assert sorted((str(r.filepath), r.line or 0, str(r.snippet)) for r in made.collect()) == sorted((str(f), n or 0, str(want(f, n, s))) for f, n, s in rows)


def test_snippets_deal_contents_once(spark):
    """Where nothing is broadcast contents are dealt as blocks, once: not whole before, and not with the findings after."""
    texts = {f"f{n}": "\n".join(f"l{i}" for i in range(n)) for n in (1, 70, 200)} | {"empty": ""}
    rows = [(f, n, "Code non disponible") for f in ("f1", "f70", "empty", "null", "gone") for n in (1, 66, 10**12, None)] + [("f70", 1, "own"), ("f200", 1, "own"), (None, 2, "Code non disponible")]
    found = spark.createDataFrame(rows, "filepath string, line long, snippet string")
    files = spark.createDataFrame([*texts.items(), ("null", None)], "path string, content string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        made = D.with_snippets(found, files)
        with redirect_stdout(io.StringIO()) as plan:
            made.explain("formatted")
        got = made.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: (.*)$", plan.getvalue(), re.M)
    assert len(dealt) >= 4 and len([x for x in dealt if "content#" in x or "lines#" in x]) == 1, dealt
    none = "Code non disponible"
    lines = lambda first, last, at: "\n".join(f"{'>> ' if i == at else '   '}{i}: l{i - 1}" for i in range(first, last + 1))
    shown = {("f1", 1): ">> 1: l0", ("f70", 1): lines(1, 6, 1), ("f70", 66): lines(61, 70, 66), ("empty", 1): ">> 1: "}
    want = {(f, n, shown.get((f, n), none)) for f in ("f1", "f70", "empty", "null") for n in (1, 66, 10**12, None)}
    want |= {("gone", n, "Impossible d'extraire le contexte : gone") for n in (1, 66, 10**12)} | {("gone", None, none)}
    want |= {("f70", 1, "own"), ("f200", 1, "own"), (None, 2, "Impossible d'extraire le contexte : ")}
    assert len(got) == len(rows) and {(r.filepath, r.line, r.snippet) for r in got} == want


def test_few_findings_move_few_contents(spark, tmp_path):
    """Contents are cut down to the paths that are asked for before they are dealt."""
    spark.range(2000).selectExpr("concat('p/', id % 50, '/', id) AS path", "concat('n', id % 100) AS file", "repeat('text ', 200) || id AS content").write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    rows = [(1, "p/7/7", "n7"), (2, "gone", "n8"), (3, "gone", "none"), (4, "p/7/7", "n7"), (5, None, "n9")]
    found = spark.createDataFrame(rows, "id int, filepath string, file string").withColumn("content", F.lit("old")).drop("content")
    made = with_content(found, files)
    got = {r.id: r.content and r.content.split(" ")[-1] for r in made.collect()}
    assert got == {1: "7", 2: "1008", 3: None, 4: "7", 5: "1009"}
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    with_text = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "content" in x]
    assert not with_text, plan


def test_selection_and_ids(spark):
    raw = spark.createDataFrame([("r", f"{f}.py", c, json.dumps([FULL] * 5)) for f in "ba" for c in (0, 1)], "run_id string, filepath string, chunk_idx int, raw string")
    best = D.assign_ids(D.select_findings(D.findings(raw), "rapid"))
    rows = best.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, 13))
    assert [r.response_pos for r in rows] == [0, 1, 2] * 4 and rows[0].filepath == "a.py"
    summary = A.run_summary(best).first()
    assert (summary.high, summary.critical, summary.score, summary.confidence_score) == (12, 0, -20, 100.0)
    empty = A.run_summary(best.where("false")).first()
    assert (empty.high, empty.score, empty.confidence_score) == (0, 100, 0.0)
    assert json_rows(best).count() == 12
    report = [r.html for r in report_rows(best.withColumn("title", F.lit("<b>"))).orderBy("id").collect()]
    assert report[0] == "<h1>Findings: 12</h1>" and "&lt;b&gt;" in report[1]


def test_ids_over_ranges(spark):
    """One run with most rows, one file with most of those, repeated rows, a null run and an empty table."""
    rows = [("a", "hot", i % 400) for i in range(900)] + [("a", f"f{i}", 0) for i in range(50)] + [("b", "x", 1)] * 3 + [(None, "y", i) for i in range(5)]
    given = spark.createDataFrame(rows, "run_id string, filepath string, n int").repartition(7)
    made = D.assign_ids(given, order=("filepath", "n")).collect()
    for run in ("a", "b", None):
        own = sorted((r for r in made if r.run_id == run), key=lambda r: r.id)
        assert [r.id for r in own] == list(range(1, len(own) + 1))
        assert [(r.filepath, r.n) for r in own] == sorted((f, n) for x, f, n in rows if x == run)
    assert D.assign_ids(given.where("false"), order=("filepath", "n")).count() == 0


@pytest.mark.parametrize("size, wanted", [(0, 0), (1, 1), (11500, 1), (11501, 2), (12000, 2), (23001, 3)])
def test_chunk_counts_and_reassembly(spark, size, wanted):
    text = "".join(chr(97 + i % 26) for i in range(size))
    parts = C.chunks(spark.createDataFrame([("f", text)], "file string, content string"), 12000).orderBy("chunk_idx").collect()
    assert len(parts) == wanted
    whole = ""
    for p in parts:
        whole += p.chunk if not whole else p.chunk[500:]
    assert whole == text


def test_context(spark):
    def shown(n, line):
        df = spark.createDataFrame([("\n".join(f"l{i}" for i in range(1, n + 1)) + "\n", line)], "c string, n int")
        return df.select(C.context(F.col("c"), F.col("n"))).first()[0]

    assert shown(2, 9) == ""
    lines = shown(20, 3).split("\n")
    assert len(lines) == 8 and lines[2] == ">> 3: l3" and lines[0] == "   1: l1"


def test_search_facets_top(spark):
    df = spark.createDataFrame([(1, "Low", "Alpha", 12), (2, "Critical", None, None), (3, "High", "beta", 0)], "id int, severity string, title string, line int")
    assert [r.id for r in A.search(df, "ALPH", ("title",)).collect()] == [1]
    assert [r.id for r in A.search(df, "12", ("title",)).collect()] == [1]
    assert A.search(df, "").count() == 3 and A.facets(df, severity=()).count() == 3
    assert [r.id for r in A.facets(df, severity=("Low", "High")).orderBy("id").collect()] == [1, 3]
    assert [r.id for r in A.top_priority(df).collect()] == [2, 3, 1]
    assert A.tail(spark.range(600), "id").count() == 501


def test_patch():
    made = make_patch("a.py", "x\n    y\nz\n", 2, "  q\n r")
    assert made["ok"] and made["before"] == "    y" and made["after"] == "    q\n    r"
    assert "-    y\n+    q\n+    r\n" in made["diff"] and "\n\n" not in made["diff"]
    assert make_patch("a", "x", 5, "q")["error"] and make_patch("a", None, 1, "q")["error"] and make_patch("a", "x", 1, " ")["error"]


@pytest.mark.parametrize(
    "content, line, fix",
    [
        ("x\fy\nz\n", 2, "q"), ("a\u2028b\nc\x85d\ne", 2, "q"), ("a\n\nb\n", 2, "q"), ("a\n  \t\nb\n", 2, "q  \n r "), ("\tx\ny", 1, "q\r\nr"),
        ("a\nb\nc\n", 2, "b"), ("a\nb\nc\n", 2, "n\nb"), ("a\nb\nc\n", 2, "b\nn"), ("a\nb\nc\n", 2, "m\nb\nn"), ("only", 1, "q\nr"), ("x\n" * 300 + "y", 150, "q"),
    ],
)
def test_patch_splits_and_indents_as_lines_are_read(content, line, fix):
    """Against the standard library's diff of the lines that reading the file gives."""
    lines = list(io.StringIO(content, newline="\n"))
    old = lines[line - 1]
    new = [" " * (len(old) - len(old.lstrip())) + x.lstrip() + "\n" for x in fix.strip().split("\n")]
    want = difflib.unified_diff(lines, [*lines[: line - 1], *new, *lines[line:]], "a/f", "b/f")
    want = "".join(x if x.endswith("\n") else f"{x}\n\\ No newline at end of file\n" for x in want)
    made = make_patch("f", content, line, fix)
    assert (made["ok"], made["diff"], made["before"], made["after"] + "\n") == (True, want, old.removesuffix("\n"), "".join(new))


@pytest.mark.parametrize("fault", [ValueError("json"), http.client.IncompleteRead(b""), AttributeError("list"), RuntimeError("any")])
def test_any_fault_of_a_backend_is_a_failed_call(fault):
    class Broken:
        def call(self, model, prompt, timeout):
            raise fault

    assert ask(Broken(), "m", "p", lambda s: None) == ("failed", None, "m")
    assert ask(ReplayBackend(lambda p: {"a": 1}), "m", "p", lambda s: None)[0] == "failed"


def test_a_fence_holds_a_list_or_an_object(spark):
    assert ask(ReplayBackend(lambda p: "x\n```json\n5\n```"), "m", "p", lambda s: None)[0] == "failed"
    assert one(spark, recovered_json, "x\n```json\n5\n```") is None


def test_ask_retries_and_falls_back():
    calls = []

    class Flaky:
        def call(self, model, prompt, timeout):
            calls.append((model, timeout))
            if len(calls) < 4:
                raise OSError
            return "{}"

    pauses = []
    assert ask(Flaky(), "qwen2.5-coder:14b", "p" * 20000, pauses.append) == ("ok", "{}", "deepseek-coder:6.7b")
    assert pauses == [2.0, 4.0] and calls[0] == ("qwen2.5-coder:14b", 200)
    for useless in ("none", "null", "[broken", ""):
        assert ask(ReplayBackend(lambda p: useless), "m", "p", pauses.append)[0] == "failed"
    assert ask(ReplayBackend(lambda p: 'so: {"a": 1}.'), "m", "p", pauses.append)[0] == "ok"


class Server:
    """A model server in a thread: notes connections and requests, closes or refuses when told to."""

    def __init__(self, status=200, close_after=None):
        self.peers, self.bodies = set(), []
        owner = self

        class Handler(http.server.BaseHTTPRequestHandler):
            protocol_version = "HTTP/1.1"

            def do_POST(self):
                owner.peers.add(self.client_address)
                owner.bodies.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
                data = json.dumps({"response": f"[{len(owner.bodies)}]"}).encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)
                if len(owner.bodies) == close_after:
                    self.close_connection = True  # without telling

            def log_message(self, *args):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.server.server_address[1]}/api/generate"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def __enter__(self):
        return self

    def __exit__(self, *args):
        self.server.shutdown()


def test_a_backend_keeps_its_connection():
    with Server() as server:
        backend = HttpBackend(server.url, 8192, num_thread=8)
        assert [backend.call("m", f"p{i}", 5) for i in range(4)] == ["[1]", "[2]", "[3]", "[4]"]
        assert len(server.peers) == 1 and server.bodies[0] == {"model": "m", "prompt": "p0", "stream": False, "format": "json", "options": {"num_ctx": 8192, "temperature": 0.1, "num_thread": 8}}
        other = pickle.loads(pickle.dumps(backend))
        assert other.call("m", "x", 5) == "[5]" and len(server.peers) == 2
    with Server(close_after=2) as server:
        backend = HttpBackend(server.url, 1)
        assert [backend.call("m", "p", 5) for _ in range(4)] == ["[1]", "[2]", "[3]", "[4]"] and len(server.peers) == 2
    with Server(status=500) as server:
        with pytest.raises(OSError):
            HttpBackend(server.url, 1).call("m", "p", 5)


def test_endpoint_resolution(monkeypatch, tmp_path):
    monkeypatch.delenv("OLLAMA_URL", raising=False)
    assert resolve_endpoint("http://given", [], "http://default") == "http://given"
    nowhere = "http://127.0.0.1:9/"
    assert resolve_endpoint(None, [nowhere], "http://default", timeout=0.2, pause=0) == "http://default"
    with Server(status=404) as wrong, Server() as right:
        assert resolve_endpoint(None, [nowhere, wrong.url, right.url], timeout=2, pause=0) == right.url
        assert len(wrong.bodies) == 2 and right.bodies[0]["prompt"] == "ping"
    monkeypatch.setenv("OLLAMA_URL", "http://env")
    assert resolve_endpoint() == "http://env" and resolve_endpoint("http://given") == "http://given"
    (tmp_path / "groups").write_text("0::/system.slice/docker-1.scope")
    assert in_container(str(tmp_path / "groups"), "") and in_container("", str(tmp_path / "groups"))
    (tmp_path / "groups").write_text("0::/init.scope")
    assert not in_container("", str(tmp_path / "groups")) and not in_container("", str(tmp_path / "none"))
    assert endpoint_candidates(True)[0] != endpoint_candidates(False)[0] and endpoint_candidates(True)[-2:] == endpoint_candidates(False)[-2:]


def test_patch_files(spark, tmp_path):
    df = spark.createDataFrame([(1, True, "--- a\n+++ b\n"), (2, False, None), (30, True, "é\n")], "id long, ok boolean, diff string")
    write_patches(df, str(tmp_path / "p"))
    assert {x.name: x.read_text() for x in (tmp_path / "p").iterdir()} == {"patch_1.patch": "--- a\n+++ b\n", "patch_30.patch": "é\n"}
    write_patches(df.where("id = 30"), str(tmp_path / "p"))
    assert [x.name for x in (tmp_path / "p").iterdir()] == ["patch_30.patch"]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    """A sink shows nothing until all is written, and a failure leaves what was there before."""
    rows = spark.range(60).repartition(6)
    wrong = F.when(F.col("id") == 42, F.raise_error(F.lit("no"))).otherwise(F.concat(F.lit("text "), F.col("id").cast("string")))
    for write, good in (
        (write_files, rows.select(F.concat(F.lit("a/f"), F.col("id").cast("string")).alias("name"), F.col("id").cast("string").alias("content"))),
        (write_document, rows.select("id", F.concat(F.lit("<p>"), F.col("id").cast("string"), F.lit("</p>")).alias("html"))),
    ):
        last = good.columns[1]
        path = tmp_path / write.__name__
        with pytest.raises(Exception, match="."):
            write(rows.select(good.columns[0] if write is write_document else F.concat(F.lit("a/f"), F.col("id").cast("string")).alias("name"), wrong.alias(last)), str(path))
        assert [x.name for x in tmp_path.iterdir()] == (["write_files"] if write is write_document else [])
        write(good, str(path))
    assert len(list((tmp_path / "write_files/a").iterdir())) == 60
    body = (tmp_path / "write_document").read_text().split("\n")
    assert body[2:-2] == [f"<p>{i}</p>" for i in range(60)] and body[0] == "<!DOCTYPE html>"
    with pytest.raises(Exception, match="names repeat"):
        write_files(rows.select(F.lit("same").alias("name"), F.lit("x").alias("content")), str(tmp_path / "twice"))
    with pytest.raises(Exception, match="."):
        write_document(good, str(tmp_path / "write_document"), overwrite=False)
    assert sorted(x.name for x in tmp_path.iterdir()) == ["write_document", "write_files"]
    write_files(rows.where("false").selectExpr("'' AS name", "'' AS content"), str(tmp_path / "empty"))
    assert (tmp_path / "empty").is_dir()


def test_patches_from_the_lines_around_equal_those_from_the_whole_content(spark):
    """And Python is given no more than these lines, whatever the length of the content."""
    from findmill.operators import report as R

    contents = [None, "", "\n", "a", "a\n", "\n\n\n", "a\n\n  b\r\nc", "\n".join(f"  l{i}" for i in range(12)), "\n".join(f"l{i}" for i in range(9)) + "\n", "x\n" * 7 + "\n"]
    fixes = ["q", "q\n r", "l4\nq", "q\nl4", "l4", " ", None]
    rows = [(i, "f", c, n, x) for i, (c, n, x) in enumerate((c, n, x) for c in contents for n in (None, -1, 0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 12, 13, 1 << 40) for x in fixes)]
    given = spark.createDataFrame(rows, "id long, file string, content string, line long, fix string")
    found = {r.id: r.p.asDict() for r in given.select("id", R.patch("file", "content", "line", "fix").alias("p")).collect()}
    for i, *row in rows:
        assert found[i] == make_patch(*row), row
    big = spark.range(3).select("id", F.lit("f").alias("file"), F.lit("some line\n").alias("one")).withColumn("content", F.repeat("one", F.lit(50_000))).withColumn("line", F.lit(9)).withColumn("fix", F.lit("q"))

    def sized(file, near, line, fix, skipped):
        return near.str.len()

    kept = R._patch
    R._patch = F.pandas_udf(sized, "long")
    try:
        assert {r.n for r in big.select(R.patch("file", "content", "line", "fix").alias("n")).collect()} == {70}
    finally:
        R._patch = kept
