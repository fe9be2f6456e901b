import pytest
from loomlog.operators import line_rules, sequential, whole_log
from loomlog.operators.focus import Focus, apply_focus, parse_range
from loomlog.operators.gate import Request, respond
from loomlog.operators.summary import summaries
from loomlog.plans.reduction import NAMES, reduce_lines, render_measures, step_measures
from loomlog.sources.lines import from_texts, head, join_lines, read_logs, tail, write_logs


def run(spark, step, text):
    return join_lines(step(from_texts(spark, [("a", text)]))).first()["text"]


def note(n):
    return f"[... {n} lines omitted ...]"


@pytest.mark.parametrize(
    ("step", "before", "after"),
    [
        (line_rules.strip_ansi, "\x1b[1;31mred\x1b[0m\ra\x07\r\nb\r", "reda\r\nb"),
        (line_rules.normalize_whitespace, "\n \na \t\r\n\n\n\xa0\nb\n\n", "a\n\nb"),
        (line_rules.normalize_whitespace, "\n\n \n", ""),
        (whole_log.shorten_ids, "u 550e8400-e29b-41d4-a716-446655440000 h deadbeef1\neyJ0123456789012345678901.01234567890123456789.01234567890123456789 deadbeef1", "u $2 h $3\n$1 $3"),
        (whole_log.shorten_ids, "export_1771908476037_2dian9n 1234567890 feedface", "$2 1234567890 $1"),
        (line_rules.shorten_urls, "see https://h.io/a/b/c/d/e?x=1#y, or wss://h/a/b?q", "see https://h.io/.../d/e or wss://h/a/b"),
        (line_rules.simplify_timestamps, "2024-01-15T14:32:01.5Z 2024-01-15 14:32:02,1 1712345678901 Jan 15 14:32:03 2024-01-15 14:32:04", "14:32:01 14:32:02 <epoch> 14:32:03 2024-01-15 14:32:04"),
        (whole_log.strip_envelope, "\n".join(f"10:00:0{i} app[$1] x [{lv}] 2024-01-01 10:00:0{i} - m {i}" for i, lv in enumerate(("info", "info", "error", "info"))), "\n".join(f"2024-01-01 10:00:0{i} - m {i}" for i in range(4))),
        (line_rules.filter_noise, "a\nGET /healthz 200\nb\nheartbeat one two\nhealth check ok fine\nc\n12:00:00\n=====", f"a\nb\n{note(2)}\nc"),
        (line_rules.filter_noise, "heartbeat\nkeepalive\nx", "heartbeat\nkeepalive\nx"),
        (line_rules.strip_source_locations, "  app.js:12 [T] hi\nmsg main-f1.ts:3:4\nb.js:1\nend", "  [T] hi\nmsg\nend"),
        (line_rules.collapse_test_status, "PASS a.ts\nPASS b.ts (1.2s)\nok x/y 0.1s\nFAIL c.ts\nPASS d.ts", "PASS [3 suites]\nFAIL c.ts\nPASS d.ts"),
        (line_rules.collapse_docker_layers, " => => pushing layer s:1  1.0s\n => => pushing layer s:2  0.5s\n => => exporting layer s:3  2s", " => => pushing 2 layers  0.5s-1s\n => => exporting layer s:3  2s"),
        (line_rules.compact_access_logs, '[10:00:01] 1.2.3.4 "GET /a HTTP/1.1" 404 took 1.5 ms\nerror "GET /b HTTP/1.1" 500', '10:00:01 GET /a → 404 (1.5ms)\nerror "GET /b HTTP/1.1" 500'),
        (line_rules.compress_prefix, "\n".join(f"2024-01-01 10:00:0{t} - m - {lv} - x{i}" for i, (t, lv) in enumerate(((1, "INFO"), (1, "INFO"), (1, "WARN"), (2, "INFO")))) + "\n====", "[2024-01-01]\nm:\n  10:00:01:\n    INFO - x0\n    INFO - x1\n    WARN - x2\n  10:00:02 - INFO - x3"),
        (whole_log.deduplicate_lines, "a 1\na 2\nb\nb\nconn 1.2.3.4:5001 n 1\nconn 1.2.3.4:5002 n 2", "[x2] a {N} | N = 1, 2\nb\n[... 1 identical lines omitted ...]\n[x2] conn 1.2.3.4:{port} n {N2} | N = 1, 2"),
        (whole_log.deduplicate_lines, "p: TypeError: something went wrong\nx\nq: TypeError: something went wrong\ny\nr: TypeError: something went wrong", "x\ny\n[x3] TypeError: something went wrong — p, q, r"),
        (line_rules.merge_scattered, "a\nb\na\nc\na\n[x2] k 1 | N = 1\n[x3] k 2 | N = 2", "a\n[... above line repeated 2 more times ...]\nb\nc\n[x5] k 1 | N = 1"),
    ],
)
def test_step(spark, step, before, after):
    assert run(spark, step, before) == after


@pytest.mark.parametrize(
    ("rewrite", "before", "after"),
    [
        (sequential.collapse_installs, ["x", "RUN pip install -r r.txt", "1.2 Collecting a==1 (from -r r.txt (line 1))", "Collecting b", "Collecting c>=2 (from a->x)", "noise", "ERROR: no", "z"], ["x", "RUN pip install -r r.txt", "pip: a==1 b", "pip: +1 transitive deps (c>=2)", "ERROR: no", "z"]),
        (sequential.detect_cycles, ["a1", "b", "a2", "b", "a3", "b", "z"], ["a1", "b", "[... above 2-line block repeated 2 more times ...]", "z"]),
        (sequential.detect_cycles, ["a", "b", "c", "a", "b", "c"], ["a", "b", "c", "[... above 3-line block repeated 1 more times ...]"]),
        (sequential.detect_cycles, ["a", "b", "a", "b"], ["a", "b", "a", "b"]),
        (sequential.fold_prefixes, ["GET /api one", "GET /api two", "GET /api three x", "other"], ["GET /api one", "  two", "  three x", "other"]),
        (sequential.fold_prefixes, ["  job run a", "  job run b", "head:", "x"], ["  job run a", "    b", "head:", "x"]),
        (sequential.collapse_retries, ["==> one", *"abcd", "==> two", *"abcd", "CACHED"], ["==> one", *"abcd", "[... 1 similar retry omitted ...]", "==> two", "CACHED"]),
        (sequential.fold_traces, ["Traceback", '  File "/x/site-packages/uvicorn/a.py", line 1', "    run()", '  File "/srv/src/app.py", line 2', "    ^^^^", "ValueError: bad", "", '  File "/srv/src/app.py", line 2', "ValueError: bad"], ["Traceback", "  [... 1 framework frames (uvicorn) omitted ...]", '  File "app.py", line 2', "ValueError: bad", "", "  [... duplicate traceback omitted ...]"]),
    ],
)
def test_rewriters(rewrite, before, after):
    assert list(rewrite(iter(before))) == after


def test_cycles_agree_with_a_plain_reading():
    import random

    def plain(lines):
        out, i = [], 0
        while i < len(lines):
            for size in range(2, 21):
                reps = 1
                while lines[i + reps * size : i + (reps + 1) * size] == lines[i : i + size] and i + (reps + 1) * size <= len(lines):
                    reps += 1
                if i + size <= len(lines) and reps >= (2 if size > 2 else 3):
                    out += [*lines[i : i + size], f"[... above {size}-line block repeated {reps - 1} more times ...]"]
                    i += reps * size
                    break
            else:
                out.append(lines[i])
                i += 1
        return out

    r = random.Random(1)
    for _ in range(300):
        lines = [r.choice("abc") for _ in range(r.randint(0, 60))]
        assert list(sequential.detect_cycles(iter(lines))) == plain(lines)


LOG = "\n".join(f"10:0{i // 6}:0{i % 6} [{'ERROR' if i % 7 == 3 else 'INFO'}] svc.{'ab'[i % 2]} - thing {i}" for i in range(20))


def test_focus(spark):
    lines = from_texts(spark, [("a", LOG)])

    def ask(**focus):
        return join_lines(apply_focus(lines, Focus(**focus))).first()["text"].split("\n")

    assert ask(level="error", context=0) == ["10:00:03 [ERROR] svc.b - thing 3", "[... 6 lines omitted ...]", "10:01:04 [ERROR] svc.a - thing 10", "[... 6 lines omitted ...]", "10:02:05 [ERROR] svc.b - thing 17", "[... 2 lines omitted ...]", "[filtered: 17 info]"]
    assert ask(level="error", context=0, skip=1, limit=1)[0] == "[showing matches 2-2 of 3 total]"
    assert ask(level="error", skip=9) == ["[3 matches found, but skip=9 exceeds match count]"]
    assert ask(contains="nothing") == ["[no lines matched the focus filters]"]
    assert ask(grep="(") == ["[no lines matched the focus filters]"]
    assert ask(time_range="nonsense") == ["[no lines matched the focus filters]"]
    assert ask(time_range="10:03-10:04", context=0)[0].startswith("10:03:00")
    assert not Focus(not_grep="x", limit=3).active
    assert parse_range("1:02-03:04:05") == (3720, 11045)


def test_summary(spark):
    text = summaries(from_texts(spark, [("a", LOG)])).first()["text"].split("\n")
    assert text[:5] == ["SUMMARY (20 lines)", "Time span: 10:00:00 — 10:03:01", "Levels:", "  ERROR: 3 (10:00:03 — 10:02:05)", "  INFO: 17 (10:00:00 — 10:03:01)"]
    assert "Errors:" in text and "Components: error, info" in text


def test_gate(spark):
    lines = from_texts(spark, [("a", LOG)])
    ask = lambda **r: respond(lines, Request(**r)).first()["text"]
    assert ask(reduce=False).startswith("[120 tokens (unreduced).]\n\n10:00:00")
    assert "exceeds 10 threshold.]\n\nSUMMARY (20 lines)" in ask(threshold=10)
    assert ask(summary=True, tail=4, head=2).startswith("SUMMARY (2 lines)")
    assert "after filtering" in ask(threshold=3, focus=Focus(level="error"), reduce=False)
    assert "smart extraction" in ask(threshold=3, query="why?", reduce=False)


def test_reduction_switches_and_measures(spark):
    lines = from_texts(spark, [("a", "x 1\nx 2\n\n\nx 3"), ("b", "")])
    off = dict.fromkeys(NAMES, False)
    assert {r["log_id"]: r["text"] for r in join_lines(reduce_lines(lines, off)).collect()} == {"a": "x 1\nx 2\n\n\nx 3", "b": ""}
    assert {r["log_id"]: r["text"] for r in join_lines(reduce_lines(lines)).collect()} == {"a": "[x2] x {N} | N = 1, 2\n\nx 3", "b": ""}
    with pytest.raises(ValueError, match="no such step"):
        reduce_lines(lines, {"nothing": True})
    table = {r["log_id"]: r["text"] for r in render_measures(step_measures(lines, off | {"normalizeWhitespace": True})).collect()}
    assert [row.split()[0] for row in table["a"].split("\n")] == ["Normalize", "Total"] and table["b"].endswith("N/A")
    steps = {(r["log_id"], r["step"]): r for r in step_measures(lines, off | {"normalizeWhitespace": True}).collect()}
    assert steps["a", "Total"]["lines_before"] == 5 and steps["a", "Normalize Whitespace"]["lines_after"] == 4
    assert steps["b", "Total"]["lines_before"] == 0 and steps["b", "Total"]["tokens_saved_pct"] is None


def test_lines_of_steps_are_measured_once(spark):
    """the result's plan read each step's lines again in each of its parts."""
    lines = spark.createDataFrame([("a", 0, "one  two "), ("a", 1, "")], "log_id string, line_no long, line string")
    got = step_measures(lines, {n: False for n in NAMES} | {"normalizeWhitespace": True, "shortenUrls": True})
    assert got._jdf.queryExecution().analyzed().toString().count("LogicalRDD") == 4
    assert {(r["step_no"], r["lines_before"], r["lines_after"]) for r in got.collect()} == {(0, 2, 1), (1, 2, 1), (2, 1, 1)}


def test_registered_measures_equal_a_plain_fold(spark, sf_dir, monkeypatch):
    from loomlog.plans import catalogue
    from loomlog.plans.reduction import STEPS

    text = LOG + "\n\n\n==> one\na\nb\nc\nd\n==> two\na\nb\nc\nd\nCACHED\nCollecting a==1 (from -r r.txt (line 1))\nCollecting b\nCollecting c>=2 (from a->x)"
    monkeypatch.setattr(catalogue, "rich_lines", lambda spark, sf_dir: from_texts(spark, [("a", text)]))
    got = {r["step_no"]: r for r in catalogue.QUERIES["step_measures"](spark, sf_dir).collect()}
    sizes = [(len(text.split()), len(text.split("\n")), len(text))]
    for step in STEPS:
        text = run(spark, step.apply, text)
        sizes.append((len(text.split()), len(text.split("\n")), len(text)))
    want = {i: (s.title, sizes[i - 1], sizes[i]) for i, s in enumerate(STEPS, 1)} | {0: ("Total", sizes[0], sizes[-1])}
    assert {i: (r["step"], *(tuple(r[f"{c}_{when}"] for c in ("tokens", "lines", "chars")) for when in ("before", "after"))) for i, r in got.items()} == want


def test_files_tails_and_heads(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.log").write_bytes(b"a\r\nb\nc\n")
    lines = read_logs(spark, str(tmp_path / "in"))
    assert [r["line"] for r in lines.orderBy("line_no").collect()] == ["a\r", "b", "c", ""]
    assert [r["line"] for r in head(tail(lines, 3), 2).orderBy("line_no").collect()] == ["b", "c"]
    write_logs(lines, str(tmp_path / "out"))
    assert sum(1 for _ in spark.read.text(str(tmp_path / "out"), lineSep="\n").collect()) == 4


def test_empty_table(spark):
    empty = spark.createDataFrame([], "log_id string, line_no long, line string")
    assert reduce_lines(empty, focus=Focus(level="error")).count() == 0
    assert summaries(empty).count() == 0


def test_measured_steps_keep_logs_where_they_are(spark):
    """each step shuffled and sorted all lines again."""
    from loomlog.sources.lineage import fixed_plans, frozen_logs

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    lines = spark.createDataFrame([(str(i % 3), i, f"a {i} ") for i in range(30)], "log_id string, line_no long, line string")
    with fixed_plans(spark):
        for step in (line_rules.strip_ansi, line_rules.filter_noise, line_rules.compress_prefix):
            plan = step(frozen_logs(line_rules.normalize_whitespace(frozen_logs(lines))))._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan
    assert spark.conf.get("spark.sql.adaptive.enabled") == adaptive


def test_classes_and_hints_lose_nothing(spark):
    """classes ask about printable ASCII first, costly patterns stand behind cheap ones; both change no result."""
    from loomlog.functions import text
    from pyspark.sql import functions as F

    chars = spark.createDataFrame([(chr(i),) for i in (*range(0xD800), *range(0xE000, 0x10000), 0x1F600)], "c string")
    for new, old in ((text.S, f"[{text.WS}]"), (text.NS, f"[^{text.WS}]"), (text.ANY, r"[^\n\r\x{2028}\x{2029}]"), (text.B1 + "a", "(?<![A-Za-z0-9_])a")):
        assert chars.where(F.concat("c", F.lit("a")).rlike(f"^{new}") != F.concat("c", F.lit("a")).rlike(f"^{old}")).count() == 0
    noise = "get /x/Ping|HEALTH_check|heartBeat|keepalive|Keep-Alive|emitting metrics|metric sent|connection pool: size|gc: 3 freed|INFO: connection open|Download the React DevTools|(anon) @ a.js:1|x ━━━━|[##] 4%|=> [internal] load build definition|=> => transferring context:|=> [internal] load metadata for|[notice] A new release of pip is available|[notice] To update, run: pip install --upgrade pip"
    silent = " 1:02:03 |fn @ b.js:2|--~~~~|- ========== "
    plain = "a line|2024-01-01 00:00:11 - app.view - INFO - user_1 view|== x|12:00:00 b"
    rows = spark.createDataFrame([(x,) for x in "|".join((noise, silent, plain)).split("|")], "line string")
    for patterns, hint, n in ((line_rules.NOISE, line_rules.NOISE_HINT, noise.count("|") + 2), (line_rules.SILENT, line_rules.SILENT_HINT, silent.count("|") + 2)):
        got, want = (rows.where(line_rules.any_of(F.col("line"), patterns, h)).count() for h in (hint, None))
        assert got == want >= n
