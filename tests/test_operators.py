import datetime as dt
import json
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folio.functions import numbers
from folio.functions import text as X
from folio.operators import chunks, jobs, report, review, rules, scoring
from folio.plans import harness as H
from folio.settings import Settings
from folio.sources.store import Files, FileStore, replace_partitions
from folio.streaming import checks as stream

FIELDS = "doc_id int, preset_id string, rule_ord int, sub_ord int, category string, severity string, source string, rule_id string, location string, message string, expected string, actual string, suggestion string, original_text string, confidence double"


def finding(doc, category, severity, rule, message="m", source="rule_engine", confidence=None):
    return (doc, "base", 0, 0, category, severity, source, rule, "", message, None, None, None, None, confidence)


def test_text_functions(spark):
    rows = [(" a  b\t", 2), ("", 0), (" ", 0), ("слово дело", 2)]
    d = spark.createDataFrame(rows, "t string, n int").select("*", X.word_count(F.col("t")).alias("c"), X.is_blank(F.col("t")).alias("b"), X.collapse(F.col("t")).alias("s"))
    got = d.collect()
    assert [r.c for r in got] == [r.n for r in got] and [r.b for r in got] == [not r.t.split() for r in got] and [r.s for r in got] == [" ".join(r.t.split()) for r in got]
    lines = ["a\nb", "a\r\nb\x0bc", "a\n", "", " x"]
    d = spark.createDataFrame([(x,) for x in lines], "t string").select("t", X.lines(F.col("t")).alias("l"))
    assert all(r.l == r.t.splitlines() or r.t == "" for r in d.collect())
    d = spark.createDataFrame([("ABC 1",), ("Abc",), ("123",), ("ГЛАВА",)], "t string").select(X.is_upper(F.col("t")).alias("u"), "t")
    assert all(r.u == r.t.isupper() for r in d.collect())


def test_split_message(spark):
    text = "ab\U0001f600" * 50
    got = spark.createDataFrame([(text,)], "t string").select(X.split_message(F.col("t"), 7).alias("p")).first().p
    assert "".join(got) == text and all(len(p.encode("utf-16-le")) // 2 <= 7 for p in got)


def test_split_message_fills_each_piece_and_is_linear(spark):
    """The pieces of a fold over characters, at a cost that a text of millions of characters shows."""

    def fold(text, limit):
        out, now = [], ""
        for ch in text:
            if len((now + ch).encode("utf-16-le")) // 2 > limit:
                out, now = [*out, now], ""
            now += ch
        return [*out, now] if now else out

    rng = random.Random(3)
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in ("ab", "a\U0001f600", "\U0001f600", "\ud7ff\ue000\U0010ffff", "a\n\u0436") for _ in range(20)]
    for limit in (2, 3, 7, 8):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.split_message(F.col("t"), limit).alias("p"))
        assert {r.i: r.p for r in df.collect()} == {i: fold(t, limit) for i, t in enumerate(texts)}
    assert spark.createDataFrame([(None,)], "t string").select(X.split_message(F.col("t"))).first()[0] is None
    long = spark.range(2).select(F.repeat(F.when(F.col("id") == 0, "abcdefghij").otherwise("abcde\U0001f600fghi"), 400_000).alias("t"))
    began = time.monotonic()
    assert long.select(F.size(X.split_message(F.col("t"))).alias("n")).agg(F.sum("n")).first()[0] == 1143 + 1258
    assert time.monotonic() - began < 30


def expected_scores(rows, policy=(0.35, 0.15, 0.05), advisory=("text.long",)):
    worst = {}
    for _, _, _, _, cat, sev, src, rule, _, msg, *_, conf in rows:
        frac = dict(zip(("critical", "error", "warning"), policy, strict=True)).get(sev, 0.0)
        if rule in advisory or not frac:
            continue
        frac *= conf if src == "ai" and conf is not None else 1
        key = (scoring.BUCKETS[cat], f"{src}:{scoring.RULE_GROUPS.get(rule, rule) or msg.strip().lower()}")
        worst[key] = max(worst.get(key, 0), frac)
    weights = {"formatting": 30, "structure": 20, "language": 15, "style": 10, "content": 25}
    return {c: round(w * max(0, 1 - sum(sorted(v for (b, _), v in worst.items() if b == c))), 1) for c, w in weights.items()}


def test_scores_against_a_plain_version(spark):
    rng = random.Random(3)
    for _ in range(4):
        rows = [finding(1, rng.choice(["formatting", "structure", "references", "language", "content"]), rng.choice(["critical", "error", "warning", "info", "pass"]), rng.choice(["a", "b", "font.main", "font.mixed", "text.long", None]), rng.choice(["M ", "m", "n"]), *rng.choice([("rule_engine", None), ("ai", rng.choice([None, 0.0, 0.5, 1.0]))])) for _ in range(rng.randrange(1, 25))]
        rng.shuffle(rows)
        f = spark.createDataFrame(rows, FIELDS)
        docs = spark.createDataFrame([(1, "base")], "doc_id int, preset_id string")
        full = spark.createDataFrame([(1, c, 1.0) for c in scoring.REVIEWED], "doc_id int, category string, coverage double")
        got = {r.category: r.earned_points for r in scoring.category_scores(docs, f, H.presets(spark), full).collect()}
        assert got == expected_scores(rows)


def test_repeats_cost_once_and_confidence_counts(spark):
    docs = spark.createDataFrame([(1, "base"), (2, "base"), (3, "base")], "doc_id int, preset_id string")
    rows = [finding(1, "formatting", "error", "x")] * 5 + [finding(1, "formatting", "warning", "font.main"), finding(1, "formatting", "warning", "font.mixed")] + [finding(2, "content", "error", None, "Same", "ai", 0.0)]
    c = {(r.doc_id, r.category): r for r in scoring.category_scores(docs, spark.createDataFrame(rows, FIELDS), H.presets(spark), spark.createDataFrame([(2, "content", 0.5)], "doc_id int, category string, coverage double")).collect()}
    assert c[1, "formatting"].earned_points == 24.0 and c[1, "formatting"].deductions == {"rule_engine:x": 4.5, "rule_engine:font": 1.5}
    assert c[2, "content"].deductions == {"ai:same": 0.0} and c[2, "content"].deduction_labels == {} and c[2, "content"].evaluated
    assert not c[3, "language"].evaluated and c[3, "language"].earned_points == 0
    t = {r.doc_id: r for r in scoring.totals(spark.createDataFrame(list(c.values()))).collect()}
    assert t[3].score == 100 and t[3].evaluated_max_score == 50 and t[2].provisional


def test_results_are_nested(spark):
    docs = spark.createDataFrame([(1, "base"), (2, "base")], "doc_id int, preset_id string")
    f = spark.createDataFrame([finding(1, "formatting", "warning", "w"), finding(1, "structure", "critical", "c")], FIELDS)
    r = {x.doc_id: x for x in scoring.results(docs, f, H.presets(spark)).collect()}
    m = {x.doc_id: x.text.split("\n") for x in report.summary_message(scoring.results(docs, f, H.presets(spark))).collect()}
    assert m[1] == ["score: 83.0/100", "critical: 1", "errors: 0", "warnings: 1", "passed: 0", "score.provisional", "pdf.unverified"] and m[2][0] == "score: 100.0/100"
    c = scoring.category_scores(docs, f, H.presets(spark))
    assert report.results_message(c, scoring.totals(c)).where("doc_id = 1").first().text.split("\n") == ["formatting: 28.5/30", "structure: 13/20", "language: not evaluated", "style: not evaluated", "content: not evaluated", "total: 83.0/100"]
    assert [x.rule_id for x in r[1].findings] == ["c", "w"] and r[1].critical == 1 and len(r[2].category_scores) == 5 and r[2].findings is None


def test_chunks(spark):
    t = spark.createDataFrame([(1, "s", " a  b "), (1, "e", " \n"), (2, "s", " ".join(map(str, range(7))))], "doc_id int, section string, text string")
    got = sorted(tuple(r) for r in chunks.chunked(t, 3).collect())
    assert got == [(1, "s", 0, " a  b ", 2), (2, "s", 0, "0 1 2", 3), (2, "s", 1, "3 4 5", 3), (2, "s", 2, "6", 1)]


def test_budget_goes_on_past_what_does_not_fit(spark):
    rows = [(1, "body", 0, 30), (1, "introduction", 0, 60), (1, "conclusion", 0, 90), (1, "body", 1, 3)]
    c = spark.createDataFrame(rows, "doc_id int, section string, chunk_index int, word_count int")
    got = {(r.section, r.chunk_index) for r in chunks.within_budget(c, 125).collect()}
    assert got == {("introduction", 0), ("body", 0), ("body", 1)}


class Scripted:
    name = "scripted"

    def __init__(self, *answers):
        self.answers = list(answers)

    def complete(self, system, user, max_tokens):
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return review.Answer(a, 100, 50)


ALL = json.dumps({"errors": [], "evaluated_categories": ["language", "style", "content"]})
SOME = json.dumps({"errors": [], "evaluated_categories": ["language"]})


def reviewed(spark, provider, **terms):
    c = spark.createDataFrame([("d", "s", 0, 600, "x " * 600, 1), ("d", "s", 1, 600, "y " * 600, 2)], "doc_id string, section string, chunk_index int, word_count int, text string, turn int")
    r = review.reviewed(c, provider, review.Terms(pause=lambda s: None, **terms))
    r = spark.createDataFrame(r.collect(), review.REVIEWED)
    cover = {x.category: x.coverage for x in review.coverage(review.parsed(r)).collect()}
    why = review.failure_reasons(r).first()
    return cover, why.reasons, why.tokens


@pytest.mark.parametrize(
    "answers,terms,cover,reasons,tokens",
    [
        ((ALL, ALL), {}, (1, 1, 1), [], 300),
        ((ALL, SOME), {}, (1, 0.5, 0.5), [], 300),
        ((ALL, review.ProviderError()), {"attempts": 1}, (0.5, 0.5, 0.5), ["provider"], None),
        (("broken", ALL, ALL), {}, (1, 1, 1), [], 450),
        ((), {"budget": 100}, (0, 0, 0), ["budget"], 0),
        (('{"errors": []}',) * 6, {}, (0, 0, 0), ["invalid_response"], 900),
        ((review.QuotaError(), ALL), {}, (0.5, 0.5, 0.5), ["provider"], None),
    ],
)
def test_reviews(spark, answers, terms, cover, reasons, tokens):
    got, why, used = reviewed(spark, Scripted(*answers), **terms)
    assert (got["language"], got["style"], got["content"]) == cover and why == reasons
    assert tokens is None or used == tokens


def test_review_findings_and_disabled(spark):
    e = {"category": "style", "severity": "error", "explanation": "why", "location": "line 2"}
    a = [("d", "s", 1, 10, json.dumps({"errors": [e, e | {"category": "content"}, e | {"category": "structure"}], "evaluated_categories": ["style"]}))]
    got = review.findings(review.parsed(spark.createDataFrame(a, "doc_id string, section string, chunk_index int, word_count int, answer string"))).collect()
    assert [(r.category, r.location, r.confidence) for r in got] == [("style", "s, fragment 2: line 2", 0.5)]
    assert reviewed(spark, review.Still())[1] == ["disabled"]


def test_validation_agrees_with_the_columns(spark):
    ok = {"category": "style", "severity": "error", "explanation": "e"}
    raws = [{"errors": [], "evaluated_categories": ["style"]}, {"errors": [ok], "evaluated_categories": ["style"]}, {"errors": [ok | {"confidence": 2}], "evaluated_categories": ["style"]}, {"errors": [ok] * 101, "evaluated_categories": ["style"]}, {"errors": [ok | {"explanation": ""}], "evaluated_categories": ["style"]}, {"errors": [], "evaluated_categories": []}, {"errors": [], "evaluated_categories": ["structure"]}, {"errors": [ok | {"original_text": "q" * 500}], "evaluated_categories": ["style"]}]
    got = review.parsed(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(raws)], "id int, answer string")).orderBy("id").collect()
    for r, raw in zip(got, raws, strict=True):
        v = review.valid(raw)
        assert r.is_valid == (v is not None)
        assert v is None or [e.asDict() for e in r.errors] == [dict(e) for e in v["errors"]]


NOW = dt.datetime(2026, 1, 31, 12)
CHECK = "id int, document_id int, status string, score double, created_at timestamp, started_at timestamp, completed_at timestamp, delivery_status string, attempts int, delivery_attempts int, job_payload string, error_detail string, result_snapshot string"


def check(id, status, hours=0.0, delivery="none", attempts=0, sends=0, payload="{}", score=None):
    at = NOW - dt.timedelta(hours=hours)
    return (id, id, status, score, at, at, at if status in jobs.ENDED else None, delivery, attempts, sends, payload, None, None)


def states(df, *columns):
    return {r.id: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_check_changes(spark):
    now = F.lit(NOW)
    t = spark.createDataFrame([check(1, "pending"), check(2, "running", 2, attempts=1), check(3, "completed", 2, "sending"), check(4, "running", 0.1, attempts=3), check(5, "pending", 30)], CHECK)
    ids = spark.createDataFrame([(1,), (2,)], "check_id int")
    assert states(jobs.claimed(t, ids, now), "status", "attempts") == {1: ("running", 1), 2: ("running", 1), 3: ("completed", 0), 4: ("running", 3), 5: ("pending", 0)}
    assert states(jobs.recovered(t, now), "status", "delivery_status") == {1: ("pending", "none"), 2: ("pending", "none"), 3: ("completed", "pending"), 4: ("running", "none"), 5: ("pending", "none")}
    assert states(jobs.expired(t, now), "status")[5] == "failed" and states(jobs.expired(t, now), "status")[1] == "pending"
    done = jobs.completed(t, spark.createDataFrame([(2, 71.5, "{}"), (3, 1.0, "{}")], "check_id int, score double, snapshot string"), now)
    assert states(done, "status", "score")[2] == ("completed", 71.5) and states(done, "score")[3] is None
    bad = spark.createDataFrame([(2, "x" * 900), (3, "late")], "check_id int, detail string")
    f = states(jobs.failed(t, bad, now), "status", "error_detail")
    assert f[2] == ("failed", "x" * 500) and f[3] == ("completed", None)
    err = spark.createDataFrame([(2, "e", False), (4, "e", False), (1, "e", True)], "check_id int, detail string, is_domain boolean")
    assert states(jobs.retried(t, err, now), "status") == {1: "pending", 2: "pending", 3: "completed", 4: "failed", 5: "pending"}
    tried = spark.createDataFrame([(3, False)], "check_id int, ok boolean")
    for want in ("pending", "pending", "failed"):
        t2 = jobs.delivered(t, tried)
        assert states(t2, "delivery_status")[3] == want
        t = t2
    assert states(t, "status")[3] == "completed"


def test_retention_and_history(spark):
    now = F.lit(NOW)
    t = spark.createDataFrame([check(1, "completed", 24 * 31, "sent"), check(2, "completed", 24 * 31, "sending"), check(3, "failed", 24 * 29), check(4, "running", 24 * 40)], CHECK)
    assert set(states(jobs.retained(t, now), "status")) == {2, 3, 4}
    up = spark.createDataFrame([(i, 7 if i < 4 else 8, f"{i}.docx") for i in range(1, 5)], "id int, user_id int, filename string")
    assert set(states(jobs.without_history(t, up, F.col("user_id") == 7), "status")) == {2, 4}
    assert [r.check_id for r in jobs.history(t, up, F.col("user_id") == 7, 2).collect()] == [3, 2]
    files = spark.createDataFrame([("a", NOW - dt.timedelta(hours=30)), ("b", NOW - dt.timedelta(hours=30)), ("c", NOW)], "path string, modified_at timestamp")
    busy = spark.createDataFrame([check(1, "running", payload='{"docx_path": "a"}'), check(2, "completed", payload='{"docx_path": "b"}')], CHECK)
    assert [r.path for r in jobs.purgeable(files, busy, now, 24).collect()] == ["b"]
    fresh = spark.createDataFrame([(1, "x" * 300)], "check_id int, location string")
    old = spark.createDataFrame([(1, "old"), (2, "stay")], "check_id int, location string")
    once = jobs.replaced(old, fresh)
    assert sorted(map(tuple, jobs.replaced(once, fresh).collect())) == sorted(map(tuple, once.collect())) == [(1, "x" * 255), (2, "stay")]


def test_users_are_upserted(spark):
    users = spark.createDataFrame([(1, "a", "A", "user", "kk"), (2, "b", "B", "admin", None)], "telegram_id int, username string, full_name string, role string, language string")
    seen = spark.createDataFrame([(1, "a2", "A2"), (3, "c", "C")], "telegram_id int, username string, full_name string")
    got = {r.telegram_id: tuple(r)[1:] for r in jobs.upserted(users, seen, [1]).collect()}
    assert got == {1: ("a2", "A2", "admin", "kk"), 2: ("b", "B", "admin", None), 3: ("c", "C", "user", None)}


def test_admission_against_a_plain_version(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(4), NOW + dt.timedelta(hours=rng.randrange(0, 80), seconds=i), None) for i in range(120)]
    rows = [(i, u, t, t + dt.timedelta(hours=rng.randrange(1, 12)) if rng.random() < 0.9 else None) for i, u, t, _ in rows]
    limits = jobs.Limits(per_day=3, active=2)
    want, held = {}, {}
    for i, u, t, done in sorted(rows, key=lambda r: (r[2], r[0])):
        mine = held.setdefault(u, [])
        ok = sum(d is None or d > t for _, d in mine) < 2 and sum(s.date() == t.date() for s, _ in mine) < 3
        want[i] = ok
        if ok:
            mine.append((t, done))
    got = jobs.admitted(spark.createDataFrame(rows, "request_id long, user_id int, ts timestamp, done_at timestamp"), limits)
    assert {r.request_id: r.is_admitted for r in got.collect()} == want and 0 < sum(want.values()) < 120


def test_state_machine(spark, tmp_path):
    assert stream.advanced(("completed", 1, "sent", 1), "fail") == ("completed", 1, "sent", 1)
    s = stream.FRESH
    for kind in ("submit", "claim", "error", "claim", "stale", "claim", "error"):
        s = stream.advanced(s, kind)
    assert s[:2] == ("failed", 3)
    events = [(1, "submit", 1), (1, "claim", 2), (1, "complete", 3), (1, "send", 4), (1, "unsent", 5), (2, "submit", 1), (2, "claim", 2), (2, "cancel", 3), (3, "claim", 1)]
    rows = [(c, k, NOW + dt.timedelta(seconds=t)) for c, k, t in events]
    (tmp_path / "in").mkdir()
    schema = "check_id long, kind string, ts timestamp"
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"check_id": c, "kind": k, "ts": t.isoformat()}) for c, k, t in rows[i * 5 : i * 5 + 5]) + "\n")
    out: dict[int, tuple] = {}

    def keep(df, _):
        out.update({r.check_id: tuple(r)[1:] for r in df.collect()})

    spark.conf.set("spark.sql.shuffle.partitions", "2")
    q = stream.dispatched(stream.states(stream.inbox(spark, str(tmp_path / "in"), schema), timers=False), keep, str(tmp_path / "cp"), None)
    assert q.awaitTermination(120)
    batch = {r.check_id: tuple(r)[1:] for r in stream.states_batch(spark.createDataFrame(rows, schema)).collect()}
    assert out == batch == {1: ("completed", 1, "pending", 1), 2: ("pending", 1, "none", 0), 3: ("new", 0, "none", 0)}


def test_stuck_checks_come_back_by_timer(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"check_id": 1, "kind": k, "ts": (NOW + dt.timedelta(seconds=i)).isoformat()}) for i, k in enumerate(("submit", "claim"))))
    seen = []
    limits = jobs.Limits(job_seconds=1, grace_seconds=1)
    q = stream.dispatched(stream.states(stream.inbox(spark, str(tmp_path / "in"), "check_id long, kind string, ts timestamp"), limits), lambda df, _: seen.extend(r.status for r in df.collect()), str(tmp_path / "cp"), 1)
    try:
        for _ in range(60):
            if "pending" in seen:
                break
            q.awaitTermination(1)
    finally:
        q.stop()
    assert seen[0] == "running" and "pending" in seen


def test_jobs_once_in_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"job_id": j, "ts": NOW.isoformat()}) for j in ("x", "x", "y")))
    got = []
    q = stream.dispatched(stream.once(stream.inbox(spark, str(tmp_path / "in"), "job_id string, ts timestamp")), lambda df, _: got.extend(r.job_id for r in df.collect()), str(tmp_path / "cp"), None)
    assert q.awaitTermination(120) and sorted(got) == ["x", "y"]


def test_reports(spark):
    p = spark.createDataFrame([("á\x00<b>\n",), (None,)], "t string").select(report.print_text("t").alias("t")).collect()
    assert [r.t for r in p] == ["á&lt;b&gt; ", None]
    names = [("a/b:c.docx",), ("x" * 200 + ".docx",), ("no suffix",), ("Ａ.pdf",)]
    n = [r.n for r in spark.createDataFrame(names, "n string").select(report.display_name(F.col("n")).alias("n")).collect()]
    assert n[0] == "a_b_c.docx" and len(n[1]) == 120 and n[1].endswith(".docx") and n[2:] == ["no suffix", "A.pdf"]
    s = spark.createDataFrame([("unnamed:63", "  Глава\nx"), ("unnamed:63", "y" * 300), ("references", ""), ("odd", "t")], "k string, t string")
    assert [r.v for r in s.select(report.section_label(F.col("k"), F.col("t"), {"references": "R", "main_body": "M"}).alias("v")).collect()] == ["Глава", "Paragraph 64", "R", "M"]
    note = spark.createDataFrame([(True, True, ["budget", "odd", "budget"]), (False, True, [])], "p boolean, a boolean, r array<string>").select(report.score_note(F.col("p"), F.col("a"), F.col("r")).alias("n")).collect()
    assert [r.n for r in note] == [["score.provisional", "ai.reason.budget"], ["score.complete"]]
    v = spark.createDataFrame([(9.5, 10.0, True, 0.5), (0.0, 10.0, False, 0.0), (10.0, 10.0, True, 1.0)], "e double, m double, d boolean, c double").select(report.category_value(*map(F.col, "emdc")).alias("v")).collect()
    assert [r.v for r in v] == ["9.5/10 · 50%", "not evaluated", "10/10"]
    f = spark.createDataFrame([finding(1, "formatting", "error", f"r{i:02}", f"m{i:02}") for i in range(35)], FIELDS)
    m = report.errors_message(f).first()
    assert m.left_out == 5 and m.text.count("m") == 30


def test_store(spark, tmp_path):
    uri = f"file://{tmp_path}"
    store = FileStore(spark, uri, 100)
    name = store.save(b"PK\x03\x04x", "../../evil.docx")
    path = tmp_path / name
    assert path.read_bytes() == b"PK\x03\x04x" and path.stat().st_mode & 0o777 == 0o600 and path.suffix == ".docx"
    for bad in (b"", b"no", b"PK\x03\x04" + b"x" * 200):
        with pytest.raises(ValueError):
            store.save(bad, "a.docx")
    store.delete(name)
    files = Files(spark, uri)
    assert not path.exists() and not files.exists(name)
    for content in (b"one", b"two"):
        files.published("r.pdf", content)
    assert files.read("r.pdf") == b"two" and files.names() == ["r.pdf"] and len(list(tmp_path.iterdir())) == 1
    assert files.create("once", b"a") and not files.create("once", b"b") and files.read("once") == b"a"
    for outside in ("../x", "/etc/x", "a/../../x", "", "hdfs://x/y"):
        with pytest.raises(ValueError):
            files.path(outside)
    t = spark.createDataFrame([(1, "a"), (2, "b")], "check_id int, v string")
    replace_partitions(t, str(tmp_path / "t"), "check_id")
    replace_partitions(spark.createDataFrame([(1, "c")], "check_id int, v string"), str(tmp_path / "t"), "check_id")
    assert sorted((r.check_id, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(1, "c"), (2, "b")]


def test_settings():
    assert Settings.from_env({"MAX_PAGES": "7"}).max_pages == 7
    with pytest.raises(ValueError):
        Settings(max_pages=0)
    with pytest.raises(ValueError):
        Settings(api_tokens={"short": 1})
    s = Settings(api_tokens={"a" * 32: 7})
    assert s.owner("a" * 32) == 7 and s.owner("b") is None and s.owner(None) is None


def test_advice_leaves_passes(spark):
    f = spark.createDataFrame([finding(1, "content", "pass", "text.long"), finding(1, "content", "critical", "text.long")], FIELDS)
    assert sorted(r.severity for r in rules.advised(f, H.presets(spark)).collect()) == ["info", "pass"]


def test_pandas_is_not_needed_for_headings(spark):
    from folio.functions import sections as S

    d = spark.createDataFrame(pd.DataFrame({"t": ["i. introduction", "IV. Introduction", "2020 год"]}))
    got = [tuple(r) for r in d.select(S.section_key(S.normalized(F.col("t"))), S.numbering(F.col("t"))).collect()]
    assert got == [(None, None), (None, "IV"), (None, "2020")]


def test_rounding_is_that_of_ieee_values(spark):
    import random

    rng = random.Random(3)
    xs = [k / 20 for k in range(2001)] + [28.95, 0.05, 0.15, 2.25, 2.35, 1e9 + 0.05, 0.0] + [rng.uniform(0, 100) for _ in range(2000)] + [round(rng.uniform(0, 100), 2) for _ in range(2000)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", numbers.rounded(F.col("x")).alias("r")).collect()
    assert [(r.x, r.r) for r in got if r.r != round(r.x, 1)] == []


def test_state_machine_in_batch_is_the_fold(spark):
    import random

    rng = random.Random(4)
    kinds = ["submit", "claim", "complete", "fail", "error", "cancel", "send", "sent", "unsent", None]
    events = [(i, rng.choice(kinds), k) for i in range(60) for k in range(rng.randrange(1, 40))]
    want = {}
    for i, kind, _ in events:
        want[i] = stream.advanced(want.get(i, stream.FRESH), kind)
    rows = spark.createDataFrame(events, "check_id long, kind string, n int").withColumn("ts", F.timestamp_seconds("n"))
    assert {r[0]: tuple(r)[1:] for r in stream.states_batch(rows).collect()} == want


def test_shipped_messages_presets_and_prompts(spark, tmp_path):
    from folio import errors
    from folio.sources import messages, presets, prompts

    rows = messages.message_rows()
    assert {f"error.{c}" for c in errors.CODES} <= {r[1] for r in rows} and all(sum(r[1] == k for r in rows) == 3 for k in {r[1] for r in rows})
    asked = spark.createDataFrame([("too_many_pages", "en"), ("nothing", "kk"), ("daily_limit", None)], "code string, lang string").withColumn("key", errors.message_key(F.col("code")))
    got = {r.code: r.text for r in report.localised(asked, messages.message_table(spark), "key", F.col("lang"), "text").collect()}
    assert got == {"too_many_pages": "There are too many pages", "nothing": "Ішкі қате", "daily_limit": "Дневной лимит исчерпан"}
    assert {p["work_type"] for p in presets.load_presets("-")} == set(presets.WORK_TYPES)
    filled = prompts.load_prompt().format(section="s", topic="t", text="the text")
    assert "the text" in filled and '{"errors"' in filled
    (tmp_path / "bad.txt").write_text("{text} {other}")
    for name, folder in (("bad", str(tmp_path)), ("none", None), ("../prompts/review", None)):
        with pytest.raises(ValueError):
            prompts.load_prompt(name, folder)


def test_http_provider_and_hanging_calls():
    import http.server
    import json
    import threading
    import time

    replies = [(200, {"choices": [{"message": {"content": "hi"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}), (429, {}), (500, {}), (200, {"choices": []})]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            assert self.path == "/v1/chat/completions" and asked["messages"][1]["content"] == "user"
            code, body = replies.pop(0)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    p = review.Http(f"http://127.0.0.1:{server.server_port}/v1", "m")
    assert p.complete("system", "user", 5) == review.Answer("hi", 3, 2)
    for error in (review.QuotaError, review.ProviderError, review.ProviderError):
        with pytest.raises(error):
            p.complete("system", "user", 5)
    server.shutdown()
    began = time.monotonic()
    with pytest.raises(TimeoutError):
        review.within(0.1, lambda: time.sleep(30))
    assert time.monotonic() - began < 5
