"""The life of a check: users, uploads and checks as tables, and what may happen to them.

Tables are plain Parquet, so changes are functions from a table to the table after the change; a writer
replaces whole partitions. One writer owns a key at a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.numbers import rounded

ACTIVE = ("pending", "running")
ENDED = ("completed", "failed")
ERROR_CHARS, FIELD_CHARS = 500, 255
DISPATCH = 100


@dataclass(frozen=True)
class Limits:
    """Quotas, attempts and ages."""

    per_day: int = 20
    active: int = 2
    attempts: int = 3
    delivery_attempts: int = 3
    job_seconds: int = 900
    grace_seconds: int = 60
    file_hours: int = 24
    report_hours: int = 168
    result_days: int = 30


def age(seconds: int) -> Column:
    return F.make_dt_interval(secs=F.lit(float(seconds)))


def history(checks: DataFrame, uploads: DataFrame, owner: Column, most: int = 10) -> DataFrame:
    """Latest checks of one owner with the uploads' names (J4, O2); ties go to the larger id."""
    own = checks.join(uploads.where(owner), checks["document_id"] == uploads["id"]).select(checks["id"].alias("check_id"), "filename", checks["created_at"], "status", "score")
    return own.orderBy(F.desc("created_at"), F.desc("check_id")).limit(most)


def latest_per(rows: DataFrame, owner: str, order: list[Column], most: int = 10) -> DataFrame:
    """The latest rows of every owner at once."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(owner).orderBy(*order))).where(F.col("rank") <= most)


def history_lines(rows: DataFrame) -> DataFrame:
    """Date, name, and the score over 100 with a mark if provisional, or else the status (M9)."""
    score = F.concat(F.regexp_replace(F.round("score", 1).cast("string"), r"\.0$", ""), F.lit("/100"), F.when(F.coalesce("provisional", F.lit(False)), " (provisional)").otherwise(""))
    return rows.withColumn("line", F.concat_ws("\n", F.date_format("created_at", "dd.MM.yyyy"), F.coalesce("filename", F.lit("-")), F.when(F.col("score").isNotNull(), score).otherwise(F.col("status"))))


def owned(rows: DataFrame, owners: DataFrame, key: str, owner_key: str) -> DataFrame:
    """Rows whose owner is among owners."""
    return rows.join(owners, rows[key] == owners[owner_key], "left_semi")


def orphans(parents: DataFrame, children: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Parents without any child."""
    return parents.join(children, parents[key] == children[parent_key], "left_anti")


def counts(checks: DataFrame, uploads: DataFrame, now: Column) -> DataFrame:
    """Checks of today (UTC) and active checks of each user."""
    rows = checks.join(uploads, checks["document_id"] == uploads["id"]).select("user_id", checks["created_at"], "status")
    return rows.groupBy("user_id").agg(F.count_if(F.col("created_at") >= F.date_trunc("DAY", now)).alias("today"), F.count_if(F.col("status").isin(*ACTIVE)).alias("active"))


def admitted(requests: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Requests with is_admitted, in the order of events (M2, ST2).

    requests: request_id, user_id, ts, done_at (null: never). A refused request does not count against
    later ones, so each user's requests are folded; the state keeps what still counts: accepted requests of
    the day or not done."""
    empty = F.array().cast("array<struct<ts:timestamp,done:timestamp>>")
    start = F.struct(empty.alias("held"), F.array().cast("array<bigint>").alias("ok"))
    day = lambda c: F.date_trunc("DAY", c)

    def step(s: Column, r: Column) -> Column:
        busy = lambda h: h["done"].isNull() | (h["done"] > r["ts"])
        held = F.filter(s["held"], lambda h: busy(h) | (day(h["ts"]) == day(r["ts"])))
        fits = (F.size(F.filter(held, busy)) < limits.active) & (F.size(F.filter(held, lambda h: day(h["ts"]) == day(r["ts"]))) < limits.per_day)
        return F.struct(F.when(fits, F.array_append(held, F.struct(r["ts"].alias("ts"), r["done_at"].alias("done")))).otherwise(held).alias("held"), F.when(fits, F.array_append(s["ok"], r["request_id"])).otherwise(s["ok"]).alias("ok"))

    rows = F.array_sort(F.collect_list(F.struct(F.col("ts"), F.col("request_id").cast("long").alias("request_id"), F.col("done_at"))))
    ok = requests.groupBy("user_id").agg(F.aggregate(rows, start, step, lambda s: s["ok"]).alias("ok")).select(F.explode("ok").alias("request_id"), F.lit(True).alias("_ok"))
    return requests.join(ok, "request_id", "left").withColumn("is_admitted", F.coalesce("_ok", F.lit(False))).drop("_ok")


def changed(table: DataFrame, when: Column, **values: Column) -> DataFrame:
    """Rows that fit get new values, others stay (a conditional update)."""
    hit = F.coalesce(when, F.lit(False))
    return table.withColumns({k: F.when(hit, v).otherwise(F.col(k)) for k, v in values.items()})


def upserted(users: DataFrame, seen: DataFrame, admins: list[int]) -> DataFrame:
    """Users after some were seen: new ones are added, names follow, language stays, the role is told anew (M1)."""
    role = F.when(F.col("telegram_id").isin(*admins) if admins else F.lit(False), "admin").otherwise("user")
    s = seen.select("telegram_id", F.col("username").alias("_u"), F.col("full_name").alias("_f"), F.lit(True).alias("_seen"))
    both = users.join(s, "telegram_id", "full_outer")
    there = F.col("_seen").isNotNull()
    return both.select("telegram_id", F.when(there, F.col("_u")).otherwise(F.col("username")).alias("username"), F.when(there, F.col("_f")).otherwise(F.col("full_name")).alias("full_name"), F.when(there, role).otherwise(F.col("role")).alias("role"), "language")


def created(checks: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """Checks with new pending ones for uploads (id, document_id); an id that is there already stays as it is (M8)."""
    fresh = asked.join(checks.select(F.col("id")), "id", "left_anti").select("id", "document_id")
    start = {"status": F.lit("pending"), "created_at": now, "attempts": F.lit(0), "delivery_attempts": F.lit(0)}
    rows = fresh.select("id", "document_id", *(v.alias(k) for k, v in start.items() if k in checks.columns))
    return checks.unionByName(rows, allowMissingColumns=True)


def looked_up(table: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of a key; the equality reaches the scan (M8)."""
    return table.where(F.col(key) == F.lit(value))


def told(table: DataFrame, news: DataFrame, key: str, column: str, known: tuple[str, ...]) -> DataFrame:
    """A column set anew for the keys in news, where its value is one of the known (M7: languages of users, states of documents)."""
    n = news.where(F.col(column).isin(*known)).groupBy(F.col(key).alias("_k")).agg(F.max(column).alias("_v"))
    both = table.join(n, table[key] == F.col("_k"), "left")
    return changed(both, F.col("_k").isNotNull(), **{column: F.col("_v")}).drop("_k", "_v")


def missing_columns(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Tables that lack columns, with the sorted names of those (X4); both: table_name, column_name."""
    lost = expected.join(found, ["table_name", "column_name"], "left_anti")
    return lost.groupBy("table_name").agg(F.array_sort(F.collect_set("column_name")).alias("missing"))


def columns_of(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name and column_name of some tables, as rows."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(name, c) for name, df in tables.items() for c in df.columns], "table_name string, column_name string")


# Fixed value: the stages of a check in their order.
STAGES = ("structure", "formatting", "text", "ai", "report")


def progress(events: DataFrame) -> DataFrame:
    """check_id, the furthest stage reached, its number and the message key of it (ST8); events: check_id, stage."""
    at = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    g = events.withColumn("_at", at).where("_at > 0").groupBy("check_id").agg(F.max("_at").cast("int").alias("step"))
    stage = F.element_at(F.array(*map(F.lit, STAGES)), F.col("step"))
    return g.select("check_id", "step", stage.alias("stage"), F.concat(F.lit("progress."), stage).alias("message_key"))


def resendable(checks: DataFrame, files: DataFrame, result: str) -> DataFrame:
    """Completed checks whose report (report_path) still exists, with the stored result and preset to render again from.

    Nothing is analysed anew; result: a struct DDL; files: path."""
    there = checks.where((F.col("status") == "completed") & F.col("result_snapshot").isNotNull()).join(files.select(F.col("path").alias("report_path")), "report_path", "left_semi")
    return there.select("id", "report_path", F.from_json("result_snapshot", result).alias("result"), "preset_snapshot")


def claimed(checks: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Pending checks among ids start running and count an attempt; others are left as they are (M4)."""
    mine = checks.join(ids.select(F.col("check_id").alias("_id")).distinct(), checks["id"] == F.col("_id"), "left")
    hit = F.col("_id").isNotNull() & (F.col("status") == "pending")
    return changed(mine, hit, status=F.lit("running"), attempts=F.col("attempts") + 1, started_at=now).drop("_id")


def completed(checks: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Checks with a result become completed with its score and snapshot (K2); doing it again changes nothing."""
    r = results.select(F.col("check_id").alias("_id"), F.col("score").alias("_score"), F.col("snapshot").alias("_snap"))
    both = checks.join(r, checks["id"] == F.col("_id"), "left")
    hit = F.col("_id").isNotNull() & (F.col("status") != "completed")
    return changed(both, hit, status=F.lit("completed"), score=F.col("_score"), result_snapshot=F.col("_snap"), completed_at=now).drop("_id", "_score", "_snap")


def replaced(findings: DataFrame, fresh: DataFrame) -> DataFrame:
    """Findings where those of a check are replaced by its fresh ones, long fields cut (K2)."""
    cut = fresh.withColumns({c: F.left(F.col(c), F.lit(FIELD_CHARS)) for c in ("location", "expected", "actual") if c in fresh.columns})
    return findings.join(fresh.select("check_id").distinct(), "check_id", "left_anti").unionByName(cut)


def failed(checks: DataFrame, errors: DataFrame, now: Column) -> DataFrame:
    """Checks with an error fail, unless they are completed (K3); details are cut."""
    e = errors.select(F.col("check_id").alias("_id"), F.col("detail").alias("_d"))
    both = checks.join(e, checks["id"] == F.col("_id"), "left")
    hit = F.col("_id").isNotNull() & (F.col("status") != "completed")
    return changed(both, hit, status=F.lit("failed"), error_detail=F.left("_d", F.lit(ERROR_CHARS)), completed_at=now).drop("_id", "_d")


def retried(checks: DataFrame, errors: DataFrame, now: Column, limits: Limits = Limits()) -> DataFrame:
    """After an error: domain errors fail at once, others go back to pending until attempts are used up (ST6)."""
    e = errors.select(F.col("check_id").alias("_id"), F.col("detail").alias("_d"), F.col("is_domain").alias("_k"))
    both = checks.join(e, checks["id"] == F.col("_id"), "left")
    hit = F.col("_id").isNotNull() & (F.col("status") == "running")
    over = F.col("_k") | (F.col("attempts") >= limits.attempts)
    out = changed(both, hit, error_detail=F.when(over, F.left("_d", F.lit(ERROR_CHARS))), completed_at=F.when(over, now), status=F.when(over, "failed").otherwise("pending"))
    return out.drop("_id", "_d", "_k")


def recovered(checks: DataFrame, now: Column, limits: Limits = Limits()) -> DataFrame:
    """Checks that run, or deliveries that send, for too long are pending again (ST3)."""
    old = F.col("started_at") < now - age(limits.job_seconds + limits.grace_seconds)
    out = changed(checks, (F.col("status") == "completed") & (F.col("delivery_status") == "sending") & old, delivery_status=F.lit("pending"))
    return changed(out, (F.col("status") == "running") & old, status=F.lit("pending"))


def dispatchable(checks: DataFrame, most: int = DISPATCH) -> DataFrame:
    """Ids that should be queued, lowest first (O3)."""
    due = (F.col("status") == "pending") | ((F.col("status") == "completed") & (F.col("delivery_status") == "pending"))
    return checks.where(F.col("job_payload").isNotNull() & due).select(F.col("id").alias("check_id")).orderBy("check_id").limit(most)


def queued(jobs: DataFrame) -> DataFrame:
    """One job for each check (K8, ST7)."""
    return jobs.withColumn("job_id", F.concat(F.lit("check:"), F.col("check_id").cast("string"))).dropDuplicates(["job_id"])


def delivered(checks: DataFrame, tried: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """After attempts to deliver (check_id, ok): sent, pending again, or failed when attempts are used up (ST5); results stay."""
    t = tried.select(F.col("check_id").alias("_id"), F.col("ok").alias("_ok"))
    both = checks.join(t, checks["id"] == F.col("_id"), "left")
    n = F.col("delivery_attempts") + 1
    state = F.when(F.col("_ok"), "sent").when(n >= limits.delivery_attempts, "failed").otherwise("pending")
    return changed(both, F.col("_id").isNotNull() & (F.col("status") == "completed") & (F.col("delivery_status") != "sent"), delivery_status=state, delivery_attempts=n).drop("_id", "_ok")


def expired(checks: DataFrame, now: Column, limits: Limits = Limits()) -> DataFrame:
    """Pending checks that waited too long have failed (ST4)."""
    old = (F.col("status") == "pending") & (F.col("created_at") < now - age(limits.file_hours * 3600))
    return changed(checks, old, status=F.lit("failed"), completed_at=now, error_detail=F.lit("Waited too long"))


def retained(checks: DataFrame, now: Column, limits: Limits = Limits()) -> DataFrame:
    """Checks without those that ended long ago and are not being sent (M5)."""
    old = (F.col("completed_at") < now - age(limits.result_days * 86400)) & F.col("status").isin(*ENDED) & (F.col("delivery_status") != "sending")
    return checks.where(~F.coalesce(old, F.lit(False)))


def without_history(checks: DataFrame, uploads: DataFrame, owner: Column) -> DataFrame:
    """Checks without the ended, not sending ones of an owner (M6)."""
    own = uploads.where(owner).select(F.col("id").alias("_d"))
    gone = checks.where(F.col("status").isin(*ENDED) & (F.coalesce("delivery_status", F.lit("")) != "sending")).join(own, F.col("document_id") == F.col("_d"), "left_semi").select("id")
    return checks.join(gone, "id", "left_anti")


def purgeable(files: DataFrame, checks: DataFrame, now: Column, hours: int) -> DataFrame:
    """Files older than so many hours that no active check needs (J12); files: path, modified_at."""
    needed = checks.where(F.col("status").isin(*ACTIVE)).select(F.get_json_object("job_payload", "$.docx_path").alias("path")).where("path IS NOT NULL")
    return files.where(F.col("modified_at") < now - age(hours * 3600)).join(needed, "path", "left_anti")


def statistics(checks: DataFrame, users: DataFrame) -> DataFrame:
    """Completed checks, mean score of complete reviews, users."""
    done = F.col("status") == "completed"
    c = checks.agg(F.count_if(done).alias("completed"), rounded(F.avg(F.when(done & F.col("ai_available"), F.col("score")))).alias("mean_score"))
    return c.withColumn("users", F.lit(users.count()).cast("long"))


def restored(checks: DataFrame, result: str, findings: DataFrame | None = None) -> DataFrame:
    """Results of checks from their snapshot, or for old ones without from the row's score and its findings (M3).

    result: a struct DDL; findings: check_id, seq and what a finding has, taken in the order of seq and not computed anew."""
    own = {"score": F.col("score"), "scoring_version": F.lit("legacy")}
    rows = checks
    if findings is not None:
        each = F.struct("seq", *(c for c in findings.columns if c not in ("check_id", "seq")))
        kept = findings.groupBy(F.col("check_id").alias("_c")).agg(F.array_sort(F.collect_list(each)).alias("_f"))
        rows, own["findings"] = checks.join(kept, checks["id"] == F.col("_c"), "left"), F.coalesce("_f", F.lit(None).cast(kept.schema["_f"].dataType))
    legacy = F.from_json(F.to_json(F.struct(*(v.alias(k) for k, v in own.items()))), result)
    out = F.when(F.col("result_snapshot").isNotNull(), F.from_json("result_snapshot", result)).otherwise(legacy)
    return rows.withColumn("result", out).select(*checks.columns, "result")


def check_json(checks: DataFrame, findings: DataFrame) -> DataFrame:
    """The public JSON of each check with its findings in order (K7)."""
    each = findings.groupBy("check_id").agg(F.array_sort(F.collect_list(F.struct("seq", "category", "severity", "rule_id", "message"))).alias("_f"))
    body = F.struct(F.col("id"), "status", "score", F.transform(F.coalesce("_f", F.array().cast("array<struct<seq:int,category:string,severity:string,rule_id:string,message:string>>")), lambda f: f.dropFields("seq")).alias("findings"))
    return checks.join(each, checks["id"] == each["check_id"], "left").select("id", F.to_json(body).alias("json"))
