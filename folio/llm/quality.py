"""Quality rules with thresholds that follow each language and source.

Every document gets a few integer measures. A histogram sketch with a fixed relative error holds
their distribution for each group: language, source and size class (the bit length of the word count,
since short texts vary more). Sketches merge by adding counts: a source's sketch in a language is the
sum of its size classes', a language's sketch of a size class the sum of its sources'. A group that is small or
constant takes the wider fence of these two, so that neither a source's habits nor a short text's spread counts
against a document; where both are small the whole language speaks, then all.

A fence lies REACH tail distances beyond a letter value: the quartile, or where that does not differ
from the median the eighth, the sixteenth and so on to the last of LETTERS. The distance is the one from
the median to the letter value, so no width is fixed: where nothing varies there is no fence. For
normal data the fence is the usual one of three quartile distances. A document outside any fence of its
group is rejected. Counts are exact integers, so reruns and other engines agree.

Edge cases: null text has no words and fails the base rules; empty texts likewise; null lang or
source are groups of their own; repeated rows, rows that repeat an id with another text and rows
without an id are each judged by themselves; an empty table gives no rows; other columns are carried
along whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.base import SPACE_CHARS, SPACE_RE, stage

#: Measure, and the sides on which it has fences.
MEASURES = (("word_length", ("low", "high")), ("punctuation", ("high",)), ("capitals", ("high",)))
FENCES = tuple((m, side) for m, sides in MEASURES for side in sides)
#: Fences lie this many tail distances outside the letter value; 6 is three quartile distances of a symmetric group.
REACH = 6
#: Letter values are the 1/2**k tails for these k.
LETTERS = (2, 3, 4, 5, 6)
#: A group's own sketch counts from so many documents.
MIN_DOCS = 30
#: Bits that a sketch bin keeps: a relative error of at most 1/32.
BITS = 6
PUNCTUATION = r"[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"


def bin_of(v: Column) -> Column:
    """The lower end of v's bin, for whole v from 0."""
    low = F.greatest(F.length(F.bin(v)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, low), low)


def measured(docs: DataFrame, carried: list[str]) -> DataFrame:
    """row (the carried columns), lang, source, size_class, the base counts and the measures of each document."""
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"), "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(SPACE_CHARS))
    d = d.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE + "+")))
    d = d.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.size("hashes")
    d = d.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != ""))
    five = lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(5)))
    d = d.withColumn("windows", F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), five)).otherwise(F.array().cast("array<bigint>")))
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    d = d.select(
        "row", "lang", "source", n.cast("long").alias("n_words"), (F.length("text") - count(SPACE_RE)).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"), count(PUNCTUATION).alias("n_punctuation"), count("[A-Z]").alias("n_capitals"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "windows",
    )
    # Only texts with an equal pair of windows pay for the sort.
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed)).drop("windows")
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twins = F.filter("placed", lambda x, k: same(x, F.get("placed", k - 1)) | same(x, F.get("placed", k + 1)))
    d = d.withColumn("at", F.sort_array(F.transform(twins, lambda x: x["i"]))).drop("placed")
    covered = F.aggregate("at", F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n")), lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(5), i - s["last"])).alias("n")), lambda s: s["n"])
    chars, words = (F.greatest(F.col(c), F.lit(1)) for c in ("word_chars", "n_words"))
    per = lambda a, times, b: F.call_function("div", F.col(a) * times, b)
    return d.select(
        "row", "lang", "source", F.length(F.bin("n_words")).alias("size_class"), "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        per("word_chars", 100, words).alias("word_length"), per("n_punctuation", 10000, chars).alias("punctuation"), per("n_capitals", 10000, chars).alias("capitals"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


GROUP = ["lang", "source", "size_class"]
#: What a group falls back on: the wider of the second and third, then the fourth; the last is taken at any size.
CHAIN = (GROUP, ["lang", "source"], ["lang", "size_class"], ["lang"], [])


def sketches(measures: DataFrame) -> DataFrame:
    """Counts by group, measure and bin over the documents that pass the base rules."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bin_of(F.col(m)).alias("bin")) for m, _ in MEASURES)))
    rows = measures.where(~base_failed()).select(*GROUP, each.alias("x"))
    return rows.groupBy(*GROUP, "x.measure", "x.bin").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    """The sum of sketches over all columns of the group but those in by."""
    return sketch.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))


def tails(sketch: DataFrame, by: list[str], mark: object = "") -> DataFrame:
    """For each group and measure: documents and the fences low and high, null where no letter value differs from the median; columns with the given mark."""
    group = W.partitionBy(*by, "measure")
    run = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("all", F.sum("n").over(group))
    value = lambda part, of: F.min(F.when(F.col("upto") * of >= F.col("all") * part, F.col("bin")))
    letters = [value(part, 1 << k).alias(f"{side}{k}") for k in LETTERS for side, part in (("low", 1), ("high", (1 << k) - 1))]
    g = run.groupBy(*by, "measure").agg(F.max("all").alias("docs"), value(1, 2).alias("mid"), *letters)
    fence = lambda side: F.coalesce(*(F.when(F.col(f"{side}{k}") != F.col("mid"), F.col(f"{side}{k}") + (F.col(f"{side}{k}") - F.col("mid")) * REACH) for k in LETTERS)).alias(f"{side}_{mark}")
    return g.select(*by, "measure", F.col("docs").alias(f"n_{mark}"), fence("low"), fence("high"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row for each group: the lowest and highest value of each measure that is kept, null for no fence."""
    both = tails(sketch, GROUP, 0)
    for k, by in enumerate(CHAIN[1:], 1):
        wider = tails(merged(sketch, by), by, k).withColumnsRenamed({c: f"{c}_{k}" for c in (*by, "measure")})
        same = both["measure"] == wider[f"measure_{k}"]
        for c in by:
            same = same & both[c].eqNullSafe(wider[f"{c}_{k}"])
        both = both.join(wider, same).drop(*(f"{c}_{k}" for c in (*by, "measure")))

    def pick(side: str) -> Column:
        own = [F.when((F.col(f"n_{k}") >= MIN_DOCS) | F.lit(k == len(CHAIN) - 1), F.col(f"{side}_{k}")) for k in range(len(CHAIN))]
        wider = (F.least if side == "low" else F.greatest)(own[1], own[2])  # a null gives way
        return F.coalesce(own[0], wider, *own[3:]).alias(side)

    both = both.select(*GROUP, "measure", pick("low"), pick("high"))
    return both.groupBy(*GROUP).agg(*(F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{side}_{m}") for m, side in FENCES))


def verdicts(docs: DataFrame, carried: list[str]) -> DataFrame:
    """measured() with base_failed and kept of each document."""
    measures = stage(measured(docs, carried), "quality")
    limits = stage(fences(sketches(measures)), "fences").withColumnsRenamed({"lang": "_lang", "source": "_source", "size_class": "_class"})
    outside = F.lit(False)
    for m, side in FENCES:
        limit = F.col(f"{side}_{m}")
        outside = outside | F.coalesce(F.col(m) > limit if side == "high" else F.col(m) < limit, F.lit(False))
    same = measures.lang.eqNullSafe(limits["_lang"]) & measures.source.eqNullSafe(limits["_source"]) & (measures.size_class == limits["_class"])
    both = measures.join(limits, same, "left").withColumn("base_failed", base_failed())
    return both.withColumn("kept", ~F.col("base_failed") & ~outside)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of each document."""
    return verdicts(docs, ["doc_id"]).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept(docs: DataFrame) -> DataFrame:
    """The rows that are kept; columns as before. Texts are written once with their measures, and never shuffled by this operator unless the table of fences outgrows a broadcast."""
    return verdicts(docs, docs.columns).where("kept").select("row.*")


_BINS = " UNION ALL ".join(f"SELECT lang, source, size_class, '{m}' AS measure, ({m} >> greatest(length(bin({m})) - {BITS}, 0)) << greatest(length(bin({m})) - {BITS}, 0) AS bin FROM good" for m, _ in MEASURES)
_LIMITS = ", ".join(f"max({side}) FILTER (measure = '{m}') AS {side}_{m}" for m, side in FENCES)
_OUTSIDE = " OR ".join(f"coalesce(m.{m} {'>' if side == 'high' else '<'} f.{side}_{m}, false)" for m, side in FENCES)


def _tails(by: list[str], mark: int) -> str:
    value = lambda part, of: f"min(bin) FILTER (upto * {of} >= total * {part})"
    group = ", ".join([*by, "measure"])
    letters = ", ".join(f"{value(part, 1 << k)} AS {side}{k}" for k in LETTERS for side, part in (("low", 1), ("high", (1 << k) - 1)))
    fence = lambda side: "coalesce(" + ", ".join(f"CASE WHEN {side}{k} <> mid THEN {side}{k} + ({side}{k} - mid) * {REACH} END" for k in LETTERS) + f") AS {side}_{mark}"
    return f"""t{mark} AS (SELECT {group}, docs AS n_{mark}, {fence("low")}, {fence("high")} FROM (
    SELECT {group}, max(total) AS docs, {value(1, 2)} AS mid, {letters}
    FROM (SELECT *, sum(n) OVER (PARTITION BY {group} ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {group}) AS total
          FROM (SELECT {group}, bin, count(*) AS n FROM bins GROUP BY ALL)) GROUP BY {group}))"""


def _picked(side: str) -> str:
    own = [f"CASE WHEN n_{k} >= {MIN_DOCS} OR {k} = {len(CHAIN) - 1} THEN {side}_{k} END" for k in range(len(CHAIN))]
    return f"coalesce({own[0]}, {'least' if side == 'low' else 'greatest'}({own[1]}, {own[2]}), {', '.join(own[3:])}) AS {side}"


def judged_sql(docs: str = "documents") -> str:
    """The same rows for DuckDB."""
    count = lambda pattern: f"length(regexp_replace(text, '[^{pattern}]', '', 'g'))::BIGINT"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM {docs}),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i+4], ' ') AS g FROM w, unnest(generate_series(1, len(words) - 4)) AS t(i)),
rep AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY rid),
b AS (SELECT w.rid, doc_id, lang, source, len(words)::BIGINT AS n_words, length(bin(len(words))) AS size_class,
        (length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')))::BIGINT AS word_chars,
        {count("#*$%&|<>")} AS n_symbols, {count(PUNCTUATION[1:-1])} AS n_punctuation, {count("A-Z")} AS n_capitals,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov USING (rid)),
m AS (SELECT *, word_chars * 100 // greatest(n_words, 1) AS word_length, n_punctuation * 10000 // greatest(word_chars, 1) AS punctuation, n_capitals * 10000 // greatest(word_chars, 1) AS capitals,
        n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
good AS (SELECT * FROM m WHERE NOT base_failed), bins AS ({_BINS}),
{", ".join(_tails(by, k) for k, by in enumerate(CHAIN))},
p AS (SELECT {", ".join(f"t0.{c}" for c in GROUP)}, t0.measure, {_picked("low")}, {_picked("high")}
      FROM t0 {" ".join(f"JOIN t{k} ON " + " AND ".join(f"t0.{c} IS NOT DISTINCT FROM t{k}.{c}" for c in (*by, "measure")) for k, by in enumerate(CHAIN) if k)}),
fen AS (SELECT lang, source, size_class, {_LIMITS} FROM p GROUP BY lang, source, size_class)
SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed, NOT m.base_failed AND NOT ({_OUTSIDE}) AS kept
FROM m LEFT JOIN fen f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source AND m.size_class = f.size_class"""
