"""URL filters: rules by host and path, and a ratio of character models for all other URLs.

URLs that a rule decides are the examples. Four of five teach: one variable-order Markov model of characters learns from
the allowed, one from the blocked. An order is used where its context was seen often enough, each
order is smoothed towards the one below. The score of a URL is the mean log ratio of its characters;
the cut between allow and block is calibrated on the other examples, which the models never saw, at the
highest balanced accuracy. Which examples teach is told by the URL's digest alone.

Log ratios are rounded to millionths once per gram and summed as whole numbers, so sums don't depend
on order. Each distinct URL is scored once. Grams that make up at least LEAST_GRAM of all rows (at most 1 / LEAST_GRAM of
them) get their ratio by broadcast, the others by key, so no key is hot. DataFrame functions only.

Edge cases: a null URL or one without :// has empty host and path and is scored as it is (null as
empty); repeated rows are judged each; where either kind is missing among the held-out examples the cut is a ratio of
one; with no examples of either kind every ratio is one and undecided URLs are allowed; an empty table gives
no rows; other columns are not looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.base import LOWER, UPPER, ascii_lower, shuffle_parts, stage, unstage

#: (verdict, host, path): a rule fits the host and its subdomains, if the path begins so.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
ORDER = 3
#: A context counts from so many characters after it in the model's examples.
MIN_CONTEXT = 5
#: Weight of the order below, in characters.
LOWER_WEIGHT = 4.0
ALPHABET = 128.0
MILLION = 1_000_000
#: Width of a calibration bin, in millionths of the mean log ratio; bins beyond EDGE meet there.
STEP, EDGE = 10_000, 500
#: Examples whose digest begins so are kept from the models; three of sixteen.
HELD_OUT = ("0", "1", "2")
#: Share of all gram rows from which a gram's ratio is broadcast.
LEAST_GRAM = 1e-4
_BEGIN, _END = "\x02", "\x03"


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", ""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def ordered(rules=RULES) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))


def decided(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, and the longest fitting rule with its verdict (else null)."""
    host, path = host_and_path(F.col("url"))
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for kind, h, start in reversed(ordered(rules)):
        fits = ((F.col("host") == h) | F.endswith("host", F.lit(f".{h}"))) & F.startswith("path", F.lit(start))
        rule, verdict = F.when(fits, F.lit(h + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return p.select("*", rule.alias("rule"), verdict.alias("by_rule"))


def url_grams(urls: DataFrame) -> DataFrame:
    """url and its grams of ORDER + 1 characters, with how often each stands in it."""
    padded = F.concat(F.lit(_BEGIN * ORDER), ascii_lower(F.col("url")), F.lit(_END))
    at = F.sequence(F.lit(1), F.length("url") + 1)
    each = F.explode(F.transform(at, lambda i: F.substring(F.col("padded"), i, F.lit(ORDER + 1))))
    return urls.withColumn("padded", padded).select("url", each.alias("gram")).groupBy("url", "gram").agg(F.count("*").alias("times"))


def held_out(url: Column) -> Column:
    return F.left(F.md5(url.cast("binary")), F.lit(1)).isin(*HELD_OUT)


def gram_ratios(grams: DataFrame, examples: DataFrame) -> DataFrame:
    """gram, its rows n, and the log ratio of its last character after the others, in whole millionths.

    grams: url, gram, times of all URLs; examples: url, allowed and blocked (pages of it)."""
    seen = grams.join(examples, "url").groupBy("gram").agg(F.sum(F.col("times") * F.col("allowed")).alias("a"), F.sum(F.col("times") * F.col("blocked")).alias("b"))
    orders = F.explode(F.sequence(F.lit(0), F.lit(ORDER)))
    suffix = F.expr("right(gram, o + 1)")
    counts = stage(seen.select("a", "b", "gram", orders.alias("o")).select("o", suffix.alias("key"), "a", "b").groupBy("o", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "url-counts")
    contexts = counts.groupBy("o", F.expr("left(key, o)").alias("context")).agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"))
    wanted = grams.groupBy("gram").agg(F.count("*").alias("n")).select("gram", "n", orders.alias("o")).select("gram", "n", "o", suffix.alias("key"), F.expr("left(right(gram, o + 1), o)").alias("context"))
    steps = None
    # Without a context all grams share one key, and there are no more next characters than Unicode has: broadcast. Others join by key.
    for part, hint in ((F.col("o") == 0, "broadcast"), (F.col("o") > 0, "merge")):
        own = wanted.where(part).join(counts.where(part).hint(hint), ["o", "key"], "left").join(contexts.where(part).hint(hint), ["o", "context"], "left")
        steps = own if steps is None else steps.unionByName(own)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    steps = steps.groupBy("gram").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("o", zero("a"), zero("b"), zero("ca"), zero("cb")))).alias("orders"))

    def below(p: Column, n: Column, total: Column) -> Column:
        return F.when(total >= MIN_CONTEXT, (n + F.lit(LOWER_WEIGHT) * p) / (total + F.lit(LOWER_WEIGHT))).otherwise(p)

    start = F.struct(F.lit(1 / ALPHABET).alias("p"), F.lit(1 / ALPHABET).alias("q"))
    ratio = F.aggregate("orders", start, lambda s, x: F.struct(below(s["p"], x["a"], x["ca"]).alias("p"), below(s["q"], x["b"], x["cb"]).alias("q")), lambda s: F.round(F.log(s["p"] / s["q"]) * MILLION).cast("long"))
    out = stage(steps.select("gram", "n", ratio.alias("ratio")), "url-ratios")
    unstage(counts)
    return out


def scores(pages: DataFrame) -> DataFrame:
    """url and the bin of its mean log ratio; pages as decided() gives them."""
    urls = pages.groupBy("url").agg(F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked"))
    # URLs are short and their grams many: dealt out anew, so that not a few tasks write all grams.
    urls = urls.repartition(shuffle_parts(pages.sparkSession), "url")
    grams = stage(url_grams(urls.select("url")), "url-grams")
    ratios = gram_ratios(grams, urls.where((F.col("allowed") + F.col("blocked") > 0) & ~held_out(F.col("url"))))
    least = max(1.0, ratios.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * LEAST_GRAM)
    common, rare = ratios.where(F.col("n") >= least).select("gram", "ratio"), ratios.where(F.col("n") < least).select("gram", "ratio")
    near = grams.join(F.broadcast(common), "gram").select("url", "times", "ratio")
    far = grams.join(F.broadcast(common.select("gram")), "gram", "left_anti").join(rare.hint("merge"), "gram").select("url", "times", "ratio")
    total = near.unionByName(far).groupBy("url").agg(F.sum(F.col("ratio") * F.col("times")).alias("total"))
    mean = F.floor(F.col("total").cast("double") / (F.length("url") + 1) / STEP)
    return total.select("url", F.greatest(F.least(mean, F.lit(EDGE)), F.lit(-EDGE)).cast("int").alias("bin"))


def calibrated(binned: DataFrame) -> int:
    """The least bin that is allowed: the first edge of highest balanced accuracy on held-out pages that rules decide,
    moved to the middle between the bins of theirs that it parts."""
    n = binned.where(F.col("by_rule").isNotNull() & held_out(F.col("url"))).groupBy("bin").agg(F.count_if(F.col("by_rule") == "allow").alias("a"), F.count_if(F.col("by_rule") == "block").alias("b"))
    rows = sorted(tuple(r) for r in n.collect())  # at most 2 * EDGE + 1 rows
    allowed, blocked = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not allowed or not blocked:
        return 0
    best, cut, above, under, before = -1, 0, allowed, 0, None
    for at, a, b in rows:
        if (value := above * blocked + under * allowed) > best:
            best, cut = value, at if before is None else at - (at - before) // 2
        above, under, before = above - a, under + b, at
    return cut


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of each page."""
    p = stage(decided(pages, rules), "pages")
    binned = stage(p.join(scores(p), "url"), "page-bins")
    cut = calibrated(binned)
    verdict = F.coalesce("by_rule", F.when(F.col("bin") >= cut, F.lit("allow")).otherwise(F.lit("block")))
    return binned.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


_HELD = "left(md5(url), 1) IN (" + ", ".join(f"'{x}'" for x in HELD_OUT) + ")"


def judged_sql(pages: str = "pages", rules=RULES) -> str:
    fits = lambda h, s: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{s}'))"
    rule = " ".join(f"WHEN {fits(h, s)} THEN '{h + s}'" for _, h, s in ordered(rules))
    verdict = " ".join(f"WHEN {fits(h, s)} THEN '{k}'" for k, h, s in ordered(rules))
    fold, last = [], "f0"
    for o in range(ORDER + 1):
        step = lambda p, n, c: f"CASE WHEN coalesce({c}, 0) >= {MIN_CONTEXT} THEN (coalesce({n}, 0)::DOUBLE + {LOWER_WEIGHT}::DOUBLE * {p}) / (coalesce({c}, 0)::DOUBLE + {LOWER_WEIGHT}::DOUBLE) ELSE {p} END"
        fold.append(f"f{o + 1} AS (SELECT {last}.gram, {step('p', 'n.a', 'c.ca')} AS p, {step('q', 'n.b', 'c.cb')} AS q FROM {last} LEFT JOIN n ON n.o = {o} AND n.key = right(gram, {o + 1}) LEFT JOIN c ON c.o = {o} AND c.context = left(right(gram, {o + 1}), {o}))")
        last = f"f{o + 1}"
    return rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM {pages}),
h AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
p AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS by_rule FROM h),
d AS (SELECT url, repeat(chr(2), {ORDER}) || translate(url, '{UPPER}', '{LOWER}') || chr(3) AS s FROM (SELECT DISTINCT url FROM p)),
g AS (SELECT url, substr(s, i, {ORDER + 1}) AS gram FROM d, unnest(generate_series(1, length(url) + 1)) AS t(i)),
e AS (SELECT gram, count(*) FILTER (by_rule = 'allow') AS a, count(*) FILTER (by_rule = 'block') AS b FROM g JOIN p USING (url) WHERE by_rule IS NOT NULL AND NOT {_HELD} GROUP BY gram),
n AS (SELECT o, right(gram, o + 1) AS key, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM e, (SELECT unnest(range(0, {ORDER + 1}))::INT AS o) GROUP BY ALL),
c AS (SELECT o, left(key, o) AS context, sum(a)::BIGINT AS ca, sum(b)::BIGINT AS cb FROM n GROUP BY ALL),
f0 AS (SELECT DISTINCT gram, {1 / ALPHABET}::DOUBLE AS p, {1 / ALPHABET}::DOUBLE AS q FROM g), {", ".join(fold)},
r AS (SELECT gram, round(ln(p / q) * {MILLION})::BIGINT AS ratio FROM {last}),
m AS (SELECT url, greatest(least(floor(sum(ratio)::DOUBLE / (length(url) + 1) / {STEP}), {EDGE}), {-EDGE})::INT AS bin FROM g JOIN r USING (gram) GROUP BY url),
b AS (SELECT p.*, bin FROM p JOIN m USING (url)),
k AS (SELECT bin, lag(bin) OVER (ORDER BY bin) AS before, a, b FROM (SELECT bin, count(*) FILTER (by_rule = 'allow') AS a, count(*) FILTER (by_rule = 'block') AS b FROM b WHERE by_rule IS NOT NULL AND {_HELD} GROUP BY bin)),
v AS (SELECT bin, before, (sum(a) OVER () - coalesce(sum(a) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * sum(b) OVER () + coalesce(sum(b) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * sum(a) OVER () AS value, sum(a) OVER () * sum(b) OVER () AS pairs FROM k),
w AS (SELECT CASE WHEN max(pairs) > 0 THEN arg_min(bin - (bin - coalesce(before, bin)) // 2, (-value, bin)) ELSE 0 END AS cut FROM v)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN bin >= cut THEN 'allow' ELSE 'block' END) AS verdict FROM b, w"""
