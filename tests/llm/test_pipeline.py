import shutil
import zlib
from collections import Counter

import brute
import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from folio.llm import decontaminate, hilbert, mixing, quality


def test_pipeline_against_its_parts(spark, sf_dir):
    """Each stage is held against a plain version of what it must do to what came before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, step in pipeline.STAGES[:-1]:
        before, docs = docs, step(spark, docs, sf_dir)
        assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = before, docs
    ids = {n: [r.doc_id for r in d.collect()] for n, (_, d) in seen.items()}
    first, kept = seen["quality_rules"]
    assert sorted(ids["quality_rules"]) == sorted(r.doc_id for r in quality.judged(first).where("kept").collect())
    assert {r.doc_id for r in kept.collect()} <= {i for i, t in ((r.doc_id, r.text) for r in first.collect()) if not brute.base_counts(t)[-1]}
    want = brute.near_copies([(r.doc_id, r.text) for r in kept.collect()])
    assert sorted(ids["ngram_jaccard_join"]) == sorted(i for i, (c, _) in want.items() if c == i)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute.leaks([(r.doc_id, r.text) for r in seen["ngram_jaccard_join"][1].collect()], items) if r[5]}
    assert sorted(ids["decontamination"]) == sorted(set(ids["ngram_jaccard_join"]) - bad)
    plan = {r.doc_id: r.copies for r in mixing.mixed(seen["decontamination"][1]).collect()}
    assert Counter(ids["source_mixing"]) == Counter({i: n for i, n in plan.items() if n})
    last = pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.columns == [*docs.columns, *hilbert.ADDED]
    assert placed_rows(last) == plain_shards(docs.collect(), hilbert.SHARDS)
    whole = pipeline.run(spark, sf_dir)
    assert placed_rows(whole) == placed_rows(last)
    assert {(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in whole.collect()} <= {tuple(r) for r in first.select("doc_id", "text", "lang", "source", "n_chars").collect()}


def placed_rows(df):
    return sorted((r.shard, r.slot, r.doc_id, r.text, r.lang, r.source) for r in df.collect())


def plain_shards(rows, shards):
    """The same from the cells and the curve's walk, by sorting."""
    def cells(values):
        n, out, before = Counter(values), {}, 0
        for v in sorted(n, key=lambda v: (v is not None, v or "")):
            out[v] = before * 2**hilbert.BITS // len(values)
            before += n[v]
        return out

    def index(x):
        """Along the curve, by transposing axes (the usual bitwise walk), with the curve's own first axes."""
        e = d = h = 0
        n = len(x)
        gray = lambda i: i ^ (i >> 1)
        turn = lambda v, k: ((v >> k) | (v << (n - k))) & (2**n - 1)
        for bit in range(hilbert.BITS - 1, -1, -1):
            at = sum((c >> bit & 1) << k for k, c in enumerate(x))
            w = next(i for i in range(2**n) if gray(i) == turn(at ^ e, (d + 1) % n))
            start = 0 if w == 0 else gray(2 * ((w - 1) // 2))
            e ^= turn(start, (n - (d + 1) % n) % n)
            odd = w if w % 2 else w - 1
            ones = 0
            while w and odd >> ones & 1:
                ones += 1
            d = (d + ones % n + 1) % n
            h = h * 2**n + w
        return h

    lang, source = cells([r.lang for r in rows]), cells([r.source for r in rows])
    size = lambda r: len((r.text or "").encode()) + 8
    key = lambda r: (index([lang[r.lang], source[r.source], min(size(r).bit_length(), 2**hilbert.BITS - 1)]), zlib.crc32((r.text or "").encode()), r.doc_id)
    out, slots = [], Counter()
    for k, r in enumerate(sorted(rows, key=key)):
        shard = k * shards // len(rows)
        out.append((shard, slots[shard], r.doc_id, r.text, r.lang, r.source))
        slots[shard] += 1
    return sorted(out)


def test_pipeline_of_nothing(spark, tmp_path, sf_dir):
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, step in pipeline.STAGES:
        empty = step(spark, empty, sf_dir)
    assert empty.collect() == []
    assert decontaminate.WINDOW == 10


def test_pipeline_runs_on_nothing_and_on_odd_rows(spark, tmp_path, sf_dir):
    """run() on an empty folder, and on nulls, repeated ids and columns with clashing names."""
    shutil.copytree(sf_dir, tmp_path / "in")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, rows in (("empty", docs.limit(0)), ("odd", odd(docs))):
        folder = tmp_path / name
        folder.mkdir()
        shutil.copy(f"{sf_dir}/benchmark.parquet", folder / "benchmark.parquet")
        rows.write.parquet(str(folder / "documents.parquet"))
        got = pipeline.run(spark, str(folder))
        assert got.columns[:5] == docs.columns[:5]
        if name == "empty":
            assert got.collect() == []
        else:
            assert {r.in_shard for r in got.collect()} == {"clash"} and {r.row for r in got.collect()} == {"clash"}
            texts = {r.text for r in got.collect()}
            assert None not in texts and got.where("doc_id IS NULL").count() > 0


def odd(docs):
    some = docs.select("doc_id", "text", "lang", "source", "n_chars").limit(60)
    none = some.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    null = some.limit(2).withColumn("text", F.lit(None).cast("string"))
    twice = some.limit(5).withColumn("doc_id", F.lit(7).cast("long"))
    lost = some.limit(5).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    return some.union(none).union(null).union(twice).union(lost).withColumns({c: F.lit("clash") for c in ("shard", "row", "rank", "rid", "size", "mark", "_first", "_copy", "copies")})
