"""Sharding by a Hilbert curve through metadata.

Language, source and text size are quantised to a few bits each; the curve index over the cells
orders the documents, and equal runs of that order become shards, so that a shard spans a small box
of all three dimensions and readers can prune it by any of them. The law is `rows`: shard counts
differ by one at most. Ties go by the text's checksum and then doc_id, so equal texts lie together.

Strings are quantised by rank weighted with rows: the cell of a value is the share of rows below it,
so common sources get cells of their own and the order of names is kept.

`placed` carries all columns along, in the order of the curve, so that the rows are ready to be written by
shard; what it adds has the names of ADDED, and a column of the input with such a name becomes in_<name>.

Edge cases: null text has size 8 and checksum 0; null lang or source come first; repeated rows and copies are
neighbours, told apart by shard and slot; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.base import ranked, stage

SHARDS = 24
DIMS, BITS = 3, 5
ADDED = ("size", "text_crc32", "curve", "law", "shard", "slot", "grown_shard")


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """The index along the Hilbert curve of a cell in len(cells) dimensions.

    Each level takes one bit of every coordinate. The curve's orientation is held as the exclusive-or
    mask and the rotation that later levels see; Gray code ranks the sub-cubes on the way."""
    n = len(cells)
    full = (1 << n) - 1
    word = lambda i: sum((F.call_function("shiftleft", F.call_function("shiftright", c, i).bitwiseAND(1), F.lit(k)) for k, c in enumerate(cells)), F.lit(0))

    def turn(x: Column, by: Column) -> Column:
        """Rotates the n bits of x to the right."""
        return F.call_function("shiftright", x, by).bitwiseOR(F.call_function("shiftleft", x, F.lit(n) - by)).bitwiseAND(full)

    def gray_rank(g: Column) -> Column:
        out, k = g, 1
        while k < n:
            out = out.bitwiseXOR(F.call_function("shiftright", out, F.lit(k)))
            k *= 2
        return out

    entry, rotation = [], []
    for w in range(1 << n):
        low = 2 * ((w - 1) // 2) if w else 0
        entry.append(low ^ (low >> 1))
        odd = w if w % 2 else w - 1
        ones = 0
        while w and odd >> ones & 1:
            ones += 1
        rotation.append(ones % n)
    entries, rotations = F.array(*map(F.lit, entry)), F.array(*map(F.lit, rotation))
    back = lambda x, by: turn(x, (F.lit(n) - by) % n)
    start = F.struct(F.lit(0).alias("e"), F.lit(0).alias("r"), F.lit(0).cast("long").alias("h"))

    def step(s: Column, bit_word: Column) -> Column:
        w = gray_rank(turn(bit_word.bitwiseXOR(s["e"]), (s["r"] + 1) % n))
        e = s["e"].bitwiseXOR(back(F.get(entries, w), (s["r"] + 1) % n))
        return F.struct(e.alias("e"), ((s["r"] + F.get(rotations, w) + 1) % n).alias("r"), (s["h"] * (full + 1) + w).alias("h"))

    words = F.array(*(word(F.lit(i)).cast("int") for i in range(bits - 1, -1, -1)))
    return F.aggregate(words, start, step, lambda s: s["h"])


def text_size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8


def name_cells(rows: DataFrame, column: str, cell: str, bits: int = BITS) -> DataFrame:
    """column and cell for each distinct value: the share of rows before it, in 2**bits steps."""
    counts = rows.groupBy(column).agg(F.count("*").alias("_n"))
    total = max(rows.count(), 1)
    order = [F.col(column).asc_nulls_first()]
    parts = ranked(counts, order, "_rank", f"cells-{column}")
    # Prefix sums of counts: whole blocks of ranks first, then inside a block; no task sees all values.
    parts = parts.withColumn("_block", F.call_function("div", F.col("_rank"), F.lit(4096)))
    blocks = parts.groupBy("_block").agg(F.sum("_n").alias("_bn"))
    blocks = blocks.select("_block", F.coalesce(F.sum("_bn").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_bb"))
    inside = W.partitionBy("_block").orderBy("_rank").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.join(blocks, "_block").withColumn("_before", F.col("_bb") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return parts.select(F.col(column), F.call_function("div", F.col("_before") * (1 << bits), F.lit(total)).cast("int").alias(cell))


def numbered(docs: DataFrame, shards: int, carried: list[str]) -> DataFrame:
    """row (the carried columns) and ADDED of each document. Carried rows move once, into the order of the curve."""
    # What the cells need is written without the texts; the rows themselves are written once, in their order.
    names = stage(docs.select("lang", "source"), "shard-names")
    lang = stage(name_cells(names, "lang", "x"), "lang-cells").withColumnRenamed("lang", "_lang")
    source = stage(name_cells(names, "source", "y"), "source-cells").withColumnRenamed("source", "_source")
    total = F.lit(max(names.count(), 1)).cast("long")
    row = F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row")
    rows = docs.select("doc_id", "lang", "source", text_size().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), row)
    log_size = F.least(F.length(F.bin("size")), F.lit((1 << BITS) - 1))
    rows = rows.join(lang, rows.lang.eqNullSafe(lang._lang)).join(source, rows.source.eqNullSafe(source._source))
    rows = rows.select("doc_id", "size", "text_crc32", hilbert_index([F.col("x"), F.col("y"), log_size.cast("int")]).alias("curve"), "row")
    rows = ranked(rows, [F.col("curve"), F.col("text_crc32"), F.col("doc_id")], "rank", "curve")
    shard = F.call_function("div", F.col("rank") * shards, total)
    first = F.call_function("div", shard * total + (shards - 1), F.lit(shards))
    return rows.select("row", "size", "text_crc32", "curve", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, curve, law, shard, slot and grown_shard (null under this law)."""
    return numbered(docs, shards, ["doc_id"]).select("row.doc_id", *ADDED)


def placed(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All columns of the documents, and ADDED."""
    names: dict[str, str] = {}
    for c in docs.columns:  # a clashing name gets in_ before it, as often as that clashes again
        name = c
        while name in ADDED or (name != c and (name in docs.columns or name in names.values())):
            name = f"in_{name}"
        names[c] = name
    return numbered(docs, shards, docs.columns).select(*(F.col("row").getField(c).alias(n) for c, n in names.items()), *ADDED)


def written(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes the documents by shard, in the order of the curve: a folder for each shard, whose files span a small box of all dimensions."""
    placed(docs, shards).write.partitionBy("shard").parquet(path)


def sharded_sql(docs: str = "documents") -> str:
    """The same rows for DuckDB: the levels of the curve are unrolled into a chain of selects."""
    n, full = DIMS, (1 << DIMS) - 1
    entry = [0] + [((w - 1) // 2 * 2) ^ ((w - 1) // 2 * 2 >> 1) for w in range(1, full + 1)]
    rot = []
    for w in range(full + 1):
        odd, ones = (w if w % 2 else w - 1), 0
        while w and odd >> ones & 1:
            ones += 1
        rot.append(ones % n)
    turn = lambda x, by: f"((({x} >> ({by})) | ({x} << ({n} - ({by})))) & {full})"
    steps, last = [], "s0"
    for k, i in enumerate(range(BITS - 1, -1, -1)):
        w = f"(((x >> {i}) & 1) | (((y >> {i}) & 1) << 1) | (((z >> {i}) & 1) << 2))"
        t = turn(f"xor({w}, e)", f"(r + 1) % {n}")
        steps.append(f"g{k} AS (SELECT *, {t} AS g FROM {last})")
        steps.append(f"v{k} AS (SELECT *, xor(xor(xor(g, g >> 1), xor(g, g >> 1) >> 2), 0) AS w FROM g{k})")
        back = turn(f"{entry}[w + 1]", f"({n} - (r + 1) % {n}) % {n}")
        steps.append(f"s{k + 1} AS (SELECT doc_id, size, crc, x, y, z, xor(e, {back}) AS e, (r + {rot}[w + 1] + 1) % {n} AS r, h * {full + 1} + w AS h FROM v{k})")
        last = f"s{k + 1}"
    cell = lambda c: f"(sum(count(*)) OVER (ORDER BY {c} NULLS FIRST) - count(*)) * {1 << BITS} // sum(count(*)) OVER ()"
    return f"""
WITH b AS (SELECT doc_id, lang, source, coalesce(octet_length(encode(text)), 0)::BIGINT + 8 AS size, coalesce(text, '') AS text FROM {docs}),
x AS (SELECT *, hex(encode(text)) AS hx FROM b), c AS (SELECT *, ({crc32_sql("hx")}) AS crc FROM x),
lx AS (SELECT lang, ({cell("lang")})::INT AS x FROM b GROUP BY lang), sy AS (SELECT source, ({cell("source")})::INT AS y FROM b GROUP BY source),
s0 AS (SELECT doc_id, size, crc, x, y, least(length(bin(size)), {(1 << BITS) - 1})::INT AS z, 0 AS e, 0 AS r, 0::BIGINT AS h
       FROM c JOIN lx ON c.lang IS NOT DISTINCT FROM lx.lang JOIN sy ON c.source IS NOT DISTINCT FROM sy.source),
{", ".join(steps)},
o AS (SELECT *, row_number() OVER (ORDER BY h, crc, doc_id) - 1 AS rank, count(*) OVER () AS total FROM {last})
SELECT doc_id, size, crc AS text_crc32, h AS curve, 'rows' AS law, (rank * {SHARDS} // total)::INT AS shard,
  (rank - ((rank * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard FROM o"""


def crc32_sql(hx: str) -> str:
    """CRC-32 in SQL of bytes given as hexadecimal text: a fold over bytes through the table of the polynomial."""
    table = []
    for k in range(256):
        v = k
        for _ in range(8):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        table.append(v)
    code = f"list_transform(range(1, length({hx}) // 2 + 1), lambda i: ('0x' || substr({hx}, 2 * i - 1, 2))::BIGINT)"
    return f"xor(list_reduce({code}, lambda a, b: xor(a >> 8, {table}[xor(a & 255, b) + 1]), 4294967295::BIGINT), 4294967295)"
