"""Sharding by histogram sort.

Every row gets a 62-bit key: 28 bits of the text's MD5, 20 bits of the doc_id's, then 14 bits that differ from row to row,
so that equal texts lie together and yet a group of any size can be cut, one of equal rows too. Splitters are found by counting, across partitions, the exact bytes below evenly
spaced probe keys and narrowing each splitter's interval to the probe cell that its target falls in, until the splitters
meet their tolerance. Only interval and cell counts reach the driver, a number that does not depend on the data. Then
rows are exchanged once, to ranges that hold equal bytes, and numbered there.

Shard splitters have tolerance 0: the row whose bytes cross a multiple of total / shards begins the next shard, so shards
differ from the ideal by one row at most. Ranges within a shard may be off by ``RANGE_TOLERANCE``.

A null text has size 1 and the checksum of no bytes. Rows with the same doc_id and text lie side by side, on both sides of
a splitter where it cuts them; which of them lies where is open, as they are equal. A null doc_id counts as an empty one.
Of a text only its size and digests are looked at,
whatever its length. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrose.llm.common import written

SHARDS = 8
TEXT_DIGITS, ID_DIGITS, ROW_BITS = 7, 5, 14
KEY_BITS = 4 * (TEXT_DIGITS + ID_DIGITS) + ROW_BITS
#: Cells per splitter and round; the fewest ranges per shard and the rows that a range should hold, and how far a range's
#: bytes may be off.
CELL_BITS = 6
RANGES_PER_SHARD, RANGE_ROWS, RANGE_TOLERANCE = 16, 2_000_000, 0.1


def key_of(text: Column, doc_id: Column) -> Column:
    digits = F.concat(F.substring(F.md5(text.cast("binary")), 1, TEXT_DIGITS), F.substring(F.md5(doc_id.cast("binary")), 1, ID_DIGITS))
    return F.shiftleft(F.conv(digits, 16, 10).cast("bigint"), ROW_BITS)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, checksum and key of every row."""
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    row = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND((1 << ROW_BITS) - 1)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key_of(text, doc_id).bitwiseOR(row).alias("key"))


def _at_most(edges: list[int], key: Column) -> Column:
    """How many of the ascending ``edges`` are not above the key, by halving steps."""
    if not edges:
        return F.lit(0)
    #: One literal, whatever its length.
    listed = F.split(F.lit(",".join(map(str, edges))), ",").cast("array<bigint>")
    steps = F.array(*(F.lit(1 << b) for b in range(len(edges).bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(listed, n + step - 1) <= key, n + step).otherwise(n))


def splitters(rows: DataFrame, parts: int, exact_every: int, total: int, tolerance: float = RANGE_TOLERANCE) -> list[int]:
    """The first keys of parts 1, 2, ...: every ``exact_every``-th exact, the others within the tolerance."""
    span = 1 << KEY_BITS
    #: By part: the interval [low, low + width) that its splitter lies in, and the bytes below it.
    found = {j: [0, span, 0] for j in range(1, parts)}
    done: dict[int, int] = {}
    while found:
        intervals = sorted({(low, width) for low, width, _ in found.values()})
        #: Intervals do not meet; a key lies in the last one that begins at or before it, or in none.
        lows, widths = (F.split(F.lit(",".join(str(x[k]) for x in intervals)), ",").cast("array<bigint>") for k in (0, 1))
        number = _at_most([low for low, _ in intervals], F.col("key"))
        beyond = F.col("key") - F.get(lows, number - 1)
        inside = beyond < F.get(widths, number - 1)
        cell = F.expr("beyond div greatest(1, width)")
        counted = rows.select("size", (number - 1).alias("number"), beyond.alias("beyond"), F.shiftright(F.get(widths, number - 1), CELL_BITS).alias("width"), inside.alias("inside")).filter("inside").select("number", cell.alias("cell"), "size").groupBy("number", "cell").agg(F.sum("size").alias("bytes")).collect()
        cells: dict[int, list[tuple[int, int]]] = {}
        for r in sorted(counted):
            cells.setdefault(r.number, []).append((r.cell, r.bytes))
        for j, (low, width, below) in list(found.items()):
            step, target = max(1, width >> CELL_BITS), j * total
            for at, size in cells.get(intervals.index((low, width)), []):
                if (below + size) * parts > target:
                    low += at * step
                    break
                below += size
            found[j] = [low, step, below]
            near = j % exact_every and target - below * parts <= tolerance * total
            if step == 1 or near:
                done[j] = low
                del found[j]
    return [done[j] for j in range(1, parts)]


def shard(docs: DataFrame, shards: int = SHARDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Every row with its shard, and its slot in it by key."""
    rows = written(keyed(docs), "keys")
    whole = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    total, ranges_per_shard = whole.bytes or 0, max(RANGES_PER_SHARD, -(-whole.n // (shards * range_rows)))
    first = splitters(rows, shards * ranges_per_shard, ranges_per_shard, total) if total else []
    part = _at_most(first, F.col("key"))
    rows = rows.withColumn("part", part).withColumn("shard", F.expr(f"part div {ranges_per_shard}").cast("int"))
    counts = {r.part: r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, seen = [], 0
    for p in range(shards * ranges_per_shard):
        seen = 0 if p % ranges_per_shard == 0 else seen
        before.append(seen)
        seen += counts.get(p, 0)
    inside = F.row_number().over(Window.partitionBy("part").orderBy("key", "doc_id", "text_crc32", "size"))
    slot = F.get(F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>"), F.col("part")) + inside - 1
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


SQL = """
WITH k AS (SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size,
                  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b,
                  ('0x' || substr(md5(coalesce(text, '')), 1, 7) || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 5))::BIGINT AS key FROM documents),
c AS (SELECT doc_id, size, key, xor(4294967295, coalesce(list_reduce(b, lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1))), 4294967295), 4294967295)) AS text_crc32 FROM k),
s AS (SELECT *, sum(size) OVER (ORDER BY key RANGE UNBOUNDED PRECEDING)::BIGINT AS upto, sum(size) OVER ()::BIGINT AS total FROM c),
n AS (SELECT *, ((8 * upto - 1) // total)::INTEGER AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY key, doc_id, text_crc32, size) - 1)::BIGINT AS slot,
       CAST(NULL AS INTEGER) AS grown_shard FROM n
"""
