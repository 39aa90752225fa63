"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each level every child draws ln(u)/weight, with u hashed from
the document's key and the child's name; the largest draw wins. A child's weight is that of its shards, so
shares follow weights, and a changed weight moves documents only into or out of that subtree: all other
draws stay as they were. A new shard comes as a branch of its own at the top, so it takes documents from
everywhere, and only into itself.

Scale: the shard is an expression on the key, no shuffle. Slots need one: shards are cut into `chunks` by
the key's hash, chunks are numbered apart, and a table of shards x chunks row counts (bounded, broadcast)
says where each chunk begins. The text never leaves the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]
EIGHT: Tree = {"r0": {"k0": {0: 1.0, 1: 1.0}, "k1": {2: 1.0, 3: 1.0}}, "r1": {"k2": {4: 1.0, 5: 1.0}, "k3": {6: 1.0, 7: 1.0}}}


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """One more shard, in a region of its own."""
    shard = 1 + max(s for racks in tree.values() for shards in racks.values() for s in shards)
    return tree | {f"r+{shard}": {f"k+{shard}": {shard: weight}}}


def weight(node) -> float:
    return sum(map(weight, node.values())) if isinstance(node, dict) else float(node)


def place(key: str, tree, path: str = "", dialect: str = "spark") -> str:
    """SQL for the shard of a text expression; Spark and DuckDB read it alike, but for how they parse hex digits."""
    if len(tree) == 1:
        ((name, child),) = tree.items()
        return place(key, child, f"{path}/{name}", dialect) if isinstance(child, dict) else str(name)

    def draw(name, child) -> str:
        digits = f"substring(md5(concat({key}, '{path}/{name}')), 1, 13)"
        number = f"conv({digits}, 16, 10)" if dialect == "spark" else f"('0x' || {digits})::UBIGINT"
        return f"ln((CAST({number} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE)) / CAST({weight(child)} AS DOUBLE)"

    names = list(tree)
    draws = {n: draw(n, tree[n]) for n in names}
    inner = {n: place(key, tree[n], f"{path}/{n}", dialect) if isinstance(tree[n], dict) else str(n) for n in names}
    cases = []
    for i, n in enumerate(names[:-1]):
        wins = " AND ".join(f"{draws[n]} {'>=' if j > i else '>'} {draws[m]}" for j, m in enumerate(names) if j != i)
        cases.append(f"WHEN {wins} THEN {inner[n]}")
    return f"(CASE {' '.join(cases)} ELSE {inner[names[-1]]} END)"


def chunk_of(key: str, chunks: int, dialect: str = "spark") -> str:
    digits = f"substring(md5({key}), 26, 7)"
    return f"CAST(CAST({f'conv({digits}, 16, 10)' if dialect == 'spark' else f"('0x' || {digits})::UBIGINT"} AS BIGINT) % {chunks} AS INT)"


def shard(docs: DataFrame, tree: Tree = EIGHT, chunks: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `key`: the key and the tree decide, nothing else. A null key counts as the word null; a null text has size 1 and the
    crc32 of no bytes. Rows with the same key share a shard and get slots of their own, in the order of crc32 and size.
    Other columns are ignored. A shard's slots are numbered in `chunks` parts, 256 or as many as hold a quarter million rows each:
    which slot a row gets depends on that, its shard never does.
    """
    chunks = chunks or max(256, docs.count() // (8 << 18))
    name = f"coalesce(CAST(`{key}` AS STRING), 'null')"
    where = {"shard": F.expr(place(name, tree)).cast("int"), "chunk": F.expr(chunk_of(name, chunks))}
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        *(c.alias(n) for n, c in where.items()),
        F.expr(place(name, grown(tree))).cast("int").alias("grown_shard"),
    )
    counts = docs.select(*(c.alias(n) for n, c in where.items())).groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    at: Column = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("at", at).join(F.broadcast(starts), ["shard", "chunk"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard"
    )


def oracle(chunks: int = 256) -> str:
    name = "coalesce(CAST(doc_id AS VARCHAR), 'null')"
    step = "list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"""
WITH t AS (SELECT list_transform(range(256), lambda i: {step}) AS crc),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
e AS (SELECT doc_id, octet_length(b) + 1 AS size, list_transform(regexp_extract_all(hex(b), '..'), lambda x: ('0x' || x)::BIGINT) AS v FROM d),
f AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, v), lambda c, x: xor(c >> 8, t.crc[xor(c, x) % 256 + 1]))) AS text_crc32,
        {place(name, EIGHT, dialect="duckdb")} AS shard, {place(name, grown(EIGHT), dialect="duckdb")} AS grown_shard, {chunk_of(name, chunks, "duckdb")} AS chunk
      FROM e, t)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY chunk, doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, CAST(grown_shard AS INT) AS grown_shard
FROM f"""
