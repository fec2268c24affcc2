"""Assignment of documents to shards by a hierarchical weighted hash tree.

The tree has three levels: regions hold racks, racks hold shards.  A document
descends it, at each level drawing one number for every child from its id and
the child's name, and follows the child with the least -ln(u) / weight.  A
child is so chosen in proportion to its weight, and a draw depends on nothing
but the id, the child's name and its weight: when a weight changes, documents
move only into or out of the subtrees on that path.  A shard that is added as a
subtree of its own therefore takes documents only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut


@dataclass(frozen=True)
class Rack:
    name: str
    #: Shard number and weight.
    shards: tuple[tuple[int, float], ...]

    @property
    def weight(self) -> float:
        return sum(w for _, w in self.shards)


@dataclass(frozen=True)
class Region:
    name: str
    racks: tuple[Rack, ...]

    @property
    def weight(self) -> float:
        return sum(r.weight for r in self.racks)


Tree = tuple[Region, ...]


def uniform_tree(shards: int = 24, regions: int = 2, racks: int = 3) -> Tree:
    """Shards 0 to shards - 1 with weight 1, dealt over regions and racks as evenly as their numbers allow."""
    per_rack: dict[tuple[int, int], list] = {}
    for s in range(shards):
        per_rack.setdefault((s % regions, s // regions % racks), []).append((s, 1.0))
    return tuple(
        Region(f"g{g}", tuple(Rack(f"g{g}/r{r}", tuple(per_rack[g, r])) for r in range(racks) if (g, r) in per_rack))
        for g in range(regions)
        if any((g, r) in per_rack for r in range(racks))
    )


def grown_tree(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, as a region of its own: no other subtree's weight changes."""
    name = f"g+{shard}"
    return (*tree, Region(name, (Rack(f"{name}/r0", ((shard, weight),)),)))


def _nodes(tree: Tree) -> dict[str, list[tuple[str, float, int]]]:
    """Children of each node: name, weight and, for a shard, its number."""
    out = {"": [(g.name, g.weight, -1) for g in tree]}
    for g in tree:
        out[g.name] = [(r.name, r.weight, -1) for r in g.racks]
        out |= {r.name: [(f"{r.name}/s{s}", w, s) for s, w in r.shards] for r in g.racks}
    return out


def _descend(children: Column, key: Column) -> Column:
    """The child with the least draw, as a struct; equal draws go to the lesser name."""

    def draw(child: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), child["name"]).cast("binary")), 1, 13), 16, 10).cast("double")
        return F.struct((-F.log((bits + 0.5) / float(1 << 52)) / child["weight"]).alias("draw"), child.alias("child"))

    return F.array_min(F.transform(children, draw))["child"]


def place(df: DataFrame, tree: Tree, key_column: str, out: str) -> DataFrame:
    """df with the shard number of each row in column out; a null key is a key of its own."""
    key = F.coalesce(F.col(key_column).cast("string"), F.lit("null"))
    child = lambda c: F.struct(F.lit(c[0]).alias("name"), F.lit(float(c[1])).alias("weight"), F.lit(c[2]).alias("shard"))
    nodes = {name: F.array(*[child(c) for c in children]) for name, children in _nodes(tree).items()}
    below = F.create_map(*[x for name, children in nodes.items() for x in (F.lit(name), children)])
    at = f"__at_{out}"
    df = df.withColumn(at, _descend(nodes[""], key))
    for _ in range(2):
        df = df.withColumn(at, _descend(F.element_at(below, F.col(at)["name"]), key))
    return df.withColumn(out, F.col(at)["shard"]).drop(at)


def number_rows(df: DataFrame, shard: str, order: list[str], out: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in the order of the given columns (nulls first).

    Rows are range-partitioned by shard and order, so no shard is gathered into one task; the counts of the parts give each
    part its offset.  Equal rows are told apart by a random-free tie-break: their place in the input partition.
    """
    df = df.withColumn("__tie", F.monotonically_increasing_id())
    keys = [shard, *order, "__tie"]
    df = df.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    df = cut(df.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    parts = df.groupBy(part.alias("__part"), F.col(shard).alias("__shard")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # One row for each partition and shard in it: partitions + shards at most, as ranges are contiguous.
    counts = sorted(parts.collect(), key=lambda r: (r["__shard"], r["__part"]))
    rows, so_far = [], {}
    for r in counts:
        at = so_far.get(r["__shard"], 0)
        rows.append((r["__part"], r["__shard"], at - r["__first"]))
        so_far[r["__shard"]] = at + r["__n"]
    if not rows:
        return df.withColumn(out, F.lit(0).cast("long")).drop("__at")
    shift = df.sparkSession.createDataFrame(rows, "__part long, __shard int, __shift long")
    return (
        df.withColumn("__part", part)
        .withColumn("__shard", F.col(shard))
        .join(F.broadcast(shift), ["__part", "__shard"])
        .select(*[c for c in df.columns if c != "__at"], (F.col("__at") + F.col("__shift")).alias(out))
    )


def assign_shards(docs: DataFrame, shards: int = 24, tree: Tree | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Shard, slot and the shard after adding one more, for every document.

    Columns: doc_id, size (UTF-8 bytes of the text, none for null, plus 8), text_crc32, law ("key"), shard, slot (the rank of
    the row by doc_id within its shard, from 0), grown_shard.  Only the id decides, so repeated rows and rows with equal ids
    share a shard; equal texts with different ids do not.  A null id is placed like any other key.  An empty table gives no
    rows; other columns of docs are ignored.
    """
    tree = tree or uniform_tree(shards)
    total = 1 + max(s for g in tree for r in g.racks for s, _ in r.shards)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary")
    df = docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    df = place(place(df, tree, "doc_id", "shard"), grown_tree(tree, total), "doc_id", "grown_shard")
    return number_rows(df, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _sql_levels(tree: Tree) -> str:
    return ", ".join(f"('{parent}', '{name}', {w}, {s})" for parent, children in _nodes(tree).items() for name, w, s in children)


def _sql_place(tree: Tree, name: str) -> str:
    draw = "-ln((('0x' || substr(md5(key || '|' || child), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / weight"
    step = "SELECT k.key, arg_min(t.child, {draw}) AS at{more} FROM {src} k JOIN {name}_tree t ON t.parent = {at} GROUP BY k.key"
    return f"""{name}_tree(parent, child, weight, shard) AS (VALUES {_sql_levels(tree)}),
        {name}_1 AS ({step.format(draw=draw, more="", src="keys", name=name, at="''")}),
        {name}_2 AS ({step.format(draw=draw, more="", src=f"{name}_1", name=name, at="k.at")}),
        {name}_3 AS ({step.format(draw=draw, more=f", arg_min(t.shard, {draw}) AS shard", src=f"{name}_2", name=name, at="k.at")})"""


def shards_sql(shards: int = 24) -> str:
    """assign_shards in SQL (DuckDB has no crc32 of a string; it is spelt out as a fold over the bytes)."""
    tree = uniform_tree(shards)
    crc_table = []
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 if c & 1 else c >> 1
        crc_table.append(c)
    return f"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key FROM documents),
        keys AS (SELECT DISTINCT key FROM docs),
        {_sql_place(tree, "now")},
        {_sql_place(grown_tree(tree, shards), "grown")},
        crc AS (SELECT DISTINCT text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(text)),
            lambda i: ('0x' || substr(hex(encode(text)), 2 * i::INT + 1, 2))::BIGINT)),
            lambda c, b: xor(c >> 8, ([{", ".join(map(str, crc_table))}]::BIGINT[])[1 + (xor(c, b) & 255)]))) AS text_crc32 FROM docs)
        SELECT d.doc_id, strlen(d.text) + 8 AS size, c.text_crc32, 'key' AS law, n.shard,
            row_number() OVER (PARTITION BY n.shard ORDER BY d.doc_id NULLS FIRST, c.text_crc32, strlen(d.text)) - 1 AS slot, g.shard AS grown_shard
        FROM docs d JOIN now_3 n USING (key) JOIN grown_3 g USING (key) JOIN crc c ON c.text = d.text"""
