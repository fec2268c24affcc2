"""Near-duplicate groups by SuperMinHash, banding, verification on full sets and union-find.

Ertl, "SuperMinHash - A New Minwise Hashing Algorithm for Jaccard Similarity
Estimation" (2017): every element walks through one random permutation of the
registers, its value in the j-th register visited being j plus a random fraction,
so that registers are correlated and estimates vary less.  All elements of a block
take their j-th steps together; a document stops once every register holds a value
below the step, since no later value can be less.

1. Documents with equal sets form classes; only one document of each goes on.
2. Signatures are cut into bands; documents that agree in a band share a bucket,
   and a bucket is linked to its least member, which keeps links linear in rows.
3. Connected components of these links are candidate clusters.
4. Within a cluster, full sets are compared, nearest signatures first, for pairs
   that union-find has not yet joined; the verified links' components are the groups.

A cluster that is large, in documents or in shingles, is dealt over parts, each of
which also gets a few documents that all parts have in common.  Where that joins
the whole cluster, as it does for copies of one text, the work is linear in it.
Else the documents that a part doesn't join with the first of these, and they alone, are
compared with all others of the cluster, part by part, so that a task holds two
parts at most and no link is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut, document_key, gathered, join_totals
from ._text import blocks, mix, prefix_hash, release, rows_of, sort_by_document, span_hash, tidied, window_starts, word_spans
from .components import connected_components

#: Registers, and the share of pairs at the threshold that may agree in no band: band_rows chooses the bands for it.
REGISTERS = 96
MISSED = 1e-5
#: Pairs whose signatures agree in a smaller share than the threshold minus this (over four standard deviations) aren't compared.
MARGIN = 0.19
#: A part of a cluster in one task: documents and shingles.
PART_DOCUMENTS = 2048
PART_SHINGLES = 4_000_000
#: Documents that all parts of a cluster have in common.
HUBS = 16

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def band_rows(threshold: int) -> int:
    """Registers in a band: as many as MISSED allows. At 80, 4: a pair shares no band once in 300,000 times."""
    for rows in (8, 6, 4, 3, 2, 1):
        if (1 - (threshold / 100) ** rows) ** (REGISTERS // rows) <= MISSED:
            return rows
    raise ValueError(f"threshold {threshold}: too low for {REGISTERS} registers; exact=True has no such limit")


def shingle_sets(block, width: int) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Distinct hashes of shingles of width words, A-Z lower-cased, sorted within each document, and n + 1 offsets.

    A document of fewer words has its whole sequence as its one shingle, one without words none.
    """
    starts, ends, words = word_spans(block)
    h = span_hash(prefix_hash(block.data, lower=True), starts, ends)
    first, doc = window_starts(words, width)
    x = np.full(len(first), width, np.uint64)
    for k in range(width):
        x = mix(x * _GOLDEN + h[first + k])
    counts = np.diff(words)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        y = counts[short].astype(np.uint64)
        for k in range(width - 1):
            on = counts[short] > k
            y[on] = mix(y[on] * _GOLDEN + h[words[short[on]] + k])
        x, doc = np.concatenate([x, y]), np.concatenate([doc, short])
    # sort_by_document looks at the last document number to choose its key width.
    order = np.argsort(doc, kind="stable")
    x, doc = x[order], doc[order]
    order = sort_by_document(x, doc)
    x, doc = x[order], doc[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (doc[1:] != doc[:-1])
    x, doc = x[new], doc[new]
    return x, np.searchsorted(doc, np.arange(block.n + 1))


def signatures(x: np.ndarray, offsets: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """SuperMinHash of each document's elements: register values as step * 2**32 + fraction; untouched ones all ones."""
    m, n = registers, len(offsets) - 1
    out = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    doc = rows_of(offsets)
    swaps: list[np.ndarray] = []
    permutation: np.ndarray | None = None
    for j in range(m):
        if not len(x):
            break
        r = mix(x + np.uint64(int(_GOLDEN) * (j + 1) % (1 << 64)))
        k = (j + (((r & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32))).astype(np.int32)
        if permutation is None and j >= 6:
            # Few elements are left: keep their permutations outright.
            permutation = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(x), 1))
            row = np.arange(len(x))
            for i, s in enumerate(swaps):
                permutation[row, i], permutation[row, s] = permutation[row, s], permutation[row, i].copy()
        if permutation is None:
            # What stands at place k after the swaps so far: follow them back.
            at = k.copy()
            for i in range(j - 1, -1, -1):
                at = np.where(at == swaps[i], i, at)
            swaps.append(k)
        else:
            row = np.arange(len(x))
            at = permutation[row, k].astype(np.int32)
            permutation[row, k] = permutation[row, j]
        np.minimum.at(out, doc * m + at, (np.uint64(j) << np.uint64(32)) | (r >> np.uint64(32)))
        done = out.reshape(n, m).max(1) < np.uint64(j + 1) << np.uint64(32)
        on = ~done[doc]
        if not on.all():
            x, doc = x[on], doc[on]
            swaps = [s[on] for s in swaps]
            if permutation is not None:
                permutation = permutation[on]
    return out.reshape(n, m)


def _describe(docs: DataFrame, width: int, threshold: int, exact: bool) -> DataFrame:
    """One row for each document: its key, set size, set fingerprint, signature (two bytes a register) and band hashes.

    With exact, the least hashes of the set itself take the place of bands: as many as no linked set can do without all of.
    """
    rows = 1 if exact else band_rows(threshold)
    bands = REGISTERS // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                x, offsets = shingle_sets(block, width)
                doc = rows_of(offsets)
                count = np.diff(offsets)
                mark = np.zeros((block.n, 2), np.uint64)
                for k, salt in enumerate((0x1234567, 0x89ABCDEF)):
                    total = np.zeros(len(x) + 1, np.uint64)
                    np.cumsum(mix(x + np.uint64(salt)), out=total[1:])
                    mark[:, k] = mix(total[offsets[1:]] - total[offsets[:-1]] + count.astype(np.uint64))
                del doc
                sig = signatures(x, offsets)
                short = (mix(sig) >> np.uint64(48)).astype("<u2")
                band = np.zeros((block.n, bands), np.uint64)
                for k in range(rows):
                    band = mix(band * _GOLDEN + sig[:, k::rows])
                as_bytes = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
                here = slice(block.first, block.first + block.n)
                keys = [batch.column(c).slice(here.start, block.n) for c in (1, 2, 3)]
                if exact:
                    # A set that shares threshold of the union holds one of these; they are the same hashes in the same order for all.
                    least = np.where(count > 0, count - -(-threshold * count // 100) + 1, 0)
                    chosen = np.arange(least.sum()) + np.repeat(offsets[:-1] - (np.cumsum(least) - least), least)
                    lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(least)].astype(np.int32), pa.array(x[chosen].view(np.int64)))
                else:
                    lists = pa.ListArray.from_arrays(np.arange(0, block.n * bands + 1, bands, dtype=np.int32), pa.array(band.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*keys, pa.array(count, pa.int64()), as_bytes(mark), as_bytes(short), lists], ["id", "k1", "k2", "n", "fp", "sig", "bands"])

    return docs.select("text", "id", "k1", "k2").mapInArrow(tidied(run), f"id {docs.schema['id'].dataType.simpleString()}, k1 long, k2 long, n long, fp binary, sig binary, bands array<long>")


def _join(sets: list[np.ndarray], sig: np.ndarray, root: np.ndarray, side: np.ndarray, threshold: int, exact: bool) -> np.ndarray:
    """root, numbers that tell what is joined already, after joining linked documents; if there are two sides, links across them only."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    root = root.copy()
    across = side.min() != side.max() if n else False
    floor = 0 if exact else (threshold / 100 - MARGIN) * sig.shape[1]
    for i in range(1, n):
        fit = root[:i] != root[i]
        fit &= 100 * np.minimum(sizes[:i], sizes[i]) >= threshold * np.maximum(sizes[:i], sizes[i])
        if across:
            fit &= side[:i] != side[i]
        near = np.flatnonzero(fit)
        agree = (sig[near] == sig[i]).sum(1)
        near = near[agree >= floor]
        for j in near[np.argsort(-agree[agree >= floor], kind="stable")].tolist():
            if root[j] == root[i]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= threshold * (sizes[i] + sizes[j] - both):
                root[root == root[j]] = root[i]
    return root


def _verify(texts: DataFrame, width: int, threshold: int, exact: bool) -> DataFrame:
    """(u, v, hub) for each document u of each group of texts (cluster, a, b: text, fp, sig, root, side, hub).

    v is the least document that verified links, and root, join with u; hub says whether a hub is among those.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        fp = np.array(table.column("fp").to_pylist(), object)
        order = np.argsort(fp, kind="stable")
        table, fp = table.take(pa.array(order)), fp[order]
        sets: list[np.ndarray] = []
        for block in blocks(table.column("text")):
            x, offsets = shingle_sets(block, width)
            sets += [x[a:b].copy() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        sig = np.array([np.frombuffer(s, "<u2") for s in table.column("sig").to_pylist()]).reshape(len(sets), -1)
        before = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)[1]
        _, first, of = np.unique(_join(sets, sig, before, table.column("side").to_numpy(), threshold, exact), return_index=True, return_inverse=True)
        hub = np.zeros(len(first), bool)
        np.logical_or.at(hub, of, table.column("hub").to_numpy(zero_copy_only=False))
        del sets, sig
        release()
        # Documents are in ascending order, so that the first of a component is its least.
        return pa.table({"u": pa.array(fp, pa.binary()), "v": pa.array(fp[first[of]], pa.binary()), "hub": pa.array(hub[of])})

    return texts.groupBy("cluster", "a", "b").applyInArrow(run, "u binary, v binary, hub boolean")


def _parts(members: DataFrame, name: str) -> DataFrame:
    """members with the number of parts of each's cluster as name + "s", and the part as name."""
    count = F.greatest(F.ceil(F.count(F.lit(1)) / PART_DOCUMENTS), F.ceil(F.sum("n") / PART_SHINGLES)).cast("int")
    counts = members.groupBy("cluster").agg(count.alias(f"{name}s"))
    return members.join(counts, "cluster").withColumn(name, F.pmod(F.xxhash64("fp", F.lit(7)), F.col(f"{name}s")).cast("int"))


def _links(members: DataFrame, size: int, texts: DataFrame, width: int, threshold: int, exact: bool) -> DataFrame:
    """Verified links (u, v) that join what belongs together in each cluster of members (cluster, fp, k1, k2, n, sig).

    size: how many members there are at most; texts: k1, k2, text.
    """
    members = cut(gathered(_parts(members, "part"), size))
    columns, side, zero = ["k1", "k2", "cluster", "fp", "sig"], F.lit(0).alias("side"), F.lit(0).alias("b")
    with_text = lambda rows: texts.join(rows, ["k1", "k2"]).dropDuplicates(["k1", "k2", "a", "b", "side"])
    large = members.where("parts > 1")
    first = Window.partitionBy("cluster").orderBy("fp")
    hubs = large.withColumn("place", F.row_number().over(first)).where(F.col("place") <= HUBS)
    hub = (F.col("parts") > 1) & (F.col("fp") == F.col("cluster"))
    own = members.select(*columns, F.col("fp").alias("root"), F.col("part").alias("a"), zero, side, hub.alias("hub"))
    shared = hubs.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("a")).where("a <> part")
    shared = shared.select(*columns, F.col("fp").alias("root"), "a", zero, side, hub.alias("hub"))
    found = cut(_verify(with_text(own.union(shared)), width, threshold, exact))
    links = found.where("u <> v").select("u", "v")
    # What a part joins with the hub, the least document of a cluster, belongs together in all parts.
    joined = found.groupBy("u").agg(F.max("hub").alias("hub"), F.min("v").alias("v"))
    apart = F.when(F.col("hub"), F.col("cluster")).otherwise(F.col("v")).alias("root")
    rooted = large.join(joined, F.col("fp") == F.col("u")).select("cluster", "fp", "k1", "k2", "n", "sig", "part", "parts", "hub", apart)
    rest = cut(gathered(_parts(rooted.where("NOT hub"), "rest"), size))
    if rest.isEmpty():
        return links
    counts = rest.select("cluster", "rests").distinct()
    no = F.lit(False).alias("hub")
    one = rest.select(*columns, "root", F.col("rest").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("b"), side, no)
    other = rooted.join(counts, "cluster").select(*columns, "root", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("a"), F.col("part").alias("b"), F.lit(1).alias("side"), no)
    more = cut(_verify(with_text(one.union(other)), width, threshold, exact))
    return links.union(more.where("u <> v").select("u", "v"))


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _groups(docs: DataFrame, width: int, threshold: int, id_column: str, text_column: str, exact: bool) -> DataFrame:
    """(id, k1, k2, n, component_id, first) of every document; first holds k1 and k2 of the document that stays in its group."""
    plain = docs.select(F.col(id_column).alias("id"), _text(text_column).alias("text"))
    keyed = plain.select("*", *document_key("id", "text"))
    every = cut(_describe(keyed, width, threshold, exact))
    # Of each class the row with the least id stands for all; its key finds its text again.
    one = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "k1", "k2", "n", "sig", "bands")).alias("r")
    classes = every.where("n > 0").groupBy("fp").agg(one).select("fp", "r.id", "r.k1", "r.k2", "r.n", "r.sig", "r.bands")
    classes = cut(gathered(classes, every.count()))
    size = classes.count()
    # The least hashes of a set are the same whatever their place, registers are not.
    banded = classes.select("fp", F.posexplode("bands").alias("band", "hash")).withColumn("band", F.lit(0) if exact else F.col("band"))
    candidates = join_totals(banded, size * REGISTERS // 4, ["band", "hash"], F.min("fp").alias("least")).select("fp", "least").where("fp <> least").distinct()
    most = None if exact else size * (REGISTERS // band_rows(threshold))
    clusters = connected_components(candidates, "fp", "least", most).select(F.col("vertex").alias("fp"), F.col("component").alias("cluster"))
    members = classes.drop("bands").join(clusters, "fp")
    links = _links(members, size, keyed.select("k1", "k2", "text"), width, threshold, exact)
    groups = connected_components(links, most=links.count()).select(F.col("vertex").alias("fp"), F.col("component").alias("group"))
    grouped = cut(gathered(classes.select("fp", "id", "k1", "k2").join(groups, "fp", "left").withColumn("group", F.coalesce("group", "fp")), size))
    least = join_totals(grouped, size, ["group"], F.min(F.struct(F.col("id").isNull().alias("no"), "id", "k1", "k2")).alias("l"))
    named = least.select("fp", F.col("l.id").alias("component_id"), F.struct("l.k1", "l.k2").alias("first"))
    some = every.where("n > 0").select("id", "k1", "k2", "n", "fp").join(named, "fp").select("id", "k1", "k2", "n", "component_id", "first")
    return some.union(every.where("n = 0").select("id", "k1", "k2", "n", F.col("id").alias("component_id"), F.struct("k1", "k2").alias("first")))


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80, id_column: str = "doc_id", text_column: str = "text", exact: bool = False) -> DataFrame:
    """Columns doc_id, n_shingles, component_id (least doc_id of the group), kept (doc_id = component_id).

    Documents are linked if 100 * |A and B| >= threshold * |A or B| for their sets of shingles of width words; a group is a
    connected component.  A null text, or one without words, has an empty set and is a group of its own.  Repeated rows are in
    one group, and each of them is kept if it has the least doc_id.  Null ids count as greater than all others; a group of
    nothing else has a null component_id and is kept.  An empty table gives no rows; other columns are ignored.

    Pairs at the threshold are missed about five times in a million, by bands or by signatures that are off by MARGIN.  exact
    misses none: it takes candidates from shares of the sets and compares signatures with nothing, at the cost of many more
    candidates.  Bands are chosen for the threshold; below 12 only exact works.
    """
    out = _groups(docs, width, threshold, id_column, text_column, exact)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, threshold: int = 80, id_column: str = "doc_id", text_column: str = "text", exact: bool = False) -> DataFrame:
    """One row of docs for each group of near_duplicates, that of the least id, with all columns; rows without words all stay."""
    groups = _groups(docs, width, threshold, id_column, text_column, exact)
    stay = groups.where("k1 = first.k1 AND k2 = first.k2").groupBy("k1", "k2").agg(F.max(F.col("n") > 0).alias("__words"))
    found = docs.select(*document_key(F.col(id_column), _text(text_column)), F.struct("*").alias("row")).join(stay, ["k1", "k2"])
    return found.where("__words").dropDuplicates(["k1", "k2"]).union(found.where("NOT __words")).select("row.*")


def near_duplicates_sql(width: int = 4, threshold: int = 80) -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
    return f"""
        WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(0, greatest(len(w) - {width}, 0) + 1), lambda i: array_to_string(list_slice(w, i + 1, i + {width}), ' '))) END AS sh FROM d),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT u, v FROM p WHERE 100 * c >= {threshold} * (n + m - c)),
        g AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
        r(u, v) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.u, g.v FROM r JOIN g ON g.u = r.v),
        c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
        SELECT doc_id, len(sh) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c ON c.u = s.doc_id"""
