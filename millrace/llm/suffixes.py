"""Removal of long byte strings that occur more than once in a corpus.

Every string of 200 bytes holds one anchor: the place of the least hash among its
40-byte substrings, the first of equal ones.  Equal strings have their anchors at
equal offsets, so a string can only recur where its anchor's 40 bytes recur, and
strings are compared within the group of one anchor alone.  An anchor's context is
the text from the first to the last string that has this anchor.

1. Anchor rows are written once, with a 128-bit digest of the context (BLAKE2b),
   and counted by hash; those that occur once drop out.
2. Contexts with equal digests are equal: their strings recur.  No cheaper hash
   decides this, so that neither chance nor a hostile text joins different bytes.
3. For an anchor with different contexts, one of each kind is fetched, and the
   suffixes that start at equal offsets from the anchor are sorted: a merge sort
   whose comparisons find the common extension of two suffixes by binary search
   over prefix hashes, so that a comparison takes a logarithmic number of steps.
   Neighbours that agree for 200 bytes recur, once their bytes are compared too;
   where that shows a collision of hashes, the bytes alone decide.
4. The different contexts of a hot anchor, as where a common passage ends in as
   many ways as there are documents, are dealt over tasks.  Each sorts its share as
   above; of the strings that it has, one of each kind goes on as a digest, and
   digests that several shares have recur.
5. A document's recurring strings are merged into runs of bytes and cut out.

Anchors (about one in 80 bytes) are fixed-length rows.  Counting and marking combine
before the shuffle or are joins that can be split, so a passage that a third of all
documents share loads no single task.  Documents are told apart by 128 bits of their
ids and texts.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Stored, cut, document_key
from ._text import Block, blocks, prefix_hash, span_hash, tidied, window_starts

LENGTH = 200
GRAM = 40
#: Different contexts of an anchor that are sorted together, some 1.5 MB; more are dealt over tasks.
SHARE_CONTEXTS = 4096
#: Bytes of contexts that a task sorts in one go, past the last group.
SORT_BYTES = 1 << 19


def digest(data: bytes) -> bytes:
    """What stands for bytes that are too many to be brought together: no two different strings with equal digests are known."""
    return hashlib.blake2b(data, digest_size=16).digest()


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def anchors(block: Block, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """doc, hash, context (two halves of its digest, with the anchor's offset), start (of the first string), n (strings) and off of each anchor."""
    starts, doc = window_starts(block.offsets, length)
    if not len(starts):
        return {k: np.zeros((0, 2) if k == "context" else 0, np.int64) for k in ("doc", "hash", "context", "start", "n", "off")}
    size = len(block.data)
    prefix = prefix_hash(block.data)
    at = np.arange(size - gram + 1)
    hashes = span_hash(prefix, at, at + gram)
    # High bits of the hash, then the place: the least is the first of the least hashes.
    low = np.uint64(int(size).bit_length())
    least = ((hashes >> low) << low) | at.astype(np.uint64)
    width, step = length - gram + 1, 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    anchor = (least[starts] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.r_[first, len(anchor)])
    start, place = starts[first], anchor[first]
    raw = block.data.tobytes()
    found = [digest(bytes((off,)) + raw[a:b]) for off, a, b in zip((place - start).tolist(), start.tolist(), (start + n - 1 + length).tolist(), strict=True)]
    d = doc[first]
    return {"doc": d, "hash": hashes[place].view(np.int64), "context": _halves(found), "start": start - block.offsets[d], "n": n, "off": place - start}


def common_extension(prefix: np.ndarray, x: np.ndarray, y: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """How many of the next length bytes agree from places x and y on, by binary search over prefix hashes."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), length, np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_] + 1) // 2
        same = span_hash(prefix, x[open_], x[open_] + middle) == span_hash(prefix, y[open_], y[open_] + middle)
        low[open_[same]] = middle[same]
        high[open_[~same]] = middle[~same] - 1
    return low


def sort_suffixes(data: np.ndarray, prefix: np.ndarray, places: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Order of the suffixes at places, each cut to length bytes, within their groups (consecutive and ascending).

    A bottom-up merge sort of all groups at once.  In each round every element looks up its rank in the neighbouring run by
    binary search, a comparison being one common_extension and one byte; equal suffixes keep their order.
    """
    n = len(places)
    order = np.arange(n)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    begin = np.repeat(first, np.diff(np.r_[first, n]))
    end = np.repeat(np.r_[first[1:], n], np.diff(np.r_[first, n])) if n else begin
    width, longest = 1, int((end - begin).max(initial=1))

    def after(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix y stands before suffix x; for equal ones, ties says so."""
        same = common_extension(prefix, x, y, length)
        full = same >= length
        i = np.minimum(same, length - 1)
        return np.where(full, ties, data[y + i] < data[x + i])

    while width < longest:
        at = np.arange(n)
        run = begin + (at - begin) // width * width
        left = (at - begin) // width % 2 == 0
        # The neighbouring run: to the right of a left one, to the left of a right one.
        low = np.where(left, np.minimum(run + width, end), run - width)
        high = np.where(left, np.minimum(run + 2 * width, end), run)
        base = low.copy()
        mine = places[order]
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            # A left element stands before equal right ones, a right one after equal left ones.
            go = after(mine[open_], mine[middle], ~left[open_])
            low[open_[go]] = middle[go] + 1
            high[open_[~go]] = middle[~go]
        to = np.where(left, at + (low - base), run - width + (at - run) + (low - base))
        merged = np.empty_like(order)
        merged[to] = order
        order = merged
        width *= 2
    return order


def recurring(contexts: list[bytes], offs: np.ndarray, counts: np.ndarray, group: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its strings stand in another context of its group as well.

    counts: strings in each context, offs: the anchor's offset in it; groups are consecutive.
    """
    data = np.frombuffer(b"".join(contexts) + bytes(length), np.uint8)
    prefix = prefix_hash(data)
    base = np.cumsum([0, *map(len, contexts)])[:-1]
    owner = np.repeat(np.arange(len(contexts)), counts)
    string = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    # Suffixes are sorted among those at one offset from the anchor.
    shift = offs[owner] - string
    order = np.lexsort((shift, group[owner]))
    owner, string, shift = owner[order], string[order], shift[order]
    places = base[owner] + string
    of = np.cumsum(np.r_[False, (shift[1:] != shift[:-1]) | (group[owner][1:] != group[owner][:-1])]) if len(owner) else owner
    several = np.bincount(of, minlength=1)[of] > 1 if len(of) else np.zeros(0, bool)
    owner, string, places, of = owner[several], string[several], places[several], of[several]
    by = sort_suffixes(data, prefix, places, of, length)
    twin = np.zeros(len(by), bool)
    near = np.flatnonzero(of[by][1:] == of[by][:-1])
    if len(near):
        x, y = places[by[near]], places[by[near + 1]]
        near = near[common_extension(prefix, x, y, length) >= length]
        wrong: list[np.ndarray] = []
        for at in range(0, len(near), 1 << 14):  # collision check: the bytes themselves
            part = near[at : at + (1 << 14)]
            x, y = places[by[part]][:, None], places[by[part + 1]][:, None]
            step = np.arange(length)
            right = (data[x + step] == data[y + step]).all(1)
            wrong.append(of[by[part[~right]]])
            part = part[right]
            twin[by[part]] = twin[by[part + 1]] = True
        for g in np.unique(np.concatenate([np.zeros(0, np.int64), *wrong])).tolist():  # the order isn't to be trusted where hashes collide
            at = np.flatnonzero(of == g)
            strings = [data[p : p + length].tobytes() for p in places[at].tolist()]
            times = Counter(strings)
            twin[at] = [times[s] > 1 for s in strings]
    out = [np.zeros(c, bool) for c in counts.tolist()]
    for o, s in zip(owner[twin].tolist(), string[twin].tolist(), strict=True):
        out[o][s] = True
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.view(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _anchor_rows(keyed: DataFrame, length: int) -> DataFrame:
    """(hash, c1, c2, k1, k2, spot) of all anchors; spot: start, n and off of anchors() in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in (1, 2)]
            for block in blocks(batch.column(0)):
                a = anchors(block, length)
                spot = (a["start"] << 16) | (a["n"] << 8) | a["off"]
                columns = [a["hash"], *a["context"].T, *(k[block.first + a["doc"]] for k in keys), spot]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["hash", "c1", "c2", "k1", "k2", "spot"])

    return keyed.select("text", "k1", "k2").mapInArrow(tidied(run), "hash long, c1 long, c2 long, k1 long, k2 long, spot long")


def _sort_groups(rows: list[tuple], length: int) -> pa.RecordBatch:
    """Rows of _sorted_out for whole groups; rows: (hash, share, shares, c1, c2, k1, k2, spot, times, bytes) by hash, share, c1, c2."""
    # A document in the table twice gives its contexts twice.
    flat = [r for before, r in zip([None, *rows], rows, strict=False) if before is None or (r[0], *r[3:5]) != (before[0], *before[3:5])]
    spots = np.array([r[7] for r in flat])
    group = np.cumsum([k > 0 and r[:2] != flat[k - 1][:2] for k, r in enumerate(flat)])
    flags = recurring([r[9] for r in flat], spots & 255, spots >> 8 & 255, group, length)
    out: list[tuple] = []
    for (hash_, share, shares, _, _, k1, k2, spot, times, raw), twin in zip(flat, flags, strict=True):
        start = spot >> 16
        if times == 1:
            out += [(k1, k2, start + a, start + b - 1 + length, None, None, None, None) for a, b in _runs(twin)]
        if shares > 1:
            halves = _halves([digest(raw[i : i + length]) for i in range(len(twin))]).tolist()
            out += [(k1, k2, None if times > 1 or twin[i] else start + i, start + i + length, hash_, share, *h) for i, h in enumerate(halves)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(8)], ["k1", "k2", "start", "end", "hash", "share", "d1", "d2"])


def _sorted_out(contexts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, start, end) of strings that recur within their group, the anchor (hash) and share.

    Rows with a hash are strings of anchors with several shares, for the comparison across these: d1 and d2 are their digests;
    start is null where it is known already that the string recurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo: list[tuple] = []
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                    if held >= SORT_BYTES and row[:2] != todo[-1][:2]:
                        yield _sort_groups(todo, length)
                        todo, held = [], 0
                    todo.append(row)
                    held += len(row[9])
        if todo:
            yield _sort_groups(todo, length)

    dealt = contexts.repartition("hash", "share").sortWithinPartitions("hash", "share", "c1", "c2").select("hash", "share", "shares", "c1", "c2", "k1", "k2", "spot", "times", "bytes")
    return dealt.mapInArrow(tidied(run), "k1 long, k2 long, start long, end long, hash long, share long, d1 long, d2 long")


def _across(strings: DataFrame, length: int) -> DataFrame:
    """(k1, k2, start, end) of strings that recur in another share of their anchor only."""
    several = cut(strings.groupBy("hash", "d1", "d2").agg((F.min("share") < F.max("share")).alias("several")).where("several").drop("several"))
    return strings.where("start IS NOT NULL").join(several, ["hash", "d1", "d2"]).select("k1", "k2", "start", "end")


def repeated_spans(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, start, end) byte spans of all strings of length bytes that start at another place too; keyed: k1, k2, text."""
    stored = Stored(_anchor_rows(keyed, length))
    rows = stored.rows
    mixed = (F.min("c1") < F.max("c1")) | (F.min("c2") < F.max("c2"))
    counted = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("times"), mixed.alias("mixed"))
    # Written out, the counts are dealt anew for the join: only a join between two exchanges is split where an anchor is hot.
    found = cut(rows.join(cut(counted.where("times > 1").drop("times")), "hash"))
    stored.drop()
    start, n = F.shiftright("spot", 16), F.shiftright("spot", 8).bitwiseAND(F.lit(255))
    whole = ["k1", "k2", start.alias("start"), (start + n - 1 + length).alias("end")]
    kinds = found.where("mixed").groupBy("hash", "c1", "c2").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("k1", "k2", "spot")).alias("one"))
    kinds = cut(kinds.select("hash", "c1", "c2", "times", "one.k1", "one.k2", "one.spot"))
    same = found.where("NOT mixed").select(*whole)
    again = found.where("mixed").join(kinds.where("times > 1").select("hash", "c1", "c2"), ["hash", "c1", "c2"]).select(*whole)
    raw = F.substring(F.col("text").cast("binary"), (start + 1).cast("int"), (n - 1 + length).cast("int"))
    shares = F.ceil(F.count(F.lit(1)) / SHARE_CONTEXTS)
    hot = cut(kinds.groupBy("hash").agg(shares.alias("shares")).where("shares > 1"))
    dealt = kinds.join(hot, "hash", "left").withColumn("shares", F.coalesce("shares", F.lit(1).cast("long"))).withColumn("share", F.pmod("c1", "shares"))
    contexts = dealt.join(keyed.select("k1", "k2", "text"), ["k1", "k2"]).select("hash", "share", "shares", "c1", "c2", "k1", "k2", "spot", "times", raw.alias("bytes"))
    sorted_out = cut(_sorted_out(contexts, length))
    apart = sorted_out.where("hash IS NULL").select("k1", "k2", "start", "end")
    return same.union(again).union(apart).union(_across(sorted_out.where("hash IS NOT NULL"), length))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", with_text: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, kept (what remains, as text); then those named in keep.

    A text is taken as its UTF-8 bytes, a null one as empty; shorter documents than length lose nothing.  All occurrences of a
    recurring string go, the first one too, and so do repeated rows.  A span may cut a character in two: kept then leaves its
    other bytes out, kept_sha256 is over the bytes as they are.  An empty table gives no rows; other columns are ignored.
    """
    if not GRAM < length <= GRAM + 255:
        raise ValueError(f"length: from {GRAM + 1} to {GRAM + 255}")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    carried = [F.col(c).alias(f"__{i}") for i, c in enumerate(keep)]
    keyed = docs.select(F.col(id_column).alias("id"), text.alias("text"), *carried).select("*", *document_key("id", "text"))
    spans = repeated_spans(keyed, length).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = keyed.join(spans, ["k1", "k2"], "left")
    kind = docs.schema[id_column].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for raw, spans in zip(batch.column(0).cast(pa.binary()), batch.column(2), strict=True):
                data = raw.as_buffer()
                size = data.size
                kept, at, removed, count = [], 0, 0, 0
                if spans.is_valid:
                    flat = spans.values
                    start, end = (flat.field(k).to_numpy() for k in (0, 1))
                    order = np.argsort(start, kind="stable")
                    start, end = start[order], np.maximum.accumulate(end[order])
                    new = np.r_[True, start[1:] > end[:-1]]
                    for a, b in zip(start[new].tolist(), end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]].tolist(), strict=True):
                        kept.append(data[at:a])
                        at = b
                        removed += b - a
                        count += 1
                kept.append(data[at:size])
                rest = b"".join(memoryview(k) for k in kept)
                for x, v in zip(out, (size, removed, count, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_text else None), strict=True):
                    x.append(v)
            columns = [batch.column(1), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())] + [pa.array(out[4], pa.string())] * with_text + batch.columns[3:]
            yield pa.RecordBatch.from_arrays(columns, names)

    extra = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return joined.select("text", F.col("id").alias("doc_id"), "spans", *[f"__{i}" for i in range(len(keep))]).mapInArrow(tidied(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text + extra)
