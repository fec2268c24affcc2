"""Document quality: base counts, and divergence from language references.

Every document has two histograms: its code points by character class, and its
words by common word (function words of several languages, and one bin for all
others).  The reference of a language is the pair of histograms summed over all
of its documents that pass the base rule.  A document is kept if the
Jensen-Shannon distances of both histograms to the nearest reference stay within
limits; texts too short for a stable histogram pass this test.

A language's limit for words depends on the length, as short texts lie farther from
any reference by chance: it is half way from the median distance of the language's
own documents of that length to the distance of a text without any common word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut
from ._text import Block, LOWER, blocks, mix, prefix_hash, rows_of, sort_by_document, span_hash, tidied, window_starts, word_spans

COMMON_WORDS = sorted(
    set(
        "the of and to in a is that it for was on with as be at by this are or from an have not you he they his her which "
        "le la les de des et un une du en que qui est dans pour pas sur au par il elle ce ne avec se sont "
        "der die das und ist von zu den mit sich ein eine nicht auch auf dem im für es als an wie bei oder "
        "el los las y del con por para una su se no al lo más como pero o si son está este esta "
        "di che il per non sono della con da si i gli "
        "o os as um uma do da em não com "
        "het een van en dat niet te zijn op".split()
    )
)
SHORTEST_WORDS = 50
#: Jensen-Shannon distances (base 2, 0 to 1) above which a document is dropped; that of words where word_limits gives none below it.
CLASS_LIMIT = 0.3
WORD_LIMIT = 0.5
#: Documents of a language and length that a median distance needs, and steps in which distances are counted for it.
MEDIAN_OF = 20
STEPS = 2000
#: Common words that texts of a length hold on average, below which their absence says nothing.
EXPECTED_COMMON = 8

_CLASS = np.full(256, 5, np.uint8)  # other ASCII signs
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_CLASS[[ord(c) for c in ".,;:'\"!?()-"]] = 4
_CLASS[0xC0:] = 6  # lead bytes: one for each code point beyond ASCII
_CLASS[0x80:0xC0] = 7  # continuation bytes, not counted
CLASSES = 7
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])


def _bins() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the common words and their bins."""
    data = np.frombuffer(b"".join(w.encode() for w in COMMON_WORDS), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in COMMON_WORDS])
    h = span_hash(prefix_hash(data, lower=True), np.r_[0, ends[:-1]], ends)
    order = np.argsort(h)
    return h[order], order


def histograms(block: Block, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character classes, and common words with one last bin for all others, by document."""
    classes = np.bincount(rows_of(block.offsets) * 8 + _CLASS[block.data], minlength=8 * block.n).reshape(block.n, 8)[:, :CLASSES]
    keys, bins = _bins()
    h = span_hash(prefix_hash(block.data, lower=True), starts, ends)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    word_bin = np.where(keys[at] == h, bins[at], len(keys))
    width = len(keys) + 1
    return classes, np.bincount(rows_of(words) * width + word_bin, minlength=width * block.n).reshape(block.n, width)


def _repeated(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Order and, in that order, whether an item equals an earlier one or a later one of its document."""
    order = sort_by_document(hashes, doc)
    h, d = hashes[order], doc[order]
    same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    return order, np.r_[False, same] if len(h) else np.zeros(0, bool), np.r_[same, False] if len(h) else np.zeros(0, bool)


def base_counts(block: Block, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words by document."""
    data, offsets = block.data, block.offsets
    prefix = prefix_hash(data)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    lengths = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(points[ends] - points[starts], out=lengths[1:])
    out = {"n_words": np.diff(words), "word_chars": np.diff(lengths[words]), "n_symbols": _sums(_SYMBOL[data], offsets)}
    # Lines: between newlines and document bounds, those with a word.
    newline = np.flatnonzero(data == 0x0A)
    line_start = np.unique(np.concatenate([offsets[:-1], newline + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = offsets[np.searchsorted(offsets, line_start, "right")]
    if len(newline):
        following = np.searchsorted(newline, line_start)
        line_end = np.where(following < len(newline), np.minimum(line_end, newline[np.minimum(following, len(newline) - 1)]), line_end)
    wordy = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[wordy], line_end[wordy]
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    order, again, _ = _repeated(span_hash(prefix, line_start, line_end), line_doc)
    out["n_dup_lines"] = np.bincount(line_doc[order][again], minlength=block.n)
    # Words covered by a five-word window that occurs at least twice in the document.
    h = span_hash(prefix, starts, ends)
    first, doc = window_starts(words, 5)
    window = np.zeros(len(first), np.uint64)
    for k in range(5):
        window = mix(window * np.uint64(0x9E3779B97F4A7C15) + h[first + k])
    order, again, before = _repeated(window, doc)
    twice = first[order[again | before]]
    cover = np.bincount(twice, minlength=len(starts) + 1).astype(np.int64) - np.bincount(np.minimum(twice + 5, len(starts)), minlength=len(starts) + 1)
    out["n_repeat_words"] = _sums(np.cumsum(cover)[: len(starts)] > 0, words)
    return out


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of counts p to the shares q; rows without counts are at distance 0."""
    total = p.sum(1, keepdims=True)
    p = p / np.maximum(total, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(p > 0, p * np.log2(p / m), 0).sum(1) + np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip(kl / 2, 0, 1)), 0.0)


def references(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Class and common-word shares of each language, over the whole text of all its documents that pass the base rule."""
    width = CLASSES + len(COMMON_WORDS) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for block in blocks(batch.column(0)):
                starts, ends, words = word_spans(block)
                passed = ~base_failed(base_counts(block, starts, ends, words))
                both = np.concatenate(histograms(block, starts, ends, words), 1)
                for i in np.flatnonzero(passed):
                    lang = langs[block.first + i]
                    if lang not in sums:
                        sums[lang] = np.zeros(width, np.int64)
                    sums[lang] += both[i]
        rows = [(x, k, int(n)) for x, s in sums.items() for k, n in enumerate(s) if n]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64()))], ["lang", "bin", "n"])

    texts = docs.select(F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    total: dict[str, np.ndarray] = {}
    for r in texts.mapInArrow(tidied(count), "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect():
        total.setdefault(r["lang"], np.zeros(width))[r["bin"]] = r["n"]
    share = lambda x: x / max(x.sum(), 1)
    return {lang: (share(x[:CLASSES]), share(x[CLASSES:])) for lang, x in sorted(total.items())}


def word_limits(reference: np.ndarray, counts: dict[int, np.ndarray], shortest_words: int = SHORTEST_WORDS) -> dict[int, float]:
    """Limit of the word distance to a reference for texts of 2**k to 2**(k + 1) - 1 words, by k.

    counts: by k, how many of the language's own documents are in each of STEPS steps of distance.  A length with too few
    documents takes the median of the next shorter one that has enough, which is larger; without any, only texts as far off as
    one without common words are beyond the limit.  Lengths at which common words may well be missing have no limit.
    """
    bare = np.zeros((1, len(reference)))
    bare[0, -1] = 1
    farthest = float(js_distance(bare, reference)[0])
    # A median beyond this would leave texts without common words within the limit.
    most = 0.998 * farthest
    out, typical = {}, most
    for k in range(63):
        n = counts.get(k)
        if n is not None and n.sum() >= MEDIAN_OF:
            typical = (int(np.searchsorted(np.cumsum(n), n.sum() / 2)) + 0.5) / STEPS
        if (1 - reference[-1]) * max(2**k, shortest_words) >= EXPECTED_COMMON:
            out[k] = (min(typical, most) + farthest) / 2
    return out


def judge_quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", shortest_words: int = SHORTEST_WORDS, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """Columns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance.

    The distances are those to the language nearest in their sum.  A null text counts as an empty one and fails the base rule.
    Without any labelled document there is no reference and the base rule alone decides.  A document of fewer than
    shortest_words words is judged by the base rule alone.  The limit of the word distance is that of word_limits for the nearest
    language and the document's length, or word_limit if that is less or there is none.  Every row gives one row; other columns
    are ignored.
    """
    found = references(docs, text_column, lang_column)
    number = {lang: i for i, lang in enumerate(found)}
    spark = docs.sparkSession
    refs = spark.sparkContext.broadcast(list(found.values()))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                starts, ends, words = word_spans(block)
                counts = base_counts(block, starts, ends, words)
                failed = base_failed(counts)
                classes, common = histograms(block, starts, ends, words)
                far = np.zeros((2, block.n))
                near, own, step = np.zeros(block.n, np.int32), np.full(block.n, -1, np.int32), np.zeros(block.n, np.int32)
                if refs.value:
                    each = np.stack([[js_distance(classes, c), js_distance(common, w)] for c, w in refs.value])
                    near = each.sum(1).argmin(0).astype(np.int32)
                    far = each[near, :, np.arange(block.n)].T
                    own = np.array([number.get(x, -1) for x in batch.column(2).slice(block.first, block.n).to_pylist()], np.int32)
                    own[failed | (counts["n_words"] < shortest_words)] = -1
                    step = np.minimum(each[own, 1, np.arange(block.n)] * STEPS, STEPS - 1).astype(np.int32)
                ids = batch.column(1).slice(block.first, block.n)
                length = (np.frexp(np.maximum(counts["n_words"], 1))[1] - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(counts[n].astype(np.int64)) for n in names), *map(pa.array, (failed, far[0], far[1], near, length, own, step))], ["doc_id", *names, "base_failed", "class_distance", "word_distance", "near", "length", "own", "step"])

    kind = docs.schema[id_column].dataType.simpleString()
    texts = docs.select(F.col(text_column).cast("string").alias("__text"), F.col(id_column).alias("doc_id"), F.col(lang_column).cast("string").alias("__lang"))
    judged = texts.mapInArrow(
        tidied(run), f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, class_distance double, word_distance double, near int, length int, own int, step int"
    )
    limit = F.lit(word_limit)
    if found:
        judged = cut(judged)
        counts: dict[int, dict[int, np.ndarray]] = {}
        for r in judged.where("own >= 0").groupBy("own", "length", "step").agg(F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault(r["own"], {}).setdefault(r["length"], np.zeros(STEPS, np.int64))[r["step"]] = r["n"]
        limits = [(i, k, x) for i, (_, w) in enumerate(found.values()) for k, x in word_limits(w, counts.get(i, {}), shortest_words).items()]
        judged = judged.join(F.broadcast(spark.createDataFrame(limits, "near int, length int, word_limit double")), ["near", "length"], "left")
        limit = F.least(F.lit(word_limit), F.col("word_limit"))  # least skips nulls
    fits = (F.col("class_distance") <= class_limit) & (F.col("word_distance") <= limit)
    kept = ~F.col("base_failed") & (fits | (F.col("n_words") < shortest_words))
    return judged.select("doc_id", *names, "base_failed", kept.alias("kept"), "class_distance", "word_distance")
