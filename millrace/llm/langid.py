"""Language identification by interpolated Kneser-Ney character trigrams.

A letter is its lower-cased code point, so that no two letters share a symbol;
whatever is no letter is one boundary symbol, and runs of it count once.  Each
language's trigram counts over all of its documents are summed by Spark.  The model
keeps, for each order, a sorted array of n-gram hashes with what interpolation needs
of them; scoring searches these arrays.  The language with the least cross-entropy
per symbol wins.  Where the models of all languages are more than a worker should
hold, they take turns: each pass over the texts has some of the languages, or a share
of one language's trigrams, and what it finds goes on with the texts.

A text is rejected if its cross-entropy is nearer to that of other languages' texts
than to that of its language's own.  Both are calibrated on a fold of the documents,
by models that haven't seen that fold: medians over texts of like length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import Stored, cut
from ._text import blocks, mix, rows_of, tidied

#: Bits of a symbol, which is a code point or 0; three symbols make a code.
BITS = 21
_SYMBOL, _PAIR = (1 << BITS) - 1, (1 << 2 * BITS) - 1
#: No letters are assigned from here on.
_POINTS = 0x40000
#: Trigrams and languages that driver and workers hold at once; more take several passes. Alphabets have some ten thousand trigrams.
PASS_TRIGRAMS = 1 << 21
PASS_LANGUAGES = 128
#: Of the documents, one in so many calibrates; and how many texts of a length that needs.
FOLDS = 8
CALIBRATED_BY = 20
#: Where rejection sets in, on the way from a language's own cross-entropy to that of other languages' texts. Without enough texts,
#: letters drawn evenly take the others' place.
LENIENCE = 0.5
#: Cross-entropies are counted in steps of a hundredth, up to 40.
STEPS = 4000
_TABLE: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter."""
    if not _TABLE:
        table = np.zeros(_POINTS, np.uint32)
        for cp in range(_POINTS):
            c = chr(cp)
            if c.isalpha():
                table[cp] = ord(c.lower()[0])
        _TABLE.append(table)
    return _TABLE[0]


def trigrams(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all trigrams of UTF-8 documents laid end to end, and n + 1 offsets of them by document.

    Every symbol is predicted from the two before it, boundaries standing before a document's first; a document without
    letters has none.
    """
    points = np.frombuffer(text.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    leads = np.zeros(len(text) + 1, np.int64)
    np.cumsum((text & 0xC0) != 0x80, out=leads[1:])
    at = leads[offsets]
    table = _symbols()
    sym = np.where(points < _POINTS, table[np.minimum(points, _POINTS - 1)], 0).astype(np.int64)
    before = np.zeros_like(sym)
    before[1:] = sym[:-1]
    starts = at[:-1][at[:-1] < len(sym)]
    before[starts] = 0
    kept = np.flatnonzero((sym != 0) | (before != 0))
    counts = np.searchsorted(kept, at)
    one = before[kept]
    two = np.zeros_like(one)
    two[1:] = one[:-1]
    first = counts[:-1][counts[:-1] < len(one)]
    two[first] = 0
    return two << 2 * BITS | one << BITS | sym[kept], counts


def length_class(n: np.ndarray) -> np.ndarray:
    """k for texts of 2**k to 2**(k + 1) - 1 symbols, 0 for empty ones."""
    return (np.frexp(np.maximum(n, 1))[1] - 1).astype(np.int64)


def discount(n1: int, n2: int) -> float:
    """From how many n-grams occur once and twice."""
    return float(n1 / (n1 + 2 * n2)) if n1 and n2 else 0.5


@dataclass
class Share:
    """Trigrams (a, b, c) with b from low to high - 1 and an a that leaves rest when divided by of."""

    low: int = 0
    high: int = 1 << BITS
    rest: int = 0
    of: int = 1

    def holds(self, a: np.ndarray | Column, b: np.ndarray | Column) -> np.ndarray | Column:
        return (b >= self.low) & (b < self.high) & (a % self.of == self.rest)


@dataclass
class Orders:
    """What the model of a share takes from all of its language: discounts of trigrams and bigrams, last symbols with the number of
    symbols before them; and all bigrams (b, c) of the share's b, with the number of symbols before them."""

    tri_off: float
    bi_off: float
    uni: np.ndarray
    uni_n: np.ndarray
    bi: np.ndarray
    bi_n: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, counts: np.ndarray) -> Orders:
        bi, bi_n = np.unique(codes & _PAIR, return_counts=True)
        uni, uni_n = np.unique(bi & _SYMBOL, return_counts=True)
        return cls(*(discount((c == 1).sum(), (c == 2).sum()) for c in (counts, bi_n)), uni, uni_n, bi, bi_n)


@dataclass
class KneserNey:
    """One language, or a share of it: sorted n-gram hashes of each order with what interpolation needs of them."""

    tri: np.ndarray
    tri_p: np.ndarray
    pair: np.ndarray
    pair_rest: np.ndarray
    bi: np.ndarray
    bi_p: np.ndarray
    one: np.ndarray
    one_rest: np.ndarray
    uni: np.ndarray
    uni_p: np.ndarray
    #: Probability that the even distribution at the bottom adds to each symbol.
    even: float
    #: Cross-entropy of the training text, summed over its symbols, and their number.
    cost: float = 0.0
    size: float = 0.0

    @staticmethod
    def _sorted(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        hashes = mix(keys.astype(np.uint64))  # one to one
        order = np.argsort(hashes)
        return [hashes[order], *(v[order].astype(np.float64) for v in values)]

    @classmethod
    def fit(cls, codes: np.ndarray, counts: np.ndarray, symbols: int, orders: Orders | None = None) -> KneserNey:
        """From distinct trigrams and their counts; symbols: how many different ones all languages have; orders: if the trigrams are a share."""

        def level(keys: np.ndarray, c: np.ndarray, off: float) -> tuple:
            """Discounted share of each n-gram in its context, and what each context leaves to the order below."""
            context, at = np.unique(keys >> BITS, return_inverse=True)
            total = np.bincount(at, c)
            return np.maximum(c - off, 0) / total[at], context, off * np.bincount(at) / total

        whole = orders or Orders.of(codes, counts)
        tri_p, pair, pair_rest = level(codes, counts, whole.tri_off)
        bi_p, one, one_rest = level(whole.bi, whole.bi_n.astype(np.float64), whole.bi_off)
        uni_p = 0.95 * whole.uni_n / whole.uni_n.sum()
        model = cls(*cls._sorted(codes, tri_p), *cls._sorted(pair, pair_rest), *cls._sorted(whole.bi, bi_p), *cls._sorted(one, one_rest), *cls._sorted(whole.uni, uni_p), 0.05 / (symbols + 1))
        model.cost, model.size = float(-(counts * model.log_p(codes)).sum()), float(counts.sum())
        return model

    def log_p(self, codes: np.ndarray) -> np.ndarray:
        """Interpolated log-probability of each trigram's last symbol."""

        def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
            if not len(keys):
                return np.full(len(wanted), float(missing))
            h = mix(wanted.astype(np.uint64))
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            return np.where(keys[at] == h, values[at], missing)

        bigrams = codes & _PAIR
        p = find(self.uni, self.uni_p, codes & _SYMBOL, 0) + self.even
        p = find(self.bi, self.bi_p, bigrams, 0) + find(self.one, self.one_rest, bigrams >> BITS, 1) * p
        p = find(self.tri, self.tri_p, codes, 0) + find(self.pair, self.pair_rest, codes >> BITS, 1) * p
        return np.log(p)


@dataclass
class Pass:
    """Models of consecutive languages, the first of which has the number first, or one model of a share of its language.

    A text's state is what the passes before have found: its cross-entropy by the shares so far of the language at hand; the least
    cross-entropy of a language, which language that is, and the sum of all languages' odds against it.
    """

    first: int
    models: list[KneserNey]
    share: Share | None = None
    #: Whether all shares of its languages are done with it.
    ends: bool = True

    def entropies(self, column: pa.Array, state: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Block by block: the first text's number, each text's symbols, and its cross-entropy by each language, as far as shares go."""
        for block in blocks(column):
            codes, counts = trigrams(block.data, block.offsets)
            n = np.diff(counts)
            entropy = np.zeros((block.n, len(self.models)))
            entropy += state[block.first : block.first + block.n, :1]
            if len(codes):
                seen, at = np.unique(codes, return_inverse=True)
                filled = np.flatnonzero(n)
                here = slice(None) if self.share is None else self.share.holds(seen >> 2 * BITS, seen >> BITS & _SYMBOL)
                p = np.zeros(len(seen))
                for k, model in enumerate(self.models):
                    p[here] = model.log_p(seen[here])
                    entropy[filled, k] -= np.add.reduceat(p[at], counts[filled]) / n[filled]
            yield block.first, n, entropy

    def follow(self, column: pa.Array, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of each text, and its state after this pass."""
        size, out = np.zeros(len(state), np.int64), state.copy()
        for first, n, entropy in self.entropies(column, state):
            here = slice(first, first + len(n))
            size[here] = n
            if not self.ends:
                out[here, 0] = entropy[:, 0]
                continue
            _, before, best, odds = state[here].T
            least = np.minimum(before, entropy.min(1))
            evidence = np.clip(n, 1, 400) / 4  # grows with length
            odds = odds * np.exp(-(before - least) * evidence) + np.exp(-(entropy - least[:, None]) * evidence[:, None]).sum(1)
            out[here] = np.stack([np.zeros(len(n)), least, np.where(least < before, self.first + entropy.argmin(1), best), odds], 1)
        return size, out


#: The state of a text before the first pass.
_START = [0.0, np.inf, 0.0, 0.0]


def _started(n: int) -> np.ndarray:
    return np.tile(np.array(_START), (n, 1))


@dataclass
class LanguageModels:
    """All languages, the passes that have their models, and the cross-entropies beyond which each rejects texts, by length_class."""

    languages: list[str]
    passes: list[Broadcast]
    limits: np.ndarray = field(default_factory=lambda: np.zeros((0, 64)))

    def judge(self, n: np.ndarray, state: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is accepted, for each text, from its symbols and its state after all passes."""
        if not self.languages:
            return ["und"] * len(n), np.zeros(len(n)), np.zeros(len(n), bool)
        _, least, best, odds = state.T
        best = best.astype(np.int64)
        limit = self.limits[best, length_class(n)]
        # The posterior, and the fit to the winner's own text.
        fit = 1 / (1 + np.exp(np.clip((least - limit) * 4, -50, 50)))
        langs = [self.languages[b] if m else "und" for b, m in zip(best, n, strict=True)]
        return langs, np.where(n > 0, 1 / odds * fit, 0.0), (n > 0) & (least <= limit)

    def score(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is accepted, for each text."""
        n, state = np.zeros(len(column), np.int64), _started(len(column))
        for shared in self.passes:
            n, state = shared.value.follow(column, state)
        return self.judge(n, state)


def calibrate(own: float, symbols: int, medians: dict[tuple[int, bool], tuple[int, float]]) -> np.ndarray:
    """Limits of one language by length_class; medians: by (length_class, whether of the language), how many texts there are, and
    their median cross-entropy.

    A length with too few texts takes the limit of the next shorter one that has enough, since shorter texts vary more; without
    any, the way from own to the cross-entropy of letters drawn evenly from symbols decides.
    """
    even = np.log(max(symbols, 2))
    out = np.full(64, own + LENIENCE * max(even - own, 0.0))
    known = False
    for k in range(64):
        (some, mine), (more, others) = (medians.get((k, own_text), (0, 0.0)) for own_text in (True, False))
        if min(some, more) >= CALIBRATED_BY:
            out[k], known = mine + LENIENCE * max(others - mine, 0.0), True
        elif known:
            out[k] = out[k - 1]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code, n, held): counts of trigrams, held of them in the fold that calibrates; of (text, lang, held) rows."""
    sums: dict[str, list[np.ndarray]] = {}
    size = 0

    def summed(parts: list[np.ndarray]) -> np.ndarray:
        codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return np.stack([codes, *(np.bincount(at, np.concatenate([p[k] for p in parts])).astype(np.int64) for k in (1, 2))])

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in sums.items():
            total = summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * total.shape[1], pa.string()), *(pa.array(x) for x in total)], ["lang", "code", "n", "held"])
        sums.clear()

    for batch in batches:
        langs = batch.column(1).dictionary_encode()
        names, index = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        held = batch.column(2).to_numpy(zero_copy_only=False)
        for block in blocks(batch.column(0)):
            codes, counts = trigrams(block.data, block.offsets)
            doc = rows_of(counts)
            of = index[block.first : block.first + block.n][doc]
            aside = held[block.first : block.first + block.n][doc]
            for k in np.unique(of):
                seen, at = np.unique(codes[of == k], return_inverse=True)
                parts = sums.setdefault(names[k], [])
                parts.append(np.stack([seen, np.bincount(at), np.bincount(at, aside[of == k]).astype(np.int64)]))
                size += len(seen)
            if size > 1 << 20:
                sums = {lang: [summed(parts)] for lang, parts in sums.items()}
                size = sum(parts[0].shape[1] for parts in sums.values())
                if size > 1 << 19:
                    yield from flush()
                    size = 0
    yield from flush()


def _groups(sizes: list[int]) -> Iterator[range]:
    """Runs of languages of these sizes that fit a pass; a language that doesn't is alone."""
    at = 0
    while at < len(sizes):
        to = at + 1
        while to < min(len(sizes), at + PASS_LANGUAGES) and sum(sizes[at : to + 1]) <= PASS_TRIGRAMS:
            to += 1
        yield range(at, to)
        at = to


def _middle() -> Column:
    return F.shiftright("code", BITS).bitwiseAND(F.lit(_SYMBOL))


def _shares(rows: DataFrame) -> list[Share]:
    """Shares of one language's trigrams (code) with about PASS_TRIGRAMS at most; together they have every trigram, seen or not."""
    out, low, held = [], 0, 0
    for b, n in sorted(map(tuple, rows.groupBy(_middle().alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())):
        if held and held + n > PASS_TRIGRAMS:
            out.append(Share(low, b))
            low, held = b, 0
        held += n
        if n > PASS_TRIGRAMS:
            of = -(-n // PASS_TRIGRAMS)
            out += [Share(low, b + 1, rest, of) for rest in range(of)]
            low, held = b + 1, 0
    return [*out, Share(low)]


def _share_models(rows: DataFrame, shares: list[Share], symbols: int) -> Iterator[KneserNey]:
    """One language's model of each share, from all of its distinct trigrams and their counts (code, n)."""
    bis = cut(rows.groupBy(F.col("code").bitwiseAND(F.lit(_PAIR)).alias("code")).agg(F.count(F.lit(1)).alias("n")))
    arrays = lambda df: [c.to_numpy() for c in df.select("code", "n").toArrow().columns]
    once = [F.count(F.when(F.col("n") == k, 1)) for k in (1, 2)]
    offs = [discount(*df.agg(*once).first()) for df in (rows, bis)]
    uni = arrays(bis.groupBy(F.col("code").bitwiseAND(F.lit(_SYMBOL)).alias("code")).agg(F.count(F.lit(1)).alias("n")))
    for share in shares:
        codes, n = arrays(rows.where(share.holds(F.shiftright("code", 2 * BITS), _middle())))
        # A bigram's first symbol is where a trigram's second one is.
        yield KneserNey.fit(codes, n.astype(np.float64), symbols, Orders(*offs, *uni, *arrays(bis.where(_middle().between(share.low, share.high - 1)))))


def _state_column(state: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, state.size + 1, len(_START), dtype=np.int32), pa.array(state.ravel()))


def _state_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(_START))


def _after(rows: DataFrame, passes: list[Broadcast]) -> DataFrame:
    """rows (text, state and others) with the states after passes; each pass's rows are written, so that no worker holds two passes."""
    stored = None
    for shared in passes:

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, state = shared.value.follow(batch.column(0), _state_of(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), _state_column(state), *batch.columns[2:]], batch.schema.names)

        before, stored = stored, Stored(rows.mapInArrow(tidied(run), rows.schema))
        rows = stored.rows
        if before:
            before.drop()
    return rows


def _medians(aside: DataFrame, passes: list[Broadcast], languages: list[str]) -> list[dict[tuple[int, bool], tuple[int, float]]]:
    """What calibrate needs of each of the languages that passes have; aside: (text, state, lang)."""
    shared = passes[-1]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            own = np.array([number.get(x, -1) for x in batch.column(2).to_pylist()], np.int64)
            for first, size, entropy in shared.value.entropies(batch.column(0), _state_of(batch.column(1))):
                at = np.flatnonzero(size)
                step = np.minimum(entropy[at] * (STEPS / 40), STEPS - 1).astype(np.int64)
                which = np.arange(step.shape[1])[None, :]
                key = ((which * 64 + length_class(size[at])[:, None]) * 2 + (which == own[first + at][:, None])) * STEPS + step
                keys, times = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], ["key", "n"])

    table = _after(aside, passes[:-1]).mapInArrow(tidied(describe), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow().sort_by("key")
    key, n = (table.column(c).to_numpy() for c in ("key", "n"))
    found: list[dict[tuple[int, bool], tuple[int, float]]] = [{} for _ in languages]
    bounds = [*np.flatnonzero(np.r_[True, key[1:] // STEPS != key[:-1] // STEPS][: len(key)]).tolist(), len(key)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        cell, total = int(key[a]) // STEPS, int(n[a:b].sum())
        step = int(key[a + np.searchsorted(np.cumsum(n[a:b]), total / 2)]) % STEPS
        found[cell // 128][cell // 2 % 64, bool(cell % 2)] = total, (step + 0.5) * 40 / STEPS
    return found


def train(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> LanguageModels:
    """Models of all languages in docs, from the whole text of every row with a language.

    Any number of languages and of trigrams is kept: the driver holds the models of one pass at a time, and of all languages the
    names and limits.  Rows whose texts are equal are in the same fold, so none calibrates a model that has seen it.  Without
    labelled rows there is no language.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    labelled = docs.select(F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    labelled = labelled.withColumn("held", F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0)
    counts = cut(labelled.mapInArrow(tidied(_count), "lang string, code long, n long, held long").groupBy("lang", "code").agg(F.sum("n").alias("n"), F.sum("held").alias("held")))
    aside = labelled.where("held").select("text", F.array(*map(F.lit, _START)).alias("state"), "lang")
    sizes = {r["lang"]: r for r in counts.groupBy("lang").agg(F.count(F.lit(1)).alias("of"), F.max(F.col("n") > F.col("held")).alias("unseen")).collect()}
    languages = sorted(sizes)
    symbols = counts.select(F.col("code").bitwiseAND(F.lit(_SYMBOL))).distinct().count()
    models = LanguageModels(languages, [], np.zeros((len(languages), 64)))
    for group in _groups([sizes[x]["of"] for x in languages]):
        names = [languages[k] for k in group]
        rows = counts if len(names) == len(languages) else counts.where(F.col("lang").isin(names))
        if sizes[names[0]]["of"] <= PASS_TRIGRAMS:
            table = rows.toArrow()
            langs = pa.chunked_array(table.column("lang")).combine_chunks().dictionary_encode()
            index, known = langs.indices.to_numpy(), langs.dictionary.to_pylist()
            codes, n, held = (table.column(c).to_numpy() for c in ("code", "n", "held"))
            of = [np.flatnonzero(index == known.index(x)) for x in names]
            fit = lambda at, c: KneserNey.fit(codes[at][c > 0], c[c > 0].astype(np.float64), symbols)  # noqa: B023, E731
            fitted = [fit(at, n[at]) for at in of]
            own = [m.cost / m.size for m in fitted]
            # Where a language has nothing but held texts, they have to do.
            before = [fit(at, n[at] - held[at]) if sizes[x]["unseen"] else m for x, at, m in zip(names, of, fitted, strict=True)]
            full, unseen = [share(Pass(group[0], fitted))], [share(Pass(group[0], before))]
            del table, langs, index, codes, n, held, of, fitted, before
        else:
            shares = _shares(rows)
            total, full, unseen = np.zeros(2), [], []
            for m, s in zip(_share_models(rows.select("code", "n"), shares, symbols), shares, strict=True):
                total += m.cost, m.size
                full.append(share(Pass(group[0], [m], s, s is shares[-1])))
            own = [total[0] / total[1]]
            if sizes[names[0]]["unseen"]:
                others = rows.where("n > held").select("code", (F.col("n") - F.col("held")).alias("n"))
                unseen = [share(Pass(group[0], [m], s, s is shares[-1])) for m, s in zip(_share_models(others, shares, symbols), shares, strict=True)]
        for k, o, found in zip(group, own, _medians(aside, unseen or full, names), strict=True):
            models.limits[k] = calibrate(o, symbols, found)
        for shared in unseen:
            shared.destroy()
        models.passes.extend(full)
    return models


def identify(docs: DataFrame, models: LanguageModels, keep: list[str], text_column: str = "text") -> DataFrame:
    """docs' columns named in keep, with lang_pred, score (0 to 1) and accepted.

    lang_pred is "und", the score 0 and accepted false for a null text, an empty one or one without letters, and if there is
    no language.  Texts of any length are read whole.  Repeated rows give repeated results, an empty table none; of equally
    likely languages the alphabetically first wins.
    """
    judges = docs.sparkSession.sparkContext.broadcast(LanguageModels(models.languages, [], models.limits))
    *early, last = models.passes or [None]
    several = bool(early)
    kept = docs.select(*keep)
    rows = docs.select(F.col(text_column).cast("string").alias("__text"), *keep)
    if several:
        states = [F.array(*map(F.lit, _START)).alias("state")]
        rows = _after(rows.toDF("text", *[f"c{i}" for i in range(len(keep))]).select("text", *states, *[f"c{i}" for i in range(len(keep))]), early)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, *others = batch.columns
            state = _state_of(others.pop(0)) if several else _started(batch.num_rows)
            n = np.zeros(batch.num_rows, np.int64)
            if last:
                n, state = last.value.follow(text, state)
            langs, scores, accepted = judges.value.judge(n, state)
            yield pa.RecordBatch.from_arrays([*others, pa.array(langs, pa.string()), pa.array(scores), pa.array(accepted)], [*keep, "lang_pred", "score", "accepted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return rows.mapInArrow(tidied(run), f"{fields}, lang_pred string, score double, accepted boolean")


def recognized(docs: DataFrame, models: LanguageModels, text_column: str = "text") -> DataFrame:
    """The rows of docs that identify accepts, with all columns, whatever these are called."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    found = identify(plain, models, plain.columns, f"c{docs.columns.index(text_column)}").where("accepted")
    return found.select(*[F.col(p).alias(c) for p, c in zip(plain.columns, docs.columns, strict=True)])


def held_out(id_column: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder fold; a null id never does."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == fold, F.lit(False))
