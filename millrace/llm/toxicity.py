"""Toxicity scores from a misspelling-tolerant lexicon and the context of its hits.

The lexicon is learned: words that occur in a far larger share of the toxic
training documents than of the others, however many they are.  Its trie is intersected with Levenshtein
automata (one edit for words of four to nine bytes, two for longer ones, none
for shorter), and the product is determinised into one transition table over
byte classes.  Scoring runs the table over all words of a block in step, one byte
position at a time; words that left the automaton drop out at once.  Each hit is
weighed by what its entry and edit distance say in training, and put into one of
two contexts by the words around it: quotation (quotation marks or reporting
verbs nearby) or plain use.  A logistic regression on these sums gives the score.

Words and quotation marks are those of code points: letters and digits of any
script make words; punctuation, typographic quotation marks among it, doesn't.
Words too long for an automaton are entries too, found as they are spelt.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut
from ._text import Block, LOWER, blocks, prefix_hash, rows_of, span_hash, tidied, word_spans

#: Labelled documents that training reads at most.
TRAINING_ROWS = 20_000
#: Bytes of an entry that misspellings are looked for; a longer one is found as it is spelt.
LONGEST_TERM = 24
#: Lexicon entries in one automaton; a larger lexicon has several, since states grow faster than the entries they are for.
AUTOMATON_ENTRIES = 256
CONTEXT_WORDS = 8
#: Share of an entry's weight that each edit leaves to a spelling, and documents of training that outweigh this assumption.
MISSPELT = 0.7
ASSUMED = 5
FEATURES = 6

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 0x40]] = True
_WORD[0x80:] = True
#: Code points beyond ASCII that are neither letters nor digits, in the blocks that texts of letters hold.
_SIGNS = [
    *(c for c in range(0x80, 0xC0) if c not in (0xAA, 0xB5, 0xBA)), *range(0x2000, 0x2070), *range(0x3000, 0x3004), *range(0x3008, 0x3021), 0x3030,
    *range(0xFF01, 0xFF10), *range(0xFF1A, 0xFF21), *range(0xFF3B, 0xFF41), *range(0xFF5B, 0xFF66),
]
#: Quotation marks beyond ASCII. The right single one is also the apostrophe: between word characters it is no quotation mark.
_MARKS = [ord(c) for c in "«»‘’‚‛“”„‟‹›「」『』〝〞〟＂｢｣"]
_APOSTROPHE = ord("’")
#: Words near which a hit counts as quoted: reporting verbs of the languages that the synthetic texts have. A parameter of train().
REPORTING = tuple("said says say wrote writes write quoted quote called told claimed dit disait écrit sagte schrieb dijo escribió".split())


def _class_table() -> np.ndarray:
    table = np.zeros(0x10000, np.uint8)
    table[_SIGNS] = 1
    table[_MARKS] = 2
    return table


_CLASS = _class_table()


def words_and_marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of UTF-8 texts end to end belong to words, and which to quotation marks."""
    word, mark = _WORD[data], data == 0x22
    for lead, kind, length in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3)):
        at = np.flatnonzero((data >= lead) & (data < kind))
        at = at[at + length <= len(data)]
        point = (data[at] & (0x1F if length == 2 else 0x0F)).astype(np.int64)
        for k in range(1, length):
            point = point << 6 | (data[at + k] & 0x3F)
        sign = _CLASS[point] > 0
        at, point = at[sign], point[sign]
        for k in range(length):
            word[at + k] = False
        if length == 3:
            inner = np.flatnonzero(point == _APOSTROPHE)
            inner = inner[(at[inner] > 0) & (at[inner] + 3 < len(data))]
            inner = inner[word[at[inner] - 1] & word[at[inner] + 3]]
            point[inner] = 0
        at = at[_CLASS[point] == 2]
        for k in range(length):
            mark[at + k] = True
    return word, mark


_DEAD = 0


def edits_allowed(word: bytes) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 10 else 2


@dataclass
class Automaton:
    """Deterministic product of the lexicon's trie and the Levenshtein automata of its words."""

    classes: np.ndarray  # byte to class; 0 is every byte that no entry holds
    step: np.ndarray  # state, class to state
    entry: np.ndarray  # state to lexicon entry, -1 if it accepts none
    distance: np.ndarray
    longest: int

    @classmethod
    def build(cls, lexicon: list[bytes]) -> Automaton:
        letters = sorted(set(b"".join(lexicon)))
        classes = np.zeros(256, np.uint8)
        classes[letters] = np.arange(1, len(letters) + 1)
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        reach: list[int] = [0]  # most edits that any word below allows
        for i, word in enumerate(lexicon):
            at = 0
            reach[0] = max(reach[0], edits_allowed(word))
            for c in classes[list(word)].tolist():
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    ends.append(-1)
                    reach.append(0)
                at = children[at][c]
                reach[at] = max(reach[at], edits_allowed(word))
            ends[at] = i

        def close(state: dict[int, int]) -> frozenset:
            """Add what skipping letters of the lexicon word reaches; least edits for each trie node."""
            todo = list(state)
            while todo:
                node = todo.pop()
                for below in children[node].values():
                    e = state[node] + 1
                    if e <= reach[below] and e < state.get(below, 9):
                        state[below] = e
                        todo.append(below)
            return frozenset(state.items())

        def follow(state: frozenset, c: int) -> frozenset:
            out: dict[int, int] = {}
            for node, e in state:
                moves = [(node, e + 1)] + [(below, e + (letter != c)) for letter, below in children[node].items()]
                for to, cost in moves:
                    if cost <= reach[to] and cost < out.get(to, 9):
                        out[to] = cost
            return close(out)

        start = close({0: 0})
        number = {frozenset(): _DEAD, start: 1}
        order, table = [frozenset(), start], []
        for state in order:
            row = []
            # Letters that no node of the state goes on with lead where class 0 leads.
            known = {letter for node, _ in state for letter in children[node]}
            other = follow(state, 0)
            for c in range(len(letters) + 1):
                to = follow(state, c) if c in known else other
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            table.append(row)
        entry, distance = np.full(len(order), -1, np.int32), np.zeros(len(order), np.int32)
        for k, state in enumerate(order):
            found = sorted((e, ends[node]) for node, e in state if ends[node] >= 0 and e <= edits_allowed(lexicon[ends[node]]))
            if found:
                distance[k], entry[k] = found[0]
        longest = max((len(w) + edits_allowed(w) for w in lexicon), default=0)
        return cls(classes, np.array(table, np.int32).reshape(len(order), -1), entry, distance, longest)

    def __getstate__(self) -> dict:
        # Most steps lead nowhere: packed, broadcasts are a small part of the table.
        return {**self.__dict__, "step": (zlib.compress(self.step.tobytes(), 1), self.step.shape)}

    def __setstate__(self, state: dict) -> None:
        packed, shape = state["step"]
        self.__dict__.update(state, step=np.frombuffer(zlib.decompress(packed), np.int32).reshape(shape))

    def match(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words within reach of an entry, that entry (the nearest, then the first), and the edit distance."""
        if not self.longest:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        sign = self.classes[LOWER[data]]
        alive = np.flatnonzero(ends - starts <= self.longest)
        state = np.ones(len(alive), np.int32)
        hits, states = [], []
        for k in range(self.longest + 1):
            over = ends[alive] - starts[alive] == k
            ok = over & (self.entry[state] >= 0)
            hits.append(alive[ok])
            states.append(state[ok])
            alive, state = alive[~over], state[~over]
            if not len(alive):
                break
            state = self.step[state, sign[starts[alive] + k]]
            on = state != _DEAD
            alive, state = alive[on], state[on]
        words, at = np.concatenate(hits), np.concatenate(states)
        order = np.argsort(words)
        return words[order], self.entry[at[order]], self.distance[at[order]]


@dataclass
class Automata:
    """The automata of a lexicon of any size."""

    parts: list[Automaton]
    entries: list[np.ndarray]  # of each part, as numbers in the lexicon
    spelt: dict[bytes, int]  # entries over LONGEST_TERM bytes

    @classmethod
    def build(cls, lexicon: list[bytes]) -> Automata:
        short = [i for i, w in enumerate(lexicon) if len(w) <= LONGEST_TERM]
        parts = [short[k : k + AUTOMATON_ENTRIES] for k in range(0, max(len(short), 1), AUTOMATON_ENTRIES)]
        spelt = {w: i for i, w in enumerate(lexicon) if len(w) > LONGEST_TERM}
        return cls([Automaton.build([lexicon[i] for i in part]) for part in parts], [np.array(part, np.int32) for part in parts], spelt)

    def match(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As Automaton.match, over all parts."""
        found = [(w, part[e], d) for part, (w, e, d) in zip(self.entries, (part.match(data, starts, ends) for part in self.parts), strict=True)]
        if self.spelt:
            long = np.flatnonzero(ends - starts > LONGEST_TERM)
            hits = [(i, e) for i, s, t in zip(long.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True) if (e := self.spelt.get(LOWER[data[s:t]].tobytes())) is not None]
            found.append((np.array([i for i, _ in hits], np.int64), np.array([e for _, e in hits], np.int32), np.zeros(len(hits), np.int32)))
        if len(found) == 1:
            return found[0]
        words, entry, distance = (np.concatenate([f[k] for f in found]) for k in range(3))
        order = np.lexsort((entry, distance, words))
        words, entry, distance = words[order], entry[order], distance[order]
        new = np.ones(len(words), bool)
        new[1:] = words[1:] != words[:-1]
        return words[new], entry[new], distance[new]


def _hash_words(words: tuple[str, ...]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return np.sort(span_hash(prefix_hash(np.frombuffer(b"".join(raw), np.uint8), lower=True), np.r_[0, ends[:-1]], ends))


@dataclass
class Toxicity:
    lexicon: list[bytes]
    automaton: Automata
    #: Log-odds of entry and edit distance, and the regression's weights with the intercept last.
    weights: np.ndarray
    coefficients: np.ndarray
    reporting: tuple[str, ...] = REPORTING

    def hits(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, entry, distance, whether in quotation, for each hit; and the number of words by document."""
        inside, mark = words_and_marks(block.data)
        starts, ends, words = word_spans(block, inside)
        found, entry, distance = self.automaton.match(block.data, starts, ends)
        doc = rows_of(words)[found]
        # Words around a hit, within its document, and the signs on both sides of each.
        first, last = np.maximum(found - CONTEXT_WORDS, words[doc]), np.minimum(found + CONTEXT_WORDS, words[doc + 1] - 1)
        left = np.where(first > words[doc], ends[first - 1], block.offsets[doc])
        right = np.where(last + 1 < words[doc + 1], starts[np.minimum(last + 1, len(starts) - 1)], block.offsets[doc + 1])
        marks = np.zeros(len(block.data) + 1, np.int64)
        np.cumsum(mark, out=marks[1:])
        quoted = marks[right] - marks[left] > 0
        if len(found) and self.reporting:
            span = np.minimum(first[:, None] + np.arange(2 * CONTEXT_WORDS + 1), last[:, None])
            prefix = prefix_hash(block.data, lower=True)
            keys = _hash_words(self.reporting)
            h = span_hash(prefix, starts[span.ravel()], ends[span.ravel()])
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            quoted |= (keys[at] == h).reshape(span.shape).any(1)
        return doc, entry, distance, quoted, np.diff(words)

    def features(self, block: Block) -> np.ndarray:
        doc, entry, distance, quoted, n_words = self.hits(block)
        w = np.maximum(self.weights[entry, distance], 0) if len(doc) else np.zeros(0)
        total = lambda x: np.bincount(doc, x, minlength=block.n)
        plain, quote = total(w * ~quoted), total(w * quoted)
        best = np.zeros(block.n)
        np.maximum.at(best, doc, w)
        density = 100 * (plain + quote) / np.maximum(n_words, 20)
        return np.stack([np.log1p(plain), np.log1p(quote), best, np.log1p(density), (plain > 0).astype(float), np.log1p(n_words) / 10], 1)

    def score(self, column: pa.Array) -> np.ndarray:
        parts = [self.features(b) @ self.coefficients[:-1] + self.coefficients[-1] for b in blocks(column)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate(parts or [np.zeros(0)]), -30, 30)))


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the intercept, last, is not shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", rows: int = TRAINING_ROWS, reporting: tuple[str, ...] = REPORTING) -> Toxicity:
    """A model from labelled documents: at most rows of them, those whose hashed ids are least, read whole.

    The bound on rows also bounds what is broadcast and what the driver receives.  Without both classes every score is the
    share of toxic labels (0.5 without any).
    """
    sample = labels.select(F.col(id_column).alias("__id"), (F.col(label_column) == 1).cast("int").alias("__y")).where("__id IS NOT NULL AND __y IS NOT NULL")
    sample = sample.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(rows)
    spark = docs.sparkSession
    chosen = sample.collect()
    picked = spark.createDataFrame(chosen, sample.schema) if chosen else sample
    texts = docs.select(F.col(id_column).alias("__id"), F.col(text_column).cast("string").alias("text")).join(F.broadcast(picked), "__id").select("text", "__y")
    # Every pass below reads these few texts, not all documents again.
    texts = cut(texts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}
        size = [0, 0]
        for batch in batches:
            label = batch.column(1).to_pylist()
            for block in blocks(batch.column(0)):
                starts, ends, words = word_spans(block, words_and_marks(block.data)[0])
                low = LOWER[block.data].tobytes()
                for i in range(block.n):
                    y = label[block.first + i]
                    size[y] += 1
                    for w in {low[s:e] for s, e in zip(starts[words[i] : words[i + 1]].tolist(), ends[words[i] : words[i + 1]].tolist(), strict=True)}:
                        seen.setdefault(w, [0, 0])[y] += 1
        rows = [(b"", size[0], size[1]), *((w, *n) for w, n in seen.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64()))], ["word", "clean", "toxic"])

    counts = texts.mapInArrow(tidied(count), "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sizes = texts.agg(F.coalesce(F.sum(1 - F.col("__y")), F.lit(0)), F.coalesce(F.sum("__y"), F.lit(0))).first()
    n_clean, n_toxic = int(sizes[0]), int(sizes[1])
    empty = Automata.build([])
    if not n_clean or not n_toxic:
        share = (n_toxic + 0.5) / (n_clean + n_toxic + 1)
        return Toxicity([], empty, np.zeros((0, 3)), np.array([0.0] * FEATURES + [np.log(share / (1 - share))]), reporting)
    odds = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    chosen = counts.where((F.length("word") > 0) & (F.col("toxic") >= max(3, 0.01 * n_toxic)) & (odds >= 6)).select("word", (odds * F.col("toxic")).alias("rank")).collect()
    lexicon = [w for _, w in sorted((-r["rank"], bytes(r["word"])) for r in chosen)]
    model = Toxicity(lexicon, Automata.build(lexicon), np.ones((max(len(lexicon), 1), 3)), np.zeros(FEATURES + 1), reporting)
    seen = np.zeros_like(model.weights)
    shared = spark.sparkContext.broadcast(model)

    def occur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.array(batch.column(1).to_pylist())
            for block in blocks(batch.column(0)):
                doc, entry, distance, _, _ = shared.value.hits(block)
                found = np.unique(np.stack([doc, entry, distance], 1), axis=0) if len(doc) else np.zeros((0, 3), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 1].astype(np.int32)), pa.array(found[:, 2].astype(np.int32)), pa.array(label[block.first + found[:, 0]].astype(np.int32))], ["entry", "distance", "y"])

    for r in texts.mapInArrow(tidied(occur), "entry int, distance int, y int").groupBy("entry", "distance").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).collect():
        model.weights[r["entry"], r["distance"]] = np.log((r["t"] + 0.5) / (n_toxic + 1)) - np.log((r["c"] + 0.5) / (n_clean + 1))
        seen[r["entry"], r["distance"]] = r["t"] + r["c"]
    # Spellings that training hardly shows weigh nearly as much as the entry itself.
    assumed = model.weights[:, :1] * MISSPELT ** np.arange(3)
    model.weights = (seen * model.weights + ASSUMED * assumed) / (seen + ASSUMED)
    weighted = spark.sparkContext.broadcast(model)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([weighted.value.features(b) for b in blocks(batch.column(0))] or [np.zeros((0, FEATURES))])
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x[:, k]) for k in range(FEATURES))], ["y", *(f"x{k}" for k in range(FEATURES))])

    table = texts.mapInArrow(tidied(describe), "y int, " + ", ".join(f"x{k} double" for k in range(FEATURES))).toArrow()
    x = np.stack([table.column(f"x{k}").to_numpy() for k in range(FEATURES)], 1)
    model.coefficients = _regression(x, table.column("y").to_numpy().astype(float))
    return model


def score_toxicity(docs: DataFrame, model: Toxicity, keep: list[str], text_column: str = "text") -> DataFrame:
    """docs' columns named in keep, with score (0 to 1) and predicted (1 from 0.5 on).

    A null text scores as an empty one, by the intercept.  Texts are read whole; every row gives one row, repeated rows
    equal ones, an empty table none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.select(F.col(text_column).cast("string").alias("__text"), *keep).mapInArrow(tidied(run), f"{fields}, score double, predicted int")
