"""BPE encoding and decoding with reuse of content-defined chunks.

A text is cut where a rolling hash of its last 32 bytes has its high bits zero, so
that equal passages are cut alike wherever they stand.  A chunk's encoding is kept
and reused for every document of the worker that holds the same chunk.  A cut may
fall inside a word; the join of two chunks is then repaired: the words on both
sides of the cut are put together and encoded anew, and the repair widens by
whole chunks until it ends where a chunk's own words end, from which point the
kept encoding agrees exactly.

This rests on how the tokenizer splits: its pieces never contain white space and
depend on nothing outside a white-space delimited word, and merges never cross
pieces.  So a word has the same ids wherever it occurs, and each worker also keeps
words in a table of bounded size.  Texts that the fast path does not cover (the
string of a special token, or a tokenizer of another make) go to the library whole,
and normalization beyond Latin letters is left to it, so that results equal the
library's on every text.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import KEPT, tidied

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks have 2**CHUNK_BITS bytes on average past the least length.
CHUNK_BITS = 10
CHUNK_LEAST = 256
#: Entries that a worker keeps at most. Words live in two generations: a full younger one takes the older one's place, and words that
#: are met again move to the younger one. A full table of chunks keeps those that were met again.
WORDS_KEPT = 600_000
#: Bytes of texts that are cut in one go.
BLOCK_BYTES = 1 << 20
CHUNKS_KEPT = 8_000

_GEAR = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 32, 256, dtype=np.uint32)
#: The splitter that the fast path knows; none of its pieces holds white space.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLITTER = regex.compile(_SPLIT)
#: Bytes as the characters that stand for them in byte-level BPE: visible ones for themselves, the others from U+0100 on.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LEVEL = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
#: Texts that str.lower() and str.split() treat as the normalizers and the splitter do: no code point from U+0250 on, none whose
#: lower case is longer, no control character that only Python counts as white space.
_PLAIN = re.compile("[\x00-\x1b\x20-\u012f\u0131-\u024f]*\\Z")
#: White space of the splitter, for normalized texts beyond those.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


_PACK = [struct.Struct(f"<{n}I").pack for n in range(24)]


def cut_block(texts: list[bytes], bits: int = CHUNK_BITS, least: int = CHUNK_LEAST) -> list[list[int]]:
    """Ends of the content-defined chunks of each text, its own end last.

    The hashes are those of the texts end to end, which are right wherever a cut may be: least bytes or more into a text.
    """
    h = _GEAR[np.frombuffer(b"".join(texts), np.uint8)]
    for k in (1, 2, 4, 8, 16):  # h becomes the sum of gear(byte) << age over the last 2 * k bytes
        h[k:] += h[:-k] << np.uint32(k)
    found = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    ends = np.cumsum([len(t) for t in texts])
    bounds = np.searchsorted(found, np.r_[0, ends]).tolist()
    found, out, start = found.tolist(), [], 0
    for k, end in enumerate(ends.tolist()):
        cuts, last = [], start
        for c in found[bounds[k] : bounds[k + 1]]:
            if c - last >= least and end - c >= least:
                cuts.append(c - start)
                last = c
        out.append([*cuts, end - start] if end > start else [])
        start = end
    return out


def cut_points(text: bytes) -> list[int]:
    return cut_block([text])[0]


@dataclass(frozen=True)
class Chunk:
    """A chunk's encoding apart from the words that touch its ends: those may go on in the neighbours."""

    #: No white space in the chunk: head is all of it.
    solid: bool
    head: str
    inner: bytes
    tail: str


class _Words(dict):
    """The younger generation of words; what it doesn't hold comes from the older one or is learned."""

    def __init__(self, learn: Callable[[str], bytes], older: dict[str, bytes]) -> None:
        self._learn, self._older = learn, older

    def forget(self) -> None:
        """Let go of the generation before this one."""
        self._older = {}

    def __missing__(self, word: str) -> bytes:
        self[word] = found = self._older.get(word) or self._learn(word)
        return found


class Encoder:
    """Encodes as the tokenizers library does with the file at path, without added special tokens; decodes without a decoder.

    Ids are kept and put together as little-endian unsigned 32-bit integers.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        self._words: dict[str, bytes] = _Words(self.learn, {})
        self._chunks: dict[str, Chunk] = {}
        self._again: set[str] = set()
        self.reused = self.scanned = 0

    def __reduce__(self) -> tuple:
        return Encoder, (self.path,)

    @cached_property
    def library(self):  # noqa: ANN201
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.path)
        t.no_truncation()
        t.no_padding()
        return t

    @cached_property
    def _tokenize(self):  # noqa: ANN202
        return self.library.model.tokenize

    @cached_property
    def _known_make(self) -> bool:
        import json

        with open(self.path, encoding="utf-8") as f:
            j = json.load(f)
        kinds = [x.get("type") for x in (j.get("normalizer") or {}).get("normalizers", [])]
        split = ((j.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        return kinds == ["NFC", "Replace", "Lowercase"] and split.get("pattern", {}).get("Regex") == _SPLIT and split.get("invert") is True and j.get("decoder") is None and not j["model"].get("dropout")

    @cached_property
    def _specials(self) -> list[str]:
        return [t.content for t in self.library.get_added_tokens_decoder().values()]

    @cached_property
    def tokens(self) -> list[str]:
        size = max(self.library.get_vocab().values()) + 1
        return [self.library.id_to_token(i) or "" for i in range(size)]

    @cached_property
    def _decimal(self) -> list[bytes]:
        return [b"%d" % i for i in range(len(self.tokens))]

    @cached_property
    def _spelt(self) -> list[bytes]:
        return [t.encode() for t in self.tokens]

    def learn(self, word: str) -> bytes:
        """A word's ids, put together from those of its pieces, which are words themselves."""
        if word.isascii():
            if word.isalpha():
                return self._packed(word)
            if word[-1] in ".,;:!?" and word[:-1].isalpha():  # two pieces, the second of one sign
                return self._words[word[:-1]] + self._words[word[-1]]
        elif word.isalpha() and max(word) < "\u0250":
            return self._packed(word.encode().decode("latin-1").translate(_BYTE_LEVEL))
        pieces = _SPLITTER.findall(word)
        if len(pieces) != 1:
            return self._join(pieces)
        return self._packed(word.encode().decode("latin-1").translate(_BYTE_LEVEL))

    def _packed(self, piece: str) -> bytes:
        ids = [t.id for t in self._tokenize(piece)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def _bound(self) -> None:
        """Start a new generation of words when the younger one is full."""
        if len(self._words) > WORDS_KEPT // 2:
            older, self._words = self._words, _Words(self.learn, self._words)
            older.forget()

    def _join(self, words: list[str]) -> bytes:
        return b"".join(map(self._words.__getitem__, words))

    def _chunk(self, text: str, plain: bool) -> Chunk:
        got = self._chunks.get(text)
        if got is not None:
            self.reused += 1
            self._again.add(text)
            return got
        if len(self._chunks) >= CHUNKS_KEPT:
            again = self._again if len(self._again) <= CHUNKS_KEPT // 2 else ()
            self._chunks = {t: self._chunks[t] for t in again}
            self._again = set()
        if plain:
            words, lead, trail = text.split(), text[0].isspace(), text[-1].isspace()
        else:
            words, lead, trail = [w for w in _SPACE.split(text) if w], bool(_SPACE.match(text[0])), bool(_SPACE.match(text[-1]))
        if len(words) == 1 and not lead and not trail:
            got = Chunk(True, text, b"", "")
        else:
            inner = words[not lead : len(words) if trail else -1]
            got = Chunk(False, words[0] if words and not lead else "", self._join(inner), words[-1] if words and not trail else "")
        self._chunks[text] = got
        self.scanned += 1
        return got

    def _normalized(self, text: str) -> tuple[str, bool] | None:
        """The normalized text and whether str.split() fits it; None if the library has to do all of it."""
        if not self._known_make or any(x in text for x in self._specials):
            return None
        if _PLAIN.match(text):
            return text.lower(), True
        return self.library.normalizer.normalize_str(text), False

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids, four bytes each; a null text is an empty one."""
        out: list[bytes] = [b""] * len(texts)
        todo: list[tuple[int, str, bool, bytes]] = []
        held = 0
        for k, text in enumerate(texts):
            if not text:
                continue
            normal = self._normalized(text)
            if normal is None:
                out[k] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            raw = normal[0].encode()
            todo.append((k, *normal, raw))
            held += len(raw)
            if held >= BLOCK_BYTES:
                self._encode_block(todo, out)
                todo, held = [], 0
        self._encode_block(todo, out)
        return out

    def _encode_block(self, todo: list[tuple[int, str, bool, bytes]], out: list[bytes]) -> None:
        self._bound()
        raws = [raw for *_, raw in todo]
        for (k, text, plain, raw), cuts in zip(todo, cut_block(raws), strict=True):
            if len(raw) != len(text) and len(cuts) > 1:  # byte cuts to character cuts; a cut inside a character moves to its end
                leads = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                cuts = sorted({int(leads[c - 1]) for c in cuts})
            elif len(raw) != len(text):
                cuts = [len(text)] if text else []
            out[k] = self._encode_chunks(text, plain, cuts)

    def _encode_chunks(self, text: str, plain: bool, cuts: list[int]) -> bytes:
        parts: list[bytes] = []
        start, open_word, words = 0, "", self._words
        for end in cuts:
            chunk = self._chunk(text[start:end], plain)
            start = end
            open_word += chunk.head
            if chunk.solid:  # no agreement yet: the word goes on
                continue
            if open_word:
                parts.append(words[open_word])
            parts.append(chunk.inner)
            open_word = chunk.tail
        if open_word:
            parts.append(words[open_word])
        return b"".join(parts)

    def encode_packed(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_packed(text), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """As the library's decode with special tokens kept; unknown ids are skipped."""
        ids = np.asarray(ids).tolist()
        if not self._known_make:
            return self.library.decode(ids, skip_special_tokens=False)
        spelt = self._spelt
        return b" ".join([spelt[i] for i in ids if i < len(spelt)]).decode()

    def decimal(self, ids: list[int]) -> bytes:
        """Decimal ids joined by single spaces."""
        return b" ".join(map(self._decimal.__getitem__, ids))


_ENCODERS: dict[str, Encoder] = {}
KEPT["encoder"] = _ENCODERS.clear


def encoder(path: str) -> Encoder:
    """This process's encoder for the file at path, with what it keeps from earlier tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids and decoded text of every document.

    ids_sha256 is over the decimal ids joined by single spaces, decoded_sha256 over the decoded text in UTF-8.  A null text is an
    empty one and has no ids.  Texts are read whole, each row gives one row, an empty table none; other columns are ignored.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    extra = ", ids array<int>, decoded string" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, shas, texts, lists, back = [], [], [], [], []
                for packed in coder.encode_batch(part.column(0).to_pylist()):
                    packed = np.frombuffer(packed, "<u4")
                    ids = packed.tolist()
                    decoded = coder.decode(packed)
                    n.append(len(ids))
                    shas.append(hashlib.sha256(coder.decimal(ids)).hexdigest())
                    texts.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        lists.append(packed.astype(np.int32))
                        back.append(decoded)
                columns = [part.column(1), pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array(lists, pa.list_(pa.int32())), pa.array(back, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    source = docs.select(F.col(text_column).cast("string").alias("__text"), F.col(id_column).alias("doc_id"))
    return source.mapInArrow(tidied(run, "encoder"), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
