"""Plain versions of the corpus operators, by the letter of what they return."""

import hashlib
import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile("[^\x20\x09-\x0d]+")
ITEM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def encoded(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))


def quality(text):
    text = text or ""
    words = SPACED.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, dup, len(covered), len(words) < 10 or 100 * len(covered) > 20 * len(words)


def contamination(texts, items):
    """texts: list; items: (item_id, text) pairs. A row for each text."""
    wanted = {}
    for item, text in items:
        w = ITEM.findall((text or "").translate(LOWER))
        for i in range(max(len(w) - 13, 0) + 1) if w else ():
            wanted.setdefault(tuple(w[i : i + 13]), set()).add(item)
    lengths = {len(p) for p in wanted}
    out = []
    for text in texts:
        w = ITEM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                p = tuple(w[i : i + n])
                if p in wanted:
                    hit.update(range(i, i + n))
                    found |= wanted[p]
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def repeats(texts, length=200):
    """(n_bytes, n_removed, n_spans, kept bytes) of each text."""
    raw = [(t or "").encode() for t in texts]
    count = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            count[k] = count.get(k, 0) + 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    return out


def shingles(text, width):
    words = SPACED.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width, 0) + 1)} if words else set()


def near_duplicates(ids, texts, width, threshold=80):
    """(n_shingles, component_id) of each document, by comparing all pairs."""
    sets = [shingles(t, width) for t in texts]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        r = find(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return [(len(s), least[find(i)]) for i, s in enumerate(sets)]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def edits(a, b):
    """Levenshtein distance of two byte strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def lexicon_hits(text, lexicon, allowed, longest, reporting, reach=8):
    """(entry, distance, quoted) of each word within reach of a lexicon entry, in the order of the text."""
    marks = "\"«»‘’‚‛“”„‟‹›"
    points = [(c, c.isalnum() or c == "@") for c in text or ""]
    spans, start = [], None
    for i, (_, inside) in enumerate([*points, (" ", False)]):
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            spans.append((start, i))
            start = None

    def is_mark(i):
        apostrophe = text[i] == "’" and 0 < i < len(text) - 1 and points[i - 1][1] and points[i + 1][1]
        return text[i] in marks and not apostrophe

    words = [text[a:b].translate(LOWER) for a, b in spans]
    out = []
    for k, w in enumerate(words):
        raw = w.encode()
        near = [(edits(raw, e), i) for i, e in enumerate(lexicon) if (edits(raw, e) <= (allowed(e) if len(e) <= longest else 0))]
        if near:
            first, last = max(k - reach, 0), min(k + reach, len(words) - 1)
            left, right = spans[first - 1][1] if first else 0, spans[last + 1][0] if last + 1 < len(words) else len(text)
            quoted = any(is_mark(i) for i in range(left, right)) or any(x in reporting for x in words[first : last + 1])
            out.append((min(near)[1], min(near)[0], quoted))
    return out


def letters(text):
    """Lower-cased letters of a text, with None for each run of other signs, as language models see it."""
    out = []
    for c in text:
        x = c.lower()[0] if c.isalpha() else None
        if x is not None or (out and out[-1] is not None):
            out.append(x)
    return out


def kneser_ney(texts):
    """p(x, a, b) of interpolated Kneser-Ney trigrams over the letters of texts: b follows x, a; and the symbols of all texts."""
    tri = {}
    for t in texts:
        s = letters(t)
        for i, x in enumerate(s):
            key = (s[i - 2] if i > 1 else None, s[i - 1] if i > 0 else None, x)
            tri[key] = tri.get(key, 0) + 1
    bi, uni = {}, {}
    for _, a, b in tri:
        bi[a, b] = bi.get((a, b), 0) + 1
    for _, b in bi:
        uni[b] = uni.get(b, 0) + 1

    def level(table):
        n1, n2 = sum(c == 1 for c in table.values()), sum(c == 2 for c in table.values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        totals, kinds = {}, {}
        for k, c in table.items():
            totals[k[:-1]] = totals.get(k[:-1], 0) + c
            kinds[k[:-1]] = kinds.get(k[:-1], 0) + 1

        def p(key, below):
            if key[:-1] not in totals:
                return below
            return (max(table.get(key, 0) - d, 0) + d * kinds[key[:-1]] * below) / totals[key[:-1]]

        return p

    p3, p2 = level(tri), level(bi)
    return lambda x, a, b: p3((x, a, b), p2((a, b), 0.95 * uni.get(b, 0) / sum(uni.values()) + 0.05 / (len(uni) + 1)))
