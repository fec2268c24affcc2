"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, operator by operator."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import _spark, bpe, components, decontaminate, langid, neardup, planes, quality, sharding, suffixes, toxicity, urls
from millrace.llm._text import blocks
from tests.llm import brute

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def texts(nasty):
    return [(r["doc_id"], r["text"]) for r in nasty.select("doc_id", "text").collect()]


def expect(nasty, f):
    return sorted(((i, *f(t)) for i, t in texts(nasty)), key=repr)


def test_bpe(nasty, empty, tokenizer):
    out = bpe.encode_documents(nasty, WORD_BPE)
    assert rows(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expect(nasty, lambda t: brute.encoded(tokenizer, t))
    for r in out.collect():
        assert tokenizer.decode(r["ids"], skip_special_tokens=False) == r["decoded"]
    assert bpe.encode_documents(empty, WORD_BPE).count() == 0


def test_bpe_of_awkward_texts(tokenizer):
    coder = bpe.Encoder(WORD_BPE)
    rng = np.random.default_rng(3)
    alphabet = [*"abcdefghij  \n\t'.,!?#0189", "'s", "'ll", "é", "ß", "İ", "ſ", "\u0301", "한", "\U0001f600", "\u00a0", "\u2003", "\x1c", "\x85", "<|endoftext|>", "</w>"]
    for n in (0, 1, 5, 300, 3000, 20000):
        for _ in range(8):
            text = "".join(rng.choice(alphabet, n))
            assert coder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    shared = "".join(rng.choice(alphabet[:20], 30000))
    for k in range(4):
        text = f"intro {k} " + shared + f" outro {k}"
        assert coder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert coder.reused > 0


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 123, 50_000, dtype=np.uint8).tobytes()
    a, b = bpe.cut_points(shared), [c - 777 for c in bpe.cut_points(b"x" * 777 + shared)]
    assert len(set(a) & set(b)) > 0.8 * len(a)
    assert bpe.cut_points(b"") == [] and bpe.cut_points(b"abc") == [3]


def test_quality(nasty, empty):
    out = quality.judge_quality(nasty)
    assert rows(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == expect(nasty, brute.quality)
    assert out.where("base_failed AND kept").count() == 0
    assert quality.judge_quality(empty).count() == 0
    nothing = quality.judge_quality(nasty.withColumn("lang", F.lit(None).cast("string")))
    assert nothing.where("kept = base_failed").count() == 0


def test_quality_without_common_words(spark):
    """Ordinary letters, but no function words: far from every language by words alone, whether or not medians are known."""
    rng = np.random.default_rng(5)
    nouns = [a + b + c for a in ("bra", "sto", "lin", "mer", "tov") for b in ("ka", "du", "re", "mi") for c in ("nt", "ss", "ld", "rk")]
    function = ["the", "of", "and", "to", "in", "is", "was", "for"]
    prose = lambda n: " ".join(str(rng.choice(function if rng.random() < 0.35 else nouns)) for _ in range(n))
    menu = lambda n: " ".join(str(rng.choice(nouns)) for _ in range(n))
    for some in (200, 10):
        texts = [(k, prose(80 + k % 300), "en") for k in range(some)] + [(1000 + n, menu(n), lang) for n in (60, 150, 450) for lang in ("en", None)] + [(2000, menu(40), "en")]
        out = {r["doc_id"]: r for r in quality.judge_quality(spark.createDataFrame(texts, "doc_id long, text string, lang string")).where("NOT base_failed").collect()}
        assert len(out) >= some
        for k, r in out.items():
            assert r["class_distance"] < quality.CLASS_LIMIT
            assert r["kept"] == (k < 1000 or k == 2000), (some, k, r)
    assert quality.word_limits(np.array([0.001, 0.999]), {}).get(6) is None


def test_jensen_shannon():
    p, q = np.array([[1.0, 0], [1, 1], [0, 0]]), np.array([0.0, 1.0])
    assert np.allclose(quality.js_distance(p, q), [1, np.sqrt(0.31127812445913283), 0])


def test_decontamination(spark, nasty, empty):
    items = [(1, "quick brown fox jumps over the lazy dog while the old man reads his paper"), (2, "WORD"), (3, None), (4, "..."), (None, "one"), (5, "nowhere to be found"), (2, "word"), (6, "ünïcödé")]
    table = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(nasty, table)
    named = [(i, t) for i, t in items if i is not None]
    plain = brute.contamination([t for _, t in texts(nasty)], items)
    names = brute.contamination([t for _, t in texts(nasty)], named)
    expected = sorted(((i, p[0], p[1], n[2], n[3], p[4]) for (i, _), p, n in zip(texts(nasty), plain, names, strict=True)), key=repr)
    assert rows(out, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected
    assert decontaminate.contamination(empty, table).count() == 0
    assert decontaminate.contamination(nasty, table.limit(0)).where("n_hit > 0 OR contaminated").count() == 0
    kept = decontaminate.decontaminate(nasty, table)
    assert kept.columns == nasty.columns and kept.count() == sum(not p[4] for p in plain)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta y gamma"), (2, "beta alpha"), (3, "alpha " + "z " * 9 + "beta"), (4, None)], "doc_id long, text string")
    asked = spark.createDataFrame([("a", "alpha beta"), ("b", "gamma ALPHA"), ("c", ""), ("d", "alpha nothing")], "query_id string, text string")
    got = {(r["doc_id"], r["query_id"], r["start"]) for r in decontaminate.proximity_matches(docs, asked, 4).collect()}
    brute_force = set()
    for i, t in [(1, "alpha x x beta y gamma"), (2, "beta alpha"), (3, "alpha " + "z " * 9 + "beta")]:
        w = t.split()
        for q, words in (("a", {"alpha", "beta"}), ("b", {"gamma", "alpha"})):
            brute_force |= {(i, q, s) for s in range(len(w)) if words <= set(w[s : s + 4])}
    assert got == brute_force


def test_index_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "alpha x x beta y gamma"), (2, " beta alpha"), (3, "x y")], "doc_id long, text string")
    asked = spark.createDataFrame([(f"q{k}", ("alpha beta", "gamma beta", "x y")[k % 3]) for k in range(9)], "query_id string, text string")
    items = asked.toDF("item_id", "text")
    near, exact = (lambda: rows(decontaminate.proximity_matches(docs, asked, 4), "doc_id", "query_id", "start")), (lambda: rows(decontaminate.contamination(docs, items), "doc_id", "n_words", "n_hit", "items_sha256"))
    whole = near(), exact()
    assert len({q for _, q, _ in whole[0]}) == 9
    known = [r["text"] for r in docs.orderBy("doc_id").collect()]
    assert whole[1] == [(k + 1, c[0], c[1], c[3]) for k, c in enumerate(brute.contamination(known, [(r["item_id"], r["text"]) for r in items.collect()]))]
    monkeypatch.setattr(decontaminate, "BROADCAST_TERMS", 2)
    assert (near(), exact()) == whole


def test_suffixes(nasty, empty):
    out = suffixes.remove_repeats(nasty)
    expected = brute.repeats([t for _, t in texts(nasty)])
    assert rows(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(((i, *r[:3], brute.sha(r[3])) for (i, _), r in zip(texts(nasty), expected, strict=True)), key=repr)
    assert suffixes.remove_repeats(empty).count() == 0


def test_suffix_sort():
    from millrace.llm._text import prefix_hash

    rng = np.random.default_rng(2)
    data = np.frombuffer(bytes(rng.integers(97, 99, 3000, dtype=np.uint8)) + bytes(200), np.uint8)
    places = rng.permutation(2900)[:700]
    order = suffixes.sort_suffixes(data, prefix_hash(data), places, np.zeros(700, np.int64), 200)
    cut = [bytes(data[p : p + 200]) for p in places]
    assert [cut[i] for i in order] == sorted(cut)


def test_repeats_at_places_of_every_kind(spark):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice([*"abcdefgh "], n))
    shared, other = word(260), word(230)
    docs = [word(400) + shared + word(300), shared, word(100) + shared[:199], "ab" * 400, shared[10:] + other, word(50) + other + other, "é" * 150, word(20) + "é" * 150, word(10) + shared[30:240] + word(5)]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert rows(suffixes.remove_repeats(table), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted((i, *r[:3], brute.sha(r[3])) for i, r in enumerate(brute.repeats(docs)))


def test_near_duplicates(nasty, empty):
    out = neardup.near_duplicates(nasty, width=4)
    known = [(i, t) for i, t in texts(nasty)]
    ids = [i if i is not None else 1 << 60 for i, _ in known]
    groups = brute.near_duplicates(ids, [t for _, t in known], 4)
    back = lambda i: None if i == 1 << 60 else i
    assert rows(out, "doc_id", "n_shingles", "component_id") == sorted(((back(i), g[0], back(g[1])) for i, g in zip(ids, groups, strict=True)), key=repr)
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.deduplicate(nasty, width=4)
    assert kept.columns == nasty.columns
    stay = [r for r in rows(kept, "doc_id", "text", "id", "key") if r[1] and len(r[1]) > 100]
    assert sorted(r[0] for r in stay) == sorted({g[1] for (i, t), g in zip(known, groups, strict=True) if t and len(t) > 100})
    assert all(r[3] == "key" and r[2] is not None for r in stay)


def test_links_near_the_threshold(spark):
    rng = np.random.default_rng(5)
    docs = []
    for _ in range(40):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
        docs.append(" ".join(words))
        for k in (1, 2, 3, 4, 8):
            changed = list(words)
            for at in rng.choice(120, k, replace=False):
                changed[at] = "changed"
            docs.append(" ".join(changed))
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    groups = brute.near_duplicates(list(range(len(docs))), docs, 4)
    assert rows(neardup.near_duplicates(table, width=4), "doc_id", "n_shingles", "component_id") == sorted(((i, *g) for i, g in enumerate(groups)), key=repr)


def test_exact_links_and_low_thresholds(spark):
    """Every link at thresholds that bands of four would miss, and every one with exact, also where clusters are all of the table."""
    rng = np.random.default_rng(15)
    docs = []
    for k in range(12):
        words = [f"w{k}x{x}" for x in range(60)]
        for changes in (0, 2, 5, 9, 14):
            changed = list(words)
            for at in rng.choice(60, changes, replace=False):
                changed[at] = "changed"
            docs.append(" ".join([*changed, *["the same end of all of them"] * (k % 2)]))
    docs += ["", "one", "one two"]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for threshold, exact in ((50, False), (80, True)):
        groups = brute.near_duplicates(list(range(len(docs))), docs, 4, threshold)
        got = rows(neardup.near_duplicates(table, width=4, threshold=threshold, exact=exact), "doc_id", "n_shingles", "component_id")
        assert got == sorted(((i, *g) for i, g in enumerate(groups)), key=repr), (threshold, exact)
    assert neardup.band_rows(80) == 4 and neardup.band_rows(50) == 2
    with pytest.raises(ValueError):
        neardup.band_rows(5)


def test_large_clusters_are_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART_DOCUMENTS", 7)
    rng = np.random.default_rng(6)
    words = [f"w{x}" for x in range(200)]
    docs = []
    for _ in range(60):
        changed = list(words)
        changed[rng.integers(0, 200)] = f"x{rng.integers(0, 10**6)}"
        docs.append(" ".join(changed))
    # A drifting chain, whose ends have nothing in common, and words of its own for every group.
    for k in range(60):
        docs.append(" ".join(f"c{x}" for x in range(6 * k, 6 * k + 200)))
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    groups = brute.near_duplicates(list(range(len(docs))), docs, 4)
    expected = sorted(((i, *g) for i, g in enumerate(groups)), key=repr)
    for hubs in (1, 16):
        monkeypatch.setattr(neardup, "HUBS", hubs)
        assert rows(neardup.near_duplicates(table, width=4), "doc_id", "n_shingles", "component_id") == expected


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(7)
    errors = []
    for _ in range(60):
        a = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
        b = np.r_[a[:320], rng.integers(0, 1 << 62, 80, dtype=np.uint64)]
        sig = neardup.signatures(np.r_[np.sort(a), np.sort(b)], np.array([0, 400, 800]))
        errors.append((sig[0] == sig[1]).mean() - 320 / 480)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (None, 3), (10, 11), (11, 12), (12, 10), (1, 2), *[(100, k) for k in range(101, 160)]]
    got = {(r["vertex"], r["component"]) for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (10, 10), (11, 10), (12, 10), *[(k, 100) for k in range(100, 160)]}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
    path = spark.createDataFrame([(k, k + 1) for k in range(300)], "u long, v long")
    assert components.connected_components(path).where("component <> 0").count() == 0


def test_components_with_hot_vertices(spark, monkeypatch):
    monkeypatch.setattr(_spark, "HOT_ROWS", 5)
    rng = np.random.default_rng(14)
    edges = [(0, k) for k in range(1, 200)] + [(1000, k) for k in range(1001, 1100)] + [(150, 1050)] + [tuple(map(int, rng.integers(2000, 2400, 2))) for _ in range(150)]
    least = {x: x for e in edges for x in e}
    for _ in range(len(least)):
        if all(least[u] == least[v] for u, v in edges):
            break
        for u, v in edges:
            least[u] = least[v] = min(least[u], least[v])
    got = {r["vertex"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: c for v, c in least.items() if any(v in e and e[0] != e[1] for e in edges)}


def test_language(spark, nasty, empty):
    english = ["the cat sat on the mat and the dog ran to the house with the man " * 3] * 5
    french = ["le chat est sur la table et le chien est dans la maison avec la femme " * 3] * 5
    docs = spark.createDataFrame([*[("en", t) for t in english], *[("fr", t) for t in french], (None, "zzz"), ("en", None)], "lang string, text string")
    models = langid.train(docs)
    assert models.languages == ["en", "fr"]
    out = {r["doc_id"]: r for r in langid.identify(nasty, models, ["doc_id"]).collect()}
    assert out[1]["lang_pred"] == out[2]["lang_pred"] == out[3]["lang_pred"] == "und" and out[1]["score"] == 0 and not out[1]["accepted"]
    assert out[5]["lang_pred"] == "en" and 0 < out[5]["score"] <= 1
    assert langid.identify(nasty, models, ["doc_id"]).count() == nasty.count()
    assert langid.identify(empty, models, ["doc_id"]).count() == 0
    nothing = langid.train(empty)
    assert {r["lang_pred"] for r in langid.identify(nasty, nothing, ["doc_id"]).collect()} == {"und"}


def test_kneser_ney_by_brute_force():
    rng = np.random.default_rng(8)
    bits = [*"abcdeefgh  .,1", "É", "ß", "İ", "Ж", "ж", "漢", "字", "\U00030010", "\u0301"]
    texts = ["".join(str(rng.choice(bits)) for _ in range(int(rng.integers(0, 60)))) for _ in range(80)]
    block = next(blocks(pa.array(texts)))
    codes, counts = langid.trigrams(block.data, block.offsets)
    assert np.diff(counts).tolist() == [len(brute.letters(t)) for t in texts]
    seen, n = np.unique(codes, return_counts=True)
    symbols = len(np.unique(codes & langid._SYMBOL))
    model = langid.KneserNey.fit(seen, n.astype(float), symbols)
    p = brute.kneser_ney(texts)
    asked = np.r_[seen, rng.permutation(seen & langid._PAIR), rng.integers(97, 123, 50) << 42 | rng.integers(97, 123, 50) << 21 | rng.integers(97, 123, 50)]
    sign = lambda c: chr(c) if c else None
    for c, x in zip(asked.tolist(), model.log_p(asked).tolist(), strict=True):
        assert abs(np.exp(x) - p(sign(c >> 42), sign(c >> 21 & langid._SYMBOL), sign(c & langid._SYMBOL))) < 1e-12
    every = np.unique(seen & langid._SYMBOL)
    for context in (seen[0] >> 21, seen[30] >> 21, 5 << 21 | 6):
        assert abs(np.exp(model.log_p(context << 21 | every)).sum() + np.exp(model.log_p(np.array([context << 21 | 0x3FFFF])))[0] - 1) < 1e-9


def test_languages_of_their_own_scripts_and_rejection(spark):
    """Scripts share no symbols, letters from U+30000 on are letters, and texts unlike any of their language's are rejected."""
    rng = np.random.default_rng(16)
    parts = {"el": "αβγδεζηθ", "ru": "абвгдежз", "zh": "漢字大小上下中人", "en": "abcdefgh"}
    prose = lambda lang, n: " ".join("".join(parts[lang][int(i)] for i in np.minimum(rng.geometric(0.4, int(rng.integers(2, 7))) - 1, 7)) for _ in range(n))
    docs = [(lang, prose(lang, int(rng.integers(20, 200)))) for lang in parts for _ in range(300)]
    models = langid.train(spark.createDataFrame(docs, "lang string, text string"))
    assert models.languages == ["el", "en", "ru", "zh"]
    fresh = [(lang, prose(lang, int(rng.integers(20, 200)))) for lang in parts for _ in range(100)]
    langs, scores, accepted = models.score(pa.array([t for _, t in fresh]))
    assert langs == [x for x, _ in fresh] and accepted.mean() > 0.99
    junk = ["".join(str(rng.choice([*"qxzjvkwy"])) for _ in range(300)) for _ in range(20)]
    assert not models.score(pa.array(junk))[2].any()
    assert models.score(pa.array(["\U00030010", "1 2", ""]))[0][1:] == ["und", "und"] and models.score(pa.array(["\U00030010"]))[0][0] != "und"


def test_language_models_are_whole(spark, monkeypatch):
    """Languages and trigrams beyond one pass take more passes; nothing is left out, whatever a pass holds."""
    rng = np.random.default_rng(21)
    letters = {"de": "abcdßä", "en": "abcdef", "zh": "漢字大小上下"}
    prose = lambda lang, n: " ".join("".join(letters[lang][int(i)] for i in np.minimum(rng.geometric(0.3, int(rng.integers(1, 7))) - 1, 5)) for _ in range(n))
    docs = [(lang, prose(lang, int(rng.integers(5, 60)))) for lang in letters for _ in range(250 if lang == "en" else 40)]
    # A language that only calibrates: repeated rows are in one fold.
    folds = spark.createDataFrame([(f"abc {k}abcd",) for k in range(60)], "text string").select("text", F.pmod(F.xxhash64("text"), F.lit(langid.FOLDS)).alias("f"))
    docs += [("one", r["text"]) for r in folds.where("f = 0").collect()]
    table = spark.createDataFrame(docs, "lang string, text string").repartition(3).cache()
    fresh = spark.createDataFrame([(prose(lang, n),) for lang in letters for n in (1, 3, 30, 200)] + [("zzyx 漢a",), ("",), (None,)], "text string").repartition(2).cache()
    of = [r["text"] for r in fresh.collect()]

    def run():
        models = langid.train(table)
        found = langid.identify(fresh, models, ["text"])
        return models, models.score(pa.array(of, pa.string())), sorted(map(tuple, found.collect()), key=repr)

    models, (langs, scores, accepted), rows_ = run()
    assert len(models.passes) == 1 and models.languages == ["de", "en", "one", "zh"]
    for trigrams, languages in ((1 << 21, 2), (40, 128)):
        monkeypatch.setattr(langid, "PASS_TRIGRAMS", trigrams)
        monkeypatch.setattr(langid, "PASS_LANGUAGES", languages)
        more, (langs2, scores2, accepted2), rows2 = run()
        assert len(more.passes) > 1 and more.languages == models.languages
        assert np.allclose(more.limits, models.limits, atol=1e-9)
        assert langs2 == langs and np.allclose(scores2, scores) and (accepted2 == accepted).all()
        assert [r[:2] + r[3:] for r in rows2] == [r[:2] + r[3:] for r in rows_]
    assert max(p.value.models[0].tri.size for p in more.passes) <= 80 and max(p.value.share.of for p in more.passes if p.value.share) > 1
    # Each distinct trigram is in one share.
    for k, lang in enumerate(models.languages):
        held = sum(p.value.models[0].tri.size for p in more.passes if p.value.first == k) or next(p.value.models[k - p.value.first].tri.size for p in more.passes if p.value.first <= k < p.value.first + len(p.value.models))
        seen = set()
        for x, t in docs:
            signs = [None, None, *brute.letters(t)] if x == lang else []
            seen |= set(zip(signs, signs[1:], signs[2:], strict=False))
        assert held == len(seen)


def test_language_of_many_trigrams(spark):
    """More than a million trigrams, hardly one of them twice: only who knows them all tells the two languages apart."""
    rng = np.random.default_rng(4)
    some = {lang: ["".join(map(chr, rng.integers(0x4E00, 0x4E00 + 2000, 2000).tolist())) for _ in range(n)] for lang, n in (("many", 600), ("less", 450))}
    models = langid.train(spark.createDataFrame([(lang, t) for lang, texts in some.items() for t in texts], "lang string, text string").repartition(4))
    pieces = [(lang, t[40:140]) for lang, texts in some.items() for t in texts[:50]]
    assert models.score(pa.array([t for _, t in pieces]))[0] == [lang for lang, _ in pieces]


def test_any_number_of_languages(spark):
    docs = spark.createDataFrame([(f"l{k:03d}", f"{chr(0x4E00 + k)}{chr(0x5E00 + k)} {chr(0x4E00 + k)}") for k in range(600)], "lang string, text string")
    models = langid.train(docs)
    assert len(models.languages) == 600
    out = langid.identify(docs, models, ["lang"]).where("lang = lang_pred")
    assert out.count() == 600


def test_toxicity(spark, nasty, empty):
    clean = [f"people said number {k} was a nice and pleasant evening in the garden" for k in range(60)]
    toxic = [f"you number {k} are a worthless scoundrel and everybody knows about it" for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(clean + toxic)), "doc_id long, text string")
    labels = spark.createDataFrame([*[(k, 0) for k in range(60)], *[(k, 1) for k in range(60, 90)], (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert b"worthless" in model.lexicon and b"scoundrel" in model.lexicon
    asked = spark.createDataFrame([(1, "such a worthles scoundrell he is"), (2, "a pleasant evening"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(asked, model, ["doc_id"]).collect()}
    assert got[1]["predicted"] == 1 and got[2]["predicted"] == 0 and got[3]["score"] == got[4]["score"]
    assert toxicity.score_toxicity(nasty, model, ["doc_id"]).count() == nasty.count()
    assert toxicity.score_toxicity(empty, model, ["doc_id"]).count() == 0
    assert toxicity.score_toxicity(nasty, toxicity.train(docs, labels.limit(0)), ["doc_id"]).where("score <> 0.5").count() == 0


def test_toxicity_keeps_every_term(spark, monkeypatch):
    """Terms far down the ranking are found too, in one automaton and in several."""
    rng = np.random.default_rng(7)
    terms = sorted({bytes(rng.integers(97, 123, 9).astype(np.uint8)).decode() for _ in range(70)})
    clean = [f"number {k} had a nice and pleasant evening in the garden" for k in range(280)]
    toxic = [f"number {k} is a {term} in the garden" for k in range(4) for term in terms]
    docs = spark.createDataFrame(list(enumerate(clean + toxic)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k >= len(clean))) for k in range(len(clean) + len(toxic))], "doc_id long, toxic int")
    asked = spark.createDataFrame([*enumerate(f"this one is a {term} in the garden" for term in terms), (1000, "this one had an evening in the garden")], "doc_id long, text string")
    for entries in (256, 16):
        monkeypatch.setattr(toxicity, "AUTOMATON_ENTRIES", entries)
        model = toxicity.train(docs, labels)
        assert {t.encode() for t in terms} <= set(model.lexicon)
        assert len(model.automaton.parts) == -(-len(model.lexicon) // entries)
        assert {r["doc_id"] for r in toxicity.score_toxicity(asked, model, ["doc_id"]).where("predicted = 1").collect()} == set(range(len(terms)))


def test_toxicity_of_short_terms(spark):
    from millrace.llm._text import blocks

    clean = [f"people said number {k} had a pleasant evening in the garden with some cake" for k in range(60)]
    toxic = [f"number {k} is {('scum', 'oaf')[k % 2]} in the garden" for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(clean + toxic)), "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(k, int(k >= 60)) for k in range(100)], "doc_id long, toxic int"))
    assert {b"scum", b"oaf"} <= set(model.lexicon)
    block = next(blocks(pa.array(["scum", "scumm", "scm", "skum", "oaf", "oafs", "scmmu"])))
    doc, entry, distance, _, _ = model.hits(block)
    assert [(int(d), model.lexicon[e], int(x)) for d, e, x in zip(doc, entry, distance, strict=True) if model.lexicon[e] in (b"scum", b"oaf")] == [(0, b"scum", 0), (1, b"scum", 1), (2, b"scum", 1), (3, b"scum", 1), (4, b"oaf", 0)]
    asked = spark.createDataFrame([(1, "this one had scumm in the garden"), (2, "this one had an oaf in the garden"), (3, "people had some cake in the garden")], "doc_id long, text string")
    assert {r["doc_id"] for r in toxicity.score_toxicity(asked, model, ["doc_id"]).where("predicted = 1").collect()} == {1, 2}


def test_automaton_is_levenshtein():
    lexicon = [b"idiot", b"worthless", b"disgusting", b"scum"]
    automaton = toxicity.Automaton.build(lexicon)
    rng = np.random.default_rng(9)
    words = [bytes(w) for w in lexicon]
    for w in lexicon:
        for _ in range(150):
            x = bytearray(w)
            for _ in range(rng.integers(1, 4)):
                at = int(rng.integers(0, len(x) + 1))
                kind = rng.integers(0, 3)
                if kind == 0:
                    x.insert(at, int(rng.integers(97, 123)))
                elif at < len(x) and kind == 1:
                    del x[at]
                elif at < len(x):
                    x[at] = int(rng.integers(97, 123))
            words.append(bytes(x))
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    found, entry, far = automaton.match(data, starts, ends)
    got = {int(f): (int(d), int(e)) for f, e, d in zip(found, entry, far, strict=True)}
    for k, w in enumerate(words):
        near = [(brute.edits(w, x), i) for i, x in enumerate(lexicon) if brute.edits(w, x) <= toxicity.edits_allowed(x)]
        assert got.get(k) == (min(near) if near else None)


def test_quotation_and_words_by_code_point():
    lexicon = [b"idiot", b"worthless", "crétin".encode(), b"scum", b"a" * 30]
    model = toxicity.Toxicity(lexicon, toxicity.Automata.build(lexicon), np.ones((5, 3)), np.zeros(toxicity.FEATURES + 1))
    plain = ["Zoë you are an idiot", "août: an idiot, it’s clear", "the idiots’s idiot", "¿idiot? no", "an idiot…", "x" * 40 + " idiot", "a" * 30, "a" * 31, "Ünïdiot idiôt"]
    quoted = ["he saw “idiot” there", "„idiot“", "«idiot»", "« idiot »", "‘idiot’", "‚idiot‘", '"idiot"', "she said idiot", "‹idiot›", "idiot écrit"]
    far = ["“yes” " + "word " * 12 + "idiot"]
    for texts, expected in ((plain, False), (quoted, True), (far, False)):
        for t in texts:
            doc, entry, distance, flags, _ = model.hits(next(blocks(pa.array([t]))))
            found = list(zip(entry.tolist(), distance.tolist(), flags.tolist(), strict=True))
            assert found == brute.lexicon_hits(t, lexicon, toxicity.edits_allowed, toxicity.LONGEST_TERM, toxicity.REPORTING), t
            assert {f[2] for f in found} <= {expected}, t
    assert all(len(model.hits(next(blocks(pa.array([t]))))[0]) for t in [*quoted, *far, *plain[:7]])
    rng = np.random.default_rng(13)
    bits = ["idiot", "idot", "Worthless", "worthles", "crétin", "cretin", "scum", "skum", "said", "word", "it’s", "“", "”", "‘", "’", "«", "»", '"', ",", "\u00a0", "。", "名", "a" * 30]
    texts = ["".join(str(rng.choice(bits)) + str(rng.choice([" ", " ", " ", ""])) for _ in range(60)) for _ in range(60)]
    block = next(blocks(pa.array(texts)))
    doc, entry, distance, flags, n = model.hits(block)
    got = list(zip(doc.tolist(), entry.tolist(), distance.tolist(), flags.tolist(), strict=True))
    assert got == [(k, *h) for k, t in enumerate(texts) for h in brute.lexicon_hits(t, lexicon, toxicity.edits_allowed, toxicity.LONGEST_TERM, toxicity.REPORTING)]


def test_planes(spark, nasty, empty, tokenizer):
    for kind in (4, 32):
        out = planes.plane_documents(nasty, WORD_BPE, planes=kind)
        ordered = out.orderBy("start").collect()
        assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in ordered if r["doc_id"] is not None) == sorted((i, *(lambda ids: (len(ids), brute.crc(ids)))([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in texts(nasty) if i is not None)
        start = 0
        for r in ordered:
            assert r["start"] == start
            start += r["n_tokens"]
        known = [r["doc_id"] for r in ordered]
        assert known == sorted(known, key=lambda i: -1 if i is None else i)
    assert planes.plane_documents(empty, WORD_BPE).count() == 0


def test_plane_file_round_trip():
    import io

    rng = np.random.default_rng(10)
    for kind in (4, 32):
        stream = io.BytesIO()
        writer = planes.PlaneWriter(stream, kind, block_ids=100)
        docs = [rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in (0, 1, 99, 100, 101, 1000, 0, 7)]
        for k, d in enumerate(docs):
            writer.add(k, d.astype("<u4").tobytes())
        writer.close()
        reader = planes.PlaneReader(stream)
        assert all((reader.document(k) == d).all() and len(reader.document(k)) == len(d) for k, d in enumerate(docs))
        assert all((ids == docs[k]).all() for k, _, ids in reader.documents())
    with pytest.raises(ValueError):
        planes.PlaneReader(io.BytesIO(b"nothing of the kind" * 10))


def test_sharding(spark, nasty, empty):
    out = sharding.assign_shards(nasty)
    got = out.collect()
    assert len(got) == nasty.count()
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24 and r["law"] == "key"
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert sharding.assign_shards(empty).count() == 0
    keys = spark.range(20000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("t"))
    counts = [r["count"] for r in sharding.assign_shards(keys).groupBy("shard").count().collect()]
    assert len(counts) == 24 and max(counts) < 1.2 * 20000 / 24
    moved = sharding.assign_shards(keys).where("shard <> grown_shard").count()
    assert 0.7 * 20000 / 25 < moved < 1.3 * 20000 / 25


def test_weights_move_rows_within_their_subtrees_only(spark):
    keys = spark.range(5000).withColumnRenamed("id", "doc_id")
    tree = sharding.uniform_tree(24)
    first = tree[0].racks[0]
    heavier = sharding.Rack(first.name, ((first.shards[0][0], 1.5), (first.shards[1][0], first.shards[1][1] - 0.5), *first.shards[2:]))
    changed = (sharding.Region(tree[0].name, (heavier, *tree[0].racks[1:])), *tree[1:])
    both = sharding.place(sharding.place(keys, tree, "doc_id", "a"), changed, "doc_id", "b").where("a <> b").select("a", "b").collect()
    inside = {s for s, _ in first.shards}
    assert both and all(r["a"] in inside and r["b"] in inside for r in both)


PAGES = [
    (1, "http://a.ORG/x", None), (2, "http://example.org/es/1", '<link rel="canonical" href="http://free.net/p">'), (3, "http://free.net/p?", ""), (4, "http://free.net/p", "<html>"), (5, None, None), (6, "nothing", ""),
    (7, "http://com/de/1", '<meta http-equiv="refresh" content="0; url=/x">'), (8, "http://com/x", None), (9, "HTTP://www.Example.org/en/12#a", None), (10, "http://b.com/fr/", "<link href='http://free.net/q' rel=canonical>"),
    (11, "http://free.net/q", '<link rel="canonical" href="http://sub.com/de/">'), (4, "http://free.net/p", "<html>"), (None, "http://org", None), (12, "://org/", None), (13, "a://b.net://c.org/", None),
]


def test_urls(spark):
    pages = spark.createDataFrame([(*p, 1, "r", "h") for p in PAGES], "page_id long, url string, html string, rule int, host string, path string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages).collect()}
    assert got[1] == ("a.org", "/x", "org/", "allow") and got[2] == ("example.org", "/es/1", "example.org/es/", "block")
    assert got[4] == ("free.net", "/p", None, "block") and got[3] == ("free.net", "/p", None, "allow")
    assert got[5] == ("", "", None, "allow") == got[6]
    assert got[7][3] == "block" and got[8] == ("com", "/x", None, "block")
    assert got[9] == ("www.example.org", "/en/12", "example.org/en/1", "block")
    # An allowed and a blocked alias: allow takes precedence.
    assert got[11] == ("free.net", "/q", None, "allow")
    assert got[None][:3] == ("org", "", None) and got[12] == ("org", "/", "org/", "allow") and got[13] == ("b.net:", "//c.org/", None, "allow")
    assert urls.judge_urls(pages).count() == len(PAGES)
    more = spark.createDataFrame([("http://far.net/1", "http://x.net/2"), ("http://x.net/2", "http://com/de/3"), (None, "http://a.net")], "source string, target string")
    far = spark.createDataFrame([(1, "http://far.net/1", None)], "page_id long, url string, html string")
    assert urls.judge_urls(far, redirects=more).first()["verdict"] == "block"
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_pipeline_stages(spark, nasty, empty, folder, tokenizer):
    """Each stage on the same awkward rows, against brute force; the first one by the operator's own verdicts."""
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name
    stages, known = dict(corpus_pipeline.STAGES), texts(nasty)

    def result(name):
        out = stages[name](spark, nasty, folder)
        assert out.columns == nasty.columns, name
        found = out.select("doc_id", "text", "n_chars", "key").collect()
        assert {r["key"] for r in found} <= {"key"}
        return sorted(((r["doc_id"], r["text"]) for r in found), key=repr), found

    verdicts = langid.identify(nasty, langid.train(nasty), ["doc_id", "text"]).where("accepted")
    assert result("language")[0] == rows(verdicts, "doc_id", "text")
    assert stages["language"](spark, nasty.withColumn("lang", F.lit(None).cast("string")), folder).count() == 0
    ids = [i if i is not None else 1 << 60 for i, _ in known]
    groups = brute.near_duplicates(ids, [t for _, t in known], 5)
    first = {d for d, i, g in zip(known, ids, groups, strict=True) if g[0] and g[1] == i}
    assert result("near_duplicates")[0] == sorted([*first, *(d for d, g in zip(known, groups, strict=True) if not g[0])], key=repr)
    left = [(i, r[3].decode("utf-8", "ignore")) for (i, _), r in zip(known, brute.repeats([t for _, t in known]), strict=True)]
    kept, found = result("repeats")
    assert kept == sorted(left, key=repr) and all(r["n_chars"] == len(r["text"]) for r in found)
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [d for d, c in zip(known, brute.contamination([t for _, t in known], items), strict=True) if not c[4]]
    assert result("contamination")[0] == sorted(clean, key=repr)
    assert rows(stages["encode"](spark, nasty, folder), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expect(nasty, lambda t: brute.encoded(tokenizer, t))


def test_pipeline_stages_have_no_caps(spark, nasty, folder, monkeypatch):
    """As many languages as there are, in several passes, and awkward rows and columns between these."""
    many = spark.createDataFrame([(k, f"{chr(0x4E00 + k)}{chr(0x5E00 + k)} {chr(0x4E00 + k)}", f"l{k:03d}", "x") for k in range(600)], "doc_id long, text string, lang string, state string")
    known = rows(corpus_pipeline.language(spark, nasty, folder), *nasty.columns)
    assert rows(corpus_pipeline.language(spark, many, folder), *many.columns) == rows(many, *many.columns)
    monkeypatch.setattr(langid, "PASS_LANGUAGES", 1)
    again = corpus_pipeline.language(spark, nasty, folder)
    assert again.columns == nasty.columns and rows(again, *nasty.columns) == known


def test_exact_deduplication(spark, monkeypatch):
    """Where hardly any pair shares a band, exact still finds what is linked."""
    prose = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, prose), (2, prose + " and so to the end"), (3, "other words than these here")], "doc_id long, text string")
    monkeypatch.setattr(neardup, "band_rows", lambda threshold: neardup.REGISTERS)
    assert [i for (i,) in rows(neardup.deduplicate(docs), "doc_id")] == [1, 2, 3]
    assert [i for (i,) in rows(neardup.deduplicate(docs, exact=True), "doc_id")] == [1, 3]


def test_anchors_with_many_contexts(spark, monkeypatch):
    rng = np.random.default_rng(11)
    word = lambda n: "".join(rng.choice([*"abcdefgh "], n))
    shared = word(300)
    docs = [word(int(rng.integers(0, 150))) + shared[int(rng.integers(0, 30)) :] + word(int(rng.integers(0, 150))) for _ in range(40)]
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    expected = sorted(((i, *r[:3], brute.sha(r[3])) for i, r in enumerate(brute.repeats(docs))), key=repr)
    for most in (3, 4096):
        monkeypatch.setattr(suffixes, "SHARE_CONTEXTS", most)
        assert rows(suffixes.remove_repeats(table), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected


def test_suffixes_with_colliding_hashes(monkeypatch):
    """With hashes that all collide, the bytes decide which strings recur, and digests which contexts are equal."""
    rng = np.random.default_rng(12)
    word = lambda n: rng.integers(97, 100, n, dtype=np.uint8).tobytes()
    shared = word(260)
    contexts = [word(int(a)) + shared + word(30) for a in (0, 20, 40, 40)] + [word(300)]
    offs, counts = np.array([0, 20, 40, 40, 7]), np.array([len(c) - 199 for c in contexts])
    group = np.zeros(5, np.int64)
    expected = [f.tolist() for f in suffixes.recurring(contexts, offs, counts, group)]
    strings = [[c[i : i + 200] for i in range(n)] for c, n in zip(contexts, counts, strict=True)]
    every = [(o - i, s) for o, c in zip(offs, strings, strict=True) for i, s in enumerate(c)]
    assert expected == [[every.count((o - i, s)) > 1 for i, s in enumerate(c)] for o, c in zip(offs, strings, strict=True)]
    monkeypatch.setattr(suffixes, "span_hash", lambda prefix, starts, ends: np.zeros(len(starts), np.uint64))
    assert [f.tolist() for f in suffixes.recurring(contexts, offs, counts, group)] == expected
    block = next(blocks(pa.array([b.decode() for b in (word(250), word(250), shared, shared)])))
    found = suffixes.anchors(block)
    kinds = {(tuple(c), block.data[o + s : o + s + n + 199].tobytes()) for c, s, n, o in zip(found["context"].tolist(), found["start"].tolist(), found["n"].tolist(), block.offsets[found["doc"]].tolist(), strict=True)}
    assert len({c for c, _ in kinds}) == len({b for _, b in kinds}) == len(kinds)


def test_workers_forget_what_another_operator_keeps():
    from millrace.llm import _text

    first = bpe.encoder(WORD_BPE)
    list(_text.tidied(lambda found: found, "encoder")(iter(())))
    assert bpe.encoder(WORD_BPE) is first
    list(_text.tidied(lambda found: found)(iter(())))
    assert bpe.encoder(WORD_BPE) is not first


def test_small_tables_are_few_files(spark, monkeypatch):
    """Whatever the number of partitions: on check_h each round of components was dealt over 211 files."""
    files = []

    class Counted(_spark.Stored):
        def __init__(self, df):
            super().__init__(df)
            files.append(len(self.rows.inputFiles()))

    monkeypatch.setattr(components, "Stored", Counted)
    chain = spark.range(300).selectExpr("id AS u", "id + 1 AS v")
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, ("32", "false"), strict=True):
            spark.conf.set(k, v)
        found = components.connected_components(chain, most=300).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, found)) == [(k, 0) for k in range(301)]
    assert len(files) > 2 and set(files) == {1}


def test_gathered_by_rows(spark, monkeypatch):
    monkeypatch.setattr(_spark, "FILE_ROWS", 10)
    rows = spark.range(0, 100, 1, 16)
    assert [_spark.gathered(rows, n).rdd.getNumPartitions() for n in (0, 10, 11, 100, 1000)] == [1, 1, 2, 10, 16]


def test_pipeline_stages_begin_settled(spark, empty, folder, monkeypatch):
    """Each stage first has executors give back memory, once; a JVM's heap and the encoder's tables stayed on."""
    calls = []

    def settle(session):
        _spark.settle(session)
        calls.append(session)

    monkeypatch.setattr(corpus_pipeline, "settle", settle)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, empty, folder)
        assert len(calls) == k + 1
