"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

1. A first pass over the documents counts the terms of the test phrases; the two
   rarest terms of each phrase are what it is looked up by.
2. A second pass stores the index: postings (term, document, position) of all
   tokens that some phrase is looked up by, those of rarest terms with the words
   around them, and each document's number of words.
3. The list of a phrase's rarest term, shifted by its offset, gives candidate
   starts; these are intersected with the list of the second rarest term, shifted
   by its own; what is left is compared word for word with the words around the
   first posting.

Both passes join tokens with a broadcast of terms, whose number is checked; more
terms than that are indexed in several passes.  Phrases, of which there may be any
number, are joined with stored postings and never broadcast by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import Stored, cut, document_key

WINDOW = 13
#: Distinct terms in one broadcast; more are counted by a shuffle, and indexed in a pass for each so many.
BROADCAST_TERMS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _fold(text: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() does just that, and faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _raw_tokens(text: Column) -> Column:
    """Words; an empty string stands first or last where the text begins or ends with separators, and alone in an empty text."""
    return F.split(_fold(F.coalesce(text.cast("string"), F.lit(""))), _SEPARATORS)


def _lead(tokens: Column) -> Column:
    return (F.get(tokens, F.lit(0)) == "").cast("int")


def _count(tokens: Column) -> Column:
    n = F.size(tokens)
    return (n - _lead(tokens) - ((n > 1) & (F.get(tokens, n - 1) == "")).cast("int")).cast("long")


def words_of(text: Column) -> Column:
    """A-Z lower-cased, then maximal runs of digits, a-z and everything beyond ASCII; none for null."""
    return F.filter(_raw_tokens(text), lambda w: w != "")


def phrases_of(items: DataFrame, window: int = WINDOW, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(item_id, phrase, words): every window of consecutive words of each item; a shorter item is one phrase, an empty one none."""
    words = items.select(F.col(id_column).alias("item_id"), words_of(F.col(text_column)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    every = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i + 1, window))).alias("words"))
    return every.select("item_id", F.md5(F.array_join("words", " ").cast("binary")).alias("phrase"), "words").dropDuplicates(["item_id", "phrase"])


def term_counts(docs: DataFrame, terms: DataFrame, text_column: str = "text") -> DataFrame:
    """(term, n): how often each of terms.term occurs in all documents."""
    # An outer explode differs from a plain one only in that the optimizer doesn't split texts twice to look for empty arrays.
    tokens = docs.select(F.explode_outer(_raw_tokens(F.col(text_column))).alias("term"))
    if terms.count() <= BROADCAST_TERMS:
        return tokens.join(F.broadcast(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(terms, "term")


def _anchored(phrases: DataFrame, docs: DataFrame, text_column: str) -> DataFrame:
    """Each distinct phrase with its two rarest terms and their offsets; phrases with a term that no document holds are gone."""
    distinct = phrases.select("phrase", "words").dropDuplicates(["phrase"])
    each = distinct.select("phrase", F.posexplode("words").alias("off", "word")).withColumnRenamed("word", "term")
    terms = cut(each.select("term").distinct())
    counts = term_counts(docs, terms, text_column)
    if terms.count() <= BROADCAST_TERMS:  # common terms stand in very many phrases
        counts = F.broadcast(counts)
    ranked = each.join(counts, "term", "left").groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "term"))).alias("r"))
    first, second = F.col("r")[0], F.col("r")[F.least(F.size("r") - 1, F.lit(1))]
    return ranked.where(first["n"] > 0).join(distinct, "phrase").select("phrase", "words", first["term"].alias("term"), first["off"].alias("off"), second["term"].alias("term2"), second["off"].alias("off2"))


class PositionalIndex:
    """Stored postings of the documents' tokens, for the given terms.

    keyed: id, k1, k2, text; terms: term, primary.  Postings of primary terms hold near, the words up to width - 1 places before
    and after, and here, the posting's own place in near.
    """

    def __init__(self, keyed: DataFrame, terms: DataFrame, width: int) -> None:
        terms = cut(terms)
        blocks = max(1, -(-terms.count() // BROADCAST_TERMS))
        parts = [terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k) for k in range(blocks)]
        rows = [self._rows(keyed, part, width) for part in parts]
        stored = [Stored(r if k == 0 else r.where("term IS NOT NULL")).rows for k, r in enumerate(rows)]
        self.documents = stored[0].where("leads").select("id", "k1", "k2", "n_words")
        self.postings = stored[0].where("term IS NOT NULL")
        for more in stored[1:]:
            self.postings = self.postings.union(more)

    @staticmethod
    def _rows(keyed: DataFrame, terms: DataFrame, width: int) -> DataFrame:
        """A row for each posting, and one for the first token, which stands for its document as well (leads).

        tokens isn't copied for each token as long as what follows stays in generated code: use no lambda functions.
        """
        held = keyed.select("id", "k1", "k2", _raw_tokens(F.col("text")).alias("tokens"))
        every = held.select("id", "k1", "k2", "tokens", F.posexplode_outer("tokens").alias("at", "word"))
        kept = every.join(F.broadcast(terms), F.col("word") == F.col("term"), "left").where("term IS NOT NULL OR at = 0")
        at, tokens = F.col("at"), F.col("tokens")
        first = F.greatest(at - (width - 1), F.lit(0))
        near = F.when(F.col("primary"), F.slice(tokens, first + 1, at - first + width))
        leads = at == 0
        return kept.select(
            F.when(leads, F.col("id")).alias("id"), "k1", "k2", F.when(leads, _count(tokens)).alias("n_words"), leads.alias("leads"),
            "term", F.coalesce("primary", F.lit(False)).alias("primary"), (at - _lead(tokens)).alias("position"), near.alias("near"), (at - first).alias("here"),
        )


def _lookup_terms(anchored: DataFrame) -> DataFrame:
    """(term, primary) of all terms that phrases are looked up by; primary: the rarest of some phrase."""
    both = anchored.select("term", F.lit(True).alias("primary")).union(anchored.select("term2", F.lit(False)))
    return both.groupBy("term").agg(F.max("primary").alias("primary"))


def phrase_matches(index: PositionalIndex, anchored: DataFrame) -> DataFrame:
    """(k1, k2, phrase, start, length) for every occurrence of an anchored phrase (see _anchored), start from 0 in words."""
    start = F.col("position") - F.col("off")
    first = index.postings.where("primary").select("k1", "k2", "term", "position").join(anchored.drop("words"), "term").where(start >= 0)
    first = first.select("k1", "k2", "phrase", "term", "position", "term2", (start + F.col("off2")).alias("position2"))
    second = index.postings.select("k1", "k2", F.col("term").alias("term2"), F.col("position").alias("position2"))
    both = cut(first.join(second, ["k1", "k2", "term2", "position2"], "left_semi").select("k1", "k2", "phrase", "term", "position"))
    near = index.postings.where("primary").select("k1", "k2", "term", "position", "near", "here")
    held = both.join(near, ["k1", "k2", "term", "position"]).join(anchored.select("phrase", "words", "off"), "phrase")
    place = F.col("here") - F.col("off")
    agree = F.when(place >= 0, F.slice("near", place + 1, F.size("words")) == F.col("words")).otherwise(False)
    return held.where(agree).select("k1", "k2", "phrase", start.alias("start"), F.size("words").alias("length")).distinct()


def proximity_matches(docs: DataFrame, queries: DataFrame, span: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, query_id, start) where all words of a query stand, in any order, within span consecutive words from start.

    queries: query_id, text.  Only starts at which the window holds the query's rarest word are looked at, which is all that
    can match.  Queries without words, or with more distinct words than span, match nothing; neither do null texts.
    """
    keyed = _keyed(docs, id_column, text_column)
    asked = queries.select(F.col("query_id").cast("string").alias("item_id"), "text")
    whole = asked.select("item_id", F.array_distinct(words_of(F.col("text"))).alias("words")).where((F.size("words") > 0) & (F.size("words") <= span))
    anchored = cut(_anchored(whole.select(F.col("item_id").alias("phrase"), "words"), keyed, "text"))
    index = PositionalIndex(keyed, anchored.select("term", F.lit(True).alias("primary")).distinct(), span)
    hits = index.postings.join(anchored.select("phrase", "words", "term"), "term").where(F.size(F.array_except("words", "near")) == 0)
    before = F.least(F.col("here"), F.col("position"))  # words before the posting in near; an empty token may stand before these
    starts = F.sequence(F.col("position") - before, F.col("position"))
    holds = lambda s: F.size(F.array_except("words", F.slice("near", s - F.col("position") + F.col("here") + 1, span))) == 0
    found = hits.select("k1", "k2", "phrase", F.explode(F.filter(starts, holds)).alias("start")).distinct()
    ids = index.documents.select("k1", "k2", "id").distinct()
    return found.join(ids, ["k1", "k2"]).select(F.col("id").alias("doc_id"), F.col("phrase").alias("query_id"), "start")


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    plain = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    return plain.select("*", *document_key("id", "text"))


def _judged(docs: DataFrame, items: DataFrame, window: int, id_column: str, text_column: str, item_id: str, item_text: str) -> DataFrame:
    """contamination with k1 and k2, which tell documents with one id apart."""
    keyed = _keyed(docs, id_column, text_column)
    phrases = cut(phrases_of(items, window, item_id, item_text))
    anchored = cut(_anchored(phrases, keyed, "text"))
    index = PositionalIndex(keyed, _lookup_terms(anchored), window)
    hits = cut(phrase_matches(index, anchored))
    spans = hits.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate("spans", zero, lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n")))
    spans = spans.select("k1", "k2", covered["n"].cast("long").alias("n_hit"))
    names = hits.select("k1", "k2", "phrase").join(phrases.select("phrase", F.col("item_id").cast("string").alias("item")), "phrase").where("item IS NOT NULL")
    names = names.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = index.documents.join(spans.join(names, ["k1", "k2"], "left"), ["k1", "k2"], "left")
    hit, names = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias("doc_id"), "k1", "k2", "n_words", hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Columns doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    n_hit counts the words inside any occurrence of a window of an item, n_items the items with such windows; items_sha256 is
    over their ids as strings, sorted and comma-joined; contaminated: n_hit > 0 and 20 * n_hit >= n_words.  A null text has no
    words; an item without words, or a null item text, matches nothing; no items, or no documents, is no error.  Null item ids
    are left out of n_items.  Repeated rows get equal results, rows that share an id but not the text results of their own.
    """
    return _judged(docs, items, window, id_column, text_column, item_id, item_text).drop("k1", "k2")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated, with all columns."""
    bad = _judged(docs, items, window, id_column, text_column, item_id, item_text).where("contaminated").select("k1", "k2").distinct()
    keyed = docs.select(*document_key(F.col(id_column), F.coalesce(F.col(text_column).cast("string"), F.lit(""))), F.struct("*").alias("row"))
    return keyed.join(bad, ["k1", "k2"], "left_anti").select("row.*")


def contamination_sql(window: int = WINDOW) -> str:
    """contamination in SQL: every window of a document against every window of an item of the same length."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
        i AS (SELECT item_id, {words} AS w FROM benchmark),
        p AS (SELECT DISTINCT item_id, unnest(list_transform(range(0, greatest(len(w) - {window}, 0) + 1), lambda k: list_slice(w, k + 1, k + {window}))) AS ph FROM i WHERE len(w) > 0),
        n AS (SELECT DISTINCT len(ph) AS n FROM p),
        dw AS (SELECT r, n, unnest(range(0, len(w) - n + 1)) AS s, w FROM d, n WHERE len(w) >= n),
        hits AS (SELECT DISTINCT r, s, n, item_id FROM (SELECT r, s, n, list_slice(w, s + 1, s + n) AS ph FROM dw) JOIN p USING (ph)),
        cover AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS x FROM hits) GROUP BY r),
        named AS (SELECT r, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS t FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS t FROM hits) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN cover USING (r) LEFT JOIN named USING (r)"""
