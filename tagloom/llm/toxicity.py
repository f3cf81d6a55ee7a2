"""Toxicity by a weighted lexicon.

Texts are folded: compatibility forms and accents go, homoglyphs of other
scripts become Latin letters, and digits and signs that stand for letters become
those.  Anything but letters then separates words.  As l, I, 1 and | pass for
each other, an Aho-Corasick automaton finds the lexicon's words and stems
(beginnings of words) in one pass over the folded text with l written as i; each
match is then looked up as it is spelt.  A spelling that the labelled rows show
to be a harmless word (fail beside fall) has no weight, an unknown one, so most
likely a disguise, that of the term.  Occurrences inside an exception phrase
don't count: phrases of two words that are a table's, or that the labelled rows
show to be harmless.  The weights of the matches are summed and normalised by
length, and a logistic curve makes the score.

The lexicon is learned from labelled rows: terms whose share of toxic documents
exceeds that of the others by far.  The sample of rows to learn from and the
lexicon are bounded by parameters; every text is scored whole.

Null texts, texts without a letter and very short ones get the score of a text
without match.  Without labelled rows every score is 0.5.  Repeated rows are
scored each, very long texts whole; an empty table gives an empty result.
Filtering keeps all columns, whatever their names, and only reads doc_id and text.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices, staged
from .learning import labelled, logistic, remainder

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "д": "d", "е": "e", "з": "e", "и": "u", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "һ": "h", "ӏ": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ո": "n", "օ": "o", "ս": "u", "ց": "g", "հ": "h", "ƚ": "l", "ł": "l", "ø": "o", "đ": "d", "ß": "ss",
}
#: Digits and signs written for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l", "+": "t"}
#: A table of phrases in which a word of the lexicon isn't meant; others are learned.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown car", "idiot proof", "pathetic fallacy", "sore loser rule", "pond scum")
STEMS = (3, 4, 5, 6, 7)

_SIGN = re.compile(r"[@$!|€£+](?=\w)")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_MARKS = regex.compile(r"\p{Mn}+")
_BREAK = re.compile(r"[\W\d_]+")
_DIGITS = re.compile(r"\d+")
_HOMOGLYPHS = {ord(k): v for k, v in HOMOGLYPHS.items()}
_DIGIT_TABLE = {ord(k): v for k, v in DIGITS.items()}
#: For ASCII: letters stay, anything else is a blank.
_LETTERS = "".join(chr(c) if chr(c).isalpha() else " " for c in range(128))


def _signs(text: str) -> str:
    """Signs within a word, and @ and $ at its beginning, as letters."""

    def letter(m):
        before = text[m.start() - 1 : m.start()]
        return SIGNS[m[0]] if m[0] in "@$" or before.isalnum() or before == "_" else m[0]

    return _SIGN.sub(letter, text)


def _digits(text: str) -> str:
    """Digits between letters, or at one end of a word with two letters beside them, as letters."""

    def letters(m):
        a, b = m.span()
        before, after = text[max(0, a - 2) : a], text[b : b + 2]
        inside = before[-1:].isalpha() and after[:1].isalpha()
        first = len(after) == 2 and after.isalpha() and not (before[-1:].isalnum() or before[-1:] == "_")
        last = len(before) == 2 and before.isalpha() and not (after[:1].isalnum() or after[:1] == "_")
        return m[0].translate(_DIGIT_TABLE) if inside or first or last else m[0]

    return _DIGITS.sub(letters, text)


def fold(text: str) -> str:
    """Folded words, each between single spaces; one space without words."""
    if not text.isascii():
        text = _MARKS.sub("", _HIDDEN.sub("", unicodedata.normalize("NFKD", text)))
    text = text.lower()
    if _SIGN.search(text):
        text = _signs(text)
    if _DIGITS.search(text):
        text = _digits(_digits(text))  # a letter made of a digit can be what another digit needs beside it
    if not text.isascii():
        text = text.translate(_HOMOGLYPHS)
        if not text.isascii():
            return f" {_BREAK.sub(' ', text).strip()} "
    return f" {' '.join(text.translate(_LETTERS).split())} "


def merged(folded: str) -> str:
    """Letters that pass for each other as one."""
    return folded.replace("l", "i")


class Lexicon:
    """Terms with weights: ' word ' is a whole word, ' stem' the beginning of one; harmless terms have the letters of one but are spelt otherwise."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS, harmless: tuple[str, ...] = ()):
        self.weights, self.exceptions, self.harmless = weights, tuple(fold(x) for x in exceptions), tuple(harmless)
        self._tries = None

    def __getstate__(self):
        return self.weights, self.exceptions, self.harmless

    def __setstate__(self, state):
        (self.weights, self.exceptions, self.harmless), self._tries = state, None

    @property
    def tries(self):
        if self._tries is None:
            spelt: dict[str, dict[str, float]] = {}
            for term, weight in self.weights.items():
                spelt.setdefault(merged(term), {})[term] = weight
            top = {form: max(known.values()) for form, known in spelt.items()}
            for term in self.harmless:
                if merged(term) in spelt:
                    spelt[merged(term)].setdefault(term, 0.0)
            terms, phrases = ahocorasick.Automaton(), ahocorasick.Automaton()
            for form, known in spelt.items():
                terms.add_word(form, (len(form), known, top[form]))
            for phrase in self.exceptions:
                terms_of = merged(phrase)
                phrases.add_word(terms_of, len(terms_of))
            for trie in (terms, phrases):
                trie.make_automaton()
            self._tries = terms, phrases
        return self._tries

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """First and last place and weight of every match in a folded text."""
        terms, phrases = self.tries
        if not len(terms):
            return []
        text = merged(folded)
        found = []
        for end, (size, known, otherwise) in terms.iter(text):
            weight = known.get(folded[end - size + 1 : end + 1], otherwise)
            if weight:
                found.append((end - size + 1, end, weight))
        if found and len(phrases):
            spans = [(end - size + 1, end) for end, size in phrases.iter(text)]
            if spans:
                found = [m for m in found if not any(a <= m[0] and m[1] <= b for a, b in spans)]
        return found

    def measures(self, text: str) -> tuple[float, float, float]:
        """Of a whole text: weight of the matches, matches, words."""
        folded = fold(text)
        found = self.matches(folded)
        return sum((m[2] for m in found), 0.0), float(len(found)), float(max(0, folded.count(" ") - 1))


def _features(m: np.ndarray) -> np.ndarray:
    """From measures (rows): weight and matches normalised by length, damped; and whether there is a match."""
    total, many, words = m.T
    return np.column_stack([np.log1p(total), np.log1p(100 * total / (words + 20)), np.minimum(many, 3), np.log1p(100 * many / (words + 20))])


def _terms(batches):
    for batch in batches:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for part in slices(batch, "text"):
            for text, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True):
                words = set(fold(text or "").split())
                terms = {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in STEMS if len(w) > n}
                found[y].update(terms)
        for y in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(list(found[y]), pa.string()), pa.array([y] * len(found[y]), pa.int32()), pa.array(list(found[y].values()), pa.int64())], names=["term", "y", "n"])


def _tail(k: int, n: int, share: float, upper: bool) -> float:
    """Chance of at least (upper) or at most k of n, each with this share."""
    if not 0 < share < 1:
        return float((share >= 1) if upper and k else (share <= 0) if not upper and k < n else 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(n, 0, -1)) - np.log(np.arange(1, n + 1)))]) + np.arange(n + 1) * np.log(share) + np.arange(n, -1, -1) * np.log1p(-share)
    return float(np.exp(logs[k:] if upper else logs[: k + 1]).sum())


def least_support(pos: int) -> int:
    """In how many toxic texts a term is at least: 5, fewer (3 at least) where only few rows are toxic."""
    return max(3, min(5, pos // 20))


def learn_lexicon(rows: DataFrame, min_support: int | None = None, min_odds: float = 2.5, chance: float = 0.05, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """All terms that tell toxic rows (y = 1) from others, with their log odds: at least min_odds.

    A term is in at least min_support distinct toxic texts (least_support of the
    toxic rows unless given), and in more of them than a term without meaning would
    be with this chance; repeated texts count once, so that copies of one row don't
    make a term.  The rows are a bounded sample, and so are their terms.
    """
    rows = staged(rows.select("text", "y").dropDuplicates(["text", "y"]), "distinct")
    docs = dict(rows.groupBy("y").count().collect())
    pos, neg = docs.get(1, 0), docs.get(0, 0)
    if not pos or not neg:
        return Lexicon({}, exceptions)
    p, q = (F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(name) for y, name in ((1, "p"), (0, "q")))
    odds = F.log((F.col("p") + 0.5) / pos) - F.log((F.col("q") + 0.5) / neg)
    counts = staged(map_batches(rows, _terms, "term string, y int, n bigint").groupBy("term").agg(p, q).withColumn("w", odds), "terms")
    found = counts.where(F.col("p") >= (min_support or least_support(pos))).where(F.col("w") >= min_odds).orderBy(F.desc(F.col("w") * F.sqrt("p")), "term").collect()
    found = [r for r in found if _tail(r["p"], r["p"] + r["q"], pos / (pos + neg), upper=True) <= chance]
    support = {r["term"]: r["p"] for r in found}
    weight = {r["term"]: r["w"] for r in found}
    kept: dict[str, float] = {}
    # a shorter stem counts where it covers clearly more than any longer term below it; terms below a kept stem go
    below: Counter = Counter()
    for term, n in support.items():
        for size in range(2, len(term)):
            below[term[:size]] = max(below[term[:size]], n)
    for term in sorted(support, key=lambda t: (len(t.rstrip()), t)):
        bare = term.rstrip()
        if any(bare[:n] in kept for n in range(2, len(bare) + (term != bare))):
            continue
        if term == bare and support[term] < 1.5 * below[term]:
            continue
        kept[term] = float(weight[term])
    # other spellings of the same letters that are no more frequent in toxic rows
    forms = rows.sparkSession.createDataFrame([(merged(t),) for t in kept], "form string")
    twins = counts.where("w <= 0").join(F.broadcast(forms.distinct()), F.translate("term", "l", "i") == F.col("form"), "left_semi").select("term").collect() if kept else []
    words = Lexicon(kept, (), tuple(sorted(r["term"] for r in twins)))
    return Lexicon(kept, (*exceptions, *learn_exceptions(rows, counts, words, neg)), words.harmless)


def _matched(folded: str, words: Lexicon) -> set[tuple[str, str, str]]:
    """(word, phrase with the word before, phrase with the word after) of every word with a match; an empty phrase at an end."""
    out = set()
    for a, _, _ in words.matches(folded):
        end = folded.index(" ", a + 1)
        left = folded[folded.rindex(" ", 0, a) + 1 : end] if a else ""
        right = folded[a + 1 : folded.index(" ", end + 1)] if end + 1 < len(folded) else ""
        out.add((folded[a + 1 : end], left, right))
    return out


def learn_exceptions(rows: DataFrame, counts: DataFrame, words: Lexicon, neg: int, min_support: int = 5, chance: float = 0.001, most_common: float = 0.1, less: float = 0.25) -> list[str]:
    """Phrases of two words, one of them with a match, that make it harmless.

    A phrase is in min_support harmless texts; its odds of being in a toxic one are
    at most `less` of its word's, and as few toxic texts as it has would come by
    chance from the word's own rate at most with this chance; and its other word is
    in at most most_common of all harmless texts, so that no article or pronoun
    excuses anything.  A match between two such phrases counts for the one whose
    other word is more peculiar to the match, and a phrase stays only for what it so
    explains itself: "a clown" isn't one where it always goes on with "fish".
    """
    if not words.weights:
        return []

    def named(found: tuple[Counter, Counter]):
        for y in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array(list(found[y]), pa.string()), pa.array([y] * len(found[y]), pa.int32()), pa.array(list(found[y].values()), pa.int64())], names=["term", "y", "n"])

    def counted(choose):
        def run(batches):
            for batch in batches:
                found: tuple[Counter, Counter] = (Counter(), Counter())
                for part in slices(batch, "text"):
                    for text, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True):
                        found[y].update(choose(_matched(fold(text or ""), words)))
                yield from named(found)

        p, q = (F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(name) for y, name in ((1, "p"), (0, "q")))
        return map_batches(rows, run, "term string, y int, n bigint").groupBy("term").agg(p, q)

    # words stand alone in this table, phrases have a blank; only phrases of some support and their words come to the driver
    seen = staged(counted(lambda matched: {x for m in matched for x in m if x}), "phrases")
    phrases = seen.where(F.col("term").contains(" ")).where(F.col("q") >= min_support)
    alone = phrases.select(F.explode(F.split("term", " ")).alias("term")).distinct()
    share = {r["term"]: (r["p"], r["q"]) for r in seen.join(alone, "term", "left_semi").collect()}
    common = {r["term"].strip(): r["q"] for r in counts.join(alone.select(F.concat(F.lit(" "), "term", F.lit(" ")).alias("term")), "term", "left_semi").collect()}

    def passes(word: str, p: int, q: int) -> bool:
        pw, qw = share[word]
        return q >= min_support and (p + 0.5) / (q + 0.5) <= less * (pw + 0.5) / (qw + 0.5) and _tail(p, p + q, (pw + 0.5) / (pw + qw + 1), upper=False) <= chance

    rank: dict[tuple[str, bool], tuple] = {}
    for r in phrases.collect():
        first, second = r["term"].split(" ")
        for word, other, after in ((first, second, True), (second, first, False)):
            if word in share and common.get(other, 0) <= most_common * neg and passes(word, r["p"], r["q"]):
                lift = r["q"] * neg / (share[word][1] * max(1, common.get(other, 0)))
                rank[r["term"], after] = (-round(lift, 9), -r["q"], not after, r["term"])

    def explained(matched):
        out = set()
        for _, left, right in matched:
            both = [x for x in ((right, True), (left, False)) if x in rank]
            if both:
                out.add(min(both, key=rank.__getitem__)[0])
        return out

    if not rank:
        return []
    words_of: dict[str, list[str]] = {}
    for phrase, after in rank:
        words_of.setdefault(phrase, []).append(phrase.split(" ")[0 if after else 1])
    alone_in = {r["term"]: (r["p"], r["q"]) for r in counted(explained).collect()}
    return sorted(x for x, (p, q) in alone_in.items() if any(passes(w, p, q) for w in words_of[x]))


class Scorer:
    """A lexicon and the coefficients of its logistic curve."""

    def __init__(self, lexicon: Lexicon, coefficients: np.ndarray):
        self.lexicon, self.coefficients = lexicon, coefficients

    def scores(self, texts: list[str | None]) -> np.ndarray:
        m = np.array([self.lexicon.measures(t or "") for t in texts]).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(self.coefficients[0] + _features(m) @ self.coefficients[1:], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, most_rows: int = 20_000, **lexicon) -> Scorer:
    """Learns from labels.toxic where crc32(doc_id) % modulus isn't held_out; most_rows bounds the sample."""
    rows = labelled(docs, labels, "toxic", remainder(F.col("doc_id"), modulus) != held_out, most_rows)
    words = learn_lexicon(rows, **lexicon)

    def measured(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                m = [words.measures(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("y"), *(pa.array([x[i] for x in m], pa.float64()) for i in range(3))], names=["y", "total", "many", "words"])

    seen = map_batches(rows.select("text", "y"), measured, "y int, total double, many double, words double").toPandas()
    seen = seen.sort_values(["y", "total", "many", "words"])  # rows come in any order; sums of doubles depend on it
    return Scorer(words, logistic(_features(seen[["total", "many", "words"]].to_numpy(float).reshape(-1, 3)), seen["y"].to_numpy(float)))


def score(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = learn(docs, labels, modulus, held_out, **options)

    def scored(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                p = model.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", "text", (remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"))
    return map_batches(base, scored, f"doc_id {kind}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, most: float = 0.5, **options) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below `most`; all rows where no term was learned."""
    model = learn(docs, labels, **options)
    if not model.lexicon.weights:
        return docs

    def chosen(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(model.scores(part.column("text").to_pylist()) < most))

    return map_batches(docs, chosen, docs.schema)
