"""Toxicity by a weighted lexicon.

Texts are folded first: compatibility forms and accents go, look-alike letters of other scripts become Latin, digits and
signs used as letters are read as letters, and i, l and 1 count as one. An Aho-Corasick automaton over the folded lexicon
finds the terms, whole words and stems that words begin with; a word counts by its heaviest term, unless it lies in an
exception phrase. The score is a logistic function of the logarithms of the summed weights and of the text's length, so a hit in
a long text counts for less, and what innocent texts hold by chance is not enough. A text without a hit scores 0.

Fit. Terms and weights come from labelled training rows: a sample bounded by ``docs_per_label`` for each label (chosen by
a hash of doc_id), in which texts that fold alike and have one label count once, wherever they lie. A term's weight is the smoothed log ratio of its occurrences for each toxic and each other text. It needs more
evidence in numbers of texts than chance gives any of the words tried, and different *contexts* (the words on both sides), so
that a group of copies with one label cannot make its own words toxic. The logistic function's three numbers are fitted to
the sample's sums, held near ``PRIOR`` where the sample is small.

Defined results. Null, empty and letterless texts score 0. Repeated rows score alike. Texts of any length are scored
whole. With no toxic training row, or with an empty table, the lexicon is empty and all scores are 0. Conflicting labels
of one doc_id count both. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm._common import Scratch, fold_of
from chunkloom.sources.streams import spread

DOCS_PER_LABEL = 8_000
MIN_DOCS = 3  # toxic texts that a term needs
MIN_WEIGHT = 2.5  # least log ratio of a term
MAX_WEIGHT = 10.0
STEMS = range(4, 9)  # letters of a stem
CHANCE_TERMS = 0.5  # terms that may pass by chance: the more are tried, the more evidence each needs
PRIOR = (-7.2, 4.4, -0.8)  # of the score: constant, factor of log(1 + weights), factor of log(1 + words / LENGTH_AT)
HOLD = (0.05, 0.5, 0.5)  # how strongly the fit is held near them
LENGTH_AT = 200.0  # words from which the length counts
THRESHOLD = 0.3

#: Letters of other scripts that look like Latin ones (fixed values).
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѐ": "e", "ё": "e", "ɡ": "g", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j",
    "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ү": "y",
    "α": "a", "β": "b", "ϲ": "c", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y",
    "ı": "i", "ɑ": "a", "ɩ": "i", "ʟ": "l", "ɴ": "n", "ʀ": "r", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l",
}
#: Digits and signs read as letters inside a word (fixed values).
SUBSTITUTES = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "+": "t", "€": "e"}
#: Phrases in which a listed term is no insult.
EXCEPTIONS = ("clown fish", "clownfish", "class clown", "trash can", "trash bin", "trash bag", "trash collection", "pond scum", "sore loser clause", "pathetic fallacy", "oxymoron", "stupid simple")

_DROP = {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_GLYPHS = {ord(k): v for k, v in HOMOGLYPHS.items()} | _DROP
_SUBST = str.maketrans(SUBSTITUTES)
_MIXED = re.compile(r"[0-9@$!|+€]*[^\W\d_][^\W_@$!|+€]*(?:[0-9@$!|+€]+[^\W\d_][^\W_@$!|+€]*)*")
_SIGN = re.compile(r"[0-9@$!|+€]")
_GAP = re.compile(r"[\W\d_]+")
_LIKE = str.maketrans({"l": "i"})


def fold(text: str) -> str:
    """Folded words joined by single blanks, with a blank at either end."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join([c for c in text if not unicodedata.combining(c)])
    text = text.lower()
    if not text.isascii():
        text = text.translate(_GLYPHS)
    if _SIGN.search(text):  # signs before a letter of the same word; those behind its last letter stay signs
        text = _MIXED.sub(lambda m: m[0].translate(_SUBST), text)
    return " " + _GAP.sub(" ", text).translate(_LIKE).strip() + " "


@dataclass
class Lexicon:
    """Folded terms with weights, and folded exception phrases."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = PRIOR
    _automaton: object = field(default=None, repr=False, compare=False)

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for term, w in self.weights.items():
                a.add_word(term, (len(term), w))
            for phrase in self.exceptions:
                folded = fold(phrase)
                a.add_word(folded, (len(folded), None))  # a term that is itself an exception is spared
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def weigh(self, text: str | None) -> tuple[float, int]:
        """Summed weights and number of words."""
        if not text or not self.weights:
            return 0.0, 0
        folded = fold(text)
        if len(folded) < 3:
            return 0.0, 0
        heaviest: dict[int, tuple[int, float]] = {}  # by the word's start
        spared = []
        for end, (size, w) in self.automaton().iter(folded):
            start = end + 1 - size
            if w is None:
                spared.append((start, end + 1))
            elif start not in heaviest or heaviest[start][1] < w:
                heaviest[start] = (end + 1, w)
        total = sum(w for start, (stop, w) in heaviest.items() if not any(a <= start and stop <= b for a, b in spared))
        return total, folded.count(" ") - 1

    def score(self, text: str | None) -> float:
        total, words = self.weigh(text)
        if not total:
            return 0.0
        z = float(np.dot(self.curve, _shape(total, words)))
        return 1.0 / (1.0 + math.exp(-max(-700.0, z)))


def _shape(total, words):
    """What the score's logistic function takes."""
    return np.array([np.ones_like(total, dtype=float), np.log1p(total), np.log1p(np.asarray(words) / LENGTH_AT)])


def fit_curve(total: np.ndarray, words: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of labels on weights and lengths by Newton's method, drawn towards PRIOR."""
    x, prior, hold = _shape(total, words).T, np.array(PRIOR), np.array(HOLD)
    theta = prior.copy()

    def loss(t):
        z = x @ t
        return float((weight * (np.logaddexp(0, z) - toxic * z)).sum() + 0.5 * (hold * (t - prior) ** 2).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
        grad = x.T @ (weight * (p - toxic)) + hold * (theta - prior)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(hold), grad)
        size = 1.0
        while size > 1e-6 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
        if np.abs(step).max() * size < 1e-9:
            break
    # More weight never lowers a score, and a longer text never raises it.
    return float(theta[0]), max(0.0, float(theta[1])), min(0.0, float(theta[2]))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(fold_of(F.col(id_col), 4) == 2, F.lit(False))


def fit_lexicon(docs: DataFrame, labels: DataFrame, *, docs_per_label: int = DOCS_PER_LABEL, exceptions: Sequence[str] = EXCEPTIONS) -> Lexicon:
    """docs: doc_id and text. labels: doc_id and toxic (0 or 1) of training rows only."""
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if not counts.get(1):
        return Lexicon({}, tuple(exceptions))
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, docs_per_label / counts[1]))).otherwise(F.lit(min(1.0, docs_per_label / max(1, counts.get(0, 0)))))
    spread = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(1_000_000)) / F.lit(1e6)
    # About 2 * docs_per_label pairs of numbers whatever the input's size: texts are found without moving any of them.
    chosen = F.broadcast(marked.filter(spread < share))
    sample = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic")

    scratch = Scratch(docs.sparkSession, "toxicity")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            folded = [xxhash.xxh3_128_digest(fold(t.as_py()).encode("utf-8", "surrogatepass")) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["text"], b["toxic"], pa.array(folded, pa.binary())], names=["text", "toxic", "digest"])

    sample = scratch.table(sample.mapInArrow(digests, "text string, toxic int, digest binary"), "sample")
    once = scratch.table(sample.groupBy("toxic", "digest").agg(F.first("text").alias("text")), "once")
    bad, fine = once.filter("toxic = 1").select("text"), once.filter("toxic = 0").select("text")
    numbers = "term string, docs long, times long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 500) for x in batches for i in range(0, len(x), 500)):
            times: Counter[str] = Counter()
            seen: Counter[str] = Counter()
            for text in b["text"].to_pylist():
                own: Counter[str] = Counter()
                for w, k in Counter(fold(text).split()).items():
                    for f in terms_of(w):
                        own[f] += k
                times.update(own)
                seen.update(own.keys())
            yield pa.RecordBatch.from_arrays([pa.array(list(times), pa.string()), pa.array([seen[f] for f in times], pa.int64()), pa.array(list(times.values()), pa.int64())], names=["term", "docs", "times"])

    total = lambda df: df.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("times").alias("times"))
    counted = scratch.table(total(bad.mapInArrow(count, numbers)).filter(F.col("docs") >= MIN_DOCS), "terms")
    tried = counted.count()
    n_toxic, n_clean = max(1, bad.count()), max(1, fine.count())
    base = n_toxic / (n_toxic + n_clean)
    least = 2 * math.log(max(1.0, tried / CHANCE_TERMS))  # of the G statistic, whose chance is about exp(-G / 2)
    # Only terms with enough evidence come to the driver, all of them.
    strong = counted.filter(F.col("docs") * (-2 * math.log(base)) >= least)
    others_ = total(fine.mapInArrow(count, numbers)).select("term", F.col("docs").alias("docs0"), F.col("times").alias("times0"))
    both = strong.join(others_, "term", "left").fillna(0, ["docs0", "times0"])
    ratio_ = F.log((F.col("times") + 0.1) / n_toxic) - F.log((F.col("times0") + 0.1) / n_clean)
    k, n0, n = F.col("docs"), F.col("docs0"), F.col("docs") + F.col("docs0")
    g = 2 * k * F.log(k / (n * base)) + F.when(n0 > 0, 2 * n0 * F.log(n0 / (n * (1 - base)))).otherwise(F.lit(0.0))
    wanted: dict[str, tuple[int, int]] = {}
    chosen: dict[str, float] = {}
    for r in both.withColumns({"ratio": ratio_, "g": g}).filter((F.col("ratio") >= MIN_WEIGHT) & (F.col("g") >= least)).orderBy("term").collect():
        wanted[r["term"]], chosen[r["term"]] = (r["docs"], r["docs0"]), min(MAX_WEIGHT, r["ratio"])
    if not chosen:
        return Lexicon({}, tuple(exceptions))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 500) for x in batches for i in range(0, len(x), 500)):
            found = set()
            for text in b["text"].to_pylist():
                words = fold(text).split()
                for left, word, right in zip(["", *words], words, [*words[1:], ""]):
                    around = zlib.crc32(f"{left} {right}".encode())
                    found.update((f, around) for f in terms_of(word) if f in chosen)
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([c for _, c in found], pa.int64())], names=["term", "around"])

    spread_ = bad.mapInArrow(contexts, "term string, around long").groupBy("term").agg(F.count_distinct("around").alias("n"))
    different = {r["term"]: r["n"] for r in spread_.collect()}  # as many rows as chosen
    for f in list(chosen):
        n, n0 = wanted[f]
        k = min(n, different.get(f, 0))
        if k < MIN_DOCS or evidence(k, k + n0, base) < least:
            del chosen[f]
    # A stem is no better than a longer term with nearly all of its texts.
    children: dict[str, int] = {}
    for f in chosen:
        for k in range(1 + STEMS[0], len(f)):
            children[f[:k]] = max(children.get(f[:k], 0), wanted[f][0])
    kept = [f for f in chosen if f.endswith(" ") or children.get(f, 0) < 0.95 * wanted[f][0]]
    best = sorted(kept, key=lambda f: (-wanted[f][0], f))
    lexicon = Lexicon({f: chosen[f] for f in best}, tuple(exceptions))
    weights, phrases = lexicon.weights, lexicon.exceptions

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(weights, phrases)
        for b in batches:
            found = [lex.weigh(t.as_py()) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64()), b["toxic"]], names=["total", "words", "toxic"])

    # Three numbers for each text of the bounded sample that has a hit.
    sums = sample.select("text", "toxic").mapInArrow(weigh, "total double, words long, toxic int").filter("total > 0").orderBy("total", "words", "toxic").toPandas()
    label = sums["toxic"].to_numpy(dtype=float)
    clean_share = min(1.0, docs_per_label / max(1, counts.get(0, 0)))
    toxic_share = min(1.0, docs_per_label / counts[1])
    rare = np.where(label > 0, toxic_share, clean_share)
    lexicon.curve = fit_curve(sums["total"].to_numpy(dtype=float), sums["words"].to_numpy(dtype=float), label, rare.min(initial=1.0) / rare)
    return lexicon


def terms_of(word: str) -> list[str]:
    """The word and its stems as they stand in folded text."""
    if not 3 <= len(word) <= 24:
        return []
    return [f" {word} ", *(f" {word[:k]}" for k in STEMS if k < len(word))]


def evidence(k: int, n: int, base: float) -> float:
    """G statistic of k toxic ones among n, where a share of base is expected."""
    out = 2 * k * math.log(k / (n * base)) if k else 0.0
    return out + (2 * (n - k) * math.log((n - k) / (n * (1 - base))) if n > k else 0.0)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, *, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """keep and score, one row per row of docs; a kept column of that name gives way to it."""
    from pyspark.sql import types as T

    kept = [c for c in keep if c.lower() not in ("score", "_text")]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("score", T.DoubleType())])
    weights, exceptions, curve = lexicon.weights, lexicon.exceptions, lexicon.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(weights, exceptions, curve)
        for b in batches:
            scores = pa.array([lex.score(t.as_py()) for t in b["_text"]], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), scores], names=[*kept, "score"])

    return spread(docs.select(*kept, F.col(text_col).alias("_text"))).mapInArrow(run, schema)
