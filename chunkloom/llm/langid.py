"""Language ID by rank-order profiles (Cavnar and Trenkle).

A profile is the list of a text's most frequent n-grams (n = 1 to 3, words padded by a blank), most frequent first. A
document takes the language whose profile has the least out-of-place distance: the sum over the document's n-grams of the
difference of ranks, or of the profile's length where the language lacks the n-gram.

Fit: the profiles come from a sample of the labelled training rows, of about ``docs_per_lang`` documents for each language
chosen by a hash of doc_id (a documented bound); their n-grams are counted on the executors and only the profiles
(languages x profile_size rows) come to the driver. Prediction reads every whole text; long ones are counted in slices.

Defined results. Null text or no letter: ``und`` with score 0. Equal counts rank by code points of the n-gram, equal
distances go to the language that sorts first. A language with no usable training text cannot be predicted; with no
profile at all every text with letters is ``und``. Repeated rows are predicted alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm._common import fold_of
from chunkloom.sources.streams import spread

PROFILE_SIZE = 300
DOCS_PER_LANG = 1_500
SLICE = 1 << 20  # characters counted at once

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; built once in a process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


BLANK = 1  # no letter, and not 0, so that packed n-grams of different lengths differ


def _grams(points: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Keys of the 1-, 2- and 3-grams that start in [start, stop): code points packed by 21 bits, a blank around and between words."""
    one = points[start:stop]
    a, b = points[start:stop][: len(points) - 1 - start], points[start + 1 : stop + 1]
    two = (a << 21) | b
    a, b, c = points[start:stop][: max(0, len(points) - 2 - start)], points[start + 1 : stop + 1], points[start + 2 : stop + 2]
    three = ((a << 42) | (b[: len(a)] << 21) | c[: len(a)])[b[: len(a)] != BLANK]
    return np.concatenate((one[one != BLANK], two, three))


def _points(text: str) -> Iterator[np.ndarray]:
    """Code points of a lower-cased text by slices, what is no letter as one blank between words, and a blank before the first word."""
    last, started = BLANK, False
    for i in range(0, len(text), SLICE):
        points = np.frombuffer(text[i : i + SLICE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        points = np.where(_letters()[points], points, BLANK)
        before = np.concatenate(([last], points[:-1]))
        kept = points[(points != BLANK) | (before != BLANK)]
        last = int(points[-1])
        if len(kept):
            yield kept if started else np.concatenate(([BLANK], kept))
            started = True


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram keys in ascending order, and their counts. Besides the text only a slice of it is held at a time."""
    keys, counts, rest = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(points: np.ndarray, stop: int) -> None:
        nonlocal keys, counts
        k, n = np.unique(_grams(points, 0, stop), return_counts=True)
        if len(keys):
            k, where = np.unique(np.concatenate((keys, k)), return_inverse=True)
            n = np.bincount(where, np.concatenate((counts, n)), len(k)).astype(np.int64)
        keys, counts = k, n

    pieces = _points(text.lower())
    piece = next(pieces, None)
    while piece is not None:
        rest, piece = np.concatenate((rest, piece)), next(pieces, None)
        if piece is not None and len(rest) > 2:  # n-grams that begin with the last two points go on in the next slice
            add(rest, len(rest) - 2)
            rest = rest[-2:]
    if len(rest):
        rest = rest if rest[-1] == BLANK else np.concatenate((rest, [BLANK]))
        add(rest, len(rest))
    return keys, counts


def top(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys, most frequent first, ties by key."""
    if len(keys) > 4 * size:  # drop what cannot be among the first, before sorting
        least = -np.partition(-counts, size - 1)[size - 1]
        chosen = counts >= least
        keys, counts = keys[chosen], counts[chosen]
    return keys[np.lexsort((keys, -counts))[:size]]


def fit_profiles(docs: DataFrame, *, profile_size: int = PROFILE_SIZE, docs_per_lang: int = DOCS_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """Profiles of the languages of docs, which the caller has restricted to training rows."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, docs_per_lang / n))).otherwise(share)
    spread = F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.lit(1_000_000)) / F.lit(1e6)
    sample = rows.filter(spread < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list] = {}
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist()):
                found.setdefault(lang, []).append(count_grams(text))
            for lang, parts in found.items():
                keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])

    grams = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    from pyspark.sql import Window

    ranked = grams.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= profile_size)
    profiles: dict[str, list[int]] = {}
    for r in ranked.orderBy("lang", "rank").collect():  # languages x profile_size rows
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Judge:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(profiles), size
        self.keys = np.unique(np.array([k for p in profiles.values() for k in p], dtype=np.int64))
        self.ranks = np.full((len(self.langs), len(self.keys) + 1), -1, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.keys, profiles[lang])] = np.arange(len(profiles[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        keys, counts = count_grams(text)
        if not len(keys):
            return "und", 0.0
        own = top(keys, counts, self.size)
        at = np.searchsorted(self.keys, own)
        at = np.where((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == own), at, len(self.keys))
        ranks = self.ranks[:, at]
        places = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))))
        distance = places.sum(axis=1)
        best = int(np.argmin(distance))
        return self.langs[best], float(1.0 - distance[best] / (self.size * len(own)))


def predict_languages(docs: DataFrame, profiles: dict[str, list[int]], *, profile_size: int = PROFILE_SIZE, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (default: the id), lang_pred and score, one row per row of docs; kept columns of these names give way to them."""
    from pyspark.sql import types as T

    kept = [c for c in (keep if keep is not None else [id_col]) if c.lower() not in ("lang_pred", "score", "_text")]
    rows = docs.select(*kept, F.col(text_col).alias("_text"))
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles, profile_size)
        for b in batches:
            said = [judge(t.as_py()) for t in b["_text"]]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], names=[*kept, "lang_pred", "score"])

    return spread(rows).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(fold_of(F.col(id_col), 3) == 1, F.lit(False))
