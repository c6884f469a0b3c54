"""BPE encoding and decoding by a tokenization automaton.

Compilation. The automaton runs over *tokens*: it accepts exactly the token sequences that BPE produces. It starts as one
state with a loop for each base symbol; a token is an arc, and behind it lies the state that has its name. Each merge
(u, v) -> w, taken in order of rank, adds a gadget:

* the state behind ``w`` is a copy of the one behind ``v`` at that time;
* wherever ``u`` and then ``v`` could be read, an arc ``w`` is added;
* behind ``u`` the arc ``v`` is taken away, and with it the arcs that later gadgets build upon it (for u = v also ``w``: the
  leftmost pair merges first).

Tokens are numbered along the tree of left parts, a node's latest child first. In this numbering a gadget takes away one
range of arcs: ``v`` and what is built upon it from this rank on. So a state is a list of ranges without arcs: its own gadgets' and, copied,
those of its right part's state up to its rank. A state's row of the transition table, the sorted bounds of the joined ranges, is
written out when the state is first entered; equal rows are one state. (All rows at once would be 49 thousand rows of thousands of bounds.)

Encoding. BPE's result for a prefix of base symbols is unique, so the automaton composed with a word's symbols is
deterministic: from left to right, each position is reached by exactly one arc whose symbols end there. A dictionary matcher emits the
arcs that end at a position, the table says which of them leads on from the state where it starts, and the word's tokens
are the arcs on the way to its end. Every symbol is looked at once; nothing is tried again. Decoding emits the arcs' labels.

Defined results. Null text: as empty (no token). Special tokens' strings in a text are their own tokens, as in the
tokenizer file; texts are normalised (NFC, white space, lower case), split into words and mapped byte by byte to
symbols. Letters are those of Unicode 16 and lower case is that of Unicode 17, as in the library, whatever this Python knows. Extra columns are
ignored, repeated rows are encoded alike, an empty table gives an empty result. Runs between blanks are
memoised up to ``cache_words`` in a process; beyond that the older half goes, so memory is bounded.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.sources.streams import spread

CACHE_WORDS = 600_000
MEMO_LETTERS = 64  # longer runs between blanks are seldom met again

#: White space as Unicode defines it.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters and numbers that came after Unicode 16 (fixed values: first and last code point of each range).
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2),
    (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2),
    (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Lower case of letters that came with Unicode 16 and 17 (fixed values: code point, lower case, number of pairs).
LOWER = ((0x1C89, 0x1C8A, 1), (0xA7CB, 0x264, 1), (0xA7CC, 0xA7CD, 1), (0xA7CE, 0xA7CF, 1), (0xA7D2, 0xA7D3, 1), (0xA7D4, 0xA7D5, 1), (0xA7DA, 0xA7DB, 1), (0xA7DC, 0x19B, 1), (0x10D50, 0x10D70, 22), (0x16EA0, 0x16EBB, 25))
_LOWER = {a + i: b + i for a, b, n in LOWER for i in range(n)}
_NEWER = "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in NEWER)
#: Words of the vocabulary's pre-tokenizer (fixed pattern of the file).
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + WHITE + r"\p{L}\p{N}]+")
#: The same where a text has letters or numbers that the library does not know.
WORDS_OF_NEWER = regex.compile(r"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{L}--[" + _NEWER + r"]]+|[\p{N}--[" + _NEWER + r"]]|[[^" + WHITE + r"\p{L}\p{N}]||[" + _NEWER + "]]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_BLANKS = re.compile(f"[{WHITE}]+")
_MAYBE_NEWER = re.compile(f"[^\x00-{chr(NEWER[0][0] - 1)}]")
_IS_NEWER = re.compile("[" + "".join(f"{chr(a)}-{chr(z)}" for a, z in NEWER) + "]")


def split_words(text: str) -> list[str]:
    """Words of a normalised text."""
    newer = not text.isascii() and _MAYBE_NEWER.search(text) and _IS_NEWER.search(text)
    return (WORDS_OF_NEWER if newer else WORDS).findall(text)


def byte_symbols() -> list[str]:
    """Printable characters that stand for bytes in byte-level vocabularies: printable Latin-1 stands for itself."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    table = dict(zip(own, map(chr, own))) | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Automaton:
    """The compiled merges of a tokenizer file with word ends."""

    END = "\u0100"  # stands for the end of a word; bytes stand for themselves

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], word_end: str):
        self.vocab, self.word_end = vocab, word_end
        self.labels = {i: t for t, i in vocab.items()}
        byte_of = {c: chr(b) for b, c in enumerate(byte_symbols())}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}  # rank of the gadget that made the token
        self.gadgets: dict[int, list[tuple[int, int]]] = {}  # by left part: rank and right part, in order of rank
        self.built: dict[int, list[int]] = {}  # by left part: tokens built upon it, in order of rank
        self.dead: set[int] = set()  # tokens whose arc no gadget could add
        for rank, (u, v) in enumerate(merges):
            self._gadget(rank, vocab[u], vocab[v], vocab[u + v])
        self._number()
        self.numbers: dict[int, int] = {}  # token: number of the state behind it
        self.rows: list[list[int]] = [[]]  # by state: bounds of the ranges without arcs; state 0 is the start
        self._known: dict[bytes, int] = {b"": 0}
        self._ranges: dict[int, tuple[np.ndarray, np.ndarray, list[int]]] = {}
        self.matcher = ahocorasick.Automaton()
        self.whole: dict[str, int] = {}  # words that are one token
        for label, t in vocab.items():
            if t not in self.dead:
                ends = label.endswith(word_end) and label != word_end
                spelled = "".join([byte_of[c] for c in (label.removesuffix(word_end) if ends else label)]) + self.END * ends
                if ends:
                    self.whole[spelled[:-1]] = t
                self.matcher.add_word(spelled, (len(spelled), t, self.place[t]))
        self.matcher.make_automaton()

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        if (u, v) in self.rank or w in self.parts:
            return
        if u in self.dead or v in self.dead or not self._could_be_read(u, v, rank):
            self.dead.add(w)
        self.rank[u, v], self.parts[w], self.born[w] = rank, (u, v), rank
        self.gadgets.setdefault(u, []).append((rank, v))
        self.built.setdefault(u, []).append(w)

    def _could_be_read(self, u: int, v: int, rank: int) -> bool:
        """Whether behind u there is an arc v, as made by the gadgets before rank: no end of u has merged with a beginning of v."""
        x, until = u, rank
        while True:
            y, until_ = v, rank
            while True:
                if self.rank.get((x, y), rank) < min(until, until_ + (x == y)):
                    return False
                if y not in self.parts:
                    break
                y, until_ = self.parts[y][0], self.born[y]
            if x not in self.parts:
                return True
            x, until = self.parts[x][1], self.born[x]

    def _number(self) -> None:
        """Places of the tokens in the tree of left parts, the latest child first, and where their subtrees end."""
        self.place: dict[int, int] = {}
        self.stop: dict[int, int] = {}
        n = 0
        for top in self.labels:
            if top in self.parts:
                continue
            todo = [(top, False)]
            while todo:
                t, done = todo.pop()
                if done:
                    self.stop[t] = n
                    continue
                self.place[t] = n
                n += 1
                todo.append((t, True))
                todo.extend((c, False) for c in self.built.get(t, ()))  # the last one is taken first

    def _taken(self, u: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """The ranges of arcs that the gadgets of left part u take away behind it, and their ranks."""
        found = self._ranges.get(u)
        if found is None:
            first, last, ranks = [], [], []
            for rank, v in self.gadgets.get(u, ()):
                children = self.built.get(v, [])
                older = bisect_left(children, rank, key=self.born.__getitem__)
                first.append(self.place[v])
                last.append(self.place[children[older - 1]] if older else self.stop[v])
                ranks.append(rank)
            found = self._ranges[u] = (np.array(first, np.int64), np.array(last, np.int64), ranks)
        return found

    def state(self, token: int) -> int:
        """Number of the state behind a token, whose row is written out now at the latest."""
        number = self.numbers.get(token)
        if number is None:
            first, last, _ = self._taken(token)
            starts, ends, t = [first], [last], token
            while t in self.parts:  # what is copied from the right part's state at the time of the gadget
                until, t = self.born[t], self.parts[t][1]
                first, last, ranks = self._taken(t)
                k = bisect_left(ranks, until)
                starts.append(first[:k])
                ends.append(last[:k])
                if not k and t not in self.parts:
                    break
            first, last = np.concatenate(starts), np.concatenate(ends)
            bounds = np.empty(0, np.int64)
            if len(first):
                order = np.argsort(first, kind="stable")
                first, last = first[order], np.maximum.accumulate(last[order])
                new = np.concatenate(([True], first[1:] > last[:-1]))
                at = np.flatnonzero(new)
                bounds = np.column_stack((first[at], last[np.append(at[1:], len(first)) - 1])).ravel()
            key = bounds.tobytes()
            number = self._known.get(key) if key else 0
            if number is None:
                number = self._known[key] = len(self.rows)
                self.rows.append(bounds.tolist())
            self.numbers[token] = number
        return number

    def arc(self, a: int, b: int) -> bool:
        """Whether the state behind token a has arc b."""
        return b not in self.dead and not bisect_right(self.rows[self.state(a)], self.place[b]) & 1

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one pre-split word."""
        if not word:
            return []
        rows, numbers, state = self.rows, self.numbers, self.state
        text = word if word.isascii() else word.encode("utf-8").decode("latin-1")
        whole = self.whole.get(text)
        if whole is not None:
            return [whole]  # one arc from the start to the end; there is no other path
        n = len(text)
        row: list[list[int] | None] = [None] * (n + 2)  # of the state in which a position is reached
        arcs = [0] * (n + 2)
        back = [0] * (n + 2)
        row[0] = rows[0]
        for end, (size, token, place) in self.matcher.iter(text + self.END):
            end += 1
            if row[end] is not None or end == n:  # only arcs over the word's end lead from its last symbol on
                continue
            here = row[end - size]
            if here is not None and not bisect_right(here, place) & 1:
                arcs[end], back[end] = token, end - size
                number = numbers.get(token)
                row[end] = rows[state(token) if number is None else number]
        out, at = [], n + 1
        while at:
            out.append(arcs[at])
            at = back[at]
        out.reverse()
        return out


class Codec:
    """Texts to tokens and back, as the tokenizer file says."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.automaton.labels | {i: t for t, i in self.special.items()}
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        self.memo = Memo(self, cache_words, Memo(self, cache_words))

    @staticmethod
    def normalise(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if _MAYBE_NEWER.search(text):
                text = text.translate(_LOWER)
            text = text.replace("Σ", "σ")  # each character by itself: no final sigma
        return text.lower()

    def words(self, text: str) -> Iterator[str | int]:
        """Pre-split words; special tokens as ids."""
        at = 0
        for m in self.cut.finditer(text) if "<" in text else ():
            yield from split_words(self.normalise(text[at : m.start()]))
            yield self.special[m[0]]
            at = m.end()
        yield from split_words(self.normalise(text[at:] if at else text))

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        encode_word = self.automaton.encode_word
        for w in self.words(text or ""):
            if isinstance(w, int):
                out.append(w)
            else:
                out.extend(encode_word(w))
        return out

    def decode(self, ids: list[int]) -> str:
        """Labels of the arcs, joined as the file's missing decoder joins them: by one space."""
        return " ".join([self.labels[i] for i in ids])

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens, sha256 of the ids and of the decoded text."""
        # No word crosses white space, and normalisation leaves its places alone: runs between blanks are encoded by themselves.
        if not text or text.isspace():
            text = ""
        elif "<" not in text:  # no special token
            text = self.normalise(text)
        if not text:
            chunks = []
        elif _SEPARATORS.search(text):  # Python splits at these, the library does not
            chunks = _BLANKS.sub(" ", text).strip(" ").split(" ")
        else:
            chunks = text.split()
        pairs = list(map(self.memo.__getitem__, chunks))
        ids, labels = (b" ".join(x) for x in zip(*pairs)) if pairs else (b"", b"")
        return ids.count(b" ") + bool(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(labels).hexdigest()


class Memo(dict):
    """Joined ids and labels of words, or of runs between blanks (given the words' memo); when it is full, the older half goes."""

    def __init__(self, codec: Codec, size: int, words: Memo | None = None):
        self.codec, self.size, self.words = codec, size, words

    def __missing__(self, key: str) -> tuple[bytes, bytes]:
        if len(self) >= self.size:
            for old in list(itertools.islice(self, self.size // 2 + 1)):
                del self[old]
        if self.words is None:
            ids = self.codec.automaton.encode_word(key)
            found = " ".join(map(str, ids)).encode(), self.codec.decode(ids).encode("utf-8")
        else:
            words = self.words
            if key.isalpha() and (low := self.codec.normalise(key)).isalpha():  # what Python knows as a letter, the library knows
                found = words[low]
            elif "<" in key:
                ids = self.codec.encode(key)
                found = " ".join(map(str, ids)).encode(), self.codec.decode(ids).encode("utf-8")
            elif key[-1] in ",." and (low := self.codec.normalise(key[:-1])).isalpha():
                (ids, labels), (ids_, labels_) = words[low], words[key[-1]]
                found = ids + b" " + ids_, labels + b" " + labels_
            else:
                parts = [words[w] for w in split_words(self.codec.normalise(key))]
                found = parts[0] if len(parts) == 1 else tuple(map(b" ".join, zip(*parts)))
        if len(key) <= MEMO_LETTERS:
            self[key] = found
        return found


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """Compiled once in a process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array of int) per row. path: a tokenizer file that every executor has."""
    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = pa.array([c.encode(t.as_py()) for t in b[text_col]], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b[id_col], ids], names=[id_col, "ids"])

    return spread(docs.select(id_col, text_col)).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text (decoded) per row."""
    schema = T.StructType([encoded.schema[id_col], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = pa.array([c.decode(x.as_py() or []) for x in b[ids_col]], pa.string())
            yield pa.RecordBatch.from_arrays([b[id_col], texts], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, schema)


def encode_digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode and decode in one pass: id, n_tokens, ids_sha256, decoded_sha256. Arcs' labels are emitted word by word."""
    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            rows = [c.digest(t.as_py()) for t in b[text_col]]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b[id_col], *cols], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return spread(docs.select(F.col(id_col), F.col(text_col))).mapInArrow(run, schema)
