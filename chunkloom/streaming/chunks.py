"""Streaming: segment-at-a-time chunking with state for each stream, and duplicate suppression in event time."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chunkloom.config import COMPRESS, ChunkConfig
from chunkloom.functions.gear import WINDOW, gear_hashes
from chunkloom.operators.chunking import positions, select_cuts

SEGMENTS = "stream_id STRING, seg_idx LONG, data BINARY, is_last BOOLEAN"
CHUNKS = "stream_id STRING, chunk_i LONG, offset LONG, size LONG, hash STRING, is_duplicate BOOLEAN"


class Chunker:
    """State of one stream: bytes since the last cut (and 31 before it), segments that came early, hashes in the dictionary."""

    def __init__(self, cfg: ChunkConfig, dictionary: int | None):
        self.cfg, self.dictionary = cfg, dictionary
        self.before, self.tail, self.offset, self.chunks = b"", b"", 0, 0
        self.next, self.early, self.seen, self.done = 0, {}, {}, False

    def push(self, number: int, data: bytes, last: bool) -> Iterator[tuple[int, int, int, str, bool]]:
        """Chunks that are final now: number, offset, size, hash, whether one equal to it is in the dictionary."""
        if number >= self.next and not self.done:
            self.early[number] = (data, last)
        while self.next in self.early:
            data, last = self.early.pop(self.next)
            self.next += 1
            self.tail += data
            yield from self._cut(last)
            self.done = last

    def _cut(self, last: bool) -> Iterator[tuple[int, int, int, str, bool]]:
        lead = len(self.before)
        h = gear_hashes(self.before + self.tail, self.cfg.table)[lead:] if self.tail else np.empty(0, np.uint32)
        cuts = select_cuts(len(self.tail), *positions(h, self.cfg), self.cfg)
        start = 0
        for end in cuts:
            if not last and len(self.tail) - start < self.cfg.max_size:
                break  # what comes may cut it otherwise
            part = self.tail[start:end]
            digest = hashlib.md5(part).hexdigest()
            at, seen = self.offset, self.seen.get(digest)
            known = seen is not None and (self.dictionary is None or at - seen <= self.dictionary)
            self.seen[digest] = at
            yield self.chunks, at, len(part), digest, known
            self.chunks, self.offset, start = self.chunks + 1, at + len(part), end
        if start:
            self.before = (self.before + self.tail[:start])[-(WINDOW - 1) :]
            self.tail = self.tail[start:]
        if self.dictionary is not None:
            self.seen = {k: v for k, v in self.seen.items() if self.offset - v <= self.dictionary}


def chunk_stream(parts: DataFrame, cfg: ChunkConfig = COMPRESS, dictionary: int | None = 64 << 20) -> DataFrame:
    """Chunks of a stream of segments (SEGMENTS), emitted as soon as no later byte can change them.

    Segments may come in any order within and across batches; a stream ends with its segment marked is_last. The state is
    bounded by the dictionary: a hash leaves it as its last chunk falls out of reach. None keeps all hashes.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chunker = pickle.loads(state.get[0]) if state.exists else Chunker(cfg, dictionary)
        rows = []
        for pdf in batches:
            for r in pdf.sort_values("seg_idx").itertuples():
                rows += [(key[0], *c) for c in chunker.push(int(r.seg_idx), b"" if r.data is None else bytes(r.data), bool(r.is_last))]
        if chunker.done:  # what is left says that the stream has ended, so late repetitions of its segments are known
            chunker = Chunker(cfg, dictionary)
            chunker.done = True
        state.update((pickle.dumps(chunker),))
        yield pd.DataFrame(rows, columns=["stream_id", "chunk_i", "offset", "size", "hash", "is_duplicate"])

    return parts.groupBy("stream_id").applyInPandasWithState(step, CHUNKS, "chunker BINARY", "append", GroupStateTimeout.NoTimeout)


def suppress_duplicates(events: DataFrame, keys: list[str], ts: str = "ts", within: str = "10 minutes") -> DataFrame:
    """The first event of equal keys within the watermark: the dictionary window in event time."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events, bytes of props and different props (approximate) in tumbling windows."""
    w = F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("props")).alias("bytes"), F.approx_count_distinct("props").alias("different"))
