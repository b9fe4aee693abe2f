"""Streams of samples cut into overlapping chunks, in batch and with Structured Streaming.

A stream's pushes (stream_id, seq, samples, eos) are buffered; whenever CHUNK samples are there, a chunk goes out and HOP samples
are let go, so neighbours share a second. eos sends out the rest. Offsets are in samples from the stream's start.

Pushes count from 0. In batch all are there and are read in order, over numbers that are missing. In a live stream a push that is
ahead waits until the missing ones are there, or until PATIENCE pushes wait; then the missing ones are given up. A push that was
taken or given up is passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHUNK, HOP, PATIENCE = 480_000, 464_000, 64
OUT = "stream_id long, chunk_idx long, start_sample long, n_samples long, energy double, last boolean"
SAMPLES = "stream_id long, chunk_idx long, start_sample long, samples array<float>, last boolean, buffered long"


def energy_row(stream, idx: int, start: int, samples: np.ndarray, last: bool, buffered: int) -> tuple:
    x = samples.astype(np.float64)
    return stream, idx, start, len(x), float(x @ x), last


def sample_row(stream, idx: int, start: int, samples: np.ndarray, last: bool, buffered: int) -> tuple:
    return stream, idx, start, samples, last, buffered


class Chunker:
    """The buffer of one stream; state is (buffer, samples let go, chunks sent, highest seq)."""

    def __init__(self, chunk: int, hop: int, state: tuple | None = None, row: Callable[..., tuple] = energy_row):
        self.chunk, self.hop, self.row = chunk, hop, row
        self.buffer, self.processed, self.sent, self.seq = (np.asarray(state[0], np.float32), *state[1:]) if state else (np.zeros(0, np.float32), 0, 0, -1)

    def _send(self, stream, n: int, last: bool) -> tuple:
        self.sent += 1
        return self.row(stream, self.sent - 1, self.processed, self.buffer[:n], last, len(self.buffer) - n)

    def push(self, stream, seq: int, samples, eos: bool) -> Iterator[tuple]:
        """Chunks that this push completes. A push that was taken before is passed over."""
        if seq <= self.seq:
            return
        self.seq = seq
        if samples is not None and len(samples):
            self.buffer = np.concatenate([self.buffer, np.asarray(samples, np.float32)])
        while len(self.buffer) >= self.chunk:
            yield self._send(stream, self.chunk, False)
            self.buffer, self.processed = self.buffer[self.hop :], self.processed + self.hop
        if eos:
            if len(self.buffer):
                yield self._send(stream, len(self.buffer), True)
            self.processed, self.buffer = self.processed + len(self.buffer), self.buffer[:0]


def columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def batch_chunks(pushes: DataFrame, chunk: int = CHUNK, hop: int = HOP, samples: bool = False) -> DataFrame:
    """The chunks of whole streams, with their energies or `samples`; a stream is read in order, its pushes aren't held together."""
    out, row = (SAMPLES, sample_row) if samples else (OUT, energy_row)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, rows = None, None, []
        for pdf in frames:
            for stream, seq, x, eos in zip(pdf.stream_id, pdf.seq, pdf.samples, pdf.eos):
                if stream != at:
                    at, state = stream, Chunker(chunk, hop, row=row)
                rows += state.push(stream, seq, x, bool(eos))
            yield pd.DataFrame(rows, columns=columns(out))
            rows = []

    return pushes.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInPandas(cut, out)


def in_order(ahead: dict[int, tuple], taken: int, patience: int) -> Iterator[tuple]:
    """Takes (seq, samples, eos) off the waiting pushes as far as their order is known."""
    for seq in sorted(ahead):
        if seq > taken + 1 and len(ahead) <= patience:
            return
        taken = max(taken, seq)
        yield ahead.pop(seq)


class ChunkProcessor(StatefulProcessor):
    def __init__(self, chunk: int, hop: int, samples: bool, patience: int):
        self.chunk, self.hop, self.patience = chunk, hop, patience
        self.out, self.row = (SAMPLES, sample_row) if samples else (OUT, energy_row)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("chunker", "buffer array<float>, processed long, sent long, seq long")
        self.waiting = handle.getListState("waiting", "seq long, samples array<float>, eos boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = Chunker(self.chunk, self.hop, tuple(self.state.get()) if self.state.exists() else None, self.row)
        ahead = {t[0]: tuple(t) for t in self.waiting.get()} if self.waiting.exists() else {}
        for pdf in rows:
            for seq, samples, eos in zip(pdf.seq, pdf.samples, pdf.eos):
                if seq > held.seq:
                    ahead.setdefault(int(seq), (int(seq), [] if samples is None else list(map(float, samples)), bool(eos)))
        out: list[tuple] = []
        for seq, samples, eos in in_order(ahead, held.seq, self.patience):
            out += held.push(key[0], seq, samples, eos)
        self.state.update((held.buffer.tolist(), held.processed, held.sent, held.seq))
        if ahead:
            self.waiting.put([ahead[seq] for seq in sorted(ahead)])
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=columns(self.out))

    def close(self) -> None:
        pass


def stream_chunks(pushes: DataFrame, chunk: int = CHUNK, hop: int = HOP, samples: bool = False, patience: int = PATIENCE) -> DataFrame:
    """The same over a streaming DataFrame; a stream's state is less than a chunk of samples and at most `patience` pushes that are
    ahead. Needs the RocksDB store."""
    out = SAMPLES if samples else OUT
    return pushes.groupBy("stream_id").transformWithStateInPandas(ChunkProcessor(chunk, hop, samples, patience), out, "Append", "None")
