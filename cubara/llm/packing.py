"""Order-preserving packing of documents into token sequences by dynamic programming.

Documents follow one another in id order. A sequence is a window of that stream
of at most `length` ids; its cost is its padding (none if its length is a power
of two, else up to `length`) plus a penalty for the cut at its end: none at a
document's end, CUT_SENTENCE inside one at a sentence's end, CUT_HARD elsewhere
(only where no boundary lies within reach). With cuts c at boundaries,

  cost(c) = penalty(c) + min over b in [c - length, c) of cost(b) + padding(c - b),

and as padding(c - b) = length - c + b for all but powers of two, the minimum is
one of cost(b) + b over a sliding window, which a monotone queue keeps, and of
the few b at a power of two before c.

Every window costs WINDOW ids besides, or crumbs of one, two and four ids would
be as good as full windows.

A task sees a range of ids in order. The programme runs along with the stream: a
cut is final as soon as the best ways to all places that a window can still begin
at go through it, and from there the documents are let go. So the cuts are the
optimum of the task's whole stream, and what is held is what isn't final yet: a
few windows, rarely more, and one whole document.
"""

from __future__ import annotations

import gc
import struct
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubara.llm.shared import in_order
from cubara.llm.tokens import Encoder, encoder

LENGTH, CUT_SENTENCE, CUT_HARD, WINDOW = 2048, 4.0, 64.0, 32.0
#: Ids that wait before it is looked which cuts are final.
WAIT = 1 << 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def padding(n: int, length: int = LENGTH) -> int:
    return 0 if n & (n - 1) == 0 else length - n


class Cuts:
    """The programme over a growing stream of boundaries; ties take the earliest window start."""

    def __init__(self, length: int = LENGTH, window: float = WINDOW):
        self.length, self.window = length, window
        self.powers = [1 << k for k in range(length.bit_length()) if 1 << k <= length]
        # By state: its place, cost and the state before. The first one is final.
        self.places, self.cost, self.back = [0], [0.0], [0]
        self.at = {0: 0}
        # The monotone queue, in two lists from `head` on: cost + place, increasing, and the state.
        self.keys, self.states, self.head = [0.0], [0], 0

    def add(self, ends: list[int], penalties: list[float]) -> None:
        """Boundaries at increasing places; gaps of more than a window get hard cuts."""
        places, cost, back, at, keys, states = self.places, self.cost, self.back, self.at, self.keys, self.states
        head, length, powers, get, window = self.head, self.length, self.powers, self.at.get, self.window
        for end, extra in zip(ends, penalties):
            while end > places[-1]:
                c, p = (end, extra) if end - places[-1] <= length else (places[-1] + length, CUT_HARD)
                while places[states[head]] < c - length:
                    head += 1
                best, best_b = keys[head] + length - c, states[head]
                for w in powers:
                    b = get(c - w)
                    if b is not None and cost[b] < best:
                        best, best_b = cost[b], b
                best += p + window
                at[c] = k = len(places)
                places.append(c)
                cost.append(best)
                back.append(best_b)
                key = best + c
                while len(keys) > head and keys[-1] > key:
                    keys.pop()
                    states.pop()
                keys.append(key)
                states.append(k)
        self.head = head

    def settled(self) -> list[int]:
        """The cuts that have become final; what lies before the last of them is forgotten."""
        live = len(self.places) - 1
        while live and self.places[live - 1] >= self.places[-1] - self.length:
            live -= 1
        return self._until(self._common(range(live, len(self.places))))

    def _common(self, states) -> int:
        """The last state on the best ways to all of these."""
        ways = set(states)
        for k in range(max(ways), -1, -1):
            if k in ways:
                if len(ways) == 1:
                    return k
                ways.remove(k)
                ways.add(self.back[k])
        return 0

    def rest(self) -> list[int]:
        """The cuts up to the last boundary."""
        return self._until(len(self.places) - 1)

    def _until(self, k: int) -> list[int]:
        out, b = [], k
        while b:
            out.append(self.places[b])
            b = self.back[b]
        if k:
            self.places, self.cost, self.back = self.places[k:], self.cost[k:], [b - k for b in self.back[k:]]
            self.back[0] = 0
            self.keys, self.states, self.head = self.keys[self.head :], [b - k for b in self.states[self.head :]], 0
            self.at = {c: i for i, c in enumerate(self.places)}
        return out[::-1]


def cuts(ends: list[int], penalties: list[float], length: int = LENGTH, window: float = WINDOW) -> list[int]:
    """The chosen cuts among the increasing places `ends` (the last is always one), from place 0."""
    of = Cuts(length, window)
    of.add(ends, penalties)
    return of.rest()


class Packer:
    """One task's stream of documents, cut as it comes."""

    def __init__(self, first_sequence: int, sentence_end: np.ndarray, length: int = LENGTH, wait: int = WAIT):
        self.sentence_end, self.sequence, self.cuts, self.wait = sentence_end, first_sequence, Cuts(length), wait
        self.docs: deque[list] = deque()  # [doc_id, ids as bytes, ids of it already cut off]
        self.done = self.size = 0  # ids cut off, and ids in all
        self.look = wait

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        self.docs.append([doc_id, ids, 0])
        inner = np.flatnonzero(self.sentence_end[np.frombuffer(ids, "<u4")[:-1]]) + 1 + self.size
        self.size += len(ids) // 4
        self.cuts.add([*inner.tolist(), self.size], [CUT_SENTENCE] * len(inner) + [0.0])
        if self.size - self.done >= self.look:
            yield from self.take(self.cuts.settled())
            self.look = max(self.wait, 2 * (self.size - self.done))  # if hardly anything is final, later

    def end(self) -> Iterator[tuple]:
        yield from self.take(self.cuts.rest())

    def take(self, chosen: list[int]) -> Iterator[tuple]:
        """The pieces of the sequences that end at these cuts."""
        for cut in chosen:
            offset, n = 0, cut - self.done
            while offset < n:
                doc_id, ids, done = self.docs[0]
                total = len(ids) // 4
                m = min(n - offset, total - done)
                yield doc_id, done, m, zlib.crc32(memoryview(ids)[4 * done : 4 * (done + m)]), total, self.sequence, offset
                offset += m
                if done + m == total:
                    self.docs.popleft()
                else:
                    self.docs[0][2] = done + m
            self.done = cut
            self.sequence += 1


def sentence_ends(known: Encoder) -> np.ndarray:
    """For each id, whether its text ends a sentence: . ! ? or a line break at its end."""
    vocabulary = known.tokenizer.get_vocab()
    out = np.zeros(max(vocabulary.values()) + 2, bool)
    for token, i in vocabulary.items():
        out[i] = token[-1:] in (".", "!", "?", "Ċ")  # U+010A: how byte-level vocabularies write a line break
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", remember: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document's ids and end_id lie in exactly one piece each; a null or
    empty text is its end id. Pieces of a sequence follow from offset 0 without
    gaps, in document order. Repeated rows and ties in the id are packed each, in
    the order of a hash of their texts; null ids come first. A very long text is
    held whole by one task. Other columns are not looked at, whatever their
    names. An empty table gives no rows. sequence_id is the task's number times
    2^32 plus a counter; cuts are the optimum of each task's range of ids, so
    each range ends with one window that may be short. Workers keep the tokenizer
    and the words it has seen for the next task, unless `remember` is false.
    """
    ordered = in_order(docs, id_col, text_col)
    end = struct.pack("<I", end_id)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    arrow = pa.schema([(n, pa.int64()) for n in names])

    def run(batches):
        known = encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 32, sentence_ends(known), length)
        send = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=arrow)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some, out = batch.slice(at, 512), []
                for d, ids in zip(some.column(0).to_pylist(), known.encode_all(some.column(1))):
                    out += packer.add(d, ids + end)
                if out:
                    yield send(out)
        if out := list(packer.end()):
            yield send(out)
        pa.default_memory_pool().release_unused()
        if not remember:
            del known, packer
            encoder.cache_clear()
            gc.collect()

    return ordered.mapInArrow(run, SCHEMA)
