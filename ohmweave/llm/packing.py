"""Best-fit packing by exact-complement hashing.

Spark tokenizes and cuts the documents into pieces, ranks the pieces of each length and lays them out.
Only the histogram of piece lengths (at most `capacity` rows, however large the input) reaches the driver,
which plans in counts: a plan step is a list of lengths that share a sequence, and how many such sequences
there are. Steps that fill a sequence exactly are found by looking up complements: a piece's gap is filled
by one, two or three available lengths. What no combination fills goes by best fit, longest first.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import freeing, smaller_batches, stored

CAPACITY = 2048
LONG_SPACE = 50_000
_ENCODERS: dict = {}


def encoder(name: str):
    """ids of a text under a public byte-level BPE vocabulary, given as <name>.json and as ranks in <name>.tiktoken.

    The ids are those that tokenizers gives for the json file: the string of an added token is that token, all
    between is encoded by ranks, some five times faster (tests compare the two). White space of LONG_SPACE
    characters and more is left to tokenizers, since the rank encoder's pattern fails on it.
    """
    if name not in _ENCODERS:
        import base64
        import json

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        at = public_tokenizers.path(f"{name}.json")
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(at) as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        plain = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        apart = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        spaces, whole = re.compile(rf"\s{{{LONG_SPACE}}}"), []

        def part(text: str) -> list[int]:
            if len(text) >= LONG_SPACE and spaces.search(text):
                whole[:] = whole or [Tokenizer.from_file(at)]
                return whole[0].encode(text, add_special_tokens=False).ids
            return plain(text)

        def encode(text: str) -> array:
            ids, begin = array("I"), 0
            for m in apart.finditer(text):
                ids.extend(part(text[begin : m.start()]))
                ids.append(added[m[0]])
                begin = m.end()
            ids.extend(part(text[begin:] if begin else text))
            return ids

        _ENCODERS[name] = encode
    return _ENCODERS[name]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: whole if it fits, else the remainder first."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """A row per piece; (task, nth) tells pieces of a length apart: the nth of that length in its task."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        encode, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        for b in freeing(batches, 1):
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text or "")
                ids.append(0)
                raw = memoryview(ids).cast("B")
                for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                    rows.append((doc, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)]), task, seen[n]))
                    seen[n] += 1
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return source.mapInArrow(run, PIECES)


def exact_steps(have: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Take from the counts `have` all the sequences that one to four lengths fill exactly; longest first."""
    steps = []

    def take(*lengths: int) -> None:
        need = np.bincount(lengths, minlength=capacity + 1)
        n = int(min(have[x] // need[x] for x in set(lengths)))
        if n > 0:
            steps.append((lengths, n))
            np.subtract(have, n * need, out=have)

    if have[capacity]:
        take(capacity)
    for a in range(capacity - 1, 0, -1):
        gap = capacity - a
        if have[a] and gap <= a:
            take(a, gap)  # a single length fills the gap
        for b in range(min(a, gap - 1), 0, -1) if have[a] else ():
            if have[b] and gap - b <= b:
                take(a, b, gap - b)  # a pair does
            if not have[a]:
                break
        for b in range(min(a, gap - 2), 0, -1) if have[a] else ():
            rest = gap - b
            c = np.arange(min(b, rest - 1), (rest - 1) // 2, -1)
            while have[a] and have[b] and len(c := c[(have[c] > 0) & (have[rest - c] > 0)]):  # a triple does
                take(a, b, int(c[0]), int(rest - c[0]))
                c = c[1:]
            if not have[a]:
                break
    return steps


def best_fit_steps(have: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Place what is left, longest first, always where the least room stays; alike sequences are one step."""
    open_steps: dict[int, list[list]] = defaultdict(list)  # room -> [lengths, count]
    for a in np.flatnonzero(have)[::-1].tolist():
        left = int(have[a])
        while left:
            room = next((r for r in range(a, capacity) if open_steps.get(r)), None)
            if room is None:
                each = capacity // a
                if left >= each:
                    open_steps[capacity - a * each].append([(a,) * each, left // each])
                if left % each:
                    open_steps[capacity - a * (left % each)].append([(a,) * (left % each), 1])
                break
            step = open_steps[room][-1]
            n = min(left, step[1])
            open_steps[room - a].append([(*step[0], a), n])
            step[1] -= n
            left -= n
            if not step[1]:
                open_steps[room].pop()
        have[a] = 0
    return [(tuple(s), n) for steps in open_steps.values() for s, n in steps]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, number of such sequences)] using up exactly the histogram."""
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        have[length] = n
    return [*exact_steps(have, capacity), *best_fit_steps(have, capacity)]


def layout(steps: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, runs of ranks: (first rank, its sequence, offset); the following ranks take the following sequences."""
    runs, used, sequence = defaultdict(list), defaultdict(int), 0
    for lengths, n in steps:
        offset = 0
        for x in lengths:
            runs[x].append((used[x], sequence, offset))
            used[x] += n
            offset += x
        sequence += n
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k", capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and id 0, so a null or empty text is one piece of length 1. Repeated rows and
    null ids are packed like any other; a text of any length is cut whole. An empty table gives an empty result. Extra columns are not looked at.
    """
    with smaller_batches(docs.sparkSession):
        cut = stored(pieces(docs, tokenizer, capacity, id_col, text_col), "pieces")
    per_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    steps = plan({r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    held = docs.sparkSession.sparkContext.broadcast(layout(steps))  # bounded by the capacity, not by the rows

    def place(batches):
        where = held.value
        for b in batches:
            length, rank = (b.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, seq, off = where[int(x)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = seq[k] + rank[at] - first[k], off[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(base, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
