"""Filling containers of fixed capacity with texts.

Lengths are counted into a histogram of at most ``capacity`` classes. On it,
patterns of a few lengths that fill a container are enumerated, non-negative
least squares fits how often each is used, the counts are rounded down, and what
is left is packed by largest-first patterns of its own. Documents take the slots
of their length by rank, which is numbered block by block. The plan depends on
the histogram alone, so its size does not grow with the corpus.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoquery.operators.skew import AT, BLOCK, number_rows
from genoquery.session import durable, ship

CAPACITY = 4096
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_ROWS = 50_000
_encodings: dict = {}


def encoding(path: str = TOKENIZER):
    """The tokenizer in ``path`` (ranks in base 64), loaded once per worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = TOKENIZER) -> DataFrame:
    """``id, n_tokens`` of each text; null and empty texts have 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "n_tokens": [len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in b[text_col]]})

    ship(docs.sparkSession)
    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} long, n_tokens long")


def enumerate_patterns(counts: np.ndarray, capacity: int, wanted: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Patterns of lengths that exist, each filling ``capacity`` as far as they allow; lengths are drawn as often as they occur.

    The last lengths of a pattern are chosen to close it: of the pairs that exist, one that fills the rest exactly.
    """
    left = counts.astype(float).copy()
    have = np.flatnonzero(counts[1:] > 0) + 1
    if not len(have):
        return []
    mass = np.cumsum(left[have])
    exists = np.zeros(capacity + 1, bool)
    exists[have] = True
    best = np.maximum.accumulate(np.where(exists, np.arange(capacity + 1), 0))  # largest length that fits a room
    out, known = [], set()
    for _ in range(wanted):
        room, pattern = capacity, []
        while room >= have[0]:
            if exists[room] and pattern:
                pattern.append(room)
                break
            if room < 6 * have[0] or rng.random() < 0.2:  # close it with a pair when one fits exactly
                a = have[have <= room // 2]
                pair = a[exists[room - a]]
                if len(pair):
                    x = int(pair[rng.integers(len(pair))])
                    pattern += [room - x, x]
                    break
            x = int(have[np.searchsorted(mass, rng.random() * mass[-1], side="right").clip(0, len(have) - 1)])
            x = x if x <= room else int(best[room])
            pattern.append(x)
            room -= x
        key = tuple(sorted(pattern, reverse=True))
        if key and key not in known:
            known.add(key)
            out.append(np.array(key))
    return out


def nnls(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, b: np.ndarray, n: int, steps: int = 200) -> np.ndarray:
    """Non-negative x that brings A x near b, by the multiplicative update; A is given by its entries, all above 0."""
    at_b = np.bincount(cols, vals * b[rows], n)
    x = np.full(n, b.sum() / max(1e-12, np.bincount(cols, vals, n).sum()))
    for _ in range(steps):
        ax = np.bincount(rows, vals * x[cols], len(b))
        x *= at_b / np.maximum(np.bincount(cols, vals * ax[rows], n), 1e-12)
    return x


def make_plan(counts: np.ndarray, capacity: int = CAPACITY, rounds: int = 3, wanted: int = 3000) -> list[tuple[np.ndarray, int]]:
    """(pattern, repeats) pairs that use each length exactly as often as it occurs."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[np.ndarray, int]] = []
    rng = np.random.default_rng(20240501)

    def use(pattern: np.ndarray, most: int) -> int:
        lengths, m = np.unique(pattern, return_counts=True)
        reps = int(min(most, (left[lengths] // m).min()))
        if reps > 0:
            left[lengths] -= m * reps
            plan.append((pattern, reps))
        return reps

    for _ in range(rounds):
        patterns = [p for p in enumerate_patterns(left, capacity, wanted, rng) if p.sum() >= 0.995 * capacity]
        if not patterns:
            break
        sizes = np.array([len(p) for p in patterns])
        rows, cols = np.concatenate(patterns), np.repeat(np.arange(len(patterns)), sizes)
        x = nnls(rows, cols, np.ones(len(rows)), left.astype(float), len(patterns))
        for i in np.argsort(-x):
            if x[i] < 1:
                break
            use(patterns[i], int(x[i]))
    while left.any():  # the rest: largest first, each length that still fits; every pattern uses up a length
        room, pattern, spare = capacity, [], left.copy()
        while True:
            fit = np.flatnonzero(spare[1 : room + 1])
            if not len(fit):
                break
            x = int(fit[-1]) + 1
            m = min(int(spare[x]), room // x)
            if x * m < room and m > 1 and len(fit) > 1:
                m = 1
            pattern += [x] * m
            spare[x] -= m
            room -= x * m
        use(np.array(pattern), 1 << 60)
    return plan


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str = TOKENIZER) -> DataFrame:
    """``id, piece, container_id, start, n_tokens``: the container of each text and its place in it.

    Only a text above ``capacity`` has more than one piece (from 0); its full pieces fill containers of their own. Texts of 0
    tokens (null, empty) have one piece and no container. Texts of equal length are told apart by id, so ids are unique.
    """
    sizes = durable(token_counts(docs, id_col, text_col, path))
    whole = F.floor(F.col("n_tokens") / capacity)
    rest = F.col("n_tokens") % capacity
    pieces = sizes.select(id_col, F.when(F.col("n_tokens") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.concat(F.array_repeat(F.lit(capacity).cast("long"), whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))).alias("p"))
    pieces = pieces.select(id_col, F.posexplode("p").alias("piece", "length"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most capacity + 1 rows
        counts[r["length"]] = r["count"]
    plan = make_plan(counts, capacity)
    # slots of a length in the order of the plan: from which slot on, which pattern, copies a container, first container, offset
    table, base, used = [], 0, np.zeros(capacity + 1, np.int64)
    for pattern, reps in plan:
        lengths, m = np.unique(pattern, return_counts=True)
        at = 0
        for length, copies in zip(lengths[::-1], m[::-1]):
            table.append((length, used[length], copies, base, at))
            used[length] += copies * reps
            at += length * copies
        base += reps
    first = np.concatenate([[0], np.cumsum(counts)])  # all slots of shorter lengths come before
    arr = np.array(sorted((first[a] + b, a, b, c, d, e) for a, b, c, d, e in table), np.int64).reshape(-1, 6)
    shared = docs.sparkSession.sparkContext.broadcast((arr, first))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arr, first = shared.value
        for b in batches:
            length, n = b["length"].to_numpy(np.int64), b["__n"].to_numpy(np.int64) - 1
            if len(arr) and len(b):
                i = np.searchsorted(arr[:, 0], first[length] + n, side="right") - 1
                slot = arr[np.maximum(i, 0)]
                o = n - slot[:, 2]
                container, start = slot[:, 4] + o // np.maximum(slot[:, 3], 1), slot[:, 5] + (o % np.maximum(slot[:, 3], 1)) * length
            else:
                container = start = np.zeros(len(b), np.int64)
            none = length == 0
            yield pd.DataFrame({id_col: b[id_col], "piece": b["piece"], "container_id": pd.array(np.where(none, 0, container), "Int64").copy() if not none.any() else pd.array([None if z else int(c) for z, c in zip(none, container)], "Int64"), "start": start, "n_tokens": length})

    blocks = max(1, int(counts.sum()) // BLOCK_ROWS)
    ranked = number_rows(pieces.withColumns({BLOCK: F.pmod(F.xxhash64(id_col), F.lit(blocks)), AT: F.struct(id_col, "piece")}), "length", 1 << 40)
    return ranked.select(id_col, "piece", "length", "__n").mapInPandas(place, f"{id_col} long, piece int, container_id long, start long, n_tokens long")
