"""Filling fixed-capacity windows with texts: counts of length combinations by non-negative least squares, the rest greedily."""

from __future__ import annotations

import base64
import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CAPACITY = 4096
#: A byte-level BPE vocabulary in rank format.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of that vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Items of one length and salt that a single window sorts, about.
RUN = 1_000_000


@lru_cache(2)
def encoder(vocabulary: str):
    """The tokenizer of a rank file, one per worker process."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens``; null texts have 0. Whole texts are tokenised where they lie."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [len(encode(t)) if t else 0 for t in pdf["text"]]})

    return documents.select("doc_id", "text").mapInPandas(count, "doc_id bigint, n_tokens bigint")


#: Combinations tried for each length, and rounds of enumerating, solving and rounding.
VARIANTS = 3
ROUNDS = 6


def combinations(histogram: dict[int, int], capacity: int, variants: int = VARIANTS) -> list[dict[int, int]]:
    """Shallow multisets of the lengths that fill a window exactly and hold no length more often than there are items of it.

    Each begins with one length and takes others at quantiles spread evenly over
    the items (so that together they resemble the histogram) until what is left
    is completed by one length or by two.
    """
    ordered = sorted(histogram)
    counts = list(accumulate(histogram[k] for k in ordered))
    typical = max(1, sum(k * v for k, v in histogram.items()) // counts[-1])
    out, seen, turn = [], set(), 0.0
    for a in reversed(ordered):
        for _ in range(variants):
            combo, room = {a: 1}, capacity - a
            free = lambda k, n=1: histogram.get(k, 0) - combo.get(k, 0) >= n  # noqa: B023, E731
            while room:
                if free(room):
                    combo[room] = combo.get(room, 0) + 1
                    room = 0
                    break
                if room <= 3 * typical or room <= 2 * ordered[-1] and len(combo) > 8:
                    at = bisect_right(ordered, room // 2)
                    pair = next((k for k in reversed(ordered[max(0, at - 64) : at]) if (free(k) and free(room - k) if k * 2 != room else free(k, 2))), None)
                    if pair:
                        for k in (pair, room - pair):
                            combo[k] = combo.get(k, 0) + 1
                        room = 0
                        break
                fits = bisect_right(ordered, room)
                if not fits:
                    break
                turn = (turn + 0.6180339887498949) % 1.0
                at = bisect_right(counts, turn * counts[fits - 1], 0, fits - 1)
                while at >= 0 and not free(ordered[at]):
                    at -= 1
                if at < 0:
                    break
                k = ordered[at]
                # many tiny items go in as a run
                n = min(histogram[k] - combo.get(k, 0), room // k, max(1, room // (16 * k)))
                combo[k] = combo.get(k, 0) + n
                room -= n * k
            key = tuple(sorted(combo.items()))
            if not room and key not in seen:
                seen.add(key)
                out.append(combo)
    return out


def solve(combos: list[dict[int, int]], histogram: dict[int, int], sweeps: int = 25) -> np.ndarray:
    """Non-negative repeat counts x that bring the combinations' items closest to the histogram (least squares, coordinate descent)."""
    left = {k: float(v) for k, v in histogram.items()}
    x = np.zeros(len(combos))
    norms = [sum(n * n for n in c.values()) for c in combos]
    for _ in range(sweeps):
        moved = 0.0
        for j, combo in enumerate(combos):
            step = sum(n * left[k] for k, n in combo.items()) / norms[j]
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for k, n in combo.items():
                    left[k] -= step * n
        if moved < 0.01:
            break
    return x


def fitted(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """(full windows by items and repeats, what is left of the histogram): enumerated combinations, repeat counts by non-negative least squares, rounded.

    A count is rounded up as far as the items go, the greatest first; what
    rounding leaves over is enumerated and solved again, a few times at most.
    """
    left = {k: v for k, v in histogram.items() if k > 0 and v > 0}
    out = []
    for _ in range(rounds):
        combos = combinations(left, capacity) if left else []
        if not combos:
            break
        counts = solve(combos, left)
        for j in np.argsort(-counts, kind="stable"):
            repeats = min([math.ceil(counts[j] - 1e-9), *(left.get(k, 0) // n for k, n in combos[j].items())])
            if repeats > 0:
                for k, n in combos[j].items():
                    left[k] -= n * repeats
                out.append((combos[j], repeats))
        left = {k: v for k, v in left.items() if v}
    return out, left


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], int]:
    """((items by length, repeats), number of fitted windows) such that every item of the histogram is in a window and none is overfull; the fitted windows come first.

    The work depends on the number of distinct lengths, at most the capacity,
    never on the number of items: the greedy rest repeats each filling as often
    as the counts allow, which uses up a length every time.
    """
    out, left = fitted(histogram, capacity)
    n_fitted = sum(repeats for _, repeats in out)
    ordered = sorted(left)
    while ordered:
        room, at, combo = capacity, len(ordered), {}
        while at and room >= ordered[0]:
            at = min(at, bisect_right(ordered, room))
            if not at:
                break
            k = ordered[at - 1]
            combo[k] = min(left[k], room // k)
            room -= combo[k] * k
            at -= 1
        repeats = min(left[k] // n for k, n in combo.items())
        for k, n in combo.items():
            left[k] -= n * repeats
        out.append((combo, repeats))
        ordered = [k for k in ordered if left[k]]
    return out, n_fitted


def pack(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece_no, window_id, window_offset, start_token, n_tokens, fitted``: where each text lies; ``fitted`` says that least squares filled the window, not the greedy rest.

    ``lengths`` has ``doc_id, n_tokens``. A text longer than the capacity is cut
    into full windows and a rest; no other is cut. The histogram of lengths, at
    most ``capacity`` rows, goes to the driver and comes back as a plan of
    intervals of ranks per length; each item finds its window by the rank it has
    among the items of its length. Ranks are counted per length and salt, so a
    length that a third of all texts have is spread over many tasks. A text of
    no tokens lies in window 0; a repeated id is one text (its longest); null
    ids are left out; no texts give no rows.
    """
    spark = lengths.sparkSession
    one = lengths.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("n_tokens").cast("bigint").alias("total"))
    pieces = F.greatest(F.ceil(F.col("total") / capacity), F.lit(1)).cast("int")
    items = one.select("doc_id", "total", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece_no")).select(
        "doc_id", "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("start_token"), F.least(F.lit(capacity), F.col("total") - F.col("piece_no") * capacity).cast("int").alias("n_tokens")
    )
    histogram = {r[0]: r[1] for r in items.groupBy("n_tokens").count().collect()}  # at most capacity + 1 rows
    salts = max(16, sum(histogram.values()) // RUN)
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)).cast("int"))
    runs = salted.groupBy("n_tokens", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("n_tokens").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))
    offsets = runs.select("n_tokens", "salt", F.coalesce(before, F.lit(0)).alias("first"))
    within = F.row_number().over(W.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece_no")) - 1
    ranked = salted.withColumn("within", within).join(offsets, ["n_tokens", "salt"]).withColumn("rank", F.col("first") + F.col("within"))

    starts, taken, window = [], Counter(), 0
    windows, n_fitted = plan(histogram, capacity)
    for combo, repeats in windows:
        offset = 0
        for k, n in sorted(combo.items(), reverse=True):
            starts.append((k, taken[k], window, n, offset))
            taken[k] += n * repeats
            offset += k * n
        window += repeats
    if 0 in histogram:
        starts.append((0, 0, 0, histogram[0], 0))
    table = np.array(sorted(starts) or [(0, 0, 0, 1, 0)], np.int64)
    sent = spark.sparkContext.broadcast(table)  # a few rows per distinct length

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sent.value
        span = np.int64(1) << 48
        keys = rows[:, 0] * span + rows[:, 1]
        for pdf in batches:
            n, rank = pdf["n_tokens"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64)
            at = np.searchsorted(keys, n * span + rank, "right") - 1
            _, first, base, copies, offset = rows[at].T
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "piece_no": pdf["piece_no"], "window_id": (window_id := base + (rank - first) // copies),
                "window_offset": (offset + (rank - first) % copies * n).astype(np.int32), "start_token": pdf["start_token"], "n_tokens": pdf["n_tokens"], "fitted": window_id < n_fitted,
            })

    return ranked.select("doc_id", "piece_no", "start_token", "n_tokens", "rank").mapInPandas(place, "doc_id bigint, piece_no int, window_id bigint, window_offset int, start_token bigint, n_tokens int, fitted boolean")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Windows of whole documents; see pack. Lengths are written to the shared checkpoint folder once, so texts are tokenised once."""
    from siftgrain.session import cut_lineage

    return pack(cut_lineage(token_lengths(documents, vocabulary)), capacity)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``n_windows, n_fitted, n_tokens, filled``: windows, those that least squares filled, and the share of the windows' room that is used."""
    windows = packed.groupBy("window_id").agg(F.sum("n_tokens").alias("used"), F.max("fitted").alias("fitted"))
    total = windows.agg(F.count("*").alias("n_windows"), F.count(F.when(F.col("fitted"), 1)).alias("n_fitted"), F.sum("used").alias("n_tokens"))
    return total.withColumn("filled", F.round(F.col("n_tokens") / (F.col("n_windows") * capacity), 6))
