"""Best-fit packing of tokenised documents into sequences of a fixed length.

The histogram of piece lengths (one count per length, however large the corpus)
states a configuration linear program: how often to use each multiset of
lengths that fits a sequence, so that every length is covered with the fewest
sequences. Multiplicative weights solve it; a knapsack dynamic program prices
the best configurations of each round. A share of the fractional solution is
rounded down, the commonest configurations first, and what is left is solved
again. After every pass best fit, which works on counts of equal bins, would
place the rest; the pass with the fewest sequences is taken. Before the first
pass that is best fit alone, so the result is never worse than that.
Pieces then find their sequence by their rank within their length, which is
counted in salted groups, so that no length is gathered in one task.

Defined results: a null text packs as an empty one (its end token only).
Repeated rows are packed once each, null ids like others. An empty table gives
an empty result. Only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.llm.common import as_table, ship, skew_join, starts, trim


@dataclass(frozen=True)
class PackingConfig:
    capacity: int = 1024
    end_id: int = 2
    #: Rounds of multiplicative weights (at most one a sequence), and the configurations traced from one round's prices.
    rounds: int = 1500
    traces: int = 20
    #: How fast a length gets cheaper as it is covered.
    step: float = 0.5
    #: Share of a sequence by which a piece may miss the dearest one in a trace, so that the traces of a round differ.
    slack: float = 0.001
    #: Times that the program is solved, and the share of each solution that is rounded; it must fill sequences exactly.
    passes: int = 2
    share: float = 0.8
    #: Pieces of one length that are numbered together.
    group_rows: int = 250
    #: Different words whose tokens a worker remembers.
    cached_words: int = 400_000


# ---------------------------------------------------------------- tokens


class _Unsafe(Exception):
    """A word whose tokens depend on its neighbours."""


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Token ids of a byte-level ``tokenizers`` file, as little-endian uint32 bytes.

    Ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``. Words
    between single spaces don't depend on each other in this vocabulary's
    splitting, so their ids are computed once and remembered; texts with other
    spacing are encoded whole.
    """

    SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str, cached_words: int):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        self.path = path
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = {bytes(letters[c] for c in word): k for word, k in spec["model"]["vocab"].items() if word not in self.special}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=self.SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.limit = cached_words
        self._exact = None
        outer = self

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if not word or word[0].isspace() or word[-1].isspace():
                    raise _Unsafe
                ids = outer._plain(" " + word)
                if len(self) >= outer.limit:
                    self.clear()
                if len(word) < 64:
                    self[word] = ids
                return ids

        self.words = Words()

    def _plain(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4").tobytes()

    def exact(self, text: str) -> bytes:
        """By the library that the file belongs to; slow, for texts that hold special tokens."""
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self.path)
        return np.array(self._exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.exact(text)
        first, *rest = text.split(" ")
        try:
            if first and first[-1].isspace():
                raise _Unsafe
            return self._plain(first) + b"".join(map(self.words.__getitem__, rest))
        except _Unsafe:
            return self._plain(text)


_ENCODERS: dict[tuple[str, int], ByteBpe] = {}


def encoder(path: str, cached_words: int) -> ByteBpe:
    if (path, cached_words) not in _ENCODERS:
        _ENCODERS[path, cached_words] = ByteBpe(path, cached_words)
    return _ENCODERS[path, cached_words]


def token_pieces(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", config: PackingConfig = PackingConfig()) -> DataFrame:
    """One row per piece: its document, number, start, length and the checksum of its ids."""
    width, end = config.capacity, np.array([config.end_id], "<u4").tobytes()

    def pieces(batches):
        bpe = encoder(tokenizer, config.cached_words)
        for batch in batches:
            out = []
            for doc, content in zip(batch["k"].array, batch["t"]):
                raw = bpe.ids(content) + end
                n = len(raw) // 4
                first = (n - 1) % width + 1
                cuts = [0, *range(first, n + 1, width)]
                for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    out.append((None if pd.isna(doc) else int(doc), number, a, b - a, zlib.crc32(raw[4 * a : 4 * b])))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame
        bpe.words.clear()
        trim()

    ship()
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInPandas(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- the linear program


def knapsack(prices: np.ndarray, capacity: int) -> np.ndarray:
    """The worth of the dearest multiset of lengths, for every room up to ``capacity`` (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    for room in range(1, capacity + 1):
        best[room] = max(best[room - 1], (prices[1 : room + 1] + best[room - 1 :: -1]).max())
    return best


def solve_configurations(demand: np.ndarray, config: PackingConfig) -> list[tuple[np.ndarray, float]]:
    """Configurations (a count per length) and how often to use each, by multiplicative weights.

    Every round prices the lengths (the more of a length is covered in relation
    to the others, the cheaper it gets), finds the worth of each room by dynamic
    programming, and traces configurations of the dearest worth, to within
    ``slack`` a piece; ties are broken by a fixed random sequence.
    """
    capacity, lengths = config.capacity, np.arange(config.capacity + 1)
    used, need = np.flatnonzero(demand), demand.astype(float)
    if not len(used):
        return []
    sequences = (need * lengths).sum() / capacity
    rounds = int(min(config.rounds, np.ceil(sequences)))
    amount = sequences / (rounds * config.traces)
    covered, rng, found = np.zeros(capacity + 1), np.random.RandomState(3), {}
    for turn in range(rounds):
        prices = np.zeros(capacity + 1)
        prices[used] = used / capacity * np.exp(-config.step * (covered[used] / need[used] - turn / rounds))
        best = knapsack(prices, capacity)
        for _ in range(config.traces):
            picks, room = [], capacity
            while room:
                worth = prices[1 : room + 1] + best[room - 1 :: -1]
                near = np.flatnonzero((worth >= best[room] - config.slack) & (prices[1 : room + 1] > 0))
                if not len(near):
                    break
                picks.append(int(near[rng.randint(len(near))]) + 1)
                room -= picks[-1]
            np.add.at(covered, picks, amount)
            key = tuple(sorted(picks))
            found[key] = found.get(key, 0.0) + amount
    return [(np.bincount(key, minlength=capacity + 1), x) for key, x in found.items()]


def best_fit(demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest pieces first: (pieces per length, number of equal bins).

    Equal bins are one entry: bins of one room take the pieces of a length
    together, each as many as go in, as the bin that a piece has just entered is
    the best fit for the next one.
    """
    rooms: list[list[tuple[tuple | None, int]]] = [[] for _ in range(capacity + 1)]
    open_rooms, done = 0, []

    def put(before, length: int, each: int, bins: int, room: int) -> None:
        nonlocal open_rooms
        entry = ((before, length, each), bins)
        if room - each * length:
            rooms[room - each * length].append(entry)
            open_rooms |= 1 << (room - each * length)
        else:
            done.append(entry)

    for length in range(capacity, 0, -1):
        left = int(demand[length])
        while left:
            fits = open_rooms >> length
            room = length + (fits & -fits).bit_length() - 1 if fits else capacity
            each = room // length
            if fits:
                before, bins = rooms[room].pop()
                if not rooms[room]:
                    open_rooms &= ~(1 << room)
            else:
                before, bins = None, -(-left // each)
            whole = min(bins, left // each)
            if whole:
                put(before, length, each, whole, room)
                left -= whole * each
            if whole < bins and left:
                put(before, length, left, 1, room)
                left, whole = 0, whole + 1
            if whole < bins:
                rooms[room].append((before, bins - whole))
                open_rooms |= 1 << room
    out = []
    for entry, bins in [*done, *(e for own in rooms for e in own)]:
        counts: dict[int, int] = {}
        while entry is not None:
            entry, length, each = entry
            counts[length] = counts.get(length, 0) + each
        out.append((counts, bins))
    return out


def plan_sequences(histogram: dict[int, int], config: PackingConfig) -> list[tuple[dict[int, int], int]]:
    """(pieces per length, number of sequences) for every piece of the histogram: the best of all passes."""
    left = np.zeros(config.capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan: list[tuple[dict[int, int], int]] = []
    best = best_fit(left, config.capacity)
    for _ in range(config.passes):
        for counts, x in sorted(solve_configurations(left, config), key=lambda c: -c[1]):
            own = np.flatnonzero(counts)
            if own @ counts[own] == config.capacity:
                times = int(min(np.floor(x * config.share), (left[own] // counts[own]).min()))
                if times > 0:
                    left -= times * counts
                    plan.append(({int(k): int(counts[k]) for k in own}, times))
        whole = plan + best_fit(left, config.capacity)
        best = min(best, whole, key=lambda p: sum(n for _, n in p))
    return best


def slots(plan: list[tuple[dict[int, int], int]]) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(length, first rank, end rank, first sequence, sequences, offset) rows, and the number of sequences.

    A row holds all pieces of one length in equal sequences: the next rank goes
    to the next sequence, and from the last one back to the first, ``length`` further on.
    """
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for counts, times in plan:
        offset = 0
        for length in sorted(counts, reverse=True):
            start = taken.get(length, 0)
            taken[length] = start + times * counts[length]
            rows.append((length, start, taken[length], sequence, times, offset))
            offset += length * counts[length]
        sequence += times
    return rows, sequence


# ---------------------------------------------------------------- placing


def pack_pieces(pieces: DataFrame, config: PackingConfig = PackingConfig()) -> DataFrame:
    """``pieces`` (a stored table) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    short = {k: n for k, n in histogram.items() if k < config.capacity}
    rows, sequences = slots(plan_sequences(short, config))
    # By Arrow, as rows of Python objects would start Python workers of their own.
    names = ("s_length", "s_from", "s_to", "s_sequence", "s_times", "s_offset")
    places = spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)}))

    full = pieces.where(F.col("length") == config.capacity).select("*", (F.monotonically_increasing_id() + F.lit(sequences)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    groups = F.create_map(*[x for k, n in sorted(short.items()) for x in (F.lit(k).cast("long"), F.lit(-(-n // config.group_rows)).cast("long"))]) if short else F.create_map(F.lit(0).cast("long"), F.lit(1).cast("long"))
    salted = pieces.where(F.col("length") < config.capacity).withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(groups, F.col("length"))))
    firsts = as_table(starts(salted.groupBy("length", "_g").agg(F.count("*").alias("n")), ["length"], "_g", "_start").drop("n"), "pack-starts")
    in_group = Window.partitionBy("length", "_g").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_r", F.row_number().over(in_group).cast("long") - 1)
    ranked = skew_join(ranked, firsts, ["length", "_g"]).withColumn("_rank", F.col("_r") + F.col("_start"))
    # ``places`` has a row for each length of a configuration. The program traces rounds * traces of them at most, a
    # configuration holds less than sqrt(2 * capacity) lengths, and best fit has some entries for each length: the bound
    # is one of the settings, whatever the corpus.
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("s_length")) & (F.col("_rank") >= F.col("s_from")) & (F.col("_rank") < F.col("s_to")))
    place = F.col("_rank") - F.col("s_from")
    turn = F.floor(place / F.col("s_times"))
    placed = placed.withColumn("sequence_id", F.col("s_sequence") + F.pmod(place, F.col("s_times"))).withColumn("offset", F.col("s_offset") + turn * F.col("s_length"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return placed.select(columns).unionByName(full.select(columns))


def pack_documents(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", config: PackingConfig = PackingConfig()) -> DataFrame:
    return pack_pieces(as_table(token_pieces(docs, tokenizer, text, key, config), "pack-pieces"), config)
