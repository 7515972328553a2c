"""Operator 10: packing token sequences by bin completion.

Lengths come from a distributed pass over the texts; a document longer than a sequence is cut into
full pieces and a first, shorter one. What is packed is the histogram of piece lengths, which has at most
as many entries as a sequence has tokens, whatever the corpus. Bin completion goes from the largest
length down: the undominated fillings around a sequence with that length are enumerated, least waste
first, and tried in a depth-first branch-and-bound that prunes when the waste so far exceeds what
the incumbent allows; the incumbent starts as the best-fit solution. The search ends when the lower bound is
met, when nothing is left to try, or at its limits (parameters of pack: `steps` of an enumeration, `branches` tried
of it, `most_nodes`, and `repeat`, which applies a filling as often as counts allow); without limits it is exact, and
Plan.proved says whether the result is known to be the least. The plan's size depends on the sequence's length
only, so it can be broadcast.

Pieces meet their places without any task that holds a whole length's pieces: each piece's number
among those of its length is a running count over salts drawn from the stored row's number, in two levels.

Null texts are empty: only the final token. Very long texts are encoded whole, runs of white space of any
length too. Repeated rows, ids and null ids are packed as often as they occur; pieces of equal length are
interchangeable, so ties are settled by the row's number. An empty table gives an empty result. Columns other
than the id and the text are not read.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clauseloom.llm.bpe import byte_alphabet, has_unknown
from clauseloom.llm.common import column, map_slices, stored, texts_of

#: Salts of a length, and how many of them make a group whose sums are counted first.
SALTS, GROUPED = 1024, 32
#: Runs of white space from this length on are cut out before encoding: their words are known without a search.
LONG_RUN = 2000


@functools.cache
def fast_encoding(path: str):
    """An encoder with the tokenizer file's byte-level vocabulary: its ids are its merge ranks, so it gives the same ids.

    (The two libraries agree on every text, added tokens inside included; a test holds them together.)
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    value = {c: b for b, c in enumerate(byte_alphabet())}
    ranks = {bytes(value[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
    # Fixed value: the published pattern of byte-level pre-tokenization.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={a["content"]: a["id"] for a in spec["added_tokens"]})


class Encoder:
    """A text's ids, whatever its length: the fast library's search goes back over each run of white space, so long ones are cut out."""

    def __init__(self, path: str) -> None:
        self.enc, self.path, self.library = fast_encoding(path), path, None
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.enc.special_tokens_set, key=len, reverse=True))) or r"(?!)")
        self.long = regex.compile(rf"\s{{{LONG_RUN},}}+")

    def plain(self, text: str) -> list[np.ndarray]:
        """The ids of a text without special strings. A run is one word, but for its last character where a word follows."""
        out, at = [], 0
        for m in self.long.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += [self.enc.encode_to_numpy(text[at : m.start()], disallowed_special=()), np.array(self.run(text[m.start() : end]), dtype=np.uint32)]
            at = end
        return [*out, self.enc.encode_to_numpy(text[at:], disallowed_special=())]

    def run(self, text: str) -> list[int]:
        return self.enc._core_bpe.encode_single_piece(text.encode())

    def __call__(self, text: str) -> np.ndarray:
        if not text.isascii() and has_unknown(text):  # classes that only the library's newer tables know
            if self.library is None:
                self.library = Tokenizer.from_file(self.path)
                self.library.no_truncation(), self.library.no_padding()
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        if len(text) < LONG_RUN or not self.long.search(text):
            return self.enc.encode_to_numpy(text, allowed_special="all")
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.plain(text[at : m.start()]), np.array([self.enc._special_tokens[m[0]]], dtype=np.uint32)]
            at = m.end()
        return np.concatenate([*out, *self.plain(text[at:])])


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces_of(df: DataFrame, vocabulary: str, limit: int, final_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document's pieces: id, piece, start, length, ids_crc32."""
    kind = dict(df.dtypes)[id_column]

    def kernel():
        enc = encoder(vocabulary)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, piece, start, length, crc = [], [], [], [], []
            for row, text in enumerate(texts_of(batch, text_column)):
                ids = np.append(enc(text), final_id).astype("<u4")
                at, n = 0, len(ids) % limit or limit
                k = 0
                while at < len(ids):
                    rows.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                    at, n, k = at + n, limit, k + 1
            ids_of = column(batch, id_column).take(pa.array(rows, pa.int64()))
            return pa.RecordBatch.from_arrays([ids_of, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=[id_column, "piece", "start", "length", "ids_crc32"])

        return work

    return map_slices(df.select(id_column, text_column), kernel, f"`{id_column}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint", text_column)


@dataclass
class Plan:
    #: (lengths in a sequence, largest first; how many sequences are filled so).
    fillings: list[tuple[tuple[int, ...], int]]
    bound: int
    nodes: int
    #: Whether no packing has fewer sequences: the lower bound is met, or the whole search was made.
    proved: bool

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.fillings)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the sum's bound and the bound that no two of the large share a sequence (Martello and Toth's L2)."""
    sizes = sorted(counts)
    total = sum(s * counts[s] for s in sizes)
    best = -(-total // capacity)
    for small in (0, *(s for s in sizes if s <= capacity // 2)):
        large = sum(counts[s] for s in sizes if s > capacity - small)
        middle = [s for s in sizes if capacity // 2 < s <= capacity - small]
        n = sum(counts[s] for s in middle)
        room = n * capacity - sum(s * counts[s] for s in middle)
        rest = sum(s * counts[s] for s in sizes if small <= s <= capacity // 2)
        best = max(best, large + n + max(0, -(-(rest - room) // capacity)))
    return best


def dominated(filling: tuple[int, ...], counts: dict[int, int], capacity: int, known: int | None = None) -> bool:
    """Whether a length left out fits in the filling's waste or could take the place of others beside the largest, and still fit.

    Sums of one length and of several are told apart, as a length in its own place is no change. Sets of lengths and sums
    are bits of integers (known: those of counts), so all lengths left out are tried at once, for each amount by which
    one may be larger.
    """
    free = sum(1 << x for x, n in counts.items() if n) if known is None else known
    waste = capacity - sum(filling)
    for x, n in Counter(filling).items():
        if counts[x] <= n:
            free &= ~(1 << x)
    if free & ((2 << waste) - 1):
        return True
    one, more = 0, 0  # bit n: some single length, some several, add up to n
    for s in filling[1:]:
        more |= (more | one) << s
        one |= 1 << s
    return any((more << d | (one << d if d else 0)) & free for d in range(waste + 1))


def completions(counts: dict[int, int], order: list[int], capacity: int, steps: int | None = 400, most: int | None = 6) -> tuple[list[tuple[int, ...]], bool]:
    """Undominated fillings of a sequence that holds the largest length, least waste first, and whether they are all.

    A length is put in as often as it fits in one step, then less often, so a filling takes at most a step for each of its
    distinct lengths. At most `steps` steps are made (but at least one filling), and `most` fillings kept; None: no limit.
    """
    largest = order[0]
    out: dict[tuple[int, ...], None] = {}
    made, whole = 0, True
    known = sum(1 << x for x in order)
    stack = [(capacity - largest, 0, (largest,))]
    while stack:
        if steps is not None and made >= steps and out:
            whole = False
            break
        room, k, chosen = stack.pop()
        made += 1
        while k < len(order) and order[k] > room:
            k += 1
        if k == len(order):
            if not dominated(chosen, counts, capacity, known):
                out[chosen] = None
            continue
        s = order[k]
        fits = min(room // s, counts[s] - (s == largest))
        for n in range(fits + 1):  # the most copies come last, and off the stack first
            stack.append((room - n * s, k + 1, chosen + (s,) * n))
    found = sorted(out, key=lambda f: (capacity - sum(f), len(f), tuple(-x for x in f)))
    return (found, whole) if most is None or len(found) <= most else (found[:most], False)


def apply_times(counts: dict[int, int], filling: tuple[int, ...]) -> int:
    need: dict[int, int] = {}
    for s in filling:
        need[s] = need.get(s, 0) + 1
    return min(counts[s] // n for s, n in need.items())


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The incumbent: around the largest length left, always the largest that still fits."""
    left = {s: n for s, n in counts.items() if n}
    order = sorted(left, reverse=True)
    out = []
    while order:
        filling, room = (order[0],), capacity - order[0]
        used = {order[0]: 1}
        for s in order:
            while s <= room and used.get(s, 0) < left[s]:
                used[s] = used.get(s, 0) + 1
                filling, room = (*filling, s), room - s
        n = apply_times(left, filling)
        out.append((filling, n))
        for s in filling:
            left[s] -= n
        order = [s for s in order if left[s]]
    return out


def pack(counts: dict[int, int], capacity: int, most_nodes: int | None = 20_000, branches: int | None = 6, steps: int | None = 400, repeat: bool = True) -> Plan:
    """Bin completion over a histogram of lengths. With None for all limits and repeat=False the whole search is made."""
    counts = {s: n for s, n in counts.items() if n}
    if not counts:
        return Plan([], 0, 0, True)
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    best_n = sum(n for _, n in best)
    total = sum(s * n for s, n in counts.items())
    nodes, whole = 0, True
    left = dict(counts)
    path: list[list] = []  # the fillings to try, the one tried, how often, and the waste before it
    waste = used = 0
    going = True
    while best_n > bound:
        if most_nodes is not None and nodes >= most_nodes:
            whole = False
            break
        order = [s for s in sorted(left, reverse=True) if left[s]]
        if going and not order:
            best, best_n = [(f[0][f[1]], f[2]) for f in path], used
            going = False
            continue
        if going:
            nodes += 1
            options, every = completions(left, order, capacity, steps, branches)
            whole &= every
            path.append([options, -1, 0, waste])
        # Take the next filling of the deepest node that has one within the bound on waste.
        going = False
        while path and not going:
            node = path[-1]
            if node[1] >= 0 and node[2]:
                for s in node[0][node[1]]:
                    left[s] += node[2]
                used -= node[2]
                waste, node[2] = node[3], 0
            node[1] += 1
            if node[1] >= len(node[0]):
                path.pop()
                continue
            filling = node[0][node[1]]
            n = apply_times(left, filling) if repeat else 1
            whole &= n == 1
            more = n * (capacity - sum(filling))
            if (best_n - 1) * capacity - total < waste + more:
                if node[1] + 1 >= len(node[0]):
                    path.pop()
                continue
            for s in filling:
                left[s] -= n
            node[2], waste, used, going = n, waste + more, used + n, True
        if not path:
            break
    return Plan(best, bound, nodes, best_n == bound or whole)


def places(plan: Plan, spark) -> DataFrame:
    """One row for each place in each filling: length, the first number of a piece that goes there, fillings, first sequence, offset."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, n in plan.fillings:
        offset = 0
        for s in filling:
            rows.append((s, taken.get(s, 0), n, sequence, offset))
            taken[s] = taken.get(s, 0) + n
            offset += s
        sequence += n
    return spark.createDataFrame(rows, "length bigint, first bigint, times bigint, sequence bigint, offset bigint")


def pack_pieces(pieces: DataFrame, capacity: int, **limits) -> DataFrame:
    """pieces (with length, 1 to capacity, and row, a number of its own) with sequence_id and offset. pieces must be stored.

    limits: those of pack.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS))).withColumn("part", F.floor(F.col("salt") / GROUPED))
    sizes = stored(salted.groupBy("length", "part", "salt").agg(F.count("*").alias("n")), "pack-sizes")  # at most capacity x SALTS rows
    by_part = sizes.groupBy("length", "part").agg(F.sum("n").alias("n"))
    histogram = {r[0]: r[1] for r in by_part.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity entries
    plan = pack(histogram, capacity, **limits)

    def before(keys: list[str], order: str) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    coarse = by_part.select("length", "part", before(["length"], "part").alias("base"))  # SALTS / GROUPED rows a length
    fine = sizes.select("length", "part", "salt", before(["length", "part"], "salt").alias("own_base"))
    own = Window.partitionBy("length", "part", "salt").orderBy("row")
    numbered = salted.withColumn("own", F.row_number().over(own) - 1).join(fine.join(coarse, ["length", "part"]), ["length", "part", "salt"])
    numbered = numbered.withColumn("number", F.col("base") + F.col("own_base") + F.col("own"))
    # Places by length, sorted by their first number: the last that is not above a piece's number is its place. There are
    # at most a few thousand fillings, so the table is small by construction.
    spots = places(plan, spark).groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "times", "sequence", "offset"))).alias("spots"))
    found = numbered.join(F.broadcast(spots), "length").withColumn("spot", F.element_at(F.filter("spots", lambda s: (s["first"] <= F.col("number")) & (F.col("number") < s["first"] + s["times"])), 1))
    out = found.withColumn("sequence_id", F.col("spot.sequence") + F.col("number") - F.col("spot.first")).withColumn("offset", F.col("spot.offset"))
    return out.select(*pieces.columns, "sequence_id", "offset", F.lit(plan.proved).alias("proved")).drop("row")


def pack_documents(df: DataFrame, vocabulary: str, capacity: int = 2048, id_column: str = "doc_id", text_column: str = "text", **limits) -> DataFrame:
    """Each document's pieces with sequence_id and offset (gapless from 0 in each sequence), and whether the number of sequences is proved to be the least."""
    cut = pieces_of(df, vocabulary, capacity, 0, id_column, text_column)
    # Numbers of rows as they are stored: no two rows share one, however often an id repeats.
    return pack_pieces(stored(cut.withColumn("row", F.monotonically_increasing_id()), "pieces"), capacity, **limits)
