"""Operator 4: token counts by compiled finite-state transducers.

Two deterministic transducers stand for a byte-level BPE tokenizer.

The *splitter* reads character classes and marks where words start. All texts of a slice form one
array, cut into chunks of equal length; every chunk yields the map from each state at its start to the
state at its end, the maps compose by a parallel prefix scan, and a second pass from the states so
found gives the marks. All of that is numpy over whole slices.

The *counter* reads the bytes of one word; each transition carries the change in the number of
tokens emitted. Its state is what can still matter: for each suffix of the bytes read that begins some
token, the trie node of the suffix, the last token before it and the tokens emitted before it. States
and transitions are made when first met (lazy determinisation) and both tables are bounded.

Null texts are empty (0 tokens); very long texts are counted whole. Repeated rows (ties) are all kept, an empty
table gives an empty result, and other columns are neither read nor carried, whatever their names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.bpe import Encoder, has_unknown
from clauseloom.llm.common import column, map_slices, texts_of

#: Characters in a chunk of the splitter.
CHUNK = 64
#: The counter's tables and the counts of words are emptied at these sizes.
MOST_TRANSITIONS, MOST_WORDS = 400_000, 800_000
#: Words longer than this aren't kept.
KEPT_WORD = 48

# Character classes and states of the splitter.
ENDS, R_, V_, L_, E_, LETTER, NUMBER, QUOTE, OTHER, BLANK, SPACE, CUT = range(12)
FRESH, LETTERS, NUMBERS, OTHERS, ONE_BLANK, ONE_SPACE, RUN_BLANK, RUN_SPACE, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(12)
#: Marks: a word starts at this character; at the one before it.
HERE, BEFORE = 1, 2
#: Stands between texts; valid UTF-8 never holds it.
SEPARATOR = "\udfff"


def splitter_step(state: int, c: int) -> tuple[int, int]:
    """The splitter's next state and marks, for words as the published byte-level pattern cuts them."""
    letter, blank = c <= LETTER, c in (BLANK, SPACE)
    if c == CUT:
        return FRESH, HERE | BEFORE * (state in (QUOTED_R, QUOTED_V, QUOTED_L))
    begun = LETTERS if letter else {NUMBER: NUMBERS, QUOTE: QUOTED, OTHER: OTHERS, BLANK: ONE_BLANK, SPACE: ONE_SPACE}[c]
    run = OTHERS if begun == QUOTED else begun  # a quote inside a run is no contraction
    if state == FRESH:
        return begun, HERE
    if state in (LETTERS, NUMBERS, OTHERS):
        return (state, 0) if run == state else (begun, HERE)
    if state in (ONE_BLANK, ONE_SPACE, RUN_BLANK, RUN_SPACE):
        if blank:
            return RUN_BLANK if c == BLANK else RUN_SPACE, 0
        split = BEFORE * (state in (RUN_BLANK, RUN_SPACE))  # the run gives up its last character
        return (run, split) if state in (ONE_BLANK, RUN_BLANK) else (begun, split | HERE)
    if state == QUOTED:
        if c == ENDS:
            return FRESH, 0
        if c in (R_, V_, L_):
            return {R_: QUOTED_R, V_: QUOTED_V, L_: QUOTED_L}[c], 0
        return (OTHERS, 0) if c in (QUOTE, OTHER) else (begun, HERE)
    if c == (L_ if state == QUOTED_L else E_):
        return FRESH, 0
    return (LETTERS, BEFORE) if letter else (begun, BEFORE | HERE)


@functools.cache
def splitter_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each code point; next state and marks at 16 * state + class."""
    classes = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
    for pattern, c in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        classes[[m.start() for m in regex.finditer(pattern, every)]] = c
    for chars, c in (("stmd", ENDS), ("r", R_), ("v", V_), ("l", L_), ("e", E_), ("'", QUOTE), (" ", BLANK), (SEPARATOR, CUT)):
        classes[[ord(x) for x in chars]] = c
    state, marks = np.zeros(256, dtype=np.uint8), np.zeros(256, dtype=np.uint8)
    for s in range(12):
        for c in range(12):
            state[16 * s + c], marks[16 * s + c] = splitter_step(s, c)
    return classes, state, marks


def word_starts(joined: str) -> np.ndarray:
    """Where words, and separators, start in texts joined by (and ending with) SEPARATOR."""
    classes, step, marks = splitter_tables()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(points)
    chunks = -(-n // CHUNK)
    kinds = np.full(chunks * CHUNK, CUT, dtype=np.uint8)
    kinds[:n] = classes[points]
    kinds = np.ascontiguousarray(kinds.reshape(chunks, CHUNK).T)
    maps = np.repeat(np.arange(12, dtype=np.uint8)[:, None], chunks, axis=1)  # start state x chunk
    for k in range(CHUNK):
        maps = step[(maps << 4) | kinds[k]]
    width = 1
    while width < chunks:  # each map becomes the composition of all maps up to its chunk
        maps[:, width:] = np.take_along_axis(maps[:, width:], maps[:, :-width], axis=0)
        width *= 2
    state = np.concatenate(([FRESH], maps[FRESH, :-1])).astype(np.uint8)
    found = np.empty((CHUNK, chunks), dtype=np.uint8)
    for k in range(CHUNK):
        at = (state << 4) | kinds[k]
        found[k], state = marks[at], step[at]
    found = found.T.reshape(-1)[:n]
    starts = (found & HERE).astype(bool)
    starts[:-1] |= (found[1:] & BEFORE).astype(bool)
    return np.flatnonzero(starts)


class Counter(dict):
    """The number of tokens of a word, by the counter transducer; known short words are looked up."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.cutter = Encoder(path)
        voc = self.voc = self.cutter.voc
        if voc.suffix or voc.steps:
            raise ValueError("only byte-level vocabularies without normalisation")
        raw = {i: bytes(voc.bytes_of[c] for c in t) for t, i in voc.ids.items()}
        self.next: dict[int, int] = {}
        self.token = [-1]
        for i, b in raw.items():
            node = 0
            for x in b:
                key = node << 8 | x
                if key not in self.next:
                    self.next[key] = len(self.token)
                    self.token.append(-1)
                node = self.next[key]
            self.token[node] = i
        self.made = {whole: (rank, pair >> 32, pair & 0xFFFFFFFF) for pair, (rank, whole) in reversed(voc.merges.items())}
        self.spines: dict[int, tuple[list, list]] = {}
        self.fits: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [((), -1)]
        self.number: dict[tuple, int] = {((), -1): 0}
        self.steps: dict[int, tuple[int, int]] = {}

    def spine(self, token: int) -> tuple[list, list]:
        """The pieces at the left and at the right edge of a token while it is merged: (piece, rank of birth, of end)."""
        if token not in self.spines:
            both = []
            for side in (1, 2):
                out, piece, ends = [], token, 1 << 60
                while True:
                    born = self.made.get(piece, (-1,))[0]
                    out.append((piece, born, ends))
                    if born < 0:
                        break
                    piece, ends = self.made[piece][side], born
                both.append(out)
            self.spines[token] = (both[0], both[1])
        return self.spines[token]

    def stays(self, a: int, b: int) -> bool:
        """Whether the border between tokens a and b survives the merges: no two pieces that meet there merge first."""
        key = a << 32 | b
        if (known := self.fits.get(key)) is not None:
            return known
        ok, merges = True, self.voc.merges
        for y, y_born, y_ends in self.spine(b)[0]:
            for x, x_born, x_ends in self.spine(a)[1]:
                if x_born <= y_ends and y_born < x_ends:
                    m = merges.get(x << 32 | y)
                    if m and m[0] < x_ends and m[0] <= y_ends:
                        ok = False
                        break
            if not ok:
                break
        if len(self.fits) > MOST_TRANSITIONS:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def transition(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the change in the number of tokens."""
        entries, last = self.states[state]
        nexts, tokens = self.next, self.token
        kept, final, total = [], -1, 0
        for node, before, count in (*entries, (0, last, 0)):
            node = nexts.get(node << 8 | byte)
            if node is None:
                continue
            kept.append((node, before, count))
            t = tokens[node]
            if t >= 0 and final < 0 and (before < 0 or self.stays(before, t)):
                final, total = t, count + 1
        new = (tuple([(node, before, count - total) for node, before, count in kept]), final)
        to = self.number.setdefault(new, len(self.states))
        if to == len(self.states):
            self.states.append(new)
        self.steps[state << 8 | byte] = to, total
        return to, total

    def __missing__(self, word: str) -> int:
        if len(self.steps) > MOST_TRANSITIONS:
            self.reset()
        state, n, steps = 0, 0, self.steps
        for byte in word.encode():
            step = steps.get(state << 8 | byte)
            state, more = step if step else self.transition(state, byte)
            n += more
        if len(word) <= KEPT_WORD:
            self[word] = n
        return n

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text; strings of added tokens inside count as one each."""
        if len(self) > MOST_WORDS:
            self.clear()
        parts, owner, out = [], [], [0] * len(texts)
        for i, t in enumerate(texts):
            for part, _ in self.voc.pieces(t):
                if part is None:
                    out[i] += 1
                elif not part.isascii() and has_unknown(part):  # classes that only the library's newer tables know
                    out[i] += sum(map(self.__getitem__, self.cutter.library_words(part)))
                elif part:
                    parts.append(part)
                    owner.append(i)
        if not parts:
            return out
        self[SEPARATOR] = 0
        joined = SEPARATOR.join(parts) + SEPARATOR
        starts = word_starts(joined)
        ends = [*starts[1:].tolist(), len(joined)]
        words = map(joined.__getitem__, map(slice, starts.tolist(), ends))
        counts = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(ends))
        firsts = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
        for i, n in zip(owner, np.add.reduceat(counts, np.searchsorted(starts, firsts)).tolist(), strict=True):
            out[i] += n
        return out


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, vocabulary: str, limit: int = 1024, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row's id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit). `vocabulary`: a tokenizer file's path."""
    kind = dict(df.dtypes)[id_column]

    def kernel():
        count = counter(vocabulary).count

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch, text_column)
            sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            return pa.RecordBatch.from_arrays(
                [column(batch, id_column), pa.array(sizes, pa.int64()), pa.array(count(texts), pa.int64())], names=[id_column, "n_bytes", "n_tokens"]
            )

        return work

    out = map_slices(df.select(id_column, text_column), kernel, f"`{id_column}` {kind}, n_bytes bigint, n_tokens bigint", text_column)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
