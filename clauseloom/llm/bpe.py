"""Operator 1: byte-pair encoding and decoding over a pair occurrence index.

The distinct words of a slice of the partition are laid out in one array of symbols. An index maps
each adjacent pair of symbols to all its positions in that array. The ranks that are active (their
pair occurs) wait in a heap; the smallest is applied to all its positions from left to right, and the
lists of the pairs that come and go around each merge are updated. Each word is encoded once; texts
are put together from the encodings of their words, which a bounded cache keeps between slices.

Null texts are empty; an empty text has no ids and decodes to "". Very long texts are encoded whole. Repeated
rows (ties) are encoded alike and all kept; an empty table gives an empty result. Columns other than the id and
the text are neither read nor carried, whatever their names.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from array import array
from collections import defaultdict

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from clauseloom.llm.common import column, map_slices, texts_of

#: Words longer than this are encoded but not kept.
CACHED_WORD = 64
#: The cache is emptied when it holds as many words.
CACHED_WORDS = 1_000_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file says: symbols, ranked merges, how texts are normalised and cut into words."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: only plain byte-level BPE is supported")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens with options are not supported")
        #: pair -> rank and merged id, in one integer each.
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.ids[a] << 32 | self.ids[b]] = (rank, self.ids[a.removesuffix(self.suffix) + b if self.suffix else a + b])
        alphabet = byte_alphabet()
        self.first = [self.ids.get(c, -1) for c in alphabet]
        self.last = [self.ids.get(c + self.suffix, -1) for c in alphabet]
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.added.items()]}
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        normalizer, splitter = spec["normalizer"], spec["pre_tokenizer"]
        parts = splitter["pretokenizers"] if splitter["type"] == "Sequence" else [splitter]
        if parts[0]["type"] == "Split":
            if parts[0]["behavior"] != "Removed" or not parts[0]["invert"]:
                raise ValueError(f"{path}: unknown way to split")
            self.words = regex.compile(parts[0]["pattern"]["Regex"])
        else:
            # Fixed value: the published pattern of byte-level pre-tokenization.
            self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.steps = [n for n in (normalizer["normalizers"] if normalizer and normalizer["type"] == "Sequence" else [normalizer]) if n]
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.bytes_of = {c: b for b, c in enumerate(alphabet)}

    def normal(self, text: str) -> str:
        for step in self.steps:
            if step["type"] == "NFC":
                text = text if text.isascii() else unicodedata.normalize("NFC", text)
            elif step["type"] == "Replace":
                text = regex.sub(step["pattern"]["Regex"], step["content"], text)
            elif step["type"] == "Lowercase":  # one character at a time, so no final sigma
                text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
            else:
                raise ValueError(step["type"])
        return text

    def pieces(self, text: str) -> list[tuple[str | None, int]]:
        """text cut at the added tokens' strings: (text, 0) or (None, id)."""
        if not self.special or not self.special.search(text):
            return [(text, 0)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(text[at : m.start()], 0)] * (m.start() > at) + [(None, self.added[m[0]])]
            at = m.end()
        return out + [(text[at:], 0)] * (at < len(text))

    def decode(self, ids) -> str:
        """The text that the library's decode gives: tokens joined by a space, or by the byte-level decoder."""
        tokens = list(map(self.tokens.__getitem__, ids))
        if not self.byte_decoder:
            return " ".join(tokens)
        return b"".join(bytes(self.bytes_of[c] for c in t) if t not in self.added else t.encode() for t in tokens).decode("utf-8", "replace")


def merge_all(words: list[str], voc: Vocabulary) -> list[array]:
    """The ids of each word, by merges over one pair occurrence index of all words."""
    symbols: list[int] = []
    starts: list[int] = []
    for w in words:
        raw = w.encode("utf-8", "replace")
        starts.append(len(symbols))
        symbols += [voc.first[b] for b in raw[:-1]]
        symbols.append(voc.last[raw[-1]])
    n = len(symbols)
    right = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    for s in starts:
        left[s] = -1
        if s:
            right[s - 1] = n
    right[n - 1 :] = [n]
    merges = voc.merges
    where: dict[int, list[int]] = defaultdict(list)
    for i in range(n):
        if right[i] < n:
            pair = symbols[i] << 32 | symbols[i + 1]
            if pair in merges:
                where[pair].append(i)
    active = [(merges[p][0], p) for p in where]
    heapq.heapify(active)
    while active:
        rank, pair = heapq.heappop(active)
        spots = where.pop(pair, None)
        if not spots:
            continue
        spots.sort()
        a, b, whole = pair >> 32, pair & 0xFFFFFFFF, merges[pair][1]
        for k, i in enumerate(spots):
            if symbols[i] != a or (j := right[i]) >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = whole, -1
            after = right[i] = right[j]
            lower = False
            if after < n:
                left[after] = i
                p = whole << 32 | symbols[after]
                if p in merges:
                    if p not in where:
                        heapq.heappush(active, (merges[p][0], p))
                    where[p].append(i)
                    lower |= merges[p][0] < rank
            before = left[i]
            if before >= 0:
                p = symbols[before] << 32 | whole
                if p in merges:
                    if p not in where:
                        heapq.heappush(active, (merges[p][0], p))
                    where[p].append(before)
                    lower |= merges[p][0] < rank
            if lower and k + 1 < len(spots):  # a smaller rank became active: it goes first
                where[pair] += spots[k + 1 :]
                heapq.heappush(active, (rank, pair))
                break
    out = []
    for s, e in zip(starts, [*starts[1:], n], strict=True):
        out.append(array("I", [x for x in symbols[s:e] if x >= 0]))
    return out


def has_unknown(text: str) -> bool:
    """Whether a text holds a character that Python's tables leave unassigned; the library's may be newer."""
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        return any(unicodedata.category(c) == "Cn" for c in set(text))


class Encoder:
    """Encodes lists of texts; keeps what it knows of short words."""

    def __init__(self, path: str) -> None:
        self.voc = Vocabulary(path)
        self.path, self.library = path, None
        self.known: dict[str, bytes] = {}
        #: Words of the texts at hand that are not kept.
        self.long: list[str] = []

    def words(self, text: str) -> list[str | int]:
        if not text.isascii() and has_unknown(text):
            return self.library_words(text)
        find = self.voc.words.findall
        out: list = []
        for part, special in self.voc.pieces(text):
            out += [special] if part is None else find(self.voc.normal(part))
        return out

    def library_words(self, text: str) -> list[str | int]:
        """As words, cut by the library itself: its tables say what characters are that Python's do not know yet."""
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        out: list = []
        for part, special in self.voc.pieces(text):
            if part is None:
                out.append(special)
            else:
                normal = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                cut = self.library.pre_tokenizer.pre_tokenize_str(normal)
                out += [normal[a:b] for _, (a, b) in cut]
        return out

    def learn(self, words) -> None:
        """Encodes the words that aren't known, all over one index."""
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        new = sorted(w for w in words if w not in self.known and type(w) is str)
        self.known.update((i, array("I", [i]).tobytes()) for i in self.voc.added.values())
        if new:
            for w, ids in zip(new, merge_all(new, self.voc), strict=True):
                self.known[w] = ids.tobytes()
            self.long = [w for w in new if len(w) > CACHED_WORD]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        cut = [self.words(t) for t in texts]
        fresh: set = set()
        for ws in cut:
            fresh.update(ws)
        self.learn(fresh)
        known = self.known
        out = [b"".join([known[w] for w in ws]) for ws in cut]
        for w in self.long:
            del known[w]
        self.long = []
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker: what it knows serves all of the worker's tasks."""
    return Encoder(path)


def encode_decode(df: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row's ids and what they decode to.

    Returns id, ids (binary: little-endian unsigned 32-bit integers), n_tokens, decoded. `vocabulary`
    is the path of a tokenizer file, readable on the executors. Texts are encoded whole, strings of
    added tokens inside them as the added tokens, as the library does by default.
    """
    kind = dict(df.dtypes)[id_column]

    def kernel():
        enc = encoder(vocabulary)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = enc.encode(texts_of(batch, text_column))
            decoded = [enc.voc.decode(array("I", raw)) for raw in ids]
            return pa.RecordBatch.from_arrays(
                [column(batch, id_column), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(decoded, pa.string())],
                names=[id_column, "ids", "n_tokens", "decoded"],
            )

        return work

    return map_slices(df.select(id_column, text_column), kernel, f"`{id_column}` {kind}, ids binary, n_tokens bigint, decoded string", text_column)
