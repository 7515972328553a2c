"""Operator 3: toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words sums, over all subsequences of three letters that span at most five, the
product of their weights, GAP to the number of letters skipped; so an insult with letters put in
between still meets the plain one. Punctuation inside words is skipped, digits that stand for
letters are read as these, and letters set apart by blanks are read as one word. Landmarks are words of
toxic training texts around letter sequences that clean ones lack. A text is a bag of its sentences'
words: a linear machine on Nyström features is trained on each toxic text's strongest word against
the strongest words of clean ones, chosen anew each round. As the machine is linear, landmarks, features
and weights fold into one table with a weight for each subsequence, so scoring is a gather and sums by
word in numpy, whatever the number of landmarks; a text's margin is its largest word's. A logistic
curve makes margins scores.

Training takes a bounded sample (parameters). Null or empty texts score as a text with no
evidence. Without labels of both kinds every text scores 0. Very long texts are scored whole. Repeated rows
(ties) score alike and are all kept, an empty table gives an empty result, and other columns are not carried.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import code_points, column, map_slices, mixed, texts_of

GAP = 0.7
OFFSETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: Symbols have six bits; these two are not letters.
SKIP, BREAK, END = 0, 62, 63
#: What words begin with, so that sequences can tell a word's start: free, as skipped signs are gone by then.
START = SKIP
#: What the log-likelihood ratio of a letter sequence must exceed the logarithm of the number of sequences tried by, and
#: the least number of texts, none a near copy of another, that must have it, for landmarks to be chosen around it.
SURPRISE, SUPPORT = 5.0, 4
#: The least margin that counts: no word at all.
NO_EVIDENCE = -1.0
#: The strongest different words of a text that count, and the words from which on a text's number of words does.
STRONGEST, FEW_WORDS = 3, 50


@functools.cache
def alphabet() -> np.ndarray:
    """The symbol of each code point: 1 to 26 for a to z, 27 to 61 for other letters."""
    out = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
    for m in regex.finditer(r"\p{L}", every):
        c = ord(m[0].lower()[0])
        out[m.start()] = c - 96 if 97 <= c <= 122 else 27 + c % 35
    out[[m.start() for m in regex.finditer(r"\s", every)]] = BREAK
    # Digits and signs that are written for letters.
    for sign, letter in zip("013457@$", "oieastas", strict=True):
        out[ord(sign)] = ord(letter) - 96
    out[0] = END
    return out


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' letters, each word's after a START; the number of the word that each is in; the text that each word is in."""
    points, _ = code_points([t.replace("\0", " ") + "\0" for t in texts])
    s = alphabet()[points]
    s = s[s != SKIP]
    after_break = np.concatenate(([True], s[:-1] >= BREAK))
    s = s[~((s == BREAK) & after_break)]  # one break between words
    edge = np.flatnonzero(s >= BREAK)
    if len(edge):
        size = np.diff(np.concatenate(([-1], edge))) - 1
        joins = np.flatnonzero((s[edge[:-1]] == BREAK) & (size[:-1] == 1) & (size[1:] == 1))
        s = np.delete(s, edge[joins])
    breaks = s >= BREAK
    word = np.cumsum(breaks)
    text_of = np.concatenate(([0], np.cumsum(s[breaks] == END)))
    letters, word = s[~breaks].astype(np.uint32), word[~breaks]
    starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(word) else np.zeros(0, np.int64)
    return np.insert(letters, starts, START), np.insert(word, starts, word[starts]), text_of


def triples(letters: np.ndarray, word: np.ndarray):
    """For each pair of offsets: the subsequences that start at each letter, whether they stay in a word, their weight."""
    n = len(letters)
    for one, two in OFFSETS:
        if n <= two:
            continue
        m = n - two
        yield (letters[:m] << 12) | (letters[one : one + m] << 6) | letters[two:], word[:m] == word[two:], GAP ** (two - 2)


def norms(sizes: np.ndarray) -> np.ndarray:
    """The root of a word's kernel with itself, by its length (as if no subsequence came twice)."""
    n = np.asarray(sizes, dtype=np.float64)
    return np.sqrt(np.maximum(np.maximum(n - 2, 0) + 2 * np.maximum(n - 3, 0) * GAP**2 + 3 * np.maximum(n - 4, 0) * GAP**4, 1e-9))


def word_margins(table: np.ndarray, letters: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with letters, and each one's sum of the table's weights over its norm."""
    if not len(letters):
        return np.zeros(0, np.int64), np.zeros(0)
    total = np.zeros(len(letters), dtype=np.float32)
    for u, inside, weight in triples(letters, word):
        total[: len(u)] += np.where(inside, table[u], 0) * np.float32(weight)
    at = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    sizes = np.diff(np.concatenate((at, [len(letters)])))
    return word[at], np.add.reduceat(total, at) / norms(sizes)


def features(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """The kernel of each word with each landmark, both normed."""
    out = np.zeros((len(words), len(landmarks)))
    letters = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.uint32)
    word = np.repeat(np.arange(len(words)), [len(w) for w in words])
    table = np.zeros(1 << 18, dtype=np.float32)
    for j, mark in enumerate(landmarks):
        mine = np.frombuffer(mark, dtype=np.uint8).astype(np.uint32)
        found = [(u[inside], weight) for u, inside, weight in triples(mine, np.zeros(len(mine), np.int64))]
        for u, weight in found:
            np.add.at(table, u, weight / norms(len(mine)))
        at, margins = word_margins(table, letters, word)
        out[at, j] = margins
        for u, _ in found:
            table[u] = 0
    return out


def apart(docs: list[list[bytes]], signs: int = 16, shared: int = 6) -> list[int]:
    """The first of each group of near copies: texts of which `shared` of `signs` least word hashes agree (about that share of words)."""
    rng = np.random.default_rng(11)
    turns = rng.integers(1, 1 << 63, (signs, 2), dtype=np.uint64) | np.uint64(1)
    place: dict[bytes, int] = {}
    numbers = [np.array([place.setdefault(w, len(place)) for w in d], dtype=np.uint64) for d in docs]
    spread = mixed(np.arange(1, len(place) + 1, dtype=np.uint64))
    least = [((spread[n][:, None] * turns[:, 0]) ^ turns[:, 1]).min(axis=0) if len(n) else None for n in numbers]
    out, holders = [], [{} for _ in range(signs)]
    for i, row in enumerate(least):
        if row is None:
            continue
        met: dict[int, int] = {}
        for h, x in zip(holders, row.tolist(), strict=True):
            for j in h.get(x, ()):
                met[j] = met.get(j, 0) + 1
        if max(met.values(), default=0) < shared:
            out.append(i)
            for h, x in zip(holders, row.tolist(), strict=True):
                h.setdefault(x, []).append(i)
    return out


def sequences(word: bytes) -> set[bytes]:
    """A word's runs of five symbols."""
    return {word[i : i + 5] for i in range(len(word) - 4)}


def telling_sequences(toxic: list[list[bytes]], clean: list[list[bytes]], most: int) -> list[bytes]:
    """Sequences that tell toxic texts from clean ones, strongest first.

    The more sequences are tried, the higher the bar: by chance alone about exp(-SURPRISE) of them would pass in all. Near copies
    count once, as they share each other's chance sequences.
    """

    toxic, clean = ([docs[i] for i in apart(docs)] for docs in (toxic, clean))
    if not toxic or not clean:
        return []
    number: dict[bytes, int] = {}
    of_word: dict[bytes, np.ndarray] = {}

    def texts_with(docs: list[list[bytes]], grow: bool) -> np.ndarray:
        """In how many of docs each known sequence is."""
        n = np.zeros(len(number), dtype=np.int64)
        for ws in docs:
            for w in ws:
                if w not in of_word:
                    ids = [number.setdefault(g, len(number)) for g in sequences(w)] if grow else [number[g] for g in sequences(w) if g in number]
                    of_word[w] = np.array(ids, dtype=np.int32)
            ids = np.unique(np.concatenate([of_word[w] for w in ws])) if ws else []
            n = np.append(n, np.zeros(len(number) - len(n), dtype=np.int64))
            n[ids] += 1
        return n

    often = texts_with(toxic, True)
    tried = [g for g, i in number.items() if often[i] >= SUPPORT]
    t = {g: int(often[number[g]]) for g in tried}
    number, of_word = {g: i for i, g in enumerate(tried)}, {}
    c = dict(zip(tried, texts_with(clean, False).tolist(), strict=True))
    ratio = len(clean) / len(toxic)
    base = len(toxic) / (len(toxic) + len(clean))
    bar = SURPRISE + np.log(max(1, len(t)))

    def surprise(g: bytes) -> float:
        """The log-likelihood ratio of g's share of toxic texts against the base rate."""
        n, p = t[g] + c[g], t[g] / (t[g] + c[g])
        return n * (p * np.log(p / base) + ((1 - p) * np.log((1 - p) / (1 - base)) if p < 1 else 0)) if p > base else 0.0

    def weight(g: bytes) -> float:
        return t[g] * np.log((t[g] + 0.1) * ratio / (c[g] + 0.1 * ratio + 0.1))

    marked = {g: surprise(g) for g in t if t[g] * ratio > 3 * c[g]}
    return sorted((g for g, x in marked.items() if x >= bar), key=lambda g: (-weight(g), g))[: 8 * most]


def choose_landmarks(toxic: list[list[bytes]], ranked: list[bytes], most: int) -> list[bytes]:
    """Frequent words of toxic texts around the telling sequences."""
    wanted = set(ranked)
    by_word: dict[bytes, dict[bytes, int]] = {}
    for ws in toxic:
        for w in ws:
            for g in sequences(w) & wanted:
                by_word.setdefault(g, {})[w] = by_word.setdefault(g, {}).get(w, 0) + 1
    out: list[bytes] = []
    covered: dict[bytes, int] = {}
    for g in ranked:
        if covered.get(g, 0) < 2 and len(out) < most:
            w = min((w for w in by_word[g] if w not in out), key=lambda w: (-by_word[g][w], len(w), w), default=None)
            if w is not None:
                out.append(w)
                for x in sequences(w):
                    covered[x] = covered.get(x, 0) + 1
    return out


def linear_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of least squared hinge loss, by accelerated gradient steps."""
    x1 = np.column_stack((x, np.ones(len(x))))
    scale = weight / weight.sum()
    rate = 1 / (2 * np.linalg.eigvalsh((x1 * scale[:, None]).T @ x1)[-1] + penalty)
    w, v = np.zeros(x1.shape[1]), np.zeros(x1.shape[1])
    for k in range(500):
        short = np.maximum(0, 1 - y * (x1 @ v))
        new = v - rate * (-2 * x1.T @ (scale * y * short) + penalty * v)
        v, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The likeliest logistic curve's coefficients, the last without a column, by Newton steps."""
    x = np.column_stack((x, np.ones(len(x))))
    ab = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(ab)), x.T @ (weight * (p - y)) + 1e-2 * ab)
        ab = ab - np.clip(step, -5, 5)
    return ab


def evidence(margins: np.ndarray, text_of: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts the margins of its STRONGEST different words, largest first, and how many words it has, as a logarithm.

    Words of one text with the same margin are one word.
    """
    out = np.full((n, STRONGEST + 1), NO_EVIDENCE)
    out[:, -1] = 0
    if len(margins):
        order = np.lexsort((-margins, text_of))
        m, t = margins[order], text_of[order]
        new = np.concatenate(([True], (t[1:] != t[:-1]) | (m[1:] != m[:-1])))
        m, t = m[new], t[new]
        first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        size = np.diff(np.concatenate((first, [len(t)])))
        rank = np.arange(len(t)) - np.repeat(first, size)
        top = rank < STRONGEST
        out[t[top], rank[top]] = np.clip(m[top], NO_EVIDENCE, 3)
        out[t[first], -1] = np.log(np.maximum(size, FEW_WORDS) / FEW_WORDS)
    return out


@dataclass
class ToxicityModel:
    #: A weight for each subsequence of three symbols.
    table: np.ndarray
    bias: float
    #: The logistic curve over evidence(): a coefficient for each of its columns, and the constant.
    curve: np.ndarray
    landmarks: list[bytes]

    def evidence(self, texts: list[str]) -> np.ndarray:
        letters, word, text_of = words_of(texts)
        at, margins = word_margins(self.table, letters, word)
        return evidence(margins + self.bias, text_of[at], len(texts))

    def bag_evidence(self, bags: list) -> np.ndarray:
        """The evidence of texts with these words."""
        every = sorted(set().union(*bags))
        place = {w: i for i, w in enumerate(every)}
        _, margins = word_margins(self.table, np.frombuffer(b"".join(every), np.uint8).astype(np.uint32), np.repeat(np.arange(len(every)), [len(w) for w in every]))
        words = np.fromiter((place[w] for b in bags for w in b), dtype=np.int64)
        return evidence(margins[words] + self.bias, np.repeat(np.arange(len(bags)), [len(b) for b in bags]), len(bags))

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.landmarks or not texts:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-(self.evidence(texts) @ self.curve[:-1] + self.curve[-1])))


def bags_of(texts: list[str]) -> list[set[bytes]]:
    """Each text's distinct words."""
    letters, word, text_of = words_of(texts)
    at = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(letters) else np.zeros(0, np.int64)
    raw = letters.astype(np.uint8).tobytes()
    bags: list[set[bytes]] = [set() for _ in texts]
    for a, b, t in zip(at.tolist(), [*at[1:].tolist(), len(raw)], text_of[word[at]].tolist() if len(at) else [], strict=True):
        bags[t].add(raw[a:b])
    return bags


def fit(texts: list[str], toxic: list[int], weight: list[float], most_landmarks: int = 96, strongest: int = 8, rounds: int = 4) -> ToxicityModel:
    once = {x: i for i, x in reversed(list(enumerate(texts)))}
    texts, toxic, weight = ([x[i] for i in sorted(once.values())] for x in (texts, toxic, weight))
    return fit_bags(bags_of(texts), toxic, weight, most_landmarks, strongest, rounds)


def fit_bags(bags: list, toxic: list[int], weight: list[float], most_landmarks: int = 96, strongest: int = 8, rounds: int = 4) -> ToxicityModel:
    """As fit, from each distinct text's distinct words."""
    empty = ToxicityModel(np.zeros(1 << 18, np.float32), 0.0, np.zeros(STRONGEST + 2), [])
    y = np.array(toxic)
    if not (y == 1).any() or not (y == 0).any():
        return empty
    docs = [sorted(w for w in b if 4 <= len(w) <= 41) for b in bags]
    bad_docs = [d for d, k in zip(docs, toxic, strict=True) if k]
    telling = telling_sequences(bad_docs, [d for d, k in zip(docs, toxic, strict=True) if not k], most_landmarks)
    marks = choose_landmarks(bad_docs, telling, most_landmarks)
    if not marks:
        return empty
    # One pass with all landmarks' subsequences picks each text's strongest words.
    first = np.zeros(1 << 18, dtype=np.float32)
    own = []
    for m in marks:
        codes = np.frombuffer(m, dtype=np.uint8).astype(np.uint32)
        own.append([(u[inside], weight_ / norms(len(m))) for u, inside, weight_ in triples(codes, np.zeros(len(m), np.int64))])
        for u, w in own[-1]:
            first[u] = np.maximum(first[u], np.float32(w * norms(len(m))))
    every = sorted(set().union(*docs))
    place = {w: i for i, w in enumerate(every)}
    _, strength = word_margins(first, np.frombuffer(b"".join(every), np.uint8).astype(np.uint32), np.repeat(np.arange(len(every)), [len(w) for w in every]))
    # Toxic-labelled texts without any telling sequence show nothing that the machine could learn: they count for the curve only.
    seen = set(telling)
    shows = [bool(k) and any(seen & sequences(w) for w in d) for d, k in zip(docs, toxic, strict=True)]
    tops = [sorted(d, key=lambda w: (-strength[place[w]], w))[:strongest] if bad or not k else [] for d, k, bad in zip(docs, toxic, shows, strict=True)]
    chosen = sorted(set().union(*map(set, tops)))
    row = {w: i for i, w in enumerate(chosen)}
    # Strongest words of toxic texts also train with a letter put in at each place.
    bad_words = sorted({w for t, k in zip(tops, toxic, strict=True) if k for w in t})
    put_in = {w: [w[:i] + bytes([1 + (7 * i + w[0]) % 26]) + w[i:] for i in range(2, len(w))] for w in bad_words}
    start, all_words = {}, list(chosen)
    for w in bad_words:
        start[row[w]] = range(len(all_words), len(all_words) + len(put_in[w]))
        all_words += put_in[w]
    kernel = features(all_words, marks)
    values, vectors = np.linalg.eigh((features(marks, marks) + features(marks, marks).T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-2)) @ vectors.T
    x = kernel @ root
    bad = [[row[w] for w in t] for t, k in zip(tops, toxic, strict=True) if k and t]
    good = np.array([row[w] for t, k in zip(tops, toxic, strict=True) if not k for w in t], dtype=np.int64)
    margin = kernel.max(axis=1)
    for _ in range(rounds):
        best = np.array([max(rows, key=lambda r: margin[r]) for rows in bad], dtype=np.int64)
        more = np.array([v for b in sorted(set(best.tolist())) for v in start[b]], dtype=np.int64)
        sizes = [len(best), len(more), len(good)]
        w, bias = linear_machine(np.vstack((x[best], x[more], x[good])), np.repeat([1.0, 1.0, -1.0], sizes), np.repeat([1 / max(1, n) * k for n, k in zip(sizes, (1, 1, 2), strict=True)], sizes))
        margin = x @ w + bias
    table = np.zeros(1 << 18, dtype=np.float32)
    for part, b in zip(own, root @ w, strict=True):
        for u, k in part:
            np.add.at(table, u, np.float32(k * b))
    model = ToxicityModel(table, bias, np.zeros(STRONGEST + 2), marks)
    model.curve = logistic(model.bag_evidence(bags), y.astype(float), np.array(weight))
    return model


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 1000, max_clean: int = 3000, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> ToxicityModel:
    """Fits on the texts of about max_toxic and max_clean labelled ids at most (all, if fewer), chosen by a hash of the id.

    labels has one row for each id. The sample, whose size these parameters bound, is broadcast to find its texts, of which
    only the distinct words go to the driver.
    """
    kind = dict(docs.dtypes)[id_column]
    rows = labels.filter(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).select(id_column, F.col(label_column).cast("int").alias("y"))
    n = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    share = {k: min(1.0, most / max(1, n.get(k, 0))) for k, most in ((0, max_clean), (1, max_toxic))}
    cut = F.when(F.col("y") == 1, F.lit(int(share[1] * (1 << 30)))).otherwise(F.lit(int(share[0] * (1 << 30))))
    chosen = rows.filter(F.pmod(F.xxhash64(id_column), F.lit(1 << 30)) < cut)
    texts = docs.select(id_column, text_column).filter(F.col(text_column).isNotNull()).join(F.broadcast(chosen), id_column).select(id_column, text_column, "y", F.md5(F.encode(text_column, "UTF-8")).alias("digest"))

    def kernel():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            # No letter's symbol is BREAK.
            words = [bytes((BREAK,)).join(sorted(b)) for b in bags_of(texts_of(batch, text_column))]
            return pa.RecordBatch.from_arrays([column(batch, id_column), column(batch, "digest"), column(batch, "y"), pa.array(words, pa.binary())], names=[id_column, "digest", "y", "words"])

        return work

    found = map_slices(texts, kernel, f"`{id_column}` {kind}, digest string, y int, words binary", text_column)
    known: dict[bytes, bytes] = {}
    bags, toxic, seen = [], [], set()
    for _, digest, y, words in sorted(found.collect(), key=lambda r: (str(r[0]), r[1], r[2])):
        if digest not in seen:
            seen.add(digest)
            bags.append([known.setdefault(w, w) for w in bytes(words).split(bytes((BREAK,))) if w])
            toxic.append(y)
    return fit_bags(bags, toxic, [1 / share[k] for k in toxic])


def score(df: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row's id and score (0 to 1; higher: likelier toxic)."""
    kind = dict(df.dtypes)[id_column]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def kernel():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([column(batch, id_column), pa.array(shared.value.score(texts_of(batch, text_column)), pa.float64())], names=[id_column, "score"])

        return work

    return map_slices(df.select(id_column, text_column), kernel, f"`{id_column}` {kind}, score double", text_column)
