"""Operator 9: near-duplicates by order MinHash and banded alignment.

Texts become lower-case words without punctuation, and these their five-word shingles, each labelled
with its occurrence. A sketch holds the `held` smallest labelled shingles under one hash function, in
text order, so it agrees for texts that share both shingles and their order. Texts with equal words (a
128-bit hash) are one node. Nodes with a sketch in common are candidates; a pair is linked if a banded
alignment of their shingles matches m of them with m / (a + b - m) >= similarity. (Matches off the band
could not reach that.) Classes are the links' connected components.

No bucket is expanded into all its pairs: each first checks its members against one leader, the node that
meets most others. In buckets that still hold several classes, only the members outside the largest class
are compared with the others of other classes, block against block, so a task's share is bounded whatever
the bucket's size and a link is lost only if no sketch of its two nodes agrees (below 1 in 10,000 at 0.8,
less above). Before alignment, pairs are left out that differ too much in length (exact) or in more of 256
one-bit minima than linked pairs can (short texts) or do (MOST_DIFFERENT, seven deviations, long ones;
256 leaves this step out). In alignments a block's common text travels once, not once for each pair.

Null texts and texts without a word (also empty ones) are classes of their own. Rows that repeat an id and
text share their class. The class id is its smallest id, nulls last; ids of any type that sorts. Very long
texts are sketched whole. An empty table gives an empty result. Other columns are neither read nor carried.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import column, discard, map_slices, mixed, slices, stored, texts_of
from clauseloom.llm.substring import row_ids

SHINGLE = 5
SKETCHES = 24
#: Shingles in a sketch; texts of up to SHORT shingles have sketches of FEW too, those under LONG only these.
HELD, FEW, LONG, SHORT = 5, 2, 24, 40
#: Distinct words whose hashes a worker keeps.
MOST_WORDS = 150_000
#: The most of 256 one-bit minima that linked texts differ in: at 0.8, 26 are expected, with a deviation of 4.8.
MOST_DIFFERENT = 60
#: Bounds of a block of a bucket's members (texts, shingles), and about how many texts one text is aligned with at once.
BLOCK, BLOCK_SHINGLES, ALIGNED = 2048, 1 << 19, 64

WORD = regex.compile(r"[\p{L}\p{N}]+")


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word, 9)
        if len(word) <= 40:
            self[word] = h
        return h


@functools.cache
def word_hashes() -> WordHashes:
    return WordHashes()


def word_array(text: str) -> np.ndarray:
    known = word_hashes()
    if len(known) > MOST_WORDS:
        known.clear()
    words = WORD.findall(text.lower())
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all five-word runs; of all words, if there are fewer."""
    n = min(SHINGLE, len(words))
    out = np.zeros(len(words) - n + 1 if n else 0, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)]
    return mixed(out)


def labelled(sh: np.ndarray) -> np.ndarray:
    """Shingles made different by the number of equal ones before them; each first one stays as it is."""
    order = np.argsort(sh, kind="stable")
    ranked = sh[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    if new.all():
        return sh
    at = np.arange(len(sh))
    nth = at - np.maximum.accumulate(np.where(new, at, 0))
    out = np.empty_like(sh)
    out[order] = np.where(nth == 0, ranked, mixed(ranked + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    return out


@functools.cache
def factors() -> np.ndarray:
    return np.random.default_rng(99).integers(0, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(sh: np.ndarray, held: int) -> np.ndarray:
    """The hash of each sketch: of its shingles in text order."""
    n, held = len(sh), min(held, len(sh))
    few = 4 * held + 8
    if n > 2 * few:
        # Only values under a bound that about `few` keep are sorted.
        bound = np.uint64(int((1 << 64) * few / n))
        found, values = [], []
        step = max(1, (1 << 18) // n)
        for k in range(0, SKETCHES, step):
            product = sh[None, :] * factors()[k : k + step, None]
            which, at = np.nonzero(product < bound)
            found.append(((which + k), at))
            values.append(product[which, at])
        which, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((np.concatenate(values), which))
        begin = np.searchsorted(which, np.arange(SKETCHES + 1))
        if (np.diff(begin) >= held).all():
            spots = at[order[begin[:-1, None] + np.arange(held)]]
        else:
            spots = np.argsort(sh[None, :] * factors()[:, None], axis=1, kind="stable")[:, :held]
    else:
        spots = np.argsort(sh[None, :] * factors()[:, None], axis=1, kind="stable")[:, :held]
    spots.sort(axis=1)
    out = np.arange(SKETCHES, dtype=np.uint64) + np.uint64(1000 * held)
    for j in range(held):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + sh[spots[:, j]])
    return out


def one_bit_minima(sh: np.ndarray) -> np.ndarray:
    """One bit of the least value in each of 256 bins, as four integers."""
    values = np.sort(mixed(sh ^ np.uint64(0x5851F42D4C957F2D)))
    bins = values >> np.uint64(56)
    first = np.concatenate(([True], bins[1:] != bins[:-1]))
    bits = np.zeros(256, dtype=np.uint8)
    bits[bins[first].astype(np.int64)] = (values[first] & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two word arrays align, by their shingles."""
    return aligned(shingles(a), shingles(b), similarity)


def aligned(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether a banded alignment of two texts' shingles matches enough of them.

    Row by row over one text's shingles, all columns of the band at once as the bits of an integer.
    """
    total = len(x) + len(y)
    apart = int(total * (1 - similarity) / (1 + similarity) + 1e-9)  # the most shingles left unmatched
    if abs(len(x) - len(y)) > apart:
        return False
    limit = min(len(x), len(y))
    head = int(np.argmin(np.append(x[:limit] == y[:limit], False)))
    x, y = x[head:], y[head:]
    limit = min(len(x), len(y))
    tail = int(np.argmin(np.append(x[::-1][:limit] == y[::-1][:limit], False)))
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if len(x) + len(y) <= apart:
        return True
    where: dict[int, int] = {}
    for j, v in enumerate(y.tolist()):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row, band = full, (1 << (2 * apart + 1)) - 1
    for i, v in enumerate(x.tolist()):
        at = where.get(v)
        if at:
            hit = row & at & (band << (i - apart) if i >= apart else band >> (apart - i))
            if hit:
                row = ((row + hit) | (row - hit)) & full
    matched = len(y) - row.bit_count()
    return len(x) + len(y) - 2 * matched <= apart


def marks_of(docs: DataFrame) -> DataFrame:
    """Each row's ids, its words' hash (two halves, null without words), number of shingles, minima and sketches. docs: rid, rid2, doc, text."""
    kind = dict(docs.dtypes)["doc"]

    def kernel():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            h1, h2, size, minima, keys = [], [], [], [], []
            for text in texts_of(batch):
                words = word_array(text)
                if not len(words):
                    h1.append(None), h2.append(None), size.append(0), minima.append([0] * 4), keys.append([])
                    continue
                sh = labelled(shingles(words))
                whole = np.frombuffer(xxhash.xxh3_128_digest(words.tobytes()), dtype=np.int64)
                h1.append(int(whole[0])), h2.append(int(whole[1])), size.append(len(sh)), minima.append(one_bit_minima(sh).tolist())
                own = [sketches(sh, HELD)] * (len(sh) >= LONG) + [sketches(sh, FEW)] * (len(sh) <= SHORT)
                keys.append(np.concatenate(own).view(np.int64))
            m = np.array(minima, dtype=np.int64).reshape(-1, 4)
            return pa.RecordBatch.from_arrays(
                [*(column(batch, c) for c in ("rid", "rid2", "doc")), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(size, pa.int32()), *(pa.array(m[:, k]) for k in range(4)), pa.array(keys, pa.list_(pa.int64()))],
                names=["rid", "rid2", "doc", "h1", "h2", "size", "m0", "m1", "m2", "m3", "keys"],
            )

        return work

    return map_slices(docs.select("rid", "rid2", "doc", "text"), kernel, f"rid bigint, rid2 bigint, doc {kind}, h1 bigint, h2 bigint, size int, m0 bigint, m1 bigint, m2 bigint, m3 bigint, keys array<bigint>")


def most_apart(a: Column, b: Column, similarity: float) -> Column:
    """The most shingles that two linked texts with a and b of them leave unmatched."""
    return F.floor((a + b) * ((1 - similarity) / (1 + similarity)) + 1e-9)


def near_enough(similarity: float, most_different: int) -> Column:
    """The condition on a pair (columns a_ and b_) that links meet (almost) always."""
    a, b = F.col("a_size"), F.col("b_size")
    different = sum((F.bit_count(F.col(f"a_m{k}").bitwiseXOR(F.col(f"b_m{k}"))) for k in range(1, 4)), F.bit_count(F.col("a_m0").bitwiseXOR(F.col("b_m0"))))
    apart = most_apart(a, b, similarity)
    return (F.abs(a - b) <= apart) & (different <= F.least(F.lit(most_different), apart))


def components(edges: DataFrame) -> DataFrame:
    """node -> class (the least node of its connected component) and n_links, for nodes with links. edges: a, b; stored.

    Labels only fall, and each round at least halves a chain's way, so the rounds end by themselves.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("class")).withColumnRenamed("a", "node"), "labels")
    while True:
        # The least class among a node's neighbours, then the class of that class.
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("class").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("class").alias("was"), F.least("class", "near").alias("class"))
        jump = labels.select(F.col("node").alias("of"), F.col("class").alias("further"))
        new = stored(step.join(jump, F.col("class") == F.col("of"), "left").select("node", "was", F.least("class", F.coalesce("further", "class")).alias("class")), "labels")
        discard(labels)
        labels = new
        if new.filter("was != class").isEmpty():
            break
    counts = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    out = stored(labels.select("node", "class").join(counts, "node"), "classes")
    discard(labels, both)
    return out


def bodies_of(ids: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, words) of the nodes in ids; stored. nodes: node and the rid, rid2 of one of its rows."""
    wanted = ids.join(nodes.select("node", "rid", "rid2"), "node").hint("merge")

    def kernel():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = [(word_array(t) >> np.uint64(32)).astype(np.uint32).tobytes() for t in texts_of(batch)]
            return pa.RecordBatch.from_arrays([column(batch, "node"), pa.array(words, pa.binary())], names=["node", "words"])

        return work

    one_each = docs.select("rid", "rid2", "text").join(wanted, ["rid", "rid2"]).dropDuplicates(["rid", "rid2"]).select("node", "text")
    return stored(map_slices(one_each, kernel, "node bigint, words binary"), "bodies")


def words_in(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint32).astype(np.uint64)


def verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b; stored) that align.

    Pairs are grouped in blocks of one text and about ALIGNED others. A block's first row holds the words of that text,
    and each further row another's, so that the kernel only ever holds two texts.
    """
    bodies = bodies_of(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct(), docs, nodes)
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / ALIGNED).alias("blocks"))
    blocks = pairs.join(size.hint("merge"), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))
    others = blocks.join(bodies.withColumnRenamed("node", "b").hint("merge"), "b").select("a", "block", "b", "words")
    first = blocks.select("a", "block").distinct().join(bodies.withColumnRenamed("node", "a").hint("merge"), "a").select("a", "block", F.lit(None).cast("bigint").alias("b"), "words")

    def run(batches):
        mine = np.zeros(0, dtype=np.uint64)
        for batch in (piece for whole in batches for piece in slices(whole, "words")):
            a, b, words = (column(batch, k).to_pylist() for k in ("a", "b", "words"))
            out: list[tuple[int, int]] = []
            for x, y, raw in zip(a, b, words, strict=True):
                own = shingles(words_in(raw))
                if y is None:
                    mine = own
                elif aligned(mine, own, similarity):
                    out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([k[j] for k in out], pa.int64()) for j in (0, 1)], names=["a", "b"])

    rows = first.unionByName(others).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    out = stored(rows.mapInArrow(run, "a bigint, b bigint"), "verified")
    discard(bodies)
    return out


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many labelled shingles each text of one list has in common with each of the other."""
    sizes = [len(x) for x in (*left, *right)]
    values, place = np.unique(np.concatenate((*left, *right)), return_inverse=True)
    text = np.repeat(np.arange(len(sizes)), sizes)
    often = np.bincount(place, minlength=len(values)) > 1
    number = np.cumsum(often) - 1
    keep = often[place]
    text, place = text[keep], number[place[keep]]
    order = np.argsort(place, kind="stable")
    text, place = text[order], place[order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for start in range(0, int(often.sum()), columns):
        a, b = np.searchsorted(place, (start, start + columns))
        holds = np.zeros((len(sizes), columns), dtype=np.float32)
        holds[text[a:b], place[a:b] - start] = 1
        out += holds[: len(left)] @ holds[len(left) :].T
    return out


def block_links(rows: DataFrame, similarity: float, most_different: int) -> DataFrame:
    """The linked pairs (a < b) within each group (key, kind, i, j) of rows: of its two sides, or of one (side -1) with itself.

    All that two blocks have in common is decided in the kernel: length and minima, then the exact number of shared
    shingles, then the alignment; only links leave it.
    """
    most = (1 - similarity) / (1 + similarity)

    def links_of(side: np.ndarray, node: np.ndarray, group: np.ndarray, size: np.ndarray, minima: np.ndarray, words: list[bytes]) -> list[tuple[int, int]]:
        left, right = np.flatnonzero(side <= 0), np.flatnonzero(side != 0)
        right = left if side[0] < 0 else right
        sh: dict[int, np.ndarray] = {}
        links = []
        for k in range(0, len(left), 256):
            x = left[k : k + 256]
            apart = np.floor((size[x][:, None] + size[right][None, :]) * most + 1e-9)
            fine = (group[x][:, None] != group[right][None, :]) & (np.abs(size[x][:, None] - size[right][None, :]) <= apart)
            if side[0] < 0:
                fine &= x[:, None] < right[None, :]
            r, c = np.nonzero(fine)
            different = np.bitwise_count(minima[x[r]] ^ minima[right[c]]).sum(axis=1)
            ok = different <= np.minimum(most_different, apart[r, c])
            r, c = r[ok], c[ok]
            if not len(r):
                continue
            some, others = np.unique(r), np.unique(c)
            for m in {*x[some].tolist(), *right[others].tolist()} - sh.keys():
                sh[m] = shingles(words_in(words[m]))
            shared = shared_counts([labelled(sh[m]) for m in x[some].tolist()], [labelled(sh[m]) for m in right[others].tolist()])
            n = shared[np.searchsorted(some, r), np.searchsorted(others, c)]
            ok = size[x[r]] + size[right[c]] - 2 * n <= apart[r, c] + 0.5
            links += [(node[p], node[q]) for p, q in zip(x[r[ok]].tolist(), right[c[ok]].tolist(), strict=True) if aligned(sh[p], sh[q], similarity)]
        return links

    keys = ("key", "kind", "i", "j")

    def run(batches):
        held: pa.Table | None = None

        def flush(table: pa.Table) -> pa.RecordBatch:
            at = np.column_stack([np.asarray(table.column(c)) for c in keys])
            edge = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]).any(axis=1), [True]))).tolist()
            side, node, group, size = (np.asarray(table.column(c)).astype(np.int64) for c in ("side", "node", "class", "size"))
            minima = np.column_stack([np.asarray(table.column(f"m{k}")) for k in range(4)]).view(np.uint64)
            words = table.column("words")
            found: set[tuple[int, int]] = set()
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                if e - s > 1:
                    found.update((min(p), max(p)) for p in links_of(side[s:e], node[s:e], group[s:e], size[s:e], minima[s:e], words.slice(s, e - s).to_pylist()))
            every = sorted(found)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in every], pa.int64()) for k in (0, 1)], names=["a", "b"])

        # The last group of a batch may go on in the next one, so it waits. A group is bounded by the size of blocks.
        for batch in (piece for whole in batches for piece in slices(whole, "words", 8 << 20)):
            now = pa.Table.from_batches([batch])
            table = now if held is None else pa.concat_tables([held, now])
            same = np.logical_and.reduce([np.asarray(table.column(c)) == table.column(c)[table.num_rows - 1].as_py() for c in keys])
            cut = int(np.argmax(same))
            if cut:
                yield flush(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            yield flush(held)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def rest_of(members: DataFrame, classes: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: float, most_different: int) -> DataFrame:
    """Links between different classes that meet in a bucket; stored. members: key, node; stored, as classes is."""
    sorted_out = members.join(classes.select("node", "class").hint("merge"), "node", "left").select("key", "node", F.coalesce("class", "node").alias("class"))
    sorted_out = stored(sorted_out.join(nodes.select("node", *WHAT).hint("merge"), "node"), "sorted")
    by_class = sorted_out.groupBy("key", "class").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    major = by_class.groupBy("key").agg(F.max(F.struct("n", "class", "shingles")).alias("top"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles")).filter("top.n < n")

    def blocks(n: Column, shingles_: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK), F.ceil(shingles_ / BLOCK_SHINGLES))

    # Both sides of a bucket go to blocks: its largest class, and all others.
    sides = major.select("key", F.col("top.class").alias("major"), blocks(F.col("top.n"), F.col("top.shingles")).alias("major_blocks"), blocks(F.col("n") - F.col("top.n"), F.col("shingles") - F.col("top.shingles")).alias("minor_blocks"))
    opened = stored(sorted_out.join(sides.hint("merge"), "key"), "open")
    discard(sorted_out)
    bodies = bodies_of(opened.select("node").distinct(), docs, nodes)
    own = opened.withColumn("large", F.col("class") == F.col("major")).withColumn("at", F.pmod(F.xxhash64("node"), F.when(F.col("large"), F.col("major_blocks")).otherwise(F.col("minor_blocks"))))

    def each(n: Column) -> Column:
        return F.sequence(F.lit(0).cast("bigint"), n - 1)

    at = F.col("at")
    # kind 0: the others among themselves; kind 1: the others (i) with the largest class (j).
    among = F.transform(each(F.col("minor_blocks")), lambda k: F.struct(F.lit(0).alias("kind"), F.least(at, k).alias("i"), F.greatest(at, k).alias("j"), F.when(at == k, -1).when(at < k, 0).otherwise(1).alias("side")))
    across = F.transform(each(F.col("major_blocks")), lambda k: F.struct(F.lit(1).alias("kind"), at.alias("i"), k.alias("j"), F.lit(0).alias("side")))
    large = F.transform(each(F.col("minor_blocks")), lambda k: F.struct(F.lit(1).alias("kind"), k.alias("i"), at.alias("j"), F.lit(1).alias("side")))
    dealt = own.select("key", "node", "class", *WHAT, F.explode(F.when(F.col("large"), large).otherwise(F.concat(among, across))).alias("x")).select("key", "node", "class", *WHAT, "x.*")
    found = stored(block_links(dealt.join(bodies.hint("merge"), "node"), similarity, most_different), "rest")
    discard(opened, bodies)
    return found


WHAT = ("size", "m0", "m1", "m2", "m3")


def near_classes(df: DataFrame, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text", most_different: int = MOST_DIFFERENT) -> DataFrame:
    """Each row's rid, rid2, id, class_id (the least id of its class), class_size (rows), n_links and kept.

    n_links counts the links of the row's text to other texts that were checked; they span its class, so they need not be
    all. kept is true for the rows of one (id, text) of each class.
    """
    docs = df.select(*row_ids(id_column, text_column), F.col(id_column).alias("doc"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    marks = stored(marks_of(docs), "marks")
    distinct = marks.filter("h1 is not null").groupBy("h1", "h2").agg(F.min(F.struct("rid", "rid2", *WHAT, "keys")).alias("x"))
    # Numbers of rows as they are stored, so two texts can't share one.
    nodes = stored(distinct.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "x.*"), "nodes")
    rows = stored(marks.select("rid", "rid2", "doc", "h1", "h2"), "rows")
    discard(marks)
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("bucket"), F.min("node").alias("one"), F.max("node").alias("two")).filter("one < two").select("key", "bucket")
    members = stored(keyed.join(shared.hint("merge"), "key"), "members")
    # A bucket is led by its node of the most company in all its buckets: the likeliest centre of a group.
    company = members.groupBy("node").agg(F.sum("bucket").alias("company"), F.collect_list("key").alias("keys"))  # at most 2 x SKETCHES keys
    leaders = company.select("node", "company", F.explode("keys").alias("key")).groupBy("key").agg(F.max(F.struct("company", "node")).alias("top")).select("key", F.col("top.node").alias("leader"))
    to_leaders = members.join(leaders.hint("merge"), "key").filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    a, b = (nodes.select(F.col("node").alias(s), *(F.col(k).alias(f"{s}_{k}") for k in WHAT)).hint("merge") for s in "ab")
    starts = stored(to_leaders.join(a, "a").join(b, "b").filter(near_enough(similarity, most_different)).select("a", "b"), "starts")
    links = verify(starts, docs, nodes, similarity)
    classes = components(links)
    discard(starts)
    more = rest_of(members, classes, docs, nodes, similarity, most_different)
    discard(members)
    if not more.isEmpty():
        every = stored(links.union(more), "all")
        discard(classes)
        classes = components(every)
        discard(every)
    discard(more, links)
    found = nodes.select("node", "h1", "h2").join(classes.hint("merge"), "node", "left")
    own = rows.join(found.hint("merge"), ["h1", "h2"], "left")
    empty = F.col("node").isNull()  # a class of its own, known by its row
    alone = (empty.alias("empty"), F.when(empty, F.col("rid2")).otherwise(0).alias("lone"))
    placed = stored(own.select("rid", "rid2", "doc", F.coalesce("class", "node", "rid").alias("class"), *alone, F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")), "placed")
    discard(rows, nodes, classes)
    first = F.min(F.struct(F.col("doc").isNull().alias("null"), "doc", "rid", "rid2")).alias("head")
    heads = placed.groupBy("class", "lone", "empty").agg(first, F.count("*").alias("class_size"))
    out = placed.join(heads.hint("merge"), ["class", "lone", "empty"])
    kept = (F.col("rid") == F.col("head.rid")) & (F.col("rid2") == F.col("head.rid2"))
    return out.select("rid", "rid2", F.col("doc").alias(id_column), F.col("head.doc").alias("class_id"), "class_size", "n_links", kept.alias("kept"))
