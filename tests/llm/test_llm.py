"""The training-data operators against brute force, libraries and round trips, and their edge cases."""

import collections
import hashlib
import inspect
import itertools
import math
import random
import zlib
from array import array

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from clauseloom.llm import ann, bpe, common, fst_tokens, jpeg, langid, ordermin, packing, queries, substring, toxicity, urlfilter
from tests.conftest import DATA

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.execute(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall())


def odd_texts(n=400):
    r = random.Random(5)
    signs = "aAbBzÉßΣσİıǅ'\"’.,!?-_ \t\n\r\x0b\x1c\x1f\x85\xa0\u200b0123½²Ⅷª中文字😀é\u00ad<|>"
    parts = ["'s", "'t", "'re", "'ve", "'ll", " ", "a", "'", "r", "e", "l", "v", "\n", "1", "!"]
    return (
        ["".join(r.choice(signs) for _ in range(r.randint(0, 80))) for _ in range(n)]
        + ["".join(r.choice(parts) for _ in range(30)) for _ in range(n)]
        + ["".join(r.choice("abehtinors ") for _ in range(60)) for _ in range(n)]
        + ["a<|endoftext|>b <|startoftext|>", "<|endoftext|>", "a" * 3000, "ha" * 2000, " " * 700, "", "   ", "\n\n x"]
    )


def test_bpe_as_the_library(texts):
    part = [*list(texts.values())[:300], *odd_texts()]
    for path in (WORD, BYTE):
        library = Tokenizer.from_file(path)
        enc = bpe.Encoder(path)
        for text, raw, ref in zip(part, enc.encode(part), library.encode_batch(part, add_special_tokens=False), strict=True):
            assert list(array("I", raw)) == ref.ids, repr(text)
            assert enc.voc.decode(ref.ids) == library.decode(ref.ids, skip_special_tokens=False)


def test_ids_and_counts_of_all_code_points():
    """Every assigned code point, and those that some tables leave unassigned, between letters, digits and quotes."""
    points = [c for c in (*range(1, 0x3000), *range(0x3000, 0x20000, 3), *range(0x20000, 0xF0100, 61)) if not 0xD800 <= c < 0xE000]
    for path in (WORD, BYTE):
        library, enc = Tokenizer.from_file(path), bpe.Encoder(path)
        for form in ("a{0}b", "1{0}'s {0}2 '{0}re"):
            some = [form.format(chr(c)) for c in points]
            want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
            assert [array("I", raw).tolist() for raw in enc.encode(some)] == want
            if path == BYTE:
                assert fst_tokens.counter(path).count(some) == list(map(len, want))
                fast = packing.encoder(path)
                assert [fast(t).tolist() for t in some] == want


def test_op1_digests(spark, texts):
    library = Tokenizer.from_file(WORD)
    rows = {r.doc_id: r for r in queries.op1_bpe(spark, DATA).collect()}
    assert len(rows) == len(texts)
    for i, ref in zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False), strict=True):
        ids = ref.ids
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op2_held_out_accuracy(spark, texts):
    lang = dict(duckdb.execute(f"select doc_id, lang from '{DATA}/documents.parquet'").fetchall())
    rows = queries.op2_language(spark, DATA).collect()
    assert len(rows) == len(texts)
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows) and all(0 <= r.score <= 1 for r in rows)
    assert sum(lang[r.doc_id] == r.lang_pred for r in out) / len(out) > 0.95


def test_op2_prediction_is_of_the_text_alone():
    model = langid.LanguageModel(["a", "b"], np.random.default_rng(1).normal(size=(langid.BUCKETS + 1, 2)).astype(np.float32), np.zeros(2))
    model.log_probs[-1] = 0
    some = ["one two", "", "123 !!", "ßé x", "a"]
    together, scores = model.score(some)
    assert together[1:3] == ["und", "und"] and scores[1] == 0
    for t, lang, s in zip(some, together, scores, strict=True):
        assert model.score([t])[0] == [lang] and abs(model.score([t])[1][0] - s) < 1e-9


def test_op3_on_a_made_corpus():
    r = random.Random(2)
    syllables = ["ta", "re", "mo", "li", "en", "or", "th", "is", "wa", "nd", "ke", "pu"]
    insults = ["blockhead", "numbskull", "wretch", "dimwit"]

    def text(bad):
        words = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(60)]
        for _ in range(3 * bad):
            words[r.randrange(60)] = r.choice(insults)
        return " ".join(words)

    y = [int(k % 5 == 0) for k in range(600)]
    docs = [text(k) for k in y]
    model = toxicity.fit(docs[:400], y[:400], [1.0] * 400)
    got = model.score(docs[400:]) >= 0.3
    assert (got == np.array(y[400:])).mean() > 0.97
    calm = "tare moli enor this wand"
    plain, gapped, put_in, spaced, none = model.score([f"{calm} numbskull", f"{calm} n-u-m-b-s-k-u-l-l", f"{calm} numbsskull", f"{calm} d i m w i t {calm}", calm])
    assert min(plain, gapped, put_in, spaced) >= 0.3 > none
    assert model.score(["", calm])[0] < 0.3
    assert (toxicity.fit(docs[:3], [0, 0, 0], [1.0] * 3).score(docs[:2]) == 0).all()


def test_op3_query_against_the_plain_model(spark, texts):
    """The query over whole tables, against the same model applied here; figures on labelled rows that it did not learn from."""
    labels = dict(duckdb.execute(f"select doc_id, max(toxic) from '{DATA}/labels.parquet' group by 1").fetchall())
    rows = {r.doc_id: r for r in queries.op3_toxicity(spark, DATA).collect()}
    assert len(rows) == len(texts) and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    known = [i for i in labels if i in texts and zlib.crc32(str(i).encode()) % 4 != 2 and labels[i] in (0, 1)]
    model = toxicity.fit([texts[i] for i in sorted(known, key=str)], [labels[i] for i in sorted(known, key=str)], [1.0] * len(known))
    want = dict(zip(texts, model.score(list(texts.values())).tolist(), strict=True))
    assert all(abs(rows[i].score - want[i]) < 1e-3 and rows[i].predicted == (rows[i].score >= 0.3) for i in texts)
    toxic, clean = ([rows[i].predicted for i in labels if i in texts and rows[i].held_out and labels[i] == k] for k in (1, 0))
    assert sum(toxic) / len(toxic) >= 0.6 and sum(clean) / len(clean) <= 0.05


def test_op2_against_plain_naive_bayes(spark):
    """Counts, smoothing and posteriors one n-gram at a time, on a small corpus that is learnt whole."""
    r = random.Random(3)
    words = {"a": ["uno", "dos", "ñandú"], "b": ["one", "two", "ßtrange"], "c": ["ein", "zwei", "für"]}
    rows = [(k, " ".join(r.choices(words[x], k=r.randint(1, 8))), x) for k in range(60) for x in [r.choice("abc")]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(df)

    def buckets(text):
        found, _, _ = langid.grams([text])
        return [b for row in found.tolist() for b in row if b != langid.BUCKETS]

    counts = {x: collections.Counter(b for _, t, y in rows if y == x for b in buckets(t)) for x in "abc"}
    for i, t, got, score in langid.identify(df, model).join(df.select("doc_id", "text"), "doc_id").select("doc_id", "text", "lang_pred", "score").collect():
        logs = {}
        for x in "abc":
            total = sum(counts[x].values()) + 0.5 * langid.BUCKETS
            logs[x] = math.log(sum(y == x for *_, y in rows) / len(rows)) + sum(math.log((counts[x][b] + 0.5) / total) for b in buckets(t))
        best = max(logs, key=logs.get)
        assert got == best and abs(score - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-4, i


def test_op3_trains_on_words_as_on_texts(spark):
    rng = random.Random(4)
    usual = ["".join(rng.choices("abcdefghijklmnoprstuv", k=rng.randint(1, 9))) for _ in range(400)]
    rows = [(k, " ".join(rng.choices(usual, k=60)) + (" zwxqhud" if k % 6 == 0 else ""), int(k % 6 == 0)) for k in range(300)] + [(300, "", 0), (301, "y" * 60, 0)]
    rows.append((302, rows[0][1], 1))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    got, want = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic")), toxicity.fit([r[1] for r in rows], [r[2] for r in rows], [1.0] * len(rows))
    assert got.landmarks and np.allclose(got.score([r[1] for r in rows]), want.score([r[1] for r in rows]), atol=1e-3)
    assert np.allclose(want.bag_evidence(toxicity.bags_of([r[1] for r in rows])), want.evidence([r[1] for r in rows]), atol=1e-4)
    known = inspect.signature(toxicity.train).parameters, inspect.signature(toxicity.fit_bags).parameters
    assert (known[0]["max_toxic"].default, known[0]["max_clean"].default, known[1]["most_landmarks"].default, known[1]["strongest"].default) == (1000, 3000, 96, 8)


def test_kernel_is_the_subsequence_sum():
    def plain(s, t):
        def f(w):
            out = collections.Counter()
            for i in range(len(w)):
                for a, b in toxicity.OFFSETS:
                    if i + b < len(w):
                        out[w[i], w[i + a], w[i + b]] += toxicity.GAP ** (b - 2)
            return out

        x, y = f(s), f(t)
        return sum(x[u] * y[u] for u in x)

    words = [bytes([1, 2, 3, 4, 5]), bytes([1, 2, 9, 3, 4, 5]), bytes([7, 8, 7, 8, 7]), bytes([1, 2])]
    got = toxicity.features(words, words[:3])
    for i, w in enumerate(words):
        for j, m in enumerate(words[:3]):
            if len(w) > 2:
                assert math.isclose(got[i, j], plain(w, m) / (toxicity.norms(len(w)) * toxicity.norms(len(m))), rel_tol=1e-5)


def test_op4_as_the_library(spark, texts):
    part = [*list(texts.values())[:300], *odd_texts()]
    library = Tokenizer.from_file(BYTE)
    assert fst_tokens.Counter(BYTE).count(part) == [len(e.ids) for e in library.encode_batch(part, add_special_tokens=False)]
    rows = {r.doc_id: r for r in queries.op4_token_counts(spark, DATA).collect()}
    for i, ref in zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False), strict=True):
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (len(ref.ids), len(texts[i].encode()), len(ref.ids) > 1024)


def test_op5_as_sql_and_on_odd_urls(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as from '{DATA}/pages.parquet'")
    assert sorted(map(tuple, queries.op5_url_filters(spark, DATA).collect()), key=str) == sorted(con.execute(queries.ORACLE["op5_url_filters"]).fetchall(), key=str)
    urls = [None, "", "x", "a://", "http://example.com", "http://EXAMPLE.com/en/x", "http://www.example.com/en/", "http://a.b.net/fr/?x", "http://net/es/", "ftp://q.net#/es/", "a://b.com?x://c.com/", "http://com/", "http://a..com/en/", "http://aexample.com/en/"]
    df = spark.createDataFrame([(k // 2 if k < 4 else k, u, u, 1) for k, u in enumerate(urls * 2)], "page_id bigint, url string, host string, digest int")
    con.register("odd", df.select("page_id", "url").toPandas())
    con.execute("create or replace view pages as from odd")
    rules = urlfilter.rule_table(spark, queries.URL_RULES)
    want = sorted(con.execute(queries.ORACLE["op5_url_filters"]).fetchall(), key=str)
    for most in (1000, 0):
        assert sorted(map(tuple, urlfilter.judge(df, rules, most_broadcast=most).collect()), key=str) == want
    assert urlfilter.judge(df.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.judge(df, rules.limit(0)).collect()} == {"allow"}


def test_op6_round_trip(spark, texts):
    raw = [jpeg.padded(t.encode()) for t in list(texts.values())[:50]] + [jpeg.padded(x) for x in (b"", b"\xff" * 577, bytes(range(256)) * 900)]
    media = jpeg.encode_many(raw)
    for p, m, found in zip(raw, media, jpeg.thumbnails(media), strict=True):
        assert b"".join(t.tobytes() for *_, t in found) == p and m[:2] == b"\xff\xd8" and m[-2:] == b"\xff\xd9"
        assert jpeg.thumbnails([m])[0][0][2].tobytes() == found[0][2].tobytes()
    rows = {r.doc_id: r for r in queries.op6_media(spark, DATA).collect()}
    for i in list(texts):
        p = jpeg.padded(texts[i].encode())
        (medium,) = jpeg.encode_many([p])
        assert (rows[i].media_bytes, rows[i].media_sha256) == (len(medium), hashlib.sha256(medium).hexdigest())
        assert rows[i].feature.split(":")[1] == f"{jpeg.average_hash(np.frombuffer(p, np.uint8).reshape(-1, jpeg.COLUMNS)):016x}" or "+" in rows[i].feature
        assert (rows[i].payload_sha256, rows[i].payload_bytes, rows[i].tail_crc32) == (hashlib.sha256(p).hexdigest(), len(p), zlib.crc32(p[-32:]))


def test_op6_broken_media_are_rows(spark):
    good = jpeg.encode_many([jpeg.padded(b"abc")])[0]
    media = [good, None, b"", b"no image", good[:-2], good[:40], b"\xff\xd8" + good[30:], good + b"\xff", bytes(200), good]
    df = spark.createDataFrame([(k, 1, m) for k, m in enumerate(media)], "doc_id int, n_bytes int, media binary")
    rows = {r.doc_id: r for r in jpeg.read_media(df).collect()}
    assert [rows[k].n_images for k in range(10)] == [1, 0, 0, 0, 0, 0, 0, 0, 0, 1]
    assert [rows[k].error is None for k in range(10)] == [True] * 3 + [False] * 6 + [True] and rows[9].thumb_hash == rows[0].thumb_hash


def test_op6_feature_is_of_all_images(spark, tmp_path):
    same = "ab" * (jpeg.COLUMNS * jpeg.MOST_ROWS // 2)
    rows = [(1, same + "x" * 600 + "~" * 552), (2, same + "~" * 552 + "x" * 600), (3, same + "x" * 1200), (4, "short")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.feature for r in queries.op6_media(spark, str(tmp_path)).collect()}
    assert len(set(got.values())) == 4 and got[1].startswith("2x192x65280+192x384:") and len(got[1].split(":")[1]) == 32
    assert got[4].startswith("1x192x192:") and len(got[4].split(":")[1]) == 16


def test_op6_reads_colour_without_restarts():
    """A 4:2:0 image made here with AC coefficients: 3 components, two MCUs."""
    dc, ac = jpeg.codes(jpeg.DC_LENGTHS, jpeg.DC_SYMBOLS), jpeg.codes((0, 2, 1, *[0] * 13), (0, 0x01, 0xF0))
    bits, before, want = "", [0, 0, 0], []
    r = random.Random(3)
    for _unit in range(2):
        for c, n in ((0, 4), (1, 1), (2, 1)):
            for _ in range(n):
                value = r.randint(-100, 100)
                if c == 0:
                    want.append(value)
                d, before[c] = value - before[c], value
                size = abs(d).bit_length()
                bits += f"{dc[size][0]:0{dc[size][1]}b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "")
                bits += f"{ac[0xF0][0]:03b}" + f"{ac[0x01][0]:02b}1" + f"{ac[0][0]:02b}"
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    head = b"\xff\xd8" + jpeg.segment(0xDB, bytes((0, 8, *[1] * 63))) + jpeg.segment(0xC0, b"\x08\x00\x10\x00\x20\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00")
    head += jpeg.segment(0xC4, bytes((0x00, *jpeg.DC_LENGTHS, *jpeg.DC_SYMBOLS)) + bytes((0x10, 0, 2, 1, *[0] * 13, 0, 0x01, 0xF0)))
    ((width, height, thumb),) = jpeg.thumbnails([head + jpeg.segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + scan + b"\xff\xd9"])[0]
    a = np.array(want).reshape(2, 2, 2) + 128
    assert (width, height) == (32, 16) and (thumb == np.concatenate((a[0], a[1]), axis=1)).all()


def recall_of(got, ids, v, asked, k=10):
    """Of rows found against brute force; every score is the exact distance."""
    hits = total = 0
    for q in np.flatnonzero(asked):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if j != q][:k]
        mine = sorted(got[int(ids[q])])
        assert [x[0] for x in mine] == list(range(1, k + 1))
        hits += len({x[1] for x in mine} & set(ids[order].tolist()))
        total += k
        at = {int(i): float(x) for i, x in zip(ids, d, strict=True)}
        assert all(math.isclose(x[2], at[x[1]], rel_tol=1e-12) for x in mine)
    return hits / total


def test_op7_against_brute_force(spark):
    """All rows of sf0.1, in one block and in many."""
    where = "/root/testdata/sf0.1"
    rows = duckdb.execute(f"select vec_id, embedding from '{where}/embeddings.parquet' order by 1").fetchall()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    df = spark.read.parquet(f"{where}/embeddings.parquet")
    for out in (queries.op7_nearest(spark, where), ann.nearest(df, df.vec_id % 100 == 0, block_rows=400, query_rows=8)):
        got = collections.defaultdict(list)
        for r in out.collect():
            got[r.query_id].append((r["rank"], r.vec_id, r.score))
        assert recall_of(got, ids, v, ids % 100 == 0) >= 0.99


def test_op7_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (100, [0.0, 1.0]), (7, [1.0, 0.0]), (7, [0.0, 1.1]), (None, [1.0, 1.0]), (8, [1.0])]
    df = spark.createDataFrame([(i, v, "x", 1, 2, "y") for i, v in rows], "vec_id bigint, embedding array<float>, score string, row int, dim int, bits string")
    got = [tuple(r) for r in ann.nearest(df, df.vec_id % 100 == 0, block_rows=2).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 7), (0, 3, 100), (0, 4, 7), (100, 1, 7), (100, 2, 0), (100, 3, 1), (100, 4, 7)]
    assert got[0][3] == 0 and ann.nearest(df.limit(0), df.vec_id % 100 == 0).count() == 0
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 2.0])], "vec_id bigint, embedding array<double>")
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(twice, twice.vec_id % 100 == 0).collect()) == [(0, 1, 0), (0, 1, 0)]


def brute_repeats(rows, window=50):
    first = {}
    cut = [(i, [w for w in regex.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in rows]
    for i, ws in cut:
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k : k + window])
            first[key] = min(first.get(key, math.inf), math.inf if i is None else i)
    out = []
    for i, ws in cut:
        gone = set()
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k : k + window])] < (math.inf if i is None else i):
                gone.update(range(k, k + window))
        kept = [w for k, w in enumerate(ws) if k not in gone]
        out.append((i, len(ws), len(gone), " ".join(kept)))
    return out


def test_op8_against_brute_force(spark, texts):
    got = sorted(tuple(r) for r in queries.op8_repeats(spark, DATA).collect())
    want = sorted((i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute_repeats(texts.items()))
    assert got == want and sum(g[2] for g in got) > 0


def test_op8_edges(spark):
    r = random.Random(4)
    words = [f"w{r.randrange(6)}" for _ in range(4000)]
    rows = [(k // 2, " ".join(words[a : a + r.randrange(0, 150)])) for k in range(80) for a in [r.randrange(0, 300)]]
    rows += [(None, rows[5][1]), (None, rows[5][1]), (-3, rows[7][1]), (5, None), (6, ""), (7, "\xa0 a\x85b\x1cc \t"), rows[9], (200, " ".join(words)), (201, " ".join(words * 3)), (202, "same " * 400), (203, "same " * 300)]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id bigint, text string, rid int, kept string, doc int")
    for window in (50, 20):
        got = substring.remove_repeats(df, window=window).select("doc_id", "n_words", "n_removed", "kept").collect()
        assert sorted(map(tuple, got), key=str) == sorted(brute_repeats(rows, window), key=str)
    assert substring.remove_repeats(df.limit(0)).count() == 0


def test_op8_words_of_another_text_stay(spark, monkeypatch):
    """With hashes that tell nothing apart, the digest of the words at the source still does."""
    monkeypatch.setattr(substring.Sums, "runs", lambda self, start, size: np.full(len(start), 7, dtype=np.uint64))
    a, b = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    found = list(substring.pieces(*substring.hashed([" ".join(a), " ".join(b)]), 50, 8))
    assert len(set(found[3].tolist())) == len(set(found[4].tolist())) == 1
    span = [(0, 11, substring.digest([w.encode() for w in a]), None)]
    rows = [(1, " ".join(a), span), (2, " ".join(b), span)]
    df = spark.createDataFrame(rows, "doc_id int, text string, spans array<struct<start:int,windows:int,digest:binary,some:array<int>>>")
    assert {r.doc_id: r.n_removed for r in substring.cut_words(df, 50, ["doc_id"]).collect()} == {1: 60, 2: 0}


def test_alignment_is_exact():
    r = random.Random(6)
    for _ in range(200):
        a = [r.randrange(40) for _ in range(r.randint(1, 120))]
        b = list(a)
        for _ in range(r.randrange(0, 6)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(2)] = [r.randrange(40) for _ in range(r.randrange(2))]
        x, y = (ordermin.shingles(np.array(w, dtype=np.uint64)).tolist() for w in (a, b))
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, j in itertools.product(range(len(x)), range(len(y))):
            table[i + 1, j + 1] = table[i, j] + 1 if x[i] == y[j] else max(table[i, j + 1], table[i + 1, j])
        m = table[-1, -1]
        if not b:
            continue
        want = m >= 0.8 * (len(x) + len(y) - m) - 1e-9
        assert ordermin.similar(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), 0.8) == want


def brute_classes(rows, similarity=0.8):
    ws = [ordermin.word_array(t or "") for _, t in rows]
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    sh = [set(ordermin.shingles(w).tolist()) if len(w) else set() for w in ws]
    holders = collections.defaultdict(set)
    for k, s in enumerate(sh):
        for x in s:
            holders[x].add(k)
    near = collections.Counter((a, b) for h in holders.values() for a, b in itertools.combinations(sorted(h), 2))
    for (a, b), n in near.items():
        if n >= 0.5 * max(len(sh[a]), len(sh[b])) and ordermin.similar(ws[a], ws[b], similarity):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        groups[top(k) if len(ws[k]) else -1 - k].append(rows[k][0])
    return sorted((i, min((x for x in g if x is not None), default=None)) for g in groups.values() for i in g)


def test_op9_against_brute_force(spark, texts):
    got = sorted((r.doc_id, r.class_id) for r in queries.op9_near_duplicates(spark, DATA).collect())
    assert got == brute_classes(list(texts.items())) and sum(a != b for a, b in got) > 50


def test_op9_links_a_copy_that_repeats_a_line(spark):
    once, twice = (np.array(x, dtype=np.uint64) for x in ([7, 8, 9], [7, 8, 7, 9]))
    got = ordermin.labelled(twice)
    assert set(ordermin.labelled(once).tolist()) <= set(got.tolist()) and len(set(got.tolist())) == 4
    for n in (20, 60, 600):
        words = [f"w{n}x{k}" for k in range(n)]
        line = words[3 : 8 + n // 60]
        rows = [(1, " ".join(words)), (2, " ".join([*words, *line]))]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        similarity = 0.7 if n == 20 else 0.8
        assert ordermin.similar(*(ordermin.word_array(t) for _, t in rows), similarity)
        assert {r.class_id for r in ordermin.near_classes(df, similarity).collect()} == {1}


def test_op9_edges(spark):
    r = random.Random(8)
    base = [f"word{r.randrange(5000)}" for _ in range(300)]
    rows = [(k, " ".join(base[: 300 - k // 3])) for k in range(60)]  # a chain: ends are far, neighbours near
    rows += [(100, None), (101, ""), (102, "!!"), (103, "one two"), (104, "One, two!"), (105, "one two three"), (None, "one two"), (106, " ".join(base[:9])), (107, " ".join(base[:10])), rows[3]]
    rows += [(200 + k, " ".join([*base[:100], *(f"own{k}x{j}" for j in range(100))])) for k in range(30)]  # one shared passage
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, node int, class string")
    out = ordermin.near_classes(df).collect()
    # Rows 106 and 107 are at 5 / 6: linked, as are all of the chain; the null id joins its words' class.
    special = {103: 103, 104: 103, None: 103, 107: 106}
    want = [(i, special.get(i, 0 if i is not None and i < 60 else i)) for i, _ in rows]
    assert sorted(((r.doc_id, r.class_id) for r in out), key=str) == sorted(want, key=str)
    assert {r.doc_id: r.n_links > 0 for r in out}[100] is False and all(r.n_links for r in out if r.class_id == 0)
    assert ordermin.near_classes(df.limit(0)).count() == 0


def test_op9_names_ids_and_long_chains(spark):
    """Text ids, columns named as the operator's own, a long chain of links, and an exact run without minima."""
    own = [f"w{k}" for k in range(60)]
    rows = [(f"d{k:03}", " ".join([*own[: 60 - k // 2], *(f"x{j}" for j in range(k // 2))])) for k in range(80)]
    df = spark.createDataFrame([(i, t, 1, 2, "c", 3, 4) for i, t in rows], "doc_id string, text string, rid int, rid2 int, class string, node int, empty int")
    got = {r.doc_id: r.class_id for r in ordermin.near_classes(df, most_different=256).collect()}
    assert set(got.values()) == {"d000"}
    edges = common.stored(spark.range(3000).selectExpr("id as a", "id + 1 as b"), "chain")
    assert [tuple(r) for r in ordermin.components(edges).groupBy("class").count().collect()] == [(0, 3001)]


def test_op9_recall_by_similarity():
    """The share of pairs that meet in a sketch and pass the minima, by their aligned similarity and length."""
    r = random.Random(17)

    def kept(n, edits):
        a = [r.randrange(1 << 40) for _ in range(n)]
        b = list(a)
        for _ in range(edits):
            b[r.randrange(len(b))] = r.randrange(1 << 40)
        x, y = (ordermin.shingles(np.array(w, dtype=np.uint64)) for w in (a, b))
        if not ordermin.aligned(x, y, 0.8):
            return None
        keys = [set(np.concatenate([ordermin.sketches(s, ordermin.HELD)] * (len(s) >= ordermin.LONG) + [ordermin.sketches(s, ordermin.FEW)] * (len(s) <= ordermin.SHORT)).tolist()) for s in (x, y)]
        minima = [ordermin.one_bit_minima(s).view(np.uint64) for s in (x, y)]
        return bool(keys[0] & keys[1]) and int(np.bitwise_count(minima[0] ^ minima[1]).sum()) <= ordermin.MOST_DIFFERENT

    for n in (12, 30, 60, 300, 1000):
        worst = max(1, round(n / 9 / 5))  # about 0.8: each edit takes five shingles from both
        for edits in {worst, max(1, worst // 2)}:
            found = [k for k in (kept(n, edits) for _ in range(150)) if k is not None]
            assert sum(found) >= 0.99 * len(found), (n, edits, sum(found), len(found))


def test_shared_counts_are_exact():
    r = np.random.default_rng(5)
    texts = [np.unique(r.integers(0, 300, 80).astype(np.uint64)) for _ in range(30)]
    got = ordermin.shared_counts(texts[:11], texts[11:], columns=64)
    assert (got == [[len(np.intersect1d(a, b)) for b in texts[11:]] for a in texts[:11]]).all()


def check_packing(rows, texts, capacity=2048):
    """rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    enc = packing.fast_encoding(BYTE)
    by_sequence, by_doc = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for spots in by_sequence.values():
        at = 0
        for offset, n in sorted(spots):
            assert offset == at
            at += n
        assert at <= capacity
    assert set(by_doc) == set(texts)
    for i, parts in by_doc.items():
        ids = np.append(enc.encode_to_numpy(texts[i] or "", allowed_special="all"), 0).astype("<u4")
        parts.sort(key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and [r.length for r in parts[1:]] == [capacity] * (len(parts) - 1)
        at = 0
        for r in parts:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return len(by_sequence)


def test_op10_packs_whole_documents(spark, texts):
    rows = queries.op10_packing(spark, DATA).collect()
    n = check_packing(rows, texts)
    assert n <= packing.lower_bound(collections.Counter(r["length"] for r in rows), 2048) + 1


def test_op10_ids_are_the_tokenizers_librarys(texts):
    library, fast = Tokenizer.from_file(BYTE), packing.encoder(BYTE)
    r = random.Random(1)
    runs = ["".join(r.choice(ws) for _ in range(n)) for ws in (" ", "\n", "\t\n \x85") for n in (1999, 2000, 2001, 5000)]
    around = itertools.product(("", "x", "<|endoftext|>", "12!"), ("", "y", "'s", "<|endoftext|>", "é z", "9"))
    long = [a + run + b + run for a, b in around for run in runs]
    for t in [*list(texts.values())[:200], *odd_texts(), *long]:
        assert fast(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t[:80])


def test_op10_and_pipeline_take_very_long_texts(spark):
    """A run of ten million blanks, and one word of a million letters."""
    rows = [(1, " " * 10_000_000 + "a"), (2, "b" * 1_000_000), (3, "\n" * 1_000_000), (4, "one two three")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = packing.pack_documents(df, BYTE)
    total = {r[0]: r[1] for r in out.groupBy("doc_id").sum("length").collect()}
    library = Tokenizer.from_file(BYTE)
    assert total[1] == 10_000_001 and all(total[i] == len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows[1:])
    assert corpus_pipeline.pack(spark, df, DATA).filter("piece = 0").count() == 4
    assert {r.doc_id: r.n_tokens for r in fst_tokens.token_counts(df, BYTE).collect()}[1] == 10_000_000
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_repeats):
        assert {r.doc_id for r in stage(spark, df, DATA).select("doc_id").collect()} == {1, 2, 3, 4}


def test_op10_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "same words here", "x", 1)] * 300 + [(None, "same words here", "y", 2)] * 300 + [(None, None, "z", 3)] * 50, "doc_id bigint, text string, row string, salt int")
    rows = packing.pack_documents(df, BYTE).collect()
    assert len(rows) == 650
    spots = collections.defaultdict(list)
    for r in rows:
        spots[r.sequence_id].append((r.offset, r.length))
    for own in spots.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(spots) == packing.lower_bound(collections.Counter(r["length"] for r in rows), 2048)


def test_bin_completion_is_optimal_on_small_cases():
    def optimum(sizes, capacity):
        best = [len(sizes)]

        def go(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(sizes):
                best[0] = len(bins)
                return
            for b in sorted({x for x in bins if x + sizes[k] <= capacity}):
                at = bins.index(b)
                go(k + 1, [*bins[:at], b + sizes[k], *bins[at + 1 :]])
            go(k + 1, [*bins, sizes[k]])

        go(0, [])
        return best[0]

    r = random.Random(9)
    for _ in range(60):
        sizes = sorted((r.randint(1, 60) for _ in range(r.randint(1, 9))), reverse=True)
        plan = packing.pack(collections.Counter(sizes), 100)
        best = optimum(sizes, 100)
        assert plan.sequences == best, sizes
        whole = packing.pack(collections.Counter(sizes), 100, most_nodes=None, branches=None, steps=None, repeat=False)
        assert whole.proved and whole.sequences == best
        assert sorted(s for f, n in plan.fillings for _ in range(n) for s in f) == sorted(sizes) and all(sum(f) <= 100 for f, _ in plan.fillings)
    assert packing.pack({}, 100).sequences == 0 and packing.pack({1: 5000, 2: 3000, 2048: 10}, 2048).proved
    assert packing.completions({60: 1, 30: 1, 20: 2, 10: 3}, [60, 30, 20, 10], 100) == ([(60, 30, 10), (60, 20, 20)], True)
    assert packing.dominated((60, 10, 10, 10), {60: 1, 30: 1, 20: 2, 10: 3}, 100) and not packing.dominated((60, 30, 10), {60: 1, 30: 1, 10: 3}, 100)


def odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 5000, "en", "s", 25000), (4, "Same text here, with a few words.", "en", "s", 5), (4, "Same text here, with a few words.", "en", "s", 5), (5, "Same text here, with a few words.", "fr", None, 5), (None, "no id", "en", "s", 5), (6, "x" * 30000, None, "s", 1), (7, "123 456", "en", "s", 7)]
    extra = spark.createDataFrame([(*r, "e", 1, 2.0, "z", True, "w", 3) for r in rows], SCHEMA + ", ids string, rid int, score double, class_id string, kept boolean, media string, length int")
    return rows, extra


def test_odd_documents_everywhere(spark):
    rows, df = odd_documents(spark)
    n = len(rows)
    assert bpe.encode_decode(df, WORD).count() == n and fst_tokens.token_counts(df, BYTE).count() == n
    assert {r.doc_id: r.n_tokens for r in fst_tokens.token_counts(df, BYTE).collect()}[2] == 0
    model = langid.train(df)
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, model).collect()}
    assert got[1] == got[2] == got[7] == "und"
    assert jpeg.read_media(jpeg.store_texts(df)).count() == n
    tox = toxicity.ToxicityModel(np.zeros(1 << 18, np.float32), -1.0, np.ones(toxicity.STRONGEST + 2), [b"x"])
    assert toxicity.score(df, tox).count() == n and toxicity.score(df.limit(0), tox).count() == 0
    assert len({r.score for r in toxicity.score(df, tox).filter("doc_id in (1, 2)").collect()}) == 1
    assert ordermin.near_classes(df).count() == n and substring.remove_repeats(df).count() == n
    packed = packing.pack_documents(df, BYTE)
    assert packed.filter("piece = 0").count() == n
    empty = df.limit(0)
    for out in (bpe.encode_decode(empty, WORD), fst_tokens.token_counts(empty, BYTE), langid.identify(empty, langid.train(empty)), jpeg.read_media(jpeg.store_texts(empty)), packing.pack_documents(empty, BYTE)):
        assert out.count() == 0


def test_pipeline_against_brute_force(spark, texts, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = dict(texts)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "packing":
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            check_packing(docs.collect(), want)
            continue
        got = dict(docs.select("doc_id", "text").collect())
        if name == "toxicity":
            model = queries.toxicity_model(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
            want = {i: t for i, t in want.items() if model.score([t])[0] < corpus_pipeline.TOXIC}
        elif name == "language":
            known = queries.language_model(spark.read.parquet(str(tmp_path / "toxicity")))
            want = {i: t for i, t in want.items() if any(c.isalpha() for c in t) and known.score([t])[1][0] >= corpus_pipeline.KNOWN}
        elif name == "near_duplicates":
            want = {i: want[i] for i, c in brute_classes(list(want.items())) if i == c}
        else:
            cut = brute_repeats(want.items())
            want = {i: want[i] if not g else k for i, n, g, k in cut if not g or g < n}
        assert got == want, name


def test_pipeline_carries_any_column(spark):
    """Each stage on odd rows with columns named as the operators' own: which ids stay, all columns, and an empty table."""
    rows, odd = odd_documents(spark)
    odd = odd.selectExpr("*", "1 as rid2", "'r' as row", "2 as rows", "3 as node", "'c' as class", "4 as spans", "5 as n_words", "6 as row_text", "7 as lang_pred")
    every = sorted((r[0] for r in rows), key=str)
    expected = {"toxicity": every, "near_duplicates": sorted([1, 2, 3, 4, 6, 7, None], key=str), "substrings": every}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, odd, DATA)
        assert out.dtypes == odd.dtypes and stage(spark, odd.limit(0), DATA).count() == 0
        got = sorted((r.doc_id for r in out.collect()), key=str)
        if name in expected:
            assert got == expected[name], name
        else:  # learnt from these few rows: only texts without letters are sure to go
            assert not {1, 2, 7} & set(got)
    assert corpus_pipeline.pack(spark, odd, DATA).filter("piece = 0").count() == len(rows) and corpus_pipeline.pack(spark, odd.limit(0), DATA).count() == 0
