"""The ten operators against brute force, and on rows that are null, empty, long, tied or repeated."""

import hashlib
import itertools
import math
import pickle
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from quarrylight.llm import common, components, decontaminate, encoding, hmm_lm, langid, line_dedup, near_copies, packing, quality_fm, quality_rules, simhash, token_blocks, warc

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, words string"
TEXTS = [
    None,
    "",
    "   \n ",
    "one",
    "The cat sat.\nOn the mat, it's 12\n\nok",
    "a  b\tc \n d",
    "x" * 5000,
    "tie tie",
    "tie tie",
    "long word " * 3000,
    "é̀ ÀB <|endoftext|> \x02 \x01 z"
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeats, and extra columns whose names clash with those of results."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else f"s{i}", None, 7, "w") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(
        [*rows, rows[4], (None, "no id here", None, None, None, None, None)], SCHEMA
    ).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(path, text, end):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("path,spaced", [(BYTE, True), (WORD, False)])
def test_encoder_gives_the_library_ids(path, spaced):
    texts = [*TEXTS, "\na", "a\n", "a \nb", " lead", "don't, I'm!!", "A.\nB c\nD", "1,2;3", "a b", "tab\tx  y"]
    e = encoding.Encoder(path, 1, spaced)
    for _ in range(2):  # unseen, then remembered
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [ids(path, t, 1) for t in texts]


def test_words_are_encoded_once_whatever_their_case_and_points():
    """In Latin-1 texts a word in capitals or before a point is no piece of its own."""
    e, texts = encoding.Encoder(WORD, 1, False), ["Été été, ÉTÉ. été! été?\nété; été: Straße, STRASSE.", "ÉTÉ,"]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [ids(WORD, t, 1) for t in texts]
    assert set(e.known) == {"été", "straße", "strasse", *",.!?;:"}


def test_latin_texts_of_odd_bytes_and_lengths(monkeypatch):
    """Pieces are equal only if all their bytes are; texts longer than a run are cut; a clash of hashes changes nothing."""
    some = ["a", "a\0", "\0", "abcdefgh", "abcdefg\0", "abcdefghi", "é" * 16, "é" * 17, "é" * 16 + "è", "é" * 200, "<|endoftext|>", "a</w>", "4.5", "'S.", "...", "a.,", "\x1c.", "\xa0", "ª.", "l'ÉTÉ,"]
    texts = [*some, " ".join(some), "\n".join(some[::-1]), " ".join(some * 3), "", None, " ", "Σ. é,"]
    want = [np.array(ids(WORD, t, 1), "<u4").tobytes() for t in texts]
    assert encoding.Encoder(WORD, 1, False).encode(texts) == want
    monkeypatch.setattr(encoding, "_RUN", 60)
    sizes, real = [], encoding.latin_pieces
    monkeypatch.setattr(encoding, "latin_pieces", lambda runs: sizes.append(sum(map(len, runs))) or real(runs))
    assert encoding.Encoder(WORD, 1, False).encode(texts) == want
    assert len(sizes) > 10 and max(sizes) == 200  # of one piece
    monkeypatch.setattr(encoding.pd, "factorize", lambda x: (np.zeros(len(x), np.int64), x[:1]))
    assert encoding.latin_pieces([b"a b"]) is None
    assert encoding.Encoder(WORD, 1, False).encode(texts) == want


def test_packing_remembers_many_pieces(monkeypatch):
    """Half a million distinct pieces, met again, are not encoded again."""
    e, seen = encoding.Encoder(BYTE, 1, True, packing.REMEMBER), []
    texts = [" ".join(f"w{i:x}" for i in range(lo, lo + 1000)) for lo in range(0, 500_000, 1000)]
    first = [e.encode(texts[lo : lo + 50]) for lo in range(0, 500, 50)]
    real = e._library
    monkeypatch.setattr(e, "_library", lambda units, lead: seen.extend(units) or real(units, lead))
    assert [e.encode(texts[lo : lo + 50]) for lo in range(0, 500, 50)] == first and not seen
    assert first[3][7] == np.array(ids(BYTE, texts[157], 1), "<u4").tobytes()


def test_spaced_words_go_to_the_model_once(monkeypatch):
    """Words of letters are learnt without the pattern and whatever stands behind them; white space of any width is remembered."""
    e = encoding.Encoder(BYTE, 1, True)
    texts = ["Été, été! été?\nété; l'été: a.b 4,5", "two  spaces\n\nété\tété été\u3000x, ", " é.\n", "\n", " ", None, ""]
    seen, real = [], e._library
    monkeypatch.setattr(e, "_library", lambda units, lead: seen.extend(units) or real(units, lead))
    want = [np.array(ids(BYTE, t, 1), "<u4").tobytes() for t in texts]
    assert e.encode(texts) == want
    assert set(seen) == {*",!?;:.", "\n", " l'été", ".b", " 4", ",5", "  spaces", "\n\nété", "\tété", "\u3000x", " "}
    monkeypatch.setattr(e, "_each", None)  # nothing is encoded again, not as a whole either
    assert e.encode(texts) == want


def test_spaced_texts_of_odd_bytes_and_lengths(monkeypatch, tmp_path):
    """As for Latin-1 texts, in UTF-8: white space of all widths, control characters, contractions, pieces of all lengths."""
    some = ["a", "a\0", "\0", "abcdefg", "abcdefg\0", "é" * 12, "é" * 13, "é" * 12 + "è", "é" * 200, "<|endoftext|>", "4.5", "'s.", "don't,", "!'s", "a.'s", "a.,", "×,", "a\u0301,", "!\x1c", "\x1c", "字。", "’s", "İ."]
    white = ["\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\t", "\r\n", "  ", "\n\n", " \n", "\n ", "\u200b"]
    texts = [*some, *(f"{a}{w}{b}" for w in [" ", "\n", *white] for a, b in zip(["", *some], [*some, ""]))]
    texts += [" ".join(some * 3), "\n".join(some[::-1]), "".join(white), "x" * 500]

    def library(path):
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return [np.array([*e.ids, 1], "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]

    want = library(BYTE)
    assert encoding.Encoder(BYTE, 1, True, remember=40).encode(texts) == want
    monkeypatch.setattr(encoding, "_RUN", 60)
    sizes, cut = [], encoding.spaced_pieces
    monkeypatch.setattr(encoding, "spaced_pieces", lambda runs: sizes.append(sum(map(len, runs))) or cut(runs))
    assert encoding.Encoder(BYTE, 1, True).encode(texts) == want
    assert len(sizes) > 40 and max(sizes) == len("\n".join(some).encode())  # no space to cut at
    monkeypatch.setattr(encoding.pd, "factorize", lambda x: (np.zeros(len(x), np.int64), x[:1]))
    assert cut([b"a b"]) is None
    assert encoding.Encoder(BYTE, 1, True).encode(texts) == want
    # a tokenizer that does not cut at white space and points gets whole texts
    whole = Tokenizer.from_file(BYTE)
    whole.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    whole.save(path := str(tmp_path / "whole.json"))
    assert encoding.Encoder(path, 1, True).encode(texts) == library(path)


def test_packing_round_trip(spark, odd, none):
    rows = packing.pack(odd, BYTE).collect()
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    want = Counter((r.doc_id, tuple(ids(BYTE, r.text, 1))) for r in odd.collect())
    for (doc, tokens), n in want.items():
        pieces = sorted(by[(doc, len(tokens))], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == n * len(tokens)
        for r in pieces:
            assert tuple(np.frombuffer(r.ids, "<u4")) == tokens[r.start : r.start + r.length]
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
    for b in bins.values():
        b.sort(key=lambda r: r.offset)
        size = sum(r.length for r in b)
        assert [r.offset for r in b] == np.cumsum(
            [0, *(r.length for r in b)]
        )[:-1].tolist() and size & (size - 1) == 0 and size <= 2048
    assert packing.pack(none, BYTE).count() == 0


def test_packing_keeps_all_limits(spark):
    d = spark.createDataFrame(
        [(i, "w " * (i * 7 % 90 + 1), i % 50) for i in range(400)], "doc_id long, text string, loss long"
    ).coalesce(1)
    limits = packing.Limits(tokens=128, segments=5, loss_tokens=60)
    rows = packing.pack(d, BYTE, limits=limits, loss_col="loss").collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
    assert all(
        sum(r.length for r in b) <= 128 and len(b) <= 5 and sum(r.loss_tokens for r in b) <= 60 for b in bins.values()
    )
    n = Counter()
    for r in rows:
        n[r.doc_id] += r.loss_tokens
    full = {r.doc_id: r.doc_tokens for r in rows}
    assert all(n[i] == min(i % 50, full[i]) for i in range(400))


def test_packing_takes_the_largest_dot_product():
    """What goes in next is, of the examples that fit in all dimensions, the one of largest demand by what is left."""
    pool = packing.Pool(packing.Limits(tokens=100, segments=9, loss_tokens=50))
    pool.add([(i, b"", n) for i, n in enumerate((60, 50, 55))], [5, 45, 50])
    weight = np.array([55 / 100, 100 / 3 / 50])
    room, want, waiting = np.array([100, 50]), [], {0: (60, 5), 1: (50, 45), 2: (55, 50)}
    while fits := {i: d for i, d in waiting.items() if (np.array(d) <= room).all()}:
        best = max(fits, key=lambda i: (np.array(fits[i]) / (100, 50) * weight * room / (100, 50)).sum())
        want.append(best)
        room = room - waiting.pop(best)
    got = [i for i, start, k, _ in pool.fill(100) if start == 0 and k == (60, 50, 55)[i]]
    assert got[: len(want)] == want and want[0] == 2  # not the longest one


def test_share_behind_the_first_line(spark):
    d = spark.createDataFrame([("ab\ncdef",), ("one line",), ("",), (None,), ("\n",)], "text string")
    assert [
        round(r.s, 3) for r in d.select(packing.behind_first_line(F.col("text")).alias("s")).collect()
    ] == [round(1 - 3 / 7, 3), 1, 1, 1, 0]
    rows = packing.pack(
        spark.createDataFrame([(1, "ab ab\ncd cd cd")], "doc_id long, text string"), BYTE, loss_share=F.lit(0.5)
    ).collect()
    assert sum(r.loss_tokens for r in rows) == -(-rows[0].doc_tokens // 2)


def test_base_counts_by_brute_force(spark, odd):
    got = {(r.doc_id, r.text): r for r in quality_rules.base_counts(odd.withColumnRenamed("start", "_lines")).collect()}
    for r in odd.collect():
        t, x = r.text or "", got[(r.doc_id, r.text)]
        w = re.findall("[^\x20\x09-\x0D]+", t)
        lines = [q for q in t.split("\n") if q.strip(" \t\n\x0b\f\r")]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
    assert "_lines" in got[(3, "one")].asDict()


def test_log_likelihood_ratio_by_brute_force(spark):
    """Weights from bucket counts of both sides; a text's llr is the mean weight of its words and pairs."""
    texts = {1: "a b a c", 2: "c c d", 3: "a b", 4: None, 5: "z"}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    trusted = spark.createDataFrame([(1,), (3,), (3,), (None,)], "doc_id long")
    h = {w: r for w, r in ((r.w, r.h) for r in spark.createDataFrame([(w,) for w in "abcdz"], "w string").select("w", F.xxhash64("w").alias("h")).collect())}
    pair = spark.createDataFrame(
        [(a, b, h[a], h[b]) for a in h for b in h], "a string, b string, x long, y long"
    ).select("a", "b", (F.pmod(F.xxhash64("x", "y"), F.lit(32))).alias("k"))
    two = {(r.a, r.b): r.k for r in pair.collect()}
    grams = {i: [h[w] % 32 for w in (t or "").split()] + [two[x] for x in zip((t or "").split(), (t or "").split()[1:])] for i, t in texts.items()}
    raw, target = Counter(k for g in grams.values() for k in g), Counter(k for i in (1, 3) for k in grams[i])
    n, m, share = sum(raw.values()), sum(target.values()), sum(target.values()) / sum(raw.values())
    weight = {
        k: math.log((target[k] + 2) / (m + 64) / ((raw[k] + 2 / share) / (n + 2 / share * 32))) for k in range(32)
    }
    got = quality_rules.log_ratios(d, trusted, buckets=32, smoothing=2.0)
    assert all(math.isclose(r.weight, weight[r.bucket], abs_tol=1e-12) for r in got.collect())
    judged = quality_rules.judge(
        d.withColumnsRenamed({"doc_id": "p"}), got, keep=["p"], buckets=32, min_words=1, threshold=0.0
    ).collect()
    for r in judged:
        g = grams[r.p]
        want = sum(weight[k] for k in g) / len(g) if g else 0.0
        assert math.isclose(r.llr, want, abs_tol=1e-9) and r.kept == (bool(g) and want >= 0 and not r.base_failed)


@pytest.mark.parametrize("name", ["_row", "_hashes", "_words", "row", "own", "none", "p", "one", "_lines", "_placed"])
def test_quality_rules_keep_any_name(spark, name):
    d = spark.createDataFrame([(1, "a b", "mine")], f"doc_id long, text string, `{name}` string")
    w = quality_rules.log_ratios(d, d.limit(0), buckets=4)
    assert quality_rules.judge(d, w, keep=["doc_id", name], buckets=4).first()[name] == "mine"


def test_quality_rules(spark, odd, none):
    w = quality_rules.log_ratios(odd, odd.where("doc_id = 4"), buckets=256)
    assert w.count() == 256
    got = quality_rules.judge(odd, w, keep=["doc_id", "start", "words"], buckets=256).collect()
    assert len(got) == odd.count() and all(r.base_failed and not r.kept for r in got if r.n_words < 20)
    by = {r.doc_id: r for r in got}
    assert by[9].n_repeat_words == 6000 and by[4].n_words == 9 and by[5].word_chars == 4 and by[0].n_words == 0 and by[0].llr == 0
    assert quality_rules.judge(none, w, keep=["doc_id"], buckets=256).count() == 0
    assert quality_rules.judge(
        none, quality_rules.log_ratios(none, none, buckets=16), keep=["doc_id"], buckets=16
    ).count() == 0


def test_repeated_windows_by_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 60))) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.base_counts(d, window=4).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        c = Counter(tuple(w[k : k + 4]) for k in range(len(w) - 3))
        assert got[i] == len({x for k in range(len(w) - 3) if c[tuple(w[k : k + 4])] > 1 for x in range(k, k + 4)})


@pytest.mark.parametrize(
    "values", [[5], [0, 2**32 - 1], list(range(1000)), [7] * 4096, [3] * 90 + [10**6] * 2, [1, 2, 3, 49407] * 999]
)
def test_blocks_round_trip(values):
    a = np.array(values, "<u4")
    raw = token_blocks.encode_block(a)
    assert token_blocks.decode_block(memoryview(raw), len(a)).tolist() == values


def test_blocks_patch_outliers():
    a = np.array([1] * 4000 + [60000] * 20, "<u4")
    assert len(token_blocks.encode_block(a)) < 1200


def test_token_files(spark, odd, none, tmp_path):
    token_blocks.write_tokens(odd, str(tmp_path / "a"), WORD, end_id=2, shard_bytes=4000, least_bytes=1)
    rows = token_blocks.read_tokens(spark, str(tmp_path / "a"))
    assert rows.rdd.getNumPartitions() == spark.read.parquet(str(tmp_path / "a" / "manifest")).count() > 3  # a task for each file
    got = rows.orderBy("start").collect()
    want = Counter((r.doc_id, tuple(ids(WORD, r.text, 2))) for r in odd.collect())
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist() and got[0].doc_id is None
    assert [r.doc_id for r in got[1:]] == sorted(r.doc_id for r in odd.where("doc_id is not null").collect())
    token_blocks.write_tokens(none, str(tmp_path / "b"), WORD, end_id=2, shard_bytes=4000)
    assert token_blocks.read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_ranges(spark):
    """Every row has a range, in the order of the keys; a large key is spread, and partitions do not matter."""
    rng = np.random.default_rng(1)
    keys = [5] * 3000 + [None] * 1000 + [
        int(x) for x in rng.integers(-(2**63), 2**63 - 1, 2000)
    ] + [10**15 + int(x) for x in rng.integers(0, 5000, 3000)]
    d = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    found = []
    for n in (1, 7):
        r = common.ranges(d.repartition(n), F.col("k"), F.lit(10), 1000, fewest=1, cells=16)
        rows = d.repartition(n).withColumn("s", r.of(F.col("k"), F.xxhash64("i"))).collect()
        found.append({x.i: x.s for x in rows})
    assert found[0] == found[1] and len(found[0]) == len(keys)
    size = Counter(found[0].values())
    assert max(size.values()) <= 200 and min(size) == 0 and max(size) == r.count - 1 and len(size) > 0.8 * r.count
    order = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or 0, found[0][i]))
    assert [found[0][i] for i in order] == sorted(found[0].values())


def test_every_letter_before_every_tail():
    """A letter that ends in a mark when it is normalised shares a pre-token with what follows."""
    letters = [
        chr(c)
        for c in range(0x80, 0x30000)
        if chr(c).isalpha() and (len(unicodedata.normalize("NFC", chr(c)).lower()) > 1 or c % 97 == 0)
    ]
    texts = [f"a{x}{t}" for x in [*letters, "é", "\u0130", "\u0958"] for t in encoding._TAIL]
    assert len(letters) > 60
    for path, spaced in ((WORD, False), (BYTE, True)):
        t = Tokenizer.from_file(path)
        want = [np.array([*e.ids, 1], "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
        assert encoding.Encoder(path, 1, spaced).encode(texts) == want


def test_damaged_token_file(spark, odd, tmp_path):
    files = token_blocks.write_tokens(odd, str(tmp_path), WORD, end_id=2, shard_bytes=1 << 30).collect()
    p = tmp_path / files[0].file
    raw = bytearray(p.read_bytes())
    raw[-45] ^= 255
    p.write_bytes(bytes(raw))
    with pytest.raises(Exception, match="damaged"):
        token_blocks.read_tokens(spark, str(tmp_path)).collect()


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(texts, items, size):
    windows = {}
    for i, t in items:
        w = WORDS.findall((t or "").translate(LOWER))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    for t in texts:
        w, hit, found = WORDS.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= x - {None}
        yield len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, odd, none, block_bytes):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "B", "é", "c9"], rng.integers(0, 40))) for _ in range(80)]
    items = [
        ("x", "a b é"), ("y", "B"), ("z", "c9 c9 a b é a"), ("w", None), ("v", ""), ("u", "a b é"), (None, "é é a a")
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {
        r.doc_id: r.contamination for r in decontaminate.mark(docs, bench, window=4, block_bytes=block_bytes).collect()
    }
    for i, (n, h, found) in enumerate(hits(texts, items, 4)):
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (n, h, found)
    kept = decontaminate.remove_contaminated(docs, bench, window=4, block_bytes=block_bytes)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {
        i for i, (n, h, _) in enumerate(hits(texts, items, 4)) if not (h and 20 * h >= n)
    }
    assert decontaminate.mark(odd, bench.limit(0)).where("contamination.n_hit > 0").count() == 0
    assert decontaminate.remove_contaminated(none, bench).count() == 0 and decontaminate.mark(odd, bench).count() == odd.count()


def test_longest_match(spark):
    docs = spark.createDataFrame([(1, "q b c d e f q")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d e f g")], "item_id long, text string")
    s = decontaminate.mark(docs, bench, window=3).first().contamination.spans
    assert [(x.doc_start, x.words, x.item_id, x.item_start) for x in s] == [(1, 5, "7", 1)]


def longest(text, items, least):
    """item -> (first word, words) of the longest match; of equal ones the one on the smallest diagonal."""
    w, want = text.split(), {}
    for name, t in items.items():
        u = t.split()
        found = []
        for p, j in itertools.product(range(len(w)), range(len(u))):
            k = 0
            while p + k < len(w) and j + k < len(u) and w[p + k] == u[j + k]:
                k += 1
            if k >= least:
                found.append((-k, p - j, p))
        if found:
            k, _, p = min(found)
            want[name] = p, -k
    return want


@pytest.mark.parametrize("held", [1, 7, 10**6])
def test_longest_matches_of_random_words(monkeypatch, held):
    """Repeated words, several documents in a shard, shares that divide a position's places; a worker's copy of the arrays."""
    monkeypatch.setattr(decontaminate, "HELD", held)
    rng = random.Random(held)
    for _ in range(40):
        letters = "ab" if rng.random() < 0.5 else "abcde"
        items = {f"i{k}": " ".join(rng.choices(letters, k=rng.randint(3, 14))) for k in range(4)}
        texts = [" ".join(rng.choices(letters + "z", k=rng.randint(0, 30))) for _ in range(5)] + ["a " * 12]
        w = pickle.loads(pickle.dumps(decontaminate.Windows([(k, v.encode()) for k, v in items.items()], 3)))
        for text, got in zip(texts, decontaminate._scan(w, [t.encode() for t in texts])):
            assert {s["item_id"]: (s["doc_start"], s["words"]) for s in got["spans"]} == longest(text, items, 3)


def test_long_texts_of_one_repeated_word():
    """4e8 pairs of places, of which only the ends of matches are held."""
    many = 20_000
    w = decontaminate.Windows([("i", b"the " * many)], 13)
    (got,) = decontaminate._scan(w, [b"x " + b"the " * many])
    assert got["n_hit"] == many and got["spans"] == [{"doc_start": 1, "words": many, "item_id": "i", "item_start": 0}]


@pytest.mark.parametrize("block_bytes", [1 << 20, 30])
def test_longest_match_of_each_item(spark, monkeypatch, block_bytes):
    """Also where items share windows: every item's longest match, its first place, by brute force."""
    monkeypatch.setattr(decontaminate, "HELD", 5)
    docs = spark.createDataFrame([(1, "x a b c d e f y"), (2, "a b c a b c"), (3, None)], "doc_id long, text string")
    items = {"A": "a b c", "B": "a b c d e f", "C": "q c a b c d"}
    bench = spark.createDataFrame([*items.items(), (None, "e f y")], "item_id string, text string")
    for r in decontaminate.mark(docs, bench, window=3, block_bytes=block_bytes).collect():
        w, want = (r.text or "").split(), {}
        for name, t in items.items():
            u = t.split()
            for p, j in itertools.product(range(len(w)), range(len(u))):
                n = next(
                    (k for k in range(min(len(w) - p, len(u) - j)) if w[p + k] != u[j + k]), min(len(w) - p, len(u) - j)
                )
                if n >= 3 and n > want.get(name, (0, 0))[1]:
                    want[name] = (p, n)
        assert {x.item_id: (x.doc_start, x.words) for x in r.contamination.spans} == want
        assert r.contamination.n_hit == {1: 7, 2: 6, 3: 0}[r.doc_id]


def test_warc_round_trip(spark, none, tmp_path):
    pages = [
        (1, "http://a/1", "same"),
        (2, "http://a/2", "same"),
        (3, None, None),
        (4, "http://a/4", ""),
        (5, "u\r\nX: y", "é\r\n\r\n" * 400),
        (9, "http://a/9", "same"),
        (None, "n", "same"),
        (9, "http://a/9", "same")
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    for name in ("a", "b"):
        warc.write_warc(df, str(tmp_path / name), shard_bytes=2500, roll_bytes=300, least_bytes=1)
    got = warc.read_warc(spark, str(tmp_path / "a")).collect()
    kind = Counter((r.key, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in got)
    assert kind == Counter(
        [
            (None, "revisit", 9),
            (1, "revisit", 9),
            (2, "revisit", 9),
            (3, "revisit", 4),
            (4, "response", None),
            (5, "response", None),
            (9, "response", None),
            (9, "response", None)
        ]
    )
    assert {
        r.key: r.payload for r in got if r.record_type == "response"
    } == {4: b"", 5: ("é\r\n\r\n" * 400).encode(), 9: b"same"}
    names = sorted(p.name for p in (tmp_path / "a").glob("*.gz"))
    assert names == sorted(p.name for p in (tmp_path / "b").glob("*.gz")) and all(
        (tmp_path / "a" / n).read_bytes() == (tmp_path / "b" / n).read_bytes() for n in names
    )
    assert not [p for p in (tmp_path / "a").iterdir() if p.name.startswith(".part")]
    warc.write_warc(df.limit(0), str(tmp_path / "c"))
    assert warc.read_warc(spark, str(tmp_path / "c")).count() == 0


def brute_components(fps, radius):
    up = {i: i for i in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(fps)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


@pytest.mark.parametrize("most", [1024, 8])
def test_simhash_links_all(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST", most)
    rng = np.random.default_rng(2)
    near = [
        (0x0123456789ABCDEF ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)))
        for _ in range(120)
    ]
    fps = dict(enumerate([*near, *(int(x) for x in rng.integers(0, 2**63, 300))]))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = {}
    for i, f in fps.items():
        rows.setdefault(signed(f), i)
    found = {
        rows[r.node]: r.component
        for r in components.connected_components(
            simhash.links(spark.createDataFrame([(f,) for f in rows], "fp long"), 4)
        ).collect()
    }
    want = brute_components({i: fps[i] for i in rows.values()}, 4)
    same = lambda of: {frozenset(k for k in want if of(k) == of(i)) for i in want}
    assert same(lambda i: found.get(i, ("alone", i))) == same(lambda i: want[i])


def test_simhash_on_odd_rows(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count() and {r.component_id for r in got if r.fp == 0} == {0}
    assert {r.component_id for r in got if r.doc_id in (7, 8)} == {7}
    kept = near_copies.keep_one(odd)
    assert kept.columns == odd.columns and Counter(
        r.doc_id for r in kept.collect()
    ) == Counter([None, 0, 3, 4, 5, 6, 7, 9, 10])
    assert simhash.near_duplicates(none).count() == 0 and near_copies.keep_one(none).count() == 0


@pytest.mark.parametrize("part,sets,size", [(8192, 2048, 1 << 20), (8, 4, 300)])
def test_similar_sets_by_brute_force(spark, monkeypatch, part, sets, size):
    """Every pair at 0.8 or more is linked, none below: short and long texts, chains, a large group, repeated lines."""
    import corpus_pipeline

    for name, value in (("PART", part), ("SETS", sets), ("HASHES", size)):
        monkeypatch.setattr(near_copies, name, value)
    rng = np.random.default_rng(8)
    texts = [
        "a b c d e f g h",
        "a b c d e f g h i",
        "A b c\td e f g h i",
        "x y",
        "x  Y",
        "",
        None,
        "same line of five words\n" * 9 + "and then some more"
    ]
    for size in (30, 60, 200):
        for base in range(4):
            words = [f"w{i}" for i in rng.integers(0, 5000, size)]
            for _ in range(40 if base else 100):
                one = list(words)
                for at in rng.integers(0, size, rng.integers(0, max(2, size // 20))):
                    one[at] = f"n{rng.integers(0, 10**6)}"
                texts.append(" ".join(one[rng.integers(0, 3) : size - rng.integers(0, size // 6)]))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = np.array([[(not a and not b) or 9 * len(a & b) >= 4 * (len(a) + len(b)) for b in sets] for a in sets])
    want = np.arange(len(texts))
    for _ in texts:
        want = np.where(near, want[None], len(texts)).min(axis=1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {
        r.doc_id: r.component_id for r in near_copies.similar(docs, 0.8).collect()
    } == dict(enumerate(want.tolist()))
    assert 20 < len(set(want.tolist())) < len(texts) / 2
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(want.tolist())


def test_similar_on_odd_rows(spark, odd, none):
    kept = near_copies.keep_one(odd, similarity=0.8)
    assert kept.columns == odd.columns and Counter(
        r.doc_id for r in kept.collect()
    ) == Counter([None, 0, 3, 4, 5, 6, 7, 9, 10])
    assert near_copies.similar(none).count() == 0 and near_copies.keep_one(none, similarity=0.8).count() == 0


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_rows_of_one_id_are_judged_each(spark, similarity):
    """Equal ids with different texts: only a row that resembles another goes. Helper names as a user's columns."""
    words = lambda k: " ".join(f"{k}{i}" for i in range(40))
    rows = [
        (5, words("a"), 1, 2),
        (5, words("b"), 1, 2),
        (6, words("b"), 1, 2),
        (7, words("a"), 3, 4),
        (5, words("b"), 1, 2)
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, _chosen int, _nth int")
    got = near_copies.keep_one(d, similarity=similarity)
    assert got.columns == d.columns
    assert sorted(map(tuple, got.collect())) == sorted([(5, words("a"), 1, 2), (5, words("b"), 1, 2)])


def test_a_dense_group_is_compared_in_tiles(spark):
    """Many texts that are near but not at 0.8: no pair of them leaves a task, and the few at 0.8 are found."""
    rng = np.random.default_rng(4)
    base, texts = [f"w{i}" for i in range(60)], []
    for k in range(300):
        one = list(base)
        for at in rng.choice(60, 2, replace=False):
            one[at] = f"x{k}"
        texts.append(" ".join(one))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    near = np.array([[9 * len(a & b) >= 4 * (len(a) + len(b)) for b in sets] for a in sets])
    want = np.arange(len(texts))
    for _ in texts:
        want = np.where(near, want[None], len(texts)).min(axis=1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {
        r.doc_id: r.component_id for r in near_copies.similar(docs, 0.8).collect()
    } == dict(enumerate(want.tolist()))


def test_common_by_brute_force():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 9000, n).astype(np.int64)) for n in (0, 1, 50, 300, 5000, 5000)]
    for pairs in (np.array([[i, j] for i in range(6) for j in range(6)]), np.array([[4, 5]])):
        assert near_copies.common(sets, sets, pairs).tolist() == [len(set(sets[i]) & set(sets[j])) for i, j in pairs]


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_hidden_markov_model(spark, none):
    rng = np.random.default_rng(4)
    kinds = [["le", "la", "un", "chat"], ["the", "a", "an", "cat"]]
    texts = [" ".join(rng.choice(kinds[i % 2], rng.integers(0, 30))) for i in range(60)]
    d = spark.createDataFrame([*enumerate(texts), (60, None), (61, "Unseen le")], "doc_id long, text string")
    shape = hmm_lm.Shape(states=3, frequent=4, classes=4, cached=6, cells=64)
    rows = hmm_lm.language_model(d, F.col("doc_id") % 5 != 0, shape).collect()
    words = {r.doc_id: [*(r.text or "").translate(LOWER).split(), "\n"] for r in d.collect()}
    c = Counter(w for i, ws in words.items() if i % 5 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in rows:
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            r.doc_id % 5 == 0, len(ws), sum(c[w] > 0 for w in ws), n
        )
        assert math.isclose(
            r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9
        ) and math.isfinite(r.score) and r.score < 0
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert hmm_lm.language_model(none, F.lit(True), shape).count() == 0
    assert hmm_lm.language_model(d, F.lit(None).cast("boolean"), shape).where("n_known = 0").count() == d.count()


def test_forward_is_exact_and_sums_to_one():
    rng = np.random.default_rng(1)
    t = hmm_lm.Tables(rng.random(2), rng.random((2, 2)), rng.random((3, 2))).normalised()
    every = [np.array([a, b, c]) for a in range(3) for b in range(3) for c in range(3)]
    p = 10 ** hmm_lm.forward(t, every)
    assert math.isclose(p.sum(), 1.0)
    for s, x in zip(every, p):
        paths = [(i, j, k) for i in range(2) for j in range(2) for k in range(2)]
        assert math.isclose(x, sum(t.start[i] * t.emit[s[0], i] * t.move[i, j] * t.emit[s[1], j] * t.move[j, k] * t.emit[s[2], k] for i, j, k in paths))
    ll = []
    for _ in range(4):
        new, x = hmm_lm.expected(t, every)
        ll.append(x)
        t = hmm_lm.Tables(
            new.start / new.start.sum(), new.move / new.move.sum(axis=1, keepdims=True), new.emit / new.emit.sum(axis=0)
        )
    assert all(b >= a - 1e-9 for a, b in zip(ll, ll[1:]))


def test_baum_welch_over_whole_texts():
    """Counts equal those of every path, whatever the texts' lengths and however long texts are cut on the way."""
    rng = np.random.default_rng(2)
    t = hmm_lm.Tables(rng.random(2), rng.random((2, 2)), rng.random((4, 2))).normalised()
    texts = [rng.integers(0, 4, n) for n in (1, 7, 3, 9, 2, 9, 0)]
    start, move, emit, ll = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2)), 0.0
    for x in texts[:-1]:
        paths = list(itertools.product(range(2), repeat=len(x)))
        p = np.array(
            [
                t.start[z[0]] * np.prod(
                    [t.move[a, b] for a, b in zip(z, z[1:])]
                ) * np.prod([t.emit[s, q] for s, q in zip(x, z)])
                for z in paths
            ]
        )
        ll += math.log(p.sum())
        for z, w in zip(paths, p / p.sum()):
            start[z[0]] += w
            for a, b in zip(z, z[1:]):
                move[a, b] += w
            for s, q in zip(x, z):
                emit[s, q] += w
    for cells in (1, 4, 20, 1000):
        got, l = hmm_lm.expected(t, texts, cells)
        assert np.allclose(got.start, start) and np.allclose(got.move, move) and np.allclose(got.emit, emit) and math.isclose(l, ll)


def test_language_models(spark, odd, none):
    text = {
        "en": "the cat sat on the mat and the dog ran",
        "de": "die katze und der hund sind nicht auf dem dach",
        "fr": "le chat est sur la table avec les chiens",
    }
    d = spark.createDataFrame(
        [(i, " ".join(np.random.default_rng(i).permutation(t.split())), k) for i in range(20) for k, t in text.items()],
        "doc_id long, text string, lang string",
    )
    model = langid.train(d.where("doc_id < 15"))
    got = langid.identify(d.where("doc_id >= 15"), model, keep=["lang"]).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)
    rows = langid.identify(odd, model, keep=["doc_id", "start", "words"]).collect()
    assert len(rows) == odd.count() and {r.lang_pred for r in rows if r.doc_id in (0, 1, 2)} == {"und"}
    assert langid.identify(none, model, keep=["doc_id"]).count() == 0
    unknown = langid.identify(odd, langid.train(none), keep=["doc_id"]).collect()
    assert len(unknown) == odd.count() and {
        (r.lang_pred, r.score, r.accepted) for r in unknown
    } == {("und", 0.0, False)}
    assert {
        r.lang_pred
        for r in langid.identify(
            odd, langid.train(odd.withColumn("lang", F.lit(None).cast("string"))), keep=["doc_id"]
        ).collect()
    } == {"und"}
    clash = langid.identify(odd.withColumnRenamed("words", "_text"), model, keep=["doc_id", "_text"]).collect()
    assert {r["_text"] for r in clash} == {"w", None}


def plain_kneser_ney(texts, order=4):
    """log P(c | before) of interpolated Kneser-Ney, by dictionaries; before: a tuple of order - 1 codes."""
    counts = {order: Counter()}
    for t in texts:
        for w in t.lower().split():
            codes = [langid.BORDER] * (order - 1) + [ord(c) + 3 for c in w] + [langid.BORDER]
            for i in range(order - 1, len(codes)):
                counts[order][tuple(codes[i - order + 1 : i + 1])] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    d = {n: (sum(x == 1 for x in c.values()) + 0.5) / (sum(x == 1 for x in c.values()) + 2 * sum(x == 2 for x in c.values()) + 1) for n, c in counts.items()}
    return counts, d


def plain_probability(counts, d, vocabulary, gram):
    p = 1 / vocabulary
    for n in range(1, len(gram) + 1):
        own = gram[len(gram) - n :]
        same = {g: c for g, c in counts[n].items() if g[:-1] == own[:-1]}
        if same:
            total = sum(same.values())
            p = max(counts[n][own] - d[n], 0) / total + d[n] * len(same) / total * p
    return p


def test_kneser_ney_by_brute_force(spark):
    """Every conditional probability equals that of the plain model, and each language's sum to one, also when n-grams are pruned."""
    texts = {"xx": ["abba baba ab", "aab bab abab b éa"], "yy": ["cab bac acca", "cc c abc"]}
    d = spark.createDataFrame(
        [(i, t, k) for k, ts in texts.items() for i, t in enumerate(ts)], "doc_id long, text string, lang string"
    )
    symbols = [langid.BORDER, *(ord(c) + 3 for c in "abcé"), ord("z") + 3]  # z stands for what is unseen
    contexts = [c for c in itertools.product(symbols, repeat=3)][::7]
    codes = np.array([[*c, s] for c in contexts for s in symbols])
    model = langid.train(d)
    got = np.exp(model.log_probability(codes))
    for j, lang in enumerate(model.langs):
        counts, discounts = plain_kneser_ney(texts[lang])
        want = [plain_probability(counts, discounts, 6, tuple(map(int, c))) for c in codes]
        assert np.allclose(got[:, j], want, rtol=1e-4)
    assert np.allclose(got.reshape(len(contexts), 6, 2).sum(axis=1), 1, atol=1e-5)
    pruned = langid.train(d, most=20)
    assert max(len(k) for k, _ in pruned.seen.values()) <= 10 < max(len(k) for k, _ in model.seen.values())
    assert np.allclose(np.exp(pruned.log_probability(codes)).reshape(len(contexts), 6, 2).sum(axis=1), 1, atol=1e-5)


def test_factorisation_machine_identity():
    rng = np.random.default_rng(0)
    m = quality_fm.Machine(5, 0.3, rng.normal(size=7), rng.normal(size=(7, 3)), np.zeros(2), np.ones(2))
    x = rng.normal(size=7)
    pairs = sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for i in range(7) for j in range(i))
    assert math.isclose(m.score(np.arange(7), x, np.zeros(7, int), 1)[0], 0.3 + m.linear @ x + pairs)


def test_quality_classifier(spark, odd, none):
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(["the", "cat", "sat", "down"], 30)) for _ in range(80)]
    bad = [" ".join(w + "$$$" for w in rng.choice(["the", "cat", "sat", "down"], 30)) for _ in range(80)]
    d = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    y = spark.createDataFrame(
        [(i, int(i < 80), None) for i in range(160)] + [(None, 1, 0), (3, None, 0), (3, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    m = quality_fm.train(d, y.where("doc_id % 4 <> 2"))
    p = {r.doc_id: r.predicted for r in quality_fm.score(d, m, keep=["doc_id"]).collect()}
    assert all(p[i] == int(i < 80) for i in range(160))
    rows = quality_fm.score(odd.withColumn("score", F.lit("x")), m, keep=["doc_id", "score", "lang"]).collect()
    assert len(rows) == odd.count() and all(
        0 <= r.score <= 1 for r in rows
    ) and quality_fm.score(none, m, keep=["doc_id"]).count() == 0
    assert all(
        abs(r.score - 0.5) < 1e-9
        for r in quality_fm.score(odd, quality_fm.train(odd, y.limit(0)), keep=["doc_id"]).collect()
    )


def test_metadata_decides(spark):
    """Texts alike, told apart by a metadata column alone; a null value is 0."""
    d = spark.createDataFrame(
        [(i, "same words here", float(i % 2), "x") for i in range(200)] + [(200, "same words here", None, "x")],
        "doc_id long, text string, size double, _meta string",
    )
    y = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, quality int")
    meta = (F.col("size"),)
    rows = quality_fm.score(
        d, quality_fm.train(d, y, meta=meta), keep=["doc_id", "_meta"], meta=meta, threshold=0.5
    ).collect()
    assert all(r.predicted == (r.doc_id % 2 if r.doc_id < 200 else 0) and r["_meta"] == "x" for r in rows)


def test_line_dedup_in_blocks_with_white_space(spark):
    """Lines equal but for white space around them are one; several blocks of hashes; helper names as a user's columns."""
    rows = [(i, f"a b c d{' ' * (i % 2)}\t\r\nown {i} x y\n  q r s t\n\x1ca b c d", f"s{i}", i, i) for i in range(9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, _gone int, _row int")
    got = line_dedup.remove_boilerplate(d, min_sites=9, counts=True, block_lines=1).orderBy("doc_id").collect()
    assert [(r.text, r.n_lines, r.n_removed) for r in got] == [(f"own {i} x y", 4, 3) for i in range(9)]
    assert all(r["_gone"] == r["_row"] == r.doc_id for r in got)


def test_line_dedup(spark, odd, none):
    rows = [
        (i, f"common line of four words\nown {i} line is here now\nshort one", f"s{i % 9}") for i in range(18)
    ] + [(99, "common line of four words", "s1"), (100, None, None), (101, "common line of four words", None)]
    d = spark.createDataFrame(
        rows, "doc_id long, text string, source string"
    ).withColumn("n_chars", F.length("text").cast("int"))
    got = {r.doc_id: r for r in line_dedup.remove_boilerplate(d, min_sites=9, min_words=4, counts=True).collect()}
    assert got[0].text == "own 0 line is here now\nshort one" and got[0].n_chars == len(got[0].text) and (
        got[0].n_lines, got[0].n_removed
    ) == (3, 1)
    assert got[99].text == "" and got[100].text is None and got[101].text == "" and len(got) == 21
    assert line_dedup.remove_boilerplate(d, min_sites=10).where("text like '%common%'").count() == 20
    same = line_dedup.remove_boilerplate(odd)
    assert same.columns == odd.columns and Counter(
        map(tuple, same.collect())
    ) == Counter(map(tuple, odd.collect())) and line_dedup.remove_boilerplate(none).count() == 0


def test_exact_counts_near_the_threshold(spark):
    rows = [(f"line number {k} goes over sites", f"s{j}") for k in range(4) for j in range(48 + k)]
    d = spark.createDataFrame(rows, "text string, source string")
    got = line_dedup.boilerplate(d, min_sites=50, lg_k=5).collect()
    assert sorted(r.sites for r in got) == [50, 51] and all(r.exact for r in got)
