"""The ten queries themselves, on whole small tables: their parameters, columns and digests against plain computations."""

import hashlib
import inspect
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from quarrylight.llm import queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encoded(name, texts, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, end] for i, x in texts.items()}


def test_every_registered_name_is_a_query():
    """op11, which gives the SQL of op11_vector_codes, is none."""
    found = queries.queries()
    assert all(list(inspect.signature(f).parameters) == ["spark", "sf_dir"] for f in found.values())
    assert len(found) == 14 and queries.oracle_sql().keys() <= found.keys()


def test_op1(spark, docs):
    ids = encoded("byte_bpe_50k.json", {i: r.text for i, r in docs.items()}, 1)
    rows = queries.op1_vector_packing(spark, SF).collect()
    at = Counter()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == crc(
            ids[r.doc_id][r.start : r.start + r.length]
        )
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    size = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == size[r.sequence_id]
        size[r.sequence_id] += r.length
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in size.values())
    assert max(size.values()) <= 2048 and padding < 0.01 * sum(size.values())


def test_op2(spark, docs):
    rows = {r.doc_id: r for r in queries.op2_ngram_likelihood(spark, SF).collect()}
    assert set(rows) == set(docs)
    for i, r in rows.items():
        t = docs[i].text or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = len({x for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for x in range(k, k + 8)})
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), again)
        assert r.base_failed == (len(w) < 20 or 100 * again > 30 * len(w)) and not (r.base_failed and r.kept)


def test_op3(spark, docs):
    ids = encoded("word_bpe_49k.json", {i: r.text for i, r in docs.items()}, 2)
    at = 0
    for r in queries.op3_token_blocks(spark, SF).orderBy("doc_id").collect():
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]), crc(ids[r.doc_id]))
        at += r.n_tokens
    assert at == sum(map(len, ids.values()))


def test_op4(spark, docs):
    item_word = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = re.findall(item_word, (r.text or "").translate(LOWER))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(r.item_id))
    lengths = {len(x) for x in windows}
    for r in queries.op4_suffix_decontamination(spark, SF).collect():
        w, hit, items = re.findall(item_word, (docs[r.doc_id].text or "").translate(LOWER)), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    items |= found
        want = (
            len(w),
            len(hit),
            len(items),
            hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
            bool(hit) and 20 * len(hit) >= len(w),
        )
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want


def test_op5(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    last = {}
    for i, x in pages.items():
        last[x] = max(last.get(x, i), i)
    import base64

    rows = queries.op5_warc_shards(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        x = pages[r.page_id]
        own = last[x] == r.page_id
        assert (r.payload_bytes, r.payload_digest) == (len(x), base64.b32encode(hashlib.sha1(x).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if own else ("revisit", last[x]))


def test_op6(spark, docs):
    prints = {}
    for i, r in docs.items():
        w = words((r.text or "").translate(LOWER))
        grams = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    up = {i: i for i in prints}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    order = sorted(prints)
    for n, i in enumerate(order):
        for j in order[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash_tiles(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", root(i)) for i in prints}


def test_op7(spark, docs):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    tokens = {i: [*words((r.text or "").translate(LOWER)), "\n"] for i, r in docs.items()}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    rows = queries.op7_hidden_markov_lm(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n
        )
        assert abs(
            r.base_score - sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        ) < 1e-6 * max(1, abs(r.base_score))
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_op8(spark, docs):
    rows = queries.op8_kneser_ney_langid(spark, SF).collect()
    assert len(rows) == len(docs) and all(
        r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows
    )
    langs = {r.lang for r in docs.values() if r.lang is not None}
    has_letter = {i: any(ch.isalpha() for ch in r.text or "") for i, r in docs.items()}
    assert all(r.lang_pred in langs if has_letter[r.doc_id] else r.lang_pred == "und" for r in rows)
    judged = [
        r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out and has_letter[r.doc_id] and docs[r.doc_id].lang
    ]
    assert len(judged) > 20 and np.mean(judged) > 0.95


def test_op9(spark, docs):
    rows = queries.op9_factorisation_quality(spark, SF).collect()
    assert len(rows) == len(docs)
    assert all(
        r.held_out == (
            zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        ) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        for r in rows
    )


def test_op10(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.op10_line_dedup(spark, SF)
    want = c.execute(queries.OP10).fetchall()
    assert sorted(
        map(repr, map(tuple, got.select(*[x[0] for x in c.description]).collect()))
    ) == sorted(map(repr, want))
