"""Vector codes, periodic runs and license scans against plain computations, with odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from quarrylight.llm import license_scan, periodic_runs, queries, vector_codes

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VECTOR = "vec_id long, embedding array<float>, label int, `a.b` string, code string"


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def plain_books(vectors, parts=8, entries=16, rounds=6):
    """Codebooks, codes and errors of whole numbers, by loops over parts and entries."""
    x = np.array(vectors, object).reshape(len(vectors), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        code, far = np.zeros(x.shape[:2], int), np.zeros(x.shape[:2], object)
        for i in range(len(x)):
            for p in range(parts):
                d = [sum((a - b) ** 2 for a, b in zip(x[i, p], c)) for c in books[p]]
                code[i, p], far[i, p] = d.index(min(d)), min(d)
        return code, far

    for _ in range(rounds):
        code, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = [x[i, p] for i in range(len(x)) if code[i, p] == e]
                if own:
                    books[p, e] = [sum(c) // len(own) for c in zip(*own)]
    code, far = assign()
    return books, ["".join(f"{c:02x}" for c in r) for r in code], far.sum(axis=1)


def test_op11_query(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = sorted(map(tuple, queries.op11_vector_codes(spark, SF).collect()))
    assert got == sorted(c.execute(queries.op11()).fetchall()) and len(got) > 100


def test_vector_codes(spark):
    """Null and odd vectors go, repeated rows and null ids and labels stay, and blocks do not matter."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=16).astype(np.float32)], int(i) % 3 or None, "x", "y") for i in range(60)]
    rows += [rows[5], rows[5], (None, rows[7][1], 1, None, None)]
    odd = [(900, None, 1, "", ""), (1, [float("nan")] * 16, 1, "", ""), (2, [None] + [0.5] * 15, 1, "", ""), (3, [float("inf")] * 16, None, "", "")]
    df = spark.createDataFrame(rows + odd, VECTOR).repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want, codes, errors = plain_books([[int(np.floor(4096 * float(v))) for v in r[1]] for r in order])
    books = vector_codes.train(df)
    assert (books == want.astype(np.int64)).all()
    got = vector_codes.encode(df, books, keep=["vec_id", "a.b", "label", "code"], code_col="code").collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted([(r.vec_id, r.code, r.error) for r in got], key=key) == sorted(zip([r[0] for r in order], codes, errors), key=key)
    assert got[0]["a.b"] in ("x", None)
    told = vector_codes.with_total(vector_codes.encode(df, books, keep=["vec_id", "label"]), "label", "error", "sum").collect()
    total = {}
    for r in told:
        total[r.label] = total.get(r.label, 0) + r.error
    assert len(told) == len(rows) and all(r.sum == total[r.label] for r in told)


def test_vector_codes_small_groups(spark, monkeypatch):
    """Totals of groups on either side of the broadcast's share."""
    monkeypatch.setattr(vector_codes, "SHARE", 3)
    df = spark.createDataFrame([(i, None if i < 30 else i // 3, i) for i in range(60)], "id long, g int, v long")
    total = {}
    for r in df.collect():
        total[r.g] = total.get(r.g, 0) + r.v
    got = vector_codes.with_total(df, "g", "v", "t").collect()
    assert len(got) == 60 and all(r.t == total[r.g] for r in got)


def test_vector_codes_empty_and_unequal(spark):
    none = spark.createDataFrame([], VECTOR)
    assert vector_codes.train(none) is None and not vector_codes.encode(none, None, keep=["vec_id"]).collect()
    few = spark.createDataFrame([(i, [float(i)] * 8, 1, "", "") for i in range(3)], VECTOR)
    books = vector_codes.train(few)
    assert books.shape == (8, 3, 1)
    assert [r.code for r in vector_codes.encode(few, books, keep=["vec_id"]).orderBy("vec_id").collect()] == [f"{i:02x}" * 8 for i in range(3)]
    with pytest.raises(ValueError):
        vector_codes.train(spark.createDataFrame([(1, [1.0] * 9, 1, "", "")], VECTOR))


def plain_runs(w, least):
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, size, q) for (s, size), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(7)
    for _ in range(1500):
        texts = []
        for _ in range(rng.randint(1, 3)):
            x = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 60))]
            if len(x) > 4 and rng.random() < 0.5:
                a, p = rng.randrange(len(x)), rng.randint(1, 9)
                x = [x[i] if i < a else x[min(a + (i - a) % p, len(x) - 1)] for i in range(len(x))]
                x += x[: rng.randrange(len(x))]
            texts.append(x)
        least = rng.choice([2, 3, 5, 12])
        names = np.array([d * 100 + v for d, x in enumerate(texts) for v in x], np.int64)
        assert list(map(tuple, periodic_runs.runs(names, least).tolist())) == plain_runs(names.tolist(), least)


@pytest.mark.parametrize("w", ["a" * 40, "ab" * 30, "aab" * 20 + "aab" * 20, "abcabd" * 9, "abaababaabaab" * 4])
def test_runs_of_known_words(w):
    names = np.array([ord(c) for c in w], np.int64)
    assert list(map(tuple, periodic_runs.runs(names, 12).tolist())) == plain_runs(w, 12)


def test_op12_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows, some = queries.op12_periodic_runs(spark, SF).collect(), 0
    assert len(rows) == len(docs)
    for r in rows:
        w, h = words(docs[r.doc_id]), zlib.crc32(str(r.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = plain_runs(w, 12)
        gone = {i for s, size, q in found for i in range(s + q, s + size)}
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else None
        lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert tuple(r)[1:] == (
            len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest(),
        )
        some += bool(found)
    assert some > 10


def test_find_runs_of_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, clashing and dotted names, an empty table."""
    long = " ".join(f"w{i % 7_001}" for i in range(300_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n ", "x"), (4, "a b " * 6, "x"), (4, "a b " * 6, "x"), (5, long, None), (None, "é " * 12, "y")]
    df = spark.createDataFrame(rows, "id long, text string, `we.ird` string").selectExpr("*", "1 AS repetition", "2 AS found", "3 AS own")
    got = periodic_runs.find_runs(df)
    assert sorted(got.columns) == sorted(df.columns)
    by = {}
    for r in got.collect():
        by.setdefault(r.id, []).append(r.repetition)
    assert all(not by[i][0].runs and by[i][0].collapsed == "" and by[i][0].n_words == 0 for i in (1, 2, 3))
    assert len(by[4]) == 2 and by[4][0] == by[4][1] and tuple(by[4][0].runs[0]) == (0, 12, 2) and by[4][0].collapsed == "a b"
    assert [tuple(x) for x in by[5][0].runs] == [(0, 300_000, 7_001)] and len(words(by[5][0].collapsed)) == 7_001
    assert by[None][0].collapsed == "é"
    assert not periodic_runs.find_runs(df.limit(0)).collect()


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_places(w, phrases):
    return sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def test_op13_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows, gpl = queries.op13_license_votes(spark, "/root/testdata/sf0.01").collect(), 0
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id] or ""
        w = WORD.findall(text.translate(LOWER))
        at = plain_places(w, license_scan.PHRASES)
        base = sorted({label for _, label in at})
        assert tuple(r)[1:6] == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(base))
        more = ["gpl-3"] if "GNU General Public License, version 3" in text else []
        gpl += bool(more)
        assert r.labels == ",".join(sorted({*base, *more})) and r.score == (1.0 if base or more else 0.0)
    assert gpl > 3


def plain_spans(text, templates, k, drift, least):
    """Spans by loops: votes, diagonals, neighbouring diagonals, coverage, and the best of those that overlap."""
    w, found = WORD.findall(text.translate(LOWER)), []
    for label, t in templates:
        t = WORD.findall(t.translate(LOWER))
        votes = sorted((i - j, i, j) for i in range(len(w) - k + 1) for j in range(len(t) - k + 1) if w[i : i + k] == t[j : j + k])
        groups = []
        for v in votes:
            if groups and v[0] - groups[-1][-1][0] <= drift:
                groups[-1].append(v)
            else:
                groups.append([v])
        for g in groups:
            covered = len({x for _, _, j in g for x in range(j, j + k)})
            if covered / len(t) >= least:
                first, end = min(i for _, i, _ in g), max(i for _, i, _ in g) + k
                found.append((first, end, label, covered, covered / len(t)))
    found.sort()
    islands = []
    for s in found:
        if islands and s[0] < max(x[1] for x in islands[-1]):
            islands[-1].append(s)
        else:
            islands.append([s])
    return sorted({(s[0], s[1] - s[0], s[2], s[4]) for i in islands for s in i if s[3] == max(x[3] for x in i)})


def test_license_spans(spark):
    """Changed, shortened and repeated notices, chunk borders, odd rows and names."""
    rng, rows = random.Random(5), []
    for n in range(120):
        out = []
        for _ in range(rng.randint(0, 4)):
            out += [f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 200))]
            notice = rng.choice(license_scan.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(notice))
                notice[i : i + 1] = rng.choice([[], ["other"], [notice[i], "more"]])
                notice = notice or ["x"]
            out += notice
        rows.append((n, " ".join(out), "x"))
    rows += [rows[3], rows[3], (None, rows[4][1], None), (500, None, ""), (501, "", ""), (502, "worK under the MIT License", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `we.ird` string").selectExpr("*", "1 AS key", "2 AS license", "3 AS own")
    got = license_scan.scan_licenses(df)
    assert sorted(got.columns) == sorted(df.columns)
    got, some = got.collect(), 0
    assert len(got) == len(rows)
    for r in got:
        want = plain_spans(r.text or "", license_scan.TEMPLATES, 4, 3, 0.7)
        assert [tuple(s) for s in r.license.spans] == want, r.doc_id
        at = plain_places(WORD.findall((r.text or "").translate(LOWER)), license_scan.PHRASES)
        assert [tuple(p) for p in r.license.places] == at
        assert r.license.labels == sorted({s[2] for s in want} | {p[1] for p in at})
        assert r.license.score == (1.0 if at else max((s[3] for s in want), default=0.0))
        some += len(want)
    assert some > 100
    assert not license_scan.scan_licenses(df.limit(0)).collect()


def test_license_words_beyond_ascii(spark):
    text = "École worK İX Ünder_the"
    got = spark.createDataFrame([(text,)], "t string").select(license_scan.words(license_scan.F.col("t"))).first()[0]
    plain = WORD.findall(text.translate(LOWER))
    assert len(got) == len(plain) and all((a == b) == b.isascii() or not b.isascii() for a, b in zip(got, plain)) and "work" not in got
