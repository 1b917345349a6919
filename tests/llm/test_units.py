"""Secret scans, fill-in-the-middle and whitening against brute force, on nulls, repeats, empty tables and clashing columns."""

import hashlib
import math
import re

import duckdb
import numpy as np
import pytest

from candor.llm import fim, registry, rowmarks, secret_scan, whitening

TEXTS = [
    None, "", "a", "\n", "\n\n", "one\ntwo", "one\ntwo\n", "x\r\ny\n\n\nz", "😀\n😀😀\n" * 3, "has <P> in it\nand more", "<S", "end <\nS>\nM>", "word " * 30000 + "\n" + "line\n" * 2000,
    "password = 'abc12' token: abcdef1 API_KEY=\"zzzzzz\" secret: token: abcdefgh", "AKIA" + "B" * 15, "AKIA" + "B" * 16 + " x " + "AKIAAKIA" + "7" * 20, "f" * 23 + " " + "0123456789abcdef" * 2 + "g" + "a" * 24,
    "ſecret=abcdefgh paSSwd:=nope passwd  :  hunter22", "😀😀 apikey=" + "0123456789abcdef" * 2, "eyJhbGciOiJI.eyJzdWIiOiIxMjM.abcdefghij", "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "ftp://me:sesame1@host.example/x",
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(i, t, f"b{i}", f"k{i}", f"s{i}") for i, t in enumerate(TEXTS)] + [(None, "secret=abcdefgh\nx", "b", "k", "s"), (3, "\n", "b", "k", "s"), (16, TEXTS[16], "b", "k", "s"), (900, TEXTS[16], "b", "k", "s")]
    at = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(rows, "doc_id long, text string, blob string, kind string, spans string").repartition(3).write.parquet(f"{at}/documents.parquet")
    return at


def plain_spans(text):
    out = []
    for at, (kind, pattern, flags, least, group) in enumerate((
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 6, 2), ("access", r"AKIA[A-Z0-9]+", 0, 20, 0), ("hex", r"[0-9a-f]+", 0, 24, 0),
    )):
        out += [(m.start(), at, kind, m.end()) for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]
    return sorted(out)


def test_secret_spans_equal_plain_ones(spark, docs, tmp_path):
    df = spark.read.parquet(f"{docs}/documents.parquet")
    got = sorted((tuple(r) for r in registry.op11_secret_scan(spark, docs).collect()), key=str)
    want = []
    for r in df.collect():
        spans = plain_spans(r["text"] or "")
        n = [sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")]
        want.append((r["doc_id"], *n, hashlib.sha256(",".join(f"{s[2]}:{s[0]}:{s[3]}" for s in spans).encode()).hexdigest()))
    assert [g[:5] for g in got] == sorted(want, key=str)
    spans = {g[0]: g[5] for g in got}
    assert [spans[k].split(":")[0] for k in (19, 20, 21)] == ["jwt", "pem", "address"] and spans[16] == spans[900] == "hex:24:56,hex:57:81" and spans[13].count("assign") == 2
    for s in ("assign", "hex"):
        assert s in spans[18]
    assert secret_scan.digests(df.where("false"), f"{tmp_path}/none").count() == 0


def test_only_unseen_pairs_are_scanned(spark, docs, tmp_path):
    ledger = f"{tmp_path}/ledger"
    df = spark.read.parquet(f"{docs}/documents.parquet")
    history = df.where("doc_id < 15 or doc_id is null")
    read = lambda: spark.read.parquet(ledger).count()
    secret_scan.scan(history, ledger, secret_scan.BASE).count()
    first = read()
    blobs = history.select(secret_scan.content_address(history["text"])).distinct().count()
    assert first == 3 * blobs
    before = sorted(map(str, secret_scan.scan(history, ledger, secret_scan.BASE).collect()))
    assert read() == first  # nothing new, nothing read
    secret_scan.scan(df, ledger, secret_scan.BASE).count()
    later = df.select(secret_scan.content_address(df["text"])).distinct().count()
    assert read() == 3 * later
    newer = (secret_scan.Rule("hex", 2, r"[0-9a-f]{24,}", least=30), *secret_scan.BASE[:2])
    found = secret_scan.scan(df, ledger, newer).where("path = 900").first()
    assert read() == 4 * later and [s["stop"] - s["start"] for s in found["spans"]] == [32]
    assert sorted(map(str, secret_scan.scan(history, ledger, secret_scan.BASE).collect())) == before  # the older version's findings are still there
    made = spark.createDataFrame([(1, "token=abcdefgh")], "doc_id int, text string")  # rows that are in no file yet
    assert secret_scan.scan(made, ledger, secret_scan.BASE).first()["spans"][0]["kind"] == "assign"


def test_row_marks_in_batches(spark, docs, monkeypatch):
    df = spark.read.parquet(f"{docs}/documents.parquet")
    gone = df.where("doc_id % 3 = 0").select(*rowmarks.place(df))
    want = sorted(map(str, df.where("doc_id is null or doc_id % 3 <> 0").collect()))
    assert sorted(map(str, rowmarks.without(df, gone).collect())) == want
    monkeypatch.setattr(rowmarks, "BATCH", 5000)  # a bitmap a batch
    assert sorted(map(str, rowmarks.without(df, gone).collect())) == want
    assert "_metadata" in rowmarks.without(df.withColumn("_metadata", df["kind"]), gone).columns


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_plain_version_and_sql(spark, docs):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    df = spark.read.parquet(f"{docs}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    plain = [plain_fim(*r) for r in rows]
    got = sorted((tuple(r) for r in registry.op12_fill_in_middle(spark, docs).collect()), key=str)
    assert got == sorted(((*p[:5], sha(p[5]), sha(r[1] or "")) for p, r in zip(plain, rows, strict=True)), key=str)
    assert {p[2] for p in plain} == {"plain", "psm", "spm"}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{docs}/documents.parquet/*.parquet'")
    assert sorted(con.sql(fim.ORACLE).fetchall(), key=str) == got
    assert fim.digests(df.where("false")).count() == 0


@pytest.mark.parametrize("grammar", sorted(fim.GRAMMARS))
def test_units_lose_nothing(spark, docs, grammar):
    df = spark.read.parquet(f"{docs}/documents.parquet")
    for r in df.select("text", fim.units(df["text"], grammar).alias("u")).collect():
        assert "".join(r["u"]) == (r["text"] or "") and all(r["u"])
    made = fim.transform(df, grammar, rate=60)
    assert made.select((fim.restored(made["output"], made["form"]) == "x").alias("x")).count() == df.count()
    back = {(r[0], r[1]) for r in made.select("doc_id", fim.restored(made["output"], made["form"])).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in df.collect()}


def test_markers_cannot_begin_within_another():
    with pytest.raises(ValueError):
        fim.Markers("<P>", "<P>", "<M>")
    with pytest.raises(ValueError):
        fim.Markers("P", "<S>", "<M>")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<float>, component string, n int")


def plain_whitening(rows):
    keep = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([v for _, v in keep], dtype=object)
    n, s = len(x), x.sum(0)
    deviation = [(i, sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))) for (i, _), v in zip(keep, x.tolist(), strict=True)]
    c = np.array([[(n * a - b) / n for a, b in zip(v, s, strict=True)] for v in x.tolist()], dtype=float)
    e, u = np.linalg.eigh(c.T @ c / n)
    return n, deviation, c, e[::-1], u[:, ::-1]


def test_whitening_equals_plain_version(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(12, 12))
    rows = [(i, (rng.normal(size=12) @ mix).astype(np.float32).tolist()) for i in range(300)] + [(None, [0.25] * 12), (7, [0.5] * 12), (7, [0.5] * 12), (1000, [-3.7] * 12)]
    bad = [(2000, None), (2001, [1.0] * 11 + [None]), (2002, [1.0] * 11 + [math.nan]), (2003, [math.inf] + [1.0] * 11), (2004, []), (2005, [1.0] * 3), (2006, [3e38] * 12)]
    n, deviation, c, e, u = plain_whitening(rows)
    got = whitening.whiten(vectors(spark, rows + bad).repartition(3)).collect()
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, 9))
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in got if r["component"] == 1) == sorted((str(i), d) for i, d in deviation)
    for k in range(8):
        mine = {r["vec_id"]: r for r in got if r["component"] == k + 1}
        want = c @ u[:, k] / math.sqrt(e[k])
        by = {i: w for (i, _), w in zip(rows, want, strict=True)}
        sign = np.sign(mine[1]["whitened"] * by[1])
        assert all(abs(sign * mine[i]["whitened"] - w) < 1e-8 for i, w in by.items())
        assert abs(mine[1]["explained"] - e[k] / e.sum()) < 1e-9 and mine[1]["identity_error"] < 1e-9


def test_whitening_of_tables_without_variance(spark):
    assert whitening.whiten(vectors(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors(spark, [])).schema.names[:3] == ["vec_id", "component", "n"]
    got = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(got) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in got)
    got = whitening.whiten(vectors(spark, [(i, [float(i), 1.0]) for i in range(5)])).collect()
    assert {(r["component"], r["whitened"] is None) for r in got} == {(1, False), (2, True)}
    far = whitening.whiten(vectors(spark, [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [0.0, 0.5])])).collect()
    assert all(r["deviation"] is None and r["deviation_exact"] > 2**63 for r in far if r["vec_id"] == 1)
    with pytest.raises(ValueError):
        whitening.whiten(vectors(spark, [(1, [1.0] * 1100)]))
