"""The corpus operators on small tables with every odd case, against brute force."""

import collections
import hashlib
import io
import random
import re
import time
import types
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from avrolith.llm import bpe, common, exact_dedup, html_extract, language_id, mixing, near_dedup, quality, toxicity, url_filters, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id long, name string, g string, spread long, n long, score double"


def docs_of(spark, rows):
    """Documents with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), None, 5, "x", "y", 1, 2, 0.5) for i, t, lang, src in rows], DOCS)


LONG = " ".join(f"word{i}" for i in range(30_000))
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, "same text", "en", "a"), (4, "same text", None, "b"), (4, "same text", None, "b"), (5, " \t\n", "fr", None), (6, LONG, "en", "a"), (7, LONG, "en", "a"), (8, LONG[:-1], "en", "a"), (None, "no id", "en", "a"), (9, "é🙂 <|endoftext|> x", "en", "a")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_lookup_join_spreads_hot_keys(spark):
    """Rows of a hot key find their values, and are dealt by more than the key."""
    big = spark.range(4000).selectExpr("if(id < 3000, 1, id % 500) as k", "id as spread", "concat('t', id) as t")
    table = big.groupBy("k").count().selectExpr("k", "count as n", "k * 2 as v", "repeat('x', 10) as w")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = common.lookup_join(big, table, ["k"], "n", 4000, "spread")
        assert all(r.v == 2 * r.k for r in out.collect()) and out.count() == 4000
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(k#\d+L?, __own_l#\d+L?", plan), plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# --- 1 ------------------------------------------------------------------------


@pytest.mark.parametrize("block", [7, 16384])
def test_exact_dedup(odd, block):
    groups = collections.defaultdict(list)
    for i, t, _, _ in ODD:
        groups[t or ""].append(i)
    want = []
    for i, t, _, _ in ODD:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows_of(exact_dedup.exact_dedup(odd, block_bytes=block)) == sorted(want, key=repr)


def test_exact_dedup_local_memory(odd):
    ids = exact_dedup.identities(odd, block_bytes=64, local_bytes=200)
    names = {(r.n_blocks, r.name) for r in ids.collect()}
    assert len(names) == len({t or "" for _, t, _, _ in ODD})


def test_exact_dedup_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


# --- 2 ------------------------------------------------------------------------


@pytest.mark.parametrize("block_rows", [1, 4])
@pytest.mark.parametrize("weights", [None, {"a": 500, "b": 300, "": 200}])
def test_mix(spark, weights, block_rows):
    rows = [(i, "t", "en", s) for i, s in enumerate(["a"] * 300 + ["b"] * 70 + [None] * 30)]
    out = mixing.mix(docs_of(spark, rows), weights=weights, block_rows=block_rows).collect()
    assert {r.doc_id for r in out} == set(range(400))
    slots = collections.defaultdict(set)
    for r in out:
        assert r["__release"] <= r["__slot"] < r["__deadline"]
        slots[r["__slot"]].add(r.source or "")
    order = [slots[s] for s in sorted(slots)]
    assert sorted(slots) == list(range(len(order))) and all(len(s) == 1 for s in order)
    seen = collections.Counter()
    n = {"a": 300, "b": 70, "": 30}
    parts = {r["__s"]: r.w for r in mixing._weights(spark.createDataFrame(list(n.items()), "__s string, n long"), 1000, weights).collect()}
    slots = sum(parts.values())
    assert weights is None or parts == weights
    assert all(abs(parts[s] / slots - 0.75 * n[s] / 400 - 0.25 / 3) < 0.002 for s in n) or weights
    for t, (s,) in enumerate(order, 1):
        seen[s] += 1
        assert all(abs(seen[x] * slots - parts[x] * t) < slots for x in parts)  # less than one block, exactly
    again = collections.Counter((r.doc_id, r["__epoch"]) for r in out)
    assert max(again.values()) == 1


@pytest.mark.parametrize("size", [3, 0.01, 0.0001])
def test_mix_buckets(spark, monkeypatch, size):
    """The order doesn't depend on how finely buckets are cut; a column of the mix's own name goes."""
    rows = [(i, "t", "en", s) for i, s in enumerate(["a"] * 300 + ["b"] * 70)]
    docs = docs_of(spark, rows).withColumnRenamed("name", "__slot").withColumnRenamed("g", "__f")
    want = [(r.doc_id, r["__slot"]) for r in mixing.mix(docs).orderBy("__slot").collect()]
    monkeypatch.setattr(mixing, "BUCKET_ROWS", size)
    out = mixing.mix(docs)
    assert out.columns == [c for c in docs.columns if c != "__slot"] + ["__slot", "__place", "__epoch", "__release", "__deadline"]
    assert [(r.doc_id, r["__slot"]) for r in out.orderBy("__slot").collect()] == want
    with pytest.warns(UserWarning, match="times over"):
        assert mixing.mix(docs, weights={"a": 1, "b": 999}).count() > 300 * 900


def test_mix_odd(odd, empty):
    assert mixing.mix(odd).select("doc_id").distinct().count() == len({i for i, *_ in ODD})
    assert mixing.mix(empty).count() == 0


# --- 3 ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.default_tokenizer(), "rb") as f:
        return bpe.Encoder(f.read())


@pytest.fixture(scope="module")
def peer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(st.characters(exclude_categories=["Cs"])), st.text("ab \n'stre09é<|endoftext|>", max_size=80)))
def test_bpe_like_library(encoder, peer, text):
    ids = encoder.encode(text)
    assert ids == peer.encode(text, add_special_tokens=False).ids
    assert encoder.decode(ids) == peer.decode(ids, skip_special_tokens=False)


def test_bpe_runs(encoder, peer, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(bpe, "RUN", 7)
    text = LONG[:5000] + "a" * 3000 + " \n" * 500
    assert encoder.encode(text) == peer.encode(text, add_special_tokens=False).ids


def test_bpe_documents(odd, empty, peer):
    got = {r.doc_id: r for r in bpe.token_digests(odd).collect()}
    for i, t, _, _ in ODD:
        ids = peer.encode(t or "", add_special_tokens=False).ids
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        assert tuple(got[i])[1:] == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = bpe.decode_documents(bpe.encode_documents(odd)).select("text", "decoded").collect()
    assert all((r.text or "") == r.decoded for r in back)
    assert bpe.token_digests(empty).count() == 0


def test_bpe_digest_with_the_ids(odd, empty, peer, monkeypatch):
    """One pass gives the ids and the digest of what they decode to; rows are given out by PIECE_BYTES of text."""
    out = bpe.encode_documents(odd, digest_col="name")
    assert out.columns == [*[c for c in odd.columns if c != "name"], "ids", "name"]
    want = [(i, t, peer.encode(t or "", add_special_tokens=False).ids, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _, _ in ODD]
    assert rows_of(out.select("doc_id", "text", "ids", "name")) == sorted(want, key=repr)
    assert bpe.encode_documents(empty, digest_col="name").count() == 0
    monkeypatch.setattr(bpe, "PIECE_BYTES", 1)
    batch = pa.record_batch({"text": [LONG, None, "", LONG, "x"]})
    assert [x.num_rows for x in bpe._pieces(batch, 0)] == [1, 2, 1, 1] and pa.Table.from_batches(bpe._pieces(batch, 0)).to_pylist() == batch.to_pylist()


def test_bpe_workers_keep_no_caches(spark):
    """What a task cached is gone when it has ended: idle workers count as their executor's memory."""

    def held(batches):
        import pyarrow as pa

        for batch in batches:
            n = sum(len(e.packed) + len(e.packed.old) + len(e.pairs) for e in bpe._encoders.values())
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int64()), pa.array([len(bpe._encoders)] * batch.num_rows, pa.int64())], names=["n", "encoders"])

    docs = spark.range(0, 400, 1, 4).selectExpr("id as doc_id", "concat('Wort', id * 7919, ' xqz', id) as text")
    for made in (bpe.encode_documents(docs), bpe.decode_documents(bpe.encode_documents(docs)), bpe.token_digests(docs)):
        made.write.format("noop").mode("overwrite").save()
        found = spark.range(0, 64, 1, 16).mapInArrow(held, "n long, encoders long").agg({"n": "max", "encoders": "max"}).first()
        assert found["max(encoders)"] == 1 and found["max(n)"] == 0


# --- 4 ------------------------------------------------------------------------


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rng = random.Random(4)
    texts = [None, "", "a b c a b c", "x\ny\nx\n \n \nx", "a|b *** <é🙂> a\u00a0b", "a a a a a", LONG, "p q r " * 50]
    texts += ["".join(rng.choice("ab \n\t|#c") for _ in range(rng.randint(0, 120))) for _ in range(150)]
    got = quality.base_counts(docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    for r in got:
        assert tuple(r)[3:] == base_counts(texts[r.doc_id]), repr(texts[r.doc_id])


def test_quality_outliers(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(60, 300))), "en", "big" if i % 3 else f"s{i % 50}") for i in range(600)]
    rows += [(1000 + i, " ".join(word() + "***" for _ in range(100)), "en", "big") for i in range(20)]
    rows += [(2000, "too short", "en", "big"), (2001, None, None, None)]
    got = {r.doc_id: r for r in quality.judge(docs_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept and got[i].distance is not None for i in range(600))
    assert not any(got[1000 + i].kept for i in range(20))
    assert got[2000].base_failed and got[2001].base_failed and not got[2001].kept


def exact_mcd(x, rng, starts=60):
    """The least determinant over many random starts, with the operator's floors and factors."""
    import numpy as np

    h, floors = int(np.ceil(quality.SHARE * len(x))), np.diag(np.array(quality.FLOORS) ** 2)
    best = None
    for _ in range(starts):
        own = x[rng.choice(len(x), min(len(x), 6), replace=False)]
        last = None
        while True:
            mean, cov = own.mean(axis=0), np.cov(own.T, bias=True).reshape(5, 5) * quality.CONSISTENCY + floors
            det = np.linalg.slogdet(cov)[1]
            if len(own) == h:
                if last is not None and det > last - 1e-9:
                    break
                last = det
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            own = x[np.argsort(d, kind="stable")[:h]]
        if best is None or last < best[0]:
            best = last, mean, cov
    return best


def test_quality_estimates(spark):
    """Determinants against the best of many random starts, and shrinking against its formula."""
    import numpy as np

    rng = np.random.default_rng(4)
    parts = {}
    for g, n, odd in (("a", 400, 0.2), ("b", 150, 0.0), ("c", 300, 0.24), ("d", 9, 0.3), ("e", 1, 0.0)):
        turn = rng.normal(size=(5, 5)) * 0.5 + np.eye(5)
        x = rng.normal(size=(n, 5)) @ turn + rng.normal(size=5)
        x[: int(odd * n)] += 25 * np.array([1, -1, 1, 1, -1])
        parts[g] = x
    rows = [(g, i, *map(float, r)) for g, x in parts.items() for i, r in enumerate(x)]
    names = ", ".join(f"x{i} double" for i in range(5))
    df = spark.createDataFrame(rows, f"g string, i long, {names}").selectExpr("g", "xxhash64(g, i) as spread", *[f"x{i}" for i in range(5)])
    groups = spark.createDataFrame([(g, len(x)) for g, x in parts.items()], "g string, n long")
    found = quality.mcd(df, groups, len(rows))
    got = {r.g: r for r in found.collect()}
    assert set(got) == set(parts)
    for g in "abcd":
        want = exact_mcd(parts[g], rng)
        assert got[g].logdet <= want[0] + 0.05, (g, got[g].logdet, want[0])
        if g in "ac":
            cov = np.array([[got[g][f"v{max(i, j)}{min(i, j)}"] for j in range(5)] for i in range(5)])
            mean = np.array([got[g][f"m{i}"] for i in range(5)])
            d = np.einsum("ij,jk,ik->i", parts[g] - mean, np.linalg.inv(cov), parts[g] - mean)
            k = int((0.2 if g == "a" else 0.24) * len(parts[g]))
            assert d[:k].min() > 100 and (d[k:] < quality.CUTOFF).mean() > 0.99
    langs = {"a": "x", "b": "x", "c": "y", "d": None, "e": "x"}
    shrunk = {r.g: r for r in quality.shrink(found.join(spark.createDataFrame(list(langs.items()), "g string, lang string"), "g"), 50).collect()}
    n = {g: len(x) for g, x in parts.items()}
    mean = {g: np.array([got[g][f"m{i}"] for i in range(5)]) for g in parts}
    cov = {g: np.array([[got[g][f"v{max(i, j)}{min(i, j)}"] for j in range(5)] for i in range(5)]) for g in parts}

    def pool(gs):
        total = sum(n[g] for g in gs)
        m = sum(n[g] * mean[g] for g in gs) / total
        return total, m, sum(n[g] * (cov[g] + np.outer(mean[g] - m, mean[g] - m)) for g in gs) / total

    _, m_all, v_all = pool(list(parts))
    for g, lang in langs.items():
        total, m, v = pool([x for x in parts if langs[x] == lang])
        m, v = (total * m + 50 * m_all) / (total + 50), (total * v + 50 * v_all) / (total + 50)
        m, v = (n[g] * mean[g] + 50 * m) / (n[g] + 50), (n[g] * cov[g] + 50 * v) / (n[g] + 50)
        assert np.allclose([shrunk[g][f"m{i}"] for i in range(5)], m) and abs(shrunk[g].logdet - np.linalg.slogdet(v)[1]) < 1e-6


def test_quality_odd(odd, empty):
    got = quality.judge(odd).collect()
    assert len(got) == len(ODD) and {r.doc_id for r in got if r.kept} == {6, 7, 8}
    assert quality.judge(empty).count() == 0


# --- 5 ------------------------------------------------------------------------


def test_warc(spark):
    big = "<p>" + "x" * 1200
    pages = [(1, "http://a/\r\nX: y", big), (2, None, big), (2, None, big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", LONG + "é"), (7, "u", "\r\n\r\nWARC/1.1\r\n" * 200), (None, "u", "z")]
    df = spark.createDataFrame([(*p, 1, "k") for p in pages], "page_id long, url string, html string, digest long, kind string")
    got = rows_of(warc.archive_pages(df))
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        keeper = max((j for j, _, x in pages if x == h and j), default=None)
        twin = len(raw) >= 1000 and i is not None and keeper != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if twin else "response", keeper if twin else None))
    assert got == sorted(want, key=repr)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_warc_chunks(spark, tmp_path):
    payload = LONG.encode()
    df = spark.createDataFrame([(1, "u", LONG)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    archives = warc.write_archives(warc.plan_records(df), folder)
    archives = spark.createDataFrame(archives.collect(), "archive string, records long")
    chunks = sorted(warc.read_chunks(archives, folder, chunk=1000).collect(), key=lambda r: r.chunk)
    assert b"".join(bytes(c.bytes) for c in chunks) == payload and max(len(c.bytes) for c in chunks) == 1000
    assert [c.is_last for c in chunks] == [False] * (len(chunks) - 1) + [True]
    assert all(c.digest_so_far == hashlib.sha1(payload[: c.length_so_far]).hexdigest() for c in chunks)


def test_warc_broken():
    head = warc.record_head("1", "response", "u", "0", None, 10, 10)
    for data in (head + b"short", head[:30], b"HTTP/1.1\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.stream_records(io.BytesIO(data)))
    whole = head + b"0123456789\r\n\r\n"
    assert [x[2] for x in warc.stream_records(io.BytesIO(whole + whole))] == [b"0123456789"] * 2


def test_warc_of_others(spark, tmp_path):
    """Records without digests or ids, of other types, not compressed."""
    body = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(body)
    got = warc.read_records(spark.createDataFrame([("a.warc", 2)], "archive string, records long"), f"file://{tmp_path}").orderBy("record").collect()
    assert [(r.record, r.record_type, r.record_id, r.payload_digest, r.length_so_far, r.digest_so_far) for r in got] == [(0, "warcinfo", "<urn:uuid:1>", None, 5, hashlib.sha1(b"hello").hexdigest()), (1, None, None, None, 0, hashlib.sha1(b"").hexdigest())]
    with pytest.raises(ValueError):
        list(warc.stream_records(io.BytesIO(b"WARC/1.0\r\nWARC-Type: x\r\n\r\n")))


# --- 6 ------------------------------------------------------------------------


def toxic_rows():
    rng = random.Random(6)
    words = [a + b for a in "ba de ki lo mu ra se ti".split() for b in "nor sel tap wim zog".split()]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(40, 90))]
        if i % 5 == 0:
            for w in rng.choices(["idiot", "moron", "stupid"], k=4):
                text.insert(rng.randrange(len(text)), w)
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, int(i % 5 == 0)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    rows[5] = (5, "banor 1d10t desel m0r0n kitap s t u p i d lowim idiiiot kitap $tupid " + rows[6][1], "en", "s")
    rows += [(9000, None, None, None), (9001, "", "en", "s"), (1, rows[1][1], "en", "s")]
    learn = spark.createDataFrame([x for x in labels if x[0] % 2 == 0], "doc_id long, toxic int")
    got = toxicity.score(docs_of(spark, rows), learn).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    for r in got:
        if r.doc_id < 600:
            assert r.predicted == (r.doc_id % 5 == 0), r
        else:
            assert r.predicted == 0


def test_restore():
    import numpy as np

    raw = ("idiot moron stupid loser " * 50 + "the hat is on a mat " * 200).encode()
    grams, _ = language_id.gram_numbers(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    model = toxicity.CharacterModel(np.bincount(grams, minlength=language_id.GRAMS))
    for written, meant in {"1d10t": "idiot", "m0r0n": "moron", "$tup1d": "stupid", "l0ser": "loser", "idiiiiot": "idiot", "mo.ron": "moron", "st*pid": "stupid"}.items():
        assert model.restore(written) == meant


def test_restored_disguises():
    import numpy as np

    raw = ("idiot moron stupid fuck ass hoe " * 50 + "the hat is on a mat hello all see too " * 200).encode()
    grams, _ = language_id.gram_numbers(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    model = toxicity.CharacterModel(np.bincount(grams, minlength=language_id.GRAMS))
    want = {"f**k on": "fuck", "f***": "fuck", "a55": "ass", "a$$": "ass", "h03": "hoe", "stuupid": "stupid", "idiiot": "idiot", "fuuck the": "fuck", "a s s": "ass", "i  d  i  o  t": "idiot", "id iot the mat": "idiot", "the stu pid": "stupid", "1 d 1 0 t": "idiot", "i. d. i. o. t.": "idiot", "s-t-u-p-i-d": "stupid", "s t u p i d on a mat": "stupid", "st€pid": "stepid"}
    clean = ["the hat is on a mat hello all see", "id", "iot", "hello hello", "455 10 20", "", "ass"]
    texts = [x for w in want for x in (w, "id")] + clean
    data = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(x) for x in data])])
    got = collections.defaultdict(set)
    for i, w in toxicity.restored(np.frombuffer(b"".join(data), np.uint8), off, model):
        got[i].add(w)
    assert all(w in got[2 * i] for i, w in enumerate(want.values())), got
    assert not any(got[2 * i + 1] for i in range(len(want))) and not any(got[2 * len(want) + i] for i in range(len(clean)))


def test_toxicity_features_are_exact(monkeypatch):
    """Two words whose hashes agree in 20 bits keep counts and weights of their own."""
    import numpy as np
    import pyarrow as pa

    seen, pair = {}, None
    for i in range(20_000):
        word = f"{'abcdefghij'[i % 10]}" + "".join(chr(107 + int(c)) for c in str(i))
        data = np.frombuffer(word.encode(), np.uint8)
        key = int(toxicity.word_features(data, np.array([0, len(data)]))[0][0, 0]) >> 44
        if key in seen:
            pair = seen[key], word
            break
        seen[key] = word
    bad, good = pair
    grams = np.zeros(language_id.GRAMS, np.int64)
    h = {w: int(toxicity.word_features(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0].view(np.int64)[0, 0]) for w in pair}
    known = types.SimpleNamespace(value=np.array([h[bad]]).view(np.uint64))
    batch = pa.RecordBatch.from_arrays([pa.array([bad] * 4 + [f"{good} {good}"] * 6)], names=["text"])
    model = lambda: toxicity.CharacterModel(grams)
    for held in (1 << 20, 1):
        monkeypatch.setattr(toxicity, "HELD", held)
        for run, want in ((toxicity._count_features(model), {h[bad]: 4, h[good]: 6, None: 20}), (toxicity._count_known(model, known), {h[bad]: 4, h[good]: 0, None: 20})):
            total = collections.Counter()
            for out in run([batch, batch]):
                for f, n in zip(*(c.to_pylist() for c in out.columns)):
                    total[f] += n
            assert {f: total[f] for f in want} == {f: n * (1 if f is None else 2) for f, n in want.items()}
    weights = toxicity.Weights(np.array([h[bad]]).view(np.uint64), np.array([2.0], np.float32))
    assert weights.of(np.array([h[bad], h[good]]).view(np.uint64)).tolist() == [2.0, 0.0]


def test_toxicity_of_disguised_words_in_the_tables(spark):
    """Toxic held-out texts of the tables stay toxic with their insults disguised; others stay clean with words disguised."""
    sf = "/root/testdata/sf0.1"
    rng = random.Random(12)
    insults = "trash pathetic idiot disgusting worthless stupid clown scum loser moron".split()
    leet = {"a": "4@", "i": "1!", "o": "0", "e": "3", "s": "5$", "t": "7"}

    def disguise(m):
        w, way = m.group(), rng.randrange(4)
        if way == 0:
            return "".join(rng.choice(leet[c]) if c in leet and (i or c != "s") else c for i, c in enumerate(w.lower()))
        if way == 1:
            return " ".join(w)
        if way == 2:
            i = rng.randrange(1, len(w))
            return w[:i] + w[i] * rng.randint(2, 4) + w[i + 1 :]
        return w[0] + "".join("*" if c in "aeiou" else c for c in w[1:])

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").collect()}
    out = {i for i in marks if zlib.crc32(str(i).encode()) % 3 == 1}
    found = re.compile(r"\b(" + "|".join(insults) + r")\b", re.I)
    rows, hidden, clean = [], [], []
    for i, mark in marks.items():
        text = docs[i]
        if i in out and mark and len(found.findall(text)) > 2:
            text = found.sub(disguise, text)
            hidden.append(i)
        elif i in out and not mark:
            words = text.split(" ")
            for j in rng.sample(range(len(words)), min(3, len(words))):
                words[j] = re.sub(r"^[a-z]{4,}$", disguise, words[j])
            text = " ".join(words)
            clean.append(i)
        rows.append((i, text))
    learn = spark.createDataFrame([(i, m) for i, m in marks.items() if i not in out], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), learn).collect()}
    caught, wrong = sum(got[i] for i in hidden) / len(hidden), sum(got[i] for i in clean) / len(clean)
    assert len(hidden) > 50 and caught > 0.9 and wrong < 0.01, (len(hidden), caught, wrong)


def test_toxicity_empty(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(odd, none).collect()} == {0.0}
    assert toxicity.score(empty, none).count() == 0


# --- 7 ------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""), ("<p>", ""), ("plain words only", "plain words only"), ("<script>var a='<p>x</p>';</script>", ""),
        ("<nav><a href=/>Home</a></nav><article><h1>T</h1><p>One,  two\n three.<p>Four &amp; f&eacute;e.</article><footer>(c)</footer>", "T One, two three. Four & fée."),
        ("<body><div class='sidebar'><p>Ad, ad, ad, ad, ad.</p></div><div id=content><p>" + "Real text, with commas, " * 5 + "</p><div class=comments><p>Nice, post!</p></div></div>", ("Real text, with commas, " * 5).strip()),
        ("<main><p>a<b>b</b>c</p><form><p>Sign up</p></form><ul><li><a href=1>x</a></li><li><a href=2>y</a></li></ul></main>", "abc"),
        ("<article><p><b>Open <br>bold<p>next</article><aside>no</aside>", "Open bold next"),
        ("<p title='a > b'>shown</p><!-- <p>hidden</p> --><style>p{}</style>", "shown"),
        ("<article>&#x110000;&#55296;ok</article>", "\ufffd\ufffdok"),
    ],
)
def test_html(page, text):
    assert html_extract.extract_text(page) == text


_PROSE = "Real text, with commas, and some more of it to be read. " * 4


@pytest.mark.parametrize(
    "around",
    [
        '<div style="overflow:hidden">%s</div>', '<div class="overflow-hidden">%s</div>', '<div class="layout has-sidebar"><div class="sidebar"><p>Ad, ad, ad.</p></div>%s</div>', '<div id="legal">%s</div>',
        '<div class="widget">%s</div>', '<form id="aspnetForm">%s</form>', '<div class="row no-nav"><nav>Menu</nav>%s</div>', "<td>%s", '<div class="page search">%s</div>',
    ],
)
@pytest.mark.parametrize("inner", ["<article><h1>T</h1><p>%s</article>", "<article><svg viewBox='0'/><button-group>T</button-group><p>%s</p></article>", "<div><h1>T</h1><p>%s</p></div>", "<article><header><h1>T</h1><p>By me</p></header><p>%s</p><footer>x</footer></article>"])
def test_html_wrappers(around, inner):
    page = "<head><title>t</title><body><nav><a href=/>Home</a></nav>" + around % (inner % _PROSE) + "<div class=cookie-banner><p>We use cookies, many, many, many cookies.</p></div><footer>c</footer>"
    assert html_extract.extract_text(page) == "T " + _PROSE.strip()


@pytest.mark.parametrize("name", ["id='Side_effects'", "id='related-work'", "id='search-results'", "id='discussion'", "id='legal'", "class='no-share'"])
@pytest.mark.parametrize("tag", ["h2", "section", "p"])
def test_html_names_inside_an_article(name, tag):
    inner = f"<{tag} {name}>Some words of the article, all of it.</{tag}>"
    assert html_extract.extract_text(f"<article><p>{_PROSE}</p>{inner}</article>") == _PROSE + "Some words of the article, all of it."


@pytest.mark.parametrize(
    "page",
    [  # templates without an article element, with remarks of readers that are longer than the text
        f"<div id=page><div class='site-header'><p>Welcome, to, us</p></div><div class=columns><div id=left-sidebar><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div><div class=post><p>{_PROSE}</p><div class='share-buttons'>Share</div><p>{_PROSE}</p></div></div><div id=comments><ol class=commentlist>" + f"<li><article class=comment><p>{_PROSE}</p></article></li>" * 9 + "</ol></div></div>",
        f"<body><main><p>{_PROSE}<p>{_PROSE}<div hidden><p>{_PROSE}</p></div><div style='color:red; display: none'>{_PROSE}</div><section class='related-posts'><article><p>See, also</article></section></main>",
        f"<table><tr><td class=sidebar><p>Ad, ad</p></td><td><p>{_PROSE}</p><p>{_PROSE}</p><td class=ads>ad</table><div class=footer>c</div>",
        f"<div><p>{_PROSE}</p><p>{_PROSE}</p><p class=ad>Buy, buy, buy, now.</p><noscript><p>Turn it on</p></noscript><select><option>a<option>b</select></div><script>if (a < b) '<p>no</p>'</script>",
    ],
)
def test_html_templates(page):
    assert html_extract.extract_text(page) == (_PROSE * 2).strip()


@pytest.mark.parametrize("page, text", [("<div>" * 200_000 + "deep", "deep"), ("<div><p>words " * 20_000, ("words " * 20_000).strip()), ("<a x=\"><b\" x=\"" * 5_000, None), ("<!" * 100_000, "<!" * 100_000), ("<ul><li>x " * 20_000, ("x " * 20_000).strip()), ("<b><p>x" * 20_000, ("x " * 20_000).strip()), ("<script>a" * 50_000, ""), ("<textarea>a " * 20_000, ("a " * 20_000).strip())])
def test_html_takes_time_in_proportion(page, text):
    begin = time.process_time()
    got = html_extract.extract_text(page)
    assert time.process_time() - begin < 20 and (text is None or got == text)


def test_html_scores():
    """Points by brute force: every paragraph walks up to the root."""
    rng = random.Random(7)

    def page(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice("div div section article td blockquote p p p span b".split())
            text = ", ".join("word" * rng.randint(1, 9) for _ in range(rng.randint(0, 12)))
            link = f"<a href=1>{text}</a>" if rng.random() < 0.2 else text
            out.append(f"<{tag}>{link}" + (page(depth - 1) if depth and tag not in ("p", "span", "b") else "") + f"</{tag}>")
        return "".join(out)

    for _ in range(150):
        root = html_extract.parse(page(4))
        nodes = html_extract._order(root)
        html_extract.measure(nodes)
        want = {n: html_extract._START.get(n.tag, 0) if n.length else 0 for n in nodes if n.block}

        def own(n):
            """(text, of it in links) outside inner blocks."""
            found = []
            for x in n.items:
                if isinstance(x, str):
                    found.append((x.strip(), n.tag == "a"))
                elif not x.block:
                    found += own(x)
            return [(t, inside or n.tag == "a") for t, inside in found]

        for n in want:
            pieces = own(n)
            size, linked, commas = sum(len(t) for t, _ in pieces), sum(len(t) for t, a in pieces if a), sum(t.count(",") for t, _ in pieces)
            paragraph = n.tag in html_extract._PARAGRAPHS
            if size and (paragraph or size > 20):
                points, up = (1 + commas + min(size / 100, 3)) * (1 - linked / size), n.parent if paragraph else n
                while up is not None:
                    if up.block:
                        want[up] += points
                        points /= 2
                    up = up.parent
        assert all(abs(n.score - want[n]) < 1e-6 for n in want)
        best = html_extract.best_container(nodes)
        assert best is None or best.score * (1 - best.linked / best.length) == max(n.score * (1 - (n.linked / n.length if n.length else 0)) for n in want)


def test_html_pages(spark):
    rows = [(1, None, None), (1, "u", "<p>x</p>"), (2, "u", "<div>" * 5000 + "deep" + "</p>" * 10), (3, "u", "<article><p>" + LONG + "</article>")]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_extract.extract_pages(df).collect()}
    assert got == {(1, None): ("", 0), (1, "u"): ("x", 1), (2, "u"): ("deep", 4), (3, "u"): (LONG, len(LONG))}
    assert html_extract.extract_pages(df.limit(0)).count() == 0


# --- 8 ------------------------------------------------------------------------


def components(rows, k, threshold):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("block, shingles", [(512, 1 << 21), (5, 1 << 21), (512, 200)])
def test_near_duplicates(spark, monkeypatch, block, shingles):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, LONG), (8, LONG + " end")]
    passage = " ".join(rng.choice(words) for _ in range(60))
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(6, 80))]
        for _ in range(rng.randint(1, 14)):
            t = list(base)
            for _ in range(rng.randint(0, 5)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows) + 1, " ".join(t) + (" " + passage if g % 4 == 0 else "")))
    rng.shuffle(rows)
    want = components(rows, 4, 80)
    got = near_dedup.near_duplicates(docs_of(spark, [(i, t, "en", "s") for i, t in rows] + [(4, "One two", "en", "s")]), k=4).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("contract", [1 << 20, 3])
def test_components_of_links(spark, monkeypatch, contract):
    """Chains, a centre with many rays, random links, repeated links and loops, over several tasks."""
    monkeypatch.setattr(near_dedup, "CONTRACT", contract)
    rng = random.Random(3)
    chain = list(range(1000, 1060))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(7, i) for i in range(100, 300)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(100)]
    links += links[:20] + [(5, 5), (-3, 2), (9, 2)]
    want = near_dedup._Union()
    for a, b in links:
        want.join(a, b)
    df = spark.createDataFrame([(min(x), max(x)) for x in links], "a long, b long").repartition(8)
    got = near_dedup.components(df).collect()
    assert len(got) == len({r.id for r in got})
    assert {r.id: r.comp for r in got} == {x: want.root(x) for a, b in links if a != b for x in (a, b)}
    assert near_dedup.components(df.where("a > 10000")).count() == 0


def test_shingles_are_told_apart_by_words():
    """Words that polynomial hashes confuse (Thue-Morse), random texts, and the 64-bit hashes of sets."""
    import numpy as np

    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    rng = random.Random(1)
    texts = ["x y z " + a, "x y z " + b, "x y z " + a.upper(), "", " ", "x y", "x  y", "y x"]
    texts += [" ".join(rng.choice("abcABC é\u00a0") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    data = [t.encode() for t in texts]
    raw, off = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])])
    for k in (1, 2, 3, 4, 5, 7):
        want = []
        for t in texts:
            w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t))
            want.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
        sets = near_dedup.exact_sets(raw, off, k)
        elements, begins, digests = near_dedup.shingle_sets(raw, off, k)
        assert [len(x) for x in want] == [len(x) for x in sets] == np.diff(begins).tolist()
        for i in range(0, len(texts), 7):
            for j in range(len(texts)):
                assert len(want[i] & want[j]) == len(np.intersect1d(sets[i], sets[j])) == len(np.intersect1d(elements[begins[i] : begins[i + 1]], elements[begins[j] : begins[j + 1]]))
                assert (want[i] == want[j]) == (digests[i] == digests[j])


def test_near_duplicates_of_repeated_ids(spark):
    """An id with several texts, and a row that holds half of all rows."""
    words = [f"w{i}" for i in range(100)]
    one, other = " ".join(words), " ".join(reversed(words))
    rows = [(5, one), (5, other), (9, other + " x"), (7, one + " y"), (None, one), (8, "a b c d e f")] + [(20, one + " z")] * 2000
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs_of(spark, [(i, t, "en", "s") for i, t in rows]), k=4).collect())
    assert got == {(5, 97, 5, True): 2, (9, 98, 5, False): 1, (7, 98, 5, False): 1, (None, 97, None, True): 1, (8, 3, 8, True): 1, (20, 98, 5, False): 2000}


def test_near_duplicates_odd(odd, empty):
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(odd).collect()}
    assert {(3, 3), (4, 3), (6, 6), (7, 6), (8, 6), (1, 1), (2, 2), (5, 5)} <= got
    assert near_dedup.near_duplicates(empty).count() == 0


def test_estimate():
    import numpy as np

    rng = np.random.default_rng(1)
    for j, ratio in ((0.8, 1.0), (0.5, 1.0), (0.8, 0.85)):
        n = 4000
        m = int(n * ratio)
        both = int(j * (n + m) / (1 + j))
        e = rng.integers(0, 2**63, n + m - both, dtype=np.uint64)
        a, b = e[:n], e[n - both :]
        r = near_dedup.sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        got = near_dedup.estimate(np.array([(r[0] > r[1]).sum()]), np.array([(r[0] < r[1]).sum()]), np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(got - j) < 0.13
    # sketches merge by maxima
    whole = near_dedup.sketches(e, np.array([0, len(e)]))[0]
    assert (whole == np.maximum(r[0], r[1])).all()


def test_shared_counts():
    import numpy as np

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(0, 6000), dtype=np.uint64)) for _ in range(12)]
    got = near_dedup.shared_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(12) for j in range(12) if i != j)


# --- 9 ------------------------------------------------------------------------


def test_language(spark, empty):
    rng = random.Random(9)
    words = {"xx": ["katan", "rokal", "mikat", "tarok"], "yy": ["söly", "fengö", "ülmen", "snöby"], "жж": ["привет", "мир", "пока", "дом"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randint(5, 40))), x, "s") for i, x in enumerate(sorted(words) * 40)]
    docs = docs_of(spark, rows + [(500, None, "xx", "s"), (501, "", None, "s"), (502, "12 34 !", "yy", "s"), (503, "KATAN", None, None), (503, "KATAN", None, None)])
    model = language_id.train(docs.where("doc_id % 4 <> 2"))
    got = [tuple(r) for r in language_id.identify(docs, model).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == len(rows) + 5 and all(by[i][1] == x and 0 < by[i][2] <= 1 for i, _, x, _ in rows)
    assert [by[i][1:] for i in (500, 501, 502)] == [("und", 0.0)] * 3 and by[503][1] == "xx"
    assert language_id.identify(empty, model).count() == 0
    nobody = language_id.train(empty)
    assert {r.lang_pred for r in language_id.identify(docs, nobody).collect()} == {"und"}


def test_gram_numbers_are_per_text():
    import numpy as np

    texts = ["", "ab", "é", "  a b ", "", "zzz"]
    raw = "".join(texts).encode()
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    grams, begins = language_id.gram_numbers(np.frombuffer(raw, np.uint8), off)
    ends = np.append(begins[1:], len(grams))
    for i, t in enumerate(texts):
        own = np.frombuffer(t.encode(), np.uint8)
        alone, _ = language_id.gram_numbers(own, np.array([0, len(own)]))
        assert sorted(g for g in grams[begins[i] : ends[i]] if g) == sorted(g for g in alone if g)


# --- 10 -----------------------------------------------------------------------


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://ORG/", "https://org", "http://a.example.org/es/x", "http://example.org/en/12?q#f", "http://badexample.org/es/", "http://x.com/fr/1", "http://x.com/de/", "HTTP://X.COM/DE/", "http://é.com/de/", "http://com/fr/", "a://b://org/", "http://u@h.org:80/es/", "http://..org/", "http://x.net/" + "p" * 5000]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls + urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: tuple(r)[1:] for r in url_filters.filter_urls(df, url_filters.rules_table(spark)).collect()}
    assert got == {i: judged(u) for i, u in enumerate(urls + urls)}
    assert url_filters.filter_urls(df.limit(0), url_filters.rules_table(spark)).count() == 0


# --- pipeline -------------------------------------------------------------------


def test_pipeline(spark, peer):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = before = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        counts.append(out.count())
        if name == "exact dedup":
            assert out.select("text").distinct().count() == out.count() == docs.select("text").distinct().count()
        if name == "near dedup":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in components(rows, 5, 80).items() if i == c}
        if name == "mix sources":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
        if name != "bpe":
            assert out.schema.names == before.schema.names
        docs = out
    assert docs.columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in docs.collect():
        ids = peer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_pipeline_encodes_in_one_worker(spark, odd):
    """A task of the last stage has one Python worker, that encodes and decodes."""
    import corpus_pipeline

    plan = corpus_pipeline.encode(spark, odd, "")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("MapInArrow", plan)) == 1, plan


def test_pipeline_odd(spark, odd):
    import corpus_pipeline

    base = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (base, base.limit(0)):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "")
        docs.count()


def test_pipeline_keeps_the_order_of_the_mix(spark, tmp_path):
    """The stages' files by name, and the rows in them, follow the schedule, also with a hot source."""
    import corpus_pipeline

    docs = docs_of(spark, [(i, f"text {i}", "en", s) for i, s in enumerate(["a"] * 300 + ["b"] * 70 + ["c"] * 30)])
    want = [(r.doc_id, r.source) for r in mixing.mix(docs).orderBy("__slot", "__place").collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for i, stage in enumerate((corpus_pipeline.mix_sources, corpus_pipeline.encode)):
            stage(spark, docs, "").write.parquet(f"{tmp_path}/{i}")
            files = sorted((tmp_path / f"{i}").glob("*.parquet"))
            got = [(r.doc_id, r.source) for f in files for r in spark.read.parquet(str(f)).coalesce(1).collect()]
            assert got == want and len(files) > 1
            docs = spark.read.parquet(f"{tmp_path}/{i}")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pipeline_keeps_rows_by_their_own_verdict(spark):
    """Rows without an id, and an id with two texts, through the stages that filter."""
    import corpus_pipeline

    rng = random.Random(11)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(120))
    clean, other, twin, near = text(), text(), text(), text()
    rows = [(None, clean, "en", "a"), (None, clean, "en", "a"), (1, other, "en", "a"), (1, "too short", "en", "a"), (2, twin, "en", "a"), (3, twin, "en", "a"), (None, twin, "en", "a"), (2, near, "en", "a"), (4, near + " end", "en", "a"), (None, near + " last", "en", "a"), (5, other + " x", "en", "a")]
    base = docs_of(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    quality_ = corpus_pipeline.quality_rules(spark, base, "")
    assert rows_of(quality_.select("doc_id", "text")) == sorted([r[:2] for r in rows if r[1] != "too short"], key=repr)
    exact = corpus_pipeline.exact_duplicates(spark, quality_, "")
    left = [(None, clean), (1, other), (3, twin), (2, near), (4, near + " end"), (None, near + " last"), (5, other + " x")]
    assert rows_of(exact.select("doc_id", "text")) == sorted(left, key=repr)
    both = exact.union(spark.createDataFrame([(3, clean + " y", "en", "a", 1), (3, text(), "en", "a", 1)], exact.schema))
    got = {(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, both, "").collect()}
    assert {(1, other), (3, twin), (2, near)} <= got and len(got) == 5
    assert sum(x[1] in (clean, clean + " y") for x in got) == 1


def test_held_out(spark):
    df = spark.range(200).withColumn("h", language_id.held_out("id", 3, 1))
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in df.collect())
