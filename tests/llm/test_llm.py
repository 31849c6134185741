"""Each operator against brute force on small fixtures with nulls, empties, copies, long texts and empty tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stratavec.llm import coder, graph, idfile, jpeg, linechunks, mixing, packing, rpforest, sharding, simhash, substrings, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=60):
    r = random.Random(5)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 7))) for _ in range(80)]
    passage = " ".join(r.choice(words) for _ in range(30))
    texts = []
    for i in range(n):
        lines = [" ".join(r.choice(words) for _ in range(r.randint(1, 12))) for _ in range(r.randint(1, 12))]
        if i % 4 == 0:
            lines.insert(len(lines) // 2, passage)
        texts.append("\n".join(lines))
    texts[5] = texts[4]
    texts[6] = texts[4] + " x"
    texts[7:11] = [None, "", "   ", "ab"]
    texts[11] = "word " * 5000
    return [(i, t, "en", ["a", "b", None][i % 3 if i % 2 else 0], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def encoded(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x, *_ in rows}


def test_word_cache_gives_the_library_s_ids():
    enc = tokens.encoder(tokens.default_path())
    odd = ["", " ", "  a  b ", "a \n b", " x", "x ", "<|endoftext|> a b", "don't  we'll", "\n\n a", "é​ b 12 3\t4 ", "x" * 50, "a\x1c b", "a b\n"]
    odd += ["a\u00a0 b", "a \u2003 b", "a\r\n\r\n b\x0b c", "\u3000 a", "l'a d'b 's\n't", "a\n\n\nb  \n c", "x" * 100 + " y", "", "日本 語", "a\u200d b", "1 2\n3\t\t4"]
    r = random.Random(1)
    odd += ["".join(r.choice(" \n\tab1.'é\u00a0") for _ in range(r.randint(0, 40))) for _ in range(500)]
    for _ in range(2):
        assert enc.ids(odd) == [x.tobytes() for x in enc.whole(odd)]
    flat, n = enc.encode(pa.array([None, "a b", None, ""]))
    assert n.tolist() == [0, len(flat), 0, 0]
    assert tokens.Encoder.encode(enc, pa.array([], pa.string()))[1].tolist() == []


def test_coder_round_trip():
    r = np.random.default_rng(0)
    blocks = [r.integers(0, 65536, r.integers(1, 900)) for _ in range(20)] + [np.full(4096, 7), np.array([65535])]
    assert all((a == b).all() for a, b in zip(blocks, coder.decode_blocks(coder.encode_blocks(blocks), [len(b) for b in blocks])))
    (p,) = idfile.payloads([np.arange(10_000) % 50])
    assert (idfile.read_payloads([p])[0] == np.arange(10_000) % 50).all()
    for bad in (p[:-1], p + b"x", b"no" + p[2:], p[:200] + bytes([p[200] ^ 1]) + p[201:]):
        with pytest.raises(ValueError):
            idfile.read_payloads([bad])


def test_token_files(docs, empty, encoded):
    at = 0
    for r in sorted(idfile.round_trip(docs).collect()):
        want = np.array([*encoded[r.doc_id], 2], "<u4").tobytes()
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(want) // 4, want)
        at += r.n_tokens
    assert idfile.round_trip(empty).count() == 0


def test_packing(docs, empty, encoded):
    by, seqs = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, window=64).collect():
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, ids in encoded.items():
        all_ids, at = np.array([*ids, 1], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and bytes(r.ids) == all_ids[at : at + r.length].tobytes()
            at += r.length
        assert at == len(all_ids)
    for s, pieces in seqs.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r.length
        assert at == 64 or s == max(seqs)
    assert packing.pack(empty).count() == 0


def test_sharding(docs, empty, rows):
    got = sharding.interleave(docs, 7).collect()
    assert len(got) == len(rows) and {r.text for r in got} == {x[1] for x in rows}
    counts = defaultdict(lambda: defaultdict(int))
    slots = defaultdict(list)
    for r in got:
        counts[r.source][r.shard] += 1
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    for c in counts.values():
        assert max(c.values()) - min(c.get(s, 0) for s in range(7)) <= 2
    assert sharding.interleave(empty, 7).count() == 0


def test_shards_by_sql(spark, docs):
    import duckdb

    from stratavec.llm import queries

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    want = {r[0]: r for r in con.execute(f"SELECT doc_id, source, size, text_crc32, law, shard, slot, grown_shard FROM ({sharding.SQL})").fetchall()}
    got = {r.doc_id: tuple(r) for r in queries.op5_stratified_shards(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and len(got) == 200


def test_sharding_takes_rows_without_keys_and_clashing_columns(spark):
    table = spark.createDataFrame([(None, "a", f"t{i}", 9, "x") for i in range(50)] + [(7, "a", "same", 9, "y")] * 5 + [(None, None, None, None, None)] * 3, "doc_id long, source string, text string, shard int, slot string")
    got = sharding.interleave(table, 4).collect()
    assert sorted((r.text is None, r.text or "") for r in got) == sorted((r.text is None, r.text or "") for r in table.collect())
    assert sorted(c for c in got[0].asDict()) == ["doc_id", "shard", "slot", "source", "text"]
    sizes = [sum(r.shard == s for r in got) for s in range(4)]
    assert sorted(sizes) == [14, 14, 15, 15] and sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(4) for k in range(sizes[s])]


def brute_line_chunks(rows):
    seen, out = set(), {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out[i] = None
            continue
        lines = text.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        chunks, now = [], []
        for k, line in enumerate(lines):
            now.append(line)
            if k == len(lines) - 1 or (h[k] * 31 + (h[k - 1] if k else 0)) % 3 == 0:
                chunks.append(now)
                now = []
        kept = []
        for c in chunks:
            if len(c) > 1 and tuple(c) in seen:
                continue
            if len(c) > 1:
                seen.add(tuple(c))
            kept += c
        out[i] = "\n".join(kept)
    return out


def test_line_chunks(docs, empty, rows):
    got = {r.doc_id: r.text for r in linechunks.dedup(docs).collect()}
    assert got == brute_line_chunks(rows) and got[5] != rows[5][1]
    assert linechunks.dedup(empty).count() == 0


def test_line_columns_may_clash_and_long_texts_lose_many_chunks(spark):
    body = "\n".join(f"line {k // 2} {'x' * (k % 5)}" for k in range(20_000))
    table = spark.createDataFrame([(1, body, "kept", 5), (2, body + "\nend", "kept", 6), (None, "a", "kept", 7)], "doc_id long, text string, other string, lines int")
    got = {r.doc_id: r for r in linechunks.dedup(table).collect()}
    assert got[1].lines == 20_000 and got[2].lines == 20_001 and got[None].text == "a" and got[2].removed_lines > 15_000
    want = brute_line_chunks([(1, body), (2, body + "\nend")])
    assert {i: got[i].text for i in (1, 2)} == want


def brute_passages(rows, long_line=50):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines, gone = (t or "").split("\n"), set()
        spans = [(a, a + 2) for a in range(len(lines) - 1)] + [(a, a + 1) for a, x in enumerate(lines) if len(x.split()) >= long_line]
        for a, b in spans:
            w = tuple(lines[a:b])
            if w in seen and t is not None:
                gone |= set(range(a, b))
            seen.add(w)
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or kept.strip(" "):
            out.append((i, t if t is None else kept))
    return out


def test_line_stage_takes_short_repeated_passages(spark, rows):
    r = random.Random(8)
    line = lambda n=14: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passages = [[line() for _ in range(k)] for k in (2, 2, 2, 3, 3, 4, 5)] + [[line(60)]]
    texts = [(i, t) for i, t, *_ in rows]
    for i, p in enumerate(passages * 2):
        texts.append((100 + i, "\n".join([line(), line(), *p, line()])))
    texts += [(None, texts[-1][1] + "\nend"), (200, "\n".join(["x", "y"] * 3)), (201, "\n".join(passages[0]))]
    table = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts], SCHEMA).repartition(3)
    out = corpus_pipeline.dedup_lines(spark, table, "").collect()
    got = {x.doc_id: x.text for x in out}
    assert got == dict(brute_passages(texts)) and len(out) == len(got) and 201 not in got
    assert all(not any(x in got.get(108 + i, "").split("\n") for x in p) for i, p in enumerate(passages))
    assert all(x.n_chars == len(x.text) for x in out if x.text is not None)
    assert corpus_pipeline.dedup_lines(spark, table.limit(0), "").count() == 0


def test_line_stage_takes_chunks_without_the_check_after_them(spark, rows, monkeypatch):
    monkeypatch.setattr(linechunks, "_PAIRS", "filter(array(struct(0 as a, 0 as b, binary('') as d)), x -> false)")
    monkeypatch.setattr(linechunks, "_LONG", "filter(array(struct(0 as a, 0 as b, binary('') as d)), x -> false)")
    body = "\n".join(f"line {k} of many" for k in range(20))
    texts = [(i, t) for i, t, *_ in rows] + [(300, body), (301, f"begin\n{body}\nend")]
    table = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts], SCHEMA).repartition(3)
    got = {x.doc_id: x.text for x in corpus_pipeline.dedup_lines(spark, table, "").collect()}
    want = {i: t for i, t in brute_line_chunks(texts).items() if t is None or t.strip(" ") or t == dict(texts)[i]}
    assert got == want and len(want[301]) < len(body) / 2


def brute_components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(n)}


def test_simhash(docs, empty, rows, monkeypatch):
    import re

    import xxhash

    monkeypatch.setattr(graph, "CELL", 4)

    def fp(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sh = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    f = [fp(t) for _, t, *_ in rows]
    got = simhash.groups(docs).collect()
    assert {r.doc_id: r.fps[0] % (1 << 64) for r in got} == dict(enumerate(f))
    want = brute_components(len(f), lambda a, b: (f[a] ^ f[b]).bit_count() <= 4)
    assert {r.doc_id: r.component_id for r in got} == want
    assert simhash.groups(empty).count() == 0
    near = {r.doc_id: r.component_id for r in simhash.groups(docs, 5, 7, 4, jaccard=0.8, spare=64.0).collect()}
    assert near[5] == near[6] == 4 and near[12] == 12


def near_copies(n=120, words=200, edits=4, seed=7):
    """Copies of one text with a few words replaced, the text itself in the middle of the ids; most pairs of copies are below 0.8."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        if i != n // 2:
            for k in r.sample(range(words), edits):
                w[k] = f"x{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def brute_near(texts, shingle=5, least=0.8):
    sets = [set(simhash.shingle_hashes(t, shingle).tolist()) for t in texts]
    return brute_components(len(texts), lambda a, b: len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]))


@pytest.mark.parametrize("cell", [2048, 50])
def test_near_copies_whose_centre_is_not_the_least(spark, monkeypatch, cell):
    monkeypatch.setattr(graph, "CELL", cell)
    texts = near_copies()
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.groups(table, 5, 7, 4, jaccard=0.8, spare=64.0).collect()}
    want = brute_near(texts)
    assert set(want.values()) == {0} and got == want


def test_overlaps(monkeypatch):
    rng = np.random.default_rng(4)
    for few in (32, 3):
        monkeypatch.setattr(graph, "FEW", few)
        sets = [np.unique(rng.integers(0, 60, k)) for k in (0, 5, 20, 40, 60, 60, 1, 0)] * 2
        got = graph.overlaps(sets)
        assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(16) for j in range(16) if i != j)


def test_equal_fingerprints_alone_are_no_copies(spark):
    fill = " a" * 500
    texts = [" ".join(f"{c}{i}" for i in range(300)) + fill for c in "pqr"]
    texts += [texts[0], texts[0] + " a a", texts[1] + " z"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.groups(table, 5, 7, 4, jaccard=0.8, spare=64.0).collect()}
    assert got == brute_near(texts) == {0: 0, 1: 1, 2: 2, 3: 0, 4: 0, 5: 1}


def test_pairs_just_above_the_least_similarity_are_found(spark):
    r = random.Random(11)
    texts = []
    for _ in range(60):  # one word in the middle and a new end: similarity 0.80 to 0.83
        w = [f"w{r.randrange(10**6)}" for _ in range(120)]
        v = w[:50] + ["new"] + w[51:112] + [f"x{r.randrange(10**6)}" for _ in range(r.randint(3, 5))]
        texts += [" ".join(w), " ".join(v)]
    want = brute_near(texts)
    assert sum(i != c for i, c in want.items()) == 60
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = corpus_pipeline.dedup_documents(spark, table.selectExpr("doc_id", "text", "'en' lang", "'a' source", "1L n_chars"), "")
    assert {x.doc_id for x in out.collect()} == {i for i, c in want.items() if i == c}


def test_document_stage_keeps_null_ids_and_takes_rows_of_an_id_together(spark):
    r = random.Random(2)
    p, q, s = (" ".join(f"{c}{r.randrange(10**6)}" for _ in range(60)) for c in "pqs")
    rows = [(1, p), (2, p), (3, q), (None, p), (None, s), (None, None), (4, None), (5, ""), (7, s), (7, q + " x"), (8, s)]
    table = spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], SCHEMA)
    out = corpus_pipeline.dedup_documents(spark, table, "").collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.text or "") for x in out) == sorted([(False, 1, p), (False, 3, q), (True, 0, p), (True, 0, s), (True, 0, ""), (False, 4, "")])
    assert corpus_pipeline.dedup_documents(spark, table.limit(0), "").count() == 0


@pytest.mark.parametrize("distance", [2, 4, 7])
def test_block_keys_find_every_pair(distance):
    r = random.Random(3)
    for n in (10, 10**6, 10**9):
        keys = simhash.block_keys(n, distance)
        for _ in range(200):
            bits = sum(1 << k for k in r.sample(range(64), distance))
            assert any(bits & m == 0 for m in keys)


def test_forest(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELL", 16)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 16))
    x[100:140] = x[100] + 0.05 * rng.standard_normal((40, 16))
    x[200:205] = x[200]
    data = [(i, [float(z) for z in v]) for i, v in enumerate(x.astype(np.float32))] + [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] * 16), (304, [1.0])]
    got = {r.vec_id: r for r in rpforest.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>"), leaf=40).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    want = brute_components(300, lambda a, b: s[a, b])
    assert len(got) == 305 and all(got[i].n_links == s[i].sum() and got[i].component_id == want[i] for i in range(300))
    assert all(got[i].n_links == 0 and got[i].kept for i in range(300, 305))
    assert rpforest.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_trees_go_on_below_a_small_sample(spark, monkeypatch):
    monkeypatch.setattr(rpforest, "SAMPLE", 200)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 1200, 2):  # pairs just above the threshold
        e = rng.standard_normal(48)
        e -= (e @ x[i]) * x[i]
        c = rng.uniform(0.951, 0.96)
        x[i + 1] = c * x[i] + np.sqrt(1 - c * c) * e / np.linalg.norm(e)
    s = x @ x.T >= 0.95
    np.fill_diagonal(s, False)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in rpforest.near_duplicates(table, leaf=40).collect()}
    assert all(got[i] <= s[i].sum() for i in range(3000)) and sum(got.values()) >= 0.99 * s.sum() and s.sum() >= 1200
    sample = x[:200]
    tree = rpforest.grow(sample, 15.0, 40, 0.02, rng)
    below = rng.standard_normal((rpforest.DEEP, 48))
    below /= np.linalg.norm(below, axis=1, keepdims=True)
    rows, leaves = rpforest.route(tree, below, x, 0.0)
    assert sorted(rows.tolist()) == list(range(3000)) and np.unique(leaves, return_counts=True)[1].max() < 400


def test_rows_of_an_id_are_one_document(spark):
    a, b = " ".join(f"p{i}" for i in range(40)), " ".join(f"q{i}" for i in range(40))
    table = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (11, "z y x w v"), (None, a)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.groups(table).collect())
    assert got == [(0, 0), (3, 3), (5, 3), (5, 3), (9, 3), (11, 11)]


def brute_substrings(rows, length=50):
    least = {}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            least[s] = min(least.get(s, i), i)
    out = {}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if least[raw[k : k + length]] < i:
                gone[k : k + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1])), kept)
    return out


def test_substrings(docs, empty, rows):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in substrings.dedup(docs).collect()}
    assert got == brute_substrings(rows)
    assert substrings.dedup(empty).count() == 0


def test_substrings_of_hot_anchors(spark, rows, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 1)
    monkeypatch.setattr(substrings, "SAMPLED", 1)
    r = random.Random(3)
    line = "this line stands in every one of the documents, and around it all is different;"
    more = [(1000 + i, f"{r.random()} {line} {r.random()}" * (1 + i % 2), "", "", 0) for i in range(40)] + [(2000, "ab" * 400, "", "", 0), (2001, "xab" + "ab" * 300 + "x", "", "", 0)]
    table = [x[:2] for x in rows + more]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in substrings.dedup(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_substrings(table)


def test_snippets_of_hot_anchors_are_not_joined_again(spark, rows, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 1)
    monkeypatch.setattr(substrings, "SAMPLED", 1)
    written, materialize = {}, substrings.materialize

    def noted(df, name, *a, **k):
        written[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return materialize(df, name, *a, **k)

    monkeypatch.setattr(substrings, "materialize", noted)
    table = [x[:2] for x in rows]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in substrings.dedup(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_substrings(table)
    assert "snippets" in written and not [name for name, plan in written.items() if "LeftAnti" in plan]
    assert written["anchors-by-text"].count("MapInArrow") == 3  # texts are hashed once


@pytest.mark.parametrize("length", [16, 33, 50, 80])
def test_anchors_are_placed(length):
    r = random.Random(1)
    raws = [bytes(r.choices(b"abcdefgh ", k=r.randrange(300))) + b"ab" * r.randrange(50) + b"HELLO " * r.randrange(20) + bytes(r.choices(b"abcdefgh ", k=r.randrange(200))) for _ in range(60)]
    grams = [substrings.mixed(substrings.grams(np.frombuffer(x, np.uint8), 16)).view(np.int64).tolist() if len(x) > 15 else [] for x in raws]
    for owner, h, first, last, place, mark in zip(*(x.tolist() for x in substrings.marked(raws, length))):
        for window in range(first, last + 1):
            at = grams[owner].index(h, window)
            assert mark == -1 or at == place and (mark >> 32 if at - window >= substrings.middle(length) else mark & 0xFFFFFFFF)


def test_repeated_anchors_are_told_whatever_the_batches():
    r = random.Random(5)
    found = sorted((r.randrange(60) ** 2 // 40, r.randrange(9), r.choice([-1, *(a << 32 | b for a in range(4) for b in range(4))] if r.random() < 0.1 else [1 << 32 | r.randrange(9), r.randrange(9) << 32])) for _ in range(900))
    want = set()
    for h in {x[0] for x in found}:
        mine = [(row, mark) for x, row, mark in found if x == h]
        texts = {row for row, _ in mine}
        if len(texts) < 2:
            continue
        if any(mark == -1 for _, mark in mine):
            want |= {(row, h) for row in texts}
            continue
        for k, part in enumerate((lambda m: m >> 32, lambda m: m & 0xFFFFFFFF)):
            for v in {part(m) for _, m in mine} - {0}:
                who = [(row, m) for row, m in mine if part(m) == v]
                if len({row for row, _ in who}) > 1:
                    want |= {(row, int(substrings.sided(np.array([h]), np.array([m]))[k][0])) for row, m in who}
    for step, most in ((7, 1), (100, 5_000), (900, 1 << 20)):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found[i : i + step])], ["h", "row", "mark"]) for i in range(0, 900, step)]
        got = [x for now in substrings.whole_keys(iter(batches), most) for x in zip(*(c.tolist() for c in substrings.shared(*(now.column(c).to_numpy() for c in range(3)), 1000, 1)))]
        assert len(got) == len(set(got)) and {x[:2] for x in got} == want and not any(x[2] for x in got)
    assert any(substrings.shared(*(np.array(c) for c in zip(*found)), 5, 1)[2])
    assert list(substrings.whole_keys(iter([]), 1)) == []


def test_substrings_keep_few_snippets_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SMALL", 1, raising=False)
    monkeypatch.setattr(substrings, "SHARE", 0.3, raising=False)
    written, materialize = [], substrings.materialize

    def noted(df, name, *a, **k):
        out = materialize(df, name, *a, **k)
        if name == "snippets":
            written.append(out.agg(F.sum(F.octet_length("snip"))).first()[0] or 0)
        return out

    monkeypatch.setattr(substrings, "materialize", noted)
    r = random.Random(3)
    passages = ["".join(r.choices("abcdefgh ", k=400)) for _ in range(60)]
    table = [(i, f"{i} ".join(r.choices(passages, k=8))) for i in range(60)]  # almost every anchor is repeated
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in substrings.dedup(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_substrings(table)
    size = sum(len(t) for _, t in table)
    assert sum(written) > 2 * size and max(written) < 0.5 * size


def test_substrings_of_repeated_and_missing_ids(spark):
    long = "a passage of more than fifty bytes that comes again and again in this table"
    table = [(4, long), (4, long), (4, "x" + long), (None, long), (None, long), (7, long + "!"), (9, None), (9, "")]
    got = sorted((r.doc_id or 99, r.n_bytes, r.n_removed) for r in substrings.dedup(spark.createDataFrame(table, "doc_id long, text string")).collect())
    n = len(long)
    assert got == sorted([(4, n, 0), (4, n, 0), (4, n + 1, 0), (99, n, n), (99, n, n), (7, n + 1, n), (9, 0, 0), (9, 0, 0)])


def test_jpeg_round_trip_and_damage(docs, empty, rows):
    r = np.random.default_rng(0)
    payloads = [bytes(64), b"\xff" * 128, r.integers(0, 256, 64 * 40, dtype=np.uint8).tobytes()]
    media = jpeg.store(payloads)
    assert [b"".join(g.tobytes() for _, _, g in m) for m in jpeg.thumbnails(media)] == payloads
    for bad in (media[0][:-2], media[0] + b"x", b"", media[2][:400]):
        with pytest.raises(ValueError):
            jpeg.thumbnails([bad])
    for x in jpeg.describe(jpeg.with_media(docs)).collect():
        raw = (rows[x.doc_id][1] or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert jpeg.describe(jpeg.with_media(empty)).count() == 0


def test_long_payload_takes_more_images():
    p = bytes(range(256)) * (64 * 8200 // 256)
    (images,) = jpeg.thumbnails(jpeg.store([p]))
    assert len(images) == 2 and b"".join(g.tobytes() for _, _, g in images) == p


def test_mixing_meets_its_targets(spark, docs, empty):
    labels = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(0, 60, 2)] + [(i, "x") for i in range(1, 60, 2)], "doc_id long, domain string")
    domains, post = mixing.posteriors(docs.select("doc_id", "text"), labels)
    w = mixing.tempered(post, len(domains), 0.5)
    fit = mixing.fit_rates(post, w)
    target = fit.target
    assert fit.converged
    x = [(r.n_tokens, r.p, r.rate) for r in fit.rates.collect()]
    assert all(r >= 0 and abs(sum(p) - 1) < 1e-9 for _, p, r in x)
    for d, t in enumerate(target):
        assert sum(n * p[d] * r for n, p, r in x) == pytest.approx(t, rel=1e-4)
    assert mixing.mix(docs, labels).count() == docs.count()
    assert mixing.mix(empty, labels).count() == 0


def test_rates_stay_nonnegative_when_a_target_is_zero(spark):
    post = spark.createDataFrame([(i, 1, 10, [p, 1 - p]) for i, p in enumerate([0.1, 0.5, 0.9])], "_key long, _times long, n_tokens long, p array<double>")
    r = [x.rate for x in mixing.fit_rates(post, [1.0, 0.0], rounds=200).rates.orderBy("_key").collect()]
    assert min(r) == 0 and r[2] > 0


@pytest.mark.parametrize("whole", [64, 2])
def test_hard_targets_are_met(spark, monkeypatch, whole):
    monkeypatch.setattr(mixing, "GRAM", whole)
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.2] * 8, 400)
    n = rng.integers(50, 500, 400)
    post = spark.createDataFrame([(i, 1, int(k), x.tolist()) for i, (k, x) in enumerate(zip(n, p))], "_key long, _times long, n_tokens long, p array<double>").coalesce(1).cache()
    fit = mixing.fit_rates(post, [0.6] + [0.4 / 7] * 7, tolerance=1e-3)
    r = np.array([x.rate for x in fit.rates.orderBy("_key").collect()])
    got = (r * n) @ p
    assert fit.converged and r.min() >= 0 and np.abs(got - fit.target).sum() <= 1e-3 * n.sum() and np.allclose(got, fit.reached)
    none = mixing.fit_rates(post.withColumn("p", F.concat("p", F.array(F.lit(0.0)))), [0.1] * 9, rounds=60, tolerance=1e-3)
    assert not none.converged and none.reached[8] == 0


def test_toxicity(spark, docs, empty):
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    r = random.Random(1)
    data = [(i, " ".join(r.choice(words) for _ in range(30)) + (" stupid idiot" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(240)]
    table = spark.createDataFrame(data, "doc_id long, text string, toxic int").union(spark.createDataFrame([(900, "bal 1d10t dem", 0), (901, "bal s-t-u-p-i-d", 0), (902, "bal i d i o t dem", 0), (903, None, 0), (904, "", 0), (905, "ball stuuupid", 0), (906, "bal dem gor", 0)], "doc_id long, text string, toxic int"))
    labels = table.where("doc_id < 900").where(~toxicity.held_out()).select("doc_id", "toxic")
    got = {x.doc_id: x.score for x in toxicity.score(table.select("doc_id", "text"), labels).collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, _, y in data)
    assert all(got[i] >= 0.7 for i in (900, 901, 902, 905)) and max(got[903], got[904], got[906]) < 0.1
    assert toxicity.score(empty, labels).count() == 0


def test_toxicity_in_long_disguises(spark):
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnr"]
    r = random.Random(1)
    data = [(i, " ".join(r.choice(words) for _ in range(30)) + (" stupid idiot" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(240)]
    calm = "bal dem gor fil dun bem gal fur dom bir gel fam dor bun"
    hidden = ["y o u i d i o t", "b a l  d e m  i d i o t", " ".join((calm + "idiot").replace(" ", "")), " ".join((calm + "stupid" + calm).replace(" ", "")), "s" + "t" * 60 + "upid", "i-d-i-" + "o" * 50 + "-t", " ".join("b" * 30 + "1d10t")]
    clean = [" ".join(calm.replace(" ", "")), "a " * 400, "9f" * 30 + "0", "ab0" * 5000, "x" * 90]
    table = spark.createDataFrame(data + [(1000 + i, f"bal {t} dem", 0) for i, t in enumerate(hidden)] + [(2000 + i, f"bal {t} dem", 0) for i, t in enumerate(clean)], "doc_id long, text string, toxic int")
    labels = table.where("doc_id < 900").where(~toxicity.held_out()).select("doc_id", "toxic")
    got = {x.doc_id: x.score for x in toxicity.score(table.select("doc_id", "text"), labels).collect()}
    assert [k for k in range(len(hidden)) if got[1000 + k] < 0.7] == []
    assert [k for k in range(len(clean)) if got[2000 + k] > 0.1] == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 10), (10, 11), (11, 12), (3, 40), (7, 7), (12, 50), (50, 60)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 40: 1, 7: 7, 9: 9, 10: 9, 11: 9, 12: 9, 50: 9, 60: 9}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_linked_pairs_and_tree_against_all_pairs():
    from stratavec.llm import graph

    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, 300)
    cuts = np.r_[0, np.sort(rng.choice(np.arange(1, 300), 40, replace=False)), 300]
    k, i, j = graph.linked_pairs(cuts[:-1], cuts[1:], lambda a, b: np.abs(x[a] - x[b]) <= 1)
    want = {(n, a, b) for n, (s, e) in enumerate(zip(cuts, cuts[1:])) for a in range(s, e) for b in range(a + 1, e) if abs(x[a] - x[b]) <= 1}
    assert len(k) == len(want) and set(zip(k.tolist(), i.tolist(), j.tolist())) == want
    assert all(len(p) == 0 for p in graph.linked_pairs(np.zeros(0, int), np.zeros(0, int), lambda a, b: a == b))
    for n, share in ((1, 0.5), (40, 0.02), (40, 0.05), (60, 0.9)):
        links = rng.random((n, n)) < share
        links |= links.T
        child, parent = graph.tree(links)
        label = graph.spanning(links)
        assert links[child, parent].all() and len(child) == n - len(set(label.tolist()))
        joined = np.zeros((n, n), bool)
        joined[child, parent] = joined[parent, child] = True
        assert (graph.spanning(joined) == label).all()


def test_stars_connect_what_pairs_connect():
    rng = np.random.default_rng(6)
    for n, m in ((1, 0), (50, 30), (400, 350), (300, 3000)):
        a, b = rng.integers(0, n, (2, m)) * 7
        x, y = graph.stars(a, b)
        links = [(p, q) for p, q in zip(a.tolist(), b.tolist())]
        want = brute_components(n, lambda i, j, s=set(links) | {(q, p) for p, q in links}: (7 * i, 7 * j) in s)
        assert dict(zip(y.tolist(), x.tolist())) == {7 * i: 7 * c for i, c in want.items() if i != c}


def test_anchors_of_joined_texts_equal_those_of_each():
    from stratavec.llm import substrings

    raws = [b"", b"x" * 49, b"ab" * 60, bytes(range(60, 120)) * 3, b"", bytes(range(60, 120)) * 2, b"q" * 50]
    owner, h, a, b = substrings.anchors(raws)
    for n, raw in enumerate(raws):
        alone = substrings.anchors([raw])
        for one, joined in zip(alone[1:], (h, a, b)):
            assert one.tolist() == joined[owner == n].tolist()
    assert list(substrings.pieces([])) == [] and list(substrings.pieces([0] * 3)) == [(0, 3)]
    much = substrings.PIECE
    assert list(substrings.pieces([much, 1, much + 1, 0])) == [(0, 1), (1, 2), (2, 3), (3, 4)]
