"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = "the of and tion here there stone river Über straße, idiot! 42 don't *** one's".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket int"


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    shared = " ".join(rng.choice(WORDS) for _ in range(40))
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60)))
        text = shared + text if i % 5 == 0 else text
        text = {3: None, 4: "", 7: " \n", 8: rows[6][1] if i == 8 else None}.get(i, text)
        rows.append((i * 3, text, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(text or ""), 0.5, 1))
    rows.append((999, "stone river " * 3000, "en", "a", 36000, 0.5, 1))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def encoded():
    from tokenizers import Tokenizer

    from geosieve.llm.tokens import default_tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return {r[0]: t.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in corpus()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pack(spark, docs, empty):
    from geosieve.llm.packing import pack

    ids = encoded()
    rows = pack(docs, share_tokens=4096).collect()
    assert all(crc(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for r in rows)
    seen = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == seen.get(r["sequence_id"], 0)
        seen[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in seen.values()) and sum(seen.values()) == sum(map(len, ids.values()))
    twice = pack(docs.union(docs)).agg(F.sum("length")).first()[0]
    assert twice == 2 * sum(map(len, ids.values())) and pack(empty).count() == 0


def test_pack_for_the_last_time_gives_the_tokenizer_back(spark, docs):
    def run(batches):
        import pyarrow as pa

        from geosieve.llm import tokens

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(tokens._encoders)]})

    from geosieve.llm import packing

    rows = lambda df: sorted(map(tuple, df.drop("ids").collect()))
    assert rows(packing.pack(docs, last_use=True)) == rows(packing.pack(docs))
    cut = packing._cut(1, last_use=True)

    def used(batches):
        from geosieve.llm import tokens

        tokens.encoder(tokens.default_tokenizer())
        list(cut(iter(())))
        yield from run(batches)

    assert {r["n"] for r in docs.select("doc_id").coalesce(1).mapInArrow(used, "n long").collect()} == {0}


def test_every_window_holds_the_mix(spark):
    from geosieve.llm.packing import SLICE_TOKENS, pack

    rng = random.Random(4)
    share = {"a": 40, "b": 30, "c": 20, "d": 9, "e": 1}
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(50, 150))), s) for i, s in enumerate(s for s, n in share.items() for _ in range(n * 4))]
    pieces = pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), window=512, share_tokens=8192).toPandas()
    part = pieces.groupby("source_no")["length"].sum() / pieces["length"].sum()
    full = pieces.groupby("sequence_id")["length"].sum() == 512
    got = pieces.groupby(["sequence_id", "source_no"])["length"].sum().unstack(fill_value=0)[full]
    assert len(got) > 50
    # A source may owe, or be owed, about a slice at either end of a window; over all windows so far that doesn't grow.
    assert ((got - part * 512).abs() <= 2 * SLICE_TOKENS + 1).all().all()
    whole = got.cumsum()
    assert ((whole.sub(whole.sum(axis=1), axis=0).add(whole.sum(axis=1), axis=0) - np.outer(whole.sum(axis=1), part)).abs() <= SLICE_TOKENS + 2).all().all()


def test_token_files(spark, docs, empty, tmp_path):
    from geosieve.llm.token_files import read_token_files, token_digest, write_token_files

    ids, at = encoded(), 0
    write_token_files(docs, str(tmp_path / "t"))
    got = {r["doc_id"]: r for r in token_digest(spark, str(tmp_path / "t")).collect()}
    for d in sorted(ids):
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (at, len(ids[d]), crc(ids[d]))
        at += len(ids[d])
    assert read_token_files(spark, str(tmp_path / "t"), [9]).first()["tokens"] == [1]
    write_token_files(empty, str(tmp_path / "e"))
    assert token_digest(spark, str(tmp_path / "e")).count() == 0


def test_encoder_equals_library():
    from geosieve.llm.tokens import default_tokenizer, encoder

    e, rng = encoder(default_tokenizer()), random.Random(2)
    parts = ["a", "É", "é", "Σ", "'s", "'", "12", "“", ",", "<|endoftext|>", " ", " ", "\x1c", "ß", "中文", "!!", "don't", "é!", "\t", "_"]
    for _ in range(2000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        assert e.encode(x.encode()).tolist() == e.lib.encode(x, add_special_tokens=False).ids


def test_near_duplicates(spark, docs, empty):
    import xxhash

    from geosieve.llm.simhash import GrayIndex, deduplicated, near_duplicates

    def fp(text):
        w = (text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    rows = {r["doc_id"]: r for r in near_duplicates(docs).collect()}
    fps = {r[0]: fp(r[1]) for r in corpus()}
    assert all(rows[d]["fp"] % (1 << 64) == f for d, f in fps.items())
    label = {d: d for d in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    label[a] = min(label[a], label[b])
    assert {d: r["component_id"] for d, r in rows.items()} == label
    assert deduplicated(docs.union(docs)).count() == len(set(label.values())) and near_duplicates(empty).count() == 0
    rng = np.random.default_rng(3)
    near = np.unique(np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 400, np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, np.uint64)))
    assert len(GrayIndex(near).forest(4)) == len(near) - 1


def test_repeats(spark, docs, empty):
    from geosieve.llm.repeats import deduplicated, digests, without_repeats

    first, want = {}, {}
    for d, text, *_ in sorted(corpus(), key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first.setdefault(b[j : j + 50], d) < d:
                gone[j : j + 50] = b"\1" * 50
        want[d] = (len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in digests(without_repeats(docs)).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 0
    # Triggers dealt with half of their context give the same.
    assert {r["doc_id"]: tuple(r)[1:] for r in digests(without_repeats(docs, hot_batches=1)).collect()} == want
    assert deduplicated(docs).count() == docs.count() and without_repeats(empty).count() == 0


def test_winnow(spark, docs, empty):
    from geosieve.llm.winnowing import edited_fingerprints, winnow

    rows, texts = {r["doc_id"]: r for r in edited_fingerprints(docs).collect()}, {r[0]: r[1] or "" for r in corpus()}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        t, nxt = texts[d], texts[order[(i + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert rows[d]["n_chars"] == len(t) and rows[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[d]["near_edited"] <= 1 and (nxt != t or rows[d]["near_next"] == 1)
    assert edited_fingerprints(empty).count() == 0 and winnow(docs.where("doc_id = 9")).first()["selected"][0]["position"] == 0


def test_winnow_of_short_texts(spark):
    import xxhash

    from geosieve.llm.winnowing import K, W, edited_fingerprints

    def selected(b):
        signed = lambda h: h - (h >> 63 << 64)
        grams = [signed(xxhash.xxh64_intdigest(b[i : i + K], 42)) >> 16 for i in range(max(1, len(b) - K + 1))]
        ends = range(min(W, len(grams)), len(grams) + 1)
        return sorted({min((h, -i) for i, h in enumerate(grams[max(e - W, 0) : e], max(e - W, 0)))[::-1] for e in ends}, reverse=True)

    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(4, 9)))
    texts = {i: " ".join(word() for _ in range(i % 20 + 1)) for i in range(60)}
    texts |= {60 + i: "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(40)) for i in range(10)}
    texts |= {70 + i: "".join(rng.choice(letters) for _ in range(60)) for i in range(10)} | {80: "", 81: "é", 82: "ab" * 20000}
    rows = {r["doc_id"]: r for r in edited_fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for d, t in texts.items():
        nxt, cut = texts[(d - 1) % len(texts)], len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        own, other, after = (selected(x.encode()) for x in (t, edited, nxt))
        for at, name, want in (("positions", "hashes", own), ("edited_positions", "edited_hashes", other)):
            assert rows[d][at] == [-p for p, _ in want] and rows[d][name] == [h for _, h in want]
        for name, x in (("near_edited", other), ("near_next", after)):
            a, b = {h for _, h in own}, {h for _, h in x}
            assert rows[d][name] == pytest.approx(len(a & b) / len(a | b))
    # Two thirds of each text stay; from four words on, and without spaces, that shows.
    assert all(rows[d]["near_edited"] > 0 for d in texts if len(texts[d].encode()) >= 40)


def test_mix(spark, docs, empty):
    from geosieve.llm.mixing import mix, mixed_documents

    rows = mix(docs).collect()
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.5 and own[0]["target"] <= 2 * own[0]["source_size"]
    assert sum(r["taken"] for r in rows) == pytest.approx(1.5 * sum(r["size"] for r in rows), abs=3)
    assert sorted(map(tuple, mix(docs.repartition(3)).collect()), key=str) == sorted(map(tuple, rows), key=str)
    words = mixed_documents(docs).select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words == sum(r["taken"] for r in rows) and mix(empty).count() == 0


def test_stages_with_null_and_repeated_ids(spark):
    from collections import Counter

    from geosieve.llm.mixing import mix, mixed_documents
    from geosieve.llm.repeats import deduplicated

    rng = random.Random(5)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    shared = fresh(12)
    ids = [1, 2, 2, 3, 3, *[None] * 8]
    texts = [shared, *(fresh(6 + i) + " " + shared for i in range(12))]
    texts[4] = texts[3]
    rows = [(d, t, "en", "a", len(t), 0.5, 1) for d, t in zip(ids, texts)] + [(None, texts[-1], "en", "a", len(texts[-1]), 0.5, 1)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    least: dict = {}
    last = lambda d: 10**9 if d is None else d
    for d, t, *_ in rows:
        for j in range(len(t) - 49):
            least[t[j : j + 50]] = min(least.get(t[j : j + 50], last(d)), last(d))

    def left(d, t):
        starts = [j for j in range(len(t) - 49) if least[t[j : j + 50]] < last(d)]
        return "".join(c for i, c in enumerate(t) if not any(j <= i < j + 50 for j in starts))

    got = Counter((r["doc_id"], r["text"]) for r in deduplicated(table).collect())
    assert got == Counter((d, left(d, t)) for d, t, *_ in rows) and all(shared not in t for d, t in got if d != 1)
    # Each text comes as often as mix() takes rows of its id and size, one copy cut at most.
    out = Counter((r["doc_id"], r["text"]) for r in mixed_documents(table).collect())
    for d, t, *_ in rows:
        n, times = len(t.split()), sum(r[:2] == (d, t) for r in rows)
        assert times <= out[d, t] <= 2 * times
    assert sum(len(t.split()) * n for (_, t), n in out.items()) == mix(table).agg(F.sum("taken")).first()[0]


def test_shards(spark, docs, empty):
    from geosieve.llm.sharding import shard

    rows = shard(docs.where("doc_id < 900").union(docs.where("doc_id < 9")), 4).collect()
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["text_crc32"] == zlib.crc32(x.encode()) for r in rows for x in [{c[0]: c[1] or "" for c in corpus()}[r["doc_id"]]])
    assert shard(empty, 4).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        shard(docs, 12)


def test_shards_are_leaves_of_a_tree_over_metadata(spark):
    from geosieve.llm.sharding import DIMENSIONS, metadata, shard, split_points

    rng = random.Random(6)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    texts[200:700] = [texts[0]] * 500  # a third of all rows are copies
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice("pqrstuvw")) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = shard(table, 8).collect()
    total = sum(r["size"] for r in got)
    by = {s: sum(r["size"] for r in got if r["shard"] == s) for s in range(8)}
    largest = max(r["size"] for r in got)
    assert len(got) == 1500 and all(abs(b - total / 8) <= 3 * largest + 0.002 * total for b in by.values())
    tree = split_points(metadata(table), total / 8)
    assert len(tree) == 7 and tree[0]["dimension"] == "source" and {n["dimension"] for n in tree} <= set(DIMENSIONS)
    # Each row lies where a walk down the tree leads, by its group's least source, language and doc_id.
    meta = {(r["doc_id"]): r.asDict() for r in metadata(table).collect()}
    for r in got:
        node = 0
        while node < 7:
            node = 2 * node + (1 if meta[r["doc_id"]][tree[node]["dimension"]] <= tree[node]["cut"] else 2)
        assert node - 7 == r["shard"]
    # Equal texts stay in one shard but where a cut had to fall into their group.
    assert all(len({r["shard"] for r in got if r["text_crc32"] == c}) == 1 for c in {r["text_crc32"] for r in got} - {zlib.crc32(texts[0].encode())})


def test_neighbours(spark):
    from geosieve.llm.neighbours import nearest

    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8))
    x[50:80] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [None] * 8)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 20).orderBy("query_id", "rank").collect()
    for q in range(0, 300, 20):
        s = x @ x[q]
        s[q] = -np.inf
        kth = np.sort(s)[-20]
        own = [r for r in got if r["query_id"] == q]
        assert len(own) == 20 and np.mean([r["score"] >= kth - 1e-9 for r in own]) >= 0.9
    assert nearest(spark.createDataFrame(rows[300:], "vec_id long, embedding array<double>")).count() == 0


def test_neighbours_over_cells(spark):
    from geosieve.llm.neighbours import nearest, search

    rng = np.random.default_rng(2)
    centres = rng.standard_normal((24, 16)) * 3
    x = centres[rng.integers(0, 24, 2400)] + rng.standard_normal((2400, 16)) * 0.3
    x[500:1300] = x[500]  # a third of all rows are one vector
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(2400)
    got = nearest(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>"), 20, 20, cell_rows=200).toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        assert list(own.sort_values("rank")["vec_id"]) == [v for _, v in sorted(zip(-own["score"], own["vec_id"]))]
        hits += (own["score"] >= np.sort(s)[-20] - 1e-9).sum()
    assert len(got) == 120 * 20 and hits >= 0.9 * len(got)
    _, _, verified = search(x[::20], ids[::20], x, ids, 1.0, 20)
    assert verified < 0.5 * 120 * 2400  # clusters are told apart by their projections


def test_neighbours_cost_of_a_pair(monkeypatch):
    """Where nothing can be pruned, products of blocks tell most pairs, and a cell returns no more than what a query's own cell left open."""
    from geosieve.llm import neighbours

    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, summed, plain = np.arange(3000), [], np.einsum
    monkeypatch.setattr(neighbours.np, "einsum", lambda how, a, b, **more: summed.append(len(a)) or plain(how, a, b, **more))
    own, _, verified = neighbours.search(x[::20], ids[::20], x[:1500], ids[:1500], 1.0, 20)
    assert verified > 0.5 * 150 * 1500 and sum(summed) < 0.5 * verified
    summed.clear()
    got, names, verified = neighbours.search(x[::20], ids[::20], x[1500:], ids[1500:], 1.0, 20, 2 - 2 * own[:, -1])
    assert verified > 0.4 * 150 * 1500 and sum(summed) < 0.1 * verified
    assert ((got > -np.inf) <= (got >= own[:, -1:] - 1e-6)).all()
    hits = 0
    for i, q in enumerate(range(0, 3000, 20)):
        s = x @ x[q]
        s[q] = -np.inf
        hits += (np.concatenate([own[i], got[i]]) >= np.sort(s)[-20] - 1e-9).sum()
        real = got[i] > -np.inf
        assert np.allclose(got[i][real], s[names[i][real]], rtol=0, atol=1e-12)
    assert hits >= 0.9 * 150 * 20


def test_classifiers(spark, docs, empty):
    from geosieve.llm.language import language
    from geosieve.llm.quality import quality

    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    for rows in (quality(docs, labels).collect(), language(docs.union(docs)).collect()):
        assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) in (61, 122)
    assert {r["lang_pred"] for r in language(docs).where("doc_id IN (9, 12, 21)").collect()} == {"und"}
    assert quality(empty, labels).count() == 0 and language(empty).count() == 0
