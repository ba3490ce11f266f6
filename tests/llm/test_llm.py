"""The ten operators and the pipeline against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from photarium.llm import decontamination, embeddings, language, packing, pii, queries, secrets, sharding, simhash, token_files, tokens, toxicity

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "", "en", "s", 0), (2, None, None, None, None), (3, "one two", "en", "s", 7), (3, "one two", "en", "s", 7), (None, "mail a.b@c.de now", "en", None, 1), (5, "x" * 200_000, "fr", "s", 5), (6, "word " * 40_000, "en", "s", 9)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with clashing names."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("clash") for c in ("score", "fp", "key", "pii", "terms", "h", "row", "part", "w0", "_", "rest", "row_key", "gone_key", "repeat_key")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").cache()


def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def test_sharding(spark, docs, odd):
    for df in (docs, odd, docs.limit(0)):
        rows = sharding.shard_by_bytes(df).orderBy("shard", "slot").collect()
        assert len(rows) == df.count()
        for s in {r["shard"] for r in rows}:
            assert [r["slot"] for r in rows if r["shard"] == s] == list(range(sum(r["shard"] == s for r in rows)))
    rows = sharding.shard_by_bytes(docs).collect()
    want = texts(docs)
    assert all(r["size"] == len(want[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(want[r["doc_id"]].encode()) for r in rows)
    size = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows], 16)
    assert size.max() - size.min() <= 2 * max(r["size"] for r in rows)


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(prints):
    label = list(range(len(prints)))
    for _ in prints:
        new = [min(label[j] for j, y in enumerate(prints) if (x ^ y).bit_count() <= 2) for x in prints]
        if new == label:
            return label
        label = new


def test_simhash_components(docs, odd):
    want = texts(docs)
    got = {r["doc_id"]: r for r in simhash.near_duplicate_components(docs).collect()}
    ids = sorted(want)
    prints = [brute_simhash(want[i]) for i in ids]
    assert [got[i]["fingerprint"] for i in ids] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in ids] == [ids[k] for k in components(prints)]
    rows = simhash.near_duplicate_components(odd).collect()
    assert len(rows) == len(ODD) and {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert simhash.near_duplicate_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cell", [256, 3])
def test_fingerprint_links(spark, cell):
    """Both routes, small cells and neighbour values, connect the same."""
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(25)]
    for _ in range(120):
        x = rng.choice(prints)
        prints.append(x ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 4))))
    prints = sorted(set(prints))
    from photarium.operators.graph import connected_components

    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "fp long")
    got = {r["vertex"] % (1 << 64): r["component"] % (1 << 64) for r in connected_components(df, simhash.fingerprint_links(df, cell)).collect()}
    want = components(prints)
    assert len(set(want)) == len(set(got.values())) and len({(got[p], w) for p, w in zip(prints, want)}) == len(set(want))


def test_containment(spark, docs, odd):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, "one two"), (3, None), (4, "")], "item_id long, text string")
    more = docs.select("doc_id", "text").limit(0).union(spark.createDataFrame([(10, "zz A, b c d e f g h i j k l m n!"), (11, "b c d e f g h i j k l m n"), (12, "a b c d e f g"), (13, "One... TWO")], "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"], r["shared"]) for r in decontamination.contained_items(more.union(odd.select("doc_id", "text")), items).collect()}
    assert got == {(10, 1, 10), (11, 1, 9), (13, 2, 1), (3, 2, 1)}
    assert decontamination.contained_items(docs.limit(0), items).count() == 0


CONTRACT = {"assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}


def brute_secrets(text):
    out = []
    for k, (kind, p) in enumerate(CONTRACT.items()):
        for m in re.finditer(p, text, re.I | re.A if kind == "assign" else re.A):
            if len(m[2] if kind == "assign" else m[0]) >= (12, 18, 16)[k]:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


def test_secrets(docs, odd):
    rng = random.Random(6)
    parts = ["token", "SECRET", "=", ":", '"', " ", "AKIA", "deadbeef", "0123456789abcdef", "QWERTYUIOP12", "x9", "\n", "ſecret", "é"]
    for text in [*texts(docs).values(), *("".join(rng.choices(parts, k=30)) for _ in range(2000))]:
        assert secrets.base_spans(text) == brute_secrets(text)
    assert secrets.secret_spans(odd).count() == len(ODD)
    code = 'KEY = "zX81-qpLm7T2vR9w"\nclient_secret = KEY\nname = "zX81-qpLm7T2vR9w-b"\npassword: changeme\n'
    assert secrets.literal_spans(code) == [("literal", 7, 23)]
    assert secrets.literal_spans("plain text: nothing to see here = fine") == []


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in kinds.items():
        for m in re.finditer(p, text, re.A):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_spans(spark, docs, odd):
    rng = random.Random(8)
    parts = ["a", "b_c", "@", ".", "-", " ", "4111111111111111", "5500 0000 0000 0004", "12", "255", "256", "+", "(", ")", "1.2.3.4", "x@y.z", "é", "😀", "\n", "007", ""]
    rows = [*texts(docs).items(), *((1_000_000 + k, "".join(rng.choices(parts, k=rng.randrange(1, 25)))) for k in range(4000))]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["stop"]) for s in r["pii"]] for r in pii.base_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert got[i] == brute_pii(text), text
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == len(ODD)
    assert out.where("doc_id IS NULL").first()["text"] == "mail [EMAIL] now"
    assert pii.redact(docs.limit(0)).count() == 0


def test_pii_terms(spark):
    """A word of one person's lines is removed with the address; words of other lines stay."""
    lines = [f"{w} keeps zorblax near a@b.cd and {w}" for w in ("red", "green", "blue", "grey")]
    rows = [(k, line) for k, line in enumerate(lines)] + [(10 + k, f"keeps and near nothing number w{k}") for k in range(200)]
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == "red keeps [TERM] near [EMAIL] and red" and got[10] == rows[4][1]


def test_toxicity(spark, odd):
    rng = random.Random(2)
    words = ["la", "mer", "bleu", "vent", "soir", "pont", "rue"]
    make = lambda bad: " ".join(rng.choices(words, k=60) + (["zorgs", "vilek"] if bad else [])) + " " + " ".join(rng.choices(words, k=20))
    rows = [(k, make(k % 3 == 0), k % 3 == 0) for k in range(240)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(b)) for k, _, b in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((got[k] >= 0.5) == (k % 3 == 0) for k in held) / len(held) > 0.9
    scored = toxicity.score(odd, model)
    assert scored.count() == len(ODD) and scored.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.train(docs, labels.where("toxic = 0")) is None


def test_toxicity_gradients():
    """Backpropagation against finite differences."""
    net = toxicity.Network(["bad worse la mer"] * 4 + ["la mer bleu vent"] * 4, np.array([1] * 4 + [0] * 4))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = net.inputs(["bad la mer worse", "vent bleu"])
    y, w, chosen = np.array([1.0, 0.0]), np.ones(2), np.array([0, 1])
    loss = lambda: np.mean(np.logaddexp(0, z := net.forward(net.embed(x), *net.windows(x, chosen))) - y * z)
    grad = net.gradients(x, chosen, y, w)
    for name in net.p:
        flat = net.p[name].reshape(-1)
        i = int(np.abs(grad[name].reshape(-1)).argmax())
        before, eps = flat[i], 1e-3
        flat[i] = before + eps
        up = loss()
        flat[i] = before - eps
        down = loss()
        flat[i] = before
        assert abs((up - down) / (2 * eps) - grad[name].reshape(-1)[i]) < 2e-3


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:20] + 0.1 * rng.standard_normal((20, 16)), base[:5], 3 * base[5:6]]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [float("inf")] * 16), (204, [1.0]), (205, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in embeddings.near_duplicate_vectors(df).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert len(got) == len(rows)
    recall = sum(min(got[k]["n_links"], near[k].sum()) for k in range(len(x))) / near.sum()
    assert recall >= 0.95 and all(got[k]["n_links"] <= near[k].sum() for k in range(len(x)))
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(200, 206))
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_crowded_bucket(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(4)
    x = (np.ones(8) + 0.01 * rng.standard_normal((70, 8))).astype(np.float32)
    got = embeddings.near_duplicate_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(69, 0)}


def test_tokens_and_files(spark, docs, odd, tmp_path, monkeypatch):
    encoder = tokens.WordTokenizer(tokens.tokenizer_path())
    rng = random.Random(1)
    hard = ["", "don't I'LL 's", "İΣΑΣ x́é", "a\x0bb\x1cd\x85e\xa0f", "½²ªµ<|endoftext|>a", "日本12語", *("".join(rng.choices("aB'sT9½é.,<|> ́İß#\n\t中-_/ ", k=40)) for _ in range(500))]
    whole = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(hard, add_special_tokens=False)]
    assert encoder.encode(hard) == whole
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    assert [t for k in range(0, len(hard), 20) for t in encoder.encode(hard[k : k + 20])] == whole

    folder = f"file://{tmp_path}/seq"
    got = token_files.read_token_files(token_files.write_token_files(docs, folder), folder).orderBy("doc_id").collect()
    start = 0
    for r in got:
        ids = encoder.tokenizer.encode(texts_of(docs)[r["doc_id"]], add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert start and len(got) == docs.count()
    reader = token_files.open_sequences(folder, "part-000000.arrow")
    assert reader.batch(0).shape[1] == reader.masks(0).shape[1] == token_files.SEQUENCE
    other = f"file://{tmp_path}/odd"
    assert token_files.read_token_files(token_files.write_token_files(odd, other), other).count() == len(ODD)
    none = f"file://{tmp_path}/none"
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), none), none).count() == 0


_texts = {}


def texts_of(docs):
    if not _texts:
        _texts.update(texts(docs))
    return _texts


def check_packing(rows):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for o, n in sorted(placed):
            assert o == at
            at += n
        assert at <= packing.CAPACITY
    return len(bins)


def test_packing(docs, odd):
    rows = packing.packed_documents(docs).collect()
    used, total = check_packing(rows), sum(r["length"] for r in rows)
    assert used <= -(-total // packing.CAPACITY) + 3
    encoder = tokens.word_tokenizer(tokens.tokenizer_path())
    ids = {i: data + (1).to_bytes(4, "little") for i, data in zip(texts_of(docs), encoder.encode(list(texts_of(docs).values())))}
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]) for r in rows)
    check_packing(packing.packed_documents(odd).collect())
    assert packing.packed_documents(docs.limit(0)).count() == 0


def test_language(spark, docs, odd):
    got = language.identify(docs.select("doc_id", "text"), language.train(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    out = {r["doc_id"]: r["lang_pred"] for r in language.identify(odd, language.train(odd)).collect()}
    assert out[1] == out[2] == "und" and out[6] != "und"
    assert language.train(docs.limit(0)) is None
    code = language.code_matrix(9)
    assert len(code) == 9 and min((code[i] != code[j]).sum() for i in range(9) for j in range(i)) >= 8


def test_pipeline(spark, docs):
    """Every stage's decision against brute force on its own input."""
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, stage(spark, kept, DIR).cache()
        if name != "packing":
            assert kept.columns == docs.columns
        if name == "simhash":
            assert {r["doc_id"] for r in kept.collect()} == brute_first_copies(texts(before))
        if name == "pii":
            want = texts(before)
            assert kept.count() == before.count() and all(not brute_pii(t) or t != want[i] for i, t in texts(kept).items())
    check_packing(kept.collect())
    assert {r["doc_id"] for r in kept.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.collect()}


def test_digest_queries(spark):
    for name in ("op4_secrets", "op7_pii"):
        rows = queries.QUERIES[name](spark, DIR).collect()
        brute = brute_secrets if name == "op4_secrets" else brute_pii
        want = {i: ",".join(f"{k}:{s}:{e}" for k, s, e in brute(t)) for i, t in texts(spark.read.parquet(f"{DIR}/documents.parquet")).items()}
        assert all(r["base_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest() for r in rows)


def grams(text):
    words = text.lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_first_copies(want):
    """Smallest id of each component of five-word Jaccard 0.8 or more; texts without words are copies of each other."""
    ids = sorted(want)
    sets = {i: grams(want[i]) for i in ids}
    label = {i: i for i in ids}
    near = [(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in ids:
        before = dict(label)
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return set(label.values())


@pytest.mark.parametrize("limits", [(512, 1024, 1 << 18), (2, 3, 64)])
def test_near_copies(spark, docs, monkeypatch, limits):
    """The stage keeps one document of each component, in small and in many blocks, hot bands included."""
    from photarium.llm import near_copies, stages

    for name, value in zip(("CELL", "BLOCK_SETS", "BLOCK_SHINGLES"), limits):
        monkeypatch.setattr(near_copies, name, value)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    edited = [(1000 + k, " ".join(rng.choice(["edit", w]) if rng.random() < 0.015 else w for w in base)) for k in range(40)]
    more = spark.createDataFrame(edited, "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    assert {r["doc_id"] for r in stages.drop_copies(spark, both, DIR).collect()} == brute_first_copies(texts(both))
    none = stages.drop_copies(spark, docs.limit(0), DIR)
    assert none.count() == 0 and none.columns == docs.columns


def test_pipeline_odd(spark, odd, tmp_path):
    """Nulls, repeats, clashing columns and an empty table through every stage."""
    for docs in (odd, odd.limit(0)):
        kept = docs
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, DIR)
            assert name == "packing" or kept.columns == docs.columns
        ids = [r["doc_id"] for r in kept.collect()]
        assert set(ids) == ({1, 3, 5, 6, None} if docs is odd else set())


def test_copies_shared_id(spark):
    """Different texts under one id are decided one by one; repeats of a row leave one."""
    from photarium.llm import stages

    a, b, c = (" ".join(f"{w}{k}" for k in range(40)) for w in "abc")
    rows = [(3, b), (5, a), (5, b), (6, a), (7, c), (7, "another clean text"), (8, "twice"), (8, "twice"), (None, b), (None, None), (9, None), (10, "")]
    got = stages.drop_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), DIR).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(3, b), (5, a), (7, c), (7, "another clean text"), (8, "twice"), (None, b), (None, None), (9, None)]))


def test_secret_lengths_and_types():
    """Long blanks, names and literals, types and remarks before a name don't hide a literal."""
    x = "zX81-qpLm7T2vR9w#"
    found = lambda text: [text[s:e] for _, s, e in secrets.literal_spans(text)]
    for text in ('db_pwd          = "{}"', 'db_pwd =\t\t\t\t\t\t\t\t\t\t"{}"', "a" * 70 + '_password = "{}"', 'db_pwd: str = "{}"', 'const pwd: string = "{}"', 'db_pwd:str="{}"', 'pwd: Optional[str] = "{}"', 'Note: db_pwd = "{}"', 'pwd = alias = "{}"', 'password="{}"'):
        assert found(text.format(x)) == [x], text
    long, bare = "zX81-qpLm7T2vR9w" * 300, "zX81qpLm7T2vR9w" * 300
    assert found(f'db_pwd = "{long}"') == [long] and found(f"db_pwd = {bare}\n") == [bare]
    assert found('"password=zX81qpLm7T2vR9w="') == ["zX81qpLm7T2vR9w="] and found("password: zX81qpLm7T2vR9w: it") == ["zX81qpLm7T2vR9w"]
    for part in ("a[", "a=", 'a="', "a: ", "a ", "a=\\", "pwd: a = ", "x" * 9 + "\t", "a:'"):
        secrets.literal_spans(part * 50_000 + "=")


def test_embedding_recall_any_size():
    """A pair at the threshold keeps its recall whatever the row count."""
    from math import comb

    for threshold in (0.9, 0.7):
        for n in (1, 100, 12_288, 786_432, 3_000_000, 100_000_000, 10**10):
            bits, tables = embeddings.plan(n, threshold)
            need, p = embeddings.Projections(4, bits, threshold, tables).need, embeddings.collision(bits, threshold)
            assert tables <= embeddings.MOST_TABLES
            assert 1 - sum(comb(tables, c) * p**c * (1 - p) ** (tables - c) for c in range(need)) >= embeddings.RECALL - 1e-9, n
            assert need >= 2


@pytest.mark.parametrize("bits", [0, 11, 17, 21])
def test_embedding_components(spark, bits):
    """Links, components and kept rows against brute force, at any number of sign bits; double components beyond float range included."""
    rng = np.random.default_rng(bits)
    base = rng.standard_normal((150, 24))
    x = np.concatenate([base, base[:120] + 0.22 * rng.standard_normal((120, 24)), base[:10], 1e39 * base[10:15], -base[15:18]])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(None, base[0].tolist()), (500, [0.0, -0.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embeddings.near_duplicate_vectors(df.withColumn("digest", df.vec_id), bits=bits).collect()}
    u = np.concatenate([x, base[:1]]) / np.linalg.norm(np.concatenate([x, base[:1]]), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    found = sum(got[k]["n_links"] for k in range(len(x)))
    assert 0.9 <= found / near[: len(x)].sum() <= 1 and all(got[k]["n_links"] <= near[k].sum() for k in range(len(x)))
    assert got[500]["n_links"] == 0 and got[500]["kept"]
    if found == near[: len(x)].sum():
        label = np.arange(len(u))
        for _ in range(len(u)):
            new = np.array([min(label[k], label[near[k]].min(initial=10**6)) for k in range(len(u))])
            if (new == label).all():
                break
            label = new
        assert all(got[k]["component_id"] == label[k] and got[k]["kept"] == (label[k] == k) for k in range(len(x)))


def test_embedding_lengths(spark):
    """Vectors of each length are linked among themselves."""
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [1.0, 0.1]), (5, [1.0, 0.0]), (6, [0.0, 1.0]), (7, [1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7)}


def test_secret_syntax():
    """Annotations, subscripts, folding, markup, calls, nesting, sections and comments."""
    x, y = "zX81-qpLm7T2vR9w#", "zX81qpLm7T2vR9w"
    found = lambda text: [text[s:e] for _, s, e in secrets.literal_spans(text)]
    for text in ('cfg["password"] = "{}"', "<password>{}</password>", 'client_secret = """{}"""', 'db_password = os.environ.get("X", "{}")', '{{"db": {{"password": "{}"}}}}', 'password = K\nK = "{}"\n', 'A = B\nsecret = A\nB = "{}"', '// old: password = "{}"', '[password]\nvalue = "{}"\n', 'cfg["k"] = "{}"\npassword = cfg["k"]\n', "don't say password = '{}' "):
        assert found(text.format(x)) == [x], text
    assert found('password = "abcDEF12" + "ghiJK34-"') == ["abcDEF12", "ghiJK34-"]
    assert found(f"password:\n  value: {y}\n") == [y] and found(f'x = "user=a password={y}"') == [y]
    assert found(f'K = "{x}"\n# K = "other-Qp8Lm7T2vR"\npassword = K\n') == [x]
    assert found("token = get_token()") == found("password: ${VAR_NAME_X}") == []
    for part in ("/*", "<!--", "a(", "<password>", "pwd = f(", '"""', "pwd='''", "pwd:\n ", "token = a\na = token\n"):
        secrets.literal_spans("password " + part * 20_000 + "=")


def test_language_letters(spark, docs):
    """Digits in rings, fractions and powers are no letters; conflicting rows of one id stay together."""
    model = language.train(docs)
    rows = spark.createDataFrame([(1, "\u00bd"), (2, "\u2461 \u00b2 12"), (3, "\u00e9t\u00e9")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(rows, model).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] != "und"
    twice = docs.select("doc_id", "text", "lang").union(docs.selectExpr("doc_id", "'1 2 3' AS text", "'zz' AS lang"))
    assert language.train(twice).langs == model.langs


def test_sharding_query(spark, docs):
    """Every column of the registered query against one prefix sum."""
    rows = sorted((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts(docs).items())
    total, before, want, slots = sum(r[1] for r in rows), 0, [], {}
    for i, size, crc in rows:
        shard = min(15, (2 * before + size) * 16 // (2 * total))
        slots[shard] = slots.get(shard, -1) + 1
        want.append((i, size, crc, "bytes", shard, slots[shard], None))
        before += size
    got = queries.QUERIES["op1_sharding"](spark, DIR).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert sorted(map(tuple, got)) == want


def slow_logit(net, words):
    """One window, word by word."""
    def vector(word):
        w = toxicity.Words([word])
        return np.concatenate([net.p["Ew"][net.words.rows(w.hash)[0]], sum((net.p["Ec"][g] for g in net.grams.rows(w.gram_hash)), np.zeros(toxicity.EMBED))])

    sig, n = lambda z: 1 / (1 + np.exp(-z)), toxicity.HIDDEN
    xs = [vector(w) for w in words] + [np.append(net.p["Ew"][0], np.zeros(toxicity.EMBED))] * (toxicity.WINDOW - len(words))
    states = {}
    for side in "fb":
        h, out = np.zeros(n), []
        for x in xs if side == "f" else reversed(xs):
            a, u = x @ net.p[f"W{side}"] + net.p[f"b{side}"], h @ net.p[f"U{side}"]
            r, z = sig(a[:n] + u[:n]), sig(a[n : 2 * n] + u[n : 2 * n])
            h = z * h + (1 - z) * np.tanh(a[2 * n :] + r * u[2 * n :])
            out.append(h)
        states[side] = out if side == "f" else out[::-1]
    hh = np.array([np.concatenate(p) for p in zip(states["f"], states["b"])])
    e = np.array([np.tanh(h @ net.p["A"] + net.p["a"]) @ net.p["v"] for h in hh])
    weight = np.where(np.arange(len(xs)) < len(words), np.exp(e), 0 if words else 1)
    return float((weight / weight.sum()) @ hh @ net.p["w"] + net.p["c"][0])


def test_toxicity_query(spark, docs):
    """Every column of the registered query against a slow pass over each window."""
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_toxicity"](spark, DIR).collect()}
    net, want = toxicity.train(docs, spark.read.parquet(f"{DIR}/labels.parquet")), texts(docs)
    assert set(got) == set(want)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5)
    for i in [*sorted(want, key=lambda i: len(want[i]))[:12], *sorted(want)[:3]]:
        words = [w.decode() for w in re.findall(rb"[a-z\x80-\xff]+", want[i].lower().encode())]
        starts = range(0, max(len(words) - toxicity.WINDOW, 0) + toxicity.STRIDE, toxicity.STRIDE)
        logit = max(slow_logit(net, words[s : s + toxicity.WINDOW]) for s in starts if s == 0 or s - toxicity.STRIDE + toxicity.WINDOW < len(words))
        assert abs(1 / (1 + np.exp(-logit)) - got[i]["score"]) < 1e-4


def test_toxicity_pieces(monkeypatch):
    """A long text read in pieces gives the words of the whole text."""
    net = toxicity.Network(["bad worse la mer Éa"] * 4 + ["la mer bleu vent"] * 4, np.array([1] * 4 + [0] * 4))
    rng = random.Random(9)
    many = ["", "".join(rng.choices("bad la mer É\n,x", k=400)), "word" * 80, " ".join(rng.choices(["la", "bad", "ΑΣ", "worse."], k=90)), "la"]
    whole = net.inputs(many)
    monkeypatch.setattr(toxicity, "PASS_CHARS", 7)
    assert all(np.array_equal(v, whole[k]) for k, v in net.inputs(many).items())


def test_pipeline_run(spark, docs):
    """The registered query: whole sequences, ids of every piece, and nothing but the last stage left in the scratch folder."""
    import os

    from photarium.sources.scratch import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    got = corpus_pipeline.run(spark, DIR)
    rows = got.collect()
    check_packing(rows)
    assert {r["doc_id"] for r in rows} <= set(texts(docs)) and len(rows) == got.count()
    (left,) = set(os.listdir(folder)) - before
    assert left.startswith("stage-packing")


def test_language_decoding(docs):
    """Nearest codeword by a slow loss over every bit."""
    want = texts(docs)
    model = language.train(docs)
    some = [want[i] for i in sorted(want)[:40]]
    best, p, _ = model.decode(some)
    for k, text in enumerate(some):
        margin = language.gram_counts([text])[0].astype(float) @ model.w.astype(float) + model.b
        loss = [sum(t * np.log1p(np.exp(-c * f)) for c, t, f in zip(row, trust, margin)) for row, trust in zip(model.code.astype(float), model.trust)]
        assert loss[best[k]] <= min(loss) + 1e-5
        share = np.exp(-len(margin) * (np.array(loss) - min(loss)))
        assert abs(share[best[k]] / share.sum() - p[k]) < 1e-3


def test_language_query(spark, docs):
    """Every column of the registered query."""
    model, want = language.train(docs), texts(docs)
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_language"](spark, DIR).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        (best,), (p,), _ = model.decode([want[i]])
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert (r["lang_pred"], round(r["score"], 4)) == ((model.langs[best], round(p, 4)) if any(map(str.isalpha, want[i])) else ("und", 0.0))


def test_token_queries(spark, docs):
    """op8 and op9 against whole texts encoded by the library."""
    from tokenizers import Tokenizer

    library, want = Tokenizer.from_file(tokens.tokenizer_path()), texts(docs)
    ids = {i: library.encode(want[i], add_special_tokens=False).ids for i in sorted(want)}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    start, rows = 0, []
    for i, x in ids.items():
        rows.append((i, start, len(x) + 1, crc([*x, 2])))
        start += len(x) + 1
    assert sorted(map(tuple, queries.QUERIES["op8_token_files"](spark, DIR).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == rows
    got = queries.QUERIES["op9_packing"](spark, DIR).collect()
    check_packing(got)
    pieces = [(i, k, s, len(x[s : s + 4096]), crc(x[s : s + 4096])) for i, x in ((i, [*x, 1]) for i, x in ids.items()) for k, s in enumerate(range(0, len(x), 4096))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == pieces


def test_simhash_query(spark, docs):
    want = texts(docs)
    ids = sorted(want)
    prints = [brute_simhash(want[i]) for i in ids]
    got = queries.QUERIES["op2_simhash"](spark, DIR).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == [(i, f"{p:016x}", ids[k]) for i, p, k in zip(ids, prints, components(prints))]


def test_leaks_shared_id(spark, tmp_path):
    """Each text is judged alone, whatever its id; an empty benchmark drops nothing."""
    from photarium.llm import stages

    item = " ".join(f"b{k}" for k in range(30))
    rows = [(1, f"before {item} after"), (1, "a clean text under the same id"), (2, item[:40]), (None, item), (None, "clean"), (3, None), (4, item.upper()), (4, item.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([("x", item)], "item_id string, text string")
    items.write.parquet(str(tmp_path / "some/benchmark.parquet"))
    items.limit(0).write.parquet(str(tmp_path / "none/benchmark.parquet"))
    got = stages.drop_leaks(spark, df, str(tmp_path / "some")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, "a clean text under the same id"), (2, item[:40]), (None, "clean"), (3, None)]))
    assert stages.drop_leaks(spark, df, str(tmp_path / "none")).count() == len(rows)


def test_secret_values():
    """Brackets, lists, tuples, operators, conditions, attributes, CDATA, blocks and broken lines; time follows the length."""
    import time

    x = "zX81-qpLm7T2vR9w#"
    found = lambda text: [text[s:e] for _, s, e in secrets.literal_spans(text)]
    for text in (
        'password = (\n    "{}"\n)', 'password = ["{}"]', '{{"password": ["{}"]}}', 'passwords = {{"x": "{}"}}', 'password = get("X") or "{}"', 'password = "a" if a else "{}"', 'password = x if a else "{}"', 'password = base + "{}"',
        'user, password = "u", "{}"', '<add key="password" value="{}"/>', "<password><![CDATA[{}]]></password>", "password: |\n  {}\nnext: 1\n", 'password\n= "{}"', 'größe_password = "{}"', 'connect(user="u", password="{}")', 'self.password: str = "{}"',
        'a = password = "{}"', 'const cfg = {{ db: {{ password: "{}" }} }};', 'password = os.getenv("A") ?? "{}"', 'let password = cond ? "no" : "{}";', '<input name="api_token" value="{}">',
    ):
        assert found(text.format(x)) == [x], text
    assert found('He said the password: it was "Ab9-qpLm7T2vR8w#x" then') == []
    assert found(f'{{"password": "no", "colour": "{x}"}}') == [] and found(f'password = None\ncolour = "{x}"') == []
    for part in ("a[", "a=", "a(", "{", "a,", "a,b=", "'", "`", "<a ", "<a b=", "name: |\n ", "a.", "a->", "/*", "\\\n", '"""x', "a=b ", "<![CDATA[", "<a><![CDATA[]", "password=("):
        took = []
        for n in (5_000, 20_000):
            began = time.process_time()
            secrets.literal_spans("password " + part * n + "=")
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.5, part


def test_op3_sql(spark):
    """The registered query against its SQL."""
    import duckdb

    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = duck.sql(decontamination.ORACLE)
    got = decontamination.op3_decontamination(spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, [_named(want.columns, r) for r in want.fetchall()]))


def _named(columns, values):
    from pyspark.sql import Row

    return Row(**dict(zip(columns, values)))
