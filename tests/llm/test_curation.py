"""Operators 11 to 13 against brute force and their SQL."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from photarium.llm import conversations, merkle, outliers

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"
ROWS = [(1, "s", "en", 0, ""), (2, None, None, None, None), (3, "s", "en", 7, "One TWO"), (3, "s", "en", 7, "One TWO"), (None, None, "en", 1, "mail A.b@c.de now"), (5, "s", "fr", 5, "X" * 200_000), (6, "s", "", 9, "Word " * 40_000), (9, "é", "zß", -4, "ÄÖ Ü")]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """doc_id -> the contract's columns, by lists."""

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
        return levels

    def rise(levels, at, cur, proof):
        for level in levels[:-1]:
            run, slot = level[at // 8 * 8 : at // 8 * 8 + 8], at % 8
            proof += run[:slot] + run[slot + 1 :]
            cur, at = digest(*run[:slot], cur, *run[slot + 1 :]), at // 8
        return cur

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    leaf = lambda r: digest(*map(field, r))
    own = {lang: sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for lang in langs}
    trees = {lang: tree([leaf(r) for r in own[lang]]) for lang in langs}
    top = tree([trees[lang][-1][0] for lang in langs])
    out = []
    for no, lang in enumerate(langs):
        for k, r in enumerate(own[lang]):
            cur, proof = leaf(r), []
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                cur = leaf((*r[:4], re.sub("[A-Z]", lambda m: m[0].lower(), r[4])))
            folded = rise(top, no, rise(trees[lang], k, cur, proof), proof)
            out.append((r[0], leaf(r), trees[lang][-1][0], top[-1][0], digest(*proof), folded, folded == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def many_docs():
    rng = random.Random(13)
    return [(k, rng.choice(["a", None]), rng.choice(["en"] * 6 + ["fr", None]), k, rng.choice(["Aa", "b", ""])) for k in range(700)] + [(10**15 + k, "s", f"l{k:03}", 1, "One") for k in range(70)]


@pytest.mark.parametrize("levels", [1, 4])
@pytest.mark.parametrize("rows", [ROWS, many_docs(), []], ids=["odd", "many", "empty"])
def test_manifest(spark, rows, levels):
    """Few and many levels a pass, one row a language, long texts, nulls, repeats, clashing columns."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("tree", "idx", "leaf", "shown", "block", "path", "root")})
    lower = merkle.leaf_digest(["doc_id", "source", "lang", "n_chars", F.translate("text", merkle._UPPER, merkle._LOWER)])
    got = merkle.manifest(docs, presented=F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower), levels=levels).select(COLUMNS)
    assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(rows)


def test_states_resume():
    """A state kept before a slot goes on to the digest of the whole message."""
    import numpy as np

    kids = [hashlib.sha256(bytes([k])).digest() for k in range(5)]
    level = merkle.Level(np.frombuffer(b"".join(kids), ">u4").reshape(-1, 8).T.astype(np.uint32))
    assert merkle._bytes(level.parents) == [hashlib.sha256("".join(k.hex() for k in kids).encode()).digest()]
    for slot in range(5):
        state = level.before[slot]
        for k in range(slot, 5):
            state = merkle.compress(state, level.words[:, k : k + 1])
        assert (merkle.finish(state, np.array([5])) == level.parents).all()


def same_as_sql(spark, query, sql, tables):
    duck = duckdb.connect()
    for t in tables:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = duck.sql(sql)
    got = query(spark, DIR)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(str, got.select(cols).collect())) == sorted(str(_row(cols, r)) for r in want.select(*cols).fetchall())


def _row(cols, values):
    from pyspark.sql import Row

    return Row(**dict(zip(cols, values)))


def test_op13_sql(spark):
    same_as_sql(spark, merkle.op13_merkle, merkle.ORACLE, ["documents"])


def brute_repair(rows):
    """(role, text, turn) in order -> the contract's columns, ways compared as (cost, text)."""
    kinds, seen = [], set()
    for role, text, _ in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        kinds.append("b" if not said else "d" if (role, text) in seen else "n" if said[-1] in ".!?" else "t")
        seen.add((role, text))
    fits = re.compile("(s?(ua)+)?").fullmatch
    ways = {"": (0, "", ())}
    for (role, text, _), kind in [*zip(rows, kinds), ((None, None, None), "end")]:
        for _ in range(2):
            for shape, (cost, audit, out) in list(ways.items()):
                for r in ("user", "assistant"):
                    ways[k] = min(ways.get(k := shape + r[0], (9**9,)), (cost + 5, audit + "I", (*out, f"{r}:")))
        if kind == "end":
            break
        after = {}
        for shape, (cost, audit, out) in ways.items():
            tries = [(shape, (cost + 2, audit + "D", out))]
            if kind in "nt":
                late = 5 * (kind == "t")
                # a row without an initial fits nowhere
                tries.append((shape + (role[:1] or "-"), (cost + late, audit + "K", (*out, f"{role}:{text}"))))
                tries += [(shape + r[0], (cost + late + 1, audit + "R", (*out, f"{r}:{text}"))) for r in ("user", "assistant")]
            for k, v in tries:
                if any(fits(k + more) for more in ("", "a", "ua")):
                    after[k] = min(after.get(k, (9**9,)), v)
        ways = {k: v for k, v in after.items()}
    cost, audit, out = min(v for k, v in ways.items() if fits(k))
    turns = sorted(t for _, _, t in rows if t is not None)
    initials = [r[:1] for r, _, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, digest("\n".join(out)))


def many_talks():
    rng = random.Random(12)
    rows = []
    for conv in [None, *range(60)]:
        for k in range(rng.randrange(1, 9)):
            text = rng.choice(["Hi.", "So?", "a b", " ", "", None, "x!", "Y. \n", "é", "\u00a0", "Hm. " * 3000])
            rows.append((conv, rng.choice([None, k, k, k, k, 2 * k]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
    return rows + [(77, k, rng.choice(["user", "assistant"]), f"{rng.randrange(150)}{rng.choice('.!?x')}") for k in range(300)]


def wanted_repairs(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            own += [("user" if fate == 4 else role, text, turn)] * (0 if fate == 0 else 2 if fate == 3 else 1)
        own.sort(key=lambda r: (r[2] is not None, r[2] or 0, r[0].encode(), r[1].encode()))
        out[conv] = brute_repair(own)
    return out


@pytest.mark.parametrize("segment", [2048, 3])
def test_repair(spark, segment):
    """Conversations in one segment and in hundreds, nulls, blanks, repeats, long texts, clashing columns."""
    from pyspark.sql import functions as F

    rows = many_talks()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("key", "part", "seg", "kinds", "fate", "times")})
    job = conversations.repair(conversations.damaged(table), segment)
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r[0]: tuple(r)[1:] for r in job.summary().select(columns).collect()}
    assert got == wanted_repairs(rows)
    said = {}
    for r in sorted(job.turns().collect(), key=lambda r: (r["part"], r["seg"], r["place"])):
        said.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {k: digest("\n".join(said.get(k, []))) for k in got} == {k: v[-1] for k, v in got.items()}


def test_repair_empty(spark):
    none = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert conversations.repair(conversations.damaged(none)).summary().count() == 0


def test_chain_of_segments():
    """Cut anywhere, the chain of segments costs what the whole costs and takes the same way."""
    rng = random.Random(7)
    for _ in range(300):
        n = rng.randrange(1, 12)
        classes, kinds = "".join(rng.choices("suax", (1, 3, 3, 1), k=n)), "".join(rng.choices("ntbd", (6, 1, 1, 1), k=n))
        value, letters = conversations.ended(*(found := conversations.cheapest(classes, kinds)))
        want = (value >> 3 * found[1], conversations.audit_of(value, letters, found[1]))
        cuts = sorted({0, n, *rng.sample(range(n + 1), min(n, 3))})
        spans, segments = list(zip(cuts, cuts[1:])), []
        for a, b in spans:
            ways = [(p, q, v) for p in range(4) for q, (v, _) in conversations.cheapest(classes[a:b], kinds[a:b], p)[0].items()]
            width = 3 * (b - a) + 2
            low = sorted({v & (1 << 3 * width) - 1 for _, _, v in ways})
            segments.append([(p, q, v >> 3 * width, low.index(v & (1 << 3 * width) - 1) + 1) for p, q, v in ways])
        cost, states = conversations.cheapest_chain(segments)
        audit = ""
        for (a, b), p, q in zip(spans, states, states[1:]):
            best, width = conversations.cheapest(classes[a:b], kinds[a:b], p)
            audit += conversations.audit_of(*best[q], width)
        assert (cost, audit + {2: "I", 1: "II"}.get(states[-1], "")) == want


def test_op12_sql(spark):
    same_as_sql(spark, conversations.op12_conversations, conversations.ORACLE, ["conversations"])


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = collections.Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    inside = {k + j for k in range(len(words) - 7) if grams[tuple(words[k : k + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:k] for k, x in enumerate(lines)), len(inside)


def brute_distances(groups, rows):
    """Row number -> distance, by whole arrays; ``rows``: (lang, source, vector)."""

    def shaped(mean, cov):
        return mean, np.linalg.inv(cov + np.diag((np.array(outliers.GRANTED) * outliers.UNIT) ** 2))

    def away(x, est):
        return np.einsum("ni,ij,nj->n", x - est[0], est[1], x - est[0])

    def moments(x, share):
        return shaped(x.mean(0), outliers.consistency(share) * np.cov(x.T, bias=True))

    def fit(x):
        low = np.sort(x, axis=0)[(len(x) - 1) // 2]
        mad = np.sort(abs(x - low), axis=0)[(len(x) - 1) // 2]
        best = (np.inf, 0, None)
        for start, est in enumerate((shaped(low, np.diag((1.4826 * mad) ** 2)), moments(x, 1))):
            det = np.inf
            for _ in range(outliers.MAX_STEPS):
                bins = np.floor(outliers.BINS * np.log2(1 + away(x, est)))
                inner = x[bins <= np.sort(bins)[(len(x) + 6) // 2 - 1]]
                new = moments(inner, len(inner) / len(x))
                value = -np.linalg.slogdet(new[1])[1]
                if value >= det - 1e-9:
                    break
                det, est = value, new
            best = min(best, (det, start, est), key=lambda b: b[:2])
        near = x[away(x, best[2]) <= outliers.CLOSE]
        return moments(near, len(near) / -(-len(near) // outliers.REWEIGHT))

    out = {}
    for pick in {groups(r) for r in rows}:
        x = np.array([v for *ls, v in rows if pick(ls)])
        est = fit(x)
        for k, r in enumerate(rows):
            if groups(r) == pick:
                out[k] = away(np.array([r[2]]), est)[0]
    return out


class Pick(tuple):
    def __call__(self, ls):
        return all(a is Ellipsis or a == b for a, b in zip(self, ls))


def test_text_stats():
    rng = random.Random(11)
    texts = [None, "", " \n\t", "a b c d e f g h a b c d e f g h", "x " * 50, "one\n\n \none\n one\n" * 2, "\u00a0 \x1c \x85"]
    texts += [" ".join(rng.choices("abcd", k=rng.randrange(40))) + "\n" * rng.randrange(2) + "".join(rng.choices("ab# \n|\r\x0b", k=20)) for _ in range(300)]
    assert [outliers.text_stats(t) for t in texts] == [brute_stats(t) for t in texts]


def prose(rng, n, low=3, high=8):
    return " ".join("".join(rng.choices("etaoin", k=rng.randrange(low, high))) for _ in range(n))


def test_outliers(spark):
    """Against whole arrays: own, language and overall estimates, junk in large shares, a hot source, nulls, repeats, clashing columns."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    rows = [(k, prose(rng, int(rng.lognormvariate(5, 0.8)) + 20), rng.choice(["en", "fr"]), rng.choice(["hot"] * 4 + ["a", "b", None])) for k in range(600)]
    rows += [(1000 + k, " ".join(rng.choice(["###", "|$|", prose(rng, 1, 14, 30)]) for _ in range(60)), "en", "hot") for k in range(90)]
    rows += [(2000, None, None, None), (2001, "", "en", "hot"), (None, prose(rng, 30), None, "x"), (2003, "word " * 40_000, "en", "a"), (2004, prose(rng, 30_000), "zz", ""), *[(2005, prose(random.Random(1), 40), "en", "hot")] * 30]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("key", "n_words", "x0", "m", "c", "group_key", "start")})
    got = outliers.judge(docs).collect()
    assert len(got) == len(rows)
    stats = {r[1]: brute_stats(r[1]) for r in rows}
    assert sorted((str(r["doc_id"]), *(r[c] for c in outliers.STATS)) for r in got) == sorted((str(i), *stats[t]) for i, t, _, _ in rows)

    def vector(t):
        n, chars, symbols, dup, rep = stats[t]
        return np.round(np.log2([n + 1, (chars + 1) / (n + 1), 1 + 64 * symbols / (chars + 1), 1 + 8 * dup / (n + 1), 1 + 4 * rep / (n + 1)]) * outliers.UNIT)

    good = [r for r in rows if stats[r[1]][0] >= 20 and 100 * stats[r[1]][4] <= 30 * stats[r[1]][0]]
    by_group, by_lang = collections.Counter((x, s) for _, _, x, s in good), collections.Counter(x for _, _, x, _ in good)
    own = lambda r: Pick(r[:2]) if by_group[r[0], r[1]] >= 50 else Pick((r[0], ...)) if by_lang[r[0]] >= 50 else Pick((..., ...))
    want = brute_distances(own, [(x, s, vector(t)) for _, t, x, s in good])
    assert len({sum(x is ... for x in own(r[2:])) for r in good}) == 3
    key = lambda i, x, s, n: (str(i), str(x), str(s), n)
    near = {key(r[0], r[2], r[3], stats[r[1]][0]): want[k] for k, r in enumerate(good)}
    for r in got:
        k = key(r["doc_id"], r["lang"], r["source"], r["n_words"])
        assert r["base_failed"] == (k not in near) and r["kept"] == (k in near and near[k] <= outliers.BOUND)
        assert r["base_failed"] or abs(r["distance"] - near[k]) <= 1e-6 * (1 + near[k])
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert not kept & set(range(1000, 1090)) and len(kept & set(range(600))) >= 595
    assert outliers.judge(docs.limit(0)).count() == 0
