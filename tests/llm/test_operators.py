"""Each operator against brute force on a small table of odd rows, and on an empty one."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm import bpe, collocations, exact_dedup, language_id, license_scan, lm_scoring, near_dedup, packing, perfect_hash, quality_rules, resampling, secret_scan, sharding, substring_dedup
from vellum.llm.suffix_array import common_prefixes, suffix_array

from .helpers import documents, odd_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    return odd_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return documents(spark, texts).repartition(3).cache()


@pytest.fixture(scope="module")
def ids(texts):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


EMPTY = {
    "op1": exact_dedup.exact_dedup,
    "op2": language_id.identify,
    "op3": lambda d: bpe.bpe_round_trip(d, PATH),
    "op4": lm_scoring.lm_scores,
    "op5": lambda d: quality_rules.quality(d, None),
    "op6": sharding.shard,
    "op7": near_dedup.near_classes,
    "op8": license_scan.license_scan,
    "op9": lambda d: packing.pack(d, PATH),
    "op10": substring_dedup.substring_dedup,
    "op11": lambda d: collocations.collocations(d, support=2),
    "op12": secret_scan.secret_scan,
    "op13": lambda d: resampling.resample(d, d.select("text").limit(2), range_rows=4),
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_table(spark, name):
    assert EMPTY[name](documents(spark, ["x"]).limit(0)).count() == 0


ODD = [None, "", "one two three", "an old text with some words in it " * 12, "an old text with some words in it " * 12, "12 34", "MIT License " * 3]


@pytest.mark.parametrize("name", EMPTY)
def test_null_ids_and_repeated_rows(spark, name):
    """Every row has its result; rows that repeat an id and a text have the same one, but for the places that they take."""
    once = documents(spark, ODD)
    rows = once.unionByName(once).unionByName(once.withColumn("doc_id", F.lit(None).cast("long")))
    found = EMPTY[name](rows).collect()
    if name == "op11":
        again = EMPTY[name](rows.withColumn("doc_id", F.lit(1))).collect()
        assert sorted(found) == sorted(again) and all(r["a"] % 3 == 0 for r in found) and found
        return
    if name == "op9":
        docs = {(r["doc_id"], r["doc_tokens"]): 0 for r in found}
        assert sum(r["length"] for r in found if r["doc_id"] is None) * 2 == sum(r["length"] for r in found if r["doc_id"] is not None) and docs
        return
    assert len(found) == 3 * len(ODD)
    if name == "op6":
        assert len({(r["shard"], r["slot"]) for r in found}) == len(found) and sum(r["doc_id"] is None for r in found) == len(ODD)
        return
    if name == "op13":
        ranks = sorted(r["rank"] for r in found if r["rank"] is not None)
        assert ranks == list(range(1, 25 * 6 // 100 + 1))
        assert len({(r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in found}) == 2 * len(ODD) - 2
        return
    own = {}
    for r in found:
        if r["doc_id"] is not None:
            own.setdefault(r["doc_id"], []).append(tuple(r))
    assert all(len(x) == 2 and len(set(x)) == 1 for x in own.values())


def test_near_dedup_recall_in_a_large_bucket(spark):
    """Hundreds of copies of one text, each changed here and there, and others with a line repeated: links by brute force are found."""
    rng = random.Random(8)
    base, texts = [f"w{k}" for k in range(150)], []
    for _ in range(700):
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            own[rng.randrange(150)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(own) + rng.choice(["", "", " line that repeats itself" * 30]))
    sets = [near_dedup.shingles(near_dedup.words_of(t)) for t in texts]
    known = {x: i for i, x in enumerate(np.unique(np.concatenate(sets)).tolist())}
    table = np.zeros((len(texts), len(known)), np.float32)
    for i, x in enumerate(sets):
        table[i, [known[y] for y in set(x.tolist())]] = 1
    both = table @ table.T
    size = table.sum(1)
    links = np.argwhere(both >= 0.8 * (size[:, None] + size[None, :] - both))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = by_id(near_dedup.near_classes(documents(spark, texts)))
    joined = sum(got[a]["class_id"] == got[b]["class_id"] for a, b in links.tolist()) / len(links)
    assert joined >= 0.999 and all(got[i]["class_id"] >= root(i) for i in range(len(texts)))


def test_exact_dedup(docs, texts):
    table = docs.select("doc_id", "text").toPandas()
    con = duckdb.connect()
    con.register("documents", table)
    got = exact_dedup.exact_dedup(docs, owner_bytes=1 << 12, capacity=2)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({exact_dedup.ORACLE})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_exact_dedup_keeps_columns_of_any_name(spark):
    docs = documents(spark, ["a b", "ab", None]).withColumns({c: F.lit(c) for c in ("own", "sha", "nth", "__id", "__sha", "__nth", "left_text")})
    for keep in (exact_dedup.keep_first, near_dedup.keep_first, substring_dedup.without_repeats):
        assert keep(docs).columns == docs.columns and keep(docs).count() in (2, 3)


def test_exact_dedup_repeated_rows(spark):
    docs = documents(spark, ["a b", "ab", "c"]).unionByName(documents(spark, ["a b", "ab", "c"]))
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == 6 and {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows} == {(0, 0, 4, True), (1, 0, 4, False), (2, 2, 2, True)}
    assert sorted(r["doc_id"] for r in exact_dedup.keep_first(docs).collect()) == [0, 2]


def test_extendible_index_splits_and_chains():
    index = exact_dedup.ExtendibleIndex(capacity=3)
    for i in range(200):
        key = i * 0x9E3779B97F4A7C15 % (1 << 64) if i < 190 else 7
        index.add(key, b"%d" % i, b"", (0,), i, 1)
        index.add(key, b"%d" % i, b"", (-1,), i + 1000, 1)
    entries = [e for _, b in index.buckets() for c in b.chains.values() for e in c]
    assert len(entries) == 200 and all(e[4] == 2 and e[3] >= 1000 for e in entries) and len(index.bucket(7).chains[7]) == 10
    assert all(b.size <= 3 for _, b in index.buckets() if 7 not in b.chains)


def test_language_id(spark):
    words = {"x": "the and of with that was from this".split(), "y": "der die und das nicht mit von sich".split()}
    texts, langs = [], {}
    for i in range(120):
        lang = "xy"[i % 2]
        texts.append(" ".join(words[lang][(i * 7 + k * k) % 8] for k in range(1 + i % 40)))
        langs[i] = lang
    texts += [None, "12 34", ""]
    got = by_id(language_id.identify(documents(spark, texts, langs)))
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (120, 121, 122)] == ["und"] * 3
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r["held_out"] and i < 120} == set(held)
    assert sum(got[i]["lang_pred"] == langs[i] for i in held) / len(held) > 0.95


def brute_phrases(text, sample):
    """Longest matches one after the other, a new one every BLOCK characters."""
    n, at = 0, 0
    while at < len(text):
        end = min(len(text), (at // language_id.BLOCK + 1) * language_id.BLOCK)
        k = at + 1
        while k < end and text[at : k + 1] in sample:
            k += 1
        n, at = n + 1, k
    return n


def test_language_id_phrases_by_brute_force():
    rng = random.Random(5)
    samples = {x: "".join(rng.choice(letters) for _ in range(400)) for x, letters in (("x", "aabcd e"), ("y", "abccd e"))}
    model = language_id.Model(samples)
    texts = ["".join(rng.choice("abcd eü1") for _ in range(n)) for n in (1, 5, 511, 512, 513, 3000, 40_000)]
    for t in texts:
        codes = model.alphabet.codes(t)
        rate, _ = model.rates([t])
        for j, lang in enumerate(sorted(samples)):
            own = "".join(map(chr, model.alphabet.codes(samples[lang])))
            assert rate[0, j] == pytest.approx(brute_phrases("".join(map(chr, codes)), own) * model.bits[j] / len(codes))


def test_suffix_automaton_phrases():
    model = language_id.Model({"x": "abcabd", "y": "zzzz"})
    codes = model.alphabet.codes("abdabc")
    table = model.tables[0]
    assert language_id.parse_counts(codes, np.array([0]), np.array([6]), table).tolist() == [2]  # abd, abc


def test_bpe(docs, texts, ids):
    got = by_id(bpe.bpe_round_trip(docs, PATH))
    for i, t in enumerate(texts):
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids[i]), hashlib.sha256(packed(ids[i])).hexdigest()), t
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def brute_ctw(train, depth):
    tree = {}
    for text in train:
        t = lm_scoring.END * depth + text + lm_scoring.END
        for i in range(depth, len(t)):
            for k in range(8):
                node, bit = (1 << k) | (t[i] >> (8 - k)), (t[i] >> (7 - k)) & 1
                for d in range(depth + 1):
                    tree.setdefault((t[i - d : i], node), [0, 0])[bit] += 1

    def own(c):
        return math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(sum(c) + 1) - math.log(math.pi)

    weighed, below = {}, Counter()
    for (ctx, node), c in sorted(tree.items(), key=lambda x: -len(x[0][0])):
        w = own(c) if len(ctx) == depth else np.logaddexp(own(c), below[ctx, node]) - math.log(2)
        weighed[ctx, node] = w
        if ctx:
            below[ctx[1:], node] += w

    def score(text):
        t, total = lm_scoring.END * depth + text + lm_scoring.END, 0.0
        for i in range(depth, len(t)):
            for k in range(8):
                node, bit, p = (1 << k) | (t[i] >> (8 - k)), (t[i] >> (7 - k)) & 1, 0.5
                for d in range(depth, -1, -1):
                    key = (t[i - d : i], node)
                    c = tree.get(key, [0, 0])
                    mine = (c[1] + 0.5) / (sum(c) + 1)
                    share = 1.0 if d == depth else math.exp(own(c) - math.log(2) - weighed.get(key, 0.0))
                    p = share * mine + (1 - share) * p
                total += math.log10(p if bit else 1 - p)
        return total

    return score


def test_lm_scores(spark, texts):
    texts = [t for t in texts if not t or len(t) < 2000]
    low = [(t or "").encode().lower() for t in texts]
    train = [low[i] for i in range(len(low)) if zlib.crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for t in train for w in [*t.split(), b" "])
    n, v = sum(count.values()), len(count)
    score = brute_ctw(train, lm_scoring.DEPTH)
    for i, r in by_id(lm_scoring.lm_scores(documents(spark, texts))).items():
        tokens = [*low[i].split(), b" "]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens))
        assert r["score"] == pytest.approx(score(low[i]), rel=1e-9)


def base_rules(text):
    w = WORD.findall(text or "")
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w))


def test_quality_rules(spark, docs, texts):
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (7, 0, 0), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality_rules.quality(docs, labels))
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:7] == base_rules(t), t
        assert got[i]["kept"] == (not got[i]["base_failed"] and got[i]["score"] >= quality_rules.THRESHOLD)
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def brute_quality(texts, good):
    """Scores by counting hashed words and pairs of words."""
    grams = []
    for t in texts:
        h = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in WORD.findall(t or "")]
        pairs = [xxhash.xxh64_intdigest(struct.pack("<Q", b), seed=xxhash.xxh64_intdigest(struct.pack("<Q", a), seed=42)) for a, b in zip(h, h[1:], strict=False)]
        grams.append([x % quality_rules.BUCKETS for x in h + pairs])
    raw, target = Counter(x for g in grams for x in g), Counter(x for i in good for x in grams[i])
    n_raw, n_target, prior = sum(raw.values()), sum(target.values()), quality_rules.PRIOR

    def ratio(x):
        p = (raw[x] + 1) / (n_raw + quality_rules.BUCKETS)
        return math.log((target[x] + prior * p) / (n_target + prior) / p)

    return [sum(map(ratio, g)) / max(1, len(g)) for g in grams]


def test_quality_score(spark, docs, texts):
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (9, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality_rules.quality(docs, labels))
    assert [got[i]["score"] for i in range(len(texts))] == pytest.approx(brute_quality(texts, [5, 6, 9]), abs=1e-5)
    assert len({r["score"] for r in got.values()}) > 5


def test_quality_rejects_what_the_target_lacks(spark):
    rng = random.Random(3)
    good = "the of and a in that it was for on".split()
    texts = [" ".join(rng.choice(good) + rng.choice(["", "", f"x{rng.randrange(40)}"]) for _ in range(200)) for _ in range(60)]
    junk = [" ".join(w.upper() + "!!" for w in rng.choices(good, k=70) + [f"j{k}{rng.randrange(9)}" for k in range(30)]) for _ in range(6)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    got = by_id(quality_rules.quality(documents(spark, texts + junk), labels))
    assert {i for i, r in got.items() if not r["base_failed"] and not r["kept"]} == set(range(60, 66))


def test_quality_rules_when_hashes_clash(spark, docs, monkeypatch, texts):
    monkeypatch.setattr(quality_rules, "POSITION", 61)  # three bits of hash are left: different windows clash
    got = by_id(quality_rules.quality(docs.where("doc_id < 12"), None))
    assert all(tuple(r)[1:7] == base_rules(texts[i]) for i, r in got.items())


def test_sharding(spark, docs, texts):
    got = by_id(sharding.shard(docs, shards=5))
    sizes = Counter(r["shard"] for r in got.values())
    assert len(got) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in got.values() if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    for i, t in enumerate(texts):
        assert (got[i]["size"], got[i]["text_crc32"]) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    again = by_id(sharding.shard(docs.repartition(7), shards=5))
    assert again == got


@pytest.mark.parametrize("n", [1, 2, 3, 17, 100, 1001])
def test_feistel_is_a_permutation(spark, n):
    walk = sharding.longest_walk(spark, n, 3)
    got = spark.range(n).select(sharding.permuted(F.col("id"), n, 3, walk).alias("x")).collect()
    assert sorted(r["x"] for r in got) == list(range(n))


def test_near_dedup(spark, docs, texts):
    got = by_id(near_dedup.near_classes(docs))
    sets = []
    for t in texts:
        w = (t or "").lower().encode().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {i: r["class_id"] for i, r in got.items()} == {i: root(i) for i in range(len(texts))}


def test_near_dedup_divides_large_buckets(spark):
    words = [f"w{k}" for k in range(120)]
    texts = []
    for i in range(30):
        own = list(words)
        own[4 * i : 4 * i + 1] = [f"v{i}"]
        texts.append(" ".join(own))
    texts += [" ".join(f"z{k}" for k in range(60))]
    docs = documents(spark, texts)
    links = near_dedup.near_links(docs, large=4)
    from vellum.llm.components import components

    assert components(links).select("label").distinct().count() == 1 and components(links).count() == 30


def test_near_dedup_pair_that_shares_one_large_bucket(spark):
    def variant(seed, changes):
        words = [f"w{k}" for k in range(300)]
        for j in random.Random(seed).sample(range(4, 296), changes):
            words[j] = f"v{seed}x{j}"
        return " ".join(words)

    texts = [variant(1037, 7), variant(6, 3), variant(35, 3)]  # the last two are similar; the first stands before them in the one bucket they share
    words = [near_dedup.words_of(t) for t in texts]
    sets = [np.unique(near_dedup.shingles(w)) for w in words]
    bands = near_dedup.band_keys(near_dedup.signatures([(x, np.ones(len(x))) for x in sets]))
    key = [near_dedup.word_key(w) for w in words]
    assert (bands[1] == bands[2]).sum() == 1 and bands[0][bands[1] == bands[2]] == bands[1][bands[1] == bands[2]] and key[0] == min(key)
    assert [(r["a"], r["b"]) for r in near_dedup.near_links(documents(spark, texts), large=2).collect()] == [tuple(sorted(key[1:]))]


def test_near_dedup_ignores_how_often_a_line_repeats(spark):
    texts = []
    for g in range(4):
        own, line = " ".join(f"g{g}w{k}" for k in range(404)), " ".join(f"g{g}z{k}" for k in range(10))
        texts += [f"{own} {line}", "\n".join([own, *[line] * 60])]  # sets of 410 and 415 shingles, one within the other
    classes = by_id(near_dedup.near_classes(documents(spark, texts)))
    assert [classes[i]["class_id"] for i in range(8)] == [0, 0, 2, 2, 4, 4, 6, 6]


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(0)
    a = rng.integers(1, 1 << 60, 300).astype(np.uint64)
    b = np.concatenate([a[:240], rng.integers(1, 1 << 60, 60).astype(np.uint64)])
    sig = near_dedup.signatures([(a, np.ones(300)), (b, np.ones(300)), (a[:1], np.ones(1))])
    assert abs((sig[0] == sig[1]).mean() - 240 / 360) < 0.1 and (sig[2] == a[0]).all()


def test_license_scan(docs, texts):
    got = by_id(license_scan.license_scan(docs))
    for i, t in enumerate(texts):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in places]
        want = (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
        assert tuple(got[i])[1:6] == want and set(want[4].split(",")) <= set(got[i]["labels"].split(",")) | {""}
    (spdx,) = (r for i, r in got.items() if "SPDX" in (texts[i] or ""))
    assert spdx["labels"] == "apache,bsd,gpl,mit"


def test_license_expressions():
    def value(x):
        return license_scan.evaluate(license_scan.parse(x))

    assert license_scan.parse("A OR B AND C WITH D") == ["A", "B", "C", "D", "with", "and", "or"]
    assert value("MIT OR GPL-2.0-only") == ({"mit", "gpl"}, True) and value("MIT AND GPL-2.0-only") == ({"mit", "gpl"}, False)
    assert value("(MIT") == ({"mit"}, True) and value("") == (set(), False) and value("MIT OR") == ({"mit"}, True)
    assert license_scan.scan("mit license mit license")[1:4] == (2, 0, 2)
    assert value("see the LICENSE file") == (set(), False) and value("TODO") == (set(), False) and value("LicenseRef-own AND EUPL-1.2") == ({"licenseref", "eupl"}, False)
    assert license_scan.scan("SPDX-License-Identifier: see the LICENSE file")[5:] == ("", 0.0)
    assert license_scan.scan("MIT License\nSPDX-License-Identifier: GPL-2.0-only")[5:] == ("gpl,mit", 0.5)


@pytest.mark.parametrize("size", [2048, 64])
def test_packing(docs, texts, ids, size):
    rows = packing.pack(docs, PATH, size=size, group_docs=8).collect()
    pieces, sequences = {}, {}
    for r in rows:
        own = [*ids[r["doc_id"]], 1]
        part = own[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(packed(part)) == r["ids_crc32"] and r["doc_tokens"] == len(own)
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(range(len(texts)))
    for spans, whole in [(s, None) for s in sequences.values()] + [(p, len(ids[i]) + 1) for i, p in pieces.items()]:
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at == whole if whole else at <= size


def test_best_fit_takes_the_tightest():
    assert packing.best_fit([7, 5, 3, 3, 2], 10) == [(0, 0), (1, 0), (0, 7), (1, 5), (1, 8)]


def brute_repeats(texts):
    data = [(t or "").encode() for t in texts]
    w = substring_dedup.WINDOW
    count = Counter(t[i : i + w] for t in data for i in range(len(t) - w + 1))
    out = {}
    for k, t in enumerate(data):
        covered = bytearray(len(t))
        for i in range(len(t) - w + 1):
            if count[t[i : i + w]] > 1:
                covered[i : i + w] = b"\1" * w
        kept = bytes(b for b, c in zip(t, covered, strict=True) if not c)
        out[k] = (len(t), sum(covered), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("group", [substring_dedup.GROUP, 2])
def test_substring_dedup(spark, texts, group, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    passage = "the passage that many share, é and all, " * 9
    texts = [t for t in texts if not t or len(t) < 5000] + [f"{k}{'ab'[k % 2] * 20}{passage[k:]}{k * 7}" for k in range(8)]
    got = by_id(substring_dedup.substring_dedup(documents(spark, texts).repartition(3)))
    assert {i: tuple(r)[1:] for i, r in got.items()} == brute_repeats(texts)


def test_suffix_array():
    rng = np.random.default_rng(2)
    for _ in range(500):
        text = rng.integers(0, rng.integers(1, 5), rng.integers(0, 40)).tolist()
        order = suffix_array(text)
        assert order == sorted(range(len(text)), key=lambda i: text[i:])
        lcp = common_prefixes(text, order)
        for r in range(1, len(order)):
            a, b, h = text[order[r - 1] :], text[order[r] :], lcp[r]
            assert a[:h] == b[:h] and (len(a) == h or len(b) == h or a[h] != b[h])
