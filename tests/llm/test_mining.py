"""Collocations, secrets and resampling against brute force."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from vellum.llm import collocations, perfect_hash, resampling, secret_scan

from .helpers import documents, odd_texts


@pytest.fixture(scope="module")
def texts():
    return odd_texts()


def test_perfect_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(3)
    shards = [np.unique(rng.integers(0, 1 << 63, n, np.int64)).astype(np.uint64) for n in (0, 1, 7, 5000)]
    built = [perfect_hash.build(v) for v in shards]
    f = perfect_hash.PerfectHash([(s, w) for s, w, _ in built])
    at = 0
    for k, (values, (_, _, order)) in enumerate(zip(shards, built)):
        assert f.slots(values[order], np.full(len(values), k)).tolist() == list(range(at, at + len(values)))
        at += len(values)
    assert f.size == at
    with pytest.raises(ValueError):
        perfect_hash.build(np.array([5, 5], np.uint64))


def mined(texts, langs, support, longest=5, top=2000):
    f, n = {}, Counter()
    for text, lang in zip(texts, langs):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        rows = []
        for p, a in found.items():
            if any(100 * b >= 100 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, r[2].decode(), -r[1], r[3], r[4], n[lang], -r[0]) for i, r in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def test_collocations_against_counting(spark):
    """Several rounds of a few candidates, full bins, nulls, a text over many blocks, words of several scripts."""
    rng = random.Random(5)
    words = "un deux Quatre été 日本 😀 a.b x\x1cy \x00".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) + rng.choice([".", "\n", "\t;", ""]) for _ in range(60)]
    texts += [None, "", "one two three four five six " * 40, " . , ;", "Same\tline\n" * 30]
    langs = [rng.choice(["fr", "deux", "un"]) for _ in texts]  # names of languages that are words
    rows = documents(spark, texts, dict(enumerate(langs))).repartition(5)
    for top, limits in ((2000, {}), (7, {"round_slots": 1000, "shard_slots": 300, "bits": 64})):
        got = sorted(map(tuple, collocations.collocations(rows, support=8, top=top, **limits).collect()))
        assert got == mined(texts, langs, 8, top=top)


def test_collocations_of_null_language_and_long_text(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 50)
    rng = random.Random(6)
    long = " ".join(rng.choice("abc") for _ in range(90_000))
    rows = documents(spark, [long, None], {0: None, 1: None})
    got = sorted(map(tuple, collocations.collocations(rows, support=100).collect()))
    assert got == mined([long], ["und"], 100) and got


def test_sums_by_hash_are_not_put_together_in_few_tasks(spark, monkeypatch):
    """A task that sums phrases by hash holds all its different ones: only arrays of counts, as large for any task, are made by few."""
    seen, option = {}, "spark.sql.files.maxPartitionBytes"
    for name in ("frequent_hashes", "candidates", "counted"):
        plain = getattr(collocations, name)
        monkeypatch.setattr(collocations, name, lambda blocks, *rest, plain=plain, name=name: (seen.setdefault(name, set()).add(blocks.rdd.getNumPartitions()), plain(blocks, *rest))[1])
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdef") for _ in range(30)) for _ in range(96)]
    rows = documents(spark, texts, dict.fromkeys(range(96), "en")).repartition(24)
    before = spark.conf.get(option)
    spark.conf.set(option, "16k")
    try:
        got = sorted(map(tuple, collocations.collocations(rows, support=20).collect()))
    finally:
        spark.conf.set(option, before)
    assert got == mined(texts, ["en"] * 96, 20) and got
    few = 2 * spark.sparkContext.defaultParallelism
    assert min(seen["frequent_hashes"]) >= 24 > few >= max(seen["candidates"] | seen["counted"])


def test_a_shared_hash_asks_for_another_seed(spark, monkeypatch):
    """Whatever finds two things under one hash, everything is done again with the next seed."""
    texts, asked = ["one two three " * 9] * 3, []
    plain = collocations._distinct_hashes

    def at_first_not(frame, h, *of):
        asked.append(h)
        return plain(frame, h, *of) and len(asked) not in (1, 4)

    monkeypatch.setattr(collocations, "_distinct_hashes", at_first_not)
    rows = documents(spark, texts, {0: "en", 1: "en", 2: "en"})
    assert sorted(map(tuple, collocations.collocations(rows, support=5).collect())) == mined(texts, ["en"] * 3, 5)
    assert len(asked) == 7
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "h long, word string")
    assert not plain(twice, "h", "word") and plain(twice.limit(1), "h", "word")


def test_base_spans_against_the_plain_patterns(texts):
    rng = random.Random(2)
    bits = ["password", "PassWd", "api_key", "apikey", "secret", "token", "=", ": ", '"', "'", " ", "\n", "AKIA", "AKIA0123456789AB", "deadbeef" * 4, "0" * 31, "abcdefgh", "x", "é", "ſecret", "toKen", "Ab/_.=-9"]
    cases = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(4000)] + [t or "" for t in texts]
    word = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in ("password", "passwd", "secret", "token"))
    assign = re.compile(rf"""({word}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for text in cases:
        want = [(m.start(), "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        want += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        want += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
        assert sorted(secret_scan.base_spans(text)) == sorted(want)
        spans = secret_scan.scan(text)[4].split(",")
        assert {f"{k}:{a}:{z}" for a, k, z in want} <= set(spans)


FOUND = [
    ('db.password = "Vk3#pqL0zz"', [("literal", "Vk3#pqL0zz")]),
    ('half = "abcd1234efgh"\nname = "x"\napi_token = half + "ZZ99yy"', [("constant", "abcd1234efgh"), ("literal", "ZZ99yy")]),
    ("const k = 'q8W7e6R5t4Y3';\nconst other = k;\nconnect({ clientSecret: other })", [("constant", "q8W7e6R5t4Y3")]),
    ('stem = "Zx81Qw77"\nprivate_key = f"{stem}-Lm55Vv"', [("constant", "Zx81Qw77"), ("literal", "-Lm55Vv")]),
    ('{"db_password": "Tr0ub4dor&3x", "token_length": "aaaa1234bbbb"}', [("literal", "Tr0ub4dor&3x")]),
    ("export DEPLOY_KEY=wJalrXUtnFEMIK7MDENG # not this: password", [("literal", "wJalrXUtnFEMIK7MDENG")]),
    ("Authorization: Bearer abcDEF123456ghi", [("literal", "abcDEF123456ghi")]),
    ('vault["signing_key"] := `9f8e7d6c5b4a`', [("literal", "9f8e7d6c5b4a")]),
    ('auth_token: str = "Kp3" "Zz8Qw4Rt6"', [("literal", "Kp3"), ("literal", "Zz8Qw4Rt6")]),
    ('if password == "abc123def456": pass', []),
    ("The secret: nobody knows it.", []),
    ('password = "changeme"\nsecret = "${VAULT}"\ntoken = "xxxxxxxxxxxx"', []),
    ('password_file = "/etc/app/pass123.txt"', []),
    ("password = read_from(store)", []),
    ('colour = "Vk3#pqL0zz"', []),
]


@pytest.mark.parametrize(("text", "want"), FOUND)
def test_assignments(text, want):
    got = [(kind, text[a:z]) for a, kind, z in secret_scan.Reader(text).spans()]
    assert got == want


def test_values_are_kept_however_many_targets_follow():
    between = "".join(f"n{i} = '{i}'\n" for i in range(25_000))
    text = f"k = 'q8W7e6R5t4Y3'\n{between}password = k\n{between}token = k + 'Zz'\n"
    got = [(kind, text[a:z]) for a, kind, z in secret_scan.Reader(text).spans()]
    assert got == [("constant", "q8W7e6R5t4Y3"), ("literal", "Zz")]


def test_values_that_go_on_from_others_share_them():
    text = "v0 = 'Zx81Qw77'\n" + "".join(f"v{i} = v{i - 1} + 'é{i}'\n" for i in range(1, 20_000)) + "x = v19999\n" + "x = x + x\n" * 2000 + "password = x\n"
    got = [(kind, text[a:z]) for a, kind, z in secret_scan.Reader(text).spans()]
    assert got == [("constant", "Zx81Qw77"), *(("constant", f"é{i}") for i in range(1, 20_000))]


def test_scores_of_parts_are_those_of_the_whole():
    rng = random.Random(4)
    bits = ["example", "your_", "change", "-me", "{{", "}}", "<", ">", "${", "}", "aA", "a", "kK\u212a", "ſecret", "se", "cret", "9f8e", "é", " ", "q8W7e6R5"]
    for _ in range(3000):
        parts = [rng.choice(bits) for _ in range(rng.randint(1, 9))]
        whole = secret_scan.Value([("".join(parts), 0, 0)])
        tree = secret_scan.Value([(p, 0, 0) for p in parts[:2]])
        for p in parts[2:]:
            tree = secret_scan.Value([tree, (p, 0, 0)])
        assert [secret_scan.value_score(tree.looks(), q) for q in (False, True)] == [secret_scan.value_score(whole.looks(), q) for q in (False, True)]
        value = "".join(parts)
        if secret_scan.PLACEHOLDER.fullmatch(value) or re.fullmatch(r"(?i)(.)\1*", value):
            assert secret_scan.value_score(whole.looks(), True) == 0.0


def test_secret_scan_rows(spark, texts):
    odd = [*texts, *(t for t, _ in FOUND), 'password="Zz' + "9Q" * 40_000 + '"']
    got = {r["doc_id"]: r for r in secret_scan.secret_scan(documents(spark, odd).repartition(3)).collect()}
    for i, t in enumerate(odd):
        assert tuple(got[i])[1:] == secret_scan.scan(t or "")
    assert got[0]["spans"] == "" and got[0]["base_sha256"] == sha256(b"").hexdigest()
    assert got[len(odd) - 1]["n_assign"] == 1


def test_redaction_joins_overlapping_spans():
    text = 'x password = "Vk3pqL0zzA" y'
    assert secret_scan.redacted(text, secret_scan.scan(text)[4]) == 'x [secret]" y'


def test_tournament_merges_runs_of_any_number():
    rng = random.Random(1)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted((rng.randint(0, 9), i, j) for j in range(rng.choice([0, 1, 5, 30]))) for i in range(k)]
        assert list(resampling.tournament([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def resampled(texts, target, ids):
    def found(t):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return len(words), [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    docs = [found(t) for t in texts]
    s, t = Counter(b for _, f in docs for b in f), Counter(b for x in target for b in found(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in s}
    rows = []
    for i, (n, f) in zip(ids, docs):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    order = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: k for k, r in enumerate(order[: 25 * len(order) // 100], 1)}
    return sorted((*r[:4], rank.get(r[0])) for r in rows)


@pytest.mark.parametrize("range_rows", [3, 1 << 20])
def test_resampling_against_brute_force(spark, texts, range_rows, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 100)
    rng = random.Random(4)
    many = texts + [" ".join(rng.choice(["alpha", "beta", "Gamma", "été", "x1"]) for _ in range(rng.randint(15, 40))) for _ in range(150)]
    target = ["alpha beta gamma", "beta alpha", None, ""]
    docs, bench = documents(spark, many).repartition(7), documents(spark, target).select("text", "label")
    got = sorted(map(tuple, resampling.resample(docs, bench, range_rows=range_rows).collect()), key=lambda r: r[0])
    assert got == resampled(many, target, range(len(many)))


def test_ties_go_to_the_smaller_id_and_all_may_be_equal(spark, monkeypatch):
    monkeypatch.setattr(resampling, "noise", lambda doc_id, seed=7: 0)
    gain = np.zeros(10000, np.int64)
    runs = resampling.weighed(documents(spark, ["w " * 30] * 40).repartition(3).select("doc_id", "text"), gain)
    assert {r["score"] for r in runs.collect()} != set() and all(r["weight"] == 0 for r in runs.collect())
    entries = [[(-5, False, i, i) for i in range(k, 12, 3)] for k in range(3)]
    assert [e[2] for e in resampling.tournament([iter(e) for e in entries])] == list(range(12))


def test_an_id_that_a_third_of_the_rows_share_is_divided(spark):
    rows = documents(spark, ["one two three four five six seven eight nine ten " * 3] * 90).selectExpr("CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id END AS doc_id", "text")
    got = resampling.resample(rows.repartition(5), rows.limit(1), range_rows=2).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert len(got) == 90 and ranks == list(range(1, 23))
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["score"] for r in drawn] == sorted((r["score"] for r in got), reverse=True)[:22]
