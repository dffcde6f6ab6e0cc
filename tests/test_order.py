import random
from itertools import product

from vellum.functions import identifiers, scheme
from vellum.operators import order, stream


def by_hand(base, texts, far):
    """The variants of one edition, text by text."""
    at = {x: i for i, x in enumerate(base)}
    own = {t: [at[x] for x in o if x in at] for t, o in texts.items()}
    said = []
    for t, o in own.items():
        for moved, after, _ in order.blocks(sorted(o), o):
            point = 0 if after is None else after + 1
            said.append((t, moved, after, min([*moved, point]), max([*moved, point - 1])))
    distant = {tuple(sorted(m)) for _, m, _, lo, hi in said if hi - lo + 1 > far}
    carried = {(t, k) for t, m, *_ in said if tuple(sorted(m)) in distant for k in m}
    covered = [set(range(lo, hi + 1)) for _, m, _, lo, hi in said if tuple(sorted(m)) not in distant]
    rows = {}

    def add(place, is_far, segments, reading, after, is_base, text=None):
        key = (place, is_far, tuple(segments), tuple(reading), after, is_base)
        rows.setdefault(key, [])
        if text is not None:
            rows[key].append(text)

    while covered:
        one = covered.pop()
        while any(one & x for x in covered):
            one |= next(x for x in covered if one & x)
            covered = [x for x in covered if not x <= one]
        stretch = sorted(one)
        reads = {t: [k for k in o if k in one and (t, k) not in carried] for t, o in own.items()}
        reads = {t: r for t, r in reads.items() if len(r) > 1}
        if any(r != sorted(r) for r in reads.values()):
            add(stretch[0], False, stretch, stretch, None, True)
            for t, r in reads.items():
                add(stretch[0], False, stretch, stretch if r == sorted(r) else r, None, r == sorted(r), t)
    for block in distant:
        follows = block[0] - 1 if block[0] else None
        add(block[0], True, block, block, follows, True)
        for t, o in own.items():
            mine = [(m, a) for w, m, a, *_ in said if w == t and set(m) & set(block)]
            whole = [(m, a) for m, a in mine if tuple(sorted(m)) == block]
            if whole:
                add(block[0], True, block, whole[0][0], whole[0][1], False, t)
            elif not mine and set(o) & set(block):
                add(block[0], True, block, block, follows, True, t)
    name = lambda ks: tuple(base[k] for k in ks)
    return {(p, f, name(s), name(r), None if a is None else base[a], b, min(t, default=None), len(t)) for (p, f, s, r, a, b), t in rows.items()}


def test_variants_by_hand(spark):
    rng, editions, orders, want = random.Random(7), [], [], set()
    for g in range(60):
        base = [f"s{i}" for i in range(rng.choice([2, 4, 9, 14]))]
        rng.shuffle(base)
        texts = {}
        for t in range(rng.choice([1, 3, 5])):
            own = [x for x in base if rng.random() < 0.9] + ["other"] * (t % 2)
            for _ in range(rng.choice([0, 1, 2])):
                i, n = rng.randrange(len(own) or 1), rng.choice([1, 1, 2])
                block = own[i : i + n]
                del own[i : i + n]
                k = rng.randrange(len(own) + 1)
                own[k:k] = block
            texts[t] = own
        texts[9] = list(texts[0])  # a copy is one more text with the reading
        editions.append((g, base))
        orders += [(g, t, o) for t, o in texts.items()]
        want |= {(g, *r) for r in by_hand(base, texts, 5)}
    found = order.order_variants(spark.createDataFrame(editions, "grp long, base array<string>"), spark.createDataFrame(orders, "grp long, text long, own array<string>"), 5)
    rows = [(r["grp"], r["place"], r["far"], tuple(r["segments"]), tuple(r["reading"]), r["after"], r["is_base"], r["text"], r["n_texts"]) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {True, False} == {r[2] for r in want}


def readings_of(levels, label):
    """All ways to cut a label into its levels, the one with the shortest first parts first."""

    def fits(i, value, parted):
        kind = str.isdigit if levels[i].kind == "number" else lambda x: not x.isdigit()
        if i + 1 < len(levels) and levels[i + 1].separator == "":
            return bool(value) and all(kind(c) for c in value)
        return bool(value) and (kind(value[0]) or levels[i].kind == "text" and parted)

    def cut(i, rest):
        parted = i == 0 or levels[i].separator != ""
        if i + 1 == len(levels):
            if fits(i, rest, parted):
                yield [rest]
            return
        mark = levels[i + 1].separator
        for k in range(len(rest) + 1):
            if rest[k:].startswith(mark) and fits(i, rest[:k], parted):
                yield from ([rest[:k], *more] for more in cut(i + 1, rest[k + len(mark) :]))

    return next(cut(0, label), None)


def test_labels_of_all_kinds(spark):
    L = scheme.Level
    schemes = [
        [L("a")], [L("a", "text")], [L("a"), L("b")], [L("a", "text"), L("b", "text", ", ")], [L("a"), L("b", "text", "")], [L("a", "text"), L("b", "number", "")],
        [L("a"), L("b"), L("c", "text", "")], [L("a", "text"), L("b", "number", "."), L("c", "number", ".")], [L("a"), L("b", "text", ""), L("c", "number", "")],
    ]
    labels = ["".join(x) for n in range(6) for x in product("1a.", repeat=n)] + ["12.3", " 1.2 ", "10a12", "1, 2", "a, b, c", "x\n1.2", "1. .2", "17a", "ἀ1"]
    rows = spark.createDataFrame([(x,) for x in labels], "label string")
    got = rows.select("label", *(scheme.parse_label(s, "label").alias(f"s{i}") for i, s in enumerate(schemes))).collect()
    for r in got:
        for i, levels in enumerate(schemes):
            cut = readings_of(levels, r["label"].strip())
            want = None if cut is None or not all(x.strip() for x in cut) else {x.key: v.strip(" ") for x, v in zip(levels, cut, strict=True)}
            assert r[f"s{i}"] == want, (r["label"], levels)


def test_spellings_of_rights(spark):
    by, mark, inc = "https://creativecommons.org/licenses/by/4.0/", "https://creativecommons.org/publicdomain/mark/1.0/", "http://rightsstatements.org/vocab/InC/1.0/"
    given = {
        by: by, by[:-1]: by, "http" + by[5:] + "deed.de": by, by + "legalcode": by, by.upper(): by, f" {mark}deed ": mark, "https" + inc[4:]: inc, inc.lower(): inc,
        by.replace("4", "3"): None, by + "deed/x": None, by + "about": None, "ftp" + by[5:]: None, "": None, "by": None,
    }
    rows = spark.createDataFrame([(x,) for x in [*given, None]], "v string").select("v", identifiers.normal_rights("v").alias("r")).collect()
    assert {r["v"]: r["r"] for r in rows} == {**given, None: None}


def test_search_folds_and_escapes_its_phrase(spark):
    docs = spark.createDataFrame([(1, "In the\nend. (a+b) The end"), (2, None), (3, "")], "doc_id long, text string")
    find = lambda *phrase: sorted((r["line"], r["pos"]) for r in stream.search(docs, phrase).collect())
    assert find("The", "end.") == [(0, 1), (1, 2)] == find("the end")
    assert find("(a+b)") == [(1, 1)] and find("(") == [] and find("e.d") == []
