"""Each operator against brute force, and the cases its docstring defines."""

import collections
import itertools
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import arc_convert, chat_format, common, decontaminate, kneser_ney, line_dedup, markers, mixing, order_minhash, resharding, suffix_dedup, weak_rules

WORDS = [a + b for a, b in itertools.product("ka to ri mu se lo ne pa vi do".split(), "lan ter mis gor pal ved sun".split())]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, slot string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, rows):
    """rows: (doc_id, text, lang, source); two columns clash with names the operators use."""
    return spark.createDataFrame([(d, t, g, s, len(t or ""), 1, "x") for d, t, g, s in rows], SCHEMA)


def edit_distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


ODD = [(None, "no id", "en", "a"), (900, None, "en", "a"), (901, "", None, None), (902, "...", "en", "b"), (903, "one", "xx", "a"), (903, "one", "xx", "a")]


# Near copies


def test_banded_distance_equals_full():
    rng = random.Random(1)
    for _ in range(800):
        a = [rng.randint(0, 5) for _ in range(rng.randint(0, 25))]
        b = [rng.randint(0, 5) if rng.random() < 0.2 else x for x in a if rng.random() > 0.1] + [1] * rng.randint(0, 3)
        limit = rng.randint(0, 10)
        assert order_minhash.banded_distance(a, b, limit) == min(edit_distance(a, b), limit + 1)


def near_rows(rng):
    rows, d = [], 0
    for g in range(12):
        base = prose(rng, rng.randint(60, 150)).split()
        rows.append((d, " ".join(base), "en", "a"))
        d += 1
        for _ in range(g % 4):
            w = list(base)
            for _ in range(rng.randint(1, max(1, len(w) // 12))):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], [rng.choice(WORDS)], [w[i], rng.choice(WORDS)]])
            rows.append((d, " ".join(w), "en", "a"))
            d += 1
    rows.append((d, rows[0][1].upper(), "en", "a"))
    passage = prose(rng, 60)
    rows += [(d + 1 + k, prose(rng, 150) + " " + passage + " " + prose(rng, 150), "en", "a") for k in range(8)]
    return rows


def test_near_copies_match_all_pairs(spark):
    rng = random.Random(2)
    rows = near_rows(rng)
    toks = {d: t.lower().split() for d, t, *_ in rows}
    pairs = [(a, b) for a, b in itertools.combinations(toks, 2) if edit_distance(toks[a], toks[b]) <= int(0.2 * max(len(toks[a]), len(toks[b])) + 1e-9)]
    label = {d: d for d in toks}
    for _ in toks:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    want = {(d, k) for d, k in label.items() if d != k}
    got = {tuple(r) for r in order_minhash.duplicates(documents(spark, rows)).collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert {d for d, _ in got} <= {d for d, _ in want}


def test_near_copies_just_above_the_threshold(spark):
    rng = random.Random(15)
    rows = []
    for g in range(120):
        w = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        rows.append((2 * g, " ".join(w), "en", "a"))
        for i in rng.sample(range(300), 30 + g % 31):  # similarity 0.90 to 0.80
            w[i] = f"x{rng.randrange(10**9)}"
        rows.append((2 * g + 1, " ".join(w), "en", "a"))
    toks = {d: t.split() for d, t, *_ in rows}
    # Texts of different pairs share no word, so these are all pairs.
    assert all(edit_distance(toks[2 * g], toks[2 * g + 1]) <= 60 for g in range(0, 120, 10))
    got = {tuple(r) for r in order_minhash.duplicates(documents(spark, rows)).collect()}
    assert got <= {(2 * g + 1, 2 * g) for g in range(120)}
    low = [g for g in range(120) if g % 31 >= 24]  # at most 0.82
    assert len(got) >= 0.95 * 120 and sum((2 * g + 1, 2 * g) in got for g in low) >= 0.9 * len(low)


def test_near_copies_odd_rows(spark):
    docs = documents(spark, [*ODD, (1, "a b c d e f g h", "en", "a"), (2, "A b, c d e f g h!", "en", "a"), (None, "a b c d e f g h", "en", "a")])
    assert [tuple(r) for r in order_minhash.duplicates(docs).collect()] == [(2, 1)]
    left = order_minhash.dedup(docs)
    assert left.columns == docs.columns and left.count() == 8
    assert order_minhash.duplicates(docs.limit(0)).count() == 0


def test_rejected_group_members_are_compared_pair_by_pair(spark):
    rng = random.Random(3)
    rows = near_rows(rng)
    a = {tuple(r) for r in order_minhash.duplicates(documents(spark, rows)).collect()}
    b = {tuple(r) for r in order_minhash.duplicates(documents(spark, rows), pivot_rounds=1).collect()}
    assert {d for d, _ in a} == {d for d, _ in b}
    # Groups that are too large to pair are split by further sketches.
    c = {tuple(r) for r in order_minhash.duplicates(documents(spark, rows), pivot_rounds=1, paired=2).collect()}
    assert {d for d, _ in c} == {d for d, _ in a}


def sharing(texts, m):
    """Whether all texts have an entry of a sketch of m in common."""
    t = order_minhash.Tokens(pa.array(texts))
    e = order_minhash.sketch(t.h, t.off, m=m)
    return bool(set.intersection(*({*map(int, x)} for x in e)))


def test_no_link_of_a_group_is_lost(spark):
    rng = random.Random(41)
    rows, want = [], set()
    while len(rows) < 30:
        # Each differs from the one before by 7 of 40 words: the third isn't near the first, the lowest id of their one group, which takes the second.
        chain = [prose(rng, 40).split()]
        places = rng.sample(range(40), 14)
        for some in (places[:7], places[7:]):
            chain.append([rng.choice(WORDS) + "x" if i in some else w for i, w in enumerate(chain[-1])])
        if sharing(texts := [" ".join(w) for w in chain], 1):
            d = len(rows)
            rows += [(d + k, text, "en", "a") for k, text in enumerate(texts)]
            want |= {(d + 1, d), (d + 2, d)}
    got = {tuple(r) for r in order_minhash.duplicates(documents(spark, rows), m=1).collect()}
    assert got == want


def test_hot_groups_lose_nothing(spark):
    rng = random.Random(42)
    rows = []
    phrase = prose(rng, 40)  # texts that share it fall into the same groups
    for d in range(150):
        w = prose(rng, 12 + d % 5).split()
        if d % 3 == 2:
            w = rows[d - 1][1].split()[40:]
            for i in rng.sample(range(len(w)), 10):
                w[i] = rng.choice(WORDS)
        rows.append((d, phrase + " " + " ".join(w), "en", "a"))
    toks = [r[1].split() for r in rows]
    t = order_minhash.Tokens(pa.array([r[1] for r in rows]))
    entries = [{*map(int, x)} for x in order_minhash.sketch(t.h, t.off, m=2)]
    label, links = list(range(150)), [(a, b) for a, b in itertools.combinations(range(150), 2) if entries[a] & entries[b] and edit_distance(toks[a], toks[b]) <= int(0.2 * max(len(toks[a]), len(toks[b])) + 1e-9)]
    for _ in range(150):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert max(sum(e in x for x in entries) for e in set().union(*entries)) > 64 and len(links) > 30
    for paired in (4096, 7):
        got = {tuple(r) for r in order_minhash.duplicates(documents(spark, rows), m=2, paired=paired).collect()}
        assert got == {(d, k) for d, k in enumerate(label) if d != k}


def test_bags_bound_the_distance():
    rng = random.Random(43)
    texts = []
    for n in (3, 60, 127, 128, 129, 140, 250, 256, 260, 300, 1000, 1030, 1200):
        w = [rng.randrange(n) for _ in range(n)]
        texts += [w, [x if rng.random() > 0.1 else rng.randrange(n) for x in w] + [1] * (n // 20), w[n // 10 :]]
    texts.sort(key=len)
    tok = np.concatenate([np.array(x, np.uint64) * np.uint64(2654435761) % np.uint64(2**32) for x in texts])
    bag = order_minhash.Bags(pa.array(order_minhash.bags(tok, np.r_[0, np.cumsum([len(x) for x in texts])]), pa.binary()), 0.8)
    i, j = (np.array(x) for x in zip(*[(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(texts[i]) >= 0.8 * len(texts[j])]))
    apart = bag.apart(i, j)
    true = [order_minhash.banded_distance(texts[x], texts[y], 3000) for x, y in zip(i, j)]
    assert (apart <= true).all() and (apart > 0.2 * np.array([len(texts[y]) for y in j])).sum() > 10


def test_distances_of_a_batch():
    rng = random.Random(21)
    pairs = []
    for _ in range(300):
        a = [rng.randint(0, 5) for _ in range(rng.choice([0, 1, 3, 10, 40]))]
        b = [rng.randint(0, 5) if rng.random() < 0.2 else x for x in a if rng.random() > 0.1] + [1] * rng.randint(0, 3)
        pairs.append((np.array(a, np.uint32), np.array(b, np.uint32)))
    for half in (3, 30):
        for (a, b), d in zip(pairs, order_minhash.batch_distances([order_minhash.trimmed(a, b) for a, b in pairs], half)):
            e = edit_distance(a.tolist(), b.tolist())
            assert d == e if e <= half else d > half
    for least in (0.5, 0.8):
        for (a, b), ok in zip(pairs, order_minhash.similar(pairs, least)):
            assert ok == (edit_distance(a.tolist(), b.tolist()) <= int(max(len(a), len(b)) * (1 - least) + 1e-9))


def test_very_long_pairs_are_aligned_between_anchors():
    rng = random.Random(22)
    a = np.array([rng.randrange(10**6) for _ in range(3000)], np.uint32)
    b = np.delete(a, rng.sample(range(3000), 40))
    assert order_minhash.anchored(a, b, 600) == 40 and order_minhash.anchored(a, b, 30) == 31
    assert order_minhash.anchored(a, a[::-1].copy(), 600) == 601


# Decontamination


def test_leaks_survive_substitutions(spark):
    rng = random.Random(4)
    items = [(k, prose(rng, rng.randint(15, 40))) for k in range(20)] + [(90, None), (91, ""), (92, "kalan"), (None, prose(rng, 20))]
    rows, want = [], set()
    for d in range(60):
        text = prose(rng, 80)
        if d % 3 == 0:
            k = d // 3
            w = items[k][1].split()
            for i in rng.sample(range(len(w)), len(w) // 8):
                w[i] = "zzz"
            text = prose(rng, 40) + ". " + " ".join(w).upper() + ", " + prose(rng, 30)
            want.add((d, k))
        rows.append((d, text, "en", "a"))
    docs = documents(spark, rows + ODD)
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)  # the one-word item names no passage
    small = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench, filter_bits=16).collect()}
    assert small == got  # a filter that lets nearly all through drops and adds nothing
    left = decontaminate.decontaminated(docs, bench)
    assert left.columns == docs.columns and not {r.doc_id for r in left.collect()} & {d for d, _ in got}
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0 and decontaminate.overlaps(docs.limit(0), bench).count() == 0


def brute_overlaps(rows, items):
    """Every item along every diagonal of every text, where any mask's window agrees."""
    out = {}
    for d, t in rows:
        w = t.split()
        for i, text in items:
            g = text.split()
            n = len(g)
            for start in range(-n + 1, len(w)):
                laid = [(k, 0 <= start + k < len(w) and w[start + k] == g[k]) for k in range(n)]
                agree = np.array([x for _, x in laid])
                hit = False
                for offsets, _, low, high in decontaminate.plans(decontaminate.MASKS):
                    if low <= n <= high:
                        places = [0] if high < 1 << 40 else range(n - offsets[-1])
                        hit |= any(all(agree[p + o] for o in offsets) for p in places)
                if not hit:
                    continue
                x, y = max(0, start), min(len(w), start + n)
                match = agree[x - start : y - start]
                begin, end, m = decontaminate.best_stretch(match)
                if n * decontaminate.SHARE < decontaminate.MIN_MATCH and match.any():
                    begin, end, m = int(np.argmax(match)), len(match) - int(np.argmax(match[::-1])), int(match.sum())
                if decontaminate.accept(m, n, decontaminate.MIN_MATCH, decontaminate.SHARE):
                    new = (m, -(x + begin), end - begin)
                    out[d, i] = max(out.get((d, i), new), new)
    return {(d, i, -b, n, m) for (d, i), (m, b, n) in out.items()}


def test_leaks_equal_all_windows(spark):
    rng = random.Random(23)
    items = [(k, prose(rng, n)) for k, n in enumerate([5, 6, 7, 8, 9, 12, 15, 25, 30, 5, 6, 7])] + [(50, "yes"), (51, "one two three four")]
    rows = []
    for d in range(60):
        w = items[d % 12][1].split()
        if d % 2:
            w[rng.randrange(len(w))] = "zzz"
        cutoff = rng.choice([len(w), len(w), max(1, len(w) - 2)])
        rows.append((d, " ".join([prose(rng, rng.randint(1, 12)), *w[:cutoff], prose(rng, rng.randint(1, 8))])))
    docs = documents(spark, [(d, t, "en", "a") for d, t in rows] + [(70, "yes", "en", "a")])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == brute_overlaps(rows, items) and len(got) >= 30
    assert decontaminate.decontaminated(documents(spark, [(d, "yes it is", "en", "a") for d in range(20)]), bench).count() == 20


def test_best_stretch():
    assert decontaminate.best_stretch(np.array([1, 1, 0, 1, 1, 1, 0, 0, 1], bool)) == (0, 6, 5) or decontaminate.best_stretch(np.array([1, 1, 0, 1, 1, 1, 0, 0, 1], bool))[2] >= 3


# Language model


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney from its definition; P(byte, context)."""
    tops = {}
    for t in texts:
        b = b"\n" * (order - 1) + t.encode()
        for i in range(len(t.encode())):
            g = b[i : i + order]
            tops[g] = tops.get(g, 0) + 1
    by = {order: tops}
    for k in range(order - 1, 0, -1):
        by[k] = {}
        for g in by[k + 1]:
            by[k][g[1:]] = by[k].get(g[1:], 0) + 1
    disc, ctx = {}, {}
    for k, t in by.items():
        n = [sum(1 for c in t.values() if c == i) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        d = [0, max(0.01, max(0, 1 - 2 * y * n[2] / n[1]) if n[1] else 0.5), max(0, 2 - 3 * y * n[3] / n[2]) if n[2] else 1, max(0, 3 - 4 * y * n[4] / n[3]) if n[3] else 1.5]
        disc[k] = d
        for g, c in t.items():
            e = ctx.setdefault(g[:-1], [0, 0.0]) if k == len(g) else None
            e[0] += c
            e[1] += d[min(c, 3)]

    def p(g):
        if not g:
            return 1 / 256
        k = len(g)
        low = p(g[1:])
        if g[:-1] not in ctx:
            return low
        total, held = ctx[g[:-1]]
        c = by[k].get(g, 0)
        return max(c - disc[k][min(c, 3)] if c else 0, 0) / total + held / total * low

    return p


def test_kneser_ney_equals_its_definition(spark):
    rng = random.Random(5)
    order = 3
    train = [prose(rng, 12) for _ in range(6)] + ["é ü", ""]
    t = spark.createDataFrame([("en", x) for x in train], "lang string, text string")
    probs, backs = kneser_ney.model(t, order)
    seen = ["kalan toter", "zq é", ""]
    docs = spark.createDataFrame([(k, "en", "en", 0, x) for k, x in enumerate(seen)] + [(0, "en", "en", 0, seen[0])], "doc_id long, lang string, model string, part int, text string")
    p = brute_model(train, order)
    for rows in (kneser_ney.scored(docs, probs, backs, order).collect(), kneser_ney.scored(docs, probs, backs, order, model_rows=0).collect()):
        assert len(rows) == 4
        for r in rows:
            b = b"\n" * (order - 1) + seen[r.doc_id].encode()
            want = -sum(np.log(p(b[i : i + order])) for i in range(len(b) - order + 1))
            assert r.n == len(seen[r.doc_id].encode()) and r.nll == pytest.approx(want, rel=1e-4, abs=1e-6)


def test_quality_tells_junk_from_prose(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for d in range(160):
        junk = d % 8 == 0
        text = prose(rng, 120)
        rows.append((d, "!! ".join(text.upper().split()) if junk else text, "en", "a"))
        if d % 2 == 0 or not junk:
            labels.append((d, 0 if junk else 1, 0))
    docs = documents(spark, rows + ODD)
    lab = spark.createDataFrame([*labels, (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    got = {(r.doc_id, r.keep) for r in kneser_ney.judged(docs, lab, order=4).collect()}
    assert all((d, False) in got for d in range(0, 160, 8))
    assert sum((d, True) in got for d in range(160) if d % 8) >= 0.95 * 140
    assert (900, False) in got and (901, False) in got
    kept = kneser_ney.keep_good(docs, lab, order=4)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    untrained = kneser_ney.judged(docs, lab.limit(0), order=4)
    assert untrained.where("not keep").count() == 2
    assert kneser_ney.judged(docs.limit(0), lab, order=4).count() == 0


def test_quality_rejects_toxic_prose(spark):
    rng = random.Random(14)
    insults = ["zugbalth", "hrokwenz", "pyxgurm"]
    rows = []
    for d in range(400):
        words = prose(rng, 100).split()
        if d % 5 == 0:
            words[rng.randrange(100)] = rng.choice(insults)
            words[rng.randrange(100)] = rng.choice(insults)
        rows.append((d, " ".join(words), "en", "a"))
    lab = spark.createDataFrame([(d, 1, int(d % 5 == 0)) for d in range(300)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in kneser_ney.judged(documents(spark, rows), lab, order=4).collect() if r.keep}
    assert sum(d not in kept for d in range(300, 400, 5)) >= 19
    assert sum(d in kept for d in range(300, 400) if d % 5) >= 72


def test_markers_equal_their_definition(spark, monkeypatch):
    rng = random.Random(44)
    rows = []
    for d in range(300):
        words = prose(rng, 30).split()
        if d % 6 == 0:
            words[rng.randrange(30)] = "zugbalth hrokwenz"
        rows.append((int(d % 6 == 0), " ".join(words)))
    n1, n0, order = 50, 250, markers.TOXIC_ORDER
    sets = [(tox, {(b"\n" * (order - 1) + x.encode())[i : i + order] for i in range(len(x))}) for tox, x in rows]
    a, b = (collections.Counter(g for tox, x in sets if tox == k for g in x) for k in (1, 0))
    want = {}
    for g, x in a.items():
        y = b[g]
        share, ratio = (x + y) / 300, ((x + 0.5) / (n1 + 1)) / ((y + 0.5) / (n0 + 1))
        if x >= markers.TOXIC_TEXTS and ratio > markers.TOXIC_RATIO and 2 * (x * np.log(x / (share * n1)) + y * np.log(max(y, 1) / (share * n0))) > markers.TOXIC_TEST:
            want[int.from_bytes(g, "big")] = np.log(ratio)
    assert len(want) > 8
    labelled = spark.createDataFrame(rows, "tox int, text string")
    for most in (2_000_000, 150):
        monkeypatch.setattr(markers, "CANDIDATES", most)
        keys, weights = markers.markers(labelled)
        assert keys.tolist() == sorted(want) and np.allclose(weights, [want[k] for k in sorted(want)])


# Repeated passages


def test_repeats_match_all_windows(spark):
    rng = random.Random(7)
    passages = [prose(rng, n) for n in (55, 70, 200)]
    rows = []
    for d in range(40):
        text = prose(rng, rng.randint(30, 120))
        if d % 4 == 0:
            text += ". " + passages[d % 3] + " " + prose(rng, 30)
        rows.append((d, text, "en", "a"))
    rows += [(50, prose(rng, 20) + " " + rows[1][1], "en", "a"), (51, " ".join(["same"] * 300), "en", "a"), (52, " ".join(["same"] * 200), "en", "a")]
    docs = documents(spark, rows + ODD + [rows[0]])
    toks = {d: t.replace(".", "").split() for d, t, *_ in rows}
    at = {}
    for d, w in toks.items():
        for i in range(len(w) - 49):
            at.setdefault(tuple(w[i : i + 50]), set()).add(d)
    covered = {d: set() for d in toks}
    for d, w in toks.items():
        for i in range(len(w) - 49):
            if len(at[tuple(w[i : i + 50])]) > 1:
                covered[d] |= set(range(i, i + 50))
    got = {d: set() for d in toks}
    for r in suffix_dedup.repeats(docs).collect():
        assert r.n_tokens >= 50 and r.other_doc_id != r.doc_id
        got[r.doc_id] |= set(range(r.first_token, r.first_token + r.n_tokens))
    assert all(got[d] <= covered[d] for d in toks)
    assert sum(len(x) for x in got.values()) >= 0.9 * sum(len(x) for x in covered.values())
    assert sum(bool(got[d]) for d in toks) >= 0.9 * sum(bool(covered[d]) for d in toks)
    assert suffix_dedup.repeats(docs.limit(0)).count() == 0


def test_suffix_order_is_right(spark):
    rng = random.Random(8)
    seqs = [[rng.randint(1, 3) for _ in range(rng.randint(1, 30))] + [1000 + k] for k in range(12)]
    chain = spark.createDataFrame([(k, 1, s) for k, s in enumerate(seqs)], "c long, p long, vs array<long>")
    got = [(r.c, r.i) for r in sorted(suffix_dedup.suffixes(chain, False).collect(), key=lambda r: r["rank"])]
    assert got == sorted(((k, i) for k, s in enumerate(seqs) for i in range(len(s))), key=lambda x: seqs[x[0]][x[1] :])


# Mixing


def test_schedule_stays_within_one_block():
    for parts in ({"a": 3, "b": 5, "c": 2}, {"a": 700, "b": 200, None: 100}, {"a": 1}):
        n, line, done = sum(parts.values()), mixing.period(parts), dict.fromkeys(parts, 0)
        assert len(line) == n
        for t, s in enumerate(line, 1):
            done[s] += 1
            assert all(abs(done[k] - t * p / n) < 1 for k, p in parts.items())


def same_as_sql(spark, docs, sql, got, benchmark=None):
    con = duckdb.connect()
    frame = docs.select("doc_id", "text", "lang", "source").toPandas()  # noqa: F841
    con.execute("create view documents as select doc_id::bigint as doc_id, text, lang, source from frame")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    shown = lambda r: tuple((0, x) if x is not None else (1, 0) for x in r)
    assert sorted(names) == sorted(got.columns)
    return sorted(map(shown, cur.fetchall())) == sorted(shown(tuple(r[n] for n in names)) for r in got.collect())


@pytest.mark.parametrize("sizes", [{"a": 900, "b": 60, "c": 33, "d": 1}, {"a": 40, "b": 40}, {"a": 5}, {"a": 2000, "b": 1, "c": 1, "d": 700}])
def test_mix_of_unequal_sources_equals_sql(spark, sizes):
    names = [s for s, n in sizes.items() for _ in range(n)]
    docs = documents(spark, [(7 * d, f"t{d}", "en", s) for d, s in enumerate(names)])
    got = mixing.mixed(docs)
    assert got.count() == len(names) and same_as_sql(spark, docs, mixing.SQL["op4_pfair_mix"], got)


def test_mix(spark):
    rows = [(d, f"t{d}", "en", "hot" if d % 10 < 7 else f"s{d % 10}") for d in range(2000)]
    docs = documents(spark, rows + ODD)
    m = mixing.mixed(docs, {"hot": 0.5, "s7": 0.25, "s8": 0.25, "none": 1.0}).collect()
    blocks = {(r.slot, r.source) for r in m}
    assert all(r.release <= r.slot < r.deadline for r in m) and len({s for s, _ in blocks}) == len(blocks)
    assert abs(sum(s == "hot" for _, s in blocks) / len(blocks) - 0.5) < 0.05 and {r.source for r in m} == {"hot", "s7", "s8"}
    assert len({r.place for r in m}) == len(m)
    full = mixing.mix(docs)
    assert full.columns == docs.columns and full.count() == len(rows + ODD)  # without a target or a cap all stay
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mixed(docs, {"none": 1.0}).count() == 0
    same = mixing.ranked(docs, range_rows=100)[0].orderBy("source", "rank").collect()
    assert same == mixing.ranked(docs)[0].orderBy("source", "rank").collect()


def test_a_tiny_source_does_not_end_the_mix(spark):
    rows = [(d, f"t{d}", "en", f"s{d % 5}") for d in range(1000)]
    docs = documents(spark, [*rows, (1000, "stray", "en", "stray"), (1001, "null", "en", None)])
    m = mixing.mixed(docs, block_docs=1, parts=40).collect()
    assert {r.doc_id for r in m} == set(range(1002)) and len({r.place for r in m}) == len(m)
    assert all(r.release <= r.slot < r.deadline for r in m)
    # Where a cap is asked for, a source above it gives its quarter of the mix and no more, and all others are used up.
    rows += [(d, f"t{d}", "en", "hot") for d in range(2000, 4000)]
    hot = documents(spark, [*rows, (1000, "stray", "en", "stray")])
    assert mixing.mixed(hot, block_docs=1).count() == 3001
    m = mixing.mixed(hot, block_docs=1, parts=40, cap=0.25).collect()
    assert {r.doc_id for r in m if r.source != "hot"} == set(range(1001))
    assert sum(r.source == "hot" for r in m) == -(-1001 // 3)


def test_capped_shares():
    s = mixing.capped({"a": 80, "b": 10, "c": 5, "d": 5}, 0.4)
    assert s["a"] == 0.4 and abs(sum(s.values()) - 1) < 1e-9 and s["b"] == pytest.approx(0.3)
    assert mixing.capped({}, 0.4) == {}


# Line dedup


def test_line_dedup_against_sql(spark):
    rng = random.Random(9)
    pool = [prose(rng, 5) for _ in range(40)] + ["", "  ", " kalan\t"]
    rows = [(d, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9))), "en", "a") for d in range(120)] + [(900, None, "en", "a"), (901, "", "en", "a")]
    got = {(r.doc_id, r.text, r.n_removed) for r in line_dedup.deduplicated(documents(spark, rows), batches=7, fanout=2).collect()}
    seen, want = set(), set()
    for d, t, *_ in rows:
        if t is None:
            want.add((d, None, 0))
            continue
        out, gone = [], 0
        for line in t.split("\n"):
            k = line.strip(" \t\r")
            if k and k in seen:
                gone += 1
            else:
                out.append(line)
                seen |= {k} - {""}
        want.add((d, "\n".join(out), gone))
    assert got == want
    odd = line_dedup.deduplicated(documents(spark, [(None, "x\ny", "en", "a"), (1, "x", "en", "a"), (1, "x", "en", "a"), (2, "y\r\nz", "en", "a")])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in odd) == [(False, 1, "x"), (False, 2, "y\r\nz"), (True, 0, "")]
    assert line_dedup.deduplicated(documents(spark, rows).limit(0)).count() == 0


def test_line_index_is_opened_again(spark, tmp_path):
    path = "file://" + str(tmp_path / "lines")
    one = line_dedup.LineIndex(spark, path, buckets=3, fanout=2)
    batches = [[(1, "a\nb"), (2, "b\nc")], [(1, "c\nd"), (3, "a\nx")], [(9, "x\ny\na")], [(4, "y\nz")]]
    seen, got = set(), []
    for k, rows in enumerate(batches):
        index = one if k == 0 else line_dedup.LineIndex(spark, path)  # as a later session would
        out = index.append(documents(spark, [(d, t, "en", "a") for d, t in rows])).collect()
        got.append({(r.doc_id, r.text) for r in out})
        index.close()
    for rows, out in zip(batches, got):
        want = set()
        for d, t in rows:
            lines = [x for x in t.split("\n") if x not in seen and not seen.add(x)]
            want.add((d, "\n".join(lines)))
        assert out == want
    assert line_dedup.LineIndex(spark, path).buckets == 3 and sum(map(len, line_dedup.LineIndex(spark, path).levels)) == 1


def test_line_dedup_with_hashed_ids(spark):
    big = 2**63 - 1
    docs = documents(spark, [(-big, "a\nb", "en", "a"), (big, "b\nc", "en", "a"), (0, "c\na", "en", "a")])
    assert {(r.doc_id, r.text) for r in line_dedup.deduplicated(docs).collect()} == {(-big, "a\nb"), (0, "c"), (big, "")}


# Weak supervision


def test_em_recovers_rule_accuracies():
    rng = np.random.default_rng(1)
    right = np.array([[0.4, 0.99], [0.3, 0.97], [0.5, 0.99], [0.25, 0.98], [0.4, 0.95]])
    good = rng.random(60_000) < 0.85
    votes = np.where(good[:, None], rng.random((60_000, 5)) < right[:, 1], rng.random((60_000, 5)) >= right[:, 0])
    v = np.where(votes, weak_rules.GOOD, weak_rules.BAD)
    pattern, count = np.unique((v * 3 ** np.arange(5)).sum(1), return_counts=True)
    prior, got, post = weak_rules.fit(pattern, count.astype(float), 5)
    assert abs(prior - 0.85) < 0.05 and np.abs(got - right).max() < 0.12


def test_em_over_patterns_equals_em_over_texts():
    """Plain EM, a text at a time, from its definition."""
    rng = np.random.default_rng(3)
    rules, n = 4, 300
    v = rng.choice([0, 1, 2, 2, 2], (n, rules))
    pattern, count = np.unique((v * 3 ** np.arange(rules)).sum(1), return_counts=True)
    _, _, post = weak_rules.fit(pattern, count.astype(float), rules, rounds=25, precision=0)
    prior, right = weak_rules.START_PRIOR, [list(weak_rules.START_RIGHT) for _ in range(rules)]
    for _ in range(25):
        good = []
        for row in v:
            p, q = prior, 1 - prior
            for k, x in enumerate(row):
                if x == weak_rules.GOOD:
                    p, q = p * right[k][1], q * (1 - right[k][0])
                elif x == weak_rules.BAD:
                    p, q = p * (1 - right[k][1]), q * right[k][0]
            good.append(p / (p + q))
        prior = (sum(good) + 1) / (n + 2)
        for k in range(rules):
            bad_of = [(1 - g, x) for g, x in zip(good, v[:, k]) if x]
            good_of = [(g, x) for g, x in zip(good, v[:, k]) if x]
            right[k] = [(sum(g for g, x in bad_of if x == weak_rules.BAD) + 1) / (sum(g for g, _ in bad_of) + 2), (sum(g for g, x in good_of if x == weak_rules.GOOD) + 1) / (sum(g for g, _ in good_of) + 2)]
    of = dict(zip(pattern.tolist(), post))
    assert max(abs(of[int((row * 3 ** np.arange(rules)).sum())] - g) for row, g in zip(v, good)) < 1e-9


def test_weak_rules_tell_junk(spark):
    rng = random.Random(10)
    rows = []
    for d in range(400):
        words = prose(rng, 100).split()
        text = ". ".join(" ".join(words[i : i + 8]) for i in range(0, 100, 8)) + "."
        if d % 20 == 0:
            text = " ".join(w.upper() + "!!" for w in words)
        elif d % 20 == 1:
            text = " | ".join(words)
        elif d % 20 == 2:
            text = " ".join(w + "***" for w in words)
        rows.append((d, text, None, "a"))
    got = {(r.doc_id, r.keep) for r in weak_rules.judged(documents(spark, rows + ODD)).collect()}
    assert all((d, d % 20 > 2) in got for d in range(400))
    assert len([1 for d, _ in got if d is None]) == 1
    assert weak_rules.judged(documents(spark, rows).limit(0)).count() == 0


def test_weak_rules_learn_toxic_words_from_labels(spark):
    rng = random.Random(13)
    insults = ["zugbalth", "hrokwenz", "pyxgurm"]
    rows = []
    for d in range(500):
        words = prose(rng, 100).split()
        if d % 5 == 0:
            words[rng.randrange(100)], words[rng.randrange(100)] = rng.choice(insults), rng.choice(insults)
        rows.append((d, ". ".join(" ".join(words[i : i + 8]) for i in range(0, 100, 8)) + ".", "xx", "a"))
    docs = documents(spark, rows)
    lab = spark.createDataFrame([(d, 1, int(d % 5 == 0)) for d in range(400)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in weak_rules.judged(docs, lab).collect() if r.keep}
    assert sum(d not in kept for d in range(400, 500, 5)) >= 19 and sum(d in kept for d in range(400, 500) if d % 5) >= 76
    # Without labels nothing is known of the words.
    assert weak_rules.judged(docs, lab.limit(0)).where("marked").count() == 0


def test_labels_go_to_the_documents(spark, monkeypatch):
    rng = random.Random(45)
    docs = documents(spark, [(d, prose(rng, 30), "en", "a") for d in range(40)])
    lab = spark.createDataFrame([(d, 1, int(d % 4 == 0)) for d in range(30)], "doc_id long, quality int, toxic int")
    plans, cut = [], weak_rules.cut
    monkeypatch.setattr(weak_rules, "cut", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), cut(df, name))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as when the labels are many
    try:
        weak_rules.judged(docs, lab).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    (plan,) = (p for name, p in plans if name == "told")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_features_equal_plain_python():
    texts = ["Aa bb!! c|d", None, "", "é É *** x x", "one"]
    f = weak_rules.features(pa.array(texts))
    assert f["words"].tolist() == [3, 0, 0, 5, 1]
    assert f["shouts"].tolist()[0] == pytest.approx(2 / 3) and f["symbols"].tolist()[3] == 0.6 and f["bare"].tolist()[3] == 0.2
    assert f["top"].tolist() == [0.25, 0, 0, 0.5, 1] and f["again"].tolist()[3] == 0.5


# Resharding


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(11)
    for _ in range(60):
        sizes = {f"s{k}": rng.randint(0, 50) for k in range(rng.randint(1, 5))}
        caps = {f"s{k}": rng.randint(0, 60) for k in range(rng.randint(1, 6))}
        if sum(sizes.values()) > sum(caps.values()):
            with pytest.raises(ValueError):
                resharding.flows(sizes, caps)
            continue
        out, into = resharding.flows(sizes, caps)
        assert sum(out.values()) == sum(into.values()) == sum(max(0, n - caps.get(s, 0)) for s, n in sizes.items())


def test_whole_blocks_move_little_more_than_the_fewest_bytes():
    """Against every assignment of blocks to shards that fits."""
    rng = random.Random(24)
    tried = 0
    while tried < 40:
        blocks = {(f"s{rng.randint(0, 2)}", k): rng.randint(0, 9) for k in range(rng.randint(1, 7))}
        caps = {f"s{k}": rng.randint(0, 25) for k in range(rng.randint(1, 4))}
        best = None
        for to in itertools.product(caps, repeat=len(blocks)):
            load = dict.fromkeys(caps, 0)
            for t, n in zip(to, blocks.values()):
                load[t] += n
            if all(load[t] <= caps[t] for t in caps):
                moved = sum(n for (s, _), t, n in zip(blocks, to, blocks.values()) if t != s)
                best = moved if best is None else min(best, moved)
        try:
            moves = resharding.transfers(blocks, caps)
        except ValueError:
            continue
        tried += 1
        load = dict.fromkeys(caps, 0)
        for (s, k), n in blocks.items():
            load[moves.get((s, k), s)] += n
        assert all(load[t] <= caps[t] for t in caps) and best is not None
        moved = sum(blocks[b] for b in moves)
        donors = {s for s, _ in moves}
        assert best <= moved <= best + sum(max(n for (s, _), n in blocks.items() if s == d) for d in donors)


def test_a_plan_of_many_shards_takes_seconds():
    import time

    rng = random.Random(25)
    blocks = {(f"s{s}", k): rng.randint(1, 1000) for s in range(2000) for k in range(64)}
    began = time.time()
    moves = resharding.transfers(blocks, resharding.default_capacities(blocks))
    assert time.time() - began < 30 and moves


def test_reshard(spark, tmp_path):
    rng = random.Random(12)
    rows = [(d, prose(rng, rng.randint(1, 60)), "en", "hot" if d % 3 else f"s{d % 4}") for d in range(600)] + ODD
    docs = documents(spark, rows).withColumnRenamed("slot", "shard")
    out = resharding.resharded(docs)
    assert out.columns == [*[c for c in docs.columns if c != "shard"], "shard"] and out.count() == len(rows)
    sizes = {}
    for r in out.collect():
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + len((r.text or "").encode())
    total = sum(sizes.values())
    assert None not in sizes and max(sizes.values()) <= 1.05 * total / 10 + 1 + max(len((r.text or '').encode()) for r in out.collect()) * 10
    left = resharding.rewrite(out, str(tmp_path / "out"))
    new = spark.read.parquet(str(tmp_path / "out"))
    assert left.count() + new.count() == len(rows)
    moved = out.where("source is null or shard <> source")
    assert set(r.source for r in moved.select("source").distinct().collect()) & set(r.source for r in left.select("source").distinct().collect()) == set()
    assert resharding.resharded(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        resharding.resharded(docs, {"a": 1})


# Chat


def test_chat(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi <|im_end|>"), (1, 2, "assistant", None), (2, 0, "user", "a"), (2, 1, "user", "b"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 0, "user", "x"), (4, None, "assistant", "y"), (5, 0, "robot", "x"), (6, 0, None, "x"), (7, 0, "user", "only"), (None, 0, "user", "x"), (8, 1, "assistant", "late"), (8, 0, "user", "early" * 5000)]
    t = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    out = chat_format.formatted(t).orderBy("conv_id", "segment").collect()
    one = [r for r in out if r.conv_id == 1]
    assert "".join(r.text for r in one) == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nhi <​|im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [r.text for r in one if r.loss] == ["<|im_end|>"] and all(r.valid for r in one)
    assert {r.conv_id: r.reason for r in out if not r.valid} == {2: "unexpected role", 3: "repeated turn", 4: "null turn", 5: "unknown role", 6: "unknown role", 7: "unfinished", None: "null conversation"}
    assert [r.turn for r in out if r.conv_id == 8] == [0, 1, 1, 1]
    assert chat_format.formatted(t.limit(0)).count() == 0
    con = duckdb.connect()
    frame = t.drop("segment").toPandas()
    con.register("conversations", frame)
    cur = con.execute(chat_format.SQL["op1_chat_format"])
    names = [c[0] for c in cur.description]
    plain = lambda rows: sorted(tuple("" if x is None or x != x else str(x).removesuffix(".0") for x in r) for r in rows)
    assert plain(cur.fetchall()) == plain(tuple(r[n] for n in names) for r in out)


# ARC


def test_arc(spark):
    import base64
    import gzip
    import hashlib

    desc = b"1 0 X\nURL IP-address Archive-date Content-type Archive-length\n"
    body = b"HTTP/1.0 200 OK\nA: b\n\nhello\nhttp://x 1.1.1.1 20200101000000 text/html 3\n"
    one = b"filedesc://a.arc 0.0.0.0 20200101000000 text/plain %d\n" % len(desc) + desc + b"\nhttp://x/ 1.2.3.4 20200102030405 text/html %d\n" % len(body) + body + b"\ndns:x 1.2.3.4 20200102 text/dns 5\n1.2.3\n"
    two = b"filedesc://b.arc 0.0.0.0 20200101000000 text/plain 200 - - 0 b.arc 6\n2 0 X\n\nhttp://y/ 1.2.3.4 20209 text/html 200 - - 0 b.arc 2\nok\n\nhttp://z/ 1.2.3.4 20200101000000 text/html 200 - - 0 b.arc 99\ncut"
    rows = [("a.arc", one), ("b.arc", two), ("c.arc.gz", gzip.compress(one[:40]) + gzip.compress(one[40:])), ("d", None), ("e", b""), (None, b"rubbish"), ("f", b"http://x 1.1.1.1 20200101000000 text/html x\n"), ("g", b"http://x 1.1.1.1 20200101000000 text/html 0\n")]
    t = spark.createDataFrame([(n, c, 1) for n, c in rows], "name string, content binary, type int")
    out = arc_convert.converted(t).orderBy("archive", "offset").collect()
    a = [r for r in out if r.archive == "a.arc"]
    assert [r.type for r in a] == ["warcinfo", "response", "resource"]
    assert a[1].payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(body.split(b"\n\n", 1)[1]).digest()).decode()
    assert bytes(a[1].record).endswith(b"\r\n\r\n" + body + b"\r\n\r\n") and a[2].date == "2020-01-02T00:00:00Z"
    assert [r.record_id[10:] for r in out if r.archive == "c.arc.gz"] != [] and len([r for r in out if r.archive == "c.arc.gz"]) == 3
    assert [(r.version, r.error) for r in out if r.archive == "b.arc"] == [(2, None), (2, "bad date"), (2, "truncated")]
    assert {r.archive: r.error for r in out if r.archive in ("d", "e", "", "f", "g")} == {"d": "empty archive", "e": "empty archive", "": "bad header", "f": "bad header", "g": None}
    assert arc_convert.converted(t.limit(0)).count() == 0


def test_arc_loses_nothing_without_a_row():
    import gzip

    rec = lambda url, kind="text/html", day="20200101000000": f"{url} 1.1.1.1 {day} {kind} 2\nok\n".encode()
    show = lambda data: [(r[5], r[12]) for r in arc_convert.records("a", data)]
    members = [gzip.compress(rec(f"http://{k}/")) for k in range(4)]
    broken = members[1][:12] + b"\xff\xff\xff" + members[1][15:]
    got = show(members[0] + broken + members[2] + members[3])
    assert [x for x in got if x[1] is None] == [("http://0/", None), ("http://2/", None), ("http://3/", None)] and (None, "bad gzip") in got
    assert show(broken)[-1] == (None, "bad gzip") and show(members[0][:-9]) == [("http://0/", None), (None, "bad gzip")]
    # Blanks in the URL or the content type, and a header that can't be read in between.
    assert show(rec("http://a/b c") + rec("http://x/", "text/html; charset=utf-8")) == [("http://a/b c", None), ("http://x/", None)]
    assert show(rec("http://a/") + b"http://bad line\nok\n" + rec("http://c/")) == [("http://a/", None), (None, "bad header"), ("http://c/", None)]
    v2 = b"filedesc://b 0.0.0.0 20200101000000 text/plain 200 - - 0 b 6\n2 0 X\n\nhttp://y z/ 1.2.3.4 20200101000000 text/html; q=1 200 - - 0 b 2\nok\n"
    assert show(v2) == [("filedesc://b", None), ("http://y z/", None)]
    assert [arc_convert.iso_date(x) for x in ("20209999999999", "20200230", "20200229", "202001020304", "2020")] == [None, None, "2020-02-29T00:00:00Z", "2020-01-02T03:04:00Z", None]


# What all operators have to stand


def test_scripts_without_blanks(spark):
    rng = random.Random(26)
    signs = [chr(0x4E00 + k) for k in range(400)]
    base = [rng.choice(signs) for _ in range(120)]
    near = list(base)
    for i in rng.sample(range(120), 8):
        near[i] = rng.choice(signs)
    other = "".join(rng.choice(signs) for _ in range(60))
    docs = documents(spark, [(1, "".join(base), "zh", "a"), (2, "。".join(["".join(near[:50]), "".join(near[50:])]), "zh", "a"), (3, other + "".join(base[:70]), "zh", "a")])
    assert [tuple(r) for r in order_minhash.duplicates(docs).collect()] == [(2, 1)]
    bench = spark.createDataFrame([(1, "".join(base[10:40]))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.overlaps(docs, bench).collect()} >= {1, 3}
    assert {r.doc_id for r in suffix_dedup.repeats(docs).collect()} >= {1, 3}


ODDER = "`meta.url` string, __place int, __t string, `a``b` int, mix_place string, plan_block long, _id int"


def odd_documents(spark, rows):
    plain = documents(spark, rows).drop("rank", "slot")
    return plain.selectExpr("*", "'u' as `meta.url`", "1 as __place", "'t' as __t", "2 as `a``b`", "'m' as mix_place", "3L as plan_block", "7 as _id", "'s' as Shard", "'g' as __gone", "5 as rank")


def corpus_operators(spark, sf_dir):
    labels, bench = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return {
        "leaks": lambda d: decontaminate.overlaps(d, bench),
        "clean": lambda d: decontaminate.decontaminated(d, bench),
        "mixed": mixing.mixed,
        "mix": mixing.mix,
        "copies": order_minhash.duplicates,
        "dedup": order_minhash.dedup,
        "lines": line_dedup.deduplicated,
        "judged": lambda d: kneser_ney.judged(d, labels, order=3),
        "good": lambda d: kneser_ney.keep_good(d, labels, order=3),
        "repeats": suffix_dedup.repeats,
        "rules": lambda d: weak_rules.judged(d, labels),
        "reshard": resharding.resharded,
    }


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    """A folder of odd tables."""
    at = str(tmp_path_factory.mktemp("odd"))
    rng = random.Random(27)
    long_text = prose(rng, 20_000)
    texts = [(-(2**63), prose(rng, 80), "en", "a.b"), (2**63 - 1, prose(rng, 70), "de", None), (5, long_text, "en", "a.b"), (6, long_text + " end", None, "c"), (7, "中文" * 60, "zh", "c"), (8, "a" * 100_000, "en", "c")]
    rows = texts + ODD + [texts[0]] + [(100 + k, prose(rng, 60), "en", "hot") for k in range(30)]
    odd_documents(spark, rows).write.parquet(at + "/documents.parquet")
    spark.createDataFrame([(100 + k, k % 4 and 1, int(k % 7 == 0)) for k in range(30)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(at + "/labels.parquet")
    spark.createDataFrame([(1, prose(rng, 20)), (None, prose(rng, 20)), (2, None), (3, "")], "item_id long, text string").write.parquet(at + "/benchmark.parquet")
    return at


@pytest.mark.parametrize("name", ["leaks", "clean", "mixed", "mix", "copies", "dedup", "lines", "judged", "good", "repeats", "rules", "reshard"])
def test_odd_tables(spark, tiny, name):
    docs = spark.read.parquet(tiny + "/documents.parquet")
    op = corpus_operators(spark, tiny)[name]
    out = op(docs)
    n = out.count()
    whole = {"mixed": docs.count(), "mix": docs.count(), "judged": docs.count(), "rules": docs.count(), "reshard": docs.count(), "lines": docs.select("doc_id", "text").distinct().count()}
    assert n == whole.get(name, n)
    if name in ("clean", "mix", "dedup", "good"):
        assert out.columns == docs.columns and out.where("doc_id is null").count() == 1
    if name in ("copies", "dedup"):
        kept = {r.doc_id for r in order_minhash.dedup(docs).collect()}
        assert 5 in kept and 6 not in kept
    assert op(docs.limit(0)).count() == 0


def test_python_gets_few_rows_at_a_time(spark):
    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    got = [r.n for r in common.cut(spark.range(5000, numPartitions=1).mapInArrow(rows, "n long"), "few").collect()]
    assert sum(got) == 5000 and max(got) <= 1000
    texts = pa.RecordBatch.from_arrays([pa.array(["x" * 50_000] * 20 + ["y" * 900_000])], ["text"])
    sizes = [sum(map(len, b.column("text").to_pylist())) for b in common.slices([texts])]
    assert sum(sizes) == 1_900_000 and sizes[-1] == 900_000 and max(sizes[:-1]) <= 1 << 18


def test_operators_leave_no_tables_behind(spark, tiny):
    from tessera.llm import common

    docs = spark.read.parquet(tiny + "/documents.parquet")
    before = len(common._TABLES)
    out = order_minhash.dedup(docs)
    held = common._TABLES[before:]
    assert len(held) == 1 and out.count()  # the ids that the result reads
    assert all(spark.read.parquet(p).count() >= 0 for p in held)


def test_no_folder_of_this_machine_off_local():
    from types import SimpleNamespace as N

    from tessera.llm import common

    conf = N(get=lambda k, d: d, set=lambda k, v: None)
    with pytest.raises(ValueError):
        common.shared_dir(N(conf=conf, sparkContext=N(master="spark://host:7077")))
