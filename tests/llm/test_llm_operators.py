"""Each operator against a brute-force version, and on nulls, empties, ties, repeats, empty tables and extra columns."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import bpe_codec, groups, hash_neighbours, jaccard_join, license_scan, quality_classifier, source_mixing, substring_dedup, suffix_repetition, toxicity_grammar, url_language_model
from tidemark.llm.arrowtext import hash_strings, slices, words

#: Columns that operators name themselves.
CLASH = "keep boolean, tokens int, score double, label string, removed string, _text string, _id long, cut_id int, cuts int, _cuts int, i int, copy int, n int, i2 int, copy2 int, served int, gone int, bucket int, begins int"


def docs_of(spark, rows, extra=True):
    """(doc_id, text[, source]) with columns whose names clash."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    schema = "doc_id long, text string, source string, n_chars long"
    if not extra:
        return spark.createDataFrame(full, schema)
    return spark.createDataFrame([(*r, None, 1, 0.5, "x", "y", None, 7, *range(12)) for r in full], f"{schema}, {CLASH}")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


ODD = [(1, None), (2, ""), (3, "   \n\t "), (None, "some words without an id"), (4, "one"), (4, "one"), (5, "word " * 40_000), (6, "a" * 50_000)]


# helpers
def test_slices_and_words():
    texts = ["a b  c", None, "", " x ", "y" * 100, "é ü"]
    batch = pa.RecordBatch.from_pydict({"t": pa.array(texts)})
    parts = list(slices([batch], 0, budget=4, rows=2))
    assert sum(p.num_rows for p in parts) == 6 and all(p.num_rows <= 2 for p in parts)
    w = words(batch.column(0))
    assert [w.vocabulary.take(pa.array(w.ids[a:b])).to_pylist() for a, b in zip(w.offsets, w.offsets[1:])] == [(t or "").split() for t in texts]
    h = hash_strings(pa.array(["a", "b", "ab", "", "a\0", "é"]))
    assert len(set(h.tolist())) == 6
    assert (hash_strings(pa.array(["x", "a", "b"]).slice(1)) == h[:2]).all()


# 1 mixing
def test_flow_costs_least():
    rng = random.Random(3)
    for it in range(60):
        names = "AB" if it % 2 else "ABC"
        pats = rng.sample([p for r in (1, 2, 3) for p in itertools.combinations(names, r)], k=rng.randint(1, 3))
        cap, rep = {p: rng.randint(1, 3) for p in pats}, 2
        weights, budget = {s: rng.choice([1, 2, 3]) for s in names}, rng.randint(1, 8)
        quota = {s: round(budget * weights[s] / sum(weights.values())) for s in names}
        cost = lambda n, c: sum(k * min(c, max(0, n - k * c)) for k in range(rep))
        value = lambda used: (sum(used.values()), -sum(cost(n, cap[p]) for p, n in used.items()))
        flows = source_mixing.route(cap, weights, budget, rep)
        assert all(sum(x for f in flows.values() for q, x in f if q == s) <= quota[s] for s in names)
        got = value({p: sum(x for _, x in f) for p, f in flows.items()})
        arcs, best = [(p, s) for p in pats for s in p], None
        for x in itertools.product(*[range(min(cap[p] * rep, quota[s]) + 1) for p, s in arcs]):
            u, v = Counter(), Counter()
            for (p, s), n in zip(arcs, x):
                u[p] += n
                v[s] += n
            if all(u[p] <= cap[p] * rep for p in pats) and all(v[s] <= quota[s] for s in names):
                best = max(best or (0, 0), value({p: u[p] for p in pats}))
        assert got == best


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 50), f"s{min(3, i % 7)}") for i in range(200)]
    rows += [(1000 + i, rows[i][1], "s9") for i in range(20)]  # copies under another source
    d = docs_of(spark, rows)
    got = source_mixing.select(d, weights={"s0": 1, "s1": 1, "s2": 1, "s3": 1, "s9": 1}, budget=15_000).collect()
    served = Counter()
    for r in got:
        served[r.source] += r.tokens
    assert all(abs(n - 3000) <= 60 for s, n in served.items() if s != "s0" and s != "s9") and served["s9"] >= 2900
    member = defaultdict(set)
    text_of = {r[0]: r[1] for r in rows}
    for i, t, s in rows:
        member[t].add(s)
    assert all(r.source in member[text_of[r.doc_id]] for r in got)
    assert all(r.doc_id < 1000 for r in got)  # the smallest doc_id stands for its copies
    again = source_mixing.select(d, weights={"s0": 1, "s1": 1, "s2": 1, "s3": 1, "s9": 1}, budget=15_000).collect()
    assert sorted(got) == sorted(again)
    kept = source_mixing.select(d).collect()
    assert {r.doc_id for r in kept} == set(range(200))  # the default budget loses no document
    mixed = source_mixing.mixed(d)
    assert mixed.columns == d.columns and mixed.count() == len(kept)


def test_mixing_edges(spark):
    got = source_mixing.select(docs_of(spark, [(*r, None) if k % 2 else (*r, "s") for k, r in enumerate(ODD)])).collect()
    assert {r.doc_id for r in got} == {4, 5, 6}
    assert source_mixing.select(docs_of(spark, [])).count() == 0
    capped = source_mixing.select(docs_of(spark, [(1, "a b", "x")]), budget=1000, repeats=4).collect()
    assert [r.repetition for r in sorted(capped, key=lambda r: r.repetition)] == [1, 2, 3, 4]
    needed = source_mixing.select(docs_of(spark, [(1, "a b", "x")]), budget=1000).collect()
    assert sorted(r.repetition for r in needed) == [*range(1, 501)]


def walk(rows, flows, seed):
    """Selections by walking each pattern's line, one token after another. rows: (doc_id, text, source)."""
    pmod = lambda x, m: x % m
    docs = {}
    for i, t, s in rows:
        d = docs.setdefault(t, [i, set(), len(t.split())])
        d[0] = min(d[0], i)
        d[1].add(s)
    out = Counter()
    for pattern, cuts in flows.items():
        own = [d for d in docs.values() if tuple(sorted(d[1])) == pattern]
        own.sort(key=lambda d: seed[d[0]])
        ends, upto = [], 0
        for s, tokens in cuts:
            upto += tokens
            ends.append((upto, s))
        at, turn = 0, 1
        while at < upto:
            for d in own:
                if at < upto:
                    out[d[0], next(s for e, s in ends if at < e), turn] += 1
                at += d[2]
            turn += 1
    return out


def test_mixing_walks_each_line(spark):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randint(1, 30)), rng.choice("abc")) for i in range(120)]
    rows += [(500 + i, rows[i][1], rng.choice("abc")) for i in range(60)]
    d, weights = docs_of(spark, rows), {"a": 5, "b": 1, "c": 2}
    key = d.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(source_mixing.SEED + 1)), F.lit(source_mixing.BUCKETS)), F.xxhash64(F.lit(source_mixing.SEED), "doc_id")).collect()
    capacity = Counter()
    members = defaultdict(set)
    for _, t, s in rows:
        members[t].add(s)
    for t, s in members.items():
        capacity[tuple(sorted(s))] += len(t.split())
    got = Counter((r.doc_id, r.source, r.repetition) for r in source_mixing.select(d, weights, 9000).collect())
    assert got == walk(rows, source_mixing.route(capacity, weights, 9000), {r[0]: r[1:] for r in key})


def test_mixed_takes_each_selection_once(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "a b c", "y"), (2, "a b c", "z"), (3, "d e", None), (1, "another text", "x"), (None, "no id", "x"), (4, None, "x")]
    d = docs_of(spark, rows)
    for budget in (None, 60):
        chosen, mixed = source_mixing.select(d, budget=budget).collect(), source_mixing.mixed(d, budget=budget)
        assert mixed.columns == d.columns and mixed.dtypes == d.dtypes
        got = mixed.collect()
        assert Counter((r.doc_id, r.source) for r in got) == Counter((r.doc_id, r.source) for r in chosen)
        assert {(r.doc_id, r.text) for r in got} == {(1, "a b c"), (3, "d e"), (1, "another text")}
    assert source_mixing.mixed(docs_of(spark, [])).count() == 0


# 2 suffix repetition
def brute_repetition(w, least):
    n, covered, best = len(w), set(), 0
    for i in range(n):
        length = 0
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and w[i + k] == w[j + k]:
                k += 1
            length = max(length, k)
        if length >= least:
            best = max(best, length)
            covered |= set(range(i, i + length))
    return len(covered), best


def test_suffix_repetition(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["a " * 9, "a"]
    for least in (1, 2, 3, 5, 8):
        got = suffix_repetition.score(docs_of(spark, list(enumerate(texts))), least).collect()
        for r in got:
            assert (r.repeated_words, r.longest_repeat) == brute_repetition(texts[r.doc_id].split(), least)
    odd = suffix_repetition.score(docs_of(spark, ODD)).collect()
    assert len(odd) == len(ODD)
    assert all(r.keep for r in odd if r.doc_id in (1, 2, 3, 4, 6)) and not any(r.keep for r in odd if r.doc_id == 5)
    assert suffix_repetition.score(docs_of(spark, [])).count() == 0


# 3 toxicity
def test_toxicity(spark):
    texts = {
        "you are an idiot": True,
        "you are not an idiot": False,
        "he said that you are an idiot": False,
        "take out the trash": False,
        "worthless moron, pathetic clown": True,
        "i will kill you": True,
        "kill the lights": False,
        "The weather is fine. You may go.": False,
        "IDIOT!! You!!": False,
        "You IDIOT!!": True,
        "he said it was fine.\nyou idiot": True,
    }
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in toxicity_grammar.score(docs_of(spark, rows)).collect()}
    assert {t: got[i].toxic for i, t in rows} == texts
    odd = toxicity_grammar.score(docs_of(spark, ODD)).collect()
    assert len(odd) == len(ODD) and not any(r.toxic for r in odd)
    assert toxicity_grammar.score(docs_of(spark, [])).count() == 0


def sentence_by_sentence(text, learnt):
    """Toxicity by plain loops over the words of each sentence."""
    m = toxicity_grammar
    names = {m.INSULT: "insult", m.THREAT: "threat", m.HINT: "hint"}
    total = reach = 0
    said = target = paid = False
    owed = 0.0
    for line in text.split("\n"):
        for word in line.split():
            s, mark = m.symbols(word, learnt)
            if s == m.NOT:
                reach = m.REACH
            else:
                kind = names.get(s)
                if kind:
                    kind = ("negated " if reach else "") + ("reported " if said else "") + kind
                    bonus = m.ADDRESSED.get(kind, 0.0)
                    total += m.WEIGHTS[kind]
                    if bonus and not paid:
                        if target:
                            total, paid = total + bonus, True
                        else:
                            owed = max(owed, bonus)
                elif s == m.TARGET:
                    target = True
                    if owed and not paid:
                        total, paid = total + owed, True
                said = said or s == m.SAYS
                reach = max(0, reach - 1)
            if mark == m.COMMA or mark == m.END:
                reach = 0
            if mark == m.END:
                said = target = paid = False
                owed = 0.0
        reach, said, target, paid, owed = 0, False, False, False, 0.0
    return round(total, 4)


def test_toxicity_by_sentences(spark):
    rng = random.Random(21)
    pick = ["idiot", "moron!", "kill", "you", "They", "not", "don't", "said", "claims,", "zorbly", "zorbish.", "house", "the,", "tree.", "cat", "?!", "never", "him;"]
    texts = [" ".join(rng.choice(pick) + ("\n" if rng.random() < 0.1 else "") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    learnt = frozenset({"zorb", "cats$"})
    got = {r.doc_id: r for r in toxicity_grammar.score(docs_of(spark, list(enumerate(texts))), learnt=learnt).collect()}
    for i, t in enumerate(texts):
        assert got[i].toxicity == pytest.approx(sentence_by_sentence(t, learnt)), t
        assert got[i].toxic == (got[i].toxicity >= toxicity_grammar.THRESHOLD)


def test_composition_equals_cascade():
    first, second, third = toxicity_grammar.negation(), toxicity_grammar.reported_speech(), toxicity_grammar.scorer()
    whole = toxicity_grammar.compose(toxicity_grammar.compose(first, second), third)
    rng = random.Random(2)
    for _ in range(200):
        p = q = r = s = 0
        a = b = 0.0
        for x in (rng.randrange(toxicity_grammar.SYMBOLS) for _ in range(30)):
            p, y, w1 = first.arcs[p, x]
            q, y, w2 = second.arcs[q, y]
            r, _, w3 = third.arcs[r, y]
            s, _, w = whole.arcs[s, x]
            a, b = a + w1 + w2 + w3, b + w
        assert a == pytest.approx(b)


def test_toxic_labels(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    said = toxicity_grammar.score(d).withColumnRenamed("toxic", "said").join(labels, "doc_id").join(d.select("doc_id", "lang"), "doc_id").where("lang = 'en'").collect()
    flagged = [r for r in said if r.said]
    assert sum(r.toxic for r in flagged) / len(flagged) > 0.95
    assert len(flagged) / sum(r.toxic for r in said) > 0.85


def test_toxic_labels_of_all_languages(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    learnt = toxicity_grammar.learn(d, labels.where("doc_id % 2 = 0"))
    odd = d.join(labels.where("doc_id % 2 = 1"), "doc_id", "left_semi")
    said = toxicity_grammar.score(odd, learnt=learnt).withColumnRenamed("toxic", "said").join(labels, "doc_id").join(odd.select("doc_id", "lang"), "doc_id").collect()
    for lang in ("en", "fr", "de", "es"):
        of = [r for r in said if r.lang == lang]
        flagged = [r for r in of if r.said]
        assert sum(r.toxic for r in flagged) > 0.95 * len(flagged)
        assert sum(r.toxic for r in flagged) > 0.65 * sum(r.toxic for r in of)


def test_toxic_labels_learnt(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 40) + (" nurgsal nurgsen nurgsik" if i % 4 == 0 else " nurg" if i % 4 == 1 else "")) for i in range(200)]
    labels = spark.createDataFrame([*((i, int(i % 4 == 0)) for i, _ in rows), (None, 1), (3, None), (999, 1)], "doc_id long, toxic int")
    docs = docs_of(spark, rows)
    learnt = toxicity_grammar.learn(docs, labels)
    assert {"nurgsal$", "nurgs"} <= learnt and all(x.startswith("nurg") for x in learnt)
    assert {r.doc_id for r in toxicity_grammar.score(docs, learnt=learnt).collect() if r.toxic} == {i for i, _ in rows if i % 4 == 0}
    assert toxicity_grammar.learn(docs, labels.where("toxic = 1")) == toxicity_grammar.learn(docs, labels.where("false")) == toxicity_grammar.learn(docs_of(spark, []), labels) == frozenset()


# 4 licenses
def brute_licenses(text, templates):
    norm = lambda t: re.sub(r"[\W_]+", " ", t.lower()).split()
    w, found = norm(text), set()
    for name, t in templates.items():
        v = norm(t)
        if any(w[i : i + len(v)] == v for i in range(len(w))):
            found.add(name)
    return found


def test_license_scan(spark):
    rng = random.Random(4)
    names = ["MIT-notice", "Apache-2.0-notice", "GPL-3.0-notice", "CC-BY-NC-4.0", "BSD", "MIT"]
    rows = []
    for i in range(60):
        body = prose(rng, 80).split()
        if i % 3:
            body[rng.randint(0, 80) : 0] = license_scan.TEMPLATES[names[i % len(names)]].split()
        rows.append((i, " ".join(body)))
    d = docs_of(spark, rows)
    got = defaultdict(set)
    for r in license_scan.scan(d).collect():
        got[r.doc_id].add(r.template)
        assert r.matched >= license_scan.MATCH
    for i, t in rows:
        exact = brute_licenses(t, license_scan.TEMPLATES)
        longest = {n for n in exact if not any(n != m and license_scan.TEMPLATES[n].rstrip(".").lower() in license_scan.TEMPLATES[m].lower() for m in exact)}
        assert got[i] == longest, i


def test_license_interrupted(spark):
    w = license_scan.TEMPLATES["BSD"].split()
    cut, header = len(w) // 3, "page seven of the manual".split()
    text = "before it " + " ".join(w[:cut] + header + w[cut : 2 * cut] + header + w[2 * cut :]) + " behind it"
    apart = " ".join(w[:cut]) + " filler" * 300 + " " + " ".join(w[cut : 2 * cut]) + " filler" * 300 + " " + " ".join(w[2 * cut :])
    got = license_scan.scan(docs_of(spark, [(1, text), (2, apart)])).collect()
    assert [(r.doc_id, r.template) for r in got] == [(1, "BSD")] and got[0].from_word == 2


def test_license_with_changes(spark):
    t = license_scan.TEMPLATES["BSD"].split()
    changed = t[:10] + ["oddly"] + t[10:20] + t[21:]
    twice = " ".join(changed) + " in between " * 30 + " ".join(t)
    got = license_scan.scan(docs_of(spark, [(1, " ".join(changed)), (2, " ".join(t[:8])), (3, twice), (3, twice)])).collect()
    assert Counter(r.doc_id for r in got) == {1: 1, 3: 2}
    assert license_scan.scan(docs_of(spark, ODD)).count() == 0 and license_scan.scan(docs_of(spark, [])).count() == 0


# 5 Jaccard join
def gram_set(text, n):
    w = [(re.sub(r"^[\W_]+|[\W_]+$", "", x).lower() or x) for x in (text or "").split()]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_pairs(rows, tau, n):
    best = {}
    own = [(i, gram_set(t, n)) for i, t in rows if i is not None]
    for (a, x), (b, y) in itertools.combinations(own, 2):
        shared = len(x & y)
        if a != b and shared and Fraction(shared, len(x | y)) >= tau:
            key = (min(a, b), max(a, b))
            best[key] = max(best.get(key, 0), round(shared / len(x | y), 6))
    return best


def near_copies(rng, count, families, words_=60):
    rows, i = [], 0
    base = [prose(rng, words_, 2000).split() for _ in range(families)]
    shared = prose(rng, 30, 2000)
    for f in base:
        for _ in range(count):
            w = list(f)
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = f"w{rng.randint(0, 2000)}"
            rows.append((i, " ".join(w) + (" " + shared if rng.random() < 0.3 else "")))
            i += 1
    return rows


def test_gram_scale_counts_every_document(spark):
    rng = random.Random(3)
    d = docs_of(spark, [(i, prose(rng, 40, 60)) for i in range(60)]).repartition(5).select("text").cache()
    for bits, hold in ((23, 4_000_000), (10, 50)):
        want = np.zeros(1 << bits)
        for r in d.collect():
            g, _ = jaccard_join.grams_of(*jaccard_join.word_hashes(pa.array([r.text])), 2)
            np.add.at(want, (g >> np.uint64(64 - bits)).astype(np.int64), 1)
        assert (jaccard_join.gram_scale(d, 2, bits, hold) == np.minimum(2 * np.log2(np.maximum(want, 1)), 63).astype(np.uint8)).all()
    assert jaccard_join.count_bits(d) == jaccard_join.COUNT_BITS


@pytest.mark.parametrize("tau, n, small, block", [(Fraction(3, 5), 3, 16, 2048), (Fraction(3, 5), 3, 2, 16), (Fraction(9, 10), 1, 3, 8), (Fraction(1, 2), 2, 2, 2048)])
def test_jaccard_join(spark, tau, n, small, block):
    rng = random.Random(5)
    rows = near_copies(rng, 25, 4) + near_copies(rng, 3, 10, 12)
    rows = [(k, t) for k, (_, t) in enumerate(rows)] + [(900, "solo"), (901, "Solo!"), (902, "two words"), (903, "two words"), (5, rows[5][1]), (7, rows[7][1] + " " + prose(rng, 200)), (904, None), (905, ""), (906, ""), (None, rows[0][1])]
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard_join.join(docs_of(spark, rows), tau, n, small=small, block=block).collect()}
    assert got == brute_pairs(rows, tau, n)


def brute_classes(rows, pairs):
    """class and links of each doc_id."""
    ids = {i for i, _ in rows if i is not None}
    near, of = defaultdict(set), {}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    for i in sorted(ids):
        todo = [i] if i not in of else []
        while todo:
            x = todo.pop()
            if x not in of:
                of[x] = i
                todo += near[x]
    return {i: (of[i], len(near[i])) for i in ids}


@pytest.mark.parametrize("tau, n, small, block", [(Fraction(1, 2), 3, 16, 2048), (Fraction(3, 5), 3, 2, 16), (Fraction(9, 10), 1, 3, 8), (Fraction(1, 2), 2, 2, 2048), (Fraction(1, 2), 2, 4, 5), (Fraction(4, 5), 3, 3, 300)])
def test_jaccard_classes(spark, tau, n, small, block):
    rng = random.Random(7)
    rows = near_copies(rng, 25, 4) + near_copies(rng, 3, 10, 12) + [(0, t) for _, t in near_copies(rng, 1, 5) for _ in range(12)]
    rows = [(k * 7 % 1000, t) for k, (_, t) in enumerate(rows)]
    rows += [(2000, "solo"), (2001, "Solo!"), (2002, "two words"), (2003, "two words"), (5, rows[5][1]), rows[7], rows[7], (rows[8][0], rows[8][1].upper()), (rows[9][0], rows[40][1]), (rows[9][0], rows[90][1] + " " + prose(rng, 20)), (2004, None), (2005, ""), (2006, ""), (None, rows[0][1])]
    got = {r.doc_id: (r.class_id, r.links) for r in jaccard_join.classes(docs_of(spark, rows), tau, n, small=small, block=block).collect()}
    assert got == brute_classes(rows, brute_pairs(rows, tau, n))


def test_jaccard_classes_of_a_large_group(spark):
    """What is written grows with the documents, not with the pairs of a group of copies."""
    rng = random.Random(8)
    base = prose(rng, 60, 2000).split()
    rows = [(i, " ".join([*base, f"x{i % 700}"])) for i in range(1500)]
    links = jaccard_join.linked(docs_of(spark, rows), block=500)
    assert links.count() <= 4 * len(rows)  # 1,124,250 pairs
    got = jaccard_join.classes(docs_of(spark, rows), block=500).collect()
    assert len(got) == len(rows) and {(r.class_id, r.links) for r in got} == {(0, len(rows) - 1)}
    assert jaccard_join.classes(docs_of(spark, [])).count() == 0


def test_jaccard_sql(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = {tuple(r) for r in con.execute(jaccard_join.ORACLE).fetchall()}
    got = [(r.doc_id, r.class_id, r.links) for r in jaccard_join.op5_jaccard_join(spark, "/root/testdata/sf0.001").collect()]
    assert len(got) == len(want) and set(got) == want and any(x[2] for x in got)


def test_metric_join_recursion():
    rng = np.random.default_rng(1)
    grams = []
    for _ in range(30):
        base = rng.integers(0, 1 << 60, 50).astype(np.uint64)
        for _ in range(25):
            x = base.copy()
            x[rng.integers(0, 50, rng.integers(0, 9))] = rng.integers(0, 1 << 60)
            grams.append(np.unique(x))
    tau = Fraction(4, 5)
    deep, flat = jaccard_join.metric_join(grams, tau, leaf=16), jaccard_join.metric_join(grams, tau, leaf=10_000)
    assert sorted(zip(*map(list, deep))) == sorted(zip(*map(list, flat)))


def test_groups(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (3, 9), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)], "doc_a long, doc_b long")
    got = {r.doc_id: r.group for r in groups.components(pairs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, **{k: 20 for k in range(20, 26)}}
    d = docs_of(spark, [(i, "t") for i in (1, 2, 3, 4, 5, 7)] + [(None, "u")])
    left = groups.one_of_each(d, pairs)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {1, 4, 7, None}
    assert groups.components(pairs.where("false")).count() == 0
    assert jaccard_join.join(docs_of(spark, [])).count() == 0


# 6 BPE
@pytest.fixture(scope="module")
def codec():
    return bpe_codec.Codec(open(bpe_codec.VOCABULARY, "rb").read())


def test_tree_concatenation(codec):
    rng = random.Random(0)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    mixed = "ab'cdls ré 12 \n\t .!?中文 th ing Ünd  's 'll"
    kinds = [lambda n: pick(mixed, n), lambda n: pick("abcdethingo", n), lambda n: "a" * n, lambda n: " " * n, lambda n: "don't'll " * (n // 8), lambda n: pick(mixed, n // 2) + pick("abcdethingo", n)]
    for _ in range(600):
        t, size = rng.choice(kinds)(rng.randint(0, 300)), rng.choice([1, 3, 7, 20, 50])
        assert codec.concatenate([codec.part(t[k : k + size]) for k in range(0, len(t), size)]) == codec.encode(t).tolist()
    unsplit = pick("abcdethingo", 30_000)
    assert codec.run_bytes(unsplit.encode()) == codec.encode(unsplit).tolist()


def test_bpe(spark, codec):
    rng = random.Random(2)
    rows = [*ODD, (7, "<|endoftext|> is text"), (8, prose(rng, 9000)), (8, prose(rng, 9000)), (9, "日本語" * 9000)]
    got = bpe_codec.encode(docs_of(spark, rows), part=4096).collect()
    want = Counter((i, tuple(codec.encode(t or "").tolist())) for i, t in rows)
    assert Counter((r.doc_id, tuple(r.tokens)) for r in got) == want
    assert all(r.round_trip and r.n_tokens == len(r.tokens) for r in got)
    assert bpe_codec.encode(docs_of(spark, [])).count() == 0


# 7 neighbours
def test_neighbours(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 32))
    x = np.vstack([centres[rng.integers(0, 20, 600)] + 0.5 * rng.normal(size=(600, 32)), rng.normal(size=(200, 32))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1, "x") for i, v in enumerate(x)], "vec_id long, embedding array<float>, code int, key string")
    got = defaultdict(list)
    for r in hash_neighbours.neighbours(df).orderBy("vec_id", "rank").collect():
        got[r.vec_id].append((r.neighbour, r.similarity))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    true = np.argsort(-s, axis=1)[:, :10]
    hit = sum(len({n for n, _ in got[i]} & set(true[i].tolist())) for i in range(len(x)))
    assert hit / true.size >= 0.9
    assert all(abs(v - s[i, n]) < 1e-4 for i in got for n, v in got[i])
    # with the whole radius every code is met: the result is exact
    small = hash_neighbours.neighbours(df.where("vec_id < 120"), radius=64).collect()
    t = np.argsort(-s[:120, :120], axis=1)[:, :10]
    assert all({r.neighbour for r in small if r.vec_id == i} == set(t[i].tolist()) for i in range(120))


def nearest(ids, x, k=10):
    """The k best ids of each id, by its best pair of vectors, ties by id."""
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    best = defaultdict(lambda: -2.0)
    s = np.round(u @ u.T, 6)
    for a, i in enumerate(ids):
        for b, j in enumerate(ids):
            if i != j:
                best[i, j] = max(best[i, j], s[a, b])
    return {i: [j for _, j in sorted((-best[i, j], j) for j in set(ids) if j != i)[:k]] for i in set(ids)}


def test_neighbours_repeated(spark):
    rng = np.random.default_rng(4)
    x, ids = rng.normal(size=(160, 32)).astype(np.float32), [*range(40)] * 4
    x[40:80] = x[:40] + 0.001 * x[40:80]  # several vectors of an id, close together
    x[80:] = np.tile(x[:40], (2, 1))  # repeated rows
    rows = [(i, v.tolist()) for i, v in zip(ids, x)]
    got = defaultdict(list)
    for r in hash_neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), radius=32).orderBy("vec_id", "rank").collect():
        got[r.vec_id].append(r.neighbour)
    assert got == nearest(ids, x)


def test_neighbours_isolated(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(20, 32)).repeat(30, axis=0) + 0.01 * rng.normal(size=(600, 32)), rng.normal(size=(15, 32))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = hash_neighbours.neighbours(df, radius=2).groupBy("vec_id").count().collect()
    assert {r.vec_id: r["count"] for r in got} == {i: 10 for i in range(len(x))}


def test_neighbours_of_queries(spark):
    """The registered query asks for one vec_id of EVERY against all vectors; recall against brute force."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id")
    ids, x = np.array([r.vec_id for r in df.collect()]), np.array([r.embedding for r in df.collect()], np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in hash_neighbours.op7_hash_neighbours(spark, "/root/testdata/sf0.1").collect():
        got[r.vec_id].append((r.neighbour, r.similarity))
    asked = np.flatnonzero(ids % hash_neighbours.EVERY == 0)
    assert set(got) == set(ids[asked].tolist()) and all(len(g) == 10 for g in got.values())
    hit = 0
    for i in asked:
        s = u @ u[i]
        s[i] = -9
        hit += len(set(ids[np.argsort(-s)[:10]].tolist()) & {o for o, _ in got[int(ids[i])]})
        assert all(abs(v - s[np.searchsorted(ids, o)]) < 1e-4 for o, v in got[int(ids[i])])
    assert hit / (10 * len(asked)) >= 0.9


def test_queries_exact_at_every_number_of_leading_bits(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x, ids = rng.normal(size=(300, 32)).astype(np.float32), [*range(-100, 150), *range(50)]
    monkeypatch.setattr(hash_neighbours, "CELL", 8)  # several blocks and cells
    want = nearest(ids, x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    for lead in (0, 3):
        monkeypatch.setattr(hash_neighbours, "leading", lambda *_, lead=lead: lead)
        got = defaultdict(list)
        for r in hash_neighbours.neighbours(df, radius=32, every=7).orderBy("vec_id", "rank").collect():
            got[r.vec_id].append(r.neighbour)
        assert got == {i: o for i, o in want.items() if i % 7 == 0}
    near = spark.createDataFrame([(20 * i + c, (x[i] + 0.001 * c).tolist()) for i in range(60) for c in range(20)], "vec_id long, embedding array<float>")
    found = hash_neighbours.neighbours(near, radius=2, every=7).collect()  # all parts are probed
    assert len(found) == 10 * len(range(0, 1200, 7)) and all(r.vec_id // 20 == r.neighbour // 20 for r in found)
    assert hash_neighbours.neighbours(df, every=1000).where("vec_id != 0").count() == 0
    assert hash_neighbours.neighbours(df.where("vec_id % 7 != 0"), every=7).count() == 0


def test_leading_bits_cost_least():
    lead = hash_neighbours.leading
    assert lead(28, 4, 6, 12_000, 600_000) == 0  # nothing is pruned: few copies
    assert lead(4, 4, 12, 1_000_000, 50_000_000) > 6  # cells are pruned


def test_neighbours_tied(spark):
    v = [float(j % 7 - 3) for j in range(32)]
    df = spark.createDataFrame([(i, v) for i in range(40)] + [(100 + i, [float((i * j) % 5 + 1) for j in range(1, 9)]) for i in range(4)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in hash_neighbours.neighbours(df).orderBy("vec_id", "rank").collect():
        got[r.vec_id].append(r.neighbour)
    assert all(got[i] == [j for j in range(11) if j != i][:10] for i in range(40))
    assert all(sorted(got[100 + i]) == [100 + j for j in range(4) if j != i] for i in range(4))  # another length, by themselves


@pytest.mark.parametrize("seed", range(4))
def test_probes_meet_all_within_the_radius(seed):
    rng = np.random.default_rng(seed)
    parts, lead, width = 4, 6, 8
    code = rng.integers(0, 1 << 32, 300).astype(np.uint64)
    code[150:] = code[:150] ^ (np.uint64(1) << rng.integers(0, 32, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 32, 150).astype(np.uint64))
    for radius in (0, 1, 2, 3, 5, 9, 32):
        masks = hash_neighbours.probes(radius, parts, lead)
        met = np.zeros((300, 300), bool)
        for p, m in enumerate(masks):
            c = hash_neighbours._cells(code, p, width, lead)
            met |= np.isin(c[:, None] ^ c[None, :], m)
        assert met[np.bitwise_count(code[:, None] ^ code[None, :]) <= radius].all()
        assert radius > 5 or not met.all()  # and it prunes


@pytest.mark.parametrize("seed", range(6))
def test_meet_equals_brute_force(monkeypatch, seed):
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(hash_neighbours, "TILE", 16)
    side = lambda n, top: (rng.integers(0, top, n), rng.integers(0, 1 << 16, n).astype(np.uint64), rng.integers(-2, 3, (n, 6)).astype(np.float32) / np.float32(5))
    a, b, k, radius = side(50, 40), side(70, 1000 if seed % 2 else 30), 4, 8
    got = list(zip(*(x.tolist() for x in hash_neighbours.meet(a, b, radius, k, True))))
    best = defaultdict(dict)
    for x, y in ((a, b), (b, a)):
        for i in range(len(x[0])):
            for j in range(len(y[0])):
                if x[0][i] != y[0][j] and int(x[1][i] ^ y[1][j]).bit_count() <= radius:
                    q, o, v = int(x[0][i]), int(y[0][j]), round(float(x[2][i] @ y[2][j]), 6)
                    best[q][o] = max(best[q].get(o, -99), v)
    want = [(q, o, v) for q in sorted(best) for v, o in sorted(((v, o) for o, v in best[q].items()), key=lambda t: (-t[0], t[1]))[:k] if v > -2]
    kept = defaultdict(list)
    for q, o, v in got:
        kept[q].append((q, o, v))
    assert [t for q in sorted(kept) for t in kept[q]] == want


def test_neighbours_edges(spark):
    v = [1.0, 2.0, 3.0, 4.0, 5.0]
    rows = [(1, v), (2, v), (2, v), (3, [5.0, 4.0, 3.0, 2.0, 1.0]), (4, None), (5, []), (6, [0.0] * 5), (7, [1.0, float("nan"), 0.0, 0.0, 0.0]), (8, [1.0, 2.0]), (None, v), (9, [1.0, None, 1.0, 1.0, 1.0])]
    got = hash_neighbours.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), radius=5).collect()
    assert {(r.vec_id, r.neighbour) for r in got} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}
    assert hash_neighbours.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# 8 classifier
def test_classifier(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = labels.where("doc_id % 3 = 0")
    model = quality_classifier.fit(spark, d, labels.where("doc_id % 3 != 0"))
    rows = quality_classifier.score(spark, d, model).join(held, "doc_id").collect()
    assert sum(r.keep == bool(r.quality) for r in rows) / len(rows) > 0.97
    good = [r for r in rows if r.quality]
    assert sum(r.keep for r in good) / len(good) > 0.98
    odd = docs_of(spark, ODD)
    out = quality_classifier.keep(spark, odd, model)
    assert out.columns == odd.columns
    scored = quality_classifier.score(spark, odd, model).collect()
    assert len(scored) == len(ODD) and len({r.quality_score for r in scored if r.doc_id in (1, 2, 3)}) == 1
    assert quality_classifier.score(spark, docs_of(spark, []), model).count() == 0


def scalar_ftrl(rows, epochs, alpha, beta, l1, l2):
    """One coordinate at a time. rows: ({coordinate: value}, label)."""
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(epochs):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return weight


def test_training_equals_scalar_ftrl():
    rng = random.Random(4)
    q, dim = quality_classifier, 1 << quality_classifier.BITS
    rows = [(np.array([rng.randrange(40) for _ in range(rng.randint(0, 30))], np.int32), rng.randint(0, 1)) for _ in range(50)]
    weights, bias = q.train(rows)
    sparse = [({**{i: c * q.SCALE / len(x) for i, c in Counter(x.tolist()).items()}, dim: 1.0}, y) for x, y in rows]
    want = scalar_ftrl(sparse, q.EPOCHS, q.ALPHA, q.BETA, q.L1, q.L2)
    assert bias == pytest.approx(want(dim), abs=1e-9)
    assert all(weights[i] == pytest.approx(want(i), rel=1e-5, abs=1e-7) for i in range(40)) and not weights[40:].any()


def test_classifier_without_labels(spark):
    d = docs_of(spark, [(i, "fine words here") for i in range(5)])
    for labels in ([], [(99, 0), (98, 1)], [(None, 1)]):
        with pytest.raises(ValueError, match="no document has a label"):
            quality_classifier.fit(spark, d, spark.createDataFrame(labels, "doc_id long, quality int"))
    # rows of one doc_id in any order give one model; doc_ids of another type match
    rows = [(1, "good words"), (1, "other words"), (2, "BAD!!! ***"), (3, "more good words")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id int, quality int")
    a, b = (quality_classifier.fit(spark, docs_of(spark, x).repartition(3), labels) for x in (rows, rows[::-1]))
    assert (a[0] == b[0]).all() and a[1] == b[1] and a[0].any()


def test_classifier_needs_both_classes(spark):
    d = docs_of(spark, [(i, "fine words here") for i in range(5)])
    one = spark.createDataFrame([(i, 1) for i in range(5)] + [(None, 0), (99, 0), (3, None)], "doc_id long, quality int")
    with pytest.raises(Exception, match="one class"):
        quality_classifier.fit(spark, d, one)
    weights, bias = quality_classifier.fit(spark, docs_of(spark, []), one)
    assert not weights.any() and bias == 0


# 9 substring dedup
def brute_intervals(rows, window):
    at = defaultdict(set)
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - window + 1):
            if i is not None:
                at[tuple(w[k : k + window])].add((i, k))
    out = defaultdict(set)
    for places in at.values():
        if len(places) > 1:
            for p in places:
                out[p[0], p != min(places)].add(p[1])
    spans = []
    for (i, removed), starts in out.items():
        run = None
        for k in sorted(starts):
            if run and k <= run[1]:
                run[1] = k + window
            else:
                run = [k, k + window]
                spans.append((i, run, removed))
    return sorted((i, a, b, removed) for i, (a, b), removed in spans)


@pytest.mark.parametrize("window, gram", [(12, 4), (5, 2), (9, 9)])
def test_intervals(spark, window, gram):
    rng = random.Random(window)
    passage = [prose(rng, 30) for _ in range(4)]
    rows = [(i, " ".join([prose(rng, rng.randint(0, 40)), passage[i % 4] if i % 3 else "", prose(rng, 20), passage[0] if i % 5 == 0 else ""])) for i in range(40)]
    rows += [(50, "same " * 40), (51, rows[3][1]), (52, None), (53, ""), (54, "short one"), (3, rows[3][1]), (None, passage[0])]
    for heavy in (substring_dedup.HEAVY, 5, 0):
        got = sorted(tuple(r) for r in substring_dedup.repeated_intervals(docs_of(spark, rows), window, gram, heavy).collect())
        assert got == brute_intervals(rows, window), heavy


def test_remove(spark):
    rng = random.Random(9)
    p = prose(rng, 60)
    rows = [(1, "start here\n" + p + " end"), (2, "other  start " + p), (3, p), (4, "clean text stays   as it is"), (5, None), (None, p)]
    d = docs_of(spark, rows)
    got = {r.doc_id: r for r in substring_dedup.remove(d).collect()}
    assert substring_dedup.remove(d).columns == d.columns
    assert got[1].text == rows[0][1] and got[4].text == rows[3][1] and got[5].text is None and got[None].text == p
    assert got[2].text == "other  start " and got[2].n_chars == 13 and 3 not in got
    assert substring_dedup.remove(docs_of(spark, [])).count() == 0
    odd = substring_dedup.repeated_intervals(docs_of(spark, ODD)).collect()
    assert {r.doc_id for r in odd} == {5}


# 10 URLs
def witten_bell(urls, alphabet, order):
    """ln P of each URL's characters under a model of the URLs, by counting contexts in dictionaries and recursion."""
    follow = defaultdict(Counter)
    for u in urls:
        s = "\2" * order + u + "\3"
        for i in range(order, len(s)):
            for k in range(order + 1):
                follow[s[i - k : i]][s[i]] += 1

    def p(context, c):
        below = 1 / alphabet if context == "" else p(context[1:], c)
        seen = follow.get(context)
        return (seen[c] + len(seen) * below) / (sum(seen.values()) + len(seen)) if seen else below

    return lambda u: [math.log(p(s[i - order : i], s[i])) for s in ["\2" * order + u + "\3"] for i in range(order, len(s))]


def test_url_model_equals_recursion(spark):
    m, rng = url_language_model, random.Random(12)
    rows = [(i, f"HTTPS://{rng.choice(['ads-x', 'casino', 'news', 'blog', 'shop', 'lib'])}{rng.randint(0, 9)}.example.org/{rng.choice(['a/b', 'c', 'casino'])}?{rng.randint(0, 99)}") for i in range(150)]
    urls = [u.lower().split("://", 1)[1] for _, u in rows]
    bad = [any(t in u.split("/")[0] for t in m.TERMS) for u in urls]
    accepted, rejected = (witten_bell([u for u, b in zip(urls, bad) if b == is_bad], m.ALPHABET, m.ORDER) for is_bad in (False, True))
    score = [sum(a - r for a, r in zip(accepted(u), rejected(u))) / (len(u) + 1) for u in urls]
    spread = lambda v: (np.mean(v), np.std(v))
    (ma, sa), (mr, sr) = spread([s for s, b in zip(score, bad) if not b]), spread([s for s, b in zip(score, bad) if b])
    threshold = (ma * sr + mr * sa) / (sa + sr)
    got = {r.page_id: r for r in m.score(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(abs(got[i].url_score - s) <= 6e-7 and (got[i].keep == (s >= threshold) or abs(s - threshold) < 1e-6) for i, s in enumerate(score))


def test_url_model(spark):
    import duckdb

    rng = random.Random(6)
    good, bad = ["tion", "ther", "blog", "news"], ["spam-farm", "casino-win", "free-bets"]
    rows = [(i, f"https://{rng.choice(bad if i % 4 == 0 else good)}.example.com/{rng.choice('abc')}/{rng.randint(0, 99)}", 1) for i in range(400)]
    rows += [(900, None, 1), (901, "", 1), (902, "https://", 1), (None, rows[1][1], 1), (1, rows[1][1], 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, n int")
    got = url_language_model.score(df).collect()
    assert len(got) == len(rows)
    known = {r[0]: r[1] for r in rows if r[0] is not None}
    assert all(r.keep == (not any(b in known[r.page_id] for b in bad)) for r in got if r.page_id is not None and r.page_id < 900)
    assert all(r.url_score is None and not r.keep for r in got if r.page_id in (900, 901, 902))
    pages = pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": [r[1] for r in rows]})  # noqa: F841
    assert sorted(map(repr, duckdb.sql(url_language_model.ORACLE).fetchall())) == sorted(repr(tuple(r)) for r in got)
    # one group alone
    one_kind = url_language_model.score(df.where("url like '%tion%'")).collect()
    assert all(r.keep and r.url_score == 0 for r in one_kind)
    assert url_language_model.score(df.where("false")).count() == 0


def test_meetings_beyond_the_overlaps_place_do_not_count():
    """Two sets of 300 grams need 200 in common, so one of the first 108 of both is among these: a meeting at place 140 isn't."""
    import pyarrow as pa

    from tidemark.llm import jaccard_join as J

    def met(place):
        size = 300 | (place * 128 // 300 << J.PLACE)
        b = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([size, size]), pa.array([7, 7])], ["doc_id", "size", "gram"])
        return sum(x.num_rows for x in J._meetings(J.TAU, J.SHARED, J.SMALL)([b]))

    assert met(100) == 1
    assert met(140) == 0


def test_visitors_of_a_region_are_not_compared():
    import numpy as np

    from tidemark.llm import jaccard_join as J

    sets = [np.arange(0, 100, dtype=np.uint64), np.arange(200, 300, dtype=np.uint64), np.arange(205, 305, dtype=np.uint64), np.arange(10, 110, dtype=np.uint64)]
    of = lambda member: [r for b in J._linked(np.arange(4), np.array(member), np.zeros(4, np.int64), np.zeros(4, bool), [x.tobytes() for x in sets], J.TAU) for r in zip(*(b.column(k).to_pylist() for k in range(3)))]
    assert of([True, False, False, False]) == [(0, 0, 1), (3, 0, 1)]  # doc_id, smallest connected, links
    assert sorted(of([True, True, False, False])) == [(0, 0, 1), (1, 1, 1), (2, 1, 1), (3, 0, 1)]
