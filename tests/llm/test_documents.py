"""Operators on documents against brute force, and on odd tables."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lexweave.llm import ann, common, fingerprints as fp, minhash, mixing, quality, sharding, suffix, toxicity
from lexweave.llm.common import Scratch, arrow_bytes, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def test_words_are_runs_without_space():
    texts = ["", " ", "a", " Ab\x0bc  d\n", "é 漢", None, "x"]
    data, at = arrow_bytes(pa.array(texts))
    hashed, begin, end, own = words(data, at)
    for i, t in enumerate(texts):
        assert [bytes(data[a:b]).decode() for a, b in zip(begin[own[i] : own[i + 1]], end[own[i] : own[i + 1]])] == WORD.findall(t or "")
    low, *_ = words(*arrow_bytes(pa.array(["AB ab"])), lower=True)
    assert low[0] == low[1] and hashed[0] != hashed[-1]


def test_words_by_blocks(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab  \n\u00e9") for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(300)] + ["x" * 500, "y" * 90 + " " + "z" * 90]
    data, at = arrow_bytes(pa.array(texts))
    whole = words(data, at)
    monkeypatch.setattr(common, "BLOCK", 16)
    for one, two in zip(whole, words(data, at), strict=True):
        assert (one == two).all()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    parts = list(common.text_slices(batch, 1))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch])) and len(parts) > 50


# Mixing


def brute_targets(sizes, weights, share=1.5, cap=2.0):
    left, out, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
            open_.remove(i)
    return out


def test_mix(spark):
    rng = random.Random(2)
    for _ in range(3):
        sizes = [rng.randint(1, 400) for _ in range(7)]
        rows = [(i * 100 + j, "w " * n, f"s{i}" if i else None) for i, total in enumerate(sizes) for j, n in enumerate([total // 3, total - total // 3])]
        got = mixing.mix_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        want = brute_targets([*sizes[1:], sizes[0]], [(3, 1, 2)[i % 3] for i in range(7)])
        for i, s in enumerate([f"s{i}" for i in range(1, 7)] + [None]):
            own = [r for r in got if r.source == s]
            assert own[0].target == pytest.approx(want[i]) and abs(sum(r.taken for r in own) - own[0].target) <= 0.5
            assert all(0 <= r.taken <= 2 * r.size for r in own)


def test_mixed_corpus(docs):
    plan = {r.doc_id: r for r in mixing.mix_plan(docs).collect()}
    mixed = mixing.mix_sources(docs).collect()
    got = {}
    for r in mixed:
        got[r.doc_id] = got.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert got == {i: r.taken for i, r in plan.items() if r.taken}
    assert mixed[0].__fields__ == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in mixed)


def test_mix_within_equal_rows(spark):
    """A budget that ends among equal rows without doc_id is used up to the word; sources don't mix."""
    rows = [(None, "a b c d e", "x")] * 101 + [(None, "a b c d e", "y")] * 40 + [(None, "a b c d e", None)] * 7
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan = mixing.mix_plan(docs).collect()
    want, got = {}, {}
    for r in plan:
        want[r.source] = want.get(r.source, 0) + r.taken
    for r in mixing.mix_sources(docs).collect():
        got[r.source] = got.get(r.source, 0) + len(WORD.findall(r.text))
    assert got == want and len({r.taken for r in plan if r.source == "x"}) > 1


def test_mix_odd_tables(odd, none):
    rows = mixing.mix_plan(odd).collect()
    assert len(rows) == odd.count() and all(r.taken == 0 for r in rows if r.doc_id in (1000, 1001, 1002))
    assert mixing.mix_plan(none).collect() == [] and mixing.mix_sources(none).collect() == []
    assert mixing.mix_sources(odd).columns == odd.columns and mixing.mix_sources(odd).count() > 0


# Quality


def test_dual_coordinate_descent_solves_the_dual():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(12) < 0.5) for _ in range(40)]
    y = np.where(rng.random(40) < 0.5, 1.0, -1.0)
    w, bias = quality.dual_coordinate_descent(rows, np.ones(12), y, np.full(40, 0.5), epochs=400)
    x = np.array([np.append(quality.unit(np.isin(np.arange(12), r).astype(float)), 1.0) for r in rows])
    value = lambda v: 0.5 * v @ v + 0.5 * np.maximum(0, 1 - y * (x @ v)).sum()
    best = value(np.append(w, bias))
    assert all(value(np.append(w, bias) + rng.normal(0, 0.05, 13)) >= best - 1e-3 for _ in range(200))


def labelled_docs(spark, bad, good, n=240):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        t = " ".join(rng.choice(["and", "then", "rain", "over", "hill", "stone"]) for _ in range(rng.randint(5, 60)))
        y = int(rng.random() < 0.5)
        rows.append((i, (good if y else bad)(t, rng)))
        labels.append((i, y, y))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_learns(spark):
    docs, labels = labelled_docs(spark, lambda t, r: t.upper() + "!!", lambda t, r: t)
    rows = quality.score_quality(docs, labels).collect()
    want = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and all(r.predicted == want[r.doc_id] for r in held)
    assert {r.doc_id for r in quality.keep_quality(docs, labels).collect()} == {r.doc_id for r in rows if r.predicted}


def test_held_out_rows_teach_nothing(spark):
    docs, labels = labelled_docs(spark, lambda t, r: t.upper(), lambda t, r: t)
    held = {r.doc_id for r in docs.select("doc_id", quality.held_out(docs["doc_id"]).alias("h")).where("h").collect()}
    flipped = spark.createDataFrame([(r.doc_id, 1 - r.quality if r.doc_id in held else r.quality, 0) for r in labels.collect()], labels.schema)
    a, b = (sorted(map(tuple, quality.score_quality(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_classifiers_on_odd_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 1), (None, 0, 0), (3, None, None), (4, 1, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    for score in (quality.score_quality, toxicity.score_toxicity):
        rows = score(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
        assert score(none, labels).collect() == []
        assert len(score(odd, labels.limit(0)).collect()) == odd.count()
    assert quality.keep_quality(odd, labels).columns == odd.columns


# Toxicity


def test_decoder_restores():
    import gzip  # noqa: F401

    text = ("you are an idiot and a moron , what a stupid loser in the trash . the scum is pathetic and worthless " * 30).encode()
    s, doc = toxicity.text_symbols(*toxicity.as_bytes([text]))
    code = (s[:-2].astype(int) * 64 + s[1:-1]) * 64 + s[2:]
    d = toxicity.Decoder(toxicity.log_model(np.bincount(code, minlength=64**3).reshape(64, 64, 64).astype(float)))
    for odd_, plain in (("1d10t", "idiot"), ("m0r0n!", "moron"), ("$tup1d", "stupid"), ("l0$er", "loser"), ("idiooooot", "idiot"), ("tr4sh", "trash"), ("р@thet1c", "pathetic"), ("clear", "clear"), ("4711", "4711")):
        assert d.token(odd_) == plain
    assert "idiot" in d.text("an i d i o t here").split() and "scum" in d.text("s-c-u-m").split()
    assert d.text("plain words, left alone.") == "plain words, left alone."


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    d = toxicity.Decoder(np.log(rng.dirichlet(np.ones(64), (64, 64))).astype(np.float32))
    lattice = [[("a", 0.0), ("b", -0.5)], [("", -0.2), ("c", 0.0)], [("dd", -0.1), ("d", 0.0)], [("e", 0.0), ("f", 0.0)]]

    def total(parts):
        x = y = 0
        cost = 0.0
        for string, c in parts:
            cost += c
            for ch in string:
                z = toxicity.symbol(ch)
                cost += float(d.model[x, y, z])
                x, y = y, z
        return cost + float(d.model[x, y, 0])

    best = max(itertools.product(*lattice), key=total)
    assert d.viterbi(lattice) == "".join(s for s, _ in best)


def test_toxicity_learns_disguises(spark):
    bad = ["moron", "idiot", "scum"]
    spoil = lambda t, r: t if r.random() < 0 else " ".join([*t.split(), r.choice(bad), *t.split()[:3], r.choice(bad)])
    docs, labels = labelled_docs(spark, lambda t, r: t, spoil)
    hidden = spark.createDataFrame([(9000, "and then rain over the m0r0n hill"), (9001, "stone s c u m rain"), (9002, "idiooooot and then"), (9003, "and then rain over hill")], docs.schema)
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs.union(hidden), labels).collect()}
    want = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(rows[i].predicted == y for i, y in want.items() if rows[i].held_out)
    assert [rows[i].predicted for i in (9000, 9001, 9002, 9003)] == [1, 1, 1, 0]


def test_disguises_are_suspect():
    """What the patterns match is decoded; plain texts around don't make a text suspect."""
    shown = ["m  o  r  o  n", "m - o - r - o - n", "m..o..r..o..n", "m 0 r 0 n", "s c 4 m", "1 d 1 o t", "m o r o n", "mor€n", "id¡ot", "s£ug", "¥ou", "Ùùù", "m._-oron", "$ c u m"]
    assert toxicity.suspects(*toxicity.as_bytes([t.encode() for t in shown[:-1]])).all()
    assert not toxicity.suspects(*toxicity.as_bytes([b"", b"m", b" o", b" r o", b"plain words", b"ab", b"b ", b"bb", b"4", b"x"])).any()
    decoder = toxicity.Decoder(np.zeros((64, 64, 64), dtype=np.float32))
    rng = random.Random(3)
    texts = ["".join(rng.choice("abA14@$!|+(*?._-~'^/\\ \n#,é€а") for _ in range(rng.randint(0, 9))) for _ in range(30_000)]
    odd_ = toxicity.suspects(*toxicity.as_bytes([t.encode() for t in texts]))
    for t, o in zip(texts, odd_, strict=True):
        assert o or decoder.text(t) == t
        found = toxicity._SPACED.search(t) or any(toxicity.disguised(w) for w in re.findall(r"\S+", t.lower()))
        assert o or not found
        assert not o or found or not t.isascii()


# Near duplicates


def shingle_set(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n, percent):
    sets = {i: shingle_set(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, corpus, n, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, n, percent).collect()}
    assert got == brute_components(corpus, n, percent)


def test_near_copies_without_an_original(spark):
    """Copies that differ each in its own way, some below the threshold: what the stars leave is compared in full."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for k in rng.sample(range(120), rng.randint(1, 4)):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_rare_shingles_find_what_all_pairs_find(spark, docs, corpus):
    """Each text a component of its own: every link is among the pairs that meet."""
    left = spark.createDataFrame([(i, i) for i, _ in corpus], "class long, component long")
    with Scratch(spark) as scratch:
        entries = minhash.rare_entries(left, docs.select("doc_id", "text"), 3, 85, scratch)
        got = {(r.a, r.b) for r in minhash.apart(entries).collect()}
    sets = {i: shingle_set(t, 3) for i, t in corpus}
    assert got >= {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}


def test_many_near_copies_of_a_long_text(spark):
    """100 copies of 1500 words, each with up to 70 words of its own from a small vocabulary, as all pairs give."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(1500)]
    rows = []
    for i in range(100):
        w = list(base)
        for k in rng.sample(range(1500), rng.choice([5, 20, 45, 70])):
            w[k] = f"x{rng.randint(0, 40)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_texts_of_one_id_are_one_node(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(7, one), (7, two), (8, one + " more"), (9, two + " more"), (10, "alone")]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {(7, 7), (8, 7), (9, 7), (10, 10)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 105), (50, 40)]
    got = {r.node: r.component for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 105: 100, 50: 40, 40: 40}


def test_near_duplicates_on_odd_tables(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.kept and r.n_shingles == 0 for r in rows if r.doc_id in (1000, 1001, 1002)) and all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert minhash.near_duplicates(none).collect() == []
    assert minhash.drop_near_duplicates(odd).columns == odd.columns
    assert minhash.drop_near_duplicates(none).collect() == []


# Repeated passages


def brute_passages(rows, n=50):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        hit, own = np.zeros(len(w), dtype=bool), set()
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            if g in first:
                hit[k : k + n] = True
            else:
                own.add(g)
        for g in own:
            first[g] = i
        if hit.any():
            out[i] = hit
    return out


@pytest.mark.parametrize("entries", [60_000, 7])
def test_passages(docs, corpus, entries, monkeypatch):
    monkeypatch.setattr(suffix, "ENTRIES", entries)
    got = {}
    for r in suffix.repeated_passages(docs).collect():
        hit = got.setdefault(r.doc_id, np.zeros(len(WORD.findall(dict(corpus)[r.doc_id])), dtype=bool))
        hit[r.start_word : r.start_word + r.n_words] = True
        assert r.first_doc_id < r.doc_id
    want = brute_passages(corpus)
    assert got.keys() == want.keys() and all((got[i] == want[i]).all() for i in want) and {17, 40} <= want.keys()


def test_anchors_cover_every_window():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    at = np.array([0, 200, 203, 240, 500])
    where = suffix.anchors(h, at)
    for a, b in zip(at[:-1], at[1:]):
        for i in range(a, b - suffix.GRAM + 1 - suffix.WINDOW + 1):
            assert ((where >= i) & (where < i + suffix.WINDOW)).any()
    assert len(where) < 500 * 2.6 / suffix.WINDOW + 8


def test_every_passage_stands_in_its_first_document(docs, corpus):
    at = {i: WORD.findall(t or "") for i, t in corpus}
    rows = suffix.repeated_passages(docs).collect()
    assert rows
    for r in rows:
        assert r.first_doc_id < r.doc_id and r.n_words >= suffix.MIN_WORDS
        assert at[r.doc_id][r.start_word : r.start_word + r.n_words] == at[r.first_doc_id][r.first_start_word : r.first_start_word + r.n_words]


def test_touching_passages_of_two_documents(spark):
    """60 words of one document, then 60 of another: two passages, each where it is; and texts that share an id."""
    one, two = [f"p{i}" for i in range(60)], [f"q{i}" for i in range(60)]
    rows = [(2, " ".join([f"a{i}" for i in range(400)] + two)), (5, " ".join(one)), (9, " ".join(one + two)), (11, " ".join(["x"] * 3 + one)), (11, " ".join(["y", "z"] + two))]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix.repeated_passages(t)
    got = sorted((r.doc_id, r.start_word, r.n_words, r.first_doc_id, r.first_start_word) for r in found.collect())
    assert got == [(9, 0, 60, 5, 0), (9, 60, 60, 2, 400), (11, 2, 60, 2, 400), (11, 3, 60, 5, 0)]
    left = sorted((r.doc_id, r.text.strip()) for r in suffix.drop_passages(t, found).collect() if r.doc_id > 5)
    assert left == [(11, "x x x"), (11, "y z")]


def test_many_left_contexts_of_one_core(spark):
    """50 pairs of documents share a core with all others, and what stands before it with one."""
    core = [f"c{i}" for i in range(40)]
    rows = []
    for i in range(50):
        own = [f"own{i}_{k}" for k in range(15)]
        for j in (0, 1):
            rows.append((100 * j + i, " ".join([f"h{i}_{j}_{k}" for k in range(7)] + own + core + [f"t{i}_{j}_{k}" for k in range(30)])))
    found = suffix.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start_word, r.n_words, r.first_doc_id, r.first_start_word) for r in found) == [(100 + i, 7, 55, i, 7) for i in range(50)]


def test_passages_on_odd_tables(odd, none):
    found = suffix.repeated_passages(odd)
    assert {(r.doc_id, r.first_doc_id) for r in found.collect()} == {(17, 3)}
    assert suffix.repeated_passages(none).collect() == []
    assert suffix.drop_passages(odd, found).columns == odd.columns and suffix.drop_passages(odd, found).count() == odd.count()


def test_passages_beside_a_hot_core(spark):
    """Words before boilerplate that two documents alone share, among many that hold the boilerplate."""
    rng = random.Random(11)
    fresh = lambda n: " ".join(f"w{rng.randrange(1 << 40)}" for _ in range(n))
    boiler = fresh(45)
    rows = [(1000 + i, f"{fresh(12)} {boiler} {fresh(12)}") for i in range(300)]
    for i in range(40):
        own = fresh(11)
        rows += [(2 * i, f"{fresh(12)} {own} {boiler} {fresh(12)}"), (2 * i + 1, f"{fresh(12)} {own} {boiler} {fresh(12)}")]
    found = suffix.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.start_word, r.n_words, r.first_doc_id, r.first_start_word) for r in found} == {(2 * i + 1, 12, 56, 2 * i, 12) for i in range(40)}


@pytest.mark.parametrize("entries", [60_000, 300])
def test_runs_of_repeated_words_are_one_passage(spark, entries, monkeypatch):
    """A run of the same two words in many documents is one passage of each, not one for every place it could lie."""
    monkeypatch.setattr(suffix, "ENTRIES", entries)
    own = lambda i, k: " ".join(f"o{i}_{j}" for j in range(k))
    rows = [(i, f"{own(i, 20 + i % 3)} {'is that ' * 130}{own(-i - 1, 9)}") for i in range(40)]
    found = suffix.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    if entries > 300:
        assert sorted((r.doc_id, r.start_word, r.n_words, r.first_start_word - 20 - r.first_doc_id % 3) for r in found) == [(i, 20 + i % 3, 260, 0) for i in range(1, 40)]
    else:  # the last words of a run may be in another task than the others
        assert len(found) <= 3 * 39 and all(any(r.doc_id == i and r.n_words >= 230 for r in found) for i in range(1, 40))
    # Runs of different lengths: all words of each, in few rows.
    rows = [(i, f"{own(i, 20 + i % 3)} {'is that ' * (60 + 7 * i % 150)}{own(-i - 1, 9)}") for i in range(40)]
    found = suffix.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    got, want = {}, brute_passages(rows)
    for r in found:
        got.setdefault(r.doc_id, np.zeros(len(want[r.doc_id]), dtype=bool))[r.start_word : r.start_word + r.n_words] = True
        text, first = dict(rows)[r.doc_id].split(), dict(rows)[r.first_doc_id].split()
        assert r.first_doc_id < r.doc_id and text[r.start_word : r.start_word + r.n_words] == first[r.first_start_word : r.first_start_word + r.n_words]
    assert got.keys() == want.keys() and all((got[i] == want[i]).all() for i in want) and len(found) < 40 * 12


def test_drop_passages(docs, corpus):
    left = {r.doc_id: r for r in suffix.drop_passages(docs, suffix.repeated_passages(docs)).collect()}
    want = brute_passages(corpus)
    for i, t in corpus:
        w = WORD.findall(t)
        keep = [x for x, h in zip(w, want.get(i, np.zeros(len(w), dtype=bool)), strict=True) if not h]
        assert (WORD.findall(left[i].text) if i in left else []) == keep
        assert i not in left or left[i].n_chars == len(left[i].text)


# Sharding


def test_difference_balances():
    rng = random.Random(1)
    for k in (2, 3, 16):
        sizes = [rng.randint(1, 1000) for _ in range(300)]
        total, places = sharding.difference([[s] + [0] * (k - 1) for s in sizes])
        sums = [0] * k
        for s, p in zip(sizes, places, strict=True):
            assert sorted(p) == list(range(k))
            sums[p[0]] += s
        assert sums == total and max(sums) - min(sums) <= 30


@pytest.mark.parametrize("fan_in", [4096, 7])
def test_shard(docs, corpus, fan_in):
    rows = sharding.shard(docs, 4, fan_in).collect()
    assert len(rows) == len(corpus)
    by_text, texts = {}, dict(corpus)
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.law == "bytes" and r.grown_shard is None
        by_text.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    sums = [sum(r.size for r in rows if r.shard == s) for s in range(4)]
    assert max(sums) - min(sums) < 0.05 * sum(sums)
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_shard_odd_tables(odd, none):
    rows = sharding.shard(odd).collect()
    assert len(rows) == odd.count() and all(r.size == 1 and r.text_crc32 is None for r in rows if r.doc_id == 1000)
    assert sharding.shard(none).collect() == []


# Nearest neighbours


def brute_nearest(rows, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        keep = ids != ids[i]
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[int(ids[i])] = [(int(a), float(b)) for a, b in zip(ids[keep][order], s[keep][order])]
    return out


def test_nearest_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 24))
    rows = [(i, (centres[i % 12] + 0.6 * rng.standard_normal(24)).tolist()) for i in range(1500)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(t, t.where("vec_id % 20 = 0"), 20, block=500, query_block=30).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want, hits = brute_nearest(rows, 20), 0
    for q, best in want.items():
        own = sorted(got[q])
        assert [r for r, *_ in own] == list(range(1, 21)) and [s for *_, s in own] == sorted((s for *_, s in own), reverse=True)
        exact = dict(best)
        hits += len(exact.keys() & {v for _, v, _ in own})
        assert all(s == pytest.approx(exact[v], abs=1e-12) for _, v, s in own if v in exact)
    assert hits / (20 * len(want)) >= 0.95


def test_nearest_small_and_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 9.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (20, [0.0, 1.0]), (None, [5.0, 5.0]), (20, [0.0, 1.0])]
    t = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<float>, rank string, score double")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(t, t.where("vec_id % 20 = 0")).collect())
    assert [g for g in got if g[0] == 0] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.5), (0, 4, 20, 0.0), (0, 5, 20, 0.0)]
    assert [g[2] for g in got if g[0] == 20] == [3, 0, 1, 2]
    assert ann.nearest(t.limit(0), t.limit(0)).collect() == []


# Fingerprints


def test_walk_by_hand():
    text = "a walk of some steps é"
    chars = fp.classes(text)
    steps = fp.walks(chars, np.array([0, len(chars)]), np.zeros(1, dtype=int))
    stay = fp._tables()[0].reshape(256, fp.PERIOD)
    at = 0
    for c, s in zip(chars, steps, strict=True):
        assert s == at
        at += stay[c, at % fp.PERIOD]


def test_bits_by_hand():
    """Bits of the sampled steps, and likeness from them, as from the embedding written out step by step."""
    texts = ["", "a", "short", "a walk of some steps é " * 9, "another walk of steps " * 40, "a walk of some steps é " * 8 + "another end of it"]
    stay, picked, bits = fp._tables()
    stay, bits = stay.reshape(256, fp.PERIOD), bits.reshape(256, -1)
    prints = fp.fingerprint_texts(texts)
    plain = []
    for t, end, words_ in zip(texts, prints.end, prints.words, strict=True):
        walk = []
        for c in fp.classes(t):
            walk += [c] * stay[c, len(walk) % fp.PERIOD]
        want = [int(bits[walk[p], i]) if p < len(walk) else 0 for i, p in enumerate(picked)]
        got = np.unpackbits(words_.astype("<u8").view(np.uint8), bitorder="little")
        assert end == len(walk) and got.tolist() == want
        plain.append((len(walk), want))
    starts = fp._starts()
    for i, (ea, wa) in enumerate(plain):
        for j, (eb, wb) in enumerate(plain):
            low, top, far = min(ea, eb), max(ea, eb), abs(ea - eb)
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                both = [k for k, p in enumerate(picked) if lo <= p < min(hi, low)]
                if both:
                    far += (min(hi, low) - lo) * min(1, 2 * sum(wa[k] != wb[k] for k in both) / len(both))
            assert fp.likeness(prints[[i]], prints[[j]])[0] == pytest.approx(1 - far / top if top else 1)
    again = fp.from_bytes(fp.as_bytes(prints))
    assert (again.end == prints.end).all() and (again.words == prints.words).all()


def test_fingerprints(spark, odd):
    rows = fp.fingerprints(odd, group_bytes=3000).collect()
    assert len(rows) == odd.count()
    order = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    want = []
    for i, r in enumerate(order):
        x, y = r.text or "", order[(i + 1) % len(order)].text or ""
        h = len(x) // 2
        e = x[: len(x) - h] + y[:h]
        p = fp.fingerprint_texts([x, e, y])
        own, edited, _ = (b.hex() for b in fp.as_bytes(p))
        want.append((r.doc_id, len(x), hashlib.sha256(e.encode()).hexdigest(), own, edited, float(fp.likeness(p[[0]], p[[1]])[0]), float(fp.likeness(p[[0]], p[[2]])[0])))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_groups_split_one_id(spark):
    """Many rows of one id, or of none, are dealt to several ranges, each with its next document."""
    rows = [(None if i % 2 else 5, f"text number {i} " * 20) for i in range(200)] + [(i, f"other {i} " * 20) for i in range(40)]
    got = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=2000).collect()
    assert sorted(r.fingerprint for r in got) == sorted(b.hex() for b in fp.as_bytes(fp.fingerprint_texts([t for _, t in rows])))


def test_fingerprint_follows_edits(corpus):
    texts = [t for _, t in corpus if len(t) > 600]
    edited = [t[:150] + "zz" + t[151:] for t in texts]
    half = [t[: len(t) // 2] + u[: len(t) - len(t) // 2] for t, u in zip(texts, texts[1:] + texts[:1], strict=True)]
    own = fp.fingerprint_texts(texts)
    near, mid = fp.likeness(own, fp.fingerprint_texts(edited)), fp.likeness(own, fp.fingerprint_texts(half))
    far = fp.likeness(fp.fingerprint_texts(texts[1:]), fp.fingerprint_texts(texts[:-1]))
    assert np.median(near) > 0.85 and abs(np.median(mid) - 0.5) < 0.15 and np.quantile(far, 0.99) < 0.4


def test_fingerprints_of_nothing(none):
    assert fp.fingerprints(none).collect() == []


def test_near_pairs(spark, docs):
    pairs = {(r.class_a, r.class_b) for r in fp.near_pairs(docs).collect()}
    assert not any(a == b for a, b in pairs)


@pytest.mark.parametrize("small", [64, 3])
def test_links_against_all_pairs(spark, small, monkeypatch):
    """Groups of near copies of long and short texts: at least nine of ten pairs of brute force, and no other."""
    monkeypatch.setattr(fp, "SMALL", small)
    monkeypatch.setattr(fp, "BUCKET_BLOCK", 5)
    rng = random.Random(5)
    letters = "abcdefghij klmnop"
    rows = []
    for size in (4, 12, 30, 60, 63, 66, 120, 250, 700, 3000):
        base = [rng.choice(letters) for _ in range(size)]
        for _ in range(14):
            t = list(base)
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = rng.choice(letters)
            rows.append((len(rows), "".join(t[: len(t) - rng.randint(0, 1)])))
    prints = fp.fingerprint_texts([t for _, t in rows])
    first = {}
    for i, b in enumerate(fp.as_bytes(prints)):
        first.setdefault(b, i)
    alike = {(a, b): fp.likeness(prints[[a]], prints[[b]])[0] for a, b in itertools.combinations(sorted(first.values()), 2)}
    want = {p for p, like in alike.items() if like >= fp.LEAST}
    found = fp.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.class_a, r.class_b) for r in found}
    assert len(found) == len(got) and got <= want and len(got) >= 0.9 * len(want) > 100


def test_linked_fingerprints(spark, odd, none):
    rows = fp.linked_fingerprints(odd).collect()
    plain = fp.fingerprints(odd).collect()
    assert sorted((tuple(r)[:7] for r in rows), key=str) == sorted(map(tuple, plain), key=str)
    first = {}
    for r in plain:
        if r.doc_id is not None:
            first[r.fingerprint] = min(r.doc_id, first.get(r.fingerprint, r.doc_id))
    assert all(r.class_id == first.get(r.fingerprint) for r in rows)
    known = odd.where("doc_id is not null")
    linked, alike = fp.linked_fingerprints(known).collect(), fp.near_pairs(known).collect()
    assert {r.class_id: r.links for r in linked} == {r.class_id: sum(r.class_id in (p.class_a, p.class_b) for p in alike) for r in linked}
    assert fp.linked_fingerprints(none).collect() == []
