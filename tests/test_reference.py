"""The dictionary operators against hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from lexweave.functions import values as V
from lexweave.operators import analytics, compare, compose, harness, lookup as L, models, reduction
from lexweave.sources import export, readers


def lex(spark, **entries):
    return readers.from_mapping(spark, entries)


def pairs(spark, *rows):
    return readers.from_pairs(spark, list(rows))


def one(df):
    return df.first().asDict()


# Values and lookup


def test_select_by_presence(spark):
    t = lex(spark, live={"DEFAULT": "l", "VERB": "v"}, aa={"NOUN": None, "DEFAULT": "d"}, plain="p", many=("x", "y", "x"), word=None)
    got = {r.key: r.selected for r in L.lookup(t.select("key"), t, "NOUN").collect()}
    assert got == {"live": ["l"], "aa": [], "plain": ["p"], "many": ["x", "y", "x"], "word": []}
    got = {r.key: r["first"] for r in L.lookup(t.select("key"), t, "VERB").collect()}
    assert got == {"live": "v", "aa": "d", "plain": "p", "many": "x", "word": None}
    miss = L.lookup(spark.createDataFrame([("nope",)], "key string"), t).first()
    assert not miss.hit and miss.selected == []


def test_layers_by_presence(spark):
    a, b = lex(spark, x={"T": None}, only="a"), lex(spark, x="masked", y="b", Haus="h")
    got = {r.key: (r.layer, r.layers) for r in L.layered_lookup(L.layered([("a", a), ("b", b)])).collect()}
    assert got == {"x": ("a", 2), "only": ("a", 1), "y": ("b", 1), "Haus": ("b", 1)}
    c = spark.createDataFrame([("q", 0, "y"), ("q", 1, "only"), ("r", 0, "Haus"), ("r", 1, "y")], "query string, pos int, key string")
    assert {r.query: r.key for r in L.layered_candidates(c, L.layered([("a", a), ("b", b)])).collect()} == {"q": "only", "r": "Haus"}


def test_aliases(spark):
    t = lex(spark, foo="f", Foo="F", bar="b", x="x", McD="m")
    assert sorted((r.key, r.owner, r.phase) for r in L.aliases(t).collect()) == [("Bar", "bar", 1), ("Foo", "Foo", 0), ("McD", "McD", 0), ("bar", "bar", 0), ("foo", "foo", 0), ("x", "x", 0)]


def test_prefixes(spark):
    t = lex(spark, **{"a": "1", "ab": "2", "é": "3", "你好": "4"})
    texts = spark.createDataFrame([("abx",), ("xé你好",)], "text string")
    assert {(r.text, r.prefix) for r in L.prefix_matches(texts, t, 5).collect()} == {("abx", "a"), ("abx", "ab")}
    assert {(r.text, r.prefix) for r in L.prefix_matches(texts, t, 5, 1).collect()} == {("xé你好", "é")}


def test_ordinals_and_misses(spark):
    t = lex(spark, **{k: "v" for k in ("b", "a", "ab", "é", "z")})
    assert [r.key for r in L.ordinals(t, 2).orderBy("ordinal").collect()] == ["a", "ab", "b", "z", "é"]
    stored = {"b", "a", "ab", "é", "z"}
    assert not stored & {r.key for r in L.adversarial_misses(t).collect()}
    assert {r.key for r in L.overlay(lex(spark, a="new"), t).collect()} == stored


def test_column_functions(spark):
    r = spark.range(1).select(
        V.demote_first(F.lit("aˈbˈc")).alias("d"), V.capitalize(F.lit("hAUS")).alias("c"), V.casefold(F.lit("Straße")).alias("f"), V.nfc(F.lit("e\u0301")).alias("n"),
        V.replace_first(F.lit("abab"), "ab", "x").alias("r"), V.occurrences(F.lit("asssa"), F.lit("ss")).alias("o"), V.grapheme_class(F.lit("9a")).alias("g"),
        V.phoneme_class(F.lit("tə")).alias("p"), V.capitalization_class(F.lit("Haus")).alias("k"), V.insert_at(F.lit("ac"), F.lit(2), "b").alias("i"),
    ).first()
    assert list(r) == ["aˌbˈc", "Haus", "strasse", "\u00e9", "xab", [2, 3], "digit", "vowel", "initial-upper", "abc"]


# Comparison


def test_verify_counts_each_kind(spark):
    source = lex(spark, gone="x", shape="x", value="x", order=("a", "b"), tags={"A": "1", "B": "2"}, null={"A": None, "B": "2"}, same=("a", "a"))
    asset = lex(spark, more="x", shape=("x",), value="y", order=("b", "a"), tags={"A": "1"}, null={"A": "1", "B": "2"}, same=("a", "a"))
    got = one(compare.verify(asset, source))
    assert got == {"source_entry_count": 7, "asset_entry_count": 7, "missing": 1, "extra": 1, "shape_mismatch": 1, "value_mismatch": 4, "tag_mismatch": 1, "null_mismatch": 2, "variant_order_mismatch": 1, "lossless": False}
    assert one(compare.diff(source, asset)) == {"only_a": 1, "only_b": 1, "same": 1, "different": 5, "shape_different": 1}
    assert one(compare.verify(source, source))["lossless"]


def test_hashes_tell_values_apart(spark):
    variants = [{"k": "a"}, {"k": ("a",)}, {"k": ("a", "a")}, {"k": None}, {"k": {"T": "a"}}, {"k": {"T": None}}, {"k": {"T": ["a"]}}, {"ka": ""}, {"k": ()}]
    assert len({compare.logical_sha256(lex(spark, **v)) for v in variants}) == len(variants)
    t = lex(spark, b="x", a="y")
    assert compare.logical_sha256(t) == compare.logical_sha256(t.orderBy("key"))


def test_pairwise(spark):
    a = lex(spark, same="s", weg=("a", "b"), part=("a", "c"), none="x", Case="q", shape="z")
    b = lex(spark, same="s", weg=("b", "a"), part=("c", "d"), none="y", case="q", shape=("z",))
    got = one(compare.compare_sources(a, b))
    want = {"exact_spelling_intersection": 5, "exact_spelling_union": 7, "lowercase_key_intersection": 6, "exact_typed_agreement": 1, "pronunciation_any_variant_agreement": 4, "shape_conflicts": 1, "value_conflicts": 1, "conflicting_overlapping_entries": 4, "same_ordered_tuple": 2, "same_unordered_variant_set": 1, "partial_variant_overlap": 1, "no_variant_overlap": 1}
    assert {k: got[k] for k in want} == want and got["jaccard_overlap"] == pytest.approx(5 / 7)
    assert [r.key for r in compare.conflict_samples(a, b, 2).collect()] == ["none", "part"]
    with pytest.raises(ValueError):
        compare.conflict_samples(a, b, -1)


# Analytics


def test_collisions(spark):
    t = lex(spark, Haus="1", haus="2", Straße="3", STRASSE="4")
    assert [(r.analysis_key, r["keys"]) for r in analytics.collisions(t, "lower").collect()] == [("haus", ["Haus", "haus"])]
    assert {r.transform: r.collision_groups for r in analytics.key_statistics(t).collect()} == {"exact": 0, "lower": 1, "casefold": 2, "nfc": 0, "nfd": 0}
    u = lex(spark, **{"caf\u00e9": "1", "cafe\u0301": "e\u0301"})
    assert one(analytics.unicode_statistics(u)) == {"non_nfc_spellings": 1, "nfc_distinct_spelling_count": 1, "nfd_distinct_spelling_count": 1, "non_nfc_pronunciation_strings": 1, "nfc_collision_groups": 1}


def test_shape(spark):
    t = pairs(spark, ("weg", "vɛk"), ("weg", "veːk"), ("weg", "vɛk"))
    assert one(analytics.source_shape(t, 3)) == {"logical_spellings": 1, "pronunciation_value_count": 3, "multi_variant_words": 1, "maximum_variant_count": 3, "duplicate_identical_rows": 1, "physical_rows": 3}


def test_cascade(spark):
    a, b = pairs(spark, ("user", "u"), ("conflict", "user"), ("left", "l")), pairs(spark, ("conflict", "domain"), ("right", "d"))
    words = spark.createDataFrame([(w,) for w in ("user", "conflict", "left", "right", "lost")], "key string")
    rows = analytics.cascade_rows(L.layered([("a", a), ("b", b)]), words, pairs(spark, ("user", "u"), ("conflict", "domain"), ("lost", "x")))
    assert {r.layer: tuple(r)[1:] for r in analytics.cascade_by_source(rows).collect()} == {"a": (3, 3, 1, 1, 1), "b": (2, 1, 0, 0, 0)}
    assert one(analytics.cascade_totals(rows)) == {"total": 5, "misses": 1, "selected_exact": 1, "oracle_exact": 2, "coverage": 0.8}


# Composition and reduction


def made(spark, rule, components, variants):
    df = spark.createDataFrame([(components, variants)], "c array<string>, v array<array<string>>")
    r = compose.RULES[rule]
    return df.select(r.applies(F.col("c"), F.col("v")).alias("a"), r.compose(F.col("v")).alias("m")).first()


def test_rules(spark):
    assert made(spark, "C0", ["A", "B"], [["a1", "a2"], ["b1", "b2"]]).m == ["a1b1", "a1b2", "a2b1", "a2b2"]
    parts = [["hˈa"], ["tˈyˈ"], ["kˈo"]]
    assert made(spark, "C1", ["ha", "ty", "ko"], parts).m == ["hˈatˌyˈkˌo"]
    assert made(spark, "C2", ["ha", "ty", "ko"], parts).m == ["hˈatˈyˈkˌo"]
    assert not made(spark, "C3", ["ha", "ty", "ko"], parts).a and made(spark, "C3", ["hat", "tys", "ko"], parts).a
    assert not made(spark, "C1", ["x", "y"], [["ˈx"], ["y"]]).a


def decided(spark, rows, **config):
    d = reduction.greedy_basis(pairs(spark, *rows).select("key", "variants"), reduction.ReductionConfig(**config))
    return {r.key: r for r in d.collect()}, d


TOY = [("1", "a"), ("2", "b"), ("12", "ab"), ("Haus", "hˈaʊs"), ("tür", "tˈyːɐ"), ("Haustür", "hˈaʊstˌyːɐ"), ("Arbeit", "a"), ("zeit", "z"), ("Arbeitszeit", "az")]


def test_toy_reduction(spark):
    got, d = decided(spark, TOY, linkers=compose.GERMAN_LINKERS)
    assert sorted(k for k, r in got.items() if not r.literal) == ["12", "Arbeitszeit", "Haustür"] and got["Arbeitszeit"].linker == "s"
    assert one(reduction.summary(d)) == {"baseline_words": 9, "literal_words": 6, "generated_words": 3, "reduction_rate": 0.333333}
    source = pairs(spark, *TOY).select("key", "variants")
    assert set(one(reduction.verify_candidate(d, source, L.adversarial_misses(source))).values()) == {0}
    q = spark.createDataFrame([("12",), ("1",), ("121",)], "key string")
    assert {r.key: (r.outcome, r.variants) for r in reduction.reconstruct_lookup(q, d).collect()} == {"12": ("generated", ["ab"]), "1": ("literal", ["a"]), "121": ("miss", None)}


def test_wrong_split_keeps_the_word(spark):
    rows = [("A", "a"), ("C", "c"), ("AB", "x"), ("BC", "y"), ("ABC", "ay")]
    got, _ = decided(spark, rows)
    assert got["ABC"].literal and got["ABC"].reason == "pronunciation-mismatch" and got["ABC"].components == ["AB", "C"]


def test_three_parts_and_limit(spark):
    rows = [("ab", "1"), ("cd", "2"), ("ef", "3"), ("abcdef", "123")]
    assert not decided(spark, rows)[0]["abcdef"].literal
    assert decided(spark, rows, max_components=2)[0]["abcdef"].literal
    assert decided(spark, rows, max_states=1)[0]["abcdef"].reason == "search-limit"


def test_recursive_parts(spark):
    rows = [("A", "a"), ("B", "b"), ("C", "c"), ("AB", "ab"), ("ABC", "abc")]
    got, _ = decided(spark, rows, recursive=True)
    assert sum(r.literal for r in got.values()) == 3


def test_levels_equal_one_word_at_a_time(spark):
    """The level loop decides as a plain builder does that visits keys by length and then spelling."""
    import random

    rng = random.Random(0)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(60)}, key=lambda w: (len(w), w))
    value = {w: "".join({"a": "ˈx", "b": "y"}[c] for c in w) if rng.random() < 0.7 else w for w in words}
    literals = {}
    for w in words:
        cut = next((i for i in range(len(w) - 1, 0, -1) if w[:i] in literals and w[i:] in literals), None)
        if cut is None or literals[w[:cut]] + literals[w[cut:]].replace("ˈ", "ˌ", 1) != value[w]:
            literals[w] = value[w]
    got, _ = decided(spark, list(value.items()), max_components=2)
    assert {k for k, r in got.items() if r.literal} == set(literals)


def test_segmentation(spark):
    t = lex(spark, a="1", ab="2", bc="3", c="4")
    w = spark.createDataFrame([("abc",)], "key string")
    assert [r.components for r in compose.segmentations(w, t, 3, 4).orderBy("place").collect()] == [["ab", "c"], ["a", "bc"]]
    assert compose.segmentations(w, t, 3, 1, max_states=1).first().limited
    assert compose.segmentation_score([1, 2]) == -100 * 2 - 12 - 4 * 2 + 2 + 1


def test_promotion(spark):
    d = spark.createDataFrame([("abc", True, "no-composition"), ("abd", True, "pronunciation-mismatch"), ("ab", False, None), ("c", False, None), ("z", False, None)], "key string, literal boolean, reason string")
    assert [(r.key, r.score) for r in reduction.promotion_candidates(d).collect()] == [("ab", 2), ("c", 1)]


# Models


def test_alignment():
    assert models.align("ab", "xy") == ["x", "y"]
    assert models.align("ab", "xyz") == ["x", "yz"]
    assert models.align("ab", "x") == ["", "x"]
    assert models.align("a", "vwxyz") is None


def test_models_learn(spark):
    t = pairs(spark, ("ab", "xy"), ("ba", "yx"), ("aab", "xxy"))
    words = spark.createDataFrame([("abba",), ("abz",)], "key string")
    assert {r.key: r.output for r in models.predict_characters(words, models.train_characters(t), "?").collect()} == {"abba": "xyyx", "abz": "xy?"}
    assert {r.key: r.output for r in models.predict_graphone(words, models.train_graphone(t)).collect()} == {"abba": "xyyx", "abz": ""}
    assert {r.key: r.output for r in models.predict_cart(t.select("key"), models.train_cart(t)).collect()} == {"ab": "xy", "ba": "yx", "aab": "xxy"}


def test_selectors(spark):
    c = spark.createDataFrame([(1, "cart", "r1", 0), (1, "graphone", "r2", 0)], "id long, stage string, rule string, score int")
    f = spark.createDataFrame([(1, "kind", "yes")], "id long, feature string, value string")
    order = ("cart", "graphone")
    assert models.choose_by_priority(c, order).first().stage == "cart"
    assert models.choose_by_tree(c, f, [("kind", "yes", "graphone")], order).first().stage == "graphone"
    assert models.choose_by_tree(c, f, [("kind", "no", "graphone")], order).first().stage == "cart"
    assert models.choose_by_score(c, {"graphone": 5}).first().stage == "graphone"
    assert models.choose_by_forest(c, f, [[("kind", "yes", "graphone")], [("kind", "yes", "graphone")], []], order).first().stage == "graphone"
    w = models.train_logistic(f.withColumn("target", F.lit("graphone")))
    assert models.choose_by_logistic(c, f, w).first().stage == "graphone"


def test_families():
    cases = {("aˈb", "aˌb"): "primary stress → secondary stress", ("ab", "aˈb"): "insert stress", ("aˈb", "ab"): "delete stress", ("ab", "ac"): "local vowel/consonant alternation", ("ab", "abc"): "other boundary-local replacement"}
    for (c, e), want in cases.items():
        assert models.family(c, e, [1], 2)[0] == want
    assert models.family("ab", "ac", [], 2)[0] == "non-local mismatch" and models.family("ab", "ab", [1], 2)[1] == "equal"


def test_affixes_and_rewrites(spark):
    t = pairs(spark, ("kind", "k"), ("kinder", "kr"), ("bild", "k"), ("bilder", "kr"))
    got = [(r.kind, r.affix, r.added, r.support) for r in models.mine_affixes(t).collect()]
    assert got == [("suffix", "er", "r", 2)]
    rules = spark.createDataFrame([(0, "suffix", "er", "r")], "rule_id int, kind string, affix string, added string")
    assert {(r.key, r.pronunciation[0]) for r in models.apply_affixes(t, t, rules).collect()} == {("kinder", "kr"), ("bilder", "kr")}
    schema = "rule_id int, operation string, spelling_left string, pronunciation_left string, pattern string, replacement string"
    rules = spark.createDataFrame([(0, "insert", "k", "", "r", "x"), (1, "delete", "", "k", "r", "")], schema)
    c = spark.createDataFrame([("kinder", "krr"), ("bilder", "r")], "key string, pronunciation string")
    assert sorted((r.key, r.rewritten) for r in models.apply_rewrites(c, rules).collect()) == [("kinder", "kr"), ("kinder", "krxr")]


def test_affix_preconditions(spark):
    """Each field of a rule by a word that it lets through and one that it refuses."""
    t = pairs(spark, ("bind", "xbindr"), ("unbinden", "p"), ("Unbinden", "q"), ("rebind", "r"), ("ab", "z"), ("abab", "w"))
    rows = [
        {"strip_prefix": "un", "strip_suffix": "en", "pronunciation_prefix_add": "<", "pronunciation_suffix_add": ">", "pronunciation_prefix_remove": "x", "pronunciation_suffix_remove": "r", "capitalization_class": "lower"},
        {"strip_prefix": "Un", "strip_suffix": "en", "capitalization_class": "initial-upper", "required_left_context": "b", "required_right_context": "nd"},
        {"strip_prefix": "re", "required_left_context": "c"}, {"strip_prefix": "re", "required_right_context": "x"}, {"strip_prefix": "re", "min_stem_length": 5},
        {"strip_prefix": "re", "spelling_suffix": "d", "spelling_prefix": "reb"}, {"strip_prefix": "re", "spelling_suffix": "x"}, {"capitalization_class": "lower"}, {"strip_suffix": "ab"}, {"strip_prefix": "aba", "strip_suffix": "bab", "min_stem_length": 0},
    ]
    names = [*models.AFFIX_TEXTS, "min_stem_length"]
    rules = spark.createDataFrame([(i, *(r.get(c) for c in names)) for i, r in enumerate(rows)], "rule_id int, " + ", ".join(f"{c} {'int' if c == names[-1] else 'string'}" for c in names))
    got = sorted((r.rule_id, r.key, r.stem, r.pronunciation[0]) for r in models.apply_affixes(t, t, rules).collect())
    assert got == [(0, "unbinden", "bind", "<bind>"), (1, "Unbinden", "bind", "xbindr"), (5, "rebind", "bind", "xbindr"), (8, "abab", "ab", "z")]


def test_rewrite_preconditions(spark):
    schema = "rule_id int, operation string, spelling_left string, spelling_right string, pronunciation_left string, pronunciation_right string, pattern string, replacement string, source_stage string"
    rows = [("", "er", "", "", None), ("", "zz", "", "", None), ("", "", "", "k", None), ("", "", "", "q", None), ("", "", "", "", "cart"), ("", "", "", "", "tree"), (None, None, None, None, None)]
    rules = spark.createDataFrame([(i, "replace", a, b, c, e, "r", "x", s) for i, (a, b, c, e, s) in enumerate(rows)], schema)
    c = spark.createDataFrame([("kinder", "krr", "cart")], "key string, pronunciation string, stage string")
    assert sorted((r.rule_id, r.rewritten) for r in models.apply_rewrites(c, rules).collect()) == [(i, "kxr") for i in (0, 2, 4, 6)]
    assert sorted(r.rule_id for r in models.apply_rewrites(c.drop("stage"), rules).collect()) == [0, 2, 6]


# Harness


def test_harness(spark):
    t = spark.createDataFrame([(1, 9.0), (2, 5.0), (2, 4.0), (3, 4.0), (1, 9.0)], "a int, b double")
    assert sorted(map(tuple, harness.pareto(t, ("a", "b")).collect())) == [(1, 9.0), (1, 9.0), (2, 4.0)]
    three = t.withColumn("c", F.lit(None).cast("int"))
    assert sorted((r.a, r.b) for r in harness.pareto(three, ("a", "b", "c")).collect()) == [(1, 9.0), (1, 9.0), (2, 4.0)]
    v = spark.createDataFrame([("x", float(i)) for i in range(1, 11)], "k string, v double")
    assert tuple(harness.nearest_rank(v, "k", "v", {"p50": 0.5, "p95": 0.95}).first())[1:] == (5.0, 10.0)
    assert tuple(harness.inclusive(v, "k", "v", {"p50": 0.5}).first())[1:] == (5.5, 5.5)
    words = spark.createDataFrame([(c * n,) for c in "abcdefgh" for n in range(1, 13)], "key string")
    assert abs(harness.stratified(words, 24).count() - 24) <= 3


# Sources, exports, store


def write(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def entries(df):
    return {r.key: (r.kind, r.variants, [tuple(i) for i in r["items"]]) for r in df.collect()}


def test_line_formats(spark, tmp_path):
    p = lambda n, t: write(tmp_path / n, t)
    read = lambda n, t, **k: {key: v[1] for key, v in entries(readers.read_lexicon(spark, p(n, t), **k)).items()}
    assert read("a.tsv", "hello\tx\nworld\ty\nhello\tz\nhello\tx\n") == {"hello": ["x", "z", "x"], "world": ["y"]}
    assert read("b.tsv", "a\tx\na\tx\nb\t\n", format="legacy-tsv") == {"a": ["x"], "b": [""]}
    assert read("c.tsv", "word\tipa\n\nHaus\t/haʊs/\npath\t/abc/def/\tnote\n", format="ipa-tsv") == {"Haus": ["haʊs"], "path": ["abc/def"]}
    assert read("d.dict", ";;; no\nWORD(2) W ER D\nWORD  W AH R D\nWORD(foo) X\n") == {"WORD": ["W ER D", "W AH R D"], "WORD(foo)": ["X"]}
    assert read("e.mfa", "# c\na\tx y\na\tz\n") == {"a": ["x y", "z"]}
    assert entries(readers.read_lexicon(spark, p("f.txt", "one\n二\n#x\n"))) == {k: ("word", [], []) for k in ("one", "二", "#x")}


@pytest.mark.parametrize("name,text", [("a.tsv", "one\n"), ("a.tsv", "\tx\n"), ("a.tsv", "a\t\n"), ("a.tsv", b"\xff\tx\n"), ("e.mfa", "a\tx\t0.5\n"), ("f.txt", "a\n\nb\n"), ("f.txt", "a\na\n"), ("g.jsonl", '{"word": "a"}\n'), ("g.jsonl", '{"word":"a","kind":"scalar","value":["x"]}\n'), ("h.json", "[]"), ("h.json", '{"a": 1}'), ("i.pls", "<lexicon><lexeme/></lexicon>"), ("i.pls", "<x/>")])
def test_bad_input_is_an_error(spark, tmp_path, name, text):
    with pytest.raises(Exception):
        readers.read_lexicon(spark, write(tmp_path / name, text)).collect()


def test_structured_formats(spark, tmp_path):
    j = '{"live":{"DEFAULT":"l","VERB":["v","w"]},"AA":{"NOUN":null},"s":"x","l":["x","y"],"e":""}'
    got = entries(readers.read_lexicon(spark, write(tmp_path / "a.json", j)))
    assert got["live"] == ("tagged", [], [("DEFAULT", "scalar", ["l"]), ("VERB", "list", ["v", "w"])]) and got["AA"][2] == [("NOUN", "null", [])] and got["e"] == ("scalar", [""], []) and got["l"] == ("list", ["x", "y"], [])
    x = '<lexicon><lexeme><grapheme>b</grapheme><phoneme>b</phoneme><phoneme>p</phoneme><role>NOUN</role></lexeme><lexeme><grapheme>b</grapheme><phoneme>v</phoneme><role>VERB</role></lexeme></lexicon>'
    assert entries(readers.read_lexicon(spark, write(tmp_path / "b.pls", x)))["b"][2] == [("NOUN", "list", ["b", "p"]), ("VERB", "scalar", ["v"])]
    import sqlite3

    db = sqlite3.connect(tmp_path / "c.db")
    db.execute("CREATE TABLE word_phonemes (word TEXT, pron_order INT, phonemes TEXT, role TEXT)")
    db.executemany("INSERT INTO word_phonemes VALUES (?, ?, ?, ?)", [("read", 1, "b", None), ("read", 0, "a", None), ("live", 0, "v", "verb")])
    db.commit()
    db.close()
    assert entries(readers.read_lexicon(spark, str(tmp_path / "c.db"))) == {"read": ("list", ["a", "b"], []), "live": ("tagged", [], [("verb", "scalar", ["v"])])}


def full(spark):
    return lex(spark, **{"s": "x", "l": ("x", "y", "x"), "t": {"B": None, "A": "1", "None": ["p", "q"]}, "w": None, "e": "", "q": 'a"\\\t'})


@pytest.mark.parametrize("name", ["x.jsonl", "x.lxc"])
def test_exports_round_trip(spark, tmp_path, name):
    path, fmt = str(tmp_path / name), "jsonl" if name.endswith("jsonl") else "lxc-tsv"
    t = full(spark).where("key <> 'q'" if fmt == "lxc-tsv" else "true")
    export.export_file(t, path, fmt)
    assert one(compare.verify(readers.read_lexicon(spark, path, fmt), t))["lossless"]


def test_lossy_exports(spark, tmp_path):
    t = full(spark)
    with pytest.raises(Exception):
        export.export_file(t, str(tmp_path / "x.tsv"))
    assert export.export_file(t, str(tmp_path / "x.tsv"), allow_lossy=True) == 6
    with pytest.raises(Exception):
        export.export_file(t, str(tmp_path / "x.json"))
    export.export_file(t.where("kind <> 'word'"), str(tmp_path / "y.json"))
    assert one(compare.verify(readers.read_lexicon(spark, str(tmp_path / "y.json")), t.where("kind <> 'word'")))["lossless"]
    assert export.convert_file(spark, str(tmp_path / "y.json"), str(tmp_path / "z.jsonl")) == 5


def test_pack(spark, tmp_path):
    t, path = full(spark), str(tmp_path / "packed")
    m = export.pack(t, path, {"license": "none"})
    assert m["entries"] == 6 and m["license"] == "none" and export.manifest_of(spark, path) == m
    assert one(compare.verify(export.open_lexicon(spark, path, check=True), t))["lossless"]
    assert export.inspect(spark, path)["tags"] == ["A", "B", "None"]
    with pytest.raises(ValueError):
        export.pack(t, str(tmp_path / "other"), {"entries": 1})


def test_reduced_asset(spark, tmp_path):
    _, d = decided(spark, TOY, max_components=2)
    export.save_reduced(d, str(tmp_path / "r"))
    again = export.load_reduced(spark, str(tmp_path / "r"), reduction.ReductionConfig(max_components=2))
    assert sorted((r.key, r.variants) for r in reduction.restore(again).collect()) == sorted((r.key, r.variants) for r in reduction.restore(d).collect())
    assert not models.audit_columns(spark.read.parquet(str(tmp_path / "r/keys")))


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "layered_lookup" in e.queries()


def test_command_line(spark, tmp_path, capsys):
    from lexweave import cli

    src = write(tmp_path / "a.tsv", "".join(f"{k}\t{v}\n" for k, v in TOY))
    assert cli.main(["pack", src, str(tmp_path / "p"), "--meta", "license=x"]) == 0
    assert cli.main(["verify", str(tmp_path / "p"), src]) == 0
    assert cli.main(["lookup", str(tmp_path / "p"), "Haus"]) == 0 and cli.main(["lookup", str(tmp_path / "p"), "nope"]) == 1
    assert cli.main(["diff", str(tmp_path / "p"), src]) == 0
    assert cli.main(["reduce", src, str(tmp_path / "r"), "--max-components", "2"]) == 0
    assert cli.main(["restore", str(tmp_path / "r"), str(tmp_path / "b.tsv"), "--max-components", "2"]) == 0
    assert sorted((tmp_path / "b.tsv").read_text().splitlines()) == sorted((tmp_path / "a.tsv").read_text().splitlines())
    assert "license" in capsys.readouterr().out


def test_capitalization_classes(spark):
    rows = [("Haus", "initial-upper"), ("HausTür", "initial-upper"), ("HAUS", "upper"), ("haus", "lower"), ("hAus", "mixed"), ("12", "mixed")]
    got = spark.createDataFrame(rows, "w string, want string").select("w", V.capitalization_class(F.col("w")).alias("got"), "want").collect()
    assert [(r.w, r.got) for r in got] == rows
