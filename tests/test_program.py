"""Stage programs, reduction diagnostics, and runs described as data, against hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from lexweave.operators import cases, compose, diagnostics, models, program, reduction


def lex(spark, *rows):
    return spark.createDataFrame([(k, [v] if isinstance(v, str) else v) for k, v in rows], "key string, variants array<string>")


@pytest.fixture(scope="module")
def parts(spark):
    literals = lex(spark, ("ab", "ˈx"), ("cd", "ˈy"), ("abc", "z"))
    words = lex(spark, ("abcd", "ˈxˌy"), ("abcs", "zs"), ("qq", "q"))
    rules = spark.createDataFrame([(1, "suffix", "s", "S"), (2, "suffix", "d", "D")], "rule_id int, kind string, affix string, added string")
    return literals, words, rules


def stages(rules):
    return (("affix", program.affixes(rules)), ("compound", program.compound(reduction.ReductionConfig(max_components=2))))


def test_first_stage_stands(spark, parts):
    literals, words, rules = parts
    got = {r.key: (r.stage, r.rule, r.pronunciation) for r in program.reconstruct(program.Program(stages(rules)), words, literals).collect()}
    assert got == {"abcd": ("affix", "2", ["zD"]), "abcs": ("affix", "1", ["zS"])}


def test_selector_and_features(spark, parts):
    literals, words, rules = parts
    seen = []

    def choose(candidates, features):
        seen.extend((r.id, r.feature, r.value) for r in features.collect())
        return models.choose_by_priority(candidates, ("compound",))

    got = {r.key: r.pronunciation for r in program.reconstruct(program.Program(stages(rules), choose), words, literals).collect()}
    assert got == {"abcd": ["ˈxˌy"], "abcs": ["zS"]}
    assert sorted(seen) == sorted([("abcd", "word_length", "4"), ("abcd", "candidate_count", "2"), ("abcd", "stage_ids", "affix,compound"), ("abcs", "word_length", "4"), ("abcs", "candidate_count", "1"), ("abcs", "stage_ids", "affix")])


def test_rewrites_follow_another_stage(spark, parts):
    literals, words, rules = parts
    new = spark.createDataFrame([(0, "replace", "z", "w")], "rule_id int, operation string, pattern string, replacement string")
    p = program.Program((("rewrite", program.rewrites(program.affixes(rules), new)),))
    assert {r.key: r.pronunciation for r in program.reconstruct(p, words, literals).collect()} == {"abcd": ["wD"], "abcs": ["wS"]}


def test_lookup_tells_members(spark, parts):
    literals, words, rules = parts
    asked = spark.createDataFrame([(k,) for k in ("ab", "abcd", "qq", "abcdd", "abcd")], "key string")
    got = sorted((r.key, r.outcome, r.variants) for r in program.lookup(program.Program(stages(rules)[1:]), asked, literals, words.union(literals)).collect())
    assert got == [("ab", "literal", ["ˈx"]), ("abcd", "generated", ["ˈxˌy"]), ("abcd", "generated", ["ˈxˌy"]), ("abcdd", "miss", None), ("qq", "unresolved", None)]
    assert program.lookup(program.Program(stages(rules)), asked.where("false"), literals, words).count() == 0


def test_predictions_leave_out_empty_outputs(spark, parts):
    literals, words, _ = parts
    p = program.Program((("model", program.predictions(lambda w: w.withColumn("output", F.when(F.col("key") == "qq", "Q").when(F.col("key") == "abcd", "")))),))
    assert [(r.key, r.pronunciation) for r in program.reconstruct(p, words, literals).collect()] == [("qq", ["Q"])]


def test_linkers(spark):
    """A half spelled like the linker is silent; a word's splits count up to its first exact one."""
    literals = lex(spark, ("ab", "x"), ("cd", "y"), ("s", "z"), ("abs", "v"), ("cds", "u"))
    source = literals.union(lex(spark, ("abscd", "xy"), ("absscd", "vzz"), ("sscd", "y"), ("kk", "k")))
    found = diagnostics.linker_opportunities(source, literals, ("s",))
    assert {(r.key, r.place, r.exact) for r in found.collect()} == {("abscd", 1, True), ("absscd", 1, False), ("sscd", 1, True)}
    assert diagnostics.linker_counts(found).first().asDict() == {"linker": "s", "exact_count": 2, "mismatch_count": 1}
    assert diagnostics.linker_totals(found).first().asDict() == {"words_newly_segmentable": 3, "words_newly_exact": 2}


def test_ranks(spark):
    literals = lex(spark, ("a", "1"), ("ab", "2"), ("bc", "3"), ("c", "4"))
    wrong = spark.createDataFrame([("abc", ["24"]), ("abcc", ["0"])], "key string, variants array<string>")
    later = spark.createDataFrame([("abc", ["13"])], "key string, variants array<string>")
    ranks = diagnostics.exact_ranks(wrong, literals, 4)
    assert {r.key: r.exact_rank for r in ranks.collect()} == {"abc": 1, "abcc": None}
    assert diagnostics.exact_ranks(later, literals, 4).first().exact_rank == 2
    assert diagnostics.exact_ranks(later, literals, 1).first().exact_rank is None
    assert diagnostics.rank_summary(ranks).first().asDict() == {"exact_on_rank_1": 1, "exact_on_rank_2_to_k": 0, "not_exact_in_top_k": 1}


def test_rule_verdicts(spark):
    tried = spark.createDataFrame([("a", "C0", True), ("a", "C1", False), ("b", "C0", True), ("b", "C1", True), ("c", "C0", False)], "key string, rule_id string, exact boolean")
    chosen = spark.createDataFrame([("a", "C1"), ("b", "C1"), ("c", "C0"), ("d", None)], "key string, rule_id string")
    assert diagnostics.rule_verdicts(tried, chosen).first().asDict() == {"selected_rule_exact": 1, "alternate_existing_rule_exact": 1, "multiple_existing_rules_exact": 1, "no_existing_rule_exact": 1}


def test_reports(spark, tmp_path):
    row = {"baseline_words": 1200, "literal_words": 900, "generated_words": 300, "reduction_rate": 0.25}
    text = diagnostics.report_markdown(row, 1000, {"missing": 0, "extra": 0, "pronunciation_mismatch": 0, "variant_order_mismatch": 0, "false_hits": 0})
    assert "Literal-entry reduction: 25.00%" in text and "Baseline logical words: 1,200" in text and "Target met: yes" in text and text.endswith("- lossless: yes\n")
    assert "- lossless: not verified" in diagnostics.report_markdown(row, 1000)
    t = lex(spark, ("a", "x"), ("b", "y"))
    diagnostics.write_reports(str(tmp_path), {"totals": t.agg(F.count("*").alias("n"))}, {"words": t.orderBy("key")}, 1)
    assert spark.read.json(f"{tmp_path}/totals").first().n == 2
    assert [tuple(r) for r in spark.read.option("sep", "\t").option("header", "true").csv(f"{tmp_path}/words").collect()] == [("a", '["x"]')]


def test_resolve():
    got = cases.resolve({"b": {"inherits": ["a", "c"], "max_components": 2}, "a": {"scored": True, "profile": "generic"}, "c": {"profile": "de-linkers"}})
    assert list(got) == ["b", "a", "c"]
    assert (got["b"]["scored"], got["b"]["profile"], got["b"]["max_components"], got["a"]["max_components"]) == (True, "de-linkers", 2, 4)
    assert got["b"]["config_sha256"] != got["a"]["config_sha256"] == cases.resolve({"x": {"scored": True, "profile": "generic"}})["x"]["config_sha256"]


@pytest.mark.parametrize("bad", [{}, {"a": {"colour": 1}}, {"a": {"inherits": "b"}}, {"a": {"inherits": "b"}, "b": {"inherits": "a"}}, {"a": {"max_components": 0}}])
def test_resolve_refuses(bad):
    with pytest.raises(ValueError):
        cases.resolve(bad)


def test_matrix_and_runs(spark):
    lexicon = lex(spark, ("ab", "x"), ("cd", "ˈy"), ("abcd", "xˌy"), ("cdab", "ˈyx"))
    grid = cases.resolve(cases.matrix({"max_components": 2}, {"profile": ["generic", "de-compound"]}))
    rows = cases.ranked(cases.run_cases(lexicon, grid)).collect()
    assert [(r["case"], r.literal_words, r.lossless) for r in rows] == [('profile="de-compound"', 2, True), ('profile="generic"', 3, True)]
    assert cases.reduction_config(cases.resolve({"a": {"rules": ["C0"]}})["a"]).rules == (compose.C0,)
    with pytest.raises(ValueError):
        cases.reduction_config(cases.resolve({"a": {"profile": "none"}})["a"])
