"""Affix and rewrite rules, small categorical models, selectors and failure diagnostics."""

from __future__ import annotations

import difflib
import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lexweave.functions.values import SECONDARY, PRIMARY, capitalization_class, grapheme_class, phoneme_class
from lexweave.operators.compose import with_parts

MAX_RULES = 4096


# Morphology --------------------------------------------------------------------------------------------------


def mine_affixes(lexicon: DataFrame, min_support: int = 2, max_rules: int | None = None) -> DataFrame:
    """(rule_id, kind, affix, stem_pron, word_pron, added, support): affixes between stored keys and their stems.

    Every proper beginning or end of a key is looked up, so the join is on equality. A rule's id is the place of
    its observation among all in sorted order. Where the word's value doesn't extend the stem's, added is empty.
    """
    t = lexicon.where(F.size("variants") > 0).select("key", F.element_at("variants", 1).alias("pron"))
    n = F.char_length("key")
    cuts = t.withColumn("i", F.explode(F.when(n > 1, F.sequence(F.lit(1), n - 1))))
    head, tail = F.substring("key", F.lit(1), F.col("i")), F.substring("key", F.col("i") + 1, n)
    stems = t.select(F.col("key").alias("stem"), F.col("pron").alias("stem_pron"))
    suffix = cuts.select(F.lit("suffix").alias("kind"), head.alias("stem"), tail.alias("affix"), F.col("pron").alias("word_pron"))
    prefix = cuts.select(F.lit("prefix").alias("kind"), tail.alias("stem"), head.alias("affix"), F.col("pron").alias("word_pron"))
    seen = suffix.unionByName(prefix).join(stems, "stem").groupBy("kind", "affix", "stem_pron", "word_pron").agg(F.count("*").alias("support"))
    w, s = F.col("word_pron"), F.col("stem_pron")
    added = F.when((F.col("kind") == "suffix") & w.startswith(s), F.substring(w, F.char_length(s) + 1, F.char_length(w))).when((F.col("kind") == "prefix") & w.endswith(s), F.substring(w, F.lit(1), F.char_length(w) - F.char_length(s))).otherwise("")
    rules = seen.where(F.col("support") >= min_support).withColumn("added", added)
    return rules if max_rules is None else rules.orderBy("kind", "affix", "stem_pron", "word_pron").limit(max_rules)


def _text_columns(rules: DataFrame, names: Sequence[str]) -> DataFrame:
    """rules with each of these columns, empty where it is missing or null."""
    return rules.withColumns({c: F.coalesce(F.col(c), F.lit("")) if c in rules.columns else F.lit("") for c in names})


AFFIX_TEXTS = (
    "spelling_prefix", "spelling_suffix", "strip_prefix", "strip_suffix", "required_left_context", "required_right_context",
    "pronunciation_prefix_add", "pronunciation_suffix_add", "pronunciation_prefix_remove", "pronunciation_suffix_remove", "capitalization_class",
)


def apply_affixes(words: DataFrame, literals: DataFrame, rules: DataFrame, min_stem: int = 1) -> DataFrame:
    """(key, rule_id, affix, stem, pronunciation): every affix rule on every word whose stem is stored.

    rules have a rule_id and any of AFFIX_TEXTS and min_stem_length (else min_stem), or for one plain affix kind,
    affix and added. What they strip is joined on itself, cut off words at each pair of lengths that occurs; affix
    in the result is what was stripped. A rule that strips nothing applies to no word.
    """
    if "kind" in rules.columns:
        end, start = F.col("kind") == "suffix", F.col("kind") == "prefix"
        plain = {"strip_suffix": (end, "affix"), "strip_prefix": (start, "affix"), "pronunciation_suffix_add": (end, "added"), "pronunciation_prefix_add": (start, "added")}
        rules = rules.withColumns({c: F.coalesce(F.when(is_, F.col(v)), F.col(c) if c in rules.columns else F.lit("")) for c, (is_, v) in plain.items()})
    rules = _text_columns(rules, AFFIX_TEXTS)
    rules = rules.select("rule_id", *AFFIX_TEXTS, (F.coalesce("min_stem_length", F.lit(min_stem)) if "min_stem_length" in rules.columns else F.lit(min_stem)).alias("min_stem_length"))
    n, size = F.char_length("key"), F.char_length
    lengths = rules.select(size("strip_prefix").alias("i"), size("strip_suffix").alias("j")).distinct()
    cuts = words.select("key").join(F.broadcast(lengths), (n >= F.col("i")) & (n >= F.col("j")))  # a row a pair of lengths
    ends = F.substring("key", F.lit(1), F.col("i")).alias("strip_prefix"), F.substring("key", n - F.col("j") + 1, F.col("j")).alias("strip_suffix")
    cuts = cuts.select("key", *ends, F.substring("key", F.col("i") + 1, F.greatest(n - F.col("i") - F.col("j"), F.lit(0))).alias("stem")).where(size("stem") < n)
    head = F.substring("key", 1, 1)
    upper, lower = (F.col("key") == F.upper("key")) & (F.col("key") != F.lower("key")), (F.col("key") == F.lower("key")) & (F.col("key") != F.upper("key"))
    case = F.when(upper, "upper").when((head == F.upper(head)) & (head != F.lower(head)), "initial-upper").when(lower, "lower").otherwise("mixed")
    ok = F.startswith(F.col("key"), F.col("spelling_prefix")) & F.endswith(F.col("key"), F.col("spelling_suffix")) & (size("stem") >= F.col("min_stem_length"))
    ok &= F.startswith(F.col("stem"), F.col("required_left_context")) & F.endswith(F.col("stem"), F.col("required_right_context"))
    ok &= (F.col("capitalization_class") == "") | (F.col("capitalization_class") == case)
    found = cuts.join(rules, ["strip_prefix", "strip_suffix"]).where(ok).join(literals.select(F.col("key").alias("stem"), "variants"), "stem")

    def made(v: Column) -> Column:
        a, b = F.col("pronunciation_prefix_remove"), F.col("pronunciation_suffix_remove")
        v = F.when(v.startswith(a), F.substring(v, size(a) + 1, size(v))).otherwise(v)
        v = F.when(v.endswith(b), F.substring(v, F.lit(1), size(v) - size(b))).otherwise(v)
        return F.concat("pronunciation_prefix_add", v, "pronunciation_suffix_add")

    return found.select("key", "rule_id", F.concat("strip_prefix", "strip_suffix").alias("affix"), "stem", F.transform("variants", made).alias("pronunciation"))


def apply_rewrites(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """candidates (key, pronunciation, stage if known) by rules (operation, contexts, pattern, replacement): the first match rewritten.

    A rule's spelling_left, spelling_right, pronunciation_left and pronunciation_right must be in the word or its
    pronunciation (missing or null: none needed), and its source_stage, unless null, be the candidate's stage.
    """
    texts = ("spelling_left", "spelling_right", "pronunciation_left", "pronunciation_right", "pattern", "replacement")
    rules = _text_columns(rules, texts).select("rule_id", "operation", *texts, (F.col("source_stage") if "source_stage" in rules.columns else F.lit(None).cast("string")).alias("source_stage"))
    p, pat = F.col("pronunciation"), F.col("pattern")
    ok = F.contains(F.col("key"), F.col("spelling_left")) & F.contains(F.col("key"), F.col("spelling_right")) & F.contains(p, F.col("pronunciation_left")) & F.contains(p, F.col("pronunciation_right")) & (pat != "") & F.contains(p, pat)
    ok &= F.col("source_stage").isNull() | (F.col("source_stage") == (F.col("stage") if "stage" in candidates.columns else F.lit(None).cast("string")))
    new = F.when(F.col("operation") == "insert", F.concat(pat, F.col("replacement"))).when(F.col("operation") == "delete", F.lit("")).otherwise(F.col("replacement"))
    place = F.expr("locate(pattern, pronunciation)")
    found = candidates.join(F.broadcast(rules), ok)
    return found.select("key", "rule_id", "pattern", F.overlay(p, new, place, F.char_length(pat)).alias("rewritten"))


def induce_rewrites(observations: DataFrame, max_rules: int = MAX_RULES) -> DataFrame:
    """Shared rules from edit observations (ordinal, pattern, ...): patterns of 1 to 8 characters, in order."""
    n = F.char_length("pattern")
    return observations.where((n > 0) & (n <= 8)).orderBy("ordinal").limit(max_rules).withColumnRenamed("ordinal", "rule_id")


# Categorical models ------------------------------------------------------------------------------------------


def align(spelling: str, pronunciation: str, longest: int = 4) -> list[str] | None:
    """The chunk of pronunciation of each letter: fewest empty chunks, then the smallest chunks in order; None: impossible."""
    n, m = len(spelling), len(pronunciation)
    best: list[dict[int, tuple[int, tuple[str, ...]]]] = [{} for _ in range(n + 1)]
    best[n][m] = (0, ())
    for i in range(n - 1, -1, -1):
        for j in range(m + 1):
            options = []
            for size in range(min(longest, m - j) + 1):
                rest = best[i + 1].get(j + size)
                if rest is not None:
                    options.append((rest[0] + (size == 0), (pronunciation[j : j + size], *rest[1])))
            if options:
                best[i][j] = min(options)
    found = best[0].get(0)
    return None if found is None else list(found[1])


def alignments(lexicon: DataFrame, longest: int = 4) -> DataFrame:
    """(key, pos, grapheme, chunk, ordinal): each letter of each key with its chunk; keys that can't be aligned are left out."""

    @F.pandas_udf("array<string>")
    def chunks(keys: pd.Series, prons: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else align(k, p, longest) for k, p in zip(keys, prons, strict=True)])

    t = lexicon.select("key", chunks("key", F.try_element_at("variants", F.lit(1))).alias("c")).where("c is not null")
    each = t.select("key", F.posexplode("c").alias("pos", "chunk"))
    return each.select("key", "pos", F.substring("key", F.col("pos") + 1, F.lit(1)).alias("grapheme"), "chunk")


def cart_context(word: str, at: int, previous: str) -> tuple[str, ...]:
    """What decides a letter's output: two letters to each side, its case, length and place buckets, the output before."""
    around = ["<BOS>" if i < 0 else "<EOS>" if i >= len(word) else word[i] for i in range(at - 2, at + 3)]
    c = word[at]
    return (*around, "upper" if c.isupper() else "lower" if c.islower() else "other", str(min(len(word) // 4, 15)), str(min(7, at * 8 // max(1, len(word)))), previous[:1] or "<EMPTY>")


def train_cart(lexicon: DataFrame) -> DataFrame:
    """(context, output): the majority output of each context over all aligned letters, keys in code-point order."""

    @F.pandas_udf("array<struct<context:string,output:string,p:int>>")
    def rows(keys: pd.Series, prons: pd.Series) -> pd.Series:
        out = []
        for k, p in zip(keys, prons, strict=True):
            found, previous, own = (None if p is None else align(k, p)), "", []
            for i, c in enumerate(found or ()):
                own.append({"context": "\x1f".join(cart_context(k, i, previous)), "output": c, "p": i})
                previous = c
            out.append(own)
        return pd.Series(out)

    t = lexicon.select("key", F.explode(rows("key", F.try_element_at("variants", F.lit(1)))).alias("r"))
    each = t.groupBy("r.context", "r.output").agg(F.count("*").alias("n"), F.min(F.struct("key", "r.p")).alias("f"))
    # max_by takes the smallest first meeting through a rank of it.
    return each.groupBy("context").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "f", "output")))[0]["output"].alias("output"))


def predict_cart(words: DataFrame, model: DataFrame, default: str = "") -> DataFrame:
    """(key, output): outputs letter by letter, each in the context of the one before.

    The model is a bounded table (a context a row) that tasks hold as a dictionary.
    """
    table = dict((r["context"], r["output"]) for r in model.collect())

    @F.pandas_udf("string")
    def run(keys: pd.Series) -> pd.Series:
        out = []
        for k in keys:
            made, previous = [], ""
            for i in range(len(k)):
                previous = table.get("\x1f".join(cart_context(k, i, previous)), default)
                made.append(previous)
            out.append("".join(made))
        return pd.Series(out)

    return words.select("key", run("key").alias("output"))


def train_graphone(lexicon: DataFrame) -> DataFrame:
    """(unit, output): the majority chunk of each letter; ties go to the chunk met first in key order."""
    each = alignments(lexicon).groupBy("grapheme", "chunk").agg(F.count("*").alias("n"), F.min(F.struct("key", "pos")).alias("f"))
    best = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "f", "chunk")))[0]["chunk"]
    return each.groupBy(F.col("grapheme").alias("unit")).agg(best.alias("output"))


def predict_graphone(words: DataFrame, model: DataFrame, longest: int = 2) -> DataFrame:
    """(key, output): the longest known unit at each place; a word with an unknown letter gives an empty string."""
    table = {r["unit"]: r["output"] for r in model.collect()}

    @F.pandas_udf("string")
    def run(keys: pd.Series) -> pd.Series:
        out = []
        for k in keys:
            made, i = [], 0
            while i < len(k):
                size = next((n for n in range(min(longest, len(k) - i), 0, -1) if k[i : i + n] in table), 0)
                if not size:
                    made = []
                    break
                made.append(table[k[i : i + size]])
                i += size
            out.append("".join(made))
        return pd.Series(out)

    return words.select("key", run("key").alias("output"))


def train_characters(lexicon: DataFrame) -> DataFrame:
    """(character, output): the majority output of each letter over keys as long as their pronunciation, lower-cased; ties: smallest."""
    p = F.lower(F.element_at("variants", 1))
    t = lexicon.where(F.char_length("key") == F.char_length(F.element_at("variants", 1))).where(F.char_length("key") > 0)
    each = t.select("key", p.alias("p"), F.explode(F.sequence(F.lit(1), F.char_length("key"))).alias("i")).select(F.substring("key", F.col("i"), F.lit(1)).alias("character"), F.substring("p", F.col("i"), F.lit(1)).alias("output"))
    counts = each.groupBy("character", "output").agg(F.count("*").alias("n"))
    return counts.groupBy("character").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "output")))[0]["output"].alias("output"))


def predict_characters(words: DataFrame, model: DataFrame, default: str = "") -> DataFrame:
    """(key, output): each letter's output, joined; letters without one give default."""
    each = words.where("key <> ''").select("key", F.posexplode(F.split("key", "")).alias("i", "character"))
    each = each.join(model, "character", "left")
    return each.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("output", F.lit(default)).alias("o")))), lambda x: x["o"]), "").alias("output"))


# Selectors ---------------------------------------------------------------------------------------------------


def pure_predicates(rows: DataFrame, min_support: int = 100, max_leaves: int = 64) -> DataFrame:
    """rows (feature, value, target): feature values with one target alone, at least min_support times."""
    each = rows.groupBy("feature", "value").agg(F.min("target").alias("rule_id"), F.max("target").alias("_hi"), F.count("*").alias("support"))
    pure = each.where((F.col("rule_id") == F.col("_hi")) & (F.col("support") >= min_support)).drop("_hi")
    return pure.orderBy(F.desc("support"), "feature", "value", "rule_id").limit(max_leaves)


def _key() -> Column:
    return F.struct("stage", F.coalesce("rule", F.lit("")).alias("rule"), F.coalesce("score", F.lit(0)).alias("score"))


def _place(order: Sequence[str]) -> Column:
    """A stage's place in an order; those that aren't in it come last."""
    p = F.array_position(F.array(*map(F.lit, order)), F.col("stage"))
    return F.when(p > 0, p).otherwise(F.lit(999))


def _pick(candidates: DataFrame, rank: Column) -> DataFrame:
    best = F.min_by(F.struct("stage", "rule", "score"), rank).alias("_b")
    return candidates.groupBy("id").agg(best).select("id", "_b.*")


def choose_by_priority(candidates: DataFrame, order: Sequence[str]) -> DataFrame:
    """Each id's candidate of the first stage of order that has one; within a stage the smallest."""
    return _pick(candidates, F.struct(_place(order).alias("o"), _key().alias("k")))


def choose_by_score(candidates: DataFrame, scores: dict[str, int]) -> DataFrame:
    """Each id's candidate of the stage with the highest score; ties by score, rule and stage, largest first."""
    stage = F.coalesce(F.create_map(*[F.lit(x) for kv in scores.items() for x in kv])[F.col("stage")], F.lit(0)) if scores else F.lit(0)
    key = F.struct(stage.alias("s"), F.coalesce("score", F.lit(0)).alias("c"), F.coalesce("rule", F.lit("")).alias("r"), F.col("stage").alias("t"))
    best = F.max_by(F.struct("stage", "rule", "score"), key).alias("_b")
    return candidates.groupBy("id").agg(best).select("id", "_b.*")


def choose_by_tree(candidates: DataFrame, features: DataFrame, predicates: Sequence[tuple[str, str, str]], order: Sequence[str]) -> DataFrame:
    """The first predicate (feature, value, stage) that holds and has a candidate decides; else the priority order."""
    spark = candidates.sparkSession
    rules = spark.createDataFrame([(f, v, s, i) for i, (f, v, s) in enumerate(predicates)], "feature string, value string, stage string, p int")
    held = features.join(F.broadcast(rules), ["feature", "value"]).groupBy("id", "stage").agg(F.min("p").alias("p"))
    found = candidates.join(held, ["id", "stage"], "left").join(features.select("id").distinct(), "id", "left_semi")
    return _pick(found, F.struct(F.coalesce("p", F.lit(1 << 20)).alias("p"), F.when(F.col("p").isNull(), _place(order)).otherwise(F.lit(0)).alias("o"), _key().alias("k")))


def choose_by_forest(candidates: DataFrame, features: DataFrame, trees: Sequence[Sequence[tuple[str, str, str]]], order: Sequence[str]) -> DataFrame:
    """Trees vote for a stage; the most voted, of equals the last by name, gives its smallest candidate."""
    votes = None
    for tree in trees:
        own = choose_by_tree(candidates, features, tree, order).select("id", "stage")
        votes = own if votes is None else votes.unionByName(own)
    counted = votes.groupBy("id", "stage").agg(F.count("*").alias("n"))
    won = counted.groupBy("id").agg(F.max_by("stage", F.struct("n", "stage")).alias("stage"))
    return _pick(candidates.join(won, ["id", "stage"]), _key())


BUCKETS = 1024


def logistic_bucket(text: str) -> int:
    """The keyed blake2b bucket of a `name=value` feature."""
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4, person=b"lxc-logit").digest(), "little") % BUCKETS


def _bucketed(features: DataFrame) -> DataFrame:
    @F.pandas_udf("int")
    def bucket(texts: pd.Series) -> pd.Series:
        return texts.map(logistic_bucket).astype("int32")

    names = features.select("feature", "value").distinct()
    names = names.withColumn("bucket", bucket(F.concat_ws("=", "feature", "value")))
    return features.join(names, ["feature", "value"])


def train_logistic(features: DataFrame) -> DataFrame:
    """(bucket, stage, weight): how often features of a bucket went with a target stage."""
    return _bucketed(features).groupBy("bucket", F.col("target").alias("stage")).agg(F.count("*").alias("weight"))


def choose_by_logistic(candidates: DataFrame, features: DataFrame, weights: DataFrame) -> DataFrame:
    """Each id's candidate with the largest sum of its stage's weights over the id's feature buckets."""
    total = _bucketed(features.select("id", "feature", "value")).join(weights, "bucket").groupBy("id", "stage").agg(F.sum("weight").alias("w"))
    found = candidates.join(total, ["id", "stage"], "left")
    key = F.struct(F.coalesce("w", F.lit(0)).alias("w"), F.coalesce("score", F.lit(0)).alias("c"), F.coalesce("rule", F.lit("")).alias("r"), F.col("stage").alias("t"))
    best = F.max_by(F.struct("stage", "rule", "score"), key).alias("_b")
    return found.groupBy("id").agg(best).select("id", "_b.*")


# Features and diagnostics ------------------------------------------------------------------------------------


def composition_features(splits: DataFrame, literals: DataFrame) -> DataFrame:
    """The categorical features of two-part splits (key, left, right), as text and counts."""
    v = literals.select("key", "variants")
    t = splits.join(v.select(F.col("key").alias("left"), F.col("variants").alias("lv")), "left").join(v.select(F.col("key").alias("right"), F.col("variants").alias("rv")), "right")
    marks = lambda c: F.char_length(c) - F.char_length(F.translate(c, PRIMARY + SECONDARY, ""))
    count = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + marks(x))
    first = lambda a: F.coalesce(F.try_element_at(a, F.lit(1)), F.lit(""))
    return t.select(
        "key",
        F.lit(2).alias("component_count"),
        F.concat(F.lit("("), F.char_length("left"), F.lit(","), F.char_length("right"), F.lit(")")).alias("component_lengths"),
        grapheme_class(F.substring("left", -1, 1)).alias("left_boundary"),
        grapheme_class(F.substring("right", 1, 1)).alias("right_boundary"),
        capitalization_class(F.col("key")).alias("capitalization"),
        F.concat(F.lit("("), count("lv"), F.lit(","), count("rv"), F.lit(")")).alias("stress_counts"),
        phoneme_class(first(F.col("lv"))).alias("left_phoneme"),
        phoneme_class(first(F.col("rv"))).alias("right_phoneme"),
    )


def family(candidate: str, expected: str, boundaries: Sequence[int], window: int) -> tuple[str, str]:
    """How a wrong candidate differs: its family and a template of the edits.

    An edit is local if it begins or ends within window of a boundary between components.
    """
    edits = [e for e in difflib.SequenceMatcher(a=candidate, b=expected, autojunk=False).get_opcodes() if e[0] != "equal"]
    template = ";".join(f"{tag}:{candidate[a:b]!r}->{expected[c:d]!r}" for tag, a, b, c, d in edits) or "equal"
    if not edits or not boundaries or any(all(abs(max(a, b) - x) > window for x in boundaries) for _, a, b, _, _ in edits):
        return "non-local mismatch", template
    had, has = PRIMARY in candidate, PRIMARY in expected
    if had and SECONDARY in expected:
        return "primary stress → secondary stress", template
    if has and not had:
        return "insert stress", template
    if had and not has:
        return "delete stress", template
    stressed = had or has or SECONDARY in candidate + expected
    return ("other boundary-local replacement" if stressed or len(candidate) != len(expected) else "local vowel/consonant alternation"), template


def failure_families(wrong: DataFrame, literals: DataFrame, window: int = 2) -> DataFrame:
    """(family, template, support) over wrong (key, components, candidate, expected)."""
    sized = with_parts(wrong.select("key", "components"), literals.select("key", F.char_length(F.coalesce(F.try_element_at("variants", F.lit(1)), F.lit(""))).alias("v")))
    t = wrong.select("key", "candidate", "expected").join(sized.select("key", "parts"), "key")

    @F.pandas_udf("struct<family:string,template:string>")
    def run(candidates: pd.Series, expected: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        out = []
        for c, e, s in zip(candidates, expected, sizes, strict=True):
            places, total = [], 0
            for n in list(s)[:-1]:
                total += int(n)
                places.append(total)
            out.append(family(c, e, places, window))
        return pd.DataFrame(out, columns=["family", "template"])

    f = t.select(run("candidate", "expected", "parts").alias("f"))
    return f.groupBy("f.family", "f.template").agg(F.count("*").alias("support")).orderBy(F.desc("support"), "template")


def audit_columns(table: DataFrame, forbidden: str = r"(?i)(recipe|decomposition|expected|target|oracle)") -> list[str]:
    """Columns of a runtime table, nested ones too, whose names say that per-word answers are stored."""
    import re

    out: list[str] = []

    def walk(kind, path: str) -> None:
        for f in getattr(kind, "fields", []):
            name = f"{path}.{f.name}" if path else f.name
            if re.search(forbidden, f.name):
                out.append(name)
            walk(getattr(f.dataType, "elementType", f.dataType), name)

    walk(table.schema, "")
    return out
