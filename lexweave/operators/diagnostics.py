"""What a reduction missed: linking elements that would help, ranks of right segmentations, and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexweave.operators.compose import GERMAN_LINKERS, PROFILES, Rule, linker_candidates, propose, segmentations, with_parts


def _any_exact(rules: tuple[Rule, ...]) -> F.Column:
    return F.exists(propose(F.col("components"), F.col("parts"), rules), lambda c: c["pronunciation"] == F.col("want"))


def linker_opportunities(source: DataFrame, literals: DataFrame, linkers: tuple[str, ...] = GERMAN_LINKERS, rules: tuple[Rule, ...] = PROFILES["de-linkers"]) -> DataFrame:
    """(key, place, linker, exact): for source's words that aren't literals, each split of them around a linker.

    exact tells whether any rule makes the word's variants from it; a half spelled like the linker is silent too.
    """
    silent = F.array(F.lit(""))
    lit = literals.select("key", "variants")
    words = source.join(literals.select("key"), "key", "left_anti")
    found = linker_candidates(words.select("key"), literals, linkers)
    for side in ("left", "right"):
        found = found.join(lit.select(F.col("key").alias(side), F.col("variants").alias(f"_{side}")), side)
        found = found.withColumn(f"_{side}", F.when(F.col(side) == F.col("linker"), silent).otherwise(F.col(f"_{side}")))
    found = found.join(words.select("key", F.col("variants").alias("want")), "key")
    found = found.withColumns({"components": F.array("left", "linker", "right"), "parts": F.array("_left", silent, "_right")})
    return found.select("key", "place", "linker", F.coalesce(_any_exact(rules), F.lit(False)).alias("exact"))


def linker_counts(opportunities: DataFrame) -> DataFrame:
    """(linker, exact_count, mismatch_count): a word's splits count up to and with its first exact one."""
    first = opportunities.where("exact").groupBy("key").agg(F.min("place").alias("_first"))
    seen = opportunities.join(first, "key", "left").where("_first is null or place <= _first")
    return seen.groupBy("linker").agg(F.count_if("exact").alias("exact_count"), F.count_if(~F.col("exact")).alias("mismatch_count"))


def linker_totals(opportunities: DataFrame) -> DataFrame:
    """One row: words that linkers make segmentable, and of those the ones that come out exact."""
    per = opportunities.groupBy("key").agg(F.bool_or("exact").alias("exact"))
    return per.agg(F.count("*").alias("words_newly_segmentable"), F.count_if("exact").alias("words_newly_exact"))


def exact_ranks(wrong: DataFrame, literals: DataFrame, k: int = 8, max_components: int = 4, max_states: int = 100_000, rules: tuple[Rule, ...] = PROFILES["de-boundary"]) -> DataFrame:
    """(key, exact_rank) of wrong (key, variants): the first of the k best segmentations that some rule makes exact, else null."""
    found = segmentations(wrong.select("key"), literals, max_components, k, max_states).where("not limited")
    parts = with_parts(found.select("key", "components"), literals.select("key", F.col("variants").alias("v"))).join(found.select("key", "components", "place"), ["key", "components"])
    each = parts.join(wrong.select("key", F.col("variants").alias("want")), "key").where(_any_exact(rules))
    return wrong.select("key").join(each.groupBy("key").agg(F.min("place").alias("exact_rank")), "key", "left")


def rank_summary(ranks: DataFrame) -> DataFrame:
    """One row: words exact on rank 1, on a later rank, and on none."""
    r = F.col("exact_rank")
    return ranks.agg(F.count_if(r == 1).alias("exact_on_rank_1"), F.count_if(r > 1).alias("exact_on_rank_2_to_k"), F.count_if(r.isNull()).alias("not_exact_in_top_k"))


def rule_verdicts(alternates: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row over words whose candidate was wrong: is the rule that was selected exact, another one, several, none?"""
    chosen = decisions.select("key", F.col("rule_id").alias("_chosen"))
    per = alternates.join(chosen, "key").groupBy("key").agg(F.count_if("exact").alias("n"), F.coalesce(F.bool_or(F.col("exact") & (F.col("rule_id") == F.col("_chosen"))), F.lit(False)).alias("own"))
    n = F.col("n")
    return per.agg(F.count_if("own").alias("selected_rule_exact"), F.count_if((n > 0) & ~F.col("own")).alias("alternate_existing_rule_exact"), F.count_if(n > 1).alias("multiple_existing_rules_exact"), F.count_if(n == 0).alias("no_existing_rule_exact"))


def write_reports(folder: str, summaries: dict[str, DataFrame], tables: dict[str, DataFrame], most: int | None = None) -> None:
    """Summaries (few rows each) as JSON lines, tables as TSV with a header, one folder each below folder.

    Executors write them, so folder is a path that Spark can write. most keeps the first rows of each table.
    """
    for name, df in summaries.items():
        df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")
    for name, df in tables.items():
        df = df if most is None else df.limit(most)
        flat = [F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c) for c in df.columns]
        df.select(*flat).write.mode("overwrite").option("sep", "\t").option("header", "true").csv(f"{folder}/{name}")


def report_markdown(summary: dict, target: int, verification: dict | None = None) -> str:
    """A reduction's report from reduction.summary's row and, if it was verified, verify_candidate's."""
    baseline, literal = int(summary["baseline_words"]), int(summary["literal_words"])
    v = verification or {}
    lossless = "not verified" if verification is None else "yes" if not any(v.values()) else "no"
    # The wording of the report.
    lines = [
        "# Lexicon resident-entry reduction result",
        "",
        f"Baseline logical words: {baseline:,}",
        f"Candidate literal words: {literal:,}",
        f"Implicitly generated baseline words: {int(summary['generated_words']):,}",
        f"Literal-entry reduction: {float(summary['reduction_rate'] or 0):.2%}",
        f"Target: <= {target:,}",
        f"Target met: {'yes' if literal <= target else 'no'}",
        "",
        "Lossless verification:",
        f"- missing: {int(v.get('missing', 0)):,}",
        f"- extra membership hits: {int(v.get('extra', 0)) + int(v.get('false_hits', 0)):,}",
        f"- pronunciation mismatches: {int(v.get('pronunciation_mismatch', 0)):,}",
        f"- variant-order mismatches: {int(v.get('variant_order_mismatch', 0)):,}",
        f"- lossless: {lossless}",
    ]
    return "\n".join(lines) + "\n"
