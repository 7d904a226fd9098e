"""Queries over the derived lexicons, one or more for each operator, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from lexweave.functions import values as V
from lexweave.operators import analytics, cases, compare, compose, diagnostics, harness, lookup as L, models, program, reduction
from lexweave.plans import derive as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# DuckDB spelling of the derived views.
_T = "translate(lower({0}), 'cqxyw', 'kkzif')"


def _p(w: str) -> str:
    t = _T.format
    return f"CASE WHEN length({w}) < 4 THEN {t(w)} WHEN length({w}) < 8 THEN 'ˈ' || {t(w)} ELSE 'ˈ' || {t(f'left({w}, 4)')} || 'ˌ' || {t(f'substr({w}, 5)')} END"


_TOK = r"tok AS (SELECT lang, w, count(*)::BIGINT AS n, min(doc_id) AS fd FROM (SELECT lang, doc_id, unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM documents) GROUP BY lang, w)"
_LEX = f"lex AS (SELECT lang, w AS key, {_p('w')} AS pron FROM tok)"
_FORMS = "forms AS (SELECT w, sum(n) AS n FROM tok GROUP BY w), lv AS (SELECT lower(w) AS key, list(w ORDER BY n DESC, w) AS variants FROM forms GROUP BY lower(w))"
_WORDS = r"words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}+')) AS key FROM benchmark)"
_LAYERED = "lay AS (SELECT *, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS i FROM lex WHERE lang IN ('en', 'de', 'fr', 'es'))"


def _with(*views: str) -> str:
    return "WITH " + ", ".join(views) + " "


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL if it has one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _layers(spark: SparkSession, d: str) -> DataFrame:
    return L.layered([(x, D.lex(spark, d, x)) for x in D.LANGS])


def _join(c: str) -> F.Column:
    return F.array_join(c, "|").alias(c)


# Lookup ------------------------------------------------------------------------------------------------------


@query("lookup_exact", _with(_TOK, _LEX, _WORDS) + "SELECT w.key, l.pron IS NOT NULL AS hit, coalesce(l.pron, '') AS selected FROM words w LEFT JOIN (SELECT * FROM lex WHERE lang = 'en') l USING (key)")
def lookup_exact(spark, d):
    return L.lookup(D.lex_words(spark, d).select("key"), D.lex(spark, d, "en")).select("key", "hit", F.array_join("selected", "|").alias("selected"))


@query("lookup_miss", _with(_TOK, _LEX) + "SELECT key FROM lex WHERE lang = 'fr' AND key NOT IN (SELECT key FROM lex WHERE lang = 'es')")
def lookup_miss(spark, d):
    return L.misses(D.lex(spark, d, "fr").select("key"), D.lex(spark, d, "es"))


@query("membership", _with(_TOK, _LEX, _WORDS) + "SELECT key FROM words WHERE key IN (SELECT key FROM lex WHERE lang = 'en')")
def membership(spark, d):
    return L.members(D.lex_words(spark, d).select("key"), D.lex(spark, d, "en"))


_TAGGED = rf"tg AS (SELECT DISTINCT role, unnest(regexp_extract_all(text, '\p{{L}}+')) AS key FROM conversations WHERE role IS NOT NULL), tv AS (SELECT key, role, {_p('key || CASE WHEN role = $$user$$ THEN $$$$ ELSE role END')} AS pron FROM tg)"


@query(
    "select_tag_default",
    _with(_TAGGED) + "SELECT key, coalesce(max(pron) FILTER (role = 'assistant'), max(pron) FILTER (role = 'user'), '') AS pron FROM tv GROUP BY key",
)
def select_tag_default(spark, d):
    t = D.lex_tagged(spark, d)
    chosen = V.first_of(V.variants_of(F.col("kind"), F.col("variants"), F.col("items"), "assistant", "user"))
    return t.select("key", F.coalesce(chosen, F.lit("")).alias("pron"))


@query("tagged_strings", _with(_TAGGED) + "SELECT key, string_agg(pron, '|' ORDER BY role) AS strings, count(*)::BIGINT AS n FROM tv GROUP BY key")
def tagged_strings(spark, d):
    s = V.all_strings(F.col("variants"), F.col("items"))
    return D.lex_tagged(spark, d).select("key", F.array_join(s, "|").alias("strings"), F.size(s).cast("long").alias("n"))


@query(
    "prefix_matches",
    _with(_TOK, _LEX) + "SELECT DISTINCT t.key AS text, p.key AS prefix FROM (SELECT key FROM lex WHERE lang = 'de') t, unnest(range(1, length(t.key) + 1)) AS u(n) JOIN (SELECT key FROM lex WHERE lang = 'de') p ON p.key = left(t.key, n)",
)
def prefix_matches(spark, d):
    t = D.lex(spark, d, "de")
    longest = t.agg(F.max(F.char_length("key"))).first()[0] or 0
    return L.prefix_matches(t.select(F.col("key").alias("text")), t, longest)


@query("prefix_length_index", _with(_TOK) + "SELECT left(w, 1) AS head, string_agg(DISTINCT length(w)::VARCHAR, '|' ORDER BY length(w)::VARCHAR) AS lengths FROM tok WHERE lang = 'es' GROUP BY 1")
def prefix_length_index(spark, d):
    return L.prefix_length_index(D.lex(spark, d, "es")).select("head", F.array_join(F.array_sort(F.transform("lengths", lambda x: x.cast("string"))), "|").alias("lengths"))


@query("ordinal_blocks", _with(_TOK) + "SELECT w AS key, n, n // 256 AS block, n % 256 AS place FROM (SELECT w, row_number() OVER (ORDER BY w) - 1 AS n FROM tok WHERE lang = 'en')")
def ordinal_blocks(spark, d):
    return L.ordinals(D.lex(spark, d, "en")).withColumnRenamed("ordinal", "n")


@query("interned_ids", _with(_TOK, _LEX) + "SELECT DISTINCT pron AS value, dense_rank() OVER (ORDER BY pron) - 1 AS id FROM lex WHERE lang = 'de'")
def interned_ids(spark, d):
    return L.interned(D.lex(spark, d, "de"))


# Layers ------------------------------------------------------------------------------------------------------


@query(
    "layered_lookup",
    _with(_TOK, _LEX, _LAYERED) + "SELECT key, lang AS layer, i::INT AS layer_idx, pron, c AS layers FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY i) AS r, count(*) OVER (PARTITION BY key) AS c FROM lay) WHERE r = 1",
)
def layered_lookup(spark, d):
    return L.layered_lookup(_layers(spark, d)).select("key", "layer", "layer_idx", F.array_join("variants", "|").alias("pron"), "layers")


@query(
    "layered_candidates",
    _with(_TOK, _LEX, _LAYERED, _WORDS)
    + "SELECT query, key, layer FROM (SELECT query, c.key, l.lang AS layer, row_number() OVER (PARTITION BY query ORDER BY l.i, c.pos) AS r FROM (SELECT key AS query, key, 0 AS pos FROM words UNION ALL SELECT key, lower(key), 1 FROM words WHERE lower(key) <> key) c JOIN lay l ON l.key = c.key) WHERE r = 1",
)
def layered_candidates(spark, d):
    w = D.lex_words(spark, d)
    c = w.select(F.col("key").alias("query"), F.lit(0).alias("pos"), "key").union(w.select("key", F.lit(1), F.lower("key")))
    return L.layered_candidates(c, _layers(spark, d)).select("query", "key", "layer")


@query("layered_order", _with(_TOK, _LEX, _LAYERED) + "SELECT key, arg_min(lang, i) AS layer, min(i)::INT AS layer_idx FROM lay GROUP BY key")
def layered_order(spark, d):
    return L.layered_order(_layers(spark, d)).select("key", "layer", "layer_idx")


_ASCII = "ax AS (SELECT key, pron FROM lex WHERE lang = 'en' AND regexp_full_match(key, '[A-Za-z]+'))"
_ALIASES = (
    "cap AS (SELECT *, upper(left(key, 1)) || lower(substr(key, 2)) AS cap FROM ax), "
    "al AS (SELECT CASE WHEN length(key) < 2 THEN NULL WHEN key = lower(key) THEN cap WHEN key = cap THEN lower(key) END AS key, key AS owner, pron FROM cap), "
    "every AS (SELECT key, key AS owner, pron, 0 AS phase FROM ax UNION ALL SELECT key, owner, pron, 1 FROM al WHERE key IS NOT NULL AND key <> owner AND key NOT IN (SELECT key FROM ax))"
)


def _ascii(spark, d):
    return D.lex(spark, d, "en").where(F.col("key").rlike("^[A-Za-z]+$"))


@query("case_alias_enumerate", _with(_TOK, _LEX, _ASCII, _ALIASES) + "SELECT key, owner, phase::INT AS phase FROM every")
def case_alias_enumerate(spark, d):
    return L.aliases(_ascii(spark, d)).select("key", "owner", "phase")


@query("case_alias_lookup", _with(_TOK, _LEX, _ASCII, _ALIASES, _WORDS) + "SELECT w.key, coalesce(e.owner, '') AS owner, coalesce(e.pron, '') AS pron FROM words w LEFT JOIN every e USING (key)")
def case_alias_lookup(spark, d):
    found = D.lex_words(spark, d).select("key").join(L.aliases(_ascii(spark, d)), "key", "left")
    return found.select("key", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce(F.array_join("variants", "|"), F.lit("")).alias("pron"))


@query("overlay_lookup", _with(_TOK, _LEX) + "SELECT key, pron, 'de' AS side FROM lex WHERE lang = 'de' UNION ALL SELECT key, pron, 'en' FROM lex WHERE lang = 'en' AND key NOT IN (SELECT key FROM lex WHERE lang = 'de')")
def overlay_lookup(spark, d):
    over, base = D.lex(spark, d, "de"), D.lex(spark, d, "en")
    o = L.overlay(over, base).join(over.select("key", F.lit("de").alias("side")), "key", "left")
    return o.select("key", F.array_join("variants", "|").alias("pron"), F.coalesce("side", F.lit("en")).alias("side"))


# Comparison --------------------------------------------------------------------------------------------------

_AB = "a AS (SELECT key, pron FROM lex WHERE lang = 'en'), b AS (SELECT key, pron FROM lex WHERE lang = 'de')"


@query(
    "diff_lexicons",
    _with(_TOK, _FORMS.replace("FROM tok", "FROM tok WHERE lang = 'en'"), _FORMS.replace("forms", "forms2").replace("lv AS", "lw AS").replace("FROM tok", "FROM tok WHERE lang = 'de'"))
    + "SELECT count(*) FILTER (lw.key IS NULL) AS only_a, count(*) FILTER (lv.key IS NULL) AS only_b, count(*) FILTER (lv.variants = lw.variants) AS same, count(*) FILTER (lv.variants <> lw.variants) AS different, 0::BIGINT AS shape_different FROM lv FULL OUTER JOIN lw ON lv.key = lw.key",
)
def diff_lexicons(spark, d):
    return compare.diff(D.lex_variants(spark, d, "en"), D.lex_variants(spark, d, "de"))


@query(
    "verify_counts",
    _with(_TOK, _FORMS.replace("FROM tok", "FROM tok WHERE lang = 'en'"), _FORMS.replace("forms", "forms2").replace("lv AS", "lw AS").replace("FROM tok", "FROM tok WHERE lang = 'de'"))
    + "SELECT count(lv.key) AS source_entry_count, count(lw.key) AS asset_entry_count, count(*) FILTER (lw.key IS NULL) AS missing, count(*) FILTER (lv.key IS NULL) AS extra, 0::BIGINT AS shape_mismatch, count(*) FILTER (lv.variants <> lw.variants) AS value_mismatch, 0::BIGINT AS tag_mismatch, 0::BIGINT AS null_mismatch, count(*) FILTER (lv.variants <> lw.variants AND list_sort(lv.variants) = list_sort(lw.variants)) AS variant_order_mismatch, false AS lossless FROM lv FULL OUTER JOIN lw ON lv.key = lw.key",
)
def verify_counts(spark, d):
    return compare.verify(D.lex_variants(spark, d, "de"), D.lex_variants(spark, d, "en"))


@query("conflict_samples", _with(_TOK, _LEX, "lw AS (SELECT key, list(pron) AS v FROM lex WHERE lang = 'en' GROUP BY key)", _FORMS) + "SELECT lv.key, array_to_string(lw.v, '|') AS left_variants, array_to_string(lv.variants, '|') AS right_variants FROM lw JOIN lv ON lw.key = lv.key WHERE lw.v <> lv.variants OR NOT list_has_any(lw.v, lv.variants) ORDER BY lv.key LIMIT 1000")
def conflict_samples(spark, d):
    return compare.conflict_samples(D.lex(spark, d, "en"), D.lex_variants(spark, d)).select("key", "left_variants", "right_variants")


@query(
    "variant_agreement",
    _with(_TOK, _FORMS.replace("FROM tok", "FROM tok WHERE lang = 'en'"), _FORMS.replace("forms", "forms2").replace("lv AS", "lw AS").replace("FROM tok", "FROM tok WHERE lang = 'fr'"))
    + "SELECT CASE WHEN lv.variants = lw.variants THEN 'same_ordered_tuple' WHEN list_sort(lv.variants) = list_sort(lw.variants) THEN 'same_unordered_variant_set' WHEN list_has_any(lv.variants, lw.variants) THEN 'partial_variant_overlap' ELSE 'no_variant_overlap' END AS variant_class, count(*) AS n FROM lv JOIN lw ON lv.key = lw.key GROUP BY 1",
)
def variant_agreement(spark, d):
    return compare.agreement(D.lex_variants(spark, d, "en"), D.lex_variants(spark, d, "fr")).groupBy("variant_class").agg(F.count("*").alias("n"))


@query(
    "pairwise_metrics",
    _with(_TOK, _LEX, "pairs AS (SELECT a.lang AS source_a, b.lang AS source_b FROM (SELECT DISTINCT lang FROM lex) a, (SELECT DISTINCT lang FROM lex) b WHERE a.lang < b.lang)")
    + """SELECT source_a, source_b,
  (SELECT count(*) FROM lex WHERE lang = source_a) AS logical_entry_count_a, (SELECT count(*) FROM lex WHERE lang = source_b) AS logical_entry_count_b,
  (SELECT count(*) FROM lex x JOIN lex y USING (key) WHERE x.lang = source_a AND y.lang = source_b) AS exact_spelling_intersection,
  (SELECT count(DISTINCT key) FROM lex WHERE lang IN (source_a, source_b)) AS exact_spelling_union,
  (SELECT count(DISTINCT lower(x.key)) FROM lex x WHERE x.lang = source_a AND lower(x.key) IN (SELECT lower(key) FROM lex y WHERE y.lang = source_b)) AS lowercase_key_intersection,
  (SELECT count(*) FROM lex x JOIN lex y USING (key) WHERE x.lang = source_a AND y.lang = source_b AND x.pron = y.pron) AS exact_typed_agreement
FROM pairs""",
)
def pairwise_metrics(spark, d):
    out = compare.pairwise({x: D.lex(spark, d, x) for x in D.LANGS})
    return out.select("source_a", "source_b", "logical_entry_count_a", "logical_entry_count_b", "exact_spelling_intersection", "exact_spelling_union", "lowercase_key_intersection", "exact_typed_agreement")


@query("pairwise_unicode")
def pairwise_unicode(spark, d):
    return compare.compare_sources(D.lex(spark, d, "de"), D.lex(spark, d, "fr"), "de", "fr")


@query(
    "cross_source_sharing",
    _with(_TOK, _LEX, "pairs AS (SELECT a.lang AS source_a, b.lang AS source_b FROM (SELECT DISTINCT lang FROM lex) a, (SELECT DISTINCT lang FROM lex) b WHERE a.lang < b.lang)")
    + """SELECT source_a, source_b,
  (SELECT count(*) FROM lex x JOIN lex y USING (key) WHERE x.lang = source_a AND y.lang = source_b AND x.pron = y.pron) AS identical_typed,
  (SELECT count(*) FROM lex x JOIN lex y USING (key) WHERE x.lang = source_a AND y.lang = source_b AND x.pron = y.pron) AS shared_variant,
  (SELECT count(DISTINCT x.pron) FROM lex x WHERE x.lang = source_a AND x.pron IN (SELECT pron FROM lex y WHERE y.lang = source_b)) AS shared_strings
FROM pairs""",
)
def cross_source_sharing(spark, d):
    return compare.sharing({x: D.lex(spark, d, x) for x in D.LANGS})


@query("entry_hash")
def entry_hash(spark, d):
    return compare.entry_hashes(D.lex_variants(spark, d))


@query("content_fingerprint")
def content_fingerprint(spark, d):
    return compare.content_fingerprint(D.lex_tagged(spark, d)).select("entries", F.col("digest").cast("string").alias("digest"))


# Analytics ---------------------------------------------------------------------------------------------------


@query("collisions_lower", _with(_TOK) + "SELECT k AS analysis_key, string_agg(w, '|' ORDER BY w) AS keys FROM (SELECT DISTINCT w, lower(w) AS k FROM tok) GROUP BY k HAVING count(*) > 1")
def collisions_lower(spark, d):
    return analytics.collisions(D.tok(spark, d).select(F.col("w").alias("key")).distinct(), "lower").select("analysis_key", _join("keys"))


@query("collisions_nfc", _with(_TOK) + "SELECT k AS analysis_key, string_agg(w, '|' ORDER BY w) AS keys FROM (SELECT w, nfc_normalize(w) AS k FROM tok) GROUP BY k HAVING count(*) > 1")
def collisions_nfc(spark, d):
    return analytics.collisions(D.tok(spark, d).select(F.col("w").alias("key")), "nfc").select("analysis_key", _join("keys"))


@query("collisions_casefold")
def collisions_casefold(spark, d):
    return analytics.collisions(D.tok(spark, d).select(F.col("w").alias("key")).distinct(), "casefold").select("analysis_key", _join("keys"))


@query("key_statistics")
def key_statistics(spark, d):
    return analytics.key_statistics(D.lex(spark, d, "de"))


@query("unicode_nfd")
def unicode_nfd(spark, d):
    return analytics.unicode_statistics(D.lex(spark, d, "fr"))


@query("unicode_nfc_stats", _with(_TOK, _LEX) + "SELECT count(*) FILTER (key <> nfc_normalize(key)) AS non_nfc_spellings, count(DISTINCT nfc_normalize(key)) AS nfc_distinct_spelling_count, count(*) FILTER (pron <> nfc_normalize(pron)) AS non_nfc_pronunciation_strings FROM lex WHERE lang = 'fr'")
def unicode_nfc_stats(spark, d):
    return analytics.unicode_statistics(D.lex(spark, d, "fr")).select("non_nfc_spellings", "nfc_distinct_spelling_count", "non_nfc_pronunciation_strings")


@query(
    "source_shape",
    _with(_TOK, _FORMS) + "SELECT count(*) AS logical_spellings, sum(len(variants))::BIGINT AS pronunciation_value_count, count(*) FILTER (len(variants) > 1) AS multi_variant_words, max(len(variants))::BIGINT AS maximum_variant_count, sum(len(variants) - len(list_distinct(variants)))::BIGINT AS duplicate_identical_rows, sum(len(variants))::BIGINT AS physical_rows FROM lv",
)
def source_shape(spark, d):
    return analytics.source_shape(D.lex_variants(spark, d))


@query("source_summary")
def source_summary(spark, d):
    return analytics.source_summary(D.lex_variants(spark, d, "es"), "es")


_CASCADE = (
    r"good AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)), "
    f"ref AS (SELECT w AS key, {_p('w')} AS want FROM good), "
    "rows AS (SELECT key, arg_min(lang, i) AS selected, arg_min(pron, i) AS value, count(*) AS hits, count(DISTINCT pron) > 1 AS conflict, list(pron) AS alls FROM lay GROUP BY key), "
    "ev AS (SELECT rows.*, want, CASE WHEN want IS NOT NULL THEN value = want END AS exact, CASE WHEN want IS NOT NULL THEN list_contains(alls, want) END AS oracle FROM rows LEFT JOIN ref USING (key))"
)


def _cascade(spark, d):
    return analytics.cascade_rows(_layers(spark, d), None, D.reference(spark, d))


@query(
    "cascade_by_source",
    _with(_TOK, _LEX, _LAYERED, _CASCADE) + "SELECT h.layer, h.hits, coalesce(c.a, 0) AS incremental_hits, coalesce(c.b, 0) AS conflict_wins, coalesce(c.e, 0) AS incremental_exact, coalesce(c.f, 0) AS incremental_errors FROM (SELECT lang AS layer, count(*) AS hits FROM lay GROUP BY lang) h LEFT JOIN (SELECT selected, count(*) AS a, count(*) FILTER (conflict) AS b, count(*) FILTER (exact) AS e, count(*) FILTER (NOT exact) AS f FROM ev GROUP BY selected) c ON h.layer = c.selected",
)
def cascade_by_source(spark, d):
    return analytics.cascade_by_source(_cascade(spark, d))


@query("cascade_totals", _with(_TOK, _LEX, _LAYERED, _CASCADE) + "SELECT count(*) AS total, 0::BIGINT AS misses, count(*) FILTER (exact) AS selected_exact, count(*) FILTER (oracle) AS oracle_exact, 1.0::DOUBLE AS coverage FROM ev")
def cascade_totals(spark, d):
    return analytics.cascade_totals(_cascade(spark, d))


@query("runtime_unique", _with(_TOK, "s AS (SELECT lang, lower(w) AS key, arg_min(left(lower(w), 3), w) AS x, list(left(lower(w), 3) ORDER BY w) AS v FROM tok GROUP BY lang, lower(w))") + "SELECT lang, key, len(v)::BIGINT AS before, len(list_distinct(v))::BIGINT AS after, x AS first FROM s")
def runtime_unique(spark, d):
    t = D.tok(spark, d).groupBy("lang", F.lower("w").alias("key")).agg(F.transform(F.sort_array(F.collect_list("w")), lambda w: F.substring(F.lower(w), 1, 3)).alias("v"))
    u = V.runtime_unique(F.col("v"))
    return t.select("lang", "key", F.size("v").cast("long").alias("before"), F.size(u).cast("long").alias("after"), F.element_at(u, 1).alias("first"))


@query("variant_order", _with(_TOK, _FORMS) + "SELECT key, array_to_string(variants, '|') AS variants FROM lv")
def variant_order(spark, d):
    return D.lex_variants(spark, d).select("key", _join("variants"))


# Composition -------------------------------------------------------------------------------------------------

_DE = f"ke AS (SELECT key, pron FROM lex WHERE lang = 'de')"
_SPLITS = "sp AS (SELECT k.key, i, a.key AS l, b.key AS r, a.pron AS lp, b.pron AS rp, k.pron FROM ke k, unnest(range(1, length(k.key))) AS u(i) JOIN ke a ON a.key = left(k.key, i) JOIN ke b ON b.key = substr(k.key, i + 1))"
_BEST = "best AS (SELECT key, any_value(pron) AS pron, arg_max(l, i) AS l, arg_max(r, i) AS r, arg_max(lp, i) AS lp, arg_max(rp, i) AS rp FROM sp GROUP BY key)"


def _dem(c: str) -> str:
    return f"regexp_replace({c}, '^([^ˈ]*)ˈ', '\\1ˌ')"


@query("two_part_segmentation", _with(_TOK, _LEX, _DE, _SPLITS, _BEST) + 'SELECT key, l AS "left", r AS "right" FROM best')
def two_part_segmentation(spark, d):
    t = D.lex(spark, d, "de")
    return compose.best_two_part(t, t)


def _composed(spark, d, rule: str):
    t = D.lex(spark, d, "de")
    b = compose.best_two_part(t, t)
    v = t.select("key", "variants")
    b = b.join(v.select(F.col("key").alias("left"), F.col("variants").alias("lv")), "left").join(v.select(F.col("key").alias("right"), F.col("variants").alias("rv")), "right")
    b = b.withColumn("components", F.array("left", "right")).withColumn("parts", F.array("lv", "rv"))
    r = compose.RULES[rule]
    return b.where(r.applies(F.col("components"), F.col("parts"))).select("key", F.array_join(r.compose(F.col("parts")), "|").alias("made"))


for _id, _when, _made in (("concat", "true", "lp || rp"), ("c1", "contains(rp, 'ˈ')", f"lp || {_dem('rp')}"), ("c2", "contains(rp, 'ˈ')", f"lp || {_dem('rp')}"), ("c3", "contains(rp, 'ˈ') AND NOT regexp_matches(lower(right(l, 1)), '[aeiouyäöü]')", f"lp || {_dem('rp')}")):
    query(f"compose_{_id}", _with(_TOK, _LEX, _DE, _SPLITS, _BEST) + f"SELECT key, {_made} AS made FROM best WHERE {_when}")(lambda spark, d, rule="C0" if _id == "concat" else _id.upper(): _composed(spark, d, rule))

_LINKERS = "(VALUES " + ", ".join(f"('{x}')" for x in compose.GERMAN_LINKERS) + ") AS lk(linker)"


@query(
    "linker_candidates",
    _with(_TOK, _LEX, _DE)
    + f'SELECT key, "left", linker, "right", r::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY length("left") DESC, "left", linker, "right") AS r FROM (SELECT k.key, left(k.key, i - 1) AS "left", linker, substr(k.key, i + length(linker)) AS "right" FROM ke k, {_LINKERS}, unnest(range(2, length(k.key) + 1)) AS u(i) WHERE substr(k.key, i, length(linker)) = linker) c WHERE "left" IN (SELECT key FROM ke) AND "right" IN (SELECT key FROM ke)) WHERE r <= 32',
)
def linker_candidates(spark, d):
    t = D.lex(spark, d, "de")
    return compose.linker_candidates(t, t)


@query("topk_segmentation")
def topk_segmentation(spark, d):
    t = D.lex(spark, d, "es")
    return compose.segmentations(t, t, 3, 4).select("key", "place", _join("components"), "limited")


@query("scored_segmentation")
def scored_segmentation(spark, d):
    t = D.lex(spark, d, "es")
    return compose.segmentations(t, t, 4, 1, scored=True).select("key", _join("components"))


@query(
    "three_part_segmentation",
    _with(_TOK, "ke AS (SELECT w AS key FROM tok WHERE lang = 'es')")
    + "SELECT DISTINCT k.key, a.key || '|' || b.key || '|' || c.key AS components FROM ke k, unnest(range(1, length(k.key) - 1)) AS u(i), unnest(range(i + 1, length(k.key))) AS v(j) JOIN ke a ON a.key = left(k.key, i) JOIN ke b ON b.key = substr(k.key, i + 1, j - i) JOIN ke c ON c.key = substr(k.key, j + 1)",
)
def three_part_segmentation(spark, d):
    """Every split into three stored keys, by segmenting to a depth that keeps them all."""
    t = D.lex(spark, d, "es")
    return compose.segmentations(t, t, 3, 100_000).where(F.size("components") == 3).select("key", _join("components"))


# Reduction ---------------------------------------------------------------------------------------------------

_TWO = reduction.ReductionConfig(max_components=2)


def _greedy_sql(levels: int = 40, made: str = f"CASE WHEN contains(rp, 'ˈ') THEN lp || {_dem('rp')} ELSE lp || rp END") -> tuple[str, str]:
    """The greedy reduction written out, a step a key length; made is what a rule makes of two parts."""
    parts = [_TOK, _LEX, "ke AS MATERIALIZED (SELECT key, pron, length(key) AS n FROM lex WHERE lang = 'de')"]
    parts.append("sp AS MATERIALIZED (SELECT k.key, k.n, i, a.key AS l, b.key AS r, a.pron AS lp, b.pron AS rp, k.pron FROM ke k, unnest(range(1, length(k.key))) AS u(i) JOIN ke a ON a.key = left(k.key, i) JOIN ke b ON b.key = substr(k.key, i + 1))")
    parts.append("d1 AS MATERIALIZED (SELECT key, NULL::VARCHAR AS made, true AS lit FROM ke WHERE n = 1)")
    for n in range(2, levels + 1):
        cand = f"SELECT key, arg_max({made}, i) AS made FROM sp WHERE n = {n} AND l IN (SELECT key FROM d{n - 1} WHERE lit) AND r IN (SELECT key FROM d{n - 1} WHERE lit) GROUP BY key"
        parts.append(f"d{n} AS MATERIALIZED (SELECT * FROM d{n - 1} UNION ALL SELECT k.key, c.made, coalesce(c.made <> k.pron, true) FROM ke k LEFT JOIN ({cand}) c USING (key) WHERE k.n = {n})")
    return _with(*parts), f"d{levels}"


_GREEDY, _LAST = _greedy_sql()


def _decisions(spark, d):
    return reduction.greedy_basis(D.lex(spark, d, "de").select("key", "variants"), _TWO)


@query("greedy_basis_summary", _GREEDY + f"SELECT count(*) AS baseline_words, count(*) FILTER (lit) AS literal_words, count(*) FILTER (NOT lit) AS generated_words, round(count(*) FILTER (NOT lit) / count(*), 6) AS reduction_rate FROM {_LAST}")
def greedy_basis_summary(spark, d):
    return reduction.summary(_decisions(spark, d))


@query("greedy_basis_literals", _GREEDY + f"SELECT key FROM {_LAST} WHERE lit")
def greedy_basis_literals(spark, d):
    return _decisions(spark, d).where("literal").select("key")


@query("failure_reasons", _GREEDY + f"SELECT CASE WHEN made IS NULL THEN 'no-composition' ELSE 'pronunciation-mismatch' END AS reason, count(*) AS words FROM {_LAST} WHERE lit GROUP BY 1")
def failure_reasons(spark, d):
    return reduction.failure_reasons(_decisions(spark, d))


@query("reconstruct_lookup", _with(_WORDS) .replace("WITH ", _GREEDY.rstrip() + ", ", 1) + f"SELECT w.key, CASE WHEN x.key IS NULL THEN 'miss' WHEN x.lit THEN 'literal' ELSE 'generated' END AS outcome, coalesce(k.pron, '') AS pron FROM words w LEFT JOIN {_LAST} x ON w.key = x.key LEFT JOIN ke k ON w.key = k.key")
def reconstruct_lookup(spark, d):
    return reduction.reconstruct_lookup(D.lex_words(spark, d).select("key"), _decisions(spark, d)).select("key", "outcome", F.coalesce(F.array_join("variants", "|"), F.lit("")).alias("pron"))


@query("rule_usage", _GREEDY + f"SELECT CASE WHEN contains(rp, 'ˈ') THEN 'C1' ELSE 'C0' END AS rule_id, count(*) AS usage, count(*) FILTER (NOT lit) AS exact, count(*) FILTER (lit) AS mismatch FROM (SELECT x.key, any_value(x.lit) AS lit, arg_max(sp.rp, sp.i) AS rp FROM {_LAST} x JOIN sp ON sp.key = x.key WHERE sp.l IN (SELECT key FROM {_LAST} WHERE lit) AND sp.r IN (SELECT key FROM {_LAST} WHERE lit) GROUP BY x.key) GROUP BY 1")
def rule_usage(spark, d):
    return reduction.rule_usage(_decisions(spark, d))


@query("verify_candidate", "SELECT 0::BIGINT AS missing, 0::BIGINT AS extra, 0::BIGINT AS pronunciation_mismatch, 0::BIGINT AS variant_order_mismatch, 0::BIGINT AS false_hits")
def verify_candidate(spark, d):
    t = D.lex(spark, d, "de").select("key", "variants")
    return reduction.verify_candidate(_decisions(spark, d), t, L.adversarial_misses(t))


@query("adversarial_misses")
def adversarial_misses(spark, d):
    return L.adversarial_misses(D.lex(spark, d, "de"))


@query(
    "promotion_candidates",
    _GREEDY + f"SELECT s.key, count(*) AS score FROM (SELECT substr(f.key, i, j) AS key FROM (SELECT key FROM {_LAST} WHERE lit) f, unnest(range(1, length(f.key) + 1)) AS u(i), unnest(range(1, length(f.key) - i + 2)) AS v(j)) s JOIN (SELECT key FROM {_LAST} WHERE NOT lit) g ON s.key = g.key GROUP BY s.key ORDER BY score DESC, s.key LIMIT 64",
)
def promotion_candidates(spark, d):
    return reduction.promotion_candidates(_decisions(spark, d))


@query("full_reduction")
def full_reduction(spark, d):
    """Segmentations of up to four parts and linking elements too."""
    config = reduction.ReductionConfig(linkers=compose.GERMAN_LINKERS)
    return reduction.summary(reduction.greedy_basis(D.lex(spark, d, "es").select("key", "variants"), config))


@query("recursive_resolution")
def recursive_resolution(spark, d):
    config = reduction.ReductionConfig(max_components=3, recursive=True)
    return reduction.summary(reduction.greedy_basis(D.lex(spark, d, "es").select("key", "variants"), config))


@query("alternate_rules")
def alternate_rules(spark, d):
    return reduction.alternate_rules(_decisions(spark, d)).groupBy("rule_id").agg(F.count("*").alias("tried"), F.count_if("exact").alias("exact"))


# Morphology, models, selectors -------------------------------------------------------------------------------

_ES = "ke AS (SELECT key, pron FROM lex WHERE lang = 'es')"


@query(
    "affix_mining",
    _with(_TOK, _LEX, _ES)
    + "SELECT kind, affix, stem_pron, word_pron, count(*) AS support FROM (SELECT 'suffix' AS kind, substr(w.key, i + 1) AS affix, s.pron AS stem_pron, w.pron AS word_pron FROM ke w, unnest(range(1, length(w.key))) AS u(i) JOIN ke s ON s.key = left(w.key, i) UNION ALL SELECT 'prefix', left(w.key, i), s.pron, w.pron FROM ke w, unnest(range(1, length(w.key))) AS u(i) JOIN ke s ON s.key = substr(w.key, i + 1)) GROUP BY ALL HAVING count(*) >= 2",
)
def affix_mining(spark, d):
    return models.mine_affixes(D.lex(spark, d, "es")).select("kind", "affix", "stem_pron", "word_pron", "support")


@query(
    "affix_apply",
    _with(_TOK, _LEX, _ES) + "SELECT w.key, r.affix, s.pron || r.added AS pron FROM ke w, (VALUES ('ado', 'ado'), ('mente', 'mente'), ('es', 'es')) AS r(affix, added) JOIN ke s ON s.key = left(w.key, length(w.key) - length(r.affix)) WHERE ends_with(w.key, r.affix) AND length(w.key) > length(r.affix)",
)
def affix_apply(spark, d):
    t = D.lex(spark, d, "es")
    rules = spark.createDataFrame([(i, "suffix", x, x) for i, x in enumerate(("ado", "mente", "es"))], "rule_id int, kind string, affix string, added string")
    return models.apply_affixes(t, t, rules).select("key", "affix", F.array_join("pronunciation", "|").alias("pron"))


@query("rewrite_apply", _with(_TOK, _LEX, _ES) + "SELECT key, 'ˈ' AS pattern, replace(pron, 'ˈ', 'ˌ') AS pron FROM ke WHERE contains(pron, 'ˈ') UNION ALL SELECT key, 'ˌ', replace(pron, 'ˌ', '') FROM ke WHERE contains(pron, 'ˌ')")
def rewrite_apply(spark, d):
    rules = spark.createDataFrame([(0, "replace", "", "", "ˈ", "ˌ"), (1, "delete", "", "", "ˌ", "")], "rule_id int, operation string, spelling_left string, pronunciation_left string, pattern string, replacement string")
    c = D.lex(spark, d, "es").select("key", F.element_at("variants", 1).alias("pronunciation"))
    return models.apply_rewrites(c, rules).select("key", "pattern", F.col("rewritten").alias("pron"))


_AFFIXES = [(0, "ción", "", "", "", "lower", "k", "", "", ""), (1, "", "mente", "a", "", "", "", "mente", "", ""), (2, "ción", "ll", "", "", "", "k", "j", "", "o"), (3, "", "ar", "", "o", "initial-upper", "", "ar", "ˈ", "")]
_REWRITES = [(0, "replace", "a", "o", "", "", "ˈ", "ˌ", None), (1, "delete", "", "", "", "s", "ˌ", "", "even"), (2, "insert", "", "z", "a", "", "r", "r", "odd")]


@query(
    "affix_contexts",
    _with(_TOK, _LEX, _ES)
    + "SELECT w.key, r.id AS rule_id, s.key AS stem, pp || CASE WHEN rs <> '' AND ends_with(CASE WHEN rp <> '' AND starts_with(s.pron, rp) THEN substr(s.pron, length(rp) + 1) ELSE s.pron END, rs) THEN left(CASE WHEN rp <> '' AND starts_with(s.pron, rp) THEN substr(s.pron, length(rp) + 1) ELSE s.pron END, length(CASE WHEN rp <> '' AND starts_with(s.pron, rp) THEN substr(s.pron, length(rp) + 1) ELSE s.pron END) - length(rs)) WHEN rp <> '' AND starts_with(s.pron, rp) THEN substr(s.pron, length(rp) + 1) ELSE s.pron END || ps AS pron FROM ke w, (VALUES "
    + ", ".join("(" + ", ".join(map(repr, r)) + ")" for r in _AFFIXES)
    + ") AS r(id, pre, suf, lc, rc, cap, pp, ps, rp, rs) JOIN ke s ON s.key = substr(w.key, length(pre) + 1, length(w.key) - length(pre) - length(suf)) WHERE starts_with(w.key, pre) AND ends_with(w.key, suf) AND length(w.key) > length(pre) + length(suf) AND starts_with(s.key, lc) AND ends_with(s.key, rc) AND (cap = '' OR cap = CASE WHEN w.key = upper(w.key) AND w.key <> lower(w.key) THEN 'upper' WHEN left(w.key, 1) = upper(left(w.key, 1)) AND left(w.key, 1) <> lower(left(w.key, 1)) THEN 'initial-upper' WHEN w.key = lower(w.key) AND w.key <> upper(w.key) THEN 'lower' ELSE 'mixed' END)",
)
def affix_contexts(spark, d):
    t = D.lex(spark, d, "es")
    names = ("strip_prefix", "strip_suffix", "required_left_context", "required_right_context", "capitalization_class", "pronunciation_prefix_add", "pronunciation_suffix_add", "pronunciation_prefix_remove", "pronunciation_suffix_remove")
    rules = spark.createDataFrame(_AFFIXES, "rule_id int, " + ", ".join(f"{c} string" for c in names))
    return models.apply_affixes(t, t, rules).select("key", "rule_id", "stem", F.array_join("pronunciation", "|").alias("pron"))


@query(
    "rewrite_contexts",
    _with(_TOK, _LEX, _ES)
    + "SELECT key, id AS rule_id, left(pron, strpos(pron, pat) - 1) || CASE op WHEN 'insert' THEN pat || new WHEN 'delete' THEN '' ELSE new END || substr(pron, strpos(pron, pat) + length(pat)) AS pron FROM ke, (VALUES "
    + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in _REWRITES)
    + ") AS r(id, op, sl, sr, pl, pr, pat, new, stage) WHERE contains(key, sl) AND contains(key, sr) AND contains(pron, pl) AND contains(pron, pr) AND contains(pron, pat) AND (stage IS NULL OR stage = CASE WHEN length(key) % 2 = 0 THEN 'even' ELSE 'odd' END)",
)
def rewrite_contexts(spark, d):
    rules = spark.createDataFrame(_REWRITES, "rule_id int, operation string, spelling_left string, spelling_right string, pronunciation_left string, pronunciation_right string, pattern string, replacement string, source_stage string")
    stage = F.when(F.char_length("key") % 2 == 0, "even").otherwise("odd")
    c = D.lex(spark, d, "es").select("key", F.element_at("variants", 1).alias("pronunciation"), stage.alias("stage"))
    return models.apply_rewrites(c, rules).select("key", "rule_id", F.col("rewritten").alias("pron"))


_CHARS = "pairs AS (SELECT key, lower(pron) AS p FROM lex WHERE lang = 'de' AND length(key) = length(pron)), ch AS (SELECT substr(key, i, 1) AS c, substr(p, i, 1) AS o FROM pairs, unnest(range(1, length(key) + 1)) AS u(i)), cnt AS (SELECT c, o, count(*) AS n FROM ch GROUP BY c, o), best AS (SELECT c, arg_max(o, (n, o)) AS o FROM cnt GROUP BY c)"


@query("char_majority_train", _with(_TOK, _LEX, _CHARS.replace("arg_max(o, (n, o))", "first(o ORDER BY n DESC, o)")) + 'SELECT c AS "character", o AS output FROM best')
def char_majority_train(spark, d):
    return models.train_characters(D.lex(spark, d, "de")).select("character", "output")


@query(
    "char_majority_predict",
    _with(_TOK, _LEX, _CHARS.replace("arg_max(o, (n, o))", "first(o ORDER BY n DESC, o)")) + "SELECT key, string_agg(coalesce(o, ''), '' ORDER BY i) AS output FROM (SELECT key, i, substr(key, i, 1) AS c FROM lex, unnest(range(1, length(key) + 1)) AS u(i) WHERE lang = 'es') t LEFT JOIN best USING (c) GROUP BY key",
)
def char_majority_predict(spark, d):
    return models.predict_characters(D.lex(spark, d, "es").select("key"), models.train_characters(D.lex(spark, d, "de")), "")


@query("cart_predict")
def cart_predict(spark, d):
    t = D.lex(spark, d, "es")
    return models.predict_cart(t.select("key"), models.train_cart(t))


@query("graphone_predict")
def graphone_predict(spark, d):
    t = D.lex(spark, d, "es")
    return models.predict_graphone(t.select("key"), models.train_graphone(t))


@query("alignment")
def alignment(spark, d):
    return models.alignments(D.lex(spark, d, "es")).select("key", "pos", "grapheme", "chunk")


@query(
    "selector_pure_predicates",
    "WITH f AS (SELECT 'brand' AS feature, p_brand AS value, CASE WHEN p_size > 25 THEN 'C1' ELSE 'C0' END AS target FROM part UNION ALL SELECT 'size', p_size::VARCHAR, CASE WHEN p_size > 25 THEN 'C1' ELSE 'C0' END FROM part) SELECT feature, value, max(target) AS rule_id, count(*) AS support FROM f GROUP BY feature, value HAVING count(DISTINCT target) = 1 AND count(*) >= 2 ORDER BY support DESC, feature, value LIMIT 64",
)
def selector_pure_predicates(spark, d):
    t = D.table(spark, d, "part")
    target = F.when(F.col("p_size") > 25, "C1").otherwise("C0").alias("target")
    rows = t.select(F.lit("brand").alias("feature"), F.col("p_brand").alias("value"), target).union(t.select(F.lit("size"), F.col("p_size").cast("string"), target))
    return models.pure_predicates(rows, 2)


_CAND = "c AS (SELECT l_orderkey AS id, CASE l_linenumber % 3 WHEN 0 THEN 'cart' WHEN 1 THEN 'graphone' ELSE 'rewrite' END AS stage, l_returnflag || l_linenumber AS rule, l_linenumber AS score FROM lineitem)"


def _candidates(spark, d):
    t = D.table(spark, d, "lineitem")
    k = F.col("l_linenumber") % 3
    stage = F.when(k == 0, "cart").when(k == 1, "graphone").otherwise("rewrite")
    return t.select(F.col("l_orderkey").alias("id"), stage.alias("stage"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("rule"), F.col("l_linenumber").alias("score"))


@query("priority_selector", "WITH " + _CAND + " SELECT id, stage, rule FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE stage WHEN 'graphone' THEN 1 WHEN 'cart' THEN 2 ELSE 999 END, stage, rule, score) AS r FROM c) WHERE r = 1")
def priority_selector(spark, d):
    return models.choose_by_priority(_candidates(spark, d), ("graphone", "cart")).select("id", "stage", "rule")


@query("score_selector", "WITH " + _CAND + " SELECT id, stage, rule FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE stage WHEN 'graphone' THEN 5 WHEN 'cart' THEN 3 ELSE 0 END DESC, score DESC, rule DESC, stage DESC) AS r FROM c) WHERE r = 1")
def score_selector(spark, d):
    return models.choose_by_score(_candidates(spark, d), {"graphone": 5, "cart": 3}).select("id", "stage", "rule")


@query(
    "tree_selector",
    "WITH " + _CAND + ", o AS (SELECT o_orderkey AS id, o_orderstatus AS s FROM orders) SELECT id, stage, rule FROM (SELECT c.*, row_number() OVER (PARTITION BY c.id ORDER BY CASE WHEN s = 'F' AND stage = 'rewrite' THEN 0 WHEN s = 'O' AND stage = 'cart' THEN 1 ELSE 9 END, CASE stage WHEN 'graphone' THEN 1 WHEN 'cart' THEN 2 ELSE 999 END, stage, rule, score) AS r FROM c JOIN o ON c.id = o.id) WHERE r = 1",
)
def tree_selector(spark, d):
    features = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("status").alias("feature"), F.col("o_orderstatus").alias("value"))
    return models.choose_by_tree(_candidates(spark, d), features, [("status", "F", "rewrite"), ("status", "O", "cart")], ("graphone", "cart")).select("id", "stage", "rule")


@query("forest_selector")
def forest_selector(spark, d):
    features = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("status").alias("feature"), F.col("o_orderstatus").alias("value"))
    trees = [[("status", "F", "rewrite")], [("status", "O", "cart")], [("status", "F", "rewrite"), ("status", "P", "graphone")]]
    return models.choose_by_forest(_candidates(spark, d), features, trees, ("graphone", "cart")).select("id", "stage", "rule")


@query("hashed_logistic")
def hashed_logistic(spark, d):
    t = D.table(spark, d, "orders")
    f = t.select(F.col("o_orderkey").alias("id"), F.lit("status").alias("feature"), F.col("o_orderstatus").alias("value"), F.when(F.col("o_orderpriority").startswith("1"), "cart").otherwise("graphone").alias("target"))
    return models.choose_by_logistic(_candidates(spark, d), f, models.train_logistic(f)).select("id", "stage", "rule")


@query("failure_families")
def failure_families(spark, d):
    wrong = _decisions(spark, d).where("reason = 'pronunciation-mismatch'").select("key", "components", F.element_at("candidate", 1).alias("candidate"), F.element_at("variants", 1).alias("expected"))
    return models.failure_families(wrong, D.lex(spark, d, "de"), 2)


@query("composition_features")
def composition_features(spark, d):
    t = D.lex(spark, d, "de")
    return models.composition_features(compose.best_two_part(t, t), t)


# Programs and diagnostics ------------------------------------------------------------------------------------

_SHORT = 7  # the literals of these queries are the keys of at most as many letters
_GERMAN = "ke AS MATERIALIZED (SELECT key, pron FROM lex WHERE lang = 'de'), lits AS (SELECT * FROM ke WHERE length(key) <= 7)"
_PAIRS = "sp AS (SELECT k.key, k.pron, i, a.key AS l, a.pron AS lp, b.pron AS rp FROM ke k, unnest(range(1, length(k.key))) AS u(i) JOIN lits a ON a.key = left(k.key, i) JOIN lits b ON b.key = substr(k.key, i + 1) WHERE length(k.key) > 7)"
_COMPOUND = f"comp AS (SELECT key, arg_max(CASE WHEN contains(rp, 'ˈ') THEN lp || {_dem('rp')} ELSE lp || rp END, i) AS made, arg_max(CASE WHEN contains(rp, 'ˈ') THEN 'C1' ELSE 'C0' END, i) AS rule FROM sp GROUP BY key)"
_ENDINGS = [(1, "suffix", "en", "ən"), (2, "suffix", "er", "ɐ"), (3, "prefix", "ge", "gə"), (4, "suffix", "n", "n")]
_AFFIXED = "aff AS (SELECT w.key, arg_min(CASE WHEN kind = 'suffix' THEN s.pron || added ELSE added || s.pron END, id) AS made, min(id)::VARCHAR AS rule FROM ke w, (VALUES " + ", ".join(map(str, _ENDINGS)) + ") AS r(id, kind, affix, added) JOIN lits s ON s.key = CASE WHEN kind = 'suffix' THEN left(w.key, length(w.key) - length(affix)) ELSE substr(w.key, length(affix) + 1) END WHERE length(w.key) > 7 AND CASE WHEN kind = 'suffix' THEN ends_with(w.key, affix) ELSE starts_with(w.key, affix) END GROUP BY w.key)"


def _program(spark, d, selector=None):
    t = D.lex(spark, d, "de").select("key", "variants")
    rules = spark.createDataFrame(_ENDINGS, "rule_id int, kind string, affix string, added string")
    stages = (("affix", program.affixes(rules)), ("compound", program.compound(_TWO)))
    return program.Program(stages, selector), t, t.where(F.char_length("key") <= _SHORT)


@query("program_first", _with(_TOK, _LEX, _GERMAN, _PAIRS, _COMPOUND, _AFFIXED) + "SELECT key, CASE WHEN a.key IS NOT NULL THEN 'affix' ELSE 'compound' END AS stage, CASE WHEN a.key IS NOT NULL THEN a.rule ELSE c.rule END AS rule, coalesce(a.made, c.made) AS pron FROM aff a FULL JOIN comp c USING (key)")
def program_first(spark, d):
    """Without a selector the first stage's proposal stands."""
    p, t, literals = _program(spark, d)
    return program.reconstruct(p, t.join(literals, "key", "left_anti"), literals).select("key", "stage", "rule", F.array_join("pronunciation", "|").alias("pron"))


@query("program_lookup", _with(_TOK, _LEX, _WORDS, _GERMAN, _PAIRS, _COMPOUND, _AFFIXED) + "SELECT w.key, CASE WHEN k.key IS NULL THEN 'miss' WHEN length(w.key) <= 7 THEN 'literal' WHEN coalesce(c.made, a.made) IS NOT NULL THEN 'generated' ELSE 'unresolved' END AS outcome, coalesce(CASE WHEN length(w.key) <= 7 THEN k.pron ELSE coalesce(c.made, a.made) END, '') AS pron FROM (SELECT key FROM words UNION SELECT key FROM ke) w LEFT JOIN ke k ON w.key = k.key LEFT JOIN comp c ON w.key = c.key LEFT JOIN aff a ON w.key = a.key")
def program_lookup(spark, d):
    """A selector that prefers compounds, asked for all members and for words that may be none."""
    p, t, literals = _program(spark, d, lambda c, f: models.choose_by_priority(c, ("compound", "affix")))
    asked = D.lex_words(spark, d).select("key").union(t.select("key")).distinct()
    return program.lookup(p, asked, literals, t).select("key", "outcome", F.coalesce(F.array_join("variants", "|"), F.lit("")).alias("pron"))


_OPEN = f"""op AS (SELECT key, "left", linker, "right", r, pron = lp || rp OR (contains(rp, 'ˈ') AND pron = lp || {_dem('rp')}) AS exact FROM (SELECT c.*, CASE WHEN "left" = linker THEN '' ELSE a.pron END AS lp, CASE WHEN "right" = linker THEN '' ELSE b.pron END AS rp, row_number() OVER (PARTITION BY c.key ORDER BY length("left") DESC, "left", linker, "right") AS r FROM (SELECT k.key, k.pron, left(k.key, i - 1) AS "left", linker, substr(k.key, i + length(linker)) AS "right" FROM ke k, {_LINKERS}, unnest(range(2, length(k.key) + 1)) AS u(i) WHERE length(k.key) > 7 AND substr(k.key, i, length(linker)) = linker) c JOIN lits a ON a.key = "left" JOIN lits b ON b.key = "right") WHERE r <= 32)"""


def _opportunities(spark, d):
    t = D.lex(spark, d, "de").select("key", "variants")
    return diagnostics.linker_opportunities(t, t.where(F.char_length("key") <= _SHORT))


@query("linker_diagnostics", _with(_TOK, _LEX, _GERMAN, _OPEN) + "SELECT linker, count(*) FILTER (exact) AS exact_count, count(*) FILTER (NOT exact) AS mismatch_count FROM op LEFT JOIN (SELECT key, min(r) AS f FROM op WHERE exact GROUP BY key) USING (key) WHERE f IS NULL OR r <= f GROUP BY linker")
def linker_diagnostics(spark, d):
    return diagnostics.linker_counts(_opportunities(spark, d))


@query("linker_totals", _with(_TOK, _LEX, _GERMAN, _OPEN) + "SELECT count(DISTINCT key) AS words_newly_segmentable, count(DISTINCT key) FILTER (exact) AS words_newly_exact FROM op")
def linker_totals(spark, d):
    return diagnostics.linker_totals(_opportunities(spark, d))


_RANKED = f"rk AS (SELECT key, pron = lp || rp OR (contains(rp, 'ˈ') AND pron = lp || {_dem('rp')}) AS exact, row_number() OVER (PARTITION BY key ORDER BY i DESC) AS r FROM sp), er AS (SELECT k.key, min(r) FILTER (exact AND r <= 4) AS exact_rank FROM ke k LEFT JOIN rk USING (key) WHERE length(k.key) > 7 GROUP BY k.key)"


def _ranks(spark, d):
    t = D.lex(spark, d, "de").select("key", "variants")
    return diagnostics.exact_ranks(t.where(F.char_length("key") > _SHORT), t.where(F.char_length("key") <= _SHORT), 4, 2)


@query("exact_ranks", _with(_TOK, _LEX, _GERMAN, _PAIRS, _RANKED) + "SELECT key, exact_rank FROM er")
def exact_ranks(spark, d):
    return _ranks(spark, d)


@query("exact_rank_summary", _with(_TOK, _LEX, _GERMAN, _PAIRS, _RANKED) + "SELECT count(*) FILTER (exact_rank = 1) AS exact_on_rank_1, count(*) FILTER (exact_rank > 1) AS exact_on_rank_2_to_k, count(*) FILTER (exact_rank IS NULL) AS not_exact_in_top_k FROM er")
def exact_rank_summary(spark, d):
    return diagnostics.rank_summary(_ranks(spark, d))


@query("rule_verdicts")
def rule_verdicts(spark, d):
    decisions = _decisions(spark, d)
    return diagnostics.rule_verdicts(reduction.alternate_rules(decisions), decisions)


_CASE = "SELECT {0!r} AS \"case\", count(*) AS baseline_words, count(*) FILTER (lit) AS literal_words, count(*) FILTER (NOT lit) AS generated_words, 0::BIGINT AS missing, count(*) FILTER (NOT lit AND made <> pron) AS pronunciation_mismatch, count(*) FILTER (NOT lit AND made <> pron) = 0 AS lossless FROM {1} JOIN ke USING (key)"
_PLAIN, _PLAIN_LAST = _greedy_sql(made="lp || rp")


@query("case_runs", f"SELECT * FROM ({_GREEDY}{_CASE.format('stressed', _LAST)}) UNION ALL SELECT * FROM ({_PLAIN}{_CASE.format('plain', _PLAIN_LAST)})")
def case_runs(spark, d):
    """Two configured reductions, one inheriting from the other, run and verified."""
    resolved = cases.resolve({"stressed": {"max_components": 2}, "plain": {"inherits": "stressed", "profile": "generic"}})
    rows = cases.run_cases(D.lex(spark, d, "de").select("key", "variants"), resolved)
    return rows.select("case", "baseline_words", "literal_words", "generated_words", "missing", "pronunciation_mismatch", "lossless")


# Harness -----------------------------------------------------------------------------------------------------


@query("pareto_front", "SELECT p_partkey FROM part x WHERE NOT EXISTS (SELECT 1 FROM part y WHERE y.p_size <= x.p_size AND y.p_retailprice <= x.p_retailprice AND (y.p_size < x.p_size OR y.p_retailprice < x.p_retailprice))")
def pareto_front(spark, d):
    return harness.pareto(D.table(spark, d, "part"), ("p_size", "p_retailprice")).select("p_partkey")


@query("percentile_nearest_rank", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def percentile_nearest_rank(spark, d):
    return harness.nearest_rank(D.table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("percentile_inclusive", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(median(value), 6) AS median FROM events GROUP BY event_type")
def percentile_inclusive(spark, d):
    return harness.inclusive(D.table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query(
    "stratified_sample",
    _with(_TOK, "t AS (SELECT DISTINCT w AS key, least(length(w) // 4, 12) AS b FROM tok WHERE lang = 'de')", "g AS (SELECT key, b, row_number() OVER (PARTITION BY b ORDER BY key) - 1 AS i, count(*) OVER (PARTITION BY b) AS n, count(*) OVER () AS total FROM t)", "k AS (SELECT DISTINCT b, n, greatest(1, round_even(1000 * n / total, 0))::BIGINT AS take FROM g)", "picks AS (SELECT DISTINCT b, CASE WHEN take >= n THEN j ELSE least(n - 1, floor(j * (n::DOUBLE / take))::BIGINT) END AS i FROM k, unnest(range(0, least(take, n))) AS u(j))")
    + "SELECT key FROM g JOIN picks USING (b, i)",
)
def stratified_sample(spark, d):
    return harness.stratified(D.lex(spark, d, "de").select("key"), 1000)


@query("source_statistics", _with(_TOK) + "SELECT sum(n)::BIGINT AS physical_rows, count(DISTINCT lower(w)) AS logical_words, count(*) AS ordered_variants, sum(n)::BIGINT - count(*) AS duplicates_removed FROM (SELECT w, sum(n) AS n FROM tok WHERE lang = 'de' GROUP BY w)")
def source_statistics(spark, d):
    return harness.source_statistics(D.tok(spark, d).where("lang = 'de'"))


@query("compression_layers")
def compression_layers(spark, d):
    return harness.compression_layers(D.table(spark, d, "benchmark").select("text"))


@query("leaderboard", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size < 10 ORDER BY p_size, p_retailprice, p_partkey LIMIT 100")
def leaderboard(spark, d):
    return harness.leaderboard(D.table(spark, d, "part").where("p_size < 10"), ("p_size", "p_retailprice", "p_partkey"), 100).select("p_partkey", "p_size", "p_retailprice")


@query("export_jsonl", _with(_TOK, _FORMS) + """SELECT key, '{"word":"' || key || '","kind":"list","value":[' || array_to_string(list_transform(variants, lambda v: '"' || v || '"'), ',') || ']}' AS line FROM lv""")
def export_jsonl(spark, d):
    from lexweave.sources.export import jsonl_lines

    return jsonl_lines(D.lex_variants(spark, d)).select("key", "line")


@query("export_lxc_tsv", _with(_TAGGED) + """SELECT key, key || chr(9) || 'tagged' || chr(9) || role || chr(9) || '"' || pron || '"' AS line FROM tv""")
def export_lxc_tsv(spark, d):
    from lexweave.sources.export import lxc_tsv_lines

    return lxc_tsv_lines(D.lex_tagged(spark, d)).select("key", "line")


@query("stream_lookup")
def stream_lookup(spark, d):
    """An extension: the events stream joined to a static lexicon, read to its end."""
    from lexweave.streaming.lookup import stream_lookup as run

    return run(spark, f"{d}/events.parquet", D.lex(spark, d, "en"))
