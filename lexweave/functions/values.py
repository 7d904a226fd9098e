"""Value-level column functions: selection by tag, variants, canonical bytes, key transforms, classes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Letters that count as vowels when the last character of a pronunciation is classed.
PHONEME_VOWELS = "aeiouyäöüɑɛɪɔʊə"
GRAPHEME_VOWELS = "aeiouyäöü"
PRIMARY, SECONDARY = "ˈ", "ˌ"


def _selector(items: Column, tag: Column | str) -> Column:
    tag = F.lit(tag) if isinstance(tag, str) else tag
    return F.try_element_at(F.filter(items, lambda i: i["tag"] == tag), F.lit(1))


def select_tag(items: Column, tag: Column | str, default_tag: str = "DEFAULT") -> Column:
    """The selector for tag, else for default_tag, else null; presence decides, so an explicit null stops the search."""
    return F.coalesce(_selector(items, tag), _selector(items, default_tag))


def variants_of(kind: Column, variants: Column, items: Column, tag: Column | str = "DEFAULT", default_tag: str = "DEFAULT") -> Column:
    """Pronunciations of a value in order: none for words and misses, the selector's for tagged values."""
    none = F.array().cast("array<string>")
    return F.when(kind == "tagged", F.coalesce(select_tag(items, tag, default_tag)["values"], none)).when(kind.isin("scalar", "list"), F.coalesce(variants, none)).otherwise(none)


def first_of(variants: Column) -> Column:
    return F.try_element_at(variants, F.lit(1))


def all_strings(variants: Column, items: Column) -> Column:
    """Every string of a value of any kind, tags' values in the tags' order."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(variants, none), F.coalesce(F.flatten(F.transform(items, lambda i: F.coalesce(i["values"], none))), none))


def runtime_unique(variants: Column) -> Column:
    """Variants without repeats, at their first places."""
    return F.array_distinct(variants)


def _length_prefixed(text: Column) -> Column:
    raw = F.encode(text, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw)), 8, "0")), raw)


def _joined(parts: Column) -> Column:
    return F.aggregate(parts, F.unhex(F.lit("")), lambda a, b: F.concat(a, b))


def _count(array: Column) -> Column:
    return F.unhex(F.lpad(F.hex(F.size(array)), 8, "0"))


def canonical_bytes(key: Column, kind: Column, variants: Column, items: Column) -> Column:
    """A row's key and typed value as bytes: each string with its length before it, each shape with its own letter.

    Two rows have equal bytes exactly if key, kind and content (order, repeats and explicit nulls included) are equal.
    """
    strings = lambda a: F.concat(_count(a), _joined(F.transform(a, _length_prefixed)))
    selector = lambda i: F.concat(_length_prefixed(i["tag"]), F.encode(F.substring(i["sel_kind"], 1, 1), "UTF-8"), strings(i["values"]))
    body = (
        F.when(kind == "scalar", F.concat(F.encode(F.lit("S"), "UTF-8"), _length_prefixed(F.element_at(variants, 1))))
        .when(kind == "list", F.concat(F.encode(F.lit("L"), "UTF-8"), strings(variants)))
        .when(kind == "tagged", F.concat(F.encode(F.lit("T"), "UTF-8"), _count(items), _joined(F.transform(items, selector))))
        .otherwise(F.encode(F.lit("W"), "UTF-8"))
    )
    return F.concat(_length_prefixed(key), body)


def casefold(c: Column) -> Column:
    """Full Unicode case folding. Project it before a join or distinct count: Spark takes it as non-deterministic."""
    return F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))


def nfc(c: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))


def nfd(c: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), c, F.lit(False))


#: Key transforms by name; add more by passing a function from Column to Column.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {"exact": lambda c: c, "lower": F.lower, "casefold": casefold, "nfc": nfc, "nfd": nfd}


def capitalize(c: Column) -> Column:
    """First character upper, the rest lower. A first character whose upper case is several letters keeps one capital."""
    head = F.upper(F.substring(c, 1, 1))
    head = F.concat(F.substring(head, 1, 1), F.lower(F.substring(head, 2, 8)))
    return F.concat(head, F.lower(F.substring(c, F.lit(2), F.char_length(c))))


def demote_first(c: Column) -> Column:
    """The first primary stress mark made secondary."""
    return F.regexp_replace(c, f"^([^{PRIMARY}]*){PRIMARY}", f"$1{SECONDARY}")


def grapheme_class(c: Column) -> Column:
    head = F.substring(c, 1, 1)
    return F.when(F.char_length(c) == 0, "empty").when(head.rlike(r"^\p{Lu}"), "upper").when(head.rlike(r"^\p{Ll}"), "lower").when(head.rlike(r"^\p{Nd}"), "digit").otherwise("other")


def phoneme_class(c: Column) -> Column:
    tail = F.substring(c, -1, 1)
    return F.when(F.char_length(c) == 0, "empty").when(F.instr(F.lit(PHONEME_VOWELS), tail) > 0, "vowel").when(tail.isin(PRIMARY, SECONDARY), "stress").otherwise("other")


def capitalization_class(c: Column) -> Column:
    head = F.substring(c, 1, 1)
    upper = (c == F.upper(c)) & (c != F.lower(c))
    lower = (c == F.lower(c)) & (c != F.upper(c))
    initial = (head == F.upper(head)) & (head != F.lower(head))
    return F.when(upper, "upper").when(initial, "initial-upper").when(lower, "lower").otherwise("mixed")


def insert_at(c: Column, place: Column, text: str) -> Column:
    """text put in at a place counted from 1."""
    return F.concat(F.substring(c, F.lit(1), place - 1), F.lit(text), F.substring(c, place, F.char_length(c)))


def replace_first(c: Column, old: str, new: str) -> Column:
    """The first occurrence of old replaced; unchanged where there is none."""
    place = F.locate(old, c)
    return F.when(place > 0, F.overlay(c, F.lit(new), place, F.lit(len(old)))).otherwise(c)


def occurrences(c: Column, text: Column, first: int = 2) -> Column:
    """Places (from 1) at or after first where text stands, overlapping ones too."""
    n = F.char_length(c) - F.char_length(text) + 1
    places = F.when(n >= first, F.sequence(F.lit(first), n)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.substring(c, i, F.char_length(text)) == text)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))
