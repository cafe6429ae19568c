"""Column expressions on forms, features, labels and ids."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "∅"


def correct(gold: Column, pred: Column) -> Column:
    """Equal and known: a null on either side is not correct."""
    return F.coalesce(gold == pred, F.lit(False))


def wrong(gold: Column, pred: Column) -> Column:
    return ~correct(gold, pred)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Share in percent, rounded half to even; null for an empty whole."""
    return F.bround(F.when(whole != 0, 100.0 * part / whole), digits)


def feature(feats: Column, name: str) -> Column:
    """A feature's value, the first one if it is named twice, or the sign for a missing one."""
    return _value(feats, name, 1)


def last_feature(feats: Column, name: str) -> Column:
    """The same, but the last one if it is named twice, as ``parse_feats`` has it."""
    return _value(feats, name, -1)


def _value(feats: Column, name: str, which: int) -> Column:
    # what stands behind the name's first or last sign, up to the next part: strings only, as a split and a filter cost a token many times that
    text, sign = F.concat(F.lit("|"), feats), f"|{name}="
    behind = F.substring_index(text if which < 0 else F.substring_index(text, sign, 2), sign, -1)
    return F.when(F.contains(text, F.lit(sign)), F.substring_index(behind, "|", 1)).otherwise(F.lit(MISSING))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def parse_feats(feats: Column) -> Column:
    """array<struct<name, value>> by name; parts without a sign are dropped, the last of a name stays."""
    parts = F.filter(F.split(F.coalesce(feats, F.lit("")), "[|]"), lambda p: F.contains(p, F.lit("=")))
    pairs = F.sort_array(F.transform(parts, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("name"), i.alias("place"), F.substring(p, F.locate("=", p) + 1, F.length(p)).alias("value"))))
    # by name and place: the last of a name is followed by another name
    last = let(pairs, lambda x: F.filter(x, lambda p, i: ~F.get(x, i + 1)["name"].eqNullSafe(p["name"])))
    return F.transform(last, lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value")))


def feats_of_text(feats: str | None) -> list[tuple[str, str]]:
    """``parse_feats`` of one text."""
    return sorted(dict(p.split("=", 1) for p in (feats or "").split("|") if "=" in p).items())


def normal_feats(feats: Column) -> Column:
    """Trimmed parts sorted by key and value; bare keys stay, an underscore is nothing."""
    parts = F.filter(F.transform(F.split(F.coalesce(feats, F.lit("")), "[|]"), lambda p: F.trim(p)), lambda p: (p != "") & (p != "_"))
    keyed = F.transform(parts, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.when(F.contains(p, F.lit("=")), F.substring(p, F.locate("=", p) + 1, F.length(p))).otherwise(F.lit("")).alias("value"), p.alias("part")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["part"]), "|")


def only_features(feats: Column, names: list[str]) -> Column:
    return F.filter(parse_feats(feats), lambda p: p["name"].isin(*names))


def reflexive(lemma: Column) -> Column:
    return F.coalesce(F.lower(lemma).rlike("(ся|сь)$"), F.lit(False))


def is_ellipsis(misc: Column) -> Column:
    return F.coalesce(F.contains(misc, F.lit("Ellipsis=Yes")), F.lit(False))


def coarse(deprel: Column) -> Column:
    return F.substring_index(deprel, ":", 1)


def punct_by_tag(upos: Column) -> Column:
    return F.coalesce(upos == "PUNCT", F.lit(False))


def punct_by_tag_or_relation(upos: Column, deprel: Column) -> Column:
    return punct_by_tag(upos) | F.coalesce(coarse(deprel) == "punct", F.lit(False))


def punct_by_form(form: Column, upos: Column, feats: Column | None = None) -> Column:
    """Tagged punctuation and the multiplication sign; an x and Roman numerals are none."""
    bare = F.trim(F.coalesce(form, F.lit("")))
    roman = bare.rlike("^[IVXLCDMivxlcdm]+$")
    if feats is not None:
        roman = roman | F.coalesce(F.contains(feats, F.lit("NumForm=Roman")), F.lit(False))
    return F.when(F.lower(bare) == "x", False).when(bare == "×", True).when(roman, False).otherwise(F.coalesce(F.upper(upos) == "PUNCT", F.lit(False)))


def punct_but_signs(form: Column, upos: Column) -> Column:
    """Tagged punctuation that is no x and no multiplication sign."""
    return punct_by_tag(upos) & ~F.lower(F.coalesce(form, F.lit(""))).isin("x", "×")


#: Quotes and marks that a form loses before it is compared, quotes that it loses at its ends, and dashes.
STRIPPED, EDGE_QUOTES, DASHES = "\"'«»„“”‚’,…", "\"'«»„“”‚’‹›„‟", "-–—"


def bare_form(form: Column, dots: bool = True) -> Column:
    """Lower case without quotes, commas, ellipsis dots, white space and dashes; without full stops too unless ``dots``. Null is empty."""
    gone = STRIPPED + DASHES + ("" if dots else ".")
    return F.translate(F.regexp_replace(F.lower(F.coalesce(form, F.lit(""))), r"(?U)\s+", ""), gone, "")


def same_form(a: Column, b: Column) -> Column:
    """Equal bare forms, with or without full stops, or spelling twins. A missing form is an underscore; quotes at the ends do not count."""
    trimmed = lambda x: F.when(x.isNull() | (x == "_"), F.lit("_")).otherwise(F.trim(x, F.lit(EDGE_QUOTES)))
    x, y = trimmed(a), trimmed(b)
    x0, y0 = bare_form(x, dots=False), bare_form(y, dots=False)
    # fixed values: pairs that count as the same word, as they stand and without full stops
    twins, short = (("с", "со"), ("к", "ко")), (("е", "есть"), ("к", "как"))
    either = lambda p, q, pairs: reduce(lambda m, n: m | n, [((p == i) & (q == j)) | ((p == j) & (q == i)) for i, j in pairs])
    return either(x, y, twins) | either(x0, y0, short) | (x0 == y0) | (bare_form(x) == bare_form(y))


def words_lower(form: Column) -> Column:
    """Words of letters and digits in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(form, F.lit(""))), F.lit(r"([A-Za-zА-Яа-яЁё0-9]+)"), F.lit(1))


def is_glue(form: Column) -> Column:
    """A form of two words or more with a quote or comma in it."""
    return F.coalesce(form.rlike("[\"«»,]"), F.lit(False)) & (F.size(words_lower(form)) >= 2)


def word_bag(form: Column) -> Column:
    """Sorted words of letters and digits, for comparing glued tokens."""
    return F.array_sort(words_lower(form))


def ud_source(raw: Column) -> Column:
    """Source of ``<source>.xml_<n>``: what stands before the last ``.xml``."""
    return F.regexp_extract(raw, r"^(.*)\.xml", 1)


def ud_number(raw: Column) -> Column:
    return F.regexp_extract(raw, r"^.*\.xml_(.*)$", 1)


def stored_source(sent_id: Column) -> Column:
    """Source of ``<n>_<source>``."""
    return F.substring(sent_id, F.locate("_", sent_id) + 1, F.length(sent_id))


def split_of(name: Column) -> Column:
    low = F.lower(name)
    out = F.lit("unknown")
    for part in ("test", "dev", "train"):
        out = F.when(F.contains(low, F.lit(part)), F.lit(part)).otherwise(out)
    return out


def added(comments: Column) -> Column:
    return F.exists(comments, lambda c: F.contains(c, F.lit("# Added to SynTagRus")))


def lower_upper(a: Column, b: Column) -> tuple[Column, Column]:
    """The two ends of an undirected edge."""
    return F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")
