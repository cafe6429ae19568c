"""Grammar tags of the source annotation as features, and relations by rule."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

#: Which feature a tag is a value of.
GROUPS = {
    "Лицо": ("1-Л", "2-Л", "3-Л"),
    "Число": ("ЕД", "МН"),
    "Род": ("МУЖ", "ЖЕН", "СРЕД"),
    "Падеж": ("ИМ", "РОД", "ПАРТ", "ДАТ", "ВИН", "ТВОР", "ПР", "МЕСТН", "ЗВ"),
    "Одуш": ("ОД", "НЕОД"),
    "Вид": ("СОВ", "НЕСОВ"),
    "Время": ("НАСТ", "ПРОШ", "НЕПРОШ"),
    "Накл": ("ИЗЪЯВ", "ПОВ"),
    "Репр": ("ИНФ", "ПРИЧ", "ДЕЕПР"),
    "Крат": ("КР",),
    "СтепСравн": ("СРАВ", "ПРЕВ"),
    "Залог": ("СТРАД",),
}
#: Tags that say yes to a feature, and tags that go to misc.
YES = {"СЛ": "Словослож", "СМЯГ": "Смягч"}
MISC = {"НЕСТАНД": "Нестандарт", "НЕПРАВ": "Неправ", "МЕТА": "Мета"}
#: The other annotation's name of a feature.
UD_NAMES = {"Одуш": "Animacy", "Род": "Gender", "Число": "Number", "Падеж": "Case", "Вид": "Aspect", "Время": "Tense", "Залог": "Voice", "Крат": "Variant", "Лицо": "Person", "Накл": "Mood", "Репр": "VerbForm", "СтепСравн": "Degree"}

TAGS = {tag: (name, tag) for name, tags in GROUPS.items() for tag in tags} | {tag: (name, "Да") for tag, name in YES.items()}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def parse(raw: Column) -> Column:
    """struct<upos, feats, misc> of a tag string ``POS TAG|TAG ...``; feats and misc are null without any.

    A part of speech NID takes a Latin word behind it along. Values of a feature and items of misc are sorted; unknown tags
    are dropped, and are listed in misc if there is nothing else.
    """
    parts = F.filter(F.split(F.coalesce(raw, F.lit("")), r"[|\s]+"), lambda x: x != "")
    return let(parts, _of_parts)


def parse_text(raw: str | None) -> tuple[str, str | None, str | None]:
    """(upos, feats, misc): ``parse`` of one text."""
    parts = [x for x in re.split(r"[|\s]+", raw or "", flags=re.ASCII) if x]
    joined = len(parts) > 1 and parts[0].upper().startswith("NID") and re.fullmatch("[A-Za-z]+", parts[1]) is not None
    rest = parts[2 if joined else 1 :]
    known: dict[str, set[str]] = {}
    for name, value in (TAGS[t] for t in rest if t in TAGS):
        known.setdefault(name, set()).add(value)
    items = sorted({f"{MISC[t]}=Да" for t in rest if t in MISC})
    feats = "|".join(f"{n}={','.join(sorted(v))}" for n, v in known.items())
    misc = "|".join(items) if items or known or not rest else f"StrGram={','.join(rest)}"
    return "+".join(parts[:2]) if joined else parts[0] if parts else "_", feats or None, misc or None


def _of_parts(parts: Column) -> Column:
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    joined = F.coalesce(F.startswith(F.upper(first), F.lit("NID")) & second.rlike("^[A-Za-z]+$"), F.lit(False))
    rest = F.slice(parts, F.when(joined, 3).otherwise(2), F.greatest(F.size(parts), F.lit(1)))
    upos = F.when(first.isNull(), "_").when(joined, F.concat_ws("+", first, second)).otherwise(first)
    misc = _map(MISC)
    # each step is bound, as what an expression names twice is computed twice
    named = lambda r: F.filter(F.transform(r, _known), lambda x: x["name"].isNotNull())
    items = lambda r: F.array_sort(F.array_distinct(F.transform(F.filter(r, lambda t: misc[t].isNotNull()), lambda t: F.concat(misc[t], F.lit("=Да")))))
    return let(rest, lambda r: let(named(r), lambda known: let(items(r), lambda i: F.struct(upos.alias("upos"), F.nullif(_listed(known), F.lit("")).alias("feats"), _said(r, known, i).alias("misc")))))


def _known(tag: Column) -> Column:
    name, value = _map({t: n for t, (n, _) in TAGS.items()}), _map({t: v for t, (_, v) in TAGS.items()})
    return F.struct(name[tag].alias("name"), value[tag].alias("value"))


def _listed(known: Column) -> Column:
    """Features in the order of their first tags, each with its values sorted."""
    of = lambda n: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(known, lambda x: x["name"] == n), lambda x: x["value"]))), ",")
    return F.array_join(F.transform(F.array_distinct(F.transform(known, lambda x: x["name"])), lambda n: F.concat(n, F.lit("="), of(n))), "|")


def _said(rest: Column, known: Column, items: Column) -> Column:
    only = (F.size(known) == 0) & (F.size(items) == 0) & (F.size(rest) > 0)
    return F.when(only, F.concat(F.lit("StrGram="), F.array_join(rest, ","))).otherwise(F.nullif(F.array_join(items, "|"), F.lit("")))


def to_ud_feats(feats: Column, lemma: Column, values: dict[str, dict[str, str]] | None = None) -> Column:
    """Features under the other annotation's names, sorted; ``values`` translates them by name, what it lacks stays.

    A reflexive lemma has the middle voice. The table of values is not known here and has to be given.
    """
    from .columns import parse_feats, reflexive

    name = _map(UD_NAMES)
    known = F.filter(parse_feats(feats), lambda p: name[p["name"]].isNotNull())
    table = {f"{k}={a}": b for k, pairs in (values or {}).items() for a, b in pairs.items()}
    given = lambda p: F.coalesce(_map(table)[F.concat(p["name"], F.lit("="), p["value"])], p["value"]) if table else p["value"]
    value = lambda p: F.when((p["name"] == "Залог") & reflexive(lemma), F.lit("Mid")).otherwise(given(p))
    out = F.array_join(F.array_sort(F.transform(known, lambda p: F.concat(name[p["name"]], F.lit("="), value(p)))), "|")
    return F.when(out == "", "_").otherwise(out)


#: Rules of a relation, the first that holds wins. Each: the dependent's parts of speech, the head's, a condition, the relation.
NOMINAL, NAMED = ("S", "PRON", "NUM", "NID"), ("NOUN", "PROPN", "PRON", "ADJ", "DET")
RULES: list[tuple[tuple[str, ...] | None, tuple[str, ...] | None, str | None, str]] = [
    (("ADP",), None, None, "case"),
    (("PUNCT",), None, None, "punct"),
    (("CCONJ",), None, None, "cc"),
    (("SCONJ",), None, None, "mark"),
    (("PART",), None, "lower(lemma) = 'бы'", "aux"),
    (("PART",), None, "lower(lemma) in ('было', 'не')", "advmod"),
    (("PART",), None, None, "discourse"),
    (("VERB", "AUX"), None, "verbform = 'Conv'", "advcl"),
    (("VERB", "AUX"), NOMINAL, "verbform = 'Inf'", "acl"),
    (("VERB", "AUX"), None, "verbform = 'Inf'", "xcomp"),
    (("VERB", "AUX"), NOMINAL, "has_relative", "acl:relcl"),
    (("VERB", "AUX"), NOMINAL, None, "acl"),
    (("VERB", "AUX"), None, None, "advcl"),
    (("ADJ", "NOUN", "PROPN"), ("V",), "gcase = 'Ins' and head_lemma rlike 'считать|называть|объявлять|обозвать|звать'", "xcomp"),
    (NAMED, ("V", "A"), "gcase = 'Nom' and voice = 'СТРАД'", "nsubj:pass"),
    (NAMED, ("V", "A"), "gcase = 'Nom'", "nsubj"),
    (NAMED, ("V",), "head_lemma = 'быть' and gcase = 'Gen' and has_quantity", "nsubj"),
    (NAMED, ("V",), "gcase = 'Acc' and not has_preposition", "obj"),
    (("NOUN", "PROPN", "PRON", "NUM", "ADJ", "DET", "SYM"), ("V",), None, "obl"),
    (("X",), ("V",), None, "nsubj"),
    (("ADJ",), NOMINAL, None, "amod"),
    (("NUM",), NOMINAL, None, "nummod"),
    (("NOUN", "PROPN", "PRON"), NOMINAL, None, "nmod"),
    (("ADV",), NOMINAL, None, "advmod"),
    (("ADV",), ("ADV",), None, "advmod"),
    (("NOUN", "PROPN", "PRON", "NUM"), ("ADV",), None, "obl"),
    (("NOUN", "PROPN", "PRON", "NUM"), ("A",), None, "obl"),
    (("ADV",), ("A", "V", "NOUN", "PROPN"), None, "advmod"),
    (("ADV",), None, None, "obl"),
]
#: Words of quantity.
QUANTITY = ("сколько", "столько", "много", "немного", "несколько")


def relation() -> Column:
    """The relation of a former root to its new head, ``TEMP`` if no rule holds.

    Reads upos, lemma, gcase (its Case), verbform, voice, has_relative (a dependent is a relative pronoun), has_preposition (a dependent is one, as case),
    has_quantity (the sentence has a word of quantity), head_upos (in the source's tags) and head_lemma.
    """
    # a bit for each rule: those that a part of speech allows, those of the head's, those whose condition holds. A chain of all rules is a method too long for the JVM to compile
    mask = lambda rules: sum(1 << i for i in rules)

    def allowed(column: str, k: int) -> Column:
        names = sorted({x for r in RULES for x in r[k] or ()})
        of = lambda x: mask(i for i, r in enumerate(RULES) if r[k] is None or x in r[k])
        table = F.create_map(*[c for x in names for c in (F.lit(x), F.lit(of(x)).cast("long"))])
        return F.coalesce(table[F.col(column)], F.lit(of(None)).cast("long"))

    held = F.lit(mask(i for i, r in enumerate(RULES) if r[2] is None)).cast("long")
    for condition in dict.fromkeys(r[2] for r in RULES if r[2]):
        held = held.bitwiseOR(F.when(F.coalesce(F.expr(condition), F.lit(False)), F.lit(mask(i for i, r in enumerate(RULES) if r[2] == condition)).cast("long")).otherwise(F.lit(0).cast("long")))
    all_ = allowed("upos", 0).bitwiseAND(allowed("head_upos", 1)).bitwiseAND(held)
    # of the bits that are left the lowest is the first rule that holds
    first = F.bit_count(all_.bitwiseXOR(all_ - 1)).cast("int") - 1
    return F.coalesce(F.get(F.array(*[F.lit(r[3]) for r in RULES]), F.when(all_ != 0, first)), F.lit("TEMP"))
