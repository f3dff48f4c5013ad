"""String functions of sections, references, terms and modal wording, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.taxonomy import MODALS, STANDARD_PREFIXES

#: White space as the review rules see it: ASCII, ideographic and no-break space.
WS = r"[\s\x{3000}\x{00A0}]"
REFERENCE = r"(?i)(?<![\p{L}\p{N}_])(?:" + "|".join(STANDARD_PREFIXES) + r")" + WS + r"*[/A-Z0-9.]*" + WS + r"*\d+(?:\.\d+)*(?:[-—–]\d{4})?"
INJECTED_REFERENCE = r"(?:GB(?:/T)?|IEC|ISO|YD/T|JG/T|HJ|QB|SJ|JB|NB)" + WS + r"*\d+(?:[./]\d+)*(?:" + WS + r"*[—\-]" + WS + r"*\d{4})?"


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, f"^{WS}+|{WS}+$", "")


def empty_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def section_key(x: Column) -> Column:
    """Comparable form of a section number: without outer brackets, appendix prefix and outer space; null stays null."""
    bare = F.regexp_replace(trimmed(x), r"^\[(.+)\]$", "$1")
    full = trimmed(F.regexp_replace(trimmed(bare), f"^附{WS}*录{WS}*", ""))
    return F.when(x.rlike(r"^[0-9A-Z.]+$"), x).otherwise(full)  # most keys need no more than one look


def compact(x: Column, limit: int | None = None) -> Column:
    """Runs of white space as one space, outer ones gone; at most limit code points."""
    short = trimmed(F.regexp_replace(F.coalesce(x, F.lit("")), f"{WS}+", " "))
    return F.substring(short, 1, limit) if limit else short


def brief(x: Column, limit: int = 120) -> Column:
    """A short form for messages; (empty) where there is nothing."""
    short = compact(x)
    return F.when((short == "") | (F.lower(short) == "none"), "（空）").when(F.length(short) > limit, F.concat(F.rtrim(F.substring(short, 1, limit)), F.lit("..."))).otherwise(short)


def error_text(error: Column, fix: Column, basis: Column) -> Column:
    return F.format_string("错误：%s；修改建议：%s；依据：%s", error, fix, basis)


def label(number: Column, title: Column) -> Column:
    return F.when(F.coalesce(number, F.lit("")) != "", F.concat(F.lit("["), number, F.lit("] "), F.coalesce(title, F.lit("")))).otherwise(F.coalesce(title, F.lit("")))


def section_line(number: Column, title: Column, content: Column, limit: int = 260) -> Column:
    return F.concat(label(number, title), F.lit("\n"), compact(content, limit))


def normal_reference(x: Column) -> Column:
    """A reference in upper case with plain dashes, without white space and outer marks."""
    plain = F.regexp_replace(F.translate(F.upper(x), "—–", "--"), f"{WS}+", "")
    return F.regexp_replace(plain, r"^[，。；;,.、()（）]+|[，。；;,.、()（）]+$", "")


def reference_ids(x: Column) -> Column:
    """Distinct normalised references of a text, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(REFERENCE), F.lit(0)), normal_reference))


def reference_base(ref: Column) -> Column:
    return F.regexp_replace(ref, r"-\d{4}$", "")


def injected_ids(x: Column) -> Column:
    """Distinct references as the injectors read them: no year, no white space."""
    found = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(INJECTED_REFERENCE), F.lit(0))
    return F.array_distinct(F.transform(found, lambda r: F.regexp_replace(F.regexp_replace(r, f"{WS}*[—\\-]{WS}*\\d{{4}}$", ""), f"{WS}+", "")))


def modal_words(x: Column) -> Column:
    """Modal words that a text holds, in their fixed order."""
    return F.filter(F.array(*map(F.lit, MODALS)), lambda w: F.contains(x, w))


def has_any(x: Column, words: list[str]) -> Column:
    return x.rlike("|".join(words))


def sentences(x: Column) -> Column:
    """Sentences of a text with white space collapsed; those under 6 code points fall away."""
    parts = F.split(F.coalesce(x, F.lit("")), "[。；;！？!?\n]+")
    return F.filter(F.transform(parts, lambda s: trimmed(F.regexp_replace(s, f"{WS}+", " "))), lambda s: F.length(s) >= 6)


def term_text(x: Column) -> Column:
    """A term without its leading number and trailing Latin gloss."""
    bare = F.regexp_replace(compact(x), f"^[\\d.]+{WS}*", "")
    return F.regexp_replace(trimmed(F.regexp_replace(bare, f"{WS}+[a-zA-Z][a-zA-Z0-9 /,()_-]{{1,80}}$", "")), "^[ ：:，,。]+|[ ：:，,。]+$", "")


def is_term_section(number: Column, title: Column) -> Column:
    n, t = F.coalesce(number, F.lit("")), F.coalesce(title, F.lit(""))
    return (n == "3") | n.startswith("3.") | (t.contains("术语") & t.contains("定义"))


def joined_numbers(x: Column) -> Column:
    """Section numbers that a line feed broke, whole again."""
    return F.regexp_replace(x, r"(?<=\d\.)\n(?=\d)", "")


def same_description(a: Column, b: Column) -> Column:
    """Equal without white space; empty or null never equals."""
    plain = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), f"{WS}+", "")
    return (plain(a) != "") & (plain(a) == plain(b))


def with_note(reason: Column, note: Column) -> Column:
    """The reason with a note in brackets, once."""
    old = trimmed(F.coalesce(reason, F.lit("")))
    return F.when(old.contains(note), old).when(old == "", note).otherwise(F.concat(old, F.lit("（"), note, F.lit("）")))


def with_supplement(description: Column, note: Column) -> Column:
    """The description with a supplement at its end, once."""
    old = trimmed(F.coalesce(description, F.lit("")))
    return F.when(old.contains(note), old).when(old == "", note).otherwise(F.concat(old, F.lit("；补充："), note))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """The text with the first occurrence of old replaced; unchanged without one."""
    at = F.position(old, text)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(old)))).otherwise(text)


def depth(number: Column) -> Column:
    """Levels of a dotted number; null where it does not begin with a digit or dot."""
    return F.when(number.rlike(r"^[\d.]+"), F.length(number) - F.length(F.replace(number, F.lit("."))) + 1)


def masked(secret: Column) -> Column:
    """First and last characters of a secret."""
    return F.when(F.coalesce(secret, F.lit("")) == "", "<empty>").when(F.length(secret) <= 8, F.repeat(F.lit("*"), F.length(secret))).otherwise(F.concat(F.substring(secret, 1, 4), F.lit("..."), F.substring(secret, -4, 4)))
