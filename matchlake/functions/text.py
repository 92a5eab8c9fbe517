"""Text functions as column expressions; only the two without a built-in form are pandas UDFs."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from matchlake.functions import tables as T

#: Letters and digits that a normalised text keeps.
KEPT = "[a-zа-яё0-9]+"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(x: Column | str) -> Column:
    """Lower-case runs of Latin and Cyrillic letters and digits, ё as е; null: none."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(col(x).cast("string"), F.lit(""))), "ё", "е"), F.lit(KEPT), F.lit(0))


def normalize(x: Column | str) -> Column:
    return F.array_join(words(x), " ")


def tokens(x: Column | str) -> Column:
    return F.array_distinct(words(x))


def normalize_any_script(x: Column | str) -> Column:
    """Lower-case letters and digits of any script, ё as е, one space between runs."""
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(col(x).cast("string"), F.lit(""))), "ё", "е"), r"[^\p{L}\p{N}]+", " "))


def split_list(x: Column | str) -> Column:
    """Parts between commas or semicolons, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(col(x), F.lit("")), "[,;]"), lambda p: F.trim(p)), lambda p: p != "")


def json_list(x: Column | str) -> Column:
    """A JSON array of strings, else what split_list gives."""
    return F.coalesce(F.from_json(col(x), "array<string>"), split_list(x))


def optional_number(x: Column | str) -> Column:
    """A number with a point or a comma; null if it is none."""
    return F.replace(F.trim(col(x)), F.lit(","), F.lit(".")).try_cast("double")


def first_number(x: Column | str) -> Column:
    return F.replace(F.nullif(F.regexp_extract(F.coalesce(col(x).cast("string"), F.lit("")), r"(\d+[.,]?\d*)", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def translit(x: Column) -> Column:
    """Cyrillic letters in Latin ones; one letter can give several."""
    one = {a: b for a, b in T.TO_LATIN.items() if len(b) <= 1}
    for a, b in T.TO_LATIN.items():
        if len(b) > 1:
            x = F.replace(x, F.lit(a), F.lit(b))
    pairs = [*[a for a, b in one.items() if b], *[a for a, b in one.items() if not b]]
    return F.translate(x, "".join(pairs), "".join(one[a] for a in pairs if one[a]))


def fold_word(x: Column) -> Column:
    """Look-alike Latin letters as Cyrillic, in words that hold Cyrillic or, from three letters, nothing else."""
    folded = F.translate(x, "".join(T.TO_CYRILLIC), "".join(T.TO_CYRILLIC.values()))
    return F.when(x.rlike("[а-яё]") | ((F.length(x) >= 3) & x.rlike(f"^[{T.LOOKALIKES}]+$")), folded).otherwise(x)


def repair_digits(x: Column) -> Column:
    """Letters read for digits in a token of three or more that has a digit."""
    fixed = F.translate(x, "".join(T.DIGITS), "".join(T.DIGITS.values()))
    return F.when(x.rlike("^[0-9оoзб]{3,}$") & x.rlike("[0-9]"), fixed).otherwise(x)


def raw_words(x: Column | str) -> Column:
    """Words of recognised text: Greek letters as Cyrillic, cut where case rises, ё as е, digits repaired, runs of letters or of digits.

    The text should be in normal form NFKC with its case (see nfkc_cased).
    """
    read = F.translate(F.coalesce(col(x), F.lit("")), "".join(T.GREEK), "".join(T.GREEK.values()))
    spaced = F.lower(F.regexp_replace(read, "(?<=[a-zа-яё])(?=[A-ZА-ЯЁ])", " "))
    cut = F.regexp_extract_all(F.replace(F.translate(spaced, "ё", "е"), F.lit("ß"), F.lit("ss")), F.lit("[a-zа-я0-9]+"), F.lit(0))
    return F.flatten(F.transform(cut, lambda w: F.regexp_extract_all(repair_digits(w), F.lit("[a-zа-я]+|[0-9]+"), F.lit(0))))


def roman(x: Column) -> Column:
    """A Roman numeral from 2 to 199 as a number in text; else null."""
    value = F.transform(F.split(F.lower(x), ""), lambda c: F.when(c == "i", 1).when(c == "v", 5).when(c == "x", 10).when(c == "l", 50).when(c == "c", 100).otherwise(0))
    total = F.aggregate(F.sequence(F.lit(0), F.size(value) - 1), F.lit(0), lambda s, i: s + F.when(F.coalesce(F.get(value, i + 1), F.lit(0)) > F.get(value, i), -F.get(value, i)).otherwise(F.get(value, i)))
    shape = F.lower(x).rlike("^c?(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$") & (F.length(x) > 0)
    return F.when(shape & total.between(2, 199), total.cast("string"))


_CANONICAL = {v: k for k, vs in T.TERMS.items() for v in vs}


def canonical(x: Column) -> Column:
    """The Cyrillic term that a spelling stands for, else the word."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(s) for pair in _CANONICAL.items() for s in pair]), x), x)


def variants(x: Column) -> Column:
    """Spellings under which a raw word may stand in the index: as read, in one script, as a term, as a number, in Latin letters.

    Words of one or two letters have none, nor has a word of which any spelling tells a style; stop words,
    single digits and spellings under three letters are left out.
    """
    folded = fold_word(x)
    read = [x, folded, canonical(x), canonical(folded)]
    latin = [F.when(w.rlike("[а-яё]"), translit(w)) for w in read]
    forms = F.array_distinct(F.array_compact(F.array(*read, roman(x), *latin)))
    useful = F.filter(forms, lambda w: ~F.array_contains(_fixed(T.STOP), w) & ((F.length(w) >= 3) | w.rlike("^[0-9]{2,}$")))
    none = ((F.length(x) < 3) & ~x.rlike("^[0-9]+$")) | F.arrays_overlap(forms, _fixed(T.STYLE_WORDS))
    return F.when(none, F.array().cast("array<string>")).otherwise(useful)


def _fixed(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def style(x: Column | str, group: str) -> Column:
    """The first style of a group, in order of priority, whose phrase the text holds as whole words."""
    text = F.concat(F.lit(" "), F.array_join(F.transform(raw_words(x), fold_word), " "), F.lit(" "))
    plain = F.concat(F.lit(" "), F.array_join(raw_words(x), " "), F.lit(" "))
    out = F.lit(None).cast("string")
    for name, phrases in reversed(T.STYLES[group]):
        hit = F.lit(False)
        for p in phrases:
            hit = hit | text.contains(f" {p} ") | plain.contains(f" {p} ")
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def year_token(x: Column) -> Column:
    return x.rlike(r"^(19[5-9][0-9]|20[0-4][0-9])$")


def deletes(x: Column, depth: int = 1) -> Column:
    """The word and what is left of it without one letter (depth 2: one or two)."""
    once = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    out = F.array_union(F.array(x), once(x))
    if depth > 1:
        out = F.array_union(out, F.flatten(F.transform(F.filter(once(x), lambda w: F.length(w) > 0), once)))
    return F.filter(out, lambda w: F.length(w) > 0)


def piece_keys(token: Column) -> Column:
    """The thirds of a token, with its length and their places: two edits leave one of them whole."""
    m = F.length(token)
    cut = lambda i: F.floor(m * i / 3)
    return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat_ws("#", m, i, F.substring(token, (cut(i) + 1).cast("int"), (cut(i + 1) - cut(i)).cast("int"))))


def piece_probes(word: Column, least: int) -> Column:
    """The keys of piece_keys under which a token of ``least`` letters or more within two edits of ``word`` is found."""
    n = F.length(word)
    cut = lambda m, i: F.floor(m * i / 3).cast("int")
    one = lambda m, i, shift: F.when(cut(m, i) + shift >= 0, F.concat_ws("#", m, i, F.substring(word, cut(m, i) + 1 + shift, cut(m, i + 1) - cut(m, i))))
    shifts = lambda m, i: F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda shift: one(m, i, shift))
    sizes = F.filter(F.sequence(n - 2, n + 2), lambda m: m >= least)
    return F.array_distinct(F.array_compact(F.flatten(F.transform(sizes, lambda m: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: shifts(m, i)))))))


def within(a: Column, b: Column, limit: int) -> Column:
    """Edit distance if it is at most ``limit``, else limit + 1."""
    d = F.levenshtein(a, b, limit)
    return F.when(d < 0, limit + 1).otherwise(d)


def contains_any(x: Column, stems: list[str]) -> Column:
    out = F.lit(False)
    for s in stems:
        out = out | F.coalesce(x, F.lit("")).contains(s)
    return out


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of a to b (not symmetric); nulls count as empty."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


@F.pandas_udf(StringType())
def nfkc_cased(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t), na_action="ignore")


def url_part(x: Column, part: str) -> Column:
    return F.try_parse_url(x, F.lit(part))


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def image_url(direct: Column, base: str, name: Column) -> Column:
    """The direct address, else base and the percent-encoded name, else null."""
    own = F.when(F.length(F.coalesce(name, F.lit(""))) > 0, F.concat(F.lit(base.rstrip("/") + "/"), F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))))
    return F.coalesce(F.nullif(direct, F.lit("")), own)


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """Count with the noun form that Russian agreement asks for; nothing for zero or less."""
    whole = F.floor(n)
    tens, last = F.pmod(whole, F.lit(100)), F.pmod(whole, F.lit(10))
    noun = F.when(tens.between(11, 14), many).when(last == 1, one).when(last.between(2, 4), few).otherwise(many)
    return F.when(n > 0, F.concat(whole.cast("string"), F.lit(" "), noun)).otherwise("")


def relative_time(minutes: Column) -> Column:
    """Coarse age of an event in minutes."""
    return (
        F.when(minutes < 1, "now").when(minutes < 60, F.concat(F.floor(minutes).cast("string"), F.lit(" min"))).when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit(" h")))
        .otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit(" d")))
    )


def mime_type(data: Column) -> Column:
    """Image type by its first bytes; null if unknown."""
    head = F.hex(F.substring(data, 1, 64))
    brands = F.transform(F.sequence(F.lit(0), F.lit(13)), lambda i: F.substring(head, F.when(i == 0, 17).otherwise(i * 8 + 25), F.lit(8)))
    named = lambda names: F.arrays_overlap(brands, F.array(*[F.lit(n.encode().hex().upper()) for n in names]))
    box = F.substring(head, 9, 8) == "66747970"
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(box & named(T.AVIF_BRANDS), "image/avif").when(box & named(T.HEIF_BRANDS), "image/heic")
    )


def upload_allowed(declared: Column, data: Column) -> Column:
    declared = F.lower(F.trim(F.substring_index(F.coalesce(declared, F.lit("")), ";", 1)))
    return mime_type(data).isNotNull() | declared.isin(T.MIMES)
