"""Text functions as Columns: pure, null-safe (null becomes ''), inside whole-stage code generation.

Unicode composition (NFC) has no built-in; it is an Arrow function, and skipped by `assume_nfc`. Whole abbreviations are looked up by another,
as built-in functions take several times as long.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed_values as V

_FOLD_FROM = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđäëïöüçñåãõîûÀÁẢÃẠĂẰẮẲẴẶÂẦẤẨẪẬÈÉẺẼẸÊỀẾỂỄỆÌÍỈĨỊÒÓỎÕỌÔỒỐỔỖỘƠỜỚỞỠỢÙÚỦŨỤƯỪỨỬỮỰỲÝỶỸỴĐÄËÏÖÜÇÑÅÎÛ"


def _base(c: str) -> str:
    return {"đ": "d", "Đ": "D"}.get(c) or unicodedata.normalize("NFD", c)[0]


_FOLD_TO = "".join(map(_base, _FOLD_FROM))
_LETTER = r"0-9A-Za-zÀ-ỹĐđ"
#: Sets of single characters: the engine tells these by a table, while in negated or joined ranges threads wait for each other (twenty times as long with eight).
_PLAIN = "abcdefghijklmnopqrstuvwxyz0123456789 "
_CONTROL = "".join(rf"\x{i:02x}" for i in (*range(9), 11, 12, *range(14, 32), 127))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: functions over arrays would else compute it anew for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def by_parts(x: pa.Array, f: Callable[[str], str], most: int = 1 << 20) -> pa.Array:
    """f of every text that isn't null, for texts of about `most` bytes at a time (one at least): a batch is never held as Python strings, and parts that f leaves as they are aren't copied before the end."""
    sizes = pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most)) + 1).tolist(), len(x)]
    parts, same = [], True
    for a, b in zip(cuts, cuts[1:]):
        old = x.slice(a, b - a).to_pylist()
        new = [None if t is None else f(t) for t in old]
        same = same and new == old
        parts.append(x.slice(a, b - a) if new == old else pa.array(new, x.type))
    return x if same else pa.concat_arrays(parts)


@F.arrow_udf(StringType())
def _nfc(x: pa.Array) -> pa.Array:
    return by_parts(x, lambda t: t if t.isascii() else unicodedata.normalize("NFC", t))


def nfc(c: Column | str) -> Column:
    return _nfc(text(c))


def collapse(c: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _single_spaced(c: Column) -> Column:
    """`collapse` of a text without any white space but spaces."""
    return F.trim(F.regexp_replace(c, " {2,}", " "))


def normalize_unicode(c: Column | str, assume_nfc: bool = False) -> Column:
    """Sentinels become ''; NFC; line ends unified; control characters and leading bullets of lines become spaces; white space collapses."""
    raw = text(c)
    s = raw if assume_nfc else nfc(raw)
    s = F.regexp_replace(s, "\r\n?", "\n")
    s = F.regexp_replace(s, f"[{_CONTROL}]", " ")
    s = F.regexp_replace(s, r"(?Um)^[\s\-\*•·●▪◦\+]+", " ")
    empty = raw.rlike(rf"(?iuU)\A\s*(?:{'|'.join(re.escape(w) for w in V.NULLISH)})\s*\z")
    return F.when(empty, F.lit("")).otherwise(collapse(s))


def _tone_pairs() -> str:
    """A pattern of a vowel with a tone before one without: a superset of the pairs, told by two plain sets of letters, as a search that folds case takes several times as long.

    Only a letter beyond ASCII before one of the second set is looked up in the first.
    """
    first, second = ("".join(sorted({x for pair, _ in V.TONES for x in (pair[i].lower(), pair[i].upper())})) for i in (0, 1))
    return rf"[^\x00-\x7f][{second}](?<=[{first}][{second}])"


def normalize_tone(c: Column | str) -> Column:
    """The tone mark of oa, oe and uy on the second vowel, in lower, upper and title case; texts without such a pair are left alone."""
    def moved(x: Column) -> Column:
        out = x
        for a, b in V.TONES:
            for f in (str, str.upper, str.capitalize):
                out = F.replace(out, F.lit(f(a)), F.lit(f(b)))
        return F.when(x.rlike(_tone_pairs()), out).otherwise(x)

    return let(text(c), moved)


_WORD = re.compile(rf"[{_LETTER}][{_LETTER}.]*")
_LONGEST = max(map(len, V.ABBREVIATIONS)) + 3


def _expanded_word(word: str) -> str:
    return V.ABBREVIATIONS.get(word.lower().rstrip("."), word) if len(word) <= _LONGEST else word


def _expanded(m: re.Match) -> str:
    return _expanded_word(m[0])


@F.arrow_udf(StringType())
def _expand(x: pa.Array) -> pa.Array:
    return by_parts(x, lambda t: _WORD.sub(_expanded, t) if any(_expanded_word(w) != w for w in set(_WORD.findall(t))) else t)


def expand_abbreviations(c: Column | str) -> Column:
    """Contextual abbreviations by pattern, in order, in texts that have their letters; then whole tokens by the table, their trailing dots dropped with them.

    Tokens are looked up by an Arrow function: cut into an array of pieces by built-in functions, a text takes several times as long.
    """
    s = text(c)
    for pattern, replacement in V.CONTEXT_ABBREVIATIONS:
        s = F.regexp_replace(s, f"(?iuU){pattern}", replacement)
    return _expand(F.when(text(c).rlike("[Tt][Pp]|[Cc][PpVv]"), s).otherwise(text(c)))


def fold_accents(c: Column | str) -> Column:
    """Letters without their accents, đ as d."""
    return F.translate(text(c), _FOLD_FROM, _FOLD_TO)


def place_key(c: Column | str) -> Column:
    return _single_spaced(F.regexp_replace(F.lower(fold_accents(c)), f"[^{_PLAIN}]+", " "))


def split_list(c: Column | str, assume_nfc: bool = False) -> Column:
    """Lower-cased parts between commas, slashes, semicolons and bars, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.lower(normalize_unicode(c, assume_nfc)), r"[,/;|]"), lambda x: F.trim(x)), lambda x: x != "")


def split_languages(c: Column | str, assume_nfc: bool = False) -> Column:
    return F.filter(split_list(c, assume_nfc), lambda x: x != "unk")


def province_table() -> dict[str, str]:
    """Folded key of each province, district and spelling -> province."""
    fold = lambda s: " ".join("".join(_base(ch) if ch not in "đĐ" else "d" for ch in s.lower()).split())
    out = {}
    for name, places in V.PROVINCES.items():
        for place in (name, *places):
            out[fold(place)] = name
    return out


def normalize_province(c: Column | str, assume_nfc: bool = False) -> Column:
    """The province of the first place: by its key, by its key without an administrative prefix, else its own name; '' is 'unknown'."""
    table = F.create_map(*(F.lit(x) for kv in province_table().items() for x in kv))

    def of(head: Column) -> Column:
        def named(key: Column) -> Column:
            bare = F.regexp_replace(key, r"^(?:tp|thanh pho|tinh|thi xa|tx)\s+", "")
            return F.coalesce(F.try_element_at(table, key), F.try_element_at(table, bare))

        own = F.trim(F.regexp_replace(head, r"(?iu)^(?:tp\.?|thành phố|tỉnh|thị xã|tx\.?)\s+", ""))
        return F.when(head == "", F.lit("unknown")).otherwise(F.coalesce(let(place_key(head), named), F.when(own != "", own), head))

    def head_of(whole: Column) -> Column:
        first = F.filter(F.transform(F.split(whole, r"[,/;|]"), lambda x: F.trim(x)), lambda x: x != "")
        return let(F.coalesce(F.try_element_at(first, F.lit(1)), whole), of)

    return let(F.lower(normalize_unicode(c, assume_nfc)), head_of)


def _pay_words(most: int) -> list[str]:
    return [rf".{{0,{most - len(w)}}}?{w}" for w in V.PAY_WORDS] + [rf".{{0,{most - len(m) - 1}}}?/\s{{0,3}}{m}" for m in V.MONTHS]


def _any(values: list[str]) -> str:
    return "|".join(values)


def _is_pay(amount: str, units: tuple[str, ...] = ()) -> str:
    """The amount, unless it counts something else (a counting noun follows, after dong or one of `units`) without a word of pay within 40 characters."""
    counted = rf"(?!\s*(?:(?:{_any([*V.DONG_BEFORE_COUNTED, *units])})\s+)?(?:{_any(V.COUNTED)}))"
    after = "(?=" + "|".join(_pay_words(40)) + ")"
    before = "(?<=" + "|".join(rf"{w}.{{0,{40 - len(w)}}}" for w in V.PAY_WORDS) + "|" + "|".join(rf"/\s{{0,3}}{m}.{{0,30}}" for m in V.MONTHS) + ")"
    return rf"(?={amount})(?:{before}(?>{amount})|(?>{amount})(?:{counted}|{after}))"


def mask_salary(c: Column | str) -> Column:
    """Amounts of pay become <SALARY>: dong first, then millions, then dollars; quantities of other things stay. Texts without a digit are left alone."""
    span = rf"{V.NUMBER}(?:\s*(?:{_any(V.RANGE_SIGNS)})\s*{V.NUMBER})?"
    dong, millions, dollars = _any(V.DONG), _any(V.MILLIONS), _any(V.DOLLARS)
    # a dollar sign before millions of users makes them no pay
    amounts = (_is_pay(rf"\b{span}\s*(?:{dong})\b"), _is_pay(rf"\b{span}\s*(?:{millions})\b"), _is_pay(rf"(?:(?:{dollars})\s*{span}\b|\b{span}\s*(?:{dollars}))", tuple(V.MILLIONS)))

    def masked(x: Column) -> Column:
        return F.when(x.rlike("[0-9]"), reduce(lambda s, a: F.regexp_replace(s, "(?siuU)(?=[0-9$uU])" + a, " <SALARY> "), amounts, x)).otherwise(x)

    return collapse(let(text(c), masked))


def experience_months(c: Column | str, assume_nfc: bool = False) -> Column:
    """Months of the first '<number> năm|tháng'; 0 without one or where none is asked for."""
    s = F.lower(normalize_unicode(c, assume_nfc))
    number, unit = (F.regexp_extract(s, r"(\d+(?:[.,]\d+)?)\s*(năm|nam|tháng|thang)", i) for i in (1, 2))
    months = F.translate(number, ",", ".").try_cast("double") * F.when(unit.isin("năm", "nam"), 12).otherwise(1)
    return F.when(s.contains("không") | s.contains("khong") | (number == ""), F.lit(0.0)).otherwise(months)


def parse_list(c: Column | str, assume_nfc: bool = False) -> Column:
    """['a', 'b'] as an array; plain text is cut at commas; what isn't well-formed loses its brackets first. Elements are normalized, empty ones dropped."""
    s = F.trim(text(c))
    bracketed = s.startswith("[") & s.endswith("]")
    parsed = F.from_json(s, "array<string>", {"allowSingleQuotes": "true"})
    fallback = F.split(F.when(bracketed, F.regexp_replace(s, r"^[\[\]]+|[\[\]]+$", "")).otherwise(s), ",")
    items = F.coalesce(F.when(bracketed & ~s.rlike(r"^\[\s*[^\s\"'\d\-\[{]"), parsed), fallback)
    none = F.lower(s).isin(*V.NULLISH) | (s == "[]")
    clean = F.filter(F.transform(items, lambda x: normalize_unicode(x, assume_nfc=True)), lambda x: x != "")
    return F.when(none, F.array().cast("array<string>")).otherwise(clean) if assume_nfc else F.when(none, F.array().cast("array<string>")).otherwise(F.from_json(_nfc(F.to_json(clean)), "array<string>"))


def join_list(c: Column | str, assume_nfc: bool = False) -> Column:
    return F.lower(F.array_join(parse_list(c, assume_nfc), " ; "))


def remove_stopwords(c: Column | str) -> Column:
    stop = sorted({w for s in V.STOPWORDS for w in (s.lower(), s.lower().replace(" ", "_"))})
    return F.array_join(F.filter(F.split(collapse(text(c)), " "), lambda x: ~F.lower(x).isin(*stop)), " ")


def group_key(*columns: Column | str, assume_nfc: bool = False) -> Column:
    """16 hex digits of the SHA-1 of the folded, lower-cased fields without punctuation: near copies have the same."""
    parts = F.concat_ws(" || ", *(F.lower(normalize_unicode(c, assume_nfc)) for c in columns))
    folded = _single_spaced(F.regexp_replace(fold_accents(parts), f"[^{_PLAIN}]+", ""))
    return F.substring(F.sha1(folded), 1, 16)


def n_words(c: Column | str) -> Column:
    return F.size(F.filter(F.split(text(c), r"(?U)\s+"), lambda w: w != ""))


def n_acronyms(c: Column | str, assume_nfc: bool = False) -> Column:
    """Words of more than one character that are upper case."""
    return F.size(F.filter(F.split(normalize_unicode(c, assume_nfc), " "), lambda t: (F.length(t) > 1) & (t == F.upper(t)) & (t != F.lower(t))))


def short_label(c: Column | str) -> Column:
    """The first two parts of a_b_c, and … where there are more."""
    parts = F.split(text(c), "_")
    return F.concat(F.array_join(F.slice(parts, 1, 2), " "), F.when(F.size(parts) > 2, F.lit("…")).otherwise(F.lit("")))


def decimal_comma(c: Column, digits: int = 4, signed: bool = False) -> Column:
    return F.translate(F.format_string(f"%{'+' if signed else ''}.{digits}f", c.cast("double")), ".", ",")


def segment(c: Column | str, lexicon: list[str] | Callable[[Column], Column] | None = None) -> Column:
    """Words of several syllables from a lexicon joined by underscores, longest first; without a lexicon the text as it is.

    A Column function, such as one of operators.segmentation with costs learnt from a corpus, can stand in the list's place.
    """
    s = text(c)
    if callable(lexicon):
        return lexicon(s)
    for entry in sorted(lexicon or [], key=lambda w: (-len(w.split(" ")), w)):
        s = F.regexp_replace(s, rf"(?iuU)(?<![{_LETTER}_]){'( )'.join('(' + w + ')' for w in entry.split(' '))}(?![{_LETTER}_])", "_".join(f"${2 * i + 1}" for i in range(len(entry.split(" ")))))
    return s


def preprocess(c: Column | str, tone: bool = True, abbreviations: bool = True, mask: bool = False, lexicon: list[str] | None = None, stopwords: bool = False, assume_nfc: bool = False) -> Column:
    """Normalization, tone, abbreviations, mask, segmentation and stopwords in this order, each by its flag."""
    s = normalize_unicode(c, assume_nfc)
    s = normalize_tone(s) if tone else s
    s = expand_abbreviations(s) if abbreviations else s
    s = mask_salary(s) if mask else s
    s = segment(s, lexicon) if lexicon else s
    return remove_stopwords(s) if stopwords else s


def register(spark) -> None:
    """The functions for SQL, as temporary SQL functions are not parameterized: names of scalar Python functions over Arrow."""
    spark.udf.register("nfc", _nfc)
