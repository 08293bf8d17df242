"""Names, captions and search: built-in functions, and two vectorised ones where Unicode folding has none."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Small kana that are written for the large ones.
_KANA = str.maketrans("ヶヵゖゕ", "ケカけか")


#: Texts that are Python objects at once; of a batch only Arrow's bytes stay.
AT_ONCE = 64


def _each(texts: pa.Array, one) -> pa.Array:
    """``one`` of each text, a few at a time: memory follows a batch's bytes, not its texts as objects."""
    parts = [pa.array([one(t) for t in texts.slice(i, AT_ONCE).to_pylist()], pa.string()) for i in range(0, len(texts), AT_ONCE)]
    return pa.concat_arrays(parts or [pa.array([], pa.string())])


@F.arrow_udf(T.StringType())
def station_key(names: pa.Array) -> pa.Array:
    """NFKC, without white space, with small ka and ke as large ones; null is the empty text."""

    def one(text):
        return "" if text is None else re.sub(r"\s+", "", unicodedata.normalize("NFKC", text).strip()).translate(_KANA)

    return _each(names, one)


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode NFKC."""
    return texts.map(lambda text: None if text is None else unicodedata.normalize("NFKC", text))


def _folding():
    """The folding of one text; made here so that tasks get it by value."""

    def one(text):
        if text is None:
            return None
        out = []
        for c in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).lower()):
            if unicodedata.combining(c) and out and out[-1].isascii():
                continue
            out.append(chr(ord(c) + 0x60) if "ぁ" <= c <= "ゖ" else c)
        plain = unicodedata.normalize("NFC", "".join(out))
        return re.sub(r"(?<=(\d))[\W_]+(?=(\d))|[\W_]+", lambda m: " " if m[1] else "", plain)

    return one


_FOLD = _folding()


@F.arrow_udf(T.StringType())
def search_key(texts: pa.Array) -> pa.Array:
    """NFKC, lower case, Latin letters without marks, hiragana as katakana, no punctuation; digits keep a gap between numbers."""
    return _each(texts, _FOLD)


@F.pandas_udf(T.ArrayType(T.StringType()))
def search_keys(lists: pd.Series) -> pd.Series:
    """``search_key`` of each text of an array."""
    return lists.map(lambda texts: None if texts is None else [_FOLD(t) for t in texts])


def fold_ascii(text: Column) -> Column:
    """Lower case without punctuation or white space, for ASCII texts; stays in the engine."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def tokens(text: Column) -> Column:
    """Runs of letters and runs of digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+|[0-9]+"), F.lit(0))


def any_contains(fields: Column, word: str) -> Column:
    return F.exists(fields, lambda f: f.contains(word))


def matches(fields: Column, query: str, synonyms: dict[str, list[str]] | None = None) -> Column:
    """Whether the whole query, or one of its synonyms, is in a field, or every word of it is in some field."""
    whole = [query.lower(), *(synonyms or {}).get(query.lower(), [])]
    hit = any_contains(fields, whole[0])
    for w in whole[1:]:
        hit = hit | any_contains(fields, w)
    every = F.lit(True)
    for w in query.lower().split():
        own = any_contains(fields, w)
        for s in (synonyms or {}).get(w, []):
            own = own | any_contains(fields, s)
        every = every & own
    return hit | every


def rank(name: Column, query: str, other: Column | None = None) -> Column:
    """0 equal, 1 begins with, 2 contains, 3 only the other field contains; null otherwise."""
    out = F.when(name == query, 0).when(name.startswith(query), 1).when(name.contains(query), 2)
    return out if other is None else out.when(other.contains(query), 3)


def in_order(items: Column, *wanted: str) -> Column:
    """Whether an array holds the wanted items in this order, with anything between."""
    names = F.array(*[F.lit(w) for w in wanted])
    return F.aggregate(items, F.lit(0), lambda k, x: k + F.when((k < len(wanted)) & (x == F.get(names, k)), 1).otherwise(0)) == len(wanted)


def split_label(text: Column) -> Column:
    """Parts of a name joined by slashes, full-width ones as well, without empty ones."""
    return F.filter(F.transform(F.split(text, "[/／]"), lambda p: F.trim(p)), lambda p: p != "")


def label(text: Column, names: dict[str, str]) -> Column:
    """Each part by its name in the mapping, joined by slashes again."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None
    known = (lambda p: F.coalesce(F.element_at(table, p), p)) if names else (lambda p: p)
    return F.array_join(F.transform(split_label(text), known), "/")


def unless_leading(prefix: Column, name: Column) -> Column:
    """The prefix, unless the name begins with it already."""
    return F.when(name.startswith(prefix), None).otherwise(prefix)


def caption(text: Column) -> tuple[Column, Column, Column]:
    """``name (first) (second)`` as its three parts; missing ones are empty."""
    pattern = r"^(.*?)(?: \(([^()]*)\))?(?: \(([^()]*)\))?$"
    return tuple(F.regexp_extract(text, pattern, k) for k in (1, 2, 3))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """``{name}`` with each value; a placeholder whose value is missing stays."""
    out = template
    for name, value in values.items():
        out = F.when(value.isNull(), out).otherwise(F.replace(out, F.lit("{" + name + "}"), value))
    return out


def reference(text: Column) -> tuple[Column, Column, Column]:
    """``name (CC, line)`` as name, country and line; empty where it has another form."""
    pattern = r"^(.*) \(([A-Z]{2}), ([^()]*)\)$"
    return tuple(F.regexp_extract(text, pattern, k) for k in (1, 2, 3))


def line_name(value: Column) -> Column:
    """Canonical line name: trimmed, NFKC, a trailing 本線 is 線."""
    folded = nfkc(F.trim(value))
    return F.when(folded.endswith("本線"), F.concat(F.substring(folded, F.lit(1), F.char_length(folded) - 2), F.lit("線"))).otherwise(folded)


def utf16_key(value: Column) -> Column:
    """A key whose order is that of the text's UTF-16 code units."""
    return F.encode(value, "UTF-16BE")


#: Characters and those that stand for them in a search.
_VARIANTS = {
    "鉄": "铁", "鐵": "铁", "営": "营", "広": "广", "浜": "滨", "沢": "泽", "関": "关", "県": "县", "気": "气", "発": "发", "図": "图", "線": "线",
    "東": "东", "電": "电", "車": "车", "臺": "台", "桜": "樱", "竜": "龙", "戸": "户", "楽": "乐", "渋": "涩", "円": "圆", "黒": "黑", "徳": "德",
    "歩": "步", "経": "经", "塩": "盐", "辺": "边", "恵": "惠", "横": "横", "浅": "浅", "駒": "驹", "舘": "馆", "館": "馆", "庁": "厅", "区": "区",
    "蔵": "藏", "ヶ": "ケ", "ヵ": "ケ",
}

#: Spellings of one character in station names, and katakana that look like kanji.
_SPELLINGS = {
    "ヶ": "ケ", "ヵ": "カ", "俱": "倶", "髙": "高", "濱": "浜", "濵": "浜", "瀨": "瀬", "鉃": "鉄", "鐵": "鉄",
    "ニ": "二", "カ": "力", "ロ": "口", "エ": "工", "オ": "才", "タ": "夕", "ト": "卜", "ハ": "八",
}


def _replaced(text: Column, table: dict[str, str]) -> Column:
    return F.translate(text, "".join(table), "".join(table.values()))


def variant_key(value: Column) -> Column:
    """``search_key`` in which variants of one character are equal. General traditional characters stay as they are."""
    return _replaced(search_key(value), _VARIANTS)


def variant_keys(values: Column) -> Column:
    """``variant_key`` of each text of an array."""
    return F.transform(search_keys(values), lambda v: _replaced(v, _VARIANTS))


def qualified(value: Column) -> tuple[Column, Column]:
    """``name (qualifier)`` or ``name [qualifier]`` as its two parts, in NFKC; the qualifier is null where either has no letter or digit."""
    whole = F.trim(nfkc(value))
    name, inner = r"^(.*)[(]([^(]*)[)]$|^(.*)[\[]([^\[]*)[\]]$", r"[\p{L}\p{N}]"
    part = lambda a, b: F.trim(F.concat(F.regexp_extract(whole, name, a), F.regexp_extract(whole, name, b)))
    both = part(1, 3).rlike(inner) & part(2, 4).rlike(inner)
    return F.when(both, part(1, 3)).otherwise(whole), F.when(both, part(2, 4))


def match_key(value: Column) -> Column:
    """The key of a station's recorded name: without qualifier, blanks, dots, dashes and a trailing 駅, with one spelling and lower case."""
    bare = _replaced(F.regexp_replace(qualified(value)[0], "[ \u30fb\uff65\\-\u2010-\u2015]", ""), _SPELLINGS)
    return F.lower(F.when((F.char_length(bare) > 1) & bare.endswith("駅"), F.substring(bare, F.lit(1), F.char_length(bare) - 1)).otherwise(bare))


def words_by_script(query: str) -> list[str]:
    """A query's words: parted at white space and where Hangul, other East Asian letters and the rest meet."""
    scripts = "[\u1100-\u11ff\u3130-\u318f\uac00-\ud7af]+|[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+|[^\\s\u1100-\u11ff\u3130-\u318f\uac00-\ud7af\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+"
    return re.findall(scripts, unicodedata.normalize("NFKC", query))


def station_code(code: Column) -> Column:
    """A station's code without the parts that vary between its records; fixed values are the networks' marks."""
    parts = F.split(code, "-")
    n, at = F.size(parts), lambda k: F.try_element_at(parts, F.lit(k))
    return (
        F.when(n < 3, code)
        .when(at(-2).isin("MTR", "LR", "MLM"), F.concat_ws("-", at(-2), at(-1)))
        .when(at(1) == "TRAM", F.concat(F.lit("TRAM-"), at(-1)))
        .when(at(2) == "NETWORK", F.concat_ws("-", at(1), F.array_join(F.slice(parts, F.lit(3), F.greatest(n - 2, F.lit(0))), "-")))
        .otherwise(code)
    )
