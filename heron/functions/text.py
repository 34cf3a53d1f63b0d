"""Text functions: tokens and stems for keyword search, personal data, prompts, ages and sizes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes in the order in which the first match is cut off.
SUFFIXES = ("ingly", "edly", "ness", "ment", "tion", "sion", "ious", "eous", "able", "ible", "less", "ful", "ing", "ied", "ies", "ily", "ers", "est", "ed", "er", "ly", "s")
#: English words left out of keyword search.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or that the to was were will with this but they have had what when where who which why how all each every both few more most "
    "other some such no nor not only own same so than too very can just should now i you your we our my me him her"
).split()
#: Patterns of personal data in the order in which they are replaced.
PII = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+1[-.\s]?)?(?:\(?[0-9]{3}\)?[-.\s]?)?[0-9]{3}[-.\s]?[0-9]{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "creditCard": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "ipAddress": r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b",
    "date": r"(?i)\b(?:\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}|\d{4}[/\-]\d{1,2}[/\-]\d{1,2}|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})\b",
}
REPLACEMENTS = {"email": "[EMAIL_REDACTED]", "phone": "[PHONE_REDACTED]", "ssn": "[SSN_REDACTED]", "creditCard": "[CARD_REDACTED]", "ipAddress": "[IP_REDACTED]", "date": "[DATE_REDACTED]"}
DEFAULT_PII = ("email", "phone", "ssn", "creditCard")


def stem(word: Column) -> Column:
    """The word without the first suffix that leaves three characters or more."""
    out = word
    for s in reversed(SUFFIXES):
        out = F.when((F.length(word) > len(s) + 2) & word.endswith(s), F.substring(word, F.lit(1), F.length(word) - len(s))).otherwise(out)
    return out


def tokens(text: Column, least: int = 2, stemming: bool = False, stop_words: tuple[str, ...] | list[str] = ()) -> Column:
    """Lower-case runs of a-z and 0-9 of at least `least` characters, stemmed, then without stop words; null gives an empty array."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z0-9]{{{least},}}"), F.lit(0))
    if stemming:
        words = F.transform(words, stem)
    return F.filter(words, lambda w: ~w.isin(list(stop_words))) if stop_words else words


def redact(text: Column, kinds: tuple[str, ...] = DEFAULT_PII, replacement: str | None = None, replacements: dict[str, str] | None = None, custom: tuple[tuple[str, str], ...] = ()) -> Column:
    """Personal data replaced kind after kind, then custom (pattern, replacement) pairs; replacements are taken literally."""
    plain = lambda s: re.sub(r"([\\$])", r"\\\1", s)
    for kind in PII:
        if kind in kinds:
            text = F.regexp_replace(text, PII[kind], plain(replacement or (replacements or {}).get(kind) or REPLACEMENTS[kind]))
    for pattern, new in custom:
        text = F.regexp_replace(text, pattern, plain(new))
    return text


def redact_plain(text: str, kinds: tuple[str, ...] = DEFAULT_PII, replacement: str | None = None) -> str:
    """redact() of one string, for functions that see texts in Python."""
    for kind, pattern in PII.items():
        if kind in kinds:
            new = replacement or REPLACEMENTS[kind]
            text = re.sub(pattern, lambda _, new=new: new, text, flags=re.ASCII)
    return text


def redact_metadata(metadata: Column, **options) -> Column:
    """A map of strings with every value redacted."""
    return F.transform_values(metadata, lambda _, v: redact(v, **options))


def has_pii(text: Column, kinds: tuple[str, ...] = DEFAULT_PII) -> Column:
    found = F.lit(False)
    for kind in kinds:
        found = found | text.rlike(PII[kind])
    return F.coalesce(found, F.lit(False))


def count_pii(text: Column, kind: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(PII[kind])), F.lit(0))


def mask(kind: str, match: Column) -> Column:
    """A match with its middle or beginning starred out."""
    n, stars = F.length(match), lambda k: F.repeat(F.lit("*"), k)
    tail = F.concat(stars(n - 4), F.right(match, F.lit(4)))
    at = F.instr(match, "@") - 1
    shown = {
        "email": F.when(at > 2, F.concat(F.left(match, F.lit(1)), stars(at - 2), F.substring(match, at, n))).otherwise(stars(n)),
        "creditCard": tail,
        "phone": tail,
        "ssn": F.concat(F.lit("***-**-"), F.right(match, F.lit(4))),
    }.get(kind, F.concat(F.left(match, F.lit(1)), stars(n - 2), F.right(match, F.lit(1))))
    return F.when(n <= 4, stars(n)).otherwise(shown)


PII_MATCH = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType())]))


@F.pandas_udf(PII_MATCH)
def find_pii(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """All matches of the default kinds with offsets in code points, in order of their starts."""
    patterns = [(k, re.compile(PII[k])) for k in DEFAULT_PII]
    for texts in batches:
        yield texts.map(lambda t: sorted(({"kind": k, "start": m.start(), "end": m.end(), "value": m[0]} for k, p in patterns for m in p.finditer(t or "")), key=lambda x: (x["start"], x["kind"])))


def normalize_prompt(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def parse_age(text: Column) -> Column:
    """Milliseconds of ages like 30d, 1.5h, 2M (months), 1y; null if it is no age."""
    n, unit = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*(ms|s|m|h|d|w|M|y)\s*$", 1), F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*(ms|s|m|h|d|w|M|y)\s*$", 2)
    sizes = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "M": 2_592_000_000, "y": 31_536_000_000}
    scale = F.coalesce(*[F.when(unit == u, F.lit(ms)) for u, ms in sizes.items()])
    return F.when(n != "", F.try_to_number(n, F.lit("999999999.999")).cast("double") * scale)


def parse_quota_age(text: Column) -> Column:
    """Milliseconds of whole ages like 30d, 1W, 24h, 60m, 30s in any case, where M is a minute too; null if it is no such age."""
    n, unit = F.regexp_extract(text, r"(?i)^(\d+)\s*(d|w|h|m|s)$", 1), F.lower(F.regexp_extract(text, r"(?i)^(\d+)\s*(d|w|h|m|s)$", 2))
    sizes = {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
    return F.when(n != "", n.cast("long") * F.coalesce(*[F.when(unit == u, F.lit(ms)) for u, ms in sizes.items()]))


#: English names of languages by their codes.
LANGUAGES = {
    "af": "Afrikaans", "am": "Amharic", "ar": "Arabic", "az": "Azerbaijani", "be": "Belarusian", "bg": "Bulgarian", "bn": "Bengali", "bs": "Bosnian", "ca": "Catalan", "ceb": "Cebuano",
    "co": "Corsican", "cs": "Czech", "cy": "Welsh", "da": "Danish", "de": "German", "el": "Greek", "en": "English", "eo": "Esperanto", "es": "Spanish", "et": "Estonian", "eu": "Basque",
    "fa": "Persian", "fi": "Finnish", "fr": "French", "fy": "Frisian", "ga": "Irish", "gd": "Scots Gaelic", "gl": "Galician", "gu": "Gujarati", "ha": "Hausa", "haw": "Hawaiian",
    "he": "Hebrew", "hi": "Hindi", "hmn": "Hmong", "hr": "Croatian", "ht": "Haitian Creole", "hu": "Hungarian", "hy": "Armenian", "id": "Indonesian", "ig": "Igbo", "is": "Icelandic",
    "it": "Italian", "ja": "Japanese", "jv": "Javanese", "ka": "Georgian", "kk": "Kazakh", "km": "Khmer", "kn": "Kannada", "ko": "Korean", "ku": "Kurdish", "ky": "Kyrgyz", "la": "Latin",
    "lb": "Luxembourgish", "lo": "Lao", "lt": "Lithuanian", "lv": "Latvian", "mg": "Malagasy", "mi": "Maori", "mk": "Macedonian", "ml": "Malayalam", "mn": "Mongolian", "mr": "Marathi",
    "ms": "Malay", "mt": "Maltese", "my": "Burmese", "ne": "Nepali", "nl": "Dutch", "no": "Norwegian", "ny": "Nyanja", "pa": "Punjabi", "pl": "Polish", "ps": "Pashto", "pt": "Portuguese",
    "ro": "Romanian", "ru": "Russian", "sd": "Sindhi", "si": "Sinhala", "sk": "Slovak", "sl": "Slovenian", "sm": "Samoan", "sn": "Shona", "so": "Somali", "sq": "Albanian", "sr": "Serbian",
    "st": "Sesotho", "su": "Sundanese", "sv": "Swedish", "sw": "Swahili", "ta": "Tamil", "te": "Telugu", "tg": "Tajik", "th": "Thai", "tl": "Tagalog", "tr": "Turkish", "uk": "Ukrainian",
    "ur": "Urdu", "uz": "Uzbek", "vi": "Vietnamese", "xh": "Xhosa", "yi": "Yiddish", "yo": "Yoruba", "zh": "Chinese", "zu": "Zulu",
}


def language_name(code: Column) -> Column:
    """The English name of a language code, or the code itself."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), code), code)


def content_text(content: Column) -> Column:
    """The text of a message that is a plain string, or a JSON array of parts of which those of type text are joined by blanks."""
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), " ")
    return F.when(content.startswith("[") & parts.isNotNull(), joined).otherwise(content)


def content_parts(content: Column) -> Column:
    """A message as parts array<struct<type, text>>: a plain string is one part of type text."""
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    return F.when(content.startswith("[") & parts.isNotNull(), parts).otherwise(F.array(F.struct(F.lit("text").alias("type"), content.alias("text"))))


def format_bytes(n: Column) -> Column:
    """B to TB with up to two decimals."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**i, F.concat(F.regexp_replace(F.format_string("%.2f", n.cast("double") / 1024**i), r"\.?0+$", ""), F.lit(f" {unit}"))).otherwise(out)
    return out


def format_duration(ms: Column) -> Column:
    """ms, s, m, h or d, the largest that fits, with one decimal."""
    out = F.concat(ms.cast("long").cast("string"), F.lit("ms"))
    for unit, size in (("s", 1000), ("m", 60_000), ("h", 3_600_000), ("d", 86_400_000)):
        out = F.when(ms >= size, F.concat(F.format_string("%.1f", ms.cast("double") / size), F.lit(unit))).otherwise(out)
    return out


def words(text: Column) -> Column:
    """Lower-case words between white space, for n-gram metrics."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
