"""Plain text, title and metadata of HTML by regular expressions, so that it stays in the JVM and SQL can check it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that go with their content.
IGNORED = ("script", "style", "nav", "header", "footer", "aside", "noscript")
#: Named character references, decoded in this order.
ENTITIES = {
    "&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&ndash;": "–", "&mdash;": "—", "&lsquo;": "‘", "&rsquo;": "’",
    "&ldquo;": "“", "&rdquo;": "”", "&hellip;": "…", "&copy;": "©", "&reg;": "®", "&trade;": "™", "&euro;": "€", "&pound;": "£", "&yen;": "¥", "&cent;": "¢",
}


def without_elements(html: Column, ignored: tuple[str, ...] = IGNORED) -> Column:
    for tag in ignored:
        html = F.regexp_replace(html, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
        html = F.regexp_replace(html, rf"(?is)<{tag}[^>]*/>", "")
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def decoded(text: Column) -> Column:
    """Named references, then numeric ones; one after the other, so that a reference made by an earlier step is decoded too."""
    for entity, char in ENTITIES.items():
        text = F.regexp_replace(text, f"(?i){entity}", char)
    parts = F.split(text, r"&#(?=\d+;|x[a-fA-F0-9]+;)")
    tail = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(_char(F.substring_index(p, ";", 1)), F.regexp_replace(p, r"^[^;]*;", "")))
    return F.when(F.size(parts) > 1, F.concat(F.element_at(parts, 1), F.array_join(tail, ""))).otherwise(text)


def _char(ref: Column) -> Column:
    """The character of a decimal or hexadecimal reference, by way of UTF-32."""
    point = F.when(ref.startswith("x"), F.conv(F.substring(ref, 2, 8), 16, 10)).otherwise(ref).cast("long")
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def html_text(html: Column, ignored: tuple[str, ...] = IGNORED, keep_lines: bool = False) -> Column:
    """The text between the tags, white space collapsed; with keep_lines, block ends start a new line."""
    text = without_elements(F.coalesce(html, F.lit("")), ignored)
    if not keep_lines:
        return F.trim(F.regexp_replace(decoded(F.regexp_replace(text, r"<[^>]+>", " ")), r"\s+", " "))
    text = F.regexp_replace(text, r"(?i)</(p|div|h[1-6]|li|tr)[^>]*>|<br\s*/?>", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)<hr\s*/?>", "\n---\n"), r"(?i)<li[^>]*>", "\n• ")
    lines = F.transform(F.split(decoded(F.regexp_replace(text, r"<[^>]+>", " ")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def html_title(html: Column) -> Column:
    """Null if there is none."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<title[^>]*>(.*?)</title>"), F.lit(1))
    return F.trim(F.get(found, F.lit(0)))


def html_meta(html: Column) -> Column:
    """A map of meta names (or properties) and contents; the last of equals counts."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\s[^>]*>)"), F.lit(1))
    pair = lambda t: F.struct(F.regexp_extract(t, r"(?i)(?:name|property)=[\"']([^\"']+)[\"']", 1).alias("k"), F.regexp_extract(t, r"(?i)content=[\"']([^\"']+)[\"']", 1).alias("v"))
    pairs = F.filter(F.transform(tags, pair), lambda x: (x["k"] != "") & (x["v"] != ""))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.map_from_arrays(F.array(x["k"]), F.array(x["v"]))))


def slug(title: Column) -> Column:
    """An id of up to 50 characters: lower-case letters and digits, the rest as single dashes."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "-"), r"^-|-$", ""), 1, 50)
