"""Text functions: Column in, Column out, built-in functions only.

Patterns name Unicode classes or carry (?U): Java's \\w and \\s are ASCII otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Header patterns, page bounds, stop words, folding tables.
HEADER_RIGHT = r"(?iu)DE\s+JUSTICIA\s+DE\s+LA\s+NACI[ÓO]N\s+(\d{1,4})\b"
HEADER_LEFT = r"(?iu)\b(\d{1,4})\s+FALLOS\s+DE\s+LA\s+CORTE\s+SUPREMA"
HEADER_LINES = 3
MAX_OFFICIAL_PAGE = 5000
RUNNING_HEADERS = (
    r"\d{1,4}[ \t]+FALLOS DE LA CORTE SUPREMA[ \t]*",
    r"FALLOS DE LA CORTE SUPREMA[ \t]*",
    r"DE JUSTICIA DE LA NACI[ÓO]N(?:[ \t]+\d{1,4})?[ \t]*",
    r"[ \t]*\d{1,4}[ \t]*",
)
MAX_RUNNING_HEADERS = 4
#: Largest number that RUNNING_HEADERS take for a header whatever it counts.
MOST_SHORT = 9999
BROKEN_WORD = r"(\p{L})[ \t]*-[ \t]*\n[ \t]*([a-záéíóúñüïö])"
#: A whole word of is_small_caps().
SMALL_CAPS = r"(?<!\p{L})(?=\p{L}*\p{Lu})(?=\p{L}*\p{Ll})(?!\p{Lu}\p{Ll}+(?!\p{L}))\p{L}+"
NAME_PARTICLES = ("de", "del", "la", "y")
STOP_WORDS = tuple(
    """
    el la lo los las un una unos unas al del
    de a ante bajo cabe con contra desde durante en entre hacia hasta
    mediante para por según sin so sobre tras
    y e o u ni que pero mas sino aunque porque pues como si cuando mientras
    donde
    yo tú él ella ello nosotros vosotros ellos ellas me te se nos os le les
    mi mis tu tus su sus nuestro nuestra nuestros nuestras vuestro vuestra
    este esta esto estos estas ese esa eso esos esas
    aquel aquella aquello aquellos aquellas
    cual cuales quien quienes cuyo cuya cuyos cuyas
    otro otra otros otras mismo misma mismos mismas
    tan tanto tanta tantos tantas todo toda todos todas cada
    algún alguna alguno algunos algunas ningún ninguna ninguno
    mucho mucha muchos muchas poco poca pocos pocas más menos muy
    no sí ya así también tampoco siempre nunca solo sólo aún aun
    es son ser fue fueron era eran sea sean
    ha han haber hay había habían hubo está están estaba estar
    """.split()
)
#: A reference to a character, and names that stand without a semicolon too, which are read by their longest beginning.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
LEGACY_LENGTHS = range(2, 7)


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once. A lambda evaluates what stands in it anew for each element, so
    whatever costs and is used within one must come in as a variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def lines(c: Column) -> Column:
    return F.split(c, r"\R", -1)


def _folding() -> tuple[str, str]:
    """(letters and marks, plain letters): every small letter that decomposes to a letter and combining marks, then
    the marks themselves, which go. Made by that rule, so that composed and decomposed text fold alike."""
    found, plain = [], []
    for c in map(chr, range(0xC0, 0x2000)):
        d = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(d) > 1 and unicodedata.category(d[0])[0] == "L" and all(unicodedata.category(x)[0] == "M" for x in d[1:]):
            found.append(c)
            plain.append(d[0])
    return "".join(found) + "".join(map(chr, range(0x300, 0x370))), "".join(plain)


ACCENTED, PLAIN = _folding()
FOLDING = {ord(c): PLAIN[i] if i < len(PLAIN) else None for i, c in enumerate(ACCENTED)}


def fold(c: Column) -> Column:
    """Lower case without accents and other combining marks."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def fold_text(text: str) -> str:
    """fold() of a text on the driver, for queries."""
    return text.lower().translate(FOLDING)


def tokens(c: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def official_page(text: Column) -> Column:
    """The page number of the header within the first lines, null outside the bounds."""
    head = F.array_join(F.slice(F.split(text, r"\R", HEADER_LINES + 1), 1, HEADER_LINES), "\n")
    found = [F.nullif(F.regexp_extract(head, p, 1), F.lit("")).cast("int") for p in (HEADER_RIGHT, HEADER_LEFT)]
    n = F.coalesce(*found)
    return F.when(n.between(1, MAX_OFFICIAL_PAGE), n)


def strip_headers(text: Column, volume: Column | None = None) -> Column:
    """Without the running headers that lead the page, up to MAX_RUNNING_HEADERS of them. The number of the page's volume, if it is
    given, is one however long it is; any other number has four digits at most."""
    unit = "|".join(RUNNING_HEADERS)
    begin, end = rf"(?iu)\A(?:(?:{unit}", rf")(?:\R|\z)){{1,{MAX_RUNNING_HEADERS}}}"
    usual = F.regexp_replace(text, begin + end, "")
    if volume is None:
        return usual
    of_volume = F.concat(F.lit(begin + r"|[ \t]*"), volume.cast("string"), F.lit(r"[ \t]*" + end))
    return F.when(volume > MOST_SHORT, F.regexp_replace(text, of_volume, F.lit(""))).otherwise(usual)


def join_broken_words(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("-")), F.regexp_replace(text, BROKEN_WORD, "$1$2")).otherwise(text)


def is_small_caps(word: Column) -> Column:
    """Upper and lower case mixed in another way than a capital and small letters."""
    return word.rlike(r"\p{Lu}") & word.rlike(r"\p{Ll}") & ~word.rlike(r"^\p{Lu}\p{Ll}+$")


def capitalize(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30)))


def title_small_caps(text: Column) -> Column:
    """Words in small caps with one capital; only these are taken out of the text and put back."""
    found = F.regexp_extract_all(text, F.lit(SMALL_CAPS), F.lit(0))
    whole = F.zip_with(F.split(text, SMALL_CAPS, -1), F.transform(found, capitalize), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.rlike(SMALL_CAPS), F.array_join(whole, "")).otherwise(text)


def clean_page(text: Column, volume: Column | None = None) -> Column:
    """Headers off, broken words joined, small caps as titles, ends trimmed; applying it twice changes nothing."""
    return let(strip_headers(text, volume), lambda body: let(join_broken_words(body), lambda joined: strip(title_small_caps(joined))))


def word_windows(text: Column, target: int = 400, overlap: int = 80) -> Column:
    """Windows of `target` words that overlap by `overlap`; a short text is one window, none is none."""
    if target <= 0 or not 0 <= overlap < target:
        raise ValueError("target must be positive and overlap from 0 to below it")
    step = target - overlap

    def cut(w: Column) -> Column:
        n = F.size(w)
        k = F.when(n == 0, 0).when(n <= target, 1).otherwise(1 + F.ceil((n - target) / step)).cast("int")
        starts = F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(w, i * step + 1, target))

    return let(words(text), cut)


def query_terms(query: Column) -> Column:
    """Lower-case words of three letters and more that are no stop words, in order, once each."""
    found = F.regexp_extract_all(F.lower(query), F.lit(r"(?U)\w+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 2) & ~F.array_contains(lit_array(STOP_WORDS), t)))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _code_point(n: Column) -> Column:
    """The character of a number, as browsers read it: controls of Latin-1 are those of Windows, what is no character is nothing or U+FFFD."""
    windows = {str(i): bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0)}
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    none = n.between(0x01, 0x08) | n.between(0x0E, 0x1F) | n.isin(0x0B, 0x7F) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    odd = n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    return F.when(odd, "\ufffd").when(n.between(0x80, 0x9F), F.try_element_at(_map(windows), n.cast("string"))).when(none, "").otherwise(plain)


def _reference(e: Column) -> Column:
    """What a match of REFERENCE stands for; an unknown name stays as it is."""
    digits = F.regexp_replace(e, "[&#xX;]", "")
    number = F.when(e.rlike("^&#[xX]"), F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 8, F.conv(digits, 16, 10).cast("long"))).otherwise(digits.try_cast("long"))
    name = F.substring(e, 2, 33)
    whole = {k: v for k, v in html5.items() if k.endswith(";")}
    legacy = _map({k: v for k, v in html5.items() if not k.endswith(";")})
    begins = [F.concat(F.try_element_at(legacy, F.substring(name, 1, n)), F.substring(name, n + 1, 33)) for n in reversed(LEGACY_LENGTHS)]
    usual = F.when(name == "amp;", "&").when(name == "nbsp;", "\xa0").when(name == "lt;", "<").when(name == "gt;", ">").when(name == "quot;", '"')
    return F.when(e.startswith("&#"), _code_point(number)).otherwise(F.coalesce(usual, F.try_element_at(_map(whole), name), *begins, e))


def unescape(c: Column) -> Column:
    """HTML references to characters, by name or number, read once each; the names are those of HTML 5."""
    return let(c, lambda t: F.when(~t.contains("&"), t).otherwise(F.array_join(F.zip_with(F.split(t, REFERENCE, -1), F.transform(F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0)), _reference), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")))


def html_to_text(html: Column) -> Column:
    """Tags become spaces, references characters, runs of white space one space. A null is empty."""
    return collapse(unescape(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " ")))


def capitalize_name(name: Column, hyphens: bool = False) -> Column:
    """Words capitalised, particles left as they are; with hyphens, each part of a compound too."""
    keep = NAME_PARTICLES + (("e",) if hyphens else ())
    cap = (lambda w: F.array_join(F.transform(F.split(w, "-"), capitalize), "-")) if hyphens else capitalize
    return F.array_join(F.transform(words(name), lambda w: F.when(F.lower(w).isin(*keep), w).otherwise(cap(w))), " ")


def _last_space_before(text: Column, at: Column) -> Column:
    """Start of the word that holds position `at` (0-based), or `at` if a word starts there."""
    return at - F.length(F.regexp_extract(F.substring(text, F.lit(1), at), r"(\S*)\z", 1))


def _next_word(text: Column, at: Column) -> Column:
    """First position from `at` on where a word starts (0-based), or the end."""
    rest = F.substring(text, at + 1, F.length(text))
    before = F.substring(text, at, F.lit(1))
    return F.when((at <= 0) | (at >= F.length(text)) | (before == " "), F.greatest(at, F.lit(0))).otherwise(at + F.length(F.regexp_extract(rest, r"\A(\S*\s*)", 1)))


def snippet(text: Column, terms: Column, window: int = 220) -> Column:
    """About `window` characters around the first term: whole words, from the start of the sentence if it is near.

    Without a term, the beginning. Ellipses mark what was cut, but not before a sentence.
    """
    return let(collapse(text), lambda plain: let(F.array_min(F.filter(F.transform(terms, lambda t: F.instr(F.lower(plain), t)), lambda i: i > 0)) - 1, lambda at: _around(plain, at, window)))


def _around(plain: Column, at: Column, window: int) -> Column:
    n = F.length(plain)
    back = F.greatest(F.lit(0), at - window // 2)
    near = F.substring(plain, back + 1, at - back)
    upto = F.length(F.regexp_extract(near, r"(?s)\A(.*[.?!]\s+(?=[A-ZÁÉÍÓÚÜÑ]))", 1))
    sentence = F.when(upto > 0, back + upto)
    forward = _next_word(plain, F.greatest(F.lit(0), at - window // 3))
    start = F.coalesce(sentence, F.when(forward > at, _last_space_before(plain, at)).otherwise(forward))
    clean = sentence.isNotNull() | (start == 0)
    end = _last_space_before(plain, F.least(n, F.greatest(at + 2 * window // 3, start + window)))
    end = F.when(end <= at, F.least(n, start + window)).otherwise(end)
    body = F.trim(F.substring(plain, start + 1, end - start))
    around = F.concat(F.when(clean, "").otherwise("…"), body, F.when(end >= n, "").otherwise("…"))
    stop = _last_space_before(plain, F.lit(window))
    head = F.concat(F.rtrim(F.substring(plain, F.lit(1), F.when(stop > 0, stop).otherwise(window))), F.lit("…"))
    return F.when(n <= window, plain).when(at.isNull(), head).otherwise(around)


def highlight(text: Column, terms: list[str]) -> Column:
    """Whole words among terms between <mark> and </mark>, whatever their case."""
    if not terms:
        return text
    any_ = "|".join("".join(c if c.isalnum() else "\\" + c for c in t) for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}])({any_})(?![\p{{L}}\p{{N}}])", "<mark>$1</mark>")


def cite_query(query: Column) -> Column:
    """`volume:page` if the query is a citation, else null."""
    p = r"(?i)\A\s*(?:fallos\s*:?\s*)?(\d{1,3})\s*:\s*(\d{1,4})\s*\z"
    return F.when(query.rlike(p), F.concat_ws(":", F.regexp_extract(query, p, 1).cast("int"), F.regexp_extract(query, p, 2).cast("int")))


def volume_of_file(name: Column) -> Column:
    """First run of two to four digits of a file name."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(name, "/"), -1), r"(\d{2,4})", 1), F.lit("")).cast("int")


def page_link(url: Column, pdf_page: Column) -> Column:
    """A link to a page of a PDF; to the file where the page isn't known."""
    return F.when(pdf_page.isNull(), url).otherwise(F.concat(url, F.lit("#page="), pdf_page.cast("string")))
