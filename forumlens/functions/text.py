"""Text predicates and the cleaning chain, as Spark expressions.

The patterns follow the Unicode rules of the usual scripting dialect: a word character is a letter, a
number or an underscore, and white space includes the separators U+001C to U+001F.
"""

from __future__ import annotations

import html
import json
import re
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from forumlens import fixed_values as V

# every white space character, spelled out: a plain class is much faster than a Unicode property
SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{SPACE_CLASS}]"
NOT_SPACE = f"[^{SPACE_CLASS}]"
PLAIN_NOT_SPACE = r"[!-~\x00-\x08\x0e-\x1b\x7f]"
SPACE_CHARACTERS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"

# Entities that replacement handles inside the JVM; the ampersand comes last, so that nothing is
# decoded twice.
COMMON_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"),
    ("&nbsp;", "\u00a0"), ("&#x200B;", "\u200b"), ("&#x200b;", "\u200b"), ("&amp;", "&"),
]
_COMMON_NAMES = "|".join(re.escape(name[1:-1]) for name, _ in COMMON_ENTITIES)
RARE_ENTITY = rf"&(?!(?:{_COMMON_NAMES});)[#A-Za-z]"


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def flag(condition: Column) -> Column:
    """A condition whose null counts as false."""
    return F.coalesce(condition, F.lit(False))


def let(column: Column | str, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` looks at it.

    Without it a chain of steps that each test and then change their input would contain the first step
    many times over.
    """
    if isinstance(column, str):
        return use(F.col(column))
    return F.element_at(F.transform(F.array(column), use), 1)


def only_if(column: Column | str, test, change) -> Column:
    """Run a costly replacement only on text that can hold what it replaces; the tests read bytes."""
    return let(column, lambda c: F.when(test(c), change(c)).otherwise(c))


def mentions(column: Column | str, keyword: str = V.KEYWORD) -> Column:
    """The keyword as a whole word in any case; null text does not mention it.

    The neighbours are looked at behind the word, so a position without the word costs one comparison. A
    plain search in the lower-case text goes first; i and s have further forms that it would miss.
    """
    word = re.escape(keyword)
    pattern = rf"(?iu){word}(?<!{WORD}{word})(?!{WORD})"
    if not keyword.isascii() or set(keyword.lower()) & set("is"):
        return flag(_col(column).rlike(pattern))
    return flag(let(column, lambda c: F.lower(c).contains(keyword.lower()) & c.rlike(pattern)))


def mentions_any(columns: list[str], keyword: str = V.KEYWORD) -> Column:
    return reduce(lambda a, b: a | b, [mentions(c, keyword) for c in columns])


def contains_keyword(column: Column | str, keyword: str = V.KEYWORD) -> Column:
    """The keyword as a substring in any case; null stays null."""
    return F.lower(_col(column)).contains(keyword.lower())


def strip(column: Column | str) -> Column:
    """White space off both ends."""
    return F.btrim(_col(column), F.lit(SPACE_CHARACTERS))


def strip_id_prefix(column: Column | str, pattern: str = V.ID_PREFIX) -> Column:
    return F.regexp_replace(_col(column), pattern, "")


def is_placeholder(column: Column | str, value: str) -> Column:
    return flag(_col(column) == value)


def without_placeholders(column: Column | str, values: tuple[str, ...] = (V.DELETED, V.REMOVED)) -> Column:
    c = _col(column)
    return F.when(flag(c.isin(list(values))), F.lit("")).otherwise(F.coalesce(c, F.lit("")))


def is_junk_title(column: Column | str, pattern: str = V.JUNK_TITLE) -> Column:
    """The title is one of the known non-content titles."""
    unicode_pattern = (
        pattern.replace(r"\W", NOT_WORD).replace(r"\s", SPACE).replace("^", r"\A", 1)
    )
    if unicode_pattern.endswith("$"):
        unicode_pattern = unicode_pattern[:-1] + r"\z"
    return flag(_col(column).rlike("(?iu)" + unicode_pattern))


def without_quotes(column: Column | str) -> Column:
    """Drop quoted lines. The ``d`` flag makes the line feed the only line end."""
    pattern = V.QUOTE_LINE.replace("(?m)", "(?md)")
    return only_if(column, lambda c: c.contains(">") | c.contains("&gt;"), lambda c: F.regexp_replace(c, pattern, ""))


def links_to_text(column: Column | str) -> Column:
    return only_if(column, lambda c: c.contains("]("), lambda c: F.regexp_replace(c, V.MARKDOWN_LINK, "$1"))


def without_urls(column: Column | str) -> Column:
    pattern = V.URL.replace(r"\S", NOT_SPACE)
    return only_if(column, lambda c: c.contains("://") | c.contains("www."), lambda c: F.regexp_replace(c, pattern, ""))


def without_zero_width(column: Column | str) -> Column:
    return F.replace(_col(column), F.lit(V.ZERO_WIDTH_SPACE), F.lit(""))


def collapse_space(column: Column | str) -> Column:
    """Blanks to one, runs around a line feed to the line feed, ends stripped."""
    blanks = only_if(column, lambda c: c.contains("  ") | c.contains("\t"),
                     lambda c: F.regexp_replace(c, r"[ \t]{2,}|\t", " "))

    def lines(c: Column) -> Column:
        stripped = F.transform(F.split(c, "\n", -1), strip)
        return F.array_join(F.filter(stripped, lambda line: line != ""), "\n")

    return let(blanks, lambda c: F.when(c.contains("\n"), lines(c)).otherwise(strip(c)))


def _entity_names() -> tuple[dict, dict]:
    """Character references by name: with their semicolon, and the old ones that may lack it."""
    closed = {name: value for name, value in html5.items() if name.endswith(";")}
    return closed, {name: value for name, value in html5.items() if not name.endswith(";")}


def _special_numbers() -> dict:
    """Numeric references that do not stand for the character of that number."""
    numbers = [*range(0, 160), *range(0xFDD0, 0xFDF0), *[plane * 0x10000 + last for plane in range(17) for last in (0xFFFE, 0xFFFF)]]
    decoded = {n: html.unescape(f"&#{n};") for n in numbers}
    return {str(n): text for n, text in decoded.items() if text != chr(n)}


def _table(mapping: dict) -> Column:
    return F.from_json(F.lit(json.dumps(mapping)), "map<string,string>")


def _character(number: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _decode_after_ampersand(part: Column) -> Column:
    """Decode the reference at the start of the text behind an ampersand, or put the ampersand back."""
    decimal = F.regexp_extract(part, r"^#([0-9]+);?", 1)
    hexadecimal = F.regexp_extract(part, r"^#[xX]([0-9a-fA-F]+);?", 1)
    closed = F.regexp_extract(part, r"^([^\t\n\f <&#;]{1,32};)", 1)
    opened = F.regexp_extract(part, r"^([^\t\n\f <&#;]{1,32})", 1)
    with_semicolon, without_semicolon = _entity_names()
    names, old_names = _table(with_semicolon), _table(without_semicolon)
    # the longest start of the word that is an old name
    starts = F.filter(F.transform(F.sequence(F.length(opened), F.lit(1), F.lit(-1)), lambda n: F.substring(opened, 1, n)),
                      lambda start: F.map_contains_key(old_names, start))
    start = F.try_element_at(starts, F.lit(1))

    # digits are cut to what can still be a code point; more of them are out of range anyway
    def number(digits: Column, base: int) -> Column:
        significant = F.regexp_replace(digits, "^0+(?=.)", "")
        return F.when(F.length(significant) <= 8, F.conv(significant, base, 10).cast("bigint")).otherwise(F.lit(1 << 40))

    def from_number(digits: Column, base: int, pattern: str) -> Column:
        n = number(digits, base)
        special = F.try_element_at(_table(_special_numbers()), n.cast("string"))
        text = (F.when(special.isNotNull(), special)
                .when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit("\ufffd")).otherwise(_character(n)))
        return F.concat(text, F.regexp_replace(part, pattern, ""))

    known = F.try_element_at(names, closed)
    return (F.when(decimal != "", from_number(decimal, 10, r"^#[0-9]+;?"))
            .when(hexadecimal != "", from_number(hexadecimal, 16, r"^#[xX][0-9a-fA-F]+;?"))
            .when((closed != "") & known.isNotNull(), F.concat(known, F.substr(part, F.length(closed) + 1)))
            .when((opened != "") & start.isNotNull(),
                  F.concat(F.try_element_at(old_names, start), F.substr(part, F.length(start) + 1)))
            .otherwise(F.concat(F.lit("&"), part)))


def _decode_every_entity(column: Column) -> Column:
    """All named and numeric references, left to right, each once."""
    parts = F.split(column, "&", -1)
    decoded = F.transform(F.slice(parts, 2, F.size(parts)), _decode_after_ampersand)
    return F.concat(F.element_at(parts, 1), F.array_join(decoded, ""))


def decode_entities(column: Column | str, full_table: bool = True) -> Column:
    """Decode character references once.

    Common ones are replaced. With ``full_table`` a text that holds any other reference takes the longer
    way over the whole table; both ways stay inside the JVM.
    """
    def decode(c: Column) -> Column:
        common = reduce(lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), COMMON_ENTITIES, c)
        return F.when(c.rlike(RARE_ENTITY), _decode_every_entity(c)).otherwise(common) if full_table else common

    return only_if(column, lambda c: c.contains("&"), decode)


def own_words(column: Column | str) -> Column:
    """Quotes, link targets and addresses removed; null becomes the empty text."""
    return without_urls(links_to_text(without_quotes(F.coalesce(_col(column), F.lit("")))))


def readable(column: Column | str, full_table: bool = True) -> Column:
    """Entities decoded and space collapsed."""
    return collapse_space(without_zero_width(decode_entities(column, full_table)))


def clean_text(column: Column | str, full_table: bool = True) -> Column:
    """The author's own words: quotes, links, addresses, entities and extra space removed, in this order."""
    return readable(own_words(column), full_table)


def title_and_body(title: Column | str, body: Column | str) -> Column:
    parts = [F.coalesce(_col(title), F.lit("")), F.coalesce(_col(body), F.lit(""))]
    return strip(F.concat(parts[0], F.lit("\n\n"), parts[1]))


def word_count(column: Column | str) -> Column:
    """Runs of characters that are not white space; plain text takes a class that its first test settles."""
    def count(c: Column) -> Column:
        return F.when(F.length(c) == F.octet_length(c), F.regexp_count(c, F.lit(PLAIN_NOT_SPACE + "++"))).otherwise(
            F.regexp_count(c, F.lit(NOT_SPACE + "++")))

    return let(column, count)


def length_window(column: Column | str, low: int = V.MIN_WORDS, high: int = V.MAX_WORDS) -> Column:
    return flag(word_count(column).between(low, high))


def truncate(column: Column | str, limit: int = V.TEXT_MAX_CHARS) -> Column:
    return F.substring(_col(column), 1, limit)


def snippet(column: Column | str, limit: int = 160) -> Column:
    """One line of at most ``limit`` characters for a listing."""
    return F.substring(F.regexp_replace(_col(column), f"{SPACE}+", " "), 1, limit)


def ends_with_question(column: Column | str) -> Column:
    return flag(strip(column).endswith("?"))


def escape_newlines(column: Column | str) -> Column:
    """Line ends as two-character escapes, so that one answer is one line."""
    c = F.replace(_col(column), F.lit("\r"), F.lit("\\r"))
    return F.replace(c, F.lit("\n"), F.lit("\\n"))


def question_key(column: Column | str, words: int = 12) -> Column:
    """A comparable form of a question text: numbering dropped, at most ``words`` words."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(_col(column)), "[^a-z0-9 ]", " "), " +", " "))
    numbered = F.regexp_replace(plain, r"^(?:(?:qa?|[a-z]*[0-9][a-z0-9]*)(?: |$))+", "")
    return F.array_join(F.slice(F.split(numbered, " "), 1, words), " ")
