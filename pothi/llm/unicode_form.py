"""One consistent form for text that looks the same but is coded differently.

The normalisation quick-check properties say which characters can never, or
may not, stand in composed text.  Only the words around such characters are
rewritten; everything else is copied unchanged, and a text without any of them
never leaves the JVM.

The form: composed letters (Bengali letters with nukta stay decomposed, as the
composition exclusions ask), plain spaces and newlines, no invisible
characters, ordinary width, each word in letters of its own script.

Defined results: null stays null, an empty text stays empty; every other text
is rewritten whole, however long.  The form is idempotent.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like a Latin letter.
LATIN_TWINS = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M",
    "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q",
    "Ԝ": "W", "а": "a", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o",
    "р": "p", "ԛ": "q", "с": "c", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v",
    "ρ": "p", "α": "a", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g",
    "ı": "i", "Ӏ": "I", "г": "r", "к": "k", "м": "m", "т": "t", "ь": "b", "п": "n",
}
# Bengali spellings that look like another letter.
BENGALI_TWINS = {"অা": "আ", "ব়": "র"}


def _chars(*ranges: int | tuple[int, int]) -> str:
    """Body of a character class made of code points and ranges of them."""
    return "".join(
        f"\\U{r:08x}" if isinstance(r, int) else f"\\U{r[0]:08x}-\\U{r[1]:08x}" for r in ranges
    )


HASANTA = _chars(0x94D, 0x9CD, 0xA4D, 0xACD, 0xB4D, 0xBCD, 0xC4D, 0xCCD, 0xD4D)
JOINERS = _chars(0x200C, 0x200D)
#: Invisible and control characters that are never kept (joiners are judged by their neighbours).
INVISIBLE = _chars(
    (0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), 0xAD, 0x34F, 0x61C, (0x115F, 0x1160),
    (0x17B4, 0x17B5), (0x180B, 0x180F), 0x200B, (0x200E, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    0x3164, (0xFE00, 0xFE0F), 0xFEFF, 0xFFA0, (0xFFF9, 0xFFFB),
)
SPACES = _chars(0x09, 0xA0, 0x1680, (0x2000, 0x200A), 0x202F, 0x205F, 0x3000)
BREAKS = _chars((0x0B, 0x0D), 0x85, (0x2028, 0x2029))
#: Latin ligatures, full-width and half-width forms.
WIDTHS = _chars((0xFB00, 0xFB06), (0xFF01, 0xFF9F), (0xFFA1, 0xFFDC), (0xFFE0, 0xFFE6), (0xFFE8, 0xFFEE))
GREEK_CYRILLIC = _chars((0x370, 0x3FF), (0x400, 0x52F))
MARKS = _chars((0x300, 0x36F))


def _escape(chars: set[str]) -> str:
    return "".join(re.escape(c) for c in sorted(chars))


def _quick_check() -> str:
    """Pattern of the places where the composed form may be violated.

    Characters whose quick check is No stand for themselves; those whose quick
    check is Maybe count only after a character that they compose with, unless
    they compose with so many that any place counts.
    """
    never: set[str] = set()
    after: dict[str, set[str]] = {}
    for code in range(0xA0, 0x10000):
        c = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        parts = unicodedata.decomposition(c)
        if not parts or parts[0] == "<":
            continue
        if not unicodedata.is_normalized("NFC", c):
            never.add(c)
        elif " " in parts:
            first, second = (chr(int(x, 16)) for x in parts.split())
            after.setdefault(second, set()).add(first)
    anywhere = {c for c, firsts in after.items() if len(firsts) > 12}
    pairs = [f"[{_escape(firsts)}]{c}" for c, firsts in after.items() if c not in anywhere]
    return "|".join([f"[{_escape(never | anywhere)}{_chars((0x1161, 0x11FF))}]", *pairs])


UNSTABLE = re.compile(
    f"[{INVISIBLE}{SPACES}{BREAKS}{WIDTHS}{JOINERS}{''.join(LATIN_TWINS)}]|"
    + "|".join(BENGALI_TWINS)
    + f"|[{HASANTA}][{_chars(0x93C, 0x9BC)}]|"
    + _quick_check()
)
#: What Java sees before a text is handed on; it matches at least wherever UNSTABLE does.
MAYBE_UNSTABLE = (
    "[^\\n\\x20-\\x7e\\u00a1-\\u00ac\\u00ae-\\u0130\\u0132-\\u0250\\u0252-\\u0260\\u0262-\\u02ff"
    "\\u0900-\\u0957\\u0960-\\u09db\\u09de\\u09e0-\\u09ff\\u2010-\\u2027\\u2030-\\u205e\\u2070-\\u20cf]"
    "|\\u0131|\\u0340|\\u09c7[\\u09be\\u09d7]|\\u0985\\u09be|\\u09ac\\u09bc|[\\u094d\\u09cd]\\u09bc|[\\u0928\\u0930\\u0933]\\u093c"
)

_plain = {c: " " for c in range(0x10000) if re.match(f"[{SPACES}]", chr(c))} | {
    c: "\n" for c in range(0x10000) if re.match(f"[{BREAKS}]", chr(c))
}
_white = re.compile(r"\s")
_drop = re.compile(f"[{INVISIBLE}]")
_joiner = re.compile(f"(?<![{HASANTA}])[{JOINERS}]+(?![{HASANTA}])")
_widths = re.compile(f"[{WIDTHS}]+")
_latin = re.compile("[A-Za-z" + _chars((0xC0, 0x24F)) + "]")
_foreign = re.compile(f"[{GREEK_CYRILLIC}]")
_twin = re.compile("[" + "".join(LATIN_TWINS) + "]")
_bengali = re.compile("|".join(BENGALI_TWINS))
_runs = re.compile(rf"[^\W\d_]+(?:[{MARKS}]+[^\W\d_]*)*")


def _own_script(run: re.Match) -> str:
    """A run of letters in the script of its own letters."""
    word = run.group()
    foreign = _foreign.findall(word)
    if not foreign and "ɑ" not in word and "ɡ" not in word and "ı" not in word:
        return word
    if _latin.search(word) or (len(word) > 1 and all(c in LATIN_TWINS for c in foreign)):
        return _twin.sub(lambda m: LATIN_TWINS[m.group()], word)
    if len(word) == 1 and 0x400 <= ord(word) <= 0x52F:
        return LATIN_TWINS.get(word, word)
    return word


def _step(word: str) -> str:
    word = _joiner.sub("", _drop.sub("", word))
    word = _widths.sub(lambda m: unicodedata.normalize("NFKC", m.group()), word)
    word = unicodedata.normalize("NFC", word)
    word = _runs.sub(_own_script, word)
    return unicodedata.normalize("NFC", _bengali.sub(lambda m: BENGALI_TWINS[m.group()], word))


def canonical_word(word: str) -> str:
    """The consistent form of a word, that is of text without white space.

    What one rule makes may be subject to another, so the rules are applied
    until nothing changes; each only removes, merges or maps into the form.
    """
    while (changed := _step(word)) != word:
        word = changed
    return word


def canonical(text: str | None) -> str | None:
    """The consistent form of a text: unstable words rewritten, the rest spliced in unchanged."""
    if not text:
        return text
    hit = UNSTABLE.search(text)
    if hit is None:
        return text
    out, done, size = [], 0, len(text)
    while hit is not None:
        at = hit.start()
        if text[at].isspace():
            out += text[done:at], ("\n" if text.startswith("\r\n", at) else _plain.get(ord(text[at]), text[at]))
            done = at + 1 + text.startswith("\r\n", at)
        else:
            left = at
            while left > done and not text[left - 1].isspace():
                left -= 1
            space = _white.search(text, at)
            right = space.start() if space else size
            out += text[done:left], canonical_word(text[left:right])
            done = right
        hit = UNSTABLE.search(text, done)
    out.append(text[done:])
    return "".join(out)


@F.pandas_udf(T.StringType())
def _canonical_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(canonical, na_action="ignore").astype(object)


def canonical_column(text: Column) -> Column:
    """Consistent form of a string column; only texts with unstable places go to Python."""
    return F.coalesce(_canonical_udf(F.when(text.rlike(MAYBE_UNSTABLE), text)), text)


def normalise(df: DataFrame, fields: list[str]) -> DataFrame:
    """``df`` with the named string columns in the consistent form; other columns stay as they are."""
    return df.withColumns({f: canonical_column(F.col(f"`{f}`")) for f in fields})


def unstable_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row (key, field) for each value that is not in the consistent form; repeats count once."""
    forms = F.array(
        *(
            F.when(F.col(f"`{f}`") != canonical_column(F.col(f"`{f}`")), F.lit(f))
            for f in fields
        )
    )
    return (
        df.select(F.col(f"`{key}`").alias(key), F.explode(F.array_compact(forms)).alias("field"))
        .distinct()
    )
