"""String functions on columns: digits, white space, preambles, normal form, stems, query expansion, names of files.

White space means what Python's ``str.split`` splits at.  Null goes in, null
comes out, unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BENGALI_DIGITS, ASCII_DIGITS = "০১২৩৪৫৬৭৮৯", "0123456789"


def _nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)


# Fixed value: phrases that models put before an answer.
PREAMBLE = (
    r"^(based on (the )?(passage|context|text)[^,]*,?\s*|according to (the )?(passage|context|text)[^,]*,?\s*|the answer is[:\s]*|"
    r"from the (passage|context|text)[^,]*,?\s*|as (mentioned|stated|given) in (the )?(passage|context|text)[^,]*,?\s*)"
)
# Fixed value: characters that the normal form of an answer replaces by a blank.
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~।]"""
# Fixed value: inflectional endings, Bengali and English.
SUFFIXES = _nfc(
    "(টির?|টা|গুলো(র|কে|তে)?|এর|কে|তে|তেই|র|ের|য়ের|কেই|ওয়া|আনো|ানো|িয়ে|য়ে|ছে|ছেন|গেছে|হয়েছে|করেছে|"
    "tion|ing|ness|ment|ity|ies|ed|er|est|ly)$"
)
# Fixed value: question words that carry no lexical signal at the beginning of a query.
QUESTION_OPENING = _nfc("^(কী|কি|কেন|কীভাবে|কোথায়|কখন|কে|কাকে|কার|কোন|what is|what are|why is|how does|how is|where is|who is)")
# Fixed value: names of book files.
FILENAME = r"^(.+?)_(ben|eng)_class(\d+)\.pdf$"
# Lookups of the enrichment step.
SUBJECT_CODES = {"ICT": "ict", "Science": "science"}
GRADE_BANDS = {6: "junior_sec", 7: "junior_sec", 8: "junior_sec", 9: "ssc", 10: "ssc"}
SCRIPTS = {"bn": "bengali", "en": "latin"}
LANGUAGE_CODES = {"ben": "bn", "eng": "en"}
PASSAGE_PREFIX, QUERY_PREFIX = "passage: ", "query: "


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def tokens(c: Column) -> Column:
    """Lower-case words; an empty text has none."""
    return F.filter(F.split(F.lower(c), f"{WS}+"), lambda x: x != "")


def fold_digits(c: Column) -> Column:
    return F.translate(c, BENGALI_DIGITS, ASCII_DIGITS)


def strip_preamble(c: Column) -> Column:
    """Without one leading preamble; it may take a whole answer that has no comma."""
    return strip(F.regexp_replace(c, "(?iuU)" + PREAMBLE, ""))


def normal_form(c: Column) -> Column:
    """Form in which answers are compared."""
    plain = F.regexp_replace(F.lower(fold_digits(strip_preamble(c))), PUNCTUATION, " ")
    return strip(F.regexp_replace(plain, f"{WS}+", " "))


def stem(token: Column) -> Column:
    """Token without its first ending, when it has more than five characters and three are left."""
    short = F.regexp_replace(token, SUFFIXES, "")
    return F.when((F.char_length(token) > 5) & (F.char_length(short) >= 3), short).otherwise(token)


def stemmed_tokens(c: Column) -> Column:
    return F.transform(tokens(c), stem)


def expand_query(c: Column) -> Column:
    """The query, followed by its form with folded digits and without an opening question word where that differs."""
    plain = strip(F.regexp_replace(fold_digits(c), f"(?iu){QUESTION_OPENING}{WS}+", ""))
    return F.when(plain != c, F.concat_ws(" ", c, plain)).otherwise(c)


def lookup(values: dict, c: Column, default: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, c), default)


def subject_code(subject: Column) -> Column:
    return lookup(SUBJECT_CODES, subject, F.lower(subject))


def grade_band(class_num: Column) -> Column:
    return lookup(GRADE_BANDS, class_num, F.lit("unknown"))


def script(lang_code: Column) -> Column:
    return lookup(SCRIPTS, lang_code, F.lit("latin"))


def parse_filename(name: Column) -> Column:
    """Struct (subject, lang, lang_code, class_num, folder_key) of a book file; null where the name does not fit."""
    pattern = "(?i)" + FILENAME
    lang = F.lower(F.regexp_extract(name, pattern, 2))
    code = F.when(lang == "ben", "bn").otherwise("en")
    number = F.regexp_extract(name, pattern, 3).try_cast("int")
    return F.when(
        name.rlike(pattern),
        F.struct(
            F.regexp_extract(name, pattern, 1).alias("subject"),
            lang.alias("lang"),
            code.alias("lang_code"),
            number.alias("class_num"),
            F.concat(F.lit("class"), number.cast("string"), F.lit("_"), code).alias("folder_key"),
        ),
    )


def chunk_key(chunk_id: Column) -> Column:
    return F.format_string("chunk_%06d", chunk_id)


def output_path(base: str, folder_key: Column, filename: Column, extension: str) -> Column:
    """Where a file's result goes: base, folder, stem with the extension."""
    return F.concat_ws("/", F.lit(base), folder_key, F.concat(F.regexp_replace(filename, r"\.[^.]*$", ""), F.lit(extension)))
