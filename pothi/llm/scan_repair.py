"""Repair of text taken from scanned pages.

Two passes over the distinct texts of each book (``source``).  The first counts
words and compounds with a hyphen over the whole corpus, and in each book the
parts of lines that have no sentence end (folded: lower case, numbers as 0, page
numbers taken off).  The second repairs each text with these counts:

* page numbers: lines that are only a number and its marks, or such a part of a
  header line; numbers in a column, or after a line that ends in a colon, stay;
* headers and footers: parts that are printed on ``PAGES`` pages of a book or
  more.  A line is printed by itself, and not wrapped text that happens to be
  equal, where the next word would still have fitted into it; nearly all lines
  with the part must be so, and most of them must not begin texts, as a lesson
  heading does.  A part with fewer pages in its own book is judged by all books
  together, and a part unlike every other is compared with the headers of its
  book: within ``edits`` of one of them it is the same header, misread.  A short
  line that interrupts a sentence is a header without repetition;
* hyphenation: a word cut at a line end is joined when the corpus knows it
  joined, or does not know it as a compound;
* misread characters: a word that the corpus hardly knows, and that becomes a
  far more frequent word by one or two known confusions, is that word; digits
  inside a word of letters are read as letters.

What remains is joined into paragraphs; columns and lists keep their lines.

Pages often stand in the middle of a text, because texts are cut by content, so
every line is looked at and not only the first and last ones.  The counts that
words, compounds and headers need are the same at every number of texts and of
books.  Headers are looked up by a join; the vocabulary is kept in memory, has
every word that stands in two texts or more, and grows with the corpus as its
vocabulary does.

Defined results: null stays null; empty and blank texts have no noise and stay;
texts are read whole; equal texts of a book are repaired once and alike; texts
without a source are a book of their own.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pothi.llm.unicode_form import canonical
from pothi.plans.store import materialise

KINDS = ("hyphen", "misread", "header", "page_no")
#: What is more frequent than ``RATIO`` squared times this share of all texts is printed so.
COMMON_SHARE = 20_000
#: Words that stand in fewer texts are not in the vocabulary.
LEAST_KNOWN = 2
#: Pages from which a line without a sentence end is a header, and the share of them on which it must stand by itself.
PAGES, ALONE = 3, 0.6
#: A word is a misreading of one that is so many times as frequent.
RATIO = 15

# What is read instead of what is printed (read, printed).
CONFUSIONS = (
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("5", "s"), ("s", "5"), ("1", "l"), ("1", "i"), ("o", "a"), ("a", "o"), ("0", "o"), ("l", "i"),
    ("i", "l"), ("ri", "n"), ("9", "g"), ("v", "y"), ("li", "h"), ("cl", "d"), ("rn", "m"), ("vv", "w"), ("6", "b"), ("ii", "u"), ("8", "b"),
    ("q", "g"), ("nn", "m"), ("m", "rn"), ("d", "cl"), ("h", "b"), ("u", "v"), ("n", "u"), ("u", "n"), ("h", "li"), ("y", "v"), ("b", "h"), ("im", "nn"),
    ("ব", "র"), ("র", "ব"), ("ভ", "ত"), ("ত", "ভ"), ("ল", "ন"), ("ন", "ল"), ("গ", "প"), ("প", "গ"), ("স", "ম"), ("ম", "স"), ("ফ", "ক"),
    ("ক", "ফ"), ("ূ", "ু"), ("ু", "ূ"), ("ি", "ী"), ("ী", "ি"), ("ন", "ণ"), ("ণ", "ন"), ("ড", "জ"), ("জ", "ড"), ("ব", "ধ"), ("ধ", "ব"),
    ("থ", "খ"), ("খ", "থ"), ("য", "ঘ"), ("ঘ", "য"), ("ষ", "য"), ("য", "ষ"), ("ঢ", "ট"), ("ট", "ঢ"),
)
DIGIT_IN_WORD = frozenset("015689")

_digits = str.maketrans("০১২৩৪৫৬৭৮৯", "0123456789")
_letters = r"A-Za-zÀ-ɏ"
_bengali = r"ঀ-৥ৰ-৿‌‍"
WORD = re.compile(rf"[{_letters}0-9]+(?:-[{_letters}0-9]+)*|[{_bengali}]+(?:-[{_bengali}]+)*")
_cut = re.compile(rf"(?<![{_letters}{_bengali}-])([{_letters}{_bengali}]+(?:-[{_letters}{_bengali}]+)*)-[ \t]*\n[ \t]*([{_letters}{_bengali}]+(?:-[{_letters}{_bengali}]+)*)")
_page_mark = r"(?:(?:page|p\.|pg\.|পৃষ্ঠা|পৃ\.)\s*\d{1,4}|\[\s*\d{1,4}\s*\]|\(\s*\d{1,4}\s*\)|[-–—]\s*\d{1,4}\s*[-–—]|\d{1,4}\s*\||\|\s*\d{1,4})"
_page_line = re.compile(rf"^{_page_mark}$", re.IGNORECASE)
_bare = re.compile(r"^\d{1,4}$")
_page_before = re.compile(rf"^(?:{_page_mark}|\d{{1,4}})(?:\s{{2,}}|\s*(?<=\|)\s+)(?=\S*[^\W\d])", re.IGNORECASE)
_page_after = re.compile(rf"(?<=\S)\s{{2,}}(?:{_page_mark}|\d{{1,4}})$", re.IGNORECASE)
_sentence_end = re.compile(r"[.।?!,;:]['\"”’)]*$")
_numbered = re.compile(r"^([^\s\d:]+\s+0\s*:)")
_item = re.compile(r"^\s*(?:\d{1,3}[.)]|[০-৯]{1,3}[.)।]|[-•*])\s")
#: Characters of a numbered heading at most.
LONGEST_HEADING = 90


_bengali_digit = re.compile("[০-৯]")
_number, _blanks = re.compile(r"\d+"), re.compile(r"\s+")


def _western(text: str) -> str:
    return text.translate(_digits) if _bengali_digit.search(text) else text


def _fold(line: str) -> str:
    return _number.sub("0", _blanks.sub(" ", _western(line).lower())).strip()


def edge_parts(line: str) -> tuple[list[str], bool] | None:
    """Folded parts of a line that may be a header, and whether a page number stands in it; nothing for other lines."""
    plain = line.strip()
    if not plain or _sentence_end.search(plain[-4:]) or _item.match(plain):
        return None
    plain = _western(plain)
    page = False
    for pattern in (_page_before, _page_after):
        mark = pattern.search(plain)
        if mark:
            plain, page = (plain[: mark.start()] + plain[mark.end() :]).strip(), True
            break
    if not any(c.isalpha() for c in plain):
        return None
    parts = [p for p in (_fold(x) for x in re.split(r"\s*[|·•]\s*", plain)) if any(map(str.isalpha, p))]
    numbered = _numbered.match(parts[0])
    if numbered:
        parts[0] = numbered.group(1)
    return parts, page


def is_page_number(lines: list[str], i: int) -> bool:
    """Whether line ``i`` is only a printed page number."""
    plain = lines[i].strip()
    if len(plain) > 20 or not plain:
        return False
    plain = _western(plain)
    if _page_line.match(plain):
        return True
    if not _bare.match(plain):
        return False
    for step in (-1, 1):
        j = i + step
        if 0 <= j < len(lines):
            beside = _western(lines[j].strip()[-20:])
            if _bare.match(beside) or (step < 0 and beside.endswith(":")):
                return False
    return True


@dataclass
class ScanModel:
    """Counts of the corpus that the repair needs."""

    texts: int
    words: dict[str, int]
    memo: dict[str, str | None] = field(default_factory=dict)

    @property
    def common(self) -> int:
        """Count beyond which a word is not taken for a misreading of a word that is still more frequent."""
        return RATIO * RATIO * max(3, self.texts // COMMON_SHARE)

    @property
    def floor(self) -> int:
        """Count from which a word can be what a word that the corpus does not know was printed as, at every number of texts."""
        return RATIO

    @cached_property
    def longest(self) -> int:
        """Length beyond which nothing can be a misreading of a known word."""
        return max(map(len, self.words), default=0) + 2

    @cached_property
    def forms(self) -> dict[str, str]:
        """Each form that one confusion makes of a frequent word, with the most frequent such word."""
        out: dict[str, str] = {}
        for word, n in self.words.items():
            if n >= self.floor and len(word) >= 2:
                for form in misread_forms(word):
                    if self.words.get(out.get(form, ""), 0) < n:
                        out[form] = word
        return out

    def printed(self, word: str) -> str | None:
        """The word of which ``word`` is a misreading, or nothing."""
        if word not in self.memo:
            if len(self.memo) > 400_000:
                self.memo.clear()
            self.memo[word] = self._printed(word)
        return self.memo[word]

    def _printed(self, word: str) -> str | None:
        if not 3 <= len(word) <= self.longest or word.isdigit():
            return None
        floor = max(self.floor, RATIO * self.words.get(word, 0))
        once = self.forms.get(word)
        if once is not None and self.words[once] >= floor:
            return once
        if len(word) >= 5:
            twice = [v for u in _confused(word) if (v := self.forms.get(u)) is not None and v != word and self.words[v] >= 2 * floor]
            if twice:
                return max(twice, key=self.words.__getitem__)
        if word.isascii() and not DIGIT_IN_WORD.isdisjoint(word) and sum(map(str.isalpha, word)) >= 3:
            if not any(c.isdigit() and c not in DIGIT_IN_WORD for c in word):
                return word.translate(_read_digits)
        return None


_read_digits = str.maketrans("015689", "olsbbg")
_by_read: dict[str, list[tuple[str, str]]] = defaultdict(list)
_by_printed: dict[str, list[tuple[str, str]]] = defaultdict(list)
for _read, _print in CONFUSIONS:
    _by_read[_read[0]].append((_read, _print))
    _by_printed[_print[0]].append((_print, _read))


def _replaced(word: str, table: dict[str, list[tuple[str, str]]]) -> list[str]:
    out = []
    for i, c in enumerate(word):
        for old, new in table.get(c, ()):
            if word.startswith(old, i):
                out.append(word[:i] + new + word[i + len(old) :])
    return out


def _confused(word: str) -> list[str]:
    """Words that one confusion may have turned into ``word``."""
    return _replaced(word, _by_read)


def misread_forms(word: str) -> list[str]:
    """What one confusion makes of ``word``."""
    return _replaced(word, _by_printed)


def _join_cut(m: re.Match, words: dict[str, int]) -> str | None:
    """The word that a line end cuts, or nothing for a compound that ends a line at its own hyphen."""
    a, b = m.group(1), m.group(2)
    joined, compound = (a + b).lower(), f"{a}-{b}".lower()
    if words.get(joined, 0) == 0 and words.get(compound, 0) > 0:
        return None
    return a + b


def repair(text: str | None, model: ScanModel, edges: dict[str, bool] | None = None, whole: bool = True) -> tuple[str | None, set[str]]:
    """A text as continuous paragraphs, and the kinds of noise that were in it; without ``whole`` lines stay unjoined.

    ``edges`` says of parts of lines of this text whether they are headers (true) or headings (false).
    """
    if not text or not text.strip():
        return text, set()
    found: set[str] = set()
    edges = edges or {}
    lines = canonical(text).split("\n")
    widths = sorted(len(x) for x in lines if x.strip())
    typical = widths[len(widths) // 2]
    kept: list[str] = []
    for i, line in enumerate(lines):
        if is_page_number(lines, i):
            found.add("page_no")
            continue
        parts = edge_parts(line)
        if parts is not None and not _is_heading(parts[0], edges):
            if any(edges.get(p) for p in parts[0]) or _interrupts(lines, i, typical):
                found.add("header")
                if parts[1]:
                    found.add("page_no")
                continue
        kept.append(line)
    body = _strip_gaps(kept, found)

    def join(m: re.Match) -> str:
        word = _join_cut(m, model.words)
        if word is None:
            return f"{m.group(1)}-{m.group(2)}"
        found.add("hyphen")
        return word

    while True:
        joined = _cut.sub(join, body)
        if joined == body:
            break
        body = joined

    fixes = {w: fixed for w in set(WORD.findall(body)) if (fixed := _reading(w, model)) is not None}
    if fixes:
        found.add("misread")
        body = WORD.sub(lambda m: fixes.get(m.group(), m.group()), body)
    return (_paragraphs(body) if whole else body), found


def _reading(word: str, model: ScanModel) -> str | None:
    """The printed form of a misread word, with its capital, or nothing."""
    low = word.lower()
    if model.words.get(low, 0) > model.common:
        return None
    printed = model.printed(low)
    if printed is None and "-" in low:
        pieces = [model.printed(p) or p for p in low.split("-")]
        printed = "-".join(pieces) if pieces != low.split("-") else None
    if printed is None or (word.isupper() and len(word) <= 4):
        return None
    return printed.capitalize() if word[0].isupper() else printed


def _is_heading(parts: list[str], edges: dict[str, bool]) -> bool:
    """Whether the numbered beginning of a line is that of headings, which begin texts; one that is no header counts as such."""
    return bool(_numbered.match(parts[0])) and not edges.get(parts[0], False)


def _interrupts(lines: list[str], i: int, typical: int) -> bool:
    """Whether a line without a sentence end stands inside a sentence that goes on after it."""
    if i == 0 or i == len(lines) - 1:
        return False
    line = lines[i].strip()
    before = next((x.strip() for x in reversed(lines[:i]) if x.strip()), "")
    after = next((x.strip() for x in lines[i + 1 :] if x.strip()), "")
    if not before or not after or len(line) > 0.75 * typical or len(line.split()) < 2:
        return False
    if before[-1] in "-" or re.search(r"[.।?!]['\"”’)]*$", before):
        return False
    if line[0].isascii() and line[0].isalpha():
        return line[0].isupper() and after[0].islower()
    return len(before) > len(line) * 1.4 and not re.match(r"[A-Za-z]", line) and len(line) < 0.5 * typical


def _strip_gaps(kept: list[str], found: set[str]) -> str:
    """Lines joined again; blank lines that only framed removed ones do not part a sentence."""
    text = "\n".join(kept)
    if found & {"header", "page_no"}:
        text = re.sub(rf"([{_letters}{_bengali},–-])[ \t]*\n(?:[ \t]*\n)+(?=[a-zà-ÿ{_bengali}])", r"\1\n", text)
    return text.strip("\n")


def _paragraphs(text: str) -> str:
    """Wrapped lines joined; blank lines, columns, lists and headings keep their breaks."""
    out: list[str] = []
    for block in re.split(r"\n[ \t]*\n+", text):
        joined: list[list[str]] = []
        closed = True
        for line in map(str.strip, block.split("\n")):
            if not line:
                continue
            bare = bool(_bare.match(_western(line[:6])))
            if closed or bare or _item.match(line):
                joined.append([line])
            else:
                joined[-1].append(line)
            # Whether the next line begins a line of its own: after a number, a colon, or a heading.
            closed = bare or line.endswith(":") or (len(joined[-1]) == 1 and len(line) <= LONGEST_HEADING and bool(_numbered.match(_fold(line))))
        if joined:
            out.append("\n".join(" ".join(lines) for lines in joined))
    return "\n\n".join(out)


COUNTED = "kind string, source string, item string, n long, alone boolean, first boolean, page boolean, a long, b long"


def line_edges(text: str) -> dict[str, tuple[bool, bool]]:
    """Parts of the lines of a text in the consistent form that may be headers: whether one stands by itself, and whether it begins the text."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    width = max(map(len, lines), default=0)
    out: dict[str, tuple[bool, bool]] = {}
    for i, line in enumerate(lines):
        parts = edge_parts(line)
        if parts is None:
            continue
        follow = lines[i + 1].split(None, 1)[0] if i + 1 < len(lines) else None
        # Wrapped lines are full, but for a last one that only has the rest of a cut word.
        alone = (follow is None or len(line) + 1 + len(follow) <= width) and not (i and " " not in line and lines[i - 1].endswith("-"))
        for p in parts[0]:
            before = out.get(p, (False, False))
            out[p] = (before[0] or alone, before[1] or i == 0)
    return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the words of a batch, each once for each page text (kind w), and the edge parts of each text (kind e)."""
    for pdf in batches:
        words: Counter[str] = Counter()
        rows: list[tuple] = []
        for text, source, page, a, b in zip(pdf["text"], pdf["source"], pdf["page"], pdf["a"], pdf["b"], strict=True):
            plain = canonical(text)
            rows += [("e", source, p, 1, alone, first, page, a, b) for p, (alone, first) in line_edges(plain).items()]
            if page:
                # The end of a line may cut a word or a compound; neither half is counted.
                words.update({w.lower() for w in WORD.findall(_cut.sub(" ", plain))})
        rows += [("w", None, w, n, None, None, True, None, None) for w, n in words.items()]
        out = pd.DataFrame(rows, columns=["kind", "source", "item", "n", "alone", "first", "page", "a", "b"], dtype=object)
        yield out.astype({"n": "Int64", "a": "Int64", "b": "Int64"})


def distinct_texts(df: DataFrame, fields: list[str], source: str | None = "source") -> DataFrame:
    """Distinct texts (text, source, a, b, page) of the named columns in each book; a, b are two hashes of the text, ``page`` says that it is a page text (the last column)."""
    book = F.col(f"`{source}`").cast("string") if source and source in df.columns else F.lit(None).cast("string")
    every = None
    for f in fields:
        one = df.select(F.col(f"`{f}`").alias("text"), book.alias("source"), F.lit(f == fields[-1]).alias("page")).where(F.col("text").rlike(r"\S"))
        every = one if every is None else every.unionAll(one)
    return every.groupBy("text", "source").agg(F.max("page").alias("page")).select("*", text_key("text")["a"].alias("a"), text_key("text")["b"].alias("b"))


def text_key(name: str):
    """Key of a text: two independent 64-bit hashes."""
    column = F.col(f"`{name}`")
    return F.struct(F.xxhash64(column).alias("a"), F.xxhash64(F.lit(1), column).alias("b"))


def count_texts(texts: DataFrame) -> DataFrame:
    """Counts of words and edge parts of a table of distinct texts."""
    return materialise(texts.mapInPandas(_count, COUNTED), "counted")


def fit_scan(counted: DataFrame, texts: int) -> ScanModel:
    """Model from the counts of a corpus of so many page texts."""
    words = counted.where("kind = 'w'").groupBy("item").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_KNOWN)
    return ScanModel(texts, {r["item"]: r["n"] for r in words.collect()})


def edits(length: F.Column) -> F.Column:
    """Edits by which two readings of one header may differ: one, from twelve characters two."""
    return F.when(length < 12, 1).otherwise(2)


def printed_edges(counted: DataFrame) -> DataFrame:
    """Rows (source, item, header): the parts that are headers of a book, and the beginnings of its headings."""
    one = F.col("page").cast("int")
    own = (
        counted.where("kind = 'e'")
        .groupBy("source", "item")
        .agg(F.sum(one).alias("n"), F.sum((F.col("alone") & F.col("page")).cast("int")).alias("alone"), F.sum((F.col("first") & F.col("page")).cast("int")).alias("first"))
    )
    own = materialise(own, "edges")
    everywhere = own.where("alone > 0").groupBy("item").agg(F.sum("n").alias("all_n"), F.sum("alone").alias("all_alone"), F.sum("first").alias("all_first"))

    def header(n: str, alone: str, first: str) -> F.Column:
        return (F.col(alone) >= PAGES) & (F.col(alone) >= ALONE * F.col(n)) & (2 * F.col(first) < F.col(n))

    enough = F.col("alone") >= PAGES
    judged = own.join(everywhere, "item", "left").select(
        "source", "item", "alone", F.when(enough, header("n", "alone", "first")).otherwise(F.coalesce(header("all_n", "all_alone", "all_first"), F.lit(False))).alias("header")
    )
    judged = materialise(judged.where("header or alone > 0"), "judged")
    headers = judged.where("header")

    def words(rows: DataFrame, name: str) -> DataFrame:
        word = F.explode(F.array_distinct(F.filter(F.split("item", " "), lambda w: (F.length(w) >= 3) | w.endswith(":"))))
        return rows.select(F.coalesce("source", F.lit("")).alias("book"), "source", F.col("item").alias(name), word.alias("word"))

    # A part unlike all others is the misreading of a header of its book that shares a word with it.
    near = (
        words(judged.where("not header and alone < %d" % PAGES), "item")
        .join(words(headers, "other").drop("source"), ["book", "word"])
        .where(F.levenshtein("item", "other", 2).between(0, edits(F.length("other"))))
        .select("source", "item")
        .distinct()
    )
    return materialise(headers.select("source", "item").union(near).distinct(), "headers")


def with_headers(texts: DataFrame, counted: DataFrame) -> DataFrame:
    """The texts with the parts of their lines that are headers (array ``headers``, null where there is none)."""
    headers = printed_edges(counted)
    found = (
        counted.where("kind = 'e'")
        .select("source", "item", "a", "b")
        .join(headers.select(F.col("source").alias("book"), "item"), ["item"])
        .where(F.col("source").eqNullSafe(F.col("book")))
        .groupBy("a", "b", "book")
        .agg(F.collect_set("item").alias("headers"))
        .withColumnsRenamed({"a": "ha", "b": "hb"})
    )
    same = (F.col("a") == F.col("ha")) & (F.col("b") == F.col("hb")) & F.col("source").eqNullSafe(F.col("book"))
    return texts.join(found, same, "left").select("text", "source", "a", "b", "headers")


def _prepared(df: DataFrame, fields: tuple[str, ...], source: str | None):
    """The distinct texts with their headers, and the model as a shared value."""
    texts = materialise(distinct_texts(df, list(fields), source), "texts")
    counted = count_texts(texts)
    model = fit_scan(counted, texts.where("page").count())
    return with_headers(texts, counted), df.sparkSession.sparkContext.broadcast(model)


def _wide(df: DataFrame, key: str, fields: tuple[str, ...], source: str | None) -> DataFrame:
    """Rows (key, field, a, b, book) of all values."""
    book = F.col(f"`{source}`").cast("string") if source and source in df.columns else F.lit(None).cast("string")
    return df.select(
        F.col(f"`{key}`").alias("key"), book.alias("book"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), text_key(f).alias("k")) for f in fields))).alias("v")
    ).select("key", "book", "v.field", "v.k.a", "v.k.b")


def scan_noise(df: DataFrame, key: str = "pair_id", fields: tuple[str, ...] = ("evidence", "source_text"), source: str | None = "source") -> DataFrame:
    """Rows (key, field, noise), each once; the last field holds the page texts, ``source`` names their book."""
    texts, shared = _prepared(df, fields, source)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            rows = [
                (a, b, book, kind)
                for text, a, b, book, headers in zip(pdf["text"], pdf["a"], pdf["b"], pdf["source"], pdf["headers"], strict=True)
                for kind in sorted(repair(text, m, _known(headers), whole=False)[1])
            ]
            yield pd.DataFrame(rows, columns=["a", "b", "source", "noise"])

    noisy = materialise(texts.mapInPandas(run, "a long, b long, source string, noise string"), "noisy")
    return (
        _wide(df.where(F.col(f"`{key}`").isNotNull()), key, fields, source)
        .join(noisy, ["a", "b"])
        .where(F.col("book").eqNullSafe(F.col("source")))
        .select(F.col("key").alias(key), "field", "noise")
        .distinct()
    )


def _known(headers) -> dict[str, bool]:
    return {} if headers is None else dict.fromkeys(headers, True)


def repaired(df: DataFrame, key: str = "pair_id", fields: tuple[str, ...] = ("evidence", "source_text"), source: str | None = "source") -> DataFrame:
    """The named columns of each row of ``df`` repaired, with the key; equal texts of a book are repaired once and joined by their keys."""
    texts, shared = _prepared(df, fields, source)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            fixed = [repair(t, m, _known(h))[0] for t, h in zip(pdf["text"], pdf["headers"], strict=True)]
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "book": pdf["source"], "fixed": pd.Series(fixed, dtype=object)})

    fixes = materialise(texts.mapInPandas(run, "a long, b long, book string, fixed string"), "fixes")
    book = F.col(f"`{source}`").cast("string") if source and source in df.columns else F.lit(None).cast("string")
    # Rows travel with the keys of their texts; only a blank text, which is no text of the table, goes along.
    keys = [
        c.alias(f"{n}{i}")
        for i, f in enumerate(fields)
        for n, c in (("a", text_key(f)["a"]), ("b", text_key(f)["b"]), ("blank", F.when(~F.col(f"`{f}`").rlike(r"\S"), F.col(f"`{f}`"))))
    ]
    out = df.select(F.col(f"`{key}`").alias("key"), book.alias("own_book"), *keys)
    for i in range(len(fields)):
        mine = fixes.withColumnsRenamed({"a": f"fa{i}", "b": f"fb{i}", "fixed": f"fixed{i}"})
        same = (F.col(f"a{i}") == F.col(f"fa{i}")) & (F.col(f"b{i}") == F.col(f"fb{i}")) & F.col("own_book").eqNullSafe(F.col("book"))
        out = out.join(mine, same, "left").drop(f"a{i}", f"b{i}", f"fa{i}", f"fb{i}", "book")
    return out.select(F.col("key").alias(key), *(F.coalesce(f"fixed{i}", f"blank{i}").alias(f) for i, f in enumerate(fields)))
