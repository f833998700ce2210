"""Template residue, filler, error pages and notices that scripts are required.

A multi-pattern automaton runs over each whole text, in lower case with digits
folded, and finds core parts of messages (scripts, errors, filler), the ordinary
words of such messages, and the openings of template places.  Where a core part
or an opening was found, each passage (a line or a sentence) is judged: it is a
message when it has a core part and nearly all of its letters belong to known
words, and residue when it holds an unfilled place that it does not talk about.
No whole messages are listed: a notice is known by the vocabulary of its trade,
while a lesson that mentions an error has words of its own, quotes it, or explains
("if", "means").  Coverage is measured per passage and not per document, because
residue counts also where real sentences stand around it.  Three kinds are known
by their form and not by coverage: unfilled places (by pattern), one token over and
over, and a run of words none of which is a function word.

Defined results: null, empty and blank texts are no residue; repeated texts are
judged alike under each id; texts are judged whole, however long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pothi.llm.unicode_form import canonical

# What notices, errors and filler are made of.  A passage is such a text when it consists of these words and
# has a part of ``CORE``; the lists hold words and short parts of the trade, no whole messages.
CORE = {
    "script": ("javascript", "noscript", "scripts", "scripting", "script blocker", "জাভাস্ক্রিপ্ট", "স্ক্রিপ্ট", "cookies", "কুকি", "जावास्क्रिप्ट"),
    "error": (
        "error", "errors", "exception", "fatal", "warning", "undefined", "traceback", "stack trace", "denied", "forbidden", "unauthorized", "unauthorised", "rejected", "not found", "could not be found", "no such",
        "no longer available", "not available", "unavailable", "moved or deleted", "been moved", "been deleted", "been removed", "does not exist", "expired", "session", "signed out", "logged out", "sign in", "log in",
        "maintenance", "timeout", "timed out", "gateway", "too many requests", "rate limit", "try again", "please wait", "reload", "refresh", "loading", "failed", "could not connect", "cannot connect",
        "could not be loaded", "cannot be displayed", "cannot load", "could not load", "will not load", "could not be parsed", "unexpected token", "went wrong", "blocked", "not responding", "did not reply", "not answering", "may not open", "return home", "page not found", "bad request",
        "null pointer", "have permission", "database connection", "ত্রুটি", "সার্ভার সাড়া", "সেশন", "মেয়াদ", "লোড", "রক্ষণাবেক্ষণ", "প্রবেশাধিকার", "প্রত্যাখ্যাত", "অনুমতি নেই", "পাওয়া যায়নি", "পাওয়া যাচ্ছে না", "মুছে ফেলা", "আবার চেষ্টা", "আবার প্রবেশ", "ফিরে আসুন", "ফিরে যান", "সংযোগ", "त्रुटि", "erreur", "error del",
    ),
    "filler": (
        "lorem", "ipsum", "todo", "tbd", "tba", "fixme", "placeholder", "dummy", "goes here", "text here", "to follow", "coming soon", "to be announced", "to be written", "to be added", "still to be", "write here", "chapter here", "lesson here",
        "replace this", "insert", "draft", "sample text", "লেখা বসবে", "এখানে লেখা", "নমুনা অনুচ্ছেদ", "নমুনা লেখা", "খসড়া", "পরে যোগ", "যোগ হবে", "যোগ করতে হবে", "এখনো লেখা হয়নি", "কাজ বাকি", "লেখা হবে",
    ),
}
WORDS = {
    "system": (
        "browser browsers settings setting support supports supported require required requires need needs needed enable enabled enabling disable disabled allow allowed activate active turn turned switch switched load loads loaded page pages"
        " site website app application view viewer reader display displayed show shown run running code status reference ref ticket id ids request requested server servers service services upstream response respond responding reply answering"
        " internal bad null unexpected token position index line attempt parse parsed fail failure unable find found missing exist exists access permission authorised authorized region country account password user network offline connect connected connection"
        " database query limit exceeded quota licence license subscription invalid contact administrator admin home start return menu search skip oops apologies inconvenience wrong happened occurred opening open opened ask asked asking quote"
        " number work working works properly parts closed close end ended ends wanted content contents book books chapter chapters lesson lessons unit units text texts quiz figure figures section sections heading title file files link links address url"
        " check try trying blocker wait waiting later minute minutes second seconds ms hour hours moment moments down soon temporarily temporary step steps"
    ),
    "filler": "body copy block final add added write written replace insert here words word paragraph paragraphs yet follow follows about describe type your name note announced come comes content goes left blank empty list class classes draft dolor sit amet consectetur adipiscing elit",
    "bengali": (
        "ব্রাউজার ব্রাউজারে ব্রাউজারের সেটিংস সেটিংসে অনুমতি চালু বন্ধ সক্রিয় নিষ্ক্রিয় পৃষ্ঠা পৃষ্ঠাটি পাতা পাতায় প্রথম বই বইটি পাঠ পাঠটি অধ্যায় অধ্যায়টি লেখা লেখাটি ফাইল ফাইলটি কোড সূত্র টিকিট নম্বর অনুরোধ মিনিট সেকেন্ড পরে"
        " আবার চেষ্টা প্রবেশ ফিরে আসুন যান দিন করুন করে করতে করা কাজ করবে দেখতে দেখানো খুলতে গিয়ে সাড়া দিচ্ছে দেয়নি শেষ হয়েছে হয়ে গেছে চলছে হচ্ছে যায়নি যাচ্ছে গেছে ঘটেছে সরানো মুছে ফেলা পরীক্ষা অভ্যন্তরীণ দুঃখিত আর আপনি আপনার খুঁজছেন যে"
        " এখানে এখনো বসবে যোগ হবে বাকি অনুচ্ছেদ চূড়ান্ত নয় অংশ প্রায় শব্দ শব্দের চিত্র সাহায্য তালিকা খুঁজুন নেই না তা তাই এই এ ও বা ছাড়া থেকে জন্য কিছু সময় নেওয়া অপেক্ষা পাওয়া প্রয়োজন লোড আছে"
    ),
    "links": (
        "a an the this that these those it its you your we our i us they them is are was were be been being am do does did has have had will would can could cannot can't couldn't doesn't don't isn't won't may might must should not no nor"
        " and or but so to of in on at by for from with without as into off out up too many some any all more again please sorry there here after before then while which has see seen go going read reading get give let use used"
    ),
}
# Words of sentences that explain or suppose instead of telling.
EXPLAINING = frozenset("if when because means called example unless whenever whether explain explains first designers যদি যখন মানে অর্থ কারণ যেমন বলে উদাহরণ".split())
# Openings of template places.
OPENINGS = ("{", "<", "%(", "@@", "__", "[[", "[your ", "[insert ", "[এখানে ", " দিতে হবে)", "#")
_name = r"[\w়-্ঁ-ঃা-ৌ‌‍ .-]{1,40}"
# Whole template places, as various systems write them.
PLACES = re.compile(
    rf"\{{\{{\s*{_name}\s*\}}\}}|\$\{{{_name}\}}|<%=?\s*{_name}\s*%>|\{{%-?\s*{_name}\s*-?%\}}|%\({_name}\)[sd]"
    rf"|@@{_name}@@|(?<!\w)__{_name}?[^\W_]__(?!\w)|<<\s*{_name}\s*>>|\[\[\s*{_name}\s*\]\]|\[(?:your|insert|এখানে)\s{_name}\]"
    rf"|<{_name}\s(?:here|বসান)>|\({_name}\sদিতে হবে\)|(?<![\w&#])#[^\W\d]{_name}?#(?!\w)|(?<![\w$(\"'{{]){{[^\W\d]{_name}?}}(?![\w}}])",
    re.IGNORECASE,
)
# Words of sentences that talk about a template place or a code instead of leaving it unfilled.
SPOKEN_OF = re.compile(
    r"\b(?:types?|writes?|writing|code|print|tag|braces|brackets|mail merge|placeholder|variable called|set)\b|লেখে|লেখেন|লিখে|সেটের|ঘরটি|চিহ্নটি|কোডে",
    re.IGNORECASE,
)
QUOTED = re.compile(r"[“\"«‘][^“”\"«»‘’\n]{1,200}[”\"»’]")
# Words without which hardly a sentence of these languages is built.
FUNCTION_WORDS = frozenset(
    "the a an of in on at to and or is are was were it this that with for from by as its if not be you your we they he she"
    " le la les un une des du de et est dans que qui pour avec el los las y en con por para del al es una"
    " er ekti ar diye theke kore".split()
)
_numbers = re.compile(r"\d+")
_blanks = re.compile(r"[^\S\n ]+| {2,}")
_lines = re.compile(r"\n+")
_sentences = re.compile(r"(?<=[.?!।])\s+")
_latin_words = re.compile(r"[a-zà-öø-ɏ]+")
_letter = r"[\w\u0900-\u0963\u0966-\u0dff\u200c\u200d]"
_one_letter = re.compile(_letter)
_message_words = re.compile(r"(?:(?!\d)[\w\u0900-\u0963\u0966-\u0dff\u200c\u200d']){2,}|[^\W\d]")
_any_word = re.compile(r"[^\W\d_]")
#: A passage is residue when this share of its letters is covered.
COVERAGE = 0.88
#: Words of a run without function words, and repeats of one token, from which it is filler.
RUN_WORDS, REPEATS = 6, 8


def folded(text: str) -> str:
    """Lower case, each number in whatever digits as 0, blanks single."""
    return _blanks.sub(" ", _numbers.sub("0", text.lower()))


class Vocabulary:
    """The automaton of core parts and openings of template places, and the words that messages consist of."""

    def __init__(self, core: dict[str, tuple[str, ...]] | None = None, words: dict[str, str] | None = None) -> None:
        self.core = sorted({canonical(part) for group in (core or CORE).values() for part in group}, key=len, reverse=True)
        self.words = frozenset(w for group in ((words or WORDS).values(), self.core) for text in group for w in canonical(text).split())
        self.machine = ahocorasick.Automaton()
        for part in self.core:
            # Whole texts are searched as they are written: letters with a nukta stand as one character or as two.
            for form in {part, _composed(part)}:
                self.machine.add_word(form, (len(form), "core"))
        for opening in OPENINGS:
            self.machine.add_word(opening, (len(opening), "place"))
        self.machine.make_automaton()

    def without_core(self, passage: str) -> str | None:
        """A folded passage without its core parts, or nothing when it has none; a Bengali part may carry an ending."""
        spans = []
        for end, (length, kind) in self.machine.iter(passage):
            start = end + 1 - length
            if kind == "core" and not (start and _one_letter.match(passage[start - 1])):
                if not (passage[end].isascii() and end + 1 < len(passage) and _one_letter.match(passage[end + 1])):
                    spans.append((start, end + 1))
        if not spans:
            return None
        out, last = [], 0
        for start, end in sorted(spans):
            out.append(passage[last : max(last, start)])
            last = max(last, end)
        return " ".join([*out, passage[last:]])


def _composed(text: str) -> str:
    """The text with য়, ড়, ঢ় as one character."""
    return text.replace("\u09af\u09bc", "\u09df").replace("\u09a1\u09bc", "\u09dc").replace("\u09a2\u09bc", "\u09dd")


def covered(passage: str, vocabulary: Vocabulary) -> bool:
    """Whether a folded passage tells a message: it has a core part, and nearly all of its letters belong to known words."""
    passage = canonical(QUOTED.sub(" ", passage))
    rest = vocabulary.without_core(passage)
    if rest is None:
        return False
    whole = _message_words.findall(passage)
    if not EXPLAINING.isdisjoint(whole):
        return False
    # What is left of a word after a core part is its ending.
    unknown = sum(len(w) for w in _message_words.findall(rest) if w not in vocabulary.words and w in whole)
    return unknown <= (1 - COVERAGE) * max(1, sum(map(len, whole)))


def unfilled(passage: str) -> bool:
    """Whether a passage holds a template place that it does not quote or talk about."""
    bare = QUOTED.sub(" ", passage)
    return PLACES.search(bare) is not None and SPOKEN_OF.search(PLACES.sub(" ", bare)) is None


def _repeated(line: str) -> bool:
    """Filler by form: hardly anything but one short token over and over."""
    tokens = line.split()
    if len(tokens) < REPEATS:
        return False
    run = best = 1
    for before, token in zip(tokens, tokens[1:], strict=False):
        run = run + 1 if token == before else 1
        best = max(best, run)
    return best >= REPEATS


def _wordless(passage: str) -> bool:
    """Filler by form: many Latin words without any function word."""
    words = _latin_words.findall(passage)
    if len(words) < RUN_WORDS or sum(map(len, words)) < 0.8 * sum(map(str.isalpha, passage)):
        return False
    return FUNCTION_WORDS.isdisjoint(words)


def residue_kind(text: str | None, vocabulary: Vocabulary) -> str | None:
    """What a text holds instead of content (message, place or filler); null where nothing was found."""
    if not text or text.isspace():
        return None
    kinds = {kind for _, (_, kind) in vocabulary.machine.iter(text.lower())}
    core, place = "core" in kinds, "place" in kinds
    for line in _lines.split(text):
        if _repeated(line):
            return "filler"
        for passage in _sentences.split(line):
            if place and unfilled(passage):
                return "place"
            if core and covered(folded(passage), vocabulary):
                return "message"
            if _wordless(passage.lower()):
                return "filler"
    return None


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    vocabulary = Vocabulary()
    for pdf in batches:
        kind = [residue_kind(t, vocabulary) for t in pdf["text"]]
        out = pd.DataFrame({"key": pdf["key"], "kind": pd.Series(kind, dtype=object, index=pdf.index)})
        yield out[out["kind"].notna()]


def find_residue(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, kind) of the texts that hold residue."""
    kind = df.schema[key].dataType.simpleString()
    return (
        df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
        .where(F.col("text").isNotNull())
        .mapInPandas(_judge, f"key {kind}, kind string")
        .withColumnRenamed("key", key)
    )


def without_residue(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose text holds no residue; null keys stay when their text is clean."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.BooleanType())
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = Vocabulary()
        for texts in batches:
            yield texts.map(lambda t: residue_kind(t, vocabulary) is None)

    return df.where(clean(F.col(f"`{text}`")))
