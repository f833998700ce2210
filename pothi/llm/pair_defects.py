"""Answers that do not serve their question, with the kind of defect.

A multi-label linear classifier scores each pair on hashed word n-grams of the
answer and on features of the pair (shared words, language, how the end of the
answer goes on in the evidence, and how much of it is more than the question and
the words of sentences that decline).  It is trained on a bounded sample of the
corpus, taken as mostly sound, and on responses made defective from it:
truncated, copied, swapped for another language, refused (composed of parts, so
that no list of whole refusals is learnt), emptied; next to them stand sound ones that look alike (no final mark, bare terms, part of the
question followed by an answer, refusal words that are only mentioned).
Thresholds are calibrated on a held-out part of both.

Defined results: a null, empty or blank answer is ``empty``; a null question has
no words and no language; null evidence and source give no context; repeated
rows of a key count once; a pair has at most one defect, the one furthest above
its threshold.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pothi.llm.language_id import FULL_SENTENCE, SEEDS, LanguageModel, fit, of_record, segments, word_count
from pothi.llm.unicode_form import canonical
from pothi.operators.sampling import hashed_sample

DEFECTS = ("empty", "truncated", "refusal", "copy", "other_language")

# What stands in for a missing answer.
STAND_INS = (
    "", " ", "?", "—", "-", "--", "...", "…", ".", "।", "!", "null", "None", "none", "NULL", "nil", "NaN", "N/A", "n/a", "NA", "na",
    "(no answer)", "no answer", "[no answer]", "(none)", "(empty)", "empty", "blank", "Answer:", "answer:", "A:", "Ans.", "Ans:", "Response:", "TBD", "unknown",
    "উত্তর:", "উত্তর :", "উঃ", "উ:", "উত্তর নেই", "প্রযোজ্য নয়", "কোনো উত্তর নেই", "নেই", "(উত্তর নেই)", "(খালি)", "not available", "not applicable", "undefined",
)
_stand_ins = frozenset(canonical(s).strip().lower() for s in STAND_INS)
# Parts that refusals are composed of, by language: openings, clauses that decline, what they are about,
# reasons, texts that do not say, how they do not say it, and short forms.  {x} is replaced by words of the question.
REFUSAL_PARTS: dict[str, dict[str, tuple[str, ...]]] = {
    "en": {
        "open": ("", "Sorry, ", "I'm sorry, but ", "Unfortunately, ", "I apologise, but ", "I'm afraid ", "Regrettably, ", "As an AI model, ", "As a language model, "),
        "decline": (
            "I cannot answer", "I can't answer", "I am unable to answer", "I'm not able to answer", "I cannot say", "I can't tell", "I do not know", "I don't know", "I am not sure",
            "I have no information", "I could not find an answer", "I must decline to answer", "I prefer not to comment", "I will not guess", "I can't help", "it is impossible to say",
            "it cannot be determined", "it is not possible to answer", "no answer can be given", "this cannot be answered", "I would only be guessing", "we cannot know", "I have to leave this unanswered",
        ),
        "about": ("", " this question", " that", " about {x}", " anything on {x}", " with {x}", " what was asked", " this one"),
        "reason": (
            "", " from the given text", " from this passage", " without more context", " with the information provided", ", because the text does not mention it", ", as the details are missing",
            "; please ask your teacher", "; please provide more of the text", ", since it is outside my scope", " right now",
        ),
        "text": ("The text", "The passage", "The given context", "This excerpt", "The provided source", "The paragraph", "The chapter above", "The material"),
        "silent": (
            "does not mention {x}", "does not say", "says nothing about {x}", "contains no information about {x}", "gives no details on {x}", "never explains {x}", "does not cover this", "is not enough to tell",
            "is too short for an answer", "has no mention of {x}", "does not state it", "lacks the answer",
        ),
        "short": (
            "Not mentioned", "Not stated in the text", "Not specified", "Insufficient information", "Not enough context", "Cannot be determined", "No information available", "Information not provided",
            "There is no information about {x}", "Nothing is said about {x}", "{x} is not mentioned in the text", "No details of {x} are given", "Unable to respond", "Please consult another source about {x}", "Outside my knowledge",
            "Please share more context", "Please give me the rest of the text", "I can answer once I see more of the page", "With more details I could tell", "More of the source is needed to say anything",
        ),
    },
    "bn": {
        "open": ("", "দুঃখিত, ", "আমি দুঃখিত, ", "ক্ষমা করবেন, ", "মাফ করবেন, ", "দুর্ভাগ্যবশত, ", "ভাষা মডেল হিসেবে "),
        "decline": (
            "আমি উত্তর দিতে পারছি না", "আমি উত্তর দিতে পারব না", "আমি বলতে পারি না", "আমি জানি না", "আমার জানা নেই", "আমি নিশ্চিত নই", "উত্তর দেওয়া সম্ভব নয়", "উত্তর দেওয়া যাচ্ছে না", "কিছু বলা যাচ্ছে না",
            "নিশ্চিত করে বলা সম্ভব নয়", "আমি সাহায্য করতে পারছি না", "আমি মন্তব্য করতে পারি না", "আমি অনুমান করতে চাই না", "আমি অক্ষম", "উত্তর খুঁজে পাওয়া যায়নি", "অনুমান করা ঠিক নয়",
        ),
        "about": ("", "এ বিষয়ে ", "এই প্রশ্নের ", "{x} সম্পর্কে ", "{x} নিয়ে ", "এটি নিয়ে "),
        "reason": ("", "পর্যাপ্ত তথ্য না থাকায় ", "প্রদত্ত অংশ থেকে ", "আরও তথ্য ছাড়া ", "পাঠ্যে উল্লেখ না থাকায় "),
        "text": ("প্রদত্ত অংশে", "পাঠ্যে", "অনুচ্ছেদে", "উৎসে", "এই লেখায়", "উপরের অংশে", "অধ্যায়ে", "প্রসঙ্গে"),
        "silent": ("{x} সম্পর্কে কিছু বলা নেই", "{x} নিয়ে কোনো তথ্য নেই", "এর উল্লেখ নেই", "উল্লেখ করা হয়নি", "{x} সম্পর্কে কিছু বলা হয়নি", "উত্তর দেওয়া নেই", "এ কথা লেখা নেই", "যথেষ্ট তথ্য পাওয়া যায় না"),
        "short": ("উল্লেখ নেই", "যথেষ্ট তথ্য নেই", "তথ্য অপর্যাপ্ত", "উত্তর জানা নেই", "শিক্ষকের কাছে জিজ্ঞাসা করো", "আরও তথ্য দিন", "এটি আমার জ্ঞানের বাইরে", "বলা সম্ভব নয়", "{x} সম্পর্কে তথ্য নেই",
            "আরও তথ্য পেলে উত্তর দিতে পারব", "আরও লেখা দিলে বলা যাবে", "সম্পূর্ণ পাঠ্য দিলে জানাতে পারব", "উত্তর দেওয়ার জন্য আরও প্রসঙ্গ দরকার", "আমি কেবল একটি ভাষা মডেল", "উত্তরটি খোলা থাকল"),
    },
    "hi": {
        "open": ("", "क्षमा करें, ", "माफ़ कीजिए, "),
        "decline": ("मैं उत्तर नहीं दे सकता", "मुझे नहीं पता", "मैं नहीं जानता", "उत्तर देना संभव नहीं है", "मैं सहायता नहीं कर सकता"),
        "about": ("", "इस प्रश्न का ", "इस बारे में "),
        "reason": ("", "दिए गए पाठ से ", "पर्याप्त जानकारी के बिना "),
        "text": ("पाठ में", "दिए गए अंश में"),
        "silent": ("{x} का उल्लेख नहीं है", "इसकी जानकारी नहीं है"),
        "short": ("जानकारी नहीं है", "उल्लेख नहीं है"),
    },
    "fr": {
        "open": ("", "Désolé, ", "Malheureusement, "),
        "decline": ("je ne peux pas répondre", "je ne sais pas", "il est impossible de répondre", "je ne suis pas en mesure de le dire"),
        "about": ("", " à cette question", " sur {x}"),
        "reason": ("", " avec le texte fourni", " sans plus d'informations"),
        "text": ("Le texte", "Le passage"),
        "silent": ("ne le dit pas", "ne mentionne pas {x}", "ne donne pas cette information"),
        "short": ("Non mentionné", "Informations insuffisantes"),
    },
    "es": {
        "open": ("", "Lo siento, ", "Lamentablemente, "),
        "decline": ("no puedo responder", "no lo sé", "no es posible responder", "no puedo ayudar"),
        "about": ("", " a esta pregunta", " sobre {x}"),
        "reason": ("", " con el texto dado", " sin más información"),
        "text": ("El texto", "El pasaje"),
        "silent": ("no lo dice", "no menciona {x}", "no da esa información"),
        "short": ("No se menciona", "No hay suficiente información"),
    },
}
# Beginnings of sentences that use such words and go on with an answer, and frames that quote a refusal.
MENTION_OPENINGS = {
    "en": ("It cannot be seen by eye, so ", "It cannot be told by touch, so ", "This is not known at first, so ", "There is not enough of it, so ", "It is not possible by hand, so "),
    "bn": ("চোখে দেখে বলা যায় না, তাই ", "হাতে ধরে বোঝা যায় না, তাই ", "শুরুতে জানা থাকে না, তাই ", "তা যথেষ্ট নয়, তাই "),
}
MENTION_FRAMES = {
    "en": ("The sign there says “{r}” for {n} days.", "The card reads “{r}” and stays {n} hours.", "One of them says “{r}” and goes on after {n} minutes.", "The word “{r}” is written on the {w}."),
    "bn": ("সেখানে “{r}” লেখা কার্ডটি {n} দিন থাকে।", "তখন পর্দায় “{r}” লেখা {n} মিনিট দেখা যায়।", "একজন “{r}” বলে {n} মিনিট পরে চলে যায়।"),
}


def compose_refusal(rng: random.Random, language: str, x: str, parts: dict[str, dict[str, tuple[str, ...]]] | None = None) -> str:
    """A refusal composed of parts, about the words ``x``; a language without parts refuses in English."""
    every = parts or REFUSAL_PARTS
    p = every.get(language, every["en"])
    pick = lambda name: rng.choice(p[name])
    before = language in ("bn", "hi")
    kind = rng.random()
    if kind < 0.5:
        about, reason = pick("about"), pick("reason") if rng.random() < 0.5 else ""
        out = pick("open") + (reason + about + pick("decline") if before else pick("decline") + about + reason)
    elif kind < 0.8:
        out = (pick("open") if rng.random() < 0.3 else "") + f"{pick('text')} {pick('silent')}"
        if rng.random() < 0.25:
            out += (", তাই " if language == "bn" else ", इसलिए " if language == "hi" else ", so ") + pick("decline")
    else:
        out = pick("short")
    out = out[:1].upper() + out[1:]
    return out.replace("{x}", x) + ("।" if before else ".")


#: Words that declining sentences are made of (all words of the parts, and of such sentences in general).
_more = (
    "a an the this that these those it its i i'm me my we you your he is are was were be been am do does did not no nor never nothing none any more so but and or of on in at to for from with by as if than then"
    " can could cannot can't won't don't didn't doesn't isn't wouldn't couldn't shall should may might would will able unable"
    " answer answers answered question questions asked text passage context excerpt source section lines article page book document material information details detail mention mentions mentioned"
    " state states stated specify specified given provided provide contain contains say says said tell tells know known knowledge unknown unclear clear enough sufficient insufficient help assist respond response reply"
    " comment speculate guess guessing sure certain sorry apologies apologise apologize afraid unfortunately regret teacher consult ask please other another here there about right discuss discussed scope outside beyond"
    " decline refuse rather leave open only just above below available model assistant language ai explain explained explains determine determined found find let put short too why how what which"
    " আমি আমার আমাকে আমরা আপনি আপনার তুমি এই এ এটি এটা এটির সেটি ওই তা তার তাই এর ও না নেই নয় নই হয় হয়নি যায় যায়নি যাচ্ছে গেল কি কিছু কিছুই কোনো কোন উত্তর উত্তরটি উত্তরের প্রশ্ন প্রশ্নের প্রশ্নটি প্রশ্নটির"
    " দিতে দেওয়া দেয়া দিন দিলে দিয়ে পারি পারছি পারব পারলাম পারলে পারেনি বলতে বলা বলার বলব বলে জানি জানা জানতে জেনে জানাতে নাও নিন নিয়ে সম্পর্কে সম্বন্ধে বিষয়ে বিষয়টি তথ্য তথ্যের উল্লেখ করা করতে করছি করি করে করবেন করুন করো"
    " প্রদত্ত দেওয়া অংশ অংশে অংশটি পাঠ্যে পাঠে লেখায় লেখা অনুচ্ছেদে অনুচ্ছেদ উৎসে উৎস প্রসঙ্গে অধ্যায়ে উপরে উপরের এখানে থেকে থাকায় ছাড়া তবে তবেই আরও যথেষ্ট পর্যাপ্ত সম্ভব ঠিক হবে হবেনা নিশ্চিত অনুমান মন্তব্য আলোচনার আলোচনা বাইরে"
    " সাহায্য দুঃখিত ক্ষমা মাফ অপারগ অক্ষম শিক্ষকের শিক্ষককে কাছে জিজ্ঞাসা একটি ভাষা মডেল হিসেবে পক্ষে কারণ খোলা রাখছি খুঁজে পাওয়া পেলাম"
)
# Words by which somebody declines or says that something is not said.
_declining = (
    "cannot can't couldn't won't doesn't isn't unable don't know unknown outside lacks lack silent consult missing prefer unanswerable unanswered more once rest needed unspecified unstated without sorry apologies apologise apologize afraid unfortunately decline refuse insufficient not no never nothing guess speculate unclear"
    " না নেই নয় নই হয়নি যায়নি অপর্যাপ্ত বাইরে আরও দিলে পেলে মডেল দুঃখিত ক্ষমা মাফ অপারগ অক্ষম नहीं क्षमा ne pas désolé impossible no siento"
)


class Lexicon:
    """Words that refusals consist of, from the parts they are composed of and from common words of such sentences."""

    def __init__(self, parts: dict[str, dict[str, tuple[str, ...]]] | None = None) -> None:
        listed = " ".join(text for p in (parts or REFUSAL_PARTS).values() for group in p.values() for text in group).replace("{x}", " ")
        self.usual = frozenset(canonical(f"{listed} {_more}").lower().replace(",", " ").replace(";", " ").split())
        self.declining = frozenset(canonical(_declining).split())


LEXICON = Lexicon()
# Phrases before a question that is only given back, and before an answer that follows one.
LEAD_INS = ("The question asks: ", "The question is: ", "You asked: ", "You want to know: ", "Question: ", "প্রশ্নে জানতে চাওয়া হয়েছে, ", "প্রশ্নটি হলো: ", "প্রশ্ন: ", "")
AND_THEN = (", and the reason is this: ", ", and the answer is: ", ", আর উত্তরটি হলো: ", ", আর কারণটি হলো: ", ": ", ". ")

HASHED = 2048
#: Rows of the corpus that the classifier may be fitted on, at most, and those of them that are made defective.
SAMPLE, REMADE = 5000, 1200
#: Least threshold on a probability.
LEAST_THRESHOLD = 0.4
_letter = r"[\w\u0900-\u0963\u0966-\u0dff\u200c\u200d]"
WORDS = re.compile(rf"{_letter}+(?:[-']{_letter}+)*")
_context_token = re.compile(rf"{_letter}+(?:-{_letter}+)*|[.?!।]")
_final = re.compile(r"[.?!।॥][\"”’')\]\s]*$")
_ellipsis = re.compile(r"(?:\.\s?\.+|…)[\"”’')\s]*$")
_open_end = re.compile(r"[,;:–—-]\s*$")
_sentence = re.compile(r"(?<=[.?!।])\s+")
_quoted = re.compile(r"[“\"«][^”\"»]{0,300}[”\"»]")
#: Answers for which the end must be looked up in the context.
UNENDED = r"(?:[^.?!।॥\"”’')\]\s]|\.\.|…)[\"”’')\]\s]*$"


def _plain(text: str) -> list[str]:
    return [w for w in WORDS.findall(text.lower()) if w[0].isalnum() or any(map(str.isalnum, w))]


def _end(answer: str) -> str:
    """The end of a text from the mark or blank before its last letter on, which decides how it ends."""
    at = len(answer)
    while at and not answer[at - 1].isalnum():
        at -= 1
    return answer[max(0, at - 1) :]


def context_tokens(*texts: str | None) -> list[str]:
    """Words and sentence ends of evidence and source, with words cut at line ends joined."""
    out: list[str] = []
    for t in texts:
        if t:
            out += _context_token.findall(re.sub(r"[-­]\s*\n\s*", "", canonical(t)).lower())
            out.append(".")
    return out


def tail_state(answer: str, context: list[str]) -> str:
    """How the last words of an answer go on in the context: end, mid, part (of a word) or none."""
    words = [w for w in _context_token.findall(answer.lower()) if w not in ".?!।"]
    if len(words) < 3 or len(context) < 3:
        return "none"
    a, b, last = words[-3:]
    state = "none"
    for i in range(len(context) - 2):
        if context[i] == a and context[i + 1] == b:
            follow = context[i + 2]
            if follow == last:
                if i + 3 >= len(context) or context[i + 3] in ".?!।":
                    return "end"
                state = "mid"
            elif follow.startswith(last) and state == "none":
                state = "part"
    return state


PAIR_FEATURES = 33


def pair_features(question: str, answer: str, state: str, languages: tuple[set[str], set[str]], lexicon: Lexicon = LEXICON) -> np.ndarray:
    """Features of a pair in the consistent form."""
    x = np.zeros(PAIR_FEATURES, np.float32)
    q, a = _plain(question), _plain(answer)
    end = _end(answer)
    ended, dots, hanging = bool(_final.search(end)), bool(_ellipsis.search(end)), bool(_open_end.search(end))
    x[0] = 1
    x[1] = not a
    x[2], x[3] = len(a) <= 1, len(a) <= 3
    x[4] = ended and not dots
    x[5] = dots and bool(a)
    x[6] = hanging and bool(a)
    unended = bool(a) and (dots or not ended)
    for i, s in enumerate(("mid", "part", "end", "none")):
        x[7 + i] = unended and len(a) > 3 and state == s
    have, want = Counter(a), Counter(q)
    shared = sum((have & want).values())
    share = shared / len(a) if a else 0.0
    x[11], x[12], x[13] = share, share >= 0.8, share >= 0.93
    covers = 0.0
    for s in _sentence.split(question):
        w = Counter(_plain(s))
        if sum(w.values()) >= 3:
            covers = max(covers, sum((w & have).values()) / sum(w.values()))
    x[14], x[15] = covers, covers >= 0.85
    known = set(q)
    late = 0
    for w in reversed(a):
        if w in known:
            break
        late += 1
    fresh = len(a) - shared
    x[16], x[17] = min(late, 4) / 4, late >= 1
    x[18] = min(fresh, 8) / 8
    x[19] = covers >= 0.85 and late == 0 and fresh <= 6 and len(a) > 3
    x[20] = covers >= 0.85 and late >= 1
    own, other = languages
    full = word_count(answer) >= FULL_SENTENCE and bool(other) and bool(own)
    x[21] = full and own.isdisjoint(other)
    x[22] = full
    x[23] = any(c in answer for c in "“”\"")
    x[24] = min(len(a), 60) / 60
    x[25] = any(c.isdigit() for c in answer)
    # Words that neither the question nor sentences that decline would use are content; a refusal has hardly any.
    said = _plain(_quoted.sub(" ", answer)) if x[23] else a
    # Endings of words may differ between question and answer.
    begun = {w[:4] for w in q if len(w) > 3}
    told = sum(w not in known and w not in lexicon.usual and w[:4] not in begun for w in said)
    declines = not lexicon.declining.isdisjoint(said)
    content = told / len(said) if said else 0.0
    x[26], x[27] = declines, declines and content <= 0.34
    x[28], x[29] = declines and content <= 0.15, declines and content * (1 - share) <= 0.05
    x[30] = content
    x[31] = declines and told <= 3 and len(said) >= 3 * told + 2
    x[32] = answer.strip().lower() in _stand_ins
    return x


class _Slots(dict):
    def __missing__(self, gram: str) -> int:
        if len(self) > 300_000:
            self.clear()
        slot = self[gram] = xxhash.xxh3_64_intdigest(gram) % HASHED
        return slot


_slot = _Slots().__getitem__
_digits = re.compile(r"\d+")


def hashed_ngrams(answer: str) -> list[int]:
    """Slots of word n-grams of one to three, with beginning and end marked."""
    words = ["^", *(_digits.sub("0", w) for w in WORDS.findall(answer.lower())), "$"]
    grams = words[1:-1] + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    grams += [f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:], strict=False)]
    return [_slot(g) for g in grams]


def design(rows: list[tuple[str, str, str, tuple[set[str], set[str]]]], lexicon: Lexicon = LEXICON) -> np.ndarray:
    """Feature rows of (question, answer, state, languages)."""
    x = np.zeros((len(rows), PAIR_FEATURES + HASHED), np.float32)
    for i, (question, answer, state, languages) in enumerate(rows):
        x[i, :PAIR_FEATURES] = pair_features(question, answer, state, languages, lexicon)
        slots = hashed_ngrams(answer)
        if slots:
            once = np.unique(slots)
            x[i, once + PAIR_FEATURES] = 2.0 / np.sqrt(len(once))
    return x


_by_script = ((re.compile("[ঀ-৥]"), "bn"), (re.compile("[ऀ-ॣ]"), "hi"))
_latin = re.compile("[A-Za-zÀ-ɏ]{2}")


def language_sets(texts: list[str], model: LanguageModel) -> list[set[str]]:
    """Languages of the full sentences of each text; a text in one script that only one language uses needs no model."""
    out: list[set[str]] = [set() for _ in texts]
    ask: list[tuple[int, str]] = []
    for i, t in enumerate(texts):
        if not t:
            continue
        scripts = [name for pattern, name in _by_script if pattern.search(t)]
        if len(scripts) == 1 and not _latin.search(t):
            out[i] = {scripts[0]}
        else:
            ask += [(i, s) for s in segments(t)]
    found: dict[int, list[tuple[str, str, float]]] = {}
    for (i, s), (name, confidence) in zip(ask, model.classify([s for _, s in ask]), strict=True):
        found.setdefault(i, []).append((s, name, confidence))
    for i, parts in found.items():
        out[i] = {name for name, _ in of_record(parts) if name != "und"}
    return out


@dataclass
class DefectModel:
    """Weights (features x defects), thresholds on the probability, and the language model."""

    weights: np.ndarray
    thresholds: np.ndarray
    languages: LanguageModel
    lexicon: Lexicon = LEXICON

    def judge(self, pairs: list[tuple[str | None, str | None, str | None, str | None]]) -> list[str | None]:
        """Defect of each (question, answer, evidence, source), or nothing."""
        questions = [canonical(p[0]) or "" for p in pairs]
        answers = [canonical(p[1]) or "" for p in pairs]
        ql, al = language_sets(questions, self.languages), language_sets(answers, self.languages)
        out: list[str | None] = []
        for at in range(0, len(pairs), 512):
            rows = []
            for i in range(at, min(at + 512, len(pairs))):
                answer = answers[i]
                end = _end(answer)
                unended = bool(end) and (not _final.search(end) or bool(_ellipsis.search(end)))
                state = tail_state(answer, context_tokens(pairs[i][2], pairs[i][3])) if unended else "none"
                rows.append((questions[i], answer, state, (ql[i], al[i])))
            p = 1 / (1 + np.exp(-np.clip(design(rows, self.lexicon) @ self.weights, -30, 30)))
            # How far above its threshold, on a common scale.
            lead = (p - self.thresholds) / (1 - self.thresholds)
            best = lead.argmax(axis=1)
            out += [DEFECTS[b] if row[b] > 0 else None for b, row in zip(best, lead, strict=True)]
        return out


def _fit_weights(x: np.ndarray, y: np.ndarray, penalty: float = 2e-4, steps: int = 250) -> np.ndarray:
    """Logistic regressions side by side, by Adam on the whole sample."""
    w = np.zeros((x.shape[1], y.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) / len(x) + penalty * w
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _calibrate(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each defect the threshold with the best F1 on held-out pairs, at three quarters of its plateau."""
    grid = np.linspace(LEAST_THRESHOLD, 0.95, 56)
    out = []
    for j in range(y.shape[1]):
        scores = []
        for t in grid:
            hit = p[:, j] > t
            tp = float((hit & (y[:, j] > 0)).sum())
            scores.append(2 * tp / max(1.0, hit.sum() + (y[:, j] > 0).sum()))
        best = np.flatnonzero(np.array(scores) >= max(scores) - 1e-9)
        out.append(grid[best[(3 * len(best)) // 4]])
    return np.array(out, np.float32)


Pair = tuple[str, str, str, tuple[set[str], set[str]]]


def synthesise(
    clean: list[tuple[str, str, set[str], set[str]]], seed: int = 5, parts: dict[str, dict[str, tuple[str, ...]]] | None = None
) -> tuple[list[Pair], list[int]]:
    """Training pairs and labels (index of the defect, -1 for sound) from sound (question, answer, languages)."""
    rng = random.Random(seed)
    pairs: list[Pair] = []
    labels: list[int] = []

    def add(q: str, a: str, state: str, langs: tuple[set[str], set[str]], label: str | None) -> None:
        pairs.append((q, a, state, langs))
        labels.append(DEFECTS.index(label) if label else -1)

    by_language: dict[str, list[str]] = {}
    for _, a, _, al in clean:
        if len(al) == 1 and word_count(a) >= FULL_SENTENCE:
            by_language.setdefault(next(iter(al)), []).append(a)
    for name, group in SEEDS.items():
        by_language.setdefault(name.split("-")[0], []).extend(group)
    for q, a, ql, al in clean:
        langs, words = (ql, al or ql), a.split()
        add(q, a, "none", langs, None)
        bare = re.sub(r"[.?!।\s]+$", "", a)
        kind = rng.random()
        if len(words) > 3:
            if rng.random() < 0.5:
                add(q, bare, "end" if kind < 0.75 else "none", langs, None)
            cut = rng.randint(max(2, len(words) // 3), len(words) - 1)
            short = " ".join(words[:cut])
            state = "mid"
            if kind < 0.3 and len(words[cut]) > 3:
                short, state = f"{short} {words[cut][: rng.randint(1, len(words[cut]) - 2)]}", "part"
            short = re.sub(r"[.?!।,;]+$", "", short) + rng.choice(["", "", "…", "...", ","])
            if not _final.search(short) or _ellipsis.search(short):
                add(q, short, state if rng.random() < 0.9 else "none", langs, "truncated")
        term = " ".join(w for w in words[: rng.randint(1, 3)])
        add(q, re.sub(r"[.,;]+$", "", term), "none", (ql, set()), None)
        # Terms that no corpus shows: capitals, capitals with digits, a made-up name.
        made_up = "".join(rng.choice("ABCDEFGHIKLMNOPRSTUVW") for _ in range(rng.randint(2, 5))) + rng.choice(["", "", str(rng.randint(2, 99))])
        add(q, made_up if rng.random() < 0.6 else made_up.capitalize() + rng.choice(["", " " + words[0].lower()]), "none", (ql, set()), None)
        asked = _sentence.split(q)
        whole = rng.choice([q, rng.choice(asked)])
        if len(whole.split()) > 3:
            form = rng.random()
            copied = whole
            if form < 0.2:
                copied = whole.upper()
            elif form < 0.4:
                copied = " ".join(rng.sample(whole.split(), len(whole.split())))
            elif form < 0.55:
                copied = re.sub(r"[.?!।,]", "", whole)
            lead = rng.choice(LEAD_INS)
            add(q, (lead + (copied[:1].lower() + copied[1:] if lead else copied)).strip(), "none", (ql, ql), "copy")
            part = re.sub(r"[.?!।]+$", "", rng.choice(asked))
            add(q, part + rng.choice(AND_THEN) + (a[:1].lower() + a[1:]), "none", (ql, ql | al), None)
            add(q, part + rng.choice(AND_THEN) + re.sub(r"[.,;]+$", "", term).lower(), "none", (ql, ql), None)
        tongue = min(ql) if ql else "en"
        if rng.random() < 0.8:
            # What a refusal is about stands in the question or is named anew.
            tokens = re.sub(r"[.?!।,]", "", rng.choice(asked) if rng.random() < 0.6 else rng.choice(clean)[1]).split()
            at = rng.randrange(len(tokens)) if tokens else 0
            x = " ".join(tokens[at : at + rng.randint(1, 4)])
            add(q, compose_refusal(rng, tongue, x, parts), "none", (ql, ql), "refusal")
        if tongue in MENTION_FRAMES and rng.random() < 0.5:
            if rng.random() < 0.5:
                quoted = re.sub(r"[.।]$", "", compose_refusal(rng, tongue, "", parts)).strip()
                fill = {"r": quoted, "n": str(rng.randint(2, 900)), "w": re.sub(r"[.,;?!।]", "", rng.choice(words)).lower() if words else "box"}
                add(q, rng.choice(MENTION_FRAMES[tongue]).format(**fill), "none", (ql, ql), None)
            else:
                add(q, rng.choice(MENTION_OPENINGS[tongue]) + a[:1].lower() + a[1:], "none", (ql, al or ql), None)
        if rng.random() < 0.25:
            add(q, rng.choice(STAND_INS), "none", (ql, set()), "empty")
        others = [n for n in by_language if n not in ql]
        if others and ql and rng.random() < 0.5:
            name = rng.choice(others)
            add(q, rng.choice(by_language[name]), "none", (ql, {name}), "other_language")
    return pairs, labels


def train(
    rows: list[tuple[str | None, str | None]], languages: LanguageModel, seed: int = 5, parts: dict[str, dict[str, tuple[str, ...]]] | None = None
) -> DefectModel:
    """Classifier from a sample of (question, answer)."""
    lexicon = Lexicon(parts) if parts else LEXICON
    kept = [(canonical(q), canonical(a)) for q, a in rows if q and a and len(_plain(a)) > 0]
    ql, al = language_sets([q for q, _ in kept], languages), language_sets([a for _, a in kept], languages)
    stand_ins = {s.strip().lower() for s in STAND_INS}
    clean = []
    for (q, a), lq, la in zip(kept, ql, al, strict=True):
        low = a.strip().lower()
        shared = Counter(_plain(a)) & Counter(_plain(q))
        # The sample is taken as sound but for what the synthetic defects would contradict outright.
        if low in stand_ins or pair_features(q, a, "none", (lq, la), lexicon)[28]:
            continue
        if sum(shared.values()) >= 0.85 * len(_plain(a)) or (lq and la and lq.isdisjoint(la)):
            continue
        if len(a.split()) > 3 and (not _final.search(a) or _ellipsis.search(a)):
            continue
        clean.append((q, a, lq, la))
    pairs, labels = synthesise(clean[:REMADE], seed, parts)
    for q, a, lq, la in clean[REMADE:]:
        pairs.append((q, a, "none", (lq, la)))
        labels.append(-1)
    if not pairs:
        pairs, labels = synthesise([("What is a cell?", "A cell is the smallest unit of life.", {"en"}, {"en"})] * 20, seed, parts)
    for s in STAND_INS:
        for _ in range(4):
            pairs.append(("What is it?", s, "none", ({"en"}, set())))
            labels.append(0)
    x = design(pairs, lexicon)
    y = (np.array(labels)[:, None] == np.arange(len(DEFECTS))).astype(np.float32)
    chance = np.random.default_rng(seed)
    held = chance.random(len(x)) < 0.25
    fitted = x[~held]
    # Half of the rows are fitted without their n-grams, so that what the features say does not hang on known phrases.
    fitted[chance.random(len(fitted)) < 0.5, PAIR_FEATURES:] = 0
    w = _fit_weights(fitted, y[~held])
    p = 1 / (1 + np.exp(-np.clip(x[held] @ w, -30, 30)))
    return DefectModel(w, _calibrate(p, y[held]), languages, lexicon)


def fit_defects(df: DataFrame, question: str = "question", answer: str = "answer", sample: int = SAMPLE, key: str | None = None) -> DefectModel:
    """Classifier for a corpus, fitted on the ``sample`` pairs with the least hashes of key and texts."""
    known = df.select(
        F.col(f"`{question}`").alias("q"), F.col(f"`{answer}`").alias("a"), (F.col(f"`{key}`") if key else F.lit(0)).alias("key")
    ).where("q is not null and a is not null")
    rows = hashed_sample(known, F.xxhash64("key", "q", "a"), sample, "q", "a", "key").toPandas()
    return train(list(zip(rows["q"], rows["a"], strict=True)), fit(df, question, key=key))


def find_defects(
    df: DataFrame,
    key: str = "pair_id",
    question: str = "question",
    answer: str = "answer",
    evidence: str = "evidence",
    source: str = "source_text",
    model: DefectModel | None = None,
) -> DataFrame:
    """Rows (key, defect) of the defective pairs; keys delivered twice count once."""
    model = model or fit_defects(df, question, answer, key=key)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at : at + 2048]
                found = m.judge(list(zip(part["q"], part["a"], part["e"], part["s"], strict=True)))
                out = pd.DataFrame({"key": part["key"].to_numpy(), "defect": pd.Series(found, dtype=object)})
                yield out[out["defect"].notna()]

    # The context is only read for answers whose end is in doubt.
    doubt = F.col(f"`{answer}`").rlike(UNENDED)
    return (
        df.where(F.col(f"`{key}`").isNotNull())
        .select(
            F.col(f"`{key}`").alias("key"),
            F.col(f"`{question}`").alias("q"),
            F.col(f"`{answer}`").alias("a"),
            F.when(doubt, F.col(f"`{evidence}`")).alias("e"),
            F.when(doubt, F.col(f"`{source}`")).alias("s"),
        )
        .mapInPandas(run, f"key {kind}, defect string")
        .groupBy("key")
        .agg(F.min("defect").alias("defect"))
        .withColumnRenamed("key", key)
    )
