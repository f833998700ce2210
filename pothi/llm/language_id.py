"""Languages of records and of the segments of mixed ones, by nearest centroids.

A text in the consistent form is cut into sentences, and where the script
changes for several words.  A segment becomes a normalised TF-IDF vector of
hashed character n-grams that keep word boundaries.  Each language has several
centroids, clustered from a small seed of sentences and from a bounded sample
of corpus segments that the seed labels with a wide margin; the nearest one by
cosine names the language, and a segment too far from every centroid is
rejected as ``und``.  The confidence sets the nearest centroid against the
nearest one of any other language.

A record has the languages of its full sentences (``FULL_SENTENCE`` words or
more); shorter segments count only where there is no full sentence, so that
borrowed terms and names do not make a record mixed.

Defined results: null, empty and blank texts have the language ``und`` with
confidence 0; texts are read whole; every row gives its own result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pothi.llm.unicode_form import canonical, canonical_column
from pothi.operators.sampling import hashed_sample

# A few sentences of each language and script to begin with.
SEEDS: dict[str, tuple[str, ...]] = {
    "en": (
        "What does the new teacher of the school do after it rains in the village?", "How many days does this work need before the end of the month?",
        "Why is the water in the river cold when the sun shines above the hills?", "It was seen that the children near the house collected both the books and the pens.",
        "Explain what happens to the seed when the farmer puts it into wet soil.", "During the lesson at the school, a small model showed how the wheel turns.",
        "The answer is written on the board, so the students copy it into their notebooks.", "Which things are kept behind the door, and who uses them every week?",
        "When did they build the bridge across the wide river, and with what was it made?", "He and she drew a picture of the old market from the top of the tower.",
        "Because the light is strong, we can see the whole town from here.", "By mixing the two liquids slowly, you get a clear solution without any smell.",
    ),
    "fr": (
        "Pourquoi le professeur de la ville montre-t-il la carte aux élèves après la pluie?", "Près de la rivière, les enfants ont vu que le pont est très ancien et fragile.",
        "Qu'est-ce que le fermier fait dans le champ quand il y a du soleil?", "Combien de jours faut-il pour remplir ce réservoir avec une petite pompe?",
        "Après le cours, nous avons écrit une lettre à notre ami qui habite loin d'ici.", "Comment le vent retient-il un nuage au-dessus des montagnes?",
        "Les livres sont sur la table et le cahier est dans le tiroir de son bureau.", "Elle a dit que ces arbres donnent des fruits sucrés en été.",
    ),
    "es": (
        "¿Por qué el maestro de la ciudad muestra el mapa a los alumnos después de la lluvia?", "Cerca del río, los niños vieron que el puente es muy antiguo y frágil.",
        "¿Qué hace el agricultor en el campo cuando hay sol?", "¿Cuántos días se necesitan para llenar este depósito con una bomba pequeña?",
        "Después de la clase escribimos una carta a nuestro amigo que vive lejos de aquí.", "¿Cómo protege el viento una nube sobre las montañas?",
        "Los libros están sobre la mesa y el cuaderno está en el cajón de su escritorio.", "Ella dijo que estos árboles dan frutas dulces en verano.",
    ),
    "bn": (
        "বৃষ্টির পরে গ্রামের নতুন শিক্ষক কী করেন?", "এই কাজ শেষ করতে কত দিন লাগে এবং কে তা করে?", "সূর্য উঠলে নদীর পানি কেন ঠান্ডা থাকে?",
        "বাড়ির কাছে শিশুরা বই ও কলম একসঙ্গে সাজিয়ে রাখে।", "কৃষক ভেজা মাটিতে বীজ রাখলে কী ঘটে তা ব্যাখ্যা করো।", "বিদ্যালয়ের পাঠে একটি ছোট নমুনা দেখায় চাকা কীভাবে ঘোরে।",
        "উত্তরটি বোর্ডে লেখা আছে, তাই শিক্ষার্থীরা খাতায় তুলে নেয়।", "দরজার পেছনে কোন কোন জিনিস রাখা আছে বলো।",
    ),
    "bn-Latn": (
        "gramer notun shikkhok brishtir pore ki koren ebong keno?", "ei kaj shesh korte koto din lage ar ke ta kore?", "shurjo uthle nodir pani keno thanda thake?",
        "barir kache shishura boi o kolom ekshonge shajiye rakhe, ar ekti chhobi dekhay.", "krishok bheja matite bij rakhle ki ghote ta bolo.",
        "amader er bari theke ekti boro pukur dekha jay, tar pashe gachh ache.", "tumi kothay jabe ar kokhon fire ashbe amake bole dio.",
        "shohorer purono bajare onek lok dhire dhire hete jay diye.",
    ),
    "hi": (
        "बारिश के बाद गाँव का नया शिक्षक क्या करता है?", "यह काम पूरा करने में कितने दिन लगते हैं और इसे कौन करता है?", "सूरज निकलने पर नदी का पानी ठंडा क्यों रहता है?",
        "घर के पास बच्चे किताबें और कलम साथ में रखते हैं।", "किसान गीली मिट्टी में बीज डालता है तो क्या होता है समझाओ।", "विद्यालय के पाठ में एक छोटा नमूना दिखाता है कि पहिया कैसे घूमता है।",
        "उत्तर बोर्ड पर लिखा है, इसलिए छात्र उसे कॉपी में लिखते हैं।", "दरवाज़े के पीछे कौन सी चीज़ें रखी हैं?",
    ),
    "hi-Latn": (
        "gaon ka naya shikshak baarish ke baad kya karta hai?", "yeh kaam poora karne mein kitne din lagte hain aur ise kaun karta hai?",
        "sooraj nikalne par nadi ka paani thanda kyon rehta hai?", "ghar ke paas bachche kitaabein aur kalam saath mein rakhte hain.",
        "kisaan geeli mitti mein beej daalta hai to kya hota hai samjhao.", "darwaze ke peeche kaun si cheezein rakhi hain, phir batao.",
    ),
}
# Spellings of labels that name a language.
LABELS: dict[str, str] = {
    "bn": "bn", "ben": "bn", "bangla": "bn", "bengali": "bn", "বাংলা": "bn", "en": "en", "eng": "en", "english": "en", "ইংরেজি": "en",
    "hi": "hi", "hin": "hi", "hindi": "hi", "हिन्दी": "hi", "हिंदी": "hi", "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr",
    "français": "fr", "francais": "fr", "es": "es", "spa": "es", "spanish": "es", "español": "es", "espanol": "es", "castellano": "es",
}

DIMENSIONS = 4096
ORDERS = (1, 2, 3, 4)
FULL_SENTENCE = 4
#: Corpus segments that the seed may label for the final centroids, at most.
SAMPLE = 3000
CENTROIDS = 4
#: Cosine of seed and corpus segments from which the seed's label is taken, and its lead over other languages.
SEED_LEAD = 1.25
#: Share of the sampled segments of a language that its rejection distance lets pass.
KEPT = 0.999

_sentence_end = re.compile(r"(?<=[.?!।॥？！])[\s\"”'’)]*\s+|\n+|(?<=\s)(?=[¿¡])")
_scripts = re.compile(r"([A-Za-zÀ-ɏ]+)|([ঀ-৥ৰ-৿]+)|([ऀ-ॣ॰-ॿ]+)|([^\W\d_]+)")
_not_letters = re.compile(r"(?:[^\wऀ-෿‌‍]|[\d_।॥])+")


def segments(text: str | None) -> list[str]:
    """Sentences of a text, cut also where full sentences of two scripts stand side by side."""
    out: list[str] = []
    for sentence in _sentence_end.split(text or ""):
        if not sentence or not sentence.strip():
            continue
        runs: list[list] = []
        for m in _scripts.finditer(sentence):
            if runs and runs[-1][0] == m.lastindex:
                runs[-1][2] += 1
            else:
                runs.append([m.lastindex, m.start(), 1])
        long = [r for r in runs if r[2] >= FULL_SENTENCE]
        cuts = [b[1] for a, b in zip(long, long[1:], strict=False) if a[0] != b[0]]
        for low, high in zip([0, *cuts], [*cuts, len(sentence)], strict=True):
            if sentence[low:high].strip():
                out.append(sentence[low:high].strip())
    return out


def word_count(segment: str) -> int:
    return sum(1 for w in segment.split() if any(c.isalpha() for c in w))


def _slots(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts and slots of their hashed n-grams, order by order; digits and marks only part words."""
    codes, owner = [], []
    for i, t in enumerate(texts):
        clean = " " + _not_letters.sub(" ", t.lower()).strip() + " "
        codes.append(np.frombuffer(clean.encode("utf-32-le"), np.uint32))
        owner.append(np.full(len(codes[-1]), i, np.int64))
    if not codes:
        return
    code, owner = np.concatenate(codes).astype(np.uint64), np.concatenate(owner)
    gram = np.zeros(len(code), np.uint64)
    for k in ORDERS:
        stop = len(code) - k + 1
        if stop <= 0:
            break
        gram = (gram[:stop] * np.uint64(0x100000001B3)) ^ (code[k - 1 :] * np.uint64(0x9E3779B97F4A7C15))
        whole = owner[:stop] == owner[k - 1 :]
        if k == 1:
            whole &= code != 32
        slot = ((gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(52)).astype(np.int64)
        yield owner[:stop][whole], slot[whole]


def features(texts: list[str]) -> np.ndarray:
    """Counts of hashed n-grams, a dense row for each text."""
    table = np.zeros(len(texts) * DIMENSIONS, np.float32)
    for owner, slot in _slots(texts):
        table += np.bincount(owner * DIMENSIONS + slot, minlength=len(table)).astype(np.float32)
    return table.reshape(len(texts), DIMENSIONS)


def document_frequency(texts: list[str]) -> np.ndarray:
    """Number of texts that have each slot."""
    present = np.zeros(len(texts) * DIMENSIONS, bool)
    for owner, slot in _slots(texts):
        present[owner * DIMENSIONS + slot] = True
    return present.reshape(len(texts), DIMENSIONS).sum(axis=0)


def script_of(text: str) -> int:
    """The script of most words of a text: Latin, Bengali, Devanagari, another, or none (0)."""
    seen = np.bincount([m.lastindex for m in _scripts.finditer(text)], minlength=5)
    return int(seen.argmax())


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each script of a partition, the number of texts and of those that have each slot."""
    total, texts_of = np.zeros((5, DIMENSIONS), np.int64), np.zeros(5, np.int64)
    for pdf in batches:
        texts = [t for t in pdf["text"] if t]
        scripts = np.array([script_of(t) for t in texts], np.int64)
        for g in np.unique(scripts):
            own = [t for t, s in zip(texts, scripts, strict=True) if s == g]
            for at in range(0, len(own), 1024):
                total[g] += document_frequency(own[at : at + 1024])
            texts_of[g] += len(own)
    for g in np.flatnonzero(texts_of):
        yield pd.DataFrame({"script": [int(g)], "n": [int(texts_of[g])], "df": [total[g].tolist()]})


def corpus_shares(texts: DataFrame) -> np.ndarray:
    """For each script of a corpus (column ``text``), the share of its texts that have each slot; all texts are counted."""
    parts = texts.select("text").where(F.col("text").rlike(r"\S")).mapInPandas(_frequencies, "script int, n long, df array<long>")
    # One row for each script and partition goes into sums by script and slot; what comes back has five scripts at most.
    summed = parts.select("script", "n", F.posexplode("df").alias("slot", "df")).groupBy("script", "slot").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).collect()
    out = np.zeros((5, DIMENSIONS))
    for r in summed:
        out[r["script"], r["slot"]] = r["df"] / r["n"]
    return out[out.any(axis=1)]


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


@dataclass
class LanguageModel:
    """Centroids (rows of unit length), the language of each, and the least cosine at which it accepts."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: np.ndarray
    least: np.ndarray

    def classify(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, confidence) of each text; ``und`` where every centroid is too far."""
        out: list[tuple[str, float]] = []
        names = np.unique(self.languages)
        for at in range(0, len(texts), 256):
            x = _weighted(features(texts[at : at + 256]), self.idf)
            cosine = x @ self.centroids.T
            best_of = np.stack([cosine[:, self.languages == n].max(axis=1) for n in names], 1)
            order = np.argsort(-best_of, axis=1, kind="stable")
            for row, (cos, first) in enumerate(zip(best_of, order, strict=True)):
                a, b = cos[first[0]], cos[first[1]] if len(first) > 1 else 0.0
                near = cosine[row] >= self.least
                accepted = near[self.languages == names[first[0]]].any()
                out.append((str(names[first[0]]), float(a / (a + max(b, 0.0)))) if accepted and a > 0 else ("und", 0.0))
        return out


def _cluster(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Spherical k-means; the first centres are far apart."""
    centres = [x.mean(axis=0)]
    for _ in range(1, min(k, len(x))):
        nearest = np.max(x @ np.stack(centres).T, axis=1)
        centres.append(x[int(np.argmin(nearest))])
    c = np.stack(centres)
    for _ in range(8):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def train(corpus: list[str], shares: np.ndarray | None = None) -> LanguageModel:
    """Model from the seeds and from corpus segments; ``shares`` are the document frequencies of the whole corpus by script.

    Languages and scripts weigh alike in the IDF, whatever their shares of the corpus.
    """
    seeds = [(name, s) for name, group in SEEDS.items() for s in group]
    labels = np.array([name for name, _ in seeds])
    seed_counts = features([s for _, s in seeds])
    counts = np.concatenate([seed_counts, features(corpus)]) if corpus else seed_counts
    by_group = np.stack([(seed_counts[labels == name] > 0).mean(axis=0) for name in SEEDS])
    if shares is not None and len(shares):
        by_group = np.concatenate([by_group, shares])
    n = len(seed_counts)
    idf = (1 + np.log1p(n) - np.log1p(n * by_group.mean(axis=0))).astype(np.float32)
    x = _weighted(counts, idf)
    sx, cx = x[: len(seeds)], x[len(seeds) :]
    names = list(SEEDS)
    first = np.stack([sx[labels == n].mean(axis=0) for n in names])
    first /= np.linalg.norm(first, axis=1, keepdims=True)
    groups = {n: [sx[labels == n]] for n in names}
    if len(cx):
        cosine = cx @ first.T
        order = np.argsort(-cosine, axis=1)
        best = np.take_along_axis(cosine, order[:, :1], 1)[:, 0]
        second = np.take_along_axis(cosine, order[:, 1:2], 1)[:, 0]
        sure = best > SEED_LEAD * np.maximum(second, 0.02)
        for j, n in enumerate(names):
            groups[n].append(cx[sure & (order[:, 0] == j)])
    centroids, languages, least = [], [], []
    for n in names:
        own = np.concatenate(groups[n])
        c = _cluster(own, CENTROIDS, 1)
        # How near a segment comes to the others of its language; its own share in the centroids would flatter it.
        rest = own.sum(axis=0) - own
        reach = np.einsum("ij,ij->i", own, rest) / np.maximum(np.linalg.norm(rest, axis=1), 1e-9)
        centroids.append(c)
        languages += [n.split("-")[0]] * len(c)
        least += [0.5 * float(np.quantile(reach, 1 - KEPT))] * len(c)
    return LanguageModel(idf, np.concatenate(centroids).astype(np.float32), np.array(languages), np.array(least))


def fit(df: DataFrame, text: str = "question", sample: int = SAMPLE, key: str | None = None) -> LanguageModel:
    """Model for a corpus: the seeds and at most ``sample`` segments of the rows with the least hashes of key and text."""
    known = df.select(F.col(f"`{text}`").alias("text"), (F.col(f"`{key}`") if key else F.lit(0)).alias("key")).where(F.col("text").isNotNull())
    rows = (
        hashed_sample(known, F.xxhash64("key", "text"), sample // 2, "text", "key")
        .select(canonical_column(F.col("text")).alias("text"))
        .toPandas()
    )
    corpus = [s for t in rows["text"] for s in segments(t) if word_count(s) >= FULL_SENTENCE]
    return train(corpus[:sample], corpus_shares(known.select("text")))


def languages_of(texts: list[str | None], model: LanguageModel) -> list[list[tuple[str, str, float]]]:
    """For each text, (segment, language, confidence) in order; texts are brought into the consistent form first."""
    parts = [segments(canonical(t)) for t in texts]
    flat = [s for p in parts for s in p]
    named = iter(model.classify(flat))
    return [[(s, *next(named)) for s in p] for p in parts]


def of_record(found: list[tuple[str, str, float]]) -> list[tuple[str, float]]:
    """Languages of a record by falling number of words, with the mean confidence of their segments."""
    full = [f for f in found if word_count(f[0]) >= FULL_SENTENCE and f[1] != "und"]
    chosen = full or [max(found, key=lambda f: word_count(f[0]))] if found else []
    weight: dict[str, list[float]] = {}
    for s, name, confidence in chosen:
        n = max(1, word_count(s))
        w = weight.setdefault(name, [0.0, 0.0])
        w[0] += n
        w[1] += n * confidence
    return [(name, w[1] / w[0]) for name, w in sorted(weight.items(), key=lambda x: (-x[1][0], x[0]))] or [("und", 0.0)]


def named_by(label: str | None) -> str | None:
    """Language that a label names, or nothing for a missing or meaningless one."""
    if not label or not label.strip():
        return None
    plain = label.strip().lower()
    return LABELS.get(plain) or LABELS.get(re.split(r"[-_ (]", plain)[0])


def _records(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for pdf in batches:
            keys, names, confidences, ranks, right = [], [], [], [], []
            for key, label, found in zip(pdf["key"], pdf["label"], languages_of(pdf["text"].tolist(), m), strict=True):
                own = of_record(found)
                ok = len(own) == 1 and named_by(label) == own[0][0]
                for rank, (name, confidence) in enumerate(own):
                    keys.append(key)
                    names.append(name)
                    confidences.append(confidence)
                    ranks.append(rank)
                    right.append(ok)
            yield pd.DataFrame({"key": keys, "language": names, "confidence": confidences, "rank": ranks, "label_right": right})

    return run


def record_languages(df: DataFrame, key: str = "pair_id", text: str = "question", label: str = "language", model: LanguageModel | None = None) -> DataFrame:
    """Rows (key, language, confidence, rank, label_right): each language of each record, the one with most words first."""
    model = model or fit(df, text, key=key)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()
    return (
        df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").alias("label"))
        .mapInPandas(_records(shared), f"key {kind}, language string, confidence double, rank int, label_right boolean")
        .withColumnRenamed("key", key)
    )


def segment_languages(df: DataFrame, key: str = "pair_id", text: str = "question", model: LanguageModel | None = None) -> DataFrame:
    """Rows (key, position, segment, language, confidence) of every segment of every text."""
    model = model or fit(df, text, key=key)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            rows = [
                (key, position, *found)
                for key, all_found in zip(pdf["key"], languages_of(pdf["text"].tolist(), m), strict=True)
                for position, found in enumerate(all_found)
            ]
            yield pd.DataFrame(rows, columns=["key", "position", "segment", "language", "confidence"])

    return (
        df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
        .mapInPandas(run, f"key {kind}, position int, segment string, language string, confidence double")
        .withColumnRenamed("key", key)
    )
