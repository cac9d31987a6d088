"""Languages of texts, and of spans within mixed texts.

A text is cut into words (runs of letters). The script of a word narrows its candidates to
the languages that were seen to be written in it; each candidate scores the word's runs of
1 to GRAM characters by their frequencies in the language. Viterbi's algorithm then labels
the words of a text with the languages of the best path, where each switch costs SWITCH,
so that a foreign word or a name doesn't break a span. A text's language is the one that
most of its letters are labelled with, its score their share.

Learning counts hashed runs of characters, a table of bounded size, over all labelled
texts: tasks add up their own, the counts are summed by a shuffle. Texts are labelled
side by side, in pieces of PIECE words with OVERLAP more on either side, in which paths
come together; so one long text costs no more than many short ones.

Defined results: a text that is null or has no letter is `und` with score 0, and so is
every text if no language was learned; words of a script that no learned language is
written in take the language around them, and a text of nothing else the most frequent
one; a null id counts as the word null; equal scores go to the first language in
code-point order. Rows that repeat an id are judged each on its own; columns of other
names don't matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thalweg.llm.tables import text_runs

GRAM = 4
#: Buckets of hashed runs, for as many languages as TABLE allows; fewer for more languages.
BUCKETS, TABLE, MOST_LANGUAGES = 1 << 16, 1 << 24, 4096
#: What a switch of languages costs, and what a word may count at most.
SWITCH, CLIP = 8.0, 8.0
#: Least share of a language's letters for it to be written in a script.
WRITTEN_IN = 0.01
SMOOTHING = 0.5
PIECE, OVERLAP = 4096, 64
#: Bytes of texts that are labelled at once, for a few languages; fewer for more.
SLICE_BYTES = 8_000_000
#: Letters of a word that are scored as one.
LONGEST = 64
UNKNOWN = "und"

# First characters of ranges of scripts; a range ends where the next begins.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x07C0, "nko"),
    (0x0800, "samaritan"), (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "cherokee"),
    (0x1400, "canadian"), (0x1680, "ogham"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "other"), (0x1D00, "latin"), (0x1F00, "greek"), (0x2000, "latin"),
    (0x2C00, "glagolitic"), (0x2C60, "latin"), (0x2C80, "coptic"), (0x2D00, "georgian"), (0x2D30, "tifinagh"), (0x2D80, "ethiopic"), (0x2DE0, "cyrillic"), (0x2E80, "han"), (0x3040, "kana"), (0x3100, "bopomofo"),
    (0x3130, "hangul"), (0x3190, "bopomofo"), (0x31F0, "kana"), (0x3200, "han"), (0xA000, "yi"), (0xA4D0, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"),
    (0xA8E0, "devanagari"), (0xA900, "other"), (0xA960, "hangul"), (0xA980, "other"), (0xAB00, "ethiopic"), (0xAB30, "latin"), (0xAB70, "cherokee"), (0xABC0, "other"), (0xAC00, "hangul"), (0xD800, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFE70, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"),
    (0xFFE0, "other"), (0x1B000, "kana"), (0x1B170, "other"), (0x1E000, "glagolitic"), (0x1E030, "cyrillic"), (0x1E100, "other"), (0x1EE00, "arabic"), (0x1F000, "other"), (0x20000, "han"), (0x32000, "other"),
)
SCRIPT_NAMES = tuple(sorted({name for _, name in SCRIPTS}))

_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    languages: list[str]
    #: Log probabilities of runs of characters (buckets, languages).
    grams: object
    #: Whether a language is written in a script (scripts, languages).
    written: object
    #: Log shares of the languages' letters.
    prior: object


def words_of(text: str) -> list[str]:
    """Runs of letters, in pieces of LONGEST at most."""
    found = _WORD.findall(text)
    if max(map(len, found), default=0) > LONGEST:
        found = [w[a : a + LONGEST] for w in found for a in range(0, len(w), LONGEST)]
    return found


def grams_of(words: list[str], buckets: int):
    """(bucket of each run of 1 to GRAM characters of the words, where each word's begin, the script of each word, its letters)."""
    import numpy as np

    lower = [w.lower() for w in words]
    sizes = np.array([len(w) for w in lower], "i8") + 2
    letters = np.frombuffer(("\x02" + "\x03\x02".join(lower) + "\x03").encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    left = np.repeat(begins + sizes, sizes) - np.arange(len(letters))  # characters to the word's end
    runs = np.zeros((len(letters), GRAM), "i8")
    h = np.zeros(len(letters), "u8")
    for n in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([letters[n:], np.zeros(n, "u8")]) + np.uint64(n + 1)
        spread = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        # a run beyond the word, and an end alone, is none
        runs[:, n] = np.where((left > n) & ((n > 0) | (letters > 3)), ((spread >> np.uint64(32)) % np.uint64(buckets)).astype("i8"), -1)
    there = runs >= 0
    counts = np.add.reduceat(there.sum(1), begins)
    starts = np.array([a for a, _ in SCRIPTS])
    kinds = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])
    scripts = kinds[np.searchsorted(starts, letters[begins + 1], "right") - 1]
    plain = np.array([len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in words], "i8")
    return runs[there], np.concatenate([[0], np.cumsum(counts)[:-1]]), scripts, plain


def buckets_for(languages: int) -> int:
    if languages > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return min(BUCKETS, 1 << ((TABLE // max(1, languages)).bit_length() - 1))


def gram_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """lang, bucket, n: counts of hashed runs of docs (text, lang); below 0, -1 - bucket is a script, and n its letters."""

    def count(batches):
        from collections import Counter, defaultdict

        import numpy as np
        import pyarrow as pa

        found = defaultdict(lambda: np.zeros(buckets + len(SCRIPT_NAMES), "i8"))
        for b in batches:
            langs = b.column(1).to_pylist()
            for at, texts in text_runs(b.column(0), SLICE_BYTES):
                words = defaultdict(Counter)
                for lang, text in zip(langs[at:], texts):
                    words[lang].update(words_of(text.decode()))
                for lang, own in words.items():
                    if not own:
                        continue
                    runs, begins, scripts, plain = grams_of(list(own), buckets)
                    n = np.array(list(own.values()), "i8")
                    each = np.repeat(n, np.diff(np.append(begins, len(runs))))
                    found[lang][:buckets] += np.bincount(runs, each, buckets).astype("i8")
                    found[lang][buckets:] += np.bincount(scripts, n * plain, len(SCRIPT_NAMES)).astype("i8")
        for lang, n in found.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.where(at < buckets, at, buckets - 1 - at).astype("i4")), pa.array(n[at])], ["lang", "bucket", "n"])

    counts = docs.where("lang is not null").select(F.col("text").cast("binary"), F.col("lang").cast("string").alias("lang")).mapInArrow(count, "lang string, bucket int, n long")
    return counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> Model:
    """The languages of docs (text, lang) by all their texts; rows without a language don't count.

    The driver holds the table of counts, of at most TABLE numbers.
    """
    import numpy as np

    languages = sorted(r[0] for r in docs.where("lang is not null").select(F.col("lang").cast("string")).distinct().limit(MOST_LANGUAGES + 1).collect())
    buckets = buckets_for(len(languages))
    counts = gram_counts(docs, buckets).toArrow()
    place = {lang: k for k, lang in enumerate(languages)}
    column = np.array([place[x] for x in counts.column("lang").to_pylist()], "i8")
    bucket, n = counts.column("bucket").to_numpy(), counts.column("n").to_numpy()
    table = np.zeros((buckets, len(languages)))
    letters = np.zeros((len(SCRIPT_NAMES), len(languages)))
    grams = bucket >= 0
    table[bucket[grams], column[grams]] = n[grams]
    letters[-1 - bucket[~grams], column[~grams]] = n[~grams]
    # languages whose texts have no letter can't be told
    known = np.flatnonzero(letters.sum(0) > 0)
    table, letters = table[:, known], letters[:, known]
    totals = table.sum(0)
    logs = (np.log(table + SMOOTHING) - np.log(totals + SMOOTHING * buckets)).astype("f4")
    shares = letters / letters.sum(0)
    return Model([languages[k] for k in known], logs, shares >= WRITTEN_IN, np.log(letters.sum(0) / max(1.0, letters.sum())))


def word_scores(words: list[str], model: Model):
    """(scores (words, languages), 0 for the best and down to -CLIP, or -2 CLIP for a script the language isn't written in; letters of each word)."""
    import numpy as np

    scores, plain = [], []
    step = max(1, (1 << 22) // (16 * len(model.languages)))
    for a in range(0, len(words), step):
        runs, begins, scripts, letters = grams_of(words[a : a + step], len(model.grams))
        total = np.add.reduceat(model.grams[runs], begins) / GRAM
        able = model.written[scripts]
        total = np.where(able, total, -np.inf)
        best = total.max(1, keepdims=True)
        one = np.where(able, np.maximum(total - np.where(np.isfinite(best), best, 0), -CLIP), -2 * CLIP)
        one[~able.any(1) | (letters == 0)] = 0
        scores.append(one)
        plain.append(letters)
    return np.concatenate(scores), np.concatenate(plain)


def best_paths(scores, words, begins, ends, prior):
    """Labels of words (places in scores) of pieces from begins to ends, one after the other in an array for each piece's places.

    All pieces go on together, word by word, the longer ones last.
    """
    import numpy as np

    order = np.argsort(begins - ends, kind="stable")
    begins, sizes = begins[order], (ends - begins)[order]
    value = np.tile(np.asarray(prior, "f4"), (len(begins), 1))
    came, stays, active = [], [], []
    for t in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -t, "left"))
        here = value[:n]
        top = here.argmax(1)
        switched = here[np.arange(n), top][:, None] - SWITCH
        stay = here >= switched
        value[:n] = np.where(stay, here, switched) + scores[words[begins[:n] + t]]
        came.append(top.astype("i2"))
        stays.append(stay)
        active.append(n)
    now, at = value.argmax(1), np.concatenate([[0], np.cumsum(sizes)]).astype("i8")
    found = np.zeros(at[-1], "i2")
    for t in range(len(came) - 1, -1, -1):
        n = active[t]
        found[at[:n] + t] = now[:n]
        kept = stays[t][np.arange(n), now[:n]]
        now[:n] = np.where(kept, now[:n], came[t])
    labels = [None] * len(begins)
    for k, place in enumerate(order):
        labels[place] = found[at[k] : at[k + 1]]
    return labels


def label_words(texts: list[str], model: Model):
    """(first word of each text and the end, label of each word, its letters) for the words of texts, one after the other."""
    import numpy as np
    import pandas as pd

    found = [words_of(t) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(w) for w in found])]).astype("i8")
    if not first[-1]:
        return first, np.zeros(0, "i2"), np.zeros(0, "i8")
    places, names = pd.factorize(np.array([w for own in found for w in own], object))
    scores, letters = word_scores(list(names), model)
    pieces = [(a, b, max(first[k], a - OVERLAP), min(first[k + 1], b + OVERLAP)) for k in range(len(texts)) for a in range(first[k], first[k + 1], PIECE) for b in [min(a + PIECE, first[k + 1])]]
    begin, end, low, high = np.array(pieces, "i8").T
    paths = best_paths(scores.astype("f4"), places, low, high, model.prior)
    labels = np.concatenate([p[a - lo : b - lo] for p, a, b, lo in zip(paths, begin, end, low, strict=True)])
    return first, labels, letters[places]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = sent.value
        size = len(model.languages)
        for b in batches:
            names, shares = [], []
            for _, texts in text_runs(b.column(1), max(100_000, SLICE_BYTES * 8 // max(8, size))):
                if not size:
                    names += [UNKNOWN] * len(texts)
                    shares += [0.0] * len(texts)
                    continue
                first, labels, letters = label_words([t.decode() for t in texts], model)
                of = np.repeat(np.arange(len(texts)), np.diff(first))
                each = np.bincount(of * size + labels, letters, len(texts) * size).reshape(len(texts), size)
                total, best = each.sum(1), each.argmax(1)
                names += [model.languages[k] if n else UNKNOWN for k, n in zip(best, total, strict=True)]
                shares += (each.max(1) / np.maximum(total, 1)).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, start, end (characters of the text), lang: the spans of one language of docs (doc_id, text), first to last letter."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = sent.value
        for b in batches:
            if not model.languages:
                continue
            for at, texts in text_runs(b.column(1), max(100_000, SLICE_BYTES * 8 // max(8, len(model.languages)))):
                texts = [t.decode() for t in texts]
                first, labels, _ = label_words(texts, model)
                owner, starts, ends, langs = [], [], [], []
                for k, text in enumerate(texts):
                    own = labels[first[k] : first[k + 1]]
                    places = [(a, min(a + LONGEST, m.end())) for m in _WORD.finditer(text) for a in range(m.start(), m.end(), LONGEST)]
                    cuts = np.flatnonzero(np.diff(own)) + 1
                    for lo, hi in zip([0, *cuts], [*cuts, len(own)], strict=True):
                        if hi > lo:
                            owner.append(at + k)
                            starts.append(places[lo][0])
                            ends.append(places[hi - 1][1])
                            langs.append(model.languages[own[lo]])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(langs, pa.string())], ["doc_id", "start", "end", "lang"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, start long, end long, lang string")


#: Documents with this remainder of their id's checksum are held out.
FOLDS, HELD_OUT = 4, 2


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % FOLDS == HELD_OUT


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of docs (doc_id, text, lang), learned from those that aren't held out."""
    model = fit(docs.where(~held_out()).select("text", "lang"))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
