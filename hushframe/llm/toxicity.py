"""Operator 9: toxicity by Levenshtein automata intersected with a lexicon trie, and context-window scores.

The lexicon (words and stems with their log-odds) is learned from at most ``SAMPLE`` labelled rows, which bounds it: a term
must be far more common in rows labelled toxic; every term that passes is in.  A word matches a term exactly, by a stem, after undoing look-alike digits, or within one
edit (two from ten letters on; swapped neighbours count as one; terms of one or two letters only exactly): the word's Levenshtein automaton walks the
trie, one row of edit counts a node, and leaves a branch as soon as no count is within the limit.  A fuzzy match
that rows without the label also use is a word of its own and is not taken.

Each match is scored in its window of words: weight of the term, less inside quotation marks or beside words
of reported speech, more where someone is addressed.  Boosted trees over these scores, fitted on labelled rows
that the lexicon was not learned from, give the probability.  Labels, language, source and doc_id are never inputs.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.kit import fold, map_batches, table, tables
from hushframe.llm.trees import Nodes, boost

#: At most so many labelled rows (those of least hashed doc_id) are used for the fit.
SAMPLE, FOLDS, WINDOW, STEMS = 20_000, 5, 6, (5, 6, 7, 8)
#: Words of reported speech, and words that address someone.
REPORTED = frozenset("said says quoted quote wrote writes called term word phrase reported according heißt sagte zitat dit mot cita dijo palabra".split())
ADDRESSED = frozenset("you your you're u ur youre are yourself du dich dein ihr euch tu te toi vous ton usted tú eres".split())
_LOOKALIKE = str.maketrans("0134578@$!", "oieastbasi")
_word = re.compile(r"[\w'@$!]+")
FEATURES = ("best", "direct", "terms", "density", "fuzzy", "quoted", "addressed", "window", "log_words")


class Matcher:
    """A lexicon as a trie, with exact, stem and fuzzy lookup of lower-cased words."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], known: frozenset[str] = frozenset()) -> None:
        self.words, self.stems, self.known = words, stems, known
        self.tries: dict[int, dict] = {1: {}, 2: {}}
        self.shorter: dict[int, set[str]] = {1: set(), 2: set()}
        for w in words:
            if (n := len(w)) < 3:
                continue
            limit = 1 if n < 10 else 2
            node = self.tries[limit]
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
            self.shorter[limit] |= _shorter(w, limit)
        self.long = sorted({(len(w), _letters(w)) for w in words if len(w) >= 10})
        self.most = max(map(len, words), default=0) + 2
        self.clean: set[str] = set()
        self.hits: dict[str, tuple[str, float, bool]] = {}

    def of(self, words: set[str]) -> dict[str, tuple[str, float, bool]]:
        """The matches among some words; what has been looked up before is not looked up again."""
        out = {}
        for w in words - self.clean:
            if (hit := self.hits.get(w) or self._find(w)) is None:
                if len(self.clean) > 400_000:
                    self.clean.clear()
                self.clean.add(w)
            else:
                out[w] = self.hits[w] = hit
        return out

    def find(self, word: str) -> tuple[str, float, bool] | None:
        """(term, weight, fuzzy) of a lower-cased word, or None."""
        return self.of({word}).get(word)

    def _find(self, word: str) -> tuple[str, float, bool] | None:
        word = word.strip("_'@$!")
        if word in self.words:
            return word, self.words[word], False
        for n in STEMS:
            if (s := word[:n]) in self.stems and len(word) >= n:
                return s, self.stems[s], False
        if word in self.known or not 2 <= len(word) <= self.most:
            return None
        plain = word.translate(_LOOKALIKE)
        if plain != word and plain in self.words:
            return plain, self.words[plain], True
        for w in dict.fromkeys((word, plain)):
            if self.may_be_near(w) and (t := self.fuzzy(w)):
                return t, self.words[t], True
        return None

    def may_be_near(self, word: str) -> bool:
        """Whether word and term meet after deleting as many letters from each as the limit allows: all near words do."""
        one, two = self.shorter[1], self.shorter[2]
        cut = {word, *[word[:i] + word[i + 1 :] for i in range(len(word))]}
        if not one.isdisjoint(cut):
            return True
        return self._may_be_long(word) and not two.isdisjoint({v for w in cut for v in _shorter(w, 1)})

    def _may_be_long(self, word: str) -> bool:
        """Whether a term of ten letters or more has a length within two, and lacks at most two of the word's letters, and the word
        two of its: an edit brings in or takes away one letter at most, a swap none."""
        n = len(word)
        if n < 8 or not self.long:
            return False
        own = _letters(word)
        return any(-2 <= size - n <= 2 and (own & ~of).bit_count() <= 2 and (of & ~own).bit_count() <= 2 for size, of in self.long)

    def fuzzy(self, word: str) -> str | None:
        """The nearest term within its limit: rows of edit counts down the trie, dead branches left."""
        n, best = len(word), (3, "")
        stack = [(trie, limit, list(range(n + 1)), None, "") for limit, trie in self.tries.items()]
        while stack:
            node, limit, row, above, last = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[n] <= limit and (row[n], child) < best:
                        best = (row[n], child)
                    continue
                new = [row[0] + 1]
                for j in range(1, n + 1):
                    v = min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (word[j - 1] != c))
                    if above is not None and j > 1 and word[j - 1] == last and word[j - 2] == c:
                        v = min(v, above[j - 2] + 1)
                    new.append(v)
                if min(new) <= limit:
                    stack.append((child, limit, new, row, c))
        return best[1] or None


def _letters(word: str) -> int:
    """The word's letters as bits, a bit for each remainder of 61; different letters may share one, which rules nothing out."""
    bits = 0
    for c in word:
        bits |= 1 << ord(c) % 61
    return bits


def _shorter(word: str, limit: int) -> set[str]:
    """The word and what is left of it after deleting up to ``limit`` letters."""
    out = {word}
    for _ in range(limit):
        out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
    return out


def context(text: str, matcher: Matcher) -> list[float] | None:
    """The feature vector of a text; None if no term occurs in it."""
    low = text.lower()
    found = matcher.of({*_word.findall(low)})
    if not found:
        return None
    spans = [(m.start(), m.end(), m[0]) for m in _word.finditer(low)]
    words = [w for _, _, w in spans]
    inside = _quoted(low, [s for s, _, _ in spans])
    best = direct = fuzzy = quoted = addressed = window = 0.0
    terms, at = set(), []
    for i, w in enumerate(words):
        if (hit := found.get(w)) is None:
            continue
        term, weight, near = hit
        around = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
        told = inside[i] or any(x in REPORTED for x in around)
        to = any(x in ADDRESSED for x in around)
        own = weight * (0.85 if near else 1.0) * (0.4 if told else 1.0) + (0.5 if to and not told else 0.0)
        best, direct = max(best, own), direct + own
        fuzzy, quoted, addressed = fuzzy + near, quoted + told, addressed + (to and not told)
        terms.add(term)
        at.append((i, own))
    j = total = 0
    for k, (i, own) in enumerate(at):  # most in any stretch of 60 words
        total += own
        while at[j][0] < i - 60:
            total -= at[j][1]
            j += 1
        window = max(window, total)
    n = len(words)
    return [best, float(np.log1p(direct)), float(len(terms)), 100 * direct / max(n, 20), fuzzy, quoted, addressed, window, float(np.log1p(n))]


def _quoted(text: str, starts: list[int]) -> list[bool]:
    """Whether each position stands between quotation marks that a line opens and closes."""
    marks = [(m.start(), m[0]) for m in re.finditer(r'["“”„«»\n]', text)]
    spans, open_at = [], None
    for p, c in marks:
        if c == "\n":
            open_at = None
        elif open_at is None:
            open_at = p
        else:
            spans.append((open_at, p))
            open_at = None
    out, k = [], 0
    for s in starts:
        while k < len(spans) and spans[k][1] < s:
            k += 1
        out.append(k < len(spans) and spans[k][0] < s)
    return out


def _sample(labels: DataFrame, sample: int) -> DataFrame:
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    ids = ids.where(fold(F.col("doc_id"), FOLDS) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Matcher, Nodes | None]:
    """Lexicon from three fifths of the sampled rows, trees from the others; without labels an empty lexicon."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(_sample(labels, sample)), "doc_id")
    rows = table(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5))), "sample")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        pos, neg = Counter(), Counter()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = {w.strip("_'@$!") for w in _word.findall((text or "").lower())}
            (pos if toxic else neg).update([*words, *{w[:n] + "*" for w in words for n in STEMS if len(w) > n}])
        keys = [*pos.keys() | neg.keys()]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], names=["term", "pos", "neg"]) if keys else None

    half = rows.where("part < 3")
    terms = table(map_batches(half, count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "terms")
    totals = half.agg(F.sum((F.col("toxic") == 1).cast("int")).alias("p"), F.sum((F.col("toxic") != 1).cast("int")).alias("n")).first()
    p, n = (totals["p"] or 0) + 1.0, (totals["n"] or 0) + 1.0
    odds = F.log((F.col("pos") + 0.5) / F.lit(p)) - F.log((F.col("neg") + 0.5) / F.lit(n))
    # seen in enough toxic rows, by far more than chance
    picked = terms.withColumn("odds", odds).where((F.col("pos") >= 4) & (F.col("odds") >= 2.5) & (F.col("odds") * F.sqrt("pos") >= 9))
    best = picked.orderBy(F.desc(F.col("odds") * F.sqrt("pos")), "term").collect()  # bounded by the sampled rows
    stems = {r["term"][:-1]: min(r["odds"], 6.0) for r in best if r["term"].endswith("*")}
    stems = {s: w for s, w in stems.items() if not any(s[:k] in stems for k in STEMS if k < len(s))}
    words = {r["term"]: min(r["odds"], 6.0) for r in best if not r["term"].endswith("*")}
    stems = {s: w for s, w in stems.items() if sum(x.startswith(s) for x in words) >= 3}
    draft = Matcher(words, {}, frozenset())

    def variants(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = [bool((hit := draft.find(t)) and hit[2]) for t in batch.column("term").to_pylist()]
        return batch.select(["term"]).filter(pa.array(keep, pa.bool_()))

    # bounded by the lexicon: only words within its edit limits
    known = map_batches(terms.where("neg > 0 and term not like '%*'").select("term"), variants, "term string", rows=8192).toPandas()
    matcher = Matcher(words, stems, frozenset(known["term"]))

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [context(t or "", matcher) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    got = map_batches(rows.where("part >= 3").select("doc_id", "toxic", "text"), features, "doc_id long, toxic int, x array<double>").toPandas().sort_values("doc_id")
    if not len(got):
        return matcher, None
    x = np.array([[0.0] * len(FEATURES) if v is None else v for v in got["x"]])
    up = {FEATURES.index(k): 1 for k in ("best", "direct", "terms", "density", "addressed", "window")} | {FEATURES.index("quoted"): -1}
    return matcher, boost(x, got["toxic"].to_numpy(float), up, trees=30, depth=3)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, score, predicted, n_terms, n_fuzzy, n_quoted)`` for each row of ``docs``.

    Null and empty texts get the score of a text without terms; without labels every score is 0; null doc_ids and repeated
    rows are scored like any other; an empty table gives an empty table; whole texts are read; other columns are ignored.
    """
    with tables():
        matcher, model = learn(docs, labels, sample)
    none = [0.0] * len(FEATURES)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not batch.num_rows:
            return None
        x = np.array([context(t or "", matcher) or none for t in batch.column("text").to_pylist()])
        p = 1 / (1 + np.exp(-model.score(x))) if model else np.zeros(len(x))
        cols = [pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *(pa.array(x[:, FEATURES.index(k)].astype(np.int64)) for k in ("terms", "fuzzy", "quoted"))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "score", "predicted", "n_terms", "n_fuzzy", "n_quoted"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, score double, predicted int, n_terms long, n_fuzzy long, n_quoted long")
