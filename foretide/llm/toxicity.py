"""Toxicity by a lexicon trie intersected with Levenshtein automata, and context windows.

The lexicon comes from labelled rows: words and word beginnings (stems) whose log-odds of toxic
against other texts are high, besides a few fixed seeds.  A word matches an entry exactly, by a
stem, or within one edit (entries of five letters or more; a stem's last letter must agree, as any
other word of the same beginning would match too).  Each match weighs its entry's log-odds,
less if its window looks like quotation, more if it addresses someone.  A logistic model over the
strongest match, their sum, density and inexactness turns matches into a score in (0, 1).

Models are fitted on a bounded sample of labelled rows (`sample` rows, half of each label where
there are enough, by hash of the id); every document is scored whole.

Defined cases: null or empty texts have no matches and get the model's score for none; without
labelled rows of both labels the seeds and fixed coefficients are used; labels that repeat count
once, toxic if any is; a text that repeats is learned from once, toxic if any of its rows is; repeated documents are scored row by row; an empty table gives no rows.
"""
from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import crc_mod, released, table, text_of, worker_cache

#: Insults of the languages at hand, which need no label to be known.
SEEDS = ("idiot", "stupid", "moron", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "dumbass", "bastard", "dummkopf", "arschloch", "connard", "imbécile", "estúpido", "idiota", "pendejo")
#: Words that report speech, and words that address someone.
REPORTING = frozenset("said says quote quoted quotes called word words term wrote dit disait mot citation sagte sagt wort zitat dijo dice palabra cita".split())
ADDRESSING = frozenset("you your you're u tu vous ton votre du dein deine ihr euch eres usted tú vos".split())
QUOTES = frozenset("\"“”«»„‘’'`")
LEET = str.maketrans("013457@$", "oieastas")
EDGES = re.compile(r"^[^\w@$]+|[^\w@$]+$")
LETTERS = re.compile(r"[^\W\d_]")
STEMS = range(4, 8)
SPAN = 4
CACHE = 250_000


def normal(word: str) -> str:
    w = EDGES.sub("", word.lower())
    return w.translate(LEET) if w and not w.isalpha() and LETTERS.search(w) else w


def automaton(word: str) -> dict[str, int]:
    """The word's Levenshtein automaton for one edit: of each letter, the places where it stands.

    A state is two sets of places as bits, reached without an edit and with one; see `step`."""
    places: dict[str, int] = {}
    for i, c in enumerate(word):
        places[c] = places.get(c, 0) | 1 << i
    return places


def step(places: dict[str, int], exact: int, edited: int, c: str) -> tuple[int, int, int]:
    """(exact, edited, places that c itself led to) after the letter c of an entry: it stands in the
    word, replaces a letter of the word, is not in the word, or follows a letter that the entry lacks."""
    at = places.get(c, 0)
    new = (exact & at) << 1
    same = (edited & at) << 1
    return new, same | exact << 1 | exact | new << 1, new | same | new << 1 & at << 1


def without_a_letter(entries) -> set[str]:
    """The entries and their forms without a letter.  Two words within one edit agree, or a form of one
    without a letter is among these of the other: what can't match never reaches the automaton."""
    return {f for e in entries for f in (e, *(e[:i] + e[i + 1 :] for i in range(len(e))))}


def near_any(w: str, forms: set[str]) -> bool:
    return w in forms or any(w[:i] + w[i + 1 :] in forms for i in range(len(w)))


def halves(entries) -> tuple[set[str], set[str]]:
    """First and second halves of entries.  One edit falls into one of them, so the other stands unchanged
    at the same end of a word that matches."""
    return {e[: len(e) // 2] for e in entries}, {e[len(e) // 2 :] for e in entries}


def shares_half(w: str, first: set[str], second: set[str]) -> bool:
    """Whether w starts or ends with a half of an entry that is up to one letter shorter or longer."""
    h = len(w) // 2
    k = len(w) - h
    return w[:h] in first or w[-k:] in second or (w[: h - 1] in first or w[-k - 1 :] in second if h == k else w[: h + 1] in first or w[1 - k :] in second)


class Lexicon:
    """entries: {text: (weight, is_stem)}; a stem may end in a star, which tells it from a word of its spelling."""

    def __init__(self, entries: dict[str, tuple[float, bool]]):
        self.seen: dict = {}
        self.words = {e: w for e, (w, stem) in entries.items() if not stem}
        self.stems = {e.removesuffix("*"): w for e, (w, stem) in entries.items() if stem}
        self.stem_sizes = sorted({len(e) for e in self.stems})
        #: Tries of the words of each length: within one edit lengths differ by one at most.
        self.tries = {n: self.grown(e for e in self.words if len(e) == n) for n in {len(e) for e in self.words} if n >= 5}
        self.stem_trie = self.grown(e for e in self.stems if len(e) >= 5)
        self.longest_stem = max(self.stem_sizes, default=0)
        self.forms_of = {n: without_a_letter(e for e in self.words if len(e) == n) for n in self.tries}
        self.forms = set().union(*self.forms_of.values())
        self.stem_forms = without_a_letter(e for e in self.stems if len(e) >= 5)
        self.first, self.second = halves([e for e in self.words if len(e) >= 5])
        #: An edit of a stem leaves its first three letters, or its first two and the fourth and fifth, or the
        #: third to fifth as they are; what follows the edit may stand one place off.
        stems = [e for e in self.stems if len(e) >= 5]
        self.stem_heads, self.stem_middles = {e[:3] for e in stems}, {e[2:5] for e in stems}
        self.stem_pairs, self.stem_starts = {e[:2] + e[3:5] for e in stems}, {e[:2] for e in stems}
        sizes = [k for k in self.stem_sizes if k >= 5]
        self.beginnings = range(sizes[0] - 1, sizes[-1] + 2) if sizes else range(0)
        self.longest = max(max(self.tries, default=0), self.longest_stem) + 1

    @staticmethod
    def grown(entries) -> dict:
        trie: dict = {}
        for e in entries:
            node = trie
            for c in e:
                node = node.setdefault(c, {})
            node[""] = e
        return trie

    @staticmethod
    def _walk(trie: dict, places: dict[str, int], n: int):
        """(entry, state, places of the last step) wherever trie and automaton both go on.  Where an edit
        is spent only letters of the word at hand lead on, so only those are tried."""
        stack, full = [(trie, 1, 2, 0)], (1 << n + 1) - 1
        while stack:
            node, exact, edited, _ = stack.pop()
            if "" in node:
                yield node[""], exact, edited, _
            if exact:
                children = [c for c in node if c]
            else:
                children = [c for c in places if c in node and places[c] & edited] if len(places) < len(node) else [c for c in node if places.get(c, 0) & edited]
            for c in children:
                x, y, last = step(places, exact, edited, c)
                x, y = x & full, y & full
                if x or y:
                    stack.append((node[c], x, y, last))

    def near(self, word: str) -> str | None:
        """The best entry within one edit of the word."""
        n, best, places = len(word), None, automaton(word)
        for size in (n - 1, n, n + 1):
            if size not in self.tries or not near_any(word, self.forms_of[size]):
                continue
            for e, exact, edited, _ in self._walk(self.tries[size], places, n):
                if (exact | edited) >> n & 1 and (best is None or (self.words[e], e) > (self.words[best], best)):
                    best = e
        return best

    def near_stem(self, word: str) -> str | None:
        """The best stem within one edit of a beginning of the word that ends in the stem's last letter."""
        word, best = word[: self.longest_stem + 1], None
        for e, _, _, last in self._walk(self.stem_trie, automaton(word), len(word)):
            if last and (best is None or (self.stems[e], e) > (self.stems[best], best)):
                best = e
        return best

    def may_begin(self, w: str) -> bool:
        middles, pairs = self.stem_middles, self.stem_pairs
        if w[:3] in self.stem_heads or w[2:5] in middles or w[1:4] in middles or w[3:6] in middles:
            return True
        head = w[:2]
        return head in self.stem_starts and (w[:4] in pairs or head + w[3:5] in pairs or head + w[4:6] in pairs)

    def match(self, raw: str) -> tuple[str, float, int] | None:
        """(entry, weight, edits) of a word."""
        if raw in self.seen:
            return self.seen[raw]
        if len(self.seen) >= CACHE:
            self.seen.clear()
        w, found = normal(raw), None
        if w in self.words:
            found = (w, self.words[w], 0)
        else:
            for k in self.stem_sizes:
                if w[:k] in self.stems and len(w) >= k:
                    found = (w[:k], self.stems[w[:k]], 0)
            if found is None and 4 <= len(w) <= self.longest and shares_half(w, self.first, self.second) and near_any(w, self.forms):  # longer words are more than one edit away
                e = self.near(w)
                found = e and (e, self.words[e], 1)
            if found is None and self.may_begin(w) and any(near_any(w[:k], self.stem_forms) for k in self.beginnings if k <= len(w)):
                e = self.near_stem(w)
                found = e and (e, self.stems[e], 1)
        self.seen[raw] = found
        return found

    def hits(self, text: str) -> tuple[list[tuple[str, float, int, float]], int]:
        """((entry, weight, edits, context factor) of every match, number of words)."""
        words = text.split()
        match, out = self.match, []
        for i, m in enumerate(map(match, words)):
            if m:
                out.append((*m, context(words, i)))
        return out, len(words)


def context(words: list[str], i: int) -> float:
    """Below 1 where the window around word i looks like quotation, above 1 where it addresses."""
    before, after = words[max(0, i - SPAN) : i], words[i + 1 : i + 1 + SPAN]
    opens = words[i][0] in QUOTES or any(w[0] in QUOTES for w in before)
    closes = words[i].rstrip(".,;:!?")[-1:] in QUOTES or any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in after)
    factor = 0.4 if opens and closes else 1.0
    plain = [w.lower().strip(".,;:!?\"'") for w in (*before, *after)]
    if any(w in REPORTING for w in plain):
        factor *= 0.7
    return factor * (1.2 if any(w in ADDRESSING for w in plain) else 1.0)


def strongest(hits: list[tuple]) -> dict[str, float]:
    """The highest weight of every spelling: a word and its stem are one."""
    out: dict[str, float] = {}
    for e, w, _, _ in hits:
        out[e] = max(w, out.get(e, w))
    return out


def features(hits: list[tuple], n: int) -> list[float]:
    exact = [w * c for _, w, e, c in hits if not e]
    edited = [w * c for _, w, e, c in hits if e]
    return [1.0, max(exact, default=0.0), math.log1p(sum(exact)), max(edited, default=0.0), math.log1p(100 * sum(exact) / max(n, 1)), min(len(exact), 10) / 3]


#: Coefficients without labels: an exact match decides, an edited one hardly.
PRIOR = [-3.0, 1.0, 0.5, 0.2, 0.1, 0.0]


def fit(rows: list[list[float]], labels: list[int]) -> list[float]:
    """Ridge logistic regression by Newton steps."""
    x, y = np.array(rows), np.array(labels, float)
    b, keep = np.zeros(x.shape[1]), np.full(x.shape[1], 0.05)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b.tolist()


def _count(batches):
    """(feature, toxic texts, other texts): words, and their beginnings marked by a star."""
    held: dict[str, list[int]] = {}

    def packed():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], names=["feature", "pos", "neg"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1)):
            words = {normal(w) for w in text.as_py().split()} - {""}
            for f in words | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}:
                held.setdefault(f, [0, 0])[1 - toxic.as_py()] += 1
            if len(held) > 150_000:
                yield packed()
                held.clear()
    if held:
        yield packed()


def learn_lexicon(sample: DataFrame) -> dict[str, tuple[float, bool]]:
    """sample(text, toxic) -> entries: the seeds and all words and stems over the bounds on odds and
    support.  Support is a share of the sample's toxic texts, so their number follows from the bounded
    sample, whatever the corpus."""
    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    entries = {s: (4.0, False) for s in SEEDS}
    if not pos or not neg:
        return entries
    odds = F.log((F.col("pos") + 0.3) / (pos + 0.6)) - F.log((F.col("neg") + 0.3) / (neg + 0.6))
    counts = sample.select("text", "toxic").mapInArrow(released(_count), "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    good = counts.filter(F.col("pos") >= max(3, round(0.004 * pos))).withColumn("odds", odds).withColumn("sure", F.col("odds") / F.sqrt(1 / (F.col("pos") + 0.3) + 1 / (F.col("neg") + 0.3))).filter("odds > 1.6 and (odds > 2.5 or sure > 4)").select("feature", "pos", "odds").collect()
    of = {r.feature: (r.pos, r.odds) for r in good}
    words = {f for f in of if not f.endswith("*")}
    stems = {}
    for f in (f for f in of if f.endswith("*")):
        p, o = of[f]
        longest = max((of[w][0] for w in words if w.startswith(f[:-1])), default=0)
        inner = max((of[g][0] for g in of if g.endswith("*") and len(g) > len(f) and g.startswith(f[:-1])), default=0)
        if p > 1.25 * longest and p > inner:  # more than its words and longer stems each
            stems[f[:-1]] = o
    return entries | {w: (of[w][1], False) for w in words} | {s + "*": (o, True) for s, o in stems.items()}


def lexicon(entries: dict) -> Lexicon:
    kept, key = worker_cache(), ("lexicon", hash(frozenset(entries.items())))
    if key not in kept:
        kept[key] = Lexicon(entries)
    return kept[key]


def learn(docs: DataFrame, labels: DataFrame, sample: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", hold: int = 4, held: int = 2) -> tuple[dict, list[float]]:
    """(lexicon entries, coefficients), from rows outside the held-out fold only."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_mod(F.col(id_col), hold) != held)).groupBy(id_col).agg(F.max(F.col(label_col)).cast("int").alias("toxic"))
    half = [known.filter(F.col("toxic") == t).orderBy(F.xxhash64(F.lit(13), id_col), id_col).limit(sample // 2) for t in (0, 1)]
    chosen = F.broadcast(half[0].unionByName(half[1]))  # at most `sample` rows
    rows = docs.select(id_col, F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).join(chosen, id_col).select("text", "toxic")
    rows = table(rows.groupBy("text").agg(F.max("toxic").alias("toxic")).repartition(24), "toxic-sample")
    entries = learn_lexicon(rows)

    def run(batches):
        own = lexicon(entries)
        for b in batches:
            f = [features(*own.hits(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), b.column(1)], names=["f", "toxic"])

    got = rows.mapInArrow(released(run), "f array<double>, toxic int").collect()  # bounded by `sample`
    if len({r.toxic for r in got}) < 2:
        return entries, PRIOR
    return entries, fit([list(r.f) for r in got], [r.toxic for r in got])


def score(docs: DataFrame, entries: dict, coefficients: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, hits (distinct entries matched, strongest first)."""

    def run(batches):
        own = lexicon(entries)
        for b in batches:
            out, named = [], []
            for t in b.column(1):
                hits, n = own.hits(t.as_py() or "")
                z = sum(x * y for x, y in zip(features(hits, n), coefficients))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
                named.append([e for e, _ in sorted(strongest(hits).items(), key=lambda x: (-x[1], x[0]))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64()), pa.array(named, pa.list_(pa.string()))], names=[id_col, "score", "hits"])

    return docs.select(id_col, text_of(F.col(text_col)).alias("text")).mapInArrow(released(run), T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("hits", T.ArrayType(T.StringType()))]))
