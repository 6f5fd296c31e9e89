"""Quality rules, lines first: every line is judged by punctuation, navigation and boilerplate
rules, failing lines are removed, and a document that loses too much of its text is rejected.

Line rules (a line without words is never judged and stays):
* navigation: at least 3 separator words, or separators are a quarter of the line's words;
* boilerplate: a phrase of BOILERPLATE between word borders, in any case of A-Z, on a line of up to 15
  words, or phrases that are a quarter of a longer line's words;
* symbols: more marks of `#*$%&|<>` than half its words;
* shouting: 6 words or more, four fifths of the letters in capitals;
* punctuation: under 4 words without a closing mark, unless it is the only line;
* repeated: 10 words or more and equal to an earlier line of the text.

Defined cases: a null, empty or wordless text fails the base rule (n_words < 50); texts are judged
whole; repeated rows one by one; other columns pass through `clean` untouched.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import WORD_RE, released

SYMBOLS = re.compile(r"[#*$%&|<>]")
SEPARATORS = frozenset(("|", ">", "»", "·", "•", "/", "-", "::"))
CLOSING = tuple(".!?…:;\"'”’)]»")
#: Phrases of notices and page furniture, in the languages at hand.
BOILERPLATE = (
    "all rights reserved", "this work is licensed under", "licensed under the", "terms of use", "terms of service", "privacy policy", "cookie policy", "we use cookies", "enable javascript", "click here", "sign in", "log in", "subscribe to our", "back to top", "lorem ipsum",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "wir verwenden cookies", "hier klicken", "nach oben",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "nous utilisons des cookies", "cliquez ici", "haut de page",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "utilizamos cookies", "haga clic aquí", "volver arriba",
)
BOILER_RE = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, BOILERPLATE)) + r")(?!\w)")
SHORT = 15
#: Letters that are counted, as Latin-1: capitals, and small ones.
UPPER, LOWER = (re.sub(rb"[^%b]" % x.encode("latin-1"), b"", bytes(range(256))) for x in ("A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"))


def shouts(line: str) -> bool:
    """Four fifths of all its letters are capitals."""
    b = line.encode("latin-1", "replace")
    upper = len(b) - len(b.translate(None, UPPER))
    return upper > 0 and upper >= 4 * (len(b) - len(b.translate(None, LOWER)))


def line_fails(line: str, words: list[str], alone: bool, again: bool, phrased: bool = True) -> bool:
    """`phrased`: the text holds a phrase somewhere; where it doesn't, no line is searched for one."""
    n = len(words)
    if not SEPARATORS.isdisjoint(words):
        bars = sum(w in SEPARATORS for w in words)
        if bars >= 3 or 4 * bars >= n:
            return True
    if 2 * len(SYMBOLS.findall(line)) > n:
        return True
    if again and n >= 10:
        return True
    if n < 4 and not alone and not words[-1].endswith(CLOSING):
        return True
    if n >= 6 and shouts(line):
        return True
    phrases = BOILER_RE.findall(line.lower()) if phrased else ()
    return bool(phrases) and (n <= SHORT or 4 * sum(p.count(" ") + 1 for p in phrases) >= n)


def repeated_words(words: list[str], size: int = 3) -> int:
    """Words that lie in a window of `size` words found twice or more."""
    if len(words) <= size:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    m = len(number)
    if m == len(words):
        return 0
    code = ids[: 1 - size]
    for k in range(1, size):
        if k == 2 and m > 2_000_000:  # three such numbers overflow 64 bits: number the pairs first
            code = np.unique(code, return_inverse=True)[1]
        code = code * m + ids[k : len(ids) - size + 1 + k]
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(code, twice)
    held = np.zeros(len(ids), bool)
    for k in range(size):
        held[k : k + len(hit)] |= hit
    return int(held.sum())


def judge(text: str, most_lost: float = 0.5) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lines, removed, kept_words, cleaned)."""
    out, seen, words_all = [], set(), []
    dup = lines = removed = kept_words = 0
    split, low = text.split("\n"), text.lower()
    phrased = any(p in low for p in BOILERPLATE)
    for line in split:
        words = WORD_RE.findall(line)
        if not words:
            out.append(line)
            continue
        lines += 1
        again = line in seen
        dup += again
        seen.add(line)
        words_all += words
        if line_fails(line, words, len(split) == 1, again, phrased):
            removed += 1
        else:
            kept_words += len(words)
            out.append(line)
    n = len(words_all)
    repeats = repeated_words(words_all)
    failed = n < 50 or 100 * repeats > 50 * n
    kept = not failed and n - kept_words <= most_lost * n
    return n, sum(map(len, words_all)), len(SYMBOLS.findall(text)), dup, repeats, failed, kept, lines, removed, kept_words, "\n".join(out)


_COLUMNS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("n_lines", T.LongType()), ("n_removed_lines", T.LongType()), ("kept_words", T.LongType())]
_ARROW = {T.LongType(): pa.int64(), T.BooleanType(): pa.bool_()}


def metrics(docs: DataFrame, most_lost: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the figures and verdict of every document."""

    def run(batches):
        for b in batches:
            rows = [judge(t.as_py() or "", most_lost)[:-1] for t in b.column(1)]
            columns = [pa.array([r[i] for r in rows], _ARROW[kind]) for i, (_, kind) in enumerate(_COLUMNS)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[id_col, *(n for n, _ in _COLUMNS)])

    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, k) for n, k in _COLUMNS)])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def clean(docs: DataFrame, most_lost: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that are kept, without their failing lines; same columns."""
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            rows = [judge(t.as_py() or "", most_lost) for t in b.column(at)]
            columns = list(b.columns)
            columns[at] = pa.array([r[-1] for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(b.schema, columns)])).filter(pa.array([r[6] for r in rows], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
