"""Personal data by weak supervision, in DataFrame operations only.

Base spans come from four patterns with checks and always stay.  Wider candidates (numbers without a
prefix, assignments of secrets, account numbers, mail-like words) are voted on by regex, gazetteer and
context labelers (+1 personal, -1 not, 0 no vote).  Expectation-maximisation over the counts of vote
patterns (at most 3^labelers rows, whatever the input) estimates each labeler's reliabilities; its
posteriors are the soft labels from which a naive-Bayes span classifier over form, length and context
is trained.  Candidates that it accepts and that touch no base span are added.

Offsets are code points, ends exclusive.  Patterns are written without nested retries, so their
time is linear in the text.  Where the pattern `X+@...` could start inside a run of X, only the
run's start or the end of the last match can begin a match; the others have failed before.

Defined cases: a null or empty text has no spans; texts are searched whole; repeated rows are judged
row by row; an empty table gives no rows; other columns pass through `redact` untouched.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import table, text_of

KINDS = ("email", "ip", "card", "phone")
#: Columns of our own beside a table's.
BASE_COL, WIDE_COL, SPANS_COL = "_foretide_base", "_foretide_wide", "_foretide_spans"
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?i:password|passwd|pwd|token|secret|api[_-]?key)[\x20\x09]{0,3}[=:][\x20\x09]{0,3}[\"']?[A-Za-z0-9_+/-]{6,}+"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?![A-Za-z0-9])"
NUMBER = r"(?<![A-Za-z0-9.+(-])[0-9(][0-9().\x20-]{5,40}[0-9](?![A-Za-z0-9])"
MAILISH = r"(?<![A-Za-z0-9@])[A-Za-z0-9]{2,32}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{2,32}+"
CANDIDATE = f"{SECRET}|{ACCOUNT}|{NUMBER}|{MAILISH}"
#: Country codes that begin an international bank account number, and its length there.
ACCOUNTS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
#: Names of secrets, and numbers that stand in for real ones.
SECRETS = ("password", "passwd", "passwort", "kennwort", "mot de passe", "contraseña", "clave", "secret", "api", "token")
DUMMIES = ("0000000", "1111111", "1234567", "7654321", "9999999", "123-45-6789", "555-0100", "example", "changeme")
#: Words that come before personal data, and words that come before other numbers.
CUES = r"(?i)\b(?:call|phone|tel|telephone|mobile|fax|contact|mail|email|e-mail|card|visa|iban|account|ssn|ip|login|teléfono|correo|tarjeta|téléphone|courriel|carte|telefon|karte|konto)\b"
OTHER = r"(?i)(?:\bversion|\bv|\bpage|\bp\.|\bfig\.?|\bfigure|\bchapter|\bisbn|\border|\bno\.|\bnr\.|§|#|\$|€|£)\s*$"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    turned = F.reverse(_digits(m))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(turned), F.lit(1))), lambda i: F.struct(i.alias("i"), (F.ascii(F.substring(turned, i, F.lit(1))) - 48).alias("d")))
    total = F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x.i % 2 == 1, x.d).when(x.d > 4, 2 * x.d - 9).otherwise(2 * x.d))
    return total % 10 == 0


#: kind -> (pattern, check of a match)
BASE = {
    "email": (EMAIL, lambda m: F.lit(True)),
    "ip": (IP, lambda m: F.forall(F.split(m, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(256)) <= 255)),
    "card": (CARD, lambda m: F.when(F.length(_digits(m)).between(16, 19), luhn(m)).otherwise(False)),
    "phone": (PHONE, lambda m: F.length(_digits(m)).between(8, 15)),
}


#: Matches whose offsets are added up together.  Lists grow by copies, so a list of n matches costs
#: n * CHUNK copies within chunks and (n / CHUNK) ** 2 between them, not n ** 2.
CHUNK = 128
_MATCH = "struct<m:string,start:int,end:int,left:string,right:string>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<m, start, end, left, right>> of the leftmost non-overlapping matches: `split` gives
    the text between them, whose lengths add up to offsets.  left, right: up to 40 and 16 characters
    around a match, as far as the next match."""
    none = F.array().cast(f"array<{_MATCH}>")
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))

    def step(acc, x):
        begin = acc.at + F.length(x.left)
        end = begin + F.length(x.m)
        one = F.struct(x.m.alias("m"), begin.alias("start"), end.alias("end"), F.right(x.left, F.lit(40)).alias("left"), F.left(x.right, F.lit(16)).alias("right"))
        return F.struct(end.alias("at"), F.concat(acc.out, F.array(one)).alias("out"))

    def chunk(x, k):
        """The matches of chunk k with offsets from its own beginning, and its length."""
        m, gap = F.slice(x.m, k * CHUNK + 1, F.lit(CHUNK)), F.slice(x.gap, k * CHUNK + 1, F.lit(CHUNK + 1))
        rows = F.transform(m, lambda v, i: F.struct(v.alias("m"), F.get(gap, i).alias("left"), F.get(gap, i + 1).alias("right")))
        return F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def whole(x):
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x.m) - 1) / CHUNK).cast("int")), lambda k: chunk(x, k))
        moved = lambda acc, c: F.struct((acc.at + c.at).alias("at"), F.concat(acc.out, F.array(F.struct(acc.at.alias("by"), c.out.alias("out")))).alias("out"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<by:int,out:array<{_MATCH}>>>").alias("out"))
        placed = F.aggregate(chunks, start, moved, lambda acc: acc.out)
        shift = lambda c: F.transform(c.out, lambda m: F.struct(m.m.alias("m"), (m.start + c.by).alias("start"), (m.end + c.by).alias("end"), m.left.alias("left"), m.right.alias("right")))
        return F.flatten(F.transform(placed, shift))

    # An array of one binds the matches to a name, so the pattern runs once.
    return F.when(text.rlike(pattern), F.element_at(F.transform(F.array(found), whole), 1)).otherwise(none)


def form(m: Column) -> Column:
    return F.when(m.rlike(f"^(?:{SECRET})"), "secret").when(m.rlike(r"^[A-Z]{2}[0-9]{2}"), "account").when(m.rlike(r"\(at\)|\[at\]"), "email").otherwise("number")


def _account_length(m: Column) -> Column:
    """An account number is as long as its country's are."""
    wanted = F.create_map(*(F.lit(x) for kv in sorted(ACCOUNTS.items()) for x in kv))
    return F.length(F.regexp_replace(m, " ", "")) == F.coalesce(F.try_element_at(wanted, F.substring(m, 1, 2)), F.lit(-1))


#: Labelers: votes from the match, the text on its left and on its right.
LABELERS = {
    "regex_secret": lambda m, a, z: F.when(m.rlike(r"[=:][\x20\x09\"']*(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{8,}$"), 1).when(m.rlike(f"^(?:{SECRET})"), -1).otherwise(0),
    "regex_number": lambda m, a, z: F.when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"), 1).when(m.rlike(r"^(?:19|20)[0-9]{2}[.-][0-9]{1,2}[.-][0-9]{1,2}$|^[0-9]+\.[0-9]+$"), -1).otherwise(0),
    "gazetteer": lambda m, a, z: F.when(F.lower(m).rlike("|".join(DUMMIES)) | m.rlike(r"^([0-9])\1*$"), -1).when(F.lower(m).rlike("|".join(SECRETS)), 1).when(m.rlike(r"^[A-Z]{2}[0-9]{2}"), F.when(_account_length(m), 1).otherwise(-1)).otherwise(0),
    "length": lambda m, a, z: F.when(form(m) != "number", 0).when(F.length(_digits(m)).between(9, 13), 1).when(F.length(_digits(m)) < 8, -1).otherwise(0),
    "cue": lambda m, a, z: F.when(a.rlike(CUES), 1).otherwise(0),
    "other": lambda m, a, z: F.when(a.rlike(OTHER) | z.rlike(r"^\s*(?:%|€|\$|km|kg|cm|mm|pm|am)\b"), -1).otherwise(0),
}


def annotate(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with BASE_COL (array<struct<kind, start, end>>, kinds as listed, then by start) and WIDE_COL
    (candidates that touch no base span: start, end, form, bucket, cue, votes)."""
    text = text_of(F.col(text_col))

    def spans(kind, pattern, check):
        found = F.filter(matches(text, pattern), lambda x: check(x.m))
        return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x.start.alias("start"), x.end.alias("end")))

    base = F.concat(*(spans(k, *x) for k, x in BASE.items()))

    def judged(x):
        votes = F.array(*(f(x.m, x.left, x.right).cast("int") for f in LABELERS.values()))
        return F.struct(x.start.alias("start"), x.end.alias("end"), form(x.m).alias("form"), F.least(F.floor(F.length(x.m) / 4), F.lit(8)).cast("int").alias("bucket"), x.left.rlike(CUES).alias("cue"), votes.alias("votes"))

    wide = F.transform(F.filter(matches(text, CANDIDATE), lambda x: ~F.exists(F.col(BASE_COL), lambda b: (b.start < x.end) & (x.start < b.end))), judged)
    return docs.withColumn(BASE_COL, base).withColumn(WIDE_COL, wide)


def reliabilities(counts: list[tuple[tuple, int]], rounds: int = 30) -> tuple[float, list[dict], dict]:
    """EM for one hidden yes/no behind conditionally independent votes: (prior, P(vote | no / yes) a
    labeler, posterior of each pattern).  Starts from labelers that are right three times in four."""
    m = len(counts[0][0]) if counts else 0
    p = 0.5
    table_ = [{v: (0.75 if v < 0 else 0.25, 0.75 if v > 0 else 0.25) if v else (0.5, 0.5) for v in (-1, 0, 1)} for _ in range(m)]
    post: dict = {}
    for _ in range(rounds):
        for votes, _n in counts:
            z = math.log(p / (1 - p)) + sum(math.log(table_[j][v][1] / table_[j][v][0]) for j, v in enumerate(votes))
            post[votes] = 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))
        total = sum(n for _, n in counts)
        yes = sum(n * post[v] for v, n in counts)
        p = min(0.99, max(0.01, (yes + 1) / (total + 2)))
        for j in range(m):
            for v in (-1, 0, 1):
                # pseudo-counts keep each labeler better than chance
                prior = (3.0, 1.0) if v < 0 else (1.0, 3.0) if v > 0 else (2.0, 2.0)
                a = sum(n * (1 - post[w]) for w, n in counts if w[j] == v) + prior[0]
                b = sum(n * post[w] for w, n in counts if w[j] == v) + prior[1]
                table_[j][v] = (a / (total - yes + 6), b / (yes + 6))
    return p, table_, post


def train(annotated: DataFrame) -> dict:
    """The span classifier: log-odds of form, length bucket and cue (bounded tables)."""
    seen = annotated.select(F.explode(WIDE_COL).alias("w")).groupBy("w.votes", "w.form", "w.bucket", "w.cue").agg(F.count(F.lit(1)).alias("n")).collect()
    if not seen:
        return {"prior": 0.0, "form": {}, "bucket": {}, "cue": {}, "votes": {}}
    by: dict = {}
    for r in seen:
        by[tuple(r.votes)] = by.get(tuple(r.votes), 0) + r.n
    p, rel, post = reliabilities(sorted(by.items()))
    model: dict = {"prior": math.log(p / (1 - p)), "votes": [{v: math.log(t[v][1] / t[v][0]) for v in t} for t in rel]}
    yes = sum(post[tuple(r.votes)] * r.n for r in seen)
    no = sum(r.n for r in seen) - yes
    for name in ("form", "bucket", "cue"):
        sums: dict = {}
        for r in seen:
            s = sums.setdefault(r[name], [1.0, 1.0])
            s[0] += (1 - post[tuple(r.votes)]) * r.n
            s[1] += post[tuple(r.votes)] * r.n
        model[name] = {k: math.log(b / (yes + 2)) - math.log(a / (no + 2)) for k, (a, b) in sums.items()}
    return model


def accepted(model: dict, threshold: float = 0.5) -> Column:
    """array<struct<kind, start, end>>: base spans and the candidates that the classifier accepts."""

    def look(name, value, default=0.0):
        out = F.lit(default)
        for k, w in sorted(model[name].items(), key=lambda x: str(x[0])):
            out = F.when(value == F.lit(k), F.lit(w)).otherwise(out)
        return out

    def odds(w):
        return F.lit(model["prior"]) + look("form", w.form) + look("bucket", w.bucket) + look("cue", w.cue)

    fits = F.filter(WIDE_COL, lambda w: (odds(w) > math.log(threshold / (1 - threshold))) & F.exists(w.votes, lambda v: v > 0))
    return F.concat(F.col(BASE_COL), F.array_sort(F.transform(fits, lambda w: F.struct(w.form.alias("kind"), w.start.alias("start"), w.end.alias("end")))))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))


def ordered(spans: Column) -> Column:
    """Kinds as listed, others after them by name; then by start."""
    rank = lambda s: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KINDS)), s.kind), F.lit(0).cast("long")), F.lit(99).cast("long"))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("r"), s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"))))
    return F.transform(keyed, lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end")))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts of base spans by kind, their digest, all spans, and all spans as an array."""
    found = table(annotate(docs.select(id_col, text_col), text_col).select(id_col, BASE_COL, WIDE_COL), "pii-spans")
    model = train(found)
    out = found.withColumn(SPANS_COL, ordered(accepted(model)))

    def count(kind):
        return F.size(F.filter(BASE_COL, lambda b: b.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return out.select(id_col, *counts, F.sha2(_joined(F.col(BASE_COL)), 256).alias("base_sha256"), _joined(F.col(SPANS_COL)).alias("spans"), F.col(SPANS_COL).alias("span_list"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets; same columns."""
    seen = table(annotate(docs, text_col), "pii-annotated")
    model = train(seen)
    spans = F.array_sort(F.transform(accepted(model), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    text = F.col(text_col)

    def step(acc, s):
        piece = F.substring(text, acc.at + 1, F.greatest(s.start - acc.at, F.lit(0)))
        return F.when(s.end <= acc.at, acc).otherwise(F.struct(s.end.alias("at"), F.concat(acc.out, piece, F.lit("<"), s.kind, F.lit(">")).alias("out")))

    done = F.aggregate(F.col(SPANS_COL), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))
    kept = [F.when(F.size(SPANS_COL) > 0, done).otherwise(text).alias(text_col) if c == text_col else F.col(c) for c in docs.columns]
    return seen.withColumn(SPANS_COL, spans).select(*kept)
