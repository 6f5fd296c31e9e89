"""A hierarchical Pitman-Yor language model of word pairs, by Gibbs sampling of its seating.

Restaurants: one for each context, all with the unigram restaurant as parent, whose base is uniform
over the training words and one unknown.  A context is the word before, by 48 bits of its hash
(the start and the end of a text are one word); words go by 64 bits.  Customers are training tokens.  Each dish of each
context keeps its tables with the number of customers at each.  A sweep takes `visits` customers of
every dish, one after another: a customer drawn at random leaves its table, which goes if it was
alone, and sits down anew at a table in proportion to n - d, or at a new one in proportion to
(theta + d T) p(word).  (A dish of one customer always has one table.)  Tables are the customers of
the unigram restaurant, whose tables are drawn anew in each sweep.  The first `burn` sweeps are discarded;
predictive probabilities are averaged over the `sweeps` after them.  Discounts are n1 / (n1 + 2 n2)
of the dishes with one and two customers, unless the caller names them.

Tokens are dealt by word into parts, so that a part holds all of a word's contexts and its parent
probability.  Words that hold more than half a part's share of a bounded sample of texts are hot:
their tokens are dealt by context too, and their few totals (at most two words a part) are summed
apart.  The sample steers the dealing alone, never a count.  What couples parts are the customers and
tables of each context: a table of their own, dealt by ranges of the context's hash into buckets;
after a sweep every part sends its share, a bucket adds up and sends each part the totals of the
contexts that it holds.  Parts use the totals of the sweep before.  Nothing per context or per word
comes to the driver.  All tokens of all texts are counted and scored; a block of texts sends a word
pair once with its number.

Defined cases: null and empty texts are their end token alone; repeated rows train and are scored
one by one; without training rows every word is unknown; an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_rows, crc_mod, forget, give_back, mixed, released, settled, text_of, word_hashes

#: Documents of a block; their numbers and the training bit take 12 bits.
BLOCK = 2000
WIDE = 4096
END = np.uint64(1)
#: Texts that the hot words are looked for in, about.
SAMPLE = 4000


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def unpack(raw, *kinds) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    out, at = [], 8 * len(kinds)
    for n, kind in zip(np.frombuffer(data, np.int64, len(kinds)).tolist(), kinds):
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _home(words: np.ndarray, contexts: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """The part of each (word, context); `hot` is sorted."""
    home = (words >> np.uint64(33)) % np.uint64(parts)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, words), len(hot) - 1)
        spread = (mixed(words + contexts * np.uint64(3)) >> np.uint64(33)) % np.uint64(parts)
        home = np.where(hot[at] == words, spread, home)
    return home.astype(np.int64)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then its end, and tokens of each text."""
    words, sizes = word_hashes(texts)
    sizes = sizes + 1
    out = np.full(len(words) + len(sizes), END, np.uint64)
    plain = np.ones(len(out), bool)
    plain[np.cumsum(sizes) - 1] = False
    out[plain] = words
    return out, sizes


def _hot(rows: DataFrame, documents: int, parts: int) -> np.ndarray:
    """Words with over half a part's share of the tokens of some SAMPLE texts, drawn by hash."""
    def run(batches):
        for b in batches:
            words, n = np.unique(_tokens(b.column(0))[0], return_counts=True)
            many = n * 8 * parts >= n.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.append(words[many], np.uint64(0)).view(np.int64)), pa.array(np.append(n[many], n.sum()))], names=["word", "n"])

    share = min(1.0, SAMPLE / max(documents, 1))
    drawn = rows.filter(F.pmod(F.xxhash64(F.lit(29), "doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    counts = drawn.mapInArrow(released(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.filter("word = 0").agg(F.max("n")).first()[0] or 0
    found = counts.filter(f"word <> 0 and n * {2 * parts} >= {total}").collect()  # at most two words a part
    return np.sort(np.array([r.word for r in found], np.int64).view(np.uint64))


def _emit(parts: int, hot: np.ndarray):
    """Messages of a block to the parts: words with their numbers of pairs, contexts and numbers of
    tokens of the pairs, documents of the tokens; and the block's documents."""
    def run(batches):
        number, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                some, block = batch.slice(lo, BLOCK), f"{task}:{number}"
                number += 1
                train = np.asarray(some.column(2)).astype(np.uint16)
                h, sizes = _tokens(some.column(1))
                doc = np.repeat(np.arange(len(sizes), dtype=np.uint16) << 1 | train, sizes)
                vocabulary, w = np.unique(h, return_inverse=True)
                c = np.roll(w, 1)
                c[0] = np.searchsorted(vocabulary, END)
                code = w * len(vocabulary) + c
                order = np.argsort(code, kind="stable")
                code, doc = code[order], doc[order]
                start = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
                runs, code = np.diff(np.append(start, len(doc))), code[start]
                words, contexts = vocabulary[code // len(vocabulary)], vocabulary[code % len(vocabulary)]
                home = _home(words, contexts, hot, parts)
                order = np.argsort(home, kind="stable")
                words, contexts, start, runs, home = words[order], contexts[order], start[order], runs[order], home[order]
                upto = np.concatenate(([0], np.cumsum(runs)))
                doc = doc[np.repeat(start - upto[:-1], runs) + np.arange(len(doc))]
                present, ends = np.unique(home, return_index=True)
                out, kinds = [], []
                for p, x, y in zip(present.tolist(), ends.tolist(), [*ends[1:].tolist(), len(home)]):
                    new = np.flatnonzero(np.concatenate(([True], words[x + 1 : y] != words[x : y - 1])))
                    out.append(pack(words[x:y][new], np.diff(np.append(new, y - x)).astype(np.uint32), (contexts[x:y] >> np.uint64(32)).astype(np.uint32), (contexts[x:y] >> np.uint64(16)).astype(np.uint16), runs[x:y].astype(np.uint32), doc[upto[x] : upto[y]]))
                    kinds.append((p, 0))
                ids = np.array([(0, 1) if i is None else (i, 0) for i in some.column(0).to_pylist()], np.int64).reshape(-1)
                out.append(pack(sizes.astype(np.int64), train.astype(np.uint8), ids))
                kinds.append((xxhash.xxh32_intdigest(block) % parts, 1))
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in kinds], pa.int32()), pa.array([k for _, k in kinds], pa.int32()), pa.array([block] * len(out), pa.string()), pa.array(out, pa.binary())], names=["part", "kind", "block", "x"])

    return run


def seat(count: np.ndarray, fresh: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating `count` customers of one dish: a new table has weight `fresh`, i.e.
    (theta + d T) p, against n - d t for the tables there are.  Long queues go in steps of an
    eighth of the customers seated so far."""
    order = np.argsort(-count, kind="stable")
    c, f, t = count[order], fresh[order], np.minimum(count[order], 1).astype(np.float64)
    j = 1
    while (live := int(np.searchsorted(-c, -j, "left"))):
        m = np.minimum(max(1, j // 8), c[:live] - j)
        p = f[:live] / (f[:live] + np.maximum(j - d * t[:live], 1e-9))
        t[:live] += rng.binomial(m, np.clip(p, 0, 1)) if j >= 8 else rng.random(live) < p
        j += max(1, j // 8)
    out = np.empty_like(t)
    out[order] = np.minimum(t, c)
    return out


class Seats:
    """The tables of dishes with two customers or more: `size[start[i] : start[i + 1]]` are those of
    dish i, each with its customers."""

    def __init__(self, tables: np.ndarray, size: np.ndarray):
        self.tables, self.size = tables.astype(np.int64), size.astype(np.int64)

    @classmethod
    def opened(cls, count: np.ndarray, tables: np.ndarray) -> "Seats":
        """A first seating: all tables but each dish's first have one customer."""
        tables = tables.astype(np.int64)
        size = np.ones(int(tables.sum()), np.int64)
        size[np.cumsum(tables) - tables] = count - tables + 1
        return cls(tables, size)

    def resample(self, fresh: np.ndarray, d: float, visits: int, rng: np.random.Generator) -> None:
        """Takes away and seats anew `visits` customers of every dish."""
        n = len(self.tables)
        if not n:
            return
        room = self.tables + visits  # a visit opens one table at most
        start = np.cumsum(room) - room
        size = np.zeros(int(room.sum()), np.int64)
        size[np.arange(len(self.size)) + np.repeat(start - (np.cumsum(self.tables) - self.tables), self.tables)] = self.size
        free, last, t = start + self.tables, start + room - 1, self.tables.copy()
        upto = np.cumsum(size)
        count = np.diff(np.concatenate(([0], upto[last])))
        base = upto[last] - count
        for _ in range(visits):
            left = np.searchsorted(np.cumsum(size), base + (rng.random(n) * count).astype(np.int64), "right")
            size[left] -= 1
            t -= size[left] == 0
            weight = np.cumsum(np.where(size > 0, size - d, 0.0))
            before = np.where(start > 0, weight[start - 1], 0.0)
            stay = weight[last] - before
            at = rng.random(n) * (stay + fresh)
            to = np.clip(np.searchsorted(weight, before + at, "right"), start, last)
            new = (at >= stay) | (size[to] == 0)
            to = np.where(new, free, to)
            size[to] += 1
            t += new
            free += new
        self.tables, self.size = t, size[size > 0]


class Part:
    """One part's pairs, sorted by word and context, with their training counts.  `ctx` numbers the
    part's own contexts; there are `contexts` of them.  `hot` numbers the word among the hot ones, or
    is -1."""

    def __init__(self, sizes: np.ndarray, ctx: np.ndarray, count: np.ndarray, contexts: int, hot: np.ndarray):
        self.word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.ctx, self.count, self.contexts, self.hot = ctx, count.astype(np.int64), contexts, hot
        self.word_count = np.bincount(self.word, self.count, len(sizes)).astype(np.int64)
        self.many = np.flatnonzero(self.count > 1)

    def whole(self, own: np.ndarray, hot_totals: np.ndarray) -> np.ndarray:
        """Values of the words, those of hot ones over all parts."""
        out, at = own.copy(), self.hot >= 0
        out[at] = hot_totals[self.hot[at]]
        return out

    def partial(self, values: np.ndarray, hot: int) -> np.ndarray:
        at = self.hot >= 0
        return np.bincount(self.hot[at], values[at], hot)

    def sweep(self, state: dict, model: dict, seed: tuple, visits: int):
        """(tables of each pair, seats, root customers and tables of each word), given the last totals."""
        rng = np.random.default_rng(seed)
        parent = root_mass(state, model, self.whole(state["root_c"], state["hot_c"]), self.whole(state["root_t"], state["hot_t"]))
        fresh = (model["theta"] + model["d"] * state["tu"][self.ctx[self.many]]) * parent[self.word[self.many]]
        seats = state["seats"] or Seats.opened(self.count[self.many], seat(self.count[self.many], fresh, model["d"], rng))
        seats.resample(fresh, model["d"], visits, rng)
        t = (self.count > 0).astype(np.int64)
        t[self.many] = seats.tables
        root_c = np.bincount(self.word, t, len(self.word_count)).astype(np.int64)
        return t, seats, root_c, root_tables(root_c, state, model, rng)

    def shares(self, t) -> tuple[np.ndarray, np.ndarray]:
        """The part's customers and tables of each of its contexts."""
        return np.bincount(self.ctx, self.count, self.contexts), np.bincount(self.ctx, t, self.contexts)


def root_mass(state: dict, model: dict, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The unigram restaurant's probability of each word."""
    return (c - model["d0"] * t + (model["theta0"] + model["d0"] * state["t0"]) / (state["v"] + 1.0)) / (state["c0"] + model["theta0"])


def root_tables(c: np.ndarray, state: dict, model: dict, rng) -> np.ndarray:
    return seat(c, np.full(len(c), (model["theta0"] + model["d0"] * state["t0"]) / (state["v"] + 1.0)), model["d0"], rng)


#: Kinds of rows: a part's pairs, a block's documents, a part's seating after a step, a part's share of
#: a bucket's contexts, the totals of these contexts, and their places in the bucket.
PAIRS, DOCUMENTS, SEATING, SHARE, TOTALS, PLACES = range(6)
#: n, v: training tokens and words; c0, t0: customers and tables of the root; one, two: dishes with one and
#: two customers, in the contexts (a) and the root (b).  Hot words are left out and added on the driver.
_SUMS = ["n", "v", "c0", "t0", "one_a", "two_a", "one_b", "two_b"]
_KEYS = ["part", "kind", "step", "bucket", "a", "b", "c", "d", "hot", *_SUMS]
_ROWS = "part int, kind int, step int, bucket int, a binary, b binary, c binary, d binary, hot array<double>, " + ", ".join(f"{x} double" for x in _SUMS)
_PARTS = _ROWS + ", blocks array<string>, runs binary, doc binary"
_TYPES = [*[pa.int32()] * 4, *[pa.binary()] * 4, pa.list_(pa.float64()), *[pa.float64()] * len(_SUMS), pa.list_(pa.string()), pa.binary(), pa.binary()]


def _rows(out: list[tuple], schema: str):
    names = [x.split(" ")[0] for x in schema.split(", ")]
    return pa.table([pa.array([x[i] if i < len(x) else None for x in out], _TYPES[i]) for i in range(len(names))], names=names)


def _shares(part: int, step: int, contexts: np.ndarray, own: Part, t: np.ndarray, buckets: int) -> list[tuple]:
    """A row for every bucket that holds some of the part's contexts (sorted): their tables; in step 0
    also the contexts and their customers."""
    cu, tu = (x.astype(np.int64) for x in own.shares(t))
    at = [*np.searchsorted(contexts, np.array([(x << 64) // buckets for x in range(buckets)], np.uint64)).tolist(), len(contexts)]
    spans = [(x, lo, hi) for x, (lo, hi) in enumerate(zip(at, at[1:])) if lo < hi]
    return [(part, SHARE, step, x, None if step else contexts[lo:hi].tobytes(), None if step else pack(cu[lo:hi]), pack(tu[lo:hi])) for x, lo, hi in spans]


def _settle(key, rows):
    """Adds up one bucket's contexts over all parts, and gives each part the totals of those that it
    holds.  Step 0 gives the places of each part's contexts in the bucket too; later steps come with them."""
    own = sorted(rows.filter(pa.array(np.asarray(rows.column("kind")) == SHARE)).select(["part", "step", "a", "b", "c"]).to_pylist(), key=lambda r: r["part"])
    step = own[0]["step"]
    if step:
        places = {r["part"]: unpack(r["a"], np.uint32)[0] for r in rows.filter(pa.array(np.asarray(rows.column("kind")) == PLACES)).select(["part", "a"]).to_pylist()}
        each = [places[r["part"]] for r in own]
    else:
        at = np.unique(np.concatenate([np.frombuffer(r["a"], np.uint64) for r in own]), return_inverse=True)[1].astype(np.uint32)
        each = np.split(at, np.cumsum([len(r["a"]) // 8 for r in own])[:-1])
    whole = np.concatenate(each)
    tu = np.bincount(whole, np.concatenate([unpack(r["c"], np.int64)[0] for r in own])).astype(np.int64)
    cu = None if step else np.bincount(whole, np.concatenate([unpack(r["b"], np.int64)[0] for r in own])).astype(np.int64)
    bucket = key[0].as_py()
    out = [(r["part"], TOTALS, step, bucket, None if step else pack(cu[x]), pack(tu[x])) for r, x in zip(own, each)]
    if not step:
        out += [(r["part"], PLACES, 0, bucket, pack(x)) for r, x in zip(own, each)]
    give_back()
    return _rows(out, _ROWS)


class Held:
    """The rows of one part: its pairs, seatings by step, and context totals by step."""

    def __init__(self, rows):
        of: dict = {}
        for r in rows.select(_KEYS[:9]).to_pylist():
            of.setdefault((r["kind"], r["step"]), []).append(r)
        base = of[PAIRS, 0][0]
        sizes, hot = unpack(base["a"], np.uint32, np.int32)
        self.contexts = np.frombuffer(base["d"], np.uint64)
        self.own = Part(sizes, *unpack(base["b"], np.uint32, np.uint32), len(self.contexts), hot)
        self.of = of

    def totals(self, step: int, what: str) -> np.ndarray:
        return np.concatenate([unpack(r[what], np.int64)[0] for r in sorted(self.of[TOTALS, step], key=lambda r: r["bucket"])])

    def roots(self, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Root customers and tables of each word; before any sweep one customer for each context."""
        if step == 0:
            c = np.bincount(self.own.word, self.own.count > 0, len(self.own.word_count)).astype(np.int64)
            return c, np.minimum(c, 1)
        return tuple(unpack(self.of[SEATING, step][0]["b"], np.int64, np.int64))

    def seats(self, step: int) -> Seats | None:
        return Seats(*unpack(self.of[SEATING, step][0]["a"], np.uint32, np.uint32)) if step else None


def _gather(parts: int, hot: np.ndarray):
    def run(key, rows):
        """Merges a part's tokens of all blocks into one row, and passes on the blocks' documents."""
        part = key[0].as_py()
        kind = np.asarray(rows.column("kind"))
        out, found = [], rows.filter(pa.array(kind == 0))
        order = np.argsort(np.array(found.column("block").to_pylist(), dtype=object)) if found.num_rows else []
        blocks = [found.column("block")[int(i)].as_py() for i in order]
        if blocks:
            hs, cs, runs_, docs = [], [], [], []
            for at, i in enumerate(order):
                words, pairs, high, low, runs, doc = unpack(found.column("x")[int(i)].as_buffer(), np.uint64, np.uint32, np.uint32, np.uint16, np.uint32, np.uint16)
                hs.append((words, pairs))
                cs.append(high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64) << np.uint64(16))
                runs_.append(runs)
                docs.append(doc.astype(np.uint32) + np.uint32(at * WIDE) if at < (1 << 20) else doc.astype(np.uint64) + np.uint64(at * WIDE))
            del found
            vocabulary, w = np.unique(np.concatenate([x for x, _ in hs]), return_inverse=True)
            w = np.repeat(w, np.concatenate([x for _, x in hs]))
            contexts, c = np.unique(np.concatenate(cs), return_inverse=True)
            del hs, cs
            runs = np.concatenate(runs_).astype(np.int64)
            code = w * len(contexts) + c
            del w, c
            order = np.argsort(code, kind="stable")
            code, start = code[order], (np.cumsum(runs) - runs)[order]
            runs = runs[order]
            new = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            upto = np.cumsum(runs) - runs
            doc = np.concatenate(docs)
            doc = doc[np.repeat(start - upto, runs) + np.arange(len(doc))]
            del docs, start
            own_runs = np.add.reduceat(runs, new)
            count = np.add.reduceat((doc & doc.dtype.type(1)).astype(np.int64), upto[new])
            code = code[new]
            sizes = np.bincount(code // len(contexts), minlength=len(vocabulary))
            ctx = (code % len(contexts)).astype(np.uint32)
            del code, runs, upto, order
            give_back()
            at = np.minimum(np.searchsorted(hot, vocabulary), max(len(hot) - 1, 0))
            which = np.where(hot[at] == vocabulary, at, -1).astype(np.int32) if len(hot) else np.full(len(vocabulary), -1, np.int32)
            own = Part(sizes, ctx, count, len(contexts), which)
            many = np.bincount(own.word, own.count > 0, len(sizes))
            cold = (which < 0) & (own.word_count > 0)
            sums = (own.count.sum(), cold.sum(), many[cold].sum(), cold.sum(), (count == 1).sum(), (count == 2).sum(), (many[cold] == 1).sum(), (many[cold] == 2).sum())
            hot_sums = np.concatenate([own.partial(own.word_count, len(hot)), own.partial(many, len(hot))]).tolist()
            out.append((part, PAIRS, 0, -1, pack(sizes.astype(np.uint32), which), pack(ctx, count.astype(np.uint32)), None, contexts.tobytes(), hot_sums, *map(float, sums), blocks, pack(own_runs.astype(np.uint32)), pack(doc)))
            out += _shares(part, 0, contexts, own, count > 0, parts)
        for block, x in zip(*(rows.filter(pa.array(kind == 1)).column(c).to_pylist() for c in ("block", "x"))):
            out.append((part, DOCUMENTS, 0, -1, x, *[None] * (len(_KEYS) - 5), [block]))
        return _rows(out, _PARTS)

    return run


def _sums(df: DataFrame, hot: int) -> tuple[dict, np.ndarray]:
    """Sums over the parts: one row, and one for each hot word's value."""
    found = {x: v or 0.0 for x, v in df.agg(*(F.sum(x).alias(x) for x in _SUMS)).first().asDict().items()}
    each = np.zeros(2 * hot)
    if hot:
        for r in df.select(F.posexplode("hot").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():  # two rows a hot word
            each[r.at] = r.x
    return found, each


def score(docs: DataFrame, sweeps: int = 3, part_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", hold: int = 5, held: int = 1, model: dict | None = None, burn: int = 2, visits: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("text"), (crc_mod(F.col(id_col), hold) != held).alias("train"))
    size, documents = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    parts = max(4, -(-(size or 0) // part_bytes))
    hot = _hot(rows, documents, parts)
    emitted = rows.mapInArrow(released(_emit(parts, hot)), "part int, kind int, block string, x binary")
    with arrow_rows(spark, BLOCK):
        got = settled(emitted.groupBy("part").applyInArrow(_gather(parts, hot), _PARTS), "lm-parts")
    mine = got.filter(F.col("kind") == PAIRS)
    pairs = mine.select(_KEYS)
    first, hot_first = _sums(pairs, len(hot))
    ratio = lambda a, b: min(0.95, max(0.1, a / (a + 2 * b))) if a + b else 0.5
    model = {"d": ratio(first["one_a"], first["two_a"]), "theta": 4.0, "d0": ratio(first["one_b"], first["two_b"]), "theta0": 1.0} | (model or {})
    hot_n = hot_first[: len(hot)]
    hot_c = hot_first[len(hot) :]
    base = {"n": first["n"], "v": first["v"] + float((hot_n > 0).sum())}

    def state_of(sums: dict, hot_c: np.ndarray, step: int, last: dict | None) -> dict:
        """Totals of the root after a step; hot words' root tables are drawn here."""
        hot_c = hot_c.astype(np.int64)
        hot_t = np.minimum(hot_c, 1).astype(np.float64) if last is None else root_tables(hot_c, last, model, np.random.default_rng((20240607, step)))
        return base | {"c0": sums["c0"] + float(hot_c.sum()), "t0": sums["t0"] + float(hot_t.sum()), "hot_c": hot_c, "hot_t": hot_t}

    shares, states, totals, seatings = got.filter(F.col("kind") == SHARE).select(_KEYS), [state_of(first, hot_c, 0, None)], [], []

    def sweep(k: int, state: dict):
        def run(key, rows):
            part, held_ = key[0].as_py(), Held(rows)
            root_c, root_t = held_.roots(k - 1)
            own = held_.own
            t, seats, root_c, root_t = own.sweep(state | {"tu": held_.totals(k - 1, "b"), "root_c": root_c, "root_t": root_t, "seats": held_.seats(k - 1)}, model, (20240607, part, k), visits)
            cold = own.hot < 0
            sums = [None, None, float(root_c[cold].sum()), float(root_t[cold].sum())] + [None] * (len(_SUMS) - 4)
            partial = np.concatenate([np.zeros(len(hot)), own.partial(root_c, len(hot))]).tolist()
            out = _rows([(part, SEATING, k, -1, pack(seats.tables.astype(np.uint32), seats.size.astype(np.uint32)), pack(root_c.astype(np.int64), root_t.astype(np.int64)), None, None, partial, *sums), *_shares(part, k, held_.contexts, own, t, parts)], _ROWS)
            give_back()
            return out

        return run

    kept = range(burn + 1, burn + sweeps + 1)

    def settle() -> None:
        rows = shares.unionByName(places) if places is not None else shares
        totals.append(settled(rows.groupBy("bucket").applyInArrow(_settle, _ROWS), "lm-totals"))

    places = None
    with arrow_rows(spark, 1):
        for k in range(1, burn + sweeps + 1):
            settle()
            places = totals[0].filter(F.col("kind") == PLACES)
            rows = pairs.unionByName(totals[-1].filter(F.col("kind") == TOTALS))
            if seatings:
                rows = rows.unionByName(seatings[-1].filter(F.col("kind") == SEATING))
            seatings.append(settled(rows.groupBy("part").applyInArrow(sweep(k, states[-1]), _ROWS), "lm-sweep"))
            if 1 < k <= burn + 1:  # what no later sweep or score reads
                forget(totals[-1], seatings[-2])
            shares = seatings[-1].filter(F.col("kind") == SHARE)
            sums, each = _sums(seatings[-1].filter(F.col("kind") == SEATING), len(hot))
            states.append(state_of(sums, each[len(hot) :], k, states[-1]))
        settle()

    def mark(key, rows):
        """Sums of a part's tokens for each document that has some here, a row for each block."""
        held_ = Held(rows)
        own, p = held_.own, np.zeros(len(held_.own.count))
        cu = held_.totals(0, "a")[own.ctx]
        for k in kept:
            c, t0 = held_.roots(k)
            state = states[k]
            up = root_mass(state, model, own.whole(c, state["hot_c"]), own.whole(t0, state["hot_t"]))[own.word]
            t = (own.count > 0).astype(np.int64)
            t[own.many] = held_.seats(k).tables
            p += (own.count - model["d"] * t + (model["theta"] + model["d"] * held_.totals(k, "b")[own.ctx]) * up) / (cu + model["theta"])
        part, r = key[0].as_py(), rows.filter(pa.array(np.asarray(rows.column("kind")) == PAIRS)).select(["blocks", "runs", "doc"]).to_pylist()[0]
        del held_, cu
        wc = own.whole(own.word_count, hot_n)[own.word]
        values = (np.log10(p / sweeps), np.log10((wc + 0.5) / (base["n"] + 0.5 * (base["v"] + 1))), wc > 0)
        runs, blocks_here = unpack(r["runs"], np.uint32)[0], r["blocks"]
        at = unpack(r["doc"], np.uint32 if len(blocks_here) <= 1 << 20 else np.uint64)[0].astype(np.int64)
        del own, p, wc
        at = at // WIDE * BLOCK + (at % WIDE >> 1)
        present = np.bincount(at, minlength=len(blocks_here) * BLOCK) > 0
        sums = [np.bincount(at, np.repeat(w, runs), len(present)) for w in values]
        del at
        out: list[list] = [[], [], [], []]
        for i, name in enumerate(blocks_here):
            docs_here = np.flatnonzero(present[i * BLOCK : (i + 1) * BLOCK])
            own_sums = [s[i * BLOCK + docs_here] for s in sums]
            for o, x in zip(out, (name, part, pack(docs_here.astype(np.uint16), own_sums[0], own_sums[1], own_sums[2].astype(np.uint32)), None)):
                o.append(x)
        give_back()
        return pa.table([pa.array(o, t) for o, t in zip(out, (pa.string(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "part", "x", "y"])

    def total(key, rows):
        found = sorted(rows.to_pylist(), key=lambda r: r["part"])
        n, train, ids = unpack(found[0]["y"], np.int64, np.uint8, np.int64)  # part -1: the block's documents
        a, b, c = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n), np.int64)
        for r in found[1:]:
            at, x, y, z = unpack(r["x"], np.uint16, np.float64, np.float64, np.uint32)
            a[at] += x
            b[at] += y
            c[at] += z
        return pa.table({"doc_id": pa.array([None if m else i for i, m in ids.reshape(-1, 2).tolist()], pa.int64()), "held_out": pa.array(train == 0), "n_tokens": pa.array(n), "n_known": pa.array(c), "train_tokens": pa.array(np.full(len(n), int(base["n"]), np.int64)), "base_score": pa.array(b), "score": pa.array(a)})

    rows = mine.select(*_KEYS, "blocks", "runs", "doc")
    empty = F.lit(None).cast("binary")
    used = [totals[0].withColumn("b", empty), *(totals[k] for k in kept), *(seatings[k - 1] for k in kept)]
    for x in used:
        rows = rows.unionByName(x.filter(F.col("kind").isin(TOTALS, SEATING)), allowMissingColumns=True)
    with arrow_rows(spark, 1):
        marked = settled(rows.groupBy("part").applyInArrow(mark, "block string, part int, x binary, y binary"), "lm-sums")
    heads = got.filter(F.col("kind") == DOCUMENTS).select(F.col("blocks")[0].alias("block"), F.lit(-1).alias("part"), empty.alias("x"), F.col("a").alias("y"))
    return marked.unionByName(heads).groupBy("block").applyInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
