"""Exact n-gram Jaccard join by vertical partitioning, as links and their components.

A document is its set of word 5-shingles (64-bit hashes).  The global n-gram order is cut into
fragments; each fragment's task sees only the segments of the sets that fall into it, counts partial
overlaps of pairs there, and the counts are summed per pair.  Only prefixes take part (two sets with
Jaccard >= 3/4 share an n-gram among the first n - ceil(3n/4) + 1 of each), so a pair's summed
overlap bounds its whole overlap; pairs that can reach the threshold are verified on whole sets.

Equal sets are one class.  Within a fragment, an n-gram held by up to LIGHT classes gives all their
pairs; one held by more is listed, and each list gives a star around one of its holders.  When stars are verified
and joined into components, listed n-grams inside one component need nothing more: any link among
their holders would join what is joined.  N-grams across up to FEW components give the pairs between
components.  N-grams across more are common passages: their holders are joined anew among
themselves under an order that puts those n-grams last; any fixed order is exact, because a pair
that shares no such n-gram in its prefixes is complete already.  The last level gives all pairs
between components.  No pair is dropped at any size.

Defined cases: texts without words (null, empty) have no n-grams and link with nothing; texts of
fewer than five words are one n-gram, their whole sequence; texts are read whole; equal ids or
repeated rows link as equal sets do; an empty table gives no rows; other columns are not touched.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import arrow_rows, forget, give_back, mixed, released, settled, table, text_of, word_hashes
from .components import components

WORDS = 5
#: Columns of our own beside a table's.
_KEY, _COMP = "_foretide_row", "_foretide_component"
LIGHT, FEW, LEVELS = 8, 32, 4
SLICE = 2000
#: Pairs that a task expands before it sums them.
MEET = 1 << 20
#: Six blocks are 21 tasks, so that no task has all lists.
LEAST_BLOCKS = 6
#: Holders of a list that one key of a join on lists has.
HOT = 4096
_M = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text (A-Z lowered)."""
    words, n = word_hashes(texts)
    grams = np.zeros(max(len(words) - WORDS + 1, 0), np.uint64)
    for i in range(WORDS if len(grams) else 0):
        grams = grams * _M + words[i : len(words) - WORDS + 1 + i]
    grams = mixed(grams)
    out, at = [], 0
    for k in n.tolist():
        if k >= WORDS:
            out.append(np.unique(grams[at : at + k - WORDS + 1]))
        else:
            whole = np.full(min(k, 1), WORDS - k, np.uint64)
            for x in words[at : at + k]:
                whole = whole * _M + x
            out.append(mixed(whole))
        at += k
    return out


def required(na, nb):
    """Smallest overlap with Jaccard of at least 3/4: overlap / (na + nb - overlap) >= 3/4."""
    return (3 * (na + nb) + 6) // 7


class Bits:
    """A fixed-size set of 64-bit hashes with false positives, never false negatives."""

    def __init__(self, raw: bytes):
        self.bits = np.frombuffer(raw, np.uint8)
        self.mask = np.uint64(len(raw) * 8 - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in bit_places(h, self.mask):
            out &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def bit_places(h: np.ndarray, mask: np.uint64):
    h = mixed(h)
    return h & mask, mixed(h) & mask


def bits_of(df: DataFrame, column: str, n: int) -> bytes:
    """A bit set over a column of longs: 16 bits a value, at most 32 MB.  At most eight partial sets,
    of that fixed size, come to the driver."""
    size = 1 << min(28, max(16, (16 * max(n, 1) - 1).bit_length()))

    def run(batches):
        bits = np.zeros(size // 8, np.uint8)
        for b in batches:
            h = np.asarray(b.column(0).drop_null()).astype(np.int64).view(np.uint64)
            for at in bit_places(h, np.uint64(size - 1)):
                np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["x"])

    parts = [r.x for r in df.select(column).coalesce(8).mapInArrow(run, "x binary").collect()]
    out = np.zeros(size // 8, np.uint8)
    for p in parts:
        out |= np.frombuffer(p, np.uint8)
    return out.tobytes()


def _fragment(t: np.ndarray, late: np.ndarray, fragments: int) -> np.ndarray:
    """Fragments are ranges of the order: most prefix n-grams lie in its first quarter."""
    u = t.astype(np.float64) / 2.0**64
    at = np.where(u < 0.26, u / 0.26 * 0.95, 0.95 + (u - 0.26) / 0.74 * 0.05)
    return np.minimum((at * fragments).astype(np.int64), fragments - 1) + np.where(late, fragments, 0)


_EMITTED = "frag int, doc_id long, cls long, n long, c binary, s binary, k binary, t binary"


def _only(wanted):
    """The rows whose id is in the broadcast bits."""

    def run(batches):
        bits = Bits(wanted.value)
        for b in batches:
            number = np.array([0 if x is None else x for x in b.column(0).to_pylist()], np.int64)
            if len(number):
                yield b.filter(pa.array(bits.has(number.view(np.uint64))))

    return run


def _emit(fragments: int, common=None):
    """Documents (frag -1) and, by fragment, the prefixes' segments: classes, set sizes, segment
    lengths, n-grams.  `common`: bits of the n-grams that come last."""

    def run(batches):
        late = Bits(common.value) if common is not None else None
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                some = batch.slice(lo, SLICE)
                ids = some.column(0)
                sets = shingle_sets(some.column(1))
                cls = np.array([xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64)
                size = np.array([len(s) for s in sets], np.int64)
                rows = {x: [] for x in ("frag", "c", "s", "k", "t")}
                seen, toks, who, lates = set(), [], [], []
                for i, s in enumerate(sets):
                    if not len(s) or int(cls[i]) in seen:
                        continue
                    seen.add(int(cls[i]))
                    p = len(s) - (3 * len(s) + 3) // 4 + 1
                    if late is None:
                        toks.append(s[:p])
                        lates.append(np.zeros(p, bool))
                    else:
                        last = late.has(s)
                        toks.append(np.concatenate((s[~last], s[last]))[:p])
                        lates.append(np.arange(p) >= int((~last).sum()))
                    who.append(np.full(p, i))
                if toks:
                    t, w = np.concatenate(toks), np.concatenate(who)
                    f = _fragment(t, np.concatenate(lates), fragments)
                    order = np.argsort(f * SLICE + w, kind="stable")
                    t, w, f = t[order], w[order], f[order]
                    cuts = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1], [True])))
                    for x, y in zip(cuts[:-1], cuts[1:]):
                        ww = w[x:y]
                        new = np.flatnonzero(np.concatenate(([True], ww[1:] != ww[:-1])))
                        rows["frag"].append(int(f[x]))
                        rows["c"].append(cls[ww[new]].tobytes())
                        rows["s"].append(size[ww[new]].astype(np.uint32).tobytes())
                        rows["k"].append(np.diff(np.append(new, len(ww))).astype(np.uint32).tobytes())
                        rows["t"].append(t[x:y].tobytes())
                m = len(rows["frag"])
                docs = len(sets) if common is None else 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([-1] * docs + rows["frag"], pa.int32()),
                        pa.concat_arrays([ids.slice(0, docs), pa.nulls(m, pa.int64())]),
                        pa.concat_arrays([pa.array(cls[:docs].view(np.int64)), pa.nulls(m, pa.int64())]),
                        pa.concat_arrays([pa.array(size[:docs]), pa.nulls(m, pa.int64())]),
                        *(pa.array([None] * docs + rows[x], pa.binary()) for x in ("c", "s", "k", "t")),
                    ],
                    names=["frag", "doc_id", "cls", "n", "c", "s", "k", "t"],
                )

    return run


_COUNTED = "kind int, a long, b long, o long, na long, nb long, list long, tokens binary, held binary"


def _count(key, rows):
    """One fragment: partial overlaps of light n-grams' pairs (kind 1), lists of the holders of heavy
    n-grams, n-grams with equal holders together (kind 2)."""
    cs, ns, ts = [], [], []
    for c, s, k, t in zip(*(rows.column(x).to_pylist() for x in ("c", "s", "k", "t"))):
        k = np.frombuffer(k, np.uint32)
        cs.append(np.repeat(np.frombuffer(c, np.int64), k))
        ns.append(np.repeat(np.frombuffer(s, np.uint32), k))
        ts.append(np.frombuffer(t, np.uint64))
    give_back()
    c, n, t = np.concatenate(cs), np.concatenate(ns).astype(np.int64), np.concatenate(ts)
    del cs, ns, ts
    order = np.lexsort((c, t))
    c, n, t = c[order], n[order], t[order]
    keep = np.concatenate(([True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])))
    c, n, t = c[keep], n[keep], t[keep]
    starts = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
    length = np.diff(np.append(starts, len(t)))
    light: list[list] = [[], []]
    for size in range(2, LIGHT + 1):
        at = starts[length == size]
        for i in range(size):
            for j in range(i + 1, size):
                light[0].append(at + i)
                light[1].append(at + j)
    lists: dict[bytes, list] = {}
    for at, size in zip(starts[length > LIGHT].tolist(), length[length > LIGHT].tolist()):
        lists.setdefault(c[at : at + size].tobytes(), []).append(t[at])

    def summed(i, j):
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (i, j))
        fits = (3 * n[i] <= 4 * n[j]) & (3 * n[j] <= 4 * n[i])
        i, j = i[fits], j[fits]
        order = np.lexsort((c[j], c[i]))
        i, j = i[order], j[order]
        new = np.flatnonzero(np.concatenate(([True], (c[i][1:] != c[i][:-1]) | (c[j][1:] != c[j][:-1])))) if len(i) else np.zeros(0, np.int64)
        return i[new], j[new], np.diff(np.append(new, len(i)))

    i0, j0, o = summed(*light)
    m, z = len(i0), len(lists)
    return pa.table({
        "kind": pa.array([1] * m + [2] * z, pa.int32()),
        "a": pa.concat_arrays([pa.array(c[i0]), pa.nulls(z, pa.int64())]), "b": pa.concat_arrays([pa.array(c[j0]), pa.nulls(z, pa.int64())]),
        "o": pa.concat_arrays([pa.array(o), pa.array(np.array([len(v) for v in lists.values()], np.int64))]),
        "na": pa.concat_arrays([pa.array(n[i0]), pa.nulls(z, pa.int64())]), "nb": pa.concat_arrays([pa.array(n[j0]), pa.nulls(z, pa.int64())]),
        "list": pa.array([None] * m + [key[0].as_py() << 32 | x for x in range(z)], pa.int64()),
        "tokens": pa.array([None] * m + [np.array(v, np.uint64).tobytes() for v in lists.values()], pa.binary()),
        "held": pa.array([None] * m + list(lists), pa.binary()),
    })


def _by_list(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """rows(list, m, cls, ...) joined with one row for each list, where m is the number of the list's
    holders: a list of more than HOT is spread over as many keys as it has times HOT holders."""
    salts = F.floor(F.col("m") / HOT)
    many = rows.withColumn("salt", F.pmod(F.xxhash64("cls"), salts + 1))
    sizes = rows.filter(F.col("m") >= HOT).select("list", "m").distinct()
    spread = lists.join(sizes, "list", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(salts, F.lit(0))))).drop("m")
    return many.join(spread, ["list", "salt"]).drop("salt")


def _longs(column: str, name: str):
    """Rows (list, its n-grams w, its values m, value) from packed 64-bit values."""

    def run(batches):
        for b in batches:
            packs = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
            if packs:
                size = [len(p) for p in packs]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(np.asarray(x), size)) for x in (b.column(0), b.column(1), pa.array(size, pa.int64()))), pa.array(np.concatenate(packs))], names=["list", "w", "m", name])

    return lambda df: df.select("list", F.col("o").alias("w"), column).mapInArrow(run, f"list long, w long, m long, {name} long")


def verified(rows: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b of classes) that link, by exact overlap of whole sets.

    The sets are read again from the texts of the classes' first documents; 48 bits of each hash are
    compared, within one pair."""
    spark = rows.sparkSession
    ids = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(reps, "cls").select("rep")
    ids = table(ids, "join-ids")
    only = spark.sparkContext.broadcast(bits_of(ids, "rep", ids.count()))

    def read(batches):
        seen = set()
        for some in _only(only)(batches):
            for lo in range(0, some.num_rows, 500):
                cls, hi, mid, size = [], [], [], []
                for s in shingle_sets(some.column(1).slice(lo, 500)):
                    h = xxhash.xxh64_intdigest(s.tobytes())
                    if len(s) and h not in seen:
                        seen.add(h)
                        top = s >> np.uint64(16)
                        cls.append(h)
                        hi.append((top >> np.uint64(16)).astype(np.uint32).tobytes())
                        mid.append((top & np.uint64(0xFFFF)).astype(np.uint16).tobytes())
                        size.append(len(s))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(cls, np.uint64).view(np.int64)), pa.array(hi, pa.binary()), pa.array(mid, pa.binary())], names=["cls", "hi", "mid"])

    def overlap(batches):
        def whole(hi, mid):
            return np.frombuffer(hi, np.uint32).astype(np.uint64) << np.uint64(16) | np.frombuffer(mid, np.uint16)

        for b in batches:
            keep = []
            for ha, ma, hb, mb in zip(*(b.column(x).to_pylist() for x in ("ha", "ma", "hb", "mb"))):
                x, y = whole(ha, ma), whole(hb, mb)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                keep.append(int((both[1:] == both[:-1]).sum()) >= required(len(x), len(y)))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = rows.mapInArrow(released(read), "cls long, hi binary, mid binary")
    one = pairs.select("a", "b").join(sets.select(F.col("cls").alias("b"), F.col("hi").alias("hb"), F.col("mid").alias("mb")), "b")
    two = one.join(sets.select(F.col("cls").alias("a"), F.col("hi").alias("ha"), F.col("mid").alias("ma")), "a")
    with arrow_rows(spark, SLICE // 2):
        return settled(two.select("a", "b", "ha", "ma", "hb", "mb").mapInArrow(released(overlap), "a long, b long").distinct(), "join-links")


def _stars(held: DataFrame) -> DataFrame:
    """(a, b): for each list the pairs of its centre with the other holders, linear in the lists.

    The centre is the holder with the largest share of its prefix in lists: of near copies, the text
    that they were made from.  Pairs that share little serve no purpose here (the lists themselves
    are exact), so those below two fifths of a prefix are left out."""
    prefix = F.col("n") - F.floor((3 * F.col("n") + 3) / 4) + 1
    share = held.groupBy("cls").agg((F.sum("w") / F.max(prefix)).alias("share"))
    centre = held.join(share, "cls").groupBy("list").agg(F.max(F.struct("share", "n", "cls")).alias("c"))
    fits = "cls <> c.cls and 3 * n <= 4 * c.n and 3 * c.n <= 4 * n"
    star = _by_list(held, centre).filter(fits)
    star = star.select(F.least("cls", "c.cls").alias("a"), F.greatest("cls", "c.cls").alias("b"), "w", F.least("n", "c.n").alias("n"))
    return star.groupBy("a", "b").agg(F.sum("w").alias("w"), F.first("n").alias("n")).filter("w >= 0.1 * n").select("a", "b")


def _reaching(key, rows):
    """Pairs between two blocks whose summed overlap can reach the threshold.

    Pairs are expanded list by list and summed whenever MEET of them are waiting, so what a task
    holds follows from the blocks' size, not from the longest list."""
    first, second = key[0].as_py(), key[1].as_py()
    of, cls, n, comp, w, block = (np.asarray(rows.column(x)) for x in ("list", "cls", "n", "comp", "w", "block"))
    order = np.argsort(of, kind="stable")
    of, n, comp, w, block = of[order], n[order], comp[order], w[order], block[order]
    names, who = np.unique(cls[order], return_inverse=True)
    sizes = np.zeros(len(names), np.int64)
    sizes[who] = n
    pairs, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list[tuple] = []

    def settle():
        nonlocal pairs, sums
        code, at = np.unique(np.concatenate([pairs, *(x for x, _ in waiting)]), return_inverse=True)
        sums = np.bincount(at, np.concatenate([sums, *(x for _, x in waiting)]), len(code)).astype(np.int64)
        pairs = code
        waiting.clear()

    held = 0
    bounds = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        left, right = (lo + np.flatnonzero(block[lo:hi] == b) for b in (first, second))
        step = max(1, MEET // max(1, len(right)))
        for at in range(0, len(left), step):
            i, j = np.repeat(left[at : at + step], len(right)), np.tile(right, len(left[at : at + step]))
            fits = (comp[i] != comp[j]) & (3 * n[i] <= 4 * n[j]) & (3 * n[j] <= 4 * n[i])
            if first == second:
                fits &= who[i] < who[j]
            i, j = i[fits], j[fits]
            a, b = np.minimum(who[i], who[j]), np.maximum(who[i], who[j])
            waiting.append((a * len(names) + b, np.maximum(w[i], w[j])))
            held += len(i)
            if held > MEET:
                settle()
                held = 0
    settle()
    a, b = pairs // len(names), pairs % len(names)
    # Beyond the prefix at most ceil(3n/4) - 1 n-grams are left.
    rest = np.maximum((3 * sizes[a] + 3) // 4, (3 * sizes[b] + 3) // 4) - 1
    can = sums + rest >= required(sizes[a], sizes[b])
    return pa.table({"a": pa.array(names[a[can]]), "b": pa.array(names[b[can]])})


def _between(lists: DataFrame, light: DataFrame) -> DataFrame:
    """(a, b): pairs across components that share lists and can reach the threshold.

    What a pair shares in its prefixes: in these lists, in longer ones (at most what is left to the
    next level, which sees such a pair again), and in light n-grams, which come in as lists of two.
    Holders are dealt into blocks, and each pair of blocks is a task that sums a pair's whole
    overlap, so no row is made for a pair and a list.  The number of blocks grows with the pairs."""
    most = lists.groupBy("list").agg(F.count(F.lit(1)).alias("m")).agg(F.sum(F.col("m") * F.col("m") / 2)).collect()[0][0] or 0
    blocks = max(LEAST_BLOCKS, math.ceil(math.sqrt(most / MEET)))
    known = lists.select("cls", "n", "comp").distinct()
    own = light.groupBy("a", "b").agg(F.sum("o").alias("w"))
    for s in "ab":
        own = own.join(known.select(F.col("cls").alias(s), F.col("n").alias(f"n{s}"), F.col("comp").alias(f"comp{s}")), s)
    ends = F.array(*(F.struct(F.col(s).alias("cls"), F.col(f"n{s}").alias("n"), F.col(f"comp{s}").alias("comp")) for s in "ab"))
    two = own.filter("compa <> compb").select((-F.abs(F.xxhash64("a", "b") / 2).cast("long") - 1).alias("list"), "w", F.explode(ends).alias("x"))
    held = lists.select("list", "w", "m", "cls", "n", "comp").union(two.select("list", "w", F.lit(2), "x.cls", "x.n", "x.comp"))
    held = held.withColumn("block", F.pmod(F.xxhash64("cls"), F.lit(blocks)).cast("int"))
    present = held.groupBy("list").agg(F.collect_set("block").alias("present"))  # at most `blocks` numbers
    dealt = _by_list(held, present).withColumn("other", F.explode("present"))
    dealt = dealt.select(F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "list", "cls", "n", "comp", "w")
    return dealt.groupBy("first", "second").applyInArrow(_reaching, "a long, b long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fragment_bytes: int = 24 << 20) -> DataFrame:
    """doc_id, n_shingles, cls (equal sets share it), component_id for every row."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    fragments = max(4, -(-size // fragment_bytes))
    with arrow_rows(spark, SLICE):
        found = table(rows.mapInArrow(released(_emit(fragments)), _EMITTED), "join-emitted", "none")
    own = settled(found.filter("frag = -1").select("doc_id", "cls", "n"), "join-own")
    reps = settled(own.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "join-classes")
    segments = found.filter("frag >= 0")
    links, common, members = None, None, None
    labels = None

    def joined(more: DataFrame) -> None:
        nonlocal links, labels
        links = more if links is None else settled(links.union(more), "join-all-links")
        by = links.join(reps.select(F.col("cls").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("cls").alias("b"), F.col("rep").alias("rb")), "b")
        labels = components(by.select(F.col("ra").alias("a"), F.col("rb").alias("b")))

    for level in range(LEVELS):
        if level:
            only = spark.sparkContext.broadcast(bits_of(members, "rep", members.count()))
            last = spark.sparkContext.broadcast(bits_of(common, "token", common.count()))
            with arrow_rows(spark, SLICE):
                rows = table(rows.mapInArrow(released(_only(only)), "doc_id long, text string"), "join-rows")
            segments = rows.mapInArrow(released(_emit(fragments, last)), _EMITTED).filter("frag >= 0")
        with arrow_rows(spark, SLICE):
            counted = settled(segments.groupBy("frag").applyInArrow(_count, _COUNTED), "join-counted")
        if not level:
            forget(found)  # the n-grams are counted, the sets' sizes are in `own`
        # Beyond the prefix at most ceil(3n/4) - 1 n-grams are left.
        rest = F.greatest(F.floor((3 * F.col("na") + 3) / 4), F.floor((3 * F.col("nb") + 3) / 4)) - 1
        reaches = F.col("o") + rest >= F.floor((3 * (F.col("na") + F.col("nb")) + 6) / 7)
        pairs = counted.filter("kind = 1").groupBy("a", "b").agg(F.sum("o").alias("o"), F.first("na").alias("na"), F.first("nb").alias("nb"))
        held = settled(_longs("held", "cls")(counted.filter("kind = 2")).join(reps, "cls"), "join-held")
        pairs = pairs.filter(reaches).select("a", "b").union(_stars(held))
        joined(verified(rows, reps, settled(pairs.distinct(), "join-pairs")))
        at = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("cls", F.coalesce("comp", "rep").alias("comp"))
        lists = held.join(at, "cls")
        spread = lists.groupBy("list", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("list").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
        lists = settled(_by_list(lists, spread), "join-lists")
        last_level = level == LEVELS - 1
        few = lists if last_level else lists.filter(F.col("k") <= FEW)
        across = settled(_between(few, counted.filter("kind = 1")), "join-across")
        if across.limit(1).count():
            joined(verified(rows, reps, across))
        many = lists.filter(F.col("k") > FEW)
        if last_level or not many.limit(1).count():
            break
        members = settled(many.select("rep").distinct(), "join-members")
        tokens = _longs("tokens", "token")(counted.filter("kind = 2").join(many.select("list").distinct(), "list", "left_semi")).select("token")
        common = settled(tokens if common is None else tokens.union(common), "join-common")

    placed = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("cls", F.coalesce("comp", "rep").alias("component_id"))
    return own.join(placed, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), "cls", F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: of its smallest id, and of rows that share that id the one
    with the smallest hash of its text (then of the whole row).  Rows without words all stay.  Same
    columns.  Rows are told apart by a key of their own, written once, so rows that share an id, or
    have none, are judged one by one."""
    keyed = table(docs.withColumn(_KEY, F.monotonically_increasing_id()), "join-keyed")
    found = join(keyed.select(_KEY, text_col), _KEY, text_col).filter("n_shingles > 0").select(F.col("doc_id").alias(_KEY), F.col("component_id").alias(_COMP))
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(_KEY).alias("row"))
    ranked = found.join(keyed.select(_KEY, id_col, text_col).select(_KEY, order.alias("_order")), _KEY)
    best = ranked.groupBy(_COMP).agg(F.min("_order").alias("best"))  # combines before the shuffle
    single = found.groupBy(_COMP).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(_COMP)
    drop = found.join(single, _COMP, "left_semi").join(best.select(F.col("best.row").alias(_KEY)), _KEY, "left_anti").select(_KEY)
    drop = table(drop, "join-drop")
    out = keyed.join(drop, _KEY, "left_anti").drop(_KEY)
    return out
