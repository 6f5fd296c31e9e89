"""Content-addressed store of token ids.

A gear rolling hash over the ids of a document cuts them into chunks; each distinct chunk is stored
once under its SHA-256, documents are recipes (lists of chunk hashes), and Merkle manifests over the
recipes let a reader verify what it reads.

Layout under `path`:
* `chunks/` (hash, n, data): ids as little-endian unsigned integers of `width` bytes;
* `recipes/` (part, start, doc_id, n_tokens, root, hashes, sizes), `start` being the number of ids of
  all documents before it in ascending id order (null ids first; equal ids by root);
* `manifest/` (part, docs, tokens, root): root = SHA-256 over block roots, one for 1,024 documents.

Defined cases: a null or empty text is its end id alone; texts are encoded whole; repeated rows are
documents of their own that share chunks; an empty table gives an empty store.
"""
from __future__ import annotations

import hashlib
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Shipped, delete, new_path, raw_texts, released, run_hashes, worker_cache

LEAST, MEAN, MOST, WINDOW = 64, 256, 2048, 8
BLOCK = 1024
HOT_PARTS = 64
#: Units that a worker keeps; texts whose units are looked up together; new units encoded together.
CACHE, SLICE, LOT = 2_500_000, 1000, 4000
#: A space between white space: a pre-token may span it.
GLUED = re.compile(r"\s (?:\s|\Z)")
GEAR = np.random.default_rng(20240229).integers(0, 1 << 63, 1 << 16, dtype=np.uint64)


#: Bytes that end a white space character beyond ASCII, and bytes that begin one.
_ENDS, _BEGINS = (0x80, 0x81, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF), (0xC2, 0xE1, 0xE2, 0xE3)


def _glue_tables() -> tuple[np.ndarray, np.ndarray]:
    ends, begins = np.zeros(256, bool), np.zeros(256, bool)
    for t, more in ((ends, _ENDS), (begins, _BEGINS)):
        t[[*range(9, 14), *range(28, 33), *more]] = True
    return ends, begins


class Encoder:
    """ids as `tokenizers` has them, packed.

    Where the file says byte-level without normalisation, what stands between two spaces (with the
    space before it) is encoded alike anywhere: a pre-token never spans a space unless white space
    stands on both sides of it, and texts with such a space are encoded as they are.  So texts are cut
    before every space, and each distinct unit is encoded once, kept under its 64-bit hash and copied
    to where it stands; other files go text by text."""

    def __init__(self, spec: str, width: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.kind = Tokenizer.from_str(spec), np.dtype(f"<u{width}")
        self.tok.encode_special_tokens = True
        file = json.loads(spec)
        pre = file.get("pre_tokenizer") or {}
        self.apart = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not file.get("normalizer")
        vocab = self.tok.get_vocab()
        self.opens = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        self.ends, self.begins = _glue_tables()
        self.clear()

    def clear(self) -> None:
        #: Sorted hashes of the units kept, and their places in `size`; `ids` are all units' ids in order.
        self.names, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.size, self.begin, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(units in the order of their ids, numbers of ids, ids) of the units between `start` and `end`.

        Units of a space and what neither begins nor ends in white space are encoded many at a time:
        each begins with the one token that begins with a space."""
        joint = (raw[start] == 32) & (end - start > 1)
        joint &= ~self.begins[raw[np.minimum(start + 1, len(raw) - 1)]] & ~self.ends[raw[end - 1]]
        at = np.flatnonzero(joint)
        size = end[at] - start[at]
        upto = np.cumsum(size)
        if len(at):
            text = raw[np.repeat(start[at] - (upto - size), size) + np.arange(int(upto[-1]))].tobytes()
        groups = [(x, min(x + LOT, len(at))) for x in range(0, len(at), LOT)]
        cut = lambda x: int(upto[x - 1]) if x else 0
        order, sizes, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, self.kind)]
        alone = np.flatnonzero(~joint).tolist()
        for (x, y), e in zip(groups, self.tok.encode_batch_fast([text[cut(x) : cut(y)].decode() for x, y in groups], add_special_tokens=False) if groups else ()):
            own = np.array(e.ids, self.kind)
            first = np.flatnonzero(self.opens[own])
            if len(first) == y - x:
                order.append(at[x:y])
                sizes.append(np.diff(np.append(first, len(own))))
                ids.append(own)
            else:
                alone += at[x:y].tolist()
        found = self._plain([raw[start[i] : end[i]].tobytes().decode() for i in alone])
        order.append(np.array(alone, np.int64))
        sizes.append(np.array([len(x) for x in found], np.int32))
        return np.concatenate(order), np.concatenate(sizes), np.concatenate([*ids, *found])

    def _look(self, raw: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The place of every unit in the cache; new ones are encoded first."""
        h = run_hashes(raw, start)
        order = np.argsort(h)
        sorted_ = h[order]
        new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
        names, first = sorted_[new], order[new]
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            place = np.where(self.names[at] == names, self.place[at], -1)
        else:
            at, place = np.zeros(len(names), np.int64), np.full(len(names), -1)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            x = start[first[missing]]
            y = np.append(start, len(raw))[first[missing] + 1]
            by, sizes, ids = self._units(raw, x, y)
            place[missing[by]] = np.arange(len(self.size), len(self.size) + len(by))
            self.begin = np.concatenate((self.begin, len(self.ids) + np.cumsum(sizes, dtype=np.int64) - sizes))
            self.size, self.ids = np.concatenate((self.size, sizes.astype(np.int32))), np.concatenate((self.ids, ids))
            into = np.searchsorted(self.names, names[missing])
            self.names, self.place = np.insert(self.names, into, names[missing]), np.insert(self.place, into, place[missing].astype(np.int32))
        out = np.empty(len(h), np.int64)
        out[order] = place[np.cumsum(new) - 1]
        return out

    def _glued(self, raw: np.ndarray, spaces: np.ndarray, at: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Which texts have a space between white space.  Bytes tell where to look, the text itself decides."""
        of = np.searchsorted(at, spaces, "right") - 1
        last = spaces + 1 == at[of + 1]
        left = (spaces > at[of]) & self.ends[raw[spaces - 1]]
        right = last | self.begins[raw[np.minimum(spaces + 1, len(raw) - 1)]]
        out = np.zeros(len(texts), bool)
        for i in np.unique(of[left & right]).tolist():
            out[i] = GLUED.search(texts[i].as_py()) is not None
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); null texts have none."""
        if not self.apart:
            found = self._plain([t or "" for t in texts.to_pylist()])
            return np.concatenate([np.zeros(0, self.kind), *found]), np.array([len(x) for x in found], np.int64)
        if len(self.names) > CACHE:
            self.clear()
        raw, at = raw_texts(texts)
        if not len(raw):
            return np.zeros(0, self.kind), np.zeros(len(texts), np.int64)
        spaces = np.flatnonzero(raw == 32)
        whole = self._glued(raw, spaces, at, texts) if len(spaces) else np.zeros(len(texts), bool)
        begins = raw == 32
        begins[at[:-1][np.diff(at) > 0]] = True
        start = np.flatnonzero(begins)
        place = self._look(raw, start)
        size = self.size[place].astype(np.int64)
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(self.begin[place] - (upto - size), size) + np.arange(int(upto[-1]))]
        bounds = np.concatenate(([0], upto))[np.searchsorted(start, at)]
        if whole.any():
            which = np.flatnonzero(whole).tolist()
            own = dict(zip(which, self._plain([texts[i].as_py() for i in which])))
            parts = [own[i] if i in own else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
            return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, np.diff(bounds)


def encoder(spec: Shipped, width: int) -> Encoder:
    kept, key = worker_cache(), ("store", spec.key, width)
    if key not in kept:
        kept[key] = Encoder(spec.data.decode(), width)
    return kept[key]


def cuts(ids: np.ndarray, ends: list[int]) -> list[list[int]]:
    """Ends of the chunks of documents that end at `ends` of `ids`: where a rolling hash of WINDOW ids
    is 0 modulo MEAN, LEAST to MOST ids apart.  LEAST > WINDOW, so no hash that counts has seen a
    neighbouring document or chunk."""
    g, h = GEAR[ids & 0xFFFF], np.zeros(len(ids), np.uint64)
    for k in range(WINDOW):
        h[k:] += g[: len(g) - k] << np.uint64(k)
    marks = (np.flatnonzero(h >> np.uint64(24) & np.uint64(MEAN - 1) == 0) + 1).tolist()
    out, at, begin = [], 0, 0
    for end in ends:
        own, last = [], begin
        while at < len(marks) and marks[at] <= begin:
            at += 1
        while at < len(marks) and marks[at] < end:
            m = marks[at]
            at += 1
            while m - last > MOST:
                last += MOST
                own.append(last)
            if m - last >= LEAST:
                own.append(m)
                last = m
        while end - last > MOST:
            last += MOST
            own.append(last)
        own.append(end)
        out.append(own)
        begin = end
    return out


def _chunked(spec: Shipped, end_id: int, width: int):
    def run(batches):
        own = encoder(spec, width)
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                ids, tokens = own(part.column(1))
                ids = np.insert(ids, np.cumsum(tokens), end_id).astype(own.kind)
                tokens = tokens + 1
                ends = np.cumsum(tokens).tolist()
                raw = ids.tobytes()
                found, begin = cuts(ids, ends), 0
                roots, hashes, sizes, data = [], [], [], []
                for end, cut in zip(ends, found):
                    at = [begin, *cut]
                    pieces = [raw[x * width : y * width] for x, y in zip(at, at[1:])]
                    hs = [hashlib.sha256(c).digest()[:16] for c in pieces]
                    roots.append(root_of(hs))
                    hashes.append(hs)
                    sizes.append([y - x for x, y in zip(at, at[1:])])
                    data.append(pieces)
                    begin = end
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens, pa.int64()), pa.array(roots, pa.binary()), pa.array(hashes, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int32())), pa.array(data, pa.list_(pa.binary()))], names=["doc_id", "n_tokens", "root", "hashes", "sizes", "data"])

    return run


def root_of(hashes: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(hashes)).digest()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, appends end_id and writes the store.  Ids must fit `width` bytes."""
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("root", T.BinaryType()), T.StructField("hashes", T.ArrayType(T.BinaryType())), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(T.BinaryType()))])
    staged = f"{path}/staged"
    docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(released(_chunked(Shipped(spark, tokenizer), end_id, width)), schema).write.option("compression", "zstd").parquet(staged)
    got = spark.read.schema(schema).parquet(staged)
    chunks = got.select(F.explode(F.arrays_zip("hashes", "sizes", "data")).alias("c")).select(F.col("c.hashes").alias("hash"), F.col("c.sizes").alias("n"), F.col("c.data").alias("data"))
    chunks.dropDuplicates(["hash"]).write.option("compression", "zstd").parquet(f"{path}/chunks")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    recipe = got.select("doc_id", "n_tokens", "root", "hashes", "sizes").repartitionByRange(parts, "doc_id", "root").withColumn("part", F.spark_partition_id())
    ranged = f"{path}/ranged"
    recipe.write.option("compression", "zstd").parquet(ranged)
    recipe = spark.read.schema(recipe.schema).parquet(ranged)
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a part
    base = recipe.groupBy("part").agg(F.sum("n_tokens").alias("tokens")).select("part", F.coalesce(before, F.lit(0)).alias("base"))
    along = Window.partitionBy("part").orderBy("doc_id", "root").rowsBetween(Window.unboundedPreceding, 0)
    placed = recipe.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.sum("n_tokens").over(along) - F.col("n_tokens"))
    placed.select("part", "start", "doc_id", "n_tokens", "root", "hashes", "sizes").write.option("compression", "zstd").parquet(f"{path}/recipes")
    _manifest(recipes(spark, path)).write.parquet(f"{path}/manifest")
    for old in (staged, ranged):
        delete(spark, old)


def recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/recipes")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/chunks")


def _manifest(found: DataFrame) -> DataFrame:
    def over(col):
        return F.unhex(F.sha2(F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("at", col))), lambda x: x[col]), F.lit(b""), lambda a, x: F.concat(a, x)), 256))

    row = F.row_number().over(Window.partitionBy("part").orderBy("start")) - 1
    blocks = found.select("part", "n_tokens", "root", row.alias("at")).groupBy("part", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"), over("root").alias("root"))
    return blocks.withColumnRenamed("block", "at").groupBy("part").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), over("root").alias("root"))


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Parts whose manifest doesn't follow from the recipes' own hashes: no rows if the store is whole."""
    own = F.unhex(F.sha2(F.aggregate("hashes", F.lit(b""), lambda a, x: F.concat(a, x)), 256))
    now = _manifest(recipes(spark, path).withColumn("root", own)).select("part", F.col("root").alias("now"))
    return spark.read.parquet(f"{path}/manifest").join(now, "part", "full").filter(~F.col("root").eqNullSafe(F.col("now")))


_POLY = 0xEDB88320


def _advance() -> np.ndarray:
    """[n, bit]: what a CRC with that bit alone becomes after 4 n zero bytes, for n up to MOST."""
    def zero_byte(x: np.ndarray) -> np.ndarray:
        for _ in range(8):
            x = np.where(x & 1, x >> 1 ^ _POLY, x >> 1).astype(np.uint32)
        return x

    out = np.empty((MOST + 1, 32), np.uint32)
    out[0] = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for n in range(1, MOST + 1):
        x = out[n - 1]
        for _ in range(4):
            x = zero_byte(x)
        out[n] = x
    return out


def combine(crcs: list[list[int]], sizes: list[list[int]]) -> np.ndarray:
    """The CRC-32 of concatenated parts, from the parts' own CRCs and lengths in 32-bit words."""
    kept = worker_cache()
    if "advance" not in kept:
        kept["advance"] = _advance()
    table, total = kept["advance"], np.zeros(len(crcs), np.uint32)
    longest = max(map(len, crcs), default=0)
    order = np.argsort([-len(c) for c in crcs], kind="stable")
    length = np.array([len(crcs[i]) for i in order])
    for j in range(longest):
        live = order[: int((length > j).sum())]
        c = np.array([crcs[i][j] for i in live], np.uint32)
        step, x, y = table[np.array([sizes[i][j] for i in live])], total[live], np.zeros(len(live), np.uint32)
        for bit in range(32):
            y ^= np.where(x >> np.uint32(bit) & 1, step[:, bit], 0).astype(np.uint32)
        total[live] = y ^ c
    return total


def digests(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: every stored chunk is read, held against its
    hash and summed; each document's chunks are held against the root of its recipe, and its sum
    follows from theirs (sums of parts combine).  Damage raises.

    A chunk that a thousandth of all references name is one of at most a thousand: their references are
    spread over HOT_PARTS keys each."""
    kind = np.dtype(f"<u{width}")

    def sums(batches):
        for b in batches:
            out = []
            for h, n, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if hashlib.sha256(d).digest()[:16] != h or len(d) != n * width:
                    raise ValueError(f"chunk {h.hex()} is damaged")
                out.append(zlib.crc32(np.frombuffer(d, kind).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["hash", "crc"])

    def whole(batches):
        for b in batches:
            parts = b.column(4).to_pylist()
            for root, ps in zip(b.column(3).to_pylist(), parts):
                if root_of([p["hash"] for p in ps]) != root:
                    raise ValueError(f"the recipe with root {root.hex()} is damaged")
            crc = combine([[p["crc"] for p in ps] for ps in parts], [[p["n"] for p in ps] for ps in parts])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc.astype(np.int64), pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    found = recipes(spark, path)
    refs = found.select("start", "doc_id", "n_tokens", "root", F.posexplode(F.arrays_zip("hashes", "sizes")).alias("pos", "c")).select("start", "doc_id", "n_tokens", "root", "pos", F.col("c.hashes").alias("hash"), F.col("c.sizes").alias("n"))
    total = found.agg(F.sum(F.size("hashes"))).first()[0] or 0
    hot = [bytes(r.hash) for r in found.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(f"n > {max(total // 1000, 10_000)}").collect()]  # at most a thousand
    is_hot = F.col("hash").isin(hot) if hot else F.lit(False)
    stored = chunks(spark, path).select("hash", "n", "data").mapInArrow(sums, "hash binary, crc long")
    stored = stored.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))))
    refs = refs.withColumn("salt", F.when(is_hot, F.pmod("start", F.lit(HOT_PARTS)).cast("int")).otherwise(0))
    joined = refs.join(stored, ["hash", "salt"], "left").select("start", "doc_id", "n_tokens", "root", F.struct("pos", "n", F.coalesce(F.col("crc"), F.raise_error(F.lit("a chunk is missing")).cast("long")).alias("crc"), "hash").alias("p"))
    docs = joined.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.array_sort(F.collect_list("p")).alias("parts"))
    schema = T.StructType([found.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    return docs.select("doc_id", "start", "n_tokens", "root", "parts").mapInArrow(whole, schema)


def read(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, ids (array of int): the documents rebuilt from recipes and chunks."""
    kind = np.dtype(f"<u{width}")

    def unpack(batches):
        for b in batches:
            ids = [np.frombuffer(b"".join(p["data"] for p in ps), kind).astype(np.int32) for ps in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    found = recipes(spark, path)
    refs = found.select("start", "doc_id", F.posexplode("hashes").alias("pos", "hash"))
    rows = refs.join(chunks(spark, path).select("hash", "data"), "hash").groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("pos", "data"))).alias("parts"))
    return rows.select("doc_id", "start", "parts").mapInArrow(unpack, T.StructType([found.schema["doc_id"], T.StructField("start", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def build(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes a store in the shared folder, holds its recipes against the manifests, and returns what
    `digests` reads from it."""
    spark = docs.sparkSession
    path = new_path(spark, "token-store")
    write(docs, path, tokenizer)
    if verify(spark, path).limit(1).count():
        raise ValueError("the store's recipes don't follow from its manifests")
    return digests(spark, path)
