"""Byte-level BPE encoding and decoding.

Every text is cut by the tokenizer's split pattern in the JVM, and a block of texts (a bounded number of bytes of one partition)
is written to the shared folder as indices into the block's *distinct* words.  Words come as arrays of byte ranks, and Spark higher-order functions fold
the ranked merges over those arrays; the rank map is a literal, a two-choice hash table over adjacent pairs.  Long words are
folded in overlapping parts by the same fold.  Words that several blocks hold are counted over the whole corpus and folded once;
the most common of them, up to a fixed number, are broadcast with their ids, and each block folds only what is left.  The texts
themselves are never shuffled, so one hot text or word costs as little as any other, and a lost executor loses only the blocks it
worked on.  Decoding concatenates the binary pieces of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, only, stored, tune

#: Bytes of words (with their offsets) after which a block is closed.
BLOCK_BYTES = 24 << 20
#: Words in one row for the fold.
ROW_WORDS = 10_000
#: Words folded for the whole corpus at once and broadcast with their ids, at most; all others are folded where they occur.
COMMON = 1_000_000
#: Bytes of a word that are folded at once; longer words are folded in parts that overlap by half.
PART = 512
NONE = 65535
SLOTS = 1 << 19
C1, C2 = 1_640_531_527, 805_459_861


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """left * 65536 + right -> rank, for each two pieces that join to a piece."""
    return {ranks[w[:i]] * 65536 + ranks[w[i:]]: r for w, r in ranks.items() for i in range(1, len(w)) if w[:i] in ranks and w[i:] in ranks}


def slot(code: int, factor: int) -> int:
    return (code * factor >> 12) & (SLOTS - 1)


def two_choice_table(pairs: dict[int, int]) -> list[int]:
    """Each pair sits in one of its two slots (cuckoo hashing), as code * 65536 + rank; -1 marks an empty slot."""
    table = [-1] * SLOTS
    for code, rank in pairs.items():
        entry, at = code * 65536 + rank, slot(code, C1)
        for _ in range(500):
            entry, table[at] = table[at], entry
            if entry < 0:
                break
            own = entry >> 16
            at = slot(own, C2) if at == slot(own, C1) else slot(own, C1)
        else:
            raise ValueError("the rank table is too full")
    return table


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def folded(word: Column, table: Column) -> Column:
    """Merge the array of ranks ``word``: again and again the adjacent pair of lowest rank, the leftmost of equals.

    The state is one array of longs, rank of the pair that begins here << 32 | byte << 16 | rank of the piece, so the least
    entry is the pair to merge, and a merge replaces up to three entries by up to two.
    """
    low = lambda x: x.bitwiseAND(F.lit(65535))

    def probe(code: Column) -> Column:
        at = lambda c, f: F.element_at(table, (F.shiftright(c * F.lit(f), 12).bitwiseAND(F.lit(SLOTS - 1)) + 1).cast("int"))
        hit = lambda c, f: F.shiftright(at(c, f), 16) == c
        return _let(code, lambda c: F.when(hit(c, C1), low(at(c, C1))).when(hit(c, C2), low(at(c, C2))).otherwise(F.lit(NONE)))

    def entry(rank: Column, place: Column, piece: Column) -> Column:
        return F.shiftleft(rank, 32) + place * 65536 + piece

    def step(e: Column, _: Column) -> Column:
        def merge(x: Column) -> Column:
            new = F.shiftright(x["m"], 32)
            after, before = F.get(e, x["j"] + 1), F.get(e, x["j"] - 2)
            merged = entry(F.coalesce(probe(new * 65536 + low(after)), F.lit(NONE)), low(F.shiftright(x["m"], 16)), new)
            left = entry(probe(low(before) * 65536 + new), low(F.shiftright(before, 16)), low(before))
            middle = F.when(x["j"] > 1, F.array(left, merged)).otherwise(F.array(merged))
            return F.concat(F.slice(e, 1, F.greatest(x["j"] - 2, F.lit(0))), middle, F.slice(e, x["j"] + 2, F.size(e)))

        found = lambda m: F.when(F.shiftright(m, 32) == NONE, e).otherwise(_let(F.struct(m.alias("m"), F.array_position(e, m).cast("int").alias("j")), merge))
        return _let(F.array_min(e), found)

    n = F.size(word)
    first = F.zip_with(word, F.slice(word, 2, n), lambda a, b: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")))
    state = F.transform(first, lambda x, i: entry(F.coalesce(probe(x["a"] * 65536 + x["b"]), F.lit(NONE)), i.cast("long"), x["a"]))
    return F.when(n < 2, word).otherwise(F.transform(F.aggregate(F.sequence(F.lit(2), n), state, step), lambda x: low(x).cast("int")))


def encoded(word: Column, table: Column, lens: Column, part: int = PART) -> Column:
    """``folded``, but words of more than ``part`` bytes in parts: a part begins where a token about the middle of the last began.

    Tokens are right as a whole if each two neighbours are what the fold makes of their bytes.  Within a part they are; where a
    part follows, its first token has to be the one that the last part has there, which is checked.  Were it another, the word is
    folded as a whole.
    """
    n, half = F.size(word), part // 2
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"), F.lit(-1).alias("next"), F.lit(True).alias("ok"))
    none = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("k"), F.lit(0).alias("used"))

    def counted(a: Column, x: Column) -> Column:
        upto = a["upto"] + F.element_at(lens, x + 1)
        fits = upto <= half
        return F.struct(upto.alias("upto"), F.when(fits, a["k"] + 1).otherwise(a["k"]).alias("k"), F.when(fits, upto).otherwise(a["used"]).alias("used"))

    def step(s: Column, _: Column) -> Column:
        def more(ids: Column) -> Column:
            ok = s["ok"] & ((s["next"] < 0) | (s["next"] == ids[0]))
            last = F.struct(n.alias("at"), F.concat(s["out"], ids).alias("out"), F.lit(-1).alias("next"), ok.alias("ok"))
            part_of = lambda u: F.struct((s["at"] + u["used"]).alias("at"), F.concat(s["out"], F.slice(ids, 1, u["k"])).alias("out"), F.get(ids, u["k"]).alias("next"), ok.alias("ok"))
            return F.when(s["at"] + part >= n, last).otherwise(_let(F.aggregate(ids, none, counted), part_of))

        return F.when(s["at"] >= n, s).otherwise(_let(folded(F.slice(word, s["at"] + 1, part), table), more))

    # Each part but the last moves on by a quarter of its bytes at least.
    parts = _let(F.aggregate(F.sequence(F.lit(0), F.ceil(n / (part // 4)).cast("int")), zero, step), lambda s: F.when(s["ok"], s["out"]).otherwise(folded(word, table)))
    return F.when(n <= part, folded(word, table)).otherwise(parts)


def with_ids(df: DataFrame, ranks_path: str, words: str = "words") -> DataFrame:
    """``df`` with its column ``words``, array<array<int>> with the byte ranks of words, turned to the ids of each word.

    The rank map and the lengths of the pieces are literal arrays in a relation of one row, read once for a query as scalar
    subqueries, so that the tasks get them ready to be read.  As literals in the fold's own expression the optimizer would
    compare, hash and print them all the time.
    """
    ranks = load_ranks(ranks_path)
    lens = np.zeros(max(ranks.values()) + 1, dtype=np.int32)
    for w, r in ranks.items():
        lens[r] = len(w)
    once = lambda x: df.sparkSession.createDataFrame(pa.table({"x": pa.array([x], pa.list_(pa.from_numpy_dtype(x.dtype)))})).scalar()
    each = F.transform(words, lambda w: encoded(w, F.col("_ranks"), F.col("_lens"), max(PART, 4 * int(lens.max()))))
    read = df.withColumns({"_ranks": once(np.array(two_choice_table(pair_ranks(ranks)))), "_lens": once(lens)})
    return read.withColumn(words, each).drop("_ranks", "_lens")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to blocks."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


@lru_cache(maxsize=4)
def _pieces(ranks_path: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All pieces with their ranks, and the ranks of the single bytes."""
    ranks = load_ranks(ranks_path)
    return pa.array(list(ranks), pa.binary()), np.fromiter(ranks.values(), np.int32, len(ranks)), np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)


def _byte_ranks(words: pa.Array, single: np.ndarray) -> pa.ListArray:
    """Binary words as arrays of the ranks of their bytes."""
    starts = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], dtype=np.uint8)[starts[0] : starts[-1]] if len(words) and starts[-1] > starts[0] else np.empty(0, np.uint8)
    return pa.ListArray.from_arrays(pa.array(starts - starts[0]), pa.array(single[raw]))


def _row(values: pa.Array) -> pa.ListArray:
    """One row with all ``values``."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _pack(x: np.ndarray) -> bytes:
    """The bytes of an array, compressed, after their number."""
    raw = x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(x: pa.Scalar, kind) -> np.ndarray:
    data = x.as_buffer()
    return np.frombuffer(pa.decompress(data.slice(8), int.from_bytes(data.slice(0, 8).to_pybytes(), "little"), codec="zstd"), dtype=kind)


def _words(batch: pa.RecordBatch, i: int) -> pa.Array:
    """The distinct words of the i-th block."""
    lens, body = _unpack(batch.column("sizes")[i], np.int32), _unpack(batch.column("words")[i], np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.py_buffer(body)])


def _cut(n_keys: int):
    """Texts as lists of words -> blocks: keys, words a text, the place of each word among the distinct ones, and those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _grouped(batches):
            lists = _one(block.column("words"))
            counts = np.diff(lists.offsets.to_numpy()).astype(np.int32)
            coded = lists.flatten().dictionary_encode()
            words = coded.dictionary.cast(pa.binary())
            starts = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
            body = np.frombuffer(words.buffers()[2], dtype=np.uint8)[starts[0] : starts[-1]] if starts[-1] > starts[0] else np.empty(0, np.uint8)
            keys = pa.StructArray.from_arrays([_one(block.column(f"k{i}")) for i in range(n_keys)], [f"k{i}" for i in range(n_keys)])
            binary = [pa.array([_pack(x)], pa.binary()) for x in (counts, coded.indices.to_numpy().astype(np.int32), np.diff(starts), body)]
            yield pa.RecordBatch.from_arrays([_row(keys), *binary], ["keys", "counts", "indices", "sizes", "words"])

    return run


def _distinct(ranks_path: str):
    """Blocks -> their distinct words that are no pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, _, _ = _pieces(ranks_path)
        for batch in batches:
            for i in range(batch.num_rows):
                words = _words(batch, i)
                words = words.filter(pc.is_null(pc.index_in(words, value_set=pieces)))
                for a in range(0, len(words), 100_000):
                    yield pa.RecordBatch.from_arrays([words.slice(a, 100_000)], ["word"])

    return run


def _packed(ranks_path: str):
    """Words -> rows of many words and of their byte ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, single = _pieces(ranks_path)
        for batch in batches:
            words = batch.column("word")
            yield pa.RecordBatch.from_arrays([_row(words), _row(_byte_ranks(words, single))], ["raw", "words"])

    return run


def common_words(blocks: DataFrame, ranks_path: str, most: int = COMMON) -> tuple[pa.Array, pa.ListArray]:
    """Words that more than one of ``blocks`` hold, the most frequent first, and their ids; at most ``most``.

    They are only there to save work: a word that is not among them is folded where it occurs.
    """
    often = stored(blocks.select("sizes", "words").mapInArrow(lean(_distinct(ranks_path)), "word binary").groupBy("word").agg(F.count("*").alias("n")).where("n > 1"))
    level = F.floor(8 * F.log2("n")).cast("int")
    total, least = 0, None
    for r in sorted(often.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        if total + r["count"] > most:
            break
        total, least = total + r["count"], r["level"]
    if least is None:
        discard(often)
        return pa.array([], pa.binary()), pa.array([], pa.list_(pa.int32()))
    rows = often.where(level >= least).select("word").repartition(-(-total // ROW_WORDS), "word").mapInArrow(lean(_packed(ranks_path)), "raw array<binary>, words array<array<int>>")
    got = with_ids(rows, ranks_path).toArrow().combine_chunks()
    discard(often)
    return _one(got.column("raw")).flatten().cast(pa.binary()), _one(got.column("words")).flatten().cast(pa.list_(pa.int32()))


def _todo(ranks_path: str, known):
    """Blocks -> rows of words still to be folded, then the block's row with the ids of those that are known."""
    names = ["words", "keys", "counts", "indices", "lens", "given"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, piece_ranks, single = _pieces(ranks_path)
        common = pa.ipc.open_stream(known.value).read_all().combine_chunks()
        common_words, common_ids = _one(common.column("word")), _one(common.column("ids"))
        common_at, common_flat = common_ids.offsets.to_numpy(), common_ids.values.to_numpy()
        common_lens = np.diff(common_at) if len(common_words) else np.zeros(1, np.int32)
        for batch in batches:
            for i in range(batch.num_rows):
                words = _words(batch, i)
                piece = pc.index_in(words, value_set=pieces).fill_null(-1).to_numpy()
                own = pc.index_in(words, value_set=common_words).fill_null(-1).to_numpy() if len(common_words) else np.full(len(words), -1)
                own = np.where(piece >= 0, -1, own)
                lens = np.where(piece >= 0, 1, np.where(own >= 0, common_lens[own], 0)).astype(np.int32)
                at = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
                given = np.empty(at[-1], dtype=np.int32)
                given[at[:-1][piece >= 0]] = piece_ranks[piece[piece >= 0]]
                mine = own[own >= 0]
                if len(mine):
                    n = common_lens[mine]
                    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    given[np.repeat(at[:-1][own >= 0], n) + inside] = common_flat[np.repeat(common_at[mine], n) + inside]
                left = words.filter(pa.array(lens == 0))
                keys = batch.column("keys")
                for a in range(0, len(left), ROW_WORDS):
                    part = _row(_byte_ranks(left.slice(a, ROW_WORDS), single))
                    yield pa.RecordBatch.from_arrays([part, pa.nulls(1, keys.type), *(pa.nulls(1, pa.binary()) for _ in range(4))], names)
                none = pa.array([[]], pa.list_(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([none, keys.slice(i, 1), batch.column("counts").slice(i, 1), batch.column("indices").slice(i, 1), *(pa.array([_pack(x)], pa.binary()) for x in (lens, given))], names)

    return run


def _assembled(n_keys: int, rows, names: list[str]):
    """Rows of folded words, each group followed by its block's row -> what ``rows`` makes of each slice of texts' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folded_lens, folded_ids = [], []
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column("words").slice(i, 1).flatten()
                folded_lens.append(np.diff(words.offsets.to_numpy()))
                folded_ids.append(words.flatten().to_numpy())
                if not batch.column("keys")[i].is_valid:
                    continue
                keys = batch.column("keys").slice(i, 1).flatten()
                counts, index, lens, given = (_unpack(batch.column(c)[i], np.int32) for c in ("counts", "indices", "lens", "given"))
                # Words stand by their first place; those already known and those folded fill the gaps of each other.
                new = lens == 0
                lens = lens.astype(np.int64)
                lens[new] = np.concatenate(folded_lens)
                at = np.concatenate([[0], np.cumsum(lens)])
                values = np.empty(at[-1], dtype=np.int32)
                fresh = np.repeat(new, lens)
                values[fresh], values[~fresh] = np.concatenate(folded_ids), given
                folded_lens, folded_ids = [], []
                step = max(1, int(len(counts) * 500_000 // max(1, len(index))))
                ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                for a in range(0, len(counts), step):
                    b = min(len(counts), a + step)
                    own = index[ends[a] : ends[b]]
                    n = lens[own]
                    upto = np.concatenate([[0], np.cumsum(n)])
                    ids = values[np.repeat(at[own] - upto[:-1], n) + np.arange(upto[-1])] if len(own) else values[:0]
                    cut = upto[ends[a : b + 1] - ends[a]].astype(np.int32)
                    part = keys.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*(part.field(k) for k in range(n_keys)), *rows(ids, cut)], [*(f"k{k}" for k in range(n_keys)), *names])

    return run


def _encoded(df: DataFrame, ranks_path: str, pattern: str, text: str, keys: tuple[str, ...], rows, kinds: dict[str, str]) -> DataFrame:
    spark = df.sparkSession
    tune(spark)
    names = {f"k{i}": k for i, k in enumerate(keys)}
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit("(?U)" + pattern), F.lit(0))
    source = only(df, **{text: "text"} | {old: k for k, old in names.items()}).select(*names, words.alias("words"))
    of_keys = ", ".join(f"{k}: {source.schema[k].dataType.simpleString()}" for k in names)
    blocks = stored(source.mapInArrow(lean(_cut(len(keys))), f"keys array<struct<{of_keys}>>, counts binary, indices binary, sizes binary, words binary"))
    common = pa.table(common_words(blocks, ranks_path), ["word", "ids"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, common.schema) as writer:
        writer.write_table(common)
    known = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    todo = blocks.mapInArrow(lean(_todo(ranks_path, known)), f"words array<array<int>>, keys array<struct<{of_keys}>>, counts binary, indices binary, lens binary, given binary")
    out = ", ".join([*(f"{k} {source.schema[k].dataType.simpleString()}" for k in names), *(f"{c} {kind}" for c, kind in kinds.items())])
    merged = with_ids(todo, ranks_path).mapInArrow(lean(_assembled(len(keys), rows, list(kinds))), out)
    return merged.select(*(F.col(k).alias(old) for k, old in names.items()), *kinds)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``df``: its ``keys`` and ``ids``, the array of token ids of its whole text.

    ``pattern`` splits the text; every match is encoded separately, without special tokens.  Null and empty texts give an
    empty array, repeated rows one result each, an empty table no rows; keys may be null.  Only ``keys`` and ``text`` are read, so
    further columns, whatever their names, do no harm.  Words may be of any length.  ``ranks_path`` is a file on every machine
    (part of the installed library).
    """
    return _encoded(df, ranks_path, pattern, text, keys, lambda ids, cut: [pa.ListArray.from_arrays(pa.array(cut), pa.array(ids))], {"ids": "array<int>"})


@lru_cache(maxsize=4)
def pieces(ranks_path: str) -> np.ndarray:
    """The binary piece of each id."""
    ranks = load_ranks(ranks_path)
    out = np.full(max(ranks.values()) + 1, b"", dtype=object)
    for w, r in ranks.items():
        out[r] = w
    return out


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out`` (replaced if it was there): the concatenated binary pieces of ``ids``.  A null array gives null, an
    empty one no bytes; an id that is none fails."""
    tune(df.sparkSession)

    @F.pandas_udf("binary")
    def joined(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = pieces(ranks_path)
        one = lambda x: None if x is None else b"".join(own[np.asarray(x, dtype=np.int64)])
        yield from lean(lambda parts: (c.map(one) for c in parts))(columns)

    return df.withColumn(out, joined(F.col(f"`{ids}`")))


def digests(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_tokens``, and the SHA-256 of the decimal ids and of the bytes that they decode to; rows as for ``encode``."""

    def rows(ids: np.ndarray, cut: np.ndarray) -> list[pa.Array]:
        own = pieces(ranks_path)
        decimal = np.array([str(i).encode() for i in range(len(own))], dtype=object)
        each = [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        told = [hashlib.sha256(b" ".join(decimal[x])).hexdigest() for x in each]
        back = [hashlib.sha256(b"".join(own[x])).hexdigest() for x in each]
        return [pa.array(np.diff(cut).astype(np.int64)), pa.array(told, pa.string()), pa.array(back, pa.string())]

    return _encoded(df, ranks_path, pattern, text, (key,), rows, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})
