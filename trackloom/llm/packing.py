"""Best-fit packing of tokenised documents by the sum-of-squares rule.

A document becomes its token ids and an end id; only one longer than a sequence is cut, into pieces of full
length and a rest. Pieces are placed longest first, each where the sum over all residual gaps of the squared
number of open sequences with that gap becomes smallest (ties: the smallest gap that remains). The rule needs
only the counts per gap, so a step costs one pass over at most `capacity` numbers.

Pieces are dealt by a hash into blocks of about `block` and packed a block at a time, in parallel. Sequences
that a block leaves with more than 1/`slack` of their room open are dissolved and packed again with those of the other
blocks, until one block is left or a round needs no fewer sequences for its pieces than they had; then they stay where
they were. After a round that settles less than half of its pieces, blocks are twice as large, up to `LARGEST`. Only lengths
and ids travel, never texts. The tokenised table is written first, so a lost executor repeats no tokenising.

Tokenising is memoised: the vocabulary's pre-tokeniser never joins across ASCII white space, so a text's ids are
those of its words in order, and most words repeat. Arrow splits `SLICE` texts at once and numbers their distinct words; only the letters and
the marks of these go further, and only what the library must encode becomes Python objects. The ids of at most some `MEMO` parts of words are kept from slice to slice,
those that are met again: beyond twice that the others go. Parts longer than `LONG` bytes are left to the library and not kept.

Defined results: null text counts as empty, an empty text is the end id alone; repeated rows are packed as often
as they occur; an empty table gives an empty result; extra columns are ignored. Where a piece goes depends on
hashes of its row's place in the table; the number of sequences hardly does.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm._common import materialize
from trackloom.llm.bpe import WordMerges, runs

CAPACITY, END_ID, BLOCK, SLACK, MEMO, SLICE, LONG = 4096, 1, 4096, 64, 100_000, 1024, 64
#: Pieces that the largest blocks have on average, and the bits that a sequence id has for the sequences of one.
LARGEST, BIN_BITS = 65_536, 20

#: A word that is letters, then marks: its ids are those of the lower-case letters and of the marks.
_SIMPLE = r"\A(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)\z"


def _numpy(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False)


class Memo:
    """Ids of the words of texts, by a tokenizers file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = WordMerges(path)
        self.parts, self.met = pa.array([], pa.string()), np.empty(0, bool)
        self.flat, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _encode(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(parts.to_pylist(), add_special_tokens=False)]
        sizes = np.array(list(map(len, ids)), np.int64)
        return np.fromiter((x for e in ids for x in e), np.int32, sizes.sum()), sizes

    def _merge(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(parts):
            return self.merges.flat(np.empty(0, np.uint8), np.empty(0, np.int64))
        _, begins, data = parts.buffers()
        ends = np.frombuffer(begins, np.int32)[parts.offset : parts.offset + len(parts) + 1].astype(np.int64)
        return self.merges.flat(np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], np.diff(ends))

    def _forget(self) -> None:
        keep = np.flatnonzero(self.met)[-MEMO:]
        self.flat, self.sizes = runs(self.flat, self.starts[keep], self.sizes[keep]), self.sizes[keep]
        self.starts, self.parts, self.met = np.cumsum(self.sizes) - self.sizes, self.parts.take(pa.array(keep)), np.zeros(len(keep), bool)

    def _find(self, parts: pa.Array, letters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts, the first `letters` of which are letters only: all in one, where those of each part begin and how many they are."""
        if len(self.parts) > 2 * MEMO:
            self._forget()
        at = pc.index_in(parts, value_set=self.parts)
        new, short = _numpy(at.is_null()), _numpy(pc.binary_length(parts)) <= LONG
        known, merged = _numpy(at.drop_null()), np.arange(len(parts)) < letters
        self.met[known] = True
        starts, sizes = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        starts[~new], sizes[~new] = self.starts[known], self.sizes[known]
        flat, kept = self.flat, new & short
        for some, encode in ((kept & merged, self._merge), (kept & ~merged, self._encode), (new & ~short, self._encode)):
            ids, n = encode(parts.filter(pa.array(some)))
            starts[some], sizes[some] = len(flat) + np.cumsum(n) - n, n
            flat = np.concatenate([flat, ids])
        self.flat = flat[: len(flat) - len(ids)]  # the long ones came last
        self.parts, self.met = pa.concat_arrays([self.parts, parts.filter(pa.array(kept))]), np.append(self.met, np.zeros(kept.sum(), bool))
        self.starts, self.sizes = np.append(self.starts, starts[kept]), np.append(self.sizes, sizes[kept])
        return flat, starts, sizes

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that differ, one word's after the other's, and how many each has."""
        split = pc.extract_regex(words, _SIMPLE)
        simple, (letters, marks) = _numpy(split.is_valid()), (part.drop_null() for part in split.flatten())
        letters, marks, whole = pc.utf8_lower(letters).dictionary_encode(), marks.dictionary_encode(), words.filter(split.is_null())
        n = len(letters.dictionary)
        flat, starts, sizes = self._find(pa.concat_arrays([letters.dictionary, marks.dictionary, whole]), n)
        at = np.empty((len(words), 2), np.int64)
        at[simple] = np.stack([_numpy(letters.indices), n + _numpy(marks.indices)], 1)
        at[~simple] = n + len(marks.dictionary) + np.arange(len(whole))[:, None]
        each = sizes[at]
        each[~simple, 1] = 0
        return runs(flat, starts[at].ravel(), each.ravel()), each.sum(1)

    def ids(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Of each text its ids, as little-endian 32-bit numbers."""
        texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        words = split.flatten().dictionary_encode()
        flat, sizes = self.learn(words.dictionary)
        at = _numpy(words.indices)
        ids = runs(flat, (np.cumsum(sizes) - sizes)[at], sizes[at]).astype("<u4", copy=False)
        ends = np.append(0, np.cumsum(sizes[at]))[_numpy(split.offsets)].tolist()
        return [ids[lo:hi].tobytes() for lo, hi in zip(ends, ends[1:])]


_MEMOS: dict[str, Memo] = {}


def memo_for(path: str) -> Memo:
    if path not in _MEMOS:
        _MEMOS[path] = Memo(path)
    return _MEMOS[path]


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, row (unique), and with_ids: ids, an array of int."""
    end = np.array([end_id], "<u4").tobytes()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("row", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        memo, row = memo_for(tokenizer_path), TaskContext.get().partitionId() << 36
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                out: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), memo.ids(part.column(1))):
                    ids += end
                    for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                        piece = ids[4 * at : 4 * (at + capacity)]
                        out.append((doc, k, at, len(piece) // 4, zlib.crc32(piece), row, piece))
                        row += 1
                cols = list(zip(*out))
                if with_ids:
                    cols[6] = [np.frombuffer(b, "<u4").astype(np.int32) for b in cols[6]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, row long" + ", ids array<int>" * with_ids
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, ddl)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the order given. Bins with no room left are no longer open."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by level; those at `capacity` are closed and stay 0
    at_level: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i, n in enumerate(lengths.tolist()):
        levels = np.flatnonzero(count[: capacity - n + 1])
        level = -1
        if len(levels):
            # the sum of squares grows by 2 * (count[level + n] - count[level]) + 2, by one less where the bin closes
            grows = 2 * (count[levels + n] - count[levels]) + 2
            if levels[-1] + n == capacity:
                grows[-1] -= 1
            k = len(levels) - 1 - int(np.argmin(grows[::-1]))
            if grows[k] <= 2 * count[n] + 1:
                level = int(levels[k])
        if level < 0:
            b, level, made = made, 0, made + 1
        else:
            b = at_level[level].pop()
            count[level] -= 1
        bins[i], offsets[i] = b, level
        if level + n < capacity:
            at_level[level + n].append(b)
            count[level + n] += 1
    return bins, offsets


def _place_block(capacity: int, slack: int, level: int, final: bool):
    def place(pdf):
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        room = capacity - np.bincount(bins, weights=pdf["length"].to_numpy())
        if len(room) > 1 << BIN_BITS:
            raise ValueError(f"a block has {len(room)} sequences, more than {BIN_BITS} bits number")
        pdf["sequence_id"] = (level << 56) + (pdf["block"].to_numpy() << BIN_BITS) + bins
        pdf["offset"] = offsets
        pdf["settled"] = True if final else (room <= capacity / slack)[bins]
        return pdf.drop(columns="block")

    return place


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, slack: int = SLACK) -> DataFrame:
    """Adds sequence_id, offset to pieces(row, length, ...): a written table with unique row."""
    keep = pieces.columns
    done: DataFrame | None = None
    loose: DataFrame | None = None  # the unsettled pieces where the round before has put them
    left, level, n, sequences = pieces, 0, pieces.count(), 0
    joined = lambda d: d if done is None else done.unionByName(d)
    while True:
        blocks = max(1, -(-n // block))
        final = blocks == 1

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.select(*keep).schema) + ", sequence_id long, offset long, settled boolean"
        placed = left.withColumn("block", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(blocks))).groupBy("block").applyInPandas(_place_block(capacity, slack, level, final), schema)
        if final and loose is None:
            return placed.drop("settled")
        placed = materialize(placed, "pack-placed")
        made = placed.groupBy("sequence_id").agg(F.first("settled").alias("settled"), F.count(F.lit(1)).alias("n"))
        made = made.agg(F.count(F.lit(1)).alias("all"), F.count_if(~F.col("settled")).alias("open"), F.sum(F.when(~F.col("settled"), F.col("n"))).alias("n")).first()
        if loose is not None and made["all"] >= sequences:
            return joined(loose)
        if final or not made["open"]:
            return joined(placed.drop("settled"))
        if 2 * made["n"] > n:
            block = max(block, min(2 * block, LARGEST))
        done = joined(placed.where("settled").drop("settled"))
        loose = placed.where("not settled").drop("settled")
        left, level, n, sequences = loose.select(*keep), level + 1, made["n"], made["open"]


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): a row for each piece."""
    pieces = materialize(tokenised_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids), "pack-pieces")
    return pack(pieces, capacity).drop("row")
