"""Alignment of two tokenizers by the byte offsets where tokens of both end.

Of a text, each tokenizer's cumulative ends become a dictionary from end to token index. The keys that both have, sorted, slice the two
lists of ids into groups, and within a group every token of the one is linked with every token of the other.

How many documents hold a pair of ids is a figure of the whole corpus. Documents are taken in blocks of about BLOCK bytes: a block keeps its
documents' pairs as places in its own list of distinct pairs, and only these lists meet the others. So what is shuffled is a row for
a block and pair, not one for a document and pair, and each block gets back the counts of its pairs. The documents' lists themselves are
packed, since as arrays in rows of Spark they take several times a block's text in the memory of each step that holds them.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from .rows import stored
from .texts import in_lists, in_small_batches

BLOCK = 4_000_000  # bytes of text in a block; a longer text is a block of its own
AT_ONCE = 200_000  # bytes of text encoded at once
ROWS = 8  # blocks in a row group of a file, which a task holds whole when it writes or reads it
SHIFT = 32  # a pair of ids is the first one's 32 bits and the second one's


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Visible characters of Latin-1 stand for themselves, all other bytes in order for the characters from 256 on.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bytes:
    """The bytes of each id of a vocabulary, one after the other."""

    def __init__(self, of: list[bytes]):
        self.sizes = np.array([len(b) for b in of], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(of), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.flat[at].tobytes()


class First:
    """A byte-level vocabulary; a text is encoded with a space before it.

    Where ids follow the order of the merges, as is usual, the merges need no list of their own, and texts of usual characters are encoded by ranks
    alone. Any other text is given to the vocabulary's own tokenizer, as the two may know different versions of Unicode.
    """

    # How such a vocabulary cuts a text before it merges bytes. Fixed value: the pattern is part of the format.
    CUTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    # Latin, Greek, Cyrillic, usual punctuation, Hebrew, Arabic, Japanese, Chinese and Korean letters: of one kind since long ago.
    ODD = regex.compile(
        r"[^\t\n\r\x20-\x7E\u00A0-\u024F\u0391-\u03A1\u03A3-\u03CE\u0400-\u052F\u05D0-\u05EA\u0621-\u064A"
        r"\u2010-\u2027\u2030-\u205E\u20AC\u3041-\u3094\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3]"
    )

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        of, names = byte_level(), self.tokenizer.get_vocab(with_added_tokens=True)
        added = set(self.tokenizer.get_added_tokens_decoder())
        tokens = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            tokens[i] = name.encode() if i in added else bytes(of[c] for c in name)
        self.bytes = Bytes(tokens)
        self.ranked = self.by_ranks(path, {t: i for i, t in enumerate(tokens) if t and i not in added})

    def by_ranks(self, path: str, ranks: dict[bytes, int]) -> tiktoken.Encoding | None:
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        merges = [m.split(" ") if isinstance(m, str) else m for m in described["model"]["merges"]]
        ids = [described["model"]["vocab"]["".join(m)] for m in merges]
        plain = described["normalizer"] is None and described["pre_tokenizer"] == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True
        }
        if not plain or ids != sorted(ids) or not all(bytes([b]) in ranks for b in range(256)):
            return None
        return tiktoken.Encoding("ranked", pat_str=self.CUTS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = [i for i, t in enumerate(texts) if self.ranked is None or self.ODD.search(t)]
        found = self.tokenizer.encode_batch_fast([" " + texts[i] for i in odd], add_special_tokens=False) if odd else []
        by_itself = {i: np.array(x.ids, dtype=np.int64) for i, x in zip(odd, found)}
        return [
            by_itself[i] if i in by_itself else self.ranked.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64)
            for i, t in enumerate(texts)
        ]


class Second:
    """A piece vocabulary with byte fallback, which adds the space itself."""

    def __init__(self, path: str):
        self.processor = SentencePieceProcessor(model_file=path)
        self.bytes = Bytes([self.token(i) for i in range(self.processor.get_piece_size())])

    def token(self, i: int) -> bytes:
        piece = self.processor.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.processor.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, dtype=np.int64) for x in self.processor.encode(texts, num_threads=1)]


@lru_cache(maxsize=1)  # a worker goes on to further tasks
def vocabularies(first: str, second: str) -> tuple[First, Second, np.ndarray]:
    one, two = First(first), Second(second)
    # Decimal ids with what may follow them: "," or "|" in the first list, "," or ";" in the second.
    n, m = len(one.bytes.sizes), len(two.bytes.sizes)
    shown = [f"{i}," for i in range(n)] + [f"{i}|" for i in range(n)] + [f"{i}," for i in range(m)] + [f"{i};" for i in range(m)]
    return one, two, np.array(shown, dtype=np.bytes_)


def slices(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Behind the last token of each group, in both lists: where the cumulative ends of both agree.

    The dictionaries are direct: at each byte offset stands what is behind the last token that ends there, or 0.
    """
    size = max(ends_a[-1:].tolist() + ends_b[-1:].tolist() + [0]) + 1
    index_a, index_b = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32)
    index_a[ends_a], index_b[ends_b] = np.arange(1, len(ends_a) + 1), np.arange(1, len(ends_b) + 1)
    common = np.flatnonzero((index_a > 0) & (index_b > 0))
    return index_a[common].astype(np.int64), index_b[common].astype(np.int64)


def links(stop_a: np.ndarray, stop_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token indices of all links: within each group every one of the first with every one of the second."""
    n_a, n_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
    each = n_a * n_b
    of = np.repeat(np.arange(len(each)), each)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
    return (stop_a - n_a)[of] + inside // n_b[of], (stop_b - n_b)[of] + inside % n_b[of]


def written(a: np.ndarray, b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray, shown: np.ndarray, n: int, m: int) -> str:
    """The groups as `a1,a2|b1;a3|b2,b3`."""
    code_a, code_b = a.copy(), b + 2 * n
    code_a[stop_a - 1] += n
    code_b[stop_b - 1] += m
    out = np.empty(len(a) + len(b), dtype=np.int64)
    n_a, n_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
    out[np.arange(len(a)) + np.repeat(stop_b - n_b, n_a)] = code_a
    out[np.arange(len(b)) + np.repeat(stop_a, n_b)] = code_b
    # entries are as wide as the widest one, filled up with zero bytes
    return shown[out].tobytes().translate(None, b"\0")[:-1].decode()


class Aligned(NamedTuple):
    """What is told of one text; `pairs`: its distinct linked pairs, and `times`: how often each is linked."""

    n_a: int
    n_b: int
    n_groups: int
    sha: str
    pairs: np.ndarray
    times: np.ndarray


NO_TOKENS = Aligned(0, 0, 0, "", np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))


def align(text: bytes, a: np.ndarray, b: np.ndarray, one: Bytes, two: Bytes, shown: np.ndarray) -> Aligned:
    spaced = b" " + text
    if one.joined(a) != spaced or two.joined(b) != spaced:
        return NO_TOKENS
    stop_a, stop_b = slices(np.cumsum(one.sizes[a]), np.cumsum(two.sizes[b]))
    groups = written(a, b, stop_a, stop_b, shown, len(one.sizes), len(two.sizes))
    at_a, at_b = links(stop_a, stop_b)
    pairs, times = np.unique((a[at_a] << SHIFT) | b[at_b], return_counts=True)
    return Aligned(len(a), len(b), len(stop_a), hashlib.sha256(groups.encode()).hexdigest(), pairs, times)


BLOCKS = "block long, pairs array<long>, holders array<int>, documents binary"  # holders: how many of the block's documents hold a pair
_LIST = pa.list_(pa.int32())
_DOCUMENTS = pa.schema(
    {"ids": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "shas": pa.string(), "places": _LIST, "times": _LIST}
)


def packed(docs: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as writer:
        writer.write_batch(docs)
    return sink.getvalue().to_pybytes()


def unpacked(data: pa.Buffer) -> pa.RecordBatch:
    with pa.ipc.open_stream(data, options=pa.ipc.IpcReadOptions(use_threads=False)) as reader:
        return reader.read_next_batch()


def _blocks(first: str, second: str):
    """Texts (id, text as bytes) become one row for each block."""

    def aligned(rows: list[tuple[int | None, bytes]]) -> Iterator[Aligned]:
        one, two, shown = vocabularies(first, second)
        for some in in_lists(((len(t), t) for _, t in rows), AT_ONCE):
            # Malformed bytes are replaced here, and then differ from what the tokens hold.
            texts = [t.decode("utf-8", "replace") for t in some]
            full = [i for i, t in enumerate(texts) if t]
            found = dict(zip(full, zip(one.encode([texts[i] for i in full]), two.encode([texts[i] for i in full])))) if full else {}
            for i, text in enumerate(some):
                yield align(text, *found[i], one.bytes, two.bytes, shown) if i in found else NO_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << SHIFT
        rows = (
            (len(text), (i, text))
            for batch in batches
            for i, text in zip(batch.column(0).to_pylist(), (x.as_py() or b"" for x in batch.column(1)))
        )
        for block in in_lists(rows, BLOCK):
            docs = list(aligned(block))
            pairs, places, holders = np.unique(np.concatenate([d.pairs for d in docs]), return_inverse=True, return_counts=True)
            ends = np.cumsum([0, *(len(d.pairs) for d in docs)]).astype(np.int32)
            columns = {
                "ids": [i for i, _ in block],
                "n_a": [d.n_a for d in docs],
                "n_b": [d.n_b for d in docs],
                "n_groups": [d.n_groups for d in docs],
                "shas": [d.sha for d in docs],
                # steps to the next place are small numbers, as a document's pairs are sorted
                "places": pa.ListArray.from_arrays(ends, pa.array(np.diff(places, prepend=0), pa.int32())),
                "times": pa.ListArray.from_arrays(ends, pa.array(np.concatenate([d.times for d in docs]), pa.int32())),
            }
            row = [[number], [pairs], [holders], [packed(pa.RecordBatch.from_pydict(columns, _DOCUMENTS))]]
            kinds = (pa.int64(), pa.list_(pa.int64()), _LIST, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(row, kinds)], names=["block", "pairs", "holders", "documents"])
            number += 1

    return run


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the counts of their pairs become one row for each document."""
    for whole in batches:
        for at in range(whole.num_rows):
            docs, found = unpacked(whole.column("documents")[at].as_buffer()), whole.column("found").slice(at, 1).flatten()
            ends, places = docs["places"].offsets.to_numpy(), np.cumsum(docs["places"].values.to_numpy(), dtype=np.int64)
            times = docs["times"].values.to_numpy().astype(np.int64)
            pair, documents, highest = (found.field(f).to_numpy(zero_copy_only=False) for f in ("pair", "documents", "best"))
            order = np.argsort(pair)  # the block's own list is sorted too
            count, best = documents[order][places] * times, highest[order][places] * times
            total = lambda x: np.diff(np.append(0, np.cumsum(x))[ends])  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [docs["ids"], docs["n_a"], docs["n_b"], docs["n_groups"], *[pa.array(total(x), pa.int64()) for x in (times, best, count)], docs["shas"]],
                names=[c.split()[0] for c in RESULT.split(", ")],
            )


def align_blocks(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents in blocks: their figures and their linked pairs as places in the block's list of distinct pairs, packed, and that list."""
    texts = in_small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return stored(texts.mapInArrow(_blocks(first, second), BLOCKS), "aligned", **{"parquet.block.row.count.limit": ROWS})


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, a, b, documents (how many hold it linked) and best (1 if no pair of the same first id is held by more)."""
    held = blocks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.holders").alias("n"))
    counts = stored(held.groupBy("pair").agg(F.sum("n").alias("documents")), "pair-counts")
    counts = counts.withColumn("a", F.shiftright("pair", SHIFT).cast("int"))
    highest = counts.groupBy("a").agg(F.max("documents").alias("highest"))
    return counts.join(highest, "a").select(
        "pair", "a", F.col("pair").bitwiseAND(2**SHIFT - 1).cast("int").alias("b"), "documents", (F.col("documents") == F.col("highest")).cast("int").alias("best")
    )


def align_documents(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    `first` (a byte-level vocabulary) encodes a space and the text, `second` (pieces with byte fallback) the text, both without special
    tokens; names of special tokens in a text are ordinary text. Groups lie between the byte offsets where tokens of both end; links are all pairs
    inside a group. n_best: links whose pair is held by the most documents of all pairs with its first id, ties included. count_sum: how many
    documents hold each link's pair, summed over the links. groups_sha256: of the groups' ids.

    Null and empty texts, malformed UTF-8, and texts that the tokens of either do not spell exactly have no tokens: zeros and an empty string. Every
    row counts as a document, repeated ones and those without id too. Other columns are not read. An empty table gives no rows.
    Both vocabularies are paths that every executor has.
    """
    blocks = align_blocks(docs, first, second, id_col, text_col)
    counts = stored(pair_counts(blocks).select("pair", "documents", "best"), "pairs")
    asked = blocks.select("block", F.explode("pairs").alias("pair"))
    # One row for a pair of a block's list, so what a block gathers is bounded by its text.
    found = asked.join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "documents", "best")).alias("found"))
    return blocks.drop("pairs", "holders").join(found, "block", "left").mapInArrow(_counted, RESULT)
