"""Packing documents into sequences by vector best-fit.

A document becomes token ids and is cut only where it is longer than a sequence. A piece has a size in three dimensions: tokens, one
document, and attention cost (the square of its length). Pieces go, longest first, to the open sequence that
has room in every dimension and is left with the smallest weighted norm of what remains (or has the largest weighted
dot-product of room and size); where none has room, a sequence is opened.

Full pieces are sequences by themselves. The others are dealt to groups of about GROUP by a hash. Groups are packed side by side, and each leaves at most a few sequences unfilled.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .rows import stored
from .texts import in_small_batches, pieces, valid

GROUP = 8_192  # pieces packed together
BYTES = 1_000_000  # of text split at once
END = 0  # the id after each document
SPACE, LETTER, DIGIT, OTHER, LINE, CONTROL = range(6)
CACHE = 32_000_000  # bytes of runs remembered in a task, at most, besides those of the texts at hand
RUN_COST = 230  # bytes that a remembered run takes beside its characters and ids


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds, and how the dimensions weigh when one is chosen."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    rule: str = "norm"  # or "dot"


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of many stretches, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Words:
    """Ids of texts by a vocabulary whose tokenizer works on single words.

    In lower case, it takes runs of letters, single digits and runs of other characters each by itself. Texts of usual Latin
    characters and without names of added tokens are split into these runs here; a run is given to the tokenizer when it is first met, all new ones in one call,
    where the vocabulary's word ends tell their ids apart. Any other text is given to the tokenizer as it is.
    """

    # Characters that lower() and composition treat one by one, and that both sides agree on being space or not.
    ODD = regex.compile(r"[^\x01-\x1B\x20-\u012F\u0131-\u017F\u2010-\u2027\u2030-\u205E\u20AC]")
    RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n")

    def __init__(self, vocabulary: str, added: bool = False):
        """`added`: names of added tokens in a text are these tokens, as for the tokenizer itself; else they are ordinary text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = not added
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        # New runs are lower case already, stand between spaces, and no run comes twice: that needs no memory of the model's own.
        # The two share one model, so the vocabulary is held once.
        self.tokenizer.model._resize_cache(0)
        self.splitting = Tokenizer(self.tokenizer.model)
        self.splitting.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.kinds = np.array([self.kind(chr(i)) for i in range(0x20AD)], dtype=np.uint8)
        self.kinds[[0, *range(0x1C, 0x20)]] = CONTROL
        self.forget()

    @staticmethod
    def kind(c: str) -> int:
        if c == "\n":
            return LINE
        if c.isspace():
            return SPACE
        return {"L": LETTER, "N": DIGIT}.get(unicodedata.category(c)[0], OTHER)

    def forget(self) -> None:
        """Only the end of a text is known, which is that of the document, and nothing at all."""
        self.known = {"\n": 0, "": 1}
        self.flat, self.starts, self.sizes = np.array([END], dtype="<u4"), np.array([0, 0]), np.array([1, 0])
        self.held = 0

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def learn(self, runs: list[str]) -> None:
        ids = np.array(self.splitting.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(runs):
            each = [self.encode(run) for run in runs]
            ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
        sizes = np.diff(ends, prepend=0)
        self.known.update(zip(runs, range(len(self.known), len(self.known) + len(runs))))
        self.starts = np.append(self.starts, len(self.flat) + ends - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.flat = np.append(self.flat, ids)
        self.held += RUN_COST * len(runs) + sum(map(len, runs)) + 4 * len(ids)

    def split(self, texts: list[str]) -> pa.Array:
        """Runs of texts in lower case, a line end after each text."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        kind = self.kinds[codes]
        if kind.max(initial=0) == CONTROL:
            raise ValueError("a control character")
        alone = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | (kind[1:] == LINE)
        spaced = np.full(len(codes) + np.count_nonzero(alone), 32, dtype=np.uint32)
        spaced[np.append(np.int32(0), np.cumsum(alone, dtype=np.int32)) + np.arange(len(codes), dtype=np.int32)] = np.where(kind == SPACE, 32, codes)
        return pc.split_pattern(pa.array([spaced.tobytes().decode("utf-32-le")]), " ").values

    def usual(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without odd characters; the end of the document follows each."""
        lower = [t.replace("\n", " ").lower() + "\n" for t in texts]
        if any("'" in t for t in lower):  # contractions are runs too
            each = [
                pc.split_pattern(pa.array(["\0".join(self.RUNS.findall(t))]), "\0").values if "'" in t else self.split([t])
                for t in lower
            ]
            runs = pa.concat_arrays(each)
        else:
            runs = self.split(lower)
        runs = runs.dictionary_encode()
        distinct = runs.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.held > CACHE:
            self.forget()
        if new := [run for run in distinct if run not in self.known]:
            self.learn(new)
        of = np.fromiter(map(self.known.__getitem__, distinct), dtype=np.int64, count=len(distinct))[runs.indices.to_numpy()]
        sizes = self.sizes[of]
        ids = self.flat[ragged(self.starts[of], sizes)]
        return np.split(ids, np.cumsum(sizes)[of == 0][:-1])

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """All ids of each text, and the end of the document, as little-endian 32-bit numbers."""
        named = [bool(t) and any(name in t.lower() for name in self.added) for t in texts]
        plain = [t and t.isascii() and "'" not in t for t in texts]
        usual = [i for i, t in enumerate(texts) if t and not named[i] and (plain[i] or not self.ODD.search(t))]
        try:
            found = self.usual([texts[i] for i in usual]) if usual else []
        except ValueError:  # some plain text has a control character, which is looked for only now
            usual = [i for i in usual if not self.ODD.search(texts[i])]
            found = self.usual([texts[i] for i in usual]) if usual else []
        out = [b""] * len(texts)
        for i, ids in zip(usual, found):
            out[i] = ids.tobytes()
        end = np.array([END], dtype="<u4")
        for i in set(range(len(texts))).difference(usual):
            out[i] = np.append(self.encode(texts[i] or ""), end).astype("<u4").tobytes()
        return out


def cut(docs: DataFrame, vocabulary: str, tokens: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents: row, doc_id, piece, start, length, ids_crc32."""

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(vocabulary, added=True)
        for batch in batches:
            rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, at = [], 0
            for texts in pieces(batch.column(2), BYTES):
                for coded in words.ids(texts):
                    for k, start in enumerate(range(0, len(coded), 4 * tokens)):
                        part = coded[start : start + 4 * tokens]
                        out.append((rows[at], ids[at], k, start // 4, len(part) // 4, zlib.crc32(part)))
                    at += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["row", "doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return in_small_batches(docs).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), valid(F.col(text_col)).alias("text")
    ).mapInArrow(cut_batches, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """For pieces in the given order: the sequence of each, and its place there."""
    limits = (capacity.tokens, capacity.documents, capacity.attention)
    w = [weight / limit**2 for weight, limit in zip(capacity.weights, limits)]
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    room = np.empty((3, max(1, len(lengths))))  # tokens, documents and attention left of each open sequence
    names = np.empty(max(1, len(lengths)), dtype=np.int64)
    n = used = 0
    for i, length in enumerate(lengths.tolist()):
        size = (length, 1, length * length)
        tokens, documents, attention = room[:, :n]
        fits = (tokens >= length) & (documents >= 1) & (attention >= size[2])
        if capacity.rule == "dot":
            worth = sum(w[d] * size[d] * room[d, :n] for d in range(3))
        else:
            worth = -(w[0] * (tokens - length) ** 2 + w[1] * (documents - 1) ** 2 + w[2] * (attention - size[2]) ** 2)
        worth = np.where(fits, worth, -np.inf)
        best = int(worth.argmax()) if n else -1
        if best < 0 or worth[best] == -np.inf:
            best, n = n, n + 1
            room[:, best], names[best] = limits, used
            used += 1
        sequence[i], offset[i] = names[best], limits[0] - int(room[0, best])
        room[:, best] -= size
        if room[:, best].min() < 1:  # nothing fits any more
            n -= 1
            room[:, best], names[best] = room[:, n], names[n]
    return sequence, offset


def pack(parts: DataFrame, n_groups: int, capacity: Capacity) -> DataFrame:
    """The pieces with sequence_id and offset."""

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row", "piece"], ascending=[False, True, True], kind="stable")
        sequence, offset = best_fit(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=group["bin_group"].astype("int64") * 2**32 + sequence, offset=offset).drop(columns=["bin_group", "row"])

    return (
        parts.withColumn("bin_group", F.pmod(F.xxhash64("row", "piece"), F.lit(n_groups)).cast("int"))
        .groupBy("bin_group")
        .applyInPandas(packed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: Capacity = Capacity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece that holds only the end of the document. Malformed UTF-8 is read with replacement
    characters. Rows with one id are packed each by itself. Other columns are not read. An empty table gives no rows. Capacities must let any single piece in.
    `vocabulary`: path of the tokenizer's file, which every executor has.
    """
    if capacity.documents < 1 or capacity.attention < capacity.tokens**2:
        raise ValueError("a full piece must fit into an empty sequence")
    parts = stored(cut(docs, vocabulary, capacity.tokens, id_col, text_col), "pieces")
    is_full = F.col("length") == capacity.tokens
    n_groups = max(1, -(-parts.where(~is_full).count() // GROUP))
    own = F.monotonically_increasing_id() + F.lit(n_groups * 2**32)  # beyond the sequences of all groups
    full = parts.where(is_full).drop("row").withColumn("sequence_id", own).withColumn("offset", F.lit(0).cast("long"))
    return pack(parts.where(~is_full), n_groups, capacity).unionByName(full)
