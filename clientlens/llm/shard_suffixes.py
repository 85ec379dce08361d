"""Repeated byte strings by suffix arrays of shards.

A string of LENGTH bytes repeats if it also starts in a document with a smaller id. Of its runs of ANCHOR bytes every such string selects the one
with the smallest hash, so equal strings select equal anchors. What follows:

1. Chunks of documents send their distinct anchors, sorted, to the owners of ranges of hashes, and get back which of them another text holds too.
   Documents that repeat an earlier text as a whole are known from their hashes, and go as a whole.
2. Stretches of strings that select one such anchor are pieces, and are dealt by anchor to shards of about SHARD bytes, so that equal strings meet.
   In a shard equal pieces are one, with the smallest id of their documents.
3. A shard's suffix array is made by induced sorting, and permuted common prefixes of LENGTH bytes or more tell which suffixes begin alike, and
   so the smallest id that each string starts in.
4. Each document gets back the places that are repeated, and removes them.

Texts stay where they are; anchors, pieces and places move. Pieces of an anchor that alone would fill a shard are first made one where they are
equal, in partial aggregates, and then dealt to shards likewise; where even different ones fill a shard, each string is settled by itself, in
partial aggregates too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .induced_sorting import permuted_common_prefixes, suffix_array, symbols
from .rows import Scan, partition_sizes, stored
from .texts import in_lists, in_small_batches
from .words import mixed

LENGTH = 50
ANCHOR = 24  # bytes, a multiple of 8
SHARD = 4_000_000
CHUNK = 4_000_000  # bytes of text that send their anchors together
AT_ONCE = 250_000  # bytes hashed at once
OWNED = 8_000_000  # bytes of text for each owner
FIRST = -(2**63)  # stands for a null id
_FACTORS = np.random.default_rng(12).integers(0, 2**64, ANCHOR // 8, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def least(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n successive numbers."""
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def anchors(data: bytes) -> np.ndarray:
    """The hash of the anchor of the string at each place of some bytes, as far as strings fit."""
    n = len(data) - ANCHOR + 1
    if len(data) < LENGTH:
        return np.empty(0, dtype=np.uint64)
    codes = np.frombuffer(data, dtype=np.uint8)
    total = np.zeros(n, dtype=np.uint64)
    for k, factor in enumerate(_FACTORS):
        total += np.lib.stride_tricks.as_strided(codes[8 * k : 8 * k + 8].view("<u8"), (n,), (1,)) * factor
    total ^= total >> np.uint64(32)
    total *= _MIX
    total ^= total >> np.uint64(29)
    return least(total, LENGTH - ANCHOR + 1)


def stretches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of successive strings with one anchor: which text, first string, number of strings, anchor."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - LENGTH + 1, 0)
    ends = np.cumsum(n)
    of = np.repeat(np.arange(len(texts)), n)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    selected = anchors(b"".join(texts))
    selected = selected[at + begins[of]] if len(selected) else np.empty(0, dtype=np.uint64)
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (selected[1:] != selected[:-1])
    first = np.flatnonzero(new)
    # The smallest hashes are small numbers: a bijection spreads them over all again.
    return of[first], at[first], np.diff(np.append(first, len(of))), mixed(selected[first])


def _chunks(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows whose second place holds a text or nothing, in chunks; the same ones whenever the rows come in the same order."""
    return in_lists(((len(row[1] or b""), row) for row in rows), CHUNK)


def planes(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers, all first bytes before all second ones and so on: the high ones then compress well."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, dtype=np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def _sent(owners: int):
    """The sorted distinct anchors of each chunk with a text that holds each, one list for each owner, and which of them two of its texts hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (row, text.as_py(), mark)
            for batch in batches
            for row, text, mark in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist())
        )
        for chunk in _chunks(rows):
            held, marks = [], []
            for some in in_lists(((len(row[1] or b""), row) for row in chunk), AT_ONCE):
                of, _, _, selected = stretches([bytes(row[1] or b"") for row in some])
                held.append(selected)
                marks.append(np.array([row[2] for row in some], dtype=np.int64)[of])
            distinct, mark, several = _by_anchor(np.concatenate(held), np.concatenate(marks))
            if not len(distinct):
                continue
            owner = ((distinct >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)  # ranges of hashes
            cuts = np.flatnonzero(np.append([True], owner[1:] != owner[:-1]))
            out = [
                (chunk[0][0], chunk[0][2], int(owner[a]), planes(distinct[a:b]), mark[a:b].tobytes(), np.packbits(several[a:b]).tobytes())
                for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(owner)).tolist())
            ]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["row", "mark", "owner", "anchors", "marks", "several"])

    return run


def _by_anchor(held: np.ndarray, marks: np.ndarray, several: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors in order, the mark of a text that holds each, and whether texts with different marks do."""
    order = np.argsort(held, kind="stable")
    held, marks = held[order], marks[order]
    begin = np.flatnonzero(np.append([True], held[1:] != held[:-1])[: len(held)])
    if not len(begin):
        return held, marks, np.empty(0, dtype=bool)
    least_mark = np.minimum.reduceat(marks, begin)
    differ = least_mark != np.maximum.reduceat(marks, begin)
    if several is not None:
        differ |= np.logical_or.reduceat(several[order], begin)
    return held[begin], least_mark, differ


def _shared(lists: pa.Table) -> pa.Table:
    """An owner's answers: of each list the anchors that several texts hold."""
    packed = lambda name: (x.as_buffer() for x in lists[name])
    values = [from_planes(x) for x in packed("anchors")]
    marks = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in packed("marks")])
    several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(v)).astype(bool) for x, v in zip(packed("several"), values)])
    told, _, differ = _by_anchor(np.concatenate(values), marks, several)
    told = told[differ]
    found = []
    for own in values:
        place = np.minimum(np.searchsorted(told, own), max(0, len(told) - 1))
        found.append(own[told[place] == own].tobytes() if len(told) else b"")
    answers = pa.table({"row": lists["row"], "shared": pa.array(found, pa.binary())})
    return answers.filter(pa.array([len(x) > 0 for x in found], pa.bool_()))


def _pieces(pairs: Iterable[tuple]) -> Iterator[tuple]:
    """Packed pieces of texts that are no copies: row of their documents, id, first byte, anchor, size and bytes."""
    for chunk in _chunks((row[3], row[1], row[2], answer) for row, answer in pairs):
        if chunk[0][3] is None or not chunk[0][3][1]:
            continue
        shared = np.sort(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in chunk[0][3][1]]))
        texts_of = [row for row in chunk if row[1] and (row[3] is None or not row[3][0])]
        for some in in_lists(((len(row[1]), row) for row in texts_of), AT_ONCE):
            texts = [bytes(row[1]) for row in some]
            of, at, n, selected = stretches(texts)
            place = np.minimum(np.searchsorted(shared, selected), len(shared) - 1)
            wanted = shared[place] == selected
            of, at, n, selected = of[wanted], at[wanted], n[wanted], selected[wanted]
            if not len(of):
                continue
            rows, ids = (np.array([FIRST if row[k] is None else row[k] for row in some], dtype=np.int64)[of] for k in (0, 2))
            size = n + LENGTH - 1
            data = b"".join([texts[o][a : a + s] for o, a, s in zip(of.tolist(), at.tolist(), size.tolist())])
            yield tuple(map(bytearray, (rows.tobytes(), ids.tobytes(), at.tobytes(), selected.tobytes(), size.astype(np.int32).tobytes(), data)))


PIECES = "row long, id long, start long, anchor long, piece binary"


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            *numbers, sizes, data = (batch.column(c)[k].as_buffer() for c in range(batch.num_columns))
            sizes = np.frombuffer(sizes, dtype=np.int32)
            offsets = pa.py_buffer(np.append(0, np.cumsum(sizes, dtype=np.int64)).astype(np.int32))
            columns = [pa.array(np.frombuffer(x, dtype=np.int64)) for x in numbers]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets, data])], names=[c.split()[0] for c in PIECES.split(", ")]
            )


def earlier(pieces: list[bytes], first: np.ndarray) -> list[list[tuple[int, int]]]:
    """Of each piece the stretches of strings (from, behind) that a piece with a smaller first id holds too."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    data = np.frombuffer(b"\0".join(pieces), dtype=np.uint8)
    begins = np.cumsum(sizes + 1) - sizes - 1
    # Symbols in the order of the bytes there are; 1 stands between pieces, 0 at the end.
    present = np.bincount(data, minlength=256) > 0
    buckets = int(present.sum()) + 2
    text = np.zeros(len(data) + 1, dtype=symbols(buckets))
    text[:-1] = (np.cumsum(present) + 1).astype(text.dtype)[data]
    text[begins[1:] - 1] = 1
    array = suffix_array(text, buckets)
    common, before = permuted_common_prefixes(data, array)
    of = np.repeat(np.arange(len(pieces)), sizes + 1)[: len(data)]
    room = (begins + sizes)[of] - np.arange(len(data))  # to the end of the piece
    whole = room >= LENGTH
    # A zero byte of a text is no end of a piece: neither string may reach beyond its own.
    alike = whole & (common >= LENGTH) & (before >= 0)
    alike[alike] = whole[before[alike]]
    order = array[array < len(data)]
    order = order[whole[order]]
    group = np.cumsum(~alike[order]) - 1
    begin = np.flatnonzero(np.append([True], group[1:] != group[:-1])[: len(group)])
    smallest = np.minimum.reduceat(first[of[order]], begin) if len(order) else np.empty(0, np.int64)
    repeated = np.zeros(len(data) + 1, dtype=bool)
    repeated[order] = smallest[group] < first[of[order]]
    # Strings that end at a piece's end are its last ones, so runs never go on from one piece to the next.
    edges = np.flatnonzero(np.diff(np.append(False, repeated).astype(np.int8)))
    found: list[list[tuple[int, int]]] = [[] for _ in pieces]
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        k = of[a]
        found[k].append((a - int(begins[k]), b - int(begins[k])))
    return found


SPANS = "row long, begin long, behind long"


def _settled(shard: pa.Table) -> pa.Table:
    """The spans of each document's text that a shard of pieces (row, id, start, piece) tells to be repeated."""
    pieces = shard["piece"].combine_chunks().dictionary_encode()
    of, ids, starts = pieces.indices.to_numpy(), shard["id"].to_numpy(), shard["start"].to_numpy()
    first = np.full(len(pieces.dictionary), np.iinfo(np.int64).max)
    np.minimum.at(first, of, ids)
    distinct = pieces.dictionary.to_pylist()
    found = earlier(distinct, first)
    sizes = np.array([len(p) for p in distinct], dtype=np.int64)
    # A piece that an earlier document holds goes as a whole; of others the strings that earlier pieces hold.
    whole = np.flatnonzero(ids > first[of])
    partly = [(k, a, b) for k in np.flatnonzero(ids == first[of]).tolist() for a, b in found[of[k]]]
    at = np.array([k for k, _, _ in partly], dtype=np.int64)
    begin = starts[at] + np.array([a for _, a, _ in partly], dtype=np.int64)
    behind = starts[at] + np.array([b for _, _, b in partly], dtype=np.int64) + LENGTH - 1
    rows = shard["row"].to_numpy()
    return pa.table(
        {
            "row": np.append(rows[whole], rows[at]),
            "begin": np.append(starts[whole], begin),
            "behind": np.append(starts[whole] + sizes[of[whole]], behind),
        }
    )


KNOWN = "one long, two long, first long, strings long, repeated array<struct<from:long,behind:long>>"


def _solved(shard: pa.Table) -> pa.Table:
    pieces = shard["piece"].to_pylist()
    found = earlier(pieces, shard["first"].to_numpy())
    kind = pa.list_(pa.struct([("from", pa.int64()), ("behind", pa.int64())]))
    repeated = pa.array([[{"from": a, "behind": b} for a, b in spans] for spans in found], kind)
    strings = pa.array([len(p) - LENGTH + 1 for p in pieces], pa.int64())
    return pa.table({"one": shard["one"], "two": shard["two"], "first": shard["first"], "strings": strings, "repeated": repeated})


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans put together where they touch or overlap, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _removed(pairs: Iterable[tuple]) -> Iterator[tuple]:
    """The result of each row; see `remove_repeated_bytes`."""
    for (_, text, i, _), answer in pairs:
        text = bytes(text or b"")
        copy, begins, ends = answer or (False, [], [])
        whole = [(0, len(text))] if len(text) >= LENGTH else []
        spans = whole if copy else merged(list(zip(begins, ends)))
        digest, at = hashlib.sha256(), 0
        for a, b in spans:
            digest.update(text[at:a])
            at = b
        digest.update(text[at:])
        yield i, len(text), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), ",".join(f"{a}:{b}" for a, b in spans)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    A byte of a text (in UTF-8; malformed bytes count as they are) goes if a string of LENGTH bytes around it also starts in a document with a
    smaller id; strings are judged on the texts as given and never cross documents. spans: first byte and end of each maximal run that goes.
    kept_sha256: of the bytes left. A null text has no bytes. A null id is smaller than all others; of rows with one id none
    is smaller. Other columns are not read. An empty table gives no rows.
    """
    spark = in_small_batches(docs).sparkSession
    text, id_or_first = F.col(text_col).cast("binary"), F.coalesce("id", F.lit(FIRST))
    base = docs.select(F.xxhash64(text).alias("mark"), text.alias("text"), F.col(id_col).cast("long").alias("id"))
    scan = Scan(base)
    rows = stored(
        Scan(base.withColumns({"sha": F.unhex(F.sha2("text", 256)), "size": F.coalesce(F.length("text"), F.lit(0))})).places("id", "sha", "size"),
        "rows",
    )
    firsts = rows.groupBy("sha").agg(F.min(id_or_first).alias("first"), F.max(id_or_first).alias("last"))
    firsts = stored(firsts.where("first < last").drop("last"), "firsts")  # stored, so that a text of many rows can be split
    copies = stored(rows.join(firsts, "sha").where(id_or_first > F.col("first")).select("row"), "copies")
    sizes = partition_sizes(rows)
    total = rows.agg(F.sum("size")).first()[0] or 0

    def answers(of: DataFrame, *columns: str) -> DataFrame:
        """One answer for each row: whether it is a copy, and some lists; by place."""
        empty = [F.expr(f"CAST(array() AS {of.schema[c].dataType.simpleString()})").alias(c) for c in columns]
        both = of.select("row", F.lit(False).alias("copy"), *columns).unionByName(copies.select("row", F.lit(True).alias("copy"), *empty))
        one = both.groupBy("row").agg(F.max("copy").alias("copy"), *[F.flatten(F.collect_list(c)).alias(c) for c in columns])
        return rows.select("row", "part", "place", "mark").join(one, "row").select("part", "place", "mark", "copy", *columns)

    sent = scan.df.select("row", "text", "mark").mapInArrow(
        _sent(max(1, -(-total // OWNED))), "row long, mark long, owner int, anchors binary, marks binary, several binary"
    )
    shared = sent.groupBy("owner").applyInArrow(_shared, "row long, shared binary")
    # One list for each owner of a chunk's anchors.
    asked = answers(shared.select("row", F.array("shared").alias("shared")), "shared")

    packed = spark.createDataFrame(
        scan.attach(asked, sizes).mapPartitions(_pieces),
        "rows binary, ids binary, starts binary, anchors binary, sizes binary, data binary",
        verifySchema=False,
    )
    pieces = stored(packed.mapInArrow(_unpacked, PIECES), "pieces", "zstd")
    weights = stored(pieces.groupBy("anchor").agg(F.sum(F.length("piece")).alias("n")), "weights")
    heavy = stored(weights.where(F.col("n") > SHARD).select("anchor"), "heavy")
    shards = max(1, -(-(weights.agg(F.sum("n")).first()[0] or 0) // SHARD))
    shard = F.pmod("anchor", F.lit(shards)).alias("shard")
    light = pieces.join(heavy, "anchor", "left_anti").select("row", "id", "start", "piece", shard)
    # As many tasks as the session has partitions: sorting takes long for its bytes, and small partitions would be put together by size.
    light = light.repartition(min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))), "shard")
    told = light.groupBy("shard").applyInArrow(_settled, SPANS).unionByName(_of_heavy(pieces.join(heavy, "anchor", "left_semi")))
    # Of one text, so bounded by it.
    found = told.groupBy("row").agg(F.collect_list("begin").alias("begins"), F.collect_list("behind").alias("ends"))
    spans = stored(answers(found, "begins", "ends"), "spans")
    return spark.createDataFrame(scan.attach(spans, sizes).mapPartitions(_removed), RESULT, verifySchema=False)


def _of_heavy(pieces: DataFrame) -> DataFrame:
    """What `_settled` says, of pieces whose anchors have more of them than a shard holds: equal ones are made one before they are dealt."""
    named = [F.xxhash64("piece").alias("one"), F.xxhash64(F.lit(1), "piece").alias("two")]
    distinct = stored(
        pieces.groupBy("piece").agg(F.min("id").alias("first"), F.min("anchor").alias("anchor")).select(*named, "first", "anchor", "piece"), "distinct"
    )
    weights = stored(distinct.groupBy("anchor").agg(F.sum(F.length("piece")).alias("n")), "distinct-weights")
    shards = max(1, -(-(weights.agg(F.sum("n")).first()[0] or 0) // SHARD))
    hot = weights.where(F.col("n") > SHARD).select("anchor")
    dealt = distinct.join(hot, "anchor", "left_anti").select("one", "two", "first", "piece", F.pmod("anchor", F.lit(shards)).alias("shard"))
    known = dealt.groupBy("shard").applyInArrow(_solved, KNOWN).unionByName(_string_by_string(distinct.join(hot, "anchor", "left_semi")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("strings").alias("behind")))
    return (
        pieces.select("row", "id", "start", *named)
        .join(known, ["one", "two"])
        .select("row", "start", F.explode(F.when(F.col("id") > F.col("first"), whole).otherwise(F.col("repeated"))).alias("span"))
        .select("row", (F.col("start") + F.col("span.from")).alias("begin"), (F.col("start") + F.col("span.behind") + LENGTH - 1).alias("behind"))
    )


def _string_by_string(pieces: DataFrame) -> DataFrame:
    """What `_solved` says of pieces, for those whose anchor is in too many of them: each string by itself."""
    strings = pieces.withColumn("at", F.explode(F.sequence(F.lit(0), F.length("piece") - LENGTH))).withColumn(
        "string", F.substring("piece", F.col("at") + 1, F.lit(LENGTH))
    )
    smallest = strings.groupBy("string").agg(F.min("first").alias("smallest"))
    again = F.struct(F.col("at").cast("long").alias("from"), (F.col("at") + 1).cast("long").alias("behind"))
    return (
        strings.join(smallest, "string")
        .groupBy("one", "two", "first", (F.length("piece") - LENGTH + 1).cast("long").alias("strings"))
        .agg(F.collect_list(F.when(F.col("smallest") < F.col("first"), again)).alias("repeated"))
    )


def repeats_sql(length: int = LENGTH) -> str:
    """The same over a view `documents` for DuckDB, string by string."""
    return f"""
      WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        strings AS (SELECT doc_id, j, b[j : j] AS byte, CASE WHEN j + {length - 1} <= n THEN b[j : j + {length - 1}] END AS key
          FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM t)),
        judged AS (SELECT doc_id, j, byte, CASE WHEN key IS NOT NULL AND min(doc_id) OVER (PARTITION BY key) < doc_id THEN 1 ELSE 0 END AS again FROM strings),
        covered AS (SELECT doc_id, j, byte, max(again) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) AS gone FROM judged),
        edges AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY j), 0) = 0 AS begins FROM covered),
        done AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, count_if(begins) AS n_spans,
          string_agg(hex(byte), '' ORDER BY j) FILTER (gone = 0) AS kept FROM edges GROUP BY doc_id)
      SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
        sha256(unhex(coalesce(kept, ''))) AS kept_sha256
      FROM t LEFT JOIN done USING (doc_id)"""
