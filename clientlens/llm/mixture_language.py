"""Languages of a text as a mixture.

Letter trigrams are counted for each language of the learning rows. A text is cut into segments of consecutive
trigrams; expectation-maximisation finds the language proportions under which its segments are likeliest. Languages are
then struck off, weakest first, as long as the likelihood lost is less than the penalty for one more language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import in_small_batches, pieces, valid

BUCKETS = 1 << 15  # of hashed trigrams: the model is BUCKETS numbers a language
SEGMENT = 24  # trigrams
ROUNDS = 12  # of expectation-maximisation
AT_ONCE = 125_000  # characters of text judged at once; each takes a number for each language, and a worker keeps the memory
PENALTY = 3.0  # nats for each language, times the logarithm of one more than the number of segments
SMOOTHING = 0.5
MOST_LANGUAGES = 1000  # more labels than this are an error, so the model has a bounded size
UNKNOWN = "und"

RESULT = "struct<lang_pred:string,score:double,n_languages:int,mixture:string>"


def _letters() -> np.ndarray:
    known = np.zeros(0x110000, dtype=bool)
    known[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return known


def trigrams(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams around each letter, and of which text each is.

    Texts are put in lower case; whatever is no letter counts as a space.
    """
    texts = [t.lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters[codes]
    codes = np.where(is_letter, codes, np.uint32(32))
    at = np.flatnonzero(is_letter)
    mixed = codes[at - 1] * np.uint32(0x9E3779B1) + codes[at] * np.uint32(0x85EBCA6B) + codes[at + 1] * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    buckets = (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - (BUCKETS.bit_length() - 1))
    starts = np.cumsum([1] + [len(t) + 1 for t in texts[:-1]])
    return buckets.astype(np.int64), np.searchsorted(starts, at, side="right") - 1


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one partition: lang, bucket, n."""
    letters, counts = _letters(), {}
    for batch in batches:
        langs, at = batch.column(0).to_pylist(), 0
        for texts in pieces(batch.column(1), AT_ONCE):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(langs[at : at + len(texts)], texts):
                by_lang.setdefault(lang, []).append(text)
            at += len(texts)
            for lang, own in by_lang.items():
                n = np.bincount(trigrams(own, letters)[0], minlength=BUCKETS)
                counts[lang] = counts[lang] + n if lang in counts else n
    for lang, n in counts.items():
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(n[seen], pa.int64())],
            names=["lang", "bucket", "n"],
        )


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log-probability of each bucket in each of them.

    All labelled rows are counted, each partition by itself first; what reaches the driver is one number for each language
    and bucket. Rows whose text or language is null teach nothing.
    """
    counts = (
        labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
        .select(valid(F.col(lang_col).cast("string")), valid(F.col(text_col)))
        .mapInArrow(count_trigrams, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = np.array(counts["lang"].to_pylist(), dtype=object)
    langs = sorted(set(names))
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; at most {MOST_LANGUAGES} can be learned")
    table = np.full((BUCKETS, len(langs)), SMOOTHING)
    for k, lang in enumerate(langs):
        own = names == lang
        table[counts["bucket"].to_numpy()[own], k] += counts["n"].to_numpy()[own]
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32) if langs else table.astype(np.float32)


def expectation_maximisation(
    like: np.ndarray, starts: np.ndarray, active: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each text.

    `like`: log-likelihood by segment and language; `starts`: each text's first segment; `active`: which
    languages each text may use.
    """
    sizes = np.diff(np.append(starts, len(like)))
    top = like.max(axis=1, keepdims=True)
    weight = np.exp(like - top)
    share = active / active.sum(axis=1, keepdims=True)
    for step in range(ROUNDS + 1):
        joint = weight * np.repeat(share, sizes, axis=0)
        total = joint.sum(axis=1, keepdims=True)
        np.maximum(total, 1e-300, out=total)
        if step < ROUNDS:
            share = np.add.reduceat(joint / total, starts, axis=0) / sizes[:, None]
    return share, np.add.reduceat((np.log(total) + top)[:, 0], starts)


def mixtures(like: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Proportions of each text over the languages that are worth their penalty."""
    n = len(starts)
    sizes = np.diff(np.append(starts, len(like)))
    active = np.ones((n, like.shape[1]))
    share, best = expectation_maximisation(like, starts, active)
    todo = np.arange(n)
    while len(todo := todo[active[todo].sum(axis=1) > 1]):
        fewer = active[todo].copy()
        fewer[np.arange(len(todo)), np.where(fewer > 0, share[todo], np.inf).argmin(axis=1)] = 0
        rows = np.concatenate([np.arange(starts[t], starts[t] + sizes[t]) for t in todo])
        new_share, new = expectation_maximisation(like[rows], np.cumsum(sizes[todo]) - sizes[todo], fewer)
        better = new + PENALTY * np.log1p(sizes[todo]) >= best[todo]
        todo, new_share, new, fewer = todo[better], new_share[better], new[better], fewer[better]
        active[todo], share[todo], best[todo] = fewer, new_share, new
    return share


def predictor(langs: list[str], table: np.ndarray) -> Column:
    """A function from a text column to `RESULT`, by a learned model."""

    def rows(texts: list[str | None], letters: np.ndarray) -> list[dict]:
        out = [{"lang_pred": UNKNOWN, "score": 0.0, "n_languages": 0, "mixture": ""} for _ in texts]
        buckets, of = trigrams([t or "" for t in texts], letters)
        if not langs or not len(buckets):
            return out
        ids, first, counts = np.unique(of, return_index=True, return_counts=True)
        # A segment never spans two texts.
        cuts = np.concatenate([np.arange(a, a + n, SEGMENT) for a, n in zip(first, counts)])
        like = np.add.reduceat(table[buckets], cuts, axis=0).astype(np.float64)
        share = mixtures(like, np.searchsorted(cuts, first))
        for i, s in zip(ids, share):
            kept = [k for k in np.argsort(-s, kind="stable") if s[k] > 0]
            out[i] = {
                "lang_pred": langs[kept[0]],
                "score": float(min(1.0, s[kept[0]])),
                "n_languages": len(kept),
                "mixture": ",".join(f"{langs[k]}:{s[k]:.3f}" for k in kept),
            }
        return out

    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("n_languages", pa.int32()), ("mixture", pa.string())])

    @F.arrow_udf(RESULT)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        letters = _letters()
        for batch in batches:
            yield pa.array([row for texts in pieces(batch, AT_ONCE) for row in rows(texts, letters)], kind)

    # Else a filter on what was found would have Spark run it twice, with two more workers: for the filter and for what passes.
    return predict.asNondeterministic()


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that teach nothing: crc32 of the id as text leaves 2 on division by 4. A row without id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", as_col: str = "language") -> DataFrame:
    """The documents with one more column, `as_col`, of type `RESULT`.

    It has the likeliest language (the first by name of equal ones), its proportion, and the whole mixture. A text that is null
    or has no letter gets `und` with score 0, and so does every text if nothing could be learned. It is learned from
    the rows that are not `held_out` and whose language is not null; a prediction sees nothing but the text. Texts of any length are read
    whole, each row by itself, repeated ones too; malformed UTF-8 is read with replacement characters. An empty table gives no rows. A column that is called `as_col` is replaced.
    """
    docs = in_small_batches(docs)
    langs, table = learn(docs.where(~held_out(id_col)), text_col, lang_col)
    return docs.withColumn(as_col, predictor(langs, table)(valid(F.col(text_col))))
