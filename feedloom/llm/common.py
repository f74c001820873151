"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words: space, tab, line feed, vertical tab, form feed, return.
SPACES = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows: their buffers hold whole texts, and the default of 10,000 takes much memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; a null text is the empty text."""
    short_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def distinct_words(texts: pa.Array, lower: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of some texts: the distinct ones, which of them each word is, and where each text ends.

    Arrow parts at the same characters as ``SPACES``; ``lower`` lower-cases A-Z only.  A text that
    begins or ends with white space gives an empty word, which is left out.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = parts.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    places = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = (parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py()).astype(np.int64)
    if b"" in distinct:
        blank = distinct.index(b"")
        full = places != blank
        ends = np.concatenate(([0], np.cumsum(full)))[ends]
        places = places[full]
    return distinct, places, ends


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def by_key(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of which some may be null; the key columns of the right side go."""
    marked = right.select(*[F.col(n).alias(f"__r_{n}") if n in names else F.col(n) for n in right.columns])
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(marked[f"__r_{n}"])
    return left.join(marked, cond, how).drop(*[f"__r_{n}" for n in names])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of the ranges ``starts[i] : starts[i] + lengths[i]``."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def smaller(batches: Iterator[pa.RecordBatch], size: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes, so that Python holds few texts at once."""
    for b in batches:
        step = max(1, int(b.num_rows * size / max(1, b.nbytes)))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of some texts, and where each text ends."""
    import xxhash

    distinct, places, ends = distinct_words(texts, lower)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    return hashes[places], ends


def mixed(x: np.ndarray) -> np.ndarray:
    """Bit mixing of 64-bit integers (the finaliser of MurmurHash3)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, from the words' hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    return mixed(out)
