"""BPE encoding and decoding with a pair occurrence index.

The new words of a batch are laid out as one symbol list.  An index maps every pair that has
a merge rank to all its positions there.  Active ranks leave a heap in ascending order; one
rank merges all positions of its pair at once and adds the pairs it creates to their lists.
Words do not touch each other, so the lowest rank of all words is also the lowest in each word
that holds it, and the result is the usual one.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from feedloom.llm.common import id_text, smaller
from feedloom.llm.tokens import PieceIds, Splitter, WordIds, flat_lists, word_bpe

CODES = "doc_id long, ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PairIndexCodec:
    """Reads a BPE file with an end-of-word suffix and no decoder; tokenizers normalises and pre-splits."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.splitter, tok = Splitter(path), Tokenizer.from_file(path)
        spec = self.splitter.spec
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.normalise, self.presplit = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        self.pairs: list[tuple[int, int]] = []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a], self.vocab[b]] = len(self.merged)
            self.pairs.append((self.vocab[a], self.vocab[b]))
            self.merged.append(self.vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        # the byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257, ...
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = [b for b in range(256) if b not in set(own)]
        letter = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.first = [self.vocab.get(letter[b], -1) for b in range(256)]
        self.last = [self.vocab.get(letter[b] + self.suffix, -1) for b in range(256)]
        self.byte = {c: b for b, c in letter.items()}
        self.splitter.spec = {}

    def encode_word(self, word: str) -> list[int]:
        """A word that the splitter leaves to the library; a special token is its id."""
        out: list[int] = []
        for part in self.cut.split(word) if self.cut else [word]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                cut = [bytes(self.byte[c] for c in p) for p, _ in self.presplit(self.normalise(part))]
                out += [i for ids in self.encode_bytes(cut) for i in ids]
        return out

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        return self.encode_bytes([p.encode() for p in pieces])

    def encode_bytes(self, pieces: list[bytes]) -> list[list[int]]:
        symbols: list[int] = []
        ends: list[int] = []
        for p in pieces:
            symbols += [self.first[b] for b in p[:-1]]
            symbols.append(self.last[p[-1]])
            ends.append(len(symbols))
        self.merge(symbols, {e - 1 for e in ends})
        out, begin = [], 0
        for end in ends:
            out.append([s for s in symbols[begin:end] if s >= 0])
            begin = end
        return out

    def merge(self, symbols: list[int], stops: set[int]) -> None:
        """Applies all merges in place; a symbol taken into the one before it becomes -1."""
        n, ranks, merged, pairs = len(symbols), self.ranks, self.merged, self.pairs
        after = [-1 if i in stops else i + 1 for i in range(n)]
        before = [-1 if i == 0 or i - 1 in stops else i - 1 for i in range(n)]
        places: dict[int, list[int]] = {}
        for i in range(n):
            if after[i] >= 0:
                r = ranks.get((symbols[i], symbols[i + 1]))
                if r is not None:
                    places.setdefault(r, []).append(i)
        heap = list(places)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            (a, b), c = pairs[r], merged[r]
            for i in sorted(places.pop(r, ())):
                j = after[i]
                if symbols[i] != a or j < 0 or symbols[j] != b:
                    continue  # an earlier merge took one of the two
                symbols[i], symbols[j] = c, -1
                k = after[i] = after[j]
                touched = [(before[i], i)]
                if k >= 0:
                    before[k] = i
                    touched.append((i, k))
                for x, y in touched:
                    if x >= 0:
                        q = ranks.get((symbols[x], symbols[y]))
                        if q is not None:
                            if q not in places:
                                places[q] = []
                                heapq.heappush(heap, q)
                            places[q].append(x)

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space: what a tokenizer without a decoder does; unknown ids are left out."""
        return " ".join([self.token[i] for i in ids if i in self.token])


@lru_cache(maxsize=2)
def codec(path: str) -> tuple[PairIndexCodec, WordIds]:
    c = PairIndexCodec(path)
    return c, WordIds(PieceIds(c.splitter, lambda new: flat_lists(c.encode_pieces(new)), c.encode_word))


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list, list[str]]]:
    c, known = codec(path)
    for b in smaller(batches):
        ids, ends = known.batch(b.column(1))
        per_text, begin = [], 0
        for end in ends:
            per_text.append(ids[begin:end])
            begin = end
        yield b.column(0), per_text, [c.decode(x.tolist()) for x in per_text]


def bpe_codes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Ids and decoded text of every row: ``doc_id, ids, decoded``.

    Null text: as empty, no ids and an empty decoded text.  Ties and repeated rows: each gives
    its own row.  A null id stays null.  An empty table gives an empty result.
    """
    path = path or word_bpe()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, texts in _encoded(batches, path):
            yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), pa.array([x.astype("int32") for x in ids], pa.list_(pa.int32())), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return id_text(docs, id_col, text_col).mapInArrow(run, CODES)


def bpe_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """As ``bpe_codes``, but the ids and the decoded text leave the task as SHA-256 digests only."""
    path = path or word_bpe()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, texts in _encoded(batches, path):
            columns = [
                keys.cast(pa.int64()),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs, id_col, text_col).mapInArrow(run, DIGESTS)
