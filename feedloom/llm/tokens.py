"""Token ids of whole texts through a cache of words.

The tokenizer cuts a text at white space before anything else, so the ids of a text are the
ids of its words (parts between ASCII white space) in order.  Each distinct word is encoded
once per worker; a text is then a gather from one flat array of ids.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from feedloom.llm.common import distinct_words, ragged

#: How the default vocabulary file normalises and splits a text.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def word_bpe() -> str:
    """Place of the default vocabulary; the same package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Splitter:
    """Cuts words into the pieces that merges never cross.

    Words of printable ASCII and Latin-1 letters are cut here by the file's own pattern, which
    needs no Unicode tables for them; ``simple`` is None for every other word, for words that may
    hold a special token, and for files with another pattern: those go through the library.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        steps = (self.spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        known = (self.spec["normalizer"] or {}).get("normalizers") == NORMALIZER and steps[0].get("pattern") == {"Regex": SPLIT}
        #: ASCII letters alone are one piece.
        self.letters = known
        self.plain = re.compile(r"[!-~À-ÖØ-öø-ÿ]+" if known else r"(?!)").fullmatch
        self.find = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall

    def simple(self, word: str) -> list[str] | None:
        return self.find(word.lower()) if self.plain(word) and "<|" not in word else None


class IdLists:
    """Keys with their ids: one flat array and where each key's ids end in it.

    Emptied when it holds ``limit`` keys, which bounds memory and changes no result.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.ends = array("I"), array("q", [0])

    def __call__(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The flat array, and begin and length of each key's ids in it."""
        if len(self.index) > self.limit:
            self.clear()
        new = list(set(keys).difference(self.index))
        if new:
            ids, lengths = self.encode(new)
            ends = len(self.flat) + np.cumsum(lengths)
            self.index.update(zip(new, range(len(self.ends) - 1, len(self.ends) - 1 + len(new)), strict=True))
            self.flat.frombytes(ids.astype(np.uint32).tobytes())
            self.ends.frombytes(ends.astype(np.int64).tobytes())
        at = np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))
        ends = np.array(self.ends, dtype=np.int64)
        return np.array(self.flat, dtype=np.uint32), ends[at], ends[at + 1] - ends[at]


class WordIds:
    """Ids of whole texts; ``encode`` turns distinct new words into their ids, flat, and the lengths."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 250_000):
        self.known = IdLists(encode, limit)

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text ends in it."""
        distinct, places, ends_of_texts = distinct_words(texts)
        flat, starts, lengths = self.known(distinct)
        starts, lengths = starts[places], lengths[places]
        counts = np.concatenate(([0], np.cumsum(lengths)))
        return flat[ragged(starts, lengths)], counts[ends_of_texts]


def flat_lists(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Some lists as one array and their lengths."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(lengths.sum())), lengths


#: Printable ASCII that is neither letter nor digit: after letters it is a piece of its own.
MARKS = frozenset(b for b in range(33, 127) if not chr(b).isalnum())
#: Before a word that goes to the library whole; no piece begins with it.
WHOLE = b"\0"


class PieceIds:
    """Ids of words by way of their distinct pieces, which ``encode_pieces`` turns into ids, flat, and the lengths."""

    def __init__(self, splitter: Splitter, encode_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], encode_word: Callable[[str], list[int]], limit: int = 200_000):
        self.splitter, self.encode_pieces, self.encode_word = splitter, encode_pieces, encode_word
        self.known = IdLists(self._encode, limit)

    def _encode(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = np.fromiter((k[:1] == WHOLE for k in keys), bool, len(keys))
        ids, lengths = self.encode_pieces([k.decode() for k, w in zip(keys, whole, strict=True) if not w])
        if not whole.any():
            return ids, lengths
        more, counts = flat_lists([self.encode_word(k[1:].decode("utf-8", "replace")) for k, w in zip(keys, whole, strict=True) if w])
        # both kinds back in the order of the keys
        every, begin = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        every[~whole], every[whole] = lengths, counts
        begin[~whole], begin[whole] = np.cumsum(lengths) - lengths, len(ids) + np.cumsum(counts) - counts
        return np.concatenate([ids, more])[ragged(begin, every)], every

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts: list[bytes] = []
        counts = np.ones(len(words), np.int64)
        letters, marks, simple = self.splitter.letters, MARKS, self.splitter.simple
        # bytes of A-Z are lowered at once; a word holds no space
        for k, low in enumerate(b" ".join(words).lower().split(b" ") if words else ()):
            if letters and low.isalpha():
                parts.append(low)
                continue
            if letters and low[:-1].isalpha() and low[-1] in marks:
                parts += (low[:-1], low[-1:])
                counts[k] = 2
                continue
            pieces = simple(words[k].decode("utf-8", "replace"))
            if pieces is None:
                parts.append(WHOLE + words[k])
            else:
                counts[k] = len(pieces)
                parts += [p.encode() for p in pieces]
        flat, starts, lengths = self.known(parts)
        total = np.concatenate(([0], np.cumsum(lengths)))
        ends = np.cumsum(counts)
        return flat[ragged(starts, lengths)], total[ends] - total[ends - counts]


@lru_cache(maxsize=2)
def library_words(path: str) -> WordIds:
    """Words encoded by the tokenizers library, without truncation, padding or special ids."""
    from tokenizers import Tokenizer

    tok, splitter = Tokenizer.from_file(path), Splitter(path)
    tok.no_truncation()
    tok.no_padding()
    suffix = splitter.spec["model"].get("end_of_word_suffix") or "\0"
    vocab = tok.get_vocab()
    last = np.zeros(max(vocab.values()) + 1, bool)
    last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
    splitter.spec = {}

    def pieces(new: list[str], step: int = 1000) -> tuple[np.ndarray, np.ndarray]:
        """Many pieces in one call; a token with the end-of-word suffix ends a piece."""
        flat, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(new), step):
            part = new[k : k + step]
            ids = np.array(tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(last[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                sizes = np.diff(ends, prepend=0)
            else:
                ids, sizes = flat_lists([e.ids for e in tok.encode_batch_fast(part, add_special_tokens=False)])
            flat.append(ids)
            lengths.append(sizes)
        return np.concatenate(flat), np.concatenate(lengths)

    return WordIds(PieceIds(splitter, pieces, lambda w: tok.encode(w, add_special_tokens=False).ids))
