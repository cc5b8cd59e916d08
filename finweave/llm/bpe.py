"""Byte-level BPE through the ``tokenizers`` library, with each distinct chunk encoded once.

The library's time goes into splitting text and tracking offsets, and web text repeats its words.
So a batch is cut at single spaces, the chunks are made distinct by Arrow, each chunk that the
worker has not met is encoded by the library's own pre-tokeniser and model, and the ids are put
together by index.  A cut at a single space is exact: the pre-tokeniser's pattern takes one leading
space into a following piece, so a piece never spans such a space from the left.  Texts for which
this does not hold (two spaces in a row, a space at the end) or that contain an added token go to
the library whole, as do all texts when the file describes another kind of tokenizer.

A file that drops white space and ends words (``WORD_PATTERN``) is cut at ASCII white space, which no piece
spans and no normalisation crosses; there only texts that contain an added token go to the library whole.
"""

from __future__ import annotations

import json
import os
import string
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from finweave.llm.common import as_large_text

#: Chunks that a worker remembers, twice: beyond this it keeps them aside for one turn and starts anew.
CACHE_CHUNKS = 300_000
#: Bytes of text encoded at once: fewer pieces look the same chunks up less often.
ENCODE_BYTES = 16_000_000
#: Rows of a batch; a batch encodes each distinct chunk once, so small ones cost time.
ENCODE_ROWS = 4_000
#: ASCII marks that follow a word as one piece; the apostrophe starts contractions and is left out.
MARKS = string.punctuation.replace("'", "")

#: Fixed value: how a tokenizer with word ends splits; no alternative takes white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Latin letters that are in composed form and have one letter of one case as lower case (not so the capital I with a dot).
PLAIN_WORD = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u024f]+$"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-ins for the 256 byte values: printable Latin-1 stays, the rest follows from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in printable}
    table.update({b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in table)})
    return table


def _splits_words(spec: dict) -> bool:
    """Whether the file normalises, splits by ``WORD_PATTERN`` and goes to bytes, and nothing else."""
    norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps, cuts = norm.get("normalizers", []), pre.get("pretokenizers", [])
    if [x["type"] for x in steps] != WORD_NORMALIZERS or [x["type"] for x in cuts] != ["Split", "ByteLevel"]:
        return False
    split, to_bytes = cuts
    cut = split["pattern"] == {"Regex": WORD_PATTERN} and split["behavior"] == "Removed" and split["invert"]
    spaces = steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
    return bool(cut and spaces and not to_bytes["add_prefix_space"] and not to_bytes["use_regex"] and spec["model"]["type"] == "BPE" and not spec.get("post_processor"))


def _put_together(values: list[bytes], index: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts whose chunks have the ids ``values[index]``, and each text's offsets into them."""
    pool = np.frombuffer(b"".join(values), dtype=np.uint32)
    lengths = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
    pool_start = np.cumsum(lengths) - lengths
    per_chunk = lengths[index]
    ends = np.cumsum(per_chunk)
    total = int(ends[-1]) if len(ends) else 0
    shift = pool_start[index] - (ends - per_chunk)
    ids = pool[np.repeat(shift, per_chunk) + np.arange(total)]
    return ids, np.concatenate([[0], ends])[offsets]


class BpeEncoder:
    """Ids of whole texts as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.by_chunk = bool(plain and spec["model"]["type"] == "BPE" and not spec.get("normalizer"))
        self.by_word = _splits_words(spec)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.alphabet = byte_alphabet()
        self.model, self.pre = self.tokenizer.model, self.tokenizer.pre_tokenizer
        #: By chunk with its leading space; stems (chunks without marks) are chunks themselves.
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece of the pre-tokeniser."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1")
        return array("I", [t.id for t in self.model.tokenize(piece.translate(self.alphabet))]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of one chunk, which stands at a text's start or takes its leading space.

        Letters, then marks, is what most chunks are: two pieces by the pattern.  The rest is split by
        the library.
        """
        stem = chunk.rstrip(MARKS)
        if stem[1:].isalpha() and (stem[0] == " " or stem[0].isalpha()):
            found = self.cache.get(stem)
            if found is None:
                found = self.cache[stem] = self.before.get(stem) or self._piece(stem)
            tail = chunk[len(stem) :]
            # Only stems are remembered: with their marks they are many more, and quickly put together.
            return found + self._tail(tail) if tail else found
        found = self.cache[chunk] = self.before.get(chunk) or b"".join(self._piece_mapped(piece) for piece, _ in self.pre.pre_tokenize_str(chunk))
        return found

    def _tail(self, marks: str) -> bytes:
        found = self.tails.get(marks)
        if found is None:
            found = self._piece(marks)
            if len(self.tails) < CACHE_CHUNKS:
                self.tails[marks] = found
        return found

    def _piece_mapped(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _has_added(self, texts: pa.Array, whole: np.ndarray) -> np.ndarray:
        for token in self.added:
            whole = whole | np.asarray(pc.match_substring(texts, token).to_numpy(zero_copy_only=False), dtype=bool)
        return whole

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts, one after another, and each text's offsets into them."""
        texts = as_large_text(texts)
        n = len(texts)
        whole = np.ones(n, bool)
        if self.by_chunk and n:
            mask = pc.or_(pc.match_substring(texts, "  "), pc.ends_with(texts, " "))
            whole = self._has_added(texts, np.asarray(mask.to_numpy(zero_copy_only=False), dtype=bool))
        elif self.by_word and n:
            whole = self._has_added(texts, np.zeros(n, bool))
        quick = self._by_word if self.by_word else self._by_chunk
        if not whole.any():
            return quick(texts)
        ids: list[np.ndarray] = []
        lengths = np.zeros(n, np.int64)
        quick_ids, quick_offsets = quick(texts.filter(pa.array(~whole)))
        k = 0
        for i in range(n):
            if whole[i]:
                part = self._whole(texts[i].as_py())
            else:
                part = quick_ids[quick_offsets[k] : quick_offsets[k + 1]]
                k += 1
            ids.append(part)
            lengths[i] = len(part)
        return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), np.concatenate([[0], np.cumsum(lengths)])

    def _by_chunk(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        lists = pc.split_pattern(texts, " ")
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        encoded = lists.values.dictionary_encode()
        index = np.asarray(encoded.indices.to_numpy(zero_copy_only=False), dtype=np.int64)
        dictionary = encoded.dictionary.to_pylist()
        first = np.zeros(len(index), bool)
        first[offsets[:-1]] = True
        cache = self.cache
        if len(cache) > CACHE_CHUNKS:
            self.before, self.cache = cache, {}
            cache = self.cache
        chunks = [" " + word for word in dictionary]
        values = list(map(cache.get, chunks))
        for i, found in enumerate(values):
            if found is None:
                values[i] = self._chunk(chunks[i])
        starts, which = np.unique(index[first], return_inverse=True)
        for i in starts:
            values.append(b"".join(map(self._piece_mapped, (p for p, _ in self.pre.pre_tokenize_str(dictionary[i])))) if dictionary[i] else b"")
        index[first] = len(dictionary) + which
        return _put_together(values, index, offsets)

    def _words(self, words: pa.Array) -> list[bytes]:
        """Ids of words without white space.  Letters, then marks, is two pieces, whose ids are remembered apart and in lower case."""
        stems = pc.utf8_rtrim(words, characters=MARKS)
        plain = pc.match_substring_regex(stems, PLAIN_WORD)
        parts = pc.if_else(plain, pc.utf8_lower(stems), words).dictionary_encode()
        if len(self.cache) > CACHE_CHUNKS:
            self.before, self.cache = self.cache, {}
        cache, before = self.cache, self.before
        names = parts.dictionary.to_pylist()
        ids = list(map(cache.get, names))
        is_plain = np.zeros(len(names), bool)
        index = parts.indices.to_numpy(zero_copy_only=False)
        is_plain[index[plain.to_numpy(zero_copy_only=False)]] = True
        whole = []
        for i, found in enumerate(ids):
            if found is None:
                if (found := before.get(names[i])) is None:
                    if not is_plain[i]:
                        whole.append(i)
                        continue
                    # One piece, which is normalised already.
                    found = self._piece(names[i])
                cache[names[i]] = ids[i] = found
        for i, found in zip(whole, self.tokenizer.encode_batch_fast([names[i] for i in whole], add_special_tokens=False)):
            cache[names[i]] = ids[i] = array("I", found.ids).tobytes()
        values = [ids[i] for i in index.tolist()]
        more = pc.and_(plain, pc.not_equal(pc.binary_length(stems), pc.binary_length(words)))
        at = np.flatnonzero(more.to_numpy(zero_copy_only=False))
        for i, word, stem in zip(at.tolist(), words.take(pa.array(at)).to_pylist(), stems.take(pa.array(at)).to_pylist()):
            values[i] += self._tail(word[len(stem) :])
        return values

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        lists = pc.ascii_split_whitespace(texts)
        encoded = lists.values.dictionary_encode()
        index = np.asarray(encoded.indices.to_numpy(zero_copy_only=False), dtype=np.int64)
        return _put_together(self._words(encoded.dictionary), index, np.asarray(lists.offsets, dtype=np.int64))

    def count(self, texts: pa.Array) -> np.ndarray:
        return np.diff(self.encode(texts)[1])


@lru_cache(maxsize=4)
def encoder(path: str) -> BpeEncoder:
    """One encoder for each tokenizer file and Python worker; tasks share a machine's cores, so it takes one."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return BpeEncoder(path)


def file_digest(path: str) -> str:
    """SHA-256 of the tokenizer file, its version in the token cache."""
    import hashlib

    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
