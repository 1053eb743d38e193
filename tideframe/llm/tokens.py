"""Token ids of whole texts by the ``tokenizers`` library, one distinct word at a time.

The tokenizer expected here drops white space before it splits, so no token spans ASCII white space and
the ids of a text are the ids of its words in a row. Words repeat far more often than texts, so those of
a batch are told apart first, and a bounded memory of words already encoded saves most of the library's
work. A tokenizer file with any other normaliser or pre-tokenizer is used as it is, on whole texts.
"""

from __future__ import annotations

import codecs
import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words remembered by each Python worker (about 40 bytes a word).
MEMORY_WORDS = 400_000
LONGEST_WORD = 64
#: Bytes of text that are encoded at once.
STEP_BYTES = 4 << 20
TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Words whose ids are laid out at once; longer batches go in several steps.
WORDS_A_STEP = 1 << 20
#: Plain words: Latin letters whose lower case is letter by letter and needs no composing, then marks.
_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_PLAIN = f"^(?P<letters>[{_LATIN}]+)(?P<marks>[.,;:!?*%#$&)]*)$"

# The chain of which words may be encoded on their own.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT = {"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTES]}

_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_OTHERS = [b for b in range(256) if b not in _PRINTED]
#: Byte-level letters: bytes that print stand for themselves, the others are numbered from 256 on.
_BYTE_LETTERS = "".join(chr(b if b in _PRINTED else 256 + _OTHERS.index(b)) for b in range(256))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def laid_out(ids: np.ndarray, size: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ids of entries ``at``, one after another; entry k has ``size[k]`` of ``ids``."""
    begin, parts = np.cumsum(size) - size, [np.empty(0, "<u4")]
    for lo in range(0, len(at), WORDS_A_STEP):
        part = at[lo : lo + WORDS_A_STEP]
        n = size[part]
        stop = np.cumsum(n)
        parts.append(ids[np.repeat(begin[part] - (stop - n), n) + np.arange(stop[-1])])
    return np.concatenate(parts)


class Encoder:
    """Encodes texts to unsigned 32-bit ids; exact, whatever is in its memory."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        chain = json.loads(self.tokenizer.to_str())
        self.by_word = chain["normalizer"] == _NORMALIZER and chain["pre_tokenizer"] == _PRE_TOKENIZER and chain["post_processor"] is None
        self.special = tuple(t["content"] for t in chain["added_tokens"])
        self.by_word = self.by_word and not any(c.isspace() for t in self.special for c in t) and all(not t.isalpha() for t in self.special)
        self.model = self.tokenizer.model
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.words, self.ids, self.size = pa.array([], pa.string()), np.empty(0, "<u4"), np.empty(0, np.int64)
        self.uses = np.empty(0, np.int64)

    def _pack(self, tokens: list) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in tokens])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of lower-case letters straight from the library's BPE model, of all else through its whole chain."""
        if word.isalpha() and word.islower() and max(word) < "ɐ":
            letters = word if word.isascii() else codecs.charmap_decode(word.encode(), "strict", _BYTE_LETTERS)[0]
            return self._pack(self.model.tokenize(letters))
        return self._whole(word)

    def _remember(self, words: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        """Adds words; beyond the memory's bound the half that was met in the fewest batches goes."""
        short = pc.less_equal(pc.binary_length(words), LONGEST_WORD)
        if pc.all(short).as_py() is False:
            stays = short.to_numpy(zero_copy_only=False)
            words, ids, size = words.filter(short), ids[np.repeat(stays, size)], size[stays]
        self.words = pa.concat_arrays([self.words, words])
        self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
        self.uses = np.concatenate([self.uses, np.ones(len(words), np.int64)])
        if len(self.words) > MEMORY_WORDS:
            stays = np.zeros(len(self.words), bool)
            stays[np.argsort(-self.uses, kind="stable")[: MEMORY_WORDS // 2]] = True
            self.words, self.ids = self.words.filter(pa.array(stays)), self.ids[np.repeat(stays, self.size)]
            self.size, self.uses = self.size[stays], self.uses[stays] >> 1

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words in a row, and how many each has."""
        plain = pc.extract_regex(words, _PLAIN)
        is_plain = plain.is_valid()
        letters = pc.if_else(is_plain, pc.utf8_lower(plain.field("letters")), words)
        marks = pc.if_else(is_plain, plain.field("marks"), "")
        parts = pa.concat_arrays([letters, marks]).dictionary_encode()
        names = parts.dictionary
        at = pc.index_in(names, value_set=self.words)
        missing = names.filter(pc.is_null(at))
        new = [self._word(w) if w else b"" for w in missing.to_pylist()]
        new_ids, new_size = np.frombuffer(b"".join(new), "<u4"), np.array([len(x) // 4 for x in new], np.int64)
        entry = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        met = entry >= 0
        self.uses[entry[met]] += 1
        entry[~met] = np.arange(len(self.words), len(self.words) + len(new))
        ids, size = np.concatenate([self.ids, new_ids]), np.concatenate([self.size, new_size])
        self._remember(missing, new_ids, new_size)
        both = entry[parts.indices.to_numpy()].reshape(2, -1).T  # letters and marks of each word
        return laid_out(ids, size, both.ravel()), size[both].sum(axis=1)

    def encode(self, texts: pa.Array, end: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (null: none), each followed by ``end``, and where each text's ids stop."""
        tail = b"" if end is None else end.to_bytes(4, "little")
        if not self.by_word:
            parts = [(self._whole(t) if t else b"") + tail for t in texts.to_pylist()]
            return np.frombuffer(b"".join(parts), "<u4"), np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)
        lists = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        stops = lists.offsets.to_numpy()[1:].astype(np.int64) - lists.offsets[0].as_py()
        words = lists.flatten().dictionary_encode()
        ids, size = self._known(words.dictionary)
        ids, size = np.append(ids, np.frombuffer(tail, "<u4")), np.append(size, len(tail) // 4)
        at = np.insert(words.indices.to_numpy(zero_copy_only=False), stops, len(size) - 1)  # the end, after each text
        reach = np.cumsum(size[at])
        return laid_out(ids, size, at), reach[stops + np.arange(len(stops))]

    def each(self, texts: pa.Array, end: int | None = END_ID) -> Iterator[np.ndarray]:
        """Ids of one text after another."""
        ids, stops = self.encode(texts, end)
        start = 0
        for stop in stops.tolist():
            yield ids[start:stop]
            start = stop


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to about ``STEP_BYTES``, so that words are told apart over more rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= STEP_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)
    pa.default_memory_pool().release_unused()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and Python worker; its memory lasts over the worker's tasks."""
    return Encoder(path)
