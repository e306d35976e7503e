"""Token ids of whole texts by the tokenizers library, with a store of words seen before."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from chaffline.llm.arrays import ragged, texts_of

#: Words a worker keeps at about most; beyond, the half that is asked for most often stays.
STORED_WORDS = 800_000
#: Words that are encoded as one text, with a mark between them that no word has.
WORDS_AT_ONCE = 4096
MARK = "\u241e"
#: Bytes of text that are encoded at once.
TEXT_BYTES = 8 << 20

_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The encoder of a tokenizer file, loaded once in each worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Encoder:
    """Encodes texts word by word, a repeated word once.

    For tokenizers whose pre-tokens begin at a space between two other characters that are no
    white space; there a text's ids are those of its parts. Byte-level BPE and BPE with word
    ends are of that kind. A special token written out in a text is that token, as in the
    library: a text is cut there, and what is left and right of it are texts of their own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that take part of the text around them are not supported")
        names = sorted((t.content for t in added), key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.size = self.tokenizer.get_vocab_size()
        self._mark = np.array(self.tokenizer.encode(f" {MARK}", add_special_tokens=False).ids, np.uint32)
        self._clear()

    def _clear(self) -> None:
        self._slots: dict[str, int] = {}
        self._starts = np.zeros(1024, np.int64)
        self._counts = np.zeros(1024, np.int64)
        self._asked = np.zeros(1024, np.int64)
        self._flat = np.zeros(4096, np.uint32)
        self._used = 0

    def _forget(self) -> None:
        """Keep the half of the words that were asked for in the most batches, the oldest first."""
        size = len(self._slots)
        kept = np.sort(np.argsort(-self._asked[:size], kind="stable")[: STORED_WORDS // 2])
        words = list(self._slots)
        starts, counts, asked = self._starts[kept], self._counts[kept], self._asked[kept]
        self._flat = self._flat[ragged(starts, counts)]
        self._used = len(self._flat)
        self._slots = {words[i]: at for at, i in enumerate(kept.tolist())}
        self._starts, self._counts, self._asked = np.cumsum(counts) - counts, counts, asked // 2

    def _lookup(self, words: list[str]) -> np.ndarray:
        """Slots of words, new ones being encoded and stored."""
        find = self._slots.get
        slots = np.fromiter((find(w, -1) for w in words), np.int64, len(words))
        new = list(dict.fromkeys(words[i] for i in np.flatnonzero(slots < 0)))
        if not new:
            self._asked[slots] += 1
            return slots
        parts = [self._ids_of(new[i : i + WORDS_AT_ONCE]) for i in range(0, len(new), WORDS_AT_ONCE)]
        ids, counts = (np.concatenate(x) for x in zip(*parts))
        first = len(self._slots)
        self._starts = _room(self._starts, first + len(new))
        self._counts = _room(self._counts, first + len(new))
        self._asked = _room(self._asked, first + len(new))
        self._flat = _room(self._flat, self._used + int(counts.sum()))
        ends = self._used + np.cumsum(counts)
        self._starts[first : first + len(new)] = ends - counts
        self._counts[first : first + len(new)] = counts
        self._flat[self._used : ends[-1]] = ids
        self._used = int(ends[-1])
        self._slots.update(zip(new, range(first, first + len(new))))
        self._asked[first : first + len(new)] = 0
        missing = np.flatnonzero(slots < 0)
        slots[missing] = np.fromiter((self._slots[words[i]] for i in missing), np.int64, len(missing))
        self._asked[slots] += 1
        return slots

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and their numbers.

        Words that begin with a space are joined by a mark and encoded as one text, as every
        call of the library costs more than a word; its ids are found again in the result.
        """
        joinable = [w[:1] == " " and w[1:2] != " " and not w[-1].isspace() and MARK not in w for w in words]
        joinable = [j and not w[1:2].isspace() for j, w in zip(joinable, words)]
        if not all(joinable):
            rest = [w for w, j in zip(words, joinable) if not j]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            if not any(joinable):
                counts = np.fromiter(map(len, found), np.int64, len(found))
                return np.array([i for ids in found for i in ids], np.uint32), counts
            ids, counts = self._ids_of([w for w, j in zip(words, joinable) if j])
            own = np.split(ids, np.cumsum(counts)[:-1])
            joined, other = iter(own), iter(found)
            every = [next(joined) if j else np.array(next(other), np.uint32) for j in joinable]
            return np.concatenate(every), np.fromiter(map(len, every), np.int64, len(every))
        text = "".join(w + f" {MARK}" for w in words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        size = len(self._mark)
        found = np.ones(len(ids) - size + 1, bool)
        for i, code in enumerate(self._mark):
            found &= ids[i : i + len(found)] == code
        ends = np.flatnonzero(found)
        counts = np.diff(ends, prepend=-size) - size
        keep = np.ones(len(ids), bool)
        keep[(ends[:, None] + np.arange(size)).ravel()] = False
        return ids[keep], counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (uint32), and the number of ids of each text."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self._slots) > STORED_WORDS:
            self._forget()
        lists = pc.split_pattern(texts, " ")
        parts = lists.flatten()
        starts = np.asarray(lists.offsets, dtype=np.int64)
        starts = starts - starts[0]
        size = np.asarray(pc.binary_length(parts))
        odd = (size == 0) | (size != np.asarray(pc.binary_length(pc.utf8_trim_whitespace(parts))))
        odd_text = np.add.reduceat(odd, starts[:-1]) > 0
        if self._special is not None:
            odd_text |= np.asarray(pc.match_substring_regex(texts, self._special.pattern))

        words = parts.dictionary_encode()
        slots = self._lookup([" " + w for w in words.dictionary.to_pylist()])[np.asarray(words.indices)]
        slots[starts[:-1]] = self._lookup(parts.take(pa.array(starts[:-1])).to_pylist())
        per_text = np.diff(starts)
        if odd_text.any():
            pieces, at = [], 0
            for i in np.flatnonzero(odd_text):
                pieces.append(slots[starts[at] : starts[i]])
                own = self._lookup(self._cut(texts[int(i)].as_py()))
                per_text[i] = len(own)
                pieces.append(own)
                at = i + 1
            pieces.append(slots[starts[at] :])
            slots = np.concatenate(pieces)
        counts = self._counts[slots]
        ids = self._flat[ragged(self._starts[slots], counts)]
        before = np.concatenate(([0], np.cumsum(counts)))
        ends = np.cumsum(per_text)
        return ids, before[ends] - before[ends - per_text]

    def _cut(self, text: str) -> list[str]:
        """The parts of a text that are encoded one by one; special tokens are parts of their own."""
        if self._special is None:
            return _parts(text)
        pieces = self._special.split(text)
        return [p for i, piece in enumerate(pieces) for p in ([piece] if i % 2 else _parts(piece)) if p or len(pieces) == 1]

    def batch(self, batch: pa.RecordBatch, column: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Like `encode` for a column, null as empty, with `end_id` behind each text."""
        ids, counts = self.encode(texts_of(batch, column))
        return np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32), counts + 1


def _room(array: np.ndarray, size: int) -> np.ndarray:
    return array if size <= len(array) else np.concatenate((array, np.zeros(max(size, len(array)), array.dtype)))


def _parts(text: str) -> list[str]:
    """A text cut in front of each space that has other characters than white space on both sides."""
    done, parts = [], text.split(" ")
    open_part = parts[0]
    for part in parts[1:]:
        if open_part and part and not open_part[-1].isspace() and not part[0].isspace():
            done.append(open_part)
            open_part = " " + part
        else:
            open_part += " " + part
    return [*done, open_part]
