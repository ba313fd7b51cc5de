"""Token ids of texts, with the tokenizers library and a public vocabulary file.

The vocabulary drops white space and never joins what white space parts, so a text's ids are those of its runs of other
characters, one after the other. A slice of texts is cut into runs and its distinct runs are found by Arrow kernels; only
those that the worker doesn't know are given to the library. Runs of Latin letters and then ASCII punctuation are what
the library's own splitting makes two words of: their letters, in lower case as it would have them, and their marks are
looked up on their own, and new ones given to it as one text. Each ends with the first id that can end a word.
All other new runs are given to it parted by a mark that none of them holds.

This holds for vocabulary files with word ends that drop white space, of which VOCABULARY is one.

What a worker knows is held in flat arrays of a bounded number of bytes. When they are full, all but the runs of the
slice at hand are forgotten.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from . import textscan as T

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END = 2
#: Bytes of runs and their ids that a worker keeps, and as many for words; bytes of text in a slice; runs given to the library at a time.
KEPT_BYTES, SLICE, LEARNT = 16 << 20, 1 << 20, 2_000
#: Stands between runs given to the library together.
APART = "~"

# Kinds of bytes: ASCII letters, the first and second byte of Latin-1 letters, punctuation that is part of no contraction or special token.
_LETTER, _LEAD, _TRAIL, _MARK = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[0xC3] = _LEAD
_KIND[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = _TRAIL
_KIND[list(rb"""!"#$%&()*+,-./:;=?@[\]^_`{}~""")] = _MARK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[0x80:0x9F] += 32  # as the second byte of a Latin-1 letter


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An Arrow array of strings of these sizes that stand one after the other in data."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


class Strings:
    """Strings as flat bytes, and a hash of each."""

    def __init__(self, column: pa.Array):
        scan = T.scan(column)
        self.data, self.offsets = scan.data, scan.offsets
        self.hashes = scan.hashes(scan.offsets[:-1], scan.offsets[1:])


def spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions of consecutive ranges (first, size), and where each range begins among them (one more entry)."""
    ends = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    at = np.repeat(first - ends[:-1], size)
    at += np.arange(ends[-1])
    return at, ends


class Known:
    """Ids of strings, by place. Place 0 is what ends a text, and no string's. Strings are found by hash and compared by content."""

    def __init__(self, end: list[int]):
        self.ids, self.starts = np.array(end, np.uint32), np.array([0, len(end)], np.int64)
        self.data, self.offsets = np.zeros(0, np.uint8), np.zeros(2, np.int64)
        self.hashes, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def find(self, s: Strings) -> np.ndarray:
        """The place of each of these strings, -1 for those not known."""
        out = np.full(len(s.hashes), -1, np.int64)
        if len(self.hashes):
            by_hash = np.argsort(s.hashes)  # neighbours in the search are then neighbours in memory
            at = np.minimum(np.searchsorted(self.hashes, s.hashes[by_hash]), len(self.hashes) - 1)
            place = self.order[at]
            same = (self.hashes[at] == s.hashes[by_hash]) & (np.diff(self.offsets)[place] == np.diff(s.offsets)[by_hash])
            mine, place = by_hash[same], place[same]
            size = np.diff(s.offsets)[mine]
            here, ends = spread(s.offsets[mine], size)
            there, _ = spread(self.offsets[place], size)
            wrong = np.concatenate([[0], np.cumsum(s.data[here] != self.data[there])])
            out[mine] = np.where(wrong[ends[1:]] == wrong[ends[:-1]], place, -1)
        return out

    def add(self, s: Strings, which: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Make known those strings of s, none of which is known, by their ids and the number of each; their places."""
        places = len(self.starts) - 1 + np.arange(len(which))
        at, ends = spread(s.offsets[which], np.diff(s.offsets)[which])
        self.data, self.offsets = np.concatenate([self.data, s.data[at]]), np.concatenate([self.offsets, self.offsets[-1] + ends[1:]])
        self.ids, self.starts = np.concatenate([self.ids, ids]), np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        by_hash = np.argsort(s.hashes[which])
        hashes = s.hashes[which][by_hash]
        into = np.searchsorted(self.hashes, hashes)
        self.hashes, self.order = np.insert(self.hashes, into, hashes), np.insert(self.order, into, places[by_hash])
        return places

    def keep(self, places: np.ndarray) -> np.ndarray:
        """Forget all but place 0 and these, and return where these then are."""
        kept = np.unique(np.append(places, 0))
        ids, ends = self.gather(kept)
        at, offsets = spread(self.offsets[kept], np.diff(self.offsets)[kept])
        self.data, self.offsets, self.ids, self.starts = self.data[at], offsets, ids, ends
        held = np.isin(self.order, kept)
        self.hashes, self.order = self.hashes[held], np.searchsorted(kept, self.order[held])
        return np.searchsorted(kept, places)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.data, self.offsets, self.ids, self.starts, self.hashes, self.order))

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these places, one after the other, and where each begins (one more entry than places)."""
        at, ends = spread(self.starts[places], self.starts[places + 1] - self.starts[places])
        return self.ids[at], ends


class Encoder:
    """Ids as unsigned 32-bit integers in the machine's order, which is little-endian wherever Spark runs."""

    def __init__(self, path: str = VOCABULARY, end: int | None = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.runs, self.words = Known([] if end is None else [end]), Known([])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[k for word, k in vocabulary.items() if word.endswith("</w>")]] = True
        self.apart = vocabulary[APART + "</w>"]

    def _library(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _places(self, known: Known, new: pa.Array, learn: Callable[[Strings, pa.Array, np.ndarray], np.ndarray]) -> np.ndarray:
        """The places of distinct strings; learn gives those of unknown ones, of which it gets the strings, the array and the indices."""
        s = Strings(new)
        at = known.find(s)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            if known.nbytes() > KEPT_BYTES:
                at[at >= 0] = known.keep(at[at >= 0])
            at[unknown] = learn(s, new, unknown)
        return at

    def _learn_words(self, s: Strings, new: pa.Array, which: np.ndarray) -> np.ndarray:
        """Make known strings that are one word to the library; an empty one has no ids."""
        strings = new.take(pa.array(which))
        ids = np.concatenate([self._library(" ".join(strings[lo : lo + LEARNT].to_pylist())) for lo in range(0, len(strings), LEARNT)])
        sizes = (np.diff(s.offsets)[which] > 0).astype(np.int64)
        sizes[sizes > 0] = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
        return self.words.add(s, which, ids, sizes)

    def _learn_others(self, s: Strings, new: pa.Array, which: np.ndarray) -> np.ndarray:
        """Make known any runs."""
        strings = new.take(pa.array(which))
        alone = pc.match_substring_regex(strings, pattern=f"{APART}|<\\|").to_numpy(zero_copy_only=False)
        places = np.empty(len(which), np.int64)
        for k in np.flatnonzero(alone).tolist():
            ids = self._library(strings[k].as_py())
            places[k] = self.runs.add(s, which[k : k + 1], ids, np.array([len(ids)]))[0]
        others = np.flatnonzero(~alone)
        for lo in range(0, len(others), LEARNT):
            part = others[lo : lo + LEARNT]
            ids = self._library(f" {APART} ".join([*strings.take(pa.array(part)).to_pylist(), ""]))
            cut = np.flatnonzero(ids == self.apart)
            places[part] = self.runs.add(s, which[part], ids[ids != self.apart], np.diff(cut, prepend=-1) - 1)
        return places

    def _learn(self, s: Strings, new: pa.Array, which: np.ndarray) -> np.ndarray:
        """Make known runs; those that are letters and then marks by way of their parts."""
        size = np.diff(s.offsets)[which]
        at, offsets = spread(s.offsets[which], size)
        data = s.data[at]
        kind = _KIND[data]
        before, after = np.append(np.uint8(0), kind[:-1]), np.append(kind[1:], np.uint8(0))
        first = np.zeros(len(data) + 1, bool)
        first[offsets[:-1]] = True
        mark, trail = kind == _MARK, kind == _TRAIL
        fits = (kind == _LETTER) | ((kind == _LEAD) & (after == _TRAIL)) | (trail & (before == _LEAD)) | mark
        fits &= mark | first[:-1] | (before != _MARK)  # no letter after a mark
        sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
        plain = sums(fits) == size
        places = np.empty(len(which), np.int64)
        if not plain.all():
            places[~plain] = self._learn_others(s, new, which[~plain])
        if plain.any():
            inside, marks = np.repeat(plain, size), sums(mark)[plain]
            lowered = np.where(trail | (kind == _LETTER), _LOWER[data], data)
            words, signs = _strings(lowered[inside & ~mark], size[plain] - marks), _strings(data[inside & mark], marks)
            both = pa.concat_arrays([words, signs]).dictionary_encode()
            part = self._places(self.words, both.dictionary, self._learn_words)[both.indices.to_numpy()].reshape(2, -1)
            ids, ends = self.words.gather(part.T.ravel())
            places[plain] = self.runs.add(s, which[plain], ids, np.diff(ends[::2]))
        return places

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), each with the end id after them, one after the other, and where each text begins (one more entry than texts)."""
        # The kernel splits at 0x20 and 0x09-0x0D, and gives empty strings at the ends of some texts.
        lists = pc.ascii_split_whitespace(text.cast(pa.string()).fill_null(""))
        coded = lists.flatten().dictionary_encode()
        at = self._places(self.runs, coded.dictionary, self._learn)
        bounds = lists.offsets.to_numpy()[1:]
        ids, ends = self.runs.gather(np.insert(at[coded.indices.to_numpy()], bounds, 0))
        return ids, ends[np.append(0, bounds + np.arange(1, len(bounds) + 1))]


@functools.lru_cache(1)
def worker_encoder(path: str, end: int | None) -> Encoder:
    """The encoder of this worker process; tasks that run in it one after the other share what it knows."""
    return Encoder(path, end)


def encoded(batches: Iterator[pa.RecordBatch], path: str = VOCABULARY, end: int | None = END) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches, the ids of their texts and where each text's begin; a null text is empty."""
    encoder = worker_encoder(path, end)
    for part in T.slices(batches, "text", SLICE):
        yield part, *encoder.encode(part["text"])
    pa.default_memory_pool().release_unused()  # the worker lives on


def binary(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The ids from each start to the next as one binary value."""
    width = ids.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer((starts * width).astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())


def width(path: str = VOCABULARY, end: int = END) -> int:
    """Bytes that an id needs in files and shuffles."""
    return 2 if max(Tokenizer.from_file(path).get_vocab_size() - 1, end) < 1 << 16 else 4
