"""Token ids of whole texts by the ``tokenizers`` library.

The library drops white space before it looks at anything else and never joins
across it, so the ids of a text are the ids of its words (runs of other than
ASCII white space), one after the other. A batch of texts is split and its
words made distinct in Arrow; only distinct words are looked at in Python, and
the ids of all texts are gathered from theirs in one pass.

Where the tokenizer lower-cases and parts letters from punctuation, a word of
Latin letters, with marks after it, is the ids of its lower-cased letters, the
stem, and those of the marks. Whether it does so is tried out, not assumed. Each Python worker keeps the ids of the stems it has
met, up to a fixed number, and sends the library only others, many in a text.
A special token's name in a text is that token, as the library has it.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stems, and marks and other words, that a worker keeps, of about 200 bytes
#: each. Frequent ones are met early; those that come when it is full are looked
#: up for their batch.
KEPT, KEPT_OTHERS = 500_000, 100_000
MODEL = "word_bpe_49k.json"
_STEM = "^[A-Za-zÀ-ÖØ-öø-ÿ]+"
#: ASCII punctuation but the apostrophe, which can begin a word of its own.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_TRIAL = ("Straße", "ÀÉÎÕÜß", "The", "éàÿ", "Ñandú", "I", "won", "aujourdhui", "ÅØÞ")
_TRIAL_MARKS = ("", ".", ",", "!!", "###", "%%%.", "-_", '")', ";:", "<|>", "/\\")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Whole texts to ids, a batch at a time."""

    def __init__(self, path: str, kept: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept, self.stems, self.others = kept, {}, {}
        self.ends = None
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
            self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(suffix)]] = True
            stems = [w.lower() for w in _TRIAL]
            whole = [a + b for a in self._each(stems) for b in self._each(list(_TRIAL_MARKS))]
            if whole != self._each([w + m for w in _TRIAL for m in _TRIAL_MARKS]) or self._together(stems) != self._each(stems):
                self.ends = None

    def _each(self, words: list[str]) -> list[bytes]:
        return [array("I", found.ids).tobytes() for found in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, stems: list[str]) -> list[bytes]:
        """The ids of stems, sent as one text. The last token of a stem, and no
        other, ends a word; were that not so, they are sent one by one."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(stems)], add_special_tokens=False)[0].ids, "<u4")
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(stops) != len(stems):
            return self._each(stems)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def _of_stems(self, stems: list[str]) -> list[bytes]:
        found = list(map(self.stems.get, stems))
        missing = [i for i, x in enumerate(found) if x is None]
        for at in range(0, len(missing), 1000):
            part = missing[at : at + 1000]
            got = self._together([stems[i] for i in part])
            for i, ids in zip(part, got, strict=True):
                found[i] = ids
            if len(self.stems) < self.kept:
                self.stems.update(zip((stems[i] for i in part), got, strict=True))
        return found

    def _of_others(self, words: list[str]) -> list[bytes]:
        missing = [w for w in words if w not in self.others]
        got = dict(zip(missing, self._each(missing), strict=True))
        if len(self.others) < KEPT_OTHERS:
            self.others.update(got)
            return [self.others[w] for w in words]
        return [got[w] if w in got else self.others[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, unsigned 32-bit, and where each text's begin
        (with the end of the last). Null counts as empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        words = split.flatten().dictionary_encode()
        distinct, place = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
        ids: np.ndarray = np.empty(len(distinct), object)
        plain = np.zeros(len(distinct), bool)
        if self.ends is not None and len(distinct):
            bare = pc.utf8_rtrim(distinct, characters=_MARKS)
            plain = pc.match_substring_regex(bare, _STEM + "$").to_numpy(zero_copy_only=False)
            stems = pc.utf8_lower(bare.filter(pa.array(plain))).dictionary_encode()
            ids[plain] = _objects(self._of_stems(stems.dictionary.to_pylist()))[stems.indices.to_numpy(zero_copy_only=False)]
            marked = plain & pc.not_equal(pc.binary_length(distinct), pc.binary_length(bare)).to_numpy(zero_copy_only=False)
            marks = pc.replace_substring_regex(distinct.filter(pa.array(marked)), _STEM, "").dictionary_encode()
            ids[marked] += _objects(self._of_others(marks.dictionary.to_pylist()))[marks.indices.to_numpy(zero_copy_only=False)]
        ids[~plain] = _objects(self._of_others(distinct.filter(pa.array(~plain)).to_pylist()))
        each = ids.tolist()
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(map(each.__getitem__, place.tolist())), "<u4")
        stop = np.concatenate(([0], np.cumsum(size[place])))
        return flat, stop[split.offsets.to_numpy(zero_copy_only=False) - split.offsets[0].as_py()]


def _objects(values: list[bytes]) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)
