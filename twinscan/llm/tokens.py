"""Token ids of whole texts by a public tokenizer file, memoised by white-space chunk.

A tokenizer whose pre-tokens never hold white space maps a text to the concatenation of the ids of
its chunks between white space. So the library encodes each distinct chunk once per worker and the
ids are joined as bytes. The memo has two generations of bounded size; what is asked for again
moves into the young one. Texts in which chunks could not be told apart alike by ``str.split`` and
the tokenizer (control separators, special-token strings) are encoded by the library as a whole.

Most new chunks are Latin letters, perhaps with punctuation behind. Normalising and splitting such
a chunk is known beforehand (lower case; the letters are one pre-token, the rest another), so their
letters go through the library's model joined into long texts, without its normaliser and splitter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: Letters whose lower case depends on the library or on what stands beside them.
_CASED = ("\u03a3", "\u0130")
#: Up to here, letters are alike in all Unicode versions and composed already.
_LATIN = "\u0250"
_MARKS = ".,;:!?#$%&*|\"()[]{}<>/\\=+-_~^@`"
_IDS = np.dtype("<u4")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """``ids(texts)`` yields each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, memo: int = 1_600_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary = self.library.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.half = memo // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, _IDS).tobytes() for x in found]

    def _runs(self, runs: list[str]) -> list[bytes]:
        """Ids of strings that are one pre-token each, lower case already."""
        ids = np.asarray(self.letters.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, _IDS)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(runs):
            return self.whole(runs)
        held, at = ids.tobytes(), [0, *(ends * 4).tolist()]
        return [held[i:j] for i, j in zip(at, at[1:], strict=False)]

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of ``chunks``, among others; the memo may lose other entries."""
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        runs: set[str] = set()
        joined, other = [], []
        for x in chunks.difference(young):
            got = old.get(x)
            if got is not None:
                young[x] = got
                continue
            core = x.rstrip(_MARKS)
            if (core.islower() and core.isalpha() and (core.isascii() or max(core) < _LATIN)) or not core:
                joined.append((x, core, x[len(core) :]))
                runs.add(core)
                runs.add(x[len(core) :])
            else:
                other.append(x)
        runs.discard("")
        new = list(runs.difference(young))
        for i in range(0, len(new), 8192):
            young.update(zip(new[i : i + 8192], self._runs(new[i : i + 8192]), strict=True))
        for x, core, rest in joined:
            if core and rest:
                young[x] = young[core] + young[rest]
        for i in range(0, len(other), 4096):
            part = other[i : i + 4096]
            young.update(zip(part, self.whole(part), strict=True))
        return young

    def ids(self, texts: Iterable[str | None], characters: int = 1 << 20) -> Iterator[bytes]:
        """A null text counts as empty. Works through about ``characters`` at a time."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= characters:
                yield from self._some(held)
                held, size = [], 0
        yield from self._some(held)

    def _some(self, texts: list[str]) -> Iterator[bytes]:
        split = []
        for text in texts:
            if any(x in text for x in _ODD):
                split.append(None)
            else:
                split.append((text if any(x in text for x in _CASED) else text.lower()).split())
        known = self._learn(set(chain.from_iterable(x for x in split if x)))
        for text, chunks in zip(texts, split, strict=True):
            yield self.whole([text])[0] if chunks is None else b"".join(map(known.__getitem__, chunks))


_HELD: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process and file."""
    if path not in _HELD:
        _HELD[path] = WordTokenizer(path)
    return _HELD[path]
