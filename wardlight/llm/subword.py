"""Token ids of the 49k word vocabulary, at the speed bulk packing needs.

The vocabulary file belongs to ``tokenizers``, and its ids are the ones returned
here. Words are split into the pieces that library's rules give, each distinct
word once per Python worker, and the pieces are merged by ``tiktoken``'s byte-pair
merger, which takes the same merges as ranks; the end-of-word mark is a space,
which no piece holds. Texts outside ASCII and Latin-1 letters go to
``tokenizers`` itself, since its Unicode rules apply there; so do, if asked for,
texts that hold the content of an added token.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
HELD_WORDS = 400_000  # distinct words a worker remembers before it starts afresh
PLAIN = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÿ]")
# fixed values: the split rule of the vocabulary file, for ASCII and Latin-1
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in the vocabulary file: printable bytes
    stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Subwords:
    """``ids(text)`` as an int32 array, equal to the library's ids."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        added = self.exact.get_added_tokens_decoder()
        # the library may look for them in lower-cased text
        self.added = re.compile("|".join(re.escape(t.content) for t in added.values()) or r"(?!)", re.I)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()

        def raw(token: str) -> bytes:
            ended = token.endswith("</w>")
            return bytes(letters[c] for c in (token[:-4] if ended else token)) + b" " * ended

        ranks = {bytes([b]): b for b in range(256)}
        for b in range(256):
            ranks[bytes([b, 32])] = len(ranks)
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ranks.setdefault(raw(left + right), len(ranks))
        self.number = np.full(len(ranks), -1, np.int32)
        for token, number in model["vocab"].items():
            if not token.startswith("<|") and raw(token) in ranks:
                self.number[ranks[raw(token)]] = number
        self.merge = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(len(ranks), bool)
        self.ends[[n for raw_, n in ranks.items() if raw_.endswith(b" ")]] = True
        self.size = max([*model["vocab"].values(), *added]) + 3
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.starts = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _learn(self, new: list[str]) -> None:
        cut = list(map(PIECES.findall, new))
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        # every piece ends with the mark, and so does its last id
        found = np.array(self.merge.encode_ordinary(" ".join(chain.from_iterable(cut)) + " "), np.int64)
        ends = np.concatenate(([0], np.flatnonzero(self.ends[found]) + 1))
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self.starts = np.append(self.starts, self.starts[-1] + ends[np.cumsum(counts)])
        self.flat = np.append(self.flat, self.number[found])

    def flat_ids(self, texts: list[str], added: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has. With ``added``, an added
        token's content in a text is that token, as the library has it by default; without, it is
        spelled like other text."""
        from wardlight.llm.common import ranges

        plain, whole = [], {}
        self.exact.encode_special_tokens = not added
        other = PLAIN.search
        for i, text in enumerate(texts):
            if other(text) or (added and self.added.search(text)):
                whole[i] = np.array(self.exact.encode(text, add_special_tokens=False).ids, np.int32)
                plain.append("")
            else:
                plain.append(text.lower())
        # no piece reaches over white space, so words are told apart first, without an object for each
        words = pc.ascii_split_whitespace(pa.array(plain, pa.large_string()))
        counts = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        missing = [w for w in own if w not in self.index]
        if len(self.index) + len(missing) > HELD_WORDS:
            self.clear()
            missing = own
        if missing:
            self._learn(missing)
        place = np.fromiter(map(self.index.__getitem__, own), np.int64, len(own))
        at = place[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else place
        first, length = self.starts[at], self.starts[at + 1] - self.starts[at]
        flat = self.flat[ranges(first, length)]
        sizes = np.diff(np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(counts)))])
        if not whole:
            return flat, sizes
        begin = np.cumsum(sizes) - sizes
        held, done = [], 0
        for i, ids in whole.items():
            held += [flat[done : begin[i]], ids]
            done = begin[i]
            sizes[i] = len(ids)
        return np.concatenate([*held, flat[done:]]), sizes

    def word_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words ``data[starts[i]:ends[i]]`` (bytes of UTF-8 without white space), as :meth:`flat_ids`
        finds them, without an object for each word."""
        from wardlight.llm.common import ranges

        width = ends - starts
        at = np.concatenate(([0], np.cumsum(width + 1)))  # a line break after each
        raw = np.full(int(at[-1]), 10, np.uint8)
        raw[ranges(at[:-1], width)] = data[ranges(starts, width)]
        # characters and not bytes are counted: bytes within a character are left out
        chars = np.diff(np.concatenate(([0], np.cumsum(raw & 0xC0 != 0x80)))[at]) - 1
        text = raw.tobytes().decode()
        begin = np.concatenate(([0], np.cumsum(chars + 1)))
        odd = np.unique(np.searchsorted(begin, [m.start() for m in PLAIN.finditer(text)], "right") - 1)
        words = {i: text[begin[i] : begin[i] + chars[i]] for i in odd.tolist()}
        if words:  # left empty here
            keep, done = [], 0
            for i in odd.tolist():
                keep.append(text[done : begin[i]])
                done = begin[i] + chars[i]
            text, chars = "".join([*keep, text[done:]]), chars.copy()
            chars[odd] = 0
        pieces = PIECES.findall(text.lower())
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        own = coded.dictionary.to_pylist()
        found = np.array(self.merge.encode_ordinary(" ".join(own) + " ") if own else [], np.int64)
        stops = np.concatenate(([0], np.flatnonzero(self.ends[found]) + 1))
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        length = np.diff(stops)[which]
        flat = self.number[found][ranges(stops[which], length)]
        # where a word's pieces end, in characters
        until = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        last = np.searchsorted(until, np.cumsum(chars), "right")
        sums = np.concatenate(([0], np.cumsum(length)))[last]
        sizes = np.diff(np.concatenate(([0], sums)))
        if not words:
            return flat, sizes
        self.exact.encode_special_tokens = True
        held, done = [], 0
        for i, word in words.items():
            ids = np.array(self.exact.encode(word, add_special_tokens=False).ids, np.int32)
            held += [flat[done : sums[i]], ids]
            done, sizes[i] = sums[i], len(ids)
        return np.concatenate([*held, flat[done:]]), sizes

    def many(self, texts: list[str], added: bool = False) -> list[np.ndarray]:
        """Ids of each text, as :meth:`flat_ids` finds them."""
        flat, sizes = self.flat_ids(texts, added)
        return np.split(flat, np.cumsum(sizes)[:-1]) if len(texts) else []


@lru_cache(maxsize=1)
def subwords(path: str | None = None) -> Subwords:
    """One per Python worker."""
    return Subwords(path or vocabulary_path())
