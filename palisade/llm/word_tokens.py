"""Token ids of whole texts by a vocabulary file of the tokenizers library, with words remembered."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from string import punctuation

import numpy as np
import pyarrow as pa

from palisade.llm import text as tx
from palisade.llm.language_id import folded

#: Words remembered by a Python worker; a full generation replaces the one before.
CACHE_ENTRIES = 160_000
#: Letters below have one letter as lower case, and stay as they are when normalised.
LATIN_END = "\u0130"
#: Bytes that part words: space and line end.
_CUTS = np.zeros(256, bool)
_CUTS[[0x20, 0x0A]] = True


class WordEncoder:
    """Encoder for byte-level vocabularies that drop white space and case, and whose pattern takes runs of letters,
    single digits, and runs of other characters.

    Then the ids of a text are those of its words in order.  Words are found by splitting at spaces and
    line ends; a word that still holds other white space is simply a longer one.  A text that holds the string of an
    added token is encoded by the library as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor share its cores
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(re.escape(t.lower().encode()) for t in added)) if added else None
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.symbols: dict[str, bytes] = {}
        letters = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = {
            c: letters.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, ord(LATIN_END)) if chr(c).isalpha()
        }

    def _letters(self, word: str) -> bytes:
        """Ids of a word of Latin letters in lower case: one match of the vocabulary's pattern, which its model splits."""
        spelled = word if word.isascii() else word.translate(self.spelling)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()

    def _encode(self, word: str) -> bytes | None:
        """Ids of a word of Latin letters with some ASCII symbols behind, as most are; None for any other.  The pattern never
        matches letters together with symbols behind them, unless an apostrophe and letters follow: both are encoded alone."""
        core = word.rstrip(punctuation)
        if not core.isalpha() or (not core.isascii() and max(core) >= LATIN_END):
            return None
        ids = self._letters(core.lower())
        if len(core) == len(word):
            return ids
        behind = word[len(core) :]
        known = self.symbols.get(behind)
        if known is None:
            if len(self.symbols) > CACHE_ENTRIES:
                self.symbols.clear()
            known = array("I", self.tokenizer.encode(behind, add_special_tokens=False).ids).tobytes()
            self.symbols[behind] = known
        return ids + known

    def _ids_of(self, keys: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self.new) > CACHE_ENTRIES:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        found = list(map(new.get, keys))
        rest = {}
        for i, ids in enumerate(found):
            if ids is None:
                ids = old.get(keys[i])
                if ids is None:
                    word = keys[i].decode()
                    ids = self._encode(word)
                    if ids is None:
                        rest[i] = word
                        continue
                found[i] = new[keys[i]] = ids
        encoded = self.tokenizer.encode_batch_fast(list(rest.values()), add_special_tokens=False)
        for i, e in zip(rest, encoded, strict=True):
            found[i] = new[keys[i]] = array("I", e.ids).tobytes()
        return found

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers of this machine; null has none.

        Distinct words (of bytes in lower case) are found for all of them at once and looked up as they are; only
        unknown ones become strings."""
        array_of = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        bounds, data = tx._bounds(array_of)
        data = folded(data[bounds[0] : bounds[-1]])
        words = tx.words_between(data, bounds - bounds[0], _CUTS)
        codes = tx.coded(words, _CUTS)
        ids, behind = tx.expanded(np.asarray(codes.indices), self._ids_of(codes.dictionary.to_pylist()), np.uint32)
        cuts = (np.concatenate([[0], behind])[words.offsets] * 4).tolist()
        out = ids.tobytes()
        found = [out[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if self.added is not None:
            places = [m.start() for m in self.added.finditer(data.tobytes())]
            # The library splits a text at the strings of added tokens before anything else: such texts go to it whole.
            for i in np.unique(np.searchsorted(bounds - bounds[0], places, "right") - 1).tolist():
                text = array_of[i].as_py() or ""
                found[i] = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return found


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encoded_batches(batches, path: str):
    """(batch, ids of each of its texts) for slices of bounded text size."""
    coder = encoder(path)
    for batch in batches:
        texts = tx.string_column(batch, "text")
        for a, b in tx.chunks(texts, tx.CHUNK_BYTES * 3 // 2):
            yield batch.slice(a, b - a), coder.encode(texts.slice(a, b - a))
