"""Token ids by the tokenizers library, each distinct unit of text encoded once.

A text is cut only where its pre-tokenizer always cuts, so the units' ids, joined, are the ids of the whole text. Units
are cached; a plain word with plain punctuation goes straight to the library's BPE model, any other unit through the
whole tokenizer. Where case does not count, many texts at a time are cut and their units numbered by Arrow, and only
distinct words without case and closing punctuation are looked up. A text that holds a special token's own characters is encoded whole, so that the library finds the token
there as it does everywhere. Tokenizers whose rules are not known here encode whole texts.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from . import shared

#: Latin letters that no normalisation form changes, and punctuation that joins no contraction.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = ".,!?;:$%&*#|()-"
PLAIN = re.compile(rf"( ?)([{LETTERS}]*)([{re.escape(MARKS)}]*)")
#: Bytes of letters and digits; characters that may join others to one, beside those that have another case.
ALNUM, JOINING = np.array([chr(b).isalnum() and b < 128 for b in range(256)]), r"[^\x00-\x{2ff}]"
#: A space after white space; a newline beside white space; where units begin for certain, a newline between others being one.
SPACED, LINED, BOUNDARY = re.compile(r" (?<=\s )"), re.compile(r"\n(?:\s|(?<=\s\n))"), re.compile(r"(?<=\S)(?= |\n\S)|(?<=\S\n)(?=\S)")
SEPARATOR = re.compile(r"[\x1c-\x1f]")


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for 256, 257, ..."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder(dict):
    """Maps a unit of text to its ids as little-endian unsigned 32-bit integers; holds at most `units` of them, those
    asked for last: when half are here, they go to `before`, and come back from there as they are asked for."""

    def __init__(self, path: str, units: int = 600_000):
        super().__init__()
        self.tokenizer, self.units, self.before = Tokenizer.from_file(path), units, {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.literals = [a.content for a in added]
        self.model, self.table = self.tokenizer.model, byte_alphabet()
        with open(path) as f:
            rules = json.load(f)
        before, normal = rules.get("pre_tokenizer") or {}, rules.get("normalizer")
        parts = [p.get("type") for p in before.get("pretokenizers", [])]
        self.kind = "whole"
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and normal is None:
            self.kind = "spaced"
        elif parts == ["Split", "ByteLevel"] and normal and {"type": "Lowercase"} in normal.get("normalizers", []) and rules["model"].get("end_of_word_suffix"):
            self.kind = "words"
        if any(a.normalized for a in added):  # such tokens may be spelt in other ways too
            self.kind = "whole"

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.units // 2:
            self.before = self.copy()
            self.clear()
        self[unit] = out = self.before.get(unit) or self.fresh(unit)
        return out

    def fresh(self, unit: str) -> bytes:
        """The ids of a unit that is not held."""
        if self.kind != "whole" and unit.isascii() and unit.isalpha():
            return self.piece(unit)
        plain = PLAIN.fullmatch(unit) if self.kind != "whole" else None
        if plain is None:
            return array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()
        space, word, marks = plain.groups()
        if word and marks:
            word = space + word
            return (self.get(word) or self.before.get(word) or self.piece(word)) + self[marks]
        return self.piece(unit)

    def piece(self, piece: str) -> bytes:
        """The ids of a piece that the pre-tokenizer leaves whole."""
        if self.kind == "words":
            piece = piece.lower()
        shown = piece.replace(" ", self.table[32]) if piece.isascii() else piece.encode().decode("latin-1").translate(self.table)
        return array("I", [t.id for t in self.model.tokenize(shown)] if shown else []).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text."""
        if any(x in text for x in self.literals):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if self.kind == "spaced":
            if "\x00" in text or SPACED.search(text) or LINED.search(text):
                units = BOUNDARY.split(text)
            else:
                units = text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")
        elif self.kind == "words" and not SEPARATOR.search(text):
            units = text.split()
        else:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, units))

    def encode_each(self, texts: pa.Array, last: bytes = b"") -> pa.Array:
        """The ids of many whole texts, null ones being empty, each followed by `last`."""
        if self.kind != "words":
            return pa.array([self.encode(t or "") + last for t in texts.to_pylist()], pa.binary())
        texts = texts.fill_null("")
        alone = np.zeros(len(texts), bool)
        for x in self.literals:
            alone |= np.asarray(pc.match_substring(texts, x))
        cut = pc.ascii_split_whitespace(pc.if_else(pa.array(alone), "", texts) if alone.any() else texts)
        units, ends = cut.flatten().dictionary_encode(), np.cumsum(np.asarray(cut.value_lengths()), dtype=np.int64)
        which = np.insert(np.asarray(units.indices), ends, len(units.dictionary))
        joined = pa.concat_arrays([self.of_units(units.dictionary.cast(pa.string())), pa.array([last], pa.binary())]).take(pa.array(which))
        bounds = starts_of(joined)[np.r_[0, ends + np.arange(1, len(ends) + 1)]]
        out = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(bounds.tobytes()), joined.buffers()[2]])
        if alone.any():
            out = pc.replace_with_mask(out, pa.array(alone), pa.array([self.encode(t) + last for t in texts.filter(pa.array(alone)).to_pylist()], pa.binary()))
        return out

    def of_units(self, units: pa.Array) -> pa.Array:
        """The ids of distinct units without white space, where case does not count."""
        bare = pc.ascii_rtrim(units, characters=MARKS)
        size, kept = np.asarray(pc.binary_length(units)), np.asarray(pc.binary_length(bare))
        first, data = starts_of(units)[:-1], np.frombuffer(units.buffers()[2] or b"", np.uint8)
        # closing punctuation is a piece of its own after a letter or a digit
        marked = np.flatnonzero((kept > 0) & (kept < size))
        at = first[marked] + kept[marked] - 1
        final, lead = data[at], np.where(kept[marked] > 1, data[at - 1], 0)
        marked = marked[ALNUM[final] | ((lead == 0xC3) & (final >= 0x80) & (final != 0x97) & (final != 0xB7))]
        choice = np.zeros(len(units), bool)
        choice[marked] = True
        words = pc.if_else(pa.array(choice), bare, units)
        lower = pc.ascii_lower(words)
        keep = pc.match_substring_regex(words, JOINING)
        for x in self.literals:
            keep = pc.or_(keep, pc.match_substring(lower, x))
        ids = self.looked_up(pc.if_else(keep, words, lower))
        if not len(marked):
            return ids
        lengths = (size - kept)[marked]
        begin = np.r_[0, np.cumsum(lengths)]
        closing = data[np.repeat(first[marked] + kept[marked] - begin[:-1], lengths) + np.arange(begin[-1])]
        marks = pa.Array.from_buffers(pa.string(), len(marked), [None, pa.py_buffer(begin.astype("<i4").tobytes()), pa.py_buffer(closing.tobytes())])
        choice = np.zeros(len(units), np.int64)
        choice[marked] = np.arange(1, len(marked) + 1)
        after = pa.concat_arrays([pa.array([b""], pa.binary()), self.looked_up(marks)]).take(pa.array(choice))
        return pc.binary_join_element_wise(ids, after, b"")

    def looked_up(self, units: pa.Array) -> pa.Array:
        """The ids of units, each distinct one looked up once."""
        coded = units.dictionary_encode()
        return pa.array([self[u] for u in coded.dictionary.to_numpy(zero_copy_only=False)], pa.binary()).take(coded.indices)


def starts_of(values: pa.Array) -> np.ndarray:
    """Where each value of a string or binary array begins in its data, and where the last one ends."""
    return np.frombuffer(values.buffers()[1], "<i4", len(values) + 1, 4 * values.offset) if len(values) else np.zeros(1, "<i4")


def encoder(name: str) -> Encoder:
    """The encoder of a vocabulary file, given by path or by its name among the public tokenizers."""
    return shared.held(("encoder", name), lambda: Encoder(name if "/" in name else public_tokenizers.path(name)))
