"""Word-level front of the BPE tokenizers: split a text as the tokenizers library does, and
encode each distinct word once through the library's BPE model.

A text is cut at special tokens, normalised and split by the file's pattern; the words are then
independent of each other, so that the ids of a text are the ids of its words in turn. Files of
another make than the two known ones are refused, never approximated.
"""

from __future__ import annotations

import json
import re
import unicodedata

import regex
from tokenizers import Tokenizer

#: Distinct words that a worker remembers; beyond it the memory is emptied and filled anew.
MEMO_WORDS = 400_000

#: Texts of these characters only take the faster standard-library pattern.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ſ]*")
_LETTER = r"A-Za-zÀ-ÖØ-öø-ſ"
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d"
_SPACED = rf"{_CUTS}| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+"
_BARE = rf"{_CUTS}|[{_LETTER}]+|[0-9]|[^\s{_LETTER}0-9]+"
_SPACED_ANY = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BARE_ANY = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The pattern as the file states it, for comparison.
_BARE_FILE = _BARE_ANY


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (chr(256 + i) for i in range(256 - len(shown)))
    return [chr(b) if b in shown else next(hidden) for b in range(256)]


class Words(dict):
    """Ids of words as little-endian unsigned 32-bit integers; a missing word is encoded."""

    def __init__(self, model, special: dict[str, int]):
        super().__init__()
        self.model, self.alphabet = model, dict(enumerate(byte_alphabet()))
        self.special = {k: v.to_bytes(4, "little") for k, v in special.items()}

    def encode(self, word: str) -> bytes:
        mapped = word.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        ids = self.special[word[1:]] if word[:1] == "\0" and word[1:] in self.special else self.encode(word)
        self[word] = ids
        return ids


class WordBpe:
    """Splits and encodes as the tokenizer file's JSON text says."""

    def __init__(self, spec: str):
        self.tokenizer, made = Tokenizer.from_str(spec), json.loads(spec)
        front, self.special = made["pre_tokenizer"], {x["content"]: x["id"] for x in made["added_tokens"]}
        plain_specials = all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in made["added_tokens"])
        rule = made["normalizer"]
        if front["type"] == "ByteLevel" and front["use_regex"] and not front["add_prefix_space"] and rule is None:
            self.fold, fast, full = False, _SPACED, _SPACED_ANY
        elif (
            front["type"] == "Sequence"
            and [x["type"] for x in front["pretokenizers"]] == ["Split", "ByteLevel"]
            and front["pretokenizers"][0]["pattern"] == {"Regex": _BARE_FILE}
            and [x["type"] for x in rule["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        ):
            self.fold, fast, full = True, _BARE, _BARE_ANY
        else:
            raise ValueError("a tokenizer file of an unknown make")
        if not plain_specials or made["post_processor"] is not None or made["model"]["dropout"]:
            raise ValueError("a tokenizer file of an unknown make")
        self.fast, self.full = re.compile(fast).findall, regex.compile(full).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words = Words(self.tokenizer.model, self.special)

    def normal(self, text: str) -> str:
        if _PLAIN.fullmatch(text):
            return text.lower()
        if "Σ" not in text and "İ" not in text and unicodedata.is_normalized("NFC", text) and not _ODD.search(text):
            return text.lower()
        return self.tokenizer.normalizer.normalize_str(text)

    def _segment(self, text: str) -> list[str]:
        if self.fold:
            text = self.normal(text)
        return self.fast(text) if _PLAIN.fullmatch(text) else self.full(text)

    def split(self, text: str) -> list[str]:
        """The words in order; a special token is its text after a NUL."""
        if "<|" not in text:
            return self._segment(text)
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            out += ["\0" + part] if i % 2 else self._segment(part)
        return out

    def ids(self, text: str) -> bytes:
        """All ids of a text, four bytes each."""
        return b"".join(map(self.words.__getitem__, self.split(text)))


#: Characters outside the plain ones that the pattern and lower-casing may treat in a way of
#: their own; such texts are normalised by the library itself.
_ODD = re.compile(r"[^\x00-ɏḀ-ỿ -⁯₠-₿]")

_made: dict[int, WordBpe] = {}


def word_bpe(spec: str) -> WordBpe:
    """One per Python worker and file."""
    found = _made.get(hash(spec))
    if found is None:
        found = _made[hash(spec)] = WordBpe(spec)
    return found


def tokenizer_file(name: str) -> str:
    """The JSON text of a public tokenizer file; read once on the driver, bounded by the file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()
