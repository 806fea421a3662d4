"""Byte-level BPE on single pre-tokens, cached per Python worker.

A tokenizer file's merges act inside one pre-token at a time. So a text's tokens are the
tokens of its pre-tokens, and each distinct pre-token needs the merges only once.
Pre-tokens of texts made of ASCII and Latin-1 letters are found with ``re`` patterns that
equal the file's pattern there; any other text goes through the library's own splitter.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from .common import token_file

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A text without such a character is cut by the patterns below exactly as by the file's.
UNUSUAL = re.compile(f"[^\t-\r -~{LETTER}]")
# FIXED VALUES: the pre-token patterns of the two public vocabularies, as their files state
# them, beside the forms used on plain texts.
SPACED = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+")
SPACELESS_SOURCE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACELESS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^\s{LETTER}0-9]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies:
    printable Latin-1 characters stand for themselves, the others for 256, 257, ..."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


ALPHABET = byte_alphabet()
TABLE = dict(enumerate(ALPHABET))
BYTES = {c: b for b, c in enumerate(ALPHABET)}


class Bpe:
    """One tokenizer file in one worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        file = token_file(path)
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(file)
        self.model = self.tok.model
        self.specials = [t["content"] for t in spec["added_tokens"]]
        #: Special strings cut the raw text wherever they stand.
        self.plain_specials = not any(t[k] for t in spec["added_tokens"]
                                      for k in ("single_word", "lstrip", "rstrip", "normalized"))
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        steps = pre.get("pretokenizers", [])
        #: Pre-tokens with a leading space, over the raw text.
        self.spaced = pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and norm is None
        #: White space is dropped, so words between white space are independent.
        self.spaceless = bool(steps) and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
        self.known_split = self.spaceless and steps[0]["pattern"].get("Regex") == SPACELESS_SOURCE \
            and [n["type"] for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]

    def pieces(self, pretoken: str) -> list:
        """The tokens of one raw pre-token."""
        return self.model.tokenize(pretoken.encode().decode("latin-1").translate(TABLE))

    def pretokens(self, text: str) -> list[str]:
        """The raw pre-tokens of a text that holds no special string."""
        if not UNUSUAL.search(text):
            return SPACED.findall(text)
        return [bytes(map(BYTES.__getitem__, s)).decode() for s, _ in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def plain(self, text: str) -> bool:
        """Whether ``SPACELESS`` cuts the text's lower-case form exactly as the file does (``known_split`` files)."""
        return not UNUSUAL.search(text) and not any(s in text for s in self.specials)


@lru_cache(maxsize=4)
def bpe(path: str) -> Bpe:
    """The file's tokenizer, kept for the life of the Python worker."""
    return Bpe(path)
