"""Splitting of texts for byte-level BPE vocabularies, shared by token counts and token output."""

from __future__ import annotations

import json

import regex

#: White space as the tokenizers library understands it in ``\s`` (fixed values).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The public pre-token pattern of this vocabulary family, with that white space (fixed values).
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: White space other than the space; the part of it outside ASCII.
OTHER_ASCII = "\t\n\v\f\r"
OTHER_WIDE = regex.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in such vocabulary files, inverted."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load(path: str) -> dict:
    """Vocabulary, merges as (left id, right id) -> (rank, merged id), ids of bytes and special strings."""
    spec = json.load(open(path, encoding="utf-8"))
    model = spec["model"]
    vocab = model["vocab"]
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    return {"vocab": vocab, "merges": merges, "bytes": {b: vocab[c] for c, b in byte_symbols().items()}, "special": special}


def special_pattern(special: dict[str, int]):
    """Matches a special string; the longest wins where several begin."""
    return regex.compile("|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None


class Inner(str):
    """A chunk that stands for itself; plain strings stand for themselves behind a space."""

    __slots__ = ()

    def __eq__(self, other):
        return isinstance(other, Inner) and str.__eq__(self, other)

    def __hash__(self):
        return ~str.__hash__(self)


def spelled(chunk: str) -> str:
    return str(chunk) if isinstance(chunk, Inner) else f" {chunk}"


def chunks(section: str) -> list[str]:
    """Cuts a text where pre-tokens surely end: at single spaces between other characters, else at pre-tokens."""
    if not section:
        return []
    uneven = section[0] == " " or section[-1] == " " or "  " in section or any(f"{w} " in section or f" {w}" in section for w in OTHER_ASCII)
    if uneven or not section.isascii() and OTHER_WIDE.search(section):
        return [Inner(x) for x in PRETOKEN.findall(section)]
    words = section.split(" ")
    words[0] = Inner(words[0])
    return words
