"""A byte-level BPE vocabulary, read from the JSON file of a public tokenizer.

The file's content is small (a few MB) and travels to the executors as a broadcast, so no executor
needs the path.  Only what the methods here rely on is accepted: byte-level pieces cut by the
library's own pattern, no normaliser, merges in the order of the ids they make.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cache, lru_cache

import regex

#: Fixed value: the pattern that cuts text into pieces before any merge.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    letters.update({chr(256 + n): b for n, b in enumerate(rest)})
    return letters


@dataclass
class Vocabulary:
    tokens: dict[int, bytes]
    ids: dict[bytes, int]
    merges: dict[int, int]
    parts: dict[int, tuple[int, int]]
    specials: dict[str, int]
    piece: regex.Pattern = field(default_factory=lambda: regex.compile(PIECES))

    def __post_init__(self):
        marks = sorted(self.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.margin = max(map(len, marks), default=0) + 2

    def segments(self, text: str) -> list[str]:
        """Text between special strings, and the special strings themselves."""
        return [s for s in self.special.split(text) if s] if self.special else [text][: bool(text)]


def pair(left: int, right: int) -> int:
    return left << 32 | right


@lru_cache(maxsize=4)
def parse(content: bytes) -> Vocabulary:
    spec = json.loads(content)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    fits = (
        model.get("type") == "BPE"
        and spec.get("normalizer") is None
        and cut.get("type") == "ByteLevel"
        and cut.get("use_regex", True)
        and not cut.get("add_prefix_space")
        and not any(model.get(k) for k in ("dropout", "unk_token", "ignore_merges", "byte_fallback"))
        and not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
    )
    if not fits:
        raise ValueError("only plain byte-level BPE vocabularies are supported")
    letters = _byte_letters()
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ids = {bytes(letters[c] for c in token): n for token, n in model["vocab"].items() if token not in specials}
    named = model["vocab"]
    merges, parts, newest = {}, {}, -1
    for entry in model["merges"]:
        left, right = entry if isinstance(entry, list) else entry.split(" ")
        made = named[left + right]
        if made <= newest or made in parts:
            raise ValueError("merges are not in the order of the ids they make")
        newest = made
        merges[pair(named[left], named[right])] = made
        parts[made] = (named[left], named[right])
    tokens = {n: t for t, n in ids.items()} | {n: s.encode() for s, n in specials.items()}
    return Vocabulary(tokens, ids, merges, parts, specials)


@cache
def content(path: str) -> bytes:
    """The file, read on the driver."""
    with open(path, "rb") as f:
        return f.read()
