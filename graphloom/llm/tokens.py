"""Token ids of the public word-end BPE vocabulary, with the words of a worker remembered.

The ids are those of tokenizers' Tokenizer.from_file(...).encode(text, add_special_tokens=False). White space never
lies within a token, so a text's ids are those of its parts between white space, one after another; each new part is
encoded once by a byte-pair encoder over the same vocabulary (tiktoken's, with the end of a word as one more byte), which
is about ten times as fast. Texts in which the two could differ are left to tokenizers: those with the vocabulary's added
strings, which are one id wherever they stand; with characters that one of the two treats as white space, or that stand
for the end of a word; and with code points that aren't assigned in this Python's Unicode tables, which the two libraries
don't class alike.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: how the vocabulary's tokenizer file splits words.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
END, END_OF_WORD = "\x01", "</w>"
MARKED = r"\g<0>" + END
CONTROLS = "[\x01\x1c-\x1f]"
#: Words that a worker remembers at most; then it begins anew.
REMEMBERED = 100_000


def byte_of_char() -> dict[str, int]:
    """The usual printable stand-ins for bytes in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordTokenizer:
    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"] for x in spec["added_tokens"]}
        self.apart = regex.compile("|".join([CONTROLS, *map(regex.escape, sorted(special))]))
        chars, ranks = byte_of_char(), {}
        for token, rank in spec["model"]["vocab"].items():
            if token not in special:
                ends = token.endswith(END_OF_WORD) and token != END_OF_WORD
                body = token[: -len(END_OF_WORD)] if ends else token
                ranks[bytes(chars[c] for c in body) + END.encode() * ends] = rank
        self.fast = tiktoken.Encoding("word_bpe", pat_str=f"[^{END}]*{END}", mergeable_ranks=ranks, special_tokens={})
        self.last = np.zeros(max(ranks.values()) + 1, bool)  # ids that end a word
        self.last[[i for token, i in ranks.items() if token.endswith(END.encode())]] = True
        del spec, ranks
        self.known: dict[str, bytes | None] = {}

    def learn(self, parts: list[str]) -> None:
        """Remembers the ids of parts, of all by one call of the encoder; None for those that only tokenizers can tell."""
        low = unicodedata.normalize("NFC", "\n".join(parts))
        low = "".join(map(str.lower, low)) if "Σ" in low else low.lower()
        marked = WORD.sub(MARKED, low)  # each word with its end
        ids = np.array(self.fast.encode_ordinary(marked.replace("\n", "")), "<u4")
        edge = np.concatenate(([0], np.flatnonzero(self.last[ids]) + 1))  # where words begin
        counts = np.array([x.count(END) for x in marked.split("\n")], np.int64)
        at = (4 * edge[np.concatenate(([0], np.cumsum(counts)))]).tolist()
        data = ids.tobytes()
        self.known.update(zip(parts, [data[i:j] for i, j in zip(at, at[1:])]))
        if not low.isascii() and (odd := {c for c in set("".join(parts)) if unicodedata.category(c) == "Cn"}):
            self.known.update((x, None) for x in parts if not odd.isdisjoint(x))

    def ids_of(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text's ids as little-endian unsigned 32-bit numbers; null: none."""
        apart = [bool(t and self.apart.search(t)) for t in texts]
        split = [t.split() if t and not a else [] for t, a in zip(texts, apart)]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        if new := list(dict.fromkeys(x for parts in split for x in parts if x not in known)):
            self.learn(new)
        out = []
        for text, parts, a in zip(texts, split, apart):
            found = [known[x] for x in parts]
            whole = a or None in found
            out.append(np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4") if whole else np.frombuffer(b"".join(found), "<u4"))
        return out

    def ids(self, text: str | None) -> np.ndarray:
        return self.ids_of([text])[0]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process."""
    return WordTokenizer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
