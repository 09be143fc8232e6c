"""Ids of a byte-level BPE tokenizer file.

The file belongs to the tokenizers library, which encodes with offsets and so takes several times as
long as it needs. The tiktoken library gives the same ids where the vocabulary's ids are in the order
of its merges (checked on loading) and where both libraries class a text's characters alike. So it
encodes texts of scripts that Unicode has not changed for long, without very long words or runs of
white space and without the string of an added token (``<|endoftext|>``), which the library makes one id;
all other texts go to the tokenizers library itself.
"""

from __future__ import annotations

import json
import os
import re
from array import array

#: Pre-tokens of byte-level tokenizers of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A character outside long-settled scripts (Latin, Greek, Cyrillic, punctuation, kana, Han, Hangul), or a long run.
_ODD = re.compile("[^\u0000-ɏΑ-ΡΣ-ώЀ-џ‐-‧‰-⁒ぁ-んァ-ヶ一-龥가-힣]|\\S{500}|\\s{200}")


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that tokenizer files of this kind write for bytes."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """Encodes texts to little-endian unsigned 32-bit ids, as the library does without special tokens around."""

    def __init__(self, definition: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(definition)
        spec = json.loads(definition)
        self.fast = self._fast(spec)
        added = "|".join(re.escape(t["content"]) for t in spec.get("added_tokens") or [])
        self.slow = re.compile(f"{_ODD.pattern}|{added}" if added else _ODD.pattern, re.IGNORECASE if self._folds(spec) else 0)

    @staticmethod
    def _folds(spec: dict) -> bool:
        """Whether added tokens are looked for in normalised text, which may have another case."""
        return any(t.get("normalized") for t in spec.get("added_tokens") or [])

    @staticmethod
    def _fast(spec: dict):
        """tiktoken over the same vocabulary, or None where that might differ."""
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        same = spec["normalizer"] is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        letters, vocab = _byte_letters(), model["vocab"]
        if not same or model.get("ignore_merges") or any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
            return None
        import tiktoken

        ranks = {bytes(letters[c] for c in token): k for token, k in vocab.items() if k < 256 + len(merges)}
        return tiktoken.Encoding("shared", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        """The ids of a text; none for null or empty."""
        if not text:
            return b""
        if self.fast is None or self.slow.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast.encode_ordinary(text)).tobytes()
