"""Token ids of whole texts, as the tokenizers and sentencepiece libraries give them.

Byte-pair files are run by a faster encoder that is given the file's own merges: this is done for files
whose steps are known here and whose ids rise with their merges, where both encoders apply the same merges in the same
order. Every other file, and every text that holds the string of an added token, goes to the library itself.

With sentencepiece a text is cut where a single space stands between two other characters: no piece
reaches over such a place, so the counts of the units can be kept and added.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable
from functools import cache
from pathlib import Path

import numpy as np

#: Longest unit that is kept, in characters; longer ones are encoded each time.
LONGEST = 48

#: Fixed value: the pattern by which byte-level files split a text before merging.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: All characters here are lower-cased one by one, are left alone by NFC in any company, and are letters or numbers for both libraries alike.
_LATIN = re.compile(r"[\t-\r -~¡-±´-¸º»¿-įıĴ-ſ]*")
#: What stands apart from letters there: shortened endings, digits, runs of signs. The signs are spelled out; categories are slow.
_LATIN_SIGN = re.compile(r"('(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-@\[-`{-~¡-©«-±´¶-¸»¿×÷]+)")


class TokenizerFile:
    """A file of the tokenizers library. ids(text): the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(Path(path).read_text())
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.fast = _byte_level(spec) or _words(spec)

    def ids(self, text: str) -> bytes:
        if self.fast and not any(a in text for a in self.added):
            found = self.fast(text)
            if found is not None:
                return found.astype("<u4").tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in such files: printable Latin-1 for itself, the others counted up from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}


def _in_order(model: dict) -> bool:
    """Whether the ids of what the merges make rise with the merges, above those of all that no merge makes."""
    made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    return all(a < b for a, b in zip(made, made[1:])) and len(model["vocab"]) == made[0] + len(made) == made[-1] + 1


def _encoder(pattern: str, ranks: dict[bytes, int]) -> Callable[[str], np.ndarray | None]:
    import tiktoken

    encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def run(text: str) -> np.ndarray | None:
        try:
            return np.frombuffer(array("I", encoding.encode_ordinary(text)), np.uint32)
        except (ValueError, RuntimeError):  # its pattern gives up on very long runs of white space
            return None

    return run


def _options(spec: dict) -> dict:
    return {k: v for k, v in spec["model"].items() if k not in ("vocab", "merges", "end_of_word_suffix") and v}


def _byte_level(spec: dict) -> Callable[[str], np.ndarray | None] | None:
    """Files that split by BYTE_LEVEL and merge bytes, with no other step."""
    pre = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec["model"].get("end_of_word_suffix") or _options(spec) != {"type": "BPE"} or not _in_order(spec["model"]):
        return None
    byte = _byte_of()
    return _encoder(BYTE_LEVEL, {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items()})


def _words(spec: dict) -> Callable[[str], np.ndarray | None] | None:
    """Files that lower the case, keep words, single digits and runs of signs, and merge bytes of which the last bears the word's end.

    No word holds a space. So each word is given one behind it, and what in the file is a byte that bears the end is
    here that byte and a space; these come before all merges, so they are put together first.
    """
    steps = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]},
    }
    found = json.loads(json.dumps({k: spec[k] for k in steps}))
    for x in (found["pre_tokenizer"] or {}).get("pretokenizers", []):
        x.pop("trim_offsets", None)
    end = spec["model"].get("end_of_word_suffix")
    if found != steps or not end or _options(spec) != {"type": "BPE"} or not _in_order(spec["model"]):
        return None
    byte, ranks = _byte_of(), {}
    for token, i in spec["model"]["vocab"].items():
        whole = token.endswith(end)
        raw = bytes(byte[c] for c in (token[: -len(end)] if whole else token))
        if b" " not in raw:
            ranks[raw + b" " * whole] = i
    run = _encoder("[^ ]+ ", ranks | {b" ": spec["model"]["vocab"]["Ġ"]})

    def ids(text: str) -> np.ndarray | None:
        if not _LATIN.fullmatch(text):
            return None
        for c in "\t\n\x0b\f\r":
            text = text.replace(c, " ")
        return run(" ".join(_LATIN_SIGN.split(text.lower())) + " ")

    return ids


class PieceFile:
    """A file of the sentencepiece library. count(text): the number of tokens; at most `keep` units are held, a full store starts anew."""

    def __init__(self, path: str, keep: int = 400_000):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.keep, self.known = keep, {}

    def _counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.library.encode(texts, num_threads=1)]

    def count(self, text: str) -> int:
        if not text or "  " in text or text[0] == " " or text[-1] == " " or "▁" in text:
            return self._counts([text])[0]
        units, known = text.split(" "), self.known
        found = [known.get(u) for u in units]
        missing = [u for u, n in zip(units, found) if n is None]
        if not missing:
            return sum(found)
        new = self._counts(missing)
        if len(known) > self.keep:
            known.clear()
        known.update((u, n) for u, n in zip(missing, new) if len(u) <= LONGEST)
        return sum(n for n in found if n is not None) + sum(new)


@cache
def open_file(path: str) -> TokenizerFile | PieceFile:
    """The tokenizer of a file, opened once a process."""
    return PieceFile(path) if path.endswith(".model") else TokenizerFile(path)


def count_tokens(path: str, text: str) -> int:
    found = open_file(path)
    return found.count(text) if isinstance(found, PieceFile) else len(found.ids(text)) // 4


def version(path: str) -> str:
    """Digest of the tokenizer's file and its library's version: counts of another version are never taken."""
    import sentencepiece
    import tokenizers

    library = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    return hashlib.sha256(Path(path).read_bytes() + library.encode()).hexdigest()
