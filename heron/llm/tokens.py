"""Token ids of whole texts by a public tokenizer, shared by packing and token counts."""

from __future__ import annotations

import re

import numpy as np

#: A run of white space of this length or more is beyond the stack of the faster library.
LONG_SPACE = 50_000
_LONG_SPACE = re.compile(rf"\s{{{LONG_SPACE}}}")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones are themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of the vocabulary in a `tokenizers` file of byte-level BPE, without special tokens added.

    Texts are encoded whole. The faster of two public libraries does it with ranks made of the same file: in such a
    vocabulary a merge's rank is its id, so the ids are the same, as tests check. Texts in which the string of a special token
    occurs, texts with LONG_SPACE characters of white space in a row, and texts that the faster library refuses, by an error
    or by a panic, are encoded by the `tokenizers` library itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if token not in self.special}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def widths(self) -> np.ndarray:
        """UTF-8 bytes of each id's text; in a byte-level vocabulary each character of a token stands for a byte."""
        out = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            out[i] = len(token)
        return out

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special) or len(text) >= LONG_SPACE and _LONG_SPACE.search(text):
            return self.plain(text)
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # a panic of the library derives from BaseException only
            if isinstance(e, (ValueError, RecursionError)) or type(e).__name__ == "PanicException":
                return self.plain(text)
            raise

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes of `dtype`; null and empty texts have none."""
        return [np.array(self.ids(t), self.dtype).tobytes() if t else b"" for t in texts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
