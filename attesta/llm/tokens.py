"""Token ids by the tokenizers library, and packing and binary files of them.

``TextEncoder`` gives a text's ids as little-endian unsigned 32-bit bytes.  It cuts a text where the tokenizer's own
first split always cuts (before a lone space, between a run of letters and digits and what follows), encodes each
distinct piece once, as long as it is remembered, and joins the pieces' ids; texts with characters beyond Latin,
and texts that hold the literal of an added token (<|endoftext|>, which becomes that token's id), are encoded whole.
"""

from __future__ import annotations

import re

import numpy as np

#: Pieces: letters and digits with the space before them; one newline; a rest up to white space; odd white space with what follows.
PIECE = re.compile(r" ?[^\W_]++(?!')|\n(?=\S)| ?\S+|\s+\S*")
BEYOND_LATIN = re.compile("[^\x00-ɏ]")
BYTE_BPE = "byte_bpe_50k.json"


def _classes() -> bytes:
    """a: letter or digit of Latin; p: one-byte punctuation; space and newline: themselves; q: apostrophe; x: anything else."""
    out = bytearray(b"x" * 256)
    for c in range(0x21, 0x7F):
        out[c] = ord("a" if chr(c).isalnum() else "p")
    for c in [*range(0x80, 0xC0), *range(0xC3, 0xCA)]:
        out[c] = ord("a")
    out[0x20], out[0x0A], out[0x27] = 0x20, 0x0A, ord("q")
    return bytes(out)


_CLASS = _classes()
#: Where none of these occurs, each comma, stop, space and newline begins a piece.
_CROSS = (b"x", b"q", b"pp", b" p", b"  ", b" \n", b"\n ", b"\n\n")


def pieces(t: str) -> list[str]:
    kinds = t.encode("utf-8").translate(_CLASS)
    if any(x in kinds for x in _CROSS) or "\u00d7" in t or "\u00f7" in t:
        return [t] if BEYOND_LATIN.search(t) else PIECE.findall(t)
    return t.replace(",", "\0,").replace(".", "\0.").replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def tokenizer_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TextEncoder:
    """Keeps at most ``max_pieces`` pieces' ids; a full store is emptied."""

    def __init__(self, path: str, max_pieces: int = 800_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: the tokenizer takes these out before its first split
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.max_pieces = max_pieces
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        f = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in f(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for t in texts:
            if any(x in t for x in self.added):
                out.append(self._encode([t])[0])
                continue
            cut = pieces(t)
            if len(cut) == 1 and len(t) > 64:
                out.append(self._encode(cut)[0])
                continue
            new = list(set(cut).difference(self.known))
            if new:
                if len(self.known) + len(new) > self.max_pieces:
                    self.known.clear()
                    new = list(set(cut))
                for i in range(0, len(new), 4096):
                    self.known.update(zip(new[i : i + 4096], self._encode(new[i : i + 4096])))
            out.append(b"".join(map(self.known.__getitem__, cut)))
        return out


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]
