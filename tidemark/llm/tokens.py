"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import os
import re

import numpy as np

from tidemark.llm.shared import per_worker

TOKENIZER = "byte_bpe_50k.json"


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, equal to the tokenizers library's `encode` of the whole text.

    The byte-level pre-tokenizer never joins what stands on both sides of a line end or before a space, if no more
    white space is next to it. Texts are cut there, each distinct piece is encoded by the library once and remembered,
    and other texts (longer white space, special tokens' strings) go through the library whole. A piece is remembered
    when it comes a second time, and at most `most` pieces are.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.most = most
        self.special = ["\x00", *(t.content for t in self.library.get_added_tokens_decoder().values())]
        self.other_space = re.compile(r"[^\S\n ]")
        self.line_end = self.library.encode("\n", add_special_tokens=False).ids
        if len(self.line_end) != 1:
            raise ValueError("the tokenizer has no single id for a line end")
        self.known = {"\n": np.array(self.line_end, "<u4").tobytes()}
        self.once = bytearray(1 << 22)  # marks by hash of pieces that came once

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")  # ids without offsets

    def encode(self, text: str) -> bytes:
        if not text or any(s in text for s in self.special):
            return self.ids(text).tobytes()
        pieces = text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            missing = list(set(pieces).difference(self.known))
            joined = "\n".join(missing)
            # an empty piece or a lone space stands between white space; such texts are not cut
            if "" in missing or " " in missing or self.other_space.search(joined):
                return self.ids(text).tobytes()
            ids = self.ids(joined)
            raw, ends = ids.tobytes(), (4 * np.flatnonzero(ids == self.line_end[0])).tolist()
            starts = [0, *(e + 4 for e in ends)]
            self.known.update((piece, raw[lo:hi]) for piece, lo, hi in zip(missing, starts, [*ends, len(raw)], strict=True))
            out = b"".join(map(self.known.__getitem__, pieces))
            full = len(self.known) - len(missing) >= self.most
            for piece in missing:
                mark = hash(piece) & 0x3FFFFF
                if full or not self.once[mark]:
                    self.once[mark] = 1
                    del self.known[piece]
            return out


def encoder(name_or_path: str = TOKENIZER) -> Encoder:
    """One encoder per Python worker; a bare name is a file of the installed tokenizers package."""

    def make() -> Encoder:
        if "/" in name_or_path:
            return Encoder(name_or_path)
        import public_tokenizers

        return Encoder(public_tokenizers.path(name_or_path))

    return per_worker("encoder", name_or_path, make)
