"""Ids of whole texts by a BPE of lower-cased words without white space, as the tokenizers library gives them.

The vocabulary is also given to the faster of the two libraries, with a control character for the end of a word: a word's last letter and its end
are joined before all else, as their ids are the lowest of all pairs. Plain Latin text (after lower-casing, so that nothing is left to
normalise) has its words marked so and goes there; text with any other character, or with a word of more than LONG letters, goes to the tokenizers library.
Tests hold both to the same ids.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable

import numpy as np

END, LONG = "\x01", 4096
#: Anything but plain white space, ASCII signs, Latin letters.
_OTHER = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ɏ]")
#: The vocabulary's own splitting pattern on such text: endings, letters, single digits, runs of signs.
_WORD = re.compile("('s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼-¾]|[^ \t\n\ra-zªµºß-öø-ɏ0-9²³¹¼-¾]+)[ \t\n\r]*")


class WordBPE:
    def __init__(self, name: str):
        import public_tokenizers as P
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(P.path(name))
        self.tok.no_truncation()
        self.tok.no_padding()
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.added = {t.content: [i] for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        with open(P.path(name)) as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # printable bytes stand for themselves, the others for the characters from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {bytes(byte_of[c] for c in t.removesuffix("</w>")) + (END.encode() if t.endswith("</w>") else b""): i for t, i in vocabulary.items()}
        self.quick = tiktoken.Encoding(name, pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of numbers of `kind`."""
        return [np.array(self.ids(t), self.kind).tobytes() for t in texts]

    def ids(self, text: str) -> list[int]:
        if self.special is not None and "<|" in text:
            parts = self.special.split(text)
            return [i for k, p in enumerate(parts) for i in (self.added[p] if k % 2 else self.ordinary(p))]
        return self.ordinary(text)

    def ordinary(self, text: str) -> list[int]:
        low = text.lower()
        if _OTHER.search(low) or (len(low) > LONG and max(map(len, low.split(" "))) > LONG):
            return self.tok.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(_WORD.sub(r"\1" + END, low.lstrip(" \t\n\r")))


@functools.cache
def word_bpe(name: str) -> WordBPE:
    return WordBPE(name)


def encoder(tokenizer: str) -> tuple[Callable[[list[str]], list[bytes]], np.dtype]:
    """The texts' ids as bytes, and the kind of number they are, of a vocabulary of words or of bytes."""
    if tokenizer.startswith("word_bpe"):
        own = word_bpe(tokenizer)
        return own.encode, own.kind
    from strandweave.llm.bpe import byte_bpe

    bpe = byte_bpe(tokenizer)
    return lambda texts: [bpe.encode(t).tobytes() for t in texts], bpe.kind
