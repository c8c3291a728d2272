"""Numbers of tokens of texts, by a public tokenizer's vocabulary."""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

#: Folder of the vocabulary files; a parameter, never copied.
FOLDER = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a file of ranks (one per worker)."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: A piece ends at the first place after so many characters where no token can go across.
PIECE = 50_000
#: A blank after a character that is none: tokens hold blanks at their front only, so one ends here whatever follows.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def pieces(text: str) -> Iterator[str]:
    """A text cut where tokens end in any case; its tokens are those of the pieces."""
    at = 0
    while len(text) - at > PIECE:
        cut = _CUT.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def count(text: str, path: str) -> int:
    """Tokens of a whole text of any length."""
    encode = encoding(path).encode_ordinary
    return sum(len(encode(piece)) for piece in pieces(text)) if text else 0


def token_count(path: str | None = None):
    """A vectorised function STRING -> INT; null gives null, an empty text 0."""
    path = path or f"{FOLDER}/{VOCABULARY}"

    @F.pandas_udf("int")
    def tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([None if t is None else count(t, path) for t in part], dtype="Int32")

    return tokens
