"""Public tokenizers inside tasks: ids and counts exactly as the library gives them.

The word tokenizer drops white space, so the ids of a text are those of its
white-space separated chunks in order. Each worker keeps the ids of chunks it has
met (at most ``KEPT`` of them) and asks the library only for new ones. Files whose
tokenizer looks at white space go to the library text by text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Sequence
from struct import pack

import numpy as np

KEPT = 700000
#: letters, then ASCII marks
_MARKED = re.compile(rb"([A-Za-z\x80-\xff]+)([!-/:-@\[-`{-~]+)")
_loaded: dict[str, "Codec"] = {}


def file_digest(path: str) -> str:
    """Version of a tokenizer: digest of its file and of the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + library.__version__.encode()).hexdigest()


def codec(path: str) -> "Codec":
    """The tokenizer of a file, loaded once per process."""
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


class Codec:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.known: dict[bytes, bytes]
        self.chunked = False
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode_all = lambda texts: pieces.encode(texts, num_threads=1)
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode_all = lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as file:
            shape = json.load(file)
        self.chunked = self._drops_space(shape)
        if self.chunked:
            self.known = Chunks(tokenizer)

    @staticmethod
    def _drops_space(shape: dict) -> bool:
        """Whether chunks between white space are encoded on their own, in lower case, and white space gives no ids."""
        first = ((shape.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        steps = (shape.get("normalizer") or {}).get("normalizers") or []
        special = shape.get("added_tokens", ())
        return (
            first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
            and r"[^\s\p{L}\p{N}]+" in first.get("pattern", {}).get("Regex", "") and [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"]
            and shape["model"].get("end_of_word_suffix") == "</w>"
            and all(x["content"].startswith("<|") and not (x["lstrip"] or x["rstrip"] or " " in x["content"]) for x in special)
        )

    def encode(self, texts: Sequence[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text, as little-endian unsigned 32-bit integers."""
        if not self.chunked:
            return [np.array(ids, "<u4").tobytes() for ids in self.encode_all([x.decode() for x in texts])]
        ids = self.known
        if len(ids) > KEPT:
            ids.clear()
        return [b"".join(map(ids.__getitem__, (x if b"<|" in x else x.lower()).split())) for x in texts]


class Chunks(dict):
    """Ids of chunks without white space, from the library for each new one.

    A chunk of Latin letters is one word, which the library's model takes as it is. A
    run of ASCII marks behind such a word stands for itself. Others go through the
    whole tokenizer.
    """

    def __init__(self, tokenizer):
        self.whole, self.model = tokenizer, tokenizer.model
        # bytes as the characters that stand for them in the vocabulary
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.visible = {x: 256 + k for k, x in enumerate(x for x in range(256) if x not in shown)}

    def __missing__(self, chunk: bytes) -> bytes:
        word = self._word(chunk)
        if word is not None:
            ids = [x.id for x in self.model.tokenize(word)]
            packed = pack(f"<{len(ids)}I", *ids)
        elif (marked := _MARKED.fullmatch(chunk)) and self._word(marked[1]) is not None:
            packed = self[marked[1]] + self[marked[2]]
        else:
            ids = self.whole.encode(chunk.decode(), add_special_tokens=False).ids
            packed = pack(f"<{len(ids)}I", *ids)
        self[chunk] = packed
        return packed

    def _word(self, chunk: bytes) -> str | None:
        """The model's text of a chunk of Latin letters."""
        if chunk.isalpha():
            return chunk.decode().lower()
        if chunk.isascii():
            return None
        text = chunk.decode()
        if not text.isalpha() or max(text) > "\xff":
            return None
        return text.lower().encode().decode("latin-1").translate(self.visible)
