"""Token ids of whole texts inside Spark tasks."""

from __future__ import annotations

import base64
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np

_NATIVE = array("I").itemsize == 4 and sys.byteorder == "little"
# White space that the ranks' pattern can take in one run; from about a million on it overflows a stack.
_RUN = 100_000
_SPACES = re.compile(rf"(?<!\s)\s{{{_RUN}}}")
_LOADED: dict[tuple[str, str], "Encoder"] = {}


class Encoder:
    """Ids as ``tokenizers`` gives them for ``json_path`` without added special tokens.

    The merges run on the same vocabulary as ranks, which is about four times as fast; a text that
    spells a special token or holds a very long run of white space goes through the tokenizer file itself.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self._plain = tiktoken.Encoding(ranks_path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._full = Tokenizer.from_file(json_path)
        self._special = [t.content for t in self._full.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(s in text for s in self._special) or len(text) >= _RUN and _SPACES.search(text):
            return _packed(self._full.encode(text, add_special_tokens=False).ids)
        return _packed(self._plain.encode_ordinary(text))


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if _NATIVE else np.array(ids, "<u4").tobytes()


def encoder(json_path: str, ranks_path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if (json_path, ranks_path) not in _LOADED:
        _LOADED[json_path, ranks_path] = Encoder(json_path, ranks_path)
    return _LOADED[json_path, ranks_path]


def vocabulary(name: str = "byte_bpe_50k") -> tuple[str, str]:
    """Paths of the public tokenizer's file and of its ranks; the workers have the same ones."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


def pieces_of(docs, capacity: int, files: tuple[str, str], end_id: int = 0):
    """Rows (doc_id, start, length, doc_tokens, ids): each document's ids and ``end_id``, cut into
    full pieces of ``capacity`` and a rest.  ids: little-endian unsigned 32-bit numbers."""
    import pyarrow as pa

    names = ["doc_id", "start", "length", "doc_tokens", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(*files).encode, end_id.to_bytes(4, "little")
        rows: list[list] = [[], [], [], [], []]
        size = 0

        def flush():
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names)

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = encode(text or "") + end
                    total = len(data) // 4
                    for start in range(0, total, capacity):
                        length = min(capacity, total - start)
                        for out, x in zip(rows, (key, start, length, total, data[4 * start : 4 * (start + length)]), strict=True):
                            out.append(x)
                    size += len(data)
                if size > 8 << 20:
                    yield flush()
                    rows, size = [[], [], [], [], []], 0
        if rows[0]:
            yield flush()

    return docs.mapInArrow(cut, "doc_id long, start long, length int, doc_tokens long, ids binary")
