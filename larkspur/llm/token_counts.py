"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut into pieces of bounded size at safe boundaries, the pieces of an Arrow batch
are packed into encoder calls balanced by bytes, and only each text's sum of lengths
leaves the worker.

A boundary is safe for a byte-level BPE model with the usual pre-tokenising pattern before
a single space that stands between two characters that aren't white space: no match of the
pattern, no merge and no special string reaches across it. A text without such a place
stays whole. Models of any other kind are never cut.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import map_texts

PIECE_CHARS = 32_768
CALL_BYTES = 1 << 18
SAFE = re.compile(r"(?<=\S) (?=\S)")


def cut(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Pieces of about ``size`` characters that encode independently; joined they are the text."""
    out, start = [], 0
    while len(text) - start > size:
        m = SAFE.search(text, start + size)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.start()
    out.append(text[start:])
    return out


def can_cut(spec: dict) -> bool:
    """Whether a tokenizer file is of the kind for which the boundaries are safe."""
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    return plain and spec.get("normalizer") is None and all(" " not in t["content"] for t in spec.get("added_tokens", []))


class Counter:
    """Lengths of texts in tokens as the library of the file gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.cuts = False
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            with open(path, encoding="utf-8") as f:
                self.cuts = can_cut(json.load(f))
            self.lengths = lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        elif path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"neither .json nor .model: {path}")

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        owner: list[int] = []
        pieces: list[str] = []
        held = 0

        def flush() -> None:
            nonlocal held
            for i, n in zip(owner, self.lengths(pieces)):
                out[i] += n
            owner.clear(), pieces.clear()
            held = 0

        for i, text in enumerate(texts):
            for piece in cut(text) if self.cuts else (text,):
                if not piece:
                    continue
                size = len(piece) if piece.isascii() else len(piece.encode("utf-8", "surrogatepass"))
                if pieces and held + size > CALL_BYTES:
                    flush()
                owner.append(i)
                pieces.append(piece)
                held += size
        if pieces:
            flush()
        return out


@lru_cache(maxsize=4)
def load_counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text.

    A null or empty text has 0 bytes and 0 tokens; repeated rows and keys stay as they are;
    an empty table gives an empty table; other columns are ignored. ``path`` names a
    tokenizers (.json) or sentencepiece (.model) file that every worker can read.
    """

    def kernel():
        counter = load_counter(path)

        def apply(texts: list) -> dict:
            whole = [t or "" for t in texts]
            return {"n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in whole], "n_tokens": counter.count(whole)}

        return apply

    out = map_texts(df, [id_col], text_col, kernel, [("n_bytes", "bigint"), ("n_tokens", "bigint")])
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
