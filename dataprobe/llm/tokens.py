"""Token counts, with overlapping chunks for huge texts."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.llm.common import pieces, row_column, with_new_columns

#: A tokenizer file is sent to the executors, so its size is checked.
MAX_TOKENIZER_BYTES = 64 << 20
#: Characters: longer texts are cut in chunks, which overlap.
HUGE, CHUNK, OVERLAP = 1 << 15, 1 << 14, 256


@lru_cache(maxsize=4)
def _load(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(text)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def can_splice(definition: dict) -> bool:
    """Is a place between a visible character and ASCII white space surely a token boundary, whatever stands around?

    The byte-level pre-tokenizer takes white space only at the start of a piece or in pieces of white space, and looks ahead
    only from within white space. So no piece reaches over such a place, and the pieces on one side do not
    depend on the other side. This needs: that pre-tokenizer, no normaliser, and added tokens that neither
    hold white space nor take in their neighbours.
    """
    pre = definition.get("pre_tokenizer") or {}
    added = definition.get("added_tokens") or []
    return (pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True)) and not pre.get("add_prefix_space")
            and definition.get("normalizer") is None and definition.get("post_processor") is None
            and (definition.get("model") or {}).get("dropout") is None
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in added))


def _stable(text: str, p: int) -> bool:
    """The proof of ``can_splice`` holds for a boundary at ``p``."""
    return text[p] in " \t\n\r" and (text[p - 1].isalnum() or "!" <= text[p - 1] <= "~")


def count_spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``, from chunks of ``chunk`` characters and the ``overlap`` that follows each.

    Neighbouring chunks are spliced at a place in their overlap where both have a token boundary and which is stable
    (``_stable``). Without one the overlap is doubled, up to the end of the text.
    """
    def encode(begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.array(tokenizer.encode(text[begin:end], add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)
        return offsets[:, 0] + begin, offsets[:, 1] + begin

    total, base, begin, width = 0, 0, 0, overlap
    end = min(chunk + width, len(text))
    starts, ends = encode(begin, end)
    while end < len(text):
        following = begin + chunk
        next_end = min(following + chunk + overlap, len(text))
        next_starts, next_ends = encode(following, next_end)
        common = np.intersect1d(ends[(ends > max(following, base)) & (ends < end)], next_starts)
        cut = next((int(p) for p in common if _stable(text, int(p))), None)
        if cut is None:
            width *= 2
            end = min(begin + chunk + width, len(text))
            starts, ends = encode(base, end)    # from the last proven boundary
            if end > following + chunk:         # the overlap has outgrown a chunk, which becomes a part of this one
                begin, width = following, end - following - chunk
            continue
        total += int(np.count_nonzero((starts >= base) & (starts < cut)))
        base, begin, end, width = cut, following, next_end, overlap
        starts, ends = next_starts, next_ends
    return total + int(np.count_nonzero(starts >= base))


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 1024, huge: int = HUGE,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens); columns of these names are
    replaced. A null text counts as empty: 0 bytes, 0 tokens.

    Tokens are those of the library without begin, end or padding tokens; strings of special tokens inside texts are
    handled as the library does by itself. Texts above ``huge`` characters go chunk by chunk, so memory for
    token lists is bounded; where the tokenizer gives no proof of stable boundaries they are encoded whole.
    """
    if os.path.getsize(tokenizer_path) > MAX_TOKENIZER_BYTES:
        raise ValueError("the tokenizer file is too large to be sent to all executors")
    with open(tokenizer_path, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    splice = can_splice(json.loads(sent.value))

    @F.arrow_udf("long")
    def tokens(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = _load(sent.value)
        for array in arrays:
            counts: list[int] = []
            for piece in pieces(iter([pa.record_batch({"text": array})]), "text"):
                texts = [t or "" for t in piece["text"].to_pylist()]
                long = [splice and len(t) > huge for t in texts]
                plain = iter(tokenizer.encode_batch_fast(
                    [t for t, apart in zip(texts, long) if not apart], add_special_tokens=False))
                counts += [count_spliced(tokenizer, t, chunk, overlap) if apart else len(next(plain))
                           for t, apart in zip(texts, long)]
            yield pa.array(counts, type=pa.int64())

    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    counted = docs.select(row_column(docs).alias("row"), F.octet_length(body).cast("long").alias("n_bytes"),
                          tokens(body).alias("n_tokens"))
    return counted.select(*with_new_columns(docs.columns, "row", n_bytes=F.col("n_bytes"), n_tokens=F.col("n_tokens"),
                                            over_limit=F.col("n_tokens") > limit))
