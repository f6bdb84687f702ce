"""Byte-level BPE encoding by tree concatenation, and decoding.

A text up to ``leaf_chars`` characters is encoded at once. A longer one is halved until its
pieces are that short; the pieces are dealt to all tasks and encoded in parallel. Neighbours
are then joined level by level: a window around the join is encoded again and grows until
both sides agree with it exactly. A side agrees

* where a space is followed by something other than white space. The splitting pattern
  starts a new piece there whatever surrounds it, so tokens before and after are independent;
* or, in unsplit text, where the window lies in one piece of the pattern and its outermost
  tokens equal those of the side. A token sequence is the encoding of its text if every
  pair of neighbours is, so equal outer tokens make the whole sequence exact;
* or where the window reaches the end of the side.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.llm.groups import sorted_groups

# Fixed value: the splitting pattern of byte-level BPE vocabularies of this kind.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_AGREE = 4
_ROWS = 512


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in byte-level vocabularies -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    table.update({chr(256 + k): b for k, b in enumerate(rest)})
    return table


class ByteBpe:
    """Encoder and decoder of a byte-level BPE file in the format of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if (
            spec["normalizer"] is not None
            or pre.get("type") != "ByteLevel"
            or pre.get("add_prefix_space")
            or not pre.get("use_regex")
            or spec["model"]["type"] != "BPE"
        ):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        alphabet = byte_alphabet()
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        ranks = {
            bytes(alphabet[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in self.special
        }
        self.core = tiktoken.Encoding("bpe", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        table = [b""] * (max([*ranks.values(), *self.special.values()]) + 1)
        for token, k in ranks.items():
            table[k] = token
        for token, k in self.special.items():
            table[k] = token.encode()
        self.table = table
        self.split = regex.compile(SPLIT_PATTERN)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text at once."""
        return self.core.encode(text, allowed_special="all", disallowed_special=())

    def decode(self, ids: list[int] | np.ndarray) -> str:
        table = self.table
        return b"".join([table[k] for k in ids]).decode("utf-8", "replace")

    def _starts_piece(self, token: int) -> bool:
        """Whether a token is a space and something other than white space."""
        raw = self.table[token]
        return len(raw) > 1 and raw[0] == 32 and not raw[1:2].isspace() and raw[1] < 0x80

    def _cut(self, ids: list[int], raw_from: int, raw_to: int) -> bytes:
        return b"".join([self.table[k] for k in ids[raw_from:raw_to]])

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the text of ``left`` followed by that of ``right``."""
        if not left or not right:
            return left or right
        reach = 16
        while True:
            low, high = max(0, len(left) - reach), min(len(right), reach)
            i = next((k for k in range(low, len(left)) if self._starts_piece(left[k])), None)
            i = 0 if low == 0 else i
            j = next((k for k in range(high - 1, 0, -1) if self._starts_piece(right[k])), None)
            j = len(right) if high == len(right) else j
            a, b = (low if i is None else i), (high if j is None else j)
            raw = self._cut(left, a, len(left)) + self._cut(right, 0, b)
            try:
                text = raw.decode("utf-8")
            except UnicodeDecodeError:
                text = None  # an edge lies inside a character
            if text is not None:
                window = self.encode(text)
                if (i is not None and j is not None) or self._agrees(
                    text, window, left[a:], right[:b], i is None, j is None
                ):
                    return left[:a] + window + right[b:]
            reach *= 2

    def _agrees(
        self, text: str, window: list[int], left: list[int], right: list[int], check_left: bool, check_right: bool
    ) -> bool:
        """Whether a window with an edge inside a piece fits the tokens of that side."""
        if len(window) < 2 * _AGREE or any(s in text for s in self.special):
            return False
        at = len(self._cut(left, 0, len(left)).decode("utf-8", "replace"))
        crossing = next(m for m in self.split.finditer(text) if m.end() > at)
        if check_left and (crossing.start() != 0 or window[:_AGREE] != left[:_AGREE]):
            return False
        return not check_right or (crossing.end() == len(text) and crossing.start() < at and window[-_AGREE:] == right[-_AGREE:])

    def concatenate(self, leaves: list[list[int]]) -> list[int]:
        """Join neighbouring pieces level by level."""
        while len(leaves) > 1:
            pairs = [self.join(a, b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
            leaves = pairs + leaves[len(leaves) // 2 * 2 :]
        return leaves[0] if leaves else []


@cache
def tokenizer(path: str) -> ByteBpe:
    """The tokenizer of a file, read once per worker."""
    return ByteBpe(path)


def _halves(text: str, leaf_chars: int) -> Iterator[str]:
    """Pieces of at most ``leaf_chars`` characters by repeated halving, in order."""
    depth = 0
    while len(text) > leaf_chars << depth:
        depth += 1
    for k in range(1 << depth):
        yield text[len(text) * k >> depth : len(text) * (k + 1) >> depth]


def _id_lists(ids: list[list[int]]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in ids]) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_documents(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = 16_384
) -> DataFrame:
    """One row per row of ``docs``: ``id_col`` and ``ids`` array<int> of its whole text.

    Null and empty texts have no ids; repeated rows each get a row; a null id stays null.
    Strings of special tokens in a text become those tokens. Other columns, whatever their
    names, are not read. ``tokenizer_path`` must be readable on every node.
    """
    id_type = docs.schema[id_col].dataType
    # Ids travel through Python as text: pandas would turn a long column with nulls into floats.
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    is_long = F.length("text") > leaf_chars

    def encode_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                some = batch.slice(at, _ROWS)
                ids = [bpe.encode(t) for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), _id_lists(ids)], ["id", "ids"])

    def halve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text, digest in zip(batch["id"], batch["text"], batch["digest"], strict=True):
                pieces = list(_halves(text, leaf_chars))
                for part in range(0, len(pieces), 64):
                    some = pieces[part : part + 64]
                    numbers = range(part, part + len(some))
                    yield pd.DataFrame({"id": [key] * len(some), "digest": digest, "leaf": numbers, "text": some})

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                ids = [bpe.encode(t) for t in some.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns[:3], _id_lists(ids)], ["id", "digest", "leaf", "ids"])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(tokenizer_path)
        for group in sorted_groups(batches, ["no_id", "digest", "key"]):
            # Rows that repeat an id and a text bring each of their leaves that many times.
            copies = int((group["leaf"] == 0).sum())
            leaves = group.drop_duplicates("leaf")["ids"]
            ids = bpe.concatenate([x.tolist() for x in leaves])
            for _ in range(copies):
                yield pd.DataFrame({"id": group["id"].iloc[:1], "ids": [np.array(ids, dtype=np.int32)]})

    result = "id string, ids array<int>"
    short = rows.where(~is_long).mapInArrow(encode_short, result)
    leaf = (
        rows.where(is_long)
        .withColumn("digest", F.xxhash64("text"))
        .mapInPandas(halve, "id string, digest long, leaf int, text string")
        # Deal the leaves by content, not in turn: a task run again gives the same rows.
        .repartition(F.xxhash64("digest", "leaf", "id"))
        .mapInArrow(encode_leaves, "id string, digest long, leaf int, ids array<int>")
        .withColumns({"no_id": F.col("id").isNull(), "key": F.coalesce("id", F.lit(""))})
        .repartition("no_id", "digest", "key")
        .sortWithinPartitions("no_id", "digest", "key", "leaf")
    )
    merged = leaf.mapInPandas(merge, result)
    return short.unionByName(merged).select(F.col("id").cast(id_type).alias(id_col), "ids")


def decode_documents(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: the text of its ids, special tokens included.

    Null ids give an empty text, bytes that are no UTF-8 the replacement character.
    """

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        bpe = tokenizer(tokenizer_path)
        return pd.Series([bpe.decode(x.tolist()) if x is not None else "" for x in ids])

    return encoded.withColumn("decoded", decode(F.col(ids_col)))
