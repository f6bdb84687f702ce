"""Token ids in ORC files, in ascending order of document id.

Documents are range-partitioned and sorted by id before they are encoded, so each file
covers a range of ids and the files follow one another. ORC stores the ids as run-length
encoded integers in stripes that tasks read in parallel; the minimum and maximum of each
stripe and row group and a Bloom filter on the document id let a lookup skip the rest.

Encoding goes word by word where the tokenizer allows it: one that drops white space gives
the ids of each run between spaces on its own, and most runs come from a cache. It is bounded
in entries and holds short runs only, so it is bounded in bytes too. When it is full, what it
holds becomes the old generation, from which runs that come again are taken over.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from maskwell.llm.bpe import byte_alphabet

ROW_GROUP = 1000
_ROWS = 256
_CACHE = 300_000
#: Longest run or piece that is kept; its ids are at most a few hundred bytes.
_KEPT = 64
_LATIN = "a-zß-öø-ÿ"
_SIMPLE = re.compile(rf"[!-~À-Ö{_LATIN}Ø-Þ]+")
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")
# Fixed value: the splitting pattern of lower-casing vocabularies that drop white space.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class CachedEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers, equal to those of the library."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_word = self._drops_white_space(spec)
        self.to_char = {b: c for c, b in byte_alphabet().items()}
        self.model = self.library.model
        self.runs: dict[str, bytes] = {}
        self.old_runs: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @staticmethod
    def _drops_white_space(spec: dict) -> bool:
        """Whether normaliser and splitter treat runs between spaces independently."""
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        return (
            [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and steps[1]["pattern"] == {"Regex": r"\s+"}
            and [s["type"] for s in splits] == ["Split", "ByteLevel"]
            and splits[0]["pattern"] == {"Regex": _WORD_PATTERN}
            and (splits[0]["behavior"], splits[0]["invert"]) == ("Removed", True)
            and not splits[1]["add_prefix_space"]
            and not splits[1]["use_regex"]
            and not any(re.search(r"\s", a["content"]) or a["lstrip"] or a["rstrip"] for a in spec["added_tokens"])
        )

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self._by_library(text)
        runs = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        known = self.runs
        try:
            return b"".join(map(known.__getitem__, runs))
        except KeyError:
            pass
        if len(known) > _CACHE:
            self.old_runs, self.runs = known, {}
            known = self.runs
        old, long = self.old_runs, {}
        for r in set(runs).difference(known):
            if len(r) > _KEPT:
                long[r] = self._run(r)
            else:
                found = old.get(r)
                known[r] = self._run(r) if found is None else found
        if not long:
            return b"".join(map(known.__getitem__, runs))
        return b"".join([long[r] if len(r) > _KEPT else known[r] for r in runs])

    def _by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _run(self, run: str) -> bytes:
        """A run of printable ASCII and Latin-1 letters needs no normaliser but lower case."""
        if not run:
            return b""
        if "<|" in run or _SIMPLE.fullmatch(run) is None:
            return self._by_library(run)
        if len(self.pieces) > _CACHE:
            self.pieces.clear()
        return b"".join([self.pieces.get(p) or self._piece(p) for p in _PIECES.findall(run.lower())])

    def _piece(self, piece: str) -> bytes:
        spelled = piece if piece.isascii() else "".join([self.to_char[b] for b in piece.encode()])
        ids = [t.id for t in self.model.tokenize(spelled)]
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= _KEPT:
            self.pieces[piece] = found
        return found


@cache
def encoder(path: str) -> CachedEncoder:
    """The encoder of a file, read once per worker."""
    return CachedEncoder(path)


SCHEMA = "doc_id long, tie long, n_tokens long, ids array<int>, part int"


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = 1,
) -> None:
    """Write ``doc_id``, ``tie``, ``part``, ``n_tokens`` and ``ids`` array<int> as ORC under ``path``.

    Null and empty texts have only the end id (none if ``end_id`` is None). Rows of equal id
    follow one another by ``tie``, the hash of the text; null ids come first. Other columns
    are not written. The tokenizer file must be readable on every node.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("tie", F.xxhash64("text"))
    # The tie takes part in the ranges, so that one frequent id does not make one large file.
    placed = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                some = batch.slice(at, _ROWS)
                raw = [words.encode(t) + end for t in some.column(1).to_pylist()]
                sizes = np.array([len(r) // 4 for r in raw], dtype=np.int64)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                flat = np.frombuffer(b"".join(raw), dtype="<i4")
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(2), pa.array(sizes), ids], ["doc_id", "tie", "n_tokens", "ids"]
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    encoded = placed.mapInArrow(encode, f"doc_id {kind}, tie long, n_tokens long, ids array<int>")
    (
        encoded.withColumn("part", F.spark_partition_id())
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(ROW_GROUP))
        .option("orc.compress", "ZSTD")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows written; ``doc_ids`` are looked up through stripe statistics and Bloom filters.

    A folder of no rows gives an empty table of the same columns with ``doc_id`` long; ids that
    are not there give nothing, null ids are never found by lookup.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def token_positions(tokens: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of each row of token files.

    ``start`` is the number of ids of all rows before it. Only lengths are shuffled: a
    running sum within each part, on top of the sum of the parts before it. No row gives no row;
    documents without an id have 0 tokens and the crc32 of nothing, 0.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = [batch.column(c) for c in ("part", "doc_id", "tie", "n_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(crc, type=pa.int64())], ["part", "doc_id", "tie", "n_tokens", "ids_crc32"]
            )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    slim = tokens.mapInArrow(digest, f"part int, doc_id {kind}, tie long, n_tokens long, ids_crc32 long")
    # One row per file: that many numbers are added up in one task.
    parts = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.withColumn("base", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    before = Window.partitionBy("part").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    inside = slim.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return inside.join(parts, "part").select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )
