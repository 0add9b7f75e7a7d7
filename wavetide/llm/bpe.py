"""Byte-level BPE encoding and decoding by tree concatenation.

A text of at most ``leaf_chars`` characters is one leaf and is encoded where it lies. A longer one is halved again
and again, at places where the pre-tokeniser splits in any case (a printable character followed by a space or line
feed), until every part is a leaf. A stretch without such a place is pre-tokenised as a whole; a pre-token longer than
``piece_bytes`` (long unsplit text) is halved at arbitrary bytes. Leaves of long texts are rows of their own, dealt
over all tasks and encoded in parallel; then the ids of neighbouring leaves are joined in a tree. A join inside a
pre-token re-encodes a window of tokens around it and doubles the window until its first id equals the id that the
left side has there and its last id equals the id that the right side has there. A sequence of BPE tokens is the
encoding of its text exactly if each neighbouring pair of tokens is, so the joined sequence is then exact.

Defined results: null text is the empty text and gives no ids; equal rows give equal results, each row one; extra
columns of the input are dropped by the query and kept out of the way by private names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, table

#: Fixed value: the pre-tokeniser's pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SAFE = re.compile(r"(?<=[!-~¡-ɏ])[ \n]")
_RARE = re.compile(r"[^\x00-ɏ]")
LEAF_CHARS = 32768
PIECE_BYTES = 4096


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The byte that each character of the vocabulary file stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes as the tokenizers library does with the file at path.

    Texts within Latin letters and ASCII go through a faster library on the same ranks; texts with rarer characters or
    the strings of special tokens go through tokenizers itself.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        to = _byte_of()
        ranks = {bytes(to[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        vocab = spec["model"]["vocab"]
        if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
            raise ValueError("ids of the vocabulary aren't in the order of its merges")
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.split = regex.compile(PATTERN)
        self.mark = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    @cached_property
    def lib(self):
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(self.path)
        lib.no_truncation()
        lib.no_padding()
        return lib

    def encode(self, text: str) -> np.ndarray:
        if _RARE.search(text) or self.mark and self.mark.search(text):
            return np.array(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token or part of one."""
        return self.fast._encode_single_piece(piece)

    def decode(self, ids) -> str:
        return self.fast.decode_bytes(ids if isinstance(ids, list) else ids.tolist()).decode("utf-8", errors="replace")

    def raw(self, ids: list[int]) -> bytes:
        return self.fast.decode_bytes(ids)

    # tree concatenation

    def leaves(self, text: str, leaf_chars: int = LEAF_CHARS, piece_bytes: int = PIECE_BYTES) -> Iterator[tuple[str, bytes]]:
        """Parts of text, in order: ("text", utf-8) to encode as a text, ("piece", bytes) a pre-token, and
        ("more", bytes) a part of the pre-token that goes on from the part before."""
        todo = [(0, len(text))]
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= leaf_chars:
                if hi > lo:
                    yield "text", text[lo:hi].encode()
                continue
            mid = (lo + hi) // 2
            found = _SAFE.search(text, mid, hi)
            at = found.start() if found else next((p for p in range(mid - 1, lo, -1) if _SAFE.match(text, p)), lo)
            if lo < at < hi:
                todo += [(at, hi), (lo, at)]
            else:
                yield from self._stretch(text[lo:hi], leaf_chars, piece_bytes)

    def _stretch(self, text: str, leaf_chars: int, piece_bytes: int) -> Iterator[tuple[str, bytes]]:
        for part in self.cut_special.split(text) if self.cut_special else [text]:
            if part in self.special:
                yield "text", part.encode()
                continue
            tokens = list(self._rare_split(part)) if _RARE.search(part) else self.split.findall(part)
            for token in tokens:
                raw = token.encode()
                kind, todo = "piece", [(0, len(raw))]
                while todo:  # halves of a long unsplit pre-token
                    lo, hi = todo.pop()
                    if hi - lo > piece_bytes:
                        todo += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
                    else:
                        yield kind, raw[lo:hi]
                        kind = "more"

    def _rare_split(self, part: str) -> list[str]:
        return [part[a:b] for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(part)]

    def encode_leaf(self, kind: str, raw: bytes) -> list[int]:
        return self.encode(raw.decode()).tolist() if kind == "text" else self.encode_piece(raw)

    def join(self, left: list[int], right: list[int], window: int = 4) -> list[int]:
        """Ids of two parts of one pre-token, joined exactly."""
        while left and right:
            i, j = max(0, len(left) - window), min(len(right), window)
            again = self.encode_piece(self.raw(left[i:]) + self.raw(right[:j]))
            if (i == 0 or again[0] == left[i]) and (j == len(right) or again[-1] == right[j - 1]):
                return left[:i] + again + right[j:]
            window *= 2
        return left + right

    def concatenate(self, parts: list[tuple[str, list[int]]]) -> np.ndarray:
        """Ids of a text from those of its leaves, by joining neighbours in a tree."""
        whole: list[list[list[int]]] = []
        for kind, ids in parts:
            if kind == "more":
                whole[-1].append(ids)
            else:
                whole.append([ids])
        out = []
        for level in whole:
            while len(level) > 1:
                level = [self.join(level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
            out.append(np.array(level[0], dtype=np.uint32))
        return np.concatenate(out) if out else np.empty(0, dtype=np.uint32)

    def encode_tree(self, text: str, leaf_chars: int = LEAF_CHARS, piece_bytes: int = PIECE_BYTES) -> np.ndarray:
        return self.concatenate([(k, self.encode_leaf(k, raw)) for k, raw in self.leaves(text, leaf_chars, piece_bytes)])


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, leaf_chars: int = LEAF_CHARS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(id, ids binary): the ids of each row's whole text as little-endian unsigned 32-bit integers."""
    path = path or default_path()
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @released
    def short(batches):
        c = codec(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode(t).astype("<u4").tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["id", "ids"])

    @released
    def split(batches):
        from pyspark import TaskContext

        c, key = codec(path), TaskContext.get().partitionId() << 33
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                key += 1
                parts = list(c.leaves(t, leaf_chars, piece_bytes))
                n = len(parts)
                yield pa.RecordBatch.from_pydict({"key": [key] * n, "id": pa.array([i] * n, pa.int64()), "no": list(range(n)), "kind": [k for k, _ in parts], "raw": pa.array([r for _, r in parts], pa.binary())})

    @released
    def leaf(batches):
        c = codec(path)
        for b in batches:
            kinds, raws = b.column(3).to_pylist(), b.column(4).to_pylist()
            ids = [np.array(c.encode_leaf(k, r), dtype="<u4").tobytes() for k, r in zip(kinds, raws)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ids, pa.binary())], ["key", "id", "no", "kind", "raw"])

    @released
    def merge(batches):
        c, key, ident, parts = codec(path), None, None, []

        def done():
            return pa.RecordBatch.from_pydict({"id": pa.array([ident], pa.int64()), "ids": pa.array([c.concatenate(parts).astype("<u4").tobytes()], pa.binary())})

        for b in batches:
            for k, i, _, kind, raw in zip(*(col.to_pylist() for col in b.columns)):
                if k != key and parts:
                    yield done()
                    parts = []
                key, ident = k, i
                parts.append((kind, np.frombuffer(raw, "<u4").tolist()))
        if parts:
            yield done()

    leaves = "key long, id long, no long, kind string, raw binary"
    long = rows.where(F.length("text") > leaf_chars).mapInArrow(split, leaves)
    long = long.repartition(F.xxhash64("key", "no")).mapInArrow(leaf, leaves)
    long = long.repartition("key").sortWithinPartitions("key", "no").mapInArrow(merge, "id long, ids binary")
    return rows.where(F.length("text") <= leaf_chars).mapInArrow(short, "id long, ids binary").unionByName(long)


def decode_tokens(df: DataFrame, path: str | None = None) -> DataFrame:
    """(id, ids binary) to (id, ids, decoded string)."""
    path = path or default_path()

    @released
    def decode(batches):
        c = codec(path)
        for b in batches:
            texts = [c.decode(np.frombuffer(x, "<u4")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    return df.mapInArrow(decode, "id long, ids binary, decoded string")


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode_tokens(encode_tokens(table(spark, sf_dir, "documents")))
    return coded.select(
        F.col("id").alias("doc_id"),
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def digest(ids: np.ndarray, text: str) -> tuple[int, str, str]:
    """The query's columns for one text, for tests."""
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
