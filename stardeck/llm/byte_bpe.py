"""Byte-level BPE by sentencepiece, with a model written directly from a vocabulary of ranks.

Every token becomes a piece in which each byte is a visible letter, with its negative rank as score, so that
sentencepiece merges in the order of ranks; normalisation is the identity. Pre-tokens that are tokens
themselves are taken from the vocabulary. Ids are the ranks; decoding maps ids back to bytes.

Cases: a null or empty text has no ids (and the hash of nothing); a null id keeps its row; repeated rows
are encoded each; long texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from .common import pieces
from .packing import byte_letters

#: Pre-tokens that a worker remembers; beyond that it starts anew.
MOST_PRETOKENS = 500_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens in the order of their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as file:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in file if line.strip()))
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return [t for _, t in ranked]


def model_of(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks; the unknown piece comes last."""
    letters = byte_letters()
    model = proto.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece=token.decode("latin-1").translate(letters), score=-float(rank), type=proto.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=proto.ModelProto.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type = proto.TrainerSpec.BPE
    spec.vocab_size = len(tokens) + 1
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = len(tokens), -1, -1, -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Codec(dict):
    """Pre-token to its ids, as decimal text joined by commas."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        tokens = read_ranks(path)
        self.ranks = {t: str(r) for r, t in enumerate(tokens)}
        self.bytes_of = {str(r): t for r, t in enumerate(tokens)}
        self.letters = byte_letters()
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model_of(tokens))
        self.parts = regex.compile(pattern).findall

    def __missing__(self, pretoken: str) -> str:
        if len(self) >= MOST_PRETOKENS:
            self.clear()
        raw = pretoken.encode("utf-8", "replace")
        ids = self.ranks.get(raw) or ",".join(map(str, self.pieces.encode(raw.decode("latin-1").translate(self.letters))))
        self[pretoken] = ids
        return ids

    def encode(self, text: str | None) -> str:
        return ",".join(map(self.__getitem__, self.parts(text))) if text else ""

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _encode(path: str, pattern: str):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in pieces(batches, 1):
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            numbers = [x.count(",") + 1 if x else 0 for x in ids]
            lists = pa.array([list(map(int, x.split(","))) if x else [] for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int64()), lists], ["doc_id", "n_tokens", "ids"])

    return make


def _digests(path: str, pattern: str):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in pieces(batches, 1):
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            numbers = [x.count(",") + 1 if x else 0 for x in ids]
            encoded = [hashlib.sha256(x.encode()).hexdigest() for x in ids]
            decoded = [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int64()), pa.array(encoded), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return make


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (array<int>) for every row."""
    d = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return d.mapInArrow(_encode(ranks_path, pattern), "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the bytes that the ids stand for, for every row of encode()'s result; null ids give no bytes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = read_ranks(ranks_path)
        for batch in batches:
            raw = [b"".join([tokens[i] for i in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(make, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 (of the decoded bytes)."""
    d = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return d.mapInArrow(_digests(ranks_path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
