"""SentencePiece models run by the tokenizers library.

The model's protobuf is read and its parts are rebuilt: normaliser, space mark, pieces with their scores (unigram
models) or the merges that the scores imply (BPE models), and byte fallback. No piece has the space mark after another
character (checked when the model is read), so a text can be cut before every run of space marks and each segment be
encoded by itself: distinct segments go through the library once per worker, in multithreaded batches, and every one of
them is compared with the reference implementation's ids.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import releasing

_SPACE = "▁"
_SPACES = re.compile(" {2,}")
STORE, ROUND_TRIP_STORE = 150_000, 400_000  # segments that a task remembers, where memory is short, and a worker, where it is not
CHARS = 250_000  # of texts handled at once, unless one text alone is longer
_LEARN = 5_000  # new segments that go through both libraries at once
_NORMAL, _USER, _BYTE = 1, 4, 6  # fixed values: piece types of the protobuf
_UNIGRAM, _BPE = 1, 2  # fixed values: model types of the protobuf


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


class Codec:
    """Encodes and decodes; built from the bytes of a model file."""

    def __init__(self, model: bytes, store: int = STORE):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer, decoders, models, normalizers

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        rules, pieces = spec.normalizer_spec, [(p.piece, p.score) for p in spec.pieces]
        plain = [p.piece for p in spec.pieces if p.type in (_NORMAL, _USER)]
        if any(_SPACE in p.lstrip(_SPACE) for p in plain):
            raise ValueError("a piece has the space mark inside, so texts can't be cut at spaces")
        if not (rules.add_dummy_prefix and rules.escape_whitespaces):
            raise ValueError("the model treats white space in a way that is not supported")
        unknown = next(i for i, p in enumerate(spec.pieces) if p.type == 2)
        fallback = spec.trainer_spec.byte_fallback
        if spec.trainer_spec.model_type == _UNIGRAM:
            core = models.Unigram(pieces, unknown, fallback)
        elif spec.trainer_spec.model_type == _BPE:
            ranks = {p.piece: p.score for p in spec.pieces if p.type in (_NORMAL, _USER)}
            merges = [(-s, p[:i], p[i:]) for p, s in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks]
            merges.sort(key=lambda m: m[0])
            names = {p: i for i, (p, _) in enumerate(pieces)}
            core = models.BPE(names, [(a, b) for _, a, b in merges], unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=fallback, cache_capacity=0)
        else:
            raise ValueError("only unigram and BPE models are supported")
        self.tokenizer = Tokenizer(core)
        self.normalizer = normalizers.Precompiled(rules.precompiled_charsmap) if rules.precompiled_charsmap else None
        self.squeeze = rules.remove_extra_whitespaces
        self.store = store
        self.prefix = _SPACE
        self.tokenizer.decoder = decoders.Sequence(
            [decoders.Replace(_SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1, 0)]
        )
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else p.piece.replace(_SPACE, " ").encode() for p in spec.pieces]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = re.compile(f"{_SPACE}+[^{_SPACE}]*")
        self._forget()

    def normalized(self, text: str) -> str:
        plain = self.normalizer.normalize_str(text) if self.normalizer else text
        if self.squeeze:
            plain = _SPACES.sub(" ", plain).strip(" ")
        return self.prefix + plain.replace(" ", _SPACE) if plain else ""

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.same = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool)

    def _learn(self, segments: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)
        # The reference adds the first space mark itself, and drops a lone one: it sees an empty text.
        expected = self.model.encode([s[1:].replace(_SPACE, " ") for s in segments], num_threads=1)
        own = [x.ids for x in found]
        expected = [e if len(s) > 1 else o for s, o, e in zip(segments, own, expected, strict=True)]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        first = len(self.same)
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(own), np.int32, sizes.sum())])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.same = np.concatenate([self.same, np.fromiter(map(eq, own, expected), bool, len(own))])
        self.known.update(zip(segments, range(first, first + len(segments)), strict=True))  # last: all else is in place

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        """The tokenizers library's ids of each text, and whether the reference agrees on all its segments."""
        cut = [self.cut.findall(self.normalized(t)) for t in texts]
        needed = set(chain.from_iterable(cut))
        new = [s for s in needed if s not in self.known]
        if len(self.known) + len(new) > self.store:
            self._forget()
            new = list(needed)
        for start in range(0, len(new), _LEARN):
            self._learn(new[start : start + _LEARN])
        out = []
        for each in cut:
            rows = np.fromiter(map(self.known.__getitem__, each), np.int64, len(each))
            sizes = self.starts[rows + 1] - self.starts[rows]
            at = np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            out.append((self.flat[at], bool(self.same[rows].all())))
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Texts of ids. Their pieces' bytes are joined; what is then no UTF-8 is left to the library's byte fallback."""
        out = []
        for each in map(np.ndarray.tolist, ids):
            try:
                out.append(b"".join(map(self.raw.__getitem__, each)).decode().removeprefix(" "))
            except UnicodeDecodeError:
                out.append(self.tokenizer.decode(each, skip_special_tokens=False))
        return out


_KEPT: dict[tuple[str, int], Codec] = {}  # one at most


def kept_codec(model: bytes, store: int) -> Codec:
    """The worker's codec: tasks that a worker runs one after another share what it has learned, ``store`` segments at most."""
    key = (hashlib.sha256(model).hexdigest(), store)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Codec(model, store)
    return _KEPT[key]


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, text in enumerate(texts):
        chars += len(text)
        if chars >= CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _frames(codec: Codec, texts: list[str]) -> Iterator[pd.DataFrame]:
    """input_ids and parity of every text, a part of the texts at a time."""
    for start, end in _parts(texts):
        found = codec.encode(texts[start:end])
        yield pd.DataFrame({"input_ids": [x[0] for x in found], "parity": [x[1] for x in found]})


def encode(docs: DataFrame, path: str, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of ``docs``, with input_ids (array of int) and parity of every text.

    Null and empty texts have no ids. The ids are the tokenizers library's; ``parity``: the reference implementation
    gives the same. Names input_ids and parity must not be among ``columns``. An empty table gives an empty result.
    """
    model = read_model(path)

    @F.pandas_udf("struct<input_ids: array<int>, parity: boolean>")
    @releasing
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(model)
        for batch in batches:
            yield from _frames(codec, [t if isinstance(t, str) else "" for t in batch])

    out = docs.select(*columns, run("text").alias("_found"))
    return out.select(*columns, "_found.input_ids", "_found.parity")


def decode(encoded: DataFrame, path: str, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of ``encoded`` and the text of its input_ids; null ids give null, an empty table an empty result."""
    model = read_model(path)

    @F.pandas_udf("string")
    @releasing
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(model)
        for batch in batches:
            texts = codec.decode([np.asarray(x if x is not None else [], np.int32) for x in batch])
            yield pd.Series([t if x is not None else None for t, x in zip(texts, batch, strict=True)])

    return encoded.select(*columns, run("input_ids").alias("text"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Every text encoded and decoded: doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers),
    text_sha256 (of the decoded text in UTF-8), lossless (it equals the input; null counts as empty) and parity.

    A text with a literal space mark comes back with a space in its place, and a model that normalises texts or squeezes
    their spaces gives back what it made of them. Repeated rows give
    repeated rows; an empty table gives an empty result.
    """
    model = read_model(path)

    @F.pandas_udf("struct<n_tokens: bigint, ids_sha256: string, text_sha256: string, lossless: boolean, parity: boolean>")
    @releasing
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = kept_codec(model, ROUND_TRIP_STORE)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch]
            rows = []
            for a, b in _parts(texts):
                found = codec.encode(texts[a:b])
                back = codec.decode([x for x, _ in found])
                for text, (ids, same), again in zip(texts[a:b], found, back, strict=True):
                    digest = hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()
                    rows.append((len(ids), digest, hashlib.sha256(again.encode()).hexdigest(), again == text, same))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "text_sha256", "lossless", "parity"])

    return docs.select("doc_id", run("text").alias("_found")).select("doc_id", "_found.*")
