"""SentencePiece encoding and decoding by the tokenizers library.

The model's protobuf is read field by field: pieces with scores and types, the normaliser's rules, the model's type. From these a tokenizer is
rebuilt: the normaliser's character map, the metaspace marker, unigram scores (or, in a BPE model, merges in the order of the merged pieces'
scores) and byte fallback. Where no piece has the marker behind another character, texts are cut ahead of markers, each different unit
is encoded once per worker in multithreaded batches, and every such unit is held against the sentencepiece library (column `parity`). Texts as a whole are,
if the model has a character map or squeezes white space, and any text that holds a unit which can't be given to that library alone (markers that end a text).
Parity is null where nothing was compared.

Decoding (`decoded`) goes through the tokenizers library in batches. Ids of unknown or control pieces, which that library spells out, are decoded by the
model's own table of pieces, and so is the round trip of `checked`, at a fraction of the time; tests hold both against sentencepiece.

Null text counts as empty: no ids. A null doc_id is kept. Repeated rows are encoded each. An empty table gives no rows. Other columns are
ignored. Text that spells a control piece (such as <s>) is ordinary text, as in sentencepiece.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import pick
from .packing import vocabulary_path
from .units import Units, divided, slices

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Numbers of the model file's format. Fixed values.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes):
    """(number, value) of a protobuf message: ints, and bytes of the other kinds."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Codec:
    """encode() and decode() of whole texts."""

    def __init__(self, path: str, verify: bool = True):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces, self.scores, self.types = [], [], []
        trainer, rules = {}, {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                rules = dict(fields(value))
        self.unk = self.types.index(UNKNOWN)
        self.kind, self.fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        self.charsmap, self.prefix, self.squeeze = rules.get(2, b""), bool(rules.get(3, 1)), bool(rules.get(4, 1))
        self.tokenizer = self._tokenizer()
        self.crosses = any(MARK in p.lstrip(MARK) for p, t in zip(self.pieces, self.types, strict=True) if t in (NORMAL, USER))
        self.find = re.compile("(?s).+" if self.crosses else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.units = Units(self._encode_units)
        self.theirs = None
        if verify:
            import sentencepiece

            self.theirs = sentencepiece.SentencePieceProcessor(model_file=path)
        self.wrong: set[str] = set()
        self.sizes = np.array([1 if t == BYTE else len(p.encode()) for p, t in zip(self.pieces, self.types, strict=True)])
        shown = {NORMAL, USER, UNUSED}
        self.odd = {i for i, t in enumerate(self.types) if t in (UNKNOWN, CONTROL)}
        self.table = [
            bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() if t in shown else " ⁇ ".encode() if t == UNKNOWN else b""
            for p, t in zip(self.pieces, self.types, strict=True)
        ]

    def _tokenizer(self):
        from tokenizers import Tokenizer, decoders, models, normalizers

        if self.kind == UNIGRAM:
            model = models.Unigram(list(zip(self.pieces, self.scores, strict=True)), self.unk, self.fallback)
        elif self.kind == BPE:
            ids = {p: i for i, p in enumerate(self.pieces)}
            whole = {p: i for p, i in ids.items() if self.types[i] in (NORMAL, USER)}
            merges = sorted((-self.scores[i], i, k) for p, i in whole.items() for k in range(1, len(p)) if p[:k] in whole and p[k:] in whole)
            model = models.BPE(ids, [(self.pieces[i][:k], self.pieces[i][k:]) for _, i, k in merges], unk_token=self.pieces[self.unk], fuse_unk=True, byte_fallback=self.fallback)
        else:
            raise ValueError(f"model type {self.kind} is neither unigram nor BPE")
        tokenizer = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            from tokenizers import Regex

            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        self.normalizer = normalizers.Sequence(steps) if steps else None
        tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.prefix else [])])
        return tokenizer

    def normalised(self, text: str) -> str:
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        return ((" " if self.prefix else "") + text).replace(" ", MARK) if text else ""

    def _ids(self, new: list[str]) -> list[bytes]:
        """Ids of units, encoded a few hundred side by side (nothing is merged across units) and told apart by their bytes."""
        if self.fallback and not self.crosses and not any(u[-1] == MARK for u in new):
            few = [new[i : i + 256] for i in range(0, len(new), 256)]
            got = self.tokenizer.encode_batch_fast(["".join(x) for x in few], add_special_tokens=False)
            ids = [np.array(e.ids, np.int64) for e in got]
            if not any((x == self.unk).any() for x in ids):
                return [b for x, units in zip(ids, few, strict=True) for b in divided(x, self.sizes, units)]
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]

    def _encode_units(self, new: list[str]) -> list[bytes]:
        open_ = [u for u in new if u[-1] == MARK]  # the next unit's markers would join these
        known = dict(zip(open_, self._ids(open_), strict=True)) if open_ else {}
        closed = [u for u in new if u not in known]
        known.update(zip(closed, self._ids(closed), strict=True))
        ours = [known[u] for u in new]
        if self.theirs and not (self.squeeze or self.charsmap):
            at = 1 if self.prefix else 0  # they put the first marker before it themselves
            fit = [i for i, u in enumerate(new) if not at or u[:1] == MARK != u]
            for i, ids in zip(fit, self.theirs.encode([new[i][at:].replace(MARK, " ") for i in fit], num_threads=1), strict=True):
                if np.array(ids, "<u4").tobytes() != ours[i]:
                    self.wrong.add(new[i])
        return ours

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b, "<u4") for b in self.units.of([self.find(self.normalised(t)) for t in texts])]

    def agrees(self, text: str, ids: np.ndarray) -> bool | None:
        """Whether the ids are those of the sentencepiece library: by the text's units, or of the whole text where not all units were compared. Null if
        that library isn't there to compare."""
        if not self.theirs:
            return None
        normal = self.normalised(text)
        if self.squeeze or self.charsmap or self.prefix and (normal[-1:] == MARK or normal[:1] not in ("", MARK)):
            return self.theirs.encode(text) == ids.tolist()
        return not self.wrong or self.wrong.isdisjoint(self.find(normal))

    def decode_batch(self, rows: list[list[int]]) -> list[str]:
        """By the tokenizers library, many texts at once."""
        spelled = [not self.odd.isdisjoint(ids) for ids in rows]
        found = iter(self.tokenizer.decode_batch([ids for ids, odd in zip(rows, spelled, strict=True) if not odd], skip_special_tokens=False))
        return [self.decode(ids) if odd else next(found) for ids, odd in zip(rows, spelled, strict=True)]

    def decode(self, ids) -> str:
        text = b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@functools.cache
def codec(path: str, verify: bool) -> Codec:
    """One to a worker, which keeps it from task to task."""
    return Codec(path, verify)


SCHEMA = "doc_id long, n_ids long, ids_crc32 long, n_unknown long, decoded_sha256 string, round_trip boolean, parity boolean"


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every text."""

    def run(batches):
        coder = codec(path, False)
        for batch in batches:
            for a, b in slices(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
                texts = [x or "" for x in batch.column(1).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x.astype(np.int32) for x in coder.encode(texts)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches):
        coder = codec(path, False)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(coder.decode_batch([x or [] for x in batch.column(1).to_pylist()]), pa.string())], names=["doc_id", "text"])

    return pick(rows, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, text string")


def checked(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every whole text: number and checksum of its ids, hash of the decoded text, whether that is the text, parity."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]

    def run(batches):
        coder = codec(path, True)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b in slices(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
                texts = [x or "" for x in batch.column(1).slice(a, b - a).to_pylist()]
                rows = []
                for key, text, ids in zip(keys[a:b], texts, coder.encode(texts), strict=True):
                    back = coder.decode(ids.tolist())
                    rows.append((key, len(ids), zlib.crc32(ids.tobytes()), int((ids == coder.unk).sum()), hashlib.sha256(back.encode()).hexdigest(), back == text, coder.agrees(text, ids)))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return pick(docs, doc_id="long", text="string").mapInArrow(run, SCHEMA)


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return checked(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path(MODEL))
