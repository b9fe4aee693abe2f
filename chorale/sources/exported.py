"""Weights exported as protocol-buffer graphs: the tensors of one or two files, sizes inferred from their shapes, a vocabulary.

Only the graph's stored tensors of floating-point kinds are read, under the names of models.RENAMES; other parts of the graph are
passed over. Their rows hold the numbers in the file's order and the shape innermost dimension first, as in the other layouts, so a
matrix [out, in] of the graph is listed as [in, out]. Files are untrusted, as in models: lengths are checked before anything is
taken, and a bad file is an error of its own row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.functions.kernels import mel_filters
from chorale.operators.scorer import LANGUAGES
from chorale.sources.models import HPARAMS, MAX_COUNT, MAX_DIMS, RENAMES, Model, ModelError, Reader, parse_vocabulary

# Numbers of fields in a graph's messages, and of element kinds.
GRAPH, TENSOR = 7, 5
DIMS, KIND, FLOATS, NAME, RAW, DOUBLES, LOCATION = 1, 2, 4, 8, 9, 10, 14
FLOAT, HALF, DOUBLE, BFLOAT = 1, 10, 11, 16
# The fallback vocabulary's special tokens; languages stand from FIRST_LANGUAGE on.
FIRST_LANGUAGE = 50258
SPECIAL = {50256: "endoftext", 50257: "startoftranscript", 50358: "translate", 50359: "transcribe", 50360: "startoflm", 50361: "startofprev", 50362: "nospeech", 50363: "notimestamps"}
#: Samples of one attention head in every size of the model.
HEAD = 64


def varint(r: Reader) -> int:
    value = shift = 0
    while True:
        b = r.take(1)[0]
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value
        if shift > 63:
            raise ModelError("a number is too long")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message."""
    r = Reader(data)
    while r.at < len(data):
        key = varint(r)
        wire = key & 7
        if wire not in (0, 1, 2, 5):
            raise ModelError(f"unknown kind {wire} of field")
        yield key >> 3, varint(r) if wire == 0 else r.take(varint(r) if wire == 2 else 8 if wire == 1 else 4)


def varints(data: bytes) -> list[int]:
    r, out = Reader(data), []
    while r.at < len(data):
        out.append(varint(r))
    return out


def numbers(kind: int, raw: bytes | None, floats: bytearray, doubles: bytearray) -> np.ndarray:
    if raw is None:
        return np.frombuffer(floats, "<f4") if kind == FLOAT else np.frombuffer(doubles, "<f8").astype("<f4")
    if kind == BFLOAT:
        return (np.frombuffer(raw, "<u2").astype("<u4") << 16).view("<f4")
    return np.frombuffer(raw, {FLOAT: "<f4", HALF: "<f2", DOUBLE: "<f8"}[kind]).astype("<f4")


def tensors_of(data: bytes) -> Iterator[tuple[str, tuple[int, ...], np.ndarray]]:
    """Name, shape (innermost first) and numbers of a file's stored tensors of floating-point kinds."""
    for graph in (v for k, v in fields(data) if k == GRAPH and isinstance(v, bytes)):
        for tensor in (v for k, v in fields(graph) if k == TENSOR and isinstance(v, bytes)):
            dims, kind, name, raw, floats, doubles, away = [], 0, "", None, bytearray(), bytearray(), 0
            for k, v in fields(tensor):
                if k in (NAME, RAW, FLOATS, DOUBLES) and not isinstance(v, bytes):
                    raise ModelError(f"field {k} of a tensor is a number")
                if k == DIMS:
                    dims += varints(v) if isinstance(v, bytes) else [v]
                elif k == KIND:
                    kind = v
                elif k == NAME:
                    name = v.decode("utf-8", "replace")
                elif k == RAW:
                    raw = v
                elif k == FLOATS:
                    floats += v
                elif k == DOUBLES:
                    doubles += v
                elif k == LOCATION:
                    away = v
            if kind not in (FLOAT, HALF, DOUBLE, BFLOAT):
                continue
            if away:
                raise ModelError(f"tensor {name} is kept in another file")
            if len(dims) > MAX_DIMS:
                raise ModelError(f"tensor {name} has {len(dims)} dimensions")
            x = numbers(kind, raw, floats, doubles)
            if math.prod(dims) != x.size:
                raise ModelError(f"tensor {name} has {x.size} numbers for a shape of {math.prod(dims)}")
            yield name, tuple(dims[::-1]), x


def own_name(name: str) -> str | None:
    """What an export's tensor is called here; None for one that no part of the model has."""
    name = reduce(lambda n, rule: re.sub(*rule, n), RENAMES, name)
    return name if re.match(r"(encoder|decoder)\.", name) else None


def sizes(shapes: dict[str, tuple[int, ...]]) -> dict[str, int]:
    """Hyper-parameters from the shapes of a whole model's tensors."""

    def dim(name: str, k: int, of: int) -> int:
        if len(shapes.get(name, ())) != of:
            raise ModelError(f"{name} of {of} dimensions is missing")
        return shapes[name][k]

    def blocks(part: str) -> int:
        found = [int(m[1]) for m in (re.match(rf"{part}\.blocks\.(\d+)\.", n) for n in shapes) if m]
        if not found:
            raise ModelError(f"{part} has no blocks")
        return max(found) + 1

    def heads(state: int) -> int:
        if state <= 0 or state % HEAD:
            raise ModelError(f"a width of {state} is no multiple of {HEAD}")
        return state // HEAD

    audio, text = dim("encoder.conv1.bias", 0, 1), dim("decoder.ln.weight", 0, 1)
    found = {
        "n_vocab": dim("decoder.token_embedding.weight", 1, 2),
        "n_audio_ctx": dim("encoder.positional_embedding", 1, 2),
        "n_audio_state": audio,
        "n_audio_head": heads(audio),
        "n_audio_layer": blocks("encoder"),
        "n_text_ctx": dim("decoder.positional_embedding", 1, 2),
        "n_text_state": text,
        "n_text_head": heads(text),
        "n_text_layer": blocks("decoder"),
        "n_mels": dim("encoder.conv1.weight", 1, 3),
        "ftype": 0,
    }
    return {k: found[k] for k in HPARAMS}


def vocabulary(text: str | None, n: int) -> list[str]:
    """Tokens of a vocabulary file, gaps and the rest up to n by number; without a file, single characters and special tokens."""
    if n > MAX_COUNT:
        raise ModelError("the vocabulary is too large")
    special: dict[int, str] = {}
    if text is None:
        listed = [chr(i) if 32 <= i < 127 else f"<|byte_{i}|>" for i in range(min(n, 256))]
        special = {i: f"<|{s}|>" for i, s in (SPECIAL | dict(enumerate([*LANGUAGES, "yue"], FIRST_LANGUAGE))).items()}
    else:
        listed = parse_vocabulary(text.strip())
    listed += [""] * (n - len(listed))
    return [special.get(i) or t or f"<|extra_{i}|>" for i, t in enumerate(listed)]


def load(files: list[bytes], vocab: str | None = None) -> Model:
    """A model of one file or of an encoder's and a decoder's; of tensors with one name the last counts."""
    tensors = {}
    for data in files:
        tensors |= {own: (shape, "f32", x.tobytes()) for name, shape, x in tensors_of(data) if (own := own_name(name))}
    hparams = sizes({k: v[0] for k, v in tensors.items()})
    return Model(hparams, vocabulary(vocab, hparams["n_vocab"]), mel_filters() if hparams["n_mels"] == 80 else np.zeros((hparams["n_mels"], 201), np.float32), tensors)


COLUMNS = "path string, part string, name string, idx int, shape array<long>, dtype string, n_bytes long, raw binary, text string"


def read_exported(spark: SparkSession, paths: list[str], vocab_path: str | None = None) -> DataFrame:
    """The items of a model in these files, as models.read_model gives them; path is each tensor's own file, and the first otherwise.

    Sizes come from a table of names and shapes without the numbers, so that no task holds more than one file.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def stored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for where, content in zip(pdf.path, pdf.content):
                try:
                    for i, (name, shape, x) in enumerate(tensors_of(bytes(content))):
                        if own := own_name(name):
                            yield pd.DataFrame([(where, "tensor", own, i, list(shape), "f32", x.nbytes, x.tobytes(), None)], columns=names)
                except ValueError as e:
                    yield pd.DataFrame([(where, "error", None, 0, [], None, 0, None, str(e))], columns=names)

    known = spark.read.text(vocab_path, wholetext=True).first() if vocab_path else None
    text = (known[0] if known else "") if vocab_path else None

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            hparams = sizes({n: tuple(map(int, s)) for n, s, p in zip(pdf.name, pdf["shape"], pdf.part) if p == "tensor"})
            rows = [("hparam", k, i, [], "i32", 4, None, str(v)) for i, (k, v) in enumerate(hparams.items())]
            rows += [("vocab", None, i, [], "utf8", len(t.encode()), None, t) for i, t in enumerate(vocabulary(text, hparams["n_vocab"]))]
        except ModelError as e:
            rows = [("error", None, 0, [], None, 0, None, str(e))]
        return pd.DataFrame([(min(pdf.path), *r) for r in rows], columns=names)

    tensors = spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(stored, COLUMNS)
    return tensors.unionByName(tensors.select("path", "part", "name", "shape").groupBy(F.lit("model").alias("model")).applyInPandas(told, COLUMNS))
