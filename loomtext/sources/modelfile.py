"""The binary model file, format 1: magic, JSON header, merges, tensors at 3, 4 or 8 bits or as floats."""

from __future__ import annotations

import io
import json
import math
import urllib.request
from dataclasses import dataclass
from pathlib import Path

import numpy as np

#: Fixed value: the first four bytes of a file.
MAGIC = b"LMAP"


@dataclass
class Model:
    header: dict
    merges: np.ndarray
    weights: dict[str, np.ndarray]

    def tokenizer(self):
        from ..functions.bpe import Tokenizer

        return Tokenizer([tuple(m) for m in self.merges.tolist()], self.header["byte_ids"], self.header["merges_base"])


def pack(values: np.ndarray, bits: int) -> bytes:
    """Signed integers as a stream of ``bits`` bits each, the lowest bit first; stored without sign by adding half the range."""
    raw = values.ravel().astype(np.int64) + (1 << (bits - 1))
    if bits == 8:
        return raw.astype(np.uint8).tobytes()
    return np.packbits(((raw[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 8:
        raw = np.frombuffer(data, np.uint8, n).astype(np.int64)
    else:
        stream = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little")
        raw = stream.reshape(n, bits) @ (1 << np.arange(bits, dtype=np.int64))
    return raw - (1 << (bits - 1))


def quantize(a: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(integers, scale per row): rows are scaled to the symmetric range of ``bits`` bits."""
    top = (1 << (bits - 1)) - 1
    scale = np.maximum(np.abs(a).reshape(len(a), -1).max(axis=1), 1e-8) / top
    shape = (-1, *[1] * (a.ndim - 1))
    return np.clip(np.rint(a / scale.reshape(shape)), -top, top).astype(np.int64), scale


def write(header: dict, merges: np.ndarray, weights: dict[str, np.ndarray], bits: int = 4) -> bytes:
    """Small tensors and vectors stay half floats; at 32 bits all stay floats."""
    listed, body = [], io.BytesIO()
    for name, a in weights.items():
        a = np.asarray(a)
        if bits == 32:
            kind, data = "f32", a.astype("<f4").tobytes()
        elif a.ndim < 2 or a.size < 64:
            kind, data = "f16", a.astype("<f2").tobytes()
        else:
            q, scale = quantize(a, bits)
            kind, data = f"q{bits}", pack(q, bits) + scale.astype("<f2").tobytes()
        listed.append({"name": name, "shape": list(a.shape), "type": kind, "bytes": len(data)})
        body.write(data)
    merges = np.asarray(merges, "<u2").reshape(-1, 2)
    head = json.dumps(header | {"format": 1, "bits": bits, "n_merges": len(merges), "tensors": listed}, separators=(",", ":")).encode()
    size = lambda n: int(n).to_bytes(4, "little")
    return b"".join((MAGIC, size(len(head)), head, size(merges.nbytes), merges.tobytes(), body.getvalue()))


def size_estimate(weights: dict[str, np.ndarray], bits: int) -> float:
    """Bytes of the tensors at ``bits`` bits, with a half float a row as scale; small tensors and vectors are half floats."""
    cut = [np.asarray(a) for a in weights.values()]
    large = [a for a in cut if a.ndim >= 2 and a.size >= 64]
    n = sum(a.size for a in large)
    return n * bits / 8 + 2 * (sum(a.size for a in cut) - n) + 2 * sum(len(a) for a in large)


def parse(data: bytes) -> Model:
    view = memoryview(data)

    def take(n: int) -> memoryview:
        nonlocal view
        if len(view) < n:
            raise ValueError("the file ends early")
        part, view = view[:n], view[n:]
        return part

    if bytes(take(4)) != MAGIC:
        raise ValueError("not a model file")
    header = json.loads(bytes(take(int.from_bytes(take(4), "little"))))
    if header.get("format", 1) != 1:
        raise ValueError(f"format {header['format']} is not supported")
    merges = np.frombuffer(take(int.from_bytes(take(4), "little")), "<u2").reshape(-1, 2)
    weights = {}
    for t in header["tensors"]:
        blob, shape = bytes(take(t["bytes"])), tuple(t["shape"])
        if t["type"][0] == "f":
            a = np.frombuffer(blob, "<f4" if t["type"] == "f32" else "<f2").astype(np.float32)
        else:
            bits, n = int(t["type"][1:]), math.prod(shape)
            used = -(-n * bits // 8)
            a = unpack(blob[:used], n, bits).reshape(shape[0], -1) * np.frombuffer(blob[used:], "<f2").astype(np.float32)[:, None]
        weights[t["name"]] = a.reshape(shape).astype(np.float32)
    return Model(header, merges, weights)


def load(source) -> Model:
    """From a path, a URL, bytes or a readable object; anything else is a TypeError."""
    if isinstance(source, Model):
        return source
    if isinstance(source, (bytes, bytearray, memoryview)):
        return parse(bytes(source))
    if hasattr(source, "read"):
        return parse(source.read())
    if isinstance(source, str) and source.startswith(("http://", "https://")):
        with urllib.request.urlopen(source, timeout=60) as r:
            return parse(r.read())
    if isinstance(source, (str, Path)):
        return parse(Path(source).read_bytes())
    raise TypeError(f"a model can't be loaded from {type(source).__name__}")


def manifest(files: dict[str, bytes]) -> list[dict]:
    """One entry per file by its own header: file, scope, precision, bytes, parameters, vocab, languages."""
    out = []
    for name, data in sorted(files.items()):
        m = parse(data)
        h = m.header
        out.append({"file": name, "scope": h.get("scope", ""), "precision": h.get("precision", f"int{h['bits']}" if h["bits"] != 32 else "fp32"), "bytes": len(data), "parameters": int(sum(w.size for w in m.weights.values())), "vocab": h["vocab"], "languages": h.get("languages", [])})
    return out


def file_name(scope: str, precision: str, version: str = "1") -> str:
    return f"titler-v{version}-{scope}-{precision}.bin"
