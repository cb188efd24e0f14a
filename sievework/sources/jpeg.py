"""Metadata inside JPEG files: segments, the picture's size, and an application segment of our own.

The segment APP15 holds the record of a face. It is written as JSON. Files from elsewhere may hold a
pickled mapping there; of that only plain containers, numbers, texts and numeric arrays are read, by an
unpickler that knows no other name, so that opening a file can run nothing.
"""

from __future__ import annotations

import base64
import io
import json
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Markers of the format.
START, END, SCAN = 0xD8, 0xD9, 0xDA
SIZES = {0xC0: "SOF0", 0xC2: "SOF2"}
NAMES = SIZES | {START: "SOI", END: "EOI", SCAN: "SOS", 0xC4: "DHT", 0xDB: "DQT", 0xDD: "DRI"}
FIRST_APP, OWN = 0xE0, 0xEF


class Corrupted(ValueError):
    pass


def segments(content: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(marker, start, payload, end) of each segment. A scan reaches up to the end marker."""
    at = 0
    while at < len(content):
        if content[at] != 0xFF or at + 1 >= len(content):
            raise Corrupted(f"no marker at {at}")
        marker, payload = content[at + 1], at + 2
        end = payload
        if marker & 0xF8 != 0xD0 and marker not in (START, END):
            size = int.from_bytes(content[payload : payload + 2], "big")
            end, payload = payload + size, payload + 2
            if size < 2 or end > len(content):
                raise Corrupted(f"a segment at {at} that does not fit")
        elif marker == START and at:
            raise Corrupted(f"a second start at {at}")
        if marker == SCAN:
            found = content.find(bytes([0xFF, END]), end)
            end = found if found >= 0 else len(content)
        yield marker, at, payload, end
        at = end


def named(marker: int) -> str | None:
    if FIRST_APP <= marker <= OWN:
        return f"APP{marker - FIRST_APP}"
    return f"RST{marker & 7}" if marker & 0xF8 == 0xD0 else NAMES.get(marker)


class _Plain(pickle.Unpickler):
    KNOWN = {
        ("numpy", "ndarray"), ("numpy", "dtype"), ("_codecs", "encode"),
        *((f"numpy.{core}.multiarray", name) for core in ("core", "_core") for name in ("_reconstruct", "scalar")),
    }

    def find_class(self, module, name):
        if (module, name) not in self.KNOWN:
            raise Corrupted(f"{module}.{name} is no plain value")
        return super().find_class(module, name)


def _simple(value):
    """Values as JSON has them: arrays as lists, bytes as base64."""
    if isinstance(value, np.ndarray):
        return _simple(value.tolist())
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, bytes):
        return base64.b64encode(value).decode()
    if isinstance(value, dict):
        return {str(k): _simple(v) for k, v in value.items()}
    return [_simple(x) for x in value] if isinstance(value, (list, tuple)) else value


def decoded(payload: bytes) -> str:
    """The own segment's record as JSON."""
    record = json.loads(payload) if payload[:1] == b"{" else _Plain(io.BytesIO(payload)).load()
    if not isinstance(record, dict):
        raise Corrupted("the own segment holds no mapping")
    return json.dumps(_simple(record))


def described(content: bytes | None) -> tuple[int | None, int | None, str | None]:
    """Height, width and the own record of a file."""
    if content is None:
        raise Corrupted("no content")
    height = width = record = None
    for marker, _, payload, end in segments(content):
        if marker in SIZES:
            height, width = (int.from_bytes(content[payload + k : payload + k + 2], "big") for k in (1, 3))
        elif marker == FIRST_APP and content[payload : payload + 4] != b"JFIF":
            raise Corrupted("the first application segment is no JFIF")
        elif marker == OWN:
            record = decoded(content[payload:end])
    return height, width, record


def rewritten(content: bytes, record: str | None) -> bytes:
    """The file with this record in place of its own: behind the last application segment, or behind
    the start if there is none. Names without a value are left out; no record at all removes it."""
    if content is None:
        raise Corrupted("no content")
    parts, place = [], 0
    for marker, start, _, end in segments(content):
        if marker != OWN:
            parts.append(content[start:end])
            if FIRST_APP <= marker <= OWN or marker == START:
                place = len(parts)
    kept = {k: v for k, v in json.loads(record).items() if v is not None} if record is not None else {}
    if kept:
        payload = json.dumps(kept).encode()
        if len(payload) > 0xFFFF - 2:
            raise Corrupted("the record does not fit in a segment")
        parts.insert(place, bytes([0xFF, OWN]) + (len(payload) + 2).to_bytes(2, "big") + payload)
    return b"".join(parts)


def _each(files: DataFrame, key: str, others: tuple[str, ...], schema: str, make) -> DataFrame:
    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                some = batch.slice(low, 64)
                rows = [x for row in zip(*(c.to_pylist() for c in some.columns), strict=True) for x in make(*row)]
                kinds = pa.schema([(x.split()[0], _ARROW[x.split()[1]]) for x in schema.split(", ")])
                columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                yield pa.record_batch([pa.array(c, kind.type) for c, kind in zip(columns, kinds, strict=True)], schema=kinds)

    return files.select(F.col(key).cast("string").alias("path"), *others).mapInArrow(run, schema)


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def read_segments(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(path, number, marker, name, size, error): a row for each segment of each file, in order; a file
    that cannot be read to its end has a last row with the error."""

    def make(path, data):
        number = 0
        try:
            if data is None:
                raise Corrupted("no content")
            for marker, start, _, end in segments(data):
                yield path, number, marker, named(marker), end - start, None
                number += 1
        except Corrupted as error:
            yield path, number, None, None, None, f"Corrupted JPG: {error}"

    return _each(files, key, (content,), "path string, number int, marker int, name string, size long, error string", make)


def read_metadata(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(path, height, width, record, error): a row for each file. record is JSON, null where there is
    none; from_json with faceset.FACES makes a face of it. A file that cannot be read has nulls and
    the error, and stops nothing."""

    def make(path, data):
        try:
            yield path, *described(data), None
        except Exception as error:  # whatever a foreign pickle may run into
            yield path, None, None, None, f"{type(error).__name__}: {error}"

    return _each(files, key, (content,), "path string, height int, width int, record string, error string", make)


def write_metadata(files: DataFrame, key: str = "path", content: str = "content", record: str = "record") -> DataFrame:
    """(path, content, error): the files' bytes with these records. Nothing is written in place."""

    def make(path, data, held):
        try:
            yield path, rewritten(data, held), None
        except (Corrupted, json.JSONDecodeError, AttributeError) as error:
            yield path, None, f"{type(error).__name__}: {error}"

    return _each(files, key, (content, record), "path string, content binary, error string", make)
