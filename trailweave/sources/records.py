"""Records in MessagePack, with arrays of numbers as the usual maps of type, shape and bytes."""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the format: leading byte -> how a number, or the length of what follows, is written.
NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
SIZED = {0xC4: (">B", "bin"), 0xC5: (">H", "bin"), 0xC6: (">I", "bin"), 0xD9: (">B", "str"), 0xDA: (">H", "str"), 0xDB: (">I", "str"), 0xDC: (">H", "list"), 0xDD: (">I", "list"), 0xDE: (">H", "map"), 0xDF: (">I", "map")}
ALONE = {0xC0: None, 0xC2: False, 0xC3: True}


def _read(raw: memoryview, at: int) -> tuple[object, int]:
    lead = raw[at]
    at += 1
    if lead < 0x80:
        return lead, at
    if lead >= 0xE0:
        return lead - 256, at
    if lead in ALONE:
        return ALONE[lead], at
    if lead in NUMBERS:
        form = NUMBERS[lead]
        return struct.unpack_from(form, raw, at)[0], at + struct.calcsize(form)
    if lead in SIZED:
        form, kind = SIZED[lead]
        n, at = struct.unpack_from(form, raw, at)[0], at + struct.calcsize(form)
    else:
        n, kind = (lead & 0x1F, "str") if lead >= 0xA0 else (lead & 0x0F, "list" if lead >= 0x90 else "map")
        if lead in (0xC1, *range(0xC7, 0xCA), *range(0xD4, 0xD9)):
            raise ValueError(f"records have no extension types, found {lead:#x}")
    if kind in ("bin", "str"):
        part = bytes(raw[at : at + n])
        if len(part) < n:
            raise ValueError("a record ends too early")
        return part if kind == "bin" else part.decode("utf-8"), at + n
    items = []
    for _ in range(n * (2 if kind == "map" else 1)):
        item, at = _read(raw, at)
        items.append(item)
    return (items if kind == "list" else _map(dict(zip(items[::2], items[1::2])))), at


def _map(found: dict) -> object:
    """A map, or the array that it stands for."""
    of = {k.decode() if isinstance(k, bytes) else k: v for k, v in found.items()}
    if of.get("nd") is not True:
        return of
    kind = of["type"]
    return np.frombuffer(of["data"], np.dtype(kind.decode() if isinstance(kind, bytes) else kind)).reshape(of["shape"]).tolist()


def unpacked(raw: bytes) -> object:
    """The value of a whole record."""
    try:
        value, at = _read(memoryview(raw), 0)
    except (IndexError, struct.error) as e:
        raise ValueError("a record ends too early") from e
    if at != len(raw):
        raise ValueError(f"{len(raw) - at} bytes after a record")
    return value


def _sized(n: int, small: tuple[int, int] | None, leads: tuple[int, ...]) -> bytes:
    """A length; ``small``: the greatest that its leading byte holds, and that byte."""
    if small and n <= small[0]:
        return bytes([small[1] | n])
    form, lead = next((f, x) for f, x in zip((">B", ">H", ">I")[-len(leads) :], leads) if n < 256 ** struct.calcsize(f))
    return bytes([lead]) + struct.pack(form, n)


def packed(value: object) -> bytes:
    """A value as a record. Arrays of numpy keep their type."""
    if value is None or isinstance(value, (bool, np.bool_)):
        return bytes([0xC0 if value is None else 0xC3 if value else 0xC2])
    if isinstance(value, (int, np.integer)):
        if 0 <= value < 128 or -32 <= value < 0:
            return bytes([int(value) % 256])
        return bytes([0xD3]) + struct.pack(">q", value) if value < 2**63 else bytes([0xCF]) + struct.pack(">Q", value)
    if isinstance(value, (float, np.floating)):
        return bytes([0xCB]) + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return _sized(len(raw), (31, 0xA0), (0xD9, 0xDA, 0xDB)) + raw
    if isinstance(value, (bytes, bytearray)):
        return _sized(len(value), None, (0xC4, 0xC5, 0xC6)) + bytes(value)
    if isinstance(value, np.ndarray):
        if value.dtype.kind in "fiub":
            return packed({"nd": True, "type": value.dtype.str, "kind": "", "shape": list(value.shape), "data": value.tobytes()})
        return packed(value.tolist())
    if isinstance(value, (list, tuple)):
        return _sized(len(value), (15, 0x90), (0xDC, 0xDD)) + b"".join(map(packed, value))
    if isinstance(value, dict):
        return _sized(len(value), (15, 0x80), (0xDE, 0xDF)) + b"".join(packed(x) for kv in value.items() for x in kv)
    raise TypeError(f"records can't hold {type(value).__name__}")
