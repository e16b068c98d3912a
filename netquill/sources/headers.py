"""Packet headers of a batch of captured frames, decoded column by column with NumPy.

All frames of a batch lie behind one another in one buffer; a field is read for
all of them at once, so no packet is a Python object.
"""

from __future__ import annotations

import ipaddress

import numpy as np
import pyarrow as pa

# Protocol numbers and IPv6 extension headers.
TCP, UDP = 6, 17
HOP_BY_HOP, ROUTING, FRAGMENT, AUTHENTICATION, DESTINATION, MOBILITY = 0, 43, 44, 51, 60, 135
FLAGS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16}
PROBED = (14, 16, 18, 0)


class Frames:
    """Bytes of many frames; reading beyond a frame's end gives 0."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.binary()).fill_null(b"")
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.begin, self.length = at[:-1], np.diff(at)
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)

    def byte(self, at) -> np.ndarray:
        at = np.asarray(at)
        inside = (at >= 0) & (at < self.length)
        return np.where(inside, self.data[np.where(inside, self.begin + at, 0)], 0).astype(np.int64)

    def number(self, at, n: int) -> np.ndarray:
        out = self.byte(at)
        for i in range(1, n):
            out = out * 256 + self.byte(at + i)
        return out


def ip_start(f: Frames, linktype: np.ndarray, probe: bool, versions: tuple[int, ...]) -> np.ndarray:
    """Where the IP header stands: by link type, or at the first probed place that has a known version; -1 if at none."""
    if not probe:
        return np.where(linktype == 1, 14, np.where(linktype == 113, 16, 0))
    at = np.full(len(f.length), -1)
    for o in PROBED[::-1]:
        at = np.where((f.length > o) & np.isin(f.byte(np.full(len(at), o)) >> 4, versions), o, at)
    return at


def past_extensions(f: Frames, at: np.ndarray, kind: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Follow the chain of extension headers; the place and kind of what comes after, and whether its ports can be read.

    A later fragment has no ports, and a chain that leads out of the frame is
    dropped.
    """
    at, kind, ok = at.copy(), kind.copy(), active.copy()
    while True:
        known = np.isin(kind, (HOP_BY_HOP, ROUTING, DESTINATION, MOBILITY, FRAGMENT, AUTHENTICATION))
        go = ok & known
        if not go.any():
            return at, kind, ok
        whole = at + 8 <= f.length
        later = (kind == FRAGMENT) & (f.number(at + 2, 2) >> 3 > 0)
        ok &= ~(go & (~whole | later))
        go &= ok
        units = f.byte(at + 1)
        size = np.where(kind == FRAGMENT, 8, np.where(kind == AUTHENTICATION, (units + 2) * 4, (units + 1) * 8))
        kind, at = np.where(go, f.byte(at), kind), np.where(go, at + size, at)


def decode_frames(raw: pa.Array, linktype: np.ndarray, probe: bool = False, ipv6: bool = False) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Which frames are TCP or UDP over IP, and the fields of those.

    Frames with a bad header, other protocols and payload offsets outside the
    frame are left out.  With ``ipv6`` both versions are read and fields hold
    ``src_addr`` and ``dst_addr``, 16 bytes each, IPv4 in its mapped form; the
    64-bit forms of IPv6 addresses are null.
    """
    f = Frames(raw)
    ip = ip_start(f, linktype, probe, (4, 6) if ipv6 else (4,))
    version = np.where(ip >= 0, f.byte(ip) >> 4, 0)
    head = (f.byte(ip) & 15) * 4
    four = (version == 4) & (f.length >= ip + 20) & (head >= 20)
    six = (version == 6) & (f.length >= ip + 40) if ipv6 else np.zeros(len(ip), bool)
    proto, t = f.byte(ip + np.where(six, 6, 9)), ip + np.where(six, 40, head)
    if six.any():
        place, kind, ok = past_extensions(f, t, proto, six)
        t, proto, six = np.where(six, place, t), np.where(six, kind, proto), six & ok
    tcp, udp = proto == TCP, proto == UDP
    keep = (four | six) & ((tcp & (f.length >= t + 20)) | (udp & (f.length >= t + 8)))
    off = np.where(tcp, (f.byte(t + 12) >> 4) * 4, 8)
    keep &= f.length >= t + off
    flags = np.where(tcp, f.byte(t + 13), 0)

    at = np.flatnonzero(keep)
    g = Frames(raw.take(pa.array(at)))
    ip, t, off, four, tcp, flags = ip[at], t[at], off[at], four[at], tcp[at], flags[at]
    src, dst = ip + np.where(four, 12, 8), ip + np.where(four, 16, 24)
    out: dict[str, pa.Array] = {}
    for name, place in (("src", src), ("dst", dst)):
        number = g.number(place, 4)
        out[f"{name}_int"] = pa.array(number, pa.int64(), mask=~four)
        text = _texts(number)
        if ipv6:
            wide = np.stack([g.byte(place + i) for i in range(16)], 1).astype(np.uint8) if len(at) else np.zeros((0, 16), np.uint8)
            if four.any():
                mapped = np.zeros((int(four.sum()), 16), np.uint8)
                mapped[:, 10:12], mapped[:, 12:] = 0xFF, wide[four][:, :4]
                wide[four] = mapped
            addresses = [bytes(x) for x in wide]
            out[f"{name}_addr"] = pa.array(addresses, pa.binary())
            names = {a: str(ipaddress.IPv6Address(a)) for a in {a for a, v4 in zip(addresses, four, strict=True) if not v4}}
            text = pa.array([v if v4 else names[a] for v, a, v4 in zip(text.to_pylist(), addresses, four, strict=True)], pa.string())
        out[f"{name}_ip"] = text
    out["src_port"], out["dst_port"] = (pa.array(g.number(t + i, 2), pa.int32()) for i in (0, 2))
    out["protocol"] = pa.array(np.where(tcp, "tcp", "udp"), pa.string())
    out["len"] = pa.array(g.length, pa.int32())
    for name, bit in FLAGS.items():
        out[name] = pa.array(flags & bit > 0)
    # Arrow keeps a memoryview it has read for the life of the process, and with it the batch
    begin, data = g.begin + t + off, g.data.tobytes()
    out["payload"] = pa.array([data[a:e] for a, e in zip(begin.tolist(), (g.begin + g.length).tolist(), strict=True)], pa.binary())
    return keep, out


def _texts(numbers: np.ndarray) -> pa.Array:
    """Dotted form; each address is spelled once a batch."""
    distinct, index = np.unique(numbers, return_inverse=True)
    names = pa.array([f"{n >> 24 & 255}.{n >> 16 & 255}.{n >> 8 & 255}.{n & 255}" for n in distinct.tolist()], pa.string())
    return names.take(pa.array(index))
