"""SHA-256 that stops and goes on elsewhere: its state is bytes, so tasks can hash a file piece after piece, one where another ended."""

from __future__ import annotations

import ctypes
import ctypes.util
import struct
from functools import cache

_M = 0xFFFFFFFF
_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, p))]


def _root(p: int, k: int) -> int:
    """The first 32 bits behind the point of the k-th root of p."""
    n = p << 32 * k
    lo, hi = 0, 1 << 40
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if mid**k <= n else (lo, mid)
    return lo & _M


_K, _START = [_root(p, 3) for p in _PRIMES], [_root(p, 2) for p in _PRIMES[:8]]


class _Context(ctypes.Structure):
    """SHA256_CTX of openssl/sha.h."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("low", ctypes.c_uint32), ("high", ctypes.c_uint32), ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("md_len", ctypes.c_uint)]


@cache
def _library() -> ctypes.CDLL | None:
    """The libcrypto that hashlib itself uses, or else the system's."""
    try:
        import _hashlib

        names = [_hashlib.__file__, ctypes.util.find_library("crypto")]
    except ImportError:
        names = [ctypes.util.find_library("crypto")]
    for name in filter(None, names):
        try:
            lib = ctypes.CDLL(name)
            lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
            return lib
        except (OSError, AttributeError):
            continue
    return None


def _plain(h: list[int], blocks: bytes) -> list[int]:
    """``h`` after whole blocks of 64 bytes, without a library."""
    turn = lambda x, n: (x >> n | x << 32 - n) & _M
    for at in range(0, len(blocks), 64):
        w = list(struct.unpack_from(">16I", blocks, at))
        for i in range(16, 64):
            x, y = w[i - 15], w[i - 2]
            w.append((w[i - 16] + (turn(x, 7) ^ turn(x, 18) ^ x >> 3) + w[i - 7] + (turn(y, 17) ^ turn(y, 19) ^ y >> 10)) & _M)
        a, b, c, d, e, f, g, z = h
        for k, x in zip(_K, w, strict=True):
            t = z + (turn(e, 6) ^ turn(e, 11) ^ turn(e, 25)) + (e & f ^ ~e & g) + k + x
            u = (turn(a, 2) ^ turn(a, 13) ^ turn(a, 22)) + (a & b ^ a & c ^ b & c)
            a, b, c, d, e, f, g, z = (t + u) & _M, a, b, c, (d + t) & _M, e, f, g
        h = [(x + y) & _M for x, y in zip(h, (a, b, c, d, e, f, g, z), strict=True)]
    return h


class Sha256:
    """``Sha256(state)`` goes on where the one with that ``state`` ended."""

    def __init__(self, state: bytes | None = None):
        self.n, *self.h = struct.unpack_from(">Q8I", state) if state else (0, *_START)
        self.tail = state[40:] if state else b""

    def update(self, data: bytes) -> None:
        self.n += len(data)
        need = -len(self.tail) % 64
        head, rest = self.tail + data[:need], len(data) - (len(data) - need) % 64
        if len(head) % 64:
            self.tail = head
            return
        self._blocks(head)
        self._blocks(data[need:rest])
        self.tail = data[rest:]

    def _blocks(self, blocks: bytes) -> None:
        lib = _library()
        if not blocks:
            return
        if lib is None:
            self.h = _plain(self.h, blocks)
            return
        c = _Context(h=(ctypes.c_uint32 * 8)(*self.h), md_len=32)
        lib.SHA256_Update(ctypes.byref(c), blocks, len(blocks))
        self.h = list(c.h)

    def state(self) -> bytes:
        return struct.pack(">Q8I", self.n, *self.h) + self.tail

    def hexdigest(self) -> str:
        last = Sha256(self.state())
        last._blocks(self.tail + b"\x80" + b"\0" * (-(len(self.tail) + 9) % 64) + struct.pack(">Q", 8 * self.n & 0xFFFFFFFFFFFFFFFF))
        return struct.pack(">8I", *last.h).hex()
