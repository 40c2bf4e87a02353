"""Ed25519 after RFC 8032, in whole numbers: enough to sign in tests and to verify where no library is at hand."""

from __future__ import annotations

import hashlib

# Fixed values of the curve.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
BASE_Y = 4 * pow(5, -1, P) % P
ROOT_OF_MINUS_ONE = pow(2, (P - 1) // 4, P)

Point = tuple[int, int, int, int]  # extended coordinates X, Y, Z, T with x = X/Z, y = Y/Z, x*y = T/Z
ZERO: Point = (0, 1, 1, 0)


def add(p: Point, q: Point) -> Point:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def times(n: int, p: Point) -> Point:
    out = ZERO
    for bit in bin(n)[2:]:
        out = add(out, out)
        if bit == "1":
            out = add(out, p)
    return out


def point(data: bytes) -> Point | None:
    """The point that 32 bytes denote, null if none."""
    if len(data) != 32:
        return None
    y, sign = int.from_bytes(data, "little") & (1 << 255) - 1, data[31] >> 7
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if x * x % P != square:
        x = x * ROOT_OF_MINUS_ONE % P
    if x * x % P != square or (x == 0 and sign):
        return None
    x = x if x & 1 == sign else P - x
    return x, y, 1, x * y % P


def encoded(p: Point) -> bytes:
    z = pow(p[2], -1, P)
    x, y = p[0] * z % P, p[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


BASE = point(BASE_Y.to_bytes(32, "little"))


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & (1 << 254) - 8 | 1 << 254, h[32:]


def public_key(seed: bytes) -> bytes:
    return encoded(times(_secret(seed)[0], BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    r = _number(prefix, message) % ORDER
    big_r, key = encoded(times(r, BASE)), public_key(seed)
    s = (r + _number(big_r, key, message) * a) % ORDER
    return big_r + s.to_bytes(32, "little")


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    a = point(key)
    if a is None or len(signature) != 64:
        return False
    s = int.from_bytes(signature[32:], "little")
    if s >= ORDER:
        return False
    h = _number(signature[:32], key, message) % ORDER
    minus_a = (P - a[0], a[1], a[2], P - a[3])
    return encoded(add(times(s, BASE), times(h, minus_a))) == signature[:32]
