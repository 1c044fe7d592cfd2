"""The standard security handler, revisions 2 to 4: RC4 of 40 and 128 bits, AES of 128 bits."""

from __future__ import annotations

import hashlib
import os

import numpy as np

PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")
#: Permission names and their bits.
PERMISSIONS = {"print": 0x4, "modify": 0x8, "copy": 0x10, "annotate": 0x20, "forms": 0x100, "reading": 0x200, "assemble": 0x400, "print_high": 0x800}


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _double(x: int) -> int:
    return ((x << 1) ^ 0x11B) & 255 if x & 128 else x << 1


def _tables() -> tuple[bytes, bytes]:
    """AES's substitution and its inverse: the inverse in GF(256), then the affine map."""
    power, log, x = [0] * 255, [0] * 256, 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= _double(x)
    box = bytearray(256)
    for v in range(256):
        inv = power[-log[v] % 255] if v else 0
        box[v] = inv ^ 0x63
        for k in range(1, 5):
            box[v] ^= ((inv << k) | (inv >> (8 - k))) & 255
    back = bytearray(256)
    for v, s in enumerate(box):
        back[s] = v
    return bytes(box), bytes(back)


_BOX, _BACK = _tables()
_SHIFT = [(i + 4 * (i % 4)) % 16 for i in range(16)]
_UNSHIFT = [(i - 4 * (i % 4)) % 16 for i in range(16)]


def _mul(n: int) -> bytes:
    def times(v: int) -> int:
        out, m = 0, n
        while m:
            if m & 1:
                out ^= v
            v, m = _double(v), m >> 1
        return out

    return bytes(map(times, range(256)))


_BY = {n: _mul(n) for n in (2, 3, 9, 11, 13, 14)}


def _schedule(key: bytes) -> list[bytes]:
    words, r = [key[i : i + 4] for i in range(0, 16, 4)], 1
    for i in range(4, 44):
        w = words[-1]
        if i % 4 == 0:
            w = bytes([_BOX[w[1]] ^ r, _BOX[w[2]], _BOX[w[3]], _BOX[w[0]]])
            r = _double(r)
        words.append(bytes(a ^ b for a, b in zip(w, words[i - 4], strict=True)))
    return [b"".join(words[i : i + 4]) for i in range(0, 44, 4)]


def _xor(a: bytes, b: bytes) -> bytes:
    return (int.from_bytes(a) ^ int.from_bytes(b)).to_bytes(16)


def _columns(s: bytes, c: tuple[int, int, int, int]) -> bytes:
    t = [_BY[n] if n > 1 else range(256) for n in c]
    return bytes(t[0][s[o + i]] ^ t[1][s[o + (i + 1) % 4]] ^ t[2][s[o + (i + 2) % 4]] ^ t[3][s[o + (i + 3) % 4]] for o in (0, 4, 8, 12) for i in range(4))


def _encrypt_block(keys: list[bytes], s: bytes) -> bytes:
    s = _xor(s, keys[0])
    for k in keys[1:-1]:
        s = _xor(_columns(bytes(_BOX[s[i]] for i in _SHIFT), (2, 3, 1, 1)), k)
    return _xor(bytes(_BOX[s[i]] for i in _SHIFT), keys[-1])


def aes_encrypt(key: bytes, data: bytes, iv: bytes | None = None) -> bytes:
    """CBC with the vector first and padding last."""
    keys, last = _schedule(key), iv or os.urandom(16)
    n = 16 - len(data) % 16
    data, out = data + bytes([n]) * n, [last]
    for i in range(0, len(data), 16):
        last = _encrypt_block(keys, _xor(data[i : i + 16], last))
        out.append(last)
    return b"".join(out)


def aes_decrypt(key: bytes, data: bytes) -> bytes:
    """CBC decrypts its blocks independently of each other, so all of them go through each round at once."""
    if len(data) < 32 or len(data) % 16:
        return b""
    keys = [np.frombuffer(k, np.uint8) for k in _schedule(key)]
    back, unshift = np.frombuffer(bytes(_BACK), np.uint8), np.array(_UNSHIFT)
    by = [np.frombuffer(_BY[n], np.uint8) for n in (14, 11, 13, 9)]
    blocks = np.frombuffer(data, np.uint8).reshape(-1, 16)
    s = blocks[1:] ^ keys[-1]
    for k in keys[-2:0:-1]:
        c = (back[s[:, unshift]] ^ k).reshape(-1, 4, 4)
        s = (by[0][c] ^ by[1][np.roll(c, -1, 2)] ^ by[2][np.roll(c, -2, 2)] ^ by[3][np.roll(c, -3, 2)]).reshape(-1, 16)
    out = ((back[s[:, unshift]] ^ keys[0]) ^ blocks[:-1]).tobytes()
    return out[: -out[-1]] if 1 <= out[-1] <= 16 else out


def _padded(password: bytes) -> bytes:
    return (password + PAD)[:32]


def owner_entry(owner: bytes, user: bytes, revision: int, size: int) -> bytes:
    key = hashlib.md5(_padded(owner or user)).digest()
    if revision >= 3:
        for _ in range(50):
            key = hashlib.md5(key[:size]).digest()
    out = _padded(user)
    for i in range(20 if revision >= 3 else 1):
        out = rc4(bytes(b ^ i for b in key[:size]), out)
    return out


def file_key(user: bytes, o: bytes, p: int, file_id: bytes, revision: int, size: int, meta: bool = True) -> bytes:
    key = hashlib.md5(_padded(user) + o + (p & 0xFFFFFFFF).to_bytes(4, "little") + file_id + (b"" if meta or revision < 4 else b"\xff" * 4)).digest()
    if revision >= 3:
        for _ in range(50):
            key = hashlib.md5(key[:size]).digest()
    return key[:size]


def user_entry(key: bytes, file_id: bytes, revision: int) -> bytes:
    if revision < 3:
        return rc4(key, PAD)
    out = hashlib.md5(PAD + file_id).digest()
    for i in range(20):
        out = rc4(bytes(b ^ i for b in key), out)
    return out + bytes(16)


def user_from_owner(owner: bytes, o: bytes, revision: int, size: int) -> bytes:
    """The padded user password that an owner password unlocks."""
    key = hashlib.md5(_padded(owner)).digest()
    if revision >= 3:
        for _ in range(50):
            key = hashlib.md5(key[:size]).digest()
    for i in range(19 if revision >= 3 else 0, -1, -1):
        o = rc4(bytes(b ^ i for b in key[:size]), o)
    return o


def object_key(key: bytes, number: int, generation: int, aes: bool) -> bytes:
    return hashlib.md5(key + number.to_bytes(3, "little") + generation.to_bytes(2, "little") + (b"sAlT" if aes else b"")).digest()[: min(16, len(key) + 5)]


class Cipher:
    def __init__(self, key: bytes, method: str):
        self.key, self.method = key, method

    def decrypt(self, number: int, generation: int, data: bytes) -> bytes:
        k = object_key(self.key, number, generation, self.method == "aes-128")
        return aes_decrypt(k, data) if self.method == "aes-128" else rc4(k, data)

    def encrypt(self, number: int, data: bytes, iv: bytes | None = None) -> bytes:
        k = object_key(self.key, number, 0, self.method == "aes-128")
        return aes_encrypt(k, data, iv) if self.method == "aes-128" else rc4(k, data)
