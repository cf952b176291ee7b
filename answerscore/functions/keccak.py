"""Keccak-256 of bytes, the hash of module registries (padding byte 1, unlike SHA-3)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_RATE, _MASK = 136, (1 << 64) - 1


def _constants() -> tuple[list[int], list[list[int]]]:
    """Round constants by their shift register, rotation offsets by the walk over the lanes."""
    rounds, register = [], 1
    for _ in range(24):
        value = 0
        for j in range(7):
            if register & 1:
                value |= 1 << (1 << j) - 1
            register = register << 1 ^ (0x171 if register & 0x80 else 0)
        rounds.append(value)
    turns, x, y = [[0] * 5 for _ in range(5)], 1, 0
    for t in range(24):
        turns[x][y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return rounds, turns


_ROUNDS, _TURNS = _constants()


def _turned(value: int, bits: int) -> int:
    return (value << bits | value >> 64 - bits) & _MASK


def _permuted(a: list[list[int]]) -> list[list[int]]:
    for constant in _ROUNDS:
        parity = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
        spread = [parity[x - 1] ^ _turned(parity[(x + 1) % 5], 1) for x in range(5)]
        b = [[0] * 5 for _ in range(5)]
        for x in range(5):
            for y in range(5):
                b[y][(2 * x + 3 * y) % 5] = _turned(a[x][y] ^ spread[x], _TURNS[x][y])
        a = [[b[x][y] ^ (~b[(x + 1) % 5][y] & _MASK & b[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
        a[0][0] ^= constant
    return a


def keccak_hex(data: bytes) -> str:
    """``0x`` and 64 hex digits."""
    padded = bytearray(data) + bytearray(_RATE - len(data) % _RATE)
    padded[len(data)] |= 1
    padded[-1] |= 0x80
    a = [[0] * 5 for _ in range(5)]
    for at in range(0, len(padded), _RATE):
        for i in range(_RATE // 8):
            a[i % 5][i // 5] ^= int.from_bytes(padded[at + 8 * i : at + 8 * i + 8], "little")
        a = _permuted(a)
    return "0x" + b"".join(a[i][0].to_bytes(8, "little") for i in range(4)).hex()


def keccak256(data: Column) -> Column:
    """Keccak-256 of a binary column, null for null."""

    @F.pandas_udf("string")
    def hashed(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else keccak_hex(bytes(v)) for v in values], dtype=object)

    return hashed(data)
