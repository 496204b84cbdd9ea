"""Pieces of SQL that several queries' statements share."""


def crc32(text: str) -> str:
    """The unsigned crc32 of an ASCII text, bit by bit."""
    bits = "list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda d, k: xor(d >> 1, (d & 1) * 3988292384), xor(c, b::BIGINT))"
    return f"xor(list_reduce([ascii(x) FOR x IN string_split({text}, '')], lambda c, b: {bits}, 4294967295::BIGINT), 4294967295::BIGINT)"
