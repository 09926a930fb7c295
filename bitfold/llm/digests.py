"""CRC-32 as SQL, for the texts that check queries; the engine they run on has no such function."""

from __future__ import annotations


def crc_rows() -> list[int]:
    """The byte table of the reflected CRC-32 polynomial, by its rule."""
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


def crc32_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text expression, as a BIGINT."""
    table = "[" + ", ".join(f"{v}::BIGINT" for v in crc_rows()) + "]"
    byte = f"('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT"
    steps = f"list_prepend(4294967295::BIGINT, [{byte} for i in range(octet_length(encode({text})))])"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, ({table})[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
