"""Sorted-string-table shards of token ids: sorted keys, prefix-compressed blocks, sparse index, Bloom filter.

File layout (little-endian): data blocks, block index, Bloom filter, 64-byte footer.

* block: zstd of [entries][restart offsets u32...][restart count u32]. An entry is varint(shared key bytes),
  varint(own key bytes), varint(value bytes), own key bytes, value. Every 16th entry shares nothing.
* index: per block its first key (u16 length, bytes), offset u64, length u32, entries u32, ids before it u64.
* Bloom filter: u32 hashes, then the bits; 10 bits a key, 7 probes by double hashing.
* footer: index offset and length, filter offset and length, entries, ids (u64 each), 8 spare, magic.

A key is 0x00 for a null id, else 0x01 and the id as big-endian with the sign bit turned, so bytes sort as ids
do, null first. Equal ids may repeat, and stand in the order in which they were added. A value is the ids as u32.
"""

from __future__ import annotations

import array
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import zstandard

MAGIC = b"TMSST\x00\x01\n"
FOOTER = struct.Struct("<6Q8x8s")
RESTART = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf, at: int) -> tuple[int, int]:
    shift = n = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _hash_pair(key: bytes) -> tuple[int, int]:
    return struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())


def _probes(key: bytes, bits: int, hashes: int) -> Iterator[int]:
    a, b = _hash_pair(key)
    return (((a + i * b) & (1 << 64) - 1) % bits for i in range(hashes))


class Writer:
    """Keys must arrive in ascending order. Holds one block, the index and 16 bytes a key (its hashes for the filter)."""

    def __init__(self, sink, block_bytes: int = 1 << 18):
        self.sink, self.block_bytes = sink, block_bytes
        self.at = self.docs = self.ids = self.before = 0
        self.zip = zstandard.ZstdCompressor(level=1)
        self.index: list[bytes] = []
        self.hashes = array.array("Q")
        self.first = self.last = None
        self._clear()

    def _clear(self) -> None:
        self.parts, self.size, self.n, self.restarts, self.block_first, self.prev = [], 0, 0, [], b"", b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.last is not None and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.n % RESTART == 0:
            self.restarts.append(self.size)
        else:
            top = min(len(key), len(self.prev))
            while shared < top and key[shared] == self.prev[shared]:
                shared += 1
        head = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.parts += (head, value)
        self.size += len(head) + len(value)
        if not self.n:
            self.block_first = key
        self.n, self.prev, self.last = self.n + 1, key, key
        self.first = key if self.first is None else self.first
        self.hashes.extend(_hash_pair(key))
        self.docs, self.ids = self.docs + 1, self.ids + len(value) // 4
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.n:
            return
        tail = struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        data = self.zip.compress(b"".join(self.parts) + tail)
        self.sink.write(data)
        self.index.append(struct.pack("<H", len(self.block_first)) + self.block_first + struct.pack("<QIIQ", self.at, len(data), self.n, self.before))
        self.at, self.before = self.at + len(data), self.ids
        self._clear()

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bloom = np.zeros((max(64, BLOOM_BITS * self.docs) + 7) // 8, np.uint8)
        pairs = np.frombuffer(self.hashes, np.uint64).reshape(-1, 2)
        for i in range(BLOOM_HASHES):
            at = (pairs[:, 0] + np.uint64(i) * pairs[:, 1]) % np.uint64(len(bloom) * 8)
            np.bitwise_or.at(bloom, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        self.sink.write(index)
        self.sink.write(struct.pack("<I", BLOOM_HASHES) + bloom.tobytes())
        self.sink.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom) + 4, self.docs, self.ids, MAGIC))


class Reader:
    """Over a seekable file: reads footer, index and filter; blocks on demand."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - FOOTER.size)
        index_at, index_len, bloom_at, bloom_len, self.docs, self.ids, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self._bloom_at, self._bloom_len, self._bloom = bloom_at, bloom_len, None
        source.seek(index_at)
        raw, at, self.blocks = source.read(index_len), 0, []
        while at < len(raw):
            (n,) = struct.unpack_from("<H", raw, at)
            key, at = raw[at + 2 : at + 2 + n], at + 2 + n
            self.blocks.append((key, *struct.unpack_from("<QIIQ", raw, at)))
            at += 24

    def _load(self, i: int) -> tuple[bytes, list[int], int]:
        """(data, restart offsets, end of the entries) of a block."""
        _, offset, length, _, _ = self.blocks[i]
        self.source.seek(offset)
        data = zstandard.ZstdDecompressor().decompress(self.source.read(length))
        (n,) = struct.unpack_from("<I", data, len(data) - 4)
        end = len(data) - 4 * (n + 1)
        return data, list(struct.unpack_from(f"<{n}I", data, end)), end

    def _entries(self, data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + n]
            at += n

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        data, _, end = self._load(i)
        return self._entries(data, 0, end)

    def find(self, i: int, key: bytes) -> list[bytes]:
        """Values of a key in a block: binary search of the restarts, then the entries from there."""
        data, restarts, end = self._load(i)
        low, high = 0, len(restarts)
        while low < high:  # first restart at or after the key
            mid = (low + high) // 2
            low, high = (mid + 1, high) if next(self._entries(data, restarts[mid], end))[0] < key else (low, mid)
        out = []
        for k, v in self._entries(data, restarts[max(0, low - 1)], end):
            if k > key:
                break
            if k == key:
                out.append(v)
        return out

    def may_hold(self, key: bytes) -> bool:
        if self._bloom is None:
            self.source.seek(self._bloom_at)
            self._bloom = self.source.read(self._bloom_len)
        bits = self._bloom[4:]
        return all(bits[p >> 3] >> (p & 7) & 1 for p in _probes(key, len(bits) * 8, struct.unpack_from("<I", self._bloom)[0]))

    def get(self, doc_id: int | None) -> list[bytes]:
        """Values of an id: filter, then binary search of the sparse index, then the blocks it can be in."""
        key = key_of(doc_id)
        if not self.blocks or not self.may_hold(key):
            return []
        low, high = 0, len(self.blocks)
        while low < high:  # first block that begins at or after the key
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.blocks[mid][0] < key else (low, mid)
        out = []
        for i in range(max(0, low - 1), len(self.blocks)):
            if self.blocks[i][0] > key:
                break
            out += self.find(i, key)
        return out


#: Where cutting before a space would not agree with the vocabulary's own splitting of white space.
IRREGULAR = re.compile(r"\s (?!\S)|[\x1c-\x1f]")
#: Memoised pieces a worker keeps; beyond that it starts anew.
MEMO = 1_000_000


def byte_alphabet() -> dict[int, int]:
    """Byte to the character that stands for it in byte-level vocabularies: itself if printable."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class Encoder:
    """Whole-text encoding with the tokenizers library, remembering what it has said of a piece.

    Merges never cross the vocabulary's pre-split, and that never joins what a single space separates, so
    a text is cut at spaces, a new piece is pre-split, and the model encodes each part once. Texts whose
    white space is irregular, and those that hold a special token's own spelling, go through the library whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        split, tokenize, table = regex.compile(public_tokenizers.PATTERN).findall, tok.model.tokenize, byte_alphabet()

        class Parts(dict):
            def __missing__(self, part: str) -> bytes:
                ids = array.array("I", [t.id for t in tokenize(part.encode().decode("latin-1").translate(table))]).tobytes()
                if len(self) >= MEMO:
                    self.clear()
                self[part] = ids
                return ids

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = b"".join(map(parts.__getitem__, split(" " + piece)))
                if len(self) >= MEMO:
                    self.clear()
                self[piece] = ids
                return ids

        special = [re.escape(t.content) for t in tok.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([IRREGULAR.pattern, *special])).search
        self.tok, self.split = tok, split
        self.parts = parts = Parts()
        self.pieces = Pieces()

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian u32."""
        if self.whole(text):
            return array.array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()
        head, *rest = text.split(" ")
        return b"".join(map(self.parts.__getitem__, self.split(head))) + b"".join(map(self.pieces.__getitem__, rest))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
