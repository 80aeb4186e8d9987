"""An adaptive context-mixing range coder for token ids, many blocks side by side.

A segment holds whole documents. Its ids are numbered by how often they occur in it and
cut into blocks that start from a blank model, carry a checksum and decode on their own;
all blocks of a segment are coded in step, one numpy lane each.

An id is predicted by what last followed its two predecessors (order 2), by what last
followed its predecessor (order 1), and by how often ids occur in the segment (order 0,
a table in its head). How often predictions came true lately, and how often in a row
this one did, give the order-2 and order-1 ids their share of the range; the order-0
distribution gets what they leave. Everything is whole-number arithmetic (quotients of
numbers below 2^53 are exact as floats), so encoder and decoder agree.

A segment of more than ``_MOST`` different ids is coded as two streams of blocks, low
halves and high halves.

Segment layout, little-endian: magic, version, documents, ids, block size, streams (u32
each); per document its id (i64) and number of ids (u32, the top bit set where the
document has no id); per stream the sizes (u32 each) of its two zlib parts and these
parts: the gaps between its different ids, and their order-0 shares (u32 each); per
block of each stream its number of 16-bit words and the crc32 of its ids (u32 each);
then the blocks' words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, VERSION = 0x44495457, 3
_NO_ID = 1 << 31
#: Bits of a coding total and of a context table.
TOTAL_BITS, CONTEXT_BITS = 15, 9
TOTAL, _SLOTS = 1 << TOTAL_BITS, (1 << CONTEXT_BITS) - 1
#: Different ids in a stream at most.
_MOST = 1 << 20
#: Bounds of the rates, and what a hit counts as.
_LEAST_RATE, _TOP_RATE, _HIT = np.int32(1 << 10), np.int32(TOTAL - 1), np.int32(31_000)
_FULL = np.int64(1) << 48
_LOW32 = np.int64((1 << 32) - 1)


def block_size(ids: int) -> int:
    """Ids in a block: fewer in small segments, so that enough blocks run side by side."""
    return max(256, min(4096, ids // 4096))


class _Shares:
    """The order-0 distribution of a stream; ids are numbered from the most frequent one on."""

    def __init__(self, ids: np.ndarray, shares: np.ndarray):
        self.bits = int(shares.sum()).bit_length() - 1
        if len(ids) != len(shares) or shares.min() < 1 or int(shares.sum()) != 1 << self.bits:
            raise ValueError("not a table of shares")
        self.order = np.argsort(-shares, kind="stable")
        self.by_id, self.shares = ids, shares
        self.ids, self.share = ids[self.order], shares[self.order]
        self.start = np.cumsum(self.share) - self.share

    @classmethod
    def of(cls, stream: np.ndarray) -> tuple[_Shares, np.ndarray]:
        """The distribution of a stream and the numbers of its ids."""
        if int(stream.max()) < _MOST:
            counts = np.bincount(stream)
            ids = places = np.flatnonzero(counts)
            counts = counts[ids]
        else:
            ids, stream, counts = np.unique(stream, return_inverse=True, return_counts=True)
            places = np.arange(len(ids))
        bits = max(12, min(18, len(stream).bit_length()), len(ids).bit_length() + 1)
        shares = 1 + counts * ((1 << bits) - len(ids)) // len(stream)
        shares[np.argmax(shares)] += (1 << bits) - shares.sum()
        table = cls(ids, shares)
        number = np.zeros(int(places[-1]) + 1, np.int32)
        number[places[table.order]] = np.arange(len(ids), dtype=np.int32)
        return table, number.take(stream)

    def packed(self) -> bytes:
        parts = [zlib.compress(x.astype("<u4").tobytes()) for x in (np.diff(self.by_id, prepend=0), self.shares)]
        return struct.pack("<II", *map(len, parts)) + b"".join(parts)

    @classmethod
    def unpacked(cls, data: bytes, at: int) -> tuple[_Shares, int]:
        sizes = struct.unpack_from("<II", data, at)
        ends = np.cumsum([at + 8, *sizes]).tolist()
        gaps, shares = (np.frombuffer(zlib.decompress(data[a:b]), "<u4").astype(np.int64) for a, b in zip(ends, ends[1:]))
        return cls(np.cumsum(gaps), shares), ends[-1]


class _Model:
    """The order-2 and order-1 predictions of every lane; lanes keep their tables one after another."""

    def __init__(self, lanes: int):
        self.context = np.arange(lanes, dtype=np.int64) << CONTEXT_BITS
        # number * 16 + confidence; confidence 0 and the number -1: nothing yet
        self.two = np.full(lanes << CONTEXT_BITS, -16, np.int32)
        self.one = np.full(lanes << CONTEXT_BITS, -16, np.int32)
        self.rate_two = np.full(lanes, TOTAL // 2, np.int32)
        self.rate_one = np.full(lanes, TOTAL // 4, np.int32)
        self.last = np.zeros(lanes, np.int32)
        self.before = np.zeros(lanes, np.int32)  # a multiple of the number before the last

    def predict(self, n: int) -> None:
        """Look up the contexts of the first ``n`` lanes; sets numbers, confidences and shares."""
        last, context = self.last[:n], self.context[:n]
        self.at_one = context + (last & _SLOTS)
        self.at_two = context + ((last * 5 + self.before[:n]) & _SLOTS)
        two, one = self.two.take(self.at_two), self.one.take(self.at_one)
        self.x_two, self.x_one, self.c_two, self.c_one = two >> 4, one >> 4, two & 15, one & 15
        self.share_two = self.rate_two[:n] * self.c_two >> 4
        share = self.rate_one[:n] * self.c_one >> 4
        share *= self.x_one != self.x_two
        share *= TOTAL - self.share_two
        share >>= TOTAL_BITS
        self.share_one = share
        self.taken = self.share_two + share

    def learn(self, n: int, x: np.ndarray) -> None:
        """Adapt the first ``n`` lanes to their numbers."""
        hit_two, hit_one = self.x_two == x, self.x_one == x
        new = x << 4
        for table, at, hit, c in ((self.two, self.at_two, hit_two, self.c_two), (self.one, self.at_one, hit_one, self.c_one)):
            # Confidence grows with a hit, up to 15, and is 1 after a miss.
            c *= hit
            c += 1
            np.minimum(c, 15, out=c)
            c += new
            table[at] = c
        # No prediction, no share and no hit: the rate stays.
        for rate, hit, share in ((self.rate_two[:n], hit_two, self.share_two), (self.rate_one[:n], hit_one > hit_two, self.share_one)):
            rate += hit * _HIT - share >> 5
            np.maximum(rate, _LEAST_RATE, out=rate)
            np.minimum(rate, _TOP_RATE, out=rate)
        self.before[:n] = self.last[:n] * 37
        self.last[:n] = x


def encode_blocks(numbers: np.ndarray, shares: _Shares, size: int) -> list[bytes]:
    """The coded words of each block of ``numbers`` (16-bit numbers)."""
    lanes = -(-len(numbers) // size)
    last = len(numbers) - size * (lanes - 1)
    grid = np.zeros((lanes, size), np.int32)
    grid.ravel()[: len(numbers)] = numbers
    columns = np.ascontiguousarray(grid.T)
    model = _Model(lanes)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, _FULL - 1, np.int64)
    width = 3 * size + 8
    out = np.zeros(lanes * width, np.uint16)
    at = np.arange(lanes, dtype=np.int64) * width
    for t in range(size):
        n = lanes if t < last else lanes - 1
        if not n:
            break
        x = columns[t, :n]
        model.predict(n)
        unit = span[:n] >> TOTAL_BITS
        # The order-0 way for all lanes, then the lanes with a hit.
        start = unit * model.taken
        each = unit * (TOTAL - model.taken) >> shares.bits
        start += each * shares.start.take(x)
        each *= shares.share.take(x)
        hit_two = model.x_two == x
        hits = np.flatnonzero(hit_two | (model.x_one == x))
        if len(hits):
            second, share_two = ~hit_two.take(hits), model.share_two.take(hits)
            wide = unit.take(hits)
            start[hits] = wide * (share_two * second)
            each[hits] = wide * np.where(second, model.share_one.take(hits), share_two)
        low[:n] += start
        span[:n] = each
        model.learn(n, x)
        # Carry into words that are out, and move the top word of each narrow range out.
        over = np.flatnonzero(low >= _FULL)
        if len(over):
            low[over] -= _FULL
            place = at[over] - 1
            while len(place):
                out[place] += 1  # wraps from 65,535 to 0
                place = place[out[place] == 0] - 1
        short = np.flatnonzero(span < (1 << 32))
        while len(short):
            value, place, wide = low.take(short), at.take(short), span.take(short) << 16
            out[place] = value >> 32
            at[short] = place + 1
            low[short] = (value & _LOW32) << 16
            span[short] = wide
            short = short[wide < (1 << 32)]
    for shift in (32, 16, 0):
        out[at] = (low >> shift) & 0xFFFF
        at += 1
    return [out[k * width : at[k]].astype("<u2").tobytes() for k in range(lanes)]


def decode_blocks(words: list[bytes], shares: _Shares, n_ids: int, size: int) -> np.ndarray:
    """The inverse of ``encode_blocks`` for ``n_ids`` numbers in all."""
    lanes = len(words)
    last = n_ids - size * (lanes - 1)
    lengths = np.array([len(w) // 2 for w in words], np.int64)
    read = np.concatenate([np.frombuffer(b"".join(words), "<u2"), np.zeros(4, np.uint16)])
    at = np.cumsum(lengths) - lengths
    model = _Model(lanes)
    ahead = (read[at].astype(np.int64) << 32) | (read[at + 1].astype(np.int64) << 16) | read[at + 2]
    span = np.full(lanes, _FULL - 1, np.int64)
    at += 3
    columns = np.zeros((size, lanes), np.int32)
    numbers = np.repeat(np.arange(len(shares.ids), dtype=np.int32), shares.share)
    for t in range(size):
        n = lanes if t < last else lanes - 1
        if not n:
            break
        model.predict(n)
        unit = span[:n] >> TOTAL_BITS
        # The order-0 way for all lanes, then the lanes with a hit.
        known = unit * model.taken
        each = unit * (TOTAL - model.taken) >> shares.bits
        rest = ahead[:n] - known
        x = numbers.take((rest / each).astype(np.int64), mode="clip")
        rest -= each * shares.start.take(x)
        each *= shares.share.take(x)
        hits = np.flatnonzero(ahead[:n] < known)
        if len(hits):
            wide, share_two, value = unit.take(hits), model.share_two.take(hits), ahead.take(hits)
            edge = wide * share_two
            second = value >= edge
            x[hits] = np.where(second, model.x_one.take(hits), model.x_two.take(hits))
            rest[hits] = value - edge * second
            each[hits] = wide * np.where(second, model.share_one.take(hits), share_two)
        columns[t, :n] = x
        ahead[:n] = rest
        span[:n] = each
        model.learn(n, x)
        short = np.flatnonzero(span < (1 << 32))
        while len(short):
            place, wide = at.take(short), span.take(short) << 16
            ahead[short] = (ahead.take(short) << 16) | read.take(place, mode="clip")
            at[short] = place + 1
            span[short] = wide
            short = short[wide < (1 << 32)]
    return np.ascontiguousarray(columns.T).ravel()[:n_ids]


def write_segment(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """A segment of (document id or None, 32-bit ids)."""
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.int64)
    size = block_size(len(ids))
    streams = [ids] if len(ids) else []
    tables = [_Shares.of(s) for s in streams]
    if tables and len(tables[0][0].ids) > _MOST:
        streams = [ids & 0xFFFF, ids >> 16]
        tables = [_Shares.of(s) for s in streams]
    head = [struct.pack("<IIIIII", MAGIC, VERSION, len(docs), len(ids), size, len(streams))]
    head += [struct.pack("<qI", doc or 0, len(x) | (_NO_ID if doc is None else 0)) for doc, x in docs]
    head += [shares.packed() for shares, _ in tables]
    words = []
    for stream, (shares, numbers) in zip(streams, tables, strict=True):
        raw = stream.astype("<u4")
        for k, block in enumerate(encode_blocks(numbers, shares, size)):
            head.append(struct.pack("<II", len(block) // 2, zlib.crc32(raw[k * size : (k + 1) * size])))
            words.append(block)
    return b"".join(head + words)


def read_segment(data: bytes) -> list[tuple[int | None, np.ndarray]]:
    """The documents of a segment; a wrong magic, version or checksum is an error."""
    magic, version, n_docs, n_ids, size, n_streams = struct.unpack_from("<IIIIII", data, 0)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a segment of this format")
    at, each = 24, -(-n_ids // size)
    directory = np.frombuffer(data, np.dtype([("doc", "<i8"), ("n", "<u4")]), n_docs, at)
    at += directory.nbytes
    tables = []
    for _ in range(n_streams):
        shares, at = _Shares.unpacked(data, at)
        tables.append(shares)
    blocks = np.frombuffer(data, np.dtype([("words", "<u4"), ("crc", "<u4")]), each * n_streams, at)
    at += blocks.nbytes
    ids = np.zeros(n_ids, np.int64)
    for s, shares in enumerate(tables):
        words = []
        for n in blocks["words"][s * each : (s + 1) * each].tolist():
            words.append(data[at : at + 2 * n])
            at += 2 * n
        stream = shares.ids.take(decode_blocks(words, shares, n_ids, size))
        raw = stream.astype("<u4")
        for k, crc in enumerate(blocks["crc"][s * each : (s + 1) * each].tolist()):
            if zlib.crc32(raw[k * size : (k + 1) * size]) != crc:
                raise ValueError(f"checksum of block {k} does not match")
        ids |= stream << (16 * s)
    sizes = (directory["n"] & (_NO_ID - 1)).astype(np.int64)
    names = [None if n & _NO_ID else doc for doc, n in zip(directory["doc"].tolist(), directory["n"].tolist(), strict=True)]
    ends = np.cumsum(sizes)
    return [(doc, ids[e - n : e]) for doc, n, e in zip(names, sizes.tolist(), ends.tolist(), strict=True)]
