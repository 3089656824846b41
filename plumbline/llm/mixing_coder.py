"""Adaptive context-mixing range coder for token ids.

A block holds up to ``BLOCK`` ids and is coded on its own: it starts from an empty model and carries a checksum. Ids
are numbered within the block by a table in its header. Three models predict the next number: order 2 remembers what
followed the last two (hashed), order 1 what followed the last one, each with a confidence; order 0 counts what came so far.
The chances that a prediction of a given confidence holds are learned after every id, and mix the three into one
distribution: order 2's guess gets its chance, order 1's guess its chance of the rest, order 0 what then is left, in
proportion to its counts, whose shares are renewed whenever the block has grown by an eighth. The distribution drives a range
coder with 64-bit state and 32-bit output; words keep room for what is carried into them until the block is complete.

Blocks are independent, so many are coded side by side: every array has one lane per block, and one step codes one
id of each. A decoder repeats the encoder's model exactly, in integers (a quotient of two integers below 2^29 is taken in double
precision, which rounds none up to the next integer). The encoder knows the ids, so only what is remembered goes step by step;
order 0 and the intervals are taken for a chunk of steps at once.

Block layout, little-endian: magic "CMB2", number of ids, of distinct ids, of table bytes, of payload words, crc32 of
the ids, crc32 of table and payload (all 32 bits); the table as variable-length differences of the sorted ids; payload.
An empty list of ids gives no block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK, LANES = 4096, 2048
HEADER = "<4s6I"
HEADER_BYTES = struct.calcsize(HEADER)
MAGIC = b"CMB2"
#: The three models share 2^MIX parts, order 0 deals its parts out in 2^INNER; both together are the coder's unit.
MIX, INNER = 13, 15
WHOLE = 1 << INNER
MIXED, LEFT = np.int32(MIX), np.int32(INNER)
UNIT = np.uint64(MIX + INNER)
#: Intervals below LEAST are widened by one word, so every step begins with at least 16 of the coder's units.
LEAST, WORD = np.uint64(1 << 32), np.uint64(32)
#: Order 0: weight of one occurrence; its cumulative shares are rebuilt after CHUNK steps or 1/2^GROWTH of all, whichever is more.
GAIN, CHUNK, GROWTH = np.int32(32), 32, 3
CONTEXTS = 1 << 11
#: A guess is remembered as symbol and confidence (1 to SURE, 0: not made yet) in 16 bits.
SHIFT, SURE = np.uint16(3), np.uint16(7)
ONE, SIX = np.uint16(1), np.uint16(6)
#: The symbol of a guess not made yet, which no block has.
NOTHING = (1 << 13) - 1
HASH = np.uint16(40503), np.uint16(2749), np.uint16(CONTEXTS - 1)
#: Symbols between two entries of the first level in which a decoder looks for a share: the bytes of two 64-bit words.
STRIDE = 16
#: Chances in 1/2^MIX move towards LIKELY + UNLIKELY after a hit and towards UNLIKELY after a miss.
LIKELY, UNLIKELY, RATE = np.int32(7750), np.int32(20), np.int32(4)
#: Chances that a guess of each confidence holds, before anything is learned.
FIRST = np.append(UNLIKELY, np.linspace(750, 6250, SURE)).astype(np.int32)


class Model:
    """Predictions of all lanes, in flat arrays. The first ``used`` lanes are active; distinct ids differ by lane.

    Arrays of two rows hold order 2's guesses first, then order 1's.
    """

    def __init__(self, distinct: np.ndarray) -> None:
        # Room for every lane's symbols and the mark of a beginning, in whole strides.
        lanes, width = len(distinct), (int(distinct.max()) // STRIDE + 1) * STRIDE
        assert distinct.max() <= BLOCK < NOTHING and width * 2 <= WHOLE
        # Both guesses and order 0 keep a part of one or more, whatever was learned.
        rest = (1 << MIX) - LIKELY - UNLIKELY
        assert rest * UNLIKELY >> MIX > 0 and rest - (rest * (LIKELY + UNLIKELY) >> MIX) > 0
        self.distinct = distinct.astype(np.int32)
        self.counts = (np.arange(width - 1) < distinct[:, None]).astype(np.int32)
        self.upto = np.zeros((lanes, width), dtype=np.int32)
        # Every symbol has a share of one at least: the floor below it is its number.
        self.floor = np.arange(width, dtype=np.int32)
        self.shares = np.zeros((lanes, width), dtype=np.uint16)
        self.flat_shares = self.shares.ravel()
        self.strides = self.shares.reshape(-1, STRIDE)
        self.guess = np.full(lanes * (CONTEXTS + width), NOTHING << SHIFT, dtype=np.uint16)
        self.chance = np.tile(FIRST, 2 * lanes)
        rows = np.arange(lanes)
        self.row_counts, self.row_shares, self.row_strides = rows * (width - 1), rows * width, rows * (width // STRIDE)
        self.row_a, self.row_b = rows * CONTEXTS, lanes * CONTEXTS + rows * width
        self.row_chance = np.arange(0, len(self.chance), len(FIRST)).reshape(2, lanes)
        # Chunks of symbols not counted yet, one row a step; lanes that have ended no longer matter.
        self.met: list[np.ndarray] = []
        self.next = 0

    def rebuild(self, step: int, used: int) -> bool:
        """Order 0's cumulative shares from the counts, if these have grown by an eighth or so since the last time."""
        if step < self.next:
            return False
        self.next = step + max(CHUNK, step >> GROWTH)
        for at in range(0, used, 64):
            part = slice(at, min(at + 64, used))
            upto, counts, distinct = self.upto[part], self.counts[part], self.distinct[part, None]
            if self.met:
                own = np.concatenate([symbols[:, part] for symbols in self.met]) + self.row_counts[: len(counts)]
                found = np.bincount(own.ravel(), minlength=counts.size).reshape(counts.shape)
                counts += found.astype(np.int32) * GAIN
            np.cumsum(counts, axis=1, out=upto[:, 1:])
            # At most 2^(2 * INNER), so 32 bits suffice.
            scaled = upto * (((WHOLE - distinct) << INNER) // upto[:, -1:])
            scaled >>= INNER
            scaled += np.minimum(self.floor, distinct)
            self.shares[part] = scaled
        self.met = []
        return True

    def slots(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Where the guesses after the last two symbols and after the last one are remembered, of one step or many."""
        used = last.shape[-1]
        found = np.empty((*last.shape[:-1], 2, used), dtype=np.int64)
        hashed = (before * HASH[0] + last * HASH[1]) & HASH[2]
        np.add(self.row_a[:used], hashed, out=found[..., 0, :])
        np.add(self.row_b[:used], last, out=found[..., 1, :])
        return found

    def predict(self, slots: np.ndarray) -> None:
        """The guesses of the next step and the chances that they hold."""
        self.at = slots
        self.known = self.guess.take(slots)
        self.sure = self.known & SURE
        self.found = self.known >> SHIFT
        self.bins = self.row_chance[:, : slots.shape[1]] + self.sure
        self.chances = self.chance.take(self.bins)
        self.differ = self.found[0] != self.found[1]

    def update(self, symbol: np.ndarray, same: np.ndarray) -> None:
        """Learns from a step; ``same`` says which guesses held."""
        moved = same * LIKELY
        moved -= self.chances
        moved += UNLIKELY
        moved >>= RATE
        # Order 1 is asked only where order 2 fails and it guesses otherwise.
        moved[1] *= self.differ > same[0]
        moved += self.chances
        self.chance[self.bins] = moved
        # A guess that held gains confidence, one that failed falls back to the least, or is replaced if it had no more.
        new = symbol << SHIFT
        kept = self.known - self.sure
        kept -= new
        kept *= self.sure > ONE
        kept += new + ONE
        gained = np.minimum(self.sure, SIX)
        gained *= same
        kept += gained
        self.guess[self.at] = kept


def _parts(chances: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of 2^MIX that order 2, order 1 and order 0 get, of one step or many."""
    order2 = chances[..., 0, :]
    rest = np.int32(1 << MIX) - order2
    order1 = rest * chances[..., 1, :]
    order1 >>= MIXED
    order1 *= differ
    return order2, order1, rest - order1


def _intervals(parts: tuple, hit2: np.ndarray, hit1: np.ndarray, low: np.ndarray, share: np.ndarray) -> tuple:
    """Start and size, in the coder's units, of a guess that holds, or else of an order 0 share above ``low``."""
    order2, order1, order0 = parts
    start = np.where(hit2, 0, np.where(hit1, order2 << LEFT, (order2 + order1 << LEFT) + low * order0))
    size = np.where(hit2, order2 << LEFT, np.where(hit1, order1 << LEFT, share * order0))
    return start.astype(np.uint64), size.astype(np.uint64)


def _first_level(model: Model, used: int) -> np.ndarray:
    return np.ascontiguousarray(model.shares[:used, STRIDE::STRIDE].T)


def _find(model: Model, coarse: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The symbols whose shares of order 0 hold the counts."""
    used = len(count)
    kind = np.uint8 if len(coarse) < 256 else np.uint16
    stride = np.add.reduce((coarse[:, :used] <= count).view(np.uint8), axis=0, dtype=kind)
    fine = model.strides.take(model.row_strides[:used] + stride, axis=0) <= count[:, None]
    bits = np.bitwise_count(fine.view(np.uint64))
    symbol = stride * np.uint16(STRIDE)
    symbol += bits[:, 0]
    symbol += bits[:, 1]
    symbol -= ONE
    return symbol


def _coded_tables(tables: list[np.ndarray]) -> Iterator[bytes]:
    """Differences of the sorted ids, as numbers of seven bits a byte, the last without a high bit."""
    sizes = np.cumsum([len(t) for t in tables])
    whole = np.concatenate(tables).astype(np.int64)
    values = np.diff(whole, prepend=0)
    firsts = np.append(0, sizes[:-1])
    values[firsts] = whole[firsts]
    longest = max(1, -(-int(values.max()).bit_length() // 7))
    length = np.ones(len(values), dtype=np.int64)
    for i in range(1, longest):
        length += values >> 7 * i > 0
    stops = np.cumsum(length)
    data = np.zeros(stops[-1], dtype=np.uint8)
    for i in range(longest):
        held = np.flatnonzero(length > i)
        data[stops[held] - length[held] + i] = values[held] >> 7 * i & 127 | np.where(length[held] > i + 1, 128, 0)
    cuts = np.append(0, stops[sizes - 1]).tolist()
    return (data[a:b].tobytes() for a, b in zip(cuts, cuts[1:]))


def _unvarints(data: bytes) -> np.ndarray:
    """The numbers of such bytes."""
    raw = np.frombuffer(data, dtype=np.uint8)
    stops = np.flatnonzero(raw < 128) + 1
    length = np.diff(stops, prepend=0)
    found = np.zeros(len(stops), dtype=np.int64)
    for i in range(5):
        held = np.flatnonzero(length > i)
        found[held] |= (raw[stops[held] - length[held] + i] & 127).astype(np.int64) << 7 * i
    return found


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Coded blocks of non-empty id arrays (unsigned 32-bit), up to ``LANES`` side by side."""
    out: list[bytes] = [b""] * len(blocks)
    for group in _groups([len(b) for b in blocks]):
        for i, coded in zip(group, _encode([blocks[i] for i in group])):
            out[i] = coded
    return out


def _groups(lengths: list[int]) -> Iterator[list[int]]:
    """Numbers of the blocks in descending length, in as few groups as ``LANES`` allows, of like size."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    count = -(-len(order) // LANES)
    for k in range(count):
        yield order[len(order) * k // count : len(order) * (k + 1) // count]


def _numbered(blocks: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sorted distinct ids of each block, and its ids as numbers of these."""
    met, number, upto = np.zeros(1 << 16, dtype=bool), np.zeros(1 << 16, dtype=np.uint16), np.arange(BLOCK, dtype=np.uint16)
    for block in blocks:
        if block.max() < len(met):
            met[block] = True
            table = met.nonzero()[0]
            met[table] = False
            number[table] = upto[: len(table)]
            yield table, number.take(block)
        else:
            table = np.unique(block)
            yield table, np.searchsorted(table, block)


def _encode(blocks: list[np.ndarray]) -> Iterator[bytes]:
    """Blocks in descending length."""
    lengths = np.array([len(b) for b in blocks])
    lanes, steps = len(blocks), int(lengths[0])
    tables, numbers = [], np.zeros((lanes, steps), dtype=np.uint16)
    for lane, (table, local) in enumerate(_numbered(blocks)):
        tables.append(table)
        numbers[lane, : len(local)] = local
    model = Model(np.array([len(t) for t in tables]))
    low, span = np.zeros(lanes, dtype=np.uint64), np.full(lanes, 2**64 - 1, dtype=np.uint64)
    # Words of 32 bits, with room for what is carried into them, the first words of all lanes first.
    room = steps * (MIX + INNER + 1) // 32 + 4
    words = np.zeros(room * lanes, dtype=np.uint64)
    filled = np.arange(lanes)
    stride = np.int64(lanes)
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")
    # The number after the last distinct id stands for what comes before the first one.
    ahead = np.repeat(model.distinct[None].astype(np.uint16), 2, axis=0)
    for chunk in range(0, steps, CHUNK):
        used = int(active[chunk])
        model.rebuild(chunk, used)
        ahead = np.concatenate([ahead[-2:, :used], numbers[:used, chunk : chunk + CHUNK].T])
        symbols = ahead[2:]
        slots = model.slots(ahead[:-2], ahead[1:-1])
        chances = np.zeros(slots.shape, dtype=np.int32)
        differ, same = np.zeros(symbols.shape, dtype=bool), np.zeros(slots.shape, dtype=bool)
        for step, symbol in enumerate(symbols):
            used = int(active[chunk + step])
            model.predict(slots[step, :, :used])
            chances[step, :, :used], differ[step, :used] = model.chances, model.differ
            held = np.equal(model.found, symbol[:used], out=same[step, :, :used])
            model.update(symbol[:used], held)
        own = model.row_shares[: symbols.shape[1]] + symbols
        lows = model.flat_shares.take(own).astype(np.int32)
        shares = model.flat_shares.take(own + 1) - lows
        first, second = same[:, 0], same[:, 1]
        starts, sizes = _intervals(_parts(chances, differ), first, second > first, lows, shares)
        for step, (start, size) in enumerate(zip(starts, sizes)):
            used = int(active[chunk + step])
            start, lo, sp, to = start[:used], low[:used], span[:used], filled[:used]
            sp >>= UNIT
            start *= sp
            lo += start
            carry = (lo < start).nonzero()[0]
            words[to[carry] - lanes] += np.uint64(1)
            sp *= size[:used]
            narrow = (sp < LEAST).astype(np.int64)
            words[to] = lo >> WORD  # written over where the word is not settled yet
            to += narrow * stride
            shift = narrow.view(np.uint64) * WORD
            lo <<= shift
            sp <<= shift
        model.met.append(symbols)
    # One more word: the smallest above low whose following bits are zero lies in the interval.
    words[filled] = (low >> WORD) + ((low & (LEAST - np.uint64(1))) > 0)
    filled = filled // lanes + 1
    words = words.reshape(room, lanes)[: filled.max()]
    while (carried := words >> WORD).any():
        words &= LEAST - np.uint64(1)
        words[:-1] += carried[1:]
    words = words.T.astype("<u4", order="C")
    for lane, (block, table, head) in enumerate(zip(blocks, tables, _coded_tables(tables))):
        body = head + words[lane, : filled[lane]].tobytes()
        ids = zlib.crc32(block.astype("<u4").tobytes())
        yield struct.pack(HEADER, MAGIC, len(block), len(table), len(head), int(filled[lane]), ids, zlib.crc32(body)) + body


def split_blocks(data: bytes) -> list[bytes]:
    """Coded blocks of a concatenation."""
    found, at = [], 0
    while at < len(data):
        head = struct.unpack_from(HEADER, data, at)
        size = HEADER_BYTES + head[3] + 4 * head[4]
        found.append(data[at : at + size])
        at += size
    return found


def decode_blocks(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of coded blocks; a damaged block raises ValueError."""
    out: list[np.ndarray] = [np.zeros(0, dtype="<u4")] * len(coded)
    for group in _groups([struct.unpack_from(HEADER, c)[1] for c in coded]):
        for i, ids in zip(group, _decode([coded[i] for i in group])):
            out[i] = ids
    return out


def _decode(coded: list[bytes]) -> Iterator[np.ndarray]:
    heads = [struct.unpack_from(HEADER, c) for c in coded]
    for head, data in zip(heads, coded):
        if head[0] != MAGIC or len(data) != HEADER_BYTES + head[3] + 4 * head[4]:
            raise ValueError("not a block of this format")
        if zlib.crc32(data[HEADER_BYTES:]) != head[6]:
            raise ValueError("a block's checksum differs")
    lengths = np.array([h[1] for h in heads])
    lanes, steps = len(coded), int(lengths[0])
    differences = _unvarints(b"".join(c[HEADER_BYTES : HEADER_BYTES + h[3]] for h, c in zip(heads, coded)))
    tables = [np.cumsum(part) for part in np.split(differences, np.cumsum([h[2] for h in heads])[:-1])]
    room = max(h[4] for h in heads) + 3
    words = np.zeros((lanes, room), dtype=np.uint32)
    for lane, (head, data) in enumerate(zip(heads, coded)):
        words[lane, : head[4]] = np.frombuffer(data, dtype="<u4", offset=HEADER_BYTES + head[3])
    model = Model(np.array([len(t) for t in tables]))
    span = np.full(lanes, 2**64 - 1, dtype=np.uint64)
    # The code's distance from the lower end of the interval.
    code = words[:, 0].astype(np.uint64) << WORD | words[:, 1]
    words, read, stride = words.T.astype(np.uint64, order="C").ravel(), np.arange(lanes) + 2 * lanes, np.int64(lanes)
    symbols = np.zeros((steps, lanes), dtype=np.uint16)
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")
    before = last = model.distinct.astype(np.uint16)
    for chunk in range(0, steps, CHUNK):
        used = int(active[chunk])
        if model.rebuild(chunk, used):
            coarse = _first_level(model, used)
        for step in range(chunk, min(chunk + CHUNK, steps)):
            used = int(active[step])
            model.predict(model.slots(before[:used], last[:used]))
            parts = _parts(model.chances, model.differ)
            sp, co, at = span[:used], code[:used], read[:used]
            sp >>= UNIT
            target = (co // sp).astype(np.int32)
            guessed = parts[0] + parts[1]
            above = target - (guessed << LEFT)
            miss = above >= 0
            above *= miss
            symbol = _find(model, coarse, (above / parts[2]).astype(np.uint16))
            own = model.row_shares[:used] + symbol
            low = model.flat_shares.take(own).astype(np.int32)
            start = (guessed << LEFT) + low * parts[2]
            size = (model.flat_shares.take(own + 1) - low) * parts[2]
            held = (~miss).nonzero()[0]
            if len(held):
                order2, order1 = parts[0][held], parts[1][held]
                first = target[held] < order2 << LEFT
                start[held] = (order2 << LEFT) * ~first
                size[held] = np.where(first, order2, order1) << LEFT
                symbol[held] = np.where(first, *model.found[:, held])
            co -= start.astype(np.uint64) * sp
            sp *= size.astype(np.uint64)
            narrow = (sp < LEAST).astype(np.int64)
            shift = narrow.view(np.uint64) * WORD
            co <<= shift
            sp <<= shift
            # Lanes that need no word shift theirs out.
            co |= words.take(at) << shift >> WORD
            at += narrow * stride
            symbols[step, :used] = symbol
            model.update(symbol, model.found == symbol)
            before, last = last, symbol
        model.met.append(symbols[chunk : chunk + CHUNK, : int(active[chunk])])
    symbols = symbols.T.copy()
    for lane, (head, table) in enumerate(zip(heads, tables)):
        ids = table[symbols[lane, : head[1]]].astype("<u4")
        if zlib.crc32(ids.tobytes()) != head[5]:
            raise ValueError("a block's ids differ from their checksum")
        yield ids
